"""Glossaries as tables: terms found in texts by one automaton, their expansions added to what is asked.

The automaton is built once in each task from the terms, which are broadcast after a check of their size, and reads a text once whatever the number of terms.

Cases: terms without a token and null sides are left out; a term that stands in several rows has its expansions joined in order; null text has none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from quern.operators.automata import Terms

#: Code points of terms and expansions that are broadcast at most.
MOST_CHARS = 20_000_000


def merged(glossary: DataFrame) -> DataFrame:
    """(term, expansion) of a glossary (term, expansion, place): one row a term in lower case, its expansions in order of place."""
    rows = glossary.where("term is not null and expansion is not null").select(F.lower("term").alias("term"), "place", "expansion")
    return rows.groupBy("term").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "expansion"))), lambda x: x["expansion"]), ", ").alias("expansion"))


def finder(glossary: DataFrame):
    """A function of a text column to the distinct expansions of the terms in it, in order; raises ValueError for a glossary (term, expansion, place) that is too large to send to tasks."""
    one = merged(glossary)
    if (one.agg(F.sum(F.length("term") + F.length("expansion"))).first()[0] or 0) > MOST_CHARS:
        raise ValueError(f"a glossary has at most {MOST_CHARS} characters")
    table = one.sparkSession.sparkContext.broadcast({r["term"]: r["expansion"] for r in one.collect()})

    @F.pandas_udf(ArrayType(StringType()))
    def expansions(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        terms = Terms(list(table.value))
        for s in series:
            yield s.map(lambda t: list(dict.fromkeys(table.value[x] for x in terms.find(t))) if isinstance(t, str) else [])

    return expansions


def glossed(text: Column, expansions: Column) -> Column:
    """text with its expansions in brackets."""
    return F.when(F.size(expansions) > 0, F.concat(text, F.lit(" ("), F.array_join(expansions, "; "), F.lit(")"))).otherwise(text)
