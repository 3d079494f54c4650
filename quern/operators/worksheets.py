"""Worksheets and answers: sections, passages and citations of a worksheet; inline markup; grounding of an answer."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import text as T

# References that an answer may name.
VERSE = r"\b(\d{1,3}:\d{1,3})\b"
COLLECTION = r"(?i)\b(Bukhari|Abu\s?Dawud|Tirmidhi|Nasa'?i|Ibn\s?Majah|Muwatta|Bayhaqi|Darimi)\b"
AMBIGUOUS = r"(?i)(?:\b(?:Sahih|Musnad|narrated\s+(?:by|in)|reported\s+(?:by|in)|related\s+by|collected\s+(?:by|in))\s+(Muslim|Ahmad)\b)|\b(Muslim|Ahmad)\s+\d{1,3}:\d{1,4}\b"
# The lines of a worksheet that hold a passage and a citation.
PASSAGE = r"(?m)^### Passage (\d+) —[\s\S]*?^- kind: .*? chunk: (\d+)\s*$"
CITATION = r'(?m)^\s*(\d+)\.\s*passage=(\d+)\s+quote="([\s\S]*?)"\s*$'
_BLANK = " \n\t\r"
# What a new worksheet says before its passages.
SHEET = "## Answer\n\n<!-- The answer, with marks [1], [2] for its citations. -->\n\n## Citations\n\n<!-- A line each: number, passage and the exact words quoted. -->\n\n## Passages\n\n"


def section(c: Column, name: str) -> Column:
    """Text of the first section whose heading is ``name``, up to the next heading of that level, comments taken out; '' without one."""
    body = F.regexp_extract(c, rf"(?ms)^## [ \t]*{re.escape(name)}[ \t]*$(.*?)(?=^## |\z)", 1)
    return F.trim(T.sub(body, r"(?s)<!--.*?-->"), F.lit(_BLANK))


def rendered(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """(slug, value): a worksheet to fill in for each question that has hits, in the form that ``passages`` and ``citations`` read.

    asked: (slug, question, also: array of further queries, note, decline); hits: (slug, query: 0 for the question, n for the n-th further one, rank,
    chunk_id, kind, ref, title, text, paged), the top of each query, so those of a slug are few. A chunk that several queries found
    stands where the first of them has it. Null also, note and decline: none; null paged: has pages; other nulls are empty; a null slug has no worksheet.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    facts = [text("kind").alias("kind"), text("ref").alias("ref"), text("title").alias("title"), F.trim(text("text"), F.lit(_BLANK)).alias("text"), F.coalesce("paged", F.lit(True)).alias("paged")]
    first = hits.where("slug IS NOT NULL AND chunk_id IS NOT NULL").groupBy("slug", "chunk_id").agg(F.min(F.struct("query", "rank", *facts)).alias("h"))
    found = first.groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("h.query", "h.rank", "chunk_id", *[f"h.{c}" for c in ("kind", "ref", "title", "text", "paged")]))).alias("found"))

    def passage(h: Column, i: Column) -> Column:
        via = F.when(h["query"] > 0, F.concat(F.lit('- found via: "'), F.coalesce(F.get("also", h["query"] - 1), F.lit("")), F.lit('"\n'))).otherwise("")
        head = F.concat(F.lit("### Passage "), (i + 1).cast("string"), F.lit(" — "), h["ref"], F.when(h["paged"], "").otherwise(" (chapter-level, no page)"))
        facts = F.concat(F.lit("\n\n- kind: "), h["kind"], F.lit(" · source: "), h["title"], F.lit(" · chunk: "), h["chunk_id"].cast("string"), F.lit("\n"))
        return F.concat(head, facts, via, F.lit("\n```\n"), h["text"], F.lit("\n```\n"))

    decline = F.when(F.col("decline"), "> Expected to decline: say who can help, give no ruling, cite only what the question touches.\n\n").otherwise("")
    note = F.when(F.col("note") != "", F.concat(F.lit("> Reviewer note: "), "note", F.lit("\n\n"))).otherwise("")
    top = F.concat(F.lit("# "), text("question"), F.lit("\n\n"), decline, note, F.lit(SHEET))
    return asked.join(found, "slug").select("slug", F.concat(top, F.array_join(F.transform("found", passage), "\n")).alias("value"))


def _rows(df: DataFrame, c: Column, pattern: str, names: dict[str, str]) -> DataFrame:
    """One row of df's slug for each match of pattern in c, its groups cast to the kinds of names."""
    x = df.select("slug", F.explode(F.regexp_extract_all(c, F.lit(pattern), F.lit(0))).alias("m"))
    return x.select("slug", *[F.trim(F.regexp_extract("m", pattern, i), F.lit(_BLANK)).cast(kind).alias(n) for i, (n, kind) in enumerate(names.items(), 1)])


def passages(df: DataFrame) -> DataFrame:
    """(slug, number, chunk_id) of worksheets (slug, text): the passages that were retrieved. Null text has none."""
    return _rows(df, F.col("text"), PASSAGE, {"number": "int", "chunk_id": "long"})


def citations(df: DataFrame) -> DataFrame:
    """(slug, ordinal, passage, quote) of the section Citations of worksheets (slug, text). Null text has none."""
    return _rows(df, section(F.col("text"), "Citations"), CITATION, {"ordinal": "int", "passage": "int", "quote": "string"})


def unverified(answer: Column, cited: Column) -> Column:
    """References that an answer names but that stand in none of its cited texts and titles (an array), each once whatever its case."""
    fold = lambda c: T.sub(c, r"(?i)\bab[uio]\b", "abu")
    sources = fold(T.squeeze(F.array_join(cited, "\n")))
    found = lambda p: F.transform(F.regexp_extract_all(answer, F.lit(p), F.lit(0)), T.squeeze)
    verses = F.filter(F.array_distinct(found(VERSE)), lambda r: ~F.contains(sources, r))
    named = F.concat(found(COLLECTION), found(AMBIGUOUS))
    first = F.filter(named, lambda r, i: F.array_position(F.transform(named, F.lower), F.lower(r)) == i + 1)
    return F.concat(verses, F.filter(first, lambda r: ~F.contains(F.lower(sources), F.lower(fold(r)))))


def uncited(answer: Column, cited: Column) -> Column:
    return (F.length(F.trim(answer)) > 400) & (F.size(cited) == 0)


# The inline marks. Emphasis may run over a line break but not over a blank line; bold may hold asterisks.
_LINE = r"\n(?!\s*\n)"
_INLINE = re.compile(rf"\*\*(?P<strong>(?:[^\n]|{_LINE})+?)\*\*(?!\*)|\*(?P<em>(?:[^*\n]|\*\*|{_LINE})+?)\*(?!\*)|`(?P<code>[^`]+?)`|\[(?P<cite>\d{{1,3}})\]")
_ARABIC = re.compile("[\u0600-\u06FF\u0750-\u077F\uFB50-\uFDFF\uFE70-\uFEFF]")
ARABIC_BLOCK_CHARS, INLINE_DEPTH = 60, 2


def inline_nodes(df: DataFrame) -> DataFrame:
    """(id, path, kind, text, block) of df (id, text): the nodes in order of their paths, two levels of emphasis deep.

    path: places from the outermost node inwards, so ``[2, 0]`` is the first node in the third. kind: text, code, arabic (code in Arabic script; block
    if it is long) and cite hold text; strong and em hold nodes. Joined, the texts give back all characters but the marks. Null and empty text: none.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[tuple] = []
            for i, whole in zip(f["id"], f["text"]):
                todo: list[tuple[list[int], str]] = [([], whole or "")]
                while todo:
                    path, text = todo.pop()
                    at, n = 0, 0
                    for m in _INLINE.finditer(text) if len(path) <= INLINE_DEPTH else ():
                        if m.start() > at:
                            out.append((i, [*path, n], "text", text[at : m.start()], False))
                            n += 1
                        kind, inner = m.lastgroup, m[m.lastgroup]
                        if kind in ("strong", "em"):
                            out.append((i, [*path, n], kind, None, False))
                            todo.append(([*path, n], inner))
                        else:
                            arabic = kind == "code" and bool(_ARABIC.search(inner))
                            out.append((i, [*path, n], "arabic" if arabic else kind, inner, arabic and len(inner) > ARABIC_BLOCK_CHARS))
                        n, at = n + 1, m.end()
                    if at < len(text):
                        out.append((i, [*path, n], "text", text[at:], False))
            yield pd.DataFrame(out, columns=["id", "path", "kind", "text", "block"])

    kind = df.schema["id"].dataType.simpleString()
    return df.select("id", "text").mapInPandas(run, f"id {kind}, path array<int>, kind string, text string, block boolean")
