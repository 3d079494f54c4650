"""The stored tables' schemas by version, oldest first: what a migration would have added is added when a table is read.

``conform`` brings rows of any version to the newest: missing columns are null, or the default that their version gave them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

VERSIONS: dict[str, list[str]] = {
    "embedding_cache": ["key string, model string, embedding array<float>"],
    "query_log": ["query_text string, matched boolean, created_at timestamp", "query_text string, matched boolean, created_at timestamp, answer_id long, score double"],
    "answers": ["id long, slug string, question string, body string, status string", "id long, slug string, question string, body string, status string, reviewed_by string, reviewed_at timestamp, published_at timestamp"],
}
DEFAULTS = {"answers": {"status": "draft"}}


def newest(table: str) -> StructType:
    return StructType.fromDDL(VERSIONS[table][-1])


def version(df: DataFrame, table: str) -> int:
    """The newest version whose columns df all has, from 1; 0 if it has those of none."""
    own = set(df.columns)
    return max((i for i, ddl in enumerate(VERSIONS[table], 1) if set(StructType.fromDDL(ddl).names) <= own), default=0)


def conform(df: DataFrame, table: str) -> DataFrame:
    """df with the newest schema's columns in its order, others dropped; ValueError where df is no version of the table."""
    if not version(df, table):
        raise ValueError(f"not a version of {table}: {df.columns}")
    own, given = set(df.columns), DEFAULTS.get(table, {})
    value = lambda f: F.col(f.name) if f.name in own else F.lit(None)
    return df.select(*[F.coalesce(value(f), F.lit(given.get(f.name))).cast(f.dataType).alias(f.name) for f in newest(table)])
