"""Write-path operators as functions of DataFrames: the new table from the old one and a change. And checks of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of new replace those of old with the same keys; others stay."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Rows of new whose keys old lacks, the first of each key in the order given; columns for the order alone are dropped."""
    once = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return old.unionByName(once.join(old.select(*keys), keys, "left_anti").select(old.columns))


def replace_parts(old: DataFrame, new: DataFrame, part: str) -> DataFrame:
    """Whole parts of new take the place of old ones (what a dynamic partition overwrite stores)."""
    return old.join(new.select(part).distinct(), part, "left_anti").unionByName(new)


def drop_stale(old: DataFrame, live: DataFrame, keys: list[str]) -> DataFrame:
    return old.join(live.select(*keys).distinct(), keys, "left_semi")


def cascade(children: DataFrame, gone: DataFrame, key: str, set_null: bool = False) -> DataFrame:
    """Children of removed parents go, or keep their row without the parent."""
    if not set_null:
        return children.join(gone.select(key).distinct(), key, "left_anti")
    mark = gone.select(key).distinct().withColumn("_gone", F.lit(True))
    return children.join(mark, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone").select(children.columns)


def backfill(df: DataFrame, facts: DataFrame, key: str, column: str, empty: Column) -> DataFrame:
    """column of rows where ``empty`` holds comes from facts (key, column)."""
    found = facts.select(key, F.col(column).alias("_new"))
    return df.join(found, key, "left").withColumn(column, F.when(empty, F.coalesce("_new", column)).otherwise(F.col(column))).drop("_new").select(df.columns)


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break a unique constraint."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, n): rows that break each rule, in one pass; null counts as broken."""
    sums = df.agg(*[F.coalesce(F.count_if(~F.coalesce(c, F.lit(False))), F.lit(0)).alias(k) for k, c in rules.items()])
    return sums.select(F.explode(F.create_map(*[x for k in rules for x in (F.lit(k), F.col(k))])).alias("rule", "n"))


def difference(stored: DataFrame, produced: DataFrame) -> DataFrame:
    """(stored, produced, extra, lacking), one row: counts of rows, of stored ones not produced and of produced ones not stored; repeated rows each count."""
    key = F.xxhash64(*stored.columns), F.hash(*stored.columns)
    side = lambda df, name: df.select(stored.columns).groupBy(key[0].alias("a"), key[1].alias("b")).agg(F.count(F.lit(1)).alias(name))
    both = side(stored, "s").join(side(produced, "p"), ["a", "b"], "full").select(F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("p", F.lit(0)).alias("p"))
    total = lambda c, name: F.coalesce(F.sum(c), F.lit(0)).alias(name)
    return both.agg(total("s", "stored"), total("p", "produced"), total(F.greatest(F.col("s") - F.col("p"), F.lit(0)), "extra"), total(F.greatest(F.col("p") - F.col("s"), F.lit(0)), "lacking"))


def changed_sets(old: DataFrame, new: DataFrame, key: str, member: str) -> DataFrame:
    """(key, added, removed) of keys whose sets of members differ; only members that one side lacks are gathered."""
    side = lambda df, name: df.select(key, member).distinct().withColumn(name, F.lit(True))
    one = side(old, "_old").join(side(new, "_new"), [key, member], "full").where("_old is null or _new is null")
    listed = lambda c: F.sort_array(F.collect_list(F.when(F.col(c), F.col(member))))
    return one.groupBy(key).agg(listed("_new").alias("added"), listed("_old").alias("removed"))


def in_list(column: Column, values: list | None) -> Column:
    """Rows of a list of values; of all where there is no list."""
    return F.lit(True) if values is None else column.isin(values)


def is_or_all(column: Column, value: str, every: str = "all") -> Column:
    """Rows of one value, or of all by the value that stands for them."""
    return F.lit(True) if value == every else column == value


def after_transition(answers: DataFrame, action: str, reviewer: Column, ready: Column) -> DataFrame:
    """Review transitions: publish needs a reviewer and embedded phrasings, save goes back to draft unless published, reject never touches published ones."""
    status = F.col("status")
    new = {
        "publish": F.when(reviewer.isNotNull() & ready, "published").otherwise(status),
        "reject": F.when(status == "published", status).otherwise("rejected"),
        "save": F.when(status == "published", status).otherwise("draft"),
    }[action]
    return answers.withColumn("status", new)
