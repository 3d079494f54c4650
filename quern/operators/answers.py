"""Small operators over answers: paragraphs, intervals, buckets, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def paragraphs_with(body: Column, mark: str, gap: str = r"\n\s*\n") -> Column:
    return F.filter(F.split(body, gap), lambda p: F.contains(p, F.lit(mark)))


def merge_intervals(df: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """Unions of overlapping or touching [lo, hi] within keys: gaps and islands, one shuffle."""
    order = Window.partitionBy(*keys).orderBy(lo, hi)
    reach = F.max(hi).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(reach.isNull() | (F.col(lo) > reach), 1).otherwise(0))
    df = df.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_island").agg(F.min(lo).alias(lo), F.max(hi).alias(hi)).drop("_island")


def age_bucket(seconds: Column, pinned: Column) -> Column:
    day = 86_400
    return F.when(pinned, "Pinned").when(seconds < day, "Today").when(seconds <= 7 * day, "Previous 7 days").when(seconds <= 30 * day, "Previous 30 days").otherwise("Older")


#: Kinds that are scripture or a commentary on it.
SCRIPTURE = ("quran", "tafsir")
#: Scores below which a scripture hit is looked at; tier of questions that are declined.
STRONG, DECLINED = 0.15, "C"


def verdict(before_kind: Column, after_kind: Column, before_ref: Column, after_ref: Column, scripture: tuple[str, ...] = SCRIPTURE) -> Column:
    """What a change did to the best hit: MOVED off scripture, REGRESSED onto it, shifted to another reference, or same."""
    was, now = before_kind.isin(*scripture), after_kind.isin(*scripture)
    return F.when(was & ~now, "MOVED").when(~was & now, "REGRESSED").when(before_ref != after_ref, "shifted").otherwise("same")


def gloss_audit(before: DataFrame, after: DataFrame, scripture: tuple[str, ...] = SCRIPTURE) -> DataFrame:
    """Best hits (query_id, kind, ref, score) without and with the glossary side by side, with the ratio of scores (null where there was none) and the verdict."""
    side = lambda df, name: df.select("query_id", *[F.col(c).alias(f"{name}_{c}") for c in ("kind", "ref", "score")])
    both = side(before, "before").join(side(after, "after"), "query_id")
    change = verdict(F.col("before_kind"), F.col("after_kind"), F.col("before_ref"), F.col("after_ref"), scripture)
    return both.withColumn("ratio", F.col("after_score") / F.nullif("before_score", F.lit(0.0))).withColumn("verdict", change)


def tier_flag(tier: Column, section: Column, kind: Column, source: Column, score: Column, legal: tuple[str, ...], wants_scripture: tuple[str, ...], scripture: tuple[str, ...] = SCRIPTURE) -> Column:
    """CHECK where a practical question's best hit is scripture, or a commentary that is no work of law, with a weak score; ok else, also in sections that scripture answers."""
    top = (kind == scripture[0]) | (kind.isin(*scripture[1:]) & ~source.isin(*legal))
    return F.when((tier != DECLINED) & ~F.coalesce(section, F.lit("")).isin(*wants_scripture) & top & (score < STRONG), "CHECK").otherwise("ok")


def sections(lines: DataFrame) -> DataFrame:
    """(file, slug, number, title) of lines (file, line, raw): each slug with the last banner above it; slugs above all banners are left out, of a repeated slug the last counts."""
    banner = F.regexp_extract("raw", r"^#\s*(\d+)\.\s*(.+?)\s*$", 1)
    mark = F.when(banner != "", F.struct(banner.cast("int").alias("number"), F.regexp_extract("raw", r"^#\s*(\d+)\.\s*(.+?)\s*$", 2).alias("title")))
    upto = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    slug = F.when(banner == "", F.nullif(F.regexp_extract("raw", r"^-\s*slug:\s*(\S+)\s*$", 1), F.lit("")))
    under = lines.select("file", "line", slug.alias("slug"), F.last(mark, ignorenulls=True).over(upto).alias("at")).where("slug is not null and at is not null")
    return under.groupBy("file", "slug").agg(F.max_by("at", "line").alias("at")).select("file", "slug", "at.number", "at.title")
