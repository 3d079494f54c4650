"""Operator 13: grouping of spelling variants without pairs.

Words are counted over whole texts. Two words that differ by a replaced code point share a wildcard group: the position
and what stands before and after it. A group has at most as many words as the alphabet has letters; it keeps its size and its two most frequent
words, so each member learns its number of partners and the best of them, and no pair is written. A word without one code point
meets the vocabulary by an equi join: both ends count each other. Contributions are summed by word. Each word's form is at least five times as frequent, so chains of forms
are short and are followed by doubling.

Cases: null and empty text has no words; a null doc_id hashes as the empty string; repeated rows count each; ties of frequency go to the smallest word in code-point order;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT, RATIO, TYPO = 6, 5, 5, 199


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of docs (doc_id, text); every TYPO-th run, by its hash with the document's number, has lost a letter.

    Shorter runs can't become words, so they are not taken out of the text at all.
    """
    runs = F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(f"[A-Za-z\\u00C0-\\u00FF]{{{least_length},}}"), F.lit(0))
    df = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run"))
    df = df.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("run"))
    return df.select(word.alias("word")).where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_count)


def _ranked(n: Column, word: Column) -> Column:
    """The smallest of these is the most frequent word, of equals the smallest."""
    return F.struct((-n).alias("m"), word.alias("word"))


def near(words: DataFrame) -> DataFrame:
    """(word, n_near, best) of words (word, n) that have near words; best is (m, word): the most frequent one, m its n negated."""
    spots = words.select("word", "n", F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at"))
    spots = spots.select("word", "n", "at", F.substring("word", F.lit(1), F.col("at") - 1).alias("prefix"), F.substring("word", F.col("at") + 1, F.length("word")).alias("suffix"))
    # Members of a group differ in one code point of the alphabet, so they are at most as many.
    groups = spots.groupBy("at", "prefix", "suffix").agg(F.sort_array(F.collect_list(_ranked(F.col("n"), F.col("word")))).alias("all")).where(F.size("all") > 1)
    groups = groups.select((F.size("all") - 1).cast("long").alias("k"), F.col("all")[0].alias("first"), F.col("all")[1].alias("second"), F.explode("all.word").alias("word"))
    replaced = groups.select("word", "k", F.when(F.col("word") == F.col("first.word"), F.col("second")).otherwise(F.col("first")).alias("best"))
    # A run of equal letters gives the same word whichever of them goes: the first stands for it.
    again = (F.col("at") > 1) & (F.substring("prefix", -1, 1) == F.substring("word", F.col("at"), F.lit(1)))
    shorter = spots.where(~again).select("word", "n", F.concat("prefix", "suffix").alias("short"))
    met = shorter.join(words.select(F.col("word").alias("short"), F.col("n").alias("short_n")), "short")
    ends = F.array(F.struct(F.col("word").alias("word"), _ranked(F.col("short_n"), F.col("short")).alias("best")), F.struct(F.col("short").alias("word"), _ranked(F.col("n"), F.col("word")).alias("best")))
    indels = met.select(F.explode(ends).alias("e")).select("e.word", F.lit(1).cast("long").alias("k"), "e.best")
    return replaced.unionByName(indels).groupBy("word").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(word, root) of forms (word, form): the end of each chain, by doubling; a form that has none is its own root."""
    paths, k = scratch.stage(forms.select("word", F.col("form").alias("root")), "paths-0"), 0
    while True:
        onward = paths.select(F.col("word").alias("root"), F.col("root").alias("next"))
        more = paths.join(onward, "root", "left")
        if more.where("next is not null").isEmpty():
            return paths
        k += 1
        paths = scratch.stage(more.select("word", F.coalesce("next", "root").alias("root")), f"paths-{k}")
        scratch.drop(f"paths-{k - 1}")


def variants(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (doc_id, text)."""
    scratch = scratch or Scratch(docs.sparkSession, "spelling")
    words = scratch.stage(vocabulary(docs), "words")
    known = words.join(near(words), "word", "left").withColumn("best_n", -F.col("best.m"))
    strong = F.col("best_n") >= RATIO * F.col("n")
    known = known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(strong, F.col("best.word")).alias("form"), F.when(strong, F.col("best_n")).alias("form_n"))
    known = scratch.stage(known, "known")
    ends = roots(known.where("form is not null"), scratch)
    return known.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: crc32 bit by bit over the UTF-8 bytes, which are one or two for these letters.
OP13_SQL = r"""
WITH RECURSIVE r AS (SELECT coalesce(doc_id::VARCHAR, '') AS doc, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]{6,}')) AS run FROM documents),
b AS (SELECT run, flatten(list_transform(string_split(doc || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195::BIGINT, unicode(c)::BIGINT - 64] END)) AS bytes FROM r),
h AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))), 4294967295::BIGINT) AS h FROM b),
o AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
s AS (SELECT word, n, i, left(word, i::INT - 1) AS a, substr(word, i::INT + 1) AS z FROM w, range(1, 1000) t(i) WHERE i <= length(word)),
p AS (SELECT x.word, y.word AS other, y.n AS m FROM s x JOIN s y USING (i, a, z) WHERE x.word <> y.word UNION SELECT s.word, w.word, w.n FROM s JOIN w ON w.word = a || z UNION SELECT w.word, s.word, s.n FROM s JOIN w ON w.word = a || z),
g AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, CASE WHEN m >= 5 * n THEN other END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN m END AS form_n FROM w LEFT JOIN g USING (word)),
c AS (SELECT word, word AS root FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, e.root, f.n, f.n_near, f.form_n FROM f JOIN (SELECT c.word, c.root FROM c JOIN f ON f.word = c.root WHERE f.form IS NULL) e ON e.word = f.word
"""
