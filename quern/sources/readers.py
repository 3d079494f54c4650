"""Readers and writers: whole texts, marked-up editions, JSON collections, tables of metadata, worksheets, manifests.

All paths go through Spark's own readers and writers, so any store that Spark knows will do. Repeated work is
avoided by anti joins against what is stored, not by side files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions import text as T

MANIFEST = "id string, title string, kind string, uri string, path string, license string, attribution string, language string, skip boolean"
KINDS = ("quran", "hadith", "tafsir", "fiqh")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def looks_marked_up(text: Column, sentinel: str = "#META#", within: int = 4000) -> Column:
    return F.contains(F.substring(text, 1, within), F.lit(sentinel))


def version_parts(uri: Column) -> dict[str, Column]:
    """Year, author and book of a version address such as 0256Author.Book, and the 25-year bucket that holds it."""
    part = lambda i: F.regexp_extract(uri, r"^(\d{4})([A-Za-z]+)\.([A-Za-z0-9]+)", i)
    year = F.nullif(part(1), F.lit("")).cast("int")
    return {"year": year, "author": part(2), "book": part(3), "bucket": (F.ceil(year / 25) * 25).cast("int")}


# Years of a bucket, and the spellings of a version's address, best first.
BUCKET_YEARS = 25
SPELLINGS = (".mARkdownSimple", ".mARkdown", ".completed", ".inProgress", "")


def candidate_addresses(versions: DataFrame, base: str) -> DataFrame:
    """(uri, rank, address) of versions (uri): every spelling in the bucket of the year, then in the next and the one before, where there is one; addresses that are none of a version have no candidates."""
    own = versions.select("uri", *[F.regexp_extract("uri", r"^(\d{4})([A-Za-z]\w*)\.(\w+)\.(.+)$", i).alias(n) for i, n in enumerate(("year", "author", "book"), 1)]).where("year <> ''")
    years = F.array(*[F.struct(F.lit(i).alias("i"), (F.col("year").cast("int") + d).alias("y")) for i, d in enumerate((0, BUCKET_YEARS, -BUCKET_YEARS))])
    near = own.select("uri", "year", "author", "book", F.explode(years).alias("b")).where("b.y > 0")
    near = near.select("*", F.posexplode(F.array(*map(F.lit, SPELLINGS))).alias("e", "spelling"))
    bucket = F.concat(F.lpad((F.ceil(F.col("b.y") / BUCKET_YEARS) * BUCKET_YEARS).cast("string"), 4, "0"), F.lit("AH"))
    author, book = F.concat("year", "author"), F.concat("year", "author", F.lit("."), "book")
    rank = F.row_number().over(Window.partitionBy("uri").orderBy("b.i", "e"))
    return near.select("uri", rank.alias("rank"), F.concat(F.lit(base + "/"), bucket, F.lit("/master/data/"), author, F.lit("/"), book, F.lit("/"), "uri", "spelling").alias("address"))


def manifest(spark: SparkSession, rows: list[dict], defaults: dict) -> DataFrame:
    """The rows of a manifest with defaults; raises on a missing id, title or licence, an unknown kind, neither uri nor path, a repeated id."""
    names = [f.split()[0] for f in MANIFEST.split(", ")]
    full = [defaults | {k: v for k, v in r.items() if v is not None} for r in rows]
    for r in full:
        missing = [k for k in ("id", "title", "kind", "license") if not r.get(k)]
        if missing or r["kind"] not in KINDS or not (r.get("uri") or r.get("path")):
            raise ValueError(f"manifest entry {r.get('id')!r}: missing {missing or 'uri or path'} or unknown kind")
    if len({r["id"] for r in full}) < len(full):
        raise ValueError("manifest: repeated id")
    return spark.createDataFrame([tuple(bool(r.get(n)) if n == "skip" else r.get(n) for n in names) for r in full], MANIFEST)


def selected(df: DataFrame, ids: list[str] | None = None, kind: str | None = None) -> DataFrame:
    """Entries by id (skipped ones too, when named) or kind."""
    if ids:
        return df.where(F.col("id").isin(ids))
    df = df.where(~F.coalesce("skip", F.lit(False)))
    return df.where(F.col("kind") == kind) if kind else df


EDITION = "surahs array<struct<number:int,name:string,englishName:string,revelationType:string,ayahs:array<struct<number:int,numberInSurah:int,text:string,juz:int,page:int>>>>"


def verses(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """One row a verse of a nested JSON edition; limit: the first chapters alone."""
    s = spark.read.schema(EDITION).json(path, multiLine=True).select(F.posexplode("surahs").alias("at", "s"))
    if limit is not None:
        s = s.where(F.col("at") < limit)
    v = s.select(F.col("s.number").alias("surah"), F.col("s.name").alias("name"), F.explode("s.ayahs").alias("a"))
    return v.select("surah", "name", F.col("a.numberInSurah").alias("ayah"), F.col("a.text").alias("text"), F.col("a.juz").alias("juz"), F.col("a.page").alias("page"))


def with_translation(arabic: DataFrame, english: DataFrame) -> DataFrame:
    """Verses with their translation, '' where there is none."""
    e = english.select("surah", "ayah", F.col("text").alias("english"))
    return arabic.join(e, ["surah", "ayah"], "left").withColumn("english", F.coalesce("english", F.lit("")))


def collection(spark: SparkSession, arabic: str, english: str, least_words: int = 11) -> DataFrame:
    """(number, arabic, english) of two JSON files with an array ``hadiths``; of repeated numbers the last counts; both must say something."""
    def side(path: str, name: str) -> DataFrame:
        h = spark.read.schema("hadiths array<struct<hadithnumber:int,text:string>>").json(path, multiLine=True).select(F.posexplode("hadiths").alias("at", "h"))
        return h.groupBy(F.col("h.hadithnumber").alias("number")).agg(F.max_by("h.text", "at").alias(name))

    both = side(arabic, "arabic").join(side(english, "english"), "number")
    return both.where((F.trim("english") != "") & (F.size(T.words(T.normalize_arabic(F.col("arabic")))) >= least_words))


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True)


def expected(spark: SparkSession, path: str) -> DataFrame:
    """(question, slugs) of a test set: blank and # lines are skipped, - is the empty set."""
    lines = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != ""))
    p = F.split("value", "\t", 2)
    slugs = F.trim(F.get(p, F.lit(1)))
    return lines.select(F.trim(p[0]).alias("question"), F.when(slugs == "-", F.array().cast("array<string>")).otherwise(F.split(slugs, r"\|")).alias("slugs"))


def quotes(spark: SparkSession, path: str) -> DataFrame:
    """(chunk_id, quote) of lines ``id::quote``."""
    p = F.split("value", "::", 2)
    return spark.read.text(path).where(F.contains("value", F.lit("::"))).select(p[0].cast("long").alias("chunk_id"), p[1].alias("quote"))


def pending(texts: DataFrame, cache: DataFrame, model: str) -> DataFrame:
    """Distinct texts whose embedding by this model is not stored yet: (key, text)."""
    own = texts.select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    return own.join(cache.where(F.col("model") == model).select("key"), "key", "left_anti")


def write_parts(df: DataFrame, path: str, part: str) -> None:
    """Replaces the parts that df holds and leaves the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)


def write_new(df: DataFrame, path: str) -> None:
    """One folder a slug; never over what exists."""
    df.select("slug", "value").write.mode("errorifexists").partitionBy("slug").text(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def listed(path: str) -> list[dict]:
    """The entries of a YAML or JSON list, a bounded file of settings read on the driver; a mapping's list under ``entries`` will do, too."""
    import json

    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        got = json.loads(text)
    except ValueError:
        import yaml

        got = yaml.safe_load(text)
    return got.get("entries", []) if isinstance(got, dict) else list(got or [])


def questions(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """(slug, question) of a list of questions; raises ValueError on an entry without either and on a repeated slug."""
    seen: set[str] = set()
    for r in rows:
        if not r.get("slug") or not r.get("question"):
            raise ValueError(f"entry without slug or question: {r!r}")
        if r["slug"] in seen:
            raise ValueError(f"repeated slug: {r['slug']}")
        seen.add(r["slug"])
    return spark.createDataFrame([(r["slug"], r["question"]) for r in rows], "slug string, question string")


def cached_lines(spark: SparkSession, path: str, model: str) -> DataFrame:
    """(key, model, embedding) of JSON lines {key, embedding}: torn lines are skipped, of a repeated key any one counts."""
    rows = spark.read.schema("key string, embedding array<float>").option("mode", "DROPMALFORMED").json(path)
    return rows.where("key is not null and embedding is not null").dropDuplicates(["key"]).select("key", F.lit(model).alias("model"), "embedding")


def append_rows(df: DataFrame, path: str) -> None:
    """Appends to a stored log or cache; a job that fails leaves nothing behind."""
    df.write.mode("append").parquet(path)
