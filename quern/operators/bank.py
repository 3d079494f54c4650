"""The answer bank: publication gate, drafts, ownership, citation repair, sweeps and the ladder of reranker forms.

Every function takes and returns DataFrames; a guard that refuses a batch is a join with the one row that counts its refusals, so it
needs no action on the driver. Empty inputs give empty results; null keys match nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vector as V

PUBLISHED, DRAFT = "published", "draft"
LADDER_MARGIN, LADDER_SHOWN = 0.15, 3


def published(answers: DataFrame) -> DataFrame:
    """The only way in which serving reads answers."""
    return answers.where(F.col("status") == PUBLISHED)


def save_drafts(answers: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(table, refused ids): rows of new replace those of one id as drafts, but never a published one."""
    kept = published(answers).select("id")
    allowed = new.join(kept, "id", "left_anti").withColumn("status", F.lit(DRAFT))
    table = answers.join(allowed.select("id").distinct(), "id", "left_anti").unionByName(allowed, allowMissingColumns=True)
    return table, new.join(kept, "id", "left_semi").select("id").distinct()


def refusals(targets: DataFrame, phrasings: DataFrame, citations: DataFrame) -> DataFrame:
    """(id, reason, n) of targets (id) that may not be published; phrasings (answer_id, embedding), citations (answer_id)."""
    bare = phrasings.where(V.unembedded(F.col("embedding"))).groupBy(F.col("answer_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    unembedded = targets.join(bare, "id").select("id", F.lit("unembedded phrasings").alias("reason"), "n")
    uncited = targets.join(citations.select(F.col("answer_id").alias("id")), "id", "left_anti")
    return unembedded.unionByName(uncited.select("id", F.lit("no citations").alias("reason"), F.lit(0).cast("long").alias("n")))


def publish(answers: DataFrame, targets: DataFrame, refused: DataFrame, reviewer: str | None, unreviewed: bool = False) -> DataFrame:
    """answers (id, status, reviewed_by) with all targets published, or as they were if any target is refused.

    Either a named reviewer or ``unreviewed``, not both: ValueError.
    """
    if bool(reviewer) == unreviewed:
        raise ValueError("publishing needs a reviewer, or unreviewed=True, and not both")
    clear = refused.agg((F.count(F.lit(1)) == 0).alias("_clear"))  # one row
    marked = answers.join(targets.select("id").distinct().withColumn("_go", F.lit(True)), "id", "left").crossJoin(F.broadcast(clear))
    go = F.col("_clear") & F.coalesce("_go", F.lit(False))
    by = F.lit(reviewer).cast("string")
    return marked.withColumn("status", F.when(go, PUBLISHED).otherwise(F.col("status"))).withColumn("reviewed_by", F.when(go, by).otherwise(F.col("reviewed_by"))).drop("_go", "_clear")


def unpublish(answers: DataFrame, targets: DataFrame) -> DataFrame:
    """Published targets go back to drafts without a reviewer."""
    marked = answers.join(targets.select("id").distinct().withColumn("_go", F.lit(True)), "id", "left")
    go = F.coalesce("_go", F.lit(False)) & (F.col("status") == PUBLISHED)
    # Both columns at once: the reviewer depends on the status before.
    return marked.withColumns({"status": F.when(go, DRAFT).otherwise(F.col("status")), "reviewed_by": F.when(~go, F.col("reviewed_by"))}).drop("_go")


def owned(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (id, user_id, ...) whose user owns the row; the others find nothing."""
    return requests.join(rows.select("id", "user_id"), ["id", "user_id"], "left_semi")


def pinned(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """rows (id, user_id, pinned_at) after requests (id, user_id, pin boolean, at), the last of each id by time; a pin by a stranger changes nothing."""
    last = owned(rows, requests).groupBy("id").agg(F.max_by(F.struct("pin", "at"), "at").alias("_r"))
    new = F.when(F.col("_r.pin"), F.col("_r.at"))
    return rows.join(last, "id", "left").withColumn("pinned_at", F.when(F.col("_r").isNull(), F.col("pinned_at")).otherwise(new)).drop("_r")


def removed(rows: DataFrame, requests: DataFrame) -> DataFrame:
    """rows without those that their owners asked to delete."""
    return rows.join(owned(rows, requests).select("id").distinct(), "id", "left_anti")


def touched(rows: DataFrame, uses: DataFrame) -> DataFrame:
    """rows (id, updated_at) with the time of their last use (id, at), if that is later."""
    last = uses.groupBy("id").agg(F.max("at").alias("_at"))
    return rows.join(last, "id", "left").withColumn("updated_at", F.greatest("updated_at", "_at")).drop("_at")


def broken(citations: DataFrame, answers: DataFrame) -> DataFrame:
    """Citations of answers that still exist (answer_id = id) but whose chunk is lost."""
    return citations.where("chunk_id is null").join(answers.select(F.col("id").alias("answer_id")), "answer_id", "left_semi")


def cite(links: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """New citations from (answer_id, ordinal, chunk_id): the printed reference is copied from the chunk, or its document; links to no chunk give none."""
    refs = chunks.select("chunk_id", "document_id", "chunk_ref").join(documents.select("document_id", "document_ref"), "document_id")
    refs = refs.select("chunk_id", T.effective_ref(F.col("chunk_ref"), F.col("document_ref")).alias("canonical_ref"))
    return links.join(refs, "chunk_id").select("answer_id", "ordinal", "chunk_id", "canonical_ref")


def checked_quotes(quotes: DataFrame, chunks: DataFrame) -> DataFrame:
    """quotes (chunk_id, quote, ...) with verdict: BAD without words to look for, GONE without the chunk, ok or MISS by whether its words are there."""
    texts = chunks.select("chunk_id", T.quote_words(F.coalesce("content", F.lit(""))).alias("_c"), F.lit(True).alias("_here"))
    own = quotes.withColumn("_q", T.quote_words(F.coalesce("quote", F.lit("")))).join(texts, "chunk_id", "left")
    verdict = F.when(F.coalesce("quote", F.lit("")) == "", "BAD").when(F.col("_here").isNull(), "GONE").when(F.contains("_c", F.col("_q")), "ok").otherwise("MISS")
    return own.withColumn("verdict", verdict).drop("_q", "_c", "_here")


def translation_findings(translations: DataFrame, chunks: DataFrame, own_kind: str = "quran") -> DataFrame:
    """(id, finding) of translations (id, chunk_id, matched, coverage, english) that break a rule of chunks (chunk_id, kind, text): the run that was matched is empty or not in its
    chunk, the share is none, the English is empty, or the chunk is of a kind that has a translation of its own."""
    own = chunks.select("chunk_id", "kind", T.quote_words(F.coalesce("text", F.lit(""))).alias("_t"))
    df = translations.withColumn("_m", T.quote_words(F.coalesce("matched", F.lit("")))).join(own, "chunk_id", "left")
    rules = {
        "empty run": F.col("_m") == "", "not in the chunk": (F.col("_m") != "") & ~F.coalesce(F.contains("_t", F.col("_m")), F.lit(False)), "coverage": ~F.coalesce((F.col("coverage") > 0) & (F.col("coverage") <= 1), F.lit(False)),
        "no English": F.trim(F.coalesce("english", F.lit(""))) == "", "translated already": F.coalesce(F.col("kind") == own_kind, F.lit(False)),
    }
    return df.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))).alias("finding"))


def phrasing_findings(answers: DataFrame, phrasings: DataFrame) -> DataFrame:
    """(id, finding, n) of answers without phrasings, or with n phrasings that are not embedded."""
    per = phrasings.groupBy(F.col("answer_id").alias("id")).agg(F.count(F.lit(1)).alias("all"), F.count_if(V.unembedded(F.col("embedding"))).alias("bare"))
    df = answers.select("id").join(per, "id", "left")
    finding = F.when(F.col("all").isNull(), "no-phrasings").when(F.col("bare") > 0, "unembedded")
    return df.select("id", finding.alias("finding"), F.coalesce("bare", F.lit(0)).alias("n")).where("finding is not null")


def unsearchable_terms(answers: DataFrame, skip: list[str]) -> DataFrame:
    """(id, absent) of answers (id, slug, phrasings): words of the slug whose stem is in no stem of the phrasings, nor holds one of four letters or more."""
    words = lambda c: F.filter(F.split(T.sub(F.lower(c), "['’]"), "[^a-z]+"), lambda w: w != "")
    terms = F.filter(F.split("slug", "-"), lambda w: (F.length(w) > 3) & ~w.isin(skip))
    df = answers.where(F.coalesce("phrasings", F.lit("")) != "").select("id", F.array_distinct(terms).alias("terms"), F.array_distinct(words(F.col("phrasings"))).alias("words"))
    # Each distinct word is stemmed once, not again for each word that it meets: the optimizer would copy a column's expression into the lambda.
    terms = F.transform("terms", lambda w: F.struct(w.alias("word"), T.stem(w).alias("stem")))

    def found(stems: Column, t: Column) -> Column:
        return F.exists(stems, lambda s: F.contains(s, t) | ((F.length(s) >= 4) & F.contains(t, s)))

    absent = T.let(F.array_distinct(F.transform("words", T.stem)), lambda stems: F.filter(terms, lambda w: (F.length(w["stem"]) >= 3) & ~found(stems, w["stem"])))
    return df.select("id", F.transform(absent, lambda w: w["word"]).alias("absent")).where(F.size("absent") > 0)


def forms(question: Column, phrasing: Column, body: Column) -> dict[str, Column]:
    """The six texts of an answer that a reranker can be given."""
    start = lambda n: F.substring(T.sub(body, "[#*\n]+", " "), 1, n)
    join = lambda *c: F.concat_ws(" ", *c)
    return {
        "phrasing only": phrasing, "primary + phrasing": join(question, phrasing), "phrasing + body120": join(phrasing, start(120)), "phrasing + body250": join(phrasing, start(250)),
        "phrasing + body500": join(phrasing, start(500)), "primary + phrasing + body250": join(question, phrasing, start(250)),
    }


def form_ladder(shortlists: DataFrame, expected: DataFrame, score: Callable[[Column, Column], Column], threshold: float) -> DataFrame:
    """(form, direct, offered, miss, wrong): how each form would serve every query.

    shortlists (query_id, query, answer_id, question, phrasing, body): the same candidates for each form; expected (query_id, answers): an
    empty array wants a miss. Alternatives are the next ``LADDER_SHOWN`` answers within ``LADDER_MARGIN`` of the first.
    """
    made = F.array(*[F.struct(F.lit(n).alias("form"), c.alias("doc")) for n, c in forms(F.col("question"), F.col("phrasing"), F.col("body")).items()])
    df = shortlists.select("query_id", "query", "answer_id", F.explode(made).alias("f"))
    best = df.groupBy("f.form", "query_id", "answer_id").agg(F.max(score(F.col("query"), F.col("f.doc"))).alias("score"))
    order = Window.partitionBy("form", "query_id").orderBy(F.desc("score"), "answer_id")
    best = best.withColumn("place", F.row_number().over(order)).withColumn("top", F.first("score").over(order)).where(F.col("place") <= LADDER_SHOWN + 1)
    near = (F.col("place") == 1) | (F.col("top") - F.col("score") < LADDER_MARGIN)
    shown = best.groupBy("form", "query_id").agg(F.max("top").alias("top"), F.sort_array(F.collect_list(F.when(near, F.struct("place", "answer_id")))).alias("shown"))
    names = F.array(*[F.lit(n) for n in forms(F.lit(""), F.lit(""), F.lit(""))])
    every = expected.select("query_id", "answers", F.explode(names).alias("form")).join(shown, ["form", "query_id"], "left")
    ids = F.transform("shown", lambda s: s["answer_id"])
    hit = F.array_contains("answers", F.get(ids, F.lit(0)))
    verdict = (
        F.when(F.col("top").isNull() | (F.col("top") < threshold), F.when(F.size("answers") == 0, "direct").otherwise("miss"))
        .when(hit, F.when(F.size("shown") > 1, "offered").otherwise("direct")).when(F.arrays_overlap("answers", ids), "offered").otherwise("wrong")
    )
    n = lambda v: F.count_if(F.col("v") == v).alias(v)
    return every.select("form", verdict.alias("v")).groupBy("form").agg(n("direct"), n("offered"), n("miss"), n("wrong"))


def search_results(chunks: DataFrame) -> DataFrame:
    """(chunk_id, block): the block that a model is given for a chunk (chunk_id, canonical_ref, content)."""
    block = F.struct(
        F.lit("search_result").alias("type"), F.concat(F.lit("chunk:"), F.col("chunk_id").cast("string")).alias("source"), F.col("canonical_ref").alias("title"),
        F.array(F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))).alias("content"), F.struct(F.lit(True).alias("enabled")).alias("citations"),
    )
    return chunks.select("chunk_id", F.to_json(block).alias("block"))


def licence_deed(attribution: Column) -> Column:
    """Address of the deed of a Creative Commons licence that an attribution names, with its version; null without one."""
    pattern = r"(?i)CC\s+(BY(?:-NC)?(?:-SA)?(?:-ND)?)\s+(\d\.\d)"
    code, version = F.regexp_extract(attribution, pattern, 1), F.regexp_extract(attribution, pattern, 2)
    return F.when(version != "", F.concat(F.lit("https://creativecommons.org/licenses/"), F.lower(code), F.lit("/"), version, F.lit("/")))
