"""Queries of the search: vector, lexical and fused retrieval, balancing, answer matching."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.operators import matching, positions, retrieval, vectors
from quern.plans.base import Registry
from quern.sources.shared import folder

QUERIES = Registry()
query = QUERIES.query

_E = "embedding::DOUBLE[]"
_KNN = f"WITH q AS (SELECT vec_id AS query_id, {_E} AS v FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query_id, vec_id AS id, label, list_cosine_distance({_E}, v) AS dist FROM embeddings, q), k AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY dist, id) AS k FROM d), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM k WHERE k <= 20) "


def _vectors(t):
    return t.embeddings.select(F.col("vec_id").alias("id"), F.col("label").alias("kind"), "embedding")


def _probes(t):
    return t.embeddings.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(_KNN + "SELECT query_id, id, rank::INT AS rank, round(dist, 6) AS dist FROM r WHERE rank <= 40")
def knn_per_kind(t):
    """H36, W1, W2, K1."""
    return retrieval.vector_arm(_vectors(t), _probes(t)).withColumn("dist", F.round("dist", 6))


@query(_KNN + "SELECT query_id, id, rank::INT AS rank, round(dist, 6) AS dist FROM r WHERE rank <= 40")
def knn_indexed(t):
    """The same answer from a stored index, exact by the bounds of codes and cells."""
    index = vectors.build(_vectors(t), folder(t.spark, "vectors"))
    return retrieval.vector_arm(None, _probes(t), index=index).withColumn("dist", F.round("dist", 6))


@query(f"WITH d AS (SELECT a.vec_id AS query_id, b.vec_id AS id, b.label, list_cosine_distance(a.{_E}, b.{_E}) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT query_id, id, label, round(dist, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY dist, id) = 1")
def knn_top1(t):
    """The nearest other vector of each twentieth one."""
    best = vectors.nearest(_vectors(t), _probes(t), 1, others=True).groupBy("query_id").agg(F.min(F.struct("dist", "id", "kind")).alias("b"))
    return best.select("query_id", "b.id", F.col("b.kind").alias("label"), F.round("b.dist", 6).alias("dist"))


@query(f"WITH d AS (SELECT a.vec_id AS query_id, a.label AS want, b.label AS got, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_distance(a.{_E}, b.{_E}), b.vec_id) AS r FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id) SELECT want AS label, count(*) AS n, count(*) FILTER (WHERE want = got) AS right_ FROM d WHERE r = 1 GROUP BY want")
def knn_label_accuracy(t):
    """J23 with labels as the truth."""
    best = vectors.nearest(_vectors(t), _probes(t), 1, others=True).groupBy("query_id").agg(F.min_by("kind", F.struct("dist", "id")).alias("got"))
    want = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    return best.join(want, "query_id").groupBy(F.col("want").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("want") == F.col("got")).alias("right_"))


@query(f"WITH d AS (SELECT a.vec_id AS query_id, b.label AS answer_id, b.vec_id, list_cosine_distance(a.{_E}, b.{_E}) AS dist FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND b.vec_id <> a.vec_id) SELECT query_id, answer_id, arg_min(vec_id, (dist, vec_id)) AS phrasing, round(min(dist), 6) AS dist FROM d GROUP BY ALL")
def best_phrasing_per_answer(t):
    """A6."""
    best = vectors.nearest(_vectors(t), _probes(t), 1, others=True)
    return best.select("query_id", F.col("kind").alias("answer_id"), F.col("id").alias("phrasing"), F.round("dist", 6).alias("dist"))


_W = r"list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w <> '')"
_LEX = "WITH q AS (SELECT item_id AS query_id, text FROM benchmark WHERE item_id % 20 = 0), qt AS (SELECT query_id, unnest(list_distinct(" + _W.format("text") + ")) AS token FROM q), ix AS (SELECT token, id, count(*) AS n FROM (SELECT doc_id AS id, unnest(" + _W.format("text") + ") AS token FROM documents) GROUP BY ALL), lex AS (SELECT query_id, id, sum(n)::DOUBLE * 0.1::DOUBLE AS score FROM ix JOIN qt USING (token) GROUP BY ALL), lr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM lex)"


def _questions(t):
    return t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def _documents(t):
    return t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), "text")


@query(_LEX + " SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM lr WHERE rank <= 40")
def lexical_or_rank(t):
    """OR match, ranked by cover density; an empty question matches nothing."""
    return retrieval.lexical_arm(_documents(t), _questions(t)).withColumn("score", F.round("score", 6))


@query(_LEX + " SELECT query_id, id, rank::INT AS rank, round(score, 6) AS score FROM lr WHERE rank <= 40")
def lexical_indexed(t):
    """The same from the stored index, of which only the questions' folders are read."""
    index = positions.build(_documents(t), folder(t.spark, "postings"))
    return retrieval.lexical_arm(index, _questions(t)).withColumn("score", F.round("score", 6))


_COVER = (
    f"WITH d AS (SELECT doc_id AS id, {_W.format('text')} AS w FROM documents), ix AS (SELECT id, unnest(w) AS token, generate_subscripts(w, 1) AS p FROM d), b AS (SELECT item_id AS query_id, {_W.format('text')} AS w FROM benchmark WHERE item_id % 20 = 0), "
    "q AS (SELECT query_id, w[2] AS a, w[3] AS b, w[1] AS c, w[6] AS d FROM b WHERE len(w) >= 6), n AS (SELECT DISTINCT query_id, id, p FROM q, ix WHERE token IN (a, b, c, d)), "
    "o AS (SELECT q.query_id, x.id, x.p AS s, y.p AS e, 0 AS k FROM q JOIN ix x ON x.token = q.a JOIN ix y ON y.id = x.id AND y.p = x.p + 1 AND y.token = q.b UNION ALL SELECT q.query_id, id, p, p, 1 FROM q JOIN ix ON token = c OR token = d), "
    "r AS (SELECT query_id, id, e, max(least(s0, s1)) AS begin_ FROM (SELECT query_id, id, e, max(CASE WHEN k = 0 THEN s END) OVER u AS s0, max(CASE WHEN k = 1 THEN s END) OVER u AS s1 FROM o WINDOW u AS (PARTITION BY query_id, id ORDER BY e RANGE UNBOUNDED PRECEDING)) WHERE s0 IS NOT NULL AND s1 IS NOT NULL GROUP BY ALL), "
    "c AS (SELECT * FROM r QUALIFY lag(begin_) OVER (PARTITION BY query_id, id ORDER BY e) IS NULL OR begin_ > lag(begin_) OVER (PARTITION BY query_id, id ORDER BY e)), "
    "m AS (SELECT c.query_id, c.id, c.begin_, c.e, count(*) AS n FROM c JOIN n ON n.query_id = c.query_id AND n.id = c.id AND n.p BETWEEN c.begin_ AND c.e GROUP BY ALL) "
    "SELECT query_id, id, round(sum(0.1::DOUBLE / (1 + e - begin_ + 1 - n)), 6) AS score FROM m GROUP BY ALL"
)


@query(_COVER)
def cover_density(t):
    """A phrase of the question's second and third words and its first or sixth word, by minimal covers of the stored index."""
    words = positions.default_tokens(F.col("text"))
    q = _questions(t).select("query_id", words.alias("w")).where("size(w) >= 6")
    some = lambda *at: q.select("query_id", F.concat_ws(" ", *[F.col("w")[i] for i in at]).alias("text"))
    index = positions.build(_documents(t), folder(t.spark, "postings"))
    terms = positions.both(positions.phrase(some(1, 2)), positions.any_of(some(0, 5)))
    return positions.ranked(index, terms).withColumn("score", F.round("score", 6))


_ARMS = _LEX + f", qv AS (SELECT vec_id AS query_id, {_E} AS v FROM embeddings WHERE vec_id IN (SELECT query_id FROM q)), vd AS (SELECT query_id, vec_id AS id, lang AS kind, list_cosine_distance({_E}, v) AS dist FROM embeddings JOIN documents ON doc_id = vec_id, qv), vk AS (SELECT *, row_number() OVER (PARTITION BY query_id, kind ORDER BY dist, id) AS k FROM vd), vr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM vk WHERE k <= 20), fused AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT query_id, id, rank FROM vr WHERE rank <= 40 UNION ALL SELECT query_id, id, rank FROM lr WHERE rank <= 40) GROUP BY ALL)"


def _corpus(t):
    """Documents with the vector of the same number; those without one are found by words alone."""
    return _documents(t).join(t.embeddings.select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


def _asked(t):
    return _questions(t).join(_probes(t), "query_id")


def _fused(t):
    rows, asked = _corpus(t), _asked(t)
    v = retrieval.vector_arm(rows.where("embedding is not null"), asked)
    return v, retrieval.fuse(v, retrieval.lexical_arm(rows, asked))


@query(_ARMS + " SELECT query_id, id, score FROM fused")
def rrf_fusion(t):
    """A10, U-2."""
    return _fused(t)[1]


@query(_ARMS + ", o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM fused), n AS (SELECT query_id, id, 0 AS tier, rank AS p FROM vr WHERE rank <= 8 UNION ALL SELECT query_id, id, 1, pos FROM o), m AS (SELECT query_id, id, min(tier * 1000 + p) AS first_at FROM n GROUP BY ALL) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY first_at, id)::INT AS pos FROM m QUALIFY pos <= 20")
def candidate_net(t):
    """K5, A27."""
    return matching.candidate_net(*_fused(t))


_FL = "fl(kind, turn, floor_, scaled) AS (VALUES ('en', 0, 4, 2), ('de', 1, 4, 2), ('es', 2, 2, 1), ('fr', 3, 3, 1))"


def _sql_balance(source: str, budget: int, floor: str, keep: str) -> str:
    return f"(SELECT {keep}, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, pos) AS pick FROM (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY query_id, s.kind ORDER BY pos) <= {floor} THEN turn ELSE 5 END AS tier FROM {source} s JOIN fl ON fl.kind = s.kind)) WHERE pick <= {budget})"


@query(_ARMS + f", {_FL}, o AS (SELECT f.*, lang AS kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM fused f JOIN documents ON doc_id = id) SELECT query_id, place::INT AS place, id, kind FROM " + _sql_balance("o", 6, "scaled", "query_id, id, kind, pos"))
def balanced_topk(t):
    """Six places, so floors shrink."""
    fused = _fused(t)[1].join(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind")), "id")
    ordered = fused.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return retrieval.balance(ordered, 6).select("query_id", "place", "id", "kind")


@query("WITH b AS (SELECT conv_id, count(*) AS b FROM conversations GROUP BY conv_id) SELECT conv_id, b::INT AS budget, kind, CASE WHEN b >= 13 THEN floor_ ELSE greatest(1, floor(floor_ * b / 13.0 + 0.5)) END::INT AS floor FROM b, (VALUES ('en', 4), ('de', 4), ('es', 2), ('fr', 3)) fl(kind, floor_)")
def scaled_floors(t):
    """Each conversation's turns as a budget."""
    budgets = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).cast("int").alias("budget"))
    floors = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(n).alias("n")) for k, n in retrieval.FLOORS]))
    return budgets.select("conv_id", "budget", floors.alias("f")).select("conv_id", "budget", "f.kind", retrieval.floor_of(F.col("budget"), F.col("f.n")).alias("floor"))


_TOK = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 2))"
_HYBRID = _ARMS + f", {_FL}, o AS (SELECT f.*, lang AS kind, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS pos FROM fused f JOIN documents ON doc_id = id), wide AS {_sql_balance('o', 36, 'floor_', 'query_id, id, kind, score, pos')}, x AS (SELECT w.query_id, w.id, w.kind, w.score, w.pos, " + _TOK.format("q.text") + " AS a, " + _TOK.format("d.text") + " AS b FROM wide w JOIN q ON q.query_id = w.query_id JOIN documents d ON d.doc_id = w.id), rr AS (SELECT query_id, id, kind, score, pos AS was, round(len(list_intersect(a, b)) / greatest(len(a) + len(b) - len(list_intersect(a, b)), 1), 6) AS rerank FROM x), p AS (SELECT query_id, id, kind, score, rerank, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, was) AS pos FROM rr)"


@query(_HYBRID + " SELECT query_id, place::INT AS place, id, kind, score, rerank FROM " + _sql_balance("p", 12, "CASE WHEN 12 >= 13 THEN floor_ ELSE greatest(1, floor(floor_ * 12 / 13.0 + 0.5)) END", "query_id, id, kind, score, rerank, pos"))
def hybrid_search(t):
    """The whole retrieval of section 3.1: arms, fusion, balance, rerank, balance."""
    return retrieval.search(_corpus(t), _asked(t))


_MATCH = f"WITH q AS (SELECT vec_id AS query_id, {_E} AS v, label FROM embeddings WHERE vec_id % 20 = 0), d AS (SELECT query_id, b.label::BIGINT AS answer_id, list_cosine_distance(b.{_E}, v) AS dist FROM embeddings b, q WHERE b.vec_id <> query_id), r AS (SELECT query_id, answer_id, round(1 - min(dist), 6) AS score FROM d GROUP BY ALL), n AS (SELECT query_id, round(min(dist), 6) AS nearest FROM d GROUP BY ALL), o AS (SELECT r.*, nearest, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, answer_id) AS pos, max(score) OVER (PARTITION BY query_id) AS top FROM r JOIN n USING (query_id)), a AS (SELECT query_id, list(answer_id ORDER BY pos) AS alternatives FROM (SELECT * FROM o WHERE pos > 1 AND top - score < CASE WHEN top < 0.5 THEN 0.35 ELSE 0.05 END QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos) <= 3) GROUP BY query_id), f AS (SELECT o.*, alternatives, (nearest > 0.32 AND score < 0.9) OR score < 0.1 AS miss FROM o LEFT JOIN a USING (query_id) WHERE pos = 1)"


def _ranked(t):
    best = vectors.nearest(_vectors(t), _probes(t), 1, others=True).select("query_id", F.col("kind").cast("long").alias("answer_id"), "dist")
    best = best.withColumn("score", F.round(1 - F.col("dist"), 6))
    return best.withColumn("nearest", F.round(F.min("dist").over(Window.partitionBy("query_id")), 6)).drop("dist")


@query(_MATCH + " SELECT query_id, CASE WHEN NOT miss THEN answer_id END AS answer_id, score, CASE WHEN miss THEN 'miss' ELSE 'hit' END AS outcome, NOT miss AND score >= 0.5 AS confident, CASE WHEN miss THEN [] ELSE coalesce(alternatives, []) END AS alternatives FROM f")
def match_ladder(t):
    """A11, W14 and the decisions of section 3.2."""
    return matching.decide(_ranked(t))


@query(_MATCH + ", v AS (SELECT f.query_id, q.label::BIGINT AS want, CASE WHEN miss THEN NULL ELSE answer_id END AS served, CASE WHEN miss THEN [] ELSE coalesce(alternatives, []) END AS alts FROM f JOIN q USING (query_id)) SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN served IS NULL THEN 'miss' WHEN served = want AND len(alts) = 0 THEN 'direct' WHEN served = want THEN 'offered' WHEN list_contains(alts, want) THEN 'offered' WHEN len(alts) > 0 THEN 'BURIED' ELSE 'WRONG' END AS verdict FROM v) GROUP BY verdict")
def eval_outcomes(t):
    """Vector labels stand for the expected answers."""
    want = t.embeddings.select(F.col("vec_id").alias("query_id"), F.col("label").cast("long").alias("want"))
    d = matching.decide(_ranked(t)).join(want, "query_id")
    offered = F.array_contains("alternatives", F.col("want"))
    some = F.size("alternatives") > 0
    v = F.when(F.col("answer_id").isNull(), "miss").when((F.col("answer_id") == F.col("want")) & ~some, "direct").when((F.col("answer_id") == F.col("want")) | offered, "offered").when(some, "BURIED").otherwise("WRONG")
    return d.groupBy(v.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query(_HYBRID + " SELECT query_id, place::INT AS place, id, kind, score, rerank FROM " + _sql_balance("p", 12, "CASE WHEN 12 >= 13 THEN floor_ ELSE greatest(1, floor(floor_ * 12 / 13.0 + 0.5)) END", "query_id, id, kind, score, rerank, pos"))
def hybrid_indexed(t):
    """Section 3.1 from the stored indexes of words and vectors."""
    rows = _corpus(t)
    index, cells = positions.build(_documents(t), folder(t.spark, "postings")), vectors.build(rows.where("embedding is not null"), folder(t.spark, "vectors"))
    return retrieval.search(rows, _asked(t), index=index, cells=cells)
