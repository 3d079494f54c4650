"""Queries over text functions: normalisation, words, similarity, markup, references, rendering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.functions import vector as V
from quern.operators import answers, glossary, prose, retrieval, similar
from quern.plans.base import Registry

QUERIES = Registry()
query = QUERIES.query

#: Strings with what the tables lack: Arabic letters, marks, digits, zero-width characters.
SAMPLES = [
    (1, "وَإِذَا ضَرَبْتُمْ  فِي"),
    (2, "أحمد آدم إبراهيم ٱلله"),
    (3, "صلاة موسى مؤمن شيئ"),
    (4, "﴿١٢٣﴾ ۴۵۶ ۝"),
    (5, "a​b⁠c ﻿ x y"),
    (6, "كــتاب"),
    (7, "plain text, Latin only"),
    (8, ""),
    (9, None),
]


def samples(t):
    return t.spark.createDataFrame(SAMPLES, "id long, raw string").coalesce(1)


def _sql_samples() -> str:
    rows = ", ".join(f"({i}, {'NULL' if s is None else chr(39) + s + chr(39)})" for i, s in SAMPLES)
    return f"samples(id, raw) AS (VALUES {rows})"


def _sql_normal(c: str) -> str:
    x = f"nfc_normalize(coalesce({c}, ''))"
    x = f"regexp_replace(regexp_replace(regexp_replace({x}, '{T.ZERO_WIDTH}', '', 'g'), '{T.QURANIC_MARKS}', ' ', 'g'), '{T.DIACRITICS}', '', 'g')"
    x = f"translate(translate({x}, '{T.FOLD_FROM}', '{T.FOLD_TO}'), '{T.DIGITS_FROM}', '{T.DIGITS_TO}')"
    return f"trim(regexp_replace({x}, '{T.SPACE}+', ' ', 'g'))"


@query(f"WITH {_sql_samples()} SELECT id, {_sql_normal('raw')} AS normal, regexp_matches(coalesce(raw, ''), '{T.ARABIC_SCRIPT}') AS arabic FROM samples UNION ALL SELECT doc_id + 100, md5({_sql_normal('text')}), regexp_matches(text, '{T.ARABIC_SCRIPT}') FROM documents")
def normalize_text(t):
    """H1, H2, T2."""
    own = samples(t).select("id", T.normalize_arabic(F.col("raw")).alias("normal"), T.has_arabic(F.col("raw")).alias("arabic"))
    return own.unionByName(t.documents.select((F.col("doc_id") + 100).alias("id"), F.md5(T.normalize_arabic(F.col("text"))).alias("normal"), T.has_arabic(F.col("text")).alias("arabic")))


_ASKED = "text || CASE turn % 3 WHEN 0 THEN ' ' || chr(1608) || chr(1614) || chr(1573) || chr(1616) || chr(1584) || chr(1614) || chr(1575) || chr(8203) || '  ' || chr(1641) WHEN 1 THEN chr(8288) || ' x' || chr(160) || 'y' ELSE '' END"


@query(f"WITH z AS (SELECT conv_id, turn, regexp_replace(nfc_normalize(coalesce({_ASKED}, '')), '{T.ZERO_WIDTH}', '', 'g') AS z FROM conversations) SELECT conv_id, turn, CASE WHEN regexp_matches(z, '{T.ARABIC_SCRIPT}') THEN {_sql_normal('z')} ELSE trim(regexp_replace(z, '{T.SPACE}+', ' ', 'g')) END AS q FROM z")
def normalize_query(t):
    """H3: every turn, a third with marked Arabic, a third with spaces and marks of no width."""
    more = F.when(F.col("turn") % 3 == 0, " \u0648\u064e\u0625\u0650\u0630\u064e\u0627\u200b  \u0669").when(F.col("turn") % 3 == 1, "\u2060 x\u00a0y").otherwise("")
    return t.conversations.select("conv_id", "turn", T.normalize_query(F.concat("text", more)).alias("q"))


_QW = r"trim(regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '" + T.SPACE.replace("{", "{{").replace("}", "}}") + "+', ' ', 'g'))"


@query(r"SELECT conv_id, turn, len(list_filter(string_split(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> ''))::INT AS n_words, array_to_string(list_filter(string_split(regexp_replace(text, '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> ''), ' ') AS rejoined, " + _QW.format("text") + " AS quote FROM conversations")
def word_forms(t):
    """H4, H5, H7."""
    w = T.words(F.col("text"))
    return t.conversations.select("conv_id", "turn", F.size(w).alias("n_words"), F.array_join(w, " ").alias("rejoined"), T.quote_words(F.col("text")).alias("quote"))


_TRI = r"list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring('  ' || w || ' ', i, 3)))))"


@query("WITH q AS (SELECT item_id, text AS q FROM benchmark WHERE item_id % 20 = 0), p AS (SELECT q.item_id, b.item_id AS other, " + _TRI.format("q.q") + " AS x, " + _TRI.format("b.text") + " AS y FROM q, benchmark b WHERE q.item_id <> b.item_id) SELECT item_id, other, round(len(list_intersect(x, y)) / greatest(len(x) + len(y) - len(list_intersect(x, y)), 1), 6) AS similarity FROM p WHERE len(list_intersect(x, y)) / greatest(len(x) + len(y) - len(list_intersect(x, y)), 1) >= 0.3")
def trigram_similarity(t):
    """A stated set of queries (a twentieth of the items) against all items."""
    sets = t.benchmark.select(F.col("item_id").alias("id"), T.trigrams(F.col("text")).alias("members"))
    pairs = similar.similar(sets.where("id % 20 = 0"), sets, 0.3).where("left_id <> right_id")
    return pairs.select(F.col("left_id").alias("item_id"), F.col("right_id").alias("other"), F.round("similarity", 6).alias("similarity"))


@query(f"SELECT doc_id, (CAST(trunc(0.35::DOUBLE * (length(text) - length(regexp_replace(text, '{T.ARABIC_BLOCK}', '', 'g'))) + 0.25::DOUBLE * length(regexp_replace(text, '{T.ARABIC_BLOCK}', '', 'g'))) AS INT) + 1) AS tokens FROM documents")
def token_estimate(t):
    """H11."""
    return t.documents.select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"SELECT doc_id, len(string_split(regexp_replace(text, '([.!:])\s+', '\1' || chr(1), 'g'), chr(1)))::INT AS n_sentences, string_split(regexp_replace(text, '([.!:])\s+', '\1' || chr(1), 'g'), chr(1))[1] AS first_sentence FROM documents")
def sentence_split(t):
    """H14."""
    s = T.sentences(F.col("text"))
    return t.documents.select("doc_id", F.size(s).alias("n_sentences"), F.get(s, F.lit(0)).alias("first_sentence"))


@query("SELECT p_partkey, coalesce(nullif(CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_brand || ' 1:' || p_size ELSE p_type END, ''), p_name) AS ref, (CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_brand || ' 1:' || p_size ELSE p_type END) NOT IN ('') AND instr(CASE WHEN p_size % 3 = 0 THEN '' WHEN p_size % 3 = 1 THEN p_brand || ' 1:' || p_size ELSE p_type END, ':') = 0 AS chapter_level, CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END AS passage FROM part")
def passage_ref_projection(t):
    """F1, F2, H43."""
    ref = F.when(F.col("p_size") % 3 == 0, "").when(F.col("p_size") % 3 == 1, F.concat("p_brand", F.lit(" 1:"), "p_size")).otherwise(F.col("p_type"))
    content = F.concat(F.lit("head"), F.lit("\n\nArabic:\n"), "p_brand")
    df = t.part.withColumn("own", ref)
    doc = F.when(F.col("p_size") % 2 == 0, F.col("p_name"))
    return df.select("p_partkey", T.effective_ref(F.col("own"), F.col("p_name")).alias("ref"), T.chapter_level(F.col("own")).alias("chapter_level"), T.passage(doc, content).alias("passage"))


def _trim(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{T.SPACE}+', ''), '{T.SPACE}+$', '')"


_HEADS = "SELECT doc_id, 'verse' AS form, source || ' ' || doc_id AS ref, ' — Surah ' || source || ', verse ' || doc_id || ' of chapter ' || (doc_id % 114 + 1) AS head, text AS english, '' AS arabic, 'Translation (T):' AS label FROM documents UNION ALL SELECT doc_id, 'collection', source || ' ' || doc_id, ' — ' || source || CASE doc_id % 4 WHEN 0 THEN ' (' || lang || '; narrated by n' || doc_id || ')' WHEN 1 THEN ' (grading: good)' WHEN 2 THEN ' (' || lang || '; grading: good)' ELSE '' END, '', text, '' FROM documents"


@query(f"WITH h AS ({_HEADS}), c AS (SELECT doc_id, form, ref || head || CASE WHEN english <> '' THEN chr(10) || chr(10) || label || chr(10) || {_trim('english')} ELSE '' END || CASE WHEN arabic <> '' THEN chr(10) || chr(10) || 'Arabic:' || chr(10) || {_trim('arabic')} ELSE '' END AS content, ref || head || CASE WHEN english <> '' THEN chr(10) || chr(10) || {_trim('english')} ELSE '' END || CASE WHEN arabic <> '' THEN chr(10) || chr(10) || {_sql_normal('arabic')} ELSE '' END AS embed_text FROM h) SELECT doc_id, form, md5(content) AS content, md5(embed_text) AS embed_text, (trunc(0.35::DOUBLE * (length(content) - length(regexp_replace(content, '{T.ARABIC_BLOCK}', '', 'g'))) + 0.25::DOUBLE * length(regexp_replace(content, '{T.ARABIC_BLOCK}', '', 'g')))::INT + 1) AS token_count FROM c")
def chunk_assembly(t):
    """Each document as a verse and as an entry of a collection; a header has only what the source says."""
    d = t.documents.withColumn("ref", F.concat("source", F.lit(" "), "doc_id"))
    verses = d.select("ref", (F.col("doc_id") % 114 + 1).alias("surah"), F.col("source").alias("name"), F.col("doc_id").alias("ayah"), F.lit("").alias("arabic"), F.col("text").alias("english"))
    k = F.col("doc_id") % 4
    rows = d.select("ref", F.col("source").alias("collection"), F.when(k.isin(0, 2), F.col("lang")).alias("book"), F.when(k == 0, F.concat(F.lit("n"), "doc_id")).otherwise("").alias("narrator"), F.when(k.isin(1, 2), "good").alias("grading"), F.col("text").alias("arabic"), F.lit("").alias("english"))
    both = prose.verse_chunks(verses, "T").withColumn("form", F.lit("verse")).unionByName(prose.collection_chunks(rows).withColumn("form", F.lit("collection")))
    return both.select(F.substring_index("ref", " ", -1).cast("long").alias("doc_id"), "form", F.md5("content").alias("content"), F.md5("embed_text").alias("embed_text"), "token_count")


@query(r"SELECT c_custkey, nullif(regexp_extract(c_name || ' ' || c_nationkey || ':' || c_custkey, ' (\d+):[^ ]*$', 1), '')::INT AS volume, CASE WHEN c_nationkey = 0 THEN c_name || ', vol. 0' WHEN c_nationkey < 5 THEN c_name ELSE c_name || ', vol. ' || c_nationkey END AS label FROM customer")
def volume_reference(t):
    """Volume 0 is a volume, none is none."""
    ref = F.concat("c_name", F.lit(" "), "c_nationkey", F.lit(":"), "c_custkey")
    volume = F.when((F.col("c_nationkey") == 0) | (F.col("c_nationkey") >= 5), F.col("c_nationkey"))
    return t.customer.select("c_custkey", F.nullif(F.regexp_extract(ref, r" (\d+):[^ ]*$", 1), F.lit("")).cast("int").alias("volume"), F.when(volume.isNull(), F.col("c_name")).otherwise(F.concat("c_name", F.lit(", vol. "), volume)).alias("label"))


_TOK = "list_distinct(list_filter(string_split_regex(lower({0}), '[^a-z0-9]+'), lambda w: length(w) > 2))"


@query("WITH q AS (SELECT item_id, " + _TOK.format("text") + " AS x FROM benchmark WHERE item_id % 20 = 0) SELECT item_id, doc_id, round(len(list_intersect(x, y)) / greatest(len(x) + len(y) - len(list_intersect(x, y)), 1), 6) AS score FROM q, (SELECT doc_id, " + _TOK.format("text") + " AS y FROM documents) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY len(list_intersect(x, y)) / greatest(len(x) + len(y) - len(list_intersect(x, y)), 1) DESC, doc_id) <= 10")
def rerank_jaccard(t):
    """The ten best documents for each twentieth item."""
    q = t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    best = retrieval.best_by_tokens(t.documents.select(F.col("doc_id").alias("id"), "text"), q, 10)
    return best.select(F.col("query_id").alias("item_id"), F.col("id").alias("doc_id"), F.round("score", 6).alias("score"))


_FNV = "list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(w, ''), lambda c: ascii(c)::UBIGINT)), lambda h, c: (xor(h, c) * 16777619::UBIGINT) & 4294967295::UBIGINT)"


@query(f"WITH d AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS ws FROM benchmark), h AS (SELECT item_id, list_transform(ws, lambda w: {_FNV}) AS hs FROM d), s AS (SELECT item_id, list_transform(hs, lambda h: (abs(CASE WHEN h >= 2147483648 THEN h::BIGINT - 4294967296 ELSE h::BIGINT END) % 64)) AS b FROM h) SELECT item_id, (i - 1)::INT AS dim, round(len(list_filter(b, lambda x: x = i - 1)) / sqrt(list_sum(list_transform(range(0, 64), lambda j: len(list_filter(b, lambda x: x = j)) * len(list_filter(b, lambda x: x = j))))), 6) AS value FROM s, range(1, 65) r(i) WHERE len(list_filter(b, lambda x: x = i - 1)) > 0")
def stub_embedding(t):
    """The bag-of-words embedding of the test backend."""
    tokens = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    counts = t.benchmark.select("item_id", F.explode(tokens).alias("w")).groupBy("item_id", V.fnv_dimension(F.col("w")).alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    length = F.sqrt(F.sum(F.col("n") * F.col("n")).over(Window.partitionBy("item_id")))
    return counts.select("item_id", "dim", F.round(F.col("n") / length, 6).alias("value"))


@query(r"SELECT doc_id, regexp_replace(text, '[#*\n]+', ' ', 'g') AS cleaned, list_sort(list_distinct(regexp_extract_all(text, '[^\x09\x0A\x0D\x20-\x7E\x{A0}-\x{24F}\x{2000}-\x{206F}]'))) AS strays, list_sort(list_distinct(regexp_extract_all(text, '[\x{0370}-\x{03FF}\x{0400}-\x{04FF}]+'))) AS wrong_script FROM documents")
def stray_chars(t):
    """H22, H23."""
    c = F.col("text")
    find = lambda p: F.sort_array(F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0))))
    return t.documents.select("doc_id", T.sub(c, r"[#*\n]+", " ").alias("cleaned"), find(r"[^\x09\x0A\x0D\x20-\x7E\x{A0}-\x{24F}\x{2000}-\x{206F}]").alias("strays"), find(r"[\x{0370}-\x{03FF}\x{0400}-\x{04FF}]+").alias("wrong_script"))


_STEM = r"regexp_replace(regexp_replace(regexp_replace({0}, '(ies)$', 'y'), '(ing|ed|es|s)$', ''), 'e$', '')"


@query("WITH w AS (SELECT p_partkey, unnest(string_split(lower(p_name), ' ')) AS w FROM part) SELECT DISTINCT w, " + _STEM.format("w") + " AS stem FROM w WHERE NOT regexp_matches(" + r"regexp_replace(regexp_replace(w, '(ies)$', 'y'), '(ing|ed|es|s)$', '')" + ", '(aa|bb|cc|dd|ee|ff|gg|hh|ii|jj|kk|ll|mm|nn|oo|pp|qq|rr|ss|tt|uu|vv|ww|xx|yy|zz)$')")
def audit_stems(t):
    """H21 on distinct words without a doubled last letter (which the checking engine's patterns cannot name)."""
    w = t.part.select(F.explode(F.split(F.lower("p_name"), " ")).alias("w")).distinct()
    bare = T.sub(T.sub(F.col("w"), "(ies)$", "y"), "(ing|ed|es|s)$")
    return w.where(~bare.rlike("(.)\\1$")).select("w", T.stem(F.col("w")).alias("stem"))


_WORDS = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> '')"
_GLOSS = rf"""WITH RECURSIVE b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), r AS (SELECT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS term, unnest(range(1, len(w) - k + 2)) AS spot FROM b, (VALUES (2), (3)) s(k) WHERE len(w) >= k),
g AS (SELECT term, string_agg('item ' || item_id, ', ' ORDER BY item_id, spot, k) AS expansion FROM r GROUP BY term), gt AS (SELECT regexp_extract_all(term, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]') AS ts, term, expansion FROM g),
d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}]') AS x FROM documents), p AS (SELECT doc_id, x, unnest(x) AS tok, generate_subscripts(x, 1) AS i FROM d),
m AS (SELECT doc_id, i, max(len(ts)) AS n, arg_max(expansion, len(ts)) AS expansion FROM p JOIN gt ON tok = ts[1] AND x[i + 2] = ts[3] AND x[i:i + len(ts) - 1] = ts GROUP BY doc_id, i),
s AS (SELECT doc_id, i, first_value(m.i IGNORE NULLS) OVER w AS spot, first_value(m.n IGNORE NULLS) OVER w AS n, first_value(m.expansion IGNORE NULLS) OVER w AS expansion FROM (SELECT doc_id, i FROM p) q LEFT JOIN m USING (doc_id, i) WINDOW w AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
f(doc_id, i, spot, expansion) AS (SELECT doc_id, spot + n, spot, expansion FROM s WHERE i = 1 AND spot IS NOT NULL UNION ALL SELECT s.doc_id, s.spot + s.n, s.spot, s.expansion FROM f JOIN s ON s.doc_id = f.doc_id AND s.i = f.i WHERE s.spot IS NOT NULL),
e AS (SELECT doc_id, expansion, min(spot) AS spot FROM f GROUP BY ALL), o AS (SELECT doc_id, count(*)::INT AS n, string_agg(expansion, '; ' ORDER BY spot) AS expansions FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::INT AS n_glosses, md5(coalesce(expansions, '')) AS expansions FROM documents LEFT JOIN o USING (doc_id)"""


def _glossary(t):
    """Every run of two and three words of the items, with the items it is from."""
    w = t.benchmark.select("item_id", T.words(F.lower("text")).alias("w"))

    def of(k: int):
        terms = F.transform(F.sequence(F.lit(1), F.size("w") - k + 1), lambda i: F.array_join(F.slice("w", i, k), " "))
        return w.where(F.size("w") >= k).select("item_id", F.lit(k).alias("k"), F.posexplode(terms).alias("at", "term"))

    runs = [of(2), of(3)]
    return runs[0].unionByName(runs[1]).select("term", F.concat(F.lit("item "), "item_id").alias("expansion"), F.struct("item_id", "at", "k").alias("place"))


@query(_GLOSS)
def gloss_query(t):
    """Thousands of terms found in every text, leftmost and longest, each expansion once."""
    e = glossary.finder(_glossary(t))(F.col("text"))
    df = t.documents.select("doc_id", e.alias("e"))
    return df.select("doc_id", F.size("e").alias("n_glosses"), F.md5(F.array_join("e", "; ")).alias("expansions"))


@query(r"SELECT o_orderkey, list_sort(list_distinct(list_transform(regexp_extract_all('see [' || o_orderkey % 7 || '] and [' || o_custkey % 5 || '] or [' || o_orderkey % 7 || ']', '\[(\d+)\]', 1), lambda x: x::INT))) AS markers FROM orders")
def marker_extraction(t):
    """H29."""
    body = F.format_string("see [%s] and [%s] or [%s]", F.col("o_orderkey") % 7, F.col("o_custkey") % 5, F.col("o_orderkey") % 7)
    return t.orders.select("o_orderkey", F.sort_array(T.markers(body)).alias("markers"))


@query(r"SELECT doc_id, list_filter(string_split(text, chr(10)), lambda p: contains(p, 'of')) AS paragraphs FROM documents")
def citation_paragraphs(t):
    """H28, with lines as paragraphs."""
    return t.documents.select("doc_id", answers.paragraphs_with(F.col("text"), "of", r"\n").alias("paragraphs"))


@query(r"SELECT doc_id, (s > 0)::BOOLEAN AS found, CASE WHEN s > 0 THEN left(text, (s - 1)::INT) ELSE text END AS before, CASE WHEN s > 0 THEN substring(text, s, length(q)) END AS hit FROM (SELECT doc_id, text, q, instr(text, q) AS s FROM (SELECT doc_id, text, substring(text, 11, 12) AS q FROM documents))")
def quote_highlight(t):
    """The first place of a quote splits a text."""
    q = F.substring("text", 11, 12)
    df = t.documents.select("doc_id", "text", q.alias("q")).withColumn("s", F.expr("instr(text, q)"))
    hit = F.col("s") > 0
    return df.select("doc_id", hit.alias("found"), F.when(hit, F.expr("left(text, s - 1)")).otherwise(F.col("text")).alias("before"), F.when(hit, F.expr("substr(text, s, length(q))")).alias("hit"))


@query("WITH x AS (SELECT DISTINCT l_orderkey AS k, l_linenumber * 3 AS lo, l_linenumber * 3 + floor(l_quantity)::INT % 6 AS hi FROM lineitem), m AS (SELECT *, max(hi) OVER (PARTITION BY k ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM x), g AS (SELECT *, sum(CASE WHEN before IS NULL OR lo > before THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY lo, hi ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT k, min(lo)::INT AS first_place, max(hi)::INT AS end_place FROM g GROUP BY k, island")
def interval_merge(t):
    """Touching and overlapping intervals are one."""
    x = t.lineitem.select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 3).alias("lo"), (F.col("l_linenumber") * 3 + F.floor("l_quantity").cast("int") % 6).alias("hi"))
    return answers.merge_intervals(x, ["k"], "lo", "hi").select("k", F.col("lo").alias("first_place"), F.col("hi").alias("end_place"))


@query("SELECT event_id, CASE WHEN event_id % 17 = 0 THEN 'Pinned' WHEN d < 86400 THEN 'Today' WHEN d <= 7 * 86400 THEN 'Previous 7 days' WHEN d <= 30 * 86400 THEN 'Previous 30 days' ELSE 'Older' END AS bucket FROM (SELECT event_id, epoch((SELECT max(ts) FROM events)) - epoch(ts) AS d FROM events)")
def age_buckets(t):
    """H35, with the latest event as now."""
    now = t.events.agg(F.max("ts").alias("now"))
    d = (F.col("now").cast("timestamp").cast("double") - F.col("ts").cast("timestamp").cast("double"))
    df = t.events.crossJoin(F.broadcast(now))  # one row
    return df.select("event_id", answers.age_bucket(d, F.col("event_id") % 17 == 0).alias("bucket"))


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS first_unit, round(1 / (1 + exp(-embedding[1]::DOUBLE)), 6) AS squashed FROM embeddings")
def vector_scaling(t):
    """H38."""
    e = V.doubles(F.col("embedding"))
    return t.embeddings.select("vec_id", F.round(V.norm(e), 6).alias("norm"), F.round(F.element_at(V.normalized(e), 1), 6).alias("first_unit"), F.round(V.sigmoid(F.element_at(e, 1)), 6).alias("squashed"))


@query("SELECT conv_id, turn, sha256(text) AS key, '{\"matched\":' || CASE WHEN turn % 2 = 0 THEN 'true' ELSE 'false' END || ',\"ids\":[' || turn || ',' || turn + 1 || ']}' AS metadata, turn + 1 AS second_id FROM conversations")
def json_metadata(t):
    """Written and read back."""
    made = F.to_json(F.struct((F.col("turn") % 2 == 0).alias("matched"), F.array("turn", F.col("turn") + 1).alias("ids")))
    back = F.from_json("metadata", "matched boolean, ids array<bigint>")
    return t.conversations.select("conv_id", "turn", F.sha2("text", 256).alias("key"), made.alias("metadata")).withColumn("second_id", F.element_at(back["ids"], 2))


_LW = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> '')"
_AUDIT = rf"""WITH b AS (SELECT item_id, {_LW} AS w FROM benchmark), g AS (SELECT w[2] AS term, string_agg(w[5] || ' ' || w[6], ', ' ORDER BY item_id) AS expansion FROM b WHERE len(w) >= 6 GROUP BY term),
qq AS (SELECT item_id, text FROM benchmark WHERE item_id % 20 = 0), qt AS (SELECT item_id, unnest(ks) AS tok, generate_subscripts(ks, 1) AS i FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS ks FROM qq)),
e AS (SELECT item_id, expansion, min(i) AS i FROM qt JOIN g ON tok = term GROUP BY ALL), x AS (SELECT item_id, string_agg(expansion, '; ' ORDER BY i) AS ex FROM e GROUP BY item_id),
asked AS (SELECT item_id AS query_id, 0 AS side, text FROM qq JOIN x USING (item_id) UNION ALL SELECT item_id, 1, text || ' (' || ex || ')' FROM qq JOIN x USING (item_id)), tk AS (SELECT query_id, side, unnest(list_distinct({_LW})) AS token FROM asked),
ix AS (SELECT token, id, count(*) AS n FROM (SELECT doc_id AS id, unnest({_LW}) AS token FROM documents) GROUP BY ALL), s AS (SELECT query_id, side, id, round(sum(n)::DOUBLE * 0.1::DOUBLE, 6) AS score FROM tk JOIN ix USING (token) GROUP BY ALL),
h AS (SELECT query_id, side, score, lang AS kind, source AS ref FROM s JOIN documents ON doc_id = id QUALIFY row_number() OVER (PARTITION BY query_id, side ORDER BY score DESC, id) = 1)
SELECT a.query_id, a.kind AS before_kind, a.ref AS before_ref, a.score AS before_score, z.kind AS after_kind, z.ref AS after_ref, z.score AS after_score, round(z.score / nullif(a.score, 0), 6) AS ratio, CASE WHEN a.kind IN ('en', 'es') AND z.kind NOT IN ('en', 'es') THEN 'MOVED' WHEN a.kind NOT IN ('en', 'es') AND z.kind IN ('en', 'es') THEN 'REGRESSED' WHEN a.ref <> z.ref THEN 'shifted' ELSE 'same' END AS verdict
FROM h a JOIN h z ON z.query_id = a.query_id AND a.side = 0 AND z.side = 1"""


@query(_AUDIT)
def gloss_audit(t):
    """H44, section 2.11: the best hit of each question that the glossary touches, without and with it."""
    w = t.benchmark.select("item_id", T.words(F.lower("text")).alias("w")).where("size(w) >= 6")
    find = glossary.finder(w.select(F.col("w")[1].alias("term"), F.concat_ws(" ", F.col("w")[4], F.col("w")[5]).alias("expansion"), F.col("item_id").alias("place")))
    asked = t.benchmark.where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text", find("text").alias("e")).where("size(e) > 0")
    rows = t.documents.select(F.col("doc_id").alias("id"), "text")

    def best(text):
        hits = retrieval.lexical_arm(rows, asked.select("query_id", text.alias("text")), 1)
        return hits.join(t.documents.select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("source").alias("ref")), "id").select("query_id", "kind", "ref", F.round("score", 6).alias("score"))

    audit = answers.gloss_audit(best(F.col("text")), best(glossary.glossed(F.col("text"), F.col("e"))), ("en", "es"))
    return audit.withColumn("ratio", F.round("ratio", 6))


_KIND = "CASE {0} % 3 WHEN 0 THEN 'quran' WHEN 1 THEN 'tafsir' ELSE 'fiqh' END"


@query(f"SELECT o_orderkey, CASE WHEN ({_KIND.format('o_orderkey')}) IN ('quran', 'tafsir') AND ({_KIND.format('o_custkey')}) = 'fiqh' THEN 'MOVED' WHEN ({_KIND.format('o_orderkey')}) = 'fiqh' AND ({_KIND.format('o_custkey')}) <> 'fiqh' THEN 'REGRESSED' WHEN o_orderkey % 5 <> o_custkey % 5 THEN 'shifted' ELSE 'same' END AS verdict FROM orders")
def score_verdict(t):
    """By the kinds and references of the best hits."""
    kind = lambda c: F.when(F.col(c) % 3 == 0, "quran").when(F.col(c) % 3 == 1, "tafsir").otherwise("fiqh")
    ref = lambda c: F.col(c) % 5
    return t.orders.select("o_orderkey", answers.verdict(kind("o_orderkey"), kind("o_custkey"), ref("o_orderkey"), ref("o_custkey")).alias("verdict"))


@query(f"SELECT o_orderkey, tier, CASE WHEN tier <> 'C' AND section <> 's3' AND (kind = 'quran' OR (kind = 'tafsir' AND source NOT IN ('w1', 'w2'))) AND score < 0.15 THEN 'CHECK' ELSE 'ok' END AS flag FROM (SELECT o_orderkey, CASE left(o_orderpriority, 1) WHEN '3' THEN 'C' WHEN '5' THEN 'A' ELSE left(o_orderpriority, 1) END AS tier, 's' || o_custkey % 4 AS section, {_KIND.format('o_orderkey')} AS kind, 'w' || o_custkey % 5 AS source, (o_orderkey % 100) / 400.0::DOUBLE AS score FROM orders)")
def tier_flag(t):
    """Practical questions whose best hit is weak scripture; works of law and sections that scripture answers are no miss."""
    first = F.substring("o_orderpriority", 1, 1)
    tier = F.when(first == "3", "C").when(first == "5", "A").otherwise(first)
    kind = F.when(F.col("o_orderkey") % 3 == 0, "quran").when(F.col("o_orderkey") % 3 == 1, "tafsir").otherwise("fiqh")
    flag = answers.tier_flag(tier, F.concat(F.lit("s"), F.col("o_custkey") % 4), kind, F.concat(F.lit("w"), F.col("o_custkey") % 5), F.col("o_orderkey") % 100 / 400.0, ("w1", "w2"), ("s3",))
    return t.orders.select("o_orderkey", tier.alias("tier"), flag.alias("flag"))


@query(r"SELECT page_id, lower(regexp_extract(url, 'https?://([^/]+)', 1)) AS host, len(regexp_extract_all(html, '<[^<>\n]{1,300}>'))::INT AS tags, trim(regexp_replace(regexp_replace(html, '<[^<>\n]{1,300}>', ' ', 'g'), '\s+', ' ', 'g')) AS bare FROM pages")
def inline_noise(t):
    """Bounded tags go, text stays."""
    c = F.col("html")
    tag = r"<[^<>\n]{1,300}>"
    return t.pages.select("page_id", F.lower(F.regexp_extract("url", "https?://([^/]+)", 1)).alias("host"), F.regexp_count(c, F.lit(tag)).alias("tags"), F.trim(T.sub(T.sub(c, tag, " "), r"\s+", " ")).alias("bare"))
