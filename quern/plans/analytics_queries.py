"""Queries of the editorial analytics, threads, audits and the write path, on the driver's tables by role."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import matching, similar, tables
from quern.plans.base import Registry
from quern.sources import readers

QUERIES = Registry()
query = QUERIES.query


def rows():
    return F.count(F.lit(1))



@query("SELECT r_name, n_name, count(DISTINCT s_suppkey) AS documents, count(c_custkey) AS chunks FROM region LEFT JOIN nation ON n_regionkey = r_regionkey LEFT JOIN supplier ON s_nationkey = n_nationkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL")
def corpus_stats(t):
    """Left joins keep parents without children. The two counts are taken before the join, so it makes no product."""
    s = t.supplier.groupBy("s_nationkey").agg(rows().alias("ns"))
    c = t.customer.groupBy("c_nationkey").agg(rows().alias("nc"))
    df = t.region.join(t.nation, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    df = df.join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    docs = F.coalesce("ns", F.lit(0))
    return df.select("r_name", "n_name", docs.alias("documents"), (F.coalesce("nc", F.lit(0)) * F.greatest(docs, F.lit(1))).alias("chunks"))


@query("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY ALL")
def status_counts(t):
    """A2."""
    return t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(rows().alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS missed, round(CASE WHEN count(*) > 0 THEN count(*) FILTER (WHERE event_type = 'error') / count(*) ELSE 0 END, 6) AS rate FROM events")
def miss_rate(t):
    """A3."""
    a = t.events.agg(rows().alias("total"), F.count_if(F.col("event_type") == "error").alias("missed"))
    return a.withColumn("rate", F.round(F.when(F.col("total") > 0, F.col("missed") / F.col("total")).otherwise(0.0), 6))


@query("SELECT user_id AS query, count(*) AS n, max(CASE WHEN event_id % 3 > 0 THEN value END) AS top_score, arg_max(event_id, (event_id % 3 > 0, CASE WHEN event_id % 3 > 0 THEN value ELSE 0 END, -event_id)) AS top_answer FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, top_score DESC NULLS LAST, query LIMIT 50")
def miss_queue(t):
    """The most asked misses with their best answer; groups without any score still have one."""
    score = F.when(F.col("event_id") % 3 > 0, F.col("value"))
    best = F.max_by("event_id", F.struct(score.isNotNull(), F.coalesce(score, F.lit(0.0)), -F.col("event_id")))
    q = t.events.where("event_type = 'error'").groupBy(F.col("user_id").alias("query")).agg(rows().alias("n"), F.max(score).alias("top_score"), best.alias("top_answer"))
    return q.orderBy(F.desc("n"), F.col("top_score").desc_nulls_last(), "query").limit(50)


@query("SELECT lang AS section, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS published, count(*) FILTER (WHERE quality = 0) AS rejected, count(*) FILTER (WHERE quality IS NULL) AS remaining FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def section_progress(t):
    """A12, J19."""
    q = F.col("quality")
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left").groupBy(F.col("lang").alias("section")).agg(rows().alias("total"), F.count_if(q == 1).alias("published"), F.count_if(q == 0).alias("rejected"), F.count_if(q.isNull()).alias("remaining"))


@query("SELECT l_returnflag AS collection, count(*) AS n, count(*) FILTER (WHERE 1 - l_discount < 0.95) AS partial FROM lineitem GROUP BY ALL")
def translation_stats(t):
    """A13."""
    return t.lineitem.groupBy(F.col("l_returnflag").alias("collection")).agg(rows().alias("n"), F.count_if(1 - F.col("l_discount") < 0.95).alias("partial"))


@query("SELECT answer_id, count(*) AS missing FROM (SELECT label AS answer_id, CASE WHEN vec_id % 7 = 0 THEN NULL WHEN vec_id % 11 = 0 THEN list_transform(embedding, lambda x: 0::FLOAT) ELSE embedding END AS e FROM embeddings) WHERE e IS NULL OR len(list_filter(e, lambda x: x <> 0)) = 0 GROUP BY answer_id")
def unembedded(t):
    """Null and zero vectors mean not embedded."""
    from quern.functions.vector import unembedded as missing

    e = F.when(F.col("vec_id") % 7 == 0, F.lit(None)).when(F.col("vec_id") % 11 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding"))
    return t.embeddings.select(F.col("label").alias("answer_id"), e.alias("e")).where(missing(F.col("e"))).groupBy("answer_id").agg(rows().alias("missing"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS joined, count(*) AS turns FROM conversations GROUP BY conv_id")
def joined_phrasings(t):
    """A7, in order of turn."""
    return t.conversations.groupBy("conv_id").agg(F.expr("listagg(text, ' ') within group (order by turn)").alias("joined"), rows().alias("turns"))


@query("WITH k AS (SELECT unnest(string_split(lower(text), chr(10))) AS phrasing, source FROM documents) SELECT phrasing, count(DISTINCT source) AS answers, string_agg(DISTINCT source, ', ' ORDER BY source) AS slugs FROM k WHERE phrasing <> '' GROUP BY phrasing HAVING count(DISTINCT source) > 1")
def shared_phrasing(t):
    """Lines that several sources have."""
    k = t.documents.select(F.explode(F.split(F.lower("text"), "\n")).alias("phrasing"), "source").where("phrasing <> ''").distinct()
    return k.groupBy("phrasing").agg(rows().alias("answers"), F.array_join(F.sort_array(F.collect_list("source")), ", ").alias("slugs")).where("answers > 1")


@query("SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY ALL HAVING count(*) > 1")
def sweep_duplicates(t):
    """A9, D12."""
    return tables.duplicates(t.documents.select(F.md5("text").alias("key")), ["key"])


@query("WITH c AS (SELECT o_orderkey, list_sort(list_distinct([o_orderkey % 5, o_custkey % 5, 1])) AS marked FROM orders), l AS (SELECT l_orderkey, list_sort(list(DISTINCT l_linenumber::BIGINT)) AS listed FROM lineitem GROUP BY ALL) SELECT o_orderkey, list_sort(list_filter(marked, lambda x: NOT list_contains(coalesce(listed, []), x))) AS dangling, list_sort(list_filter(coalesce(listed, []), lambda x: NOT list_contains(marked, x))) AS orphaned FROM c LEFT JOIN l ON l_orderkey = o_orderkey")
def dangling_orphan(t):
    """U-3: marks without a citation and citations without a mark."""
    marked = F.array_distinct(F.array(F.col("o_orderkey") % 5, F.col("o_custkey") % 5, F.lit(1).cast("long")))
    listed = t.lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.col("l_linenumber").cast("long")).alias("listed"))
    df = t.orders.select("o_orderkey", marked.alias("marked")).join(listed, "o_orderkey", "left").withColumn("listed", F.coalesce("listed", F.array().cast("array<bigint>")))
    return df.select("o_orderkey", F.sort_array(F.array_except("marked", "listed")).alias("dangling"), F.sort_array(F.array_except("listed", "marked")).alias("orphaned"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40)")
def no_citations_anti(t):
    """J8."""
    return t.orders.select("o_orderkey").join(t.lineitem.where("l_quantity > 40").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 5)")
def semi_by_ids(t):
    """F6, J9."""
    return t.lineitem.join(t.part.where("p_size < 5").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi").select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, count(l_orderkey) AS citations FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_discount > 0.08 GROUP BY o_orderkey")
def citation_counts(t):
    """Zero when none."""
    c = t.lineitem.where("l_discount > 0.08").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(rows().alias("n"))
    return t.orders.select("o_orderkey").join(c, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("citations"))


@query("SELECT l_orderkey, l_linenumber, p_name, c_name, n_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def hydrate(t):
    """Ids to rows over three parents."""
    df = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    df = df.join(t.part.select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"))
    df = df.join(t.orders.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    df = df.join(t.customer.select("c_custkey", "c_name", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey"))
    return df.join(F.broadcast(t.nation), F.col("n_nationkey") == F.col("c_nationkey")).select("l_orderkey", "l_linenumber", "p_name", "c_name", "n_name")  # 25 nations


@query("SELECT conv_id, turn, role, CASE WHEN role = 'assistant' THEN quality END AS answer_quality, text FROM conversations LEFT JOIN labels ON doc_id = conv_id")
def thread_rebuild(t):
    """J4."""
    lab = t.labels.select(F.col("doc_id").alias("conv_id"), "quality")
    return t.conversations.join(lab, "conv_id", "left").select("conv_id", "turn", "role", F.when(F.col("role") == "assistant", F.col("quality")).alias("answer_quality"), "text")


@query("SELECT o_orderkey, coalesce(string_agg(l_linenumber || ':' || l_returnflag, ',' ORDER BY l_linenumber, l_returnflag), '') AS translations, count(l_linenumber)::INT AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_tax > 0.05 GROUP BY o_orderkey")
def attached_lists(t):
    """A nested list in order, empty when there is none (flattened for comparison)."""
    lists = t.lineitem.where("l_tax > 0.05").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_returnflag"))).alias("xs"))
    df = t.orders.select("o_orderkey").join(lists, "o_orderkey", "left")
    flat = F.array_join(F.transform("xs", lambda x: F.concat_ws(":", x["l_linenumber"].cast("string"), x["l_returnflag"])), ",")
    return df.select("o_orderkey", F.coalesce(flat, F.lit("")).alias("translations"), F.coalesce(F.size("xs"), F.lit(0)).alias("n"))


@query("SELECT o_orderkey, coalesce(a.p_partkey, b.p_partkey) AS chunk FROM orders LEFT JOIN part a ON o_orderkey % 2 = 0 AND a.p_partkey = o_custkey LEFT JOIN part b ON b.p_partkey = o_orderkey % 500 WHERE coalesce(a.p_partkey, b.p_partkey) IS NOT NULL")
def citation_resolution(t):
    """By id, else by position, else dropped."""
    a, b = t.part.select(F.col("p_partkey").alias("a")), t.part.select(F.col("p_partkey").alias("b"))
    df = t.orders.select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).alias("byid"), (F.col("o_orderkey") % 500).alias("bypos"))
    df = df.join(a, F.col("a") == F.col("byid"), "left").join(b, F.col("b") == F.col("bypos"), "left")
    return df.select("o_orderkey", F.coalesce("a", "b").alias("chunk")).where("chunk is not null")


_DW = r"regexp_replace(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]', '', 'g'), '\s+', ' ', 'g')"


@query("WITH c AS (SELECT item_id, " + _DW.format("text") + " AS q FROM benchmark), d AS (SELECT doc_id, " + _DW.format("text") + " AS x FROM documents), m AS (SELECT item_id, doc_id, count(*) OVER (PARTITION BY item_id) AS n FROM c JOIN d ON contains(x, q) WHERE trim(q) <> '') SELECT item_id, doc_id FROM m WHERE n = 1")
def rebind_unique(t):
    """F11, A.10: a quote is bound again only if exactly one text holds its words."""
    met = similar.containing(t.benchmark.select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote")), t.documents.select(F.col("doc_id").alias("text_id"), "text"))
    one = met.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("quote_id"))).where("n = 1")
    return one.select(F.col("quote_id").alias("item_id"), F.col("text_id").alias("doc_id"))


_CITED = "array_to_string(string_split(text, ' ')[(doc_id % 7 + 1):(doc_id % 7 + doc_id % 12 + 1)], ' ')"


@query(f"WITH c AS (SELECT doc_id AS cite_id, source AS ref, '«' || {_CITED} || '.' AS quote FROM documents), k AS (SELECT doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS ref, " + _DW.format("text") + " AS x FROM documents), q AS (SELECT *, " + _DW.format("quote") + " AS q FROM c), m AS (SELECT cite_id, chunk_id, count(*) OVER (PARTITION BY cite_id) AS n FROM q JOIN k ON k.ref = q.ref AND contains(x, q) WHERE trim(q) <> '') SELECT cite_id, CASE WHEN n = 1 THEN chunk_id END AS chunk_id, n FROM m QUALIFY row_number() OVER (PARTITION BY cite_id ORDER BY chunk_id) = 1")
def rebind_by_ref(t):
    """Citations of 1 to 12 words that lost their chunk meet chunks of the same effective reference; bound where exactly one holds the words."""
    first = F.split(F.substring_index("text", " ", 18), " ")  # no quote goes beyond the 18th word
    quote = F.concat(F.lit("«"), F.array_join(F.slice(first, (F.col("doc_id") % 7 + 1).cast("int"), (F.col("doc_id") % 12 + 1).cast("int")), " "), F.lit("."))
    cites = t.documents.select(F.col("doc_id").alias("quote_id"), F.col("source").alias("ref"), quote.alias("quote"))
    # A chunk's own reference stands before that of its document.
    own = F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise("")
    chunks = t.documents.select(F.col("doc_id").alias("text_id"), T.effective_ref(own, F.col("source")).alias("ref"), "text")
    met = similar.counted(cites, chunks)
    return met.select(F.col("quote_id").alias("cite_id"), F.when(F.col("n") == 1, F.col("one")).alias("chunk_id"), "n")


@query("SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN coalesce('nation ' || n_name, '') ELSE c_name END AS c_name FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey")
def backfill_refs(t):
    """J12, D1."""
    facts = t.nation.select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("nation "), "n_name").alias("c_name"))
    df = t.customer.select("c_custkey", "c_nationkey", "c_name", "c_acctbal")
    return tables.backfill(df, facts, "c_nationkey", "c_name", F.col("c_acctbal") < 0).select("c_custkey", "c_name")


@query("WITH f AS (SELECT source, doc_id FROM documents WHERE n_chars < 200 UNION ALL SELECT lang, doc_id FROM documents WHERE n_chars > 4000), c AS (SELECT source AS kind, count(*) AS n, count(DISTINCT doc_id) AS answers FROM f GROUP BY ALL) SELECT kind, n, answers, doc_id FROM f JOIN c ON source = kind QUALIFY row_number() OVER (PARTITION BY kind ORDER BY doc_id) <= 25")
def findings_by_kind(t):
    """Counts of findings and of the answers they affect, with the first 25 of each kind; only these are ranked after a group limit."""
    d = t.documents
    f = d.where("n_chars < 200").select(F.col("source").alias("kind"), "doc_id").unionByName(d.where("n_chars > 4000").select(F.col("lang").alias("kind"), "doc_id"))
    first = f.withColumn("r", F.row_number().over(Window.partitionBy("kind").orderBy("doc_id"))).where("r <= 25").drop("r")
    return first.join(f.groupBy("kind").agg(rows().alias("n"), F.countDistinct("doc_id").alias("answers")), "kind").select("kind", "n", "answers", "doc_id")


@query(r"WITH x AS (SELECT doc_id, source, unnest(regexp_extract_all(text, '[A-Za-z@#~%$^&*_|\\]{2,}')) AS tok FROM documents), y AS (SELECT lower(tok) AS token, doc_id, source FROM x) SELECT token, count(*) AS n, count(DISTINCT source) AS books, min(doc_id) AS first_seen FROM y GROUP BY token ORDER BY n DESC, token LIMIT 20")
def markup_audit_top(t):
    """Suspect runs of whole texts, most frequent first."""
    found = F.regexp_extract_all("text", F.lit(r"[A-Za-z@#~%$^&*_|\\]{2,}"), F.lit(0))
    x = t.documents.select("doc_id", "source", F.explode(found).alias("tok"))
    per = x.groupBy(F.lower("tok").alias("token"), "source").agg(rows().alias("k"), F.min("doc_id").alias("d"))
    return per.groupBy("token").agg(F.sum("k").alias("n"), rows().alias("books"), F.min("d").alias("first_seen")).orderBy(F.desc("n"), "token").limit(20)


@query("SELECT source, round(avg(CASE WHEN n_chars % 4 > 0 THEN 1.0 ELSE 0 END), 6) AS coverage, count(*) AS blocks FROM documents GROUP BY source")
def coverage_ratio(t):
    """Share of blocks with a page."""
    page = F.when(F.col("n_chars") % 4 > 0, F.col("n_chars"))
    return t.documents.groupBy("source").agg(F.round(F.avg(page.isNotNull().cast("double")), 6).alias("coverage"), rows().alias("blocks"))


@query("SELECT l_orderkey AS book, nullif(l_linenumber % 3, 0)::INT AS volume, min(floor(l_quantity))::INT AS lo, max(floor(l_quantity))::INT AS hi, CASE WHEN min(floor(l_quantity)) = max(floor(l_quantity)) THEN min(floor(l_quantity))::INT || '' ELSE min(floor(l_quantity))::INT || '-' || max(floor(l_quantity))::INT END AS span FROM lineitem GROUP BY ALL")
def page_spans(t):
    """A17, A18."""
    page = F.floor("l_quantity").cast("int")
    g = t.lineitem.groupBy(F.col("l_orderkey").alias("book"), F.nullif(F.col("l_linenumber") % 3, F.lit(0)).alias("volume")).agg(F.min(page).alias("lo"), F.max(page).alias("hi"))
    return g.withColumn("span", F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", F.col("lo").cast("string"), F.col("hi").cast("string"))))


@query("SELECT event_type, p, list_sort(list(value))[(floor((count(*) - 1) * p) + 1)::INT] AS q FROM events, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) ps(p) GROUP BY event_type, p")
def quantile_lower_index(t):
    """The value at floor((n - 1) * p): found by counts of whole numbers first, so only values that share one with the wanted place are ranked."""
    ps = t.spark.createDataFrame([(0.1,), (0.5,), (0.9,)], "p double")
    e = t.events.select("event_type", "value", F.floor("value").alias("whole"))
    per = e.groupBy("event_type", "whole").agg(rows().alias("k"))
    n = per.groupBy("event_type").agg(F.sum("k").alias("n")).crossJoin(F.broadcast(ps)).select("event_type", "p", (F.floor((F.col("n") - 1) * F.col("p")) + 1).alias("want"))

    def found(counts, keys, order, wants):
        """The row of counts that each wanted place falls in, and the place within it."""
        c = counts.withColumn("upto", F.sum("k").over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))
        hit = c.join(wants, keys).where((F.col("want") <= F.col("upto")) & (F.col("want") > F.col("upto") - F.col("k")))
        return hit.withColumn("want", F.col("want") - F.col("upto") + F.col("k"))

    at = found(per, ["event_type"], "whole", n).select("event_type", "whole", "p", "want")
    near = e.join(at.select("event_type", "whole").distinct(), ["event_type", "whole"], "left_semi").groupBy("event_type", "whole", "value").agg(rows().alias("k"))
    return found(near, ["event_type", "whole"], "value", at).select("event_type", "p", F.col("value").alias("q"))


@query("(SELECT o_orderkey, 1 AS pinned FROM orders WHERE o_orderkey % 97 = 0) UNION ALL (SELECT o_orderkey, 0 FROM orders WHERE o_orderkey % 97 <> 0 ORDER BY o_orderdate DESC, o_orderkey LIMIT 100)")
def conversation_list(t):
    """U-1: all pinned ones and the newest hundred others."""
    o = t.orders
    newest = o.where("o_orderkey % 97 <> 0").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100)
    return o.where("o_orderkey % 97 = 0").select("o_orderkey", F.lit(1).alias("pinned")).unionByName(newest.select("o_orderkey", F.lit(0).alias("pinned")))


@query("WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS place FROM documents) SELECT doc_id, line, min(place)::INT AS first_place, row_number() OVER (PARTITION BY doc_id ORDER BY min(place))::INT AS ordinal FROM l GROUP BY doc_id, line")
def dedupe_first_seen(t):
    """Order-preserving dedupe within each answer (here a text's lines), with ordinals."""
    lines = t.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("place", "line"))
    d = lines.groupBy("doc_id", "line").agg(F.min("place").alias("first_place"))
    return d.withColumn("ordinal", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_place")))


@query("SELECT l_orderkey, min_by(l_partkey, (p, l_linenumber, l_partkey)) AS part, min(p) AS owner FROM (SELECT *, l_linenumber % 3 AS p FROM lineitem) GROUP BY l_orderkey")
def first_query_owns(t):
    """U-5: of several lists that hold an item the first one owns it."""
    p = F.col("l_linenumber") % 3
    return t.lineitem.groupBy("l_orderkey").agg(F.min_by("l_partkey", F.struct(p, F.col("l_linenumber"), F.col("l_partkey"))).alias("part"), F.min(p).alias("owner"))


@query("SELECT l_orderkey, arg_max(l_partkey, (l_extendedprice, -l_linenumber, l_partkey)) AS best FROM lineitem GROUP BY l_orderkey")
def best_chunk(t):
    """The highest score, the first of equal ones."""
    return t.lineitem.groupBy("l_orderkey").agg(F.max_by("l_partkey", F.struct(F.col("l_extendedprice"), -F.col("l_linenumber"), F.col("l_partkey"))).alias("best"))


@query("SELECT p_brand, p_type, n, coverage FROM (SELECT p_brand, p_type, count(*) AS n, round(avg(CASE WHEN p_size > 25 THEN 1.0 ELSE 0 END), 6) AS coverage FROM part GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) <= 6")
def version_ranking(t):
    """Up to six candidates of each work."""
    g = t.part.groupBy("p_brand", "p_type").agg(rows().alias("n"), F.round(F.avg((F.col("p_size") > 25).cast("double")), 6).alias("coverage"))
    return g.withColumn("r", F.row_number().over(Window.partitionBy("p_brand").orderBy(F.desc("n"), "p_type"))).where("r <= 6").drop("r")


@query("WITH g AS (SELECT * FROM customer WHERE length(trim(c_name)) BETWEEN 1 AND 1000 AND contains(lower(c_name), '1') AND regexp_matches(c_name, '^[A-Za-z]+#[0-9]+$')) SELECT 'no list, all' AS asked, c_custkey, c_name FROM g UNION ALL SELECT 'list, all', c_custkey, c_name FROM g WHERE c_nationkey IN (1, 2) UNION ALL SELECT 'no list, one', c_custkey, c_name FROM g WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'list, one', c_custkey, c_name FROM g WHERE c_nationkey IN (1, 2) AND c_mktsegment = 'BUILDING'")
def guarded_filters(t):
    """A list that may be left out, the value that stands for all, guards, shapes and substrings in one pushed-down filter."""
    c = F.col("c_name")
    rows_ = t.customer.where(F.length(F.trim(c)).between(1, 1000) & F.lower(c).contains("1") & c.rlike("^[A-Za-z]+#[0-9]+$"))
    asked = {"no list, all": (None, "all"), "list, all": ([1, 2], "all"), "no list, one": (None, "BUILDING"), "list, one": ([1, 2], "BUILDING")}
    each = [rows_.where(tables.in_list(F.col("c_nationkey"), kinds) & tables.is_or_all(F.col("c_mktsegment"), status)).select(F.lit(name).alias("asked"), "c_custkey", "c_name") for name, (kinds, status) in asked.items()]
    return functools.reduce(DataFrame.unionByName, each)


@query("SELECT p_partkey, p_name, p_size FROM part WHERE p_partkey % 10 > 0 UNION ALL SELECT p_partkey, upper(p_name), p_size + 1 FROM part WHERE p_partkey % 10 = 0 UNION ALL SELECT -p_partkey, p_name, 0 FROM part WHERE p_partkey % 50 = 0")
def upsert_rows(t):
    """Changed and new rows replace, others stay."""
    old = t.part.select("p_partkey", "p_name", "p_size")
    new = old.where("p_partkey % 10 = 0").select("p_partkey", F.upper("p_name").alias("p_name"), (F.col("p_size") + 1).alias("p_size"))
    new = new.unionByName(old.where("p_partkey % 50 = 0").select((-F.col("p_partkey")).alias("p_partkey"), "p_name", F.lit(0).alias("p_size")))
    return tables.upsert(old, new, ["p_partkey"])


@query("SELECT source, doc_id, n_chars FROM documents WHERE source <> 'src1' UNION ALL SELECT source, doc_id + 1000000, 1 FROM documents WHERE source = 'src1' AND doc_id % 3 = 0")
def replace_chunks(t):
    """Whole parts are replaced."""
    old = t.documents.select("source", "doc_id", "n_chars")
    new = old.where("source = 'src1' and doc_id % 3 = 0").select("source", (F.col("doc_id") + 1_000_000).alias("doc_id"), F.lit(1).cast("long").alias("n_chars"))
    return tables.replace_parts(old, new, "source")


@query("SELECT 'citations' AS side, o_orderkey AS id, o_custkey AS parent FROM orders WHERE o_custkey % 9 <> 0 UNION ALL SELECT 'log', o_orderkey, CASE WHEN o_custkey % 9 = 0 THEN NULL ELSE o_custkey END FROM orders")
def cascades(t):
    """Children go with a parent, or keep their row without it."""
    gone = t.customer.where("c_custkey % 9 = 0").select(F.col("c_custkey").alias("parent")).unionByName(t.orders.where("o_custkey % 9 = 0").select(F.col("o_custkey").alias("parent")))
    log = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent"))
    a = tables.cascade(log, gone, "parent").select(F.lit("citations").alias("side"), "id", "parent")
    return a.unionByName(tables.cascade(log, gone, "parent", set_null=True).select(F.lit("log").alias("side"), "id", "parent"))


@query("SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN 'published' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_acctbal > 0 THEN 'published' ELSE 'draft' END AS status FROM customer")
def publish_transition(t):
    """Publishing needs a reviewer and embedded phrasings."""
    a = t.customer.select(F.col("c_custkey").alias("id"), F.when(F.col("c_nationkey") == 3, "published").otherwise("draft").alias("status"), "c_mktsegment", "c_acctbal")
    reviewer = F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), F.lit("r"))
    return tables.after_transition(a, "publish", reviewer, F.col("c_acctbal") > 0).select("id", "status")


@query("SELECT * FROM (VALUES ('coverage in (0, 1]', (SELECT count(*) FROM lineitem WHERE NOT (1 - l_discount > 0 AND 1 - l_discount <= 1))), ('quantity below 45', (SELECT count(*) FROM lineitem WHERE NOT l_quantity < 45)), ('flag known', (SELECT count(*) FROM lineitem WHERE l_returnflag NOT IN ('A', 'N')))) v(rule, n)")
def expectations(t):
    """Checks of a written table in one pass."""
    c = 1 - F.col("l_discount")
    return tables.violations(t.lineitem, {"coverage in (0, 1]": (c > 0) & (c <= 1), "quantity below 45": F.col("l_quantity") < 45, "flag known": F.col("l_returnflag").isin("A", "N")})


@query("WITH o AS (SELECT conv_id, list(DISTINCT role) AS a FROM conversations GROUP BY ALL), n AS (SELECT conv_id, list(DISTINCT CASE WHEN turn > 2 AND role = 'user' THEN 'guest' ELSE role END) AS b FROM conversations GROUP BY ALL) SELECT conv_id, list_sort(list_filter(b, lambda x: NOT list_contains(a, x))) AS added, list_sort(list_filter(a, lambda x: NOT list_contains(b, x))) AS removed FROM o JOIN n USING (conv_id) WHERE list_sort(a) <> list_sort(b)")
def phrasing_sync(t):
    """U-4, D10: only sets that differ are replaced."""
    c = t.conversations
    new = c.select("conv_id", F.when((F.col("turn") > 2) & (F.col("role") == "user"), "guest").otherwise(F.col("role")).alias("role"))
    return tables.changed_sets(c.select("conv_id", "role"), new, "conv_id", "role")


@query("SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 3 = 0 THEN 't' || o_custkey END, md5(o_orderkey::VARCHAR)) AS token FROM orders")
def share_tokens(t):
    """A token once given stays."""
    old = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("t"), "o_custkey"))
    return t.orders.select("o_orderkey", F.coalesce(old, F.md5(F.col("o_orderkey").cast("string"))).alias("token"))


@query("WITH x AS (SELECT label AS kind, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings) SELECT kind, count(*) AS n, min(r) AS lo FROM x WHERE r <= 20 GROUP BY kind")
def kind_histogram(t):
    """A20 over the first rows of each kind."""
    r = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    x = t.embeddings.select(F.col("label").alias("kind"), r.cast("long").alias("r")).where("r <= 20")
    return x.groupBy("kind").agg(rows().alias("n"), F.min("r").alias("lo"))


@query("SELECT event_type AS query_text, user_id, min(ts) AS first_ts, count(*) AS asked FROM events GROUP BY ALL HAVING count(*) > 1")
def repeated_queries(t):
    """Reads back appended log rows, repeated texts."""
    return t.events.groupBy(F.col("event_type").alias("query_text"), "user_id").agg(F.min("ts").alias("first_ts"), rows().alias("asked")).where("asked > 1")


@query("SELECT doc_id, regexp_matches(text, '(?i)todo|lorem ipsum') AS placeholder, len(list_filter(string_split_regex(text, '[ \\t\\n\\r\\f\\x0b]+'), lambda w: w <> ''))::INT < 150 AS thin, regexp_matches(text, '(?m)^##\\s') AS heading_in_body, contains(text, '\\\"') AS escaped_quote FROM documents")
def body_sweeps(t):
    """Section 2.11: thin, placeholder, heading in body, escaped quote."""
    c = F.col("text")
    n = F.size(F.filter(F.split(c, r"[ \t\n\r\f\x0b]+"), lambda w: w != ""))
    return t.documents.select("doc_id", c.rlike("(?i)todo|lorem ipsum").alias("placeholder"), (n < 150).alias("thin"), c.rlike(r"(?m)^##\s").alias("heading_in_body"), F.contains(c, F.lit('\\"')).alias("escaped_quote"))


@query("SELECT l_orderkey, list(l_linenumber ORDER BY l_linenumber) <> list(rn ORDER BY l_linenumber) AS gap, count(*) - count(DISTINCT l_partkey) AS duplicate_quotes FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS rn FROM lineitem WHERE l_linenumber <> 3) GROUP BY l_orderkey")
def ordinal_gaps(t):
    """Section 2.11: ordinals that are not 1..n, quotes cited twice."""
    g = t.lineitem.where("l_linenumber <> 3").groupBy("l_orderkey").agg(rows().alias("n"), F.max("l_linenumber").alias("hi"), F.min("l_linenumber").alias("lo"), F.countDistinct("l_linenumber").alias("u"), F.countDistinct("l_partkey").alias("parts"))
    return g.select("l_orderkey", ((F.col("hi") != F.col("n")) | (F.col("lo") != 1) | (F.col("u") != F.col("n"))).alias("gap"), (F.col("n") - F.col("parts")).alias("duplicate_quotes"))


@query("SELECT event_id, value, first_value FROM (SELECT event_id, value, first_value(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_of_session(t):
    """The last of several entries wins."""
    w = Window.partitionBy("user_id")
    x = matching.best_by(t.events.withColumn("first_value", F.first("value").over(w.orderBy("ts", "event_id"))), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    return x.select("event_id", "value", "first_value")


@query("WITH n AS (SELECT o_custkey AS id, o_orderpriority AS name FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1) SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT id, name FROM n WHERE id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def insert_missing(t):
    """D3: on conflict nothing is done; of new rows with one key the first stays."""
    old = t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = t.orders.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("name"), "o_orderdate", "o_orderkey")
    return tables.insert_missing(old, new, ["id"], ["o_orderdate", "o_orderkey"])


@query("SELECT a.p_size AS surah, a.p_partkey AS ayah, a.p_name AS text, coalesce(b.p_type, '') AS english FROM part a LEFT JOIN part b ON b.p_partkey = a.p_partkey AND b.p_size % 3 <> 0")
def verse_pairs(t):
    """Verses with their translation, the empty string where there is none."""
    arabic = t.part.select(F.col("p_size").alias("surah"), F.col("p_partkey").alias("ayah"), F.col("p_name").alias("text"))
    english = t.part.where("p_size % 3 <> 0").select(F.col("p_size").alias("surah"), F.col("p_partkey").alias("ayah"), F.col("p_type").alias("text"))
    return readers.with_translation(arabic, english)


@query("SELECT * FROM (VALUES ('same', (SELECT count(*) FROM nation), (SELECT count(*) FROM nation), 0, 0), ('changed', (SELECT count(*) FROM part), (SELECT count(*) FROM part WHERE p_size > 3), (SELECT count(*) FROM part WHERE p_size <= 3), 0)) v(part, stored, produced, extra, lacking)")
def stored_equals_produced(t):
    """Rows stored and produced, and how many of each the other lacks."""
    same = tables.difference(t.nation, t.nation).select(F.lit("same").alias("part"), "*")
    return same.unionByName(tables.difference(t.part, t.part.where("p_size > 3")).select(F.lit("changed").alias("part"), "*"))


@query("SELECT o_orderkey, count(p_partkey) AS shown, count(*) FILTER (WHERE l_orderkey IS NOT NULL AND p_partkey IS NULL) AS orphans FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey AND p_size > 10 GROUP BY o_orderkey")
def orphan_counts(t):
    """Citations shown by the inner join, and those that it hides."""
    c = t.lineitem.select("l_orderkey", "l_partkey").join(t.part.where("p_size > 10").select("p_partkey"), F.col("p_partkey") == F.col("l_partkey"), "left")
    n = c.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("p_partkey").alias("shown"), F.count_if(F.col("p_partkey").isNull()).alias("orphans"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return t.orders.select("o_orderkey").join(n, "o_orderkey", "left").select("o_orderkey", zero("shown"), zero("orphans"))


_UUID = "'^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$'"
_ID = "CASE WHEN o_orderkey % 3 = 0 THEN md5(o_orderkey::VARCHAR) ELSE left(md5(o_orderkey::VARCHAR), 8) || '-' || substring(md5(o_orderkey::VARCHAR), 9, 4) || '-' || substring(md5(o_orderkey::VARCHAR), 13, 4) || '-' || substring(md5(o_orderkey::VARCHAR), 17, 4) || '-' || substring(md5(o_orderkey::VARCHAR), 21, 12) END"


@query(f"SELECT o_orderkey, regexp_matches({_ID}, {_UUID}) AS is_id, starts_with(lower(o_orderpriority), '1') AND regexp_matches(o_custkey::VARCHAR, '^[0-9]+$') AS listed FROM orders")
def id_shapes(t):
    """The shape of an id; a prefix in any case with digits alone."""
    h = F.md5(F.col("o_orderkey").cast("string"))
    cut = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))
    own = F.when(F.col("o_orderkey") % 3 == 0, h).otherwise(cut)
    listed = F.lower("o_orderpriority").startswith("1") & F.col("o_custkey").cast("string").rlike("^[0-9]+$")
    return t.orders.select("o_orderkey", own.rlike(_UUID.strip("'")).alias("is_id"), listed.alias("listed"))


@query("SELECT l_orderkey AS book, arg_min(l_suppkey, l_linenumber) FILTER (WHERE l_suppkey % 3 <> 0) AS volume FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey, l_partkey) AS r FROM lineitem) WHERE r = 1 GROUP BY l_orderkey")
def first_volume(t):
    """The first volume in order that is not null."""
    volume = F.when(F.col("l_suppkey") % 3 != 0, F.col("l_suppkey"))
    once = matching.best_by(t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"), ["l_orderkey", "l_linenumber"], ["l_suppkey", "l_partkey"])
    x = once.select(F.col("l_orderkey").alias("book"), volume.alias("volume"), F.when(volume.isNotNull(), F.col("l_linenumber")).alias("at"))
    return x.groupBy("book").agg(F.min_by("volume", "at").alias("volume"))


@query("SELECT c_custkey, force FROM customer, (VALUES (true), (false)) f(force) WHERE c_nationkey <> 3 AND (force OR NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'))")
def still_to_draft(t):
    """published ones are always left out, drafted ones unless forced."""
    todo = t.customer.where("c_nationkey <> 3").select("c_custkey")
    drafted = t.orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return todo.withColumn("force", F.lit(True)).unionByName(todo.join(drafted, "c_custkey", "left_anti").withColumn("force", F.lit(False)))
