"""Queries of the corpus pipeline: line classes, islands, page fill, chunk packing, linkage, readers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators import answers, linkage, markup, worksheets
from quern.plans.base import Registry
from quern.sources import readers
from quern.sources.shared import folder
from quern.streaming import appends, misses

QUERIES = Registry()
query = QUERIES.query

_W = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}_]+', ' ', 'g'), ' '), lambda w: w <> '')"
_CAND = f"WITH p AS (SELECT item_id, {_W} AS w FROM benchmark), d AS (SELECT doc_id, {_W} AS w FROM documents), ps AS (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - 6, 1), 3), lambda i: array_to_string(w[i:i+7], ' '))) AS s FROM p WHERE len(w) >= 8), ds AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 6, 1)), lambda i: array_to_string(w[i:i+7], ' '))) AS s FROM d WHERE len(w) >= 8) "


def _pair_sides(t):
    return t.benchmark.select(F.col("item_id").alias("passage_id"), "text"), t.documents.select(F.col("doc_id").alias("text_id"), "text")


@query(_CAND + "SELECT item_id AS passage_id, doc_id AS text_id, count(*) AS hits FROM ps JOIN ds USING (s) GROUP BY ALL HAVING count(*) >= 2")
def shingle_candidates(t):
    """J16, A19."""
    return linkage.candidates(*_pair_sides(t))


@query()
def linkage_verified(t):
    """U6, W10, A.5: SQL has no longest-match recursion; tested against a brute-force version."""
    p, d = _pair_sides(t)
    pairs = linkage.candidates(p, d).join(p.withColumnRenamed("text", "passage"), "passage_id").join(d, "text_id")
    return linkage.resolved(linkage.verified(pairs))


_DOCL = "WITH l AS (SELECT doc_id AS work, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents)"


@query(_DOCL + ", b AS (SELECT *, sum(CASE WHEN length(raw) < 60 THEN 1 ELSE 0 END) OVER (PARTITION BY work ORDER BY line ROWS UNBOUNDED PRECEDING) AS island FROM l) SELECT work, island, count(*) AS n, md5(string_agg(raw, ' ' ORDER BY line)) AS text FROM b GROUP BY work, island")
def paragraph_islands(t):
    """Short lines open a paragraph; gaps and islands, then an ordered join."""
    l = markup.lines(t.documents.select(F.col("doc_id").alias("work"), "text"))
    w = Window.partitionBy("work").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    b = l.withColumn("island", F.sum((F.length("raw") < 60).cast("int")).over(w))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), " ")
    return b.groupBy("work", "island").agg(F.count(F.lit(1)).alias("n"), F.md5(text).alias("text"))


@query(_DOCL + ", p AS (SELECT work, line, CASE WHEN line % 3 = 2 THEN line END AS page FROM l) SELECT work, line::INT AS line, min(page) OVER (PARTITION BY work ORDER BY line ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS next_page, max(page) OVER (PARTITION BY work ORDER BY line ROWS UNBOUNDED PRECEDING) AS last_page FROM p")
def backward_page_fill(t):
    """A line takes the next mark; what follows the last one keeps the last."""
    l = markup.lines(t.documents.select(F.col("doc_id").alias("work"), "text")).select("work", "line", F.when(F.col("line") % 3 == 2, F.col("line").cast("long")).alias("page"))
    w = Window.partitionBy("work").orderBy("line")
    return l.select("work", "line", F.first("page", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)).alias("next_page"), F.last("page", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("last_page"))


@query("SELECT o_orderkey, max(CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderkey END) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS section FROM orders")
def section_carry_down(t):
    """The last banner applies to what follows."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return t.orders.select("o_orderkey", F.last(F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderkey")), ignorenulls=True).over(w).alias("section"))


@query("WITH RECURSIVE l AS (SELECT doc_id AS work, generate_subscripts(string_split(text, chr(10)), 1)::INT AS block, unnest(string_split(text, chr(10))) AS raw FROM documents), c AS (SELECT work, block, (trunc(0.25::DOUBLE * length(raw))::INT + 1) AS cost FROM l), f AS (SELECT work, block, cost::BIGINT AS total, 0 AS part FROM c WHERE block = 1 UNION ALL SELECT c.work, c.block, CASE WHEN f.total + c.cost > 650 THEN c.cost ELSE f.total + c.cost END, CASE WHEN f.total + c.cost > 650 THEN f.part + 1 ELSE f.part END FROM f JOIN c ON c.work = f.work AND c.block = f.block + 1) SELECT work, part, count(*) AS blocks, max(total) AS cost FROM f GROUP BY work, part")
def chunk_packing(t):
    """W7, A.2: lines packed to 650 tokens; the running sum starts anew at each flush."""
    l = markup.lines(t.documents.select(F.col("doc_id").alias("work"), "text")).select("work", (F.col("line") + 1).alias("block"), F.lit("").alias("heading"), T.estimate_tokens(F.col("raw")).alias("cost"))
    p = markup.pack(l).join(l, ["work", "block"])
    return p.groupBy("work", "part").agg(F.count(F.lit(1)).alias("blocks"), F.sum("cost").alias("cost"))


@query(r"SELECT doc_id, len(CASE WHEN cost <= 900 THEN [text] WHEN len(string_split(regexp_replace(text, '([.!:])\s+', '\1' || chr(1), 'g'), chr(1))) > 1 THEN string_split(regexp_replace(text, '([.!:])\s+', '\1' || chr(1), 'g'), chr(1)) ELSE range(0, len(string_split_regex(text, '\s+')), 382)::VARCHAR[] END)::INT AS pieces FROM (SELECT doc_id, text, trunc(0.25::DOUBLE * length(text))::INT + 1 AS cost FROM documents)")
def oversize_split(t):
    """W9, A.4: only paragraphs beyond the limit are cut, those of one sentence into runs of words."""
    cost = T.estimate_tokens(F.col("text"))
    pieces = markup.split_oversize(F.col("text"), cost)
    return t.documents.select("doc_id", F.size(pieces).alias("pieces"))


@query("WITH u AS (SELECT lpad((page_id % 60)::VARCHAR, 4, '0') AS y, 'Author' || page_id AS a, page_id FROM pages), v AS (SELECT *, y || a || '.Book.V' || page_id || '-x1' AS uri FROM u), n AS (SELECT *, i, (y::INT + d) AS year FROM v, (VALUES (0, 0), (1, 25), (2, -25)) k(i, d) WHERE y::INT + d > 0), e AS (SELECT * FROM n, (VALUES (0, '.mARkdownSimple'), (1, '.mARkdown'), (2, '.completed'), (3, '.inProgress'), (4, '')) x(j, ext)) SELECT uri, (row_number() OVER (PARTITION BY uri ORDER BY i, j))::INT AS rank, 'base/' || lpad((ceil(year / 25.0) * 25)::INT::VARCHAR, 4, '0') || 'AH/master/data/' || y || a || '/' || y || a || '.Book/' || uri || ext AS address FROM e")
def candidate_urls(t):
    """Every spelling of a version's address in three buckets, best first."""
    year = F.lpad((F.col("page_id") % 60).cast("string"), 4, "0")
    return readers.candidate_addresses(t.pages.select(F.concat(year, F.lit("Author"), "page_id", F.lit(".Book.V"), "page_id", F.lit("-x1")).alias("uri")), "base")


@query("WITH l AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN (turn + 1) || '. ' || role || turn END AS banner, 's' || turn % 4 AS slug FROM conversations), w AS (SELECT conv_id, turn, banner, slug, last_value(banner IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS at_ FROM l) SELECT conv_id AS file, slug, arg_max(split_part(at_, '. ', 1)::INT, turn) AS number, arg_max(split_part(at_, '. ', 2), turn) AS title FROM w WHERE banner IS NULL AND at_ IS NOT NULL GROUP BY conv_id, slug")
def sections_by_slug(t):
    """Lines of banners and slugs; each slug with the last banner above it."""
    raw = F.when(F.col("turn") % 3 == 1, F.concat(F.lit("#  "), (F.col("turn") + 1).cast("string"), F.lit(". "), "role", "turn", F.lit("  "))).otherwise(F.concat(F.lit("- slug: s"), F.col("turn") % 4))
    return answers.sections(t.conversations.select(F.col("conv_id").alias("file"), F.col("turn").alias("line"), raw.alias("raw")))


@query("SELECT event_id, user_id, 'events' AS stream, event_id % 4 AS batch FROM events")
def log_appends(t):
    """The log stored in four batches, each handed over twice."""
    path = folder(t.spark, "log")
    for k in (0, 1, 2, 3, 2, 0, 3, 1):
        appends.append_once(t.events.where(F.col("event_id") % 4 == k).select("event_id", "user_id"), path, "events", k)
    return appends.stored_rows(t.spark, path)


@query("SELECT conv_id, turn, CASE WHEN text = '-' THEN NULL ELSE string_split(text, ' ')[1] END AS first_word, len(string_split(text, ' '))::INT AS n FROM conversations WHERE NOT starts_with(text, '#') AND trim(text) <> ''")
def expected_sets(t):
    """Blank and comment lines are skipped, '-' is the empty set."""
    c = F.col("text")
    parts = F.when(c == "-", F.array().cast("array<string>")).otherwise(F.split(c, " "))
    return t.conversations.where(~c.startswith("#") & (F.trim(c) != "")).select("conv_id", "turn", F.get(parts, F.lit(0)).alias("first_word"), F.size(parts).alias("n"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS total, count(*) FILTER (WHERE event_type = 'error') AS missed, round(count(*) FILTER (WHERE event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1")
def daily_miss_rate(t):
    """Section 2.8: the log by day; the same function serves a stream."""
    log = t.events.select(F.col("ts").alias("created_at"), (F.col("event_type") != "error").alias("matched"))
    return misses.daily_miss_rate(log).withColumn("rate", F.round("rate", 6))


_SHEET_SQL = r"""WITH s AS (SELECT 's' || item_id AS slug, item_id, trim(regexp_replace(left(text, 40), '["\s]+', ' ', 'g')) AS quote FROM benchmark)
SELECT slug, 1::INT AS ordinal, quote, (item_id * 10 + 1)::BIGINT AS chunk_id FROM s
UNION ALL SELECT slug, 2::INT, 'quoted of ' || slug, (item_id * 10 + 2)::BIGINT FROM s WHERE item_id % 3 = 0
UNION ALL SELECT slug, 2::INT, 'quoted of ' || slug, NULL::BIGINT FROM s WHERE item_id % 3 <> 0"""


def _sheets(t):
    """A worksheet for each item of benchmark; two of three lack their second passage. A heading that only begins alike is another section."""
    slug, quote = F.concat(F.lit("s"), "item_id"), F.trim(T.sub(F.substring("text", 1, 40), r'["\s]+', " "))
    number = lambda n: F.concat(F.lit(f"### Passage {n} — item "), "item_id", F.lit("\n\n- kind: text · chunk: "), (F.col("item_id") * 10 + n).cast("string"), F.lit("\n\n> "), "text", F.lit("\n\n"))
    second = F.when(F.col("item_id") % 3 == 0, number(2)).otherwise("")
    cited = F.concat(F.lit('## Citations old\n1. passage=1 quote="no"\n## Citations\n<!-- one a line -->\n1. passage=1 quote="'), quote, F.lit('"\n 2. passage=2 quote=" quoted of '), slug, F.lit('"\n'))
    return t.benchmark.select(slug.alias("slug"), F.concat(F.lit("## Answer\nBody [1] <!-- no -->\n## Passages\n"), number(1), second, cited).alias("text"))


@query(_SHEET_SQL)
def worksheet_citations(t):
    """Citations of a worksheet with the chunk of their passage; a passage it lacks is null."""
    df = _sheets(t)
    p = worksheets.passages(df).select("slug", F.col("number").alias("passage"), "chunk_id")
    return worksheets.citations(df).join(p, ["slug", "passage"], "left").select("slug", "ordinal", "quote", "chunk_id")


_RENDER_SQL = """WITH h AS (SELECT l_orderkey AS o, l_partkey AS c, min({'q': l_linenumber % 3, 'r': l_linenumber}) AS f FROM lineitem GROUP BY ALL),
p AS (SELECT o, c, f, row_number() OVER (PARTITION BY o ORDER BY f.q, f.r, c) AS i FROM h),
b AS (SELECT o, string_agg('### Passage ' || i || ' — part ' || c || CASE WHEN c % 4 = 0 THEN ' (chapter-level, no page)' ELSE '' END || chr(10) || chr(10) || '- kind: ' || p_brand || ' · source: ' || p_type || ' · chunk: ' || c || chr(10)
  || CASE f.q WHEN 0 THEN '' WHEN 1 THEN '- found via: "' || o_orderpriority || '"' || chr(10) ELSE '- found via: "' || o_orderstatus || '"' || chr(10) END || chr(10) || '```' || chr(10) || p_name || chr(10) || '```' || chr(10), chr(10) ORDER BY i) AS body
  FROM p JOIN part ON p_partkey = c JOIN orders ON o_orderkey = o GROUP BY o)
SELECT 'o' || o AS slug, '# order ' || o || chr(10) || chr(10) || CASE WHEN o_custkey % 5 = 0 THEN '> Expected to decline: say who can help, give no ruling, cite only what the question touches.' || chr(10) || chr(10) ELSE '' END
  || CASE WHEN o_orderstatus = 'F' THEN '> Reviewer note: ' || o_orderpriority || chr(10) || chr(10) ELSE '' END || '__SHEET__' || body AS value FROM b JOIN orders ON o_orderkey = o""".replace("__SHEET__", worksheets.SHEET)


@query(_RENDER_SQL)
def worksheet_rendered(t):
    """A worksheet for each order, its parts as passages found by three queries; a part found twice stands where it was first."""
    slug = lambda c: F.concat(F.lit("o"), c).alias("slug")
    asked = t.orders.select(slug("o_orderkey"), F.concat(F.lit("order "), "o_orderkey").alias("question"), F.array("o_orderpriority", "o_orderstatus").alias("also"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("note"), (F.col("o_custkey") % 5 == 0).alias("decline"))
    found = t.lineitem.select(slug("l_orderkey"), (F.col("l_linenumber") % 3).alias("query"), F.col("l_linenumber").alias("rank"), F.col("l_partkey").alias("chunk_id"))
    parts = t.part.select(F.col("p_partkey").alias("chunk_id"), F.col("p_brand").alias("kind"), F.concat(F.lit("part "), "p_partkey").alias("ref"), F.col("p_type").alias("title"), F.col("p_name").alias("text"), (F.col("p_partkey") % 4 != 0).alias("paged"))
    return worksheets.rendered(asked, found.join(parts, "chunk_id"))


_GROUND_SQL = """WITH a AS (SELECT o_orderkey AS id, (o_orderkey % 114 + 1) || ':' || (o_custkey % 200 + 1) AS v, o_orderkey % 3 AS k FROM orders)
SELECT id, CASE k WHEN 0 THEN 'Tirmidhi|Muslim 300:4000' WHEN 1 THEN v || '|Tirmidhi|Sahih Muslim|Muslim 300:4000' ELSE v || '|Tirmidhi|Abu Dawud|Sahih Muslim|Muslim 300:4000' END AS unverified, k = 2 AS uncited FROM a"""


@query(_GROUND_SQL)
def grounding(t):
    """H30, A.8: references that stand in no cited text; a name counts as a whole, whatever its case and line breaks."""
    verse = F.concat_ws(":", F.col("o_orderkey") % 114 + 1, F.col("o_custkey") % 200 + 1)
    kind = F.col("o_orderkey") % 3
    answer = F.concat(F.lit("See "), verse, F.lit(" and "), verse, F.lit("; Tirmidhi, Abu Dawud and\nTIRMIDHI say; Sahih\nMuslim, a Muslim, Muslim 300:4000. "), F.when(kind == 2, F.repeat(F.lit("more "), 100)).otherwise(""))
    cited = F.when(kind == 0, F.array(F.concat(F.lit("on "), verse), F.lit("sahih  muslim"), F.lit("Sunan Abi Dawud 3"))).when(kind == 1, F.array(F.lit("a muslim author"), F.lit("abu dawud"))).otherwise(F.array().cast("array<string>"))
    df = t.orders.select(F.col("o_orderkey").alias("id"), answer.alias("answer"), cited.alias("cited"))
    return df.select("id", F.array_join(worksheets.unverified(F.col("answer"), F.col("cited")), "|").alias("unverified"), worksheets.uncited(F.col("answer"), F.col("cited")).alias("uncited"))


_TURN = "WITH t AS (SELECT doc_id AS id, regexp_replace(text, '[*`\\[\\]]', '_', 'g') AS x FROM documents), l AS (SELECT id, unnest(string_split(x, chr(10))) AS line, generate_subscripts(string_split(x, chr(10)), 1)::INT - 1 AS i FROM t WHERE x <> ''), k AS (SELECT id, i * 2 AS spot, line, i % 4 AS turn FROM l WHERE line <> '')"


@query(_TURN + " SELECT id, spot, '' || spot AS path, CASE turn WHEN 0 THEN 'strong' WHEN 1 THEN 'em' WHEN 2 THEN 'code' ELSE 'text' END AS kind, CASE WHEN turn >= 2 THEN line END AS text FROM k UNION ALL SELECT id, spot, spot || '.0', 'text', line FROM k WHERE turn < 2 UNION ALL SELECT id, spot + 1, '' || (spot + 1), 'cite', '7' FROM k")
def inline_markup(t):
    """Every line of a text in another mark, each followed by a citation; nodes come back nested."""
    lines = F.split(F.regexp_replace("text", r"[*`\[\]]", "_"), "\n")
    df = t.documents.select(F.col("doc_id").alias("id"), F.posexplode(lines).alias("i", "line")).where("line <> ''")
    mark = F.element_at(F.array(F.lit("**"), F.lit("*"), F.lit("`"), F.lit("")), F.col("i") % 4 + 1)
    # Lines are parsed one by one here, so that a place in the text can be told from the line's number.
    one = df.select((F.col("id") * 1_000_000 + F.col("i")).alias("id"), F.concat(mark, "line", mark, F.lit("[7]")).alias("text"))
    n = worksheets.inline_nodes(one)
    at = F.col("id") % 1_000_000 * 2 + F.col("path")[0]
    path = F.array_join(F.concat(F.array(at.cast("string")), F.transform(F.slice("path", 2, 3), lambda x: x.cast("string"))), ".")
    return n.select(F.floor(F.col("id") / 1_000_000).alias("id"), at.cast("int").alias("spot"), path.alias("path"), "kind", "text")