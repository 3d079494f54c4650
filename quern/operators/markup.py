"""From marked-up works to page-cited chunks.

``line_kinds`` classifies lines with regular expressions. ``blocks`` parses works in two folds over sorted partitions, with one exchange: forward through the
lines with the stack of titles and the open paragraph, then backward through the blocks with the next page mark. ``classical_chunks`` packs blocks into chunks of a token
budget in a third fold, which carries heading, pages and cost. Each fold goes on over the edges of its Arrow batches and holds one paragraph or one chunk, whatever the length of a work.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.sources.shared import folder, stored

# The line grammar.
PAGE = r"Page(?:End)?V(\d+)P(\d+)"
PAGE_LINE = r"^\s*Page(?:End)?V(\d+)P(\d+)\s*$"
HEADING = r"^#{3,}\s*(\|+)\s*(.*)$"
ENTRY = r"^#{3,}\s*\$+\s*(.*)$"
START = r"^#\s+(.*)$"
CONTINUATION = r"^~~\s?(.*)$"
NOISE_LINE = r"^#####+\s*$|^\s*[_\-=~]{4,}\s*$"
INLINE_NOISE = (
    r"(?=[%m@_|P<])(?:%~%|\bms\d+\b|@Q[BE]@|_{4,}|^\|+|Page(?:End)?V\d*[A-Za-z]\w*P\w+|Page(?:End)?V\d+P\w*[A-Za-z]\w*"
    r"|<[^<>\n]{1,300}>|@[A-Za-z]{2,12}@)"
)  # the look ahead names the first characters, so that other places fail at once
# Runs of letters and marks that the parser should have consumed in a text of another script, and characters of a sample.
SUSPECT, CONTEXT = r"[A-Za-z@#~%$^&*_|\\]{2,}", 90
META = r"^#META#\s*(.+?)\s*::\s*(.*)$"
META_END = "#META#Header#End#"
ABSENT = ("NODATA", "NOTGIVEN", "NOCODE", "")

TARGET, OVERSIZE, WORDS_PER_WRAP = 650, 900, 382


def lines(works: DataFrame) -> DataFrame:
    """(work, line, raw) of works (work, text)."""
    return works.select("work", F.posexplode(F.split(F.regexp_replace("text", "\r\n", "\n"), "\n")).alias("line", "raw"))


def body(df: DataFrame) -> DataFrame:
    """Lines after the header: after its end mark, else after the last header line."""
    own = Window.partitionBy("work")
    end = F.min(F.when(F.trim("raw") == META_END, F.col("line"))).over(own)
    last = F.max(F.when(F.col("raw").startswith("#META#"), F.col("line"))).over(own)
    return df.withColumn("_from", F.coalesce(end, last, F.lit(-1))).where(F.col("line") > F.col("_from")).drop("_from")


def whole_bodies(works: DataFrame) -> DataFrame:
    """``body`` of the ``lines`` of works (work, text), a row each: lines stay in order in their work's partition, so nothing is exchanged after the texts and nothing is sorted."""
    cut = works.repartition("work").select("work", F.split(F.replace("text", F.lit("\r\n"), F.lit("\n")), "\n").alias("_lines"), F.contains("text", F.lit("#META#")).alias("_header"))
    end = F.nullif(F.array_position(F.transform("_lines", lambda x: F.trim(x)), META_END), F.lit(0)) - 1
    last = F.array_max(F.transform("_lines", lambda x, i: F.when(x.startswith("#META#"), i)))
    at = cut.select("work", "_lines", F.coalesce(F.when(F.col("_header"), F.coalesce(end, last)), F.lit(-1)).alias("_from"))
    return at.select("work", "_from", F.posexplode("_lines").alias("line", "raw")).where(F.col("line") > F.col("_from")).drop("_from")


def meta(df: DataFrame) -> DataFrame:
    """(work, key, value) of header lines; values that stand for nothing are left out."""
    m = df.select("work", "line", F.regexp_extract("raw", META, 1).alias("key"), F.trim(F.regexp_extract("raw", META, 2)).alias("value"))
    return m.where((F.col("key") != "") & ~F.col("value").isin(*ABSENT)).groupBy("work", "key").agg(F.max_by("value", "line").alias("value"))


def line_kinds(df: DataFrame) -> DataFrame:
    """kind and content of each line, the first rule that applies winning."""
    c = F.col("raw")
    noise = c.rlike(NOISE_LINE)
    clean = F.when(noise, "").otherwise(T.sub(c, "(?U)" + INLINE_NOISE, " "))
    blank, was_blank = ~F.col("clean").rlike(r"(?U)\S"), ~c.rlike(r"(?U)\S")
    df = df.withColumn("clean", clean)
    k = F.col("clean")
    kind = (
        F.when(noise | (blank & ~was_blank), "skip").when(k.rlike(PAGE_LINE), "page").when(k.rlike(ENTRY), "entry").when(k.rlike(HEADING), "heading")
        .when(blank, "blank").when(k.rlike(CONTINUATION), "more").when(k.rlike(START), "start").otherwise("text")
    )
    df = df.withColumn("kind", kind)
    content = (
        F.when(F.col("kind") == "entry", F.regexp_extract(k, ENTRY, 1)).when(F.col("kind") == "heading", F.regexp_extract(k, HEADING, 2))
        .when(F.col("kind") == "more", F.regexp_extract(k, CONTINUATION, 1)).when(F.col("kind") == "start", F.regexp_extract(k, START, 1)).otherwise(k)
    )
    return df.withColumn("content", content).withColumn("depth", F.when(F.col("kind") == "heading", F.length(F.regexp_extract(k, HEADING, 1))))


SEPARATOR = " › "
_PAGE = re.compile(PAGE)


def folded(df: DataFrame, order: list[Column] | None, step: Callable, schema: pa.Schema, types: str) -> DataFrame:
    """What step yields over the rows of each work in order: step(state, row) gives (state, rows); state and row are None before and after a work.

    df's partitions hold works whole. State goes on over the edges of batches. Without an order the rows come in theirs.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, work, started = None, None, False
        for b in batches:
            out: list[dict] = []
            names = b.schema.names
            for values in zip(*(c.to_pandas().tolist() if pa.types.is_string(c.type) else c.to_pylist() for c in b.columns)):
                row = dict(zip(names, values))
                if started and row["work"] != work:
                    out += ({"work": work} | r for r in step(state, None)[1])
                    state = None
                work, started = row["work"], True
                state, made = step(state, row)
                if made:
                    out += ({"work": work} | r for r in made)
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in out], f.type) for f in schema], schema=schema)
        if started:
            yield pa.RecordBatch.from_pylist([{"work": work} | r for r in step(state, None)[1]], schema)

    return (df if order is None else df.sortWithinPartitions("work", *order)).mapInArrow(run, types)


def _lines_step(state: dict | None, row: dict | None) -> tuple[dict, list[dict]]:
    """Titles in force, lines of the open paragraph, the last volume, the number of pieces so far; gives blocks, which have no page yet, and marks in document order."""
    s = state or {"crumbs": [], "open": [], "volume": None, "n": 0}
    out: list[dict] = []

    def piece(**values) -> None:
        s["n"] += 1
        out.append({"n": s["n"], "heading": None, "text": None, "volume": None, "page": None} | values)

    def marks(text: str) -> None:
        for volume, page in _PAGE.findall(text):
            if int(volume) or int(page):  # (0, 0) stands for text without pages
                s["volume"] = int(volume)
                piece(volume=s["volume"], page=int(page))

    def close() -> None:
        body, s["open"] = " ".join(t for t in map(str.strip, s["open"]) if t), []
        at = 0
        for m in [*(_PAGE.finditer(body) if "Page" in body else ()), None]:
            if text := body[at : m.start() if m else None].strip():
                piece(heading=SEPARATOR.join(s["crumbs"]), text=text, volume=s["volume"])
            if m:
                marks(m.group())
                at = m.end()

    kind = row["kind"] if row else "blank"
    if kind not in ("more", "text"):
        close()
    if kind == "page":
        marks(row["content"])
    elif kind == "heading":
        marks(row["content"])
        title = _PAGE.sub(" ", row["content"]).strip().strip("|").strip()
        s["crumbs"] = s["crumbs"][: row["depth"] - 1] + ([title] if title else [])  # no padding for depths that are skipped
    elif kind != "blank":
        s["open"].append(row["content"])
    return s, out


def _pages_step(mark: tuple[int, int] | None, row: dict | None) -> tuple[tuple[int, int] | None, list[dict]]:
    """Backward: a block takes the mark that follows it; what follows the last mark keeps the volume it has, and no page."""
    if row is None:
        return None, []
    if row["page"] is not None:
        return (row["volume"], row["page"]), []
    own = {c: row[c] for c in ("n", "heading", "text", "volume")}
    return mark, [own | dict(zip(("volume", "page"), mark or (row["volume"], None)))]


def blocks(df: DataFrame, together: bool = False) -> DataFrame:
    """(work, block, heading, text, volume, page) of classified lines; block numbers rise in document order.

    A block takes the next real page mark in document order, standing alone, inside a line or in a heading; text after the
    last mark has the last volume and no page. (0, 0) ends a piece of text but numbers nothing. together: partitions hold works whole already.
    """
    kind = df.schema["work"].dataType.simpleString()
    rows = df.where("kind <> 'skip'").select("work", "line", "kind", "content", "depth")
    arrow = pa.schema([("work", _arrow(df, "work")), ("n", pa.int32()), ("heading", pa.string()), ("text", pa.string()), ("volume", pa.int32()), ("page", pa.int32())])
    types = f"work {kind}, n int, heading string, text string, volume int, page int"
    pieces = folded(rows if together else rows.repartition("work"), ["line"], _lines_step, arrow, types)
    return folded(pieces, [F.desc("n")], _pages_step, arrow, types).withColumnRenamed("n", "block")


def parse(df: DataFrame) -> DataFrame:
    """``blocks`` of lines (work, line, raw), header included: one exchange."""
    return blocks(line_kinds(body(df.repartition("work"))), together=True)


def _whole_step(state: dict | None, row: dict | None) -> tuple[dict, list[dict]]:
    """Both folds at once: blocks wait for the next mark, at most until their work ends."""
    s = state or {"lines": None, "wait": [], "n": 0}
    out: list[dict] = []
    if row is not None and row["kind"] == "skip":
        return s, out
    s["lines"], made = _lines_step(s["lines"], row)

    def flush(mark: tuple[int, int] | None) -> None:
        for b in s["wait"]:
            s["n"] += 1
            out.append(b | {"n": s["n"]} | dict(zip(("volume", "page"), mark or (b["volume"], None))))
        s["wait"] = []

    for b in made:
        if b["page"] is None:
            s["wait"].append(b)
        else:
            flush((b["volume"], b["page"]))
    if row is None:
        flush(None)
    return s, out


def parse_whole(works: DataFrame) -> DataFrame:
    """``parse`` of works (work, text), a row each: one exchange of texts, no sort; blocks are numbered from 1 and come in order. A task holds one work's blocks that wait for a page mark."""
    kind = works.schema["work"].dataType.simpleString()
    rows = line_kinds(whole_bodies(works)).select("work", "kind", "content", "depth")  # lines to skip go to the fold: a filter here would classify each line twice
    arrow = pa.schema([("work", _arrow(works, "work")), ("n", pa.int32()), ("heading", pa.string()), ("text", pa.string()), ("volume", pa.int32()), ("page", pa.int32())])
    return folded(rows, None, _whole_step, arrow, f"work {kind}, n int, heading string, text string, volume int, page int").withColumnRenamed("n", "block")


def audit(df: DataFrame, show: int = 15, worst: int = 5) -> DataFrame:
    """(part, name, n, work, sample) of blocks: how many suspect runs there are and how many differ, the most frequent with the first place of each, the works that have most, and the blocks with and without a page."""
    own = F.regexp_extract_all("text", F.lit(SUSPECT), F.lit(0))
    runs = df.select("work", F.explode(own).alias("run")).withColumn("name", F.lower("run"))
    # Counts and first works by name keep no text; only the first works of the names shown are read again for their samples.
    found = stored(runs.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("work").alias("work")), folder(df.sparkSession, "runs"))
    shown = F.broadcast(found.orderBy(F.desc("n"), "name").limit(show))
    again = df.join(F.broadcast(shown.select("work").distinct()), "work", "left_semi").select("work", "block", F.substring("text", 1, CONTEXT).alias("sample"), F.explode(F.array_distinct(F.transform(own, F.lower))).alias("name"))
    samples = again.join(shown, ["name", "work"]).groupBy("name", "n", "work").agg(F.min(F.struct("block", "sample")).alias("at"))
    none, words = F.lit(None).cast(df.schema["work"].dataType), F.lit(None).cast("string")
    top = samples.select(F.lit("artifact").alias("part"), "name", "n", "work", F.col("at.sample").alias("sample"))
    works = df.select("work", F.size(own).cast("long").alias("n")).where("n > 0").groupBy("work").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "work").limit(worst).select(F.lit("work").alias("part"), words.alias("name"), "n", "work", words.alias("sample"))
    total = found.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("artifacts"), F.count(F.lit(1)).alias("distinct"))
    pages = df.agg(F.count(F.lit(1)).alias("blocks"), F.count("page").alias("paged"))
    line = lambda t, *names: t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in names])).alias("x")).select(F.lit("total").alias("part"), "x.name", "x.n", none.alias("work"), words.alias("sample"))
    return top.unionByName(works).unionByName(line(total, "artifacts", "distinct")).unionByName(line(pages, "blocks", "paged"))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def pack(df: DataFrame, target: int = TARGET) -> DataFrame:
    """(work, block, run, part) of df (work, block, heading, cost): in order, a new part where the budget would be passed, a new run where the heading changes.

    The budget's running sum starts anew at each flush, so it is no window function: partitions sorted by (work, block) are folded in
    Arrow batches with the state of one block, whatever the length of a work. A null cost counts nothing.
    """

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        work = heading = None
        run = part = total = 0
        started = False
        for f in frames:
            runs, parts = [], []
            for w, h, c in zip(f["work"], f["heading"], f["cost"].fillna(0).astype(int)):
                if not started or w != work:
                    work, heading, run, part, total, started = w, h, 1, 0, 0, True
                elif h != heading:
                    heading, run, part, total = h, run + 1, 0, 0
                if total > 0 and total + c > target:
                    part, total = part + 1, 0
                total += c
                runs.append(run)
                parts.append(part)
            yield pd.DataFrame({"work": f["work"], "block": f["block"], "run": runs, "part": parts})

    kinds = {x.name: x.dataType.simpleString() for x in df.schema}
    rows = df.select("work", "block", F.coalesce("heading", F.lit("")).alias("heading"), "cost").repartition("work").sortWithinPartitions("work", "block")
    return rows.mapInPandas(fold, f"work {kinds['work']}, block {kinds['block']}, run long, part int")


def classical_chunks(df: DataFrame, titles: DataFrame | Column, target: int = TARGET, together: bool = True, ordered: bool = False) -> DataFrame:
    """(work, ordinal, ref, volume, heading, content, embed_text, token_count) of blocks (work, block, heading, text, volume, page) and titles (work, title), or titles as an expression of work.

    A chunk never spans headings; oversize blocks are cut and packed again with their page. Its reference names the first volume and the span of
    pages, or the title alone where no page reached it. together: df comes from ``blocks``, whose partitions hold works whole;
    ordered: from ``parse_whole``, whose blocks also come in order.
    """
    from quern.operators import prose

    def step(state: dict | None, row: dict | None) -> tuple[dict, list[dict]]:
        s = state or {"n": 0, "texts": [], "cost": 0, "heading": "", "pages": [], "volume": None}
        out: list[dict] = []

        def close() -> None:
            if s["texts"]:
                low, high = (min(s["pages"]), max(s["pages"])) if s["pages"] and s["volume"] is not None else (None, None)
                out.append({"ordinal": s["n"], "heading": s["heading"], "body": "\n\n".join(s["texts"]), "volume": s["volume"] if low is not None else None, "low": low, "high": high})
                s.update(n=s["n"] + 1, texts=[], cost=0, pages=[], volume=None)

        if row is None or (s["texts"] and row["heading"] != s["heading"]):
            close()
        for text in prose.pieces(row["text"].strip()) if row and row["text"].strip() else ():
            cost = prose.cost(text)
            if s["cost"] + cost > target:
                close()
            if not s["texts"]:
                s["heading"] = row["heading"]
            s["texts"].append(text)
            s["cost"] += cost
            s["pages"] += [row["page"]] if row["page"] is not None else []
            s["volume"] = row["volume"] if s["volume"] is None else s["volume"]
        return s, out

    kind = df.schema["work"].dataType.simpleString()
    arrow = pa.schema([("work", _arrow(df, "work")), ("ordinal", pa.int32()), ("heading", pa.string()), ("body", pa.string()), ("volume", pa.int32()), ("low", pa.int32()), ("high", pa.int32())])
    types = f"work {kind}, ordinal int, heading string, body string, volume int, low int, high int"
    rows = df.select("work", "block", F.coalesce("heading", F.lit("")).alias("heading"), F.coalesce("text", F.lit("")).alias("text"), "volume", "page")
    made = folded(rows if together or ordered else rows.repartition("work"), None if ordered else ["block"], step, arrow, types)
    made = made.join(titles, "work") if isinstance(titles, DataFrame) else made.withColumn("title", titles)
    span = F.concat(F.lit(" "), F.col("volume").cast("string"), F.lit(":"), F.col("low").cast("string"), F.when(F.col("low") != F.col("high"), F.concat(F.lit("-"), F.col("high").cast("string"))).otherwise(""))
    ref = F.concat("title", F.coalesce(span, F.lit("")))
    none = F.lit(None).cast("string")
    parts = prose.assembled(ref, F.when(F.col("heading") != "", F.concat(F.lit(" — "), "heading")), none, F.col("body"), none)
    return made.select("work", "ordinal", ref.alias("ref"), "volume", "heading", *[c.alias(n) for n, c in parts.items()]).withColumn("token_count", T.estimate_tokens(F.col("content")))


def volume_ref(title: Column, volume: Column) -> Column:
    """Name of the document that a volume of a work is; volume 0 is a work of one unnumbered volume, which is not a work without pages."""
    return F.when(volume.isNull(), F.concat(title, F.lit(" (unpaginated)"))).when(volume == 0, title).otherwise(F.concat(title, F.lit(" vol. "), volume.cast("string")))


def volumes(chunks: DataFrame, titles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(work, volume, ref, ordinal, chunks) of each volume's document, unpaginated text last; and the names of a work that several documents would share, which refuse it."""
    counted = stored(chunks.groupBy("work", "volume").agg(F.count(F.lit(1)).alias("chunks")), folder(chunks.sparkSession, "volumes"))  # read three times
    own = counted.join(titles, "work").withColumn("ref", volume_ref(F.col("title"), F.col("volume")))
    order = Window.partitionBy("work").orderBy(F.col("volume").isNull(), "volume")
    clash = own.groupBy("ref").agg(F.count(F.lit(1)).alias("documents")).where("documents > 1")
    return own.select("work", "volume", "ref", (F.row_number().over(order) - 1).alias("ordinal"), "chunks"), clash


def split_oversize(c: Column, cost: Column) -> Column:
    """Pieces of a paragraph whose cost passes the limit: sentences, or runs of words where there is one sentence; others stay whole."""
    s = T.sentences(c)
    wrapped = T.let(F.split(c, r"\s+"), lambda w: F.transform(F.sequence(F.lit(1), F.size(w), F.lit(WORDS_PER_WRAP)), lambda i: F.array_join(F.slice(w, i, F.lit(WORDS_PER_WRAP)), " ")))
    return F.when(cost <= OVERSIZE, F.array(c)).when(F.size(s) > 1, s).otherwise(wrapped)
