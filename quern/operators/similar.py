"""Joins of sets and of quotes without meeting on what is common.

``similar`` keeps the pairs whose sets are alike: members are put in order of rarity, a pair over the threshold shares one of the rarest members of both sides, the prefix,
and sizes of alike sets are bounded by each other; what meets is compared exactly. ``containing`` finds the texts that hold a quote word for word: each quote meets
texts by its rarest run of whole words alone, and within one reference where references are given. ``counted`` only counts them, so nothing is exchanged for a quote but what
a batch of texts counts, however many texts hold it.

Cases: empty and null sets are alike to nothing; null and wordless quotes are contained in nothing; repeated ids are one set.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as T
from quern.operators.retrieval import MAX_BROADCAST_ROWS, small
from quern.sources.shared import folder, stored

GRAM = 3
#: Code points at which every place of a text is looked up; code points of texts that are looked up at once, and that are counted at once; quotes whose counts a task holds.
DENSE, BLOCK, PART, MOST_HELD = 4, 1 << 15, 1 << 21, 200_000
#: Bits of a filter that every task holds: for each key, and at most (32 MB; beyond, more of what meets is dropped by the join). Keys of a quote, by rule of thumb; bits of a filter that are packed by one task, and bytes of them; cells, in bits, that repeated runs meet in.
BITS_EACH, MOST_BITS, KEYS_EACH, SEGMENT, CELLS = 32, 1 << 28, 2, 20, 18
SEGMENT_BYTES = 1 << (SEGMENT - 3)
_STEP, _CODE, _TAG = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x165667B19E3779F9
_PROBES = tuple(np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB))


def prefixes(sets: DataFrame, rarity: DataFrame, threshold: float) -> DataFrame:
    """(id, n, member) of sets (id, member): the rarest members, as many as leave too few to reach the threshold without one of them."""
    ranked = sets.join(rarity, "member", "left").withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("id")))
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(0)), "member"))
    return ranked.withColumn("r", place).where(F.col("r") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1).select("id", "n", "member")


def similar(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id, right_id, similarity) of left and right (id, members) whose Jaccard similarity reaches the threshold."""
    a, b = (s.select("id", F.array_distinct("members").alias("members")).where(F.size("members") > 0).dropDuplicates(["id"]) for s in (left, right))
    x, y = (s.select("id", F.explode("members").alias("member")) for s in (a, b))
    rarity = y.groupBy("member").agg(F.count(F.lit(1)).alias("df"))
    p, q = prefixes(x, rarity, threshold), prefixes(y, rarity, threshold)
    near = (F.col("p.n") >= threshold * F.col("q.n") - 1e-9) & (F.col("q.n") >= threshold * F.col("p.n") - 1e-9)
    met = p.alias("p").join(q.alias("q"), (F.col("p.member") == F.col("q.member")) & near).select(F.col("p.id").alias("left_id"), F.col("q.id").alias("right_id")).distinct()
    both = met.join(a.select(F.col("id").alias("left_id"), F.col("members").alias("_a")), "left_id").join(b.select(F.col("id").alias("right_id"), F.col("members").alias("_b")), "right_id")
    return both.withColumn("similarity", T.jaccard(F.col("_a"), F.col("_b"))).where(F.col("similarity") >= threshold).drop("_a", "_b")


def _runs(words: Column, n: int) -> Column:
    """Hashes of the runs of n words."""
    none = F.array().cast("array<bigint>")
    return T.let(words, lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(n))))).otherwise(none))


def containing(quotes: DataFrame, texts: DataFrame, by_ref: bool = False) -> DataFrame:
    """(quote_id, text_id) of quotes (quote_id, quote) and texts (text_id, text) that hold their words; by_ref: both have a column ref, which must agree.

    Words are compared in lower case, without punctuation, white space as one space. The first and the last word may end inside a word of the text; those between are whole.
    """
    ref = ["ref"] if by_ref else []
    q = quotes.select("quote_id", *ref, T.database_words(F.col("quote")).alias("q")).where(F.trim("q") != "")
    d = texts.select("text_id", *ref, T.database_words(F.col("text")).alias("body"))
    inner = F.regexp_extract_all("q", F.lit(r"(?<= )[^ ]+(?= )"), F.lit(0))
    q = q.withColumn("inner", inner)
    words = d.select("text_id", *ref, F.filter(F.split("body", " "), lambda w: w != "").alias("w"))
    # Quotes with whole words meet by the rarest of their runs; only runs that a quote has are counted and exchanged.
    runs = F.when(F.size("inner") >= GRAM, _runs(F.col("inner"), GRAM)).otherwise(_runs(F.col("inner"), 1))
    asked = q.where(F.size("inner") > 0).select("quote_id", F.explode(F.array_distinct(runs)).alias("gram"))
    singles = not q.where(F.size("inner").between(1, GRAM - 1)).isEmpty()
    held = F.concat(_runs(F.col("w"), 1), _runs(F.col("w"), GRAM)) if singles else _runs(F.col("w"), GRAM)
    places = words.select("text_id", *ref, F.explode(F.array_distinct(held)).alias("gram")).join(small(asked.select("gram").distinct()), "gram", "left_semi")
    places = stored(places, folder(quotes.sparkSession, "grams"))
    df = places.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    # A run that no text has ends its quote.
    anchor = asked.join(df, "gram", "left").groupBy("quote_id").agg(F.min_by(F.struct("gram", "df"), F.struct(F.coalesce("df", F.lit(0)), "gram")).alias("a")).where("a.df is not null").select("quote_id", F.col("a.gram").alias("gram"))
    own = anchor.join(q.drop("inner"), "quote_id")
    met = places.join(small(own), ["gram", *ref]).select("quote_id", "text_id", "q")
    # The others are one or two words: within a reference they are compared there, else they meet the vocabulary, not the texts.
    few = q.where(F.size("inner") == 0).drop("inner")
    if by_ref:
        met = met.unionByName(few.join(d.select("text_id", "ref"), "ref").select("quote_id", "text_id", "q"))
    elif not few.isEmpty():
        part = F.split(F.trim("q"), " ")
        first, second = part[0], F.get(part, F.lit(1))
        side = few.select("quote_id", "q", F.when(second.isNull() | (F.length(first) > F.length(second)), first).otherwise(second).alias("part"), second.isNull().alias("single"), (F.length(first) > F.length(second)).alias("ends"))
        vocabulary = words.select(F.explode(F.array_distinct("w")).alias("word")).distinct()
        fits = F.when(F.col("single"), F.contains("word", F.col("part"))).when(F.col("ends"), F.endswith("word", F.col("part"))).otherwise(F.startswith("word", F.col("part")))
        whole = vocabulary.join(small(side), fits).select("quote_id", "q", "word")
        met = met.unionByName(words.select("text_id", F.explode(F.array_distinct("w")).alias("word")).join(small(whole), "word").select("quote_id", "text_id", "q"))
    return met.distinct().join(d.select("text_id", "body"), "text_id").where(F.contains("body", F.col("q"))).select("quote_id", "text_id")


def _blocks(refs: pa.Array, texts: pa.Array, most: int) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(texts with a line break after each, their rows, where they start and where the last ends, hashes of their references), ``most`` code points or a text at a time."""
    seeds, rows, parts, n = {}, [], [], 0

    def block() -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
        return "".join(parts), np.array(rows), np.cumsum([0, *map(len, parts)]), np.array([seeds[refs[i].as_py()] for i in rows], np.uint64)

    for i in range(len(texts)):
        ref = refs[i].as_py()
        if ref not in seeds:
            seeds[ref] = xxhash.xxh3_64_intdigest(ref.encode())
        rows.append(i)
        parts.append(texts[i].as_py() + "\n")
        n += len(parts[-1])
        if n >= most:
            yield block()
            rows, parts, n = [], [], 0
    if parts:
        yield block()


def _level(n: int) -> bool:
    """Whether places are left at this length where no quote goes on."""
    return n >= DENSE and n & (n - 1) == 0


def _keys(h: np.ndarray, seeds: np.ndarray, n: int, whole: bool) -> np.ndarray:
    return (h ^ seeds) + np.uint64((2 * n + whole) * _TAG & 0xFFFFFFFFFFFFFFFF)


def _slots(keys: np.ndarray, probe: np.uint64, bits: int) -> np.ndarray:
    return (keys * probe) >> np.uint64(64 - bits)


def _held(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places whose key may be in the table."""
    at, bits = None, len(table).bit_length() + 2
    for probe in _PROBES:
        slot = _slots(keys if at is None else keys[at], probe, bits)
        hit = np.flatnonzero(table.take((slot >> np.uint64(3)).view(np.int64)) >> (slot.astype(np.uint8) & np.uint8(7)) & np.uint8(1))
        at = hit if at is None else at[hit]
    return at


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _numbers(codes: np.ndarray) -> np.ndarray:
    return (codes.astype(np.uint64) + np.uint64(1)) * _CODE


def _filters(quotes: DataFrame, counts: tuple[int, int]) -> list[np.ndarray]:
    """Two Bloom filters of quotes (ref, q): of their first DENSE code points and of whole shorter ones, and of longer starts and whole quotes. Their size is bounded, whatever the counts of keys."""
    bits = [min(max(10, (BITS_EACH * n).bit_length()), MOST_BITS.bit_length() - 1) for n in counts]

    def slots(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, _, begin, seeds in _blocks(b.column("ref"), b.column("q"), BLOCK):
                own, sizes, at, n = _numbers(_codes(text)), np.diff(begin) - 1, begin[:-1], 0
                h = np.zeros(len(at), np.uint64)
                while len(at):
                    n += 1
                    h = h * _STEP + own[at + (n - 1)]
                    done = sizes == n
                    made = [(int(n >= DENSE), _keys(h[done], seeds[done], n, True))] + ([(int(n > DENSE), _keys(h, seeds, n, False))] if _level(n) else [])
                    for table, keys in made:
                        for probe in _PROBES if len(keys) else ():
                            slot = np.unique(_slots(keys, probe, bits[table])).astype(np.int64)
                            yield pa.RecordBatch.from_arrays([pa.array((slot >> SEGMENT) + (table << 32)), pa.array((slot & ((1 << SEGMENT) - 1)).astype(np.int32))], ["segment", "slot"])
                    h, at, seeds, sizes = h[~done], at[~done], seeds[~done], sizes[~done]

    def packed(rows: pa.Table) -> pa.Table:
        part = np.zeros(1 << SEGMENT, bool)
        part[rows.column("slot").to_numpy()] = True
        return pa.table([rows.column("segment").slice(0, 1), pa.array([np.packbits(part, bitorder="little").tobytes()], pa.binary())], ["segment", "part"])

    tables = [np.zeros(max(1 << (b - 3), SEGMENT_BYTES), np.uint8) for b in bits]
    found = quotes.mapInArrow(slots, "segment long, slot int").distinct().groupBy("segment").applyInArrow(packed, "segment long, part binary")
    for segment, part in found.collect():  # at most MOST_BITS bits of each
        lo = (segment & 0xFFFFFFFF) * SEGMENT_BYTES
        tables[segment >> 32][lo : lo + SEGMENT_BYTES] = np.frombuffer(part, np.uint8)
    return [t[: 1 << (b - 3)] for t, b in zip(tables, bits)]


def _dense(own: np.ndarray, seeds: np.ndarray, tables: list[np.ndarray], sizes: set[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, keys) where a shorter quote may stand, and (DENSE, places, hashes) where a longer one may start: every place is looked up."""
    h = np.zeros(len(own), np.uint64)
    for n in range(1, min(DENSE, len(own)) + 1):
        h = h[: len(own) - n + 1]
        h *= _STEP
        h += own[n - 1 :]
        if n in sizes or n == DENSE:
            keys = _keys(h, seeds[: len(h)], n, n < DENSE)
            at = _held(tables[0], keys)
            yield n, at, keys[at] if n < DENSE else h[at]


def _hits(codes: np.ndarray, begin: np.ndarray, seeds: np.ndarray, tables: list[np.ndarray], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, places, keys) where a quote of that length may stand, by rising length; beyond the first lengths only places where a quote may go on are looked up."""
    wanted, found, lo = set(sizes), {}, 0
    while lo < len(begin) - 1:
        hi = max(lo + 1, int(np.searchsorted(begin, begin[lo] + BLOCK, "right")) - 1)
        for n, at, keys in _dense(_numbers(codes[begin[lo] : begin[hi]]), np.repeat(seeds[lo:hi], np.diff(begin[lo : hi + 1])), tables, wanted):
            found.setdefault(n, []).append((at + begin[lo], keys))
        lo = hi
    for n in sorted(found):
        at, h = (np.concatenate(x) for x in zip(*found[n]))
        if n < DENSE:
            yield n, at, h
    if DENSE not in found:
        return
    own = np.repeat(seeds, np.diff(begin))[at]
    for n in range(DENSE, sizes[-1] + 1):
        if n > DENSE:
            inside = np.searchsorted(at, len(codes) - n, "right")
            at, h, own = at[:inside], h[:inside], own[:inside]
            h = h * _STEP + _numbers(codes[at + (n - 1)])
            if _level(n):
                on = _held(tables[1], _keys(h, own, n, False))
                at, h, own = at[on], h[on], own[on]
        if not len(at):
            return
        if n in wanted:
            keys = _keys(h, own, n, True)
            hit = _held(tables[1], keys)
            yield n, at[hit], keys[hit]


def _exact(codes: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n code points from each place as one number, n at most 3."""
    return sum(codes[at + i].astype(np.int64) << (21 * i) for i in range(n))


def _alike(codes: np.ndarray, a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Whether the n code points from places a are those from places b."""
    same = np.ones(len(a), bool)
    for i in range(n):
        same &= codes[a + i] == codes[b + i]
    return same


def _once(codes: np.ndarray, text: np.ndarray, at: np.ndarray, keys: np.ndarray, n: int) -> np.ndarray:
    """One of the places of each text that hold the same n code points: of those that fall into one cell the last stays, its like are dropped, the others go on."""
    left, kept, bits = np.arange(len(at), dtype=np.int32), [], min(CELLS, len(at).bit_length() + 2)
    cell = ((keys ^ (text.astype(np.uint64) * _CODE)) * _PROBES[0] >> np.uint64(64 - bits)).view(np.int64)
    last, short = np.empty(1 << bits, np.int32), n <= 3
    own = _exact(codes, at, n) if short else keys
    while len(left):
        mine = cell[left]
        last[mine] = left
        first = last[mine]
        won = first == left
        kept.append(left[won])
        left, first = left[~won], first[~won]
        same = (own[first] == own[left]) & (text[first] == text[left])
        if not short:
            same[same] = _alike(codes, at[left[same]], at[first[same]], n)
        left = left[~same]
    return np.sort(np.concatenate(kept)) if kept else left


def _counts(text: str, begin: np.ndarray, seeds: np.ndarray, tables: list[np.ndarray], sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(length, texts, places, edges, same) of runs that may be quotes, each run of a text once, in groups of one key that start at the edges; same: the run and the reference are those of the group's first."""
    codes = _codes(text)
    texts = np.repeat(np.arange(len(seeds), dtype=np.int32), np.diff(begin))
    for n, at, keys in _hits(codes, begin, seeds, tables, sizes):
        if not len(at):
            continue
        one = _once(codes, texts[at], at, keys, n)
        one = one[np.argsort(keys[one], kind="stable")]
        at, keys, own = at[one], keys[one], texts[at[one]]
        edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        first = np.repeat(edge, np.diff(np.append(edge, len(keys))))
        yield n, own, at, edge, (seeds[own] == seeds[own[first]]) & _alike(codes, at, at[first], n)


def counted(quotes: DataFrame, texts: DataFrame) -> DataFrame:
    """(quote_id, n, one): how many texts (text_id, ref, text) of its reference hold the words of a quote (quote_id, ref, quote), as ``containing`` compares them, and the smallest of them.

    Texts are read once and not exchanged: their places are looked up in a filter of the quotes and of their starts, and what may be a quote is counted by batches of texts. The counts
    meet the quotes by the quote itself, so what only seems to be one is dropped.
    """
    spark = quotes.sparkSession
    q = quotes.select("quote_id", "ref", T.database_words(F.col("quote")).alias("q")).where((F.trim("q") != "") & F.col("ref").isNotNull())
    q = stored(q, folder(spark, "quotes"))
    each = q.select("ref", "q").distinct()
    starts, whole, sizes = each.agg(F.countDistinct("ref", F.substring("q", 1, DENSE)), F.count(F.lit(1)), F.sort_array(F.collect_set(F.length("q")))).first()
    refs = each.select("ref").distinct()
    own = texts.where(F.col("ref").isNotNull() & F.col("text").isNotNull())
    if refs.limit(MAX_BROADCAST_ROWS + 1).count() <= MAX_BROADCAST_ROWS:  # texts of no quote's reference are not read through
        own = own.join(F.broadcast(refs), "ref", "left_semi")
    d = own.select("text_id", "ref", T.database_words(F.col("text")).alias("body"))
    shared = spark.sparkContext.broadcast(_filters(each, (starts, KEYS_EACH * whole)))
    kind = texts.schema["text_id"].dataType.simpleString()

    def look(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, field = {}, None

        def out() -> pa.RecordBatch:
            rows = list(zip(*((*k, *v) for k, v in held.items())))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.string()), pa.array(rows[1], pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], field.type)], ["ref", "q", "n", "one"])

        def add(ref: str, q: str, n: int, one: object) -> None:
            if (h := held.get((ref, q))) is None:
                held[ref, q] = [n, one]
            else:
                h[0], h[1] = h[0] + n, min(h[1], one)

        for b in batches:
            field, refs, ids = b.schema.field("text_id"), b.column("ref").to_pylist(), b.column("text_id").to_pylist()
            order = sorted(range(len(ids)), key=ids.__getitem__)
            rank = np.empty(len(ids), np.int64)
            rank[order] = np.arange(len(ids))
            for text, rows, begin, seeds in _blocks(b.column("ref"), b.column("body"), PART):
                for n, own, at, edge, same in _counts(text, begin, seeds, shared.value, sizes):
                    place = rank[rows[own]]
                    many, least = np.add.reduceat(same.astype(np.int64), edge), np.minimum.reduceat(np.where(same, place, len(ids)), edge)
                    for row, i, k, one in zip(rows[own[edge]].tolist(), at[edge].tolist(), many.tolist(), least.tolist()):
                        add(refs[row], text[i : i + n], k, ids[order[one]])
                    for i in np.flatnonzero(~same).tolist():  # other code points of the same key
                        add(refs[rows[own[i]]], text[at[i] : at[i] + n], 1, ids[rows[own[i]]])
                if len(held) >= MOST_HELD:
                    yield out()
        if held:
            yield out()

    found = d.mapInArrow(look, f"ref string, q string, n long, one {kind}").groupBy("ref", "q").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
    found = stored(found, folder(spark, "counts"))
    return q.join(found, ["ref", "q"]).groupBy("quote_id").agg(F.sum("n").alias("n"), F.min("one").alias("one"))
