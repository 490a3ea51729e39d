"""Removal of long repeated byte strings by merging Burrows-Wheeler transforms of shards.

Every string of LENGTH bytes has an anchor, the first of its K-byte strings with the smallest hash, and equal strings have equal anchors at the
same place. The strings of one anchor lie in one segment of the text, so only segments whose anchors hash alike have to be compared, and
these are aligned at the anchor. Equal segments are counted, not compared.

The segments of an anchor come in shards. Each shard sorts its suffixes column by column, from the right, and keeps per column the symbols in
sorted order: its Burrows-Wheeler transform. Shards are merged without their texts: from column to column the interleave of the shards is
refined by a stable partition by the symbols that the transforms yield next, and the common prefix of neighbours is one more than the least
common prefix between their places before. Runs of neighbours with a common prefix of LENGTH are the repeated intervals.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, free_name, giving_back, text_blocks

LENGTH = 200
K = 32
#: K-byte strings in a LENGTH-byte string.
REACH = LENGTH - K + 1
#: Columns of an aligned segment; the anchor begins at column REACH - 1.
COLUMNS = 2 * (REACH - 1) + K
SHARD_ROWS = 8192
#: Segments merged at once, and the most that one anchor brings there; the strings of anchors with more are counted one by one.
MERGE_ROWS = 16384
OUTSIDE = 256


def byte_codes() -> np.ndarray:
    """A random-looking 64-bit number for each byte."""
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def mixed(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def string_hashes(x: np.ndarray, length: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Polynomial hash of every `length`-byte string of x, by doubling."""
    power, have, at = [pow(base, 1 << i, 1 << 64) for i in range(length.bit_length())], byte_codes()[x], 0
    total, done = None, 0
    for i in range(length.bit_length()):
        if length >> i & 1:
            size = len(x) - length + 1
            part = have[done:done + size]
            total = part if total is None else total * np.uint64(power[i]) + part
            done += 1 << i
        if i + 1 < length.bit_length():
            have = have[:-(1 << i)] * np.uint64(power[i]) + have[1 << i:]
    return mixed(total)


def window_minimum(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` neighbours, by doubling."""
    size, have = len(key) - width + 1, 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[:size], key[width - have:width - have + size])


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """Segments of all texts: text number, first string's place, strings, anchor's place in the segment, anchor hash, segment hash."""
    import xxhash

    joined = b"".join(texts)
    none = np.empty(0, dtype=np.int64)
    if len(joined) < LENGTH:
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    hashes = string_hashes(np.frombuffer(joined, dtype=np.uint8), K)
    # The place breaks ties, so the first is taken; it also names the anchor.
    place = (window_minimum((hashes >> np.uint64(32) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64), REACH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(sizes)
    at = np.arange(len(place))
    owner = np.repeat(np.arange(len(texts)), sizes)[:len(place)]
    at = at[at + LENGTH <= ends[owner]]
    if not len(at):
        return none, none, none, none, none.view(np.uint64), none.view(np.uint64)
    place, owner = place[at], owner[at]
    first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])
    count = np.diff(np.r_[first, len(at)])
    start, text, anchor = at[first], owner[first], place[first]
    view = memoryview(joined)
    segment = np.array([xxhash.xxh3_64_intdigest(view[s:s + n]) for s, n in zip(start.tolist(), (count + LENGTH - 1).tolist())], dtype=np.uint64)
    return text, start - (ends - sizes)[text], count, anchor - start, hashes[anchor], segment


def find_segments(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, loc, anchor, segment) of docs (doc_id, mark, text); loc packs the place, number of strings and anchor's place."""
    def run(batches: Iterator[pa.RecordBatch]):
        for part, texts in text_blocks(batches, "text"):
            text, start, count, offset, anchor, segment = anchors(texts)
            loc, owner = start << 32 | count << 24 | offset << 16, pa.array(text)
            yield pa.RecordBatch.from_arrays([part.column(0).take(owner), part.column(1).take(owner), pa.array(loc), pa.array(anchor.view(np.int64)), pa.array(segment.view(np.int64))], names=["doc_id", "mark", "loc", "anchor", "segment"])

    return docs.mapInArrow(giving_back(run), "doc_id long, mark long, loc long, anchor long, segment long")


def unpacked(name: str) -> F.Column:
    shift, mask = {"start": (32, 0x7FFFFFFF), "count": (24, 0xFF), "offset": (16, 0xFF)}[name]
    return F.shiftrightunsigned("loc", shift).bitwiseAND(F.lit(mask))


def aligned(rows: list[tuple[int, bytes]]) -> np.ndarray:
    """One row per segment (anchor's place, bytes), anchors below each other; OUTSIDE where there is no byte."""
    out = np.full((len(rows), COLUMNS), OUTSIDE, dtype=np.uint16)
    for i, (offset, raw) in enumerate(rows):
        begin = REACH - 1 - offset
        out[i, begin:begin + len(raw)] = np.frombuffer(raw, dtype=np.uint8)
    return out


def partition(symbols: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Stable order by group, then symbol; both fit into 16 bits, so both passes are radix sorts."""
    first = np.argsort(symbols, kind="stable")
    return first[np.argsort(group[first], kind="stable")]


def shard_transform(block: np.ndarray, group: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Per column: the symbols in the sorted order of the suffixes that begin one column further right, and that column's own order.

    Rows of a shard come by group.
    """
    order = np.arange(len(block))
    symbols, orders = [None] * COLUMNS, [None] * COLUMNS
    for c in range(COLUMNS - 1, -1, -1):
        symbols[c] = block[order, c]
        order = order[partition(symbols[c], group)]
        orders[c] = order
    return symbols, orders


def merge_transforms(shards: list[tuple[list[np.ndarray], list[np.ndarray]]], groups: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Yields (column, shard of each rank, row in its shard, common prefix with the rank before), from the last column to the first."""
    sizes = [len(g) for g in groups]
    start = partition(np.repeat(np.arange(len(groups)), sizes).astype(np.uint16), np.concatenate(groups))
    shard = np.repeat(np.arange(len(groups)), sizes)[start]
    group = np.sort(np.concatenate(groups))
    common = np.zeros(len(shard), dtype=np.int64)
    symbols = np.empty(len(shard), dtype=np.uint16)
    for c in range(COLUMNS - 1, -1, -1):
        of = [np.flatnonzero(shard == s) for s in range(len(shards))]
        for s, ranks in enumerate(of):
            symbols[ranks] = shards[s][0][c]  # the transform yields its symbols in the order of its own ranks
        move = partition(symbols, group)
        before, after = move[:-1], move[1:]
        same = (group[before] == group[after]) & (symbols[before] == symbols[after]) & (symbols[after] != OUTSIDE)
        now = np.zeros(len(shard), dtype=np.int64)
        if same.any():
            # Least common prefix between the two old places; the old order of equal symbols is kept, so before < after.
            spans = np.stack([before[same] + 1, after[same] + 1], axis=1).ravel()
            now[1:][same] = np.minimum.reduceat(np.r_[common, 0], spans)[::2] + 1
        shard, common = shard[move], now
        row = np.empty(len(shard), dtype=np.int64)
        for s in range(len(shards)):
            row[shard == s] = shards[s][1][c]
        yield c, shard, row, common


def repeated_runs(rows: list[tuple[int, int, int, bytes]]) -> list[list[tuple[int, int]]]:
    """For segments (group, strings, anchor's place, bytes), sorted by group: runs [first, last] of strings that another segment of the group has."""
    groups = np.unique([r[0] for r in rows], return_inverse=True)[1].astype(np.uint16)
    cuts = range(0, len(rows), SHARD_ROWS)
    shards = [shard_transform(aligned([r[2:] for r in rows[a:a + SHARD_ROWS]]), groups[a:a + SHARD_ROWS]) for a in cuts]
    begin = np.array([REACH - 1 - r[2] for r in rows])
    count = np.array([r[1] for r in rows])
    hit = np.zeros((len(rows), REACH), dtype=bool)
    for c, shard, row, common in merge_transforms(shards, [groups[a:a + SHARD_ROWS] for a in cuts]):
        if c >= REACH:
            continue
        long_ = common >= LENGTH
        long_[:-1] |= long_[1:]
        found = (shard * SHARD_ROWS + row)[long_]
        at = c - begin[found]
        inside = (at >= 0) & (at < count[found])
        hit[found[inside], at[inside]] = True
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    return [list(zip(np.flatnonzero(e == 1).tolist(), (np.flatnonzero(e == -1) - 1).tolist())) for e in edge]


def merge_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges rows (anchor, segment, n, loc parts, bytes), which come by anchor, in batches of whole anchors."""
    held: list[dict] = []

    def flush(rows):
        runs = repeated_runs([(r["anchor"], r["count"], r["offset"], r["bytes"]) for r in rows])
        out = [(r["anchor"], r["segment"], [{"first": a, "last": b} for a, b in x]) for r, x in zip(rows, runs) if x and r["n"] == 1]
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        a, s, x = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(s, pa.int64()), pa.array(x, kind)], names=["anchor", "segment", "runs"])

    for batch in batches:
        for row in batch.to_pylist():
            if len(held) >= MERGE_ROWS and row["anchor"] != held[-1]["anchor"]:
                yield flush(held)
                held = []
            held.append(row)
    if held:
        yield flush(held)


def counted_runs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The same result for anchors with too many segments for one merge: their strings are counted by 128-bit hash, spread over all tasks."""
    def strings(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                raws = part.column(part.schema.get_field_index("bytes")).to_pylist()
                counts = np.array([len(r) - LENGTH + 1 for r in raws])
                x = np.frombuffer(b"".join(raws), dtype=np.uint8)
                row = np.repeat(np.arange(len(raws)), counts)
                place = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = place + np.repeat(np.cumsum(counts + LENGTH - 1) - (counts + LENGTH - 1), counts)
                pick = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[pa.array(string_hashes(x, LENGTH, b)[at].view(np.int64)) for b in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)], *[part.column(i).take(pick) for i in range(3)], pa.array(place.astype(np.int32))],
                                                 names=["h1", "h2", "anchor", "segment", "n", "place"])

    found = scratch.table("strings", rows.select("anchor", "segment", "n", "bytes").mapInArrow(giving_back(strings), "h1 long, h2 long, anchor long, segment long, n long, place int"))
    often = found.groupBy("h1", "h2").agg(F.sum("n").alias("times")).filter("times > 1")
    return (found.filter("n = 1").join(often, ["h1", "h2"]).groupBy("anchor", "segment")
            .agg(F.collect_list(F.struct(F.col("place").alias("first"), F.col("place").alias("last"))).alias("runs")))  # at most REACH


def repeated_spans(docs: DataFrame, scratch: Scratch, merge_rows: int = MERGE_ROWS) -> DataFrame:
    """(doc_id, mark, spans) of docs (doc_id, mark, text): spans [from, to) of repeated bytes, not yet united; texts without any are left out."""
    found = scratch.table("segments", find_segments(docs))
    # Written first, so that the join deals both sides out itself and can split the rows of a frequent anchor.
    twice = scratch.table("twice", found.groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"))
    alike = scratch.table("alike", found.join(twice, "anchor"))
    scratch.drop("segments", "twice")
    kinds = alike.groupBy("anchor", "segment").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "mark", "loc")).alias("rep"))
    kinds = scratch.table("kinds", kinds)
    several = scratch.table("several", kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    compared = scratch.table("compared", kinds.join(several, "anchor").select("anchor", "segment", "n", "kinds", "rep.*"))
    asked = compared.select("doc_id", "mark", F.struct("anchor", "segment", "n", "kinds", unpacked("start").cast("int").alias("start"), unpacked("count").cast("int").alias("count"), unpacked("offset").cast("int").alias("offset")).alias("ask"))
    asked = asked.groupBy("doc_id", "mark").agg(F.collect_list("ask").alias("asks"))  # at most one per byte of one text
    cut = (docs.join(asked, ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select(F.col("text"), F.explode("asks").alias("ask"))
           .select("ask.*", F.substring("text", F.col("ask.start") + 1, F.col("ask.count") + (LENGTH - 1)).alias("bytes")).drop("start"))
    largest = compared.agg(F.max("kinds")).first()[0] or 0
    many = F.col("kinds") > merge_rows
    if largest > merge_rows:
        cut = scratch.table("cut", cut)
    few = cut.filter(~many).repartition("anchor").sortWithinPartitions("anchor")
    runs = few.mapInArrow(giving_back(merge_partition), "anchor long, segment long, runs array<struct<first:int,last:int>>")
    if largest > merge_rows:
        runs = runs.unionByName(counted_runs(cut.filter(many), scratch))
    whole = kinds.filter("n > 1").select("anchor", "segment", F.lit(None).cast("array<struct<first:int,last:int>>").alias("runs"))
    results = scratch.table("runs", runs.unionByName(whole))
    start, count = unpacked("start").cast("int"), unpacked("count").cast("int")
    all_ = F.array(F.struct(F.lit(0).alias("first"), (count - 1).alias("last")))
    spans = F.transform(F.coalesce("runs", all_), lambda r: F.struct((start + r["first"]).alias("from"), (start + r["last"] + LENGTH).alias("to")))
    made = alike.join(results, ["anchor", "segment"]).select("doc_id", "mark", F.explode(spans).alias("span"))
    out = scratch.table("spans", made.groupBy("doc_id", "mark").agg(F.collect_list("span").alias("spans")))
    scratch.drop("alike", "kinds", "several", "compared", "cut", "strings", "runs")
    return out


def united(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Sorted spans without overlap or contact."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(raw: bytes, spans: list[tuple[int, int]], whole: bool = False) -> bytes:
    """The bytes outside the spans; if `whole`, without the rest of a character that a span cuts apart."""
    edges = [0, *[e for s in spans for e in s], len(raw)]
    parts = [raw[a:b] for a, b in zip(edges[::2], edges[1::2])]
    return b"".join(p.decode("utf-8", "ignore").encode() for p in parts) if whole else b"".join(parts)


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None, merge_rows: int = MERGE_ROWS, whole: bool = False) -> DataFrame:
    """The columns `keep`, removed (spans [from, to) of bytes) and kept_bytes of each row; these two get underscores in front where `keep` has their names.

    A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same text or another; all strings are judged on the
    input. Null texts are empty; texts shorter than LENGTH lose nothing. Repeated rows are copies of each other: each loses all that is long
    enough. Rows with one id and different texts are told apart by a 64-bit hash of the text, rows without an id by two such hashes. An empty table gives an empty
    result. With `whole`, kept_bytes has whole characters only.
    """
    keep = docs.columns if keep is None else keep
    names = {c: f"in_{i}" for i, c in enumerate(keep)}
    body = F.col(f"`{text}`")
    inner = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()], F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.xxhash64(F.lit("no id"), body)).alias("doc_id"),
                        F.xxhash64(body).alias("mark"), F.coalesce(body.cast("binary"), F.lit(b"")).alias("text"))
    scratch = Scratch(docs.sparkSession)
    spans = repeated_spans(inner.select("doc_id", "mark", "text"), scratch, merge_rows)
    joined = inner.join(spans, ["doc_id", "mark"], "left").select(*names.values(), "spans", "text")

    def cut(batches):
        for part, texts in text_blocks(batches, "text", 1 << 20):
            found = [united(s) for s in part.column(len(names)).to_pylist()]
            pairs = pa.array([[{"from": a, "to": b} for a, b in s] for s in found], pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*part.columns[:len(names)], pairs, pa.array([without(t, s, whole) for t, s in zip(texts, found)], pa.binary())], names=[*names.values(), "removed", "kept_bytes"])

    fields = "".join(f"{n} {docs.schema[c].dataType.simpleString()}, " for c, n in names.items())
    made = joined.mapInArrow(giving_back(cut), f"{fields}removed array<struct<from:int,to:int>>, kept_bytes binary")
    return made.select(*[F.col(n).alias(c) for c, n in names.items()], *[F.col(c).alias(free_name(c, keep)) for c in ("removed", "kept_bytes")])


def shortened(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents with the repeats taken out of their texts; a character that a span cuts apart goes as a whole. Null texts stay null.

    Columns keep their names and order, whatever these are.
    """
    names = {c: f"own_{i}" for i, c in enumerate(docs.columns)}
    inner = docs.toDF(*names.values())
    inner = inner.withColumn("was_null", inner[names[text]].isNull())
    made = remove_repeats(inner, names[text], names[doc_id], keep=["was_null", *[n for c, n in names.items() if c != text]], whole=True)
    return made.select(*[F.when(~F.col("was_null"), F.col("kept_bytes").cast("string")).alias(c) if c == text else F.col(n).alias(c) for c, n in names.items()])
