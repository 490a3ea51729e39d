"""Near duplicates by bottom-k sketches of word shingles.

One hash function gives each distinct shingle a value; a text's sketch is its k smallest values. Texts with equal sets form one class and
count once. Inverted lists of retained values give candidate classes: the values of a sketch are ordered from rare to frequent, and only as many of
the rarest are listed as two similar sketches can't both miss. Of each candidate pair the sketch of the union estimates the similarity,
and what passes is confirmed on full sets.

Long lists, of a passage that many texts share or of a large group of copies, are not paired out. Their members are first linked in stars and
chains; lists whose members are then not yet all connected go through the same listing once more, on full sets, where the pairs
that still can be similar are few, and pairs within a component are left out.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, free_name, giving_back, map_texts

WORDS = 5
K = 64
#: Similarity in percent, if none is given.
PERCENT = 85
#: Chance of missing a similar pair that the number of shared values is set for.
MISS = 1e-8
#: Lists up to this length are paired out.
SHORT_LIST = 32
CHUNK = 1000
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mixed(z: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values (a bijection)."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_values(text: bytes) -> np.ndarray:
    """Sorted distinct 63-bit hash values of the text's shingles: of WORDS words, or of all where there are fewer; none without a word."""
    import xxhash

    words = text.lower().split()  # both know ASCII only: A-Z, and the white space of the word pattern
    if not words:
        return np.empty(0, dtype=np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), dtype=np.uint64)
    size = min(WORDS, len(h))
    total = np.full(len(h) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        total += mixed(h[i:len(h) - size + 1 + i] + MULTIPLIERS[i]) * MULTIPLIERS[i]
    return np.unique(mixed(total) >> np.uint64(1))  # 63 bits, so that signed order is the same


def sketches(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_shingles, a 128-bit key of the whole set, sketch (the K smallest values, ascending, as signed numbers)."""
    def make(texts):
        import xxhash

        sets = [shingle_values(t) for t in texts]
        keys = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
        return [[len(s) for s in sets], keys, [s[:K].view(np.int64).tolist() for s in sets]]

    return map_texts(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), "text", "n_shingles long, set_key binary, sketch array<long>", make, ["doc_id"])


def least_shared(percent: int) -> int:
    """Of the K smallest values of a union, similar texts share percent of K or more on average, and fewer than this with a chance below MISS."""
    p, below, s = percent / 100, 0.0, 0
    while s < K and (below := below + math.comb(K, s) * p ** s * (1 - p) ** (K - s)) <= MISS:
        s += 1
    return s


def must_share(n: int, percent: int = PERCENT) -> int:
    """Retained values that a text of n shingles shares with any similar text's sketch; where sets fit into sketches this is exact."""
    return least_shared(percent) if n >= K else max(1, min(-(-percent * n // 100), K + (-(100 - percent) * n // percent)))


def estimates(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose similarity, estimated from the K smallest values of the union of both sketches, may reach the bound."""
    a, b = (classes.select(F.col("cid").alias(x), F.col("sketch").alias(f"s{x}")) for x in "ab")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, K)
    shared = F.size(F.array_intersect(union, F.array_intersect("sa", "sb")))
    return pairs.join(a, "a").join(b, "b").filter(shared * K >= least_shared(percent) * F.size(union)).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that are similar by their full sets."""
    a, b = (sets.select(F.col("cid").alias(x), F.col("values").alias(f"s{x}")) for x in "ab")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):  # one pair of sets at a time; they stay in the batch's memory
                x, y = (np.frombuffer(s.as_buffer(), dtype=np.uint64) for s in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(giving_back(check), "a long, b long")


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(cid, root) of all nodes of `edges` (a, b): root is the smallest number reachable; nodes that are roots are left out.

    Each round hangs the larger neighbours of a node on its smallest one, then the node itself and its smaller ones; the number of rounds grows with
    the logarithm of the longest chain. Minima are pre-aggregated, so a hub's neighbours never meet in one task.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    before, i = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.col("u"), F.col("v"))).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now = scratch.table(f"{name}{i}", small)
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003)).first())
        if i:
            scratch.drop(f"{name}{i - 1}")
        if state == before:
            return now.select(F.col("u").alias("cid"), F.col("v").alias("root"))
        before, i = state, i + 1


def similar_sizes(percent: int) -> F.Column:
    """The smaller set of x and y comes first and is large enough to reach the similarity."""
    return ((F.col("x.n") < F.col("y.n")) | ((F.col("x.n") == F.col("y.n")) & (F.col("x.cid") < F.col("y.cid")))) & (100 * F.col("x.n") >= percent * F.col("y.n"))


def ordered_pair() -> list[F.Column]:
    return [F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")]


def listed(classes: DataFrame, scratch: Scratch, percent: int) -> DataFrame:
    """Inverted lists (v, cid, n, held): of each sketch the rarest values that it can't miss to share, where two classes or more list them."""
    limits = F.lit([0, *[min(n, K) - must_share(n, percent) + 1 for n in range(1, K + 1)]])
    values = classes.select("cid", "n", F.explode("sketch").alias("v"))
    # Counts are written first, so that the join deals both sides out itself and can split the rows of a frequent value.
    common = scratch.table("common", values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"))
    shared = values.join(common, "v").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("s"))  # at most K values
    held = F.least("n", F.lit(K)).cast("int")
    # Values of one class only are the rarest and use up places first.
    places = F.element_at(limits, held + 1) - (held - F.size("s"))
    entries = shared.filter(places > 0).select("cid", "n", F.explode(F.slice("s", F.lit(1), F.greatest(places, F.lit(0)))).alias("e")).select("e.v", "cid", "n")
    entries = scratch.table("entries", entries)
    held_by = scratch.table("held", entries.groupBy("v").agg(F.count("*").alias("held")).filter("held > 1"))
    return entries.join(held_by, "v")


def star_pairs(lists: DataFrame, scratch: Scratch) -> DataFrame:
    """Pairs of each member of a long list with one hub, and of neighbours by set size in chunks of about CHUNK members.

    The hub is the member that most long lists hold: where texts are edited copies of one, each edit drops out of lists, so the least edited one is taken.
    """
    often = lists.groupBy("cid").agg(F.count("*").alias("lists"))
    hub = lists.join(often, "cid").groupBy("v").agg(F.max(F.struct("lists", (-F.col("cid")).alias("c"))).alias("hub")).select("v", (-F.col("hub.c")).alias("hub"))
    hub = scratch.table("hubs", hub)
    stars = lists.join(hub, "v").filter("cid <> hub").select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"))
    chunk = F.pmod(F.xxhash64("cid"), F.ceil(F.col("held") / CHUNK))
    chain = lists.withColumn("c", chunk).withColumn("next", F.lead("cid").over(Window.partitionBy("v", "c").orderBy("n", "cid")))
    chains = chain.filter("next is not null").select(F.least("cid", "next").alias("a"), F.greatest("cid", "next").alias("b"))
    return stars.unionByName(chains)


def full_pairs(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs of members (cid, root) of different components that can be similar: they share one of the rarest shingles that a similar
    text can't miss, and behind it enough shingles are left in both. No pair that is similar is missed."""
    def values(batches):
        for batch in batches:
            arrays = [np.frombuffer(x, dtype=np.int64) for x in batch.column(2).to_pylist()]
            offsets = np.cumsum([0, *map(len, arrays)])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(arrays)))], names=["cid", "root", "s"])

    rows = (members.join(sets, "cid").select("cid", "root", "values").mapInArrow(giving_back(values), "cid long, root long, s array<long>")
            .select("cid", "root", F.size("s").cast("long").alias("n"), F.explode("s").alias("v")))
    common = rows.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1")
    own = Window.partitionBy("cid", "n")  # one text's shingles
    ranked = rows.join(common, "v").select("*", (F.row_number().over(own.orderBy("df", "v")) + F.col("n") - F.count("*").over(own)).alias("place"))
    entries = ranked.filter(100 * (F.col("place") - 1) <= (100 - percent) * F.col("n")).select("v", "cid", "root", "n", "place")
    overlap = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place")) + 1
    enough = (100 + percent) * overlap >= percent * (F.col("x.n") + F.col("y.n"))
    on = (F.col("x.v") == F.col("y.v")) & (F.col("x.root") != F.col("y.root")) & similar_sizes(percent) & enough
    return entries.alias("x").join(entries.alias("y"), on).select(*ordered_pair()).distinct()


def keyed_sets(texts: list[bytes]) -> list[list[bytes]]:
    import xxhash

    sets = [shingle_values(t).tobytes() for t in texts]
    return [sets, [xxhash.xxh3_128_digest(s) for s in sets]]


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. Texts are similar from `percent` of shared shingles on.

    Null, empty and wordless texts have no shingles and are linked with nothing. Repeated rows are copies of each other and share a component; of
    rows with the same id and text each says the same; where texts differ, each row says what its text is linked with. A null id is linked with nothing, and its component is null and kept. An empty table gives an
    empty result; other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.table("rows", sketches(docs, doc_id, text))
    usable = rows.filter("doc_id is not null and n_shingles > 0")
    classes = scratch.table("classes", usable.groupBy("set_key").agg(F.min("doc_id").alias("cid"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch")))
    lists = scratch.table("lists", listed(classes, scratch, percent))
    short, long_ = lists.filter(F.col("held") <= SHORT_LIST), lists.filter(F.col("held") > SHORT_LIST)
    near = short.alias("x").join(short.alias("y"), (F.col("x.v") == F.col("y.v")) & similar_sizes(percent)).select(*ordered_pair())
    pairs = scratch.table("pairs", estimates(near.unionByName(star_pairs(long_, scratch)).distinct(), classes, percent))
    ids = pairs.select(F.explode(F.array("a", "b")).alias("cid")).unionByName(long_.select("cid")).distinct()
    texts = docs.select(F.col(doc_id).cast("long").alias("cid"), F.col(text).alias("text")).join(ids, "cid")
    sets = map_texts(texts, "text", "values binary, set_key binary", keyed_sets, ["cid"])
    # An id whose rows have different texts can stand for several classes; each has its own set.
    sets = scratch.table("sets", classes.select("cid", "set_key").join(sets, ["cid", "set_key"]).dropDuplicates(["cid", "set_key"]).select("cid", "values"))
    links = scratch.table("links", confirmed(pairs, sets, percent))
    first = components(links, scratch, "first")
    labelled = long_.join(first, "cid", "left").select("v", "cid", F.coalesce("root", "cid").alias("root"))
    open_ = labelled.groupBy("v").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    members = scratch.table("members", labelled.join(open_, "v").select("cid", "root").distinct())
    more = confirmed(scratch.table("rest", estimates(full_pairs(members, sets, percent), classes, percent)), sets, percent)
    merged = first.select(F.col("cid").alias("a"), F.col("root").alias("b")).unionByName(more)
    roots = components(merged, scratch, "last")
    known = scratch.table("components", classes.join(roots, "cid", "left").select("set_key", F.coalesce("root", "cid").alias("root")))
    scratch.drop("classes", "common", "entries", "held", "hubs", "lists", "pairs", "sets", "links", "members", "rest")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id"))
    out = rows.join(known, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.select("*", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One document of each component, with all its columns; of rows with the same id the one with the smallest text. Rows without an id stay."""
    found = near_duplicates(docs, doc_id, text, percent).filter("doc_id is not null")
    name = free_name("gone", docs.columns)
    gone = found.filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    left = docs.join(gone, docs[doc_id].cast("long") == F.col(name), "left_anti")
    if found.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
        return left
    rank = free_name("rank", docs.columns)
    first = F.row_number().over(Window.partitionBy(docs[doc_id]).orderBy(docs[text]))
    return left.withColumn(rank, first).filter((F.col(rank) == 1) | docs[doc_id].isNull()).drop(rank)
