"""Document fingerprints: bottom-k sketches of shingle hashes, in column expressions only.

A fingerprint is the K smallest distinct hashes of a text's shingles, as a hex string. Fingerprints of parts merge into that of the whole; two of them estimate
resemblance and containment, one the number of distinct shingles.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.llm.common import free_name

WORDS = 5
K = 64
BITS = 48
DIGITS = BITS // 4
#: Square root of the number of ranges of ids that are ordered apart from each other; their largest ids are broadcast.
SIDE = 64


def word_hashes(text: Column) -> Column:
    """Hash of each word; words are the runs of other characters than ASCII white space."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(words: Column) -> Column:
    """BITS-bit hashes of the runs of WORDS words, of all words where there are fewer; empty without a word. `words` should be a plain column."""
    n = F.size(words)
    runs = F.transform(F.sequence(F.lit(1), n - (WORDS - 1)), lambda i: F.xxhash64(*[F.get(words, i + (j - 1)) for j in range(WORDS)]))
    short = F.array(F.xxhash64(words))
    hashes = F.when(n >= WORDS, runs).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))
    return F.transform(hashes, lambda h: F.shiftrightunsigned(h, 64 - BITS))


def bottom(hashes: Column, k: int = K) -> Column:
    """The sketch of an array of hashes: its k smallest distinct values, ascending."""
    return F.slice(F.array_sort(F.array_distinct(hashes)), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Adds the sketch of a text column; word hashes stand in a column of their own, as else each shingle would make them anew."""
    words = free_name("words", [*df.columns, name])
    return df.withColumn(words, word_hashes(F.coalesce(F.col(text), F.lit("")))).withColumn(name, bottom(shingle_hashes(F.col(words)), k)).drop(words)


def to_string(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), DIGITS, "0"))), "")


def from_string(fingerprint: Column) -> Column:
    count = (F.length(fingerprint) / DIGITS).cast("int")
    digits = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.conv(F.substr(fingerprint, i * DIGITS + 1, F.lit(DIGITS)), 16, 10).cast("bigint"))
    return F.when(count > 0, digits).otherwise(F.array().cast("array<bigint>"))


def merged(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of both texts' shingles."""
    return F.slice(F.array_sort(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's sketch that both sketches hold: estimates common shingles over all. Two empty sketches are alike: 1."""
    union = merged(a, b, k)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    """Exact below k values, else (k - 1) / the k-th smallest hash as a share of the hash range."""
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) * F.lit(float(1 << BITS)) / (F.get(sketch, F.lit(k - 1)) + 1))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has: resemblance * shingles of the union / shingles of a, at most 1."""
    share = resemblance(a, b, k) * distinct_shingles(merged(a, b, k), k) / distinct_shingles(a, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), share))


def merge_groups(df: DataFrame, keys: Sequence[str], sketch: str, k: int = K) -> DataFrame:
    """One merged sketch per group of rows; each task cuts a group to k values before the shuffle. Null sketches add nothing."""
    values = df.select(*keys, F.explode(sketch).alias("_h")).distinct()
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h"))
    return values.withColumn("_r", rank).filter(F.col("_r") <= k).groupBy(*keys).agg(F.array_sort(F.collect_list("_h")).alias(sketch))


def id_range(docs: DataFrame) -> Column:
    """Number of the range of an id, from 0: how many cut points are not above it, looked up in two steps of SIDE comparisons."""
    shares = F.array(*[F.lit(i / (SIDE * SIDE)) for i in range(1, SIDE * SIDE)])
    cuts = docs.agg(F.percentile_approx("id", shares, 8 * SIDE * SIDE)).first()[0] or []
    blocks = [cuts[i:i + SIDE] for i in range(0, len(cuts), SIDE)]
    firsts, blocks = (F.from_json(F.lit(str(x)), t) for x, t in (([b[0] for b in blocks], "array<bigint>"), (blocks, "array<array<bigint>>")))

    def not_above(points: Column) -> Column:
        return F.size(F.filter(points, lambda c: c <= F.col("id")))

    block = not_above(firsts)
    return F.when(block > 0, (block - 1) * SIDE + not_above(F.get(blocks, block - 1))).otherwise(0).cast("long")


def with_next(docs: DataFrame) -> DataFrame:
    """Rows (id, text) with the sketch of each and the text and sketch of the next row by descending id; after the last comes the first.

    Ids are cut at approximate quantiles into SIDE * SIDE ranges, so these are alike in rows however ids are spread; rows without an id come last, in as many
    ranges of a hash of their text. Each range gets one guest, the first row of the range behind it (the last range that of all), so the rows of a range
    find their next ones among themselves. Equal ids are ordered by the hash.
    """
    hashed = docs.withColumn("hash", F.xxhash64("text"))
    own = hashed.withColumn("span", F.when(F.col("id").isNotNull(), id_range(hashed)).otherwise(-1 - SIDE * SIDE // 2 - F.shiftright("hash", 64 - (SIDE * SIDE).bit_length() + 1)))
    # At most 2 * SIDE * SIDE + 1 rows: one window and a broadcast suffice.
    tops = own.groupBy("span").agg(F.struct(F.max("id").alias("id"), F.when(F.max("id").isNull(), F.min("hash")).alias("hash")).alias("top"))
    order = Window.partitionBy(F.lit(0)).orderBy(F.desc("span"))
    all_ = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    guests = tops.select(F.col("span").alias("host"), F.coalesce(F.lead(F.struct("top", "span")).over(order), F.first(F.struct("top", "span")).over(all_)).alias("g")).select("host", F.col("g.top").alias("top"), F.col("g.span").alias("from"))
    seen = own.join(F.broadcast(guests), (F.col("span") == F.col("from")) & ((F.col("id") == F.col("top.id")) | (F.col("id").isNull() & (F.col("hash") == F.col("top.hash")))), "left")
    places = F.when(F.col("host").isNull(), F.array(F.struct(F.col("span"), F.lit(False).alias("guest")))).otherwise(F.array(F.struct(F.col("span"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("span"), F.lit(True).alias("guest"))))
    dealt = seen.select("id", "hash", "text", F.explode(places).alias("p")).select("id", "hash", "text", "p.*").repartition("span")
    sketched = with_sketch(dealt, "text", "sketch")
    follow = Window.partitionBy("span").orderBy("guest", F.desc_nulls_last("id"), "hash")
    return sketched.select("*", F.lead("text").over(follow).alias("next_text"), F.lead("sketch").over(follow).alias("next_sketch")).filter("not guest").drop("guest", "span", "hash")


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null texts are empty: their fingerprint is the empty string, and two empty texts are alike (1), an empty and another one not (0). A table of one row has that
    row as its own next. Repeated rows get a row each; an empty table gives an empty result; other columns are not read.
    """
    inner = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = with_next(inner).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    # left() counts code points
    rows = rows.withColumn("edited", F.concat(F.left("text", F.col("n_chars").cast("int") - half), F.left("next_text", half)))
    rows = with_sketch(rows.drop("text", "next_text"), "edited", "edited_sketch")
    return rows.select(F.col("id").alias("doc_id"), "n_chars", F.sha2("edited", 256).alias("edited_sha256"), to_string(F.col("sketch")).alias("fingerprint"), to_string(F.col("edited_sketch")).alias("edited_fingerprint"),
                       resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch")).alias("near_next"))
