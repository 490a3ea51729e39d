"""Ordered computations that stay distributed when one key holds a large share of the rows.

A plain window puts all rows of a key in one task. Here an ordered group is cut into chunks (time slices,
or ranges of the sort key), every chunk is processed on its own, and one summary row per chunk is carried
forward. The second step sees chunks, not rows, so its size is the number of slices of a key.
"""
from __future__ import annotations

import atexit
import contextlib
import json
import uuid
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from marketlens.session import checkpoint_dir

CHUNK = "_chunk"


def time_chunk(ts: str, seconds: int) -> Column:
    """Number of the time slice an instant or a date falls in; grows with time."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / seconds)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through the session's file systems; nothing once the session has ended."""
    context = spark.sparkContext
    if context._jsc is not None:
        folder = context._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)


#: Spark removes the shuffle files of an execution when it ends.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written meanwhile go as soon as each writing ends, and not when the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


def materialise(df: DataFrame) -> DataFrame:
    """Writes an intermediate result once to the shared checkpoint folder and reads it back.

    Used where a result is needed several times (sampling, chunks, carried rows): the work before it is done once,
    its lineage ends there, and the loss of an executor does not bring it back. Lazy results read the files, so they are deleted when the session's process ends,
    or by `forget`.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    with short_shuffles(spark):
        df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written._stage = path
    return written


def forget(*written: DataFrame) -> None:
    """Deletes results of `materialise` that nothing reads any more."""
    for df in written:
        remove(df.sparkSession, df._stage)


def dealt(df: DataFrame, rows: int = 1 << 19) -> DataFrame:
    """Written once, for models that go over it many times and keep each part in a task's memory: parts and their order stay, but those above `rows` rows are cut evenly.

    Models that draw samples by part thus see the same parts as without it, as long as these are not too large.
    """
    df = materialise(df.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}))
    last, most = df.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).agg(F.max("_part"), F.max("n")).first()
    if last is None:
        return df.drop("_part", "_row")
    cuts = -(-most // rows)
    place = F.col("_part") * cuts + F.pmod("_row", F.lit(cuts)).cast("int")
    return df.repartitionById((last + 1) * cuts, place).sortWithinPartitions("_row").drop("_part", "_row")


def carry_over(df: DataFrame, keys: Sequence[str], summary: dict[str, Column],
               combine: Callable[[str], Column] = F.sum) -> DataFrame:
    """One row per (keys, chunk) holding the summary of all strictly earlier chunks of the same key."""
    per_chunk = df.groupBy(*keys, CHUNK).agg(*[c.alias(n) for n, c in summary.items()])
    earlier = (Window.partitionBy(*keys).orderBy(CHUNK)
               .rowsBetween(Window.unboundedPreceding, -1))
    return per_chunk.select(*keys, CHUNK, *[combine(n).over(earlier).alias(n) for n in summary])


def range_chunks(df: DataFrame, order: Sequence[Column], chunks: int | None = None, sample: int | None = None, write: bool = True) -> DataFrame:
    """Adds a chunk number that grows with the sort key (ascending, all parts of the key together).

    The input is written once (not if `write` is false, for inputs that are cheap to read again: the sample then needs the sort key alone), then cut points come from a hash sample of keys. Chunks are twice the shuffle partitions by default, as the session
    sets these by the size of the data, and the sample 16 keys a chunk. Cut points only balance the chunks; results never depend on them. Including the tie-break column in `order` also splits long runs of equal values.
    """
    df = materialise(df) if write else df
    chunks = chunks or max(64, 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sample = sample or 16 * chunks
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    slot = F.pmod(F.xxhash64("k"), F.lit(sample))
    rows = (df.select(key.alias("k")).groupBy(slot.alias("slot"))
            .agg(F.min_by("k", F.xxhash64("k", F.lit(7))).alias("k"))
            .select("k.*").collect())
    rows = sorted(tuple(r) for r in rows if None not in tuple(r))
    step = max(1, len(rows) // chunks)
    cuts = rows[step::step] if len(rows) >= 2 * chunks else []
    if not cuts:
        return df.withColumn(CHUNK, F.lit(0))
    names = [f"k{i}" for i in range(len(order))]
    text = json.dumps([dict(zip(names, c)) for c in cuts], default=lambda v: v.isoformat() if hasattr(v, "isoformat") else str(v))
    cut_array = F.from_json(F.lit(text), ArrayType(df.select(key.alias("k")).schema[0].dataType))
    return df.withColumn(CHUNK, F.size(F.filter(cut_array, lambda s: s <= key)))


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[Column], measures: dict[str, Column],
                   seconds: int | None = None, ts: str | None = None, write: bool = True) -> DataFrame:
    """Adds inclusive running sums (columns named after `measures`) along `order` within `keys` (never NULL)."""
    chunked = (df.withColumn(CHUNK, time_chunk(ts, seconds)) if seconds
               else range_chunks(df, order, write=write))
    inputs = chunked.withColumns({f"_m_{n}": c for n, c in measures.items()})
    within = (Window.partitionBy(*keys, CHUNK).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = inputs.withColumns({f"_w_{n}": F.sum(f"_m_{n}").over(within) for n in measures})
    before = carry_over(inputs, keys, {f"_c_{n}": F.sum(f"_m_{n}") for n in measures})
    joined = local.join(before, [*keys, CHUNK], "left")
    totals = {n: F.coalesce(F.col(f"_w_{n}"), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) for n in measures}
    drop = [f"_{p}_{n}" for n in measures for p in "mwc"]
    return joined.withColumns(totals).drop(*drop, CHUNK)


def prefix_at(facts: DataFrame, instants: DataFrame, keys: Sequence[str], ts: str,
              measures: dict[str, Column], seconds: int = 86400) -> DataFrame:
    """Sums of `measures` over facts strictly before each instant; one row per distinct (keys, instant).

    Facts are first added up per (keys, ts) with map-side partial sums, and instants are made distinct, so
    a popular key costs its number of distinct instants, not its number of rows.
    """
    grains = facts.groupBy(*keys, ts).agg(*[F.sum(c).alias(n) for n, c in measures.items()])
    probes = (instants.select(*keys, ts).distinct()
              .select(*keys, ts, *[F.lit(None).alias(n) for n in measures], F.lit(0).alias("_side")))
    both = materialise(grains.withColumn("_side", F.lit(1)).unionByName(probes))
    summed = running_totals(both, keys, [F.col(ts), F.col("_side")],
                            {n: F.col(n) for n in measures}, seconds=seconds, ts=ts)
    return summed.filter("_side = 0").select(*keys, ts, *measures)


def asof_before(left: DataFrame, right: DataFrame, keys: Sequence[str], ts: str, right_ts: str,
                payload: Sequence[str], tie: str | None = None, inclusive: bool = False,
                seconds: int = 86400) -> DataFrame:
    """Latest right row strictly before (or up to, if inclusive) the left instant; NULL where there is none.

    Only one right row per (keys, instant) can win and only distinct left instants matter, so both sides
    are reduced before they meet. The winner inside a time slice comes from a window over the slice, the
    winner of earlier slices from one carried row per slice.
    """
    packed = F.struct(F.col(right_ts).alias("_at"), *[F.col(c) for c in payload])
    winner = F.max_by(packed, F.col(tie)) if tie else F.max(packed)
    usable = " and ".join(f"`{k}` is not null" for k in keys)
    facts = (right.filter(usable).filter(F.col(right_ts).isNotNull())
             .groupBy(*keys, F.col(right_ts).alias("_t")).agg(winner.alias("_hit"))
             .withColumn("_side", F.lit(0 if inclusive else 1)))
    probes = (left.filter(usable).filter(F.col(ts).isNotNull()).select(*keys, F.col(ts).alias("_t")).distinct()
              .withColumn("_hit", F.lit(None).cast(facts.schema["_hit"].dataType))
              .withColumn("_side", F.lit(1 if inclusive else 0)))
    both = materialise(facts.unionByName(probes)).withColumn(CHUNK, time_chunk("_t", seconds))
    within = (Window.partitionBy(*keys, CHUNK).orderBy("_t", "_side")
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = both.withColumn("_near", F.last("_hit", ignorenulls=True).over(within))
    far = carry_over(both, keys, {"_far": F.max("_hit")}, lambda n: F.last(n, ignorenulls=True))
    probe_side = 1 if inclusive else 0
    found = (local.filter(F.col("_side") == probe_side).join(far, [*keys, CHUNK], "left")
             .select(*keys, F.col("_t").alias(ts), F.coalesce("_near", "_far").alias("_hit")))
    joined = left.join(found, [*keys, ts], "left")
    return joined.select(*left.columns, F.col("_hit._at").alias(right_ts if right_ts not in left.columns else f"{right_ts}_asof"),
                         *[F.col(f"_hit.{c}").alias(c) for c in payload])


def with_total(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Adds the group size: the largest running count of the key."""
    totals = ranked.groupBy(*keys).agg(F.max("_cum").alias("_total"))
    return ranked.join(totals, list(keys)) if keys else ranked.withColumn("_total", totals.scalar())


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                    higher: bool = False) -> DataFrame:
    """Exact quantiles per key (linear interpolation, or the next higher value), without gathering a group.

    Values are counted first (partial sums on the map side), counts are accumulated chunk by chunk along
    the value, and only the rows at the wanted positions are kept.
    """
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_totals(counts, keys, [F.col("_v")], {"_cum": F.col("_n")})
    joined = with_total(ranked, keys)
    aggs = []
    for name, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        ends = {}
        for end, idx in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (idx < F.col("_cum")) & (idx >= F.col("_cum") - F.col("_n"))
            ends[end] = F.max(F.when(hit, F.col("_v")))
        frac = F.max(pos - F.floor(pos))
        low, high = ends["lo"].cast("double"), ends["hi"].cast("double")
        aggs.append((high if higher else low + (high - low) * frac).alias(name))
    return joined.groupBy(*keys).agg(*aggs)


def pick_rank(df: DataFrame, keys: Sequence[str], value: str, rank: Column, out: str) -> DataFrame:
    """The value at a 1-based rank that may depend on `_total`, the group size (order statistic)."""
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v"))
              .agg(F.count(F.lit(1)).alias("_n")))
    ranked = running_totals(counts, keys, [F.col("_v")], {"_cum": F.col("_n")})
    joined = with_total(ranked, keys)
    hit = (rank <= F.col("_cum")) & (rank > F.col("_cum") - F.col("_n"))
    return (joined.filter(hit).groupBy(*keys)
            .agg(F.max("_v").alias(out), F.max("_total").alias("n")))
