"""Helpers of the corpus operators: shared scratch tables, document blocks, free column names."""
from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.session import checkpoint_dir

#: One block holds about this many bytes of text; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20
#: A task keeps the ids of at most so many distinct words.
CACHE_WORDS = 200_000
#: A space that white space precedes and no other character follows: here words can't be cut apart at spaces.
UNEVEN_SPACE = re.compile(r"\s (?!\S)")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(name: str, taken: Iterable[str]) -> str:
    """`name`, with underscores put in front until no column of the input has it (names ignore case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = f"_{name}"
    return name


#: Bytes as terms hold them: A-Z lower-cased, all else that is not a digit, a letter or beyond ASCII a space.
TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
#: Rows of a query set, such as benchmark items, are met by all documents in blocks of about this many bytes of text.
ITEM_BYTES = 1 << 20


def plain_terms(raw: bytes) -> list[bytes]:
    """The maximal runs of digits, ASCII letters (A-Z lower-cased) and characters beyond ASCII."""
    return raw.translate(TERM_BYTES).split()


def item_blocks(items: DataFrame, text: str, size: int = ITEM_BYTES) -> list[DataFrame]:
    """Cuts a query set into parts of about `size` bytes of text, each small enough for the driver and every task; at least one part."""
    total = items.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(1, -(-total // size))
    return [items.filter(F.pmod(F.xxhash64(*items.columns), F.lit(parts)) == i) for i in range(parts)]


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the documents that no model may learn from; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


class Scratch:
    """Intermediate tables of one operator call, in the folder that all executors share.

    A written table ends lineage, so the loss of an executor does not bring the work before it back. `drop` deletes what is
    no longer read; what a lazy result still reads goes when the session ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{checkpoint_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
        atexit.register(self.drop)

    def table(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        context = self.spark.sparkContext
        if context._jsc is None:  # the session has ended
            return
        for name in names or ("",):
            path = context._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def by_spaced_words(ids: Callable[[str], bytes]) -> Callable[[str], bytes]:
    """An encoder that keeps the ids of words for their next occurrence.

    A text is cut before the spaces between words, where no match of a byte-level vocabulary's split pattern runs on. Texts with uneven white
    space are encoded whole.
    """
    known: dict[str, bytes] = {}

    def encode(text: str) -> bytes:
        if UNEVEN_SPACE.search(text):
            return ids(text)
        first, *words = text.split(" ")
        out = [ids(first)]
        for word in words:
            got = known.get(word)
            if got is None:
                if len(known) >= CACHE_WORDS:
                    known.clear()
                got = ids(f" {word}")
                if len(word) < 64:
                    known[word] = got
            out.append(got)
        return b"".join(out)

    return encode


def giving_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that ends by giving freed memory back to the system: workers live on, and would keep what one task took."""
    def run_and_release(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return run_and_release


def text_blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cuts Arrow batches into slices of about `size` bytes of text; null texts come as empty ones."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        first, held, texts = 0, 0, []
        for i, value in enumerate(column):
            raw = value.as_py() or b""
            if texts and held + len(raw) > size:
                yield batch.slice(first, i - first), texts
                first, held, texts = i, 0, []
            texts.append(raw)
            held += len(raw)
        if texts:
            yield batch.slice(first), texts


def map_texts(df: DataFrame, text: str, outputs: str, function: Callable[[list[bytes]], list], keep: list[str], setup: Callable | None = None,
              size: int = BLOCK_BYTES) -> DataFrame:
    """Adds columns made from whole texts: `function(texts)` gives one list of values per output column.

    `outputs` is a DDL string; `setup()` runs once per task and its result goes to the function first. An output whose name `keep` has
    gets underscores in front.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    raw = free_name("raw_text", keep)
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("binary").alias(raw))
    added = StructType.fromDDL(outputs)
    schema = StructType([*source.schema.fields[:-1], *[StructField(free_name(f.name, keep), f.dataType) for f in added.fields]])
    types = [f.type for f in to_arrow_schema(added)]

    def run(batches):
        first = (setup(),) if setup else ()
        for part, texts in text_blocks(batches, raw, size):
            made = function(*first, texts)
            arrays = [part.column(i) for i in range(len(keep))] + [pa.array(v, t) for v, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(giving_back(run), schema)
