"""Packing of token streams into sequences of at most 1024 ids with bounded memory.

Each partition keeps a fixed number of open windows. A document's ids fill whole windows first; the rest goes to the open window that it
fills best. When none has room, the fullest window is filled to its end with the first part of the piece and emitted, so emitted
windows carry no padding. What is left open at the end of the partitions is merged in a tree: the open windows of some partitions are packed
the same way, until one group is left.
"""
from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import Scratch, by_spaced_words, giving_back, text_blocks

LENGTH = 1024
OPEN_WINDOWS = 16
FAN = 64
END_ID = 0
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task long, window long, offset long, ids binary, open boolean"
PIECE_NAMES = [x.split()[0] for x in PIECES.split(", ")]
PIECE_TYPES = [*[pa.int64()] * 8, pa.binary(), pa.bool_()]


def byte_bpe_encoder(json_path: str, rank_path: str, special: str = "<|endoftext|>") -> Callable[[str], bytes]:
    """Text to ids as little-endian unsigned 32-bit integers.

    Texts that hold the special token's string are encoded by `tokenizers`, which gives it its own id.
    """
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(rank_path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    whole = Tokenizer.from_file(json_path)
    words = by_spaced_words(lambda text: np.asarray(plain.encode_ordinary(text), dtype="<u4").tobytes())

    def encode(text: str) -> bytes:
        if special in text:
            return np.asarray(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return words(text)

    return encode


class Packer:
    """Open windows of one partition; `emit(window number, pieces)` gets each finished window."""

    def __init__(self, emit, length: int = LENGTH, windows: int = OPEN_WINDOWS):
        self.emit, self.length, self.windows = emit, length, windows
        self.open: list[tuple[int, list]] = []  # (ids held, pieces)
        self.count = 0

    def close(self, i: int) -> None:
        held, pieces = self.open.pop(i)
        self.emit(self.count, pieces)
        self.count += 1

    def finish(self, is_open: bool) -> None:
        """Hands out the windows that are still open."""
        for _, pieces in self.open:
            self.emit(self.count, pieces, is_open)
            self.count += 1
        self.open = []

    def add(self, doc, size: int) -> None:
        """Places the ids 0 to size - 1 of a document; a piece is (document, start, length, offset)."""
        at = 0
        while size - at >= self.length:
            self.emit(self.count, [(doc, at, self.length, 0)])
            self.count += 1
            at += self.length
        while at < size:
            left = size - at
            fits = [(self.length - held, i) for i, (held, _) in enumerate(self.open) if self.length - held >= left]
            if fits:
                i = min(fits)[1]
            elif len(self.open) < self.windows:
                self.open.append((0, []))
                i = len(self.open) - 1
            else:
                i = max(range(len(self.open)), key=lambda j: self.open[j][0])
            held, pieces = self.open[i]
            part = min(left, self.length - held)
            pieces.append((doc, at, part, held))
            self.open[i] = (held + part, pieces)
            at += part
            if held + part == self.length:
                self.close(i)


def pieces_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * len(PIECE_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, PIECE_TYPES, strict=True)], names=PIECE_NAMES)


def piece_rows(task: int, window: int, pieces: list, is_open: bool) -> list[tuple]:
    """Rows of one window; only open windows, a fixed number per task, carry their ids on."""
    out = []
    for (doc, first, ids, total), at, n, offset in pieces:
        own = ids[4 * at:4 * (at + n)]
        out.append((doc, first + at, n, zlib.crc32(own), total, task, window, offset, own if is_open else None, is_open))
    return out


def pack_partitions(docs: DataFrame, doc_id: str, text: str, encoder: Callable[[], Callable[[str], bytes]], length: int, windows: int) -> DataFrame:
    """Pieces by task and window; `open` marks those of windows that were open at the end of the task."""
    from pyspark import TaskContext

    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))

    def run(batches):
        encode, task = encoder(), TaskContext.get().partitionId()
        rows: list[tuple] = []
        packer = Packer(lambda window, pieces, is_open=False: rows.extend(piece_rows(task, window, pieces, is_open)), length, windows)
        for part, texts in text_blocks(batches, "text", 1 << 20):
            for key, raw in zip(part.column(0).to_pylist(), texts):
                ids = encode(raw.decode("utf-8", "replace")) + END_ID.to_bytes(4, "little")
                packer.add((key, 0, ids, len(ids) // 4), len(ids) // 4)
            yield pieces_batch(rows)
            rows.clear()
        packer.finish(True)
        yield pieces_batch(rows)

    return source.mapInArrow(giving_back(run), PIECES)


def merge_group(fan: int, length: int, windows: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    """Packs the open pieces of some tasks once more, longest first."""
    def run(table: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        pieces = sorted(table.to_pylist(), key=lambda p: (-p["length"], p["task"], p["window"], p["offset"]))
        task = pieces[0]["task"] // fan
        packer = Packer(lambda window, held, is_open=False: rows.extend(piece_rows(task, window, held, is_open)), length, windows)
        for p in pieces:
            packer.add((p["doc_id"], p["start"], p["ids"], p["doc_tokens"]), p["length"])
        packer.finish(not last)
        return pa.Table.from_batches([pieces_batch(rows)])

    return run


def pack(docs: DataFrame, encoder: Callable[[], Callable[[str], bytes]], doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, windows: int = OPEN_WINDOWS, fan: int = FAN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document's ids end with END_ID; a null or empty text is that id alone. Repeated rows are packed as often as they come, an
    empty table gives no rows, a null id is kept, other columns are not read. Sequences are padded by their reader: to `length`, unless they are a
    power of two long. Only the last `windows` sequences can be short. `encoder()` runs once per task and gives text -> ids.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.table("level0", pack_partitions(docs, doc_id, text, encoder, length, windows))
    tasks = pieces.filter("open").agg(F.coalesce(F.max("task"), F.lit(0))).first()[0] + 1
    level, closed = 0, [pieces.filter("not open").withColumn("level", F.lit(0))]
    while True:
        level, tasks = level + 1, -(-tasks // fan)
        # A group holds at most `fan` * `windows` windows of `length` ids.
        groups = pieces.filter("open").groupBy(F.floor(F.col("task") / fan))
        pieces = scratch.table(f"level{level}", groups.applyInArrow(merge_group(fan, length, windows, tasks == 1), PIECES))
        closed.append(pieces.filter("not open").withColumn("level", F.lit(level)))
        if tasks == 1:
            break
    done = closed[0]
    for more in closed[1:]:
        done = done.unionByName(more)
    sequence = F.col("level").cast("long") * F.lit(1 << 58) + F.shiftleft("task", 34) + F.col("window")
    return done.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence.alias("sequence_id"), "offset")
