"""Byte-level BPE: ranked merges folded over byte arrays of distinct words, decoding by joining pieces.

Frequent words are folded by higher-order functions, with the rank file as one literal: an array of buckets by hash, as a map literal would
be searched from its start for each pair. A word is an array of bytes; each step of the fold joins the neighbours whose union has the lowest
rank, the first ones where there are several. The other words are too many for this (see README): tasks fold them the same way over byte
strings in Arrow batches, each distinct word once.
"""
from __future__ import annotations

import base64
import json
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens.llm.common import CACHE_WORDS, by_spaced_words, map_texts

NONE = 2147483647
BUCKETS = 1 << 16
FREQUENT = 1 << 16
#: One document in so many is read to choose the frequent words.
CHOOSE_FROM = 64
#: Longer words are few; the quadratic fold is not for them.
LONG_WORD = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@cache
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


def bucket_literal(entries: dict[bytes, object], kind: str) -> Column:
    """Constant array of buckets of (key, value), by the low bits of the hash that xxhash64() gives the key."""
    import xxhash

    buckets: list[list] = [[] for _ in range(BUCKETS)]
    for key, value in entries.items():
        buckets[xxhash.xxh64_intdigest(key, 42) % BUCKETS].append({"k": base64.b64encode(key).decode(), "v": value})
    return F.from_json(F.lit(json.dumps(buckets)), f"array<array<struct<k:binary,v:{kind}>>>")


def look_up(table: Column, key: Column, missing: Column) -> Column:
    bucket = F.get(table, F.xxhash64(key).bitwiseAND(F.lit(BUCKETS - 1)).cast("int"))
    return F.aggregate(bucket, missing, lambda found, e: F.when(e["k"] == key, e["v"]).otherwise(found))


def merge_step(table: Column, pieces: Column) -> Column:
    """The pieces with the lowest-ranked pair of neighbours joined; null if no pair has a rank."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(pieces) - 2), lambda j: look_up(table, F.concat(F.get(pieces, j), F.get(pieces, j + 1)), F.lit(NONE)))

    def join(found: Column) -> Column:
        at = F.array_position(found, F.array_min(found)).cast("int")
        return F.when(F.array_min(found) < NONE, let(at, lambda p: F.concat(
            F.slice(pieces, F.lit(1), p - 1), F.array(F.concat(F.get(pieces, p - 1), F.get(pieces, p))), F.slice(pieces, p + 2, F.size(pieces)))))

    return let(pairs, join)


def fold_word(table: Column, word: Column) -> Column:
    """Ids of a word (binary): of the word itself if it has one, else of what is left when no more pairs can be joined."""
    n = F.octet_length(word)
    single = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    start = F.struct(single.alias("pieces"), F.lit(False).alias("done"))

    def step(state: Column, _: Column) -> Column:
        go = (~state["done"]) & (F.size(state["pieces"]) > 1)
        joined = let(merge_step(table, state["pieces"]), lambda m: F.struct(F.coalesce(m, state["pieces"]).alias("pieces"), m.isNull().alias("done")))
        return F.when(go, joined).otherwise(F.struct(state["pieces"].alias("pieces"), F.lit(True).alias("done")))

    merged = F.aggregate(F.sequence(F.lit(1), n), start, step, lambda s: s["pieces"])
    ids = F.transform(merged, lambda p: look_up(table, p, F.lit(NONE)))
    return let(look_up(table, word, F.lit(NONE)), lambda own: F.when(own < NONE, F.array(own)).otherwise(ids))


def split_words(text: Column, pattern: str) -> Column:
    """Matches of the vocabulary's pattern; (?U) makes \\s all Unicode white space, as the library's engine has it."""
    return F.regexp_extract_all(text, F.lit(f"(?U){pattern}"), F.lit(0))


def frequent_words(docs: DataFrame, text: str, pattern: str, table: Column, count: int = FREQUENT, one_in: int = CHOOSE_FROM) -> dict[bytes, list[int]]:
    """Ids of at most `count` words that occur most in one of `one_in` texts, picked by hash: a store of finished work, no statistic."""
    some = docs.filter(F.pmod(F.xxhash64(text), F.lit(one_in)) == 0)
    words = some.select(F.explode(split_words(F.col(text), pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = words.filter((F.length("word") <= LONG_WORD) & (F.col("n") > 1)).orderBy(F.desc("n"), "word").limit(count)
    return {bytes(r["word"]): r["ids"] for r in top.select(F.col("word").cast("binary").alias("word")).select("word", fold_word(table, F.col("word")).alias("ids")).collect()}


def fold_bytes(word: bytes, table: dict[bytes, int]) -> list[int]:
    """The same fold over one word, for words that are not frequent."""
    own = table.get(word)
    if own is not None:
        return [own]
    rank, pieces = table.get, [word[i:i + 1] for i in range(len(word))]
    found = [rank(word[i:i + 2], NONE) for i in range(len(word) - 1)]
    while found:
        lowest = min(found)
        if lowest == NONE:
            break
        at = found.index(lowest)
        joined = pieces[at] + pieces[at + 1]
        pieces[at:at + 2] = [joined]
        del found[at]
        if at:
            found[at - 1] = rank(pieces[at - 1] + joined, NONE)
        if at < len(found):
            found[at] = rank(joined + pieces[at + 1], NONE)
    return [table[p] for p in pieces]


def encoder(path: str, pattern: str, known: dict[bytes, list[int]]) -> Callable[[str], bytes]:
    """Text to ids as little-endian unsigned 32-bit integers; each distinct word of a task is folded once, as long as it is kept."""
    from array import array

    import regex
    import tiktoken

    with open(path, "rb") as file:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    # A word beyond LONG_WORD bytes has too many pairs to look through in each step; the library merges with a queue.
    long_ = tiktoken.Encoding("words", pat_str=r"[\s\S]+", mergeable_ranks=table, special_tokens={})
    words = regex.compile(pattern)

    folded: dict[str, list[int]] = {}

    def word_ids(word: str) -> list[int]:
        raw = word.encode()
        if len(raw) > LONG_WORD:
            return long_.encode_ordinary(word)
        if len(folded) >= CACHE_WORDS:
            folded.clear()
        ids = folded[word] = known.get(raw) or fold_bytes(raw, table)
        return ids

    def piece_ids(text: str) -> bytes:
        if text[1:].isalpha() and text[0] == " ":  # one match of the pattern
            return array("I", word_ids(text)).tobytes()
        ids: list[int] = []
        for word in words.findall(text):
            ids += folded.get(word) or word_ids(word)
        return array("I", ids).tobytes()

    return by_spaced_words(piece_ids)


def decoded(ids: bytes, pieces: dict[int, bytes]) -> bytes:
    """The pieces of the ids, joined; an id that has no piece adds nothing."""
    import numpy as np

    return b"".join([pieces.get(i, b"") for i in np.frombuffer(ids, dtype="<u4").tolist()])


def round_trip(docs: DataFrame, text: str, pattern: str, path: str, keep: list[str] | None = None) -> DataFrame:
    """Adds ids (little-endian unsigned 32-bit integers) of each whole text and decoded, the bytes that the ids stand for.

    Null and empty texts have no ids and decode to nothing. Rows come through one by one, so repeated ones, null ids and an empty table need nothing special.
    """
    known = frequent_words(docs, text, pattern, bucket_literal(ranks(path), "int"))
    shared = docs.sparkSession.sparkContext.broadcast(known)  # at most FREQUENT words

    def setup():
        with open(path, "rb") as file:
            pieces = {int(b): base64.b64decode(a) for a, b in map(bytes.split, file)}
        return encoder(path, pattern, shared.value), pieces

    def run(tools, texts):
        encode, pieces = tools
        ids = [encode(t.decode("utf-8", "replace")) for t in texts]
        return [ids, [decoded(i, pieces) for i in ids]]

    return map_texts(docs, text, "ids binary, decoded binary", run, docs.columns if keep is None else keep, setup, 1 << 20)
