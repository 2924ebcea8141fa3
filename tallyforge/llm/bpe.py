"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Texts are cut into the pattern's matches and gathered in blocks: one row holds
the distinct words of a few megabytes of text, and for each text the numbers of
its words. Every distinct word is merged, the pair of least rank first and the
leftmost of equal ones; texts are put together from the ids of their words, and
decoded by concatenating the pieces of the ids, both by higher-order functions.

The merging comes in two forms with equal results. With `fold` it is a fold of
higher-order functions over the bytes of the distinct words, with the ranks as
a literal map. That form needs more than twice the CPU time that the check
tool allows (see README.md), so by default the block builder merges the words,
each distinct word of a block once.

Bytes appear as the characters U+0000 to U+00FF, as keys of a literal map have
to be strings; encoding to ISO-8859-1 gives the bytes back. The map is dealt
into many small ones by a checksum, because Spark searches a map from its start.

The fold takes a time that grows with the square of a word's length, so words
of more than LONG_BYTES bytes, which only junk contains, are merged in the
block builder with a heap instead; the ids are the same.

Defined results: a null or empty text has no token and decodes to nothing;
repeated rows get equal results; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

LONG_BYTES = 256
#: Text bytes of a block; it bounds a row's distinct words.
BLOCK_BYTES = 16 << 20
_BUCKETS = 8192
_NONE = 2**31 - 1
#: White space as the tokenizer's regular expressions know it.
_SPACE = r"\t-\r\x20\x85\xa0  -     　"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def _chars(data: bytes) -> str:
    return data.decode("latin-1")


def heap_merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word: least rank first, leftmost of equal ones, in n log n steps."""
    n = len(word)
    end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[word[i : i + 2]], i, i + 2) for i in range(n - 1) if word[i : i + 2] in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = end[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(word[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := before[i]) >= 0 and (r := ranks.get(word[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = end[i]
    return out


#: Distinct words whose ids a Python worker keeps from block to block.
KEPT_WORDS = 300_000
_kept: dict[str, list[int]] = {}


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    if len(word) > LONG_BYTES // 4:
        return heap_merge(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best, at = _NONE, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], _NONE)
            if rank < best:
                best, at = rank, i
        if at < 0:
            return [ranks[p] for p in parts]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


_BLOCK = "docs array<struct<doc_id:long,words:array<int>>>, words array<string>, given array<array<int>>"


class _Numbers(dict):
    """Numbers of words in the order of their first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _block_builder(pattern: str, ranks: dict[bytes, int], block_bytes: int, fold: bool):
    find = regex.compile(pattern.replace(r"\S", f"[^{_SPACE}]").replace(r"[^\s", f"[^{_SPACE}").replace(r"\s", f"[{_SPACE}]")).findall

    def merged(word: str) -> list[int] | None:
        data = word.encode()
        if fold:
            return heap_merge(data, ranks) if len(data) > LONG_BYTES else None
        ids = _kept.get(word)
        if ids is None:
            ids = merge_word(data, ranks)
            if len(_kept) < KEPT_WORDS and len(data) <= 32:
                _kept[word] = ids
        return ids

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = _Numbers()
        ids, offsets, words, size = [], [0], [], 0
        _kept.clear()  # another task of this worker may have had other ranks

        def flush() -> pa.RecordBatch:
            docs = pa.StructArray.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.concat_arrays(words) if words else pa.array([], pa.int32()))], ["doc_id", "words"])
            arrays = [
                pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), docs),
                pa.array([[_chars(w.encode()) for w in number] if fold else []], pa.list_(pa.string())),
                pa.array([[merged(w) for w in number]], pa.list_(pa.list_(pa.int32()))),
            ]
            return pa.RecordBatch.from_arrays(arrays, ["docs", "words", "given"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = find(text)
                words.append(pa.array(np.fromiter(map(number.__getitem__, found), np.int32, len(found))))
                ids.append(doc_id)
                offsets.append(offsets[-1] + len(found))
                size += len(text)
                if size >= block_bytes:
                    yield flush()
                    number = _Numbers()
                    ids, offsets, words, size = [], [0], [], 0
        if ids:
            yield flush()

    return build


def _let(value: Column, body) -> Column:
    """`body` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _rank(ranks: Column, piece: Column) -> Column:
    return F.coalesce(F.try_element_at(F.get(ranks, (F.crc32(piece.cast("binary")) % _BUCKETS).cast("int")), piece), F.lit(_NONE))


def _fold(word: Column, ranks: Column) -> Column:
    """The pieces of a word."""
    one = lambda x: F.array(x)
    none = F.array().cast("array<int>")

    def merged(acc: Column, k: Column) -> Column:
        p, r = acc["p"], acc["r"]

        def joined(piece: Column) -> Column:
            left = F.when(k > 1, one(_rank(ranks, F.concat(F.get(p, k - 2), piece)))).otherwise(none)
            right = F.when(k + 1 < F.size(p), one(_rank(ranks, F.concat(piece, F.get(p, k + 1))))).otherwise(none)
            return F.struct(
                F.concat(F.slice(p, F.lit(1), k - 1), one(piece), F.slice(p, k + 2, F.size(p))).alias("p"),
                F.concat(F.slice(r, F.lit(1), F.greatest(k - 2, F.lit(0))), left, right, F.slice(r, k + 2, F.size(r))).alias("r"),
            )

        return _let(F.concat(F.get(p, k - 1), F.get(p, k)), joined)

    def step(acc: Column, _: Column) -> Column:
        return _let(F.array_min(acc["r"]), lambda m: F.when(m < _NONE, _let(F.array_position(acc["r"], m).cast("int"), lambda k: merged(acc, k))).otherwise(acc))

    n = F.length(word)
    p = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
    r = F.transform(F.sequence(F.lit(1), n - 1), lambda i: _rank(ranks, F.substring(word, i, F.lit(2))))
    folded = F.aggregate(F.sequence(F.lit(1), n - 1), F.struct(p.alias("p"), r.alias("r")), step, lambda acc: acc["p"])
    return F.when((n == 1) | (_rank(ranks, word) < _NONE), one(word)).otherwise(folded)


def _literals(ranks: dict[bytes, int]) -> tuple[Column, Column]:
    """The rank map in buckets and the pieces by id, both as literals."""
    dealt: list[dict[str, int]] = [{} for _ in range(_BUCKETS)]
    pieces: list[str | None] = [None] * (max(ranks.values()) + 1)
    for data, rank in ranks.items():
        key = _chars(data)
        dealt[zlib.crc32(key.encode()) % _BUCKETS][key] = rank
        pieces[rank] = key
    return F.from_json(F.lit(json.dumps(dealt)), "array<map<string,int>>"), F.from_json(F.lit(json.dumps(pieces)), "array<string>")


def encoded_blocks(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, fold: bool = False) -> DataFrame:
    """(docs, ids, pieces): blocks of texts with the ids of each distinct word and what they decode to.

    With `fold` the words are merged by higher-order functions, else in the
    block builder; the ids are the same.
    """
    ranks = load_ranks(path)
    rank_map, piece_list = _literals(ranks)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    built = rows.mapInArrow(_block_builder(pattern, ranks, block_bytes, fold), _BLOCK)
    if fold:

        def ids(given: Column, word: Column, table: Column) -> Column:
            return F.coalesce(given, F.transform(_fold(word, table), lambda piece: _rank(table, piece)))

        folded = _let(rank_map, lambda table: F.zip_with("given", "words", lambda given, word: ids(given, word, table)))
        out = built.select("docs", folded.alias("ids"))
    else:
        out = built.select("docs", F.col("given").alias("ids"))
    decoded = _let(piece_list, lambda table: F.transform("ids", lambda word: F.array_join(F.transform(word, lambda i: F.get(table, i)), "")))
    return out.select("docs", "ids", decoded.alias("pieces"))


def encode_digests(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, fold: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    out = encoded_blocks(docs, path, pattern, block_bytes, fold)
    out = out.select("docs", "pieces", F.transform("ids", lambda w: F.concat_ws(",", w.cast("array<string>"))).alias("ids"), F.transform("ids", lambda w: F.size(w)).alias("n"))

    def digest(doc: Column) -> Column:
        words = doc["words"]
        return F.struct(
            doc["doc_id"].alias("doc_id"),
            F.aggregate(words, F.lit(0).cast("long"), lambda acc, i: acc + F.get(F.col("n"), i)).alias("n_tokens"),
            F.sha2(F.array_join(F.transform(words, lambda i: F.get(F.col("ids"), i)), ","), 256).alias("ids_sha256"),
            F.sha2(F.encode(F.array_join(F.transform(words, lambda i: F.get(F.col("pieces"), i)), ""), "ISO-8859-1"), 256).alias("decoded_sha256"),
        )

    return out.select(F.inline(F.transform("docs", digest)))


def encode(docs: DataFrame, path: str, pattern: str, block_bytes: int = BLOCK_BYTES, fold: bool = False) -> DataFrame:
    """(doc_id, ids) of every document."""
    out = encoded_blocks(docs, path, pattern, block_bytes, fold)
    return out.select(F.inline(F.transform("docs", lambda doc: F.struct(doc["doc_id"].alias("doc_id"), F.flatten(F.transform(doc["words"], lambda i: F.get(F.col("ids"), i))).alias("ids")))))


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, data): the bytes that the ids stand for, concatenated."""
    _, pieces = _literals(load_ranks(path))
    joined = _let(pieces, lambda table: F.array_join(F.transform("ids", lambda i: F.get(table, i)), ""))
    return encoded.select("doc_id", F.encode(joined, "ISO-8859-1").alias("data"))
