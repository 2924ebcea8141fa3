"""Benchmark decontamination by templates.

Words become template tokens: numbers, names and units of measure turn into
typed placeholders, all others are lower-cased and lose their outer
punctuation. Windows of eight template tokens of documents and benchmark items
meet in a hash join; a window counts if the values in its placeholders are
consistent too, that is, if equal benchmark values stand where equal document
values stand and unequal where unequal. So an item is caught if its numbers or
names were swapped for others, but not where a template merely looks alike.
Windows of few literal words, as in tables or lists of names, count where all
their words are equal, values included; they add to the share of an item that is
held, but can't lower that of its other windows.

A number is a word of digits with separators; a unit is a word of the list
below after a number; a name is a capitalised word that doesn't begin a
sentence or line.

Defined results: null and empty texts match nothing, on either side; an item of
fewer than eight words is one window of its own length; an item of one word is
held by documents of that word only; a very long text is a slice of its own; of
items that a document holds alike all are named; an empty table gives an empty
result; repeated items are items of their own; repeated rows of one doc_id count
as one document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

WINDOW = 8
#: Share of an item's windows that a document has to hold, and their least number.
COVERAGE, LEAST_WINDOWS = 0.3, 3
#: Literal words that a window needs to match by its template, so that rows of other numbers don't match each other.
LEAST_LITERALS = 4
#: Benchmark windows whose hashes may go to all tasks (8 bytes each); beyond that all document windows are shuffled.
BROADCAST_WINDOWS = 2_000_000

UNITS = (
    "mm cm m km g kg mg lb lbs oz ml l s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years "
    "percent % dollar dollars euro euros cent cents usd eur gbp km/h mph kmh degrees degree meter meters metre metres mile miles inch inches foot feet liter liters litre litres"
).split()

_STRIP = np.zeros(256, bool)
_STRIP[list(b".,;:!?\"'()[]{}<>*#&|$")] = True
_NUMERIC = np.zeros(256, bool)
_NUMERIC[list(b"0123456789.,:/-%")] = True
_SENTENCE_END = np.zeros(256, bool)
_SENTENCE_END[list(b".!?:")] = True
_LITERAL, _NUMBER, _NAME, _UNIT = range(4)
_PLACE = blocks.mix(np.array([0, 11, 22, 33], np.uint64))


def _hash_words(words: list[str]) -> np.ndarray:
    buf, offsets = blocks.text_buffer(pa.array([" ".join(words)]))
    return np.sort(blocks.segment(buf, offsets).hash)


_UNIT_HASHES = _hash_words(UNITS)


def _isin(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def template(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, value, kind) of every word that holds more than punctuation."""
    raw, offsets = blocks.text_buffer(texts)
    buf = blocks.fold_case(raw)
    words = blocks.segment(buf, offsets)
    start, end = words.start.copy(), words.end.copy()
    if not len(start):
        return words.row, words.hash, words.hash, np.zeros(0, np.int8)
    for _ in range(4):
        start += (start < end) & _STRIP[buf[np.minimum(start, len(buf) - 1)]]
        end -= (start < end) & _STRIP[buf[end - 1]]
    newline = np.concatenate([[0], np.cumsum(raw == 10)])
    begins = np.ones(len(start), bool)
    begins[1:] = (words.row[1:] != words.row[:-1]) | _SENTENCE_END[buf[words.end[:-1] - 1]] | (newline[words.start[1:]] > newline[words.end[:-1]])
    keep = start < end
    start, end, row, begins = start[keep], end[keep], words.row[keep], begins[keep]
    if not len(start):
        return row, np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int8)
    value = blocks.RangeHash(buf)(start, end)
    digits = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57))])
    numeric = np.concatenate([[0], np.cumsum(_NUMERIC[buf])])
    kind = np.full(len(start), _LITERAL, np.int8)
    head = raw[start]
    latin = np.zeros(len(start), bool)
    two = head == 0xC3
    latin[two] = (raw[np.minimum(start[two] + 1, len(raw) - 1)] <= 0x9E) & (raw[np.minimum(start[two] + 1, len(raw) - 1)] != 0x97)
    kind[(((head >= 65) & (head <= 90)) | latin) & ~begins & (end - start > 1)] = _NAME
    is_number = (numeric[end] - numeric[start] == end - start) & (digits[end] > digits[start])
    kind[is_number] = _NUMBER
    after = np.zeros(len(start), bool)
    after[1:] = is_number[:-1] & (row[1:] == row[:-1])
    kind[after & _isin(value, _UNIT_HASHES)] = _UNIT
    return row, np.where(kind == _LITERAL, value, _PLACE[kind]), value, kind


def windows(row: np.ndarray, token: np.ndarray, value: np.ndarray, kind: np.ndarray, width: int, least: int, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, exact) of the runs of `width` words within a text.

    Runs of `least` literals hash their template, others (`exact`) the words
    themselves. An item's first word is literal even if it is a name elsewhere:
    with `both`, runs that hold `least` literals just so have either hash.
    """
    n = len(row) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
    acc = np.zeros(n, np.uint64)
    for k in range(width):
        acc = acc * np.uint64(0xD6E8FEB86659FD93) + token[k : k + n]
    literal = np.concatenate([[0], np.cumsum(kind == _LITERAL)])
    literal = literal[width:] - literal[:-width]
    inside = row[:n] == row[width - 1 :]
    at = np.flatnonzero(inside & (literal >= least))
    few = np.flatnonzero(inside & (literal < least + both))
    words = np.zeros(len(few), np.uint64)
    for k in range(width):
        words = words * np.uint64(0xD6E8FEB86659FD93) + value[few + k]
    hashes = np.concatenate([blocks.mix(acc[at] + np.uint64(width)), blocks.mix(words + np.uint64(width + 1000))])
    return np.concatenate([at, few]), hashes, np.arange(len(at) + len(few)) >= len(at)


def slots(at: np.ndarray, value: np.ndarray, kind: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, values): hashes of which placeholders of a window hold equal values, and of the values themselves."""
    pattern, values = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    for j in range(width):
        filled = kind[at + j] != _LITERAL
        first = np.full(len(at), j, np.uint64)
        for i in range(j - 1, -1, -1):
            same = filled & (kind[at + i] != _LITERAL) & (value[at + i] == value[at + j])
            first[same] = i
        pattern = blocks.mix(pattern + np.where(filled, first + np.uint64(1), np.uint64(0)) + np.uint64(j))
        values = blocks.mix(values + np.where(filled, value[at + j], np.uint64(0)) + np.uint64(j))
    return pattern, values


_SCHEMA = "id long, width int, position int, window long, pattern long, slots long, exact boolean"


def _emit(ids: pa.Array, texts: pa.Array, widths: list[int], wanted: np.ndarray | None, whole: bool) -> pa.RecordBatch:
    """Windows of a slice; `whole` for benchmark items, which have just the width that fits them."""
    row, token, value, kind = template(texts)
    count = np.bincount(row, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    parts = []
    for width in widths:
        at, key, exact = windows(row, token, value, kind, width, LEAST_LITERALS if width == WINDOW else 2, whole)
        if whole or width == 1:
            keep = (count[row[at]] == width) | ((width == WINDOW) & (count[row[at]] >= WINDOW))
            at, key, exact = at[keep], key[keep], exact[keep]
        if wanted is not None:
            keep = _isin(key, wanted)
            at, key, exact = at[keep], key[keep], exact[keep]
        pattern, values = slots(at, value, kind, width)
        pattern[exact] = values[exact] = 0  # the hash holds them
        parts.append((row[at], np.full(len(at), width), at - first[row[at]], key, pattern, values, exact))
    r, w, p, key, pattern, values, exact = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 7
    arrays = [ids.take(pa.array(r.astype(np.int64))), pa.array(w, pa.int32()), pa.array(p, pa.int32()), *(pa.array(x.astype(np.uint64).view(np.int64)) for x in (key, pattern, values)), pa.array(exact.astype(bool))]
    return pa.RecordBatch.from_arrays(arrays, ["id", "width", "position", "window", "pattern", "slots", "exact"])


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, least: int = LEAST_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, reparameterised) of every document that holds an item.

    n_windows counts the item's windows that the document holds; coverage is their
    share, or that of the windows that match by template, if greater; reparameterised
    says that some of them match by their template only, with other values.
    """

    def items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.text_slices(batches):
            yield _emit(part.column(0), part.column(1), list(range(1, WINDOW + 1)), None, True)

    bench = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(items, _SCHEMA)
    bench = blocks.shared_checkpoint(bench.withColumnRenamed("id", "item_id"))
    widths = sorted(r.width for r in bench.select("width").distinct().collect())  # 1 to 8
    bounded = bench.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    wanted = np.unique(bench.select("window").toArrow().column("window").to_numpy().view(np.uint64)) if bounded else None

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.text_slices(batches):
            yield _emit(part.column(0), part.column(1), widths, wanted, False)

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(candidates, _SCHEMA)
    found = found.select(F.col("id").alias("doc_id"), "window", "pattern", F.col("slots").alias("doc_slots"))
    side = bench.select("item_id", "position", "window", "pattern", "slots", "exact")
    # Its size was just checked; Spark shuffles both sides otherwise.
    met = found.join(F.broadcast(side) if bounded else side, ["window", "pattern"])
    each = met.groupBy("doc_id", "item_id", "position").agg(F.min((F.col("doc_slots") == F.col("slots")).cast("int")).alias("same"), F.min("exact").alias("exact"))
    held = each.groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(~F.col("exact")).alias("n_template"), F.min("same").alias("same"))
    sizes = bench.groupBy("item_id").agg(F.count_distinct("position").alias("n"), F.count_if(~F.col("exact")).alias("n_t"))

    def enough(windows: str, of: str) -> Column:
        return (F.col(windows) > 0) & (F.col(windows) >= F.least(F.lit(least), F.col(of))) & (F.col(windows) >= F.lit(coverage) * F.col(of))

    out = held.join(F.broadcast(sizes) if bounded else sizes, "item_id").where(enough("n_windows", "n") | enough("n_template", "n_t"))
    share = F.greatest(F.col("n_windows") / F.col("n"), F.when(F.col("n_t") > 0, F.col("n_template") / F.col("n_t")))
    return out.select("doc_id", "item_id", "n_windows", share.alias("coverage"), (F.col("same") == 0).alias("reparameterised"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Rows are told apart by a hash of id and text, so that of rows of one id, or
    of none, only those go that hold an item.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(text))
    found = contaminated(docs.select(key.alias("doc_id"), text.alias("text")), benchmark).select(F.col("doc_id").alias("_key")).distinct()
    found = blocks.Tables(docs.sparkSession).keep(found, "held")
    return docs.withColumn("_key", key).join(blocks.bounded(found), "_key", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
