"""Spelling variants: words one edit apart, grouped under their commonest form, by a bit-sliced position index.

Words meet in tiles. Two words that differ by one edit agree in a first or in a
last part: if the shorter one has m code points, in its first m // 2 or in its
last m - m // 2. A word of length L therefore goes under four keys, both parts
for m = L and for m = L - 1, and rows of one key stay together. A tile is a run
of whole keys; a key with more words than a tile holds is cut into pieces, and
every piece meets every one of them.

The index of a tile has a bitset over its words for each position and letter.
A word reads its letters once and carries four sets along, 64 words at a time:
those equal so far (zero errors), and those with one letter replaced, one left
out or one more so far (one error), the latter two by the bitsets of shifted
positions. Lengths decide at the end which sets are hits.

Defined results: a null text has no run; without an id the hash is of `:<run>`;
repeated rows count again; a run may be of any length; words equal in count go
by code points; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LEAST_LENGTH, LEAST_COUNT, MODULUS = 5, 3, 97
#: Distinct words that a task counts before it passes the counts on; words and letters of a tile; words that read at once.
HELD_WORDS, TILE_WORDS, TILE_LETTERS, READ_AT_ONCE = 200_000, 2048, 1 << 16, 256

_LOWER = {c: c + 32 for c in range(65, 91)}


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the words of documents (id, text), summed within the task as far as HELD_WORDS allows."""
    held: Counter[str] = Counter()
    lowered: dict[str, str] = {}

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        held.clear()
        return out

    for batch in batches:
        for doc, text in zip(batch.column(0), batch.column(1), strict=True):
            if not text.is_valid:
                continue
            seed = zlib.crc32(f"{doc.as_py() if doc.is_valid else ''}:".encode())
            for run, n in Counter(RUN.findall(text.as_py())).items():
                if len(run) < LEAST_LENGTH:
                    continue  # nor has it enough letters with one deleted
                word = lowered.get(run)
                if word is None:
                    if len(lowered) >= HELD_WORDS:
                        lowered.clear()
                    word = lowered[run] = run.translate(_LOWER)
                h = zlib.crc32(word.encode(), seed)
                if h % MODULUS == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < LEAST_LENGTH:
                        continue
                held[word] += n
            if len(held) >= HELD_WORDS:
                yield flush()
    if held:
        yield flush()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n) of words of at least five code points and three occurrences."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(words: DataFrame) -> DataFrame:
    """(key, word, n): a word under the first and the last part of it, for itself as the shorter of a pair and as the longer."""
    long = F.length("word")

    def parts(m):
        head = F.floor(m / 2).cast("int")
        return [F.concat_ws(":", m.cast("string"), F.lit("a"), F.substring("word", F.lit(1), head)), F.concat_ws(":", m.cast("string"), F.lit("z"), F.substring("word", long - (m - head) + 1, m - head))]

    keys = F.when(long > LEAST_LENGTH, F.array(*parts(long), *parts(long - 1))).otherwise(F.array(*parts(long)))
    return words.select(F.explode(keys).alias("key"), "word", "n")


class Index:
    """Bitsets over the words of a tile, by position and letter and by length."""

    def __init__(self, words: list[str]):
        self.width = (len(words) + 63) // 64
        self.length = np.array([len(w) for w in words])
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        first = np.cumsum(self.length) - self.length
        owner = np.repeat(np.arange(len(words)), self.length)
        place = (np.arange(len(codes)) - first[owner]) << 32 | codes
        self.places, which = np.unique(place, return_inverse=True)
        self.bits = np.zeros((len(self.places) + 1, self.width), np.uint64)  # the last row is empty
        np.bitwise_or.at(self.bits, (which, owner >> 6), np.uint64(1) << (owner & 63).astype(np.uint64))
        self.every = self._set(np.ones(len(words), bool))
        self.n = len(words)

    def _set(self, member: np.ndarray) -> np.ndarray:
        padded = np.zeros(self.width * 64, np.uint8)
        padded[: len(member)] = member
        return np.packbits(padded, bitorder="little").view(np.uint64)

    def at(self, position: int, letters: np.ndarray) -> np.ndarray:
        """Words with each of `letters` at a position, a row of bits for each."""
        if position < 0:
            return self.bits[np.full(len(letters), len(self.places))]
        want = position << 32 | letters
        found = np.minimum(np.searchsorted(self.places, want), len(self.places) - 1)
        return self.bits[np.where(self.places[found] == want, found, len(self.places))]

    def near(self, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(reader, word) of all pairs one edit apart; `letters` has a row for each reader, all of one length."""
        readers, long = letters.shape
        equal = np.repeat(self.every[None], readers, 0)
        replaced, fewer = np.zeros_like(equal), np.zeros_like(equal)
        more = equal.copy()
        for i in range(long):
            c = letters[:, i]
            same = self.at(i, c)
            fewer = (fewer & self.at(i - 1, c)) | equal
            replaced = (replaced & same) | (equal & ~same)
            equal = equal & same
            more = (more & self.at(i + 1, c)) | equal
        hits = (replaced & self._set(self.length == long)) | (fewer & self._set(self.length == long - 1)) | (more & self._set(self.length == long + 1))
        return np.nonzero(np.unpackbits(hits.view(np.uint8), axis=1, bitorder="little")[:, : self.n])


def near_in(index: Index, readers: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(reader, words) for every reader that has near words in the index."""
    length = np.array([len(w) for w in readers])
    for long in np.unique(length):
        alike = np.flatnonzero(length == long)
        step = max(1, min(READ_AT_ONCE, (1 << 22) // (8 * index.width)))
        for at in range(0, len(alike), step):
            some = alike[at : at + step]
            letters = np.frombuffer("".join(readers[k] for k in some).encode("utf-32-le"), np.uint32).astype(np.int64).reshape(len(some), long)
            reader, word = index.near(letters)
            cut = np.flatnonzero(np.diff(reader)) + 1
            for r, w in zip(np.split(reader, cut), np.split(word, cut), strict=True):
                if len(r):
                    yield int(some[r[0]]), w


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, word, n), those of a key one after another, to pairs (word, near, near_n)."""
    words: dict[str, int] = {}  # of the tile: whole keys
    key, own = None, {}  # of the key that is read

    def out(pairs: Iterator[tuple[str, str, int]]) -> Iterator[pa.RecordBatch]:
        rows = list(pairs)
        if rows:
            word, near, n = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(near, pa.string()), pa.array(n, pa.int64())], ["word", "near", "near_n"])

    def met(readers: dict[str, int], others: dict[str, int]) -> Iterator[pa.RecordBatch]:
        if len(readers) and len(others) and (len(readers) > 1 or readers is not others):
            names, counts, reading = list(others), list(others.values()), list(readers)
            yield from out((reading[r], names[w], counts[w]) for r, found in near_in(Index(names), reading) for w in found)

    def pieces(of: dict[str, int]) -> list[dict[str, int]]:
        cuts, letters = [{}], 0
        for w, n in of.items():
            if cuts[-1] and (len(cuts[-1]) >= TILE_WORDS or letters + len(w) > TILE_LETTERS):
                cuts.append({})
                letters = 0
            cuts[-1][w] = n
            letters += len(w)
        return cuts

    def full(of: dict[str, int]) -> bool:
        return len(of) >= TILE_WORDS or sum(map(len, of)) > TILE_LETTERS

    def close() -> Iterator[pa.RecordBatch]:
        """The key is read: it goes into the tile, or is too large and meets itself piece by piece."""
        nonlocal words
        if full(own):
            cuts = pieces(own)
            for a in cuts:
                for b in cuts:
                    yield from met(a, b)
        elif len(own) > 1:
            words |= own
            if full(words):
                yield from met(words, words)
                words = {}

    for batch in batches:
        for k, word, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != key:
                yield from close()
                key, own = k, {}
            own[word] = n
    yield from close()
    yield from met(words, words)


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every pair of words one edit apart, both ways."""
    return _keyed(words).repartition("key").sortWithinPartitions("key").mapInArrow(_tiles, "word string, near string, near_n long").dropDuplicates(["word", "near"])


def roots(tables: blocks.Tables, forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form; each round doubles how far a word has followed the forms."""
    reached, k = tables.keep(forms.select("word", F.col("form").alias("root")), "root0"), 0
    while True:
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = reached.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        k += 1
        step = tables.keep(step, f"root{k}")
        reached = step.drop("moved")
        if step.where("moved").isEmpty():
            return reached


def variants(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary."""
    tables = blocks.Tables(docs.sparkSession)
    words = tables.keep(vocabulary(docs), "words")
    pairs = near_words(words)
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near"))
    about = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    rows = words.join(about, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= 2 * F.col("n"), F.col("best")).alias("form"))
    rows = tables.keep(rows.select("word", F.col("form.near").alias("form"), "n", "n_near", (-F.col("form.less")).alias("form_n")), "rows")
    found = roots(tables, rows.where("form is not null"))
    return rows.join(found, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
