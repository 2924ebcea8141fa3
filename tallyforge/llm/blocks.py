"""Vectorised word segmentation over Arrow text columns, and checkpoints.

The functions here run inside Spark tasks on slices of a few megabytes, so a
task's memory depends on the slice size and on its longest single text only.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that one vectorised step works on.
SLICE_BYTES = 2 << 20

_BASE = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names. A folder of this machine serves in its place for a local master only."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def shared_checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Tables:
    """Steps of one job, each written as Parquet to the shared folder and read again, so that no plan spans two of them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{ensure_checkpoint_dir(spark)}/job-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.folder}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def keep_parts(self, df: DataFrame, name: str, by: str) -> DataFrame:
        """A step in folders by the value of a column, so that one value is read without the others."""
        path = f"{self.folder}/{name}"
        df.write.partitionBy(by).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def forget(self, *names: str) -> None:
        """Delete steps that no later one reads."""
        for name in names:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each holds about `size` bytes.

    Texts are never cut: one that is longer than `size` makes a slice of its own.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = np.asarray(pc.binary_length(texts).fill_null(0), dtype=np.int64)
        ends = np.cumsum(lengths)
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + size, side="right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the n + 1 offsets of the texts in them. Null is the empty text."""
    texts = texts.fill_null("") if texts.null_count else texts
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    buf = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return buf, offs - offs[0]


def fold_case(buf: np.ndarray) -> np.ndarray:
    """Lower-case ASCII letters and the Latin-1 capitals (U+00C0 to U+00DE) of UTF-8 bytes."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    if len(buf) > 1:
        second = np.flatnonzero((buf[:-1] == 0xC3) & (buf[1:] >= 0x80) & (buf[1:] <= 0x9E) & (buf[1:] != 0x97)) + 1
        out[second] += 32
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche (the public splitmix64 constants)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, SLICE_BYTES + (1 << 16)), base, dtype=np.uint64)
        table[0] = 1
        table = np.cumprod(table)
        _powers[base] = table
    return table[:n]


class RangeHash:
    """Hashes of byte ranges of one buffer, from prefix sums of a polynomial modulo 2**64."""

    def __init__(self, buf: np.ndarray):
        self.prefix = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _power_table(_BASE, len(buf)), out=self.prefix[1:])
        self.inverse = _power_table(_INVERSE, len(buf) + 1)

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start] + (end - start).astype(np.uint64))


@dataclass
class Words:
    """Words of a slice of texts: byte ranges, the row of each word's text, and a hash of its bytes."""

    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    n_rows: int


def segment(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray | None = None) -> Words:
    """Runs of bytes that are `inside` words; by default of bytes other than ASCII white space and controls."""
    n = len(buf)
    if inside is None:
        inside = buf > 32
    padded = np.zeros(n + 2, dtype=bool)
    padded[1:-1] = inside
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    start = np.flatnonzero(padded[1:-1] & (~padded[:-2] | edge[:-1]))
    end = np.flatnonzero(padded[1:-1] & (~padded[2:] | edge[1:])) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    return Words(start, end, row, RangeHash(buf)(start, end) if len(start) else np.zeros(0, np.uint64), len(offsets) - 1)


def shingles(words: Words, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of every run of `width` words; a text with fewer words, but one at least, is a single shingle."""
    n = len(words.hash)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    counts = np.bincount(words.row, minlength=words.n_rows)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    acc = np.zeros(n, dtype=np.uint64)
    factor = 1
    for k in range(min(width, n)):
        shifted = np.zeros(n, dtype=np.uint64)
        shifted[: n - k] = words.hash[k:] if k else words.hash
        same = np.zeros(n, dtype=bool)
        same[: n - k] = words.row[k:] == words.row[: n - k] if k else True
        acc += np.where(same, shifted, np.uint64(0)) * np.uint64(factor)
        factor = factor * 0xD6E8FEB86659FD93 & _MASK
    at = np.arange(n) - first[words.row]
    whole = at + width <= counts[words.row]
    short = (counts[words.row] < width) & (at == 0)
    keep = whole | short
    return words.row[keep], mix(acc[keep])


#: Rows of keys that may go to all tasks: some tens of MB.
BROADCAST_KEYS = 300_000


def bounded(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """`keys` marked for broadcast if they are few; `keys` should be a written step, as it is counted."""
    return keys.hint("broadcast") if keys.limit(most + 1).count() <= most else keys
