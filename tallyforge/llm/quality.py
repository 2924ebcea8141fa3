"""Quality classifier: positive-unlabelled learning with the non-negative risk.

Trusted positives and unlabelled web text are drawn as bounded samples. The
share of positives in the unlabelled text is estimated from the two score
distributions, and a small network minimises the non-negative unbiased risk

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).

Labelled negatives are never used: neither for training nor for the prior.

Defined results: a null or empty text is scored from its features like any
other (all rates zero); repeated rows get equal scores, and so do equal texts
anywhere; a score at the threshold is accepted; a very long text is one slice of
its own; an empty table gives an empty result; columns other than the id and
the text are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Rows of each of the two fitting samples at most.
FIT_ROWS = 6000

_SYMBOLS, _UPPER, _LOWER, _DIGIT, _SPACE, _NEWLINE, _STOP, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b"#$%&*|<>{}[]@^~=+_\\/!")] = _SYMBOLS
_CLASS[65:91] = _UPPER
_CLASS[97:123] = _LOWER
_CLASS[128:] = _LOWER
_CLASS[48:58] = _DIGIT
_CLASS[list(b" \t\r")] = _SPACE
_CLASS[10] = _NEWLINE
_CLASS[list(b".,;:?")] = _STOP
N_FEATURES = 18


def features(texts: pa.Array) -> np.ndarray:
    """Rates of byte classes, word lengths, case and repetition over each whole text."""
    buf, offsets = blocks.text_buffer(texts)
    n, lengths = len(offsets) - 1, np.diff(offsets)
    rows = np.repeat(np.arange(n), lengths)
    counts = np.bincount(rows * 8 + _CLASS[buf], minlength=n * 8).reshape(n, 8).astype(np.float64)
    words = blocks.segment(buf, offsets)
    n_words = np.bincount(words.row, minlength=n).astype(np.float64)

    def per_word(mask: np.ndarray) -> np.ndarray:
        return np.bincount(words.row[mask], minlength=n) / np.maximum(n_words, 1)

    def distinct(row: np.ndarray, key: np.ndarray) -> np.ndarray:
        if not len(key):
            return np.zeros(n)
        _, at = np.unique(key ^ blocks.mix(row.astype(np.uint64) + np.uint64(1)), return_index=True)
        return np.bincount(row[at], minlength=n)

    length = words.end - words.start
    first, last = (buf[words.start], buf[words.end - 1]) if len(length) else (buf[:0], buf[:0])
    repeats = np.zeros(len(length), bool)
    repeats[1:] = (words.hash[1:] == words.hash[:-1]) & (words.row[1:] == words.row[:-1])
    s_row, s_key = blocks.shingles(words)
    n_shingles = np.maximum(np.bincount(s_row, minlength=n), 1)
    size = np.maximum(lengths, 1)
    out = np.column_stack(
        [
            np.sqrt(counts[:, _SYMBOLS] / size),
            counts[:, _UPPER] / np.maximum(counts[:, _UPPER] + counts[:, _LOWER], 1),
            counts[:, _DIGIT] / size,
            counts[:, _SPACE] / size,
            counts[:, _NEWLINE] / size,
            counts[:, _STOP] / size,
            counts[:, _OTHER] / size,
            np.bincount(words.row, weights=length, minlength=n) / np.maximum(n_words, 1) / 10,
            np.log1p(n_words) / 5,
            distinct(words.row, words.hash) / np.maximum(n_words, 1),
            distinct(s_row, s_key) / n_shingles,
            per_word(repeats),
            per_word(_CLASS[first] == _UPPER),
            per_word(_CLASS[last] == _SYMBOLS),
            per_word(length == 1),
            per_word(length > 20),
            per_word(_CLASS[first] == _SYMBOLS),
            (n_words == 0).astype(np.float64),
        ]
    )
    return out.astype(np.float32)


class Model:
    """Standardised features, one hidden layer of tanh units and a logistic output."""

    def __init__(self, mean, scale, w1, b1, w2, b2):
        self.mean, self.scale, self.w1, self.b1, self.w2, self.b2 = mean, scale, w1, b1, w2, b2

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self.standard(x) @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from scores of a positive-against-unlabelled model.

    Where the scores are high there are hardly any negatives, so the ratio of
    the two shares above a threshold bounds the prior from above; the least
    ratio over thresholds that most positives pass is the estimate.
    """
    cuts = np.quantile(positive, np.linspace(0.02, 0.5, 13))
    p = np.array([(positive >= c).mean() for c in cuts])
    u = np.array([(unlabelled >= c).mean() for c in cuts])
    return float(np.clip(np.min(u / np.maximum(p, 1e-9)), 0.05, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, hidden: int = 16, steps: int = 150, rate: float = 0.02, seed: int = 7) -> tuple[Model, float]:
    """The model of least non-negative risk, and the estimated class prior.

    The prior comes from a model of one half of each sample and its scores of
    the other half: scores of rows that a model has seen would make the
    unlabelled ones look too different. Few steps keep both from overfitting.
    """
    rng = np.random.default_rng(seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    prior = None
    for stage in ("prior", "risk"):
        params = [rng.normal(0, 0.4, (positive.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 0.4, hidden), np.zeros(1)]
        model = Model(mean, scale, *params)
        half = 2 if stage == "prior" else 1
        p, u = model.standard(positive[::half]), model.standard(unlabelled[::half])
        moments = [(np.zeros_like(x), np.zeros_like(x)) for x in params]
        for step in range(1, steps + 1):
            hp, hu = np.tanh(p @ params[0] + params[1]), np.tanh(u @ params[0] + params[1])
            fp, fu = hp @ params[2] + params[3], hu @ params[2] + params[3]
            sp, su = 1 / (1 + np.exp(-np.clip(fp, -30, 30))), 1 / (1 + np.exp(-np.clip(fu, -30, 30)))
            if stage == "prior":  # plain positive against unlabelled
                gp, gu = (sp - 1) / len(p), su / len(u)
            else:
                negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
                gu, gp_negative = su / len(u), -prior * sp / len(p)
                if negative >= 0:
                    gp = prior * (sp - 1) / len(p) + gp_negative
                else:  # step back from the part of the risk that went below zero
                    gp, gu = -gp_negative, -gu
            grads = [np.zeros_like(x) for x in params]
            for x, h, g in ((p, hp, gp), (u, hu, gu)):
                back = np.outer(g, params[2]) * (1 - h * h)
                grads[0] += x.T @ back
                grads[1] += back.sum(0)
                grads[2] += h.T @ g
                grads[3] += g.sum()
            for k, (x, g, (m, v)) in enumerate(zip(params, grads, moments, strict=True)):
                g = g + 1e-4 * x
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                params[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        if stage == "prior":
            rest = slice(1, None, 2) if min(len(positive), len(unlabelled)) > 1 else slice(None)
            prior = estimate_prior(model.logit(positive[rest]), model.logit(unlabelled[rest]))
    return model, prior


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document are kept from learning: crc32 of the id leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in blocks.text_slices(batches):
        x = features(part.column(2))
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(list(x), pa.list_(pa.float32()))], ["doc_id", "positive", "x"])


def fit_sample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Features of at most `rows` trusted positives and `rows` unlabelled texts, chosen by a hash of the id and ordered by it.

    Ids whose labels contradict each other aren't trusted; of texts of one id the least is taken.
    """
    order = F.xxhash64("doc_id")
    marked = labels.where(F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = marked.where("quality = 1").select("doc_id").orderBy(order, "doc_id").limit(rows)
    web = docs.where(~held_out(F.col("doc_id"))).select("doc_id").distinct().orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(rows)
    chosen = trusted.withColumn("positive", F.lit(True)).unionByName(web.withColumn("positive", F.lit(False)))
    # `rows` bounds the broadcast side: two lists of ids of a fixed length.
    drawn = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    drawn = drawn.select(F.col("doc_id").cast("long"), "positive", "text")
    got = drawn.mapInArrow(_extract, "doc_id long, positive boolean, x array<float>").toPandas().sort_values("doc_id", kind="stable")
    x = np.stack(got.x) if len(got) else np.zeros((0, N_FEATURES), np.float32)
    is_positive = got.positive.to_numpy(dtype=bool)
    return x[is_positive].astype(np.float64), x[~is_positive].astype(np.float64)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Without trusted positives or without texts nothing can be learnt: every
    score is 0.5 then.
    """
    positive, unlabelled = fit_sample(docs, labels, rows)
    model = fit(positive, unlabelled)[0] if len(positive) and len(unlabelled) else None

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.text_slices(batches):
            x = features(part.column(1)).astype(np.float64)
            s = model.score(x) if model is not None else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(s, pa.float64())], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, rows: int = FIT_ROWS) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    positive, unlabelled = fit_sample(docs, labels, rows)
    model = fit(positive, unlabelled)[0] if len(positive) and len(unlabelled) else None
    at = docs.columns.index("text")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.text_slices(batches):
            if model is None:
                yield part
            else:
                yield part.filter(pa.array(model.score(features(part.column(at)).astype(np.float64)) >= threshold))

    return docs.mapInArrow(accept, docs.schema)
