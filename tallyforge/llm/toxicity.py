"""Toxic spans by a linear-chain conditional random field over words.

Words carry hashed features: the word itself and its first and last bytes.
Labelled tokens for training come from the labelled documents by distant
supervision: a feature that occurs in toxic documents almost only, and more than
chance would have it, marks the words that carry it there; how strict chance is
taken is chosen by cross-fitting on the labelled documents. The chain (two states) is trained on sentences by
its exact gradient; forward-backward marginals of every word of a text then
give offending offsets, and their sum and maximum give the document's score
through a logistic curve fitted on the same labelled documents.

A chain ends with a sentence or after CHAIN words, so that a text of any length
needs bounded memory for its chains.

Defined results: a null or empty text has no word, hence no span, and gets the
curve's score for no evidence; repeated rows get equal results; without labels
of both kinds, on texts short enough to learn from, every score is 0; a score at
the threshold is toxic; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Fitting sample: documents of each label at most, and their greatest length in bytes.
FIT_ROWS, FIT_BYTES = 1000, 1 << 16
CHAIN = 128
BUCKETS = 1 << 18
#: A marking feature occurs in so many toxic documents, and these are such a share of its documents.
LEAST_DOCS, LEAST_SHARE = 8, 0.8
N_FEATURES = 5
#: False-discovery rates of marking features, one of which is chosen on the learning documents.
LIMITS = (1e-4, 3e-3, 5e-2)

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_WORD[128:] = True
_BREAK = np.zeros(256, bool)
_BREAK[list(b".!?\n")] = True


class Tokens:
    """Words of a slice of texts, their hashed features and the chains they form."""

    def __init__(self, texts: pa.Array):
        raw, offsets = blocks.text_buffer(texts)
        buf = blocks.fold_case(raw)
        words = blocks.segment(buf, offsets, _WORD[buf])
        self.buf, self.offsets, self.start, self.end, self.row = raw, offsets, words.start, words.end, words.row
        self.n_rows = len(offsets) - 1
        if not len(self.start):
            self.features = np.zeros((0, N_FEATURES), np.int32)
            self.first, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return
        ranged = blocks.RangeHash(buf)
        ranges = [(self.start, self.end)]
        ranges += [(self.start, np.minimum(self.start + k, self.end)) for k in (4, 6, 8)]
        ranges += [(np.maximum(self.end - 4, self.start), self.end)]
        self.features = np.column_stack([(blocks.mix(ranged(a, b) + np.uint64(k)) % np.uint64(BUCKETS)).astype(np.int32) for k, (a, b) in enumerate(ranges)])
        breaks = np.concatenate([[0], np.cumsum(_BREAK[raw])])
        new = np.ones(len(self.start), bool)
        new[1:] = (self.row[1:] != self.row[:-1]) | (breaks[self.start[1:]] > breaks[self.end[:-1]])
        sentence = np.flatnonzero(new)
        at = np.arange(len(new)) - np.repeat(sentence, np.diff(np.append(sentence, len(new))))
        self.first = np.flatnonzero(at % CHAIN == 0)
        self.length = np.diff(np.append(self.first, len(new)))


def marginals(emission: np.ndarray, first: np.ndarray, length: np.ndarray, transition: np.ndarray, pairs: bool = False):
    """P(state 1) of every word; with `pairs` also the expected transitions (2 x 2) and log partition.

    `emission` is the score of state 1 over state 0; `transition[i, j]` of a
    step from i to j. Chains are advanced together, the longest ones first.
    """
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    n, steps = len(first), int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(1, steps + 1), side="right")
    weights = np.exp(transition)
    boost = np.exp(np.clip(emission, -30, 30))
    forward, scale = np.empty((len(emission), 2)), np.empty(len(emission))
    state = np.ones((n, 2))
    for t in range(steps):
        m = live[t]
        state = state[:m] if t == 0 else state[:m] @ weights
        state[:, 1] *= boost[first[:m] + t]
        total = state.sum(1)
        state = state / total[:, None]
        forward[first[:m] + t], scale[first[:m] + t] = state, total
    out, expected = np.empty(len(emission)), np.zeros((2, 2))
    back = np.ones((n, 2))
    for t in range(steps - 1, -1, -1):
        m = live[t]
        at = first[:m] + t
        now = np.ones((m, 2))
        if t + 1 < steps:
            k = live[t + 1]
            nxt = back[:k].copy()
            nxt[:, 1] *= boost[at[:k] + 1]
            nxt /= scale[at[:k] + 1][:, None]
            now[:k] = nxt @ weights.T
            if pairs:
                expected += (forward[at[:k]].T @ nxt) * weights
        back[:m] = now
        both = forward[at] * now
        out[at] = both[:, 1] / both.sum(1)
    return (out, expected, np.log(scale).sum()) if pairs else out


class Model:
    def __init__(self, weights: np.ndarray, bias: float, transition: np.ndarray, curve: np.ndarray):
        self.weights, self.bias, self.transition, self.curve = weights, bias, transition, curve

    def words(self, tokens: Tokens) -> np.ndarray:
        return marginals(self.weights[tokens.features].sum(1) + self.bias, tokens.first, tokens.length, self.transition)

    def evidence(self, tokens: Tokens, p: np.ndarray) -> np.ndarray:
        most = np.zeros(tokens.n_rows)
        np.maximum.at(most, tokens.row, p)
        strong = np.where(p > 0.2, p, 0)  # tails of thousands of harmless words don't add up
        total, n = np.bincount(tokens.row, weights=strong, minlength=tokens.n_rows), np.bincount(tokens.row, minlength=tokens.n_rows)
        return np.column_stack([np.log1p(total), np.minimum(total, 4), most, np.log1p(n) / 5, np.ones(tokens.n_rows)])

    def scores(self, tokens: Tokens, p: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.evidence(tokens, p) @ self.curve, -30, 30)))


def marking(bad: np.ndarray, good: np.ndarray, limit: float) -> np.ndarray:
    """Which features mark: their share of toxic documents is high, and beyond chance with a false-discovery rate of `limit`.

    A bound on the rate, unlike one on any false mark, lets through what is rare
    where many marks are true, such as those of a language with few labels.
    """
    total = bad + good
    at = np.clip(bad / np.maximum(total, 1), 1e-9, 1 - 1e-9)
    tried = np.flatnonzero(bad >= LEAST_DOCS)
    chance = np.where(at > 0.5, np.exp(-total * (at * np.log(2 * at) + (1 - at) * np.log(2 * (1 - at)))), 1.0)[tried]  # Chernoff's bound
    ordered = np.sort(chance)
    found = np.flatnonzero(ordered <= limit * np.arange(1, len(ordered) + 1) / max(1, len(ordered)))
    marks = np.zeros(len(bad), bool)
    if len(found):
        marks[tried[chance <= ordered[found[-1]]]] = True
    return marks & (at >= LEAST_SHARE)


def choose_limit(texts: list[str], toxic: np.ndarray) -> float:
    """The limit on false marks under which models of two thirds of the learning documents do best on the other third.

    Toxic and other documents weigh alike, of equal limits the strictest wins.
    """
    right = np.zeros((len(LIMITS), 2))
    part = np.arange(len(texts)) % 3
    for k in range(3):
        here = np.flatnonzero(part != k)
        if toxic[here].all() or not toxic[here].any():
            return LIMITS[0]
        away = np.flatnonzero(part == k)
        tokens = Tokens(pa.array([texts[i] for i in away], pa.string()))
        for at, limit in enumerate(LIMITS):
            model = fit([texts[i] for i in here], toxic[here], limit=limit, epochs=5, chains=10_000)
            said = model.scores(tokens, model.words(tokens)) >= 0.5
            right[at] += (said & toxic[away]).sum(), (~said & ~toxic[away]).sum()
    return LIMITS[int(np.argmax((right / np.maximum([toxic.sum(), (~toxic).sum()], 1)).mean(1)))]


def fit(texts: list[str], toxic: np.ndarray, share: float = 0.5, *, limit: float = LIMITS[0], epochs: int = 12, chains: int = 30_000, seed: int = 11) -> Model:
    rng = np.random.default_rng(seed)
    tokens = Tokens(pa.array(texts, pa.string()))
    label = toxic[tokens.row]
    marked = np.zeros(len(label), bool)
    for k in range(N_FEATURES):
        pair = np.unique(tokens.row * BUCKETS + tokens.features[:, k].astype(np.int64))
        row, feature = pair // BUCKETS, pair % BUCKETS
        bad = np.bincount(feature[toxic[row]], minlength=BUCKETS)
        good = np.bincount(feature[~toxic[row]], minlength=BUCKETS) * (toxic.sum() / max((~toxic).sum(), 1))
        marked |= marking(bad, good, limit)[tokens.features[:, k]]
    gold = (marked & label).astype(np.float64)
    chain = np.repeat(np.arange(len(tokens.first)), tokens.length)
    has = np.bincount(chain, weights=gold, minlength=len(tokens.first)) > 0
    chosen = np.concatenate([rng.permutation(np.flatnonzero(has))[: chains // 2], rng.permutation(np.flatnonzero(~has))[: chains // 2]])
    weights, bias, transition = np.zeros(BUCKETS), -2.0, np.zeros((2, 2))
    seen_w, seen_b, seen_t = np.full(BUCKETS, 1e-8), 1e-8, np.full((2, 2), 1e-8)
    for _ in range(epochs):
        rng.shuffle(chosen)
        for part in np.array_split(chosen, max(1, len(chosen) // 1500)):
            length = tokens.length[part]
            first = np.cumsum(length) - length
            at = np.repeat(tokens.first[part] - first, length) + np.arange(length.sum())
            f, y = tokens.features[at], gold[at]
            p, expected, _ = marginals(weights[f].sum(1) + bias, first, length, transition, pairs=True)
            step = np.ones(len(y), bool)
            step[first] = False
            here, before = y[step].astype(int), y[np.flatnonzero(step) - 1].astype(int)
            observed = np.bincount(before * 2 + here, minlength=4).reshape(2, 2)
            g = np.bincount(f.reshape(-1), weights=np.repeat(p - y, N_FEATURES), minlength=BUCKETS) / len(part) + 1e-6 * weights
            gb, gt = (p - y).sum() / len(part), (expected - observed) / len(part)
            seen_w += g * g
            seen_b += gb * gb
            seen_t += gt * gt
            weights -= 0.3 * g / np.sqrt(seen_w)
            bias -= 0.3 * gb / np.sqrt(seen_b)
            transition = transition - 0.3 * gt / np.sqrt(seen_t)
    model = Model(weights, bias, transition, np.zeros(5))
    x = model.evidence(tokens, model.words(tokens))
    # Toxic documents are over-represented in the sample; weights give the curve their share among all labels.
    each = np.where(toxic, share / max(toxic.sum(), 1), (1 - share) / max((~toxic).sum(), 1))
    curve, moment, spread = np.zeros(5), np.zeros(5), np.zeros(5)
    for t in range(1, 1501):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        g = x.T @ ((p - toxic) * each) + 1e-4 * curve
        moment, spread = 0.9 * moment + 0.1 * g, 0.99 * spread + 0.01 * g * g
        curve = curve - 0.05 * (moment / (1 - 0.9**t)) / (np.sqrt(spread / (1 - 0.99**t)) + 1e-8)
    model.curve = curve
    return model


def held_out(doc_id: Column) -> Column:
    """Whether the labels of a document are kept from learning: crc32 of the id leaves no remainder by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model | None:
    """A model from at most `rows` toxic and `rows` other labelled documents, chosen by a hash of the id.

    Ids whose labels contradict each other teach nothing; of texts of one id the least is taken.
    """
    usable = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most").drop("most")
    share = usable.agg(F.avg("toxic").alias("share")).first().share
    order = F.xxhash64("doc_id")
    picked = usable.where("toxic = 1").orderBy(order, "doc_id").limit(rows).unionByName(usable.where("toxic = 0").orderBy(order, "doc_id").limit(rows))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # `rows` bounds the broadcast side.
    drawn = docs.select("doc_id", text.alias("text")).where(F.octet_length("text") <= FIT_BYTES).join(F.broadcast(picked), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).toPandas()
    toxic = drawn.toxic.to_numpy() == 1
    if not toxic.any() or toxic.all():
        return None
    order = np.argsort(drawn.doc_id.to_numpy(), kind="stable")
    texts = [drawn.text.iloc[i] for i in order]
    return fit(texts, toxic[order], float(share), limit=choose_limit(texts, toxic[order]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every document; spans are code points, end exclusive."""
    model = fit_documents(docs, labels, rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in blocks.text_slices(batches):
            n = part.num_rows
            if model is None:
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.zeros(n)), pa.array([[]] * n, pa.list_(pa.list_(pa.int32())))], ["doc_id", "score", "spans"])
                continue
            tokens = Tokens(part.column(1))
            p = model.words(tokens)
            hit = np.flatnonzero(p >= 0.5)
            points = np.concatenate([[0], np.cumsum((tokens.buf & 0xC0) != 0x80)])
            row = tokens.row[hit]
            base = points[tokens.offsets[row]]
            spans: list[list[list[int]]] = [[] for _ in range(n)]
            for r, a, b in zip(row.tolist(), (points[tokens.start[hit]] - base).tolist(), (points[tokens.end[hit]] - base).tolist(), strict=True):
                spans[r].append([a, b])
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.scores(tokens, p)), pa.array(spans, pa.list_(pa.list_(pa.int32())))], ["doc_id", "score", "spans"])

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows_in.mapInArrow(score, "doc_id long, score double, spans array<array<int>>")
    joined = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s.cast("array<string>"))), ",")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), joined.alias("spans"))
