"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text byte by byte in both directions, across white space,
and labels every position with a language; it is trained in numpy by
backpropagation through time. The probabilities of all positions of a whole
text are pooled by their mean into the document's probabilities.

So that many texts advance together and a very long one needs no long loop,
texts are read in segments of SEGMENT_BYTES. Each direction starts CONTEXT_BYTES
before a segment, where the text has them, and so has its state when it reaches the
first position that counts; every position is labelled once.

Defined results: null texts and texts without a letter are `und` with score 0;
without a labelled document that is short enough to learn from all texts are
`und`; ties go to the first language in order; repeated rows get equal results;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks

#: Fitting sample: labelled documents at most, and their greatest length in bytes.
FIT_ROWS, FIT_BYTES = 1500, 1 << 16
SEGMENT_BYTES, CONTEXT_BYTES = 1024, 64
HIDDEN = 12
#: Segments that advance together.
TOGETHER = 4096
#: Bytes of each passage that the network is trained on.
PASSAGE_BYTES = 48


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Two gated recurrent layers side by side, and a softmax over their states at each position."""

    def __init__(self, languages: list[str], rng: np.random.Generator, hidden: int = HIDDEN):
        self.languages, self.hidden = languages, hidden
        draw = lambda *shape: (rng.normal(0, 1, shape) / np.sqrt(shape[0] if len(shape) > 1 and shape[0] < 256 else 4)).astype(np.float32)
        self.params = {
            "x0": draw(256, 3 * hidden), "u0": draw(hidden, 3 * hidden),
            "x1": draw(256, 3 * hidden), "u1": draw(hidden, 3 * hidden),
            "v": draw(2 * hidden, len(languages)), "c": np.zeros(len(languages), np.float32),
        }

    def _advance(self, rows: np.ndarray, live: np.ndarray, side: int, *, back: bool = False) -> Iterator[tuple[int, np.ndarray]]:
        """(step, states) of one direction; rows come longest first, `live` counts those with a byte at each step.

        Going `back`, each row starts at its own end. The states are overwritten by the next step. Gates and new
        states are apart, so that each operation runs over one block of memory, and by exp, which is faster than tanh.
        """
        h, n = self.hidden, len(rows)
        # Logistic functions are 1 / (1 + exp(-a)), and tanh is 1 - 2 / (1 + exp(2 a)).
        parts = lambda w: [np.ascontiguousarray(w[:, k * h : (k + 1) * h] * w.dtype.type(f)) for k, f in enumerate((-1, -1, 2))]
        (x_z, x_r, x_new), (u_z, u_r, u_new) = parts(self.params[f"x{side}"]), parts(self.params[f"u{side}"])
        columns = np.ascontiguousarray(rows.T)
        states, *space = (np.zeros((n, h), x_z.dtype) for _ in range(5))
        for t in range(len(live) - 1, -1, -1) if back else range(len(live)):
            at = columns[t, : live[t]]
            state, z, r, new, b = states[: len(at)], *(x[: len(at)] for x in space)
            with np.errstate(over="ignore"):  # beyond the greatest number a quotient is 0, as it should be
                for gate, x, u in ((z, x_z, u_z), (r, x_r, u_r)):
                    np.take(x, at, 0, out=gate, mode="clip")
                    gate += np.matmul(state, u, out=b)
                    np.exp(gate, out=gate)
                    gate += 1
                np.take(x_new, at, 0, out=new, mode="clip")
                np.matmul(state, u_new, out=b)
                b /= r
                new += b
                np.exp(new, out=new)
            new += 1
            np.divide(-2, new, out=new)
            new += 1
            state -= new
            state /= z
            state += new
            yield t, state

    def states(self, rows: np.ndarray, live: np.ndarray, side: int) -> np.ndarray:
        """States (steps x rows x hidden) of one direction."""
        out = np.zeros((len(live), len(rows), self.hidden), np.float32)
        for t, state in self._advance(rows, live, side):
            out[t, : live[t]] = state
        return out

    def label(self, rows: np.ndarray, length: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sums of the probabilities of the positions from `begin` to `end` of each row of bytes (rows x languages)."""
        p, out = self.params, np.zeros((len(rows), len(self.languages)), np.float32)
        order = np.argsort(-length, kind="stable")
        half = [np.ascontiguousarray(p["v"][: self.hidden].T), np.ascontiguousarray(p["v"][self.hidden :].T)]
        for k in range(0, len(rows), TOGETHER):
            at = order[k : k + TOGETHER]
            n, first, last = length[at].astype(np.int64), begin[at], end[at]
            steps = int(n[0])
            w, live = rows[at, :steps], np.searchsorted(-n, -np.arange(1, steps + 1), side="right")
            ahead = np.empty((steps, len(self.languages), len(at)), np.float32)
            for t, state in self._advance(w, live, 0):
                ahead[t, :, : live[t]] = half[0] @ state.T + p["c"][:, None]
            total = np.zeros((len(self.languages), len(at)), np.float32)
            for t, state in self._advance(w, live, 1, back=True):
                m = live[t]
                e = half[1] @ state.T
                e += ahead[t, :, :m]
                e -= e.max(0)
                np.exp(e, out=e)
                e *= ((t >= first[:m]) & (t < last[:m])) / e.sum(0)
                total[:, :m] += e
            out[at] = total.T
        return out

    def gradient(self, words: np.ndarray, length: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross-entropy over all positions, by backpropagation through time."""
        p, h, n, steps = self.params, self.hidden, len(words), int(length.max())
        mask = (np.arange(steps)[:, None] < length[None, :]).astype(np.float32)[:, :, None]
        there = np.maximum(length[:, None] - 1 - np.arange(steps), 0)
        inputs = [words[:, :steps], np.take_along_axis(words, there, 1)]
        tapes, sides = [], []
        for side in (0, 1):
            state, tape = np.zeros((n, h), np.float32), []
            outs = np.zeros((steps, n, h), np.float32)
            for t in range(steps):
                a, b = p[f"x{side}"][inputs[side][:, t]], state @ p[f"u{side}"]
                gates = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
                new = np.tanh(a[:, 2 * h :] + gates[:, h:] * b[:, 2 * h :])
                tape.append((state, gates, new, b))
                state = state + mask[t] * ((1 - gates[:, :h]) * (new - state))
                outs[t] = state
            tapes.append(tape)
            sides.append(outs)
        aligned = sides[1][there.T, np.arange(n)[None, :]]
        both = np.concatenate([sides[0], aligned], axis=2)
        logits = both @ p["v"] + p["c"]
        e = np.exp(logits - logits.max(2, keepdims=True))
        d = e / e.sum(2, keepdims=True)
        d[:, np.arange(n), target] -= 1
        d *= mask / mask.sum()
        grads = {k: np.zeros_like(x) for k, x in p.items()}
        grads["v"], grads["c"] = np.einsum("tnh,tnl->hl", both, d), d.sum((0, 1))
        d_both = d @ p["v"].T
        d_back = np.zeros((steps, n, h), np.float32)
        np.add.at(d_back, (there.T, np.arange(n)[None, :]), d_both[:, :, h:] * mask)
        for side, d_out in ((0, d_both[:, :, :h]), (1, d_back)):
            flow, steps_a = np.zeros((n, h), np.float32), np.zeros((steps, n, 3 * h), p["v"].dtype)
            for t in range(steps - 1, -1, -1):
                state, gates, new, b = tapes[side][t]
                z, r = gates[:, :h], gates[:, h:]
                flow = flow + d_out[t] * mask[t]
                live = flow * mask[t]
                d_new = live * (1 - z) * (1 - new * new)
                d_z = live * (state - new) * z * (1 - z)
                d_r = d_new * b[:, 2 * h :] * r * (1 - r)
                d_a = np.concatenate([d_z, d_r, d_new], axis=1)
                d_b = np.concatenate([d_z, d_r, d_new * r], axis=1)
                steps_a[t] = d_a
                grads[f"u{side}"] += state.T @ d_b
                flow = live * z + flow * (1 - mask[t]) + d_b @ p[f"u{side}"].T
            seen, flat = np.ascontiguousarray(inputs[side].T).reshape(-1), steps_a.reshape(-1, 3 * h)
            grads[f"x{side}"] += np.stack([np.bincount(seen, weights=flat[:, k], minlength=256) for k in range(3 * h)], axis=1).astype(flat.dtype)
        return grads


def gather(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """(ranges x longest) bytes of ranges of a buffer, 0 beyond their ends."""
    width = np.arange(int(length.max()) if len(length) else 0)
    return np.where(width < length[:, None], buf[np.minimum(start[:, None] + width, len(buf) - 1)], 0).astype(np.uint8)


def segments(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, length, begin, end): byte ranges of segments with their context, and the positions in them that count."""
    sizes = np.diff(offsets)
    pieces = -(-sizes // SEGMENT_BYTES)
    row = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = offsets[row] + nth * SEGMENT_BYTES
    last = np.minimum(first + SEGMENT_BYTES, offsets[row + 1])
    start, stop = np.maximum(first - CONTEXT_BYTES, offsets[row]), np.minimum(last + CONTEXT_BYTES, offsets[row + 1])
    return row, start, stop - start, first - start, last - start


def probabilities(network: Network, texts: pa.Array) -> np.ndarray:
    """Mean of the probabilities of all positions of each text (texts x languages); zero for an empty one."""
    raw, offsets = blocks.text_buffer(texts)
    buf = blocks.fold_case(raw)
    row, start, length, begin, end = segments(offsets)
    out = np.zeros((len(texts), len(network.languages)))
    for k in range(0, len(row), TOGETHER):
        part = slice(k, k + TOGETHER)
        sums = network.label(gather(buf, start[part], length[part]), length[part], begin[part], end[part])
        np.add.at(out, row[part], sums)
    return out / np.maximum(np.diff(offsets), 1)[:, None]


def fit(texts: list[str], langs: list[str], *, steps: int = 300, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Network:
    """Train on passages drawn evenly from the languages; every position carries its document's language."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(langs))
    network = Network(languages, rng)
    raw, offsets = blocks.text_buffer(pa.array(texts, pa.string()))
    buf, sizes = blocks.fold_case(raw), np.diff(offsets)
    target = np.array([languages.index(x) for x in langs])
    pools = [np.flatnonzero((target == k) & (sizes > 0)) for k in range(len(languages))]
    pools = [p for p in pools if len(p)]
    moments = {k: (np.zeros_like(x), np.zeros_like(x)) for k, x in network.params.items()}
    for step in range(1, steps + 1):
        if not pools:
            break
        at = np.concatenate([rng.choice(p, batch // len(pools) + 1) for p in pools])
        start = offsets[at] + (rng.random(len(at)) * np.maximum(sizes[at] - PASSAGE_BYTES + 1, 1)).astype(np.int64)
        length = np.minimum(PASSAGE_BYTES, offsets[at + 1] - start)
        order = np.argsort(-length)
        grads = network.gradient(gather(buf, start[order], length[order]), length[order], target[at[order]])
        slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for k, g in grads.items():
            g = np.clip(g, -1, 1)
            m, v = moments[k]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            network.params[k] -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return network


def held_out(doc_id: Column) -> Column:
    """Whether the language of a document is kept from learning: crc32 of the id leaves 1 by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame, rows: int = FIT_ROWS) -> Network | None:
    """A network from at most `rows` labelled documents, chosen by a hash of the id."""
    text = F.col("text").cast("string")
    usable = docs.select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")) & (F.octet_length("text") <= FIT_BYTES))
    picked = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # `rows` bounds the broadcast side, and one text is taken of each id.
    drawn = usable.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min(F.struct("text", "lang")).alias("d")).select("doc_id", "d.text", "d.lang").toPandas().sort_values("doc_id", kind="stable")
    return fit(drawn.text.tolist(), drawn.lang.tolist()) if len(drawn) else None


def languages(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    network = fit_documents(docs, rows)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(network.languages, dtype=object)
        for part in blocks.text_slices(batches):
            n, lettered = part.num_rows, np.asarray(part.column(2))
            texts = pc.if_else(part.column(2), part.column(1), pa.scalar("", pa.string()))
            pooled = probabilities(network, texts)
            best = pooled.argmax(1)
            score = np.where(lettered, np.clip(pooled[np.arange(n), best], 0, 1), 0.0)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.where(lettered, names[best], "und"), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("lettered", F.col("text").rlike(r"\p{L}"))
    if network is None:
        out = rows_in.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        out = rows_in.mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
