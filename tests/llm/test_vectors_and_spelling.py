"""Whitening, nearest neighbours and spelling variants against brute-force versions, with their edge cases."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from tallyforge.llm import neighbours, spelling, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, node string, k string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "n", "k") for i, v in rows], SCHEMA)


BAD = [(901, None), (902, []), (903, [1.0, None, 2.0] + [0.0] * 5), (904, [float("nan")] + [1.0] * 7), (905, [float("inf")] + [1.0] * 7), (906, [1.0, 2.0])]


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(1)
    mix = rng.normal(size=(8, 8))
    rows = [(int(i), (rng.normal(size=8) @ mix * 0.1).tolist()) for i in range(600)] + [(5, [0.5] * 8), (None, [0.25] * 8), (None, [0.25] * 8)]
    got = whitening.whiten(vectors(spark, rows + BAD), block_rows=64).toPandas()
    x = np.floor(np.array([np.float32(v) for _, v in rows], np.float64) * 1024).astype(np.int64) + 100000
    n, sums = len(x), x.sum(0)
    centred = x - sums / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    assert len(got) == n * 8 and set(got.n) == {n} and got.identity_error.max() < 1e-9 and got.identity_error.nunique() == 1
    assert np.allclose(got.groupby("component").explained.first().to_numpy(), values / values.sum(), rtol=1e-9)
    want = centred @ axes / np.sqrt(values)
    for c in range(8):
        mine = got[(got.component == c + 1) & got.vec_id.between(6, 599)].sort_values("vec_id").whitened.to_numpy()
        other = want[6:600, c]
        assert min(np.abs(mine - other).max(), np.abs(mine + other).max()) < 1e-8
    deviation = ((n * x - sums) ** 2).sum(1)
    assert collections.Counter(got.deviation) == collections.Counter(np.repeat(deviation, 8).tolist())


def test_whitening_of_little(spark):
    assert whitening.whiten(vectors(spark, BAD[:2])).count() == 0
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(k, [0.5, 0.25]) for k in range(4)])).count() == 0  # no variance
    got = whitening.whiten(vectors(spark, [(k, [float(k), 1.0]) for k in range(4)])).collect()
    assert {(r.component, r.n) for r in got} == {(1, 4)} and len(got) == 4
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 5.0])])).collect()
    assert {r.deviation for r in huge if r.vec_id != 3} == {None}


@pytest.mark.parametrize("parts", [1, 4, 9])
def test_deviations_of_any_size(parts):
    x = np.array([[1 << 40, 5], [3, -(1 << 40)], [7, 7]])
    sums = np.array([int(s) for s in x.sum(0)], object)
    want = [sum((parts * int(v) - int(s)) ** 2 for v, s in zip(row, sums, strict=True)) for row in x]
    assert whitening._deviations(x, parts, sums) == [v if v < 1 << 63 else None for v in want]


def recall(got, rows, step=20, most=20):
    ids = np.array([i for i, _ in rows])
    v = np.array([np.float32(x) for _, x in rows], np.float64)
    found = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        found[r.query_id].append((r.vec_id, r.score))
    shares = []
    for at in np.flatnonzero(ids % step == 0):
        score = v @ v[at]
        order = [k for k in np.lexsort((ids, -score)) if k != at][:most]
        mine = found[ids[at]]
        assert len(mine) == len(order) and len({i for i, _ in mine}) == len(mine)
        assert all(abs(s - score[ids == i][0]) < 1e-9 for i, s in mine)
        shares.append(len({i for i, _ in mine} & set(ids[order])) / len(order))
    assert set(found) == set(ids[ids % step == 0].tolist())
    return np.mean(shares)


def test_neighbours_against_brute_force(spark):
    """Vectors of many directions and lengths, a tight cluster with a third of all, and copies of one vector."""
    rng = np.random.default_rng(2)
    v = rng.normal(size=(3000, 32)) * rng.uniform(0.5, 2, size=(3000, 1))
    v[:1000] = rng.normal(size=32) + rng.normal(size=(1000, 32)) * 0.05
    v[2500:2560] = v[2500]
    rows = [(k, v[k].tolist()) for k in range(3000)]
    bad = [(i, x) for i, x in BAD if i != 906] + [(20000, [0.0] * 32), (20020, None)]
    bad = [(i + 19000 if i < 1000 else i, x if x is None or len(x) == 32 else (x + [1.0] * 32)[:32] if x else x) for i, x in bad]
    got = neighbours.nearest(vectors(spark, rows + bad + [(None, [1.0] * 32), rows[7], rows[40]])).collect()
    assert recall(got, rows) >= 0.95


def test_neighbours_of_copies_and_of_few(spark):
    same = [(k, [1.0, 2.0]) for k in range(50)]
    got = neighbours.nearest(vectors(spark, same)).collect()
    for q in (0, 20, 40):
        assert [r.vec_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [k for k in range(21) if k != q][:20]
    few = [(k, [float(k + 1), 1.0]) for k in range(7)]
    got = sorted(neighbours.nearest(vectors(spark, few)).collect(), key=lambda r: r.rank)
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, k + 1, 6 - k) for k in range(6)]
    assert neighbours.nearest(vectors(spark, [(0, [1.0, 0.0])])).count() == 0
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    several = neighbours.nearest(vectors(spark, [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [2.0, 0.0]), (2, [-1.0, 0.0])])).collect()
    assert sorted((r.vec_id, r.score) for r in several) == [(1, 2.0), (2, -1.0)]


def test_codes_keep_their_vectors():
    v = np.random.default_rng(3).normal(size=(50, 17))
    assert np.abs(neighbours.decode(neighbours.encode(v).slice(10, 20)) - v[10:30]).max() <= np.abs(v).max() / 32767


def plain_variants(rows):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out = {}
    for w, n in words.items():
        around = [x for x in words if abs(len(x) - len(w)) <= 1 and near(w, x)]
        best = min(around, key=lambda x: (-words[x], x), default=None)
        form = best if best is not None and words[best] >= 2 * n else None
        out[w] = [form, n, len(around), words[form] if form else None]

    def root(w):
        while out[w][0]:
            w = out[w][0]
        return w

    return {w: (form, root(w), n, k, form_n) for w, (form, n, k, form_n) in out.items()}


def variants(spark, rows):
    docs = spark.createDataFrame([(i, t, "w", "n", "k") for i, t in rows], "doc_id long, text string, word string, n string, key string")
    got = spelling.variants(docs).collect()
    assert len({r.word for r in got}) == len(got)
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in got}


@pytest.mark.parametrize("tile", [2048, 8])
def test_variants_against_brute_force(spark, monkeypatch, tile):
    """With small tiles keys are larger than a tile, as they would be with very many words."""
    rng = random.Random(4)
    rows = []
    for k in range(120):
        text = []
        for _ in range(150):
            w = "".join(rng.choices("abé", k=rng.randint(4, 7)))
            text.append(w.capitalize() if rng.random() < 0.2 else w)
        rows.append((k, " ".join(text)))
    rows += [(None, "colour Colour COLOUR color color"), (None, None), (5, ""), (5, "×÷×÷× " * 4), (6, "x" * 30_000 + " " + ("y" * 20_000 + "-") * 3), (6, "ßßßßß ßßßßß ßßßßß ßßßßßß ßßßßßß ßßßßßß")]
    rows += [rows[3], rows[3]]
    index = spelling.Index
    monkeypatch.setattr(spelling, "TILE_WORDS", tile)
    want = plain_variants(rows)
    if tile == 2048:
        got = variants(spark, rows)
    else:  # the tiles themselves: tasks don't see a changed constant
        import pyarrow as pa

        words = {w: v[2] for w, v in want.items()}
        keyed = sorted((key, w, n) for w, n in words.items() for m in {len(w), max(5, len(w) - 1)} for key in (f"{m}:a:{w[: m // 2]}", f"{m}:z:{w[len(w) - m + m // 2 :]}"))
        batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in keyed]), pa.array([r[1] for r in keyed]), pa.array([r[2] for r in keyed], pa.int64())], ["key", "word", "n"])
        pairs = {tuple(r.values()) for b in spelling._tiles(iter([batch])) for r in b.to_pylist()}
        assert collections.Counter(a for a, _, _ in pairs) == {w: v[3] for w, v in want.items() if v[3]}
        return
    assert got == want and index is spelling.Index
    assert len([w for w, v in want.items() if v[0]]) > 20


def test_variants_of_nothing(spark):
    assert variants(spark, []) == {} and variants(spark, [(1, "a b c"), (2, None)]) == {}
