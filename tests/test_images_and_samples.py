"""Preparation of scanned pages, amounts in words, and samples that keep what concerns them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.functions import images
from tallyforge.functions import text as X
from tallyforge.operators import subset
from tallyforge.sources import documents


def _page(angle, seed=0, specks=0.004, size=(360, 300)):
    rng = np.random.default_rng(seed)
    page = np.full(size, 235, np.uint8)
    for top in range(24, size[0] - 24, 11):
        at = 16
        while at < size[1] - 30:
            n = int(rng.integers(8, 34))
            page[top : top + 4, at : min(at + n, size[1] - 16)] = 40
            at += n + 5
    page = images.turned(page, -angle) if angle else page
    return np.where(rng.random(page.shape) < specks, 0, page).astype(np.uint8)


@pytest.mark.parametrize("angle", [x / 4 for x in range(-12, 13)])
def test_planted_angles(angle):
    page = _page(angle, seed=int(angle * 4) + 20)
    assert abs(images.skew(page) - angle) <= 0.25
    made = images.prepared(page)
    assert abs(images.skew(made)) <= 0.25 and set(np.unique(made)) <= {0, 255}


def test_large_page_is_searched_on_a_smaller_copy():
    page = np.kron(_page(1.5), np.ones((5, 5), np.uint8))
    assert abs(images.skew(page) - 1.5) <= 0.25


def test_pages_without_ink():
    for page in (np.zeros((0, 0), np.uint8), np.full((20, 30), 255, np.uint8), np.full((20, 30), 7, np.uint8), np.zeros((1, 1), np.uint8)):
        assert images.skew(page) == 0.0
        assert images.prepared(page).shape == page.shape


def test_median_and_tones_in_the_plain_way():
    rng = np.random.default_rng(3)
    page = rng.integers(0, 256, (images.STRIP + 9, 13)).astype(np.uint8)
    padded = np.pad(page, 1, mode="edge")
    plain = [[sorted(padded[i : i + 3, j : j + 3].ravel())[4] for j in range(page.shape[1])] for i in range(page.shape[0])]
    assert (images.despeckled(page) == np.array(plain)).all()
    tones = np.repeat(np.array([10, 60, 110, 200], np.uint8), [1, 49, 49, 1]).reshape(10, 10)
    assert sorted(np.unique(images.stretched(tones))) == [0, 255]
    assert (images.turned(page, 0.0) == page).all()


def test_scans_of_any_kind(spark):
    page = _page(-1.0)
    rows = [("good", page.shape[1], page.shape[0], page.tobytes()), ("null", 3, 3, None), ("short", 4, 4, b"abc"), ("unsized", None, 2, b"ab"), ("empty", 0, 0, b"")]
    scans = spark.createDataFrame(rows, "source_file string, width int, height int, pixels binary")
    got = {r.source_file: r for r in images.prepare_scans(scans).collect()}
    assert got.keys() == {r[0] for r in rows} and abs(got["good"].angle + 1.0) <= 0.25
    assert bytes(got["good"].pixels) == images.prepared(page).tobytes()
    assert [(got[k].pixels, got[k].angle) for k in ("null", "short", "unsized")] == [(None, None)] * 3
    assert (bytes(got["empty"].pixels), got["empty"].angle, got["unsized"].width) == (b"", 0.0, None)
    assert images.prepare_scans(scans.limit(0)).count() == 0


def test_scan_readers(spark, tmp_path):
    """A page that lies askew is read only once it is level; a clean one isn't tried again."""
    text = "From: Harbour Goods Ltd\\nInvoice No: HG-1\\nInvoice date: 2025-03-14\\nTotal due: 5.00"
    for name, angle in (("level.pdf", 0.0), ("askew.pdf", 2.0), ("never.pdf", 9.0)):
        np.save(tmp_path / "page.npy", _page(angle))
        (tmp_path / "page.npy").rename(tmp_path / name)

    def raster(data):
        import io

        return np.load(io.BytesIO(data))

    def recognise(page, mode):
        whole = abs(images.skew(page)) <= 0.3
        return text.replace("\\n", "\n") if whole and mode == "block" else "From: Harbour Goods Ltd" if mode == "column" else None

    got = documents.read_invoices(spark, str(tmp_path), lambda data: None, documents.scan_readers(raster, recognise)).collect()
    assert {r.source_file: (r.method, "HG-1" in r.text) for r in got} == {"level.pdf": ("ocr", True), "askew.pdf": ("ocr", True), "never.pdf": ("ocr", False)}


WORDS = [
    (0.0, "Zero eur and 00/100"), (0.05, "Zero eur and 05/100"), (13.5, "Thirteen eur and 50/100"), (20.0, "Twenty eur and 00/100"), (99.99, "Ninety-nine eur and 99/100"),
    (100.0, "One hundred eur and 00/100"), (1000.01, "One thousand eur and 01/100"), (1015.0, "One thousand fifteen eur and 00/100"), (-342119.4, "Minus three hundred forty-two thousand one hundred nineteen eur and 40/100"),
    (1e6, "One thousand thousand eur and 00/100"), (2000001.0, "Two thousand thousand one eur and 00/100"), (None, None), (float("nan"), None), (float("inf"), None), (1e300, None),
]


def test_amounts_in_words(spark):
    rows = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(WORDS)], "k int, amount double")
    got = {r.k: r.words for r in rows.select("k", X.amount_words(F.col("amount"), F.lit("EUR")).alias("words")).collect()}
    assert got == {k: w for k, (_, w) in enumerate(WORDS)}


def _choose(spark, files, share):
    return sorted(r.key for r in subset.choose(spark.createDataFrame(files, "key long, planted boolean"), share).collect())


def test_samples(spark):
    import hashlib

    files = [(k, k % 10 == 0) for k in range(100)]
    others = sorted((hashlib.md5(str(k).encode()).hexdigest(), k) for k, p in files if not p)
    assert _choose(spark, files, 0.3) == sorted([k for k, p in files if p] + [k for _, k in others[:20]])
    assert _choose(spark, files, 0.05) == [k for k, p in files if p]
    assert _choose(spark, [(1, None), (None, False), (3, True)], 1.0) == [1, 3]
    assert _choose(spark, [], 0.5) == []


def test_rows_that_concern_a_sample(spark):
    rows = spark.createDataFrame([(1, [5]), (2, [6]), (3, [5, 6]), (4, [7, 8]), (5, []), (6, None), (7, [5, 5])], "row_index long, owners array<long>")
    chosen = spark.createDataFrame([(5,), (8,)], "key long")
    assert sorted(r.row_index for r in subset.concerned(rows, chosen).collect()) == [1, 3, 4, 5, 6, 7]
    assert sorted(r.row_index for r in subset.concerned(rows, chosen.limit(0)).collect()) == [5, 6]
    assert subset.concerned(rows.limit(0), chosen).count() == 0


def _plain_skew(grey):
    """The search one page and one angle at a time, by sums over pixels."""
    k = max(1, min(4, grey.shape[1] // images.SEARCH_WIDTH))
    h, w = grey.shape[0] // k * k, grey.shape[1] // k * k
    small = (grey[:h, :w].reshape(h // k, k, w // k, k).mean((1, 3)) if k > 1 and h else grey).astype(np.float64)
    ink = np.clip(np.median(small) - small, 0, None)
    y, x = np.nonzero(ink > 8)
    if not y.size:
        return 0.0
    weight, across = ink[y, x], np.arange(small.shape[1]) - (small.shape[1] - 1) / 2

    def sharpness(angle):
        moved = np.rint(-across * np.tan(np.radians(angle)) * images.PARTS).astype(int)
        moved -= moved.min()
        rows = np.convolve(np.bincount(y * images.PARTS + moved[x], weight), np.ones(images.PARTS))
        return float((rows * rows).sum())

    best = lambda angles: max(sorted(angles, key=abs), key=sharpness)
    rough = best(np.arange(-6, 7) * images.COARSE)
    return round(float(best(rough + np.arange(-4, 5) * images.FINE)), 1)


def _plain_prepared(grey, angle):
    """A page turned pixel by pixel, stretched and freed of specks by the functions for each."""
    h, w = grey.shape
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    padded = np.pad(grey, 1, constant_values=255).astype(np.float32)
    y, x = np.arange(h)[:, None] - (h - 1) / 2, np.arange(w) - (w - 1) / 2
    from_y, from_x = np.clip(c * y + s * x + (h + 1) / 2, 0, h + 0.999), np.clip(c * x - s * y + (w + 1) / 2, 0, w + 0.999)
    i, j = from_y.astype(int), from_x.astype(int)
    v, u = (from_y - i).astype(np.float32), (from_x - j).astype(np.float32)
    upper, lower = (padded[i + k, j] * (1 - u) + padded[i + k, j + 1] * u for k in (0, 1))
    level = np.rint(upper * (1 - v) + lower * v).astype(np.uint8) if abs(angle) >= 0.1 else grey
    upto = np.cumsum(np.bincount(level.ravel(), minlength=256))
    low, high = np.searchsorted(upto, upto[-1] * images.CUTOFF, "right"), np.searchsorted(upto, upto[-1] * (1 - images.CUTOFF), "left")
    spread = np.clip((np.arange(256) - low) * 255.0 / (high - low), 0, 255).astype(np.uint8)[level] if high > low else level
    assert (images.stretched(level) == spread).all()
    return np.where(images.despeckled(spread) > images.WHITE, 255, 0)


def _kinds_of_pages(rng, size):
    """Pages of one size: text, noise, two tones of which each is half of the page, paper that isn't even, no ink."""
    yield from (_page(angle, seed=int(rng.integers(1000)), size=size) for angle in (-2.5, 0.0, 1.2) if min(size) > 60)
    yield rng.integers(0, 256, size).astype(np.uint8)
    yield np.where(np.arange(size[0] * size[1]).reshape(size) % 2, 41, 200).astype(np.uint8)
    yield np.clip(rng.normal(200, 20, size), 0, 255).astype(np.uint8)
    yield np.full(size, 7, np.uint8)


@pytest.mark.parametrize("size", [(300, 260), (90, 70), (1, 9), (9, 1), (5, 5), (2, 900), (131, 801), (640, 1205), (300, 1700)])
def test_stacks_of_pages_in_the_plain_way(size):
    pages = list(_kinds_of_pages(np.random.default_rng(size[0]), size))
    angles = images.skews(np.stack(pages)).tolist()
    assert angles == [_plain_skew(page) for page in pages]
    for page, angle in zip(pages, angles, strict=True):
        assert images.skew(page) == angle
        for turn in {angle, -1.3, 3.4}:
            assert (images.prepared(page, turn) == _plain_prepared(page, turn)).all()


def test_a_stack_costs_less_than_its_pages_alone():
    import time

    pages, seconds = np.stack([_page(1.0, seed=k) for k in range(64)]), []
    for search in (lambda: images.skews(pages), lambda: [_plain_skew(page) for page in pages]):
        search()
        began = time.process_time()
        search()
        seconds.append(time.process_time() - began)
    assert seconds[0] < seconds[1] / 2


def test_drawn_pages_stay_in_their_task(spark):
    """Pages are drawn, made ready and measured a few at a time; none goes through the engine between."""
    import pyarrow as pa

    from tallyforge.plans import forms

    plan = forms.page_angles(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "MapInPandas" not in plan and "binary" not in plan
    keys = [9 * k + 4 for k in range(2 * forms.DRAWN + 5)]
    batch = pa.RecordBatch.from_pydict({"inv_ord": keys, "source_file": list(map(str, keys)), "text": ["a bc def"] * len(keys), "angle": [k % 11 * 0.5 - 2.5 for k in keys]})
    drawn = list(forms._draw(iter([batch])))
    assert [len(x) for x in drawn] == [forms.DRAWN, forms.DRAWN, 5]
    assert sorted(int(x) for y in drawn for x in y["source_file"].to_pylist()) == keys
