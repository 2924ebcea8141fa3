"""Grey images of scanned pages, made ready for reading: levelled, stretched, freed of specks and black on white."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Degrees that are tried, share of pixels cut at both ends of the tones, and the tone above which a pixel is white.
LARGEST, COARSE, FINE, REACH = 3.0, 0.5, 0.1, 0.4
CUTOFF, WHITE = 0.02, 165
#: Rows of an image that are worked on at once, and the width that the search of an angle needs.
STRIP, SEARCH_WIDTH = 256, 400
#: Parts of a row that the search tells apart.
PARTS = 4
#: Pixels that a tone is guessed from, and those that are turned at once.
GUESSED, TURN_PIXELS = 2048, 1 << 17
#: Pages of one size that are worked on at once, and the pixels that they have at most unless it is one page.
STACK, STACK_PIXELS = 32, 1 << 22


def _shrunk(pages: np.ndarray) -> tuple[np.ndarray, int]:
    """Sums of blocks of up to four by four pixels, and the pixels of a block."""
    n, height, width = pages.shape
    k = max(1, min(4, width // SEARCH_WIDTH))
    h, w = height // k * k, width // k * k
    if k == 1 or not h:
        return pages, 1
    return pages[:, :h, :w].reshape(n, h // k, k, w // k, k).sum((2, 4), dtype=np.uint16), k * k


_KEPT: dict[str, np.ndarray] = {}


def _kept(name: str, shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Space of the last stack, whose contents don't matter; fresh memory costs more than the sums in it."""
    size = int(np.prod(shape)) * np.dtype(kind).itemsize
    if size > 8 * STACK_PIXELS:
        return np.empty(shape, kind)
    if len(_KEPT.get(name, ())) < size:
        _KEPT[name] = np.empty(size, np.uint8)
    return _KEPT[name][:size].view(kind).reshape(shape)


def _tone(grey: np.ndarray, count: int) -> int:
    """The least tone that so many pixels don't exceed, guessed from some of them and looked for from there."""
    some = np.sort(grey.ravel()[:: max(1, grey.size // GUESSED)])
    guess = int(some[min(len(some) - 1, count * len(some) // grey.size)])
    # low is too dark, high is not
    low, high, step = -1, int(grey.max()), 1
    while high - low > 1:
        guess = min(max(guess, low + 1), high - 1)
        if np.count_nonzero(grey <= guess) >= count:
            high, guess = guess, guess - step
        else:
            low, guess = guess, guess + step
        step *= 2
    return high


def _twice_median(grey: np.ndarray) -> int:
    half = (grey.size + 1) // 2
    middle = _tone(grey, half)
    whole = grey.size % 2 or np.count_nonzero(grey <= middle) > half
    return middle + (middle if whole else int(grey[grey > middle].min()))


def _ink(grey: np.ndarray, area: int, middle: int, ink: np.ndarray) -> int:
    """Puts into ink how much darker than the median pixels are, if it is much, in the unit that keeps the numbers of this page small; the largest of them."""
    ink[...] = grey
    ink *= -2
    ink += middle
    ink *= ink > 16 * area
    top = int(ink.max())
    if np.count_nonzero(ink) == np.count_nonzero(ink == top):
        np.minimum(ink, 1, out=ink)
        return min(top, 1)
    if middle % 2 == 0:
        ink >>= 1
        top >>= 1
    return top


def _sharpness(upto: np.ndarray, angle: float) -> np.ndarray:
    """How unevenly ink falls on rows, for each page of a stack; upto: ink of the columns before each, by row and page.

    A column moves as a whole, as far as it is off the middle, and a pixel is as
    high as all parts of a row, wherever between rows it falls. Columns that
    move equally far are taken as one: as the next ones move a part of a row
    farther, what these leave where the others begin is all that remains of
    their sums. Whole numbers wrap around on the way and are right at the end.
    """
    columns, height, n = len(upto) - 1, *upto.shape[1:]
    moved = np.rint((np.arange(columns) - (columns - 1) / 2) * -np.tan(np.radians(angle)) * PARTS).astype(np.int64)
    moved -= moved.min()
    # the first row stays empty
    rows = np.zeros((PARTS, height + int(moved.max()) // PARTS + 3, n), upto.dtype)
    turns = np.flatnonzero(np.diff(moved))
    for x, place in zip((turns + 1).tolist(), np.minimum(moved[turns], moved[turns + 1]).tolist(), strict=True):
        at = place // PARTS + 1
        kept = rows[place % PARTS, at : at + height]
        np.add(kept, upto[x], kept)
    level = rows[:, 1:] - rows[:, :-1]
    put = np.subtract if moved[0] > moved[-1] else np.add
    for place in range(int(moved[-1]), int(moved[-1]) + PARTS):
        kept = level[place % PARTS, place // PARTS : place // PARTS + height]
        put(kept, upto[-1], kept)
    level = (np.negative(level, level) if put is np.subtract else level).reshape(-1, n).astype(np.float64)
    return np.einsum("ij,ij->j", level, level)


def skews(pages: np.ndarray) -> np.ndarray:
    """The turn of each page of a stack, in degrees counter-clockwise, that levels its lines; 0 for a page without ink.

    Ink is projected on rows along lines of that slope. Level lines
    give few full rows and empty ones between, so the sum of squares is largest.
    """
    small, area = _shrunk(pages)
    n, height, width = small.shape
    if not small.size:
        return np.zeros(n)
    middles = [_twice_median(page) for page in small]
    ink = _kept("ink", (n, height, width), np.uint16 if area > 1 or any(middle % 2 for middle in middles) else np.uint8)
    page, tops = np.empty((height, width), np.int16), []
    for grey, middle, own in zip(small, middles, ink, strict=True):
        tops.append(_ink(grey, area, middle, page))
        own[...] = page
    # pages beside each other, so that a column of all is one run of numbers
    beside = _kept("beside", (height, width, n), ink.dtype)
    beside.reshape(-1, n)[...] = ink.reshape(n, -1).T
    kind = np.uint16 if max(tops) * width < 1 << 16 else np.uint32
    upto, column = _kept("upto", (width + 1, height, n), kind), np.empty((height, n), kind)
    upto[0] = 0
    for x in range(width):
        np.copyto(column, beside[:, x])
        np.add(upto[x], column, upto[x + 1])
    tried: dict[int, np.ndarray] = {}

    def best(steps: np.ndarray) -> np.ndarray:
        """For each page the best of its steps of the finest kind; the least turn, if several are."""
        steps = np.take_along_axis(steps, np.argsort(np.abs(steps), 1, kind="stable"), 1)
        for k in np.unique(steps):
            if k not in tried:
                tried[k] = _sharpness(upto, k * FINE)
        score = np.array([[tried[k][page] for k in own] for page, own in enumerate(steps)])
        return np.take_along_axis(steps, score.argmax(1)[:, None], 1)

    coarse, reach = round(COARSE / FINE), round(REACH / FINE)
    most = round(LARGEST / COARSE)
    rough = best(np.tile(np.arange(-most, most + 1) * coarse, (n, 1)))
    found = best(rough + np.arange(-reach, reach + 1))[:, 0]
    return np.where(np.array(tops) > 0, np.round(found * FINE, 1), 0.0)


def skew(grey: np.ndarray) -> float:
    """The turn, in degrees counter-clockwise, that levels the lines of a page; 0 for a page without ink."""
    return float(skews(grey[None])[0])


def _turn(pages: np.ndarray, angle: float, out: np.ndarray) -> None:
    """Puts into out the pages of a stack turned about their centres, counter-clockwise, on white."""
    n, h, w = pages.shape
    c, s = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    padded = _kept("padded", (n, h + 2, w + 2), np.uint8)
    padded[:, [0, -1]] = 255
    padded[:, :, [0, -1]] = 255
    padded[:, 1:-1, 1:-1] = pages
    padded = padded.reshape(n, -1)
    x, rows = np.arange(w) - (w - 1) / 2, max(1, TURN_PIXELS // max(1, w))
    for top in range(0, h, rows):
        y = np.arange(top, min(top + rows, h))[:, None] - (h - 1) / 2
        from_y = np.clip(c * y + s * x + (h + 1) / 2, 0, h + 0.999)
        from_x = np.clip(c * x - s * y + (w + 1) / 2, 0, w + 0.999)
        i, j = from_y.astype(np.int64), from_x.astype(np.int64)
        v, u = (from_y - i).astype(np.float32), (from_x - j).astype(np.float32)
        # the rows of a page that are looked at, as numbers; an index of the upper left one of four is right for the others' places
        first, last = int(i.min()), int(i.max()) + 2
        over, left, at = 1 - v, 1 - u, (i - first) * (w + 2) + j
        upper, lower, part = (np.empty(at.shape, np.float32) for _ in range(3))
        looked = np.empty((last - first) * (w + 2), np.float32)
        for page, made in zip(padded, out, strict=True):
            looked[...] = page[first * (w + 2) : last * (w + 2)]
            for row, skip in ((upper, 0), (lower, w + 2)):
                looked[skip:].take(at, out=row, mode="clip")
                np.multiply(row, left, out=row)
                looked[skip + 1 :].take(at, out=part, mode="clip")
                np.multiply(part, u, out=part)
                np.add(row, part, out=row)
            np.multiply(upper, over, out=upper)
            np.multiply(lower, v, out=lower)
            np.add(upper, lower, out=upper)
            made[top : top + rows] = np.rint(upper, out=upper)


def turned(grey: np.ndarray, angle: float) -> np.ndarray:
    """The image turned about its centre, counter-clockwise, on white."""
    out = np.empty_like(grey)
    _turn(grey[None], angle, out[None])
    return out


def _tones(grey: np.ndarray) -> np.ndarray:
    """What each tone becomes when they are spread over the whole range; an even image stays."""
    low, high = _tone(grey, int(np.floor(grey.size * CUTOFF)) + 1), _tone(grey, int(np.ceil(grey.size * (1 - CUTOFF))))
    if high <= low:
        return np.arange(256, dtype=np.uint8)
    return np.clip((np.arange(256) - low) * 255.0 / (high - low), 0, 255).astype(np.uint8)


def stretched(grey: np.ndarray) -> np.ndarray:
    """Tones spread over the whole range, less the darkest and the lightest pixels; an even image stays."""
    return _tones(grey)[grey]


def despeckled(grey: np.ndarray) -> np.ndarray:
    """Each pixel becomes the median of its three by three; edges count as going on."""
    padded, out = np.pad(grey, 1, mode="edge"), np.empty_like(grey)
    for top in range(0, grey.shape[0], STRIP):
        n = min(STRIP, grey.shape[0] - top)
        a, b, c = (padded[top + i : top + i + n] for i in range(3))
        low, mid, high = np.minimum(np.minimum(a, b), c), _middle(a, b, c), np.maximum(np.maximum(a, b), c)
        left, here, right = slice(None, -2), slice(1, -1), slice(2, None)
        lowest = np.maximum(np.maximum(low[:, left], low[:, here]), low[:, right])
        highest = np.minimum(np.minimum(high[:, left], high[:, here]), high[:, right])
        out[top : top + n] = _middle(lowest, _middle(mid[:, left], mid[:, here], mid[:, right]), highest)
    return out


def _middle(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))


def _light(grey: np.ndarray) -> np.ndarray:
    """1 for each pixel that is white once the page is stretched and freed of specks, else 0.

    The order of tones stays as they are stretched, so the median of nine
    pixels is white if five of them will be.
    """
    light = (grey >= np.searchsorted(_tones(grey), WHITE, "right")).view(np.uint8)
    # sums of each pixel and those on both sides of it; edges count as going on
    rows = light.copy()
    rows[1:] += light[:-1]
    rows[:-1] += light[1:]
    rows[0] += light[0]
    rows[-1] += light[-1]
    nine = rows.copy()
    nine[:, 1:] += rows[:, :-1]
    nine[:, :-1] += rows[:, 1:]
    nine[:, 0] += rows[:, 0]
    nine[:, -1] += rows[:, -1]
    return (nine >= 5).view(np.uint8)


def _made_ready(pages: np.ndarray, angle: float) -> np.ndarray:
    """The pages of a stack, turned by one angle and made black and white."""
    level, out = pages, np.empty_like(pages)
    if abs(angle) >= 0.1:
        _turn(pages, angle, level := _kept("level", pages.shape, np.uint8))
    for grey, made in zip(level, out, strict=True):
        np.multiply(_light(grey), np.uint8(255), out=made)
    return out


def prepared(grey: np.ndarray, angle: float | None = None) -> np.ndarray:
    """A levelled page of black and white; the angle is looked for unless it is given."""
    if not grey.size:
        return grey
    return _made_ready(grey[None], skew(grey) if angle is None else angle)[0]


def _stacks(rows: list[int], pages: list[np.ndarray | None]) -> Iterator[tuple[list[int], np.ndarray]]:
    """Pages of one size, so many that a stack stays small."""
    most = max(1, min(STACK, STACK_PIXELS // max(1, pages[rows[0]].size)))
    for k in range(0, len(rows), most):
        yield rows[k : k + most], np.stack([pages[row] for row in rows[k : k + most]])


def page_bytes(pages: np.ndarray) -> pa.Array:
    """The pages of a stack as binary values, without a copy."""
    ends = np.arange(len(pages) + 1, dtype=np.int32) * (pages.size // len(pages))
    return pa.Array.from_buffers(pa.binary(), len(pages), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(pages)])


def _pages(batch: pa.RecordBatch) -> list[np.ndarray | None]:
    """The image of each row; none for a null or one whose bytes aren't width times height."""
    out = []
    for width, height, data in zip(batch["width"].to_pylist(), batch["height"].to_pylist(), batch["pixels"], strict=True):
        grey = np.frombuffer(data.as_buffer(), np.uint8) if data.is_valid else None
        whole = grey is not None and width is not None and height is not None and min(width, height) >= 0 and len(grey) == width * height
        out.append(grey.reshape(height, width) if whole else None)
    return out


def _angles(pages: list[np.ndarray | None]) -> list[float | None]:
    """The skew of each page, found for pages of one size together."""
    out: list[float | None] = [None] * len(pages)
    size = lambda row: pages[row].shape
    for _, rows in groupby(sorted((row for row, page in enumerate(pages) if page is not None), key=size), size):
        for part, stack in _stacks(list(rows), pages):
            for row, angle in zip(part, skews(stack).tolist(), strict=True):
                out[row] = angle
    return out


SCAN = ["source_file", "width", "height", "pixels"]


def ready_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What `prepare_scans` does to Arrow batches of a task."""
    for batch in batches:
        pages = _pages(batch)
        angles = _angles(pages)

        def rows_of(part: list[int], made: pa.Array, batch=batch, angles=angles) -> pa.RecordBatch:
            named = batch.select(SCAN[:3]).take(pa.array(part))
            return pa.RecordBatch.from_arrays([*named.columns, made, pa.array([angles[row] for row in part], pa.float64())], [*SCAN, "angle"])

        if bare := [row for row, page in enumerate(pages) if page is None]:
            yield rows_of(bare, pa.nulls(len(bare), pa.binary()))
        alike = lambda row, pages=pages, angles=angles: (*pages[row].shape, angles[row])
        for (*_, angle), rows in groupby(sorted((row for row, page in enumerate(pages) if page is not None), key=alike), alike):
            for part, stack in _stacks(list(rows), pages):
                yield rows_of(part, page_bytes(_made_ready(stack, angle) if stack.size else stack))


def angle_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(source_file, angle): the turn of each page that levels it, without making it ready."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch["source_file"], pa.array(_angles(_pages(batch)), pa.float64())], ["source_file", "angle"])


def prepare_scans(scans: DataFrame) -> DataFrame:
    """(source_file, width, height, pixels, angle): grey scans, a byte a pixel, made ready; the rows of a page from top to bottom.

    A null page, or one whose bytes aren't width times height, keeps its row,
    without pixels and angle; one of no pixels has angle 0. Work stays within a
    page, so there is no shuffle.
    """
    sized = scans.select("source_file", F.col("width").cast("int"), F.col("height").cast("int"), "pixels")
    return sized.mapInArrow(ready_batches, "source_file string, width int, height int, pixels binary, angle double")
