"""Gray pictures as arrays of rows: resampling, hashes, borders. Column expressions; digests take Arrow batches by shape.

A picture without rows, with an empty row or with rows of different lengths is none: what is made of it is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole(gray: Column) -> Column:
    """Whether it has rows, all of one length over 0, without nulls."""
    width = F.size(F.get(gray, F.lit(0)))
    return F.coalesce((F.size(gray) > 0) & (width > 0) & F.forall(gray, lambda row: F.coalesce((F.size(row) == width) & ~F.exists(row, lambda x: x.isNull()), F.lit(False))), F.lit(False))


def _spread(lines: Column, n: Column, size: int, add, zero: Column) -> Column:
    """n lines summed up into ``size``: line j covers [j * size, (j + 1) * size), a sum [i * n, (i + 1) * n) of the same axis;
    the weight of a line is how much of it a sum covers."""

    def summed(i):
        low, high = i * n, (i + 1) * n
        first, last = F.floor(low / size).cast("int"), (F.ceil(high / size) - 1).cast("int")
        cover = lambda j: (F.least(high, (j + 1) * size) - F.greatest(low, j * size)).cast("double")
        return F.aggregate(F.sequence(first, last), zero, lambda held, j: add(held, F.get(lines, j), cover(j)))

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), summed)


def resampled(gray: Column, height: int, width: int) -> Column:
    """Sums of areas: the picture as height x width cells, each the sum of what it covers, weighted by how much.

    Rows count ``height`` and columns ``width`` times, so that weights are whole numbers: a cell is the mean brightness
    times the number of the picture's pixels. Whole numbers stay exact. Each pixel is read once or, where cells are
    smaller than pixels, once for each cell that it reaches into.
    """

    def made(g):
        none = F.transform(F.get(g, F.lit(0)), lambda x: F.lit(0.0))
        columns = F.size(F.get(g, F.lit(0)))
        rows = _spread(g, F.size(g), height, lambda held, row, weight: F.zip_with(held, row, lambda x, y: x + weight * y.cast("double")), none)
        cells = F.transform(rows, lambda row: _spread(row, columns, width, lambda held, x, weight: held + weight * x, F.lit(0.0)))
        return F.when(whole(g), cells)

    return let(gray, made)


def gradient_hash(gray: Column) -> Column:
    """Bits of brightness steps along each row of a gray picture (array of arrays): 1 where it rises."""
    bits = F.transform(gray, lambda row: F.array_join(F.transform(F.sequence(F.lit(1), F.size(row) - 1), lambda i: F.when(F.get(row, i) > F.get(row, i - 1), "1").otherwise("0")), ""))
    return F.array_join(bits, "")


def average_hash(gray: Column) -> Column:
    """Bits of what is brighter than the mean."""
    mean = lambda flat: F.aggregate(flat, F.lit(0.0), lambda s, x: s + x) / F.size(flat)
    bits = lambda flat, m: F.array_join(F.transform(flat, lambda x: F.when(x > m, "1").otherwise("0")), "")
    return let(F.flatten(gray), lambda flat: let(mean(flat), lambda m: bits(flat, m)))


def as_hex(bits: Column) -> Column:
    """A string of bits, four for each digit."""
    digits = lambda b: F.transform(F.sequence(F.lit(1), F.length(b) - 3, F.lit(4)), lambda i: F.lower(F.conv(F.substring(b, i, 4), 2, 16)))
    return let(bits, lambda b: F.array_join(digits(b), ""))


def by_shape(gray):
    """Of an Arrow array of pictures: places and pixels (pictures x rows x columns) of all whole ones of a shape, without nulls
    and other than finite values."""
    rows, valid = gray.values, np.asarray(gray.is_valid())
    outer, inner = np.asarray(gray.offsets, dtype=np.int64), np.asarray(rows.offsets, dtype=np.int64)
    pixels = rows.values.to_numpy(zero_copy_only=False)
    odd = np.concatenate([[0], np.cumsum(~np.isfinite(pixels))])  # nulls have become NaN
    height, length = np.diff(outer), np.where(np.asarray(rows.is_valid()), np.diff(inner), -1)
    width = np.zeros(len(height), np.int64)
    width[height > 0] = length[outer[:-1][height > 0]]
    uneven = np.bincount(np.repeat(np.arange(len(height)), height), length[outer[0] : outer[-1]] != np.repeat(width, height), minlength=len(height))
    good = np.flatnonzero(valid & (height > 0) & (width > 0) & (uneven == 0) & (odd[inner[outer[1:]]] == odd[inner[outer[:-1]]]))
    shapes, of = np.unique(np.stack([height[good], width[good]]), axis=1, return_inverse=True)
    for k, (h, w) in enumerate(shapes.T.tolist()):
        places = good[of.reshape(-1) == k]
        yield places, pixels[inner[outer[places]][:, None] + np.arange(h * w)].reshape(-1, h, w)


def _covers(n: int, size: int) -> np.ndarray:
    """Row by sum how much of each of n lines each of ``size`` sums covers, as in _spread."""
    i, j = np.arange(size)[:, None], np.arange(n)
    return np.maximum(0, np.minimum((i + 1) * n, (j + 1) * size) - np.maximum(i * n, j * size)).astype(np.float64)


def _digest(gray: Column, height: int, width: int, bits: Callable[[np.ndarray], np.ndarray]) -> Column:
    """bits (of pictures x height x width sums) as hex; null for what by_shape leaves out."""

    import pyarrow as pa

    def told(pictures):
        out = [None] * len(pictures)
        for places, x in by_shape(pictures):
            cells = _covers(x.shape[1], height) @ x @ _covers(x.shape[2], width).T
            found = bits(cells).reshape(len(x), -1)
            for place, packed in zip(places.tolist(), np.packbits(found, axis=1), strict=True):
                out[place] = packed.tobytes().hex()[: found.shape[1] // 4]
        return pa.array(out, pa.string())

    told.__annotations__ = {"pictures": pa.Array, "return": pa.Array}  # they tell Spark the kind of function
    return F.arrow_udf(told, "string")(gray.cast("array<array<double>>"))


def difference_digest(gray: Column, size: int = 16) -> Column:
    """The gradient bits of a picture of any shape, resampled to ``size`` rows of ``size + 1`` cells, as hex."""
    fast = _digest(gray, size, size + 1, lambda cells: cells[:, :, 1:] > cells[:, :, :-1])
    return F.coalesce(fast, as_hex(gradient_hash(resampled(gray, size, size + 1))))


def average_digest(gray: Column, size: int = 8) -> Column:
    """The average bits of a picture of any shape, resampled to ``size`` x ``size`` cells, as hex."""
    fast = _digest(gray, size, size, lambda cells: cells > cells.sum(axis=(1, 2), keepdims=True) / size**2)
    return F.coalesce(fast, as_hex(average_hash(resampled(gray, size, size))))


def hex_hash(gray: Column, size: int = 8) -> Column:
    """The gradient bits of ``size`` rows of ``size + 1`` cells as hex, without resampling; null for a picture of another shape."""
    fits = whole(gray) & (F.size(gray) == size) & (F.size(F.get(gray, F.lit(0))) == size + 1)
    return F.when(fits, as_hex(gradient_hash(gray)))


def _leading(flags: Column, most: Column) -> Column:
    """How many of the first ``most`` flags are true before one is not."""
    start = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    step = lambda held, x: F.struct((held["n"] + F.when(held["on"] & x, 1).otherwise(0)).alias("n"), (held["on"] & x).alias("on"))
    return F.aggregate(F.slice(flags, 1, most), start, step, lambda held: held["n"])


def _flat(sums: Column, squares: Column, n: Column, corner: Column, tolerance: float) -> Column:
    """Of lines of n pixels, by sums and sums of squares: little spread and near the corner's brightness."""
    flat = lambda s, q: (n * q - s * s < tolerance * tolerance * n * n) & (F.abs(s - corner * n) < 2 * tolerance * n)
    return F.zip_with(sums, squares, flat)


def border(channels: Sequence[Column], tolerance: float = 12.0, most_share: float = 0.15) -> Column:
    """top, bottom, left and right (the last two of each axis exclusive) of what lies inside flat margins.

    channels: the picture's, as gray pictures of one shape. A line is margin if in all channels its pixels spread by less
    than the tolerance and their mean is within twice of it of the corners' median. At most ``most_share`` of the height
    or width goes on a side. Lines are judged by sums and squares that two passes over the pixels give.
    """
    return let(F.struct(*[g.alias(f"c{k}") for k, g in enumerate(channels)]), lambda held: _border([held[f"c{k}"] for k in range(len(channels))], tolerance, most_share))


def _border(channels: Sequence[Column], tolerance: float, most_share: float) -> Column:
    height, width = F.size(channels[0]), F.size(F.get(channels[0], F.lit(0)))
    total = lambda row, f: F.aggregate(row, F.lit(0.0), lambda s, x: s + f(x.cast("double")))
    own, square = lambda x: x, lambda x: x * x

    def corner(gray):
        at = lambda i, j: F.get(F.get(gray, i), j).cast("double")
        four = F.array_sort(F.array(at(F.lit(0), F.lit(0)), at(F.lit(0), width - 1), at(height - 1, F.lit(0)), at(height - 1, width - 1)))
        return (F.get(four, F.lit(1)) + F.get(four, F.lit(2))) / 2

    def row_flags(gray):
        sums = lambda f: F.transform(gray, lambda row: total(row, f))
        return let(corner(gray), lambda c: _flat(sums(own), sums(square), width, c, tolerance))

    def column_flags(gray):
        none = F.transform(F.get(gray, F.lit(0)), lambda x: F.lit(0.0))
        sums = lambda f: F.aggregate(gray, none, lambda held, row: F.zip_with(held, row, lambda s, x: s + f(x.cast("double"))))
        return let(corner(gray), lambda c: _flat(sums(own), sums(square), height, c, tolerance))

    def all_of(flags):
        both = flags[0]
        for more in flags[1:]:
            both = F.zip_with(both, more, lambda x, y: x & y)
        return both

    most = [F.floor(n * most_share).cast("int") for n in (height, width)]
    ends = lambda flags, n, m: F.struct(_leading(flags, m).alias("a"), (n - _leading(F.reverse(flags), m)).alias("b"))
    down = let(all_of([row_flags(g) for g in channels]), lambda flags: ends(flags, height, most[0]))
    across = let(all_of([column_flags(g) for g in channels]), lambda flags: ends(flags, width, most[1]))
    box = let(F.struct(down.alias("y"), across.alias("x")), lambda s: F.struct(s["y"]["a"].alias("top"), s["y"]["b"].alias("bottom"), s["x"]["a"].alias("left"), s["x"]["b"].alias("right")))
    same = whole(channels[0])
    for gray in channels[1:]:
        same = same & whole(gray) & (F.size(gray) == height) & (F.size(F.get(gray, F.lit(0))) == width)
    return F.when(same, box)


def cropped(gray: Column, box: Column) -> Column:
    """The part of a picture inside a box of ``border``."""
    return F.transform(F.slice(gray, box["top"] + 1, box["bottom"] - box["top"]), lambda row: F.slice(row, box["left"] + 1, box["right"] - box["left"]))
