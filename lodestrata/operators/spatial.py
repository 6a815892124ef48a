"""Distances, buffers, interpolation and burning of shapes.

The exact distance transform goes over columns, then over rows, in strips of lines as arrays, in about as many steps as the
grid has cells, whatever the number of marks; it carries the mark, so that nearest neighbours come out of it too. Points of an
interpolation are broadcast, FEW at a time; of more, the slices' sums are merged.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata import store
from lodestrata.deploy import ship
from lodestrata.operators import spectra, tiles
from lodestrata.operators.grid import Meta
from lodestrata.operators.tiles import Block

#: Points that are broadcast at once.
FEW = 50_000
#: Cells that a point is the nearest of from which it is broadcast, where points are many.
WIDE = 100_000

#: Points of a square that one list holds, and those that a point may share its first square with, on average.
LIST, CROWD = 256, 32


def _slices(points: DataFrame) -> list[DataFrame]:
    """points as tables of about FEW rows at most, each to be broadcast by itself."""
    n = max(1, -(-points.count() // FEW))
    if n == 1:
        return [F.broadcast(points)]
    part = F.pmod(F.xxhash64(*points.columns), F.lit(n))
    return [F.broadcast(points.filter(part == i)) for i in range(n)]


def least_parabolas(at: np.ndarray, high: np.ndarray, order: np.ndarray, n: int, step: float) -> tuple[np.ndarray, np.ndarray]:
    """For each of n places of each line, the least of (place - at)**2 * step**2 + high, and which parabola has it (ties: the
    least order). at has a line's parabolas, the same for all; high and order have a row for each line.

    Whichever parabola is the least, it never moves back along a line. So the middle of a stretch is found among those between
    the ends' ones: twice as many places at each of log n passes, all lines and places of a pass at once."""
    lines, p = high.shape
    best, which = np.zeros((lines, n)), np.zeros((lines, n), np.int64)
    q = at * step
    s = 1 << max(0, n - 1).bit_length()
    while s:
        x = np.arange(s - 1, n, 2 * s)
        if len(x):
            low = which[:, x - s] if x[0] >= s else np.concatenate([np.zeros((lines, 1), np.int64), which[:, x[1:] - s]], axis=1)
            after = x + s
            top = np.full((lines, len(x)), p - 1)
            inside = after < n
            top[:, inside] = which[:, after[inside]]
            size = (top - low + 1).ravel()
            begin = np.concatenate([[0], np.cumsum(size)])
            k = np.repeat(low.ravel() - begin[:-1], size) + np.arange(begin[-1])
            line = np.repeat(np.repeat(np.arange(lines), len(x)), size)
            d = (np.repeat(np.tile(x * step, lines), size) - q[k]) ** 2 + high[line, k]
            least = np.minimum.reduceat(d, begin[:-1])
            first = np.where(d == np.repeat(least, size), order[line, k], np.iinfo(np.int64).max)
            rank = np.minimum.reduceat(first, begin[:-1])
            own = np.where((first == np.repeat(rank, size)) & (d == np.repeat(least, size)), k, p)
            best[:, x] = least.reshape(lines, -1)
            which[:, x] = np.minimum.reduceat(own, begin[:-1]).reshape(lines, -1)
        s >>= 1
    return best, which


#: Cells of the lines that one task works on at once.
STRIP = 2_000_000


def _strip(length: int) -> int:
    """How many lines of so many cells are a strip."""
    return max(1, min(256, STRIP // length))


def nearest_marks(marks: DataFrame, meta: Meta) -> DataFrame:
    """(r, c, d, mr, mc, ord) of every cell: exact metres to the nearest of marks (r, c, ord), of marks as near that of the
    least ord; no rows without marks.

    Columns that have marks are worked on in strips: the nearest mark above and below by two running extremes. Each strip sends
    its part to the strips of rows, as arrays; there the least parabolas give all cells of some rows at once. Marks alone are
    shuffled first, then the columns that have some; a strip is the largest thing in one task, and the steps do not depend on
    how many marks there are."""
    ship(marks.sparkSession)
    dx, dy = meta.metres()
    h, w = meta.h, meta.w
    across, down = _strip(h), _strip(w)
    m = marks.filter(F.col("r").between(0, h - 1) & F.col("c").between(0, w - 1)).groupBy(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c")).agg(F.min("ord").cast("long").alias("ord"))

    def columns(key: tuple, table: pa.Table) -> pa.Table:
        r, c, order = (table[n].to_numpy() for n in ("r", "c", "ord"))
        at, place = np.unique(c, return_inverse=True)
        ords = np.zeros((h, len(at)), np.int64)
        ords[r, place] = order
        above, below = np.full((h, len(at)), -1, np.int32), np.full((h, len(at)), 2 * h, np.int32)
        above[r, place] = below[r, place] = r
        np.maximum.accumulate(above, axis=0, out=above)
        below = np.minimum.accumulate(below[::-1], axis=0)[::-1]
        rows, each = np.arange(h)[:, None], np.arange(len(at))[None, :]
        up, dn = np.where(above >= 0, rows - above, 4 * h), np.where(below < h, below - rows, 4 * h)
        o_up, o_dn = ords[np.maximum(above, 0), each], ords[np.minimum(below, h - 1), each]
        higher = (up < dn) | ((up == dn) & ((o_up < o_dn) | ((o_up == o_dn) & (above < below))))
        mr, order = np.where(higher, above, below).astype(np.int32), np.where(higher, o_up, o_dn)
        strips = range(0, h, down)
        cut = lambda a: pa.array([np.ascontiguousarray(a[lo : lo + down]).tobytes() for lo in strips], pa.binary())
        return pa.table({"strip": pa.array([lo // down for lo in strips], pa.int32()), "cs": pa.array([at.astype(np.int32).tobytes()] * len(strips), pa.binary()), "mr": cut(mr), "ord": cut(order)})

    def rows(key: tuple, table: pa.Table) -> pa.Table:
        parts = sorted(((np.frombuffer(a, np.int32), np.frombuffer(b, np.int32), np.frombuffer(c, np.int64)) for a, b, c in zip(*(table[n].to_pylist() for n in ("cs", "mr", "ord")), strict=True)), key=lambda x: int(x[0][0]))
        c = np.concatenate([a for a, _, _ in parts])
        mr, order = (np.concatenate([x[i].reshape(-1, len(x[0])) for x in parts], axis=1) for i in (1, 2))
        first = key[0].as_py() * down
        r = np.arange(first, first + len(mr), dtype=np.int32)
        high = ((r[:, None] - mr) * dy) ** 2
        d, k = least_parabolas(c, high, order, w, dx)
        line = np.arange(len(r))[:, None]
        return pa.table({"r": np.repeat(r, w), "c": np.tile(np.arange(w, dtype=np.int32), len(r)), "d": np.sqrt(d).ravel(), "mr": mr[line, k].ravel(), "mc": c[k].ravel(), "ord": order[line, k].ravel()})

    lines = m.groupBy((F.col("c") / across).cast("int").alias("part")).applyInArrow(columns, "strip int, cs binary, mr binary, ord binary")
    return lines.groupBy("strip").applyInArrow(rows, "r int, c int, d double, mr int, mc int, ord long")


def distance(marks: DataFrame, meta: Meta) -> DataFrame:
    """(r, c, d) of every cell: exact metres to the nearest mark; no rows without marks."""
    return nearest_marks(marks.select("r", "c", F.lit(0).cast("long").alias("ord")), meta).select("r", "c", "d")


def proximity_linear(d: Column, decay: float = 5_000.0) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - d / decay))


def proximity_exp(d: Column, decay: float = 2_500.0) -> Column:
    return F.exp(-d / decay)


def outside(grid: DataFrame, marks: DataFrame, meta: Meta, buffer_m: float) -> DataFrame:
    """The cells of grid at least buffer_m from every mark."""
    return grid.join(distance(marks, meta), ["r", "c"], "left").filter(F.col("d").isNull() | (F.col("d") >= buffer_m)).drop("d")


def idw(targets: DataFrame, points: DataFrame, power: float = 2.0, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """targets (r, c) with v: the inverse-distance mean of all points (r, c, v); distances below 1 count as 1.

    By its definition every target meets every point. Points of one cell are as near, so they are summed first: no more
    than the grid's cells are left, FEW of which are broadcast at a time."""
    p = points.groupBy(F.col("r").alias("_r"), F.col("c").alias("_c")).agg(F.sum("v").alias("_v"), F.count("v").alias("_n"))
    d2 = ((F.col("r") - F.col("_r")) * dy) ** 2 + ((F.col("c") - F.col("_c")) * dx) ** 2
    w = 1 / F.greatest(d2, F.lit(1.0)) ** (power / 2)
    sums = [F.sum(w * F.col("_v")).alias("wv"), F.sum(w * F.col("_n")).alias("w")]
    parts = [targets.select("r", "c").crossJoin(x).groupBy("r", "c").agg(*sums) for x in _slices(p)]
    out = reduce(DataFrame.unionByName, parts)
    if len(parts) > 1:
        out = out.groupBy("r", "c").agg(F.sum("wv").alias("wv"), F.sum("w").alias("w"))
    return out.select("r", "c", (F.col("wv") / F.col("w")).alias("v"))


#: Steps to which near points are summed one by one.
NEAR = 8


def idw_grid(points: DataFrame, meta: Meta, power: float = 2.0) -> DataFrame:
    """(r, c, v) of every cell: the inverse-distance mean of all points (r, c, v) on the grid; distances below a metre count as 1.

    Sums of weighted values are a convolution of the cells' sums with one kernel. Points up to NEAR steps away are summed in
    tiles; the rest of the kernel, which has no peak to drown the others, goes through transforms of the zero-padded grid. Time
    grows with the cells, not with cells times points."""
    dx, dy = meta.metres()
    p = store.stored(points.filter("v IS NOT NULL").groupBy("r", "c").agg(F.sum("v").alias("s"), F.count("*").cast("double").alias("n")), "idw-cells")

    def weight(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a[:, None] * dy) ** 2 + (b[None, :] * dx) ** 2, 1.0) ** (-power / 2)

    def near(block: Block) -> dict[str, np.ndarray]:
        v = np.nan_to_num(block.v)
        steps = np.arange(-NEAR, NEAR + 1)
        w = weight(steps, steps)
        h, k = block.shape
        out = np.zeros((2, h, k))
        for i, a in enumerate(steps + NEAR):
            for j, b in enumerate(steps + NEAR):
                out += w[i, j] * v[:, a : a + h, b : b + k]
        return {"s": out[0], "n": out[1]}

    tall, wide = 2 * meta.h, 2 * meta.w

    def kernel(rows: np.ndarray, cols: np.ndarray) -> np.ndarray:
        a, b = spectra.signed(rows, tall), spectra.signed(cols, wide)
        far = (np.abs(a)[:, None] > NEAR) | (np.abs(b)[None, :] > NEAR)
        return np.where(far, weight(a, b), 0.0)[None]

    far = spectra.filtered(p, meta.h, meta.w, ["s", "n"], lambda z, r, c: z[:2] * z[2], ["fs", "fn"], (tall, wide), kernel)
    close = tiles.stencil(p, meta, NEAR, near, ["s", "n"], ("s", "n"))
    both = close.join(far, ["r", "c"])
    total = F.col("n") + F.col("fn")
    return both.select("r", "c", F.when(total > 0, (F.col("s") + F.col("fs")) / total).alias("v")).filter("v IS NOT NULL")


def nearest_on_grid(points: DataFrame, meta: Meta) -> DataFrame:
    """Every cell (r, c) with dist, in metres, and the columns p_* of the nearest point (r, c, ord, ...); of points as near,
    the first by ord. A distance transform that carries the mark, then one join by the marks' cells.

    Of a cell's points only the first by ord is ever the nearest: the others go before anything is joined or copied."""
    other = [c for c in points.columns if c not in ("r", "c", "ord")]
    if not other:
        return _named(nearest_marks(points, meta))
    inside = points.filter(F.col("r").between(0, meta.h - 1) & F.col("c").between(0, meta.w - 1)).withColumns({"r": F.col("r").cast("int"), "c": F.col("c").cast("int"), "ord": F.col("ord").cast("long")})
    marks = store.stored(inside.groupBy("r", "c").agg(F.min("ord").alias("ord")), "nearest-marks")
    few = marks.count() <= FEW
    own = inside.join(F.broadcast(marks) if few else marks, ["r", "c", "ord"])
    p = store.stored(own.groupBy(*[F.col(k).alias(f"p_{k}") for k in ("r", "c", "ord")]).agg(*[F.first(c).alias(f"p_{c}") for c in other]), "nearest-points")
    keys = ["p_r", "p_c", "p_ord"]
    if few:
        return _named(nearest_marks(marks, meta)).join(F.broadcast(p), keys)
    # Of many points some may still be the nearest of very many cells: those few are broadcast, and their cells stay where they are.
    near = store.stored(_named(nearest_marks(marks, meta)), "nearest-cells")
    wide = store.stored(near.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > WIDE).drop("_n"), "nearest-wide")
    return near.join(F.broadcast(p.join(F.broadcast(wide), keys)), keys).unionByName(near.join(F.broadcast(wide), keys, "left_anti").join(p, keys))


def _named(near: DataFrame) -> DataFrame:
    return near.withColumnsRenamed({"d": "dist", "mr": "p_r", "mc": "p_c", "ord": "p_ord"})


def _lists(p: DataFrame, rest: list[str]) -> DataFrame:
    """The points of a square (i, j) as lists of at most LIST: a row for each, however many points a square has."""
    row = F.row_number().over(Window.partitionBy("i", "j").orderBy("p_r", "p_c"))
    point = F.struct(F.col("b.ord").alias("p_ord"), "p_r", "p_c", *[F.col(f"b.{c}").alias(f"p_{c}") for c in rest])
    return p.withColumn("k", F.floor((row - 1) / LIST)).groupBy("i", "j", "k").agg(F.collect_list(point).alias("near")).drop("k")


def nearest(left: DataFrame, points: DataFrame, dx: float = 1.0, dy: float = 1.0, keys: tuple[str, ...] = ("r", "c")) -> DataFrame:
    """left's keys with dist and the columns p_* of the nearest of points (r, c, ord, ...); of points as near, the first by ord.

    Places off any grid, as many as there may be. Each place looks at the points of its square and the eight about it; what is
    found within a square's side is the nearest. Only places that found nothing so near go on, with squares twice as wide. A
    place or a point that occurs often is looked at once. The points of a square come as lists, and of places and points the
    fewer are copied to the nine squares: no pair of the two is ever a row. Where points lie in crowds, squares begin smaller."""
    at = lambda r, c: (F.col(r) * dy, F.col(c) * dx)
    rest = [c for c in points.columns if c not in ("r", "c", "ord")]
    first = F.min(F.struct("ord", *rest)).alias("b")
    p = store.stored(points.filter("r IS NOT NULL AND c IS NOT NULL").groupBy(F.col("r").alias("p_r"), F.col("c").alias("p_c")).agg(first), "nearest-points")
    q = store.stored(left.filter("r IS NOT NULL AND c IS NOT NULL").select("r", "c").distinct(), "nearest-places")
    (py, px), (qy, qx) = at("p_r", "p_c"), at("r", "c")
    edges = [F.min, F.max]
    n, *ends = p.agg(F.count("*"), *[f(x) for x in (py, px) for f in edges]).first()
    left_over, *own = q.agg(F.count("*"), *[f(x) for x in (qy, qx) for f in edges]).first()
    found = None
    if n and left_over:
        spans = [max(ends[i + 1], own[i + 1]) - min(ends[i], own[i]) for i in (0, 2)]
        tiny = max(max(spans) / 1e6, 1e-9)
        side = max(1.5 * math.sqrt(max(ends[1] - ends[0], 1e-9) * max(ends[3] - ends[2], 1e-9) / n), tiny)
        square = lambda x: F.floor(x / F.lit(side))
        while side > tiny:
            # The points that a point shares its square with, on average.
            crowd = p.groupBy(square(py).alias("i"), square(px).alias("j")).agg(F.count("*").alias("m")).agg(F.sum(F.col("m").cast("double") * F.col("m")) / n).first()[0]
            if crowd <= CROWD:
                break
            side = max(side / 2, tiny)
        steps = F.array(*[F.lit(i) for i in (-1, 0, 1)])

        def dealt(rows: DataFrame, y: Column, x: Column, to_all: bool) -> DataFrame:
            own = rows.withColumns({"i": square(y), "j": square(x)})
            if not to_all:
                return own
            own = own.withColumn("a", F.explode(steps)).withColumn("i", F.col("i") + F.col("a"))
            return own.withColumn("a", F.explode(steps)).withColumn("j", F.col("j") + F.col("a")).drop("a")

        def measured(x: Column) -> Column:
            y, z = x["p_r"] * dy, x["p_c"] * dx
            return F.struct(F.sqrt((y - qy) ** 2 + (z - qx) ** 2).alias("dist"), *[x[f"p_{c}"].alias(f"p_{c}") for c in ("ord", "r", "c", *rest)])

        while True:
            few = left_over < n
            near = dealt(q, qy, qx, few).join(_lists(dealt(p, py, px, not few), rest), ["i", "j"], "left")
            best = near.select("i", "j", "r", "c", F.array_min(F.transform("near", measured)).alias("b"))
            # A place that is in one square only has all its lists in it, and so in one task.
            best = best.groupBy(*([] if few else ["i", "j"]), "r", "c").agg(F.min("b").alias("b"))
            last = side > max(spans)
            looked = store.stored(best.select("r", "c", "b"), "nearest-round")
            sure = F.col("b").isNotNull() & (F.lit(last) | (F.col("b.dist") < side))
            done = looked.filter(sure).select("r", "c", "b.*")
            found = done if found is None else found.unionByName(done)
            q = looked.filter(~sure).select("r", "c")
            if last or not (left_over := q.count()):
                break
            side *= 2
    if found is None:
        found = q.limit(0).crossJoin(p.limit(0).select(F.lit(0.0).alias("dist"), F.col("b.ord").alias("p_ord"), "p_r", "p_c", *[F.col(f"b.{c}").alias(f"p_{c}") for c in rest]))
    columns = [c for c in found.columns if c not in ("r", "c")]
    return left.select(*dict.fromkeys([*keys, "r", "c"])).join(found, ["r", "c"]).select(*keys, *columns)


def inside_ring(x: Column, y: Column, ring: list[tuple[float, float]]) -> Column:
    """Whether a point lies in a polygon ring, by the parity of crossings."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
        if y1 != y2:
            hits = ((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
            crossings = crossings + hits.cast("int")
    return crossings % 2 == 1


def burn_line(meta: Meta, line: list[tuple[float, float]], grid: DataFrame) -> DataFrame:
    """The cells that a line of (x, y) touches: segments against cell boxes, by clipping."""
    touched = F.lit(False)
    x0, y1 = meta.x0 + F.col("c") * meta.dx, meta.y0 + F.col("r") * meta.dy
    x1, y0 = x0 + meta.dx, y1 + meta.dy
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        lows, highs, apart = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
        for a, b, lo, hi in ((ax, bx, x0, x1), (ay, by, y0, y1)):
            if a == b:
                apart |= (F.lit(a) < lo) | (F.lit(a) > hi)
            else:
                t, u = (lo - a) / (b - a), (hi - a) / (b - a)
                lows.append(F.least(t, u))
                highs.append(F.greatest(t, u))
        touched |= ~apart & (F.greatest(*lows) <= F.least(*highs))
    return grid.filter(touched)


def segments(parts: DataFrame, closed: bool) -> DataFrame:
    """(part, ax, ay, bx, by): the sides of parts (part, p: an array of points), with the last to the first if closed."""
    p, n = F.col("p"), F.size("p")
    ends = F.slice("p", F.lit(2), n)
    starts, ends = (p, F.concat(ends, F.slice("p", F.lit(1), F.lit(1)))) if closed else (F.slice("p", F.lit(1), n - 1), ends)
    side = lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by"))
    return parts.filter(n > 0).select("part", F.inline(F.zip_with(starts, ends, side)))


def _range(low: Column, high: Column, n: int) -> Column:
    """The whole numbers from low to high that lie in 0 to n - 1."""
    a, b = (F.greatest(F.lit(0.0), F.least(F.lit(float(n)), F.floor(low).cast("double"))).cast("int"), F.greatest(F.lit(-1.0), F.least(F.lit(n - 1.0), F.floor(high).cast("double"))).cast("int"))
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))


def burn_segments(sides: DataFrame, meta: Meta) -> DataFrame:
    """The distinct cells that segments touch, as burn_line has them, for any number of segments.

    A segment goes to the rows of its span and, in a row, to the columns of its piece there; both with a cell to spare,
    then the exact test."""
    ax, ay, bx, by = (F.col(n) for n in ("ax", "ay", "bx", "by"))
    fa, fb = (ay - meta.y0) / meta.dy, (by - meta.y0) / meta.dy
    rows = sides.select("ax", "ay", "bx", "by", F.explode(_range(F.least(fa, fb) - 1, F.greatest(fa, fb) + 1, meta.h)).alias("r"))
    clip = lambda t: F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    top, bottom = meta.y0 + (F.col("r") - 0.01) * meta.dy, meta.y0 + (F.col("r") + 1.01) * meta.dy
    t, u = (F.when(ay == by, end).otherwise(clip((edge - ay) / F.nullif(by - ay, F.lit(0.0)))) for edge, end in ((top, 0.0), (bottom, 1.0)))
    ft, fu = (ax + t * (bx - ax) - meta.x0) / meta.dx, (ax + u * (bx - ax) - meta.x0) / meta.dx
    at = rows.select("*", F.explode(_range(F.least(ft, fu) - 1, F.greatest(ft, fu) + 1, meta.w)).alias("c"))
    x0, y1 = meta.x0 + F.col("c") * meta.dx, meta.y0 + F.col("r") * meta.dy
    lows, highs, apart = [F.lit(0.0)], [F.lit(1.0)], F.lit(False)
    for a, b, lo, hi in ((ax, bx, x0, x0 + meta.dx), (ay, by, y1 + meta.dy, y1)):
        t, u = (lo - a) / F.nullif(b - a, F.lit(0.0)), (hi - a) / F.nullif(b - a, F.lit(0.0))
        apart |= (a == b) & ((a < lo) | (a > hi))
        lows.append(F.least(t, u))  # null, and so passed over, where the segment does not move along this axis
        highs.append(F.greatest(t, u))
    return at.filter(~apart & (F.greatest(*lows) <= F.least(*highs))).select("r", "c").distinct()


def fill_rings(sides: DataFrame, meta: Meta) -> DataFrame:
    """The distinct cells whose centres lie in any ring (part), as inside_ring has them, for any number of rings.

    A ring's crossings of a row are sorted; between the first and the second, the third and the fourth, ... is inside."""
    ax, ay, bx, by = (F.col(n) for n in ("ax", "ay", "bx", "by"))
    fa, fb = (ay - meta.y0) / meta.dy - 0.5, (by - meta.y0) / meta.dy - 0.5
    rows = sides.filter(ay != by).select("*", F.explode(_range(F.least(fa, fb) - 1, F.greatest(fa, fb) + 1, meta.h)).alias("r"))
    y = meta.y0 + (F.col("r") + 0.5) * meta.dy
    crossed = rows.filter((ay > y) != (by > y)).select("part", "r", ((bx - ax) * (y - ay) / (by - ay) + ax).alias("x"))
    lines = crossed.groupBy("part", "r").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # a ring's sides at most
    pairs = F.transform(F.sequence(F.lit(1), F.size("xs"), F.lit(2)), lambda i: F.struct(F.element_at("xs", i).alias("lo"), F.element_at("xs", i + 1).alias("hi")))
    spans = lines.select("r", F.inline(pairs))
    f = lambda x: (x - meta.x0) / meta.dx - 0.5
    at = spans.select("r", "lo", "hi", F.explode(_range(F.least(f(F.col("lo")), f(F.col("hi"))) - 1, F.greatest(f(F.col("lo")), f(F.col("hi"))) + 1, meta.w)).alias("c"))
    x = meta.x0 + (F.col("c") + 0.5) * meta.dx
    return at.filter((x >= F.col("lo")) & (x < F.col("hi"))).select("r", "c").distinct()
