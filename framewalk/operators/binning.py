"""Grids, histograms and density maps."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewalk.functions.arrays import digitize
from framewalk.operators.joins import with_totals

#: The last edge of a position grid is widened by this share of the interval.
TOL = 1e-6


def histogram(df: DataFrame, value: Column, edges: list[float], keys: list[str] | None = None, closed: bool = True) -> DataFrame:
    """(keys, bin, lo, hi, n) for every bin, left-closed; the last holds its right edge too if closed."""
    keys = keys or []
    last = len(edges) - 1
    b = digitize(F.col("_v"), edges) - 1
    b = F.when(F.col("_v") == float(edges[-1]), last - 1 if closed else None).otherwise(b)
    counted = df.select(*keys, value.cast("double").alias("_v")).select(*keys, b.alias("bin")).where((F.col("bin") >= 0) & (F.col("bin") < last)).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    bins = F.inline(F.array(*(F.struct(F.lit(k).alias("bin"), F.lit(float(edges[k])).alias("lo"), F.lit(float(edges[k + 1])).alias("hi")) for k in range(last))))
    grid = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    grid = grid.select(*keys, bins)
    return grid.join(counted, [*keys, "bin"], "left").fillna(0, ["n"])


def discrete_positions(positions: DataFrame, boxes: DataFrame, axis: str, edges: list[float]) -> DataFrame:
    """(cmp, frame, state): the bin of each compound's position relative to the box, along an axis.

    edges are relative, from 0 to 1; the last is widened so that all wrapped positions fall in a bin.
    positions has (cmp, frame, x, y, z), boxes (frame, lx, ly, lz), which is joined on the frame.
    """
    inner = [*edges[:-1], edges[-1] + TOL]
    rows = positions.join(boxes.select("frame", F.col(f"l{axis}").alias("_l")), "frame")
    rel = F.col(axis) / F.col("_l")
    return rows.select("cmp", "frame", (digitize(rel - F.floor(rel), inner) - 1).alias("state"))


def reported_edges(boxes: DataFrame, axis: str, edges: list[float]) -> DataFrame:
    """(edge, value): the edges scaled by the mean box length."""
    array = F.posexplode(F.lit([float(e) for e in edges]))
    return boxes.agg(F.avg(f"l{axis}").alias("_l")).select("_l", array.alias("edge", "_e")).select("edge", (F.col("_e") * F.col("_l")).alias("value"))


def assign_to_grid(positions: DataFrame, edges: dict[str, list[float]], discard_below: bool = False, discard_above: bool = False) -> DataFrame:
    """positions with b<axis> (0 below, len(edges) from the last on) and cell, one number for all axes."""
    rows = positions.withColumns({f"b{a}": digitize(F.col(a), e) for a, e in edges.items()})
    for a, e in edges.items():
        rows = rows.where(F.col(f"b{a}") > 0) if discard_below else rows
        rows = rows.where(F.col(f"b{a}") < len(e)) if discard_above else rows
    cell = F.lit(0)
    for a, e in edges.items():
        cell = cell * (len(e) + 1) + F.col(f"b{a}")
    return rows.withColumn("cell", cell)


def density_map(positions: DataFrame, boxes: DataFrame, plane: tuple[str, str], slab_axis: str, slab: tuple[float, float], bins: tuple[int, int]) -> DataFrame:
    """(bx, by, n, density): particles by cell of a plane, in a slab of relative height, per frame and mean volume of a cell.

    Positions are wrapped; every cell of the map has a row.
    """
    top = 1 + TOL if slab[1] >= 1 else slab[1]
    lengths = {a: F.col(f"l{a}") for a in (*plane, slab_axis)}
    rows = positions.join(boxes.select("frame", *(f"l{a}" for a in lengths)), "frame")
    rel = {a: F.col(a) / lengths[a] - F.floor(F.col(a) / lengths[a]) for a in lengths}
    rows = rows.where((rel[slab_axis] >= slab[0]) & (rel[slab_axis] < top))
    cell = [F.least(F.lit(n - 1), F.floor(rel[a] * n).cast("int")) for a, n in zip(plane, bins)]
    counted = rows.select(cell[0].alias("bx"), cell[1].alias("by")).groupBy("bx", "by").agg(F.count("*").alias("n"))
    mean = boxes.agg(F.count("*").alias("_f"), F.avg(lengths[plane[0]] * lengths[plane[1]] / (bins[0] * bins[1])).alias("_a"), F.avg(lengths[slab_axis]).alias("_h"))
    grid = positions.sparkSession.range(bins[0]).select(F.col("id").cast("int").alias("bx"), F.explode(F.sequence(F.lit(0), F.lit(bins[1] - 1))).alias("by"))
    full = grid.join(counted, ["bx", "by"], "left").fillna(0, ["n"])
    full = with_totals(full, mean)
    return full.select("bx", "by", "n", F.try_divide(F.col("n"), F.col("_f") * F.col("_a") * F.col("_h") * (min(slab[1], 1.0) - slab[0])).alias("density"))


def subvolume_charge(positions: DataFrame, boxes: DataFrame, cube_lengths: list[float]) -> DataFrame:
    """(length, n_cubes, n_atoms, mean_q, mean_q2): net charge of the whole cubes of each length that fit into the boxes.

    positions has (frame, x, y, z, q), wrapped.  Empty cubes count; atoms beyond the last whole cube do not.
    """
    sizes = F.explode(F.lit([float(c) for c in cube_lengths])).alias("length")
    per_box = boxes.select("frame", "lx", "ly", "lz", sizes).withColumns({f"n{a}": F.floor(F.col(f"l{a}") / F.col("length")) for a in "xyz"})
    rows = positions.join(per_box, "frame").withColumns({f"c{a}": F.floor(F.col(a) / F.col("length")) for a in "xyz"})
    inside = rows.where("cx >= 0 and cy >= 0 and cz >= 0 and cx < nx and cy < ny and cz < nz")
    cubes = inside.groupBy("length", "frame", "cx", "cy", "cz").agg(F.sum("q").alias("q"), F.count("*").alias("n"))
    total = cubes.groupBy("length").agg(F.sum("q").alias("q"), F.sum(F.col("q") * F.col("q")).alias("q2"), F.sum("n").alias("n_atoms"))
    counted = per_box.groupBy("length").agg(F.sum(F.col("nx") * F.col("ny") * F.col("nz")).cast("long").alias("n_cubes"))
    return counted.join(total, "length", "left").select("length", "n_cubes", F.coalesce("n_atoms", F.lit(0)).alias("n_atoms"), F.try_divide(F.coalesce("q", F.lit(0.0)), F.col("n_cubes")).alias("mean_q"), F.try_divide(F.coalesce("q2", F.lit(0.0)), F.col("n_cubes")).alias("mean_q2"))


def nearest_site(positions: DataFrame, sites: DataFrame, lengths: tuple[float, float], z: tuple[float, float] | None = None, fill: int = -1) -> DataFrame:
    """(cmp, frame, state): the number of the nearest site in the plane, by the minimum image; fill outside the z window.

    sites has (site, x, y).  The plane is cut into cells that hold about one site each; a position is compared with the
    sites of the nine cells around it, joined on the cell.  What has no site within a cell's width there (in a gap of the
    lattice) is compared with all sites, in rows of their own: ties go to the lowest number.
    """
    n_sites = max(1, sites.count())
    edge = math.sqrt(lengths[0] * lengths[1] / n_sites)
    counts = [max(1, int(length / edge)) for length in lengths]
    near = min(length / n for length, n in zip(lengths, counts))

    def cell(x: Column, length: float, n: int) -> Column:
        frac = x / length
        return F.least(F.lit(n - 1), F.floor((frac - F.floor(frac)) * n)).cast("int")

    around = [F.array_distinct(F.array(*(F.pmod(cell(F.col(a), length, n) + k, F.lit(n)) for k in (-1, 0, 1)))) for a, length, n in zip("xy", lengths, counts)]
    spread = sites.select("site", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    point = F.struct("site", F.col("x").alias("_x"), F.col("y").alias("_y"))
    by_cell = spread.withColumn("cx", F.explode(around[0])).withColumn("cy", F.explode(around[1])).groupBy("cx", "cy").agg(F.collect_list(point).alias("_sites"))

    def distance(s: Column) -> Column:
        out = F.lit(0.0)
        for a, length in zip("xy", lengths):
            d = F.col(a) - s[f"_{a}"]
            d = d - F.floor(d / length + 0.5) * length
            out = out + d * d
        return F.struct(out.alias("d"), s["site"].alias("site"))

    inside = F.lit(True) if z is None else (F.col("z") >= z[0]) & (F.col("z") < z[1])
    asked = positions.select("cmp", "frame", "x", "y", inside.alias("_in"), *(cell(F.col(a), length, n).alias(f"c{a}") for a, length, n in zip("xy", lengths, counts)))
    best = asked.join(by_cell, ["cx", "cy"], "left").select("cmp", "frame", "x", "y", "_in", F.array_min(F.transform("_sites", distance)).alias("_b"))
    sure = ~F.col("_in") | (F.col("_b.d") <= near * near)
    sure = F.coalesce(sure, F.lit(False))
    done = best.where(sure).select("cmp", "frame", F.when(F.col("_in"), F.col("_b.site")).otherwise(F.lit(fill)).alias("state"))
    every = spread.groupBy(F.pmod(F.xxhash64("site"), F.lit(-(-n_sites // 1024))).alias("_k")).agg(F.collect_list(point).alias("_sites"))  # at most about 1,024 sites a row
    salts = 64  # so that the rest is dealt out over tasks, each with all sites
    parts = every.select(F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_s"), "_sites")
    rest = best.where(~sure).select("cmp", "frame", "x", "y", F.pmod(F.xxhash64("cmp", "frame"), F.lit(salts)).cast("int").alias("_s")).join(parts, "_s")
    rest = rest.select("cmp", "frame", F.array_min(F.transform("_sites", distance)).alias("_b")).groupBy("cmp", "frame").agg(F.min("_b").alias("_b")).select("cmp", "frame", F.col("_b.site").alias("state"))
    return done.unionByName(rest)


def hexagon_faces(vertices: list[tuple[float, float]], r0: float, lengths: tuple[float, float]) -> list[tuple[float, float]]:
    """Centres of the faces of a hexagonal lattice with a flat side along x: vertices moved by r0 that meet no vertex."""
    def near(p, q):
        d = [(a - b) - length * round((a - b) / length) for a, b, length in zip(p, q, lengths)]
        return d[0] * d[0] + d[1] * d[1] < 1e-4 * r0 * r0

    moved = [((x + r0) % lengths[0], y) for x, y in vertices]
    return [p for p in moved if not any(near(p, v) for v in vertices)]


def hexagon_axes(vertices: list[tuple[float, float]], r0: float, lengths: tuple[float, float], neighbours: int = 1, tol: float = 1e-3) -> list[tuple[float, float, float]]:
    """(x0, y0, angle in degrees to x): the lines through the faces of such a lattice, towards nearest or second-nearest faces.

    Lines that are the same under the periodic images of the box appear once.
    """
    if neighbours not in (1, 2):
        raise ValueError("neighbours is 1 or 2")
    faces = sorted(hexagon_faces(vertices, r0, lengths))
    same = lambda a, b, length: abs(a - b - length * round((a - b) / length)) < tol
    out: list[tuple[float, float, float]] = []
    for angle in (30.0, 90.0, 150.0) if neighbours == 1 else (0.0, 60.0, 120.0):
        slope = math.tan(math.radians(angle))
        seen: list[float] = []
        for x, y in faces:
            at, length = (x, lengths[0]) if angle == 90 else (y - slope * x, lengths[1])  # where the line meets the x axis, or the y axis
            if not any(same(at, other, length) for other in seen):
                seen.append(at)
                out.append((x, y, angle))
    return out


def hexagonal_distribution(positions: DataFrame, axes: list[tuple[float, float, float]], lengths: tuple[float, float], width: float, edges: list[float]) -> DataFrame:
    """(angle, bin, lo, hi, n): distances along the axes of hexagon_axes from their faces, of the positions within width / 2 of an axis.

    Distances to an axis and along it are those to the nearest image; an axis is as long as the box is in its direction.
    """
    found = []
    for x0, y0, angle in axes:
        phi = math.radians(angle)
        if angle == 90:
            off = F.col("x") - x0
            off = off - F.floor(off / lengths[0] + 0.5) * lengths[0]
            along, period = F.col("y") - y0, lengths[1]
        else:
            off = F.col("y") - y0 - math.tan(phi) * (F.col("x") - x0)
            off = (off - F.floor(off / lengths[1] + 0.5) * lengths[1]) * math.cos(phi)
            along, period = (F.col("x") - x0 + off * math.sin(phi)) / math.cos(phi), lengths[0] / abs(math.cos(phi))
        along = F.abs(along - F.floor(along / period + 0.5) * period)
        found.append(F.struct(F.lit(angle).alias("angle"), off.alias("off"), along.alias("s")))
    rows = positions.select(F.explode(F.array(*found)).alias("k")).where(F.abs(F.col("k.off")) < width / 2).select("k.angle", "k.s")
    return histogram(rows, F.col("s"), edges, ["angle"])


def axial_distribution(positions: DataFrame, axes: list[tuple[float, float, float, float]], width: float, edges: list[float]) -> DataFrame:
    """histogram of positions along axes, of those within width / 2 of one; an axis is (x0, y0, ux, uy), u of length 1.

    The axes are few; each position is measured against them in its own row.
    """
    along = F.array(*(F.struct(((F.col("x") - x0) * ux + (F.col("y") - y0) * uy).alias("s"), F.abs((F.col("y") - y0) * ux - (F.col("x") - x0) * uy).alias("d")) for x0, y0, ux, uy in axes))
    rows = positions.select(F.explode(along).alias("k")).where(F.col("k.d") <= width / 2)
    return histogram(rows, F.col("k.s"), edges)


def trapezoid(df: DataFrame, x: str, y: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, integral) of y over x by the trapezoid rule."""
    keys = keys or []
    w = Window.partitionBy(*keys).orderBy(x)
    area = (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2
    return df.select(*keys, area.alias("_a")).groupBy(*keys).agg(F.coalesce(F.sum("_a"), F.lit(0.0)).alias("integral"))


def trapezoid_2d(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """One row: the integral of z over y, then x."""
    return trapezoid(trapezoid(df, y, z, [x]), x, "integral")


def cross_section(matrix: DataFrame, across: str, at: float, width: float, along: str, z: str) -> DataFrame:
    """(along, z): the mean of a long matrix over the cells within width / 2 of a value."""
    return matrix.where(F.abs(F.col(across) - at) <= width / 2).groupBy(along).agg(F.avg(z).alias(z))


def bilinear(matrix: DataFrame, points: DataFrame) -> DataFrame:
    """points(i, x, y) with z, interpolated between the four cells of matrix(r, c, z) around them (numbers of rows and columns)."""
    rows = points.withColumns({"r0": F.floor("x"), "c0": F.floor("y")}).withColumns({"fx": F.col("x") - F.floor("x"), "fy": F.col("y") - F.floor("y")})
    corner = F.explode(F.array(*(F.struct((F.col("r0") + a).alias("r"), (F.col("c0") + b).alias("c"), ((F.col("fx") if a else 1 - F.col("fx")) * (F.col("fy") if b else 1 - F.col("fy"))).alias("w")) for a in (0, 1) for b in (0, 1))))
    met = rows.select("i", "x", "y", corner.alias("k")).select("i", "x", "y", "k.*").where("w > 0").join(matrix.select("r", "c", "z"), ["r", "c"], "left")
    return met.groupBy("i", "x", "y").agg(F.when(F.count("z") == F.count("*"), F.sum(F.col("w") * F.col("z"))).alias("z"))
