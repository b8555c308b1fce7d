"""Centres, displacements, unwrapping, RMSD and correlation functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewalk.functions import geometry
from framewalk.functions.geometry import box_columns, box_matrix, min_image, wrap_into
from framewalk.operators.contacts import AXES
from framewalk.operators.lags import correlate, lag_pairs
from framewalk.session import drop, importable, kept


def _xyz(prefix: str = ""):
    return tuple(F.col(f"{prefix}{a}") for a in AXES)


def centers(positions: DataFrame, keys: list[str], weight: Column | None = None, boxes: DataFrame | None = None, whole: str | None = None, wrapped: bool = False) -> DataFrame:
    """(keys, x, y, z): centres of groups of positions, weighted (mass, charge) or of geometry; null where the weights sum to 0.

    With boxes (by frame, which is one of the keys then): whole, a column that orders the particles of a group, makes each
    group whole first (each particle at its image nearest to the group's first); wrapped brings the centres into the box.
    """
    rows = positions if weight is None else positions.withColumn("_w", weight.cast("double"))
    if whole is not None:
        extra = [c for c in rows.columns if c not in ("frame", *AXES)]
        rows = make_whole(rows, boxes, [k for k in keys if k != "frame"], whole).select("frame", *extra, *AXES)
    if weight is None:
        made = rows.groupBy(*keys).agg(*(F.avg(a).alias(a) for a in AXES))
    else:
        made = rows.groupBy(*keys).agg(*(F.try_divide(F.sum(F.col("_w") * F.col(a)), F.sum("_w")).alias(a) for a in AXES))
    return wrap(made, boxes).select(*keys, *AXES) if wrapped else made


def compound_attribute(atoms: DataFrame, keys: list[str], attribute: str, weight: str | None = None) -> DataFrame:
    """(keys, value): an attribute by compound; weight None is the mean, "total" the sum, else a column to weigh by."""
    if weight is None:
        value = F.avg(attribute)
    elif weight == "total":
        value = F.sum(attribute)
    else:
        value = F.try_divide(F.sum(F.col(weight) * F.col(attribute)), F.sum(weight))
    return atoms.groupBy(*keys).agg(value.alias("value"))


def atoms_per_compound(atoms: DataFrame, keys: list[str]) -> DataFrame:
    return atoms.groupBy(*keys).agg(F.count("*").alias("n_atoms"))


def with_boxes(positions: DataFrame, boxes: DataFrame) -> DataFrame:
    return positions.join(boxes.select("frame", *box_columns(boxes.columns)), "frame")


def wrap(positions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Positions shifted into their boxes; boxes has (frame, lx, ly, lz[, alpha, beta, gamma])."""
    box = box_columns(boxes.columns)
    rows = with_boxes(positions, boxes)
    return rows.withColumns(dict(zip(AXES, wrap_into(_xyz(), box)))).drop(*box)


def wrap_compounds(positions: DataFrame, boxes: DataFrame, compound: str, weight: str | None = None) -> DataFrame:
    """Positions moved so that the centre of each compound lies in the box, the compound being kept as it is."""
    w = Window.partitionBy("frame", compound)
    box = box_columns(boxes.columns)
    rows = with_boxes(positions, boxes)
    mean = lambda a: F.avg(a).over(w) if weight is None else F.try_divide(F.sum(F.col(weight) * F.col(a)).over(w), F.sum(weight).over(w))
    rows = rows.withColumns({f"_{a}": mean(a) for a in AXES})
    moved = [x + (c - was) for x, c, was in zip(_xyz(), wrap_into(_xyz("_"), box), _xyz("_"))]
    return rows.withColumns(dict(zip(AXES, moved))).drop(*box, "_x", "_y", "_z")


def make_whole(positions: DataFrame, boxes: DataFrame, compound: str | list[str], order: str, reference: str = "first", weight: str | None = None) -> DataFrame:
    """Compounds smaller than half a box made whole: each atom goes to the image nearest to the compound's first.

    reference "cog" or "com" (with weight, the masses) also brings the whole compound's centre into the box.
    """
    if reference not in ("first", "cog", "com") or (reference == "com") != (weight is not None):
        raise ValueError("reference is first, cog, or com with a weight")
    keys = [compound] if isinstance(compound, str) else compound
    box = box_columns(boxes.columns)
    group = Window.partitionBy("frame", *keys)
    w = group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = with_boxes(positions, boxes).withColumns({f"_{a}": F.first(a).over(w) for a in AXES})
    near = min_image([x - x0 for x, x0 in zip(_xyz(), _xyz("_"))], box)
    rows = rows.withColumns({a: F.col(f"_{a}") + d for a, d in zip(AXES, near)})
    if reference != "first":
        mean = lambda a: F.avg(a).over(group) if weight is None else F.try_divide(F.sum(F.col(weight) * F.col(a)).over(group), F.sum(weight).over(group))
        rows = rows.withColumns({f"_{a}": mean(a) for a in AXES})
        rows = rows.withColumns({a: x + (c - was) for a, x, c, was in zip(AXES, _xyz(), wrap_into(_xyz("_"), box), _xyz("_"))})
    return rows.drop(*box, "_x", "_y", "_z")


def matrices(rows: pd.DataFrame, box: list[str]) -> np.ndarray:
    """The box matrices of rows that have a box's columns, one each."""
    out = np.zeros((len(rows), 3, 3))
    lengths = rows[box[:3]].to_numpy(float)
    if len(box) == 3:
        out[:, range(3), range(3)] = lengths
        return out
    a, b, g = np.cos(np.radians(rows[box[3:]].to_numpy(float))).T
    sine = np.sqrt(1 - g * g)
    y = (a - b * g) / sine
    out[:, 0, 0] = lengths[:, 0]
    out[:, 1, 0], out[:, 1, 1] = lengths[:, 1] * g, lengths[:, 1] * sine
    out[:, 2, 0], out[:, 2, 1], out[:, 2, 2] = lengths[:, 2] * b, lengths[:, 2] * y, lengths[:, 2] * np.sqrt(1 - b * b - y * y)
    return out


def images(d: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """The numbers of box vectors by which differences are off their minimum images: by the divisions of geometry.cart2box, so that halves fall as there."""
    z = d[..., 2] / matrix[..., 2, 2]
    y = (d[..., 1] - z * matrix[..., 2, 1]) / matrix[..., 1, 1]
    x = (d[..., 0] - z * matrix[..., 2, 0] - y * matrix[..., 1, 0]) / matrix[..., 0, 0]
    return np.floor(np.stack([x, y, z], axis=-1) + 0.5)


_SHIFT = ("i", "j", "k")


def _doubled(hooks: DataFrame) -> DataFrame:
    """hooks (frame, a, to, i, j, k), each leading to a smaller one, with `to` the last one of the way, and the shifts along it summed.

    Each round replaces a pointer by that of where it leads: log2 of the longest way rounds.
    """
    while True:
        ahead = hooks.select("frame", F.col("a").alias("to"), F.col("to").alias("_to"), *(F.col(c).alias(f"_{c}") for c in _SHIFT))
        joined = hooks.join(ahead, ["frame", "to"], "left")
        moved = kept(joined.select("frame", "a", F.coalesce("_to", "to").alias("to"), *((F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in _SHIFT), F.col("_to").isNotNull().alias("went")), "pointers")
        drop(hooks)
        hooks = moved.drop("went")
        if moved.where("went").isEmpty():
            return hooks


def _contracted(edges: DataFrame, hooks: DataFrame) -> DataFrame:
    """edges (frame, a, b, i, j, k) between what their ends lead to, one for each pair, without those inside of one."""
    end = lambda c: hooks.select("frame", F.col("a").alias(c), F.col("to").alias(f"{c}2"), *(F.col(x).alias(f"{x}{c}") for x in _SHIFT))
    both = edges.join(end("a"), ["frame", "a"], "left").join(end("b"), ["frame", "b"], "left")
    zero = F.lit(0)
    moved = both.select("frame", F.coalesce("a2", "a").alias("a"), F.coalesce("b2", "b").alias("b"), *((F.col(x) + F.coalesce(f"{x}b", zero) - F.coalesce(f"{x}a", zero)).alias(x) for x in _SHIFT))
    return moved.where("a <> b").groupBy("frame", "a", "b").agg(F.min(F.struct(*_SHIFT)).alias("s")).select("frame", "a", "b", "s.*")


def make_whole_by_bonds(positions: DataFrame, boxes: DataFrame, compound: str, atom: str, bonds: DataFrame) -> DataFrame:
    """Compounds of any size made whole along bonds(a, b), each one of atoms of one compound: bonded atoms go to each other's nearest images.

    Of what bonds hold together, the atom with the least number stays where it is.  Every bond says by how many box vectors its ends are apart.  A
    round hooks each atom to its least bonded one, if that is less than it; follows the hooks to their ends by pointer doubling, adding
    the shifts on the way; and goes on with what is left of the bonds, which then join those ends.  Hooks part a chain, however
    long, into few pieces at once, so that rounds and joins are about the logarithm of a compound's size, and a compound is
    rows, not a group.  Where rings or bonds as long as half a box leave a choice, some way along the bonds decides.
    """
    box = box_columns(boxes.columns)
    chosen = with_boxes(positions, boxes)
    matrix = box_matrix(box)
    points = chosen.select("frame", F.col(atom).alias("_a"), *AXES)
    first = chosen.select("frame", F.col(atom).alias("a"), *AXES, *box)
    second = points.select("frame", F.col("_a").alias("b"), *(F.col(c).alias(f"_{c}") for c in AXES))
    known = bonds.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    apart = known.join(first, "a").join(second, ["frame", "b"])
    steps = geometry.cart2box(tuple(F.col(f"_{c}") - F.col(c) for c in AXES), matrix)
    # a's shift is b's and this
    there = apart.select("frame", "a", "b", *(F.floor(x + 0.5).cast("long").alias(c) for c, x in zip(_SHIFT, steps)))
    edges = kept(there.unionByName(there.select("frame", F.col("b").alias("a"), F.col("a").alias("b"), *((-F.col(c)).alias(c) for c in _SHIFT))), "bonds")
    at = chosen.select("frame", F.col(atom).alias("_atom"), F.col(atom).alias("_at"), *(F.lit(0).cast("long").alias(f"_{c}") for c in _SHIFT))
    while not edges.isEmpty():
        least = edges.where("b < a").groupBy("frame", "a").agg(F.min(F.struct("b", *_SHIFT)).alias("s"))
        hooks = _doubled(kept(least.select("frame", "a", F.col("s.b").alias("to"), *(F.col(f"s.{c}").alias(c) for c in _SHIFT)), "hooks"))
        led = hooks.select("frame", F.col("a").alias("_at"), "to", *_SHIFT)
        at = at.join(led, ["frame", "_at"], "left").select("frame", "_atom", F.coalesce("to", "_at").alias("_at"), *((F.col(f"_{c}") + F.coalesce(c, F.lit(0))).alias(f"_{c}") for c in _SHIFT))
        left = kept(_contracted(edges, hooks), "bonds")
        drop(edges)
        edges = left
    rows = chosen.withColumn("_atom", F.col(atom)).join(at.drop("_at"), ["frame", "_atom"])
    moved = geometry.box2cart(tuple(F.col(f"_{c}").cast("double") for c in _SHIFT), matrix)
    return rows.withColumns({a: F.col(a) + m for a, m in zip(AXES, moved)}).select(*positions.columns)


def unwrap(positions: DataFrame, boxes: DataFrame, key: str, method: str = "scaling") -> DataFrame:
    """positions(frame, key, x, y, z), wrapped, made continuous in time; each particle starts from where it is in its first frame.

    scaling, displacement, in-house: the steps do not depend on the result, so that they are running
    sums over a window by particle.  heuristic, hybrid: the result of a frame enters the next, so that each
    particle is a group.  Boxes may be skewed: steps are counted in box vectors then.
    """
    box = box_columns(boxes.columns)
    rows = with_boxes(positions.select("frame", key, *AXES), boxes)
    w = Window.partitionBy(key).orderBy("frame")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    if method in ("heuristic", "hybrid"):
        importable(positions.sparkSession)

        def one(r: pd.DataFrame) -> pd.DataFrame:
            r = r.sort_values("frame")
            xyz, cells = r[list(AXES)].to_numpy(float), matrices(r, box)
            out = xyz.copy()
            if method == "hybrid":
                d = np.diff(xyz, axis=0)
                crossed = np.einsum("ti,tij->tj", images(d, cells[1:]), cells[1:])
            for t in range(1, len(out)):
                if method == "heuristic":
                    out[t] = xyz[t] - images(xyz[t] - out[t - 1], cells[t]) @ cells[t]
                else:
                    out[t] = out[t - 1] + d[t - 1] - crossed[t - 1] - images(xyz[t - 1] - out[t - 1], cells[t - 1]) @ (cells[t] - cells[t - 1])
            r[list(AXES)] = out
            return r[["frame", key, *AXES]]

        return rows.groupBy(key).applyInPandas(one, rows.select("frame", key, *AXES).schema)
    if method not in ("scaling", "displacement", "in-house"):
        raise ValueError(f"unknown method {method!r}")
    first = Window.partitionBy(key).orderBy("frame").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    matrix = box_matrix(box)
    if method == "displacement":
        rows = rows.withColumns({f"_{a}": F.col(a) - F.lag(a).over(w) for a in AXES})
        steps = min_image(_xyz("_"), box)
    else:
        rows = rows.withColumns({f"_s{a}": c for a, c in zip(AXES, geometry.cart2box(_xyz(), matrix))})
        rows = rows.withColumns({f"_{a}": F.col(f"_s{a}") - F.lag(f"_s{a}").over(w) for a in AXES})
        crossed = [F.floor(F.col(f"_{a}") + 0.5) for a in AXES]
        steps = [-c for c in crossed] if method == "scaling" else geometry.box2cart(tuple(F.col(f"_{a}") - c for a, c in zip(AXES, crossed)), matrix)
    rows = rows.withColumns({f"_d{a}": F.coalesce(c, F.lit(0.0)) for a, c in zip(AXES, steps)})
    sums = tuple(F.sum(f"_d{a}").over(upto) for a in AXES)
    if method == "scaling":
        done = [x + m for x, m in zip(_xyz(), geometry.box2cart(sums, matrix))]
    else:
        done = [F.first(a).over(first) + x for a, x in zip(AXES, sums)]
    return rows.select("frame", key, *(x.alias(a) for a, x in zip(AXES, done)))


def _longest(n_frames: int, max_lag: int | None) -> int:
    return n_frames - 1 if max_lag is None else min(n_frames - 1, max_lag)


def msd(positions: DataFrame, key: str, n_frames: int, restart: int = 1, max_lag: int | None = None, block: Column | None = None) -> DataFrame:
    """([block,] lag, n, msd_x, msd_y, msd_z, msd): mean square displacement by lag, over particles and starts 0, restart, ...

    block splits the frames (numbered from 0 in each block by the caller).  Starts meet the frames of their particle's
    next buckets (see lags), so that max_lag bounds the pairs: particles times starts times about 2 * max_lag.
    """
    keys = ["block"] if block is not None else []
    rows = positions.select("frame", key, *AXES, *([block.alias("block")] if keys else []))
    starts = rows.where(F.col("frame") % restart == 0).select(*keys, key, F.col("frame").alias("f0"), *(F.col(a).alias(f"{a}0") for a in AXES))
    pairs = lag_pairs(starts, rows, [*keys, key], _longest(n_frames, max_lag))
    square = {a: (F.col(a) - F.col(f"{a}0")) * (F.col(a) - F.col(f"{a}0")) for a in AXES}
    made = pairs.groupBy(*keys, "lag").agg(F.count("*").alias("n"), *(F.avg(square[a]).alias(f"msd_{a}") for a in AXES))
    return made.withColumn("msd", F.col("msd_x") + F.col("msd_y") + F.col("msd_z"))


def msd_all_lags(positions: DataFrame, key: str, block: Column | None = None) -> DataFrame:
    """msd with every frame as a start and no bound on the lag.

    A particle's series is a group (as many rows as frames); its sums over all pairs are correlations of the coordinates and
    their squares, so that a long series takes frames * log(frames) steps.  Frames may be missing: a series of ones where there are
    some gives the numbers of pairs.
    """
    importable(positions.sparkSession)
    keys = ["block"] if block is not None else []
    rows = positions.select(*([block.cast("int").alias("block")] if keys else []), key, F.col("frame").cast("int").alias("frame"), *(F.col(a).cast("double").alias(a) for a in AXES))

    def one(r: pd.DataFrame) -> pd.DataFrame:
        frames = r["frame"].to_numpy()
        there = np.zeros(frames.max() + 1)
        there[frames] = 1.0
        n = np.rint(correlate(there, there))
        out = {k: r[k].iloc[0] for k in keys} | {"lag": np.arange(len(there), dtype=np.int32), "n": n.astype(np.int64)}
        for a in AXES:
            x = np.zeros(len(there))
            x[frames] = r[a].to_numpy() - r[a].mean()  # sums of smaller values lose less
            square = x * x
            out[f"s{a}"] = np.maximum(0.0, correlate(square, there) + correlate(there, square) - 2 * correlate(x, x))
        made = pd.DataFrame(out)
        made.loc[0, ["sx", "sy", "sz"]] = 0.0
        return made[made["n"] > 0]

    sums = rows.groupBy(*keys, key).applyInPandas(one, ", ".join([*(f"{k} int" for k in keys), "lag int, n long, sx double, sy double, sz double"]))
    made = sums.groupBy(*keys, "lag").agg(F.sum("n").alias("n"), *((F.sum(f"s{a}") / F.sum("n")).alias(f"msd_{a}") for a in AXES))
    return made.withColumn("msd", F.col("msd_x") + F.col("msd_y") + F.col("msd_z"))


def msd_by_layer(positions: DataFrame, key: str, layers: DataFrame, n_frames: int, restart: int = 1, max_lag: int | None = None) -> DataFrame:
    """(layer, lag, n, md_*, msd_*): displacements by lag and the particle's layer at the start; layers is (frame, key, layer)."""
    starts = positions.where((F.col("frame") % restart == 0) & (F.col("frame") < n_frames - 1)).join(layers.select("frame", key, "layer"), ["frame", key])
    starts = starts.select(key, "layer", F.col("frame").alias("f0"), *(F.col(a).alias(f"{a}0") for a in AXES))
    pairs = lag_pairs(starts, positions.select("frame", key, *AXES), [key], _longest(n_frames, max_lag))
    d = {a: F.col(a) - F.col(f"{a}0") for a in AXES}
    return pairs.groupBy("layer", "lag").agg(F.count("*").alias("n"), *(F.avg(d[a]).alias(f"md_{a}") for a in AXES), *(F.avg(d[a] * d[a]).alias(f"msd_{a}") for a in AXES))


def msd_by_layer_all_lags(positions: DataFrame, key: str, layers: DataFrame, n_frames: int) -> DataFrame:
    """msd_by_layer with every frame but the last as a start and no bound on the lag; layers are whole numbers.

    As in msd_all_lags, a particle's sums over all pairs are correlations: of the frames at which it starts in a layer with
    its coordinates and their squares.  So its steps are layers * frames * log(frames).
    """
    importable(positions.sparkSession)
    rows = positions.select(key, F.col("frame").cast("int").alias("frame"), *(F.col(a).cast("double").alias(a) for a in AXES)).join(layers.select(key, "frame", F.col("layer").cast("int").alias("layer")), [key, "frame"], "left")

    def one(r: pd.DataFrame) -> pd.DataFrame:
        frames = r["frame"].to_numpy()
        size = frames.max() + 1
        there = np.zeros(size)
        there[frames] = 1.0
        series = {}
        for a in AXES:
            series[a] = np.zeros(size)
            series[a][frames] = r[a].to_numpy() - r[a].mean()  # sums of smaller values lose less
        made = []
        for layer in np.unique(r["layer"].dropna()):
            start = np.zeros(size)
            start[frames[(r["layer"] == layer).to_numpy()]] = 1.0
            start[n_frames - 1 :] = 0.0
            n = np.rint(correlate(start, there))
            out = {"layer": np.int32(layer), "lag": np.arange(size, dtype=np.int32), "n": n.astype(np.int64)}
            for a, x in series.items():
                own = start * x
                out[f"s{a}"] = correlate(start, x) - correlate(own, there)
                out[f"q{a}"] = np.maximum(0.0, correlate(start, x * x) + correlate(own * x, there) - 2 * correlate(own, x))
                out[f"s{a}"][0] = out[f"q{a}"][0] = 0.0
            made.append(pd.DataFrame(out)[n > 0])
        names = ["layer", "lag", "n", *(f"{k}{a}" for a in AXES for k in "sq")]
        return pd.concat(made)[names] if made else pd.DataFrame(columns=names)

    sums = rows.groupBy(key).applyInPandas(one, "layer int, lag int, n long, " + ", ".join(f"{k}{a} double" for a in AXES for k in "sq"))
    mean = lambda c, name: (F.sum(c) / F.sum("n")).alias(name)
    return sums.groupBy("layer", "lag").agg(F.sum("n").alias("n"), *(mean(f"s{a}", f"md_{a}") for a in AXES), *(mean(f"q{a}", f"msd_{a}") for a in AXES))


def block_average(blocks: DataFrame, keys: list[str], value: str, ddof: int = 0) -> DataFrame:
    """(keys, mean, sd): mean over the blocks and its standard deviation, that of the blocks over the root of their number."""
    std = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    return blocks.groupBy(*keys).agg(F.avg(value).alias("mean"), (std / F.sqrt(F.count(value))).alias("sd"))


def lag_at_value(curve: DataFrame, keys: list[str], x: str, y: str, value: float) -> DataFrame:
    """(keys, x): where y comes nearest to a value, the first of equals."""
    best = F.min_by(x, F.struct(F.abs(F.col(y) - value), F.col(x)))
    return curve.groupBy(*keys).agg(best.alias(x))


def rmsd(ref: DataFrame, sel: DataFrame, keys: list[str], particle: str, weight: str | None = None, boxes: DataFrame | None = None, center: bool = False) -> DataFrame:
    """(keys, n, msd_x, msd_y, msd_z, rmsd): deviation of two position sets, paired by particle.

    Weights are normalised to a sum of 1, and the sum is divided by the number of particles.  The sets must have
    other columns of the same names in the keys only; center takes each set's own centre away first.
    """
    def ready(p: DataFrame, tag: str) -> DataFrame:
        if center:
            w = Window.partitionBy(*keys)
            p = p.withColumns({f"_{a}": F.col(a) - (F.avg(a).over(w) if weight is None else F.try_divide(F.sum(F.col(weight) * F.col(a)).over(w), F.sum(weight).over(w))) for a in AXES})
        else:
            p = p.withColumns({f"_{a}": F.col(a).cast("double") for a in AXES})
        return p.select(*keys, particle, *(F.col(f"_{a}").alias(f"{tag}{a}") for a in AXES), *([F.col(weight).alias("_w")] if weight and tag == "a" else []))

    pairs = ready(ref, "a").join(ready(sel, "b"), [*keys, particle])
    d = {a: F.col(f"b{a}") - F.col(f"a{a}") for a in AXES}
    if boxes is not None:
        pairs = with_boxes(pairs, boxes)
        d = dict(zip(AXES, min_image([d[a] for a in AXES], box_columns(boxes.columns))))
    w = F.col("_w") if weight else F.lit(1.0)
    made = pairs.groupBy(*keys).agg(F.count("*").alias("n"), *((F.try_divide(F.sum(w * d[a] * d[a]), F.sum(w)) / (F.count("*") if weight else 1)).alias(f"msd_{a}") for a in AXES))
    return made.withColumn("rmsd", F.sqrt(F.col("msd_x") + F.col("msd_y") + F.col("msd_z")))


def rmsd_vs_time(positions: DataFrame, particle: str, frame0: int = 0, **options) -> DataFrame:
    """rmsd of every frame to one of them; the one frame is given to all others through an equi-join on the particle."""
    ref = positions.where(F.col("frame") == frame0).drop("frame")
    frames = positions.select("frame", particle)
    return rmsd(frames.join(ref, particle), positions, ["frame"], particle, **options)
