"""Contacts of compounds, block by block: the particles are shuffled, and a task finds a block's pairs and sums them by compound.

A block is some reference compounds by some other ones (contacts.in_blocks).  Pairs are many more than particles and mostly seen once, so they are
never rows on their own: in a block they are numbers of an array, compared a bounded many at a time, and what leaves the task is counts or
runs of pairs of compounds.  Where the pairs of particles are the result (particle_pairs), they leave the task as they are found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of particles that are compared at a time, and keys that are held before equal ones are summed.
COMPARED, HELD = 1 << 16, 1 << 22
#: Pairs of a part of a block, the share of the compared ones that are pairs, and particles that it is estimated from.
PART, SHARE, SAMPLE = 4_000_000, 0.34, 4096
#: Places along x are in 2 ** FINE steps of a cell; distances of cells are taken to be shorter by this part of the cutoff than computed.
FINE, NEAR = 10, 1e-6
#: Rows of a batch that leaves a block, and particles that are asked about at a time.
ROWS, ASKED = 1 << 16, 1 << 14


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Numbers in the order of the values, and the values."""
    coded = pa.concat_arrays(column.chunks).dictionary_encode(null_encoding="encode")
    order = pc.sort_indices(coded.dictionary)
    rank = np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    return rank[coded.indices.to_numpy()], coded.dictionary.take(order)


def _found(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Places of keys in known, which is sorted; -1 without one."""
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return np.where(known[at] == keys, at, -1)


def _inside(share: np.ndarray) -> bool:
    share = share[~np.isnan(share)]
    return not len(share) or (share.min() > -NEAR and share.max() < 1 + NEAR)


class Block:
    """The particles of a block by cell.  one has frame, cx, cy, cz, rx, ry, rz and, with boxes, nx, ny, nz and the box; many frame, cx, cy, cz, x, y, z.

    Along x particles are in the order of their places in units of a cell, so that only those within reach are compared: from a row of cells
    the reach is what is left of the cutoff, in a skewed box the cutoff.  Where cells are not those of the places, cells alone count.  group numbers the rows of one that are asked about together.
    """

    def __init__(self, one: dict[str, np.ndarray], many: dict[str, np.ndarray], box: list[str], cutoff: float, group: np.ndarray | None = None):
        self.cutoff, self.box = cutoff, box
        self.frames, frame = np.unique(many["frame"], return_inverse=True)
        at = _found(self.frames, one["frame"])
        self.rows = np.flatnonzero(at >= 0)
        at, one = at[self.rows], {k: v[self.rows] for k, v in one.items()}
        group = np.zeros(len(at), np.int64) if group is None else group[self.rows]
        by = np.lexsort((one["cx"], one["cz"], one["cy"], at, group))  # sorted questions are answered faster
        self.rows, self.at, group, one = self.rows[by], at[by], group[by], {k: v[by] for k, v in one.items()}
        self.groups = np.concatenate(([0], np.flatnonzero(group[1:] != group[:-1]) + 1, [len(group)])) if len(group) else np.zeros(1, np.int64)
        self.n = {a: one[f"n{a}"].astype(np.int64) for a in "xyz"} if box else {}
        first = np.zeros(len(self.frames), np.int64)  # any row of one in the frame knows its box
        first[self.at] = np.arange(len(self.at))
        self.share = self._shares({a: one[f"r{a}"] for a in "xyz"}, one, one, slice(None))
        shares = self._shares(many, many, one, first[frame])
        #: Whether places are known within cells; those of frames that one does not have are not.
        asked = np.bincount(self.at, minlength=len(self.frames))[frame] > 0
        self.placed = all(_inside(v) for v in self.share.values()) and all(_inside(v[asked]) for v in shares.values())
        for found in (self.share, shares):
            for a in "xyz":
                found[a] = np.nan_to_num(np.clip(found[a], 0.0, 1.0)) if self.placed else np.full(len(found[a]), 0.5)
        self.cell, other = {}, {}
        for a in "xyz":
            self.cell[a], other[a] = one[f"c{a}"].astype(np.int64), many[f"c{a}"].astype(np.int64)
            if not box:  # without a box no cell is at the end of a row
                low = min(self.cell[a].min(initial=0), other[a].min(initial=0)) - 1
                self.cell[a], other[a] = self.cell[a] - low, other[a] - low
                self.n[a] = np.full(len(self.at), max(self.cell[a].max(initial=0), other[a].max(initial=0)) + 2)
        self.width = {a: int(max(self.cell[a].max(initial=0), other[a].max(initial=0), self.n[a].max(initial=0))) + 2 for a in "xyz"}
        self.lines, line = np.unique(frame * self.width["y"] + other["y"], return_inverse=True)
        self.columns, column = np.unique(line * self.width["z"] + other["z"], return_inverse=True)
        x = other["x"] + shares["x"]
        place = column * (self.width["x"] << FINE) + (x * (1 << FINE)).astype(np.int64)
        self.order = np.argsort(place, kind="stable")
        self.place, self.frame_of_many = place[self.order], frame[self.order]
        self.many = {a: many[a][self.order] for a in "xyz"}
        self.one = {a: one[f"r{a}"] for a in "xyz"}
        if len(box) > 3:  # of cells along the box vectors, the distance of the two faces that x leads to
            across = one["m11"] * one["m22"]
            height = one["m00"] * across / np.sqrt(across**2 + (one["m10"] * one["m22"]) ** 2 + (one["m10"] * one["m21"] - one["m11"] * one["m20"]) ** 2)
            self.size = {"x": height / self.n["x"]}
        else:
            self.size = {a: one[f"l{a}"] / self.n[a] if box else np.full(len(self.at), float(cutoff)) for a in "xyz"}
        self.shape = {}
        for c in box:
            self.shape[c] = one[c][0] if len(one[c]) and (one[c] == one[c][0]).all() else one[c]

    def _shares(self, at: dict[str, np.ndarray], cells: dict[str, np.ndarray], one: dict[str, np.ndarray], of: slice | np.ndarray) -> dict[str, np.ndarray]:
        """By axis how far into its cell a particle is, from 0 to 1; half-way along y and z in a skewed box, where distances along axes do not add up."""
        if not self.box:
            return {a: at[a] / self.cutoff - cells[f"c{a}"] for a in "xyz"}
        if not len(self.at):
            return {a: np.full(len(at[a]), 0.5) for a in "xyz"}
        if len(self.box) == 3:
            parts = {a: at[a] / one[f"l{a}"][of] for a in "xyz"}
        else:
            m = {c: one[c][of] for c in self.box}
            fz = at["z"] / m["m22"]
            fy = (at["y"] - fz * m["m21"]) / m["m11"]
            parts = {"x": (at["x"] - fz * m["m20"] - fy * m["m10"]) / m["m00"]}
        return {a: (parts[a] - np.floor(parts[a])) * self.n[a][of] - cells[f"c{a}"] if a in parts else np.full(len(at[a]), 0.5) for a in "xyz"}

    def _steps(self, a: str, k: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows that have a cell k steps along an axis that no smaller step has led to, its number, and the square of the least distance to it."""
        n = self.n[a][rows]
        rows = rows[(n >= 3) | (k == 0) | ((n == 2) & (k == 1))]
        n = self.n[a][rows]
        if k == 0 or not self.placed or a not in self.size:
            away = np.zeros(len(rows))
        else:
            share = self.share[a][rows]
            away = np.where(n >= 3, np.maximum((share if k < 0 else 1.0 - share) * self.size[a][rows] - NEAR * self.cutoff, 0.0), 0.0)
        return rows, (self.cell[a][rows] + k) % n, away * away

    def ranges(self, start: int = 0, stop: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of one from start to stop, first and last place + 1 in many): what lies within reach in the cells around it, those of a row along x at once."""
        found, count, most = [], (len(self.rows) if stop is None else stop) - start, self.cutoff * self.cutoff * (1 + NEAR)
        for ky in (-1, 0, 1):
            rows, y, dy = self._steps("y", ky, np.arange(start, start + count))
            line = _found(self.lines, self.at[rows] * self.width["y"] + y)
            rows, line, dy = rows[line >= 0], line[line >= 0], dy[line >= 0]
            of, far = np.full(count, -1), np.zeros(count)
            of[rows - start], far[rows - start] = line, dy
            for kz in (-1, 0, 1):
                there, z, dz = self._steps("z", kz, rows)
                left = most - far[there - start] - dz
                column = np.where(left >= 0, _found(self.columns, of[there - start] * self.width["z"] + z), -1)
                there, column, left = there[column >= 0], column[column >= 0], left[column >= 0]
                if not len(there):
                    continue
                n = self.n["x"][there] << FINE
                reach = 1.0 if not self.placed else np.sqrt(left) / self.size["x"][there]
                x = self.cell["x"][there] + self.share["x"][there]
                low = np.floor((x - reach) * (1 << FINE)).astype(np.int64) - 1
                high = np.floor((x + reach) * (1 << FINE)).astype(np.int64) + 1
                base = column * (self.width["x"] << FINE)
                around = high - low + 1 >= n
                found.append((there, base + np.where(around, 0, np.maximum(low, 0)), base + np.where(around, n, np.minimum(high, n))))
                if self.box:
                    for over, a, b in ((low < 0, low + n, n), (high >= n, n * 0, high - n)):
                        over = over & ~around
                        found.append((there[over], (base + a)[over], (base + b)[over]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        rows, first, last = (np.concatenate(v) for v in zip(*found))
        low, high = np.searchsorted(self.place, first, "left"), np.searchsorted(self.place, last, "right")
        some = high > low
        return rows[some], low[some], high[some]

    def _square(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The square of the distance of the minimum image, in the steps of geometry.vdist."""
        d = {a: self.many[a][j] - self.one[a][i] for a in "xyz"}
        of = lambda c, at: self.shape[c] if np.ndim(self.shape[c]) == 0 else self.shape[c][at]
        if len(self.box) == 3:
            for a in "xyz":
                far = np.flatnonzero(np.abs(d[a]) >= 0.49 * of(f"l{a}", i))  # nearer ones are moved by no box
                if len(far):
                    length = of(f"l{a}", i[far])
                    d[a][far] -= np.floor(d[a][far] / length + 0.5) * length
        elif self.box:
            m = {c: of(c, i) for c in self.box}
            fz = d["z"] / m["m22"]
            fy = (d["y"] - fz * m["m21"]) / m["m11"]
            fx = (d["x"] - fz * m["m20"] - fy * m["m10"]) / m["m00"]
            ix, iy, iz = (np.floor(f + 0.5) for f in (fx, fy, fz))
            d["x"] -= ix * m["m00"] + iy * m["m10"] + iz * m["m20"]
            d["y"] -= iy * m["m11"] + iz * m["m21"]
            d["z"] -= iz * m["m22"]
        square = d["x"] * d["x"]
        square += d["y"] * d["y"]
        square += d["z"] * d["z"]
        return square

    def near(self, start: int = 0, stop: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of a row in the order of one, and of many) of the pairs within the cutoff, a bounded many at a time."""
        return ((i, j) for i, j, _ in self.measured(start, stop))

    def measured(self, start: int = 0, stop: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """near, with the distances."""
        rows, low, high = self.ranges(start, stop)
        ends, most = np.cumsum(high - low), self.cutoff * self.cutoff * (1 + NEAR)
        compared = COMPARED // 2 if len(self.box) > 3 else COMPARED  # a skewed box takes more steps, whose arrays are to stay in the cache
        k = 0
        while k < len(rows):
            stop = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + compared, "right")))
            n = high[k:stop] - low[k:stop]
            i = np.repeat(rows[k:stop], n)
            j = np.arange(len(i)) + np.repeat(low[k:stop] - (np.cumsum(n) - n), n)
            square = self._square(i, j)
            close = np.flatnonzero(square <= most)
            dist = np.sqrt(square[close])
            inside = dist <= self.cutoff
            yield i[close[inside]], j[close[inside]], dist[inside]
            k = stop

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(row of one, row of many, number of the frame) of the pairs within the cutoff, a bounded many at a time."""
        for i, j in self.near():
            yield self.rows[i], self.order[j], self.frame_of_many[j]


def _once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.diff(np.append(first, len(keys)))


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    if not len(a[0]) or not len(b[0]):
        return a if len(a[0]) else b
    keys, n = np.concatenate((a[0], b[0])), np.concatenate((a[1], b[1]))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def summed(keys: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, sorted, and how often each is there; no more of the repeated ones are held than HELD or the distinct ones."""
    done, new, size = (np.zeros(0, np.int64), np.zeros(0, np.int64)), [], 0
    for k in keys:
        new.append(k)
        size += len(k)
        if size > max(HELD, len(done[0])):
            done, new, size = _merged(done, _once(np.concatenate(new))), [], 0
    return _merged(done, _once(np.concatenate(new))) if new else done


def _parts(ref: np.ndarray, n_refs: int, many: int) -> np.ndarray:
    """Numbers of parts of a block for compounds in their order, many of them with about as many particles each."""
    size = np.bincount(ref, minlength=n_refs)
    return (np.cumsum(size) - size) * many // max(1, len(ref))


def _expected(one: dict[str, np.ndarray], many: dict[str, np.ndarray], box: list[str], cutoff: float) -> float:
    """About how many pairs a block has."""
    n = len(one["frame"])
    few = np.arange(0, n, max(1, n // SAMPLE))
    _, low, high = Block({k: v[few] for k, v in one.items()}, many, box, cutoff).ranges()
    return SHARE * (high - low).sum() * n / len(few)


def _arrays(left: pa.Table, right: pa.Table, box: list[str]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    arrays = lambda t, names: {c: t[c].to_numpy() for c in names}
    places = [f"c{a}" for a in "xyz"]
    return arrays(left, ["frame", *places, "rx", "ry", "rz", *(["nx", "ny", "nz", *box] if box else [])]), arrays(right, ["frame", *places, "x", "y", "z"])


def particle_pairs(left: pa.Table, right: pa.Table, box: list[str], cutoff: float) -> Iterator[pa.Table]:
    """(frame, ref, sel, dist) of one block's pairs of particles, a bounded many at a time."""
    if not len(left) or not len(right):
        return
    block = Block(*_arrays(left, right, box), box, cutoff)
    refs, sels = left["ref"].combine_chunks().take(pa.array(block.rows)), right["sel"].combine_chunks().take(pa.array(block.order))
    held, size = [], 0
    for start in range(0, len(block.rows), ASKED):
        for found in block.measured(start, min(start + ASKED, len(block.rows))):
            held.append(found)
            size += len(found[0])
            if size >= ROWS:
                yield _measured(block, refs, sels, held)
                held, size = [], 0
    if size:
        yield _measured(block, refs, sels, held)


def _measured(block: Block, refs: pa.Array, sels: pa.Array, held: list) -> pa.Table:
    i, j, dist = (np.concatenate(v) for v in zip(*held))
    return pa.table({"frame": pa.array(block.frames[block.frame_of_many[j]], pa.int32()), "ref": refs.take(pa.array(i)), "sel": sels.take(pa.array(j)), "dist": pa.array(dist)})


def all_levels(left: pa.Table, right: pa.Table, box: list[str], cutoff: float) -> Iterator[pa.Table]:
    """(kind, frame, ref, sel, n) of one block: contacts summed by particles or compounds on either side, kind being 2 for ref's compounds plus 1 for sel's.

    As in block_pairs compounds are taken part by part, of a large one its particles are; sums by its particles leave the task as they are found.
    """
    if not len(left) or not len(right):
        return
    refs, sels = ([codes(t[f"{side}{c}"]) for c in ("", "_cmp")] for side, t in (("ref", left), ("sel", right)))
    one, many = _arrays(left, right, box)
    alone = [not pc.any(pc.greater(t.group_by(["frame", side]).aggregate([([], "count_all")])["count_all"], 1)).as_py() for side, t in (("ref", left), ("sel", right))]
    expected = _expected(one, many, box, cutoff)
    of = _parts(refs[1][0], len(refs[1][1]), max(1, int(expected / PART)))
    block = Block(one, many, box, cutoff, of[refs[1][0]])
    rows = max(1, int(2 * PART * len(left) / max(1.0, expected))) if alone[0] else len(left)  # a particle's contacts of a frame are to be found at once
    del one, many
    own, other = [c[block.rows] for c, _ in refs], [c[block.order] for c, _ in sels]
    bits = [len(block.frames).bit_length(), *(len(v).bit_length() for _, v in sels)]
    if max(len(v).bit_length() for _, v in refs) + max(bits[1:]) + bits[0] > 63:
        raise OverflowError("too many particles and frames for one block")

    def keys(kind: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        return own[kind >> 1][i] << (bits[0] + bits[1 + (kind & 1)]) | other[kind & 1][j] << bits[0] | block.frame_of_many[j]

    def table(kind: int, found: np.ndarray, n: np.ndarray) -> pa.Table:
        a, b, f = found >> (bits[0] + bits[1 + (kind & 1)]), found >> bits[0] & ((1 << bits[1 + (kind & 1)]) - 1), found & ((1 << bits[0]) - 1)
        return _in_batches({"kind": pa.array(np.full(len(n), kind, np.int32)), "frame": pa.array(block.frames[f], pa.int32()), "ref": refs[kind >> 1][1].take(pa.array(a)), "sel": sels[kind & 1][1].take(pa.array(b)), "n": pa.array(n, pa.int64())})

    for start, stop in zip(block.groups[:-1], block.groups[1:]):
        sums = {kind: _once(np.zeros(0, np.int64)) for kind in (2, 3)}
        for low in range(start, stop, rows):
            found = list(block.near(low, min(low + rows, stop)))
            if not found:
                continue
            i, j = (np.concatenate(v) for v in zip(*found))
            del found
            at = keys(0, i, j)
            yield table(0, *((at, np.ones(len(at), np.int64)) if all(alone) else _once(at)))
            yield table(1, *_once(keys(1, i, j)))
            for kind in sums:
                sums[kind] = _merged(sums[kind], _once(keys(kind, i, j)))
        for kind, (found, n) in sums.items():
            yield table(kind, found, n)


def block_pairs(left: pa.Table, right: pa.Table, box: list[str], cutoff: float, make: str, options: dict | None = None) -> pa.Table | None:
    """What contacts.compound_pairs makes of one block's particles, without the block's number; None without any pair.

    The compounds of left are taken part by part, so that the keys of about PART pairs are held, however many the block has.
    """
    if not len(left) or not len(right):
        return None
    (ref, refs), (sel, sels) = codes(left["ref_cmp"]), codes(right["sel_cmp"])
    one, many = _arrays(left, right, box)
    of = _parts(ref, len(refs), max(1, int(_expected(one, many, box, cutoff) / PART)))
    block = Block(one, many, box, cutoff, of[ref])
    del one, many
    n_sels, n_frames = len(sels), len(block.frames)
    if len(refs) * n_sels * (n_frames + 1) >= 1 << 63:
        raise OverflowError("too many compounds and frames for one block")
    own, other = ref[block.rows] * (n_sels * n_frames), sel[block.order] * n_frames + block.frame_of_many
    tables = []
    for start, stop in zip(block.groups[:-1], block.groups[1:]):
        keys, n = summed(own[i] + other[j] for i, j in block.near(start, stop))
        if len(keys):
            tables.append(MADE[make](Pairs(keys, n, refs, sels, block.frames), **(options or {})))
    return pa.concat_tables(tables) if tables else None


class Pairs:
    """Contacts of compounds of a part: keys, which are sorted by compounds and frame, and n of each."""

    def __init__(self, keys: np.ndarray, n: np.ndarray, refs: pa.Array, sels: pa.Array, frames: np.ndarray):
        self.keys, self.n, self.refs, self.sels, self.frames = keys, n, refs, sels, frames
        self.n_sels, self.n_frames = len(sels), len(frames)
        self.pair, self.code = np.divmod(keys, self.n_frames)

    @property
    def frame(self) -> np.ndarray:
        return self.frames[self.code]

    def names(self, pair: np.ndarray) -> dict[str, pa.Array]:
        ref, sel = np.divmod(pair, self.n_sels)
        return {"ref": self.refs.take(pa.array(ref)), "sel": self.sels.take(pa.array(sel))}

    def runs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, number of the first frame, first frame, frames) of the runs."""
        pair, frame = self.pair, self.frame
        first = _firsts((pair[1:] != pair[:-1]) | (frame[1:] != frame[:-1] + 1))
        return pair[first], self.code[first], frame[first], np.diff(np.append(first, len(frame)))


def _firsts(other: np.ndarray) -> np.ndarray:
    """Places of the first of equal neighbours, from whether a value differs from the one before."""
    return np.flatnonzero(np.concatenate(([True], other)))


def _counts(of: Pairs) -> pa.Table:
    return _in_batches({"frame": pa.array(of.frame, pa.int32()), **of.names(of.pair), "n": pa.array(of.n, pa.int64())})


def _runs(of: Pairs) -> pa.Table:
    pair, _, start, size = of.runs()
    first = _firsts(pair[1:] != pair[:-1])
    runs = np.diff(np.append(first, len(pair)))
    return _spans(of, pair, start, size, runs=pa.array(np.repeat(runs, runs), pa.int32()))


def _longest(of: Pairs) -> pa.Table:
    pair, code, _, size = of.runs()
    return _spans(of, *longest(pair, code, size, of.n_sels, of.n_frames, of.frames))


def _spans(of: Pairs, pair: np.ndarray, start: np.ndarray, size: np.ndarray, **more: pa.Array) -> pa.Table:
    return _in_batches({**of.names(pair), "start": pa.array(start, pa.int32()), "stop": pa.array(start + size, pa.int32()), **more})


def _levels(of: Pairs) -> pa.Table:
    """With how many partners a reference compound has n contacts in a frame."""
    most = int(of.n.max()) + 1
    keys, k = _once((of.pair // of.n_sels * of.n_frames + of.code) * most + of.n)
    at, n = np.divmod(keys, most)
    return _in_batches({"frame": pa.array(of.frames[at % of.n_frames], pa.int32()), "ref": of.refs.take(pa.array(at // of.n_frames)), "n": pa.array(n, pa.int64()), "k": pa.array(k, pa.int64())})


def _common(of: Pairs, n_frames: int) -> pa.Table:
    """Pairs that are in contact in so many frames."""
    first = _firsts(of.pair[1:] != of.pair[:-1])
    return _in_batches(of.names(of.pair[first][np.diff(np.append(first, len(of.pair))) == n_frames]))


def _lags(of: Pairs, max_lag: int | None) -> pa.Table:
    """Pairs in contact by frame (at is null), and the ramps of lags.run_overlaps of the runs of one pair: the sum of their signs by place."""
    frames, n = np.unique(of.code, return_counts=True)
    pair, _, start, size = of.runs()
    least, width = -int(size.max()), int(of.frames[-1] - of.frames[0]) + 1

    def ramps() -> Iterator[np.ndarray]:
        d, first = 0, np.arange(len(pair))  # runs of a pair are neighbours, the d-th is looked at
        while len(first):
            for low in range(0, len(first), COMPARED):
                a, b = first[low : low + COMPARED], first[low : low + COMPARED] + d
                gap = start[b] - start[a]
                for at, less in ((gap - size[a], 0), (gap, 1), (gap + size[b] - size[a], 1), (gap + size[b], 0)):
                    yield (at.astype(np.int64) - least) * 2 + less
            d += 1
            first = first[first + d < len(pair)]
            same = pair[first + d] == pair[first]
            first = first[same if max_lag is None else same & (start[first + d] - start[first] - size[first] < max_lag)]

    keys, k = summed(ramps())
    place, less = np.divmod(keys, 2)
    first = _firsts(place[1:] != place[:-1])
    sums = np.add.reduceat(np.where(less == 1, -k, k), first)
    at = place[first] + least
    some = (sums != 0) & (at < width if max_lag is None else at <= max_lag)
    members = {"frame": pa.array(of.frames[frames], pa.int32()), "at": pa.nulls(len(frames), pa.int64()), "n": pa.array(n, pa.int64())}
    return pa.concat_tables([pa.table(members), pa.table({"frame": pa.nulls(some.sum(), pa.int32()), "at": pa.array(at[some], pa.int64()), "n": pa.array(sums[some], pa.int64())})])


def _meetings(of: Pairs, apart: tuple[int, int]) -> pa.Table:
    """Partners of a reference compound at a frame (f0 = f1) with sums of their numbers, and those it has at both of two frames so many apart."""
    at, own = np.unique(of.pair // of.n_sels * of.n_frames + of.code, return_inverse=True)
    numbers = of.sels.cast(pa.float64()) if pa.types.is_integer(of.sels.type) or pa.types.is_floating(of.sels.type) else pa.nulls(of.n_sels, pa.float64())
    value = numbers.to_numpy(zero_copy_only=False)[of.pair % of.n_sels]
    known = ~np.isnan(value)
    size, total = np.bincount(own, known), np.bincount(own, np.where(known, value, 0.0))
    mean = np.divide(total, size, out=np.zeros(len(at)), where=size > 0)
    off = np.where(known, value - mean[own], 0.0)
    least, greatest = np.full(len(at), np.nan), np.full(len(at), np.nan)
    np.fmin.at(least, own, value), np.fmax.at(greatest, own, value)
    real = lambda x: pa.array(x, pa.float64(), from_pandas=True)
    ref, frame = of.refs.take(pa.array(at // of.n_frames)), pa.array(of.frames[at % of.n_frames], pa.int32())
    stats = {"size": pa.array(size.astype(np.int64)), "total": real(total), "square": real(np.bincount(own, off * off)), "least": real(least), "greatest": real(greatest)}
    alone = _in_batches({"ref": ref, "f0": frame, "f1": frame, "n": pa.array(np.bincount(own), pa.int64()), **stats})
    again = np.flatnonzero(np.concatenate(([False], of.pair[1:] == of.pair[:-1])) | np.concatenate((of.pair[1:] == of.pair[:-1], [False])))
    pair, code, found, d = of.pair[again], of.code[again], [], 1
    while True:  # frames of a pair are neighbours, the d-th is looked at
        same = np.flatnonzero(pair[d:] == pair[:-d])
        if not len(same):
            break
        between = of.frames[code[same + d]] - of.frames[code[same]]
        same = same[(between >= apart[0]) & (between <= apart[1])]
        found.append((pair[same] // of.n_sels * of.n_frames + code[same]) * of.n_frames + code[same + d])
        d += 1
    keys, n = _once(np.concatenate(found)) if found else _once(np.zeros(0, np.int64))
    at, last = np.divmod(keys, of.n_frames)
    both = {"ref": of.refs.take(pa.array(at // of.n_frames)), "f0": pa.array(of.frames[at % of.n_frames], pa.int32()), "f1": pa.array(of.frames[last], pa.int32()), "n": pa.array(n, pa.int64())}
    return pa.concat_tables([alone, _in_batches({**both, **{c: pa.nulls(len(n), v.type) for c, v in stats.items()}})])


def _filled(of: Pairs, intermittency: int, n_frames: int) -> pa.Table:
    """Frames in contact after repair.correct_contact_intermittency, whose rule this is, on the runs of a pair and the gaps between them as arrays."""
    pair, _, start, size = of.runs()
    stop, first = start + size, np.concatenate(([True], pair[1:] != pair[:-1]))
    last = np.append(first[1:], True)
    before = np.where(first, 0, np.concatenate(([0], stop[:-1])))
    run_long = (size > intermittency) | (start == 0) | (stop == n_frames)
    gap_long = (start > before) & (first | (start - before > intermittency))
    rest = last & (stop < n_frames)
    # three turns a run, in order: the gap before it, itself, and what is left after the last one
    bound = np.tile([False, True, False], len(pair))
    at, long = np.stack((before, start, stop), 1).ravel(), np.stack((gap_long, run_long, rest), 1).ravel()
    kept = np.flatnonzero(long)
    bound, at, pair = bound[kept], at[kept], pair[kept // 3]
    change = _firsts((pair[1:] != pair[:-1]) | (bound[1:] != bound[:-1]))
    bound, at, pair = bound[change], at[change], pair[change]
    until = np.where(np.append(pair[1:] == pair[:-1], False), np.append(at[1:], n_frames), n_frames)
    at, until, pair = at[bound], until[bound], pair[bound]
    n = until - at
    frame = np.arange(n.sum()) + np.repeat(at - (np.cumsum(n) - n), n)
    return _in_batches({"frame": pa.array(frame, pa.int32()), **of.names(np.repeat(pair, n))})


def _checks(of: Pairs, n_frames: int | None, n_refs: int | None, n_sels: int | None) -> pa.Table:
    """One row: what contacts.check_contacts counts, of this part."""
    ref, sel = np.divmod(of.pair, of.n_sels)
    out, null = np.zeros(len(of.keys), bool), np.zeros(len(of.keys), bool)
    for values, at, most in ((pa.array(of.frames), of.code, n_frames), (of.refs, ref, n_refs), (of.sels, sel, n_sels)):
        beyond = pc.less(values, 0) if most is None else pc.or_(pc.less(values, 0), pc.greater_equal(values, most))
        out |= pc.fill_null(beyond, False).to_numpy(zero_copy_only=False)[at]
        null |= values.is_null().to_numpy(zero_copy_only=False)[at]
    counted = {"n": len(of.keys), "repeated": int((of.keys[1:] == of.keys[:-1]).sum()), "nulls": null.sum(), "outside": out.sum()}
    return pa.table({c: pa.array([int(v)], pa.int64()) for c, v in counted.items()})


#: What a part's pairs are made to.
MADE = {"counts": _counts, "runs": _runs, "longest": _longest, "levels": _levels, "common": _common, "lags": _lags, "meetings": _meetings, "filled": _filled, "checks": _checks}


def longest(pair: np.ndarray, code: np.ndarray, size: np.ndarray, n_sels: int, n_frames: int, frames: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, start, size) of the runs of a reference compound that begin at one frame (frames[code]) the longest, of the lowest number; by keys that sort so, where they fit."""
    ref, sel = np.divmod(pair, n_sels)
    by = ref * n_frames + code
    if (int(by.max()) + 1) * (n_frames + 1) * n_sels < 1 << 63:
        keys = np.sort((by * (n_frames + 1) + (n_frames - size)) * n_sels + sel)
        by, sel = keys // n_sels, keys % n_sels
        by, size = by // (n_frames + 1), n_frames - by % (n_frames + 1)
    else:
        order = np.lexsort((sel, -size, by))
        by, sel, size = by[order], sel[order], size[order]
    first = np.concatenate(([True], by[1:] != by[:-1]))
    by, sel, size = by[first], sel[first], size[first]
    return by // n_frames * n_sels + sel, frames[by % n_frames], size


def _in_batches(columns: dict[str, pa.Array]) -> pa.Table:
    table = pa.table(columns)
    return pa.Table.from_batches(table.to_batches(max_chunksize=ROWS), table.schema)
