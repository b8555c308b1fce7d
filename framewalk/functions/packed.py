"""The packed integer coordinates of .xtc frames, to and from numpy arrays.

A frame's coordinates are multiples of 1 / precision.  A group of atoms is stored as one atom's
place in the frame's range, then up to eight steps from atom to atom in a smaller
range.  The bits of a group tell where the next one begins, so groups are followed one by one; their
numbers are then taken out of the bits all at once, one width at a time.
"""

from __future__ import annotations

import struct

import numpy as np

# Fixed values of the format: the ranges of steps by index, the first index in use, the magic number, atoms up to which nothing is packed.
RANGES = [
    0, 0, 0, 0, 0, 0, 0, 0, 0, 8, 10, 12, 16, 20, 25, 32, 40, 50, 64, 80, 101, 128, 161, 203, 256, 322, 406, 512, 645, 812, 1024, 1290, 1625, 2048, 2580, 3250, 4096, 5060, 6501, 8192, 10321,
    13003, 16384, 20642, 26007, 32768, 41285, 52015, 65536, 82570, 104031, 131072, 165140, 208063, 262144, 330280, 416127, 524287, 660561, 832255, 1048576, 1321122, 1664510, 2097152, 2642245,
    3329021, 4194304, 5284491, 6658042, 8388607, 10568983, 13316085, 16777216,
]
FIRST, MAGIC, PLAIN, MOST_STEPS, WIDE = 9, 1995, 9, 8, 0xFFFFFF

#: Bytes of a frame before its coordinates: magic number, atoms, step, time, box, atoms again.
HEAD = 56


def head_of(data: bytes) -> tuple[int, int, float, np.ndarray]:
    """(atoms, step, time, box vectors as rows) of a frame's first HEAD bytes."""
    magic, atoms, step, time, *rest = struct.unpack(">iiif9fi", data[:HEAD])
    if magic != MAGIC or atoms != rest[9] or atoms < 0:
        raise ValueError("not the begin of an .xtc frame")
    return atoms, step, time, np.array(rest[:9]).reshape(3, 3)


def length_of(data: bytes) -> int:
    """Bytes of the frame that begins with data, of which HEAD + 36 are enough."""
    atoms = head_of(data)[0]
    if atoms <= PLAIN:
        return HEAD + 12 * atoms
    (size,) = struct.unpack(">i", data[HEAD + 32 : HEAD + 36])
    return HEAD + 36 + (size + 3) // 4 * 4


def _numbers(bits: np.ndarray, at: np.ndarray, width: int, sizes: list[int]) -> np.ndarray:
    """Three numbers from the `width` bits at each place: the digits of one number, which is stored with its lowest byte first."""
    held = bits[at[:, None] + np.arange(width)]
    full, rest = divmod(width, 8)
    digits = [np.packbits(held[:, 8 * k : 8 * k + 8], axis=1)[:, 0].astype(np.int64) for k in range(full)]
    if rest:
        digits.append(np.packbits(held[:, 8 * full :], axis=1)[:, 0].astype(np.int64) >> (8 - rest))
    out = np.zeros((len(at), 3), np.int64)
    for axis in (2, 1):
        left = np.zeros(len(at), np.int64)
        for k in reversed(range(len(digits))):
            left = left << 8 | digits[k]
            digits[k] = left // sizes[axis]
            left -= digits[k] * sizes[axis]
        out[:, axis] = left
    for k in reversed(range(len(digits))):
        out[:, 0] = out[:, 0] << 8 | digits[k]
    return out


def _plain(bits: np.ndarray, at: np.ndarray, widths: list[int]) -> np.ndarray:
    """Three numbers, each by itself, highest bit first."""
    out = np.zeros((len(at), 3), np.int64)
    for axis, width in enumerate(widths):
        for k in range(width):
            out[:, axis] = out[:, axis] << 1 | bits[at + k]
        at = at + width
    return out


def unpack(data: bytes, atoms: int) -> np.ndarray:
    """The coordinates (atoms, 3) in what follows a frame's head, as 32-bit floats."""
    if atoms <= PLAIN:
        return np.frombuffer(data, ">f4", 3 * atoms).reshape(-1, 3).astype(np.float32)
    precision, *rest = struct.unpack(">f3i3iii", data[:36])
    low, high, index, size = np.array(rest[:3]), np.array(rest[3:6]), rest[6], rest[7]
    sizes = [int(x) for x in high - low + 1]
    if max(sizes) > WIDE:
        widths = [x.bit_length() for x in sizes]
        width = sum(widths)
    else:
        widths, width = None, (sizes[0] * sizes[1] * sizes[2]).bit_length()
    bits = np.unpackbits(np.frombuffer(data, np.uint8, size, 36))
    bits = np.concatenate([bits, np.zeros(128, np.uint8)])
    five = np.zeros(len(bits) - 4, np.uint8)
    for k in range(5):
        five = five << 1 | bits[k : len(bits) - 4 + k]
    flags, fives = bits.tolist(), five.tolist()

    starts, counts, step_at, step_index = [], [], [], []
    at = made = steps = 0
    while made < atoms:
        starts.append(at)
        at += width
        change = 0
        if flags[at]:
            steps, change = divmod(fives[at + 1], 3)
            change -= 1
            at += 5
        at += 1
        for _ in range(steps):
            step_at.append(at)
            step_index.append(index)
            at += index
        counts.append(steps)
        made += 1 + steps
        index += change
    if made != atoms or at > 8 * size:
        raise ValueError("damaged .xtc frame")

    begin = np.array(starts)
    whole = (_plain(bits, begin, widths) if widths else _numbers(bits, begin, width, sizes)) + low
    count = np.array(counts)
    first = np.cumsum(1 + count) - 1 - count  # each group's first atom
    out = np.empty((atoms, 3), np.int64)
    out[first + (count > 0)] = whole  # the second of a group, if it has steps
    if step_at:
        places, indexes = np.array(step_at), np.array(step_index)
        moved = np.empty((len(places), 3), np.int64)
        for i in np.unique(indexes):
            same = np.flatnonzero(indexes == i)
            moved[same] = _numbers(bits, places[same], int(i), [RANGES[i]] * 3) - RANGES[i] // 2
        group = np.repeat(np.arange(len(count)), count)
        before = np.cumsum(count) - count  # steps before each group
        nth = np.arange(len(places)) - before[group]
        sums = np.vstack([np.zeros((1, 3), np.int64), np.cumsum(moved, axis=0)])
        out[first[group] + np.where(nth == 0, 0, nth + 1)] = whole[group] + sums[1:] - sums[before[group]]
    return (out / precision).astype(np.float32)


def pack(points: np.ndarray, precision: float = 1000.0, changes=None) -> bytes:
    """What follows a frame's head: the coordinates, packed unless they are few.

    Steps have one range in a frame, the least that holds three quarters of them; changes(k), for the k-th group, may ask for the
    next (1) or the one before (-1).
    """
    atoms = len(points)
    if atoms <= PLAIN:
        return points.astype(">f4").tobytes()
    scaled = np.asarray(points, np.float64) * precision
    whole = np.where(scaled >= 0, np.floor(scaled + 0.5), np.ceil(scaled - 0.5))
    if np.abs(whole).max() >= 2**31 - 2:
        raise ValueError("coordinates too large for the precision")
    whole = whole.astype(np.int64)
    low, high = whole.min(axis=0), whole.max(axis=0)
    sizes = [int(x) for x in high - low + 1]
    wide = max(sizes) > WIDE
    width = sum(x.bit_length() for x in sizes) if wide else (sizes[0] * sizes[1] * sizes[2]).bit_length()
    usual = 2 * int(np.quantile(np.abs(np.diff(whole, axis=0)).max(axis=1), 0.75)) + 2
    index = next((i for i in range(FIRST, len(RANGES)) if RANGES[i] >= usual), len(RANGES) - 1)
    start, parts = index, []

    def number(values: list[int], of: list[int], bits: int) -> str:
        n = (values[0] * of[1] + values[1]) * of[2] + values[2]
        full, rest = divmod(bits, 8)
        out = [format(n >> 8 * k & 255, "08b") for k in range(full)]
        return "".join(out) + (format(n >> 8 * full, f"0{rest}b") if rest else "")

    rows, k, steps, groups = whole.tolist(), 0, 0, 0
    while k < atoms:
        half = RANGES[index] // 2
        # the group's first two atoms change places: the second is stored whole
        order = [k + 1, k, *range(k + 2, min(atoms, k + MOST_STEPS + 1))] if k + 1 < atoms else [k]
        moves: list[list[int]] = []
        for a, b in zip(order, order[1:]):
            move = [y - x + half for x, y in zip(rows[a], rows[b])]
            if min(move) < 0 or max(move) >= RANGES[index]:
                break
            moves.append(move)
        first = rows[order[0] if moves else k]
        place = [x - m for x, m in zip(first, low.tolist())]
        parts.append("".join(format(x, f"0{s.bit_length()}b") for x, s in zip(place, sizes)) if wide else number(place, sizes, width))
        change = changes(groups) if changes else 0
        if not FIRST <= index + change < len(RANGES):
            change = 0
        if len(moves) == steps and not change:
            parts.append("0")
        else:
            steps = len(moves)
            parts.append("1" + format(3 * steps + 1 + change, "05b"))
        parts += [number(m, [RANGES[index]] * 3, index) for m in moves]
        k += 1 + len(moves)
        index += change
        groups += 1
    text = "".join(parts)
    size = -(-len(text) // 8)
    data = int(text.ljust(8 * size, "0"), 2).to_bytes(size, "big")
    return struct.pack(">f3i3iii", precision, *low.tolist(), *high.tolist(), start, size) + data.ljust(-(-size // 4) * 4, b"\0")


def frame_of(points: np.ndarray, step: int, time: float, box: np.ndarray, precision: float = 1000.0) -> bytes:
    """A whole frame; box has the vectors as rows."""
    return struct.pack(">iiif9fi", MAGIC, len(points), step, time, *np.asarray(box, float).ravel(), len(points)) + pack(points, precision)
