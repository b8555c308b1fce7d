"""Boxes and periodic boundaries as column expressions.

A box is given by the columns of its lengths and angles (degrees), or by the lower
triangle of its matrix; a vector by three columns.  Orthorhombic boxes have a shorter form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def box_volume(lengths: Vector, angles: Vector) -> Column:
    """Volume of a box, null unless it is positive."""
    a, b, c = (F.cos(F.radians(x)) for x in angles)
    squared = 1 - a * a - b * b - c * c + 2 * a * b * c
    volume = lengths[0] * lengths[1] * lengths[2] * F.sqrt(F.greatest(squared, F.lit(0.0)))
    return F.when(volume > 0, volume)


def volume(lengths: Vector) -> Column:
    return lengths[0] * lengths[1] * lengths[2]


def diagonal(lengths: Vector) -> Column:
    return F.sqrt(lengths[0] * lengths[0] + lengths[1] * lengths[1] + lengths[2] * lengths[2])


def triclinic_box(matrix: list[Vector]) -> list[Column]:
    """Lengths and angles of a 3x3 matrix given by rows; all zero if a length is 0 or an angle 180."""
    dot = lambda u, v: u[0] * v[0] + u[1] * v[1] + u[2] * v[2]
    lengths = [F.sqrt(dot(v, v)) for v in matrix]
    angle = lambda i, j: F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.try_divide(dot(matrix[i], matrix[j]), lengths[i] * lengths[j])))))
    angles = [angle(1, 2), angle(0, 2), angle(0, 1)]
    valid = (lengths[0] > 0) & (lengths[1] > 0) & (lengths[2] > 0) & (angles[0] < 180) & (angles[1] < 180) & (angles[2] < 180)
    return [F.when(valid, x).otherwise(0.0) for x in [*lengths, *angles]]


def triclinic_vectors(lengths: Vector, angles: Vector) -> list[Vector]:
    """The rows of the lower triangular matrix of a box; all zero if it is none."""
    ca, cb, cg = (F.when(x == 90, F.lit(0.0)).otherwise(F.cos(F.radians(x))) for x in angles)
    sg = F.when(angles[2] == 90, F.lit(1.0)).otherwise(F.sin(F.radians(angles[2])))
    lx, ly, lz = (x.cast("double") for x in lengths)
    y = F.try_divide(ca - cb * cg, sg)
    zz = 1 - cb * cb - y * y
    valid = (lx > 0) & (ly > 0) & (lz > 0) & (zz > 0)
    rows = [(lx, 0.0, 0.0), (ly * cg, ly * sg, 0.0), (lz * cb, lz * y, lz * F.sqrt(F.greatest(zz, F.lit(0.0))))]
    return [tuple(F.when(valid, x).otherwise(0.0) for x in row) for row in rows]


def box2cart(pos: Vector, matrix: list[Vector]) -> list[Column]:
    """Cartesian coordinates of box coordinates: pos times the matrix."""
    return [sum((pos[i] * matrix[i][k] for i in (1, 2)), pos[0] * matrix[0][k]) for k in range(3)]


def cart2box(pos: Vector, matrix: list[Vector]) -> list[Column]:
    """Box coordinates of Cartesian ones, the matrix being lower triangular: substitution from the last row up."""
    z = pos[2] / matrix[2][2]
    y = (pos[1] - z * matrix[2][1]) / matrix[1][1]
    x = (pos[0] - z * matrix[2][0] - y * matrix[1][0]) / matrix[0][0]
    return [x, y, z]


ANGLES = ("alpha", "beta", "gamma")


def box_columns(names: list[str]) -> list[str]:
    """Those of a box table's columns that describe its boxes: lx, ly, lz, and the angles if there are any."""
    return ["lx", "ly", "lz", *(ANGLES if all(a in names for a in ANGLES) else ())]


def box_matrix(box: list[str], prefix: str = "") -> list[Vector]:
    """The matrix of a box given by the columns of box_columns."""
    lengths = tuple(F.col(f"{prefix}{c}").cast("double") for c in box[:3])
    if len(box) == 3:
        zero = F.lit(0.0)
        return [(lengths[0], zero, zero), (zero, lengths[1], zero), (zero, zero, lengths[2])]
    return triclinic_vectors(lengths, tuple(F.col(f"{prefix}{c}").cast("double") for c in box[3:]))


def min_image(d: Vector, box: list[str] | None, prefix: str = "") -> list[Column]:
    """A difference brought to its minimum image by a box's columns; as it is without a box."""
    if box is None:
        return list(d)
    if len(box) == 3:
        return [mic_ortho(x, F.col(f"{prefix}{c}")) for x, c in zip(d, box)]
    zero = F.lit(0.0)
    return vdist(d, (zero, zero, zero), box_matrix(box, prefix))


def wrap_into(pos: Vector, box: list[str]) -> list[Column]:
    """A position shifted into a box given by its columns."""
    if len(box) == 3:
        return [wrap_ortho(x, F.col(c)) for x, c in zip(pos, box)]
    return wrap_pos(pos, box_matrix(box))


def wrap_ortho(x: Column, length: Column) -> Column:
    return x - length * F.floor(x / length)


def wrap_pos(pos: Vector, matrix: list[Vector]) -> list[Column]:
    """Positions shifted into the box."""
    inside = [F.floor(c) for c in cart2box(pos, matrix)]
    return [p - s for p, s in zip(pos, box2cart(inside, matrix))]


def mic_ortho(d: Column, length: Column) -> Column:
    """A difference brought into [-length / 2, length / 2)."""
    return d - length * F.floor(d / length + 0.5)


def vdist(a: Vector, b: Vector, matrix: list[Vector] | None = None) -> list[Column]:
    """a - b, by the minimum image if a box matrix is given."""
    d = [x - y for x, y in zip(a, b)]
    if matrix is None:
        return d
    images = [F.floor(c + 0.5) for c in cart2box(d, matrix)]
    return [x - s for x, s in zip(d, box2cart(images, matrix))]


def norm(v: Vector) -> Column:
    return F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
