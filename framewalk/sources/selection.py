"""Selections of atoms: a small language, read to an expression tree, and planned as filters and joins.

What is a predicate of a row becomes one column expression; what depends on other rows becomes a semi or anti join on
the frame and the columns that matter.  In a conjunction the predicates filter first, and each join then
narrows what the one before it has left.

    or, and, not, ( )                          in this order of binding, the weakest first
    all, none, protein, backbone, nucleic      sets of residue and atom names
    name type resname segid A B* [CN]?         lists of names, * ? [...] as in file names
    resid index bynum 1 5:9 12-                lists of numbers and ranges, ends included; bynum counts from 1
    mass charge radius 1.0:2.5                 ranges of numbers
    prop [abs] COLUMN < <= > >= == != NUMBER
    point X Y Z CUTOFF                         no farther than the cutoff from a place
    around CUTOFF OF                           no farther than the cutoff from one of OF, but not of OF
    sphzone R OF, sphlayer RI RO OF            that far from the centre of OF
    isolayer RI RO OF                          no farther than RO from one of OF, and farther than RI from each
    cyzone R ZMAX ZMIN OF                      in a cylinder along z around the centre of OF
    byres OF, same COLUMN as OF                of a residue (of the column's value) that OF has
    bonded OF                                  with a bond to one of OF

OF is a selection of its own, over all atoms of the frame: what follows up to the closing parenthesis.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewalk.functions import geometry

# Residue and atom names.
PROTEIN = "ALA ARG ASN ASP CYS GLN GLU GLY HIS ILE LEU LYS MET PHE PRO SER THR TRP TYR VAL ASH CYM CYX GLH HID HIE HIP HSD HSE HSP LYN MSE SEC PYL ACE NME NMA".split()
NUCLEIC = "ADE URA CYT GUA THY DA DC DG DT RA RU RG RC A T U C G DA5 DC5 DG5 DT5 DA3 DC3 DG3 DT3 RA5 RU5 RG5 RC5 RA3 RU3 RG3 RC3".split()
BACKBONE = "N CA C O".split()

NAMES = {"name": "name", "type": "type", "resname": "resname", "segid": "segid"}
WHOLE = {"resid": ("resid", 0), "index": ("atom_ix", 0), "bynum": ("atom_ix", 1)}
REAL = {"mass": "mass", "charge": "charge", "radius": "radius"}
SETS = {"all", "none", "protein", "backbone", "nucleic"}
COMPARE = {"<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b}
#: Words that take a selection: how many numbers come before it.
OVER = {"around": 1, "sphzone": 1, "sphlayer": 2, "isolayer": 2, "cyzone": 3, "byres": 0, "bonded": 0}
RESERVED = {"and", "or", "not", "(", ")"}


@dataclass(frozen=True)
class Node:
    """kind is and, or, not, row (a predicate), or a word of OVER or "same"; numbers and column are what the word is given."""

    kind: str
    parts: tuple["Node", ...] = ()
    predicate: Column | None = None
    numbers: tuple[float, ...] = ()
    column: str | None = None

    @property
    def by_row(self) -> bool:
        return self.kind == "row" or self.kind in ("and", "or", "not") and all(p.by_row for p in self.parts)


class Reader:
    """Reads one selection."""

    def __init__(self, text: str):
        self.text = text
        self.words = re.findall(r"\(|\)|[<>=!]=?|(?:\[[^\]\s]*\]|[^\s()<>=!])+", text)
        self.at = 0

    def fail(self, why: str) -> ValueError:
        return ValueError(f"{why} in {self.text!r}")

    def peek(self) -> str | None:
        return self.words[self.at] if self.at < len(self.words) else None

    def next(self, what: str = "a word") -> str:
        if self.at >= len(self.words):
            raise self.fail(f"{what} is missing")
        self.at += 1
        return self.words[self.at - 1]

    def number(self) -> float:
        word = self.next("a number")
        try:
            return float(word)
        except ValueError:
            raise self.fail(f"{word!r} is no number") from None

    def whole(self) -> Node:
        made = self.either()
        if self.peek() is not None:
            raise self.fail(f"{self.peek()!r} is not expected")
        return made

    def either(self) -> Node:
        parts = [self.both()]
        while self.peek() == "or":
            self.next()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else Node("or", tuple(parts))

    def both(self) -> Node:
        parts = [self.single()]
        while self.peek() == "and":
            self.next()
            parts.append(self.single())
        return parts[0] if len(parts) == 1 else Node("and", tuple(parts))

    def single(self) -> Node:
        word = self.next("a selection")
        if word == "not":
            return Node("not", (self.single(),))
        if word == "(":
            made = self.either()
            if self.peek() != ")":
                raise self.fail("a closing parenthesis is missing")
            self.next()
            return made
        if word in OVER:
            numbers = tuple(self.number() for _ in range(OVER[word]))
            return Node(word, (self.either(),), numbers=numbers)
        if word == "same":
            column = self.next("a column")
            if self.next("as") != "as" or not column.isidentifier():
                raise self.fail("same needs a column and as")
            return Node("same", (self.either(),), column="resid" if column == "residue" else column)
        return Node("row", predicate=self.predicate(word))

    def values(self, word: str) -> list[str]:
        out = []
        while self.peek() is not None and self.peek() not in RESERVED:
            out.append(self.next())
        if not out:
            raise self.fail(f"{word} has no values")
        return out

    def predicate(self, word: str) -> Column:
        isin = lambda c, of: F.coalesce(F.col(c).isin(of), F.lit(False))
        if word in SETS:
            return {
                "all": lambda: F.lit(True), "none": lambda: F.lit(False), "protein": lambda: isin("resname", PROTEIN), "nucleic": lambda: isin("resname", NUCLEIC),
                "backbone": lambda: isin("resname", PROTEIN) & isin("name", BACKBONE),
            }[word]()
        if word in NAMES:
            return _or([_like(F.col(NAMES[word]), v) for v in self.values(word)])
        if word in WHOLE:
            column, first = WHOLE[word]
            return _or([self._range(F.col(column), v, first, r"(-?\d+)(?:(?:[:-])(-?\d+)?)?", int) for v in self.values(word)])
        if word in REAL:
            return _or([self._range(F.col(REAL[word]), v, 0, r"(-?[\d.]+(?:[eE]-?\d+)?)(?::(-?[\d.]+(?:[eE]-?\d+)?)?)?", float) for v in self.values(word)])
        if word == "prop":
            column = self.next("a column")
            absolute = column == "abs"
            column = self.next("a column") if absolute else column
            test = self.next("a comparison")
            if not column.isidentifier() or test not in COMPARE:
                raise self.fail("prop needs a column, a comparison and a number")
            return F.coalesce(COMPARE[test](F.abs(column) if absolute else F.col(column), F.lit(self.number())), F.lit(False))
        if word == "point":
            place = [self.number() for _ in range(3)]
            return _near([F.col(a) - p for a, p in zip("xyz", place)], self.number())
        raise self.fail(f"{word!r} is no word of the language")

    def _range(self, column: Column, value: str, first: int, pattern: str, kind) -> Column:
        m = re.fullmatch(pattern, value)
        if not m:
            raise self.fail(f"{value!r} is no number or range")
        low = kind(m[1]) - first
        if m[2] is None and len(value) > len(m[1]):  # open to the end
            test = column >= low
        else:
            test = column.between(low, kind(m[2] or m[1]) - first)
        return F.coalesce(test, F.lit(False))


def _or(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _like(column: Column, pattern: str) -> Column:
    if not re.search(r"[*?\[]", pattern):
        return F.coalesce(column == pattern, F.lit(False))
    out, k = "", 0
    while k < len(pattern):
        if pattern[k] == "[" and (end := pattern.find("]", k + 2)) > 0:
            inside = pattern[k + 1 : end]
            out += "[" + ("^" if inside[0] == "!" else "") + re.sub(r"([\\\[\]^&])", r"\\\1", inside.lstrip("!")) + "]"
            k = end
        else:
            out += {"*": ".*", "?": "."}.get(pattern[k]) or re.escape(pattern[k])
        k += 1
    return F.coalesce(column.rlike(f"^(?s:{out})$"), F.lit(False))


def _near(d: list[Column], cutoff: float) -> Column:
    return F.coalesce(sum((x * x for x in d), F.lit(0.0)) <= cutoff * cutoff, F.lit(False))


class Planner:
    """Plans a tree over one table of atoms."""

    def __init__(self, atoms: DataFrame, boxes: DataFrame | None, bonds: DataFrame | None):
        self.atoms, self.boxes, self.bonds = atoms, boxes, bonds
        self.frame = [c for c in ("frame",) if c in atoms.columns]
        self.keys = [*self.frame, "atom_ix"]

    def of(self, node: Node) -> DataFrame:
        """What a selection over all atoms holds."""
        return self.rows(node, self.atoms)

    def predicate(self, node: Node) -> Column:
        if node.kind == "row":
            return node.predicate
        parts = [self.predicate(p) for p in node.parts]
        return ~parts[0] if node.kind == "not" else reduce(lambda a, b: a & b if node.kind == "and" else a | b, parts)

    def rows(self, node: Node, among: DataFrame) -> DataFrame:
        """The rows among these that the node holds."""
        if node.by_row:
            return among.where(self.predicate(node))
        if node.kind == "and":
            for part in sorted(node.parts, key=lambda p: not p.by_row):  # filters first
                among = self.rows(part, among)
            return among
        if node.kind == "or":
            plain = [p for p in node.parts if p.by_row]
            found = [self.rows(p, among).select(*self.keys) for p in node.parts if not p.by_row]
            if plain:
                found.append(among.where(_or([self.predicate(p) for p in plain])).select(*self.keys))
            return among.join(reduce(DataFrame.unionByName, found).distinct(), self.keys, "left_semi")
        if node.kind == "not":
            return among.join(self.rows(node.parts[0], among).select(*self.keys), self.keys, "left_anti")
        return getattr(self, f"_{node.kind}")(node, among)

    def _near(self, inner: DataFrame, among: DataFrame, cutoff: float) -> DataFrame:
        """The keys of the rows within the cutoff of one of inner, by the distance join of contact_pairs."""
        from framewalk.operators.contacts import contact_pairs

        frame = F.col("frame") if self.frame else F.lit(0).alias("frame")
        point = lambda rows, name: rows.select(frame, F.col("atom_ix").alias(name), "x", "y", "z")
        boxes = self.boxes if self.boxes is None or "frame" in self.boxes.columns else self.boxes.withColumn("frame", F.lit(0))
        pairs = contact_pairs(point(inner, "ref"), point(among, "sel"), cutoff, boxes)
        return pairs.select(*self.frame, F.col("sel").alias("atom_ix")).distinct()

    def _around(self, node: Node, among: DataFrame) -> DataFrame:
        inner = self.of(node.parts[0])
        others = among.join(inner.select(*self.keys), self.keys, "left_anti")
        return others.join(self._near(inner, others, node.numbers[0]), self.keys, "left_semi")

    def _isolayer(self, node: Node, among: DataFrame) -> DataFrame:
        inner, (low, high) = self.of(node.parts[0]), node.numbers
        others = among.join(inner.select(*self.keys), self.keys, "left_anti")
        return others.join(self._near(inner, others, high), self.keys, "left_semi").join(self._near(inner, others, low), self.keys, "left_anti")

    def _centred(self, node: Node, among: DataFrame) -> tuple[DataFrame, list[Column]]:
        """Rows with the vector from the centre of the node's selection in their frame, by minimum image: one row a frame is joined."""
        centre = self.of(node.parts[0]).groupBy(*self.frame).agg(*(F.avg(a).alias(f"_c{a}") for a in "xyz")).where("_cx is not null")
        rows, box = among, None
        if self.boxes is not None:
            box = [f"_{c}" for c in geometry.box_columns(self.boxes.columns)]
            sizes = self.boxes.select(*self.frame, *(F.col(c[1:]).alias(c) for c in box))
            centre = centre.join(sizes, self.frame) if self.frame else centre.withColumn("_one", F.lit(1)).join(sizes.withColumn("_one", F.lit(1)), "_one").drop("_one")
        rows = rows.join(centre, self.frame) if self.frame else rows.withColumn("_one", F.lit(1)).join(centre.withColumn("_one", F.lit(1)), "_one")
        d = [F.col(a) - F.col(f"_c{a}") for a in "xyz"]
        return rows, geometry.min_image(d, [c[1:] for c in box], "_") if box else d

    def _zone(self, node: Node, among: DataFrame, test) -> DataFrame:
        rows, d = self._centred(node, among)
        return rows.where(test(d)).select(*among.columns)

    def _sphzone(self, node: Node, among: DataFrame) -> DataFrame:
        return self._zone(node, among, lambda d: _near(d, node.numbers[0]))

    def _sphlayer(self, node: Node, among: DataFrame) -> DataFrame:
        low, high = node.numbers
        return self._zone(node, among, lambda d: _near(d, high) & ~_near(d, low))

    def _cyzone(self, node: Node, among: DataFrame) -> DataFrame:
        r, top, bottom = node.numbers
        return self._zone(node, among, lambda d: _near(d[:2], r) & F.coalesce((d[2] <= top) & (d[2] >= bottom), F.lit(False)))

    def _same(self, node: Node, among: DataFrame) -> DataFrame:
        return self._alike(node, among, [node.column])

    def _byres(self, node: Node, among: DataFrame) -> DataFrame:
        return self._alike(node, among, [c for c in ("resid", "segid") if c in among.columns])

    def _alike(self, node: Node, among: DataFrame, columns: list[str]) -> DataFrame:
        by = [*self.frame, *columns]
        return among.join(self.of(node.parts[0]).select(*by).distinct(), by, "left_semi")

    def _bonded(self, node: Node, among: DataFrame) -> DataFrame:
        if self.bonds is None:
            raise ValueError("bonded needs a table of bonds")
        both = self.bonds.select(F.col("a").alias("atom_ix"), F.col("b").alias("_to")).unionByName(self.bonds.select(F.col("b").alias("atom_ix"), F.col("a").alias("_to")))
        near = self.of(node.parts[0]).select(*self.keys).join(both, "atom_ix").select(*self.frame, F.col("_to").alias("atom_ix")).distinct()
        return among.join(near, self.keys, "left_semi")


def select_atoms(atoms: DataFrame, selection: str, boxes: DataFrame | None = None, bonds: DataFrame | None = None) -> DataFrame:
    """The rows of atoms that a selection holds, in the language above.

    atoms has atom_ix, frame if it holds several, and the columns that the selection names.  boxes (frame, lx, ly, lz[, alpha, beta,
    gamma]) makes distances go by the minimum image (point excepted); bonds is (a, b).  A null is in no list or range, "not" holds it.  An
    empty selection makes around, layers and zones empty.
    """
    return Planner(atoms, boxes, bonds).of(Reader(selection).whole()).select(*atoms.columns)
