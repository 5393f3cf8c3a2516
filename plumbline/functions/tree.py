"""Geometries as trees in Python, and their text and binary forms.

A tree is (geometry, dims, items): of a point and a line, items are coordinates (tuples of floats); of a polygon, rings; of all others,
trees.  Only the serialized boundary uses these; native layouts stay with Spark's own expressions.
"""

from __future__ import annotations

import math
import re
import struct
from decimal import ROUND_HALF_EVEN, Context, Decimal

from ..types import GEOMETRY_NAMES, GEOMETRYCOLLECTION, LINESTRING, MULTILINESTRING, MULTIPOINT, MULTIPOLYGON, POINT, POLYGON, XY, XYM, XYZ, XYZM

N_ORD = {XY: 2, XYZ: 3, XYM: 3, XYZM: 4}
TAGS = {XY: "", XYZ: " Z", XYM: " M", XYZM: " ZM"}
_BY_NAME = {n: g for g, n in GEOMETRY_NAMES.items() if 1 <= g <= 7}
_MEMBER = {MULTIPOINT: POINT, MULTILINESTRING: LINESTRING, MULTIPOLYGON: POLYGON}
MAX_DEPTH = 31
Tree = tuple[int, int, list]


class GeometryError(ValueError):
    """Text or bytes that are no geometry, or a geometry that does not fit; ``status`` names the kind."""

    def __init__(self, message: str, status: str = "INVALID"):
        super().__init__(message)
        self.status = status


# ---- numbers -------------------------------------------------------------------------------------------------------

_CONTEXT = Context(prec=400, rounding=ROUND_HALF_EVEN)


def format_double(v: float, precision: int = 16, signed_zero: bool = False) -> str:
    """At most ``precision`` digits after the point: the shortest decimal that reads back as ``v``, rounded half to even.

    Beyond 1e17 the shortest form with an exponent, whatever the precision; no negative zero, unless ``signed_zero`` keeps the sign of -0.0.
    """
    if v != v:
        return "nan"
    if math.isinf(v):
        return "Infinity" if v > 0 else "-Infinity"
    if abs(v) > 1e17:
        return repr(v)
    if not v:
        return "-0" if signed_zero and math.copysign(1, v) < 0 else "0"
    if v == int(v):
        # The shortest digits, padded with zeros: not every digit of the integer.
        return format(Decimal(repr(v)), "f").removesuffix(".0")
    text = repr(v)
    point = text.find(".")
    if "e" in text or len(text) - point - 1 > precision:
        text = format(Decimal(text).quantize(Decimal(1).scaleb(-precision), context=_CONTEXT), "f")
        if "." in text:
            text = text.rstrip("0").rstrip(".")
        if text in ("-0", ""):
            text = "0"
    return text


# ---- text ----------------------------------------------------------------------------------------------------------

_SPACE, _END_OF_NUMBER = " \t\r\n", " \t\r\n,)("
#: Numbers without anything that float() takes and the format does not (signs before a number, underscores, other digits).
_PLAIN = re.compile(r"[0-9.,eE \t\r\n-]+\Z").match


_BLANKS, _LETTERS = re.compile(r"[ \t\r\n]*").match, re.compile(r"[A-Za-z]*").match
_TAGGED = {"Z": XYZ, "M": XYM, "ZM": XYZM}


class _Text:
    def __init__(self, text: str):
        self.t, self.i = text, 0

    def fail(self, what: str):
        raise GeometryError(f"Expected {what} at byte {len(self.t[: self.i].encode())}")

    def skip(self) -> bool:
        end = _BLANKS(self.t, self.i).end()
        moved, self.i = end > self.i, end
        return moved

    def peek(self) -> str:
        self.i = _BLANKS(self.t, self.i).end()
        return self.t[self.i : self.i + 1]

    def word(self) -> str:
        self.i = _BLANKS(self.t, self.i).end()
        return _LETTERS(self.t, self.i)[0]

    def number(self) -> float:
        j = self.i
        while j < len(self.t) and self.t[j] not in _END_OF_NUMBER:
            j += 1
        part = self.t[self.i : j]
        try:
            if not part or part[0] == "+" or "_" in part or not part.isascii():
                raise ValueError
            out = float(part)
        except ValueError:
            self.fail("number")
        self.i = j
        return out

    def coord(self, n: int) -> tuple:
        self.skip()
        out = [self.number()]
        for _ in range(n - 1):
            if not self.skip():
                self.fail("whitespace")
            out.append(self.number())
        return tuple(out)

    def coords(self, n: int) -> list:
        """A list of coordinates; one of plain numbers is read at once, any other step by step, to say where it goes wrong."""
        if self.peek() == "(":
            end = self.t.find(")", self.i)
            part = self.t[self.i + 1 : end]
            if end > 0 and _PLAIN(part):
                try:
                    out = [tuple(map(float, c.split())) for c in part.split(",")]
                except ValueError:
                    out = []
                if out and all(len(c) == n for c in out):
                    self.i = end + 1
                    return out
        return self.listed(lambda: self.coord(n))

    def listed(self, item) -> list:
        """Nothing for EMPTY, else at least one item in parentheses."""
        if self.word() == "EMPTY":
            self.i += 5
            return []
        if self.peek() != "(":
            self.fail("'(' or 'EMPTY'")
        self.i += 1
        out = [item()]
        while True:
            c = self.peek()
            if c == ")":
                self.i += 1
                return out
            if c != ",":
                self.fail("',' or ')'" if c else "')'")
            self.i += 1
            out.append(item())

    def dims(self) -> int:
        tag = self.word()
        if tag in _TAGGED and self.t[self.i + len(tag) : self.i + len(tag) + 1] in (*_SPACE, "("):
            self.i += len(tag)
            return _TAGGED[tag]
        return XY

    def tagged(self, depth: int = 0) -> Tree:
        if depth > MAX_DEPTH:
            raise GeometryError(f"geometries nest deeper than {MAX_DEPTH}")
        name = self.word()
        if name not in _BY_NAME:
            self.fail("geometry type")
        self.i += len(name)
        g, d = _BY_NAME[name], self.dims()
        return g, d, self.body(g, d, depth)

    def body(self, g: int, d: int, depth: int) -> list:
        n = N_ORD[d]
        coords = lambda: self.coords(n)
        if g == POINT:
            out = coords()
            if len(out) > 1:
                raise GeometryError("Expected ')' : a point has one coordinate")
            return out
        if g == LINESTRING:
            return coords()
        if g == POLYGON:
            return self.listed(coords)
        if g == MULTIPOINT:
            self.skip()
            if self.t[self.i : self.i + 1] == "(" and (flat_end := self.t.find(")", self.i)) > 0 and _PLAIN(self.t[self.i + 1 : flat_end]):
                return [(POINT, d, [c]) for c in coords()]
            flat = lambda: (POINT, d, coords() if self.peek() == "(" or self.word() == "EMPTY" else [self.coord(n)])
            return self.listed(flat)
        if g == GEOMETRYCOLLECTION:
            return self.listed(lambda: self.tagged(depth + 1))
        return self.listed(lambda: (_MEMBER[g], d, self.body(_MEMBER[g], d, depth + 1)))


def parse_wkt(text: str) -> Tree:
    t = _Text(text)
    out = t.tagged()
    t.skip()
    if t.i < len(t.t):
        t.fail("end of input")
    return out


def format_wkt(tree: Tree, precision: int = 16, flat_multipoint: bool = True, depth: int = 0, signed_zero: bool = False) -> str:
    g, d, _ = tree
    if depth > MAX_DEPTH:
        raise GeometryError(f"geometries nest deeper than {MAX_DEPTH}")
    return GEOMETRY_NAMES[g] + TAGS[d] + " " + _body(tree, precision if 0 <= precision <= 16 else 16, flat_multipoint, depth, signed_zero)


def _body(tree: Tree, p: int, flat: bool, depth: int, signed_zero: bool) -> str:
    g, _, items = tree
    if not items:
        return "EMPTY"
    coords = lambda cs: "(" + ", ".join(" ".join(format_double(v, p, signed_zero) for v in c) for c in cs) + ")" if cs else "EMPTY"
    if g in (POINT, LINESTRING):
        return coords(items)
    if g == POLYGON:
        return "(" + ", ".join(map(coords, items)) + ")"
    if g == GEOMETRYCOLLECTION:
        return "(" + ", ".join(format_wkt(x, p, flat, depth + 1, signed_zero) for x in items) + ")"
    bare = lambda x: coords(x[2])[1:-1] if flat and g == MULTIPOINT and x[2] else _body(x, p, flat, depth + 1, signed_zero)
    return "(" + ", ".join(map(bare, items)) + ")"


# ---- binary --------------------------------------------------------------------------------------------------------


class _Bytes:
    def __init__(self, raw: bytes):
        self.b, self.i, self.srid = raw, 0, None

    def take(self, fmt: str, what: str):
        size = struct.calcsize(fmt)
        if self.i + size > len(self.b):
            raise GeometryError(f"Expected {what} but found end of buffer at byte {self.i}", "TOO_FEW_BYTES")
        out = struct.unpack_from(fmt, self.b, self.i)
        self.i += size
        return out[0] if len(out) == 1 else out

    def coords(self, order: str, n: int, d: int) -> list:
        size = n * N_ORD[d] * 8
        if self.i + size > len(self.b):
            raise GeometryError(f"Expected coordinate sequence of {n} coords ({size} bytes) but found {len(self.b) - self.i} bytes remaining at byte {self.i}", "TOO_FEW_BYTES")
        flat = struct.unpack_from(f"{order}{n * N_ORD[d]}d", self.b, self.i)
        self.i += size
        return list(zip(*[iter(flat)] * N_ORD[d], strict=True))

    def tree(self, depth: int = 0) -> Tree:
        if depth > MAX_DEPTH:
            raise GeometryError(f"geometries nest deeper than {MAX_DEPTH}", "INVALID_GEOMETRY_TYPE")
        start = self.i
        endian = self.take("B", "endian byte")
        if endian > 1:
            raise GeometryError(f"Expected endian byte 0 or 1 but found {endian} at byte {start}", "INVALID_ENDIAN")
        order = "<" if endian else ">"
        code = self.take(order + "I", "uint32")
        z, m, srid, low = bool(code & 0x80000000), bool(code & 0x40000000), bool(code & 0x20000000), code & 0x0000FFFF
        if srid:
            srid_value = self.take(order + "I", "uint32")
            self.srid = srid_value if self.srid is None else self.srid
        thousands, g = divmod(low, 1000)
        if thousands > 3 or not 1 <= g <= 7:
            raise GeometryError(f"Expected valid geometry type code but found {low} at byte {start + 1}", "INVALID_GEOMETRY_TYPE")
        z, m = z or thousands in (1, 3), m or thousands in (2, 3)
        d = {(False, False): XY, (True, False): XYZ, (False, True): XYM, (True, True): XYZM}[z, m]
        if g == POINT:
            c = self.coords(order, 1, d)
            return g, d, c
        n = self.take(order + "I", "uint32")
        if g == LINESTRING:
            return g, d, self.coords(order, n, d)
        if g == POLYGON:
            return g, d, [self.coords(order, self.take(order + "I", "uint32"), d) for _ in range(n)]
        return g, d, [self.tree(depth + 1) for _ in range(n)]


def parse_wkb(raw: bytes, strict: bool = False) -> tuple[Tree, int | None]:
    """(tree, SRID or None); ``strict`` also refuses bytes after the geometry."""
    b = _Bytes(raw)
    out = b.tree()
    if strict and b.i < len(raw):
        raise GeometryError(f"Expected end of input at byte {b.i}", "TOO_MANY_BYTES")
    return out, b.srid


def format_wkb(tree: Tree, depth: int = 0) -> bytes:
    """Little-endian with ISO type codes; an empty point is all NaN."""
    g, d, items = tree
    if depth >= MAX_DEPTH:
        raise GeometryError(f"geometries nest deeper than {MAX_DEPTH - 1}")
    head = struct.pack("<BI", 1, g + (d - 1) * 1000)
    flat = lambda cs: struct.pack(f"<{len(cs) * N_ORD[d]}d", *(v for c in cs for v in c))
    if g == POINT:
        return head + flat(items or [(math.nan,) * N_ORD[d]])
    head += struct.pack("<I", len(items))
    if g == LINESTRING:
        return head + flat(items)
    if g == POLYGON:
        return head + b"".join(struct.pack("<I", len(r)) + flat(r) for r in items)
    return head + b"".join(format_wkb(x, depth + 1) for x in items)


# ---- casts ---------------------------------------------------------------------------------------------------------

_PLACE = {XY: (0, 1, None, None), XYZ: (0, 1, 2, None), XYM: (0, 1, None, 2), XYZM: (0, 1, 2, 3)}


def cast_coord(c: tuple, frm: int, to: int) -> tuple:
    """Ordinates that the target lacks go, those that the source lacks are NaN; Z and M never mix."""
    if frm == to:
        return c
    return tuple(c[at] if (at := _PLACE[frm][k]) is not None else math.nan for k in range(4) if _PLACE[to][k] is not None)


def coords_of(tree: Tree, dims: int | None = None):
    """All coordinates, in order, in their own dimensions or in ``dims``."""
    g, d, items = tree
    if g in (POINT, LINESTRING):
        yield from (cast_coord(c, d, dims or d) for c in items)
    elif g == POLYGON:
        for r in items:
            yield from (cast_coord(c, d, dims or d) for c in r)
    else:
        for x in items:
            yield from coords_of(x, dims)


def sequences_of(tree: Tree, dims: int) -> list[list]:
    """Coordinates of each line and ring."""
    g, d, items = tree
    if g == LINESTRING:
        return [[cast_coord(c, d, dims) for c in items]]
    if g == POLYGON:
        return [[cast_coord(c, d, dims) for c in r] for r in items]
    return [] if g == POINT else [s for x in items for s in sequences_of(x, dims)]


def cast_lenient(tree: Tree, to: int, dims: int) -> list | tuple | None:
    """Payload of native type ``to`` by what the coordinates allow; an empty point is all NaN."""
    if to in (POINT, MULTIPOINT, LINESTRING):
        coords = list(coords_of(tree, dims))
        if to == POINT:
            if len(coords) > 1:
                raise GeometryError("Can't convert feature with >1 coordinate to POINT")
            return coords[0] if coords else (math.nan,) * N_ORD[dims]
        if len(sequences_of(tree, dims)) > 1:
            raise GeometryError("Can't convert feature with >1 sequence to LINESTRING")
        return coords
    if to in (POLYGON, MULTILINESTRING):
        return [s for s in sequences_of(tree, dims) if s]
    parts: list = []

    def walk(t: Tree) -> None:
        if t[0] in (GEOMETRYCOLLECTION, MULTIPOLYGON):
            for x in t[2]:
                walk(x)
        elif rings := [s for s in sequences_of(t, dims) if s]:
            parts.append(rings)

    if to != MULTIPOLYGON:
        raise GeometryError(f"no conversion to type {to}")
    walk(tree)
    return parts


def cast_strict(tree: Tree, to: int, dims: int) -> list | tuple:
    """As cast_lenient(), but only between a type and its multi form; sizes above 1 do not narrow."""
    g, d, items = tree
    name, target = GEOMETRY_NAMES[g], GEOMETRY_NAMES[to]
    if to == POINT:
        coords = list(coords_of(tree, dims))
        if len(coords) > 1:
            raise GeometryError("Can't append geometry with coord count >1 to array of type POINT")
        return coords[0] if coords else (math.nan,) * N_ORD[dims]
    own = lambda t: [cast_coord(c, t[1], dims) for c in t[2]]
    rings = lambda t: [[cast_coord(c, t[1], dims) for c in r] for r in t[2]]
    if not any(True for _ in coords_of(tree)):  # whatever is empty fits everywhere
        return []
    simple, payload = {LINESTRING: (LINESTRING, own), MULTIPOINT: (POINT, own), POLYGON: (POLYGON, rings), MULTILINESTRING: (LINESTRING, own), MULTIPOLYGON: (POLYGON, rings)}[to]
    multi = next(k for k, v in _MEMBER.items() if v == simple)
    if g not in (simple, multi):
        raise GeometryError(f"Can't append {name} to array of type {target}")
    if to == simple:
        if g == multi and len(items) > 1:
            raise GeometryError(f"Can't append {name} with size >1 to array of type {target}")
        return payload(items[0] if g == multi else tree)
    members = items if g == multi else [tree]
    return [c for m in members for c in own(m)] if to == MULTIPOINT else [payload(m) for m in members]


def from_native(value, geometry: int, dims: int) -> Tree:
    """Tree of a native payload of tuples."""
    if geometry == POINT:
        return POINT, dims, [value]
    if geometry == LINESTRING or geometry == POLYGON:
        return geometry, dims, value
    if geometry == MULTIPOINT:
        return geometry, dims, [(POINT, dims, [c]) for c in value]
    return geometry, dims, [(_MEMBER[geometry], dims, x) for x in value]


def _full(coords: list, d: int) -> list[tuple]:
    """Coordinates as x, y, z, m."""
    nan = math.nan
    return [(x, y, nan, nan) for x, y in coords] if d == XY else [cast_coord(c, d, XYZM) for c in coords]


def nodes_of(tree: Tree, level: int = 0) -> list[tuple[int, int, int, int, list]]:
    """Depth-first nodes: level, geometry, dims, size and coordinates (as x, y, z, m) of each; rings are lines."""
    g, d, items = tree
    if g in (POINT, LINESTRING):
        return [(level, g, d, len(items), _full(items, d))]
    out = [(level, g, d, len(items), [])]
    for x in items:
        out += [(level + 1, LINESTRING, d, len(x), _full(x, d))] if g == POLYGON else nodes_of(x, level + 1)
    return out


def from_nodes(nodes: list[tuple]) -> Tree:
    it = iter(nodes)

    def one() -> Tree:
        _, g, d, size, coords = next(it)
        if g in (POINT, LINESTRING):
            return g, d, [c[:2] for c in coords] if d == XY else [cast_coord(c, XYZM, d) for c in coords]
        kids = [one() for _ in range(size)]
        return g, d, [k[2] for k in kids] if g == POLYGON else kids

    out = one()
    if next(it, None) is not None:
        raise GeometryError("more nodes than the geometry has")
    return out


def first_code(tree: Tree) -> int | None:
    """ISO code of the outermost geometry, if there is any coordinate."""
    return tree[0] + (tree[1] - 1) * 1000 if any(True for _ in coords_of(tree)) else None
