"""Columns of text and binary geometries: decode, encode, convert, validate.

Each function takes a column and returns one; Python works on Arrow batches and only here.  Native layouts are written, and binary
points and lines read, with numpy and Arrow over the whole batch; other text and binary is read value by value.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .. import types as G
from . import tree as tr

_COORD = T.StructType([T.StructField(n, T.DoubleType(), False) for n in "xyzm"])
_NODE = T.StructType([T.StructField("level", T.IntegerType()), T.StructField("gtype", T.IntegerType()), T.StructField("dims", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("coords", T.ArrayType(_COORD))])
#: A geometry of any type as one column: outermost type and dimensions, SRID, depth-first nodes.
IR = T.StructType([T.StructField("gtype", T.IntegerType()), T.StructField("dims", T.IntegerType()), T.StructField("srid", T.LongType()), T.StructField("nodes", T.ArrayType(_NODE))])


def _udf(returns: T.DataType, fn: Callable[[pa.Array], pa.Array]) -> Callable[[Column], Column]:
    return F.arrow_udf(fn, returns)


def _each(returns: T.DataType, fn: Callable) -> Callable[[Column], Column]:
    """Null stays null; every other value goes through ``fn``."""
    arrow = to_arrow_type(returns)

    def run(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else fn(v) for v in values.to_pylist()], arrow)

    return _udf(returns, run)


def tuples(value, depth: int, names: str | None):
    """Coordinates as tuples, from structs (``names``) or arrays."""
    if depth:
        return [tuples(v, depth - 1, names) for v in value]
    return tuple(value[n] for n in names) if names else tuple(value)


def _untuple(value, depth: int, names: str | None):
    if depth:
        return [_untuple(v, depth - 1, names) for v in value]
    return dict(zip(names, value, strict=True)) if names else list(value)


def reader(t: G.GeometryType) -> Callable:
    """Function from a Python value of type ``t`` to a tree."""
    if t.id in G.TEXT:
        return tr.parse_wkt
    if t.id in G.BINARY:
        return lambda v: tr.parse_wkb(v)[0]
    names = G.DIM_NAMES[t.dims] if t.coords == G.SEPARATE else None
    if t.geometry == G.BOX:
        if t.dims != G.XY:
            raise ValueError("only XY boxes can be read as polygons")

        def box(b):
            if b["xmin"] > b["xmax"] or b["ymin"] > b["ymax"]:
                return G.POLYGON, G.XY, []
            x0, y0, x1, y1 = b["xmin"], b["ymin"], b["xmax"], b["ymax"]
            return G.POLYGON, G.XY, [[(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]]

        return box
    return lambda v: tr.from_native(tuples(v, G.DEPTH[t.geometry], names), t.geometry, t.dims)


def writer(t: G.GeometryType, precision: int = 16, flat_multipoint: bool = True, strict: bool = False, signed_zero: bool = False) -> Callable:
    if t.id in G.TEXT:
        return lambda tree: tr.format_wkt(tree, precision, flat_multipoint, signed_zero=signed_zero)
    if t.id in G.BINARY:
        return tr.format_wkb
    if t.geometry == G.BOX:
        raise ValueError("a box is no conversion target; use box()")
    names = G.DIM_NAMES[t.dims] if t.coords == G.SEPARATE else None
    cast = tr.cast_strict if strict else tr.cast_lenient
    return lambda tree: _untuple(cast(tree, t.geometry, t.dims), G.DEPTH[t.geometry], names)


# ---- native layouts, all rows of a batch at once ------------------------------------------------------------------------------


def _levels(values: pa.Array, depth: int) -> tuple[list[np.ndarray], pa.Array]:
    """Offsets of each level of lists, outermost first and from 0, and the coordinates below them."""
    out = []
    for _ in range(depth):
        offs = np.asarray(values.offsets).astype(np.int64)
        values = values.values.slice(offs[0], offs[-1] - offs[0])
        out.append(offs - offs[0])
    return out, values


def _ordinates(coords: pa.Array, t: G.GeometryType) -> np.ndarray:
    """Coordinates x ordinates; a null coordinate (a null point) is all NaN."""
    n_ord = tr.N_ORD[t.dims]
    if t.coords == G.SEPARATE:
        return np.stack([c.to_numpy(zero_copy_only=False) for c in coords.flatten()], 1)
    if coords.null_count:
        coords = coords.fill_null([math.nan] * n_ord)
    return np.asarray(coords.flatten()).reshape(-1, n_ord)


def _masked(out: pa.Array, like: pa.Array) -> pa.Array:
    return pc.if_else(like.is_valid(), out, pa.scalar(None, out.type)) if like.null_count else out


def _native_to_wkb(t: G.GeometryType) -> Callable[[pa.Array], pa.Array]:
    """The bytes of a batch in one buffer: heads go to where they belong, ordinates fill what is left."""
    n_ord, depth, dims = tr.N_ORD[t.dims], G.DEPTH[t.geometry], (t.dims - 1) * 1000
    code = lambda g: np.uint32(g + dims)
    whole = np.dtype([("e", "u1"), ("c", "<u4"), ("n", "<u4")])
    bare = np.dtype([("e", "u1"), ("c", "<u4")])

    def head(kind: np.dtype, g: int, sizes: np.ndarray) -> np.ndarray:
        out = np.empty(len(sizes), kind)
        out["e"], out["c"] = 1, code(g)
        if kind == whole:
            out["n"] = sizes
        return np.frombuffer(out.tobytes(), np.uint8).reshape(len(sizes), kind.itemsize)

    def run(values: pa.Array) -> pa.Array:
        offs, coords = _levels(values, depth)
        xs = _ordinates(coords, t)
        size = [np.diff(o) for o in offs]
        width = 8 * n_ord
        one = np.ones(len(xs), np.int64)
        # Heads from the outermost level to the innermost, as bytes: one row for each geometry of the level.
        heads = {
            G.POINT: lambda: [head(bare, G.POINT, one)],
            G.LINESTRING: lambda: [head(whole, G.LINESTRING, size[0])],
            G.MULTIPOINT: lambda: [head(whole, G.MULTIPOINT, size[0]), head(bare, G.POINT, one)],
            G.POLYGON: lambda: [head(whole, G.POLYGON, size[0]), size[1].astype("<u4").view(np.uint8).reshape(-1, 4)],
            G.MULTILINESTRING: lambda: [head(whole, G.MULTILINESTRING, size[0]), head(whole, G.LINESTRING, size[1])],
            G.MULTIPOLYGON: lambda: [head(whole, G.MULTIPOLYGON, size[0]), head(whole, G.POLYGON, size[1]), size[2].astype("<u4").view(np.uint8).reshape(-1, 4)],
        }[t.geometry]()
        # Children of each level: of the innermost heads, coordinates (one each, if the heads are of points).
        kids = [*offs, np.arange(len(xs) + 1)][: len(heads)]
        taken = [h.shape[1] for h in heads]
        # Bytes of each item, from the inside; then where it begins, from the outside.
        sizes = [np.empty(0)] * len(heads)
        below = np.full(len(xs), width, np.int64)
        for level in range(len(heads) - 1, -1, -1):
            total = np.concatenate([[0], np.cumsum(below)])
            sizes[level] = taken[level] + np.diff(total[kids[level]])
            below = sizes[level]
        at = np.concatenate([[0], np.cumsum(sizes[0])])
        if at[-1] >= 2**31:
            raise ValueError("a batch has over 2 GB of binary geometries: lower spark.sql.execution.arrow.maxRecordsPerBatch")
        out, body = np.empty(at[-1], np.uint8), np.ones(at[-1], bool)
        starts = at[:-1]
        for level, h in enumerate(heads):
            where = starts[:, None] + np.arange(taken[level])
            out[where], body[where] = h, False
            if level + 1 < len(heads):
                before = np.cumsum(sizes[level + 1]) - sizes[level + 1]
                owner = np.repeat(np.arange(len(starts)), np.diff(kids[level]))
                first = np.minimum(kids[level][:-1], max(0, len(before) - 1))
                starts = starts[owner] + taken[level] + before - (before[first][owner] if len(before) else 0)
        out[body] = np.frombuffer(np.ascontiguousarray(xs, "<f8").tobytes(), np.uint8)
        return _masked(pa.Array.from_buffers(pa.binary(), len(values), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out.tobytes())]), values)

    return run


def format_doubles(xs: np.ndarray, precision: int = 16, signed_zero: bool = False) -> pa.Array:
    """Each number as format_double() writes it.

    Of numbers from 1 to 1e10 the shortest decimal has at most 16 places and needs no rounding at full precision: these are printed
    at once; of all others each distinct one is printed by itself.
    """
    size = np.abs(xs)
    plain = ((size >= 1) & (size < 1e10) & (precision >= 16)) | (xs == np.floor(xs)) & (size < 1e10) & (size >= 1)
    out = pc.replace_substring_regex(pc.cast(pa.array(np.where(plain, xs, 1.0)), pa.string()), r"\.0$", "")
    if plain.all():
        return out
    names, code = np.unique(xs[~plain].view(np.int64), return_inverse=True)  # by bits, so that NaN is one
    said = pa.array([tr.format_double(v, precision, signed_zero) for v in names.view(np.float64).tolist()], pa.string())
    at = np.full(len(xs), -1)
    at[~plain] = code
    return pc.if_else(pa.array(plain), out, said.take(pa.array(np.maximum(at, 0)))) if len(said) else out


def coords_text(xs: np.ndarray, precision: int, signed_zero: bool = False) -> pa.Array:
    """Ordinates of each coordinate with a space between."""
    n = len(xs)
    flat = format_doubles(np.ascontiguousarray(xs).ravel(), precision, signed_zero)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * xs.shape[1]), flat), " ")


def _enclosed(texts: pa.Array, offs: np.ndarray) -> pa.Array:
    """The members of each list in parentheses, or EMPTY."""
    lists = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), texts)
    return pc.if_else(pa.array(np.diff(offs) > 0), pc.binary_join_element_wise("(", pc.binary_join(lists, ", "), ")", ""), "EMPTY")


def _native_to_wkt(t: G.GeometryType, precision: int, flat_multipoint: bool, signed_zero: bool = False) -> Callable[[pa.Array], pa.Array]:
    precision = precision if 0 <= precision <= 16 else 16
    tag = G.GEOMETRY_NAMES[t.geometry] + tr.TAGS[t.dims] + " "

    def run(values: pa.Array) -> pa.Array:
        offs, coords = _levels(values, G.DEPTH[t.geometry])
        text = coords_text(_ordinates(coords, t), precision, signed_zero)
        if t.geometry == G.POINT or t.geometry == G.MULTIPOINT and not flat_multipoint:
            text = pc.binary_join_element_wise("(", text, ")", "")
        for o in reversed(offs):
            text = _enclosed(text, o)
        return _masked(pc.binary_join_element_wise(tag, text, ""), values)

    return run


# ---- binary points and lines, the rows of a batch that are such at once ----------------------------------------------------


class Runs:
    """Of a batch of binary geometries, the rows that are little-endian points or lines without SRID: ``rows`` and ``codes``, and the rest as ``others``."""

    def __init__(self, values: pa.Array):
        n = len(values)
        at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
        self.buf = np.frombuffer(values.buffers()[2] or b"", np.uint8) if n else np.empty(0, np.uint8)
        self.start, size = at[:-1], np.diff(at)
        valid = np.asarray(values.is_valid()) if n else np.zeros(0, bool)
        some = np.flatnonzero(valid & (size >= 9))
        head = self.buf[self.start[some, None] + np.arange(9)]
        code = np.ascontiguousarray(head[:, 1:5]).view("<u4").ravel().astype(np.int64)
        count = np.ascontiguousarray(head[:, 5:9]).view("<u4").ravel().astype(np.int64)
        kind, dims = code % 1000, code // 1000
        width = 8 * np.array([2, 3, 3, 4, 0])[np.minimum(dims, 4)]
        point = (kind == 1) & (size[some] == 5 + width)
        line = (kind == 2) & (size[some] == 9 + width * count)
        good = (head[:, 0] == 1) & (dims <= 3) & (point | line)
        self.rows, self.codes, self.counts = some[good], code[good], np.where(point, 1, count)[good]
        rest = valid.copy()
        rest[self.rows] = False
        self.others = np.flatnonzero(rest)

    def groups(self):
        """For each code: its rows, where their coordinates begin, and these."""
        for code in np.unique(self.codes).tolist():
            mine = np.flatnonzero(self.codes == code)
            rows, counts = self.rows[mine], self.counts[mine]
            n_ord = (2, 3, 3, 4)[code // 1000]
            offs = np.concatenate([[0], np.cumsum(counts)])
            first = self.start[rows] + (5 if code % 1000 == 1 else 9)
            where = np.repeat(first - offs[:-1] * 8 * n_ord, counts) + np.arange(offs[-1]) * 8 * n_ord
            xs = self.buf[where[:, None] + np.arange(8 * n_ord)].view("<f8") if offs[-1] else np.empty((0, n_ord))
            yield code, rows, offs, xs


def _wkb_to_wkt(precision: int, flat_multipoint: bool, signed_zero: bool = False) -> Callable[[pa.Array], pa.Array]:
    precision = precision if 0 <= precision <= 16 else 16

    def run(values: pa.Array) -> pa.Array:
        runs, parts, where = Runs(values), [], []
        for code, rows, offs, xs in runs.groups():
            body = _enclosed(coords_text(xs, precision, signed_zero), offs)
            parts.append(pc.binary_join_element_wise(G.GEOMETRY_NAMES[code % 1000] + tr.TAGS[code // 1000 + 1] + " ", body, ""))
            where.append(rows)
        if len(runs.others):
            parts.append(pa.array([tr.format_wkt(tr.parse_wkb(v)[0], precision, flat_multipoint, signed_zero=signed_zero) for v in values.take(pa.array(runs.others)).to_pylist()], pa.string()))
            where.append(runs.others)
        if not parts:
            return pa.nulls(len(values), pa.string())
        at = np.full(len(values), -1)
        at[np.concatenate(where)] = np.arange(sum(map(len, parts)))
        return pa.concat_arrays([p.cast(pa.string()) for p in parts]).take(pa.array(at, mask=at < 0))

    return run


def convert(col: Column, frm: G.GeometryType, to: G.GeometryType, *, strict: bool = False, precision: int = 16, flat_multipoint: bool = True, signed_zero: bool = False) -> Column:
    """``col`` of type ``frm`` as type ``to``; a value that cannot be converted fails the query.  ``signed_zero`` writes -0.0 as -0 in text."""
    if not frm.serialized and frm.geometry != G.BOX and to.serialized:
        return _udf(to.spark_type(), _native_to_wkb(frm) if to.id in G.BINARY else _native_to_wkt(frm, precision, flat_multipoint, signed_zero))(col)
    if frm.id in G.BINARY and to.id in G.TEXT:
        return _udf(T.StringType(), _wkb_to_wkt(precision, flat_multipoint, signed_zero))(col)
    read, write = reader(frm), writer(to, precision, flat_multipoint, strict, signed_zero)
    return _each(to.spark_type(), lambda v: write(read(v)))(col)


def _tried(t: G.GeometryType) -> T.StructType:
    return T.StructType([T.StructField("value", t.spark_type()), T.StructField("error", T.StringType())])


def try_convert(col: Column, frm: G.GeometryType, to: G.GeometryType, *, strict: bool = False) -> Column:
    """struct<value, error>: the error's text instead of a failing query."""
    return try_convert_all(col, frm, {"it": to}, strict=strict)["it"]


def try_convert_all(col: Column, frm: G.GeometryType, to: dict[str, G.GeometryType], *, strict: bool = False) -> Column:
    """A struct of one struct<value, error> for each target by name; each value is read once for all of them.  A null is null in each."""
    read, writers = reader(frm), {k: writer(t, strict=strict) for k, t in to.items()}
    nothing = {"value": None, "error": None}

    def one(v):
        try:
            tree = read(v)
        except tr.GeometryError as e:
            return {k: {"value": None, "error": str(e)} for k in writers}
        out = {}
        for k, write in writers.items():
            try:
                out[k] = {"value": write(tree), "error": None}
            except tr.GeometryError as e:
                out[k] = {"value": None, "error": str(e)}
        return out

    returns = T.StructType([T.StructField(k, _tried(t)) for k, t in to.items()])
    arrow = to_arrow_type(returns)

    def run(values: pa.Array) -> pa.Array:
        return pa.array([{k: nothing for k in writers} if v is None else one(v) for v in values.to_pylist()], arrow)

    return _udf(returns, run)(col)


def to_ir(col: Column, frm: G.GeometryType) -> Column:
    """Each geometry as IR; its nodes and coordinates are laid out flat, as Arrow has them."""
    read = (lambda v: tr.parse_wkb(v)) if frm.id in G.BINARY else (lambda v, r=reader(frm): (r(v), None))
    arrow = to_arrow_type(IR)
    node = arrow.field("nodes").type.value_type

    def run(values: pa.Array) -> pa.Array:
        tops, nodes, sizes, coords = [], [], [], []
        for v in values.to_pylist():
            if v is None:
                tops.append((None, None, None)), sizes.append(0)
                continue
            tree, srid = read(v)
            mine = tr.nodes_of(tree)
            tops.append((tree[0], tree[1], srid)), sizes.append(len(mine))
            nodes += [(*n[:4], len(n[4])) for n in mine]
            for n in mine:
                coords += n[4]
        at = lambda lens: pa.array(np.concatenate([[0], np.cumsum(lens)]).astype(np.int32))
        xs = np.array(coords, np.float64).reshape(-1, 4)
        flat = np.array(nodes, np.int32).reshape(-1, 5)
        point = node.field("coords").type.value_type
        listed = pa.ListArray.from_arrays(at(flat[:, 4]), pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xs[:, k])) for k in range(4)], fields=list(point)), type=node.field("coords").type)
        all_nodes = pa.StructArray.from_arrays([*(pa.array(np.ascontiguousarray(flat[:, k])) for k in range(4)), listed], fields=list(node))
        top = [pa.array([t[k] for t in tops], arrow.field(k).type) for k in range(3)]
        return pa.StructArray.from_arrays([*top, pa.ListArray.from_arrays(at(sizes), all_nodes, type=arrow.field("nodes").type)], fields=list(arrow), mask=pa.array([t[0] is None for t in tops], pa.bool_()))

    return _udf(IR, run)(col)


def from_ir(col: Column, to: G.GeometryType) -> Column:
    write = writer(to)
    arrow = to_arrow_type(to.spark_type())

    def run(values: pa.Array) -> pa.Array:
        offs, nodes = _levels(values.field("nodes"), 1)
        (first,), coords = _levels(nodes.field("coords"), 1)
        xs = list(zip(*(coords.field(k).to_numpy(zero_copy_only=False).tolist() for k in range(4)), strict=True))
        cols = [nodes.field(k).to_pylist() for k in range(4)]
        every = [(*row, xs[a:b]) for *row, a, b in zip(*cols, first[:-1].tolist(), first[1:].tolist(), strict=True)]
        return pa.array([write(tr.from_nodes(every[a:b])) if ok else None for ok, a, b in zip(values.is_valid().to_pylist(), offs[0][:-1].tolist(), offs[0][1:].tolist(), strict=True)], arrow)

    return _udf(to.spark_type(), run)(col)


def status(col: Column, frm: G.GeometryType) -> Column:
    """OK, or what is wrong: TOO_FEW_BYTES, TOO_MANY_BYTES, INVALID_ENDIAN, INVALID_GEOMETRY_TYPE, or INVALID for text."""
    strict = (lambda v: tr.parse_wkb(v, True)) if frm.id in G.BINARY else reader(frm)

    def one(v):
        try:
            strict(v)
        except tr.GeometryError as e:
            return e.status
        return "OK"

    return _each(T.StringType(), one)(col)


def error(col: Column, frm: G.GeometryType) -> Column:
    """Null for a readable geometry, else the message."""
    read = reader(frm)

    def one(v):
        try:
            read(v)
        except tr.GeometryError as e:
            return str(e)
        return None

    return _each(T.StringType(), one)(col)


def type_code(col: Column, frm: G.GeometryType) -> Column:
    """ISO code of the outermost geometry; null for null and without a coordinate."""
    read = reader(frm)
    return _each(T.IntegerType(), lambda v: tr.first_code(read(v)))(col)


def box_of(tree: tr.Tree) -> dict:
    """XY bounds of one geometry."""
    out = [math.inf, math.inf, -math.inf, -math.inf]
    for c in tr.coords_of(tree):
        for k in (0, 1):  # comparisons with NaN are false
            out[k] = c[k] if c[k] < out[k] else out[k]
            out[k + 2] = c[k] if c[k] > out[k + 2] else out[k + 2]
    return dict(zip(("xmin", "ymin", "xmax", "ymax"), out, strict=True))


def bounds(col: Column, frm: G.GeometryType, dims: int = G.XY) -> Column:
    """Box of a serialized geometry: NaN never counts, nothing gives (inf, .., -inf, ..), also in a dimension that a geometry lacks.

    Points and lines in little-endian binary are bounded without building geometries.
    """
    box = G.GeometryType.make(G.BOX, dims).spark_type()
    arrow, read, names = to_arrow_type(box), reader(frm), G.DIM_NAMES[dims]

    def run(values: pa.Array) -> pa.Array:
        n = len(values)
        low, high = np.full((len(names), n), np.inf), np.full((len(names), n), -np.inf)

        def put(rows: np.ndarray, offs: np.ndarray, xs: np.ndarray, have: str) -> None:
            some = np.diff(offs) > 0
            first = offs[:-1][some]
            for k, name in enumerate(names):
                if name in have and len(first):
                    x = xs[:, have.index(name)]
                    nan = np.isnan(x)
                    low[k, rows[some]], high[k, rows[some]] = np.minimum.reduceat(np.where(nan, np.inf, x), first), np.maximum.reduceat(np.where(nan, -np.inf, x), first)

        if frm.id in G.BINARY:
            runs = Runs(values)
            for code, rows, offs, xs in runs.groups():
                put(rows, offs, xs, G.DIM_NAMES[code // 1000 + 1])
            others = runs.others
        else:
            others = np.flatnonzero(np.asarray(values.is_valid())) if n else np.empty(0, np.int64)
        if len(others):
            lists = [list(tr.coords_of(read(v), G.XYZM)) for v in values.take(pa.array(others)).to_pylist()]
            put(others, np.concatenate([[0], np.cumsum([len(x) for x in lists])]), np.array([c for x in lists for c in x], float).reshape(-1, 4), "xyzm")
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in (*low, *high)], fields=list(arrow), mask=values.is_null())

    return _udf(box, run)(col)
