"""The scalar and aggregate operators by name: one registry, for columns and for SQL.

SQL has the scalar operators as functions (register_all) and the aggregates as spellings over these and Spark's own aggregates (sql()), so
they keep partial aggregation and no group is ever collected.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as G
from ..functions import codec, native


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def void(c, t: G.GeometryType | None = None) -> Column:
    """Null for every row of any input."""
    return F.lit(None)


def void_agg(c, t: G.GeometryType | None = None) -> Column:
    return F.max(F.lit(None).cast("int"))


def visit_void_agg(c, t: G.GeometryType) -> Column:
    """Null if every geometry can be read; else the query fails with the first message (in order of text)."""
    message = F.min(codec.error(_c(c), t)) if t.serialized else F.max(F.lit(None).cast("string"))
    return F.when(message.isNotNull(), F.raise_error(message).cast("int"))


def format_wkt(c, t: G.GeometryType, precision: int = 16, max_element_size_bytes: int = 0) -> Column:
    """Text with at most ``precision`` decimals, cut after ``max_element_size_bytes`` bytes (all of it is ASCII) if that is positive."""
    text = codec.convert(_c(c), t, G.GeometryType(G.WKT), precision=precision)
    return F.substring(text, 1, max_element_size_bytes) if max_element_size_bytes > 0 else text


def as_type(c, t: G.GeometryType, type: int) -> Column:
    """``c`` as another type by the lenient rules, with the same CRS and edges."""
    out = G.GeometryType(int(type), t.metadata)
    if out.id == t.id:
        made = _c(c)
    elif not t.serialized and not out.serialized and t.geometry == out.geometry != G.BOX:
        # Only dimensions or layout differ: no Python.
        made = native.cast_coords(native.cast_dims(c, t, out.dims), t.with_dims(out.dims), out.coords)
    else:
        made = codec.convert(_c(c), t, out)
    return made.alias("geometry", metadata=out.field_metadata())


def as_wkt(c, t: G.GeometryType) -> Column:
    return as_type(c, t, G.WKT)


def as_wkb(c, t: G.GeometryType) -> Column:
    return as_type(c, t, G.WKB)


def box(c, t: G.GeometryType, dims: int = G.XY) -> Column:
    if not t.serialized:
        return native.box(c, t, dims)
    native._planar(t)
    return codec.bounds(_c(c), t, dims).alias("box", metadata=G.GeometryType.make(G.BOX, dims, metadata=t.metadata).field_metadata())


def box_agg(c, t: G.GeometryType, dims: int = G.XY) -> Column:
    return native.box_agg(box(c, t, dims), dims)


# ---- what iterates over coordinates, for native, text and binary columns alike ---------------------------------------------

_XYZM_LINE = G.GeometryType.make(G.LINESTRING, G.XYZM)


def nodes(c, t: G.GeometryType) -> Column:
    """The depth-first nodes of a text or binary geometry: read once, then all is Spark's own."""
    return codec.to_ir(_c(c), t)["nodes"]


def coords(c, t: G.GeometryType) -> Column:
    """All coordinates as one array: of a native column as they are, of text and binary as x, y, z, m (NaN where there is none)."""
    return F.flatten(F.transform(nodes(c, t), lambda n: n["coords"])) if t.serialized else native.coords(c, t)


def vertices(c, t: G.GeometryType) -> Column:
    """Generator: one row for each coordinate, with its place."""
    return F.posexplode(coords(c, t))


def edges(c, t: G.GeometryType) -> Column:
    """array<struct<start, end>>: neighbouring vertices of each line and ring; a point is an edge from itself to itself."""
    if not t.serialized:
        return native.edges(c, t)
    same = lambda n: F.transform(n["coords"], lambda p: F.struct(p.alias("start"), p.alias("end")))
    none = F.array().cast(native._edge_type(_XYZM_LINE))
    pairs = lambda s: F.when(F.size(s) < 2, none).otherwise(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end"))))
    return F.flatten(F.transform(nodes(c, t), lambda n: F.when(n["gtype"] == G.POINT, same(n)).otherwise(pairs(n["coords"]))))


def num_coords(c, t: G.GeometryType) -> Column:
    return F.aggregate(nodes(c, t), F.lit(0), lambda a, n: a + F.size(n["coords"])) if t.serialized else native.num_coords(c, t)


def mean_coord(c, t: G.GeometryType) -> Column:
    """Unweighted mean of a geometry's coordinates: of text and binary as x, y, z, m."""
    return native.mean_coord(coords(c, t), _XYZM_LINE) if t.serialized else native.mean_coord(c, t)


# ---- the structure of text and binary geometries ------------------------------------------------------------------------------


def structure(c, t: G.GeometryType) -> Column:
    """struct<geometry, dims, srid, num_sequences, num_geometries> of the outermost geometry.

    Sequences are a point's or line's own coordinates and a polygon's rings; geometries are the members of all others.  A column of
    sequence sizes comes from sequence_size(), members from member().
    """
    ir = codec.to_ir(_c(c), t)
    first = ir["nodes"][0]
    own = F.when(first["gtype"] == G.POLYGON, first["size"]).when(first["gtype"].isin(G.POINT, G.LINESTRING), F.lit(1)).otherwise(F.lit(0))
    members = F.when(first["gtype"] >= G.MULTIPOINT, first["size"]).otherwise(F.lit(0))
    return F.when(ir.isNotNull(), F.struct(ir["gtype"].alias("geometry"), ir["dims"].alias("dims"), ir["srid"].alias("srid"), own.alias("num_sequences"), members.alias("num_geometries")))


def sequence_size(c, t: G.GeometryType, i: int) -> Column:
    """Coordinates of the ``i``-th sequence (from 0) of a point, line or polygon; null if there is none."""
    ns = nodes(c, t)
    first = F.get(ns, F.lit(0))
    return F.when(first["gtype"] == G.POLYGON, F.size(F.get(ns, F.lit(i + 1))["coords"])).when(first["gtype"].isin(G.POINT, G.LINESTRING) & F.lit(i == 0), F.size(first["coords"]))


def members(c, t: G.GeometryType) -> Column:
    """array<struct<geometry, dims, size>> of the members of a multi geometry or collection, in order; empty for all others."""
    ns = nodes(c, t)
    inner = F.transform(F.filter(ns, lambda n: n["level"] == 1), lambda n: F.struct(n["gtype"].alias("geometry"), n["dims"].alias("dims"), n["size"].alias("size")))
    # The rings of a polygon are no members.
    return F.when(F.get(ns, F.lit(0))["gtype"] == G.POLYGON, F.array().cast("array<struct<geometry:int,dims:int,size:int>>")).otherwise(inner)


def unique_geometry_types_agg(c, t: G.GeometryType) -> Column:
    return native.unique_types(codec.type_code(_c(c), t) if t.serialized else native.type_code(c, t))


KERNELS: dict[str, Callable[..., Column]] = {
    "void": void,
    "void_agg": void_agg,
    "visit_void_agg": visit_void_agg,
    "format_wkt": format_wkt,
    "as_type": as_type,
    "as_wkt": as_wkt,
    "as_wkb": as_wkb,
    "unique_geometry_types_agg": unique_geometry_types_agg,
    "box": box,
    "box_agg": box_agg,
    "vertices": vertices,
    "edges": edges,
    "num_coords": num_coords,
    "mean_coord": mean_coord,
    "structure": structure,
    "sequence_size": sequence_size,
    "members": members,
}


def kernel(name: str) -> Callable[..., Column]:
    if name not in KERNELS:
        raise NotImplementedError(f"no operator is named {name!r}")
    return KERNELS[name]


def overload(name: str, t: G.GeometryType) -> Callable[..., Column] | None:
    """The operator for columns of type ``t``, or None if it does not apply to these."""
    fn = kernel(name)
    fits = {"structure": t.serialized, "sequence_size": t.serialized, "members": t.serialized, "edges": t.geometry != G.BOX, "vertices": t.geometry != G.BOX, "num_coords": t.geometry != G.BOX, "mean_coord": t.geometry != G.BOX}
    planar = name not in ("box", "box_agg") or t.metadata.edges == "planar"
    return (lambda c, *args, **kw: fn(c, t, *args, **kw)) if fits.get(name, True) and planar else None


_TEXT, _RAW = G.GeometryType(G.WKT), G.GeometryType(G.WKB)
_IN = {"wkt": _TEXT, "wkb": _RAW}


def _scalars() -> dict[str, tuple[Callable, T.DataType]]:
    """SQL functions: what each does with the values of a batch, and what it returns."""
    box_type = G.GeometryType.make(G.BOX).spark_type()
    out: dict[str, tuple[Callable, T.DataType]] = {"void": (lambda v: None, T.StringType())}
    for name, t in _IN.items():
        read = codec.reader(t)

        def error(v, read=read):
            try:
                read(v)
            except ValueError as e:
                return str(e)
            return None

        out[f"{name}_valid"] = (lambda v, e=error: e(v) is None, T.BooleanType())
        out[f"{name}_error"] = (error, T.StringType())
        out[f"{name}_type_code"] = (lambda v, read=read: codec.tr.first_code(read(v)), T.IntegerType())
        out[f"{name}_box"] = (lambda v, read=read: codec.box_of(read(v)), box_type)
        for other, to in _IN.items():
            if other != name:
                out[f"{name}_to_{other}"] = (lambda v, read=read, write=codec.writer(to): write(read(v)), to.spark_type())
    return out


def register_all(spark: SparkSession, prefix: str = "geo_") -> list[str]:
    """SQL functions over text (wkt_) and binary (wkb_) columns.

    wkt_to_wkb, wkb_to_wkt, .._valid, .._error, .._type_code, .._box (struct<xmin, ymin, xmax, ymax>), .._format(g, precision,
    max_bytes), .._as_type(g, type id) as text, and void.  The aggregates are spelt by sql().
    """
    made = {name: F.udf(lambda v, fn=fn: None if v is None else fn(v), returns, useArrow=True) for name, (fn, returns) in _scalars().items()}
    for name, t in _IN.items():
        read = codec.reader(t)

        def formatted(v, precision, most, read=read):
            if v is None:
                return None
            text = codec.tr.format_wkt(read(v), 16 if precision is None else precision)
            return text[:most] if most and most > 0 else text

        def as_type_text(v, to, read=read):
            if v is None or to is None:
                return None
            t = G.GeometryType(int(to))
            tree = read(v)
            return codec.tr.format_wkt(tree if t.serialized else codec.tr.from_native(codec.tr.cast_lenient(tree, t.geometry, t.dims), t.geometry, t.dims))

        made[f"{name}_format"] = F.udf(formatted, T.StringType(), useArrow=True)
        made[f"{name}_as_type"] = F.udf(as_type_text, T.StringType(), useArrow=True)
    for name, fn in made.items():
        spark.udf.register(prefix + name, fn)
    return [prefix + n for n in made]


def _box_agg_sql(prefix: str, name: str, x: str) -> str:
    side = lambda n, s: f"coalesce({s}({prefix}{name}_box({x}).{n}{s}), double('{'' if s == 'min' else '-'}infinity'))"
    return "named_struct(" + ", ".join(f"'{n}{s}', {side(n, s)}" for s in ("min", "max") for n in "xy") + ")"


def _unique_sql(prefix: str, name: str, x: str) -> str:
    return f"array_sort(collect_set({prefix}{name}_type_code({x})))"  # 28 codes at most


_AGGREGATES = {"box_agg": _box_agg_sql, "unique_geometry_types_agg": _unique_sql}


def sql(spark: SparkSession, query: str, prefix: str = "geo_") -> DataFrame:
    """``query`` with the aggregates geo_wkt_box_agg(x), geo_wkb_box_agg(x), geo_.._unique_geometry_types_agg(x), geo_.._visit_void_agg(x), geo_void_agg(x) spelt out."""
    call = re.compile(rf"\b{re.escape(prefix)}(?:(wkt|wkb)_(box_agg|unique_geometry_types_agg|visit_void_agg)|void_agg)\s*\(", re.I)
    while m := call.search(query):
        depth, quote, end = 1, "", m.end()
        while end < len(query) and depth:
            c = query[end]
            if quote:
                quote = "" if c == quote else quote
            elif c in "'\"`":
                quote = c
            else:
                depth += (c == "(") - (c == ")")
            end += 1
        if depth:
            raise ValueError(f"{m[0]} is not closed")
        x = query[m.end() : end - 1]
        if m[1] is None:
            said = "max(cast(null as int))"
        elif m[2].lower() == "visit_void_agg":
            message = f"min({prefix}{m[1].lower()}_error({x}))"
            said = f"case when {message} is not null then cast(raise_error({message}) as int) end"
        else:
            said = _AGGREGATES[m[2].lower()](prefix, m[1].lower(), x)
        query = query[: m.start()] + said + query[end:]
    return spark.sql(query)
