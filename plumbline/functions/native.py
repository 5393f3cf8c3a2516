"""Native geometry columns, in Spark's own expressions only.

``t`` is the column's GeometryType, since Spark's type does not tell a line from a multipoint.  All work on streams and in groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as G

INF = float("inf")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def point(x, y, z=None, m=None) -> Column:
    """Separate point of the ordinates given."""
    return F.struct(*[_col(c).cast("double").alias(n) for n, c in zip("xyzm", (x, y, z, m), strict=True) if c is not None])


def line(order: list[str], *ordinates: str, names: str = "xy") -> Column:
    """Aggregate: the coordinates of a group as a line, in the order of ``order``."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[F.col(c).cast("double").alias(f"_{n}") for n, c in zip(names, ordinates, strict=True)])))
    return F.transform(rows, lambda r: F.struct(*[r[f"_{n}"].alias(n) for n in names]))


def build(df: DataFrame, t: G.GeometryType, by: list[str], parts: list[str], order: list[str], *ordinates: str, name: str = "geometry") -> DataFrame:
    """Geometries of type ``t`` from rows of vertices: one for each group ``by``.

    ``parts`` name the levels within it, from the outside (for a polygon its rings, for a multipolygon polygons and rings); parts are in
    the order of their values, vertices in that of ``order``.  Each level is one aggregation by what is left of the keys.
    """
    if t.serialized or t.geometry == G.BOX or len(parts) != max(0, G.DEPTH[t.geometry] - 1):
        raise ValueError(f"{t} is not built from {len(parts)} levels of parts")
    if len(ordinates) != len(G.DIM_NAMES[t.dims]):
        raise ValueError(f"Expected {len(G.DIM_NAMES[t.dims])} ordinates")
    made = df.groupBy(*by, *parts).agg(line(order, *ordinates, names=G.DIM_NAMES[t.dims]).alias("_g"))
    for k in range(len(parts), 0, -1):
        made = made.groupBy(*by, *parts[: k - 1]).agg(F.array_sort(F.collect_list(F.struct(parts[k - 1], "_g")))["_g"].alias("_g"))
    if t.geometry == G.POINT:
        made = made.withColumn("_g", F.when(F.size("_g") <= 1, F.get("_g", F.lit(0))).otherwise(F.raise_error(F.lit("a point has one vertex")).cast(t.with_coords(G.SEPARATE).spark_type())))
    return made.select(*by, cast_coords("_g", t.with_coords(G.SEPARATE), t.coords).alias(name, metadata=t.field_metadata()))


def coords(c, t: G.GeometryType) -> Column:
    """All coordinates of a geometry as one array."""
    c = _col(c)
    depth = G.DEPTH[t.geometry]
    if depth == 0:
        return F.array(c)
    for _ in range(depth - 1):
        c = F.flatten(c)
    return c


def num_coords(c, t: G.GeometryType) -> Column:
    c = _col(c)
    return F.when(c.isNotNull(), F.size(coords(c, t)))


def ordinate(c, t: G.GeometryType, name: str) -> Column:
    """One ordinate of all coordinates; an absent dimension has none. Only this leaf is read from Parquet if coordinates are separate."""
    names = G.DIM_NAMES[t.dims]
    if name not in names:
        return F.array().cast("array<double>")
    cs = coords(c, t)
    return cs[name] if t.coords == G.SEPARATE and G.DEPTH[t.geometry] else F.transform(cs, (lambda p: p[name]) if t.coords == G.SEPARATE else (lambda p: p[names.index(name)]))


def _least(values: Column, low: bool) -> Column:
    real = F.filter(values, lambda v: ~F.isnan(v))
    return F.coalesce(F.array_min(real) if low else F.array_max(real), F.lit(INF if low else -INF))


def _planar(t: G.GeometryType) -> None:
    if t.metadata.edges != "planar":
        raise ValueError("box kernel does not support non-planar edges")


def box(c, t: G.GeometryType, dims: int = G.XY) -> Column:
    """Bounds of each geometry. NaN never counts; an empty geometry gives (inf, .., -inf, ..), a null one null. CRS goes along."""
    _planar(t)
    c = _col(c)
    names = G.DIM_NAMES[dims]
    if t.geometry == G.BOX:
        values = {n + s: (c[n + s] if n in G.DIM_NAMES[t.dims] else F.lit(INF if s == "min" else -INF)) for s in ("min", "max") for n in names}
    else:
        values = {n + s: _least(ordinate(c, t, n), s == "min") for s in ("min", "max") for n in names}
    meta = G.GeometryType.make(G.BOX, dims, metadata=t.metadata)
    return F.when(c.isNotNull(), F.struct(*[v.alias(k) for k, v in values.items()])).alias("box", metadata=meta.field_metadata())


def box_agg(b, dims: int = G.XY) -> Column:
    """Union of boxes, in each group; nulls count as empty, and the result is never null."""
    b = _col(b)
    # NaN sorts above all numbers in Spark; a box never has one, but a hand-made one might.
    side = lambda n, s: F.coalesce((F.min if s == "min" else F.max)(F.when(~F.isnan(b[n + s]), b[n + s])), F.lit(INF if s == "min" else -INF))
    return F.struct(*[side(n, s).alias(n + s) for s in ("min", "max") for n in G.DIM_NAMES[dims]])


def box_to_polygon(b, t: G.GeometryType | None = None) -> Column:
    """Closed ring of five vertices; no ring where a minimum is above its maximum.  A box of other dimensions than XY is refused."""
    if t is not None and (t.geometry != G.BOX or t.dims != G.XY):
        raise ValueError("only XY boxes are polygons")
    b = _col(b)
    p = lambda x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    ring = F.array(p("xmin", "ymin"), p("xmax", "ymin"), p("xmax", "ymax"), p("xmin", "ymax"), p("xmin", "ymin"))
    return F.when(b.isNotNull(), F.when((b["xmin"] > b["xmax"]) | (b["ymin"] > b["ymax"]), F.array().cast("array<array<struct<x:double,y:double>>>")).otherwise(F.array(ring)))


def empty_box(dims: int = G.XY) -> Column:
    """The box of nothing: from infinity to minus infinity in each dimension."""
    return F.struct(*[F.lit(INF if s == "min" else -INF).alias(n + s) for s in ("min", "max") for n in G.DIM_NAMES[dims]])


def box_side(b, t: G.GeometryType, side: str) -> Column:
    """xmin, ymin, zmin, mmin, xmax, .. of a box; infinity, or minus infinity, in a dimension it lacks."""
    if side[:-3] not in tuple("xyzm") or side[-3:] not in ("min", "max"):
        raise ValueError(f"a box has no side {side!r}")
    b = _col(b)
    return b[side] if side[0] in G.DIM_NAMES[t.dims] else F.when(b.isNotNull(), F.lit(INF if side.endswith("min") else -INF))


def is_empty_box(b, t: G.GeometryType) -> Column:
    """Whether a minimum is above its maximum in any dimension the box has."""
    b, empty = _col(b), F.lit(False)
    for n in G.DIM_NAMES[t.dims]:
        empty = empty | (b[n + "min"] > b[n + "max"])
    return empty


def lower_bound(b, dims: int = G.XY) -> Column:
    return F.struct(*[_col(b)[n + "min"].alias(n) for n in G.DIM_NAMES[dims]])


def upper_bound(b, dims: int = G.XY) -> Column:
    return F.struct(*[_col(b)[n + "max"].alias(n) for n in G.DIM_NAMES[dims]])


def type_code(c, t: G.GeometryType) -> Column:
    """ISO code of a geometry with at least one coordinate, else null; a box is a polygon."""
    c = _col(c)
    if t.geometry == G.BOX:
        return F.when(c.isNotNull() & (c["xmin"] <= c["xmax"]) & (c["ymin"] <= c["ymax"]), F.lit(G.POLYGON))
    return F.when(F.size(coords(c, t)) > 0, F.lit(t.geometry + (t.dims - 1) * 1000)) if G.DEPTH[t.geometry] else F.when(c.isNotNull(), F.lit(t.geometry + (t.dims - 1) * 1000))


def unique_types(code) -> Column:
    """Aggregate: the distinct codes, ascending. State is one long however many rows there are."""
    code = _col(code)
    bit = (F.floor(code / 1000) * 8 + code % 1000).cast("int")
    mask = F.coalesce(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)), F.lit(0).cast("long"))
    # Spelt out, since lambdas may not see a code that Python made.
    return F.array_compact(F.array(*[F.when(F.getbit(mask, F.lit(i)) == 1, F.lit(i // 8 * 1000 + i % 8)) for i in range(32)]))


def vertices(c, t: G.GeometryType) -> Column:
    """Generator: one row for each coordinate, with its place."""
    return F.posexplode(coords(c, t))


def sequences(c, t: G.GeometryType) -> Column:
    """Lines and rings as array<array<coordinate>>; points are sequences of one."""
    c = _col(c)
    if t.geometry in (G.POLYGON, G.MULTILINESTRING):
        return c
    if t.geometry == G.MULTIPOLYGON:
        return F.flatten(c)
    return F.array(c) if t.geometry == G.LINESTRING else F.transform(coords(c, t), lambda p: F.array(p))


def edges(c, t: G.GeometryType) -> Column:
    """array<struct<start, end>>: neighbouring vertices of each sequence; a point is an edge from itself to itself."""
    c = _col(c)
    if t.geometry in (G.POINT, G.MULTIPOINT):
        return F.transform(coords(c, t), lambda p: F.struct(p.alias("start"), p.alias("end")))
    pairs = lambda s: F.when(F.size(s) < 2, F.array().cast(_edge_type(t))).otherwise(F.zip_with(F.slice(s, 1, F.size(s) - 1), F.slice(s, 2, F.size(s) - 1), lambda a, b: F.struct(a.alias("start"), b.alias("end"))))
    return F.flatten(F.transform(sequences(c, t), pairs))


def _edge_type(t: G.GeometryType) -> T.ArrayType:
    p = G.GeometryType.make(G.POINT, t.dims, t.coords).spark_type()
    return T.ArrayType(T.StructType([T.StructField("start", p), T.StructField("end", p)]))


def slice_coords(c, offset: int, length: int) -> Column:
    """Items ``offset`` to ``offset + length`` of the outermost level: vertices of a line, rings, lines or polygons of the others."""
    return F.slice(_col(c), offset + 1, length)


def slice_rows(df: DataFrame, order: list[str], offset: int, length: int) -> DataFrame:
    """Rows ``offset`` to ``offset + length`` in the order of ``order``: the slice of a whole column."""
    return df.orderBy(*order).offset(offset).limit(length)


def _map_coords(c: Column, depth: int, fn) -> Column:
    return fn(c) if depth == 0 else F.transform(c, lambda x: _map_coords(x, depth - 1, fn))


def cast_dims(c, t: G.GeometryType, dims: int) -> Column:
    """Other dimensions: what the target lacks goes, what the source lacks is NaN; Z and M never mix."""
    have, want = G.DIM_NAMES[t.dims], G.DIM_NAMES[dims]
    if t.coords == G.SEPARATE:
        fn = lambda p: F.struct(*[(p[n] if n in have else F.lit(float("nan"))).alias(n) for n in want])
    else:
        fn = lambda p: F.array(*[p[have.index(n)] if n in have else F.lit(float("nan")) for n in want])
    out = t.with_dims(dims)
    c = _col(c)
    return F.when(c.isNotNull(), _map_coords(c, G.DEPTH[t.geometry], fn)).alias("geometry", metadata=out.field_metadata())


def cast_coords(c, t: G.GeometryType, layout: int) -> Column:
    """Separate to interleaved coordinates or back."""
    names = G.DIM_NAMES[t.dims]
    if layout == t.coords:
        return _col(c)
    fn = (lambda p: F.array(*[p[n] for n in names])) if layout == G.INTERLEAVED else (lambda p: F.struct(*[p[i].alias(n) for i, n in enumerate(names)]))
    c = _col(c)
    return F.when(c.isNotNull(), _map_coords(c, G.DEPTH[t.geometry], fn)).alias("geometry", metadata=t.with_coords(layout).field_metadata())


def check_interleaved(c, t: G.GeometryType) -> Column:
    """``c``, or a failing query where a coordinate has the wrong number of ordinates (Spark has no fixed-size arrays)."""
    n = len(G.DIM_NAMES[t.dims])
    c = _col(c)
    return F.when(F.forall(coords(c, t), lambda p: F.size(p) == n) | c.isNull(), c).otherwise(F.raise_error(F.lit(f"Expected {n} ordinates")).cast(t.spark_type()))


def mean_coord(c, t: G.GeometryType) -> Column:
    """Aggregate over exploded vertices is avg(); this is the unweighted mean of one geometry's own coordinates."""
    n = F.size(coords(c, t))
    return F.struct(*[F.when(n > 0, F.aggregate(ordinate(c, t, d), F.lit(0.0), lambda a, v: a + v) / n).alias(d) for d in G.DIM_NAMES[t.dims]])
