"""Geometry columns in and out of tables: types from field metadata, Parquet with boxes beside, Arrow with extension metadata."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import types as G
from ..operators import kernels


def geometry_type(df: DataFrame, column: str) -> G.GeometryType:
    return G.GeometryType.of(df.schema[column])


def with_type(df: DataFrame, column: str, t: G.GeometryType) -> DataFrame:
    """The column with its type in its metadata (most expressions lose it); its Spark type is checked."""
    out = df.withColumn(column, F.col(column).alias(column, metadata=t.field_metadata()))
    geometry_type(out, column)
    return out


def read(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A table; field metadata comes back from Parquet with it."""
    return spark.read.format(fmt).load(path)


def write(df: DataFrame, path: str, column: str, box_column: str | None = "bbox", mode: str = "errorifexists") -> None:
    """Parquet with each geometry's box beside it, so filters on bounds reach the scan and skip row groups."""
    if box_column:
        df = df.withColumn(box_column, kernels.box(column, geometry_type(df, column)))
    df.write.mode(mode).parquet(path)


def in_window(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float, box_column: str = "bbox") -> DataFrame:
    """Rows whose box meets a window: comparisons of struct fields, which Parquet scans evaluate."""
    b = F.col(box_column)
    return df.where((b["xmin"] <= xmax) & (b["xmax"] >= xmin) & (b["ymin"] <= ymax) & (b["ymax"] >= ymin))


_LEVELS = {G.LINESTRING: ["vertices"], G.MULTIPOINT: ["points"], G.POLYGON: ["rings", "vertices"], G.MULTILINESTRING: ["linestrings", "vertices"], G.MULTIPOLYGON: ["polygons", "rings", "vertices"], G.POINT: []}


def arrow_type(t: G.GeometryType) -> pa.DataType:
    """Arrow storage with the child names and widths that Spark does not keep."""
    if t.id in G.TEXT:
        return pa.string()
    if t.id in G.BINARY:
        return pa.binary()
    names = G.DIM_NAMES[t.dims]
    if t.geometry == G.BOX:
        return pa.struct([pa.field(n + s, pa.float64(), False) for s in ("min", "max") for n in names])
    out: pa.DataType = pa.struct([pa.field(n, pa.float64(), False) for n in names]) if t.coords == G.SEPARATE else pa.list_(pa.field(names, pa.float64(), False), len(names))
    for level in reversed(_LEVELS[t.geometry]):
        out = pa.list_(pa.field(level, out, False))
    return out


def _as_storage(col: pa.Array, to: pa.DataType) -> pa.Array:
    """``col`` with the names, widths and nullability of ``to``: the same buffers, level by level."""
    mask = col.is_null() if col.null_count else None
    if isinstance(to, pa.StructType):
        # Ordinates below a null are null too; the storage type has none such.
        return pa.StructArray.from_arrays([col.field(k).fill_null(float("nan")) for k in range(to.num_fields)], fields=list(to), mask=mask)
    if isinstance(to, pa.FixedSizeListType):
        # A null has no ordinates here and as many as any other there.
        if mask is not None:
            col = col.fill_null([float("nan")] * to.list_size)
        flat = col.flatten()
        if len(flat) != to.list_size * len(col):
            raise ValueError(f"Expected {to.list_size} ordinates")
        return pa.FixedSizeListArray.from_arrays(flat, type=to, mask=mask)
    if isinstance(to, pa.ListType):
        offs = col.offsets
        first = offs[0].as_py()
        values = _as_storage(col.values.slice(first, offs[-1].as_py() - first), to.value_type)
        return pa.ListArray.from_arrays(pc.subtract(offs, pa.scalar(first, pa.int32())), values, type=to, mask=mask)
    return col.cast(to)


def _nullable(t: T.DataType) -> T.DataType:
    if isinstance(t, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType)) for f in t.fields])
    return T.ArrayType(_nullable(t.elementType)) if isinstance(t, T.ArrayType) else t


def to_arrow(df: DataFrame, extension_prefix: str) -> pa.Table:
    """All rows as an Arrow table whose geometry fields carry extension name (prefix + name) and metadata."""
    # Spark's own export takes no null above a field that may not be null.
    table = df.select(*[F.col(f.name).cast(_nullable(f.dataType)).alias(f.name) if G.TYPE_KEY in f.metadata else F.col(f.name) for f in df.schema.fields]).toArrow()
    fields, cols = [], []
    for f in df.schema.fields:
        col = table[f.name]
        if G.TYPE_KEY in f.metadata:
            t = G.GeometryType.of(f)
            meta = {"ARROW:extension:name": extension_prefix + t.name, "ARROW:extension:metadata": t.metadata.serialize()}
            fields.append(pa.field(f.name, arrow_type(t), True, meta))
            cols.append(pa.chunked_array([_as_storage(pa.concat_arrays([c]), arrow_type(t)) for c in col.chunks], arrow_type(t)))
        else:
            fields.append(table.schema.field(f.name))
            cols.append(col)
    return pa.Table.from_arrays(cols, schema=pa.schema(fields))


def from_arrow(spark: SparkSession, table: pa.Table, extension_prefix: str) -> DataFrame:
    """A DataFrame of an Arrow table, with extension metadata turned into field metadata."""
    df = spark.createDataFrame(table)
    names = {t.name: t for t in map(G.GeometryType, (G.WKT, G.WKB))}
    for f in table.schema:
        meta = {k.decode(): v.decode() for k, v in (f.metadata or {}).items()}
        name = meta.get("ARROW:extension:name", "")
        if not name.startswith(extension_prefix) or not name:
            continue
        name = name[len(extension_prefix) :]
        if name in names:
            t = names[name]
        else:
            inner, levels = f.type, 0
            while isinstance(inner, (pa.ListType, pa.LargeListType)):
                inner, levels = inner.value_type, levels + 1
            geometry = next(g for g, n in G.GEOMETRY_NAMES.items() if n.lower() == name)
            fixed = isinstance(inner, pa.FixedSizeListType)
            spelt = inner.value_field.name if fixed else "".join(x.name for x in inner)
            if fixed and spelt not in G.DIM_NAMES.values():
                spelt = {2: "xy", 3: "xyz", 4: "xyzm"}[inner.list_size]
            if geometry == G.BOX:
                spelt = "".join(x.name[0] for x in list(inner)[: inner.num_fields // 2])
            dims = next((d for d, n in G.DIM_NAMES.items() if n == spelt), None)
            if dims is None:
                raise ValueError(f"Expected dimensions xy, xyz, xym or xyzm but found '{spelt}'")
            t = G.GeometryType.make(geometry, dims, G.INTERLEAVED if fixed else G.SEPARATE)
        t = G.GeometryType(t.id, G.Metadata.parse(meta.get("ARROW:extension:metadata")))
        df = df.withColumn(f.name, F.col(f.name).alias(f.name, metadata=t.field_metadata()))
    return df
