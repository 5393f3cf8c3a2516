"""Geometry types, their metadata, and how both lie in Spark fields.

A geometry is an ordinary column: text, binary, a struct of ordinates, nested arrays of these, or a box.  What Spark's type does not
say (line or multipoint, Z or M, coordinate reference system, edges) is JSON in the field's metadata.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import types as T

GEOMETRY, POINT, LINESTRING, POLYGON, MULTIPOINT, MULTILINESTRING, MULTIPOLYGON, GEOMETRYCOLLECTION, BOX = 0, 1, 2, 3, 4, 5, 6, 7, 990
XY, XYZ, XYM, XYZM = 1, 2, 3, 4
SEPARATE, INTERLEAVED = 1, 2
#: Serialized layouts, by id.
WKB, LARGE_WKB, WKT, LARGE_WKT, WKB_VIEW, WKT_VIEW = 100001, 100002, 100003, 100004, 100005, 100006
GEOMETRY_NAMES = {GEOMETRY: "GEOMETRY", POINT: "POINT", LINESTRING: "LINESTRING", POLYGON: "POLYGON", MULTIPOINT: "MULTIPOINT", MULTILINESTRING: "MULTILINESTRING", MULTIPOLYGON: "MULTIPOLYGON", GEOMETRYCOLLECTION: "GEOMETRYCOLLECTION", BOX: "BOX"}
DIM_NAMES = {XY: "xy", XYZ: "xyz", XYM: "xym", XYZM: "xyzm"}
EDGE_TYPES = ("planar", "spherical", "vincenty", "thomas", "andoyer", "karney")
CRS_TYPES = ("none", "unknown", "projjson", "wkt2:2019", "authority_code", "srid")
#: Levels of arrays around the point.
DEPTH = {POINT: 0, LINESTRING: 1, MULTIPOINT: 1, POLYGON: 2, MULTILINESTRING: 2, MULTIPOLYGON: 3}
TEXT, BINARY = {WKT, LARGE_WKT, WKT_VIEW}, {WKB, LARGE_WKB, WKB_VIEW}
#: Where a field's metadata has the type id and the CRS and edges.
TYPE_KEY, META_KEY = "geometry_type", "geometry_metadata"


def type_id(geometry: int, dims: int = XY, coords: int = SEPARATE) -> int:
    if geometry == BOX and coords != SEPARATE:
        raise ValueError("boxes have separate coordinates only")
    if geometry != BOX and geometry not in DEPTH:
        raise ValueError(f"no native layout for {GEOMETRY_NAMES.get(geometry, geometry)}")
    return (dims - 1) * 1000 + (coords - 1) * 10000 + geometry


def split_id(i: int) -> tuple[int, int, int]:
    """(geometry, dims, coords) of a type id; zeros of a serialized one."""
    if i in TEXT | BINARY:
        return 0, 0, 0
    coords, rest = divmod(i, 10000)
    dims, geometry = divmod(rest, 1000)
    if geometry not in DEPTH and geometry != BOX or not 0 <= dims <= 3 or not 0 <= coords <= 1 or geometry == BOX and coords:
        raise ValueError(f"{i} is no geometry type id")
    return geometry, dims + 1, coords + 1


def all_type_ids() -> list[int]:
    native = [type_id(g, d, c) for c in (SEPARATE, INTERLEAVED) for d in DIM_NAMES for g in DEPTH]
    return sorted([*native, *(type_id(BOX, d) for d in DIM_NAMES), *TEXT, *BINARY])


#: Longitude and latitude on WGS 84, as the registry that all implementations share spells it in PROJJSON.
LON_LAT = {
    "type": "GeographicCRS",
    "name": "WGS 84 (CRS84)",
    "datum_ensemble": {
        "name": "World Geodetic System 1984 ensemble",
        "members": [
            {"name": "World Geodetic System 1984 (Transit)", "id": {"authority": "EPSG", "code": 1166}},
            {"name": "World Geodetic System 1984 (G730)", "id": {"authority": "EPSG", "code": 1152}},
            {"name": "World Geodetic System 1984 (G873)", "id": {"authority": "EPSG", "code": 1153}},
            {"name": "World Geodetic System 1984 (G1150)", "id": {"authority": "EPSG", "code": 1154}},
            {"name": "World Geodetic System 1984 (G1674)", "id": {"authority": "EPSG", "code": 1155}},
            {"name": "World Geodetic System 1984 (G1762)", "id": {"authority": "EPSG", "code": 1156}},
            {"name": "World Geodetic System 1984 (G2139)", "id": {"authority": "EPSG", "code": 1309}},
        ],
        "ellipsoid": {"name": "WGS 84", "semi_major_axis": 6378137, "inverse_flattening": 298.257223563},
        "accuracy": "2.0",
        "id": {"authority": "EPSG", "code": 6326},
    },
    "coordinate_system": {
        "subtype": "ellipsoidal",
        "axis": [
            {"name": "Geodetic longitude", "abbreviation": "Lon", "direction": "east", "unit": "degree"},
            {"name": "Geodetic latitude", "abbreviation": "Lat", "direction": "north", "unit": "degree"},
        ],
    },
    "scope": "Not known.",
    "area": "World.",
    "bbox": {"south_latitude": -90, "west_longitude": -180, "north_latitude": 90, "east_longitude": 180},
    "id": {"authority": "OGC", "code": "CRS84"},
}
_BLANK = " \t\r\n"


def _members(text: str) -> list[tuple[str, object, str]]:
    """(key, value, the value's own text) of each member of a JSON object, in order."""
    decoder, out, i = json.JSONDecoder(), [], 0
    bad = ValueError(f"Expected valid JSON metadata but got '{text}'")

    def blank(i: int) -> int:
        while i < len(text) and text[i] in _BLANK:
            i += 1
        return i

    def mark(i: int, marks: str) -> tuple[str, int]:
        i = blank(i)
        if text[i : i + 1] not in tuple(marks):
            raise bad
        return text[i], blank(i + 1)

    _, i = mark(i, "{")
    after = "}" if text[i : i + 1] == "}" else ","
    if after == "}":
        i += 1
    while after == ",":
        try:
            key, i = decoder.raw_decode(text, i)
            _, i = mark(i, ":")
            value, end = decoder.raw_decode(text, i)
        except ValueError:
            raise bad from None
        if not isinstance(key, str):
            raise bad
        out.append((key, value, text[i:end]))
        after, i = mark(end, ",}")
    if rest := text[blank(i) :]:
        raise ValueError(f"Expected JSON object with no trailing characters but found trailing '{rest}'")
    return out


@dataclass(frozen=True)
class Metadata:
    """Edges and coordinate reference system. ``crs`` is a parsed JSON object, a string, or None; ``crs_text`` is its JSON as it was read."""

    edges: str = "planar"
    crs: object = None
    crs_type: str = "none"
    crs_text: str | None = field(default=None, compare=False)

    @staticmethod
    def parse(text: str | None) -> Metadata:
        """Keys but edges, crs and crs_type are passed over; no value may be a number or a boolean."""
        if not text:
            return Metadata()
        members = _members(text)
        for _, value, said in members:
            if isinstance(value, (bool, int, float)):
                raise ValueError(f"Expected valid JSON metadata but got '{text}': {said} is no string, object, list or null")
        raw, texts = {k: v for k, v, _ in members}, {k: said for k, _, said in members}
        edges, crs, kind = raw.get("edges"), raw.get("crs"), raw.get("crs_type")
        if edges is not None and edges not in EDGE_TYPES:
            raise ValueError(f"Unsupported value for edges: {edges!r}")
        if crs is not None and not isinstance(crs, (dict, str)):
            raise ValueError("Unsupported type for crs")
        if "crs_type" in raw and not isinstance(kind, str):
            raise ValueError("Unsupported type for crs_type")
        kind = "none" if crs is None else kind if kind in CRS_TYPES else "unknown"
        return Metadata(edges or "planar", crs, kind, texts["crs"] if crs is not None else None)

    def serialize(self) -> str:
        out = []
        if self.edges != "planar":
            out.append(f'"edges":{json.dumps(self.edges)}')
        if self.crs_type not in ("none", "unknown"):
            out.append(f'"crs_type":{json.dumps(self.crs_type)}')
        if self.crs is not None:
            out.append(f'"crs":{self.crs_text or json.dumps(self.crs, separators=(",", ":"), ensure_ascii=False)}')
        return "{" + ",".join(out) + "}"

    @staticmethod
    def lon_lat() -> Metadata:
        return Metadata(crs=LON_LAT, crs_type="projjson")


@dataclass(frozen=True)
class GeometryType:
    """One of the 58 types, with metadata; its with_* methods give changed copies."""

    id: int
    metadata: Metadata = Metadata()

    def __post_init__(self):
        split_id(self.id)

    @staticmethod
    def make(geometry: int, dims: int = XY, coords: int = SEPARATE, metadata: Metadata = Metadata()) -> GeometryType:
        return GeometryType(type_id(geometry, dims, coords), metadata)

    @property
    def geometry(self) -> int:
        return split_id(self.id)[0]

    @property
    def dims(self) -> int:
        return split_id(self.id)[1]

    @property
    def coords(self) -> int:
        return split_id(self.id)[2]

    @property
    def serialized(self) -> bool:
        return self.id in TEXT | BINARY

    def with_geometry(self, geometry: int) -> GeometryType:
        return GeometryType.make(geometry, self.dims or XY, SEPARATE if geometry == BOX else self.coords or SEPARATE, self.metadata)

    def with_dims(self, dims: int) -> GeometryType:
        return GeometryType.make(self.geometry, dims, self.coords, self.metadata)

    def with_coords(self, coords: int) -> GeometryType:
        return GeometryType.make(self.geometry, self.dims, coords, self.metadata)

    def with_edges(self, edges: str) -> GeometryType:
        if edges not in EDGE_TYPES:
            raise ValueError(f"Unsupported value for edges: {edges!r}")
        return replace(self, metadata=replace(self.metadata, edges=edges))

    def with_crs(self, crs, crs_type: str = "unknown") -> GeometryType:
        return replace(self, metadata=replace(self.metadata, crs=crs, crs_type="none" if crs is None else crs_type, crs_text=None))

    def with_crs_lon_lat(self) -> GeometryType:
        return replace(self, metadata=replace(Metadata.lon_lat(), edges=self.metadata.edges))

    def simple(self) -> GeometryType:
        return self.with_geometry({MULTIPOINT: POINT, MULTILINESTRING: LINESTRING, MULTIPOLYGON: POLYGON}.get(self.geometry, self.geometry))

    def multi(self) -> GeometryType:
        return self.with_geometry({POINT: MULTIPOINT, LINESTRING: MULTILINESTRING, POLYGON: MULTIPOLYGON}.get(self.geometry, self.geometry))

    @property
    def name(self) -> str:
        return "wkt" if self.id in TEXT else "wkb" if self.id in BINARY else GEOMETRY_NAMES[self.geometry].lower()

    def __str__(self) -> str:
        crs = "" if self.metadata.crs is None else str(self.metadata.crs)
        tail = f"<{self.metadata.crs_type}: {crs[:40]}{'...' if len(crs) > 40 else ''}>" if crs else ""
        head = "" if self.metadata.edges == "planar" else self.metadata.edges + " "
        return f"{head}{self.name}{'' if self.serialized or self.dims == XY else '_' + DIM_NAMES[self.dims][2:]}{'[interleaved]' if self.coords == INTERLEAVED else ''}{tail}"

    def spark_type(self) -> T.DataType:
        if self.id in TEXT:
            return T.StringType()
        if self.id in BINARY:
            return T.BinaryType()
        names = DIM_NAMES[self.dims]
        if self.geometry == BOX:
            return T.StructType([T.StructField(n + side, T.DoubleType(), False) for side in ("min", "max") for n in names])
        out: T.DataType = T.ArrayType(T.DoubleType(), False) if self.coords == INTERLEAVED else T.StructType([T.StructField(n, T.DoubleType(), False) for n in names])
        for _ in range(DEPTH[self.geometry]):
            out = T.ArrayType(out, False)
        return out

    def field_metadata(self) -> dict:
        return {TYPE_KEY: self.id, META_KEY: self.metadata.serialize()}

    def field(self, name: str) -> T.StructField:
        return T.StructField(name, self.spark_type(), True, self.field_metadata())

    @staticmethod
    def of(field: T.StructField) -> GeometryType:
        """The type that a field's metadata names, checked against its Spark type; without metadata, the type Spark's type allows."""
        said = field.metadata.get(TYPE_KEY)
        if said is None:
            return GeometryType(infer(field.dataType))
        out = GeometryType(int(said), Metadata.parse(field.metadata.get(META_KEY)))
        if not _same(out.spark_type(), field.dataType):
            raise ValueError(f"Expected {out.spark_type().simpleString()} for {out} but found {field.dataType.simpleString()}")
        return out


def _same(a: T.DataType, b: T.DataType) -> bool:
    return a.simpleString() == b.simpleString()


def infer(t: T.DataType) -> int:
    if isinstance(t, T.StringType):
        return WKT
    if isinstance(t, T.BinaryType):
        return WKB
    depth = 0
    while isinstance(t, T.ArrayType) and not isinstance(t.elementType, T.DoubleType):
        t, depth = t.elementType, depth + 1
    if isinstance(t, T.StructType):
        names = [f.name for f in t.fields]
        if any(not isinstance(f.dataType, T.DoubleType) for f in t.fields):
            raise ValueError("Expected ordinates of type double")
        for d, spelt in DIM_NAMES.items():
            if names == list(spelt):
                return type_id((POINT, LINESTRING, POLYGON, MULTIPOLYGON)[depth], d)
            if names == [n + s for s in ("min", "max") for n in spelt] and depth == 0:
                return type_id(BOX, d)
        raise ValueError(f"Expected dimensions xy, xyz, xym or xyzm but found {names}")
    raise ValueError(f"no geometry layout has Spark type {t.simpleString()}; interleaved ones need metadata")
