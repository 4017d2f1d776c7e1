"""Vector layers: geometries as nested arrays, their texts and bytes, and folders of shapefiles as a data source.

A geometry is ``struct<kind: string, parts: array<array<struct<x: double, y: double>>>>``: POINT, LINESTRING and POLYGON have
their points, lines or rings as parts (outer rings run clockwise in files, holes the other way); MULTI kinds are these with
more parts, as files have them.

``spark.read.format("shapes")`` reads a shapefile or all of a folder; its index gives each task a range of records.
Comparisons of attributes are pushed down: records that fail them are not decoded, nor are those outside the option
``bbox`` ("x0,y0,x1,y1"), which the records' own bounds answer. ``df.write.format("shapes")`` writes a shapefile a task, or several of
``HELD`` bytes, whole files only when the job commits. Attributes are numbers, texts of up to 254 bytes, dates and booleans.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator, Sequence
from datetime import date
from typing import Any

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, StringStartsWith, WriterCommitMessage,
)

_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
_GEOMETRY = T.StructType([T.StructField("kind", T.StringType()), T.StructField("parts", T.ArrayType(T.ArrayType(_POINT)))])
GEOMETRY = "struct<kind:string,parts:array<array<struct<x:double,y:double>>>>"
#: Records of a range that a task reads.
RECORDS = 50_000
#: Bytes of records that a writing task holds before it closes a shapefile.
HELD = 16 << 20
# Codes of shapes in shapefiles and in well-known bytes.
_SHAPES = {1: "POINT", 3: "LINESTRING", 5: "POLYGON", 8: "MULTIPOINT"}
_KINDS = {"POINT": 1, "LINESTRING": 2, "POLYGON": 3, "MULTIPOINT": 4, "MULTILINESTRING": 5}

# Texts, without Python.


def to_wkt(geometry: Column) -> Column:
    """Well-known text; numbers as Spark prints doubles."""
    points = lambda part: F.array_join(F.transform(part, lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))), ", ")
    parts, kind = geometry["parts"], geometry["kind"]
    inner = F.array_join(F.transform(parts, points), ", ")
    nested = F.concat(F.lit("("), F.array_join(F.transform(parts, lambda r: F.concat(F.lit("("), points(r), F.lit(")"))), ", "), F.lit(")"))
    text = F.when(kind.isin("POINT", "LINESTRING", "MULTIPOINT"), F.concat(F.lit("("), inner, F.lit(")"))).otherwise(nested)
    return F.when(F.size(parts) == 0, F.concat(kind, F.lit(" EMPTY"))).otherwise(F.concat_ws(" ", kind, text))


def from_wkt(text: Column) -> Column:
    """The geometry of a well-known text of two dimensions; null if it is none. Rings of several polygons are parts of one."""
    kind = F.upper(F.regexp_extract(text, r"^\s*([A-Za-z]+)", 1))
    body = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]+\s*", ""), r"([-+0-9.eE]+)\s+([-+0-9.eE]+)", r'{"x":$1,"y":$2}')
    json = F.translate(body, "()", "[]")
    point = "struct<x:double,y:double>"
    flat = F.from_json(F.regexp_replace(json, r"\[\s*(\{[^{}]*\})\s*\]", "$1"), f"array<{point}>")
    line = F.from_json(json, f"array<{point}>")
    rings = F.from_json(json, f"array<array<{point}>>")
    many = F.flatten(F.from_json(json, f"array<array<array<{point}>>>"))
    whole = F.when(F.lower(text).contains("empty"), F.array().cast(f"array<array<{point}>>"))
    parts = F.coalesce(whole, F.when(kind == "MULTIPOINT", F.array(flat)).when(kind.isin("POINT", "LINESTRING"), F.array(line)).when(kind.isin("POLYGON", "MULTILINESTRING"), rings).when(kind == "MULTIPOLYGON", many))
    named = F.when(kind == "MULTIPOLYGON", "POLYGON").otherwise(kind)
    fine = parts.isNotNull() & ~F.exists(parts, lambda r: r.isNull() | F.exists(r, lambda p: p.isNull() | p["x"].isNull() | p["y"].isNull()))
    return F.when(fine, F.struct(named.alias("kind"), parts.alias("parts")).cast(GEOMETRY))


# Bytes.


def _wkb(kind: str, parts: Sequence[Sequence[Any]]) -> bytes:
    points = lambda ps: struct.pack(f"<{2 * len(ps)}d", *(v for p in ps for v in (p["x"], p["y"])))
    head = struct.pack("<BI", 1, _KINDS[kind])
    if kind == "POINT":
        return head + (points(parts[0][:1]) if parts else struct.pack("<2d", float("nan"), float("nan")))
    if kind == "LINESTRING":
        return head + struct.pack("<I", len(parts[0]) if parts else 0) + (points(parts[0]) if parts else b"")
    if kind == "POLYGON":
        return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(r)) + points(r) for r in parts)
    if kind == "MULTIPOINT":
        all_ = [p for r in parts for p in r]
        return head + struct.pack("<I", len(all_)) + b"".join(_wkb("POINT", [[p]]) for p in all_)
    return head + struct.pack("<I", len(parts)) + b"".join(_wkb("LINESTRING", [r]) for r in parts)


def _read_wkb(b: bytes, at: int = 0) -> tuple[str, list[list[dict[str, float]]], int]:
    order = "<" if b[at] == 1 else ">"
    code = struct.unpack_from(f"{order}I", b, at + 1)[0]
    at += 5

    def count() -> int:
        nonlocal at
        at += 4
        n = struct.unpack_from(f"{order}I", b, at - 4)[0]
        if n * 4 > len(b):
            raise ValueError("broken off")
        return n

    def points(n: int) -> list[dict[str, float]]:
        nonlocal at
        v = struct.unpack_from(f"{order}{2 * n}d", b, at)
        at += 16 * n
        return [{"x": x, "y": y} for x, y in zip(v[::2], v[1::2], strict=True)]

    if code == 1:
        p = points(1)
        return "POINT", [p] if p[0]["x"] == p[0]["x"] else [], at
    if code == 2:
        p = points(count())
        return "LINESTRING", [p] if p else [], at
    if code == 3:
        return "POLYGON", [points(count()) for _ in range(count())], at
    parts: list[list[dict[str, float]]] = []
    for _ in range(count()):
        _, inner, at = _read_wkb(b, at)
        parts += inner
    if code == 4:
        return "MULTIPOINT", [[p for r in parts for p in r]] if parts else [], at
    return {5: "MULTILINESTRING", 6: "POLYGON"}[code], parts, at


def to_wkb(geometry: Column) -> Column:
    """Well-known bytes, little-endian."""

    @F.pandas_udf("binary")
    def made(kinds: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([None if k is None or k not in _KINDS or p is None else _wkb(k, [list(r) for r in p]) for k, p in zip(kinds, parts, strict=True)], dtype=object)

    return made(geometry["kind"], geometry["parts"])


def from_wkb(value: Column) -> Column:
    """The geometry of well-known bytes of two dimensions; null if they are broken or of another kind."""

    @F.pandas_udf(GEOMETRY)
    def read(values: pd.Series) -> pd.DataFrame:
        rows = []
        for b in values:
            try:
                rows.append(_read_wkb(bytes(b))[:2])
            except (struct.error, KeyError, IndexError, TypeError, ValueError):
                rows.append((None, None))
        return pd.DataFrame(rows, columns=["kind", "parts"])

    found = read(value)
    return F.when(found["kind"].isNotNull(), found)


# Shapefiles. Headers are 100 bytes; lengths are in words of two bytes.


def _fs(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The shapefiles at a path: itself, or those of a folder."""
    fs, at = _fs(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [at]
    found = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(at)) if f.path.lower().endswith(".shp"))
    if not found:
        raise FileNotFoundError(f"no shapefile at {path}")
    return found


def _fields(dbf: bytes) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """Records, header's and a record's length, and (name, type, length, decimals) of each field."""
    n, head, size = struct.unpack_from("<IHH", dbf, 4)
    fields, at = [], 32
    while dbf[at] != 0x0D:
        name = dbf[at : at + 11].split(b"\0")[0].decode("ascii", "replace")
        fields.append((name, chr(dbf[at + 11]), dbf[at + 16], dbf[at + 17]))
        at += 32
    return n, head, size, fields


def _attribute(raw: bytes, kind: str, decimals: int) -> Any:
    text = raw.decode("utf-8", "replace").rstrip("\0 ")
    if kind == "C":
        return text or None
    text = text.strip()
    if not text or set(text) <= set("*?"):
        return None
    if kind in "NF":
        return float(text) if decimals or kind == "F" else int(text)
    if kind == "D":
        return date(int(text[:4]), int(text[4:6]), int(text[6:8]))
    return text.upper() in "TY" if kind == "L" else text


_TYPES = {"C": T.StringType(), "D": T.DateType(), "L": T.BooleanType()}


def _parts(record: bytes) -> dict[str, Any] | None:
    code = struct.unpack_from("<i", record)[0]
    if code not in _SHAPES:
        return None
    pair = lambda v: [{"x": x, "y": y} for x, y in zip(v[::2], v[1::2], strict=True)]
    if code == 1:
        return {"kind": "POINT", "parts": [pair(struct.unpack_from("<2d", record, 4))]}
    if code == 8:
        n = struct.unpack_from("<i", record, 36)[0]
        return {"kind": "MULTIPOINT", "parts": [pair(struct.unpack_from(f"<{2 * n}d", record, 40))]}
    parts, n = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{parts}i", record, 44), n]
    points = pair(struct.unpack_from(f"<{2 * n}d", record, 44 + 4 * parts))
    lines = [points[a:b] for a, b in zip(starts, starts[1:], strict=False)]
    return {"kind": "MULTILINESTRING" if code == 3 and parts > 1 else _SHAPES[code], "parts": lines}


class Records(InputPartition):
    def __init__(self, path: str, first: int, last: int) -> None:
        self.path, self.first, self.last = path, first, last


_TESTS: dict[type, Any] = {
    EqualTo: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w, LessThanOrEqual: lambda v, w: v <= w,
    In: lambda v, w: v in w, StringStartsWith: lambda v, w: v.startswith(w),
}


class ShapeReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict[str, str]) -> None:
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        self.bbox = tuple(map(float, options["bbox"].split(","))) if options.get("bbox") else None
        self.step = int(options.get("records", RECORDS))
        self.tests: list[tuple[str, type, Any]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in (*_TESTS, IsNull, IsNotNull) and len(f.attribute) == 1 and f.attribute[0] != "geometry":
                self.tests.append((f.attribute[0], type(f), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> Sequence[Records]:
        out = []
        for path in _files(self.path):
            n = (_fs(self.path)[0].get_file_info(path[:-4] + ".shx").size - 100) // 8
            out += [Records(path, k, min(n, k + self.step)) for k in range(0, n, self.step)]
        return out or [Records("", 0, 0)]

    def _holds(self, row: dict[str, Any]) -> bool:
        for name, kind, value in self.tests:
            v = row[name]
            if (v is not None) if kind is IsNull else (v is None) if kind is IsNotNull else (v is None or not _TESTS[kind](v, value)):
                return False
        return True

    def read(self, part: Records) -> Iterator[tuple]:
        if part.first >= part.last:
            return
        fs, _ = _fs(self.path)
        stem = part.path[:-4]
        with fs.open_input_file(stem + ".shx") as f:
            f.seek(100 + 8 * part.first)
            index = struct.unpack(f">{2 * (part.last - part.first)}i", f.read(8 * (part.last - part.first)))
        with fs.open_input_file(stem + ".dbf") as dbf, fs.open_input_file(part.path) as shp:
            head = dbf.read(32)
            size = struct.unpack_from("<H", head, 8)[0]
            _, head_size, width, fields = _fields(head + dbf.read(size - 32))
            dbf.seek(head_size + part.first * width)
            for k in range(part.last - part.first):
                raw, at, row = dbf.read(width), 1, {}
                for name, kind, length, decimals in fields:
                    row[name] = _attribute(raw[at : at + length], kind, decimals)
                    at += length
                if raw[:1] == b"*" or not self._holds(row):
                    continue
                shp.seek(2 * index[2 * k] + 8)
                record = shp.read(2 * index[2 * k + 1])
                if self.bbox and not self._meets(record):
                    continue
                row["geometry"] = _parts(record)
                yield tuple(_tupled(row["geometry"]) if n == "geometry" else row.get(n) for n in self.names)

    def _meets(self, record: bytes) -> bool:
        code = struct.unpack_from("<i", record)[0]
        if code not in _SHAPES:
            return False
        x0, y0, x1, y1 = struct.unpack_from("<2d", record, 4) * 2 if code == 1 else struct.unpack_from("<4d", record, 4)
        a, b, c, d = self.bbox
        return x0 <= c and a <= x1 and y0 <= d and b <= y1


def _tupled(g: dict[str, Any] | None) -> tuple | None:
    return None if g is None else (g["kind"], [[(p["x"], p["y"]) for p in r] for r in g["parts"]])


def _ring_area(r: Sequence[Any]) -> float:
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(r, r[1:], strict=False)) / 2


class Written(WriterCommitMessage):
    def __init__(self, stems: list[str]) -> None:
        self.stems = stems


class ShapeWriter(DataSourceWriter):
    def __init__(self, schema: T.StructType, path: str, overwrite: bool) -> None:
        self.schema, self.path, self.overwrite = schema, path, overwrite
        self.run = uuid.uuid4().hex
        self.fields = []
        for f in schema.fields:
            if f.name == "geometry":
                continue
            kind = f.dataType
            if isinstance(kind, T.IntegralType):
                self.fields.append((f.name, "N", 20, 0))
            elif isinstance(kind, (T.DoubleType, T.FloatType)):
                self.fields.append((f.name, "F", 25, 16))
            elif isinstance(kind, T.DateType):
                self.fields.append((f.name, "D", 8, 0))
            elif isinstance(kind, T.BooleanType):
                self.fields.append((f.name, "L", 1, 0))
            elif isinstance(kind, T.StringType):
                self.fields.append((f.name, "C", 254, 0))
            else:
                raise ValueError(f"{f.name}: attributes can't be {kind.simpleString()}")
            if len(f.name.encode("ascii", "replace")) > 10:
                raise ValueError(f"{f.name}: names of attributes have 10 letters at most")
        if len({f.name for f in schema.fields} & {"geometry"}) != 1:
            raise ValueError("a layer has one column geometry")

    def _cell(self, v: Any, kind: str, length: int) -> bytes:
        if v is None:
            return b" " * length
        text = {"F": lambda: repr(float(v)), "D": lambda: f"{v:%Y%m%d}", "L": lambda: "T" if v else "F"}.get(kind, lambda: str(v))().encode()
        if len(text) > length:
            raise ValueError(f"an attribute of {len(text)} bytes is longer than {length}")
        return text.ljust(length) if kind == "C" else text.rjust(length)

    def write(self, rows: Iterator[Any]) -> Written:
        """Shapefiles under hidden names. A file's records are held until its bounds and length are known, so a task starts a new one after ``HELD`` bytes."""
        fs, folder = _fs(self.path)
        fs.create_dir(folder, recursive=True)
        stems, code, rows = [], 0, iter(rows)
        while True:
            shp, shx, dbf, words, held, box = [], [], [], 50, 0, [float("inf"), float("inf"), float("-inf"), float("-inf")]
            for row in rows:
                body, own, bounds = _record(row["geometry"])
                if own and code and own != code:
                    raise ValueError("a layer has one kind of shape")
                code = own or code
                if bounds:
                    box = [min(box[0], bounds[0]), min(box[1], bounds[1]), max(box[2], bounds[2]), max(box[3], bounds[3])]
                shp.append(struct.pack(">2i", len(shp) + 1, len(body) // 2) + body)
                shx.append(struct.pack(">2i", words, len(body) // 2))
                words += 4 + len(body) // 2
                dbf.append(b" " + b"".join(self._cell(row[name], kind, length) for name, kind, length, _ in self.fields))
                held += sum(len(c[-1]) for c in (shp, shx, dbf))
                if held >= HELD:
                    break
            if not shp:
                return Written(stems)
            stems.append(f"{folder}/_{self.run}-{uuid.uuid4().hex}")
            self._file(fs, stems[-1], (shp, shx, dbf), words, code, box)

    def _file(self, fs: pafs.FileSystem, stem: str, records: tuple[list[bytes], ...], words: int, code: int, box: list[float]) -> None:
        shp, shx, dbf = records
        head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size) + struct.pack("<2i", 1000, code) + struct.pack("<8d", *(box if box[0] <= box[2] else [0.0] * 4), 0, 0, 0, 0)
        names = b"".join(name.encode("ascii", "replace").ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([length, decimals]) + bytes(14) for name, kind, length, decimals in self.fields)
        size = 33 + 32 * len(self.fields)
        first = struct.pack("<4B", 3, 100, 1, 1) + struct.pack("<IHH", len(shp), size, 1 + sum(f[2] for f in self.fields)) + bytes(20)
        for end, parts in ((".shp", [head(words), *shp]), (".shx", [head(50 + 4 * len(shp)), *shx]), (".dbf", [first, names, b"\r", *dbf, b"\x1a"])):
            with fs.open_output_stream(stem + end) as f:
                for p in parts:
                    f.write(p)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = _fs(self.path)
        fs.create_dir(folder, recursive=True)
        if self.overwrite:
            for f in fs.get_file_info(pafs.FileSelector(folder)):
                if f.type == pafs.FileType.File and not f.base_name.startswith("_"):
                    fs.delete_file(f.path)
        for k, stem in enumerate(sorted(stem for m in messages if m for stem in m.stems)):
            for end in (".dbf", ".shx", ".shp"):
                fs.move(stem + end, f"{folder}/part-{k:05d}-{self.run}{end}")

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = _fs(self.path)
        if fs.get_file_info(folder).type == pafs.FileType.Directory:
            for f in fs.get_file_info(pafs.FileSelector(folder)):
                if f.base_name.startswith(f"_{self.run}"):
                    fs.delete_file(f.path)


def _record(g: Any) -> tuple[bytes, int, tuple | None]:
    """A record's content, its shape's code (0 for none) and bounds."""
    parts = [r for r in g["parts"] if r] if g is not None and g["parts"] is not None else []
    if not parts:
        return struct.pack("<i", 0), 0, None
    kind = g["kind"]
    if kind == "POLYGON":  # outer rings clockwise, holes inside the other way
        outer = _ring_area(parts[0]) > 0
        parts = [r[::-1] for r in parts] if outer else parts
    flat = [v for r in parts for p in r for v in (p["x"], p["y"])]
    xs, ys = flat[::2], flat[1::2]
    box = (min(xs), min(ys), max(xs), max(ys))
    code = {"POINT": 1, "LINESTRING": 3, "MULTILINESTRING": 3, "POLYGON": 5, "MULTIPOINT": 8}[kind]
    if code == 1:
        return struct.pack("<i2d", 1, *flat[:2]), 1, box
    if code == 8:
        return struct.pack("<i4di", 8, *box, len(xs)) + struct.pack(f"<{len(flat)}d", *flat), 8, box
    starts, at = [], 0
    for r in parts:
        starts.append(at)
        at += len(r)
    return struct.pack("<i4d2i", code, *box, len(parts), len(xs)) + struct.pack(f"<{len(parts)}i", *starts) + struct.pack(f"<{len(flat)}d", *flat), code, box


class Shapes(DataSource):
    @classmethod
    def name(cls) -> str:
        return "shapes"

    def schema(self) -> T.StructType:
        path = self.options["path"]
        with _fs(path)[0].open_input_file(_files(path)[0][:-4] + ".dbf") as f:
            head = f.read(32)
            fields = _fields(head + f.read(struct.unpack_from("<H", head, 8)[0] - 32))[3]
        kind = lambda f: _TYPES.get(f[1]) or (T.LongType() if f[1] == "N" and not f[3] else T.DoubleType() if f[1] in "NF" else T.StringType())
        return T.StructType([T.StructField(f[0], kind(f)) for f in fields] + [T.StructField("geometry", _GEOMETRY)])

    def reader(self, schema: T.StructType) -> ShapeReader:
        return ShapeReader(schema, dict(self.options))

    def writer(self, schema: T.StructType, overwrite: bool) -> ShapeWriter:
        return ShapeWriter(schema, self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    """Make ``shapes`` a format of the session."""
    spark.dataSource.register(Shapes)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_layer(spark: SparkSession, path: str, bbox: Sequence[float] | None = None) -> DataFrame:
    register(spark)
    reader = spark.read.format("shapes")
    return (reader.option("bbox", ",".join(map(repr, map(float, bbox)))) if bbox else reader).load(path)


def write_layer(df: DataFrame, path: str, mode: str = "append") -> None:
    register(df.sparkSession)
    df.write.format("shapes").mode(mode).save(path)


def write_layers(df: DataFrame, path: str, by: str) -> None:
    """A feature dataset: a folder of layers, one for each value of a column of few values."""
    for row in df.select(by).distinct().collect():
        write_layer(df.where(F.col(by).eqNullSafe(F.lit(row[0]))).drop(by), f"{path}/{row[0]}")
