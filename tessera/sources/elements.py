"""Self-describing element files as a Spark data source: `format("elements")`.

A file is a text header and a body. The header starts with `ply`, names the encoding of the
body, and lists elements (name, counts) with their properties; the body holds the elements'
rows in order, as text or binary of either byte order, plain or compressed.

Reading: option `element` picks the element (the first by default); the path is a file or a
folder. An uncompressed binary file whose rows have one width is cut by row ranges, so one
large file is read by many tasks and unwanted elements before it are skipped; any other file
is one partition. An n-dimensional element gets index columns `_i0`, `_i1`, ... before its
properties. Array properties are `struct<shape array<long>, data array>`. Files of one folder
must have the element's properties alike. An element without rows gives no rows.

Writing: one file for each partition, options `element`, `encoding` (ascii,
binary_little_endian, binary_big_endian), `compress` (gzip, bzip2), `type`. Nulls have no
place in the format and are refused. Paths may be of any file system that Arrow can open.
"""

from __future__ import annotations

import bz2
import gzip
import io
import math
import posixpath
import re
import struct
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import ArrayType, BooleanType, ByteType, DecimalType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

# The encodings of numbers, their numpy codes and their Spark types.
NUMBERS = {
    "int8": ("i1", ByteType()),
    "int16": ("i2", ShortType()),
    "int32": ("i4", IntegerType()),
    "int64": ("i8", LongType()),
    "nat8": ("u1", ShortType()),
    "nat16": ("u2", IntegerType()),
    "nat32": ("u4", LongType()),
    "nat64": ("u8", DecimalType(20, 0)),
    "real16": ("f2", FloatType()),
    "real32": ("f4", FloatType()),
    "real64": ("f8", DoubleType()),
}
FORMATS = ("ascii", "binary_little_endian", "binary_big_endian")
#: Header lines up to which a reader looks for its end.
HEADER_LINES = 16384
#: Rows of a partition of a file that can be cut.
ROWS = 1_000_000


@dataclass
class Element:
    name: str
    shape: list[int]
    properties: list[tuple[str, str]] = field(default_factory=list)  # (name, encoding)

    @property
    def rows(self) -> int:
        return math.prod(self.shape)

    def dtype(self, order: str) -> np.dtype | None:
        """One row's layout, if its width is fixed."""
        if any(e not in NUMBERS for _, e in self.properties):
            return None
        return np.dtype([(n, order + NUMBERS[e][0]) for n, e in self.properties])


@dataclass
class Header:
    format: str
    elements: list[Element]
    size: int
    type: list[str] = field(default_factory=list)
    meta: dict = field(default_factory=dict)
    comments: list[str] = field(default_factory=list)
    compress: str | None = None
    length: int | None = None

    @property
    def order(self) -> str:
        return ">" if self.format == "binary_big_endian" else "<"

    def element(self, name: str | None) -> Element:
        for e in self.elements:
            if name in (None, e.name):
                return e
        raise KeyError(f"no element {name!r}; the file has {[e.name for e in self.elements]}")


def check_encoding(encoding: str) -> None:
    parts = encoding.split(":")
    whole = lambda e: e[:3] in ("int", "nat") and e in NUMBERS
    ok = encoding in NUMBERS or (parts[0] == "string" and len(parts) == 2 and whole(parts[1])) or (parts[0] == "array" and len(parts) == 4 and parts[1].isdigit() and int(parts[1]) > 0 and whole(parts[2]) and parts[3] in NUMBERS)
    if not ok:
        raise NotImplementedError(f"encoding {encoding!r}")


def _meta_value(encoding: str, text: str):
    if encoding.startswith("string:"):
        n, _, value = text.partition(" ")
        if len(value.encode()) != int(n):
            raise ValueError("a metadata string has another length than stated")
        return value
    return float(text) if encoding.startswith("real") else int(text)


def parse_header(f) -> Header:
    """Reads to the end of the header; f gives lines of bytes."""
    lines, size = [], 0
    for _ in range(HEADER_LINES):
        raw = f.readline()
        size += len(raw)
        if not raw.endswith(b"\n"):
            raise EOFError("the file ends inside its header")
        line = raw[:-1].decode()
        if line == "end_header":
            break
        lines.append(line)
    else:
        raise BufferError("the header has no end")
    if not lines or lines[0] != "ply" or len(lines) < 2 or not re.fullmatch(rf"format ({'|'.join(FORMATS)}) 2\.0", lines[1]):
        raise ValueError("not an element file")
    h = Header(lines[1].split()[1], [], size)
    for line in lines[2:]:
        word, _, rest = line.partition(" ")
        parts = rest.split()
        if word == "element" and len(parts) >= 2:
            h.elements.append(Element(parts[0], [int(n) for n in parts[1:]]))
        elif word == "property" and len(parts) == 2 and h.elements:
            check_encoding(parts[0])
            h.elements[-1].properties.append((parts[1], parts[0]))
        elif word == "type":
            h.type += parts
        elif word == "meta" and len(parts) >= 2:
            encoding, key, value = (rest.split(" ", 2) + [""])[:3]
            h.meta[key] = _meta_value(encoding, value)
        elif word == "comment":
            h.comments.append(rest)
        elif word == "compress" and rest in ("gzip", "bzip2"):
            h.compress = rest
        elif word == "length" and len(parts) == 1:
            h.length = int(parts[0])
        else:
            raise ValueError(f"header line {line!r}")
    return h


def spark_type(encoding: str):
    if encoding in NUMBERS:
        return NUMBERS[encoding][1]
    if encoding.startswith("string:"):
        return StringType()
    return StructType([StructField("shape", ArrayType(LongType(), False)), StructField("data", ArrayType(NUMBERS[encoding.split(":")[3]][1], False))])


def element_schema(e: Element) -> StructType:
    index = [StructField(f"_i{i}", LongType(), False) for i in range(len(e.shape))] if len(e.shape) > 1 else []
    return StructType(index + [StructField(n, spark_type(enc), False) for n, enc in e.properties])


class _Text:
    """Values of a text body, one after another."""

    def __init__(self, body: bytes):
        self.body, self.at = body, 0
        self.token = re.compile(rb"[^\s]+")

    def number(self, encoding: str):
        m = self.token.search(self.body, self.at)
        if m is None:
            raise EOFError("the body ends early")
        self.at = m.end()
        return float(m[0]) if encoding.startswith("real") else int(m[0])

    def numbers(self, encoding: str, n: int) -> list:
        return [self.number(encoding) for _ in range(n)]

    def text(self, encoding: str) -> str:
        n = self.number(encoding)
        out = self.body[self.at + 1 : self.at + 1 + n]
        if len(out) < n:
            raise EOFError("the body ends early")
        self.at += 1 + n
        return out.decode()


class _Binary:
    def __init__(self, body: bytes, order: str):
        self.body, self.at, self.order = body, 0, order

    def numbers(self, encoding: str, n: int) -> list:
        d = np.dtype(self.order + NUMBERS[encoding][0])
        if self.at + n * d.itemsize > len(self.body):
            raise EOFError("the body ends early")
        out = np.frombuffer(self.body, d, n, self.at)
        self.at += n * d.itemsize
        return out.tolist()

    def number(self, encoding: str):
        return self.numbers(encoding, 1)[0]

    def text(self, encoding: str) -> str:
        n = self.number(encoding)
        out = self.body[self.at : self.at + n]
        if len(out) < n:
            raise EOFError("the body ends early")
        self.at += n
        return out.decode()


def _value(source, encoding: str):
    if encoding in NUMBERS:
        return source.number(encoding)
    parts = encoding.split(":")
    if parts[0] == "string":
        return source.text(parts[1])
    shape = source.numbers(parts[2], int(parts[1]))
    return {"shape": shape, "data": source.numbers(parts[3], math.prod(shape))}


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _index(e: Element, first: int, n: int) -> list[np.ndarray]:
    return list(np.unravel_index(np.arange(first, first + n), e.shape)) if len(e.shape) > 1 else []


def _batch(e: Element, columns: list, first: int, n: int) -> pa.RecordBatch:
    schema = _arrow(element_schema(e))
    arrays = []
    for c, f in zip([*_index(e, first, n), *columns], schema):
        if pa.types.is_decimal(f.type):
            c = [int(v) for v in c]
        arrays.append(pa.array(c.astype(f.type.to_pandas_dtype()) if isinstance(c, np.ndarray) and not pa.types.is_decimal(f.type) else c, f.type))
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def _open(path: str):
    fs, p = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + posixpath.abspath(path))
    return fs, p


def _files(path: str) -> list[str]:
    fs, p = _open(path)
    info = fs.get_file_info(p)
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == pafs.FileType.File:
        return [path]
    return [f"{path.rstrip('/')}/{i.base_name}" for i in sorted(fs.get_file_info(pafs.FileSelector(p)), key=lambda i: i.path) if i.type == pafs.FileType.File and i.base_name[0] not in "._"]


def header_of(path: str) -> Header:
    fs, p = _open(path)
    with io.BufferedReader(fs.open_input_file(p)) as f:
        return parse_header(f)


def read_body(f, h: Header) -> bytes:
    body = f.read()
    if h.length is not None and len(body) != h.length:
        raise EOFError(f"the body has {len(body)} bytes instead of {h.length}")
    return gzip.decompress(body) if h.compress == "gzip" else bz2.decompress(body) if h.compress == "bzip2" else body


@dataclass
class Part(InputPartition):
    path: str
    first: int = 0
    rows: int | None = None  # None: the whole file


class ElementReader(DataSourceReader):
    def __init__(self, path: str, element: str | None, rows: int):
        self.path, self.name, self.cut = path, element, rows

    def partitions(self):
        out = []
        for path in _files(self.path):
            h = header_of(path)
            e = h.element(self.name)
            before = h.elements[: h.elements.index(e) + 1]
            fixed = h.format != "ascii" and not h.compress and all(x.dtype(h.order) is not None for x in before)
            if fixed:
                out += [Part(path, i, min(self.cut, e.rows - i)) for i in range(0, e.rows, self.cut)]
            else:
                out.append(Part(path))
        return out or [Part("")]

    def read(self, part: Part):
        if not part.path:
            return
        fs, p = _open(part.path)
        with io.BufferedReader(fs.open_input_file(p)) as f:
            h = parse_header(f)
            e = h.element(self.name)
            before = h.elements[: h.elements.index(e)]
            if part.rows is not None:
                d = e.dtype(h.order)
                f.seek(h.size + sum(x.rows * x.dtype(h.order).itemsize for x in before) + part.first * d.itemsize)
                done = 0
                while done < part.rows:
                    n = min(65536, part.rows - done)
                    raw = f.read(n * d.itemsize)
                    if len(raw) < n * d.itemsize:
                        raise EOFError("the body ends early")
                    a = np.frombuffer(raw, d.newbyteorder(h.order)).astype(d.newbyteorder("="))
                    yield _batch(e, [a[x] for x, _ in e.properties], part.first + done, n)
                    done += n
                return
            body = read_body(f, h)
        source = _Text(body) if h.format == "ascii" else _Binary(body, h.order)
        for x in before:
            for _ in range(x.rows):
                for _, enc in x.properties:
                    _value(source, enc)
        for first in range(0, e.rows, 4096):
            n = min(4096, e.rows - first)
            rows = [[_value(source, enc) for _, enc in e.properties] for _ in range(n)]
            yield _batch(e, [list(c) for c in zip(*rows)] or [[] for _ in e.properties], first, n)


def encoding_of(t) -> str:
    if isinstance(t, StringType):
        return "string:nat32"
    if isinstance(t, BooleanType):
        return "nat8"
    if isinstance(t, ArrayType):
        return f"array:1:nat32:{encoding_of(t.elementType)}"
    if isinstance(t, StructType) and t.names == ["shape", "data"]:
        return f"array:?:nat32:{encoding_of(t['data'].dataType.elementType)}"
    if isinstance(t, DecimalType) and t.scale == 0:
        return "nat64"
    for name in ("int8", "int16", "int32", "int64", "real32", "real64"):
        if type(t) is type(NUMBERS[name][1]):
            return name
    raise TypeError(f"no encoding for {t.simpleString()}")


def write_header(h: Header) -> bytes:
    lines = ["ply", f"format {h.format} 2.0"]
    lines += [f"type {' '.join(h.type)}"] if h.type else []
    for k, v in h.meta.items():
        if re.search(r"\s", k):
            raise ValueError(f"white space in the metadata key {k!r}")
        lines.append(f"meta string:nat32 {k} {len(v.encode())} {v}" if isinstance(v, str) else f"meta real64 {k} {v!r}" if isinstance(v, float) else f"meta int64 {k} {v}")
    lines += [f"comment {c}" for c in h.comments]
    lines += [f"compress {h.compress}"] if h.compress else []
    lines += [f"length {h.length}"] if h.length is not None else []
    for e in h.elements:
        for name in (e.name, *(n for n, _ in e.properties)):
            if not name or re.search(r"\s", name):
                raise ValueError(f"white space in the name {name!r}")
        lines.append(f"element {e.name} {' '.join(map(str, e.shape))}")
        lines += [f"property {enc} {n}" for n, enc in e.properties]
    return ("\n".join(lines) + "\nend_header\n").encode()


def _encoded(v, enc: str, order: str, text: bool) -> bytes:
    if v is None:
        raise ValueError("the format has no nulls")
    parts = enc.split(":")
    if parts[0] == "string":
        raw = v.encode()
        return f"{len(raw)} ".encode() + raw if text else struct.pack(order + "I", len(raw)) + raw
    if parts[0] == "array":
        shape, data = (list(v["shape"]), list(v["data"])) if not isinstance(v, (list, tuple, np.ndarray)) or hasattr(v, "asDict") else ([len(v)], list(v))
        if len(shape) != int(parts[1]) or math.prod(shape) != len(data):
            raise ValueError("an array does not fit its shape")
        if text:
            return " ".join([*map(str, shape), *(_number(x, parts[3]) for x in data)]).encode()
        return struct.pack(f"{order}{len(shape)}I", *shape) + np.array(data, order + NUMBERS[parts[3]][0]).tobytes()
    return _number(v, enc).encode() if text else np.array(v, order + NUMBERS[enc][0]).tobytes()


def _number(v, enc: str) -> str:
    if v is None:
        raise ValueError("the format has no nulls")
    return repr(float(v)) if enc.startswith("real") else str(int(v))


def write_file(f, h: Header, rows: list[list[tuple]]) -> None:
    """Header and body of the elements' rows; the header's length is set."""
    text = h.format == "ascii"
    out = []
    for e, rs in zip(h.elements, rows, strict=True):
        if e.rows != len(rs):
            raise ValueError(f"element {e.name} has {len(rs)} rows instead of {e.rows}")
        for r in rs:
            cells = [_encoded(v, enc, h.order, text) for v, (_, enc) in zip(r, e.properties, strict=True)]
            out.append(b" ".join(cells) + b"\n" if text else b"".join(cells))
    body = b"".join(out)
    body = gzip.compress(body) if h.compress == "gzip" else bz2.compress(body) if h.compress == "bzip2" else body
    h.length = len(body)
    f.write(write_header(h) + body)


@dataclass
class Written(WriterCommitMessage):
    temporary: str
    final: str


class ElementWriter(DataSourceWriter):
    """Each task writes a file under a hidden name; only the commit gives it its own, so a lost task leaves nothing behind."""

    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.options, self.schema, self.overwrite = dict(options), schema, overwrite
        self.encodings = [encoding_of(f.dataType) for f in schema]
        if options.get("encoding", "binary_little_endian") not in FORMATS or options.get("compress") not in (None, "gzip", "bzip2"):
            raise ValueError("unknown encoding or compression")

    def write(self, rows):
        o = self.options
        rows = [tuple(r) for r in rows]
        encodings = list(self.encodings)
        for i, enc in enumerate(encodings):
            if "?" in enc:
                encodings[i] = enc.replace("?", str(len(rows[0][i]["shape"]) if rows else 1))
        e = Element(o.get("element", "row"), [len(rows)], list(zip(self.schema.names, encodings)))
        h = Header(o.get("encoding", "binary_little_endian"), [e], 0, type=o.get("type", "").split(), compress=o.get("compress"))
        fs, p = _open(o["path"])
        fs.create_dir(p, recursive=True)
        name = f"part-{uuid.uuid4().hex}.elements"
        with fs.open_output_stream(f"{p}/.{name}") as f:
            write_file(f, h, [rows])
        return Written(f"{p}/.{name}", f"{p}/{name}")

    def commit(self, messages):
        fs, p = _open(self.options["path"])
        if self.overwrite:
            for i in fs.get_file_info(pafs.FileSelector(p, allow_not_found=True)):
                if i.type == pafs.FileType.File and i.base_name.endswith(".elements") and not i.base_name.startswith("."):
                    fs.delete_file(i.path)
        for m in messages:
            if m is not None:
                fs.move(m.temporary, m.final)

    def abort(self, messages):
        fs, _ = _open(self.options["path"])
        for m in messages:
            if m is not None:
                fs.delete_file(m.temporary)


class ElementSource(DataSource):
    @classmethod
    def name(cls):
        return "elements"

    def schema(self):
        files = _files(self.options["path"])
        if not files:
            raise FileNotFoundError(f"no element file in {self.options['path']}")
        return element_schema(header_of(files[0]).element(self.options.get("element")))

    def reader(self, schema):
        return ElementReader(self.options["path"], self.options.get("element"), int(self.options.get("rows", ROWS)))

    def writer(self, schema, overwrite):
        return ElementWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes `spark.read.format("elements")` and `df.write.format("elements")` known to the session."""
    from tessera.session import ship

    ship(spark)
    spark.dataSource.register(ElementSource)
