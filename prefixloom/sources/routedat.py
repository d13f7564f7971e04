"""Binary form: a protobuf list of categories, read and written through a Spark data source named `routedat`.

Message fields (fixed values of the format): file 1 = category; category 1 = name, 2 = entry, 3 = reverse; block entry
1 = address, 2 = prefix; rule entry 1 = type, 2 = value, 3 = attribute; attribute 1 = key, 2 = bool, 3 = int.

Reading: the driver walks the framing of categories and entries through a window of 1 MB and cuts the file by byte offsets into
runs of about `split` bytes, so a giant category is decoded by many tasks, each of which reads its own bytes once, and small
categories share a task.  Options: kind (geoip, geosite; found out
if not given), split (bytes a task, 4 MB).  Writing: every task encodes its rows to fragments, and commit puts fragments of one
category together in order; rows must be sorted by cat_ord and ord within each task and range-partitioned by them,
which write_dat() does.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from prefixloom.schema import GEOIP, GEOSITE

VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5


def varint(buf: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(buf):
            raise ValueError("unexpected end of data")
        b = buf[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def fields(buf: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(field, wire type, start, end) of every field; for a varint, start is its value."""
    while at < end:
        tag, at = varint(buf, at)
        field, wire = tag >> 3, tag & 7
        if wire == VARINT:
            value, at = varint(buf, at)
            yield field, wire, value, at
        elif wire == BYTES:
            n, at = varint(buf, at)
            if at + n > end:
                raise ValueError("unexpected end of data")
            yield field, wire, at, at + n
            at += n
        elif wire in (FIXED64, FIXED32):
            n = 8 if wire == FIXED64 else 4
            if at + n > end:
                raise ValueError("unexpected end of data")
            yield field, wire, at, at + n
            at += n
        else:
            raise ValueError(f"unknown wire type {wire}")


def text(buf: bytes, a: int, b: int) -> str:
    return buf[a:b].decode("utf-8", "replace")


def category_head(buf: bytes, a: int, b: int) -> tuple[str, bool, list[tuple[int, int]]]:
    """Name, reverse and the places of the entries; the last name and reverse count."""
    name, reverse, found = "", False, []
    for field, wire, x, y in fields(buf, a, b):
        if field == 1 and wire == BYTES:
            name = text(buf, x, y)
        elif field == 2 and wire == BYTES:
            found.append((x, y))
        elif field == 3 and wire == VARINT:
            reverse = x != 0
    return name, reverse, found


def block(buf: bytes, a: int, b: int) -> tuple[int, int, bytes]:
    """(family, prefix, address); the family is by the address's length, prefixes are clamped to 255."""
    ip, pfx = b"", 0
    for field, wire, x, y in fields(buf, a, b):
        if field == 1 and wire == BYTES:
            ip = bytes(buf[x:y])
        elif field == 2 and wire == VARINT:
            pfx = min(x, 255)
    return {4: 4, 16: 6}.get(len(ip), 0), pfx, ip


def attribute(buf: bytes, a: int, b: int) -> dict:
    out = {"k": "", "b": True, "i": None}
    for field, wire, x, y in fields(buf, a, b):
        if field == 1 and wire == BYTES:
            out["k"] = text(buf, x, y)
        elif field == 2 and wire == VARINT:
            out |= {"b": x != 0, "i": None}
        elif field == 3 and wire == VARINT:
            out |= {"b": None, "i": x - (1 << 64) if x >= 1 << 63 else x}
    return out


def rule(buf: bytes, a: int, b: int) -> tuple[int, str, list | None]:
    """(type modulo 256, value, attributes or None)."""
    type_, val, attrs = 0, "", None
    for field, wire, x, y in fields(buf, a, b):
        if field == 1 and wire == VARINT:
            type_ = x % 256
        elif field == 2 and wire == BYTES:
            val = text(buf, x, y)
        elif field == 3 and wire == BYTES:
            attrs = [*(attrs or []), attribute(buf, x, y)]
    return type_, val, attrs


def sniff(buf: bytes) -> str | None:
    """Kind by the very first field of the first category's first entry: an address of 4 or 16 bytes or a prefix make blocks, a
    type or a value make rules; anything else, and an empty entry, is unknown."""
    try:
        field, wire, a, b = next(fields(buf, 0, len(buf)))
        if (field, wire) != (1, BYTES):
            return None
        for f2, w2, x, y in fields(buf, a, b):
            if f2 != 2:
                continue
            if w2 != BYTES:
                return None
            f3, w3, p, q = next(fields(buf, x, y))
            if (f3, w3) == (1, BYTES):
                return "geoip" if q - p in (4, 16) else None
            return {(2, VARINT): "geoip", (1, VARINT): "geosite", (2, BYTES): "geosite"}.get((f3, w3))
    except (ValueError, StopIteration):
        return None
    return None


def sniff_entries(buf: bytes) -> str | None:
    """Kind by the first entry of any category whose fields are all of one kind's: addresses (of any length) and prefixes, or types,
    values and attributes."""
    sorts = {(1, BYTES): "geoip", (2, VARINT): "geoip", (1, VARINT): "geosite", (2, BYTES): "geosite", (3, BYTES): "geosite"}
    try:
        for field, wire, a, b in fields(buf, 0, len(buf)):
            if (field, wire) != (1, BYTES):
                continue
            for f2, w2, x, y in fields(buf, a, b):
                if (f2, w2) == (2, BYTES):
                    found = {sorts.get(f[:2]) for f in fields(buf, x, y)}
                    if len(found) == 1 and None not in found:
                        return found.pop()
    except ValueError:
        return None
    return None


def kind_of(buf: bytes, name: str = "") -> str:
    """By the first entry, else by name, else by the entries behind it: the first one may have an address of odd length."""
    found = sniff(buf)
    low = os.path.basename(name).lower()
    if found is None:
        found = "geosite" if "site" in low else "geoip" if "ip" in low else sniff_entries(buf)
    if found is None:
        raise ValueError(f"neither a block nor a rule file: {name}")
    return found


# writing


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes(field: int, raw: bytes) -> bytes:
    return _varint(field << 3 | BYTES) + _varint(len(raw)) + raw


def _number(field: int, n: int) -> bytes:
    return _varint(field << 3 | VARINT) + _varint(n)


def block_bytes(fam: int, pfx: int, ip: bytes | None) -> bytes:
    """One entry of a block category; an entry without an address of a known length and without bytes is left out."""
    if fam not in (4, 6) and ip is None:
        return b""
    body = (_bytes(1, ip) if ip else b"") + (_number(2, pfx) if pfx else b"")
    return _bytes(2, body)


def rule_bytes(type_: int, val: str, attrs: list | None) -> bytes:
    body = (_number(1, type_) if type_ else b"") + _bytes(2, (val or "").encode())
    for a in attrs or []:
        value = _number(3, a["i"]) if a["i"] is not None else _number(2, int(bool(a["b"])))
        body += _bytes(3, _bytes(1, a["k"].encode()) + value)
    return _bytes(2, body)


def category_bytes(name: str, entries: bytes, reverse: bool) -> bytes:
    return _bytes(1, _bytes(1, name.encode()) + entries + (_number(3, 1) if reverse else b""))


# the data source


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _files(path: str) -> list[str]:
    """The file, or all .dat files of a folder, named as the path was (a URI keeps its scheme and host)."""
    from pyarrow import fs

    store, at = _store(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.Directory:
        names = sorted(f.base_name for f in store.get_file_info(fs.FileSelector(at)) if f.is_file and f.base_name.endswith(".dat"))
        return [f"{path.rstrip('/')}/{n}" for n in names]
    return [path]


def load_bytes(path: str) -> bytes:
    store, at = _store(path)
    with store.open_input_file(at) as f:
        return f.read()


class Window:
    """A file as the driver and the tasks walk it: small reads through a window of bounded size, never the whole file."""

    def __init__(self, path: str, size: int = 1 << 20):
        store, at = _store(path)
        self.file = store.open_input_file(at)
        self.length, self.step, self.start, self.buf = self.file.size(), size, 0, b""

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, key):
        if isinstance(key, slice):
            a, b = key.start or 0, min(self.length, self.length if key.stop is None else key.stop)
            if b - a > self.step:
                return self.file.read_at(b - a, a)
            return self._held(a, max(a, b))[a - self.start : b - self.start]
        return self._held(key, key + 1)[key - self.start]

    def _held(self, a: int, b: int) -> bytes:
        if a < self.start or b > self.start + len(self.buf):
            self.start, self.buf = a, self.file.read_at(min(max(self.step, b - a), self.length - a), a)
        return self.buf


@dataclass
class Slice(InputPartition):
    """Runs of entries: (file, cat_ord, name, first ord, bytes from, to), each within one category."""

    path: str
    runs: list


class RouteDatReader(DataSourceReader):
    """partitions() walks the framing of entries through a window of bounded size and cuts runs of about `split` bytes; small
    categories share a task.  A task reads its own bytes only."""

    def __init__(self, path: str, kind: str, split: int, schema):
        self.path, self.kind, self.split, self.schema = path, kind, split, schema

    def partitions(self):
        out = []
        for path in _files(self.path):
            buf, open_, size = Window(path), [], 0
            cats = (f for f in fields(buf, 0, len(buf)) if f[0] == 1 and f[1] == BYTES)
            for cat_ord, (_, _, a, b) in enumerate(cats):
                name, cuts, n, start, last = "", [], 0, None, a
                at = a
                while at < b:
                    field, wire, x, y = next(fields(buf, at, b))
                    if field == 1 and wire == BYTES:
                        name = text(buf, x, y)
                    elif field == 2 and wire == BYTES:
                        if start is None or y - start[1] > self.split:
                            if start is not None:
                                cuts.append((*start, at))
                            start = (n, at)
                        n, last = n + 1, y
                    at = y
                if start is not None:
                    cuts.append((*start, last))
                for first, p, q in cuts:
                    if open_ and size + q - p > self.split:
                        out.append(Slice(path, open_))
                        open_, size = [], 0
                    open_.append((cat_ord, name, first, p, q))
                    size += q - p
            if open_:
                out.append(Slice(path, open_))
        return out or [Slice(self.path, [])]

    def read(self, p: Slice):
        schema, make = to_arrow_schema(self.schema), block if self.kind == "geoip" else rule
        file = p.path.rstrip("/").rpartition("/")[2]
        store, at = _store(p.path) if p.runs else (None, "")
        for cat_ord, name, first, a, b in p.runs:
            with store.open_input_file(at) as f:
                buf = f.read_at(b - a, a)
            found = [(x, y) for field, wire, x, y in fields(buf, 0, len(buf)) if field == 2 and wire == BYTES]
            for i in range(0, len(found), 20_000):
                part = found[i : i + 20_000]
                columns = list(zip(*(make(buf, x, y) for x, y in part), strict=True))
                ords = list(range(first + i, first + i + len(part)))
                rows = [[file] * len(part), [cat_ord] * len(part), [name] * len(part), ords, *map(list, columns)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, schema.types, strict=True)], schema=schema)


@dataclass
class Fragments(WriterCommitMessage):
    path: str
    index: list  # (cat_ord, name, offset, length), in the order of the rows


class RouteDatWriter(DataSourceWriter):
    """Fragments lie beside the file until commit joins them; an aborted or repeated task leaves the file as it is."""

    def __init__(self, path: str, kind: str, reverse: set[int], names: dict[int, str]):
        self.path, self.kind, self.reverse, self.names, self.run = path, kind, reverse, names, uuid.uuid4().hex[:12]

    def write(self, rows):
        from pyspark import TaskContext

        store, at = _store(self.path)
        name = f"{at}.part-{self.run}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        index, offset = [], 0
        with store.open_output_stream(name, buffer_size=1 << 20) as f:
            for r in rows:
                raw = block_bytes(r["fam"], r["pfx"], r["ip"]) if self.kind == "geoip" else rule_bytes(r["type"], r["val"], r["attrs"])
                f.write(raw)
                if index and index[-1][0] == r["cat_ord"]:
                    index[-1][3] += len(raw)
                else:
                    index.append([r["cat_ord"], r["cat"], offset, len(raw)])
                offset += len(raw)
        return Fragments(name, index)

    def commit(self, messages):
        store, at = _store(self.path)
        messages = sorted((m for m in messages if m is not None), key=lambda m: m.path)
        parts: dict[int, list] = {}
        names = dict(self.names)
        for m in messages:
            for cat_ord, name, offset, length in m.index:
                parts.setdefault(cat_ord, []).append((m.path, offset, length))
                names.setdefault(cat_ord, name)
        with store.open_output_stream(at, buffer_size=1 << 20) as out:
            for cat_ord in sorted(names):
                mine = parts.get(cat_ord, [])
                head, tail = _bytes(1, names[cat_ord].encode()), _number(3, 1) if cat_ord in self.reverse else b""
                out.write(_varint(1 << 3 | BYTES) + _varint(len(head) + sum(n for _, _, n in mine) + len(tail)) + head)
                for path, offset, length in mine:
                    with store.open_input_file(path) as f:
                        f.seek(offset)
                        for i in range(0, length, 1 << 22):
                            out.write(f.read(min(1 << 22, length - i)))
                out.write(tail)
        self._clean(messages)

    def abort(self, messages):
        self._clean([m for m in messages if m is not None])

    def _clean(self, messages):
        """Delete all fragments of this write, those of attempts that failed or were lost too."""
        from pyarrow import fs

        store, at = _store(self.path)
        folder, _, name = at.rpartition("/")
        for f in store.get_file_info(fs.FileSelector(folder or ".")):
            if f.base_name.startswith(f"{name}.part-{self.run}-"):
                store.delete_file(f.path)


class RouteDat(DataSource):
    @classmethod
    def name(cls):
        return "routedat"

    def _kind(self) -> str:
        if "kind" in self.options:
            return self.options["kind"]
        path = self.options["path"]
        first = _files(path)[0]
        return kind_of(Window(first), first)

    def schema(self):
        return GEOIP if self._kind() == "geoip" else GEOSITE

    def reader(self, schema):
        return RouteDatReader(self.options["path"], self._kind(), int(self.options.get("split", 1 << 22)), schema)

    def writer(self, schema, overwrite):
        names = {int(k): v for k, v in json.loads(self.options.get("names", "{}")).items()}
        reverse = {int(x) for x in self.options.get("reverse", "").split(",") if x}
        return RouteDatWriter(self.options["path"], self.options["kind"], reverse, names)


def read_dat(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Entries of a file, or of all .dat files of a folder."""
    spark.dataSource.register(RouteDat)
    reader = spark.read.format("routedat")
    return (reader.option("kind", kind) if kind else reader).load(path)


def read_categories(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """Categories of a file, empty ones too; the framing is walked through a window, and only the heads are kept."""
    buf = Window(path)
    kind = kind or kind_of(buf, path)
    rows = []
    for f, w, a, b in fields(buf, 0, len(buf)):
        if f == 1 and w == BYTES:
            name, reverse = "", False
            for field, wire, x, y in fields(buf, a, b):
                if field == 1 and wire == BYTES:
                    name = text(buf, x, y)
                elif field == 3 and wire == VARINT:
                    reverse = x != 0
            rows.append((path.rstrip("/").rpartition("/")[2], kind, len(rows), name, reverse))
    return spark.createDataFrame(rows, "file string, kind string, cat_ord int, name string, reverse boolean")


def write_dat(df: DataFrame, categories: DataFrame, kind: str, path: str) -> None:
    """Write categories in order, with their entries in order.  Categories are few (a name each reaches the driver)."""
    df.sparkSession.dataSource.register(RouteDat)
    store, at = _store(path)
    store.create_dir(at.rpartition("/")[0] or ".", recursive=True)
    cats = categories.select("cat_ord", "name", "reverse").orderBy("cat_ord").collect()
    names = json.dumps({r["cat_ord"]: r["name"] for r in cats})
    reverse = ",".join(str(r["cat_ord"]) for r in cats if r["reverse"])
    rows = df.repartitionByRange("cat_ord", "ord").sortWithinPartitions("cat_ord", "ord")
    out = rows.write.format("routedat").option("kind", kind).option("names", names).option("reverse", reverse)
    out.mode("append").save(path)


