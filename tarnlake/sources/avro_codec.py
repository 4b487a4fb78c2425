"""Avro schemas and the binary encoding: parsing, canonical form, fingerprints, resolution, container files and framed messages."""

from __future__ import annotations

import datetime as dt
import decimal
import hashlib
import io
import json
import os
import struct
import zlib
from collections.abc import Callable, Iterator
from typing import Any

PRIMITIVES = frozenset("null boolean int long float double bytes string".split())
MAGIC = b"Obj\x01"
EMPTY = 0xC15D213AA4D7A795  # the fingerprint of nothing, as the specification fixes it
EPOCH = dt.date(1970, 1, 1)
PROMOTIONS = {"int": ("long", "float", "double"), "long": ("float", "double"), "float": ("double",), "string": ("bytes",), "bytes": ("string",)}

Schema = Any


class AvroError(ValueError):
    pass


def parse(text: str | Schema) -> Schema:
    """A schema with full names, where named types met again stay references."""
    raw = json.loads(text) if isinstance(text, str) and text.strip()[:1] in "{[\"" else text
    return _named(raw, "", {})


def _full(name: str, space: str) -> str:
    return name if "." in name or not space else f"{space}.{name}"


def _named(s: Schema, space: str, known: dict) -> Schema:
    if isinstance(s, list):
        return [_named(x, space, known) for x in s]
    if isinstance(s, str):
        if s in PRIMITIVES:
            return s
        full = _full(s, space)
        if full not in known:
            raise AvroError(f"no type {s!r}")
        return known[full]
    kind = s["type"]
    if kind in ("record", "error", "enum", "fixed"):
        full = _full(s["name"], s.get("namespace", space))
        out = {**s, "name": full}
        known[full] = out
        inner = full.rpartition(".")[0]
        out["aliases"] = [_full(a, inner) for a in s.get("aliases", [])]
        if "fields" in s:
            out["fields"] = [{**f, "type": _named(f["type"], inner, known)} for f in s["fields"]]
        return out
    if kind == "array":
        return {**s, "items": _named(s["items"], space, known)}
    if kind == "map":
        return {**s, "values": _named(s["values"], space, known)}
    return {**s, "type": _named(kind, space, known)} if not (isinstance(kind, str) and kind in PRIMITIVES) else s


def kind_of(s: Schema) -> str:
    return "union" if isinstance(s, list) else s if isinstance(s, str) else kind_of(s["type"]) if not isinstance(s["type"], str) else s["type"]


def canonical(s: Schema) -> str:
    """Parsing canonical form: only what matters for reading, in a fixed order."""
    seen: set[str] = set()
    text = lambda v: json.dumps(v, ensure_ascii=False)

    def form(x: Schema) -> str:
        k = kind_of(x)
        if k == "union":
            return "[" + ",".join(map(form, x)) + "]"
        if k in PRIMITIVES:
            return text(k)
        if k == "array":
            return f'{{"type":"array","items":{form(x["items"])}}}'
        if k == "map":
            return f'{{"type":"map","values":{form(x["values"])}}}'
        if x["name"] in seen:
            return text(x["name"])
        seen.add(x["name"])
        head = f'{{"name":{text(x["name"])},"type":"{k}"'
        if k == "enum":
            return head + ',"symbols":[' + ",".join(map(text, x["symbols"])) + "]}"
        if k == "fixed":
            return head + f',"size":{int(x["size"])}}}'
        return head + ',"fields":[' + ",".join(f'{{"name":{text(f["name"])},"type":{form(f["type"])}}}' for f in x["fields"]) + "]}"

    return form(parse(s))


def _rabin_table() -> list[int]:
    out = []
    for i in range(256):
        fp = i
        for _ in range(8):
            fp = fp >> 1 ^ (EMPTY if fp & 1 else 0)
        out.append(fp)
    return out


RABIN = _rabin_table()


def fingerprint(s: Schema, algorithm: str = "rabin") -> bytes:
    """rabin (8 bytes, little-endian), md5 or sha256 of the canonical form."""
    data = canonical(s).encode()
    if algorithm != "rabin":
        return hashlib.new(algorithm, data).digest()
    fp = EMPTY
    for b in data:
        fp = fp >> 8 ^ RABIN[(fp ^ b) & 0xFF]
    return struct.pack("<Q", fp)


class SchemaStore:
    """Writer schemas by fingerprint or registry id."""

    def __init__(self, algorithm: str = "rabin") -> None:
        self.algorithm, self.known = algorithm, {}

    def register(self, s: Schema) -> bytes:
        fp = fingerprint(s, self.algorithm)
        self.known[fp] = parse(s)
        return fp

    def set(self, key: bytes | int, s: Schema) -> None:
        self.known[key] = parse(s)

    def lookup(self, key: bytes | int) -> Schema | None:
        return self.known.get(key)


# -- values ------------------------------------------------------------------------------------------------------


def write_long(n: int) -> bytes:
    n = n << 1 ^ n >> 63
    out = bytearray()
    while n & ~0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


class Reader:
    def __init__(self, data: bytes) -> None:
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) < n:
            raise AvroError("the data end early")
        self.at += n
        return out

    def long(self) -> int:
        shift = value = 0
        while True:
            b = self.take(1)[0]
            value |= (b & 0x7F) << shift
            if b < 0x80:
                return (value >> 1) ^ -(value & 1)
            shift += 7


def to_logical(s: Schema, v: Any) -> Any:
    kind = s.get("logicalType") if isinstance(s, dict) else None
    if kind == "date":
        return EPOCH + dt.timedelta(days=v)
    if kind in ("timestamp-millis", "timestamp-micros", "timestamp-nanos", "local-timestamp-millis", "local-timestamp-micros", "local-timestamp-nanos"):
        micros = v * 1000 if kind.endswith("millis") else v // 1000 if kind.endswith("nanos") else v
        base = dt.datetime(1970, 1, 1, tzinfo=None if kind.startswith("local") else dt.UTC)
        return base + dt.timedelta(microseconds=micros)
    if kind == "time-millis":
        return v * 1000
    if kind == "decimal":
        return decimal.Decimal(int.from_bytes(v, "big", signed=True)).scaleb(-s.get("scale", 0))
    if kind == "duration":
        return struct.unpack("<III", v)
    return v


def from_logical(s: Schema, v: Any) -> Any:
    kind = s.get("logicalType") if isinstance(s, dict) else None
    if kind == "date" and isinstance(v, dt.date):
        return (v - EPOCH).days
    if isinstance(v, dt.datetime):
        base = dt.datetime(1970, 1, 1, tzinfo=v.tzinfo and dt.UTC)
        micros = (v - base) // dt.timedelta(microseconds=1)
        return micros // 1000 if kind.endswith("millis") else micros * 1000 if kind.endswith("nanos") else micros
    if kind == "time-millis":
        return v // 1000
    if kind == "decimal":
        n = int(decimal.Decimal(v).scaleb(s.get("scale", 0)).to_integral_value())
        size = s["size"] if kind_of(s) == "fixed" else (n if n >= 0 else ~n).bit_length() // 8 + 1
        return n.to_bytes(size, "big", signed=True)
    return struct.pack("<III", *v) if kind == "duration" else v


def decoder(s: Schema) -> Callable[[Reader], Any]:
    k = kind_of(s)
    if k == "union":
        branches = [decoder(x) for x in s]
        plain = len([x for x in s if kind_of(x) != "null"]) <= 1

        def union(r: Reader) -> Any:
            i = r.long()
            if not 0 <= i < len(branches):
                raise AvroError(f"no branch {i}")
            v = branches[i](r)
            return v if plain else {"tag": i, f"b{i}": v}

        return union
    if k == "record":
        fields = [(f["name"], decoder(f["type"])) for f in s["fields"]]
        return lambda r: {n: d(r) for n, d in fields}
    if k in ("array", "map"):
        item = decoder(s["items"] if k == "array" else s["values"])

        def blocks(r: Reader) -> Iterator[int]:
            while n := r.long():
                if n < 0:
                    r.long()
                yield from range(abs(n))

        if k == "array":
            return lambda r: [item(r) for _ in blocks(r)]
        return lambda r: {r.take(r.long()).decode(): item(r) for _ in blocks(r)}
    if k == "enum":
        return lambda r: s["symbols"][r.long()]
    base = {
        "null": lambda r: None, "boolean": lambda r: r.take(1) == b"\1", "int": Reader.long, "long": Reader.long, "float": lambda r: struct.unpack("<f", r.take(4))[0], "double": lambda r: struct.unpack("<d", r.take(8))[0],
        "bytes": lambda r: r.take(r.long()), "string": lambda r: r.take(r.long()).decode(), "fixed": lambda r: r.take(s["size"]),
    }[k]
    return (lambda r: to_logical(s, base(r))) if isinstance(s, dict) and "logicalType" in s else base


def encoder(s: Schema) -> Callable[[Any], bytes]:
    k = kind_of(s)
    if k == "union":
        kinds, parts = [kind_of(x) for x in s], [encoder(x) for x in s]
        plain = len([x for x in kinds if x != "null"]) <= 1

        def union(v: Any) -> bytes:
            if v is None:
                if "null" not in kinds:
                    raise AvroError("null isn't a branch")
                return write_long(kinds.index("null"))
            i = next(i for i, x in enumerate(kinds) if x != "null") if plain else v["tag"]
            return write_long(i) + parts[i](v if plain else v[f"b{i}"])

        return union
    if k == "record":
        fields = [(f["name"], encoder(f["type"])) for f in s["fields"]]
        return lambda v: b"".join([e(v[n]) for n, e in fields])
    if k == "array":
        item = encoder(s["items"])
        return lambda v: (write_long(len(v)) + b"".join(map(item, v)) if v else b"") + b"\0"
    if k == "map":
        value, key = encoder(s["values"]), encoder("string")
        return lambda v: (write_long(len(v)) + b"".join(key(a) + value(b) for a, b in (v.items() if isinstance(v, dict) else v)) if v else b"") + b"\0"
    if k == "enum":
        return lambda v: write_long(s["symbols"].index(v))

    def fixed(v: bytes) -> bytes:
        if len(v) != s["size"]:
            raise AvroError(f"{len(v)} bytes aren't {s['size']}")
        return bytes(v)

    base = {
        "null": lambda v: b"", "boolean": lambda v: b"\1" if v else b"\0", "int": write_long, "long": write_long, "float": lambda v: struct.pack("<f", v), "double": lambda v: struct.pack("<d", v),
        "bytes": lambda v: write_long(len(v)) + bytes(v), "string": lambda v: write_long(len(b := v.encode())) + b, "fixed": fixed,
    }[k]
    return (lambda v: base(from_logical(s, v))) if isinstance(s, dict) and "logicalType" in s else base


# -- resolution --------------------------------------------------------------------------------------------------


def resolver(writer: Schema, reader: Schema) -> Callable[[Any], Any]:
    """Turns values decoded by the writer's schema into the reader's: fields by name or alias, defaults for missing ones, promotions."""
    w, r = kind_of(writer), kind_of(reader)
    if w == "union" or r == "union":
        wide_w, wide_r = (writer if w == "union" else [writer]), (reader if r == "union" else [reader])
        some_w, some_r = ([x for x in b if kind_of(x) != "null"] for b in (wide_w, wide_r))
        if len(some_w) > 1 or len(some_r) > 1:
            return _union_resolver(wide_w, wide_r, len(some_w) > 1, len(some_r) > 1)
        inner = resolver(some_w[0], some_r[0]) if some_w and some_r else lambda v: v
        nullable = any(kind_of(x) == "null" for x in wide_r)

        def optional(v: Any) -> Any:
            if v is None and not nullable:
                raise AvroError("null for a type that isn't nullable")
            return None if v is None else inner(v)

        return optional
    if w == r == "record":
        have = {f["name"]: f for f in writer["fields"]}
        plan = []
        for f in reader["fields"]:
            source = next((n for n in (f["name"], *f.get("aliases", [])) if n in have), None)
            if source is not None:
                plan.append((f["name"], source, resolver(have[source]["type"], f["type"]), None))
            elif "default" in f:
                plan.append((f["name"], None, None, default(f["type"], f["default"])))
            else:
                raise AvroError(f"{f['name']} is missing and has no default")
        return lambda v: {n: d if s is None else fn(v[s]) for n, s, fn, d in plan}
    if w == r == "enum":
        fallback = reader.get("default")
        known = set(reader["symbols"])

        def symbol(v: str) -> str:
            if v in known:
                return v
            if fallback is None:
                raise AvroError(f"no symbol {v}")
            return fallback

        return symbol
    if w == r and w in ("array", "map"):
        inner = resolver(writer["items" if w == "array" else "values"], reader["items" if w == "array" else "values"])
        return (lambda v: [inner(x) for x in v]) if w == "array" else (lambda v: {k: inner(x) for k, x in v.items()})
    if w == r:
        if w == "fixed" and writer["size"] != reader["size"]:
            raise AvroError("sizes of fixed differ")
        return lambda v: v
    if r not in PROMOTIONS.get(w, ()):
        raise AvroError(f"{w} doesn't resolve to {r}")
    return {"long": int, "float": float, "double": float, "bytes": lambda v: v.encode(), "string": lambda v: v.decode()}[r]


def _union_resolver(writers: list[Schema], readers: list[Schema], tagged_in: bool, tagged_out: bool) -> Callable[[Any], Any]:
    """Branch by branch: each of the writer's goes to the reader's first of its own kind (and name), or else to the first that it resolves to. A branch that
    fits none fails when a value has it. Values of unions of several kinds carry a tag."""

    def place(w: Schema) -> tuple[int, Callable[[Any], Any]] | None:
        named = lambda s: s.get("name") if isinstance(s, dict) else None
        same = [j for j, r in enumerate(readers) if kind_of(r) == kind_of(w)]
        for j in [*(j for j in same if named(readers[j]) == named(w)), *same, *range(len(readers))]:
            try:
                return j, resolver(w, readers[j])
            except AvroError:
                continue
        return None

    places = [place(w) for w in writers]
    null = next((i for i, w in enumerate(writers) if kind_of(w) == "null"), None)

    def resolve(v: Any) -> Any:
        i = v["tag"] if tagged_in else null if v is None else next(i for i in range(len(writers)) if i != null)
        if i is None or places[i] is None:
            raise AvroError("a branch that the reader doesn't have")
        j, fix = places[i]
        value = v[f"b{i}"] if tagged_in else v
        value = None if kind_of(writers[i]) == "null" else fix(value)
        return {"tag": j, f"b{j}": value} if tagged_out else value

    return resolve


def default(s: Schema, v: Any) -> Any:
    k = kind_of(s)
    if k == "union":
        return default(s[0], v)
    if k in ("bytes", "fixed") and isinstance(v, str):
        v = v.encode("latin-1")
    if k == "record":
        return {f["name"]: default(f["type"], v.get(f["name"], f.get("default"))) for f in s["fields"]}
    if k == "array":
        return [default(s["items"], x) for x in v]
    if k == "map":
        return {a: default(s["values"], b) for a, b in v.items()}
    return to_logical(s, v) if k not in ("null",) else None


# -- container files ---------------------------------------------------------------------------------------------


def _codec(name: str) -> tuple[Callable[[bytes], bytes], Callable[[bytes], bytes]]:
    if name == "null":
        return bytes, bytes
    if name == "deflate":
        def deflate(b: bytes) -> bytes:
            z = zlib.compressobj(6, zlib.DEFLATED, -15)
            return z.compress(b) + z.flush()

        return deflate, lambda b: zlib.decompress(b, -15)
    if name == "zstandard":
        import zstandard

        return lambda b: zstandard.compress(b, 3), lambda b: zstandard.ZstdDecompressor().decompressobj().decompress(b)
    if name == "snappy":
        import pyarrow as pa

        def plain_size(b: bytes) -> int:
            size = shift = 0
            for x in b:
                size |= (x & 0x7F) << shift
                shift += 7
                if x < 0x80:
                    return size
            raise AvroError("snappy block without a length")

        def unsnappy(b: bytes) -> bytes:
            out = pa.Codec("snappy").decompress(b[:-4], plain_size(b), asbytes=True)
            if zlib.crc32(out) != struct.unpack(">I", b[-4:])[0]:
                raise AvroError("snappy block with a wrong checksum")
            return out

        return lambda b: pa.Codec("snappy").compress(b, asbytes=True) + struct.pack(">I", zlib.crc32(b)), unsnappy
    if name == "lz4":  # one frame, as the library that introduced it writes
        import pyarrow as pa

        return lambda b: pa.Codec("lz4").compress(b, asbytes=True), lambda b: pa.CompressedInputStream(pa.BufferReader(b), "lz4").read()
    raise AvroError(f"no codec {name}")


class FileWriter:
    def __init__(self, out: Any, schema: Schema, codec: str = "deflate", block_bytes: int = 1 << 18) -> None:
        self.out, self.encode, self.pack, self.limit = out, encoder(parse(schema)), _codec(codec)[0], block_bytes
        self.sync, self.rows, self.size, self.count = os.urandom(16), [], 0, 0
        meta = {"avro.schema": json.dumps(schema).encode(), "avro.codec": codec.encode()}
        out.write(MAGIC + encoder({"type": "map", "values": "bytes"})(meta) + self.sync)

    def write(self, row: Any) -> None:
        self.write_encoded(self.encode(row))

    def write_encoded(self, b: bytes) -> None:
        self.rows.append(b)
        self.size += len(b)
        if self.size >= self.limit:
            self.flush()

    def flush(self) -> None:
        if self.rows:
            data = self.pack(b"".join(self.rows))
            self.out.write(write_long(len(self.rows)) + write_long(len(data)) + data + self.sync)
            self.rows, self.size = [], 0


def _stream_long(f: Any) -> int | None:
    shift = value = 0
    while b := f.read(1):
        value |= (b[0] & 0x7F) << shift
        if b[0] < 0x80:
            return (value >> 1) ^ -(value & 1)
        shift += 7
    return None


def read_header(f: Any) -> tuple[Schema, dict[str, bytes], bytes]:
    """Raw schema, metadata and sync mark of a container file; the stream stands at its first block."""
    if f.read(4) != MAGIC:
        raise AvroError("no Avro container file")
    meta: dict[str, bytes] = {}
    while n := _stream_long(f):
        if n < 0:
            _stream_long(f)
        for _ in range(abs(n)):
            key = f.read(_stream_long(f)).decode()
            meta[key] = f.read(_stream_long(f))
    return json.loads(meta["avro.schema"]), meta, f.read(16)


def read_blocks(f: Any, start: int = 0, end: int | None = None) -> Iterator[tuple[int, bytes]]:
    """Rows and plain data of the blocks that begin in [start, end) of a file that can seek. The header belongs to the first part; other parts begin at
    the first sync mark from start on, so that parts share no block and leave none out."""
    f.seek(0)
    _, meta, sync = read_header(f)
    unpack, at = _codec(meta.get("avro.codec", b"null").decode())[1], f.tell()
    if start > at:
        f.seek(start - 16 if start - 16 > at else at)  # a mark that ends at start begins a block there
        seen, base = b"", f.tell()
        while (k := seen.find(sync)) < 0:
            more = f.read(1 << 16)
            if not more:
                return
            drop = max(0, len(seen) - 15)
            seen, base = seen[drop:] + more, base + drop
        f.seek(base + k + 16)
    while end is None or f.tell() < end:
        n = _stream_long(f)
        if n is None:
            return
        data = f.read(_stream_long(f))
        if f.read(16) != sync:
            raise AvroError("block without its sync mark")
        yield n, unpack(data)


def read_rows(f: Any, reader: Schema | None = None, start: int = 0, end: int | None = None) -> Iterator[Any]:
    f.seek(0)
    writer = parse(read_header(f)[0])
    decode = decoder(writer)
    fix = resolver(writer, parse(reader)) if reader is not None else None
    for n, data in read_blocks(f, start, end):
        r = Reader(data)
        for _ in range(n):
            v = decode(r)
            yield fix(v) if fix else v


#: Kinds that column_decoder() and column_encoder() take, alone or beside null.
FLAT = frozenset({"boolean", "int", "long", "float", "double", "string", "bytes"})


def flat_fields(s: Schema) -> list[tuple[str, str, int | None]] | None:
    """Name, kind and place of null (0, 1, or None if it can't be) of each field of a record of flat fields; None if it isn't one. Logical types but
    timestamps and dates, which are plain numbers, aren't flat."""
    if kind_of(s) != "record":
        return None
    out = []
    for f in s["fields"]:
        branches = f["type"] if kind_of(f["type"]) == "union" else [f["type"]]
        kinds = [kind_of(b) for b in branches]
        rest = [b for b, k in zip(branches, kinds, strict=True) if k != "null"]
        if len(rest) != 1 or len(branches) > 2 or kind_of(rest[0]) not in FLAT:
            return None
        logical = rest[0].get("logicalType") if isinstance(rest[0], dict) else None
        if logical is not None and logical not in ("date", "timestamp-micros", "local-timestamp-micros"):
            return None
        out.append((f["name"], kind_of(rest[0]), kinds.index("null") if "null" in kinds else None))
    return out


_VARINT = """n = data[at]; at += 1
if n > 127:
    n &= 127; shift = 7
    while True:
        b = data[at]; at += 1
        n |= (b & 127) << shift
        if b < 128: break
        shift += 7
n = (n >> 1) ^ -(n & 1)
"""


def column_decoder(fields: list[tuple[str, str, int | None]], wanted: frozenset[str]) -> Callable[[bytes, int], dict[str, list]]:
    """A function made for a record: block and rows to lists of values, by column. Fields that aren't wanted are stepped over."""
    takes = {"boolean": "v = data[at] == 1; at += 1\n", "float": "v, = f4(data, at); at += 4\n", "double": "v, = f8(data, at); at += 8\n"}
    steps = {"boolean": "at += 1\n", "float": "at += 4\n", "double": "at += 8\n"}
    lines = ["def decode(data, rows):", "    at = 0", *[f"    c{i} = []; a{i} = c{i}.append" for i in range(len(fields))], "    for _ in range(rows):"]

    def put(text: str, depth: int) -> None:
        lines.extend("    " * depth + x for x in text.rstrip("\n").split("\n"))

    for i, (name, kind, null) in enumerate(fields):
        depth = 2
        if null is not None:
            put("b = data[at]; at += 1", 2)
            put(f"if b not in (0, 2): raise AvroError('no branch')\nif b == {2 * null}:\n    {f'a{i}(None)' if name in wanted else 'pass'}\nelse:", 2)
            depth = 3
        if kind in ("int", "long"):
            put(_VARINT + (f"a{i}(n)" if name in wanted else ""), depth)
        elif kind in ("string", "bytes"):
            put(_VARINT + "if n < 0 or at + n > len(data): raise AvroError('the data end early')\n" + (f"a{i}(data[at:at + n])\n" if name in wanted else "") + "at += n", depth)
        else:
            put(takes[kind] + f"a{i}(v)" if name in wanted else steps[kind], depth)
    lines.append("    if at != len(data): raise AvroError('rows and data differ')")
    lines.append("    return {" + ", ".join(f"{name!r}: c{i}" for i, (name, _, _) in enumerate(fields) if name in wanted) + "}")
    scope: dict[str, Any] = {"f4": struct.Struct("<f").unpack_from, "f8": struct.Struct("<d").unpack_from, "AvroError": AvroError}
    exec("\n".join(lines), scope)  # made of the schema's places and kinds; names come in as literals only
    return scope["decode"]


def column_encoder(fields: list[tuple[str, str, int | None]]) -> Callable[..., list[bytes]]:
    """A function made for a record: columns (lists; strings as bytes) to encoded rows."""
    names = ", ".join(f"v{i}" for i in range(len(fields)))
    lines = ["def encode(columns):", "    out = []", f"    for {names}{',' if len(fields) == 1 else ''} in zip(*columns):", "        p = []"]
    for i, (name, kind, null) in enumerate(fields):
        value = {"boolean": f"b'\\1' if v{i} else b'\\0'", "float": f"f4(v{i})", "double": f"f8(v{i})"}.get(kind, f"long(v{i})")
        if kind in ("string", "bytes"):
            puts = [f"p.append(long(len(v{i}))); p.append(v{i})"]
        else:
            puts = [f"p.append({value})"]
        if null is None:
            lines.append(f"        if v{i} is None: raise AvroError('null isn\\'t a branch')")
            lines += [f"        {x}" for x in puts]
        else:
            lines.append(f"        if v{i} is None: p.append(b'\\x{2 * null:02x}')")
            lines.append(f"        else: p.append(b'\\x{2 * (1 - null):02x}'); " + "; ".join(puts))
    lines += ["        out.append(b''.join(p))", "    return out"]
    cache = [write_long(n) for n in range(1 << 12)]
    scope: dict[str, Any] = {"f4": struct.Struct("<f").pack, "f8": struct.Struct("<d").pack, "AvroError": AvroError, "long": lambda n: cache[n] if 0 <= n < 4096 else write_long(n)}
    exec("\n".join(lines), scope)
    return scope["encode"]


# -- framed messages ---------------------------------------------------------------------------------------------


def frame(body: bytes, wire: str, key: bytes | int | None = None) -> bytes:
    """single (marker and fingerprint), confluent (4-byte id), apicurio (8-byte id) or raw."""
    return {"single": lambda: b"\xc3\x01" + key, "confluent": lambda: b"\0" + struct.pack(">I", key), "apicurio": lambda: b"\0" + struct.pack(">Q", key), "raw": lambda: b""}[wire]() + body


def unframe(message: bytes, wire: str) -> tuple[bytes | int | None, bytes]:
    if wire == "raw":
        return None, message
    size, marker = {"single": (10, b"\xc3\x01"), "confluent": (5, b"\0"), "apicurio": (9, b"\0")}[wire]
    if len(message) < size or not message.startswith(marker):
        raise AvroError(f"no {wire} message")
    key = message[len(marker) : size]
    return (key if wire == "single" else int.from_bytes(key, "big")), message[size:]


def to_bytes(schema: Schema, rows: list[Any], codec: str = "deflate") -> bytes:
    out = io.BytesIO()
    w = FileWriter(out, schema, codec)
    for row in rows:
        w.write(row)
    w.flush()
    return out.getvalue()
