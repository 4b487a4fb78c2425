import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tarnlake.sources import avro
from tarnlake.sources import avro_codec as codec


@pytest.mark.parametrize("compression", ["null", "deflate", "snappy", "zstandard"])
def test_round_trip(spark, tmp_path, compression):
    df = spark.createDataFrame(
        [(True, 1, 1 << 40, 1.5, 2.5, "é", b"\0", [1, None], {"a": 1.0}, (1, "x"), dt.date(1969, 1, 1), dt.datetime(2020, 1, 1, 1), decimal.Decimal("-1.25")), (None,) * 13],
        "b boolean, i int, l long, f float, d double, s string, y binary, a array<int>, m map<string,double>, r struct<p:int,q:string>, t date, n timestamp_ntz, c decimal(9,2)",
    )
    p = str(tmp_path / "a")
    avro.write(df, p, compression)
    assert sorted(map(repr, avro.read(spark, p).collect())) == sorted(map(repr, df.collect()))
    assert avro.read(spark, p, ["s", "i"]).columns == ["s", "i"] and avro.read(spark, p, [1]).columns == ["i"] and "m" not in avro.read(spark, p, skip=["m"]).columns
    avro.write(df.limit(1), p, compression, mode="overwrite")
    assert avro.read(spark, p).count() == 1


def test_resolution(spark, tmp_path):
    p = str(tmp_path / "a")
    avro.write(spark.createDataFrame([(1, "RED", "gone")], "id int, color string, extra string"), p, schema={"type": "record", "name": "R", "fields": [{"name": "id", "type": "int"}, {"name": "color", "type": {"type": "enum", "name": "C", "symbols": ["RED", "BLUE"]}}, {"name": "extra", "type": "string"}]})
    reader = {"type": "record", "name": "R", "fields": [{"name": "key", "aliases": ["id"], "type": "double"}, {"name": "color", "type": {"type": "enum", "name": "C", "symbols": ["BLUE", "NONE"], "default": "NONE"}}, {"name": "note", "type": ["null", "string"], "default": None}, {"name": "tags", "type": {"type": "array", "items": "int"}, "default": [7]}]}
    assert tuple(avro.read(spark, p, reader_schema=reader).first()) == (1.0, "NONE", None, [7])
    with pytest.raises(codec.AvroError):
        codec.resolver("string", "int")


def test_fingerprints_and_frames(spark):
    # the specification's own examples
    assert codec.fingerprint('"int"')[::-1].hex() == "7275d51a3f395c8f" and codec.fingerprint('"string"')[::-1].hex() == "8f014872634503c7"
    a = {"type": "record", "name": "M", "namespace": "x", "doc": "d", "fields": [{"name": "a", "type": "int"}]}
    assert codec.canonical(a) == '{"name":"x.M","type":"record","fields":[{"name":"a","type":"int"}]}'
    b = {**a, "fields": [*a["fields"], {"name": "b", "type": "string", "default": "?"}]}
    df = spark.range(3).select(F.struct(F.col("id").cast("int").alias("a")).alias("r"))
    store = codec.SchemaStore()
    store.register(a)
    for key in (7, 1 << 20):
        store.set(key, a)
    for wire, key in (("single", None), ("confluent", 7), ("apicurio", 1 << 20)):
        back = df.select(avro.encode(F.col("r"), a, wire, key).alias("m")).select(avro.decode(F.col("m"), b, wire, store).alias("v")).select("v.*")
        assert sorted(map(tuple, back.collect())) == [(0, "?"), (1, "?"), (2, "?")]
    broken = spark.createDataFrame([(b"\xc3\x01" + b"\0" * 9,), (b"",), (None,)], "m binary")
    assert [r[0] for r in broken.select(avro.decode(F.col("m"), b, "single", store)).collect()] == [None] * 3


def test_unions_and_blocks():
    s = {"type": "record", "name": "U", "fields": [{"name": "u", "type": ["int", "string", "null"]}]}
    rows = [{"u": {"tag": 0, "b0": 3}}, {"u": {"tag": 1, "b1": "x"}}]
    import io

    assert list(codec.read_rows(io.BytesIO(codec.to_bytes(s, rows)))) == rows
    r = codec.Reader(b"\x01\x02\x06\x00")  # an array block with a negative count and its size
    assert codec.decoder({"type": "array", "items": "int"})(r) == [3]


def test_parts_share_no_block():
    """However a file is cut into ranges, every block is read once."""
    import io

    schema = {"type": "record", "name": "r", "fields": [{"name": "i", "type": "long"}, {"name": "s", "type": ["null", "string"]}]}
    out = io.BytesIO()
    w = codec.FileWriter(out, schema, "null", block_bytes=60)
    for i in range(200):
        w.write({"i": i * 37 - 999, "s": None if i % 3 else "x" * (i % 50)})
    w.flush()
    data = out.getvalue()
    want = list(codec.read_rows(io.BytesIO(data)))
    assert len(want) == 200
    for step in (7, 16, 50, 333, len(data)):
        got = [r for at in range(0, len(data), step) for r in codec.read_rows(io.BytesIO(data), None, at, at + step)]
        assert got == want, step


@pytest.mark.parametrize("name", ["null", "deflate", "snappy", "zstandard", "lz4"])
def test_columns_as_rows(name):
    """The functions made for flat records agree with the general ones."""
    import io

    kinds = ["boolean", "int", "long", "float", "double", "string", "bytes"]
    schema = {"type": "record", "name": "r", "fields": [{"name": k, "type": k} for k in kinds] + [{"name": f"n{k}", "type": ["null", k]} for k in kinds] + [{"name": f"m{k}", "type": [k, "null"]} for k in kinds]}
    values = {"boolean": [True, False], "int": [0, -1, 2**31 - 1, -(2**31)], "long": [63, 64, -64, -65, 2**62, -(2**63)], "float": [0.5, -2.0], "double": [1e300, -0.0], "string": ["", "é" * 100, "x"], "bytes": [b"", b"\0\xff" * 90]}
    rows = [{p + k: (None if p and i % 4 == 1 else values[k][i % len(values[k])]) for p in ("", "n", "m") for k in kinds} for i in range(50)]
    data = codec.to_bytes(schema, rows, name)
    fields = codec.flat_fields(codec.parse(schema))
    (n, block), *more = codec.read_blocks(io.BytesIO(data))
    assert n == 50 and not more
    columns = codec.column_decoder(fields, frozenset(f for f, _, _ in fields))(block, n)
    plain = lambda v: v.decode() if isinstance(v, bytes) else v
    for f, k, _ in fields:
        got = columns[f] if k != "string" else [None if v is None else plain(v) for v in columns[f]]
        assert got == [r[f] for r in rows], f
    some = codec.column_decoder(fields, frozenset({"long", "mstring"}))(block, n)
    assert set(some) == {"long", "mstring"} and some["long"] == columns["long"] and some["mstring"] == columns["mstring"]
    packed = codec.column_encoder(fields)([[v.encode() if isinstance(v, str) else v for v in (r[f] for r in rows)] for f, _, _ in fields])
    assert b"".join(packed) == block
    with pytest.raises((codec.AvroError, IndexError)):
        codec.column_decoder(fields, frozenset())(block[:-1], n)


def test_general_unions():
    writer = ["null", "int", "string", {"type": "record", "name": "P", "fields": [{"name": "a", "type": "int"}]}]
    reader = ["string", "double", {"type": "record", "name": "P", "fields": [{"name": "a", "type": "long"}, {"name": "b", "type": "int", "default": 7}]}, "null"]
    fix = codec.resolver(codec.parse(writer), codec.parse(reader))
    assert fix({"tag": 0, "b0": None}) == {"tag": 3, "b3": None}
    assert fix({"tag": 1, "b1": 5}) == {"tag": 1, "b1": 5.0}
    assert fix({"tag": 2, "b2": "x"}) == {"tag": 0, "b0": "x"}
    assert fix({"tag": 3, "b3": {"a": 1}}) == {"tag": 2, "b2": {"a": 1, "b": 7}}
    # a plain type into a union and out of one; a branch that fits nothing fails with its value only
    assert codec.resolver("int", codec.parse(["null", "string", "long"]))(3) == {"tag": 2, "b2": 3}
    narrow = codec.resolver(codec.parse(["int", "string"]), "long")
    assert narrow({"tag": 0, "b0": 4}) == 4
    with pytest.raises(codec.AvroError):
        narrow({"tag": 1, "b1": "x"})
    same = codec.resolver(codec.parse(writer), codec.parse(writer))
    assert same({"tag": 2, "b2": "x"}) == {"tag": 2, "b2": "x"}
