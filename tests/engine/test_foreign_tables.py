"""Tables in the public layouts, made here without the engine, and the row sets of deletion vectors."""

import json
import struct

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tarnlake.operators.logtable import LogTable
from tarnlake.plans.expr import col
from tarnlake.sources import roaring

SCHEMA = json.dumps({"type": "struct", "fields": [{"name": "id", "type": "long", "nullable": True, "metadata": {}}, {"name": "region", "type": "string", "nullable": True, "metadata": {}}]})


@pytest.mark.parametrize("rows", [[], [0], [5, 17, 42], range(0, 200_000, 2), range(70_000), [1, (1 << 32) + 3, (5 << 32) + 7], np.random.default_rng(0).integers(0, 1 << 22, 90_000)])
def test_row_sets(rows):
    want = np.unique(np.array(list(rows), np.int64))
    data = roaring.encode(want)
    assert roaring.decode(data).tolist() == want.tolist()
    assert roaring.read_vector(roaring.vector_file(data), 1, len(data)).tolist() == want.tolist()
    text = roaring.z85_encode(data)
    assert roaring.z85_decode(text, len(data)) == data


def test_runs_and_broken_bytes():
    # by hand: one container of the runs 3..5 and 10..10
    runs = struct.pack("<I", roaring.WITH_RUNS) + b"\1" + struct.pack("<HH", 2, 3) + struct.pack("<HHHHH", 2, 3, 2, 10, 0)
    data = struct.pack("<iqi", roaring.ARRAY_MAGIC, 1, 0) + runs
    assert roaring.decode(data).tolist() == [(2 << 16) + x for x in (3, 4, 5, 10)]
    with pytest.raises(roaring.RoaringError):
        roaring.decode(struct.pack("<iq", 1, 0))
    file = bytearray(roaring.vector_file(roaring.encode(np.array([1, 2]))))
    file[-1] ^= 1
    with pytest.raises(roaring.RoaringError):
        roaring.read_vector(bytes(file), 1, len(file) - 9)
    # the published example of the text form
    assert roaring.z85_encode(bytes([0x86, 0x4F, 0xD2, 0x6F, 0xB5, 0x59, 0xF7, 0x5B])) == "HelloWorld"


def test_a_table_that_others_wrote(spark, tmp_path):
    root = tmp_path / "t"
    adds = []
    for k, region in enumerate(("us", "eu", None)):
        folder = root / f"region={region or '__HIVE_DEFAULT_PARTITION__'}"
        folder.mkdir(parents=True)
        pq.write_table(pa.table({"id": list(range(10 * k, 10 * k + 10))}), folder / "part-0.parquet")
        adds.append({"path": f"{folder.name}/part-0.parquet", "partitionValues": {"region": region}, "size": (folder / "part-0.parquet").stat().st_size, "modificationTime": 1, "dataChange": True, "stats": json.dumps({"numRecords": 10, "minValues": {"id": 10 * k}, "maxValues": {"id": 10 * k + 9}, "nullCount": {"id": 0}})})
    data = roaring.encode(np.array([0, 3]))
    adds[0]["deletionVector"] = {"storageType": "i", "pathOrInlineDv": roaring.z85_encode(data), "sizeInBytes": len(data), "cardinality": 2}
    log = root / "_delta_log"
    log.mkdir()
    protocol = {"minReaderVersion": 3, "minWriterVersion": 7, "readerFeatures": ["deletionVectors"], "writerFeatures": ["deletionVectors"]}
    meta = {"id": "x", "format": {"provider": "parquet", "options": {}}, "schemaString": SCHEMA, "partitionColumns": ["region"], "configuration": {}, "createdTime": 1}
    # a checkpoint in the public layout; the commits before it are gone
    rows = [{"protocol": protocol, "metaData": None, "add": None}, {"protocol": None, "metaData": meta, "add": None}, *({"protocol": None, "metaData": None, "add": a} for a in adds)]
    text = pa.string()
    vector = pa.struct([("storageType", text), ("pathOrInlineDv", text), ("offset", pa.int32()), ("sizeInBytes", pa.int32()), ("cardinality", pa.int64())])
    kinds = pa.schema([
        ("protocol", pa.struct([("minReaderVersion", pa.int32()), ("minWriterVersion", pa.int32()), ("readerFeatures", pa.list_(text)), ("writerFeatures", pa.list_(text))])),
        ("metaData", pa.struct([("id", text), ("format", pa.struct([("provider", text), ("options", pa.map_(text, text))])), ("schemaString", text), ("partitionColumns", pa.list_(text)), ("configuration", pa.map_(text, text)), ("createdTime", pa.int64())])),
        ("add", pa.struct([("path", text), ("partitionValues", pa.map_(text, text)), ("size", pa.int64()), ("modificationTime", pa.int64()), ("dataChange", pa.bool_()), ("stats", text), ("deletionVector", vector)])),
    ])
    for r in rows:
        if r["metaData"]:
            r["metaData"] = meta | {"configuration": [], "format": {"provider": "parquet", "options": []}}
        if r["add"]:
            r["add"] = r["add"] | {"partitionValues": list(r["add"]["partitionValues"].items())}
    pq.write_table(pa.Table.from_pylist(rows, kinds), log / f"{4:020d}.checkpoint.parquet")
    (log / f"{4:020d}.json").write_text(json.dumps({"commitInfo": {"timestamp": 5, "operation": "WRITE"}}) + "\n")
    (log / "_last_checkpoint").write_text(json.dumps({"version": 4, "size": 5}))
    t = LogTable.open(spark, str(root))
    read = lambda: sorted(((r.id, r.region) for r in t.read().collect()), key=str)
    want = [(i, r) for i, r in [(i, ("us", "eu", None)[i // 10]) for i in range(30)] if i not in (0, 3)]
    assert read() == sorted(want, key=str) and t.count() == 28
    assert len(t.plan(col("id").gt(25))) == 1 and sorted(r.id for r in t.read(["id"], col("region").eq("us") & col("id").lt(5)).collect()) == [1, 2, 4]
    # delete from it, add to it, and open it again through a checkpoint of one's own
    assert t.delete(col("id").isin(1, 15)) == (2, 5)
    t.write(spark.createDataFrame([(100, "us")], "id long, region string"))
    want = sorted([w for w in want if w[0] not in (1, 15)] + [(100, "us")], key=str)
    assert read() == want
    for how in ({}, {"v2": True}, {"parts": 3}, {"v2": True, "parts": 2}):
        t.checkpoint(**how)
        again = LogTable(spark, str(root))
        assert again._checkpoints()[6] and sorted(map(tuple, again.read().collect()), key=str) == want
        for n in again.store.names("_delta_log"):
            if n.startswith(f"{6:020d}.checkpoint"):
                again.store.delete(f"_delta_log/{n}")
