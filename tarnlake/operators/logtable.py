"""A table kept as a log of actions: versions, merge-on-read deletes, change feed, checkpoints, schema features.

The log holds JSON actions, one commit per file, created exclusively, and checkpoints and deletion vectors in the public layouts. Data files are
Parquet. Only actions and paths are handled on the driver.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.registry import DEFAULT, Registry
from tarnlake.operators import stats as st
from tarnlake.operators.rows import BATCH, PATH, ROW, Batches, changed_by, flagged, numbered, read_files, read_placed, without
from tarnlake.operators.storage import ConflictError, Entry, Store, now_ms
from tarnlake.plans import compile as comp
from tarnlake.plans.expr import Expr
from tarnlake.plans.prune import ColumnStats, can_match, decision
from tarnlake.sources import roaring
from tarnlake.sources.files import with_settings
from tarnlake.sources.avro import open_fs

LOG = "_delta_log"
HIT = "__hit"
READER, WRITER = 3, 7
FEATURES = frozenset({"deletionVectors", "columnMapping", "typeWidening", "timestampNtz", "v2Checkpoint", "changeDataFeed", "identityColumns", "rowTracking", "inCommitTimestamp", "domainMetadata", "appendOnly", "invariants", "icebergCompatV1", "icebergCompatV2", "vacuumProtocolCheck"})
ID, PHYSICAL = "delta.columnMapping.id", "delta.columnMapping.physicalName"
IDENTITY = "delta.identity."
CHECKPOINT_EVERY = 10
#: Type changes that keep old files readable: from, to.
WIDER = {"byte": ("short", "integer", "long", "double"), "short": ("integer", "long", "double"), "integer": ("long", "double"), "float": ("double",), "date": ("timestamp_ntz",)}
INTEGERS = {"byte": 3, "short": 5, "integer": 10, "long": 20}


_VECTOR = "deletionVector:struct<storageType:string,pathOrInlineDv:string,offset:int,sizeInBytes:int,cardinality:long>"
#: Columns of a checkpoint, by kind of action. Fixed values of the public layout.
ACTION_TYPES = {
    "protocol": "struct<minReaderVersion:int,minWriterVersion:int,readerFeatures:array<string>,writerFeatures:array<string>>",
    "metaData": "struct<id:string,name:string,description:string,format:struct<provider:string,options:map<string,string>>,schemaString:string,partitionColumns:array<string>,configuration:map<string,string>,createdTime:long>",
    "add": f"struct<path:string,partitionValues:map<string,string>,size:long,modificationTime:long,dataChange:boolean,stats:string,tags:map<string,string>,{_VECTOR},baseRowId:long,defaultRowCommitVersion:long>",
    "remove": f"struct<path:string,deletionTimestamp:long,dataChange:boolean,extendedFileMetadata:boolean,partitionValues:map<string,string>,size:long,stats:string,{_VECTOR},baseRowId:long,defaultRowCommitVersion:long>",
    "txn": "struct<appId:string,version:long,lastUpdated:long>",
    "domainMetadata": "struct<domain:string,configuration:string,removed:boolean>",
    "sidecar": "struct<path:string,sizeInBytes:long,modificationTime:long>",
    "checkpointMetadata": "struct<version:long>",
}
ACTIONS = ", ".join(f"{k} {v}" for k, v in ACTION_TYPES.items())


class ProtocolError(RuntimeError):
    """The table asks for what this engine doesn't do."""


def can_widen(old: T.DataType, new: T.DataType) -> bool:
    a, b = old.typeName(), new.typeName()
    if isinstance(new, T.DecimalType):
        if isinstance(old, T.DecimalType):
            return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
        return a in INTEGERS and new.precision - new.scale >= INTEGERS[a]
    return b in WIDER.get(a, ())


@dataclass(frozen=True)
class Snapshot:
    version: int
    protocol: Mapping
    metadata: Mapping
    files: Mapping[tuple, Mapping]
    gone: Mapping[tuple, Mapping] = field(default_factory=dict)
    txns: Mapping[str, int] = field(default_factory=dict)
    domains: Mapping[str, str] = field(default_factory=dict)
    timestamp: int = 0

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.metadata["schemaString"]))

    @property
    def partitions(self) -> list[str]:
        return list(self.metadata.get("partitionColumns", []))

    @property
    def config(self) -> Mapping[str, str]:
        return self.metadata.get("configuration", {})


def _records(action: Mapping) -> int | None:
    return json.loads(action.get("stats") or "{}").get("numRecords")


def file_key(action: Mapping) -> tuple:
    dv = action.get("deletionVector")
    return action["path"], dv and f"{dv['storageType']}{dv['pathOrInlineDv']}@{dv.get('offset')}"


def replay(base: Snapshot | None, version: int, actions: Sequence[Mapping]) -> Snapshot:
    """The snapshot after one commit: per file and deletion vector, per key, the latest action wins."""
    s = base or Snapshot(-1, {}, {}, {})
    files, gone, txns, domains = dict(s.files), dict(s.gone), dict(s.txns), dict(s.domains)
    protocol, metadata, stamp = s.protocol, s.metadata, s.timestamp
    for action in actions:
        (kind, body), = action.items()
        if kind == "add":
            files[file_key(body)] = body
            gone.pop(file_key(body), None)
        elif kind == "remove":
            files.pop(file_key(body), None)
            gone[file_key(body)] = body
        elif kind == "protocol":
            protocol = body
        elif kind == "metaData":
            metadata = body
        elif kind == "txn":
            txns[body["appId"]] = body["version"]
        elif kind == "domainMetadata":
            domains.pop(body["domain"], None) if body.get("removed") else domains.update({body["domain"]: body["configuration"]})
        elif kind == "commitInfo":
            stamp = body.get("inCommitTimestamp", body.get("timestamp", stamp))
    return Snapshot(version, protocol, metadata, files, gone, txns, domains, stamp)


def snapshot_actions(s: Snapshot) -> list[dict]:
    return [
        {"protocol": s.protocol}, {"metaData": s.metadata},
        *({"txn": {"appId": k, "version": v}} for k, v in s.txns.items()), *({"domainMetadata": {"domain": k, "configuration": v, "removed": False}} for k, v in s.domains.items()),
        *({"add": a} for a in s.files.values()), *({"remove": r} for r in s.gone.values()),
    ]


def compat(s: Snapshot) -> list[str]:
    """The snapshot-table compatibility modes that are on."""
    return [v for v in ("V1", "V2") if s.config.get(f"delta.enableIcebergCompat{v}") == "true"]


def check_compat(s: Snapshot, schema: T.StructType) -> None:
    """What the snapshot-table compatibility modes ask for."""
    for version in compat(s):
        if s.config.get("delta.columnMapping.mode", "none") == "none":
            raise ProtocolError(f"compat {version} needs column mapping")
        if s.config.get("delta.enableDeletionVectors") == "true" or "deletionVectors" in s.protocol.get("writerFeatures", []) or any(a.get("deletionVector") for a in s.files.values()):
            raise ProtocolError(f"compat {version} excludes deletion vectors")
        kinds = {f.dataType.typeName() for f in schema.fields}
        if "void" in kinds or version == "V1" and kinds & {"map", "array"}:
            raise ProtocolError(f"compat {version}: column types {sorted(kinds)}")


class LogTable:
    def __init__(self, spark: SparkSession, path: str, registry: Registry = DEFAULT) -> None:
        self.spark, self.store, self.registry = spark, Store(spark, path), registry
        self._latest: Snapshot | None = None

    # -- opening ------------------------------------------------------------------------------------------

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType, partition_by: Sequence[str] = (), config: Mapping[str, str] | None = None, mapping: str = "none") -> LogTable:
        table, config = cls(spark, path), dict(config or {})
        if unknown := set(partition_by) - set(schema.fieldNames()):
            raise ValueError(f"no partition columns {sorted(unknown)}")
        features = {"deletionVectors", "inCommitTimestamp", "domainMetadata"}
        if on := compat(Snapshot(-1, {}, {"configuration": config}, {})):
            features = features - {"deletionVectors"} | {f"icebergCompat{v}" for v in on}
        if mapping not in ("none", "id", "name"):
            raise ValueError("mapping: none, id or name")
        if mapping != "none":
            config |= {"delta.columnMapping.mode": mapping, "delta.columnMapping.maxColumnId": str(len(schema.fields))}
            schema = T.StructType([T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, ID: k, PHYSICAL: f"col-{uuid.uuid4()}"}) for k, f in enumerate(schema.fields, 1)])
            features.add("columnMapping")
        metadata = {"id": str(uuid.uuid4()), "schemaString": schema.json(), "partitionColumns": list(partition_by), "configuration": config, "createdTime": now_ms(), "format": {"provider": "parquet"}}
        protocol = {"minReaderVersion": READER, "minWriterVersion": WRITER, "readerFeatures": sorted(features & {"deletionVectors", "columnMapping"}), "writerFeatures": sorted(features)}
        check_compat(Snapshot(-1, protocol, metadata, {}), schema)
        table._commit(None, "CREATE TABLE", [{"protocol": protocol}, {"metaData": metadata}])
        return table

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> LogTable:
        table = cls(spark, path)
        if table.latest_version() < 0:
            raise FileNotFoundError(path)
        table.refresh()
        return table

    @classmethod
    def open_or_create(cls, spark: SparkSession, path: str, schema: T.StructType, partition_by: Sequence[str] = (), config: Mapping[str, str] | None = None) -> LogTable:
        return cls.open(spark, path) if cls(spark, path).latest_version() >= 0 else cls.create(spark, path, schema, partition_by, config)

    def versions(self) -> list[int]:
        return [int(n[:20]) for n in self.store.names(LOG) if n.endswith(".json") and len(n) == 25]

    def latest_version(self) -> int:
        return max(self.versions(), default=-1)

    def refresh(self) -> Snapshot:
        self._latest = self.snapshot()
        return self._latest

    @property
    def current(self) -> Snapshot:
        return self._latest or self.refresh()

    def commit_actions(self, version: int) -> list[dict]:
        return [json.loads(line) for line in self.store.read(f"{LOG}/{version:020d}.json").splitlines() if line]

    def snapshot(self, version: int | None = None, timestamp: int | None = None) -> Snapshot:
        """The state at a version, or after the last commit at or before a time in milliseconds."""
        if timestamp is not None:
            version = -1
            for v in self.versions():
                stamp = next((a["commitInfo"]["inCommitTimestamp"] for a in self.commit_actions(v) if "commitInfo" in a), None)
                if stamp is None:
                    raise ValueError("commits carry no timestamps")
                if stamp > timestamp:
                    break
                version = v
            if version < 0:
                raise ValueError("no version is that old")
        latest = self.latest_version()
        goal = latest if version is None else version
        if not 0 <= goal <= latest:
            raise ValueError(f"no version {goal}; the latest is {latest}")
        s = self._latest if self._latest and self._latest.version <= goal else None
        if s is None:
            s = self._from_checkpoint(goal)
        compacted = self._compacted()
        v = (s.version if s else -1) + 1
        while v <= goal:
            end = next((e for (a, e) in compacted if a == v and e <= goal), None)
            if end is not None:
                s = replay(s, end, [json.loads(x) for x in self.store.read(f"{LOG}/{v:020d}.{end:020d}.compacted.json").splitlines()])
                v = end + 1
            else:
                s = replay(s, v, self.commit_actions(v))
                v += 1
        self._gate(s.protocol)
        return s

    @staticmethod
    def _gate(protocol: Mapping) -> None:
        unknown = set(protocol.get("readerFeatures", [])) - FEATURES
        if protocol.get("minReaderVersion", 1) > READER or unknown:
            raise ProtocolError(f"reader version {protocol.get('minReaderVersion')}, features {sorted(unknown)}")

    @staticmethod
    def _gate_write(protocol: Mapping) -> None:
        unknown = set(protocol.get("writerFeatures", [])) - FEATURES
        if protocol.get("minWriterVersion", 1) > WRITER or unknown:
            raise ProtocolError(f"writer version {protocol.get('minWriterVersion')}, features {sorted(unknown)}")

    # -- the log ------------------------------------------------------------------------------------------

    def _commit(self, base: Snapshot | None, operation: str, actions: Sequence[Mapping]) -> int:
        if base is not None:
            self._gate_write(base.protocol)
        version = base.version + 1 if base else 0
        stamp = max(now_ms(), (base.timestamp + 1) if base else 0)
        info = {"commitInfo": {"timestamp": stamp, "inCommitTimestamp": stamp, "operation": operation}}
        self.store.create(f"{LOG}/{version:020d}.json", "\n".join(json.dumps(a) for a in [info, *actions]) + "\n")
        self._latest = replay(base, version, [info, *actions])
        if version and version % CHECKPOINT_EVERY == 0:
            self.checkpoint()
        return version

    def checkpoint(self, parts: int = 1, v2: bool = False) -> int:
        """Write the whole state, tombstones included, in the public layout: one file or several. v2: files go to sidecars that a small main file names."""
        s = self.current
        name = f"{LOG}/{s.version:020d}.checkpoint"
        actions = snapshot_actions(s)
        info = {"version": s.version, "size": len(actions)}
        if v2:
            inside = [a for a in actions if not a.keys() & {"add", "remove"}]
            sidecars = self._write_actions([a for a in actions if a.keys() & {"add", "remove"}], [f"{LOG}/_sidecars/{uuid.uuid4()}.parquet" for _ in range(parts)])
            inside += [{"checkpointMetadata": {"version": s.version}}, *({"sidecar": {"path": e.path.rpartition("/")[2], "sizeInBytes": e.size, "modificationTime": e.modified}} for e in sidecars)]
            self._write_actions(inside, [f"{name}.{uuid.uuid4()}.parquet"])
        elif parts > 1:
            self._write_actions(actions, [f"{name}.{k:010d}.{parts:010d}.parquet" for k in range(1, parts + 1)])
            info["parts"] = parts
        else:
            self._write_actions(actions, [f"{name}.parquet"])
        self.store.write(f"{LOG}/_last_checkpoint", json.dumps(info))
        return s.version

    def _write_actions(self, actions: Sequence[Mapping], names: Sequence[str]) -> list[Entry]:
        """Actions as Parquet files of those names, a column to each kind."""
        stage = f"{LOG}/_stage-{uuid.uuid4().hex}"
        rows = [json.dumps(a) for a in actions]
        df = self.spark.createDataFrame([(r, k % len(names)) for k, r in enumerate(rows)], "body string, part int").select("part", F.from_json("body", ACTIONS).alias("a"))
        df.repartitionByRange(len(names), "part").select("a.*").write.parquet(self.store.uri(stage))
        found = [e.path for e in self.store.walk(stage) if e.path.endswith(".parquet")]
        for e, name in zip(found, names, strict=False):
            self.store.move(e, name)
        for name in names[len(found) :]:  # parts without rows
            self.spark.createDataFrame([], ACTIONS).coalesce(1).write.parquet(self.store.uri(f"{stage}/empty"))
            self.store.move(next(e.path for e in self.store.walk(f"{stage}/empty") if e.path.endswith(".parquet")), name)
            self.store.delete(f"{stage}/empty")
        self.store.delete(stage)
        return [e for e in self.store.walk(LOG) if e.path in set(names)]

    def _checkpoints(self) -> dict[int, list[str]]:
        """Complete checkpoints by version: their main files."""
        out: dict[int, list[str]] = {}
        several: dict[tuple[int, int], list[str]] = {}
        for n in self.store.names(LOG):
            m = re.fullmatch(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10})|\.([0-9a-f-]{36}))?\.(parquet|json)", n)
            if m and m[2]:
                several.setdefault((int(m[1]), int(m[3])), []).append(n)
            elif m:
                out.setdefault(int(m[1]), [n])
        return out | {v: names for (v, many), names in several.items() if len(names) == many}

    def _from_checkpoint(self, goal: int) -> Snapshot | None:
        found = {v: names for v, names in self._checkpoints().items() if v <= goal}
        if not found:
            return None
        version = max(found)
        actions = self._read_actions([f"{LOG}/{n}" for n in found[version]])
        if sidecars := [a["sidecar"]["path"] for a in actions if "sidecar" in a]:
            actions += self._read_actions([f"{LOG}/_sidecars/{p}" for p in sidecars])
        if f"{version:020d}.json" in self.store.names(LOG):  # checkpoints carry no times
            actions += [a for a in self.commit_actions(version) if "commitInfo" in a]
        return replay(None, version, [a for a in actions if not a.keys() & {"sidecar", "checkpointMetadata"}])

    def _read_actions(self, paths: Sequence[str]) -> list[dict]:
        if paths[0].endswith(".json"):
            return [json.loads(line) for p in paths for line in self.store.read(p).splitlines() if line]
        df = self.spark.read.parquet(*map(self.store.uri, paths))
        kinds = [c for c in df.columns if c in ACTION_TYPES]
        rows = df.select(*[F.to_json(F.col(c)).alias(c) for c in kinds]).collect()
        return [{c: json.loads(r[c])} for r in rows for c in kinds if r[c] is not None]

    def _compacted(self) -> list[tuple[int, int]]:
        return sorted(((int(n[:20]), int(n[21:41])) for n in self.store.names(LOG) if n.endswith(".compacted.json")), key=lambda x: (x[0], -x[1]))

    def compact_log(self, start: int, end: int) -> None:
        """Fold a range of commits into one file that replay may use in their stead; protocol and metadata stay in it."""
        last: dict[tuple, dict] = {}
        for v in range(start, end + 1):
            for action in self.commit_actions(v):
                (kind, body), = action.items()
                key = ("file", *file_key(body)) if kind in ("add", "remove") else ("txn", body["appId"]) if kind == "txn" else ("domain", body["domain"]) if kind == "domainMetadata" else (kind,)
                if kind != "cdc":
                    last[key] = action
        self.store.create(f"{LOG}/{start:020d}.{end:020d}.compacted.json", "\n".join(map(json.dumps, last.values())) + "\n")

    # -- schema -------------------------------------------------------------------------------------------

    @staticmethod
    def physical(s: Snapshot) -> dict[str, str]:
        return {f.name: f.metadata.get(PHYSICAL, f.name) if s.config.get("delta.columnMapping.mode", "none") != "none" else f.name for f in s.schema.fields}

    def _physical_schema(self, s: Snapshot) -> T.StructType:
        names = self.physical(s)
        return T.StructType([T.StructField(names[f.name], f.dataType, True) for f in s.schema.fields])

    def _alter(self, operation: str, fields: Sequence[T.StructField], config: Mapping[str, str] | None = None, feature: str | None = None, partitions: Sequence[str] | None = None) -> int:
        s = self.current
        schema = T.StructType(list(fields))
        metadata = {**s.metadata, "schemaString": schema.json(), "configuration": {**s.config, **(config or {})}, "partitionColumns": list(partitions if partitions is not None else s.partitions)}
        check_compat(replace(s, metadata=metadata), schema)
        actions: list[dict] = [{"metaData": metadata}]
        if feature and feature not in s.protocol["writerFeatures"]:
            actions.insert(0, {"protocol": {**s.protocol, "writerFeatures": sorted([*s.protocol["writerFeatures"], feature])}})
        return self._commit(s, operation, actions)

    def widen(self, column: str, new: T.DataType) -> int:
        """Change a column to a wider type; old files are cast as they are read."""
        s = self.current
        old = s.schema[column]
        if not can_widen(old.dataType, new):
            raise ValueError(f"{column}: {old.dataType.simpleString()} doesn't widen to {new.simpleString()}")
        changes = [*old.metadata.get("delta.typeChanges", []), {"fromType": old.dataType.simpleString(), "toType": new.simpleString()}]
        fields = [T.StructField(f.name, new, f.nullable, {**f.metadata, "delta.typeChanges": changes}) if f.name == column else f for f in s.schema.fields]
        return self._alter("CHANGE COLUMN", fields, feature="typeWidening")

    def rename(self, old: str, new: str) -> int:
        s = self.current
        if s.config.get("delta.columnMapping.mode", "none") == "none":
            raise ValueError("renaming needs column mapping")
        if new in s.schema.fieldNames():
            raise ValueError(f"there is a column {new}")
        fields = [T.StructField(new if f.name == old else f.name, f.dataType, f.nullable, f.metadata) for f in s.schema.fields]
        return self._alter("RENAME COLUMN", fields, partitions=[new if p == old else p for p in s.partitions])

    def add_column(self, name: str, kind: T.DataType) -> int:
        s = self.current
        meta, config = {}, {}
        if s.config.get("delta.columnMapping.mode", "none") != "none":
            top = int(s.config["delta.columnMapping.maxColumnId"]) + 1
            meta, config = {ID: top, PHYSICAL: f"col-{uuid.uuid4()}"}, {"delta.columnMapping.maxColumnId": str(top)}
        return self._alter("ADD COLUMNS", [*s.schema.fields, T.StructField(name, kind, True, meta)], config)

    # -- reading ------------------------------------------------------------------------------------------

    def files_frame(self, s: Snapshot) -> DataFrame:
        """Live files with typed statistics: path, dv, rows, and a struct per column."""
        names, schema = self.physical(s), s.schema
        rows = [(a["path"], (a.get("deletionVector") or {}).get("pathOrInlineDv"), _records(a), a["partitionValues"], a.get("stats") or "{}") for a in s.files.values()]
        df = self.spark.createDataFrame(rows, "path string, dv string, rows long, parts map<string,string>, stats string")
        data = [f for f in schema.fields if f.name not in s.partitions and st.has_bounds(f.dataType)]
        bounds = T.StructType([T.StructField(names[f.name], f.dataType) for f in data])
        counts = T.StructType([T.StructField(names[f.name], T.LongType()) for f in schema.fields if f.name not in s.partitions])
        inner = T.StructType([T.StructField("minValues", bounds), T.StructField("maxValues", bounds), T.StructField("nullCount", counts), T.StructField("nanCount", counts), T.StructField("tightBounds", T.BooleanType()), T.StructField("inexact", T.ArrayType(T.StringType()))])
        df = df.withColumn("s", F.from_json("stats", inner))
        columns = []
        for f in schema.fields:
            p = names[f.name]
            if f.name in s.partitions:
                v = F.try_element_at("parts", F.lit(p)).try_cast(f.dataType)
                n = F.when(v.isNull(), F.col("rows")).otherwise(0)
                columns.append(F.struct(v.alias("min"), v.alias("max"), n.cast("long").alias("nulls"), F.lit(0).cast("long").alias("nans"), F.lit(True).alias("exact")).alias(f.name))
            else:
                nulls, nans = F.col("s.nullCount")[p].alias("nulls"), F.col("s.nanCount")[p].alias("nans")
                if f in data:
                    exact = ~F.coalesce(F.array_contains("s.inexact", p), F.lit(False)) & F.col("dv").isNull()
                    columns.append(F.struct(F.col("s.minValues")[p].alias("min"), F.col("s.maxValues")[p].alias("max"), nulls, nans, exact.alias("exact")).alias(f.name))
                else:
                    columns.append(F.struct(nulls, nans).alias(f.name))
        return df.select("path", "dv", "rows", *columns)

    def _accessor(self, frame: DataFrame):
        find = st.accessor(frame.schema)

        def with_deletes(name: str) -> ColumnStats | None:
            # deleted rows leave counts too high, and bounds loose
            s = find(name)
            if s is None:
                return None
            live = F.col("dv").isNull()
            return ColumnStats(s.low, s.high, F.when(live | (s.nulls == 0) | (s.nulls == F.col("rows")), s.nulls), F.when(live | (s.nans == 0), s.nans) if s.nans is not None else None, s.exact)

        return with_deletes

    def plan(self, filter_: Expr | None = None, snapshot: Snapshot | None = None) -> list[Mapping]:
        """The live files that can hold matching rows."""
        s = snapshot or self.current
        if filter_ is None or not s.files:
            return list(s.files.values())
        frame = self.files_frame(s)
        kept = {r["path"] for r in frame.filter(can_match(filter_, s.schema, F.col("rows"), self._accessor(frame))).select("path").collect()}
        return [a for a in s.files.values() if a["path"] in kept]

    def count(self) -> int:
        """Live rows, by the statistics and the deletion vectors of the log."""
        if any(_records(a) is None for a in self.current.files.values()):
            return self.read().count()
        return sum(_records(a) - (a.get("deletionVector") or {}).get("cardinality", 0) for a in self.current.files.values())

    def decisions(self, filter_: Expr, snapshot: Snapshot | None = None) -> DataFrame:
        s = snapshot or self.current
        frame = self.files_frame(s)
        return frame.select("path", "rows", decision(filter_, s.schema, F.col("rows"), self._accessor(frame)).alias("decision"))

    def _deleted(self, adds: Sequence[Mapping]) -> DataFrame | None:
        """(path, row) of the rows that deletion vectors name; the vectors are read and unpacked where the tasks run."""
        found = [(a["path"], v["storageType"], v["pathOrInlineDv"], v.get("offset") or 0, v["sizeInBytes"]) for a in adds if (v := a.get("deletionVector"))]
        if not found:
            return None
        root = self.store.root
        files = self.spark.createDataFrame(found, "path string, kind string, place string, offset int, size int")

        def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for path, kind, place, offset, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if kind == "i":
                        rows = roaring.decode(roaring.z85_decode(place, size))
                    else:
                        fs, at = open_fs(place if kind == "p" else f"{root}/{roaring.vector_path(place)}")
                        with fs.open_input_file(at) as f:
                            f.seek(offset)
                            rows = roaring.read_vector(f.read(size + 8), 0, size)
                    for lo in range(0, len(rows), 100_000):
                        own = rows[lo : lo + 100_000]
                        yield pa.RecordBatch.from_arrays([pa.array([path] * len(own), pa.string()), pa.array(own)], names=["path", "row"])

        return files.mapInArrow(unpack, "path string, row long")

    def _live(self, s: Snapshot, adds: Sequence[Mapping], addresses: bool = False) -> DataFrame:
        """Live rows of some files under their logical names. Only files that have a deletion vector are joined with it."""
        names, df = self.physical(s), None
        own = lambda a: a["path"].startswith(f"data/{BATCH}=")
        for marked in (False, True):
            for ours in (True, False):  # files that others wrote lie where they like
                some = [a for a in adds if bool(a.get("deletionVector")) == marked and own(a) == ours]
                if not some and (marked or not ours or len(adds)):
                    continue
                if ours:
                    part = read_files(self.store, self.spark, [a["path"] for a in some], self._physical_schema(s), addresses or marked)
                else:
                    part = read_placed(self.store, self.spark, [(a["path"], a["partitionValues"]) for a in some], self._physical_schema(s), [names[p] for p in s.partitions], addresses or marked)
                if marked:
                    part = without(part, self._deleted(some), [a["path"] for a in some], sum(a["deletionVector"]["cardinality"] for a in some))
                    part = part if addresses else part.drop(PATH, ROW)
                df = part if df is None else df.unionByName(part)
        return df.select(*[F.col(f"`{names[f.name]}`").alias(f.name) for f in s.schema.fields], *([PATH, ROW] if addresses else []))

    def read(self, columns: list[str] | None = None, filter_: Expr | None = None, version: int | None = None, timestamp: int | None = None) -> DataFrame:
        """Rows at a version or time, pruned by file and then filtered exactly."""
        s = self.current if version is None and timestamp is None else self.snapshot(version, timestamp)
        return comp.apply(self._live(s, self.plan(filter_, s)), filter_, columns, self.registry)

    def read_with_row_ids(self) -> DataFrame:
        """All rows with _row_id, stable while rows aren't rewritten, and _row_commit_version."""
        s = self.current
        base = self.spark.createDataFrame([(a["path"], a["baseRowId"], a["defaultRowCommitVersion"]) for a in s.files.values()], f"{PATH} string, base long, _row_commit_version long")
        return self._live(s, list(s.files.values()), True).join(base, PATH).withColumn("_row_id", F.col("base") + F.col(ROW)).drop(PATH, ROW, "base")

    # -- writing ------------------------------------------------------------------------------------------

    def _stats(self, files: DataFrame, schema: T.StructType, parts: Sequence[str]) -> tuple[dict[str, str], dict[str, dict]]:
        """Statistics and partition values of each file, in one pass."""
        out, values = {}, {}
        for r in files.groupBy(PATH).agg(*st.aggregates(schema), *[F.first(F.col(f"`{p}`").cast("string")).alias(p) for p in parts]).collect():  # one row per file
            values[r[PATH]] = {p: r[p] for p in parts}
            low, high, nulls, nans, inexact = {}, {}, {}, {}, []
            for f in schema.fields:
                c = r[f.name].asDict()
                nulls[f.name], nans[f.name] = c["nulls"], c["nans"]
                if c.get("min") is not None:
                    low[f.name], high[f.name] = (v if isinstance(v, int | float | bool | str) else str(v) for v in (c["min"], c["max"]))
                    if not c["exact"]:
                        inexact.append(f.name)
            out[r[PATH]] = json.dumps({"numRecords": r["rows"], "minValues": low, "maxValues": high, "nullCount": nulls, "nanCount": nans, "inexact": inexact, "tightBounds": True})
        return out, values

    def _write_files(self, s: Snapshot, df: DataFrame, data_change: bool = True) -> list[dict]:
        """Write rows (logical names) as new files; gives their add actions."""
        names = self.physical(s)
        parts = [names[p] for p in s.partitions]
        folder = f"data/{BATCH}={uuid.uuid4().hex}"
        out = df.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(names[f.name]) for f in s.schema.fields])
        (out.write.partitionBy(*parts) if parts else out.write).parquet(self.store.uri(folder))
        found = [e for e in self.store.walk(folder) if e.path.endswith(".parquet")]
        data = T.StructType([f for f in self._physical_schema(s).fields if f.name not in parts])
        # else each file of many is listed by a task of its own
        listing = with_settings(self.spark, {"spark.sql.sources.parallelPartitionDiscovery.parallelism": 8 * self.spark.sparkContext.defaultParallelism})
        stats, values = self._stats(read_files(self.store, listing, [e.path for e in found], self._physical_schema(s), True), data, parts) if found else ({}, {})
        high = int(json.loads(s.domains.get("delta.rowTracking", '{"rowIdHighWaterMark": -1}'))["rowIdHighWaterMark"]) + 1
        adds = []
        for e in found:
            if e.path not in stats:  # no rows
                continue
            adds.append({"path": e.path, "partitionValues": values[e.path], "size": e.size, "modificationTime": e.modified, "dataChange": data_change, "stats": stats[e.path], "baseRowId": high, "defaultRowCommitVersion": s.version + 1})
            high += json.loads(stats[e.path])["numRecords"]
        self._next_row_id = high
        return adds

    def _tracking(self, s: Snapshot) -> list[dict]:
        return [{"domainMetadata": {"domain": "delta.rowTracking", "configuration": json.dumps({"rowIdHighWaterMark": self._next_row_id - 1}), "removed": False}}]

    @staticmethod
    def _remove(add: Mapping, data_change: bool = True) -> dict:
        return {"remove": {"path": add["path"], "deletionTimestamp": now_ms(), "dataChange": data_change, "partitionValues": add["partitionValues"], "size": add["size"], "stats": add.get("stats"), **({"deletionVector": add["deletionVector"]} if add.get("deletionVector") else {})}}

    def _identity(self, s: Snapshot, df: DataFrame) -> tuple[DataFrame, list[dict]]:
        """Fill generated columns; their high-water marks move in the schema."""
        own = [f for f in s.schema.fields if IDENTITY + "step" in f.metadata]
        if not own:
            return df, []
        fields, marks = list(s.schema.fields), {}
        missing = [f for f in own if f.name not in df.columns]
        for f in own:
            if f.name in df.columns and not f.metadata.get(IDENTITY + "allowExplicitInsert", False):
                raise ValueError(f"{f.name} is generated")
        if missing:
            df = numbered(self.store, df, "__n")
            n = df.count()
        for f in own:
            start, step, mark = f.metadata[IDENTITY + "start"], f.metadata[IDENTITY + "step"], f.metadata.get(IDENTITY + "highWaterMark")
            if f in missing:
                first = start if mark is None else mark + step
                df = df.withColumn(f.name, (F.lit(first) + F.lit(step) * F.col("__n")).cast(f.dataType))
                marks[f.name] = first + step * (n - 1) if n else mark
            else:
                top = df.agg((F.max if step > 0 else F.min)(f.name)).first()[0]
                marks[f.name] = top if mark is None else mark if top is None else max(top, mark) if step > 0 else min(top, mark)
        fields = [T.StructField(f.name, f.dataType, f.nullable, {**f.metadata, IDENTITY + "highWaterMark": marks[f.name]}) if marks.get(f.name) is not None else f for f in fields]
        return df.drop("__n"), [{"metaData": {**s.metadata, "schemaString": T.StructType(fields).json()}}]

    def write(self, df: DataFrame, mode: str = "append", txn: tuple[str, int] | None = None) -> int:
        """Append or overwrite. txn (application, version): a repeat of one that is in already does nothing."""
        s = self.current
        if mode not in ("append", "overwrite"):
            raise ValueError("mode: append or overwrite")
        if txn and s.txns.get(txn[0], -1) >= txn[1]:
            return s.version
        df, schema_actions = self._identity(s, df)
        if set(df.columns) != set(s.schema.fieldNames()):
            raise ValueError(f"columns {df.columns} don't match {s.schema.fieldNames()}")
        adds = self._write_files(s, df)
        if schema_actions:
            self.store.delete("_stage")
        removes = [self._remove(a) for a in s.files.values()] if mode == "overwrite" else []
        actions = [*schema_actions, *removes, *({"add": a} for a in adds), *self._tracking(s)]
        if txn:
            actions.append({"txn": {"appId": txn[0], "version": txn[1], "lastUpdated": now_ms()}})
        for _ in range(20 if mode == "append" and not schema_actions else 1):
            try:
                return self._commit(s, "WRITE", actions)
            except ConflictError:  # a blind append holds whatever came before it
                s = self.refresh()
                if txn and s.txns.get(txn[0], -1) >= txn[1]:
                    return s.version
                if mode != "append" or schema_actions:
                    raise
        raise ConflictError("append")

    def _matches(self, s: Snapshot, filter_: Expr | Column | Batches) -> tuple[list[Mapping], DataFrame]:
        candidates = self.plan(filter_, s) if isinstance(filter_, Expr) else list(s.files.values())
        if not isinstance(filter_, Expr | Column):
            return candidates, flagged(self._live(s, candidates, True), filter_, HIT).filter(HIT).drop(HIT)
        return candidates, comp.apply(self._live(s, candidates, True), filter_, None, self.registry)

    def _cdc(self, s: Snapshot, df: DataFrame) -> list[dict]:
        if s.config.get("delta.enableChangeDataFeed") != "true":
            return []
        folder = f"_change_data/{uuid.uuid4().hex}"
        df.write.parquet(self.store.uri(folder))
        return [{"cdc": {"path": folder, "partitionValues": {}, "size": sum(e.size for e in self.store.walk(folder)), "dataChange": False}}]

    def delete(self, filter_: Expr | Column | Batches) -> tuple[int, int]:
        """filter_: a predicate, or a function from a record batch to a boolean array. Mark matching rows deleted; rows where the predicate is null stay. Returns rows and version; without matches nothing is committed.
        Where a compatibility mode excludes deletion vectors the files are written anew without the rows."""
        s = self.current
        if s.config.get("delta.appendOnly") == "true":
            raise ProtocolError("the table is append-only")
        candidates, matched = self._matches(s, filter_)
        if compat(s):
            return self._delete_by_rewrite(s, candidates, matched, filter_)
        rows = matched.select(F.col(PATH).alias("path"), F.col(ROW).alias("row"))
        before = self._deleted(candidates)
        marked = rows.withColumn("new", F.lit(True))
        if before is not None:
            marked = marked.unionByName(before.join(rows.select("path").distinct(), "path", "left_semi").withColumn("new", F.lit(False)))
        root = self.store.root

        def pack(group: pa.Table) -> pa.Table:
            """One file's rows as a deletion vector in a file of its own. A task that is run again writes another one; vacuum takes the first."""
            own = uuid.uuid4()
            data = roaring.encode(group["row"].to_numpy())
            fs, at = open_fs(f"{root}/deletion_vector_{own}.bin")
            with fs.open_output_stream(at) as f:
                f.write(roaring.vector_file(data))
            out = {"path": [group["path"][0].as_py()], "place": [roaring.z85_encode(own.bytes)], "size": [len(data)], "n": [group.num_rows], "fresh": [pc.sum(group["new"].cast(pa.int64())).as_py()]}
            return pa.table(out, pa.schema([("path", pa.string()), ("place", pa.string()), ("size", pa.int32()), ("n", pa.int64()), ("fresh", pa.int64())]))

        vectors = {r["path"]: r for r in marked.groupBy("path").applyInArrow(pack, "path string, place string, size int, n long, fresh long").collect()}  # one row per file
        if not vectors:
            return 0, s.version
        actions: list[dict] = self._cdc(s, matched.drop(PATH, ROW).withColumn("_change_type", F.lit("delete")))
        for a in candidates:
            if (v := vectors.get(a["path"])) is None:
                continue
            actions.append(self._remove(a))
            if v["n"] != _records(a):
                actions.append({"add": {**a, "dataChange": True, "deletionVector": {"storageType": "u", "pathOrInlineDv": v["place"], "offset": 1, "sizeInBytes": v["size"], "cardinality": v["n"]}}})
        return sum(v["fresh"] for v in vectors.values()), self._commit(s, "DELETE", actions)

    def _delete_by_rewrite(self, s: Snapshot, candidates: Sequence[Mapping], matched: DataFrame, filter_: Expr | Column) -> tuple[int, int]:
        touched = {r[PATH]: r["n"] for r in matched.groupBy(PATH).agg(F.count("*").alias("n")).collect()}  # one row per file
        if not touched:
            return 0, s.version
        adds = [a for a in candidates if a["path"] in touched]
        written = self._write_files(s, self._flag(s, self._live(s, adds), filter_).filter(~F.col(HIT)).drop(HIT))
        cdc = self._cdc(s, matched.drop(PATH, ROW).withColumn("_change_type", F.lit("delete")))
        actions = [*(self._remove(a) for a in adds), *({"add": a} for a in written), *cdc, *self._tracking(s)]
        return sum(touched.values()), self._commit(s, "DELETE", actions)

    def _flag(self, s: Snapshot, rows: DataFrame, filter_: Expr | Column | Batches) -> DataFrame:
        if not isinstance(filter_, Expr | Column):
            return flagged(rows, filter_, HIT)
        return rows.withColumn(HIT, F.coalesce(comp.predicate(filter_, s.schema, self.registry) if isinstance(filter_, Expr) else filter_, F.lit(False)))

    def update(self, filter_: Expr | Column | Batches, assignments: Mapping[str, Expr | Column] | Callable[[pa.RecordBatch], pa.RecordBatch]) -> tuple[int, int]:
        """Rewrite the files with matching rows; assigned expressions, or a function over record batches of matching rows, see the old row."""
        s = self.current
        if s.config.get("delta.appendOnly") == "true":
            raise ProtocolError("the table is append-only")
        candidates, matched = self._matches(s, filter_)
        touched = {r[PATH]: r["n"] for r in matched.groupBy(PATH).agg(F.count("*").alias("n")).collect()}
        if not touched:
            return 0, s.version
        adds = [a for a in candidates if a["path"] in touched]
        rows, kinds = self._live(s, adds), {f.name: f.dataType for f in s.schema.fields}
        told = self._flag(s, rows, filter_)
        pre = told.filter(HIT).drop(HIT)
        if isinstance(assignments, Mapping):
            new = {c: (comp.expression(e, s.schema, self.registry) if isinstance(e, Expr) else e).cast(kinds[c]) for c, e in assignments.items()}
            changed = told.select(*[F.when(F.col(HIT), new[c]).otherwise(F.col(f"`{c}`")).alias(c) if c in new else F.col(f"`{c}`") for c in rows.columns])
            post = pre.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in rows.columns])
        else:
            post = changed_by(pre, assignments, s.schema)
            changed = told.filter(~F.col(HIT)).drop(HIT).unionByName(post)
        written = self._write_files(s, changed)
        cdc = self._cdc(s, pre.withColumn("_change_type", F.lit("update_preimage")).unionByName(post.withColumn("_change_type", F.lit("update_postimage"))))
        actions = [*(self._remove(a) for a in adds), *({"add": a} for a in written), *cdc, *self._tracking(s)]
        return sum(touched.values()), self._commit(s, "UPDATE", actions)

    # -- change feed --------------------------------------------------------------------------------------

    def changes(self, start: int, end: int) -> DataFrame:
        """Rows inserted, deleted and updated by the commits from start to end, with _change_type, _commit_version and _commit_timestamp."""
        frames, s = [], self.snapshot(start)
        for v in range(start, end + 1):
            actions = self.commit_actions(v)
            s = s if v == start else replay(s, v, actions)
            stamp = next((a["commitInfo"]["inCommitTimestamp"] for a in actions if "commitInfo" in a), None)
            tag = lambda df, kind, v=v, stamp=stamp: df.withColumns({**({"_change_type": F.lit(kind)} if kind else {}), "_commit_version": F.lit(v).cast("long"), "_commit_timestamp": F.timestamp_millis(F.lit(stamp))})
            kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in s.schema.fields)
            if cdc := [a["cdc"]["path"] for a in actions if "cdc" in a]:
                frames.append(tag(self.spark.read.schema(f"{kinds}, _change_type string").parquet(*map(self.store.uri, cdc)), None))
                continue
            adds = {a["add"]["path"]: a["add"] for a in actions if "add" in a and a["add"]["dataChange"]}
            removes = {a["remove"]["path"]: a["remove"] for a in actions if "remove" in a and a["remove"]["dataChange"]}
            if fresh := [a for p, a in adds.items() if p not in removes]:
                frames.append(tag(self._live(s, fresh), "insert"))
            if lost := [r for p, r in removes.items() if p not in adds]:
                frames.append(tag(self._live(s, lost), "delete"))
            for p in adds.keys() & removes.keys():  # only the deletion vector changed
                before = self._live(s, [removes[p]], True)
                frames.append(tag(before.join(self._deleted([adds[p]]).select(F.col("path").alias(PATH), F.col("row").alias(ROW)), [PATH, ROW], "left_semi").drop(PATH, ROW), "delete"))
        if not frames:
            s = self.current
            return self.spark.createDataFrame([], T.StructType([*s.schema.fields, T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType()), T.StructField("_commit_timestamp", T.TimestampType())]))
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)

    # -- maintenance --------------------------------------------------------------------------------------

    def compact(self, smaller_than: int = 32 << 20, least: int = 2, most: int = 100, target: int = 128 << 20) -> int | None:
        """Merge small files, partition by partition, without deleted rows; changes no data. None if there is nothing to merge."""
        s = self.current
        by_part: dict[tuple, list[Mapping]] = {}
        for a in sorted(s.files.values(), key=lambda a: (a["size"], a["path"])):
            if a["size"] < smaller_than or a.get("deletionVector"):
                by_part.setdefault(tuple(sorted(a["partitionValues"].items(), key=str)), []).append(a)
        chosen = [a for group in by_part.values() if len(group) >= least for a in group[:most]]
        if not chosen:
            return None
        pieces = max(1, -(-sum(a["size"] for a in chosen) // target))
        # dealt by address, so that a task that is run again gets the same rows
        place = F.pmod(F.xxhash64(PATH, ROW), F.lit(pieces))
        df = self._live(s, chosen, True).repartition(*([max(pieces, 1)] if not s.partitions else []), *s.partitions, place).drop(PATH, ROW)
        adds = self._write_files(s, df, data_change=False)
        return self._commit(s, "OPTIMIZE", [*(self._remove(a, False) for a in chosen), *({"add": a} for a in adds), *self._tracking(s)])

    def vacuum(self, retain_ms: int = 7 * 24 * 3600 * 1000, dry_run: bool = False) -> list[str]:
        """Delete files that no version within the retention needs; returns their paths."""
        s = self.current
        self._gate_write(s.protocol)
        horizon = now_ms() - retain_ms
        alive = [*s.files.values(), *(r for r in s.gone.values() if r.get("deletionTimestamp", 0) > horizon)]
        keep = {a["path"] for a in alive}
        vectors = {roaring.vector_path(v["pathOrInlineDv"]) for a in alive if (v := a.get("deletionVector")) and v["storageType"] == "u"}
        old = [e.path for e in self.store.walk("data") if e.path.endswith(".parquet") and e.path not in keep and e.modified <= horizon]
        old += [e.path for e in self.store.walk("_change_data") if e.modified <= horizon]
        old += [n for n in self.store.names("") if n.startswith("deletion_vector_") and n.endswith(".bin") and n not in vectors and self.store.modified(n) <= horizon]
        for p in [] if dry_run else old:
            self.store.delete(p)
        return old

    # -- domains ------------------------------------------------------------------------------------------

    def domains(self) -> dict[str, str]:
        return dict(self.current.domains)

    def set_domain(self, name: str, configuration: str) -> int:
        if name.startswith("delta."):
            raise ValueError("names that start with delta. are reserved")
        return self._commit(self.current, "SET DOMAIN", [{"domainMetadata": {"domain": name, "configuration": configuration, "removed": False}}])

    def remove_domain(self, name: str) -> int:
        if name not in self.current.domains or name.startswith("delta."):
            raise KeyError(name)
        return self._commit(self.current, "REMOVE DOMAIN", [{"domainMetadata": {"domain": name, "configuration": "", "removed": True}}])
