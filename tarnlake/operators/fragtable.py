"""A table of fragments: each version is a manifest that lists Parquet fragments and where their deleted rows are noted.

Row addresses are (fragment, offset). Deletes add tombstones, updates tombstone and write one new fragment, and secondary
indices map values to addresses so that a lookup opens only the fragments it must.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.registry import DEFAULT, Registry
from tarnlake.operators.rows import BATCH, PATH, ROW, Batches, changed_by, flagged, read_files, without
from tarnlake.operators.storage import Store, now_ms, spread
from tarnlake.plans import compile as comp
from tarnlake.plans.expr import All, Any_, Compare, Const, Expr, In, Lit, Ref

#: Rows that a fragment has, about, at most. More rows make more fragments, so that a task's share doesn't grow.
FRAGMENT_ROWS = 1_000_000
#: Partitions of up to so many fragments' rows are dealt out evenly, for which Spark sorts each; if one is larger, all are cut into fragments where they are.
DEALT = 4
VERSIONS = "_versions"


@dataclass(frozen=True)
class Fragment:
    id: int
    files: tuple[str, ...]
    rows: int
    deletions: str | None = None  # folder of (path, row)
    deleted: int = 0


@dataclass(frozen=True)
class Manifest:
    version: int
    timestamp: int
    schema: str
    fragments: tuple[Fragment, ...] = ()
    next_fragment: int = 0
    operation: str = ""
    indices: Mapping[str, Mapping] = field(default_factory=dict)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def from_json(cls, text: str) -> Manifest:
        raw = json.loads(text)
        return cls(**{**raw, "fragments": tuple(Fragment(**{**f, "files": tuple(f["files"])}) for f in raw["fragments"])})


class FragmentTable:
    def __init__(self, spark: SparkSession, path: str, registry: Registry = DEFAULT) -> None:
        self.spark, self.store, self.registry, self.manifest = spark, Store(spark, path), registry, None

    # -- versions -----------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self.store.names(VERSIONS) if n.endswith(".json")]

    def _load(self, version: int) -> Manifest:
        return Manifest.from_json(self.store.read(f"{VERSIONS}/{version:020d}.json"))

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None, as_of: int | None = None) -> FragmentTable:
        """The newest version, a given one (from 1), or the last at or before a time in milliseconds."""
        if version is not None and as_of is not None:
            raise ValueError("version or as_of, not both")
        table = cls(spark, path)
        found = table.versions()
        if as_of is not None:
            found = [v for v in found if table._load(v).timestamp <= as_of]
        if not found or version is not None and version not in found:
            raise FileNotFoundError(f"{path}: no such version")
        table.manifest = table._load(version if version is not None else max(found))
        return table

    @classmethod
    def create(cls, spark: SparkSession, path: str, df: DataFrame, fragments: int = 1, by: str | None = None) -> FragmentTable:
        """fragments: how many at least; by: a column of whose values each fragment gets a range."""
        table = cls(spark, path)
        if table.versions():
            raise FileExistsError(path)
        empty = Manifest(0, 0, df.schema.json())
        added, next_ = table._fragments(empty, df, *spread(df), fragments, by)
        table._commit(empty, replace(empty, fragments=added, next_fragment=next_), "create")
        return table

    @property
    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.manifest.schema))

    def _commit(self, base: Manifest, new: Manifest, operation: str) -> int:
        new = replace(new, version=base.version + 1, timestamp=max(now_ms(), base.timestamp + 1), operation=operation)
        self.store.create(f"{VERSIONS}/{new.version:020d}.json", new.to_json())
        self.manifest = new
        return new.version

    # -- writing ------------------------------------------------------------------------------------------

    def _fragments(self, m: Manifest, df: DataFrame, n: int, most: int, least: int = 1, by: str | None = None) -> tuple[tuple[Fragment, ...], int]:
        """Write df of n rows, about most of them in its largest partition. Fragments are dealt or ranged; those cut from large partitions can be more, by one for each partition."""
        schema = T.StructType.fromJson(json.loads(m.schema))
        if [(f.name, f.dataType) for f in df.schema.fields] != [(f.name, f.dataType) for f in schema.fields]:
            raise ValueError(f"schema {df.schema.simpleString()} isn't {schema.simpleString()}")
        folder, count, cut = f"data/{BATCH}={uuid.uuid4().hex}", max(least, -(-n // FRAGMENT_ROWS)), {}
        if by:
            df = df.repartitionByRange(count, by)
        elif count == 1:
            df = df.coalesce(1)
        elif most <= DEALT * FRAGMENT_ROWS:
            df = df.repartition(count)
        else:
            cut = {"maxRecordsPerFile": -(-n // count)}
        df.write.options(**cut).parquet(self.store.uri(folder))
        files = [e.path for e in self.store.walk(folder) if e.path.endswith(".parquet")]
        sizes = {r[PATH]: r["n"] for r in read_files(self.store, self.spark, files, schema, True).groupBy(PATH).agg(F.count("*").alias("n")).collect()} if files else {}
        own = [f for f in files if sizes.get(f)]
        return tuple(Fragment(m.next_fragment + k, (f,), sizes[f]) for k, f in enumerate(own)), m.next_fragment + len(own)

    def append(self, df: DataFrame, fragments: int = 1) -> int:
        m = self.manifest
        added, next_ = self._fragments(m, df, *spread(df), fragments)
        return self._commit(m, replace(m, fragments=m.fragments + added, next_fragment=next_), "append")

    def overwrite(self, df: DataFrame, fragments: int = 1) -> int:
        """Replace rows and schema; earlier versions stay readable."""
        m = replace(self.manifest, schema=df.schema.json())
        added, next_ = self._fragments(m, df, *spread(df), fragments)
        return self._commit(self.manifest, replace(m, fragments=added, next_fragment=next_, indices={}), "overwrite")

    # -- reading ------------------------------------------------------------------------------------------

    def count(self) -> int:
        return sum(f.rows - f.deleted for f in self.manifest.fragments)

    def _deleted(self, fragments: Sequence[Fragment]) -> DataFrame | None:
        """(path, row) of their deleted rows, each once: a fragment's are in its own folder, whatever older folders say."""
        own = [(p, f.deletions.rpartition("/")[2]) for f in fragments if f.deletions for p in f.files]
        if not own:
            return None
        folders = sorted({f.deletions for f in fragments if f.deletions})
        rows = self.spark.read.schema("path string, row long").parquet(*map(self.store.uri, folders)).select("path", "row", F.element_at(F.split("_metadata.file_path", "/"), -2).alias("folder"))
        return rows.join(F.broadcast(self.spark.createDataFrame(own, "path string, folder string")), ["path", "folder"], "left_semi").select("path", "row")

    def _rows(self, fragments: Sequence[Fragment], addresses: bool = False) -> DataFrame:
        deleted = self._deleted(fragments)
        paths = [p for f in fragments for p in f.files]
        df = without(read_files(self.store, self.spark, paths, self.schema, addresses or deleted is not None), deleted, paths, sum(f.deleted for f in fragments))
        return df if addresses else df.drop(PATH, ROW)

    def read(self, columns: list[str] | None = None, filter_: Expr | None = None) -> DataFrame:
        """Live rows: indices choose fragments, tombstones are masked, the filter is exact."""
        return comp.apply(self._rows(self.plan(filter_)), filter_, columns, self.registry)

    # -- mutation -----------------------------------------------------------------------------------------

    def _tombstone(self, m: Manifest, rows: DataFrame) -> tuple[Manifest, int, int]:
        """rows: path, row of live rows, each once. Each fragment's note holds all its deleted rows. Also returns how many are new, and how many of these one task found at most."""
        folder = f"deletions/{uuid.uuid4().hex}"
        rows.select("path", "row").write.parquet(self.store.uri(folder))
        noted = self.spark.read.schema("path string, row long").parquet(self.store.uri(folder))
        fresh = {r["path"]: r["n"] for r in noted.groupBy("path").agg(F.count("*").alias("n")).collect()}
        most = noted.groupBy("_metadata.file_name").count().agg(F.max("count")).first()[0] or 0  # a task notes in one file
        touched = [f for f in m.fragments if f.files[0] in fresh]
        if before := [f for f in touched if f.deletions]:
            self._deleted(before).write.mode("append").parquet(self.store.uri(folder))
        new = tuple(replace(f, deletions=folder, deleted=f.deleted + fresh[f.files[0]]) if f in touched else f for f in m.fragments)
        return replace(m, fragments=new), sum(fresh.values()), most

    def delete_rows(self, offsets: Mapping[int, Sequence[int]]) -> int:
        """Delete by fragment and offset; returns how many rows that were live."""
        m = self.manifest
        by_id = {f.id: f for f in m.fragments}
        pairs = []
        for k, rows in offsets.items():
            if k not in by_id or any(not 0 <= r < by_id[k].rows for r in rows):
                raise IndexError(f"fragment {k}: offset out of range")
            pairs += [(by_id[k].files[0], int(r)) for r in set(rows)]
        asked = self.spark.createDataFrame(pairs, "path string, row long")
        already = self._deleted(m.fragments)
        return self._delete(asked if already is None else asked.join(already.join(F.broadcast(asked), ["path", "row"], "left_semi"), ["path", "row"], "left_anti"))

    def _matches(self, filter_: Expr | Column | Batches) -> DataFrame:
        rows = self._rows(self.plan(filter_) if isinstance(filter_, Expr) else self.manifest.fragments, True)
        if not isinstance(filter_, Expr | Column):
            return flagged(rows, filter_, "__hit").filter("__hit").drop("__hit")
        return comp.apply(rows, filter_, None, self.registry)

    def delete(self, filter_: Expr | Column | Batches) -> int:
        """Delete rows that match a predicate, or a function from a record batch to a boolean array; none, and the version stays."""
        found = self._matches(filter_)
        return self._delete(found.select(F.col(PATH).alias("path"), F.col(ROW).alias("row")))

    def _delete(self, rows: DataFrame) -> int:
        m = self.manifest
        new, n, _ = self._tombstone(m, rows)
        if n:
            self._commit(m, new, "delete")
        return n

    def update(self, filter_: Expr | Column | Batches, assignments: Mapping[str, Expr | Column] | Callable[[pa.RecordBatch], pa.RecordBatch]) -> tuple[int, int]:
        """Tombstone matching rows and write them, changed, as new fragments. Expressions, or a function over record batches, see the old row."""
        m = self.manifest
        if isinstance(assignments, Mapping) and (unknown := set(assignments) - set(self.schema.fieldNames())):
            raise KeyError(", ".join(sorted(unknown)))
        found = self._matches(filter_)
        if not isinstance(assignments, Mapping):
            return self._replace(m, found, changed_by(found, assignments, self.schema))
        new = {c: comp.expression(e, self.schema, self.registry) if isinstance(e, Expr) else e for c, e in assignments.items()}
        changed = found.select(*[(new[f.name].cast(f.dataType) if f.name in new else F.col(f"`{f.name}`")).alias(f.name) for f in self.schema.fields])
        return self._replace(m, found, changed)

    def _replace(self, m: Manifest, found: DataFrame, changed: DataFrame) -> tuple[int, int]:
        marked, n, most = self._tombstone(m, found.select(F.col(PATH).alias("path"), F.col(ROW).alias("row")))
        if not n:
            return 0, m.version
        # one task writes a fragment, but many find its rows
        added, next_ = self._fragments(m, changed.repartition(1) if n <= FRAGMENT_ROWS else changed, n, most)
        return n, self._commit(m, replace(marked, fragments=marked.fragments + added, next_fragment=next_), "update")

    def compact(self) -> int | None:
        """Rewrite the fragments that have deletions, as fragments of at most FRAGMENT_ROWS rows."""
        m = self.manifest
        holed = [f for f in m.fragments if f.deleted]
        if not holed:
            return None
        n, rows = sum(f.rows - f.deleted for f in holed), self._rows(holed)
        sizes = (n, n) if n <= DEALT * FRAGMENT_ROWS else spread(rows)
        added, next_ = self._fragments(m, rows.repartition(1) if n <= FRAGMENT_ROWS else rows, *sizes)
        return self._commit(m, replace(m, fragments=tuple(f for f in m.fragments if not f.deleted) + added, next_fragment=next_, indices={}), "compact")

    def vacuum(self, keep: int = 1, dry_run: bool = False) -> list[str]:
        """Keep the newest manifests; delete older ones and what only they refer to."""
        if keep < 1:
            raise ValueError("keep at least one version")
        versions = self.versions()
        kept = [self._load(v) for v in versions[-keep:]]
        files = {p for m in kept for f in m.fragments for p in f.files}
        folders = {f.deletions for m in kept for f in m.fragments} | {i["path"] for m in kept for i in m.indices.values()}
        old = [e.path for e in self.store.walk("data") if e.path.endswith(".parquet") and e.path not in files]
        old += [e.path for top in ("deletions", "_indices") for e in self.store.walk(top) if e.path.endswith(".parquet") and e.path.rpartition("/")[0] not in folders]
        old += [f"{VERSIONS}/{v:020d}.json" for v in versions[:-keep]]
        for p in [] if dry_run else old:
            self.store.delete(p)
        return old

    # -- indices ------------------------------------------------------------------------------------------

    def create_index(self, name: str, column: str, kind: str = "btree") -> int:
        """btree: values sorted, each with its address, for equality and ranges. bitmap: the fragments that hold each value."""
        m = self.manifest
        folder = f"_indices/{uuid.uuid4().hex}"
        ids = self.spark.createDataFrame([(p, f.id) for f in m.fragments for p in f.files], f"{PATH} string, fragment int")
        entries = read_files(self.store, self.spark, [p for f in m.fragments for p in f.files], self.schema, True).join(F.broadcast(ids), PATH).select(F.col(column).alias("value"), "fragment", F.col(ROW).alias("offset")).filter("value is not null")
        if kind == "bitmap":
            entries = entries.groupBy("value").agg(F.sort_array(F.collect_set("fragment")).alias("fragments"))
        elif kind != "btree":
            raise ValueError("kind: btree or bitmap")
        parts = -(-sum(f.rows for f in m.fragments) // FRAGMENT_ROWS) or 1
        entries.repartitionByRange(parts, "value").sortWithinPartitions("value").write.parquet(self.store.uri(folder))
        info = {"column": column, "kind": kind, "path": folder, "fragments": [f.id for f in m.fragments]}
        return self._commit(m, replace(m, indices={**m.indices, name: info}), "create index")

    def indices(self) -> dict[str, Mapping]:
        return dict(self.manifest.indices)

    def lookup(self, name: str, low=None, high=None, include_low: bool = True, include_high: bool = True) -> DataFrame:
        """(fragment, offset) of a btree's values within bounds; a bitmap gives fragments of one value (low)."""
        info = self.manifest.indices[name]
        df = self.spark.read.parquet(self.store.uri(info["path"]))
        v = F.col("value")
        if info["kind"] == "bitmap":
            return df.filter(v == F.lit(low)).select(F.explode("fragments").alias("fragment"))
        if low is not None:
            df = df.filter(v >= F.lit(low) if include_low else v > F.lit(low))
        if high is not None:
            df = df.filter(v <= F.lit(high) if include_high else v < F.lit(high))
        return df.select("fragment", "offset")

    def _known(self, e: Expr) -> set[int] | None:
        """Fragments that can hold matches, by the indices; None where they can't tell."""
        if isinstance(e, Const):
            return None if e.value else set()
        if isinstance(e, All):
            sets = [s for p in e.parts if (s := self._known(p)) is not None]
            return set.intersection(*sets) if sets else None
        if isinstance(e, Any_):
            sets = [self._known(p) for p in e.parts]
            return None if None in sets else set().union(*sets)
        if isinstance(e, In) and isinstance(e.part, Ref):
            return self._known_values(e.part.name, [v for v in e.values if v.value is not None])
        if not (isinstance(e, Compare) and isinstance(e.left, Ref) and isinstance(e.right, Lit) and e.right.value is not None):
            return None
        v, bounds = e.right.value, {"=": (1, 1), "<=>": (1, 1), "<": (0, 1), "<=": (0, 1), ">": (1, 0), ">=": (1, 0)}.get(e.op)
        for name, info in self.manifest.indices.items():
            if bounds is None or info["column"] != e.left.name or info["kind"] == "bitmap" and e.op not in ("=", "<=>"):
                continue
            if not comp.comparable(comp.literal(e.right)[1], self.schema[info["column"]].dataType):
                return set()
            found = self.lookup(name, v if bounds[0] else None, v if bounds[1] else None, e.op != ">", e.op != "<")
            return {r["fragment"] for r in found.select("fragment").distinct().collect()} | {f.id for f in self.manifest.fragments if f.id not in info["fragments"]}
        return None

    def _known_values(self, column: str, values: Sequence[Lit]) -> set[int] | None:
        """Fragments that can hold one of the values, by one lookup."""
        for info in self.manifest.indices.values():
            if info["column"] != column:
                continue
            fitting = [comp.literal(v)[0] for v in values if comp.comparable(comp.literal(v)[1], self.schema[column].dataType)]
            if not fitting:
                return set()
            df = self.spark.read.parquet(self.store.uri(info["path"])).filter(F.col("value").isin(*fitting))
            found = df.select(F.explode("fragments").alias("fragment") if info["kind"] == "bitmap" else "fragment").distinct().collect()
            return {r["fragment"] for r in found} | {f.id for f in self.manifest.fragments if f.id not in info["fragments"]}
        return None

    def plan(self, filter_: Expr | None) -> list[Fragment]:
        known = self._known(filter_) if isinstance(filter_, Expr) and self.manifest.indices else None
        return [f for f in self.manifest.fragments if known is None or f.id in known]
