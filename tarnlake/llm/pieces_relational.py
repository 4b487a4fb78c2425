"""The lattice of pieces.py in Spark's own operators, kept to be measured against it: explode, equi-join to the piece table,
grouping by word, higher-order aggregate, and joins that bring the encoded words back to the documents."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.pieces import DEFAULT_MODEL, SPACE, UNIT, lattice

EDGE = "struct<end:int,size:int,id:int,after:array<int>>"


def _words(text: Column) -> Column:
    """Distinct words of a text: after a space with the mark in front, after a line feed bare."""
    lines = F.split(F.translate(text, SPACE, " "), "\n", -1)

    def line(x: Column, i: Column) -> Column:
        own = F.split(x, " ", -1)
        return F.transform(own, lambda w, k: F.when((k == 0) & (i > 0), w).otherwise(F.concat(F.lit(SPACE), w)))

    return F.array_distinct(F.flatten(F.transform(lines, line)))


def _fold(edges: Column) -> Column:
    """Pieces of a word from its edges in order of end and size: an end keeps the edge that agrees with the one kept at its start."""
    none = F.array().cast("array<struct<id:int,size:int>>")

    def keep(acc: Column, e: Column) -> Column:
        before = F.get(acc, e["end"] - e["size"])["id"]
        fits = (e["size"] == e["end"] + 1) | (e["id"] < 0) | (before < 0) | F.array_contains(e["after"], before)
        return F.when((F.size(acc) == e["end"]) & fits, F.concat(acc, F.array(F.struct(e["id"].alias("id"), e["size"].alias("size"))))).otherwise(acc)

    kept = F.aggregate(edges, none, keep)

    def back(kept: Column) -> Column:
        start = F.struct((F.size(kept) - 1).alias("at"), F.array().cast("array<int>").alias("ids"))

        def step(acc: Column, e: Column) -> Column:
            moved = F.struct((acc["at"] - e["size"]).alias("at"), F.concat(F.array(e["id"]), acc["ids"]).alias("ids"))
            return F.when(acc["at"] == e["k"], moved).otherwise(acc)

        numbered = F.transform(kept, lambda e, k: F.struct(e["id"].alias("id"), e["size"].alias("size"), k.alias("k")))
        return F.aggregate(F.reverse(numbered), start, step, lambda acc: acc["ids"])

    return back(kept)


def encode(docs: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """As pieces.encode."""
    spark = docs.sparkSession
    with open(model_file, "rb") as f:
        data = f.read()
    model, tool = spark.sparkContext.broadcast(data), lattice(data)
    table = spark.createDataFrame([(p, i) for p, i in tool.table.items()], "piece string, id int")
    rest = [c for c in docs.columns if c != "text"]
    base = docs.select(F.monotonically_increasing_id().alias("rid"), F.struct(*rest).alias("row"), F.col("text").cast("string").alias("text"))
    own = base.filter("text <> ''").select("rid", F.explode(_words(F.col("text"))).alias("word")).filter(~F.col("word").isin("", SPACE))

    words = own.select("word").distinct()
    starts = words.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("start"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(tool.longest), F.char_length("word") - F.col("start") + 1))
    parts = starts.select("word", "start", F.explode(sizes).alias("size")).withColumn("piece", F.substring(F.col("word"), F.col("start"), F.col("size")))
    edges = parts.join(F.broadcast(table), "piece", "left").filter("id is not null or size = 1")
    edges = edges.select("word", F.struct((F.col("start") + F.col("size") - 2).alias("end"), "size", F.coalesce("id", F.lit(-1)).alias("id")).alias("e"))
    grouped = edges.groupBy("word").agg(F.sort_array(F.collect_list("e")).alias("edges"))

    def agreeing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Gives each edge the pieces before it that it agrees with."""
        tool = lattice(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                lists = part.column(1).to_pylist()
                a, b = [], []
                for edges in lists:
                    by_end = defaultdict(list)
                    for e in edges:
                        by_end[e["end"]].append(e["id"])
                    for e in edges:
                        e["after"] = near = [x for x in by_end.get(e["end"] - e["size"], ()) if x >= 0] if e["id"] >= 0 else []
                        a += near
                        b += [e["id"]] * len(near)
                good = iter(tool.agree(np.array(a, np.int64), np.array(b, np.int64)).tolist())
                for edges in lists:
                    for e in edges:
                        e["after"] = [x for x in e["after"] if next(good)]
                kind = pa.list_(pa.struct([("end", pa.int32()), ("size", pa.int32()), ("id", pa.int32()), ("after", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists, kind)], names=["word", "edges"])

    encoded = grouped.mapInArrow(agreeing, f"word string, edges array<{EDGE}>").select("word", _fold(F.col("edges")).alias("ids"))
    found = own.join(encoded.hint("shuffle_hash"), "word").groupBy("rid").agg(F.collect_list(F.struct("word", "ids")).alias("found"))
    joined = base.join(found, "rid", "left").select("row", "text", "found")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = lattice(model.value)
        for batch in batches:
            ids, same = [], []
            for text, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = {}
                for w in found or ():
                    places, out = 0, []
                    if min(w["ids"]) < 0:  # characters that are no pieces: as bytes
                        for i in w["ids"]:
                            out.append(np.array([i], np.int32).tobytes() if i >= 0 else tool._bytes(w["word"][places]))
                            places += len(tool.text(i)) if i >= 0 else 1
                    else:
                        out.append(np.array(w["ids"], np.int32).tobytes())
                    words[w["word"]] = b"".join(out)
                units = UNIT.findall(" " + text.replace(SPACE, " ")) if text else []
                own = np.frombuffer(b"".join(tool.lay(u, words) for u in units), np.int32)
                ids.append(own)
                same.append(tool.decode(own) == (text or ""))
            sizes = [len(x) for x in ids]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(sizes, pa.int64()), pa.array(same)], names=["row", "ids", "n_tokens", "round_trip"])

    return joined.mapInArrow(assemble, T.StructType([base.schema["row"], T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType())]))
