"""The radix sort of substring.py in its plain form, kept to be measured against it: every suffix is a row, and each pass deals
the suffixes by their next bytes, drops those that are alone, and goes on with the others, through the threshold."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.common import materialize
from tarnlake.llm.substring import LAST_ID, kept_batches

#: Bytes of a digit.
DIGIT = 20


def dedup(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """As substring.dedup."""
    rest = [c for c in docs.columns if c != "text"]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("dkey"), F.xxhash64(text).alias("th"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("row"))
    texts = base.select("dkey", "th", F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("b")).distinct()
    long_enough = texts.filter(F.octet_length("b") >= length)
    # "group" names the bytes that a suffix has had so far: suffixes of one group agree in all of them
    rows = long_enough.select("dkey", "th", F.explode(F.sequence(F.lit(0), F.octet_length("b") - length)).alias("s"), F.col("b"), F.lit(0).cast("long").alias("group"))
    for at in range(0, length, DIGIT):
        if at:
            rows = rows.join(long_enough, ["dkey", "th"])
        digit = F.substr(F.col("b"), F.col("s") + (at + 1), F.lit(min(DIGIT, length - at)))
        rows = rows.select("dkey", "th", "s", "group", digit.alias("digit"))
        same = Window.partitionBy("group", "digit")
        order = F.rank().over(same.orderBy("dkey", "th", "s"))
        rows = rows.withColumn("many", F.count("*").over(same)).withColumn("k", order).filter("many > 1")
        rows = materialize(rows.select("dkey", "th", "s", F.xxhash64("group", "digit").alias("group"), "k"), "suffixes")
    r = F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR((F.col("s") + length).cast("long"))
    gone = rows.filter("k > 1").groupBy("dkey", "th").agg(F.collect_list(r).alias("ranges"))
    out = T.StructType([T.StructField("row", base.schema["row"].dataType), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType()), *([T.StructField("kept_text", T.StringType())] if with_text else [])])
    return base.join(gone, ["dkey", "th"], "left").select("dkey", "th", "text", "row", "ranges").mapInArrow(kept_batches(with_text), out)
