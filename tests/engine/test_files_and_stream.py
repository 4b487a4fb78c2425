import pytest

from tarnlake.operators.logtable import LogTable
from tarnlake.plans.expr import col
from tarnlake.sources import files
from tarnlake.streaming.sink import ChangeReader, write_stream


def test_parquet(spark, tmp_path):
    p = str(tmp_path / "p")
    df = spark.range(1000).selectExpr("id", "concat('n', id) name", "struct(id as x) s")
    files.write_parquet(df, p, files.WriteOptions(files=4, sort_by=["id"], bloom=["name"], version2=True, dictionary={"name": False}, max_rows_per_file=200))
    scan = files.scan_parquet(spark, p, columns=["id", "s.x"], filter_=col("name").starts_with("n99") & col("id").gt(5), verify_checksums=True)
    assert sorted(r[0] for r in scan.collect()) == [99, *range(990, 1000)]
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(name,n99)" in plan and "GreaterThan(id,5)" in plan
    one = next((tmp_path / "p").glob("*.parquet"))
    meta = files.parquet_metadata(str(one))
    lo = meta["row_groups"][0]["columns"]["id"]["min"]
    assert meta["rows"] <= 200 and files.candidate_groups(str(one), "id", lo) == [0] and files.candidate_groups(str(one), "id", -5) == []
    assert files.row_group(spark, str(one), 0, ["id"]).count() == meta["row_groups"][0]["rows"]
    with pytest.raises(IndexError):
        files.row_group(spark, str(one), 9)


def test_orc(spark, tmp_path):
    p = str(tmp_path / "o")
    files.write_orc(spark.range(100).selectExpr("id", "if(id % 2 = 0, null, 'x') v"), p, files.WriteOptions(files=1, bloom=["id"]))
    assert files.scan_orc(spark, p, columns=["id"], filter_=col("v").is_null() & col("id").lt(6)).count() == 3
    assert files.orc_metadata(str(next((tmp_path / "o").glob("*.orc"))))["rows"] == 100


def test_stream_is_exactly_once(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    t = LogTable.create(spark, str(tmp_path / "t"), spark.range(0).schema)
    changes = ChangeReader(t, 1)
    for k in range(3):
        spark.range(10 * k, 10 * k + 10).write.mode("append").parquet(source)
        stream = spark.readStream.schema("id long").parquet(source)
        write_stream(stream, t, "app", checkpoint).awaitTermination()
    assert t.refresh().txns["app"] == 2 and sorted(r[0] for r in t.read().collect()) == list(range(30))
    assert changes.poll().count() == 30 and changes.poll() is None
    v = t.latest_version()
    # a replay of the first batch, as after a lost checkpoint
    write_stream(spark.readStream.schema("id long").option("maxFilesPerTrigger", 100).parquet(source), t, "app", str(tmp_path / "cp2")).awaitTermination()
    assert t.latest_version() == v


def test_inspect(spark, tmp_path, capsys):
    from tarnlake.sources import avro, inspect

    avro.write(spark.range(3), str(tmp_path / "a"), "snappy")
    spark.range(3).coalesce(1).write.parquet(str(tmp_path / "p"))
    found = [str(next((tmp_path / d).glob(f"*.{e}"))) for d, e in (("a", "avro"), ("p", "parquet"))]
    assert inspect.main(found) == 0 and inspect.main([]) == 2
    out = capsys.readouterr().out
    assert '"codec": "snappy"' in out and '"rows": 3' in out
