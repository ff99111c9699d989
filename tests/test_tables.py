from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from runcourier.operators.sections import assemble
from runcourier.schema import TABLE_SCHEMAS
from runcourier.session import work_path
from runcourier.sources import tables as T
from runcourier.sources.sample import RUN_ID, sample_tables
from runcourier.sources.tables import (
    append,
    base_dir,
    create_or_replace,
    load_catalog_tables,
    load_tables,
    save_tables,
    upsert,
    upsert_into,
    whole_text,
)


def test_store_and_load(spark, tmp_path, monkeypatch):
    t = sample_tables(spark)
    save_tables(t, str(tmp_path))
    save_tables(t, str(tmp_path))
    back = load_tables(spark, str(tmp_path))
    for name, schema in TABLE_SCHEMAS.items():
        assert back.table(name).schema == schema
        assert sorted(back.table(name).collect()) == sorted(t.table(name).collect())
    append(t.failed_check, f"{tmp_path}/failed_check")
    assert load_tables(spark, str(tmp_path)).failed_check.count() == 6
    monkeypatch.setenv("RUNCOURIER_TABLES", str(tmp_path))
    assert load_tables(spark).suite_status.count() == 1
    monkeypatch.delenv("RUNCOURIER_TABLES")
    with pytest.raises(ValueError):
        base_dir()


def test_run_filter_reaches_the_scan(spark, tmp_path):
    save_tables(sample_tables(spark), str(tmp_path))
    t = load_tables(spark, str(tmp_path)).of_run(RUN_ID)
    plan = t.section("failed")._jdf.queryExecution().executedPlan().toString()
    assert f"EqualTo(run_id,{RUN_ID})" in plan
    assert assemble(t).first().run_id == RUN_ID
    assert assemble(load_tables(spark, str(tmp_path)).of_run("x")).collect() == []


def test_catalog_tables(spark):
    spark.sql("create database if not exists demo")
    for name in TABLE_SCHEMAS:
        sample_tables(spark).table(name).write.mode("overwrite").saveAsTable(f"demo.{name}")
    assert assemble(load_catalog_tables(spark, "demo")).count() == 1
    spark.sql("drop database demo cascade")


def test_list_of_runs(spark):
    t = sample_tables(spark)
    runs = spark.createDataFrame([(RUN_ID,), ("x",)], "run_id string")
    assert t.of_runs(runs).failed_check.count() == 3
    assert t.of_runs(runs.where("run_id = 'x'")).failed_check.count() == 0


def test_upsert(spark, tmp_path):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id string, n int, s string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "z")], "id string, n int, s string")
    want = [("a", 1, "x"), ("b", 3, None), ("c", 4, "z")]
    assert sorted(tuple(r) for r in upsert(old, new, ["id"]).collect()) == want
    path = str(tmp_path / "t")
    create_or_replace(old, path)
    upsert_into(spark, path, new, ["id"])
    upsert_into(spark, path, new, ["id"])
    assert sorted(tuple(r) for r in spark.read.parquet(path).collect()) == want


def test_whole_text(spark, tmp_path):
    (tmp_path / "body.html").write_text("<p>a</p>\n<p>b</p>\n")
    row = whole_text(spark, str(tmp_path / "body.html")).first()
    assert row.text == "<p>a</p>\n<p>b</p>\n" and row.path.endswith("body.html")


def test_work_folder_is_the_named_one(spark):
    assert work_path(spark, "x").startswith(spark.sparkContext.getConf().get("spark.checkpoint.dir"))
    assert work_path(spark, "x") != work_path(spark, "x")


def test_source_rows_are_not_shuffled_for_a_slice(spark):
    t = sample_tables(spark)
    plan = t.failed_check.where(F.col("run_id") == RUN_ID)._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_stored_tables_are_ordered_by_run(spark, tmp_path):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.concat(F.lit("r"), F.col("id") % 97))
        .alias("run_id"),
        F.concat(F.lit("d"), F.col("id")).alias("threshold_query_description"),
    )
    tables = replace(sample_tables(spark), threshold_breach=rows.repartition(6))
    # Small targets, so that the large run is split and small files are merged.
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        save_tables(tables, str(tmp_path))
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    stored = spark.read.parquet(f"{tmp_path}/threshold_breach")
    assert stored.count() == 20_000 and stored.exceptAll(rows).count() == 0
    files = stored.select("run_id", F.input_file_name().alias("f"))
    assert files.where("run_id = 'hot'").select("f").distinct().count() > 1
    others = files.where("run_id <> 'hot'").distinct().groupBy("run_id").count()
    assert others.where("count > 1").count() < 97


def test_upsert_writes_touched_buckets_only_and_survives_a_stop(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(f"k{i}", i, f"v{i}") for i in range(200)]
    T.save_buckets(spark.createDataFrame(rows, "id string, n int, v string"), path, ["id"], 16)
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    new = spark.createDataFrame([("k3", 1003, None), ("new", 5, "x")], "id string, n int, v string")
    T.upsert_buckets(spark, path, new, ["id"], 16)
    want = {r[0]: r for r in rows} | {"k3": ("k3", 1003, None), "new": ("new", 5, "x")}
    assert {tuple(r) for r in T.read_buckets(spark, path).collect()} == set(want.values())
    kept = [p for p, at in before.items() if p.exists() and p.stat().st_mtime_ns == at]
    assert len(kept) >= 14

    # Stopped after the merged buckets were staged: the next reader puts them in place.
    finish = T.finish_upsert
    stopped = []
    try:
        T.finish_upsert = lambda *_: stopped.append(1)
        T.upsert_buckets(spark, path, spark.createDataFrame([("k5", 0, "z")], "id string, n int, v string"), ["id"], 16)
    finally:
        T.finish_upsert = finish
    assert stopped and (tmp_path / "t.staged" / "_SUCCESS").exists()
    want["k5"] = ("k5", 0, "z")
    assert {tuple(r) for r in T.read_buckets(spark, path).collect()} == set(want.values())
    assert not (tmp_path / "t.staged").exists()
    T.upsert_buckets(spark, path, new.limit(0), ["id"], 16)
    assert T.read_buckets(spark, path).count() == 201


def test_runs_are_pruned_by_bucket(spark, tmp_path):
    folder = str(tmp_path / "runs")
    suites = [(f"r{i}", "S", "PASSED", "PASS", 1, 1, 0, "t", "u") for i in range(300)]
    T.save_run_tables(T.inline_tables(spark, suite_status=suites), folder)
    tables = T.load_run_tables(spark, folder)
    some = spark.createDataFrame([("r5",), ("r77",), ("none",)], "run_id string")
    cut_tables = tables.of_runs(some)
    assert {r.run_id for r in cut_tables.suite_status.collect()} == {"r5", "r77"}
    assert cut_tables.suite_status.columns == [f.name for f in TABLE_SCHEMAS["suite_status"].fields]
    plan = cut_tables.suite_status._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "run_bucket" in filters
    assert [r.run_id for r in tables.of_run("r9").suite_status.collect()] == ["r9"]
    one = tables.of_run("r9").suite_status._jdf.queryExecution().executedPlan().toString()
    assert "run_bucket" in one.split("PartitionFilters: [")[1].split("]")[0]
    T.save_run_tables(T.inline_tables(spark, suite_status=[("r5", "T", "PASSED", "PASS", 1, 1, 0, "t", "u")]), folder, "append")
    assert T.load_run_tables(spark, folder).of_run("r5").suite_status.count() == 2
