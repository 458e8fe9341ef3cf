"""Scans and sinks through files."""

import json

from tideline.sources import scan


def test_parquet_round_trip_cleans_numbers(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0), ("b", float("nan")), ("b", float("inf")), ("a", None)], "analysis_type string, v double")
    scan.write_parquet(df, str(tmp_path / "p"), ["analysis_type"])
    back = scan.read_parquet(spark, str(tmp_path / "p"))
    assert sorted((r.analysis_type, r.v) for r in back.where("v is not null").collect()) == [("a", 1.0)] and back.count() == 4


def test_csv_round_trip_and_sidecar_fallback(spark, tmp_path):
    a = spark.createDataFrame([("s1", 1.0)], "session string, v double")
    b = spark.createDataFrame([("s1", 9.0), ("s2", 2.0)], "session string, v double")
    scan.write_csv(b, str(tmp_path / "c"))
    csv = spark.read.schema("session string, v double").option("header", True).csv(str(tmp_path / "c"))
    assert sorted((r.session, r.v) for r in scan.read_sidecars(a, csv).collect()) == [("s1", 1.0), ("s2", 2.0)]


def test_event_tsv(spark, tmp_path):
    for task in ("rest", "play"):
        (tmp_path / f"sub-01_task-{task}_events.tsv").write_text("onset\tduration\ttrial_type\n0.5\tn/a\tSync1\n1.5\t0.1\tOther\n")
    got = scan.read_events(spark, str(tmp_path / "*.tsv"), "onset double, duration double, trial_type string").collect()
    assert sorted((r.subject, r.task, r.onset, r.duration) for r in got) == [("sub-01", "play", 0.5, None), ("sub-01", "rest", 0.5, None)]


def test_json_sidecar(spark, tmp_path):
    (tmp_path / "qc.json").write_text(json.dumps({"subject": "s1", "coverage": {"epochs": 3}}, indent=1))
    r = scan.read_json(spark, str(tmp_path / "qc.json"), "subject string, coverage struct<epochs:int>, absent string").first()
    assert (r.subject, r.coverage.epochs, r.absent) == ("s1", 3, None)


def test_latest_snapshot_of_real_files(spark, tmp_path):
    for name in ("demo_global_20260520_120000", "demo_global_20260521_120000", "demo_other_20250101_000000"):
        spark.range(1).write.parquet(str(tmp_path / "cleaned" / f"{name}.parquet"))
    files = spark.createDataFrame([(p.name, str(p), p.stat().st_mtime) for p in (tmp_path / "cleaned").iterdir()], "file_name string, file_path string, file_time double")
    got = {r.type: r.file_name for r in scan.latest_snapshots(files.withColumn("file_time", files.file_time * 0)).collect()}
    assert got == {"global": "demo_global_20260521_120000.parquet", "other": "demo_other_20250101_000000.parquet"}


def test_arrays_of_different_lengths_give_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], [3.0, 4.0]), (2, [1.0], [])], "k int, a array<double>, b array<double>")
    assert [(r.k, r.i, r.a, r.b) for r in scan.explode_columns(df, ["k"], ["a", "b"]).orderBy("i").collect()] == [(1, 0, 1.0, 3.0), (1, 1, 2.0, 4.0)]
