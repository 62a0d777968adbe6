"""Table lake and run manifest."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from faultweave.functions import labels
from faultweave.functions.scalars import format_bytes
from faultweave.sources import lake, manifest
from faultweave.sources.schemas import MANIFEST, TABLES, columns

REGION = "0|AFRICA|dry|\n1|ASIA|big|\n"


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    (folder / "region.tbl").write_text(REGION)
    (folder / "nation.tbl").write_text("0|ALGERIA|0|hot|\n")
    (folder / "orders.tbl").write_text(
        "".join(f"{i}|7|O|12.50|1995-01-0{i}|1-URGENT|c|0|x|\n" for i in range(1, 7))
    )
    return folder


def test_read_raw(spark, raw):
    df = lake.read_raw_table(spark, "orders", str(raw))
    assert df.columns == columns(TABLES["orders"])
    row = df.orderBy("o_orderkey").first()
    assert (row.o_orderkey, row.o_totalprice, row.o_orderdate) == (1, 12.5, "1995-01-01")


def test_unknown_table(spark, raw):
    with pytest.raises(ValueError, match="Unknown table: shops"):
        lake.read_raw_table(spark, "shops", str(raw))


def test_convert_all_goes_on_after_a_failure(spark, raw, tmp_path):
    out = str(tmp_path / "lake")
    outcome = lake.convert_all(spark, str(raw), out, partitions=3)
    done = {name for name, error in outcome.items() if error is None}
    assert done == {"region", "nation", "orders"} and set(outcome) == set(TABLES)
    summary = {r.table_name: r for r in lake.table_summary(spark, out).collect()}
    assert list(summary) == sorted(TABLES)
    assert (summary["orders"].row_count, summary["region"].row_count) == (6, 2)
    assert summary["orders"].bytes > 0 and summary["orders"].size.endswith("KB")
    assert (summary["part"].found, summary["part"].size) == (False, "NOT FOUND")
    assert set(lake.register_tables(spark, out)) == done
    assert spark.sql("SELECT count(*) FROM orders").first()[0] == 6


def test_layout(spark):
    df = spark.range(100).repartition(20)
    assert lake.lay_out(df, "orders", 12).rdd.getNumPartitions() == 12
    assert lake.lay_out(df, "part").rdd.getNumPartitions() == 10
    assert lake.lay_out(df, "part", 4).rdd.getNumPartitions() == 4


def test_layout_by_size(spark, monkeypatch):
    df = spark.range(100).repartition(500)
    gigabyte = 1024**3
    assert lake.lay_out_by_size(df, "orders", 10).rdd.getNumPartitions() == 200
    assert lake.lay_out_by_size(df, "orders", 150 * gigabyte).rdd.getNumPartitions() == 300
    assert lake.lay_out_by_size(df, "part", 10).rdd.getNumPartitions() == 10
    assert lake.lay_out_by_size(df, "part", 20 * gigabyte).rdd.getNumPartitions() == 40


def test_convert_by_size(spark, raw, tmp_path):
    out = str(tmp_path / "lake")
    lake.convert_table(spark, "region", str(raw), out)
    assert spark.read.parquet(f"{out}/region").count() == 2
    assert lake.stored_bytes(spark, str(raw / "region.tbl")).first()["bytes"] == len(REGION)


def test_format_bytes(spark):
    sizes = [0, 1023, 1024, 1152, 1024**2 - 1, 1024**2, 5 * 1024**3, 1024**3 * 5000]
    df = spark.createDataFrame([(s,) for s in sizes], "n bigint")
    got = [r[0] for r in df.select(format_bytes(F.col("n"))).collect()]
    assert got == [
        "0 B",
        "1023 B",
        "1.00 KB",
        "1.13 KB",
        "1024.00 KB",
        "1.00 MB",
        "5.00 GB",
        "5000.00 GB",
    ]


def run(i, status, kind="OOM"):
    return (f"R{i}", kind, 1, f"{i:03d}", "2024-01-01T00:00:00", f"app_{i}", status)


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "manifest")
    first = spark.createDataFrame([run(1, "FINISHED"), run(2, "TIMEOUT")], MANIFEST)
    manifest.append_runs(first, path)
    manifest.append_runs(spark.createDataFrame([run(3, "ERROR: no, really")], MANIFEST), path)
    got = sorted(tuple(r) for r in manifest.read_manifest(spark, path).collect())
    assert got == [run(1, "FINISHED"), run(2, "TIMEOUT"), run(3, "ERROR: no, really")]


def test_manifest_text(spark, tmp_path):
    path = tmp_path / "manifest.csv"
    path.write_text(
        ",".join(columns(MANIFEST)) + "\n"
        "R1, OOM ,1, 001 ,t,app_1, FAILED \n\nshort,OOM,1\nR2,OOM,x,002,t,N/A,ERROR: a, b\n"
    )
    rows = {r.AppName: r for r in manifest.read_manifest(spark, str(path)).collect()}
    assert set(rows) == {"R1", "R2"}
    assert (rows["R1"].FailureType, rows["R1"].RunId, rows["R1"].Status) == ("OOM", "001", "FAILED")
    assert (rows["R2"].Label, rows["R2"].Status) == (None, "ERROR: a")


def test_pending_and_summary(spark):
    states = ["FINISHED", "FAILED", "TIMEOUT", "ERROR: x"]
    done = spark.createDataFrame([run(i, s) for i, s in enumerate(states, 1)], MANIFEST)
    planned = spark.createDataFrame(
        [("OOM", f"{i:03d}") for i in range(1, 6)] + [("SKEW", "001")],
        "failure_type string, run_id string",
    )
    left = {tuple(r) for r in manifest.pending_runs(planned, done).collect()}
    assert left == {("OOM", "003"), ("OOM", "004"), ("OOM", "005"), ("SKEW", "001")}
    assert [tuple(r) for r in manifest.run_summary(done).collect()] == [("OOM", 4, 1, 1, 1, 1)]


def test_planned_runs(spark):
    runs = manifest.plan_runs(spark)
    assert runs.count() == 80
    some = manifest.plan_runs(spark, {"OOM": 2, "NET": 0}).orderBy("run_id").collect()
    assert [tuple(r) for r in some] == [("OOM", "001"), ("OOM", "002")]


def test_scenarios(spark):
    df = spark.createDataFrame([(4, "data_SKEW"), (9, "nothing")], "label int, asked string")
    by_label = labels.scenarios_by_label(df).collect()
    assert [(r.label, r.name, r.tpch_query) for r in by_label] == [(4, "NETWORK_TIMEOUT", "Q1")]
    by_name = labels.scenarios_by_name(df, "asked").collect()
    assert [(r.asked, r.name) for r in by_name] == [("data_SKEW", "DATA_SKEW")]
    names = [r[0] for r in df.select(labels.scenario_name(F.col("label"))).collect()]
    assert names == ["NETWORK_TIMEOUT", "UNKNOWN(9)"]
    folders = [s.label for s in labels.SCENARIOS]
    assert sorted(labels.FOLDER_LABELS.values()) == folders == list(range(7))
