import math

import pytest

from slatework import __main__ as cli
from slatework.operators import disk_model, statistics, suites
from slatework.plans.builder import Q
from slatework.plans.nodes import PlanError


def test_summary(spark):
    df = spark.createDataFrame([(1, "a", 2.0), (3, "b", 2.0), (3, None, 1.0)], "k int, s string, x double")
    got = {r[0]: tuple(r)[1:] for r in statistics.summary(df).collect()}
    assert got["k"][:4] == (3, "1", "3", 2) and got["s"][:4] == (3, None, None, 2) and abs(got["x"][4] - 2 / 3) < 1e-6
    assert statistics.summary(df.limit(0)).count() == 0
    with pytest.raises(PlanError):
        statistics.summary(df, ["nope"])


def test_histogram(spark):
    df = spark.range(95).selectExpr("id % 7 AS v")
    values = sorted(i % 7 for i in range(95))
    want = [(b, c[0], c[-1], len(c)) for b in range(10) if (c := values[b * 10 : (b + 1) * 10])]
    assert sorted(map(tuple, statistics.histogram(df, "v").collect())) == want
    assert statistics.histogram(df.limit(0), "v").count() == 0


def test_large_histogram_scales(spark):
    got = statistics.histogram(spark.range(30_000).toDF("v"), "v").collect()
    assert len(got) == 10 and all(r["frequency"] == 3000 for r in got)


def test_large_histogram_counts_every_row(spark):
    df = spark.range(30_007).selectExpr("IF(id % 3 = 0, 5, id * 7919 % 30007) AS v")
    values = sorted(5 if i % 3 == 0 else i * 7919 % 30_007 for i in range(30_007))
    want = [(b, c[0], c[-1], len(c)) for b in range(10) if (c := values[b * 3001 : (b + 1) * 3001])]
    assert sorted(map(tuple, statistics.histogram(df, "v").collect())) == want


def test_physical_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(statistics, "RUN_ROWS", 7)
    rows = [(i, i % 50, 5, None) for i in range(100)]
    spark.createDataFrame(rows, "up int, saw int, flat int, none int").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = dict(map(tuple, statistics.in_order(spark.read.parquet(str(tmp_path / "t"))).collect()))
    assert got == {"up": True, "saw": False, "flat": True, "none": True}


def brute(trace, d):
    end = cyl = 0
    out = [0] * 8
    for _, kind, start, n in sorted(trace):
        out[0 if kind == "read" else 1] += 1
        if not n:
            continue
        per = d.blocks_per_track * d.heads_per_cylinder
        a, b = start // per, (start + n - 1) // per
        gap, crossed = abs(cyl - a), b - a
        seek = 0 if gap == 0 else d.track_to_track_seek_ms if gap == 1 else d.track_to_track_seek_ms + (d.full_stroke_seek_ms - d.track_to_track_seek_ms) * math.sqrt(min(1, gap / d.total_cylinders))
        parts = [seek + crossed * d.track_to_track_seek_ms, 0 if start == end + 1 else 30000 / d.rpm, n * d.block_size / 1e6 / d.transfer_rate_mb_s * 1000]
        ns = [round(p * 1e6) for p in parts]
        out[2] += n
        out[3] += gap + crossed
        for i, v in enumerate([sum(ns), *ns]):
            out[4 + i] += v
        cyl, end = b, start + n - 1
    return out[:4] + [(x + 500) // 1000 for x in out[4:]]


def test_disk_costs(spark, monkeypatch):
    monkeypatch.setattr(disk_model, "RUN", 5)
    trace = [(1, "read", 1, 4), (2, "read", 5, 8), (3, "write", 9_000_000, 32), (4, "read", 4090, 10), (5, "read", 0, 0), (6, "write", 4100, 1), (9, "read", 3_000_000_000, 2), (12, "read", 3_000_000_002, 2)]
    df = spark.createDataFrame(trace, "seq long, kind string, start_block long, num_blocks long")
    assert list(disk_model.metrics(df).first()) == brute(trace, disk_model.Disk())
    assert list(disk_model.metrics(df.limit(0)).first()) == [0] * 8


def test_layout_and_protocol(spark):
    extents, scratch = disk_model.layout([("a", 8192), ("b", 4096)])
    gap = -(-10_000_000_000 // 4096)
    assert [(e.start_block, e.num_blocks) for e in extents] == [(0, 2), (2 + gap, 1)] and scratch == 3 + 2 * gap
    for bad in ([("a b", 4096)], [("a", 0)], [("a", 100)]):
        with pytest.raises(PlanError):
            disk_model.layout(bad)
    store = disk_model.BlockStore([("a", 8192)])
    assert store.request("get block-size") == "4096" and store.request("get file num-blocks a") == "2" and store.request("get file start-block a") == "0"
    assert store.request("GET block 0 2") == "" and store.request(f"put block {store.scratch} 1") == "" and store.request("exit") is None
    for bad in ("get file num-blocks z", "put block 0 1", "jump", "get block x 1"):
        with pytest.raises(PlanError):
            store.request(bad)
    assert store.metrics(spark).first()["total_blocks_processed"] == 3
    with pytest.raises(PlanError):
        disk_model.Disk(block_size=0)


def test_suites(spark, tmp_path):
    t = {"t": spark.createDataFrame([(1, "a"), (2, "b")], "k int, s string").coalesce(1)}
    (tmp_path / "good").write_text("2|b|\n1|a|\n")
    (tmp_path / "ordered").write_text("1|a|\n2|b|\n\nignored\n")
    (tmp_path / "bad").write_text("1|a|\n3|c|\n")
    q = Q.scan("t").build()
    make = suites.SuiteQuery
    good = [make("any order", q, tmp_path / "good", sort_before_check=True), make("ordered", Q.scan("t").sort("k").build(), tmp_path / "ordered"), make("off", q, tmp_path / "bad", disabled=True)]
    suites.save_suite(good, tmp_path / "s.json")
    assert all(o.passed for o in suites.run_suite(suites.load_suite(tmp_path / "s.json"), t, spark))
    bad = [make("wrong", q, tmp_path / "bad", sort_before_check=True), good[0]]
    assert [o.passed for o in suites.run_suite(bad, t, spark)] == [False]
    assert not suites.run_suite([make("order", q, tmp_path / "good")], t, spark)[0].passed
    for kw in ({"expected": tmp_path / "none"}, {"expected": tmp_path / "good", "memory_limit_mb": 10}):
        with pytest.raises(PlanError):
            make("x", q, **kw)


def test_command_line(spark, tmp_path, capsys):
    data, out, run = tmp_path / "data", tmp_path / "out", tmp_path / "run"
    data.mkdir()
    (data / "t.schema").write_text("a|s\nI32|STRING\n")
    (data / "t.csv").write_text("1|x|\n2|y|\n2|x|\n")
    assert cli.main(["all", "-d", str(data), "-c", str(out), "-r", str(run)]) == 0
    assert (out / "t.bin").stat().st_size == 4096 and (out / "database.sqlite").exists()
    disk, sizes = disk_model.load_config(run / "disk_sim_config.json")
    assert disk == disk_model.Disk() and sizes == [("t", 4096)]
    (out / "t.bin").write_bytes(b"")
    with pytest.raises(PlanError):
        disk_model.load_config(run / "disk_sim_config.json")
    stats = {c["column_name"]: c["stats"] for c in __import__("json").loads((run / "db_config.json").read_text())["table_specs"][0]["column_specs"]}
    assert stats["a"][0] == "IsPhysicallyOrdered" and "IsPhysicallyOrdered" not in stats["s"] and {"CardinalityStat": 2} in stats["a"]
    assert len(suites.load_suite(run / "monitor_config.json")) == 2
    assert cli.main(["example"]) == 0 and '"Cross"' in capsys.readouterr().out
