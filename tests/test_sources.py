import json
import sqlite3

import pytest

from slatework.functions.text_format import format_float, lines
from slatework.plans.nodes import PlanError
from slatework.sources import blocks, delimited, sinks
from slatework.sources.catalog import Catalog, ColumnSpec, TableSpec, parquet_tables


def test_float_text():
    cases = {3.0: "3.0", 2.5: "2.5", -0.0: "-0.0", 1e15: "1000000000000000", 1e20: "100000000000000000000", 0.0001: "0.0001", 1e-7: "0.0000001", 123456789.0: "123456789.0", 0.1 + 0.2: "0.30000000000000004"}
    assert {x: format_float(x) for x in cases} == cases


def test_lines(spark):
    df = spark.createDataFrame([(0, "ALGERIA", 1e-5, 0.1), (1, "", 3.0, 2.0), (None, "x", 1e8, float("inf"))], "a int, s string, d double, f float")
    assert [r[0] for r in lines(df).collect()] == ["0|ALGERIA|0.00001|0.10000000149011612|", "1||3.0|2.0|", "|x|100000000.0|inf|"]


def test_schema_and_delimited(spark, tmp_path):
    (tmp_path / "t.schema").write_text("a|b|c|\nI32|string|Float64|\n")
    (tmp_path / "t.csv").write_text("1|x|2.5|\n2||3|\n3|y|0\n")
    (tmp_path / "orphan.csv").write_text("1\n")
    found = delimited.tables(spark, tmp_path)
    assert list(found) == ["t"]
    assert [tuple(r) for r in found["t"].collect()] == [(1, "x", 2.5), (2, "", 3.0), (3, "y", 0.0)]


@pytest.mark.parametrize("line", ["1|x", "1|x|2|3|", "z|x|2.5|", "1|x|abc|", ""])
def test_bad_lines_raise(spark, tmp_path, line):
    (tmp_path / "t.csv").write_text(f"1|x|2.5|\n{line}\n2|y|1|\n")
    with pytest.raises(Exception, match="expected 3 fields|not "):
        delimited.read(spark, str(tmp_path / "t.csv"), delimited.parse_schema("a|b|c\nI32|STRING|FLOAT64")).collect()


def test_bad_schema():
    for text in ("a|b", "a|b\nI32", "a\nDATE"):
        with pytest.raises(PlanError):
            delimited.parse_schema(text)


def test_block_files(spark, tmp_path):
    rows = [(i, i * 10**10, i / 4, i / 3, "é" * (i % 7)) for i in range(500)]
    df = spark.createDataFrame(rows, "a int, b long, c float, d double, s string").coalesce(1)
    n = blocks.write(df, tmp_path / "t.bin", 512)
    data = (tmp_path / "t.bin").read_bytes()
    assert len(data) == 512 * n and int.from_bytes(data[510:512], "little") > 0
    assert sorted(map(tuple, blocks.read(spark, str(tmp_path / "t.bin"), df.schema, 512).collect())) == sorted(map(tuple, df.collect()))
    assert blocks.encode(df.limit(0)).count() == 0


def test_blocks_refuse(spark):
    for rows in ([("x" * 600,)], [("a\0b",)], [(None,)]):
        with pytest.raises(Exception, match="doesn't fit|zero byte|no nulls"):
            blocks.encode(spark.createDataFrame(rows, "s string"), 512).collect()


def test_sqlite_and_text(spark, tmp_path):
    df = spark.createDataFrame([(1, 'say "hi"', 0.5), (2, "b", None)], "a int, s string, x double").coalesce(1)
    sinks.write_sqlite({"t": df}, tmp_path / "d.sqlite")
    assert sqlite3.connect(tmp_path / "d.sqlite").execute("SELECT * FROM t").fetchall() == [(1, 'say "hi"', 0.5), (2, "b", None)]
    assert list(sinks.stream_text(df)) == ['1|say "hi"|0.5|', "2|b||", "!"]
    sinks.write_text(df, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 2


def test_catalog(tmp_path):
    c = Catalog([TableSpec("t", "t", [ColumnSpec("a", "Int32", ["IsPhysicallyOrdered", {"CardinalityStat": 3}])])])
    c.save(tmp_path / "c.json")
    assert Catalog.load(tmp_path / "c.json") == c and c["t"].schema.fieldNames() == ["a"]
    assert set(json.loads((tmp_path / "c.json").read_text())) == {"table_specs"}
    with pytest.raises(PlanError):
        Catalog.from_json({"table_specs": [{"name": "t"}]})
    with pytest.raises(PlanError):
        c["nope"]


def test_unknown_parquet_table(spark, sf):
    with pytest.raises(PlanError):
        parquet_tables(spark, sf)("nope")
