"""The catalogue of queries: each a plan or data-set operator over a folder of Parquet tables, with DuckDB SQL beside it."""

from __future__ import annotations

import sqlite3
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text_format import lines
from .operators import disk_model, statistics, suites
from .plans import codec
from .plans.builder import Q, col, f64, i32, string
from .plans.lower import lower
from .plans.nodes import Query
from .sources import blocks, delimited, sinks
from .sources.catalog import SCHEMA_TYPES, Catalog, ColumnSpec, TableSpec, catalog_type, parquet_tables

Run = Callable[[SparkSession, str], DataFrame]


def _nation(prefix: str) -> Q:
    return Q.scan("nation").project(("n_nationkey", f"{prefix}_nationkey"), ("n_name", f"{prefix}_name"), ("n_regionkey", f"{prefix}_regionkey"))


def _renamed(table: str, prefix: str, *columns: str) -> Q:
    return Q.scan(table).project(*((c, f"{prefix}_{c}") for c in columns))


def _join(*relations: Q) -> Q:
    out = relations[0]
    for r in relations[1:]:
        out = out.cross(r)
    return out


T = Q.scan
#: name -> (plan, SQL)
PLANS: dict[str, tuple[Query, str]] = {
    "scan_region": (T("region").build(), "SELECT * FROM region"),
    "scan_lineitem": (T("lineitem").build(), "SELECT * FROM lineitem"),
    "filter_eq_string": (T("customer").filter("c_mktsegment", "EQ", "BUILDING").build(), "SELECT * FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "filter_eq_i32": (T("part").filter("p_size", "EQ", i32(15)).build(), "SELECT * FROM part WHERE p_size = 15"),
    "filter_ne": (T("orders").filter("o_orderstatus", "NE", "F").build(), "SELECT * FROM orders WHERE o_orderstatus <> 'F'"),
    "filter_gt_f64": (T("lineitem").filter("l_quantity", "GT", f64(45)).build(), "SELECT * FROM lineitem WHERE l_quantity > 45"),
    "filter_date_range": (
        T("orders").filter_all(("o_orderdate", "GTE", "1996-01-01"), ("o_orderdate", "LT", "1997-01-01")).build(),
        "SELECT * FROM orders WHERE o_orderdate >= '1996-01-01' AND o_orderdate < '1997-01-01'",
    ),
    "filter_lte": (T("customer").filter("c_acctbal", "LTE", f64(0)).build(), "SELECT * FROM customer WHERE c_acctbal <= 0"),
    "filter_cross_type": (T("lineitem").filter("l_quantity", "EQ", i32(10)).build(), "SELECT * FROM lineitem WHERE l_quantity = 10"),
    "filter_int_by_float": (T("part").filter_all(("p_size", "GT", f64(10.5)), ("p_size", "LTE", f64(20.0))).build(), "SELECT * FROM part WHERE p_size > 10.5 AND p_size <= 20.0"),
    "filter_col_col": (T("lineitem").filter("l_linenumber", "GT", col("l_quantity")).build(), "SELECT * FROM lineitem WHERE l_linenumber > l_quantity"),
    "filter_mixed_ne": (T("region").filter("r_name", "NE", i32(1)).build(), "SELECT * FROM region"),
    "filter_mixed_eq": (T("region").filter("r_name", "EQ", i32(1)).build(), "SELECT * FROM region WHERE false"),
    "project_rename": (T("nation").project(("n_nationkey", "id"), ("n_name", "name")).build(), "SELECT n_nationkey AS id, n_name AS name FROM nation"),
    "project_dup": (T("nation").project(("n_name", "a"), ("n_name", "b")).build(), "SELECT n_name AS a, n_name AS b FROM nation"),
    "filter_after_project": (
        T("nation").project(("n_name", "nm"), ("n_regionkey", "rk")).filter("rk", "EQ", i32(2)).project("nm").build(),
        "SELECT nm FROM (SELECT n_name AS nm, n_regionkey AS rk FROM nation) WHERE rk = 2",
    ),
    "filter_after_swap": (
        T("nation").project(("n_nationkey", "n_regionkey"), ("n_regionkey", "n_nationkey")).filter("n_nationkey", "EQ", i32(1)).build(),
        "SELECT * FROM (SELECT n_nationkey AS n_regionkey, n_regionkey AS n_nationkey FROM nation) WHERE n_nationkey = 1",
    ),
    "sort_multi": (T("supplier").sort("s_nationkey", ("s_acctbal", False)).build(), "SELECT * FROM supplier ORDER BY s_nationkey, s_acctbal DESC"),
    "cross_small": (T("nation").cross(T("region")).build(), "SELECT * FROM nation, region"),
    "equi_join_2way": (
        T("customer").cross(T("orders")).filter_all(("c_custkey", "EQ", col("o_custkey")), ("o_totalprice", "GT", f64(400000))).project("o_orderkey", "c_name", "o_totalprice").build(),
        "SELECT o_orderkey, c_name, o_totalprice FROM customer, orders WHERE c_custkey = o_custkey AND o_totalprice > 400000",
    ),
    "equi_join_multi_key": (
        _renamed("lineitem", "a", "l_orderkey", "l_suppkey", "l_linenumber").cross(_renamed("lineitem", "b", "l_orderkey", "l_suppkey", "l_linenumber"))
        .filter_all(("a_l_orderkey", "EQ", col("b_l_orderkey")), ("a_l_suppkey", "EQ", col("b_l_suppkey")), ("a_l_linenumber", "LT", col("b_l_linenumber")))
        .project(("a_l_orderkey", "ok"), ("b_l_linenumber", "ln")).build(),
        "SELECT a.l_orderkey AS ok, b.l_linenumber AS ln FROM lineitem a, lineitem b WHERE a.l_orderkey = b.l_orderkey AND a.l_suppkey = b.l_suppkey AND a.l_linenumber < b.l_linenumber",
    ),
    "theta_join_lt": (
        T("supplier").cross(T("nation")).filter("s_nationkey", "LT", col("n_nationkey")).project("s_suppkey", "n_nationkey").build(),
        "SELECT s_suppkey, n_nationkey FROM supplier, nation WHERE s_nationkey < n_nationkey",
    ),
    "self_join_ne": (
        _nation("a").cross(_nation("b")).filter_all(("a_regionkey", "EQ", col("b_regionkey")), ("a_nationkey", "NE", col("b_nationkey"))).project(("a_name", "x"), ("b_name", "y")).build(),
        "SELECT a.n_name AS x, b.n_name AS y FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey",
    ),
    "equi_join_band": (
        _renamed("orders", "a", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").cross(_renamed("orders", "b", "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"))
        .filter_all(("a_o_custkey", "EQ", col("b_o_custkey")), ("a_o_orderdate", "LT", col("b_o_orderdate")), ("a_o_totalprice", "GT", col("b_o_totalprice")))
        .project(("a_o_orderkey", "a"), ("b_o_orderkey", "b")).build(),
        "SELECT o1.o_orderkey AS a, o2.o_orderkey AS b FROM orders o1, orders o2 WHERE o1.o_custkey = o2.o_custkey AND o1.o_orderdate < o2.o_orderdate AND o1.o_totalprice > o2.o_totalprice",
    ),
    "q2_shape": (
        _join(T("part"), T("supplier"), T("lineitem"), T("nation"), T("region"))
        .filter_all(("p_partkey", "EQ", col("l_partkey")), ("s_suppkey", "EQ", col("l_suppkey")), ("p_size", "EQ", i32(15)), ("s_nationkey", "EQ", col("n_nationkey")), ("n_regionkey", "EQ", col("r_regionkey")), ("r_name", "EQ", "EUROPE"))
        .sort(("s_acctbal", False), "n_name", "s_name", "p_partkey").project("s_acctbal", "s_name", "n_name", "p_partkey", "p_brand").build(),
        "SELECT s_acctbal, s_name, n_name, p_partkey, p_brand FROM part, supplier, lineitem, nation, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size = 15 AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'",
    ),
    "q3_shape": (
        _join(T("customer"), T("orders"), T("lineitem"))
        .filter_all(("c_mktsegment", "EQ", "BUILDING"), ("c_custkey", "EQ", col("o_custkey")), ("l_orderkey", "EQ", col("o_orderkey")), ("o_orderdate", "LT", "1995-03-15"), ("l_shipdate", "GT", "1995-03-15"))
        .sort("o_orderdate", "l_orderkey").project("l_orderkey", "o_orderdate", "l_extendedprice").build(),
        "SELECT l_orderkey, o_orderdate, l_extendedprice FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < '1995-03-15' AND l_shipdate > '1995-03-15'",
    ),
    "q5_shape": (
        _join(T("lineitem"), T("customer"), T("orders"), T("nation"), T("region"), T("supplier"))
        .filter_all(("c_custkey", "EQ", col("o_custkey")), ("l_orderkey", "EQ", col("o_orderkey")), ("l_suppkey", "EQ", col("s_suppkey")), ("c_nationkey", "EQ", col("s_nationkey")), ("s_nationkey", "EQ", col("n_nationkey")), ("n_regionkey", "EQ", col("r_regionkey")), ("r_name", "EQ", "ASIA"), ("o_orderdate", "GTE", "1994-01-01"), ("o_orderdate", "LT", "1999-01-01"))
        .project("n_name", "l_extendedprice", "l_discount").build(),
        "SELECT n_name, l_extendedprice, l_discount FROM lineitem, customer, orders, nation, region, supplier WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= '1994-01-01' AND o_orderdate < '1999-01-01'",
    ),
    "q7_shape": (
        _join(T("supplier"), T("lineitem"), T("orders"), T("customer"), _nation("n1"), _nation("n2"))
        .filter_all(("s_suppkey", "EQ", col("l_suppkey")), ("o_orderkey", "EQ", col("l_orderkey")), ("c_custkey", "EQ", col("o_custkey")), ("s_nationkey", "EQ", col("n1_nationkey")), ("c_nationkey", "EQ", col("n2_nationkey")), ("n1_name", "EQ", "NATION_6"), ("n2_name", "EQ", "NATION_7"))
        .project(("n1_name", "supp_nation"), ("n2_name", "cust_nation"), "l_shipdate").build(),
        "SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, l_shipdate FROM supplier, lineitem, orders, customer, nation n1, nation n2 WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey AND n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7'",
    ),
    "q8_shape": (
        _join(T("part"), T("supplier"), T("lineitem"), T("orders"), T("customer"), _nation("n1"), _nation("n2"), T("region"))
        .filter_all(("p_partkey", "EQ", col("l_partkey")), ("s_suppkey", "EQ", col("l_suppkey")), ("l_orderkey", "EQ", col("o_orderkey")), ("o_custkey", "EQ", col("c_custkey")), ("c_nationkey", "EQ", col("n1_nationkey")), ("n1_regionkey", "EQ", col("r_regionkey")), ("s_nationkey", "EQ", col("n2_nationkey")), ("r_name", "EQ", "AMERICA"))
        .project("o_orderkey", ("n2_name", "nation"), "l_extendedprice").build(),
        "SELECT o_orderkey, n2.n_name AS nation, l_extendedprice FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND s_nationkey = n2.n_nationkey AND r_name = 'AMERICA'",
    ),
    "q10_shape": (
        _join(T("customer"), T("orders"), T("lineitem"), T("nation"))
        .filter_all(("c_custkey", "EQ", col("o_custkey")), ("l_orderkey", "EQ", col("o_orderkey")), ("c_nationkey", "EQ", col("n_nationkey")), ("l_returnflag", "EQ", "R"), ("o_orderdate", "GTE", "1995-01-01"), ("o_orderdate", "LT", "1996-01-01"))
        .project("c_custkey", "c_name", "l_extendedprice", "c_acctbal", "n_name").build(),
        "SELECT c_custkey, c_name, l_extendedprice, c_acctbal, n_name FROM customer, orders, lineitem, nation WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND c_nationkey = n_nationkey AND l_returnflag = 'R' AND o_orderdate >= '1995-01-01' AND o_orderdate < '1996-01-01'",
    ),
    "part_brand_join": (
        T("lineitem").cross(T("part")).filter_all(("p_partkey", "EQ", col("l_partkey")), ("p_brand", "EQ", "Brand#2"), ("l_quantity", "LT", f64(5))).project("l_orderkey", "p_name").build(),
        "SELECT l_orderkey, p_name FROM lineitem, part WHERE p_partkey = l_partkey AND p_brand = 'Brand#2' AND l_quantity < 5.0",
    ),
    "docs_labels_join": (
        T("documents").cross(T("labels").project(("doc_id", "label_doc"), "quality")).filter_all(("doc_id", "EQ", col("label_doc")), ("lang", "EQ", string("en")), ("quality", "EQ", i32(1))).project("doc_id", "lang", "quality").build(),
        "SELECT d.doc_id, lang, quality FROM documents d, labels l WHERE d.doc_id = l.doc_id AND lang = 'en' AND quality = 1",
    ),
    "events_filter": (
        T("events").filter_all(("event_type", "EQ", "click"), ("value", "GT", f64(50))).project("event_id", "user_id", "value").build(),
        "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND value > 50.0",
    ),
}


def _plan(query: Query) -> Run:
    return lambda spark, sf_dir: lower(query, parquet_tables(spark, sf_dir))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q3_shape, by way of its JSON text."""
    return lower(codec.loads(codec.dumps(PLANS["q3_shape"][0])), parquet_tables(spark, sf_dir))


def join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lower(PLANS["equi_join_2way"][0], parquet_tables(spark, sf_dir), strategy="merge")


def join_shuffle_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lower(PLANS["equi_join_2way"][0], parquet_tables(spark, sf_dir), strategy="shuffle_hash")


def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines(_table(spark, sf_dir, "customer"))


def delimited_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as bar-delimited lines and back."""
    df = _table(spark, sf_dir, "supplier")
    return delimited.parse_lines(lines(df), df.schema)


def block_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as blocks of packed rows and back."""
    df = _table(spark, sf_dir, "part")
    return blocks.decode(blocks.encode(df), df.schema)


def stat_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return statistics.summary(df, exact=True).select("column_name", F.col("lower_bound").cast("long").alias("lower_bound"), F.col("upper_bound").cast("long").alias("upper_bound"))


def stat_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.summary(_table(spark, sf_dir, "customer"), exact=True).select("column_name", "row_count", "distinct_count")


def stat_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.summary(_table(spark, sf_dir, "customer"), exact=True).select("column_name", F.round(F.col("density").cast("double"), 6).alias("density"))


def stat_distinct_estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact up to the limit, estimated beyond it: whether each count is, exactly or within three errors, the true one."""
    orders = _table(spark, sf_dir, "orders")
    true = statistics.summary(orders, exact=True).select("column_name", F.col("distinct_count").alias("n"))
    off = F.abs(F.col("distinct_count") - F.col("n"))
    fine = F.when(F.col("n") <= statistics.EXACT_LIMIT, off == 0).otherwise(off <= 3 * statistics.ERROR * F.col("n"))
    return statistics.summary(orders).join(true, "column_name").select("column_name", "row_count", F.col("n").alias("true_count"), fine.alias("is_near"))


def stat_histogram_p_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(_table(spark, sf_dir, "part"), "p_brand")


def stat_histogram_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequencies of a histogram that is made from a sample and scaled to the table."""
    return statistics.sampled_histogram(_table(spark, sf_dir, "lineitem"), "l_quantity").select("bucket", "frequency")


def stat_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.summary(_table(spark, sf_dir, "region").limit(0)).select("column_name", "row_count", "distinct_count")


def stat_histogram_p_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.histogram(_table(spark, sf_dir, "part"), "p_size")


def stat_physical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return statistics.in_order(_table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"])


def _trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace of block accesses made up from the events."""
    e = _table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "purchase", "write").otherwise("read")
    return e.select(F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("user_id") * 37 % 100_000).alias("start_block"), (F.col("event_id") % 33).alias("num_blocks"))


def _folder(spark: SparkSession) -> Path:
    """A new folder for files that the driver writes: below the shared one where that is a plain path."""
    shared = (spark.conf.get("spark.checkpoint.dir", None) or "").removeprefix("file://").removeprefix("file:")
    base = shared if shared.startswith("/") else tempfile.gettempdir()
    Path(base).mkdir(parents=True, exist_ok=True)
    return Path(tempfile.mkdtemp(prefix="slatework-files-", dir=base))


def delimited_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as a bar-delimited file with a schema file beside it, found in its folder and read."""
    df, folder = _table(spark, sf_dir, "supplier"), _folder(spark)
    names = {v: k for k, v in SCHEMA_TYPES.items()}
    types = "|".join(names[catalog_type(f.dataType)] for f in df.schema.fields)
    (folder / "supplier.schema").write_text("|".join(df.columns) + "\n" + types + "\n", encoding="utf-8")
    with open(folder / "supplier.csv", "w", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in sinks.stream_text(df, None))
    return delimited.tables(spark, folder)["supplier"]


def block_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a block file and read again."""
    df, path = _table(spark, sf_dir, "part"), _folder(spark) / "part.bin"
    blocks.write(df, path)
    return blocks.read(spark, f"file://{path}", df.schema)


def sqlite_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as a SQLite table and read again."""
    df, path = _table(spark, sf_dir, "nation"), _folder(spark) / "nation.sqlite"
    sinks.write_sqlite({"nation": df}, path)
    with sqlite3.connect(path) as db:
        rows = db.execute("SELECT * FROM nation").fetchall()
    db.close()
    return spark.createDataFrame(rows, df.schema)


def catalog_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a saved and loaded catalog says of nation: types and distinct values of its columns."""
    df, path = _table(spark, sf_dir, "nation"), _folder(spark) / "catalog.json"
    found = statistics.collect(df)
    columns = [ColumnSpec(f.name, t := catalog_type(f.dataType), found[f.name].to_json(t)) for f in df.schema.fields]
    Catalog([TableSpec("nation", "nation", columns)]).save(path)
    loaded = Catalog.load(path)["nation"]
    rows = [(c.name, c.type, next(x["CardinalityStat"] for x in c.stats if "CardinalityStat" in x)) for c in loaded.columns]
    return spark.createDataFrame(rows, "column_name string, data_type string, distinct_count bigint")


def disk_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files of as many blocks as some tables have rows lie."""
    sizes = [(t, 4096 * _table(spark, sf_dir, t).count()) for t in ("region", "nation", "customer", "lineitem")]
    extents, _ = disk_model.layout(sizes)
    return spark.createDataFrame([(e.file_id, e.start_block, e.num_blocks) for e in extents], "file_id string, start_block bigint, num_blocks bigint")


def suite_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suites that pass in any order and in order, differ from the expected lines, and fail while they run."""
    folder, tables = _folder(spark), parquet_tables(spark, sf_dir)
    plan = T("nation").sort("n_nationkey").build()
    right = list(sinks.stream_text(lower(plan, tables), None))
    for name, said in (("ordered", right), ("reversed", right[::-1]), ("short", right[:-1])):
        (folder / name).write_text("\n".join(said) + "\n", encoding="utf-8")
    fails = _table(spark, sf_dir, "nation").select(F.raise_error(F.lit("no such block")).cast("long").alias("n_nationkey"))
    cases = [
        ("any_order", plan, "reversed", True, tables), ("in_order", plan, "ordered", False, tables), ("wrong_order", plan, "reversed", False, tables),
        ("missing_line", plan, "short", True, tables), ("failing", T("nation").build(), "ordered", True, {"nation": fails}),
    ]
    outcomes = [o for name, q, wanted, any_order, t in cases for o in suites.run_suite([suites.SuiteQuery(name, q, folder / wanted, sort_before_check=any_order)], t, spark)]
    return spark.createDataFrame([(o.name, o.passed) for o in outcomes], "name string, passed boolean")


def disk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return disk_model.metrics(_trace(spark, sf_dir))


OTHERS: dict[str, Run] = {
    f.__name__: f
    for f in (
        json_plan, join_merge, join_shuffle_hash, result_lines, delimited_round_trip, block_round_trip, stat_range, stat_distinct,
        stat_density, stat_distinct_estimated, stat_histogram_p_size, stat_histogram_p_brand, stat_histogram_sampled, stat_empty, stat_physical_order,
        delimited_file, block_file, sqlite_file, catalog_file, disk_layout, suite_outcomes, disk_metrics,
    )
}

_CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
_ORDERS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
OTHERS_SQL: dict[str, str] = {
    "json_plan": PLANS["q3_shape"][1],
    "join_merge": PLANS["equi_join_2way"][1],
    "join_shuffle_hash": PLANS["equi_join_2way"][1],
    "result_lines": "SELECT c_custkey || '|' || c_name || '|' || c_nationkey || '|' || CAST(c_acctbal AS VARCHAR) || '|' || c_mktsegment || '|' AS value FROM customer",
    "delimited_round_trip": "SELECT * FROM supplier",
    "block_round_trip": "SELECT * FROM part",
    "stat_range": " UNION ALL ".join(f"SELECT '{c}' AS column_name, min({c}) AS lower_bound, max({c}) AS upper_bound FROM orders" for c in ("o_orderkey", "o_custkey")),
    "stat_distinct": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS distinct_count FROM customer" for c in _CUSTOMER),
    "stat_density": " UNION ALL ".join(f"SELECT '{c}' AS column_name, round(CAST(CAST(count(DISTINCT {c}) / count(*) AS FLOAT) AS DOUBLE), 6) AS density FROM customer" for c in _CUSTOMER),
    "stat_histogram_p_size": "SELECT b AS bucket, min(p_size) AS lower_bound, max(p_size) AS upper_bound, count(*) AS frequency FROM (SELECT p_size, (row_number() OVER (ORDER BY p_size) - 1) // CAST(ceil((SELECT count(*) FROM part) / 10.0) AS BIGINT) AS b FROM part) GROUP BY b",
    "stat_histogram_p_brand": "SELECT b AS bucket, min(p_brand) AS lower_bound, max(p_brand) AS upper_bound, count(*) AS frequency FROM (SELECT p_brand, (row_number() OVER (ORDER BY p_brand) - 1) // CAST(ceil((SELECT count(*) FROM part) / 10.0) AS BIGINT) AS b FROM part) GROUP BY b",
    "stat_histogram_sampled": "WITH t AS (SELECT count(*) AS n, least(count(*), 10000) AS s, CAST(ceil(least(count(*), 10000) / 10.0) AS BIGINT) AS c FROM lineitem) SELECT b AS bucket, CAST(floor(least(c, s - b * c) * (CAST(n AS DOUBLE) / s)) AS BIGINT) AS frequency FROM t, range(10) r(b) WHERE b * c < s",
    "stat_empty": "SELECT 'x' AS column_name, CAST(0 AS BIGINT) AS row_count, CAST(0 AS BIGINT) AS distinct_count WHERE false",
    "stat_distinct_estimated": " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS row_count, count(DISTINCT {c}) AS true_count, true AS is_near FROM orders" for c in _ORDERS),
    "stat_physical_order": " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (WHERE p > x) = 0 AS is_ordered FROM (SELECT {c} AS x, lag({c}) OVER (ORDER BY n) AS p FROM (SELECT {c}, row_number() OVER () AS n FROM orders))"
        for c in ("o_orderkey", "o_totalprice")
    ),
    "delimited_file": "SELECT * FROM supplier",
    "block_file": "SELECT * FROM part",
    "sqlite_file": "SELECT * FROM nation",
    "catalog_file": " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(DISTINCT {c}) AS distinct_count FROM nation" for c, t in (("n_nationkey", "Int32"), ("n_name", "String"), ("n_regionkey", "Int32"))),
    "disk_layout": """
WITH s AS (SELECT 1 AS n, 'region' AS file_id, count(*) AS b FROM region UNION ALL SELECT 2, 'nation', count(*) FROM nation
           UNION ALL SELECT 3, 'customer', count(*) FROM customer UNION ALL SELECT 4, 'lineitem', count(*) FROM lineitem)
SELECT file_id, CAST(coalesce(sum(b + greatest(4 * b, 2441407)) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_block, b AS num_blocks FROM s
""",
    "suite_outcomes": "SELECT * FROM (VALUES ('any_order', true), ('in_order', true), ('wrong_order', false), ('missing_line', false), ('failing', false)) t(name, passed)",
    "disk_metrics": """
WITH t AS (SELECT event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'write' ELSE 'read' END AS kind, user_id * 37 % 100000 AS s, event_id % 33 AS n FROM events),
m AS (SELECT *, s + n - 1 AS e, coalesce(lag(s + n - 1) OVER (ORDER BY seq), 0) AS prev FROM t WHERE n > 0),
c AS (SELECT *, abs(s // 4096 - prev // 4096) AS d, e // 4096 - s // 4096 AS x FROM m),
k AS (SELECT n, d + x AS cyl,
        CAST(round((CASE WHEN d = 0 THEN 0 WHEN d = 1 THEN 0.8::DOUBLE ELSE 0.8::DOUBLE + (18.0::DOUBLE - 0.8::DOUBLE) * sqrt(least(d / 500000.0::DOUBLE, 1)) END + x * 0.8::DOUBLE) * 1000000) AS BIGINT) AS seek,
        CAST(round(CASE WHEN s = prev + 1 THEN 0 ELSE 0.5::DOUBLE * 60 / 7200 * 1000 END * 1000000) AS BIGINT) AS rot,
        CAST(round(n * 4096 / 1000000.0::DOUBLE / 150 * 1000 * 1000000) AS BIGINT) AS xfer FROM c)
SELECT (SELECT count(*) FROM t WHERE kind = 'read') AS total_reads, (SELECT count(*) FROM t WHERE kind = 'write') AS total_writes,
       CAST(sum(n) AS BIGINT) AS total_blocks_processed, CAST(sum(cyl) AS BIGINT) AS total_cylinders_traveled,
       CAST((sum(seek) + sum(rot) + sum(xfer) + 500) // 1000 AS BIGINT) AS total_io_time_us, CAST((sum(seek) + 500) // 1000 AS BIGINT) AS total_seek_time_us,
       CAST((sum(rot) + 500) // 1000 AS BIGINT) AS total_rotational_latency_us, CAST((sum(xfer) + 500) // 1000 AS BIGINT) AS total_transfer_time_us FROM k
""",
}

QUERIES: dict[str, Run] = {name: _plan(query) for name, (query, _) in PLANS.items()} | OTHERS
ORACLE_SQL: dict[str, str] = {name: sql for name, (_, sql) in PLANS.items()} | OTHERS_SQL
