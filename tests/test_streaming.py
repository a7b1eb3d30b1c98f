from slatework.plans.builder import Q, f64
from slatework.plans.lower import lower


def test_stateless_plans_over_a_stream(spark, sf, tmp_path):
    static = spark.read.parquet(f"{sf}/events.parquet")
    static.repartition(3).write.parquet(str(tmp_path / "in"))
    q = Q.scan("events").filter_all(("event_type", "EQ", "click"), ("value", "GT", f64(50))).project("event_id", ("value", "v")).build()
    stream = spark.readStream.schema(static.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = lower(q, {"events": stream})
    assert out.isStreaming
    run = out.writeStream.format("memory").queryName("stateless_plan").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = sorted(map(tuple, spark.table("stateless_plan").collect()))
    assert got == sorted(map(tuple, lower(q, {"events": static}).collect())) and got
