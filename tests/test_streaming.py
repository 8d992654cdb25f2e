from quire.plans.command_queries import TRANSCRIPT
from quire.streaming import transcripts as S


def _files(spark, tmp_path):
    t = TRANSCRIPT.df(spark).selectExpr("*", "timestamp'2026-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, seq * 20) ts")
    schema = t.schema
    for k in (1, 2):
        t.where("seq <= 2" if k == 1 else "seq > 2").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


def test_sessions_stop_at_their_first_failure(spark, tmp_path):
    from quire.operators.device import executed

    q = S.executed(_files(spark, tmp_path)).writeStream.format("memory").queryName("stops").outputMode("append").option("checkpointLocation", f"{tmp_path}/c1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("stops").collect()}
    assert got == {(r.session, r.seq, r.status) for r in executed(TRANSCRIPT.df(spark)).collect()}


def test_failures_by_window(spark, tmp_path):
    q = S.failures_by_window(_files(spark, tmp_path)).writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", f"{tmp_path}/c2").trigger(availableNow=True).start()
    q.awaitTermination(120)
    rows = spark.table("windows").collect()
    assert sum(r.outputs for r in rows) == 9 and sum(r.failures for r in rows) >= 3
