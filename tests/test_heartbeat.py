"""Open calls are reported until they end."""

from __future__ import annotations

import time

from foliomill.streaming import heartbeat


def test_heartbeat(spark, tmp_path):
    def tell(*rows):
        spark.createDataFrame(rows, "call string, event string, label string").coalesce(1).write.mode("append").parquet(str(tmp_path / "calls"))

    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, heartbeat.PROVIDER)
    try:
        tell(("a", "started", "page 1"), ("b", "started", "page 2"), ("b", "ok", "page 2"), ("c", "error", "page 3"))
        calls = spark.readStream.schema("call string, event string, label string").parquet(str(tmp_path / "calls"))
        query = heartbeat.heartbeats(calls, 500).writeStream.format("memory").queryName("beats").outputMode("append").trigger(processingTime="1 second").option("checkpointLocation", str(tmp_path / "state")).start()
        try:
            end = time.time() + 120
            while time.time() < end and spark.sql("select * from beats where event = 'waiting'").count() < 2:
                time.sleep(1)
            tell(("a", "ok", "page 1"))
            while time.time() < end and not spark.sql("select * from beats where call = 'a' and event = 'ok'").count():
                time.sleep(1)
            rows = [tuple(r) for r in spark.sql("select call, event, message, elapsed_ms from beats").collect()]
            time.sleep(3)
            assert spark.sql("select * from beats").count() == len(rows)
        finally:
            query.stop()
        waiting = [r for r in rows if r[1] == "waiting"]
        assert len(waiting) >= 2 and {r[0] for r in waiting} == {"a"} and waiting[0][2].startswith("Model still working on page 1 (")
        assert [r[3] for r in waiting] == sorted(r[3] for r in waiting) and {(r[0], r[1]) for r in rows} == {("a", "waiting"), ("a", "ok"), ("b", "ok"), ("c", "error")}
    finally:
        spark.conf.unset(name)


def test_shown():
    assert [heartbeat.shown(x) for x in (-5, 999, 61_000, 3_661_000)] == ["0s", "0s", "1m 1s", "1h 1m 1s"]
