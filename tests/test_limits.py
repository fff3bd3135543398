"""Rolling windows of a stream against those of a batch, with restarts between."""

import datetime as dt
import random

from pyspark.sql import functions as F

from lexforge.streaming import limits, pacing

BASE = dt.datetime(2024, 1, 1)


def _rows(n=120):
    rng = random.Random(3)
    rows = [(u, i, BASE + dt.timedelta(seconds=rng.choice((2, 3, 20)) * i // 2 + (u or 0), milliseconds=rng.randrange(3) * 250), rng.choice((None, 5, 70))) for i in range(n) for u in (1, 2, None)]
    return [*rows, (1, 9001, BASE + dt.timedelta(seconds=10), 1), (1, 9002, BASE + dt.timedelta(seconds=70), 1), (1, 9003, BASE + dt.timedelta(seconds=70), 4)]


def test_stream_equals_batch_after_restarts(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "user_id int, event_id int, ts timestamp, tokens int"
    rows = sorted(_rows(), key=lambda r: (r[2], r[1]))
    end = [(u, -1, BASE + dt.timedelta(days=2), 1) for u in (1, 2, None)]
    parts = [rows[::3], rows[1::3] + [(1, 9999, None, 5)], rows[2::3], end, [(1, -1, BASE + dt.timedelta(days=3), 1)]]  # each part is out of order to the one before
    batch = spark.createDataFrame(rows, schema)
    want = sorted((str(r.user_id), r.event_id, r.tokens_60s, r.requests_60s) for r in pacing.rolling(batch.withColumn("tokens", F.coalesce("tokens", F.lit(0))), "user_id", "ts", "tokens", "event_id").collect())
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    for part in parts:  # a query of its own for each part: state comes back from the checkpoint
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out = limits.rolling_stream(stream, "user_id", "ts", "tokens", "event_id", late="1 hour")
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted((str(r.tenant), r.event_id, r.tokens_60s, r.requests_60s) for r in spark.read.parquet(str(tmp_path / "out")).where("event_id >= 0").collect())
    assert len(got) == len(want) and got == want
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
