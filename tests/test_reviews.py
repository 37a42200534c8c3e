"""Review progress: the fold over a table against a plain scan, and the stream against the fold, with a restart between."""

from __future__ import annotations

import random
from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from variorum.streaming import reviews as R

FIELDS = "card long, ts timestamp, id long, correct boolean, difficulty int"
BEGIN = datetime(2024, 1, 1, tzinfo=timezone.utc)


def scan(rows):
    out = {}
    for card, ts, id_, correct, difficulty in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2] or 0)):
        level, n, right, _ = out.get(card, (0, 0, 0, None))
        d = R.USUAL if difficulty is None else difficulty
        if correct and d >= 4:
            level = min(5, level + 1)
        elif not correct or d <= 2:
            level = max(0, level - 1)
        out[card] = (level, n + 1, right + bool(correct), ts.replace(tzinfo=None))
    return out


def told(rows):
    return {r.card: (r.mastery, r.times_reviewed, r.times_correct, r.last_reviewed) for r in rows}


def reviews(r, n, cards):
    return [(r.choice(cards), BEGIN + timedelta(seconds=r.randint(0, 5000)), k, r.random() < 0.7, r.randint(1, 5)) for k in range(n)]


def test_fold(spark):
    r = random.Random(3)
    rows = reviews(r, 3000, [1] * 5 + list(range(2, 30))) + [(None, BEGIN, 1, True, 5), (1, None, 2, True, 5), (40, BEGIN, None, None, None), (41, BEGIN, 1, True, None)]
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("7", "10000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        assert told(R.progress(spark.createDataFrame(rows, FIELDS).repartition(5)).collect()) == scan(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert R.progress(spark.createDataFrame([], FIELDS)).count() == 0


def test_stream_with_a_restart(spark, tmp_path):
    r = random.Random(8)
    rows = sorted(reviews(r, 400, list(range(12))), key=lambda x: x[1])
    parts = [rows[:150], rows[150:300], rows[300:], [(99, BEGIN + timedelta(days=1), 0, True, 5)], [(99, BEGIN + timedelta(days=2), 1, True, 5)]]
    for p in parts:
        r.shuffle(p)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for k, p in enumerate(parts):
            spark.createDataFrame(p, FIELDS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if k == 1:
                continue  # this one waits for the second start
            stream = spark.readStream.schema(FIELDS).parquet(str(tmp_path / "in"))
            q = R.progress_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            q.awaitTermination(120)
            assert q.exception() is None
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    out = spark.read.parquet(str(tmp_path / "out"))
    last = out.groupBy("card").agg(F.max_by(F.struct("*"), "times_reviewed").alias("x")).select("x.*").where("card <> 99")
    want = {c: v for c, v in scan([x for p in parts for x in p]).items() if c != 99}
    assert told(last.collect()) == want
    assert out.count() > len(want)
