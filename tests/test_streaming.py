"""The event-time stream against the batch form: out of order, late, and restarted from its checkpoint."""

import datetime as dt
import math
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from galeframe.operators import timeseries
from galeframe.streaming.ordered import SlidingScores, stream_ordered_expansions

START = dt.datetime(2024, 1, 1)
SCHEMA = "site int, raw_row long, ts timestamp, score double"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(name, before)


def test_sliding_scores_equal_sorting_each_time():
    r = random.Random(1)
    held, past = SlidingScores(7, []), []
    for _ in range(200):
        rank = math.ceil((len(past) + 1) * 0.8)
        assert held.expansion(0.2) == (sorted(past)[rank - 1] if past and rank <= len(past) else None)
        score = r.choice([0.0, 1.0, r.random()])
        held.add(score)
        past = [*past, score][-7:]


def test_equals_the_batch_form_with_disorder_late_rows_and_a_restart(rocks):
    r = random.Random(5)
    rows = [(s, 100 * s + k, START + dt.timedelta(minutes=3 * k), round(r.random(), 3)) for s in (0, 1) for k in range(60)]
    rows += [(0, 900, START + dt.timedelta(minutes=30), 0.5)]  # ties with another row in time
    batches = [[], [], []]
    for row in rows:
        batches[min(2, int((row[2] - START).total_seconds() // 3600))].append(row)
    for b in batches:
        r.shuffle(b)
    batches[0].append(batches[1].pop(0))  # early
    late = (1, 999, START, 0.9)  # two hours behind the watermark
    last = [(s, 5000 + s, START + dt.timedelta(days=1), 0.1) for s in (0, 1)]
    flush = [(s, 6000 + s, START + dt.timedelta(days=2), 0.1) for s in (0, 1)]
    folder = tempfile.mkdtemp(prefix="spark-")
    found = {}
    for number, part in enumerate([*batches, [late, *last], flush]):
        rocks.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        # every part is a new query that starts from the checkpoint of the one before
        stream = stream_ordered_expansions(rocks.readStream.schema(SCHEMA).parquet(f"{folder}/in"), 9, 0.2, "1 hour")
        query = stream.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, number
    for x in rocks.read.parquet(f"{folder}/out").collect():
        assert x.raw_row not in found
        found[x.raw_row] = x.expansion
    whole = rocks.createDataFrame(rows, SCHEMA)
    expected = {x.raw_row: x.expansion for x in timeseries.rolling_expansion(whole.withColumn("test", F.lit(True)), ["site"], ["ts", "raw_row"], "score", "test", 9, 0.2).collect()}
    assert late[1] not in found and {k: v for k, v in found.items() if k < 5000} == expected
