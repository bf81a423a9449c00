"""Rules that a shorter one would get wrong: the throttle, the last known quote, tellings of names."""

import datetime as dt
import random

from pyspark.sql import functions as F

from boutline.operators import feed, market
from boutline.sources.views import on_workers


def test_throttle_counts_from_the_last_call_let_through(spark):
    on_workers(spark)
    rng, start = random.Random(3), dt.datetime(2024, 1, 1)
    rows = [(i, f"k{rng.choice([0, 0, 0, 0, 1, 2])}", start + dt.timedelta(minutes=rng.choice([0, 5, 30, 59, 60, 61, 600]) + 7 * rng.randrange(400))) for i in range(600)]
    rows += [(1000, "steady", start)] + [(1000 + j, "steady", start + dt.timedelta(minutes=40 * j)) for j in range(1, 9)] + [(2000, "once", start), (3000, "gone", None)]
    want, last = set(), {}
    for i, key, ts in sorted((r for r in rows if r[2]), key=lambda r: (r[2], r[0])):
        if key not in last or ts - last[key] >= dt.timedelta(minutes=60):
            want.add(i)
            last[key] = ts
    got = feed.throttled(spark.createDataFrame(rows, "id long, k string, ts timestamp"), "k", "id", "ts", 60)
    assert {r.id for r in got.collect()} == want
    assert {i for i in want if 1000 <= i < 2000} == {1000, 1002, 1004, 1006, 1008}  # against the call before, refused or not, only the first would pass
    assert feed.throttled(spark.createDataFrame([], "id long, k string, ts timestamp"), "k", "id", "ts", 60).count() == 0


def test_last_quote_is_the_last_known_of_each_column(spark):
    rows = [(1, "x", "2024-01-01", 1, 0.4, 2.0, 2.1), (1, "x", "2024-01-02", 2, 0.5, None, 2.2), (1, "x", "2024-01-03", 3, None, None, 2.3), (2, "x", "2024-01-01", 4, None, 1.5, None)]
    quotes = spark.createDataFrame(rows, "pair long, source string, snap string, quote_id long, p1 double, o1 double, o2 double").withColumn("snap", F.col("snap").cast("timestamp"))
    got = {r.pair: (r.p1, r.o1, r.o2) for r in market.last_per_source(quotes).collect()}
    assert got == {1: (0.5, 2.0, 2.3), 2: (None, 1.5, None)}
