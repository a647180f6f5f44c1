"""Streams whose rows come out of order over many batches give what the batch form gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terrafold.operators import ledger as L
from terrafold.streaming import features as T
from terrafold.streaming.drain import drain


@pytest.fixture(scope="module")
def shuffled(spark, tmp_path_factory):
    """Twelve files of an hour of events each, each two neighbours swapped, rows shuffled inside."""
    rng = np.random.default_rng(5)
    n = 720
    status = np.array(["Running", "Succeeded", "Failed", "Cancelled", "Queued"])
    d = pd.DataFrame({"run_id": rng.integers(0, 90, n), "seq": np.arange(n), "status": rng.choice(status, n),
                      "at": pd.Timestamp("2024-03-01") + pd.to_timedelta(np.arange(n), unit="min")})
    path = tmp_path_factory.mktemp("events")
    schema = "run_id long, seq long, status string, at timestamp_ntz"
    for i, hour in enumerate(np.arange(12).reshape(6, 2)[:, ::-1].ravel()):
        part = d[hour * 60:hour * 60 + 60].sample(frac=1, random_state=int(hour))
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.createDataFrame(d, schema), str(path), schema


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_run_status_out_of_order(spark, shuffled):
    events, path, schema = shuffled
    live = drain(T.stream_runs(T.landing(spark, path, schema, files_per_batch=1), "3 hours"), "update", ["run_id"])
    assert rows(live.select("run_id", "status", "illegal").where("status <> 'Queued' or illegal > 0")) == \
        rows(L.fold_runs(events).select("run_id", "status", "illegal").where("status <> 'Queued' or illegal > 0"))


@pytest.mark.parametrize("minutes", [7.0, 90.0])
def test_cache_out_of_order(spark, shuffled, minutes):
    events, path, schema = shuffled
    requests = lambda d: d.select((F.col("run_id") % 9).alias("key"), "seq", "at")
    live = drain(T.stream_cache(requests(T.landing(spark, path, schema, files_per_batch=1)), minutes, "3 hours"), "update", ["key", "seq"])
    until, want = {}, []
    for key, seq, at in rows(requests(events)):
        hit = key in until and at < until[key]
        if not hit:
            until[key] = at + pd.Timedelta(minutes=minutes)
        want.append((key, seq, hit))
    assert rows(live.select("key", "seq", "hit")) == want
