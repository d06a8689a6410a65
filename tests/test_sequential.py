"""Streams that go on from a saved state, over several batches and a restart, against the whole history at once."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import design
from lattica.streaming import sequential

SCHEMA = "time_id long, asset_id long, x double, y double"


def panel(seed=1):
    rng = random.Random(seed)
    return [(t, k, float(rng.randint(0, 9)), float(rng.randint(0, 5))) for t in range(-40, 60) for k, share in enumerate((1, 0.6, 0.2)) if rng.random() < share or t in (-40, 59)]


def plain(rows, keep):
    out, past = {}, {}
    for t, k, x, y in sorted(rows):
        own = past.setdefault(k, [])
        made = sequential.recent_features(np.array([a for a, _, _ in own]), np.array([[b, c] for _, b, c in own]).reshape(len(own), 2), t, np.array([x, y]))
        out[t, k] = (*made, made[0] * 2 + made[1] - made[3])
        own.append((t, x, y))
        del own[:-keep]
    return out, past


def test_batches_restart_and_state(spark, tmp_path):
    rows, keep = panel(), 4
    want, past = plain(rows, keep)
    df = spark.createDataFrame(rows, SCHEMA)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    design.saved_state(df.filter("time_id < 0"), ["x", "y"], keep).write.parquet(f"file://{tmp_path}/state")
    processor = sequential.Predictor(["x", "y"], keep, sequential.recent_features, sequential.RECENT, lambda x: x[:, 0] * 2 + x[:, 1] - x[:, 3])
    got = None
    for k, (low, high) in enumerate(((0, 20), (20, 35), (35, 50), (50, 60))):
        df.filter(F.col("time_id").between(low, high - 1)).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        if k % 2:
            got = sequential.predict_files(spark, f"file://{tmp_path}/in", df.schema, f"file://{tmp_path}/state", processor, f"file://{tmp_path}/out", partitions=3)
            assert got.count() == sum(0 <= t < high for t, *_ in rows)
    assert {(r.time_id, r.asset_id): pytest.approx(tuple(r)[2:]) for r in got.collect()} == {k: v for k, v in want.items() if k[0] >= 0}
    held = sequential.held_rows(spark, f"file://{tmp_path}/out").collect()
    assert sorted((r.asset_id, r.time_id, *r["values"]) for r in held) == sorted((k, *v) for k, own in past.items() for v in own)
    assert spark.conf.get("spark.sql.shuffle.partitions") == before
    # nothing new: nothing is done again
    again = sequential.predict_files(spark, f"file://{tmp_path}/in", df.schema, f"file://{tmp_path}/state", processor, f"file://{tmp_path}/out", partitions=3)
    assert again.count() == got.count()
    # a time that has passed is an error
    df.filter("time_id = 40").coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    with pytest.raises(Exception, match="must rise"):
        sequential.predict_files(spark, f"file://{tmp_path}/in", df.schema, f"file://{tmp_path}/state", processor, f"file://{tmp_path}/out", partitions=3)


def test_cold_start(spark, tmp_path):
    rows = panel(2)
    want, _ = plain(rows, 3)
    df = spark.createDataFrame(rows, SCHEMA)
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    processor = sequential.Predictor(["x", "y"], 3, sequential.recent_features, sequential.RECENT, lambda x: x[:, 0] * 2 + x[:, 1] - x[:, 3])
    got = sequential.predict_files(spark, f"file://{tmp_path}/in", df.schema, None, processor, f"file://{tmp_path}/out", partitions=2)
    assert {(r.time_id, r.asset_id): pytest.approx(tuple(r)[2:]) for r in got.collect()} == want
