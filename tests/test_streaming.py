import datetime as dt

import pytest

from plumbline.streaming import rollback

T0 = dt.datetime(2024, 1, 1)
EVENT = "metric string, ts timestamp, value double"


@pytest.fixture
def stateful(spark):
    spark.conf.set(*rollback.STATE_STORE)
    yield spark
    spark.conf.unset(rollback.STATE_STORE[0])


def test_a_trigger_fires_once_a_window_over_restarts_and_late_rows(stateful, tmp_path):
    spark = stateful
    triggers = spark.createDataFrame([("high", "err", "gte", 20.0, 2, 60), ("low", "err", "lt", 0.5, 1, 60), ("other", "err", "gte", 0.0, 1, 300)], "trigger_id string, metric string, operator string, threshold double, min_samples long, window_seconds int")

    def run(*rows):
        """Adds a file of (second, value) and lets a new query, from the same checkpoint, read what is new."""
        spark.createDataFrame([(m, T0 + dt.timedelta(seconds=s), v) for m, s, v in rows], EVENT).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
        stream = spark.readStream.schema(EVENT).parquet(f"file://{tmp_path}/in")
        q = rollback.watch_early(stream, triggers, 60, "10 seconds").writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(f"file://{tmp_path}/out")).option("checkpointLocation", f"file://{tmp_path}/cp").outputMode("update").trigger(availableNow=True).start()
        assert q.awaitTermination(100)
        assert q.exception() is None
        return sorted((r.trigger_id, (r.window_start - T0).seconds, r.observed_value, r.samples) for r in spark.read.schema(rollback.FIRED).parquet(f"file://{tmp_path}/out").collect())

    first = [("high", 0, 20.0, 2)]
    assert run(("err", 1, 10.0), ("err", 2, 30.0), ("err", 3, None), ("fine", 4, 99.0), ("err", 61, 30.0)) == first
    assert run(("err", 5, 500.0), ("err", 65, 0.0)) == first  # the first window has fired; the second's mean is 15
    second = [*first, ("high", 60, 20.0, 3)]
    assert run(("err", 66, 30.0)) == second
    third = [*second, ("low", 240, 0.0, 1)]
    assert run(("err", 250, 0.0)) == sorted(third)  # the watermark is now past the first two windows
    assert run(("err", 7, 900.0), ("err", 8, 900.0), ("err", 251, 0.0)) == sorted(third)
