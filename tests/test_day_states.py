"""Day states merged batch by batch equal the statistics of all observations at once."""

from __future__ import annotations

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from stratus.operators import current as A
from stratus.sources.fixture import load_airports, load_observations
from stratus.streaming import read_observations_stream
from stratus.streaming.daystate import (compact_day_states, extremes_from_states, fog_low_cloud_from_states, rain_thunder_from_states,
                                        read_day_states, update_day_states)
from tests.test_one_scan import rows


@pytest.fixture(scope="module")
def data(spark, sf001):
    return load_observations(spark, sf001), load_airports(spark, sf001)


def run(spark, folder, states, ckpt, air):
    update_day_states(read_observations_stream(spark, folder + "/*", max_files_per_trigger=1), states, ckpt, air, available_now=True).awaitTermination(180)


def check(states, obs, air):
    assert rows(rain_thunder_from_states(states)) == rows(A.rain_thunder_days(obs, air))
    assert rows(extremes_from_states(states)) == rows(A.temp_dewpoint_daily_extremes(obs, air))
    assert rows(fog_low_cloud_from_states(states)) == rows(A.fog_low_cloud_by_rain_day(obs, air))


def test_three_batches_with_late_rows_and_a_restart(spark, data):
    obs, air = data
    root = tempfile.mkdtemp(prefix="stratus-states-", dir="/tmp")
    incoming, states, ckpt = (os.path.join(root, p) for p in ("in", "states", "ckpt"))
    # Every batch has rows of all years, so the later ones bring late rows for days that are there already.
    for k in range(2):
        obs.filter(F.col("hour") % 3 == k).coalesce(1).write.parquet(f"{incoming}/b{k}")
    run(spark, incoming, states, ckpt, air)
    check(read_day_states(spark, states), obs.filter(F.col("hour") % 3 < 2), air)
    obs.filter(F.col("hour") % 3 == 2).coalesce(1).write.parquet(f"{incoming}/b2")
    run(spark, incoming, states, ckpt, air)   # restarted from its checkpoint
    assert sorted(os.listdir(states)) == ["batch=0", "batch=1", "batch=2"]
    check(read_day_states(spark, states), obs, air)

    # A batch that is repeated overwrites its own folder: the last commit is undone and the query started again.
    os.remove(os.path.join(ckpt, "commits", "2"))
    for f in os.listdir(os.path.join(ckpt, "commits")):
        if f.startswith(".2"):
            os.remove(os.path.join(ckpt, "commits", f))
    run(spark, incoming, states, ckpt, air)
    check(read_day_states(spark, states), obs, air)

    compact_day_states(spark, states, root + "/compact")
    assert rows(read_day_states(spark, root + "/compact")) == rows(read_day_states(spark, states))


def test_no_observations(spark, data):
    obs, air = data
    from stratus.streaming.daystate import partial_day_states
    assert rain_thunder_from_states(partial_day_states(obs.limit(0), air)).count() == 0
