"""Any cut of the events into batches labels them as the fold over whole sessions does."""

import random

import pytest
from pyspark.sql import functions as F

from estrado.operators import sequences
from estrado.streaming import handover

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def whole(events, calls=("signup", "purchase")):
    out = {}
    for user in {e[2] for e in events}:
        fold = sequences.Handover()
        for e in sorted((e for e in events if e[2] == user), key=lambda e: (e[1], e[0])):
            out[user, e[0]] = fold.label(e[3] in calls, e[4] > 20)
    return out


def made(n, users, seed):
    import datetime as dt

    r = random.Random(seed)
    at = [dt.datetime(2026, 1, 1) + dt.timedelta(seconds=r.randrange(3 * 86400), microseconds=r.choice([0, 0, 500, 999_999])) for _ in range(n)]
    at[1::7] = at[::7][: len(at[1::7])]  # ties
    return [(i, t, r.randrange(users), r.choice(["signup", "purchase", "view", "click"]), r.choice([10.0, 30.0])) for i, t in enumerate(at)]


def run(spark, tmp_path, parts, **options):
    folder = tmp_path / "events.parquet"
    for i, part in enumerate(parts):
        spark.createDataFrame(part, EVENTS).coalesce(1).write.mode("append").parquet(str(folder))
    got = handover.over_files(spark, str(tmp_path), valid="value > 20", **options)
    rows = [((r.pleno_id, r.seg_id), r.turno) for r in got.collect()]
    assert len(rows) == len(dict(rows)), "a segment came twice"
    return dict(rows)


@pytest.mark.parametrize("cuts", [1, 5])
def test_any_cut_in_any_order(spark, tmp_path, cuts):
    """Rows dealt to the batches at random: with room for the latest, nothing hangs on the cut."""
    e = made(300, 4, cuts)
    shuffled = random.Random(cuts).sample(e, len(e))
    parts = [shuffled[i::cuts] for i in range(cuts)]
    assert run(spark, tmp_path, parts, late="10 days", idle="30 days") == whole(e)


def test_cut_in_time_with_little_room(spark, tmp_path):
    e = sorted(made(200, 3, 7), key=lambda x: x[1])
    assert run(spark, tmp_path, [e[i : i + 50] for i in range(0, 200, 50)], late="1 seconds", idle="30 days") == whole(e)


def test_a_silent_session_starts_anew(spark, tmp_path):
    import datetime as dt

    day = lambda d, i, kind: (i, dt.datetime(2026, 1, d), 1, kind, 30.0)
    parts = [[day(1, 0, "signup"), day(2, 1, "view")], [day(20, 2, "view"), day(21, 3, "signup")], [day(25, 4, "view"), day(26, 5, "view")]]
    got = run(spark, tmp_path, parts, late="1 seconds", idle="4 days")
    # after eighteen days the chair speaks again, after four the turn goes on
    assert [got[1, i] for i in range(6)] == [-1, 0, -1, -1, 0, 0]


def test_the_setting_comes_back(spark):
    before = spark.conf.get(handover.PROVIDER)
    with handover.rocksdb(spark):
        assert spark.conf.get(handover.PROVIDER) == handover.ROCKSDB
    assert spark.conf.get(handover.PROVIDER) == before


def test_same_as_the_fold_in_batch(spark, tiny):
    e = spark.read.parquet(f"{tiny}/events.parquet")
    seg = e.select(F.col("user_id").alias("pleno_id"), F.col("event_id").alias("seg_id"), F.unix_micros(F.col("ts").cast("timestamp")).cast("double").alias("start"), F.col("event_type").alias("speaker"), "value")
    want = {(r.pleno_id, r.seg_id): r.turno for r in sequences.handovers(seg, "^(signup|purchase)$", F.col("value") > 20).collect()}
    assert {(r.pleno_id, r.seg_id): r.turno for r in handover.over_files(spark, tiny, valid="value > 20").collect()} == want
