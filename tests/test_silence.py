"""Agents that fall silent: by the wall clock without input, over restarts, and by the watermark."""

import random
import time
from datetime import datetime, timedelta

import pytest

from plumbline.streaming import jobs, silence

SCHEMA = "agent_id string, created_at timestamp, extra string, n bigint, last string"
OUT = "agent_id string, kind string, last_seen timestamp, n_messages bigint"
T0 = datetime(2024, 1, 1)


def say(spark, path, messages):
    rows = [(a, None if t is None else T0 + timedelta(seconds=t), "x", 1, "y") for a, t in messages]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{path}/in")


def told(spark, path):
    return sorted((r.agent_id, r.kind, (r.last_seen - T0).total_seconds(), r.n_messages)
                  for r in jobs.read_batches(spark, f"{path}/out/rows", OUT).collect())


def start(spark, path, **options):
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    return silence.silence_stream(stream, f"{path}/out", f"{path}/checkpoint", **options)


def wait(spark, path, count, query, seconds=90):
    end = time.monotonic() + seconds
    while len(told(spark, path)) < count:
        assert time.monotonic() < end and query.isActive, (told(spark, path), query.exception())
        time.sleep(1)


def test_by_arrival_without_further_input(spark, tmp_path):
    path, options = str(tmp_path), dict(silent="4 seconds", clock="processing", once=False, every="1 second")
    say(spark, path, [("a", 5), ("a", 9), ("b", 7), (None, 1), ("c", None)])
    query = start(spark, path, **options)
    try:
        wait(spark, path, 2, query)   # nothing arrives after the first file
        assert told(spark, path) == [("a", "silent", 9, 2), ("b", "silent", 7, 1)]
    finally:
        query.stop()
    # a restart repeats nothing; one comes back, one new agent is heard and the stream goes down before it is due
    query = start(spark, path, **options)
    try:
        say(spark, path, [("a", 20), ("d", 21)])
        wait(spark, path, 3, query)
    finally:
        query.stop()
    assert [r for r in told(spark, path) if r[1] == "back"] == [("a", "back", 9, 2)]
    time.sleep(5)
    query = start(spark, path, **options)
    try:
        wait(spark, path, 5, query)
        time.sleep(3)
    finally:
        query.stop()
    assert told(spark, path) == [("a", "back", 9, 2), ("a", "silent", 9, 2), ("a", "silent", 20, 1), ("b", "silent", 7, 1), ("d", "silent", 21, 1)]


def test_by_watermark_against_sessions(spark, tmp_path):
    """Messages in any order within the delay; the last ones move the watermark."""
    draw, path = random.Random(3), str(tmp_path)
    hours = 3600
    every = [(draw.choice("abc"), draw.randint(0, 240) * hours + draw.randint(0, 3000)) for _ in range(60)]
    every += [("busy", 3 * hours * i) for i in range(80)] + [("busy", 24 * hours * 10)]
    every.sort(key=lambda m: m[1] + draw.randint(0, hours - 1))
    for lo in range(0, len(every), 50):
        say(spark, path, every[lo:lo + 50])
        start(spark, path, silent="24 hours", delay="3 hours")
    top, want = max(t for _, t in every), []
    for agent in sorted({a for a, _ in every}):
        times = sorted(t for a, t in every if a == agent)
        sessions = silence.merged([(t, t, 1) for t in times], 24 * hours)
        want += [(agent, "silent", last, n) for _, last, n in sessions if last + 27 * hours <= top]
    assert told(spark, path) == want and want


def test_no_messages(spark, tmp_path):
    say(spark, str(tmp_path), [])
    start(spark, str(tmp_path))
    assert told(spark, str(tmp_path)) == []


def test_settings_hold_for_the_start_only(spark, tmp_path):
    key = next(iter(silence.ROCKSDB))
    before = spark.conf.get(key)
    say(spark, str(tmp_path), [("a", 1)])
    start(spark, str(tmp_path))
    assert spark.conf.get(key) == before
    with pytest.raises(ValueError, match="no clock"):
        start(spark, str(tmp_path), clock="moon")
