"""Schedulers as streams, in any order and batches of arrival, against the machines run over all rows at once."""

import datetime as dt
import random

import pytest

from quillstream.streaming import ingest
from quillstream.streaming.scheduler import BEAT, Chains, Polls, rocksdb, schedule

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def micros(seconds):
    return int(T0.timestamp()) * 1_000_000 + seconds * 1_000_000


def streamed(spark, tmp_path, batches, machine, delay, horizon):
    schema = "key string, at timestamp, value long"
    with rocksdb(spark):
        for rows in batches:
            spark.createDataFrame([(k, at(s), v) for k, s, v in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            s = schedule(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), machine, delay, micros(horizon))
            out = ingest.run_to_table(s, str(tmp_path / "out"))
    return sorted((r.key, int(r.at.timestamp() * 1_000_000) if r.at.tzinfo else int(r.at.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000, r.what, r.n) for r in out.collect())


def at_once(rows, machine, horizon):
    out = []
    for key in {k for k, _, _ in rows}:
        _, log = machine.run((None, 0, 0), [(micros(s), v) for k, s, v in rows if k == key and s < horizon], micros(horizon))
        out += [(key, *r) for r in log]
    return sorted(out)


@pytest.mark.parametrize("machine", [Polls(600), Polls(600, retry=60, retries=2, ttl=90), Polls(300, retry=30, retries=3, once=True), Chains(400)], ids=["polls", "retries", "jobs", "chains"])
def test_any_order_of_arrival(spark, tmp_path, machine):
    rng = random.Random(5)
    values = [BEAT, 0, 3] if isinstance(machine, Chains) else [0, 0, 1]
    rows = [(rng.choice("abcd"), rng.randrange(0, 9000), rng.choice(values)) for _ in range(120)]
    late = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 1500))  # each comes at most 1500 s after its turn
    batches = [late[:50], late[50:90], [*late[90:], ("z", 20_000, 1)]]
    got = streamed(spark, tmp_path, batches, machine, "1500 seconds", 15_000)
    assert got == at_once([*rows, ("z", 20_000, 1)], machine, 15_000) and len(got) >= 10


def test_slow_after_five_failures_and_repeats():
    hour = 3600
    machine = Polls(hour)
    rows = [(micros(k * hour), 0) for k in range(5)]
    _, log = machine.run((None, 0, 0), rows, micros(20 * hour))
    assert [(m - micros(0)) // (hour * 1_000_000) for m, _, _ in log] == [10, 16]
    _, log = machine.run((None, 0, 0), [*rows, (micros(5 * hour), 1)], micros(8 * hour))
    assert log == [(micros(6 * hour), "poll", 0), (micros(7 * hour), "poll", 0)]


def test_retries_double_and_jobs_leave():
    machine = Polls(600, retry=60, retries=2, once=True)
    state, log = machine.run((None, 0, 0), [(micros(0), 0)], micros(100))
    assert log == [(micros(60), "retry", 1)]
    state, log = machine.run(state, [(micros(100), 0), (micros(230), 0), (micros(240), 1)], micros(5000))
    assert log == [(micros(220), "retry", 2), (micros(230), "left", 3)] and state[2] == 1


def test_chain_ends_or_expires():
    rows = [(micros(0), BEAT), (micros(10), 5), (micros(20), BEAT), (micros(30), 0), (micros(40), 2), (micros(50), BEAT), (micros(350), BEAT)]
    _, log = Chains(300).run((None, 0, 0), rows, micros(1000))
    assert [(w, n) for _, w, n in log] == [("started", 0), ("continued", 1), ("refused", 1), ("ended", 2), ("started", 0), ("expired", 0), ("started", 0), ("expired", 0)]
