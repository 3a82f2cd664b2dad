"""The acquisition's state machine: recorded responses as a batch and as a stream, timers, and a restart from the checkpoint."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from sheaf.streaming import acquire

SHAPE = "source string, url string, at timestamp, status int, retry_after string, body string"
T0 = datetime(2024, 5, 1, tzinfo=timezone.utc)
POLICY = acquire.Policy()


def plain(rows, policy=POLICY):
    """{(source, url): (event, attempts, status, body, due)} by the rules, one response after the other."""
    import re
    import zlib
    from email.utils import parsedate_to_datetime

    out = {}
    for source, url, at, status, after, body in sorted(rows, key=lambda r: (r[2], r[3] is not None, r[3] or 0)):
        event, n, *_ = out.get((source, url), ("retry", 0))
        if event != "retry":
            continue
        n += 1
        again = (status is None or status >= 500 or status in (413, 429)) and n <= policy.retries
        good = status is not None and 200 <= status < 300
        due = None
        if again:
            raw = min(policy.base_s * 2 ** (n - 1), policy.most_s) * 1000
            wait = int(raw + raw * policy.jitter * (zlib.crc32(f"{url}:{n}".encode()) % 1000) / 1000)
            if after and re.fullmatch(r"\s*\d+\s*", after):
                wait = min(int(after) * 1000, 300_000)
            elif after and "GMT" in after:
                wait = max(0, min(300_000, round((parsedate_to_datetime(after) - at).total_seconds() * 1000)))
            due = (at + timedelta(milliseconds=wait)).replace(tzinfo=None)
        out[source, url] = ("delivered" if good else "retry" if again else "failed", n, status, body if good else None, due)
    return out


def recorded():
    rng = random.Random(5)
    rows = []
    for i in range(120):
        at = T0 + timedelta(seconds=rng.randrange(60))
        for k in range(rng.randrange(1, 6)):
            status = rng.choice([200, 204, 301, 404, 413, 429, 500, 503, 503, None, None])
            after = rng.choice([None, None, "7", " 9999 ", "soon", "Wed, 01 May 2024 00:10:00 GMT", "Wed, 21 Oct 2015 07:28:00 GMT"])
            rows.append((f"s{i % 5}", f"https://h/{i}", at + timedelta(seconds=40 * k), status, after, f"body {i}.{k}"))
    rows.append((None, None, T0, 200, None, None))
    return rows


def found(df):
    return {(r.source, r.url): (r.event, r.attempts, r.status, r.body, r.due) for r in df.collect()}


@pytest.fixture(scope="module")
def state(spark):
    spark.conf.set(*acquire.ROCKSDB)
    yield
    spark.conf.unset(acquire.ROCKSDB[0])


def test_recorded_responses(spark):
    rows = recorded()
    pages = acquire.outcomes(spark.createDataFrame(rows, SHAPE))
    assert found(pages) == plain(rows)
    per = {r.source: r for r in acquire.by_source(pages).collect()}
    for s in {r[0] for r in rows}:
        own = {k: v for k, v in plain(rows).items() if k[0] == s}
        assert (per[s].delivered, per[s].failed, per[s].open) == tuple(sum(v[0] == e for v in own.values()) for e in ("delivered", "failed", "retry"))
    files = acquire.delivered_files(pages, "https://h").where("source = 's1'").collect()
    assert {(f.path, f.content) for f in files} == {(k[1].removeprefix("https://h/") + ".md", v[3]) for k, v in plain(rows).items() if k[0] == "s1" and v[0] == "delivered"}
    assert acquire.outcomes(spark.createDataFrame([], SHAPE)).count() == 0


def test_all_failed(spark):
    rows = [("a", "https://h/2", T0, 404, None, "x"), ("a", "https://h/1", T0, None, None, None), ("b", "https://h/1", T0, 404, None, None), ("b", "https://h/3", T0, 200, None, "y"), ("c", "https://h/1", T0, 500, None, None)]
    rows += [("a", "https://h/1", T0 + timedelta(seconds=k), None, None, None) for k in (40, 80)]
    per = {r.source: r.error for r in acquire.by_source(acquire.outcomes(spark.createDataFrame(rows, SHAPE))).collect()}
    assert per == {"a": "all fetches failed. First error: no answer for https://h/1", "b": None, "c": None}


def run(spark, folder, name, stop_after=None):
    feed = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    acquire.start(feed, str(folder / f"out-{name}"), str(folder / f"check-{name}"), late="1 minute").awaitTermination()
    return spark.read.schema(acquire.EVENT).parquet(str(folder / f"out-{name}"))


def put(spark, folder, rows, n):
    spark.createDataFrame(rows, SHAPE).coalesce(1).write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").mode("append").json(str(folder / "in"))


def test_stream_gives_what_the_batch_gives_also_after_a_restart(spark, state, tmp_path):
    rows = sorted((r for r in recorded() if r[0]), key=lambda r: r[2])
    (tmp_path / "in").mkdir()
    cut = [rows[:150], rows[150:260], rows[260:]]
    for k, part in enumerate(cut):
        put(spark, tmp_path, part, k)
        run(spark, tmp_path, "steps")  # each run goes on from the checkpoint of the one before
    want = plain(rows)
    whole = found(acquire.latest(run(spark, tmp_path, "whole")))
    steps = found(acquire.latest(run(spark, tmp_path, "steps")))
    assert steps == whole
    # pages that are still open may have been given unanswered attempts by their timers; all others are as in the batch
    assert {k for k in whole if whole[k] != want[k]} <= {k for k, v in want.items() if v[0] == "retry"} and len(whole) == len(want)


def test_timers_end_pages_that_stay_unanswered(spark, state, tmp_path):
    (tmp_path / "in").mkdir()
    put(spark, tmp_path, [("s", "https://h/1", T0, 503, "5", None), ("s", "https://h/2", T0, 200, None, "two")], 0)
    put(spark, tmp_path, [("s", "https://h/9", T0 + timedelta(hours=1), 200, None, "late")], 1)
    put(spark, tmp_path, [("s", "https://h/9", T0 + timedelta(hours=2), 200, None, "later")], 2)
    put(spark, tmp_path, [("s", "https://h/8", T0 + timedelta(hours=3), 200, None, "latest")], 3)
    events = run(spark, tmp_path, "timers").where("url = 'https://h/1'").orderBy("attempts").collect()
    assert [(e.event, e.attempts, e.status) for e in events] == [("retry", 1, 503), ("retry", 2, None), ("failed", 3, None)]
    assert events[0].due == datetime(2024, 5, 1, 0, 0, 5)
