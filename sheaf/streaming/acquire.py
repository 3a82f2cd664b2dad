"""Acquisition as a state machine over the responses of pages: attempts, waits, outcomes, and what becomes of a source.

A response is one answer (or none: a null status) to one request for a page: source, url, at, status, retry_after, body. A page is delivered by a status of 200 to
299; server errors, 413, 429 and missing answers are tried again, up to `retries` times; any other status ends it. The wait before the next try doubles from
`base_s` up to `most_s`, with a share of jitter that depends on the URL and the attempt alone, so that replays agree; a Retry-After (seconds, or a
date, 0 if it is past) takes its place, up to `cap_s`. What comes after a page's end is ignored.

`outcomes` reads recorded responses as a batch. `follow` does the same on a stream, with a state for each page; a page that should have been
tried again and has no response `patience_s` after its wait counts as unanswered, by a timer on event time.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

DELIVERED, RETRY, FAILED = "delivered", "retry", "failed"
EVENT = "source string, url string, event string, attempts int, status int, body string, due timestamp"
PAGE = ["source", "url"]


@dataclass(frozen=True)
class Policy:
    retries: int = 2
    base_s: float = 1.0
    most_s: float = 30.0
    jitter: float = 0.25
    cap_s: float = 300.0
    patience_s: float = 30.0

    def again(self, status: Column) -> Column:
        return status.isNull() | (status >= 500) | status.isin(413, 429)

    def wait_ms(self, attempts: Column, at: Column, retry_after: Column, url: Column) -> Column:
        """Milliseconds to wait after so many attempts."""
        raw = F.least(F.lit(self.base_s) * F.pow(F.lit(2.0), attempts - 1), F.lit(self.most_s)) * 1000
        share = F.crc32(F.concat_ws(":", url, attempts.cast("string")).cast("binary")) % 1000
        own = (raw + F.floor(raw * self.jitter * share / 1000)).cast("long")
        text = F.trim(retry_after)
        date = F.try_to_timestamp(F.regexp_extract(text, r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1), F.lit("d MMM yyyy HH:mm:ss"))
        hinted = F.when(text.rlike(r"\A\d+\z"), F.least(text.try_cast("decimal(38,0)") * 1000, F.lit(int(self.cap_s * 1000))).cast("long")).when(date.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(int(self.cap_s * 1000)), F.unix_millis(date) - F.unix_millis(at))).cast("long"))
        return F.coalesce(hinted, own)

    # the same for one page, in the stream's state
    def tries_again(self, status: int | None) -> bool:
        return status is None or status >= 500 or status in (413, 429)

    def wait_of(self, attempts: int, at_ms: int, retry_after: str | None, url: str) -> int:
        cap, text = int(self.cap_s * 1000), (retry_after or "").strip(" ")
        if re.fullmatch(r"[0-9]+", text):
            return min(int(text) * 1000, cap)
        if re.search(r"\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2}", text):
            try:
                return max(0, min(cap, int(parsedate_to_datetime(text).timestamp() * 1000) - at_ms))
            except ValueError:
                pass
        raw = min(self.base_s * 2.0 ** (attempts - 1), self.most_s) * 1000
        return int(raw + raw * self.jitter * (zlib.crc32(f"{url}:{attempts}".encode()) % 1000) / 1000 // 1)


def outcomes(responses: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """responses(source, url, at, status, retry_after, body) -> one row for each page: source, url, event, attempts, status, body, due (of the next try, if one is open).

    Of a page's responses only the first retries + 1 matter; ties in time go by status, nulls first.
    """
    page = Window.partitionBy(*PAGE)
    rows = responses.withColumn("attempts", F.row_number().over(page.orderBy(F.asc_nulls_first("at"), F.asc_nulls_first("status"), "retry_after", "body"))).where(F.col("attempts") <= policy.retries + 1)
    again = policy.again(F.col("status")) & (F.col("attempts") <= policy.retries)
    rows = rows.withColumn("__end", F.coalesce(F.min(F.when(~again, F.col("attempts"))).over(page), F.max("attempts").over(page))).where("attempts = __end")
    good = F.coalesce(F.col("status").between(200, 299), F.lit(False))
    event = F.when(good, DELIVERED).when(again, RETRY).otherwise(FAILED)
    due = F.when(again, F.timestamp_millis(F.unix_millis("at") + policy.wait_ms(F.col("attempts"), F.col("at"), F.col("retry_after"), F.col("url"))))
    return rows.select(*PAGE, event.alias("event"), F.col("attempts").cast("int").alias("attempts"), F.col("status").cast("int").alias("status"), F.when(good, F.col("body")).alias("body"), due.alias("due"))


def latest(events: DataFrame) -> DataFrame:
    """The last event of each page of a stream's events: what outcomes() tells of the same responses."""
    rank = F.struct("attempts", (F.col("event") != RETRY).alias("ended"))
    return events.groupBy(*PAGE).agg(F.max_by(F.struct("event", "attempts", "status", "body", "due"), rank).alias("e")).select(*PAGE, "e.*")


def by_source(pages: DataFrame) -> DataFrame:
    """outcomes -> source, delivered, failed, open, error: all pages have ended and none was delivered. The first failed page by URL is named."""
    count = lambda e: F.count_if(F.col("event") == e)
    per = pages.groupBy("source").agg(count(DELIVERED).alias("delivered"), count(FAILED).alias("failed"), count(RETRY).alias("open"), F.min(F.when(F.col("event") == FAILED, F.struct("url", "status"))).alias("first"))
    why = F.concat(F.coalesce(F.concat(F.lit("HTTP "), F.col("first.status").cast("string")), F.lit("no answer")), F.lit(" for "), F.col("first.url"))
    none = (F.col("delivered") == 0) & (F.col("open") == 0) & (F.col("failed") > 0)
    return per.select("source", "delivered", "failed", "open", F.when(none, F.concat(F.lit("all fetches failed. First error: "), why)).alias("error"))


def delivered_files(pages: DataFrame, base_url: str) -> DataFrame:
    """The files(source, path, content) of delivered pages; of pages with one path the last by URL."""
    from sheaf.functions.text import url_to_path

    rows = pages.where(F.col("event") == DELIVERED).select("source", url_to_path("url", base_url).alias("path"), "url", "body")
    return rows.groupBy("source", "path").agg(F.max_by("body", "url").alias("content"))


class Attempts(StatefulProcessor):
    """The state of a page: attempts so far, whether it has ended, and when the next try is due (ms)."""

    def __init__(self, policy: Policy):
        self.policy = policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.page = handle.getValueState("page", "attempts int, ended boolean, due long")

    def take(self, key, at_ms: int, status: int | None, retry_after: str | None, body: str | None) -> dict | None:
        """The event that a response (or its absence) makes."""
        attempts, ended, due = self.page.get() if self.page.exists() else (0, False, None)
        if ended:
            return None
        if due is not None:
            self.handle.deleteTimer(due + int(self.policy.patience_s * 1000))
        attempts += 1
        again = self.policy.tries_again(status) and attempts <= self.policy.retries
        good = status is not None and 200 <= status <= 299
        due = at_ms + self.policy.wait_of(attempts, at_ms, retry_after, key[1]) if again else None
        self.page.update((attempts, not again, due))
        if due is not None:
            self.handle.registerTimer(due + int(self.policy.patience_s * 1000))
        return {"source": key[0], "url": key[1], "event": DELIVERED if good else RETRY if again else FAILED, "attempts": attempts, "status": status, "body": body if good else None, "due": None if due is None else pd.Timestamp(due, unit="ms")}

    def told(self, events: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(events, columns=["source", "url", "event", "attempts", "status", "body", "due"])
        return out.astype({"attempts": "int32", "status": "Int32", "due": "datetime64[ns]"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        some = pd.concat(list(rows)).sort_values(["at", "status", "retry_after", "body"], na_position="first")
        events = []
        for r in some.itertuples(index=False):
            event = self.take(key, int(r.at.timestamp() * 1000), None if pd.isna(r.status) else int(r.status), None if pd.isna(r.retry_after) else r.retry_after, None if pd.isna(r.body) else r.body)
            if event is None:
                break
            events.append(event)
        yield self.told(events)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        event = self.take(key, int(expiredTimerInfo.getExpiryTimeInMs()), None, None, None)
        yield self.told([] if event is None else [event])

    def close(self) -> None:
        pass


#: A setting that the stream's state needs.
ROCKSDB = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def follow(responses: DataFrame, policy: Policy = Policy(), late: str = "10 minutes") -> DataFrame:
    """A stream of responses -> the events of pages (EVENT) as they come; responses later than `late` are left out. Needs the setting ROCKSDB."""
    rows = responses.select(*PAGE, "at", F.col("status").cast("int").alias("status"), "retry_after", "body").withWatermark("at", late)
    return rows.groupBy(*PAGE).transformWithStateInPandas(statefulProcessor=Attempts(policy), outputStructType=EVENT, outputMode="Append", timeMode="EventTime")


def start(responses: DataFrame, out: str, checkpoint: str, **options):
    """Write the events of a growing folder of responses as Parquet."""
    return follow(responses, **options).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
