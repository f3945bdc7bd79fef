"""Sessions that end after a time without access, and token buckets."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, ttl_seconds: int, user: str = "user_id", ts: str = "ts") -> DataFrame:
    """user, session, started, ends, accesses: an access at or after the time to live from the one before begins a new session."""
    order = W.partitionBy(user).orderBy(ts)
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    gap = micros - F.lag(micros).over(order)
    new = F.when(gap.isNull() | (gap >= ttl_seconds * 1_000_000), 1).otherwise(0)
    numbered = events.select(user, ts, new.alias("new")).withColumn("session", F.sum("new").over(order))
    return numbered.groupBy(user, "session").agg(F.min(ts).alias("started"), (F.max(ts) + F.make_dt_interval(secs=F.lit(ttl_seconds))).alias("ends"), F.count("*").alias("accesses"))


def sessions_stream(events: DataFrame, ttl_seconds: int, late: str = "10 minutes", user: str = "user_id", ts: str = "ts") -> DataFrame:
    """The same over a stream. A session window also joins events exactly its gap apart, so its gap is a microsecond shorter."""
    gap = f"{ttl_seconds * 1_000_000 - 1} microseconds"
    return events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count("*").alias("accesses")).select(user, F.col("w.start").alias("started"), F.col("w.end").alias("ends"), "accesses")


def expired(held: DataFrame, now_ms: int) -> DataFrame:
    """The sessions (session_id, expires_at_ms, ...) whose time is over at now_ms: a sweep deletes these, one at its last moment included."""
    return held.where(F.col("expires_at_ms") <= now_ms)


def session_view(sessions: DataFrame, documents: DataFrame, outputs: DataFrame, kinds: tuple[str, ...] = ("documentMap", "reviewPrompts", "compare")) -> DataFrame:
    """What a session shows of itself: its fields, its documents (slot, name, page_count, word_count, paragraph_count) by slot, and which outputs it has, never their texts.

    sessions: session_id, stage, document_type, expires_at_ms. documents: session_id and those fields. outputs: session_id, kind.
    """
    item = F.struct("slot", "name", "page_count", "word_count", "paragraph_count")
    held = documents.groupBy("session_id").agg(F.array_sort(F.collect_list(item)).alias("documents"))
    made = outputs.groupBy("session_id").agg(F.collect_set("kind").alias("made"))
    rows = sessions.join(held, "session_id", "left").join(made, "session_id", "left")
    has = F.struct(*(F.coalesce(F.array_contains("made", k), F.lit(False)).alias(k) for k in kinds))
    ends = F.date_format(F.timestamp_millis("expires_at_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return rows.select("session_id", "stage", "document_type", ends.alias("expires_at"), "documents", has.alias("outputs"))


def spend(times_ms: list[int], per_minute: int, tokens: float | None = None, at: int | None = None) -> tuple[list[int], float, int]:
    """(seconds to wait for each request, 0 if it may go ahead; tokens left; time of the last one)."""
    rate = per_minute / 60_000
    left, out = float(per_minute) if tokens is None else tokens, []
    for now in times_ms:
        if at is not None:
            left = min(float(per_minute), left + (now - at) * rate)
        at = now
        if left >= 1:
            left -= 1
            out.append(0)
        else:
            out.append(max(1, math.ceil((1 - left) / rate / 1000)))
    return out, left, at or 0


BUCKET = "event_id long, client long, retry_after int"


def token_bucket(requests: DataFrame, per_minute: int) -> DataFrame:
    """event_id, client, retry_after for requests (event_id, client, now_ms), each client's in order of time."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["now_ms", "event_id"])
        return pd.DataFrame({"event_id": f.event_id, "client": f.client, "retry_after": spend(f.now_ms.tolist(), per_minute)[0]})

    return requests.groupBy("client").applyInPandas(run, BUCKET)


def token_bucket_stream(requests: DataFrame, per_minute: int) -> DataFrame:
    """The same over a stream: a client's tokens are state, dropped once they would be full again."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        f = pd.concat(list(frames)).sort_values(["now_ms", "event_id"])
        out, left, at = spend(f.now_ms.tolist(), per_minute, *(state.get if state.exists else (None, None)))
        state.update((left, at))
        state.setTimeoutDuration(60_000)
        yield pd.DataFrame({"event_id": f.event_id, "client": f.client, "retry_after": out})

    return requests.groupBy("client").applyInPandasWithState(run, BUCKET, "tokens double, at long", "append", GroupStateTimeout.ProcessingTimeTimeout)
