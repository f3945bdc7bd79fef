"""Journeys from their events: stage, most urgent deadline and alarm, in batch and as a stream.

Events are read in order of their own time, whatever order they come in. A text with a safety cue is
an alarm: it absorbs the journey, so nothing at or after the first alarm changes stage or deadline.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docloom.functions.text import pattern
from docloom.operators.flow import URGENT_DAYS
from docloom.plans.registry import SAFETY_CUES, SAFETY_VETOES

STAGE_CHOSEN, SAID, DEADLINE = "stage-chosen", "user-said", "deadline-known"
CUE = "struct<rank:int,cue:string,matched:string>"
EVENT = f"journey_id long, at long, event_id long, type string, stage string, origin string, cues array<{CUE}>, day int, label string"
STATE = "journey_id long, status string, stage string, deadline date, days_left int, deadline_origin string, label string, cues array<string>, matched array<string>, guidance array<string>, said_in string"


def found_cues(text: Column) -> Column:
    """array of (rank, cue, matched): the cues of a text in order of the table, each with its first match. A cue whose veto matches doesn't count."""

    def hit(name: str, patterns: list[str]) -> Column:
        matched = F.coalesce(*(F.when(text.rlike(pattern(p)), F.regexp_extract(text, pattern(p), 0)) for p in patterns))
        vetoed = F.lit(False)
        for p in SAFETY_VETOES.get(name, ()):
            vetoed = vetoed | text.rlike(pattern(p))
        return F.when(matched.isNotNull() & ~vetoed, F.struct(F.lit(list(SAFETY_CUES).index(name)).alias("rank"), F.lit(name).alias("cue"), matched.alias("matched")))

    return F.array_compact(F.array(*(hit(n, ps) for n, (ps, _) in SAFETY_CUES.items())))


def guidance_of(cues: Column) -> Column:
    """What helps with the cues (names), in their order, without repeats."""
    table = F.create_map(*(x for n, (_, g) in SAFETY_CUES.items() for x in (F.lit(n), F.array(*map(F.lit, g)))))
    return F.array_distinct(F.flatten(F.transform(cues, lambda c: F.element_at(table, c))))


def merged_alarms(said: DataFrame) -> DataFrame:
    """journey_id, category, cues, matched, guidance, origin: all cues of all texts of a journey as one alarm; only journeys with a cue.

    said: journey_id, text, origin (interview or question). Cues go by the table, then the interview
    before questions, then by what matched; the same words for one cue count once, in whatever case.
    """
    rank = F.when(F.col("origin") == "interview", 0).otherwise(1)
    each = said.select("journey_id", "origin", rank.alias("o"), F.explode(found_cues(F.col("text"))).alias("c"))
    once = W.partitionBy("journey_id", "c.cue", F.lower("c.matched")).orderBy("o", "c.matched")
    first = each.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    listed = F.array_sort(F.collect_list(F.struct(F.col("c.rank").alias("rank"), "o", F.col("c.matched").alias("matched"), F.col("c.cue").alias("cue"), "origin")))
    rows = first.groupBy("journey_id").agg(listed.alias("l"))
    names = F.transform("l", lambda x: x["cue"])
    return rows.select("journey_id", names[0].alias("category"), names.alias("cues"), F.transform("l", lambda x: x["matched"]).alias("matched"), guidance_of(names).alias("guidance"), F.col("l")[0]["origin"].alias("origin"))


def prepared(events: DataFrame) -> DataFrame:
    """The columns of EVENT from journey_id, ts, event_id, type, stage, text, origin, date, label; rows without a journey or time are left out."""
    cues = F.when(F.col("type") == SAID, found_cues(F.coalesce("text", F.lit("")))).otherwise(F.array().cast(f"array<{CUE}>"))
    rows = events.where("journey_id IS NOT NULL AND ts IS NOT NULL")
    return rows.select(F.col("journey_id").cast("long").alias("journey_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").cast("long").alias("event_id"), "type", "stage", "origin", cues.alias("cues"), F.unix_date(F.col("date").cast("date")).alias("day"), "label")


def journeys(events: DataFrame, today: dt.date) -> DataFrame:
    """STATE of each journey after all its events (journey_id, ts, event_id, type, stage, text, origin, date, label).

    Equal times go by event_id. Aggregates only: no journey is held in one task.
    """
    e = prepared(events)
    when = F.struct("at", "event_id")
    alarm = e.where(F.size("cues") > 0).groupBy("journey_id").agg(F.min_by(F.struct("cues", "origin"), when).alias("alarm"), F.min(when).alias("from"))
    before = e.join(alarm.select("journey_id", "from"), "journey_id", "left").where(F.col("from").isNull() | (when < F.col("from")))
    left = F.col("day") - F.lit((today - dt.date(1970, 1, 1)).days)
    near = (F.col("type") == DEADLINE) & (left <= URGENT_DAYS)
    rank = F.struct((left < 0).alias("past"), F.abs(left).alias("days"), F.when(F.col("origin") == "user", 0).otherwise(1).alias("o"), F.col("label").isNull().alias("none"), "label")
    chosen = F.max_by("stage", F.when((F.col("type") == STAGE_CHOSEN) & F.col("stage").isNotNull(), when))
    best = F.min(F.when(near, F.struct(rank.alias("rank"), "day", left.alias("left"), "origin", "label")))
    state = before.groupBy("journey_id").agg(chosen.alias("stage"), best.alias("best"))
    rows = e.select("journey_id").distinct().join(state, "journey_id", "left").join(alarm, "journey_id", "left")
    status = F.when(F.col("alarm").isNotNull(), "safety-escalation").when(F.col("stage").isNull(), "awaiting-stage").when(F.col("best").isNotNull(), "urgent-review").otherwise("review")
    names = F.transform("alarm.cues", lambda c: c["cue"])
    return rows.select(
        "journey_id", status.alias("status"), "stage", F.date_from_unix_date("best.day").alias("deadline"), F.col("best.left").cast("int").alias("days_left"), F.col("best.origin").alias("deadline_origin"), F.col("best.label").alias("label"),
        names.alias("cues"), F.transform("alarm.cues", lambda c: c["matched"]).alias("matched"), guidance_of(names).alias("guidance"), F.col("alarm.origin").alias("said_in"),
    )


class Journey(StatefulProcessor):
    """A journey's events that still matter, as list state. Once an alarm is known, later events are dropped, earlier ones may still come."""

    def __init__(self, today: dt.date, ttl_ms: int) -> None:
        self.today, self.ttl = (today - dt.date(1970, 1, 1)).days, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getListState("events", "at long, event_id long, type string, stage string, origin string, day int, label string", ttlDurationMs=self.ttl)
        self.alarm = handle.getValueState("alarm", f"at long, event_id long, origin string, cues array<{CUE}>", ttlDurationMs=self.ttl)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        whole = lambda v: None if pd.isna(v) else int(v)
        text = lambda v: v if isinstance(v, str) else None
        alarm = tuple(self.alarm.get()) if self.alarm.exists() else None
        held = {(e[0], e[1]): tuple(e) for e in self.events.get()} if self.events.exists() else {}
        for f in rows:
            for r in f.itertuples(index=False):
                at = int(r.at), int(r.event_id)
                if len(r.cues):
                    if alarm is None or at < alarm[:2]:
                        alarm = (*at, text(r.origin), [(int(c["rank"]), c["cue"], c["matched"]) for c in r.cues])
                elif r.type in (STAGE_CHOSEN, DEADLINE):
                    held[at] = (*at, r.type, text(r.stage), text(r.origin), whole(r.day), text(r.label))
        kept = sorted(e for k, e in held.items() if alarm is None or k < alarm[:2])
        self.events.put(kept) if kept else self.events.clear()
        if alarm is not None:
            self.alarm.update((*alarm[:3], [tuple(c) for c in alarm[3]]))
        yield self.row(key[0], kept, alarm)

    def row(self, journey: int, events: list[tuple], alarm: tuple | None) -> pd.DataFrame:
        stage = next((e[3] for e in reversed(events) if e[2] == STAGE_CHOSEN and e[3] is not None), None)
        near = [(d < 0, abs(d), e[4] != "user", e[6] is None, e[6] or "", e, d) for e in events if e[2] == DEADLINE and e[5] is not None and (d := e[5] - self.today) <= URGENT_DAYS]
        best = min(near, key=lambda n: n[:5], default=None)
        cues = [c[1] for c in alarm[3]] if alarm else None
        status = "safety-escalation" if alarm else "awaiting-stage" if stage is None else "urgent-review" if best else "review"
        guidance = list(dict.fromkeys(g for c in cues for g in SAFETY_CUES[c][1])) if alarm else None
        day = dt.date(1970, 1, 1) + dt.timedelta(best[5][5]) if best else None
        made = (journey, status, stage, day, best[6] if best else None, best[5][4] if best else None, best[5][6] if best else None, cues, [c[2] for c in alarm[3]] if alarm else None, guidance, alarm[2] if alarm else None)
        return pd.DataFrame([made], columns=[c.split()[0] for c in STATE.split(", ")]).astype({"days_left": "Int32"})

    def close(self) -> None:
        pass


def journeys_stream(events: DataFrame, today: dt.date, ttl_ms: int = 86_400_000) -> DataFrame:
    """The same over a stream of events: a row for each journey of a batch, with its state after that batch.

    State older than ttl_ms goes. The session's state store must be the RocksDB one.
    """
    return prepared(events).groupBy("journey_id").transformWithStateInPandas(Journey(today, ttl_ms), STATE, "Update", "ProcessingTime")
