from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from docloom.streaming import journeys

SHAPE = "journey_id long, ts timestamp, event_id long, type string, stage string, text string, origin string, date date, label string"
TODAY = dt.date(2026, 1, 10)


def events(seed=2, n=240):
    draw = random.Random(seed)
    out = []
    for k in range(n):
        j, ts = draw.randrange(12), dt.datetime(2026, 1, 1) + dt.timedelta(seconds=draw.randrange(400))
        kind = draw.choice([journeys.STAGE_CHOSEN, journeys.SAID, journeys.DEADLINE, journeys.DEADLINE])
        text = draw.choice(["hello", None, "he hit me", "nobody hit me", "my husband beats me", "they locked us out"]) if kind == journeys.SAID and draw.random() < 0.35 else "a question"
        day = TODAY + dt.timedelta(draw.randrange(-5, 15)) if kind == journeys.DEADLINE and draw.random() < 0.9 else None
        out.append((j, ts, k, kind, draw.choice(["before-signing", "problem-started", None]) if kind == journeys.STAGE_CHOSEN else None, text if kind == journeys.SAID else None, draw.choice(["user", "document", "interview"]), day, draw.choice([None, "a", "b"])))
    return out + [(None, dt.datetime(2026, 1, 1), 900, journeys.SAID, None, "he hit me", "interview", None, None), (50, None, 901, journeys.SAID, None, "x", None, None, None)]


def fold(rows):
    """One event after another, as they are said to happen."""
    states = {}
    for j, ts, k, kind, stage, text, origin, day, label in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[1], r[2])):
        s = states.setdefault(j, {"status": "awaiting-stage", "stage": None, "best": None})
        if s["status"] == "safety-escalation":
            continue
        if kind == journeys.STAGE_CHOSEN and stage:
            s["stage"] = stage
        if kind == journeys.DEADLINE and day is not None and (d := (day - TODAY).days) <= 7:
            new = (d < 0, abs(d), origin != "user", label is None, label or "", day, d)
            s["best"] = new if s["best"] is None or new[:5] < s["best"][:5] else s["best"]
        s["status"] = "awaiting-stage" if s["stage"] is None else "urgent-review" if s["best"] else "review"
        if text in ("he hit me", "my husband beats me", "they locked us out"):
            s["status"] = "safety-escalation"
            s["cues"] = {"he hit me": ["violence"], "my husband beats me": ["domestic", "violence"], "they locked us out": ["eviction"]}[text]
    return {j: (s["status"], s["stage"], s["best"] and s["best"][5], s.get("cues")) for j, s in states.items()}


def seen(rows):
    return {r.journey_id: (r.status, r.stage, r.deadline, r.cues) for r in rows}


def test_journeys_by_brute_force(spark):
    rows = events()
    got = journeys.journeys(spark.createDataFrame(rows, SHAPE).repartition(3), TODAY).collect()
    assert seen(got) == fold(rows) and {r.status for r in got} >= {"safety-escalation", "urgent-review"}
    assert journeys.journeys(spark.createDataFrame([], SHAPE), TODAY).count() == 0


def test_stream_equals_batch_in_any_order(spark, tmp_path, seed=5):
    rows = events(seed)
    want = fold(rows)
    random.Random(seed + 1).shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], SHAPE).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        last = {}

        def keep(batch, _):
            last.update({r.journey_id: r for r in batch.collect()})

        source = spark.readStream.schema(SHAPE).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = journeys.journeys_stream(source, TODAY).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    assert seen(last.values()) == want


def test_cues_vetoes_and_merged_alarms(spark):
    texts = ["My daughter was slapped and is not safe", "They hurt our kids", "My wife threatens to hurt me", "I am afraid to go home", "In the novel he hit me", "Nobody hit me", "It hits me financially", "pati maarta hai", "मुझे मारा", "the suicide clause", "I feel suicidal", ""]
    said = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [[c.cue for c in r.c] for r in said.select("i", journeys.found_cues(F.col("t")).alias("c")).orderBy("i").collect()]
    assert got == [["child"], ["child"], ["domestic", "violence"], ["domestic"], [], [], [], ["domestic"], ["violence"], [], ["self-harm"], []]
    rows = [(1, "They locked me out", "question"), (1, "He HIT ME", "question"), (1, "he hit me", "interview"), (2, "fine", "interview"), (3, None, "question")]
    (r,) = journeys.merged_alarms(spark.createDataFrame(rows, "journey_id long, text string, origin string")).collect()
    assert (r.journey_id, r.category, r.cues, r.matched, r.origin) == (1, "violence", ["violence", "eviction"], ["hit me", "locked me out"], "interview") and r.guidance == ["emergency", "police", "legal-aid"]
