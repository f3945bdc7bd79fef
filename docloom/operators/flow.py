"""Journeys: stages, deadlines and safety cues, as aggregates that don't depend on the order of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.operators.rules import Rule, flags, rules_for_stage
from docloom.plans.registry import ROUTING, RULES, SAFETY_CUES, STAGE_PLANS

URGENT_DAYS = 7


def urgent_deadline(events: DataFrame, today: Column) -> DataFrame:
    """journey_id, deadline, days_left, past_due, origin, label: the most urgent deadline at most a week away.

    events: journey_id, date, origin (user or document), label. Coming ones before past ones, the
    nearest first, then the user's own, the labelled, the label's order.
    """
    days = F.datediff("date", today)
    near = events.withColumn("days_left", days).where(F.col("days_left") <= URGENT_DAYS).withColumn("past_due", F.col("days_left") < 0)
    order = W.partitionBy("journey_id").orderBy("past_due", F.abs("days_left"), F.when(F.col("origin") == "user", 0).otherwise(1), F.col("label").isNull(), "label")
    return near.withColumn("_n", F.row_number().over(order)).where("_n = 1").select("journey_id", F.col("date").alias("deadline"), "days_left", "past_due", "origin", "label")


def safety(said: DataFrame) -> DataFrame:
    """journey_id, cues in order of the table, guidance without repeats; only journeys with a cue. said: journey_id, text."""
    names = list(SAFETY_CUES)
    found = flags(said, {n: ps for n, (ps, _) in SAFETY_CUES.items()}).select("journey_id", F.explode("fired").alias("cue")).distinct()
    rank = F.array_position(F.array(*map(F.lit, names)), F.col("cue"))
    listed = found.groupBy("journey_id").agg(F.transform(F.array_sort(F.collect_set(F.struct(rank.alias("r"), "cue"))), lambda x: x["cue"]).alias("cues"))
    guide = F.create_map(*(x for n, (_, g) in SAFETY_CUES.items() for x in (F.lit(n), F.array(*map(F.lit, g)))))
    return listed.withColumn("guidance", F.array_distinct(F.flatten(F.transform("cues", lambda c: F.element_at(guide, c)))))


def state(journeys: DataFrame, urgent: DataFrame, alarms: DataFrame) -> DataFrame:
    """journey_id, stage, status. An alarm wins over all else; a stage comes before review. journeys: journey_id, stage (null: none chosen)."""
    status = F.when(F.col("cues").isNotNull(), "safety-escalation").when(F.col("stage").isNull(), "awaiting-stage").when(F.col("deadline").isNotNull(), "urgent-review").otherwise("review")
    return journeys.join(urgent, "journey_id", "left").join(alarms, "journey_id", "left").select("journey_id", "stage", status.alias("status"))


def look_for(stage: str, rules: Sequence[Rule] = RULES) -> list[str]:
    """Ids of the stage's rules that are not in the background: the primary ones first, families in the order of its plan."""
    families = STAGE_PLANS[stage][0]
    return [r.id for r in sorted(rules_for_stage(rules, stage), key=lambda r: (r.relevance(stage) != "primary", families.index(r.family)))]


def decisions(states: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """states (journey_id, stage, status and, where known, deadline) with what follows from them.

    analysis: skip for an alarm, run in review, else wait. families, asks, outputs and look_for are the
    stage's plan, empty unless the analysis runs. answer_style is brief and official_contact true where
    a deadline is near and nothing is alarmed.
    """
    alarm, runs = F.col("status") == "safety-escalation", F.col("status").isin("review", "urgent-review")
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    plan = {name: [F.when(runs & (F.col("stage") == s), texts(of(s))) for s in STAGE_PLANS] for name, of in (
        ("families", lambda s: STAGE_PLANS[s][0]), ("asks", lambda s: STAGE_PLANS[s][1]), ("outputs", lambda s: STAGE_PLANS[s][2]), ("look_for", lambda s: look_for(s, rules)),
    )}
    near = (F.col("deadline").isNotNull() if "deadline" in states.columns else F.col("status") == "urgent-review") & ~alarm
    return states.withColumns({
        "analysis": F.when(alarm, "skip").when(runs, "run").otherwise("wait"),
        **{name: F.coalesce(*each, texts(())) for name, each in plan.items()},
        "answer_style": F.when(near, "brief").otherwise("full"),
        "official_contact": near,
    })


def route(concerns: DataFrame) -> DataFrame:
    """concern beside its resources in order. concerns: a column concern and any others."""
    table = F.create_map(*(x for k, v in ROUTING.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    return concerns.select("*", F.posexplode(F.element_at(table, F.col("concern"))).alias("pos", "resource_id"))
