"""A registry of help resources from JSON, with checks of its references and hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "resources array<struct<id string, title string, url string>>"
ROUTING_SCHEMA = "concerns map<string, array<string>>, guidance map<string, string>"


def read(spark: SparkSession, resources: str, routing: str) -> tuple[DataFrame, DataFrame]:
    """(resources: id, title, url; routes: origin, name, pos, id) of two JSON files. origin is concern or guidance."""
    listed = spark.read.schema(SCHEMA).json(resources, multiLine=True).select(F.inline("resources"))
    found = spark.read.schema(ROUTING_SCHEMA).json(routing, multiLine=True)
    concerns = found.select(F.explode("concerns").alias("name", "ids")).select(F.lit("concern").alias("origin"), "name", F.posexplode("ids").alias("pos", "id"))
    guidance = found.select(F.explode("guidance").alias("name", "id")).select(F.lit("guidance").alias("origin"), "name", F.lit(0).alias("pos"), "id")
    return listed, concerns.unionByName(guidance)


def problems(resources: DataFrame, routes: DataFrame) -> DataFrame:
    """problem, name, id, one row each: repeated-resource, unknown-resource, repeated-route and unreachable-resource.

    resources: id. routes: origin, name, id. An id that a concern lists twice is one repeated-route.
    """
    ids = resources.select("id").distinct()
    row = lambda df, problem, name=F.lit(None).cast("string"): df.select(F.lit(problem).alias("problem"), name.alias("name"), "id")
    twice = resources.groupBy("id").count().where("count > 1")
    again = routes.where("origin = 'concern'").groupBy("name", "id").count().where("count > 1")
    unknown = routes.select("origin", "name", "id").distinct().join(ids, "id", "left_anti")
    return (
        row(twice, "repeated-resource")
        .unionByName(row(unknown, "unknown-resource", F.col("name")))
        .unionByName(row(again, "repeated-route", F.col("name")))
        .unionByName(row(ids.join(routes.select("id"), "id", "left_anti"), "unreachable-resource"))
    )


def official_host(url: Column) -> Column:
    """The lower-case host of an https URL without credentials or port that is a government one; null for all others."""
    host = F.lower(F.regexp_extract(url, r"(?i)^https://([a-z0-9.-]+)(?:[/?#]|\z)", 1))
    # The official hosts.
    ours = host.isin("gov.in", "nic.in", "tele-law.in", "www.tele-law.in") | host.endswith(".gov.in") | host.endswith(".nic.in")
    return F.when(ours, host)
