"""A packet: sections of lines whose citations are numbered by first use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECTIONS = ("summary", "dates", "questions", "evidence")


def lines(map_rows: DataFrame, timeline: DataFrame, prompts: DataFrame, key: str = "doc_id", missing: DataFrame | None = None) -> DataFrame:
    """key, section, seq, text, places of a document's fields, dates and questions.

    missing: key, rule_order, title of what was looked for and not found; it stands behind the questions, without places.
    """
    part = lambda k, df, order, text, places: df.select(key, F.lit(k).alias("section_order"), F.lit(SECTIONS[k]).alias("section"), order.cast("int").alias("seq"), text.alias("text"), places.cast("array<int>").alias("places"))
    field = F.concat_ws(": ", "field", "status")
    day = F.concat_ws(" - ", F.date_format("date", "d MMMM yyyy"), "written")
    if missing is not None:
        none = F.array().cast("array<int>").alias("places")
        absent = missing.select(key, F.lit(1).alias("o"), F.col("rule_order").alias("n"), F.concat(F.lit("Not found: "), "title").alias("prompt"), none)
        prompts = prompts.select(key, F.lit(0).alias("o"), "n", "prompt", F.col("places").cast("array<int>").alias("places")).unionByName(absent)
        prompts = prompts.withColumn("n", F.row_number().over(W.partitionBy(key).orderBy("o", "n")))
    return (
        part(0, map_rows, F.col("field_order"), field, F.col("places"))
        .unionByName(part(1, timeline, F.col("n"), day, F.array("paragraph_index")))
        .unionByName(part(2, prompts, F.col("n"), F.col("prompt"), F.col("places")))
    )


def numbered(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """rows with citations: each paragraph's number by its first use over all sections, ascending."""
    used = rows.select(key, "section_order", "seq", F.posexplode("places").alias("pos", "place"))
    first = used.groupBy(key, "place").agg(F.min(F.struct("section_order", "seq", "pos")).alias("o"))
    number = first.withColumn("number", F.row_number().over(W.partitionBy(key).orderBy("o")))
    cited = used.join(number.select(key, "place", "number"), [key, "place"]).groupBy(key, "section_order", "seq").agg(F.sort_array(F.collect_set("number")).alias("citations"))
    return rows.join(cited, [key, "section_order", "seq"], "left").withColumn("citations", F.coalesce("citations", F.array().cast("array<int>")))


def text(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, packet: underlined section headings and lines with [n] references, in order."""
    refs = F.concat_ws("", F.transform("citations", lambda n: F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))))
    body = rows.select(key, "section_order", "section", "seq", F.concat("text", refs).alias("line"))
    one = body.groupBy(key, "section_order", "section").agg(F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("l"))
    said = F.concat_ws("\n", F.upper("section"), F.repeat(F.lit("-"), F.length("section")), F.array_join(F.transform("l", lambda x: x["line"]), "\n"))
    return one.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section_order", said.alias("t")))).alias("s")).select(key, F.array_join(F.transform("s", lambda x: x["t"]), "\n\n").alias("packet"))
