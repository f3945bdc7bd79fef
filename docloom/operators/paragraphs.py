"""Documents to located paragraphs, and documents' facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import clause_label, is_heading, squeeze, word_count

BLANK_LINE = r"\n[ \t\f\x0B]*\n"


def split_paragraphs(docs: DataFrame, key: str = "doc_id", text: str = "text", page: str | None = None, delimiter: str = BLANK_LINE) -> DataFrame:
    """key, paragraph_index (from 1, over all pages), page, text: paragraphs without surplus white space; empty ones are dropped."""
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\r\n?", "\n"), delimiter)
    cols = [F.col(key), (F.col(page) if page else F.lit(None).cast("int")).alias("page")]
    kept = F.filter(F.transform(parts, squeeze), lambda p: p != "")
    if page is None:
        return docs.select(*cols, F.posexplode(kept).alias("i", "text")).select(key, (F.col("i") + 1).alias("paragraph_index"), "page", "text")
    rows = docs.select(*cols, F.posexplode(kept).alias("i", "text"))
    order = W.partitionBy(key).orderBy("page", "i")
    return rows.select(key, F.row_number().over(order).alias("paragraph_index"), "page", "text")


def locate(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with chunk_id ("p" and the index), clause (kind, label) and heading."""
    return paragraphs.withColumns({
        "chunk_id": F.concat(F.lit("p"), F.col("paragraph_index").cast("string")),
        "clause": clause_label(F.col("text")),
        "heading": is_heading(F.col("text")),
    })


def summary(paragraphs: DataFrame, key: str = "doc_id") -> DataFrame:
    return paragraphs.groupBy(key).agg(
        F.max("page").alias("page_count"),
        F.count("*").alias("paragraph_count"),
        F.sum(word_count(F.col("text"))).cast("long").alias("word_count"),
    )


def analysed_slot(documents: DataFrame, session: str = "session_id") -> DataFrame:
    """The document of each session that is analysed: the primary one, else the newer one of a pair."""
    rank = F.when(F.col("slot") == "primary", 0).otherwise(1)
    first = W.partitionBy(session).orderBy(rank, "doc_id")
    return documents.where(F.col("slot").isin("primary", "newer")).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
