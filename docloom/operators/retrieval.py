"""BM25 retrieval over an inverted index, for one document, a group or the whole corpus, many questions at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.stem import STEMMED, vocabulary
from docloom.functions.text import is_heading, spelled, tokens
from docloom.plans.registry import STOPWORDS, SYNONYMS
from docloom.sources.shared import kept

K1, B = 1.2, 0.75


def index(chunks: DataFrame, scope: Sequence[str] = ("doc_id",), chunk: str = "paragraph_index", stemmed: bool = True, headings: bool = False, terms: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """postings (scope, chunk, len, term, tf), lengths (scope, chunk, len) and stats (scope, n, avg).

    scope names the columns within which chunks compete; none for the whole corpus. Headings don't
    take part unless asked for. Python sees each distinct token once, and none without stemmed.
    With terms (term) only their postings are made: no other token of the corpus is shuffled for
    them. Lengths and stats are of all tokens in any case. The tokens are written to the shared
    folder once, as all three read them; so are the words that lead to wanted terms, which then are
    broadcast where they are few.
    """
    scope = list(scope)
    read = chunks if headings else chunks.where(~is_heading(F.col("text")))
    told = kept(read.select(*scope, chunk, tokens(F.col("text")).alias("tokens")).withColumn("len", F.size("tokens").cast("long")))
    each = told.select(*scope, chunk, "len", F.explode("tokens").alias("token")).withColumn("token", spelled(F.col("token")))
    if stemmed and terms is None:  # counted before it is joined: many tokens of a chunk are equal
        counts = each.groupBy(*scope, chunk, "len", "token").agg(F.count("*").alias("tf")).join(vocabulary(each), "token")
        postings = counts.groupBy(*scope, chunk, "len", "term").agg(F.sum("tf").alias("tf"))
    else:
        said = each.withColumnRenamed("token", "term")
        if terms is not None:
            wanted = kept(terms.select("term").distinct())
            if stemmed:  # other tokens than words of letters are their own terms, so numbers aren't counted through
                stems = vocabulary(each.where(F.col("token").rlike(STEMMED))).join(wanted, "term", "left_semi")
                names = stems.unionByName(wanted.where(~F.col("term").rlike(STEMMED)).select(F.col("term").alias("token"), "term"))
                said = each.join(kept(names), "token")
            else:
                said = said.join(wanted, "term", "left_semi")
        postings = said.groupBy(*scope, chunk, "len", "term").agg(F.count("*").alias("tf"))
    lengths = told.select(*scope, chunk, "len")
    stats = lengths.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    return postings, lengths, stats


def query_terms(queries: DataFrame, expand: bool = True, weight: float = 0.5, stemmed: bool = True, synonyms: Mapping[str, Sequence[str]] = SYNONYMS) -> DataFrame:
    """query_id, pos, term, surface, weight, origin of each query (query_id, query): stopwords out, synonyms in at a lower weight, one row for each term."""
    stop = F.array(*map(F.lit, sorted(STOPWORDS)))
    said = queries.select("query_id", F.posexplode(tokens(F.col("query"))).alias("pos", "surface")).where(~F.array_contains(stop, F.col("surface")))
    rows = said.select("query_id", "pos", F.lit(-1).alias("ord"), F.col("surface").alias("token"), "surface", F.lit(1.0).alias("weight"), F.lit("query").alias("origin"))
    if expand:
        pairs = F.create_map(*(x for k, v in synonyms.items() for x in (F.lit(k), F.lit(" ".join(v)))))
        more = said.select("query_id", "pos", "surface", F.posexplode(tokens(F.element_at(pairs, F.col("surface")))).alias("ord", "token")).where(~F.array_contains(stop, F.col("token")))
        rows = rows.unionByName(more.select("query_id", "pos", "ord", "token", "surface", F.lit(weight).alias("weight"), F.lit("synonym").alias("origin")))
    rows = rows.withColumn("token", spelled(F.col("token")))
    rows = rows.join(vocabulary(rows), "token") if stemmed else rows.withColumn("term", F.col("token"))
    first = W.partitionBy("query_id", "term").orderBy(F.desc("weight"), "origin", "pos", "ord")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("query_id", "pos", "term", "surface", "weight", "origin")


def search(terms: DataFrame, built: tuple[DataFrame, DataFrame, DataFrame], scope: Sequence[str] = ("doc_id",), chunk: str = "paragraph_index", limit: int | None = 5) -> DataFrame:
    """query_id, scope, chunk, score, rank, matched (typed words in their order): best first, ties by chunk.

    A synonym counts in full where the word it stands for is nowhere in the scope. limit None ranks all.
    What is found is written to the shared folder once, as three steps read it.
    Terms that have columns of the scope are asked of that scope alone.
    """
    postings, lengths, stats = built
    scope = list(scope)
    found = kept(postings.join(terms, ["term", *(c for c in scope if c in terms.columns)]))
    typed = found.groupBy("query_id", *scope, "surface").agg(F.max((F.col("origin") == "query").cast("int")).alias("typed"))
    df = found.groupBy("query_id", *scope, "term").agg(F.count("*").alias("df"))
    rows = found.join(df, ["query_id", *scope, "term"]).join(typed, ["query_id", *scope, "surface"])
    rows = rows if "len" in postings.columns else rows.join(lengths, [*scope, chunk])
    rows = rows.join(stats, scope) if scope else rows.crossJoin(F.broadcast(stats))  # one row
    idf = F.log(1.0 + (F.col("n") - F.col("df") + F.lit(0.5)) / (F.col("df") + F.lit(0.5)))
    norm = K1 * (1.0 - B + B * F.col("len") / F.when(F.col("avg") > 0, F.col("avg")).otherwise(1.0))
    worth = F.when((F.col("origin") == "synonym") & (F.col("typed") == 0), 1.0).otherwise(F.col("weight"))
    gain = worth * idf * (F.col("tf") * (K1 + 1.0)) / (F.col("tf") + norm)
    scored = rows.groupBy("query_id", *scope, chunk).agg(F.sum(gain).alias("score"), F.array_sort(F.collect_set(F.struct("pos", "surface"))).alias("m")).where("score > 0")
    order = W.partitionBy("query_id", *scope).orderBy(F.desc(F.round("score", 9)), chunk)
    ranked = scored.withColumn("rank", F.row_number().over(order))
    ranked = ranked if limit is None else ranked.where(F.col("rank") <= limit)
    return ranked.select("query_id", *scope, chunk, "score", "rank", F.transform("m", lambda x: x["surface"]).alias("matched"))
