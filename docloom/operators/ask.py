"""Verbatim excerpts, and questions about documents: passages, statements about them, and one of three outcomes.

All of it is built-in functions, so excerpts stay in the JVM. Offsets are code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import SPACE, let, squeeze
from docloom.operators import retrieval
from docloom.operators.claims import MAX_QUOTE, MAX_TEXT, validate
from docloom.operators.compare import MONTHS
from docloom.operators.evidence import capped

MAX_QUESTION, MAX_PASSAGES, MAX_CHARS, MAX_EXCERPT = 500, 5, 10_000, 4000
#: Statements of an answer by its style.
STATEMENTS = {"brief": 1, "full": 3}
SURE = 0.6
CUT = "…"
SHOWN = "array<struct<confidence:double,text:string,quote:string,source_chunk_ids:array<string>>>"
SOLID = "[^" + SPACE[1:]
#: Shortened words whose point ends no sentence, by what they shorten; nor does that of a single capital.
SHORTENED = {
    "titles": ("Mr", "Mrs", "Ms", "Mx", "Dr", "Prof", "Sri", "Shri", "Smt", "Kum", "Capt", "Col", "Hon"),
    "firms": ("Bros", "Co", "Corp", "Inc", "Ltd", "Pvt", "M/s"),
    "places in a text": ("Art", "Cl", "No", "Nos", "Para", "Sch", "Sec", "Vol", "pp"),
    "Latin": ("cf", "e.g", "etc", "i.e", "viz", "vs"),
    "sums and times": ("Rs", "approx", "a.m", "p.m"),
    "months": tuple(m.title() for m in MONTHS if m != "may"),
}
_CLOSING = "[\"”')\\]]{0,8}"
_POINTED = "|".join(w.replace(".", "[.]") for ws in SHORTENED.values() for w in ws)
#: The places between two sentences: behind an end mark, its closing signs and white space, before any other sign.
#: The two signs before a place are looked at first, as a look back over many costs more than all the rest.
BETWEEN = f"(?<=[.!?।\"”')\\]{SPACE[1:]}{SPACE})(?={SOLID})(?<=[.!?।]{_CLOSING}{SPACE}{{1,32}})(?<!(?:^|{SPACE}|[(])(?:{_POINTED}|[A-Z])[.]{_CLOSING}{SPACE}{{1,32}})"


def span(start: Column, end: Column) -> Column:
    return F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))


def cut(text: Column, where: Column) -> Column:
    """The text of a span."""
    return F.substring(text, where["start"] + 1, where["end"] - where["start"])


def span_of(text: Column, needle: Column) -> Column:
    """The span of the first place where needle stands; null where it stands nowhere or is empty."""
    return let(F.instr(text, needle), lambda at: F.when((at > 0) & (needle != ""), span(at - 1, at - 1 + F.length(needle))))


def sentence_at(text: Column, at: Column) -> Column:
    """The span of the sentence that covers an offset, without the white space behind it.

    Sentences are folded once, each beside its start; the last one that starts at or before the offset counts.
    """
    begin = F.struct(F.lit(0).alias("next"), F.lit(0).alias("start"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        here, after = acc["next"] <= at, acc["next"] + F.length(piece)
        said = acc["next"] + F.length(F.regexp_replace(piece, SPACE + r"+\z", ""))
        return F.struct(after.alias("next"), F.when(here, acc["next"]).otherwise(acc["start"]).alias("start"), F.when(here, said).otherwise(acc["end"]).alias("end"))

    return F.aggregate(F.split(text, BETWEEN, -1), begin, step, lambda acc: span(acc["start"], acc["end"]))


def window_around(text: Column, bounds: Column, focus: Column, most: int) -> Column:
    """bounds, or a span of at most so many code points in them around the focus, without words cut in half. The focus is always in it, whole.

    What the focus leaves of most is shared out to both sides, half each; what one side has no text
    for goes to the other.
    """
    before = F.substring(text, bounds["start"] + 1, F.greatest(focus["start"] - bounds["start"], F.lit(0)))
    behind = F.substring(text, focus["end"] + 1, F.greatest(bounds["end"] - focus["end"], F.lit(0)))

    def shared(sides: Column) -> Column:
        one, two = sides["one"], sides["two"]
        room = F.greatest(F.lit(most) - (focus["end"] - focus["start"]), F.lit(0))
        left = F.least(F.length(one), F.greatest(F.floor(room / 2).cast("int"), room - F.length(two)))
        right = F.least(F.length(two), room - left)
        # With one sign more than is given, a word that an end cuts shows as one that goes on.
        torn = F.length(F.regexp_extract(F.substring(one, F.length(one) - left, left + 1), f"^{SOLID}*", 0))
        split = F.length(F.regexp_extract(F.substring(two, F.lit(1), right + 1), f"{SOLID}*\\z", 0))
        left = F.when(left < F.length(one), F.greatest(left - torn, F.lit(0))).otherwise(left)
        right = F.when(right < F.length(two), F.greatest(right - split, F.lit(0))).otherwise(right)
        return span(focus["start"] - left, focus["end"] + right)

    fits = (bounds["end"] - bounds["start"] <= most) & (focus["start"] >= bounds["start"]) & (focus["end"] <= bounds["end"])
    return F.when(fits, span(bounds["start"], bounds["end"])).otherwise(let(F.struct(before.alias("one"), behind.alias("two")), shared))


def excerpt(text: Column, focus: Column, most: int = MAX_EXCERPT) -> Column:
    """The text, or the window around the focus where it is longer."""
    return F.when(F.length(text) <= most, text).otherwise(let(window_around(text, span(F.lit(0), F.length(text)), focus, most), lambda w: cut(text, w)))


def verbatim(text: Column, match: Column, exact: bool = False) -> Column:
    """struct(text, quote) that rests on a match: its sentence, cut ends marked, and as the quote the match itself (exact) or the sentence, both under the limits of claims. Null where the match is null."""

    def claim(sentence: Column) -> Column:
        shown = lambda w: F.concat(F.when(w["start"] > sentence["start"], CUT).otherwise(""), cut(text, w), F.when(w["end"] < sentence["end"], CUT).otherwise(""))
        quote = match if exact else window_around(text, sentence, match, MAX_QUOTE)
        return F.struct(let(window_around(text, sentence, match, MAX_TEXT - 2), shown).alias("text"), let(quote, lambda w: cut(text, w)).alias("quote"))

    return F.when(match.isNotNull(), let(sentence_at(text, match["start"]), claim))


def places(hits: DataFrame) -> DataFrame:
    """hits (text, matched, ...) with said: one verbatim claim for each, the sentence around what matched."""
    # The span in a column of its own: within the claim it would be looked for anew wherever it is named.
    return hits.withColumn("_at", span_of(F.col("text"), F.col("matched"))).withColumn("said", verbatim(F.col("text"), F.col("_at"))).drop("_at")


def tidy_question(question: Column) -> Column:
    """White space as single blanks, and a question mark where no end mark stands; empty stays empty."""
    return let(squeeze(question), lambda q: F.when((q == "") | q.rlike("[?.!।]\\z"), q).otherwise(F.concat(q, F.lit("?"))))


def passages(chunks: DataFrame, questions: DataFrame, most: int = MAX_PASSAGES, chars: int = MAX_CHARS, window: int = MAX_EXCERPT) -> DataFrame:
    """query_id, doc_id, paragraph_index, text: what is read for each question, at most so many of its document's best paragraphs.

    chunks: doc_id, paragraph_index, text. questions: query_id (unique), doc_id, question. A long
    paragraph counts by its window around the first typed word in it; one that would pass the limit
    of characters is passed over, though not the first. Questions over 500 characters read nothing.
    """
    asked = questions.select("query_id", "doc_id", tidy_question(F.col("question")).alias("query")).where(F.length(squeeze(F.col("question"))) <= MAX_QUESTION)
    terms = retrieval.query_terms(asked).join(asked.select("query_id", "doc_id"), "query_id")
    hits = retrieval.search(terms, retrieval.index(chunks.select("doc_id", "paragraph_index", "text"), terms=terms), limit=most)
    typed = F.filter(F.transform("matched", lambda t: span_of(F.lower("text"), F.lower(t))), lambda s: s.isNotNull())
    focus = F.coalesce(F.get(typed, F.lit(0)), span(F.lit(0), F.lit(0)))
    read = hits.join(chunks.select("doc_id", "paragraph_index", "text"), ["doc_id", "paragraph_index"]).withColumn("text", excerpt(F.col("text"), focus, window))
    item = F.struct("rank", "paragraph_index", F.length("text").alias("len"), "text")
    kept = read.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(item)).alias("items")).withColumn("fit", capped(F.col("items"), most, chars))
    each = kept.select("query_id", "doc_id", F.explode(F.filter("items", lambda i: F.array_contains(F.col("fit"), i["paragraph_index"].cast("int")))).alias("i"))
    return each.select("query_id", "doc_id", "i.paragraph_index", "i.text")


def restated(read: DataFrame, most: int = STATEMENTS["full"], confidence: float = 0.75) -> DataFrame:
    """Statements without a model: response_id, claim_index, text, quote, source_chunk_ids, category, confidence of the first passages of each question.

    A statement names its passage's first sentence and quotes its first eight words, so all checks can be run on it.
    """
    order = W.partitionBy("query_id").orderBy("paragraph_index")
    first = read.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    text = squeeze(F.col("text"))
    said = F.substring(F.concat(F.lit("The passage starts with: "), F.get(F.split(text, BETWEEN, 2), F.lit(0))), 1, MAX_TEXT)
    return first.select(
        F.col("query_id").alias("response_id"), (F.col("n") - 1).alias("claim_index"), F.rtrim(said).alias("text"), F.array_join(F.slice(F.split(text, " "), 1, 8), " ").alias("quote"),
        F.array(chunk_id()).alias("source_chunk_ids"), F.lit("answer").alias("category"), F.lit(confidence).alias("confidence"),
    )


def chunk_id() -> Column:
    return F.concat(F.lit("p"), F.col("paragraph_index").cast("string"))


def answers(questions: DataFrame, read: DataFrame, claims: DataFrame, unavailable: DataFrame | None = None, sure: float = SURE) -> DataFrame:
    """query_id, doc_id, status, reason, suggested_question, shown, places, withheld of each question; none is dropped.

    status: answered, not-in-document (reason: no-evidence where nothing was read, nothing-verified
    where no statement passed the checks, low-confidence where the best one is too unsure),
    model-unavailable (its response_id is in unavailable) or question-too-long. shown: the verified
    and confident statements (confidence, text, quote, source_chunk_ids), surest first. places: the
    paragraphs read. withheld: the number of other statements.
    """
    sent = read.select(F.col("query_id").alias("response_id"), chunk_id().alias("chunk_id"), "text")
    checked = validate(claims, sent)
    good = F.col("reason").isNull()
    item = F.struct((-F.col("confidence")).alias("order"), "claim_index", "confidence", "text", "quote", "source_chunk_ids")
    made = checked.groupBy(F.col("response_id").alias("query_id")).agg(
        F.count("*").alias("n"), F.max(F.when(good, F.col("confidence"))).alias("best"), F.array_sort(F.collect_list(F.when(good & (F.col("confidence") >= sure), item))).alias("fine")
    )
    seen = read.groupBy("query_id").agg(F.sort_array(F.collect_list(F.col("paragraph_index").cast("int"))).alias("places"))
    rows = questions.select("query_id", "doc_id", "question").join(seen, "query_id", "left").join(made, "query_id", "left")
    gone = F.lit(False)
    if unavailable is not None:
        rows = rows.join(unavailable.select(F.col("response_id").alias("query_id"), F.lit(True).alias("gone")).distinct(), "query_id", "left")
        gone = F.coalesce("gone", F.lit(False))
    long = F.coalesce(F.length(squeeze(F.col("question"))) > MAX_QUESTION, F.lit(False))
    reason = F.when(long, None).when(F.col("places").isNull(), "no-evidence").when(gone, None).when(F.col("best").isNull(), "nothing-verified").when(F.col("best") < sure, "low-confidence")
    rows = rows.withColumn("reason", reason)
    status = F.when(long, "question-too-long").when(F.col("reason").isNotNull(), "not-in-document").when(gone, "model-unavailable").otherwise("answered")
    rows = rows.withColumn("status", status)
    none = F.col("status") != "answered"
    fields = ("confidence", "text", "quote", "source_chunk_ids")
    shown = F.transform("fine", lambda x: F.struct(*(x[f].alias(f) for f in fields)))
    return rows.select(
        "query_id", "doc_id", "status", "reason", F.when(F.col("status") == "not-in-document", tidy_question(F.col("question"))).alias("suggested_question"),
        F.when(none, F.array().cast(SHOWN)).otherwise(shown).alias("shown"), F.coalesce("places", F.array().cast("array<int>")).alias("places"),
        F.when(gone, 0).otherwise(F.coalesce("n", F.lit(0)) - F.when(none, 0).otherwise(F.size("fine"))).cast("long").alias("withheld"),
    )
