"""Checks of claims that cite and quote paragraphs."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from docloom.functions.text import let, match_form, nfkc, pattern
from docloom.plans.registry import LANGUAGE, REVIEW_REGISTER
from docloom.sources.shared import kept

MAX_CLAIMS, MAX_TEXT, MAX_QUOTE, MAX_CITED, MIN_QUOTE_WORDS = 8, 400, 300, 3, 3
ECHO_WORDS, ECHO_WINDOW, ECHO_STEP, ECHO_SHARE, ECHO_SLACK = 8, 16, 4, 0.7, 1.5
#: Reasons in the order in which a claim is held against them.
REASONS = ("unknown-chunk", "quote-too-short", "quote-not-found", "instructions-echoed", "conclusory-language", "off-register")
OUTPUT = "struct<claims:array<struct<text:string,quote:string,source_chunk_ids:array<string>,category:string,confidence:double>>>"
#: Longest category, and how many issues of an output are told.
MAX_CATEGORY, MAX_ISSUES = 40, 8
FIELDS = ("text", "quote", "source_chunk_ids", "category", "confidence")


def issues_of(said: Column, read: Column, most: int = MAX_CLAIMS, categories: Sequence[str] = ()) -> Column:
    """What is wrong with an output, as "path: what", at most MAX_ISSUES; empty where it fits. said: its JSON text; read: the same as OUTPUT."""
    none = F.array().cast("array<string>")
    note = lambda test, *text: F.when(test, F.array(F.concat(*(F.lit(t) if isinstance(t, str) else t.cast("string") for t in text)))).otherwise(none)
    others = lambda keys, known, path: F.transform(F.array_except(F.coalesce(keys, none), F.array(*map(F.lit, known))), lambda k: F.concat(path, F.lit(": unknown key "), k))

    def of_claim(raw: Column, i: Column) -> Column:
        c, path = F.get(read["claims"], i), F.concat(F.lit("claims."), i.cast("string"))
        told = lambda field, test, what: note(F.coalesce(test, F.lit(True)), path, f".{field}: {what}")
        texts = [told(f, (F.trim(c[f]) == "") | (F.length(F.trim(c[f])) > n), f"must be a text of 1 to {n} characters") for f, n in (("text", MAX_TEXT), ("quote", MAX_QUOTE))]
        known = c["category"].isin(list(categories)) if categories else (c["category"] != "") & (F.length(c["category"]) <= MAX_CATEGORY)
        ids = c["source_chunk_ids"]
        return F.concat(
            *texts,
            told("source_chunk_ids", ~F.size(ids).between(1, MAX_CITED) | F.exists(ids, lambda x: x.isNull() | (x == "")), f"must name 1 to {MAX_CITED} excerpts"),
            told("category", ~known, "is not one of the categories"),
            told("confidence", ~c["confidence"].between(0, 1), "must be a number from 0 to 1"),
            others(F.json_object_keys(raw), FIELDS, path),
        )

    raws = F.from_json(F.get_json_object(said, "$.claims"), "array<string>")
    top = F.concat(
        others(F.json_object_keys(said), ("claims",), F.lit("output")),
        note(read["claims"].isNull(), "claims: must be a list"),
        note(F.size(read["claims"]) > most, f"claims: more than {most}"),
    )
    return F.slice(F.concat(top, F.coalesce(F.flatten(F.transform(raws, of_claim)), none)), 1, MAX_ISSUES)


def parse(outputs: DataFrame, text: str = "output", most: int = MAX_CLAIMS, categories: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(claims, failures) of model outputs (response_id, output). A failure is not-json or schema, with its issues.

    An output fits as a whole or not at all: unknown keys are issues too. Of an output that is no JSON
    nothing is told. Texts and quotes lose the white space around them. Null outputs are no JSON.
    """
    read = outputs.withColumn("o", F.from_json(text, OUTPUT)).withColumn("json", F.get_json_object(text, "$").isNotNull())
    judged = read.withColumn("issues", F.when(F.col("json"), issues_of(F.col(text), F.col("o"), most, categories)).otherwise(F.array().cast("array<string>")))
    judged = judged.withColumn("error", F.when(~F.col("json"), "not-json").when(F.size("issues") > 0, "schema"))
    claims = judged.where("error IS NULL").select("response_id", F.posexplode("o.claims").alias("claim_index", "c")).select("response_id", "claim_index", "c.*")
    return claims.withColumns({c: F.trim(c) for c in ("text", "quote")}), judged.where("error IS NOT NULL").select("response_id", "error", "issues")


def lint(text: Column, language: Mapping[str, Sequence[str]] = LANGUAGE) -> Column:
    """array of (register, phrase): of each register of conclusory language its first phrase that stands in the text; one for a register at most."""
    said = match_form(text)
    found = []
    for name, ps in language.items():
        phrase = F.coalesce(*(F.when(said.rlike(pattern(p)), F.regexp_extract(said, pattern(p), 0)) for p in ps))
        found.append(F.when(phrase.isNotNull(), F.struct(F.lit(name).alias("register"), phrase.alias("phrase"))))
    return F.array_compact(F.array(*found))


def words(text: Column) -> Column:
    """Runs of letters, digits and apostrophes in match form."""
    form = F.translate(F.lower(nfkc(text)), "\u2018\u2019\u201a\u201b\u02bc", "'''''")
    form = F.when(form.rlike(r"[^\x00-\x7F]"), F.regexp_replace(form, r"[\u200B-\u200D\u2060\uFEFF\u00AD]", "")).otherwise(form)
    return F.filter(F.split(form, r"[^\p{L}\p{N}']+"), lambda w: w != "")


def runs(text: Column, n: int = ECHO_WORDS) -> Column:
    """Distinct runs of n words."""

    def made(w: Column) -> Column:
        starts = F.when(F.size(w) >= n, F.sequence(F.lit(1), F.size(w) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.array_join(F.slice(w, i, n), " ")))

    return let(words(text), made)


def run_hashes(w: Column, n: int = ECHO_WORDS) -> Column:
    """A 64-bit hash for each run of n words, in order: runs of 1, 2, 4, ... words joined two by two."""

    def joined(made: Column, shift: int) -> Column:
        width = F.greatest(F.size(made) - shift, F.lit(0))
        return F.zip_with(F.slice(made, F.lit(1), width), F.slice(made, F.lit(shift + 1), width), lambda x, y: F.xxhash64(x, y))

    def grown(made: Column, length: int) -> Column:
        step = min(length, n - length)
        return made if length == n else let(joined(made, step), lambda m: grown(m, length + step))

    return let(F.transform(w, lambda x: F.xxhash64(x)), lambda m: grown(m, 1))


#: Bits of the filter over the smaller side's runs, and runs up to which it is made and that side is sent to all tasks.
FILTER_BITS, FEW_RUNS = 1 << 20, 100_000


def _filtered(hashes: DataFrame) -> Callable[[Column], Column]:
    """A test whether a hash may be one of those in h. Two bits of each are set; the bits are summed up on Spark and come back as FILTER_BITS / 64 numbers at most."""
    places = [F.pmod(F.shiftrightunsigned("h", k), F.lit(FILTER_BITS)) for k in (0, 32)]
    bits = hashes.select(F.explode(F.array(*places)).alias("b")).groupBy(F.shiftright("b", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(b & 63 AS INT))")).alias("w")).collect()
    table = {r["at"]: r["w"] for r in bits}
    numbers = F.from_json(F.lit(json.dumps([table.get(i, 0) for i in range(FILTER_BITS // 64)])), "array<bigint>")  # read once, while the plan is made

    def may(h: Column) -> Column:
        bit = lambda k: F.pmod(F.shiftrightunsigned(h, k), F.lit(FILTER_BITS))
        found = lambda b: F.getbit(F.get(numbers, F.shiftright(b, 6).cast("int")), b.bitwiseAND(F.lit(63)).cast("int")) == 1
        return found(bit(0)) & found(bit(32))

    return may


def echoes(rows: DataFrame, against: DataFrame, key: str, other: str, n: int = ECHO_WORDS, few: int = FEW_RUNS) -> DataFrame:
    """key, other, shared: texts that share runs of n words, and how many distinct ones; texts that share none are not met.

    against is the smaller side. Runs of rows are hashes until a filter over against's runs lets them
    pass; only then their words are put together and compared. Where against has more than few runs
    there is no filter, and hashes, not words, are joined by a shuffle before words are compared.
    Several texts of one key count together; rows of a null key are left out.
    """
    mine = against.where(F.col(other).isNotNull()).select(other, words(F.col("text")).alias("w")).select(other, "w", run_hashes(F.col("w"), n).alias("hs"))
    piece = lambda i: F.array_join(F.slice("w", i + 1, n), " ")
    told = mine.select(other, "w", F.posexplode("hs").alias("i", "h")).select(other, "h", piece(F.col("i")).alias("run")).distinct()
    told = kept(told.groupBy("h", "run").agg(F.collect_list(other).alias("_others")))
    count = told.count()
    texts = rows.where(F.col(key).isNotNull()).select(F.col(key), words(F.col("text")).alias("w")).select(key, "w", run_hashes(F.col("w"), n).alias("hs"))
    if count <= few:
        may = _filtered(told)
        spots = F.filter(F.transform("hs", lambda h, i: F.when(may(h), i)), lambda i: i.isNotNull())
        said = texts.select(key, "w", "hs", F.explode(spots).alias("i")).select(key, F.get("hs", F.col("i")).alias("h"), piece(F.col("i")).alias("run"))
        met = said.join(F.broadcast(told), ["h", "run"])
    else:
        hashes = texts.select(key, F.explode(F.array_distinct("hs")).alias("h")).join(told.select("h").distinct(), "h", "left_semi")
        near = hashes.groupBy(key).agg(F.collect_set("h").alias("_near"))  # no more than a text's own runs
        back = texts.join(near, key)
        spots = F.filter(F.transform("hs", lambda h, i: F.when(F.array_contains("_near", h), i)), lambda i: i.isNotNull())
        said = back.select(key, "w", "hs", F.explode(spots).alias("i")).select(key, F.get("hs", F.col("i")).alias("h"), piece(F.col("i")).alias("run"))
        met = said.join(told, ["h", "run"])
    return met.select(key, "run", F.explode("_others").alias(other)).distinct().groupBy(key, other).agg(F.count("*").alias("shared"))


def near_echo(instructions: Sequence[str]):
    """A pandas UDF: whether a claim recites the instructions, word for word or nearly and in order."""
    import math
    import re

    told = [re.findall(r"[\w']+", t.lower()) for t in instructions]

    def shared(a: list[str], b: list[str]) -> int:
        row = [0] * (len(b) + 1)
        for x in a:
            last = row[:]
            for j, y in enumerate(b):
                row[j + 1] = last[j] + 1 if x == y else max(last[j + 1], row[j])
        return row[-1]

    def recites(w: list[str]) -> bool:
        if len(w) < 4:
            return False
        parts = [w] if len(w) <= ECHO_WINDOW else [w[i : i + ECHO_WINDOW] for i in [*range(0, len(w) - ECHO_WINDOW, ECHO_STEP), len(w) - ECHO_WINDOW]]
        for part in parts:
            need, span, wanted = math.ceil(len(part) * ECHO_SHARE), math.ceil(len(part) * ECHO_SLACK), set(part)
            if any(shared(part, t[i : i + span]) >= need for t in told for i in range(len(t)) if t[i] in wanted):
                return True
        return False

    @F.pandas_udf(BooleanType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: recites(re.findall(r"[\w']+", (t or "").lower())))

    return run


def echoes_across(claims: DataFrame, instructions: Sequence[str], n: int = ECHO_WORDS, window: int = ECHO_WINDOW) -> DataFrame:
    """response_id, claim_index of the claims over whose borders the instructions are recited. claims: response_id, claim_index, text.

    Every claim with a word in a run of n words of the instructions that passes a border counts; so do
    both neighbours of a border around which half a window of words on each side recites them nearly.
    A response holds at most 8 claims of bounded length, so it is one row here.
    """
    parted = claims.select("response_id", "claim_index", words(F.col("text")).alias("w"))
    each = parted.groupBy("response_id").agg(F.array_sort(F.collect_list(F.struct("claim_index", "w"))).alias("c"))
    spoken = F.flatten(F.transform("c", lambda c: F.transform(c["w"], lambda w: F.struct(w.alias("w"), c["claim_index"].alias("claim")))))
    told = F.array_distinct(F.flatten(F.array(*(runs(F.lit(t), n) for t in instructions)))) if instructions else F.array().cast("array<string>")

    def recited(t: Column) -> Column:
        starts = F.when(F.size(t) >= n, F.sequence(F.lit(1), F.size(t) - n + 1)).otherwise(F.array().cast("array<int>"))
        parts = F.transform(starts, lambda i: F.slice(t, i, n))
        over = F.filter(parts, lambda p: (F.get(p, F.lit(0))["claim"] != F.get(p, F.lit(n - 1))["claim"]) & F.array_contains(told, F.array_join(F.transform(p, lambda x: x["w"]), " ")))
        return F.flatten(F.transform(over, lambda p: F.transform(p, lambda x: x["claim"])))

    exact = each.select("response_id", F.explode(F.array_distinct(let(spoken, recited))).alias("claim_index"))
    following = F.lead("w").over(W.partitionBy("response_id").orderBy("claim_index"))
    next_index = F.lead("claim_index").over(W.partitionBy("response_id").orderBy("claim_index"))
    half = window // 2
    around = parted.select("response_id", "claim_index", next_index.alias("next"), F.array_join(F.concat(F.slice("w", F.greatest(F.size("w") - half + 1, F.lit(1)), F.lit(half)), F.slice(following, 1, half)), " ").alias("around")).where("next IS NOT NULL")
    nearly = around.where(near_echo(instructions)("around")).select("response_id", F.explode(F.array("claim_index", "next")).alias("claim_index")) if instructions else exact.limit(0)
    return exact.unionByName(nearly).distinct()


def resolve(claims: DataFrame, chunks: DataFrame, sure: float = 0.6) -> DataFrame:
    """claims with status, problem, excerpts (chunk ids found, in order of citation), unresolved and low_confidence, as a reader's page would show them.

    status: grounded, or ungrounded with the problem invalid-claim (a part is null or out of range),
    no-citations or unresolved-citations (none is there). claims: response_id, claim_index, text,
    quote, source_chunk_ids, confidence. chunks: response_id, chunk_id.
    """
    ids = F.array_distinct("source_chunk_ids")
    cited = claims.select("response_id", "claim_index", F.posexplode(ids).alias("_at", "chunk_id"))
    there = cited.join(chunks.select("response_id", "chunk_id", F.lit(True).alias("_there")).distinct(), ["response_id", "chunk_id"], "left")
    listed = lambda found: F.transform(F.array_sort(F.collect_list(F.when(F.col("_there").isNotNull() == F.lit(found), F.struct("_at", "chunk_id")))), lambda x: x["chunk_id"])
    per = there.groupBy("response_id", "claim_index").agg(listed(True).alias("excerpts"), listed(False).alias("unresolved"))
    rows = claims.join(per, ["response_id", "claim_index"], "left")
    fine = F.col("text").isNotNull() & F.col("quote").isNotNull() & F.col("source_chunk_ids").isNotNull() & F.coalesce(F.col("confidence").between(0, 1), F.lit(False))
    problem = F.when(~fine, "invalid-claim").when(F.size("source_chunk_ids") == 0, "no-citations").when(F.size(F.coalesce("excerpts", F.array().cast("array<string>"))) == 0, "unresolved-citations")
    rows = rows.withColumn("problem", problem)
    return rows.withColumns({"status": F.when(F.col("problem").isNull(), "grounded").otherwise("ungrounded"), "low_confidence": F.col("problem").isNull() & (F.col("confidence") < sure)})


def in_review_register(text: Column) -> Column:
    """Whether a statement puts something to the reader: a question, a request at the start of a clause, a hint what to do, or a gap of the document. Empty ones pass."""
    said = match_form(text)
    hit = F.lit(False)
    for p in REVIEW_REGISTER:
        hit = hit | said.rlike(pattern(p))
    return F.when(said == "", F.lit(True)).otherwise(hit)


def validate(claims: DataFrame, chunks: DataFrame, instructions: Sequence[str] = (), language: Mapping[str, Sequence[str]] = LANGUAGE, review: bool = False) -> DataFrame:
    """claims with reason (null: accepted), supporting (the cited ids, those that carry the quote first), phrases (what lint found) and hint.

    hint names the excerpt of the response, the first by id, in which a quote stands that none of the
    cited ones has. With review, statements that put nothing to the reader are off-register.

    claims: response_id, claim_index, text, quote, source_chunk_ids. chunks: response_id, chunk_id, text.
    """
    sent = chunks.select("response_id", "chunk_id", match_form(F.col("text")).alias("_said"))
    cited = claims.select("response_id", "claim_index", match_form(F.col("quote")).alias("_q"), F.posexplode(F.array_distinct("source_chunk_ids")).alias("_at", "chunk_id"))
    joined = cited.join(sent, ["response_id", "chunk_id"], "left")
    per = joined.groupBy("response_id", "claim_index").agg(
        F.max(F.col("_said").isNull()).alias("_unknown"),
        F.max(F.coalesce(F.contains("_said", "_q"), F.lit(False))).alias("_found"),
        F.array_sort(F.collect_list(F.struct((~F.coalesce(F.contains("_said", "_q"), F.lit(False))).alias("late"), "_at", "chunk_id"))).alias("_ids"),
    )
    rows = claims.join(per, ["response_id", "claim_index"])
    quoted = F.size(F.filter(F.split(F.col("quote"), r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}]")))
    rows = rows.withColumn("phrases", lint(F.col("text"), language))
    told = F.lit(False)
    if instructions:
        recited = F.array_distinct(F.flatten(F.array(*(runs(F.lit(t)) for t in instructions))))
        told = F.arrays_overlap(runs(F.coalesce(F.col("text"), F.lit(""))), recited) | near_echo(instructions)(F.col("text"))
    reason = F.when(F.col("_unknown"), REASONS[0]).when(quoted < MIN_QUOTE_WORDS, REASONS[1]).when(~F.col("_found"), REASONS[2]).when(told, REASONS[3]).when(F.size("phrases") > 0, REASONS[4])
    reason = reason.when(~in_review_register(F.coalesce(F.col("text"), F.lit(""))), REASONS[5]) if review else reason
    judged = rows.withColumn("reason", reason).withColumn("supporting", F.transform("_ids", lambda x: x["chunk_id"])).drop("_unknown", "_found", "_ids")
    lost = judged.where(F.col("reason") == REASONS[2]).select("response_id", "claim_index", match_form(F.col("quote")).alias("_q"))
    hints = lost.join(sent, "response_id").where(F.contains("_said", "_q")).groupBy("response_id", "claim_index").agg(F.min("chunk_id").alias("hint"))  # a response has a few excerpts
    return judged.join(hints, ["response_id", "claim_index"], "left")


def decide(validated: DataFrame, floor: float = 0.6) -> DataFrame:
    """response_id, outcome: answered, low-confidence, or no-evidence where no claim was accepted."""
    best = validated.groupBy("response_id").agg(F.max(F.when(F.col("reason").isNull(), F.col("confidence"))).alias("c"))
    return best.select("response_id", F.when(F.col("c").isNull(), "no-evidence").when(F.col("c") < floor, "low-confidence").otherwise("answered").alias("outcome"))


def best_attempt(attempts: DataFrame) -> DataFrame:
    """One attempt for each response_id: the first clean one, else the second acceptable one, else the first, else none of them.

    attempts: response_id, attempt (1 or 2), accepted, rejected (numbers of claims), failed.
    """
    rank = F.when(~F.col("failed") & (F.col("rejected") == 0), F.col("attempt")).when(~F.col("failed") & (F.col("accepted") > 0), 13 - F.col("attempt")).otherwise(99)
    first = W.partitionBy("response_id").orderBy("_rank", "attempt")
    return attempts.withColumn("_rank", rank).withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("usable", F.col("_rank") < 99).drop("_rank", "_n")
