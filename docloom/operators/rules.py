"""Rules over paragraphs: any, all and none of some patterns, with captures and stage ranking.

Rules are unrolled into one projection of constant predicates, so each paragraph is scanned once and
every pattern is compiled once for each task; no join with a table of patterns.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docloom.functions.text import BEFORE, BEHIND, capital, clause_label, clause_name, let, pattern, template

FAMILIES = ("money", "time", "duty", "exit", "data-ip")
STAGES = ("before-signing", "problem-started", "compare-versions")
RELEVANCES = ("primary", "secondary", "background")


class Hinted(str):
    """A pattern with hints: lower-case parts of which one at least stands in every text that it matches."""

    hints: tuple[str, ...]

    def __new__(cls, pattern: str, *hints: str) -> Hinted:
        made = super().__new__(cls, pattern)
        made.hints = tuple(dict.fromkeys(h.lower() for h in hints))
        return made


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    any: Sequence[str]
    all: Sequence[str] = ()
    none: Sequence[str] = ()
    #: One of RELEVANCES for each of STAGES.
    ranks: Sequence[str] = ("background",) * len(STAGES)
    types: Sequence[str] = ()
    prompt: str = "Read {clause}."
    category: str = ""
    captures: Sequence[str] = field(default=(), init=False)

    def __post_init__(self) -> None:
        names = dict.fromkeys(n for p in (*self.any, *self.all) for n in re.findall(r"\(\?<([a-z]\w*)>", p))
        object.__setattr__(self, "captures", tuple(names))
        object.__setattr__(self, "category", self.category or self.id.split(".", 1)[1])

    @property
    def family(self) -> str:
        return self.id.split(".", 1)[0]

    def relevance(self, stage: str | None) -> str | None:
        return None if stage is None else self.ranks[STAGES.index(stage)]


def check(rules: Iterable[Rule]) -> None:
    """Raises ValueError where ids repeat, a family is unknown or a prompt names what no pattern captures without a fallback."""
    seen: set[str] = set()
    for r in rules:
        if r.id in seen or r.family not in FAMILIES or len(r.ranks) != len(STAGES) or not r.any:
            raise ValueError(f"bad rule {r.id}")
        seen.add(r.id)
        for name, fallback in re.findall(r"\{(\w+)(\|[^}]*)?\}", r.prompt):
            if name != "clause" and (name not in r.captures or not fallback):
                raise ValueError(f"rule {r.id}: {name} is not captured or has no fallback")


def _hit(text: Column, p: str, form: Column | None = None, hints: Sequence[str] = ()) -> Column:
    """Whether a pattern matches. With the plain form a hint is looked for first, and that form is matched where case is all that it lacks."""
    if form is None:
        return text.rlike(pattern(p))
    near = pattern(p).removeprefix("(?iu)").replace(BEFORE, r"(?<!\w)").replace(BEHIND, r"(?!\w)")  # the same signs where case is regarded, and one test for them
    hit = form.rlike(near) if caseless(p) else text.rlike(pattern(p))
    return _or([form.contains(h) for h in hints]) & hit if hints else hit


def _or(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


#: Letters that patterns, which regard no case, take for ASCII ones, and these.
FOLDED = {"\u017f": "s", "\u212a": "k", "\u0131": "i", "\u0130": "i"}


def plain(text: Column) -> Column:
    """The form in which hints are looked up: lower case, and the four letters that fold to ASCII ones as these."""
    folds = _or([text.contains(c) for c in FOLDED])
    return F.lower(F.when(folds, F.translate(text, "".join(FOLDED), "".join(FOLDED.values()))).otherwise(text))


def caseless(p: str) -> bool:
    """Whether a pattern matches the plain form, case regarded, just where it matches the text with no regard to it.

    So it is if it has lower-case letters only, no class that tells the four folded letters from ASCII
    ones, as word signs do, and no range but of digits or such letters.
    """
    said = re.fullmatch(r"(?:\\[sbd]|\\p\{L\}|\\[^A-Za-z0-9]|[^\\A-Z])*", p) and not re.search(r"\[[^\]]*[^\[\]]-[^\]]", re.sub(r"0-9|a-z", "", p))
    return bool(said) and not any(c.isalpha() and not c.isascii() for c in p)


def _quoted(value: str | None) -> str:
    """A text in Spark SQL. Long lists of constants are given to the parser at once, as each Column is a call to the JVM."""
    return "CAST(NULL AS STRING)" if value is None else "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Places of the table of hints: a beginning of a word leads to the rules that have a hint so begun.
SLOTS = 4093


def beginnings(rule: Rule) -> set[str] | None:
    """Up to eight first signs of the hints of the any patterns; null where a pattern has no hint, or one that begins no word."""
    if not all(isinstance(p, Hinted) and p.hints for p in rule.any):
        return None
    begun = {re.match("[a-z0-9_]{0,8}", h)[0] for p in rule.any for h in p.hints}
    return None if "" in begun else begun


def _any_of(begun: set[str]) -> str:
    """A pattern of the longest of such beginnings, one step for each sign, however many there are."""
    heads = sorted({b[0] for b in begun if b})
    more = [h + _any_of({b[1:] for b in begun if b[:1] == h}) for h in heads]
    return f"(?:{'|'.join(more)}){'?' if '' in begun else ''}" if more else ""


def candidates(rules: Sequence[tuple[int, Rule]], form: Column) -> Column:
    """Numbers of the rules that a text, in plain form, may fire, in order.

    One pattern finds the beginnings of words that any hint has, and only these are looked up, by
    their place in a constant table; so the cost is that of the text's words, whatever the number of
    rules, and on a text without hints no pattern is tried. Hints stand at the beginning of a word,
    as in all patterns made of phrases. Rules without hints are always candidates.
    """
    wanted: dict[str, set[int]] = {}
    always = []
    for i, r in rules:
        begun = beginnings(r)
        if begun is None:
            always.append(i)
        for b in begun or ():
            wanted.setdefault(b, set()).add(i)
    every = F.from_json(F.lit(json.dumps(sorted(always))), "array<int>")
    if not wanted:
        return every
    table: list[list[dict]] = [[] for _ in range(SLOTS)]
    for b in wanted:  # with those of its own beginnings, as the longest is found
        table[zlib.crc32(b.encode()) % SLOTS].append({"b": b, "i": sorted(set().union(*(wanted.get(b[:n], ()) for n in range(1, len(b) + 1))))})
    slots = F.from_json(F.lit(json.dumps(table)), "array<array<struct<b:string,i:array<int>>>>")  # read once, while the plan is made
    held = lambda b: F.flatten(F.transform(F.filter(F.get(slots, (F.crc32(b) % SLOTS).cast("int")), lambda x: x["b"] == b), lambda x: x["i"]))
    found = F.array_distinct(F.regexp_extract_all(form, F.lit(rf"(?<!\w){_any_of(set(wanted))}"), F.lit(0)))
    return F.sort_array(F.array_distinct(F.concat(F.flatten(F.transform(found, held)), every)))


def fires(rule: Rule, text: Column, form: Column | None = None) -> Column:
    """One scan for all of the any patterns; the others only where that matches. With the plain form, and where hints are, only on texts with one of them."""
    hints = lambda ps: [h for p in ps for h in p.hints] if all(isinstance(p, Hinted) and p.hints for p in ps) else []
    every = "|".join(f"(?:{re.sub(r'[(][?]<[a-z][a-zA-Z0-9_]*>', '(?:', p)})" for p in rule.any)
    out = _hit(text, every, form, hints(rule.any) if beginnings(rule) is None else ())  # the others' hints were found before
    for p in rule.all:
        out = out & _hit(text, p, form, hints([p]))
    for p in rule.none:
        out = out & ~_hit(text, p, form, hints([p]))
    return out


def matched(rule: Rule, text: Column) -> Column:
    """The match of the first of the any patterns that matches."""
    return F.coalesce(*(F.when(_hit(text, p), F.regexp_extract(text, pattern(p), 0)) for p in rule.any))


def value(rule: Rule, name: str, text: Column) -> Column:
    """What the first matching any or all pattern with a group of that name caught in it; null where none did."""
    said = []
    for p in (*rule.any, *rule.all):
        names = re.findall(r"\((?!\?)|\(\?<([a-z]\w*)>", p)
        if name in names:
            said.append(let(F.regexp_extract(text, pattern(p), names.index(name) + 1), lambda v: F.nullif(v, F.lit(""))))
    return F.coalesce(*said)


def captured(rule: Rule, text: Column) -> Column:
    """Named groups of all matching any and all patterns; the first value of a name wins."""
    if not rule.captures:
        return F.create_map().cast("map<string,string>")
    values = [F.struct(F.lit(name).alias("key"), value(rule, name, text).alias("value")) for name in rule.captures]
    return F.map_from_entries(F.filter(F.array(*values), lambda e: e["value"].isNotNull()))


def prompts(rules: Sequence[Rule], at: Column, text: Column, clause: Column) -> Column:
    """The prompt of the rule at a place of rules, for a text that it fires on. Rules with one prompt, and no captures in it, share a branch."""
    alike: dict[tuple, list[int]] = {}
    for i, r in enumerate(rules):
        alike.setdefault((r.prompt, *([i] if "{" in r.prompt.replace("{clause}", "") else [])), []).append(i)
    out = F
    for places in alike.values():
        r = rules[places[0]]
        said = template(r.prompt, {name: value(r, name, text) for name in r.captures if f"{{{name}" in r.prompt} | {"clause": clause_name(clause)})
        out = out.when(at.isin(places), said if r.prompt[:1].isupper() else let(said, capital))
    return F.lit(None).cast("string") if out is F else out


def evaluate(paragraphs: DataFrame, rules: Sequence[Rule], stage: str | None = None, document_type: str | None = None, key: str = "doc_id", details: bool = True) -> DataFrame:
    """One row for each paragraph and rule that fires; headings and blank paragraphs are skipped.

    paragraphs: key, paragraph_index, text, clause (without it, clauses are read from the texts of hits), heading. hit_order numbers a document's hits for
    reading: by relevance at the stage, place and rule. Without details the columns matched, captures
    and prompt are left out, and the plan is a third as large.
    """
    used = [(i, r) for i, r in enumerate(rules) if document_type is None or not r.types or document_type in r.types]
    text, at = F.col("text"), F.col("rule_order")
    clause = ["clause"] if "clause" in paragraphs.columns else []
    read = paragraphs.where(~F.col("heading") & (F.trim("text") != "")).select(key, "paragraph_index", "text", *clause, plain(text).alias("_form"))
    def made(of, none: Column | None, at: Column = at, part: Sequence[tuple[int, Rule]] = used) -> Column:
        """of(rule), an expression over the text, for the row's rule, which is found by halves."""
        if len(part) > 4:
            half = len(part) // 2
            return F.when(at < part[half][0], made(of, none, at, part[:half])).otherwise(made(of, none, at, part[half:]))
        out = none
        for i, r in part:
            out = F.when(at == i, of(r)) if out is none else out.when(at == i, of(r))
        return out

    # First the rules of which the text has a hint, then which of them fire, and a row for each of these; what they matched is read from the hits alone, and only where it is asked for.
    # The test is inside the array, not a filter behind it: as one generated method of all rules' patterns it would be too long for the JVM to compile.
    form = F.col("_form")
    fired = F.filter(candidates(used, form), lambda i: made(lambda r: fires(r, text, form), None, i)) if used else F.array().cast("array<int>")
    asked = read.select(key, "paragraph_index", "text", *clause, F.explode_outer(fired).alias("rule_order"))
    hits = asked.where("rule_order IS NOT NULL")  # outer, as before an inner one Spark tests for empty arrays, and makes each twice

    def said(of) -> Column:
        """of(rule) for the row's rule, a constant."""
        return F.get(F.expr(f"CAST(array({', '.join(_quoted(of(r)) for r in rules)}) AS ARRAY<STRING>)"), at)

    if not clause:
        hits = hits.withColumn("clause", clause_label(text))
    nothing, more = F.lit(None).cast("string"), []
    if details:
        more = [made(lambda r: matched(r, text), nothing).alias("matched"), made(lambda r: captured(r, text), F.create_map().cast("map<string,string>")).alias("captures"), prompts(rules, at, text, F.col("clause")).alias("prompt")]
    hits = hits.select(
        key, "paragraph_index", "text", "clause", said(lambda r: r.id).alias("rule_id"), said(lambda r: r.family).alias("family"), said(lambda r: r.category).alias("category"), said(lambda r: r.title).alias("title"), "rule_order",
        said(lambda r: r.relevance(stage)).alias("relevance"), *more,
    )
    rank = F.when(F.col("relevance") == "primary", 0).when(F.col("relevance") == "secondary", 1).otherwise(2)
    return hits.withColumn("hit_order", F.row_number().over(W.partitionBy(key).orderBy(rank, "paragraph_index", "rule_order")))


def family_summary(documents: DataFrame, hits: DataFrame, key: str = "doc_id") -> DataFrame:
    """Each document beside each family with its hits, places and rules; families without hits have zeros."""
    found = hits.groupBy(key, "family").agg(F.count("*").alias("hits"), F.countDistinct("paragraph_index").alias("places"), F.sort_array(F.collect_set("rule_id")).alias("rules"))
    each = documents.select(key).distinct().select(key, F.posexplode(F.array(*map(F.lit, FAMILIES))).alias("family_order", "family"))
    return each.join(found, [key, "family"], "left").select(key, "family", "family_order", F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("places", F.lit(0)).cast("long").alias("places"), F.coalesce("rules", F.array().cast("array<string>")).alias("rules"))


def table(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    """The rules as rows: rule_id, family, category, rule_order, types and one relevance for each stage."""
    rows = [(r.id, r.family, r.category, r.title, i, list(r.types), *(r.relevance(s) for s in STAGES)) for i, r in enumerate(rules)]
    names = ", ".join(f"`{s}` string" for s in STAGES)
    return spark.createDataFrame(rows, f"rule_id string, family string, category string, title string, rule_order int, types array<string>, {names}")


def rules_for_stage(rules: Sequence[Rule], stage: str) -> list[Rule]:
    """The stage's rules that are not in the background, by relevance, family and place in the registry."""
    ranked = [(RELEVANCES.index(r.relevance(stage)), FAMILIES.index(r.family), i, r) for i, r in enumerate(rules)]
    return [r for n, _, _, r in sorted(ranked, key=lambda x: x[:3]) if n < 2]


def not_fired(documents: DataFrame, hits: DataFrame, rules: Sequence[Rule], stage: str, key: str = "doc_id") -> DataFrame:
    """The stage's primary rules that did not fire in a document. documents: key and document_type (null: not known)."""
    asked = [r for r in rules if r.relevance(stage) == "primary"]
    row = F.array(*(F.struct(F.lit(r.id).alias("rule_id"), F.array(*map(F.lit, r.types)).cast("array<string>").alias("types")) for r in asked))
    each = documents.select(key, "document_type", F.explode(row).alias("r")).where(F.col("document_type").isNull() | (F.size("r.types") == 0) | F.expr("array_contains(r.types, document_type)"))
    return each.select(key, "r.rule_id").join(hits.select(key, "rule_id").distinct(), [key, "rule_id"], "left_anti")


def flags(rows: DataFrame, patterns: dict[str, Sequence[str]], text: str = "text") -> DataFrame:
    """rows with fired: the names whose patterns match the text, in order of the table. For safety cues, instructions and lint."""
    tests = [F.when(_or([_hit(F.col(text), p) for p in ps]), F.lit(name)) for name, ps in patterns.items()]
    return rows.withColumn("fired", F.array_compact(F.array(*tests)))
