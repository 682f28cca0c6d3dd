"""Secret scans through a trigram inverted index, in DataFrame operations only.

Each rule is a regular expression. From it a Boolean query over trigrams is derived: any of several sets of trigrams,
all of which every match must contain. Postings (trigram, document) are made for the trigrams that the rules ask for,
the postings of each set are intersected, and only the documents that are left are verified with the rule's
expression. A rule without a mandatory trigram scans every text.

Spans are counted in code points, end exclusive. Matches of one rule are leftmost and never overlap; those of different
rules may.

Defined cases: a null or empty text has no spans; rows with one id share their postings, and each row is verified by
itself; rows with a null id are verified by every rule; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from facetrank.llm import text as K


@dataclass(frozen=True)
class Rule:
    """``group`` must be at least ``least`` characters long, else the match is dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: Fixed patterns of the base rules.
BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
#: Formats that well-known services publish for their credentials (fixed patterns).
SERVICE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)
RULES = BASE_RULES + SERVICE_RULES
#: What follows the header of a key: all up to its END line, or, where that is missing, the lines of base64 (line ends may
#: be written as backslashes and letters). Everything is bounded or possessive.
PEM_TO_END = r"[^-]{0,20000}+(?:-{1,4}[^-]{1,20000}+){0,8}+-----END [A-Z ]{0,20}PRIVATE KEY-----"
PEM_BODY = r"(?:\s{1,4}(?:Proc-Type|DEK-Info): [^\r\n]{0,100}){0,2}(?:(?:\\[rn]|\s){0,8}+[A-Za-z0-9+/=]{16,}+){1,400}+(?:[\r\n]{1,2}[A-Za-z0-9+/=]{1,15}(?![^\r\n]))?"
#: The rules of redaction: a private key goes with its header. Scans report the header, as their SQL does.
REDACT_RULES = tuple(Rule(r.kind, f"{r.pattern}(?:{PEM_TO_END}|{PEM_BODY})?") if r.kind == "pem" else r for r in RULES)
REDACTED = "[REDACTED]"
#: Matches in a run, whose places are carried on from one to the next.
RUN = 256
#: Strings that a part of an expression may stand for before the derivation gives up on it.
MAX_STRINGS = 64


def trigram_query(pattern: str) -> list[frozenset[str]] | None:
    """Sets of lower-case trigrams, all of one of which stand in every match; None if some match needs none."""
    parsed = re._parser.parse(pattern)
    op = re._constants

    def strings(items) -> set[str] | None:
        """All strings that a sequence can match, if they are few."""
        out = {""}
        for kind, value in items:
            part = one(kind, value)
            if part is None or len(out) * len(part) > MAX_STRINGS:
                return None
            out = {a + b for a in out for b in part}
        return out

    def one(kind, value) -> set[str] | None:
        if kind is op.LITERAL:
            return {chr(value).lower()}
        if kind is op.SUBPATTERN:
            return strings(value[3])
        if kind is op.BRANCH:
            parts = [strings(x) for x in value[1]]
            return None if None in parts else set().union(*parts)
        if kind is op.IN and all(k is op.LITERAL for k, _ in value) and len(value) <= 8:
            return {chr(v).lower() for _, v in value}
        if kind is op.MAX_REPEAT and value[1] == 1:
            part = strings(value[2])
            return None if part is None else part | ({""} if value[0] == 0 else set())
        if kind is op.AT:
            return {""}
        return None

    query: set[frozenset[str]] = {frozenset()}
    now = {""}

    def flush() -> None:
        nonlocal query, now
        found = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in now}
        query = {a | b for a in query for b in found}
        query = {a for a in query if not any(b < a for b in query)}
        now = {""}

    for kind, value in parsed:
        part = one(kind, value)
        if part is not None and len(now) * len(part) <= MAX_STRINGS:
            now = {a + b for a in now for b in part}
            continue
        flush()
        if part is not None:
            now = part
        elif kind is op.MAX_REPEAT and value[0] >= 1 and (first := strings(value[2])) is not None:
            now = first
            flush()
    flush()
    return None if frozenset() in query else sorted(query, key=sorted)


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """(doc_id, trigram) of each trigram asked for that stands in a text, letters taken as lower case."""
    low = F.lower(F.col("text"))
    there = F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(F.col("_low"), t))
    return docs.where("doc_id IS NOT NULL").select("doc_id", low.alias("_low")).select("doc_id", F.explode(there).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(doc_id, rules): bits of the rules whose Boolean query a document's postings satisfy.

    The table that says which set asks for which trigram follows from the rules, a few hundred rows at most, and is
    sent to all tasks; postings are combined before the shuffle.
    """
    asked = []
    for r, rule in enumerate(rules):
        for c, terms in enumerate(trigram_query(rule.pattern) or []):
            asked += [(t, r, c, 1 << i, (1 << len(terms)) - 1) for i, t in enumerate(sorted(terms))]
    spark = docs.sparkSession
    if not asked:
        return spark.createDataFrame([], "doc_id bigint, rules bigint")
    terms = spark.createDataFrame(asked, "trigram string, rule int, clause int, bit bigint, whole bigint")
    met = postings(docs, sorted({a[0] for a in asked})).join(F.broadcast(terms), "trigram")
    met = met.groupBy("doc_id", "rule", "clause").agg(F.bit_or("bit").alias("got"), F.min("whole").alias("whole")).where("got = whole")
    return met.groupBy("doc_id").agg(F.bit_or(F.expr("shiftleft(1L, rule)")).alias("rules"))


def bound_to(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def carried(items: Column, kind: str, before: Callable[[Column], Column], step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """array<kind>: what ``step`` of (place so far, item) makes of each item, beside the place that it hands on.

    Items are taken in runs of ``RUN``: the place where a run begins is ``before`` of all items ahead of it, and only
    within the run is it handed on. So n items take n * RUN + n * n / RUN plain steps and not n * n copies.
    """
    nothing = F.array().cast(f"array<{kind}>")

    def merge(acc: Column, x: Column) -> Column:
        at, made = step(acc["at"], x)
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(made)).alias("out"))

    def run(j: Column) -> Column:
        at = before(F.slice(items, F.lit(1), j * RUN))
        return F.aggregate(F.slice(items, j * RUN + 1, F.lit(RUN)), F.struct(at.alias("at"), nothing.alias("out")), merge, lambda acc: acc["out"])

    runs = F.sequence(F.lit(0), ((F.size(items) - 1) / F.lit(RUN)).cast("int"))
    return F.when(F.size(items) > 0, F.flatten(F.transform(runs, run))).otherwise(nothing)


def spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind, end>> of one rule's matches, by the lengths of what stands between and in them."""
    pattern = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    matched = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    checked = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else None

    def zipped(m: Column) -> Column:
        return F.arrays_zip(F.slice(between, F.lit(1), F.size(m)).alias("b"), m.alias("m"), (m if checked is None else checked).alias("c"))

    def length(x: Column) -> Column:
        return x["b"].cast("bigint") + x["m"].cast("bigint")

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        end = at + length(x)
        return end, F.struct((at + x["b"].cast("bigint")).alias("start"), F.lit(number).alias("kind"), end.alias("end"), (x["c"] >= rule.least).alias("fits"))

    def placed(steps: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        every = carried(steps, "struct<start:bigint, kind:int, end:bigint, fits:boolean>", lambda some: F.aggregate(some, zero, lambda acc, x: acc + length(x)), step)
        return F.transform(F.filter(every, lambda x: x["fits"]), lambda x: F.struct(x["start"], x["kind"], x["end"]))

    return bound_to(bound_to(matched, zipped), placed)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, into: str = "secret_spans") -> DataFrame:
    """``docs`` (with doc_id and text) with ``into``: array<struct<start, kind, end>> by start, then rule.

    A column of that name is replaced; all others stay, whatever their names.
    """
    docs = docs.select(*(F.col(K.quoted(c)) for c in docs.columns if c.lower() != into.lower()))
    key, bits, whole = (K.unused(c, docs.columns, [into]) for c in ("id", "rules", "whole_text"))
    found = candidates(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), rules)
    found = found.select(F.col("doc_id").alias(key), F.col("rules").alias(bits))
    with_rules = docs.join(found, F.col("doc_id") == F.col(key), "left")
    asked = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(F.coalesce(F.col(bits), F.lit(0))).cast("bigint")
    with_rules = with_rules.withColumns({bits: asked, whole: F.coalesce("text", F.lit(""))})
    nothing = F.array().cast("array<struct<start:bigint, kind:int, end:bigint>>")
    parts = []
    for i, rule in enumerate(rules):
        every = spans(F.col(whole), rule, i)
        parts.append(every if trigram_query(rule.pattern) is None else F.when(F.col(bits).bitwiseAND(F.lit(1 << i)) != 0, every).otherwise(nothing))
    return with_rules.withColumn(into, F.array_sort(F.concat(*parts))).drop(key, bits, whole)


def joined(found: Column, rules: tuple[Rule, ...]) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*(F.lit(r.kind) for r in rules))
    return F.concat_ws(",", F.transform(found, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))))


def secret_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    slim = docs.select(F.col(K.quoted(doc_id)).cast("bigint").alias("doc_id"), F.col(K.quoted(text)).alias("text"))
    found = scan(slim, rules).select("doc_id", "secret_spans")
    base = F.filter("secret_spans", lambda x: x["kind"] < len(BASE_RULES))

    def count(number: int) -> Column:
        return F.size(F.filter("secret_spans", lambda x: x["kind"] == number)).cast("bigint")

    counts = [count(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE_RULES)]
    return found.select("doc_id", *counts, F.sha2(joined(base, rules), 256).alias("base_sha256"), joined(F.col("secret_spans"), rules).alias("spans"))


def redact(docs: DataFrame, *, rules: tuple[Rule, ...] = REDACT_RULES, mark: str = REDACTED) -> DataFrame:
    """``docs`` (with doc_id and text) with each secret replaced by ``mark``; overlapping secrets are one."""

    zero = F.lit(0).cast("bigint")

    def last(some: Column) -> Column:
        return F.coalesce(F.array_max(F.transform(some, lambda x: x["end"])), zero)

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        gap = F.substring(F.col("text"), (at + 1).cast("int"), (x["start"] - at).cast("int"))
        return F.greatest(at, x["end"]), F.when(x["start"] >= at, F.concat(gap, F.lit(mark))).otherwise(F.lit(""))

    into = K.unused("secret_spans", docs.columns)
    found = scan(docs, rules, into)
    rest = F.substring(F.col("text"), (last(F.col(into)) + 1).cast("int"), F.length("text"))
    clean = F.concat(F.array_join(carried(F.col(into), "string", last, step), ""), rest)
    return found.withColumn("text", F.when(F.size(into) > 0, clean).otherwise(F.col("text"))).select(*(F.col(K.quoted(c)) for c in docs.columns))
