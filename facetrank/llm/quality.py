"""Quality rules with host-level verdicts.

Each document is judged by its own text (base rules). Then rule failures are aggregated by host (the ``source``
column), the failure rate of each host is shrunk towards an empirical beta prior fitted over all hosts, and the verdict
on the host is joined back to its documents: documents of a host that fails almost always are rejected as well.

Defined cases: a null text has no words and fails; a null host counts as the host ''; an empty table gives an empty
result; repeated rows and repeated ids are judged row by row; the filter returns the caller's columns as they are, whatever
their names (its own have names that the caller's table doesn't use).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from facetrank.llm import text as K
from facetrank.sources.session import cut, prepare

#: A host is rejected when its shrunken failure rate is over this.
MAX_HOST_RATE = 0.9
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: Parts of a host, so that one with a third of all documents isn't joined in one task.
SALTS = 32
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
BLANKS = " \t\n\x0b\x0c\r"

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _counts(column: pa.Array) -> dict[str, np.ndarray]:
    raw, offsets = K.buffers(column)
    hashes, first = K.word_hashes(raw, offsets)
    solid = ~K.IS_SPACE[raw] & ((raw & 0xC0) != 0x80)
    win, inside = K.windows(hashes, first, WINDOW)
    covered = np.zeros(len(hashes) + 1, np.int64)
    if inside.any():
        at = np.flatnonzero(inside)
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[at].astype(K.U64)
        key = K.mix(win[at] ^ K.mix(doc + K.U64(1)))
        order = np.argsort(key)
        ordered = key[order]
        same = ordered[1:] == ordered[:-1]
        twice = np.zeros(len(key), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    lines = []
    for value in column.to_pylist():
        if not value or "\n" not in value:
            lines.append(0)
            continue
        full = [x for x in value.split("\n") if x.strip(BLANKS)]
        lines.append(len(full) - len(set(full)))
    return {
        "n_words": np.diff(first),
        "word_chars": K.sums(solid, offsets),
        "n_symbols": K.sums(SYMBOLS[raw], offsets),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": K.sums(np.cumsum(covered)[:-1] > 0, first),
    }


def _failed(found: dict[str, np.ndarray]) -> np.ndarray:
    n, repeat = found["n_words"], found["n_repeat_words"]
    return (n < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n)


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, source, counts, base_failed) of each row of ``docs`` (doc_id, text, source)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            found = _counts(batch.column("text"))
            columns = [batch.column("doc_id"), batch.column("source"), *(pa.array(found[c], pa.int64()) for c in _COUNTS), pa.array(_failed(found))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "source", *_COUNTS, "base_failed"])

    fields = [docs.schema["doc_id"], docs.schema["source"], *(StructField(c, LongType()) for c in _COUNTS), StructField("base_failed", BooleanType())]
    return docs.select("doc_id", "text", "source").mapInArrow(run, StructType(fields))


def flagged(docs: DataFrame, text: str, name: str) -> DataFrame:
    """``docs`` with a boolean column ``name``, which it must not have: whether the row fails by itself."""
    prepare(docs.sparkSession)
    return K.with_columns_of(docs, text, [StructField(name, BooleanType())], lambda batch, held: [pa.array(_failed(_counts(batch.column(held))))])


def host_rates(measured: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed) of every host; partial sums are made before the shuffle."""
    return measured.groupBy(F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")
    )


def beta_prior(rates: DataFrame) -> tuple[float, float]:
    """(a, b) of the beta prior by the moments of the hosts' rates; one row of sums comes to the driver.

    Where all hosts have the same rate (or there is one host), the prior has the weight of two documents.
    """
    rate = F.col("n_failed") / F.col("n_docs")
    row = rates.agg(F.avg(rate).alias("m"), F.var_samp(rate).alias("v"), F.sum("n_failed").alias("f"), F.sum("n_docs").alias("n")).first()
    if row["n"] is None:
        return 1.0, 1.0
    m = min(max(row["m"], 1e-6), 1 - 1e-6)
    weight = m * (1 - m) / row["v"] - 1 if row["v"] and row["v"] > 1e-12 else 2.0
    weight = min(max(weight, 0.5), 1e6)
    return m * weight, (1 - m) * weight


def host_verdicts(rates: DataFrame, prior: tuple[float, float], max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """(host, host_rate, host_kept): the shrunken failure rate, and whether it is low enough."""
    a, b = prior
    rate = (F.col("n_failed") + F.lit(a)) / (F.col("n_docs") + F.lit(a + b))
    return rates.select("host", rate.alias("host_rate"), (rate <= F.lit(max_rate)).alias("host_kept"))


def join_verdicts(rows: DataFrame, verdicts: DataFrame, host: str, kept: str, rate: str | None = None) -> DataFrame:
    """``rows`` with column ``kept`` (and ``rate``) of its host; hosts are split into salted parts, so no task gets a whole hot host."""
    mine, salt = K.unused("host", rows.columns), K.unused("salt", rows.columns)
    plain = [F.col(K.quoted(c)) for c, t in rows.dtypes if t in ("bigint", "int", "string")]
    left = rows.withColumns({mine: F.coalesce(F.col(K.quoted(host)).cast("string"), F.lit("")), salt: F.pmod(F.xxhash64(*plain), F.lit(SALTS)).cast("int")})
    right = verdicts.select(F.col("host").alias(mine), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias(salt), F.col("host_kept").alias(kept), *([F.col("host_rate").alias(rate)] if rate else []))
    return left.join(right, [mine, salt], "left").drop(mine, salt)


def quality_rules(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per document: id, counts, base_failed, host_rate and kept."""
    named = docs.select(F.col(K.quoted(doc_id)).alias("doc_id"), F.col(K.quoted(text)).alias("text"), F.col(K.quoted(host)).alias("source"))
    measured = cut(measure(named))
    rates = host_rates(measured)
    judged = join_verdicts(measured, host_verdicts(rates, beta_prior(rates), max_rate), "source", "host_kept", "host_rate")
    return judged.select("doc_id", *_COUNTS, "base_failed", (~F.col("base_failed") & F.col("host_kept")).alias("kept"), "host_rate")


def keep_good(docs: DataFrame, *, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they are (the pipeline's filter).

    Texts are measured twice, once for the hosts and once for the rows: that is cheaper than a copy of all texts.
    """
    slim = docs.select(F.col(K.quoted(text)).alias("text"), F.col(K.quoted(host)).alias("source"))
    rates = cut(host_rates(flagged(slim, "text", "base_failed")))
    bad = host_verdicts(rates, beta_prior(rates), max_rate).where(~F.col("host_kept"))
    failed = K.unused("base_failed", docs.columns)
    columns = [F.col(K.quoted(c)) for c in docs.columns]
    passed = flagged(docs, text, failed).where(~F.col(failed)).select(*columns)
    if bad.isEmpty():
        return passed
    kept = K.unused("host_kept", docs.columns)
    return join_verdicts(passed, bad, host, kept).where(F.col(kept).isNull()).select(*columns)
