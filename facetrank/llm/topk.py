"""Exact top-k inner products: norm-sorted blocks, rotated partial sums and Cauchy-Schwarz bounds.

Vectors become integers, so that scores are exact. A rotation from the singular vectors of the whole table (by its Gram
matrix, which has dimensions squared entries however many rows there are) moves most of the length into the first
coordinates. Rows are ordered by descending length into bands, at most ``BANDS`` of them, and each band is dealt into
blocks of a fixed size; queries are dealt into blocks as well. Every query first meets a block of the longest rows, which
gives it a lower bound on its k-th score. With that, its own length and the lengths of a band, Cauchy-Schwarz says which
bands it needs at all; queries are put in blocks by that number, and a row is sent only to the query blocks that need its
band. Then each pair of a query block and a row block is one task's work: a row is skipped when the partial sum over the
first coordinates plus the product of the two remaining lengths is below the k-th score so far. The plan holds a few
numbers for each band, however many rows there are.
Bounds are compared with a margin for rounding; what passes is scored in whole numbers.

Defined cases: vectors that are null, or hold a null or a non-finite component, take no part; missing components of a
shorter vector count as 0; ties go to the smaller id; a null id takes no part; repeated rows are separate candidates.
A row is known by its id: rows that share a query's id are all its own and never its candidates, and an id on several
vectors is one query whose pairs are ranked together. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.sources.session import cut, prepare

K = 5
SCALE = 256
#: Rows of a block, and queries of a block.
BLOCK = 2048
#: Bands of length, and how many different numbers of bands a query block may need.
BANDS, LEVELS = 256, 8
#: Parts of the first coordinates over which partial sums are taken.
PARTIAL = 4


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Rows of an array column as a matrix, padded with zeros."""
    sizes = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), width), np.int64)
    if len(column):
        out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = np.asarray(column.flatten())
    return out


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, q array<bigint>, norm bigint) of the vectors that take part; q is floor(scale * x)."""
    fine = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    q = F.transform("v", lambda x: F.floor(x * F.lit(float(scale))))
    rows = vectors.where(fine & F.col("vec_id").isNotNull()).select("vec_id", q.alias("q"))
    return rows.withColumn("norm", F.aggregate("q", F.lit(0).cast("bigint"), lambda a, x: a + x * x))


def rotation(rows: DataFrame, width: int) -> np.ndarray:
    """Orthogonal matrix whose first columns carry the most of the table's length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = _dense(batch.column("q"), width).astype(np.float64)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(list(total), pa.list_(pa.float64()))], names=["i", "row"])

    summed = rows.select("q").mapInArrow(run, "i bigint, row array<double>").select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("x"))
    gram = np.zeros((width, width))
    for r in summed.collect():  # width squared entries
        gram[r["i"], r["pos"]] = r["x"]
    return np.linalg.eigh((gram + gram.T) / 2)[1][:, ::-1].copy()


def best(q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, k: int, strip: int = 256) -> list[tuple[int, int, int]]:
    """(query, row, score) of each query's k best of the rows, leaving out what is surely under its ``floor``.

    ``x`` is in order of descending length; it is taken in strips, and each strip lifts the floor of the next.
    """
    held_score = np.full((len(q), k), np.iinfo(np.int64).min)
    held_id = np.full((len(q), k), np.iinfo(np.int64).max)
    first = max(1, q.shape[1] // PARTIAL)
    rotated_q, rotated_x = q @ turn, x @ turn
    rest_q = np.sqrt(np.maximum((rotated_q[:, first:] ** 2).sum(axis=1), 0))
    rest_x = np.sqrt(np.maximum((rotated_x[:, first:] ** 2).sum(axis=1), 0))
    long_q, long_x = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1)), np.sqrt((x.astype(np.float64) ** 2).sum(axis=1))
    exact_q, exact_x = q.astype(np.float64), x.astype(np.float64)
    for at in range(0, len(x), strip):
        part = slice(at, at + strip)
        kth = np.maximum(floor, held_score[:, -1].astype(np.float64))
        live = np.flatnonzero(long_q * long_x[part].max() * (1 + 1e-9) + 1e-6 >= kth)
        if not len(live):
            continue
        bound = rotated_q[live, :first] @ rotated_x[part, :first].T + np.outer(rest_q[live], rest_x[part])
        may = bound * 1.0 + 1e-6 * (1 + np.outer(long_q[live], long_x[part])) >= kth[live, None]
        rows = np.flatnonzero(may.any(axis=1))
        if not len(rows):
            continue
        live, may = live[rows], may[rows]
        if np.abs(exact_q).max(initial=0) * np.abs(exact_x).max(initial=0) * q.shape[1] < 2**52:
            score = (exact_q[live] @ exact_x[part].T).astype(np.int64)
        else:
            score = q[live] @ x[part].T
        may &= q_ids[live, None] != ids[part][None, :]
        score = np.where(may, score, np.iinfo(np.int64).min)
        all_score = np.concatenate([held_score[live], score], axis=1)
        all_id = np.concatenate([held_id[live], np.where(may, ids[part][None, :], np.iinfo(np.int64).max)], axis=1)
        order = np.lexsort((all_id, -np.maximum(all_score, np.iinfo(np.int64).min + 1)), axis=1)[:, :k]
        held_score[live], held_id[live] = np.take_along_axis(all_score, order, 1), np.take_along_axis(all_id, order, 1)
    there = held_score > np.iinfo(np.int64).min
    i, j = np.nonzero(there)
    return list(zip(q_ids[i].tolist(), held_id[i, j].tolist(), held_score[i, j].tolist(), strict=True))


def _meet(dealt: DataFrame, turn: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, score) of the best pairs of each group of rows (qb, xb, is_query, vec_id, q, floor)."""
    width = len(turn)

    def solve(table: pa.Table) -> list[tuple[int, int, int]]:
        table = table.combine_chunks()
        x, ids = _dense(table.column("q").combine_chunks(), width), np.asarray(table.column("vec_id"))
        asks = np.asarray(table.column("is_query"))
        floor = np.asarray(table.column("floor")).astype(np.float64)
        mine = np.flatnonzero(~asks)
        mine = mine[np.lexsort((ids[mine], -(x[mine] ** 2).sum(axis=1)))]
        return best(ids[asks], x[asks], floor[asks], ids[mine], x[mine], turn, k)

    def run(table: pa.Table) -> pa.Table:
        found = solve(table)
        columns = zip(*found, strict=True) if found else ([], [], [])
        return pa.table([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])

    return dealt.groupBy("qb", "xb").applyInArrow(run, "query_id bigint, vec_id bigint, score bigint")


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "copy")
    return pairs.withColumn("copy", F.monotonically_increasing_id()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("copy")


def _numbers(values: list[int]) -> Column:
    return F.array(*map(F.lit, values))


def top_k(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", query_every: int = 50, k: int = K, scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of each query, the rows whose id is divisible by ``query_every``."""
    spark = prepare(vectors.sparkSession)
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    rows = cut(integers(rows, scale))
    row = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("q")).alias("width")).first()
    if not row["n"] or not row["width"]:
        if not row["n"]:
            return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    width = max(1, row["width"] or 1)
    turn = rotation(rows, width)

    # Bands by descending squared length; their edges are quantiles.
    bands = max(1, min(BANDS, -(-row["n"] // block)))
    edges = sorted({float(e) for e in rows.approxQuantile("norm", [i / bands for i in range(1, bands)], 0.25 / bands)}, reverse=True) if bands > 1 else []
    listed = F.array(*map(F.lit, edges)) if edges else F.array().cast("array<double>")
    placed = rows.withColumn("band", F.size(F.filter(listed, lambda e: e > F.col("norm"))))
    members = {r["band"]: r["n"] for r in placed.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a band
    parts = [-(-members.get(b, 0) // block) for b in range(len(edges) + 1)]
    # Which block of its band a row is in follows from its place in the table, so repeated ids don't meet in one.
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.greatest(F.element_at(_numbers(parts), F.col("band") + 1), F.lit(1)))
    placed = cut(placed.withColumn("part", part.cast("int")))

    asks = placed.where(F.pmod("vec_id", F.lit(query_every)) == 0).select("vec_id", "q", "norm")
    q_blocks = max(1, -(-asks.count() // block))
    head = min(b for b, n in enumerate(parts) if n)
    fields = ["qb", "xb", "is_query", "vec_id", "q", "floor"]
    name = F.concat_ws("-", F.col("band").cast("string"), F.col("part").cast("string")).alias("xb")
    low = F.lit(float("-inf"))

    def dealt(questions: DataFrame, answers: DataFrame) -> DataFrame:
        left = questions.select("qb", name, F.lit(True).alias("is_query"), "vec_id", "q", "floor")
        return left.union(answers.select("qb", name, F.lit(False).alias("is_query"), "vec_id", "q", low.alias("floor"))).select(*fields)

    # The first meeting: all queries, a block of the longest rows.
    every = asks.select("vec_id", "q", low.alias("floor"), F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).cast("int").alias("qb"), F.lit(head).alias("band"), F.lit(0).alias("part"))
    longest = placed.where((F.col("band") == head) & (F.col("part") == 0)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    started = cut(_meet(dealt(every, longest), turn, k))
    if sum(parts) == 1:
        return _ranked(started, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    # How many bands a query needs: those whose greatest length times its own reaches its k-th score so far.
    kth = started.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score").cast("double")).alias("floor")).withColumnRenamed("query_id", "vec_id")
    floors = asks.join(kth.hint("merge"), "vec_id", "left").withColumn("floor", F.coalesce("floor", low))
    reach = F.size(F.filter(listed, lambda e: (F.col("floor") <= 0) | (e * F.col("norm") * (1 + 1e-6) >= F.col("floor") * F.col("floor"))))
    levels = min(LEVELS, len(edges) + 1)
    level = F.ceil((reach + 1) * F.lit(levels) / F.lit(len(edges) + 1)).cast("int") - 1
    floors = cut(floors.withColumn("level", level))
    asked = {r["level"]: r["n"] for r in floors.groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a level
    blocks = [-(-asked.get(v, 0) // block) for v in range(levels)]
    last = [(v + 1) * (len(edges) + 1) // levels - 1 for v in range(levels)]  # the last band that a level needs
    # Query blocks are numbered from those that need most, so a band is needed by the first few numbers.
    first = [sum(blocks[v + 1 :]) for v in range(levels)]
    needed = [sum(n for n, end in zip(blocks, last, strict=True) if end >= b) for b in range(len(parts))]
    at = F.col("level") + 1
    number = F.element_at(_numbers(first), at) + F.pmod(F.xxhash64("vec_id"), F.greatest(F.element_at(_numbers(blocks), at), F.lit(1)))
    floors = floors.withColumns({"qb": number.cast("int"), "band": F.explode(F.sequence(F.lit(0), F.element_at(_numbers(last), at)))})
    counts = F.element_at(_numbers(parts), F.col("band") + 1)
    floors = floors.where(counts > 0).withColumn("part", F.explode(F.sequence(F.lit(0), counts - 1)))
    wanted = F.element_at(_numbers(needed), F.col("band") + 1)
    others = placed.where(wanted > 0).withColumn("qb", F.explode(F.sequence(F.lit(0), wanted - 1)))
    rest = (F.col("band") != head) | (F.col("part") != 0)
    pairs = started.union(_meet(dealt(floors.where(rest), others.where(rest)), turn, k))
    return _ranked(pairs, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
