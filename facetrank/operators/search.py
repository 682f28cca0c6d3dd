"""Dense pools, exact filters, gates and top-k.

Top-k by query is a window that Spark limits before the shuffle (WindowGroupLimit), so each task sends k rows a query.
Equal scores are ordered by id, everywhere.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from facetrank.functions.numeric import dot, lit
from facetrank.sources.session import prepare

#: Queries that are sent to all tasks at once; more are taken in blocks of this size.
QUERY_BLOCK = 1024


def dense_scores(items: DataFrame, queries: Mapping[int, Sequence[float]], embedding: str = "embedding", item_id: str = "vec_id", keep: Sequence[str] = ()) -> DataFrame:
    """(query_id, item_id, keep..., dense) of a stated, bounded set of query vectors against all items.

    The vectors are literals of one projection of the items for each block: nothing is joined or shuffled.
    """
    every, out = list(queries.items()), None
    for at in range(0, max(len(every), 1), QUERY_BLOCK):
        scored = F.array(*[F.struct(F.lit(q).cast("bigint").alias("query_id"), dot(embedding, v).alias("dense")) for q, v in every[at : at + QUERY_BLOCK]])
        part = items.select(item_id, *keep, F.explode(scored).alias("s")).select("s.query_id", item_id, *keep, "s.dense")
        out = part if out is None else out.unionAll(part)
    return out


#: Items that meet a block of queries at once, and places (queries times k) that a task keeps.
ITEM_BLOCK, PLACES = 1024, 2_000_000


def dots(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Inner products of all rows of q with all rows of v, each summed from the first component on, as ``dot`` does."""
    out, term = np.zeros((len(q), len(v))), np.empty((len(q), len(v)))
    for d in range(q.shape[1]):
        out += np.multiply(q[:, d, None], v[None, :, d], out=term)
    return out


def _query_blocks(queries: DataFrame, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    rows = queries.select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector")).orderBy("query_id").toArrow()
    ids = rows.column("query_id").to_numpy()
    flat = rows.column("vector").combine_chunks().flatten().to_numpy()
    for at in range(0, len(ids), size):
        yield ids[at : at + size], flat.reshape(len(ids), -1)[at : at + size]


def _item_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        if n := batch.num_rows:
            ids, v = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(n, -1)
            for at in range(0, n, ITEM_BLOCK):
                yield ids[at : at + ITEM_BLOCK], v[at : at + ITEM_BLOCK]


def _per_block(items: DataFrame, queries: DataFrame, size: int, run, embedding: str, item_id: str) -> DataFrame:
    """What ``run(batches, query ids, query vectors)`` makes of the items, for each block of queries."""
    spark = prepare(items.sparkSession)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    schema = f"query_id bigint, `{item_id}` bigint, dense double"
    rows = items.select(F.col(item_id).cast("bigint").alias(item_id), F.col(embedding).cast("array<double>").alias("v")).repartition(n, item_id).sortWithinPartitions(item_id)
    out = None
    for block in _query_blocks(queries, size):
        held = spark.sparkContext.broadcast(block)
        part = rows.mapInArrow(lambda batches, held=held: run(batches, *held.value), schema)
        out = part if out is None else out.unionAll(part)
    return spark.createDataFrame([], schema) if out is None else out


def nearest(items: DataFrame, queries: DataFrame, k: int, *, own: bool = True, embedding: str = "embedding", item_id: str = "vec_id") -> DataFrame:
    """(query_id, item_id, dense, rank): each query's k best items, exactly, for any number of (query_id, vector).

    Queries are taken in blocks; a task keeps the k best of its items, which come in order of id so that the first of
    equals stays. Without ``own``, the item whose id is the query's is left out.
    """
    names = ["query_id", item_id, "dense"]

    def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        cuts = range(0, len(ids), ITEM_BLOCK // 4)
        best = {at: (np.empty((len(ids[at : at + ITEM_BLOCK // 4]), 0)), np.empty((len(ids[at : at + ITEM_BLOCK // 4]), 0), np.int64)) for at in cuts}
        for mine, v in _item_blocks(batches):
            for at in cuts:
                q = ids[at : at + ITEM_BLOCK // 4]
                s = dots(vectors[at : at + ITEM_BLOCK // 4], v)
                if not own:
                    s[q[:, None] == mine[None, :]] = -np.inf
                s, there = np.hstack([best[at][0], s]), np.hstack([best[at][1], np.broadcast_to(mine, s.shape)])
                first = np.argsort(-s, axis=1, kind="stable")[:, :k]
                best[at] = np.take_along_axis(s, first, 1), np.take_along_axis(there, first, 1)
        for at, (s, there) in best.items():
            some = np.isfinite(s)
            rows, _ = np.nonzero(some)
            yield pa.RecordBatch.from_arrays([pa.array(ids[at + rows]), pa.array(there[some]), pa.array(s[some])], names=names)

    found = _per_block(items, queries, max(64, min(4 * QUERY_BLOCK, PLACES // max(k, 1))), run, embedding, item_id)
    return ranked(found, ["query_id"], "dense", item_id, k)


def all_scores(items: DataFrame, queries: DataFrame, embedding: str = "embedding", item_id: str = "vec_id") -> DataFrame:
    """(query_id, item_id, dense) of each query with each item: as many rows as the product of both."""

    def run(batches: Iterator[pa.RecordBatch], ids: np.ndarray, vectors: np.ndarray) -> Iterator[pa.RecordBatch]:
        for mine, v in _item_blocks(batches):
            for at in range(0, len(ids), ITEM_BLOCK // 4):
                q = ids[at : at + ITEM_BLOCK // 4]
                s = dots(vectors[at : at + ITEM_BLOCK // 4], v)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q, len(mine))), pa.array(np.tile(mine, len(q))), pa.array(s.ravel())], names=["query_id", item_id, "dense"])

    return _per_block(items, queries, 4 * QUERY_BLOCK, run, embedding, item_id)


def query_vectors(items: DataFrame, ids: Sequence[int], embedding: str = "embedding", item_id: str = "vec_id") -> dict[int, list[float]]:
    """Vectors of some items by id, in order of id (as many as are named)."""
    rows = items.where(F.col(item_id).isin(list(ids))).select(item_id, embedding).orderBy(item_id).collect()
    return {r[0]: [float(x) for x in r[1]] for r in rows}


def ranked(rows: DataFrame, by: Sequence[str], score: str, item_id: str, k: int | Column | None = None, name: str = "rank") -> DataFrame:
    """``rows`` with their rank by descending score, then id; the first k of each group only, where k is given."""
    out = rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), item_id)))
    return out if k is None else out.where(F.col(name) <= (F.lit(k) if isinstance(k, int) else k))


def top_k(rows: DataFrame, score: str, item_id: str, k: int) -> DataFrame:
    """The k best rows with rank from 1; none for k = 0, all for k beyond their number."""
    best = rows.orderBy(F.desc(score), item_id).limit(max(k, 0))
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), item_id)))


def exact_filter(rows: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Rows that have all the facet values named; a filter of its own, so that it is pushed into the scan."""
    for field, value in filters.items():
        rows = rows.where(F.col(field) == F.lit(value))
    return rows


def facets(items: DataFrame, catalog: DataFrame, item_id: str, key: str, fields: Mapping[str, str], missing: str = "Unknown") -> DataFrame:
    """``items`` with facet columns from a catalog; items without an entry have the value ``missing``."""
    side = catalog.select(F.col(key).alias("_key"), *[F.col(c).cast("string").alias(n) for n, c in fields.items()])
    return items.join(side, F.col(item_id) == F.col("_key"), "left").drop("_key").fillna(missing, list(fields))


def gather(candidates: DataFrame, codes: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Codes of a bag of candidates: a candidate named twice is scored twice; an id that no code has is an error."""
    joined = candidates.join(codes.withColumn("_there", F.lit(True)), row_id, "left")
    there = F.when(F.col("_there").isNotNull(), F.col(row_id)).otherwise(F.raise_error(F.concat(F.lit("no such candidate: "), F.coalesce(F.col(row_id).cast("string"), F.lit("null")))))
    return joined.withColumn(row_id, there).drop("_there")


def gate_table(scored: DataFrame, score: str, fractions: Sequence[float], k: int) -> DataFrame:
    """(gate_index, fraction, gate, eligible, eligible_fraction) of each selectivity that leaves more than k items."""
    row = F.percentile(score, F.array(*[lit(1 - f) for f in fractions])).alias("gates")
    gates = scored.agg(row, F.count(F.lit(1)).alias("n")).select(F.posexplode("gates").alias("gate_index", "gate"), "n")
    gates = gates.withColumn("fraction", F.get(F.array(*map(lit, fractions)), F.col("gate_index"))).where(F.col("fraction") * F.col("n") >= k + 1)
    values = gates.select("gate_index", "fraction", "gate", "n").collect()  # one row a fraction
    if not values:
        return gates.select("gate_index", "fraction", "gate", F.lit(0).cast("bigint").alias("eligible"), lit(0).alias("eligible_fraction"))
    counts = scored.agg(*[F.count_if(F.col(score) >= lit(v["gate"])).alias(f"c{v['gate_index']}") for v in values])
    counts = counts.select(F.explode(F.array(*[F.struct(F.lit(v["gate_index"]).alias("gate_index"), lit(v["fraction"]).alias("fraction"), lit(v["gate"]).alias("gate"), F.col(f"c{v['gate_index']}").alias("eligible"), F.lit(v["n"]).alias("n")) for v in values])).alias("g"))
    return counts.select("g.gate_index", "g.fraction", "g.gate", "g.eligible", (F.col("g.eligible") / F.col("g.n")).alias("eligible_fraction"))


def gated_truth(scores: DataFrame, gate: float, k: int, dense: str = "dense", semantic: str = "semantic", item_id: str = "vec_id") -> DataFrame:
    """Exact top-k of each query among the items that pass the gate, the query's own item left out."""
    passed = scores.where((F.col(semantic) >= lit(gate)) & (F.col(item_id) != F.col("query_id")))
    return ranked(passed, ["query_id"], dense, item_id, k)


def ask_size(fraction: float, k: int, multiplier: float, n_items: int) -> int:
    """How many an over-fetching search asks for."""
    return min(max(math.ceil(multiplier * k / fraction), k), max(n_items - 1, k))


def over_fetch(scores: DataFrame, gate: float, fraction: float, k: int, multiplier: float, n_items: int, dense: str = "dense", semantic: str = "semantic", item_id: str = "vec_id") -> DataFrame:
    """Filter after fetching: the first ``ask`` by dense score, of these the first k that pass.

    The query's own item takes a place among the fetched and goes afterwards.
    """
    ask = ask_size(fraction, k, multiplier, n_items)
    fetched = ranked(scores, ["query_id"], dense, item_id, ask, "_fetched").drop("_fetched")
    return gated_truth(fetched, gate, k, dense, semantic, item_id)


def recall(found: DataFrame, truth: DataFrame, queries: DataFrame, item_id: str = "vec_id") -> DataFrame:
    """(query_id, hits, n_truth, recall); 1 for a query with nothing to find."""
    hits = found.select("query_id", item_id).join(truth.select("query_id", item_id), ["query_id", item_id], "left_semi").groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"))
    sizes = truth.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_truth"))
    zero = F.lit(0).cast("bigint")
    out = queries.select("query_id").join(sizes, "query_id", "left").join(hits, "query_id", "left")
    out = out.select("query_id", F.coalesce("hits", zero).alias("hits"), F.coalesce("n_truth", zero).alias("n_truth"))
    return out.withColumn("recall", F.when(F.col("n_truth") == 0, lit(1)).otherwise(F.col("hits") / F.col("n_truth")))


def tile(rows: DataFrame, row_id: str, n_source: int, n: int) -> DataFrame:
    """n rows that repeat the source's, in order: row i has what source row i % n_source has."""
    index = rows.sparkSession.range(n).withColumnRenamed("id", "tile_id").withColumn(row_id, F.col("tile_id") % n_source)
    return index.join(rows, row_id)


def random_candidates(spark, n: int, n_items: int, seed: int = 7) -> DataFrame:
    """(pos, row_id): n candidates with repetition, by a hash of their position."""
    return spark.range(n).select(F.col("id").alias("pos"), F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n_items)).alias("row_id"))
