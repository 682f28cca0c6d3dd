"""MinHash near-dedup by a multi-index Hamming join.

A document is the set of its distinct word shingles. Its signature has ``positions`` MinHash values of 16 bits each.
Signatures are split into chunks; by pigeonhole, two signatures that differ in fewer than ``chunks * (errors + 1)``
positions agree in some chunk up to ``errors`` positions, so listing each chunk with every choice of ``errors``
positions left out finds every pair below that distance. Pairs are confirmed on the full shingle sets.

How hot groups are kept flat: documents with the same set are one class and join once. Buckets are worked off in rounds.
In each round a bucket has one centre, drawn at random, which meets the members of other components; then it leaves the
bucket, as all its pairs are decided, and links of all buckets are joined into components. A bucket whose members are in
one component is closed: pairs within a component change nothing. So a round has at most one pair per member, and a
group of near copies closes after a few. What stays open once rounds no longer help (documents that are somewhat alike
but not linked) is compared in blocks of a fixed size, which hand on one link for each two components.

Defined cases: null and blank texts have the empty set and are linked with nothing; fewer words than a shingle give one
shingle of them all; repeated rows are copies; rows with one id are one node; a null id is linked with nothing; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from facetrank.llm import text as K
from facetrank.llm.components import components, dealt_anew
from facetrank.sources.session import cut, drop, prepare, sweep

POSITIONS = 96
CHUNK = 6
ERRORS = 1
SALTS = 16
#: Rounds of centres at most, and the share of open members that a round must close for another to follow: as long as it
#: is half, all rounds together cost no more than twice the first.
ROUNDS, LEAST_CLOSED = 12, 0.5
#: Members of a block in the comparison of what rounds leave open.
BLOCK = 512
#: Share of pairs at the least similarity that may be further apart than the signature distance up to which pairs are
#: confirmed; the index itself leaves out 4e-8 of them.
FAR = 1e-10


def distance_limit(positions: int, percent: int) -> int:
    """The least distance that a share below ``FAR`` of pairs of that similarity exceeds (each position differs with
    probability 1 - similarity, so the tail of a binomial distribution)."""
    p = 1 - percent / 100
    tail, limit = 0.0, positions
    while limit > 0:
        tail += comb(positions, limit) * p**limit * (1 - p) ** (positions - limit)
        if tail >= FAR:
            break
        limit -= 1
    return limit


def _coefficients(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * K.U64(2) + K.U64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def shingle_sets(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text, first of each document and the end)."""
    raw, offsets = K.buffers(column)
    raw = K.LOWER[raw]
    hashes, first = K.word_hashes(raw, offsets)
    counts = np.diff(first)
    doc = np.repeat(np.arange(len(counts)), counts)
    win, inside = K.windows(hashes, first, size)
    at = np.flatnonzero(inside)
    value, owner = win[at], doc[at]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = []
        for d in short:
            acc = K.U64(0x5851F42D4C957F2D)
            with np.errstate(over="ignore"):
                for h in hashes[first[d] : first[d + 1]]:
                    acc = K.mix(np.array([acc * K.U64(K._BASE) + h]))[0]
            whole.append(acc)
        value, owner = np.concatenate([value, np.array(whole, K.U64)]), np.concatenate([owner, short])
    key = K.mix(value ^ K.mix(owner.astype(K.U64) + K.U64(1)))
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order][1:] != key[order][:-1]
    keep = np.sort(order[new])
    if len(short):
        keep = keep[np.argsort(owner[keep], kind="stable")]
    return value[keep], np.searchsorted(owner[keep], np.arange(len(counts) + 1))


def _signatures(value: np.ndarray, first: np.ndarray, positions: int) -> np.ndarray:
    """uint16[documents, positions]; zeros where a document has no shingle."""
    out = np.zeros((len(first) - 1, positions), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if not len(full):
        return out
    starts = first[:-1][full]
    mul, add = _coefficients(positions)
    work = np.empty_like(value)
    for p in range(positions):
        np.multiply(value, mul[p], out=work)
        np.add(work, add[p], out=work)
        out[full, p] = K.mix(np.minimum.reduceat(work, starts)).astype(np.uint16)
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    """One fixed-width binary value for each row of a matrix."""
    n, width = len(rows), rows.shape[1] * rows.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _matrix(column: pa.Array, positions: int) -> np.ndarray:
    return K.buffers(column)[0].view(np.uint16).reshape(-1, positions)


def signatures(docs: DataFrame, size: int, positions: int = POSITIONS) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, sig): d1 and d2 are a 128-bit digest of the set."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            value, first = shingle_sets(batch.column("text"), size)
            digest = [np.zeros(batch.num_rows, np.uint64) for _ in range(2)]
            if len(value):
                for d, salt in zip(digest, (0x1234567, 0x7654321), strict=True):
                    total = np.zeros(len(value) + 1, np.uint64)
                    np.cumsum(K.mix(value + K.U64(salt)), out=total[1:])
                    d[:] = total[first[1:]] - total[first[:-1]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(first), pa.int64()), *(pa.array(d.view(np.int64)) for d in digest), _binary(_signatures(value, first, positions))],
                names=["doc_id", "n_shingles", "d1", "d2", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_shingles bigint, d1 bigint, d2 bigint, sig binary")


def chunk_keys(reps: DataFrame, positions: int, chunk: int, errors: int) -> DataFrame:
    """(key, id): each chunk of each signature with every choice of ``errors`` positions left out."""
    choices = [np.array([p for p in range(chunk) if p not in out]) for out in combinations(range(chunk), errors)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                sig = _matrix(batch.column("sig"), positions).astype(np.uint64)
                keys = []
                for c in range(positions // chunk):
                    for k, left in enumerate(choices):
                        acc = np.full(len(sig), c * len(choices) + k + 1, np.uint64)
                        for p in left:
                            acc = K.mix(acc * K.U64(K._BASE) + sig[:, c * chunk + p])
                        keys.append(acc)
                ids = np.asarray(batch.column("id"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.tile(ids, len(keys)))], names=["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key bigint, id bigint")


def near_enough(pairs: DataFrame, reps: DataFrame, positions: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose sizes and signatures allow the similarity."""
    most = distance_limit(positions, percent)
    one = reps.select(F.col("id").alias("u"), F.col("n_shingles").alias("nu"), F.col("sig").alias("su"))
    two = reps.select(F.col("id").alias("v"), F.col("n_shingles").alias("nv"), F.col("sig").alias("sv"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far = (_matrix(batch.column("su"), positions) != _matrix(batch.column("sv"), positions)).sum(axis=1)
            yield batch.select(["u", "v"]).filter(pa.array(far <= most))

    sized = F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent
    return pairs.join(one.hint("merge"), "u").join(two.hint("merge"), "v").where(sized).select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(id, hashes): the sorted 64-bit shingle hashes of the documents named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            value, first = shingle_sets(batch.column("text"), size)
            sets = [np.sort(value[a:b]).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sets, pa.binary())], names=["id", "hashes"])

    wanted = docs.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
    return wanted.mapInArrow(run, "id bigint, hashes binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets have 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for a, b in zip(batch.column("hu"), batch.column("hv"), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), np.uint64) for x in (a, b))
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(common * 100 >= percent * (len(both) - common))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    one, two = (sets.select(F.col("id").alias(c), F.col("hashes").alias(f"h{c}")).hint("merge") for c in "uv")
    return pairs.join(one, "u").join(two, "v").select("u", "v", "hu", "hv").mapInArrow(run, "u bigint, v bigint")


def _common(sets: list[np.ndarray], n: int) -> np.ndarray:
    """Sizes of the intersections of the first ``n`` sets with the others, by products of 0/1 matrices.

    The matrices have some thousand columns at a time, so that memory doesn't follow the longest document.
    """
    value = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    order = np.argsort(value, kind="stable")
    value, row = value[order], row[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    column = np.cumsum(new) - 1
    out = np.zeros((n, len(sets) - n), np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
        at = slice(*np.searchsorted(column, [start, start + 8192]))
        dense = np.zeros((len(sets), 8192), np.float32)
        dense[row[at], column[at] - start] = 1
        out += dense[:n] @ dense[n:].T
    return out.astype(np.int64)


def _bucket_members(reps: DataFrame, positions: int, chunk: int, errors: int) -> DataFrame:
    """(key, id) of every bucket with two members or more."""
    keys = chunk_keys(reps, positions, chunk, errors)
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    return keys.join(dealt_anew(shared, "key").hint("merge"), "key")


def _with_components(members: DataFrame, found: DataFrame | None) -> DataFrame:
    if found is None:
        return members.withColumn("component", F.col("id"))
    named = members.join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left")
    return named.select("key", "id", F.coalesce("component", "id").alias("component"))


def _open(members: DataFrame, found: DataFrame | None, number: int) -> DataFrame:
    """(key, id, component, centre, home, size) of the buckets that span components; ``home`` is the centre's component.

    The centre is the member with the least hash, another one in each round; a large component mostly provides it.
    """
    named = _with_components(members, found)
    drawn = F.min(F.struct(F.xxhash64("id", F.lit(number)).alias("draw"), "id", "component")).alias("x")
    buckets = named.groupBy("key").agg(drawn, F.min("component").alias("low"), F.max("component").alias("high"), F.count(F.lit(1)).alias("size"))
    buckets = buckets.where("low < high").select("key", F.col("x.id").alias("centre"), F.col("x.component").alias("home"), "size")
    return named.join(dealt_anew(buckets, "key").hint("merge"), "key")


def link_by_rounds(members: DataFrame, reps: DataFrame, sets: DataFrame, positions: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(components found, members of the buckets that are still open); both are cut."""
    found, left, before, held = None, members, None, None
    for number in range(ROUNDS + 1):
        now = cut(_open(left, found, number))
        if held is not None:
            drop(held)  # of the round before, from which ``left`` came
        held, n = now, now.count()
        if not n or number == ROUNDS or before is not None and n > (1 - LEAST_CLOSED) * before:
            break
        stars = now.where("component <> home").select(F.col("centre").alias("u"), F.col("id").alias("v")).distinct()
        near = cut(near_enough(stars, reps, positions, percent))
        links = cut(confirm(near, sets, percent))
        if found is None:
            found = components(links)
        elif not links.isEmpty():
            after = components(links.union(found.select(F.col("node").alias("u"), F.col("component").alias("v"))))
            drop(found)
            found = after
        drop(near, links)
        sweep(members.sparkSession)
        left, before = now.where("id <> centre AND size > 2").select("key", "id"), n
    rest = cut(held.select("home", "id", "component").distinct())
    drop(held)
    if found is None:
        found = members.sparkSession.createDataFrame([], "node bigint, component bigint")
    return found, rest


def confirm_across(named: DataFrame, sets: DataFrame, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (u, v) between the components of each home's members, from ``named`` (home, id, component).

    For each home, those outside it meet all members: both are dealt into blocks, each pair of blocks is one small
    group, and one link for each two components leaves it.
    """
    sizes = named.groupBy("home").agg(F.count(F.lit(1)).alias("n_all"), F.count_if(F.expr("component <> home")).alias("n_out")).where("n_out > 0")
    # A home can hold a great part of all members: both sides are salted.
    sizes = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    blocks = {"rows": F.ceil(F.col("n_all") / block).cast("int"), "columns": F.ceil(F.col("n_out") / block).cast("int")}
    counted = named.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(sizes, ["home", "_salt"]).withColumns(blocks)
    every = counted.withColumns({"one": F.pmod(F.xxhash64("id"), "rows").cast("int"), "two": F.explode(F.expr("sequence(0, columns - 1)")), "outside": F.lit(False)})
    out = counted.where("component <> home").withColumns({"two": F.pmod(F.xxhash64("id"), "columns").cast("int"), "one": F.explode(F.expr("sequence(0, rows - 1)")), "outside": F.lit(True)})
    fields = ["home", "one", "two", "outside", "id", "component"]
    dealt = every.select(*fields).union(out.select(*fields)).join(sets.hint("merge"), "id").repartition("home", "one", "two")
    dealt = dealt.sortWithinPartitions("home", "one", "two", "outside").select(*fields, "hashes")

    def linked(rows: list[tuple]) -> set[tuple[int, int]]:
        outside = [r for r in rows if r[3]]
        rest = [r for r in rows if not r[3]]
        if not outside or not rest:
            return set()
        found = [np.frombuffer(r[6].as_buffer(), np.uint64) for r in outside + rest]
        size = np.array([len(x) for x in found])
        common = _common(found, len(outside))
        union = size[: len(outside), None] + size[None, len(outside) :] - common
        places = zip(*np.nonzero(common * 100 >= percent * union), strict=True)
        return {(outside[i][5], rest[j][5]) for i, j in places if outside[i][5] != rest[j][5]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for row in zip(*(batch.column(c).to_pylist() for c in fields), batch.column("hashes"), strict=True):
                if held and held[0][:3] != row[:3]:
                    found |= linked(held)
                    held = []
                held.append(row)
            yield from links(found)
        yield from links(linked(held))

    def links(found: set[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*sorted(found), strict=True)], names=["u", "v"])

    return dealt.mapInArrow(run, "u bigint, v bigint").distinct()


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80,
    positions: int = POSITIONS, chunk: int = CHUNK, errors: int = ERRORS,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest id reachable) and kept."""
    docs = docs.select(F.col(K.quoted(doc_id)).cast("bigint").alias("doc_id"), F.col(K.quoted(text)).alias("text"))
    every = cut(signatures(docs, shingle, positions))
    full = every.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = full.groupBy("d1", "d2", "n_shingles").agg(F.min(F.struct("doc_id", "sig")).alias("x"), F.count(F.lit(1)).alias("copies"))
    reps = cut(classes.select("d1", "d2", "n_shingles", "copies", F.col("x.doc_id").alias("id"), F.col("x.sig").alias("sig")))

    members = cut(_bucket_members(reps, positions, chunk, errors))
    sweep(docs.sparkSession)
    sets = cut(full_sets(docs, members, shingle))
    found, still = link_by_rounds(members, reps, sets, positions, percent)
    drop(members)
    more = []
    if not still.isEmpty():
        more.append(cut(confirm_across(still, sets, percent)))
    drop(still, sets)
    sweep(docs.sparkSession)
    # An id on rows with different sets is one node: it links their classes.
    several = full.groupBy("doc_id").agg(F.min(F.struct("d1", "d2")).alias("a"), F.max(F.struct("d1", "d2")).alias("b")).where("a <> b").select("doc_id")
    if not several.isEmpty():
        rows = full.join(several.hint("merge"), "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct()
        more.append(cut(rows.join(reps.hint("merge"), ["d1", "d2"]).select(F.col("doc_id").alias("u"), F.col("id").alias("v"))))
    more = [x for x in more if not x.isEmpty()]
    if more:
        known = found.select(F.col("node").alias("u"), F.col("component").alias("v"))
        after = components(reduce(DataFrame.union, more, known))
        drop(found, *more)
        found = after

    # Only classes of several documents, and linked ones, need a place in the join; copies of one class are salted.
    homes = reps.join(found.withColumnRenamed("node", "id").hint("merge"), "id", "left").where("copies > 1 OR component IS NOT NULL")
    homes = homes.select("d1", "d2", F.coalesce("component", "id").alias("component_id")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = every.drop("sig").withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(homes.hint("merge"), ["d1", "d2", "_salt"], "left")
    component = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) without near-duplicates: of each group, the smallest id stays once.

    Rows with a null id are linked with nothing and stay. Of several rows with the smallest id one stays, the first by
    all columns that have an order. Columns stay as they are, whatever their names.
    """
    columns = [F.col(K.quoted(c)) for c in docs.columns]
    judged = cut(near_duplicates(docs, **options).select("doc_id", "kept"))
    gone = judged.where("NOT kept").select("doc_id").distinct()
    out = docs.join(gone.hint("merge"), "doc_id", "left_anti")
    again = judged.where("kept AND doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if again.isEmpty():
        return out.select(*columns)
    again = cut(again)
    place = K.unused("row", docs.columns)
    ordered = [F.col(K.quoted(f.name)) for f in docs.schema if f.name != "doc_id" and not isinstance(f.dataType, MapType | VariantType)]
    first = Window.partitionBy("doc_id").orderBy(*ordered or ["doc_id"])
    once = out.join(again.hint("merge"), "doc_id", "left_semi").withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return out.join(again.hint("merge"), "doc_id", "left_anti").select(*columns).union(once.select(*columns))
