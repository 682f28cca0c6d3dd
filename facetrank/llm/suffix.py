"""Removal of repeated byte strings, exact at any distance, on a Burrows-Wheeler transform.

A byte goes if some string of ``length`` bytes that covers it also starts anywhere else. Strings (windows) are dealt by
the smallest hash of their 32-byte grams: equal windows have the same one, and neighbouring windows mostly share it, so
that a document becomes a few runs of windows, each a segment of its bytes. A hash that occurs once can't hold a repeat,
and its segments end there; no bytes are moved for them. Segments with the same bytes (by a keyed hash, so that no pattern can
make different ones look the same) count as one with a weight, and are repeats as they stand.

What is left is gathered by hash into batches of bounded size. In each, the transform of the segments is built, and the
longest common prefixes of neighbouring suffixes are derived by increasing value: each boundary found at one value is
extended backward by the characters around it, breadth first, and gives the boundaries of the next value. The expansion
stops at ``length``; rows that no boundary parts by then start with the same ``length`` bytes. When an interval is
split, all parts but the largest are visited, so the work is n log n in the worst case.

A hash with more different segments than a batch may hold (the edges of a passage that is in a great part of all
documents: each goes on in another way) is dealt again, by the least hashes at both ends of each window as well, and where
that is not enough over shorter and shorter ends. Again what occurs once goes, what is equal counts as one, and what is
left is batched. So a segment breaks up in a few parts a level, nearly all of which go at once. Parts that are still too
many after that are told apart window by window, by a hash of all bytes.

Defined cases: a null or empty text has no bytes; texts under ``length`` bytes lose nothing; repeated rows are copies of
each other, so all their windows go; rows with a null id are handled like others; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from facetrank.llm import text as K
from facetrank.llm.components import dealt_anew
from facetrank.sources.session import cut, drop, prepare, sweep

LENGTH = 200
GRAM = 32
#: Windows in a segment at most; longer runs (of periodic text) are split.
RUN = 4096
#: Bytes of segments that one transform is built of.
BATCH_BYTES = 1 << 20
#: Bytes of different segments of one hash beyond which they are dealt again first, and grams at each end of a window
#: whose least hash that goes by, level by level.
HOT_BYTES = 1 << 18
ENDS = (64, 16, 4)
_SEGMENT = "h bigint, c bigint, start bigint, n bigint, inner boolean"


def _sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    out, step = values, 1
    while 2 * step <= width:
        out = np.minimum(out[:-step], out[step:])
        step *= 2
    rest = width - step
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def segments(raw: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(document, h, c, start in it, number of windows, whether h occurs twice in it) of every run of windows."""
    gram = min(GRAM, length)
    width = length - gram + 1
    if len(raw) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.uint64, np.int64, np.int64, bool))
    prefix = K.prefix_hashes(raw)
    at = np.arange(len(raw) - gram + 1)
    grams = K.range_hashes(prefix, at, at + gram)
    least = _sliding_minimum(grams, width)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    valid = doc[: len(least)] == doc[length - 1 : length - 1 + len(least)]
    first = np.ones(len(least), bool)
    first[1:] = (least[1:] != least[:-1]) | (doc[1 : len(least)] != doc[: len(least) - 1])
    first &= valid
    start = np.flatnonzero(first)
    ends = np.flatnonzero(valid & np.append(~valid[1:] | first[1:], True)) + 1
    n = ends - start
    if len(n) and n.max() > RUN:
        parts = -(-n // RUN)
        inner = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, whole = np.repeat(start, parts) + inner * RUN, np.repeat(n, parts)
        n = np.minimum(RUN, whole - inner * RUN)
    h = least[start]
    twice = _occurs_twice(grams, h, start, start + n + width - 1)
    data = memoryview(np.ascontiguousarray(raw))
    c = K.content_hashes(data[a:b] for a, b in zip(start.tolist(), (start + n + length - 1).tolist(), strict=True))
    return doc[start], h, c, start - offsets[doc[start]], n, twice


def _occurs_twice(grams: np.ndarray, h: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Whether each hash stands at two places or more of its range."""
    mask = K.U64((1 << 22) - 1)
    marked = np.zeros(1 << 22, bool)
    marked[h & mask] = True
    at = np.flatnonzero(marked[grams & mask])
    value = grams[at]
    order = np.argsort(value, kind="stable")
    value, at = value[order], at[order]
    low, high = np.searchsorted(value, h, "left"), np.searchsorted(value, h, "right")
    out = np.zeros(len(h), bool)
    many = np.flatnonzero(high - low > 1)
    # Places of one value are in order, so those in a range are a run of them.
    size = (high - low)[many]
    place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low[many], size)
    inside = (at[place] >= np.repeat(start[many], size)) & (at[place] < np.repeat(stop[many], size))
    out[many] = K.sums(inside, np.concatenate([[0], np.cumsum(size)])) > 1
    return out


def _as_signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def unique_ids(docs: DataFrame) -> bool:
    """Whether an id names one row, so that a hash of the text isn't needed beside it."""
    return docs.groupBy(F.coalesce("doc_id", F.lit(-1)).alias("id0")).count().where("count > 1").isEmpty()


def fingerprint(docs: DataFrame, length: int, unique: bool) -> DataFrame:
    """(doc_id, id0, d, n_bytes, sha256, segments): one row per document.

    (id0, d) tells rows apart: the id, and a hash of the text, which is 0 where ids are unique.
    """
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            raw, offsets = K.buffers(batch.column("text"))
            digest, sha = _digests(raw, offsets)
            digest = digest * K.U64(not unique)
            doc, *parts = segments(raw, offsets, length)
            values = [_as_signed(parts[0]), _as_signed(parts[1]), pa.array(parts[2]), pa.array(parts[3]), pa.array(parts[4])]
            where = np.searchsorted(doc, np.arange(batch.num_rows + 1)).astype(np.int32)
            nested = pa.ListArray.from_arrays(pa.array(where), pa.StructArray.from_arrays(values, ["h", "c", "start", "n", "inner"]))
            ids = batch.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [ids, ids.fill_null(-1), _as_signed(digest), pa.array(np.diff(offsets)), pa.array(sha), nested], names=["doc_id", "id0", "d", "n_bytes", "sha256", "segments"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id bigint, id0 bigint, d bigint, n_bytes bigint, sha256 string, segments array<struct<{_SEGMENT.replace(' ', ':').replace(',:', ', ')}>>")


def _digests(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str]]:
    """(64 bits of each text's SHA-256, the whole in hexadecimal)."""
    data = memoryview(np.ascontiguousarray(raw))
    sha = [hashlib.sha256(data[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return np.frombuffer(b"".join(x.digest()[:8] for x in sha), np.uint64), [x.hexdigest() for x in sha]


def transform(symbols: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of the cyclic text, its transform); rows are in order of their first ``depth`` symbols at least."""
    n = len(symbols)
    key = np.zeros(n, np.uint64)
    for k in range(7):  # 9 bits a symbol
        key = (key << K.U64(9)) | np.roll(symbols, -k).astype(np.uint64)
    reach = 7
    while True:
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        rank = np.empty(n, np.uint64)
        rank[order] = (np.cumsum(new) - 1).astype(np.uint64)
        if reach >= depth or new.all():
            break
        key = (rank << K.U64(32)) | np.roll(rank, -reach)
        reach *= 2
    return order, symbols[order - 1]


def expand(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, interval of each of its rows): rows of one interval start with the same ``length`` symbols."""
    suffixes, bwt = transform(symbols, length + 1)
    n = len(symbols)
    back = np.argsort(bwt, kind="stable")  # row of the transform that stands at each row of the sorted column
    forth = np.empty(n, np.int64)
    forth[back] = np.arange(n)
    column = bwt[back]
    found = np.zeros(n + 1, bool)  # a boundary before the row has been found
    label = np.zeros(n, np.int64)
    begin, end = np.zeros(n + 1, np.int64), np.zeros(n + 1, np.int64)
    end[0], labels = n, 1
    new = np.flatnonzero(np.append(False, column[1:] != column[:-1]))  # common prefixes of 0 symbols
    found[new] = True
    for _ in range(length):
        if not len(new):
            break
        # Split the intervals at the new boundaries; only the parts beside the largest get new labels.
        of = label[new]
        lead = np.ones(len(new), bool)
        lead[1:] = of[1:] != of[:-1]
        last = np.append(lead[1:], True)
        parts_begin = np.concatenate([begin[of[lead]], new])
        parts_of = np.concatenate([of[lead], of])
        order = np.argsort(parts_begin, kind="stable")
        parts_begin, parts_of = parts_begin[order], parts_of[order]
        close = np.ones(len(parts_begin), bool)
        close[:-1] = parts_of[1:] != parts_of[:-1]
        parts_end = np.empty_like(parts_begin)
        parts_end[:-1] = parts_begin[1:]
        parts_end[close] = end[of[last]]
        size = parts_end - parts_begin
        group = np.cumsum(np.append(True, close[:-1])) - 1
        by_size = np.lexsort((size, group))
        largest = by_size[np.append(group[by_size][1:] != group[by_size][:-1], True)]
        begin[parts_of[largest]], end[parts_of[largest]] = parts_begin[largest], parts_end[largest]
        rest = np.ones(len(size), bool)
        rest[largest] = False
        size, starts = size[rest], parts_begin[rest]
        fresh = np.arange(labels, labels + len(size))
        labels += len(size)
        begin[fresh], end[fresh] = starts, parts_end[rest]
        rows = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(starts, size)
        label[rows] = np.repeat(fresh, size)
        # Extend backward: where two neighbours in the sorted column now stand in different intervals.
        row = forth[rows]
        up, down = row, row + 1
        up = up[(up > 0) & ~found[up]]
        down = down[(down < n) & ~found[np.minimum(down, n)]]
        near = np.concatenate([up, down])
        near = near[label[back[near - 1]] != label[back[near]]]
        found[near] = True
        new = np.unique(near)
    return suffixes, label


def repeated(parts: list[bytes], weights: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(segment, first, end) of the runs of windows that occur twice or more, by the weights of their segments."""
    sizes = np.array([len(p) for p in parts])
    symbols = np.zeros(sizes.sum() + len(parts), np.uint16)
    begin = np.cumsum(sizes + 1) - sizes - 1
    place = np.arange(sizes.sum()) + np.repeat(np.arange(len(parts)), sizes)
    symbols[place] = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint16) + 1
    suffixes, label = expand(symbols, length)
    owner = np.repeat(np.arange(len(parts)), sizes + 1)
    offset = np.arange(len(symbols)) - begin[owner]
    window = offset + length <= sizes[owner]
    rows = window[suffixes]
    weight = np.bincount(label[rows], weights=weights[owner[suffixes[rows]]], minlength=len(symbols) + 1)
    hit = np.zeros(len(symbols), bool)
    hit[suffixes[rows]] = weight[label[rows]] >= 2
    edge = np.flatnonzero(hit)
    first = edge[~np.append(False, hit)[edge]]
    end = edge[~np.append(hit, False)[edge + 1]] + 1
    return list(zip(owner[first].tolist(), offset[first].tolist(), (end - begin[owner[first]]).tolist(), strict=True))


_PART = ["h", "id0", "d", "start", "m", "data"]
_PARTS = "h bigint, id0 bigint, d bigint, start bigint, m bigint, data binary"
_SPANS = "array<struct<a: bigint, b: bigint>>"
_RANGE = f"id0 bigint, d bigint, spans {_SPANS}"


def _expand_batches(parts: DataFrame, length: int) -> DataFrame:
    """(id0, d, spans): byte ranges of the repeated windows of the segments that occur once."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        found = repeated([x[5] for x in held], np.array([x[4] for x in held]), length)
        rows = [(held[i][1], held[i][2], held[i][3] + first, held[i][3] + stop + length - 1) for i, first, stop in found if held[i][4] == 1]
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        id0, d, a, b = (np.array(x, np.int64) for x in columns)
        return pa.RecordBatch.from_arrays([pa.array(id0), pa.array(d), _spans_of(a, b, np.arange(len(a) + 1))], names=["id0", "d", "spans"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _PART), strict=True):
                if size >= BATCH_BYTES and held[-1][0] != row[0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
        if held:
            yield solve(held)

    return parts.select(*_PART).repartition("h").sortWithinPartitions("h").mapInArrow(run, _RANGE)


def _spans_of(a: np.ndarray, b: np.ndarray, first: np.ndarray) -> pa.Array:
    """Lists of ranges [a, b); ``first`` says where each list begins, and the end."""
    return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.StructArray.from_arrays([pa.array(a), pa.array(b)], ["a", "b"]))


def _gathered(owner: np.ndarray, key: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(the first, the number and the joined ranges of the runs of each owner and key), for runs of periodic text recur."""
    order = np.lexsort((start, key, owner))
    key, owner, start, stop = key[order], owner[order], start[order], (start + size)[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    edge = fresh.copy()
    edge[1:] |= start[1:] > stop[:-1]  # runs of one key have one size, so the stops are in order as well
    first, spans = np.flatnonzero(fresh), np.flatnonzero(edge)
    ends = stop[np.append(spans[1:], len(stop)) - 1] if len(spans) else stop
    return order[first], np.diff(np.append(first, len(key))), _spans_of(start[spans], ends, np.searchsorted(spans, np.append(first, len(key))))


def _windows_of(batch: pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all segments; segment, place in the bytes and place in the document of each of their windows)."""
    raw, offsets = K.buffers(batch.column("data"))
    n = np.diff(offsets) - length + 1
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return raw, owner, offsets[:-1][owner] + at, np.asarray(batch.column("start"))[owner] + at


def _split(parts: DataFrame, length: int, width: int) -> DataFrame:
    """(h, id0, d, start, m, data, c, inner, own, spans): the segments as runs of windows with the same least hashes at
    both ends. Equal runs of a segment are one, with the ranges of all. ``own`` is the weight of the segment, ``m`` that
    times the number of equal runs; ``inner`` says that two windows of the run may be the same.
    """
    gram = min(GRAM, length)
    width = min(width, length - gram + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "data"):
            raw, owner, place, start = _windows_of(batch, length)
            prefix, every = K.prefix_hashes(raw), np.arange(len(raw) - gram + 1)
            grams = K.range_hashes(prefix, every, every + gram)
            least = _sliding_minimum(grams, width)
            key = K.mix(least[place] + K.mix(least[place + length - gram + 1 - width] + K.U64(1)))
            key = K.mix(key ^ K.mix(np.asarray(batch.column("h")).view(np.uint64)[owner]))
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
            first, which, begins = np.flatnonzero(new), np.cumsum(new) - 1, grams[place]
            size = np.diff(np.append(first, len(key))) + length - 1
            order = np.lexsort((begins, which))
            same = (which[order][1:] == which[order][:-1]) & (begins[order][1:] == begins[order][:-1])
            inner = np.zeros(len(first), bool)
            inner[which[order][1:][same]] = True
            data = memoryview(np.ascontiguousarray(raw))
            c = K.content_hashes(data[a:b] for a, b in zip(place[first].tolist(), (place[first] + size).tolist(), strict=True))
            some, times, spans = _gathered(owner[first], K.mix(key[first]) ^ c, start[first], size)
            chosen = first[some]
            of = pa.array(owner[chosen])
            pieces = [bytes(data[a:b]) for a, b in zip(place[chosen].tolist(), (place[chosen] + size[some]).tolist(), strict=True)]
            own = np.asarray(batch.column("m"))[owner[chosen]]
            arrays = [_as_signed(key[chosen]), batch.column("id0").take(of), batch.column("d").take(of), pa.array(start[chosen]), pa.array(own * times), pa.array(pieces, pa.binary())]
            yield pa.RecordBatch.from_arrays([*arrays, _as_signed(c[some]), pa.array(inner[some]), pa.array(own), spans], names=[*_PART, "c", "inner", "own", "spans"])

    return parts.select(*_PART).mapInArrow(run, f"{_PARTS}, c bigint, inner boolean, own bigint, spans {_SPANS}")


def _whole_windows(parts: DataFrame, length: int) -> DataFrame:
    """As :func:`_expand_batches`, window by window: those whose bytes have the same hash as another one's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches, "data", limit=K.SLICE_BYTES // 16):
            raw, owner, place, start = _windows_of(batch, length)
            data = memoryview(np.ascontiguousarray(raw))
            hashed = K.content_hashes(data[i : i + length] for i in place.tolist())
            some, times, spans = _gathered(owner, hashed, start, np.full(len(owner), length))
            of = pa.array(owner[some])
            own = np.asarray(batch.column("m"))[owner[some]]
            yield pa.RecordBatch.from_arrays([_as_signed(hashed[some]), batch.column("id0").take(of), batch.column("d").take(of), pa.array(own), pa.array(own * times), spans], names=["k", "id0", "d", "own", "m", "spans"])

    every = parts.select(*_PART).mapInArrow(run, f"k bigint, id0 bigint, d bigint, own bigint, m bigint, spans {_SPANS}")
    again = every.groupBy("k").agg(F.sum("m").alias("total")).where("total > 1").select("k")
    return every.where("own = 1").join(dealt_anew(again, "k").hint("merge"), "k", "left_semi").select("id0", "d", "spans")


def _hot_ranges(parts: DataFrame, length: int, used: list[DataFrame]) -> DataFrame:
    """As :func:`_expand_batches`, for hashes with more segments than a batch may hold; tables cut on the way are put in
    ``used``."""
    ranges = []
    for width in ENDS:
        runs = cut(_split(parts, length, width))
        kinds = runs.groupBy("h", "c").agg(F.sum("m").alias("m"), F.bool_or("inner").alias("inner"), F.min(F.struct("id0", "d", "start", "data")).alias("x"))
        kinds = cut(kinds.select("h", "c", "m", "inner", "x.*"))
        same = runs.where("own = 1").join(kinds.where("m > 1").select("h", "c").hint("merge"), ["h", "c"], "left_semi")
        ranges.append(same.select("id0", "d", "spans"))
        open_ = F.count_if(F.expr("m = 1")).alias("single"), F.count(F.lit(1)).alias("kinds"), F.bool_or("inner").alias("inner_any")
        sizes = kinds.groupBy("h").agg(F.sum(F.octet_length("data")).alias("bytes"), *open_).where("single > 0 AND (kinds > 1 OR inner_any)")
        left = cut(kinds.join(dealt_anew(sizes, "h").hint("merge"), "h").select(*_PART, "bytes"))
        used += [runs, kinds, left]
        ranges.append(_expand_batches(left.where(F.col("bytes") <= HOT_BYTES), length))
        parts = left.where(F.col("bytes") > HOT_BYTES).select(*_PART)
        if parts.isEmpty():
            break
    else:
        ranges.append(_whole_windows(parts, length))
    return reduce(DataFrame.union, ranges)


def _fetch(texts: DataFrame, length: int) -> DataFrame:
    """(h, id0, d, start, m, hot, data): the bytes of each segment wanted, from rows with a text and ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for id0, d, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("id0", "d", "text", "wanted")), strict=True):
                data = text.encode() if wanted else b""
                for w in wanted or ():
                    piece = data[w["start"] : w["start"] + w["n"] + length - 1]
                    for column, value in zip(out, (w["h"], id0, d, w["start"], w["m"], w["hot"], piece), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=["h", "id0", "d", "start", "m", "hot", "data"])

    return texts.select("id0", "d", "text", "wanted").mapInArrow(run, "h bigint, id0 bigint, d bigint, start bigint, m bigint, hot boolean, data binary")


def merged(ranges: list[dict]) -> list[tuple[int, int]]:
    """Sorted, joined byte ranges."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["a"], r["b"]) for r in ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def whole_characters(data: bytes, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The ranges shrunk to whole UTF-8 characters, so that what is left is text."""
    out = []
    for a, b in ranges:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _spans(docs: DataFrame, length: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(fingerprints of all rows, texts that may have repeats, (id0, d, text, ranges) of those that do); the first two are
    cut, and may be dropped once nothing reads them."""
    unique = unique_ids(docs)
    every = cut(fingerprint(docs, length, unique))
    runs = every.select("id0", "d", F.explode("segments").alias("s")).select("id0", "d", "s.*")
    again = runs.groupBy("h").agg(F.count(F.lit(1)).alias("k"), F.bool_or("inner").alias("inner")).where("k > 1 OR inner").select("h")
    rows = cut(runs.join(dealt_anew(again, "h").hint("merge"), "h", "left_semi"))
    sweep(docs.sparkSession)
    kinds = rows.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"), F.bool_or("inner").alias("inner"), F.min(F.struct("id0", "d", "start", "n")).alias("x"))
    kinds = cut(kinds.select("h", "c", "m", "inner", "x.*"))

    # One kind of segment that occurs twice is an interval that needs no expansion: its weight says that it repeats.
    hashes = kinds.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.bool_or("inner").alias("inner"), F.sum(F.col("n") + (length - 1)).alias("bytes")).where("kinds > 1 OR inner")
    hashes = hashes.select("h", (F.col("bytes") > HOT_BYTES).alias("hot"))
    asked = kinds.join(dealt_anew(hashes, "h").hint("merge"), "h").select("id0", "d", F.struct("h", "m", "start", "n", "hot").alias("asked"))
    here = rows.select("id0", "d", F.lit(None).cast(asked.schema["asked"].dataType).alias("asked")).distinct()
    lists = asked.union(here).groupBy("id0", "d").agg(F.collect_list("asked").alias("wanted"))
    texts = cut(_with_digest(docs, unique).join(lists.hint("merge"), ["id0", "d"]))
    once = texts
    if not unique and not every.groupBy("id0", "d").count().where("count > 1").isEmpty():
        once = texts.dropDuplicates(["id0", "d"])  # rows that are the same in id and text are asked once
    parts = cut(_fetch(once, length))
    sweep(docs.sparkSession)
    ranges = _expand_batches(parts.where("NOT hot"), length)
    hot = parts.where("hot").drop("hot")
    used: list[DataFrame] = [rows, kinds, parts]
    if not hot.isEmpty():
        ranges = ranges.union(_hot_ranges(hot, length, used))
    same = rows.join(kinds.where("m > 1").select("h", "c").hint("merge"), ["h", "c"], "left_semi")
    span = F.struct(F.col("start").alias("a"), (F.col("start") + F.col("n") + (length - 1)).alias("b"))
    whole = same.select("id0", "d", F.array(span).alias("spans"))
    ranges = cut(whole.union(ranges).groupBy("id0", "d").agg(F.flatten(F.collect_list("spans")).alias("ranges")))
    drop(*used)
    sweep(docs.sparkSession)
    return every, texts, texts.select("id0", "d", "text").join(ranges.hint("merge"), ["id0", "d"])


def _with_digest(docs: DataFrame, unique: bool) -> DataFrame:
    """``docs`` (doc_id, text) as (id0, d, text), without null texts."""
    if unique:
        return docs.where("text IS NOT NULL").select(F.coalesce("doc_id", F.lit(-1)).alias("id0"), F.lit(0).cast("bigint").alias("d"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            digest, _ = _digests(*K.buffers(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").fill_null(-1), _as_signed(digest), batch.column("text")], names=["id0", "d", "text"])

    return docs.where("text IS NOT NULL").select("doc_id", "text").mapInArrow(run, "id0 bigint, d bigint, text string")


def repeat_report(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    slim = docs.select(F.col(K.quoted(doc_id)).cast("bigint").alias("doc_id"), F.col(K.quoted(text)).alias("text"))
    every, texts, hit = _spans(slim, length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            removed, spans, sha = [], [], []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data, gone = text.encode(), merged(ranges)
                removed.append(sum(b - a for a, b in gone))
                spans.append(len(gone))
                edges = [0, *(x for r in gone for x in r), len(data)]
                sha.append(hashlib.sha256(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id0"), batch.column("d"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha)], names=["id0", "d", "n_removed", "n_spans", "kept"]
            )

    changed = cut(hit.mapInArrow(run, "id0 bigint, d bigint, n_removed bigint, n_spans bigint, kept string").dropDuplicates(["id0", "d"]))
    drop(texts)
    sweep(docs.sparkSession)
    out = every.drop("segments").join(changed, ["id0", "d"], "left")
    counts = [F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_removed", "n_spans")]
    return out.select("doc_id", "n_bytes", *counts, F.coalesce("kept", "sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """``docs`` (with doc_id and text) without the repeated bytes; n_chars follows, other columns stay.

    Of a character of several bytes, all go or none: spans are shrunk to whole characters.
    """
    slim = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    every, texts, hit = _spans(slim, length)
    drop(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in K.slices(batches):
            kept = []
            for text, ranges in zip(batch.column("text").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
                data = text.encode()
                edges = [0, *(x for r in whole_characters(data, merged(ranges)) for x in r), len(data)]
                kept.append(b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode())
            yield pa.RecordBatch.from_arrays([batch.column("id0"), batch.column("d"), pa.array(kept, pa.string())], names=["id0", "d", "kept"])

    id0, d, new = (K.unused(c, docs.columns) for c in ("id0", "d", "kept"))
    changed = cut(hit.mapInArrow(run, "id0 bigint, d bigint, kept string")).dropDuplicates(["id0", "d"]).toDF(id0, d, new)
    drop(texts)
    sweep(docs.sparkSession)

    if unique_ids(slim):
        marked = docs.withColumns({id0: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)), d: F.lit(0).cast("bigint")})
    else:
        marked = docs.withColumn(id0, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-1)))
        marked = K.with_columns_of(marked, "text", [StructField(d, LongType())], lambda batch, held: [_as_signed(_digests(*K.buffers(batch.column(held)))[0])])
    out = marked.join(changed.hint("merge"), [id0, d], "left")
    text = {f.name.lower(): f.name for f in docs.schema}["text"]
    values = {text: F.coalesce(F.col(new), F.col("text"))}
    for f in docs.schema:
        if f.name.lower() == "n_chars":
            values[f.name] = F.when(F.col(new).isNull(), F.col(f.name)).otherwise(F.length(new)).cast(f.dataType)
    return out.select(*(values[c].alias(c) if c in values else F.col(K.quoted(c)) for c in docs.columns))
