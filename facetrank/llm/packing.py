"""Best-fit packing of token sequences by minimum bin slack.

Documents are tokenised (words are encoded once per worker and kept), cut into pieces no longer than a sequence, and
dealt into groups of a fixed number of pieces. In a group, each bin is opened with the longest piece left;
a bitset of reachable sums over the lengths still available then gives the fullest combination that fits beside it,
and that combination leaves the group. Only lengths and ids are dealt, never tokens.

Defined cases: a null or empty text is the closing id alone; a null id is packed like any other; repeated rows are
packed once per row; an empty table gives an empty result; a document longer than a sequence is cut at multiples of
the capacity and only its last piece may be shorter.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from operator import neg

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from facetrank.llm import text as K
from facetrank.sources.session import cut, prepare

CAPACITY = 2048
#: Pieces in a group; the last bin of a group is the one that may stay open.
GROUP_PIECES = 2500
#: A task packs one group, or several once there would be more tasks than this; it holds this many pieces at most.
MANY_TASKS, TASK_PIECES = 2000, 1_000_000
#: Words, and bare words, whose ids a worker keeps.
CACHE_WORDS = 300_000
#: Bytes of the longest key that stays in the worker; others are encoded where they occur.
LONGEST_KEY = 128
#: Marks that compose with the letter before them.
MARKS = "[\u0300-\u036f]"
#: Never the beginning of a contraction, so a cut beside these is one that the vocabulary's pattern makes.
LAST_LATIN = "\u024f"
PUNCTUATION = b'.,;:!?#*$%&|<>()"'
END_ID = 0


def tokenizer_path(name: str) -> str:
    """Where a vocabulary file lies on this machine."""
    import os

    import public_tokenizers

    return name if os.path.isabs(name) else public_tokenizers.path(name)


class Recent:
    """About the last ``size`` keys asked for: a young dict, and an old one that goes when the young one is full."""

    def __init__(self, size: int):
        self.half, self.young, self.old = size // 2, {}, {}

    def missing(self, keys: set) -> list:
        """Those keys that aren't held; the others are in ``young`` from now on."""
        if len(self.young) > self.half:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        out = []
        for key in keys.difference(young):
            value = old.get(key)
            if value is None:
                out.append(key)
            else:
                young[key] = value
        return out


class WordEncoder:
    """Ids of whole texts, by encoding each distinct word once.

    The vocabulary's rules drop white space and never join across it, so a text's ids are those of its words in turn.
    A word is also cut between punctuation at its ends and a letter or digit, where the rules always cut, so that the
    bare word is what is encoded and kept. Bare words of Latin letters are lower-cased first, as the rules do (none of
    these letters composes with another, and each has one lower-case letter). The rules leave a word of such lower-case
    letters as it is and whole, so it goes to the merges without them.
    """

    def __init__(self, vocabulary: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(vocabulary))
        #: Written-out special tokens stand for themselves, across words if need be: texts that hold one (or what would be
        #: one in lower case) are encoded whole.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words, self.parts = Recent(CACHE_WORDS), Recent(CACHE_WORDS)
        #: The same merges for words of lower-case Latin letters, on which the other rules have no effect.
        rules = json.loads(self.tokenizer.to_str())
        types = [[x["type"] for x in (rules[k] or {}).get(of, [])] for k, of in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        self.merges = self.tokenizer
        if types == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]]:
            self.merges = Tokenizer.from_str(json.dumps(rules | {"normalizer": None, "pre_tokenizer": rules["pre_tokenizer"]["pretokenizers"][1]}))

    @staticmethod
    def cut(word: bytes) -> tuple[bytes, ...]:
        if word.isalnum():
            return (word,)
        bare = word.strip(PUNCTUATION)
        if bare.isascii():
            if not (bare[:1].isalnum() and bare[-1:].isalnum()):
                return (word,)
            low = bare
        else:
            text = bare.decode()
            small = text.lower()
            if not (small[0].isalpha() and small[-1].isalpha()):
                return (word,)
            low = small.encode() if max(text) <= LAST_LATIN and "\u0130" not in text else bare
        if len(bare) == len(word):
            return (low,)
        at = word.index(bare)
        return tuple(x for x in (word[:at], low, word[at + len(bare) :]) if x)

    def known(self, distinct: list[bytes], longest: int) -> list[bytes]:
        """Ids of each of some distinct words, as little-endian 32-bit integers; ``longest`` is their greatest length."""
        cut = self.cut
        cuts = {w: cut(w) for w in self.words.missing(set(distinct))}
        new = self.parts.missing(set().union(*cuts.values()))
        words, parts = self.words.young, self.parts.young
        for start in range(0, len(new), 4096):
            some = {p: p.decode() for p in new[start : start + 4096]}
            plain = {p: x for p, x in some.items() if x.isalpha() and x.islower() and (x.isascii() or max(x) <= LAST_LATIN)}
            for tokenizer, held in ((self.merges, plain), (self.tokenizer, {p: x for p, x in some.items() if p not in plain})):
                found = [x.ids for x in tokenizer.encode_batch_fast(list(held.values()), add_special_tokens=False)] if held else []
                flat = np.array([i for ids in found for i in ids], "<u4").tobytes()
                at = 0
                for part, ids in zip(held, found, strict=True):
                    parts[part] = flat[at : (at := at + 4 * len(ids))]
        for word, pieces in cuts.items():
            words[word] = parts[pieces[0]] if len(pieces) == 1 else b"".join([parts[p] for p in pieces])
        out = [words[w] for w in distinct]
        if longest > LONGEST_KEY:
            for held, used in ((words, cuts), (parts, new)):
                for key in used:
                    if len(key) > LONGEST_KEY:
                        del held[key]
        return out

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, first of each text and the end)."""
        whole = np.zeros(len(texts), bool)
        for content in self.special:
            whole |= np.asarray(pc.match_substring(texts, content, ignore_case=True).fill_null(False))
        # ASCII letters are lower-cased first, as the rules do, but not before marks that may compose with a letter.
        whole |= np.asarray(pc.match_substring_regex(texts, MARKS).fill_null(False))
        if not whole.any():
            return self.plain_ids(pc.ascii_lower(texts))
        flat, first = self.plain_ids(pc.ascii_lower(pc.if_else(pa.array(whole), "", texts)))
        parts = [flat[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
        for i in np.flatnonzero(whole):
            parts[i] = np.array(self.tokenizer.encode(texts[int(i)].as_py(), add_special_tokens=False).ids, "<u4")
        return np.concatenate(parts), np.cumsum([0, *map(len, parts)])

    def plain_ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without special tokens, in lower case."""
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        first = np.asarray(split.offsets).astype(np.int64)
        coded = split.flatten().dictionary_encode()
        index = np.asarray(coded.indices)
        distinct = coded.dictionary.cast(pa.binary())
        held = self.known(distinct.to_pylist(), pc.max(pc.binary_length(distinct)).as_py() or 0)
        size = np.array([len(x) for x in held], np.int64) // 4
        begin = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(held), "<u4")
        length = size[index]
        end = np.cumsum(length)
        total = int(end[-1]) if len(end) else 0
        out = flat[np.arange(total) + np.repeat(begin[index] - end + length, length)]
        return out, np.concatenate([[0], end])[first - first[0]]


def tokenize(docs: DataFrame, *, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of every piece of every row of ``docs`` (doc_id, text)."""
    prepare(docs.sparkSession)
    end = np.array([END_ID], "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = K.worker_cache(f"words {vocabulary}", lambda: WordEncoder(vocabulary))
        for batch in K.slices(batches, limit=8 * K.SLICE_BYTES, using=f"words {vocabulary}"):
            flat, first = encoder.ids(batch.column("text"))
            rows: list[list] = [[], [], [], [], []]
            pieces = []
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = flat[first[i] : first[i + 1]]
                for piece, at in enumerate(range(0, len(ids) + 1, capacity)):
                    part = ids[at : at + capacity]
                    if len(part) < capacity:
                        part = np.concatenate([part, end])
                    for column, value in zip(rows, (doc, piece, at, len(part), zlib.crc32(part)), strict=True):
                        column.append(value)
                    if with_ids:
                        pieces.append(part.astype(np.int32))
            arrays = [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(x, pa.int64()) for x in rows[2:])]
            if with_ids:
                arrays.append(pa.array(pieces, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(arrays)])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fullest(lengths: list[int], stock: dict[int, list[int]], room: int) -> list[int]:
    """The multiset of ``lengths`` (longest first, each at most as often as in stock) with the largest sum up to ``room``.

    Bit s of the bitset says that some combination has the sum s. Lengths are added one copy at a time until the room
    is filled exactly; the steps are then walked back.
    """
    mask, full, sums, steps = (1 << (room + 1)) - 1, 1 << room, 1, []
    for k in range(bisect_left(lengths, -room, key=neg), len(lengths)):
        length = lengths[k]
        for _ in range(min(len(stock[length]), room // length)):
            after = sums | (sums << length) & mask
            if after == sums:
                break
            steps.append((length, sums))
            sums = after
            if sums & full:
                break
        if sums & full:
            break
    best, chosen = sums.bit_length() - 1, []
    for length, before in reversed(steps):
        if best and not before >> best & 1:
            chosen.append(length)
            best -= length
    return chosen


def pack_lengths(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each length; bins are numbered from 0."""
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    stock: dict[int, list[int]] = {}
    for i in np.argsort(lengths, kind="stable")[::-1]:
        stock.setdefault(int(lengths[i]), []).append(int(i))
    order, number = sorted(stock, reverse=True), 0

    def take(length: int, used: int) -> int:
        i = stock[length].pop()
        bins[i], offsets[i] = number, used
        if not stock[length]:
            del stock[length]
            del order[bisect_left(order, -length, key=neg)]
        return used + length

    while order:
        used = take(order[0], 0)
        if used < capacity:
            for length in fullest(order, stock, capacity - used):
                used = take(length, used)
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (with doc_id, piece, length) with sequence_id and offset; columns of these names are replaced.

    Groups have about ``group_pieces`` pieces whatever the size of the table. Rows are dealt round robin, so that no id,
    source or length can make a task large, and put in an order that a task run again finds as well.
    """
    prepare(pieces.sparkSession)
    pieces = pieces.drop("sequence_id", "offset")
    n = pieces.count()
    tasks = max(1, min(-(-n // group_pieces), max(MANY_TASKS, -(-n // TASK_PIECES))))
    fields = [*pieces.schema.fields, StructField("sequence_id", LongType()), StructField("offset", LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        every = pa.Table.from_batches(held)
        groups = max(1, round(every.num_rows / group_pieces))
        edges = [every.num_rows * g // groups for g in range(groups + 1)]
        number = TaskContext.get().partitionId() << 40
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            rows = every.slice(a, b - a).combine_chunks()
            bins, offsets = pack_lengths(np.asarray(rows.column("length")), capacity)
            rows = rows.append_column("sequence_id", pa.array(bins + number)).append_column("offset", pa.array(offsets))
            number += int(bins.max()) + 1
            yield from rows.combine_chunks().to_batches(max_chunksize=10_000)

    order = [c for c, t in pieces.dtypes if t in ("int", "bigint")]
    return pieces.repartition(tasks).sortWithinPartitions(F.xxhash64(*order), *order).mapInArrow(run, StructType(fields))


def pack_documents(
    docs: DataFrame, *, vocabulary: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return pack(cut(tokenize(slim, vocabulary=vocabulary, capacity=capacity)), capacity=capacity, group_pieces=group_pieces)
