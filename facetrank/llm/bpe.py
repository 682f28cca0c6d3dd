"""Byte-level BPE encoding and decoding by prefix dynamic programming.

For each byte prefix of a piece there is exactly one token that the encoding of that prefix can end in. Storing it for
every prefix gives the encoding by walking back from the end, lets bytes be appended exactly (only the new prefixes
are computed), and after an edit only the prefixes from the edit on are computed again. Which token ends a prefix is
found by trying the tokens that are suffixes of it: a token fits if the token stored for the prefix before it stays
beside it, that is if encoding the two together gives back the two.

Texts are cut where a run of white space begins, which no match of the pattern crosses; distinct cuts are encoded once
per worker and kept.

Defined cases: a null or empty text has no ids; repeated rows are encoded row by row; bytes that no token covers raise
an error (the rank files used here have all 256 single bytes); an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.llm import text as K
from facetrank.llm.packing import LONGEST_KEY, Recent, tokenizer_path
from facetrank.sources.session import prepare

#: Cuts, pieces and pairs of tokens that a worker keeps.
CACHE_CUTS = 1_000_000
CACHE_PIECES = 800_000
CACHE_PAIRS = 1_000_000
#: White space as Unicode has it (fixed values).
SPACE = "\t-\r \x85\xa0  -     　"
CUT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

#: Token lengths to try where no longer token can end.
SHORT = (3, 2)


class PrefixTable:
    """The last token of every byte prefix of one piece; bytes can be appended and edited."""

    def __init__(self, bpe: Bpe, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(data)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.fill(self.data, self.last)

    def edit(self, start: int, stop: int, new: bytes) -> None:
        """Replace a byte range; prefixes that end before it are kept."""
        tail = self.data[stop:]
        del self.last[start:]
        self.data = self.data[:start]
        self.append(new + tail)

    def ids(self, length: int | None = None) -> list[int]:
        """The ids of the piece, or of its prefix of so many bytes."""
        at, out = len(self.data) if length is None else length, []
        while at:
            token = self.last[at - 1]
            out.append(token)
            at -= len(self.bpe.tokens[token])
        return out[::-1]


class Bpe:
    """Ranks and the pattern that splits texts into pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.tokens: dict[int, bytes] = {v: k for k, v in ranks.items()}
        self.pattern = regex.compile(pattern.replace(r"[^\s", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]"))
        #: Lengths of the tokens that end in four given bytes (or in fewer, for shorter tokens), longest first.
        ends: dict[bytes, set[int]] = {}
        for token in ranks:
            if len(token) > 3:
                ends.setdefault(token[-4:], {3, 2}).add(len(token))
        self.ends = {k: sorted(v, reverse=True) for k, v in ends.items()}
        self.halves: dict[int, tuple[int, int]] = {}
        self.edges: dict[tuple[int, bool], list[tuple[bytes, int, int]] | None] = {}
        self.fits: dict[tuple[int, int], bool] = {}
        self.cuts, self.pieces = Recent(CACHE_CUTS), Recent(CACHE_PIECES)
        size = max(self.tokens) + 1
        self.width = np.zeros(size, np.int64)
        for k, v in self.tokens.items():
            self.width[k] = len(v)
        self.begin = np.concatenate([[0], np.cumsum(self.width)])[:-1]
        self.all_bytes = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def fill(self, data: bytes, last: list[int]) -> None:
        """Extend ``last`` to every prefix of ``data``."""
        ranks, ends, tokens, fits = self.ranks, self.ends, self.tokens, self.fits
        for stop in range(len(last) + 1, len(data) + 1):
            found = -1
            for length in ends.get(data[stop - 4 : stop], SHORT) if stop > 3 else SHORT:
                if length > stop:
                    continue
                token = ranks.get(data[stop - length : stop])
                if token is None:
                    continue
                if length == stop:
                    if self.whole(token):
                        found = token
                        break
                    continue
                pair = (last[stop - length - 1], token)
                fit = fits.get(pair)
                if fit is None:
                    fit = self.beside(*pair)
                if fit:
                    found = token
                    break
            last.append(found if found >= 0 else ranks[data[stop - 1 : stop]])

    def merged(self, data: bytes) -> list[int]:
        """Ids of a short byte string by its merges in turn, lowest rank first (used on pairs of tokens only)."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def split(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge gives ``token``; twice itself for a token that no merge gives."""
        known = self.halves.get(token)
        if known is None:
            data, known = self.tokens[token], (token, token)
            if len(data) > 1:
                parts = [data[i : i + 1] for i in range(len(data))]
                while len(parts) > 2:
                    best, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
                    if best >= token:
                        break
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                if len(parts) == 2:
                    known = (self.ranks[parts[0]], self.ranks[parts[1]])
            self.halves[token] = known
        return known

    def whole(self, token: int) -> bool:
        """Whether a piece of just this token's bytes is encoded as the token."""
        return len(self.tokens[token]) == 1 or self.split(token) != (token, token) or self.merged(self.tokens[token]) == [token]

    def spine(self, token: int, right: bool) -> list[tuple[bytes, int, int]] | None:
        """What stands at one edge of a token while it is being merged: (bytes, rank it appears at, rank it goes at)."""
        known = self.edges.get((token, right), 0)
        if known == 0:
            known, goes, at = [], 1 << 60, token
            while True:
                data = self.tokens[at]
                known.append((data, at if len(data) > 1 else -1, goes))
                if len(data) == 1:
                    break
                halves = self.split(at)
                if halves == (at, at):
                    known = None
                    break
                goes, at = at, halves[right]
            self.edges[token, right] = known
        return known

    def beside(self, left: int, right: int) -> bool:
        """Whether the bytes of the two tokens together are encoded as the two.

        They are unless some merge crosses the boundary: a pair that stands at it at the same time and has a rank at
        which neither is gone. Of equal ranks the leftmost goes first.
        """
        before, after = self.spine(left, True), self.spine(right, False)
        if before is None or after is None:
            fit = self.merged(self.tokens[left] + self.tokens[right]) == [left, right]
        else:
            fit, ranks = True, self.ranks
            for a, a_from, a_to in before:
                for b, b_from, b_to in after:
                    if a_from <= b_to and b_from < a_to and (rank := ranks.get(a + b)) is not None and rank < a_to and rank <= b_to:
                        fit = False
                        break
                if not fit:
                    break
        if len(self.fits) > CACHE_PAIRS:
            self.fits.clear()
        self.fits[left, right] = fit
        return fit

    def piece(self, data: bytes) -> list[int]:
        token = self.ranks.get(data)
        if token is not None:  # a rank file's reader takes a piece that is a token as it is
            return [token]
        return PrefixTable(self, data).ids()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [CUT.findall(t) for t in texts]
        new = {c: self.pattern.findall(c) for c in self.cuts.missing(set().union(*split))}
        fresh = self.pieces.missing(set().union(*new.values()))
        for piece in fresh:
            ids = self.piece(piece.encode())
            self.pieces.young[piece] = struct.pack(f"<{len(ids)}I", *ids)
        cuts, pieces = self.cuts.young, self.pieces.young
        for c, found in new.items():
            cuts[c] = pieces[found[0]] if len(found) == 1 else b"".join([pieces[p] for p in found])
        out = [b"".join(map(cuts.__getitem__, some)) for some in split]
        for held, used in ((cuts, new), (pieces, fresh)):
            for key in [k for k in used if len(k) > LONGEST_KEY]:
                del held[key]
        return out

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        width = self.width[found]
        stop = np.cumsum(width)
        at = np.arange(stop[-1] if len(stop) else 0) + np.repeat(self.begin[found] - stop + width, width)
        return self.all_bytes[at].tobytes()


def load(ranks: str, pattern: str | None = None) -> Bpe:
    """From a rank file: a path, or the name of a public vocabulary."""
    import base64

    import public_tokenizers

    with open(tokenizer_path(ranks), "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return Bpe(table, pattern or public_tokenizers.PATTERN)


def encode(docs: DataFrame, *, ranks: str, pattern: str | None = None, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256[, ids array<int>]."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = K.worker_cache(f"bpe {ranks} {pattern}", lambda: load(ranks, pattern))
        for batch in K.slices(batches, using=f"bpe {ranks} {pattern}"):
            n, digest, decoded, kept = [], [], [], []
            for ids in bpe.encode_all([t or "" for t in batch.column("text").to_pylist()]):
                n.append(len(ids) // 4)
                digest.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
                if with_ids:
                    kept.append(np.frombuffer(ids, "<u4").astype(np.int32))
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(decoded, pa.string())]
            if with_ids:
                arrays.append(pa.array(kept, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(arrays)])

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return slim.mapInArrow(run, schema)


def decode(rows: DataFrame, *, ranks: str, ids: str = "ids", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, data binary): the bytes that each row's ids stand for; null ids give null."""
    prepare(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = K.worker_cache(f"bpe {ranks} None", lambda: load(ranks))
        for batch in batches:
            out = [None if x is None else bpe.decode(np.array(x, "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], names=["doc_id", "data"])

    return rows.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id bigint, data binary")
