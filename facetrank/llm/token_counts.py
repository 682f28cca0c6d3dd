"""Token counts by dynamic programming over a trie of distinct pre-tokens.

A pre-token (a word with the mark of a word's begin) is divided into vocabulary pieces so that the sum of their unigram
scores is greatest. The distinct pre-tokens of a slice are inserted in a trie by sorting them: neighbours share their
longest common prefix, and a depth-first walk keeps the forward scores of the prefix that it stands on. So the score of
a shared prefix is computed once, and the count is stored where a pre-token ends. Counts are kept by the worker.

Scores are log probabilities of a Zipf distribution over the vocabulary's order, -log(rank + 2), as the files of public
vocabularies at hand give an order of pieces. A character that no piece covers counts as the bytes of its UTF-8 form,
each with a score under that of every piece. Of equal scores, fewer pieces win, then the longer last piece.

Defined cases: a null or empty text has no tokens; repeated rows are counted row by row; an empty table gives an empty
result; white space of any kind parts words and is not counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetrank.llm import text as K
from facetrank.llm.packing import Recent, tokenizer_path
from facetrank.sources.session import prepare

MARK = "▁"
CACHE_WORDS = 1_000_000


class Unigram:
    """Scores of pieces, and the best division of words."""

    def __init__(self, pieces: list[str]):
        self.score = {p: -math.log(i + 2) for i, p in enumerate(pieces) if p}
        #: Lengths of the pieces that end in a given character, and what a byte of an uncovered character costs.
        ends: dict[str, set[int]] = {}
        for p in self.score:
            ends.setdefault(p[-1], set()).add(len(p))
        self.ends = {k: sorted(v) for k, v in ends.items()}
        self.byte = -math.log(len(pieces) + 2) - 10
        self.known = Recent(CACHE_WORDS)

    def step(self, word: str, at: int, best: list[tuple[float, int]]) -> tuple[float, int]:
        """(score, -count) of the prefix that ends after character ``at``, from those of the shorter prefixes."""
        width = len(word[at].encode("utf-8", "surrogatepass"))
        score, count = best[at]
        top = (score + width * self.byte, count - width)
        for length in self.ends.get(word[at], ()):
            begin = at + 1 - length
            if begin < 0:
                break
            piece = self.score.get(word[begin : at + 1])
            if piece is not None:
                score, count = best[begin]
                top = max(top, (score + piece, count - 1))
        return top

    def counts(self, words: Iterable[str]) -> Iterator[tuple[str, int]]:
        """(word, tokens) of distinct words: a depth-first walk over their trie."""
        best: list[tuple[float, int]] = [(0.0, 0)]
        before = ""
        for word in sorted(words):
            same, most = 0, min(len(word), len(before))
            while same < most and word[same] == before[same]:
                same += 1
            del best[same + 1 :]
            for at in range(same, len(word)):
                best.append(self.step(word, at, best))
            before = word
            yield word, -best[-1][1]

    def all(self, words: list[str]) -> np.ndarray:
        new = self.known.missing(set(words))
        self.known.young.update(self.counts(new))
        return np.array([self.known.young[w] for w in words], np.int64)


def load(vocabulary: str) -> Unigram:
    """From a piece model file: a path, or the name of a public vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(vocabulary))
    size = model.get_piece_size()
    special = [model.is_control(i) or model.is_unknown(i) or model.is_byte(i) for i in range(size)]
    return Unigram(["" if special[i] else model.id_to_piece(i) for i in range(size)])


def count_tokens(docs: DataFrame, *, vocabulary: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_tokens."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = K.worker_cache(f"unigram {vocabulary}", lambda: load(vocabulary))
        for batch in K.slices(batches, limit=8 * K.SLICE_BYTES, using=f"unigram {vocabulary}"):
            split = pc.utf8_split_whitespace(batch.column("text").fill_null(""))
            first = np.asarray(split.offsets).astype(np.int64)
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_pylist()
            counts = model.all([MARK + w for w in words]) if words else np.empty(0, np.int64)
            full = np.array([bool(w) for w in words], bool)
            index, first = np.asarray(coded.indices), first - first[0]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(K.sums(full[index], first)), pa.array(K.sums((counts * full)[index], first))], names=["doc_id", "n_words", "n_tokens"]
            )

    slim = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "doc_id bigint, n_words bigint, n_tokens bigint")
