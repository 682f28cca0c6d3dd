"""The pipeline against plain versions of its stages."""

import sys
import zlib
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import brute

from facetrank.llm import secrets

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"


def plain(docs):
    docs = {i: t for i, t in docs.items() if not brute.quality(t)[5]}
    groups = brute.near_groups(docs, 5)
    docs = {i: t for i, t in docs.items() if groups[i] == i}
    ids = list(docs)
    out = {}
    for i, gone in zip(ids, brute.repeats([docs[i] for i in ids], 200), strict=True):
        at, text = 0, ""
        for c in docs[i]:
            n = len(c.encode())
            text += "" if gone[at : at + n].all() else c
            at += n
        out[i] = brute.redact(text, secrets.REDACTED, secrets.RULES)
    return out


def test_pipeline(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, text in plain(docs).items():
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048])) for n, at in enumerate(range(0, len(ids), 2048))]
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)


def test_stages_keep_columns(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "suffix_dedup", "secret_scan", "best_fit_packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).schema == docs.schema


NAMES = ["_rules", "_text", "_id", "rules", "whole_text", "id", "secret_spans", "n_words", "word_chars", "base_failed", "host", "salt", "_salt", "host_kept", "host_rate", "_id0", "id0", "d", "kept", "_row", "row", "a.b", "c`d", "SALT2", "label"]


def test_stages_leave_other_columns(spark):
    """Every value of columns whose names an operator might use itself; odd rows; one bad host, so that verdicts are joined."""
    import corpus_pipeline

    good = " ".join(f"w{i}" for i in range(40))
    rows = [(1, good, "s", 0), (2, good, "s", 1), (2, good + " x", "s", 2), (3, f"{good} token=abcdefghijklmnop", "t", 3), (None, good.replace("w", "v"), "t", 4), (4, None, "t", 5), (5, "", None, 6), (6, "é" * 300 + " " + good.replace("w", "q"), "s", 7), (7, "é" * 300 + " " + good.replace("w", "u"), "s", 8)]
    rows += [(100 + i, "short", "bad", 9 + i) for i in range(120)] + [(300, good.replace("w", "z"), "bad", 200)] + [(400 + i, " ".join(f"h{i}_{k}" for k in range(30)), f"host{i % 9}", 300 + i) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, number int")
    for k, name in enumerate(NAMES):
        docs = docs.selectExpr("*", f"concat('mine {k} ', number) AS `{name.replace('`', '``')}`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.cut(docs)
        out = corpus_pipeline.cut(stage(spark, docs, SF))
        assert out.schema == docs.schema, name
        got = out.collect()
        assert len(got) < len(rows) if name == "quality_rules" else got, name
        assert all(r[c] == f"mine {k} {r['number']}" for r in got for k, c in enumerate(NAMES)), name
        docs = out
    kept = {r["number"]: r["text"] for r in docs.collect()}
    assert 200 not in kept and 300 in kept and 4 in kept and not {1, 2, 5, 6, 9} & set(kept)
    assert kept[7].startswith("q0") and kept[8].startswith("u0")  # the space was part of the passage
    assert stage_pieces(spark, docs) == len(kept)


def stage_pieces(spark, docs):
    import corpus_pipeline

    return corpus_pipeline.STAGES[-1][1](spark, docs, SF).count()
