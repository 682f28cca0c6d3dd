"""Each operator against a plain version, with nulls, empty and long texts, ties, repeats, empty tables, other columns."""

import base64
import hashlib
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute

from facetrank.llm import bpe, components, minhash, packing, quality, secrets, sharding, suffix, token_counts, topk, urls

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
DOCS = "doc_id bigint, text string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    """Real documents, and odd rows under ids from a million on."""
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    odd = ["a" * 1000, None, "", "ab" * 300, "x" * 199, "é" * 150, " \n\t ", "w" * 200, "w" * 201, "one", "one two", "ONE two", LONG, 'token = "abcdefghijklmnop" AKIA' + "Q" * 16, "hello world " * 40, "hello world " * 40]
    more = [(10**6 + i, t, None if i % 2 else "src0") for i, t in enumerate(odd)] + [(10**6, "a" * 1000, "src0")]
    return rows.union(spark.createDataFrame(more, DOCS)).withColumns({c: F.lit("mine") for c in ("kept", "n_words", "offset", "slot", "_rules", "b")}).cache()


def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(rows):
    return sorted(rows, key=str)


def test_quality(spark, docs):
    got = quality.quality_rules(docs).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert key((r["doc_id"], *(r[n] for n in names)) for r in got) == key((r["doc_id"], *brute.quality(r["text"])) for r in docs.collect())
    assert all(r["kept"] == (not r["base_failed"]) for r in got)  # no host here fails almost always
    assert quality.quality_rules(empty(spark)).count() == 0
    assert quality.keep_good(docs).columns == docs.columns


def test_bad_host(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, "short" if i < 99 else good, "bad") for i in range(100)] + [(1000 + h * 100 + i, "short" if i == 0 else good, f"h{h}") for h in range(20) for i in range(50)]
    judged = {r["doc_id"]: r["kept"] for r in quality.quality_rules(spark.createDataFrame(rows, DOCS)).collect()}
    assert not judged[99] and judged[1001] and not judged[1000]
    kept = {r["doc_id"] for r in quality.keep_good(spark.createDataFrame(rows, DOCS)).select("doc_id").collect()}
    assert kept == {i for i, k in judged.items() if k}


def test_near_duplicates(spark, docs):
    rows = docs.dropDuplicates(["doc_id"])
    texts = {r["doc_id"]: r["text"] for r in rows.collect()}
    got = {r["doc_id"]: r for r in minhash.near_duplicates(rows, shingle=2).collect()}
    want = brute.near_groups(texts, 2)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["n_shingles"] == len(brute.shingles(texts[i], 2)) and r["kept"] == (want[i] == i) for i, r in got.items())
    assert minhash.near_duplicates(docs.union(docs), shingle=2).where("NOT kept").select("doc_id").distinct().count() == sum(not r["kept"] for r in got.values())
    assert minhash.near_duplicates(empty(spark)).count() == 0
    assert minhash.near_duplicates(spark.createDataFrame([(None, "a b c", "s"), (None, "a b c", "s")], DOCS)).count() == 2


def test_near_chain_and_hot_group(spark):
    """Links that only pass through others, and a group larger than the blocks it is compared in."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(60)]
    rows, now = [], list(base)
    for i in range(40):  # each differs a little from the one before
        rows.append((i, " ".join(now), "s"))
        now = list(now)
        now[rng.randrange(60)] = f"x{i}"
    for i in range(200):
        words = list(base)
        for _ in range(rng.randint(0, 6)):
            words[rng.randrange(60)] = f"y{rng.randrange(1000)}"
        rows.append((100 + i, " ".join(words), "s"))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2).collect()}
    assert got == brute.near_groups({i: t for i, t, _ in rows}, 2)


def test_near_large_groups(spark):
    """2,000 near copies, as many that are alike but not linked, and pairs among those; no step may grow with pairs."""
    rng = random.Random(6)
    base, other = [f"w{i}" for i in range(80)], [f"t{i}" for i in range(60)]
    rows = []
    for i in range(2000):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(80)] = f"y{rng.randrange(100_000)}"
        rows.append((i, " ".join(words), "s"))
    for i in range(600):
        words = other + [f"z{i // 2}_{k}" for k in range(24)]
        if i % 2:
            words[rng.randrange(84)] = "changed"
        rows.append((5000 + i, " ".join(words), "s"))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2).collect()}
    assert got == brute.near_groups({i: t for i, t, _ in rows}, 2)


def test_near_blocks(spark, monkeypatch):
    """What rounds leave open, in blocks smaller than the group."""
    monkeypatch.setattr(minhash, "ROUNDS", 1)
    rows = [(i, " ".join([f"t{k}" for k in range(60)] + [f"z{i // 2}_{k}" for k in range(24)] + ["odd"] * (i % 2)), "s") for i in range(120)]
    table = spark.createDataFrame(rows, DOCS)
    reps = minhash.signatures(table, 2).withColumnRenamed("doc_id", "id")
    members = minhash._bucket_members(reps, minhash.POSITIONS, minhash.CHUNK, minhash.ERRORS)
    sets = minhash.full_sets(table, members, 2)
    found, still = minhash.link_by_rounds(members, reps, sets, minhash.POSITIONS, 80)
    links = minhash.confirm_across(still, sets, 80, block=16)
    both = minhash.components(links.union(found.select("node", "component")))
    assert {r["node"]: r["component"] for r in both.collect()} == {i: i - i % 2 for i in range(120)}


def test_components(spark):
    """One task for few links, rounds for more, rounds until few are left: all as a walk over the links finds."""
    rng = random.Random(7)
    links = [(5, 5), (9, 3), (9, 3), *((i, i + 1) for i in range(1000, 1060)), *((2000, 2001 + i) for i in range(40)), *((rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(120))]
    near = {}
    for a, b in links:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = {}
    for start in sorted(near):
        todo = [] if start in want else [start]
        while todo:
            x = todo.pop()
            if want.setdefault(x, start) == start:
                todo += near[x] - want.keys()
    table = spark.createDataFrame(links, "u bigint, v bigint").repartition(7)
    for local in (0, 150, components.LOCAL_LINKS):
        rows = components.components(table, local=local).collect()
        assert len(rows) == len(want) and {r["node"]: r["component"] for r in rows} == want
    assert components.components(table.where("u = v")).count() == components.components(table.limit(0), local=0).count() == 0


def test_components_tasks(spark):
    """Few links cost a few stages, however many partitions a shuffle has."""
    sc = spark.sparkContext
    table = spark.createDataFrame([(i, i + 1) for i in range(100)], "u bigint, v bigint")
    sc.setJobGroup("few links", "")
    components.components(table)
    sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = sc.statusTracker().getJobIdsForGroup("few links")
    assert jobs and sum(len(sc.statusTracker().getJobInfo(j).stageIds) for j in jobs) <= 6


def test_near_one_id_on_several_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, "s"), (5, a, "s"), (5, b, "s"), (9, b + " more", "s"), (7, c, "s"), (2, c, "s"), (2, None, "s"), (None, a, "s")]
    got = {(r["doc_id"], r["component_id"]) for r in minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=2).collect()}
    want = brute.near_groups([(i, t) for i, t, _ in rows if i is not None], 2)
    assert got - {(None, None)} == set(want.items()) == {(1, 1), (5, 1), (9, 1), (7, 2), (2, 2)}


def thue_morse(n: int, one: str, two: str) -> str:
    return "".join(two if bin(i).count("1") % 2 else one for i in range(n))


def test_patterned_words(spark):
    """Words that a polynomial hash modulo a power of two can't tell apart."""
    x, y = thue_morse(2048, "a", "b"), thue_morse(2048, "b", "a")
    rows = [(1, f"one {x} two", "s"), (2, f"one {y} two", "s"), (3, " ".join([x] * 8 + [y] * 8 + ["pad"] * 8), "s"), (4, " ".join([*"abcdefg", x, *"abcdefg", y, *map(str, range(20))]), "s")]
    table = spark.createDataFrame(rows, DOCS)
    near = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(table, shingle=2).collect()}
    assert near == brute.near_groups({i: t for i, t, _ in rows}, 2) == {1: 1, 2: 2, 3: 3, 4: 4}
    judged = {r["doc_id"]: r["n_repeat_words"] for r in quality.quality_rules(table).collect()}
    assert judged == {i: brute.quality(t)[4] for i, t, _ in rows}
    gone = brute.repeats([t for _, t, _ in rows], 200)
    assert key(tuple(r) for r in suffix.repeat_report(table).collect()) == key((i, *brute.repeat_row(t, g)) for (i, t, _), g in zip(rows, gone, strict=True))


def test_keep_one(spark, docs):
    out = minhash.keep_one(docs, shingle=5)
    want = brute.near_groups({r["doc_id"]: r["text"] for r in docs.collect()}, 5)
    assert out.columns == docs.columns
    assert key(r["doc_id"] for r in out.collect()) == key(i for i, c in want.items() if i == c)


def test_expansion_units():
    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([3, 5, 9])
        parts = [bytes(rng.choice(b"ab\x00") for _ in range(rng.randint(length, 60))) for _ in range(rng.randint(1, 8))]
        weights = np.array([rng.choice([1, 1, 2]) for _ in parts])
        count = Counter()
        for p, w in zip(parts, weights, strict=True):
            for j in range(len(p) - length + 1):
                count[p[j : j + length]] += w
        want = {(i, j) for i, p in enumerate(parts) for j in range(len(p) - length + 1) if count[p[j : j + length]] > 1}
        assert {(i, j) for i, a, b in suffix.repeated(parts, weights, length) for j in range(a, b)} == want


@pytest.mark.parametrize("hot", [suffix.HOT_BYTES, 1])
def test_repeats(spark, docs, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_BYTES", hot)
    monkeypatch.setattr(suffix, "BATCH_BYTES", 1 << 16)
    rows = docs.union(docs.where("doc_id < 3").withColumn("doc_id", F.lit(None).cast("bigint"))).collect()
    table = spark.createDataFrame(rows, docs.schema)
    want = [(r["doc_id"], *brute.repeat_row(r["text"], g)) for r, g in zip(rows, brute.repeats([r["text"] for r in rows], 200), strict=True)]
    assert key(tuple(r) for r in suffix.repeat_report(table).collect()) == key(want)
    assert suffix.repeat_report(empty(spark)).count() == 0


@pytest.mark.parametrize("hot", [suffix.HOT_BYTES, 4000])
def test_passage_in_many_documents(spark, hot, monkeypatch):
    """One passage, whole or in part, in 20,000 documents that all go on in their own way."""
    monkeypatch.setattr(suffix, "HOT_BYTES", hot)
    rng = random.Random(7)
    words = [f"{a}{b}" for a in ("ba", "do", "ki", "lu", "me") for b in ("rra", "shi", "ton", "vel", "xo")]
    passage = " ".join(rng.choice(words) for _ in range(80))
    rows = []
    for i in range(20_000 if hot > 4000 else 2_000):
        own = [" ".join(rng.choice(words) + str(rng.randrange(10**6)) for _ in range(6)) for _ in range(2)]
        part = passage if rng.random() < 0.9 else passage[rng.randrange(100) : rng.randrange(250, 480)]
        rows.append((i, f"{own[0]} {part} {own[1]}", "s"))
    want = [(i, *brute.repeat_row(t, g)) for (i, t, _), g in zip(rows, brute.repeats([t for _, t, _ in rows], 200), strict=True)]
    got = suffix.repeat_report(spark.createDataFrame(rows, DOCS).repartition(8)).collect()
    assert key(tuple(r) for r in got) == key(want)


def test_remove_repeats_keeps_characters(spark, docs):
    out = suffix.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    rows = docs.collect()
    gone = brute.repeats([r["text"] for r in rows], 200)
    want = []
    for r, g in zip(rows, gone, strict=True):
        at, keep = 0, ""
        for c in r["text"] or "":
            n = len(c.encode())
            keep += "" if g[at : at + n].all() else c
            at += n
        want.append((r["doc_id"], None if r["text"] is None else keep))
    assert key((r["doc_id"], r["text"]) for r in out.collect()) == key(want)


def test_trigram_queries():
    assert secrets.trigram_query("[0-9a-f]{16,}") is None
    assert secrets.trigram_query("AKIA[A-Z0-9]+") == [frozenset({"aki", "kia"})]
    assert secrets.trigram_query("(?:abcd|xyz)[0-9]uvw") == sorted([frozenset({"abc", "bcd", "uvw"}), frozenset({"xyz", "uvw"})], key=sorted)
    assert secrets.trigram_query("ab.*cd") is None


def test_secrets(spark, docs):
    rng = random.Random(2)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIkey", '"', "'", " ", ":", "=", "abcdefghijklmnop", "AKIA", "ABCDEF0123456789XY", "0123456789abcdef", "é", "😀", "\n", "x"]
    more = [(2 * 10**6 + i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30))), "s") for i in range(400)]
    table = docs.select("doc_id", "text", "source", "_rules").union(spark.createDataFrame(more + [(None, "token=abcdefghijklmn", "s")], DOCS).withColumn("_rules", F.lit("")))
    want = []
    for r in table.collect():
        found = brute.secrets(r["text"])
        text = ",".join(f"{n}:{a}:{b}" for a, _, b, n in found)
        want.append((r["doc_id"], *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    assert key(tuple(r)[:5] for r in secrets.secret_report(table).collect()) == key(want)
    assert secrets.secret_report(empty(spark)).count() == 0


def test_service_rules_and_redaction(spark):
    text = "a ghp_" + "x1" * 18 + " b -----BEGIN RSA PRIVATE KEY----- c password=" + "0123456789abcdef" * 2 + " d"
    rows = spark.createDataFrame([(1, text, "s"), (2, None, "s"), (3, "clean text", "s")], DOCS)
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_report(rows).collect()}
    assert [x.split(":")[0] for x in spans[1].split(",")] == ["github", "pem", "assign", "hex"] and spans[3] == ""
    out = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert out == {1: "a [REDACTED] b [REDACTED] c [REDACTED] d", 2: None, 3: "clean text"}


def test_urls(spark):
    rows = [(1, None), (2, "abc"), (3, "http://A.Example.COM/en/7x?q"), (4, "x://com/en/"), (5, "://"), (6, "http://xcom/en/"), (7, "http://m.example.net/de/8#a"), (8, "http://m.example.net/de/9")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string").withColumn("host", F.lit("mine"))
    got = {r["page_id"]: r for r in urls.url_filter(pages).collect()}
    assert (got[3]["host"], got[3]["path"], got[3]["rule"], got[3]["verdict"]) == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert (got[4]["rule"], got[4]["verdict"]) == ("com/en/", "block") and got[6]["rule"] is None
    assert (got[7]["rule"], got[8]["rule"]) == ("example.net/de/8", "net/de/")
    assert all(got[i]["host"] == "" and got[i]["path"] == "" for i in (1, 2, 5))
    assert urls.url_filter(pages.limit(0)).count() == 0


def test_urls_plain(spark):
    """Host, path, rule and ruled verdicts of whole pages, by string operations."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    odd = [None, "", "://", "a://b://c/d?e", "HTTP://X.COM/EN/", "http://com/en/1", "http://Com#/en/", "x://a.net/de/?/", "http://é.ORG/es/ü", "http://İ.net/de/1"]
    pages = pages.union(spark.createDataFrame([(-i - 1, u) for i, u in enumerate(odd)], "page_id bigint, url string"))

    def plain(url):
        host, path = "", ""
        if url and "://" in url:
            rest = url.partition("://")[2]
            end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
            host, rest = brute.lower(rest[:end]), rest[end:]
            path = rest[: min((rest.find(c) for c in "?#" if c in rest), default=len(rest))]
        best = None
        for r in urls.RULES:
            name, _, start = r.rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(r.rule) > len(best.rule)):
                best = r
        return host, path, best and best.rule, best and best.verdict

    got = {r["page_id"]: r for r in urls.url_filter(pages).collect()}
    for r in pages.collect():
        host, path, rule, verdict = plain(r["url"])
        mine = got[r["page_id"]]
        assert (mine["host"], mine["path"], mine["rule"]) == (host, path, rule) and mine["verdict"] in ((verdict,) if rule else ("allow", "block"))


def test_urls_held_out(spark):
    """Accuracy on rows of the labelled table that training doesn't see, and on hosts that no rule knows."""
    table = urls.labelled(spark).withColumn("part", F.pmod(F.xxhash64("host"), F.lit(5)))
    model = urls.train(table.where("part > 0"))
    unseen = table.where("part = 0").select("host", "path", F.lit(None).cast("string").alias("ruled"), "label")
    right = F.avg((F.col("verdict") == F.when(F.col("label") == 1, "block").otherwise("allow")).cast("int"))
    assert urls.verdicts(unseen, model).agg(right).first()[0] > 0.85
    judged = urls.url_filter(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule IS NULL")
    unwanted = F.col("host").rlike("(adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)")
    assert judged.agg(F.avg((unwanted == (F.col("verdict") == "block")).cast("int"))).first()[0] > 0.98


def test_urls_own_table(spark):
    pages = spark.createDataFrame([(1, "http://aaaa.com/"), (2, "http://bbbb.com/"), (3, "http://x.com/en/")], "page_id bigint, url string")
    table = spark.createDataFrame([("aaaa.com", "/", 1.0), ("bbbb.com", "/", 0.0)] * 3, "host string, path string, label double")
    assert [r["verdict"] for r in urls.url_filter(pages, table=table).orderBy("page_id").collect()] == ["block", "allow", "block"]
    assert [r["verdict"] for r in urls.url_filter(pages, table=table.limit(0)).orderBy("page_id").collect()] == ["allow", "allow", "block"]


def test_token_counts(spark, docs):
    model = token_counts.load("piece_bpe_32k.model")

    def plain(word):
        best = [(0.0, 0)]
        for at in range(len(word)):
            n = len(word[at].encode())
            ways = [(best[at][0] + n * model.byte, best[at][1] - n)]
            ways += [(best[b][0] + model.score[word[b : at + 1]], best[b][1] - 1) for b in range(max(0, at - 40), at + 1) if word[b : at + 1] in model.score]
            best.append(max(ways))
        return -best[-1][1]

    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in token_counts.count_tokens(docs, vocabulary="piece_bpe_32k.model").collect()}
    for r in docs.where("doc_id < 40 OR (doc_id >= 1000000 AND length(text) < 700) OR text IS NULL").collect():
        words = (r["text"] or "").split()
        assert got[r["doc_id"]] == (len(words), sum(plain("▁" + w) for w in words))
    assert token_counts.count_tokens(empty(spark), vocabulary="piece_bpe_32k.model").count() == 0


def test_sharding(spark, docs):
    names = [f"s{i}" for i in range(64)]
    table = sharding.lookup_table(names)
    count = Counter(table)
    assert len(table) == 65_537 and max(count.values()) - min(count.values()) <= 1
    assert sharding.moved(names, names[:-1]) / 65_537 < 0.05
    placed = sharding.assign(docs, "doc_id", names)
    assert placed.count() == docs.count() and placed.groupBy("doc_id").agg(F.countDistinct("shard").alias("n")).where("n > 1").isEmpty()
    assert all(names[table[r["slot"]]] == r["shard"] for r in placed.select("slot", "shard").collect())
    hot = spark.range(3000).withColumn("k", F.lit("same"))
    assert sharding.assign(hot, "k", names, salt="id", spread=50).select("shard").distinct().count() > 20
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 65_536)


def test_sharding_query(spark):
    """The whole query against an independent filling of the table and another implementation of the hash."""
    xxhash = pytest.importorskip("xxhash")
    from facetrank.llm.queries import op4_sharding

    names, size = [f"shard-{i:03d}" for i in range(64)], 65_537

    def order(name):
        begin, step = (int(hashlib.sha256(f"{use}:{name}".encode()).hexdigest()[:16], 16) for use in ("offset", "step"))
        return ((begin + k * (step % (size - 1) + 1)) % size for k in range(size))

    orders = list(map(order, names))
    owner = {}
    while len(owner) < size:
        for name, places in zip(names, orders, strict=True):
            free = next((s for s in places if s not in owner), None)
            if free is not None:
                owner[free] = name
    got = op4_sharding(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        hashed = xxhash.xxh64_intdigest(r["doc_id"].to_bytes(8, "little", signed=True), seed=42)
        hashed -= (hashed >= 1 << 63) << 64
        assert (r["slot"], r["shard"]) == (hashed % size, owner[hashed % size])


def test_bpe(spark, docs):
    tiktoken = pytest.importorskip("tiktoken")
    name = "byte_bpe_multi_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(name), "rb"))}
    theirs = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    mine = bpe.load(name)
    rng = random.Random(1)
    letters = "aabbeetth'sll  \n\t\x85\xa0 　\x1c\x1f123½²Ⅷ٣éñöçΣ한漢😀%%==--__́​'"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["a" * 20_000, " " * 3000, "%$" * 2000]
    for t in texts:
        assert np.frombuffer(mine.encode(t), "<u4").tolist() == theirs.encode_ordinary(t)
    got = bpe.encode(docs, ranks=name)
    for r in got.join(docs.select("doc_id", "text"), "doc_id").collect():
        ids = np.array(theirs.encode_ordinary(r["text"] or ""), "<u4")
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((r["text"] or "").encode()).hexdigest()
    back = bpe.decode(got, ranks=name).join(docs.select("doc_id", "text"), "doc_id")
    assert back.where(F.decode("data", "UTF-8") != F.coalesce("text", F.lit(""))).isEmpty()
    assert bpe.encode(empty(spark), ranks=name).count() == 0


def test_prefix_table():
    mine = bpe.load("byte_bpe_multi_50k.tiktoken")
    table = bpe.PrefixTable(mine, b"hello wor")
    table.append(b"ldliness")
    table.edit(3, 5, b"XY zz")
    assert table.data == b"helXY zz worldliness" and table.ids() == bpe.PrefixTable(mine, table.data).ids()
    for n in range(1, len(table.data) + 1):
        assert table.ids(n) == bpe.PrefixTable(mine, table.data[:n]).ids()


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    total = sum(r["length"] for r in rows)
    return len(by), -(-total // capacity)


def test_packing(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    theirs = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    special = [(3 * 10**6 + i, t, "s") for i, t in enumerate(["see <|endoftext|> here", "x<|ENDOFTEXT|>y <|startoftext|>it's<|endoftext|>'s", "<|endoftext|>" * 2100, "a<|endoftext|", "<|end oftext|>"])]
    docs = docs.select("doc_id", "text", "source", "offset").union(spark.createDataFrame(special, DOCS).withColumn("offset", F.lit("")))
    got = packing.pack_documents(docs, vocabulary="word_bpe_49k.json").collect()
    want = []
    for r in docs.collect():
        ids = np.array([*theirs.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(r["doc_id"], i, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048])) for i, at in enumerate(range(0, len(ids), 2048))]
    assert key((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == key(want)
    bins, least = check_packing(got, 2048)
    assert bins <= least + 2
    assert packing.pack_documents(empty(spark), vocabulary="word_bpe_49k.json").count() == 0


def test_word_encoder():
    theirs = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    encoder, rng = packing.WordEncoder("word_bpe_49k.json"), random.Random(4)
    letters = [*"aBé'ß9²Ⅷ.,-!#—<≯̱Σς‘’ _\"() İǅ한sStTmMdDrevl", "'s", "don't", "'LL", " ", "\n", "<|endoftext|>", "<|STARTOFTEXT|>"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert encoder.ids(pa.array([text]))[0].tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_word_encoder_plain_letters():
    """Words of lower-case Latin letters need the merges alone; all others get the vocabulary's rules as well."""
    encoder = packing.WordEncoder("word_bpe_49k.json")
    full = encoder.tokenizer
    letters = [chr(c) for c in range(0x41, 0x280) if chr(c).isalpha()]
    words = [w for x in letters for w in (x, x + x, "a" + x, x + "e", f"st{x}rn", f"{x}'s")]
    flat, first = encoder.ids(pa.array(words))
    assert [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [full.encode(w, add_special_tokens=False).ids for w in words]
    encoder = packing.WordEncoder("word_bpe_49k.json")
    encoder.tokenizer = None
    assert encoder.ids(pa.array(["Plain words größer"]))[0].tolist() == full.encode("Plain words größer", add_special_tokens=False).ids


def test_bin_slack():
    assert sorted(packing.fullest([9, 7, 5, 3], {9: [0], 7: [1], 5: [2], 3: [3, 4]}, 13)) == [3, 3, 7]
    assert packing.fullest([9], {9: [0]}, 5) == []
    lengths = np.random.default_rng(3).integers(1, 2049, 800)
    bins, offsets = packing.pack_lengths(lengths, 2048)
    used = np.bincount(bins, lengths)
    assert used.max() <= 2048 and len(used) <= -(-lengths.sum() // 2048) + 6


def brute_top(rows, k=5, every=50):
    fine = [(i, np.floor(256 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in fine), default=1)
    ids, x = np.array([i for i, _ in fine]), np.zeros((len(fine), width), int)
    for r, (_, v) in enumerate(fine):
        x[r, : len(v)] = v
    out = []
    for r in np.flatnonzero(ids % every == 0):
        s = x @ x[r]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[r]][:k]
        out += [(int(ids[r]), n + 1, int(ids[j]), int(s[j])) for n, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize("block", [2048, 60, 7])
def test_top_k(spark, block):
    """Also with lengths that differ, so that bands fall away."""
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding")
    if block == 7:
        rows = rows.withColumn("embedding", F.transform("embedding", lambda x: x * (1 + F.pow(F.col("vec_id") % 23, F.lit(2)))))
    assert sorted(tuple(r) for r in topk.top_k(rows, block=block).collect()) == brute_top(rows.collect())


def test_top_k_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (50, [float("nan")]), (100, None), (150, []), (200, [1.0, None]), (1, [1.0, 2.0]), (2, [1.0, 2.0, 3.0]), (3, [-5.0]), (None, [1.0]), (-50, [1e5, 1.0]), *((i, [1.0, 2.0]) for i in range(4, 40))]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("rank", F.lit(1))
    for block in (2048, 8):
        assert sorted(tuple(r) for r in topk.top_k(table, block=block).collect()) == brute_top(rows)
    assert topk.top_k(table.limit(0)).count() == 0
