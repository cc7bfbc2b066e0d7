"""Byte-level BPE codec, source divergence and hard negatives against the library, brute force and messy rows."""

import base64
import hashlib
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from ratebook.llm import catalog, divergence, hard_negatives, matrix_bpe
from tests.conftest import MEDIUM, SMALL
from tests.llm import messy

FILES = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def library():
    with open(FILES[0], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=FILES[1], mergeable_ranks=ranks, special_tokens={})


# --- codec

def odd_texts(n=3000):
    rng = random.Random(5)
    alphabets = [list("abcdestlm'12 \n\t"), list("ab"), list("!-= #"), [chr(c) for c in range(0x20, 0x250)],
                 [chr(c) for c in (0x558, 0x88F, 0x11DE0, 0x3000, 0x85, 0x1C, 0x20, 0x41, 0xE9, 0x4E00, 0x1F600, 0x32000, 0x27, 0x73)]]
    for _ in range(n):
        a = rng.choice(alphabets)
        yield "".join(rng.choice(a) for _ in range(rng.choice([3, 12, 60])))
    for a in alphabets:
        yield "".join(rng.choice(a) for _ in range(6000))
    yield from ("x" * 20_000, "ab" * 4000, "aab" * 900, "é" * 3000, "=" * 5001, "the" * 2000)


def test_vocabulary_equals_the_library(library):
    vocab = matrix_bpe.vocabulary(*FILES)
    texts = [r[1] for r in messy.rows()] + list(odd_texts())
    raws = vocab.encode(texts)
    ids = [np.frombuffer(r, dtype="<u4").tolist() for r in raws]
    assert ids == [library.encode_ordinary(t or "") for t in texts]
    flat = np.concatenate([np.array(i, dtype=np.int64) for i in ids])
    ends = np.cumsum([0, *map(len, ids)])
    decoded, at = vocab.decode(flat, ends)
    assert [bytes(decoded[a:b]) for a, b in zip(at[:-1], at[1:])] == [(t or "").encode() for t in texts]


def test_cache_is_bounded_and_changes_nothing(monkeypatch, library):
    monkeypatch.setattr(matrix_bpe, "CACHE_ENTRIES", 50)
    vocab = matrix_bpe.Vocabulary(*FILES)
    texts = [f"word{i} and {i % 7} more {i}{i}" for i in range(400)]
    for at in range(0, 400, 20):
        raws = vocab.encode(texts[at:at + 20])
        assert [np.frombuffer(r, dtype="<u4").tolist() for r in raws] == [library.encode_ordinary(t) for t in texts[at:at + 20]]
        assert len(vocab.met) <= 50 and len(vocab.met_before) <= 50


def test_pairs_find_all_and_only_their_entries():
    rng = np.random.default_rng(2)
    left, right = np.divmod(rng.permutation(40_000)[:5000], 200)
    pairs = matrix_bpe.Pairs(left, right, np.arange(5000, dtype=np.int32))
    want = {(a, b): i for i, (a, b) in enumerate(zip(left.tolist(), right.tolist()))}
    a, b = np.divmod(np.arange(40_000), 200)
    assert pairs.find(a, b).tolist() == [want.get(k, int(matrix_bpe.NONE)) for k in zip(a.tolist(), b.tolist())]
    assert pairs.find(np.array([-1]), np.array([-1])).tolist() == [int(matrix_bpe.NONE)]


def test_codec_query_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()

    def row(r):
        ids = library.encode_ordinary(r.text or "")
        return (r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                hashlib.sha256(library.decode_bytes(ids)).hexdigest())
    assert sorted(map(tuple, catalog.op13(spark, SMALL).collect())) == sorted(map(row, docs))


def test_codec_messy_rows(spark, library):
    df = messy.frame(spark).withColumn("ids", F.lit("clash")).withColumn("decoded", F.lit("clash"))
    coded = matrix_bpe.encode_texts(df, *FILES)
    back = matrix_bpe.decode_ids(coded, *FILES, keep=["doc_id", "ids"])
    got = sorted((str(r.doc_id), r.ids, bytes(r.decoded)) for r in back.collect())
    want = sorted((str(r[0]), library.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in messy.rows())
    assert got == want
    assert "ids" in coded.columns and coded.columns.count("ids") == 1 and "text" not in coded.columns
    assert matrix_bpe.encode_texts(messy.empty(spark), *FILES).collect() == []
    nothing = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in matrix_bpe.decode_ids(nothing, *FILES).collect()] == [b"", b""]
    with pytest.raises(Exception, match="outside the vocabulary"):
        matrix_bpe.decode_ids(spark.createDataFrame([(1, [5, 60_000])], "doc_id long, ids array<int>"), *FILES).collect()


# --- divergence

def brute_divergence(docs, min_docs=3, top=200):
    docs = [(t or "", g or "", s or "") for t, g, s in docs]
    out = []
    for lang in {g for _, g, _ in docs}:
        words = [(s, Counter(re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)))
                 for t, g, s in docs if g == lang]
        holders = Counter(w for _, c in words for w in c)
        kept = [w for w, n in holders.items() if n >= min_docs]
        sources = sorted({s for s, _ in words})
        counts = {s: Counter() for s in sources}
        for s, c in words:
            counts[s].update({w: n for w, n in c.items() if holders[w] >= min_docs})
        everything = sum(counts.values(), Counter())

        def shares(c):
            total = sum(c.values())
            return {w: 1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept}
        p = {s: shares(counts[s]) for s in sources}
        q = shares(everything)
        for s in sources:
            pairs = sorted((-sum((p[s][w] - p[o][w])**2 // p[o][w] for w in kept), o) for o in sources if o != s)
            terms = sorted((-((p[s][w] - q[w])**2 // q[w]), w.encode()) for w in kept if counts[s][w] and p[s][w] > q[w])[:top]
            out += [(lang, s, "pair", o, -v, i) for i, (v, o) in enumerate(pairs, 1)]
            out += [(lang, s, "term", w.decode(), -v, i) for i, (v, w) in enumerate(terms, 1)]
    return sorted(out)


def test_joint_entries_are_the_products():
    rng = np.random.default_rng(4)
    for size, columns in ((1, 1), (50, 7), (3000, 40), (300, 2000)):
        x = (rng.random((size, columns)) < 0.1).astype(np.int64)
        x[0, 0] = 1
        row, column = np.nonzero(x)
        left, right, n = divergence.joint_entries(row, column, rng.integers(1, 9, len(row)))
        got = np.zeros((columns, columns), dtype=np.int64)
        got[left, right] = n
        assert (got == np.triu(x.T @ x)).all()


@pytest.mark.parametrize("seed", [1, 2])
def test_divergence_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "b", "É", "é", "don't", "x-y", "一二", "zz", "\x00n", "[q]", *[f"w{c}" for c in "abcdefghijklmn"]]
    docs = [(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30)) if rng.random() < .9 else []) if rng.random() < .95 else None,
             rng.choice(["en", "fr", None, ""]), rng.choice(["s1", "s2", "s3", "lone" if rng.random() < .1 else "s1", None])) for _ in range(150)]
    docs += [("only twice", "xx", "u"), ("only twice", "xx", "v"), ("", "yy", "u"), (None, "yy", "v"), ("a a a", "zz", "alone")]
    df = spark.createDataFrame(docs, "text string, lang string, source string").repartition(5)
    got = sorted(map(tuple, divergence.source_divergence(df, top=9).collect()))
    assert got == brute_divergence(docs, top=9)


def test_divergence_messy_rows(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    got = sorted(map(tuple, divergence.source_divergence(messy.frame(spark)).collect()))
    assert got == brute_divergence([(r[1], r[2], r[3]) for r in messy.rows()])
    assert divergence.source_divergence(messy.empty(spark)).collect() == []


def test_share_is_exact_for_large_counts(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 9 * 10**15 - 2), rng.randint(1, 10**6)) for _ in range(200)] + [(0, 1), (0, 0), (9 * 10**15 - 2, 1)]
    rows = [(c, c + rng.randint(0, 10**12), v) if v else (0, 0, 0) for c, v in rows]
    df = spark.createDataFrame(rows, "c long, t long, v long").select("c", "t", "v", F.expr(divergence.share("c", "t")).alias("p"))
    assert all(r.p == 1 + (10**9 * (r.c + 1) // (r.t + r.v) if r.t + r.v else 0) for r in df.collect())


# --- hard negatives

def brute_negatives(rows, positives=5, negatives=10):
    kept = {}
    for i, v, label in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        r = (str(label), [math.floor(256 * x) for x in v])
        kept[i] = min(kept.get(i, r), r)
    out = []
    for a, (label, v) in kept.items():
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, g) for i, (g, w) in kept.items() if i != a)
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            found = [r for r in scored if r[2] != label and 30 * -s <= 100 * -r[0] <= 90 * -s][:negatives]
            out += [(a, p, k, i, -s, -n) for k, (n, i, _) in enumerate(found, 1)]
    return sorted(out)


def vectors(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], "vec_id long, embedding array<double>, label int, id string, block string")


@pytest.mark.parametrize("kind", ["even", "clustered", "hot", "wide"])
def test_negatives_equal_brute_force(spark, monkeypatch, kind):
    rng = np.random.default_rng(7)
    monkeypatch.setattr(hard_negatives, "LEAST_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "FIRST_LOOK", 16)
    monkeypatch.setattr(hard_negatives, "FIT_ROWS", 200)
    x = rng.normal(size=(900, 7 if kind == "even" else 16))
    if kind == "clustered":
        x = rng.normal(size=(12, 16))[rng.integers(0, 12, 900)] * 3 + x * 0.1
    if kind == "hot":
        x[rng.random(900) < 0.4] = x[0]
    if kind == "wide":
        x *= 10_000
    x /= np.sqrt((x * x).sum(axis=1))[:, None] if kind in ("even", "hot") else 1
    rows = [(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, rng.integers(0, 3, 900)))]
    got = hard_negatives.hard_negatives(vectors(spark, rows).repartition(4), F.col("id") % 100 == 0)
    assert sorted(map(tuple, got.collect())) == brute_negatives(rows)


def test_negatives_visit_few_cells_of_clustered_rows(monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16)) * 300
    x = np.floor(centres[rng.integers(0, 40, 6000)] + rng.normal(size=(6000, 16)) * 5).astype(np.int64)
    space = hard_negatives.Space(16, int(np.abs(x).max()), 6000)
    raws = [r.astype(space.stored).tobytes() for r in x]
    ids, labels = np.arange(6000), np.array(["a"] * 6000, dtype=object)
    space.fit(ids[:800], labels[:800], raws[:800])
    (a, ra), (b, rb) = space.code(x)
    space.lay_out({(i, j): (1, ra[a == i].max(), rb[b == j].max()) for i, j in zip(a.tolist(), b.tolist())})
    block = hard_negatives.Block(space, ids, labels, a, b, raws)
    scored = []
    real = block._score
    monkeypatch.setattr(block, "_score", lambda q, places, answers, usable: (
        scored.append(sum(e - s for s, e in places)), real(q, places, answers, usable)))
    top, low = space.bounds(x[:50])
    for k in range(50):
        best = hard_negatives.Best(5, -2**63, 2**63 - 1)
        block.search(x[k], [t[k] for t in top], [v[k] for v in low], [best], block.ids != k)
        want = sorted((-int(x[k] @ x[i]), i) for i in range(6000) if i != k)[:5]
        assert list(zip((-best.scores).tolist(), best.ids.tolist())) == want
    assert sum(scored) < 0.35 * 50 * 6000


def test_cells_come_by_falling_bound():
    rng = np.random.default_rng(8)
    a, b = rng.integers(0, 9, 13).astype(float), rng.integers(0, 9, 6).astype(float)
    got = list(hard_negatives.cells_by_bound(a, b))
    assert [s for s, _, _ in got] == sorted((s for s, _, _ in got), reverse=True)
    assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(13) for j in range(6)] and all(s == a[i] + b[j] for s, i, j in got)


def test_negatives_messy_rows(spark):
    good = [(i, [1.0, i / 50, -0.5], i % 3) for i in range(0, 240)]
    odd = [(None, [1.0, 1.0, 1.0], 1), (300, None, 1), (400, [1.0, None, 2.0], 1), (500, [1.0, float("nan"), 0.0], 1),
           (600, [float("inf"), 0.0, 0.0], 1), (700, [1.0, 2.0, 3.0], None), (800, [], 1), (900, [0.0, 0.0, 0.0], 2), (1000, [-1.0, -9.0, 0.0], 0),
           (100, [1.0, 2.0, -0.5], 1), (100, [1.0, 2.0, -0.5], 1), (100, [9.0, 2.0, -0.5], 2), (301, [2.0, 1.0], 1)]
    rows = good + odd
    got = hard_negatives.hard_negatives(vectors(spark, rows).repartition(3), F.col("id") % 100 == 0)
    padded = [(i, v if v is None else [*v, 0.0, 0.0, 0.0][:3], g) for i, v, g in rows]
    assert sorted(map(tuple, got.collect())) == brute_negatives(padded)
    for none in ([], [(1, None, 1)], [(1, [1.0], 1)], [(100, [], 1), (101, [], 1), (102, [], 2)]):
        want = brute_negatives(none)
        assert sorted(map(tuple, hard_negatives.hard_negatives(vectors(spark, none), F.col("id") % 100 == 0).collect())) == want
    with pytest.raises(ValueError, match="fit a long"):
        hard_negatives.hard_negatives(vectors(spark, [(100, [1e18], 1), (1, [1e18], 1)]), F.col("id") % 100 == 0)


@pytest.mark.parametrize("name", ["op11_source_divergence", "op12_hard_negatives"])
def test_queries_equal_their_sql(spark, name):
    table = {"op11_source_divergence": "documents", "op12_hard_negatives": "embeddings"}[name]
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{MEDIUM}/{table}.parquet'")
    want = con.execute(catalog.SQL[name])
    columns = [c[0] for c in want.description]
    got = catalog.QUERIES[name](spark, MEDIUM)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(want.fetchall())
