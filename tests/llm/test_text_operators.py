"""Token counts, quality rules, quality classifier, PII and packing against brute force and messy rows."""

import hashlib
import json
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ratebook.llm import catalog
from ratebook.llm.bpe import Ids, cuts_at_spaces, pack_ids
from ratebook.llm.packing import Packer, pack_documents
from ratebook.llm.pii import BASE_KINDS, digest, find_pii, of_kind, redact
from ratebook.llm.pu_classifier import fit_pu, pu_scores
from ratebook.llm.quality_rules import MONOTONE, fit_rules, quality_rules
from ratebook.llm.textstats import BASE, FEATURES
from ratebook.llm.token_counts import _frequent_pieces, frequent_lengths, token_counts
from tests.conftest import MEDIUM, SMALL
from tests.llm import messy

LARGE = "/root/testdata/sf0.1"
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def texts_of(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}


def test_token_counts_equal_the_library(spark):
    tok = Tokenizer.from_file(BYTE_BPE)
    for r in catalog.QUERIES["op1_token_counts"](spark, SMALL).join(
            spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id").collect():
        n = len(tok.encode(r.text or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len((r.text or "").encode()), n > 512)


def test_token_counts_of_messy_rows(spark):
    tok = Tokenizer.from_file(BYTE_BPE)
    docs = messy.frame(spark)
    got = token_counts(docs, BYTE_BPE)
    assert got.columns == [c for c in docs.columns if c not in ("text", "n_tokens")] + ["n_bytes", "n_tokens", "over_limit"]
    want = Counter((r[0], len(tok.encode(r[1] or "", add_special_tokens=False).ids)) for r in messy.rows())
    assert Counter((r.doc_id, r.n_tokens) for r in got.collect()) == want
    assert token_counts(messy.empty(spark), BYTE_BPE).count() == 0


def test_token_counts_of_other_tokenizer_files(spark, tmp_path):
    texts = ["Hello World, an  example", "it's <|endoftext|> x", " ", "ÀB 12\n 3", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rules = json.loads(Path(BYTE_BPE).read_text())
    rules["pre_tokenizer"]["add_prefix_space"] = True
    rules["truncation"] = {"direction": "Right", "max_length": 2, "strategy": "LongestFirst", "stride": 0}
    other = tmp_path / "prefixed.json"
    other.write_text(json.dumps(rules))
    assert cuts_at_spaces(BYTE_BPE, False) and cuts_at_spaces(WORD_BPE, True)
    for path in (WORD_BPE, str(other)):
        assert not cuts_at_spaces(path, False)
        tok = Tokenizer.from_file(path)
        tok.no_truncation()
        want = {i: len(tok.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(texts)}
        assert {r.doc_id: r.n_tokens for r in token_counts(docs, path).collect()} == want
    ids = Ids(BYTE_BPE)
    tok = Tokenizer.from_file(BYTE_BPE)
    assert [ids.encode(t) for t in texts] == [pack_ids(tok.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_the_frequent_table_merges_the_tasks_lists(spark):
    docs = spark.createDataFrame([(i, "one two two three " * 3 + " x") for i in range(40)], "doc_id long, text string").repartition(4)
    assert set(frequent_lengths(docs, "text", BYTE_BPE)) == {"one", "two", "three", "x"}
    assert frequent_lengths(messy.empty(spark), "text", BYTE_BPE) == {}
    pieces = docs.select("text").mapInArrow(_frequent_pieces, "piece string, n long")
    assert pieces.groupBy().sum("n").first()[0] == 40 * 13


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    hit = {i + j for i in range(len(words) - 2) for j in range(3) if windows[tuple(words[i:i + 3])] > 1}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))


def test_quality_rules_base_and_verdict(spark):
    texts = texts_of(spark, MEDIUM)
    got = {r.doc_id: r for r in catalog.QUERIES["op3_quality_rules"](spark, MEDIUM).collect()}
    assert got.keys() == texts.keys()
    for i, r in got.items():
        base = brute_statistics(texts[i])
        assert tuple(r[c] for c in BASE) == base
        assert r.base_failed == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (r.base_failed and r.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    judged = [(got[i].kept, q) for i, q in labels.items() if i in got and not got[i].base_failed]
    assert np.mean([k == bool(q) for k, q in judged]) > 0.97


def test_quality_rules_are_monotone_and_stand_messy_rows(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet")
    forest = fit_rules(docs, spark.read.parquet(f"{MEDIUM}/labels.parquet"))
    rng = np.random.default_rng(0)
    x = np.abs(rng.normal(size=(400, len(FEATURES))))
    for name in MONOTONE:
        more = x.copy()
        more[:, FEATURES.index(name)] += np.abs(rng.normal(size=400))
        assert (forest.margin(more) <= forest.margin(x) + 1e-12).all()
    got = quality_rules(messy.frame(spark), forest)
    want = Counter((r[0], *brute_statistics(r[1])) for r in messy.rows())
    assert Counter((r.doc_id, *[r[c] for c in BASE]) for r in got.collect()) == want
    no_labels = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    assert fit_rules(docs, no_labels) is None
    kept = quality_rules(messy.frame(spark), None).where("kept = base_failed").count()
    assert kept == 0
    assert quality_rules(messy.empty(spark), forest).count() == 0


def test_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{LARGE}/labels.parquet")
    got = catalog.QUERIES["op2_quality_classifier"](spark, LARGE).cache()
    rows = got.join(labels, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.collect())
    good = sorted(r.score for r in rows if r.quality == 1)
    bad = [r.score for r in rows if r.quality == 0]
    auc = np.mean([np.searchsorted(good, b, "right") for b in bad])
    assert 1 - auc / len(good) > 0.98
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.collect())


def test_classifier_stands_messy_rows(spark):
    docs = messy.frame(spark)
    labels = spark.createDataFrame([(4, 1), (4, 0), (None, 1), (9, None), (11, 1)], "doc_id long, quality int")
    model = fit_pu(docs, labels)
    got = pu_scores(docs, model)
    assert got.count() == docs.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    assert fit_pu(docs, labels.where("false")) is None
    assert {r.score for r in pu_scores(docs, None).collect()} == {0.5}
    assert pu_scores(messy.empty(spark), model).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
            "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
            "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    twice = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(d - 9 * (d > 9) for d in twice) % 10 == 0


def brute_spans(text):
    def good(kind, hit):
        digits = re.sub("[^0-9]", "", hit)
        return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in hit.split(".")),
                "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m.group())]


def random_texts():
    import random
    rng = random.Random(1)
    letters = "0123456789.+-@ ()ab%é\n"
    out = ["".join(rng.choice(letters[:n]) for _ in range(rng.randint(0, 120))) for n in (13, 16, 22, 12) for _ in range(150)]
    return out + ["a@b.c%x@d.e", "1.2.3.4.5.6.7.8", "\U0001f600 me@x.org 300.1.1.1 0255.001.2.3", "x@y.z " * 300, "1.1.1.1," * 300,
                  "4111 1111 1111 1111 and 4111-1111-1111-1112", None, ""]


def test_pii_base_spans(spark):
    rows = list(enumerate(random_texts())) + [(10_000 + i, t) for i, t in texts_of(spark, SMALL).items()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    for r in find_pii(docs).select("doc_id", digest(of_kind(F.col("pii"), *BASE_KINDS)).alias("s")).collect():
        assert r.s == ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[r.doc_id]))


def test_pii_added_kinds_need_checksum_or_context(spark):
    texts = ["GB82 WEST 1234 5698 7654 32", "GB83 WEST 1234 5698 7654 32", "card 3782 822463 10005", "3782 822463 10005",
             'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "24be64439e3e49cf46b2d7c90f3602a3d0b907ff", "ssn 123-45-6789", "123-45-6789"]
    got = find_pii(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, text string")).orderBy("i").collect()
    assert [[s.kind for s in r.pii] for r in got] == [["iban"], [], ["card_short"], [], ["secret"], [], ["ssn"], []]


def test_pii_linear_on_long_runs_and_messy_rows(spark):
    long = ["a" * 300_000, "1" * 300_000, "1 " * 150_000, "+" + "(" * 200_000, "A1" * 100_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(long)], "doc_id long, text string")
    assert all(r.pii == [] for r in find_pii(docs).collect())
    docs = messy.frame(spark)
    got = find_pii(docs)
    assert got.count() == docs.count() and got.where("pii is null").count() == 0
    assert set(got.columns) == set(docs.columns)
    masked = redact(docs)
    assert masked.columns == docs.columns and masked.where("text is null").count() == docs.where("text is null").count()
    assert find_pii(messy.empty(spark)).count() == 0 and redact(messy.empty(spark)).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_redaction_removes_base_spans(spark):
    docs = spark.createDataFrame([(1, "mail a@b.cd or +1 (743) 555-3824, host 10.0.0.1 x"), (2, "nothing"), (3, "a@b.cd")],
                                 "doc_id long, text string")
    assert [r.text for r in redact(docs).orderBy("doc_id").collect()] == [
        "mail [EMAIL] or [PHONE], host [IP] x", "nothing", "[EMAIL]"]


def check_packing(rows, docs):
    """Each id in one piece, crc of every piece, offsets without gaps; returns the share of padding."""
    tok = Tokenizer.from_file(WORD_BPE)
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
    want = Counter()
    for i, text in docs:
        ids = np.array(tok.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")
        want[i] += len(ids)
        own = sorted(pieces[i], key=lambda r: r.start)
        if [d for d, _ in docs].count(i) == 1:
            assert [r.start for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
            for r in own:
                assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert want == Counter({i: sum(r.length for r in own) for i, own in pieces.items()})
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append(r)
    padding = total = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == list(np.cumsum([0] + [r.length for r in own])[:-1])
        n = sum(r.length for r in own)
        assert n <= 4096
        total += n
        padding += 0 if n & (n - 1) == 0 else 4096 - n
    return padding / max(total, 1)


def test_packing_round_trip(spark):
    rows = catalog.QUERIES["op5_packing"](spark, MEDIUM).collect()
    assert check_packing(rows, list(texts_of(spark, MEDIUM).items())) < 0.01
    groups = Counter()
    for s, tier, group in {(r.sequence_id, r.tier, r.step_group) for r in rows}:
        groups[tier, group] += tier
    assert max(groups.values()) == 8 * 4096


def test_packing_messy_rows(spark):
    docs = messy.frame(spark)
    got = pack_documents(docs, WORD_BPE).collect()
    check_packing(got, [r[:2] for r in messy.rows()])
    assert all(zlib.crc32(bytes(r.ids)) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in got)
    assert pack_documents(messy.empty(spark), WORD_BPE).count() == 0
    clash = pack_documents(docs.withColumn("part", F.lit("x")), WORD_BPE, keep=["doc_id", "start", "part"], with_ids=False)
    assert clash.columns[:3] == ["doc_id", "part", "start"] and clash.columns.count("start") == 1
    assert {(r.part, type(r.start)) for r in clash.collect()} == {("x", int)}


@pytest.mark.parametrize("seed", range(5))
def test_packer_fills_every_window(seed):
    rng = np.random.default_rng(seed)
    windows = []
    packer = Packer(lambda tier, pieces: windows.append((tier, pieces)))
    sizes = rng.integers(1, 9000, 300)
    for i, n in enumerate(sizes):
        packer.add((i,), 0, bytes(4 * int(n)), int(n))
    packer.pack()
    rest = packer.rest()
    assert all(sum(len(p[2]) for p in pieces) == 4 * tier for tier, pieces in windows)
    left = sum(len(p[2]) for p in rest) // 4
    assert left < 4096 and sum(t for t, _ in windows) + left == sizes.sum()


def test_op7_digest_columns(spark):
    texts = texts_of(spark, SMALL)
    for r in catalog.QUERIES["op7_pii"](spark, SMALL).collect():
        spans = brute_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in BASE_KINDS] == [sum(s[0] == k for s in spans) for k in BASE_KINDS]
        assert r.spans.startswith(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def test_pieces_encode_like_the_library():
    import random

    from ratebook.llm import bpe
    rng = random.Random(4)
    atoms = ["a", "B", "é", "Ü", "ß", " ", "  ", "\n", "\t", "1", "23", ".", "...", "&", "$$", "<|endoftext|>", "'s", "'", "<", "|>",
             "_", "-", "\r", "É", "word", "the", "×", " ", "İ", "Σ", "é", "一"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 60))) for _ in range(1500)] + [t for t in messy.ODD]
    words, lengths = bpe.Ids(WORD_BPE), bpe.Lengths(BYTE_BPE, {"the": 1})
    word_tok, byte_tok = Tokenizer.from_file(WORD_BPE), Tokenizer.from_file(BYTE_BPE)
    for t in texts:
        assert words.encode(t) == bpe.pack_ids(word_tok.encode(t, add_special_tokens=False).ids)
        assert lengths.count(t) == len(byte_tok.encode(t, add_special_tokens=False).ids)


def test_caches_keep_their_bound(monkeypatch):
    from ratebook.llm import bpe
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 10)
    lengths = bpe.Lengths(BYTE_BPE, {})
    text = " ".join(f"w{i % 37}" for i in range(500))
    assert lengths.count(text) == len(Tokenizer.from_file(BYTE_BPE).encode(text, add_special_tokens=False).ids)
    assert len(lengths) <= 10 and len(lengths.old) <= 10


def test_plain_stretches_are_counted_by_their_pre_tokens(monkeypatch):
    """One remembered length serves a word with any marks around it; frequent pieces are never encoded again."""
    from ratebook.llm import bpe
    tok = Tokenizer.from_file(BYTE_BPE)
    lengths = bpe.Lengths(BYTE_BPE, {"word": len(tok.encode(" word").ids)})
    encoded = []
    monkeypatch.setattr(bpe, "byte_level", lambda part, to=bpe.byte_level: encoded.append(part) or to(part))
    text = "plain word, (word) word; plain. it's  word\n word plain" + " word. wörd's plain," * 20
    assert lengths.count(text) == len(tok.encode(text, add_special_tokens=False).ids)
    assert sorted(set(encoded)) == sorted(encoded) and " word" not in encoded and encoded.count(" plain") == 1
    assert set(lengths) == {" it's ", " wörd's"}
    assert lengths.count("word") == len(tok.encode("word", add_special_tokens=False).ids)
