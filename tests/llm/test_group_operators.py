"""Repeated strings, SimHash groups, neighbours, licences and mixing against brute force and messy rows."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark.sql import functions as F

from ratebook.llm import catalog, mixing
from ratebook.llm.components import components
from ratebook.llm.hilbert_ann import hilbert_keys, nearest_neighbours
from ratebook.llm.licenses import FULL, full_text, scan_licenses
from ratebook.llm.repeats import first_least, names
from ratebook.llm.simhash import fingerprint, posting_links, simhash_groups
from ratebook.llm.suffix_dedup import anchor_rows, merged, repeated_strings, shared_rows, strip_rows, window_rows, answer_rows
from tests.conftest import MEDIUM, SMALL
from tests.llm import messy


def brute_repeats(docs, least):
    holder = {}
    for i, t in docs:
        raw = (t or "").encode()
        for a in range(len(raw) - least + 1 if i is not None else 0):
            s = raw[a:a + least]
            holder[s] = min(holder.get(s, i), i)
    out = []
    for i, t in docs:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for a in range(len(raw) - least + 1 if i is not None else 0):
            if holder[raw[a:a + least]] < i:
                gone[a:a + least] = b"\1" * least
        kept = bytes(x for x, g in zip(raw, gone) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def random_documents(seed, n=120):
    rng, docs = random.Random(seed), []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 6)):
            k = rng.random()
            if k < 0.4 and docs:
                s = rng.choice(docs)[1]
                a = rng.randint(0, max(0, len(s) - 1))
                parts.append(s[a:a + rng.randint(0, 150)])
            elif k < 0.5:
                parts.append(rng.choice(["x", "ab", "é"]) * rng.randint(0, 90))
            else:
                parts.append("".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 80))))
        docs.append((i, "".join(parts)))
    extra = [(5, docs[5][1]), (7, docs[90][1]), (None, docs[3][1]), (200, None), (201, "")]
    rows = docs + extra
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,least", [(1, 50), (2, 50), (3, 7), (4, 16)])
def test_repeated_strings_equal_brute_force(spark, seed, least):
    rows = random_documents(seed)
    got = repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), least)
    found = sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got.collect()], key=str)
    assert found == brute_repeats(rows, least)


def test_op6_on_the_small_table(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    got = catalog.QUERIES["op6_suffix_dedup"](spark, SMALL)
    found = sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()], key=str)
    assert found == brute_repeats(docs, 50)


def test_repeated_strings_of_copies_and_empty_tables(spark):
    text = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").repartition(7)
    got = {r.doc_id: r.n_removed for r in repeated_strings(docs).collect()}
    assert got == {i: 0 if i == 0 else len(text) for i in range(300)}
    assert repeated_strings(messy.empty(spark)).count() == 0


def test_names_by_doubling_and_first_least():
    raw = np.frombuffer(b"abracadabra abracadabra xyz", dtype=np.uint8)
    for n in (1, 2, 3, 7, 11):
        h = names(raw, n)
        same = {}
        for i in range(len(raw) - n + 1):
            assert same.setdefault(raw[i:i + n].tobytes(), h[i]) == h[i]
        assert len(set(h.tolist())) == len(same)
    values = np.random.default_rng(0).integers(0, 9, 500).astype(np.uint32)
    for width in (1, 2, 5, 26):
        got = first_least(values, width)
        assert got.tolist() == [i + int(np.argmin(values[i:i + width])) for i in range(len(values) - width + 1)]


def passage_between_flanks(n):
    rng = np.random.default_rng(7)
    passage = "".join(map(chr, rng.integers(97, 123, 300)))
    return [(i, "".join(map(chr, rng.integers(97, 123, 120))) + passage + "".join(map(chr, rng.integers(97, 123, 120)))) for i in range(n)]


@pytest.mark.parametrize("hot", [0, 8, 50_000])
def test_hot_strips_equal_brute_force(spark, hot):
    for rows, least in ((passage_between_flanks(150), 50), (random_documents(3), 20)):
        got = repeated_strings(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), least, hot_strips=hot).collect()
        assert sorted([(r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in got], key=str) == brute_repeats(rows, least)


def test_strips_at_the_edges_of_a_passage_do_not_meet_in_one_group():
    n, per, buckets = 800, 100, 4096
    rows = passage_between_flanks(n)
    blocks = [pa.table({"block": [b] * per, "row": pa.array(range(per), pa.int32()), "id": [i for i, _ in part], "raw": [t.encode() for _, t in part]})
              for b in range(n // per) for part in [rows[b * per:(b + 1) * per]]]

    def by_bucket(tables):
        every = pa.concat_tables(tables)
        return [every.filter(pc.equal(every["bucket"], b)) for b in pc.unique(every["bucket"].drop_null()).to_pylist()]

    def of_block(table, b):
        return table.filter(pc.equal(table["block"], b))

    anchors = [pa.Table.from_batches(list(anchor_rows(50, 25, buckets)(x.select(["block", "raw"]).to_batches()))) for x in blocks]
    shared = pa.concat_tables([shared_rows(g) for g in by_bucket(anchors)])
    strips = by_bucket([strip_rows(50, 25, buckets)(x, of_block(shared, b)) for b, x in enumerate(blocks)])
    answers = pa.concat_tables([answer_rows(100)(g) for g in strips])
    replies = pa.concat_tables([shared, answers], promote_options="default")
    windows = [window_rows(50, 25, buckets)(x, of_block(replies, b)) for b, x in enumerate(blocks)]
    named = by_bucket([x.filter(pc.is_valid(x["windows"])) for x in windows])
    ranked = by_bucket([x.filter(pc.is_valid(x["strips"])) for x in windows])
    assert max(sum(map(len, g["strips"].to_pylist())) // 22 for g in strips) <= 4 * len(blocks)
    assert max((sum(map(len, g["strips"].to_pylist())) // 18 for g in ranked), default=0) <= 200
    assert len(named) > 1000 and max(sum(map(len, g["windows"].to_pylist())) // 24 for g in named) <= 8 * len(blocks)


def test_merged_runs():
    cover = merged(np.array([2, 1, 1, 1, 2]), np.array([0, 5, 0, 20, 3]), np.array([4, 9, 5, 22, 8]))
    assert cover.tolist() == [(1, 0, 9), (1, 20, 22), (2, 0, 8)]


def brute_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, bits=4):
    """fps: (id, unsigned fingerprint); smallest id reachable, per row."""
    values = sorted({f for _, f in fps})
    parent = {f: f for f in values}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    array = np.array(values, dtype=np.uint64)
    for i, f in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(array[i + 1:] ^ array[i]) <= bits) + i + 1:
            a, b = root(f), root(values[j])
            if a != b:
                parent[max(a, b)] = min(a, b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[root(f)] = min(least.get(root(f), i), i)
    return [(i, least.get(root(f))) for i, f in fps]


def test_fingerprints():
    rng = random.Random(5)
    texts = [None, "", " \n", "One", "one two", "a b c d", messy.LONG[:20_000],
             *(" ".join(rng.choice("aA bB É ß x".split()) for _ in range(rng.randint(1, 400))) for _ in range(40))]
    for t in texts:
        assert fingerprint(t, 4) & (1 << 64) - 1 == brute_fingerprint(t)


def test_op8_on_the_small_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = catalog.QUERIES["op8_simhash"](spark, SMALL).collect()
    want = dict(brute_components([(i, brute_fingerprint(t)) for i, t in docs.items()]))
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {
        i: (f"{brute_fingerprint(t):016x}", want[i]) for i, t in docs.items()}


def test_simhash_groups_of_messy_rows(spark):
    docs = messy.frame(spark)
    got = simhash_groups(docs, keep=docs.columns)
    assert got.columns == [c for c in docs.columns if c not in ("fp", "component_id")] + ["fp", "component_id", "component_fp"]
    want = Counter(brute_components([(r[0], brute_fingerprint(r[1])) for r in messy.rows()]))
    assert Counter((r.doc_id, r.component_id) for r in got.collect()) == want
    assert simhash_groups(messy.empty(spark)).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_one_posting_connects_what_is_near(seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 3).astype(np.uint64)
    entries = np.unique([int(rng.choice(base)) ^ sum(1 << int(b) for b in rng.integers(0, 32, rng.integers(0, 9)))
                         for _ in range(300)]).astype(np.uint64)
    links = posting_links(entries, 4)
    assert len(links) < len(entries)
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    parent = {int(e): int(e) for e in entries}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in links:
        parent[root(a)] = root(b)
    for a in entries:
        for b in entries[np.bitwise_count(entries ^ a) <= 4]:
            assert root(int(a)) == root(int(b))


def test_components_of_chains_stars_and_nothing(spark):
    links = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 50)] + [(-5, -5), (7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 50)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hilbert_neighbours_in_key_are_neighbours_in_space():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), axis=-1).reshape(-1, 3)
    keys = hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    walk = grid[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def brute_nearest(vectors, is_query, k):
    """vectors: (id, float64 vector); per query id the k nearest (id, distance)."""
    ids = np.array([i for i, _ in vectors])
    x = np.stack([v for _, v in vectors])
    out = {}
    for i, v in vectors:
        if is_query(i):
            gap = x - v
            d = np.sqrt((gap * gap).sum(axis=1))
            out[i] = [(int(ids[j]), float(d[j])) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def test_op4_recall_on_the_middle_table(spark):
    sf = "/root/testdata/sf0.1"
    vectors = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in
               spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = brute_nearest(vectors, lambda i: i % 100 == 0, 10)
    got = {}
    for r in catalog.QUERIES["op4_hilbert_neighbours"](spark, sf).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert got.keys() == want.keys()
    held = dict(vectors)
    for q, rows in got.items():
        assert [r for r, _, _ in rows] == list(range(1, 11))
        assert [(s, v) for _, v, s in rows] == sorted((s, v) for _, v, s in rows)
        for _, v, s in rows:
            gap = held[v] - held[q]
            assert s == math.sqrt((gap * gap).sum())
    hits = sum(len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))


def test_neighbours_with_copies_ties_and_bad_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(60)]
    rows += [(100 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(400)]
    rows += [(600, None), (601, [0.0] * 6), (602, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (603, [float("nan")] * 6),
             (604, [1.0, 2.0]), (None, [1.0] * 6), (605, [float("inf")] + [0.0] * 5), (0, rows[0][1])]
    good = [(i, np.array(v)) for i, v in rows[:460]]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<double>, raw string, score string")
    got = {}
    for r in nearest_neighbours(docs, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got == brute_nearest(good, lambda i: i % 20 == 0, 10)
    few = nearest_neighbours(docs.where("vec_id < 4"), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2, 3]
    assert nearest_neighbours(docs.where("false"), F.col("vec_id") == 0).count() == 0
    assert nearest_neighbours(docs, F.lit(False)).count() == 0


def test_licences_and_inheritance(spark):
    rows = [("/a/LICENSE", "Released under the MIT License."), ("/a/b/c/x.py", "print(1)"), ("/a/b/y.py", "Licensed under CC BY-NC 4.0.\ncode"),
            ("/z/q.py", "nothing"), ("/a/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
            (None, "SPDX-License-Identifier: Apache-2.0"), ("/a/t", None), ("/a/u", ""), ("top", "the licence plate of my car is red and old"),
            ("/n/only", "Licensed under the Apache License, Version 2.0.")]
    files = spark.createDataFrame([(i, *r, "clash", "clash") for i, r in enumerate(rows)],
                                  "i long, path string, text string, license string, unit string")
    got = {r.i: (r.license, r.found) for r in scan_licenses(files, F.col("path")).collect()}
    assert got == {0: ("MIT", "text"), 1: ("GPL-3.0", "ancestor"), 2: ("CC-BY-NC-4.0", "text"), 3: (None, None), 4: ("GPL-3.0", "text"),
                   5: ("Apache-2.0", "text"), 6: ("MIT", "ancestor"), 7: ("MIT", "ancestor"), 8: (None, None), 9: ("Apache-2.0", "text")}
    messy_files = messy.frame(spark)
    assert scan_licenses(messy_files, F.col("source")).count() == messy_files.count()
    assert scan_licenses(messy.empty(spark), F.col("source")).count() == 0
    plan = scan_licenses(files, F.col("path"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_full_licence_texts_in_files_and_headers(spark):
    mit = full_text("MIT").replace("MIT License\n", "Copyright (c) 2020 Some One and others\n")
    header = "".join(f"# {line}\n" for line in mit.split("\n"))
    code = "".join(f"value_{i} = call_{i % 50}(value_{i // 2})\n" for i in range(800))
    affero = full_text("GPL-3.0").replace("GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June",
                                          "GNU AFFERO GENERAL PUBLIC LICENSE\n                       Version 3, 19 November", 1)
    rows = [(f"/{k}/terms.txt", full_text(k)) for k in FULL if k != "AGPL-3.0"] + [(f"/{k}/sub/code.py", "x") for k in FULL]
    rows += [("/AGPL-3.0/terms.txt", affero), ("/h/a.py", header + code), ("/h/b.py", code)]
    files = spark.createDataFrame(rows, "path string, text string")
    got = {r.path: (r.license, r.found) for r in scan_licenses(files, F.col("path")).collect()}
    want = {p: (p.split("/")[1], "text" if p.endswith(".txt") else "ancestor") for p, _ in rows}
    assert got == want | {"/h/a.py": ("MIT", "text"), "/h/b.py": (None, None)}


def test_near_misses_of_licence_notices(spark):
    cases = [("GPL-2.0", "Licensed under the GNU General Public License, version 2"), ("GPL-3.0", "Licensed under the GNU GPL, version 3"),
             (None, "This work is licensed under the GNU General Public License"), ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
             ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"), ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
             ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"), (None, "Licensed under the BSD License"),
             ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"), ("CC-BY-4.0", "Licensed under CC BY 4.0"),
             ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0"), ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), (None, "Licensed under CC BY-SA 3.0"),
             ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
             ("ISC", "Released under the ISC License"), ("Zlib", "Released under the Zlib License"), (None, "Released under the Foo License"),
             ("MPL-1.1", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 1.1"),
             (None, "Licensed under the Apache License, Version 1.1"), ("Apache-2.0", "// Licensed under the Apache License, Version 2.0 (the \"License\");"),
             ("EUPL-1.2", "# SPDX-License-Identifier: EUPL-1.2"), ("GPL-2.0", "// SPDX-License-Identifier: gpl-2.0-only"),
             ("Apache-2.0 OR MIT", "/* SPDX-License-Identifier: (Apache-2.0 or MIT) */"), (None, "SPDX-License-Identifier: NONE"),
             ("GPL-2.0 WITH Classpath-exception-2.0", "SPDX-License-Identifier: GPL-2.0-or-later WITH Classpath-exception-2.0"),
             *((f"GPL-{v}.0", "it under the terms of the GNU General Public License as published by\n"
                f"# the Free Software Foundation, either version {v} of the License, or\n# any later version.") for v in (2, 3)),
             ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\n# License, v. 2.0. If a copy")]
    bsd = full_text("BSD-2-Clause")
    cases += [("BSD-2-Clause", "x = 1\n" * 400 + bsd), ("BSD-3-Clause", "x = 1\n" * 400 + full_text("BSD-3-Clause"))]
    files = spark.createDataFrame([(i, f"/{i}/f", t) for i, (_, t) in enumerate(cases)], "i long, path string, text string")
    got = {r.i: r.license for r in scan_licenses(files, F.col("path")).collect()}
    assert [(got[i], t[:90]) for i, (_, t) in enumerate(cases)] == [(k, t[:90]) for k, t in cases]


def test_licence_tree_has_inheriting_rows(spark):
    found = Counter(r.found for r in catalog.QUERIES["op9_license_scan"](spark, MEDIUM).collect())
    assert found["ancestor"] and found["text"] and found[None]


def sources(spark, seed=3, n=6000):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["a"] * 30 + ["b"] * 8 + ["c"] * 3 + [None] * 2 + ["z"]), rng.randint(0, 4000)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


@pytest.mark.parametrize("kw", [dict(evenness=0.5, max_epochs=4.0), dict(every_source_once=True, max_epochs=2.0),
                                dict(evenness=0.9, max_epochs=1.5), dict(max_epochs=1.0)])
def test_mixing_meets_targets_and_budgets(spark, monkeypatch, kw):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100_000)
    rows, docs = sources(spark)
    weights = mixing.source_weights(docs, "source", "n_tokens", **kw)
    w = {r.source: r for r in weights.collect()}
    total = sum(n for _, _, n in rows)
    shares = {s: sum(n for _, t, n in rows if t == s) / total for s in w}
    alpha = next(iter(w.values())).exponent
    z = sum(p ** alpha for p in shares.values())
    for s, r in w.items():
        assert r.weight == pytest.approx(shares[s] ** alpha / z, rel=1e-9)
        assert r.epochs <= kw["max_epochs"] + 1e-6
        assert not kw.get("every_source_once") or r.epochs >= 1 - 1e-9
    entropy = -sum(r.weight * math.log(r.weight) for r in w.values())
    if "evenness" in kw:
        natural = -sum(p * math.log(p) for p in shares.values())
        target = natural + kw["evenness"] * (math.log(len(shares)) - natural)
        assert entropy <= target + 1e-6
        assert entropy == pytest.approx(target, abs=1e-4) or max(r.epochs for r in w.values()) == pytest.approx(kw["max_epochs"], abs=1e-3)
    got = mixing.budgeted_copies(docs, docs, weights, "doc_id", "source", "n_tokens").collect()
    assert len(got) == len(rows)
    for s, r in w.items():
        own = [x for x in got if x.source == s]
        read = sum(x.n_tokens * x.copies for x in own)
        assert r.budget <= read <= r.budget + 4000
        assert max(x.copies for x in own) - min(x.copies for x in own) <= 1


def spark_hash(*values):
    """Spark's xxhash64: each value hashed with the hash so far as seed, nulls skipped."""
    at = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else v.to_bytes(4 if isinstance(v, Small) else 8, "little", signed=True)
            at = xxhash.xxh64_intdigest(data, seed=at)
    return at


class Small(int):
    """An int column's value (others are long)."""


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("kw", [dict(evenness=0.5, max_epochs=4.0), dict(every_source_once=True, max_epochs=2.0)])
def test_mixture_serves_permuted_blocks(spark, monkeypatch, kw):
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 100_000)
    rows, docs = sources(spark, seed=5, n=3000)
    docs = docs.withColumn("place", F.lit("own")).repartition(3)
    weights = mixing.source_weights(docs, "source", "n_tokens", **kw)
    mixed = mixing.mixture(docs, docs, weights, "doc_id", "source", "n_tokens", seed=9, unread=True)
    got = mixed.collect()
    assert mixed.columns == ["doc_id", "source", "n_tokens", "copies", "epoch", "block", "place", "inner"]
    assert {r.doc_id for r in got if r.epoch is None} == {r.doc_id for r in got if r.copies == 0}
    for w in weights.collect():
        own = [(i, n) for i, s, n in rows if s == w.source]
        n_blocks = -(-w.tokens // 100_000)
        want, epoch, left = [], 0, w.budget
        while left > 0:
            keyed = []
            for i, n in own:
                block = signed(spark_hash(i, Small(9))) % n_blocks
                order = spark_hash(w.source, block, Small(10), epoch)
                keyed.append((order, block, signed(spark_hash(i, Small(11), epoch)), i, n))
            for order, block, _, i, n in sorted(keyed):
                if left > 0 or epoch < w.budget // w.tokens:
                    want.append((i, epoch, block, (epoch + order / 2.0 ** 64) / w.epochs))
                left -= n
            epoch += 1
        mine = sorted((r for r in got if r.source == w.source and r.epoch is not None), key=lambda r: (r.place, r.block, r.inner))
        assert [(r.doc_id, r.epoch, r.block) for r in mine] == [x[:3] for x in want]
        assert [r.place for r in mine] == pytest.approx([x[3] for x in want], rel=1e-12)
    served = mixing.in_order(mixing.mixture(docs, docs, weights, "doc_id", "source", "n_tokens", seed=9)).collect()
    assert [r.doc_id for r in served] == [r.doc_id for r in sorted((r for r in got if r.epoch is not None),
                                                                  key=lambda r: (r.place, r.block, r.inner))]


def test_exponent_meets_both_limits_or_is_refused(spark):
    shares = spark.createDataFrame([(x,) for x in (0.5, 0.3, 0.15, 0.05)], "share double")

    def figures(a):
        z = sum(x ** a for x in (0.5, 0.3, 0.15, 0.05))
        w = [x ** a / z for x in (0.5, 0.3, 0.15, 0.05)]
        return -sum(x * math.log(x) for x in w), max(x / p for x, p in zip(w, (0.5, 0.3, 0.15, 0.05)))

    a = mixing.find_exponent(shares, 1.0, 1.0, 1.2)
    assert 1.3 < a < 1.45 and figures(a)[0] == pytest.approx(1.0, abs=1e-6) and figures(a)[1] <= 1.2
    a = mixing.find_exponent(shares, 1.0, None, 1.2)
    assert a < 1 and figures(a)[1] == pytest.approx(1.2, abs=1e-6)
    a = mixing.find_exponent(shares, 1.0, 0.01, None)
    assert figures(a)[0] == pytest.approx(0.01, abs=1e-6)
    assert mixing.find_exponent(shares, 1.0, 2.0, None) == 0.0
    for budget, entropy, most in ((1.0, 0.01, 1.2), (3.0, None, 2.0), (None, None, 0.5), (None, 0.01, 2.0)):
        with pytest.raises(ValueError):
            mixing.find_exponent(shares, budget, entropy, most)
    even = spark.createDataFrame([(0.4,), (0.4,), (0.2,)], "share double")
    with pytest.raises(ValueError):  # two equal sources always share the most
        mixing.find_exponent(even, 1.0, 0.5, None)


def test_mixing_of_messy_and_empty_tables(spark):
    docs = messy.frame(spark).withColumn("n", F.coalesce(F.length("text"), F.lit(0)).cast("long"))
    weights = mixing.source_weights(docs, "source", "n", max_epochs=2.0, every_source_once=True)
    got = mixing.budgeted_copies(docs, docs, weights, "doc_id", "source", "n")
    assert got.count() == docs.count() and got.where("n > 0 and (copies < 1 or copies > 2)").count() == 0
    mixed = mixing.mixture(docs, docs, weights, "doc_id", "source", "n")
    read = got.agg(F.sum("copies")).first()[0]
    assert mixed.count() == read and mixing.in_order(mixed).count() == read
    none = docs.where("false")
    weights = mixing.source_weights(none, "source", "n", evenness=0.5, max_epochs=2.0)
    assert mixing.budgeted_copies(none, none, weights, "doc_id", "source", "n").count() == 0
    assert mixing.in_order(mixing.mixture(none, none, weights, "doc_id", "source", "n")).count() == 0


def test_unknown_denied_and_program_files_give_no_licence(spark):
    epl = "Licensed under the Eclipse Public License 2.0"
    files = spark.createDataFrame([
        (1, "/a/z.py", "SPDX-License-Identifier: LicenseRef-Acme"), (2, "/a/w.py", epl + "\ncode"), (3, "/a/v.py", "code alone"),
        (4, "/b/LICENSE", "SPDX-License-Identifier: MIT"), (5, "/b/w.py", epl + "\ncode"), (6, "/b/v.py", "code alone"),
        (7, "/c/x.txt", "This file is not licensed under the Apache License, Version 2.0"),
        (8, "/c/y.txt", "We compared work licensed under the GPL version 3 by others; our own code is proprietary.")],
        "i long, path string, text string")
    got = {r.i: (r.license, r.found) for r in scan_licenses(files, F.col("path")).collect()}
    assert got == {1: ("LicenseRef-Acme", "text"), 2: (None, None), 3: (None, None), 4: ("MIT", "text"), 5: (None, None),
                   6: ("MIT", "ancestor"), 7: (None, None), 8: (None, None)}
