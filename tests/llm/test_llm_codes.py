"""Vector codes, the source audit and vector near-duplicates against brute force."""

from __future__ import annotations

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F

from lifetrail.llm import perfect_hash, source_audit, vector_codes, vector_dedup

VECTORS = "vec_id long, embedding array<float>, label int"
CLASHES = ("code", "error", "label_error", "salt", "of", "v", "node", "digest", "links", "root", "cell", "m")


def clashing(spark, rows, schema=VECTORS, parts=3):
    return spark.createDataFrame(rows, schema).select("*", *(F.lit("clash").alias(c) for c in CLASHES)).repartition(parts)


# ---------------------------------------------------------------- codes
@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 12), st.integers(1, 30), st.integers(0, 10**6), st.sampled_from([2, 9, 1 << 20]))
def test_equal_average_search_finds_the_nearest_entry_of_lowest_index(d, entries, n, seed, spread):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-spread, spread, (n, d)), rng.integers(-spread, spread, (entries, d))
    at, far = vector_codes.nearest(x, book)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def brute_codes(rows, parts, entries, rounds=2, scale=256):
    kept = [(i, lab, [math.floor(scale * float(np.float32(c))) for c in v]) for i, v, lab in rows
            if v and len(v) == 4 and all(c is not None and math.isfinite(c) and abs(c) < 1e6 for c in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    d = 4 // parts
    cut = [[v[p * d:(p + 1) * d] for p in range(parts)] for _, _, v in kept]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def assigned():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        now = assigned()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, now) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(col) // len(mine) for col in zip(*mine)]
    out, by_label = [], collections.Counter()
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    for (i, lab, _), a in zip(kept, assigned()):
        by_label[lab] += sum(f for f, _ in a)
        out.append((i, lab, "".join(f"{k:02x}" for _, k in a), sum(f for f, _ in a)))
    return sorted(((i, c, e, by_label[lab], digest) for i, lab, c, e in out), key=str)


def odd_vectors():
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(x) for x in v], int(i) % 3 if i % 5 else None) for i, v in enumerate(rng.normal(size=(60, 4)))]
    rows += [(7, rows[7][1], 1), (7, [0.5, 0.5, 0.5, 0.5], 1), (100, [0.0] * 4, 2), (None, [0.1] * 4, 0), (101, None, 0), (102, [], 0),
             (103, [1.0, None, 0.0, 0.0], 1), (104, [float("nan")] * 4, 1), (105, [float("inf"), 0.0, 0.0, 0.0], 1), (106, [1.0, 2.0], 1), (107, [1e30, 0.0, 0.0, 0.0], 1)]
    return rows


@pytest.mark.parametrize("parts,entries", [(2, 8), (4, 3), (1, 64), (2, 200)])
def test_codes_of_odd_vectors(spark, parts, entries):
    df = clashing(spark, odd_vectors())
    got = sorted((tuple(r) for r in vector_codes.code_table(df, parts=parts, entries=entries).collect()), key=str)
    assert got == brute_codes(odd_vectors(), parts, entries)


def test_codes_of_no_vectors_and_their_decoding(spark):
    assert vector_codes.code_table(spark.createDataFrame([], VECTORS)).collect() == []
    assert vector_codes.code_table(spark.createDataFrame([(1, None, 1)], VECTORS)).collect() == []
    rows = [(i, [i / 8.0, -i / 8.0, 0.25, 0.5], 1) for i in range(8)]
    coded, books = vector_codes.encode(spark.createDataFrame(rows, VECTORS), parts=2, entries=8)
    for r in vector_codes.decode(coded, books).collect():  # as many entries as vectors: every code is exact up to the floor
        assert np.allclose(r["approx"], rows[r["vec_id"]][1], atol=1 / 256) and r["error"] == 0


# ---------------------------------------------------------------- perfect hash
@pytest.mark.parametrize("levels", [40, 2, 0])
def test_perfect_hash_is_minimal_and_checks_keys(spark, monkeypatch, levels):
    monkeypatch.setattr(perfect_hash, "LEVELS", levels)  # few levels: the rest is listed
    keys = [f"wort{i}é".encode() for i in range(300)] + [b"", b"x" * 1000]
    shards = collections.defaultdict(list)
    for k, h in zip(keys, perfect_hash.hashes(keys).view(np.int64)):
        shards[int(h) % 5].append(k)
    held = perfect_hash.Shards(5, {s: perfect_hash.build(k) for s, k in shards.items()})
    slots = held.lookup(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and [held.key(int(s)) for s in slots] == keys
    assert (held.lookup([b"other", b"wort", b"wort300", b"\xff"]) == -1).all()
    some = perfect_hash.Shards(5, {2: perfect_hash.build(shards[2])})
    assert (some.lookup(shards[2]) >= 0).all() and (some.lookup(shards[3]) == -1).all()
    assert perfect_hash.keys_of(perfect_hash.build(shards[2])) == [some.key(i) for i in range(len(shards[2]))]
    assert perfect_hash.Shards(1, {0: perfect_hash.build([])}).lookup([b"a"]).tolist() == [-1]
    df = spark.createDataFrame([(k.decode(),) for k in keys], "k string").select("k", F.xxhash64(F.col("k").cast("binary")).alias("h"))
    assert {r["k"].encode(): r["h"] for r in df.collect()} == dict(zip(keys, perfect_hash.hashes(keys).view(np.int64).tolist()))


# ---------------------------------------------------------------- source audit
def brute_audit(docs, min_docs=3, top=200):
    term, low = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+"), str.maketrans({c: c + 32 for c in range(65, 91)})
    rows = [(lang or "", source or "", term.findall((text or "").translate(low))) for text, lang, source in docs]
    df, count = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for lang, _, words in rows:
        df[lang].update(set(words))
    kept = {lang: {w for w, c in d.items() if c >= min_docs} for lang, d in df.items()}
    for lang, source, words in rows:
        words = [w for w in words if w in kept[lang]]
        count[lang, source].update(words)
        count[lang, None].update(words)
    total = {g: sum(c.values()) for g, c in count.items()}
    p = {g: {w: 1 + 10**9 * (count[g][w] + 1) // (total[g] + len(kept[g[0]])) for w in kept[g[0]]} for g in count}
    out = []
    for lang, source in [g for g in count if g[1] is not None]:
        mine, whole = p[lang, source], p[lang, None]
        pairs = [(-sum((mine[w] - q[w]) ** 2 // q[w] for w in kept[lang]), other) for (l, other), q in p.items() if l == lang and other not in (None, source)]
        terms = [(-((mine[w] - whole[w]) ** 2 // whole[w]), w) for w in kept[lang] if count[lang, source][w] and mine[w] > whole[w]]
        for part, found in (("pair", pairs), ("term", terms)):
            found = sorted(found, key=lambda x: (x[0], x[1].encode()))
            out += [(lang, source, part, item, -v, i) for i, (v, item) in enumerate(found, 1) if part == "pair" or i <= top]
    return sorted(out)


@pytest.mark.parametrize("small", [{}, dict(shard_terms=5, wave_bytes=1500, task_terms=20, task_slots=10, sources=2)])
def test_audit_of_odd_documents(spark, odd_docs, no_docs, small):
    words = ["Ähre", "the", "THE", "ß", "日本", "x-y", "z9z", "end"]
    rows = [(i, " ".join(words[(i * k) % 8] for k in range(1, 9)), ["en", "de", None][i % 3], ["a", "b", "c", None, ""][i % 5], 1) for i in range(40)]
    rows += [(99, "alone " * 50_000, "xx", "s", 1), (98, "lonely", "xx", "t", 1)]
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars", "rank", F.lit(1).alias("part"), F.lit(1).alias("slots")).unionByName(
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").select("*", F.lit("c").alias("rank"), F.lit(1).alias("part"), F.lit(1).alias("slots")))
    got = sorted(tuple(r) for r in source_audit.audit(docs, **small).collect())
    assert got == brute_audit([tuple(r) for r in docs.select("text", "lang", "source").collect()])
    assert ("xx", "s", "pair", "t", 0, 1) in got
    if not small:
        assert source_audit.audit(no_docs).collect() == []


def test_audit_keeps_the_best_terms_only(spark):
    rows = [("en", "s%d" % (i % 2), " ".join(f"w{chr(97 + (i * j) % 26)}" for j in range(30))) for i in range(30)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string")
    got = sorted(tuple(r) for r in source_audit.audit(docs, top=4, shard_terms=6).collect())
    assert got == brute_audit([(t, lang, s) for lang, s, t in rows], top=4)


def test_shares_are_exact_beyond_double():
    counts = np.array([0, 1, 12_345_678_901, 999_999_999_999], np.int64)
    assert source_audit.shares(counts, 3_000_000_000_017, 7_000_003).tolist() == [1 + 10**9 * (int(c) + 1) // 3_000_007_000_020 for c in counts]


# ---------------------------------------------------------------- vector near-duplicates
def brute_links(rows, threshold=0.98):
    good = [i for i, (_, v, lab) in enumerate(rows) if lab is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    links = {i: set() for i in range(len(rows))}
    unit = {i: np.array(rows[i][1], np.float32).astype(np.float64) for i in good}
    unit = {i: v / np.linalg.norm(v) for i, v in unit.items()}
    for n, i in enumerate(good):
        for j in good[:n]:
            if rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold:
                links[i].add(j)
                links[j].add(i)
    out, seen = [], {}
    for i in range(len(rows)):
        if i not in seen:
            todo, part = [i], {i}
            while todo:
                new = links[todo.pop()] - part
                part |= new
                todo += new
            ids = [rows[k][0] for k in part if rows[k][0] is not None]
            seen.update({k: min(ids, default=None) for k in part})
        out.append((rows[i][0], len(links[i]), seen[i], rows[i][0] == seen[i]))
    return sorted(out, key=str)


def near_vectors(seed, singles, groups, dim=16):
    rng = np.random.default_rng(seed)
    rows = [rng.normal(size=dim) for _ in range(singles)]
    for size, noise in groups:
        centre = rng.normal(size=dim)
        centre /= np.linalg.norm(centre)
        rows += [centre + noise * rng.normal(size=dim) / dim ** 0.5 for _ in range(size)]
    order = rng.permutation(len(rows))
    return [(int(i), [float(x) for x in np.float32(rows[k])], int(k) % 2) for i, k in enumerate(order)]


@pytest.mark.parametrize("settings_", [{}, dict(cell=60, group=50), dict(cell=20, group=500, degree=6, beam=6, overlap=1, margin=0.0)])
def test_links_of_groups_and_a_hot_group(spark, settings_):
    rows = near_vectors(5, 150, [(90, 0.12), (40, 0.18), (2, 0.05), (3, 0.25)])
    rows += [(1000 + i, rows[0][1], rows[0][2]) for i in range(30)]  # exact copies
    rows += [(2000 + i, [8 * x for x in rows[1][1]], rows[1][2]) for i in range(2)]  # the same direction
    found, recall = vector_dedup.link_table(clashing(spark, rows), **settings_)
    assert sorted((tuple(r) for r in found.collect()), key=str) == brute_links(rows) and recall >= 0.999


def test_links_of_odd_vectors(spark):
    rows = odd_vectors() + [(200, [1e-30, 0.0, 0.0, 0.0], 1), (201, [1e30, 0.0, 0.0, 0.0], 1), (202, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (None, [9.0, 9.0, -9.0, 1.0], 2),
                            (203, [1.0, 2.0], None), (204, [-0.0, 1.0, 0.0, 0.0], 2), (205, [0.0, 1.0, 0.0, 0.0], 2)]
    found, _ = vector_dedup.link_table(clashing(spark, rows))
    want = [(i, n, c, i == c) for i, n, c, _ in brute_links(rows)]
    assert sorted((tuple(r) for r in found.collect()), key=str) == sorted(want, key=str)
    empty, recall = vector_dedup.link_table(spark.createDataFrame([], VECTORS))
    assert empty.collect() == [] and recall == 1.0


def test_graph_search_alone_finds_the_neighbours():
    rng = np.random.default_rng(2)
    x = vector_dedup._unit(np.concatenate([rng.normal(size=(1500, 32)), rng.normal(size=32) + 0.1 * rng.normal(size=(200, 32))]))
    graph = vector_dedup.Graph(x, 24)
    graph.insert(rng.permutation(len(x)), 24)
    assert ((graph.edges >= 0).sum(axis=1) >= 1).all()
    found = np.concatenate([graph.in_range(np.arange(a, min(a + 512, len(x))), 24, 0.98) for a in range(0, len(x), 512)])
    near = x @ x.T >= 0.98
    assert (found & near).sum() / near.sum() >= 0.9
    root = vector_dedup.forest(*np.nonzero(found), len(x))
    assert len(set(root[1500:])) == 1
