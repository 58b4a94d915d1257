"""Vector searches, sharding, mixing and the pipeline against brute force; SQL oracles."""

from __future__ import annotations

import collections
import itertools
import re
import zlib

import numpy as np
import pytest
from conftest import SF001, SF01
from contract_check import compare, duck
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F
from test_llm_text import brute_classes, brute_secrets, digest_rows, pairs  # noqa: F401
from tokenizers import Tokenizer

import corpus_pipeline
from lifetrail.llm import block_ann, language_id, mixing, resharding, voronoi_topk
from lifetrail.llm.common import TOKENIZER
from lifetrail.llm.contract import QUERIES
from lifetrail.llm.oracle import ORACLE_SQL


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    problems, *_ = compare(spark, duck(SF01), name, QUERIES[name], ORACLE_SQL[name], SF01)
    assert not problems, problems


# ---------------------------------------------------------------- vectors
VECTORS = "vec_id long, embedding array<float>, label int"


def usable(rows, zero):
    rows = [(i, v) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))]
    if not rows:
        return []
    sizes = collections.Counter(len(v) for _, v in rows)
    dim = max(sizes, key=lambda d: (sizes[d], d))
    return [(i, v) for i, v in rows if len(v) == dim]


def brute_topk(rows, k, every):
    data = [(i, [int(np.floor(64.0 * np.float64(np.float32(x)))) for x in v]) for i, v in usable(rows, True)]
    out = []
    for at, (q, qv) in enumerate(data):
        if q % every == 0:
            found = sorted((-sum(a * b for a, b in zip(qv, v)), i) for other, (i, v) in enumerate(data) if other != at)[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


def brute_nearest(rows, k, every):
    data = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in usable(rows, False)]
    out = []
    for at, (q, qv) in enumerate(data):
        if q % every == 0:
            found = sorted((float(np.sqrt(np.cumsum((v - qv) ** 2)[-1])), i) for other, (i, v) in enumerate(data) if other != at)[:k]
            out += [(q, r, i, s) for r, (s, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(int(i), rng.normal(size=6).astype(np.float32).tolist(), 0) for i in range(300)]
    rows += [(1000 + i, [0.5, -0.25, 0.125, 0.0, 1.0, -1.0], 1) for i in range(200)]  # one very common vector
    rows += [(2000, [0.0] * 6, 0), (2010, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (2020, [float("nan")] * 6, 0), (2030, [float("inf"), 0.0, 0.0, 0.0, 0.0, 0.0], 0), (2040, None, 0),
             (2050, [], 0), (2060, [1.0, 2.0], 0), (None, [1.0] * 6, 0), (20, rows[20][1], 0), (40, [9.0] * 6, 0), (41, [2.0] * 6, 0), (41, [8.0] * 6, 0), (41, [3.0] * 6, 0)]
    return rows, spark.createDataFrame(rows, VECTORS).withColumn("score", F.lit("clash")).repartition(4)


def test_topk_odd_vectors(odd_vectors):
    rows, df = odd_vectors
    assert pairs(voronoi_topk.search(df, k=7, every=10, pivots=5, query_block=8, data_block=32)) == sorted(brute_topk(rows, 7, 10), key=repr)


def test_nearest_odd_vectors(odd_vectors):
    rows, df = odd_vectors
    assert pairs(block_ann.search(df, k=7, every=10, query_block=8, data_block=32)) == sorted(brute_nearest(rows, 7, 10), key=repr)


@pytest.mark.parametrize("search", [voronoi_topk.search, block_ann.search])
def test_few_or_no_vectors(spark, search):
    assert search(spark.createDataFrame([], VECTORS)).count() == 0
    assert search(spark.createDataFrame([(0, [1.0, 2.0], 0)], VECTORS)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 2.0], 0), (1, [1.0, 2.0], 0), (3, [2.0, 1.0], 0)], VECTORS)
    assert [(r.query_id, r["rank"]) for r in search(few).orderBy("rank").collect()] == [(0, 1), (0, 2)]


def test_quantisation_bounds_hold():
    rng = np.random.default_rng(2)
    v = rng.normal(size=(200, 32)) * rng.uniform(1e-3, 1e3, (200, 1))
    code, scale, residual = block_ann.quantise(v)
    assert (np.linalg.norm(v - code * scale[:, None], axis=1) <= residual + 1e-12).all()
    assert (block_ann.products(code, code) == code.astype(np.int64) @ code.astype(np.int64).T).all()


# ---------------------------------------------------------------- sharding
def check_shards(rows, docs, shards):
    size = lambda t: len((t or "").encode()) + 8
    assert sorted(((r.doc_id, r.shard_size) for r in rows), key=repr) == sorted(((d, size(t)) for d, t in docs), key=repr)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.shard_new].append(r)
    for of in held.values():
        assert sorted(r.shard_slot for r in of) == list(range(len(of)))
    loads = [sum(r.shard_size for r in held.get(j, [])) for j in range(shards)]
    return loads


def test_resharding_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op8_flow_resharding"](spark, SF001).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == sorted((d, len(t.encode()) + 8, zlib.crc32(t.encode())) for d, t in docs)
    loads = collections.Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert set(loads) == set(range(24)) and max(loads.values()) <= 1.1 * min(loads.values())
    for j in loads:
        assert sorted(r.slot for r in rows if r.shard == j) == list(range(sum(r.shard == j for r in rows)))


def test_resharding_odd_documents(odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    old = F.pmod(F.xxhash64(F.coalesce("source", F.lit(""))), F.lit(3))
    check_shards(resharding.reshard(odd_docs, old, 3, shards=4, blocks=8).collect(), docs, 4)
    assert resharding.reshard(no_docs, old, 3, shards=4).count() == 0


def test_resharding_moves_the_fewest_bytes(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.expr("int(id % 50)")).alias("text"))
    old = F.when(F.col("doc_id") % 10 < 6, 0).otherwise(F.pmod("doc_id", F.lit(4)))
    a = resharding.assign(docs, old, 4, shards=6, blocks=128).cache()
    loads = {r.shard_new: r.s for r in a.groupBy("shard_new").agg(F.sum("shard_size").alias("s")).collect()}
    assert max(loads.values()) - min(loads.values()) <= 60
    was = {r.shard_old: r.s for r in a.groupBy("shard_old").agg(F.sum("shard_size").alias("s")).collect()}
    share = sum(was.values()) / 6
    moved = a.where("shard_old <> shard_new").agg(F.sum("shard_size")).first()[0]
    fewest = sum(max(0, s - share) for s in was.values())
    assert moved <= 1.05 * fewest
    # a shard that keeps its content is not written
    same = resharding.assign(docs, old, 4, shards=4, blocks=128, capacity=[was.get(j, 0) for j in range(4)])
    assert resharding.changed_shards(same) == []


def test_cheapest_flow_is_optimal():
    rng = np.random.default_rng(7)
    for _ in range(30):
        n, m = rng.integers(1, 4, 2)
        supply, cost = rng.integers(0, 4, n).tolist(), rng.integers(0, 5, (n, m)).tolist()
        capacity = rng.integers(0, 4, m).tolist()
        if sum(supply) > sum(capacity):
            with pytest.raises(ValueError):
                resharding.cheapest_flow(supply, capacity, lambda i, j: cost[i][j])
            continue
        flow = resharding.cheapest_flow(supply, capacity, lambda i, j: cost[i][j])
        assert [sum(flow.get((i, j), 0) for j in range(m)) for i in range(n)] == supply
        assert all(sum(flow.get((i, j), 0) for i in range(n)) <= capacity[j] for j in range(m))
        units = [i for i, s in enumerate(supply) for _ in range(s)]
        best = min((sum(cost[i][j] for i, j in zip(units, to)) for to in itertools.product(range(m), repeat=len(units))
                    if all(to.count(j) <= capacity[j] for j in range(m))), default=0)
        assert sum(cost[i][j] * f for (i, j), f in flow.items()) == best


# ---------------------------------------------------------------- mixing
def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(size):
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, full = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: 2.0 * size[s] if s in full else rest * weight[s] / open_weight for s in names}
        new = {s for s in names if s not in full and target[s] > 2 * size[s]}
        if not new:
            return target
        full |= new


def check_mix(rows, docs, near):
    size = collections.Counter()
    for _, text, source in docs:
        size[source] += words(text)
    target = brute_targets(size)
    taken = collections.Counter()
    for r in rows:
        assert r.mix_taken <= 2 * r.mix_size and r.mix_source_size == size[r.source]
        assert r.mix_target == pytest.approx(target[r.source])
        taken[r.source] += r.mix_taken
    for s in size:
        assert abs(taken[s] - target[s]) <= near


def test_mixing_query(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = QUERIES["op10_apportioned_mix"](spark, SF001).collect()
    text = {r.doc_id: (r.text, r.source) for r in docs.collect()}
    size, taken = collections.Counter(), collections.Counter()
    for r in rows:
        assert r.size == words(text[r.doc_id][0]) and 0 <= r.taken <= 2 * r.size
        size[text[r.doc_id][1]] += r.size
        taken[text[r.doc_id][1]] += r.taken
    target = brute_targets(size)
    assert len(rows) == len(text)
    assert all(r.source_size == size[text[r.doc_id][1]] and r.target == pytest.approx(target[text[r.doc_id][1]]) for r in rows)
    assert all(abs(taken[s] - target[s]) <= 2 * mixing.BLOCK_WORDS for s in size)
    again = QUERIES["op10_apportioned_mix"](spark.newSession(), SF001).collect()
    assert sorted(rows) == sorted(again)


def test_mixing_odd_documents(odd_docs, no_docs):
    docs = [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    mixed = mixing.mix(odd_docs, block_words=4, shards=3)
    check_mix(mixed.collect(), docs, 8)
    copies = mixing.mixed_documents(odd_docs, block_words=4, shards=3)
    assert copies.columns == odd_docs.columns
    assert sum(words(r.text) for r in copies.collect()) == mixed.agg(F.sum("mix_taken")).first()[0]
    assert mixing.mix(no_docs).count() == 0


def test_quotas_are_sainte_lague(spark):
    target = {1: 530.0, 2: 240.0, 3: 226.0, 4: 4.0, 5: 0.0}
    plan = spark.createDataFrame([(k, t) for k, t in target.items()], "rank int, target double")
    got = {(r.shard, r["rank"]): r.quota for r in mixing.quotas(plan, block_words=10, shards=3).collect()}
    won = collections.Counter()
    for seat in range(100):
        best = max(target, key=lambda k: (target[k] / (2 * won[k] + 1), -k))
        won[best] += 1
        if seat + 1 in (33, 66, 100):
            shard = (33, 66, 100).index(seat + 1)
            assert {k: sum(got.get((s, k), 0) for s in range(shard + 1)) for k in target} == {k: won[k] for k in target}


# ---------------------------------------------------------------- pipeline
def test_pipeline_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    columns = docs.columns
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF001)
        before, after = [tuple(r) for r in docs.collect()], [tuple(r) for r in out.collect()]
        kept.append((name, before, after))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == columns
            docs = spark.createDataFrame(after, docs.schema)
    stages = {name: (before, after) for name, before, after in kept}

    before, after = stages["language_id"]
    model = language_id.train(language_id.training_rows(spark.createDataFrame(before, docs.schema)))
    pred = {r.doc_id: r for r in language_id.predict(spark.createDataFrame(before, docs.schema), model).collect()}
    assert sorted(after) == sorted((i, t, pred[i].lang_pred, s, n) for i, t, _, s, n in before if pred[i].lang_pred != "und")
    before, after = stages["near_dedup"]
    assert sorted(r[0] for r in after) == sorted({c for _, c in brute_classes([(r[0], r[1]) for r in before])})
    assert set(after) <= set(before)
    before, after = stages["secrets"]
    text = {r[0]: r[1] for r in after}
    dirty = {r[0] for r in before if brute_secrets(r[1])[:3] != (0, 0, 0)}
    assert dirty and all(brute_secrets(text[i])[:3] == (0, 0, 0) and "[SECRET]" in text[i] for i in dirty)
    assert all(text[r[0]] == r[1] or "[SECRET]" in text[r[0]] for r in before)
    before, after = stages["mix"]
    taken, size = collections.Counter(), {r[0]: words(r[1]) for r in before}
    for r in after:
        taken[r[0]] += words(r[1])
        assert r[4] == len(r[1])
    mixed = {r.doc_id: r.mix_taken for r in mixing.mix(spark.createDataFrame(before, docs.schema), block_words=corpus_pipeline.MIX_BLOCK_WORDS).collect()}
    assert {i: n for i, n in mixed.items() if n} == dict(taken) and all(taken[i] <= 2 * size[i] for i in taken)
    before, after = stages["bpe"]
    library = Tokenizer.from_file(TOKENIZER)
    want = sorted((r[0], library.encode(r[1], add_special_tokens=False).ids) for r in before)
    assert sorted((i, list(ids)) for i, n, ids in after) == want and all(n == len(ids) for _, n, ids in after)


def test_pipeline_runs_on_odd_and_no_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, SF001)
        assert docs.columns == ["doc_id", "n_tokens", "ids"]
        docs.count()


def test_entry_without_the_subpackage(tmp_path):
    """Without the llm folders the entry still imports and has the other queries."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path
    root = Path(corpus_pipeline.__file__).parent
    shutil.copytree(root / "lifetrail", tmp_path / "lifetrail", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120)
