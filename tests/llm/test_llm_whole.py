"""The operators' whole job where the provided tables do not ask for it."""

from __future__ import annotations

from conftest import SF001
from llm_fixtures import no_docs, odd_docs  # noqa: F401
from pyspark.sql import functions as F
from test_llm_text import TINY, WORD, brute_licenses, pairs

import corpus_pipeline
from lifetrail.llm import language_id, licenses, mixing, resharding, secrets

# ---------------------------------------------------------------- licenses
WRAPPED = {
    "bsd": "// Redistribution and use in source and binary forms, with or without\n// modification, are permitted provided that the following conditions\n// are met:",
    "mpl": " * This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\r\nof this software and associated documentation files (the \"Software\"), to deal",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by",
}


def brute_windows(text):
    words = WORD.findall((text or "").translate(TINY))
    best, met = 0.0, set()
    for label, template in licenses.TEMPLATES:
        t, width = set(licenses.template_words(template)), licenses.window_width(template)
        most = max(len(t & set(words[k:k + width])) for k in range(max(1, len(words))))
        if most >= 0.8 * len(t) - 1e-9:
            met.add(label)
            best = max(best, most / len(t))
    n_words, n_base, first, last, base, _, score = brute_licenses(text)
    return n_words, n_base, first, last, base, ",".join(sorted(met | set(base.split(",")) - {""})), max(best, 1.0 if n_base else 0.0)


def test_licenses_wrapped_and_scattered(spark, odd_docs):
    filler = "the garden gate stood open while rain fell on old stones ".split()
    scattered = " ".join(" ".join([w, *filler]) for w in licenses.template_sequence(licenses.TEMPLATES[5][1]))
    rows = [(k, f"A file.\n\n{notice}\nand more text") for k, notice in enumerate(WRAPPED.values())]
    rows += [(10, scattered), (11, f"{scattered} {WRAPPED['mpl']} {scattered}"), (12, "\n".join([WRAPPED["bsd"]] * 50 + [WRAPPED["mit"]])),
             (13, "permitted are modification without or with forms binary source use"), (14, "permission\nis\nhereby\ngranted"), (15, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert [got[k].labels for k in range(4)] == list(WRAPPED) and all(got[k].score == 1.0 for k in range(4))
    assert (got[10].labels, got[10].score) == ("", 0.0) and got[11].labels == "mpl" and got[12].labels == "bsd,mit"
    for table in (docs, odd_docs):
        want = sorted(((d, *brute_windows(t)) for d, t in table.select("doc_id", "text").collect()), key=repr)
        assert pairs(licenses.scan(table)) == want


# ---------------------------------------------------------------- mixing
def test_shards_hold_their_quotas(spark, odd_docs):
    documents = spark.read.parquet(f"{SF001}/documents.parquet")
    mixed = mixing.mix(documents, shards=5).cache()
    sizes = documents.select("source", mixing.words().alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = mixing.targets(sizes)
    quota = {(r.shard, r.source): r.quota for r in mixing.quotas(plan, shards=5).join(plan, "rank").collect()}
    held = {(r.shard, r.source): r.n for r in mixed.select("source", F.inline("mix_shards")).groupBy("shard", "source").agg(F.sum("words").alias("n")).collect()}
    assert len({s for s, _ in held}) == 5
    for key, blocks in quota.items():  # a source's last block may be short
        assert 64 * blocks - 2 * 63 <= held.get(key, 0) <= 64 * blocks
    for docs, options in ((documents, {"shards": 5}), (odd_docs, {"shards": 3, "block_words": 4})):
        of = mixing.mix(docs, **options)
        assert of.where("mix_taken <> aggregate(mix_shards, 0L, (n, s) -> n + s.words)").count() == 0
        parts = mixing.mixed_shards(docs, **options)
        assert parts.columns == ["mix_shard", *docs.columns]  # own columns pass through, also those that begin with mix_
        got = parts.withColumn("n", mixing.words()).groupBy("mix_shard", "doc_id").agg(F.sum("n").alias("n"))
        want = of.select("doc_id", F.inline("mix_shards")).groupBy("shard", "doc_id").agg(F.sum("words").alias("n"))
        assert pairs(got) == pairs(want)


# ---------------------------------------------------------------- sharding
def test_reshard_layout_writes_changed_shards_only(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.expr("int(id % 50)")).alias("text"), F.lit("s").alias("source"))
    old = f"{tmp_path}/old"
    resharding.rewrite(resharding.assign(docs, F.pmod("doc_id", F.lit(4)), 4, shards=4), old)
    was = {r.shard_new: r.s for r in spark.read.parquet(old).groupBy("shard_new").agg(F.sum("shard_size").alias("s")).collect()}
    moved = was[2] // 2
    out = resharding.reshard_layout(spark, old, 4, f"{tmp_path}/new", capacity=[was[0], was[1], was[2] - moved, was[3] + moved])
    assert sorted(p.name for p in (tmp_path / "new").glob("shard_new=*")) == ["shard_new=2", "shard_new=3"]
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted((r.doc_id, r.text) for r in docs.collect())
    slots = {r.shard_new: sorted(r.slots) for r in out.groupBy("shard_new").agg(F.collect_list("shard_slot").alias("slots")).collect()}
    assert set(slots) == {0, 1, 2, 3} and all(s == list(range(len(s))) for s in slots.values())
    same = resharding.reshard_layout(spark, old, 4, f"{tmp_path}/same", capacity=[was[j] for j in range(4)])
    assert not list((tmp_path / "same").glob("shard_new=*")) and same.count() == 2000


# ---------------------------------------------------------------- language
def test_every_language_is_learned(spark):
    rows = [(k, "the cat sat on the mat and ran", "en") for k in range(3000)] + [(k, "katten satt på mattan och sprang", "sv") for k in range(3000, 3003)] + [(None, "kissa istui matolla", "fi")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    counts = {r["lang"]: r["count"] for r in language_id.sample(docs, sample_rows=300).groupBy("lang").count().collect()}
    assert counts["sv"] == 3 and counts["fi"] == 1 and 200 < counts["en"] < 400
    model = language_id.train(docs, sample_rows=300)
    assert model[0] == ["en", "fi", "sv"]
    assert language_id.predict(docs.where("doc_id = 3000"), model).first().lang_pred == "sv"
    assert language_id.sample(docs, sample_rows=3004).count() == 3004
    assert language_id.row_bound([5, 100, 1000], 700) == 595 and language_id.row_bound([], 700) == 200


# ---------------------------------------------------------------- pipeline

def test_pipeline_keeps_the_documents_own_columns(spark):
    rows = [(1, "the cat sat on the mat", "en", 7, "x", "en?", 1), (2, "!!", "en", 8, "y", "de?", 2), (6, "the dog ran to the cat", "en", 9, None, None, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, shares string, lang_pred string, language_id_Score int")
    out = corpus_pipeline.identify_language(spark, docs, SF001)
    assert out.schema == docs.schema
    assert sorted(map(tuple, out.collect())) == [rows[0], rows[2]]


# ---------------------------------------------------------------- secrets
def test_secrets_partly_covered_by_fixed_spans(spark):
    documents = spark.read.parquet(f"{SF001}/documents.parquet")
    ratios = secrets.train(secrets.labelled_tokens(documents))
    left, middle, right = "qX7fK2mZ9LwT", "0123456789abcdef", "Z9vBn8RcYTqW"
    rows = [(1, f"é😀 {left}{middle}{right} end"), (2, f"see {middle}{middle} end"), (3, f"a {left}{middle}{right}{middle}{left} z AKIA{'B' * 14}{middle}"),
            (4, "nothing here"), (5, None), (6, middle)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit(1).alias("t"), F.lit(2).alias("union"))
    found = {r.doc_id: r.spans for r in secrets.scan(docs, ratios).collect()}
    assert found[1] == "random:3:43,hex:15:31" and found[2] == "hex:4:36"
    assert found[3].startswith("random:2:70,hex:14:30,hex:42:58,") and found[6] == "hex:0:16"
    clean = secrets.redact(docs, ratios)
    assert clean.columns == docs.columns
    assert {r.doc_id: r.text for r in clean.collect()} == {
        1: "é😀 [SECRET] end", 2: "see [SECRET] end", 3: "a [SECRET] z [SECRET]", 4: "nothing here", 5: None, 6: "[SECRET]"}


def test_own_columns_pass_through_whatever_their_names(spark):
    """Values, not only names: columns that the operators use themselves, with dots, and of a map type."""
    from pyspark.sql import functions as F

    from lifetrail.llm import mixing, near_dedup
    names = ["near_key", "mix_size", "mix_note", "mix_document", "mix_key", "mix_text", "document", "key", "place", "n", "root", "first_id", "a.b"]
    rows = [(i, f"text number {i % 7} of a small corpus with some words in it {'more ' * (i % 7)}", f"s{i % 3}") for i in range(20)] + [(20, None, None), (3, "other words for the same id here", "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = docs.select("*", *(F.concat(F.lit(f"{n}:"), F.col("doc_id"), F.coalesce(F.substring("text", 1, 5), F.lit("-"))).alias(n) for n in names), F.create_map(F.lit("k"), F.col("doc_id")).alias("m"))
    docs = docs.repartition(3)
    want = {(r.doc_id, (r.text or "-")[:5]): r for r in docs.collect()}
    for out in (near_dedup.representatives(docs), mixing.mixed_documents(docs, block_words=3), mixing.mixed_shards(docs, block_words=3, shards=2)):
        got = out.collect()
        assert got and set(docs.columns) <= set(out.columns)
        for r in got:
            own = [w for (d, _), w in want.items() if d == r.doc_id]
            assert any(all(r[c] == w[c] for c in docs.columns if c != "text") for w in own), r
    kept = near_dedup.representatives(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 3, 4, 5, 6, 20]


def test_repeated_ids_are_rows_of_their_own(spark):
    """The probe of an id in two rows: both are candidates, and as queries both are answered."""
    from lifetrail.llm import block_ann, voronoi_topk
    rows = [(0, [4.0, 2.0], 0), (1, [1.0, 2.0], 0), (1, [3.0, 2.0], 0), (2, [0.0, 1.0], 0)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    top = [(r.query_id, r["rank"], r.vec_id, r.score) for r in voronoi_topk.search(vectors).orderBy("rank").collect()]
    assert top == [(0, 1, 1, 16 * 64 * 64), (0, 2, 1, 8 * 64 * 64), (0, 3, 2, 2 * 64 * 64)]
    near = [(r.vec_id, r["rank"]) for r in block_ann.search(vectors).orderBy("rank").collect()]
    assert near == [(1, 1), (1, 2), (2, 3)]
    twice = spark.createDataFrame([(0, [1.0], 0), (0, [3.0], 0), (5, [2.0], 0)], "vec_id long, embedding array<float>, label int")
    assert sorted((r["rank"], r.vec_id, r.score) for r in voronoi_topk.search(twice).collect()) == sorted([(1, 0, 3 * 4096), (2, 5, 2 * 4096), (1, 5, 6 * 4096), (2, 0, 3 * 4096)])


def test_groups_of_long_texts_are_cut_by_their_elements(spark, monkeypatch):
    from lifetrail.llm import near_dedup
    monkeypatch.setattr(near_dedup, "CHUNK_ELEMENTS", 200)
    rows = [(i, " ".join(f"w{j}" if j != i else f"x{i}" for j in range(100))) for i in range(12)] + [(50, " ".join(f"z{j}" for j in range(80)))]
    got = {r.doc_id: r.class_id for r in near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {**{i: 0 for i in range(12)}, 50: 50}
