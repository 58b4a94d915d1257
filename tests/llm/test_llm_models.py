"""Language mixtures and random-string spans against models written out in plain Python."""

from __future__ import annotations

import collections
import math
import re
import unicodedata

import pytest
from conftest import SF001
from pyspark.sql import functions as F

from lifetrail.llm import language_id, secrets

MASK = (1 << 64) - 1


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


# ---------------------------------------------------------------- language mixtures
def plain_trigrams(text):
    words = "".join(c if unicodedata.category(c).startswith("L") else " " for c in (text or "").lower()).split()
    out = collections.Counter()
    for word in words:
        code = [0, *map(ord, word), 0]
        for a, b, c in zip(code, code[1:], code[2:]):
            h = ((a * 0x9E3779B97F4A7C15) & MASK) ^ ((b * 0xC2B2AE3D27D4EB4F) & MASK) ^ ((c * 0x165667B19E3779F9) & MASK)
            out[((h * 0xD6E8FEB86659FD93) & MASK) >> 48] += 1
    return out


def plain_model(rows):
    counts = collections.defaultdict(collections.Counter)
    for text, lang in rows:
        if lang is not None and text is not None and (found := plain_trigrams(text)):
            counts[lang].update(found)
    seen = len({b for c in counts.values() for b in c})
    return {lang: (c, sum(c.values()) + seen) for lang, c in sorted(counts.items())}


def plain_mixture(like, n, langs, rounds=400):
    """EM over the trigrams of one text: shares and log-likelihood."""
    share = {x: 1 / len(langs) for x in langs}
    total = sum(n.values())
    for _ in range(rounds):
        new = dict.fromkeys(langs, 0.0)
        for b, c in n.items():
            whole = sum(share[x] * like[b][x] for x in langs)
            for x in langs:
                new[x] += c * share[x] * like[b][x] / whole
        new = {x: v / total for x, v in new.items()}
        done = max(abs(new[x] - share[x]) for x in langs) < 1e-7
        share = new
        if done:
            break
    return share, sum(c * math.log(sum(share[x] * like[b][x] for x in langs)) for b, c in n.items())


def plain_prediction(model, text):
    n = plain_trigrams(text)
    if not n or not model:
        return "und", 0.0
    like = {b: {x: (c[b] + 0.5) / size for x, (c, size) in model.items()} for b in n}
    single = {x: sum(c * math.log(like[b][x]) for b, c in n.items()) for x in model}
    chosen = [max(single, key=lambda x: (single[x], [-ord(c) for c in x]))]
    share, value = {chosen[0]: 1.0}, single[chosen[0]]
    total = sum(n.values())
    sure = 1 / sum(math.exp((v - value) / 3) for v in single.values())
    while len(chosen) < len(model):
        slope = {x: sum(c * like[b][x] / sum(share[y] * like[b][y] for y in chosen) for b, c in n.items()) / total for x in model if x not in chosen}
        new = max(slope, key=slope.get)
        if slope[new] <= 1:
            break
        mixed, better = plain_mixture(like, n, [*chosen, new])
        if 2 * (better - value) / 3 <= math.log(total):
            break
        chosen, share, value = [*chosen, new], mixed, better
    best = max(share, key=share.get)
    return best, share[best] * sure


def test_language_mixtures_equal_plain_em(documents):
    rows = language_id.training_rows(documents)
    model = plain_model([(r.text, r.lang) for r in rows.collect()])
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.predict(documents, language_id.train(rows)).collect()}
    texts = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect() if len(r.text or "") < 6000]
    want = {d: plain_prediction(model, t) for d, t in texts}
    assert len(want) > 150
    same = [d for d in want if got[d][0] == want[d][0] and abs(got[d][1] - want[d][1]) < 0.02]
    assert len(same) >= 0.99 * len(want), [(got[d], want[d]) for d in want if d not in same][:5]


# ---------------------------------------------------------------- random strings
def plain_ratios(texts):
    counts = {True: collections.Counter(), False: collections.Counter()}
    fixed = re.compile(f"{secrets.HEX}|{secrets.ACCESS}")
    for t in texts:
        values = [m.group(2) for m in re.finditer(secrets.ASSIGN, t, re.A) if len(m.group(2)) >= 12]
        random = values + re.findall(secrets.ACCESS, t) + re.findall(secrets.HEX, t)
        plain = [w for w in re.findall(secrets.IDENTIFIER, t) if not fixed.search(w)]
        for label, tokens in ((True, random), (False, plain)):
            for w in tokens:
                counts[label].update(zip(w, w[1:]))
    size = len(secrets.ALPHABET)
    row = {label: collections.Counter() for label in counts}
    for label, c in counts.items():
        for (a, b), k in c.items():
            if a in secrets.ALPHABET and b in secrets.ALPHABET:
                row[label][a] += k

    def ratio(a, b):
        logs = [math.log((counts[x][a, b] + secrets.PSEUDO / size) / (row[x][a] + secrets.PSEUDO)) for x in (True, False)]
        return logs[0] - logs[1]
    return ratio


def plain_spans(t, ratio):
    fixed = [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, t, re.A) if len(m.group(2)) >= 12]
    fixed += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t)] + [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t)]
    inside = set()
    for a, _, b in fixed:
        inside.update(range(a, b))
    found = []
    for m in re.finditer(secrets.TOKEN, t):
        total = sum(round(ratio(a, b), 6) for a, b in zip(m.group(), m.group()[1:]))
        if total >= secrets.MARGIN and total >= secrets.PER_CHAR * (len(m.group()) - 1) and not set(range(m.start(), m.end())) <= inside:
            found.append((m.start(), 3, m.end()))
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(fixed + found))


def test_random_spans_equal_a_plain_markov_model(spark, documents):
    ids = "4fGh9kQz7LmN2pRsT8vWxY3 a/b/c/d/e/f/g/h/i/j/k some_ordinary_identifier_name QmFzZTY0IHRleHQgaXMgaGVyZSBvaw== word" * 3
    more = spark.createDataFrame([(10**6, ids), (10**6 + 1, f"x 0123456789abcdef{'Zq8' * 9} y")], "doc_id long, text string")
    docs = documents.select("doc_id", "text").unionByName(more)
    rows = [(r.doc_id, r.text or "") for r in docs.collect()]
    ratio = plain_ratios([t for _, t in rows])
    got = {r.doc_id: r.spans for r in secrets.scan(docs, secrets.train(secrets.labelled_tokens(docs))).collect()}
    want = {d: plain_spans(t, ratio) for d, t in rows}
    assert got == want and any("random" in s for s in want.values())
    assert docs.where(F.col("text").isNotNull()).count() > 100
