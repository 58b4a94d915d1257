"""Text operators against brute force, on the provided tables and on odd documents."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF001
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import no_docs, odd_docs  # noqa: F401

from lifetrail.llm import bpe, language_id, licenses, near_dedup, secrets, token_files
from lifetrail.llm.common import TOKENIZER
from lifetrail.llm.contract import QUERIES
from lifetrail.llm.textbytes import factorise, mix


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(TOKENIZER)


def pairs(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---------------------------------------------------------------- BPE
ALPHABET = st.sampled_from(["a", "b", "'s", "'", "'ll", " ", "  ", "\n", "\t", " ", "　", "é", "1", "²", "!", "日", "😀", "<|endoftext|>", "\x00", "\x1c", "\x85"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(ALPHABET, max_size=12).map("".join), min_size=1, max_size=6))
def test_pieces_encode_as_the_library_does(texts):
    tok, specials = bpe.tokenizer(TOKENIZER), bpe.special_tokens(TOKENIZER)
    data, starts, ends, first = bpe.split_pieces(pa.array(texts), specials)
    for i, text in enumerate(texts):
        ids = []
        for a, b in zip(starts[first[i]:first[i + 1]], ends[first[i]:first[i + 1]]):
            w = data[a:b].tobytes()
            ids += [specials[w]] if w in specials else tok.encode(w.decode(), add_special_tokens=False).ids
        assert ids == tok.encode(text, add_special_tokens=False).ids
        assert bpe.decode_ids(np.array(ids, np.int64), TOKENIZER) == tok.decode(ids, skip_special_tokens=False)


def test_factorise_numbers_equal_pieces_alike():
    words = [b"a", b"bb", b"a", b"x" * 40, b"x" * 41, b"x" * 40, b"", b"y" * 3000, b"y" * 3000]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    codes, first = factorise(data, ends - [len(w) for w in words], ends)
    assert [words[first[c]] for c in codes] == words and len(first) == len(set(words))


def digest_rows(rows, library):
    out = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_bpe_query_equals_the_library(spark, documents, library):
    want = digest_rows(documents.select("doc_id", "text").collect(), library)
    assert pairs(QUERIES["op3_distinct_word_bpe"](spark, SF001)) == want


def test_bpe_odd_documents_in_small_blocks(odd_docs, no_docs, library):
    want = digest_rows(odd_docs.select("doc_id", "text").collect(), library)
    assert pairs(bpe.round_trip_digests(odd_docs, TOKENIZER, block_bytes=64)) == want
    assert bpe.round_trip_digests(no_docs, TOKENIZER).count() == 0
    back = bpe.decode(bpe.encode(odd_docs, TOKENIZER, block_bytes=64), TOKENIZER)
    assert pairs(back) == sorted(((r.doc_id, r.text or "") for r in odd_docs.collect()), key=repr)


# ---------------------------------------------------------------- token files
def file_rows(rows, library):
    encoded = [(d, library.encode(t or "", add_special_tokens=False).ids + [0]) for d, t in rows]
    encoded = [(d, np.array(i, "<u4").tobytes()) for d, i in encoded]
    encoded.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1])))
    out, start = [], 0
    for d, raw in encoded:
        out.append((d, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    return sorted(out, key=repr)


def test_token_files_query(spark, documents, library):
    assert pairs(QUERIES["op7_seekable_token_files"](spark, SF001)) == file_rows(documents.select("doc_id", "text").collect(), library)


def test_token_files_odd_documents(spark, odd_docs, no_docs, library):
    index = token_files.write_token_files(odd_docs, TOKENIZER, token_files.token_folder(spark), docs_per_file=3, block_bytes=64)
    assert index.count() > 1
    assert pairs(token_files.read_digests(index)) == file_rows(odd_docs.select("doc_id", "text").collect(), library)
    assert token_files.read_digests(token_files.write_token_files(no_docs, TOKENIZER, token_files.token_folder(spark))).count() == 0


def test_token_files_read_only_what_is_asked_and_check_it(spark, odd_docs, library, tmp_path):
    index = token_files.write_token_files(odd_docs, TOKENIZER, token_files.token_folder(spark), docs_per_file=100).collect()
    file = index[0].file
    ids = token_files.read_documents(file, [7])
    assert list(ids) == [7] and ids[7].tolist() == library.encode(odd_docs.where("doc_id = 7").first().text, add_special_tokens=False).ids + [0]
    import pyarrow.fs as pafs
    fs, at = pafs.FileSystem.from_uri(file)
    raw = bytearray(fs.open_input_file(at).read())
    _, _, seek = token_files.read_tables(pa.BufferReader(bytes(raw)))
    offset, packed = int(seek[-1][0]), int(seek[-1][1])
    raw[offset + packed - 1] ^= 0xFF
    with pytest.raises(Exception):
        token_files.read_frame(pa.BufferReader(bytes(raw)), seek[-1])


# ---------------------------------------------------------------- language
def test_language_held_out_accuracy(spark, documents):
    truth = {r.doc_id: r.lang for r in documents.select("doc_id", "lang").collect()}
    rows = QUERIES["op1_language_mixture"](spark, SF001).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_mixture_proportions(spark, documents):
    langs, table = model = language_id.train(language_id.training_rows(documents))
    text = {l: " ".join(r.text for r in documents.where(f"lang = '{l}'").limit(5).collect())[:6000] for l in ("de", "fr")}
    bucket, n = language_id.trigrams(text["de"][:4000] + " " + text["fr"][:2000])
    share, _ = language_id.infer(bucket, n.astype(float), table)
    got = dict(zip(langs, share))
    assert abs(got["de"] - 2 / 3) < 0.1 and abs(got["fr"] - 1 / 3) < 0.1
    one, _ = language_id.infer(*[x.astype(float) if k else x for k, x in enumerate(language_id.trigrams(text["fr"]))], table)
    assert (one > 0).sum() == 1
    short = language_id.predict(spark.createDataFrame([(1, None), (2, ""), (3, "12 !")], "doc_id long, text string"), model).collect()
    assert [(r.lang_pred, r.score) for r in short] == [("und", 0.0)] * 3


def test_language_odd_documents(odd_docs, no_docs):
    model = language_id.train(language_id.training_rows(odd_docs))
    out = language_id.annotate(odd_docs, model)
    assert out.count() == odd_docs.count() and out.columns[-3:] == ["lang_pred", "score", "shares"]
    empty = language_id.train(language_id.training_rows(no_docs))
    assert {r.lang_pred for r in language_id.predict(odd_docs, empty).collect()} == {"und"}
    assert language_id.predict(no_docs, model).count() == 0


# ---------------------------------------------------------------- near copies
def brute_classes(rows):
    """Classes by all pairs of texts that share an element."""
    ids, texts = [r[0] for r in rows], [r[1] for r in rows]
    number, h, w = near_dedup.elements(pa.array(texts, pa.string()))
    cut = np.searchsorted(number, np.arange(len(ids) + 1))
    sets = [(h[a:b], w[a:b]) for a, b in zip(cut[:-1], cut[1:])]
    holders = collections.defaultdict(list)
    for k, (e, _) in enumerate(sets):
        if texts[k] is not None:
            for x in e.tolist():
                holders[x].append(k)
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in {(a, b) for held in holders.values() for n, a in enumerate(held) for b in held[n + 1:]}:
        if near_dedup.probability_jaccard(*sets[i], *sets[j]) >= 0.8 - 1e-9:
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    name = {}
    for k in range(len(ids)):
        if ids[k] is not None:
            name[find(k)] = min(name.get(find(k), ids[k]), ids[k])
    return sorted(((ids[k], name.get(find(k))) for k in range(len(ids))), key=repr)


def test_near_copies_query(spark, documents):
    want = brute_classes([tuple(r) for r in documents.select("doc_id", "text").collect()])
    assert pairs(QUERIES["op2_probminhash_dedup"](spark, SF001)) == want


def test_near_copies_of_a_chain_and_large_groups(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join(base)) for k in range(40)]  # equal
    for k in range(40, 400):  # near copies with one to five words changed: more than two chunks
        words = list(base)
        for at in rng.integers(0, 120, rng.integers(1, 6)):
            words[at] = f"x{k}-{at}"
        rows.append((k, " ".join(words)))
    rows += [(k, " ".join(f"v{k}-{j}" for j in range(60))) for k in range(400, 430)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert pairs(near_dedup.classes(docs, chunk=64)) == brute_classes(rows)


def test_near_copies_odd_documents(odd_docs, no_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert pairs(near_dedup.classes(odd_docs)) == brute_classes(rows)
    kept = near_dedup.representatives(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert near_dedup.classes(no_docs).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=8), st.lists(st.integers(1, 5), min_size=1, max_size=8), st.integers(0, 8))
def test_probability_jaccard_and_its_bound(a, b, shared):
    x = (np.arange(len(a), dtype=np.uint64), np.array(a))
    shift = max(0, len(a) - shared)
    y = (np.arange(shift, shift + len(b), dtype=np.uint64), np.array(b))
    px, py = dict(zip(x[0].tolist(), a)), dict(zip(y[0].tolist(), b))
    want = sum(1 / sum(max(px.get(j, 0) / px[i], py.get(j, 0) / py[i]) for j in px | py) for i in px if i in py)
    assert near_dedup.probability_jaccard(*x, *y) == pytest.approx(want)
    assert near_dedup.upper_bounds([x, y])[0, 1] >= want - 1e-9


def test_signatures_estimate_probability_jaccard():
    rng = np.random.default_rng(3)
    texts = [(np.sort(rng.choice(60, 40, replace=False)).astype(np.uint64), rng.integers(1, 4, 40)) for _ in range(2)]
    h = mix(np.concatenate([t[0] for t in texts]))
    sign = near_dedup.signatures(np.repeat([0, 1], 40), h, np.concatenate([t[1] for t in texts]), 2, registers=4096)
    assert abs((sign[0] == sign[1]).mean() - near_dedup.probability_jaccard(*texts[0], *texts[1])) < 0.04


# ---------------------------------------------------------------- licenses
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TINY = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_licenses(text):
    text = (text or "").translate(TINY)
    words = WORD.findall(text)
    base = [(k, label) for phrase, label in licenses.PHRASES.items() for k in range(len(words)) if words[k:k + len(phrase.split())] == phrase.split()]
    best, met = 1.0 if base else 0.0, set()
    for line in text.split("\n"):
        held = set(WORD.findall(line))
        for label, template in licenses.TEMPLATES:
            t = set(licenses.template_words(template))
            if len(held & t) >= 0.8 * len(t) - 1e-9:
                met.add(label)
                best = max(best, len(held & t) / len(t))
    at = [k for k, _ in base]
    labels = lambda s: ",".join(sorted(s))
    return len(words), len(base), min(at, default=None), max(at, default=None), labels({x for _, x in base}), labels({x for _, x in base} | met), best


def test_license_scan(spark, documents, odd_docs, no_docs):
    notices = spark.createDataFrame(
        [(1, "x\nReleased under the MIT License."), (2, "MIT\nlicense"), (3, "licensed UNDER cc by-nc 4.0 now"), (4, "Released under MIT License"),
         (5, "apache license mit license apache license"), (6, "under the\nlicense"), (7, "Licensed  under the Apache-License: version 2")], "doc_id long, text string")
    for docs in (documents, odd_docs, notices):
        rows = docs.select("doc_id", "text").collect()
        assert pairs(licenses.scan(docs)) == sorted(((d, *brute_licenses(t)) for d, t in rows), key=repr)
    assert licenses.scan(no_docs).count() == 0


# ---------------------------------------------------------------- secrets
KINDS = [
    ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def brute_secrets(text):
    found = [[m for m in r.finditer(text or "") if ok(m)] for _, r, ok in KINDS]
    spans = sorted((m.start(), k, f"{KINDS[k][0]}:{m.start()}:{m.end()}") for k, ms in enumerate(found) for m in ms)
    return (*map(len, found), hashlib.sha256(",".join(s for *_, s in spans).encode()).hexdigest())


def test_secret_scan_base(spark, documents, odd_docs, no_docs):
    tricky = spark.createDataFrame(
        [(1, "😀 token=secret=abcdefghijklmnop"), (2, "token = secret = abcdefghijklmn"), (3, "Api_Key:'A.B-C_D/E+F=123' é AKIA" + "A" * 14),
         (4, "AKIAAKIAAKIAAKIA12 AKIA" + "0" * 13), (5, "0123456789abcdef0123456789ABCDEF"), (6, "passwordtoken=" + "x" * 12 + " secret:short")], "doc_id long, text string")
    for docs in (documents, odd_docs, tricky):
        ratios = secrets.train(secrets.labelled_tokens(documents))
        got = secrets.scan(docs, ratios).drop("spans")
        assert pairs(got) == sorted(((d, *brute_secrets(t)) for d, t in docs.select("doc_id", "text").collect()), key=repr)
    assert secrets.scan(no_docs, secrets.train(secrets.labelled_tokens(no_docs))).count() == 0


def test_secret_scan_markov(spark, documents):
    ratios = secrets.train(secrets.labelled_tokens(documents))
    docs = spark.createDataFrame(
        [(1, "the key qX7fK2mZ9LwT4vBn8RcY here"), (2, "internationalisation_of_the_thing anthththionerethe"), (3, "token = 24be64439e3e49cf46b2d7c90f3602a3d0b907ff")], "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in secrets.scan(docs, ratios).collect()}
    assert spans[1] == "random:8:28" and spans[2] == "" and spans[3] == "assign:0:48,hex:8:48"
    clean = {r.doc_id: r.text for r in secrets.redact(docs, ratios).collect()}
    assert clean == {1: "the key [SECRET] here", 2: "internationalisation_of_the_thing anthththionerethe", 3: "[SECRET]"}


def test_redact_keeps_everything_else(odd_docs):
    ratios = [0.0] * (128 * 128)
    before, after = pairs(odd_docs.select("doc_id", "text").where("doc_id <> 9 or doc_id is null")), secrets.redact(odd_docs, ratios)
    assert after.columns == odd_docs.columns
    assert pairs(after.select("doc_id", "text").where("doc_id <> 9 or doc_id is null")) == before
    assert after.where("doc_id = 9").first().text == '[SECRET]" [SECRET] [SECRET]'
