"""Near-duplicate classes by ProbMinHash.

A text's elements are its shingles of ``SHINGLE`` words (runs of letters,
digits and characters beyond ASCII, in lower case) weighted by how often
they occur; a text with fewer words is one element, a text without words
is its bytes.  The similarity is the probability Jaccard

    J_P(x, y) = sum_i 1 / sum_j max(x_j / x_i, y_j / y_i)   over shared i,

which for equal weights is the plain Jaccard of the sets.

1. Equal texts are one node.
2. ProbMinHash: each element is a Poisson process whose rate is its
   weight; every arrival falls on a register, which keeps the earliest
   one and its element.  Elements of a block of texts arrive in rounds,
   and an element stops as soon as its time is later than all of its
   text's registers.  Two texts agree in a register with probability J_P.
3. Banding: ``BANDS`` bands of ``ROWS`` registers; texts that agree in a
   band are candidates.  At similarity 0.8 a pair is missed with
   probability (1 - 0.8^4)^24 < 4e-6.
4. Verification: the candidates of a bucket go to the group of the
   bucket's smallest node (buckets with the same smallest node are one
   group, so a pair is not met again in every band).  Groups larger than
   ``CHUNK`` texts or ``CHUNK_ELEMENTS`` elements are cut into chunks, and
   each pair of chunks is a group of its own, so no group grows with the
   data.  Within a group products of
   incidence matrices bound all similarities from above; pairs that pass
   and are not yet connected are computed exactly.  A group returns a
   spanning forest of its links, not its pairs.
5. Classes are the connected components of the links, by repeated
   minimum labels and shortcuts with written tables between the steps.

Defined cases: a null text is in no class but its own; empty texts are
equal to each other; a null ``doc_id`` takes its class from the others
(null if there are none); a class is named by its smallest ``doc_id``;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lifetrail.llm.bpe import blocks_of
from lifetrail.llm.common import lean, materialise, release_if_large, whole_text
from lifetrail.llm.textbytes import expand, mix, piece_keys, text_buffers, word_spans

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
CHUNK = 128
#: Elements (12 bytes each) of a chunk; groups with long texts are cut into more chunks.
CHUNK_ELEMENTS = 1 << 18
#: Text that a task works on at a time; the temporary arrays take some thirty times as much.
BLOCK_BYTES = 2 << 20
#: Tables of candidates up to this size (rows times the bytes of one) are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
ROW_BYTES = 80
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- elements
def elements(column, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, element, weight) of a column of texts, by text and element."""
    data, offsets = text_buffers(pc.utf8_lower(pc.fill_null(column, "")))
    starts, ends = word_spans(data, offsets)
    key = piece_keys(data, starts, ends)
    first = np.searchsorted(starts, offsets)
    n_words = np.diff(first)
    n = np.where(n_words > 0, np.maximum(n_words - shingle + 1, 1), 0)
    at = expand(first[:-1], n)
    text = np.repeat(np.arange(len(n)), n)
    end = first[1:][text]
    h = np.zeros(len(at), np.uint64)
    for k in range(shingle):
        inside = at + k < end
        factor = mix(np.array([k + 1], np.uint64) * GOLDEN)[0] | np.uint64(1)
        h += np.where(inside, key[np.minimum(at + k, max(len(key) - 1, 0))] * factor, np.uint64(0)) if len(key) else np.uint64(0)
    h = mix(h)
    bare = np.flatnonzero(n == 0)
    if bare.size:
        own = np.array([xxhash.xxh3_64_intdigest(data[offsets[i]:offsets[i + 1]].tobytes()) for i in bare], np.uint64)
        text, h = np.concatenate([text, bare]), np.concatenate([h, own])
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    return text[at], h[at], np.diff(np.append(at, len(h)))


# ---------------------------------------------------------------- signatures
def signatures(text: np.ndarray, element: np.ndarray, weight: np.ndarray, n_texts: int, registers: int = BANDS * ROWS) -> np.ndarray:
    """ProbMinHash signatures (texts x registers) of elements sorted by text; a text without elements gets zeros."""
    time = np.full(n_texts * registers, np.inf)
    sign = np.zeros(n_texts * registers, np.uint64)
    count = np.bincount(text, minlength=n_texts)
    only = count[text] == 1  # a single element takes every register
    sign.reshape(n_texts, registers)[text[only]] = element[only, None]
    text, element, rate = text[~only], element[~only], weight[~only].astype(np.float64)
    t = np.zeros(len(text))
    step = 0
    while len(text):
        step += 1
        draw = mix(element + np.uint64(step * int(GOLDEN) % (1 << 64)))
        t = t - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 9007199254740992.0) / rate
        place = text * registers + (mix(draw ^ GOLDEN) % np.uint64(registers)).astype(np.int64)
        early = np.flatnonzero(t < time[place])
        np.minimum.at(time, place[early], t[early])
        won = early[time[place[early]] == t[early]]
        sign[place[won]] = element[won]
        latest = time.reshape(n_texts, registers).max(axis=1) if step < 4 or step % 8 == 0 else latest
        on = t < latest[text]
        text, element, rate, t = text[on], element[on], rate[on], t[on]
    return sign.reshape(n_texts, registers)


def band_keys(sign: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.zeros((len(sign), bands), np.uint64)
    for r in range(rows):
        out = mix(out * np.uint64(0x9DDFEA08EB382D69) + sign[:, r::rows][:, :bands])
    return out.view(np.int64)


def _bands(shingle: int, bands: int, rows: int, block_bytes: int):
    def run(batches):
        for batch in blocks_of(batches, block_bytes):
            found = elements(batch.column("text"), shingle)
            keys = band_keys(signatures(*found, batch.num_rows, bands * rows), bands, rows)
            n = pa.array(np.bincount(found[0], minlength=batch.num_rows), pa.int64())
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("node"), keys, n], names=["doc_id", "node", "bands", "n"])
    return run


# ---------------------------------------------------------------- verification
def probability_jaccard(xh, xw, yh, yw) -> float:
    """J_P of two texts' (sorted elements, weights)."""
    _, a, b = np.intersect1d(xh, yh, assume_unique=True, return_indices=True)
    if not len(a):
        return 0.0
    x, y = xw[a].astype(np.float64), yw[b].astype(np.float64)
    x_out, y_out = xw.sum() - x.sum(), yw.sum() - y.sum()
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    low, high = np.cumsum(x), y.sum() - np.cumsum(y)  # up to i the x side is larger, beyond it the y side
    return float((1 / ((x_out + low) / x + (y_out + high) / y)).sum())


def upper_bounds(texts: list[tuple[np.ndarray, np.ndarray]], width: int = 4096) -> np.ndarray:
    """For all pairs 1 / (1/X + 1/Y - 1), where X and Y are the shares of the
    texts' weights that lie on shared elements.  It is never below J_P, and
    equal to it where all weights of a text are equal."""
    row = np.repeat(np.arange(len(texts)), [len(h) for h, _ in texts])
    distinct, code = np.unique(np.concatenate([h for h, _ in texts]), return_inverse=True)
    share = np.concatenate([w / w.sum() for _, w in texts])
    often = np.bincount(code, minlength=len(distinct)) > 1
    column = (np.cumsum(often) - 1)[code]
    keep = often[code]
    row, column, share = row[keep], column[keep], share[keep]
    order = np.argsort(column, kind="stable")
    row, column, share = row[order], column[order], share[order]
    x = np.zeros((len(texts), len(texts)))
    for at in range(0, int(often.sum()), width):
        part = slice(*np.searchsorted(column, (at, at + width)))
        held, whole = np.zeros((len(texts), width)), np.zeros((len(texts), width))
        held[row[part], column[part] - at] = 1
        whole[row[part], column[part] - at] = share[part]
        x += whole @ held.T
    with np.errstate(divide="ignore"):
        return 1 / (1 / x + 1 / x.T - 1)


def forest(ids: np.ndarray, texts: list[tuple[np.ndarray, np.ndarray]], threshold: float) -> list[tuple[int, int]]:
    """Links that connect whatever is similar within a group: (member, its component's smallest member)."""
    root = np.arange(len(ids))
    bound = upper_bounds(texts)
    a, b = np.nonzero(np.triu(bound >= threshold - 1e-9, 1))
    order = np.argsort(-bound[a, b], kind="stable")
    for i, j in zip(a[order].tolist(), b[order].tolist()):
        if root[i] != root[j] and probability_jaccard(*texts[i], *texts[j]) >= threshold - 1e-9:
            one, other = sorted((root[i], root[j]))
            root[root == other] = one
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(root) if r != i]


def _verify(threshold: float):
    def run(group: pa.Table) -> pa.Table:
        release_if_large()
        ids, at = np.unique(group.column("node").to_numpy(), return_index=True)
        h, w = group.column("h").to_pylist(), group.column("w").to_pylist()
        texts = [(np.frombuffer(h[i], "<u8"), np.frombuffer(w[i], "<u4").astype(np.int64)) for i in at]
        links = forest(ids, texts, threshold) if len(ids) > 1 else []
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})
    return run


def _elements(shingle: int, block_bytes: int):
    def run(batches):
        for batch in blocks_of(batches, block_bytes):
            text, h, w = elements(batch.column("text"), shingle)
            cut = np.searchsorted(text, np.arange(batch.num_rows + 1))
            parts = list(zip(cut[:-1], cut[1:]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array([h[a:b].astype("<u8").tobytes() for a, b in parts], pa.binary()), pa.array([w[a:b].astype("<u4").tobytes() for a, b in parts], pa.binary())],
                names=["node", "h", "w"])
    return run


# ---------------------------------------------------------------- classes
def components(links: DataFrame) -> DataFrame:
    """``node, root`` (the smallest node of its component) from links ``a, b``."""
    edges = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "near-edges")
    label = materialise(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "near-labels")
    while True:
        near = edges.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("m"))
        new = label.join(near, "node").select("node", "root", F.least("root", "m").alias("to"))
        jump = label.select(F.col("node").alias("to"), F.col("root").alias("far"))
        new = materialise(new.join(jump, "to").select("node", F.col("root").alias("was"), F.least("to", "far").alias("root")), "near-labels")
        label = new.select("node", "root")
        if new.where("was <> root").limit(1).count() == 0:
            return label


def candidate_groups(nodes: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``hub, ca, cb, node``: the groups in which candidates are verified."""
    members = nodes.select("node", "n", F.posexplode("bands").alias("band", "key"))
    hubs = members.groupBy("band", "key").agg(F.min("node").alias("hub"), F.count("*").alias("size")).where("size > 1").drop("size")
    groups = materialise(members.join(hubs, ["band", "key"]).select("hub", "node", "n").distinct(), "near-groups")
    # only groups of more than a chunk are looked up, so the large side need not meet on a hot hub
    chunks = F.greatest(F.ceil(F.count("*") / chunk), F.ceil(F.sum("n") / CHUNK_ELEMENTS)).cast("int")
    large = materialise(groups.groupBy("hub").agg(chunks.alias("chunks")).where("chunks > 1"), "near-large")
    side = F.broadcast(large) if large.count() * ROW_BYTES <= BROADCAST_BYTES else large
    c = groups.join(side, "hub", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    c = c.withColumn("c", F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int"))
    return c.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("hub", F.least("c", "o").alias("ca"), F.greatest("c", "o").alias("cb"), "node")


def _keyed(docs: DataFrame) -> DataFrame:
    return whole_text(docs).withColumn("node", F.unhex(F.md5(F.col("text").cast("binary"))))


def text_classes(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, chunk: int = CHUNK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``text_key, first_id, root`` of every distinct text: texts of one class share ``root``."""
    keyed = _keyed(docs)
    found = keyed.where("node is not null").mapInArrow(lean(_bands(shingle, bands, rows, block_bytes)), "doc_id long, node binary, bands array<long>, n long")
    nodes = found.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.first("bands").alias("bands"), F.first("n").alias("n"))
    nodes = materialise(nodes.select(F.col("node").alias("text_key"), F.monotonically_increasing_id().alias("node"), "first_id", "bands", "n"), "near-nodes")

    groups = candidate_groups(nodes, chunk)
    wanted = materialise(groups.select("node").distinct().join(nodes.select("node", "text_key", "first_id"), "node"), "near-wanted")
    side = F.broadcast(wanted) if wanted.count() * ROW_BYTES <= BROADCAST_BYTES else wanted
    texts = keyed.select(F.col("doc_id").alias("d"), "text", F.col("node").alias("k")).join(side, (F.col("k") == F.col("text_key")) & F.col("d").eqNullSafe(F.col("first_id")))
    weighted = texts.select("node", "text").mapInArrow(lean(_elements(shingle, block_bytes)), "node long, h binary, w binary")
    links = groups.join(weighted, "node").groupBy("hub", "ca", "cb").applyInArrow(_verify(threshold), "a long, b long")
    root = components(materialise(links.distinct(), "near-links"))
    return nodes.select("text_key", "node", "first_id").join(root, "node", "left").select("text_key", "first_id", F.coalesce("root", "node").alias("root"))


def classes(docs: DataFrame, **settings) -> DataFrame:
    """``doc_id, class_id`` of every document."""
    found = materialise(text_classes(docs, **settings), "near-classes")
    name = found.groupBy("root").agg(F.min("first_id").alias("class_id"))
    named = found.join(name, "root").select("text_key", "class_id")
    out = _keyed(docs).select("doc_id", F.col("node").alias("text_key")).join(named, "text_key", "left")
    return out.select("doc_id", F.when(F.col("text_key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"))


def representatives(docs: DataFrame, **settings) -> DataFrame:
    """One row of ``docs`` for each class (its smallest ``doc_id``; of rows
    that share it the first), and all rows without text.  Columns pass
    through unchanged, whatever their names and types.

    Equal texts meet first, in an aggregation that keeps one row per task
    and text, so a hot text is never gathered."""
    found = materialise(text_classes(docs, **settings), "near-classes")
    first = F.min(F.struct(F.col("first_id").isNull().alias("unnamed"), "first_id", "text_key"))
    chosen = found.groupBy("root").agg(first.alias("m")).select(F.col("m.text_key").alias("key"))
    number = F.col("doc_id").cast("long")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("document"), F.unhex(F.md5(F.col("text").cast("string").cast("binary"))).alias("key"),
                       F.struct(number.isNull().alias("unnamed"), number.alias("doc_id"), F.monotonically_increasing_id().alias("row")).alias("place"))
    one = rows.where("key is not null").groupBy("key").agg(F.min_by("document", "place").alias("document"))
    kept = one.join(chosen, "key").select("document").union(rows.where("key is null").select("document"))
    return kept.select(*(F.col("document").getField(c).alias(c) for c in docs.columns))
