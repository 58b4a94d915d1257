"""BPE encoding and decoding over a distinct-word table.

Texts are split into pre-token pieces block by block (a block is at most
``block_bytes`` of text of one task).  A block keeps its documents as
piece numbers and hands on its distinct pieces, dealt into lanes by hash:
one packed list per lane.  The lanes are the word table: a lane gathers
the lists of all blocks, encodes each distinct word once, and returns
each list's ids in the list's order.  The block's documents then find
their ids by position.  Decoding joins ids to the vocabulary's pieces and
concatenates their bytes.

A piece is in a block's lists once however frequent it is, so there is no
hot key, and only packed lists and numbers are shuffled.

Defined cases: a null text counts as empty and has no ids; a null
``doc_id`` is kept; repeated rows are encoded one by one; other columns
are ignored; an empty table gives an empty result; special tokens of the
vocabulary that stand in a text become their ids, as in the library.
Limits: byte-level BPE files without normaliser, prefix blank or
post-processor (checked).
"""

from __future__ import annotations

import functools
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lifetrail.llm.common import lean, materialise_bucketed, release_if_large, whole_text
from lifetrail.llm.textbytes import bpe_piece_starts, expand, factorise, piece_keys, text_buffers

BLOCK_BYTES = 8 << 20
LEAST_LANES, MOST_LANES = 16, 1 << 16


@functools.cache
def tokenizer(path: str) -> Tokenizer:
    spec = json.load(open(path, encoding="utf-8"))
    pre = spec["pre_tokenizer"] or {}
    if spec["normalizer"] or spec["post_processor"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        raise ValueError(f"{path}: only plain byte-level BPE is supported")
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
        raise ValueError(f"{path}: only plain added tokens are supported")
    tok = Tokenizer.from_file(path)
    tok.no_padding()
    tok.no_truncation()
    return tok


@functools.cache
def special_tokens(path: str) -> dict[bytes, int]:
    return {t.content.encode(): i for i, t in tokenizer(path).get_added_tokens_decoder().items()}


@functools.cache
def vocabulary_pieces(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all vocabulary entries with each id's start and length."""
    tok = tokenizer(path)
    # the printable stand-ins that byte-level vocabularies use for bytes
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    byte_of = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    special = {i: s for s, i in special_tokens(path).items()}
    pieces = [b""] * (max(tok.get_vocab(with_added_tokens=True).values(), default=-1) + 1)
    for piece, i in tok.get_vocab(with_added_tokens=True).items():
        pieces[i] = special[i] if i in special else bytes(byte_of[c] for c in piece)
    length = np.array([len(p) for p in pieces], np.int64)
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(length) - length, length


def split_pieces(column, specials: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a column of texts, starts and ends of their pieces, and each text's first piece.

    A special token is cut out first, as a piece of its own."""
    data, offsets = text_buffers(column)
    raw = data.tobytes()
    cuts = [offsets]
    marks: list[int] = []
    if specials and any(s in raw for s in specials):
        for m in re.finditer(b"|".join(re.escape(s) for s in sorted(specials, key=len, reverse=True)), raw):
            if np.searchsorted(offsets, m.start(), side="right") == np.searchsorted(offsets, m.end(), side="left"):
                marks.append(m.start())
                cuts.append(np.array([m.start(), m.end()]))
    bounds = np.unique(np.concatenate(cuts)) if marks else offsets
    starts = bpe_piece_starts(data, bounds)
    if marks:  # whatever was split inside a special token is one piece
        ends = bounds[np.searchsorted(bounds, marks, side="right")]
        inside = np.zeros(len(data) + 1, bool)
        for a, b in zip(marks, ends):
            inside[a + 1:b] = True
        starts = starts[~inside[starts]]
    ends = np.append(starts[1:], len(data))
    return data, starts, ends, np.searchsorted(starts, offsets)


def blocks_of(batches, block_bytes: int):
    """Gather and cut Arrow batches into blocks of at most ``block_bytes`` of text (or one longer text)."""
    parts, held = [], 0
    for batch in batches:
        size = np.diff(text_buffers(batch.column("text"))[1])
        start = 0
        for i, s in enumerate(size):
            if held and held + s > block_bytes:
                parts.append(batch.slice(start, i - start))
                yield pa.concat_batches(parts)
                parts, held, start = [], 0, i
            held += int(s)
        if start < batch.num_rows:
            parts.append(batch.slice(start))
    if parts:
        yield pa.concat_batches(parts)


BLOCK_SCHEMA = "block string, doc_ids array<long>, counts binary, codes binary, lanes binary, words array<binary>"


def pack(values: np.ndarray) -> bytes:
    """Compressed unsigned 32-bit integers, byte by byte: all lowest bytes first."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return planes.reshape(4, -1).T.copy().view("<u4").ravel()


def pack_lists(flat: np.ndarray, lengths: np.ndarray) -> bytes:
    """Lists of bytes or of numbers, one after the other, with their lengths."""
    head = pack(lengths)
    body = zstandard.ZstdCompressor(level=1).compress(flat.tobytes()) if flat.dtype == np.uint8 else pack(flat)
    return len(head).to_bytes(4, "little") + head + body


def unpack_lists(raw: bytes, text: bool) -> tuple[np.ndarray, np.ndarray]:
    n = int.from_bytes(raw[:4], "little")
    head, body = raw[4:4 + n], raw[4 + n:]
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8) if text else unpack(body)
    return flat, unpack(head).astype(np.int64)


def _blocks(path: str, block_bytes: int, lanes: int):
    def run(batches):
        specials = special_tokens(path)
        task = TaskContext.get().partitionId()
        for k, batch in enumerate(blocks_of(batches, block_bytes)):
            data, starts, ends, first_piece = split_pieces(batch.column("text"), specials)
            codes, first = factorise(data, starts, ends)
            # frequent pieces get small numbers, which pack well
            order = np.argsort(-np.bincount(codes, minlength=len(first)), kind="stable")
            number = np.empty(len(first), np.int64)
            number[order] = np.arange(len(first))
            first = first[order]
            starts, length = starts[first], ends[first] - starts[first]
            lane = (piece_keys(data, starts, starts + length) % np.uint64(lanes)).astype(np.int64)
            words = []
            for p in range(lanes):
                of = np.flatnonzero(lane == p)
                words.append(pack_lists(data[expand(starts[of], length[of])], length[of]) if len(of) else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array([f"{task}-{k}"]), pa.array([batch.column("doc_id").to_pylist()], pa.list_(pa.int64())), pa.array([pack(np.diff(first_piece))]),
                 pa.array([pack(number[codes])]), pa.array([pack(lane)]), pa.array([words], pa.list_(pa.binary()))],
                names=["block", "doc_ids", "counts", "codes", "lanes", "words"])
    return run


def _encode_lane(path: str):
    """Encode each distinct word of a lane once; every block's list gets its ids back by position."""
    def run(lane: pa.Table) -> pa.Table:
        release_if_large()
        tok, specials = tokenizer(path), special_tokens(path)
        lists = [unpack_lists(w, True) for w in lane.column("words").to_pylist()]
        data, length = np.concatenate([d for d, _ in lists]), np.concatenate([n for _, n in lists])
        ends = np.cumsum(length)
        codes, first = factorise(data, ends - length, ends)
        raw = data.tobytes()
        words = [raw[e - n:e] for e, n in zip(ends[first].tolist(), length[first].tolist())]
        found = tok.encode_batch([w.decode("utf-8") for w in words], add_special_tokens=False)
        ids = [[specials[w]] if w in specials else e.ids for w, e in zip(words, found)]
        n_ids = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.uint32, int(n_ids.sum()))
        start = np.cumsum(n_ids) - n_ids
        cuts = np.cumsum([0, *(len(n) for _, n in lists)])
        out = [pack_lists(flat[expand(start[c], n_ids[c])], n_ids[c]) for c in (codes[a:b] for a, b in zip(cuts[:-1], cuts[1:]))]
        return pa.table({"of_block": lane.column("block"), "lane": lane.column("lane"), "ids": pa.array(out, pa.binary())})
    return run


def _join_ids(out):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: a block's documents; right: its lanes of ids."""
        release_if_large()
        ids = {row["lane"]: unpack_lists(row["ids"], False) for row in right.select(["lane", "ids"]).to_pylist()}
        names = sorted(ids)
        flat = np.concatenate([ids[p][0] for p in names]) if names else np.zeros(0, np.uint32)
        n_ids = np.concatenate([ids[p][1] for p in names]) if names else np.zeros(0, np.int64)
        tables = []
        for row in left.to_pylist():
            # position in the lanes of each piece number
            place = np.empty(len(n_ids), np.int64)
            place[np.argsort(unpack(row["lanes"]), kind="stable")] = np.arange(len(n_ids))
            start, length = (np.cumsum(n_ids) - n_ids)[place], n_ids[place]
            codes, counts = unpack(row["codes"]), unpack(row["counts"]).astype(np.int64)
            ends = np.cumsum(counts)
            tables.append(out(row["doc_ids"], ((flat, start[c], length[c]) for c in (codes[e - n:e] for e, n in zip(ends, counts)))))
        return pa.concat_tables(tables)
    return run


def lanes_for(text_bytes: int, block_bytes: int) -> int:
    """Number of lanes of the word table: in proportion to the blocks, within limits."""
    return int(min(MOST_LANES, max(LEAST_LANES, 2 * text_bytes // block_bytes)))


def _encoded(docs: DataFrame, path: str, block_bytes: int, out, schema: str) -> DataFrame:
    docs = whole_text(docs)
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    lanes = lanes_for(text_bytes, block_bytes)
    # bucketed by block: the documents' side of the last step is not shuffled
    blocks = materialise_bucketed(docs.mapInArrow(lean(_blocks(path, block_bytes, lanes)), BLOCK_SCHEMA), "bpe-blocks", "block", lanes)
    words = blocks.select("block", F.posexplode("words").alias("lane", "words")).where("words is not null")
    ids = words.groupBy("lane").applyInArrow(_encode_lane(path), "of_block string, lane int, ids binary")
    return blocks.drop("words").groupBy("block").cogroup(ids.groupBy("of_block")).applyInArrow(_join_ids(out), schema)


def encode(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id`` and ``ids`` (array of int) of every document."""
    def out(doc_ids, parts):
        ids = [flat[expand(start, length)].astype(np.int32) for flat, start, length in parts]
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "ids": pa.array(ids, pa.list_(pa.int32()))})
    return _encoded(docs, path, block_bytes, out, "doc_id long, ids array<int>")


def decode_ids(ids: np.ndarray, path: str) -> str:
    """The text of one document's ids: each id joined to its piece, invalid UTF-8 replaced."""
    raw, start, length = vocabulary_pieces(path)
    return raw[expand(start[ids], length[ids])].tobytes().decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id`` and ``text`` from ``doc_id`` and ``ids``.

    The vocabulary (its size is fixed by the tokenizer file, 50,257
    entries for the default) is the small side of the id-to-piece join:
    every task holds it as an array, and ids find their pieces by place."""
    def run(batches):
        for batch in batches:
            texts = [decode_ids(np.array(i or [], np.int64), path) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])
    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


DIGEST_SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip_digests(docs: DataFrame, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per document the number of ids, SHA-256 of the ids (little-endian
    unsigned 32-bit) and of the text decoded from them; the ids of a
    block are digested where they were joined and never shuffled."""
    def out(doc_ids, parts):
        rows = []
        for flat, start, length in parts:
            ids = flat[expand(start, length)]
            text = decode_ids(ids.astype(np.int64), path)
            rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()))
        return pa.table({"doc_id": pa.array(doc_ids, pa.int64()), "n_tokens": pa.array([r[0] for r in rows], pa.int64()),
                         "ids_sha256": pa.array([r[1] for r in rows], pa.string()), "decoded_sha256": pa.array([r[2] for r in rows], pa.string())})
    return _encoded(docs, path, block_bytes, out, DIGEST_SCHEMA)
