"""Token ids in files of independent zstandard frames.

File format: one zstandard frame per document (its ids as little-endian
unsigned 32-bit integers), then a skippable frame with the ``doc_id`` of
each frame, then a skippable frame with the seek table of the public
zstandard seekable format: compressed size, decompressed size and
checksum (low 32 bits of XXH64 of the decompressed bytes) per frame,
number of frames, descriptor byte, magic number.  A reader loads the two
tables from the file's end and decompresses only the frames it needs,
checking each one's checksum.

Writing: documents are encoded and compressed where they are read, so
only compressed frames are shuffled.  They go to files by ranges of
``doc_id`` (bounds from the column's quantiles, one number per file) and
are streamed to the shared folder in ascending order; a file appears
under its final name only when it is complete, and a task that runs again
writes the same bytes.

Defined cases: a null text counts as empty (its only id is the end id); a
null ``doc_id`` sorts before all others; rows with equal ids stand side
by side, ordered by their ids' bytes; an empty table gives no files and
no rows; other columns are ignored.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import tiktoken
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lifetrail.llm.bpe import blocks_of, special_tokens, split_pieces, tokenizer, vocabulary_pieces
from lifetrail.llm.common import materialise, scratch_dir, whole_text
from lifetrail.llm.textbytes import expand, factorise

SKIPPABLE_IDS, SKIPPABLE_SEEK, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1  # fixed values of the format
DOCS_PER_FILE = 4096
BLOCK_BYTES = 4 << 20
MOST_READ_TASKS = 20_000
#: Words whose ids a worker remembers between its blocks.
REMEMBERED_WORDS = 1 << 17


# ---------------------------------------------------------------- the format
def write_file(out, frames: Iterable[tuple[int | None, bytes, int, int]]) -> tuple[int, int]:
    """Write (doc_id, frame, decompressed size, checksum) in order; returns frames and decompressed bytes."""
    ids, entries, total = [], [], 0
    for doc_id, frame, size, check in frames:
        out.write(frame)
        ids.append(doc_id)
        entries.append(struct.pack("<III", len(frame), size, check))
        total += size
    known = np.array([i is not None for i in ids], np.uint8).tobytes()
    directory = np.array([i or 0 for i in ids], "<i8").tobytes() + known
    out.write(struct.pack("<II", SKIPPABLE_IDS, len(directory)) + directory)
    table = b"".join(entries) + struct.pack("<IBI", len(entries), 0x80, SEEKABLE_MAGIC)
    out.write(struct.pack("<II", SKIPPABLE_SEEK, len(table)) + table)
    return len(entries), total


def read_tables(source) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, their validity and the seek table (offset, compressed, decompressed, checksum) of an open file."""
    end = source.size()
    source.seek(end - 9)
    count, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC or descriptor != 0x80:
        raise ValueError("not a seekable file with checksums")
    seek_at = end - 9 - 12 * count - 8
    source.seek(seek_at)
    if struct.unpack("<II", source.read(8)) != (SKIPPABLE_SEEK, 12 * count + 9):
        raise ValueError("broken seek table")
    table = np.frombuffer(source.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
    ids_at = seek_at - 9 * count - 8
    source.seek(ids_at)
    if struct.unpack("<II", source.read(8)) != (SKIPPABLE_IDS, 9 * count):
        raise ValueError("broken document directory")
    raw = source.read(9 * count)
    offset = np.cumsum(table[:, 0]) - table[:, 0]
    return np.frombuffer(raw, "<i8", count), np.frombuffer(raw, np.uint8, count, 8 * count).astype(bool), np.column_stack([offset, table])


def read_frame(source, entry) -> np.ndarray:
    """The ids of one document; raises when its checksum does not hold."""
    offset, packed, size, check = map(int, entry)
    source.seek(offset)
    raw = zstandard.ZstdDecompressor().decompress(source.read(packed), max_output_size=size)
    if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
        raise ValueError("checksum does not match")
    return np.frombuffer(raw, "<u4")


def read_documents(path: str, doc_ids: Iterable[int]) -> dict[int, np.ndarray]:
    """The ids of the named documents of one file; other frames stay compressed."""
    fs, at = pafs.FileSystem.from_uri(path)
    wanted = set(doc_ids)
    with fs.open_input_file(at) as source:
        ids, known, seek = read_tables(source)
        return {int(i): read_frame(source, e) for i, k, e in zip(ids, known, seek) if k and int(i) in wanted}


# ---------------------------------------------------------------- writing
_WORDS: dict[tuple[str, bytes], np.ndarray] = {}


@functools.cache
def word_encoder(path: str):
    """A function from one piece to its ids.  Where the file's ids are its
    merge ranks, the same merges run in the faster of the two libraries."""
    raw, start, length = vocabulary_pieces(path)
    blob, specials = raw.tobytes(), special_tokens(path)
    ranks = {blob[s:s + n]: i for i, (s, n) in enumerate(zip(start.tolist(), length.tolist())) if n and blob[s:s + n] not in specials}
    spec = json.load(open(path, encoding="utf-8"))["model"]
    merged = [spec["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in spec["merges"]]
    if merged == sorted(merged) and all(bytes([b]) in ranks for b in range(256)):
        return tiktoken.Encoding("file", pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    tok = tokenizer(path)
    return lambda word: tok.encode(word, add_special_tokens=False).ids


def _frames(path: str, end_id: int, level: int, block_bytes: int, bounds: list[int]):
    def run(batches):
        edges = np.array(bounds, np.int64)
        encode, specials = word_encoder(path), special_tokens(path)
        for batch in blocks_of(batches, block_bytes):
            data, starts, ends, first_piece = split_pieces(batch.column("text"), specials)
            codes, first = factorise(data, starts, ends)
            found = []
            raw = data.tobytes()
            for a, b in zip(starts[first].tolist(), ends[first].tolist()):
                word = raw[a:b]
                ids = _WORDS.get((path, word))
                if ids is None:
                    ids = [specials[word]] if word in specials else encode(word.decode("utf-8"))
                    if len(_WORDS) < REMEMBERED_WORDS:
                        _WORDS[path, word] = ids
                found.append(ids)
            length = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((i for ids in found for i in ids), "<u4", int(length.sum()))
            start = np.cumsum(length) - length
            pack = zstandard.ZstdCompressor(level=level)
            doc_ids, sizes, checks, frames = batch.column("doc_id"), [], [], []
            known = np.array([i is not None for i in doc_ids.to_pylist()], bool)
            file_no = pa.array(np.where(known, np.searchsorted(edges, pc.fill_null(doc_ids, 0).to_numpy(zero_copy_only=False)), 0), pa.int64())
            for a, b in zip(first_piece[:-1], first_piece[1:]):
                c = codes[a:b]
                ids = np.append(flat[expand(start[c], length[c])], np.uint32(end_id)).astype("<u4").tobytes()
                frames.append(pack.compress(ids))
                sizes.append(len(ids))
                checks.append(xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF)
            for k in range(0, len(frames), 512):
                yield pa.RecordBatch.from_arrays([file_no.slice(k, 512), doc_ids.slice(k, 512), pa.array(frames[k:k + 512], pa.binary()), pa.array(sizes[k:k + 512], pa.int64()), pa.array(checks[k:k + 512], pa.int64())], names=["file_no", "doc_id", "frame", "size", "check"])
    return run


INDEX_SCHEMA = "file_no long, file string, documents long, tokens long"


def _write_files(folder: str):
    def run(batches):
        def rows():
            for batch in batches:
                yield from zip(*(batch.column(c).to_pylist() for c in ("file_no", "doc_id", "frame", "size", "check")))

        fs, at = pafs.FileSystem.from_uri(folder)
        it = rows()
        row = next(it, None)
        while row is not None:
            file_no = row[0]

            def of_file():
                nonlocal row
                while row is not None and row[0] == file_no:
                    yield row[1:]
                    row = next(it, None)

            name = f"tokens-{file_no:07d}.zst"
            draft = f"{at}/.{name}.{np.random.default_rng().integers(1 << 62):x}"
            with fs.open_output_stream(draft) as out:
                count, size = write_file(out, of_file())
            if fs.get_file_info(f"{at}/{name}").type == pafs.FileType.NotFound:
                fs.move(draft, f"{at}/{name}")
            else:  # another attempt of this task has written the same bytes
                fs.delete_file(draft)
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file_no, f"{folder}/{name}", count, size // 4)], names=["file_no", "file", "documents", "tokens"])
    return run


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = 0, docs_per_file: int = DOCS_PER_FILE, level: int = 1, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Write all documents in ascending ``doc_id`` order; returns the index of the files (one row each)."""
    docs = whole_text(docs)
    n_files = max(1, -(-docs.count() // docs_per_file))
    bounds = sorted(set(docs.stat.approxQuantile("doc_id", [k / n_files for k in range(1, n_files)], 1 / (8 * n_files)))) if n_files > 1 else []
    frames = docs.mapInArrow(_frames(path, end_id, level, block_bytes, [int(b) for b in bounds]), "file_no long, doc_id long, frame binary, size long, check long")
    # a file's number names its partition, so every task writes one file
    ordered = frames.repartitionById(n_files, F.col("file_no").cast("int")).sortWithinPartitions("file_no", F.col("doc_id").asc_nulls_first(), "size", "check")
    return materialise(ordered.select("file_no", "doc_id", "frame", "size", "check").mapInArrow(_write_files(folder), INDEX_SCHEMA), "token-index")


# ---------------------------------------------------------------- reading
READ_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _read_files(batches):
    for batch in batches:
        for file, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
            fs, at = pafs.FileSystem.from_uri(file)
            with fs.open_input_file(at) as source:
                ids, known, seek = read_tables(source)
                crc = [zlib.crc32(read_frame(source, e).tobytes()) for e in seek]
            count = seek[:, 2] // 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64(), mask=~known), pa.array(start + np.cumsum(count) - count, pa.int64()), pa.array(count, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_digests(index: DataFrame) -> DataFrame:
    """Read all files back: per document its first position in the whole
    stream, its number of ids and their CRC-32.  Each file's start is a
    running sum over the index, which has one row per file."""
    start = F.sum("tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, -1))
    at = index.select("file_no", "file", F.coalesce(start, F.lit(0)).cast("long").alias("start"))
    tasks = min(MOST_READ_TASKS, max(1, index.count()))
    return at.repartitionById(tasks, F.pmod("file_no", F.lit(tasks)).cast("int")).select("file", "start").mapInArrow(_read_files, READ_SCHEMA)


def token_folder(spark: SparkSession) -> str:
    return scratch_dir(spark, "token-files")
