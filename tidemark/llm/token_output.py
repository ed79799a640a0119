"""Token ids in binary files: independent zstandard frames, a trailing seek table, a checksum per frame.

A file is a row of zstandard frames, each holding the ids of whole documents (little-endian unsigned 32-bit
integers), then a skippable frame with the index of documents, then a seek table in the public zstandard
seekable format: per frame its compressed size, plain size and the low 32 bits of XXH64 of the plain bytes.
Any zstandard tool unpacks the file; a reader that wants a document reads the two tables at the end and
unpacks one frame.
"""

from __future__ import annotations

import functools
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import new_path, ship, slices, stage

FRAME_TOKENS = 1 << 16
# Fixed values of the public format.
SKIPPABLE, INDEX_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1

#: The byte-level vocabulary's own split of text into pieces, which it encodes one by one.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
#: Characters on whose classes all Unicode versions agree; other texts go to the library whole.
PLAIN = re.compile("[\t-\r -~¡-©«-¬®-±´¶-¸»¿-ʯ‐-‧]*")
WORD = re.compile(r" [^\W\d_]+")
#: Pieces of a generation of the cache; two are held.
CACHE = 300_000


class Encoder:
    """ids of whole texts by the tokenizers library; pieces that were seen before come from a bounded cache.

    The cache has two generations: when the younger is full it becomes the older one, from which pieces that occur again
    come back. So common pieces stay, however many others occur once.
    """

    def __init__(self, path: str, end_id: int | None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = b"" if end_id is None else struct.pack("<I", end_id)
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.spaced[[i for t, i in self.tokenizer.get_vocab().items() if t.startswith("Ġ")]] = True
        kind = repr(self.tokenizer.pre_tokenizer)
        self.by_piece = self.tokenizer.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def learn(self, new: set[str]) -> None:
        """Encode pieces that the cache lacks."""
        # Spaced words are encoded in one text: each of them starts with a token that starts with a space.
        words = [p for p in new if WORD.fullmatch(p)]
        if words:
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(words)], add_special_tokens=False)[0].ids, "<u4")
            cuts = (4 * np.flatnonzero(self.spaced[ids])).tolist()
            data = ids.tobytes()
            self.pieces.update(zip(words, map(data.__getitem__, map(slice, cuts, [*cuts[1:], len(data)])), strict=True))
        rest = list(new.difference(words))
        self.pieces.update(zip(rest, self.whole(rest), strict=True))

    def parts(self, text: str) -> list[str] | None:
        """The pieces of a text, where the vocabulary's split is known."""
        plain = self.by_piece and PLAIN.fullmatch(text) and not any(s in text for s in self.special)
        return PIECES.findall(text) if plain else None

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > CACHE:
            self.pieces, self.older = {}, self.pieces
        parts = [self.parts(t) for t in texts]
        if new := set().union(*filter(None, parts)).difference(self.pieces):
            again = new.intersection(self.older)
            self.pieces.update(zip(again, map(self.older.__getitem__, again), strict=True))
            self.learn(new.difference(again))
        # The library takes other texts as they are.
        others = iter(self.whole([t for p, t in zip(parts, texts, strict=True) if p is None]))
        return [(next(others) if p is None else b"".join(map(self.pieces.__getitem__, p))) + self.end for p in parts]


@functools.lru_cache(2)
def encoder_of(path: str, end_id: int | None) -> Encoder:
    """One per Python worker, whose later tasks find the pieces of its earlier ones."""
    return Encoder(path, end_id)


def write_frames(to, docs: Iterator[tuple[int | None, bytes]]) -> tuple[int, int]:
    """Write (doc id, id bytes) pairs in order to the open file; documents and ids written."""
    packer = zstandard.ZstdCompressor(level=1)
    ids, sizes, frames, held, size = [], [], [], [], 0

    def flush():
        nonlocal held, size
        if held:
            plain = b"".join(held)
            packed = packer.compress(plain)
            to.write(packed)
            frames.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
            held, size = [], 0

    for doc, data in docs:
        ids.append(doc)
        sizes.append(len(data) // 4)
        held.append(data)
        size += len(data)
        if size >= 4 * FRAME_TOKENS:
            flush()
    flush()
    null = np.packbits(np.array([d is None for d in ids], bool)).tobytes()
    table = packer.compress(np.array([d or 0 for d in ids], "<i8").tobytes() + np.array(sizes, "<u8").tobytes() + null)
    to.write(struct.pack("<II", INDEX_MAGIC, len(table)) + table)
    entries = b"".join(struct.pack("<III", *f) for f in frames)
    # The seek table: entries, number of frames, descriptor (checksums: bit 7), magic number.
    to.write(struct.pack("<II", SKIPPABLE, len(entries) + 9) + entries + struct.pack("<IBI", len(frames), 0x80, FOOTER_MAGIC))
    return len(ids), sum(sizes)


class FrameFile:
    """Random access to a file of write_frames: ``documents`` (ids and sizes), ``read(i)`` of one of them, ``scan()`` of all."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != FOOTER_MAGIC or not flags & 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = size - 9 - 12 * count
        file.seek(table)
        entries = np.frombuffer(file.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.starts = np.concatenate([[0], np.cumsum(entries[:, 0])])
        self.plain = np.concatenate([[0], np.cumsum(entries[:, 1])])
        self.sums = entries[:, 2]
        file.seek(int(self.starts[-1]))
        magic, length = struct.unpack("<II", file.read(8))
        if magic != INDEX_MAGIC or self.starts[-1] + 8 + length + 8 != table:
            raise ValueError("the index of documents is damaged")
        index = zstandard.ZstdDecompressor().decompress(file.read(length))
        n = (len(index) * 8) // 129
        self.doc_ids = np.frombuffer(index, "<i8", n)
        self.sizes = np.frombuffer(index, "<u8", n, 8 * n).astype(np.int64)
        self.null = np.unpackbits(np.frombuffer(index, np.uint8, offset=16 * n))[:n].astype(bool)
        self.offsets = 4 * np.concatenate([[0], np.cumsum(self.sizes)])

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.starts[k]))
        data = self.file.read(int(self.starts[k + 1] - self.starts[k]))
        plain = zstandard.ZstdDecompressor().decompress(data)
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.sums[k]:
            raise ValueError(f"frame {k} does not match its checksum")
        return plain

    def frame_of(self, i: int) -> int:
        return int(np.searchsorted(self.plain, self.offsets[i], "right")) - 1

    def read(self, i: int) -> np.ndarray:
        """The ids of the i-th document; one frame is unpacked."""
        if not self.sizes[i]:
            return np.zeros(0, "<u4")
        k = self.frame_of(i)
        at = int(self.offsets[i] - self.plain[k])
        return np.frombuffer(self.frame(k), "<u4", int(self.sizes[i]), at)

    def scan(self) -> Iterator[tuple[int | None, int, memoryview]]:
        """(doc id, ids before it in the file, id bytes) of all documents, a frame at a time."""
        k, plain = -1, b""
        for i in range(len(self.sizes)):
            if self.sizes[i] and (of := self.frame_of(i)) != k:
                k, plain = of, self.frame(of)
            at = int(self.offsets[i] - self.plain[max(k, 0)])
            yield None if self.null[i] else int(self.doc_ids[i]), int(self.offsets[i]) // 4, memoryview(plain)[at : at + 4 * int(self.sizes[i])]


def filesystem(uri: str):
    return pafs.FileSystem.from_uri(uri)


def _writer(folder: str, tokenizer: str, end_id: int | None):
    schema = pa.schema([("part", pa.int32()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer, end_id)
        first = next(batches := (s for s in slices(batches, "text")), None)
        if first is None:
            return

        def docs():
            for rows, _, _ in (first, *()):
                yield from pairs(rows)
            for rows, _, _ in batches:
                yield from pairs(rows)

        def pairs(rows):
            names = rows.schema.names
            ids = rows.column(names.index("id")).to_pylist()
            return zip(ids, encoder([t or "" for t in rows.column(names.index("text")).to_pylist()]), strict=True)

        # Written beside its place and moved there, so a task that is run again leaves one whole file.
        path, own = f"{folder}/part-{part:06d}.tokens.zst", f"{folder}/.part-{part:06d}-{uuid.uuid4().hex}"
        fs, at = filesystem(own)
        fs.create_dir(at.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(at) as to:
            n, tokens = write_frames(to, docs())
        fs.move(at, filesystem(path)[1])
        yield pa.RecordBatch.from_pydict({"part": [part], "path": [path], "docs": [n], "tokens": [tokens]}, schema=schema)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, folder: str | None = None) -> DataFrame:
    """Encode all texts into files in ascending order of id; returns part, path, docs, tokens, start of each file.

    Null text is empty (its document has the end id alone); null ids come first and are kept as null; rows
    that repeat an id are documents of their own; an empty table writes no file.
    """
    ship(docs.sparkSession)
    spark = docs.sparkSession
    folder = folder or new_path(spark, "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    ordered = rows.repartitionByRange(parts, F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first())
    files = stage(ordered.mapInArrow(_writer(folder, tokenizer, end_id), "part int, path string, docs long, tokens long"), "files")
    # One row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _reader(batches):
    schema = pa.schema([("id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
    for batch in batches:
        for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            fs, at = filesystem(path)
            with fs.open_input_file(at) as file:
                rows = [(doc, start + before, len(data) // 4, zlib.crc32(data)) for doc, before, data in FrameFile(file, file.size()).scan()]
            for i in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[i : i + 50_000], strict=True), schema, strict=True)], schema=schema)


def read_tokens(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document of the files of write_tokens: id, start, n_tokens, ids_crc32; every checksum is verified."""
    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("path", "start").repartition(n, "path").mapInArrow(_reader, "id long, start long, n_tokens long, ids_crc32 long").withColumnRenamed("id", id_col)
