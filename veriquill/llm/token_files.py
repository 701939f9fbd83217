"""Token-id files: independent zstandard frames with a trailing seek table and per-frame checksums.

A file holds documents in ascending order of id. Each document is one frame: its token ids and the end id as little-endian uint32. After the
frames come two skippable frames: the documents' ids (int64, NULL_ID for none) and the seek table of the zstandard seekable format, which has
for every frame its compressed and decompressed size and the low 32 bits of the xxh64 of its content. A reader of one document reads the
two tables and that document's bytes only.

Files are written by tasks under names of their own and count once the manifest, a Parquet table that Spark commits, names them; a task that
runs twice leaves a file that nothing names.

Defined results: null and empty texts hold the end id alone. Rows without an id come last. Repeated rows are written once each. No documents
give no files, an empty manifest and no rows.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .spark_io import materialize, partitions, shared_dir

END_ID = 0
NULL_ID = -(1 << 63)
#: Fixed values of the zstandard formats: skippable frames for the documents' ids and for the seek table, and the seek table's last bytes.
IDS_MAGIC, SEEK_MAGIC, SEEK_END = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
LEVEL = 1
#: Text for one file, and distinct pieces in each of the two generations that a task remembers the ids of.
FILE_CHARS = 16 << 20
REMEMBERED = 400_000
#: Rows of a manifest, about 100 bytes each, that are broadcast; beyond it they are joined by a shuffle.
BROADCAST_FILES = 200_000

#: The pre-tokens of the byte-level vocabulary, and texts in which this pattern and the library's are known to agree.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
PLAIN = regex.compile(r"[\t\n\r\x20-\x7E\xA1-\xAC\xAE-\u024F\u2010-\u2027\u2030-\u205E]*")
#: In texts without these a blank always begins a pre-token and a newline always is one.
WIDE_SPACES = ("  ", " \n", "\n ", "\n\n", "\t", "\r")
#: The bytes of the vocabulary: printable ones stand for themselves, the others for characters from 256 on.
_OWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in _OWN)}


class Encoder:
    """Ids of a text as the tokenizers library gives them.

    Texts of plain characters are cut before blanks and around newlines, which are borders of pre-tokens. Each piece's ids are remembered in
    two generations: when the younger is full it takes the older one's place.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}
        self.marks = {m: self._tokens([m]) for m in ".,"}

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _tokens(self, words: list[str]) -> bytes:
        return np.array([t.id for w in words for t in self.model.tokenize(w.encode().decode("latin-1").translate(BYTE_CHARS))], "<u4").tobytes()

    def _learn(self, piece: str) -> bytes:
        """The ids of a new piece; those of a word before a full stop or comma are looked up first."""
        if piece in self.known:
            return self.known[piece]
        ids = self.older.get(piece)
        if ids is None:
            word, mark = piece[:-1], piece[-1]
            if mark in self.marks and word and word[-1].isalnum():
                ids = self._learn(word) + self.marks[mark]
            else:
                ids = self._tokens([piece] if piece.lstrip(" ").isalpha() and piece[:2] != "  " else PRETOKEN.findall(piece))
        self.known[piece] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text) or any(s in text for s in self.specials):
            return self._whole(text)
        if any(s in text for s in WIDE_SPACES):
            pieces = PRETOKEN.findall(text)
        else:
            pieces = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        known, learn = self.known, self._learn
        try:
            out = b"".join([known[p] for p in pieces])
        except KeyError:
            out = b"".join([known[p] if p in known else learn(p) for p in pieces])
            if len(known) > REMEMBERED:
                self.older, self.known = known, {"": b""}
        return out


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class FrameFile:
    """The bytes of one file, document by document."""

    def __init__(self, level: int = LEVEL):
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=True)
        self.parts: list[bytes] = []
        self.ids: list[int] = []
        self.seek: list[bytes] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        frame = self.pack.compress(ids)
        self.parts.append(frame)
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.seek.append(struct.pack("<III", len(frame), len(ids), xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF))
        self.tokens += len(ids) // 4

    def bytes(self) -> bytes:
        ids = self.pack.compress(np.array(self.ids, "<i8").tobytes())
        ids = struct.pack("<II", IDS_MAGIC, len(ids)) + ids
        # the table's own entries: the frames, and the ids as a frame of no content
        table = b"".join(self.seek) + struct.pack("<III", len(ids), 0, 0)
        foot = struct.pack("<IBI", len(self.seek) + 1, 0x80, SEEK_END)
        return b"".join(self.parts) + ids + struct.pack("<II", SEEK_MAGIC, len(table) + len(foot)) + table + foot


class FrameReader:
    """Reads a file through fetch(offset, length): the tables first, then the frames that are asked for."""

    def __init__(self, length: int, fetch):
        self.fetch = fetch
        frames, kind, end = struct.unpack("<IBI", fetch(length - 9, 9))
        if end != SEEK_END or kind != 0x80:
            raise ValueError("no seek table with checksums at the end of the file")
        table = np.frombuffer(fetch(length - 9 - 12 * frames, 12 * frames), "<u4").reshape(-1, 3)
        starts = np.concatenate(([0], np.cumsum(table[:, 0], dtype=np.int64)))
        at, size = int(starts[-2]), int(table[-1, 0])
        self.table, self.starts = table[:-1], starts[:-2] if frames > 1 else starts[:0]
        self.doc_ids = np.frombuffer(zstandard.ZstdDecompressor().decompress(fetch(at + 8, size - 8)), "<i8")
        self.unpack = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        """The ids of the i-th document; ValueError if its checksum is not that of the seek table."""
        size, full, check = (int(x) for x in self.table[i])
        ids = self.unpack.decompress(self.fetch(int(self.starts[i]), size), max_output_size=full)
        if xxhash.xxh64_intdigest(ids) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {i} is damaged")
        return ids


def reader_of(data: bytes) -> FrameReader:
    view = memoryview(data)
    return FrameReader(len(data), lambda at, n: bytes(view[at : at + n]))


def _write(folder: str, vocabulary: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, encode, n = FrameFile(), encoder(vocabulary), 0
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                out.add(doc_id, (encode(text) if text else b"") + end)
                n += 1
        if not n:
            return
        part, name = TaskContext.get().partitionId(), f"{uuid.uuid4().hex}.tokens"
        fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
        fs.create_dir(path, recursive=True)
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(out.bytes())
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "file": [name], "n_docs": pa.array([n], pa.int64()), "tokens": pa.array([out.tokens], pa.int64())})

    return write


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None) -> tuple[str, DataFrame]:
    """Write docs (doc_id, text) as token files in ascending order of doc_id; (folder, manifest: part, file, n_docs, tokens, start)."""
    folder = folder or shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    files = max(partitions(docs), chars // FILE_CHARS)
    key = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    dealt = docs.repartitionByRange(files, *key).sortWithinPartitions(*key, "text")
    manifest = materialize(dealt.mapInArrow(_write(folder, vocabulary), "part long, file string, n_docs long, tokens long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return folder, manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("content"), strict=True):
            reader, rows = reader_of(data.as_buffer()), []
            for i, doc_id in enumerate(reader.doc_ids.tolist()):
                ids = reader.frame(i)
                rows.append((None if doc_id == NULL_ID else doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                start += len(ids) // 4
            yield pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in rows], pa.int64()) for k, c in enumerate(("doc_id", "start", "n_tokens", "ids_crc32"))})


def read_token_files(folder: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files that the manifest names."""
    spark, n = manifest.sparkSession, manifest.count()
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not n:
        return spark.createDataFrame([], schema)
    files = spark.read.format("binaryFile").load(f"{folder}/*.tokens").select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    starts = manifest.select("file", "start")
    starts = F.broadcast(starts) if n <= BROADCAST_FILES else starts
    return files.join(starts, "file").select("start", "content").mapInArrow(_read, schema)
