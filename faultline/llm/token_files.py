"""Token ids of documents in seekable Zstandard files.

File format: one Zstandard frame for each document, holding its ids as little-endian unsigned 32-bit integers; then a
skippable frame (magic ``0x184D2A50``) with each document's id as a signed 64-bit integer and a byte that is 1 if it is null;
last the seek table of the Zstandard seekable format: a skippable frame (``0x184D2A5E``) with compressed size, decompressed
size and the low 32 bits of the content's XXH64 of every frame (the index frame included, with decompressed size 0), then
the number of frames, a descriptor with the checksum flag and the magic ``0x8F92EAB1``.  Any Zstandard reader yields the ids
of all documents of a file; a reader that knows the table reads the footer and then only the frames it was asked for.

Documents are range-partitioned by id, one file a partition, numbered in the order of ids.  Files are written in the folder
that all executors share, under a name of their own for every attempt, and moved to the final name when whole, so a lost
executor or a second attempt leaves no half file.  A text's ids are the concatenation of those of its pre-tokens (see
``bpe_words``): the library encodes each new pre-token once, texts that are not plain as a whole.

Defined results: a null or empty text has only the end id; rows with a null id come first; equal ids are ordered by their
texts; no rows give no files and no result rows; the start of a document counts the ids of all before it.
"""

from __future__ import annotations

import array
import gc
import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import shared_dir

from .bpe_words import PRE_TOKENS, is_plain
from .common import held, text_pieces

PIECE_CHARS, CACHE_CHUNKS, FILE_ROWS, LEVEL = 2_000_000, 400_000, 10_000, 1
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
READ_SCHEMA = "file int, place long, doc_id long, start long, n_tokens long, ids_crc32 long"


class Encoder:
    """Ids of texts as bytes, by the library, with a bounded memory of chunks."""

    def __init__(self, path: str):
        # A task has one core; threads of its own would only compete with its neighbours.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.specials = [t.content for t in self.library.get_added_tokens_decoder().values()]
        vocabulary, ending = self.library.get_vocab(), self.library.model.end_of_word_suffix
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith(ending)]] = True
        self.chunks: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}

    def encode(self, texts: list[str | None]) -> list[bytes]:
        # Strings, bytes and lists of them: the collector would go through millions of them and find no cycle.
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self.looked_up(texts)
        finally:
            if collecting:
                gc.enable()

    def looked_up(self, texts: list[str | None]) -> list[bytes]:
        chunked = [t.split() if t and is_plain(t, self.specials) else None for t in texts]
        if len(self.chunks) > CACHE_CHUNKS:  # what recurs comes back from the older memory
            self.older, self.chunks = self.chunks, {}
        # One look-up a chunk; only those that are not there are gone through again.
        known = self.chunks.get
        found = [list(map(known, c)) if c else [] for c in chunked]
        new = [i for i, ids in enumerate(found) if None in ids]
        self.learn({c for i in new for c, ids in zip(chunked[i], found[i], strict=True) if ids is None})
        for i in new:
            found[i] = [known(c) if ids is None else ids for c, ids in zip(chunked[i], found[i], strict=True)]
        return [
            b"".join(ids) if c is not None else self.ids(t) if t else b""
            for t, c, ids in zip(texts, chunked, found, strict=True)
        ]

    def learn(self, chunks: set[str]) -> None:
        kept = {c: ids for c in chunks if (ids := self.older.get(c)) is not None}
        self.chunks.update(kept)
        parts = {c: PRE_TOKENS(c.lower()) for c in chunks.difference(kept)}
        if len(self.words) > CACHE_CHUNKS:
            self.older_words, self.words = self.words, {}
        wanted = set().union(*parts.values()).difference(self.words)
        kept = {w: ids for w in wanted if (ids := self.older_words.get(w)) is not None}
        self.words.update(kept)
        fresh = list(wanted.difference(kept))
        self.words.update(zip(fresh, self.words_ids(fresh), strict=True))
        word = self.words.__getitem__
        for chunk, words in parts.items():
            self.chunks[chunk] = b"".join(map(word, words))

    def ids(self, text: str) -> bytes:
        return array.array("I", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def words_ids(self, words: list[str]) -> list[bytes]:
        """Ids of pre-tokens.  Many are encoded as one text with blanks between them; the last id of each, and no other, closes a word."""
        out: list[bytes] = []
        for start in range(0, len(words), 1_000):
            content = self.ids(" ".join(words[start:start + 1_000]))
            ends = (4 * (np.flatnonzero(self.closes[np.frombuffer(content, "<u4")]) + 1)).tolist()
            out += [content[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        return out


def encoder(path: str) -> Encoder:
    return held(("token_files", path), lambda: Encoder(path))


def skippable(magic: int, content: bytes) -> bytes:
    return struct.pack("<II", magic, len(content)) + content


class FileWriter:
    """Writes frames to an open stream and remembers the table."""

    def __init__(self, stream):
        import zstandard

        self.stream, self.compress = stream, zstandard.ZstdCompressor(level=LEVEL, write_checksum=True).compress
        self.table, self.doc_ids, self.nulls = bytearray(), [], bytearray()

    def add(self, doc_id: int | None, content: bytes) -> None:
        import xxhash

        frame = self.compress(content)
        self.stream.write(frame)
        self.table += struct.pack("<III", len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF)
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)

    def finish(self) -> None:
        index = skippable(INDEX_MAGIC, np.array(self.doc_ids, "<i8").tobytes() + bytes(self.nulls))
        self.stream.write(index)
        self.table += struct.pack("<III", len(index), 0, 0)
        footer = struct.pack("<IBI", len(self.doc_ids) + 1, CHECKSUMS, FOOTER_MAGIC)
        self.stream.write(skippable(SEEK_MAGIC, bytes(self.table) + footer))


class FileReader:
    """Documents of a seekable source (``seek``, ``read``): the table is read at once, frames when asked for."""

    def __init__(self, source, size: int):
        self.source = source
        frames, descriptor, magic = struct.unpack("<IBI", self.piece(size - 9, 9))
        if magic != FOOTER_MAGIC or descriptor != CHECKSUMS:
            raise ValueError("no seek table with checksums at the end of the file")
        table = self.piece(size - 9 - 12 * frames, 12 * frames)
        self.table = np.frombuffer(table, "<u4").reshape(frames, 3)
        self.starts = np.r_[0, np.cumsum(self.table[:, 0], dtype=np.int64)]
        documents = frames - 1
        index = self.piece(int(self.starts[documents]) + 8, 9 * documents)
        self.doc_ids = np.frombuffer(index, "<i8", documents)
        self.nulls = np.frombuffer(index, np.uint8, documents, 8 * documents).astype(bool)

    def __len__(self) -> int:
        return len(self.doc_ids)

    def piece(self, start: int, size: int) -> bytes:
        self.source.seek(start)
        return self.source.read(size)

    def ids(self, place: int) -> bytes:
        """The packed ids of one document; ValueError if its checksum is wrong."""
        import xxhash
        import zstandard

        compressed, size, checksum = map(int, self.table[place])
        frame = self.piece(int(self.starts[place]), compressed)
        content = zstandard.ZstdDecompressor().decompress(frame, max_output_size=size) if size else b""
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {place} is damaged")
        return content


def filesystem(folder: str):
    """The file system of a folder and the folder's path there."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int | None = None, doc_id: str = "doc_id",
                      text: str = "text", file_rows: int = FILE_ROWS) -> DataFrame:
    """Writes the files (at once) and returns their manifest: file, name, documents, tokens."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    files = max(1, -(-rows.count() // file_rows), docs.sparkSession.sparkContext.defaultParallelism)
    # The text's hash too, so that rows which share an id, null included, are spread over files.
    dealt = rows.repartitionByRange(files, F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text")
    ending = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, writer, tokens = TaskContext.get().partitionId(), None, 0
        store, base = filesystem(folder)
        final = f"{base}/tokens-{number:08d}.zst"
        trial = f"{base}/.tokens-{number:08d}-{uuid.uuid4().hex}"
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for start, end in text_pieces(texts, PIECE_CHARS):
                for one, content in zip(ids[start:end], encoder(path).encode(texts[start:end]), strict=True):
                    if writer is None:
                        store.create_dir(base, recursive=True)
                        writer = FileWriter(store.open_output_stream(trial, compression=None))
                    writer.add(one, content + ending)
                    tokens += (len(content) + len(ending)) // 4
        if writer is not None:
            writer.finish()
            writer.stream.close()
            store.move(trial, final)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number], pa.int32()), pa.array([final.rpartition("/")[2]]),
                 pa.array([len(writer.doc_ids)], pa.int64()), pa.array([tokens], pa.int64())],
                names=["file", "name", "documents", "tokens"])

    manifest = dealt.mapInArrow(run, "file int, name string, documents long, tokens long")
    manifest.write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row for each document as the files have it: file, place, doc_id, start, n_tokens and the checksum of its ids.

    ``start`` is the number of ids before the document.  Those of earlier files are a running sum over the manifest, one
    row a file, which each reader is given with its file.
    """
    from pyspark.sql import Window

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", "name", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("first"))
    many = max(1, manifest.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = filesystem(folder)
        for batch in batches:
            for number, name, first in zip(*(batch.column(c).to_pylist() for c in ("file", "name", "first")), strict=True):
                with store.open_input_file(f"{base}/{name}") as source:
                    reader = FileReader(source, source.size())
                    sizes, sums = np.zeros(len(reader), np.int64), np.zeros(len(reader), np.int64)
                    for place in range(len(reader)):
                        content = reader.ids(place)
                        sizes[place], sums[place] = len(content) // 4, zlib.crc32(content)
                    starts = first + np.cumsum(sizes) - sizes
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(reader), number), pa.int32()), pa.array(np.arange(len(reader)), pa.int64()),
                         pa.array(reader.doc_ids, pa.int64(), mask=reader.nulls), pa.array(starts), pa.array(sizes), pa.array(sums)],
                        names=["file", "place", "doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(many, "file").mapInArrow(run, READ_SCHEMA)


def token_file_index(docs: DataFrame, path: str, end_id: int | None = None, **options) -> DataFrame:
    """Writes the files to a new shared folder and returns what reading them gives: doc_id, start, n_tokens, ids_crc32."""
    folder = shared_dir(docs.sparkSession, "token-files")
    manifest = write_token_files(docs, path, folder, end_id, **options)
    return read_token_files(manifest, folder).select("doc_id", "start", "n_tokens", "ids_crc32")
