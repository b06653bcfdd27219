"""Operator 2: token-id files with a shared zstandard dictionary.

A file holds documents in ascending ``doc_id`` order. Each document's ids are little-endian integers of the file's width, compressed
on their own with one dictionary that all files share, so one short document is read without its neighbours::

    magic "TOKENS01" | width u8 | dictionary sha256 (32) | documents u64 | place of the index u64
    one zstandard frame per document
    index: doc_id i64 * n | known u8 * n | place u64 * (n + 1) | ids u32 * n

The dictionary is trained on the serialised ids of a bounded sample (it only serves compression): the ``SAMPLE_TEXTS`` distinct texts with
the smallest hash are encoded by tasks and cut in samples of ``SAMPLE_IDS``; ``SAMPLE_BYTES`` of these, again by hash, reach the driver. With
less than four times ``DICT_BYTES`` of them the dictionary is empty. It lies beside the files as ``<sha256>.dict``. Texts are range-partitioned by
``doc_id``, sorted and written by each task in files of about ``FILE_BYTES``; the table of files gives every file's
first place in the sequence of all ids.

Texts are encoded with the tokenizers library. White space only ever ends a word of the tokenizers that this takes (they cut at white
space and drop it), so texts are cut there, and what stands between is encoded by the library once and kept, in bounded bytes.

Defined results: a null text is an empty one and has just the end id. Rows without ``doc_id`` come first. Rows that repeat each other
are all kept, in any order among themselves. An empty table gives no files and no rows.
"""

from __future__ import annotations

import hashlib
import struct
from array import array
from collections.abc import Iterator
from string import punctuation

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from salesspark.llm.common import settled
from salesspark.llm.files import TaskFiles, file_system, read_whole
from salesspark.llm.kept import Kept, owns, working_for
from salesspark.plans.prefix import running_total

MAGIC = b"TOKENS01"
HEAD = struct.Struct("<8sB32sQQ")
DICT_BYTES, SAMPLE_TEXTS, SAMPLE_BYTES, SAMPLE_IDS = 65_536, 2_000, 4 << 20, 2_000
FILE_BYTES, LEVEL = 16 << 20, 1
#: Bytes of encoded pieces that a worker keeps, and the longest of them.
KEPT_BYTES, LONGEST = 256 << 20, 32
#: What a tokenizer is tried on: all letters, pairs of letters, letters beyond ASCII.
PROBES = ["".join(chr(97 + (i * j + k) % 26) for i in range(26)) for j in (1, 3, 5, 7, 9, 11) for k in (0, 1)] + list("abcxyzéßø") + [
    "the", "stationing", "überprüfung", "niñez", "élève", "œuvre", "łódź", "řeč", "þing"]
#: The letter that a byte-level model reads for each byte: printable Latin-1 for itself, the others from U+0100 on.
_OWN = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _OWN)}

FILES_SCHEMA = "part int, nth int, uri string, n_docs long, n_ids long, n_bytes long"


class WordEncoder:
    """Whole texts to little-endian u32 ids, by a tokenizer that cuts at white space and drops it.

    A piece of Latin letters, maybe with ASCII punctuation behind it, goes by its letters in lower case and its punctuation, if the tokenizer
    lower-cases and cuts between the two; and lower-case letters need neither normalising nor cutting, so they go straight to the library's
    merges. All else is encoded by the library as a whole. What the tokenizer does is tried on ``PROBES`` first.
    """

    def __init__(self, spec: str):
        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        for probe in ("a b", "a\nb\tc", " a  b\r\n"):
            if self.library(probe) != b"".join(self.library(x) for x in probe.split()):
                raise ValueError("this tokenizer does not drop white space between words")
        self.model = self.tokenizer.model
        own = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.folds = not any(c.isalpha() for c in own) and all(
            self.library(cased + tail) == self.library(w) + self.library(tail) for w in PROBES for cased in (w, w.title(), w.upper())
            if cased.lower() == w for tail in ("", ",", ".", "!?", "'", "$$$", "-"))
        self.merges = all(self.merged(w) == self.library(w) for w in PROBES)
        self.kept = Kept(self.piece, KEPT_BYTES, LONGEST)

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, letters: str) -> bytes:
        """Lower-case letters by the merges alone; the model reads bytes, each as a letter of its own."""
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(BYTE_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def piece(self, piece: str) -> bytes:
        """The ids of what stands between white space. The lower case may have no more than Latin letters: that of U+0130 ends in a mark,
        which punctuation joins."""
        core = piece.rstrip(punctuation)
        if self.folds and core.isalpha() and max(core) < "ɐ" and max(low := core.lower()) < "ɐ":
            if low != piece:
                return self.kept[low] + self.kept[piece[len(core):]] if core != piece else self.kept[low]
            if self.merges:
                return self.merged(low)
        return self.library(piece) if piece else b""

    def encode(self, text: str | None) -> bytes:
        for c in "\n\t\r":
            text = (text or "").replace(c, " ")
        return b"".join(map(self.kept.__getitem__, text.split(" ")))


_ENCODERS: dict[int, WordEncoder] = {}
owns("token_files", _ENCODERS.clear)


def encoder_of(spec: str) -> WordEncoder:
    if hash(spec) not in _ENCODERS:
        _ENCODERS[hash(spec)] = WordEncoder(spec)
    return _ENCODERS[hash(spec)]


def narrowed(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def train_dictionary(texts: DataFrame, spec: str, width: int) -> bytes:
    """Dictionary bytes from the sample; empty if the sample is too small to train on, when frames are made without dictionary."""
    hashed = texts.filter(F.length("text") > 0).withColumn("h", F.xxhash64("text"))
    chosen = hashed.select("h").distinct().orderBy("h").limit(SAMPLE_TEXTS).withColumnRenamed("h", "chosen")
    rows = hashed.join(F.broadcast(chosen), F.col("h") == F.col("chosen")).dropDuplicates(["h"]).select("h", "text")
    shared = texts.sparkSession.sparkContext.broadcast(spec)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("token_files")
        encoder, size = encoder_of(shared.value), SAMPLE_IDS * width
        for b in batches:
            for h, text in zip(b.column("h").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = narrowed(encoder.encode(text), width)
                cut = [ids[at:at + size] for at in range(0, len(ids), size)]
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int64()),
                                                  pa.array(cut, pa.binary())], ["h", "nth", "ids"])

    cut = rows.mapInArrow(samples, "h long, nth long, ids binary").orderBy(F.xxhash64("h", "nth"), "h", "nth")
    found = [bytes(r["ids"]) for r in cut.select("ids").limit(SAMPLE_BYTES // (SAMPLE_IDS * width)).collect()]
    found = [x for x in found if len(x) >= 8]
    if sum(map(len, found)) < 4 * DICT_BYTES or len(found) < 8:
        return b""
    return zstandard.train_dictionary(DICT_BYTES, found, k=64, d=8).as_bytes()


def write_file(rows: list[tuple[int | None, bytes]], width: int, digest: bytes) -> bytes:
    """The bytes of a file; rows: doc_id, frame and number of ids."""
    places = np.cumsum([HEAD.size] + [len(f) for _, f, _ in rows]).astype("<u8")
    head = HEAD.pack(MAGIC, width, digest, len(rows), int(places[-1]))
    return b"".join([head, *[f for _, f, _ in rows],
                     np.array([i or 0 for i, _, _ in rows], "<i8").tobytes(),
                     np.array([i is not None for i, _, _ in rows], "u1").tobytes(), places.tobytes(),
                     np.array([n for _, _, n in rows], "<u4").tobytes()])


class TokenFile:
    """Documents of one file: ``ids(k)`` reads the k-th alone."""

    def __init__(self, content: bytes, dictionary: bytes):
        magic, self.width, digest, self.n, at = HEAD.unpack_from(content)
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("no token file, or written with another dictionary")
        self.content, n = content, self.n
        self.doc_ids = np.frombuffer(content, "<i8", n, at)
        self.known = np.frombuffer(content, "u1", n, at + 8 * n)
        self.places = np.frombuffer(content, "<u8", n + 1, at + 9 * n)
        self.counts = np.frombuffer(content, "<u4", n, at + 9 * n + 8 * (n + 1))
        self.reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)

    def ids(self, k: int) -> np.ndarray:
        frame = self.content[int(self.places[k]):int(self.places[k + 1])]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}").astype("<u4")


def write_tokens(docs: DataFrame, uri: str, spec: str, end_id: int | None = 1, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """Write ``docs`` below ``uri``; the table of files in order, with ``first_place``, the ids before the file."""
    spark = docs.sparkSession
    largest = max(Tokenizer.from_str(spec).get_vocab_size(with_added_tokens=True) - 1, end_id or 0)
    width = 2 if largest < 1 << 16 else 4
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dictionary = train_dictionary(texts, spec, width)
    digest = hashlib.sha256(dictionary).digest()
    fs, path = file_system(uri)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{digest.hex()}.dict") as f:
        f.write(dictionary)
    shared = spark.sparkContext.broadcast((spec, dictionary))
    last = b"" if end_id is None else end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        working_for("token_files")
        spec, dictionary = shared.value
        encoder = encoder_of(spec)
        pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        files, rows, size = TaskFiles(uri, ".tok"), [], 0

        def flushed() -> pa.RecordBatch:
            content = write_file(rows, width, digest)
            part, nth = files.part, files.nth
            return pa.RecordBatch.from_pylist([{
                "part": part, "nth": nth, "uri": files.write(content), "n_docs": len(rows),
                "n_ids": sum(r[2] for r in rows), "n_bytes": len(content)}], schema=files_schema)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = encoder.encode(text) + last
                    rows.append((doc, pack.compress(narrowed(ids, width)), len(ids) // 4))
                    size += len(rows[-1][1])
                    if size >= FILE_BYTES:
                        yield flushed()
                        rows, size = [], 0
        if rows:
            yield flushed()

    files_schema = pa.schema([("part", pa.int32()), ("nth", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()),
                              ("n_ids", pa.int64()), ("n_bytes", pa.int64())])
    ordered = texts.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    written = settled(ordered.mapInArrow(run, FILES_SCHEMA))
    placed = running_total(written, "n_ids", [F.col("part"), F.col("nth")], out="upto")
    return placed.withColumn("first_place", F.col("upto") - F.col("n_ids")).drop("upto") \
        .withColumn("dictionary", F.lit(f"{uri.rstrip('/')}/{digest.hex()}.dict"))


def read_tokens(spark: SparkSession, files: DataFrame) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (little-endian u32) of every document of ``files``."""
    listed = settled(files.select("uri", "first_place", "dictionary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                f = TokenFile(read_whole(row["uri"]), read_whole(row["dictionary"]))
                starts = row["first_place"] + np.concatenate([[0], np.cumsum(f.counts, dtype=np.int64)])
                for at in range(0, f.n, 512):
                    end = min(f.n, at + 512)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.doc_ids[at:end], mask=f.known[at:end] == 0), pa.array(starts[at:end]),
                         pa.array(f.counts[at:end].astype(np.int64)),
                         pa.array([f.ids(k).tobytes() for k in range(at, end)], pa.binary())],
                        names=["doc_id", "start", "n_tokens", "ids"])

    n = max(1, listed.count())
    return listed.repartition(n, "uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
