"""Operator 1: token ids as binary shards with a shared zstandard dictionary.

Layout of a store folder: ``dictionary`` (trained on serialized id arrays of a
bounded sample), one ``shard-NNNNN`` per range of doc_id, and ``manifest.json``
(dictionary hash, id width, and for each shard its documents, ids, and first and
last doc_id, in order). A shard is ``MAGIC``, the dictionary's sha256, the id
width, one zstandard frame per document, the offset index (for each document its
id with a null flag, the end of its frame, the end of its ids), and the index's
place and length. Files are read by ranges: ``find`` looks a document up in the
manifest, searches one shard's index entry by entry, and reads one frame.

Frames go out as they are made: a task holds a batch of texts and the index, not
its shard. Executors write each shard under a name of their own and rename it,
so a task that runs twice leaves the same file. Defined results: rows are stored
in ascending doc_id order, null ids first, equal ids by a hash of the text and
then the text (equal rows in any order); null and empty texts hold only the end
id; other columns are ignored; an empty table gives a store without documents.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlog.llm.bpe import encoder
from strandlog.llm.common import bounded, doc_bytes, scratch_dir, store_fs, table, unit_hash

MAGIC = b"TOKSHRD2"
#: Documents that the dictionary may be trained on, and characters of each: of a longer text one span at a hashed place.
DICT_SAMPLE_DOCS, DICT_SAMPLE_CHARS = 1500, 20_000
DICT_BYTES = 64 << 10
#: Bytes of text of a shard, about: with more text there are more shards.
SHARD_TEXT = 256 << 20
LEVEL = 3
#: Bytes of frames, and index entries, that a scan of a shard reads at once.
READ_BYTES, READ_ENTRIES = 4 << 20, 4096


def write_file(uri: str, name: str, data: bytes) -> None:
    """Write under a name of its own, then rename: readers and reruns see whole files only."""
    fs, root = store_fs(uri)
    fs.create_dir(root, recursive=True)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(own) as out:
        out.write(data)
    fs.move(own, f"{root}/{name}")


def read_file(uri: str, name: str) -> bytes:
    fs, root = store_fs(uri)
    with fs.open_input_file(f"{root}/{name}") as f:
        return f.read()


def train_dictionary(arrays: list[bytes]) -> bytes:
    """A dictionary from serialized id arrays; empty if there is too little to train on."""
    import zstandard

    arrays = [a for a in arrays if len(a) >= 16]
    if len(arrays) < 20:
        return b""
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, arrays)) // 20)), arrays).as_bytes()
    except zstandard.ZstdError:
        return b""


HEAD, ENTRY, FOOT = struct.Struct("<8s32sB"), struct.Struct("<?qQQ"), struct.Struct("<QQ")


class ShardWriter:
    """Writes one shard to a stream: frames as they come, then the offset index."""

    def __init__(self, out, dictionary: bytes, width: int):
        import zstandard

        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict, write_checksum=False, write_content_size=True).compress
        self.out, self.width, self.index = out, width, []
        self.at = self.ids = 0
        out.write(HEAD.pack(MAGIC, hashlib.sha256(dictionary).digest(), width))

    def add(self, doc_id: int | None, packed: bytes) -> None:
        frame = self.compress(packed)
        self.out.write(frame)
        self.at += len(frame)
        self.ids += len(packed) // self.width
        self.index.append(ENTRY.pack(doc_id is not None, doc_id or 0, self.at, self.ids))

    def close(self) -> None:
        for k in range(0, len(self.index), READ_ENTRIES):
            self.out.write(b"".join(self.index[k : k + READ_ENTRIES]))
        self.out.write(FOOT.pack(HEAD.size + self.at, len(self.index)))


class ShardReader:
    """Reads documents of a shard, by position or doc_id, from a file that can seek."""

    def __init__(self, file, size: int, dictionary: bytes):
        import zstandard

        self.file = file
        magic, digest, self.width = HEAD.unpack(self.read(0, HEAD.size))
        if magic != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a shard of this dictionary")
        self.index, self.n = FOOT.unpack(self.read(size - FOOT.size, FOOT.size))
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompress = zstandard.ZstdDecompressor(dict_data=zdict).decompress

    def read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def __len__(self) -> int:
        return self.n

    def entry(self, k: int) -> tuple[bool, int, int, int]:
        """(id is known, id, end of the frame, end of the ids) of a document; zeros before the first."""
        return ENTRY.unpack(self.read(self.index + k * ENTRY.size, ENTRY.size)) if k >= 0 else (False, 0, 0, 0)

    def document(self, k: int) -> tuple[int | None, int, bytes]:
        """doc_id, first id's place in the shard, packed ids."""
        (_, _, start, first), (known, doc_id, stop, _) = self.entry(k - 1), self.entry(k)
        return doc_id if known else None, first, self.decompress(self.read(HEAD.size + start, stop - start))

    def find(self, doc_id: int) -> bytes:
        """Packed ids of the first document of this id: a binary search by index entries, and one frame."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.entry(mid)[:2] < (True, doc_id) else (lo, mid)
        if lo == self.n or self.entry(lo)[:2] != (True, doc_id):
            raise KeyError(doc_id)
        return self.document(lo)[2]

    def scan(self) -> Iterator:
        """Lists of (doc_id, first id's place, packed ids), a bounded stretch of the shard each."""
        start = first = 0
        for at in range(0, self.n, READ_ENTRIES):
            entries = list(ENTRY.iter_unpack(self.read(self.index + at * ENTRY.size, min(READ_ENTRIES, self.n - at) * ENTRY.size)))
            k = 0
            while k < len(entries):
                stop = k + 1
                while stop < len(entries) and entries[stop][2] - start <= READ_BYTES:
                    stop += 1
                frames, out, base = memoryview(self.read(HEAD.size + start, entries[stop - 1][2] - start)), [], start
                for known, doc_id, end, last in entries[k:stop]:
                    out.append((doc_id if known else None, first, self.decompress(frames[start - base : end - base])))
                    start, first = end, last
                yield out
                k = stop


class Store:
    """A store's documents by doc_id, read by ranges."""

    def __init__(self, path: str):
        self.path, self.manifest, self.dictionary = path, json.loads(read_file(path, "manifest.json")), read_file(path, "dictionary")

    def find(self, doc_id: int) -> list[int]:
        """Ids of the first document of this doc_id, from the one shard that may begin it."""
        import numpy as np

        for p in self.manifest["shards"]:
            if p["last_doc"] is not None and doc_id <= p["last_doc"]:
                with open_shard(self.path, p["shard"], self.dictionary) as shard:
                    return np.frombuffer(shard.find(doc_id), dtype=f"<u{shard.width}").tolist()
        raise KeyError(doc_id)


@contextlib.contextmanager
def open_shard(path: str, shard: int, dictionary: bytes):
    fs, root = store_fs(path)
    with fs.open_input_file(f"{root}/shard-{shard:05d}") as f:
        yield ShardReader(f, f.size(), dictionary)


def write_store(docs: DataFrame, path: str, tokenizer: str, end_id: int, shards: int | None = None) -> dict:
    """Encode and store every document; returns the manifest, one entry per shard."""
    spark = docs.sparkSession
    n, size = docs.select(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    place = (F.col("unit") * F.greatest(F.lit(0), F.length("text") - DICT_SAMPLE_CHARS)).cast("int") + 1
    spans = docs.select("doc_id", "text", (unit_hash("doc_id", "text") * max(1.0, n / (2 * DICT_SAMPLE_DOCS))).alias("unit")).filter("unit < 1")
    spans = spans.select("unit", "doc_id", F.substring(F.col("text"), place, F.lit(DICT_SAMPLE_CHARS)).alias("text")).orderBy("unit", "doc_id", "text").limit(DICT_SAMPLE_DOCS)
    sample = [bytes(r.text) for r in doc_bytes(spans).collect()]
    enc = encoder(tokenizer)
    end = enc.pack([end_id])
    dictionary = train_dictionary([p + end for p in enc.encode_many(sorted(sample))])
    write_file(path, "dictionary", dictionary)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        enc, shard, out, first = encoder(tokenizer), TaskContext.get().partitionId(), None, None
        fs, root = store_fs(path)
        own = f"{root}/.shard-{shard:05d}-{uuid.uuid4().hex}"
        for b in bounded(batches):
            ids = b.column("doc_id").to_pylist()
            if out is None:
                sink, first = fs.open_output_stream(own), ids[0]
                out = ShardWriter(sink, read_file(path, "dictionary"), enc.width)
            for doc_id, packed in zip(ids, enc.encode_many(b.column("text").to_pylist())):
                out.add(doc_id, packed + end)
        if out is not None:
            out.close()
            sink.close()
            fs.move(own, f"{root}/shard-{shard:05d}")
            row = {"shard": [shard], "n_docs": [len(out.index)], "n_ids": [out.ids], "first_doc": [first], "last_doc": [ids[-1]]}
            yield pa.RecordBatch.from_pydict(row, schema=pa.schema([(c, pa.int64()) for c in row]))

    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_TEXT))
    order = ["doc_id", "tie", "text"]
    ranged = doc_bytes(docs, F.col("doc_id").cast("long").alias("doc_id")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id()).repartitionByRange(shards, F.asc_nulls_first("doc_id"), "tie", "row")
    done = ranged.sortWithinPartitions(F.asc_nulls_first("doc_id"), *order[1:]).select("doc_id", "text").mapInArrow(run, "shard long, n_docs long, n_ids long, first_doc long, last_doc long")
    parts, base = [], 0
    for r in sorted(done.collect()):  # one row for each shard
        parts.append({"shard": r.shard, "n_docs": r.n_docs, "first_id": base, "first_doc": r.first_doc, "last_doc": r.last_doc})
        base += r.n_ids
    manifest = {"dictionary_sha256": hashlib.sha256(dictionary).hexdigest(), "width": enc.width, "ids": base, "shards": parts}
    write_file(path, "manifest.json", json.dumps(manifest).encode())
    return manifest


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, frame-decoded ids (packed as 32-bit): a row per stored document."""
    manifest = json.loads(read_file(path, "manifest.json"))
    width = manifest["width"]

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        dictionary = read_file(path, "dictionary")
        for b in batches:
            for shard, base in zip(b.column("shard").to_pylist(), b.column("first_id").to_pylist()):
                with open_shard(path, shard, dictionary) as reader:
                    for got in reader.scan():
                        wide = [np.frombuffer(p, dtype=f"<u{width}").astype("<u4").tobytes() for _, _, p in got]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([g[0] for g in got], pa.int64()), pa.array([base + g[1] for g in got], pa.int64()), pa.array([len(w) // 4 for w in wide], pa.int64()), pa.array([zlib.crc32(w) for w in wide], pa.int64()), pa.array(wide, pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids_crc32", "ids"],
                        )

    parts = spark.createDataFrame([(p["shard"], p["first_id"]) for p in manifest["shards"]], "shard long, first_id long")
    return parts.repartition(max(1, len(manifest["shards"])), "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch_dir(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return read_store(spark, path).drop("ids")
