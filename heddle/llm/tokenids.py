"""Token ids in binary shards, with a minimal perfect hash index from document keys to offsets.

A shard file: the raw ids of its documents one after another, then a footer: the keys in order, and
an index of exactly one slot a key. The slot holds a stored fingerprint of the key, the offset and the
length, so a key costs a few array reads and a comparison, and a stranger is refused but for one in 2**32.

Edge cases: a null or empty text is the end id alone; rows with equal doc_ids are told apart by their
occurrence within a shard; null doc_ids come first and are keyed by a value of their own; an empty
table makes no shard; other columns of the input are ignored.
"""

from __future__ import annotations

import json
import posixpath
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions import scans
from heddle.llm import common, tokens

#: Documents a shard holds, about.
SHARD_ROWS = 131_072
#: Bytes of text in a shard, on average at most.
SHARD_BYTES = 64 << 20
MAGIC = b"HDLIDS01"
META = "shard int, path string, docs long, ids long"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: shifts and odd multipliers spread every bit."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def hashes(keys: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """One hash for each (key, null or not, occurrence)."""
    with np.errstate(over="ignore"):
        salt = nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + null.astype(np.uint64)
    return _mix(_mix(keys.astype(np.int64).view(np.uint64)) ^ salt)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct hashes.

    Level by level, each hash still unplaced picks a bit of an array of twice as many bits; those alone
    on their bit stay there. A hash's slot is the rank of its bit among all set bits.
    """

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        """words: the levels' bits, 64 to a word; sizes: words of each level."""
        self.words, self.sizes = words, sizes
        self.ranks = np.cumsum(np.bitwise_count(words).astype(np.int64)) - np.bitwise_count(words)

    @staticmethod
    def _bits(h: np.ndarray, level: int, words: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (_mix(h + np.uint64(level + 1) * np.uint64(0xD1342543DE82EF95)) % np.uint64(64 * words)).astype(np.int64)

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        if len(np.unique(h)) < len(h):
            raise ValueError("two keys have one hash")
        levels = []
        while len(h):
            words = -(-2 * len(h) // 64)
            bit = cls._bits(h, len(levels), words)
            hits = np.bincount(bit, minlength=64 * words)
            levels.append(np.packbits(hits == 1, bitorder="little").view("<u8"))
            h = h[hits[bit] > 1]
        return cls(np.concatenate(levels) if levels else np.zeros(0, "<u8"), np.array([len(x) for x in levels], dtype="<i8"))

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Each hash's slot; -1 for strangers that meet no set bit."""
        out = np.full(len(h), -1, dtype=np.int64)
        rest, base = np.arange(len(h)), 0
        for level, words in enumerate(self.sizes.tolist()):
            bit = self._bits(h[rest], level, words)
            at = base + bit // 64
            shift = (bit % 64).astype(np.uint64)
            here = (self.words[at] >> shift) & np.uint64(1) == 1
            below = np.bitwise_count(self.words[at] & ((np.uint64(1) << shift) - np.uint64(1)))
            out[rest[here]] = self.ranks[at[here]] + below[here]
            rest, base = rest[~here], base + words
        return out


def _print(h: np.ndarray) -> np.ndarray:
    return (_mix(h ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype("<u4")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, by the names that Spark gives them: s3a is S3, viewfs goes by HDFS's library."""
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)


def write_shard(fs: pafs.FileSystem, path: str, batches: Iterator[tuple[list, list]], name: str, attempt: int) -> tuple[int, int]:
    """Writes the (doc_ids, texts) of batches, sorted by doc_id; gives the counts of documents and ids."""
    enc = tokens.encoder(name)
    width = np.dtype(enc.dtype).itemsize
    end = np.array([tokens.END], dtype=enc.dtype).tobytes()
    keys, lengths = [], []
    part = f"{path}.{attempt}"
    with fs.open_output_stream(part) as out:
        out.write(MAGIC)
        for ids, texts in batches:
            for key, text in zip(ids, texts, strict=True):
                raw = enc.encode(text.as_py()) + end
                out.write(raw)
                keys.append(key)
                lengths.append(len(raw) // width)
        null = np.array([k is None for k in keys], dtype=bool)
        key = np.array([k or 0 for k in keys], dtype="<i8")
        n = len(key)
        new = np.r_[True, (key[1:] != key[:-1]) | (null[1:] != null[:-1])] if n else np.zeros(0, dtype=bool)
        at = np.arange(n)
        nth = at - np.maximum.accumulate(np.where(new, at, 0))
        h = hashes(key, null, nth)
        index = PerfectHash.build(h)
        slot = index.slots(h)
        size = np.array(lengths, dtype="<i8")
        start = np.cumsum(size) - size
        prints, starts, sizes = np.zeros(n, dtype="<u4"), np.zeros(n, dtype="<i8"), np.zeros(n, dtype="<i8")
        prints[slot], starts[slot], sizes[slot] = _print(h), start, size
        arrays = {"keys": key, "null": null.astype("u1"), "nth": nth.astype("<i8"), "words": index.words, "levels": index.sizes, "prints": prints, "starts": starts, "sizes": sizes}
        head = json.dumps({"dtype": enc.dtype, "docs": n, "ids": int(size.sum()), "arrays": {k: [v.dtype.str, len(v)] for k, v in arrays.items()}}).encode()
        for v in arrays.values():
            out.write(v.tobytes())
        out.write(head + struct.pack("<q", len(head)) + MAGIC)
    fs.move(part, path)  # a lost or doubled attempt leaves no half file
    return n, int(size.sum())


class Shard:
    """Keyed access to one shard file."""

    def __init__(self, uri: str):
        fs, path = file_system(uri)
        self.file = fs.open_input_file(path)
        total = self.file.size()
        tail = self.file.read_at(16, total - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{uri} is no shard")
        (n,) = struct.unpack("<q", tail[:8])
        head = json.loads(self.file.read_at(n, total - 16 - n))
        self.dtype, self.docs, self.ids = np.dtype(head["dtype"]), head["docs"], head["ids"]
        at = len(MAGIC) + self.ids * self.dtype.itemsize
        for name, (kind, size) in head["arrays"].items():
            kind = np.dtype(kind)
            setattr(self, name, np.frombuffer(self.file.read_at(size * kind.itemsize, at), dtype=kind))
            at += size * kind.itemsize
        self.index = PerfectHash(self.words, self.levels)

    def find(self, keys: np.ndarray, null: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of each key's ids, -1 and 0 if the shard doesn't hold it."""
        if not self.docs:
            return np.full(len(keys), -1), np.zeros(len(keys), dtype=np.int64)
        h = hashes(keys, null, nth)
        slot = self.index.slots(h)
        ok = (slot >= 0) & (self.prints[slot] == _print(h))
        return np.where(ok, self.starts[slot], -1), np.where(ok, self.sizes[slot], 0)

    def read(self, start: int, length: int) -> np.ndarray:
        width = self.dtype.itemsize
        return np.frombuffer(self.file.read_at(length * width, len(MAGIC) + start * width), dtype=self.dtype)

    def get(self, key: int | None, nth: int = 0) -> np.ndarray | None:
        """The ids of a document, None for a stranger."""
        start, length = self.find(np.array([key or 0]), np.array([key is None]), np.array([nth]))
        return None if start[0] < 0 else self.read(int(start[0]), int(length[0]))


def write(docs: DataFrame, folder: str, shard_rows: int = SHARD_ROWS, shard_bytes: int = SHARD_BYTES, tokenizer: str = tokens.NAME) -> DataFrame:
    """Writes docs (doc_id, text) as shards in ascending doc_id order below folder; gives a META row for each shard.

    Shards have some shard_bytes of text on average, and some shard_rows documents at most.
    """
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    n = max(1, -(-rows // shard_rows), -(-size // shard_bytes))
    # equal ids may be many: a hash of the text lets them spread over several shards
    d = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", F.xxhash64("text"))
    d = d.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = task.partitionId()
        uri = posixpath.join(folder, f"shard-{shard:07d}.ids")
        fs, path = file_system(uri)
        fs.create_dir(posixpath.dirname(path), recursive=True)

        def rows() -> Iterator[tuple[list, list]]:
            yield first.column(0).to_pylist(), first.column(1)
            for b in batches:
                yield b.column(0).to_pylist(), b.column(1)

        count, ids = write_shard(fs, path, rows(), tokenizer, task.taskAttemptId())
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([uri]), pa.array([count]), pa.array([ids])], ["shard", "path", "docs", "ids"])

    # one small row a shard: a few files hold them
    return common.stored(common.map_arrow(d, run, META).repartition(1 + n // 10_000), "shards")


def documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, looked up in the files by its key."""
    upto = scans.global_sums(shards.select("shard", "path", F.col("ids").alias("own"), "ids"), "shard", ["ids"], descending=False)
    based = upto.withColumn("base", F.col("ids") - F.col("own"))
    n = max(1, min(shards.count(), 100_000))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = Shard(path)
                null = s.null.astype(bool)
                start, size = s.find(s.keys, null, s.nth)
                if (start < 0).any():
                    raise ValueError(f"{path}: its index misses a key")
                crc = [zlib.crc32(s.read(int(a), int(k)).astype("<u4").tobytes()) for a, k in zip(start, size, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(s.keys, mask=null), pa.array(start + base), pa.array(size), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return common.map_arrow(based.select("path", "base").repartition(n, "path"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Writes docs to the shared folder and reads every document back."""
    return documents(write(docs, common.scratch(spark, "ids")))
