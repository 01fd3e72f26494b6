"""Token-id shards: raw id payloads with a minimal perfect hash index from document key to offset.

A shard file holds, little-endian: the magic, a header (counts and section lengths), the levels of
the hash, and for each slot the stored fingerprint, the key's place and length in the payload; the
keys in the order of the documents; then the ids, 16 or 32 bits wide. A key is looked up by hashing
it level by level until its bit is set; the rank of that bit is its slot, and the stored fingerprint
tells a key that was never put in. The manifest has the keys each shard covers, so that a look-up in
the whole corpus opens only the shards that can hold the key.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import bounded_batches, fresh_folder, ids_crc, session, table
from tidemill.llm.tokens import encoder

MAGIC = b"TMSHARD2"
_HEAD = struct.Struct("<8sQQIIq")
#: Bits of a level for each key that is still without a slot.
GAMMA = 2
MOST_LEVELS = 64


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys: bit arrays by level, and their ranks."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits, dtype=np.int64) - bits)
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys.astype(np.uint64)
        while len(left):
            if len(levels) == MOST_LEVELS:
                raise ValueError("keys are not distinct")
            at = (_mix(left, len(levels)) % np.uint64(max(1, GAMMA * len(left)))).astype(np.int64)
            hits = np.bincount(at, minlength=max(1, GAMMA * len(left)))
            levels.append((hits == 1).astype(np.uint8))
            left = left[hits[at] != 1]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for some keys that were not put in, any slot for others."""
        keys = keys.astype(np.uint64)
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mix(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at] == 1
            out[left[hit]] = self.ranks[k][at[hit]]
            left = left[~hit]
        return out

    def pack(self) -> bytes:
        parts = [struct.pack("<I", len(self.levels))]
        for bits in self.levels:
            parts += [struct.pack("<Q", len(bits)), np.packbits(bits, bitorder="little").tobytes()]
        return b"".join(parts)

    @classmethod
    def unpack(cls, data: bytes) -> PerfectHash:
        (count,), at, levels = struct.unpack_from("<I", data), 4, []
        for _ in range(count):
            (n,) = struct.unpack_from("<Q", data, at)
            size = (n + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(data, np.uint8, size, at + 8), count=n, bitorder="little"))
            at += 8 + size
        return cls(levels)


def key_fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys, 1000) >> np.uint64(32)).astype(np.uint32)


def index_keys(keys: np.ndarray, nameless: int = 0) -> np.ndarray:
    """The keys as the index has them: the first row of a key by itself, each further one by a key made from its number.
    The last so many rows have no key; theirs come from their number, too."""
    named = np.asarray(keys, np.int64)[: len(keys) - nameless]
    return np.concatenate([_numbered(named), _mix(np.arange(nameless, dtype=np.uint64), 3000)])


def _numbered(keys: np.ndarray) -> np.ndarray:
    unsigned = keys.view(np.uint64).copy()
    order = np.argsort(unsigned, kind="stable")
    same = unsigned[order]
    first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]])) if len(same) else np.zeros(0, np.int64)
    number = np.zeros(len(keys), np.int64)
    number[order] = np.arange(len(keys)) - np.repeat(first, np.diff(np.concatenate([first, [len(keys)]])).astype(np.int64))
    for k in np.flatnonzero(number).tolist():
        unsigned[k] = _mix(unsigned[k : k + 1], 2000 + int(number[k]))[0]
    return unsigned


def pack_shard(keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nameless: int = 0) -> bytes:
    """A shard of documents in the given order; keys are signed longs, and the last so many documents have none."""
    wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
    unsigned = index_keys(keys, nameless)
    mph = PerfectHash.build(unsigned)
    slot = mph.slots(unsigned)
    stored, place, length = np.zeros(len(keys), "<u4"), np.zeros(len(keys), "<u8"), np.zeros(len(keys), "<u8")
    stored[slot], place[slot], length[slot] = key_fingerprints(unsigned), np.cumsum(lengths) - lengths, lengths
    index = mph.pack()
    head = _HEAD.pack(MAGIC, len(keys), len(ids), len(index), 4 if wide else 2, nameless)
    return b"".join([head, index, stored.tobytes(), place.tobytes(), length.tobytes(), keys.astype("<i8").tobytes(), ids.astype("<u4" if wide else "<u2").tobytes()])


class Shard:
    """A shard read back. get(key) is one hash, one fingerprint and one slice."""

    def __init__(self, data: bytes):
        magic, n, tokens, index, width, self.nameless = _HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = _HEAD.size
        self.hash = PerfectHash.unpack(data[at : at + index])
        at += index
        sections = []
        for kind in ("<u4", "<u8", "<u8", "<i8"):
            sections.append(np.frombuffer(data, kind, n, at))
            at += sections[-1].nbytes
        self.stored, self.place, self.length, self.keys = sections
        self.payload = np.frombuffer(data, "<u4" if width == 4 else "<u2", tokens, at)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of each key in the payload; length -1 for keys whose fingerprint isn't stored."""
        return self._find(np.asarray(keys, np.int64).view(np.uint64))

    def rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Place and length of every document in the order of the shard, rows that repeat a key included."""
        place, length = self._find(index_keys(self.keys, self.nameless))
        if (length < 0).any():
            raise ValueError("the index of a shard doesn't find its own keys")
        return place, length

    def doc_ids(self) -> list[int | None]:
        return [*self.keys[: len(self.keys) - self.nameless].tolist(), *[None] * self.nameless]

    def _find(self, unsigned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = self.hash.slots(unsigned)
        ok = slot >= 0
        ok[ok] = self.stored[slot[ok]] == key_fingerprints(unsigned[ok])
        at = np.where(ok, slot, 0)
        if not len(self.stored):
            return np.zeros(len(slot), np.int64), np.full(len(slot), -1)
        return np.where(ok, self.place[at].astype(np.int64), 0), np.where(ok, self.length[at].astype(np.int64), -1)

    def get(self, key: int) -> np.ndarray | None:
        place, length = (x[0] for x in self.find(np.array([key])))
        return None if length < 0 else self.payload[place : place + length]


def put_file(uri: str, data: bytes) -> None:
    """Writes a file whole: under another name first, so that a lost or repeated task leaves no torn file."""
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    task = TaskContext.get()
    part = f"{path}.{task.taskAttemptId() if task else 0}.part"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, path)


def get_file(uri: str) -> bytes:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


#: Text bytes of a shard, about.
SHARD_BYTES = 8 << 20


def _spans(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[list, list[str]]]:
    """Runs of rows (ids, texts) of about so many bytes, in order."""
    ids, texts, size = [], [], 0
    for b in batches:
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(key)
            texts.append(text)
            size += len(text)
            if size >= most:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


_MANIFEST = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("uri", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64()), ("low", pa.int64()), ("high", pa.int64())])


def ordered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) in partitions of rising ids, each sorted; null ids come last, null texts are empty."""
    spark = session(docs)
    bounded_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    by = F.col("doc_id").asc_nulls_last()
    return rows.repartitionByRange(n, by).sortWithinPartitions(by, "text")


def write_shards(docs: DataFrame, path: str, kind: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every document and writes shard files in ascending id order; one row per shard.

    Rows of a null id come last and have no key; reading a shard through gives them, too. Rows that repeat
    an id are all in the files, by text; a look-up of the id finds the first. Null text: only the end id.
    A shard file appears whole or not at all, and a task that runs again writes the same bytes to the same
    name.
    """
    folder = folder or fresh_folder(session(docs), "shards")

    def run(batches):
        enc, part = encoder(path, kind), TaskContext.get().partitionId()
        for k, (keys, texts) in enumerate(_spans(batches, SHARD_BYTES)):
            found, lengths = [], []
            for a in range(0, len(texts), 256):
                ids, _, upto = enc.encode_many(texts[a : a + 256])
                lengths.append(np.diff(upto) + 1)
                found.append(np.insert(ids, upto[1:], end_id))
            ids, length = np.concatenate(found), np.concatenate(lengths)
            uri, nameless = f"{folder}/part-{part:06d}-{k:06d}.shard", keys.count(None)
            named = keys[: len(keys) - nameless]
            put_file(uri, pack_shard(np.array([*named, *[0] * nameless], np.int64), length, ids, nameless))
            ends = (named[0], named[-1]) if named else (None, None)
            yield table({"part": [part], "shard": [k], "uri": [uri], "docs": [len(keys)], "tokens": [len(ids)], "low": [ends[0]], "high": [ends[1]]}, _MANIFEST)

    return ordered(docs, id_col, text_col).mapInArrow(run, "part long, shard long, uri string, docs long, tokens long, low long, high long")


_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Documents are looked up by key through each shard's index, fingerprints checked.
    """

    def run(batches):
        for b in batches:
            for uri, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                shard = Shard(get_file(uri))
                place, length = shard.rows()
                crc = [ids_crc(shard.payload[p : p + n]) for p, n in zip(place.tolist(), length.tolist(), strict=True)]
                yield table({"doc_id": shard.doc_ids(), "start": base + place, "n_tokens": length, "ids_crc32": crc}, _READ)

    return manifest.select("uri", "base").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


_GOT = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))])


def get_many(manifest: DataFrame, keys: Sequence[int]) -> DataFrame:
    """(doc_id, ids) of a list of keys, those that aren't there left out; of rows that repeat an id, the first.

    Only shards whose range of keys has one of them are opened, and in each a key costs one hash, one
    fingerprint and one slice. The list goes to the executors; it is the caller's, and so of bounded size.
    """
    wanted = np.unique(np.array(list(keys), np.int64))

    def run(batches):
        for b in batches:
            for part, number, uri in zip(*(c.to_pylist() for c in b.columns), strict=True):
                shard = Shard(get_file(uri))
                place, length = shard.find(wanted)
                at = np.flatnonzero(length >= 0)
                # A fingerprint of 32 bits may be met by a key that was never put in; the key itself tells.
                at = at[np.isin(wanted[at], shard.keys[: len(shard.keys) - shard.nameless])]
                if len(at):
                    ids = [shard.payload[p : p + n].tolist() for p, n in zip(place[at].tolist(), length[at].tolist(), strict=True)]
                    yield table({"part": [part] * len(at), "shard": [number] * len(at), "doc_id": wanted[at], "ids": ids}, _GOT)

    any_of = F.exists(F.lit(wanted.tolist()) if len(wanted) else F.array().cast("array<long>"), lambda k: (k >= F.col("low")) & (k <= F.col("high")))
    got = manifest.where(any_of).select("part", "shard", "uri").mapInArrow(run, "part long, shard long, doc_id long, ids array<long>")
    return got.groupBy("doc_id").agg(F.min_by("ids", F.struct("part", "shard")).alias("ids"))


def with_base(manifest: DataFrame) -> DataFrame:
    """Adds base, the ids of all shards before: sums of whole partitions, then of shards within one."""
    from pyspark.sql import Window

    parts = manifest.groupBy("part").agg(F.sum("tokens").alias("n"))
    # One row for each of a number of partitions that is set, not one for each document.
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))).alias("before"))
    within = F.sum("tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("within", within).join(before, "part").select("*", (F.coalesce("before", F.lit(0)) + F.coalesce("within", F.lit(0))).alias("base"))


def encode_corpus(docs: DataFrame, path: str, kind: str = "word", end_id: int = 2) -> DataFrame:
    """Writes the corpus as shards in the shared folder and reads it back (see read_shards)."""
    from tidemill.llm.common import cut

    manifest = with_base(cut(write_shards(docs, path, kind, end_id)))
    n = int(session(docs).conf.get("spark.sql.shuffle.partitions"))
    return read_shards(manifest.repartition(n, "uri"))
