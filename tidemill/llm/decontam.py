"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact check."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import binary, bounded_batches, filtered, session, table

WORDS, LEAST = 5, 0.8
#: Bits of a fingerprint. Two windows at the least similarity differ in 39 of 256, give or take six (short ones in 48);
#: the radius is four to six deviations beyond. Unrelated windows differ in 128, give or take eight.
WIDE, RADIUS = 256, 73
#: The bits fall into blocks of eight, and a block is near if it differs by so many bits at most. A pair with fewer near
#: blocks than WIDE // 8 - RADIUS // (NEAR + 1) differs by more than the radius.
NEAR = 2
#: Items of fewer shingles than this, counted by weight, are verified wherever a window shares a shingle with them.
EVEN = 8
#: Benchmark items taken in one pass over the documents, and bytes of them (one item may be longer): the bound of what
#: comes to the driver and goes to the executors.
BLOCK_ITEMS, BLOCK_BYTES = 4096, 16 << 20
#: Text bytes whose words are hashed at once.
BYTES_AT_ONCE = 1 << 20

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class _Hasher:
    """Hashes of the words of a byte buffer, all at once."""

    def __init__(self):
        self.up, self.down = _powers(_ODD, 1), _powers(_BACK, 1)

    def words(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and hash of each word; a word is a run of bytes other than ASCII white space, A-Z as a-z."""
        if len(x) + 1 > len(self.up):
            self.up, self.down = _powers(_ODD, len(x) + 1), _powers(_BACK, len(x) + 1)
        x = _LOWER[x]
        gap = np.concatenate([[True], _SPACE[x], [True]])
        edge = np.flatnonzero(gap[1:] != gap[:-1])
        start, end = edge[::2], edge[1::2]
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[: len(x)], out=sums[1:])
        return start, end, _mix((sums[end] - sums[start]) * self.down[start])


def shingle_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, from the hashes of the words."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = _mix(out + words[k : len(words) - n + 1 + k] + np.uint64(k + 1))
    return out


_SALTS = _mix(np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * _ODD)


def window_fingerprints(hashes: np.ndarray, size: int) -> np.ndarray:
    """SimHash of each run of so many shingles, each weighing as often as it occurs: rows of 64-bit words."""
    wide = _mix(hashes[:, None] ^ _SALTS[None, :])
    bits = np.unpackbits(wide.view(np.uint8).reshape(len(hashes), -1), axis=1, bitorder="little")
    sums = np.zeros((len(hashes) + 1, WIDE), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    ones = sums[size:] - sums[:-size]
    return np.packbits(ones * 2 > size, axis=1, bitorder="little").view(np.uint64)


def weighted_similarity(a: Counter, b: Counter) -> float:
    """Sum of the smaller weights over sum of the larger; a shingle weighs as often as it occurs."""
    least = sum((a & b).values())
    most = sum((a | b).values())
    return least / most if most else 0.0


class HammingBlocks:
    """Fingerprints by block and by the values near theirs on it: those that share enough near blocks with a query are
    its candidates, and none within the radius is missing."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS, always: np.ndarray | None = None):
        self.fps, self.radius = fps.reshape(-1, WIDE // 64), radius
        self.always = np.zeros(len(self.fps), bool) if always is None else always
        self.least = max(1, WIDE // 8 - radius // (NEAR + 1))
        values = np.arange(256, dtype=np.uint8)
        bytes_of = self.fps.view(np.uint8).reshape(len(self.fps), -1)
        # near[block, value]: a bit for each fingerprint within NEAR bits of that value on that block.
        self.near = np.stack([np.packbits(np.bitwise_count(values[:, None] ^ bytes_of[:, k][None, :]) <= NEAR, axis=1) for k in range(WIDE // 8)])

    def candidates(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, fingerprint) pairs with enough near blocks."""
        at = queries.view(np.uint8).reshape(len(queries), -1)
        found = []
        for a in range(0, len(queries), step := max(1, (1 << 20) // max(1, len(self.fps)))):
            part = at[a : a + step]
            count = np.zeros((len(part), len(self.fps)), np.uint8)
            for k in range(WIDE // 8):
                count += np.unpackbits(self.near[k, part[:, k]], axis=1, count=len(self.fps))
            q, f = np.nonzero((count >= self.least) | self.always)
            found.append((q + a, f))
        return tuple(np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in range(2))

    def pairs(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, fingerprint) pairs within the radius, and all with a fingerprint that is always a candidate."""
        queries = queries.reshape(-1, WIDE // 64)
        q, f = self.candidates(queries)
        ok = (np.bitwise_count(queries[q] ^ self.fps[f]).sum(axis=1) <= self.radius) | self.always[f]
        return q[ok], f[ok]


def _grams(words: list[bytes], n: int) -> list[bytes]:
    return [b" ".join(words[k : k + n]) for k in range(len(words) - n + 1)]


class BenchmarkIndex:
    """Items by length in words, with their fingerprints, shingles and seeds."""

    def __init__(self, items: list[tuple[int | None, bytes]], words: int = WORDS, radius: int = RADIUS, least: float = LEAST):
        hasher, self.least = _Hasher(), least
        self.items = [key for key, _ in items]
        groups: dict[int, list[tuple[int, np.ndarray, Counter]]] = {}
        for key, (_, text) in enumerate(items):
            split = text.lower().split()
            if split:
                n = min(words, len(split))
                hashes = shingle_hashes(hasher.words(np.frombuffer(text, np.uint8))[2], n)
                groups.setdefault(len(split), []).append((key, hashes, Counter(_grams(split, n))))
        self.groups = []
        for length in sorted(groups):
            rows, n = groups[length], min(words, length)
            size = length - n + 1
            fps = np.concatenate([window_fingerprints(r[1], size)[:1] for r in rows])
            # Where a few shingles carry nearly all the weight, one more can turn a quarter of the bits: no radius holds.
            heavy = np.array([size >= 9 and size**2 < EVEN * sum(w * w for w in r[2].values()) for r in rows])
            self.groups.append((length, n, size, [r[0] for r in rows], [r[2] for r in rows], HammingBlocks(fps, radius, heavy), np.unique(np.concatenate([r[1] for r in rows]))))
        self.sizes = sorted({g[1] for g in self.groups})
        self.seeds = {n: np.unique(np.concatenate([g[6] for g in self.groups if g[1] == n])) for n in self.sizes}
        self.filters = {}
        for n, s in self.seeds.items():
            bits = np.zeros(1 << 22, bool)
            bits[(s & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
            self.filters[n] = bits

    def seeded(self, n: int, hashes: np.ndarray) -> np.ndarray:
        """Where a shingle is also one of an item. A window without any has similarity zero."""
        at = np.flatnonzero(self.filters[n][(hashes & np.uint64((1 << 22) - 1)).astype(np.int64)])
        s = self.seeds[n]
        return at[s[np.minimum(np.searchsorted(s, hashes[at]), len(s) - 1)] == hashes[at]]

    def matches(self, text: bytes, word_hashes: np.ndarray, start: np.ndarray, end: np.ndarray, seeds: dict[int, np.ndarray]) -> list[tuple[int | None, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item at or over the least similarity."""
        best: dict[int, tuple[float, int, int]] = {}
        for length, n, size, keys, grams, blocks, own in self.groups:
            hits = seeds.get(n)
            if hits is None or not len(hits) or len(word_hashes) < length:
                continue
            hashes = shingle_hashes(word_hashes, n)
            hits = hits[np.isin(hashes[hits], own)]
            reach = np.zeros(len(hashes) + 2, np.int64)
            np.add.at(reach, np.maximum(0, hits - size + 1), 1)
            np.add.at(reach, hits + 1, -1)
            open_ = np.flatnonzero(np.cumsum(reach)[: len(hashes) - size + 1] > 0)
            for run in np.split(open_, np.flatnonzero(np.diff(open_) > 1) + 1) if len(open_) else []:
                for a in range(int(run[0]), int(run[-1]) + 1, 4096):
                    b = min(a + 4096, int(run[-1]) + 1)
                    fps = window_fingerprints(hashes[a : b + size - 1], size)
                    for w, i in zip(*(x.tolist() for x in blocks.pairs(fps)), strict=True):
                        at = a + w
                        words = [text[p:q].lower() for p, q in zip(start[at : at + length].tolist(), end[at : at + length].tolist(), strict=True)]
                        value = weighted_similarity(Counter(_grams(words, n)), grams[i])
                        if value >= self.least and value > best.get(keys[i], (0.0,))[0]:
                            best[keys[i]] = (value, at, length)
        return [(self.items[k], at, length, value) for k, (value, at, length) in sorted(best.items())]

    def scan(self, texts: list[bytes]) -> list[list[tuple[int, int, int, float]]]:
        """Matches of each text. Words of several texts are hashed in one buffer."""
        out: list[list] = [[] for _ in texts]
        hasher, k = _Hasher(), 0
        while k < len(texts):
            stop, size = k, 0
            while stop < len(texts) and (stop == k or size + len(texts[stop]) < BYTES_AT_ONCE):
                size += len(texts[stop]) + 1
                stop += 1
            x = np.frombuffer(b"\n".join(texts[k:stop]), np.uint8)
            begins = np.cumsum([0, *(len(t) + 1 for t in texts[k:stop])])
            start, end, hashes = hasher.words(x)
            first = np.searchsorted(start, begins)
            owner = np.repeat(np.arange(stop - k), np.diff(first))
            found: dict[int, dict[int, np.ndarray]] = {}
            for n in self.sizes:
                at = self.seeded(n, shingle_hashes(hashes, n))
                at = at[owner[at] == owner[at + n - 1]]
                if not len(at):
                    continue
                docs, cuts = np.unique(owner[at], return_index=True)
                for d, part in zip(docs.tolist(), np.split(at, cuts[1:]), strict=True):
                    found.setdefault(d, {})[n] = part - first[d]
            for d, seeds in found.items():
                a, b = first[d], first[d + 1]
                out[k + d] = self.matches(texts[k + d], hashes[a:b], start[a:b] - begins[d], end[a:b] - begins[d], seeds)
            k = stop
        return out


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64())])


def _blocks(benchmark: DataFrame, id_col: str, text_col: str):
    """The distinct (item id, text) of the benchmark in blocks of bounded size, by id (null last) and text."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), binary(text_col).alias("text")).distinct()
    items = items.select(F.struct(F.col("item_id").isNull().alias("none"), "item_id", "text").alias("item"))
    last = None
    while True:
        rest = items
        if last is not None:
            none, key, text = last
            after = F.struct(F.lit(none).alias("none"), F.lit(key).cast("long").alias("item_id"), F.lit(text).alias("text"))
            rest = items.where(F.col("item") > after)
        rest = rest.orderBy("item")
        sizes = [r[0] for r in rest.limit(BLOCK_ITEMS).select(F.octet_length("item.text")).collect()]
        if not sizes:
            return
        n = max(1, int(np.searchsorted(np.cumsum(sizes), BLOCK_BYTES, side="right")))
        part = [r[0] for r in rest.limit(n).collect()]
        yield [(r["item_id"], bytes(r["text"])) for r in part]
        last = (part[-1]["none"], part[-1]["item_id"], part[-1]["text"])


def contamination(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document and benchmark item it holds: doc_id, item_id, first_word, n_words, similarity.

    Windows of as many words as the item, at every word of every document, are compared by their
    multisets of 5-word shingles (items of fewer words: all their words as one). Fingerprints of the
    windows that share a shingle with an item go through the Hamming blocks; pairs within the radius
    are verified exactly, and the best window (the first, on a tie) is returned if its similarity is
    0.8 or more. Each text of an item id that occurs with several is an item of its own, and so is one
    without an id (item_id null in the result); items without words match nothing. Documents that
    repeat an id have rows each for itself. Null text: empty. Empty tables give no rows. The benchmark
    is taken in blocks of bounded size.
    """
    spark: SparkSession = session(docs)
    bounded_batches(spark)
    out = None
    rows = docs.select(F.col(id_col).cast("long"), binary(text_col))
    for block in _blocks(benchmark, "item_id", "text"):
        sent = spark.sparkContext.broadcast(BenchmarkIndex(block, words, RADIUS, least))

        def run(batches, sent=sent):
            index = sent.value
            for b in batches:
                found = index.scan(b.column(1).to_pylist())
                got = [(d, *m) for d, ms in zip(b.column(0).to_pylist(), found, strict=True) for m in ms]
                if got:
                    yield table(dict(zip(_OUT.names, zip(*got, strict=True), strict=True)), _OUT)

        part = rows.mapInArrow(run, "doc_id long, item_id long, first_word long, n_words long, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, first_word long, n_words long, similarity double")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """The documents that hold no benchmark item (see contamination), each row judged by its own text; all columns stay."""
    for block in _blocks(benchmark, "item_id", "text"):
        sent = session(docs).sparkContext.broadcast(BenchmarkIndex(block, words, RADIUS, least))
        docs = filtered(docs, "text", lambda texts, sent=sent: [not m for m in sent.value.scan(texts)])
    return docs
