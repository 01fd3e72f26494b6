"""SimHash near-duplicates found through pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import binary, bounded_batches, cut, restrict, session, table
from tidemill.llm.components import Sets, components

BITS = 64
SEED = 42
#: Shingles hashed at once; longer texts go in blocks.
BLOCK = 1 << 15
#: Reference fingerprints of the full table, and of each part of a key.
PIVOTS = 16
KEY_PIVOTS = 12
#: Runs of one key up to this length are compared in one sweep over the whole batch.
SHORT_RUN = 48
#: Fingerprints of one key that are compared in one task; keys of more are split by further zones.
KEY_RUN = 1 << 15


def _shingles(words: list[bytes], n: int) -> Iterator[list[bytes]]:
    if 0 < len(words) < n:
        yield [b" ".join(words)]
        return
    for a in range(0, len(words) - n + 1, BLOCK):
        block = words[a : a + BLOCK + n - 1]
        yield list(map(b" ".join, zip(*(block[k : len(block) - n + 1 + k] for k in range(n)), strict=True)))


def fingerprint(text: bytes, n: int = 3) -> int:
    """SimHash of a text's n-word shingles, repeats included; no words: zero."""
    ones, total = np.zeros(BITS, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for block in _shingles(text.lower().split(), n):
        h = np.fromiter((digest(s, SEED) for s in block), np.uint64, len(block))
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=0, dtype=np.int64)
        total += len(block)
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little") if total else 0


_FP = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])


def fingerprints(docs: DataFrame, words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed long. Null or empty text: zero."""
    bounded_batches(session(docs))

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield table({"doc_id": b.column(0), "fp": fp}, _FP)

    return docs.select(F.col(id_col).cast("long"), binary(text_col)).mapInArrow(run, "doc_id long, fp long")


def _zones(mask: int, parts: int) -> list[int]:
    """The set bits of a mask, in as many zones of nearly equal size."""
    bits = [b for b in range(BITS) if mask >> b & 1]
    cuts = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [sum(1 << b for b in bits[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)]


def reference(count: int, salt: int) -> np.ndarray:
    """Reference fingerprints, from a rule."""
    return np.array([xxhash.xxh64_intdigest(f"reference {salt} {k}".encode(), SEED) for k in range(count)], np.uint64)


def distance_table(fps: np.ndarray, refs: np.ndarray, mask: int = (1 << BITS) - 1) -> np.ndarray:
    """Hamming distances (rows: fingerprints, columns: references) within the bits of a mask.

    The distance within a mask m follows from the distances to a reference r and to its complement
    on m: (d(x, r) - d(x, r ^ m) + |m|) / 2. So it, too, is a coordinate that differs between two
    fingerprints by no more than they themselves do.
    """
    return np.bitwise_count((fps[:, None] ^ refs[None, :]) & np.uint64(mask)).astype(np.int8)


def key_masks(radius: int) -> list[tuple[int, int]]:
    """Pairs of zones of which any two fingerprints within the radius agree on at least one.

    radius + 1 zones can't all differ, and nor can radius + 1 zones of the bits outside the zone that
    agrees. So the two coordinates, distance tables within the first and within the second zone, are
    equal: the largest coordinate difference is zero there.
    """
    full = (1 << BITS) - 1
    return [(a, b) for a in _zones(full, radius + 1) for b in _zones(full & ~a, radius + 1)]


def rests(radius: int, level: int) -> list[int]:
    """The bits outside the zones of each key: of those of key_masks, and level by level of their splits."""
    full = (1 << BITS) - 1
    out = [full & ~a & ~b for a, b in key_masks(radius)]
    for _ in range(level):
        out = [m & ~c for m in out for c in _zones(m, radius + 1)]
    return out


def _mixed(columns: np.ndarray) -> np.ndarray:
    """One 64-bit number for each row of a distance table. Two rows that meet by chance fail later."""
    out = np.zeros(len(columns), np.uint64)
    for c in columns.T:
        out = (out ^ c.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _survivors(x: np.ndarray, y: np.ndarray, radius: int, refs: np.ndarray) -> np.ndarray:
    """Which pairs (x[i], y[i]) pass the table (largest coordinate difference) and then the distance itself."""
    ok = np.abs(distance_table(x, refs) - distance_table(y, refs)).max(axis=1) <= radius
    at = np.flatnonzero(ok)
    return at[np.bitwise_count(x[at] ^ y[at]) <= radius]


def links_of_run(fps: np.ndarray, radius: int, refs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links within a long run that share a key, block by block, coordinate by coordinate."""
    t = distance_table(fps, refs)
    order = np.argsort(t[:, 0], kind="stable")
    fps, t = fps[order], t[order]
    for a in range(0, len(fps), 256):
        b = min(a + 256, len(fps))
        end = int(np.searchsorted(t[:, 0], t[b - 1, 0] + radius, side="right"))
        near = np.ones((b - a, end - a), bool)
        for k in range(t.shape[1]):
            near &= np.abs(t[a:b, k][:, None] - t[a:end, k][None, :]) <= radius
        i, j = np.nonzero(np.triu(near, 1))
        good = np.bitwise_count(fps[a + i] ^ fps[a + j]) <= radius
        yield from zip(fps[a + i[good]].view(np.int64).tolist(), fps[a + j[good]].view(np.int64).tolist(), strict=True)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_KEYED = pa.schema([("key", pa.int64()), ("path", pa.int64()), ("fp", pa.int64())])
_KEYED_DDL = "key long, path long, fp long"


def _deeper(rows: DataFrame, radius: int, level: int) -> DataFrame:
    """Rows of keys of a level split by zones of the bits they leave open: any two within the radius that had a key in
    common have one in common again."""
    refs, masks = reference(KEY_PIVOTS, 3 + level), rests(radius, level)

    def run(batches):
        for b in batches:
            key, path, fp = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            for p in np.unique(path).tolist():
                at = path == p
                x, old = fp[at].view(np.uint64), key[at].view(np.uint64)
                for z, zone in enumerate(_zones(masks[p], radius + 1)):
                    new = old ^ _mixed(np.hstack([np.full((len(x), 1), z + 1, np.int8), distance_table(x, refs, zone)]))
                    yield table({"key": new.view(np.int64), "path": np.full(len(x), p * (radius + 1) + z), "fp": x.view(np.int64)}, _KEYED)

    return rows.select("key", "path", "fp").mapInArrow(run, _KEYED_DDL)


def _bounded_keys(rows: DataFrame, radius: int, most: int) -> DataFrame:
    """The rows with keys of too many fingerprints split until none is left. Distinct fingerprints of one key differ in the
    open bits, so this ends; and only what is hot is read again."""
    done, level = None, 0
    while True:
        hot = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key"))
        few = hot.isEmpty()
        part = rows if few else restrict(rows, hot, ["key"], "left_anti")
        done = part if done is None else done.unionByName(part)
        if few:
            return done
        rows = cut(_deeper(restrict(rows, hot, ["key"], "left_semi"), radius, level))
        level += 1


def near_links(fps: DataFrame, radius: int = 2, most: int = KEY_RUN) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of a column fp that join whatever is within the radius.

    Each fingerprint goes to (radius + 1)^2 keys, each a row of a pivot distance table; fingerprints
    with a key in common are the candidates, the full table discards those whose largest coordinate
    difference is over the radius, and survivors are verified bit by bit. Of the links found in a
    partition only those are returned that join two sets not yet joined there, so a group of near
    copies makes as many rows as it has fingerprints, not as it has pairs. A key of more than so many
    fingerprints is split by further zones, without losing a link.
    """
    masks = key_masks(radius)
    refs, first, second = reference(PIVOTS, 0), reference(KEY_PIVOTS, 1), reference(KEY_PIVOTS, 2)

    def keyed(batches):
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            for k, (m, s) in enumerate(masks):
                rows = np.hstack([np.full((len(x), 1), k, np.int8), distance_table(x, first, m), distance_table(x, second, s)])
                yield table({"key": _mixed(rows).view(np.int64), "path": np.full(len(x), k), "fp": x.view(np.int64)}, _KEYED)

    def pairs(key, x, begin, length):
        run = np.repeat(length, length)
        for step in range(1, int(min(length.max(initial=1), SHORT_RUN))):
            i = np.flatnonzero((key[step:] == key[:-step]) & (run[step:] <= SHORT_RUN))
            good = i[_survivors(x[i], x[i + step], radius, refs)] if len(i) else i
            yield from zip(x[good].view(np.int64).tolist(), x[good + step].view(np.int64).tolist(), strict=True)
        for k in np.flatnonzero(length > SHORT_RUN).tolist():
            yield from links_of_run(x[begin[k] : begin[k] + length[k]], radius, refs)

    def linked(batches):
        sets, held = Sets(), (np.zeros(0, np.int64), np.zeros(0, np.int64))
        for b in (*batches, None):
            if b is None:
                key, fp, last = *held, True
            else:
                key = np.concatenate([held[0], b.column(0).to_numpy()])
                fp, last = np.concatenate([held[1], b.column(1).to_numpy()]), False
            if not len(key):
                continue
            end = len(key) if last else int(np.searchsorted(key, key[-1], side="left"))
            held = (key[end:], fp[end:])
            key, x = key[:end], fp[:end].view(np.uint64)
            begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if end else np.zeros(0, np.int64)
            length = np.diff(np.concatenate([begin, [end]]))
            new = [p for p in pairs(key, x, begin, length) if sets.join(*p)]
            if new:
                yield table({"a": [min(p) for p in new], "b": [max(p) for p in new]}, _LINK)

    n = int(session(fps).conf.get("spark.sql.shuffle.partitions"))
    keys = _bounded_keys(fps.select("fp").mapInArrow(keyed, _KEYED_DDL), radius, most).select("key", "fp")
    return keys.repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(linked, "a long, b long")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Texts without words have fingerprint zero and link like any other. Rows of a null id keep their
    fingerprint and take part, but never name a component. An empty table gives no rows; columns
    other than id and text are not read, so clashing names do no harm.
    """
    fp = cut(fingerprints(docs, words, id_col, text_col))
    uniq = cut(fp.groupBy("fp").agg(F.min("doc_id").alias("root")))
    found = components(near_links(uniq, radius))
    rooted = uniq.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "root", F.coalesce("component", "fp").alias("component"))
    least = rooted.groupBy("component").agg(F.min("root").alias("component_id"))
    named = rooted.join(least, "component").select("fp", "component_id")
    return fp.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


__all__ = ["distance_table", "fingerprint", "fingerprints", "near_links", "simhash_components"]
