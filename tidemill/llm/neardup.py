"""SimHash near duplicates at a similarity of shingle sets: pivot distance tables, then the sets themselves.

Each text has a fingerprint: a SimHash of WIDE bits over its distinct shingles. Two texts at the least
similarity differ in 0.15 to 0.19 of the bits, whatever their length, so the radius lies more than five
deviations beyond that; unrelated texts differ in half of them. Texts that can be similar are brought
together by shared shingles: a text's keys are the least of its shingles under KEYS hashes, and two
texts have a given key in common with a probability that is their similarity.

Within a key a table of distances to reference fingerprints (members of the key) discards pairs by
their largest coordinate difference, then by the fingerprints themselves; what holds together falls
into pieces. Only texts of a piece bring their shingle sets along. A text most of whose shingles no
other of the piece has can't be similar to any and is passed over; all other pairs of the piece are
compared by the sets, and only pairs that pass are joined. Keys are taken in rounds, and pieces whose
texts are joined already are passed over, so a group of copies is compared once and not once for
each key. A piece of very many texts is compared in parts, part against part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import binary, bounded_batches, cut, restrict, session, table
from tidemill.llm.components import Sets, components
from tidemill.llm.decontam import _Hasher, _mix, shingle_hashes
from tidemill.llm.simhash import reference

WORDS, LEAST = 5, 0.8
#: Keys of each text, and the rounds they are taken in: 1 in 390,000 pairs at the least similarity has none in common.
KEYS = 8
ROUNDS = ((0, 1), (1, 3), (3, 8))
#: Bits of a fingerprint, and those that may differ: 48 on average at the least similarity, deviation 6.2.
WIDE, RADIUS = 256, 79
#: Reference fingerprints taken from each key.
PIVOTS = 8
#: Fingerprints of one key that are held against each other in one task; longer keys go by set size and in parts.
KEY_RUN = 1 << 14
#: Sets compared at once with those that come after them.
BLOCK = 512
#: Documents of one piece, and shingles of them, that are compared in one task.
RUN, RUN_SHINGLES = 1 << 14, 1 << 21
#: A side that is compared with all.
ANY = 2
#: A shingle in this many pairs of two blocks or fewer is counted pair by pair, others by matrix product.
FEW_PAIRS = 1024

_KEYED = pa.schema([("doc_id", pa.int64()), ("keys", pa.list_(pa.int64())), ("size", pa.int64()), ("fp", pa.binary())])
_SETS = pa.schema([("doc_id", pa.int64()), ("shingles", pa.binary())])
_PIECE = pa.schema([("orig", pa.int64()), ("doc_id", pa.int64()), ("size", pa.int64()), ("c", pa.int64())])
_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def text_shingles(text: bytes, hasher: _Hasher, words: int = WORDS) -> np.ndarray:
    """Hash of each shingle of a text, repeats included; fewer words: one of them all."""
    h = hasher.words(np.frombuffer(text, np.uint8))[2]
    return shingle_hashes(h, min(words, len(h))) if len(h) else np.zeros(0, np.uint64)


def set_fingerprint(h: np.ndarray, salts: np.ndarray) -> bytes:
    """SimHash of a set of shingle hashes: a bit is set if it is set in over half of them, 64 bits for each salt."""
    ones = np.zeros(64 * len(salts), np.int64)
    for a in range(0, len(h), 255):  # what a byte can count
        mixed = _mix(h[a : a + 255, None] ^ salts)
        ones += np.add.reduce(np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(h), bitorder="little").tobytes()


def keys_of(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, keys, size, fp) of each text that has words: KEYS keys, its number of distinct shingles, its fingerprint."""
    bounded_batches(session(docs))
    salts, bits = reference(KEYS, 3), reference(WIDE // 64, 4)

    def run(batches):
        hasher = _Hasher()
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                h = np.unique(text_shingles(text, hasher, words))
                if not len(h) or doc is None:
                    continue
                keys = [int(_mix((_mix(h ^ s)).min(keepdims=True) + np.uint64(k)).view(np.int64)[0]) for k, s in enumerate(salts)]
                out.append((doc, keys, len(h), set_fingerprint(h, bits)))
            yield table({n: [r[k] for r in out] for k, n in enumerate(_KEYED.names)}, _KEYED)

    return docs.select(F.col(id_col).cast("long"), binary(text_col)).mapInArrow(run, "doc_id long, keys array<long>, size long, fp binary")


def sets_of(docs: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, shingles): the distinct shingles of each text, ascending."""

    def run(batches):
        hasher = _Hasher()
        for b in batches:
            sets = [np.unique(text_shingles(t, hasher, words)).tobytes() for t in b.column(1).to_pylist()]
            yield table({"doc_id": b.column(0), "shingles": sets}, _SETS)

    return docs.select(F.col(id_col).cast("long"), binary(text_col)).mapInArrow(run, "doc_id long, shingles binary")


def pieces(fps: np.ndarray, sizes: np.ndarray, radius: int = RADIUS, least: float = LEAST) -> np.ndarray:
    """To each fingerprint (row of words) the number of its piece: what pairs that may be similar hold together.

    The table has the distances to PIVOTS members. A pair is discarded if a coordinate differs by more than
    the radius, if the distance itself is over it, or if the sizes of the sets rule the similarity out.
    """
    n = len(fps)
    picks = fps[np.unique(np.linspace(0, n - 1, min(PIVOTS, n)).astype(np.int64))]
    coordinates = np.bitwise_count(fps[:, None, :] ^ picks[None, :, :]).sum(axis=2, dtype=np.int16)
    label, left, number = np.full(n, -1), np.arange(n), 0
    while len(left):
        front, left = [int(left[0])], left[1:]
        label[front] = number
        while front and len(left):
            x = front.pop()
            ok = np.abs(coordinates[left] - coordinates[x]).max(axis=1) <= radius
            ok &= np.minimum(sizes[left], sizes[x]) >= least * np.maximum(sizes[left], sizes[x])
            at = np.flatnonzero(ok)
            at = at[np.bitwise_count(fps[left[at]] ^ fps[x]).sum(axis=1) <= radius]
            label[left[at]] = number
            front += left[at].tolist()
            left = np.delete(left, at)
        number += 1
    return label


def _common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """How many members each set of a has in common with each of b."""
    x, y = np.concatenate(a), np.concatenate(b)
    i, j = np.repeat(np.arange(len(a)), [len(s) for s in a]), np.repeat(np.arange(len(b)), [len(s) for s in b])
    i, x = i[o := np.argsort(x, kind="stable")], x[o]
    j, y = j[o := np.argsort(y, kind="stable")], y[o]
    values, first, many = np.unique(x, return_index=True, return_counts=True)
    low, high = np.searchsorted(y, values, side="left"), np.searchsorted(y, values, side="right")
    pairs = many * (high - low)
    out = np.zeros(len(a) * len(b), np.int64)
    few = np.flatnonzero((pairs > 0) & (pairs <= FEW_PAIRS))
    for part in np.split(few, np.searchsorted(np.cumsum(pairs[few]), np.arange(1 << 21, pairs[few].sum(), 1 << 21))) if len(few) else []:
        size, width = pairs[part], (high - low)[part]
        k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        w = np.repeat(width, size)
        out += np.bincount(i[np.repeat(first[part], size) + k // w] * len(b) + j[np.repeat(low[part], size) + k % w], minlength=len(out))
    out = out.reshape(len(a), len(b))
    often = np.flatnonzero(pairs > FEW_PAIRS)
    for c in range(0, len(often), 2048):
        part = often[c : c + 2048]
        m, n = np.zeros((len(a), len(part)), np.float32), np.zeros((len(b), len(part)), np.float32)
        for at, (f, q, lo, hi) in enumerate(zip(first[part], many[part], low[part], high[part], strict=True)):
            m[i[f : f + q], at] = 1
            n[j[lo:hi], at] = 1
        out += (m @ n.T).astype(np.int64)
    return out


def _similar(a: list[np.ndarray], b: list[np.ndarray], sizes_a: np.ndarray, sizes_b: np.ndarray, least: float) -> np.ndarray:
    """Whether each set of a has the least Jaccard similarity with each of b, or more."""
    both = _common(a, b)
    return (both >= least * (sizes_a[:, None] + sizes_b[None, :] - both)) & (both > 0)


def _shared(sets: list[np.ndarray], sizes: np.ndarray, least: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sets (numbers; given as their members' bytes) that may be similar to another, and of each the members that
    another of these has, too.

    A set similar to another has the least similarity's share of its members in common with it. Sets that
    have fewer in common with all others together go, until none does.
    """
    values, code = np.unique(np.concatenate(sets).view(np.uint64), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    while True:
        rows = np.bincount(code, minlength=len(values))[code] > 1
        code, owner = code[rows], owner[rows]
        alive = np.bincount(owner, minlength=len(sets)) >= np.maximum(1, least * sizes - 1e-9)
        if alive[owner].all():
            break
        code, owner = code[alive[owner]], owner[alive[owner]]
    left = np.flatnonzero(alive)
    return left, np.split(code, np.searchsorted(owner, left[1:])) if len(left) else []


def _joined(ids: list[int], sets: list[np.ndarray], known: list[int], side: list[int], least: float) -> list[tuple[int, int]]:
    """Spanning links of all similar pairs between what is known to be joined; of sides 0 and 1, only those across."""
    up, links = Sets(), []
    for i, c in zip(ids, known, strict=True):
        up.join(i, c)
    all_sizes = np.array([len(x) // 8 for x in sets])
    left, parts = _shared(sets, all_sizes, least)
    order = np.argsort(all_sizes[left], kind="stable")
    rows, sizes, sides = left[order], all_sizes[left][order], np.array(side)[left][order]
    parts = [parts[k] for k in order.tolist()]
    for a in range(0, len(rows), BLOCK):
        one = slice(a, min(a + BLOCK, len(rows)))
        for b in range(a, len(rows), BLOCK):
            two = slice(b, min(b + BLOCK, len(rows)))
            if sizes[b] * least - 1e-9 > sizes[one.stop - 1]:
                break
            if len({up.root(ids[k]) for k in (*rows[one].tolist(), *rows[two].tolist())}) == 1:
                continue
            ok = _similar(parts[one], parts[two], sizes[one], sizes[two], least)
            ok &= (sides[one][:, None] != sides[two][None, :]) | (sides[one][:, None] == ANY)
            if a == b:
                ok = np.triu(ok, 1)
            for i, j in zip(*(x.tolist() for x in np.nonzero(ok)), strict=True):
                p, q = ids[rows[a + i]], ids[rows[b + j]]
                if p != q and up.join(p, q):
                    links.append((min(p, q), max(p, q)))
    return links


def _values(c: pa.Array) -> list:
    """Values of a column; of a binary one, views of its buffer, so that no copies of many short arrays are made."""
    if not pa.types.is_binary(c.type):
        return c.to_pylist()
    offsets = np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1].tolist()
    data = np.frombuffer(c.buffers()[2] or b"", np.uint8)
    return [data[a:b] for a, b in zip(offsets, offsets[1:], strict=False)]


def _groups(batches) -> Iterator[list[list]]:
    """Columns of each run of rows with one value in the first."""
    held: list[list] = []
    for b in batches:
        columns = [_values(c) for c in b.columns]
        edges = [k for k in range(1, b.num_rows) if columns[0][k] != columns[0][k - 1]]
        for a, z in zip([0, *edges], [*edges, b.num_rows], strict=True):
            if a == z:
                continue
            if held and held[0][-1] != columns[0][a]:
                yield held
                held = []
            held = [h + c[a:z] for h, c in zip(held, columns, strict=True)] if held else [c[a:z] for c in columns]
    if held:
        yield held


def _compare(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join the similar documents of each g of rows (g, doc_id, c, side); of one c are joined already."""

    def run(batches):
        for _, ids, c, side, raw in _groups(batches):
            found = _joined(ids, raw, c, side, least) if len(ids) > 1 else []
            if found:
                yield table({"a": [p for p, _ in found], "b": [q for _, q in found]}, _LINK)

    return _dealt(rows.join(sets, "doc_id").select("g", "doc_id", "c", "side", "shingles"), "g").mapInArrow(run, "a long, b long")


def _dealt(rows: DataFrame, by: str) -> DataFrame:
    n = int(session(rows).conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, by).sortWithinPartitions(by, "doc_id")


def _count(rows: DataFrame, run: int) -> DataFrame:
    """(orig, parts): into how many parts each group is dealt, for groups whose documents aren't all joined yet."""
    n = rows.groupBy("orig").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high")
    return n.select("orig", F.ceil(F.greatest(F.col("n") / run, F.when(F.col("n") > 2, F.col("s") / RUN_SHINGLES).otherwise(0.0))).cast("long").alias("parts"))


def _in_pieces(rows: DataFrame, least: float) -> DataFrame:
    """(orig, doc_id, size, c): the pieces of each key's documents, those left out that are alone or joined already."""

    def run(batches):
        for key, ids, sizes, c, fps in _groups(batches):
            label = pieces(np.concatenate(fps).view(np.uint64).reshape(len(ids), -1), np.array(sizes), RADIUS, least)
            out = []
            for k in range(int(label.max()) + 1):
                at = np.flatnonzero(label == k).tolist() if label.max() else range(len(ids))
                if len(at) > 1 and len({c[i] for i in at}) > 1:
                    name = int(_mix(np.array([key[0]], np.int64).view(np.uint64) + np.uint64(k + 1)).view(np.int64)[0])
                    out += [(name, ids[i], sizes[i], c[i]) for i in at]
            if out:
                yield table(dict(zip(_PIECE.names, zip(*out, strict=True), strict=True)), _PIECE)

    return _dealt(rows.select("orig", "doc_id", "size", "c", "fp"), "orig").mapInArrow(run, "orig long, doc_id long, size long, c long")


def _links_of(rows: DataFrame, sets: DataFrame, run: int, least: float) -> DataFrame:
    """(a, b): links that join all similar documents of each group of rows (orig, doc_id, size, c).

    A group of up to so many documents is compared in one task. A longer one falls into windows by the
    size of the sets: sizes of two that are similar differ by no more than the least similarity, so
    they have a window in common. A window that is still too long is compared part against part.
    """
    side = F.lit(ANY).alias("side")
    counted = cut(_count(rows, run))
    whole = lambda d, n: _compare(d.join(n.where("parts = 1"), "orig").select(F.col("orig").alias("g"), "doc_id", "c", side), sets, least)
    links = whole(rows, counted)
    if counted.where("parts > 1").isEmpty():
        return links
    bucket = F.floor(F.log("size") / (-math.log(least) + 1e-6))
    wide = rows.join(counted.where("parts > 1"), "orig").select("doc_id", "size", "c", "orig", F.explode(F.array(bucket, bucket + 1)).alias("w"))
    rows = cut(wide.select("doc_id", "size", "c", F.xxhash64("orig", "w").alias("orig")))
    counted = cut(_count(rows, run))
    links = links.unionByName(whole(rows, counted))
    long = cut(rows.join(counted.where("parts > 1"), "orig"))
    if long.isEmpty():
        return links
    # Each part by itself first: what is joined then need not be compared across parts.
    part = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.col("parts"))
    within = cut(_compare(long.select(F.xxhash64("orig", part).alias("g"), "doc_id", "c", side), sets, least))
    joined = components(within.unionByName(long.where("doc_id <> c").select(F.least("doc_id", "c").alias("a"), F.greatest("doc_id", "c").alias("b"))))
    now = long.select("orig", "doc_id", "size").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    now = cut(now.select("orig", "doc_id", "size", F.coalesce("component", "doc_id").alias("c")))
    return links.unionByName(within).unionByName(_across(now, sets, run, least))


def _across(rows: DataFrame, sets: DataFrame, run: int, least: float) -> DataFrame:
    """Links between documents of one orig that aren't of one c, part against part.

    A c of many documents has parts of its own, which aren't compared with each other; all others share parts.
    """
    weight = F.greatest(F.count(F.lit(1)) / run, F.sum("size") / RUN_SHINGLES) * 2  # two parts meet in a task
    each = rows.groupBy("orig", "c").agg(weight.alias("w")).withColumn("own", F.col("w") >= 1)
    mixed = each.where("not own").groupBy("orig").agg(F.ceil(F.sum("w")).cast("long").alias("k0"))
    placed = rows.join(each, ["orig", "c"]).join(mixed, "orig", "left")
    alone = F.xxhash64("orig", "c", F.pmod(F.xxhash64("doc_id", F.lit(2)), F.ceil("w").cast("long")))
    shared = F.xxhash64("orig", F.lit("mixed"), F.pmod(F.xxhash64("c", F.lit(3)), F.col("k0")))
    placed = cut(placed.select("orig", "doc_id", "c", F.when(F.col("own"), alone).otherwise(shared).alias("part"), F.when(F.col("own"), F.col("c")).alias("big")))
    parts = cut(placed.select("orig", "part", "big").distinct())
    x, y = (parts.select("orig", F.col("part").alias(n), F.col("big").alias(f"big_{n}")) for n in ("x", "y"))
    meet = x.join(y, "orig").where((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("big_x") == F.col("big_y"), F.lit(False)))
    ends = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("part"), F.lit(ANY).alias("side"))))
    ends = ends.otherwise(F.array(F.struct(F.col("x").alias("part"), F.lit(0).alias("side")), F.struct(F.col("y").alias("part"), F.lit(1).alias("side"))))
    dealt = cut(meet.select("orig", F.xxhash64("orig", "x", "y").alias("g"), F.explode(ends).alias("e")).select("orig", "g", "e.part", "e.side"))
    return _compare(placed.join(dealt, ["orig", "part"]).select("g", "doc_id", "c", "side"), sets, least)


def near_components(
    docs: DataFrame, words: int = WORDS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, key_run: int = KEY_RUN
) -> DataFrame:
    """(node, component) of the documents that have a near duplicate; component is the least of its group.

    Rounds over the keys; after each the links found so far are settled. Ids must be distinct and not
    null (see drop_near, which makes them so). Texts without words have no near duplicate.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    keyed = cut(keys_of(texts, words, "doc_id", "text"))
    known: DataFrame | None = None
    for begin, end in ROUNDS:
        c = F.col("doc_id").alias("c")
        now = keyed if known is None else keyed.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        if known is not None:
            c = F.coalesce("component", "doc_id").alias("c")
        rows = now.select("doc_id", "size", "fp", c, F.explode(F.slice("keys", begin + 1, end - begin)).alias("orig")).dropDuplicates(["orig", "doc_id"])
        n = rows.groupBy("orig").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("orig", "n")
        rows = rows.join(cut(n), "orig")
        held = _in_pieces(rows.where(F.col("n") <= key_run), least)
        held = cut(held.unionByName(rows.where(F.col("n") > key_run).select("orig", "doc_id", "size", "c")))
        if held.isEmpty():
            continue
        wanted = cut(held.select("doc_id").distinct())
        sets = cut(sets_of(restrict(texts, wanted, ["doc_id"], "left_semi"), words, "doc_id", "text"))
        links = _links_of(held, sets, run, least)
        if known is not None:
            links = links.unionByName(known.where("node <> component").select(F.col("component").alias("a"), F.col("node").alias("b")))
        known = components(links)
    return docs.sparkSession.createDataFrame([], "node long, component long") if known is None else known


def _noded(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """(row, id, text, node): the caller's row as one struct, so that no name of its columns can meet one used here, and a
    number for each row that no other text has: the id, or a hash for rows whose id is null or repeated."""
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    again = cut(rows.groupBy(F.col("id").alias("again")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 or again is null").select("again"))
    if again.isEmpty():
        return rows.withColumn("node", F.col("id")), False
    ids = again.withColumn("odd", F.lit(True))
    small = ids.count() < 1 << 18
    marked = rows.join(F.broadcast(ids) if small else ids, F.col("id").eqNullSafe(F.col("again")), "left")
    hashed = F.xxhash64(F.coalesce(F.col("id"), F.lit(-1).cast("long")), F.col("id").isNull(), F.col("text"))
    return marked.withColumn("node", F.when(F.col("odd"), hashed).otherwise(F.col("id"))).drop("again", "odd"), True


def drop_near(docs: DataFrame, words: int = WORDS, least: float = LEAST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without those that have one of a smaller id in their group; all columns stay.

    Rows that repeat an id are documents of their own, told apart by their text; of two of one group
    with the same id one stays, and rows that repeat id and text stay together. A null id comes after
    all others. Texts without words stay. An empty table gives none.
    """
    rows, odd = _noded(docs, id_col, text_col)
    found = near_components(rows, words, least, "node", "text")
    if odd:
        # The least node of a group needn't be the least id: the row that stays is chosen by id.
        named = restrict(rows.select("node", "id"), cut(found.select("node")), ["node"], "left_semi")
        order = F.struct(F.col("id").isNull(), "id", "node")
        first = found.join(named, "node").groupBy("component").agg(F.min(order)["node"].alias("first"))
        gone = found.join(first, "component").where("node <> first")
    else:
        gone = found.where("node <> component")
    return restrict(rows, cut(gone.select("node").distinct()), ["node"], "left_anti").select("row.*")
