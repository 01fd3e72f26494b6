"""Removal of long strings repeated across documents, by suffix sorting at sampled places.

Whatever 50 bytes two documents share, they share the least-hashed 16 bytes within them, at the same
place. So it is enough to sort suffixes at those anchors: about one byte in seventeen.

1. Anchors of every document go, as hashes alone, to buckets; anchors of two documents or more go
   back to the groups of documents that have them.
2. Each group of documents cuts out the text around its repeated anchors, and deep-shallow sorts
   these contexts. Of equal contexts the one in the least document goes on; the others are covered.
3. In each bucket the contexts of all groups are sorted likewise; where an anchor has contexts that
   differ, their 50-byte strings are sorted, and each equal to one of a smaller document is covered.
4. Each group of documents takes its covered places out.

Every decision compares bytes; hashes only bring together what is compared. Group and bucket sizes
follow from the bytes of the input. A string in a third of all documents is one context in each
group, so a hot bucket has as many of it as there are groups, not documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import binary, bounded_batches, session, table
from tidemill.llm.decontam import _BACK, _ODD, _mix, _powers
from tidemill.llm.suffix import as_words, deep_shallow

LENGTH = 50
#: Bytes of an anchor, and windows of that size within one string.
ANCHOR = 16
#: Starts taken at once in a long document.
BLOCK = 1 << 17
#: Text bytes of a group of documents, about; and of what the first step takes before it writes.
GROUP_BYTES, FLUSH_BYTES = 12 << 20, 6 << 20
#: Strings of 50 bytes sorted at once.
STRINGS = 1 << 16
_PLACE = (1 << 18) - 1


class Anchors:
    """Anchors of byte texts: for each run of string starts with the same one, its place and hash."""

    def __init__(self, length: int = LENGTH):
        self.length, self.wide = length, length - ANCHOR + 1
        self.up, self.down = _powers(_ODD, BLOCK + length + 1), _powers(_BACK, BLOCK + length + 1)

    def _block(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        sums = np.zeros(len(x) + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[: len(x)], out=sums[1:])
        h = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * self.down[: len(x) - ANCHOR + 1])
        low = (h & ~np.uint64(_PLACE)) | np.arange(len(h), dtype=np.uint64)  # the leftmost of the least
        step = 1
        while step * 2 <= self.wide:
            low = np.minimum(low[:-step], low[step:])
            step *= 2
        if step < self.wide:
            low = np.minimum(low[: len(low) - (self.wide - step)], low[self.wide - step :])
        place = (low & np.uint64(_PLACE)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        last = np.concatenate([first[1:], [len(place)]]) - 1
        return first, last, place[first], h[place[first]]

    def of(self, text: bytes) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By block: its offset, its bytes, first and last string start, anchor place, anchor hash."""
        x = np.frombuffer(text, np.uint8)
        for a in range(0, len(x) - self.length + 1, BLOCK):
            part = x[a : a + BLOCK + self.length - 1]
            yield a, part, *self._block(part)


def _five(h: np.ndarray) -> bytes:
    """The upper 40 bits of each hash."""
    return (h >> np.uint64(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfive(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(data, np.uint8).reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


_ROW = pa.schema([("key", pa.int64()), ("data", pa.binary())])
_DDL = "key long, data binary"
_FLAG = np.uint32(1 << 31)


def _rows(pairs: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"key": pa.array([p[0] for p in pairs], pa.int64()), "data": pa.array([p[1] for p in pairs], pa.binary())}, schema=_ROW)


def _splits(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Runs of equal values of a sorted array."""
    cuts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])) if len(key) else np.zeros(1, np.int64)
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        yield int(key[a]), slice(a, b)


def _anchor_rows(batches, buckets: int, length: int):
    """(bucket, hashes and groups): one entry for each anchor and group of documents that are taken together."""
    anchors = Anchors(length)

    def flush(hs, gs):
        h, g = np.concatenate(hs), np.concatenate(gs)
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])
        first = np.flatnonzero(new)
        many = np.diff(np.concatenate([first, [len(h)]])) > 1
        h, g = h[first], g[first] | np.where(many, _FLAG, np.uint32(0))
        bucket = (h % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        h, g, bucket = h[order], g[order], bucket[order]
        out = [(k, np.uint32(s.stop - s.start).tobytes() + _five(h[s]) + g[s].tobytes()) for k, s in _splits(bucket)]
        return table({"key": [p[0] for p in out], "data": [p[1] for p in out]}, _ROW)

    hs, gs, size = [], [], 0
    for b in batches:
        for g, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            found = [part[5] for part in anchors.of(text)]
            if found:
                h = np.unique(np.concatenate(found))
                hs.append(h)
                gs.append(np.full(len(h), g, np.uint32))
                size += len(text)
            if size >= FLUSH_BYTES:
                yield flush(hs, gs)
                hs, gs, size = [], [], 0
    if hs:
        yield flush(hs, gs)


def _repeated(t: pa.Table) -> pa.Table:
    """Of one bucket: to each group its anchors that two documents or more have."""
    hs, gs = [], []
    for data in t["data"].to_pylist():
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        hs.append(_unfive(data[4 : 4 + 5 * n]))
        gs.append(np.frombuffer(data, np.uint32, n, 4 + 5 * n))
    h, g = np.concatenate(hs), np.concatenate(gs)
    order = np.argsort(h, kind="stable")
    h, g = h[order], g[order]
    first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    count = np.diff(np.concatenate([first, [len(h)]]))
    ok = np.repeat((count > 1) | np.logical_or.reduceat((g & _FLAG) > 0, first), count)
    h, g = h[ok], g[ok] & ~_FLAG
    order = np.lexsort((h, g))
    h, g = h[order], g[order]
    return _rows([(k, _five(np.unique(h[s]) << np.uint64(24))) for k, s in _splits(g.astype(np.int64))])


def _spread(out: np.ndarray, text: np.ndarray, starts: np.ndarray, sizes: np.ndarray, to: np.ndarray) -> None:
    """Copies runs of a byte array (starts, sizes) to places of another, some thousand runs at a time."""
    for a in range(0, len(starts), 1 << 13):
        s, n, t = starts[a : a + (1 << 13)], sizes[a : a + (1 << 13)], to[a : a + (1 << 13)]
        ends = np.cumsum(n)
        step = np.arange(int(ends[-1])) - np.repeat(ends - n, n)
        out[step + np.repeat(t, n)] = text[step + np.repeat(s, n)]


class Contexts:
    """Texts around anchors: hash, place of the anchor in the context, length, document, group, row in
    the group, place in the document; and the bytes, one context after another."""

    FIELDS = (("h", "<u8"), ("left", "u1"), ("size", "<u2"), ("doc", "<i8"), ("group", "<u4"), ("row", "<u4"), ("at", "<u8"))

    def __init__(self, parts: dict[str, np.ndarray], text: np.ndarray):
        self.p, self.text = parts, text
        self.starts = np.cumsum(parts["size"], dtype=np.int64) - parts["size"]

    def __len__(self) -> int:
        return len(self.p["h"])

    @classmethod
    def join(cls, many: list[Contexts]) -> Contexts:
        return cls({k: np.concatenate([c.p[k] for c in many]) for k, _ in cls.FIELDS}, np.concatenate([c.text for c in many]))

    def take(self, rows: np.ndarray) -> Contexts:
        p = {k: v[rows] for k, v in self.p.items()}
        size = p["size"].astype(np.int64)
        text = np.zeros(int(size.sum()), np.uint8)
        _spread(text, self.text, self.starts[rows], size, np.cumsum(size) - size)
        return Contexts(p, text)

    def pack(self) -> bytes:
        raw = b"".join([np.uint32(len(self)).tobytes(), *(self.p[k].astype(t).tobytes() for k, t in self.FIELDS), self.text.tobytes()])
        return zstandard.ZstdCompressor(level=1).compress(raw)

    @classmethod
    def unpack(cls, data: bytes) -> Contexts:
        raw = zstandard.ZstdDecompressor().decompress(data)
        n, at, p = int(np.frombuffer(raw, np.uint32, 1)[0]), 4, {}
        for k, t in cls.FIELDS:
            p[k] = np.frombuffer(raw, t, n, at)
            at += p[k].nbytes
        return cls(p, np.frombuffer(raw, np.uint8, -1, at))

    def sorted_classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Deep-shallow order by anchor, place of it, size and bytes; and the class of each place in the order."""
        wide = -(-(2 * length - ANCHOR) // 8) * 8
        rows = np.zeros((len(self), 16 + wide), np.uint8)
        rows[:, :8] = self.p["h"].astype(">u8").view(np.uint8).reshape(-1, 8)
        rows[:, 8:16] = (self.p["left"].astype(np.uint64) << np.uint64(32) | self.p["size"].astype(np.uint64)).astype(">u8").view(np.uint8).reshape(-1, 8)
        _spread(rows.reshape(-1), self.text, self.starts, self.p["size"].astype(np.int64), 16 + np.arange(len(self)) * rows.shape[1])
        return deep_shallow(as_words(rows))

    def least(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of classes of equal contexts: order, class, and the least document of each place's class."""
        order, cls = self.sorted_classes(length)
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        return order, cls, np.minimum.reduceat(self.p["doc"][order], first)[cls]


def _cover(row: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    """Covered places of a group's rows, overlapping and touching ones joined."""
    order = np.lexsort((start, row))
    row, start, end = row[order], start[order], end[order]
    # Ends rise within a row from left to right once the largest so far is taken; rows are kept apart by an offset.
    span = int(end.max()) + 2
    top = np.maximum.accumulate(end + row * span) - row * span
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (start[1:] > top[:-1])])
    first = np.flatnonzero(new)
    last = np.concatenate([first[1:], [len(row)]]) - 1
    return np.stack([row[first], start[first], top[last]]).astype("<i8").tobytes()


def _contexts(docs: pa.Table, replies: pa.Table, buckets: int, length: int) -> pa.Table:
    """Of one group of documents: contexts to buckets, and what is covered by its own documents (negative key)."""
    if not len(docs) or not len(replies):
        return _rows([])
    known = np.unique(np.concatenate([_unfive(d) for d in replies["data"].to_pylist()]))
    group = int(docs["g"][0].as_py())
    anchors, many = Anchors(length), []
    for row, (doc, text) in enumerate(_in_order(docs)):
        if doc is None:
            continue
        for a, x, first, last, place, h in anchors.of(text):
            cut = h >> np.uint64(24)
            ok = known[np.minimum(np.searchsorted(known, cut), len(known) - 1)] == cut
            if not ok.any():
                continue
            first, last, place, h = first[ok], last[ok], place[ok], h[ok]
            size = last - first + length
            ends = np.cumsum(size)
            where = np.arange(int(ends[-1])) + np.repeat(first - (ends - size), size)
            p = {"h": h, "left": place - first, "size": size, "doc": np.full(len(h), doc), "group": np.full(len(h), group), "row": np.full(len(h), row), "at": first + a}
            many.append(Contexts({k: p[k].astype(t) for k, t in Contexts.FIELDS}, x[where]))
    if not many:
        return _rows([])
    c = Contexts.join(many)
    order, _, least = c.least(length)
    covered = c.p["doc"][order] > least
    out = []
    if covered.any():
        o = order[covered]
        at = c.p["at"][o].astype(np.int64)
        out.append((-1 - group, _cover(c.p["row"][o].astype(np.int64), at, at + c.p["size"][o])))
    rest = c.take(np.sort(order[~covered]))
    bucket = (rest.p["h"] % np.uint64(buckets)).astype(np.int64)
    by = np.argsort(bucket, kind="stable")
    return _rows(out + [(k, rest.take(by[s]).pack()) for k, s in _splits(bucket[by])])


def _string_covers(c: Contexts, cls: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Contexts in order with their classes, of anchors with several classes: (context, start of a covered string)."""
    n = c.p["size"].astype(np.int64) - length + 1  # strings of each context
    edges = np.flatnonzero(np.concatenate([[True], c.p["h"][1:] != c.p["h"][:-1]]))
    total = np.concatenate([[0], np.cumsum(n)])
    a = 0
    while a < len(edges):
        b = a + 1
        while b < len(edges) and total[edges[b + 1] if b + 1 < len(edges) else len(c)] - total[edges[a]] <= STRINGS:
            b += 1
        rows = np.arange(edges[a], edges[b] if b < len(edges) else len(c))
        a = b
        line = np.repeat(rows, n[rows])
        off = np.arange(len(line)) - np.repeat(np.cumsum(n[rows]) - n[rows], n[rows])
        wide = -(-length // 8) * 8
        strings = np.zeros((len(line), 16 + wide), np.uint8)
        strings[:, :8] = c.p["h"][line].astype(">u8").view(np.uint8).reshape(-1, 8)
        strings[:, 8:16] = (off - c.p["left"][line].astype(np.int64) + (1 << 32)).astype(">u8").view(np.uint8).reshape(-1, 8)
        windows = np.lib.stride_tricks.sliding_window_view(c.text, length)
        strings[:, 16 : 16 + length] = windows[c.starts[line] + off]
        order, same = deep_shallow(as_words(strings))
        doc = c.p["doc"][line[order]]
        first = np.flatnonzero(np.concatenate([[True], same[1:] != same[:-1]]))
        covered = order[doc > np.minimum.reduceat(doc, first)[same]]
        yield line[covered], off[covered]


def _bucket(t: pa.Table, length: int) -> pa.Table:
    """Of one bucket: what is covered in each group. Rows of a negative key pass, under the key of their group."""
    key = t["key"][0].as_py()
    if key < 0:
        return _rows([(-1 - key, d) for d in t["data"].to_pylist()])
    c = Contexts.join([Contexts.unpack(d) for d in t["data"].to_pylist()])
    order, cls, least = c.least(length)
    covered = c.p["doc"][order] > least
    o = order[covered]
    spans = [(o, c.p["at"][o].astype(np.int64), c.p["size"][o].astype(np.int64))]
    # Anchors with one class of contexts are settled; strings of the others are compared with each other.
    h = c.p["h"][order]
    edges = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    ends = np.concatenate([edges[1:], [len(h)]])
    several = np.repeat(cls[edges] != cls[ends - 1], ends - edges)
    left = order[several & ~covered]
    if len(left):
        part = c.take(left)
        for line, off in _string_covers(part, cls, length):
            rows = left[line]
            spans.append((rows, c.p["at"][rows].astype(np.int64) + off, np.full(len(rows), length)))
    row, at, size = (np.concatenate([s[k] for s in spans]) for k in range(3))
    group = c.p["group"][row].astype(np.int64)
    by = np.argsort(group, kind="stable")
    return _rows([(g, _cover(c.p["row"][row[by[s]]].astype(np.int64), at[by[s]], (at + size)[by[s]])) for g, s in _splits(group[by])])


def _in_order(docs: pa.Table) -> list[tuple[int | None, bytes]]:
    """A group's rows in an order that doesn't depend on how they came: by id and then text."""
    return sorted(zip(docs["doc_id"].to_pylist(), docs["t"].to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


_OUT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.binary())])
_OUT_DDL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _remove(docs: pa.Table, covers: pa.Table, with_text: bool) -> pa.Table:
    rows = _in_order(docs) if len(docs) else []
    spans: dict[int, list[tuple[int, int]]] = {}
    if len(covers):
        got = np.concatenate([np.frombuffer(d, "<i8").reshape(3, -1) for d in covers["data"].to_pylist()], axis=1)
        joined = np.frombuffer(_cover(*got), "<i8").reshape(3, -1)
        for r, a, b in joined.T.tolist():
            spans.setdefault(r, []).append((a, b))
    out: list[tuple] = []
    for k, (doc, text) in enumerate(rows):
        gone, parts, at = spans.get(k, []), [], 0
        for a, b in gone:
            parts.append(text[at:a])
            at = b
        kept = b"".join([*parts, text[at:]])
        out.append((doc, len(text), len(text) - len(kept), len(gone), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
    return pa.table({f.name: pa.array([r[i] for r in out], f.type) for i, f in enumerate(_OUT)}, schema=_OUT)


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept (if asked for).

    A byte goes if it is covered by a string of so many bytes that also starts in a document of a
    smaller id; strings are judged on the input. Null text: empty. Rows of a null id keep all their
    bytes and take none from others; rows of the same id take nothing from each other. An empty
    table gives no rows.
    """
    spark = session(docs)
    bounded_batches(spark)
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), binary(text_col).alias("t"))
    total = base.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(total) // GROUP_BYTES))
    rows = base.withColumn("g", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("t"))), F.lit(groups)).cast("long"))
    named = rows.where("doc_id is not null").select("g", "t")
    found = named.mapInArrow(lambda it: _anchor_rows(it, groups, length), _DDL)
    replies = found.groupBy("key").applyInArrow(_repeated, _DDL)
    texts = rows.groupBy("g")
    contexts = texts.cogroup(replies.groupBy("key")).applyInArrow(lambda a, b: _contexts(a, b, groups, length), _DDL)
    covers = contexts.groupBy("key").applyInArrow(lambda t: _bucket(t, length), _DDL)
    out = texts.cogroup(covers.groupBy("key")).applyInArrow(lambda a, b: _remove(a, b, with_text), _OUT_DDL)
    return out if with_text else out.drop("kept")
