"""Order-preserving packing by dynamic programming over window cuts."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from tidemill.llm.common import table
from tidemill.llm.shards import _spans, ordered
from tidemill.llm.tokens import encoder

#: Text bytes that one run of the dynamic programme covers; a run's last window is the only one it must close.
RUN_BYTES = 4 << 20
#: Penalties in ids: a cut within a document at the end of a sentence, and a cut inside a sentence.
SENTENCE, INSIDE = 1, 6
#: Windows start and end at candidate cuts; a sentence longer than this has candidates inside it, too.
LONGEST_GAP = 32


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions where a window may end, ascending from 0, and the truncation penalty of each."""
    none = np.iinfo(np.int16).max
    penalty = np.full(int(doc_ends[-1]) + 1, none, np.int16)
    penalty[sentence_ends] = SENTENCE
    penalty[doc_ends] = penalty[0] = 0
    pos = np.flatnonzero(penalty != none)
    for k in np.flatnonzero(np.diff(pos) > LONGEST_GAP).tolist():
        penalty[pos[k] + LONGEST_GAP : pos[k + 1] : LONGEST_GAP] = INSIDE
    pos = np.flatnonzero(penalty != none)
    return pos, penalty[pos].astype(np.int64)


def choose_cuts(pos: np.ndarray, pen: np.ndarray, size: int = 1024) -> list[int]:
    """Indices into pos of the cuts that minimise padding plus penalties, windows of 1 to size ids.

    cost[i] = pen[i] + min over j of cost[j] + padding(pos[i] - pos[j]). Padding is size less the
    length, so the minimum is that of cost[j] + pos[j] over a window that slides: a monotone queue
    keeps it. A window whose length is a power of two has no padding; those few are looked up.
    """
    p, penalty, n = pos.tolist(), pen.tolist(), len(pos)
    # (place, earlier place) whose distance is a power of two, by place.
    exact = []
    for w in (1 << k for k in range(size.bit_length()) if 1 << k < size):
        k = np.searchsorted(pos, pos - w)
        i = np.flatnonzero(pos[k] == pos - w)
        exact.append(np.stack([i, k[i]], axis=1))
    exact = np.concatenate(exact)
    exact = exact[np.argsort(exact[:, 0], kind="stable")]
    upto = np.searchsorted(exact[:, 0], np.arange(n + 1)).tolist()
    earlier = exact[:, 1].tolist()
    cost, back = [0] * n, [0] * n
    queue, values, head = [0], [p[0]], 0
    for i in range(1, n):
        x = p[i]
        while p[queue[head]] < x - size:
            head += 1
        j = queue[head]
        best = values[head] + size - x
        for k in earlier[upto[i] : upto[i + 1]] if upto[i] < upto[i + 1] else ():
            if cost[k] < best:
                best, j = cost[k], k
        cost[i] = best = best + penalty[i]
        back[i] = j
        value = best + x
        while len(queue) > head and values[-1] >= value:
            queue.pop()
            values.pop()
        queue.append(i)
        values.append(value)
    cuts, i = [], len(p) - 1
    while i:
        cuts.append(i)
        i = back[i]
    return [0, *reversed(cuts)]


_PIECE = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")])


def pack(docs: DataFrame, path: str, size: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents in sequences of at most size ids, in document order.

    Per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens,
    sequence_id, offset. Every id lies in one piece; an empty or null text is its end id alone.
    Documents go in ascending id to ranges of ids, and a range in runs of about RUN_BYTES to the
    dynamic programme; a run's sequences are its own. An empty table gives no rows.
    """

    def run(batches):
        enc, sequence = encoder(path, "byte"), TaskContext.get().partitionId() << 40
        for keys, texts in _spans(batches, RUN_BYTES):
            ids, ends, upto = _encoded(enc, texts, end_id)
            pos, pen = candidates(upto[1:], ends)
            cuts = pos[choose_cuts(pos, pen, size)]
            bounds = np.sort(np.concatenate([cuts, upto]))
            bounds = bounds[np.concatenate([[True], bounds[1:] != bounds[:-1]])]
            begin, length = bounds[:-1], np.diff(bounds)
            doc = np.searchsorted(upto, begin, side="right") - 1
            window = np.searchsorted(cuts, begin, side="right") - 1
            raw = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)]
            yield table(
                {
                    "doc_id": [keys[d] for d in doc.tolist()],
                    "start": begin - upto[doc],
                    "length": length,
                    "ids_crc32": crc,
                    "doc_tokens": np.diff(upto)[doc],
                    "sequence_id": sequence + window,
                    "offset": begin - cuts[window],
                },
                _PIECE,
            )
            sequence += len(cuts) - 1

    return ordered(docs, id_col, text_col).mapInArrow(run, ", ".join(f"`{f.name}` long" for f in _PIECE))


def _encoded(enc, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids with end ids, positions after which a sentence ends, where documents begin (one more: the end)."""
    found, ends, lengths, base = [], [], [], 0
    for a in range(0, len(texts), 256):
        ids, sentence, upto = enc.encode_many(texts[a : a + 256])
        found.append(np.insert(ids, upto[1:], end_id))
        marks = np.insert(sentence, upto[1:], False)
        ends.append(base + np.flatnonzero(marks) + 1)
        lengths.append(np.diff(upto) + 1)
        base += len(marks)
    return np.concatenate(found), np.concatenate(ends), np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
