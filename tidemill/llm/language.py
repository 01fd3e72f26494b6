"""Language identification by prediction by partial matching over bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import binary, bounded_batches, bounded_sample, crc_mod4, session, table

#: Bytes of context of the deepest trees.
ORDER = 3
#: Learned from this many labelled rows of each language at most, those with the least hash of the id.
SAMPLE_ROWS = 1200
#: Bytes taken at once.
BLOCK = 1 << 20
#: Letters and some numbers besides; see has_letter.
_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_START = b"\n" * ORDER


def has_letter(text: str) -> bool:
    """Whether any character is of a letter category; signs such as superscripts, fractions and Roman numerals aren't."""
    return any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def grams(text: bytes) -> np.ndarray:
    """For each byte of a text, itself and the ORDER bytes before it as one number; line ends stand before the text."""
    x = np.frombuffer(_START + text, np.uint8).astype(np.uint32)
    return x[:-3] << 24 | x[1:-2] << 16 | x[2:-1] << 8 | x[3:]


def _sum_by(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    uniq, at = np.unique(keys, return_inverse=True)
    return uniq, np.bincount(at, counts, len(uniq))


class ByteTrees:
    """Context trees of orders 3 to 0 for some languages, as code lengths in nats under frozen counts.

    A byte's code at a context seen n times with q distinct bytes: count / (n + q) if it was seen
    there, else the escape q / (n + q) and its code at the next shorter context. A context never
    seen costs nothing. Below order 0 all 256 bytes are alike.
    """

    def __init__(self, counts: dict[str, tuple[np.ndarray, np.ndarray]]):
        self.langs = sorted(counts)
        k = len(self.langs)
        lower = np.full((1, k), np.log(256.0))  # code length by (gram of the order below)
        self.orders: list[tuple] = []
        for order in range(ORDER + 1):
            mask = np.uint32((1 << 8 * (order + 1)) - 1)
            per = [_sum_by(g & mask, c.astype(float)) for g, c in (counts[x] for x in self.langs)]
            keys = np.unique(np.concatenate([p[0] for p in per] or [np.zeros(0, np.uint32)]))
            contexts = np.unique(keys >> np.uint32(8))
            seen, totals, distinct = np.zeros((len(keys), k)), np.zeros((len(contexts), k)), np.zeros((len(contexts), k))
            for j, (g, c) in enumerate(per):
                seen[np.searchsorted(keys, g), j] = c
                at = np.searchsorted(contexts, g >> np.uint32(8))
                totals[:, j] = np.bincount(at, c, len(contexts))
                distinct[:, j] = np.bincount(at, minlength=len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(totals > 0, np.log(totals + distinct) - np.log(distinct), 0.0)
                at = np.searchsorted(contexts, keys >> np.uint32(8))
                known = np.log(totals + distinct)[at] - np.log(seen)
            if order == 0:
                below = np.repeat(lower, len(keys), axis=0)
            else:
                below = self._at(keys & (mask >> np.uint32(8)), order - 1)
            self.orders.append((keys, np.where(seen > 0, known, escape[at] + below), contexts, escape))

    def _at(self, g: np.ndarray, order: int) -> np.ndarray:
        """Code lengths, a row for each gram and a column for each language, from this order downwards."""
        if order < 0:
            return np.full((len(g), len(self.langs)), np.log(256.0))
        keys, bits, contexts, escape = self.orders[order]
        out = np.empty((len(g), len(self.langs)))
        at = np.minimum(np.searchsorted(keys, g), max(0, len(keys) - 1))
        hit = keys[at] == g if len(keys) else np.zeros(len(g), bool)
        out[hit] = bits[at[hit]]
        if not hit.all():
            left = g[~hit]
            shorter = self._at(left & np.uint32((1 << 8 * order) - 1), order - 1)
            if len(contexts):
                c = np.minimum(np.searchsorted(contexts, left >> np.uint32(8)), len(contexts) - 1)
                shorter += np.where((contexts[c] == left >> np.uint32(8))[:, None], escape[c], 0.0)
            out[~hit] = shorter
        return out

    def code_lengths(self, text: bytes) -> np.ndarray:
        """Exact code length of a whole text in each language."""
        total = np.zeros(len(self.langs))
        for a in range(0, len(text), BLOCK):
            g = grams(text[max(0, a - ORDER) : a + BLOCK])
            g = np.sort(g if a == 0 else g[min(a, ORDER) :])
            first = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
            total += np.diff(np.concatenate([first, [len(g)]])) @ self._at(g[first], ORDER)
        return total

    def predict(self, text: bytes) -> tuple[str, float]:
        """A language and its posterior probability; und (0.0) for texts without a letter."""
        if not self.langs or not has_letter(text.decode("utf-8", "ignore")):
            return "und", 0.0
        nats = self.code_lengths(text)
        best = int(np.argmin(nats))
        return self.langs[best], float(1.0 / np.exp(np.minimum(0.0, nats[best] - nats)).sum())


_COUNT = pa.schema([("lang", pa.string()), ("g", pa.int64()), ("n", pa.int64())])


def learn(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> ByteTrees:
    """Counts grams of a bounded sample of labelled rows (whole texts), on the executors.

    What comes to the driver is a count for each language and distinct gram of the sample.
    """
    bounded_batches(session(docs))
    known = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang is not null and doc_id is not null")
    known = known.where(crc_mod4("doc_id") != 2)
    rows = bounded_sample(known, "lang", "doc_id", sample_rows).select("lang", binary("text"))

    def run(batches):
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                g, n = np.unique(grams(text), return_counts=True)
                yield table({"lang": [lang] * len(g), "g": g.astype(np.int64), "n": n}, _COUNT)

    got = rows.mapInArrow(run, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n")).toArrow()
    langs = np.array(got["lang"].to_pylist(), object)
    g, n = got["g"].to_numpy().astype(np.uint32), got["n"].to_numpy()
    order = np.argsort(g, kind="stable")
    langs, g, n = langs[order], g[order], n[order]
    return ByteTrees({x: (g[langs == x], n[langs == x]) for x in sorted(set(langs.tolist()))})


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def identify(docs: DataFrame, trees: ByteTrees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score for every document, from its text alone. Null text: und."""
    spark = session(docs)
    bounded_batches(spark)
    # Bounded by the sample that the trees were learned from.
    sent = spark.sparkContext.broadcast(trees)

    def run(batches):
        model = sent.value
        for b in batches:
            pairs = [model.predict(t) for t in b.column(1).to_pylist()]
            yield table({"doc_id": b.column(0), "lang_pred": [p[0] for p in pairs], "score": [p[1] for p in pairs]}, _OUT)

    return docs.select(F.col(id_col).cast("long"), binary(text_col)).mapInArrow(run, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Rows that are held out, or of a null id, are never learned from."""
    out = identify(docs, learn(docs, sample_rows))
    return out.select("doc_id", (crc_mod4("doc_id") == 2).alias("held_out"), "lang_pred", "score")


__all__ = ["ByteTrees", "identify", "language_report", "learn"]
