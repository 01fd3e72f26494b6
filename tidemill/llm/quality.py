"""Quality classifier: a byte-level convolutional network in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import binary, bounded_batches, bounded_sample, crc_mod4, filtered, session, table

#: A filter sees WIDTH bytes and moves on by STRIDE; a chunk is 2 * HALF filter places, and chunks overlap by half.
WIDTH, STRIDE, HALF = 12, 4, 16
CHUNK = 2 * HALF * STRIDE
EMBED, FILTERS, HIDDEN = 4, 32, 24
#: Learned from this many labelled rows of each label at most, those with the least hash of the id.
SAMPLE_ROWS = 600
#: Labelled texts longer than this aren't learned from (they are scored whole), so what the driver holds is bounded.
SAMPLE_BYTES = 1 << 16
EPOCHS, RATE, SEED = 10, 4e-3, 7
#: Filter places taken at once, so that memory does not follow a text's length.
BLOCK_CHUNKS = 4096
THRESHOLD = 0.7


def windows(text: bytes) -> np.ndarray:
    """The bytes seen by each filter place, padded with zero bytes to whole half chunks, two at least."""
    halves = max(2, -(-len(text) // (HALF * STRIDE)))
    x = np.zeros(halves * HALF * STRIDE + WIDTH - STRIDE, np.uint8)
    x[: len(text)] = np.frombuffer(text, np.uint8)
    return x


class ByteConvNet:
    """Embedding, filters with ReLU, mean and maximum over each chunk, a hidden layer, then the maximum
    and mean over all chunks of the document and a logistic unit."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        n = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {
            "E": r.standard_normal((256, EMBED)).astype(np.float32) * 0.5,
            "W": n(WIDTH * EMBED, FILTERS),
            "b": np.zeros(FILTERS, np.float32),
            "V": n(2 * FILTERS, HIDDEN),
            "c": np.zeros(HIDDEN, np.float32),
            "u": n(2 * HIDDEN, 1)[:, 0],
            "d": np.zeros(1, np.float32),
        }

    def _places(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.p["E"][x]
        n = (len(x) - WIDTH) // STRIDE + 1
        cols = np.lib.stride_tricks.sliding_window_view(e.reshape(-1), WIDTH * EMBED)[:: STRIDE * EMBED][:n]
        return cols, np.maximum(cols @ self.p["W"] + self.p["b"], 0)

    def _chunks(self, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        halves = a.reshape(-1, HALF, FILTERS)
        s, m = halves.sum(axis=1), halves.max(axis=1)
        return (s[:-1] + s[1:]) / (2 * HALF), np.maximum(m[:-1], m[1:]), halves

    def _hidden(self, x: np.ndarray) -> np.ndarray:
        mean, top, _ = self._chunks(self._places(x)[1])
        return np.maximum(np.hstack([mean, top]) @ self.p["V"] + self.p["c"], 0)

    def probability(self, text: bytes) -> float:
        """Of a whole text, in blocks of chunks; the empty text is one chunk of padding."""
        x, step = windows(text), HALF * STRIDE
        halves = (len(x) - (WIDTH - STRIDE)) // step
        top, total, count = np.zeros(HIDDEN, np.float32), np.zeros(HIDDEN), halves - 1
        for a in range(0, count, BLOCK_CHUNKS):
            b = min(a + BLOCK_CHUNKS, count)
            h = self._hidden(x[a * step : (b + 1) * step + WIDTH - STRIDE])
            top, total = np.maximum(top, h.max(axis=0)), total + h.sum(axis=0)
        z = float(np.concatenate([top, total / count]) @ self.p["u"] + self.p["d"][0])
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def gradient(self, text: bytes, label: int, weight: float) -> dict[str, np.ndarray]:
        p, x = self.p, windows(text)
        cols, a = self._places(x)
        mean, top, halves = self._chunks(a)
        f = np.hstack([mean, top])
        h = np.maximum(f @ p["V"] + p["c"], 0)
        at = h.argmax(axis=0)
        g = np.concatenate([h[at, np.arange(HIDDEN)], h.mean(axis=0)])
        prob = 1 / (1 + np.exp(-np.clip(g @ p["u"] + p["d"][0], -30, 30)))
        dz = np.float32((prob - label) * weight)
        dg = dz * p["u"]
        dh = np.repeat((dg[HIDDEN:] / len(h))[None, :], len(h), axis=0)
        dh[at, np.arange(HIDDEN)] += dg[:HIDDEN]
        dh *= h > 0
        df = dh @ p["V"].T
        dmean, dtop = df[:, :FILTERS] / (2 * HALF), df[:, FILTERS:]
        da = np.zeros_like(halves)
        da[:-1] += dmean[:, None, :]
        da[1:] += dmean[:, None, :]
        place = halves.argmax(axis=1)
        m = halves.max(axis=1)
        left = m[:-1] >= m[1:]
        k, j = np.meshgrid(np.arange(len(m)), np.arange(FILTERS), indexing="ij")
        dm = np.zeros_like(m)
        dm[:-1] += dtop * left
        dm[1:] += dtop * ~left
        da[k, place, j] += dm
        da = da.reshape(-1, FILTERS) * (a > 0)
        dcols = (da @ p["W"].T).reshape(-1, WIDTH, EMBED)
        dE = np.zeros_like(p["E"])
        for t in range(WIDTH):
            seen = x[t : t + (len(dcols) - 1) * STRIDE + 1 : STRIDE]
            for e in range(EMBED):
                dE[:, e] += np.bincount(seen, dcols[:, t, e], 256)
        return {"E": dE, "W": cols.T @ da, "b": da.sum(axis=0), "V": f.T @ dh, "c": dh.sum(axis=0), "u": dz * g, "d": np.array([dz])}

    def fit(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, rate: float = RATE, batch: int = 16, seed: int = SEED) -> ByteConvNet:
        """Adam over whole documents, both labels weighing alike. The same sample gives the same network."""
        if not texts:
            return self
        r, y = np.random.default_rng(seed), np.array(labels)
        share = np.array([max(1, (y == k).sum()) for k in (0, 1)])
        weight = len(y) / (2 * share)[y]
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(w) for k, w in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(texts))
            for a in range(0, len(order), batch):
                part = order[a : a + batch]
                total: dict[str, np.ndarray] = {}
                for i in part.tolist():
                    for k, g in self.gradient(texts[i], int(y[i]), float(weight[i]) / len(part)).items():
                        total[k] = total[k] + g if k in total else g
                step += 1
                now = rate * (1 - epoch / epochs)
                for k, g in total.items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.99 * v[k] + 0.01 * g * g
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
        return self


def learn(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteConvNet:
    """Fits the network to a bounded sample of labelled rows that aren't held out, whole texts.

    Of each label sample_rows ids at most, and of these the texts of up to SAMPLE_BYTES bytes. Rows that repeat
    an id are all learned from, up to as many rows again.
    """
    spark = session(docs)
    bounded_batches(spark)
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    known = known.where(crc_mod4("doc_id") != 2)
    chosen = bounded_sample(known, "y", "doc_id", sample_rows).select("doc_id", "y")
    # Both the sample's ids and its texts are bounded by sample_rows of each label.
    wanted = spark.createDataFrame([tuple(r) for r in chosen.collect()], "doc_id long, y int")
    texts = docs.select(F.col(id_col).alias("doc_id"), binary(text_col).alias("text")).where(crc_mod4("doc_id") != 2)
    found = texts.where(F.octet_length("text") <= SAMPLE_BYTES).join(F.broadcast(wanted), "doc_id").select("doc_id", "y", "text")
    # Where ids repeat there may be more rows: the same ones are taken, however the table is dealt out.
    rows = sorted(tuple(r) for r in found.orderBy(F.xxhash64("doc_id", "text"), "doc_id", "text").limit(4 * sample_rows).collect())
    return ByteConvNet().fit([bytes(r[2]) for r in rows], [r[1] for r in rows])


_OUT = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def score(docs: DataFrame, net: ByteConvNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the probability of label 1 for every document, from its text alone. Null text: empty."""
    spark = session(docs)
    bounded_batches(spark)
    # A network of fixed size, some kilobytes.
    sent = spark.sparkContext.broadcast(net)

    def run(batches):
        model = sent.value
        for b in batches:
            yield table({"doc_id": b.column(0), "score": [model.probability(t) for t in b.column(1).to_pylist()]}, _OUT)

    return docs.select(F.col(id_col).cast("long"), binary(text_col)).mapInArrow(run, "doc_id long, score double")


def quality_report(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from THRESHOLD on). Without any label every score is near a half."""
    out = score(docs, learn(docs, labels, sample_rows))
    return out.select("doc_id", (crc_mod4("doc_id") == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents whose score is at least the given one, each row judged by its own text; all columns stay.

    Null text: empty. Rows that repeat an id, or have none, are judged like any other. Empty tables give no rows.
    """
    sent = session(docs).sparkContext.broadcast(learn(docs, labels, sample_rows))
    return filtered(docs, "text", lambda texts: [sent.value.probability(t) >= least for t in texts])
