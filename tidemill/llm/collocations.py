"""Collocations: merged count-min sketches of n-grams, then exact counts of what passes them, scores and subsumption."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.llm.common import KEY_BYTES, ROW_BYTES, binary, bounded_batches, cut, restrict, session, table

#: Words of the longest phrase, the least count of a candidate, and the share of its count, in percent, at which a longer one subsumes it.
WORDS, LEAST, SUBSUMED = 5, 100, 100
#: Phrases reported for each language.
TOP = 2000
#: Rows of the sketch, bytes of text for each of its cells, and the bounds of its width; a row of the widest is 16 MB of bits.
ROWS, BYTES_A_CELL, NARROW, WIDE = 2, 16, 1 << 16, 1 << 27
#: Cells of a block, the unit in which sketches are merged; counts stop at a byte, which is over LEAST.
BLOCK, FULL = 1 << 20, 255
#: Bytes of text that a worker takes together, and sketches of that much text that one merge takes.
SEGMENT, MERGED = 8 << 20, 4096
#: Text that a task of the exact count has at least, if there is enough for two rounds of tasks, and phrases that it holds.
#: The more of both, the fewer rows it sends on for each phrase.
TASK, HELD = 256 << 20, 500_000
#: Parts in which the best phrases of a language are found before they are ranked together.
PARTS = 32
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_TABLE = bytes(10 if b in _ENDS else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(29), np.uint64(32))

_CELLS = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("part", pa.int64()), ("gaps", pa.binary()), ("counts", pa.binary())])
_CELLS_DDL = "row int, block int, part long, gaps binary, counts binary"
_COUNTS = pa.schema([("lang", pa.string()), ("phrase", pa.binary()), ("size", pa.int32()), ("f", pa.int64())])


# --- words and n-grams of a segment -------------------------------------------------------------------


def _slices(text: bytes) -> Iterator[bytes]:
    """A long text in parts, cut where a piece ends, so that no phrase is lost."""
    at = 0
    while len(text) - at > SEGMENT and (end := _END.search(text, at + SEGMENT)):
        yield text[at : end.start()]
        at = end.end()
    yield text[at:] if at else text


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, list[bytes]]]:
    """Texts by language, some SEGMENT bytes together."""
    held, size = {}, 0
    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for part in _slices(text):
                held.setdefault(lang, []).append(part)
                size += len(part) + 64
                if size >= SEGMENT:
                    yield held
                    held, size = {}, 0
    if held:
        yield held


class _Vocabulary(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        return k


def _word_ids(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Word numbers in order, 1 where a piece ends; the words by number. 0 is nobody's."""
    known = _Vocabulary({b"": 0, b"\n": 1})
    tokens = b"\n".join(texts).translate(_TABLE).replace(b"\n", b" \n ").split(b" ")
    ids = np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))
    return ids[ids > 0], list(known)


def _hashes(ids: np.ndarray, words: list[bytes], lang: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each size: whether an n-gram begins at a place, and its hash with the language's."""
    of_word = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))[ids]
    a, b, s, t = _MIX

    def mix(x: np.ndarray) -> np.ndarray:
        x = x * a
        x ^= x >> s
        x *= b
        return x ^ (x >> t)

    real = ids > 1
    begins, h = real, mix(of_word ^ np.uint64(xxhash.xxh64_intdigest(lang.encode(), 1)))
    for n in range(1, WORDS + 1):
        if n > 1:
            begins = begins[:-1] & real[n - 1 :]
            h = mix(h[:-1] + mix(of_word[n - 1 :] + np.uint64(n)))
        if not len(begins):
            return
        yield n, begins, h


def _cell(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return ((h >> np.uint64(32 * row)) & np.uint64(width - 1)).astype(np.uint32)


# --- the sketch ---------------------------------------------------------------------------------------


def _pack(cells: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending cells as gaps of a byte, 255 meaning 255 and no cell; counts less one."""
    gaps = np.diff(cells.astype(np.int64), prepend=0)
    out = np.full(int((gaps // 255).sum()) + len(gaps), 255, np.uint8)
    out[np.cumsum(gaps // 255 + 1) - 1] = gaps % 255
    return out.tobytes(), (np.minimum(counts, FULL) - 1).astype(np.uint8).tobytes()


def _unpack(gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    g = np.frombuffer(gaps, np.uint8)
    return np.cumsum(g, dtype=np.int64)[g != 255], np.frombuffer(counts, np.uint8).astype(np.uint16) + 1


def _sketches(width: int):
    block = min(width, BLOCK)

    def run(batches):
        for part, held in enumerate(_segments(batches)):
            found = [[] for _ in range(ROWS)]
            for lang, texts in held.items():
                for _, begins, h in _hashes(*_word_ids(texts), lang):
                    h = h[begins]
                    for row in range(ROWS):
                        found[row].append(_cell(h, row, width))
            for row in range(ROWS):
                cells = np.sort(np.concatenate(found[row])) if found[row] else np.empty(0, np.uint32)
                if not len(cells):
                    continue
                at = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
                cells, counts = cells[at], np.diff(np.r_[at, len(cells)])
                ends = np.searchsorted(cells, np.arange(0, width + 1, block, dtype=np.int64))
                out = {k: [] for k in _CELLS.names}
                for k, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if j > i:
                        gaps, n = _pack(cells[i:j] - np.uint32(k * block), counts[i:j])
                        for name, v in zip(_CELLS.names, (row, k, part, gaps, n), strict=True):
                            out[name].append(v)
                yield table(out, _CELLS)

    return run


def _merge(cells: DataFrame, width: int, keys: list[str], least: int | None = None) -> DataFrame:
    """Sums of the sketches with the same keys, block by block: each task streams sorted rows over one dense block.

    With least, the sums end as a bit for each cell: whether it counts so many.
    """
    block, ends = min(width, BLOCK), least is not None
    schema = pa.schema([("row", pa.int32()), ("block", pa.int32()), ("bits", pa.binary())]) if ends else _CELLS

    def put(key, dense):
        if ends:
            return table({"row": [key[0]], "block": [key[1]], "bits": [np.packbits(dense >= min(least, FULL), bitorder="little").tobytes()]}, schema)
        at = np.flatnonzero(dense)
        gaps, counts = _pack(at, dense[at])
        return table({"row": [key[0]], "block": [key[1]], "part": [key[2]], "gaps": [gaps], "counts": [counts]}, schema)

    def run(batches):
        now, dense = None, np.zeros(block, np.uint16)
        for b in batches:
            for r in b.to_pylist():
                key = tuple(r[k] for k in keys)
                if key != now:
                    if now is not None:
                        yield put(now, dense)
                    now, dense = key, np.zeros(block, np.uint16)
                at, n = _unpack(r["gaps"], r["counts"])
                dense[at] = np.minimum(dense[at] + n, FULL)
        if now is not None:
            yield put(now, dense)

    return cells.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "row int, block int, bits binary" if ends else _CELLS_DDL)


def frequent_cells(docs: DataFrame, total: int, least: int = LEAST) -> tuple[int, list[np.ndarray]]:
    """The width of the sketch and, for each of its rows, a bit for each cell: whether it counts least n-grams or more.

    docs: lang, text (binary); total: bytes of all texts. Each worker sketches its own text, as sorted cells with their
    counts; sketches are summed block by block, those of many segments in two steps. A sum can't be less than the
    count of any n-gram in the cell. The driver receives the bits alone, at most ROWS * WIDE / 8 bytes.
    """
    width = NARROW
    while width < WIDE and width * BYTES_A_CELL < total:
        width *= 2
    cells = docs.mapInArrow(_sketches(width), _CELLS_DDL)
    parts = -(-total // (SEGMENT * MERGED))
    if parts > 1:
        cells = _merge(cells.withColumn("part", F.pmod(F.xxhash64("gaps"), F.lit(parts))), width, ["row", "block", "part"])
    bits = [np.zeros(width // 8, np.uint8) for _ in range(ROWS)]
    size = min(width, BLOCK) // 8
    for row, block, found in _merge(cells, width, ["row", "block"], least).collect():
        bits[row][block * size : block * size + size] = np.frombuffer(found, np.uint8)
    return width, bits


# --- exact counts -------------------------------------------------------------------------------------


def _counts(width: int, shared):
    def frequent(h: np.ndarray) -> np.ndarray:
        ok = np.ones(len(h), bool)
        for row, bits in enumerate(shared.value):
            cell = _cell(h, row, width)
            ok &= (bits[cell >> np.uint32(3)] >> (cell & np.uint32(7)).astype(np.uint8) & 1).astype(bool)
        return ok

    def flush(counts: dict[tuple[str, bytes], int]):
        rows = list(counts.items())
        for k in range(0, len(rows), 1 << 16):
            part = rows[k : k + (1 << 16)]
            sizes = [p.count(b" ") + 1 if p else 0 for (_, p), _ in part]
            yield table({"lang": [x for (x, _), _ in part], "phrase": [p for (_, p), _ in part], "size": sizes, "f": [f for _, f in part]}, _COUNTS)
        counts.clear()

    def run(batches):
        counts: dict[tuple[str, bytes], int] = {}
        for held in _segments(batches):
            for lang, texts in held.items():
                ids, words = _word_ids(texts)
                counts[lang, b""] = counts.get((lang, b""), 0) + int((ids > 1).sum())
                alive = number = None
                phrases: list[bytes] = words
                for n, begins, h in _hashes(ids, words, lang):
                    if n > 1:  # both shorter parts may be frequent
                        begins = begins & alive[:-1] & alive[1:]
                    alive = np.zeros(len(begins), bool)
                    at = np.flatnonzero(begins)
                    at = at[frequent(h[at])]
                    alive[at] = True
                    if not len(at):
                        break
                    # Equal n-grams: equal n-grams of one word less before equal words; no hash decides.
                    pairs = ids[at] if n == 1 else number[at] * len(words) + ids[at + n - 1]
                    kinds, same, f = np.unique(pairs, return_inverse=True, return_counts=True)
                    phrases = [words[k] for k in kinds] if n == 1 else [phrases[k // len(words)] + b" " + words[k % len(words)] for k in kinds.tolist()]
                    number = np.zeros(len(ids), np.int64)
                    number[at] = same
                    for p, k in zip(phrases, f.tolist(), strict=True):
                        counts[lang, p] = counts.get((lang, p), 0) + k
            if len(counts) >= HELD:
                yield from flush(counts)
        yield from flush(counts)

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST) -> DataFrame:
    """lang, phrase, size, f: every phrase of 1 to WORDS words that occurs least times or more in a language, with its exact count.

    Two passes. The first merges sketches; the second counts, exactly and by their words, the n-grams whose cells
    and whose shorter parts may be frequent. A sketch overestimates only, so nothing frequent is lost; what passes
    it wrongly is counted, and goes. The row of size 0 and phrase "" has the number of words of the language.
    """
    spark = session(docs)
    bounded_batches(spark)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), binary(text_col).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    width, bits = frequent_cells(rows, total, least)
    shared = spark.sparkContext.broadcast(bits)
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-total // TASK))
    found = rows.coalesce(tasks).mapInArrow(_counts(width, shared), "lang string, phrase binary, size int, f long")
    counted = found.groupBy("lang", F.col("phrase").cast("string").alias("phrase"), "size").agg(F.sum("f").alias("f"))
    return cut(counted.where((F.col("f") >= least) | (F.col("size") == 0)))


# --- scores -------------------------------------------------------------------------------------------


def _part(first: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice("w", first, n), " ")


def _with(rows: DataFrame, keyed: DataFrame, on: list[str], small: bool, how: str = "inner") -> DataFrame:
    return rows.join(F.broadcast(keyed) if small else keyed, on, how)


def scored_phrases(counts: DataFrame) -> DataFrame:
    """lang, phrase, size, a, l, r, n, score of each candidate: the cut with the lowest score, then the earliest.

    counts: as phrase_counts returns them. The parts of a candidate occur as often as it does at least, so they are there.
    """
    small = counts.count() * ROW_BYTES <= KEY_BYTES
    totals = counts.where("size = 0").select("lang", F.col("f").alias("n"))
    cand = counts.where("size > 1").withColumnRenamed("f", "a").withColumn("w", F.split("phrase", " "))
    k = F.explode(F.sequence(F.lit(1), F.col("size") - 1))
    cuts = cand.withColumn("k", k).withColumns({"first": _part(F.lit(1), F.col("k")), "second": _part(F.col("k") + 1, F.col("size") - F.col("k"))}).drop("w")
    cuts = _with(cuts, counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"], small)
    cuts = _with(cuts, counts.select("lang", F.col("phrase").alias("second"), F.col("f").alias("r")), ["lang", "second"], small)
    cuts = _with(cuts, totals, ["lang"], small)
    # Products of 38 digits, divided as integers.
    score = F.expr("CAST(CAST(1000 AS DECIMAL(38, 0)) * a * n div (CAST(l AS DECIMAL(38, 0)) * r) AS BIGINT)")
    best = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("b")
    return cuts.groupBy("lang", "phrase", "size", "a", "n").agg(best).select("lang", "phrase", "size", "a", "b.l", "b.r", "n", "b.score")


def subsumed(counts: DataFrame) -> DataFrame:
    """lang, phrase, longer: each phrase within a longer candidate, with the largest count of such a one."""
    cand = counts.where("size > 2").withColumn("w", F.split("phrase", " "))
    n = cand.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    at = n.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    return at.select("lang", _part(F.col("i"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", top: int = TOP, least: int = LEAST, share: int = SUBSUMED) -> DataFrame:
    """Each language's best phrases: lang, rank (from 1), phrase, a, l, r, n, score.

    Phrases within a longer candidate that occurs share percent as often, or more, are left out. Order: score, count, both
    falling, then the phrase by its bytes. Null text: empty; null language: und; ids aren't read. A language without
    candidates, and an empty table, give no rows. Repeated rows count as often as they are there.
    """
    counts = phrase_counts(docs, text_col, lang_col, least)
    scored = scored_phrases(counts)
    inside = cut(subsumed(counts))
    kept = restrict(scored, inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("a") * share))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part first, so that a task ranks PARTS * top rows of a language at most.
    some = Window.partitionBy("lang", "part").orderBy(*order)
    ahead = kept.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).withColumn("rank", F.row_number().over(some)).where(F.col("rank") <= top)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    out = ahead.drop("rank", "part").withColumn("rank", rank).where(F.col("rank") <= top)
    return out.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", *(F.col(c).cast("long").alias(c) for c in ("a", "l", "r", "n", "score")))


def collocations_sql(top: int = TOP, least: int = LEAST, share: int = SUBSUMED) -> str:
    """The same rows in SQL, over documents."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    grams = " UNION ALL ".join(f"SELECT lang, {n} AS size, array_to_string(w[i : i + {n - 1}], ' ') AS phrase FROM (SELECT lang, w, unnest(range(1, len(w) - {n} + 2)) AS i FROM s WHERE len(w) >= {n})" for n in range(1, WORDS + 1))
    cuts = " UNION ALL ".join(f"SELECT lang, phrase, size, f, w, {k} AS k FROM c WHERE size > {k}" for k in range(1, WORDS))
    inner = " UNION ALL ".join(f"SELECT lang, array_to_string(w[{i} : {i + m - 1}], ' ') AS phrase, f FROM c WHERE size >= {max(i + m - 1, m + 1)}" for m in range(2, WORDS) for i in range(1, WORDS - m + 2))
    return rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    s AS MATERIALIZED (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
    n AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM s GROUP BY lang),
    g AS ({grams}),
    q AS MATERIALIZED (SELECT lang, phrase, size, count(*)::HUGEINT AS f FROM g GROUP BY ALL HAVING count(*) >= {least}),
    c AS (SELECT *, string_split(phrase, ' ') AS w FROM q WHERE size > 1),
    k AS ({cuts}),
    z AS (SELECT k.lang, k.phrase, k.f AS a, k.k, x.f AS l, y.f AS r, n.n, (1000 * k.f * n.n) // (x.f * y.f) AS score FROM k JOIN n ON n.lang = k.lang
      JOIN q x ON x.lang = k.lang AND x.phrase = array_to_string(k.w[1 : k.k], ' ') JOIN q y ON y.lang = k.lang AND y.phrase = array_to_string(k.w[k.k + 1 : k.size], ' ')),
    b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    i AS (SELECT lang, phrase, max(f) AS longer FROM ({inner}) GROUP BY ALL),
    o AS (SELECT b.* FROM b LEFT JOIN i ON i.lang = b.lang AND i.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < {share} * a)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM o
    QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""
