"""Mixing, collocations and centroids against brute force and SQL, and on odd tables."""

import math
import random
import re
import struct
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemill.llm import centroids, collocations, mixing
from tidemill.llm.queries import llm_queries

CLASHES = ("size", "target", "n", "p", "base", "draw", "part", "node", "nodes", "row", "times", "copy", "copies", "taken", "s", "place", "weight", "v", "cluster", "upper", "f", "w", "phrase", "rank", "c", "at", "source_size")


# --- mixing ------------------------------------------------------------------------------------------


def spark_hash(*values):
    """Spark's xxhash64 of ints of 4 bytes (given as a tuple), longs and bytes; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            data = v if isinstance(v, bytes) else struct.pack("<i", v[0]) if isinstance(v, tuple) else struct.pack("<q", v)
            h = xxhash.xxh64_intdigest(data, h)
    return h - (1 << 64) if h >> 63 else h


def plain_targets(sizes):
    """Reshares round by round, as the rule is stated."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    target, held = {}, set()
    while True:
        rest = Fraction(3, 2) * sum(sizes.values()) - sum(2 * sizes[s] for s in held)
        open_ = [s for s in names if s not in held]
        target = {s: Fraction(2 * sizes[s]) if s in held else rest * weight[s] / sum(weight[x] for x in open_) for s in names}
        over = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not over:
            return target
        held |= over


def plain_rounding(units, salt):
    """Sequential pivots over (size, draw, doc_id, part, p), largest first: what is done, and the residual."""
    rest, done = None, []
    for x in sorted(units, key=lambda u: (u[0], u[1], (u[2] is not None, u[2] or 0), u[3], u[4]), reverse=True):
        if rest is None:
            rest = x
            continue
        a, b = rest, x
        up_a, down_a, up_b, down_b = (1 - a[4]) * a[0], a[4] * a[0], (1 - b[4]) * b[0], b[4] * b[0]
        up, down = min(up_a, down_b), min(down_a, up_b)
        u = (spark_hash(a[1], a[3], b[1], b[3], (salt,)) & ((1 << 53) - 1)) / float(1 << 53)
        clip = lambda p: max(0.0, min(1.0, p))
        if u * (up + down) < down:
            rest, out = ((*b[:4], clip(b[4] - up / b[0])), (*a[:4], 1.0)) if up_a <= down_b else ((*a[:4], clip(a[4] + up / a[0])), (*b[:4], 0.0))
        else:
            rest, out = ((*b[:4], clip(b[4] + down / b[0])), (*a[:4], 0.0)) if down_a <= up_b else ((*a[:4], clip(a[4] - down / a[0])), (*b[:4], 1.0))
        done.append(out)
    return done, rest


def plain_mix(rows, fan, salt=mixing.SALT):
    """Sorted (doc_id, source, size, target, taken)."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    total = {s: sum(z for z, r in zip(size, rows, strict=True) if r[2] == s) for s in {r[2] for r in rows}}
    target, out = plain_targets(total), []
    for s in total:
        own, seen, level = [(z, r) for z, r in zip(size, rows, strict=True) if r[2] == s], {}, {}
        t = float(target[s])
        rate = min(2.0, t / total[s]) if total[s] else 0.0
        base, p = math.floor(rate), rate - math.floor(rate)
        nodes = 1 if len(own) <= fan else -(-len(own) // min(fan, math.ceil(math.sqrt(len(own)))))
        for z, (i, text, _) in own:
            draw = spark_hash(i, (text or "").encode(), (salt,))
            part = seen[i, draw] = seen.get((i, draw), 0) + 1
            if z and p > 0:
                level.setdefault(spark_hash(draw, part, (salt + 1,)) % nodes, []).append((z, draw, i, part, p))
            else:
                out.append((i, s, z, t, base * z))
        while level:
            up = {}
            for k, units in level.items():
                if nodes > 1:
                    done, rest = plain_rounding(units, salt + 2)
                    up.setdefault(k // fan, []).append(rest)
                else:
                    tries = [(abs(math.floor(r[4] + 0.5) - r[4]) * r[0], j, d, r) for j in range(mixing.TRIES) for d, r in [plain_rounding(units, salt + 2 + j)]]
                    _, _, done, rest = min(tries, key=lambda x: x[:2])
                    done = [*done, (*rest[:4], math.floor(rest[4] + 0.5))]
                out += [(u[2], s, u[0], t, int(base + u[4]) * u[0]) for u in done]
            level, nodes = up, -(-nodes // fan)
    return sorted(out, key=repr)


def mix_rows(df, **options):
    return sorted((tuple(r) for r in mixing.mix_plan(df, **options).select("doc_id", "source", "size", "target", "taken").collect()), key=repr)


@pytest.mark.parametrize("fan", [mixing.FAN, 3])
def test_mix_equals_brute_force(spark, fan):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.select("doc_id", "text", "source").collect()]
    assert mix_rows(docs, fan=fan) == plain_mix(rows, fan)


def test_mix_by_few_sources_is_near_its_targets(spark):
    r = random.Random(3)
    rows = [(k, " ".join(["w"] * int(r.paretovariate(0.9) * 5 % 5000)), "hot" if k % 3 else f"s{k % 4}") for k in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_plan(df).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.max(F.col("taken") - 2 * F.col("size")).alias("over"), F.count("*").alias("n")).collect()
    assert sum(x["n"] for x in got) == 4000 and all(x["over"] <= 0 for x in got)
    assert all(abs(x["taken"] - x["target"]) <= min(x["most"] / 2, 0.01 * x["target"]) + 1e-6 for x in got)
    assert mix_rows(df) == mix_rows(df.repartition(7)) == plain_mix(rows, mixing.FAN)


ODD = [(1, "a b c", "x"), (1, "a b c", "x"), (None, "a b c", "x"), (None, "a b c", "x"), (2, None, "x"), (3, "", "y"), (4, " \n ", None), (5, "one two three four", None), (6, "d " * 3000, "é"), (7, "e f", "z"), (7, "g h i", "z")]


def test_mix_odd_rows(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns({n: F.lit(1) for n in CLASHES})
    assert mix_rows(df) == plain_mix(ODD, mixing.FAN)
    assert mix_rows(df.limit(0)) == []
    nothing = spark.createDataFrame([(1, None, None), (2, " ", "a")], "doc_id long, text string, source string")
    assert [(r[3], r[4]) for r in mix_rows(nothing)] == [(0.0, 0), (0.0, 0)]
    text = spark.createDataFrame([(f"k{i}", t, s) for i, t, s in ODD], "doc_id string, text string, source string")
    assert sum(r[2] for r in mix_rows(text)) == sum(r[2] for r in mix_rows(df))


def test_mixed_has_the_documents_of_the_plan(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string").withColumns({n: F.lit(k) for k, n in enumerate(CLASHES)})
    out = mixing.mixed(df)
    assert out.columns == df.columns
    key = lambda rows: sorted(((r["doc_id"], r["text"], r["source"]) for r in rows), key=repr)
    text = {(i, s, len((t or "").split())): t for i, t, s in ODD}
    want = [(i, text[i, s, z], s) for i, s, z, c in mixing.mix_plan(df).select("doc_id", "source", "size", "copies").collect() for _ in range(c)]
    assert key(out.collect()) == sorted(want, key=repr)
    assert mixing.mixed(df.limit(0)).count() == 0


def test_targets_need_no_plan_in_python(spark):
    plan = llm_queries()["op11_mix"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


@pytest.mark.parametrize("seed", range(4))
def test_targets_follow_the_rule(spark, seed):
    r = random.Random(seed)
    sizes = {f"s{k:03}": r.choice([0, 1, 3, 10, 1000, 10**6]) for k in range(r.randint(1, 60))} | ({None: 7} if seed % 2 else {})
    per = spark.createDataFrame([(s, z, 1) for s, z in sizes.items()], "source string, size long, n long")
    got = {x["source"]: x["target"] for x in mixing.source_targets(per).collect()}
    assert got == pytest.approx({s: float(t) for s, t in plain_targets(sizes).items()})


# --- collocations ------------------------------------------------------------------------------------


def phrases(docs, rows, **options):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    got = sorted(tuple(r) for r in collocations.collocations(docs, **options).collect())
    options |= {"top": options.get("top", collocations.TOP)}
    return got, sorted(con.execute(collocations.collocations_sql(**options)).fetchall())


@pytest.mark.parametrize("options", [{}, {"least": 4, "top": 20000}, {"least": 4, "top": 30, "share": 60}])
def test_collocations_equal_sql(spark, options):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got, want = phrases(docs, [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()], **options)
    assert got == want and (len(got) > 20 or not options)


def test_collocations_odd_rows(spark):
    r = random.Random(1)
    word = lambda: r.choice(["der", "Hund", "x\x00y", "\x1cz", "日本語", "ÄB", "a b", "i"])
    text = lambda n: "".join(word() + r.choice([" ", "  ", "\t", "\r\n", ". ", ",", ":", "\x0b", " "]) for _ in range(n))
    rows = [(k, text(300), r.choice(["de", "en", None, "und"])) for k in range(20)] + [(None, None, "en"), (1, "", None), (1, " \t ", "de"), (2, "., .", "xx")]
    rows += [(3, "b c " * 20000, "long"), (4, ", ".join(["k l m"] * 30000), "long"), (5, "same same. same same", "de")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({n: F.lit(1) for n in (*CLASHES, "size", "l", "r", "a")})
    for least in (3, 300):  # beyond 255 a cell is full before it has so many
        got, want = phrases(df, rows, least=least, top=5000)
        assert got == want and got
    assert collocations.collocations(df.limit(0)).count() == 0


def test_sketches_never_underestimate(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MERGED", 0.01)  # so that merges take two steps
    r = random.Random(2)
    rows = [("a", " ".join(f"w{int(r.paretovariate(0.7)) % 5000}" for _ in range(3000)).encode()) for _ in range(40)]
    df = spark.createDataFrame(rows, "lang string, text binary").repartition(5)
    width, bits = collocations.frequent_cells(df, sum(len(t) for _, t in rows), 20)
    ids, words = collocations._word_ids([t for _, t in rows])
    for _, begins, h in collocations._hashes(ids, words, "a"):
        kinds, n = np.unique(h[begins], return_counts=True)
        hit = np.logical_and.reduce([np.unpackbits(b, bitorder="little")[collocations._cell(kinds, row, width)] > 0 for row, b in enumerate(bits)])
        assert hit[n >= 20].all() and not hit[n < 20].all()


def test_long_texts_are_cut_where_pieces_end(monkeypatch):
    monkeypatch.setattr(collocations, "SEGMENT", 50)
    text = b"one two three, four five. " * 20 + b"x" * 300 + b" end\nlast"
    parts = list(collocations._slices(text))
    pieces = lambda t: [p.split() for p in re.split(rb"[.,;:!?\x0a-\x0d]", t) if p.split()]
    assert len(parts) > 5 and [p for t in parts for p in pieces(t)] == pieces(text)
    cells = np.array([0, 1, 254, 255, 600, 100000, 100001])
    assert [x.tolist() for x in collocations._unpack(*collocations._pack(cells, np.array([1, 2, 255, 256, 7, 1, 9999])))] == [cells.tolist(), [1, 2, 255, 255, 7, 1, 255]]


# --- centroids ---------------------------------------------------------------------------------------


@pytest.mark.parametrize("seed,spread", [(0, 3), (1, 40), (2, 1 << 25), (3, 1)])
def test_exponion_finds_the_nearest_in_every_round(seed, spread):
    r = np.random.default_rng(seed)
    v = r.integers(-spread, spread + 1, (3000, 6)) + r.integers(-2, 3, (3000, 1)) * spread
    v = np.clip(v, -centroids.LARGEST + 1, centroids.LARGEST - 1)
    at, before = v[:25].copy(), None
    at[7] = at[3]  # equal centroids: ties all the way
    cluster, upper, lower, looked = np.full(len(v), -1), np.zeros(len(v)), np.zeros(len(v)), []
    for _ in range(8):
        cluster, upper, lower, seen = centroids.assign(v, cluster, upper, lower, centroids.Centres.of(at, before))
        d = np.array([[int(((x.astype(object) - c.astype(object)) ** 2).sum()) for c in at] for x in v[:300]])
        assert (cluster[:300] == d.argmin(axis=1)).all()
        full = centroids._distances(v, at)
        assert (full[:300] == d).all() and (cluster == full.argmin(axis=1)).all()
        own = np.sqrt(full[np.arange(len(v)), cluster].astype(float))
        full[np.arange(len(v)), cluster] = np.iinfo(np.int64).max
        assert (upper >= own).all() and (lower <= np.sqrt(full.min(axis=1).astype(float))).all()
        looked.append(seen)
        before, at = at, np.array([v[cluster == k].sum(axis=0) // (cluster == k).sum() if (cluster == k).any() else at[k] for k in range(len(at))])
    assert looked[0] == v.shape[0] * 25 and looked[-1] < looked[0]


def vectors(spark, rows, **options):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, 1)", rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({n: F.lit(1) for n in CLASHES})
    got = sorted((tuple(r) for r in centroids.cluster_report(df, **options).collect()), key=repr)
    return got, sorted(con.execute(centroids.cluster_sql(**options)).fetchall(), key=repr)


def test_clusters_equal_sql_on_odd_rows(spark):
    r = random.Random(5)
    one = lambda: [r.choice([-1.5, -0.25, 0.0, 0.1, 0.7, 2.0]) for _ in range(4)]
    rows = [(k, one()) for k in range(200)] + [(200 + k, [0.5, 0.5, 0.5, 0.5]) for k in range(100)]  # one frequent vector
    odd = [(400, None), (401, []), (402, [1.0] * 3), (403, [1.0, None, 1.0, 1.0]), (404, [1.0, float("nan"), 1.0, 1.0]), (405, [float("inf"), 1.0, 1.0, 1.0]), (406, [1.0] * 5)]
    for k, rounds in ((9, 5), (1, 2), (40, 3)):
        got, want = vectors(spark, rows + odd, k=k, rounds=rounds, dim=4)
        assert got == want and len(got) == 300
    got, want = vectors(spark, rows[:3] + odd, k=9, dim=4)  # fewer vectors than centroids
    assert got == want and {x[2] for x in got} == {0}
    got, _ = vectors(spark, [*rows[:50], rows[3], (None, one()), (None, one()), (60, [1e30, 0.0, 0.0, 0.0])], k=5, dim=4)
    assert len(got) == 53 and sum(x[0] is None for x in got) == 2  # repeated and null ids stay, what has no exact distance goes
    assert centroids.cluster_report(spark.createDataFrame(odd, "vec_id long, embedding array<float>"), dim=4).count() == 0


def test_clusters_are_the_same_however_the_table_is_dealt_out(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet")
    one, two = (sorted(map(tuple, centroids.cluster_report(d).collect())) for d in (rows, rows.repartition(7)))
    assert one == two and len(one) == 500
