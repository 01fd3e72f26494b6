"""Each operator against a brute-force version, and on nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import functools
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.conftest import SF
from tidemill.llm import components, decontam, exact, language, neardup, packing, pages, pii, quality, repeats, shards, simhash, suffix
from tidemill.llm.common import bounded_sample
from tidemill.llm.queries import llm_oracle_sql, llm_queries
from tidemill.llm.tokens import Encoder, public_path

BASE = "the quick brown fox jumps over a lazy dog while seven wizards quietly box up jars of very old pickled onions near the river bank at dawn every single day".split()
LONG = " ".join(BASE[(i * i + 3 * i) % len(BASE)] + str(i % 97) for i in range(30000))

#: Null, empty, blank, tied and repeated rows, very long texts, other scripts, and columns whose names clash with internal ones.
ODD = [
    (1, "same text here", "en"), (2, "same text here", "en"), (7, "same text here", None), (3, None, "en"), (4, "", "fr"), (5, "   \n\t ", "fr"), (6, "Grüße – 日本語 ñandú", "de"),
    (8, LONG, "en"), (9, LONG + " tail", "en"), (10, "x", "en"), (11, "x" * 5000, None), (12, " ".join(BASE), "en"), (13, " ".join(["Fox"] * 400), "en"), (14, "a\x00b \x1c c", None),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, lang string")
    names = ("fp", "key", "g", "t", "n", "top", "node", "component", "root", "run", "ended", "b", "r", "y", "page", "near", "fold")
    return df.withColumns({n: F.lit(1) for n in names})


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.select("doc_id", "text").collect()}


def classes(pairs, ids):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


# --- op1 ---------------------------------------------------------------------------------------------


def plain_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def check_op1(df, rows):
    fps = {i: plain_fingerprint(t) for i, t in rows.items()}
    ids = sorted(fps)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (fps[a] ^ fps[b]).bit_count() <= 2]
    want = {i: (f"{fps[i]:016x}", c) for i, c in classes(pairs, ids).items()}
    got = [tuple(r) for r in simhash.simhash_components(df).select("doc_id", "fingerprint", "component_id").collect()]
    assert len(got) == len(ids) and {i: (f, c) for i, f, c in got} == want


def test_simhash_equals_brute_force(docs, texts):
    check_op1(docs, texts)


def test_simhash_odd_rows(odd):
    check_op1(odd, {i: t or "" for i, t, _ in ODD})
    assert simhash.simhash_components(odd.limit(0)).count() == 0
    with_null = odd.select("doc_id", "text").unionByName(odd.select(F.lit(None).cast("long").alias("doc_id"), "text").limit(1))
    assert simhash.simhash_components(with_null).where("doc_id is null").first()["component_id"] is not None


@pytest.mark.parametrize("radius", [1, 2])
def test_near_links_join_all_within_radius(spark, radius):
    r = random.Random(5)
    seeds = [r.getrandbits(64) for _ in range(40)]
    fps = {s for s in seeds} | {s ^ sum(1 << b for b in r.sample(range(64), r.randint(1, 3))) for s in seeds for _ in range(12)}
    # One dense group, longer than what is compared in one sweep: flips within a few bits share keys.
    fps |= {seeds[0] ^ sum(1 << b for b in r.sample(range(10), r.randint(1, 4))) for _ in range(200)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    mask = (1 << 64) - 1
    want = classes([(a, b) for k, a in enumerate(signed) for b in signed[k + 1 :] if ((a ^ b) & mask).bit_count() <= radius], signed)
    for most in (simhash.KEY_RUN, 20):  # the second has keys split, more than once
        links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, most).collect()
        assert all(((x["a"] ^ x["b"]) & mask).bit_count() <= radius for x in links)
        assert classes([(x["a"], x["b"]) for x in links], signed) == want


def test_distance_within_a_mask_follows_from_reference_distances():
    x, ref = simhash.reference(50, 9), simhash.reference(4, 8)
    mask = 0x00FF00FF0000FFF0
    full, other = simhash.distance_table(x, ref).astype(int), simhash.distance_table(x, ref ^ np.uint64(mask)).astype(int)
    assert ((full - other + mask.bit_count()) // 2 == simhash.distance_table(x, ref, mask)).all()


@pytest.mark.parametrize("links", [[], [(1, 2)], [(k, k + 1) for k in range(1, 60)], [(50, k) for k in range(49)], [(3, 3), (9, 4), (4, 7), (20, 21), (21, 20)]])
def test_components(spark, links):
    ids = sorted({x for p in links for x in p if p[0] != p[1]})
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == classes([p for p in links if p[0] != p[1]], ids)


# --- near duplicates of the pipeline ----------------------------------------------------------------------


def jaccard(a, b):
    def s(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    a, b = s(a), s(b)
    return len(a & b) / len(a | b) if a | b else 0.0


def test_near_duplicates_equal_brute_force(spark, docs, texts):
    r, rows = random.Random(3), {i: t for i, t in texts.items() if i < 90}
    for k, i in enumerate(sorted(rows)[:20]):  # edits of one, two and many words
        w = rows[i].split()
        for _ in range(1 + 3 * (k % 3)):
            w[r.randrange(len(w))] = "edited"
        rows[10_000 + i] = " ".join(w)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    ids = sorted(rows)
    want = classes([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(rows[a], rows[b]) >= 0.8], ids)
    got = {i: i for i in ids} | {x["node"]: x["component"] for x in neardup.near_components(df).collect()}
    assert got == want and len(set(want.values())) < len(ids)


@pytest.mark.parametrize("run", [6, 25, 1000])
def test_near_duplicates_in_hot_keys(spark, run):
    r = random.Random(8)
    word = lambda: f"w{r.randrange(10**6)}"
    family, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    rows = {k: [*family[: k % 100], word(), *family[k % 100 :]] for k in range(80)}  # near copies of one text
    rows |= {100 + k: [*passage, *(word() for _ in range(60))] for k in range(60)}  # one passage, else nothing in common
    df = spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], "doc_id long, text string")
    got = {x["node"]: x["component"] for x in neardup.near_components(df, run=run, key_run=2 * run).collect()}
    assert got == {k: 0 for k in range(80)}


def test_near_duplicates_odd_rows(odd):
    kept = sorted(r[0] for r in neardup.drop_near(odd).select("doc_id").collect())
    assert kept == [1, 3, 4, 5, 6, 8, 10, 11, 12, 13, 14]
    assert neardup.drop_near(odd).columns == odd.columns and neardup.drop_near(odd.limit(0)).count() == 0


# --- op5 -------------------------------------------------------------------------------------------------


def check_op5(df, rows):
    got = {r["doc_id"]: r for r in exact.exact_dedup(df).collect()}
    groups = {}
    for i, t in rows.items():
        groups.setdefault(t, []).append(i)
    assert len(got) == len(rows)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())


def test_exact_dedup(docs, texts, odd):
    check_op5(docs, texts)
    check_op5(odd, {i: t or "" for i, t, _ in ODD})
    assert exact.exact_dedup(odd.limit(0)).count() == 0
    assert sorted(r[0] for r in exact.drop_exact(odd).select("doc_id").collect()) == [4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14]


def test_exact_dedup_long_common_starts(spark):
    rows = {k: "a" * n for k, n in enumerate((0, 23, 24, 25, 255, 256, 257, 2048, 2049, 2049, 17000, 17000))} | {20: "a" * 2048 + "b", 21: "a" * 16999 + "b"}
    check_op5(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), rows)


def test_repeated_rows(spark, odd):
    rows = [(5, "alpha beta"), (5, "alpha beta"), (5, "other"), (6, "alpha beta"), (7, "other"), (7, "other"), (8, "lone"), (8, "lone two")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact.exact_dedup(df).collect())
    assert got == [(5, 6, 3, False), (5, 6, 3, False), (5, 7, 3, False), (6, 6, 3, True), (7, 7, 3, True), (7, 7, 3, True), (8, 8, 1, True), (8, 8, 1, True)]
    assert sorted(tuple(r) for r in exact.drop_exact(df).collect()) == sorted([rows[3], rows[4], *rows[6:]])
    sizes = sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in shards.encode_corpus(df, public_path("word_bpe_49k.json")).collect())
    assert sizes == sorted((i, len(x), crc(x)) for i, t in rows for x in [library("word_bpe_49k.json", t, 2)])
    assert simhash.simhash_components(df).count() == len(rows) and repeats.remove_repeats(df).count() == len(rows)
    assert sum(r["length"] for r in packing.pack(df, public_path("byte_bpe_50k.json")).collect()) == sum(len(library("byte_bpe_50k.json", t, 0)) for _, t in rows)
    assert neardup.drop_near(df).count() == 5 and pii.pii_digest(df).count() == len(rows)


def test_exact_dedup_null_ids(spark):
    df = spark.createDataFrame([(None, "t"), (None, "t"), (1, "t"), (None, "u"), (None, "u")], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["keep_id"] or 0, r["group_size"], r["kept"]) for r in exact.exact_dedup(df).collect())
    assert got == [(0, 0, 2, True)] * 2 + [(0, 1, 3, False)] * 2 + [(1, 1, 3, True)]
    assert sorted((r[0] or 0, r[1]) for r in exact.drop_exact(df).collect()) == [(0, "u"), (1, "t")]


def test_exact_dedup_keeps_distinct_texts_whose_groups_share_a_head(spark):
    x, y = "x" * 24, "y" * 24
    rows = [(7, x + "aaa"), (5, x + "same"), (7, y + "bbb"), (4, y + "same")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, exact.drop_exact(df).collect())) == sorted(rows)
    pairs = [(7, x + "1"), (3, x + "1"), (7, y + "1"), (2, y + "1"), (7, x + "1" * 400), (7, x + "1" * 400), (1, x + "1" * 400)]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    assert sorted(r["group_size"] for r in exact.exact_dedup(df).collect()) == [2, 2, 2, 2, 3, 3, 3]
    assert sorted(map(tuple, exact.drop_exact(df).collect())) == sorted([(7, x + "1"), (7, y + "1"), (7, x + "1" * 400)])


# --- op2, op7 ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name,kind", [("word_bpe_49k.json", "word"), ("byte_bpe_50k.json", "byte")])
def test_encoder_equals_the_library(texts, name, kind, monkeypatch):
    from tidemill.llm import tokens

    samples = [t or "" for _, t, _ in ODD if len(t or "") < 9000] + list(texts.values())[:60]
    samples += ["a<|endoftext|>b", "İstanbul H̱x", "don't  stop\n\n\n x  ", "\xa0\xa0 x ²½ 12", "''t '' ''s 'LL", "a\r\n\tb", "é é", "x" * 300, "!!!...???", "A1b2C3", "\x85 x"]
    enc = Encoder(public_path(name), kind)
    for limit in (tokens.TABLE_PIECES, 150):
        monkeypatch.setattr(tokens, "TABLE_PIECES", limit)
        ids, _, upto = enc.encode_many(samples)
        for k, s in enumerate(samples):
            assert ids[upto[k] : upto[k + 1]].tolist() == enc.tokenizer.encode(s, add_special_tokens=False).ids, repr(s[:40])


@functools.lru_cache
def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_path(name))


def library(name, text, end):
    return tokenizer(name).encode(text, add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_shards_round_trip(odd):
    got = sorted(tuple(r) for r in shards.encode_corpus(odd, public_path("word_bpe_49k.json")).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    at, want = 0, []
    for i, t, _ in sorted(ODD):
        ids = library("word_bpe_49k.json", t or "", 2)
        want.append((i, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert shards.encode_corpus(odd.limit(0), public_path("word_bpe_49k.json")).count() == 0


def test_shards_of_the_whole_table(docs, texts):
    path = public_path("word_bpe_49k.json")
    got = {r["doc_id"]: (r["start"], r["n_tokens"], r["ids_crc32"]) for r in shards.encode_corpus(docs, path).collect()}
    at = 0
    for i in sorted(texts):
        ids = library("word_bpe_49k.json", texts[i], 2)
        assert got[i] == (at, len(ids), crc(ids))
        at += len(ids)
    manifest = shards.write_shards(docs, path, "word", 2).persist()
    found = {r["doc_id"]: r["ids"] for r in shards.get_many(manifest, [3, 150, 150, 10**9, -4]).collect()}
    assert found == {i: library("word_bpe_49k.json", texts[i], 2) for i in (3, 150)}
    assert shards.get_many(manifest, []).count() == 0


def test_shards_hold_rows_without_an_id(spark, monkeypatch):
    rows = [(None, "no id"), (None, "no id"), (4, "four"), (0, "zero"), (None, None), (4, "four again")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for size in (1, 1 << 20):  # bytes of a shard
        monkeypatch.setattr(shards, "SHARD_BYTES", size)
        got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in shards.encode_corpus(df, public_path("word_bpe_49k.json")).collect())
        at, want = 0, []
        for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
            ids = library("word_bpe_49k.json", t or "", 2)
            want.append((at, i, len(ids), crc(ids)))
            at += len(ids)
        assert got == want
        manifest = shards.write_shards(df, public_path("word_bpe_49k.json"), "word", 2)
        assert [(r["doc_id"], r["ids"]) for r in shards.get_many(manifest, [4, 7]).collect()] == [(4, library("word_bpe_49k.json", "four", 2))]


@pytest.mark.parametrize("n", [0, 1, 2, 1000])
def test_perfect_hash_is_minimal_and_knows_strangers(n):
    keys = simhash.reference(n, 1).view(np.int64)
    lengths = np.arange(n) % 5
    ids = np.arange(lengths.sum()) % 60000
    s = shards.Shard(shards.pack_shard(keys, lengths, ids))
    assert sorted(s.hash.slots(keys.view(np.uint64)).tolist()) == list(range(n))
    place, length = s.find(keys)
    assert (length == lengths).all() and (place == np.cumsum(lengths) - lengths).all() and (s.payload == ids).all()
    strangers = simhash.reference(500, 2).view(np.int64)
    assert (s.find(strangers)[1] == -1).all()
    if n:
        assert s.get(int(keys[-1])).tolist() == ids[len(ids) - lengths[-1] :].tolist() and s.get(12345) is None


def test_shard_bears_wide_ids_and_rejects_other_files():
    s = shards.Shard(shards.pack_shard(np.array([5]), np.array([2]), np.array([70000, 1])))
    assert s.get(5).tolist() == [70000, 1]
    with pytest.raises(ValueError):
        shards.Shard(b"x" * 100)
    with pytest.raises(ValueError):
        shards.PerfectHash.build(np.array([1, 1], np.uint64))
    s = shards.Shard(shards.pack_shard(np.array([3, 3, 9]), np.array([1, 2, 1]), np.array([7, 8, 8, 9])))
    assert s.get(3).tolist() == [7] and s.get(9).tolist() == [9] and [x.tolist() for x in s.rows()] == [[0, 1, 3], [1, 2, 1]]


def padding(n):
    return 0 if n & (n - 1) == 0 else 1024 - n


def check_pieces(rows, texts):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert set(by_doc) == set(texts)
    for i, t in texts.items():
        ids, at = library("byte_bpe_50k.json", t, 0), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    total = 0
    for seq in by_seq.values():
        at = 0
        for r in sorted(seq, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
        total += padding(at)
    return total


def test_packing(docs, texts, odd):
    some = {i: t for i, t in texts.items() if i < 60}
    pad = check_pieces(packing.pack(docs.where("doc_id < 60"), public_path("byte_bpe_50k.json")).collect(), some)
    assert pad < 0.05 * sum(len(library("byte_bpe_50k.json", t, 0)) for t in some.values())
    check_pieces(packing.pack(odd, public_path("byte_bpe_50k.json")).collect(), {i: t or "" for i, t, _ in ODD})
    assert packing.pack(odd.limit(0), public_path("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("seed", range(8))
def test_cuts_are_optimal(seed):
    r = np.random.default_rng(seed)
    pos = np.concatenate([[0], np.cumsum(r.integers(1, 14, 40))])
    pen = r.integers(0, 6, len(pos))
    pen[0] = 0
    size = 32
    pad = lambda n: 0 if n & (n - 1) == 0 else size - n
    cost = [0] + [10**9] * (len(pos) - 1)
    for i in range(1, len(pos)):
        cost[i] = pen[i] + min(cost[j] + pad(pos[i] - pos[j]) for j in range(i) if pos[i] - pos[j] <= size)
    cuts = packing.choose_cuts(pos, pen, size)
    got = sum(pen[b] + pad(pos[b] - pos[a]) for a, b in zip(cuts, cuts[1:], strict=False))
    assert cuts[0] == 0 and cuts[-1] == len(pos) - 1 and got == cost[-1]


# --- op3 -------------------------------------------------------------------------------------------------


def plain_repeats(rows, n=50):
    seen, out = set(), {}
    for i in sorted(rows):
        b = rows[i].encode()
        cov, own = bytearray(len(b)), set()
        for j in range(len(b) - n + 1):
            s = b[j : j + n]
            if s in seen:
                cov[j : j + n] = b"\1" * n
            own.add(s)
        seen |= own
        kept = bytes(x for x, c in zip(b, cov, strict=True) if not c)
        spans = sum(1 for k, c in enumerate(cov) if c and (k == 0 or not cov[k - 1]))
        out[i] = (len(b), sum(cov), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def check_op3(df, rows):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in repeats.remove_repeats(df).collect()}
    assert got == plain_repeats(rows)


def test_repeats_equal_brute_force(docs, texts):
    check_op3(docs.where("doc_id < 120"), {i: t for i, t in texts.items() if i < 120})


def test_repeats_odd_rows(odd):
    check_op3(odd, {i: t or "" for i, t, _ in ODD})
    assert repeats.remove_repeats(odd.limit(0)).count() == 0
    same = odd.select(F.lit(1).cast("long").alias("doc_id"), "text").where("length(text) > 4000")
    assert repeats.remove_repeats(same).agg(F.sum("n_removed")).first()[0] == 0


def test_repeats_overlaps_and_low_entropy(spark):
    r = random.Random(1)
    pool = ["".join(r.choice("ab") for _ in range(60)) for _ in range(6)] + ["z" * 70, "ab" * 40]
    rows = {k: "".join(r.choice(pool)[r.randint(0, 9) :] for _ in range(r.randint(1, 5))) for k in range(60)}
    check_op3(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), rows)


def test_repeats_across_blocks(spark, monkeypatch):
    r = random.Random(2)
    shared = "".join(r.choice("abcdefgh ") for _ in range(900))
    rows = {1: "q" * 37 + shared, 2: shared[100:] + "w" * 11 + shared[:300], 3: "e" * 120 + shared[250:420]}
    for size in (64, 100, 257):
        monkeypatch.setattr(repeats, "BLOCK", size)
        sent = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
        got = list(repeats.Anchors().of(rows[1].encode()))
        assert sum(len(p[2]) for p in got) > 0 and len(got) == -(-(len(rows[1]) - 49) // size)
        check_op3(sent, rows)


@pytest.mark.parametrize("n,letters,wide", [(0, 3, 16), (1, 3, 16), (2, 1, 16), (300, 2, 48), (1500, 3, 64), (700, 1, 40), (900, 200, 32)])
def test_deep_shallow_sort(n, letters, wide):
    r = np.random.default_rng(n)
    x = r.integers(97, 97 + letters, (n, wide)).astype(np.uint8)
    if n > 100:
        x[: n // 2, :24] = 97
        x[r.integers(0, n, n // 3)] = x[3]
    order, cls = suffix.deep_shallow(suffix.as_words(x))
    rows = [x[i].tobytes() for i in order]
    assert rows == sorted(y.tobytes() for y in x) and sorted(order.tolist()) == list(range(n))
    assert all((a == b) == (cls[k] == cls[k + 1]) for k, (a, b) in enumerate(zip(rows, rows[1:], strict=False)))


# --- op4 -------------------------------------------------------------------------------------------------


def plain_ppm(text, counts):
    total = 0.0
    s = b"\n\n\n" + text
    for k in range(3, len(s)):
        nats = 0.0
        for order in (3, 2, 1, 0):
            seen = {}
            for g, n in counts.items():
                if g[3 - order : 3] == s[k - order : k]:
                    seen[g[3]] = seen.get(g[3], 0) + n
            n, q = sum(seen.values()), len(seen)
            if s[k] in seen:
                nats += -np.log(seen[s[k]] / (n + q))
                break
            if n:
                nats += -np.log(q / (n + q))
        else:
            nats += np.log(256)
        total += nats
    return total


def test_code_lengths_equal_plain_trees():
    samples = {"aa": b"the cat sat on the mat", "bb": b"le chat est sur le tapis", "cc": b"z"}
    trees = language.ByteTrees({k: np.unique(language.grams(v), return_counts=True) for k, v in samples.items()})
    for text in (b"the cat", b"le chat zq", b"\xff\x00 new", b"z", b"", b"thzzz"):
        want = []
        for k in trees.langs:
            s, counts = b"\n\n\n" + samples[k], {}
            for j in range(len(samples[k])):
                counts[s[j : j + 4]] = counts.get(s[j : j + 4], 0) + 1
            want.append(plain_ppm(text, counts))
        assert np.allclose(trees.code_lengths(text), want)


def test_code_length_does_not_depend_on_blocks(monkeypatch):
    trees = language.ByteTrees({"x": np.unique(language.grams(LONG[:5000].encode()), return_counts=True)})
    whole = trees.code_lengths(LONG.encode())
    monkeypatch.setattr(language, "BLOCK", 1000)
    assert np.allclose(trees.code_lengths(LONG.encode()), whole)


def test_language_held_out_accuracy(docs, odd):
    out = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang_pred <> 'und'")
    assert out.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    trees = language.learn(docs)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(odd, trees).collect()}
    assert got[3] == got[4] == got[5] == ("und", 0.0) and len(got) == len(ODD) and all(0 <= s <= 1 for _, s in got.values())
    assert {r["lang_pred"] for r in language.language_report(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.language_report(odd.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["²²", "Ⅷ", "123 ½", "٣ ①", " ?!\n"])
def test_signs_are_no_letters(text):
    trees = language.ByteTrees({x: (np.array([65], np.uint32), np.array([1])) for x in ("de", "fr")})
    assert trees.predict(text.encode()) == ("und", 0.0) and trees.predict((text + "é").encode())[0] != "und"


def test_predictions_ignore_other_columns(docs):
    trees = language.learn(docs)
    a = {r[0]: r[1] for r in language.identify(docs, trees).select("doc_id", "lang_pred").collect()}
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("yy")})
    assert a == {r[0]: r[1] for r in language.identify(other, trees).select("doc_id", "lang_pred").collect()}


def test_bounded_sample(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), (F.col("id") % 3).cast("string").alias("k"))
    for rows in (1, 50, 10_000):
        got = {r["k"]: r["count"] for r in bounded_sample(df, "k", "doc_id", rows).groupBy("k").count().collect()}
        assert len(got) == 3 and all(0.5 * min(rows, 1666) <= n <= max(rows, 3) for n in got.values())
    assert bounded_sample(df.limit(0), "k", "doc_id", 5).count() == 0


# --- op8 -------------------------------------------------------------------------------------------------


def test_network_gradient():
    net = quality.ByteConvNet(seed=1)
    for k in net.p:
        net.p[k] = net.p[k].astype(np.float64)
    text = (" ".join(BASE) * 3).encode()
    grad = net.gradient(text, 1, 1.0)
    r, loss = np.random.default_rng(0), lambda: -np.log(net.probability(text))
    for k, g in grad.items():
        for _ in range(6):
            at = tuple(r.integers(0, s) for s in net.p[k].shape)
            keep = net.p[k][at]
            net.p[k][at] = keep + 1e-5
            up = loss()
            net.p[k][at] = keep - 1e-5
            down = loss()
            net.p[k][at] = keep
            assert abs((up - down) / 2e-5 - g[at]) < 2e-4 + 1e-2 * abs(g[at]), k


def test_network_sees_the_whole_text(monkeypatch):
    net, text = quality.ByteConvNet(), LONG.encode()[:60000]
    whole = net.probability(text)
    monkeypatch.setattr(quality, "BLOCK_CHUNKS", 7)
    assert abs(net.probability(text) - whole) < 1e-4
    assert net.probability(text[:-200] + b"!" * 200) != whole and 0 <= net.probability(b"") <= 1


def plain_probability(net, text):
    """One place after another, one chunk after another, with nothing but loops."""
    p, half = net.p, quality.HALF
    halves = max(2, -(-len(text) // (half * quality.STRIDE)))
    x = list(text) + [0] * (halves * half * quality.STRIDE + quality.WIDTH - quality.STRIDE - len(text))
    places = []
    for k in range(halves * half):
        seen = np.concatenate([p["E"][x[k * quality.STRIDE + i]] for i in range(quality.WIDTH)])
        places.append(np.maximum(seen @ p["W"] + p["b"], 0))
    hidden = []
    for c in range(halves - 1):
        chunk = np.stack(places[c * half : (c + 2) * half])
        hidden.append(np.maximum(np.concatenate([chunk.mean(axis=0), chunk.max(axis=0)]) @ p["V"] + p["c"], 0))
    h = np.stack(hidden)
    return 1 / (1 + np.exp(-(np.concatenate([h.max(axis=0), h.mean(axis=0)]) @ p["u"] + p["d"][0])))


@pytest.mark.parametrize("blocks", [4096, 2])
def test_probability_equals_plain_loops(texts, blocks, monkeypatch):
    monkeypatch.setattr(quality, "BLOCK_CHUNKS", blocks)
    net = quality.ByteConvNet(3)
    for t in (b"", b"a", "ñ é".encode() * 30, b"x" * 1000, *(t.encode() for t in list(texts.values())[:15])):
        assert net.probability(t[:6000]) == pytest.approx(float(plain_probability(net, t[:6000])), abs=1e-5)


def test_quality_area_on_rows_held_out(spark):
    sf = SF.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.quality_report(docs, labels).where("held_out").join(labels, "doc_id").select("quality", "score").collect()
    good, bad = ([r["score"] for r in rows if r["quality"] == k] for k in (1, 0))
    area = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert len(good) >= 15 and len(bad) >= 15 and area > 0.9


def test_quality_held_out(spark, odd):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality.quality_report(docs, labels)
    held = out.where("held_out").join(labels, "doc_id").select("score", "predicted", "quality").collect()
    assert out.count() == docs.count() and np.mean([r["predicted"] == r["quality"] for r in held]) > 0.9
    none = quality.quality_report(odd, labels.limit(0)).collect()
    assert len(none) == len(ODD) and all(0 <= r["score"] <= 1 for r in none)
    assert quality.quality_report(odd.limit(0), labels.limit(0)).count() == 0


# --- op9 -------------------------------------------------------------------------------------------------


def plain_base(text):
    out = []
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(d[::-1])) % 10 == 0
    kinds = (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(x) <= 255 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 16 <= len(d) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 8 <= len(d) <= 15),
    )
    for kind, p, ok in kinds:
        out += [(kind, *m.span()) for m in re.finditer(p, text) if ok(m[0], re.sub("[^0-9]", "", m[0]))]
    return out


def base_of(text):
    return [s[:3] for s in pii.find_pii(text) if s.kind in pii.KINDS[: pii.BASE]]


def test_base_spans_equal_plain_patterns(texts):
    r = random.Random(4)
    for t in texts.values():
        assert base_of(t) == plain_base(t)
    bits = ["a@b.c", "@", ".", "1.2.3.4", "4111 1111-1111 1111", "+1 (555) 123-4567", "+", "-", "999", "x.y@z-1.co.uk", "0012.1.1.1", " ", "é", "a", "@b.c", "7"]
    for _ in range(3000):
        t = "".join(r.choice(bits) for _ in range(r.randint(1, 9)))
        assert base_of(t) == plain_base(t), t


def test_base_spans_take_linear_time():
    for t in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+" * 200_000, "a@" * 100_000, "a@b." * 50_000, "+1" + "-" * 300_000, "1 " * 150_000):
        base_of(t)


def test_checksums_and_context():
    kinds = lambda t: [s.kind for s in pii.find_pii(t)]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 ok") == ["iban"] and kinds("IBAN GB83 WEST 1234 5698 7654 32 ok") == []
    assert kinds("my SSN is 123-45-6789") == ["ssn"] and kinds("code 123-45-6789") == [] and kinds("order part no 123-45-6789 SSN") == []
    a, b = (pii.find_pii(t)[0].score for t in ("call my phone +1 555 123 4567", "xx +1 555 123 4567"))
    assert a > b and pii.masked("mail a@b.co now") == "mail [email] now"


def test_pii_digest(odd, docs, texts):
    got = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    for i, t in texts.items():
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in plain_base(t))
        assert got[i]["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert got[i]["spans"] == ",".join(f"{s.kind}:{s.start}:{s.end}" for s in pii.find_pii(t))
        assert got[i]["n_email"] == sum(s[0] == "email" for s in plain_base(t))
    assert pii.pii_digest(odd).count() == len(ODD) and pii.pii_digest(odd.limit(0)).count() == 0


# --- op10 ------------------------------------------------------------------------------------------------


def plain_matches(text, items):
    out = {}
    w = text.lower().encode().split()
    for key, item in items:
        iw = item.lower().encode().split()
        size = len(iw)
        n = min(5, size)
        want = decontam.Counter(decontam._grams(iw, n))
        for a in range(len(w) - size + 1) if size else ():
            v = decontam.weighted_similarity(decontam.Counter(decontam._grams(w[a : a + size], n)), want)
            if v >= 0.8 and v > out.get(key, (0,))[0]:
                out[key] = (v, a, size)
    return sorted((k, a, size, v) for k, (v, a, size) in out.items())


def test_decontamination_equals_brute_force(spark, odd):
    r = random.Random(6)
    items = [(k, " ".join(r.choice(BASE) + str(r.randrange(20)) for _ in range(n))) for k, n in enumerate((3, 8, 15, 30, 40, 40, 25))] + [(90, ""), (91, "one two"), (92, " ".join(["la"] * 20))]
    rows = {}
    for k in range(120):
        w = [r.choice(BASE) + str(r.randrange(20)) for _ in range(r.randint(0, 80))]
        part = r.choice(items)[1].split()
        if part and k % 3 == 0:
            part[r.choice((0, -1, len(part) // 2))] = r.choice(part)
        at = r.randrange(len(w) + 1)
        rows[k] = " ".join(w[:at] + ([x.upper() for x in part] if k % 2 else []) + w[at:])
    rows[200], rows[201] = " ".join(["la"] * 300), "ONE\n two"
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(x) for x in decontam.contamination(df, bench).collect())
    want = sorted((d, *m) for d, t in rows.items() for m in plain_matches(t, items))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(want) > 30
    assert np.allclose([g[4] for g in got], [w[4] for w in want])
    kept = decontam.drop_contaminated(df, bench)
    assert sorted(x[0] for x in kept.select("doc_id").collect()) == sorted(set(rows) - {w[0] for w in want})
    assert decontam.contamination(odd, bench).count() == len([m for _, t, _ in ODD for m in plain_matches((t or "")[:3000], items)])
    assert decontam.contamination(odd, bench.limit(0)).count() == 0 and decontam.contamination(odd.limit(0), bench).count() == 0


def test_decontamination_takes_the_benchmark_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 3)
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(7)]
    df = spark.createDataFrame([(k, "pre " + t) for k, t in items], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"]) for r in decontam.contamination(df, spark.createDataFrame(items, "item_id long, text string")).collect())
    assert got == [(k, k) for k in range(7)]


def test_no_item_is_lost_between_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 2)
    items = [(1, "a1 a2 a3 a4 a5 a6"), (2, "b1 b2 b3 b4 b5 b6"), (2, "c1 c2 c3 c4 c5 c6"), (None, "d1 d2 d3 d4 d5 d6"), (None, "e1 e2 e3 e4 e5 e6"), (None, "f1 f2 f3 f4 f5 f6")]
    df = spark.createDataFrame([(k, t) for k, (_, t) in enumerate(items)], "doc_id long, text string")
    for size in (1 << 20, 20):  # bytes of a block; the second is less than two items have
        monkeypatch.setattr(decontam, "BLOCK_BYTES", size)
        bench = spark.createDataFrame(items, "item_id long, text string")
        got = sorted((r["doc_id"], r["item_id"] or 0) for r in decontam.contamination(df, bench).collect())
        assert got == [(k, i or 0) for k, (i, _) in enumerate(items)]
        assert decontam.drop_contaminated(df, bench).count() == 0


def test_blocks_find_all_within_the_radius():
    a, b = simhash.reference(800, 4).reshape(-1, 4), simhash.reference(1200, 5).reshape(-1, 4)
    r = np.random.default_rng(1)
    for k in range(150):  # 40 to 90 bits away
        flips = np.zeros(256, np.uint8)
        flips[r.choice(256, 40 + k // 3, replace=False)] = 1
        b[k] = a[k] ^ np.packbits(flips).view(np.uint64)
    for radius in (20, 73):
        blocks = decontam.HammingBlocks(a, radius)
        q, f = blocks.pairs(b)
        want = {(i, j) for i in range(300) for j in range(200) if int(np.bitwise_count(b[i] ^ a[j]).sum()) <= radius}
        assert set(zip(q.tolist(), f.tolist(), strict=True)) == want
    assert len(blocks.candidates(b[150:])[0]) < 0.12 * 150 * 200  # of unrelated pairs


def test_few_shingles_with_all_the_weight(spark):
    item = " ".join(["to be or not"] * 12)
    docs = [(k, " ".join(["to be or not"] * 11) + f" x{k} be or not") for k in range(40)]
    got = decontam.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string"))
    want = [d for d, t in docs if plain_matches(t, [(1, item)])]
    assert sorted(r["doc_id"] for r in got.collect()) == want and len(want) == 40


# --- op6 -------------------------------------------------------------------------------------------------


def plain_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@pytest.mark.parametrize("seed", range(20))
def test_lcs(seed):
    r = random.Random(seed)
    a, b = ([r.choice("abcd") for _ in range(r.randint(0, 14))] for _ in range(2))
    at = pages.lcs(a, b)
    it = iter(b)
    assert at == sorted(set(at)) and all(a[k] in it for k in at) and len(at) == plain_lcs(a, b)


@pytest.mark.parametrize(
    "markup,text",
    [
        ("<article><h1>T &amp; t</h1><p><b>One\n two<br><p>Three</article><footer>f</footer>", "T & t\nOne two\nThree"),
        ("<body><nav><ul><li>m</ul></nav><main><p>a<div class='x ad-box'>no</div><p>b</main><aside>s</aside>", "a\nb"),
        ("<script>var a='<p>x</p>'</script><style>p{}</style><p>y<!-- <p>c</p> -->z", "yz"),
        ("<article><p>a</p><section id=comments><p>c</p></section><p>b</p><form>f</form></article>", "a\nb"),
        ("<p>1 < 2 &lt; 3 &copy;&#233;&nbsp;x</p>", "1 < 2 < 3 ©é x"),
        ("<article><p>open <b>bold</b>ly<p>cut of", "open boldly\ncut of"),
        ("<article><p>x<p data-a='>'>y</p></article", "x\ny"),
        ("<table><tr><td>a<td>b</table>", "a\nb"),
        ("", ""),
        ("<p hidden>h</p><div style='display: none'>n</div>", ""),
        ("<!-- never closed <p>x", ""),
        ("<article class='advert'>no</article><p>yes", "yes"),
        ("<body class='overflow-hidden'><article class='overflow-hidden'><p>x</p></article>", "x"),
        ("<article><p>see <a href='/hidden-gems'>these gems</a> and <a class='share'>that</a> now</p></article>", "see these gems and that now"),
        ("<article><p class='lead share-price'>Up</p><div class='ad-hoc'>b</div><section class='social-history' aria-label='Related work'><p>c</p></section></article>", "Up\nb\nc"),
        ("<article><header><h1>Title</h1><p>By me</p></header><p>t</p></article>", "Title\nt"),
        ("<header><h1>Site</h1></header><div class='site-header'>h</div><p>t</p><div class='comment-list'><p>c</p></div>", "t"),
        ("<article><p>a <span hidden>no</span><button>go</button> b</p></article>", "a b"),
        ("<article class='post related-off'><p>a</p><article class='comment x'><p>c</p></article></article>", "a"),
    ],
)
def test_page_text(markup, text):
    assert pages.main_text(markup) == text


def test_pages_differ_from_their_neighbours(spark):
    top = "<div>Site name</div><div>Welcome to all</div>"
    rows = [(i, f"http://h.x/a/{i}", f"<body>{top}<p>Own {i}</p><p>More {i}</p><div>Imprint</div>") for i in range(30)]
    rows += [(50, None, None), (51, "http://g.x/", "<p>alone"), (52, "http://i.x/a/7", "<article><p>Art</article><p>Imprint"), (53, "u", ""), (None, "http://k.x/1", "<p>k")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("page", "near", "host", "path", "lines", "text", "other", "open")})
    got = pages.extract_pages(df.repartition(5)).collect()
    text = {r["page_id"]: r["text"] for r in got}
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    assert all(text[i] == f"Own {i}\nMore {i}" for i in range(30))
    assert (text[50], text[51], text[52], text[53], text[None]) == ("", "alone", "Art", "", "k")
    assert pages.extract_pages(df.limit(0)).count() == 0


def test_neighbours_decide_what_a_class_leaves_open(spark):
    page = lambda k: f"<article><p>Own {k}</p><div class='share-price'>Price {k}</div><div class='related-work'>Read on</div></article>"
    rows = [(k, f"http://h/a/{k}", page(k)) for k in range(4)] + [(9, "http://g/a", page(9))]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Own {k}\nPrice {k}" for k in range(4)} | {9: "Own 9\nPrice 9\nRead on"}


def test_the_nearest_path_is_on_either_side(spark):
    page = lambda own, side: f"<p>{side} top</p><p>{own}</p>"
    rows = [(1, "http://h/a/z", page("one", "A")), (2, "http://h/b/a", page("two", "B")), (3, "http://h/b/b", page("three", "B"))]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "A top\none", 2: "two", 3: "three"}


def test_pages_of_the_tables(spark):
    df = spark.read.parquet(f"{SF}/pages.parquet")
    import html

    for r in df.join(pages.extract_pages(df).select("page_id", F.col("text").alias("got")), "page_id").collect():
        body = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", body)]
        assert r["got"] == "\n".join(b for b in blocks if b)


# --- queries and the pipeline ---------------------------------------------------------------------------------


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_sql(spark, duck, name):
    got = llm_queries()[name](spark, SF)
    cur = duck.execute(llm_oracle_sql()[name])
    columns = [d[0] for d in cur.description]
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(cur.fetchall())


def test_pipeline_equals_brute_force(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "decontaminate", "pack"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    net = quality.learn(docs, labels)
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    rows = {i: t for i, t in rows.items() if net.probability(t.encode()) >= 0.5}
    last = {}
    for i in sorted(rows):
        last[rows[i]] = i
    rows = {i: t for i, t in rows.items() if last[t] == i}
    ids = sorted(rows)
    near = classes([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(rows[a], rows[b]) >= 0.8], ids)
    rows = {i: t for i, t in rows.items() if near[i] == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    index = decontam.BenchmarkIndex([(k, t.encode()) for k, t in items])
    hit = {i for i, m in zip(rows, index.scan([t.encode() for t in rows.values()]), strict=True) if m}
    assert hit >= {i for i, t in rows.items() if any(x in t for _, x in items)}
    rows = {i: t for i, t in rows.items() if i not in hit}
    check_pieces(corpus_pipeline.run(spark, SF).collect(), rows)


def test_stages_keep_the_columns(spark, odd):
    import corpus_pipeline

    docs = odd.select("doc_id", "text", "lang", F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0
