"""Inputs on which an operator could do less than its whole job."""

import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from tests.llm.test_operators import classes, jaccard
from tidemill.llm import exact, neardup, pages, quality, tokens
from tidemill.llm.common import bounded_sample


def near(spark, rows, run):
    """Components of the near duplicates, and those of brute force."""
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {i: i for i in rows} | {x["node"]: x["component"] for x in neardup.near_components(df, run=run, key_run=4 * run).collect()}
    ids = sorted(rows)
    return got, classes([(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if jaccard(rows[a], rows[b]) >= 0.8], ids)


def edited(words, n, r):
    words = list(words)
    for k in r.sample(range(len(words) // 6), n):
        words[6 * k + 3] = f"e{r.randrange(10**9)}"
    return " ".join(words)


@pytest.mark.parametrize("run", [1000, 16])
def test_copies_of_one_original_that_differ_from_each_other(spark, run):
    r = random.Random(4)
    words = [f"w{r.randrange(10**6)}" for _ in range(250)]
    rows = {1000: " ".join(words)} | {k: edited(words, 4, r) for k in range(100)}
    got, want = near(spark, rows, run)
    assert set(want.values()) == {0} and sum(got[k] == 0 for k in rows) == 101


def test_hot_keys_find_the_same_links(spark):
    r = random.Random(6)
    word = lambda: f"w{r.randrange(10**6)}"
    passage, rows = [word() for _ in range(40)], {}
    for f in range(40):  # originals with a passage in common, each with copies that differ more from each other
        words = [*passage, *(word() for _ in range(200))]
        rows[500 + f] = " ".join(words)
        rows |= {10 * f + k: edited(words, 4, r) for k in range(4)}
    got, want = near(spark, rows, 8)
    assert got == want and len(set(want.values())) == 40


def test_repeated_lines_and_short_texts(spark):
    r, rows = random.Random(7), {}
    for k in range(40):
        words = [f"w{r.randrange(10**6)}" for _ in range(200)]
        rows[4 * k], rows[4 * k + 1] = " ".join(words), " ".join(words + words[:16] * 50)
        rows[4 * k + 2], rows[4 * k + 3] = " ".join(words[20:28]), " ".join(words[20:29])  # 4 of 5 shingles
    got, want = near(spark, rows, 1000)
    assert got == want and len(set(want.values())) == 80


@pytest.mark.parametrize("name,kind", [("byte_bpe_50k.json", "byte")])
def test_more_distinct_pieces_than_the_table_holds(name, kind, monkeypatch):
    monkeypatch.setattr(tokens, "TABLE_PIECES", 60)
    many = [" ".join(str(7_000_000 + 37 * k) for k in range(200)) + ". End.", "short one. Two"]
    enc = tokens.Encoder(tokens.public_path(name), kind)
    ids, sentence, upto = enc.encode_many(many)
    for k, t in enumerate(many):
        assert ids[upto[k] : upto[k + 1]].tolist() == enc.tokenizer.encode(t, add_special_tokens=False).ids
    assert sentence.sum() == 3 and len(enc.index) <= 60


def test_copies_of_a_page_without_an_article(spark):
    page = lambda body, side: "<html><body>" + "".join(f"<p>{x}</p>" for x in (f"{side} top", *body, f"{side} end")) + "</body></html>"
    rows = [(k, f"http://h/a/{k}", page(["story one", "more of it"], "A")) for k in range(5)]  # copies only, in path order
    rows += [(9, "http://h/a/9", page(["story nine"], "A")), (10, "http://h/b/1", page(["first of b"], "B")), (11, "http://h/b/2", page(["second of b"], "B"))]
    want = {k: "story one\nmore of it" for k in range(5)} | {9: "story nine", 10: "first of b", 11: "second of b"}
    for n in (1, 4):
        df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(n)
        assert {r["page_id"]: r["text"] for r in pages.extract_pages(df).collect()} == want


# --- faults found by review --------------------------------------------------------------------------


def test_stages_with_columns_of_any_name(spark):
    names = ("row", "id", "text2", "node", "component", "i", "z", "h", "__i", "__z", "__h", "__node", "__again", "__id", "__odd", "again", "odd", "first", "same", "number", "keep_id", "g")
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (None, "a b c d e f"), (3, " ".join(f"w{k}" for k in range(60))), (4, " ".join(f"w{k}" for k in range(61))), (3, "other"), (None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    df = plain.withColumns({n: F.lit(100 + k) for k, n in enumerate(names)})
    for drop in (exact.drop_exact, neardup.drop_near):
        want = sorted(((r["doc_id"], r["text"]) for r in drop(plain).collect()), key=repr)
        out = drop(df)
        assert out.columns == df.columns
        got = out.collect()
        assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == want
        assert all(r[n] == 100 + k for r in got for k, n in enumerate(names))


def test_quality_fit_does_not_depend_on_partitioning(spark):
    r = random.Random(8)
    docs = [(k % 6, " ".join(r.choice(["good", "fine", "well", "bad", "junk", "click"]) for _ in range(30))) for k in range(400)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(6)], "doc_id long, quality int")
    probe = "good fine junk click"
    found = {quality.learn(spark.createDataFrame(rows, "doc_id long, text string").repartition(n), labels, 4).probability(probe.encode()) for rows, n in ((docs, 1), (docs[::-1], 5))}
    assert len(found) == 1


def test_sample_of_very_many_classes(spark):
    df = spark.createDataFrame([(k, f"c{k % 1500}") for k in range(6000)] + [(1, None)], "doc_id long, lang string").withColumns({n: F.lit(1) for n in ("g", "b", "last", "row", "n")})
    got = bounded_sample(df, "lang", "doc_id", 2)
    assert got.columns == df.columns
    per = {r["lang"]: r["k"] for r in got.groupBy("lang").agg(F.count("*").alias("k")).collect()}
    assert len(per) == 1500 and all(1 <= k <= 4 for k in per.values())


def test_sentences_end_in_any_script():
    enc = tokens.Encoder(tokens.public_path("byte_bpe_50k.json"), "byte")
    texts = ["It\u2019s one. It\u2019s two! Three\nfour", "\u65e5\u672c\u3002\u8a9e\uff01 end", "plain. two", "3.5 \u20ac \U0001f600 ok", ""]
    ids, sentence, upto = enc.encode_many(texts)
    for k, t in enumerate(texts):
        own = ids[upto[k] : upto[k + 1]].tolist()
        assert own == enc.tokenizer.encode(t, add_special_tokens=False).ids
    counts = [int(sentence[upto[k] : upto[k + 1]].sum()) for k in range(len(texts))]
    assert counts == [3, 2, 1, 1, 0]
    assert enc.tokenizer.decode(ids[: np.flatnonzero(sentence)[0] + 1].tolist()) == "It\u2019s one."


def test_article_text_that_looks_like_an_aside():
    page = "<article><header><h1>T</h1><p>By me</p><p class='standfirst'>What it is about</p></header><section id='notice'><p id='search'>kept</p><h2 id='related'>also</h2></section><p class='lead share-price'>same</p><p>Energy is <math><mi>E</mi><mo>=</mo><mi>m</mi></math> always</p></article>"
    want = "T\nWhat it is about\nkept\nalso\nsame\nEnergy is E=m always"
    assert pages.main_text(page) == want and pages.main_text(page, ["same"]) == want


def test_near_copies_of_a_page_keep_their_text(spark):
    body = "".join(f"<p>Paragraph {k} of the story, long enough to be what the page is about.</p>" for k in range(6))
    rows = [(k, f"http://h/a/{k}", f"<body><p>top</p>{body}<p>Viewed {k} times</p></body>") for k in range(3)]
    got = {r["page_id"]: r["text"] for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all("Paragraph 0 of the story" in t and "Paragraph 5" in t for t in got.values())


@pytest.mark.parametrize("seed", range(2))
def test_differencing_of_a_table_equals_pairing_by_hand(spark, seed):
    """Pages without an article, all of other texts: each against the nearer of its neighbours in path order, by a plain LCS."""
    r = random.Random(seed)
    rows = []
    for host in ("a.example", "b.example"):
        menu = [f"menu {host} {k}" for k in range(8)]
        for k in range(12):
            own = [f"{host} story {k} line {i} {r.randrange(10**9)} and some more of it" for i in range(r.randint(4, 8))]
            shown = [m for m in menu if r.random() < 0.7]
            rows.append((len(rows), f"http://{host}/{r.choice(['x', 'y', 'z'])}/{k:02}", [*shown[:4], *own, *shown[4:]]))
    folders = lambda p: p.split("/")[:-1]
    path = lambda u: "/" + u.split("/", 3)[3]
    common = lambda x, y: next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905, E731
    near = lambda a, b: (common(folders(path(a)), folders(path(b))), common(path(a), path(b)))

    def shared(a, b):
        n, m = len(a), len(b)
        best = [[0] * (m + 1) for _ in range(n + 1)]
        for i in range(n - 1, -1, -1):
            for j in range(m - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        return best[0][0]

    want = {}
    for i, url, own in rows:
        host = sorted((path(u), u, k) for k, u, _ in rows if u.split("/")[2] == url.split("/")[2])
        at = host.index((path(url), url, i))
        before, after = (host[at - 1] if at else None), (host[at + 1] if at + 1 < len(host) else None)
        pick = before if after is None or (before is not None and near(url, before[1]) >= near(url, after[1])) else after
        want[i] = (own, rows[pick[2]][2])
    table = [(i, u, "<body>" + "".join(f"<div>{t}</div>" for t in own) + "</body>") for i, u, own in rows]
    got = {x["page_id"]: x["text"] for x in pages.extract_pages(spark.createDataFrame(table, "page_id long, url string, html string").repartition(5)).collect()}
    for i, (own, other) in want.items():
        kept = got[i].split("\n") if got[i] else []
        assert [t for t in own if t in set(kept)] == kept and set(own) - set(other) <= set(kept)  # in order; nothing goes that the neighbour hasn't
        assert len(own) - len(kept) == shared(own, other)


def test_pages_with_an_article_are_differenced_too(spark):
    page = lambda k: f"<nav>Home</nav><article><p>Own {k}</p><p>Quoted</p></article><footer>Imprint</footer><footer>No {k}</footer>"
    rows = [(k, f"http://h/a/{k}", page(k)) for k in range(6)] + [(8, "http://h/a/5", page(5)), (9, "http://g/a", page(9))]
    got = {r["page_id"]: r for r in pages.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()}
    assert {k: r["text"] for k, r in got.items()} == {k: f"Own {5 if k == 8 else k}\nQuoted" for k in (*range(6), 8, 9)}
    # The menu, the quotation and the imprint are in the neighbour, too; the last host has no neighbour.
    assert {k: (r["n_lines"], r["n_shared"]) for k, r in got.items()} == {k: (5, 0 if k == 9 else 3) for k in got}
