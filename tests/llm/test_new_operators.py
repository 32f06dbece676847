"""Whitening, sharding and fill-in-middle against brute force, with the cases that tables may hold."""

import hashlib
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from traceforge.llm import fim, html, sharding, simhash, whitening

SF = "/root/testdata/sf0.001"


def brute_whitening(rows, most=16):
    """rows: id -> entries. Plain NumPy in whole numbers, without tiles."""
    x = {i: np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000 for i, v in rows.items()}
    fit = np.unique(np.array(list(x.values())), axis=0)
    n, s = len(fit), fit.sum(0)
    c = (n * fit - s) / n
    v = c.T @ c / n
    e, w = np.linalg.eigh(v)
    top = [k for k in np.argsort(-e)[:most] if e[k] > 1e-9 * e.max()]
    white = {i: ((n * a - s) / n) @ w[:, top] / np.sqrt(e[top]) for i, a in x.items()}
    return n, {i: int(((n * a - s).astype(object) ** 2).sum()) for i, a in x.items()}, white, e[top] / np.trace(v)


def same_whitening(got, rows, most=16):
    n, deviation, white, shares = brute_whitening(rows, most)
    k = len(shares)
    found = {(r["vec_id"], r["component"]): r for r in got}
    assert len(found) == len(got) == len(rows) * k
    sign = np.array([np.sign(sum(found[i, c + 1]["whitened"] * white[i][c] for i in rows)) for c in range(k)])
    for i in rows:
        for c in range(k):
            r = found[i, c + 1]
            assert (r["n"], r["deviation"]) == (n, deviation[i])
            assert r["whitened"] == pytest.approx(sign[c] * white[i][c], abs=1e-7)
            assert r["explained"] == pytest.approx(shares[c], rel=1e-9)
            assert 0 <= r["identity_error"] < 1e-9


def test_whitening_against_plain_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = {r["vec_id"]: r["embedding"] for r in table.collect()}
    same_whitening(__spark_entry__.queries()["op11_tiled_whitening"](spark, SF).collect(), rows)


def test_whitening_cases(spark):
    rng = np.random.default_rng(3)
    good = {i: rng.normal(size=5).round(3).tolist() for i in range(40)}
    good |= {100 + i: good[0] for i in range(60)}  # a hot vector counts once
    bad = [(200, None), (201, []), (202, [1.0, None, 0.0, 0.0, 0.0]), (203, [1.0, float("nan"), 0.0, 0.0, 0.0]), (204, [1.0, float("inf"), 0.0, 0.0, 0.0]), (205, [1.0, 2.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in [*good.items(), *bad]], "vec_id long, embedding array<double>, component int").repartition(7)
    same_whitening(whitening.components_of(df, most=3).collect(), good, 3)
    # any tile width, and rows cut into any row-blocks, give the same covariance
    fit = whitening.packed(df, 5).select("v").distinct().select(F.monotonically_increasing_id().alias("row"), "v").cache()
    n, sums = whitening.sums_of(fit, 5)
    plain = np.cov(np.unique([np.floor(64 * np.array(v)) for v in good.values()], axis=0).T, bias=True)
    for width, rows in ((1, 7), (2, 3), (5, 1000), (64, 1)):
        assert whitening.covariance(fit, n, sums, width, rows) == pytest.approx(plain, rel=1e-12)
    # no rows, one vector only (no variance), constant dimensions, null and repeated ids
    assert whitening.components_of(df.filter("false")).collect() == []
    assert whitening.components_of(df.filter("vec_id >= 100 AND vec_id < 200")).collect() == []
    line = spark.createDataFrame([(None, [1.0, 2.0, 5.0]), (7, [2.0, 4.0, 5.0]), (7, [4.0, 8.0, 5.0])], "vec_id long, embedding array<float>")
    got = whitening.components_of(line).collect()
    assert sorted((r["vec_id"] or 0, r["component"], r["n"]) for r in got) == [(0, 1, 3), (7, 1, 3), (7, 1, 3)]
    assert got[0]["explained"] == pytest.approx(1.0)


def test_whitening_of_large_entries_stays_exact(spark):
    rows = {i: [float(i) * 2**40, -float(i % 3)] for i in range(9)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<double>")
    model = whitening.fit_whitening(df)
    x = {i: [int(64 * c) + 1_000_000 for c in v] for i, v in rows.items()}
    sums = [sum(v[k] for v in x.values()) for k in range(2)]
    assert (model.n, model.sums) == (9, sums)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whitened(df, model).collect()}
    assert got == {i: sum((9 * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    assert {r["vec_id"]: r["deviation"] for r in whitening.components_of(df).collect()}[0] is None  # beyond 64 bits
    far = spark.createDataFrame([(0, [1e300]), (1, [0.0])], "vec_id long, embedding array<double>")
    assert whitening.fit_whitening(far).sums == [2**52 + 2_000_000]


def check_shards(rows, shards):
    """Counts at most one apart, slots gapless, every source in every shard in its share (at most one off at either cut)."""
    n = len(rows)
    counts = [sum(r["shard"] == k for r in rows) for k in range(shards)]
    assert sum(counts) == n and max(counts) - min(counts) <= 1
    for k in range(shards):
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(counts[k]))
    sources = {r["source"] for r in rows}
    for s in sources:
        each = [sum(r["source"] == s and r["shard"] == k for r in rows) for k in range(shards)]
        assert all(abs(Fraction(sum(each), n) * counts[k] - each[k]) <= 2 for k in range(shards)), (s, each)


def brute_shards(rows, shards, seed=42):
    key = lambda r: (hashlib.sha256(f"{seed}:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest(), zlib.crc32((r["text"] or "").encode()), len((r["text"] or "").encode()))
    order = []
    for s in {r["source"] for r in rows}:
        own = sorted((r for r in rows if r["source"] == s), key=key)
        order += [((2 * i + 1) / (2 * len(own)), key(r), r["doc_id"]) for i, r in enumerate(own)]
    order.sort(key=lambda x: x[:2])
    n = len(order)
    place = [g * shards // n for g in range(n)]
    return sorted((d, place[g], g - place.index(place[g])) for g, (_, _, d) in enumerate(order))


def test_shards_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    got = sharding.assign(docs, keep=["doc_id", "source"]).collect()
    check_shards(got, 24)
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in got) == brute_shards(rows, 24)
    size = {r["doc_id"]: (len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode())) for r in rows}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in got} == size
    assert {(r["law"], r["grown_shard"]) for r in got} == {("rows", None)}
    assert sharding.assign(docs.repartition(9), seed=7).select("doc_id", "shard", "slot").exceptAll(sharding.assign(docs, seed=7).select("doc_id", "shard", "slot")).isEmpty()


def test_shard_cases(spark, tmp_path):
    rows = [(i, f"text {i}", "hot" if i % 3 else None if i % 2 else "a", 5) for i in range(500)]
    rows += [(None, None, "b", 1)] * 40 + [(3, "same", "hot", 2)] * 90 + [(1000, "", "b", 1), (1001, "naïve 😀", "b", 1), (1002, "x" * 300_000, "b", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Slot int").repartition(5)
    got = sharding.assign(df, 10)
    assert got.columns == ["doc_id", "text", "source", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    got = got.collect()
    check_shards(got, 10)
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got)) == sorted((i is None, i or 0, t or "") for i, t, _, _ in rows)
    by = {r["doc_id"]: r["size"] for r in got}
    assert (by[1000], by[1001], by[1002], by[None]) == (8, 8 + len("naïve 😀".encode()), 300_008, 8)
    few = sharding.assign(df.limit(3), 24).collect()
    assert sorted(r["slot"] for r in few) == [0, 0, 0] and len({r["shard"] for r in few}) == 3
    assert sharding.assign(df.filter("false")).collect() == []
    with pytest.raises(ValueError):
        sharding.assign(df, 0)
    sharding.write_shards(sharding.assign(df, 4), f"{tmp_path}/shards", 4, files_per_shard=2)
    back = spark.read.parquet(f"{tmp_path}/shards")
    assert back.count() == len(rows) and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
    assert all(len(list((tmp_path / "shards" / f"shard={k}").glob("*.parquet"))) == 2 for k in range(4))


def brute_fim(key, text, seed=42):
    """With a list of all units, as the contract states it."""
    text = text or ""
    found = re.findall(fim.UNIT, text)
    n = len(found)
    d = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[8 * i : 8 * i + 8], 16) for i in range(4))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(found[:i]), "".join(found[i:j]), "".join(found[j:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), "<S>" + s + "<P>" + p + "<M>" + m
    return n, "psm", len(p), len(m), "<P>" + p + "<S>" + s + "<M>" + m


def test_fill_in_middle_against_lists(spark):
    odd = ["", None, "   ", " \t\n x ", " a b", "<P>", "a <S> b", "x<", "a <P b <M c", "😀 naïve  \r\n", "\x0b\x0c", "word " * 60_000, "x" * 200_000, " " * 200_000 + "y" + " " * 1000, "<" * 50 + " <P<S<M " * 9]
    rows = [(i, t, "keep") for i in range(0, 60) for t in odd] + [(None, t, "nul") for t in odd]
    df = spark.createDataFrame(rows, "doc_id long, text string, Form string")
    out = fim.transform(df)
    assert out.columns == ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        key = "" if r["doc_id"] is None else r["doc_id"]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == brute_fim(key, r["text"])
        assert r["back"] == (r["text"] or "")
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}
    assert fim.transform(df.filter("false")).collect() == []
    every = fim.transform(df, cut_percent=100, spm_percent=0, keep=["doc_id"])
    assert every.columns[0] == "doc_id" and every.filter("form = 'spm'").isEmpty()
    assert fim.transform(df.drop("doc_id").withColumn("doc_id", F.lit("a:7")), seed=1).select("doc_id").distinct().count() == 1


def test_second_pass_is_lazy():
    pattern = re.compile(fim.UNIT)
    text = "a b c d e "
    n = fim.units(text, pattern)
    found = [m.end() for m in pattern.finditer(text)]
    assert n == len(found) == 6
    for i in range(n + 1):
        for j in range(i, n + 1):
            assert fim.ends(text, pattern, i, j) == (found[i - 1] if i else 0, found[j - 1] if j else 0)


def test_fill_in_middle_query(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    for r in __spark_entry__.queries()["op13_fill_in_middle"](spark, SF).collect():
        n, form, p, m, output = brute_fim(r["doc_id"], docs[r["doc_id"]])
        assert tuple(r)[1:] == (n, form, p, m, sha(output), sha(docs[r["doc_id"]] or ""))


def texts(spark, pages):
    rows = [(k, "http://h.example/", p) for k, p in enumerate(pages)]
    return [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_bars_do_not_reach_into_the_article(spark):
    words = [f"First sentence {k} of this page. Another one {k * k}." for k in range(4)]
    for around in (
        '<div class="layout with-sidebar"><article><p>{0}</p></article><div class="sidebar"><p>Side</p></div></div>', "<form action=/x><article><p>{0}</p></article><input name=q></form>",
        '<div class="page-container has-nav"><nav>Menu</nav><main><p>{0}</p></main></div>', '<form><div class="site with-toolbar"><main><p>{0}</p></main></div></form>',
    ):
        assert texts(spark, [f"<html><body>{around.format(w)}</body></html>" for w in words]) == words
    head = "<body><header><h1>Site</h1></header><article><header><h1>About {0}</h1></header><p>{1}</p><footer>Posted</footer></article></body>"
    assert texts(spark, [head.format(k, w) for k, w in enumerate(words)]) == [f"About {k}\n{w}" for k, w in enumerate(words)]
    # a header without a heading, readers' comments, related cards and a sidebar of its own stay out, articles or not
    out = '<body><article><header>By someone</header><p>{0}</p></article><div class="comments"><article><p>Nice {0}</p></article></div><div class="sidebar"><article><p>Card {0}</p></article></div><aside class="page with-cards"><article><p>More {0}</p></article></aside><form class="comment-form layout"><main>Reply {0}</main></form></body>'
    assert texts(spark, [out.format(w) for w in words]) == words


def test_paths_are_places_in_document_order():
    page = html.Page("<body><div><p>a</p><ul><li>b</li></ul></div><p>c</p>d<table><tr><td>e</td></tr></table></body>")
    tree = dict(html.nodes_by_path(html.read_shape(page.shape)))
    assert [(tree[p].tag, t) for p, t, _ in page.out] == [("p", "a"), ("li", "b"), ("p", "c"), ("body", "d"), ("td", "e")]


def test_deep_pages_need_memory_for_their_nodes_only():
    import tracemalloc

    tracemalloc.start()
    page = html.Page("<div>x" * 50_000)
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert len(page.out) == 50_000 and peak < 60 << 20


def test_op2_counts_all_fingerprints_within_the_radius(spark):
    got = __spark_entry__.queries()["op2_simhash"](spark, SF).collect()
    prints = {r.doc_id: int(r.fingerprint, 16) for r in got}
    assert len(prints) == len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in got:
        want = sum((prints[r.doc_id] ^ p).bit_count() <= 3 for p in prints.values()) - 1 if r.doc_id % 100 == 0 else None
        assert r.n_within == want
    # bits at the borders of blocks, classes of equal prints, radius 0
    rows = [(k, v, w) for k, (v, w) in enumerate([(0, 0), (0, 0), (0, 1), (7, 0), (15, 0), (-1, -1), (-1, -8), (1 << 62, 3), (1 << 20, 1 << 41), (0, 0)])]
    df = spark.createDataFrame(rows, "doc_id long, fa long, fb long")
    apart = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(a[1:], b[1:]))
    for radius, blocks in ((3, 6), (0, 1), (1, 3), (2, 7)):
        found = {r.doc_id: r.n_within for r in simhash.count_within(df, F.col("doc_id") >= 0, radius, blocks).collect()}
        assert found == {a[0]: sum(apart(a, b) <= radius for b in rows) - 1 for a in rows}, (radius, blocks)
    assert simhash.count_within(df.filter("false"), F.lit(True)).count() == 0
