"""Each operator against brute force, the library or held-out labels, and on nulls, empty texts, repeats and empty tables."""

import base64
import collections
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from traceforge.llm import _tokens, ann, bpe, html, langid, minhash, packing, ppm, quality, queries, simhash, tokencount

SF = "/root/testdata/sf0.001"
JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
LIBRARY = Tokenizer.from_file(JSON)
ODD = ["", " ", "  ", " a  b\n \n c   ", "x<|endoftext|>y <|endof", "don't we'll\t\tz", "日本語 テキスト🙂", "a" * 3000, "foo\n ", "   foo", "\x1c \x85 　x", "1234 56\r\n\r\n  7"]
_rnd = random.Random(3)
ODD += ["".join(_rnd.choice(" \n\tab.é1'<|endoftext|>s") for _ in range(_rnd.randint(0, 50))) for _ in range(300)]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, SCORE double, ids string, row int, bin int"


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty, repeated rows, a null id, a long text without spaces, and columns that clash with added ones."""
    rows = [(1, None), (2, ""), (3, "a b c d e f g"), (3, "a b c d e f g"), (None, "a b c d e f g"), (5, "é" * 20000), (6, "A b  c D e F g"), (7, "\n\t "), (8, "word")]
    return spark.createDataFrame([(i, t, None, None, None, 1.0, "x", 1, 1) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def as_bytes(ids):
    return np.array(ids, "<u4").tobytes()


def test_cached_encoder_gives_the_librarys_ids():
    assert _tokens.library_encoder(JSON, limit=50).encode(ODD) == [as_bytes(ids_of(t)) for t in ODD]


def test_replay_gives_tiktokens_ids_and_decodes():
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}, special_tokens={})
    enc = bpe.ReplayEncoder(_tokens.read_ranks(RANKS), limit=100)
    for _ in range(2):
        got = enc.encode(ODD)
        assert got == [as_bytes(own.encode_ordinary(t)) for t in ODD]
    assert [enc.decode(b) for b in got] == [t.encode() for t in ODD]


def test_replay_of_ranks_that_fall_out_of_order():
    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 256, b"abc": 300, b"ab": 400, b"cd": 280, b"bcd": 260}
    one = tiktoken.Encoding("own", pat_str=r"[a-z]+", mergeable_ranks=ranks, special_tokens={})
    words = ["".join(_rnd.choice("abcd") for _ in range(_rnd.randint(1, 12))) for _ in range(300)]
    assert [np.frombuffer(b, "<u4").tolist() for b in bpe.MergeReplay(ranks).encode([w.encode() for w in words])] == [one.encode_ordinary(w) for w in words]


@pytest.mark.parametrize("chunk,overlap", [(40, 4), (97, 16)])
def test_chunks_are_spliced_without_a_trace(chunk, overlap):
    for t in ODD:
        assert tokencount.count_by_chunks(LIBRARY, t * 9, chunk, overlap, collect=True) == ids_of(t * 9)


def test_chunks_of_cached_pieces_give_the_librarys_ids():
    """Chunks that are plain never go to the library; those with special strings or unsafe white space do."""
    enc = _tokens.library_encoder(JSON)
    for t in ODD:
        for text in (t * 9, "plain words, as most are. " * 7 + t * 3 + " and more of them\nin lines " * 9):
            for chunk, overlap in ((40, 8), (97, 30), (500, 64)):
                assert tokencount.count_by_chunks(LIBRARY, text, chunk, overlap, collect=True, pieces=enc) == ids_of(text)

    class Refused:
        def encode(self, *args, **kwargs):
            raise AssertionError("a plain chunk went to the library")

    text = "".join(f"word{k} of line {k % 7},\n" if k % 5 else f"don't {k} " for k in range(20000))
    assert tokencount.count_by_chunks(Refused(), text, pieces=enc) == len(ids_of(text))


def test_token_counts_on_edges(edge):
    got = tokencount.token_counts(edge, JSON, limit=4, huge=1000, chunk=500, overlap=20).collect()
    for r in got:
        t = r.text or ""
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), len(ids_of(t)), len(ids_of(t)) > 4)
    assert len(got) == edge.count() and tokencount.token_counts(edge.filter("false"), JSON).count() == 0


def test_bpe_query_on_edges(edge):
    got = bpe.encode_decode(edge, RANKS).collect()
    assert all(r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest() and len(r.ids) == r.n_tokens for r in got) and len(got) == edge.count()


def test_packing_is_whole_and_gapless(spark, documents, edge):
    for docs in (documents.limit(150), edge):
        rows = packing.pack_documents(docs, JSON, cap=256).collect()
        want = collections.Counter()
        for r in docs.collect():
            ids = ids_of(r.text or "") + [0]
            want.update((r.doc_id, k, s, n, zlib.crc32(as_bytes(ids[s : s + n]))) for k, (s, n) in enumerate(packing.cut(len(ids), 256)))
        assert want == collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
        for b in bins.values():
            at = 0
            for o, n in sorted(b):
                assert o == at
                at += n
            assert at <= 256
        assert len(bins) <= 1.02 * sum(r.length for r in rows) / 256 + 2
    assert packing.pack_documents(edge.filter("false"), JSON).count() == 0


def test_packing_levels_lose_nothing(spark):
    pieces = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.col("id") * 37 % 100 + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    rows = packing.pack(pieces, cap=128, rows_per_task=100, fan_in=3).collect()
    fill = collections.Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert len({r.doc_id for r in rows}) == len(rows) == 3000 and max(fill.values()) <= 128
    assert len(fill) <= 1.05 * sum(fill.values()) / 128


def test_packing_pieces_of_over_half_never_meet_in_one_task(spark, monkeypatch):
    tasks = []
    level = packing._level
    monkeypatch.setattr(packing, "_level", lambda k, *rest: tasks.append((k, *rest)) or level(k, *rest))
    pieces = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(66).cast("long").alias("length"), F.lit(0).cast("long").alias("ids_crc32"))
    rows = packing.pack(pieces, cap=129, rows_per_task=200, fan_in=8).collect()
    assert len({r.sequence_id for r in rows}) == len(rows) == 2000
    # the third level is where pieces of over half are closed: it isn't the single last task
    assert not any(last for k, _, _, last in tasks if k <= 3)
    with pytest.raises(ValueError):
        packing.pack(pieces, rows_per_task=1)


def test_language_on_held_out_rows(spark, documents):
    got = {r.doc_id: r for r in queries.op1_language_id(spark, SF).collect()}
    rows = [r for r in documents.collect() if got[r.doc_id].held_out]
    assert sum(got[r.doc_id].lang_pred == r.lang for r in rows) >= 0.97 * len(rows)


def test_language_on_edges(spark, edge):
    model = langid.fit(["the of and", "der die das"] * 5, ["en", "de"] * 5)
    got = {r.doc_id: r for r in langid.identify(edge, model).collect()}
    assert got[1].lang_pred == got[2].lang_pred == got[7].lang_pred == "und" and 0 <= got[3].score <= 1
    assert {r.lang_pred for r in langid.identify(edge, langid.train(edge)).collect()} == {"und"}


def test_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    y = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = [(r.score, y[r.doc_id], r.predicted) for r in queries.op7_attention_quality(spark, sf).collect() if r.held_out and r.doc_id in y]
    good, bad = [s for s, v, _ in got if v], [s for s, v, _ in got if not v]
    assert np.mean([g > b for g in good for b in bad]) > 0.95


def test_quality_on_edges(spark, edge):
    none = quality.fit([], [])
    assert [r.predicted for r in quality.score(edge, none).collect()] == [1] * edge.count()
    labels = spark.createDataFrame([(3, 1), (8, 0), (None, 1), (5, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.score(edge, quality.train(edge, labels)).collect())


def test_simhash_against_plain_python(spark, documents):
    rows = sorted(documents.collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in simhash.with_edited(documents, rows_per_range=7).collect()}
    same = {}
    for k, r in enumerate(rows):
        nxt, n = rows[(k + 1) % len(rows)], len(r.text)
        edited = r.text[: n - n // 2] + nxt.text[: n // 2]
        g = got[r.doc_id]
        assert g.n_chars == n and g.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert g.near_next == 1 - (int(g.fingerprint, 16) ^ int(got[nxt.doc_id].fingerprint, 16)).bit_count() / 128
        assert same.setdefault(r.text, g.fingerprint) == g.fingerprint
    assert np.mean([g.near_edited > g.near_next for g in got.values()]) > 0.95


def test_simhash_on_edges_and_block_tables(spark, edge):
    assert simhash.with_edited(edge).count() == edge.count() and simhash.with_edited(edge.filter("false")).count() == 0
    a = [_rnd.getrandbits(60) for _ in range(40)]
    fps = spark.createDataFrame([(k, x ^ (1 << _rnd.randint(0, 40)) if k % 2 else x, 5) for k, x in enumerate(a + a)], "doc_id long, fa long, fb long")
    rows = fps.collect()
    want = {(p.doc_id, q.doc_id) for p in rows for q in rows if p.doc_id != q.doc_id and (p.fa ^ q.fa).bit_count() + (p.fb ^ q.fb).bit_count() <= 2}
    assert {(r.query_id, r.doc_id) for r in simhash.within(fps, fps, 2, 5).collect()} == want


def test_neighbours_against_all_pairs(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    ids, x = zip(*[(r.vec_id, r.embedding) for r in v.collect()])
    x = np.array(x, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(set)
    for r in queries.op3_additive_neighbours(spark, SF).collect():
        got[r.query_id].add(r.vec_id)
    hits = []
    for k, i in enumerate(ids):
        if i % 50 == 0:
            s = x @ x[k]
            s[k] = -2
            hits.append(len(got[i] & {ids[j] for j in np.lexsort((ids, -s))[:5]}) / 5)
    assert len(hits) == len(got) and np.mean(hits) >= 0.9


def test_neighbours_on_edges(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [1.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.rank, r.vec_id, r.score) for r in ann.search(v, v.filter("vec_id = 0")).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
    assert ann.search(v.filter("false"), v).count() == 0


def shingles(text):
    w = text.encode().lower().split() if text.isascii() else [x for x in bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()).split()]
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_near_duplicates_against_all_pairs(spark, documents):
    base = [r.text for r in documents.limit(60).collect()]
    rows = []
    for k in range(300):
        w = base[k % 60].split(" ")
        for _ in range(k // 60 * 2):
            w[_rnd.randrange(len(w))] = f"new{_rnd.random()}"
        rows.append((1000 - k, " ".join(w)))
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "ONE two"), (5003, "ONE two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingles(t or "") for i, t in rows}
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 85 * len(a | b):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_near_duplicates_on_edges(edge):
    assert minhash.near_duplicates(edge).count() == edge.count() and minhash.near_duplicates(edge.filter("false")).count() == 0
    left = minhash.deduplicated(edge)
    # the null id's text is a copy of 3's
    assert left.columns == edge.columns and sorted(r.doc_id or 0 for r in left.collect()) == [1, 2, 3, 5, 7, 8]


def brute_ppm(train, text, order):
    """PPM by its definition: counts of all contexts, escape method C, symbols of longer contexts excluded."""
    counts = collections.defaultdict(collections.Counter)
    for t in train:
        b = bytes([ppm.START] * order) + t.encode() + bytes([ppm.END])
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[b[i - k : i]][b[i]] += 1
    out, b = 0.0, bytes([ppm.START] * order) + text.encode() + bytes([ppm.END])
    for i in range(order, len(b)):
        gone, p = set(), 1.0
        for k in range(order, -1, -1):
            seen = {s: n for s, n in counts[b[i - k : i]].items() if s not in gone} if b[i - k : i] in counts else {}
            n, d = sum(seen.values()), len(seen)
            if b[i] in seen:
                p *= seen[b[i]] / (n + d)
                break
            if d:
                p *= d / (n + d)
                gone |= seen.keys()
        else:
            p /= ppm.SYMBOLS - len(gone)
        out += math.log10(p)
    return out


def test_ppm_against_its_definition(spark, edge):
    rows = [(k, "".join(_rnd.choice("aab cé") for _ in range(_rnd.randint(0, 40)))) for k in range(30)] + [(40, None), (41, "zzz ab"), (42, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    train = [t or "" for i, t in rows if i % 3]
    c = collections.Counter(w for t in train for w in t.lower().split())
    n, v = sum(c.values()) + len(train), len(c) + 1
    # the second time every block holds a few texts, and the longest ones are longer than a block
    for r in ppm.score(docs, F.col("doc_id") % 3 != 0).collect() + ppm.score(docs, F.col("doc_id") % 3 != 0, block_bytes=25).collect():
        t = dict(rows)[r.doc_id] or ""
        assert math.isclose(r.score, brute_ppm(train, t, ppm.ORDER), rel_tol=1e-9)
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t.lower().split()) + math.log10((len(train) + 1) / (n + v + 1))
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.train_tokens == n and r.n_known == 1 + sum(w in c for w in t.lower().split())
    assert ppm.score(edge, F.col("doc_id") > 1).count() == edge.count() and ppm.score(edge.filter("false"), F.lit(True)).count() == 0
    assert all(math.isfinite(r.score) for r in ppm.score(edge, F.lit(False)).collect())


PAGE = """<!DOCTYPE html><html><head><title>t{n}</title><style>p{{}}</style></head><body><nav><a href=/>Home</a></nav><div class="notice">Sale</div>
<div id=content><h1>Head &amp; {n}</h1><p>First   text {n} <b>bold</b><p>Second {n}<br>line<ul><li>item {n}</ul><p>Same line</div><form><p>Name</p></form>
<aside>side {n}</aside><section class="comments"><p>me too {n}</p></section><script>var a = "<p>no</p>";</script><footer>&copy; {n}</footer>"""


def test_html_against_hand_made_text(spark):
    rows = [(n, f"http://a.com/{n}", PAGE.format(n=n), n) for n in range(6)] + [(7, None, None, 0), (8, "http://b.com", "", 0), (9, "http://c.com", "plain <text", 0), (10, "http://c.com", "<p>1 &lt; 2</p>", 0)]
    got = {r.page_id: r for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string, host int")).collect()}
    assert got[2].text.split("\n")[:4] == ["Head & 2", "First text 2 bold", "Second 2 line", "item 2"] and "me too" not in got[2].text and "Sale" not in got[2].text
    assert (got[7].text, got[8].text, got[10].text) == ("", "", "1 < 2") and got[7].n_chars == 0
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_html_compares_texts_over_shapes(spark):
    extra = ["<h2>head {n}</h2>", "<ul><li>item {n}</ul>", "<table><tr><td>cell {n}</table>"]
    rows = [(n, f"http://a.com/{n}", f"<div id=top><p>Same on all</p></div><div id=content><h1>Head {n}</h1>{extra[n].format(n=n)}<blockquote>words of page {n}</blockquote></div>") for n in range(3)]
    got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {n: [f"Head {n}", f"{('head', 'item', 'cell')[n]} {n}", f"words of page {n}"] for n in range(3)}
    again = [(n, f"http://a.com/{n}", "<div><p>Same on all</p>" + extra[n % 3].format(n=n) + "</div>") for n in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(again, "page_id long, url string, html string")).collect()}
    assert got == {n: f"{('head', 'item', 'cell')[n % 3]} {n}" for n in range(9)}


def test_html_keeps_headings_of_near_copies_and_deep_pages(spark):
    frame = "<nav><p>Home</p></nav><article><h1>{h}</h1><p>Long words of the article number {a} that go on for a while.</p><p>{t}</p></article><footer><p>Same foot</p></footer>"
    rows = [(1, "http://a.com", frame.format(h="One", a=1, t="first")), (2, "http://a.com", frame.format(h="One", a=1, t="edited")), (3, "http://a.com", frame.format(h="Two", a=2, t="third"))]
    deep = "<div>" * 5000 + "<p>down here</p>" + "</div>" * 5000
    rows += [(4, None, deep), (5, None, deep.replace("here", "there"))]
    got = {r.page_id: r.text.split("\n") for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[n][0] for n in (1, 2, 3)] == ["One", "One", "Two"] and [got[n][2] for n in (1, 2, 3)] == ["first", "edited", "third"]
    assert got[4] == ["down here"] and got[5] == ["down there"]


def test_html_labels_tell_all_words(spark):
    many = "auto bg block border flex gray h hidden lg m mt overflow p"
    assert html.Node(html.label_of("div", f' class="{many} sidebar"')).barred and not html.Node(html.label_of("div", f' class="{many} w"')).barred
    assert "main" in html.label_of("div", ' class="a b c d e f g h i j k l m" id="main"').split(".")[1:]
    assert html.label_of("div", f' class="{many} x"') != html.label_of("div", f' class="{many} y"') and html.label_of("p", ' class="b a"') == "p.a.b"
    side = "sidebar hidden lg:block w-64 flex-shrink-0 border-r border-gray-200 bg-white overflow-y-auto px-4 py-6"
    rows = [(n, "http://a.com/", f'<div class="{side}"><p>aside {n}</div><div><p>words {n} <span class="{side}">inline {n}</span></div>') for n in range(3)]
    assert [r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()] == [f"words {n}" for n in range(3)]


def test_html_template_is_written_and_read_again():
    for shape in ("", "(a,)", "(a(b,c(d,)e,)f,)"):
        assert html.write_shape(html.read_shape(shape)) == shape


def test_tree_matching_counts_the_largest_match():
    a, b = html.read_shape("(a(b,c(d,)e,))"), html.read_shape("(a(c(d,x,)e,))")
    assert html.match(a, b, {}) == 5  # the root, a, c, d, e
    html.align(a, b)
    assert [n.label for _, n in html.nodes_by_path(a)].count("x") == 1


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, SF)
        assert left.columns == docs.columns and 0 < left.count() <= docs.count(), name
        docs = left
