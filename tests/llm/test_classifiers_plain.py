"""What the classifiers' queries return, held against plain Python over the learned weights: no arrays, no batches."""

import math
import zlib
from itertools import combinations

import pytest

import __spark_entry__
from traceforge.llm import langid, quality, queries

SF = "/root/testdata/sf0.001"


def plain_language(model, text):
    """Counts of hashed one- to three-byte grams, every machine's margin, votes in the family and then between families' languages."""
    if not text or not any(c.isalpha() for c in text):
        return "und", 0.0
    data = " ".join(text.lower().split()).encode()
    size, counts, total = 1 << langid.BITS, {}, 0
    for n in (1, 2, 3):
        for i in range(len(data) - n + 1):
            key = 0
            for b in data[i : i + n]:
                key = (key * 257 + b) % 2**32
            at = data[i] if n == 1 else ((key * 2654435761 % 2**32) >> (32 - langid.BITS)) + (n - 1) * size
            counts[at] = counts.get(at, 0) + 1
            total += 1
    margin = {k: sum(m.weights[a] * c for a, c in counts.items()) / total + m.bias for k, m in model.machines.items()}

    def vote(names):
        if len(names) == 1:
            return names[0], 1.0
        wins, chance = dict.fromkeys(names, 0), dict.fromkeys(names, 0.0)
        for a, b in combinations(names, 2):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, model.machines[a, b].slope * margin[a, b]))))
            wins[a if p >= 0.5 else b] += 1
            chance[a] += p
            chance[b] += 1 - p
        best = sorted(names, key=lambda n: (-wins[n], -chance[n], n))[0]
        return best, chance[best] / (len(names) - 1)

    family, p = vote(sorted(model.families))
    lang, q = vote(model.families[family])
    return lang, p * q


def test_op1_against_plain_votes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs.filter(queries.remainder(4) != 2))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = __spark_entry__.queries()["op1_language_id"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        lang, score = plain_language(model, texts[r.doc_id])
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert (r.lang_pred, r.score) == (lang, pytest.approx(score, rel=1e-4, abs=1e-6)), r.doc_id


def test_op1_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.train(docs)
    assert langid.identify(docs.filter("false"), model).count() == 0
    nothing = langid.train(docs.filter("false"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, nothing).collect()} == {("und", 0.0)}
    rows = [(1, None, "xx"), (2, "", "xx"), (3, "12 %", "xx"), (4, "word " * 100_000, "xx"), (4, "word " * 100_000, None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, Lang_pred string"), model).collect()
    assert got[0].__fields__ == ["doc_id", "text", "lang_pred", "score"]
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and (got[3].lang_pred, got[3].score) == plain_close(model, "word " * 100_000) and got[3][2:] == got[4][2:]


def plain_close(model, text):
    lang, score = plain_language(model, text)
    return lang, pytest.approx(score, rel=1e-4, abs=1e-6)


def plain_quality(model, text):
    """One passage after the other through the learned weights."""
    p = {k: v.tolist() for k, v in model.p.items()}
    sigmoid = lambda z: 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    hs, attention = [], []
    for row in quality.passages(text).tolist():
        z = [max(-8.0, min(8.0, (x - m) / s)) for x, m, s in zip(row, model.mean.tolist(), model.spread.tolist())]
        h = [math.tanh(sum(a * w[j] for a, w in zip(z, p["E"])) + p["e"][j]) for j in range(len(p["e"]))]
        v = [math.tanh(sum(a * w[j] for a, w in zip(h, p["V"]))) for j in range(len(p["w"]))]
        u = [sigmoid(sum(a * w[j] for a, w in zip(h, p["U"]))) for j in range(len(p["w"]))]
        hs.append(h)
        attention.append(sum(a * b * c for a, b, c in zip(v, u, p["w"])))
    weights = [math.exp(a - max(attention)) for a in attention]
    pooled = [sum(w * h[j] for w, h in zip(weights, hs)) / sum(weights) for j in range(len(p["e"]))]
    return sigmoid(sum(a * b for a, b in zip(pooled, p["c"])) + p["d"][0])


def test_op7_against_a_plain_forward_pass(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs.filter(queries.remainder(5) != 0), spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = __spark_entry__.queries()["op7_attention_quality"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        want = plain_quality(model, texts[r.doc_id] or "")
        assert r.score == pytest.approx(want, rel=1e-6) and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_op7_odd_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    assert quality.score(docs.filter("false"), model).count() == 0
    long = "A sentence, of some kind. " * 20_000
    rows = [(1, None, 5), (2, "", 5), (3, long, 5), (3, long, None)]
    got = quality.score(spark.createDataFrame(rows, "doc_id long, text string, Score int"), model).collect()
    assert got[0].__fields__ == ["doc_id", "text", "score", "predicted"]
    assert got[0].score == got[1].score == pytest.approx(plain_quality(model, "")) and got[2].score == got[3].score == pytest.approx(plain_quality(model, long))
    assert {r.score for r in quality.score(docs, quality.train(docs, labels.filter("false"))).collect()} == {0.5}
