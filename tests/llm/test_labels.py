"""Language and quality: held-out accuracy, plain re-computation, awkward rows."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.messy import corpus, frame
from winnow.llm import langid, quality
from winnow.llm.queries import QUERIES
from winnow.llm.text import chunks

MIDDLE = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    found = QUERIES["op1_language_id"](spark, MIDDLE)
    truth = spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id", "lang")
    right = found.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97 and found.count() == truth.count()


def test_language_by_hand(spark):
    rows = [(i, t, la, "s") for i, (t, la) in enumerate([("the cat sat", "en"), ("the hat", "en"), ("le chat était là", "fr"), ("un chapeau", "fr"), ("x", None), (None, "en")])]
    docs = frame(spark, rows)
    model = langid.fit(docs, buckets=256)
    assert model.langs == ["en", "fr"] and np.allclose(np.exp(model.prior), [0.6 * 0 + 0.5, 0.5])
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for i, t, *_ in rows:
        if t is None:
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        (chunk,) = chunks([pa.RecordBatch.from_arrays([pa.array([t])], ["text"])])
        total = model.prior + sum(model.logp[:, b].sum(axis=1) for b, _ in langid.grams(chunk, 256))
        best = int(total.argmax())
        assert got[i]["lang_pred"] == model.langs[best]
        assert math.isclose(got[i]["score"], 1 / np.exp(total - total.max()).sum(), rel_tol=1e-9)


def plain_grams(text, buckets):
    """Buckets of all character 1-, 2- and 3-grams that hold a letter, one at a time."""
    letters = "".join((c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text)
    out = []
    for k in (1, 2, 3):
        for i in range(len(letters) - k + 1):
            gram = letters[i : i + k]
            if gram.strip(" "):
                h = k * 0x1000193
                for c in gram:
                    h = (h ^ ord(c)) * 0x9E3779B1 % 2**32
                    h ^= h >> 15
                out.append((h * 0x9E3779B1 % 2**32) >> (33 - buckets.bit_length()))
    return out


def test_language_model_from_plain_counts(spark):
    texts = [(t, la) for _, t, la, _ in corpus(5) if t is not None and la is not None and len(t) < 5000] + [("Zażółć gęślą jaźń", "pl"), ("ΑΣ 中文 x", "pl")]
    docs = frame(spark, [(i, t, la, "s") for i, (t, la) in enumerate(texts)])
    model = langid.fit(docs, buckets=512)
    langs = sorted({la for _, la in texts})
    counts = {la: [langid.ALPHA] * 512 for la in langs}
    for t, la in texts:
        for b in plain_grams(t, 512):
            counts[la][b] += 1
    assert model.langs == langs
    for i, la in enumerate(langs):
        assert np.allclose(model.logp[i], np.log(np.array(counts[la]) / sum(counts[la])))
        assert math.isclose(model.prior[i], math.log(sum(x == la for _, x in texts) / len(texts)))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    for i, (t, _) in enumerate(texts):
        total = [model.prior[j] + sum(model.logp[j][b] for b in plain_grams(t, 512)) for j in range(len(langs))]
        if any(c.isalpha() for c in t):
            assert got[i]["lang_pred"] == langs[int(np.argmax(total))]
            assert math.isclose(got[i]["score"], 1 / sum(math.exp(x - max(total)) for x in total), rel_tol=1e-6)


def test_language_awkward(spark):
    docs = frame(spark, corpus())
    found = langid.predict(docs, langid.fit(docs)).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    und = {r["doc_id"] for r in found if r["lang_pred"] == "und"}
    assert {900, 901, 902, 904, None} <= und | {None} and 903 not in und
    empty = docs.where("false")
    for none in (empty, docs.withColumn("lang", F.lit(None).cast("string"))):
        got = langid.predict(docs, langid.fit(none)).collect()
        assert len(got) == docs.count() and {(r["lang_pred"], r["score"]) for r in got} == {("und", 0.0)}
    with pytest.raises(ValueError):
        langid.fit(docs, buckets=1 << 23)
    assert langid.predict(empty, langid.fit(docs)).count() == 0


def test_quality_held_out(spark):
    found = QUERIES["op2_quality_knn"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").where("held_out")
    assert found.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_votes_by_hand():
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(40, 5))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    labels = rng.integers(0, 2, 40).astype(float)
    model = quality.Model(None, None, vectors, labels, 0.5)
    points = np.vstack([vectors[:7], np.zeros((1, 5))])
    got = quality.vote(points, model, voters=6, block=3)
    for p, g in zip(points, got):
        s = vectors @ p
        near = np.argsort(-s)[:6]
        w = np.maximum(s[near], 0) ** quality.SHARPNESS
        assert np.isclose(g, (w * labels[near]).sum() / w.sum() if w.sum() > 1e-9 else 0.5)


def test_quality_awkward(spark):
    docs = frame(spark, corpus())
    labels = spark.createDataFrame([(1, 1), (4, 0), (7, 1), (7, 0), (10, None), (None, 1), (13, 0), (16, 1)], "doc_id long, quality int")
    rows = quality.labelled(docs, labels, F.lit(True), "doc_id", "text", "quality", 100)
    assert {r["k"] for r in rows.collect()} == {1, 4, 13, 16}
    model = quality.fit(rows)
    found = quality.score(docs, model).collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    assert quality.score(docs.where("false"), model).count() == 0
    unlearned = quality.fit(rows.where("false"))
    assert {r["score"] for r in quality.score(docs, unlearned).collect()} == {0.5}
