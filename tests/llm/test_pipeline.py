"""The pipeline, stage by stage, against brute force on a small table."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
import corpus_pipeline
from tests.llm.test_duplicates import groups
from tests.llm.test_packing import check
from tests.llm.test_search import containments
from winnow.llm import line_dedup, quality
from winnow.llm.frames import table, written

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SMALL, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = written(stage(spark, docs, SMALL), "test")
        out.append((docs, after))
        docs = after
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns_stay(stages):
    for before, after in stages[:-1]:
        assert before.columns == after.columns


def test_quality(spark, stages):
    docs, kept = stages[0]
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SMALL, "labels").collect()}
    rows = quality.labelled(docs, table(spark, SMALL, "labels"), F.lit(True), "doc_id", "text", "quality", quality.FIT_ROWS)
    scores = {r["doc_id"]: r["score"] for r in quality.score(docs, quality.fit(rows)).collect()}
    assert {i for i, _ in pairs(kept)} == {i for i, s in scores.items() if s >= 0.7}
    wrong = [i for i, q in labels.items() if (scores[i] >= 0.7) != (q == 1)]
    assert len(wrong) <= 0.05 * len(labels)


def test_lines(stages):
    docs, after = stages[1]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    spread, first = {}, {}
    for i, t, s in rows:
        for x in (t or "").split("\n"):
            spread.setdefault(x.strip(" "), set()).add(s)
            first[x.strip(" ")] = min(i, first.get(x.strip(" "), i))
    expected = {}
    for i, t, _ in rows:
        seen, kept = set(), []
        for x in t.split("\n"):
            y = x.strip(" ")
            if not y or len(spread[y]) < line_dedup.MIN_SITES or (first[y] == i and y not in seen):
                kept.append(x)
            seen.add(y)
        expected[i] = "\n".join(kept)
    assert dict(pairs(after)) == expected
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_near_copies(stages):
    docs, after = stages[2]
    later = {i for i, _, c in groups(pairs(docs), 5, 80) if c < i}
    assert later and sorted(pairs(after)) == sorted(p for p in pairs(docs) if p[0] not in later)


def test_benchmark(spark, stages):
    docs, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in table(spark, SMALL, "benchmark").collect()]
    bad = {e[0] for e in containments(pairs(docs), items, 5, 0.8)}
    assert sorted(pairs(after)) == sorted(p for p in pairs(docs) if p[0] not in bad)


def test_packing(stages):
    docs, pieces = stages[4]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = [(i, np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], np.uint32)) for i, t in pairs(docs)]
    check(pieces.collect(), expected, 4096)


def test_awkward_and_empty_tables(spark, tmp_path):
    """Nulls, empties, repeated rows and clashing columns pass every stage; an empty table gives no piece."""
    from tests.llm.messy import corpus, frame

    for name, rows in (("awkward", corpus(7)), ("empty", [])):
        folder = str(tmp_path / name)
        for other in ("labels", "benchmark"):
            table(spark, SMALL, other).write.parquet(f"{folder}/{other}.parquet")
        frame(spark, rows or corpus(7)).where("true" if rows else "false").write.parquet(f"{folder}/documents.parquet")
        docs = table(spark, folder, "documents")
        for stage, fn in corpus_pipeline.STAGES[:-1]:
            after = written(fn(spark, docs, folder), "test")
            assert after.columns == docs.columns and after.count() <= docs.count(), stage
            docs = after
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
        assert {p["doc_id"] for p in pieces} == {r["doc_id"] for r in docs.collect()}
        assert sum(p["start"] == 0 for p in pieces) >= docs.count()
        if rows:
            kept = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert docs.count() > 0 and None in kept
        else:
            assert pieces == []


def test_texts_go_to_python_in_small_batches(spark):
    """What a stage writes meets bounded batches, however long its texts are; the session's setting stays."""
    from winnow.llm import frames

    setting = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], ["bytes", "rows"])

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    found = written(texts.mapInArrow(sizes, "bytes long, rows long"), "test").collect()
    assert sum(r["rows"] for r in found) == 400
    assert max(r["bytes"] for r in found) < 2 * frames.BATCH_BYTES
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) == setting


def test_quality_sends_the_text_alone(spark):
    """One column of a row goes to Python, and rows with columns named like the stage's own come back as they were."""
    rows = table(spark, SMALL, "documents").withColumn("score", F.lit(0.0)).withColumn("row", F.col("doc_id"))
    kept = corpus_pipeline.quality_classifier(spark, rows, SMALL)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInArrow" not in plan
    assert kept.columns == rows.columns
    assert kept.exceptAll(rows).isEmpty() and not kept.isEmpty()


def test_packing_makes_its_small_tables_without_python_rows(spark, monkeypatch):
    """A table from a list of rows passes through a second set of Python workers, which keep their memory beside the first."""
    made = []
    own = type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **b: made.append(data) or own(self, data, *a, **b))
    docs = table(spark, SMALL, "documents").limit(50)
    a = corpus_pipeline.packing.pack(docs, corpus_pipeline.word_bpe, targets={"web": 0.5, "code": 0.5}).count()
    assert a > 0 and len(made) == 2 and all(isinstance(x, pa.Table) for x in made)
