"""Fingerprints, containment and licences against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tests.llm.messy import corpus, edited, frame, words
from winnow.llm import decontaminate, fingerprints, licenses

SIGN = 1 << 63


def xx(*values, seed=42):
    """Spark's xxhash64 of strings or longs."""
    h = seed
    for v in values:
        if v is None:
            continue
        h = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else (v % (1 << 64)).to_bytes(8, "little"), seed=h % (1 << 64))
    return h - (1 << 64) if h >= SIGN else h


def closed_syncmers(t):
    """{hash: first position} of the anchors of a text, from the definition."""
    h = [xx(w) for w in re.findall(r"[^ \t\n\x0B\f\r]+", t)]
    if len(h) < 4:
        return {xx(" ".join(map(str, h))) % (1 << 32): 0} if h else {}
    pair = [xx(a, b) for a, b in zip(h, h[1:])]
    found = {}
    for i in range(len(h) - 3):
        inner = pair[i : i + 3]
        if min(inner) in (inner[0], inner[2]):
            found.setdefault(xx(inner[0], inner[2]) % (1 << 32), i)
    return dict(sorted(found.items())[: fingerprints.ANCHORS])


def sketch_likeness(a, b):
    least = sorted(set(a) | set(b))[: max(len(a), len(b))]
    return 1.0 if not least else sum(x in a and x in b for x in least) / len(least)


def test_edit_study(spark):
    rows = [r for r in corpus(6) if r[0] not in (None, corpus(6)[0][0], corpus(6)[5][0])]
    got = {r["doc_id"]: r for r in fingerprints.edit_study(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    rows.sort(key=lambda r: r[0])
    for (i, t, *_), (_, nxt, *_) in zip(rows, rows[1:] + rows[:1]):
        t, nxt = t or "", nxt or ""
        changed = t[: len(t) - len(t) // 4] + nxt[: len(t) // 4]
        a, b, c = closed_syncmers(t), closed_syncmers(changed), closed_syncmers(nxt)
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest()
        assert r["fingerprint"] == " ".join(f"{h:08x}.{p:x}" for h, p in a.items())
        assert r["edited_fingerprint"] == " ".join(f"{h:08x}.{p:x}" for h, p in b.items())
        assert np.isclose(r["near_edited"], sketch_likeness(a, b)) and np.isclose(r["near_next"], sketch_likeness(a, c))


def test_a_passage_shared_by_long_texts_is_matched(spark):
    rng = random.Random(11)
    passage = words(rng, 50, 10**6)
    a, b = (f"{words(rng, n, 10**6)} {passage} {words(rng, 2000, 10**6)}" for n in (1500, 700))
    got = {r["doc_id"]: r for r in fingerprints.edit_study(frame(spark, [(1, a, "en", "a"), (2, b, "en", "a"), (3, "two words", "en", "a")])).collect()}
    x, y = closed_syncmers(a), closed_syncmers(b)
    assert len(x) > 1000 and got[1]["fingerprint"].count(" ") == len(x) - 1
    common = sorted(x[h] for h in set(x) & set(y) if y[h] - x[h] == 700 - 1500)
    assert got[1]["stretch_next"] == common[-1] - common[0] + 1 >= 40
    assert np.isclose(got[1]["shared_next"], len(set(x) & set(y)) / len(set(x) | set(y)))
    assert got[3]["stretch_next"] == 0 and got[2]["stretch_next"] == 0 and got[2]["shared_next"] == 0


def test_fingerprints_awkward(spark):
    docs = frame(spark, corpus())
    found = fingerprints.edit_study(docs).collect()
    assert len(found) == docs.count()
    assert fingerprints.edit_study(docs.where("false")).count() == 0
    alone = fingerprints.edit_study(docs.where("doc_id = 903")).collect()
    assert len(alone) == 1 and alone[0]["near_next"] == 1.0  # after the last comes the first, itself


def test_fingerprints_stay_native(spark):
    plan = fingerprints.edit_study(frame(spark, corpus()))._jdf.queryExecution().toString()
    plan += decontaminate.contained(frame(spark, corpus()), frame(spark, corpus()).select(F.col("doc_id").alias("item_id"), "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_bounds_below(spark):
    bounds = [3 * i for i in range(50)]
    got = spark.range(-5, 160).select("id", fingerprints._bounds_below(bounds, F.col("id")).alias("n")).collect()
    assert all(r["n"] == sum(b < r["id"] for b in bounds) for r in got)


def test_syncmers_do_not_depend_on_context():
    rng = random.Random(4)
    inner = words(rng, 60, 10**6)
    a = set(closed_syncmers(words(rng, 40, 10**6) + " " + inner))
    assert len(a & set(closed_syncmers(inner + " " + words(rng, 30, 10**6)))) > 20


def containments(docs, items, k, share):
    def split(t):
        return re.findall(r"[^\W_]+", (t or "").lower())

    out = set()
    for q, it in items:
        w = split(it)
        n = min(k, len(w))
        if not n:
            continue
        s = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)}
        for i, t, *_ in docs:
            v = split(t)
            both = len(s & {tuple(v[j : j + n]) for j in range(len(v) - n + 1)})
            if both >= share * len(s) - 1e-9:
                out.add((i, q, len(s), both))
    return out


def test_containment(spark):
    rng = random.Random(8)
    items = [(q, words(rng, n, 10**5)) for q, n in enumerate([1, 3, 4, 5, 6, 20, 20, 40, 60, 60])] + [(20, None), (21, ""), (22, "..."), (23, words(rng, 30, 3)), (None, words(rng, 12, 10**5))]
    rows = corpus(8)
    for i in range(80):
        body = words(rng, rng.choice([5, 100, 400]), 10**5).split()
        it = edited(rng, rng.choice(items)[1] or "x", rng.choice([0, 0, 0.01, 0.03, 0.08]))
        at = rng.randrange(len(body) + 1)
        rows.append((5000 + i, " ".join(body[:at] + [it.upper() if rng.random() < 0.3 else it] + body[at:]), "en", "a"))
    docs = frame(spark, rows)
    tests = spark.createDataFrame([(q, t, "x", "y") for q, t in items], "item_id long, text string, doc_id string, row string")
    got = decontaminate.contained(docs, tests)
    expected = containments(rows, items, 5, 0.8)
    assert len(expected) > 30
    assert {(r["doc_id"], r["item_id"], r["n_shingles"], r["matched"]) for r in got.collect()} == expected
    clean = decontaminate.clean_of(docs, tests)
    assert clean.columns == docs.columns
    bad = {(i, t) for i, t, *_ in rows if any(e[0] == i for e in containments([(i, t)], items, 5, 0.8))}
    assert sorted(str((r["doc_id"], r["text"])) for r in clean.collect()) == sorted(str((i, t)) for i, t, *_ in rows if (i, t) not in bad)
    assert decontaminate.contained(docs.where("false"), tests).count() == 0
    assert decontaminate.contained(docs, tests.where("false")).count() == 0


def test_licenses_found_and_measured(spark):
    rng = random.Random(2)
    mit, short = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0-notice"]
    changed = mit.split(" ")
    del changed[30:33]
    changed[60:60] = ["or", "so"]
    rows = [
        (1, f"{words(rng, 50)}\n{mit} {words(rng, 20)}", "en", "a"),
        (2, f"é中 {' '.join(changed).upper()}", "en", "a"),
        (3, f"{short}\n{words(rng, 9)}\n{short}", "en", "a"),
        (4, " ".join(mit.split(" ")[:40]), "en", "a"),
        (5, words(rng, 300), "en", "a"),
        (6, "all rights reserved all rights reserved " * 200, "en", "a"),
    ]
    got = licenses.scan(frame(spark, rows + corpus())).collect()
    by = {i: sorted((r["template"], round(r["coverage"], 3)) for r in got if r["doc_id"] == i) for i in range(1, 7)}
    n = len(re.findall(r"[A-Za-z0-9]+", mit))
    assert by[1] == [("MIT", 1.0)] and by[2] == [("MIT", round((n - 3) / n, 3))]
    assert by[3] == [("GPL-3.0-notice", 1.0)] * 2 and by[4] == [] and by[5] == [] and len(by[6]) == 400
    text = {r[0]: r[1] for r in rows}
    for r in got:
        found = text[r["doc_id"]][r["start"] : r["end"]]
        if r["doc_id"] in (1, 3):
            assert found == licenses.TEMPLATES[r["template"]].rstrip(".")
    assert licenses.scan(frame(spark, rows).where("false")).count() == 0
    with pytest.raises(ValueError):
        licenses.build_index({"x": "two words"})


def test_drifting_and_short_notices_are_found(spark):
    parts = licenses.TEMPLATES["GPL-3.0"].split(" ")
    third = -(-len(parts) // 3)
    drift = " ".join(x for i in range(0, len(parts), third) for x in [*parts[i : i + third], *("q1 q2 q3 q4 q5 q6".split(" "))])
    rows = [(1, drift, "en", "a"), (2, "Released under an MIT License.", "en", "a"), (3, "Released under an odd License.", "en", "a")]
    got = {(r["doc_id"], r["template"]): r["coverage"] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got == {(1, "GPL-3.0"): 1.0, (2, "MIT-notice"): 0.8}


def test_banded_alignment_is_the_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert licenses.banded(np.array(a), np.array(b), 0, 12)[0] == best[-1][-1]
