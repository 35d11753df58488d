"""Line spread, unit dedup, Jaccard groups and repeated strings against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import pytest

from tests.llm.messy import corpus, frame
from winnow.llm import jaccard_join, line_dedup, suffix_dedup, unit_dedup
from winnow.llm.frames import components

LAST = (1 << 63) - 1


def lines_corpus():
    rng = random.Random(3)
    common = [f"line {i} stands often" for i in range(12)]
    rows = []
    for i in range(80):
        body = [rng.choice(common) if rng.random() < 0.3 else f"own {rng.random()}" for _ in range(rng.randrange(6))]
        rows.append((rng.randrange(60), "\n".join(body) + rng.choice(["", "\n", " "]), "en", rng.choice("abcdefgh")))
    return rows + [(70, None, None, None), (71, "", None, "a"), (None, common[0], "en", None), (72, f"  {common[1]} \n{common[1]}", "en", "a"), rows[0], rows[0]]


def test_line_spread(spark):
    rows = lines_corpus()
    docs = frame(spark, rows)
    for sites in (2, 5, 9):
        spread, first = defaultdict(set), {}
        for i, t, _, s in rows:
            for line in (t or "").split("\n"):
                if line.strip(" "):
                    spread[line.strip(" ")].add(s)
                    first[line.strip(" ")] = min(first.get(line.strip(" "), LAST), LAST if i is None else i)
        expected = []
        for i, t, _, _ in rows:
            if t is None:
                expected.append((i, None, 0, 0))
                continue
            kept, seen = [], set()
            for line in t.split("\n"):
                x = line.strip(" ")
                wide = x and len(spread[x]) >= sites
                if not wide or (first[x] == (LAST if i is None else i) and x not in seen):
                    kept.append(line)
                seen.add(x)
            expected.append((i, "\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept)))
        got = line_dedup.remove_boilerplate(docs, min_sites=sites)
        assert got.columns == [*docs.columns, "n_lines", "n_removed"]
        key = lambda r: tuple(str(x) for x in r)
        assert sorted((tuple(r) for r in got.select("doc_id", "text", "n_lines", "n_removed").collect()), key=key) == sorted(expected, key=key)
    assert line_dedup.remove_boilerplate(docs.where("false")).count() == 0


def test_near_threshold_lines_are_counted_exactly(spark):
    rows = [(i, f"x {n}", "en", f"s{i}") for n in (95, 99, 100, 101, 110) for i in range(n)]
    lines = line_dedup.lines_of(frame(spark, rows, clashing=False), "doc_id", "text", "source")
    found = line_dedup.boilerplate(lines, min_sites=100, log_k=4, band=2.0).count()  # a poor sketch, so all are counted
    assert found == 3


def units(t, min_words):
    for m in re.finditer(r"(?:[^\n.!?]|[.!?](?!\s))+(?:[.!?]+(?=\s|$))?", t):
        w = re.findall(r"[a-z0-9]+", m.group().lower())
        if len(w) >= min_words:
            yield tuple(w)


def test_unit_dedup(spark):
    rng = random.Random(5)
    pool = [" ".join(f"w{rng.randrange(99)}" for _ in range(n)) + rng.choice([".", "!", "?"]) for n in (2, 4, 5, 7, 9, 12) for _ in range(3)]
    rows = [(i // 2 * 2 + 1, rng.choice([" ", "\n"]).join(rng.choice(pool) for _ in range(rng.randrange(8))), "en", "a") for i in range(40)]
    rows = list({r[0]: r for r in rows}.values()) + [(500, None, "en", "a"), (501, "", "en", "a"), (None, pool[-1].upper(), "en", "a")]
    docs = frame(spark, rows)
    seen, expected = set(), defaultdict(int)
    for i, t, *_ in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        for u in units(t or "", 4):
            expected[i] += u in seen
            seen.add(u)
    got = unit_dedup.repeated_units(docs, min_words=4).collect()
    counts = defaultdict(int)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        counts[r["doc_id"]] += 1
        here = next(units(text[r["doc_id"]][r["start"] : r["end"]], 4))
        assert next(units(text[r["kept_doc_id"]][r["kept_start"] :], 4)) == here
        assert text[r["doc_id"]].encode()[r["byte_start"] : r["byte_end"]].decode() == text[r["doc_id"]][r["start"] : r["end"]]
    assert counts == {i: n for i, n in expected.items() if n}
    cut = unit_dedup.without_repeats(docs, min_words=4)
    assert cut.columns == docs.columns and cut.count() == len(rows)
    assert unit_dedup.repeated_units(cut, min_words=4).count() == 0
    assert unit_dedup.repeated_units(docs.where("false")).count() == 0


def test_unit_dedup_awkward(spark):
    docs = frame(spark, corpus())
    assert unit_dedup.without_repeats(docs).count() == docs.count()


def test_repeated_lines_and_paragraphs_of_short_sentences(spark):
    line = "Ascirr para osóciónta. No las ciónbo os!"
    first = "one two three\nfour five\nsix seven"
    rows = [
        (1, f"{line}\nown words that stand here only once\n\n{first}", "en", "a"),
        (2, f"other words that stand here only once\n  {line.replace("Asc", "ASC")}", "en", "a"),
        (3, f"yet other words that stand here only once.\n \n{first}\n\nNo las.", "en", "a"),
        (4, "Start. Yet other words that stand here only once. End.\nfour five", "en", "a"),
    ]
    docs = frame(spark, rows)
    got = sorted((r["doc_id"], rows[r["doc_id"] - 1][1][r["start"] : r["end"]], r["kept_doc_id"], r["kept_start"]) for r in unit_dedup.repeated_units(docs).collect())
    assert got == [
        (2, line.replace("Asc", "ASC"), 1, 0), (3, first, 1, rows[0][1].index(first)), (4, "Yet other words that stand here only once.", 3, 0),
    ]
    kept = {r["doc_id"]: r["text"] for r in unit_dedup.without_repeats(docs).collect()}
    assert kept[1] == rows[0][1] and line.replace("Asc", "ASC") not in kept[2] and first not in kept[3] and kept[4] == "Start.  End.\nfour five"


def groups(rows, k, percent):
    def tokens(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        return frozenset([tuple(w)]) if 0 < len(w) < k else frozenset(zip(*(w[j:] for j in range(k))))

    sets = [(i, tokens(t)) for i, t, *_ in rows]
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            if s and t and None not in (i, j) and 100 * len(s & t) >= percent * len(s | t):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=str)


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80)])
def test_jaccard_groups(spark, k, percent):
    for seed in (1, 2):
        rows = corpus(seed, 120)
        docs = frame(spark, rows)
        got = jaccard_join.similar_groups(docs, k=k, percent=percent)
        assert got.columns == ["doc_id", "n_shingles", "component_id"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == groups(rows, k, percent)


def test_jaccard_chain_of_near_copies(spark):
    """Each text differs from the next a little and from the last a lot; two hundred lightly edited copies beside them."""
    rng = random.Random(9)
    text = [f"v{i}" for i in range(200)]
    rows = []
    for i in range(40):
        text[i * 5] = f"new{i}"
        rows.append((1000 - i, " ".join(text), "en", "a"))
    base = [f"b{i}" for i in range(150)]
    for i in range(200):
        copy = list(base)
        for j in rng.sample(range(150), rng.randrange(6)):
            copy[j] = f"e{rng.random()}"
        rows.append((2000 + i, " ".join(copy), "en", "a"))
    got = jaccard_join.similar_groups(frame(spark, rows), k=3, percent=90).collect()
    assert sorted((tuple(r) for r in got), key=str) == groups(rows, 3, 90)


def thue_morse(n, a, b):
    """Two complementary sequences that hashes by powers modulo 2^64 can't tell apart."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def test_jaccard_of_several_texts_of_one_id(spark):
    """Each text of an id keeps its links, also where the texts have equally many shingles, or are copies of others' texts."""
    rng = random.Random(8)
    a, b, c, d = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(4))
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    rows = [(1, a), (2, b), (5, near(a)), (5, near(b)), (8, c), (9, c), (9, d), (11, near(d)), (12, "alone here now then"), (9, None)]
    got = jaccard_join.similar_groups(frame(spark, [(i, t, "en", "a") for i, t in rows]), k=3, percent=80).collect()
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (2, 1), (5, 1), (8, 8), (9, 8), (11, 8), (12, 12)}
    assert sorted(r["n_shingles"] for r in got if r["doc_id"] == 9) == [0, 58, 58]


def test_jaccard_of_complementary_words(spark):
    one, two = map("".join, thue_morse(1024, "a", "b"))
    rows = [(1, one, "en", "a"), (2, two, "en", "a"), (3, f"{one} x", "en", "a"), (4, f"{two} x", "en", "a"), (5, "x" + one, "en", "a"), (6, one, "en", "a")]
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.similar_groups(frame(spark, rows), k=3, percent=90).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 1}


def test_units_of_complementary_words(spark):
    one, two = map(" ".join, thue_morse(1024, "ab", "ba"))
    rows = [(1, one, "en", "a"), (2, two, "en", "a"), (3, f"{one}\n\n{two}", "en", "a")]
    got = unit_dedup.repeated_units(frame(spark, rows)).collect()
    assert sorted((r["doc_id"], r["start"], r["kept_doc_id"]) for r in got) == [(3, 0, 1), (3, len(one) + 2, 2)]


def test_spans_have_distinct_hashes():
    import numpy as np

    from winnow.llm.text import hashed_spans

    rng = random.Random(4)
    spans = {bytes(rng.choice(b"ab\x00") for _ in range(rng.choice([0, 1, 3, 7, 8, 9, 16, 30, 255, 256, 257, 900]))) for _ in range(3000)}
    seen = {}
    spans = sorted(spans)
    for shift in (0, 1, 5):
        data = np.frombuffer(b"z" * shift + b"".join(spans), np.uint8)
        ends = shift + np.cumsum([len(s) for s in spans])
        h = hashed_spans(data, ends - [len(s) for s in spans], ends)
        assert len(set(h.tolist())) == len(spans)
        assert seen.setdefault("h", h.tolist()) == h.tolist()  # the same wherever they stand
        assert not set(hashed_spans(data, ends - [len(s) for s in spans], ends, seed=1).tolist()) & set(h.tolist())


def test_first_of_each_group(spark):
    rows = corpus(4)
    docs = frame(spark, rows)
    kept = jaccard_join.first_of_each_group(docs)
    assert kept.columns == docs.columns
    later = {i for i, _, c in groups(rows, 5, 80) if i is not None and c < i}
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in later)
    assert jaccard_join.first_of_each_group(docs.where("false")).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r["node"], r["component"]) for r in got} == {(x, find(x)) for x in linked} and len(got) == len(linked)


def removed(rows, least):
    """(id, n_bytes, n_removed, n_spans, sha) of rows with distinct ids."""
    seen, out = set(), []
    for i, t, *_ in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        b = (t or "").encode()
        gone = [False] * len(b)
        for s in range(len(b) - least + 1):
            g = b[s : s + least]
            if g in seen:
                gone[s : s + least] = [True] * least
            seen.add(g)
        kept = bytes(c for c, x in zip(b, gone) if not x)
        spans = sum(x and (j == 0 or not gone[j - 1]) for j, x in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def small_alphabet(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t = "".join(rng.choice("abé") for _ in range(rng.randrange(120)))
        if rows and rng.random() < 0.6:
            other = rng.choice(rows)[1]
            a = rng.randrange(len(other) + 1)
            t = t[:20] + other[a : a + rng.randrange(60)] + t[20:40]
        if rng.random() < 0.15:
            t += rng.choice(["a", "ab", "abé"]) * 40
        rows.append((i * 2, t, "en", "a"))
    return rows + [(9001, None, "en", "a"), (9002, "", "en", "a"), (None, rows[1][1], "en", "a"), (9003, "ab" * 3000, "en", "a")]


@pytest.mark.parametrize("seed,least,anchor", [(1, 12, 4), (2, 20, 6), (3, 9, 9)])
def test_repeated_strings(spark, seed, least, anchor):
    rows = small_alphabet(seed, 120)
    got = suffix_dedup.repeats_removed(frame(spark, rows), least=least, anchor=anchor)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == removed(rows, least)
    for r in got.where("n_removed > 0").collect()[:5]:
        assert hashlib.sha256(r["kept"]).hexdigest() == r["kept_sha256"] and len(r["spans"]) == 2 * r["n_spans"]


def test_repeated_strings_of_crowded_anchors(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CONTEXTS", 3)
    rows = small_alphabet(7, 150)
    got = suffix_dedup.repeats_removed(frame(spark, rows), least=12, anchor=4)
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == removed(rows, 12)


def test_repeated_strings_awkward(spark):
    docs = frame(spark, corpus())
    got = suffix_dedup.repeats_removed(docs).collect()
    assert len(got) == docs.count()
    twice = [r["kept_sha256"] for r in got if r["doc_id"] == corpus()[0][0]]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert suffix_dedup.repeats_removed(docs.where("false")).count() == 0


def test_rows_alike_lose_what_one_of_them_loses(spark):
    rows = small_alphabet(5, 60)
    again = [rows[3], rows[40], rows[40], rows[-1], rows[-2]]  # the last but one has a null id
    once = {r[0]: r for r in removed(rows, 12)}
    own = (9500, "z" + "".join(random.Random(8).choices("cdefghijklmnop", k=200)), "en", "a")
    rows, again = rows + [own], again + [own]
    expected = [*once.values(), *(once[r[0]] for r in again[:-1])] + removed([own], 12) * 2
    got = [tuple(r)[:5] for r in suffix_dedup.repeats_removed(frame(spark, rows + again, clashing=False), least=12, anchor=4).collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert [r[2] for r in got if r[0] == 9500] == [0, 0]


def test_prefix_intervals():
    import numpy as np

    found = set(suffix_dedup.prefix_intervals(np.array([0, 5, 7, 7, 3, 9, 5]), 4))
    assert found == {(5, 0, 4), (7, 1, 4), (5, 4, 7), (9, 4, 6)}
