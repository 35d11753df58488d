"""Small tables with everything awkward in them."""

import random

from pyspark.sql import types as T

BASE = [("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType())]
#: further columns that operators use as names of their own
CLASHING = ["id", "k", "h", "row", "gone", "item", "score", "later", "tokens", "spans", "part", "queue", "_text", "_key", "u", "v", "site", "word", "n"]


def frame(spark, rows, clashing=True):
    """rows: (doc_id, text, lang, source)."""
    fields = [T.StructField(n, t) for n, t in BASE] + [T.StructField(c, T.StringType()) for c in CLASHING if clashing]
    data = [(i, t, la, s, None if t is None else len(t), *(["x"] * len(CLASHING) if clashing else [])) for i, t, la, s in rows]
    return spark.createDataFrame(data, T.StructType(fields)).repartition(3)


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"z{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def corpus(seed=1, texts=60):
    """Random texts with exact and near copies, then nulls, empties, ties, repeated rows and a very long text."""
    rng = random.Random(seed)
    rows, made = [], []
    for i in range(texts):
        kind = rng.random()
        if made and kind < 0.2:
            t = rng.choice(made)
        elif made and kind < 0.5:
            t = edited(rng, rng.choice(made), rng.choice([0.005, 0.01, 0.02, 0.05]))
        else:
            t = words(rng, rng.choice([1, 2, 3, 4, 5, 30, 80, 150, 150, 300]), 10**6)
            made.append(t)
        rows.append((i * 3 + 1, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None])))
    rows += [(900, None, "en", "a"), (901, "", "en", "a"), (902, " \n\t ", None, None), (903, "ÀÉ ß ΑΣ 中文 \U0001F600 é", "fr", "b"), (904, "!!! 123", "en", "b")]
    rows += [(rows[0][0], rows[0][1], "en", "a"), (rows[5][0], "another text under the same id", "en", "a"), (None, rows[3][1], "en", "a"), (None, None, None, None)]
    rows += [(950, " ".join(["again"] * 30_000), "en", "a"), (951, words(rng, 20_000, 50), "en", "b"), (-7, rows[2][1], "en", "c")]
    return rows
