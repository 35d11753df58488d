"""The conversation trie against every prefix listed by brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm import conversation_trie
from winnow.llm.queries import op13_conversation_trie

FIELDS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType()), *(T.StructField(c, T.StringType()) for c in ("node", "path", "shard", "words", "at"))])


def table(spark, rows):
    return spark.createDataFrame([(*r, "n", "p", "s", "w", "a") for r in rows], FIELDS).repartition(4)


def rebuilt(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    # turns of one number: by role, then digest of the text
    mark = lambda t: hashlib.sha256(f"{len(t[2].encode())}:{t[2]}{t[3]}".encode()).digest()
    own = {c: [(t[2], t[3]) for t in sorted(ts, key=lambda t: (t[:3], mark(t)))] for c, ts in own.items()}
    out = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        out[c] = own.get(base, [])[:h] + ts[h:]
    return out


def brute(paths):
    nodes = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            nodes.setdefault(tuple(path[:d]), []).append(c)
    children = {}
    for p in nodes:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        kids = children.get(p, [])
        leaves[p] = sum(leaves[k] for k in kids) or 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved[p] = (len(nodes[p]) - 1) * words + sum(saved[k] for k in kids)
    ends = lambda p: ",".join(str(c) for c in sorted(c for c in nodes[p] if len(paths[c]) == len(p)))
    return sorted(
        (min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends(p).encode()).hexdigest()) for p, m in nodes.items()
    )


def talk(seed, n):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        kind = rng.random()
        texts = ["hello there", "hot first turn"] if kind < 0.35 else [rng.choice(["a b", "a  c", "", "é\tx"]) for _ in range(rng.randrange(1, 7))]
        rows += [(c, i, rng.choice(["user"] * 9 + ["system"]) if kind > 0.35 else "user", t) for i, t in enumerate(texts)]
    rows += [(n + 1, i, "user", f"turn {i % 7}") for i in range(300)] + [(n + 2, i, "user", f"turn {i % 7}") for i in range(250)]
    rows += [(-23, 1, None, None), (-23, None, "user", "first"), (-20, 1, "user", "x"), (10**12 + 3, 5, None, "\x0b late"), (n + 30, 1, "user", "b"), (n + 30, 1, "user", "a"), (n + 30, 1, "user", "a"), (None, 1, "user", "lost")]
    return rows


@pytest.mark.parametrize("shard_bytes,skeleton_bytes", [(1 << 30, 1 << 24), (500, 1 << 24), (500, 60_000)])
def test_against_every_prefix(spark, monkeypatch, shard_bytes, skeleton_bytes):
    monkeypatch.setattr(conversation_trie, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(conversation_trie, "SKELETON_BYTES", skeleton_bytes)
    monkeypatch.setattr(conversation_trie, "PIECE", 40)  # id lists in many pieces
    rows = talk(4, 220)
    paths = conversation_trie.paths_of(table(spark, rows))
    built = conversation_trie.grafted(paths, F.col("conv_id") - F.col("conv_id") % 20, F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4, most=3)
    got = conversation_trie.trie(built)
    want = brute(rebuilt(rows))
    assert sorted((tuple(r) for r in got.collect()), key=lambda r: (r[0], r[1])) == sorted(want, key=lambda r: (r[0], r[1]))


def test_whole_table(spark):
    folder = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, op13_conversation_trie(spark, folder).collect()), key=str) == sorted(brute(rebuilt(rows)), key=str)


def test_small(spark):
    trie = lambda rows: sorted(map(tuple, conversation_trie.trie(conversation_trie.paths_of(table(spark, rows))).collect()), key=str)
    empty = hashlib.sha256().hexdigest()
    assert trie([]) == [] and trie([(None, 1, "user", "x")]) == []
    one = hashlib.sha256(b"7").hexdigest()
    assert trie([(7, 1, None, None)]) == sorted([(7, 0, None, 1, 1, 1, 0, empty), (7, 1, 7, 1, 0, 1, 0, one)], key=str)
    # role and text are told apart
    assert len(trie([(1, 1, "ab", "c"), (2, 1, "a", "bc")])) == 3


def test_turnless_conversations(spark):
    rows = [(1, ()), (2, ()), (3, ())]
    paths = spark.createDataFrame(rows, "conv_id long, turns array<struct<digest:binary,words:long>>")
    (root,) = conversation_trie.trie(paths).collect()
    assert tuple(root) == (1, 0, None, 3, 0, 1, 0, hashlib.sha256(b"1,2,3").hexdigest())
