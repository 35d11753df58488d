"""Prefix trie of conversations by a splitter skeleton.

A conversation is the path of its turns' digests. Paths are range-partitioned in order of (path, id); the paths
that part the shards, with all their prefixes, are the skeleton. A node whose members lie in several shards is a prefix
of a path between them, so it is in the skeleton; every other node is finished by the scan of one sorted shard.
Skeleton nodes get partial aggregates from each shard, which are reduced and rolled up.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from winnow.llm.frames import small_side, written

#: bytes of a turn's digest, of the paths in a shard, and of all splitters together
DIGEST, SHARD_BYTES, SKELETON_BYTES = 32, 8 << 20, 16 << 20
#: paths drawn for each splitter, bytes of a piece of an id list
OVERSAMPLE, PIECE = 8, 1 << 16
#: one word
WORD = r"[^\x20\x09-\x0D]+"

_SCAN = "kind string, conv_id long, depth long, parent_conv_id long, parent_node long, node long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, shard int, piece long, ids string"
_FIELDS = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}[c.split()[1]]) for c in _SCAN.split(", ")])


def paths_of(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id`` and ``turns``, its array of (digest, words of the text) in order.

    Order is by turn, nulls first; turns of one number by role and then digest, repeated rows are repeated turns. Null
    roles and texts are empty. Rows without an id belong to no conversation. A conversation is held in one row, 40 bytes a turn.
    """
    who, what = F.coalesce(F.col(role).cast("string"), F.lit("")), F.coalesce(F.col(text).cast("string"), F.lit(""))
    mark = F.unhex(F.sha2(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, what), 256))
    rows = turns.where(F.col(key).isNotNull()).select(
        F.col(key).cast("long").alias("conv_id"), F.col(turn).alias("at"), who.alias("role"), mark.alias("digest"), F.regexp_count(what, F.lit(WORD)).cast("long").alias("words")
    )
    ordered = F.sort_array(F.collect_list(F.struct("at", "role", "digest", "words")))
    return rows.groupBy("conv_id").agg(F.transform(ordered, lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns"))


def grafted(paths: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """Each conversation with its first ``heads`` turns (at most ``most``) replaced by as many of conversation ``base``:
    all if that has fewer, none if it is absent."""
    none = F.array().cast(paths.schema["turns"].dataType)
    stems = paths.select(F.col("conv_id").alias("stem"), F.slice("turns", 1, most).alias("first"))
    both = paths.select("conv_id", "turns", base.alias("base"), heads.cast("int").alias("h")).join(stems, F.col("base") == F.col("stem"), "left")
    head = F.when(F.col("h") > 0, F.slice(F.coalesce("first", none), F.lit(1), F.col("h"))).otherwise(none)
    tail = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return both.select("conv_id", F.concat(head, tail).alias("turns"))


class Skeleton:
    """The trie of the splitters' paths: ``step[(node, digest)]`` is a child; node 0 is the root, parents come before children."""

    def __init__(self, splitters: list[tuple[bytes, int]]):
        self.splitters = splitters
        self.step: dict[tuple[int, bytes], int] = {}
        self.parent, self.depth = [-1], [0]
        for path, _ in splitters:
            node = 0
            for i in range(0, len(path), DIGEST):
                at = (node, path[i : i + DIGEST])
                if at not in self.step:
                    self.step[at] = len(self.parent)
                    self.parent.append(node)
                    self.depth.append(self.depth[node] + 1)
                node = self.step[at]

    def walk(self, path: bytes) -> list[int]:
        """The skeleton nodes along a path, the root first."""
        nodes = [0]
        for i in range(0, len(path), DIGEST):
            child = self.step.get((nodes[-1], path[i : i + DIGEST]))
            if child is None:
                break
            nodes.append(child)
        return nodes


class Node:
    """A node on the stack: aggregates of the members seen so far and the closed children, which wait for its smallest member."""

    __slots__ = ("least", "members", "children", "leaves", "saved", "words", "ends", "waiting")

    def __init__(self, words: int):
        self.least, self.members, self.children, self.leaves, self.saved, self.words = None, 0, 0, 0, 0, words
        self.ends, self.waiting = None, []


class Scan:
    """Depth-first scan of the sorted paths of one shard; ``rows`` collects what is finished."""

    def __init__(self, skeleton: Skeleton, shard: int):
        self.skeleton, self.shard = skeleton, shard
        self.path, self.frame = b"", [0]
        self.stack = [Node(0)]
        self.rows: list[dict] = []
        self.ids: list[str] = []
        self.size = self.pieces = 0

    def add(self, conv: int, path: bytes, words: list[int]) -> None:
        same, limit = 0, min(len(path), len(self.path)) // DIGEST
        while same < limit and path[same * DIGEST : (same + 1) * DIGEST] == self.path[same * DIGEST : (same + 1) * DIGEST]:
            same += 1
        while len(self.stack) > same + 1:
            self.close()
        if path != self.path:
            self.flush()
            del self.frame[same + 1 :]
            if len(self.frame) == same + 1:
                self.frame = self.skeleton.walk(path)
            self.path = path
        for w in words[same:]:
            self.stack.append(Node(w))
        if len(self.frame) == len(self.stack):  # ends at a skeleton node
            self.ids.append(str(conv))
            self.size += len(self.ids[-1]) + 1
            if self.size > PIECE:
                self.flush()
        else:
            top = self.stack[-1]
            if top.ends is None:
                top.ends = hashlib.sha256(str(conv).encode())
            else:
                top.ends.update(f",{conv}".encode())
        top = self.stack[-1]
        top.members += 1
        top.least = conv if top.least is None else min(top.least, conv)

    def flush(self) -> None:
        if self.ids:
            self.rows.append({"kind": "ends", "node": self.frame[len(self.path) // DIGEST], "shard": self.shard, "piece": self.pieces, "ids": ",".join(self.ids)})
            self.pieces += 1
            self.ids, self.size = [], 0

    def close(self) -> None:
        depth = len(self.stack) - 1
        if depth < len(self.frame):
            self.flush()
        node = self.stack.pop()
        above = self.stack[-1] if self.stack else None
        if above is not None:
            above.members += node.members
            above.least = node.least if above.least is None else min(above.least, node.least)
        if depth < len(self.frame):
            self.rows += [r | {"parent_node": self.frame[depth]} for r in node.waiting]
            self.rows.append({"kind": "part", "node": self.frame[depth], "conv_id": node.least, "n_convs": node.members, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "piece": node.words})
            return
        self.rows += [r | {"parent_conv_id": node.least} for r in node.waiting]
        node.leaves += node.children == 0
        node.saved += (node.members - 1) * node.words
        above.children, above.leaves, above.saved = above.children + 1, above.leaves + node.leaves, above.saved + node.saved
        ends = (node.ends or hashlib.sha256()).hexdigest()
        above.waiting.append({"kind": "node", "conv_id": node.least, "depth": depth, "n_convs": node.members, "n_children": node.children, "n_leaves": node.leaves, "saved_tokens": node.saved, "ends_sha256": ends})

    def finish(self) -> None:
        while self.stack:
            self.close()


def _skeleton(paths: DataFrame) -> Skeleton:
    """Splitters at even distances of paths drawn by hash; their bytes are bounded, so longer paths give fewer shards."""
    n, size, longest = paths.agg(F.count("*"), F.sum(F.octet_length("path") + DIGEST), F.max(F.octet_length("path"))).first()
    wanted = max(-(-(size or 0) // SHARD_BYTES), min(paths.sparkSession.sparkContext.defaultParallelism, -(-n // 1000)))
    shards = min(wanted, max(1, SKELETON_BYTES // ((longest or 0) + DIGEST)))
    if shards <= 1:
        return Skeleton([])
    drawn = paths.select("path", "conv_id").orderBy(F.xxhash64("conv_id"), "conv_id").limit(OVERSAMPLE * shards).collect()
    drawn = sorted((bytes(r["path"]), r["conv_id"]) for r in drawn)
    return Skeleton(sorted({drawn[i * len(drawn) // shards] for i in range(1, shards)}))


def trie(conversations: DataFrame) -> DataFrame:
    """One row per distinct prefix of the ``turns`` of ``conversations`` (``conv_id`` unique): ``conv_id`` (smallest member), ``depth``,
    ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    The root (depth 0, null parent) has all conversations, those without turns too; a table without conversations has no node.
    Skeleton nodes are at most ``SKELETON_BYTES / DIGEST``; only they, and the drawn paths, meet the driver.
    """
    spark = conversations.sparkSession
    path = F.unhex(F.array_join(F.transform("turns", lambda t: F.hex(t["digest"])), ""))
    paths = written(conversations.select("conv_id", path.alias("path"), F.col("turns.words").alias("words")), "paths")
    skeleton = _skeleton(paths)
    shared = spark.sparkContext.broadcast(skeleton)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = shared.value.splitters
        for batch in batches:
            shard = [bisect_right(cuts, (p, c)) for p, c in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard, pa.int32())], [*batch.schema.names, "shard"])

    dealt = paths.mapInArrow(place, "conv_id long, path binary, words array<long>, shard int")
    dealt = dealt.repartitionById(len(skeleton.splitters) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            for conv, path, words, shard in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "path", "words", "shard"))):
                if now is None or now.shard != shard:
                    if now is not None:
                        now.finish()
                        yield pa.RecordBatch.from_pylist(now.rows, _FIELDS)
                    now = Scan(shared.value, shard)
                now.add(conv, path, words)
                if len(now.rows) >= 20_000:
                    yield pa.RecordBatch.from_pylist(now.rows, _FIELDS)
                    now.rows = []
        if now is not None:
            now.finish()
            yield pa.RecordBatch.from_pylist(now.rows, _FIELDS)

    done = written(dealt.mapInArrow(scan, _SCAN), "trie")

    parts = done.where("kind = 'part'").groupBy("node").agg(
        F.min("conv_id").alias("least"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("piece").alias("words")
    )
    sums = {r["node"]: r.asDict() for r in parts.collect()}  # at most one row per skeleton node
    for node in sorted(sums, reverse=True):  # children come after parents
        s = sums[node]
        s["n_leaves"] += s["n_children"] == 0
        s["saved_tokens"] += (s["n_convs"] - 1) * s["words"]
        if node:
            above = sums[skeleton.parent[node]]
            above["n_children"] += 1
            above["n_leaves"] += s["n_leaves"]
            above["saved_tokens"] += s["saved_tokens"]
    rows = [(n, s["least"], skeleton.depth[n], sums[skeleton.parent[n]]["least"] if n else None, s["n_convs"], s["n_children"], s["n_leaves"], s["saved_tokens"]) for n, s in sums.items()]
    top = spark.createDataFrame(rows, "node long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ends = None, None
        for batch in batches:
            for n, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if n != node:
                    if node is not None:
                        yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": ends.hexdigest()}])
                    node, ends = n, hashlib.sha256()
                else:
                    ends.update(b",")
                ends.update(ids.encode())
        if node is not None:
            yield pa.RecordBatch.from_pylist([{"node": node, "ends_sha256": ends.hexdigest()}])

    # a list is hashed from its first id to its last: one task streams its pieces
    pieces = done.where("kind = 'ends'").select("node", "shard", "piece", "ids").repartition("node").sortWithinPartitions("node", "shard", "piece")
    ends = pieces.mapInArrow(hashed, "node long, ends_sha256 string")
    empty = hashlib.sha256().hexdigest()
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    skeletal = top.join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(empty)))
    small = small_side(top.select(F.col("node").alias("up"), F.col("conv_id").alias("up_conv")), len(rows), 32)
    local = done.where("kind = 'node'").join(small, F.col("parent_node") == F.col("up"), "left")
    return skeletal.select(out).union(local.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "up_conv")).select(out))
