"""Mixture-controlled packing of tokenised documents into sequences.

Documents are tokenised, and dealt to partitions by hash, so each partition sees the mixture of the whole. In a
partition every source has a queue. A window of ``length`` tokens is filled by deficit round-robin: each source earns
its target share of the window, is served the whole tokens it has earned, and keeps the rest as its deficit for the next window. As
soon as a source cannot give what it owes the next window, the rest of the partition and its deficits are handed over: all rests
are dealt anew to fewer partitions, round by round, until one is left. So every window but those at the end of
the last partition meets the targets. What is left there is cut into powers of two.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.frames import small_side, written
from winnow.llm.text import Bytes8, Chunk, LOWER, chunks, hashed_spans, words

#: tokens of a sequence, id after each document
LENGTH, END = 4096, 2
#: tokens of a partition; sources of a smaller share of the tokens have one queue together, each by its weight
PART_TOKENS, LEAST_SHARE = 4 << 20, 1 / 1024
#: a round that leaves more than this part of its tokens shows that the targets can't be met by what there is
STUCK = 0.75
#: bytes of remembered words that a worker keeps
REMEMBERED_BYTES = 40 << 20
#: a control character that stands between words while they are encoded, and a number that is no id
_BETWEEN, _NO_ID = "\x01", 0xFFFFFFFF

_PIECE = "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ALL = f"{_PIECE}, part int, queue int, earned array<double>, ids binary, member long, weight double, draw long"


class WordIds:
    """Token ids of texts, word by word. The tokenizer drops case, parts at white space and parts letters from other signs, so words
    are remembered in lower case and without the full stop or comma after them: by a hash of 64 bits and their
    first eight bytes, in a hash table of numpy arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads cost memory
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        """Words have numbers from 1; ``table`` holds them at their hash or the next free place, 0 is free."""
        self.table = np.zeros(1 << 16, np.int32)
        self.key, self.head = np.zeros(1, np.uint64), np.zeros(1, np.uint64)
        self.first, self.count, self.flat = np.zeros(1, np.int32), np.zeros(1, np.int32), np.zeros(0, np.uint32)
        self.again = np.zeros(1, bool)

    def shrink(self) -> None:
        """Keep the words that were met again since the last time, or none if these are most."""
        stay = np.flatnonzero(self.again)
        if 2 * len(stay) > len(self.key):
            self.forget()
            return
        key, head, first, count, flat = self.key[stay], self.head[stay], self.first[stay], self.count[stay], self.flat
        self.forget()
        ends = np.cumsum(count, dtype=np.int64)
        self.flat = flat[np.repeat(first - (ends - count), count) + np.arange(int(count.sum()))]
        self._append(key, head, (ends - count).astype(np.int32), count)

    def _append(self, key: np.ndarray, head: np.ndarray, first: np.ndarray, count: np.ndarray) -> None:
        """Give words whose ids stand in ``flat`` their numbers."""
        known = len(self.key)
        self.key, self.head = np.concatenate([self.key, key]), np.concatenate([self.head, head])
        self.first, self.count = np.concatenate([self.first, first]), np.concatenate([self.count, count])
        self.again = np.concatenate([self.again, np.zeros(len(key), bool)])
        if 2 * len(self.key) > len(self.table):
            self.table = np.zeros(1 << (2 * len(self.key)).bit_length(), np.int32)
            known = 1
        self._enter(np.arange(known, len(self.key), dtype=np.int32))

    def _place(self, key: np.ndarray) -> np.ndarray:
        return (key >> np.uint64(64 - len(self.table).bit_length() + 1)).astype(np.int64)

    def numbers(self, key: np.ndarray, head: np.ndarray) -> np.ndarray:
        """The number of each word, 0 where it is not known."""
        out = np.zeros(len(key), np.int32)
        at, todo = self._place(key), np.arange(len(key))
        while len(todo):
            number = self.table[at]
            same = (self.key[number] == key[todo]) & (self.head[number] == head[todo]) & (number > 0)
            out[todo[same]] = number[same]
            on = (number > 0) & ~same
            todo, at = todo[on], (at[on] + 1) & (len(self.table) - 1)
        return out

    def _enter(self, number: np.ndarray) -> None:
        at = self._place(self.key[number])
        while len(number):
            free = self.table[at] == 0
            self.table[at[free]] = number[free]
            on = self.table[at] != number
            number, at = number[on], (at[on] + 1) & (len(self.table) - 1)

    def _ids(self, words: list[str]) -> list[int]:
        return self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids

    def learn(self, key: np.ndarray, head: np.ndarray, new: list[str]) -> None:
        """New words are encoded many at a time, a control character between them; its id shows where one ends."""
        (mark,) = self._ids([_BETWEEN])
        firsts, counts, flats, have = [], [], [self.flat], len(self.flat)
        for i in range(0, len(new), 2000):
            part = new[i : i + 2000]
            if any(_BETWEEN in w for w in part):
                flat = np.array([t for w in part for t in (*self._ids([w]), _NO_ID)], np.uint32)
                end = flat == _NO_ID
            else:
                flat = np.array(self._ids([x for w in part for x in (w, _BETWEEN)]), np.uint32)
                end = flat == mark
            ends = np.flatnonzero(end) - np.arange(len(part))  # after the marks are taken out
            count = np.diff(ends, prepend=0)
            firsts.append(have + ends - count)
            counts.append(count)
            flats.append(flat[~end])
            have += len(flats[-1])
        self.flat = np.concatenate(flats)
        self._append(key, head, np.concatenate(firsts).astype(np.int32), np.concatenate(counts).astype(np.int32))

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        low = LOWER[np.frombuffer(b"".join(texts), np.uint8)]
        w = words(Chunk(None, low, np.cumsum([0, *map(len, texts)])))  # parted at ASCII white space only
        last, before = low[w.end - 1], low[np.maximum(w.end - 2, 0)]
        marked = ((last == 0x2E) | (last == 0x2C)) & (w.end - w.start > 1) & (before >= 0x61) & (before <= 0x7A)
        place = np.arange(len(w.start)) + np.cumsum(marked) - marked
        start, end = (np.empty(len(place) + int(marked.sum()), np.int64) for _ in range(2))
        start[place], end[place] = w.start, w.end - marked
        start[place[marked] + 1], end[place[marked] + 1] = w.end[marked] - 1, w.end[marked]
        firsts = np.append(place, len(start))[w.first]
        if sum(a.nbytes for a in (self.table, self.key, self.head, self.first, self.count, self.flat)) > REMEMBERED_BYTES:
            self.shrink()
        key, head = hashed_spans(low, start, end), Bytes8(low).at(start, end - start)
        number = self.numbers(key, head)
        self.again[number] = True
        while len(missing := np.flatnonzero(number == 0)):
            _, one = np.unique(key[missing], return_index=True)
            one = missing[one]
            self.learn(key[one], head[one], [low[a:b].tobytes().decode(errors="replace") for a, b in zip(start[one].tolist(), end[one].tolist())])
            number[missing] = self.numbers(key[missing], head[missing])
        count = self.count[number].astype(np.int64)
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(self.first[number] - (ends - count), count) + np.arange(int(count.sum()))]
        borders = np.concatenate([[0], ends])[firsts]
        return [ids[a:b] for a, b in zip(borders[:-1], borders[1:])]


def to_planes(ids: np.ndarray) -> bytes:
    """Ids as four runs of bytes, the low bytes first, compressed after their number: the high ones are mostly alike."""
    planes = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return len(ids).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def from_planes(packed: bytes) -> np.ndarray:
    size = 4 * int.from_bytes(packed[:4], "little")
    planes = pa.decompress(packed[4:], decompressed_size=size, codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class Item:
    """A document or the rest of one in a queue; ``member`` is its source, ``weight`` the source's share."""

    __slots__ = ("doc", "start", "total", "ids", "member", "weight", "draw")

    def __init__(self, doc, start: int, total: int, ids: np.ndarray, member: int = 0, weight: float = 1.0, draw: int = 0):
        self.doc, self.start, self.total, self.ids, self.member, self.weight, self.draw = doc, start, total, ids, member, weight, draw


class Packer:
    """The queues of one partition; ``targets`` are the shares of its queues, ``earned`` their deficits."""

    def __init__(self, targets: dict[int, float], length: int, base: int, earned: dict[int, float] | None = None):
        self.targets, self.length, self.sequence = targets, length, base
        self.queues: dict[int, deque[Item]] = {}
        self.backlog: dict[int, int] = {}
        self.earned = dict.fromkeys(targets, 0.0) | (earned or {})
        self.pieces: list[tuple] = []

    def add(self, queue: int, item: Item) -> None:
        self.queues.setdefault(queue, deque()).append(item)
        self.backlog[queue] = self.backlog.get(queue, 0) + len(item.ids)

    def interleave(self) -> None:
        """Sources that share a queue take turns by weight, document by document; those without a target come last."""
        for q, items in self.queues.items():
            served: dict[int, int] = {}
            due = []
            for item in items:
                served[item.member] = served.get(item.member, 0) + len(item.ids)
                due.append(served[item.member] / item.weight if item.weight else float("inf"))
            if len(served) > 1:
                self.queues[q] = deque(item for _, item in sorted(zip(due, items), key=lambda x: x[0]))

    def take(self, queue: int, tokens: int, offset: int) -> int:
        """Move ``tokens`` of a queue into the current sequence from ``offset``; the new offset."""
        items = self.queues[queue]
        self.backlog[queue] -= tokens
        while tokens:
            item = items[0]
            ids = item.ids[:tokens]
            self.pieces.append((item.doc, item.start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), item.total, self.sequence, offset))
            offset += len(ids)
            tokens -= len(ids)
            if len(ids) == len(item.ids):
                items.popleft()
            else:
                item.start, item.ids = item.start + len(ids), item.ids[len(ids) :]
        return offset

    def dealt(self, size: int) -> dict[int, int]:
        """Tokens of each queue in the next window of ``size``: what it has earned, and one more for those nearest to another."""
        due = {q: self.earned[q] + share * size for q, share in self.targets.items() if share > 0}
        part = {q: max(0, int(x)) for q, x in due.items()}
        over = size - sum(part.values())
        order = sorted(due, key=lambda q: (part[q] - due[q], q))
        while over > 0 and order:
            for q in order[:over]:
                part[q] += 1
            over -= len(order[:over])
        while over < 0:  # deficits of many partitions add up
            for q in [q for q in reversed(order) if part[q]][:-over]:
                part[q] -= 1
                over += 1
        return part

    def short(self, part: dict[int, int]) -> bool:
        """Whether a source with a target lacks tokens for its part of the window."""
        for q, tokens in part.items():
            if self.backlog.get(q, 0) < tokens:
                return True
        return not part or any(self.queues[q] and not self.queues[q][0].weight for q, tokens in part.items() if tokens)

    def window(self, size: int, part: dict[int, int]) -> None:
        """One sequence of ``size`` tokens, which must be there; what ``part`` asks of dry queues is given by the longest ones."""
        for q, share in self.targets.items():
            self.earned[q] += share * size
        offset = 0
        for q in sorted(part, key=lambda q: (-part[q], q)):
            n = min(part[q], self.backlog.get(q, 0))
            if n > 0:
                offset = self.take(q, n, offset)
                self.earned[q] -= n
        while offset < size:
            q = max(self.backlog, key=lambda q: (self.backlog[q], -q))
            n = min(self.backlog[q], size - offset)
            offset = self.take(q, n, offset)
            self.earned[q] = self.earned.get(q, 0.0) - n
        self.sequence += 1

    def left(self) -> int:
        return sum(self.backlog.values())

    def run(self, everything: bool) -> Iterator[pa.RecordBatch]:
        """Fill windows while all sources can give their part, or to the end; gives the pieces in batches."""
        while self.left() >= self.length:
            part = self.dealt(self.length)
            if not everything and self.short(part):
                break
            self.window(self.length, part)
            if len(self.pieces) > 20_000:
                yield self.batch()
        while everything and (rest := self.left()):
            size = 1 << (rest.bit_length() - 1)
            self.window(size, self.dealt(size))
        yield self.batch()

    def batch(self) -> pa.RecordBatch:
        names = [f.split()[0] for f in _PIECE.split(", ")]
        pieces, self.pieces = self.pieces, []
        return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pieces], pa.int64()) for i in range(len(names))], names)

    def rests(self, part: int) -> Iterator[pa.RecordBatch]:
        """What is left, some documents a batch, and a row of deficits."""
        def rows(items: list[tuple[int, Item]]) -> pa.RecordBatch:
            columns = {
                "id": pa.array([x.doc for _, x in items], pa.int64()), "start": pa.array([x.start for _, x in items], pa.int64()), "doc_tokens": pa.array([x.total for _, x in items], pa.int64()), "length": pa.array([len(x.ids) for _, x in items], pa.int64()),
                "queue": pa.array([q for q, _ in items], pa.int32()), "ids": pa.array([to_planes(x.ids) for _, x in items], pa.binary()), "member": pa.array([x.member for _, x in items], pa.int64()),
                "weight": pa.array([x.weight for _, x in items], pa.float64()), "draw": pa.array([x.draw for _, x in items], pa.int64()),
            }
            return pa.RecordBatch.from_pydict(columns)

        held, size = [], 0
        for q, items in self.queues.items():
            while items:
                held.append((q, items.popleft()))
                size += len(held[-1][1].ids)
                if size > 1 << 20:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)
        earned = [self.earned.get(q, 0.0) for q in range(max(self.earned, default=-1) + 1)]
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "earned": pa.array([earned], pa.list_(pa.float64()))})


_TYPES = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "array<double>": pa.list_(pa.float64()), "binary": pa.binary()}
_FIELDS = [(f.split()[0], _TYPES[f.split()[1]]) for f in _ALL.split(", ")]


def _with_schema(batch: pa.RecordBatch) -> pa.RecordBatch:
    have = set(batch.schema.names)
    return pa.RecordBatch.from_arrays([batch.column(n) if n in have else pa.nulls(batch.num_rows, t) for n, t in _FIELDS], [n for n, _ in _FIELDS])


def encoded(docs: DataFrame, encoder: Callable[[], object], key: str, text: str, source: str, end: int) -> DataFrame:
    """``id``, ``source``, ``draw`` (hash of id and text), ``doc_tokens`` and ``ids`` of every row."""
    rows = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.col(source).cast("string").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for chunk in chunks(batches):
            found = [np.append(x, np.uint32(end)) for x in coder.encode([chunk.text(i) for i in range(chunk.rows.num_rows)])]
            yield pa.RecordBatch.from_arrays(
                [*(chunk.rows.column(c) for c in ("id", "source", "draw")), pa.array([len(x) for x in found], pa.int64()), pa.array(map(to_planes, found), pa.binary())],
                ["id", "source", "draw", "doc_tokens", "ids"],
            )

    return rows.withColumn("draw", F.xxhash64("id", "text")).mapInArrow(run, "id long, source string, draw long, doc_tokens long, ids binary")


def pack(docs: DataFrame, encoder: Callable[[], object], key: str = "doc_id", text: str = "text", source: str = "source", targets: dict[str, float] | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    """Every token of every document in exactly one piece: ``key`` (an integer), ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset``.

    ``encoder()`` is called once per task, may hand out one object per worker, and gives an object whose ``encode`` turns a list of texts
    in UTF-8 into id arrays. ``targets``: share of each source, by default its share of all tokens;
    null is a source of its own. A null or empty text is its end id alone. Rows of one
    id are packed each on its own. If targets ask for more of a source than there is, the windows after that hold
    the mixture of what is left.
    """
    spark = docs.sparkSession
    rows = written(encoded(docs, encoder, key, text, source, end), "tokens")
    sizes = written(rows.groupBy("source").agg(F.sum("doc_tokens").alias("tokens")), "sources")
    if targets is None:
        sizes = sizes.withColumn("weight", F.col("tokens").cast("double"))
    else:
        wish = spark.createDataFrame(pa.table({"wish": pa.array(targets.keys(), pa.string()), "weight": pa.array(map(float, targets.values()), pa.float64())}))
        sizes = sizes.join(wish, F.col("source").eqNullSafe(F.col("wish")), "left").select("source", "tokens", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    kinds, left, weights = sizes.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    # queue 0 is that of all small sources; the others are at most 1 / LEAST_SHARE
    large = (F.col("weight") >= LEAST_SHARE * weights) & (F.col("weight") > 0)
    own = sorted(sizes.where(large).select("source", "weight").collect(), key=lambda r: (r["source"] is None, r["source"]))
    total = weights or 1.0
    shares = {0: max(0.0, 1.0 - sum(r["weight"] for r in own) / total) if own else 1.0} | {i: r["weight"] / total for i, r in enumerate(own, 1)}
    if shares[0] < 1e-9:
        shares[0] = 0.0
    # as Arrow tables: from a list of rows they would pass through Python workers of another kind, which stay beside the others
    numbered = spark.createDataFrame(pa.table({"named": pa.array([r["source"] for r in own], pa.string()), "queue": pa.array(range(1, len(own) + 1), pa.int32())}))
    known = sizes.join(F.broadcast(numbered), F.col("source").eqNullSafe(F.col("named")), "left")
    known = written(known.select(F.col("source").alias("known"), F.xxhash64("source").alias("member"), F.coalesce("queue", F.lit(0)).alias("queue"), "weight"), "weights")
    rest = rows.join(small_side(known, kinds, 100), F.col("source").eqNullSafe(F.col("known")))
    rest = rest.select("id", F.lit(0).cast("long").alias("start"), "doc_tokens", "queue", F.lit(None).cast("double").alias("earned"), "ids", "member", "weight", "draw")
    pieces = [f.split()[0] for f in _PIECE.split(", ")]

    def packed(rest: DataFrame, shares: dict[int, float], step: int, everything: bool) -> DataFrame:
        names = list(rest.columns)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part = TaskContext.get().partitionId()
            packer = Packer(shares, length, step << 56 | part << 30)
            for batch in batches:
                for doc, start, tokens, q, earned, ids, member, weight, draw in zip(*(batch.column(c).to_pylist() for c in names)):
                    if ids is None:
                        packer.earned[q] = packer.earned.get(q, 0.0) + earned
                    else:
                        packer.add(q, Item(doc, start, tokens, from_planes(ids), member, weight, draw))
            packer.interleave()
            yield from map(_with_schema, packer.run(everything))
            yield from map(_with_schema, packer.rests(part))

        return rest.mapInArrow(run, _ALL)

    out, step, slow = None, 0, 0
    while True:
        groups = max(1, -(-left // PART_TOKENS))
        everything = groups == 1 or slow > 1
        place = F.when(F.col("ids").isNull(), F.col("draw")).otherwise(F.xxhash64("draw", "id", "start"))
        dealt = rest.repartitionById(groups, F.pmod(place, F.lit(groups)).cast("int")).sortWithinPartitions("queue", "draw", "id", "start", "doc_tokens", "ids")
        done = written(packed(dealt, shares, step, everything), "packed")
        ready = done.where("sequence_id is not null").select(*pieces)
        out = ready if out is None else out.union(ready)
        if everything:
            return out.withColumnRenamed("id", key)
        over = done.where("ids is not null")
        sums = {r["queue"]: r["n"] for r in over.groupBy("queue").agg(F.sum("length").alias("n")).collect()}
        now = sum(sums.values())
        if not now:
            return out.withColumnRenamed("id", key)
        rest = over.select("id", "start", "doc_tokens", "queue", F.lit(None).cast("double").alias("earned"), "ids", "member", "weight", "draw")
        if now > STUCK * left:
            shares, slow = {q: n / now for q, n in sums.items()}, slow + 1
            rest = rest.withColumn("weight", F.lit(1.0))
        else:
            slow = 0
            later = max(1, -(-now // PART_TOKENS))
            owed = done.where("earned is not null").select(F.pmod("part", F.lit(later)).cast("long").alias("to"), F.posexplode("earned").alias("queue", "earned"))
            owed = owed.groupBy("to", "queue").agg(F.sum("earned").alias("earned"))
            none = {c: F.lit(None).cast(rest.schema[c].dataType).alias(c) for c in rest.columns}
            rest = rest.union(owed.select(*({**none, "queue": F.col("queue"), "earned": F.col("earned"), "draw": F.col("to").alias("draw")}[c] for c in rest.columns)))
        left, step = now, step + 1
