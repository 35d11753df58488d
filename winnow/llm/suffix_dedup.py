"""Repeated byte strings across documents, from common-prefix intervals of enhanced suffix arrays.

Every string of ``LEAST`` bytes owns an anchor: the short substring in it with the least hash,
the leftmost of equals. Equal strings have equal anchors at equal places, so suffixes may be
partitioned by anchor without losing a repeat, and neighbouring starts that share an anchor
travel together, as one *context*: the bytes of all strings that own it.

* Equal contexts of one anchor are runs inside a longer repeat: all but the earliest are repeated
  as a whole. Tasks reduce them within each chunk of text before the shuffle and within each
  anchor after it, without reading a byte again.
* Anchors with several different contexts are where repeats begin, end or split. The bytes of
  one context of each kind are brought together; their suffixes are sorted, and the intervals
  of common prefixes of at least ``LEAST`` bytes are found by a stack scan. An interval whose occurrences are all
  preceded by the same byte is part of a longer repeat and is passed over; the others are
  maximal repeats, and all their occurrences but the earliest are marked.
* Anchors with more contexts than ``CONTEXTS`` are split by the first ``LEAST`` bytes of their suffixes,
  that is by interval, and aggregated.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.frames import small_side, written
from winnow.llm.text import Chunk, chunks, mix, prefix_hash, span_hash

#: bytes of a repeat at least, bytes of an anchor
LEAST, ANCHOR = 100, 24
#: contexts of one anchor that one task compares; suffixes sorted at once
CONTEXTS, BLOCK = 200_000, 100_000

_LAST = (1 << 63) - 1
_SECOND = np.uint64(0x6C62272E07BB0142)


def owned(chunk: Chunk, least: int = LEAST, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """Runs of starts that share an anchor: row, first start, starts, bytes from first start to anchor, hash of anchor and of context."""
    data, n = chunk.data, len(chunk.data)
    w = least - anchor + 1  # anchors in a string
    empty = np.zeros(0, np.int64)
    if n < least:
        return empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    total = prefix_hash(data)
    at = np.arange(n - anchor + 1)
    h = span_hash(total, at, at + anchor)
    # order by the upper half of the hash, then by place; minima of windows of w by doubling
    best = (h & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    reach = 1
    while reach * 2 <= w:
        best = np.minimum(best[: len(best) - reach], best[reach:])
        reach *= 2
    if reach < w:
        best = np.minimum(best[: len(best) - (w - reach)], best[w - reach :])
    place = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)  # anchor of the string at each start
    row = np.repeat(np.arange(len(chunk.offsets) - 1), np.diff(chunk.offsets))[: len(place)]
    good = np.arange(len(place)) + least <= chunk.offsets[1:][row]
    head = good.copy()
    head[1:] &= ~good[:-1] | (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(head)
    if not len(first):
        return empty, empty, empty, empty, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    tail = good.copy()
    tail[:-1] &= ~good[1:] | head[1:]
    last = np.flatnonzero(tail)
    starts, lead = last - first + 1, place[first] - first
    context = mix(span_hash(total, first, last + least) ^ lead.astype(np.uint64))
    return row[first], first - chunk.offsets[row[first]], starts, lead, h[place[first]], context


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``id`` (null: last), ``k`` (tells rows of one id apart by a hash of the text, else 0), ``text`` (null: empty) and
    ``several`` (null unless the id has several rows)."""
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(_LAST)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    several = written(rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.lit(True).alias("several")), "several")
    rows = rows.join(small_side(several, several.count(), 24), "id", "left")
    return rows.select("id", F.when(F.col("several"), F.xxhash64("text")).otherwise(F.lit(0).cast("long")).alias("k"), "text", "several")


def _each_once(rows: DataFrame) -> DataFrame:
    """One row for each (id, k), so that no row repeats itself; only rows whose id has several are shuffled."""
    several = written(rows.where("several").dropDuplicates(["id", "k"]).select("id", "k", "text"), "several-once")
    return rows.where("several is null").select("id", "k", "text").union(several)


_RUN = "h long, c long, id long, k long, pos long"


def _runs(rows: DataFrame, least: int, anchor: int) -> DataFrame:
    """Contexts, reduced per chunk: ``h``, ``c`` and the earliest place (``pos``: start << 16 | starts << 8 | lead).

    Later equal contexts of the chunk come out as repeated starts at once (starts = 0: from ``pos`` >> 16 to ``c``).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            row, start, count, lead, h, c = owned(chunk, least, anchor)
            if not len(row):
                continue
            ids, ks = (np.asarray(chunk.rows.column(x)) for x in ("id", "k"))
            ids, ks = ids[row], ks[row]
            order = np.lexsort((start, ks, ids, c, h))
            same = np.zeros(len(order), bool)
            same[1:] = (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])
            kept, again = order[~same], np.sort(order[same])
            out = [h[kept].view(np.int64), c[kept].view(np.int64), ids[kept], ks[kept], start[kept] << 16 | count[kept] << 8 | lead[kept]]
            if len(again):  # neighbouring repeated runs become one
                a, b = start[again], start[again] + count[again] - 1
                new = np.ones(len(again), bool)
                new[1:] = (row[again][1:] != row[again][:-1]) | (a[1:] != b[:-1] + 1)
                f = np.flatnonzero(new)
                z = np.append(f[1:], len(again)) - 1
                g = again[f]
                scattered = mix(ids[g].astype(np.uint64) + a[f].astype(np.uint64)).view(np.int64)
                out = [np.concatenate(x) for x in zip(out, (scattered, b[z], ids[g], ks[g], a[f] << 16))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["h", "c", "id", "k", "pos"])

    return rows.mapInArrow(run, _RUN)


_FOUND = "contexts boolean, h long, id long, k long, a long, b long"


def _found(contexts: bool, h, ids, k, a, b) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), contexts)), *(pa.array(x, pa.int64()) for x in (h, ids, k, a, b))], [f.split()[0] for f in _FOUND.split(", ")])


def _resolve(runs: DataFrame, least: int) -> DataFrame:
    """Repeated spans (id, k, a to b) and, where an anchor has several contexts, the earliest of each kind (``a`` = pos)."""
    parts = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = runs.repartition(parts, "h").sortWithinPartitions("h", "c", "id", "k", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry, told = np.zeros((5, 0), np.int64), True  # a row of the open anchor, and whether it is told already
        for batch in batches:
            rows = np.stack([np.asarray(x) for x in batch.columns])
            plain = (rows[4] >> 8 & 0xFF) == 0
            if plain.any():
                f = rows[:, plain]
                yield _found(False, f[0], f[2], f[3], f[4] >> 16, f[1] + least)
                rows = rows[:, ~plain]
                if not rows.shape[1]:
                    continue
            had = carry.shape[1]
            rows = np.concatenate([carry, rows], axis=1)
            h, c, ids, k, pos = rows
            new_h = np.ones(len(h), bool)
            new_h[1:] = h[1:] != h[:-1]
            kind = new_h.copy()
            kind[1:] |= c[1:] != c[:-1]
            again = ~kind
            start = pos >> 16
            yield _found(False, h[again], ids[again], k[again], start[again], (start + (pos >> 8 & 0xFF) - 1 + least)[again])
            anchor = np.cumsum(new_h) - 1
            kinds = np.bincount(anchor, weights=kind)
            wanted = kind & (kinds[anchor] > 1)
            if had and told:
                wanted[0] = False
            if wanted.any():
                yield _found(True, h[wanted], ids[wanted], k[wanted], pos[wanted], pos[wanted])
            open_rows = np.flatnonzero(anchor == anchor[-1])
            told = kinds[-1] > 1 or bool(had and told and open_rows[0] == 0)
            carry = rows[:, -1:] if told else rows[:, open_rows[:1]]

    return dealt.mapInArrow(run, _FOUND)


def _contexts(rows: DataFrame, wanted: DataFrame, count: int, least: int) -> DataFrame:
    """The bytes of the wanted contexts, one byte of left context before them where there is one."""
    asked = wanted.groupBy("id", "k").agg(F.collect_list(F.struct("h", F.col("a").alias("pos"))).alias("asked"))
    both = rows.join(small_side(asked, count, 24), ["id", "k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            asked = chunk.rows.column("asked")
            sizes = np.diff(np.asarray(asked.offsets))
            flat = asked.flatten()
            h, pos = np.asarray(flat.field("h")), np.asarray(flat.field("pos"))
            row = np.repeat(np.arange(len(sizes)), sizes)
            start = (pos >> 16) + chunk.offsets[row]
            end = start + (pos >> 8 & 0xFF) - 1 + least
            left = np.where(pos >> 16 > 0, start - 1, start)
            data = chunk.data.tobytes()
            body = [data[a:b] for a, b in zip(left.tolist(), end.tolist())]
            at = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(h), chunk.rows.column("id").take(at), chunk.rows.column("k").take(at), pa.array(pos), pa.array(body, pa.binary())], ["h", "id", "k", "pos", "body"])

    return both.mapInArrow(run, "h long, id long, k long, pos long, body binary")


def prefix_intervals(lcp: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """(length, from, to) of all intervals of common prefixes of at least ``least``, by a stack scan.

    ``lcp[i]`` is the common prefix of sorted suffixes i - 1 and i; lcp[0] = 0.
    """
    stack: list[tuple[int, int]] = []  # length, left border
    for i, length in enumerate([*lcp.tolist(), 0]):
        left = i - 1
        while stack and stack[-1][0] > length:
            depth, left = stack.pop()
            yield depth, left, i
        if length >= least and (not stack or stack[-1][0] < length):
            stack.append((length, left))


def marked(body: np.ndarray, left: np.ndarray, size: np.ndarray, group: np.ndarray, rank: np.ndarray, least: int) -> np.ndarray:
    """For suffixes given as rows of zero-padded bytes: how many bytes of each stand earlier too (0: none).

    ``left``: byte before each suffix, -1 where it is not known; ``size``: true lengths;
    ``group``: suffixes of different groups are never compared; ``rank``: order of occurrence.
    """
    n, width = body.shape
    keyed = np.empty((n, 8 + width), np.uint8)
    keyed[:, :8] = group.astype(">u8").view(np.uint8).reshape(n, 8)
    keyed[:, 8:] = body
    order = np.argsort(keyed.view(f"S{8 + width}").ravel(), kind="stable")
    body, size, group, left, rank = body[order], size[order], group[order], left[order], rank[order]
    lcp = np.zeros(n, np.int64)
    if n > 1:
        differ = body[1:] != body[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        lcp[1:] = np.where(group[1:] == group[:-1], np.minimum(same, np.minimum(size[1:], size[:-1])), 0)
    best = np.zeros(n, np.int64)
    deep = lcp >= least
    # stretches of neighbours with enough in common; those preceded throughout by one byte are passed over
    opens = np.flatnonzero(deep[1:] & ~deep[:-1]) if n > 1 else np.zeros(0, np.int64)
    closes = np.flatnonzero(deep[1:] & ~np.append(deep[2:], False)) + 2 if n > 1 else opens
    diverse = np.ones(n, bool)
    diverse[1:] = (left[1:] != left[:-1]) | (left[1:] < 0)
    changes = np.concatenate([[0], np.cumsum(diverse)])
    for lo, hi in zip(opens.tolist(), closes.tolist()):
        if changes[hi] == changes[lo + 1] and left[lo] >= 0:
            continue
        within = lcp[lo:hi].copy()
        within[0] = 0
        for length, a, b in prefix_intervals(within, least):
            a, b = lo + a, lo + b
            if changes[b] == changes[a + 1] and left[a] >= 0:
                continue
            earliest = a + int(rank[a:b].argmin())
            own = best[earliest]
            np.maximum(best[a:b], length, out=best[a:b])
            best[earliest] = own
    out = np.zeros(n, np.int64)
    out[order] = best
    return out


def _scan(contexts: DataFrame, least: int) -> DataFrame:
    """Marked spans (id, k, a to b) of the contexts of each anchor."""
    parts = int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = contexts.repartition(parts, "h").sortWithinPartitions("h")

    def blocks(h, ids, k, pos, body) -> Iterator[pa.RecordBatch]:
        """Whole anchors. Strings that are equal lie equally far before their anchor, so a block may
        hold a part of these distances."""
        start, starts, lead = pos >> 16, pos >> 8 & 0xFF, pos & 0xFF
        before = (start > 0).astype(np.int64)
        lengths = starts + least - 1
        flat = np.frombuffer(b"".join(body) + bytes(256 + least), np.uint8)
        base = np.cumsum(np.array([len(x) for x in body])) - np.array([len(x) for x in body]) + before
        rank = np.empty(len(h), np.int64)
        rank[np.lexsort((start, k, ids))] = np.arange(len(h))
        _, group = np.unique(h, return_inverse=True)
        which = np.repeat(np.arange(len(h)), starts)
        inner = np.arange(len(which)) - np.repeat(np.cumsum(starts) - starts, starts)
        distance = lead[which] - inner
        order = np.argsort(distance, kind="stable")
        which, inner, distance = which[order], inner[order], distance[order]
        width = int(lengths.max())
        view = np.lib.stride_tricks.sliding_window_view(flat, width)
        at = 0
        while at < len(which):
            end = min(len(which), at + BLOCK)
            if end < len(which):  # not within a distance
                end = int(np.searchsorted(distance, distance[end - 1], side="right"))
            w, i = which[at:end], inner[at:end]
            size = lengths[w] - i
            rows = view[base[w] + i].copy()
            rows[np.arange(width)[None, :] >= size[:, None]] = 0
            left = np.where((i > 0) | (before[w] > 0), flat[np.maximum(base[w] + i - 1, 0)].astype(np.int64), -1)
            left[i == 0] = -1  # the string before it has another anchor and is seen elsewhere
            # rank of occurrences within a group at one distance is the rank of their contexts
            many = marked(rows, left, size, group[w] * 256 + distance[at:end], rank[w], least)
            hit = np.flatnonzero(many)
            if len(hit):
                a = start[w[hit]] + i[hit]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids[w[hit]], k[w[hit]], a, a + many[hit])], ["id", "k", "a", "b"])
            at = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def flush(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            yield from blocks(*(np.asarray(batch.column(c)) for c in ("h", "id", "k", "pos")), batch.column("body").to_pylist())

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < 4000:
                continue
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            h = np.asarray(whole.column("h"))
            cut = int(np.searchsorted(h, h[-1]))  # the last anchor may go on
            if cut:
                yield from flush(whole.slice(0, cut))
            held = [whole.slice(cut)]
            rows = len(h) - cut
        if rows:
            yield from flush(pa.Table.from_batches(held).combine_chunks().to_batches()[0])

    return dealt.mapInArrow(run, "id long, k long, a long, b long")


def _split(contexts: DataFrame, least: int) -> DataFrame:
    """Marked spans of contexts whose anchor is too common: one group for each string of ``least`` bytes."""
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                first, starts = r["pos"] >> 16, r["pos"] >> 8 & 0xFF
                body = r["body"][1 if first else 0 :]
                total = prefix_hash(np.frombuffer(body, np.uint8))
                i = np.arange(starts)
                g1 = span_hash(total, i, i + least)
                g2 = span_hash(prefix_hash(np.frombuffer(body, np.uint8) ^ np.uint8(0x5A)), i, i + least) ^ _SECOND
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (g1.view(np.int64), g2.view(np.int64), np.full(starts, r["id"]), np.full(starts, r["k"]), first + i)], ["g1", "g2", "id", "k", "a"])

    every = written(contexts.mapInArrow(strings, "g1 long, g2 long, id long, k long, a long"), "strings")
    place = F.struct("id", "k", "a")
    firsts = written(every.groupBy("g1", "g2").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1"), "firsts")
    return every.join(firsts, ["g1", "g2"]).where(place != F.col("f")).select("id", "k", "a", (F.col("a") + least).alias("b"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, anchor: int = ANCHOR) -> tuple[DataFrame, DataFrame]:
    """The keyed rows and, for each (id, k) with any, ``spans``: its maximal runs of bytes covered by a string of
    ``least`` bytes that also starts earlier (smaller id, or the same row and an earlier start)."""
    rows = _keyed(docs, key, text)
    once = _each_once(rows)
    found = written(_resolve(_runs(once, least, anchor), least), "runs")
    wanted = found.where("contexts").select("h", "id", "k", "a")
    crowded = written(wanted.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CONTEXTS).select("h"), "crowded")
    contexts = written(_contexts(once, wanted, wanted.count(), least), "contexts")
    spans = found.where("not contexts").select("id", "k", "a", "b")
    if n := crowded.count():
        crowd = small_side(crowded, n, 16)
        spans = spans.union(_split(contexts.join(crowd, "h", "left_semi"), least))
        contexts = contexts.join(crowd, "h", "left_anti")
    spans = spans.union(_scan(contexts, least))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            merged = []
            for s in batch.column("s"):
                a, b = (np.asarray(s.values.field(x)) for x in ("a", "b"))
                order = np.argsort(a, kind="stable")
                a, b = a[order], np.maximum.accumulate(b[order])
                new = np.ones(len(a), bool)
                new[1:] = a[1:] > b[:-1]
                f = np.flatnonzero(new)
                merged.append(np.stack([a[f], b[np.append(f[1:], len(a)) - 1]], axis=1).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("k"), pa.array([m.tolist() for m in merged], pa.list_(pa.int64()))], ["id", "k", "spans"])

    grouped = spans.groupBy("id", "k").agg(F.collect_list(F.struct("a", "b")).alias("s"))
    return rows.drop("several"), written(grouped.mapInArrow(merge, "id long, k long, spans array<long>"), "spans")


def repeats_removed(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """Each row's ``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, removed ``spans`` (byte offsets,
    from, to, from, to ...) and, if ``with_text``, the ``kept`` bytes.

    Null texts are empty; texts shorter than ``least`` have no repeats; null ids rank last. Rows alike
    in id and text are one document and lose the same bytes; rows of one id with different texts rank by a hash of the text.
    """
    rows, spans = repeated_spans(docs, key, text, least, anchor)
    size = spans.agg(F.sum(F.size("spans") * 8 + 48)).first()[0] or 0
    both = rows.join(small_side(spans, size, 1), ["id", "k"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            out = []
            for i, s in enumerate(chunk.rows.column("spans").to_pylist()):
                body, kept, at = chunk.text(i), [], 0
                for a, b in zip((s or [])[::2], (s or [])[1::2]):
                    kept.append(body[at:a])
                    at = b
                kept = b"".join([*kept, body[at:]])
                out.append((len(body), len(body) - len(kept), len(s or []) // 2, hashlib.sha256(kept).hexdigest(), s or [], kept if with_text else None))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [chunk.rows.column("id"), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
            )

    done = both.mapInArrow(run, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>, kept binary")
    done = done.withColumn("id", F.when(F.col("id") == _LAST, F.lit(None)).otherwise(F.col("id"))).withColumnRenamed("id", key)
    return done if with_text else done.drop("kept")
