"""Exact substring deduplication by sorted suffixes: every byte of a long string that starts earlier too is removed.

Sorting a suffix for every byte would move a hundred times the corpus, so suffixes are taken at anchors only. In any string
of LENGTH bytes one position is its anchor: the first of those GRAM-byte pieces whose hash is least (winnowing). Equal
strings have their anchor at the same place, and neighbouring strings share one, so there is an anchor per 35 bytes or so.

1. Anchors are packed and dealt to buckets by the hash of their piece. Those whose piece occurs nowhere else can't repeat
   and are left out; this decides nothing else.
2. The contexts of all others (all strings that they stand for) are sorted as suffixes from the anchor on: each task makes
   sorted runs, front-coded (the length that a suffix has in common with the one before, and the rest). The runs of a bucket
   are combined by a loser tree that knows how much each head has in common with the last winner, and compares only what
   comes after that.
3. Of neighbours in the merged order the common lengths are known, so are the classes of suffixes that agree in their
   first n bytes. With the same for what stands before the anchor, strings are equal if both classes are; all but the first
   of a class are removed.
4. Removed ranges are united by document and cut from the texts.

In a run, a repeated suffix costs its place alone. Positions count bytes of UTF-8; matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, settle
from tidemark.llm.text_vectors import Chunk, Hashes, chunks, mixed

LENGTH = 100
GRAM = 32
#: Anchors that a task holds before it sorts and sends them; suffixes in a sorted run.
HELD = 1 << 20
RUN = 200_000
#: Anchors in a bucket, about.
BUCKET = 1_000_000

PACKED = "kind int, bucket long, docs binary, starts binary, ends binary, at binary, fps binary"


def anchors(chunk: Chunk, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchors of a chunk: positions, first and last start of the strings they stand for, hashes of their pieces."""
    data, bounds = chunk.data, chunk.bounds
    n, wide = len(data), length - gram + 1
    nothing = np.zeros(0, np.int64)
    if n < length:
        return nothing, nothing, nothing, nothing.astype(np.uint64)
    hashes = Hashes(data)
    pieces = hashes.of(np.arange(n - gram + 1), np.arange(gram, n + 1))
    bits = np.uint64(max(24, int(n).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    size = -(-n // wide) * wide
    key = np.full(size, ~np.uint64(0))
    key[: len(pieces)] = (pieces & ~low) | np.arange(len(pieces), dtype=np.uint64)
    rows = key.reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    ends = np.repeat(bounds[1:], np.diff(bounds))
    starts = np.flatnonzero(ends - np.arange(n) >= length)
    if not len(starts):
        return nothing, nothing, nothing, nothing.astype(np.uint64)
    at = (np.minimum(behind[starts], ahead[starts + wide - 1]) & low).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
    at, lo, hi = at[edge[:-1]], starts[edge[:-1]], starts[edge[1:] - 1]
    return at, lo, hi, pieces[at]


def united(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges as the fewest that cover the same, sorted by document and start. Ranges that touch become one."""
    if not len(docs):
        return docs, starts, ends
    order = np.lexsort((starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    new = np.concatenate([[True], docs[1:] != docs[:-1]])
    block = np.cumsum(new) - 1
    # a running maximum of the ends that begins anew with each document
    span = int(ends.max()) + 1
    reach = np.maximum.accumulate(ends + block * span) - block * span
    new[1:] |= starts[1:] > reach[:-1]
    first = np.flatnonzero(new)
    return docs[first], starts[first], np.maximum.reduceat(ends, first)


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Of sorted rows: for each, the place of the first row with the same keys."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


def _bytes(x: np.ndarray, kind: str = "<i8") -> bytes:
    return x.astype(kind).tobytes()


def _packs(kind: int, bucket: np.ndarray, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Rows of PACKED: one for each bucket, with the columns' values of its rows."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]])) if len(bucket) else np.zeros(1, np.int64)
    spans = list(zip(edges, edges[1:], strict=False))
    names = ["docs", "starts", "ends", "at", "fps"]
    kinds = {"docs": "<i8", "fps": "<u8"}
    held = {c: columns[c][order].astype(kinds.get(c, "<i4" if not len(columns[c]) or columns[c].max() < 2**31 else "<i8")) for c in names if c in columns}
    cut = [pa.array([held[c][a:b].tobytes() if c in held else None for a, b in spans], pa.binary()) for c in names]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(spans), kind, np.int32)), pa.array(bucket[edges[:-1]].astype(np.int64)), *cut], ["kind", "bucket", *names])


def _unpack(rows: pd.DataFrame, names: tuple[str, ...]) -> dict[str, np.ndarray]:
    out = {}
    for c in names:
        kind = {"docs": "<i8", "fps": "<u8"}.get(c)
        parts = [np.frombuffer(x, kind or ("<i4" if len(x) * 2 == len(d) else "<i8")) for x, d in zip(rows[c], rows["docs"], strict=True)]
        out[c] = np.concatenate(parts) if parts else np.zeros(0, kind or "<i8")
        if kind is None:
            out[c] = out[c].astype(np.int64)
    return out


def find_anchors(docs: DataFrame, buckets: int, length: int, gram: int) -> DataFrame:
    """Packs of kind 0: anchors by the hash of their piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal held, size
            doc, at, lo, hi, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            return _packs(0, mixed(fp) % np.uint64(buckets), {"docs": doc, "starts": lo, "ends": hi, "at": at, "fps": fp})

        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for chunk in chunks(batch.column("text")):
                at, lo, hi, fp = anchors(chunk, length, gram)
                row = np.searchsorted(chunk.bounds, at, "right") - 1
                begin = chunk.bounds[row]
                held.append((ids[chunk.first + row].astype(np.int64), at - begin, lo - begin, hi - begin, fp))
                size += len(at)
                if size > HELD:
                    yield packed()
        if held:
            yield packed()

    return docs.mapInArrow(run, PACKED)


def compare_anchors(packs: DataFrame, buckets: int) -> DataFrame:
    """Packs of kind 2, by document: the anchors whose piece occurs in another place too."""

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        x = _unpack(rows, ("docs", "starts", "ends", "at", "fps"))
        order = np.lexsort((x["at"], x["docs"], x["fps"]))
        x = {c: v[order] for c, v in x.items()}
        # rows that repeat a doc_id have the same anchors twice
        new = np.ones(len(order), bool)
        new[1:] = (x["fps"][1:] != x["fps"][:-1]) | (x["docs"][1:] != x["docs"][:-1]) | (x["at"][1:] != x["at"][:-1])
        group = _first_of(x["fps"])
        many = np.bincount(group, weights=new, minlength=len(group))[group] > 1
        return _packs(2, mixed(x["docs"][many].view(np.uint64)) % np.uint64(buckets), {c: v[many] for c, v in x.items()}).to_pandas()

    return packs.groupBy("bucket").applyInPandas(run, PACKED)


def by_document(packs: DataFrame) -> DataFrame:
    """doc_id, gone (united ranges: start and end in turn), close (anchors: at, first start, last start, piece in turn)."""

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        x = _unpack(rows[rows["kind"] == 1], ("docs", "starts", "ends"))
        doc, lo, hi = united(x["docs"], x["starts"], x["ends"])
        y = _unpack(rows[rows["kind"] == 2], ("docs", "starts", "ends", "at", "fps"))
        order = np.lexsort((y["at"], y["docs"]))
        spans = np.stack([lo, hi], 1)
        close = np.stack([y["at"], y["starts"], y["ends"], y["fps"].view(np.int64)], 1)[order] if len(order) else np.zeros((0, 4), np.int64)
        ids = np.unique(np.concatenate([doc, y["docs"]]))
        cut = lambda table, own: [_bytes(table[a:b]) for a, b in zip(np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right"), strict=True)]
        return pd.DataFrame({"doc_id": ids.astype(np.int64), "gone": cut(spans, doc), "close": cut(close, y["docs"][order])})

    return packs.groupBy("bucket").applyInPandas(run, "doc_id long, gone binary, close binary")


def common_length(x: bytes, y: bytes, known: int) -> int:
    """How many first bytes two strings share; known of them are known to be equal."""
    most = min(len(x), len(y))
    step = 16
    at = known
    while at < most and x[at : at + step] == y[at : at + step]:
        at += step
    while at < most and x[at] == y[at]:
        at += 1
    return min(at, most)


class LoserTree:
    """Merges sorted runs of (suffix, common length with the run's suffix before it).

    Every loser keeps what it has in common with the winner that beat it, which is what was given out last when its match
    is played again. So of two heads the one with more in common with the last winner is the smaller, without a look at
    either; only heads that have equally much are compared, and only beyond that.
    """

    def __init__(self, runs: list[tuple[list[bytes], list[int]]]) -> None:
        self.runs = runs
        self.next = [0] * len(runs)
        self.size = 1
        while self.size < len(runs):
            self.size *= 2
        self.losers: list[tuple[int, int]] = [(-1, 0)] * self.size
        self.winner = self._play(1)

    def _head(self, run: int) -> bytes | None:
        if run < 0 or run >= len(self.runs) or self.next[run] >= len(self.runs[run][0]):
            return None
        return self.runs[run][0][self.next[run]]

    def _match(self, a: tuple[int, int], b: tuple[int, int]) -> tuple[tuple[int, int], tuple[int, int]]:
        """Winner and loser; the loser's length is now what it shares with the winner."""
        x, y = self._head(a[0]), self._head(b[0])
        if x is None:
            return b, a
        if y is None:
            return a, b
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        n = common_length(x, y, a[1])
        first = x[n : n + 1] < y[n : n + 1] or (len(x) == len(y) == n and a[0] < b[0])
        return (a, (b[0], n)) if first else (b, (a[0], n))

    def _play(self, node: int) -> tuple[int, int]:
        if node >= self.size:
            return node - self.size, 0
        best, self.losers[node] = self._match(self._play(2 * node), self._play(2 * node + 1))
        return best

    def merged(self) -> Iterator[tuple[int, int, int]]:
        """(run, place in it, common length with the suffix given out before) in order."""
        while (self._head(self.winner[0])) is not None:
            run, shared = self.winner
            place = self.next[run]
            yield run, place, shared
            self.next[run] += 1
            now = (run, self.runs[run][1][place + 1] if place + 1 < len(self.runs[run][0]) else 0)
            node = (run + self.size) // 2
            while node:
                now, self.losers[node] = self._match(now, self.losers[node])
                node //= 2
            self.winner = now


RUNS = "bucket long, shared binary, sizes binary, rest binary, left_sizes binary, lefts binary, docs binary, at binary, lo binary, hi binary"


def sorted_runs(texts: DataFrame, buckets: int, length: int) -> DataFrame:
    """Front-coded sorted runs of the suffixes at the anchors in ``close``, by the hash of their piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def coded() -> pa.RecordBatch:
            nonlocal held
            held.sort()
            rows = []
            lo = 0
            for k in range(1, len(held) + 1):
                if k < len(held) and held[k][0] == held[lo][0]:
                    continue
                part = held[lo:k]
                shared = [0, *(common_length(x[1], y[1], 0) for x, y in zip(part, part[1:], strict=False))]
                number = lambda values, kind="<i8": np.array(values, kind).tobytes()
                rows.append((part[0][0], number(shared, "<u2"), number([len(x[1]) for x in part], "<u2"), b"".join(x[1][n:] for x, n in zip(part, shared, strict=True)), number([len(x[2]) for x in part], "<u2"), b"".join(x[2] for x in part), *(number([x[i] for x in part]) for i in (3, 4, 5, 6))))
                lo = k
            held = []
            return pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["bucket", "shared", "sizes", "rest", "left_sizes", "lefts", "docs", "at", "lo", "hi"]), preserve_index=False)

        for batch in batches:
            for doc_id, text, close in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("close").to_pylist(), strict=True):
                data = (text or "").encode()
                for at, lo, hi, fp in np.frombuffer(close, "<i8").reshape(-1, 4).tolist():
                    held.append((int(np.uint64(fp & (2**64 - 1)) % np.uint64(buckets)), data[at : hi + length], data[lo:at][::-1], doc_id, at, lo, hi))
                if len(held) > RUN:
                    yield coded()
        if held:
            yield coded()

    return texts.mapInArrow(run, RUNS)


def _classes(order: np.ndarray, shared: np.ndarray, n: int) -> np.ndarray:
    """By row: the class of strings that agree in their first n bytes. order: rows in string order; shared: with the one before."""
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(shared < n)
    return out


def merge_runs(runs: DataFrame, buckets: int, length: int) -> DataFrame:
    """Packs of kind 1 by document: ranges of strings that occur earlier, from the merged runs of each bucket."""

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        decoded, lefts, facts = [], [], []
        for r in rows.itertuples(index=False):
            shared, sizes, lsizes = (np.frombuffer(x, "<u2").tolist() for x in (r.shared, r.sizes, r.left_sizes))
            strings, before, pos, lpos = [], b"", 0, 0
            for n, size in zip(shared, sizes, strict=True):
                before = before[:n] + r.rest[pos : pos + size - n]
                pos += size - n
                strings.append(before)
            for size in lsizes:
                lefts.append(r.lefts[lpos : lpos + size])
                lpos += size
            decoded.append((strings, shared))
            facts.append(np.stack([np.frombuffer(x, "<i8") for x in (r.docs, r.at, r.lo, r.hi)], 1))
        base = np.cumsum([0, *(len(s) for s, _ in decoded)])
        merged = np.array([(base[i] + place, n) for i, place, n in LoserTree(decoded).merged()], np.int64).reshape(-1, 2)
        doc, at, lo, hi = np.concatenate(facts).T
        left_order = np.array(sorted(range(len(lefts)), key=lefts.__getitem__), np.int64)
        left_shared = np.array([0, *(common_length(lefts[a], lefts[b], 0) for a, b in zip(left_order, left_order[1:], strict=False))], np.int64)
        room = at - lo
        gone: list[tuple] = []
        for before in range(int(room.max()) + 1):
            use = np.flatnonzero((at - before >= lo) & (at - before <= hi))
            if len(use) < 2:
                continue
            left, right = _classes(left_order, left_shared, before)[use], _classes(merged[:, 0], merged[:, 1], length - before)[use]
            order = np.lexsort((at[use], doc[use], left, right))
            first = order[_first_of(right[order], left[order])]
            a, b = use[order], use[first]
            later = a[(doc[a] != doc[b]) | (at[a] != at[b])]
            gone.append((doc[later], at[later] - before, at[later] - before + length))
        doc, lo, hi = united(*(np.concatenate(x) for x in zip(*gone, strict=True))) if gone else (np.zeros(0, np.int64),) * 3
        return _packs(1, mixed(doc.view(np.uint64)) % np.uint64(buckets), {"docs": doc, "starts": lo, "ends": hi}).to_pandas()

    return runs.groupBy("bucket").applyInPandas(run, PACKED)


def dedup(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (array of start, end), kept (binary) for each row of (doc_id, text).

    A byte is removed if a string of ``length`` bytes that covers it also starts earlier: in a document with a smaller id,
    or before it in the same one. Strings are judged on the input. Null texts are empty, and nothing is removed from texts
    shorter than ``length``. Rows that repeat a doc_id count as one document, which is not earlier than itself. Rows without
    a doc_id keep their text whole. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    known = docs.where("doc_id is not null")
    total = known.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 30 // BUCKET)
    packs = settle(compare_anchors(find_anchors(known, buckets, length, gram), buckets), "anchors")
    marked = settle(by_document(packs).select(F.col("doc_id").alias("_id"), "close"), "marked")
    # what is joined to the texts grows as they do, so these joins shuffle at every size
    close = known.join(marked.hint("merge"), F.col("doc_id") == F.col("_id")).drop("_id")
    later = settle(merge_runs(sorted_runs(close, buckets, length), buckets, length), "later")
    drop(packs, marked)
    spans = settle(by_document(later).select(F.col("doc_id").alias("_id"), "gone"), "spans")
    drop(later)
    joined = docs.join(spans.hint("merge"), F.col("doc_id") == F.col("_id"), "left").drop("_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                data = text.encode()
                ranges = [(a, min(b, len(data))) for a, b in np.frombuffer(gone or b"", "<i8").reshape(-1, 2).tolist() if a < len(data)]
                kept, at = [], 0
                for a, b in ranges:
                    kept.append(data[at:a])
                    at = b
                kept.append(data[at:])
                out.append((len(data), sum(b - a for a, b in ranges), [{"start": a, "end": b} for a, b in ranges], b"".join(kept)))
            n, removed, ranges, kept = zip(*out, strict=True) if out else ((),) * 4
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(ranges, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])

    return joined.select("doc_id", "text", "gone").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary")
