"""Vector code compression: product codes whose codebooks are trained by a heap Lloyd.

Vectors are cut into equal parts, and each part position has a codebook of its own. A part keeps the slack between its bounds:
the distance to its second nearest entry less that to its own. Entries move, so slack is used up by the drift of its own
entry and by the largest drift of another. Each task keeps, for each block and each entry, a heap of the entry's parts by
slack plus the drift at the time it was measured. A round pops only parts whose key the cumulative drift has passed, scans
all entries exactly for those and pushes them back; all others surely stay. The state of a block (codes, keys, heaps) is a
row of a table in the shared folder, written once a round, so a lost executor costs the tasks it ran. Codebooks (entries
times dimension) are all that the driver and the closures hold.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, settle, small
from tidemark.llm.vector_blocks import BLOCK, exact_kind, in_blocks, longs, packed_longs, squared, whole

PARTS, ENTRIES, ROUNDS = 16, 64, 2

BLOCKS = "n int, ids binary, ids_there binary, labels binary, labels_there binary, vectors binary"
STATE = BLOCKS + ", codes binary, keys binary, heaps binary, starts binary, moved binary, popped long"


def violated(heap: np.ndarray, starts: np.ndarray, keys: np.ndarray, drift: np.ndarray) -> np.ndarray:
    """Members of the heaps whose key the drift of their entry has reached.

    heap holds members; those of entry j stand at starts[j] to starts[j + 1], as a binary heap by key. All heaps are walked
    together, a level at a time, and only below members that are violated themselves.
    """
    sizes, found = np.diff(starts), [np.zeros(0, np.int64)]
    entry = np.flatnonzero(sizes)
    node = np.zeros(len(entry), np.int64)
    while len(entry):
        member = heap[starts[entry] + node]
        bad = keys[member] <= drift[entry]
        entry, node = np.repeat(entry[bad], 2), np.repeat(2 * node[bad], 2) + np.tile([1, 2], int(bad.sum()))
        found.append(member[bad])
        there = node < sizes[entry]
        entry, node = entry[there], node[there]
    return np.concatenate(found)


def heaped(codes: np.ndarray, keys: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """(heap, starts) of all members: a run sorted by key is a heap."""
    return np.lexsort((keys, codes)), np.searchsorted(np.sort(codes), np.arange(entries + 1))


def scanned(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry of each part (ties to the lower index), and the slack to the next; infinite if there is no other."""
    kind = exact_kind(x, book)
    d2 = squared(x.astype(kind), book.astype(kind))
    code = d2.argmin(axis=1)
    if len(book) == 1:
        return code, np.full(len(x), np.inf)
    two = np.sqrt(np.partition(d2, 1, axis=1)[:, :2].astype(np.float64))
    return code, two[:, 1] - two[:, 0]


def drifts(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """By part position and entry, by how much a slack may have shrunk: the entry's own way and the longest of another."""
    way = np.sqrt(((after - before).astype(np.float64) ** 2).sum(axis=2))
    if way.shape[1] == 1:
        return way
    first, second = np.sort(way, axis=1)[:, -1:], np.sort(way, axis=1)[:, -2:-1]
    other = np.where(np.arange(way.shape[1])[None, :] == way.argmax(axis=1)[:, None], second, first)
    return (way + other) * (1 + 1e-9) + 1e-6


def _cut(vectors: bytes, n: int, parts: int) -> np.ndarray:
    """By part position, vector and place."""
    return np.frombuffer(vectors, "<i4").reshape(n, parts, -1).transpose(1, 0, 2).astype(np.int64)


def _blocks(rows: DataFrame, dim: int, most: int) -> DataFrame:
    def make(found: pd.DataFrame, x: np.ndarray) -> tuple:
        return len(x), *packed_longs(found["vec_id"]), *packed_longs(found["label"]), x.astype("<i4").tobytes()

    return in_blocks(rows, dim, make, BLOCKS, most)


def _step(blocks: DataFrame, books: np.ndarray, drift: np.ndarray | None) -> DataFrame:
    """The state after all parts are assigned to the books: all scanned where drift is None, else those that are popped.

    moved holds what each entry's sums and counts gain and lose.
    """
    parts, entries, width = books.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x = _cut(r.vectors, r.n, parts)
                moved, popped = np.zeros((parts, entries, width + 1), np.int64), 0
                codes, keys = np.zeros((parts, r.n), "<i2"), np.zeros((parts, r.n))
                heaps, starts = np.zeros((parts, r.n), "<i4"), np.zeros((parts, entries + 1), "<i4")
                if drift is not None:
                    codes[:], keys[:] = np.frombuffer(r.codes, "<i2").reshape(parts, -1), np.frombuffer(r.keys, "<f8").reshape(parts, -1)
                    heaps[:], starts[:] = np.frombuffer(r.heaps, "<i4").reshape(parts, -1), np.frombuffer(r.starts, "<i4").reshape(parts, -1)
                for p in range(parts):
                    out = np.arange(r.n) if drift is None else violated(heaps[p], starts[p], keys[p], drift[p])
                    popped += len(out)
                    if not len(out):
                        continue
                    own = np.concatenate([x[p][out], np.ones((len(out), 1), np.int64)], axis=1)
                    new, slack = scanned(x[p][out], books[p])
                    changed = np.full(len(out), True) if drift is None else new != codes[p][out]
                    np.add.at(moved[p], new[changed], own[changed])
                    if drift is not None:
                        np.subtract.at(moved[p], codes[p][out][changed], own[changed])
                    codes[p][out], keys[p][out] = new, slack + (0 if drift is None else drift[p][new])
                    heaps[p], starts[p] = heaped(codes[p], keys[p], entries)
                state = (codes.tobytes(), keys.tobytes(), heaps.tobytes(), starts.tobytes(), moved.astype("<i8").tobytes(), popped)
                yield pd.DataFrame([(r.n, r.ids, r.ids_there, r.labels, r.labels_there, r.vectors, *state)], columns=[c.split()[0] for c in STATE.split(", ")])

    return blocks.mapInPandas(run, STATE)


def _moved(state: DataFrame, shape: tuple[int, int, int]) -> np.ndarray:
    """What moved in all blocks, added up by cell in Spark: as many cells as the codebooks have numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(shape, np.int64).ravel()
        for batch in batches:
            for moved in batch["moved"]:
                total += np.frombuffer(moved, "<i8")
        cells = np.flatnonzero(total)
        yield pd.DataFrame({"cell": cells, "total": total[cells]})

    out = np.zeros(shape, object).ravel()
    for r in state.select("moved").mapInPandas(run, "cell int, total long").groupBy("cell").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect():
        out[r.cell] = int(r.total)
    return out.reshape(shape)


def _coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    parts = len(books)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                x, codes = _cut(r.vectors, r.n, parts), np.frombuffer(r.codes, "<i2").reshape(parts, -1)
                error = sum(((x[p] - books[p][codes[p]]) ** 2).sum(axis=1) for p in range(parts))
                yield pd.DataFrame({"vec_id": longs(r.ids, r.ids_there), "label": longs(r.labels, r.labels_there), "codes": list(codes.T.astype(np.int32)), "error": error})

    return state.select("n", "ids", "ids_there", "labels", "labels_there", "vectors", "codes").mapInPandas(run, "vec_id long, label long, codes array<int>, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, most: int = BLOCK) -> tuple[DataFrame, np.ndarray, list[int]]:
    """(vec_id, label, codes, error for each sound vector; the codebooks by part, entry and place; how many parts each round scanned).

    vectors has vec_id and embedding and may have a whole-number label; other columns are passed over. Vectors that are null
    or hold null or non-finite components are dropped; components count as floor(256 * x), within 2^26 of 0. All others are
    rows of the result. The dimension is that of the vector with the smallest vec_id (of repeated ones, the smallest vector);
    vectors of another dimension, and all if it isn't a multiple of parts, have neither codes nor an error. Rows without a
    vec_id are coded but start no entry; repeated rows count as often. Fewer rows than entries make smaller codebooks, and
    none make an empty result. An entry that gets no part stays where it is.
    """
    if "label" not in {c.lower() for c in vectors.columns}:
        vectors = vectors.withColumn("label", F.lit(None).cast("long"))
    rows = whole(vectors.withColumn("label", F.col("label").cast("long")), "label")
    start = rows.where("vec_id is not null").select("vec_id", "parts").orderBy("vec_id", "parts").limit(1).collect()
    dim = len(start[0].parts) if start else 0
    if not dim or dim % parts:
        return rows.select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error")), np.zeros((parts, 0, 0), np.int64), []
    first = rows.where(F.col("vec_id").isNotNull() & (F.size("parts") == dim)).select("vec_id", "parts").orderBy("vec_id", "parts").limit(entries).collect()  # entries rows
    books = np.array([r.parts for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2).copy()
    others = rows.where(F.size("parts") != dim).select("vec_id", "label", F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    state = settle(_step(_blocks(rows, dim, most), books, None), "codes")
    popped = [state.agg(F.sum("popped")).first()[0] or 0]
    sums, drift = _moved(state, (*books.shape[:2], books.shape[2] + 1)), np.zeros(books.shape[:2])
    for _ in range(rounds):
        before = books.copy()
        for p, j in zip(*np.nonzero(sums[:, :, -1]), strict=True):
            books[p, j] = [t // sums[p, j, -1] for t in sums[p, j, :-1]]
        drift = drift + drifts(before, books)
        last, state = state, settle(_step(state, books, drift), "codes")
        sums = sums + _moved(state, sums.shape)
        popped.append(state.agg(F.sum("popped")).first()[0] or 0)
        drop(last)
    return _coded(state, books).unionByName(others), books, popped


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def reported(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (the sum over rows of an equal label, nulls together), codebooks_sha256."""
    coded, books, _ = compress(vectors)
    coded = settle(coded, "coded")
    by_label = settle(coded.groupBy("label").agg(F.sum("error").alias("label_error")), "labels")
    code = F.array_join(F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return (
        coded.alias("c")
        .join(small(by_label).alias("l"), F.col("c.label").eqNullSafe(F.col("l.label")))
        .select("vec_id", F.when(F.col("codes").isNotNull(), code).alias("code"), "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
    )
