"""Best-fit packing of token sequences (best-two-fit).

Pieces of one length are interchangeable, so the plan depends on the histogram of piece lengths alone, which has at most
``capacity`` entries however many documents there are. The driver runs best-two-fit over that histogram and gets
*patterns*: the lengths in one sequence, and how many sequences have them. A pattern is used as often as the counts
allow, so each use exhausts some length and the number of patterns is bounded by the capacity too. Spark then ranks the
pieces of each length and deals them into the slots.

Tokens come from Arrow batches, since no SQL function tokenizes. The tokens are written to the shared folder once; after
that only ids and lengths move.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import settle

CAPACITY = 2048
END = 0
VOCABULARY = "byte_bpe_50k"
#: Ids that the vocabulary gives to text that spells them out.
SPECIAL = {"<|endoftext|>": 50256}
#: About so many pieces of one length and salt are ranked by one task.
RANKED_TOGETHER = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids binary"


@cache
def _encoder(path: str):
    """The vocabulary's merge ranks as an encoder; its ids are those of the tokenizers library (tests hold both together)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


def tokenize(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, end: int = END) -> DataFrame:
    """Each document (doc_id, text) as pieces of at most ``capacity`` tokens: doc_id, piece, start, length, ids.

    ids are little-endian unsigned 32-bit numbers, and end with ``end``. Null text counts as empty: one piece that holds
    ``end`` alone. Only longer documents are cut; the first piece takes what is left over. Rows that repeat a doc_id are
    documents of their own.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(f"{VOCABULARY}.tiktoken")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(np.array(encoder.encode(text or "", allowed_special="all"), "<u4"), np.uint32(end))
                first = len(ids) % capacity or capacity
                edges = [0, *range(first, len(ids) + 1, capacity)]
                rows += [(doc_id, k, a, b - a, ids[a:b].tobytes()) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInPandas(cut, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns (lengths in a sequence, number of such sequences) for counts of pieces by length.

    A sequence takes the longest piece left, then again and again the longest that fits. Then its smallest piece (not its
    first) gives way to the two pieces left that fill the widened gap most, if they leave less room than it did.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    patterns = []
    while left.any():
        free, taken = left.copy(), []
        room = capacity
        while room and len(fits := np.flatnonzero(free[: room + 1])):
            length = int(fits[-1])
            n = min(int(free[length]), room // length)
            taken += [length] * n
            free[length] -= n
            room -= n * length
        if room and len(taken) > 1:
            gap = room + taken[-1]
            some = np.flatnonzero(free[: gap + 1])
            best = (taken[-1], None)
            for a in some[::-1]:
                if 2 * a <= best[0]:
                    break
                free[a] -= 1
                other = np.flatnonzero(free[: min(a, gap - a) + 1])
                free[a] += 1
                if len(other) and a + other[-1] > best[0]:
                    best = (int(a + other[-1]), (int(a), int(other[-1])))
                    if best[0] == gap:
                        break
            if best[1]:
                taken[-1:] = best[1]
        uses = Counter(taken)
        times = min(int(left[length]) // n for length, n in uses.items())
        for length, n in uses.items():
            left[length] -= n * times
        patterns.append((taken, times))
    return patterns


def _slots(patterns: list[tuple[list[int], int]]) -> pd.DataFrame:
    """Where the pieces of each length go: its pieces from rank ``first`` fill ``per`` places a sequence from ``sequence`` on."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for lengths, times in patterns:
        offset = 0
        for length, per in Counter(lengths).items():
            rows.append((length, used[length], per, sequence, offset))
            used[length] += per * times
            offset += per * length
        sequence += times
    return pd.DataFrame(rows, columns=["length", "first", "per", "sequence", "offset"]).sort_values(["length", "first"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pieces with sequence_id and offset. Needs doc_id, piece and length (1 to capacity); other columns ride along.

    Ranks within a length are counted by (length, salt), so a length that a third of all pieces share is spread over many
    tasks. An empty table gives an empty one.
    """
    spark = pieces.sparkSession
    total = pieces.count()
    salts = max(8, total // RANKED_TOGETHER)
    salted = pieces.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = settle(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "starts")
    by_length = {r["length"]: r["n"] for r in starts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    slots = _slots(best_two_fit(by_length, capacity))
    held = spark.sparkContext.broadcast({c: slots[c].to_numpy() for c in slots})  # bounded by the capacity, not by the documents

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = held.value
        scale = 1 << 44
        keys = s["length"] * scale + s["first"]
        for batch in batches:
            length, rank = batch["length"].to_numpy(), batch["_rank"].to_numpy()
            at = np.searchsorted(keys, length * scale + rank, "right") - 1
            within = rank - s["first"][at]
            batch["sequence_id"] = s["sequence"][at] + within // s["per"][at]
            batch["offset"] = s["offset"][at] + within % s["per"][at] * length
            yield batch.drop(columns="_rank")

    own = Window.partitionBy("length", "_salt").orderBy("doc_id", "piece")
    ranked = salted.join(starts.select("length", "_salt", "_before"), ["length", "_salt"]).withColumn("_rank", F.row_number().over(own) - 1 + F.col("_before"))
    ranked = ranked.select(*pieces.columns, "_rank")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInPandas(deal, f"{kept}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The pieces of all documents with their ids, and the sequence and place of each."""
    return pack(settle(tokenize(docs, capacity, vocabulary), "pieces"), capacity)


def packed_digests(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """pack_documents with ids_crc32 in place of the ids, which are digested before the rows are dealt out."""
    pieces = tokenize(docs, capacity, vocabulary).withColumn("ids", F.crc32("ids"))
    return pack(settle(pieces.withColumnRenamed("ids", "ids_crc32"), "pieces"), capacity)
