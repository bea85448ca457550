"""N-gram Jaccard join with prefix trees: every link between documents whose shingle sets are similar enough.

1. Each text becomes its set of word shingles (64-bit hashes). Documents with equal sets are one class; from here on only
   classes count. Shingles that many classes share are counted over all documents.
2. A global order puts those frequent shingles last. Two similar sets share a shingle among the first of both (prefix
   filter), so classes meet by the shingles of their prefixes. These are dealt to buckets in packed arrays.
3. Where few classes share a shingle, their pairs are counted; a pair that shares too few prefix shingles for what can
   still come after them is dropped. Where many do (families of near copies), each class is paired with the first
   of them only; what these pairs leave apart is joined block by block.
4. Pairs are verified exactly. A class's partners stand in a prefix tree: their sets in global order, sorted, with the
   length each has in common with the one before. A set takes over the overlap counted for the prefix it shares, and a
   subtree is left as soon as the rest of the query's set can't reach the threshold.
5. Links become components by distributed union-find.

No step gathers a whole group of copies or of documents with a common passage: copies collapse inside a task first, hot
classes are salted, and frequent shingles come last.
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
from tidemark.llm.components import components
from tidemark.llm.text_vectors import Chunk, chunks, mixed, shingles

WORDS = 5
PERCENT = 75
#: A shingle is put last in the order if so many classes have it, counting the tasks' files in which FEW have it.
FREQUENT = 12
FEW = 2
#: So many shingles are put last at most (8 bytes each are broadcast): the most frequent. Others only cost time.
MOST_FREQUENT = 1_000_000
#: Members of a larger group that all others of it are compared with first.
HUBS = 5
#: Groups of so many classes give all their pairs to be counted.
SMALL = 48
#: Prefix shingles in a bucket, about; partners of a class that are verified together, about.
BUCKET = 1_000_000
TOGETHER = 512
#: Bits of the sieve that rows without a wanted doc_id are kept out of a shuffle by: 8 MB, whatever the number of rows.
SIEVE = 1 << 26
#: Tasks hold so many packed shingles before they hand them on.
HELD = 1 << 20

TOP = np.uint64(1 << 63)


def shingle_sets(chunk: Chunk, size: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles of all rows, one row after the other; where each begins, how many it has, its digest."""
    rows, h = shingles(chunk, size)
    h = h >> np.uint64(1)
    order = np.lexsort((h, rows))
    rows, h = rows[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (h[1:] != h[:-1])
    rows, h = rows[new], h[new]
    n = np.bincount(rows, minlength=chunk.rows)
    starts = np.cumsum(n) - n
    digest = np.zeros(chunk.rows, np.uint64)
    if len(h):
        some = n > 0
        one = np.add.reduceat(mixed(h), starts[some])
        two = np.add.reduceat(mixed(h ^ np.uint64(0x5851F42D4C957F2D)), starts[some])
        digest[some] = mixed(one * np.uint64(0x2545F4914F6CDD1D) + mixed(two) + n[some].astype(np.uint64))
    return h, starts, n, digest


def prefix_length(n, percent: int = PERCENT):
    """How many of a set's first shingles are compared: any similar set has one of them among its own first."""
    return n + (-percent * n) // 100 + 1


def overlap_needed(n, m, percent: int = PERCENT):
    """The least overlap with which sets of sizes n and m are similar."""
    return -((-percent * (n + m)) // (100 + percent))


def packed(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each token, in order."""
    return np.ascontiguousarray(tokens.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.uint64)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def classes(docs: DataFrame, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, cid) of all rows, and (token, seen): shingles by the classes that have them, where a file has FEW."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held, size = [], 0

        def counted(least: int):
            nonlocal held, size
            keys = np.concatenate([k for k, _ in held]) if held else np.zeros(0, np.uint64)
            counts = np.concatenate([c for _, c in held]) if held else np.zeros(0, np.int64)
            keys, back = np.unique(keys, return_inverse=True)
            counts = np.bincount(back, weights=counts, minlength=len(keys)).astype(np.int64)
            keep = counts >= least
            held, size = [(keys[keep], counts[keep])], int(keep.sum())

        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64())
            for chunk in chunks(batch.column("text")):
                h, starts, n, digest = shingle_sets(chunk, words)
                fresh = []
                for i, d in enumerate(digest.tolist()):
                    if n[i] and d not in known:
                        known.add(d)
                        fresh.append(i)
                own = np.zeros(chunk.rows, bool)
                own[fresh] = True
                mine = h[np.repeat(own, n)]
                held.append((mine, np.ones(len(mine), np.int64)))
                size += len(mine)
                if size > 8 * HELD:
                    counted(2)
                nothing = pa.nulls(chunk.rows, pa.int64())
                yield pa.RecordBatch.from_arrays([ids[chunk.first : chunk.first + chunk.rows], pa.array(n.astype(np.int64)), _signed(digest), nothing, nothing], ["doc_id", "n", "cid", "token", "seen"])
        counted(FEW)
        keys, counts = held[0]
        nothing = pa.nulls(len(keys), pa.int64())
        yield pa.RecordBatch.from_arrays([nothing, nothing, nothing, _signed(keys), pa.array(counts)], ["doc_id", "n", "cid", "token", "seen"])

    both = settle(docs.mapInArrow(run, "doc_id long, n long, cid long, token long, seen long"), "classes")
    return both.where("seen is null").select("doc_id", "n", "cid"), both.where("seen is not null").select("token", "seen")


def _ordered(chunk: Chunk, words: int, last: np.ndarray):
    """shingle_sets in the global order: those in ``last`` get the highest bit, and so come last."""
    h, starts, n, digest = shingle_sets(chunk, words)
    if len(last) and len(h):
        at = np.minimum(np.searchsorted(last, h), len(last) - 1)
        h = np.where(last[at] == h, h | TOP, h)
        rows = np.repeat(np.arange(len(n)), n)
        h = h[np.lexsort((h, rows))]
    return h, starts, n, digest


def prefixes(docs: DataFrame, last, buckets: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The prefix shingles of all classes, packed by bucket: tokens, class ids and set sizes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: set[int] = set()
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size
            token, cid, n = (np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
            bucket = (mixed(token) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            bucket, token, cid, n = bucket[order], token[order], cid[order], n[order]
            edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
            cut = lambda x, t: pa.array([x[a:b].astype(t).tobytes() for a, b in zip(edges, edges[1:], strict=False)], pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(bucket[edges[:-1]]), cut(token, "<u8"), cut(cid, "<u8"), cut(n, "<i4")], ["bucket", "tokens", "cids", "sizes"])

        for batch in batches:
            for chunk in chunks(batch.column("text")):
                h, starts, n, digest = _ordered(chunk, words, last.value)
                fresh = []
                for i, d in enumerate(digest.tolist()):
                    if n[i] and d not in known:
                        known.add(d)
                        fresh.append(i)
                if not fresh:
                    continue
                rows = np.array(fresh)
                p = prefix_length(n[rows], percent)
                at = np.repeat(starts[rows] - (np.cumsum(p) - p), p) + np.arange(p.sum())
                held.append((h[at], np.repeat(digest[rows], p), np.repeat(n[rows], p)))
                size += len(at)
                if size > HELD:
                    yield flush()
        if held:
            yield flush()

    return docs.mapInArrow(run, "bucket long, tokens binary, cids binary, sizes binary")


def meet(packed: DataFrame, small: int = SMALL, percent: int = PERCENT) -> DataFrame:
    """Rows of kind 0: pairs (a, b) of classes with sizes na, nb that share c prefix shingles of small groups; of kind 1:
    members (token a, class b, size na) of larger groups."""

    def run(key: tuple[Any, ...], parts: pd.DataFrame) -> pd.DataFrame:
        token = np.frombuffer(b"".join(parts["tokens"]), "<u8")
        cid = np.frombuffer(b"".join(parts["cids"]), "<u8")
        n = np.frombuffer(b"".join(parts["sizes"]), "<i4")
        order = np.lexsort((cid, token))
        token, cid, n = token[order], cid[order], n[order]
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (cid[1:] != cid[:-1])])
        token, cid, n = token[new], cid[new], n[new].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        count = np.diff(np.append(first, len(token)))
        a, b, c, na, nb = [], [], [], [], []

        def flush(x, y):
            fits = 100 * np.minimum(n[x], n[y]) >= percent * np.maximum(n[x], n[y])
            x, y = x[fits], y[fits]
            order = np.lexsort((cid[y], cid[x]))
            x, y = x[order], y[order]
            edge = np.flatnonzero(np.concatenate([[True], (cid[x][1:] != cid[x][:-1]) | (cid[y][1:] != cid[y][:-1])])) if len(x) else np.zeros(0, np.int64)
            a.append(cid[x[edge]])
            b.append(cid[y[edge]])
            c.append(np.diff(np.append(edge, len(x))))
            na.append(n[x[edge]])
            nb.append(n[y[edge]])

        held, size = [], 0
        for s in range(2, small + 1):
            groups = first[count == s]
            left, right = np.triu_indices(s, 1)
            step = max(1, 1_000_000 // len(left))
            for lo in range(0, len(groups), step):
                g = groups[lo : lo + step, None]
                held.append(((g + left).ravel(), (g + right).ravel()))
                size += held[-1][0].size
                if size > 2_000_000:
                    flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            flush(*(np.concatenate(x) for x in zip(*held, strict=True)))
        big = np.repeat(count > small, count)
        join = lambda xs, t: np.concatenate([*xs, np.zeros(0, t)]).astype(t)
        pairs = pd.DataFrame({"kind": 0, "a": join(a, "<u8").view(np.int64), "b": join(b, "<u8").view(np.int64), "c": join(c, np.int64), "na": join(na, np.int64), "nb": join(nb, np.int64)})
        members = pd.DataFrame({"kind": 1, "a": token[big].view(np.int64), "b": cid[big].view(np.int64), "c": 0, "na": n[big], "nb": 0})
        return pd.concat([pairs, members], ignore_index=True)

    return packed.groupBy("bucket").applyInPandas(run, "kind int, a long, b long, c long, na long, nb long")


class PrefixTree:
    """Sets in global order as a tree: sorted, each with the length it has in common with the one before."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
        self.sets = [sets[i] for i in self.order]
        self.common = [0] * min(1, len(sets))
        for x, y in zip(self.sets, self.sets[1:], strict=False):
            k = min(len(x), len(y))
            other = np.flatnonzero(x[:k] != y[:k])
            self.common.append(int(other[0]) if len(other) else k)

    def similar(self, query: np.ndarray, percent: int = PERCENT, skip=lambda i: False, block: int = 64) -> Iterator[int]:
        """Places (in the list that the tree was made of) of all sets similar to the query."""
        m = len(query)
        fewest = overlap_needed(m, -((-percent * m) // 100), percent)  # for the smallest set that can be similar
        counted = [0]  # by depth, in steps of a block: what the current path shares with the query
        left_at = None  # depth at which the current path was left
        for place, s, common in zip(self.order, self.sets, self.common, strict=True):
            if left_at is not None and common >= left_at:
                continue
            left_at = None
            n = len(s)
            depth = min(common // block, len(counted) - 1)
            del counted[depth + 1 :]
            if skip(place) or 100 * min(n, m) < percent * max(n, m):
                continue
            need = overlap_needed(n, m, percent)
            shared, at = counted[depth], depth * block
            while at < n:
                part = s[at : at + block]
                found = np.searchsorted(query, part)
                shared += int((query[np.minimum(found, m - 1)] == part).sum())
                at += len(part)
                rest = m - int(np.searchsorted(query, part[-1], "right"))
                if len(part) == block:
                    counted.append(shared)
                if shared + rest < fewest:
                    left_at = at
                    break
                if shared + min(rest, n - at) < need:
                    break
            if at >= n and shared >= need:
                yield place


def sieved(docs: DataFrame, ids: DataFrame, bits: int = SIEVE) -> DataFrame:
    """The rows of docs whose doc_id is among ids (doc_id), and a few others: those whose hash meets that of one of ids.

    The hashes are bits of a map, which is broadcast, so rows are left out where they are read. More ids than bits only let more rows through.
    """

    def place(column: str):
        return F.pmod(F.xxhash64(column), F.lit(bits)) + 1  # bits are counted from 1

    sieve = ids.groupBy(F.bitmap_bucket_number(place("doc_id")).alias("_part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place("doc_id"))).alias("_bits"))
    at = F.bitmap_bit_position(place("doc_id"))
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    there = F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1
    return docs.join(F.broadcast(sieve), (F.bitmap_bucket_number(place("doc_id")) == F.col("_part")) & there, "left_semi")


def _sets_of(docs: DataFrame, ids: DataFrame, last, words: int) -> DataFrame:
    """cid and tokens (packed, in global order) of the classes whose first documents are ids (doc_id, settled)."""
    texts = sieved(docs, ids).join(ids, "doc_id").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column("text")):
                h, starts, n, digest = _ordered(chunk, words, last.value)
                yield pa.RecordBatch.from_arrays([_signed(digest), pa.array([packed(h[a : a + k]) for a, k in zip(starts, n, strict=True)], pa.binary())], ["cid", "tokens"])

    return texts.mapInArrow(run, "cid long, tokens binary").groupBy("cid").agg(F.any_value("tokens").alias("tokens"))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose sets are similar. Each a's partners are dealt to so many trees as they need."""
    sets = sets.hint("merge")  # as large as the texts: a few that could be broadcast are shuffled like many
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / TOGETHER).alias("salts"))
    dealt = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("salts")))
    partners = dealt.join(sets.withColumnRenamed("cid", "b"), "b").select("a", "salt", "b", "tokens")
    asked = salts.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).join(sets.withColumnRenamed("cid", "a"), "a").select("a", "salt", F.col("a").alias("b"), "tokens")

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        own = rows["b"].to_numpy() == key[0]
        query = unpacked(rows["tokens"][own].iloc[0])
        others = rows[~own]
        tree = PrefixTree([unpacked(t) for t in others["tokens"]])
        found = list(tree.similar(query, percent))
        return pd.DataFrame({"a": np.full(len(found), key[0], np.int64), "b": others["b"].to_numpy()[found].astype(np.int64)})

    return partners.unionByName(asked).groupBy("a", "salt").applyInPandas(run, "a long, b long")


def block_join(members: DataFrame, sets: DataFrame, percent: int = PERCENT, block: int = TOGETHER) -> DataFrame:
    """Links (a, b) between members (token, cid, label) of one token that have different labels.

    Members of a token are dealt to blocks. Those without the token's most frequent label visit every block of it, and there
    meet the prefix tree of the block. So a family in which all but a few are connected already costs what these few cost.
    A pair is looked at under its first common token alone.
    """
    sizes = members.groupBy("token", "label").agg(F.count("*").alias("n"))
    main = sizes.groupBy("token").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.ceil(F.sum("n") / block).alias("blocks"))
    tokens = members.groupBy("cid").agg(F.sort_array(F.collect_set("token")).alias("all"))  # a prefix of one set at most
    dealt = members.join(main, "token").join(tokens, "cid")
    own = dealt.withColumns({"block": F.pmod(F.xxhash64("cid"), F.col("blocks")), "asks": F.lit(False)})
    cells = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    asking = dealt.where("label <> main").withColumns({"block": F.explode(cells), "asks": F.lit(True)})
    rows = own.unionByName(asking).join(sets.hint("merge"), "cid").select("token", "block", "asks", "cid", "label", "all", "tokens")

    def run(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        token = int(key[0])
        there, asks = rows[~rows["asks"]], rows[rows["asks"]]
        out = []
        if len(asks) and len(there):
            tree = PrefixTree([unpacked(t) for t in there["tokens"]])
            labels, ids, groups = there["label"].to_numpy(), there["cid"].to_numpy(), [set(map(int, x)) for x in there["all"]]
            for cid, label, mine, tokens in zip(asks["cid"], asks["label"], asks["all"], asks["tokens"], strict=True):
                before = {int(t) for t in mine if t < token}
                skip = lambda p: labels[p] == label or not before.isdisjoint(groups[p])  # noqa: B023, E731
                out += [(ids[p], cid) for p in tree.similar(unpacked(tokens), percent, skip)]
        return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

    return rows.groupBy("token", "block").applyInPandas(run, "a long, b long")


def join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, small: int = SMALL, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n_shingles, component_id) for each row of (doc_id, text), and the links (a, b) found between classes.

    Words are runs of characters that aren't ASCII white space, in lower case for A-Z. Null and empty texts, and texts
    without words, have the empty set: they are linked with nothing. Rows that repeat a doc_id are one document if their
    texts have equal sets; with other texts they are linked through it where it is the smallest doc_id of either set, and apart otherwise. Rows without a doc_id are linked with nothing and have no
    component_id. An empty table gives an empty one. Sets are compared by
    48 bits of the shingles' hashes; they connect all similar classes, but a family of near copies gets a spanning set of links only.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows, seen = classes(docs, words)
    named_docs = docs.where("doc_id is not null")
    hot = seen.groupBy("token").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= frequent)
    hot = hot.orderBy(F.desc("seen"), "token").limit(MOST_FREQUENT).select("token").toArrow().column("token").to_numpy()
    last = spark.sparkContext.broadcast(np.sort(hot.astype(np.int64)).view(np.uint64))
    reps = settle(rows.where("n > 0 and doc_id is not null").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")), "representatives")
    total = reps.agg(F.sum(F.floor(F.col("n") / 4) + 1)).first()[0] or 0
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // BUCKET)
    met = settle(meet(prefixes(named_docs, last, buckets, words, percent), small, percent), "met")
    members = met.where("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("cid"), F.col("na").alias("n"))
    pairs = met.where("kind = 0").groupBy("a", "b").agg(F.sum("c").alias("c"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    uncounted = settle(members.groupBy("cid").agg(F.count("*").alias("g")), "uncounted")
    for side in "ab":
        pairs = pairs.join(uncounted.select(F.col("cid").alias(side), F.col("g").alias(f"g{side}")), side, "left").fillna(0, [f"g{side}"])
    larger = F.greatest("na", "nb")
    need = F.ceil(F.lit(percent) * (F.col("na") + F.col("nb")) / F.lit(100 + percent))
    pairs = pairs.where(F.col("c") + F.least("ga", "gb") + F.ceil(F.lit(percent) * larger / 100) - 1 >= need).select("a", "b")
    # stars over the large groups, about a few members that tokens with much the same members have in common
    least = [F.min(F.struct(F.xxhash64("cid", F.lit(k)).alias("h"), "cid", "n")).alias(f"h{k}") for k in range(HUBS)]
    hubs = members.groupBy("token").agg(*least)
    starred = members.join(hubs, "token").select("cid", "n", F.explode(F.array(*[f"h{k}" for k in range(HUBS)])).alias("hub")).where("cid <> hub.cid")
    starred = starred.where(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    starred = starred.select(F.least("cid", "hub.cid").alias("a"), F.greatest("cid", "hub.cid").alias("b"))
    pairs = settle(pairs.unionByName(starred).distinct(), "pairs")
    wanted = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).union(members.select("cid")).distinct()
    wanted = settle(reps.join(wanted, "cid").select(F.col("rep").alias("doc_id")), "wanted")
    sets = settle(_sets_of(named_docs, wanted, last, words), "sets")
    links = settle(verified(pairs, sets, percent), "links")
    labels = components(links).select(F.col("vertex").alias("cid"), F.col("component").alias("label"))
    labelled = members.join(labels, "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    apart = labelled.groupBy("token").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("k"), F.sum(F.xxhash64("cid").cast("decimal(38,0)")).alias("h")).where("x <> y")
    apart = apart.groupBy("k", "h").agg(F.min("token").alias("token")).select("token")  # of tokens with the same members one
    apart = settle(labelled.join(apart, "token"), "apart")
    if not apart.isEmpty():
        links = settle(links.unionByName(block_join(apart, sets, percent)).distinct(), "links")
    by = reps.select("cid", "rep")
    edges = links.join(by.withColumnsRenamed({"cid": "a", "rep": "ra"}), "a").join(by.withColumnsRenamed({"cid": "b", "rep": "rb"}), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    groups = components(edges)
    named = settle(reps.join(groups, reps["rep"] == groups["vertex"], "left").select("cid", F.coalesce("component", "rep").alias("component_id")), "named")
    drop(met, uncounted, pairs, wanted, sets, apart)
    full = rows.where("n > 0").join(named, "cid", "left").withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.col("component_id"))).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty), links
