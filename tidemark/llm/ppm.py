"""Scores of a language model: prediction by partial matching over bytes, with a count-based model of words beside it.

The model is a trie of byte contexts of up to ORDER bytes. It's kept as tables: counts of grams (a context and the byte after
it) by order, and its nodes (contexts) with the sums that escapes need. A gram is packed into one number, nine bits a symbol;
the oldest symbol stands highest, so that a shorter context is the low bits of a longer one. A text is coded from its first
byte, before which boundary symbols stand, to one boundary symbol at its end.

A byte's probability is that of the longest context it was seen in, times the escapes from the longer ones. Counts are
discounted by a half and the escape gets half for each distinct symbol. What a longer context has seen is excluded from the
shorter one: since every gram is counted in all orders, the symbols excluded at a context are those of the child it was
reached from, so a node needs only its parent's total over those symbols, and exclusion is a sum by node. Beyond order 0 all
257 symbols not seen yet are alike.

Neither texts nor the model pass through one place. Texts are packed in blocks; a block counts its grams and words, so what is
shuffled is what is distinct in a block. The counts make the model, the costs of all distinct grams are taken from it by
joins, and each block gets the costs of its own grams back. Costs are whole numbers (10^-9), so sums don't depend on their order.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import fsum

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import drop, settle
from tidemark.llm.vector_blocks import longs, packed_longs

ORDER = 5
BITS = 9
#: The largest count that stands beside a gram in one number: BITS are left below the longest gram's.
MOST = (1 << BITS) - 1
#: The symbol before and after a text; bytes are 0 to 255.
EDGE = 256
SYMBOLS = 257
#: Bytes of text in a block; a block has at least one text, whole.
BLOCK = 24 << 20
#: Bytes of texts whose grams are made at a time; a longer text is taken whole.
WINDOW = 1 << 18
#: Bytes of texts that are split into words at a time, likewise.
WORDS_WINDOW = 1 << 21
#: Costs are in units of 1 / UNIT.
UNIT = 10**9
#: Stands for the gram in rows of words, since a null would turn grams into doubles in Arrow batches.
NO_GRAM = -1
#: What is added to each count of the model of words.
ADDED = 0.1

BLOCKS = "block long, rows int, ids binary, ids_there binary, held binary, sizes binary, texts binary"
ASKED = "block long, gram long, word binary, n long"


def grams(texts: list[bytes], order: int = ORDER) -> np.ndarray:
    """The packed grams of all positions of the texts and of their ends, one text after the other."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    # order edges stand before each text, of which the first is also the end of the text before
    ends = np.cumsum(sizes) + order * np.arange(1, len(texts) + 1)
    symbols = np.full(len(data) + order * (len(texts) + 1), EDGE, np.int64)
    symbols[np.arange(len(data)) + order * np.repeat(np.arange(1, len(texts) + 1), sizes)] = data
    out = np.zeros(len(symbols) - order, np.int64)
    for k in range(order + 1):
        out <<= BITS
        out |= symbols[k : k + len(out)]
    kept = np.zeros(len(out), bool)
    kept[np.arange(len(data)) + order * np.repeat(np.arange(len(texts)), sizes)] = True
    kept[ends - order] = True
    return out[kept]


def windows(texts: list[bytes], most: int = WINDOW) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of at most that many bytes, with the number of the first; a text that is longer is a run of its own."""
    lo, size = 0, 0
    for i, text in enumerate(texts):
        if i > lo and size + len(text) > most:
            yield lo, texts[lo:i]
            lo, size = i, 0
        size += len(text)
    if texts:
        yield lo, texts[lo:]


def _blocks(rows: DataFrame, most: int) -> DataFrame:
    """Rows (doc_id, held_out, text) in blocks. A block's number is its own; texts are compressed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        first, held, size, number = TaskContext.get().partitionId() << 32, [], 0, 0

        def block() -> pd.DataFrame:
            nonlocal size, number
            found = pd.concat(held, ignore_index=True)
            texts = found["text"].tolist()
            held.clear()
            size, number = 0, number + 1
            packed = (*packed_longs(found["doc_id"]), found["held_out"].to_numpy().astype("u1").tobytes(), np.array([len(t) for t in texts], "<i8").tobytes(), pa.compress(b"".join(texts), codec="zstd", asbytes=True))
            return pd.DataFrame([(first + number - 1, len(texts), *packed)], columns=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            lo, ends = 0, batch["text"].str.len().to_numpy().cumsum()
            while lo < len(batch):
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + most - size, "right")))
                held.append(batch.iloc[lo:hi])
                size, lo = size + int(ends[hi - 1] - before), hi
                if size >= most or lo < len(batch):
                    yield block()
        if held:
            yield block()

    return rows.mapInPandas(run, BLOCKS)


def _texts(r: dict) -> list[memoryview]:
    ends = np.cumsum(np.frombuffer(r["sizes"], "<i8")).tolist()
    data = memoryview(pa.decompress(r["texts"], ends[-1], codec="zstd", asbytes=True))
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def _held(r: dict) -> np.ndarray:
    return np.frombuffer(r["held"], "u1").astype(bool)


def _words(texts: list[memoryview], held: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the texts and how often each stands in those that are learned from; the words of all texts, as places among these, and how many each text has.

    The last of the distinct words is the empty one, which stands for the end of a text and isn't among the words of all texts.
    """
    starts = np.cumsum([0, *map(len, texts)]).astype("<i8")
    data = pa.Array.from_buffers(pa.large_string(), len(texts), [None, pa.py_buffer(starts), pa.py_buffer(b"".join(texts))])
    lists = pc.ascii_split_whitespace(data)
    code = lists.flatten().dictionary_encode()
    distinct = code.dictionary.cast(pa.large_binary())
    sizes = pc.list_value_length(lists).to_numpy()
    at = code.indices.to_numpy()
    del data, lists, code
    real = pc.binary_length(distinct).to_numpy() > 0  # white space before or after the words leaves an empty one
    place = np.where(real, np.cumsum(real) - 1, -1).astype(np.int32)
    at = place[at]
    of_text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)[at >= 0]
    at = at[at >= 0]
    distinct = pa.concat_arrays([distinct.filter(pa.array(real)), pa.array([b""], pa.large_binary())])
    n = np.bincount(at[~held[of_text]], minlength=len(distinct))
    n[-1] = (~held).sum()
    return distinct, n, at, np.bincount(of_text, minlength=len(texts))


def _word_counts(texts: list[memoryview], held: np.ndarray) -> tuple[pa.Array, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """As _words, with the words of all texts and how many each text has by windows, and the empty word anywhere; split by windows, for the sake of memory."""
    found = []
    for lo, run in windows(texts, WORDS_WINDOW):
        found.append(_words(run, held[lo : lo + len(run)]))
    code = pa.concat_arrays([words for words, *_ in found]).dictionary_encode()
    codes = np.split(code.indices.to_numpy(), np.cumsum([len(words) for words, *_ in found])[:-1])
    counts = np.zeros(len(code.dictionary), np.int64)
    for own, (_, n, _, _) in zip(codes, found, strict=True):
        counts[own] += n
    return code.dictionary, counts, [(own[at], sizes) for own, (_, _, at, sizes) in zip(codes, found, strict=True)]


def _runs(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal ones begins in sorted keys."""
    return np.flatnonzero(np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]]))


def _unpacked(packed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams in order, and the count of each."""
    first = _runs(packed >> BITS)
    return packed[first] >> BITS, np.add.reduceat(packed & MOST, first) if len(first) else np.zeros(0, np.int64)


def _slices(packed: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Runs of about so many rows of sorted packed counts, none of which ends within a gram."""
    lo = 0
    while lo < len(packed):
        hi = min(lo + most, len(packed))
        if hi < len(packed):
            hi = int(np.searchsorted(packed, packed[hi - 1] | MOST, "right"))
        yield packed[lo:hi]
        lo = hi


def _summed(packed: np.ndarray) -> np.ndarray:
    """Packed counts, sorted in place, with the rows of each gram as one; of a count beyond MOST the rest stands in further rows."""
    packed.sort()
    out = [packed[:0]]
    for part in _slices(packed, WINDOW):
        kinds, n = _unpacked(part)
        rows = np.maximum(1, -(-n // MOST))
        each = np.full(int(rows.sum()), MOST, np.int64)
        each[np.cumsum(rows) - 1] = n - (rows - 1) * MOST
        out.append(np.repeat(kinds << BITS, rows) | each)
    return np.concatenate(out)


def _packed_counts(texts: list[memoryview], held: np.ndarray, order: int) -> np.ndarray:
    """The distinct grams of the texts with their counts in those that are learned from, as _summed has them: one number a gram, for the sake of memory."""
    found, new, fresh = np.zeros(0, np.int64), [], 0
    for lo, run in windows(texts):
        learned = np.repeat(~held[lo : lo + len(run)], [len(t) + 1 for t in run])
        new.append(_summed(grams(run, order) << BITS | learned))
        fresh += len(new[-1])
        if fresh > len(found) // 2 + 4 * WINDOW:  # so that a gram is merged few times
            new.append(found)
            found, fresh = np.concatenate(new), 0
            new.clear()
            found = _summed(found)
    new.append(found)
    del found
    both = np.concatenate(new)
    new.clear()
    return _summed(both)


def _counted(texts: list[memoryview], held: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct grams of the texts in order, and how often each stands in those that are learned from."""
    return _unpacked(_packed_counts(texts, held, order))


def _asked(blocks: DataFrame, order: int) -> DataFrame:
    """By block, each distinct gram and word, with its count in the texts that are learned from (0 where only others have it)."""
    schema = pa.schema([("block", pa.int64()), ("gram", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                texts, held = _texts(r), _held(r)
                packed = _packed_counts(texts, held, order)
                for rows in _slices(packed, WINDOW):
                    g, n = _unpacked(rows)
                    yield pa.record_batch([np.full(len(g), r["block"]), g, pa.nulls(len(g), pa.binary()), n], schema=schema)
                del packed, rows, g, n
                words, n = _word_counts(texts, held)[:2]
                for lo in range(0, len(words), WINDOW):
                    part = words[lo : lo + WINDOW].cast(pa.binary())
                    yield pa.record_batch([np.full(len(part), r["block"]), np.full(len(part), NO_GRAM), part, n[lo : lo + WINDOW]], schema=schema)
                del texts, words, n
                pa.default_memory_pool().release_unused()  # workers are kept for later tasks

    return blocks.mapInArrow(run, ASKED)


def _low(gram: Column, symbols: Column) -> Column:
    """The last symbols of a gram."""
    return gram.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), (symbols * BITS).cast("int")) - 1)


def trie(counted: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(level, gram, n of each gram of each order; level, context, total, kinds, below, fewer of each node), from the counts of the longest grams.

    total and kinds are the count of all symbols after the context and how many differ. below and fewer are what is left of
    its parent's total and kinds when its own symbols are excluded there (null at the root).
    """
    levels = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level")
    by_order = counted.where("n > 0").select(levels, "gram", "n").select("level", _low(F.col("gram"), F.col("level") + 1).alias("gram"), "n").groupBy("level", "gram").agg(F.sum("n").alias("n"))
    by_order = settle(by_order, "grams")
    shorter = by_order.select((F.col("level") + 1).alias("level"), F.col("gram").alias("shorter"), F.col("n").alias("under"))
    with_under = by_order.withColumn("shorter", _low(F.col("gram"), F.col("level"))).join(shorter, ["level", "shorter"], "left")
    nodes = with_under.groupBy("level", F.shiftright("gram", BITS).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("under").alias("under"))
    nodes = settle(nodes, "nodes")
    parents = nodes.select((F.col("level") + 1).alias("level"), F.col("context").alias("parent"), F.col("total").alias("above"), F.col("kinds").alias("kinds_above"))
    full = nodes.withColumn("parent", _low(F.col("context"), F.col("level") - 1)).join(parents, ["level", "parent"], "left")
    full = settle(full.select("level", "context", "total", "kinds", (F.col("above") - F.col("under")).alias("below"), (F.col("kinds_above") - F.col("kinds")).alias("fewer")), "trie")
    drop(nodes)
    return by_order, full


def costs(counted: DataFrame, order: int = ORDER) -> DataFrame:
    """gram, cost (log10 of the probability of its last symbol after its others, in units) of each counted gram, from what the grams with n > 0 teach."""
    by_order, nodes = trie(counted, order)
    half = F.lit(0.5)
    unit = lambda x: F.round(x * UNIT).cast("long").alias("cost")
    top = nodes.where(F.col("level") == order).select("context", "total")
    known = counted.where("n > 0").withColumn("context", F.shiftright("gram", BITS)).join(top, "context")
    direct = known.select("gram", unit(F.log10((F.col("n") - half) / F.col("total"))))
    # the others fall through the orders: what is known of each at every order, then the sum of its escapes
    levels = F.explode(F.sequence(F.lit(0), F.lit(order))).alias("level")
    fallen = counted.where("n = 0").select("gram", levels)
    fallen = fallen.withColumns({"own": _low(F.col("gram"), F.col("level") + 1), "context": F.shiftright(_low(F.col("gram"), F.col("level") + 1), BITS)})
    met = fallen.join(by_order.withColumnsRenamed({"gram": "own"}), ["level", "own"], "left").join(nodes, ["level", "context"], "left")
    at = met.groupBy("gram").agg(
        F.max(F.when(F.col("total").isNotNull(), F.col("level"))).alias("top"),
        F.coalesce(F.max(F.when(F.col("n").isNotNull(), F.col("level"))), F.lit(-1)).alias("found"),
        F.max_by("n", F.when(F.col("n").isNotNull(), F.col("level"))).alias("n"),
        F.array_sort(F.collect_list(F.struct("level", "total", "kinds", "below", "fewer"))).alias("path"),  # one for each order
    )
    node = lambda level: F.element_at("path", level + 1)
    escape = F.log10(half * node(F.col("top"))["kinds"] / node(F.col("top"))["total"])
    passed = F.filter("path", lambda x: (x["level"] > F.col("found") + 1) & (x["level"] <= F.col("top")) & (x["below"] > 0))
    escapes = F.aggregate(passed, F.lit(0.0), lambda so_far, x: so_far + F.log10(half * x["fewer"] / x["below"]))
    last = F.when(F.col("found") >= 0, F.log10((F.col("n") - half) / node(F.col("found") + 1)["below"])).otherwise(-F.log10(SYMBOLS - node(F.lit(0))["kinds"]))
    cost = F.when(F.col("top").isNull(), -F.log10(F.lit(float(SYMBOLS)))).when(F.col("found") == F.col("top"), F.log10((F.col("n") - half) / node(F.col("top"))["total"])).otherwise(escape + escapes + last)
    out = settle(direct.unionByName(at.select("gram", unit(cost))), "costs")
    drop(by_order, nodes)
    return out


def _scored(blocks: DataFrame, answered: DataFrame, told: DataFrame, order: int, train_tokens: int, kinds: int) -> DataFrame:
    """The rows of all blocks with their scores; answered has by block the cost of each gram, told the count of each word that other blocks have too."""
    bottom = train_tokens + ADDED * (kinds + 1)

    def score(block: pa.Table, answers: pa.Table) -> pa.Table:
        is_told = pc.is_valid(block["word"])
        told = block.select(["word", "value", "own"]).filter(is_told)
        (r,) = block.filter(pc.invert(is_told)).to_pylist()
        texts, held = _texts(r), _held(r)
        known, cost = pd.Index(answers["gram"].to_numpy()), answers["value"].to_numpy()
        total = []
        for _, run in windows(texts):
            each = cost[known.get_indexer(grams(run, order))]
            total.append(np.add.reduceat(each, np.cumsum([0] + [len(t) + 1 for t in run[:-1]])))
        del known, cost
        words, count, parts = _word_counts(texts, held)
        place = pc.index_in(told["word"].cast(pa.large_binary()), value_set=words).to_numpy()
        count[place] += told["value"].to_numpy() - told["own"].to_numpy()
        weight, end = np.log10((count + ADDED) / bottom), words.index(pa.scalar(b"", words.type)).as_py()
        last = float(weight[end])
        base, n_known = [], []
        for at, sizes in parts:
            seen = np.concatenate([[0], np.cumsum(count[at] > 0)])
            ends = np.cumsum(sizes)
            of_word = weight[at]
            base += [fsum([*of_word[a:b].tolist(), last]) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            n_known.append(seen[ends] - seen[ends - sizes] + int(count[end] > 0))
        out = {
            "doc_id": pa.array(longs(r["ids"], r["ids_there"]), pa.int64()), "held_out": held, "n_tokens": np.concatenate([sizes for _, sizes in parts]) + 1, "n_known": np.concatenate(n_known),
            "train_tokens": np.full(len(texts), train_tokens), "base_score": base, "score": np.concatenate(total) / UNIT,
        }
        pa.default_memory_pool().release_unused()  # workers are kept for later tasks
        return pa.table(out)

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    beside = blocks.unionByName(told, allowMissingColumns=True)
    return beside.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, schema)


def lm_scores(docs: DataFrame, order: int = ORDER, most: int = BLOCK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: log10 probabilities of each whole text, in lower case for A-Z.

    docs has doc_id and text; other columns are passed over. Both models learn from rows whose crc32 of the doc_id as text
    isn't divisible by ten; rows without a doc_id are learned from too. score is the byte model's for all bytes of the text,
    white space too, and its end; base_score that of its words and its end, each count raised by a tenth. A null text is an
    empty one, which has its end alone. Each row is a text, repeated ones too. A text stays whole in one block, however long;
    that takes some hundred bytes of memory for each of its own. With nothing to learn from, each byte has a probability of 1 in 257. Empty tables give an
    empty one.
    """
    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(False))
    text = F.coalesce(F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")).cast("binary")
    blocks = settle(_blocks(docs.select(doc_id.alias("doc_id"), held.alias("held_out"), text.alias("text")), most), "texts")
    asked = settle(_asked(blocks, order), "asked")
    of_words, of_grams = asked.where("word is not null"), asked.where("word is null")
    vocabulary = settle(of_words.groupBy("word").agg(F.sum("n").alias("value"), F.count("*").alias("blocks")), "words")
    train_tokens, kinds = vocabulary.agg(F.coalesce(F.sum("value"), F.lit(0)), F.count(F.when(F.col("value") > 0, 1))).first()
    # a word of one block alone is known there: most words of a large corpus stand in one text
    told = settle(of_words.join(vocabulary.where("blocks > 1"), "word").where("value <> n").select("block", "word", "value", F.col("n").alias("own")), "told")
    drop(vocabulary)
    counted = settle(of_grams.groupBy("gram").agg(F.sum("n").alias("n")), "counted")
    priced = costs(counted, order)
    priced_grams = of_grams.select("block", "gram").join(priced, "gram").select("block", "gram", F.col("cost").alias("value"))
    out = settle(_scored(blocks, priced_grams, told, order, train_tokens, kinds), "scores")
    drop(blocks, asked, told, counted, priced)
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
