"""Ranked lexical search by sort-based accumulation.

The queries are a stated set of items, taken in blocks of bounded text; the documents are all documents. For each block one pass over the texts counts
every document's terms and keeps, of those that the block asks for, how often each occurs: the postings, a row for each document. From the
postings come the counts of the collection (documents, terms, documents holding a term), and then the scores: a task concatenates the
arrays of (item, document, impact) that its documents' postings match, radix-sorts them by the packed key item << 16 | document, and sums runs
of equal keys with ``reduceat``. Each item keeps a heap of its best documents. Heaps of all tasks are dealt by ranges of (item, task), so that one
item's candidates are many tasks' work, selected again by heap, and ranked.

A term is a maximal run of code points outside ASCII or of ASCII letters and digits; only A-Z are lower-cased.

Defined cases: a null or empty text has no terms and is no document of the collection (``N``); an item without terms, or whose terms occur
nowhere, has no rows; equal scores are ranked by ascending id, null ids last; rows with equal ids, of documents or of items, are ranked
each (equal items are not told apart in the result); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import field, materialize, slices, texts_of

TOP = 10
#: Bytes of item text that one block holds (an item beyond that is a block of its own), and its items at most.
BLOCK, BLOCK_ITEMS = 2 << 20, 1 << 16
#: Impacts that a task accumulates at once, and the documents at most that a packed key tells apart.
IMPACTS, PACKED = 1 << 21, 1 << 16
_TERMS = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(_TERMS).split()


@dataclass(frozen=True)
class Block:
    """Items with the ids of their distinct terms. Term t is asked for by ``items[first[t]:first[t + 1]]``."""

    ids: list[int | None]
    vocabulary: dict[bytes, int]
    first: np.ndarray
    items: np.ndarray


def blocks(items: DataFrame, id_col: str, text_col: str, size: int = BLOCK) -> Iterator[Block]:
    """The items, streamed through the driver a block at a time."""
    held: list[tuple[int | None, set[bytes]]] = []
    n = 0
    for r in items.select(field(id_col).cast("long"), field(text_col)).toLocalIterator():
        raw = (r[1] or "").encode()
        if held and (n + len(raw) > size or len(held) == BLOCK_ITEMS):
            yield _block(held)
            held, n = [], 0
        held.append((r[0], set(terms(raw))))
        n += len(raw)
    if held:
        yield _block(held)


def _block(held: list[tuple[int | None, set[bytes]]]) -> Block:
    vocabulary: dict[bytes, int] = {}
    pairs = np.array([(vocabulary.setdefault(t, len(vocabulary)), i) for i, (_, ts) in enumerate(held) for t in sorted(ts)], np.int64).reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    return Block([i for i, _ in held], vocabulary, np.searchsorted(pairs[:, 0], np.arange(len(vocabulary) + 1)), pairs[:, 1])


def postings(docs: DataFrame, block: Block, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, tf): a row for each document with a term; n counts all its terms, the arrays hold those of the block."""
    vocabulary = block.vocabulary
    schema = "doc_id long, n long, terms array<int>, tf array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, whole.column(1)):
                keep, n, ends, found, tf = [], [], [0], [], []
                for i, raw in enumerate(texts_of(b.column(1))):
                    words = terms(raw)
                    if not words:
                        continue
                    counted = Counter(words)
                    hit = counted.keys() & vocabulary.keys()
                    found.extend([vocabulary[t] for t in hit])
                    tf.extend([counted[t] for t in hit])
                    keep.append(i)
                    n.append(len(words))
                    ends.append(len(found))
                at = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array(found, pa.int32())), pa.ListArray.from_arrays(at, pa.array(tf, pa.int64()))], names=["doc_id", "n", "terms", "tf"])

    return docs.select(field(id_col).cast("long").alias("doc_id"), field(text_col).alias("text")).mapInArrow(run, schema)


def document_frequencies(posted: DataFrame, size: int) -> np.ndarray:
    """Documents holding each term of the block: counted by task, then summed; ``size`` numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for b in batches:
            held += np.bincount(b.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at])], names=["term", "df"])

    df = np.zeros(size, np.int64)
    for r in posted.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():
        df[r["term"]] = r["df"]
    return df


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) for k in df], np.int64)


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The stable order of 32-bit keys: two passes of numpy's radix sort, which it uses for 16-bit integers."""
    low = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")
    return low[np.argsort((keys[low] >> 16).astype(np.uint16), kind="stable")]


def accumulate(n: np.ndarray, ends: np.ndarray, found: np.ndarray, tf: np.ndarray, block: Block, w: np.ndarray, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(item, row, score) of every item and row that share a term, sorted by item, then row. Row r's postings are ``found[ends[r]:ends[r + 1]]``."""
    row = np.repeat(np.arange(len(n)), np.diff(ends))
    m = 10 + 90 * n * n_docs // n_terms
    impact = w[found] * (1_000_000_000 * tf // (1000 * tf + 8 * m[row]))
    asked = block.first[found + 1] - block.first[found]
    base = np.cumsum(asked) - asked
    item = block.items[np.arange(int(asked.sum())) - np.repeat(base - block.first[found], asked)]
    keys = (item.astype(np.uint32) << np.uint32(16)) | np.repeat(row, asked).astype(np.uint32)
    order = radix_order(keys)
    keys = keys[order]
    begins = np.flatnonzero(np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1])))
    if not len(begins):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    score = np.add.reduceat(np.repeat(impact, asked)[order], begins)
    return (keys[begins] >> 16).astype(np.int64), (keys[begins] & 0xFFFF).astype(np.int64), score


class Best:
    """The ``top`` best documents of each item seen so far, as heaps whose root is the worst kept."""

    def __init__(self, top: int):
        self.top, self.heaps = top, {}
        self.floor = np.zeros(BLOCK_ITEMS, np.int64)

    def offer(self, item: np.ndarray, doc: list[int | None], score: np.ndarray) -> None:
        """doc: the ids of the rows offered, null ids as None."""
        for i, d, s in zip(item.tolist(), doc, score.tolist(), strict=True):
            heap = self.heaps.setdefault(i, [])
            entry = (s, d is not None, -(d or 0))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.floor[i] = heap[0][0]

    def rows(self) -> tuple[list[int], list[int | None], list[int]]:
        flat = [(i, -d if has else None, s) for i, heap in self.heaps.items() for s, has, d in heap]
        return [x[0] for x in flat], [x[1] for x in flat], [x[2] for x in flat]


def best_in_tasks(posted: DataFrame, block: Block, w: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """(item, task, doc_id, score): each task's best documents for each item of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        best = Best(top)
        for b in batches:
            ends = b.column(2).offsets.to_numpy().astype(np.int64)
            found, tf = (b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (2, 3))
            ends = ends - ends[0]
            n = b.column(1).to_numpy(zero_copy_only=False)
            work = np.concatenate(([0], np.cumsum(block.first[found + 1] - block.first[found])))[ends]
            a = 0
            while a < len(n):
                z = min(max(int(np.searchsorted(work, work[a] + IMPACTS, "right")) - 1, a + 1), a + PACKED, len(n))
                item, row, score = accumulate(n[a:z], ends[a : z + 1] - ends[a], found[ends[a] : ends[z]], tf[ends[a] : ends[z]], block, w, n_docs, n_terms)
                good = np.flatnonzero((score > 0) & (score >= best.floor[item]))
                best.offer(item[good], b.column(0).take(pa.array(a + row[good])).to_pylist(), score[good])
                a = z
        item, doc, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([TaskContext.get().partitionId()] * len(item), pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())], names=["item", "task", "doc_id", "score"])

    return posted.mapInArrow(run, "item int, task int, doc_id long, score long")


def best_in_ranges(heaps: DataFrame, top: int) -> DataFrame:
    """The best of each item in each range of (item, task): a range's rows arrive unsorted and are selected by heap again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(top)
        for b in batches:
            best.offer(b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_pylist(), b.column(3).to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(best.rows(), (pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["item", "doc_id", "score"])

    ranges = int(heaps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return heaps.repartitionByRange(ranges, "item", "task").mapInArrow(run, "item int, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for b in blocks(items, item_col, item_text_col, block):
        posted = materialize(postings(docs, b, id_col, text_col), "postings")
        n_docs, n_terms = posted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n_docs or not b.vocabulary:
            continue
        w = weights(document_frequencies(posted, len(b.vocabulary)), n_docs)
        heaps = materialize(best_in_tasks(posted, b, w, n_docs, n_terms, top), "heaps")  # written, as dealing by ranges reads it twice
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        ranked = best_in_ranges(heaps, top).withColumn("rank", rank).filter(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(b.ids)), "item int, item_id long")
        out = out.unionByName(ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return out
