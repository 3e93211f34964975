"""Filter interaction audit by an incidence matrix product.

Each document is one of 32 outcomes: a bit for each of five filters that it fails. What any order of the filters keeps, removes, finds redundant
or alone removes depends on nothing else, so a part's documents are a row of 32 counts, and the answers for all 120 orders and 5 steps are that row
times an integer matrix of 32 by 600 (``INCIDENCE``). Documents labelled good or toxic are two further rows of counts.

Filters, by bit: A under 200 words; B: 100 * distinct words < 50 * words; C: 100 * capitals A-Z > 2 * code points; D: any of ``#$%&*|``; E: a
smaller doc_id has the same text, removed or not, in any part.

Texts are measured once, in one pass that keeps some fifty bytes a document; E joins the smallest id of each text, hot texts by a bounded
broadcast; the counts are summed before the shuffle, to 32 numbers for each part and row kind.

Defined cases: a null text is an empty one and equals it; a null source is the part ''; a null doc_id is smaller than none and has no label; rows
with equal ids do not precede each other; of several labels for one id, any that says good (toxic) counts; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import field, join_spread, map_rows, materialize, texts_of

FILTERS = "ABCDE"
FEW_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 2
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = re.compile(rb"[#$%&*|]")
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS = len(FILTERS)
OUTCOMES = 1 << STEPS


def incidence() -> dict[str, np.ndarray]:
    """For each kind of answer a matrix of outcomes by (order, step), 1 where that outcome counts there; ``own`` adds a filter's removals over all orders."""
    kept, removed, redundant, unique = (np.zeros((OUTCOMES, len(ORDERS) * STEPS), np.int64) for _ in range(4))
    mask = np.arange(OUTCOMES)
    bits = {f: 1 << i for i, f in enumerate(FILTERS)}
    for o, order in enumerate(ORDERS):
        before = 0
        for s, f in enumerate(order):
            at, fails, gone = o * STEPS + s, (mask & bits[f]) > 0, (mask & before) > 0
            before |= bits[f]
            kept[:, at] = (mask & before) == 0
            removed[:, at] = fails & ~gone
            redundant[:, at] = fails & gone
            unique[:, at] = mask == bits[f]
    letters = np.array([f for order in ORDERS for f in order])
    return {"kept": kept, "removed": removed, "redundant": redundant, "unique_fails": unique, "shapley": removed @ (letters[:, None] == letters[None, :]).astype(np.int64)}


INCIDENCE = incidence()


def _measure(text: pa.Array) -> list[pa.Array]:
    """The bits A to D and a digest of each text."""
    masks, digests = [], []
    for raw in texts_of(text):
        raw = raw or b""
        words = raw.split()
        points = len(raw.decode()) if not raw.isascii() else len(raw)
        m = 1 if len(words) < FEW_WORDS else 0
        m |= 2 if 100 * len(set(words)) < DISTINCT_SHARE * len(words) else 0
        m |= 4 if 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > CAPITAL_SHARE * points else 0
        m |= 8 if _MARKS.search(raw) else 0
        masks.append(m)
        digests.append(hashlib.sha256(raw).digest())
    return [pa.array(masks, pa.int32()), pa.array(digests, pa.binary())]


def outcomes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(id, part, mask): one row for each document, bit i of ``mask`` set where filter i fails."""
    src = docs.select(field(id_col).cast("long").alias("id"), F.coalesce(field(part_col).cast("string"), F.lit("")).alias("part"), field(text_col).alias("text"))
    rows = map_rows(src, "text", [("mask", T.IntegerType()), ("digest", T.BinaryType())], _measure, keep=["id", "part"])
    rows = materialize(rows.select("row.id", "row.part", "mask", "digest"), "filter-outcomes")
    lows = rows.groupBy("digest").agg(F.min("id").alias("low"), F.count("*").alias("n"))
    joined = join_spread(rows, lows, "digest", rows.count())
    later = F.coalesce(F.col("id") > F.col("low"), F.lit(False))
    return joined.select("id", "part", F.when(later, F.col("mask").bitwiseOR(F.lit(16))).otherwise(F.col("mask")).alias("mask"))


def histograms(found: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, n, good, toxic): for each part three rows of counts by outcome, as arrays."""
    marks = labels.filter(field(id_col).isNotNull()).groupBy(field(id_col).cast("long").alias("id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = found.select("id", "part", "mask").join(marks, "id").select("part", "mask", F.lit(0).alias("one"), "good", "toxic")
    rows = found.select("part", "mask", F.lit(1).alias("one"), F.lit(0).alias("good"), F.lit(0).alias("toxic")).unionByName(marked)
    cells = rows.groupBy("part", "mask").agg(*[F.sum(c).alias(c) for c in ("one", "good", "toxic")])
    at = lambda c, k: F.coalesce(F.sum(F.when(F.col("mask") == k, F.col(c))), F.lit(0).cast("long"))
    stacked: list[Column] = [F.array(*[at(c, k) for k in range(OUTCOMES)]).alias(name) for name, c in (("n", "one"), ("good", "good"), ("toxic", "toxic"))]
    return cells.groupBy("part").agg(*stacked)


def products(stacked: DataFrame) -> DataFrame:
    """The 600 answers of each part: its rows of counts times the incidence matrices."""
    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(ORDERS) * STEPS
        order, step = [o for o in ORDERS for _ in range(STEPS)], np.tile(np.arange(1, STEPS + 1, dtype=np.int32), len(ORDERS))
        for b in batches:
            for a in range(0, b.num_rows, 256):
                piece = b.slice(a, 256)
                n, good, toxic = (piece.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, OUTCOMES) for i in (1, 2, 3))
                answers = {k: n @ m for k, m in INCIDENCE.items()} | {"good_lost": good @ INCIDENCE["removed"], "toxic_lost": toxic @ INCIDENCE["removed"]}
                parts = piece.column(0).take(pa.array(np.repeat(np.arange(piece.num_rows), cells)))
                yield pa.RecordBatch.from_arrays([parts, pa.array(order * piece.num_rows, pa.string()), pa.array(np.tile(step, piece.num_rows)), *[pa.array(answers[c].ravel()) for c in names[3:]]], names=names)

    return stacked.mapInArrow(run, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return products(histograms(outcomes(docs), labels))
