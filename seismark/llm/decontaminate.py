"""Benchmark decontamination by pigeonhole edit matching.

A test item of m symbols has an error budget of k = rate * m edits and is cut into k + 1 pieces: whatever k edits do, one piece
stays whole. An automaton finds all exact piece hits in a document, and around the hits, in windows that are merged where they meet, Myers' bit-parallel recurrence
computes the least edit distance of the item to any part of the text there: a text is read once for each item that it may hold, however often it repeats. Symbols are taken twice: characters, which forgive slips within words, and whole words,
which forgive replaced, left-out and added ones; an item is found if either distance is within its budget. Items are a stated query set:
they are taken in blocks of bounded size, each block against all documents.

Texts and items are compared lower-cased, as words of letters and digits with single spaces between them; characters of scripts that
are written without spaces are words of their own. Items begin and end at a word's border, and that counts as a character of theirs.

Defined cases: null or empty texts match nothing; items without a word are left out; an item with a null id is matched and reported
with a null item; items with the same text are all reported; budgets are rounded down, so an item of few symbols is matched exactly; repeated documents are
each reported; empty tables give an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import map_rows, row_of

#: Share of an item's characters, and of its words, that may differ.
RATE, WORD_RATE = 0.05, 0.2
#: Characters of items that one pass over the documents takes (an automaton of some 100 MB).
BLOCK_CHARS = 2_000_000

MATCH = T.ArrayType(T.StructType([T.StructField("item", T.LongType()), T.StructField("unit", T.StringType()), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())]))
MATCH_ARROW = pa.list_(pa.struct([("item", pa.int64()), ("unit", pa.string()), ("distance", pa.int32()), ("end", pa.int64())]))


_GAP = re.compile(r"[\W_]+")
#: Thai, Lao, Khmer and Burmese letters, kana, and Han characters.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0002ffff]")


def normalise(text: str | None) -> str:
    """The text's words with a space before, between and after them; empty if there are none."""
    if not text:
        return ""
    out = text.lower()
    if not out.isascii() and _UNSPACED.search(out):
        out = _UNSPACED.sub(lambda m: f" {m[0]} ", out)
    out = " " + _GAP.sub(" ", out).strip() + " "
    return out if len(out) > 2 else ""


def budget(symbols: Sequence, rate: float) -> int:
    return int(len(symbols) * rate)


def pieces(symbols: Sequence, k: int) -> list[tuple[int, Sequence]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(symbols) * i // (k + 1) for i in range(k + 2)]
    return [(a, symbols[a:z]) for a, z in zip(cuts, cuts[1:], strict=False) if z > a]


def myers(item: Sequence, text: Sequence, k: int) -> tuple[int, int] | None:
    """The least distance (at most k) between the item and any part of the text, and the part's first possible end. Symbols are characters or words."""
    m = len(item)
    if not m:
        return None
    masks: dict = {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score = full, 0, m
    best = (m, 0) if m <= k else None  # the empty part
    for at, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv) & full, pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full  # a match may start anywhere: row zero stays 0
        pv, mv = mh | ~(xv | ph) & full, ph & xv
        if score <= k and (best is None or score < best[0]):
            best = (score, at + 1)
            if not score:
                break
    return best


class Matcher:
    """All items of a block: [(item number, normalised text)]."""

    def __init__(self, items: Iterable[tuple[int | None, str]], rate: float = RATE, word_rate: float = WORD_RATE):
        self.ids: dict[str, list[int | None]] = {}
        for number, text in items:
            if text:
                self.ids.setdefault(text, []).append(number)
        self.texts = list(self.ids)
        words = [t.split() for t in self.texts]
        #: by unit (0: characters, 1: words), then item
        self.symbols: tuple[list[Sequence], list[Sequence]] = (self.texts, words)
        self.budgets = [[budget(t, rate) for t in self.texts], [budget(w, word_rate) for w in words]]
        #: by piece, then (item, unit): the first and the last offset at which the item has the piece
        where: dict[str, dict[tuple[int, int], tuple[int, int]]] = {}
        for unit in (0, 1):
            for n, (item, k) in enumerate(zip(self.symbols[unit], self.budgets[unit], strict=True)):
                for at, piece in pieces(item, k):
                    uses = where.setdefault(f" {' '.join(piece)} " if unit else piece, {})
                    uses[n, unit] = uses.get((n, unit), (at, at))[0], at
        self.auto = ahocorasick.Automaton()
        for piece, uses in where.items():
            self.auto.add_word(piece, (len(piece), [(n, unit, a, z) for (n, unit), (a, z) in uses.items()]))
        if where:
            self.auto.make_automaton()
        self.some = bool(where)

    def find(self, text: str) -> list[tuple[int | None, str, int, int]]:
        """(item number, unit, least distance, end in the normalised text) of all items within a budget."""
        if not self.some or not text:
            return []
        words: list[str] = []
        starts: list[int] = []
        windows: dict[tuple[int, int], list[list[int]]] = {}
        for end, (size, uses) in self.auto.iter(text):
            for n, unit, first, last in uses:
                place = end + 1 - size
                if unit:
                    if not words:
                        words = text.split()
                        starts = [0, *accumulate(len(w) + 1 for w in words)]  # where the space before each word stands
                    place = bisect_left(starts, place)
                k = self.budgets[unit][n]
                a, z = place - last - k, place - first + len(self.symbols[unit][n]) + k
                held = windows.setdefault((n, unit), [])
                if held and a <= held[-1][1] and z >= held[-1][0]:  # hits come in the order of their ends: most windows grow the last one
                    held[-1] = [min(a, held[-1][0]), max(z, held[-1][1])]
                else:
                    held.append([a, z])
        best: dict[int, tuple[int, int, int]] = {}
        for (n, unit), spans in sorted(windows.items(), key=lambda x: x[0][1]):
            if n in best and (unit or not best[n][1]):
                continue  # within the budget of characters already
            got = self._closest(self.symbols[unit][n], self.budgets[unit][n], words if unit else text, spans)
            if got:
                best[n] = (unit, got[0], starts[got[1]] if unit else got[1])
        found = [(number, ("char", "word")[unit], d, end) for n, (unit, d, end) in best.items() for number in self.ids[self.texts[n]]]
        return sorted(found, key=lambda x: (x[0] is None, x[0] or 0))

    @staticmethod
    def _closest(item: Sequence, k: int, text: Sequence, spans: list[list[int]]) -> tuple[int, int] | None:
        """(distance, end) of the closest part of the text within the spans where the item may lie; the first of equals. Spans that meet are read as one, so no
        symbol of the text is read twice."""
        if isinstance(text, str) and (at := text.find(item)) >= 0:
            return 0, at + len(item)
        best, merged = None, []
        for a, z in sorted(spans):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(z, merged[-1][1])
            else:
                merged.append([a, z])
        for a, z in merged:
            a = max(0, a)
            got = myers(item, text[a:z], k)
            if got and (best is None or got[0] < best[0]):
                best = (got[0], a + got[1])
                if not got[0]:
                    break
        return best


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int | None, str]]]:
    """The items, in blocks of bounded size; the driver holds one block at a time."""
    block: list[tuple[int | None, str]] = []
    size = 0
    for number, text in items.select(F.col(id_col).cast("long"), text_col).toLocalIterator():
        text = normalise(text)
        if not text:
            continue
        if block and size + len(text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((number, text))
        size += len(text)
    if block:
        yield block


_built: dict[str, tuple] = {}


def contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, word_rate: float = WORD_RATE, keep: list[str] | None = None) -> DataFrame:
    """``row`` (the document's columns) and ``matches``, the items that it holds within their budgets."""
    out = None
    for block in _blocks(items, item_id, item_text):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def find(text: pa.Array, sent=sent) -> list[pa.Array]:
            held = _built.get("last")  # one automaton for each worker, made anew when a block or rate follows
            if held is None or held[0] is not sent.value or held[1] != (rate, word_rate):
                _built["last"] = held = (sent.value, (rate, word_rate), Matcher(sent.value, rate, word_rate))
            matcher = held[2]
            rows = [[{"item": i, "unit": u, "distance": d, "end": e} for i, u, d, e in matcher.find(normalise(t))] for t in text.to_pylist()]
            return [pa.array(rows, MATCH_ARROW)]

        if out is None:
            out = map_rows(docs, text_col, [("matches", MATCH)], find, keep)
        else:  # the next block reads what the last one passed on
            flat = out.select(F.struct(F.col("row"), F.col("matches")).alias("held"), F.col("row").getField(text_col).alias("text"))
            out = map_rows(flat, "text", [("more", MATCH)], find, ["held"]).select(F.col("row.held.row").alias("row"), F.concat("row.held.matches", "more").alias("matches"))
    if out is None:
        return docs.select(row_of(docs, keep), F.array().cast(MATCH).alias("matches"))
    return out
