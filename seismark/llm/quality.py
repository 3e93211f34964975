"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger keeps the measurements and one
long whose bit i says that rule i failed. A policy is a named, versioned mask over those bits; verdicts and
ablations (what a rule rejects alone, what a policy keeps without it) come from the bits by bitwise
aggregation, without another look at any text.

Defined cases: a null or blank text has no words and fails ``few_words``; repeated rows are measured each;
an empty table gives an empty ledger; further columns of the input, whatever their names, stay in ``row``.
"""

from __future__ import annotations

from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import WORD_SPACE, map_rows, texts_of

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = b"abcdefghijklmnopqrstuvwxyz"
DIGITS = b"0123456789"

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_stutter"]

#: Rules by bit: (name, SQL that is true where the rule fails). Integers only, so that any engine gives the same bits.
RULES: list[tuple[str, str]] = [
    ("few_words", "n_words < 20"),
    ("repeated_windows", "100 * n_repeat_words > 30 * n_words"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 14 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("repeated_lines", "100 * n_dup_lines > 50 * n_lines"),
    ("capitals", "n_upper > n_lower"),
    ("digits", "100 * n_digits > 50 * word_chars"),
    ("stutter", "100 * n_stutter > 30 * n_words"),
]
BIT = {name: i for i, (name, _) in enumerate(RULES)}
BASE_MASK = (1 << BIT["few_words"]) | (1 << BIT["repeated_windows"])


@dataclass(frozen=True)
class Policy:
    """A versioned choice of rules; a document is rejected if one of them failed."""

    version: str
    mask: int


def policy(version: str, *rules: str) -> Policy:
    return Policy(version, sum(1 << BIT[r] for r in rules))


POLICIES = [
    policy("v1", "few_words", "repeated_windows"),
    policy("v2", "few_words", "repeated_windows", "symbols", "repeated_lines"),
    policy("v3", *BIT),
]
CURRENT = POLICIES[-1]

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)


def repeated_window_words(words: list[bytes]) -> int:
    """Words inside windows of eight words that occur twice or more (the first occurrence included)."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    index: dict[bytes, int] = {}
    put = index.setdefault
    ids = np.array([put(w, len(index)) for w in words], dtype=np.uint64) + np.uint64(1)
    if len(index) == len(words):
        return 0
    h = ids[:n] * _MIX[0]
    for j in range(1, WINDOW):
        h += ids[j : n + j] * _MIX[j]
    h ^= h >> np.uint64(29)
    order = np.sort(h)
    same = order[1:] == order[:-1]
    if not same.any():  # equal windows have equal hashes
        return 0
    first: dict[bytes, int] = {}
    covered = np.zeros(len(words) + 1, dtype=np.int64)
    small = ids.astype(np.uint32)
    hit: set[int] = set()
    for i in np.flatnonzero(np.isin(h, order[1:][same])).tolist():
        key = small[i : i + WINDOW].tobytes()  # exact, whatever the hash says
        j = first.setdefault(key, i)
        if j != i:
            hit.add(i)
            hit.add(j)
    for i in hit:
        covered[i] += 1
        covered[i + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(covered)))


def _measure(text: pa.Array) -> list[pa.Array]:
    points = pc.fill_null(pc.utf8_length(text), 0).to_pylist()
    out: list[list[int]] = [[] for _ in MEASURES]
    for raw, n_points in zip(texts_of(text), points, strict=True):
        raw = raw or b""
        size = len(raw)
        words = raw.split()
        lines = [x for x in raw.split(b"\n") if x.strip()]
        row = (
            len(words),
            n_points - (size - len(raw.translate(None, WORD_SPACE))),
            size - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)),
            repeated_window_words(words),
            len(lines),
            size - len(raw.translate(None, UPPER)),
            size - len(raw.translate(None, LOWER)),
            size - len(raw.translate(None, DIGITS)),
            sum(map(eq, words, words[1:])),
        )
        for column, value in zip(out, row, strict=True):
            column.append(value)
    return [pa.array(x, pa.int64()) for x in out]


def _bits() -> Column:
    bits = F.lit(0).cast("long")
    for i, (_, fails) in enumerate(RULES):
        bits = bits.bitwiseOR(F.when(F.expr(fails), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row for each document: ``row`` (its columns), the measurements, ``failure_bits``."""
    return map_rows(docs, text_col, [(m, T.LongType()) for m in MEASURES], _measure, keep).withColumn("failure_bits", _bits())


def passes(bits: Column, chosen: Policy = CURRENT) -> Column:
    return bits.bitwiseAND(F.lit(chosen.mask).cast("long")) == 0


def ablations(led: DataFrame, policies: list[Policy] = POLICIES) -> DataFrame:
    """For each policy and rule in it: documents that fail the rule, documents that fail nothing else of the
    policy (sole), what the policy keeps, and what it would keep without the rule. The ledger is first summed by
    distinct bits (at most 2^rules rows, combined before the shuffle)."""
    counts = led.groupBy("failure_bits").agg(F.count("*").alias("n"))
    arms = [(p.version, p.mask, name, 1 << i) for p in policies for name, i in BIT.items() if p.mask >> i & 1]
    arm = F.explode(F.array(*[F.struct(F.lit(v).alias("policy"), F.lit(m).cast("long").alias("mask"), F.lit(r).alias("rule"), F.lit(b).cast("long").alias("bit")) for v, m, r, b in arms]))
    failed = F.col("failure_bits").bitwiseAND(F.col("arm.mask"))
    n_if = lambda c: F.sum(F.when(c, F.col("n")).otherwise(F.lit(0).cast("long")))
    return (
        counts.select("failure_bits", "n", arm.alias("arm"))
        .groupBy("arm.policy", "arm.rule")
        .agg(
            n_if(failed.bitwiseAND(F.col("arm.bit")) != 0).alias("n_failed"),
            n_if(failed == F.col("arm.bit")).alias("n_sole"),
            n_if(failed == 0).alias("n_kept"),
            n_if(failed.bitwiseAND(F.bitwise_not(F.col("arm.bit"))) == 0).alias("n_kept_without"),
        )
    )
