"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance d <= 2r share a value within r bits of both. So every distinct fingerprint
emits all its variants within r = radius // 2 bits, equal variants meet, and those that meet are linked. All
members of one variant's bucket lie within 2r of each other, so a bucket of any size is linked by a star
to its smallest member: a pair for each member, none for each pair of members, and no link is lost.

The 2,081 variants of a fingerprint (r = 2) are never written out. A variant's leading bits decide the place where it meets others, so a
fingerprint goes once to each place that its variants reach, and the receiving task expands the variants that belong there, block by
block. Places are prefixes: as many bits as the number of fingerprints asks for, and more wherever a place would hold over ``PLACE``
fingerprints, until none does (near copies share their leading bits, so some places fill up faster). Copies count once
(fingerprints are made distinct first), so a group of copies of any size is one row here.

Defined cases: a null, empty or blank text has fingerprint zero, linked like any other; under ``shingle`` words the
whole sequence is the one shingle; documents with a null id are fingerprinted and get the smallest id
of their component, null if it has none; repeated rows stay repeated; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import join_spread, map_rows, materialize, texts_of
from .components import connected_components

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Variants that a task expands at once (8 bytes each, and as many again while sorting).
BLOCK = 4_000_000
#: Fingerprints that one place holds at most, and the bits by which a fuller one is split.
PLACE, SPLIT = 250_000, 6
_A_TO_Z = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_CHUNK = 65_536


def fingerprint(raw: bytes | None, shingle: int = SHINGLE) -> int:
    """Bit b is set if it is set in more than half of the hashes of the text's word shingles."""
    words = (raw or b"").translate(_A_TO_Z).split()
    if not words:
        return 0
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    n = max(len(words) - shingle + 1, 1)
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    starts = np.concatenate(([0], ends[: n - 1] + 1)).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(flat[a:z], SEED) for a, z in zip(starts, last.tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK, None].view(np.uint8), axis=1, bitorder="little")
        # groups of 255 rows add up in single bytes
        whole = len(bits) // 255 * 255
        if whole:
            ones += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        ones += bits[whole:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def _prints(text: pa.Array) -> list[pa.Array]:
    return [pa.array(np.array([fingerprint(x) for x in texts_of(text)], np.uint64).view(np.int64), pa.int64())]


def fingerprints(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``fp`` (the 64 bits as a signed long)."""
    return map_rows(docs, text_col, [("fp", T.LongType())], _prints, keep)


def _flips(bits: int, most: int) -> list[np.ndarray]:
    """Masks over so many low bits, by the number of bits that they flip."""
    out = [np.zeros(1, np.uint64)]
    for k in range(1, most + 1):
        out.append(np.array([sum(1 << b for b in c) for c in combinations(range(bits), k)], np.uint64))
    return out


def _forest(fps: np.ndarray, spent: np.ndarray, prefix_bits: int, half: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fps that meet under one prefix: each linked member with the smallest of its group here. ``spent``: bits by which
    a fingerprint's own prefix differs from it; the others may differ below the prefix."""
    low = 64 - prefix_bits
    masks = _flips(low, half)
    suffix = fps & np.uint64((1 << low) - 1)
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        while (up := parent.setdefault(i, i)) != i:
            parent[i] = parent[up]
            i = up
        return i

    # variants are taken in slices by their own leading bits, so that memory is bounded whatever the number of fingerprints
    by_spent = [np.flatnonzero(spent == d) for d in range(half + 1)]
    total = sum(len(ix) * sum(len(m) for m in masks[: half - d + 1]) for d, ix in enumerate(by_spent))
    cut = min(max(0, int(np.ceil(np.log2(max(total / BLOCK, 1))))), low)
    for part in range(1 << cut):
        values, owners = [], []
        for d, ix in enumerate(by_spent):
            if not len(ix):
                continue
            for mask in masks[: half - d + 1]:
                if cut:
                    shift = np.uint64(low - cut)
                    tops = suffix[ix] >> shift
                    for top in np.unique(mask >> shift).tolist():
                        chosen = ix[tops ^ np.uint64(top) == part]
                        if len(chosen):
                            own = mask[mask >> shift == top]
                            values.append((suffix[chosen, None] ^ own).ravel())
                            owners.append(np.repeat(chosen, len(own)))
                else:
                    values.append((suffix[ix, None] ^ mask).ravel())
                    owners.append(np.repeat(ix, len(mask)))
        if not values:
            continue
        value, owner = np.concatenate(values), np.concatenate(owners)
        ordered = np.sort(value)
        twice = ordered[1:][ordered[1:] == ordered[:-1]]
        if not len(twice):
            continue
        # a table of 2^20 bits thins the variants before the exact search
        table = np.zeros(1 << 20, bool)
        slot = lambda v: (v * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(44)
        table[slot(twice)] = True
        near = np.flatnonzero(table[slot(value)])
        v, o = value[near], owner[near]
        order = np.argsort(v, kind="stable")
        v, o = v[order], o[order]
        meet = np.flatnonzero(v[1:] == v[:-1])
        pairs = np.unique(np.stack([o[meet], o[meet + 1]], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        for i, j in pairs[np.bitwise_count(fps[pairs[:, 0]] ^ fps[pairs[:, 1]]) <= 2 * half].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b)] = min(a, b)
    linked = np.array([i for i in parent if root(i) != i], np.int64)
    return linked, np.array([root(i) for i in linked.tolist()], np.int64)


def first_bits(n: int, half: int, place: int = 0) -> int:
    """The fewest prefix bits (six at least) at which n evenly spread fingerprints fill no place beyond half of ``place``."""
    p = 6
    while p < 40 and n * sum(comb(p, k) for k in range(half + 1)) / 2**p > (place or PLACE) / 2:
        p += 2
    return p


def links(distinct_fps: DataFrame, radius: int = RADIUS, prefix_bits: int | None = None, node: str = "fp") -> DataFrame:
    """Pairs (a, b) of the ``node`` values of distinct ``fp`` rows, whose components are those of "at most ``radius`` bits apart".
    radius is even."""
    half = radius // 2
    if radius % 2:
        raise ValueError("radius must be even: each side takes half of it")
    p = prefix_bits or first_bits(distinct_fps.count(), half)
    kind = distinct_fps.schema[node].dataType
    masks = [(m, d) for d, ms in enumerate(_flips(p, half)) for m in ms.astype(np.int64).tolist()]
    prefix = F.shiftrightunsigned("fp", 64 - p)
    goes = F.explode(F.array(*[F.struct(prefix.bitwiseXOR(F.lit(m)).alias("prefix"), F.lit(d).alias("spent")) for m, d in masks])).alias("to")
    sent = distinct_fps.select("fp", F.col(node).alias("node"), goes).select("fp", "node", "to.prefix", "to.spent")
    met = None
    while True:
        full = sent.groupBy("prefix").agg(F.count("*").alias("n")).filter(F.col("n") > PLACE).select("prefix")
        full = materialize(full, "full-places")
        last = p + SPLIT > 58 or full.isEmpty()
        here = sent if last else sent.join(full, "prefix", "left_anti")
        found = _meet(here, p, half, kind)
        met = found if met is None else met.unionByName(found)
        if last:
            return met.distinct()
        # the variants of a full place go on to longer prefixes, with the flips that are left
        more = [(m, d) for d, ms in enumerate(_flips(SPLIT, half)) for m in ms.astype(np.int64).tolist()]
        at = F.shiftleft("prefix", SPLIT).bitwiseOR(F.shiftrightunsigned("fp", 64 - p - SPLIT).bitwiseAND(F.lit((1 << SPLIT) - 1)))
        goes = F.explode(F.array(*[F.struct(at.bitwiseXOR(F.lit(m)).alias("prefix"), (F.col("spent") + d).alias("spent")) for m, d in more])).alias("to")
        sent = sent.join(full, "prefix", "left_semi").select("fp", "node", goes).select("fp", "node", "to.prefix", "to.spent").filter(F.col("spent") <= half)
        p += SPLIT


def _meet(sent: DataFrame, p: int, half: int, kind: T.DataType) -> DataFrame:
    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches).sort_by("fp")
        fps, spent = held.column("fp").to_numpy().view(np.uint64), held.column("spent").to_numpy()
        a, b = _forest(fps, spent, p, half)
        nodes = held.column("node").combine_chunks()
        yield pa.RecordBatch.from_arrays([nodes.take(pa.array(a)), nodes.take(pa.array(b))], names=["a", "b"])

    return sent.groupBy("prefix").applyInArrow(meet, T.StructType([T.StructField("a", kind), T.StructField("b", kind)]))


def labelled(prints: DataFrame, id_col: str = "id", radius: int = RADIUS, prefix_bits: int | None = None) -> DataFrame:
    """For each distinct ``fp`` of prints: ``print`` (the fingerprint), ``component`` (a key), ``n`` (its rows) and ``component_id``, the smallest id
    that links lead to (null if there is none). A node of the links is a fingerprint with its smallest id before it, so the smallest node
    reachable is the answer itself and no component's members ever meet; fingerprints without any id come after all others."""
    least = prints.groupBy("fp").agg(F.min(id_col).cast("long").alias("least"), F.count("*").alias("n"))
    node = F.struct(F.col("least").isNull().alias("none"), F.coalesce("least", F.lit(0).cast("long")).alias("id"), "fp")
    ids = materialize(least.select("fp", node.alias("node"), "n"), "distinct-fingerprints")
    comp = connected_components(materialize(links(ids, radius, prefix_bits, "node"), "links")).select(F.col("node.fp").alias("print"), "component")
    found = ids.join(comp, F.col("fp") == F.col("print"), "left").select(F.col("fp").alias("print"), F.coalesce("component", "node").alias("component"), "n")
    return found.withColumn("component_id", F.when(~F.col("component.none"), F.col("component.id")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, prefix_bits: int | None = None) -> DataFrame:
    """One row for each document: ``id``, ``fp``, ``component_id`` (the smallest id that links lead to). Ids are integers."""
    held = materialize(fingerprints(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), "text", ["id"]).select("row.id", "fp"), "fingerprints")
    label = materialize(labelled(held, "id", radius, prefix_bits).select("print", "component_id", "n"), "labels")
    return join_spread(held, label.withColumnRenamed("print", "fp"), "fp", held.count()).select("id", "fp", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of docs, one for each component: the one with the smallest id (null ids last); among rows with that id the
    one with the smallest text hash, then an arbitrary but fixed one of the equal rows. Rows are told apart by their place in a written
    table, not by their id, so a repeated or missing id never costs a text that is not a copy."""
    held = materialize(fingerprints(docs, text_col), "with-fingerprints")
    place = F.struct(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("at"))
    rows = held.select(F.col("row").getField(id_col).alias("id"), F.col("fp"), F.xxhash64(F.col("row").getField(text_col)).alias("h"), place.alias("place"))
    # the best row of each fingerprint, then of each component: both are minima, combined before the shuffle
    order = F.struct(F.col("id").isNull().alias("none"), "id", "h", "place")
    best = materialize(rows.groupBy("fp").agg(F.min(order).alias("best")), "best-of-fingerprint")
    label = labelled(best.select("fp", F.col("best.id").alias("id")), "id", radius)
    # a component is known by its smallest id; one without any id, by its smallest fingerprint
    named = best.join(label, F.col("fp") == F.col("print"))
    chosen = named.groupBy("component").agg(F.min("best").alias("best")).select("best.place.*")
    back = held.select("row", place.alias("place")).select("row", "place.*")
    kept = back.join(chosen.hint("shuffle_hash"), ["file", "at"], "left_semi")
    return kept.select("row.*")
