"""SentencePiece encoding and decoding by suffix-array matching.

The distinct chunks of a batch are concatenated and indexed by a suffix array (ordered as deep as the longest piece). Every piece's
occurrences are one range of it, found by two binary searches. The resulting edges (start, length, piece) are sorted by position, and the
lattice of each chunk is relaxed over them:

* for a BPE file by its own rule: start from single characters and take the best-scored edge that joins two neighbours (the leftmost
  of equal ones) until none is left. This gives the ids of the SentencePiece library itself;
* for a unigram file (and ``rule="unigram"``) as a shortest path: positions in order, each keeping its best sum of scores.

A chunk is a run of spaces with the non-spaces after it: no piece of such a file has a non-space before a space, so
chunks are independent (files for which this fails are refused). Within a chunk, nothing is ever joined over a place that no edge of two or more
characters covers, so a chunk falls apart there: short parts are merged side by side, a round for each merge; long ones over a heap of pairs, in
O(n log n). A chunk longer than ``INDEXED`` is read in windows, each up to its last such place. Characters without a piece become their UTF-8 bytes' pieces. Spaces are
written U+2581 and one is put before the text, as the files say; decoding undoes both, so texts come back exactly, but for U+2581
itself, which comes back as a space.

Defined cases: null and empty texts have no ids and decode to an empty text; blank texts keep their spaces; repeated rows are encoded
each; chunks of any length are encoded whole; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import map_rows

SPACE = "▁"
#: Chunks that a worker keeps encoded, and characters that it indexes at once.
KEPT, INDEXED = 300_000, 400_000
#: Bytes of text that a worker encodes at once.
SLICE = 2 << 20
#: Characters of a part that is merged in rounds at most, and of a chunk that a worker keeps.
ROUNDS, SHORT = 48, 200
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NONE = np.iinfo(np.int32).max


class Pieces:
    """A SentencePiece file's pieces in rank order (best score first)."""

    def __init__(self, path: str, rule: str | None = None):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        norm, kind = proto.normalizer_spec, proto.trainer_spec.model_type
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not (norm.add_dummy_prefix and norm.escape_whitespaces):
            raise ValueError("only files that keep texts as they are, with a space before them, can be read")
        self.rule = rule or {1: "unigram", 2: "bpe"}[kind]
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.vocab_size())
        self.text = [sp.id_to_piece(i) for i in ids]
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        if any(SPACE in self.text[i].lstrip(SPACE) for i in plain):
            raise ValueError("a piece has a space after another character")
        self.byte = {int(self.text[i][3:-1], 16): i for i in ids if sp.is_byte(i)}
        if len(self.byte) < 256:
            raise ValueError("the file has no byte pieces")
        self.single = {self.text[i]: i for i in plain if len(self.text[i]) == 1}
        self.plain = plain
        self.longest = max(len(self.text[i]) for i in plain)
        self.alphabet = np.array(sorted({ord(c) for i in plain for c in self.text[i]}), np.uint32)
        order = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        rank = {i: r for r, i in enumerate(order)}
        self.rank_of = np.array([rank[i] for i in plain], np.int32)
        self.id_of_rank = np.array(order, np.int32)
        self.score_of_rank = np.array([sp.get_score(i) for i in order])
        self.floor = float(self.score_of_rank.min()) - 10
        self.lengths = np.array([len(self.text[i]) for i in plain], np.int64)
        self.keys = self._coded([self.text[i] for i in plain])
        self.raw = [bytes([int(t[3:-1], 16)]) if sp.is_byte(i) else b"" if sp.is_control(i) else t.replace(SPACE, " ").encode() for i, t in enumerate(self.text)]

    def symbols(self, text: str) -> np.ndarray:
        """A character's place in the alphabet, from 1; 0 if no piece holds it."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        at = np.searchsorted(self.alphabet, points)
        at[at == len(self.alphabet)] = 0
        return np.where(self.alphabet[at] == points, at + 1, 0).astype(">u2")

    def _coded(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.longest), ">u2")
        for i, t in enumerate(texts):
            out[i, : len(t)] = self.symbols(t)
        return out.view(f"S{2 * self.longest}").ravel()

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, length, rank) of every occurrence of every piece, sorted by start, then length."""
        depth = self.longest
        sym = np.zeros(len(text) + depth, ">u2")
        sym[: len(text)] = self.symbols(text)
        rows = np.lib.stride_tricks.sliding_window_view(sym, depth)[: len(text)]
        suffix = np.ascontiguousarray(rows).view(f"S{2 * depth}").ravel()
        array = self._order(sym, len(text))
        suffix = suffix[array]
        low = np.searchsorted(suffix, self.keys, "left")
        after = self.keys.view(np.uint8).reshape(len(self.keys), -1).copy()
        after[np.arange(2 * depth)[None] >= 2 * self.lengths[:, None]] = 0xFF
        high = np.searchsorted(suffix, after.view(f"S{2 * depth}").ravel(), "right")
        n = high - low
        which = np.repeat(np.arange(len(n)), n)
        at = array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)]
        length, rank = self.lengths[which], self.rank_of[which]
        by = np.argsort(at * (depth + 1) + length)
        return at[by], length[by], rank[by]

    def _order(self, sym: np.ndarray, n: int) -> np.ndarray:
        """The suffix array to the depth of the longest piece or more, by doubling: ranks of 4 symbols, then of 8, 16, ..."""
        s = np.zeros(n + 3, np.uint64)
        s[:n] = sym[:n]
        key = s[:n] << np.uint64(48) | s[1 : n + 1] << np.uint64(32) | s[2 : n + 2] << np.uint64(16) | s[3 : n + 3]
        depth, order = 4, np.argsort(key)
        while depth < self.longest and n:
            ordered = key[order]
            rank = np.empty(n, np.uint64)
            rank[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1])).astype(np.uint64)
            after = np.zeros(n, np.uint64)
            if n > depth:
                after[:-depth] = rank[depth:]
            key = rank << np.uint64(32) | after
            depth, order = 2 * depth, np.argsort(key)
        return order

    def encode_chunks(self, chunks: list[str]) -> list[bytes]:
        """The ids of each chunk, as little-endian 32-bit integers."""
        text = "".join(chunks)
        sizes = np.fromiter(map(len, chunks), np.int64, len(chunks))
        start, length, rank = self.edges(text)
        owner = np.repeat(np.arange(len(chunks)), sizes)
        inside = owner[np.minimum(start + length, len(text)) - 1] == owner[start]
        inside &= start + length <= len(text)
        start, length, rank = start[inside], length[inside], rank[inside]
        if self.rule == "unigram":
            ends = self._shortest(text, sizes, start, length, rank)
        else:
            ends = self._merged(len(text), start, length, rank)
        table = np.full((len(text), self.longest + 1), -1, np.int32)
        table[start, length] = rank
        begins, spans = ends
        got = table[begins, np.minimum(spans, self.longest)]
        ids = np.where(got >= 0, self.id_of_rank[got], -1)
        counts = np.bincount(owner[begins], minlength=len(chunks)) if len(begins) else np.zeros(len(chunks), np.int64)
        first = np.cumsum(counts) - counts
        blob, cuts = ids.astype("<i4").tobytes(), (4 * first).tolist() + [4 * len(ids)]
        out = [blob[a:z] for a, z in zip(cuts, cuts[1:], strict=False)]
        for k in np.unique(owner[begins[ids < 0]]).tolist() if (ids < 0).any() else []:
            row: list[int] = []
            at = slice(first[k], first[k] + counts[k])
            for i, b in zip(ids[at].tolist(), begins[at].tolist(), strict=True):
                row += [i] if i >= 0 else [self.byte[x] for x in text[b].encode()]
            out[k] = np.array(row, "<i4").tobytes()
        return out

    def apart(self, n: int, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """For each of n characters whether no edge of two or more characters reaches over its beginning."""
        over = np.bincount(start + 1, length > 1, n + self.longest + 1) - np.bincount(start + length, length > 1, n + self.longest + 1)
        return np.cumsum(over)[:n] < 0.5

    def _merged(self, n: int, start: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and lengths of the symbols that are left when no two neighbours can be joined."""
        table = np.full((n, self.longest + 1), _NONE, np.int32)
        table[start, length] = rank
        part = np.cumsum(self.apart(n, start, length)) - 1
        sizes = np.bincount(part) if n else np.zeros(0, np.int64)
        rounds = sizes[part] <= ROUNDS
        found = [self._in_rounds(np.flatnonzero(rounds), part, table)]
        first = np.cumsum(sizes) - sizes
        for k in np.flatnonzero(sizes > ROUNDS).tolist():
            found.append(self._by_heap(int(first[k]), int(sizes[k]), table))
        begins, spans = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(begins, kind="stable")
        return begins[order], spans[order]

    def _by_heap(self, at: int, n: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One part: its pairs in a heap by rank, then place; a pair that has changed since is passed over."""
        wide, longest = self.longest + 1, self.longest
        rank_of = memoryview(table.reshape(-1))[at * wide : (at + n) * wide]
        size, after, before = [1] * n, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank_of[i * wide + 2]) != _NONE]
        heapify(heap)
        while heap:
            key = heappop(heap)
            i = key & 0xFFFFFFFF
            j = after[i]
            if not size[i] or j == n:
                continue
            joined = size[i] + size[j]
            if joined > longest or rank_of[i * wide + joined] != key >> 32:
                continue
            size[i], size[j] = joined, 0
            j = after[i] = after[j]
            if j < n:
                before[j] = i
                more = joined + size[j]
                if more <= longest and (r := rank_of[i * wide + more]) != _NONE:
                    heappush(heap, r << 32 | i)
            h = before[i]
            if h >= 0:
                more = size[h] + joined
                if more <= longest and (r := rank_of[h * wide + more]) != _NONE:
                    heappush(heap, r << 32 | h)
        spans = np.array(size, np.int64)
        begins = np.flatnonzero(spans)
        return begins + at, spans[begins]

    def _in_rounds(self, b: np.ndarray, part: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts side by side: in each round the best pair of neighbours of every part that still has one becomes one symbol."""
        done_b, done_l = [b[:0]], [b[:0]]
        size = np.ones(len(b), np.int64)
        while len(b):
            joined = size[:-1] + size[1:]
            pair = np.where((part[b[:-1]] == part[b[1:]]) & (joined <= self.longest), table[b[:-1], np.minimum(joined, self.longest)], _NONE)
            pair = np.append(pair, np.int32(_NONE))
            own = part[b]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            best = np.minimum.reduceat(pair, heads)
            per = np.diff(np.append(heads, len(b)))
            # a part without a pair left is done
            quiet = np.repeat(best == _NONE, per)
            done_b.append(b[quiet])
            done_l.append(size[quiet])
            at = np.flatnonzero((pair == np.repeat(best, per)) & ~quiet)
            at = at[np.append(True, own[at][1:] != own[at][:-1])] if len(at) else at  # the leftmost one of each part
            size[at] += size[at + 1] if len(at) else 0
            stay = ~quiet
            stay[at + 1] = False
            b, size = b[stay], size[stay]
        return np.concatenate(done_b), np.concatenate(done_l)

    def encode_long(self, chunk: str) -> bytes:
        """A chunk of any length: windows of it, each up to the last place that no edge reaches over. A window without such a place grows."""
        out, at, size = [], 0, INDEXED
        while at < len(chunk):
            window = chunk[at : at + size + self.longest]
            cut = len(window)
            if at + cut < len(chunk):
                start, length, _ = self.edges(window)
                whole = start + length <= len(window)
                free = np.flatnonzero(self.apart(size + 1, *(x[whole & (start <= size)] for x in (start, length))))
                cut = int(free[-1])
                if not cut:
                    size *= 2
                    continue
            out += self.encode_chunks([window[:cut]])
            at, size = at + cut, INDEXED
        return b"".join(out)

    def _shortest(self, text: str, sizes: np.ndarray, start: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        begins, spans = [], []
        first = np.searchsorted(start, np.arange(len(text) + 1)).tolist()
        lengths, scores = length.tolist(), self.score_of_rank[rank].tolist()
        at = 0
        for size in sizes.tolist():
            best, back = [0.0] + [-1e300] * size, [0] * (size + 1)
            for i in range(size):
                for e in range(first[at + i], first[at + i + 1]):
                    z, s = i + lengths[e], best[i] + scores[e]
                    if s > best[z]:
                        best[z], back[z] = s, i
                if best[i + 1] == -1e300 or (best[i] + self.floor > best[i + 1] and text[at + i] not in self.single):
                    best[i + 1], back[i + 1] = best[i] + self.floor, i
            cut, z = [], size
            while z:
                cut.append((at + back[z], z - back[z]))
                z = back[z]
            for b, n in reversed(cut):
                begins.append(b)
                spans.append(n)
            at += size
        return np.array(begins, np.int64), np.array(spans, np.int64)


_held: dict[tuple, tuple[Pieces, dict[str, bytes]]] = {}


def _pieces(path: str, rule: str | None) -> tuple[Pieces, dict[str, bytes]]:
    if (path, rule) not in _held:
        _held.clear()
        _held[path, rule] = (Pieces(path, rule), {})
    return _held[path, rule]


def encode_texts(path: str, texts: list[str | None], rule: str | None = None) -> list[np.ndarray]:
    """The ids of each text."""
    pieces, known = _pieces(path, rule)
    split = [_CHUNK.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
    new = set().union(*split).difference(known)
    if len(known) + len(new) > KEPT:
        known.clear()
        new = set().union(*split)
    found: dict[str, bytes] = {}
    group: list[str] = []
    size = 0
    for chunk in new:
        if len(chunk) > INDEXED:
            found[chunk] = pieces.encode_long(chunk)
            continue
        group.append(chunk)
        size += len(chunk)
        if size > INDEXED:
            found.update(zip(group, pieces.encode_chunks(group), strict=True))
            group, size = [], 0
    if group:
        found.update(zip(group, pieces.encode_chunks(group), strict=True))
    known.update({c: ids for c, ids in found.items() if len(c) <= SHORT})
    held = {c: ids for c, ids in found.items() if len(c) > SHORT}
    if held:
        get = lambda c: known[c] if c in known else held[c]
    else:
        get = known.__getitem__
    return [np.frombuffer(b"".join(map(get, chunks)), "<i4") for chunks in split]


def decode_ids(path: str, ids: np.ndarray, rule: str | None = None) -> str:
    pieces, _ = _pieces(path, rule)
    text = b"".join(map(pieces.raw.__getitem__, ids.tolist())).decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def encode(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None, rule: str | None = None, check: bool = False) -> DataFrame:
    """``row``, ``ids`` and their crc32 (of little-endian 32-bit integers). With ``check`` each text is decoded again where it was
    encoded, and ``decoded_chars`` and ``round_trip`` (whether the text came back) follow."""

    def run(text: pa.Array) -> list[pa.Array]:
        texts = text.to_pylist()
        rows = encode_texts(model, texts, rule)
        ends = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
        flat = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int32), pa.int32())
        out = [pa.ListArray.from_arrays(pa.array(ends), flat), pa.array([zlib.crc32(r) for r in rows], pa.int64())]
        if check:
            chars, same = [], []
            for t, r in zip(texts, rows, strict=True):
                back = decode_ids(model, r, rule)
                chars.append(len(back))
                same.append(back == (t or ""))
            out += [pa.array(chars, pa.int64()), pa.array(same, pa.bool_())]
        return out

    add = [("ids", T.ArrayType(T.IntegerType())), ("ids_crc32", T.LongType())]
    if check:
        add += [("decoded_chars", T.LongType()), ("round_trip", T.BooleanType())]
    return map_rows(docs, text_col, add, run, keep, SLICE)


def decode(encoded: DataFrame, model: str, ids_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """``row`` and ``decoded``, the text that the ids stand for."""

    def run(ids: pa.Array) -> list[pa.Array]:
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        cuts, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
        return [pa.array([decode_ids(model, flat[a:z]) for a, z in zip(cuts, cuts[1:], strict=False)], pa.string())]

    return map_rows(encoded, ids_col, [("decoded", T.StringType())], run, keep)
