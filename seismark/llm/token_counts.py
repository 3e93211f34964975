"""Token counts under a unigram model, by dynamic programming over a trie of pre-tokens.

A pre-token is a word (what stands between ASCII white space) with U+2581 before it. Its best segmentation maximises the sum of
its pieces' scores; ties go to fewer tokens. The distinct pre-tokens of a worker's texts go into a trie; the forward score of a node (best sum and its
token count) depends on the path to it alone, so it is computed once for all words that share the prefix, in this batch or a later
one, and at a word's end the count is stored. A text's count is the sum over its words.

Characters that no piece holds fall back to their UTF-8 bytes: as many tokens, each scored below all pieces.

The scores are those that the file gives its pieces. For a BPE file these are merge ranks, so its counts are not those of its own encoder; README has the
difference in figures.

Defined cases: a null, empty or blank text has no words and no tokens; repeated rows are counted each; words of any length are
segmented whole; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ._common import map_rows, texts_of

#: Words whose counts, and nodes that, a worker keeps before it starts a new trie; characters of a word that go into the trie at most.
KEPT, NODES, DEEP = 500_000, 600_000, 200
SPACE = "▁"


def load_pieces(path: str) -> tuple[dict[str, float], float]:
    """Scores of a SentencePiece file's normal pieces, and the score of a fallback byte: the least one, less ten."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    return scores, min(scores.values()) - 10


class Trie:
    """Nodes are numbers; ``child`` holds them by parent and character, ``best`` and ``used`` their forward score and its tokens,
    ``ends`` the counts of the words that end at one."""

    def __init__(self, scores: dict[str, float], fallback: float):
        self.scores, self.fallback = scores, fallback
        self.longest = max(map(len, scores), default=1)
        self.clear()

    def clear(self) -> None:
        self.child: dict[int, int] = {}
        self.best, self.used = [0.0], [0]
        self.ends: dict[bytes, int] = {}

    def _forward(self, word: str, end: int, best: list[float], used: list[int], off: int = 0) -> tuple[float, int]:
        """The forward score of word[:end]; best[i] and used[i] are those of word[:i + off]."""
        get, top, n = self.scores.get, -1e300, 0
        for start in range(max(0, end - self.longest), end):
            score = get(word[start:end])
            if score is not None:
                total = best[start - off] + score
                if total > top or total == top and used[start - off] + 1 < n:
                    top, n = total, used[start - off] + 1
        if n:
            return top, n
        size = len(word[end - 1].encode())
        return best[end - 1 - off] + self.fallback * size, used[end - 1 - off] + size

    def insert(self, words: Iterable[bytes]) -> None:
        """Stores the words' counts; nodes that a word is the first to reach are scored. Words come in order, so each walks on from where
        it leaves the one before it."""
        child, best, used, ends = self.child, self.best, self.used, self.ends
        get, longest = self.scores.get, self.longest
        path, nodes, scored, counts = "", [0], [best[0]], [used[0]]
        for raw in sorted(words):
            word = SPACE + raw.decode()
            deep = min(len(word), DEEP)
            shared, most = 0, min(len(path), deep)
            while shared < most and path[shared] == word[shared]:
                shared += 1
            del nodes[shared + 1 :], scored[shared + 1 :], counts[shared + 1 :]
            node = nodes[-1]
            for end in range(shared + 1, deep + 1):
                key = node << 21 | ord(word[end - 1])
                node = child.get(key, 0)
                if not node:
                    top, n = -1e300, 0
                    for start in range(max(0, end - longest), end):
                        score = get(word[start:end])
                        if score is not None:
                            total = scored[start] + score
                            if total > top or total == top and counts[start] + 1 < n:
                                top, n = total, counts[start] + 1
                    if not n:
                        n = len(word[end - 1].encode())
                        top, n = scored[end - 1] + self.fallback * n, counts[end - 1] + n
                    node = child[key] = len(best)
                    best.append(top)
                    used.append(n)
                nodes.append(node)
                scored.append(best[node])
                counts.append(used[node])
            path = word[:deep]
            ends[raw] = counts[-1] if len(word) <= DEEP else self._beyond(word, scored, counts)

    def _beyond(self, word: str, scored: list[float], counts: list[int]) -> int:
        """The count of a word that is longer than the trie is deep: there only the last scores matter."""
        off = len(scored) - self.longest
        scored, counts = scored[off:], counts[off:]
        for end in range(DEEP + 1, len(word) + 1):
            if len(scored) > 64 * self.longest:
                off += len(scored) - self.longest
                scored, counts = scored[-self.longest :], counts[-self.longest :]
            top, n = self._forward(word, end, scored, counts, off)
            scored.append(top)
            counts.append(n)
        return counts[-1]


_held: dict[str, Trie] = {}


def _trie(path: str) -> Trie:
    if path not in _held:
        _held.clear()
        _held[path] = Trie(*load_pieces(path))
    return _held[path]


def count_texts(path: str, texts: list[bytes | None]) -> tuple[list[int], list[int]]:
    """(words, tokens) of each text."""
    trie = _trie(path)
    split = [(t or b"").split() for t in texts]
    new = set().union(*split).difference(trie.ends)
    if len(trie.ends) + len(new) > KEPT or len(trie.best) > NODES:
        trie.clear()
        new = set().union(*split)
    trie.insert(new)
    get = trie.ends.__getitem__
    return [len(w) for w in split], [sum(map(get, w)) for w in split]


def token_counts(docs: DataFrame, model: str, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row``, ``n_words`` and ``n_tokens`` of every text. Nothing is shuffled."""

    def run(text: pa.Array) -> list[pa.Array]:
        words, tokens = count_texts(model, texts_of(text))
        return [pa.array(words, pa.int64()), pa.array(tokens, pa.int64())]

    return map_rows(docs, text_col, [("n_words", T.LongType()), ("n_tokens", T.LongType())], run, keep)
