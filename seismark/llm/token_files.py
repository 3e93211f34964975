"""Token ids as flat unsigned integer files with 64-bit document offsets, memory-mapped for reading.

Layout of a data set in a shared folder, for shards 0..P-1 in ascending document order:
``NNNNN-<attempt>.bin`` all ids, little-endian unsigned 16 or 32 bits (by vocabulary size), nothing between documents;
``NNNNN-<attempt>.idx`` documents + 1 little-endian int64 offsets, in ids from the shard's start;
``NNNNN-<attempt>.ids`` the documents' ids as little-endian int64 (zero for a null id);
``manifest.json`` the integer width, the end id, and for each shard its files, counts, null ids and bases: the documents and ids
of all shards before it, prefix sums over the shard totals (the driver sees one row for each shard).

A shard's files get names of their own for each attempt and the manifest names those of the attempt that Spark accepted, so a
task that ran twice, or whose executor was lost half way, leaves nothing that is read.

Defined cases: a null or empty text is a document of the end id alone; null ids come first; rows with equal ids are
ordered by their text's hash (equal rows are alike in any order); an empty table gives a data set without shards.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import texts_of

#: Entries that a worker's caches of words and of word parts hold before they start anew.
WORDS, PARTS = 200_000, 1_200_000
#: The pre-tokenizer pattern for which plain texts are cut by _CUT.
_LATIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ňŊ-ž"
#: Texts that lower() and the file's normaliser treat alike: ASCII and composed Latin letters.
_PLAIN = re.compile(rf"[\t-\r\x20-\x7e{_LETTERS}]*")
#: What _LATIN_PATTERN finds in a plain text: its alternatives begin with different characters, so their order is free.
_CUT = re.compile(rf"[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\s{_LETTERS}0-9]+")


class WordEncoder:
    """Encodes whole texts with a tokenizers file, through memos of words and word parts.

    A text's ids are those of its words one after another wherever neither the normaliser nor the pre-tokenizer
    looks across ASCII white space and drops it, which the constructor asserts of the file. Words that
    repeat are looked up; others go through the library."""

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        spec = json.loads(self.tok.to_str())
        wide = max(self.tok.get_vocab_size(), end_id + 1) > 1 << 16
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.end = np.array([end_id], self.kind).tobytes()
        self.words: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
        norms = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = split.get("behavior") == "Removed" and split.get("invert") is True and norms == ["NFC", "Replace", "Lowercase"]
        self.by_word = self.by_word and split["pattern"].get("Regex") == _LATIN_PATTERN
        self.marks = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self.model, self.pre = self.tok.model, self.tok.pre_tokenizer

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _part(self, part: str) -> bytes:
        got = self.parts.get(part)
        if got is None:
            if len(self.parts) >= PARTS:
                self.parts.clear()
            inner = part if part.isascii() else self.pre.pre_tokenize_str(part)[0][0]
            got = self.parts[part] = self._pack([t.id for t in self.model.tokenize(inner)])
        return got

    def _word(self, raw: bytes) -> bytes:
        got = self._pack(self.tok.encode(raw.decode(), add_special_tokens=False).ids)
        if len(self.words) >= WORDS:
            self.words.clear()
        self.words[raw] = got
        return got

    def encode(self, raw: bytes | None) -> bytes:
        """The ids of a whole text and the end id."""
        if not raw:
            return self.end
        text = raw.decode()
        if not self.by_word:
            return self._pack(self.tok.encode(text, add_special_tokens=False).ids) + self.end
        if _PLAIN.fullmatch(text) and not self.marks.search(text):
            get, found, make = self.parts.get, _CUT.findall(text.lower()), self._part
        else:
            get, found, make = self.words.get, raw.split(), self._word
        out = list(map(get, found))
        if None in out:
            out = [(get(w) or make(w)) if x is None else x for x, w in zip(out, found, strict=True)]
        out.append(self.end)
        return b"".join(out)


_held: dict[tuple, WordEncoder] = {}


def encoder(path: str, end_id: int) -> WordEncoder:
    if (path, end_id) not in _held:
        _held.clear()
        _held[path, end_id] = WordEncoder(path, end_id)
    return _held[path, end_id]


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """A folder in a local mount or an object store, by its URI."""
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:") if uri.startswith(("/", "file:")) else uri)


def write(docs: DataFrame, uri: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None) -> dict:
    """Writes the data set; returns its manifest. Documents are dealt to shards by ranges of (id, text hash)."""
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).withColumn("h", F.xxhash64("text"))
    dealt = src.repartitionByRange(n, "id", "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h").select("id", "text")
    fs, root = filesystem(uri)
    fs.create_dir(root, recursive=True)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first = next(batches, None)
        if first is None:
            return
        enc = encoder(tokenizer, end_id)
        width, part = enc.kind.itemsize, TaskContext.get().partitionId()
        fs, root = filesystem(uri)
        name = f"{part:05d}-{uuid.uuid4().hex[:12]}"
        docs_n = tokens = nulls = 0
        with fs.open_output_stream(f"{root}/{name}.bin") as ids_to, fs.open_output_stream(f"{root}/{name}.idx") as offsets_to, fs.open_output_stream(f"{root}/{name}.ids") as docs_to:
            offsets_to.write(np.zeros(1, "<i8").tobytes())
            for b in _with(first, batches):
                blobs = [enc.encode(x) for x in texts_of(b.column(1))]
                lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // width
                ids_to.write(b"".join(blobs))
                offsets_to.write((tokens + np.cumsum(lengths)).astype("<i8").tobytes())
                nulls += b.column(0).null_count
                docs_to.write(b.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes())
                tokens, docs_n = tokens + int(lengths.sum()), docs_n + b.num_rows
        yield pa.RecordBatch.from_pydict({"shard": [part], "name": [name], "docs": [docs_n], "tokens": [tokens], "nulls": [nulls], "width": [width]})

    rows = sorted(dealt.mapInArrow(shard, "shard long, name string, docs long, tokens long, nulls long, width long").collect())  # a row for each shard
    base_docs = base_tokens = 0
    out = []
    for r in rows:
        out.append({"name": r["name"], "docs": r["docs"], "tokens": r["tokens"], "nulls": r["nulls"], "base_docs": base_docs, "base_tokens": base_tokens})
        base_docs, base_tokens = base_docs + r["docs"], base_tokens + r["tokens"]
    manifest = {"width": rows[0]["width"] if rows else 2, "end_id": end_id, "docs": base_docs, "tokens": base_tokens, "shards": out}
    with fs.open_output_stream(f"{root}/manifest.json") as to:
        to.write(json.dumps(manifest).encode())
    return manifest


def _with(first: pa.RecordBatch, rest: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield first
    yield from rest


def open_manifest(uri: str) -> dict:
    fs, root = filesystem(uri)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        return json.loads(f.read())


def ranges(fs: pafs.FileSystem, path: str, kind: str) -> Callable[[int, int], np.ndarray]:
    """Reads entries a to z of a file: of a memory map where the folder is a local mount, else by a ranged read."""
    size = np.dtype(kind).itemsize
    if isinstance(fs, pafs.LocalFileSystem):
        whole = np.memmap(path, kind, "r") if os.path.getsize(path) else np.zeros(0, kind)
        return lambda a, z: whole[a:z]
    f = fs.open_input_file(path)
    return lambda a, z: np.frombuffer(f.read_at((z - a) * size, a * size), kind)


def read_digests(spark: SparkSession, uri: str, rows_at_once: int = 10_000) -> DataFrame:
    """One row for each document, from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as 32-bit integers)."""
    manifest = open_manifest(uri)
    kind = "<u4" if manifest["width"] == 4 else "<u2"
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    todo = [(s["name"], s["docs"], s["base_tokens"], s["nulls"]) for s in manifest["shards"]]
    if not todo:
        return spark.createDataFrame([], schema)
    shards = spark.createDataFrame(todo, "name string, docs long, base long, nulls long").repartition(len(todo))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(uri)
        for b in batches:
            for s in b.to_pylist():
                ids = ranges(fs, f"{root}/{s['name']}.bin", kind)
                offsets = ranges(fs, f"{root}/{s['name']}.idx", "<i8")
                docs = ranges(fs, f"{root}/{s['name']}.ids", "<i8")
                for i in range(0, s["docs"], rows_at_once):
                    z = min(i + rows_at_once, s["docs"])
                    at = offsets(i, z + 1)
                    cuts = (at - at[0]).tolist()
                    block = ids(int(at[0]), int(at[-1]))
                    crc = [zlib.crc32(block[a:e].astype("<u4")) for a, e in zip(cuts, cuts[1:], strict=False)]
                    none = np.arange(i, z) < s["nulls"]
                    yield pa.RecordBatch.from_arrays([pa.array(docs(i, z), pa.int64(), mask=none), pa.array(at[:-1] + s["base"], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return shards.mapInArrow(read, schema)
