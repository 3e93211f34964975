"""WARC archives: writing, normalising whole-file gzip streams, reading by a sidecar index.

``write`` deals pages to archives in which all records of a file are one gzip stream, as some crawlers leave them: nothing in such a file can be
reached without inflating what is before it. ``normalise`` inflates each file once, as a stream, and rewrites every record as a gzip member
of its own, with a sidecar index of (offset, length, type, ids, digest) beside it. ``read`` takes the index and fetches each record by a
ranged read of its member alone.

Of captures with equal payloads (equal SHA-256 and length) of at least ``SHORTEST`` bytes, the one with the largest page_id is a ``response``; the others are
``revisit`` records with HTTP headers, digest and reference, but no payload. Payloads that very many pages share are joined by a bounded broadcast; short
pages take no part in a join.

Files: ``NNNNN-<attempt>-<k>.warc.gz`` for the k-th file of a task (a file is closed after ``ROLL`` bytes of records), ``.idx`` the index, one JSON line a
record. Names are of an attempt and manifests are tables of the names that Spark accepted, so a task that ran twice, or whose executor was lost half
way, leaves nothing that is read.

Defined cases: a null html is an empty payload; a null url is a record without WARC-Target-URI; control characters and blanks of a url are
percent-encoded in the header, as its lines cannot hold them; among equal payloads null page_ids come last, and every row with the largest
page_id is a response (rows equal in id and payload are one capture written twice); an empty table gives no archives.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field as attribute

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import HOT, field, materialize, slices
from .token_files import filesystem

SHORTEST = 1000
#: Bytes of records after which a task begins a new file; bytes that are inflated or copied at once.
ROLL, PIECE = 256 << 20, 1 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_SPACE = uuid.UUID("9f3f8d5c-2f2c-4a57-9d4e-5a1d3c1f7a10")


@dataclass
class Record:
    """A record's named fields, in order, and its block."""

    fields: dict[str, str]
    block: bytes = b""

    def to_bytes(self) -> bytes:
        head = "".join(f"{k}: {v}\r\n" for k, v in (self.fields | {"Content-Length": str(len(self.block))}).items())
        return f"WARC/1.1\r\n{head}\r\n".encode() + self.block + b"\r\n\r\n"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}/{digest}')}>"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None) -> Record:
    """A capture as a response, or as a revisit of the page ``refers_to``."""
    digest = hashlib.sha1(payload).digest()
    fields = {"WARC-Type": "response" if refers_to is None else "revisit", "WARC-Record-ID": record_id(page_id, digest.hex()), "WARC-Date": DATE}
    if url is not None:
        fields["WARC-Target-URI"] = _encoded(url)
    if page_id is not None:
        fields["X-Page-ID"] = str(page_id)
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(refers_to, digest.hex()), "X-Refers-To-Page-ID": str(refers_to)}
        if refers_url is not None:
            fields["WARC-Refers-To-Target-URI"] = _encoded(refers_url)
    fields |= {"WARC-Payload-Digest": "sha1:" + base64.b32encode(digest).decode(), "Content-Type": "application/http; msgtype=response"}
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return Record(fields, http + (payload if refers_to is None else b""))


def _encoded(url: str) -> str:
    return _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)


@dataclass
class Parser:
    """Cuts a stream of inflated bytes into records, as pieces arrive; holds one record and a piece at most."""

    held: bytearray = attribute(default_factory=bytearray)
    need: int = 0

    def feed(self, piece: bytes) -> Iterator[bytes]:
        """The whole records (head, block, closing lines) that the bytes so far complete."""
        self.held += piece
        at = 0
        while True:
            if not self.need:
                end = self.held.find(b"\r\n\r\n", at)
                if end < 0:
                    break
                self.need = end + 4 - at + int(parse_head(bytes(self.held[at:end]))["content-length"]) + 4
            if len(self.held) - at < self.need:
                break
            yield bytes(self.held[at : at + self.need])
            at, self.need = at + self.need, 0
        del self.held[:at]

    def close(self) -> None:
        if self.held:
            raise ValueError(f"{len(self.held)} bytes after the last whole record")


def parse_head(head: bytes) -> dict[str, str]:
    """The named fields, names in lower case. The first line is the version."""
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/1."):
        raise ValueError(f"no record begins with {version[:20]!r}")
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def split_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and its block."""
    end = raw.index(b"\r\n\r\n")
    head = parse_head(raw[:end])
    size = int(head["content-length"])
    block = raw[end + 4 : end + 4 + size]
    if len(block) < size or raw[end + 4 + size :] != b"\r\n\r\n":
        raise ValueError("a record does not end where its length says")
    return head, block


def inflated(read: Callable[[int], bytes]) -> Iterator[bytes]:
    """A gzip file's bytes in pieces of bounded size, whatever its members."""
    inner, began = zlib.decompressobj(31), False
    while raw := read(PIECE):
        full = False
        while raw or full:
            out = inner.decompress(raw, PIECE)
            yield out
            began, full = True, len(out) == PIECE  # more may be held back, though all input is taken
            if inner.eof:
                raw, inner, began, full = inner.unused_data, zlib.decompressobj(31), False, False
            else:
                raw = inner.unconsumed_tail
    if began and not inner.eof:
        raise ValueError("the gzip stream is cut off")


def decisions(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", shortest: int = SHORTEST) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url): refers_to is null where the page is written as a response."""
    src = pages.select(field(id_col).cast("long").alias("page_id"), field(url_col).alias("url"), F.coalesce(field(html_col), F.lit("")).alias("html"))
    none = (F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    short = src.filter(F.octet_length("html") < shortest).select("page_id", "url", "html", *none)
    long = src.filter(F.octet_length("html") >= shortest).withColumn("key", F.concat(F.sha2("html", 256), F.lit("-"), F.octet_length("html")))
    groups = long.groupBy("key").agg(F.max(F.struct("page_id", "url")).alias("last"), F.count("*").alias("n"))
    groups = materialize(groups.filter("n > 1"), "equal-payloads")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if not total:
        return short.unionByName(long.select("page_id", "url", "html", *none))
    many = F.col("n") > total / HOT  # fewer than HOT payloads
    hot, rest = F.broadcast(groups.filter(many).drop("n")), groups.filter(~many).drop("n")
    joined = long.join(hot, "key").unionByName(long.join(hot.select("key"), "key", "left_anti").join(rest, "key", "left"))
    again = F.col("last.page_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last.page_id"))
    return short.unionByName(joined.select("page_id", "url", "html", F.when(again, F.col("last.page_id")).alias("refers_to"), F.when(again, F.col("last.url")).alias("refers_url")))


def write(decided: DataFrame, uri: str, roll: int = ROLL) -> DataFrame:
    """Writes the archives, each one gzip stream; returns the table of their names (name, records, bytes)."""
    fs, root = filesystem(uri)
    fs.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, root = filesystem(uri)
        stem = f"{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:12]}"
        done: list[tuple[str, int, int]] = []
        to = packer = None
        size = records = 0

        def close() -> None:
            if to is not None:
                to.write(packer.flush())
                to.close()
                done.append((f"{stem}-{len(done)}", records, size))

        for whole in batches:
            for b in slices(whole, whole.column(2)):
                for r in b.to_pylist():
                    if to is None or size >= roll:
                        close()
                        to, packer, size, records = fs.open_output_stream(f"{root}/{stem}-{len(done)}.warc.gz", compression=None), zlib.compressobj(1, wbits=31), 0, 0
                        info = Record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": DATE, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n")
                        to.write(packer.compress(info.to_bytes()))
                    raw = page_record(r["page_id"], r["url"], r["html"].encode(), r["refers_to"], r["refers_url"]).to_bytes()
                    to.write(packer.compress(raw))
                    size, records = size + len(raw), records + 1
        close()
        yield pa.RecordBatch.from_pydict({"name": [x[0] for x in done], "records": [x[1] for x in done], "bytes": [x[2] for x in done]}, pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return materialize(decided.select("page_id", "url", "html", "refers_to", "refers_url").mapInArrow(run, "name string, records long, bytes long"), "archives")


def normalise(archives: DataFrame, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrites the named archives below ``target`` with a gzip member for each record; returns the table of their names (name, records, bytes)."""
    fs, root = filesystem(target)
    fs.create_dir(root, recursive=True)
    n = archives.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (in_fs, in_root), (out_fs, out_root) = filesystem(source), filesystem(target)
        for b in batches:
            for old in b.column(0).to_pylist():
                name = f"{old}-{uuid.uuid4().hex[:12]}"
                parser, offset, records = Parser(), 0, 0
                with in_fs.open_input_stream(f"{in_root}/{old}.warc.gz", compression=None) as f, out_fs.open_output_stream(f"{out_root}/{name}.warc.gz", compression=None) as to, out_fs.open_output_stream(f"{out_root}/{name}.idx", compression=None) as index:
                    for piece in inflated(f.read):
                        for raw in parser.feed(piece):
                            packer = zlib.compressobj(level, wbits=31)
                            member = packer.compress(raw) + packer.flush()
                            head, _ = split_record(raw)
                            line = {"offset": offset, "length": len(member), "type": head["warc-type"], "id": head["warc-record-id"], "uri": head.get("warc-target-uri"), "digest": head.get("warc-payload-digest")}
                            index.write(json.dumps(line).encode() + b"\n")
                            to.write(member)
                            offset, records = offset + len(member), records + 1
                    parser.close()
                yield pa.RecordBatch.from_pydict({"name": [name], "records": [records], "bytes": [offset]})

    return materialize(archives.select("name").repartition(max(n, 1)).mapInArrow(run, "name string, records long, bytes long"), "normalised")


def index_of(fs: pafs.FileSystem, path: str) -> Iterator[dict]:
    """The entries of a sidecar index, read in pieces."""
    rest = b""
    with fs.open_input_stream(path) as f:
        while piece := f.read(PIECE):
            *lines, rest = (rest + piece).split(b"\n")
            yield from map(json.loads, lines)


def read(spark: SparkSession, archives: DataFrame, uri: str) -> DataFrame:
    """Every record of the normalised archives, by the sidecar index: (type, record_id, uri, page_id, refers_to, refers_to_record, payload_bytes, payload_digest,
    payload). A response's length and digest are those of the payload read, and must be those of its header; a revisit's are its
    header's, and its payload is null."""
    schema = "record_type string, record_id string, uri string, page_id long, refers_to long, refers_to_record string, payload_bytes long, payload_digest string, payload binary"
    arrow = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("uri", pa.string()), ("page_id", pa.int64()), ("refers_to", pa.int64()), ("refers_to_record", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, size = [], 0
                with fs.open_input_file(f"{root}/{name}.warc.gz") as f:
                    for at in index_of(fs, f"{root}/{name}.idx"):
                        if at["type"] not in ("response", "revisit"):
                            continue
                        rows.append(_capture(zlib.decompress(f.read_at(at["length"], at["offset"]), 31)))
                        size += len(rows[-1]["payload"] or b"") + 500
                        if size > PIECE:
                            yield pa.RecordBatch.from_pylist(rows, arrow)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, arrow)

    n = archives.count()
    return archives.select("name").repartition(max(n, 1)).mapInArrow(run, schema)


def _capture(raw: bytes) -> dict:
    head, block = split_record(raw)
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^content-length: *(\d+)\r?$", http)[1])
    digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
    full = head["warc-type"] == "response"
    if full and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {head['warc-record-id']} is not what its header says")
    number = lambda k: int(head[k]) if k in head else None
    return {
        "record_type": head["warc-type"], "record_id": head["warc-record-id"], "uri": head.get("warc-target-uri"), "page_id": number("x-page-id"), "refers_to": number("x-refers-to-page-id"),
        "refers_to_record": head.get("warc-refers-to"), "payload_bytes": size, "payload_digest": digest, "payload": payload if full else None,
    }
