"""Chat formatting over a prefix tree of conversations.

Conversations that begin with the same turns share the nodes of those turns. All conversations are sorted by their path of turn hashes, which is
a depth-first walk of the tree: what a conversation shares with the one before it is on the tree already, and only the turns beyond that (its
*branch*) are written. A branch carries the position at which its first unit stands (after its ancestors), and the intervals of the packed
sequence that its units attend to besides their own branch: those of its ancestor turns. Units are code points, or token ids of a
tokenizers file; a turn's marks and its text are encoded apart, so that the loss mask falls between units.

The walk needs the current path only. Ranges of the sorted conversations are walked at once, each as if it were the first; the driver then goes from range to
range (one row for each, with two paths): what a range's first conversation shares with the last one before it is taken out again, and all places in the range
move by the units before it. Reading back walks the packed rows in the same way. So the data are shuffled once to gather conversations, once
to sort them and once to read them back, whatever they share: no turn is joined by its content.

Template: ``<s>[INST] user [/INST]``, `` assistant </s>``, ``<<SYS>> system <</SYS>>`` and ``[ROLE name] text [/ROLE]`` for any other role, each with
single spaces inside its marks. A control string inside a text (``<s>``, ``</s>``, ``[INST]`` ...) gets a backslash after its first
character, one more if it has some already; reading takes one away, so any text comes back exactly. Only assistant texts are under
the loss mask.

Defined cases: null texts and roles are empty; turns are ordered by turn (nulls first), then role and text; conversations with equal turns
share all their nodes; rows with a null id form one conversation; an empty table gives an empty result. A conversation is a bounded
unit: its turns meet in one task. Nothing else does: conversations that share a path, however many, are told apart by their ids in the sort.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import materialize

_CONTROL = re.compile(r"([<\[])(\\*)(?=/?(?:s>|INST\]|ROLE[ \]]|SYS>>))")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(?=/?(?:s>|INST\]|ROLE[ \]]|SYS>>))")
_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]| (?P<assistant>.*?) </s>|<<SYS>> (?P<system>.*?) <</SYS>>|\[ROLE (?P<role>.*?)\] (?P<text>.*?) \[/ROLE\]", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and the bounds of its escaped text."""
    body = escape(text)
    if role == "user":
        head, tail = "<s>[INST] ", " [/INST]"
    elif role == "assistant":
        head, tail = " ", " </s>"
    elif role == "system":
        head, tail = "<<SYS>> ", " <</SYS>>"
    else:
        head, tail = f"[ROLE {_hide(role)}] ", " [/ROLE]"
    return head + body + tail, len(head), len(head) + len(body)


def _hide(role: str) -> str:
    """A role name without the bracket that would end it."""
    return escape(role).replace("\\", "\\\\").replace("]", "\\)")


def _show(role: str) -> str:
    out = re.sub(r"\\([\\)])", lambda m: "\\" if m[1] == "\\" else "]", role)
    return unescape(out)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; every character belongs to one."""
    turns, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        if m["role"] is not None:
            turns.append((_show(m["role"]), unescape(m["text"])))
        else:
            role = next(r for r in ("user", "assistant", "system") if m[r] is not None)
            turns.append((role, unescape(m[role])))
    if at != len(formatted):
        raise ValueError(f"unreadable at {at}")
    return turns


class Units:
    """Turns as units: code points, or ids of a tokenizers file in which no string of a text is special."""

    def __init__(self, tokenizer: str | None):
        self.tok = None
        if tokenizer:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            from tokenizers import Tokenizer

            self.tok = Tokenizer.from_file(tokenizer)
            self.tok.encode_special_tokens = True
            self.tok.no_truncation()
            self.tok.no_padding()

        self.marks: dict = {}  # the template's own strings, which every turn repeats

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch(texts, add_special_tokens=False)] if self.tok else [[ord(c) for c in x] for x in texts]

    def _mark(self, text: str) -> list[int]:
        if text not in self.marks:
            if len(self.marks) > 1_000:
                self.marks.clear()
            self.marks[text] = self._ids([text])[0]
        return self.marks[text]

    def of(self, turns: list[tuple[str, str]]) -> list[dict]:
        """For each (role, text): its units, and which of them are its escaped text."""
        out, cut = [], []
        for role, text in turns:
            segment, a, z = render(role, text)
            out.append({"role": role, "head": segment[:a], "tail": segment[z:]})
            cut.append(segment[a:z])
        for t, body in zip(out, self._ids(cut) if cut else [], strict=True):
            head, tail = self._mark(t.pop("head")), self._mark(t.pop("tail"))
            t |= {"units": [*head, *body, *tail], "text_from": len(head), "text_to": len(head) + len(body)}
        return out

    def text(self, units: list[int]) -> str:
        return self.tok.decode(units, skip_special_tokens=False) if self.tok else "".join(map(chr, units))

    def parts(self, t: dict) -> tuple[str, str, str]:
        """A turn's head, escaped text and tail, from its units."""
        u, a, z = t["units"], t["text_from"], t["text_to"]
        ends = []
        for part in (tuple(u[:a]), tuple(u[z:])):
            if part not in self.marks:
                if len(self.marks) > 1_000:
                    self.marks.clear()
                self.marks[part] = self.text(list(part))
            ends.append(self.marks[part])
        return ends[0], self.text(u[a:z]), ends[1]


_INTERVALS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OWN = pa.list_(pa.struct([("role", pa.string()), ("units", pa.list_(pa.int32())), ("text_from", pa.int32()), ("text_to", pa.int32()), ("in_loss", pa.bool_())]))
_PACKED = T.StructType(
    [
        T.StructField("part", T.IntegerType()), T.StructField("at", T.LongType()), T.StructField("conv_id", T.LongType()), T.StructField("shared", T.IntegerType()), T.StructField("start", T.LongType()),
        T.StructField("turns", T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("units", T.ArrayType(T.IntegerType())), T.StructField("text_from", T.IntegerType()), T.StructField("text_to", T.IntegerType()), T.StructField("in_loss", T.BooleanType())]))),
        T.StructField("path", T.ArrayType(T.StringType())), T.StructField("attends", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)


def _common(a: list[str], b: list[str]) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _walk(tokenizer: str | None):
    """Sorted conversations of one range to packed rows, as if nothing came before: places count units from the range's start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        units, part = Units(tokenizer), TaskContext.get().partitionId()
        path: list[str] = []
        held: list[tuple[int, int]] = []
        at = total = 0
        for b in batches:
            rows = []
            for conv, turns, nodes in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                shared = _common(path, nodes)
                own = units.of([(t["role"], t["text"]) for t in turns[shared:]])
                held, start = held[:shared], total
                rows.append((part, at, conv, shared, start, [t | {"in_loss": t["role"] == "assistant"} for t in own], nodes, [{"start": a, "end": z} for a, z in held]))
                for t in own:
                    held.append((total, total + len(t["units"])))
                    total += len(t["units"])
                path, at = nodes, at + 1
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), _OWN, pa.list_(pa.string()), _INTERVALS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_PACKED.names)

    return run


class Packed:
    """``rows``: a row for each conversation, in depth-first order by (part, at): conv_id, ``shared`` (turns that it has in common with the row
    before it), ``turns`` (its own, with units, the bounds of the text among them, in_loss), ``start`` (where they begin in the packed
    sequence), ``position`` (of its first own unit) and ``attends`` (intervals of its ancestor turns). ``given``: part, depth and interval of the
    turns on the path that a part begins with."""

    def __init__(self, rows: DataFrame, given: DataFrame, tokenizer: str | None):
        self.rows, self.given, self.tokenizer = rows, given, tokenizer

    def turns(self) -> DataFrame:
        """Every turn of the tree once: packed_start, packed_end, position, role, units, the bounds of its text and in_loss."""
        own = F.posexplode(F.arrays_zip("turns", _ends("turns").alias("end"))).alias("depth", "x")
        size = F.size("x.turns.units")
        return self.rows.select("start", "position", own).select((F.col("start") + F.col("x.end") - size).alias("packed_start"), (F.col("start") + F.col("x.end")).alias("packed_end"), (F.col("position") + F.col("x.end") - size).alias("position"), "x.turns.*")


def _ends(turns: str) -> Column:
    """Running sums of the turns' units."""
    last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0).cast("long"))
    return F.aggregate(turns, F.array().cast("array<bigint>"), lambda acc, t: F.concat(acc, F.array(last(acc) + F.size(t["units"]))))


def pack(conversations: DataFrame, tokenizer: str | None = None) -> Packed:
    spark = conversations.sparkSession
    turn = F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # a turn's node: the hash of its parent's node, its role and its text
    node = lambda acc, t: F.substring(F.sha2(F.concat_ws("\x1f", acc, F.char_length(t["role"]).cast("string"), t["role"], t["text"]), 256), 1, 32)
    path = F.aggregate("turns", F.array().cast("array<string>"), lambda acc, t: F.concat(acc, F.array(node(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")), t))))
    held = materialize(convs.select("conv_id", "turns", path.alias("path")), "conversations")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = held.repartitionByRange(n, "path", "conv_id").sortWithinPartitions("path", "conv_id")
    rows = materialize(spread.mapInArrow(_walk(tokenizer), _PACKED), "packed")
    # from range to range: one row for each, with its first and its last conversation
    ends = lambda c: F.struct("path", "attends", "start", _ends("turns").alias("ends"))  # noqa: E731, ARG005
    parts = rows.groupBy("part").agg(F.min_by(ends(0), "at").alias("first"), F.max_by(ends(0), "at").alias("last"))
    base, path_before, where = 0, [], []
    moves, given = [], []
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        first, z = r["first"], r["last"]
        shared = _common(path_before, first["path"])
        twice = first["ends"][shared - 1] if shared else 0  # units that the range has written again
        known = where[:shared]
        places = [(a["start"], a["end"]) for a in z["attends"]] + [(z["start"] + a, z["start"] + e) for a, e in zip([0, *z["ends"]], z["ends"], strict=False)]
        where = [known[depth] if a < twice else (a - twice + base, e - twice + base) for depth, (a, e) in enumerate(places)]
        moves.append((r["part"], shared, twice, base, [{"start": a, "end": e} for a, e in known]))
        given += [(r["part"], depth, a, e) for depth, (a, e) in enumerate(known)]
        path_before, base = z["path"], base - twice + z["start"] + (z["ends"][-1] if z["ends"] else 0)
    table = spark.createDataFrame(moves, "part int, again int, twice long, base long, known array<struct<start:bigint,end:bigint>>")
    told = rows.join(F.broadcast(table), "part")  # a row for each range
    begins = (F.col("at") == 0) & (F.col("again") > 0)
    moved = lambda v: v - F.col("twice") + F.col("base")
    attends = F.transform("attends", lambda x, i: F.when(x["start"] < F.col("twice"), F.element_at("known", i + 1)).otherwise(F.struct(moved(x["start"]).alias("start"), moved(x["end"]).alias("end"))))
    placed = told.select(
        "part", "at", "conv_id", F.when(begins, F.col("again")).otherwise(F.col("shared")).alias("shared"), F.when(begins, F.col("base")).otherwise(moved(F.col("start"))).alias("start"),
        F.when(begins, F.slice("turns", F.col("again") + 1, F.greatest(F.size("turns"), F.lit(1)))).otherwise(F.col("turns")).alias("turns"), F.when(begins, F.col("known")).otherwise(attends).alias("attends"),
    )
    position = F.aggregate("attends", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["start"])
    return Packed(placed.withColumn("position", position), spark.createDataFrame(given, "part int, depth int, start long, end long"), tokenizer)


def read_back(packed: Packed) -> DataFrame:
    """One row for each conversation, from the packed output alone: the turns at its ``attends`` and its own are joined, parsed and unescaped; positions are checked."""
    # turns of earlier parts that a part begins with, as a row before its first
    lead = packed.turns().drop("position").join(F.broadcast(packed.given), F.col("packed_start") == F.col("start"))  # a path for each range
    turn = F.struct("role", "units", "text_from", "text_to", "in_loss")
    lead = lead.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("depth", turn.alias("turn"), F.struct("start", "end").alias("at"))), lambda a, b: a["depth"] - b["depth"]).alias("x"))
    empty = F.lit(0).cast("long")
    lead = lead.select("part", F.lit(-1).cast("long").alias("at"), F.lit(None).cast("long").alias("conv_id"), empty.alias("start"), F.transform("x", lambda v: v["turn"]).alias("turns"), F.transform("x", lambda v: v["at"]).alias("attends"), empty.alias("position"))
    cols = lead.columns
    n = int(packed.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = packed.rows.select(*cols).unionByName(lead).repartition(n, "part").sortWithinPartitions("part", "at")
    tokenizer = packed.tokenizer

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = Units(tokenizer)
        tree: dict[int, tuple[int, dict]] = {}  # turns of the current path by place
        before = last = None
        for b in batches:
            rows = []
            for part, at, conv, start, turns, attends, position in zip(*(b.column(c).to_pylist() for c in cols), strict=True):
                places = [(a["start"], a["end"]) for a in attends]
                if at < 0:
                    tree = {a: (z, t) for (a, z), t in zip(places, turns, strict=True)}
                    before = None
                    continue
                if before is None or before[0] != part:
                    tree = tree if at == 0 and before is None else {}
                if not (not turns and before == (part, places)):
                    path = []
                    for a, z in places:
                        if a not in tree or tree[a][0] != z:
                            raise ValueError(f"conversation {conv} attends to {a}:{z}, which is no turn of its path")
                        path.append((a, z, tree[a][1]))
                    if sum(z - a for a, z in places) != position:
                        raise ValueError(f"conversation {conv} begins at a wrong position")
                    for t in turns:
                        path.append((start, start + len(t["units"]), t))
                        start += len(t["units"])
                    tree = {a: (z, t) for a, z, t in path}
                    last = _digest(units, [t for _, _, t in path])
                    before = (part, [(a, z) for a, z, _ in path])
                rows.append((conv, *last))
            out = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i in (2, 4) else pa.int64()) for i, c in enumerate(out)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return ordered.mapInArrow(read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest(units: Units, path: list[dict]) -> tuple:
    parts = [units.parts(t) for t in path]
    formatted = "".join(x for part in parts for x in part)
    turns = parse(formatted)
    loss = "".join(unescape(body) for t, (_, body, _) in zip(path, parts, strict=True) if t["in_loss"])
    sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)


def with_probe(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The conversations and one more, -7, whose texts look like the template's own marks."""
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(probe)
