"""Ranked search, WARC archives and the filter audit against brute force, and their defined cases."""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seismark.llm import filter_audit, search, warc
from seismark.llm._common import scratch_path

SF = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
A_TO_Z = {c: c + 32 for c in range(65, 91)}


# search


def brute_search(docs, items, top=10):
    counted = [(d, Counter(TERM.findall((t or "").translate(A_TO_Z)))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    big_n, big_l = len(counted), sum(n for _, _, n in counted)
    out = []
    for item, text in items:
        found = []
        for d, c, n in counted:
            score = 0
            for t in set(TERM.findall((text or "").translate(A_TO_Z))) & c.keys():
                df = sum(t in x for _, x, _ in counted)
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df + 1)))
                score += w * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * (10 + 90 * n * big_n // big_l)))
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block, impacts, packed", [(search.BLOCK, search.IMPACTS, search.PACKED), (60, 7, 3)])
def test_search_is_brute_force(spark, monkeypatch, block, impacts, packed):
    rng = random.Random(3)
    pool = [*"abcdefgh", "Ünï", "漢字", "x9", "İ", "Z"]
    texts = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 30))) + rng.choice(["", "-", "!a"])) for i in range(60)]
    texts += [(70, None), (71, ""), (72, " .\n"), (None, "a b"), (None, "a b"), (5, "a b c"), (80, "a " * 5000), *[(i, "same same text") for i in range(90, 110)]]
    items = [(1, "A b, ünï"), (2, None), (3, "..."), (4, "nowhere"), (1, "same TEXT"), (None, "漢字 x9 İ"), (6, " ".join(pool)), (7, "a")]
    docs = spark.createDataFrame([(*t, 1, 2) for t in texts], "doc_id long, text string, score int, n int").repartition(5)
    monkeypatch.setattr(search, "IMPACTS", impacts)
    monkeypatch.setattr(search, "PACKED", packed)
    got = search.search(docs, spark.createDataFrame([(*i, 0) for i in items], "item_id long, text string, rank int"), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_search(texts, items)
    assert search.search(docs.limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert search.search(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


@given(st.lists(st.integers(0, 2**32 - 1), max_size=200))
@settings(max_examples=100, deadline=None)
def test_radix_order_is_stable_order(keys):
    keys = np.array(keys, np.uint32)
    assert search.radix_order(keys).tolist() == np.argsort(keys, kind="stable").tolist()


@given(st.text())
@settings(max_examples=200, deadline=None)
def test_terms_are_those_of_the_pattern(text):
    assert [t.decode() for t in search.terms(text.encode())] == TERM.findall(text.translate(A_TO_Z))


# WARC


def test_records_survive_any_pieces():
    records = [warc.page_record(i, f"http://h/{i} é\r\n", b"\r\n\r\nWARC/1.1\r\n" * i + b"\x00") for i in range(9)]
    whole = b"".join(r.to_bytes() for r in records)
    for size in (1, 7, 64, len(whole)):
        p = warc.Parser()
        got = [r for at in range(0, len(whole), size) for r in p.feed(whole[at : at + size])]
        p.close()
        assert got == [r.to_bytes() for r in records]
    head, block = warc.split_record(got[3])
    assert block == records[3].block and head["warc-target-uri"] == "http://h/3%20é%0D%0A"
    with pytest.raises(ValueError):
        warc.split_record(got[3][:-1])


@pytest.mark.parametrize("size", [0, 5, warc.PIECE, 3 * warc.PIECE + 1])
def test_inflated(size):
    """Members of any number; output that does not fit a piece; files that are cut off."""
    one, two = b"a" * size, np.random.default_rng(1).bytes(size)
    packed = gzip.compress(one) + gzip.compress(two)
    pieces = list(warc.inflated(io.BytesIO(packed).read))
    assert b"".join(pieces) == one + two and max(map(len, pieces)) <= warc.PIECE
    with pytest.raises(ValueError):
        list(warc.inflated(io.BytesIO(packed[:-9]).read))


@pytest.mark.parametrize("hot", [2, warc.HOT])
def test_archives(spark, monkeypatch, hot):
    monkeypatch.setattr(warc, "HOT", hot)
    long = "x" * 1000
    rows = [(1, "u1", long), (2, "u2", long), (3, None, long), (3, "u3", long), (4, "u4", "x" * 999), (5, "u5", "x" * 999), (6, "u 6\r\nX: y", "é" * 500), (7, "u7", "é" * 500), (8, "u8", None), (9, "u9", ""), (None, "n", long), (None, "n", "y" * 2000), (None, "n", "y" * 2000), (10, "u10", "\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame([(*r, "c", 1) for r in rows], "page_id long, url string, html string, key string, n int").repartition(3)
    uri = scratch_path(spark, "test")
    whole = warc.write(warc.decisions(pages), f"{uri}/a", roll=1500)
    assert whole.count() > 3 and whole.agg(F.sum("records")).first()[0] == len(rows)  # files roll
    members = warc.normalise(whole, f"{uri}/a", f"{uri}/b")
    got = warc.read(spark, members, f"{uri}/b").collect()
    want = []
    for i, _, h in rows:
        raw = (h or "").encode()
        same = [j for j, _, x in rows if (x or "") == (h or "") and j is not None]
        top = max(same, default=None)
        again = len(raw) >= 1000 and top is not None and i != top
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", top if again else None, None if again else raw))
    assert sorted(map(repr, want)) == sorted(repr((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))) for r in got)
    ids = {r.page_id: r.record_id for r in got}
    assert all(r.refers_to_record == ids[r.refers_to] for r in got if r.refers_to) and {r.uri for r in got if r.page_id == 6} == {"u%206%0D%0AX:%20y"}
    fs, root = warc.filesystem(f"{uri}/b")
    for r in members.collect():  # a member for each record, and the index points at it
        with fs.open_input_stream(f"{root}/{r.name}.warc.gz", compression=None) as f:
            raw = f.read()
        at = list(warc.index_of(fs, f"{root}/{r.name}.idx"))
        assert len(at) == r.records and sum(x["length"] for x in at) == len(raw) == r.bytes
        assert all(gzip.decompress(raw[x["offset"] : x["offset"] + x["length"]]).startswith(b"WARC/1.1\r\n") for x in at)
    bare = warc.write(warc.decisions(pages.limit(0)), f"{uri}/c")
    assert warc.read(spark, warc.normalise(bare, f"{uri}/c", f"{uri}/d"), f"{uri}/d").count() == 0


def test_a_changed_payload_is_refused():
    raw = warc.page_record(1, "u", b"payload").to_bytes()
    assert warc._capture(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc._capture(raw.replace(b"\r\n\r\npayload", b"\r\n\r\npayloaD"))


# filter audit


def test_audit_is_brute_force(spark):
    rng = random.Random(5)
    base = ["a b c", "", "A" * 50 + " x", " ".join(f"w{i}" for i in range(250)), "w " * 300, "x # y", " ".join(f"W{i}" for i in range(210)) + " %", "é " * 201]
    docs = [(i, rng.choice([*base, None]), rng.choice(["s", "t", None, ""])) for i in range(120)] + [(None, "a b c", "s"), (7, "a b c", "t"), (7, "unique words", "t")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1), (4000, 1, 1)]
    df = spark.createDataFrame([(*d, 1, "m") for d in docs], "doc_id long, text string, source string, mask int, part string").repartition(4)
    got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, x in labels if x == 1}
    facts = []
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first.get(t, i)}
        facts.append((s or "", fails, i is not None and i in good, i is not None and i in toxic))
    parts = {f[0] for f in facts}
    assert len(got) == 600 * len(parts)
    shapley = Counter()
    for p in parts:
        for order in permutations("ABCDE"):
            for s, f in enumerate(order):
                mine = [x for x in facts if x[0] == p]
                gone = [any(x[1][g] for g in order[:s]) for x in mine]
                out = [x for x, g in zip(mine, gone, strict=True) if x[1][f] and not g]
                r = got[p, "".join(order), s + 1]
                assert r.kept == sum(not x[1][f] and not g for x, g in zip(mine, gone, strict=True)) and r.removed == len(out)
                assert r.redundant == sum(x[1][f] and g for x, g in zip(mine, gone, strict=True)) and r.unique_fails == sum(x[1][f] and sum(x[1].values()) == 1 for x in mine)
                assert (r.good_lost, r.toxic_lost) == (sum(x[2] for x in out), sum(x[3] for x in out))
                shapley[p, f] += len(out)
    assert all(r.shapley == shapley[p, o[s - 1]] for (p, o, s), r in got.items())
    assert filter_audit.audit(df.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0
    assert filter_audit.audit(df, spark.createDataFrame([], "doc_id long, quality int, toxic int")).agg(F.sum("good_lost")).first()[0] == 0


def test_products_stack_many_parts(spark):
    """More parts than one product takes; a slice of a batch is read at its own place."""
    n = 700
    rows = [(str(i), [i if k == 1 else 0 for k in range(32)], [1] * 32, [0] * 32) for i in range(n)]
    got = filter_audit.products(spark.createDataFrame(rows, "part string, n array<long>, good array<long>, toxic array<long>").coalesce(1))
    assert got.count() == 600 * n and got.filter("filter_order = 'ABCDE' and step = 1 and removed <> cast(part as long)").count() == 0


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_warc", "op13_filter_audit"])
def test_sql_twin(spark, name):
    import duckdb

    from seismark.llm.queries import ORACLE, QUERIES

    c = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "labels"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = QUERIES[name](spark, SF)
    got = c.execute(ORACLE[name])
    cols = sorted(d[0] for d in got.description)
    assert sorted(df.columns) == cols
    assert sorted(repr([r[k] for k in cols]) for r in df.collect()) == sorted(repr(list(r)) for r in c.execute(f"select {', '.join(cols)} from ({ORACLE[name]})").fetchall())
