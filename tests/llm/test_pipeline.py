"""The pipeline's rows against a brute-force version on a small table."""

import re

import corpus_pipeline as cp
from seismark.llm import decontaminate, quality, simhash

SF = "/root/testdata/sf0.001"


def test_stages():
    assert [n for n, _ in cp.STAGES] == ["quality rules", "near-duplicates", "benchmark decontamination", "secret scans", "SentencePiece encoding"]


def test_run_matches_brute_force(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    kept = []
    for d in docs:
        raw = d["text"].encode()
        words, lines = raw.split(), [x for x in raw.split(b"\n") if x.strip()]
        count = lambda pattern, t=d["text"]: len(re.findall(pattern, t))
        m = {"n_words": len(words), "word_chars": sum(len(w.decode()) for w in words), "n_symbols": count(r"[#*$%&|<>]"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": quality.repeated_window_words(words), "n_lines": len(lines), "n_upper": count("[A-Z]"), "n_lower": count("[a-z]"), "n_digits": count("[0-9]"), "n_stutter": sum(a == b for a, b in zip(words, words[1:], strict=False))}
        if not any(eval(rule, {}, m) for _, rule in quality.RULES):  # noqa: S307
            kept.append(d)
    fp = {d["doc_id"]: simhash.fingerprint(d["text"].encode()) for d in kept}
    group = {i: i for i in fp}
    changed = True
    while changed:
        changed = False
        for i in fp:
            for j in fp:
                if group[i] < group[j] and (fp[i] ^ fp[j]).bit_count() <= 4:
                    group[j], changed = group[i], True
    kept = [d for d in kept if group[d["doc_id"]] == d["doc_id"]]
    items = [decontaminate.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = [d for d in kept if not any(i in decontaminate.normalise(d["text"]) for i in items)]
    got = {r.doc_id: r for r in cp.run(spark, SF).collect()}
    assert set(got) == {d["doc_id"] for d in clean}
    for d in clean:
        r = got[d["doc_id"]]
        assert r.round_trip and r.n_tokens == len(r.ids) and len(r.text) == r.n_chars
        if "[secret]" not in r.text:
            assert r.text == d["text"]
        assert not re.search(r"AKIA[A-Z0-9]{16}|(?<![0-9a-f])[0-9a-f]{24,}", r.text)


def test_stages_keep_columns_and_take_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, "en", "s", 0), (2, "", None, None, 0), (2, "x " * 40, "en", "s", 80), (None, "some words here to keep " * 9 + "and on", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in cp.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert cp.STAGES[-1][1](spark, docs, SF).count() == 4
