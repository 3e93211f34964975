"""The queries opN_<name>: each applies an operator to its whole table and returns its full result."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch_path, table

#: The end-of-document id that op6 appends.
END_ID = 2


def tokenizer_file(name: str) -> str:
    return importlib.import_module("public_tokenizers").path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality as q

    led = q.ledger(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base_failed = F.col("failure_bits").bitwiseAND(F.lit(q.BASE_MASK).cast("long")) != 0
    return led.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), q.passes(F.col("failure_bits")).alias("kept"), "failure_bits")


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import simhash as s

    found = s.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import html_text

    return html_text.extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("row.page_id", "row.url", "text", "n_chars")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    packed = chat.pack(chat.with_probe(spark, table(spark, sf_dir, "conversations")), tokenizer_file("byte_bpe_50k.json"))
    return chat.read_back(packed)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item found in it."""
    from . import decontaminate as d

    found = d.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("row.doc_id", F.explode("matches").alias("m")).select("doc_id", F.col("m.item").alias("item_id"), F.col("m.unit").alias("unit"), F.col("m.distance").cast("long").alias("distance"), F.col("m.end").alias("match_end"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_files as t

    uri = scratch_path(spark, "token-files")
    t.write(table(spark, sf_dir, "documents"), uri, tokenizer_file("word_bpe_49k.json"), END_ID)
    return t.read_digests(spark, uri)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import token_counts as t

    return t.token_counts(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), keep=["doc_id"]).select("row.doc_id", "n_words", "n_tokens")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import langid

    docs = table(spark, sf_dir, "documents")
    net = langid.fit(docs.filter(~langid.held_out(F.col("doc_id"))))
    found = langid.predict(docs, net, keep=["doc_id"])
    return found.select("row.doc_id", langid.held_out(F.col("row.doc_id")).alias("held_out"), "lang_pred", "score")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every text, their checksum (as little-endian 32-bit integers), and whether decoding them gives the text back."""
    from . import sentencepieces as s

    found = s.encode(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), keep=["doc_id"], check=True)
    return found.select("row.doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32", "decoded_chars", "round_trip")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import secrets as s

    found = s.secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long")
    spans = s.written(F.array_sort(F.concat("base", "random"), lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0)))
    return found.select("row.doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(s.written(F.col("base")), 256).alias("base_sha256"), spans.alias("spans"), F.size("random").cast("long").alias("n_random"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import search

    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as whole-file gzip archives, rewritten with a member for each record, and read back by the index."""
    from . import warc

    uri = scratch_path(spark, "warc")
    whole = warc.write(warc.decisions(table(spark, sf_dir, "pages")), f"{uri}/whole")
    found = warc.read(spark, warc.normalise(whole, f"{uri}/whole", f"{uri}/members"), f"{uri}/members")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_simhash_dedup": op2_simhash_dedup,
    "op3_html_text": op3_html_text,
    "op4_chat_format": op4_chat_format,
    "op5_decontaminate": op5_decontaminate,
    "op6_token_files": op6_token_files,
    "op7_token_counts": op7_token_counts,
    "op8_language_id": op8_language_id,
    "op9_sentencepiece": op9_sentencepiece,
    "op10_secret_scan": op10_secret_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_warc": op12_warc,
    "op13_filter_audit": op13_filter_audit,
}

#: n_repeat_words joins every 8-word window of a document with its kind; the rest are list functions.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
ORACLE = {
    "op1_quality_rules": rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text, {_WORDS} as ws from documents),
pos as (select rid, unnest(range(1, greatest(len(ws) - 6, 1))) as i, ws from d where len(ws) >= 8),
win as (select rid, i, array_to_string(ws[i:i+7], ' ') as w from pos),
rep as (select rid, i from (select rid, i, count(*) over (partition by rid, w) as c from win) where c > 1),
cov as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from rep) group by rid),
m as (
  select d.rid, doc_id, len(ws) as n_words,
    coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls,
    coalesce(cov.n, 0) as n_repeat_words,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) as n_upper, length(regexp_replace(text, '[^a-z]', '', 'g')) as n_lower,
    length(regexp_replace(text, '[^0-9]', '', 'g')) as n_digits,
    len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) as n_stutter
  from d left join cov on d.rid = cov.rid),
r as (select *, len(ls) - len(list_distinct(ls)) as n_dup_lines, len(ls) as n_lines from m),
b as (select *,
    (case when n_words < 20 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 30 * n_words then 2 else 0 end)
    + (case when word_chars < 2 * n_words then 4 else 0 end)
    + (case when word_chars > 14 * n_words then 8 else 0 end)
    + (case when 10 * n_symbols > n_words then 16 else 0 end)
    + (case when 100 * n_dup_lines > 50 * n_lines then 32 else 0 end)
    + (case when n_upper > n_lower then 64 else 0 end)
    + (case when 100 * n_digits > 50 * word_chars then 128 else 0 end)
    + (case when 100 * n_stutter > 30 * n_words then 256 else 0 end) as bits
  from r)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
  (bits & 3) <> 0 as base_failed, bits = 0 as kept, cast(bits as bigint) as failure_bits
from b""",
    "op4_chat_format": r"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|ROLE[ \]]|SYS>>))', '\1\\\2\3', 'g') as esc from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(esc) + case role when 'user' then 18 when 'assistant' then 6 when 'system' then 17 else length(role) + 16 end)::bigint as formatted_chars
from e group by conv_id""",
    "op11_lexical_search": r"""
with d as (select row_number() over () as rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
q as (select row_number() over () as qid, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as ts from benchmark),
c as (select count(*)::bigint as big_n, sum(len(ts))::bigint as big_l from d where len(ts) > 0),
p as (select rid, doc_id, n, t, count(*)::bigint as tf from (select rid, doc_id, len(ts)::bigint as n, unnest(ts) as t from d) group by all),
f as (select t, floor(1000 * ln((2 * big_n + 2) / (2 * count(*) + 1)))::bigint as w from p, c group by t, big_n),
s as (select qid, item_id, rid, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // big_l))))::bigint as score
  from (select qid, item_id, unnest(ts) as t from q) join f using (t) join p using (t), c group by all)
select item_id, (row_number() over (partition by qid order by score desc, doc_id nulls last))::integer as rank, doc_id, score from s where score > 0
qualify rank <= 10""",
    "op12_warc": r"""
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select *, octet_length(encode(h)) as b, max(page_id) over (partition by h) as top from p)
select page_id, b::bigint as payload_bytes, sha1(h) as payload_digest, case when b >= 1000 and top is not null and page_id is distinct from top then 'revisit' else 'response' end as record_type,
  case when b >= 1000 and page_id is distinct from top then top end as refers_to
from g""",
    "op13_filter_audit": r"""
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels where doc_id is not null group by doc_id),
m as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
  [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) over (partition by t), false)] as fails
  from d left join l using (doc_id)),
h as (select part, fails, count(*) as n, sum(good) as good, sum(toxic) as toxic from m group by all),
a as (select unnest(range(1, 6)) as i),
o as (select [a.i, b.i, c.i, e.i, f.i] as ord from a, a as b, a as c, a as e, a as f where len(list_distinct([a.i, b.i, c.i, e.i, f.i])) = 5),
s as (select ord, array_to_string(list_transform(ord, lambda x: substr('ABCDE', x, 1)), '') as filter_order, unnest(range(1, 6)) as step from o),
x as (select part, filter_order, step, ord[step] as filter, n, good, toxic, fails[ord[step]] as here, len(list_filter(ord[1:step - 1], lambda k: fails[k])) > 0 as gone, len(list_filter(fails, lambda k: k)) as n_fails from h, s),
r as (select part, filter_order, step::integer as step, filter, coalesce(sum(n) filter (not here and not gone), 0)::bigint as kept, coalesce(sum(n) filter (here and not gone), 0)::bigint as removed,
  coalesce(sum(n) filter (here and gone), 0)::bigint as redundant, coalesce(sum(n) filter (here and n_fails = 1), 0)::bigint as unique_fails,
  coalesce(sum(good) filter (here and not gone), 0)::bigint as good_lost, coalesce(sum(toxic) filter (here and not gone), 0)::bigint as toxic_lost
  from x group by part, filter_order, step, filter)
select * exclude (filter), (sum(removed) over (partition by part, filter))::bigint as shapley from r""",
}
