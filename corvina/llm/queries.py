"""Registered queries of this package, with the parameters of production; SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import decontamination, fill_in_middle, hard_negatives, hidden_markov, language_id, license_scan, line_dedup, quality_rules, quotation_links, sentencepiece_codec, simhash, suffix_dedup, warc
from corvina.llm.common import table


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.dedup(docs, min_docs=10, min_chars=1)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def held_out(n: int = 3, rest: int = 1) -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n == rest


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    pieces = language_id.vocabulary(model_path())
    languages, p = language_id.learn(docs.filter(~F.coalesce(held_out(), F.lit(False))), pieces)
    return language_id.identify(docs.select("doc_id", "text"), pieces, languages, p).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents")).withColumn("licenses", F.array_join("licenses", " "))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.digests(sentencepiece_codec.encode(table(spark, sf_dir, "documents"), model_path()))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"), min_bytes=0)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation_links.link(table(spark, sf_dir, "conversations"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", *quality_rules.BASE, "base_failed", "kept")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


def op12_hidden_markov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_markov.score(table(spark, sf_dir, "documents"), held_out(7, 2))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle.transform(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c, 256)
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(fill_in_middle.restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_decontamination, op2_line_dedup, op3_language_id, op4_license_scan, op5_sentencepiece,
        op6_simhash, op7_warc, op8_quotation_links, op9_quality_rules, op10_suffix_dedup,
        op11_hard_negatives, op12_hidden_markov, op13_fill_in_middle,
    )}


OP2 = r"""
with lines as (
  select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, unnest(range(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))) as i
  from documents),
keyed as (select *, trim(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as k from lines),
often as (select k from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10),
marked as (select *, k in (select k from often) as gone from keyed)
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""


OP7 = r"""
with p as (select page_id, encode(coalesce(html, '')) as body, sha1(encode(coalesce(html, ''))) as hexes from pages),
first as (select hexes, min(page_id) as least from p group by hexes)
select page_id, octet_length(body)::bigint as payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hexes, 1 + 5 * (i // 4), 5))::bigint >> (5 * (3 - i % 4))) & 31) + 1)::bigint, 1)), 'string_agg', '') as payload_digest,
  case when page_id = least then 'response' else 'revisit' end as record_type,
  case when page_id <> least then least end as refers_to
from p join first using (hexes)
"""

OP10 = r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as s from d, unnest(range(0, length(h) // 2 - 199)) as t(i)),
often as (select s from w group by s having count(*) > 1),
hit as (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from w where s in (select s from often)),
island as (select doc_id, i, sum(case when before is null or i > before + 200 then 1 else 0 end) over (partition by doc_id order by i) as k from hit),
span as (select doc_id, k, min(i) as lo, max(i) + 200 as hi from island group by doc_id, k),
gap as (select doc_id, hi as lo, lead(lo) over (partition by doc_id order by lo) as hi from span union all select doc_id, 0, min(lo) from span group by doc_id),
kept as (select g.doc_id, string_agg(substr(h, 2 * g.lo + 1, 2 * (coalesce(g.hi, length(h) // 2) - g.lo)), '' order by g.lo) as h from gap g join d on g.doc_id = d.doc_id group by g.doc_id),
cut as (select doc_id, sum(hi - lo) as n_removed, count(*) as n_spans from span group by doc_id)
select d.doc_id, (length(d.h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join cut on d.doc_id = cut.doc_id left join kept on d.doc_id = kept.doc_id
"""


OP8 = r"""
with recursive c as (select row_number() over () as rid, conv_id, turn, role, replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) as t from conversations),
raw as (select rid, unnest(string_split(t, chr(10))) as x, unnest(range(1, 2 + length(t) - length(replace(t, chr(10), '')))) as i from c),
line as (select rid, i, length(regexp_replace(regexp_extract(x, '^([ \t]*>)+'), '[^>]', '', 'g')) as level, regexp_replace(x, '^([ \t]*>)+ ?', '') as body from raw),
told as (select *, level = 0 and regexp_matches(body, '(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$') and coalesce(lead(level) over w, 0) > 0 as announces,
  case when level is distinct from lag(level) over w then 1 else 0 end as new from line window w as (partition by rid order by i)),
own as (select rid, trim(coalesce(string_agg(body, chr(10) order by i) filter (level = 0 and not announces), ''), chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') as t from told group by rid),
run as (select *, sum(new) over (partition by rid order by i) as run from told),
passage as (select rid, run, any_value(level) as level, string_agg(body, chr(10) order by i) as t from run where level > 0 group by rid, run),
many as (select rid, count(*) as n from passage group by rid),
said as (select rid, null::bigint as level, t from own union all select rid, level, t from passage),
unit as (select rid, level, 0 as kind, t from said union all select rid, level, 1, unnest(regexp_split_to_array(t, '\n[ \t]*\n')) from said union all select rid, level, 2, unnest(string_split(t, chr(10))) from said),
norm as (select c.conv_id, c.turn, level, kind, trim(regexp_replace(lower(u.t), '[\s\x0b]+', ' ', 'g')) as t from unit u join c using (rid) where c.conv_id is not null and c.turn is not null),
wrote as (select t, conv_id, min(turn) as turn from norm where level is null and t <> '' group by t, conv_id),
firsts as (select t, min((conv_id, turn)) as org from wrote group by t),
quote as (select conv_id, turn, t, min((level, kind)) as how from norm where level is not null and t <> '' group by conv_id, turn, t),
origin as (select q.conv_id, q.turn, how, coalesce(case when w.turn < q.turn then (w.conv_id, w.turn) end, case when length(q.t) >= 20 and f.org < (q.conv_id, q.turn) then f.org end) as org
  from quote q left join wrote w on w.t = q.t and w.conv_id = q.conv_id left join firsts f on f.t = q.t),
parent as (select conv_id, turn, org[1] as pc, org[2] as pt from origin where org is not null qualify row_number() over (partition by conv_id, turn order by how, org desc) = 1),
chain as (select conv_id, turn, pc, pt from parent union all select chain.conv_id, chain.turn, p.pc, p.pt from chain join parent p on p.conv_id = chain.pc and p.turn = chain.pt),
top as (select conv_id, turn, pc as top from chain where not exists (select 1 from parent p where p.conv_id = chain.pc and p.turn = chain.pt)),
start as (select conv_id, min(turn) as start from c where conv_id is not null and turn is not null group by conv_id)
select c.conv_id, c.turn, c.role, own.t as text, coalesce(many.n, 0)::bigint as n_quoted, pc as parent_conv, pt as parent_turn,
  case when c.conv_id is not null and c.turn is not null then coalesce(top, c.conv_id) end as root_conv,
  case when c.conv_id is not null and c.turn is not null then s.start end as root_turn
from c join own using (rid) left join many using (rid) left join parent p on p.conv_id = c.conv_id and p.turn = c.turn
  left join top on top.conv_id = c.conv_id and top.turn = c.turn left join start s on s.conv_id = coalesce(top, c.conv_id)
"""

COMMON = ", ".join(f"('{w}')" for w in sorted(set(quality_rules.COMMON)))
OP9 = rf"""
with d as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (select doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
gram as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from w, unnest(range(1, len(w) - 1)) as u(i)),
twice as (select doc_id, g from gram group by doc_id, g having count(*) > 1),
again as (select doc_id, count(distinct i + k) as n from gram join twice using (doc_id, g), unnest([0, 1, 2]) as u(k) group by doc_id),
line as (select doc_id, count(*) - count(distinct x) as n from (select doc_id, unnest(string_split(t, chr(10))) as x from d) where regexp_matches(x, '[^\x20\x09-\x0D]') group by doc_id),
class as (select doc_id, lang, [length(regexp_replace(t, '[^\p{{Ll}}]', '', 'g')), length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')), length(regexp_replace(t, '[^\p{{Lt}}\p{{Lm}}\p{{Lo}}]', '', 'g')),
  length(regexp_replace(t, '[^\p{{Nd}}]', '', 'g')), length(regexp_replace(t, '[^\x20\x09-\x0D]', '', 'g'))] as c, length(t) as n from d),
chars as (select doc_id, lang, unnest(c || [n - list_sum(c)])::double as c, unnest(range(0, 6)) as bin, n from class),
common(v) as (values {COMMON}),
seen as (select doc_id, v as bin, count(*) as c from (select doc_id, unnest(list_transform(w, lambda x: lower(x))) as v from w) join common using (v) group by all),
words as (select w.doc_id, lang, v as bin, coalesce(c, 0)::double as c, len(w) as n from w cross join common left join seen on seen.bin = v and seen.doc_id = w.doc_id
  union all select w.doc_id, lang, '', len(w) - coalesce((select sum(c) from seen where seen.doc_id = w.doc_id), 0), len(w) from w),
hist as (select 'c' as kind, doc_id, lang, bin::varchar as bin, c, n from chars union all select 'w', doc_id, lang, bin, c, n from words),
ref as (select kind, lang, bin, sum(c) / sum(sum(c)) over (partition by kind, lang) as q from hist where lang is not null group by kind, lang, bin),
term as (select h.kind, doc_id, r.lang, c / nullif(n, 0) as p, q from hist h join ref r on h.kind = r.kind and h.bin = r.bin),
js as (select kind, doc_id, lang, sqrt(greatest(0, sum((case when p > 0 then p * log2(p / ((p + q) / 2)) else 0 end + case when q > 0 then q * log2(q / ((p + q) / 2)) else 0 end) / 2))) as d from term where p is not null group by kind, doc_id, lang),
near as (select doc_id, min(d) filter (kind = 'c') as dc, min(d) filter (kind = 'w') as dw from js group by doc_id),
base as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  coalesce(line.n, 0)::bigint as n_dup_lines, coalesce(again.n, 0)::bigint as n_repeat_words, length(t) as size from w left join line using (doc_id) left join again using (doc_id)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and (size < 200 or coalesce(dc, 0) <= 0.24) and (n_words < 50 or coalesce(dw, 0) <= 0.4) as kept
from judged left join near using (doc_id)
"""


OP11 = """
with r as (select vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.id as a, b.id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as s from r a join r b on a.id % 50 = 0 and a.id <> b.id),
p as (select a, b, s from s where same qualify row_number() over (partition by a order by s desc, b) <= 5),
n as (select p.a, p.b as p, p.s as ps, s.b as n, s.s as ns, row_number() over (partition by p.a, p.b order by s.s desc, s.b) as k
  from p join s on s.a = p.a and not s.same and 50 * p.s <= 100 * s.s and 100 * s.s <= 95 * p.s)
select a as anchor_id, p as positive_id, k::int as rank, n as negative_id, ps as positive_score, ns as negative_score from n where k <= 3
"""

OP13 = """
with d as (select doc_id, coalesce(text, '') as t, sha256('1:' || doc_id::varchar) as h from documents),
g as (select doc_id, t, length(t) as n, ('0x' || substr(h, 1, 8))::bigint as h1, ('0x' || substr(h, 9, 8))::bigint as h2, ('0x' || substr(h, 17, 8))::bigint as h3, ('0x' || substr(h, 25, 8))::bigint as h4 from d),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as i, greatest(h1 % (n + 1), h2 % (n + 1)) as j,
  case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from g),
x as (select *, substr(t, 1, i) as p, substr(t, i + 1, j - i) as m, substr(t, j + 1) as s from c)
select doc_id, n::bigint as n, form, case when form <> 'plain' then i end as prefix_chars, case when form <> 'plain' then j - i end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256, sha256(t) as restored_sha256
from x
"""


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": OP11, "op13_fill_in_middle": OP13, "op2_line_dedup": OP2, "op7_warc": OP7, "op8_quotation_links": OP8, "op9_quality_rules": OP9, "op10_suffix_dedup": OP10}
