"""The registered queries of the engine's own operators over the driver's tables, each with its SQL where SQL can say it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina import rules, schemas
from corvina.functions import records as R
from corvina.functions import text as T
from corvina.operators import curate, export, fulltext, match, packing, search, similar, snapshots
from corvina.operators.stored import stored
from corvina.plans import adapters as A
from corvina.plans import sql as S
from corvina.sources import archives, readers, sinks
from corvina.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def works(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.project(A.raw(spark, sf_dir), A.subjects(spark))


def full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.stages(curate.codes(works(spark, sf_dir), A.filenames(spark, sf_dir), A.file_codes(spark, sf_dir)), A.groups(spark, sf_dir))


def joined(c: str | Column, sort: bool = True) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.array_join(F.array_sort(c) if sort else c, "|"), F.lit(""))


# ---- cleaning rules ------------------------------------------------------------------------------------------------


@query(f"with {S.WORKS} select id, src, type, title, edition, edition_no, year, subject, school, pdf, 'https://www.ntsec.edu.tw/science/detail.aspx?a=' || case when src = '全國' then '21' else '90' end || '&sid=' || id as url, md5(abstract) as abstract_md5 from works")
def works_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("id", "src", "type", "title", "edition", "edition_no", "year", "subject", "school", "pdf", "url", F.md5("abstract").alias("abstract_md5"))


@query(f"with {S.WORKS} select id, {S.listed('list_distinct(keywords)')} as keywords from works")
def keywords_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("id", joined("keywords").alias("keywords"))


@query(f"with {S.WORKS} select id, {S.listed('teachers', False)} as teachers from works")
def people_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("id", joined("teachers", False).alias("teachers"))


@query(f"with {S.WORKS} select id, {S.letters('title')} as letters, lower({S.letters('title')}) as key, {S.norm('title')} as norm from works")
def title_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("title")
    return works(spark, sf_dir).select("id", T.letters(t).alias("letters"), T.title_key(t).alias("key"), T.search_norm(t).alias("norm"))


@query(f"with {S.WORKS} select id, edition_no, year from works")
def year_edition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("id", "edition_no", "year")


@query(f"with {S.WORKS}, {S.parse('works', 'award_raw')} select id, rank, {S.listed('special')} as special, {S.listed('rep', False)} as rep from parsed")
def award_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("id", "rank", joined("special").alias("special"), joined("rep", False).alias("rep"))


@query(f"with {S.WORKS}, {S.parse('works', 'award_raw')} select coalesce({S.CLASS}, 'other') as award_class, count(*) as n, count(*) filter (len(special) > 0) as with_special from parsed group by 1")
def award_class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).groupBy(F.coalesce(R.award_class(F.col("rank")), F.lit("other")).alias("award_class")).agg(F.count("*").alias("n"), F.count_if(F.size("special") > 0).alias("with_special"))


@query(f"with {S.WORKS} select id, {S.city('school')} as city from works")
def city_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("id", "city")


@query(f"with {S.WORKS} select id, {S.school_stage('school')} as stage from works")
def stage_school(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("id", R.school_stage(F.col("school")).alias("stage"))


@query(f"with {S.WORKS}, {S.VOTE} select id, voted from vote")
def stage_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = works(spark, sf_dir).filter(F.col("type") == rules.WORK)
    return curate.neighbour_vote(rows, ["src", "edition"], "id", R.school_stage(F.col("school")), F.col("school").rlike(rules.AMBIGUOUS_SCHOOL)).select("id", "voted")


@query(f"with {S.WORKS}, {S.CASCADE} select id, code, stage, stage_src, stage_detail from final")
def stage_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, sf_dir).select("id", "code", "stage", "stage_src", "stage_detail")


@query(f"with {S.WORKS} select id, replace(coalesce(domain, ''), '、', '|') as domains from works")
def subject_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return works(spark, sf_dir).select("id", joined("domains", False).alias("domains"))


OFFICIAL = f"""official as (select edition_no, code, max(award) as award from (select 14 + id % 52 as edition_no, code,
    replace(replace(replace({S.pick(A.OFFICIAL, "id")}, '最佳(鄉土)教材獎', '最佳鄉土教材獎'), '(鄉土)教材獎', '最佳鄉土教材獎'), '奬', '獎') as award from codes where id % 5 = 2 and id % 2 = 0) group by 1, 2),
  target as (select edition_no, code, max(id) as id from works join codes using (id) where code is not null group by 1, 2),
  hit as (select id, award from target join official using (edition_no, code))"""


@query(f"with {S.WORKS}, {S.CODES}, {S.parse('works', 'award_raw')}, {OFFICIAL}, {S.parse('hit', 'award', 'off')} select p.id, case when award is null then p.rank when award = '未列獎項' then coalesce(p.rank, '未得獎') else coalesce(off.rank, p.rank) end as rank, {S.listed('case when award is null or award = $$未列獎項$$ then p.special else list_distinct(p.special || off.special) end')} as special, case when award is not null then '官方作品資料表' end as award_src from parsed p left join off on p.id = off.id")
def award_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = curate.codes(works(spark, sf_dir), A.filenames(spark, sf_dir), A.file_codes(spark, sf_dir))
    return curate.official_awards(coded, A.official(spark, sf_dir)).select("id", "rank", joined("special").alias("special"), "award_src")


@query(f"with {S.WORKS}, k as (select id, src, lower({S.letters('title')}) as k from works where type = '作品') select w.id, coalesce(string_agg(o.id::varchar, '|' order by o.id), '') as related from works w left join k on w.id = k.id left join k o on o.k = k.k and o.src <> k.src group by w.id")
def related_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = curate.related(works(spark, sf_dir), lambda ids: F.array_join(ids.cast("array<string>"), "|"))
    return text.select("id", F.coalesce("related", F.lit("")).alias("related"))


QC = f"""with {S.WORKS}, {S.CASCADE}, {S.parse('works', 'award_raw')}, j as (select p.*, f.stage, f.stage_src, {S.city('school')} as city from parsed p join final f using (id) where type = '作品')
select 'stage_src' as report, src, stage_src as value, count(*) as n from j group by all union all select 'stage', src, stage, count(*) from j group by all
union all select 'no_domain', '*', subject, count(*) from j where domain is null group by all union all select 'rank', '*', rank, count(*) from j group by all
union all select 'special', '*', s, count(*) from (select unnest(special) as s from j) group by all
union all select 'no_city', src, 'missing', count(*) from j where city is null and src = '全國' group by all union all select 'no_city', src, 'total', count(*) from j where src = '全國' group by all"""


@query(QC)
def qc_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.quality_report(full(spark, sf_dir))


# ---- search --------------------------------------------------------------------------------------------------------

RANKED = search.SearchRequest(q="The and")
SCOPED = search.SearchRequest(q="Solar", scope=True, sort="old", year_from=1990, src=frozenset({"0"}))
BROWSED = search.SearchRequest(city="新北市", year_from=2000, shown=60)
FACETED = search.SearchRequest(q="the", stage=frozenset({"國中", "高中職"}), domain=frozenset({"物理", "化學", "生物"}), award=frozenset({"top", "special"}), year_to=2020)
LINES = "查證關鍵字：solar cell\nthe of and\n光合作用 zzzz\n螞蟻"


@query(f"with {S.WORKS}, {S.parse('works', 'award_raw')}, {S.SERVING}, h as (select *, {S.points('the')} as a, {S.points('and')} as b from serving where type = '作品') select id, a + b + case when contains(nt, 'theand') then 4 else 0 end as score, year, (contains(nt, 'the') or contains(nk, 'the') or contains(nt, 'and') or contains(nk, 'and')) as core from h where a > 0 and b > 0 order by score desc, year desc nulls last, id desc limit 30")
def search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.serving(works(spark, sf_dir)), RANKED).select("id", "score", "year", "core")


@query(f"with {S.WORKS}, {S.parse('works', 'award_raw')}, {S.SERVING} select id, {S.points('solar', True)} as score, year from serving where type = '作品' and {S.points('solar', True)} > 0 and coalesce(year >= 1990, true) and src = '全國' order by year, id limit 30")
def search_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.serving(works(spark, sf_dir)), SCOPED).select("id", "score", "year")


@query(f"with {S.WORKS} select id, 1 as score, year from works where type = '作品' and coalesce(year >= 2000, true) and {S.city('school')} = '新北市' order by year desc nulls last, id desc limit 60")
def search_no_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(search.serving(works(spark, sf_dir)), BROWSED).select("id", "score", "year")


FACETS = f"""with {S.WORKS}, {S.parse('works', 'award_raw')}, {S.SERVING}, {S.CASCADE}, c as (
  select s.id, case when src = '全國' then '0' else '1' end as s, coalesce(f.stage, '未標示') as g, case when domain is null then []::varchar[] else string_split(domain, '、') end as d,
    list_filter([{S.CLASS}, case when len(special) > 0 then 'special' end, case when rank is null and len(special) = 0 then 'unknown' end], lambda x: x is not null) as a
  from serving s join final f using (id) where s.type = '作品' and {S.points('the')} > 0 and coalesce(year <= 2020, true)),
b as (select *, g in ('國中', '高中職') as og, list_has_any(d, ['物理', '化學', '生物']) as od, list_has_any(a, ['top', 'special']) as oa from c)
select 'src' as facet, s as value, count(*) as n from b where og and od and oa group by all union all select 'stage', g, count(*) from b where od and oa group by all
union all select 'domain', x, count(*) from (select unnest(d) as x from b where og and oa) group by all union all select 'award', x, count(*) from (select unnest(a) as x from b where og and od) group by all"""


@query(FACETS)
def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.facets(search.scored(search.serving(full(spark, sf_dir)), FACETED), FACETED)


def novelty_sql() -> str:
    parts = []
    for n, words in enumerate(search.novelty_lines(LINES)):
        p = [f"(case when contains(nt, {S.text(k)}) then 6 else 0 end + case when contains(nk, {S.text(k)}) then 4 else 0 end + case when contains(na, {S.text(k)}) then 1 else 0 end)" for k in words]
        hits = " + ".join(f"(({x}) > 0)::int" for x in p)
        parts.append(f"select {n} as line, id, year, {' + '.join(p)} as s, {hits} as h, {len(words)} as k from serving where type = '作品'")
    return f"with {S.WORKS}, {S.parse('works', 'award_raw')}, {S.SERVING}, t as ({' union all '.join(parts)}) select line, case when h = k then 'full' else 'part' end as kind, id, case when h = k then s else s + 10 * h end as score, year from t where h = k or (k > 1 and h >= ceil(k / 2))"


@query(novelty_sql())
def novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.novelty(search.serving(works(spark, sf_dir)), search.novelty_lines(LINES))


@query(f"select * exclude (r) from (select *, row_number() over (partition by line, kind order by score desc, year desc nulls last, id) as r from ({novelty_sql()})) where (kind = 'full' and r <= 6) or (kind = 'part' and r <= 4)")
def novelty_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.novelty(search.serving(works(spark, sf_dir)), search.novelty_lines(LINES), 6, 4).drop("rank")


@query(f"with {S.WORKS}, {S.parse('works', 'award_raw')}, {S.SERVING}, p as (select id, abstract, case when instr(na, 'the') - 1 > 40 then instr(na, 'the') - 31 when instr(na, 'the') > 0 then 0 when instr(na, 'and') - 1 > 40 then instr(na, 'and') - 31 else 0 end as st from serving), s as (select id, case when st > 0 then '…' || substr(abstract, st + 1) else abstract end as t from p) select id, case when length(t) > 140 then left(t, 140) || '…' else t end as snippet from s")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.serving(works(spark, sf_dir)).select("id", search.snippet(RANKED).alias("snippet"))


@query(f"with {S.WORKS}, x as (select 'year' as kind, year::varchar as value from works union all select 'city', {S.city('school')} from works) select kind, value, count(*) as n from x where value is not null group by all")
def pickers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.pickers(works(spark, sf_dir))


# ---- similarity ----------------------------------------------------------------------------------------------------


def text_of(df: DataFrame) -> Column:
    return similar.weighted_text(F.col("title"), F.col("keywords"), F.col("abstract"))


@query(f"with {S.WORKS}, {S.TOKENS} select id, token, round(x, 8) as x, rank from vec")
def tfidf_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = works(spark, sf_dir).filter(F.col("type") == rules.WORK)
    return similar.vectors(docs, "id", text_of(docs)).select("id", "token", F.round("x", 8).alias("x"), F.col("rank").cast("long").alias("rank"))


@query(f"with {S.WORKS}, {S.TOKENS}, keys as (select id, lower({S.letters('title')}) as k from works), dots as (select a.id, b.id as other, round(sum(a.x * b.x), 10) as score, min(a.rank) as first from vec a join vec b on a.token = b.token and a.id <> b.id group by 1, 2 having round(sum(a.x * b.x), 10) > 0.08), r as (select d.*, row_number() over (partition by d.id order by score desc, first, other) as rank from dots d join keys x on d.id = x.id join keys y on d.other = y.id where x.k <> y.k) select id, rank, other, round(score, 7) as score from r where rank <= 8")
def similar_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar.similar(works(spark, sf_dir)).select("id", F.col("rank").cast("long").alias("rank"), "other", F.round("score", 7).alias("score"))


# ---- packing and exports -------------------------------------------------------------------------------------------


@query(f"with {S.WORKS}, {S.CASCADE} select src, edition, count(*) filter (w.type = '作品') as works, count(*) filter (w.type = '作品' and pdf is not null) as with_file, count(*) filter (w.type = '作品' and length(abstract) > 1000) as with_text, count(*) filter (w.type <> '作品') as reviews from works w group by grouping sets ((src, edition), ())")
def stats_pivot_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.statistics(works(spark, sf_dir), F.col("pdf").isNotNull(), F.length("abstract") > 1000)


PACK = 12


@query(f"""with recursive {S.WORKS}, c as (select coalesce(domain, '其他') as base, year, count(*) as n, row_number() over (partition by coalesce(domain, '其他') order by year) as k from works where src = '國際' group by 1, 2),
p as (select base, year, n, k, 0 as bin, n as fill from c where k = 1 union all select c.base, c.year, c.n, c.k, case when p.fill + c.n > {PACK} then p.bin + 1 else p.bin end, case when p.fill + c.n > {PACK} then c.n else p.fill + c.n end from p join c on c.base = p.base and c.k = p.k + 1)
select base, year, n, bin from p""")
def greedy_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = works(spark, sf_dir).filter(F.col("src") == rules.INTERNATIONAL).withColumn("base", R.folder_base(F.col("domains")))
    return packing.greedy(rows, "base", "year", PACK)


@query(f"""with {S.WORKS}, g as (select coalesce(domain, '未分類') as base, edition_no, count(*) as n from works where src = '全國' group by 1, 2),
t as (select base, sum(n) as total, list_sort(list(edition_no)) as eds from g group by base), u as (select *, eds[len(eds) // 2 + 1] as mid from t),
v as (select g.*, total, mid, list_filter(eds, lambda x: x < mid) as lo, list_filter(eds, lambda x: x >= mid) as hi from g join u using (base)),
f as (select *, case when edition_no < mid then lo else hi end as part from v)
select base, edition_no, n, case when total <= 100 then base else base || '_第' || list_min(part) || case when list_min(part) <> list_max(part) then '-' || list_max(part) else '' end || '屆' end as folder from f""")
def folder_half_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = works(spark, sf_dir).filter(F.col("src") == rules.NATIONAL).withColumn("base", R.folder_base(F.col("domains"), "未分類"))
    return packing.half_split(rows, "base", "edition_no", 100)


CHUNK = 60_000


@query(f"""with recursive {S.WORKS}, s as (select id, strlen(abstract) + 12 as size, row_number() over (order by id) as k from works where abstract <> ''),
p as (select id, k, 0 as chunk, size as fill from s where k = 1 union all select s.id, s.k, case when p.fill > {CHUNK} then p.chunk + 1 else p.chunk end, case when p.fill > {CHUNK} then s.size else p.fill + s.size end from p join s on s.k = p.k + 1)
select id, chunk from p""")
def abstract_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.byte_chunks(works(spark, sf_dir), "id", "abstract", CHUNK)


@query(f"with {S.WORKS}, {S.CASCADE}, {S.parse('works', 'award_raw')} select id as i, case when src = '全國' then 0 else 1 end as s, nullif(title, '') as t, year as y, nullif(edition, '') as e, stage as g, stage_src as gs, stage_detail as gd, nullif(replace(coalesce(domain, ''), '、', '|'), '') as d, nullif(subject, '') as sj, rank as r, nullif({S.listed('special')}, '') as sp, nullif({S.listed('rep', False)}, '') as rp, nullif(school, '') as sc, {S.city('school')} as c, nullif({S.listed('teachers', False)}, '') as tc, nullif({S.listed('list_distinct(keywords)')}, '') as k, code as cd, pdf as p, case when type = '評語' then 1 end as v, case when id % 2 = 0 then 1 end as f from parsed join final using (id)")
def meta_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full(spark, sf_dir).withColumn("related", F.lit(None).cast("array<long>"))
    out = export.short_records(rows, rows.filter("id % 2 = 0").select("id")).drop("rl")
    line = lambda c, sort: F.when(F.col(c).isNotNull(), joined(c, sort)).alias(c)
    return out.select(*(line(c, c in ("sp", "k")) if c in ("d", "sp", "rp", "tc", "k") else c for c in out.columns))


REPORT = f"""with {S.WORKS}, {S.CASCADE}, {S.parse('works', 'award_raw')} select id as sid, title as "作品名稱", case when src = '全國' then '全國中小學科展' else '臺灣國際科展' end as "科展類別", edition as "屆次", year as "年份",
coalesce(stage_detail, stage, '') as "學習階段", coalesce({S.case('stage_src', rules.STAGE_SOURCES)}, '') as "學習階段來源", subject as "科別", coalesce(domain, '') as "標準領域", award_raw as "得獎情形", coalesce(rank, '') as "名次",
'科教館網站' as "得獎資料來源", school as "學校名稱", coalesce({S.city('school')}, '') as "縣市", array_to_string(teachers, '、') as "指導老師",
array_to_string(list_filter(list_transform(string_split(replace(authors, '；', ';'), ';'), lambda x: trim(x)), lambda x: x <> ''), '、') as "作者", coalesce(code, '') as "作品編號", type as "類型",
case when id % 2 = 0 then '有' else '' end as "研究內容節錄", case when id % 5 = 3 then '有' else '' end as "本機PDF", case when id % 10 = 3 then 'folder' else '' end as "分科資料夾", '2026-01-01' as "官網核對日期", md5(abstract) as "摘要或動機", coalesce(pdf, '') as "檔案連結" from parsed join final using (id)"""


@query(REPORT)
def report_28(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full(spark, sf_dir).withColumns({"award_src": F.lit(None).cast("string"), "related": F.lit(None).cast("array<long>")})
    authors = A.raw(spark, sf_dir).select(F.col("sid").alias("id"), F.col("作者").alias("authors"))
    files = A.file_codes(spark, sf_dir).select(F.col("sid").alias("id"), "file")
    folders = files.filter("id % 2 = 1").select("file", F.lit("folder").alias("folder"))
    out = export.report(rows, authors, rows.filter("id % 2 = 0").select("id"), files, folders, "2026-01-01")
    # columns that other queries compare: 特別獎, 關鍵字, 同作品另一科展 sid, 科教館頁面
    return out.drop("特別獎", "關鍵字", "同作品另一科展 sid", "科教館頁面").withColumn("摘要或動機", F.md5("摘要或動機"))


IDS = [7, 3, 12, 40, 5, 999_999_999]


@query(f"with {S.WORKS}, {S.CASCADE}, {S.parse('works', 'award_raw')}, b as (select unnest({IDS}) as id, generate_subscripts({IDS}, 1) - 1 as pos) select pos as \"at\", id, md5(concat_ws(chr(10), chr(10) || '### W' || (pos + 1) || '｜' || title, '- 來源：' || case when src = '全國' then '全國中小學科展　' || edition else '臺灣國際科展　' || year || ' 年' end, '- 學習階段／科別：' || coalesce(stage_detail, stage, '未標示') || '／' || subject, '- 得獎：' || nullif(array_to_string([rank] || special, '・'), ''), '- 學校：' || coalesce(nullif(school, ''), '未填'), '- 關鍵字：' || nullif(array_to_string(keywords, '、'), ''), '- 科教館頁面：https://www.ntsec.edu.tw/science/detail.aspx?a=' || case when src = '全國' then '21' else '90' end || '&sid=' || id, '- PDF 全文：' || pdf, chr(10) || '摘要：' || coalesce(nullif(abstract, ''), '（無摘要）'))) as text from b join parsed using (id) join final using (id)")
def pack_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.pack(full(spark, sf_dir), IDS).withColumn("text", F.md5("text"))


# ---- snapshots -----------------------------------------------------------------------------------------------------


def changed(old: DataFrame) -> DataFrame:
    """A later snapshot: some titles and schools differ, some rows are gone, errors or new."""
    i = F.col("sid")
    new = old.filter(i % 17 != 5).withColumns({"作品名稱": F.when(i % 11 == 3, F.concat(F.lit("x"), "作品名稱")).when(i % 23 == 2, "").otherwise(F.col("作品名稱")), "學校名稱": F.when(i % 13 == 4, "").otherwise(F.col("學校名稱")), "error": F.when(i % 19 == 6, "timeout")})
    more = old.filter(i % 50 == 1).withColumn("sid", i + 10_000_000)
    return new.unionByName(more)


NEW = f"{S.RAW}, old as (select sid, t, sch from raw where t <> ''), new as (select sid, case when sid % 11 = 3 then 'x' || t when sid % 23 = 2 then '' else t end as t, case when sid % 13 = 4 then '' else sch end as sch, case when sid % 19 = 6 then 'timeout' end as error from old where sid % 17 <> 5 union all select sid + 10000000, t, sch, null from old where sid % 50 = 1)"


@query(rf"with {NEW}, j as (select o.sid, trim(o.t, chr(10) || chr(13) || chr(9) || ' ') as ot, trim(n.t, chr(10) || chr(13) || chr(9) || ' ') as nt, o.sch as os, n.sch as ns from old o join new n using (sid) where n.error is null and n.t <> '') select sid, '作品名稱' as field, left(ot, 200) as old, left(nt, 200) as new from j where ot <> nt union all select sid, '學校名稱', os, ns from j where os <> ns")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = A.raw(spark, sf_dir).filter("`作品名稱` <> ''")
    return snapshots.differences(old, changed(old))


@query(f"with {NEW} select o.sid, case when n.error is not null then 'failed' when coalesce(n.t, '') = '' then 'gone' else 'there' end as state from old o left join new n using (sid)")
def snapshot_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = A.raw(spark, sf_dir).filter("`作品名稱` <> ''")
    return snapshots.states(old, changed(old)).select("sid", "state")


@query(f"with {NEW} select sid from new where t <> '' and sid > (select max(sid) from old)")
def new_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = A.raw(spark, sf_dir).filter("`作品名稱` <> ''")
    return snapshots.additions(old, changed(old)).select("sid")


@query("select o_orderkey as sid from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sid"))
    return snapshots.remaining(orders, A.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("sid")))


# ---- pages ---------------------------------------------------------------------------------------------------------


QUOTE = '"'


def clean_sql(x: str) -> str:
    e = rf"regexp_replace(regexp_replace({x}, '<br\s*/?>', chr(10), 'g'), '<[^>]+>', '', 'g')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        e = f"replace({e}, '{a}', '{b}')"
    return rf"regexp_replace(replace({e}, '　', ' '), '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')"


@query(rf"select page_id, {clean_sql('''regexp_extract(html, '(?s)<title[^>]*>(.*?)</title>', 1)''')} as title, {clean_sql('''regexp_extract(html, '(?s)<h1[^>]*>(.*?)</h1>', 1)''')} as heading, md5(array_to_string(list_transform(regexp_extract_all(html, '(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: {clean_sql('x')}), '|')) as paragraphs, array_to_string(regexp_extract_all(html, '<a\s[^>]*href={QUOTE}([^{QUOTE}]*){QUOTE}', 1), '|') as links from pages")
def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.html_fields(A.table(spark, sf_dir, "pages"))
    return out.select("page_id", "title", "heading", F.md5(F.array_join("paragraphs", "|")).alias("paragraphs"), joined("links", False).alias("links"))


@query(f"select page_id, md5({clean_sql('html')}) as text from pages")
def html_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "pages").select("page_id", F.md5(T.html_text(F.col("html"))).alias("text"))


# ---- files ---------------------------------------------------------------------------------------------------------


def file_names(w: DataFrame) -> DataFrame:
    """Names of files as they come: by code, by title, with two-part codes and groups behind the title."""
    i = F.col("id")
    code = F.when(i % 3 == 0, F.lpad((80000 + i % 10000).cast("string"), 6, "0")).otherwise(F.lpad((i % 90 + 10).cast("string"), 2, "0"))
    title = F.regexp_replace(F.when(i % 7 == 1, F.concat(F.lit("123_"), "title", F.lit("（國小教師組）"))).otherwise(F.col("title")), "[\n\r/]", "")
    return w.filter(F.col("src") == rules.NATIONAL).select(i.alias("want"), F.concat(F.lit("第"), F.col("edition_no").cast("string"), F.lit("屆_國小組_物理_佳作_"), code, F.lit("_"), title, F.lit(".pdf")).alias("name"))


FILES = f"""{S.WORKS}, {S.CODES}, files as (select id as want, '第' || edition_no || '屆_國小組_物理_佳作_' || case when id % 3 = 0 then lpad((80000 + id % 10000)::varchar, 6, '0') else lpad((id % 90 + 10)::varchar, 2, '0') end || '_' ||
  regexp_replace(case when id % 7 = 1 then '123_' || title || '（國小教師組）' else title end, '[\n\r/]', '', 'g') || '.pdf' as name from works where src = '全國'),
p as (select *, regexp_extract(name, '^第(\\d+)屆_([^_]+)_.*?_(\\d{{2,6}})_(.+)\\.pdf$', ['ed', 'grp', 'code', 'title']) as m from files),
q as (select *, regexp_extract(m.title, '^((?:\\d{{2,4}}_)*)', 1) as front from p),
parsed_files as (select want, name, try_cast(nullif(m.ed, '') as int) as edition, nullif(m.grp, '') as grp, coalesce(nullif(regexp_extract(front, '(\\d{{2,4}})_$', 1), ''), nullif(m.code, '')) as code, regexp_replace(substr(m.title, length(front) + 1), '[（(][^）)]*組[）)]$', '') as title from q)"""


@query(f"with {FILES} select want, edition, grp, code, title from parsed_files where edition is not null")
def filename_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.parsed(file_names(works(spark, sf_dir))).filter("edition is not null").select("want", "edition", "grp", "code", "title")


@query(f"with {FILES}, bc as (select edition_no as edition, code, max(id) as a from works join codes using (id) where code is not null group by 1, 2), bt as (select edition_no as edition, {S.letters('title')} as key, max(id) as b from works where src = '全國' and type = '作品' group by 1, 2) select want, coalesce(a, b) as work, case when a is not null then 'code' when b is not null then 'title' end as how from parsed_files f left join bc on f.edition = bc.edition and f.code = bc.code left join bt on f.edition = bt.edition and {S.letters('f.title')} = bt.key where f.edition is not null")
def file_match_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = curate.codes(works(spark, sf_dir), A.filenames(spark, sf_dir), A.file_codes(spark, sf_dir))
    return match.matched(file_names(coded), coded, fuzzy=False).filter("edition is not null").select("want", "work", "how")


def misspelt(w: DataFrame) -> DataFrame:
    """A file for each national work, whose title has lost every ninth character."""
    short = F.array_join(F.filter(F.split(F.regexp_replace("title", "[\n\r/]", ""), ""), lambda c, i: i % 9 != 8), "")
    return w.filter((F.col("src") == rules.NATIONAL) & (F.col("type") == rules.WORK)).select(F.col("id").alias("position"), F.concat(F.lit("第"), F.col("edition_no").cast("string"), F.lit("屆_國小組_物理_佳作_9999_"), short, F.lit(".pdf")).alias("name"))


@query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The works' few fields are stored, as each way to match reads them and their titles come from whole texts."""
    w = stored(works(spark, sf_dir).select("id", "src", "type", "title", "edition_no"))
    return match.matched(misspelt(w), w.withColumn("code", F.lit(None).cast("string"))).select("position", "name", "edition", "work", "how")


@query()
def greedy_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = works(spark, sf_dir)
    return match.assigned(misspelt(w), w)


# ---- full text -----------------------------------------------------------------------------------------------------


def sections(w: DataFrame) -> DataFrame:
    cut = F.floor(F.length("abstract") / 3).cast("int")
    section = lambda h, t: F.struct(F.lit(h).alias("h"), F.lit("討論").alias("k"), t.alias("text"))
    return w.select(F.col("id").alias("sid"), F.array(section("一!", F.left("abstract", cut)), section("二", F.substring("abstract", cut + 1, F.length("abstract")))).alias("secs"))


@query(f"with {S.WORKS}, s as (select id as sid, length(abstract) as total, unnest([1, 2]) as k, unnest([left(abstract, length(abstract) // 3), substr(abstract, length(abstract) // 3 + 1)]) as t from works), c as (select *, greatest(300, floor(length(t) * 1000.0 / greatest(total, 1)))::int as n from s) select sid, k, md5(case when total > 1000 and length(t) > n then left(t, n) || '…（節錄）' else t end) as text from c")
def section_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections(works(spark, sf_dir)).select("sid", F.posexplode(fulltext.trimmed(F.col("secs"), 1000)).alias("k", "s")).select("sid", (F.col("k") + 1).alias("k"), F.md5("s.text").alias("text"))


@query(f"with {S.WORKS} select id, len(regexp_extract_all(abstract || repeat('烉', (id % 8)::int) || repeat('ж', (id % 50)::int), {S.text(rules.GARBLED)})) >= 5 or len(regexp_extract_all(abstract || repeat('烉', (id % 8)::int) || repeat('ж', (id % 50)::int), {S.text(rules.ODD_SCRIPT)})) >= 30 as garbled from works")
def garbled_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("abstract", F.expr("repeat('烉', cast(id % 8 as int))"), F.expr("repeat('ж', cast(id % 50 as int))"))
    return works(spark, sf_dir).select("id", T.garbled(t, rules.GARBLED, rules.ODD_SCRIPT).alias("garbled"))


REPAIRS = {"烉": "：", "炻": "，", "ˤ": "）", "愞": "溶"}


@query(f"with {S.WORKS} select id, translate(title || '愞解烉' || id || '炻x', '烉炻ˤ愞', '：，）溶') as text from works")
def char_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = "".join(REPAIRS)
    return works(spark, sf_dir).select("id", F.translate(F.concat("title", F.lit("愞解烉"), F.col("id").cast("string"), F.lit("炻x")), keys, "".join(REPAIRS.values())).alias("text"))


@query(f"with {S.WORKS}, n as (select id, title || ' 王大明、李小華 林x 張三陳一' as t, list_filter(list_transform(regexp_split_to_array(authors, '[;；、,，]'), lambda x: trim(x)), lambda x: length(x) >= 2) as names from works) select id, case when list_contains(names, '王大明') then replace(case when list_contains(names, '李小華') then replace(t, '李小華', '〔作者〕') else t end, '王大明', '〔作者〕') else replace(replace(replace(t, case when list_contains(names, '陳一') then '陳一' else chr(1) end, '〔作者〕'), case when list_contains(names, '張三') then '張三' else chr(1) end, '〔作者〕'), case when list_contains(names, '李四') then '李四' else chr(1) end, '〔作者〕') end as text from (select id, names, t from n where not list_has_any(names, ['en', 'fr', 'de', 'es']) union all select id, names, replace(t, list_filter(names, lambda x: x in ('en', 'fr', 'de', 'es'))[1], '〔作者〕') from n where list_has_any(names, ['en', 'fr', 'de', 'es']))")
def redact_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = A.raw(spark, sf_dir).select(F.col("sid").alias("id"), F.col("作者").alias("authors"))
    rows = works(spark, sf_dir).join(authors, "id")
    return rows.select("id", fulltext.without_names(F.concat("title", F.lit(" 王大明、李小華 林x 張三陳一")), fulltext.author_names(F.col("authors"))).alias("text"))


@query(rf"with {S.WORKS} select id, md5(regexp_replace(abstract || ' key sk-abcdefghij0123456789' || id || ' AIza_-' || repeat('a', (id % 30)::int), '(?:sk-|AIza|ghp_|gho_|xox[abp]-)[A-Za-z0-9_\-]{{16,}}', '〔已移除疑似金鑰〕', 'g')) as text from works")
def redact_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat("abstract", F.lit(" key sk-abcdefghij0123456789"), F.col("id").cast("string"), F.lit(" AIza_-"), F.expr("repeat('a', cast(id % 30 as int))"))
    return works(spark, sf_dir).select("id", F.md5(fulltext.without_secrets(t)).alias("text"))


def papers(w: DataFrame) -> DataFrame:
    """Whole texts under headings, as documents have them, in six parts of equal length (the last takes the rest)."""
    cut = F.floor(F.length("abstract") / 6).cast("int")
    part = lambda n: F.substring("abstract", n * cut + 1, cut if n < 5 else F.length("abstract"))
    body = F.concat(F.lit("目錄\n一、研究動機...1\n二、研究目的...2\n\n壹、研究動機\n"), part(0), F.lit("\n貳、研究目的\n"), part(1), F.lit("\n參、研究設備及器材\n"), part(2), F.lit("\n肆、研究方法\n- 3 -\n"), part(3), F.lit("\n伍、研究結果與討論\n"), part(4), F.lit("\n陸、結論\n"), part(5), F.expr("repeat('中文字', 120)"))
    return w.select(F.col("id").alias("sid"), F.when(F.col("id") % 9 == 4, F.col("abstract")).otherwise(body).alias("text"))


@query()
def section_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fulltext.extracted(papers(works(spark, sf_dir)))
    return out.select("sid", "status", F.coalesce(F.array_join(F.transform("secs", lambda s: F.concat(s["h"], F.lit("/"), s["k"], F.lit("/"), F.length(s["text"]).cast("string"))), "|"), F.lit("")).alias("sections"))


@query()
def section_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.statistics(fulltext.extracted(papers(works(spark, sf_dir))))


@query()
def redacted_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    authors = A.raw(spark, sf_dir).select("sid", F.col("作者").alias("authors"))
    out = fulltext.redacted(fulltext.extracted(papers(works(spark, sf_dir))), authors)
    return out.select("sid", F.md5(F.to_json("secs")).alias("secs"), "named", "secrets")


FREQUENCIES = {"的": 900, "，": 800, "。": 500, "是": 300, "在": 250, "與": 200, "中": 180, "實": 150, "驗": 150, "水": 120, "研": 100, "究": 100}


GLYPH_PAGE = "的，是在的水中實驗。與研究的，的水是在。" * 3


@query(f"""with p as (select doc_id, coalesce(text, '') || chr(10) || '炻烉炻烉炻烉' as own from documents),
b as (select *, len(regexp_extract_all(own, {S.text(rules.GARBLED)})) >= 5 or len(regexp_extract_all(own, {S.text(rules.ODD_SCRIPT)})) >= 30 as bad from p)
select doc_id as sid, case when doc_id % 2 = 0 then '{GLYPH_PAGE}' || chr(10) else '' end || case when bad then translate(own, '烉炻ˤ愞', '：，）溶') else own end as text from b""")
def glyph_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as a page; by id, next to a page of Chinese written as glyph numbers shifted by 436, whose SQL is the page itself."""
    glyphs = fulltext.Glyphs(FREQUENCIES)
    number = {chr(x): i + glyphs.first for i, x in reversed(list(enumerate(glyphs.numbers.tolist()))) if x}
    text = "".join(chr(number[c] + 436) for c in GLYPH_PAGE)
    own, marks = F.coalesce("text", F.lit("")), F.lit("炻烉炻烉炻烉")
    pages = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("sid"), F.when(F.col("doc_id") % 2 == 0, F.array(F.lit(text), own, marks)).otherwise(F.array(own, marks)).alias("pages"))
    return fulltext.repaired(pages, FREQUENCIES, REPAIRS)


@query()
def learn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which one letter is written wrongly throughout, next to their clean abstracts."""
    w = works(spark, sf_dir)
    bad = F.concat(F.lit("封面" * 30), F.translate("abstract", "eo", "烉炻"))
    return fulltext.learned(w.select(F.col("id").alias("sid"), bad.alias("text")), w)


# ---- generic forms on the star schema ------------------------------------------------------------------------------


@query("select o_orderpriority, year(o_orderdate) as y, count(*) as n, count(*) filter (o_orderstatus = 'F') as closed from orders group by grouping sets ((o_orderpriority, year(o_orderdate)), ())")
def orders_pivot_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "orders").select("o_orderpriority", F.year("o_orderdate").cast("long").alias("y"), (F.col("o_orderstatus") == "F").alias("f"))
    each = rows.groupBy("o_orderpriority", "y").agg(F.count("*").alias("n"), F.count_if("f").alias("closed"))
    total = each.agg(F.sum("n").alias("n"), F.sum("closed").alias("closed"))
    return each.unionByName(total.select(F.lit(None).cast("string").alias("o_orderpriority"), F.lit(None).cast("long").alias("y"), "n", "closed"))


@query("with b as (select event_id, user_id, event_type, row_number() over (partition by user_id order by event_id) as n from events), v as (select b.event_id, o.event_type, count(*) as c, min(o.n) as f from b join b o on b.user_id = o.user_id and abs(b.n - o.n) <= 4 and o.event_type <> 'click' where b.event_type = 'click' group by 1, 2) select event_id, case when event_type <> 'click' then event_type else coalesce((select arg_max(v.event_type, (c, -f)) from v where v.event_id = b.event_id), event_type) end as voted from b")
def events_neighbour_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.table(spark, sf_dir, "events")
    return curate.neighbour_vote(e, ["user_id"], "event_id", F.col("event_type"), F.col("event_type") == "click").select("event_id", "voted")


@query("select conv_id, count(*) as n, string_agg(role, '|' order by turn) as roles from conversations group by conv_id")
def conversation_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("r"))
    return rows.select("conv_id", "n", F.array_join(F.transform("r", lambda x: x["role"]), "|").alias("roles"))


@query("select count(*) as documents, count(*) filter (quality = 1) as good, count(*) filter (quality is null) as unlabelled from documents left join labels using (doc_id)")
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "documents").select("doc_id").join(A.table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count("*").alias("documents"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality").isNull()).alias("unlabelled"))




# ---- display, names, plans -----------------------------------------------------------------------------------------


@query(f"with {S.WORKS}, {S.CASCADE}, {S.parse('works', 'award_raw')} select id, concat_ws(' · ', src, year::varchar, case when src = '全國' then nullif(split_part(edition, '--', 1), '') end, stage || case when stage_src = '推測' then '?' else '' end, nullif(subject, ''), case when rank is distinct from '未得獎' then nullif(concat_ws('・', rank, case when len(special) > 0 then array_to_string(special, '・') end), '') end, nullif(school, '')) as meta from parsed join final using (id)")
def display_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, sf_dir).select("id", search.meta_line().alias("meta"))


NAME = f"'第' || coalesce(edition_no::varchar, 'None') || '屆_' || coalesce({S.case('coalesce(stage_detail, stage)', rules.STAGE_GROUPS)}, '組別未知') || '_' || subject || '_' || coalesce(rank, '未列獎項') || '_' || coalesce(code, '000000') || '_' || title"


@query(f"with {S.WORKS}, {S.CASCADE}, {S.parse('works', 'award_raw')} select id, left(trim(regexp_replace({NAME}, " + r"""'[\\/:*?"<>|\n\r\t]+', '_', 'g')), 80) || '.pdf' as name from parsed join final using (id)""")
def download_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return full(spark, sf_dir).select("id", match.download_name().alias("name"))


@query(f"with {S.WORKS}, {S.CODES}, listed as (select 14 + id % 52 as edition, code from codes where id % 5 = 2 and id % 2 = 0), disk as (select edition_no as edition, code, 'f' || id as path from works join codes using (id) where id % 3 = 0 and code is not null) select 'listed' as kind, l.edition, l.code, path from listed l left join disk d on l.edition = d.edition and l.code = d.code union all select 'extra', edition, code, path from disk d where not exists (select 1 from listed l where l.edition = d.edition and l.code = d.code)")
def official_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = curate.codes(works(spark, sf_dir), A.filenames(spark, sf_dir), A.file_codes(spark, sf_dir))
    disk = coded.filter("id % 3 = 0 and code is not null").select(F.col("edition_no").alias("edition"), "code", F.concat(F.lit("f"), F.col("id").cast("string")).alias("path"))
    plan, extra = match.listed_plan(A.official(spark, sf_dir), disk)
    return plan.select(F.lit("listed").alias("kind"), "edition", "code", "path").unionByName(extra.select(F.lit("extra").alias("kind"), "edition", "code", "path"))


@query(f"with {S.WORKS} select id from works where pdf is not null and id % 5 <> 3")
def unfetched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.unfetched(works(spark, sf_dir), A.file_codes(spark, sf_dir)).select("id")


@query("""select doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;')) as escaped from documents""")
def html_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", F.md5(T.html_escape(F.col("text"))).alias("escaped"))


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by user_id")
def last_row_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return readers.last_wins(rows, ["user_id"], "event_id")


@query("select event_type, count(*) as n, count(*) filter (json_valid(props)) as valid, sum((props->>'$.k')::bigint)::bigint as total from events group by event_type")
def json_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = F.from_json("props", "k long", {"mode": "PERMISSIVE"})
    rows = A.table(spark, sf_dir, "events").select("event_type", parsed.alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p").alias("valid"), F.sum("p.k").alias("total"))


@query("select sid, ceil(n / 10)::int as pages from (select l_suppkey as sid, count(*) as n from lineitem group by 1)")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("sid")).agg(F.count("*").alias("n"))
    return rows.select("sid", F.size(readers.list_pages(F.col("n"))).alias("pages"))


@query("with r as (select o_custkey, o_orderkey, row_number() over w as k, o_totalprice - lead(o_totalprice) over w as m from orders window w as (partition by o_custkey order by o_totalprice desc, o_orderkey)) select o_custkey, o_orderkey, k as rank, round(case when k = 1 then m end, 4) as margin from r where k <= 2")
def best_and_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return match.top_two(rows, "o_custkey", "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"), F.round("margin", 4).alias("margin"))


@query()
def section_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.average_chars(fulltext.report(fulltext.extracted(papers(works(spark, sf_dir)))))


@query(f"""with {S.WORKS}, e as (select id, replace(replace(replace(replace(replace(abstract, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') as t from works)
select id, md5(regexp_replace(t, '(the|and)', '<mark>\\1</mark>', 'gi')) as marked from e""")
def highlighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.serving(works(spark, sf_dir)).select("id", F.md5(search.marked(RANKED, F.col("abstract"), None)).alias("marked"))


DETAIL = 0


@query(f"""with {S.WORKS}, links as (select 'similar' as kind, rank::int as "at", other as o from ({SQL['similar_top8']}) where id = {DETAIL} union all
select 'related', (generate_subscripts(a, 1) - 1)::int, unnest(a) from (select string_split(related, '|')::bigint[] as a from ({SQL['related_links']}) where id = {DETAIL} and related <> ''))
select kind, "at", w.id, title, src, year from links join works w on w.id = o""")
def detail_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a work that has neighbours and works of the same title in the other contest."""
    w = works(spark, sf_dir)
    return search.detail(curate.related(w), DETAIL, similar.similar_to(w, DETAIL), w)[1]


@query(f"""with {S.WORKS}, {S.CASCADE}, {S.parse('works', 'award_raw')}, w as (select p.* exclude (id), p.id, f.code, f.stage, f.stage_src, f.stage_detail, {S.city('school')} as city from parsed p join final f on p.id = f.id),
d as (select id, unnest([
 {{'at': 0, 'label': '編號', 'value': case when code <> '' then '作品編號 ' || code else 'SID ' || id end}}, {{'at': 1, 'label': '作品', 'value': title}},
 {{'at': 2, 'label': '來源', 'value': src || coalesce('・' || case when src = '全國' then nullif(edition, '') else year || ' 年' end, '')}},
 {{'at': 3, 'label': '學習階段', 'value': coalesce(coalesce(stage_detail, stage) || case stage_src when '作品編號' then '（取自官方作品編號）' when '官網組別' then '（取自官網組別）' when '官網科別' then '（取自官網科別）' when '推測' then '（本站依學校名稱推測）' else '' end, '未標示')}},
 {{'at': 4, 'label': '科別', 'value': case when coalesce(subject, '') = '' then '（未填）' else subject end || coalesce('（領域：' || domain || '）', '')}},
 {{'at': 5, 'label': '得獎', 'value': coalesce(nullif(concat_ws('・', rank, nullif(array_to_string(special, '・'), '')), ''), '未標示')}}, {{'at': 6, 'label': '出國代表', 'value': array_to_string(rep, '；')}},
 {{'at': 7, 'label': '學校', 'value': concat_ws(' ', nullif(school, ''), city)}}, {{'at': 8, 'label': '指導老師', 'value': array_to_string(teachers, '、')}}, {{'at': 9, 'label': '關鍵字', 'value': array_to_string(keywords, '、')}},
 {{'at': 10, 'label': '摘要或動機', 'value': coalesce(nullif(abstract, ''), '這件作品沒有摘要。')}}, {{'at': 11, 'label': '下載', 'value': pdf}},
 {{'at': 12, 'label': '原始頁面', 'value': 'https://www.ntsec.edu.tw/science/detail.aspx?a=' || case when src = '全國' then '21' else '90' end || '&sid=' || id}}], recursive := true) from w)
select id, "at", label, md5(value) as value_md5 from d where coalesce(value, '') <> ''""")
def detail_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.detail_fields(full(spark, sf_dir)).select("id", "at", "label", F.md5("value").alias("value_md5"))


@query(f"""with {S.WORKS}, k as (select id, src, lower({S.letters('title')}) as k from works where type = '作品'), c as (select k, min(id) as class_id, count(*) filter (src = '全國') as n_national, count(*) filter (src <> '全國') as n_international from k group by k)
select id, src, class_id, n_national, n_international from k join c using (k) where n_national > 0 and n_international > 0""")
def related_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.title_classes(works(spark, sf_dir))

# ---- files that are written and read back --------------------------------------------------------------------------


def folder(spark: SparkSession) -> str:
    """A new place in the folder that driver and executors share; a temporary one only where they are one process."""
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not shared and not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
        raise ValueError("a cluster needs spark.checkpoint.dir, a folder that driver and executors share")
    return f"{shared or tempfile.mkdtemp(prefix='corvina-')}/{uuid.uuid4().hex}"


@query(f"with {S.RAW}, u as (select sid, case when t <> '' then t else 'old ' end as title, text, pdf from raw where t <> '' or sid % 4 = 1) select sid, title, md5(text) as text_md5, case when pdf is null then 0 else 1 end as files from u")
def crawl_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log in which a quarter of the records has an earlier line: the last titled line of a sid counts."""
    rows, path = A.raw(spark, sf_dir), folder(spark)
    early = rows.filter("sid % 4 = 1").withColumn("作品名稱", F.concat(F.lit("old "), "作品名稱"))
    sinks.json_lines(early, f"{path}/1")
    sinks.json_lines(rows, f"{path}/2")
    return readers.raw_records(spark, f"{path}/*").select("sid", F.col("作品名稱").alias("title"), F.md5("摘要或動機").alias("text_md5"), F.size("檔案連結").alias("files"))


@query(f"with {S.RAW}, u as (select sid, case when t <> '' then t else 'old ' end as title, text, pdf from raw where t <> '' or sid % 4 = 1) select sid, title, md5(text) as text_md5, case when pdf is null then 0 else 1 end as files from u")
def log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of crawl_log as a stream that is stopped once: the earlier lines, then all, four files an epoch."""
    rows, path = A.raw(spark, sf_dir), folder(spark)
    early = rows.filter("sid % 4 = 1").withColumn("作品名稱", F.concat(F.lit("old "), "作品名稱"))
    for lines in (early, rows):
        lines.write.mode("append").option("ignoreNullFields", True).json(f"{path}/in")
        ingest.start(spark, f"{path}/in", f"{path}/out", f"{path}/offsets", files=4).awaitTermination()
    return ingest.records(spark, f"{path}/out").select("sid", F.col("作品名稱").alias("title"), F.md5("摘要或動機").alias("text_md5"), F.size("檔案連結").alias("files"))


@query("select doc_id, strlen(coalesce(text, ''))::bigint as n_bytes, sha256(coalesce(text, '')) as content_sha256 from documents")
def archive_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to zip archives, an entry each, and read back by entry."""
    rows = A.table(spark, sf_dir, "documents").select(F.concat(F.lit("texts/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.encode("text", "UTF-8").alias("content"))
    found = archives.entries(archives.write(rows, folder(spark)))
    return found.select(F.regexp_extract("name", r"(-?\d+)\.txt$", 1).cast("long").alias("doc_id"), F.octet_length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("content_sha256"))


@query(SQL["search_rank"])
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of search_rank by posting lists. The serving fields are written once; the index is made of them and the search reads them."""
    path = folder(spark)
    search.serving(works(spark, sf_dir)).select("id", "type", "year", "_t", "_k", "_o", "_a").write.parquet(f"{path}/serving")
    docs = spark.read.parquet(f"{path}/serving")
    search.write_grams(docs, f"{path}/grams")
    return search.search(search.narrowed(docs, f"{path}/grams", RANKED), RANKED).select("id", "score", "year", "core")


@query(f"with {S.WORKS}, {S.CODES} select '第' || (14 + id % 52) || '屆' as edition, code, {S.pick(A.OFFICIAL, 'id')} as award from codes where id % 5 = 2 and id % 2 = 0")
def official_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = A.official(spark, sf_dir), folder(spark)
    rows.write.option("header", True).csv(path)
    return readers.csv(spark, path, rows.schema).select(F.col("屆次").alias("edition"), F.col("作品編號").alias("code"), F.col("名次").alias("award"))


@query(SQL["award_override"].replace("max(award) as award", "arg_max(award, id) as award").replace("select 14 + id % 52 as edition_no", "select id, 14 + id % 52 as edition_no"))
def official_last_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list with two lines of each work in files of its own: the last line counts, an earlier one is wrong."""
    path, schema = folder(spark), schemas.OFFICIAL
    lines = A.official_lines(A.filenames(spark, sf_dir)).filter("sid % 2 = 0")
    wrong = lines.withColumn("名次", A.pick(A.OFFICIAL, F.col("sid") + 1))
    for i, part in enumerate((wrong, lines)):
        part.orderBy("sid").drop("sid").write.option("header", True).csv(f"{path}/{i}")
    coded = curate.codes(works(spark, sf_dir), A.filenames(spark, sf_dir), A.file_codes(spark, sf_dir))
    return curate.official_awards(coded, readers.csv(spark, f"{path}/*", schema, place=True)).select("id", "rank", joined("special").alias("special"), "award_src")


@query(f"with {S.RAW}, l as (select sid, case when sid % 4 <> 0 then '全國' else '國際' end as src, subj, {S.pick(('物理', '化學、生物', '', '資訊、、數學'), 'sid // 9')} as d from raw) select src, subj as subject, list_filter(string_split(arg_max(d, sid), '、'), lambda x: x <> '')::varchar as domains from l group by 1, 2")
def subject_last_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of subjects with a line for each record, in order of the records."""
    path, i = folder(spark), F.col("sid")
    domains = A.pick(("物理", "化學、生物", "", "資訊、、數學"), F.floor(i / 9))
    lines = A.raw(spark, sf_dir).select(i, F.when(i % 4 != 0, "全國").otherwise("國際").alias("來源"), F.col("科別").alias("原始科別"), domains.alias("標準領域"))
    lines.orderBy("sid").drop("sid").write.option("header", True).csv(path)
    table = curate.subject_table(readers.csv(spark, path, schemas.SUBJECTS, place=True))
    return table.select("src", "subject", F.concat(F.lit("["), F.array_join("domains", ", "), F.lit("]")).alias("domains"))


PATCHES = {0: {"指導老師": "甲"}, 3: {"學校名稱": "乙校", "關鍵字": "丙"}, 16: {"學校名稱": "丁校"}, 17: {"學校名稱": "戊校"}}


@query(f"with {S.RAW} select sid, case when sid = 3 and coalesce(sch, '') = '' then '乙校' when sid = 16 and coalesce(sch, '') = '' then '丁校' when sid = 17 and coalesce(sch, '') = '' then '戊校' else sch end as school, case when sid = 0 and coalesce(teach, '') = '' then '甲' else teach end as teachers, case when sid = 3 and coalesce(kw, '') = '' then '丙' else kw end as keywords from raw")
def patched_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing fields of single records set from a table; fields that are there stay."""
    out = readers.patched(A.raw(spark, sf_dir), PATCHES)
    return out.select("sid", F.col("學校名稱").alias("school"), F.col("指導老師").alias("teachers"), F.col("關鍵字").alias("keywords"))


@query("select n_nationkey::bigint as sid, n_name as value from nation")
def map_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is one JSON object; of nations, as such a file is read by one task."""
    path = folder(spark)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.col("n_nationkey").cast("string").alias("k"), F.col("n_name").alias("v"))))
    A.table(spark, sf_dir, "nation").agg(F.to_json(pairs).alias("value")).write.text(path)
    return readers.json_map(spark, path, "string")


@query("select n_nationkey::bigint as sid, n_name as name from nation")
def array_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that is one JSON array over several lines."""
    path = folder(spark)
    row = F.struct(F.col("n_nationkey").cast("long").alias("sid"), F.col("n_name").alias("name"))
    A.table(spark, sf_dir, "nation").agg(F.replace(F.to_json(F.collect_list(row)), F.lit("},{"), F.lit("},\n{")).alias("value")).write.text(path)
    return readers.json_array(spark, path, schemas.of("sid long, name string"))


# ---- pages of the site, made from the records ----------------------------------------------------------------------


@query("select distinct (c % 7)::varchar as cat, sid::bigint as sid from (select l_orderkey % 97 as c, l_suppkey as sid from lineitem)")
def list_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    both, amp = A.table(spark, sf_dir, "lineitem"), F.when(F.col("l_linenumber") % 2 == 0, "&amp;").otherwise("&")
    link = F.concat(F.lit('<a href="detail.aspx?a=21'), amp, F.lit("cat="), (F.col("l_orderkey") % 97 % 7).cast("string"), amp, F.lit("sid="), F.col("l_suppkey").cast("string"), F.lit('">x</a> <a href="detail.aspx?a=21&sid=1">y</a>'))
    return readers.listed(both.select(link.alias("html")))


@query(f"with {S.RAW} select sid, {S.txt('t')} as title, md5({S.txt('text')}) as text_md5, nullif(subj, '') as subject, sch as school, coalesce(pdf is not null, false) as has_file from raw")
def record_page_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Record pages with every label twice, of which the last counts."""
    text = lambda c: T.html_escape(F.coalesce(c, F.lit("")))
    pair = lambda k, v: F.concat(F.lit(f'<p class="title x">{k}</p>\n<p class="v">'), v, F.lit("</p>"))
    rows = A.raw(spark, sf_dir)
    html = F.concat(
        F.lit('<div class="sciencefair-title"><p class="t">'), text(F.col("作品名稱")), F.lit("</p></div>"),
        pair("科別", F.lit("first")), pair("學校名稱", F.lit("first")), pair("科別", text(F.col("科別"))), pair("學校名稱", text(F.col("學校名稱"))),
        F.lit('<div class="summary-movtivation"><h1>x</h1> <div class="article-content a">'), text(F.col("摘要或動機")), F.lit("</div></div>"),
        F.when(F.size("檔案連結") > 0, '<a href="https://www.ntsec.edu.tw/article/FileAtt.ashx?id=7">f</a>').otherwise(""),
    )
    out = readers.record_pages(rows.select("sid", html.alias("html")))
    return out.select("sid", F.col("作品名稱").alias("title"), F.md5("摘要或動機").alias("text_md5"), F.col("科別").alias("subject"), F.col("學校名稱").alias("school"), (F.size("檔案連結") > 0).alias("has_file"))


@query("select page_id, case when page_id % 3 = 0 then 'ok' when page_id % 5 = 1 then '下載失敗：' || left(repeat('timeout ' || page_id || ' ', 9), 60) else '不是 PDF（連結可能已失效）' end as status from pages")
def fetch_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    head = F.encode(F.concat(F.when(i % 3 == 0, "%PDF-1.4").otherwise(""), F.coalesce("html", F.lit(""))), "UTF-8")
    error = F.when(i % 5 == 1, F.repeat(F.concat(F.lit("timeout "), i.cast("string"), F.lit(" ")), 9))
    return A.table(spark, sf_dir, "pages").select("page_id", R.fetch_status(head, error).alias("status"))


@query("select page_id, url from pages where page_id % 4 in (0, 1)")
def document_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that end in .pdf in any case count, those that begin with '._' and others don't."""
    i = F.col("page_id")
    name = F.concat(F.when(i % 4 == 2, "._").otherwise(""), F.lit("a"), i.cast("string"), F.when(i % 4 == 0, ".PDF").when(i % 4 == 3, ".pdf.zip").otherwise(".pdf"))
    return A.table(spark, sf_dir, "pages").filter(R.is_document(name)).select("page_id", "url")


# ---- snapshots, plans, choices -------------------------------------------------------------------------------------


@query(f"with {S.RAW} select sid from raw union all select unnest(range(m + 1, m + 2001)) from (select max(sid) as m from raw)")
def ids_to_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshots.to_check(A.raw(spark, sf_dir))


@query(rf"""with {NEW}, j as (select o.sid, trim(o.t, chr(10) || chr(13) || chr(9) || ' ') as ot, trim(n.t, chr(10) || chr(13) || chr(9) || ' ') as nt, o.sch as os, n.sch as ns from old o join new n using (sid) where n.error is null and n.t <> ''),
d as (select sid from j where ot <> nt union all select sid from j where os <> ns),
s as (select case when n.error is not null then 'failed' when coalesce(n.t, '') = '' then 'gone' else 'there' end as state from old o left join new n using (sid))
select '2026-01-01' as date, (select count(*) from old) as known, (select count(*) from d) as differences, (select count(distinct sid) from d) as works_changed, (select count(*) from s where state = 'gone') as gone,
(select count(*) from s where state = 'failed') as failed, (select count(*) from new where t <> '' and sid > (select max(sid) from old)) as added""")
def snapshot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = A.raw(spark, sf_dir).filter("`作品名稱` <> ''")
    return snapshots.summary(old, changed(old), "2026-01-01").select("date", "known", "differences", "works_changed", "gone", "failed", "added")


@query(f"""select base, year, n, case when max(bin) over (partition by base) = 0 then base else base || '_' || min(year) over b || case when min(year) over b <> max(year) over b then '-' || max(year) over b else '' end || '年' end as folder
from ({SQL['greedy_pack']}) window b as (partition by base, bin)""")
def folder_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = works(spark, sf_dir).filter(F.col("src") == rules.INTERNATIONAL).withColumn("base", R.folder_base(F.col("domains")))
    return packing.ranged_folders(rows, "base", "year", PACK)


@query(f"""with {S.WORKS}, {S.CASCADE}, g as (select coalesce(domain, '其他') || '_' || edition_no as base, stage, count(*) as n from works join final using (id) where src = '全國' and stage is not null group by 1, 2)
select base, stage, n, case when n < 5 and right(base, 1) not in ('3', '7') then '其他_' || stage else base end as target from g""")
def small_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New files by subject, edition and stage; folders of editions that end in 3 or 7 are there."""
    base = F.concat(R.folder_base(F.col("domains")), F.lit("_"), F.col("edition_no").cast("string"))
    new = full(spark, sf_dir).filter((F.col("src") == rules.NATIONAL) & F.col("stage").isNotNull()).groupBy(base.alias("base"), "stage").agg(F.count("*").alias("n"))
    return packing.merged_small(new, new.filter(F.right("base", F.lit(1)).isin("3", "7")))


@query(f"with {FILES}, bc as (select edition_no as edition, code, max(id) as a from works join codes using (id) where code is not null group by 1, 2), bt as (select edition_no as edition, {S.letters('title')} as key, max(id) as b from works where src = '全國' and type = '作品' group by 1, 2) select want, coalesce(a, b) as work from parsed_files f left join bc on f.edition = bc.edition and f.code = bc.code left join bt on f.edition = bt.edition and {S.letters('f.title')} = bt.key where f.edition is not null and coalesce(a, b) is not null")
def strict_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strict match ends with an error if a file has no work, so it is given those that have one."""
    coded = curate.codes(works(spark, sf_dir), A.filenames(spark, sf_dir), A.file_codes(spark, sf_dir))
    names = match.matched(file_names(coded), coded, fuzzy=False).filter("work is not null").select("want", "name")
    return match.strictly_matched(names, coded).select("want", "work")


FOLDER = 40
PLAN = f"""with recursive {S.WORKS}, {S.CASCADE}, f as (select id, coalesce(domain, '其他') || '_' || stage as base, stage, edition_no as e, stage in ('國小', '國中') and id % 7 < 3 as old from works join final using (id) where src = '全國' and stage is not null),
h as (select base || case when stage = '國小' then '' when e <= 40 then '_第15-40屆' else '_第41-65屆' end as folder, base, case when stage = '國小' then null when e <= 40 then 15 else 41 end as a, case when stage = '國小' then null when e <= 40 then 40 else 65 end as b, count(*) as held, min(e) as low, max(e) as high from f where old group by all),
nm as (select base, case when count(*) < 5 and base not in (select base from h) then '其他_' || split_part(base, '_', 2) else base end as t from f where not old group by base),
c as (select t as base, e, count(*) as n, row_number() over (partition by t order by e) as k from f join nm using (base) where not old group by t, e),
g as (select base, sum(n) as total, min(e) as lo, max(e) as hi from c group by base),
r as (select * from h where a is not null qualify row_number() over (partition by base order by a) = 1), p as (select * from h where a is null),
x as (select g.*, r.folder as was, case when r.base is not null then case when r.held + total <= {FOLDER} then 'wide' else 'own' end when p.base is null then 'plain' when p.held + total <= {FOLDER} then 'plain' else 'aside' end as how,
  g.base || '_第' || lo || '-' || hi || '屆' as own, g.base || '_第' || least(r.a, lo) || '-' || greatest(r.b, hi) || '屆' as wide, g.base || '_第' || p.low || '-' || p.high || '屆' as away from g left join (select base, folder, held, a, b from r) r on g.base = r.base left join p on g.base = p.base),
t as (select *, case how when 'wide' then wide when 'plain' then base else own end as target from x), y as (select *, total > {FOLDER} and target not in (select folder from h) as cut from t),
w as (select base, e, n, k, 0 as bin, n as fill from c where k = 1 union all select c.base, c.e, c.n, c.k, case when w.fill + c.n > {FOLDER} then w.bin + 1 else w.bin end, case when w.fill + c.n > {FOLDER} then c.n else w.fill + c.n end from w join c on c.base = w.base and c.k = w.k + 1),
z as (select w.base, e, case when cut then w.base || '_第' || min(e) over i || '-' || max(e) over i || '屆' else target end as folder from w join y using (base) window i as (partition by w.base, bin))"""


def new_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """New national files, and folders with those that are there: of primary schools plain ones, of junior high schools two ranges."""
    base = F.concat(R.folder_base(F.col("domains")), F.lit("_"), F.col("stage"))
    rows = full(spark, sf_dir).filter((F.col("src") == rules.NATIONAL) & F.col("stage").isNotNull()).select("id", base.alias("base"), F.col("edition_no").alias("edition"), "stage")
    old = F.col("stage").isin("國小", "國中") & (F.col("id") % 7 < 3)
    part = F.when(F.col("stage") == "國小", "").when(F.col("edition") <= 40, "_第15-40屆").otherwise("_第41-65屆")
    return rows.filter(~old).select("id", "base", "edition"), rows.filter(old).groupBy(F.concat("base", part).alias("folder"), "edition").agg(F.count("*").alias("n"))


@query(f"{PLAN} select id, folder from f join nm using (base) join z on z.base = nm.t and z.e = f.e where not old")
def incremental_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.incremental(*new_files(spark, sf_dir), FOLDER)[0]


@query(f"{PLAN} select case how when 'wide' then was else base end as folder, case how when 'wide' then wide else away end as renamed from t where how = 'aside' or how = 'wide' and was <> wide")
def folder_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.incremental(*new_files(spark, sf_dir), FOLDER)[1]


@query(f"with {S.WORKS} select id, edition_no from works where edition_no in (20, 21, 40)")
def edition_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.of_editions(works(spark, sf_dir), (20, 21, 40)).select("id", "edition_no")


@query("select doc_id::varchar as wrong, case when doc_id % 3 = 0 then 'old' else 'new' end as \"right\" from documents")
def repairs_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of repairs of which old pairs stay, behind those of all documents."""
    new = A.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("wrong"), F.lit("new").alias("right"))
    return fulltext.merged_repairs(new.filter("cast(wrong as long) % 3 = 0").withColumn("right", F.lit("old")), new)


@query(rf"""with {S.WORKS}, p as (select id, '第 ' || id % 90 || ' 頁' || chr(10) || abstract || chr(10) || chr(10) || chr(10) || '  - ' || id % 1000 || ' -' || chr(10) || '水溫 25 o C　下' || chr(10) || '降，甲' || chr(10) || '乙' || chr(10) || '丙' as x from works),
a as (select id, regexp_replace(regexp_replace(x, '(?m)^\s*(第\s*\d+\s*頁|[-–—]?\s*\d{{1,3}}\s*[-–—]?)\s*$', '', 'g'), '(\d)\s*\n?\s*o\s*\n?\s*C\b', '\1°C', 'g') as x from p),
b as (select id, regexp_replace(x, '[ \t　]+', ' ', 'g') as x from a), c as (select id, regexp_replace(x, '([一-鿿，、；：（）「」])\n([一-鿿，、；：（）「」])', '\1\2', 'g') as x from b),
d as (select id, regexp_replace(x, '([一-鿿，、；：（）「」])\n([一-鿿，、；：（）「」])', '\1\2', 'g') as x from c)
select id, md5(regexp_replace(regexp_replace(x, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')) as text from d""")
def paragraphs_cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("id")
    text = F.concat(F.lit("第 "), (i % 90).cast("string"), F.lit(" 頁\n"), "abstract", F.lit("\n\n\n  - "), (i % 1000).cast("string"), F.lit(" -\n水溫 25 o C　下\n降，甲\n乙\n丙"))
    return works(spark, sf_dir).select("id", F.md5(T.paragraphs(text)).alias("text"))


STATES = ("q=solar+cell&yf=1990&c=%E5%8F%B0%E5%8C%97%E5%B8%82&sort=old", "rv=1&yt=x&w=17", "")


@query("select * from (values (0, 'solar cell', 1990, '台北市', false, 'old', null, 2), (1, '', null, '', true, 'rel', 17, 1), (2, '', null, '', false, 'rel', null, 0)) t(n, q, year_from, city, review, sort, opened, active)")
def url_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = [search.SearchRequest.from_query_string(s) for s in STATES]
    rows = [(n, r.q, r.year_from, r.city, r.review, r.sort, r.open, r.active) for n, r in enumerate(found)]
    return spark.createDataFrame(rows, "n int, q string, year_from int, city string, review boolean, sort string, opened int, active int")
