"""The registered queries in SQL of another engine, written from the rules and not from the DataFrame code."""

from __future__ import annotations

from corvina import rules
from corvina.plans import adapters as A


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def array(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(text, values)) + "]"


def pick(values: tuple[str, ...], i: str) -> str:
    return f"{array(values)}[({i}) % {len(values)} + 1]"


def among(values: tuple[str, ...]) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


def case(x: str, pairs: tuple[tuple[str, str], ...]) -> str:
    return f"case {x} " + " ".join(f"when {text(a)} then {text(b)}" for a, b in pairs) + " end"


def txt(x: str) -> str:
    return rf"regexp_replace(regexp_replace(replace(coalesce({x}, ''), '\r', ''), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '^[\s\x{{a0}}\x{{3000}}]+|[\s\x{{a0}}\x{{3000}}]+$', '', 'g')"


def norm(x: str) -> str:
    wide, narrow = "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F)))
    return f"translate(replace(lower(coalesce({x}, '')), '台', '臺'), {text(wide)}, {text(narrow)})"


def letters(x: str) -> str:
    return rf"regexp_replace({x}, '[^\p{{L}}\p{{N}}]', '', 'g')"


RAW = rf"""raw as (
  select doc_id as sid, text, lang, 1974 + doc_id % 52 as y,
    case when doc_id % 29 = 1 then '評語 ' else '' end || left(split_part(coalesce(text, ''), chr(10), 1), 60) as t,
    case when doc_id % 4 <> 0 then '第' || (14 + doc_id % 52) || '屆--民國 ' || (63 + doc_id % 52) || '年' else (1974 + doc_id % 52)::varchar end as ed,
    {pick(A.SUBJECTS, "doc_id")} as subj, {pick(A.AWARDS, "doc_id")} as award, {pick(A.SCHOOLS, "doc_id")} as sch, {pick(A.TEACHERS, "doc_id")} as teach,
    {pick(A.TEACHERS, "doc_id + 1")} || '；' || lang as authors, {pick(A.KEYWORDS, "doc_id")} as kw,
    case when doc_id % 3 <> 0 then 'https://example.org/file?id=' || doc_id end as pdf
  from documents)"""
PARTS = "list_transform(case when regexp_matches(k, '[、,，;；/]') then regexp_split_to_array(k, '[、,，;；/]') when regexp_matches(k, '[一-鿿]') then regexp_split_to_array(k, '\\s+') else [k] end, lambda x: trim(x, ' .。'))"
WORKS = rf"""{RAW}, named as (
  select sid as id, case when sid % 4 <> 0 then '全國' else '國際' end as src, {txt("t")} as title, regexp_replace({txt("ed")}, '\s', '', 'g') as edition, {txt("subj")} as subject,
    {txt("award")} as award_raw, {txt("sch")} as school, {txt("text")} as abstract, {txt("kw")} as k, pdf, authors, lang,
    list_filter(list_transform(regexp_split_to_array({txt("teach")}, '[;；、,，]'), lambda x: trim(x)), lambda x: x <> '') as teachers
  from raw), works as (
  select *, case when src = '全國' and contains(title, '評語') then '評語' else '作品' end as type,
    list_filter({PARTS}, lambda x, i: x <> '' and list_position({PARTS}, x) = i) as keywords,
    try_cast(nullif(regexp_extract(edition, '第\s*(\d+)\s*屆', 1), '') as int) as edition_no,
    coalesce(try_cast(nullif(regexp_extract(edition, '民國\s*(\d+)', 1), '') as int) + 1911, try_cast(nullif(regexp_extract(edition, '(\d{{4}})', 1), '') as int)) as year,
    {case("subject", tuple((s, d) for names, d in A.DOMAINS for s in names))} as domain
  from named)"""


def parse(source: str, column: str, out: str = "parsed") -> str:
    """CTEs that add rank, special and rep to the rows of a source."""
    rep = "regexp_matches(x, '代表|展覽會|博覽會')"
    fix = f"coalesce({case('z', rules.SPECIAL_SPELLINGS)}, z)"
    return rf"""{out}_c as (select *, regexp_split_to_array({txt(column)}, '[;；、]') as chunks from {source}), {out}_p as (
  select *, list_filter(flatten(list_transform(list_filter(chunks, lambda x: not {rep}), lambda x: regexp_split_to_array(x, '\s+'))), lambda x: x <> '') as parts from {out}_c), {out} as (
  select * exclude (chunks, parts), coalesce(list_filter(parts, lambda x: x in {among(rules.RANKS)} and x not in {among(rules.NO_RANK)})[1], case when len(list_filter(parts, lambda x: x in {among(rules.RANKS)})) > 0 then '未得獎' end) as rank,
    list_distinct(list_transform(list_transform(list_filter(parts, lambda x: x not in {among(rules.RANKS)}), lambda x: replace(replace(x, '(鄉土)教材獎', '最佳鄉土教材獎'), '最佳最佳', '最佳')), lambda z: {fix})) as special,
    list_transform(list_filter(chunks, lambda x: {rep}), lambda x: regexp_replace(x, '\s', '', 'g')) as rep
  from {out}_p)"""


def listed(x: str, order: bool = True) -> str:
    return f"coalesce(array_to_string({f'list_sort({x})' if order else x}, '|'), '')"


def city(x: str) -> str:
    s = f"replace({x}, '台', '臺')"
    old = "case " + " ".join(f"when contains({s}, {text(a)}) then {text(b)}" for a, b in rules.OLD_COUNTIES) + " end"
    towns = "case " + " ".join(f"when contains({s}, {text(a)}) then {text(b)}" for a, b in rules.TOWNS) + " end"
    first = lambda pairs: f"list_min(list_filter([{', '.join(f'{{pos: instr({s}, {text(a)}), b: {text(b)}}}' for a, b in pairs)}], lambda q: q.pos > 0)).b"
    return f"coalesce({old}, {first([(c, c) for c in rules.CITIES])}, {towns}, {first([(c[:2], c) for c in rules.SHORT_CITIES])})"


def school_stage(x: str) -> str:
    s = f"replace({x}, '臺', '台')"
    return "case " + " ".join(f"when regexp_matches({s}, {text(p)}) then {text(v)}" for p, v in rules.SCHOOL_STAGES) + " end"


CLASS = f"case when rank in {among(rules.TOP_RANKS)} then 'top' when rank in {among(rules.MERIT_RANKS)} then 'merit' when rank = '未得獎' then 'none' end"
VOTE = f"""based as (select id, src, edition, school, {school_stage("school")} as base, row_number() over (partition by src, edition order by id) as n from works where type = '作品'),
marked as (select *, base is null or regexp_matches(school, {text(rules.AMBIGUOUS_SCHOOL)}) as amb from based),
votes as (select m.id, v.base, count(*) as c, min(v.n) as first from marked m join marked v on m.src = v.src and m.edition = v.edition and abs(m.n - v.n) <= 4 and not v.amb where m.amb group by m.id, v.base),
best as (select id, arg_max(base, (c, -first)) as base from votes group by id),
vote as (select m.id, case when amb then coalesce(b.base, m.base) else m.base end as voted from marked m left join best b on m.id = b.id)"""
CODES = """codes as (select id,
  coalesce(case when id % 5 = 2 then ['03', '04', '05', '08', '77'][id % 5 + 1] || lpad((id % 10000)::varchar, 4, '0') end, case when id % 5 = 3 and id % 2 = 0 then lpad((80000 + id % 10000)::varchar, 6, '0') end) as code,
  case when id % 5 = 3 then """ + pick(A.FILE_GROUPS, "id") + """ end as file_group, case when id % 7 = 4 then """ + pick(A.GROUPS, "id") + """ end as listed_group from works)"""
LEFT2 = case("left(code, 2)", rules.CODE_STAGES)
LISTED, FILED = case("listed_group", rules.GROUP_STAGES), case("file_group", rules.FILE_GROUP_STAGES)
CASCADE = rf"""{VOTE}, {CODES}, tried as (select w.id, w.type, code, {LEFT2} as a, {LISTED} as b, {FILED} as c, nullif(regexp_extract(subject, '{rules.SUBJECT_STAGE}', 1), '') as d, voted as e
  from works w join codes using (id) left join vote using (id)),
staged as (select id, code, case when type = '作品' then coalesce(a, b, c, d, e) end as stage0,
  case when type = '作品' then case when a is not null then '作品編號' when b is not null or c is not null then '官網組別' when d is not null then '官網科別' when e is not null then '推測' end end as stage_src from tried),
final as (select id, code, case when stage0 in ('高中', '高職') then '高中職' else stage0 end as stage, stage_src, case when stage0 in ('高中', '高職') then stage0 end as stage_detail from staged)"""
SERVING = f"""serving as (select *, {norm("title")} as nt, {norm("array_to_string(keywords, ' ')")} as nk, {norm("school || ' ' || array_to_string(teachers, ' ')")} as no, {norm("abstract")} as na from parsed)"""


def points(term: str, scope: bool = False) -> str:
    t = text(term)
    s = f"(case when contains(nt, {t}) then 6 else 0 end + case when contains(nk, {t}) then 4 else 0 end"
    return s + ")" if scope else s + f" + case when contains(no, {t}) then 2 else 0 end + least(3, (length(na) - length(replace(na, {t}, ''))) // {len(term)}))"


TOKENS = r"""toks as (select id, lower(concat_ws(' ', title, title, title, array_to_string(keywords, ' '), array_to_string(keywords, ' '), abstract)) as t from works where type = '作品'),
runs as (select id, unnest(regexp_extract_all(t, '[一-鿿]{2,}')) as r, generate_subscripts(regexp_extract_all(t, '[一-鿿]{2,}'), 1) as k from toks),
pairs as (select id, r[i:i + 1] as token, k * 1000000 + i as pos from runs, unnest(range(1, length(r))) as u(i)),
latin as (select id, unnest(regexp_extract_all(t, '[a-z][a-z0-9\-]{2,}')) as token, 1000000000 + generate_subscripts(regexp_extract_all(t, '[a-z][a-z0-9\-]{2,}'), 1) as pos from toks),
tf as (select id, token, count(*) as tf, min(pos) as pos from (select * from pairs union all select * from latin) group by id, token),
df as (select token, count(*) as df from tf group by token),
w as (select id, token, pos, round((1 + ln(tf)) * ln((select count(*) from toks) / df), 12) as w from tf join df using (token) where df > 1 and df < 0.2 * (select count(*) from toks)),
ranked as (select *, row_number() over (partition by id order by w desc, pos) as rank from w),
vec as (select id, token, rank, w / coalesce(nullif(sqrt(sum(w * w) over (partition by id)), 0), 1) as x from ranked where rank <= 60)"""
