"""The registered queries as SQL over the supplied tables.

Each query is a list of common table expressions plus a final select whose
columns are cast as `spec` says. The SQL is written from the definitions in
the survey, not from the Spark plans: words are unfolded to rows and every
clause is its own join.
"""

from __future__ import annotations

from checks.spec import SPEC, columns
from findrift.functions import scoring as S
from findrift.functions import stemmer as P
from findrift.functions import text as T

AS_OF = "date '2001-12-31'"
WORD = r"[\p{L}\p{N}]+"

# The edit distance of the oracle counts bytes, so letters outside ASCII are
# first mapped to single control characters.
_LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
_CODES = [c for c in range(1, 32) if c not in (9, 10, 13)][: len(_LETTERS)]
_TO = "||".join(f"chr({c})" for c in _CODES)


def _lit(v) -> str:
    return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)


def _list(values) -> str:
    return "[" + ", ".join(_lit(v) for v in values) + "]"


def _boost(table: dict) -> str:
    return "(values " + ", ".join(f"({_lit(f)}, {b})" for f, b in table.items()) + ")"


_IDF = "ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5))"
_SAT = "{tf} / ({tf} + 1.2 * (0.25 + 0.75 * {dl} / {avg}))"


def idf(n: str, df: str) -> str:
    return _IDF.format(n=n, df=df)


def sat(tf: str, dl: str, avg: str) -> str:
    return f"(case when {avg} is null then 1.0 else {_SAT.format(tf=tf, dl=dl, avg=avg)} end)"


def scale(avg: str) -> str:
    return f"(case when {avg} is null then 1.0 else 2.2 end)"


def words(text: str) -> str:
    return f"regexp_extract_all(lower(coalesce({text}, '')), '{WORD}')"


def _decay(date: str, days: int) -> str:
    return (
        f"coalesce(exp(pow(abs(date_diff('day', {date}, {AS_OF})) / {days}.0, 2) * ln(0.5)), 1.0)"
    )


def _signals(w: dict, days: int) -> str:
    return (
        f"({w['popularity']} * log10(1 + coalesce(popularity, 1.0)) "
        f"+ {w['vote_count']} * log10(2 + coalesce(vote_count, 1)) "
        f"+ {w['vote_average']} * coalesce(vote_average, 5.0) "
        f"+ {w['recency']} * {_decay('release_dt', days)})"
    )


KEYWORD = _signals(S.KEYWORD_SIGNALS, S.KEYWORD_SCALE)
BROWSE = _signals(S.BROWSE_SIGNALS, S.BROWSE_SCALE)

# --- common table expressions, in an order that satisfies their references ---

CTE: dict[str, str] = {}

CTE["li"] = (
    "select l_partkey, count(*) vc, round(avg(l_quantity) / 5, 4) va from lineitem group by l_partkey"
)
CTE["b"] = (
    r"select doc_id, text, lang, source, string_split_regex(text, '\s+') w from documents"
)
CTE["catalog"] = """
select b.doc_id id, array_to_string(w[1:5], ' ') title, array_to_string(w[6:9], ' ') tagline,
  text overview,
  list_concat(list_concat(list_value(source, lang),
    case when quality = 1 then ['quality'] else cast([] as varchar[]) end),
    case when toxic = 1 then ['toxic'] else cast([] as varchar[]) end) genres,
  string_split(p_name, ' ') keywords,
  [array_to_string(w[10:11], ' '), array_to_string(w[13:14], ' ')] cast_names, p_brand director,
  case when b.doc_id % 17 = 0 then '' when b.doc_id % 19 = 0 then '1998'
       when b.doc_id % 23 = 0 then 'not-a-date' when b.doc_id % 41 = 0 then '9223372036854775807'
       when b.doc_id % 43 = 0 then concat('9517', b.doc_id, '00000')
       else strftime(date '1995-01-01' + cast(b.doc_id * 37 % 2400 as integer), '%Y-%m-%d') end release_date,
  va vote_average, cast(vc as integer) vote_count,
  case when b.doc_id % 13 = 0 then null else round(p_retailprice / 10, 4) end popularity,
  p_size * 4 runtime, lang original_language, w
from b left join part on p_partkey = b.doc_id left join li on l_partkey = b.doc_id
  left join labels on labels.doc_id = b.doc_id
"""
CTE["docs"] = r"""
select *, case
  when regexp_full_match(release_date, '\d{4}-\d{2}-\d{2}') then try_cast(release_date as date)
  when regexp_full_match(release_date, '\d{4}') then make_date(cast(release_date as integer), 1, 1)
  when try_cast(release_date as bigint) between -62135596800000 and 253402300799999
  then cast(make_timestamp(try_cast(release_date as bigint) * 1000) as date) end release_dt
from catalog
"""
CTE["rawq"] = r"""
select item_id * 2 + form query_id,
  case when form = 0 then text else case item_id % 10
    when 0 then '  ' when 1 then 'en' when 2 then 'RED' when 3 then 'Brand#13'
    when 4 then w[1] when 5 then array_to_string(w[1:5], ' ')
    else array_to_string(w[2:4], ' ') end end q,
  case when item_id % 3 = 0 then 'en,,src1' end genres,
  case item_id % 4 when 0 then '5.0' when 1 then 'abc' end rmin,
  case when item_id % 5 = 0 then '6' end rmax,
  case when item_id % 7 = 0 then '2' when item_id % 7 = 1 then '0' when item_id % 7 = 2 then '99999999999'
    when item_id % 11 = 3 then repeat('9', 400) end page,
  case item_id % 6 when 0 then '10' when 1 then '500' when 2 then '99999999999' end size
from (select *, string_split_regex(text, '\s+') w from benchmark), (values (0), (1)) forms(form)
"""
CTE["q"] = """
select query_id, coalesce(q, '') query,
  nullif([x for x in string_split(genres, ',') if x <> ''], []) genres,
  try_cast(rmin as double) rating_min, try_cast(rmax as double) rating_max,
  case when page is null then 1 when length(page) > 16 then 1000000000000000
    else least(1000000000000000, greatest(1, cast(page as bigint))) end page,
  case when size is null then 24 else least(50, greatest(1, cast(size as bigint))) end page_size
from rawq
"""
CTE["t"] = "select query_id, query from q where trim(query) <> ''"
CTE["toks"] = f"""
select id, field, false exact, len(ts) dl, unnest(range(len(ts))) pos, unnest(ts) term from (
  select id, 'title' field, {words('title')} ts from catalog
  union all select id, 'tagline', {words('tagline')} from catalog
  union all select id, 'overview', {words('overview')} from catalog)
union all
select id, 'cast.name', false, len(x) + len(y),
  unnest(list_concat(range(len(x)), [100 + len(x) + i for i in range(len(y))])),
  unnest(list_concat(x, y))
from (select id, {words('cast_names[1]')} x, {words('cast_names[2]')} y from catalog)
union all select id, 'title.keyword', true, 1, null, title from catalog where title is not null
union all select id, 'director', true, 1, null, director from catalog where director is not null
union all select distinct id, 'genres', true, 1, cast(null as bigint), unnest(genres) from catalog
union all select distinct id, 'keywords', true, 1, cast(null as bigint), unnest(keywords) from catalog
"""
CTE["post"] = """
select id, field, term, count(*) tf, max(dl) dl, max(exact) exact, list_sort(list(pos) filter (pos is not null)) positions
from toks group by id, field, term
"""
CTE["voc"] = "select field, term, count(*) df from post group by field, term"
CTE["st"] = """
select field, count(*) n_docs, case when bool_or(exact) then null else avg(dl) end avg_len
from (select field, id, max(dl) dl, bool_or(exact) exact from post group by field, id) group by field
"""
CTE["qt"] = f"""
select query_id, unnest(range(len(ts))) i, unnest(ts) term, len(ts) n
from (select query_id, {words('query')} ts from t)
"""
CTE["fq"] = """
select query_id, field, term qterm, count(*) times
from qt, (values ('title'), ('tagline'), ('overview'), ('cast.name')) f(field) group by all
union all
select query_id, field, query, 1 from t, (values ('title.keyword'), ('director')) f(field)
"""
CTE["fx"] = f"""
select field, qterm, term, df, edits, 1 - edits / least(lq, lt) weight from (
  select a.field, a.qterm, v.term, v.df, lq, lt, k, damerau_levenshtein(a.m, v.m) edits
  from (select distinct field, qterm, length(qterm) lq,
          case when length(qterm) <= 2 then 0 when length(qterm) <= 5 then 1 else 2 end k,
          translate(qterm, '{_LETTERS}', {_TO}) m from fq) a
  join (select field, term, df, length(term) lt, translate(term, '{_LETTERS}', {_TO}) m from voc) v
    on a.field = v.field and abs(lq - lt) <= k)
where edits <= k
"""
CTE["best"] = f"""
select query_id, id, max(s) score from (
  select c.query_id, p.id, p.field, sum(c.w * b.boost * {scale('st.avg_len')}
      * {idf('st.n_docs', 'c.gdf')} * {sat('p.tf', 'p.dl', 'st.avg_len')}) s
  from (select fq.query_id, fx.field, fx.term, fq.times * fx.weight w, g.gdf
        from fq join fx using (field, qterm)
        join (select field, qterm, max(df) gdf from fx group by all) g using (field, qterm)) c
  join post p on p.field = c.field and p.term = c.term
  join st on st.field = c.field
  join {_boost(S.BEST_FIELDS)} b(field, boost) on b.field = c.field
  group by all)
group by all
"""
CTE["cross_parts"] = f"""
select query_id, id, sum(m) score from (
  select qt.query_id, qt.i, p.id, max(b.boost * 2.2 * {idf('g.n', 'd.gdf')} * {sat('p.tf', 'p.dl', 'st.avg_len')}) m
  from qt join post p on p.term = qt.term
  join {_boost(S.CROSS_FIELDS)} b(field, boost) on b.field = p.field
  join st on st.field = p.field
  join (select term, max(df) gdf from voc where field in ('title', 'overview', 'cast.name') group by term) d
    on d.term = qt.term,
  (select max(n_docs) n from st where field in ('title', 'overview', 'cast.name')) g
  group by all)
group by all
union all
select t.query_id, p.id, {S.CROSS_DIRECTOR} * {idf('st.n_docs', 'v.df')}
from t join post p on p.field = 'director' and p.term = t.query
join voc v on v.field = 'director' and v.term = t.query join st on st.field = 'director'
"""
CTE["cross_f"] = "select query_id, id, max(score) score from cross_parts group by all"
CTE["term_m"] = f"""
select query_id, id, sum(s) score from (
  select t.query_id, p.id, {S.GENRE_TERM} * {idf('st.n_docs', 'v.df')} s
  from t join post p on p.field = 'genres' and p.term = t.query
  join voc v on v.field = p.field and v.term = p.term join st on st.field = p.field
  union all
  select t.query_id, p.id, {S.KEYWORD_TERM} * {idf('st.n_docs', 'v.df')}
  from t join post p on p.field = 'keywords' and p.term = lower(t.query)
  join voc v on v.field = p.field and v.term = p.term join st on st.field = p.field)
group by all
"""
CTE["pidf"] = f"""
select qt.query_id, v.field, sum({idf('st.n_docs', 'v.df')}) idf
from qt join voc v on v.term = qt.term join st on st.field = v.field
where v.field in ('title', 'cast.name', 'overview') group by all
"""


def _phrase_score(freq_cte: str, boosts: dict) -> str:
    return f"""
select f.query_id, f.field, f.id, f.freq,
  b.boost * 2.2 * i.idf * {sat('f.freq', 'd.dl', 'st.avg_len')} score
from {freq_cte} f join {_boost(boosts)} b(field, boost) on b.field = f.field
join st on st.field = f.field
join pidf i on i.query_id = f.query_id and i.field = f.field
join (select distinct id, field, dl from post) d on d.id = f.id and d.field = f.field
"""


CTE["pfreq"] = """
select query_id, field, id, cast(count(*) as double) freq from (
  select qt.query_id, k.field, k.id, k.pos - qt.i start
  from qt join toks k on k.term = qt.term where k.field in ('title', 'cast.name')
  group by all having count(distinct qt.i) = max(qt.n))
group by all
"""
CTE["phrase"] = _phrase_score("pfreq", S.PHRASES)
CTE["sfreq"] = """
select query_id, field, id, sum(1 / (1 + spread)) freq from (
  select query_id, field, id, edge, max(off) spread from (
    select qt.query_id, k.field, k.id, qt.i, qt.n, k.pos - qt.i - o.off edge, min(o.off) off
    from qt join toks k on k.term = qt.term and k.field = 'overview', (values (0), (1), (2)) o(off)
    group by all)
  group by query_id, field, id, edge
  having count(*) = max(n) and min(off) = 0 and count(distinct edge + off + i) = max(n))
group by all
"""
CTE["sloppy"] = _phrase_score("sfreq", S.SLOPPY_PHRASES)
CTE["should"] = """
select query_id, id, sum(score) score from (
  select query_id, id, score from best union all select query_id, id, score from cross_f
  union all select query_id, id, score from term_m union all select query_id, id, score from phrase
  union all select query_id, id, score from sloppy)
group by all
"""
CTE["matched"] = f"""
select s.query_id, s.id, round(s.score * {KEYWORD}, 6) score, d.genres doc_genres, d.vote_average
from should s join docs d using (id)
union all
select q.query_id, d.id, round({BROWSE}, 6), d.genres, d.vote_average
from q, docs d where trim(q.query) = ''
"""
_GENRE_OK = "(q.genres is null or list_has_any(m.doc_genres, q.genres))"
_RATING_OK = (
    "(q.rating_min is null or coalesce(m.vote_average >= q.rating_min, false)) and "
    "(q.rating_max is null or coalesce(m.vote_average <= q.rating_max, false))"
)
CTE["kept"] = f"""
select m.query_id, m.id, m.score, q.page, q.page_size,
  row_number() over (partition by m.query_id order by m.score desc, m.id) rank
from matched m join q using (query_id) where {_GENRE_OK} and {_RATING_OK}
"""
CTE["sreq"] = """
select anchor query_id, anchor, case when anchor // 20 % 4 = 0 or anchor // 20 % 8 = 3 then 20
  when anchor // 20 % 4 = 1 then 1 else 8 end as "limit"
from (select doc_id anchor from documents union all select item_id * 20 + 1000000000 from benchmark)
"""
CTE["areq"] = "select * from sreq where anchor % 20 = 0"
CTE["tell"] = """
select r.anchor, p.field, p.term, v.df
from (select distinct anchor from areq) r join post p on p.id = r.anchor
join voc v on v.field = p.field and v.term = p.term, (select count(*) n from catalog) c
where p.field in ('title', 'overview', 'genres', 'keywords') and v.df >= 2
qualify row_number() over (partition by r.anchor
  order by round(p.tf * (1 + ln((c.n + 1) / (v.df + 1))), 9) desc, p.field, p.term) <= 25
"""
CTE["sim"] = f"""
select anchor, id, score, row_number() over (partition by anchor order by score desc, id) rank from (
  select l.anchor, p.id, round(sum({scale('st.avg_len')} * {idf('st.n_docs', 'l.df')}
      * {sat('p.tf', 'p.dl', 'st.avg_len')}), 6) score
  from tell l join post p on p.field = l.field and p.term = l.term and p.id <> l.anchor
  join st on st.field = l.field
  join (select anchor, count(*) n from tell group by anchor) c on c.anchor = l.anchor
  group by l.anchor, p.id, c.n having count(*) >= greatest(1, floor(c.n * 0.3)))
"""
# raw details: what survives of each record
CTE["det"] = """
select id, title, overview, release_date, vote_average, vote_count, popularity, genres, runtime,
  original_language, tagline, keywords,
  [array_to_string(w[2 * k + 1 : 2 * k + 2], ' ') for k in range(12)] members,
  case when id % 7 <> 0 then director end director, id % 29 = 0 error, id % 31 = 0 malformed
from catalog
"""
CTE["usable"] = "select * from det where not error and not malformed"
CTE["export"] = """
select p_partkey id, case when p_partkey % 11 = 0 then 0.0 else p_retailprice end popularity from part
"""
CTE["delta2"] = """
select id, title || ' v2' title, director from catalog where id in (select doc_id from labels)
union all select item_id + 1000000000, text || ' v2', 'new' from benchmark
"""
_LOG_TERMS = f"""
select conv_id, turn, field, term, count(*) tf, list_sort(list(pos)) positions from (
  select conv_id, turn, field, unnest(range(len(ts))) pos, unnest(ts) term from (
    select conv_id, turn, 'role' field, {words('role')} ts from conversations
    union all select conv_id, turn, 'text', {words('text')} from conversations))
group by all
"""

# --- English analysis: the stemmer as nested selects ---


def _suffix_case(rules, measure: str) -> str:
    out = "case"
    for suffix, repl in P.longest_first(rules):
        out += (
            f" when ends_with(w, '{suffix}') then "
            rf"regexp_replace(w, '^({measure}.*){suffix}$', '\1{repl}')"
        )
    return out + " else w end"


def _step_4_case() -> str:
    out = "case"
    for suffix, before in P.step_4_rules():
        out += (
            f" when ends_with(w, '{suffix}') then case when "
            f"regexp_matches(w[:-{len(suffix) + 1}], '^{P.M_OVER_1}') and "
            f"regexp_matches(w[:-{len(suffix) + 1}], '{before}$') "
            f"then w[:-{len(suffix) + 1}] else w end"
        )
    return out + " else w end"


def _stems() -> str:
    sql = r"select distinct term, regexp_replace(term, '^y', 'Y') w from content"
    sql = f"""select term, case when ends_with(w, 'sses') or ends_with(w, 'ies') then w[:-3]
      when ends_with(w, 'ss') then w when ends_with(w, 's') then w[:-2] else w end w from ({sql})"""
    sql = rf"""select term, w, case when ends_with(w, 'eed')
        then regexp_replace(w, '^({P.M_OVER_0}.*)eed$', '\1ee')
        else regexp_replace(w, '^({P.VOWEL_IN_STEM}.*)(?:ed|ing)$', '\1') end b from ({sql})"""
    sql = f"""select term, case when ends_with(w, 'eed') or b = w then b
      when regexp_matches(b, '(?:at|bl|iz)$') then b || 'e'
      when length(b) > 1 and b[-1] = b[-2:-2] and regexp_matches(b, '[^aeiouylsz]$') then b[:-2]
      when regexp_matches(b, '^{P.SHORT_STEM}$') then b || 'e' else b end w from ({sql})"""
    sql = rf"select term, regexp_replace(w, '^({P.VOWEL_IN_STEM}.*)y$', '\1i') w from ({sql})"
    sql = f"select term, {_suffix_case(P.STEP_2, P.M_OVER_0)} w from ({sql})"
    sql = f"select term, {_suffix_case(P.STEP_3, P.M_OVER_0)} w from ({sql})"
    sql = f"select term, {_step_4_case()} w from ({sql})"
    sql = f"""select term, case when ends_with(w, 'e') and (regexp_matches(w[:-2], '^{P.M_OVER_1}')
      or (regexp_matches(w[:-2], '^{P.M_IS_1}$') and not regexp_matches(w[:-2], '^{P.SHORT_STEM}$')))
      then w[:-2] else w end w from ({sql})"""
    sql = f"""select term, case when ends_with(w, 'll') and regexp_matches(w, '^{P.M_OVER_1}')
      then w[:-2] else w end w from ({sql})"""
    return (
        "select term, case when length(term) <= 2 then term "
        f"else regexp_replace(w, '^Y', 'y') end stem from ({sql})"
    )


_POSSESSIVE = r"([\p{L}\p{N}])[''’][sS]($|[^\p{L}\p{N}])"
CTE["content"] = f"""
select * from (
  select id, field, unnest(range(len(ts))) pos, unnest(ts) term from (
    select id, field, regexp_extract_all(lower(regexp_replace(coalesce(value, ''), '{_POSSESSIVE}', '\\1\\2', 'g')), '{WORD}') ts
    from (select id, 'title' field, title as value from catalog union all select id, 'tagline', tagline from catalog
          union all select id, 'overview', overview from catalog)))
where term not in ({', '.join(_lit(s) for s in T.STOP_WORDS)})
"""
CTE["stems"] = _stems()

# --- final selects ---

_TERM_FIELDS = "('title', 'tagline', 'overview', 'cast.name')"

FINAL: dict[str, str] = {
    "tokens_standard": "select id, field, pos, term from toks where not exact",
    "tokens_english": "select id, field, pos, term, stem from content join stems using (term)",
    "edge_ngrams": (
        "select id, pos, term word, unnest([substr(term, 1, n) "
        "for n in range(2, least(15, length(term)) + 1)]) gram from toks where field = 'title' and length(term) >= 2"
    ),
    "autocomplete": (
        "select query_id, rank, id, score from (select query_id, id, count(*) score, "
        "row_number() over (partition by query_id order by count(*) desc, id) rank from "
        "(select distinct qt.query_id, k.id, qt.term from qt join toks k on k.field = 'title' "
        "and length(qt.term) between 2 and 15 and starts_with(k.term, qt.term)) group by query_id, id) where rank <= 10"
    ),
    "field_variants": (
        "select id, 'title' field, 'english' analysis, title as value from catalog "
        "union all select id, 'title.keyword', 'exact', title from catalog "
        "union all select id, 'title.raw', 'standard', title from catalog "
        "union all select id, 'title.autocomplete', 'prefix', title from catalog "
        "union all select id, 'tagline', 'english', tagline from catalog "
        "union all select id, 'overview', 'english', overview from catalog "
        "union all select id, 'keywords', 'exact', unnest(keywords) from catalog "
        "union all select id, 'keywords.text', 'english', unnest(keywords) from catalog "
        "union all select id, 'cast.name', 'standard', unnest(cast_names) from catalog "
        "union all select id, 'cast.name.keyword', 'exact', unnest(cast_names) from catalog"
    ),
    "cast_positions": "select id, pos, term from toks where field = 'cast.name'",
    "build_postings": "select id, field, term, tf, dl, coalesce(positions, []) positions from post",
    "vocab_stats": "select * from voc",
    "field_stats": "select * from st",
    "bm25_match": (
        f"select qt.query_id, p.field, p.id, sum(2.2 * {idf('st.n_docs', 'v.df')} * "
        f"{sat('p.tf', 'p.dl', 'st.avg_len')}) score from qt "
        f"join post p on p.term = qt.term and p.field in {_TERM_FIELDS} "
        "join voc v on v.field = p.field and v.term = p.term join st on st.field = p.field group by all"
    ),
    "best_fields": "select * from best",
    "fuzzy_expand": "select * from fx",
    "cross_fields": "select * from cross_f",
    "term_match": "select * from term_m",
    "phrase_match": "select * from phrase",
    "phrase_slop": "select * from sloppy",
    "bool_should": "select * from should",
    "signal_scores": (
        "select id, 0.8 * log10(1 + coalesce(popularity, 1.0)) popularity, "
        "0.4 * log10(2 + coalesce(vote_count, 1)) vote_count, "
        f"0.1 * coalesce(vote_average, 5.0) vote_average, {KEYWORD} keyword_sum, {BROWSE} browse_sum from docs"
    ),
    "date_decay": (
        f"select id, release_date, {_decay('release_dt', 3650)} keyword_decay, "
        f"{_decay('release_dt', 730)} browse_decay from docs"
    ),
    "browse": (
        f"select row_number() over (order by round({BROWSE}, 6) desc, id) rank, id, "
        f"round({BROWSE}, 6) score from docs qualify rank <= 24"
    ),
    "search": (
        "select k.query_id, k.rank, k.id, k.score, d.title, d.genres, d.vote_average, d.release_date, "
        "d.director from kept k join docs d using (id) "
        "where rank > (page - 1) * page_size and rank <= page * page_size"
    ),
    "search_page": (
        "select query_id, rank, id, score from kept "
        "where rank > (page - 1) * page_size and rank <= page * page_size"
    ),
    "search_cumulative": "select query_id, rank, id, score from kept where rank <= page * page_size",
    "search_totals": (
        "select q.query_id, coalesce(n, 0) total, least(q.page * q.page_size, coalesce(n, 0)) "
        "< coalesce(n, 0) has_more from q left join "
        "(select query_id, count(*) n from kept group by query_id) using (query_id)"
    ),
    "similar_docs": (
        "select query_id, anchor, rank, s.id, score, title, genres, vote_average, release_date "
        'from areq join sim s using (anchor) join catalog c on c.id = s.id where rank <= "limit"'
    ),
    "filter_genres_any": (
        f"select m.query_id, m.id from matched m join t using (query_id) join q using (query_id) where {_GENRE_OK}"
    ),
    "filter_rating_range": (
        f"select m.query_id, m.id from matched m join t using (query_id) join q using (query_id) where {_RATING_OK}"
    ),
    "post_filter": (
        f"select m.query_id, count(*) matched, count(*) filter ({_GENRE_OK} and {_RATING_OK}) kept "
        "from matched m join t using (query_id) join q using (query_id) group by all"
    ),
    "facet_genres": (
        "select query_id, genre, count(*) doc_count from "
        "(select distinct query_id, id, unnest(doc_genres) genre from matched) group by query_id, genre "
        "qualify row_number() over (partition by query_id order by count(*) desc, genre) <= 30"
    ),
    "genres_overview": (
        "select genre as key, count(*) doc_count from (select distinct id, unnest(genres) genre from catalog) "
        "group by all order by doc_count desc, key limit 50"
    ),
    "lookup_by_id": (
        "select s.query_id, s.anchor id, c.id is not null found, c.title, c.director "
        "from sreq s left join catalog c on c.id = s.anchor"
    ),
    "source_excludes": "select id, title, overview from catalog",
    "normalize_requests": "select query_id, query, genres, rating_min, rating_max, page, page_size from q",
    "normalize_limits": 'select query_id, "limit" from sreq',
    "display_columns": (
        "select id, year(release_dt) as year, round(vote_average / 2) stars, round(vote_average, 1) rating, "
        "case when runtime >= 60 then (runtime // 60) || 'h ' || (runtime % 60) || 'm' else runtime || 'm' end runtime_text, "
        "upper(original_language) as language, genres[1:2] card_genres, keywords[1:10] shown_keywords, "
        "left(cast_names[1], 1) cast_initial, format('{:,}', vote_count) votes_text, "
        "'images/w342/' || id || '.jpg' card_image from docs"
    ),
    "parse_release_date": "select id, release_date, release_dt from docs",
    "id_export_scan": "select * from export",
    "latest_snapshot": "select id, popularity * 2 popularity, date '2001-12-29' dt from export",
    "top_popular_ids": (
        "select id, popularity from export where popularity > 0 order by popularity desc, id limit 100000"
    ),
    "detail_scan": (
        "select id, title, case when not malformed then len(genres) end n_genres, 12 n_cast, "
        "case when id % 7 = 0 then 1 else 3 end n_crew, case when error then 34 end status_code, malformed from det"
    ),
    "normalize_detail": (
        "select id, title, overview, release_date, coalesce(vote_average, 0) vote_average, "
        "coalesce(vote_count, 0) vote_count, coalesce(popularity, 0) popularity, genres, "
        "coalesce(runtime, 0) runtime, 0 budget, 0 revenue, '' poster_path, original_language, tagline, "
        "keywords, members[1:10] cast_names, coalesce(director, '') director from usable"
    ),
    "array_pluck": "select id, genres, keywords from usable",
    "array_first_k": (
        "select id, k as position, members[k + 1] as name, case when k % 3 <> 0 then 'role ' || k else '' end as character, "
        "k as order_ from usable, range(10) r(k)"
    ),
    "first_match": "select id, coalesce(director, '') director from usable",
    "reject_error_docs": (
        "select id, case when malformed then 'malformed' else 'error document' end reason, "
        "case when error then 34 end status_code from det where error or malformed"
    ),
    "ids_join_detail": (
        "select e.id, u.id is not null loaded, u.title from export e left join usable u on u.id = e.id "
        "where e.popularity > 0"
    ),
    "catalog_refresh": (
        "select u.id, u.title, coalesce(u.popularity, 0) popularity, coalesce(u.director, '') director "
        "from usable u join export e on e.id = u.id where e.popularity > 0"
    ),
    "load_tallies": (
        "select wanted, loaded, wanted - loaded skipped from "
        "(select count(*) wanted from export where popularity > 0), "
        "(select count(*) loaded from usable u join export e on e.id = u.id where e.popularity > 0)"
    ),
    "upsert_by_id": (
        "select id, title, director from delta2 union all "
        "select id, title, director from catalog where id not in (select id from delta2)"
    ),
    "append_generated_id": (
        "select concat('generated_', epoch_ms(date_trunc('hour', ts)), '_', event_id) id, event_id from events "
        "union all select concat('generated_0_', event_id + 1000000000), event_id + 1000000000 from events"
    ),
    "bulk_pairs_sink": (
        "select '{\"index\":{\"_index\":\"catalog\",\"_id\":\"' || id || '\"}}' as value from catalog "
        "union all select cast(to_json({'title': title, 'genres': genres, 'vote_count': vote_count}) as varchar) from catalog"
    ),
    "bulk_auto_ids": (
        "select '{\"index\":{}}' as value from events union all select cast(to_json("
        "{'event_id': event_id, 'user_id': user_id, 'event_type': event_type}) as varchar) from events"
    ),
    "bulk_pairs_scan": "select id, title, overview, genres, vote_count, popularity from catalog",
    "bulk_outcome": (
        "select count(*) as items, count(*) filter (event_type <> 'error') indexed, "
        "count(*) filter (event_type <> 'error') without_error, "
        "count(*) filter (event_type = 'error') failed from events"
    ),
    "table_count": (
        "select 'catalog' as name, count(*) as rows from documents union all select 'events', count(*) from events"
    ),
    "log_append": "select *, cast(ts as date) dt from events union all select *, cast(ts as date) from events",
    "log_postings": _LOG_TERMS,
    "stream_log_append": "select *, cast(ts as date) dt from events",
    "stream_dedupe": "select *, cast(ts as date) dt from events",
    "stream_upsert": (
        "select id, title, director from delta2 union all "
        "select id, title, director from catalog where id not in (select id from delta2)"
    ),
}
FINAL["array_first_k"] = FINAL["array_first_k"].replace("k as order_", 'k as "order"')

_CAST = {
    "i": "cast({c} as bigint)",
    "s": "cast({c} as varchar)",
    "f": "round(cast({c} as double), 6)",
    "b": "cast({c} as boolean)",
    "l": "array_to_string({c}, ',')",
    "t": "strftime({c}, '%Y-%m-%dT%H:%M:%S.%gZ')",
}


def _needed(sql: str) -> list[str]:
    """Expressions that a select refers to, directly or not, in their order."""
    import re

    todo, seen = [sql], set()
    while todo:
        for word in set(re.findall(r"\b[a-z]\w*\b", todo.pop())):
            if word in CTE and word not in seen:
                seen.add(word)
                todo.append(CTE[word])
    return [c for c in CTE if c in seen]


def build(name: str) -> str:
    body = FINAL[name]
    out = ", ".join(
        _CAST[kind].format(c=f'"{col}"') + f' as "{col}"' for col, kind in columns(name)
    )
    ctes = ",\n".join(f"{c} as ({CTE[c].strip()})" for c in _needed(body))
    return (f"with {ctes}\n" if ctes else "") + f"select {out} from ({body}) final"


def oracle_sql() -> dict[str, str]:
    return {name: build(name) for name in SPEC}
