"""The registered queries of this subpackage: production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from findrift.llm import bpe, collocations, jaccard, kneser_ney, packing, pivots, repair, rules, sharding, token_files, toxicity, warc, wrappers


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the ids of every text and of the bytes decoded from them."""
    return bpe.digests(
        _table(spark, sf, "documents"),
        public_tokenizers.path("byte_bpe_multi_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )


def op2_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The ledger of every document and the verdicts of the base and production policies."""
    book = rules.ledger(_table(spark, sf, "documents"), ["doc_id"])
    return book.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        rules.fails(rules.BASE).alias("base_failed"),
        (~rules.fails(rules.PRODUCTION)).alias("kept"),
        "failed",
    )


def op3_warc(spark: SparkSession, sf: str) -> DataFrame:
    """The records read back from an archive of all pages."""
    archive = warc.write(_table(spark, sf, "pages"))
    return warc.read(archive, payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op4_packing(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.sequences(
        _table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    ).drop("cost")


def op5_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by a model of the labels that are not held out."""
    docs, labels = _table(spark, sf, "documents"), _table(spark, sf, "labels")
    held = kneser_ney.remainder("doc_id", 4) == 2
    model = toxicity.train(docs, labels.where(~held))
    return toxicity.score(docs, model).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")


def op6_wrappers(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of all pages."""
    return wrappers.extract(_table(spark, sf, "pages"))


def op7_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    return sharding.assign(_table(spark, sf, "documents"))


def op8_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of all documents by a model of those not held out."""
    docs = _table(spark, sf, "documents")
    held = kneser_ney.remainder("doc_id", 7) == 2
    model = kneser_ney.train(docs.where(~held))
    return kneser_ney.score(docs, model).select(
        "doc_id",
        held.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("bigint").alias("train_tokens"),
        "base_score",
        "score",
        "perplexity",
    )


def op9_pivot_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links and components of all vectors."""
    return pivots.link(_table(spark, sf, "embeddings"))


def op10_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return jaccard.classes(_table(spark, sf, "documents"))


def op11_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The best 2000 phrases of two and three words of each language."""
    return collocations.mine(_table(spark, sf, "documents"))


def op12_token_files(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of the ids of all documents, read back from the files that hold them."""
    corpus = token_files.write(_table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return token_files.read(spark, corpus)


def op13_repair(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest repairs of all conversations after damage."""
    return repair.audit_damaged(_table(spark, sf, "conversations"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_byte_bpe, op2_quality_rules, op3_warc, op4_packing, op5_toxicity, op6_wrappers, op7_sharding, op8_kneser_ney,
        op9_pivot_links, op10_jaccard_join, op11_collocations, op12_token_files, op13_repair,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


# Words are runs outside space and 0x09-0x0D; the first lines unfold them.
_WORDS = r"""
t as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
w as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') as ws from t)
"""

_OP2 = rf"""
with {_WORDS},
g as (select r, unnest(range(1, len(ws) - 3)) as i, ws from w),
h as (select r, i, array_to_string(ws[i:i + 4], ' ') as g from g),
k as (select r, i, count(*) over (partition by r, g) as n from h),
p as (select r, i + unnest([0, 1, 2, 3, 4]) as p from k where n > 1),
c as (select r, count(distinct p) as n_repeat_words from p group by r),
m as (
  select r, doc_id, len(ws) as n_words, length(array_to_string(ws, '')) as word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as n_upper,
    length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as n_letters,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) as ls
  from w),
f as (
  select doc_id, n_words, word_chars, n_symbols, len(ls) - len(list_distinct(ls)) as n_dup_lines,
    coalesce(n_repeat_words, 0) as n_repeat_words, n_upper, n_letters, len(ls) as n_lines
  from m left join c using (r)),
b as (
  select *, (case when n_words < 10 then 1 else 0 end)
    + (case when 100 * n_repeat_words > 20 * n_words then 2 else 0 end)
    + (case when 100 * n_symbols > 4 * word_chars then 4 else 0 end)
    + (case when 100 * n_dup_lines > 50 * n_lines then 8 else 0 end)
    + (case when 100 * n_upper > 50 * n_letters then 16 else 0 end)
    + (case when word_chars > 20 * n_words then 32 else 0 end)
    + (case when 100 * n_letters < 60 * word_chars then 64 else 0 end) as failed
  from f)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 <> 0 as base_failed,
  failed & 63 = 0 as kept, failed
from b
"""

_OP3 = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha1(encode(coalesce(html, ''))) as d
  from pages),
t as (select d, n, max(page_id) as top from p where n >= 1000 group by d, n)
select page_id, n as payload_bytes, d as payload_digest,
  case when top is not null and (page_id is null or page_id < top) then 'revisit' else 'response' end as record_type,
  case when page_id is null or page_id < top then top end as refers_to
from p left join t using (d, n)
"""

_OP9 = """
with recursive
v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as x from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
e as (
  select a.vec_id as a, b.vec_id as b from v a join v b
  on a.label = b.label and len(a.x) = len(b.x) and a.vec_id <> b.vec_id
  where list_cosine_similarity(a.x, b.x) >= 0.93),
r(id, c) as (
  select vec_id, vec_id from embeddings
  union
  select e.a, r.c from r join e on e.b = r.id where r.c < e.a),
n as (select a, count(*) as n from e group by a),
c as (select id, min(c) as c from r group by id)
select vec_id, coalesce(n, 0) as n_links, c as component_id, vec_id = c as kept
from embeddings join c on c.id = vec_id left join n on n.a = vec_id
"""

_OP10 = rf"""
with recursive
t as (
  select doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \x09-\x0D]+'), lambda x: x <> '') as ws
  from documents),
u as (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from t where len(ws) > 0),
s as (select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g from u),
n as (select doc_id, count(*) as n from s group by doc_id),
o as (
  select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b using (g)
  where a.doc_id <> b.doc_id group by all),
e as (
  select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b
  where 100 * o >= 80 * (x.n + y.n - o)),
r(id, c) as (
  select doc_id, doc_id from documents
  union
  select e.a, r.c from r join e on e.b = r.id where r.c < e.a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, c.c as component_id
from documents d left join n using (doc_id) join (select id, min(c) as c from r group by id) c on c.id = d.doc_id
"""


_OP11 = r"""
with
p as (
  select lang, row_number() over () as r, unnest(string_split_regex(t, '[.,;:!?\n-\r]')) as t
  from (select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents)),
w as (select lang, list_filter(string_split_regex(t, '[ \t]+'), lambda x: x <> '') as w from p),
u as (select lang, w, unnest(range(1, len(w) + 1)) as i from w),
s as (
  select lang, w[i] as w1, w[i + 1] as w2, w[i + 2] as w3, len(w) - i + 1 as m from u),
g as (
  select lang, 1 as k, w1 as g, count(*) as f from s group by all
  union all select lang, 2, w1 || ' ' || w2, count(*) from s where m > 1 group by all
  union all select lang, 3, w1 || ' ' || w2 || ' ' || w3, count(*) from s where m > 2 group by all),
n as (select lang, sum(f)::bigint as n from g where k = 1 group by lang),
c as (select lang, k, g, f as a, string_split(g, ' ') as w from g where k > 1 and f >= 10),
z as (
  select lang, g, a, 1 as cut, w[1] as x, array_to_string(w[2:], ' ') as y from c
  union all select lang, g, a, 2, w[1] || ' ' || w[2], w[3] from c where k = 3),
t as (
  select z.lang, z.g, z.a, cut, l.f as l, r.f as r, (1000000::hugeint * z.a * z.a) // (l.f::hugeint * r.f) as score
  from z join g l on l.lang = z.lang and l.g = z.x join g r on r.lang = z.lang and r.g = z.y),
b as (select * from t qualify row_number() over (partition by lang, g order by score, cut) = 1),
h as (
  select lang, h, max(a) as a from (
    select lang, w[1] || ' ' || w[2] as h, a from c where k = 3
    union all select lang, w[2] || ' ' || w[3], a from c where k = 3) group by all),
q as (
  select b.lang, b.g as phrase, b.a, l, r, score from b left join h on h.lang = b.lang and h.h = b.g
  where h.a is null or 100 * h.a < 50 * b.a),
o as (select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from q)
select lang, rank, phrase, a, l, r, n, score::bigint as score from o join n using (lang) where rank <= 2000
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that have one; the others are tested against brute force."""
    return {
        "op2_quality_rules": _OP2,
        "op3_warc": _OP3,
        "op9_pivot_links": _OP9,
        "op10_jaccard_join": _OP10,
        "op11_collocations": _OP11,
    }
