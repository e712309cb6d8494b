"""The numbered corpus queries, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserax.llm.common import table

URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.url_filter import filter_urls

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.toxicity import toxicity_held_out

    return toxicity_held_out(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.substring_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.sharding import shard_by_bytes

    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.language_id import identify_held_out

    return identify_held_out(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.tokens import tokenize

    found = tokenize(table(spark, sf_dir, "documents"), byte_bpe())
    return found.select("doc_id", "start", "n_tokens", "ids_crc32")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.mixing import mix

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.topk import top_k

    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.quality import judged

    return judged(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.spelling import document_variants

    return document_variants(table(spark, sf_dir, "documents"))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tesserax.llm.conversation import audited

    return audited(table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


OP1_SQL = r"""
with p as (
  select page_id,
    case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as u
  from pages),
q as (
  select page_id, translate(regexp_extract(u, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(u, '^[^/?#]*([^?#]*)', 1) as path
  from p),
rules(verdict, h, s) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
  ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
fits as (
  select q.page_id, q.host, q.path, max_by(h || s, length(h || s)) as rule, max_by(verdict, length(h || s)) as v
  from q join rules on (q.host = h or q.host like '%.' || h) and starts_with(q.path, s)
  group by all)
select q.page_id, q.host, q.path, f.rule, coalesce(f.v, 'allow') as verdict
from q left join fits f on q.page_id = f.page_id and q.host = f.host and q.path = f.path
"""

OP9_SQL = r"""
with d as (
  select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    case when doc_id is not null and count(*) over (partition by doc_id) = 1 then doc_id::varchar
      else concat(coalesce(doc_id::varchar, 'null'), ':', md5(coalesce('t' || text, 'n')), ':', md5(coalesce('t' || source, 'n')), ':', row_number() over (partition by doc_id, text, source)) end as draw
  from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int] as weight, 3 * source_size as cap from s),
o as (
  select *, (sum(source_size) over ()) - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as lft
  from w),
c as (select *, rest * weight > cap * lft as cut from o),
f as (select rest as r1, lft as l1 from c where not cut order by cap / weight, source nulls last limit 1),
t as (
  select source, source_size, case when cut then cap::double else r1::double * weight::double / l1::double end as target from c, f),
j as (
  select d.doc_id, d.draw, d.size, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate
  from d join t on d.source is not distinct from t.source),
h as (select *, ('0x' || substr(md5('17:' || draw), 1, 13))::bigint::double / 4503599627370496.0::double as u from j)
select doc_id, size, source_size, target,
  cast((floor(rate) + (u < rate - floor(rate))::int) * size as bigint) as taken
from h
"""

OP10_SQL = r"""
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as w from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
x as (select vec_id, unnest(w) as c, generate_subscripts(w, 1) as i from v),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, sum(q.c * c.c)::bigint as score
  from x q join x c on q.i = c.i and q.vec_id % 100 = 0 and c.vec_id <> q.vec_id group by all),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select query_id, rank, vec_id, score from r where rank <= 10
"""


OP11_SQL = r"""
with t as (
  select doc_id, coalesce(text, '') as x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l, row_number() over () as k
  from documents),
g as (select k, generate_subscripts(w[3:], 1) as i, unnest(list_zip(w[:-3], w[2:-2], w[3:])) as s from t where len(w) >= 3),
r as (select k, i from g qualify count(*) over (partition by k, s) > 1),
c as (select k, count(distinct i + j) as n from r, range(3) as o(j) group by k),
m as (
  select doc_id, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars,
    (length(x) - length(regexp_replace(x, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(l) as n_lines,
    (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words,
    len(list_filter(w, lambda y: not regexp_matches(y, '\p{L}'))) as n_letterless,
    length(x) - length(regexp_replace(x, '[A-ZÀ-ÖØ-Þ]', '', 'g')) as n_capitals,
    len(list_filter(l, lambda y: regexp_matches(y, '^ *[-*•]'))) as n_bullet_lines,
    len(list_filter(l, lambda y: regexp_matches(y, '(\.\.\.|…) *$'))) as n_ellipsis_lines
  from t left join c using (k)),
b as (
  select *, (n_words < 50)::bigint + 2 * (100 * n_repeat_words > 50 * n_words)::bigint + 4 * (10 * n_symbols > n_words)::bigint
    + 8 * (5 * n_dup_lines > 2 * n_lines)::bigint + 16 * (word_chars < 2 * n_words)::bigint + 32 * (word_chars > 20 * n_words)::bigint
    + 64 * (10 * n_letterless > 4 * n_words)::bigint + 128 * (2 * n_capitals > word_chars)::bigint
    + 256 * (10 * n_bullet_lines > 9 * n_lines)::bigint + 512 * (10 * n_ellipsis_lines > 3 * n_lines)::bigint as failed
  from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed & 3 > 0 as base_failed, failed = 0 as kept, failed from b
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filter": OP1_SQL, "op9_mixing": OP9_SQL, "op10_topk": OP10_SQL, "op11_quality": OP11_SQL}
