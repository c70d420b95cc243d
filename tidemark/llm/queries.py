"""The registered queries of the training-data operators, each over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import decontaminate
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.html_text import extract_text
from tidemark.llm.line_dedup import dedup_lines
from tidemark.llm.mixing import mix_sources
from tidemark.llm.nearest import nearest
from tidemark.llm.ppm import score_documents
from tidemark.llm.simhash import near_dedup
from tidemark.llm.spelling import spelling_variants
from tidemark.llm.token_counts import token_counts
from tidemark.llm.toxicity import score_toxicity, train_toxicity
from tidemark.llm.warc import archive_round_trip
from tidemark.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_toxicity(docs, table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("hit_runs")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_line_dedup, op2_html_text, op3_exact_dedup, op4_token_counts, op5_mix_sources, op6_toxicity, op7_warc, op8_decontaminate, op9_simhash, op10_ppm_scores, op11_nearest, op12_spelling, op13_whitening, pipeline)
}

_LINES = """lines as (
  select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as a from documents),
keyed as (
  select doc_id, r, unnest(a) as line, generate_subscripts(a, 1) as pos from lines),
keys as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from keyed),
often as (
  select k from keys where length(k) >= 1 group by k having count(distinct doc_id) >= 10)"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": f"""with {_LINES}
select doc_id, count(*) as n_lines, count(*) filter (where o.k is not null) as n_dropped,
       sha256(coalesce(string_agg(case when o.k is null then line end, chr(10) order by pos) filter (where o.k is null), '')) as kept_sha256
from keys left join often o using (k) group by r, doc_id""",
    "op3_exact_dedup": """with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as body from documents)
select doc_id, min(doc_id) over (partition by body) as keep_id, count(*) over (partition by body) as group_size,
       doc_id = min(doc_id) over (partition by body) as kept, sha256(body) as text_sha256 from t""",
    "op7_warc": """with p as (
  select page_id, coalesce(html, '') as h from pages),
q as (
  select page_id, octet_length(encode(h)) as payload_bytes, sha256(h) as payload_digest, min(page_id) over (partition by h) as owner from p)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> owner then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> owner then owner end as refers_to from q""",
    "op11_nearest": """with v as (
  select vec_id, embedding::double[] as e from embeddings
  where vec_id is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
d as (
  select q.vec_id as query_id, c.vec_id as vec_id, sqrt(list_reduce(list_transform(list_zip(c.e, q.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, (row_number() over (partition by query_id order by score, vec_id))::int as rank, vec_id, score from d qualify rank <= 10""",
    "op12_spelling": """with recursive crc(b, c) as (
  select b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) from (select unnest(range(256)) as b)),
steps as (
  select list(c order by b) as t from crc),
runs as (
  select doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as r from documents),
counted as (
  select doc_id, r, count(*) as k from runs where length(r) >= 6 group by 1, 2),
hashed as (
  select r, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(coalesce(doc_id::varchar, '') || ':' || r)), 2),
           lambda i: ('0x' || substr(hex(encode(coalesce(doc_id::varchar, '') || ':' || r)), i, 2))::bigint)),
         lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) as h from counted, steps),
words as (
  select case when h % 199 = 0 then substr(r, 1, h % length(r)) || substr(r, 2 + h % length(r)) else r end as w, sum(k)::bigint as n
  from hashed group by 1 having length(w) >= 6 and sum(k) >= 5),
holes as (
  select w, n, i, substr(w, 1, i - 1) as a, substr(w, i + 1) as b from (select w, n, unnest(range(1, length(w) + 1)) as i from words)),
near as (
  select x.w, y.w as o, y.n as m from holes x join holes y on x.i = y.i and x.a = y.a and x.b = y.b and x.w <> y.w
  union select x.w, y.w, y.n from holes x join words y on y.w = x.a || x.b
  union select y.w, x.w, x.n from holes x join words y on y.w = x.a || x.b),
best as (
  select w, count(*) as n_near, max(m) as m, arg_min(o, struct_pack(m := -m, o := encode(o))) as o from near group by w),
formed as (
  select words.w, n, coalesce(n_near, 0) as n_near, case when m >= 5 * n then o end as form, case when m >= 5 * n then m end as form_n from words left join best using (w)),
chains(w, root) as (
  select w, w from formed where form is null
  union all select f.w, c.root from formed f join chains c on f.form = c.w)
select w as word, n, n_near, form, form_n, root from formed join chains using (w)""",
}
