"""The registered queries of the subpackage and their SQL checks."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spool
from . import (
    bm25,
    codes,
    langid,
    mixing,
    neardup,
    packing,
    pieces,
    spotsigs,
    tokenfiles,
    toolcalls,
    triecounts,
    urls,
    variants,
)
from .common import table

#: fixed values: the rules that the URL query is asked to apply (verdict, host, path)
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: even out the sources until the mixture has this share of the highest possible entropy
MIX = mixing.MixTarget(entropy_share=0.995)
WORD_TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"
SAMPLES = 2
TOP = 10


def _held_out(doc_id: str) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = langid.fit(docs.filter(~_held_out("doc_id")))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", _held_out("doc_id").alias("held_out"), "language.*"
    )


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return tokenfiles.token_files(docs, public_tokenizers.path(WORD_TOKENIZER))


def op3_bm25_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    queries = docs.filter("doc_id % 50 = 0").select(F.col("doc_id").alias("qid"), "text")
    return bm25.top_k(docs, queries, TOP)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return triecounts.token_counts(docs, public_tokenizers.path(PIECE_MODEL))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages", "page_id", "url"), URL_RULES, carry=("page_id",))


def op6_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_neighbours(table(spark, sf_dir, "documents", "doc_id", "text"))


def op7_piece_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pieces.sample_encodings(docs, public_tokenizers.path(PIECE_MODEL), samples=SAMPLES)


def op8_temperature_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "doc_id", "source", mixing.token_count(F.col("text")).alias("n_tokens")
    )
    return mixing.mixture(docs, MIX)


def op9_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    calls, results = toolcalls.calls_of(turns)
    return toolcalls.link_calls(calls, results, toolcalls.CHAT_TOOLS)


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"), words=2)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return variants.variants(spool(variants.word_counts(docs)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
    return coded.withColumn("codebooks_sha256", F.lit(books.sha256()))


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return packing.pack(docs, public_tokenizers.path(BYTE_TOKENIZER)).select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset",
    )


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_token_files": op2_token_files,
    "op3_bm25_top_k": op3_bm25_top_k,
    "op4_token_counts": op4_token_counts,
    "op5_url_filter": op5_url_filter,
    "op6_spotsigs": op6_spotsigs,
    "op7_piece_samples": op7_piece_samples,
    "op8_temperature_mix": op8_temperature_mix,
    "op9_tool_calls": op9_tool_calls,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_vector_codes": op12_vector_codes,
    "op13_harmonic_packing": op13_harmonic_packing,
}

_OP5 = """
with parts as (
  select page_id,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path
  from pages),
rules(verdict, rhost, rpath) as (values
  ('block', 'net', '/'), ('allow', 'example.net', '/en/'),
  ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fitting as (
  select page_id, host, path, rhost || rpath as rule, verdict,
    row_number() over (partition by page_id, host, path order by length(rhost) desc, length(rpath) desc) as nr
  from parts left join rules
    on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from fitting where nr = 1
"""

_OP8 = """
with recursive
sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as n_tokens
  from documents),
sources as (select source, sum(n_tokens)::bigint as tokens from sized group by source),
total as (select sum(tokens)::double as total from sources),
shared as (select source, tokens, tokens / total as share from sources, total),
shares as (select list(share) filter (tokens > 0) as p, count(*) filter (tokens > 0) as n from shared),
search(step, lo, hi, p, n) as (
  select 0, 0::double, 1::double, p, n from shares
  union all
  select step + 1,
    case when ok then (lo + hi) / 2 else lo end, case when ok then hi else (lo + hi) / 2 end, p, n
  from (
    select *, ln(z) - list_sum(list_transform(w, lambda x: x * ln(x))) / z >= 0.995 * ln(n) as ok
    from (select *, list_sum(w) as z
      from (select *, list_transform(p, lambda x: pow(x, (lo + hi) / 2)) as w from search))) s
  where step < 45),
exponent as (select lo as x from search where step = 45),
raised as (
  select source, tokens, case when tokens > 0 then pow(share, x) else 0 end as raised from shared, exponent),
weighted as (select *, round(raised / (sum(raised) over ()), 9) as weight from raised),
budget as (select max(ceil(tokens / weight)) as budget from weighted where weight > 0),
plan as (
  select source, tokens, greatest(round(weight * budget)::bigint, tokens) as quota from weighted, budget),
uses as (
  select d.doc_id, d.source, n_tokens, e.epoch, quota, tokens
  from sized d join plan p on d.source is not distinct from p.source,
    unnest(generate_series(1, case when tokens > 0 then quota // tokens + 1 else 1 end)) e(epoch)),
keyed as (
  select *, ('0x' || substr(key, 1, 2))::int as block
  from (select *, md5('7:' || epoch || ':' || coalesce(doc_id::varchar, '')) as key from uses)),
placed as (select *, md5('7:block:' || epoch || ':' || block) as block_key from keyed),
running as (
  select *, sum(n_tokens) over (partition by source, epoch order by block_key, key) as upto
  from placed)
select doc_id, source, n_tokens, epoch, block, block_key, key
from running
where tokens = 0 or epoch <= quota // tokens or (quota % tokens > 0 and upto <= quota % tokens)
"""

_OP10 = """
with recursive
words as (
  select doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as w from documents),
runs as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s
  from words),
sizes as (select doc_id, len(s)::bigint as n from runs),
flat as (select doc_id, unnest(s) as sh from runs),
shared as (
  select a.doc_id as x, b.doc_id as y, count(*) as inter
  from flat a join flat b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
links as (
  select x, y from shared join sizes p on p.doc_id = x join sizes q on q.doc_id = y
  where 100 * inter >= 80 * (p.n + q.n - inter)),
both_ways as (select x, y from links union all select y, x from links),
reach(a, b) as (
  select doc_id, doc_id from sizes
  union
  select a, y from reach join both_ways on b = x)
select s.doc_id, any_value(n) as n_shingles, min(b) as component_id, s.doc_id = min(b) as kept
from sizes s join reach on a = s.doc_id group by s.doc_id
"""


def _op12() -> str:
    """Six rounds and a last assignment, as one chain of common table expressions."""
    steps = ["""
with kept as (
  select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
  where embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
flat as (
  select vec_id, (i - 1) // (len(v) // 8) as p, (i - 1) % (len(v) // 8) as i, v[i] as x
  from (select vec_id, v, unnest(range(1, len(v) + 1)) as i from kept)),
starts as (select vec_id, row_number() over (order by vec_id) - 1 as e from kept order by vec_id limit 16),
c0 as (select p, e, i, x as c from flat join starts using (vec_id)),"""]
    for r in range(7):
        steps.append(f"""
d{r} as (
  select vec_id, p, e, sum((x - c) * (x - c))::bigint as d from flat join c{r} using (p, i) group by all),
a{r} as (
  select vec_id, p, min(d) as d, arg_min(e, d * 16 + e) as e from d{r} group by all),""")
        if r < 6:
            steps.append(f"""
s{r} as (
  select p, e, i, sum(x)::bigint as s, count(*) as n from a{r} join flat using (vec_id, p) group by all),
c{r + 1} as (
  select p, e, i, case when n is null then c else (s - ((s % n) + n) % n) // n end as c
  from c{r} left join s{r} using (p, e, i)),""")
    steps.append("""
books as (select sha256(string_agg(c::varchar, ',' order by p, e, i)) as codebooks_sha256 from c6),
coded as (
  select vec_id, string_agg(printf('%02x', e::int), '' order by p) as code, sum(d)::bigint as error
  from a6 group by vec_id),
labelled as (
  select label, sum(error)::bigint as label_error from coded join kept using (vec_id) group by label)
select c.vec_id, code, error, label_error, codebooks_sha256
from coded c join kept k using (vec_id) join labelled l on l.label is not distinct from k.label, books
""")
    return "".join(steps)


ORACLE = {
    "op5_url_filter": _OP5,
    "op8_temperature_mix": _OP8,
    "op10_near_duplicates": _OP10,
    "op12_vector_codes": _op12(),
}
