"""The registered queries ``opN_<name>`` and, where SQL can express them,
their DuckDB oracles.  Each query selects the columns it needs from the whole
table and applies its operator."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (decontaminate, langid, lm, mixing, nndescent, orchard, prefix_trie, quality, sharding, simhash,
               urlfilter, warc, wavelet)
from .common import cut, prepare, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return fn(spark, sf_dir)

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[name] = run
        if oracle:
            ORACLES[name] = oracle
        return fn

    return deco


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_wavelet_tokens")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return wavelet.encode_corpus(docs, tokenizer_path(), end_id=1)


@query("op2_edit_decontaminate")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))


OP3_SQL = r"""
with d as (
 select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
  ('0x' || substr(md5('0|' || coalesce(doc_id::varchar, 'null') || '|' || md5(coalesce(text, ''))), 1, 13))::bigint
   / 4503599627370496.0 as toss
 from documents),
s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as rank
 from d group by source),
w as (select *, case rank % 3 when 0 then 5 when 1 then 2 else 1 end as weight from s),
o as (select *, row_number() over (order by source_size / weight, rank) as k from w),
p as (select *, coalesce(sum(2 * source_size) over (order by k rows between unbounded preceding and 1 preceding), 0) as capped,
  sum(weight) over (order by k rows between current row and unbounded following) as free,
  sum(source_size) over () as total from o),
c as (select *, 2 * source_size * free <= weight * (1.5 * total - capped) as above from p),
f as (select coalesce(sum(2 * source_size) filter (above), 0) as capped, sum(weight) filter (not above) as free from c),
t as (select c.source, c.source_size, case when above then (2 * source_size)::double
  else weight * ((1.5 * total - f.capped)::double) / f.free end as target from c, f),
r as (select d.doc_id, d.size, d.toss, t.source_size, t.target,
  case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate
 from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
 ((floor(rate) + case when toss < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken from r
"""


@query("op3_mix_sources", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", "taken")


@query("op4_deleted_interpolation")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).cast("binary"))
    # of the training documents every twentieth is deleted: it teaches the weights
    fold = F.when(crc % 10 == 0, lm.TEST).when(crc % 20 == 1, lm.DELETED).otherwise(lm.KEPT)
    return lm.score_corpus(table(spark, sf_dir, "documents").select("doc_id", fold.alias("fold"), "text"))


@query("op5_rendezvous_shards")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.number(sharding.place(table(spark, sf_dir, "documents")))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


URL_RULES = (
    urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "example.org", "/es/"),
    urlfilter.Rule("block", "example.org", "/en/1"), urlfilter.Rule("allow", "com", "/fr/"),
    urlfilter.Rule("block", "com", "/de/"))

OP6_SQL = r"""
with u as (select page_id,
 translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
 coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path from pages),
r as (select * from (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
 ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) as v(verdict, rhost, rpath)),
m as (select page_id, u.host, u.path, max_by(rhost || rpath, length(rhost || rpath)) as rule,
  max_by(verdict, length(rhost || rpath)) as verdict
 from u join r on ends_with('.' || u.host, '.' || rhost) and starts_with(u.path, rpath) group by all)
select u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') as verdict
from u left join m on u.page_id = m.page_id and u.host = m.host and u.path = m.path
"""


@query("op6_url_filter", OP6_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES).drop("url")


@query("op7_simhash_components")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


OP8_SQL = r"""
with p as (select row_number() over (order by page_id) as id, page_id, coalesce(html, '') as html from pages),
d as (select id, page_id, strlen(html)::bigint as payload_bytes, sha1(html) as hex from p),
f as (select hex, min_by(page_id, id) as first_page, min(id) as first_id from d group by hex),
b as (select d.*, first_page, first_id,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::int, 5))::bigint >> (15 - 5 * (i % 4))::int) & 31)::int, 1)), '') as payload_digest
 from d join f using (hex))
select page_id, payload_bytes, payload_digest, case when id = first_id then 'response' else 'revisit' end as record_type,
 case when id <> first_id then first_page end as refers_to from b
"""


@query("op8_warc_archive", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP9_SQL = r"""
with d as (select row_number() over () as id, doc_id, source, coalesce(text, '') as t,
  coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) as w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
 from documents),
g as (select id, unnest(range(1, len(w) - 3)) as i, w from d),
h as (select id, i, array_to_string(w[i:i + 4], ' ') as gram from g),
b as (select id, i from (select id, i, count(*) over (partition by id, gram) as n from h) x where n > 1),
c as (select id, sum(least(5, nxt - i)) as n from (select id, i,
  coalesce(lead(i) over (partition by id order by i), i + 5) as nxt from b) y group by id),
m as (select d.id, doc_id, source, len(w)::bigint as n_words,
  length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(c.n, 0)::bigint as n_repeat_words,
  length(regexp_replace(t, '[^A-Z]+', '', 'g'))::bigint as n_upper
 from d left join c on c.id = d.id),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  100 * n_symbols > 10 * n_words as symbols_failed, 100 * n_dup_lines > 10 * n_words as lines_failed,
  100 * n_upper > 50 * word_chars as upper_failed from m),
r as (select source, 'b' as rule, count(*) as n, sum(base_failed::int) as k from f group by all union all
 select source, 's', count(*), sum(symbols_failed::int) from f group by all union all
 select source, 'u', count(*), sum(upper_failed::int) from f group by all union all
 select source, 'l', count(*), sum(lines_failed::int) from f group by all),
p as (select rule, avg(k / n) as m, var_pop(k / n) as v from r group by rule),
q as (select r.source, max(case when p.v > 0 then (k + greatest(m * (1 - m) / v - 1, 0) * m)
   / (n + greatest(m * (1 - m) / v - 1, 0)) else (k + 1) / (n + 2) end) > 0.5 as rejected
 from r join p using (rule) group by r.source)
select f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.n_upper, f.base_failed,
 not (f.base_failed or f.symbols_failed or f.upper_failed or q.rejected) as kept
from f join q on f.source is not distinct from q.source
"""


@query("op9_host_quality", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    judged = quality.judge(cut(quality.measure(docs).drop("text")))
    return judged.select("doc_id", *quality.MEASURES, "base_failed", "kept")


@query("op10_language_spans")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4
    model = langid.fit(docs.where(fold != 2).select("text", "lang"))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (fold == 2).alias("held_out"), F.col("language.lang").alias("lang_pred"), "language.score",
                        "language.spans")


@query("op11_nn_descent")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.neighbour_graph(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")).table


OP12_SQL = r"""
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, z) as pos, z, words from (
  select conv_id, turn, md5(strlen(coalesce(role, ''))::varchar || ':' || coalesce(role, '') || coalesce(text, '')) as z,
   coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as words
  from conversations where conv_id is not null) x),
c as (select conv_id, conv_id - conv_id % 20 as base, count(*) as n, xor(list_reduce(
  list_prepend(4294967295, list_transform(range(1, length(conv_id::varchar) + 1), lambda i: ascii(substr(conv_id::varchar, i::int, 1))::bigint)),
  lambda r, b: list_reduce([xor(r, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)),
  4294967295) % 4 as h from t group by conv_id),
g as (select c.conv_id, c.h, c.base, least(c.h, coalesce(b.n, 0)) as taken from c left join c b on b.conv_id = c.base),
r as (select g.conv_id, taken + pos - h as k, z, words from g join t using (conv_id) where pos > h union all
 select g.conv_id, pos, z, words from g join t on t.conv_id = g.base where pos <= h),
s as (select g.conv_id, coalesce(list(z order by k) filter (z is not null), []) as zs,
  coalesce(list(words order by k) filter (z is not null), []) as ws from g left join r using (conv_id) group by g.conv_id),
q as (select zs, any_value(ws) as ws, count(*) as weight, min(conv_id) as seq,
  sha256(string_agg(conv_id::varchar, ',' order by conv_id)) as ends from s group by zs),
p as (select *, unnest(range(0, len(zs) + 1)) as depth from q),
n as (select zs[1:depth] as node, depth, min(seq) as conv_id, sum(weight)::bigint as n_convs,
  any_value(case when depth > 0 then ws[depth] else 0 end) as words from p group by 1, 2),
k as (select node[1:depth - 1] as node, depth - 1 as depth, count(*) as n_children from n where depth > 0 group by 1, 2),
m as (select n.*, coalesce(n_children, 0) as n_children from n left join k using (node, depth)),
u as (select node[1:a] as node, a as depth, sum((n_convs - 1) * words)::bigint as saved_tokens, count(*) filter (n_children = 0) as n_leaves
 from (select *, unnest(range(0, depth + 1)) as a from m) group by 1, 2)
select m.conv_id, m.depth, f.conv_id as parent_conv_id, m.n_convs, m.n_children, u.n_leaves, u.saved_tokens,
 coalesce(q.ends, sha256('')) as ends_sha256
from m join u using (node, depth) left join m f on m.depth = f.depth + 1 and m.node[1:m.depth - 1] = f.node left join q on q.zs = m.node
"""


@query("op12_prefix_trie", OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def _op13_round(k: int) -> str:
    """Assignment to the codebooks c<k> and the codebooks c<k+1> after it."""
    return f"""
a{k} as (select p.id, p.part, p.x, arg_min(entry, d * 64 + entry) as entry, min(d) as d from (
  select p.id, p.part, p.x, c.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::bigint as d
  from p join c{k} c on p.part = c.part) p group by all),
u{k} as (select part, entry, i, sum(x[i])::bigint as s, count(*) as n
 from (select part, entry, x, unnest(range(1, len(x) + 1)) as i from a{k}) group by all),
m{k} as (select part, entry, list((s - ((s % n) + n) % n) // n order by i) as x from u{k} group by all),
c{k + 1} as (select c.part, c.entry, coalesce(m.x, c.x) as x from c{k} c left join m{k} m using (part, entry))"""


OP13_SQL = f"""
with k as (select row_number() over (order by vec_id) as id, vec_id, label,
  list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
 from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select id, part, v[part * len(v) // 16 + 1:(part + 1) * len(v) // 16] as x from (select *, unnest(range(16)) as part from k)),
c0 as (select part, id - 1 as entry, x from p where id <= 64),{_op13_round(0)},{_op13_round(1)},
a2 as (select p.id, p.part, arg_min(entry, d * 64 + entry) as entry, min(d) as d from (
  select p.id, p.part, c.entry, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::bigint as d
  from p join c2 c on p.part = c.part) p group by all),
r as (select id, string_agg(lower(printf('%02x', entry)), '' order by part) as code, sum(d)::bigint as error from a2 group by id),
h as (select sha256(string_agg(array_to_string(x, ','), ',' order by part, entry)) as sha from c2)
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, sha as codebooks_sha256
from r join k using (id), h
"""


@query("op13_orchard_codes", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orchard.compress(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
