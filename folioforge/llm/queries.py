"""The queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from folioforge.llm import bpe, centroids, embed, exact, html_extract, langid, minhash, mixing, quality, rules, spelling, suffix, warc

VOCABULARY = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_table(spark, sf_dir, "pages"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.train(docs, PIECES))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_texts(_table(spark, sf_dir, "documents"), VOCABULARY, public_tokenizers.PATTERN, ids=False)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.archive_and_read(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(_table(spark, sf_dir, "documents"), kept=False)


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_groups(_table(spark, sf_dir, "documents"))


def op10_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embedding_links(_table(spark, sf_dir, "embeddings"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_vectors(_table(spark, sf_dir, "embeddings"))


def op13_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rules.apply_policy(rules.ledger(_table(spark, sf_dir, "documents")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failures")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": op1_html,
    "op2_language": op2_language,
    "op3_bpe": op3_bpe,
    "op4_quality": op4_quality,
    "op5_minhash": op5_minhash,
    "op6_warc": op6_warc,
    "op7_mix": op7_mix,
    "op8_suffix": op8_suffix,
    "op9_exact": op9_exact,
    "op10_embeddings": op10_embeddings,
    "op11_spelling": op11_spelling,
    "op12_centroids": op12_centroids,
    "op13_rules": op13_rules,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP5_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents
), g as (
  select distinct doc_id, array_to_string(ws[i : i + 4], ' ') as s from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) as i from w where len(ws) > 0)
), n as (
  select doc_id, count(*) as n from g group by doc_id
), f as (
  select doc_id, md5(string_agg(s, chr(10) order by s)) as f from g group by doc_id
), r as (
  select f, min(doc_id) as rep from f group by f
), q as (
  select g.doc_id, g.s from g join r on g.doc_id = r.rep
), l as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from q a join q b on a.s = b.s and a.doc_id < b.doc_id group by all
), e as (
  select a, b from l join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)
), e2 as (
  select a, b from e union all select b, a from e
), t as (
  select rep as node, rep as label from r
  union
  select e2.b, t.label from t join e2 on e2.a = t.node where t.label < e2.b
), c as (
  select node, min(label) as component_id from t group by node
)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(c.component_id, w.doc_id) as component_id, coalesce(c.component_id, w.doc_id) = w.doc_id as kept
from w left join n using (doc_id) left join f using (doc_id) left join r using (f) left join c on c.node = r.rep
"""

OP6_SQL = r"""
with p as (
  select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as payload_bytes, sha1(coalesce(html, '')) as h from pages
), g as (
  select html, min(page_id) as first_id from p group by html
), d as (
  select p.page_id, payload_bytes, first_id,
    list_aggregate(list_transform(range(0, 32), lambda i:
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + (
        (('0x' || h[1 + 10 * (i // 8) : 10 + 10 * (i // 8)])::bigint >> (35 - 5 * (i % 8))) & 31)::int]), 'string_agg', '') as payload_digest
  from p join g using (html)
)
select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from d
"""

OP7_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5(case when doc_id is null then '|mix' || md5(coalesce(text, '')) else doc_id::varchar || '|mix' end) as k from documents
), s as (
  select source, sum(size)::bigint as source_size from d group by source
), w as (
  select *, ([3.0, 1.0, 2.0])[((row_number() over (order by source is null, source) - 1) % 3 + 1)::int]::double as weight, 2 * source_size as cap from s
), f as (
  select *, cap / weight as ratio,
    coalesce(sum(cap) over (order by cap / weight, source is null, source rows between unbounded preceding and 1 preceding), 0)::double as full_caps,
    sum(weight) over (order by cap / weight, source is null, source rows between current row and unbounded following) as open_weight,
    1.5 * (sum(source_size) over ())::double as budget
  from w
), l as (
  select arg_min((budget - full_caps) / open_weight, ratio) as level from f where (budget - full_caps) / open_weight <= ratio
), t as (
  select source, source_size, least(cap::double, weight * (select level from l)) as target from f
), p as (
  select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as budget,
    coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (case when source_size > 0 then budget // source_size * size + greatest(0, least(size, budget % source_size - start)) else 0 end)::bigint as taken
from p
"""

OP9_SQL = f"""
with d as (select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from d group by t)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(d.t) as text_sha256 from d join g using (t)
"""

OP10_SQL = r"""
with recursive v as (
  select vec_id, embedding::double[] as x from embeddings where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0 and len(list_filter(embedding, lambda c: c <> 0)) > 0
), e as (
  select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) and list_cosine_similarity(a.x, b.x) >= 0.9
), t as (
  select vec_id as node, vec_id as label from v
  union
  select e.b, t.label from t join e on e.a = t.node where t.label < e.b
), c as (
  select node, min(label) as component_id from t group by node
), n as (
  select a, count(*) as n_links from e group by a
)
select vec_id, coalesce(n_links, 0)::bigint as n_links, coalesce(component_id, vec_id) as component_id, coalesce(component_id, vec_id) = vec_id as kept
from embeddings left join c on node = vec_id left join n on a = vec_id
"""

#: crc32 in two steps of four bits for each byte.
_CRC_HALVES = "[0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948, 3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]"
_CRC_STEP = f"xor(({{0}}) >> 4, ({_CRC_HALVES})[(({{0}}) & 15) + 1])"

OP11_SQL = f"""
with recursive t as (
  select coalesce(doc_id::varchar, '') as doc, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') as t from documents
), r as (
  select doc, w, count(*) as n from (select doc, unnest(regexp_extract_all(t, '[A-Za-z\u00C0-\u00FF]+')) as w from t) where length(w) >= 7 group by all
), b as (
  select *, flatten(list_transform(string_split(doc || ':' || w, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c)::bigint - 64] end)) as bytes from r
), h as (
  select w, n, xor(list_reduce(bytes, lambda s, x: {_CRC_STEP.format(_CRC_STEP.format('xor(s, x)'))}, 4294967295::bigint), 4294967295::bigint) as h from b
), z as (
  select case when h % 31 = 0 then substr(w, 1, (h % length(w))::int) || substr(w, (h % length(w))::int + 2) else w end as word, n from h
), v as (
  select word, sum(n)::bigint as n from z where length(word) >= 7 group by word having sum(n) >= 2
), d as (
  select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as rest from (select *, unnest(range(1, length(word) + 1))::int as i from v)
), p as (
  select a.word as a, b.word as b from d a join d b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union select d.word, v.word from d join v on d.rest = v.word
  union select v.word, d.word from d join v on d.rest = v.word
), m as (
  select p.a as word, count(*) as n_near, max(x.n) as most from p join v x on x.word = p.b group by p.a
), f as (
  select m.word, min(p.b) as form, any_value(m.most) as form_n from m join v on v.word = m.word join p on p.a = m.word join v x on x.word = p.b and x.n = m.most where m.most >= 10 * v.n group by m.word
), g as (
  select word, word as node, 0 as steps from v union all select g.word, f.form, steps + 1 from g join f on f.word = g.node
), e as (
  select word, arg_max(node, steps) as root from g group by word
)
select v.word, f.form, e.root, v.n, coalesce(m.n_near, 0)::bigint as n_near, f.form_n from v join e using (word) left join m using (word) left join f using (word)
"""


def _op12_sql(rounds: int = 3) -> str:
    whole = "select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as q from embeddings where embedding is not null and len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0"
    parts = [f"v as ({whole})", "c0 as (select (row_number() over (order by sha256('1:' || coalesce(vec_id::varchar, '')), q) - 1)::int as k, q from v qualify k < 16)", "r as (select row_number() over () as row, * from v)"]
    near = "a{0} as (select row, any_value(vec_id) as vec_id, any_value(r.q) as q, arg_min(k, d * 16 + k) as k, min(d)::bigint as d from (select r.*, c{0}.k, list_sum(list_transform(range(1, 65), lambda i: (r.q[i] - c{0}.q[i]) * (r.q[i] - c{0}.q[i]))) as d from r cross join c{0}) r group by row)"
    for i in range(rounds):
        parts.append(near.format(i))
        parts.append(f"s{i} as (select k, i, sum(x)::bigint as s, count(*) as n from (select k, unnest(q) as x, unnest(range(64)) as i from a{i}) group by k, i)")
        parts.append(f"c{i + 1} as (select c.k, coalesce(m.q, c.q) as q from c{i} c left join (select k, list((s - (s % n + n) % n) // n order by i) as q from s{i} group by k) m on m.k = c.k)")
    parts.append(near.format(rounds))
    names = f"select k, sha256(list_aggregate(list_transform(q, lambda x: x::varchar), 'string_agg', ',')) as centroid_sha256 from c{rounds}"
    return f"with {', '.join(parts)} select vec_id, k as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256 from a{rounds} join ({names}) using (k)"


OP13_SQL = r"""
with d as (
  select row_number() over () as row, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents
), g as (
  select row, i, array_to_string(ws[i : i + 4], ' ') as s from (select *, unnest(range(1, len(ws) - 3)) as i from d where len(ws) >= 5)
), w as (
  select row, i from (select row, i, count(*) over (partition by row, s) as n from g) where n > 1
), p as (
  select row, count(distinct i + j) as n from w cross join (select unnest(range(5)) as j) group by row
), l as (
  select row, count(*) as n, count(*) - count(distinct line) as dup from (select row, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]') group by row
), m as (
  select doc_id, len(ws)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
    coalesce(l.dup, 0)::bigint as n_dup_lines, coalesce(p.n, 0)::bigint as n_repeat_words, coalesce(l.n, 0) as n_lines
  from d left join p using (row) left join l using (row)
), f as (
  select *, ((n_words < 10)::bigint + 2 * (100 * n_repeat_words > 20 * n_words)::bigint + 4 * (n_words > 0 and word_chars < 2 * n_words)::bigint + 8 * (n_words > 0 and word_chars > 20 * n_words)::bigint
    + 16 * (n_words > 0 and 10 * n_symbols > n_words)::bigint + 32 * (n_lines >= 4 and 2 * n_dup_lines > n_lines)::bigint)::bigint as failures from m
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 as base_failed, failures = 0 as kept, failures from f
"""

ORACLE_SQL: dict[str, str] = {
    "op5_minhash": OP5_SQL,
    "op6_warc": OP6_SQL,
    "op7_mix": OP7_SQL,
    "op9_exact": OP9_SQL,
    "op10_embeddings": OP10_SQL,
    "op11_spelling": OP11_SQL,
    "op12_centroids": _op12_sql(),
    "op13_rules": OP13_SQL,
}
