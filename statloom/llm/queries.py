"""One query per operator, over its whole table with production parameters, and its SQL where there is one."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.frames import cut_lineage, shared_folder
from . import token_counts as token_totals
from .conversations import repair
from .fingerprint import neighbour_likeness
from .merkle import leaf_digest, prove
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .page_text import extract
from .quality import quality_scores
from .secrets import find_secrets, joined
from .licences import scan
from .token_counts import apply_batch, token_counts
from .topk import top_k
from .warc import derive, responses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


QUERIES["op1_minhash"] = op1_minhash
ORACLE["op1_minhash"] = """with recursive w as materialized (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as materialized (select distinct doc_id, unnest(case when len(ws) = 0 then []::varchar[] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as g from w),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
k as materialized (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as materialized (select a, b from k join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 75 * (x.n + y.n - o)),
r as (select doc_id as d, doc_id as c from documents union select r.d, e.b from r join e on e.a = r.c)
select d as doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(c) as component_id, d = min(c) as kept
from r left join n on n.doc_id = r.d group by d"""


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["op4_packing"] = op4_packing


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", F.col("pattern_size").alias("source_size"), "target", "taken")


QUERIES["op6_mixing"] = op6_mixing
ORACLE["op6_mixing"] = """with d as materialized (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size, md5('42:' || coalesce(doc_id::varchar, '')) as h from documents),
s as (select source, sum(size)::bigint as n, (row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as w from d group by source),
o as (select *, row_number() over (order by 3.0::double * n / w, encode(source) nulls last) as k from s),
c as (select *, sum(n) over () as total, coalesce(sum(3 * n) over (order by k rows between unbounded preceding and 1 preceding), 0) as used, sum(w) over (order by k rows between current row and unbounded following) as ws from o),
f as (select min(k) as k from c where w * (total - used) <= 3 * n * ws),
t as (select c.source, c.n, case when c.k < f.k then (3 * c.n)::double else (c.w * (x.total - x.used))::double / x.ws::double end as target from c, f, c x where x.k = f.k),
g as (select *, floor(target + 0.5)::bigint as quota from t),
r as (select d.*, g.n, g.target, case when g.n > 0 then g.quota // g.n else 0 end as passes, case when g.n > 0 then g.quota % g.n else 0 end as rest,
  coalesce(sum(size) over (partition by d.source order by h, d.doc_id, size rows between unbounded preceding and 1 preceding), 0) as before from d join g on d.source is not distinct from g.source)
select doc_id, size, n as source_size, target, (passes * size + least(size, greatest(0, rest - before)))::bigint as taken from r"""


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES["op8_topk"] = op8_topk
ORACLE["op8_topk"] = """with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as (select q.vec_id as query_id, c.vec_id, list_inner_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 50 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from p)
select query_id, rank, vec_id, score from r where rank <= 5"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


QUERIES["op7_quality"] = op7_quality


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


QUERIES["op2_secrets"] = op2_secrets


def op3_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbour_likeness(_table(spark, sf_dir, "documents"))


QUERIES["op3_fingerprint"] = op3_fingerprint


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derive(responses(_table(spark, sf_dir, "pages"), "2024-01-01T00:00:00Z"))


QUERIES["op5_warc"] = op5_warc


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads all documents, delivers the load twice, counts the end token of each from then on, and withdraws exact copies."""
    store = f"{shared_folder(spark).rstrip('/')}/token-counts-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents").withColumn("copy", F.md5("text"))
    counted = cut_lineage(token_counts(docs, {"byte_bpe_50k": public_tokenizers.path("byte_bpe_50k.json"), token_totals.WORDS: None}, keep=("source", "lang", "copy")))
    load = counted.withColumn("op", F.lit("insert"))
    apply_batch(load, store, "load")
    apply_batch(load, store, "load")
    with_end = counted.where(F.col("version") != token_totals.WORDS).withColumn("op", F.lit("revise")).withColumn("tokens", F.col("tokens") + 1)
    apply_batch(with_end, store, "end-token")
    first = counted.where("copy is not null").groupBy("copy").agg(F.min("doc_id").alias("first"))
    copies = counted.join(first, "copy").where("doc_id <> first").withColumn("op", F.lit("delete"))
    apply_batch(copies, store, "copies")
    return token_totals.totals(spark, store)


QUERIES["op9_token_counts"] = op9_token_counts


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(_table(spark, sf_dir, "documents"))


QUERIES["op10_licences"] = op10_licences


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the rows are tampered with: their texts lose their line feeds."""
    fields = ("doc_id", "source", "lang", "n_chars")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest(*fields, F.translate("text", "\n", "")))
    out = prove(_table(spark, sf_dir, "documents"), leaf_digest(*fields, "text"), tampered)
    return out.select("doc_id", "leaf", "subroot", "root", F.sha2("proof", 256).alias("proof_sha256"), "folded_root", "verified")


QUERIES["op11_merkle"] = op11_merkle


def _sql_crc32(text: str) -> str:
    """CRC-32 of an ASCII text: each character is folded in, followed by eight shifts."""
    shifts = ", ".join(["-1"] * 8)
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::bigint, {shifts}]))"
    return (f"xor(list_reduce(list_prepend(4294967295::bigint, {bits}), lambda a, x: case when x >= 0 then xor(a, x) "
            "when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end), 4294967295::bigint)")


def _sql_leaf(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::varchar)::varchar || ':' || {c}::varchar, '-')" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE["op11_merkle"] = f"""with recursive l as materialized (
  select *, row_number() over (order by source nulls first, doc_id nulls first, leaf) as rid,
    row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by source) as n from (
  select doc_id, source, {_sql_leaf('text')} as leaf, case when {_sql_crc32('doc_id::varchar')} % 2 = 0 then {_sql_leaf("replace(text, chr(10), '')")} end as changed from documents)),
t as (select 0 as lvl, source, pos as i, leaf as h, n from l
  union all select lvl + 1, source, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from t where n > 1 group by lvl, source, i // 3),
sub as materialized (select source, h, row_number() over (order by encode(source) nulls first) - 1 as gid from t where n = 1),
u as (select 0 as lvl, gid as i, h, count(*) over () as n from sub
  union all select lvl + 1, i // 3, sha256(string_agg(h, '' order by i)), any_value((n + 2) // 3) from u where n > 1 group by lvl, i // 3),
ts as materialized (select lvl, source, i, coalesce(string_agg(h, '') over (partition by lvl, source, i // 3 order by i rows between unbounded preceding and 1 preceding), '') as lft,
  coalesce(string_agg(h, '') over (partition by lvl, source, i // 3 order by i rows between 1 following and unbounded following), '') as rgt from t where n > 1),
us as materialized (select lvl, i, coalesce(string_agg(h, '') over (partition by lvl, i // 3 order by i rows between unbounded preceding and 1 preceding), '') as lft,
  coalesce(string_agg(h, '') over (partition by lvl, i // 3 order by i rows between 1 following and unbounded following), '') as rgt from u where n > 1),
steps as (select rid, lvl as k, lft, rgt from l join ts on ts.source is not distinct from l.source and ts.i = l.pos // (3 ** ts.lvl)::bigint
  union all select rid, 1000 + us.lvl, lft, rgt from l join sub on sub.source is not distinct from l.source join us on us.i = sub.gid // (3 ** us.lvl)::bigint),
p as (select rid, string_agg(lft || rgt, '' order by k) as proof, list({{'h': '', 'l': lft, 'r': rgt}} order by k) as way from steps group by rid),
f as (select l.doc_id, l.leaf, l.changed, sub.h as subroot, (select h from u where n = 1) as root, coalesce(p.proof, '') as proof, coalesce(p.way, []) as way
  from l join sub on sub.source is not distinct from l.source left join p on p.rid = l.rid),
g as (select *, list_reduce(list_prepend({{'h': coalesce(changed, leaf), 'l': '', 'r': ''}}, way), lambda a, x: {{'h': sha256(x.l || a.h || x.r), 'l': '', 'r': ''}}).h as folded from f)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, folded as folded_root, folded = root as verified from g"""


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, damaged by the checksum of its turns and repaired."""
    table = _table(spark, sf_dir, "conversations")
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kept = table.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(key) % 20).alias("way")).where("way <> 0")
    text = F.when(F.col("way") == 1, "").when(F.col("way") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("way") == 4, "user").otherwise(F.col("role"))
    damaged = kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.expr("sequence(1, if(way = 3, 2, 1))")))
    found = repair(damaged).withColumnRenamed("conv_id", "id")
    out = table.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zeros = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *zeros, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES["op12_conversations"] = op12_conversations
# States: 0 nothing, 1 system, 2 user, 3 assistant. `ins` are insertions before a turn, `use` is what may become of it.
ORACLE["op12_conversations"] = f"""with recursive k as materialized (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_sql_crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")} % 20 as way from conversations),
d as (select conv_id, turn, case when way = 4 then 'user' else role end as role,
    case when way = 1 then '' when way = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(range(case when way = 3 then 2 else 1 end)) as copy from k where way <> 0),
o as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as i from d),
p as (select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, left(role, 1) as ini, lag(left(role, 1)) over (partition by conv_id order by i) as prev,
    not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') as cut from o),
r as materialized (select *, blank or again as must, not blank and not again and cut as trunc from p),
ins(q, letters, qk, c, t) as (values (0, '', 0, 0, ''), (1, '', 1, 0, ''), (2, '', 2, 0, ''), (3, '', 3, 0, ''), (0, 'I', 2, 5, 'user:|'), (1, 'I', 2, 5, 'user:|'), (3, 'I', 2, 5, 'user:|'), (2, 'I', 3, 5, 'assistant:|'),
    (0, 'II', 3, 10, 'user:|assistant:|'), (1, 'II', 3, 10, 'user:|assistant:|'), (3, 'II', 3, 10, 'user:|assistant:|'), (2, 'II', 2, 10, 'assistant:|user:|')),
use(qk, letter, ini, nq, c, role) as (values (0, 'D', null, 0, 2, null), (1, 'D', null, 1, 2, null), (2, 'D', null, 2, 2, null), (3, 'D', null, 3, 2, null),
    (0, 'K', 's', 1, 0, null), (0, 'K', 'u', 2, 0, null), (1, 'K', 'u', 2, 0, null), (3, 'K', 'u', 2, 0, null), (2, 'K', 'a', 3, 0, null),
    (0, 'R', null, 2, 1, 'user'), (1, 'R', null, 2, 1, 'user'), (3, 'R', null, 2, 1, 'user'), (2, 'R', null, 3, 1, 'assistant')),
moves as materialized (select ins.q, use.nq, letters || letter as e, ins.c + use.c as c, replace(t, '|', chr(10)) as t, letter, ini, role from ins join use using (qk)),
w as (select conv_id, 0::bigint as i, 0 as q, {{'c': 0::bigint, 'e': '', 't': ''}} as b from (select distinct conv_id from r)
  union all select w.conv_id, w.i + 1, m.nq, min({{'c': (w.b.c + m.c + case when r.trunc and m.letter <> 'D' then 5 else 0 end)::bigint, 'e': w.b.e || m.e,
      't': w.b.t || m.t || case when m.letter = 'D' then '' else coalesce(m.role, r.role) || ':' || r.text || chr(10) end}})
    from w join r on r.conv_id is not distinct from w.conv_id and r.i = w.i + 1 join moves m on m.q = w.q and (m.letter = 'D' or not r.must) and (m.ini is null or m.ini = r.ini) group by 1, 2, 3),
s as (select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate, count(*) filter (trunc) as truncated,
    count(*) filter (i > 1 and prev || ini not in ('su', 'ua', 'au')) as illegal, max(i) as n from r group by conv_id),
e as (select w.conv_id, min({{'c': (w.b.c + case q when 1 then 10 when 2 then 5 else 0 end)::bigint, 'e': w.b.e || case q when 1 then 'II' when 2 then 'I' else '' end,
    't': w.b.t || case q when 1 then 'user:' || chr(10) || 'assistant:' || chr(10) when 2 then 'assistant:' || chr(10) else '' end}}) as b
  from w join s on s.conv_id is not distinct from w.conv_id and w.i = s.n group by w.conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal,
  coalesce(e.b.c, 0)::bigint as cost, coalesce(e.b.e, '') as audit, sha256(coalesce(left(e.b.t, greatest(length(e.b.t) - 1, 0)), '')) as repaired_sha256
from (select distinct conv_id from conversations) a left join s on s.conv_id is not distinct from a.conv_id left join e on e.conv_id is not distinct from a.conv_id"""


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


QUERIES["op13_html"] = op13_html
