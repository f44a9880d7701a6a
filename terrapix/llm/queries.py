"""The registered opN queries: each applies one operator to its whole table and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import decontaminate, digest
from .exact_dedup import exact_dedup
from .html_text import html_text
from .licenses import digest as license_digest
from .licenses import scan_licenses
from .merkle import manifest
from .near_dedup import near_dedup
from .packing import pack
from .pii import digest as pii_digest
from .pii import find_pii
from .ppm import ppm_score
from .prefix_trie import conversation_trie
from .quality import score_quality
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"), keep_text=False).drop("spans", "kept_text")


@query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 1024)


@query
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


@query
def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


ORACLE["op8_exact_dedup"] = r"""
with n as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents where doc_id is not null
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size, doc_id = min(doc_id) over w as kept, sha256(norm) as text_sha256
from n window w as (partition by norm)
"""


@query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


@query
def op9_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_score(table(spark, sf_dir, "documents"))


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(find_pii(table(spark, sf_dir, "documents")))


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_digest(scan_licenses(table(spark, sf_dir, "documents")))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of decimal text: a byte is mixed in, then eight shifts follow.
_CRC = (
    "xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split({}, ''), lambda x: list_concat([ord(x)::bigint], [-1::bigint, -1, -1, -1, -1, -1, -1, -1])))), "
    "lambda c, o: case when o >= 0 then xor(c, o) else xor(c >> 1, 3988292384 * (c & 1)) end), 4294967295::bigint)"
)
ORACLE["op12_prefix_trie"] = f"""
with own as (
  select conv_id, n_bytes, t, row_number() over (partition by conv_id order by turn nulls first, t[:32]) as pos
  from (select conv_id, turn, strlen(coalesce(text, '')) as n_bytes, sha256(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) as t from conversations where conv_id is not null)
),
ids as (select conv_id, conv_id - conv_id % 5 as source, {_CRC.format("conv_id::varchar")} % 9 as h from (select distinct conv_id from own)),
built as (
  select i.conv_id, o.pos, o.t, o.n_bytes from ids i join own o on o.conv_id = i.source and o.pos <= i.h
  union all select i.conv_id, o.pos, o.t, o.n_bytes from ids i join own o on o.conv_id = i.conv_id and o.pos > i.h
),
placed as (select conv_id, t, n_bytes, row_number() over (partition by conv_id order by pos) as depth from built),
path as (
  select conv_id, depth, n_bytes, string_agg(t, '') over (partition by conv_id order by depth rows unbounded preceding) as k from placed
  union all select conv_id, 0, 0, '' from ids
),
node as (select k, any_value(depth) as depth, min(conv_id) as conv_id, count(*) as n_convs, any_value(n_bytes) as n_bytes from path group by k),
ends as (select k, sha256(string_agg(cast(conv_id as varchar), ',' order by conv_id)) as e from (select conv_id, max_by(k, depth) as k from path group by conv_id) group by k),
child as (select k[: greatest(64 * (depth - 1), 0)] as k, count(*) as n from node where depth > 0 group by all),
below as (
  select p.k, count(*) filter (where c.n is null) as n_leaves, sum((q.n_convs - 1) * q.n_bytes) as saved
  from node q join path p on p.conv_id = q.conv_id and p.depth <= q.depth left join child c on c.k = q.k group by p.k
)
select n.conv_id, cast(n.depth as bigint) as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(c.n, 0) as n_children, b.n_leaves, cast(b.saved as bigint) as saved_tokens, coalesce(e.e, sha256('')) as ends_sha256
from node n left join node u on n.depth > 0 and u.k = n.k[: greatest(64 * (n.depth - 1), 0)] left join child c on c.k = n.k join below b on b.k = n.k left join ends e on e.k = n.k
"""


@query
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(table(spark, sf_dir, "documents"))


def _enc(*columns: str) -> str:
    return " || ".join(f"coalesce(strlen(cast({c} as varchar)) || ':' || cast({c} as varchar), '-')" for c in columns)


ORACLE["op13_merkle_manifest"] = f"""
with recursive leaf as (
  select doc_id, lang, sha256({_enc("doc_id", "source", "lang", "n_chars", "text")}) as leaf,
    case when doc_id is not null and {_CRC.format("doc_id::varchar")} % 7 = 0 then sha256({_enc("doc_id", "source", "lang", "(n_chars + 1)", "text")}) else sha256({_enc("doc_id", "source", "lang", "n_chars", "text")}) end as bad
  from documents
),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by lang) as n from leaf),
up as (
  select lang, 0 as l, i, n, leaf as d from placed
  union all select lang, l + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' order by i)) from up where n > 1 group by lang, l, i // 2, n
),
sub as (select lang, d, row_number() over (order by lang nulls first) - 1 as i, count(*) over () as n from up where n = 1),
top as (
  select 0 as l, i, n, d from sub
  union all select l + 1, i // 2, (n + 1) // 2, sha256(string_agg(d, '' order by i)) from top where n > 1 group by l, i // 2, n
),
low as (
  select doc_id, lang, leaf, 0 as l, i, n, bad as x, '' as proof from placed
  union all select f.doc_id, f.lang, f.leaf, f.l + 1, f.i // 2, (f.n + 1) // 2, sha256(case when s.d is null then x when f.i % 2 = 0 then x || s.d else s.d || x end), proof || coalesce(s.d, '')
  from low f left join up s on s.lang is not distinct from f.lang and s.l = f.l and s.i = xor(f.i, 1) where f.n > 1
),
high as (
  select f.doc_id, f.leaf, s.d as subroot, 0 as l, s.i, s.n, f.x, f.proof from low f join sub s on s.lang is not distinct from f.lang where f.n = 1
  union all select f.doc_id, f.leaf, f.subroot, f.l + 1, f.i // 2, (f.n + 1) // 2, sha256(case when s.d is null then x when f.i % 2 = 0 then x || s.d else s.d || x end), proof || coalesce(s.d, '')
  from high f left join top s on s.l = f.l and s.i = xor(f.i, 1) where f.n > 1
)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, x as folded_root, x = root as verified from high, (select d as root from top where n = 1) where n = 1
"""


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


_WORDS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
ORACLE["op4_decontaminate"] = f"""
with d as (select doc_id, {_WORDS} as w from documents where doc_id is not null),
b as (select cast(item_id as varchar) as item_id, {_WORDS} as w from benchmark where item_id is not null),
win as (
  select distinct item_id, least(len(w), 10) as n, array_to_string(w[p : p + least(len(w), 10) - 1], ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) as p from b where len(w) > 0)
),
dw as (
  select doc_id, p, n, array_to_string(w[p : p + n - 1], ' ') as t
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as p from d, (select distinct n from win) where len(w) >= n)
),
hit as (select dw.doc_id, dw.p, dw.n, win.item_id from dw join win using (n, t)),
cov as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + n)) as q from (select distinct doc_id, p, n from hit)) group by doc_id),
it as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join cov using (doc_id) left join it using (doc_id)
"""
