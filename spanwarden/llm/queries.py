"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwarden.llm import chat, decontam, line_dedup, neardup, packing, pii, quality, quality_rules, tokens, toxicity
from spanwarden.llm.common import read
from spanwarden.plans.shipping import ship

#: Rows and bytes that Arrow hands to Python at once; either bound ends a batch, so long texts don't add up.
BATCH_ROWS, BATCH_BYTES = "1000", "16m"


def session(spark: SparkSession) -> SparkSession:
    """Bounds what Python workers get at once, and ships them the package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return ship(spark)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(session(spark), sf_dir, "documents"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(session(spark), sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    same = "</s>[INST] ok [/INST]"
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(F.array(*[F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(same).alias("text")) for i, r in enumerate(("user", "assistant"))])))
    return chat.read_back(chat.formatted(rows.unionByName(more)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    session(spark)
    return quality.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(read(session(spark), sf_dir, "documents"), keep=["doc_id"])


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    session(spark)
    return toxicity.classified(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.counted(read(session(spark), sf_dir, "documents"), short=True)


def op7_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    session(spark)
    return tokens.read_shards(tokens.write_shards(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    session(spark)
    rows, _ = decontam.contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = quality_rules.assess(read(session(spark), sf_dir, "documents").select("doc_id", "text", "lang", "source"), keep=["doc_id"])
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(read(session(spark), sf_dir, "documents"), shingle=2)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_packing, op2_chat, op3_quality, op4_pii, op5_toxicity, op6_line_dedup, op7_token_shards, op8_decontamination, op9_quality_rules, op10_near_duplicates, pipeline)
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = r"[^\x20\x09-\x0D]+"
#: name: (numerator, denominator, scale, least spread), as the rules' ratios
_RATIOS = ", ".join(f"('{k}', {v[0]} * {v[2]} // greatest({v[1]}, 1), {v[3]}, {str(v[4]).lower()})" for k, v in quality_rules.RATIOS.items())



def _packing_sql() -> str:
    """The dynamic programme unrolled: a table for each number of buckets, with the cheapest end before each."""
    least = "select j, min(cost) as cost, arg_min(i, (cost, i)) as i from"
    tables = [f"b1 as ({least} (select j, 0 as i, c0(0, j) as cost from x) group by j)".replace("c0(0, j)", "hi * x - tok")]
    for k in range(2, packing.BUCKETS + 1):
        pad = "(y.hi - p.hi) * y.x - (y.tok - p.tok)"
        tables.append(f"b{k} as ({least} (select y.j, p.j as i, b.cost + {pad} as cost from x y join x p on p.j < y.j join b{k - 1} b on b.j = p.j) group by j)")
    ends = [f"e{packing.BUCKETS} as (select max(j) as j from x)"]
    ends += [f"e{k} as (select i as j from b{k + 1} join e{k + 1} using (j))" for k in range(packing.BUCKETS - 1, 0, -1)]
    every = " union all ".join(f"select j from e{k}" for k in range(1, packing.BUCKETS + 1))
    return rf"""
with n as (select doc_id, len(regexp_extract_all(coalesce(text, ''), '{_SPACED}'))::bigint as n from documents),
p as (select doc_id, piece, least({packing.LONGEST}, n - piece * {packing.LONGEST})::bigint as n_tokens from (select *, unnest(generate_series(0, (n - 1) // {packing.LONGEST})) as piece from n where n > 0)),
x as materialized (select n_tokens as x, row_number() over (order by n_tokens) as j, sum(count(*)) over (order by n_tokens)::bigint as hi, sum(count(*) * n_tokens) over (order by n_tokens)::bigint as tok from p group by n_tokens),
{", ".join(t.replace(" as (", " as materialized (", 1) for t in tables)}, {", ".join(ends)},
ends as (select x as bucket from x join ({every}) using (j)),
b as (select p.*, (select min(bucket) from ends where bucket >= n_tokens) as bucket, ('0x' || substr(md5(doc_id || ',' || piece || ',' || n_tokens), 1, 8))::bigint % greatest({packing.SHARDS}, (select count(*) from p) // {packing.SHARD_ROWS}) as shard from p),
o as (select *, row_number() over (partition by bucket order by shard, doc_id, piece, n_tokens) - 1 as place, greatest(1, {packing.BUDGET} // bucket) as fit from b)
select doc_id, piece, n_tokens, bucket, (place // fit)::bigint as batch, (place % fit)::bigint as slot from o"""


#: Where SQL can't express an operator (sampled fits, edit joins, dynamic programmes, token files), tests/llm
#: hold it against brute force instead.
ORACLES: dict[str, str] = {
    "op1_packing": _packing_sql(),
    "op2_chat": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select * from (values (-7::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'), (-7::bigint, 1::bigint, 'assistant', '</s>[INST] ok [/INST]')) t(a, b, c, d)),
e as (select *, length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]|NEXT\]))', '\1\\\2\3', 'g')) as escaped, lag(role) over (partition by conv_id order by turn, role, text) as before from c)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(escaped + case when before is null or before <> role then length(role) + 20 else 6 end)::bigint as formatted_chars
from e group by conv_id""",
    "op8_decontamination": rf"""
with side as (select 'd' as side, doc_id as id, {_LOW} as t from documents union all select 'b', item_id, {_LOW} from benchmark),
w as (select side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from side),
items as (select distinct id, size, array_to_string(ws[k:k + size - 1], ' ') as win from (select *, unnest(generate_series(1, len(ws) - size + 1)) as k from (select *, least(len(ws), 13) as size from w where side = 'b' and len(ws) > 0))),
hits as (select d.id, d.k, d.size, i.id as item from (select id, size, k, array_to_string(ws[k:k + size - 1], ' ') as win from
  (select id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) as k from w, (select distinct size from items) where side = 'd' and len(ws) >= size)) d join items i on i.size = d.size and i.win = d.win),
words as (select id, count(distinct pos) as n_hit from (select id, unnest(generate_series(k, k + size - 1)) as pos from (select distinct id, k, size from hits)) group by id),
found as (select id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct id, item::varchar as item from hits) group by id)
select w.id as doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated
from w left join words using (id) left join found using (id) where side = 'd'""",
    "op9_quality_rules": rf"""
with w as (select doc_id, lang, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as ws, string_split(coalesce(text, ''), chr(10)) as ls from documents),
grams as (select doc_id, k, array_to_string(ws[k:k + 4], ' ') as g from (select doc_id, ws, unnest(generate_series(1, len(ws) - 4)) as k from w)),
again as (select doc_id, count(distinct pos) as n_repeat_words from (select doc_id, unnest(generate_series(k, k + 4)) as pos from (select *, count(*) over (partition by doc_id, g) as c from grams) where c > 1) group by doc_id),
dup as (select doc_id, sum(c - 1) as n_dup_lines from (select doc_id, l, count(*) as c from (select doc_id, unnest(ls) as l from w) where regexp_matches(l, '{_SPACED}') group by all) group by doc_id),
counts as (select doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines from w left join again using (doc_id) left join dup using (doc_id)),
ratios as (select doc_id, lang, source, n_words, r.* from counts, lateral (values {_RATIOS}) r(metric, v, least_spread, both_sides)),
cells as (select lang, source, metric, (v >> greatest(length(ltrim(bin(v), '0')) - 6, 0)::bigint) << greatest(length(ltrim(bin(v), '0')) - 6, 0)::bigint as cell, count(*) as n from ratios where n_words > 0 group by all),
sums as (select lang, source, metric, 1 as level, cell, sum(n) as n from cells group by all union all select lang, null, metric, 2, cell, sum(n) from cells group by all union all select null, null, metric, 3, cell, sum(n) from cells group by all),
run as (select *, sum(n) over (partition by level, lang, source, metric order by cell) as up, sum(n) over (partition by level, lang, source, metric) as total from sums),
quart as (select level, lang, source, metric, max(total) as total, min(cell) filter (up * 4 >= total) as q1, min(cell) filter (up * 4 >= total * 3) as q3 from run group by all),
own as (select r.*, case when g.total >= 200 then g.q1 when l.total >= 200 then l.q1 else a.q1 end as q1, case when g.total >= 200 then g.q3 when l.total >= 200 then l.q3 else a.q3 end as q3, g.total is null as new
  from ratios r left join quart g on g.level = 1 and g.lang is not distinct from r.lang and g.source is not distinct from r.source and g.metric = r.metric
  left join quart l on l.level = 2 and l.lang is not distinct from r.lang and l.metric = r.metric left join quart a on a.level = 3 and a.metric = r.metric),
judged as (select doc_id, bool_or(not new and (v > q3 + 6 * greatest(q3 - q1, least_spread) or (both_sides and v < q1 - 6 * greatest(q3 - q1, least_spread)))) as outside from own group by doc_id)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not coalesce(outside, false) as kept from counts join judged using (doc_id)""",
    "op10_near_duplicates": rf"""
with recursive w as (select doc_id, regexp_extract_all({_LOW}, '{_SPACED}') as ws from documents),
sets as (select doc_id, case when len(ws) >= 2 then list_sort(list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1]))) else ws end as s from w),
classes as (select s, min(doc_id) as rep, len(s) as n from sets where len(s) > 0 group by s),
-- with its shingles from the rarest on, a set shares one of the first n - ceil(0.8 n) + 1 with any that is alike
each as (select rep, n, unnest(s) as x from classes),
rare as (select rep, n, x, row_number() over (partition by rep order by c, x) as pos from (select *, count(*) over (partition by x) as c from each)),
front as (select rep, n, x from rare where pos <= n - ceil(n * 80 / 100) + 1),
pairs as (select distinct a.rep as a, b.rep as b from front a join front b on a.x = b.x and a.rep < b.rep and least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
links as (select p.a, p.b from pairs p join classes x on x.rep = p.a join classes y on y.rep = p.b where 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
edges as (select a, b from links union all select b, a from links),
reach as (select rep as node, rep as low from classes union select r.node, e.b from reach r join edges e on e.a = r.low where true),
tops as (select node, min(low) as component from reach group by node)
select d.doc_id, len(d.s)::bigint as n_shingles, coalesce(t.component, d.doc_id) as component_id, coalesce(t.component, d.doc_id) = d.doc_id as kept
from sets d left join classes c on c.s = d.s left join tops t on t.node = c.rep""",
    # its distance is one of bytes, so the characters beyond ASCII (of 28 at most) stand for themselves by control ones
    "op6_line_dedup": r"""
with l as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(generate_series(1, len(string_split(text, chr(10))))) as pos from documents),
o as (select * from l where length(line) >= 30 or regexp_matches(line, '[\p{L}\p{N}]')),
known as (select line, min((doc_id, pos)) as first from o group by line),
far as (select string_agg(c, '' order by c) as chars from (select distinct unnest(string_split(line, '')) as c from known where length(line) >= 30) where ord(c) > 127),
near_ as (select array_to_string(list_transform(list_filter(generate_series(1, 31), lambda i: i not in (9, 10, 13)), lambda i: chr(i::int)), '') as codes),
long as materialized (select line, first, length(line) as n, translate(line, chars, codes) as code, length(replace(line, 'e', '')) as e, length(replace(line, 'a', '')) as a, length(replace(line, 'n', '')) as m, length(replace(line, 't', '')) as t, length(replace(line, ' ', '')) as s from known, far, near_ where length(line) >= 30),
links as (select x.line as a, y.line as b, x.first as fa, y.first as fb from long x join long y on y.n between x.n and x.n + 2 and (x.n < y.n or x.line < y.line)
  and abs((x.n - x.e) - (y.n - y.e)) <= 2 and abs((x.n - x.a) - (y.n - y.a)) <= 2 and abs((x.n - x.m) - (y.n - y.m)) <= 2 and abs((x.n - x.t) - (y.n - y.t)) <= 2 and abs((x.n - x.s) - (y.n - y.s)) <= 2
  and levenshtein(x.code, y.code) <= 2),
ends as (select line, bool_or(later) as near, count(*) as links from (select a as line, fb < fa as later from links union all select b, fa < fb from links) group by line),
told as (select doc_id, count(*) filter (coalesce(near, false) or first <> (doc_id, pos)) as n_removed, count(*) filter (coalesce(near, false)) as n_near, sum(coalesce(links, 0))::bigint as n_links from o join known using (line) left join ends using (line) group by doc_id)
select doc_id, coalesce(len(string_split(text, chr(10))), 0)::bigint as n_lines, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_near, 0)::bigint as n_near, coalesce(n_links, 0)::bigint as n_links from documents left join told using (doc_id)""",
}
