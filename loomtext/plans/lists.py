"""Queries of list operators: order of models, limits of messages, unions, removals, units of work."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lists
from . import inputs as I
from .inputs import CHUNKS, PAIRS, SEGMENTS
from .registry import query, table


@query("select user_id, event_id, row_number() over (partition by user_id order by case when event_type = 'error' then -1 when event_type = 'purchase' then 0 when event_type = 'view' then 1 else 2 end, event_id) as place from events")
def o2_ordered_refs(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("group"), F.when(F.col("event_type") == "error", "client").otherwise("api").alias("kind"))
    return lists.ordered_refs(e, ["user_id"], ["purchase", "view"], "group", "event_id").select("user_id", "event_id", "place")


@query(f"select doc_id, blk, case when length(text) > 160 then rtrim(left(text, 159)) || '…' else text end as text from (select *, row_number() over (partition by doc_id order by blk) as r from {SEGMENTS}) where r <= 20")
def o6_dropped_edits(spark, d):
    return lists.dropped_edits(I.segments(spark, d).select("doc_id", "blk", "text"), ["doc_id"], "blk")


@query("select l_suppkey, o from (select l_suppkey, l_orderkey * 10 + l_linenumber as o, row_number() over (partition by l_suppkey order by l_orderkey * 10 + l_linenumber) as r from lineitem where l_returnflag <> 'R') where r <= 30")
def o7_listed_minors(spark, d):
    rows = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("o"))
    return lists.first_rows(rows, ["l_suppkey"], "o", lists.MOST_MINORS)


@query("select c_custkey as client, (select o_orderkey from orders where o_custkey = c_custkey and o_orderstatus = 'O' order by o_orderdate, o_orderkey limit 1) as task_id from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'O')")
def o8_oldest_tasks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("task_id"), F.col("o_orderdate").alias("created"), F.when(F.col("o_orderstatus") == "O", "waiting").otherwise("answered").alias("state"), F.col("o_custkey").alias("kind"))
    return lists.oldest_matching(o, table(spark, d, "customer").select(F.col("c_custkey").alias("client"), F.col("c_custkey").alias("kind")), ["kind"])


@query("select p_brand, p_partkey from (select *, row_number() over (partition by p_brand order by p_partkey desc) as r from part) where r <= 150")
def o10_known_terms(spark, d):
    return lists.first_rows(table(spark, d, "part").select("p_brand", "p_partkey"), ["p_brand"], "p_partkey", lists.MOST_KNOWN_TERMS, last=True)


@query("select l_orderkey, list(l_partkey order by l_linenumber, l_partkey) as parts from lineitem group by 1")
def o11_replies_by_index(spark, d):
    """Replies that come in any order, put back by their index."""
    return lists.by_index(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "parts")


@query("select s_nationkey, s_suppkey, row_number() over (partition by s_nationkey order by (s_suppkey % 3 = 0) desc, s_name) as place from supplier where s_acctbal > 0")
def o12_picker_order(spark, d):
    s = table(spark, d, "supplier").select("s_nationkey", "s_suppkey", F.col("s_name").alias("name"), (F.col("s_suppkey") % 3 == 0).alias("local"), (F.col("s_acctbal") > 0).alias("available"))
    return lists.picker_order(s, ["s_nationkey"]).select("s_nationkey", "s_suppkey", "place")


@query(f"select doc_id, 's0' as section, 'title' as block_id, source as text from documents union all select doc_id, 's1', 'b' || blk, text from {SEGMENTS}")
def u3_meta_and_sections(spark, d):
    """Blocks of a meta section and those of the text as one table."""
    meta = lists.with_section(table(spark, d, "documents"), "doc_id", "s0", F.lit("title"), F.col("source"))
    return meta.unionByName(lists.with_section(I.segments(spark, d), "doc_id", "s1", F.concat(F.lit("b"), F.col("blk").cast("string")), F.col("text")))


@query("select user_id, list_sort(list_distinct(list(event_type) || ['seed', 'view'])) as ids from events group by 1")
def u4_offered_and_seed(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(lists.with_seeds(F.collect_set("event_type"), ["seed", "view"]).alias("ids"))


@query("select l_orderkey, list_filter(list('p' || (l_suppkey % 3) || '/m' || l_partkey order by l_linenumber, l_partkey, l_suppkey), lambda x: not starts_with(x, 'p' || (l_orderkey % 3) || '/')) as refs from lineitem group by 1")
def u5_without_provider(spark, d):
    s = lambda c: c.cast("string")
    ref = F.concat(F.lit("p"), s(F.col("l_suppkey") % 3), F.lit("/m"), s(F.col("l_partkey")))
    rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", ref.alias("r")))), lambda x: x.r).alias("refs"))
    return rows.select("l_orderkey", lists.without_provider("refs", F.concat(F.lit("p"), s(F.col("l_orderkey") % 3))).alias("refs"))


_ROTATED = "(select o_orderkey, ['a', 'b', 'c', 'd'] as refs, list_distinct([chr((97 + o_custkey % 6)::int), chr((97 + o_orderkey % 5)::int)]) as skip, ['c', chr((97 + o_custkey % 5)::int)] as lead from orders)"


@query(f"select o_orderkey, list_filter(front, lambda x: list_contains(own, x)) || list_filter(own, lambda x: not list_contains(lead, x)) as refs from (select *, case when lead[1] = lead[2] then [lead[1]] else lead end as front, list_filter(refs, lambda x: not list_contains(skip, x)) as own from {_ROTATED})")
def u7_rotated_models(spark, d):
    letter = lambda c, n: F.chr(97 + c % n)
    o = table(spark, d, "orders")
    refs = F.array(*map(F.lit, "abcd"))
    lead = F.array_distinct(F.array(F.lit("c"), letter(F.col("o_custkey"), 5)))
    return o.select("o_orderkey", lists.rotated(refs, lead, F.array(letter(F.col("o_custkey"), 6), letter(F.col("o_orderkey"), 5))).alias("refs"))


@query("select n_nationkey, list_sort(list_filter(['id', 'path', n_name], lambda x: x not in ('id', 'language'))) as unknown from nation")
def u9_unknown_arguments(spark, d):
    args = F.create_map(F.lit("id"), F.lit("1"), F.lit("path"), F.lit("2"), F.col("n_name"), F.lit("3"))
    return table(spark, d, "nation").select("n_nationkey", lists.unknown_keys(args, ["id", "language"]).alias("unknown"))


@query(f"select project, chunk_index, state, qa_score, (chunk_index % 4)::int as issues, case when chunk_index % 4 >= 2 then 1 else 0 end::int as major_issues from {CHUNKS}")
def p4_chunk_briefs(spark, d):
    issue = lambda s: F.struct(F.lit("tags").alias("type"), F.lit(s).alias("severity"))
    some = F.slice(F.array(issue("minor"), issue("major"), issue("minor")), F.lit(1), (F.col("chunk_index") % 4).cast("int"))
    return lists.chunk_briefs(I.chunks(spark, d).select("project", "chunk_index", "state", "qa_score", F.lit("text").alias("final"), some.alias("issues")))


@query("select o_custkey, list_sort(list('n' || o_orderkey || '=' || o_orderpriority) filter (o_orderkey % 3 <> 0)) as texts from orders group by 1 having count(*) filter (o_orderkey % 3 <> 0) > 0")
def m4_rekeyed(spark, d):
    """Texts by old id as texts by new one; ids without a text go."""
    k = F.col("o_orderkey").cast("string")
    pairs = lambda v, when=F.lit(True): F.map_from_entries(F.collect_list(F.when(when, F.struct(k.alias("k"), v.alias("v")))))
    rows = table(spark, d, "orders").groupBy("o_custkey").agg(pairs(F.col("o_orderpriority"), F.col("o_orderkey") % 3 != 0).alias("texts"), pairs(F.concat(F.lit("n"), k)).alias("ids"))
    texts = F.array_sort(F.transform(F.map_entries(lists.rekeyed("texts", "ids")), lambda e: F.concat(e.key, F.lit("="), e.value)))
    return rows.select("o_custkey", texts.alias("texts")).where(F.size("texts") > 0)


_FIX = f"(select *, conv_id % 4 = 0 as none, conv_id % 4 = 1 as broken from {PAIRS})"


@query(f"select conv_id, turn, case when none then 'none' when broken then 'broken' else 'fixed' end as took from {_FIX}")
def v5_accepted_fixes(spark, d):
    """Fixes of answers: none given, one with a tag too many, one that holds."""
    k = F.col("conv_id") % 4
    fixed = F.when(k == 1, F.concat(F.col("source"), F.lit("<9/>"))).when(k > 1, F.col("source"))
    took = lists.accepted_fix("source", F.lit("\u0000before"), fixed)
    name = F.when(took != "\u0000before", "fixed").when(k == 0, "none").otherwise("broken")
    return I.pairs(spark, d).select("conv_id", "turn", name.alias("took"))


@query(f"select project, chunk_index, dense_rank() over (partition by project order by f) as unit, row_number() over (partition by project, chunk_index % 3 order by chunk_index) as turn from (select *, min(chunk_index) over (partition by project, chunk_index % 3) as f from {CHUNKS} where state = 'pending')")
def g2_scheduling_units(spark, d):
    rows = I.chunks(spark, d).withColumn("section", F.col("chunk_index") % 3)
    return lists.scheduling_units(rows, ["project"]).select("project", "chunk_index", "unit", "turn")


@query("""select p_partkey, 'm' || p_partkey as id, case when p_size > 10 then p_size * 1000 end::bigint as context, case when p_size % 4 > 1 then p_size::double * 1000000 end as price_in, case when p_size % 4 > 1 then 2000000.0::double end as price_out, p_size % 5 > 0 as text_only from part""")
def s35_listed_models(spark, d):
    s, q = F.col("p_size"), F.lit('"')
    text = lambda c: F.concat(q, c, q)
    price = F.when(s % 4 == 0, "-1").when(s % 4 == 1, "").otherwise(s.cast("string"))
    kinds = F.when(s % 5 == 0, '["text","image"]').when(s % 5 == 1, "null").otherwise('["text"]')
    length = F.when(s > 10, (s * 1000).cast("string")).otherwise("0")
    entry = F.concat(F.lit('{"id":'), text(F.concat(F.lit("m"), F.col("p_partkey").cast("string"))), F.lit(',"context_length":'), length, F.lit(',"pricing":{"prompt":'), text(price), F.lit(',"completion":"2"},"architecture":{"output_modalities":'), kinds, F.lit("}}"))
    return table(spark, d, "part").select("p_partkey", lists.listed_models(entry).alias("m")).select("p_partkey", "m.id", "m.context", "m.price_in", "m.price_out", "m.text_only")
