"""Queries of smaller operators: lists, names, models, settings, display and state."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import unicode as U
from ..operators import checks, limits, lists, pages, plan, projects, protocol, rollup, routing, script
from ..sources import markdown, markup
from ..streaming import leases
from . import inputs as I
from .inputs import CHUNKS, SEGMENTS
from .registry import query, table


@query()
def s6_page_blocks(spark, d):
    """Blocks of web pages with inline tags."""
    return markup.page_blocks(table(spark, d, "pages")).select("page_id", "blk_ord", "kind", "text", F.size("tags").alias("tags"))


@query()
def s2_text_blocks(spark, d):
    """Paragraph blocks of documents read as Markdown."""
    return markdown.read_blocks(table(spark, d, "documents"), True)


@query()
def w4_split_segments(spark, d):
    return plan.split_segments(I.segments(spark, d), ["doc_id", "blk"], 60)


@query("""with w as (select doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+')) as w from documents),
 h as (select doc_id, list_reduce(list_prepend(2166136261::bigint, list_transform(string_split(w, ''), lambda c: ascii(c)::bigint)), lambda a, c: (xor(a, c) * 16777619) & 4294967295) as h, count(*) as n from w group by doc_id, w),
 v as (select doc_id, k, sum(x) as x from (select doc_id, h % 64 as k, n * 1.0::double as x from h union all select doc_id, (h >> 8) % 64, n * 0.5::double from h) group by 1, 2),
 n as (select doc_id, sqrt(sum(x * x)) as n from v group by 1)
 select doc_id, list(coalesce(x, 0.0::double) / coalesce(n, 1.0::double) order by k) as embedding from (select doc_id, unnest(range(64)) as k from documents) left join v using (doc_id, k) left join n using (doc_id) group by doc_id""")
def n9_hash_embeddings(spark, d):
    return table(spark, d, "documents").select("doc_id", U.hash_embedding("text").alias("embedding"))


@query("select conv_id, turn, upper(substr(role, 1, 1)) || lower(substr(role, 2)) || '-' || upper(substr(role, 1, 1)) || lower(substr(role, 2)) as title from conversations")
def f16_title_case(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", U.title_case(F.concat_ws("-", F.upper("role"), "role")).alias("title"))


@query("select p_partkey, p_name as name from part where p_partkey % 2 = 0")
def f17_speakers(spark, d):
    t = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<1>"), "p_name", F.lit(" (low):</1> Hi."))).otherwise(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", X.speaker_name(t).alias("name")).where("name is not null")


@query("select n_nationkey, case n_nationkey % 4 when 0 then 'hr' when 1 then 'de' when 2 then 'en' end as code, case n_nationkey % 4 when 0 then 'dash' when 1 then 'quotes' when 2 then 'quotes' end as dialogue from nation")
def f25_typography(spark, d):
    k = F.col("n_nationkey") % 4
    lang = F.when(k == 0, " Croatian ").when(k == 1, "de-AT").when(k == 2, "EN_us").otherwise(F.col("n_name"))
    return table(spark, d, "nation").select("n_nationkey", projects.language_code(lang).alias("code"), projects.default_dialogue(lang).alias("dialogue"))


@query("select p_partkey, regexp_replace(lower(p_name || ' ' || p_size), '[0-9]+', '#', 'g') as key from part")
def f27_repeat_lines(spark, d):
    return table(spark, d, "part").select("p_partkey", X.normalize_repeat(F.concat_ws("  ", "p_name", F.col("p_size").cast("string"))).alias("key"))


@query("select p_partkey, case p_partkey % 3 when 0 then 'transla' || lower(p_brand) when 1 then 'word- ' || upper(p_brand) else 'word ' || lower(p_brand) end as line from part")
def f28_joined_lines(spark, d):
    k = F.col("p_partkey") % 3
    a = F.when(k == 0, "transla-").when(k == 1, "word-").otherwise("word")
    b = F.when(k == 1, F.upper("p_brand")).otherwise(F.lower("p_brand"))
    return table(spark, d, "part").select("p_partkey", X.join_lines(a, b).alias("line"))


@query("select p_partkey, floor(p_retailprice / 0.5 + 0.5)::double * 0.5 as size from part")
def n4_rounded_sizes(spark, d):
    return table(spark, d, "part").select("p_partkey", X.rounded_to(F.col("p_retailprice"), 0.5).alias("size"))


@query("select doc_id from documents where doc_id % 2 = 0")
def n6_same_hash(spark, d):
    h = F.sha2(F.col("text").cast("binary"), 256)
    other = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" SHA256:"), F.upper(h))).otherwise(F.lit("sha256:0"))
    return table(spark, d, "documents").where(X.same_hash(h, other)).select("doc_id")


@query("select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) as uuid from (select doc_id, sha1(text) as h from documents)")
def n7_uuids(spark, d):
    return table(spark, d, "documents").select("doc_id", X.uuid_from("text").alias("uuid"))


@query("select event_id, json_extract_string(props, '$.' || json_keys(props)[1]) as first from events")
def m1_first_json(spark, d):
    """A JSON object within chatter, and its first value."""
    reply = F.concat(F.lit("<think>no {\n</think>Here: "), F.col("props"), F.lit(" done."))
    obj = X.first_json(reply)
    return table(spark, d, "events").select("event_id", F.element_at(F.map_values(F.from_json(obj, "map<string,string>")), 1).alias("first"))


@query("select n_nationkey as k, n_name as value, 'nation' as kind from nation union all select r_regionkey, r_name, 'region' from region")
def m5_flat_catalog(spark, d):
    """Maps of a catalog as key and value rows."""
    flat = lambda t, k, v, kind: table(spark, d, t).agg(F.map_from_entries(F.collect_list(F.struct(k, v))).alias("m")).select(F.explode("m").alias("k", "value"), F.lit(kind).alias("kind"))
    return flat("nation", "n_nationkey", "n_name", "nation").union(flat("region", "r_regionkey", "r_name", "region"))


@query("select o_orderkey, (greatest(0, a - c) + c + b)::bigint as total from (select o_orderkey, o_orderkey as a, o_custkey as b, o_orderkey % 7 as c from orders)")
def m9_usage(spark, d):
    """Token usage from the field names of three vendors."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    names = [("prompt_tokens", "completion_tokens", "cached_tokens"), ("input_tokens", "output_tokens", "cache_read"), ("promptTokenCount", "candidatesTokenCount", "cachedContentTokenCount")]
    usage = None
    for i, (a, b, c) in enumerate(names):
        j = F.to_json(F.struct(k.alias(a), F.col("o_custkey").alias(b), (k % 7).alias(c)))
        usage = F.when(k % 3 == i, j) if usage is None else usage.when(k % 3 == i, j)
    parsed = o.withColumn("u", F.from_json(usage, "map<string,long>"))
    pick = lambda i: F.coalesce(*(F.try_element_at("u", F.lit(n[i])) for n in names))
    return parsed.select("o_orderkey", (F.greatest(F.lit(0), pick(0) - pick(2)) + pick(2) + pick(1)).alias("total"))


@query(f"select project, chunk_index from {CHUNKS} where state in ('failed', 'translating', 'proofreading', 'reviewing', 'fixing')")
def p3_retry(spark, d):
    return projects.retry_selection(I.chunks(spark, d)).select("project", "chunk_index")


@query(f"select project, count(*) filter (state in ('pending', 'translating', 'proofreading', 'reviewing', 'fixing')) as pending from {CHUNKS} group by 1")
def t10_recovered(spark, d):
    return projects.recovered(I.chunks(spark, d)).groupBy("project").agg(F.count_if(F.col("state") == "pending").alias("pending"))


@query(f"""select c_custkey as project, c_name as name, count(chunk_index) as chunks, count(*) filter (state in ('done', 'flagged')) as done, count(*) filter (state = 'flagged') as flagged, count(*) filter (state = 'failed') as failed from customer join {CHUNKS} on project = c_custkey group by 1, 2""")
def a3_summaries(spark, d):
    p = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), F.col("c_name").alias("name"))
    return projects.summaries(p, I.chunks(spark, d)).where("chunks > 0").select("project", "name", "chunks", "done", "flagged", "failed")


@query("select lower(c_mktsegment) || '-' || (c_custkey // 20) as target, string_agg(c_name, ',' order by c_name) as sources, count(*) as n from customer group by 1 having count(*) > 1")
def a12_shared_targets(spark, d):
    target = F.concat_ws("-", "c_mktsegment", F.floor(F.col("c_custkey") / 20).cast("string"))
    names = table(spark, d, "customer").select(F.col("c_name").alias("name"), target.alias("target"))
    return script.shared_targets(names)


@query("select user_id, least(16, sum(case when v < 1 then 1 else v end))::bigint as slots from (select user_id, event_id % 5 as v from events) group by 1")
def a16_server_slots(spark, d):
    return rollup.server_slots(table(spark, d, "events"), "user_id", F.col("event_id") % 5)


@query("select lower(trim(p_type)) as name, max_by(p_name, p_partkey) as target from part where p_brand like '%1' and p_size > 5 group by 1")
def j11_name_map(spark, d):
    p = table(spark, d, "part")
    entries = p.where("p_brand like '%1'").select(F.col("p_type").alias("source"), F.col("p_name").alias("target"), F.when(F.col("p_size") > 5, " Person ").otherwise("term").alias("type"), F.col("p_partkey").alias("ord"))
    return script.name_map(entries, p.select(F.upper("p_type").alias("label")))


@query("select user_id as request, min(event_id) as ord, case event_type when 'click' then 'view' else event_type end as ref from events where event_type <> 'refund' group by user_id, case event_type when 'click' then 'view' else event_type end")
def j13_resolved_models(spark, d):
    e = table(spark, d, "events")
    wanted = e.select(F.col("user_id").alias("request"), F.col("event_id").alias("ord"), F.col("event_type").alias("name"))
    aliases = spark.createDataFrame([("click", "view")], "alias string, ref string")
    models = e.where("event_type not in ('refund', 'click')").select(F.col("event_type").alias("ref"))
    return routing.resolve(wanted, aliases, models)


@query("select o_orderkey as project, (select p.o_orderkey from orders p where p.o_custkey = o.o_custkey and p.o_orderpriority = o.o_orderpriority and p.o_orderstatus <> o.o_orderstatus order by p.o_orderdate desc, p.o_orderkey limit 1) as older from orders o where exists (select 1 from orders p where p.o_custkey = o.o_custkey and p.o_orderpriority = o.o_orderpriority and p.o_orderstatus <> o.o_orderstatus)")
def j18_older_projects(spark, d):
    o = table(spark, d, "orders")
    return projects.same_source_other_hash(o.select(F.col("o_orderkey").alias("project"), F.col("o_custkey").alias("path"), F.col("o_orderpriority").alias("lang"), F.col("o_orderstatus").alias("hash"), F.col("o_orderdate").alias("updated_at")))


@query("select user_id, min_by(event_type, event_id) as model from events where value > 50 group by 1")
def g9_first_success(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", F.col("event_type").alias("model"), (F.col("value") > 50).alias("ok"))
    return projects.first_success(e, "user_id", "event_id")


@query("select event_id, user_id as request from events e where value > 10 and (event_id % 3 = 0 or not exists (select 1 from events i where i.user_id = e.user_id and i.value > 10 and i.event_id % 3 = 0))")
def p5_usable_models(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("request"), (F.col("value") > 10).alias("available"), F.lit(True).alias("has_client"), F.lit(False).alias("embedding"), (F.col("event_id") % 3 == 0).alias("up"))
    return routing.usable(e).select("event_id", "request")


@query("select p_partkey, case when p_size % 2 = 0 then 1 when p_size % 3 = 0 then greatest(1, p_size % 5) else least(16, greatest(1, p_size)) end::int as workers from part")
def g3_worker_counts(spark, d):
    s = F.col("p_size")
    return table(spark, d, "part").select("p_partkey", projects.worker_count(s % 2 == 1, F.when(s % 3 != 0, s), s % 5).cast("int").alias("workers"))


@query("select conv_id, turn, case when length(text) > 5 and length(substr(text, 1, greatest(1, length(text) - (conv_id % 4) * 30)::int)) between 0.6 * length(text) and 1.6 * length(text) then substr(text, 1, greatest(1, length(text) - (conv_id % 4) * 30)::int) else text end as text from conversations where regexp_matches(text, '^[A-Za-z].*[a-z.]$') and not regexp_matches(substr(text, 1, greatest(1, length(text) - (conv_id % 4) * 30)::int), '[ \\t\\r\\n]$') and length(text) > 5")
def v4_proofread(spark, d):
    """Proofread text within bounds of length replaces the translation."""
    c = table(spark, d, "conversations")
    cut = F.expr("substr(text, 1, cast(greatest(1, length(text) - (conv_id % 4) * 30) as int))")
    rows = c.withColumn("after", cut).where(F.col("text").rlike("^[A-Za-z].*[a-z.]$") & ~F.col("after").rlike("[ \\t\\r\\n]$") & (F.length("text") > 5))
    return rows.select("conv_id", "turn", checks.accept_proofread("text", "text", "after").alias("text"))


@query("select l_orderkey, case when sum(case when l_returnflag = 'R' then 1 else 0 end) > 0 or max(case when l_quantity = 50 then 'e' end) is not null then 'flagged' else 'done' end as state from lineitem group by 1")
def v10_final_states(spark, d):
    by = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("m"), F.max(F.when(F.col("l_quantity") == 50, "e")).alias("e"))
    return by.select("l_orderkey", projects.final_state(F.col("m"), F.col("e")).alias("state"))


_FOUND = "case l_suppkey % 6 when 0 then 'omission' when 1 then 'glossary' when 2 then 'tags' when 3 then 'addition' else 'odd' end"


@query(f"""with r as (select l_orderkey, l_linenumber * 100000 + l_partkey as ord, case when l_partkey % 3 = 0 then 0 else 1 end as p, case when l_partkey % 3 = 0 then 'tags' else {_FOUND} end as type, case when l_partkey % 3 = 0 then 'major' when l_returnflag = 'A' then 'major' else 'minor' end as severity from lineitem),
 t as (select *, case when type = 'odd' then 'mistranslation' else type end as kind from r) select l_orderkey, ord, kind as type, severity from (select *, row_number() over (partition by l_orderkey, kind order by p, ord) as i from t) where p = 0 or i = 1""")
def v9_merged_issues(spark, d):
    """Issues found by rule and by a model, whose types and severities are not all known; the first of a type wins."""
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"), F.expr(_FOUND).alias("type"), F.when(F.col("l_returnflag") == "A", "major").otherwise("nit").alias("severity"), (F.col("l_partkey") % 3 == 0).alias("own"))
    by_rule = rows.where("own").select("l_orderkey", "ord", F.lit("tags").alias("type"), F.lit("major").alias("severity"))
    return checks.merge_reviews(by_rule, rows.where("not own").drop("own"), ["l_orderkey"]).select("l_orderkey", "ord", "type", "severity")


@query("select user_id, floor(epoch_us(ts) / 100000)::bigint as slot, string_agg(event_type, '' order by ts, event_id) as text from events group by 1, 2")
def t6_token_bursts(spark, d):
    from ..operators import limits

    return limits.burst_tokens(table(spark, d, "events"), "user_id", "ts", "event_type", "event_id")


@query()
def t3_lease_states(spark, d):
    """Final states of tasks that clients lease; events of users stand for operations."""
    e = table(spark, d, "events")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) == 1
    op = F.when(first, "add").otherwise(F.element_at(F.array(*map(F.lit, ["lease", "submit_bad", "release", "lease", "submit_ok"])), (F.col("event_id") % 5 + 1).cast("int")))
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return leases.final_states(e.select(F.col("user_id").cast("string").alias("task_id"), ms.alias("ms"), op.alias("op"), F.lit(86_400_000).cast("long").alias("lease_ms")))


@query(f"select doc_id, list_sort(list(distinct substr(text, 1, 1))) as firsts from {SEGMENTS} group by 1")
def u2_distinct_lists(spark, d):
    return lists.distinct_values(I.segments(spark, d), "doc_id", F.substring("text", 1, 1), "firsts")


@query("select p_partkey from part where p_size is not null and p_size not in (select n_nationkey from nation)")
def s27_missing_references(spark, d):
    return script.missing_references(table(spark, d, "part").select("p_partkey", "p_size"), "p_size", table(spark, d, "nation"), "n_nationkey").select("p_partkey")


@query("select event_id, least(8, power(2, event_id % 6))::double as wait from events")
def n10_back_off(spark, d):
    return table(spark, d, "events").select("event_id", limits.back_off(F.col("event_id") % 6).alias("wait"))


@query()
def s17_paragraphs(spark, d):
    """Lines of documents, given places on pages, joined into paragraphs."""
    k = F.col("blk")
    rows = I.segments(spark, d).select("doc_id", k.alias("ord"), F.floor(k / 30).cast("int").alias("page"), (700.0 - (k % 30) * 12.0 - F.floor((k % 30) / 5) * 12.0).alias("y"), F.when(k % 7 == 0, 60.0).otherwise(50.0).alias("x"), (50.0 + F.least(F.lit(450.0), F.length("text") * 5.0)).alias("x_end"), F.when(F.length("text") < 20, 14.0).otherwise(10.0).alias("size"), "text")
    return pages.paragraphs(rows)


@query("select o_custkey, string_agg(o_orderkey::varchar, ',' order by o_orderdate desc, o_orderkey) as projects from orders group by 1")
def o1_newest_first(spark, d):
    return projects.newest_first(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query(f"select project, chunk_index, case when state in ('done', 'flagged') then null when state = 'pending' and project % 4 > 0 then case when project % 4 = 1 then 'rest' when project % 8 = 3 then 'review' else 'proofread' end else 'translate' end as stage from {CHUNKS}")
def t9_resume(spark, d):
    """Where a run goes on with each chunk; pauses left some with a part of their translation, with all of it, or proofread."""
    k, ids = F.col("project"), ["a", "b", "c"]
    texts = lambda names: F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.lit("x") for _ in names)))
    none = F.expr("cast(map() as map<string,string>)")
    translation = F.when(k % 4 == 0, none).when(k % 4 == 1, texts(ids[:1])).otherwise(texts(ids))
    stage = projects.next_stage(F.col("state"), F.array(*map(F.lit, ids)), translation, F.when(k % 8 == 3, texts(ids)).otherwise(none))
    return I.chunks(spark, d).select("project", "chunk_index", stage.alias("stage"))


@query(f"select project, max(chunk_index) - min(chunk_index) as span, arg_max(model, (ts, chunk_index)) as last, arg_min(state, (ts, chunk_index)) as first from {CHUNKS} group by 1")
def w12_first_and_last(spark, d):
    c = I.chunks(spark, d)
    ends = rollup.first_and_last(c, "project", ["ts", "chunk_index"], "state", "model")
    return ends.join(c.groupBy("project").agg((F.max("chunk_index") - F.min("chunk_index")).alias("span")), "project")


@query(f"select project, string_agg(qa_model, ',' order by f) as models from (select project, qa_model, min(chunk_index) as f from {CHUNKS} where qa_model is not null group by 1, 2) group by 1")
def u6_ordered_distinct(spark, d):
    return lists.ordered_distinct(I.chunks(spark, d), "project", "chunk_index", "qa_model").select("project", F.array_join("values", ",").alias("models"))




_CLEAN = "regexp_replace(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), '^ | $', '', 'g')"


@query(f"select doc_id, row_number() over (partition by doc_id order by blk)::int as n, {_CLEAN} as text from {SEGMENTS}")
def k5_books(spark, d):
    """Documents written as EPUB books and read again: a paragraph for each line."""
    from ..sources import epub
    from ..sources.blocks import blocks_of

    lines = I.segments(spark, d).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("blk", "text"))), lambda s: s.text).alias("lines"))

    files = blocks_of(lines, ["doc_id"], "lines", lambda ls: [{"content": epub.build("Book", [("One", [("para", x) for x in ls])])}], {"content": "binary"})
    blocks = epub.read_blocks(files, key="doc_id").where("block_id like 'd1.%' and block_id <> 'd1.t'")
    return blocks.select("doc_id", F.regexp_extract("block_id", r"\.([0-9]+)$", 1).cast("int").alias("n"), "text")


@query(f"select doc_id, list_sort(list(blk::varchar)) as ids, sum(length(text))::bigint as chars from {SEGMENTS} group by 1")
def g5_translated(spark, d):
    """Chunks through the runner, with a model that gives every segment back reversed but forgets the first of many until it is asked again."""
    from ..operators import runner
    from ..operators.stages import new_folder

    def model(request, number, task):
        first = (F.regexp_count(request, F.lit("<seg ")) > 3) & request.startswith("<seg")
        return F.array_join(F.transform(protocol.elements(request), lambda e, i: F.when(first & (i == 0), "").otherwise(X.segment_element(e.id, F.reverse(e.text)))), "\n")

    segs = plan.pack(I.segments(spark, d), ["doc_id"], "blk", 1500).select("doc_id", "chunk", "blk", F.regexp_replace("text", "^[ \t\r\n]+|[ \t\r\n]+$", "").alias("text"))
    chunks = segs.groupBy("doc_id", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("blk", "text"))), lambda s: F.struct(s.blk.cast("string").alias("id"), s.text.alias("text"))).alias("segs"))
    chunks = chunks.withColumn("state", F.lit("pending")).withColumn("final", F.expr("cast(map() as map<string,string>)"))
    done = runner.run(chunks, ["doc_id", "chunk"], model, 1, new_folder(spark, "runs")).groupBy("doc_id").agg(F.flatten(F.collect_list(F.map_entries("final"))).alias("final"))
    return done.select("doc_id", F.array_sort(F.transform("final", lambda e: e.key)).alias("ids"), F.aggregate("final", F.lit(0).cast("long"), lambda a, e: a + F.length(e.value)).alias("chars"))


@query(f"select doc_id, blk::int as line, text from {SEGMENTS}")
def s25_script_lines(spark, d):
    """Documents read as chapter scripts: every line that is translated, by its text."""
    from ..sources import novel

    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return novel.read_blocks(docs).select(F.col("path").cast("long").alias("doc_id"), "line", "text")


@query("select n_nationkey, 'CUSTOM_' || regexp_replace(upper(n_name || '-x.1'), '[^A-Z0-9]+', '_', 'g') || '_API_KEY' as name from nation")
def f12_key_names(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.key_name(F.concat("n_name", F.lit("-x.1"))).alias("name"))


@query("select event_id, case when event_id % 3 = 0 then 'export refused: ' || event_type end as refusal from events")
def f33_refusals(spark, d):
    t = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Error invoking: Error: export refused: "), "event_type")).otherwise(F.col("event_type"))
    return table(spark, d, "events").select("event_id", X.export_refusal(t).alias("refusal"))


@query("select l_suppkey, case when len(xs) > 20 then array_to_string(xs[1:20], ', ') || ' and ' || (len(xs) - 20) || ' more' else array_to_string(xs, ', ') end as list from (select l_suppkey, list_sort(list(distinct l_partkey)) as xs from lineitem group by 1)")
def o9_capped_lists(spark, d):
    xs = F.array_sort(F.collect_set("l_partkey"))
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(X.listed(xs).alias("list"))


@query("select doc_id, (length(text) < 20 or length(text) < (doc_id % 50) * 5) as scanned from documents")
def s19_scanned(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.length("text").alias("chars"), (F.col("doc_id") % 50).alias("pages"))
    return rows.select("doc_id", X.looks_scanned("chars", "pages").alias("scanned"))


@query("select p_partkey, (not contains(lower(p_type), 'tin') and p_size % 2 = 0 and p_size % 7 > 0 and (p_size % 3 > 0 or p_retailprice < 1000)) as offered, (p_size % 5 > 0 and p_retailprice >= 1000) as paid from part")
def p6_offered_models(spark, d):
    """Listed models by id, kind and price; parts stand for models."""
    s = F.col("p_size")
    price = F.when(F.col("p_retailprice") >= 1000, 1.0).otherwise(0.0)
    known = F.when(s % 7 > 0, price)
    offered = X.discoverable("p_type", ["TIN"], s % 2 == 0, known, known, s % 3 == 0)
    return table(spark, d, "part").select("p_partkey", offered.alias("offered"), X.is_paid(s % 5 == 0, price, F.lit(0.0), F.lit(0.0)).alias("paid"))


@query("select n_nationkey, case when n_nationkey % 2 = 0 then ['- Tone: dry'] else []::varchar[] end || case when n_nationkey % 3 = 0 then ['## Characters', '- Ana (f): tall'] else []::varchar[] end as lines from nation")
def f32_brief_additions(spark, d):
    k = F.col("n_nationkey")
    have = F.concat(F.lit("A book. "), F.when(k % 2 == 1, "Its TONE is light. ").otherwise(""), F.when(k % 3 > 0, "With ana.").otherwise(""))
    people = F.array(F.struct(F.lit("Ana").alias("name"), F.lit("f").alias("gender"), F.lit("tall").alias("note")))
    return table(spark, d, "nation").select("n_nationkey", X.brief_additions(have, {"Tone": (F.lit(" dry "), ["tone"]), "Genre": (F.lit(" "), ["genre"])}, people).alias("lines"))


@query("select distinct p_brand, p_type as name from part where p_type not in (select p_type from part where p_size > 45)")
def j12_missing_names(spark, d):
    """Names without a row of their own, each once; large parts have one."""
    p = table(spark, d, "part")
    return lists.without_row(p.select("p_brand", F.col("p_type").alias("name")), p.where("p_size > 45").select(F.col("p_type").alias("name")), "name")


@query("select doc_id, list_sort(list(distinct k)) as missing from (select doc_id, unnest(['en', 'fr', 'de', 'es']) as k, lang from documents) where k <> lang group by 1")
def j17_missing_seeds(spark, d):
    return table(spark, d, "documents").select("doc_id", lists.missing_seeds(F.array("lang"), ["en", "fr", "de", "es"]).alias("missing"))


@query("select event_type, regexp_replace(lower(event_type), '[0-9]+', '#', 'g') as k, count(distinct user_id) as pages from events group by 1, 2")
def a8_distinct_pages(spark, d):
    return pages.distinct_pages(table(spark, d, "events"), ["event_type", X.normalize_repeat("event_type").alias("k")], "user_id")


@query("select user_id, count(*) filter (event_id % 3 = 0) as waiting, count(*) filter (event_id % 3 = 1) as leased from events group by 1")
def a15_queue_counts(spark, d):
    k = F.col("event_id") % 3
    return rollup.queue_counts(table(spark, d, "events"), "user_id", k == 0, k == 1)


@query(f"""with o as (select doc_id, text, blk, row_number() over (partition by doc_id, text order by blk) as i from {SEGMENTS}), n as (select doc_id, blk, case when blk % 11 = 3 then text || '!' else text end as text from {SEGMENTS} where (doc_id + blk) % 7 <> 0),
 m as (select doc_id, text, blk, row_number() over (partition by doc_id, text order by blk) as i from n)
 select doc_id, count(o.blk) filter (m.blk is not null) as kept, count(m.blk) filter (o.blk is null) as new, count(o.blk) filter (m.blk is null) as removed from o full join m using (doc_id, text, i) group by 1""")
def a19_refresh_report(spark, d):
    """Blocks kept, new and removed between two versions, by copies of equal text."""
    old = I.segments(spark, d)
    new = old.where("(doc_id + blk) % 7 <> 0").withColumn("text", F.when(F.col("blk") % 11 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return rollup.version_report(old, new, "doc_id")
