"""Queries of the engine's own operators over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import unicode as U
from ..operators import align, checks, glossary, limits, lists, pages, plan, projects, protocol, rollup, routing, script
from . import inputs as I
from .inputs import BLOCKS, CHUNKS, GLOSSARY, PAIRS, SEGMENTS, TRIM, WS
from .registry import query, table

BUDGET = 150
_PACKED = f"""with recursive s as (select doc_id, blk, tokens + 8 as t, row_number() over (partition by doc_id order by blk) as r from {SEGMENTS}),
 p as (select doc_id, blk, r, t as used, 1 as chunk, t from s where r = 1 union all
  select s.doc_id, s.blk, s.r, case when p.used + s.t > {BUDGET} then s.t else p.used + s.t end, case when p.used + s.t > {BUDGET} then p.chunk + 1 else p.chunk end, s.t from p join s on s.doc_id = p.doc_id and s.r = p.r + 1)"""


@query(f"{_PACKED} select doc_id, chunk, count(*) as segments, sum(t)::bigint as tokens from p group by all")
def w2_packed_chunks(spark, d):
    """Lines of documents packed into chunks of a token budget: the flagship."""
    return plan.chunks(plan.pack(I.segments(spark, d), ["doc_id"], "blk", BUDGET), ["doc_id"])


@query(f"{_PACKED} select doc_id, count(distinct chunk) as chunks, count(*) as segments, sum(t)::bigint as tokens from p group by all")
def a18_document_counts(spark, d):
    packed = plan.pack(I.segments(spark, d), ["doc_id"], "blk", BUDGET)
    return packed.groupBy("doc_id").agg(F.countDistinct("chunk").alias("chunks"), F.count("*").alias("segments"), F.sum(F.col("tokens") + 8).alias("tokens"))


@query(f"select doc_id, blk, text, {TRIM.format('text')} = '' as blank, cast(ceil(length(text) / 4.0) as bigint) as tokens from {BLOCKS}")
def s3_line_blocks(spark, d):
    return I.blocks(spark, d).select("doc_id", "blk", "text", (X.trim_ws("text") == "").alias("blank"), X.rough_tokens("text").alias("tokens"))


@query(f"select doc_id, count(*) as blocks, sum(len(regexp_extract_all(text, '[^ \t\r\n]+')))::bigint as words, sum(tokens)::bigint as tokens from {SEGMENTS} group by all")
def s37_file_facts(spark, d):
    return I.segments(spark, d).groupBy("doc_id").agg(F.count("*").alias("blocks"), F.sum(X.word_count("text")).alias("words"), F.sum("tokens").alias("tokens"))


@query(f"select doc_id, blk, 1 + sum(case when regexp_matches(text, '^(The|In|Of)[^A-Za-z]') then 1 else 0 end) over (partition by doc_id order by blk)::bigint as section from {SEGMENTS}")
def w8_section_numbers(spark, d):
    """Sections go up at heading lines; a line that starts with one of three words stands for a heading."""
    from pyspark.sql import Window

    along = Window.partitionBy("doc_id").orderBy("blk")
    return I.segments(spark, d).select("doc_id", "blk", (1 + F.sum(F.col("text").rlike("^(The|In|Of)[^A-Za-z]").cast("long")).over(along)).alias("section"))


@query("select p_partkey, regexp_matches(regexp_replace(w || ' ' || p_name, '^[ ]+|[ ]+$', '', 'g'), '(?i)^(chapter|part|book|teil)($|[^A-Za-z0-9_])') as heading from (select *, (['Chapter','partly','BOOK','teil','X'])[(p_partkey % 5 + 1)::int] as w from part)")
def s4_chapter_lines(spark, d):
    w = F.element_at(F.array(*map(F.lit, ["Chapter", "partly", "BOOK", "teil", "X"])), (F.col("p_partkey") % 5 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", X.is_chapter_line(F.concat_ws(" ", w, F.col("p_name"))).alias("heading"))


@query("select page_id, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) as title, upper(regexp_extract(html, '(?i)<html lang=\"([a-z]+)\"', 1)) as lang from pages")
def s9_page_titles(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1).alias("title"), F.upper(F.regexp_extract("html", '(?i)<html lang="([a-z]+)"', 1)).alias("lang"))


@query("select lower(regexp_extract(url, '^https?://([^/:?#]+)', 1)) as host, count(*) as n from pages group by all")
def s32_hosts(spark, d):
    return table(spark, d, "pages").groupBy(X.host("url").alias("host")).agg(F.count("*").alias("n"))


@query(f"select doc_id, blk from {BLOCKS} where {TRIM.format('text')} <> ''")
def p1_translatable(spark, d):
    return plan.translatable(I.blocks(spark, d)).select("doc_id", "blk")


@query(f"select project, chunk_index from {CHUNKS} where state in ('pending', 'failed')")
def p2_todo(spark, d):
    return projects.todo(I.chunks(spark, d)).select("project", "chunk_index")


@query("select event_id, length(m) as n, (link >= 0.25) as citation from (select event_id, m, length(u)::double / length(m) as link from (select event_id, 'www.x.org/' || event_type as u, 'www.x.org/' || event_type || repeat(' w', (event_id % 60)::int) as m from events))")
def p8_citations(spark, d):
    m = F.concat(F.lit("www.x.org/"), "event_type", F.repeat(F.lit(" w"), (F.col("event_id") % 60).cast("int")))
    return table(spark, d, "events").select("event_id", F.length(m).alias("n"), X.is_citation(m).alias("citation"))


@query("select c_custkey, coalesce(n_name, c_name) as language from customer left join (select n_name, lower(n_name) as k from nation where n_nationkey % 2 = 0) on k = lower(case when c_custkey % 2 = 0 then (select n_name from nation where n_nationkey = c_nationkey) else c_name end)")
def p11_language_lookup(spark, d):
    """A case-insensitive lookup that passes unknown names through."""
    nation = table(spark, d, "nation")
    c = table(spark, d, "customer").join(F.broadcast(nation.select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("_own"))), "c_nationkey")  # 25 nations
    asked = c.withColumn("asked", F.when(F.col("c_custkey") % 2 == 0, F.lower("_own")).otherwise(F.col("c_name")))
    return projects.looked_up(asked, "asked", nation.where("n_nationkey % 2 = 0"), "n_name").select("c_custkey", F.when((F.col("c_custkey") % 2 == 0) & (F.col("found") == F.col("asked")), F.col("c_name")).otherwise(F.col("found")).alias("language"))


@query("select c_custkey, case when c_custkey % 4 = 0 then null when c_custkey % 4 = 1 then c_mktsegment else c_name end as value from customer")
def p12_patch_merge(spark, d):
    """A patch over a base: absent keeps, empty clears."""
    patch = F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 4 != 1, F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", projects.patched(F.col("c_mktsegment"), patch).alias("value"))


_HITS = f"select s.doc_id, s.blk, g.ord, g.term from (select *, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w from {SEGMENTS}) s join {GLOSSARY} g on list_contains(s.w, g.term)"


@query(f"select doc_id, blk, ord, term from (select *, row_number() over (partition by doc_id, blk order by ord) as r from ({_HITS})) where r <= 5")
def j1_relevant_terms(spark, d):
    """The first five glossary entries that occur in each line."""
    return glossary.relevant_entries(I.segments(spark, d), ["doc_id", "blk"], I.glossary(spark, d), 5).select("doc_id", "blk", "ord", "term")


def _parts(spark, d):
    final = F.when(F.col("l_quantity") >= 4, F.concat(F.lit(" "), "l_returnflag", F.col("l_linenumber").cast("string"), F.lit(" ")))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("project"), F.col("l_linenumber").alias("part"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("parts"), F.concat_ws("-", F.col("l_orderkey").cast("string"), (F.col("l_suppkey") % 3).cast("string")).alias("block_id"), final.alias("final"))


@query("""select project, block_id, string_agg(trim(final), ' ' order by part, final) as text from (
 select l_orderkey as project, l_orderkey || '-' || (l_suppkey % 3) as block_id, l_linenumber as part, l_suppkey % 3 + 1 as parts, case when l_quantity < 4 then null else ' ' || l_returnflag || l_linenumber || ' ' end as final from lineitem)
 where final is not null group by project, block_id having count(*) = max(parts)""")
def j2_block_translations(spark, d):
    """Parts of a block joined, only where all of them have a text; the lines of an order stand for parts."""
    return rollup.translations(_parts(spark, d), ["project"])


@query(f"""with t as (select project, block_id from (select *, project || '-' || (chunk_index % 4) as block_id from {CHUNKS}) where state in ('done', 'flagged', 'reviewing')),
 s as (select *, project || '-' || (chunk_index % 4) as block_id from {CHUNKS}),
 m as (select s.*, t.block_id is null as missing from s left join (select distinct * from t) t using (project, block_id)),
 c as (select * from m where missing or state not in ('done', 'flagged'))
 select c.project, coalesce(max(b.blocks), 0)::bigint as blocks, coalesce(string_agg(chunk_index::varchar, ',' order by chunk_index) filter (state = 'failed'), '') as failed,
 coalesce(string_agg(chunk_index::varchar, ',' order by chunk_index) filter (state in ('translating', 'proofreading', 'reviewing', 'fixing')), '') as running,
 coalesce(string_agg(chunk_index::varchar, ',' order by chunk_index) filter (state in ('pending', 'done', 'flagged')), '') as pending
 from c left join (select project, count(distinct block_id) as blocks from m where missing group by 1) b using (project) group by 1""")
def j3_untranslated_report(spark, d):
    s = I.chunks(spark, d).withColumn("block_id", F.concat_ws("-", F.col("project").cast("string"), (F.col("chunk_index") % 4).cast("string")))
    done = s.where(F.col("state").isin("done", "flagged", "reviewing")).select("project", "block_id").distinct()
    return rollup.untranslated(s, ["project"], done)


@query("""with r as (select p_partkey % 2 as n, p_partkey as ord, lower(regexp_replace(trim(p_type), ' +', ' ', 'g')) || (p_partkey // 2 % 40) as k, p_name as target,
  case when p_partkey % 4 = 0 then 'm' when p_partkey % 2 = 1 and p_partkey % 3 = 0 then 'f' else '' end as gender from part),
 w as (select *, row_number() over (partition by k order by n, ord) as i, greatest(sum(1 - n) over (partition by k), 1) as holder from r),
 g as (select k, first(gender order by n, ord) as later from w where i > holder and gender <> '' group by k)
 select n::int as added, ord, k as source, target, case when i = holder and gender = '' then later else gender end as gender from w left join g using (k) where n = 0 or i = holder""")
def j4_merged_glossary(spark, d):
    """The entries of odd parts merged into those of even ones."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    rows = lambda half, flag, mod: p.where(k % 2 == half).select(k.alias("ord"), F.concat(F.lower(X.collapse("p_type")), (F.floor(k / 2) % 40).cast("string")).alias("source"), F.col("p_name").alias("target"), F.when(k % mod == 0, flag).otherwise("").alias("gender"), F.lit("").alias("note"))
    return glossary.merge_glossaries(rows(0, "m", 4), rows(1, "f", 3)).select("added", "ord", "source", "target", "gender")


def _versions(spark, d):
    old = I.segments(spark, d)
    new = old.where("(doc_id + blk) % 7 <> 0").withColumn("text", F.when(F.col("blk") % 11 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return old, new


@query()
def j5_aligned_blocks(spark, d):
    """Lines of documents against a version with lines dropped and edited."""
    old, new = _versions(spark, d)
    return align.align_blocks(old, new)


_NEW = f"(select doc_id, blk, case when blk % 11 = 3 then text || '!' else text end as text from {SEGMENTS} where (doc_id + blk) % 7 <> 0)"


@query(f"""with o as (select doc_id, blk, text from {SEGMENTS}), n as (select * from {_NEW}), kept as (select doc_id, blk from o join n using (doc_id, blk, text) where (doc_id + blk) % 3 > 0),
 a as (select doc_id, text, blk as old_blk, row_number() over (partition by doc_id, text order by blk) as i from o anti join kept using (doc_id, blk)),
 b as (select doc_id, text, blk as new_blk, row_number() over (partition by doc_id, text order by blk) as i from n anti join kept using (doc_id, blk))
 select doc_id, new_blk, old_blk from a join b using (doc_id, text, i)""")
def j6_moved_blocks(spark, d):
    """What an alignment that found two thirds of the lines in their old places leaves over."""
    old, new = _versions(spark, d)
    kept = old.select("doc_id", F.col("blk").alias("old_blk"), F.col("text").alias("was")).where((F.col("doc_id") + F.col("old_blk")) % 3 > 0)
    found = new.join(kept, (new["doc_id"] == kept["doc_id"]) & (new["blk"] == kept["old_blk"]) & (new["text"] == kept["was"]), "left")
    return align.moved_blocks(old, new, found.select(new["doc_id"], new["blk"].alias("new_blk"), "old_blk"))


@query("""select l_orderkey, l_suppkey % 2 as blk, l_linenumber as part, bool_and(l_partkey % 9 > 0 and l_returnflag in ('A', 'N') and l_quantity > 2) over (partition by l_orderkey, l_suppkey % 2) as kept from lineitem""")
def j7_carried_blocks(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 2).alias("blk"), F.col("l_linenumber").alias("part"), F.lit("t").alias("old_text"), F.when(F.col("l_partkey") % 9 > 0, "t").otherwise("u").alias("text"), F.when(F.col("l_returnflag") == "A", "done").when(F.col("l_returnflag") == "N", "flagged").otherwise("failed").alias("state"), F.when(F.col("l_quantity") > 2, "x").alias("final"))
    return align.carried(rows, ["l_orderkey"]).select("l_orderkey", "blk", "part", "kept")


@query(f"select conv_id, turn, length(source) as source_chars, length(target) as target_chars from {PAIRS}")
def j8_qa_pairs(spark, d):
    return I.pairs(spark, d).select("conv_id", "turn", F.length("source").alias("source_chars"), F.length("target").alias("target_chars"))


@query("select distinct o_custkey from orders o where exists (select 1 from lineitem l where l.l_orderkey = o.o_orderkey and l_quantity > 49)")
def j9_affected(spark, d):
    hot = table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_orderkey").alias("o_orderkey"))
    return checks.affected(table(spark, d, "orders"), hot, ["o_orderkey"]).select("o_custkey").distinct()


_SERVED = "(select event_id, event_type || '-' || user_id as served from events)"
_PROFILES = "(select distinct event_type || case when user_id % 3 = 0 then '' else '-' || (user_id % 10) end as profile from events)"


@query(f"select served, max_by(profile, length(profile)) as profile from (select distinct served from {_SERVED}) s left join {_PROFILES} p on starts_with(served, profile) group by served")
def j14_longest_prefix(spark, d):
    e = table(spark, d, "events")
    user = F.col("user_id").cast("string")
    served = e.select(F.concat_ws("-", "event_type", user).alias("served")).distinct()
    profiles = e.select(F.when(F.col("user_id") % 3 == 0, F.col("event_type")).otherwise(F.concat_ws("-", F.col("event_type"), (F.col("user_id") % 10).cast("string"))).alias("profile")).distinct()
    return routing.longest_prefix(served, profiles)


@query("select s_suppkey, s_name from supplier union all select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)")
def j15_picked_models(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", "s_name")
    return routing.anti_merge(table(spark, d, "customer").select(F.col("c_custkey").alias("s_suppkey"), F.col("c_name").alias("s_name")), s, "s_suppkey")


@query(f"select project, {', '.join(f'count(*) filter (state = {s!r}) as {s}' for s in rollup.STATES)} from {CHUNKS} group by project")
def a1_state_counts(spark, d):
    return rollup.state_counts(I.chunks(spark, d), ["project"])


@query(f"""select project, floor(sum(qa_score) / count(qa_score) * 10 + 0.5) / 10 as score, count(qa_score) as scored,
 coalesce((select string_agg(m, ',' order by f) from (select qa_model as m, min(chunk_index) as f from {CHUNKS} i where i.project = c.project and qa_score is not null and qa_model is not null group by 1)), '') as models,
 coalesce(bool_and(qa_model is distinct from model) filter (qa_score is not null), project % 2 = 0) as independent from {CHUNKS} c group by project""")
def a2_qa_scores(spark, d):
    """Projects with an even number name a reviewer in their settings."""
    return rollup.qa_scores(I.chunks(spark, d).withColumn("reviewer", F.col("project") % 2 == 0), ["project"], "reviewer")


@query("select l_orderkey, l_linenumber, sum(l_quantity)::bigint as tokens_in, sum(l_partkey)::bigint as tokens_out from lineitem group by rollup (l_orderkey, l_linenumber)")
def a4_spend(spark, d):
    return rollup.spend(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber", tokens_in="l_quantity", tokens_out="l_partkey")


@query("select l_orderkey, l_linenumber, (greatest(0, l_partkey - l_suppkey) * 3.0::double + l_suppkey * 0.5::double + l_quantity * 15.0::double) / 1000000 as usd from lineitem")
def a5_usage_cost(spark, d):
    rows = table(spark, d, "lineitem").withColumns({"pi": F.lit(3.0), "pc": F.lit(0.5), "po": F.lit(15.0)})
    return rows.select("l_orderkey", "l_linenumber", X.cost_usd("pi", "pc", "po", "l_partkey", "l_suppkey", "l_quantity").alias("usd"))


_AGENTS = [("translator", False, 3.0, 15.0, 4, 2000), ("proofreader", False, 1.0, 5.0, 4, 2000), ("qa", True, 0.0, 0.0, 4, 2000), ("glossary", False, 1.0, 5.0, 4, 2000)]


@query(f"""with n as (select doc_id, count(*) as n, sum(tokens)::bigint as source, floor(sum(tokens) * 1.2::double + 0.5)::bigint as out from {SEGMENTS} group by 1),
 a as (select * from (values ('translator', false, 3.0::double, 15.0::double), ('proofreader', false, 1.0, 5.0), ('qa', true, 0.0, 0.0), ('glossary', false, 1.0, 5.0)) t(agent, local, pi, po)),
 x as (select doc_id, agent, local, pi, po, case agent when 'glossary' then source + greatest(1, ceil(source / 2000.0))::bigint * 2400 when 'translator' then source + n * 1000 else source + out + n * 1000 end::bigint as tokens_in,
  case agent when 'glossary' then greatest(1, ceil(source / 2000.0))::bigint * 500 when 'qa' then n * 200 else out end::bigint as tokens_out from n cross join a)
 select doc_id, agent, tokens_in, tokens_out, case when local then 0.0::double else (tokens_in * pi + tokens_out * po) / 1000000 end as cost_usd, tokens_out / (case when local then 30 else 80 end)::double / (case when agent = 'glossary' then 1 else 4 end) as seconds from x""")
def a6_estimate(spark, d):
    return rollup.estimate(I.segments(spark, d), ["doc_id"], _AGENTS)


@query("""select l_suppkey, (select q from (select l_quantity as q, sum(l_linenumber) as w, min(l_orderkey * 10 + l_linenumber) as o from lineitem i where i.l_suppkey = l.l_suppkey group by 1) order by w desc, o limit 1) as mode,
 list_sort(list(l_quantity))[(floor(count(*) / 2.0) + 1)::int] as median from lineitem l group by l_suppkey""")
def a7_mode_and_median(spark, d):
    rows = table(spark, d, "lineitem").withColumn("o", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    mode = rollup.weighted_mode(rows, ["l_suppkey"], "l_quantity", "l_linenumber", "o").withColumnRenamed("l_quantity", "mode")
    return rows.groupBy("l_suppkey").agg(rollup.upper_median("l_quantity").alias("median")).join(mode, "l_suppkey")


_MARKED = "(select doc_id, case (case when blk % 5 = 0 then blk % 4 else doc_id % 4 end) when 0 then '– ' when 1 then '<1>„' when 2 then '* «' else '' end || text as text from {})"


def _marked(spark, d):
    """All lines; those of a document open alike but for every fifth."""
    k = F.when(F.col("blk") % 5 == 0, F.col("blk") % 4).otherwise(F.col("doc_id") % 4)
    return I.segments(spark, d).select("doc_id", F.concat(F.when(k == 0, "– ").when(k == 1, "<1>„").when(k == 2, "* «").otherwise(""), F.col("text")).alias("text"))


_STYLES = f"""(select doc_id, case when dash >= 2 * greatest(quotes, guillemets) then 'dash' when quotes >= 2 * greatest(dash, guillemets) then 'quotes' when guillemets >= 2 * greatest(dash, quotes) then 'guillemets' else 'mixed' end as style from (
 select doc_id, count(*) filter (regexp_matches(l, '^[–—―]')) as dash, count(*) filter (regexp_matches(l, '^[„“"”]')) as quotes, count(*) filter (regexp_matches(l, '^[«»]')) as guillemets
 from (select doc_id, regexp_replace(text, '^({WS}|</?[0-9]+/?>|[*_#>])+', '') as l from {_MARKED.format(SEGMENTS)}) group by doc_id) where dash + quotes + guillemets >= 2)"""


@query(f"select * from {_STYLES}")
def a10_dialogue_styles(spark, d):
    return rollup.dialogue_styles(_marked(spark, d), ["doc_id"])


@query(f"""with s as (select doc_id % 20 as project, doc_id as chunk_index, style from {_STYLES}),
 g as (select project, style, string_agg(chunk_index::varchar, ',' order by chunk_index) as chunks, count(*) as n, min(chunk_index) as f from s group by 1, 2)
 select project, style, chunks, style <> first_value(style) over (partition by project order by n desc, f) as offending from g""")
def a11_style_check(spark, d):
    styles = rollup.dialogue_styles(_marked(spark, d), ["doc_id"]).select((F.col("doc_id") % 20).alias("project"), F.col("doc_id").alias("chunk_index"), "style")
    return rollup.style_check(styles, "project")


@query(f"select project, greatest(0, 10 - 3 * count(*) filter (state = 'failed') - count(*) filter (state = 'flagged')) as score from {CHUNKS} group by project")
def a13_issue_scores(spark, d):
    return I.chunks(spark, d).groupBy("project").agg(checks.issue_score(F.count_if(F.col("state") == "failed"), F.count_if(F.col("state") == "flagged")).alias("score"))


@query(f"select project, count(*) filter (state in ('done', 'flagged')) as done, count(*) as total, case when count(*) filter (state in ('done', 'flagged')) > 0 then floor(600.0::double / count(*) filter (state in ('done', 'flagged')) * (count(*) - count(*) filter (state in ('done', 'flagged'))) + 0.5)::bigint end as eta from {CHUNKS} group by project")
def a14_progress(spark, d):
    return rollup.progress(I.chunks(spark, d), ["project"], F.lit(600.0))


@query("select ctx, case when ctx is null then 2375 else greatest(100, least(1500, floor((ctx - 1400 - ceil(ctx * 0.15::double)) / 2.3::double)))::bigint end as budget from (select case when p_partkey % 50 = 0 then null else p_partkey * 8 end as ctx from part)".replace("2375", "least(1500, floor((8192 - 1400 - ceil(8192 * 0.15::double)) / 2.3::double))::bigint"))
def a17_chunk_budgets(spark, d):
    rows = table(spark, d, "part").select(F.when(F.col("p_partkey") % 50 != 0, F.col("p_partkey") * 8).alias("ctx"))
    return rows.select("ctx", plan.chunk_budget(F.col("ctx")).alias("budget"))


@query(f"{_PACKED}, x as (select p.doc_id, p.chunk, p.blk, s.text from p join {SEGMENTS} s using (doc_id, blk)), r as (select *, dense_rank() over (partition by doc_id, chunk order by blk desc) as r from x), t as (select doc_id, chunk + 1 as chunk, string_agg(text, chr(10) || chr(10) order by blk) as t from r where r <= 2 group by 1, 2) select doc_id, chunk, case when length(t) > 1200 then '...' || right(t, 1200) else t end as source, reverse(case when length(t) > 1200 then '...' || right(t, 1200) else t end) as translation from t")
def w1_previous_tails(spark, d):
    packed = plan.pack(I.segments(spark, d), ["doc_id"], "blk", BUDGET).withColumn("final", F.col("text"))
    return plan.previous_tails(packed, ["doc_id"]).withColumn("translation", F.reverse("translation"))


@query("select user_id, event_id, sum(c) over (partition by user_id order by ts, event_id) as run from (select *, case when row_number() over w = 1 or event_type is distinct from lag(event_type) over w then 1 else 0 end as c from events window w as (partition by user_id order by ts, event_id))")
def w6_runs(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    return align.runs(e, ["user_id"], "o", "event_type").select("user_id", "event_id", "run")


@query("select p_brand, p_partkey, p_brand || '-' || row_number() over (partition by p_brand order by p_partkey) as alias from part")
def w9_aliases(spark, d):
    return routing.numbered_aliases(table(spark, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey")


@query(f"select doc_id, blk, last_value(case when length(text) < 40 then text end ignore nulls) over (partition by doc_id order by blk) as heading from {SEGMENTS}")
def w10_carried_headings(spark, d):
    """The last heading before each line; a short line stands for a heading."""
    return lists.carried_forward(I.segments(spark, d), "doc_id", "blk", F.when(F.length("text") < 40, F.col("text")), "heading").select("doc_id", "blk", "heading")


@query("select user_id, event_id from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as r from events) where r <= 3")
def w11_live_tails(spark, d):
    return lists.newest_rows(table(spark, d, "events"), "user_id", [F.col("ts").desc(), F.col("event_id").desc()]).select("user_id", "event_id")


@query(f"select conv_id, turn, regexp_extract_all(source, '<(?:/[0-9]+|[0-9]+/?)>') as tags, regexp_replace(source, '<(?:/[0-9]+|[0-9]+/?)>', '', 'g') as plain from {PAIRS}")
def f1_tag_tokens(spark, d):
    return I.pairs(spark, d).select("conv_id", "turn", X.tag_tokens("source").alias("tags"), X.strip_tags("source").alias("plain"))


@query("select p_partkey, lower(regexp_replace(trim(p_type), ' +', ' ', 'g')) as key from part")
def f4_normalized_terms(spark, d):
    return table(spark, d, "part").select("p_partkey", U.normalize_term("p_type").alias("key"))


@query(f"select doc_id, blk, regexp_extract(text, '^[ \\t]*') || 'X' as fitted from (select doc_id, blk, repeat(' ', (blk % 4)::int) || text as text from {SEGMENTS})")
def f8_fit_edges(spark, d):
    t = F.concat(F.repeat(F.lit(" "), (F.col("blk") % 4).cast("int")), F.col("text"))
    return I.segments(spark, d).select("doc_id", "blk", X.fit_edges(t, F.lit("  X ")).alias("fitted"))


@query(f"select doc_id, len(regexp_extract_all(text, '[^ \t\r\n]+')) as words from documents")
def f9_word_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.word_count("text").alias("words"))


@query("select conv_id, turn, text as prose from conversations where text = regexp_replace(text, '^[ \\t\\r\\n]+|[ \\t\\r\\n]+$', '', 'g')")
def f10_clean_prose(spark, d):
    c = table(spark, d, "conversations").where(X.trim_ws("text") == F.col("text"))
    wrapped = F.concat(F.lit("<think>a\nb</think>\n```text\n"), F.col("text"), F.lit("\n```"))
    return c.select("conv_id", "turn", X.clean_prose(wrapped).alias("prose"))


@query("select p_partkey, left(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), 40) as slug from part")
def f11_slugs(spark, d):
    return table(spark, d, "part").select("p_partkey", U.slug("p_name").alias("slug"))


@query(f"select doc_id, blk, case when length(text) <= 30 then text else regexp_replace(substr(text, 1, 29), '{WS}+$', '') || '…' end as short from {SEGMENTS}")
def f13_cut(spark, d):
    return I.segments(spark, d).select("doc_id", "blk", X.cut("text", 30).alias("short"))


@query("select n_nationkey, 'Translate to ' || n_name || ' ().' as prompt from nation")
def f14_templates(spark, d):
    t = F.lit("Translate to {{language}} ({{unknown}}).")
    return table(spark, d, "nation").select("n_nationkey", X.render_template(t, {"language": F.col("n_name")}).alias("prompt"))


@query(f"select doc_id, string_agg('<seg id=\"' || blk || '\">' || text || '</seg>', chr(10) order by blk) as request from {SEGMENTS} group by doc_id")
def f15_segment_requests(spark, d):
    return protocol.format_segments(I.segments(spark, d).withColumn("seg_id", F.col("blk").cast("string")), ["doc_id"], "blk")


@query(f"select doc_id, trim(regexp_replace(text, '{WS}*\\r?\\n{WS}*', ' ', 'g'), chr(32) || chr(9) || chr(10) || chr(13)) as line from documents")
def f18_one_line(spark, d):
    return table(spark, d, "documents").select("doc_id", X.one_line("text").alias("line"))


@query("select page_id, replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as xml from pages")
def f21_escaped_xml(spark, d):
    return table(spark, d, "pages").select("page_id", X.escape_xml("html").alias("xml"))


@query("select user_id, (['ar', 'he-IL', 'en', 'fa_IR', 'fr'])[(user_id % 5 + 1)::int] as lang, user_id % 5 in (0, 1, 3) as rtl from (select distinct user_id from events)")
def f22_right_to_left(spark, d):
    lang = F.element_at(F.array(*map(F.lit, ["ar", "he-IL", "en", "fa_IR", "fr"])), (F.col("user_id") % 5 + 1).cast("int"))
    return table(spark, d, "events").select("user_id").distinct().select("user_id", lang.alias("lang"), X.is_rtl(lang).alias("rtl"))


@query(f"select doc_id, blk, case when regexp_matches(t, '^(#|>|[-*+][ \\t]|[0-9]+[.)][ \\t])') then '\\' || t else t end as line from (select doc_id, blk, case blk % 4 when 0 then '- ' when 1 then '1. ' when 2 then '#' else '' end || text as t from {SEGMENTS})")
def f23_escaped_lines(spark, d):
    k = F.col("blk") % 4
    t = F.concat(F.when(k == 0, "- ").when(k == 1, "1. ").when(k == 2, "#").otherwise(""), F.col("text"))
    return I.segments(spark, d).select("doc_id", "blk", X.escape_line_start(t).alias("line"))


@query("select p_partkey, case p_partkey % 4 when 0 then 'qwen' when 1 then 'poolside' when 2 then 'acme' else 'unknown' end as family from part")
def f24_families(spark, d):
    k = F.col("p_partkey") % 4
    ident = F.when(k == 0, "Qwen3-8b").when(k == 1, "laguna-x").when(k == 2, "acme/thing").otherwise("thing")
    return table(spark, d, "part").select("p_partkey", X.guess_family(ident).alias("family"))


@query("select event_id, case when event_id % 5 = 0 then 'daily' when event_id % 5 = 1 then 'retry' when event_id % 5 = 2 then 'context' when event_id % 5 = 3 then 'retry' else 'fatal' end as class from events")
def f29_error_classes(spark, d):
    k = F.col("event_id") % 5
    status = F.when(k < 2, 429).when(k == 2, 400).when(k == 3, 503).otherwise(404)
    message = F.when(k == 0, "free-models-per-day").when(k == 2, "maximum context reached").otherwise("no")
    return table(spark, d, "events").select("event_id", X.error_class(status, message).alias("class"))


@query("select o_orderkey, case when k < 90 then k || 's' when k < 5400 then floor(k / 60.0 + 0.5)::bigint || ' min' else (floor(k / 360.0 + 0.5) / 10)::decimal(20,1) || ' h' end as duration, case when k >= 10000 then floor(k / 1000.0 + 0.5)::bigint || 'k' when k >= 1000 then (floor(k / 1000.0 * 10 + 0.5) / 10)::decimal(20,1) || 'k' else k::varchar end as count from (select o_orderkey, o_orderkey % 20000 as k from orders)")
def f30_display(spark, d):
    k = F.col("o_orderkey") % 20000
    return table(spark, d, "orders").select("o_orderkey", X.format_duration(k).alias("duration"), X.format_count(k).alias("count"))


@query("select o_orderkey, floor(greatest(0.0::double, least(10.0::double, try_cast(replace(s, ',', '.') as double))) * 10 + 0.5) / 10 as score from (select o_orderkey, case o_orderkey % 4 when 0 then '7,25' when 1 then '12' when 2 then 'good' else (o_orderkey % 100) / 10.0 || '' end as s from orders)")
def n3_scores(spark, d):
    k = F.col("o_orderkey") % 4
    s = F.when(k == 0, " 7,25 ").when(k == 1, "12").when(k == 2, "good").otherwise(((F.col("o_orderkey") % 100) / 10).cast("string"))
    return table(spark, d, "orders").select("o_orderkey", X.parse_score(s).alias("score"))


@query("select doc_id, sha256(text) as hash from documents")
def n5_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash("text").alias("hash"))


@query("select event_id, cast(ts as date) as day, cast(cast(ts as date) + 1 as date) as resets from events")
def n8_utc_days(spark, d):
    ts = F.col("ts")
    return table(spark, d, "events").select("event_id", limits.utc_day(ts).alias("day"), limits.next_utc_day(ts).alias("resets"))


@query("select event_id, count(*) over (partition by user_id order by ts range between interval 59999999 microseconds preceding and interval 1 microseconds preceding) as in_window from events")
def t1_minute_window(spark, d):
    return limits.minute_waits(table(spark, d, "events"), "user_id", "ts", 1).select("event_id", "in_window")


@query("select event_id, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id)::int as today, row_number() over (partition by user_id, cast(ts as date) order by ts, event_id) <= 2 as admitted from events")
def t2_daily_limit(spark, d):
    return limits.daily(table(spark, d, "events"), "user_id", "ts", "event_id", 2).select("event_id", "today", "admitted")


@query("with e as (select user_id, ts as t, 1 as x from events union all select user_id, ts + interval 2 hours, -1 from events), r as (select user_id, sum(x) over (partition by user_id order by t, x rows unbounded preceding) as n from e) select user_id, max(n)::bigint as most from r group by 1")
def t4_most_at_once(spark, d):
    e = table(spark, d, "events").withColumn("end", F.col("ts") + F.expr("interval 2 hours"))
    return limits.most_at_once(e, "user_id", "ts", "end")


@query("select user_id, max_by(event_type, (ts, event_id)) as event_type from events group by 1")
def t5_latest_state(spark, d):
    return limits.latest(table(spark, d, "events"), "user_id", "ts", "event_id", "event_type")


_TAGS = "list_sort(regexp_extract_all({}, '<(?:/[0-9]+|[0-9]+/?)>'))"


@query(f"""select conv_id, turn, s = t and nested as ok, not nested as misnested from (select conv_id, turn, {_TAGS.format('source')} as s, {_TAGS.format('target')} as t,
 replace(replace(array_to_string(regexp_extract_all(target, '<(?:/[0-9]+|[0-9]+)>'), ''), '<2></2>', ''), '<1></1>', '') = '' as nested from {PAIRS})""")
def v1_tag_checks(spark, d):
    c = I.pairs(spark, d).select("conv_id", "turn", checks.tag_check("source", "target").alias("c"))
    return c.select("conv_id", "turn", "c.ok", "c.misnested")


@query(f"""with p as (select *, {_TAGS.format('source')} as st, {_TAGS.format('target')} as tt, replace(array_to_string(regexp_extract_all(target, '<(?:/[0-9]+|[0-9]+)>'), ''), '<1></1>', '') = '' as nested,
 {TRIM.format("regexp_replace(source, '<(?:/[0-9]+|[0-9]+/?)>', '', 'g')")} as s, {TRIM.format("regexp_replace(target, '<(?:/[0-9]+|[0-9]+/?)>', '', 'g')")} as t from {PAIRS}),
 q as (select *, s = t and s <> '' and len(regexp_extract_all(s, '[^ \t\r\n]+')) >= 3 as same, length(t)::double / greatest(length(s), 1) as ratio from p)
 select conv_id, turn, 0 as ord, 'tags' as type, 'major' as severity from q where not (st = tt and nested) union all select conv_id, turn, 1, 'untranslated', 'major' from q where same
 union all select conv_id, turn, 2, 'omission', 'major' from q where not same and length(s) >= 25 and ratio < 0.4 union all select conv_id, turn, 3, 'addition', 'minor' from q where not same and length(s) >= 25 and ratio > 2.5""")
def v2_deterministic_issues(spark, d):
    return checks.plain_issues(I.pairs(spark, d), ["conv_id", "turn"])


@query()
def v2_glossary_issues(spark, d):
    return checks.glossary_issues(I.pairs(spark, d), ["conv_id", "turn"], I.glossary(spark, d))


@query("select p_partkey, case p_partkey % 6 when 0 then 'is empty' when 1 then 'is more than one line' when 2 then 'contains an inline placeholder tag' when 3 then 'begins with a structural label' when 4 then 'contains a scene or beat id' end as problem from part")
def v7_catalog_values(spark, d):
    k = F.col("p_partkey") % 6
    n = F.col("p_name")
    value = F.when(k == 0, "  ").when(k == 1, F.concat(n, F.lit("\nx"))).when(k == 2, F.concat(n, F.lit("<2/>"))).when(k == 3, F.concat(F.lit("** on screen : "), n)).when(k == 4, F.concat(n, F.lit(" ch01.s02.b003"))).otherwise(n)
    return table(spark, d, "part").select("p_partkey", X.catalog_problem(value).alias("problem"))


@query("select conv_id, list_sort(list(turn::varchar)) as ids, case when conv_id % 3 = 0 then ['0'] else []::varchar[] end as missing, case when conv_id % 3 = 1 then ['x'] else []::varchar[] end as extra, case when conv_id % 4 = 1 then ['0'] else []::varchar[] end as duplicate from conversations where conv_id in (select conv_id from conversations where turn = 0) group by conv_id".replace("case when conv_id % 4 = 1 then ['0'] else []::varchar[] end as duplicate", "case when conv_id % 4 = 1 and conv_id % 3 <> 0 then ['0'] else []::varchar[] end as duplicate"))
def x2_parsed_replies(spark, d):
    """Replies with an element blank, one too many or one twice."""
    c = table(spark, d, "conversations")
    k = F.col("conv_id")
    body = F.when((k % 3 == 0) & (F.col("turn") == 0), " ").otherwise(F.concat(F.lit("t"), F.col("turn").cast("string")))
    rows = c.select("conv_id", "turn", F.col("turn").cast("string").alias("seg_id"), body.alias("text"))
    req = protocol.format_segments(rows, ["conv_id"], "turn").join(c.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.col("turn").cast("string"))).alias("ids"), F.min("turn").alias("low")).where("low = 0"), "conv_id")
    reply = F.concat(F.lit("Sure:\n"), F.col("request"), F.when(k % 3 == 1, "<seg id='x'>y</seg>").otherwise(""), F.when((k % 4 == 1) & (k % 3 != 0), "<seg id=0>other</seg>").otherwise(""))
    return protocol.with_parsed(req.withColumn("reply", reply), "reply", "ids", "p").select("conv_id", "ids", "p.missing", "p.extra", "p.duplicate")


@query("select user_id, list(event_id order by event_id)[1:60] as hits from events group by user_id")
def o5_first_hits(spark, d):
    return lists.first_hits(table(spark, d, "events"), "user_id", "event_id")


@query("select k, problem from (select s_suppkey as k, 'missing' as problem from supplier where s_suppkey not in (select c_custkey from customer where c_custkey % 3 > 0) union all select c_custkey, 'unknown' from customer where c_custkey % 3 > 0 and c_custkey not in (select s_suppkey from supplier))")
def u1_key_parity(spark, d):
    expected = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"))
    return script.key_parity(expected, table(spark, d, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("k")), "k")


@query("select p_brand, p_size, count(*) as n from part group by 1, 2 having count(*) > 1")
def s27_duplicate_keys(spark, d):
    return script.duplicate_keys(table(spark, d, "part"), ["p_brand", "p_size"])


@query(f"""with l as (select doc_id, blk // 8 as page, blk, blk % 8 in (0, 7) as margin, case when blk % 8 = 0 then 'Head ' || (blk // 8) when blk % 16 = 7 then '- ' || blk || ' -' else text end as text from {SEGMENTS}),
 k as (select *, regexp_replace(lower(text), '[0-9]+', '#', 'g') as k from l where margin), n as (select doc_id, greatest(2, ceil(count(distinct page) / 2.0)) as need from l group by 1),
 o as (select k.doc_id, k.k from k join n using (doc_id) group by k.doc_id, k.k, n.need having count(distinct page) >= n.need)
 select doc_id, blk from l where not margin union all select k.doc_id, k.blk from k where not (k.blk % 16 = 7) and not exists (select 1 from o where o.doc_id = k.doc_id and o.k = regexp_replace(k.k, '[ \\t\\r\\n]+', ' ', 'g')) and not regexp_matches(k.text, '^[-–— ]*[0-9]+[-–— ]*$')""")
def s16_running_lines(spark, d):
    """Eight lines a page; the first is a running head, the last of every other page a page number."""
    k = F.col("blk")
    lines = I.segments(spark, d).select("doc_id", F.floor(k / 8).cast("int").alias("page"), "blk", (k % 8).isin(0, 7).alias("margin"), F.when(k % 8 == 0, F.concat(F.lit("Head "), F.floor(k / 8).cast("string"))).when(k % 16 == 7, F.concat(F.lit("- "), k.cast("string"), F.lit(" -"))).otherwise(F.col("text")).alias("text"))
    return pages.without_running_lines(lines).select("doc_id", "blk")


@query("select o_custkey as doc_id, min(level) as level from (select o_custkey, length(o_orderpriority) % 4 as level, count(*) as n from orders group by 1, 2) where n >= 2 group by 1")
def s18_split_levels(spark, d):
    return pages.split_level(table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), (F.length("o_orderpriority") % 4).alias("level")))


@query("select c_custkey, (['blank','heading','scene','cast','puzzle','clue','direction','line','break','narration'])[(c_custkey % 10 + 1)::int] as cls from customer")
def s21_script_classes(spark, d):
    k = (F.col("c_custkey") % 10 + 1).cast("int")
    samples = ["  ", "## {}", "**Scene:** {}", "ON SCREEN: {}", "PUZZLE: box (lock)", "CLUE: box/key: {}", "FADE TO BLACK.", "PETRA (low): {}.", "* * *", "She saw {}."]
    line = F.replace(F.element_at(F.array(*map(F.lit, samples)), k), F.lit("{}"), F.col("c_name"))
    return table(spark, d, "customer").select("c_custkey", script.line_class(line).alias("cls"))


@query(f"select doc_id, string_agg(case when length(t) < 40 then '## ' || t else case when regexp_matches(t, '^(#|>|[-*+][ \\t]|[0-9]+[.)][ \\t])') then '\\' || t else t end end, chr(10) || chr(10) order by blk) || chr(10) as md from (select doc_id, blk, {TRIM.format('text')} as t from {SEGMENTS}) group by doc_id")
def k6_markdown(spark, d):
    """Documents as Markdown; a short line stands for a heading."""
    from ..sources.markdown import to_markdown

    rows = I.segments(spark, d).withColumn("kind", F.when(F.length(X.trim_ws("text")) < 40, "heading").otherwise("para")).withColumn("level", F.lit(None).cast("int"))
    return to_markdown(rows, ["doc_id"], "blk")
