"""Queries of whole runs: the runner over conversations, alias chains, glossary passes, refreshed chunk lists, limits, names, digests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align, chains, checks, digests, glossary, limits, plan, projects, protocol, routing, runner, script
from ..operators.stages import new_folder
from . import inputs as I
from .inputs import GLOSSARY, PAIRS, SEGMENTS, TRIM
from .queries import _PACKED, BUDGET
from .registry import query, table


def column_model(request, model, task):
    """A model whose faults follow the number before the colon of the segment ids, modulo 8 (the last: 16):

    1 the first model leaves out the last of several; 2 it adds an unknown segment; 3 any model loses a tag of more than two; 4 no model
    gives segment 0; 5 the first of several comes twice, unlike; 6 all are blank but after a note; 7 the source comes back, for 7 mod 16 also
    when it is to be mended.
    """
    kind = F.pmod(F.regexp_extract(request, 'id="(-?[0-9]+):', 1).cast("long"), F.lit(16))
    n, fault = F.regexp_count(request, F.lit("<seg ")), kind % 8
    no_note = request.startswith("<seg")

    def answer(e, i):
        good = F.concat(F.lit("Xx "), e.text)
        one = lambda text: X.segment_element(e.id, text)
        return (
            F.when((fault == 1) & (model == 0) & (n > 1) & (i == n - 1), "")
            .when((fault == 3) & (n > 2), one(F.replace(good, F.lit("</1>"), F.lit(""))))
            .when((fault == 4) & e.id.endswith(":0"), "")
            .when((fault == 5) & (n > 1) & (i == 0), F.concat(one(good), one(F.lit("other"))))
            .when((fault == 6) & no_note, one(F.lit(" ")))
            .when((fault == 7) & ((task == "translate") | (kind == 7)), one(e.text))
            .otherwise(one(good))
        )

    unknown = F.when((fault == 2) & (model == 0), '<seg id="zzz">?</seg>').otherwise("")
    return F.concat(F.array_join(F.transform(protocol.elements(request), answer), "\n"), unknown)


def conversation_chunks(spark, d):
    """(conv_id, state, segs, final): a conversation is a chunk, its turns are segments in a tag pair; some were done or at work before."""
    c = table(spark, d, "conversations").where(X.trim_ws("text") != "")
    turn = Window.partitionBy("conv_id").orderBy("turn")
    seg_id = F.concat_ws(":", "conv_id", (F.row_number().over(turn) - 1).cast("string"))
    text = F.concat(F.lit("<1>"), F.translate("text", "<>`", "()'"), F.lit("</1>"))
    segs = c.select("conv_id", "turn", seg_id.alias("id"), text.alias("text")).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", "text"))).alias("s"))
    state = F.when(F.col("conv_id") % 11 == 0, "done").when(F.col("conv_id") % 11 == 1, "translating").otherwise("pending")
    return segs.select("conv_id", state.alias("state"), F.transform("s", lambda s: F.struct(s.id, s.text)).alias("segs"), F.expr("cast(map() as map<string,string>)").alias("final"))


_PLAIN = TRIM.format("translate(text, '<>`', '()''')")


@query(f"""with recursive s as (select conv_id, row_number() over (partition by conv_id order by turn) - 1 as i, length(text) + 7 as chars,
  regexp_matches({_PLAIN}, '\\p{{L}}{{2}}') and len(regexp_extract_all({_PLAIN}, '[^ \\t\\r\\n]+')) >= 3 as seen from conversations where {TRIM.format("text")} <> ''),
 c as (select conv_id, conv_id % 11 = 0 as old, ((conv_id % 16) + 16) % 16 as k, count(*) as n, sum(chars) as chars, sum(case when i = 0 then chars else 0 end) as first, count(*) filter (seen) as seen from s group by conv_id),
 h as (select conv_id, n from c where k % 8 = 3 union all select conv_id, case when x = 0 then (n + 1) // 2 else n // 2 end from h, (select unnest([0, 1]) as x) where n > 2),
 t as (select conv_id, sum(case when n > 2 then 4 else 1 end) as asks from h group by all)
 select conv_id, case when old then 'done' when k % 8 = 4 then 'failed' when k = 7 and seen > 0 then 'flagged' else 'done' end as state,
  (case when old then 0 when k % 8 = 4 then n - 1 else n end)::bigint as n_final,
  coalesce((case when old then 0 when k % 8 = 4 then chars - first + 3 * (n - 1) when k = 7 then chars when k = 15 then chars + 3 * seen else chars + 3 * n end), 0)::bigint as chars,
  (case when old then 0 when k % 8 in (1, 5) then least(n, 2) when k % 8 = 2 then 3 when k % 8 = 3 then t.asks when k % 8 = 4 then case when n > 1 then 5 else 4 end when k % 8 = 6 then 2 when k % 8 = 7 then 1 + (seen > 0)::int else 1 end)::bigint as asks
 from c left join t using (conv_id)""")
def g1_project_runs(spark, d):
    """Chunks run to done, flagged or failed in rounds: asking again, salvage, the next model, halves, review and mending."""
    out = runner.run(conversation_chunks(spark, d), ["conv_id"], column_model, 2, new_folder(spark, "runs"))
    chars = F.aggregate(F.map_values("final"), F.lit(0).cast("long"), lambda n, t: n + F.length(t))
    return out.select("conv_id", "state", F.size("final").cast("long").alias("n_final"), chars.alias("chars"), "asks")


_TARGET = "case when event_id % 50 = 0 then 'm' || event_id when event_id % 101 = 1 then 'a' || event_id + 1 when event_id % 101 = 2 then 'a' || event_id - 1 when event_id < 8 then 'm' || event_id else 'a' || event_id - event_id % 7 - 1 end"


@query(f"""with recursive e as (select 'a' || event_id as alias, {_TARGET} as target from events),
 r as (select alias, target, 1 as steps from e union select r.alias, e.target, least(r.steps + 1, 60) from r join e on e.alias = r.target where r.steps < 60),
 last as (select alias, target, steps from r where target like 'm%')
 select e.alias, last.target, last.steps::bigint as steps, last.alias is null as circular from e left join last using (alias)""")
def m8_resolved_aliases(spark, d):
    """Aliases that lead down to every fiftieth, which names a model, but for some that lead round in a circle."""
    k = F.col("event_id")
    a = lambda n: F.concat(F.lit("a"), n.cast("string"))
    m = F.concat(F.lit("m"), k.cast("string"))
    target = F.when(k % 50 == 0, m).when(k % 101 == 1, a(k + 1)).when(k % 101 == 2, a(k - 1)).when(k < 8, m).otherwise(a(k - k % 7 - 1))
    return chains.resolved(table(spark, d, "events").select(a(k).alias("alias"), target.alias("target")), new_folder(spark, "chains"))


_DEFAULTS = "map {'b': case when p_partkey % 2 = 0 then p_brand end, 'a': case when p_partkey % 3 = 0 then p_type end, 'c': case when p_partkey % 5 = 0 then '' end}"


@query(f"""with p as (select p_partkey, case when p_partkey % 4 = 0 then [p_name] when p_partkey % 4 = 1 then [] end as given, {_DEFAULTS} as defaults, case when p_partkey % 7 > 2 then ['c', 'x', 'b'] end as "order" from part),
 l as (select p_partkey, given, list_filter(list_transform("order", lambda g: defaults[g]), lambda x: x is not null and x <> '') as a, list_filter([defaults['a'], defaults['b'], defaults['c']], lambda x: x is not null and x <> '') as b from p)
 select p_partkey, case when len(given) > 0 then given when len(a) > 0 then a when len(b) > 0 then b else ['near/small', 'far/large'] end as fallbacks from l""")
def m8_fallback_lists(spark, d):
    k = F.col("p_partkey")
    given = F.when(k % 4 == 0, F.array("p_name")).when(k % 4 == 1, F.expr("cast(array() as array<string>)"))
    defaults = F.create_map(F.lit("b"), F.when(k % 2 == 0, F.col("p_brand")), F.lit("a"), F.when(k % 3 == 0, F.col("p_type")), F.lit("c"), F.when(k % 5 == 0, F.lit("")))
    order = F.when(k % 7 > 2, F.array(F.lit("c"), F.lit("x"), F.lit("b")))
    return table(spark, d, "part").select("p_partkey", chains.fallback_list(given, defaults, order, ["near/small", "far/large"]).alias("fallbacks"))


_LISTED = "(select user_id, list({'ref': case when event_id % 9 = 0 then 'role' else 'p' || event_id % 4 || '/m' || event_id % 3 end, 'kind': 'p' || event_id % 4, 'client': event_id % 4 = 3 and event_id % 9 > 0} order by event_id)[1:6] as refs from events group by user_id)"
_ROWS = "[" + ", ".join(f"{{'now': '{r}', 'was': '{r}', 'kind': '{r.split('/')[0]}', 'taken': false}}" for r in ("p0/m1", "p1/m0", "p0/m2", "p2/m0", "p1/m2", "q/x")) + "]"


@query(f"""with recursive l as (select user_id, refs, list_filter(refs, lambda r: r.ref like '%/%' and not r.client) as mine from {_LISTED}),
 f as (select user_id, refs, mine, 1 as i, {_ROWS} as slots, []::varchar[] as placed from l union all
  select user_id, refs, mine, i + 1, case when pos > 0 then list_transform(slots, lambda s, k: case when k = pos then {{'now': ref, 'was': s.was, 'kind': s.kind, 'taken': true}} else s end) else slots end, case when pos > 0 then list_append(placed, ref) else placed end
  from (select *, mine[i].ref as ref, coalesce(nullif(coalesce(list_position(list_transform(slots, lambda s: not s.taken and s.was = mine[i].ref), true), 0), 0), list_position(list_transform(slots, lambda s: not s.taken and s.kind = mine[i].kind), true), 0) as pos from f where i <= len(mine))),
 z as (select *, list_transform(list_filter(slots, lambda s: s.taken and s.now <> s.was), lambda s: s.was) as gone from f where i = len(mine) + 1),
 o as (select user_id, list_concat(list_transform(list_filter(refs, lambda r: r.client), lambda r: r.ref), list_transform(slots, lambda s: s.now), list_transform(list_filter(refs, lambda r: not list_contains(placed, r.ref) and not list_contains(gone, r.ref)), lambda r: r.ref)) as xs from z)
 select user_id, list_filter(xs, lambda x, i: list_position(xs, x) = i) as "order" from o""")
def o2_shared_order(spark, d):
    """Lists of six models under one order of six rows: own rows, rows of their kind, clients first, aliases last."""
    k = F.col("event_id")
    kind = F.concat(F.lit("p"), (k % 4).cast("string"))
    ref = F.when(k % 9 == 0, "role").otherwise(F.concat(kind, F.lit("/m"), (k % 3).cast("string")))
    one = F.struct(k, ref.alias("ref"), kind.alias("kind"), ((k % 4 == 3) & (k % 9 > 0)).alias("client"))
    lists = table(spark, d, "events").groupBy("user_id").agg(F.slice(F.array_sort(F.collect_list(one)), 1, 6).alias("refs"))
    rows = F.array(*(F.struct(F.lit(r).alias("ref"), F.lit(r.split("/")[0]).alias("kind")) for r in ("p0/m1", "p1/m0", "p0/m2", "p2/m0", "p1/m2", "q/x")))
    return lists.select("user_id", chains.shared_order(F.col("refs"), rows).alias("order"))


@query("select folder, sha256(string_agg(name || chr(0) || content || chr(0), '' order by name)) as sha256 from (select doc_id // 20 as folder, 'doc-' || lpad(doc_id::varchar, 12, '0') || '.md' as name, coalesce(text, '') as content from documents) group by folder")
def n5_folder_digests(spark, d):
    """Twenty documents are a folder."""
    files = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 20).alias("folder"), F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".md")).alias("name"), F.col("text").alias("content"))
    return digests.folder_digests(files, "folder", "name", "content")


_LIMIT = "(select user_id % 20 as provider, ts, max(floor(value)::bigint) as rpm from events where event_type = 'error' and value is not null group by all)"


@query(f"select r.event_id, r.provider, l.rpm from (select event_id, user_id % 20 as provider, ts from events where event_type <> 'error') r asof left join {_LIMIT} l on r.provider = l.provider and r.ts >= l.ts")
def t8_limits_in_force(spark, d):
    """Errors change the limit of their provider; every other event has the limit that holds at its time."""
    e = table(spark, d, "events").withColumn("provider", F.col("user_id") % 20)
    changes = e.where("event_type = 'error' and value is not null").select("provider", "ts", F.floor("value").cast("long").alias("rpm"))
    asked = e.where("event_type <> 'error'").select("event_id", "provider", "ts")
    return limits.in_force(asked, changes, "provider", "ts", ["rpm"]).select("event_id", "provider", "rpm")


@query("""with p as (select p_partkey % 6 as pass, p_partkey as ord, trim(p_name) as source, p_type as target, case when p_partkey % 5 = 0 then 'f' else '' end as gender, case when p_partkey % 3 = 0 then p_brand end as note, case when p_partkey % 4 = 0 then 'PLACE' else 'thing' end as type from part where p_partkey % 6 <> 3 and p_partkey % 11 <> 0),
 o as (select 0 as pass, p_partkey as ord, p_name as source, 'own' as target, null as gender, null as note, 'phrase' as type from part where p_partkey < 20 and p_partkey in (select min(p_partkey) from part group by lower(p_name))),
 b as (select *, 0 as rank from o union all select *, 1 from p),
 k as (select lower(source) as k, max(struct_pack(rank := -rank, pass := -pass, ord := -ord, source := source, target := target, type := case when lower(type) in ('place', 'phrase') then lower(type) else 'term' end)) as first,
  arg_min(nullif(gender, ''), (rank, pass, ord)) filter (nullif(gender, '') is not null) as gender, arg_min(note, (rank, pass, ord)) filter (note is not null) as note from b group by 1)
 select (-first.rank)::int as added, (-first.pass)::bigint as pass, (-first.ord)::bigint as ord, first.source as source, first.target as target, gender, note, first.type as type from k""")
def g4_glossary_passes(spark, d):
    """Five passes that worked and one that failed, over an own glossary without genders and notes."""
    k = F.col("p_partkey")
    parts = table(spark, d, "part")
    passes = parts.select((k % 6).alias("pass"), k.alias("ord"), F.concat(F.lit(" "), "p_name").alias("source"), F.when(k % 11 != 0, F.col("p_type")).otherwise(" ").alias("target"), F.when(k % 4 == 0, "PLACE").otherwise("thing").alias("type"), F.when(k % 5 == 0, "F").otherwise("").alias("gender"), F.when(k % 3 == 0, F.col("p_brand")).alias("note"), (k % 6 == 3).alias("failed"))
    least = parts.groupBy(F.lower("p_name")).agg(F.min("p_partkey").alias("p_partkey"))
    none = F.lit(None).cast("string")
    own = parts.where("p_partkey < 20").join(least.select("p_partkey"), "p_partkey", "left_semi").select(k.alias("ord"), F.col("p_name").alias("source"), F.lit("own").alias("target"), none.alias("gender"), none.alias("note"), F.lit("phrase").alias("type"))
    return glossary.merge_passes(own, passes)


_BUDGET = 150
_PACK = lambda rows, key: f"""select {key}, blk, r, t as used, 1 as pack, t from {rows} where r = 1 union all
  select {", ".join("s." + c for c in key.split(", "))}, s.blk, s.r, case when p.used + s.t > {_BUDGET} then s.t else p.used + s.t end, case when p.used + s.t > {_BUDGET} then p.pack + 1 else p.pack end, s.t"""  # noqa: E731
_REFRESHED = f"""with recursive o1 as (select doc_id, blk, text, tokens + 8 as t, row_number() over (partition by doc_id order by blk) as r from {SEGMENTS}),
 op as ({_PACK("o1", "doc_id")} from op p join o1 s on s.doc_id = p.doc_id and s.r = p.r + 1),
 old as (select doc_id, blk, text, pack as chunk, case when (doc_id + pack) % 5 = 0 then 'failed' when (doc_id + pack) % 5 = 1 then 'flagged' else 'done' end as state, blk % 13 = 5 as edited from op join o1 using (doc_id, blk)),
 new as (select doc_id, blk, case when blk % 11 = 3 then text || '!' else text end as text, tokens + 8 as t from {SEGMENTS} where (doc_id + blk) % 7 <> 0),
 i as (select new.*, case when old.text = new.text and state in ('done', 'flagged') then chunk end as from_chunk, case when old.text = new.text and state in ('done', 'flagged') then state else 'pending' end as state from new left join old using (doc_id, blk)),
 c as (select *, case when lag(blk) over w is null or from_chunk is distinct from lag(from_chunk) over w then 1 else 0 end as c from i window w as (partition by doc_id order by blk)),
 ru as (select *, sum(c) over (partition by doc_id order by blk) as run from c),
 g as (select doc_id, run, blk, t, row_number() over (partition by doc_id, run order by blk) as r from ru where from_chunk is null),
 gp as ({_PACK("g", "doc_id, run")} from gp p join g s on s.doc_id = p.doc_id and s.run = p.run and s.r = p.r + 1),
 a as (select ru.doc_id, ru.blk, from_chunk, state, dense_rank() over (partition by ru.doc_id order by ru.run, coalesce(pack, 1)) as chunk from ru left join gp on gp.doc_id = ru.doc_id and gp.blk = ru.blk)"""


def _refresh(spark, d, same=lambda text: text):
    """Old chunks with states, edits and finals, a new version, and their alignment by place."""
    segments = I.segments(spark, d)
    old = plan.pack(segments.withColumn("text", same(F.col("text"))), ["doc_id"], "blk", _BUDGET)
    by = (F.col("doc_id") + F.col("chunk")) % 5
    old = old.withColumn("state", F.when(by == 0, "failed").when(by == 1, "flagged").otherwise("done")).withColumn("edited", F.col("blk") % 13 == 5).withColumn("final", F.concat(F.lit("x ").cast(dict(old.dtypes)["text"]), "text"))
    new = segments.where("(doc_id + blk) % 7 <> 0").withColumn("text", same(F.when(F.col("blk") % 11 == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    aligned = new.select("doc_id", F.col("blk").alias("new_blk"), F.col("blk").alias("old_blk"))
    return old, new, aligned


@query(f"{_REFRESHED} select doc_id, blk, from_chunk::int as from_chunk, chunk::int as chunk, state from a")
def g12_refreshed_chunks(spark, d):
    """Chunk lists after lines were dropped and edited: kept runs, and gaps packed anew."""
    old, new, aligned = _refresh(spark, d)
    return align.refreshed(new, old, aligned, "doc_id", _BUDGET).select("doc_id", "blk", "from_chunk", "chunk", "state")


@query(f"""{_REFRESHED}, n as (select doc_id, count(from_chunk) as kept, count(*) - count(from_chunk) as to_translate, max(chunk) as chunks, count(distinct case when from_chunk is not null then chunk end) as chunks_kept from a group by doc_id),
 b as (select old.doc_id, count(*) filter (new.blk is null) as removed, count(*) filter (edited and from_chunk is not null) as edits_kept, count(*) filter (edited and from_chunk is null) as edits_dropped from old left join new using (doc_id, blk) left join a using (doc_id, blk) group by old.doc_id)
 select doc_id, coalesce(kept, 0)::bigint as kept, coalesce(to_translate, 0)::bigint as to_translate, removed::bigint as removed, coalesce(chunks, 0)::bigint as chunks, coalesce(chunks_kept, 0)::bigint as chunks_kept, edits_kept::bigint as edits_kept, edits_dropped::bigint as edits_dropped from b left join n using (doc_id)""")
def g12_refresh_reports(spark, d):
    """Counts need texts only to tell whether they are equal, so their SHA-256 goes through the joins instead."""
    old, new, aligned = _refresh(spark, d, lambda text: F.unhex(F.sha2(text, 256)))
    return align.refresh_report(align.refreshed(new, old, aligned, "doc_id", _BUDGET), old, aligned, "doc_id")


@query("""select c_custkey, case c_custkey % 6 when 0 then '**IVANA** (low): ' || c_name when 1 then 'ON SCREEN: Ivana (hat, (red, old) boots), Ben, Cy' when 2 then 'CY: ' || c_name when 3 then 'TESTIMONY: Ivana' when 4 then 'On screen: Ben (x), Dee, Ivana' else 'Ana said: ' || c_name end as localized,
 case c_custkey % 6 when 2 then 'CY' when 4 then 'Dee' end as kept from customer""")
def f19_localized_names(spark, d):
    """Script lines of six forms; one name has a colon, another a comma, and both stay."""
    k, name = F.col("c_custkey") % 6, F.col("c_name")
    lines = F.when(k == 0, F.concat(F.lit("**ANA** (low): "), name)).when(k == 1, "ON SCREEN: Ana (hat, (red, old) boots), Ben, Cy").when(k == 2, F.concat(F.lit("CY: "), name)).when(k == 3, "TESTIMONY: Ana").when(k == 4, "On screen: Ben (x), Dee, Ana").otherwise(F.concat(F.lit("Ana said: "), name))
    names = {"ana": "Ivana", "dee": "Dee, jr", "ben": " "}
    own = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    with_colon = F.map_concat(own, F.create_map(F.lit("cy"), F.lit("C: y")))
    rows = table(spark, d, "customer").select("c_custkey", lines.alias("line"), F.when(k == 2, with_colon).otherwise(own).alias("names"))
    return script.localized_names(rows, "line", "names").select("c_custkey", "localized", "kept")


@query("select doc_id, octet_length(encode(text)) as n_bytes, sha256(text) as sha256 from documents where text <> ''")
def x1_text_files(spark, d):
    """Documents written as Markdown files by the file source, in a fixed number of folders, and read again in small ranges: the pieces of each join to its text."""
    from ..operators import digests
    from ..sources import files

    files.register(spark)
    folder = new_folder(spark, "files")
    docs = table(spark, d, "documents").where("text <> ''").select(F.concat(F.pmod(F.hash("doc_id"), F.lit(1024)).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), F.lit(0).cast("long").alias("start"), F.col("text").alias("raw"))
    docs.write.format("loomtext").mode("append").save(folder)
    pieces = spark.read.format("loomtext").option("rangeBytes", "32768").load(folder)
    whole = digests.stream_digests(pieces, "path", "start", "raw").withColumn("doc_id", F.regexp_extract("path", "/(-?[0-9]+)[.]md$", 1).cast("long"))
    return whole.select("doc_id", "n_bytes", "sha256")


_HOLDS = "case when conv_id % 2 = 0 then conv_id % 5 in (0, 1) else conv_id % 3 > 0 or conv_id % 5 = 4 end"


@query(f"select conv_id, turn, unnest(case when {_HOLDS} then [1] else [0, 1] end) as ord, case when ord = 0 then 'tags' else 'style' end as type from {PAIRS}")
def j10_reply_issues(spark, d):
    """Four issues of each pair, one of tags, two of a kind, one of a segment that is not there."""
    pairs = I.pairs(spark, d)
    issue = lambda o, t, turn: F.struct(F.lit(o).alias("ord"), F.lit(t).alias("type"), turn.alias("turn"))
    turn = F.col("turn")
    given = pairs.select("conv_id", F.explode(F.array(issue(0, "tags", turn), issue(1, "style", turn), issue(2, "style", turn), issue(0, "omission", turn + 1000))).alias("i")).select("conv_id", "i.turn", "i.ord", "i.type")
    return checks.reply_issues(given, pairs, ["conv_id", "turn"]).select("conv_id", "turn", "ord", "type")


@query("""select conv_id, list_sort(list_concat(case when conv_id % 3 = 0 then ['0: missing'] else []::varchar[] end, case when conv_id % 3 = 1 then ['x: unknown'] else []::varchar[] end, case when conv_id % 3 <> 0 and conv_id % 4 = 1 then ['0: given twice'] else []::varchar[] end,
  case when conv_id % 5 = 2 then list_filter(list(turn::varchar || ': tags'), lambda t: conv_id % 3 <> 0 or t <> '0: tags') else []::varchar[] end)) as problems from conversations where conv_id in (select conv_id from conversations where turn = 0) group by conv_id""")
def v6_submission_problems(spark, d):
    """Work from outside: an element blank, unknown, twice and unlike, or without its tags."""
    c = table(spark, d, "conversations")
    k, turn = F.col("conv_id"), F.col("turn").cast("string")
    text = F.when((k % 3 == 0) & (F.col("turn") == 0), " ").when(k % 5 == 2, "plain").otherwise("<1>good</1>")
    element = X.segment_element(turn, text)
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(turn.alias("id"), F.lit("<1>source</1>").alias("text")))).alias("segs"), F.array_join(F.sort_array(F.collect_list(element)), "\n").alias("body"), F.min("turn").alias("low")).where("low = 0")
    reply = F.concat("body", F.when(k % 3 == 1, "<seg id='x'>y</seg>").otherwise(""), F.when((k % 4 == 1) & (k % 3 != 0), "<seg id=0>other</seg>").otherwise(""))
    read = protocol.with_parsed(rows.withColumn("reply", reply).withColumn("ids", F.transform("segs", lambda s: s.id)), "reply", "ids", "p")
    return read.select("conv_id", F.array_sort(checks.submission_problems(F.col("p"), F.col("segs"))).alias("problems"))


@query("""with p as (select p_partkey, p_partkey % 3 > 0 as client_only, case p_partkey % 4 when 0 then []::varchar[] when 1 then ['client/other', 'near/m'] when 2 then ['client/own', 'far/m', 'plain'] else ['near/m'] end as models, case p_partkey % 5 when 0 then true when 1 then false end as proofread, (['qa', 'proofreader', 'translator'])[p_partkey % 3 + 1] as agent from part),
 a as (select *, case when client_only and len(models) > 0 then case when proofread then ['qa', 'proofreader'] else ['qa'] end else []::varchar[] end as agents from p),
 b as (select *, list_transform(models, lambda m: case when m not like '%/%' then 'not provider/model' when m = 'client/own' then 'it translates' when m like 'client/%' or m like 'near/%' then null else 'not free' end) as problems from a)
 select p_partkey, agents, problems, list_filter(['client/own', 'client/other', 'near/m', 'far/m'], lambda r: case when list_contains(agents, agent) then not (list_contains(models, r) and r in ('client/other', 'near/m')) else r not like 'client/%' end) as outside from b""")
def g13_reviewers(spark, d):
    """Who may review in projects that spend nothing, and which models their agents may not ask."""
    k = F.col("p_partkey")
    some = lambda *xs: F.array(*map(F.lit, xs)) if xs else F.expr("cast(array() as array<string>)")
    models = F.when(k % 4 == 0, some()).when(k % 4 == 1, some("client/other", "near/m")).when(k % 4 == 2, some("client/own", "far/m", "plain")).otherwise(some("near/m"))
    rows = table(spark, d, "part").select("p_partkey", models.alias("models"), F.element_at(some("qa", "proofreader", "translator"), (k % 3 + 1).cast("int")).alias("agent"), routing.reviewer_agents(k % 3 > 0, models, F.when(k % 5 == 0, True).when(k % 5 == 1, False)).alias("agents"))
    problems = F.transform("models", lambda m: routing.reviewer_problem(m, "client/own", ["near"]))
    outside = routing.outside_refs(some("client/own", "client/other", "near/m", "far/m"), F.col("agent"), F.col("agents"), F.col("models"), "client/own", ["near"])
    return rows.select("p_partkey", "agents", problems.alias("problems"), outside.alias("outside"))


_NL = "chr(10)"


@query(f"""{_PACKED}, x as (select p.doc_id, p.chunk, p.blk, s.text from p join {SEGMENTS} s using (doc_id, blk)),
 q as (select doc_id, chunk, min(blk) = 0 as starts, string_agg('<seg id="' || blk || '">' || text || '</seg>', {_NL} order by blk) as q from x group by 1, 2),
 r as (select *, dense_rank() over (partition by doc_id, chunk order by blk desc) as r from x), t as (select doc_id, chunk + 1 as chunk, string_agg(text, {_NL} || {_NL} order by blk) as t from r where r <= 2 group by 1, 2),
 g as (select ord as doc_id, '- ' || term || ' = ' || target_term as line from {GLOSSARY})
 select doc_id, chunk, md5(concat_ws({_NL} || {_NL}, case when starts then '## Glossary' || {_NL} || line end, '## Previous passage' || {_NL} || case when length(t) > 1200 then '...' || right(t, 1200) else t end, '## Segments' || {_NL} || q)) as content
 from q left join t using (doc_id, chunk) left join g using (doc_id)""")
def g8_requests(spark, d):
    """What a model is asked for each chunk: glossary terms of the first, the end of the passage before, and the segments."""
    segs = plan.pack(I.segments(spark, d), ["doc_id"], "blk", BUDGET).withColumn("seg_id", F.col("blk").cast("string"))
    keys = ["doc_id", "chunk"]
    terms = segs.where("blk = 0").select(*keys).join(I.glossary(spark, d).select(F.col("ord").alias("doc_id"), "ord", "term", "target_term"), "doc_id")
    tails = plan.previous_tails(segs.withColumn("final", F.col("text")), ["doc_id"])
    asked = projects.requests(protocol.format_segments(segs, keys, "blk"), keys, terms, tails, "Translate.")
    return asked.select(*keys, F.md5(F.element_at("messages", 2).content.cast("binary")).alias("content"))


_TERMS = {"type": "object", "required": ["terms"], "properties": {"terms": {"type": "array", "minItems": 1, "items": {"type": "object", "required": ["source", "size"], "properties": {"source": {"type": "string", "minLength": 1}, "size": {"type": "integer"}}}}}}


@query("""select p_partkey, case when p_partkey % 5 < 4 then '{"terms": [{"source": "' || p_name || '", "size": ' || p_size || '}]}' end as json,
 case p_partkey % 5 when 4 then case when p_partkey % 2 = 0 then ['terms[0].size: not integer', 'terms[0].source: missing'] else ['terms: too few items'] end else []::varchar[] end as problems, case when p_partkey % 5 in (1, 2, 4) then 2 else 1 end as asks from part""")
def g7_repaired_answers(spark, d):
    """Terms as JSON: some answers are right at once, some in a fence after thinking, some only after their problems are named, some never."""
    k = F.col("p_partkey")
    asks = table(spark, d, "part").select(k, F.concat_ws("|", k.cast("string"), "p_name", F.col("p_size").cast("string")).alias("request"))

    def model(request, number, task):
        part = lambda i: F.regexp_extract(request, r"^([0-9]+)\|([^|]*)\|([0-9]+)", i)
        n, again = part(1).cast("long"), F.instr(request, "not usable") > 0
        good = F.concat(F.lit('{"terms": [{"source": "'), part(2), F.lit('", "size": '), part(3), F.lit("}]}"))
        never = F.when(n % 2 == 0, '{"terms": [{"size": "x"}]}').otherwise('{"terms": []}')
        return F.when(n % 5 == 0, good).when(n % 5 == 3, F.concat(F.lit("<think>{no}</think>```json\n"), good, F.lit("\n```"))).when(n % 5 == 4, never).when(again, good).when(n % 5 == 1, "no object").otherwise('{"term": 1}')

    out = runner.answers(asks, ["p_partkey"], _TERMS, model, new_folder(spark, "runs"))
    return out.select("p_partkey", "json", F.array_sort("problems").alias("problems"), "asks")


@query("""select o_orderkey, case when o_orderkey % 7 = 0 then 'it is running: refresh it later' when kind in ('vn', 'vnp') then 'its format is not refreshed' when now <> kind then 'the source is now ' || now || ', the project was made for ' || kind end as refresh,
 case when o_orderkey % 7 = 0 then 'it is running: editing has to wait' end as edit from (select o_orderkey, (['md', 'vn', 'epub', 'vnp', 'txt'])[(o_orderkey % 5 + 1)::int] as kind, case when o_custkey % 3 = 0 then 'txt' else (['md', 'vn', 'epub', 'vnp', 'txt'])[(o_orderkey % 5 + 1)::int] end as now from orders)""")
def p13_refusals(spark, d):
    """Projects that run, whose format is not refreshed, or whose new source is of another format."""
    k = F.col("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ["md", "vn", "epub", "vnp", "txt"])), (k % 5 + 1).cast("int"))
    now = F.when(F.col("o_custkey") % 3 == 0, "txt").otherwise(kind)
    return table(spark, d, "orders").select("o_orderkey", projects.refresh_refusal(k % 7 == 0, kind, now).alias("refresh"), projects.edit_refusal(k % 7 == 0, "editing").alias("edit"))


_BITS = ", ".join(f"(event_id // {2**i}) % 2 = 1 as {n}" for i, n in enumerate(("shows", "picked", "hidden", "known", "listed", "local", "priced")))


@query(f"""with b as (select event_id, {_BITS} from events), p as (select *, case when shows and not known and not picked then case when not listed then 'not listed' when not local and not priced then 'no price' end end as problem from b)
 select event_id, case when problem is not null then picked when shows then picked or not known else false end as is_picked, case when problem is not null then hidden when shows then false else hidden or not picked end as is_hidden, problem from p""")
def m10_model_choices(spark, d):
    """Every combination of a request and what is known of its model."""
    bit = lambda i: F.floor(F.col("event_id") / 2**i) % 2 == 1
    rows = table(spark, d, "events").select("event_id", routing.model_choice(*(bit(i) for i in range(7))).alias("c"))
    return rows.select("event_id", F.col("c.picked").alias("is_picked"), F.col("c.hidden").alias("is_hidden"), F.col("c.problem").alias("problem"))
