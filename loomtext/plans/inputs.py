"""Tables of the engine's data model, derived from the given tables; each has a DataFrame form and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.plan import line_blocks, translatable
from ..operators.rollup import STATES
from .registry import table

WS = "[ \\t\\r\\n]"
TRIM = f"regexp_replace({{}}, '^{WS}+|{WS}+$', '', 'g')"

BLOCKS = "(select doc_id, unnest(range(len(l))) as blk, unnest(l) as text from (select doc_id, string_split(text, chr(10)) as l from documents where text is not null))"


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return line_blocks(table(spark, d, "documents"))


SEGMENTS = f"(select doc_id, blk, text, cast(ceil(length(text) / 4.0) as bigint) as tokens from {BLOCKS} where {TRIM.format('text')} <> '')"


def segments(spark: SparkSession, d: str) -> DataFrame:
    return translatable(blocks(spark, d)).select("doc_id", "blk", "text", F.ceil(F.length("text") / 4).cast("long").alias("tokens"))


PAIRS = """(select conv_id, turn, case when conv_id % 2 = 0 then '<1>' || source || '</1> <2/>' else source end as source,
 case when conv_id % 2 = 1 and conv_id % 3 > 0 then target when conv_id % 5 = 0 then '<1>' || source || '</1> <2/>' when conv_id % 5 = 1 then '<1>' || target || '</1> <2/>'
  when conv_id % 5 = 2 then '<1>' || target || '</1>' when conv_id % 5 = 3 then '</1>' || target || '<1> <2/>' when conv_id % 3 = 0 then source else target end as target
 from (select a.conv_id, a.turn, a.text as source, b.text as target from conversations a join conversations b on a.conv_id = b.conv_id and b.turn = a.turn + 1 where a.role = 'user' and b.role = 'assistant'))"""


def pairs(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, turn, source, target): a user's turn and the answer, with placeholder tags that fit for some and not for others."""
    c = table(spark, d, "conversations")
    a = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("s"))
    b = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("t"))
    k, s, t = F.col("conv_id"), F.col("s"), F.col("t")
    tagged = lambda x, before="<1>", after="</1> <2/>": F.concat(F.lit(before), x, F.lit(after))
    target = (
        F.when((k % 2 == 1) & (k % 3 > 0), t).when(k % 5 == 0, tagged(s)).when(k % 5 == 1, tagged(t)).when(k % 5 == 2, tagged(t, after="</1>")).when(k % 5 == 3, tagged(t, "</1>", "<1> <2/>")).when(k % 3 == 0, s).otherwise(t)
    )
    return a.join(b, ["conv_id", "turn"]).select("conv_id", "turn", F.when(k % 2 == 0, tagged(s)).otherwise(s).alias("source"), target.alias("target"))


_LIST = "['" + "','".join(STATES) + "']"
CHUNKS = f"""(select o_custkey as project, o_orderkey as chunk_index, ({_LIST})[(o_orderkey % 8) + 1] as state, 'm' || (o_custkey % 3) as model,
 case when o_orderkey % 5 = 0 then null else 'm' || (o_orderkey % 4) end as qa_model, case when o_orderkey % 3 = 0 then null else cast(o_orderkey % 41 as double) / 4 end as qa_score, o_orderdate as ts from orders)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """(project, chunk_index, state, model, qa_model, qa_score, ts): an order stands for a chunk of its customer's project."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    name = lambda c, n: F.concat(F.lit("m"), (c % n).cast("string"))
    return o.select(
        F.col("o_custkey").alias("project"),
        k.alias("chunk_index"),
        F.element_at(F.array(*map(F.lit, STATES)), (k % 8 + 1).cast("int")).alias("state"),
        name(F.col("o_custkey"), 3).alias("model"),
        F.when(k % 5 != 0, name(k, 4)).alias("qa_model"),
        F.when(k % 3 != 0, (k % 41).cast("double") / 4).alias("qa_score"),
        F.col("o_orderdate").alias("ts"),
    )


GLOSSARY = """(select item_id as ord, lower(w) as term, case when item_id % 3 = 0 then lower(w) else lower(w) || 'et' end as target_term from (
 select item_id, (string_split(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), ' '))[(item_id % 7 + 1)::int] as w from benchmark) where w <> '')"""


def glossary(spark: SparkSession, d: str) -> DataFrame:
    """(ord, term, target_term): a word of each benchmark item; a third keeps its form."""
    b = table(spark, d, "benchmark")
    w = F.element_at(F.split(F.regexp_replace("text", "[^A-Za-z ]", " "), " "), (F.col("item_id") % 7 + 1).cast("int"))
    return b.select("item_id", w.alias("w")).where("w <> ''").select(F.col("item_id").alias("ord"), F.lower("w").alias("term"), F.when(F.col("item_id") % 3 == 0, F.lower("w")).otherwise(F.concat(F.lower("w"), F.lit("et"))).alias("target_term"))
