"""Segments and chunks: token budgets, greedy packing, previous-chunk tails."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

OVERHEAD, MIN_BUDGET, DEFAULT_MAX, DEFAULT_CONTEXT = 8, 100, 1500, 8192


def chunk_budget(context: Column, user_max: Column | int = DEFAULT_MAX, prompt: int = 600, glossary: int = 400, previous: int = 400, expansion: float = 1.3, safety: float = 0.15) -> Column:
    """Source tokens a chunk may have, of the smallest context window of its models (null: the default window)."""
    ctx = F.coalesce(context, F.lit(DEFAULT_CONTEXT))
    free = ctx - prompt - glossary - previous - F.ceil(ctx * safety)
    top = F.lit(user_max) if isinstance(user_max, int) else user_max
    return F.greatest(F.lit(MIN_BUDGET), F.least(top, F.floor(free / (1 + expansion)))).cast("long")


def line_blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, blk, text): each line of a document is a block."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("blk", "text"))


def translatable(blocks: DataFrame) -> DataFrame:
    kind = (F.col("kind") != "meta") if "kind" in blocks.columns else F.lit(True)
    return blocks.where(kind & (X.trim_ws("text") != ""))


def pack(segments: DataFrame, keys: list[str], order: str, budget: int) -> DataFrame:
    """segments with chunk: greedy packing in order within keys; a segment costs its tokens and an overhead.

    Whether a chunk ends depends on what came before, so it is a fold over the ordered segments of a key. Only (order, cost) pairs
    are gathered, 16 bytes a segment, and only the first segment of each chunk comes out of the fold; chunks are then counted along
    the segments.
    """
    cost = F.col("tokens") + OVERHEAD
    gathered = segments.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), cost.alias("t")))).alias("xs"))
    kind = dict(segments.dtypes)[order]
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as array<{kind}>)").alias("firsts"))

    def step(acc, x):
        full = (acc.used > 0) & (acc.used + x.t > budget)
        return F.struct(F.when(full, x.t).otherwise(acc.used + x.t).cast("long").alias("used"), F.when(full, F.concat(acc.firsts, F.array(x.o))).otherwise(acc.firsts).alias("firsts"))

    firsts = gathered.select(*keys, F.explode(F.aggregate("xs", empty, step, lambda acc: acc.firsts)).alias(order)).withColumn("_first", F.lit(1))
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = segments.join(firsts, [*keys, order], "left")
    return marked.withColumn("chunk", (1 + F.sum(F.coalesce("_first", F.lit(0))).over(along)).cast("int")).drop("_first")


def chunks(packed: DataFrame, keys: list[str]) -> DataFrame:
    return packed.groupBy(*keys, "chunk").agg(F.count("*").alias("segments"), F.sum(F.col("tokens") + OVERHEAD).alias("tokens"))


def previous_tails(segments: DataFrame, keys: list[str], blocks: int = 2, most: int = 1200) -> DataFrame:
    """(keys, chunk, source, translation): the last blocks of the chunk before, of segments that have a final text."""
    done = segments.where(F.col("final").isNotNull())
    newest = Window.partitionBy(*keys, "chunk").orderBy(F.col("blk").desc())
    last = done.withColumn("_r", F.dense_rank().over(newest)).where(F.col("_r") <= blocks)

    def tail(c):
        t = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("blk", c))), lambda s: s[c]), "\n\n")
        return F.when(F.length(t) > most, F.concat(F.lit("..."), F.right(t, F.lit(most)))).otherwise(t)

    return last.groupBy(*keys, (F.col("chunk") + 1).alias("chunk")).agg(tail("text").alias("source"), tail("final").alias("translation"))


_SENTENCE = re.compile(r".*?(?:[.!?…]+[\"'”’»)\]]*(?=\s|$)\s*|\n+|$)", re.S)


def split_block(text: str, budget: int, count=lambda t: -(-len(t) // 4)) -> list[str]:
    """A block in parts of at most `budget` tokens: at sentences, a longer sentence at words, never within an open tag pair."""
    room = max(MIN_BUDGET // 2, budget - OVERHEAD)
    if count(text) <= room:
        return [text]
    units: list[str] = []
    for s in filter(None, _SENTENCE.findall(text)):
        units += [s] if count(s) <= room else _gather(re.findall(r"\S*\s|\S+$", s), room, count)
    parts = _gather(units, room, count, tags=True)
    return [p.strip() for p in parts] if len(parts) > 1 else [text]


def _gather(units: list[str], room: int, count, tags: bool = False) -> list[str]:
    out, held, used, depth = [], "", 0, 0
    for u in units:
        n = count(u)
        if held and depth == 0 and used + n > room:
            out.append(held)
            held, used = "", 0
        held, used = held + u, used + n
        if tags:
            depth += len(re.findall(r"<\d+>", u)) - len(re.findall(r"</\d+>", u))
    return out + [held] if held else out


def split_segments(blocks: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """(keys, part, parts, text, tokens): blocks cut into parts that fit; part is null for a block that stays whole."""
    @F.pandas_udf("array<string>")
    def parts(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_block(t, budget))

    rows = blocks.withColumn("_p", parts("text")).select(*keys, F.size("_p").alias("parts"), F.posexplode("_p").alias("_i", "text"))
    one = F.col("parts") > 1
    return rows.select(*keys, F.when(one, F.col("_i") + 1).alias("part"), F.when(one, F.col("parts")).alias("parts"), "text", X.rough_tokens("text").alias("tokens"))
