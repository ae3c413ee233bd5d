"""States, scores, spend and estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

# The states of a chunk, in order.
STATES = ["pending", "translating", "proofreading", "reviewing", "fixing", "done", "flagged", "failed"]
RUNNING = ["translating", "proofreading", "reviewing", "fixing"]


def state_counts(chunks: DataFrame, keys: list[str]) -> DataFrame:
    """One column for each state, zero where none."""
    return chunks.groupBy(*keys).agg(*(F.count_if(F.col("state") == s).alias(s) for s in STATES))


def qa_scores(chunks: DataFrame, keys: list[str], reviewer: str | None = None) -> DataFrame:
    """(keys, score, scored, models, independent): mean of the scored to one decimal, reviewers in order of appearance.

    independent: no scored chunk was reviewed by the model that translated it; before any is scored, whether the settings name a
    reviewer, the boolean column `reviewer` of chunks where that is given.
    """
    scored = F.col("qa_score").isNotNull()
    mean = F.sum("qa_score") / F.count("qa_score")
    names = F.transform(F.array_sort(F.collect_list(F.when(scored & F.col("qa_model").isNotNull(), F.struct("chunk_index", "qa_model")))), lambda s: s.qa_model)
    return chunks.groupBy(*keys).agg(
        (F.floor(mean * 10 + 0.5) / 10).alias("score"),
        F.count("qa_score").alias("scored"),
        F.array_join(F.array_distinct(names), ",").alias("models"),
        F.coalesce(F.bool_and(F.when(scored, ~F.col("qa_model").eqNullSafe(F.col("model")))), F.bool_or(reviewer) if reviewer else F.lit(None), F.lit(False)).alias("independent"),
    )


def progress(chunks: DataFrame, keys: list[str], elapsed: Column) -> DataFrame:
    """(keys, done, total, eta): eta is null before the first chunk is finished."""
    rows = chunks.groupBy(*keys).agg(F.count_if(F.col("state").isin("done", "flagged")).alias("done"), F.count("*").alias("total"), F.max(elapsed).alias("_e"))
    return rows.select(*keys, "done", "total", F.when(F.col("done") > 0, F.floor(F.col("_e") / F.col("done") * (F.col("total") - F.col("done")) + 0.5)).cast("long").alias("eta"))


def dialogue_styles(paragraphs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, style): the commonest opening if at least twice as common as the next, else mixed; keys with fewer than two go."""
    mark = X.dialogue_mark("text")
    n = paragraphs.groupBy(*keys).agg(*(F.count_if(mark == m).alias(m) for m in ("dash", "quotes", "guillemets")))
    top = F.greatest("dash", "quotes", "guillemets")
    second = F.element_at(F.array_sort(F.array("dash", "quotes", "guillemets")), 2)
    name = F.when(F.col("dash") == top, "dash").when(F.col("quotes") == top, "quotes").otherwise("guillemets")
    return n.where(F.col("dash") + F.col("quotes") + F.col("guillemets") >= 2).select(*keys, F.when(top >= 2 * second, name).otherwise("mixed").alias("style"))


def style_check(styles: DataFrame, project: str, expected: str | None = None) -> DataFrame:
    """(project, style, chunks, offending): chunk lists by style; a style offends unless it is the expected or commonest one."""
    by = styles.groupBy(project, "style").agg(F.sort_array(F.collect_list("chunk_index")).alias("chunks"), F.min("chunk_index").alias("_first"))
    place = Window.partitionBy(project).orderBy(F.size("chunks").desc(), "_first")
    wanted = F.lit(expected) if expected else F.first("style").over(place)
    return by.select(project, "style", F.array_join(F.col("chunks").cast("array<string>"), ",").alias("chunks"), (F.col("style") != wanted).alias("offending"))


def weighted_mode(rows: DataFrame, keys: list[str], value: str, weight: str, order: str) -> DataFrame:
    """(keys, value): the value of the largest total weight, the first seen of equals."""
    totals = rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w"), F.min(order).alias("_o"))
    return totals.groupBy(*keys).agg(F.max_by(value, F.struct("_w", -F.col("_o"))).alias(value))


def upper_median(c: str) -> Column:
    xs = F.array_sort(F.collect_list(c))
    return F.element_at(xs, (F.floor(F.size(xs) / 2) + 1).cast("int"))


def estimate(chunks: DataFrame, keys: list[str], agents: list[tuple]) -> DataFrame:
    """(keys, agent, tokens_in, tokens_out, cost_usd, seconds) for agents (name, local, price in, price out, workers, glossary budget); they are
    settings, so they are part of the expression and no table."""
    n = chunks.groupBy(*keys).agg(F.count("*").alias("n"), F.sum("tokens").alias("source"))
    n = n.withColumn("out", F.floor(F.col("source") * 1.2 + 0.5).cast("long"))
    names = ("agent", "local", "price_in", "price_out", "workers", "glossary_budget")
    rows = n.withColumn("_a", F.explode(F.array(*(F.struct(*(F.lit(v).alias(k) for k, v in zip(names, a))) for a in agents)))).select(*n.columns, "_a.*")
    passes = F.greatest(F.lit(1), F.ceil(F.col("source") / F.col("glossary_budget"))).cast("long")
    a = F.col("agent")
    tokens_in = F.when(a == "glossary", F.col("source") + passes * 2400).when(a == "translator", F.col("source") + F.col("n") * 1000).otherwise(F.col("source") + F.col("out") + F.col("n") * 1000)
    tokens_out = F.when(a == "glossary", passes * 500).when(a == "qa", F.col("n") * 200).otherwise(F.col("out"))
    rows = rows.withColumn("tokens_in", tokens_in.cast("long")).withColumn("tokens_out", tokens_out.cast("long"))
    speed = F.when(F.col("local"), 30).otherwise(80)
    return rows.select(*keys, "agent", "tokens_in", "tokens_out", F.when(F.col("local"), 0.0).otherwise((F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1_000_000).alias("cost_usd"), (F.col("tokens_out") / speed / F.when(a == "glossary", 1).otherwise(F.col("workers"))).alias("seconds"))


def translations(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block_id, text): a whole block's final text; a split block's parts trimmed and joined, only if all are there."""
    rows = segments.where(F.col("final").isNotNull())
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "final"))), lambda s: X.trim_ws(s.final)), " ")
    by = rows.groupBy(*keys, "block_id").agg(F.count("*").alias("_n"), F.max("parts").alias("_parts"), joined.alias("_joined"), F.max("final").alias("_whole"))
    return by.where(F.col("_parts").isNull() | (F.col("_n") == F.col("_parts"))).select(*keys, "block_id", F.when(F.col("_parts").isNull(), F.col("_whole")).otherwise(F.col("_joined")).alias("text"))


def untranslated(segments: DataFrame, keys: list[str], done: DataFrame) -> DataFrame:
    """(keys, blocks, failed, running, pending): blocks without a translation, and chunks to blame by state."""
    has = segments.join(done.select(*keys, "block_id", F.lit(True).alias("_ok")), [*keys, "block_id"], "left")
    blocks = has.where(F.col("_ok").isNull()).groupBy(*keys).agg(F.countDistinct("block_id").alias("blocks"))
    chunk = has.groupBy(*keys, "chunk_index", "state").agg(F.bool_or(F.col("_ok").isNull()).alias("_missing")).where(F.col("_missing") | ~F.col("state").isin("done", "flagged"))
    listed = lambda when: F.array_join(F.sort_array(F.collect_list(F.when(when, F.col("chunk_index")))).cast("array<string>"), ",")
    failed, running = F.col("state") == "failed", F.col("state").isin(RUNNING)
    by = chunk.groupBy(*keys).agg(listed(failed).alias("failed"), listed(running).alias("running"), listed(~failed & ~running).alias("pending"))
    return by.join(blocks, keys, "left").select(*keys, F.coalesce("blocks", F.lit(0)).cast("long").alias("blocks"), "failed", "running", "pending")


def spend(chunks: DataFrame, *keys: str, tokens_in: str = "tokens_in", tokens_out: str = "tokens_out") -> DataFrame:
    """(keys, tokens_in, tokens_out): sums for each chunk, each project and all, one level for each key."""
    return chunks.rollup(*keys).agg(F.sum(tokens_in).cast("long").alias("tokens_in"), F.sum(tokens_out).alias("tokens_out"))


def queue_counts(tasks: DataFrame, key: str, waiting: Column, leased: Column) -> DataFrame:
    """(key, waiting, leased): tasks of each client by condition."""
    return tasks.groupBy(key).agg(F.count_if(waiting).alias("waiting"), F.count_if(leased).alias("leased"))


def server_slots(instances: DataFrame, key: str, parallel: Column, most: int = 16) -> DataFrame:
    """(key, slots): requests that the loaded instances of a server take at once, each at least one, in all at most `most`."""
    return instances.groupBy(key).agg(F.least(F.lit(most), F.sum(F.greatest(F.lit(1), parallel))).cast("long").alias("slots"))


def version_report(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, kept, new, removed) of two versions (key, blk, text): the n-th copy of a text is kept if the other has an n-th one."""
    place = Window.partitionBy(key, "text").orderBy("blk")
    n = lambda df, c: df.select(key, "text", F.col("blk").alias(c), F.row_number().over(place).alias("_n"))
    both = n(old, "_a").join(n(new, "_b"), [key, "text", "_n"], "full")
    a, b = F.col("_a").isNotNull(), F.col("_b").isNotNull()
    return both.groupBy(key).agg(F.count_if(a & b).alias("kept"), F.count_if(~a).alias("new"), F.count_if(~b).alias("removed"))


def first_and_last(events: DataFrame, key: str, order: list[str], first: str, last: str) -> DataFrame:
    """(key, first, last): one column of the first event of each key, another of the last."""
    o = F.struct(*order)
    return events.groupBy(key).agg(F.min_by(first, o).alias("first"), F.max_by(last, o).alias("last"))
