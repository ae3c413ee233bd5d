"""Lists of models, keys and rows: order, limits, unions and removals. Lists are arrays or small groups; nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .checks import tag_check

# How many rows messages and prompts show.
MOST_DROPPED, MOST_MINORS, MOST_LOG_LINES, MOST_KNOWN_TERMS, MOST_NAMES, CUT_CHARS = 20, 30, 300, 150, 80, 160


def ordered_refs(refs: DataFrame, keys: list[str], groups: list[str], ref: str = "ref", order: str = "ord") -> DataFrame:
    """refs (keys, ref, ord, group, kind) with `place`: refs of a client first, then by the rank of their group, unknown groups last,
    and in their own order within a rank."""
    at = F.array_position(F.array(*map(F.lit, groups)), F.col("group"))
    rank = F.when(F.col("kind") == "client", -1).otherwise(F.when(F.coalesce(at, F.lit(0)) > 0, at - 1).otherwise(len(groups)))
    return refs.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(rank, order)))


def first_rows(rows: DataFrame, keys: list[str], order, most: int, last: bool = False) -> DataFrame:
    """The first (or last) `most` rows of each key."""
    by = F.col(order).desc() if last else F.col(order)
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(by))).where(F.col("_r") <= most).drop("_r")


def dropped_edits(edits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, order, text): the first dropped edits of each key, cut for a message."""
    return first_rows(edits, keys, order, MOST_DROPPED).withColumn("text", X.cut("text", CUT_CHARS))


def oldest_matching(tasks: DataFrame, clients: DataFrame, on: list[str]) -> DataFrame:
    """(client, task_id): for each client the oldest waiting task that its filter admits; tasks (task_id, created, state, on)."""
    first = tasks.where("state = 'waiting'").groupBy(*on).agg(F.min_by("task_id", F.struct("created", "task_id")).alias("task_id"))
    return clients.join(first, on).select("client", "task_id")


def picker_order(models: DataFrame, keys: list[str]) -> DataFrame:
    """Available models (keys, name, local, available) with `place`: local ones first, then by name."""
    return models.where("available").withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("local").desc(), "name")))


def without_provider(refs: Column | str, provider: Column) -> Column:
    """A list of refs without those of a provider."""
    return F.filter(X.col(refs), lambda r: ~F.startswith(r, F.concat(provider, F.lit("/"))))


def rotated(refs: Column, lead: Column, skip: Column) -> Column:
    """A list of distinct refs as an attempt uses it: without `skip`, unless nothing else is left, and those of `lead` first in the
    order of lead."""
    kept = F.filter(refs, lambda r: ~F.array_contains(skip, r))
    own = F.when(F.size(kept) > 0, kept).otherwise(refs)
    return F.concat(F.filter(lead, lambda r: F.array_contains(own, r)), F.filter(own, lambda r: ~F.array_contains(lead, r)))


def unknown_keys(args: Column | str, valid: list[str]) -> Column:
    """Keys of a map that are not valid, in order."""
    return F.array_sort(F.array_except(F.map_keys(X.col(args)), F.array(*map(F.lit, valid))))


def chunk_briefs(chunks: DataFrame) -> DataFrame:
    """Chunks (chunk_index, section, state, issues, qa_score, model, ...) without texts, issues as counts."""
    counts = [F.size("issues").alias("issues"), F.size(F.filter("issues", lambda i: i.severity == "major")).alias("major_issues")]
    return chunks.select(*(c for c in chunks.columns if c not in ("issues", "segments", "translation", "proofread", "final")), *counts)


def rekeyed(texts: Column | str, ids: Column | str) -> Column:
    """A map of texts by old id as a map by new id; ids maps old to new, ids without a text go."""
    own = X.col(texts)
    there = F.map_filter(X.col(ids), lambda old, _: F.map_contains_key(own, old))
    return F.map_from_arrays(F.map_values(there), F.transform(F.map_keys(there), lambda old: F.element_at(own, old)))


def accepted_fix(source: Column | str, before: Column | str, fixed: Column | str) -> Column:
    """The fixed text where there is one and its tags hold, with the edges of the source; else the text before."""
    fitted = X.fit_edges(source, F.coalesce(X.col(fixed), F.lit("")))
    return F.when(X.col(fixed).isNotNull() & tag_check(source, fitted).ok, fitted).otherwise(X.col(before))


def scheduling_units(chunks: DataFrame, keys: list[str], split_sections: bool = False) -> DataFrame:
    """Pending chunks (keys, section, chunk_index) with `unit`: a section's chunks are one unit, in the order in which sections first
    come, or each chunk is one of its own; and `turn`, its place in the unit."""
    todo = chunks.where("state = 'pending'")
    if split_sections:
        return todo.withColumn("unit", F.row_number().over(Window.partitionBy(*keys).orderBy("chunk_index"))).withColumn("turn", F.lit(1))
    first = todo.withColumn("_first", F.min("chunk_index").over(Window.partitionBy(*keys, "section")))
    unit = F.dense_rank().over(Window.partitionBy(*keys).orderBy("_first"))
    return first.withColumn("unit", unit).withColumn("turn", F.row_number().over(Window.partitionBy(*keys, "section").orderBy("chunk_index"))).drop("_first")


def listed_models(entries: Column) -> Column:
    """(id, context, price_in, price_out, price_cached, text_only) of a JSON entry of a server's model list: prices a token become
    prices a million, a missing or negative one means no price, and models that answer with more than text are marked."""
    kind = "id string, context_length long, pricing struct<prompt:string,completion:string,input_cache_read:string>, architecture struct<output_modalities:array<string>>"
    m = F.from_json(entries, kind)
    million = lambda v: v.try_cast("double") * 1_000_000
    into, out = million(m.pricing.prompt), million(m.pricing.completion)
    priced = (into >= 0) & (out >= 0)
    kinds = m.architecture.output_modalities
    return F.struct(
        m.id.alias("id"),
        F.when(m.context_length > 0, m.context_length).alias("context"),
        F.when(priced, into).alias("price_in"),
        F.when(priced, out).alias("price_out"),
        F.when(priced, million(m.pricing.input_cache_read)).alias("price_cached"),
        (kinds.isNull() | ((F.size(kinds) == 1) & (F.element_at(kinds, 1) == "text"))).alias("text_only"),
    )


def first_hits(hits: DataFrame, key: str, order: str, most: int = 60) -> DataFrame:
    """(key, hits): the first hits of each key in order, at most so many; the rest never leaves its task."""
    along = Window.partitionBy(key).orderBy(order)
    top = hits.withColumn("_r", F.row_number().over(along)).where(F.col("_r") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", order))), lambda s: s[order]).alias("hits"))


def by_index(replies: DataFrame, key: str, index: str, value: str, name: str) -> DataFrame:
    """(key, name): values that came in any order, put back by their index."""
    return replies.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(index, value))), lambda s: s[value]).alias(name))


def newest_rows(rows: DataFrame, key: str, order: list, most: int = 3) -> DataFrame:
    """The last rows of each key, for a live view."""
    newest = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most).drop("_r")


def carried_forward(rows: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """rows with the last value, its own included, that was not null."""
    along = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(along))


def distinct_values(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """(key, name): each value once, sorted."""
    return rows.groupBy(key).agg(F.array_sort(F.collect_set(value)).alias(name))


def ordered_distinct(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """(key, values): each value once, in the order of its first row."""
    first = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.min(order).alias("_o"))
    return first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda s: s[value]).alias("values"))


def with_seeds(ids: Column, seeds: list[str]) -> Column:
    """Offered and seed ids as one sorted list."""
    return F.array_sort(F.array_union(ids, F.array(*map(F.lit, seeds))))


def missing_seeds(ids: Column, seeds: list[str]) -> Column:
    """Seed ids that are not there yet, sorted."""
    return F.array_sort(F.array_except(F.array(*map(F.lit, seeds)), ids))


def with_section(rows: DataFrame, key: str, section: str, block_id: Column, text: Column) -> DataFrame:
    """(key, section, block_id, text): rows as blocks of a section, to be united with those of others by name."""
    return rows.select(key, F.lit(section).alias("section"), block_id.alias("block_id"), text.alias("text"))


def without_row(names: DataFrame, have: DataFrame, name: str) -> DataFrame:
    """names, each once, for which have has no row."""
    return names.join(have.select(name), name, "left_anti").distinct()
