"""Aliases that lead to aliases, fallback lists, and one shared order of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .stages import stage

def resolved(edges: DataFrame, path: str) -> DataFrame:
    """(alias, target, steps, circular) of edges (alias, target), one for each alias: the end of its chain, or none if it runs into a circle.

    Only aliases that others lead to are followed, twice as far each round, as a join and a committed stage under path; all others take one
    step to them at the end. A round in which no chain ends is the last: had a chain an end farther off, an alias on it would have
    reached that end in this round. So what still moves then is in a circle or leads into one.
    """
    spark = edges.sparkSession
    inner = edges.join(edges.select(F.col("target").alias("alias")).distinct(), "alias", "left_semi")
    now = stage(spark, f"{path}/0", lambda: inner.select("alias", "target", F.lit(1).cast("long").alias("steps"), F.lit(True).alias("moved")))
    left, k = now.count(), 0
    while left:
        k += 1
        on = now.select(F.col("alias").alias("target"), F.col("target").alias("_next"), F.col("steps").alias("_more"))

        def further(now: DataFrame = now, on: DataFrame = on) -> DataFrame:
            moved = F.col("_next").isNotNull()
            return now.join(on, "target", "left").select("alias", F.coalesce("_next", "target").alias("target"), (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps"), moved.alias("moved"))

        now = stage(spark, f"{path}/{k}", further)
        before, left = left, now.where("moved").count()
        if left == before:
            break
    to = now.select(F.col("alias").alias("target"), F.col("target").alias("_end"), F.col("steps").alias("_more"), F.col("moved").alias("_moved"))
    circular = F.coalesce("_moved", F.lit(False))
    end, steps = F.coalesce("_end", "target"), F.lit(1).cast("long") + F.coalesce("_more", F.lit(0))
    return edges.join(to, "target", "left").select("alias", F.when(~circular, end).alias("target"), F.when(~circular, steps).alias("steps"), circular.alias("circular"))


def fallback_list(given: Column, defaults: Column, order: Column, last_resort: list[str]) -> Column:
    """The given list where it has rows; else the defaults (group -> model) in the given order of groups, else all of them by group; else
    the last resort. Empty names count for nothing."""
    named = lambda xs: F.filter(xs, lambda x: x.isNotNull() & (x != ""))
    some = lambda xs: F.when(F.size(xs) > 0, xs)
    ordered = named(F.transform(order, lambda g: F.try_element_at(defaults, g)))
    by_group = named(F.transform(F.array_sort(F.map_entries(defaults)), lambda e: e.value))
    return F.coalesce(some(given), some(ordered), some(by_group), F.array(*map(F.lit, last_resort)))


def shared_order(refs: Column, rows: Column) -> Column:
    """One order for all roles: the rows (array<struct<ref, kind>>), in which each model of refs (array<struct<ref, kind, client>>) that is no
    client takes its own row or the first row of its kind that none has taken; clients before, the rest of refs after, each once.

    A name without a slash is an alias: it takes no row. What a row was before a model took it is left out at the end as well.
    """
    slot = "array<struct<now:string,was:string,kind:string,taken:boolean>>"
    start = F.struct(F.transform(rows, lambda r: F.struct(r.ref.alias("now"), r.ref.alias("was"), r.kind.alias("kind"), F.lit(False).alias("taken"))).cast(slot).alias("slots"), F.expr("cast(array() as array<string>)").alias("placed"))
    mine = F.filter(refs, lambda r: F.instr(r.ref, "/") > 0)
    mine = F.filter(mine, lambda r: ~r.client)

    def step(acc, r):
        free = lambda test: F.array_position(F.transform(acc.slots, lambda s: ~s.taken & test(s)), True)
        own = free(lambda s: s.was == r.ref)
        at = F.when(own > 0, own).otherwise(free(lambda s: s.kind == r.kind))
        put = F.transform(acc.slots, lambda s, i: F.when(i + 1 == at, F.struct(r.ref.alias("now"), s.was.alias("was"), s.kind.alias("kind"), F.lit(True).alias("taken"))).otherwise(s))
        return F.struct(put.cast(slot).alias("slots"), F.when(at > 0, F.concat(acc.placed, F.array(r.ref))).otherwise(acc.placed).alias("placed"))

    def finish(acc):
        gone = F.transform(F.filter(acc.slots, lambda s: s.taken & (s.now != s.was)), lambda s: s.was)
        clients = F.transform(F.filter(refs, lambda r: r.client), lambda r: r.ref)
        rest = F.transform(F.filter(refs, lambda r: ~F.array_contains(acc.placed, r.ref) & ~F.array_contains(gone, r.ref)), lambda r: r.ref)
        return F.array_distinct(F.concat(clients, F.transform(acc.slots, lambda s: s.now), rest))

    return F.aggregate(mine, start, step, finish)


def kind_of(ref: Column) -> Column:
    """The provider of a model, by which rows of a shared order are told apart."""
    return X.trim_ws(F.split(ref, "/")[0])
