"""The segment protocol of model requests and replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

_ELEMENT = r"""(?s)<seg\s+id\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+)\s*>.*?</seg\s*>"""
_START = r"""^<seg\s+id\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))\s*>"""
_INSIDE = rf"(?s){_START}(.*)</seg\s*>$"


def format_segments(segments: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, request): the segments of a key as elements, one a line, in order."""
    one = X.segment_element("seg_id", "text")
    return segments.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, one.alias("e")))), lambda s: s.e), "\n").alias("request"))


def elements(reply: Column | str) -> Column:
    """array<struct<id, text>>: the elements of a reply in order, after thinking blocks and a fence around it are gone."""
    found = F.regexp_extract_all(X.clean_prose(reply), F.lit(f"({_ELEMENT})"), F.lit(1))
    part = lambda e, i: F.regexp_extract(e, _START, i)
    return F.transform(found, lambda e: F.struct(X.trim_ws(F.concat(part(e, 1), part(e, 2), part(e, 3))).alias("id"), F.regexp_extract(e, _INSIDE, 4).alias("text")))


def parse_reply(reply: Column | str, expected: Column | str) -> Column:
    """struct(segments, missing, extra, duplicate, conflicting, ok): the first element of an id wins, a blank one is missing."""
    return parse_elements(elements(reply), X.col(expected))


def with_parsed(rows: DataFrame, reply: str, expected: str, name: str) -> DataFrame:
    """rows with parse_reply() as column `name`; the reply's patterns run once for each row, not once for each id."""
    return rows.withColumn("_elements", elements(reply)).withColumn(name, parse_elements(F.col("_elements"), X.col(expected))).drop("_elements")


def parse_elements(es: Column, want: Column) -> Column:
    """parse_reply() of elements that were taken from the reply before. Every list is made once; ids are looked up by place."""
    return X.let(es, lambda es: X.let(F.transform(es, lambda e: e.id), lambda ids: X.let(F.array_distinct(ids), lambda distinct: _read(es, ids, distinct, want))))


def _read(es: Column, ids: Column, distinct: Column, want: Column) -> Column:
    first = lambda i: F.element_at(es, F.array_position(ids, i).cast("int")).text
    full = F.filter(F.transform(F.array_intersect(distinct, want), lambda i: F.struct(i.alias("id"), X.trim_ws(first(i)).alias("text"))), lambda e: e.text != "")
    twice = F.filter(distinct, lambda i: F.size(F.filter(ids, lambda x: x == i)) > 1)
    duplicate = F.when(F.size(distinct) == F.size(ids), F.expr("cast(array() as array<string>)")).otherwise(twice)
    conflicting = lambda twice: F.filter(F.array_intersect(twice, want), lambda i: F.size(F.array_distinct(F.transform(F.filter(es, lambda e: e.id == i), lambda e: X.collapse(e.text)))) > 1)
    missing = lambda full: X.let(F.transform(full, lambda e: e.id), lambda given: F.filter(want, lambda i: ~F.array_contains(given, i)))
    lists = lambda full, duplicate, missing, extra: F.struct(
        F.map_from_entries(full).alias("segments"),
        missing.alias("missing"),
        extra.alias("extra"),
        duplicate.alias("duplicate"),
        conflicting(duplicate).alias("conflicting"),
        ((F.size(missing) == 0) & (F.size(extra) == 0) & (F.size(duplicate) == 0)).alias("ok"),
    )
    return X.let(full, lambda f: X.let(duplicate, lambda d: X.let(missing(f), lambda m: X.let(F.array_except(distinct, want), lambda x: lists(f, d, m, x)))))


def salvage(parsed: Column, expected: Column | str) -> Column:
    """struct(keep, ask): what a failed reply still gives and what to ask again; null where it is not worth it."""
    want = X.col(expected)
    ask = F.filter(want, lambda i: F.array_contains(parsed.missing, i) | F.array_contains(parsed.conflicting, i))
    keep = F.filter(F.map_keys(parsed.segments), lambda i: ~F.array_contains(parsed.conflicting, i))
    most = F.greatest(F.lit(2), F.ceil(F.size(want) / 4))
    good = (F.size(parsed.extra) == 0) & (F.size(keep) > 0) & (F.size(ask) < F.size(want)) & (F.size(ask) <= most)
    return F.when(good, F.struct(F.array_sort(keep).alias("keep"), ask.alias("ask")))
