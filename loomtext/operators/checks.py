"""Deterministic checks of a translation against its source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .glossary import has_target, relevant_entries

MIN_RATIO, MAX_RATIO, MIN_RATIO_CHARS = 0.4, 2.5, 25
ISSUE_TYPES = ["omission", "addition", "mistranslation", "glossary", "tags", "untranslated"]


def numbered(tokens: Column) -> Column:
    """Each token with the count of its equals up to it, so that set operations treat a list as a multiset."""
    return F.transform(tokens, lambda t, i: F.concat(t, F.lit("#"), F.size(F.filter(F.slice(tokens, F.lit(1), i + 1), lambda u: u == t)).cast("string")))


def _bare(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.substring_index(t, "#", 1))


def nests(tokens: Column) -> Column:
    """Whether pairs close in the order they open; void tags are passed over."""
    start = F.struct(F.expr("cast(array() as array<string>)").alias("stack"), F.lit(True).alias("ok"))

    def step(acc, t):
        number = F.regexp_extract(t, "([0-9]+)", 1)
        opens, closes = t.rlike("^<[0-9]+>$"), t.rlike("^</")
        top = F.try_element_at(acc.stack, F.lit(-1))
        return F.struct(
            F.when(opens, F.concat(acc.stack, F.array(number))).when(closes & (F.size(acc.stack) > 0), F.slice(acc.stack, 1, F.greatest(F.size(acc.stack) - 1, F.lit(0)))).otherwise(acc.stack).alias("stack"),
            (acc.ok & (~closes | F.coalesce(top == number, F.lit(False)))).alias("ok"),
        )

    return F.aggregate(tokens, start, step, lambda acc: acc.ok & (F.size(acc.stack) == 0))


def tag_check(source: Column | str, translated: Column | str) -> Column:
    """struct(ok, missing, extra, misnested): the same multiset of tags, properly nested; lists are sorted."""
    left = lambda a, b: F.array_sort(_bare(F.array_except(a, b)))
    told = lambda missing, extra, bad: F.struct(((F.size(missing) == 0) & (F.size(extra) == 0) & ~bad).alias("ok"), missing.alias("missing"), extra.alias("extra"), bad.alias("misnested"))

    def compared(a: Column, b: Column) -> Column:
        return X.let(numbered(a), lambda na: X.let(numbered(b), lambda nb: X.let(left(na, nb), lambda m: X.let(left(nb, na), lambda x: X.let(~nests(b), lambda bad: told(m, x, bad))))))

    return X.let(X.tag_tokens(source), lambda a: X.let(X.tag_tokens(translated), lambda b: compared(a, b)))


def tags_hold(source: Column, translated: Column) -> Column:
    """tag_check().ok, at no cost where neither text has a tag."""
    return (~source.contains("<") & ~translated.contains("<")) | tag_check(source, translated).ok


def looks_untranslated(source: Column | str, kept_terms: list[str] = ()) -> Column:
    """Three words or more outside tags, not counting terms that are kept as they are; text with two letters together."""
    plain = X.trim_ws(X.strip_tags(source))
    outside = X.trim_ws(X.text_outside_tags(source))
    body = F.when(outside != "", outside).otherwise(plain)
    for t in kept_terms:
        body = F.regexp_replace(body, "(?iu)" + _quoted(t), " ")
    return plain.rlike(r"\p{L}{2}") & (X.word_count(body) >= 3)


def _quoted(t: str) -> str:
    return "".join("\\" + c if c in ".*+?^${}()|[]\\" else c for c in t)


def plain_issues(pairs: DataFrame, keys: list[str], same_language: bool = False, kept_terms: list[str] = ()) -> DataFrame:
    """(keys, ord, type, severity) for columns source and target: tags, untranslated or length ratio. A null target is passed over."""
    found = issues_of(F.col("source"), F.col("target"), same_language, kept_terms)
    return pairs.where(F.col("target").isNotNull()).select(*keys, F.explode(found).alias("i")).select(*keys, "i.ord", "i.type", "i.severity")


def issues_of(source: Column, target: Column, same_language: bool = False, kept_terms: list[str] = ()) -> Column:
    """array<struct(ord, type, severity)> of one pair, see plain_issues()."""
    one = lambda o, t, s: F.struct(F.lit(o).alias("ord"), F.lit(t).alias("type"), F.lit(s).alias("severity"))

    def all_of(src: Column, tgt: Column, same: Column) -> Column:
        ratio = F.length(tgt) / F.greatest(F.length(src), F.lit(1))
        sized = ~same & (F.length(src) >= MIN_RATIO_CHARS)
        return F.array_compact(
            F.array(
                F.when(~tags_hold(source, target), one(0, "tags", "major")),
                F.when(same, one(1, "untranslated", "major")),
                F.when(sized & (ratio < MIN_RATIO), one(2, "omission", "major")),
                F.when(sized & (ratio > MAX_RATIO), one(3, "addition", "minor")),
            )
        )

    same = lambda src, tgt: F.lit(not same_language) & (src != "") & (src == tgt) & looks_untranslated(source, list(kept_terms))
    plain = lambda c: X.trim_ws(X.strip_tags(c))
    return X.let(plain(source), lambda src: X.let(plain(target), lambda tgt: X.let(same(src, tgt), lambda s: all_of(src, tgt, s))))


def glossary_issues(pairs: DataFrame, keys: list[str], glossary: DataFrame) -> DataFrame:
    """(keys, term, target_term): glossary terms of the source whose target the translation lacks; citations are passed over."""
    rows = pairs.where(F.col("target").isNotNull() & ~X.is_citation("source"))
    hits = relevant_entries(rows.withColumnRenamed("source", "text"), keys, glossary)
    rows = rows.select(*keys, X.strip_tags("target").alias("_tgt"))
    return hits.join(rows, keys).where(~has_target(F.col("_tgt"), F.col("target_term"))).select(*keys, "term", "target_term")


def issue_score(major: Column, other: Column) -> Column:
    return F.greatest(F.lit(0), 10 - 3 * major - other)


def accept_proofread(source: Column | str, before: Column | str, after: Column | str) -> Column:
    """The proofread text where its tags hold and its length stays within 0.6 to 1.6 of the translation, else the translation."""
    b, a = F.coalesce(X.col(before), F.lit("")), X.fit_edges(source, after)
    ratio = F.length(a) / F.greatest(F.lit(1), F.length(b))
    return F.when(tag_check(source, a).ok & ratio.between(0.6, 1.6), a).otherwise(b)


def merge_reviews(deterministic: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """Issues of both, first wins for a segment and type; unknown types become mistranslation, other severities minor. Of issues
    that one place has of a type the major comes first, so the result does not depend on the order of rows."""
    tidy = model.withColumn("type", F.when(F.col("type").isin(ISSUE_TYPES), F.col("type")).otherwise("mistranslation")).withColumn("severity", F.when(F.col("severity") == "major", "major").otherwise("minor"))
    both = deterministic.withColumn("_p", F.lit(0)).unionByName(tidy.withColumn("_p", F.lit(1)))
    first = Window.partitionBy(*keys, "type").orderBy("_p", "ord", F.col("severity") != "major")
    own = both.withColumn("_r", F.row_number().over(first))
    return own.where((F.col("_p") == 0) | (F.col("_r") == 1)).drop("_p", "_r")


def affected(segments: DataFrame, issues: DataFrame, keys: list[str]) -> DataFrame:
    """Segments with at least one issue."""
    return segments.join(issues.select(*keys), keys, "left_semi")


def reply_issues(issues: DataFrame, pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Issues (keys, ord, type, ...) that a reviewing model gave, of segments there are (pairs: keys, source, target): tag issues go where the tags
    hold, and of one segment's issues of a type the first stays."""
    known = issues.join(pairs.select(*keys, tag_check("source", "target").ok.alias("_tags_hold")), keys)
    first = Window.partitionBy(*keys, "type").orderBy("ord")
    kept = known.where((F.col("type") != "tags") | ~F.col("_tags_hold")).withColumn("_r", F.row_number().over(first))
    return kept.where(F.col("_r") == 1).drop("_r", "_tags_hold")


def submission_problems(read: Column, segs: Column) -> Column:
    """array<string>: what keeps work that came from outside from being taken; empty: all of it is taken, else none.

    read is a parsed reply, segs array<struct<id, text>>.
    """
    told = lambda ids, what: F.transform(ids, lambda i: F.concat(i, F.lit(": " + what)))
    given = F.filter(segs, lambda s: F.map_contains_key(read.segments, s.id))
    wrong = F.filter(given, lambda s: ~tag_check(s.text, F.try_element_at(read.segments, s.id)).ok)
    return F.concat(told(read.missing, "missing"), told(read.extra, "unknown"), told(read.conflicting, "given twice"), told(F.transform(wrong, lambda s: s.id), "tags"))
