"""Glossary terms: which occur in a text, whether a translation has their target, and merging of lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import unicode as U

_PALATAL = {"k": "c", "c": "k", "g": "z", "z": "g", "h": "s", "s": "h"}  # fixed values: endings that alternate


def term_key(c: Column | str) -> Column:
    """Lower case, single spaces. Texts are taken to be in composed form; normalize_term() composes."""
    return X.collapse(F.lower(X.col(c)))


def term_pattern(key: Column | str) -> Column:
    """A pattern for the term as a whole word or phrase, any case, any white space between its words."""
    safe = F.regexp_replace(X.col(key), r"([.*+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])"), F.replace(safe, F.lit(" "), F.lit(r"\s+")), F.lit(r"(?![\p{L}\p{N}])"))


def relevant_entries(texts: DataFrame, keys: list[str], glossary: DataFrame, most: int = 60) -> DataFrame:
    """(keys, ord, term, target_term): the first `most` entries, in glossary order, whose term occurs in text; keys are unique.

    Texts and terms in composed form meet by an equal join on one word, or sign, of the term; texts do not go along. A term that is
    that word is found by that; only for longer ones the text is fetched and the pattern decides.
    """
    token = r"([\p{L}\p{N}]+|[^\p{L}\p{N}\s])"
    g = glossary.select("ord", "term", "target_term", U.normalize_term("term").alias("_key")).where("_key <> ''")
    first = F.when(F.col("_key").rlike(r"[\p{L}\p{N}]"), F.regexp_extract("_key", r"([\p{L}\p{N}]+)", 1)).otherwise(F.substring("_key", 1, 1))
    g = g.withColumn("_first", first).withColumn("_pattern", F.when(F.col("_key") != first, term_pattern("_key")))
    decomposed = F.col("text").rlike(r"[\p{M}\x{1100}-\x{11ff}\x{2126}\x{212a}\x{212b}]")
    texts = texts.select(*keys, "text")
    texts = texts.where(~decomposed).union(texts.where(decomposed).withColumn("text", U.composed("text")))
    rows = texts.select(*keys, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(token), F.lit(1)))).alias("_first"))
    met = rows.join(g, "_first")
    cols = [*keys, "ord", "term", "target_term"]
    hits = met.where("_pattern is null").select(cols)
    if not g.where("_pattern is not null").isEmpty():
        hits = hits.union(met.where("_pattern is not null").join(texts, keys).where("text rlike _pattern").select(cols))
    place = Window.partitionBy(*keys).orderBy("ord")
    return hits.withColumn("_r", F.row_number().over(place)).where(F.col("_r") <= most).drop("_r")


def has_target(translation: Column, target: Column) -> Column:
    """Whether every word of the target begins, by its stem, some word of the translation; endings k/c, g/z, h/s alternate."""
    hay = F.lower(translation)

    def present(w):
        n = F.length(w)
        stem = F.substring(w, F.lit(1), n - F.when(n >= 7, 2).when(n >= 4, 1).otherwise(0))
        end = F.right(stem, F.lit(1))
        other = F.lit(None).cast("string")
        for a, b in _PALATAL.items():
            other = F.when(end == a, F.lit(b)).otherwise(other)
        alt = F.concat(F.substring(stem, F.lit(1), F.length(stem) - 1), other)
        begins = lambda s: F.exists(F.regexp_extract_all(hay, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda x: x.startswith(s)) | F.coalesce(F.regexp_like(hay, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.regexp_replace(s, r"([.*+?^${}()|\[\]\\])", r"\\$1"))), F.lit(False))
        return begins(stem) | F.coalesce(begins(alt), F.lit(False))

    return F.forall(X.words(F.lower(target)), present)


def merge_glossaries(base: DataFrame, extra: DataFrame) -> DataFrame:
    """(added, ord, source, target, gender, note): base rows (added 0) stay; a row whose key is taken only fills the missing gender or
    note of the last base row (or first new row) of that key; other new rows (added 1) follow in their order."""
    rows = base.withColumn("_new", F.lit(0)).unionByName(extra.withColumn("_new", F.lit(1))).withColumn("_key", term_key("source"))
    rows = rows.where((F.col("_new") == 0) | (F.col("_key") != ""))
    own = Window.partitionBy("_key")
    in_order = own.orderBy("_new", "ord")
    rows = rows.withColumn("_n", F.row_number().over(in_order)).withColumn("_base", F.sum(1 - F.col("_new")).over(own))
    holder = F.greatest(F.col("_base"), F.lit(1))
    is_holder = F.col("_n") == holder
    later = lambda c: F.first(F.when((F.col("_n") > holder) & (F.col(c) != ""), F.col(c)), ignorenulls=True).over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    fill = lambda c: F.when(is_holder & (F.coalesce(F.col(c), F.lit("")) == ""), later(c)).otherwise(F.col(c)).alias(c)
    kept = rows.withColumn("_keep", (F.col("_new") == 0) | is_holder).select("_new", "ord", "source", "target", fill("gender"), fill("note"), "_keep")
    return kept.where("_keep").select(F.col("_new").alias("added"), "ord", "source", "target", "gender", "note")


def parse_table(texts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ord, source, target, type, gender, note) from Markdown tables; rows without source or target are passed over."""
    lines = texts.select(*keys, F.posexplode(F.split("text", "\r?\n")).alias("ord", "line")).where(F.instr("line", "|") > 0)
    body = F.regexp_replace(F.regexp_replace(X.trim_ws("line"), r"^\|", ""), r"(?<!\\)\|$", "")
    cells = F.transform(F.split(body, r"(?<!\\)\|"), lambda c: X.trim_ws(F.replace(c, F.lit("\\|"), F.lit("|"))))
    rows = lines.withColumn("c", cells)
    cell = lambda i: F.try_element_at("c", F.lit(i))
    text = lambda i: F.when(cell(i) != "", cell(i))
    divider = F.forall("c", lambda x: (x == "") | x.rlike("^:?-{2,}:?$"))
    header = (F.lower(cell(1)) == "source") & (F.lower(F.coalesce(cell(2), F.lit(""))) == "target")
    return rows.where(~divider & ~header & text(1).isNotNull() & text(2).isNotNull()).select(*keys, "ord", cell(1).alias("source"), cell(2).alias("target"), F.coalesce(text(3), F.lit("term")).alias("type"), text(4).alias("gender"), text(5).alias("note"))


def table_text(entries: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text): the Markdown table of the entries, in order; pipes within a cell get a backslash."""
    cell = lambda c: X.trim_ws(F.replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), "\r?\n", " "), F.lit("|"), F.lit("\\|")))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(c) for c in ("source", "target", "type", "gender", "note"))), F.lit(" |"))
    head = "| Source | Target | Type | Gender | Note |\n|---|---|---|---|---|\n"
    return entries.groupBy(*keys).agg(F.concat(F.lit(head), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", row.alias("line")))), lambda s: s.line), "\n"), F.lit("\n")).alias("text"))


# The types of a term.
TERM_TYPES = ["person", "place", "org", "term", "phrase"]


def merge_passes(existing: DataFrame, passes: DataFrame) -> DataFrame:
    """(added, ord, source, target, gender, note, type): the glossary after passes over the text, (pass, ord, source, target, type, gender, note, failed).

    Passes are read side by side and merged once: the first row of a term wins and later ones fill its gaps, which is what merging
    pass after pass gives. Rows of failed passes, without source or without target are left out; unknown types become `term`. If there are passes and
    all have failed, reading the result fails.
    """
    clean = lambda c: X.trim_ws(F.coalesce(F.col(c), F.lit("")))
    kind = F.lower(clean("type"))
    typed = lambda df: df.withColumn("type", F.when(kind.isin(TERM_TYPES), kind).otherwise("term"))
    good = passes.where(~F.coalesce("failed", F.lit(False)) & (clean("source") != "") & (clean("target") != ""))
    row = lambda df, order: df.select(order.alias("ord"), clean("source").alias("source"), clean("target").alias("target"), F.nullif(F.lower(clean("gender")), F.lit("")).alias("gender"), F.nullif(clean("note"), F.lit("")).alias("note"), "type")
    extra = row(typed(good), F.struct(F.col("pass").cast("long").alias("pass"), F.col("ord").cast("long").alias("ord")))
    base = existing.select(F.struct(F.lit(0).cast("long").alias("pass"), F.col("ord").cast("long").alias("ord")).alias("ord"), "source", "target", "gender", "note")
    kinds = extra.groupBy(term_key("source").alias("_k")).agg(F.min_by("type", "ord").alias("_type"))
    old = existing.groupBy(term_key("source").alias("_k")).agg(F.min_by("type", "ord").alias("_old"))
    out = merge_glossaries(base, extra.drop("type")).withColumn("_k", term_key("source")).join(old, "_k", "left").join(kinds, "_k", "left")
    lost = passes.agg((F.count("*") > 0).alias("some"), F.coalesce(F.bool_and(F.coalesce("failed", F.lit(False))), F.lit(False)).alias("all"))
    out = out.crossJoin(F.broadcast(lost))  # one row
    fine = F.when(F.col("some") & F.col("all"), F.raise_error(F.lit("every glossary pass failed")).cast("int")).otherwise(F.col("added"))
    return out.select(fine.alias("added"), F.col("ord.pass").alias("pass"), F.col("ord.ord").alias("ord"), "source", "target", "gender", "note", F.coalesce("_old", "_type").alias("type"))
