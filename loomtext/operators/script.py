"""Lines of visual-novel scripts, packs and catalogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .glossary import term_key

_S = "[ \t]*"
_ID = "[A-Za-z0-9_-]+"
# Line classes in the order they are tried, with the pattern of each; (prefix)(text)(suffix) where there is text.
LINE_CLASSES = [
    ("blank", rf"^{_S}$"),
    ("break", rf"^{_S}(?:-(?:{_S}-){{2,}}|\*(?:{_S}\*){{2,}}|_(?:{_S}_){{2,}}){_S}$"),
    ("heading", rf"^({_S}#{{1,6}}[ \t]+)(.*?)({_S}#*{_S})$"),
    ("scene", rf"(?i)^({_S}\**{_S}(?:scene|scena){_S}:{_S}\**{_S})(.+?)({_S}\**{_S})$"),
    ("cast", rf"(?i)^{_S}\**{_S}(?:on screen|na ekranu){_S}:"),
    ("testimonyEnd", rf"(?i)^{_S}\**{_S}(?:end[ \t]+testimony|kraj[ \t]+svjedo[čc]enja){_S}\**{_S}$"),
    ("puzzle", rf"(?i)^{_S}\**{_S}(?:puzzle|zagonetka){_S}:{_S}\**{_S}{_ID}{_S}(?:\({_S}{_ID}{_S}\))?{_S}\**{_S}$"),
    ("clue", rf"(?i)^({_S}\**{_S}(?:clue|trag){_S}:{_S}\**{_S}{_ID}{_S}/{_S}{_ID}{_S}:{_S}\**{_S})(.*?)({_S}\**{_S})$"),
    ("evidence", rf"(?i)^({_S}\**{_S}(?:evidence|dokaz){_S}:{_S}\**{_S}{_ID}{_S}:{_S}\**{_S})(.*?)({_S}\**{_S})$"),
    ("testimony", rf"(?i)^({_S}\**{_S}(?:testimony|svjedo[čc]enje){_S}:{_S}\**{_S})(.*?)({_S}\**{_S})$"),
    ("narration", rf"(?i)^({_S}\**{_S}(?:narration|narrator|naracija|pripovjeda[čc]){_S}\**(?:{_S}\([^)]*\))?{_S}:\**{_S})(.*?)({_S})$"),
    ("direction", rf"^{_S}\**(?:(?:SMASH |MATCH |JUMP |HARD |QUICK )?CUT(?: TO| BACK TO| NA)?|FADE(?: IN| OUT| TO(?: BLACK| WHITE)?| U CRNO)?|DISSOLVE(?: TO)?|(?:INT|EXT)(?:[ ./][\p{{Lu}}\p{{N}}'’ ./-]*)?|REZ(?: NA)?|PRIJELAZ(?: NA)?|ZATAMNJENJE)\**{_S}[:.]?\**{_S}$"),
    ("line", rf"^({_S}\**[\p{{Lu}}][\p{{Lu}}\p{{N}}'’ .-]{{0,40}}?\**(?:{_S}\([^)]{{1,120}}\))?{_S}:\**[ \t]+)(.+?)({_S})$"),
]


def line_class(c: Column | str) -> Column:
    """The class of a script line; a line of no other class is narration."""
    t, out = X.col(c), None
    for name, pattern in LINE_CLASSES:
        out = F.when(t.rlike(pattern), name) if out is None else out.when(t.rlike(pattern), name)
    return out.otherwise("narration")


def line_parts(c: Column | str) -> Column:
    """struct(cls, prefix, text, suffix): what stays and what is translated; the parts join to the line."""
    t, out = X.col(c), None
    parts = lambda cls, prefix, text, suffix: F.struct(F.lit(cls).alias("cls"), prefix.alias("prefix"), text.alias("text"), suffix.alias("suffix"))
    for name, pattern in LINE_CLASSES:
        has_text = "(.*?)" in pattern or "(.+?)" in pattern
        own = parts(name, *(F.regexp_extract(t, pattern, i) for i in (1, 2, 3))) if has_text else parts(name, t, F.lit(""), F.lit(""))
        out = F.when(t.rlike(pattern), own) if out is None else out.when(t.rlike(pattern), own)
    lead, trail = F.regexp_extract(t, r"^[ \t]*", 0), F.regexp_extract(t, r"[ \t]*$", 0)
    inner = F.substring(t, F.length(lead) + 1, F.greatest(F.lit(0), F.length(t) - F.length(lead) - F.length(trail)))
    return out.otherwise(parts("narration", lead, inner, trail))


def character_labels(names: DataFrame, speakers: DataFrame, key: str) -> DataFrame:
    """(key, label): given names, then speakers in order of appearance; the first spelling of a name wins."""
    both = names.select(key, "label", "ord", F.lit(0).alias("_p")).union(speakers.select(key, "label", "ord", F.lit(1).alias("_p")))
    both = both.withColumn("_k", term_key("label")).where("_k <> ''")
    first = Window.partitionBy(key, "_k").orderBy("_p", "ord")
    return both.withColumn("_r", F.row_number().over(first)).where("_r = 1").select(key, "label", "_p", "ord")


def name_map(glossary: DataFrame, labels: DataFrame) -> DataFrame:
    """(name, target): the last person row of each label whose target differs."""
    rows = glossary.withColumn("name", term_key("source")).where((F.lower(X.trim_ws("type")) == "person") & (X.trim_ws("target") != "") & (term_key("target") != F.col("name")))
    rows = rows.join(labels.select(term_key("label").alias("name")).distinct(), "name", "left_semi")
    return rows.groupBy("name").agg(X.trim_ws(F.max_by("target", "ord")).alias("target"))


def shared_targets(names: DataFrame) -> DataFrame:
    """(target, sources): targets that more than one name has."""
    return names.groupBy(F.lower("target").alias("target")).agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("sources"), F.count("*").alias("n")).where("n > 1")


def duplicate_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_references(rows: DataFrame, column: str, targets: DataFrame, key: str) -> DataFrame:
    """Rows whose reference is not null and has no target."""
    return rows.where(F.col(column).isNotNull()).join(targets.select(F.col(key).alias(column)).distinct(), column, "left_anti")


def key_parity(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, problem): keys that only one side has."""
    missing = expected.select(key).distinct().join(actual, key, "left_anti").select(key, F.lit("missing").alias("problem"))
    return missing.union(actual.select(key).distinct().join(expected, key, "left_anti").select(key, F.lit("unknown").alias("problem")))


# A spoken line's start as marks, name and what follows it; an on-screen line; one entry of it.
_SPEAKER = r"^([ \t]*\**)([\p{Lu}][\p{Lu}\p{N}'’ .-]{0,40}?)(\**(?:[ \t]*\([^)]{1,120}\))?[ \t]*:\**[ \t]+)$"
_ON_SCREEN = r"(?iu)^([ \t]*\**[ \t]*(?:on screen|na ekranu)[ \t]*:[ \t]*\**[ \t]*)(.*?)([ \t]*)$"
_ENTRY = r"(?s)^([ \t]*\**[ \t]*)([^(*]+?)([ \t]*(?:\(.*)?\**[ \t]*)$"


def outer_commas(c: Column | str) -> Column:
    """array<string>: the text cut at the commas that stand outside of round brackets; a closing bracket too many counts for nothing.

    Pieces between commas are joined again while a bracket is open, so the fold is over pieces, not characters.
    """
    depth = lambda s, at: F.aggregate(F.regexp_extract_all(s, F.lit("([()])"), F.lit(1)), at, lambda d, b: F.when(b == "(", d + 1).otherwise(F.greatest(F.lit(0), d - 1)))
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit(None).cast("string").alias("open"), F.lit(0).alias("depth"))

    def step(acc, piece):
        whole = F.when(acc.open.isNull(), piece).otherwise(F.concat_ws(",", acc.open, piece))
        after = depth(piece, acc.depth)
        return F.struct(F.when(after == 0, F.concat(acc.done, F.array(whole))).otherwise(acc.done).alias("done"), F.when(after > 0, whole).alias("open"), after.alias("depth"))

    return F.aggregate(F.split(X.col(c), ","), start, step, lambda acc: F.when(acc.open.isNull(), acc.done).otherwise(F.concat(acc.done, F.array(acc.open))))


def localized_names(rows: DataFrame, line: str, names: str) -> DataFrame:
    """rows with `localized`, the line with names written as the map column `names` (term_key() of a name -> name) has them, and `kept`, a name that
    could not be written: with it the line would not be of its class any more.

    Names of spoken lines go in capitals with their marks; names of on-screen lines and witnesses as they are. A name with comma or bracket
    is not put on screen. Other lines stay.
    """
    p = lambda f: F.col(f"_p.{f}")
    once = lambda c, name: F.explode(F.array(c)).alias(name)  # noqa: E731  worked out once, not again wherever a part of it is used
    rows = rows.select("*", once(line_parts(line), "_p"))
    target = lambda name: F.nullif(X.trim_ws(F.try_element_at(F.col(names), term_key(name))), F.lit(""))
    speaker = lambda i: F.regexp_extract(p("prefix"), _SPEAKER, i)
    spoken_to = F.when((p("cls") == "line") & p("prefix").rlike(_SPEAKER), target(speaker(2)))
    witness_to = F.when(p("cls") == "testimony", target(X.trim_ws(p("text"))))
    prefix = F.when(spoken_to.isNotNull(), F.concat(speaker(1), F.upper(spoken_to), speaker(3))).otherwise(p("prefix"))
    text = F.when(witness_to.isNotNull(), witness_to).otherwise(p("text"))
    rows = rows.withColumn("_prefix", prefix).withColumn("_text", text).withColumn("_to", F.coalesce(spoken_to, witness_to))
    rows = rows.select("*", once(line_parts(F.concat("_prefix", "_text", p("suffix"))), "_again"))
    holds = (F.col("_again.cls") == p("cls")) & (F.col("_again.prefix") == F.col("_prefix")) & (F.col("_again.suffix") == p("suffix"))
    part = lambda e, i: F.regexp_extract(e, _ENTRY, i)
    fits = lambda e: target(part(e, 2)).isNotNull() & ~target(part(e, 2)).rlike("[,()]")
    screen = lambda i: F.regexp_extract(F.col(line), _ON_SCREEN, i)
    entries = outer_commas(screen(2))
    shown = F.array_join(F.transform(entries, lambda e: F.when(fits(e), F.concat(part(e, 1), target(part(e, 2)), part(e, 3))).otherwise(e)), ",")
    on_screen = F.concat(screen(1), shown, screen(3))
    refused = F.try_element_at(F.filter(entries, lambda e: target(part(e, 2)).isNotNull() & ~fits(e)), F.lit(1))
    changes = F.col("_to").isNotNull()
    out = F.when(p("cls") == "cast", on_screen).when(changes & holds, F.concat("_prefix", "_text", p("suffix"))).otherwise(F.col(line))
    kept = F.when(p("cls") == "cast", X.trim_ws(part(refused, 2))).when(changes & ~holds, F.when(p("cls") == "line", X.trim_ws(speaker(2))).otherwise(X.trim_ws(p("text"))))
    return rows.withColumn("localized", out).withColumn("kept", kept).drop("_p", "_prefix", "_text", "_to", "_again")
