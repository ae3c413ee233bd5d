"""Scalar text functions as Column expressions. White space in engine rules is space, tab, carriage return and line feed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[ \t\r\n]"

# Right-to-left languages, model families in the order they are looked for, structural labels of a script.
RTL = ["ar", "he", "iw", "fa", "ur", "yi", "ps", "sd", "ug", "dv", "ckb"]
FAMILIES = ["qwen", "nemotron", "poolside", "laguna", "deepseek", "llama", "mistral", "gemma", "gemini", "claude", "gpt", "grok", "nomic", "glm", "kimi"]
LABELS = ["SCENE", "ON SCREEN", "NARRATION", "CG", "INSERT", "SFX", "AMBIENCE", "CLUE", "EVIDENCE", "PUZZLE", "TESTIMONY"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value worked out once for a row however often it is used; within a lambda Spark would work it out each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def trim_ws(c: Column | str) -> Column:
    return F.trim(col(c), F.lit(" \t\r\n"))


def words(c: Column | str) -> Column:
    return F.filter(F.split(col(c), rf"{WS}+"), lambda w: w != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def rough_tokens(c: Column | str) -> Column:
    """Four characters a token, rounded up."""
    return F.ceil(F.length(col(c)) / 4).cast("long")


def one_line(c: Column | str) -> Column:
    return trim_ws(F.regexp_replace(col(c), rf"{WS}*\r?\n{WS}*", " "))


def collapse(c: Column | str) -> Column:
    return trim_ws(F.regexp_replace(col(c), rf"{WS}+", " "))


def cut(c: Column | str, most: int) -> Column:
    """The text, or its first most - 1 characters without end space and an ellipsis."""
    t = col(c)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.regexp_replace(F.substring(t, 1, most - 1), rf"{WS}+$", ""), F.lit("…")))


def fit_edges(source: Column | str, text: Column | str) -> Column:
    """The text trimmed, after the indentation of its source."""
    return F.concat(F.regexp_extract(col(source), r"^[ \t]*", 0), trim_ws(text))


def tag_tokens(c: Column | str) -> Column:
    """Placeholder tags in order: <1>, </1>, <2/>; a tag with both slashes is none."""
    return F.filter(F.regexp_extract_all(col(c), F.lit(r"(</?[0-9]+/?>)"), F.lit(1)), lambda t: ~t.rlike("^</.*/>$"))


def strip_tags(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"<(?:/[0-9]+|[0-9]+/?)>", "")


def text_outside_tags(c: Column | str) -> Column:
    return strip_tags(F.regexp_replace(col(c), r"(?s)<([0-9]+)>.*?</\1>", " "))


def lead(c: Column | str) -> Column:
    """A paragraph without the tags, emphasis and space it starts with."""
    return F.regexp_replace(col(c), r"^(?:[ \t\r\n]|</?[0-9]+/?>|[*_#>])+", "")


def strip_thinking(c: Column | str) -> Column:
    t = F.regexp_replace(col(c), r"(?is)<think>.*?</think>", "")
    return F.ltrim(F.substring_index(t, "</think>", -1), F.lit(" \t\r\n"))


def clean_prose(c: Column | str) -> Column:
    fence = r"(?is)^```[a-z]*\n(.*?)\n```$"
    return let(trim_ws(strip_thinking(c)), lambda t: F.when(t.startswith("```") & t.rlike(fence), trim_ws(F.regexp_extract(t, fence, 1))).otherwise(t))


def first_json(c: Column | str) -> Column:
    """The text from the first { to the last } of a reply, null where there is none."""

    def between(t: Column) -> Column:
        start, end = F.instr(t, "{"), F.length(t) - F.instr(F.reverse(t), "}") + 1
        return F.when((start > 0) & (F.instr(t, "}") > 0) & (end > start), F.substring(t, start, end - start + 1))

    return let(strip_thinking(c), between)


def escape_xml(c: Column | str) -> Column:
    t = col(c)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return t


def escape_line_start(c: Column | str) -> Column:
    t = col(c)
    return F.when(t.rlike(r"^(#|>|[-*+][ \t]|[0-9]+[.)][ \t])"), F.concat(F.lit("\\"), t)).otherwise(t)


def is_rtl(c: Column | str) -> Column:
    return F.coalesce(F.split(F.lower(trim_ws(c)), "[-_]")[0].isin(RTL), F.lit(False))


def guess_family(c: Column | str) -> Column:
    s = F.lower(col(c))
    out = None
    for f in FAMILIES:
        name = F.lit("poolside" if f == "laguna" else f)
        out = F.when(s.contains(f), name) if out is None else out.when(s.contains(f), name)
    return out.when(F.instr(s, "/") > 0, F.substring_index(s, "/", 1)).otherwise("unknown")


def normalize_repeat(c: Column | str) -> Column:
    return collapse(F.regexp_replace(F.lower(col(c)), "[0-9]+", "#"))


def join_lines(prev: Column | str, following: Column | str) -> Column:
    """Two lines as one: a hyphen between letters goes where the next line goes on in lower case."""
    a, b = col(prev), col(following)
    return F.when(a.rlike(r"\p{L}-$") & b.rlike(r"^\p{Ll}"), F.concat(F.substring(a, F.lit(1), F.length(a) - 1), b)).otherwise(F.concat_ws(" ", a, b))


# Words that start a chapter's heading.
CHAPTER_START = "(?:chapter|part|book|prologue|epilogue|poglavlje|kapitel|chapitre|cap[ií]tulo|capitolo|teil|глава|часть)(?![A-Za-z0-9_])"


def is_chapter_line(c: Column | str) -> Column:
    """A heading line of a plain text, at most 80 characters."""
    t = trim_ws(c)
    return (F.length(t) > 0) & (F.length(t) <= 80) & t.rlike(rf"(?i)^[ \t]*{CHAPTER_START}")


def is_citation(c: Column | str) -> Column:
    """Mostly links, or an author-year entry."""
    t = trim_ws(c)
    links = F.regexp_extract_all(t, F.lit(r"(?i)((?:https?://|www\.)[^ \t\r\n]+|\bdoi:[ \t\r\n]*[^ \t\r\n]+|\bisbn(?:-1[03])?:?[ \t\r\n]*[0-9-]+x?)"), F.lit(1))
    chars = F.aggregate(links, F.lit(0), lambda n, m: n + F.length(m))
    entry = t.rlike(r"(?s)^[ \t\r\n]*\p{Lu}[\p{L}'’-]+,[ \t\r\n]*(?:\p{Lu}\.[ \t\r\n]*)+.*\b(?:1[5-9]|20)[0-9]{2}[a-z]?\b")
    return (F.length(t) > 0) & ((chars / F.greatest(F.length(t), F.lit(1)) >= 0.25) | entry)


def catalog_problem(c: Column | str) -> Column:
    """Why a catalog value cannot be used; null where it can. The first rule that fails names it."""
    v = col(c)
    head = F.regexp_replace(v, r"^[ \t\r\n*_]+", "")
    label = "|".join(x.replace(" ", "[ ]+") for x in LABELS)
    return (
        F.when(v.isNull(), "is not a string")
        .when(trim_ws(v) == "", "is empty")
        .when(v.rlike("[\r\n]"), "is more than one line")
        .when(v.rlike("</?[0-9]+/?>"), "contains an inline placeholder tag")
        .when(head.rlike(rf"(?i)^(?:{label})[ ]*:"), "begins with a structural label")
        .when(v.rlike(r"(?:^|[^\p{L}\p{N}_])ch[0-9]{2}\.s[0-9]{2}(?:\.b[0-9]{3})?(?:$|[^\p{L}\p{N}_])"), "contains a scene or beat id")
    )


def dialogue_mark(c: Column | str) -> Column:
    """How a paragraph opens dialogue: dash, quotes, guillemets or null."""
    t = lead(c)
    return F.when(t.rlike("^[–—―]"), "dash").when(t.rlike("^[„“\"”]"), "quotes").when(t.rlike("^[«»]"), "guillemets")


def parse_score(c: Column | str) -> Column:
    """A grade from text, comma or point, within 0 to 10, to one decimal; null where it is none."""
    n = F.replace(trim_ws(c), F.lit(","), F.lit(".")).try_cast("double")
    return F.floor(F.greatest(F.lit(0.0), F.least(F.lit(10.0), n)) * 10 + 0.5) / 10


def same_hash(a: Column | str, b: Column | str) -> Column:
    bare = lambda c: F.regexp_replace(F.lower(trim_ws(c)), "^sha256:", "")
    return bare(a) == bare(b)


def uuid_from(c: Column | str) -> Column:
    h = F.sha1(col(c))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4), F.substring(h, 17, 4), F.substring(h, 21, 12))


def format_duration(sec: Column | str) -> Column:
    s = col(sec)
    r = lambda x: F.floor(x + 0.5).cast("long").cast("string")
    return F.when(s.isNull(), "?").when(s < 90, F.concat(r(F.greatest(F.lit(0), s)), F.lit("s"))).when(s < 5400, F.concat(r(s / 60), F.lit(" min"))).otherwise(F.concat((F.floor(s / 360 + 0.5) / 10).cast("decimal(20,1)").cast("string"), F.lit(" h")))


def format_count(n: Column | str) -> Column:
    c = col(n)
    tenths = lambda x: (F.floor(x * 10 + 0.5) / 10).cast("decimal(20,1)").cast("string")
    return F.when(c >= 1_000_000, F.concat(tenths(c / 1_000_000), F.lit("M"))).when(c >= 10_000, F.concat(F.floor(c / 1000 + 0.5).cast("string"), F.lit("k"))).when(c >= 1000, F.concat(tenths(c / 1000), F.lit("k"))).otherwise(c.cast("string"))


def error_class(status: Column | str, message: Column | str) -> Column:
    s, m = col(status), col(message)
    return (
        F.when((s == 429) & m.rlike("(?i)per[-_ ]day|daily"), "daily")
        .when(m.rlike("(?i)exceed_context_size|exceeds the available context|context (size|length|window)|maximum context|n_ctx|token limit without an answer"), "context")
        .when(s.isin(408, 425, 429) | (s >= 500), "retry")
        .otherwise("fatal")
    )


def segment_element(seg_id: Column | str, text: Column | str, tag: str = "seg") -> Column:
    return F.concat(F.lit(f'<{tag} id="'), col(seg_id), F.lit('">'), col(text), F.lit(f"</{tag}>"))


def speaker_name(c: Column | str) -> Column:
    """The name in a speaker tag at the start; null where there is none."""
    n = F.regexp_extract(col(c), r"^<1>\**[ \t\r\n]*([^(:*<]+?)[ \t\r\n]*\**(?:[ \t\r\n]*\([^)]*\))?[ \t\r\n]*:\**[ \t\r\n]*</1>", 1)
    return F.when(n != "", n)


def render_template(template: Column | str, values: dict[str, Column]) -> Column:
    """{{name}} filled from values; unknown names are empty."""
    t = col(template)
    for name, v in values.items():
        t = F.replace(t, F.lit("{{" + name + "}}"), F.coalesce(v, F.lit("")))
    return F.regexp_replace(t, r"\{\{[A-Za-z0-9_]+\}\}", "")


def cost_usd(price_in, price_cached, price_out, tokens_in, cached, tokens_out) -> Column:
    return (F.greatest(F.lit(0), col(tokens_in) - col(cached)) * col(price_in) + col(cached) * col(price_cached) + col(tokens_out) * col(price_out)) / 1_000_000


def key_name(c: Column | str) -> Column:
    """The name under which a provider's key is kept."""
    return F.concat(F.lit("CUSTOM_"), F.regexp_replace(F.upper(col(c)), "[^A-Z0-9]+", "_"), F.lit("_API_KEY"))


def export_refusal(c: Column | str, start: str = "export refused") -> Column:
    """The refusal within an error's text, from its start on; null where there is none."""
    t = col(c)
    return F.when(F.instr(t, start) > 0, F.substring(t, F.instr(t, start), F.length(t)))


def listed(numbers: Column | str, most: int = 20) -> Column:
    """Numbers as a list, the first `most` and how many more."""
    xs = col(numbers)
    shown = F.array_join(F.slice(xs, 1, most).cast("array<string>"), ", ")
    return F.when(F.size(xs) > most, F.concat(shown, F.lit(" and "), (F.size(xs) - most).cast("string"), F.lit(" more"))).otherwise(shown)


def looks_scanned(chars: Column | str, pages: Column | str) -> Column:
    """Whether a document has too little text to have a text layer."""
    return (col(chars) < 20) | (col(chars) < col(pages) * 5)


def discoverable(model_id: Column | str, skip: list[str], text_only: Column, price_in: Column, price_out: Column, free_only: Column) -> Column:
    """Whether a listed model is offered: no word to skip in its id, text only, a known price, free where only free ones are wanted."""
    word = F.lit(False)
    for w in skip:
        word = word | F.lower(col(model_id)).contains(w.lower())
    return ~word & text_only & price_in.isNotNull() & price_out.isNotNull() & (~free_only | ((price_in == 0) & (price_out == 0)))


def is_paid(local: Column, price_in: Column, price_out: Column, price_cached: Column) -> Column:
    return ~local & ((price_in > 0) | (price_out > 0) | (price_cached > 0))


def brief_additions(existing: Column | str, fields: dict[str, tuple[Column, list[str]]], characters: Column) -> Column:
    """Lines that a generated brief adds to a text: fields whose words it lacks, characters (struct name, gender, note) it does not
    name, under a heading unless it has one."""
    have = F.lower(col(existing))
    lines = []
    for label, (value, words_) in fields.items():
        known = F.lit(False)
        for w in words_:
            known = known | have.contains(w)
        lines.append(F.when(~known & (trim_ws(value) != ""), F.concat(F.lit(f"- {label}: "), trim_ws(value))))
    fresh = F.filter(characters, lambda c: (trim_ws(c["name"]) != "") & ~have.contains(F.lower(trim_ws(c["name"]))))
    rows = F.transform(fresh, lambda c: F.concat(F.lit("- "), c["name"], F.coalesce(F.concat(F.lit(" ("), c["gender"], F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(": "), c["note"]), F.lit(""))))
    head = F.when((F.size(fresh) > 0) & ~col(existing).rlike(r"(?im)^#+\s*characters"), F.array(F.lit("## Characters"))).otherwise(F.expr("cast(array() as array<string>)"))
    return F.concat(F.array_compact(F.array(*lines)), head, rows)


def rounded_to(value: Column, step: float) -> Column:
    """The nearest multiple of a step, halves up."""
    return F.floor(value / step + 0.5).cast("double") * step


def content_hash(c: Column | str) -> Column:
    """SHA-256 of a text's UTF-8 bytes, or of bytes."""
    return F.sha2(col(c).cast("binary"), 256)


def host(url: Column | str) -> Column:
    """The host of an address, in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(col(url), "^https?://([^/:?#]+)", 1))
