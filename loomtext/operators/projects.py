"""Projects: settings, summaries, editing, refresh reports, requests and acceptance of submitted work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from .rollup import RUNNING, qa_scores, state_counts

# How dialogue and quotations are marked by default, by language code, and codes of language names.
TYPOGRAPHY = {"hr": ("dash", "„…”"), "sr": ("dash", "„…”"), "bs": ("dash", "„…”"), "pl": ("dash", "„…”"), "ru": ("dash", "«…»"), "es": ("dash", "«…»"), "en": ("quotes", "“…”"), "de": ("quotes", "„…“"), "cs": ("quotes", "„…“")}
LANGUAGES = {"croatian": "hr", "serbian": "sr", "bosnian": "bs", "polish": "pl", "russian": "ru", "spanish": "es", "english": "en", "german": "de", "czech": "cs"}


def language_code(c: Column | str) -> Column:
    """The code of a language given by code or English name; null where the table does not know it."""
    k = F.lower(X.trim_ws(c))
    named = F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv))
    code = F.split(k, "[-_]")[0]
    return F.coalesce(F.try_element_at(named, k), F.when(code.isin(list(TYPOGRAPHY)), code))


def default_dialogue(c: Column | str) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for k, (d, _) in TYPOGRAPHY.items() for x in (k, d))), language_code(c))


def summaries(projects: DataFrame, chunks: DataFrame, key: str = "project") -> DataFrame:
    """projects with counts of their chunks and QA score, newest first by updated_at."""
    n = state_counts(chunks, [key])
    total = chunks.groupBy(key).agg(F.count("*").alias("chunks"))
    out = projects.join(total, key, "left").join(n, key, "left").join(qa_scores(chunks, [key]), key, "left")
    done = (F.col("done") + F.col("flagged")).alias("done")
    return out.select(*projects.columns, F.coalesce("chunks", F.lit(0)).alias("chunks"), done, "flagged", "failed", "score", "scored", "independent")


def retry_selection(chunks: DataFrame, indices: list[int] | None = None) -> DataFrame:
    """The named chunks, or those that failed or were at work."""
    return chunks.where(F.col("chunk_index").isin(indices) if indices else F.col("state").isin("failed", *RUNNING))


def recovered(chunks: DataFrame) -> DataFrame:
    """After a crash: work in progress is pending again, finished work stays."""
    return chunks.withColumn("state", F.when(F.col("state").isin(RUNNING), "pending").otherwise(F.col("state")))


def edited(chunks: DataFrame, key: str, edits: DataFrame) -> DataFrame:
    """chunks (key, final map) with edits (key, seg_id, text) over their finals; the edited ids are kept in order, issues go."""
    by = edits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("seg_id", "text"))).alias("_e"))
    rows = chunks.join(by, key, "left")
    keep = F.map_filter("final", lambda k, v: F.col("_e").isNull() | ~F.map_contains_key("_e", k))
    known = F.map_filter("_e", lambda k, v: F.map_contains_key("final", k))
    return rows.withColumn("edited_segs", F.when(F.col("_e").isNotNull(), F.array_sort(F.array_union(F.coalesce("edited_segs", F.array().cast("array<string>")), F.map_keys(known)))).otherwise(F.col("edited_segs"))).withColumn("final", F.when(F.col("_e").isNull(), F.col("final")).otherwise(F.map_concat(keep, known))).drop("_e")


def final_state(major: Column, error: Column) -> Column:
    return F.when((major > 0) | error.isNotNull(), "flagged").otherwise("done")


def worker_count(enabled: Column, at_once: Column, concurrency: Column) -> Column:
    """1 with parallel off; null at_once means as many as the provider allows; else 1 to 16."""
    return F.when(~enabled, 1).when(at_once.isNull(), F.greatest(F.lit(1), F.coalesce(concurrency, F.lit(1)))).otherwise(F.least(F.lit(16), F.greatest(F.lit(1), at_once)))


def requests(chunks: DataFrame, keys: list[str], terms: DataFrame, tails: DataFrame, system: str) -> DataFrame:
    """(keys, messages): the system prompt and a user message of glossary, previous passage and segments."""
    by = terms.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(" = ", "term", "target_term").alias("l")))), lambda s: F.concat(F.lit("- "), s.l)), "\n").alias("_terms"))
    rows = chunks.join(by, keys, "left").join(tails.select(*keys, F.col("source").alias("_before")), keys, "left")
    part = lambda title, c: F.when(c.isNotNull(), F.concat(F.lit(f"## {title}\n"), c))
    user = F.concat_ws("\n\n", part("Glossary", F.col("_terms")), part("Previous passage", F.col("_before")), part("Segments", F.col("request")))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return rows.select(*keys, F.array(message("system", F.lit(system)), message("user", user)).alias("messages"))


def with_model(requests: DataFrame, model, column: str = "messages") -> DataFrame:
    """requests with `reply`: model(list of {role, content}) -> text, called once for each row in the executors. A task may run
    again, so the function has to give the same answer or remember it."""

    @F.pandas_udf("string")
    def call(messages):
        return messages.map(lambda ms: model([{"role": m["role"], "content": m["content"]} for m in ms]))

    return requests.withColumn("reply", call(column))


def same_source_other_hash(projects: DataFrame) -> DataFrame:
    """(project, older): the newest other project of the same path and language whose source differs."""
    a, b = projects.alias("a"), projects.alias("b")
    hits = a.join(b, (F.col("a.path") == F.col("b.path")) & (F.col("a.lang") == F.col("b.lang")) & (F.col("a.hash") != F.col("b.hash")))
    newest = Window.partitionBy("project").orderBy(F.col("_t").desc(), "older")
    hits = hits.select(F.col("a.project").alias("project"), F.col("b.project").alias("older"), F.col("b.updated_at").alias("_t"))
    return hits.withColumn("_r", F.row_number().over(newest)).where("_r = 1").select("project", "older")


def first_success(attempts: DataFrame, call: str, order: str) -> DataFrame:
    """(call, model): the first attempt of each call that worked."""
    return attempts.where("ok").groupBy(call).agg(F.min_by("model", order).alias("model"))


def todo(chunks: DataFrame) -> DataFrame:
    """Chunks that are still to be run."""
    return chunks.where(F.col("state").isin("pending", "failed"))


def next_stage(state: Column, segments: Column, translation: Column, proofread: Column) -> Column:
    """Where a run goes on with a chunk: null for one that is done or flagged. A pending chunk that a pause parked keeps the output of the
    stages that finished; any other starts over, one at work when the run broke off too."""
    parked = (state == "pending") & (F.size(translation) > 0)
    whole = F.size(F.array_except(segments, F.map_keys(translation))) == 0
    proofs = F.size(proofread) > 0
    return F.when(state.isin("done", "flagged"), None).when(parked & whole & proofs, "review").when(parked & whole, "proofread").when(parked, "rest").otherwise("translate")


def newest_first(projects: DataFrame, key: str, ts: str, name: str) -> DataFrame:
    """(key, projects): names of a key's projects, the newest first, by name where the time is one."""
    newest = F.struct((-F.unix_micros(F.col(ts).cast("timestamp"))).alias("t"), name)
    return projects.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(newest)), lambda s: s[name].cast("string")), ",").alias("projects"))


def patched(base: Column, patch: Column) -> Column:
    """A value after a patch: a missing patch keeps it, an empty one clears it."""
    merged = F.coalesce(patch, base)
    return F.when(merged != "", merged)


def looked_up(rows: DataFrame, name: str, known: DataFrame, known_name: str) -> DataFrame:
    """rows with `found`: the known spelling of a name whatever its case; a name that is not known stays as it is."""
    table = known.select(F.col(known_name).alias("_known"), F.lower(known_name).alias("_k")).dropDuplicates(["_k"])
    return rows.withColumn("_k", F.lower(name)).join(table, "_k", "left").withColumn("found", F.coalesce("_known", name)).drop("_k", "_known")


# Formats of which a changed source is a new project.
NOT_REFRESHED = ("vn", "vnp")


def refresh_refusal(running: Column, kind: Column, new_kind: Column) -> Column:
    """Why a project's source may not be refreshed now; null: it may."""
    return F.when(running, "it is running: refresh it later").when(kind.isin(*NOT_REFRESHED), "its format is not refreshed").when(new_kind != kind, F.concat(F.lit("the source is now "), new_kind, F.lit(", the project was made for "), kind))


def edit_refusal(running: Column, what: str) -> Column:
    """Why a project may not be changed by hand now; null: it may."""
    return F.when(running, F.lit(f"it is running: {what} has to wait"))
