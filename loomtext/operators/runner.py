"""The project runner: chunks go through a model in rounds, each a DataFrame step with a committed stage.

A round asks for all that is open, reads the answers and decides what each leaves open. Chunks never meet one another, so a round has
no exchange, and its rows hold only what was found and what is still asked for. A run that was stopped goes on after its last committed round: no answer that was
committed is asked for again. After the rounds come the review, one request to mend what it found, and the final states.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import checks, protocol, replies
from .projects import final_state
from .stages import stage

#: Answers of one model that may be unusable before the next is asked, and requests for the rest of an answer that was nearly whole.
WRONG_ANSWERS, FOLLOW_UPS = 2, 2
#: Requests for structured answers that are one task, about.
REQUESTS = 50_000
SEGS = "array<struct<id:string,text:string>>"
ASK = f"struct<segs:{SEGS},model:int,wrong:int,follow:int,note:string>"

#: A model: the columns of request, model number and task ("translate" or "fix") to a column with the reply.
Model = Callable[[Column, Column, Column], Column]


def from_function(answer: Callable[[str, int, str], str]) -> Model:
    """A model of a Python function, called once for each request in the executors. A task may run again, so it has to answer alike."""

    @F.pandas_udf("string")
    def call(request, model, task):
        import pandas as pd

        return pd.Series([answer(r, int(m), t) for r, m, t in zip(request, model, task)], dtype=object)

    return lambda request, model, task: call(request, model, task)


def _ask(segs: Column, model: Column, wrong: Column, follow: Column, note: Column) -> Column:
    return F.struct(segs.cast(SEGS).alias("segs"), model.cast("int").alias("model"), wrong.cast("int").alias("wrong"), follow.cast("int").alias("follow"), note.cast("string").alias("note"))


def request_of(segs: Column, note: Column) -> Column:
    """The segments as elements, one a line, after a note on the last answer if there is one."""
    return F.concat_ws("\n\n", note, F.array_join(F.transform(segs, lambda s: X.segment_element(s.id, s.text)), "\n"))


def _parsed(rows: DataFrame) -> DataFrame:
    """rows (segs, reply) with `read`, the parsed reply, and `broken`: ids whose tags the answer does not keep."""
    rows = rows.withColumn("_found", protocol.elements("reply")).withColumn("ids", F.transform("segs", lambda s: s.id))
    rows = rows.withColumn("read", protocol.parse_elements(F.col("_found"), F.col("ids"))).drop("_found")
    wrong = F.filter("segs", lambda s: X.let(F.try_element_at(F.col("read.segments"), s.id), lambda t: t.isNotNull() & ~checks.tags_hold(s.text, t)))
    return rows.withColumn("broken", F.transform(wrong, lambda s: s.id))


def decide(rows: DataFrame, models: int) -> DataFrame:
    """rows (segs, model, wrong, follow, reply) with outcome, found (id -> text) and next: what is asked in the round that follows.

    An answer that gives every segment once, with its tags, is good. One that lacks few, has no unknown ids and is not alone gives the rest, and
    the few are asked for. Else the same model is asked again with a note, then the next model, then the two halves. A single segment
    that no model gives fails; one whose tags no model keeps is taken without tags, which the review will find.
    """
    rows = _parsed(rows)
    read, n = F.col("read"), F.size("ids")
    ask = F.filter("ids", lambda i: F.array_contains(read.missing, i) | F.array_contains(read.conflicting, i) | F.array_contains("broken", i))
    known = F.size(read.extra) == 0
    rows = rows.withColumn("ask", ask)
    good = known & (F.size("ask") == 0)
    few = known & (F.size("ask") < n) & (F.size("ask") <= F.greatest(F.lit(2), F.ceil(n / 4))) & (F.col("follow") < FOLLOW_UPS)
    outcome = (
        F.when(good, "good").when(few, "salvaged").when(F.col("wrong") + 1 < WRONG_ANSWERS, "again").when(F.col("model") + 1 < models, "next model").when(n > 1, "halved").when(known & (F.size("broken") == 1), "untagged").otherwise("failed")
    )
    rows = rows.withColumn("outcome", outcome)
    is_ = lambda o: F.col("outcome") == o
    text = lambda s: F.try_element_at(read.segments, s.id)
    taken = F.filter("segs", lambda s: is_("untagged") | ((is_("good") | is_("salvaged")) & ~F.array_contains("ask", s.id)))
    found = F.map_from_entries(F.transform(taken, lambda s: F.struct(s.id, X.fit_edges(s.text, F.when(is_("untagged"), X.strip_tags(text(s))).otherwise(text(s))))))
    none, model, zero = F.lit(None), F.col("model"), F.lit(0)
    problems = F.concat_ws("; ", *(F.when(F.size(c) > 0, F.concat(F.lit(f"{name}: "), F.array_join(c, ", "))) for name, c in (("missing", read.missing), ("unknown", read.extra), ("told twice", read.conflicting), ("tags", F.col("broken")))))
    half = F.ceil(n / 2).cast("int")
    nothing = F.expr(f"cast(array() as array<{ASK}>)")
    follows = (
        F.when(is_("salvaged"), F.array(_ask(F.filter("segs", lambda s: F.array_contains("ask", s.id)), model, F.col("wrong"), F.col("follow") + 1, none)))
        .when(is_("again"), F.array(_ask(F.col("segs"), model, F.col("wrong") + 1, F.col("follow"), F.concat(F.lit("The last answer was not usable. "), problems))))
        .when(is_("next model"), F.array(_ask(F.col("segs"), model + 1, zero, zero, none)))
        .when(is_("halved"), F.array(_ask(F.slice("segs", F.lit(1), half), zero, zero, zero, none), _ask(F.slice("segs", half + 1, n - half), zero, zero, zero, none)))
        .otherwise(nothing)
    )
    return rows.withColumn("found", found).withColumn("next", follows).drop("read", "broken", "ids", "ask")


def translated(chunks: DataFrame, keys: list[str], model: Model, models: int, path: str, most_rounds: int | None = None) -> list[DataFrame] | None:
    """The committed rounds over chunks (keys, segs), the last with nothing open; None if most_rounds were made in this call before that."""
    spark = chunks.sparkSession
    start = chunks.select(*keys, _ask(F.col("segs"), F.lit(0), F.lit(0), F.lit(0), F.lit(None)).alias("a"))
    rounds: list[DataFrame] = []
    while True:
        here = f"{path}/round={len(rounds)}"
        if most_rounds is not None and len(rounds) >= most_rounds:
            return None
        open_asks = start if not rounds else rounds[-1].select(*keys, F.explode("next").alias("a"))

        def answered(asks: DataFrame = open_asks) -> DataFrame:
            asks = asks.select(*keys, "a.*").withColumn("request", request_of(F.col("segs"), F.col("note")))
            asks = asks.withColumn("reply", model(F.col("request"), F.col("model"), F.lit("translate")))
            return decide(asks, models).select(*keys, "outcome", "found", "next")

        rounds.append(stage(spark, here, answered))
        if rounds[-1].where(F.size("next") > 0).isEmpty():
            return rounds


def _with_issues(segs: Column, final: Column, minor: bool) -> Column:
    """The segments that have a major issue, or any, by the deterministic checks; a chunk has all it takes in its own row."""
    bad = lambda i: F.lit(True) if minor else i.severity == "major"
    return F.filter(segs, lambda s: F.exists(checks.issues_of(s.text, F.element_at(final, s.id)), bad))


def run(chunks: DataFrame, keys: list[str], model: Model, models: int, path: str, fix_minor: bool = False, proofread: bool = False, most_rounds: int | None = None) -> DataFrame | None:
    """(keys, state, final, asks) of chunks (keys, state, segs array<struct<id, text>>, final map): done and flagged ones stay as they are, all others
    start over. None: it was stopped after most_rounds rounds, and the same call without them goes on.

    A chunk of which a segment was never given is failed and keeps what it has. Else its pairs are reviewed by the deterministic
    checks, the segments with a major issue (any, with fix_minor) are asked for once more, an answer is taken where it is read and its
    tags hold, and the chunk is flagged if a major issue remains. With proofread, the translation is asked about once before, and a text is taken
    where the answer is whole and accept_proofread() takes it. `asks` counts requests; chunks that were not run have none.
    """
    spark = chunks.sparkSession
    source = chunks
    chunks = stage(spark, f"{path}/chunks", lambda: source.select(*keys, "state", "segs", "final"))
    finished = F.col("state").isin("done", "flagged")
    todo = chunks.where(~finished | F.col("state").isNull())
    rounds = translated(todo.where(F.size("segs") > 0), keys, model, models, f"{path}/translate", most_rounds)
    if rounds is None:
        return None
    answers = reduce(DataFrame.unionByName, (r.select(*keys, "found") for r in rounds))
    got = answers.groupBy(*keys).agg(F.map_from_entries(F.flatten(F.collect_list(F.map_entries("found")))).alias("final"), F.count("*").alias("asks"))
    rows = todo.select(*keys, "segs").join(got, keys, "left")
    whole = F.size("final") == F.size("segs")
    none = F.expr(f"cast(array() as {SEGS})")
    reviewed = lambda of: of.withColumn("bad", F.when(whole, _with_issues(F.col("segs"), F.col("final"), fix_minor)).otherwise(none))
    joined = rows.withColumn("final", F.coalesce("final", F.expr("cast(map() as map<string,string>)"))).withColumn("asks", F.coalesce("asks", F.lit(0)))
    rows = stage(spark, f"{path}/translated", lambda: joined if proofread else reviewed(joined))
    if proofread:
        given = rows

        def read_again() -> DataFrame:
            asks = given.where(whole & (F.size("segs") > 0))
            asks = asks.withColumn("sources", F.col("segs")).withColumn("segs", F.transform("segs", lambda s: F.struct(s.id.alias("id"), F.element_at("final", s.id).alias("text"))))
            asks = asks.withColumn("reply", model(request_of(F.col("segs"), F.lit(None).cast("string")), F.lit(0), F.lit("proofread")))
            read = _parsed(asks.select(*keys, "sources", "segs", "reply", F.col("final").alias("before"))).where("read.ok")
            new = F.transform("sources", lambda s: F.struct(s.id, checks.accept_proofread(s.text, F.element_at("before", s.id), F.element_at("read.segments", s.id))))
            return read.select(*keys, F.map_from_entries(new).alias("proof"))

        proofs = stage(spark, f"{path}/proofread", read_again)
        asked = (whole & (F.size("segs") > 0)).cast("int")
        rows = given.join(proofs, keys, "left").select(*keys, "segs", F.coalesce("proof", "final").alias("final"), (F.col("asks") + asked).alias("asks"))
        rows = reviewed(rows)

    def mended() -> DataFrame:
        asks = rows.where(F.size("bad") > 0).withColumn("all", F.col("segs")).withColumn("segs", F.col("bad"))
        asks = asks.withColumn("reply", model(request_of(F.col("segs"), F.lit(None).cast("string")), F.lit(0), F.lit("fix")))
        read = _parsed(asks.select(*keys, "segs", "reply", "all", "final", "asks"))
        usable = F.map_filter("read.segments", lambda k, _: ~F.array_contains("broken", k) & ~F.array_contains("read.conflicting", k))
        read = read.select(*keys, F.col("all").alias("segs"), "final", "asks", usable.alias("fixed"))
        kept = F.map_filter("final", lambda k, _: ~F.map_contains_key("fixed", k))
        answered = F.col("fixed").isNotNull()
        out = read.select(*keys, "segs", F.when(answered, F.map_concat(kept, "fixed")).otherwise(F.col("final")).alias("final"), (F.col("asks") + answered.cast("int")).alias("asks"))
        return out.select(*keys, "final", "asks", (F.size(_with_issues(F.col("segs"), F.col("final"), False)) > 0).alias("major"))

    fixes = stage(spark, f"{path}/fixed", mended)
    ended = lambda of, state: of.select(*keys, state.alias("state"), "final", F.col("asks").cast("long").alias("asks"))
    good = rows.where(F.size("bad") == 0)  # nothing was asked about, so no major issue is left
    ran = ended(good, F.when(whole, "done").otherwise("failed")).unionByName(ended(fixes, final_state(F.col("major").cast("int"), F.lit(None))))
    return ran.unionByName(chunks.where(finished).select(*keys, "state", "final", F.lit(0).cast("long").alias("asks")))


def answers(asks: DataFrame, keys: list[str], schema: dict, model: Model, path: str) -> DataFrame:
    """(keys, json, problems, asks) of asks (keys, request): the JSON object that the model answers with, where it keeps the schema.

    An answer that does not is asked for once more, with its problems named; what is still wrong then gives no JSON and its problems.
    Both rounds are committed stages under path, so a stopped run asks for nothing twice.
    """
    spark = asks.sparkSession

    def asked(rows: DataFrame) -> DataFrame:
        rows = rows.withColumn("reply", model(F.col("request"), F.lit(0), F.lit("json")))
        return rows.select(*keys, "request", "reply", replies.structured("reply", schema).alias("problems"))

    def dealt() -> DataFrame:
        # requests are short, so a file of millions would be one task; the number stands, as small partitions would be put together
        rows = asks.select(*keys, "request")
        return asked(rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // REQUESTS)), *keys))

    first = stage(spark, f"{path}/asked", dealt)
    note = F.concat(F.lit("\n\nThe last answer was not usable: "), F.array_join("problems", "; "), F.lit(". Answer with one JSON object."))
    wrong = F.size("problems") > 0
    second = stage(spark, f"{path}/repaired", lambda: asked(first.where(wrong).withColumn("request", F.concat("request", note))))
    both = first.where(~wrong).withColumn("asks", F.lit(1)).unionByName(second.withColumn("asks", F.lit(2)))
    return both.select(*keys, F.when(~wrong, X.first_json("reply")).alias("json"), "problems", "asks")
