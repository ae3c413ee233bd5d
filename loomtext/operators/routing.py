"""Model lists: aliases, longest-prefix profiles, usability, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def longest_prefix(served: DataFrame, profiles: DataFrame) -> DataFrame:
    """(served, profile): the profile of the same id in any case, else the longest id that the served one starts with.

    Each served id is spelled out into its prefixes, so the join is an equal one.
    """
    s = served.select("served", F.lower("served").alias("_s"))
    prefixes = s.select("served", "_s", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("_s"), F.lit(1))), lambda n: F.substring(F.col("_s"), F.lit(1), n))).alias("_p"))
    hits = prefixes.join(profiles.select("profile", F.lower("profile").alias("_p")), "_p")
    best = hits.groupBy("served").agg(F.max_by("profile", F.length("profile")).alias("profile"))
    return served.select("served").join(best, "served", "left")


def numbered_aliases(models: DataFrame, kind: str, order: str) -> DataFrame:
    """models with `alias`: kind-1, kind-2 ... along the order."""
    return models.withColumn("alias", F.concat_ws("-", kind, F.row_number().over(Window.partitionBy(kind).orderBy(order)).cast("string")))


def resolve(requests: DataFrame, aliases: DataFrame, models: DataFrame) -> DataFrame:
    """(request, ord, ref): each wanted name as a model, by alias or itself; unknown names and repeats go."""
    named = requests.join(aliases.select(F.col("alias").alias("name"), F.col("ref").alias("_ref")), "name", "left").withColumn("ref", F.coalesce("_ref", "name"))
    known = named.join(models.select("ref").distinct(), "ref", "left_semi")
    first = Window.partitionBy("request", "ref").orderBy("ord")
    return known.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == 1).select("request", "ord", "ref")


def usable(candidates: DataFrame) -> DataFrame:
    """candidates that are available, have a client and are not for embeddings; of a request's, those that are up unless none is."""
    able = candidates.where(F.col("available") & F.col("has_client") & ~F.col("embedding"))
    any_up = F.bool_or("up").over(Window.partitionBy("request"))
    return able.withColumn("_any", any_up).where(F.col("up") | ~F.col("_any")).drop("_any")


def anti_merge(picked: DataFrame, file_rows: DataFrame, key: str) -> DataFrame:
    """Rows of a file, and picked rows whose key it lacks."""
    return file_rows.unionByName(picked.join(file_rows.select(key), key, "left_anti"))


def reviewer_agents(client_only: Column, models: Column, proofread: Column) -> Column:
    """array<string>: the agents that a client-only project's reviewer models work for; none without such models."""
    some = client_only & (F.size(models) > 0)
    return F.when(some & F.coalesce(proofread, F.lit(False)), F.array(F.lit("qa"), F.lit("proofreader"))).when(some, F.array(F.lit("qa"))).otherwise(F.expr("cast(array() as array<string>)"))


def reviewer_problem(ref: Column, translator: str, local: list[str], client: str = "client") -> Column:
    """Why a model may not review in a project that spends nothing; null: it may. Other clients and models of local providers may."""
    provider = F.split(ref, "/")[0]
    free = (provider == client) | provider.isin(local)
    return F.when(F.instr(ref, "/") == 0, "not provider/model").when(ref == translator, "it translates").when(~free, "not free")


def outside_refs(refs: Column, agent: Column, reviewers: Column, models: Column, translator: str, local: list[str], client: str = "client") -> Column:
    """Of the models an agent of a client-only project would ask, those it may not: a reviewer may ask its reviewer models that may review,
    any other agent only clients."""
    reviews = F.array_contains(reviewers, agent)
    may_review = lambda r: F.array_contains(models, r) & reviewer_problem(r, translator, local, client).isNull()
    return F.filter(refs, lambda r: F.when(reviews, ~may_review(r)).otherwise(F.split(r, "/")[0] != client))


def model_choice(show: Column, picked: Column, hidden: Column, known: Column, listed: Column, local: Column, priced: Column) -> Column:
    """struct(picked, hidden, problem): a model after it was asked to be shown or hidden.

    Hiding takes a picked model off the picks and hides any other. Showing picks a model that is not known, if its provider lists it, with
    a price unless the provider is local. With a problem nothing changes.
    """
    fresh = show & ~known & ~picked
    problem = F.when(fresh & ~listed, "not listed").when(fresh & ~local & ~priced, "no price")
    fine = problem.isNull()
    return F.struct(F.when(fine, (show & picked) | fresh).otherwise(picked).alias("picked"), F.when(~fine, hidden).when(show, False).otherwise(hidden | ~picked).alias("hidden"), problem.alias("problem"))
