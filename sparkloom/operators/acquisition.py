"""The relational part of acquiring candidates: planning, discovery, the cascade of checks, budgets and counters."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalar import canonical_url, in_domains, license_among, relevance, with_host, with_licence
from ..plans.errors import ParameterError
from ..plans.plugins import DiscoveryProvider, RelevanceEvaluator
from ..plans.session import cut
from .budgets import left_before
from .ordering import with_position

#: The checks in their order; the first that fails gives the reason.
REASONS = ("license_not_allowed", "domain_not_allowed", "declared_size", "byte_budget", "decode_failed", "mime_not_allowed", "too_small", "exact_duplicate", "low_quality", "near_duplicate", "storage_budget", "not_relevant")


@dataclass(frozen=True)
class Spec:
    """What an acquisition asks for. mimes: those allowed; None: every image type."""

    licenses: list[str] = field(default_factory=list)
    domains: list[str] = field(default_factory=list)
    mimes: list[str] | None = None
    min_width: int = 0
    min_height: int = 0
    min_quality: float = 15.0
    byte_budget: int | None = None
    storage_budget: int | None = None
    keywords: list[str] = field(default_factory=list)
    accept_relevance: float = 0.6
    review_relevance: float = 0.2


def queries(subject: list[str], variants: list[str], most: int = 24) -> list[str]:
    """Distinct search texts: the subject alone and with each variant."""
    base = " ".join(subject)
    return list(dict.fromkeys(q for q in [base, *[f"{base} {v}".strip() for v in variants]] if q))[:most]


def estimates(n: int, budget: int) -> tuple[int, int]:
    """Fewest and most candidates to look at for n accepted."""
    low = max(n, math.ceil(n / 0.75))
    return low, max(low, min(budget, math.ceil(n / 0.45)))


def trial(n: int, trial_size: int) -> tuple[int, int]:
    """Target and candidate cap of a trial run."""
    target = min(n, trial_size)
    return target, max(3 * target, target + 5)


def batch_size(remaining: int, accepted: int, evaluated: int, least: int = 4, most: int = 64) -> int:
    """Next batch by the yield so far."""
    rate = accepted / evaluated if evaluated else 0.5
    return max(least, min(most, math.ceil(remaining / max(rate, 0.05))))


def fan_out(providers: DataFrame, texts: DataFrame) -> DataFrame:
    """provider, query, priority for each provider and query; priority = max(0.1, 1 - 0.01 * position)."""
    return providers.crossJoin(F.broadcast(texts)).select("provider", "query", F.greatest(F.lit(0.1), 1 - 0.01 * F.col("position")).alias("priority"))  # both are a plan's short lists


def normalise_results(raw: DataFrame) -> DataFrame:
    """Results with an https address and an image type; markup goes from titles, addresses become canonical."""
    text = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"<[^>]*>", " "), r"\s+", " "))
    d = raw.where(F.lower("url").startswith("https://") & F.lower("mime").startswith("image/"))
    return d.withColumns({"title": text("title"), "description": text("description"), "canonical_url": canonical_url(F.col("url"))}).where("canonical_url is not null")


def search_by(spark: SparkSession, provider: DiscoveryProvider, query: str, limit: int, cursor: str | None = None) -> DataFrame:
    """At most `limit` results of a plugin's search as normalise_results has them; refused if a column is missing."""
    raw = provider.search(spark, query, limit, cursor)
    if lacking := {"url", "mime", "title", "description"} - set(raw.columns):
        raise ParameterError(f"the search gives no {', '.join(sorted(lacking))}")
    return normalise_results(raw.limit(limit))


def direct_urls(text: DataFrame, column: str) -> DataFrame:
    """url: addresses of a list separated by lines or commas."""
    return text.select(F.explode(F.split(F.col(column), r"[\n,]")).alias("url")).select(F.trim("url").alias("url")).where("url <> ''").distinct()


def discover(known: DataFrame, found: DataFrame, order: str) -> DataFrame:
    """What is new in a run: first of each (provider, remote id) and of each address, and not known by either."""
    d = found.join(known.select("run_id", "provider", "remote_id"), ["run_id", "provider", "remote_id"], "left_anti").join(known.select("run_id", "canonical_url"), ["run_id", "canonical_url"], "left_anti")
    for keys in (("run_id", "provider", "remote_id"), ("run_id", "canonical_url")):
        d = d.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).where("__k = 1").drop("__k")
    return d


def relevance_state(text: Column, expected: Column, accept: float, review: float) -> Column:
    r = relevance(text, expected)
    return F.when(r >= accept, "accept").when(r >= review, "review").otherwise("reject")


def running_total(df: DataFrame, column: str, order: list[str], name: str) -> DataFrame:
    """Sum of a column up to and with each row in the order, in two passes over range partitions."""
    d = with_position(df, order, "__pos").withColumn("__b", F.floor(F.col("__pos") / 100_000))
    before = d.groupBy("__b").agg(F.sum(column).alias("__s"))
    before = before.select("__b", (F.sum("__s").over(Window.orderBy("__b")) - F.col("__s")).alias("__from"))
    own = F.sum(column).over(Window.partitionBy("__b").orderBy("__pos").rowsBetween(Window.unboundedPreceding, 0))
    return d.withColumn("__own", own).join(F.broadcast(before), "__b").withColumn(name, F.col("__own") + F.col("__from")).drop("__own", "__from", "__b", "__pos")


def provider_import(files: DataFrame, fetched: DataFrame, max_total: int, max_file: int, done: DataFrame | None = None, order: list[str] = ("path",)) -> DataFrame:
    """path, state (completed, skipped, failed), reason, sha256, bytes of a provider's files, in the order given.

    files: path, byte_size (declared) and expected_sha256, both may be missing. fetched: path, actual_size, sha256 of
    what was downloaded. done: path, bytes, sha256 that an earlier run completed; they stay as they are and count for the
    total. A file is skipped if its declared or actual size goes over what is left of max_total, and fails if it wasn't
    downloaded, is larger than max_file or has another digest than expected; neither takes from the total.
    """
    none = files.sparkSession.createDataFrame([], "path string, bytes long, sha256 string")
    done = none if done is None else done.select("path", "bytes", "sha256")
    used = done.join(files.select("path"), "path", "left_semi").agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    d = files.join(done.select("path"), "path", "left_anti").join(fetched.select("path", "actual_size", "sha256"), "path", "left")
    bad = F.when(F.col("actual_size").isNull(), "download_failed").when(F.col("actual_size") > max_file, "file_too_large")
    d = d.withColumn("__bad", bad).withColumn("__size", F.when(F.col("__bad").isNull(), F.col("actual_size")).otherwise(0))
    d = d.withColumn("__other", F.col("__bad").isNull() & F.coalesce(F.col("expected_sha256") != F.col("sha256"), F.lit(False)))
    d = d.withColumns({"__asks": F.greatest(F.coalesce("byte_size", F.lit(0)), "__size"), "__takes": F.when(F.col("__other"), 0).otherwise(F.col("__size"))})
    d = left_before(d, "__takes", max_total - used, list(order), "__left", need="__asks")
    skipped = (F.col("byte_size") > F.col("__left")) | (F.col("__bad").isNull() & (F.col("actual_size") > F.col("__left")))
    reason = F.when(skipped, "total_byte_limit").otherwise(F.coalesce("__bad", F.when(F.col("__other"), "checksum_mismatch")))
    d = d.withColumn("reason", reason).withColumn("state", F.when(skipped, "skipped").when(F.col("reason").isNotNull(), "failed").otherwise("completed"))
    kept = F.col("state") == "completed"
    new = d.select("path", "state", "reason", F.when(kept, F.col("sha256")).alias("sha256"), F.when(kept, F.col("actual_size").cast("long")).alias("bytes"))
    old = files.select("path").join(done, "path").select("path", F.lit("completed").alias("state"), F.lit(None).cast("string").alias("reason"), "sha256", "bytes")
    return new.unionByName(old)


def cascade(candidates: DataFrame, spec: Spec, known_digests: DataFrame | None = None, near: DataFrame | None = None, order: list[str] = ("candidate_id",), evaluator: RelevanceEvaluator | None = None) -> DataFrame:
    """Adds state (accepted, review, rejected, failed) and reason: the first failing check in order wins.

    candidates: candidate_id, url, license, declared_width, declared_height, bytes, decoded, mime, width, height, sha256,
    quality, phash, text. known_digests: of assets stored before; near: the phashes that are near an active one.

    Candidates are taken in the order given, which must tell all of them apart. Only those that pass licence, domain and
    declared size are downloaded and take from the byte budget; one larger than what is left fails (no reason; it may be
    tried again), one after its end is rejected. A candidate is an exact duplicate of a known asset or of an earlier
    candidate that was stored, not of one that was itself rejected. What is stored takes from the storage budget, and is
    then judged by relevance: shared keywords, or what an evaluator says, kept within 0 to 1. Cheap checks of a row come
    first: nothing that fails one is sorted or shuffled for a budget.
    """
    order, names = list(order), candidates.columns
    if evaluator is not None:
        r = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(evaluator.relevance(F.col("text")).cast("double"), F.lit(0.0))))
    else:
        r = relevance(F.col("text"), F.array(*map(F.lit, spec.keywords))) if spec.keywords else F.lit(1.0)
    less = lambda c, n: F.coalesce(F.col(c), F.lit(0)) < n
    declared = lambda c, n: F.coalesce(F.col(c).cast("long"), F.lit(0)).between(F.lit(1), F.lit(n - 1))
    first = {
        "license_not_allowed": ~license_among("__licence", spec.licenses) if spec.licenses else F.lit(False),
        "domain_not_allowed": ~in_domains(F.col("__host"), spec.domains) if spec.domains else F.lit(False),
        "declared_size": declared("declared_width", spec.min_width) | declared("declared_height", spec.min_height),
    }
    loaded = {
        "decode_failed": ~F.coalesce("decoded", F.lit(False)),
        "mime_not_allowed": ~F.coalesce(F.col("mime").isin(spec.mimes) if spec.mimes is not None else F.col("mime").startswith("image/"), F.lit(False)),
        "too_small": less("width", spec.min_width) | less("height", spec.min_height),
    }

    def failing(checks: dict[str, Column]) -> Column:
        out = F.lit(None).cast("string")
        for name, c in reversed(checks.items()):
            out = F.when(F.coalesce(c, F.lit(False)), F.lit(name)).otherwise(out)
        return out

    d = candidates.withColumns({"__failed": F.lit(False), "__r": r})
    # family, version and host of a row are columns, which the checks then compare
    d = with_licence(d, "license", "__licence") if spec.licenses else d
    d = with_host(d, "url", "__host") if spec.domains else d
    if spec.byte_budget is None:
        d = d.withColumn("reason", failing(first | loaded))
    else:
        d = cut(d.withColumn("reason", failing(first)))
        open_ = left_before(d.where("reason is null"), "bytes", spec.byte_budget, order, "__left")
        open_ = open_.withColumn("reason", F.when(F.col("__left") <= 0, "byte_budget")).withColumn("__failed", F.col("reason").isNull() & (F.coalesce("bytes", F.lit(0)) > F.col("__left")))
        d = open_.drop("__left").unionByName(d.where("reason is not null"))
        d = d.withColumn("reason", F.coalesce("reason", F.when(~F.col("__failed"), failing(loaded))))
    # what the checks of a row say is used from here on several times, and worked out once
    d = cut(d)
    d = d.join(known_digests.select("sha256", F.lit(True).alias("__known")).distinct(), "sha256", "left") if known_digests is not None else d.withColumn("__known", F.lit(None).cast("boolean"))
    d = d.join(near.select("phash", F.lit(True).alias("__near")).distinct(), "phash", "left") if near is not None else d.withColumn("__near", F.lit(None).cast("boolean"))
    later = failing({"low_quality": less("quality", spec.min_quality), "near_duplicate": F.coalesce("__near", F.lit(False))})
    d = d.withColumn("__open", F.col("reason").isNull() & ~F.col("__failed")).withColumn("__known", F.coalesce("__known", F.lit(False))).withColumn("__later", later)
    key = F.struct(*[F.col(f"`{c}`") for c in order])
    d = d.withColumn("__key", key)
    # of each digest, the first candidate that every other check lets through is stored if the storage holds it
    able = d.where("__open and not __known and __later is null")
    firsts = able.where("sha256 is not null").groupBy("sha256").agg(F.min("__key").alias("__first"))
    d = d.join(firsts, "sha256", "left")
    stores = "__open and not __known and __later is null and (__first is null or __first = __key)"
    if spec.storage_budget is not None:
        d = cut(d)
        stored = left_before(d.where(stores).select("__key", "bytes", *order), "bytes", spec.storage_budget, order, "__left")
        full = stored.where(F.coalesce("bytes", F.lit(0)) > F.col("__left")).select(F.col("__key").alias("__full"))
        d = d.join(full, F.coalesce("__first", "__key") == F.col("__full"), "left")
    else:
        d = d.withColumn("__full", F.lit(None).cast(d.schema["__key"].dataType))
    again = F.col("__known") | F.coalesce((F.col("__first") < F.col("__key")) & F.col("__full").isNull(), F.lit(False))
    last = {"exact_duplicate": again, "low_quality": F.col("__later") == "low_quality", "near_duplicate": F.col("__later") == "near_duplicate", "storage_budget": F.col("__full").isNotNull(), "not_relevant": F.col("__r") < spec.review_relevance}
    d = d.withColumn("reason", F.coalesce("reason", F.when(F.col("__open"), failing(last))))
    state = F.when(F.col("__failed"), "failed").when(F.col("reason").isNotNull(), "rejected").when(F.col("__r") < spec.accept_relevance, "review").otherwise("accepted")
    return d.withColumn("state", state).select(*[F.col(f"`{c}`") for c in names], "reason", "state")


def counters(candidates: DataFrame) -> DataFrame:
    """run_id, counts by state, evaluated, yield and bytes kept, in one pass."""
    n = lambda *s: F.count_if(F.col("state").isin(*s))
    g = candidates.groupBy("run_id").agg(n("accepted").alias("accepted"), n("review").alias("review"), n("rejected").alias("rejected"), n("discovered").alias("discovered"), n("failed").alias("failed"), F.coalesce(F.sum(F.when(F.col("state") == "accepted", F.col("bytes"))), F.lit(0)).alias("stored_bytes"))
    g = g.withColumn("evaluated", F.col("accepted") + F.col("review") + F.col("rejected"))
    return g.withColumn("yield", F.coalesce(F.try_divide(F.col("accepted").cast("double"), F.col("evaluated").cast("double")), F.lit(0.0)))


def rejections(candidates: DataFrame) -> DataFrame:
    """reason, n, most frequent first."""
    return candidates.where("state = 'rejected'").groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason")


def runs_with_counters(runs: DataFrame, plans: DataFrame, candidates: DataFrame) -> DataFrame:
    return runs.join(plans, "plan_id").join(counters(candidates), "run_id", "left")


def runnable(q: DataFrame) -> DataFrame:
    """Queries that are not exhausted, with their place (from 0) by priority, then accepted, then age, then id."""
    d = q.where(~F.col("exhausted")).withColumns({"__priority": -F.col("priority"), "__accepted": -F.col("accepted")})
    return with_position(d, ["__priority", "__accepted", "created_at", "query_id"], "place").drop("__priority", "__accepted")


def pending(candidates: DataFrame, q: DataFrame, most: int) -> DataFrame:
    """The oldest candidates to fetch: discovered, or failed with fewer than three attempts, with their query."""
    open_ = (F.col("state") == "discovered") | ((F.col("state") == "failed") & (F.col("attempts") < 3))
    return candidates.where(open_).join(q, "query_id", "left").orderBy("discovered_at", "candidate_id").limit(most)


def recovered(candidates: DataFrame) -> DataFrame:
    """States after a crash: in flight becomes failed if bytes were read, else discovered."""
    flight = F.col("state").isin("downloading", "evaluating")
    return candidates.withColumn("state", F.when(flight & (F.coalesce("bytes", F.lit(0)) > 0), "failed").when(flight, "discovered").otherwise(F.col("state")))


def given_up(candidates: DataFrame) -> DataFrame:
    """candidate_id, reason of those whose third download failed."""
    return candidates.where("state = 'failed' and attempts >= 3").select("candidate_id", F.lit("download_failed").alias("reason"))


def query_counts(decisions: DataFrame) -> DataFrame:
    """query_id, accepted, rejected: each candidate counts once, by its first final decision."""
    final = decisions.where(F.col("state").isin("accepted", "rejected")).groupBy("query_id", "candidate_id").agg(F.min_by("state", F.struct("decided_at", "decision_id")).alias("state"))
    return final.groupBy("query_id").agg(F.count_if(F.col("state") == "accepted").alias("accepted"), F.count_if(F.col("state") == "rejected").alias("rejected"))


def asset_states(assets: DataFrame, human: DataFrame) -> DataFrame:
    """Assets with the state that the last human decision asks for: accept active, reject excluded."""
    last = human.groupBy("asset_id").agg(F.max_by("decision", F.struct("decided_at", "decision_id")).alias("__d"))
    return assets.join(last, "asset_id", "left").withColumn("state", F.when(F.col("__d") == "accept", "active").when(F.col("__d") == "reject", "excluded").otherwise(F.col("state"))).drop("__d")


def review_page(candidates: DataFrame, decisions: DataFrame, q: DataFrame, state: str, page: int, size: int) -> DataFrame:
    """A page of candidates of a state with their decisions (in order) and query."""
    p = candidates.where(F.col("state") == state).orderBy("discovered_at", "candidate_id").offset(page * size).limit(size)
    d = decisions.join(F.broadcast(p.select("candidate_id")), "candidate_id").groupBy("candidate_id").agg(F.sort_array(F.collect_list(F.struct("decided_at", "decision_id", F.col("state").alias("decision")))).alias("decisions"))
    return p.join(d, "candidate_id", "left").join(q, "query_id", "left")


def shortfall(accepted: int, target: int, exhausted: bool, budget_left: bool, bytes_left: bool = True, replenish: bool = True) -> str | None:
    """Why a run that isn't finished ends here: planned_batch_done, candidate_budget, byte_budget or queries_exhausted;
    None if it goes on or has reached its target."""
    if accepted >= target:
        return None
    if not replenish:
        return "planned_batch_done"
    return "candidate_budget" if not budget_left else "byte_budget" if not bytes_left else "queries_exhausted" if exhausted else None


def run(spec: Spec, target: int, max_candidates: int, search: Callable[[int], DataFrame | None], trial_only: bool = False, known_digests: DataFrame | None = None) -> tuple[DataFrame | None, str]:
    """Takes batches of candidates through the cascade until so many are accepted or something runs out; returns all that
    were judged, and "completed" or why not.

    search(n) gives up to n new candidates of later order, or None (or none) when its providers have no more. The size of
    a batch follows the yield so far. What was judged is checkpointed batch by batch; of it the driver sees counts alone.
    """
    judged, n, accepted, loaded, stored = None, 0, 0, 0, 0
    while accepted < target:
        why = shortfall(accepted, target, False, n < max_candidates, spec.byte_budget is None or loaded < spec.byte_budget, not (trial_only and n))
        if why:
            return judged, why
        found = search(min(batch_size(target - accepted, accepted, n), max_candidates - n))
        if found is None or found.isEmpty():
            return judged, "queries_exhausted"
        left = replace(spec, byte_budget=None if spec.byte_budget is None else spec.byte_budget - loaded, storage_budget=None if spec.storage_budget is None else spec.storage_budget - stored)
        known = known_digests
        if judged is not None:
            own = judged.where("state in ('accepted', 'review') or reason = 'not_relevant'").select("sha256").where("sha256 is not null")
            known = own if known is None else own.unionByName(known.select("sha256"))
        batch = cut(cascade(found, left, known))
        counts = batch.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(F.col("state") == "accepted").alias("accepted"),
            F.coalesce(F.sum(F.when((F.col("state") != "failed") & ~F.coalesce(F.col("reason").isin(*REASONS[:4]), F.lit(False)), F.col("bytes"))), F.lit(0)).alias("loaded"),
            F.coalesce(F.sum(F.when(F.col("state").isin("accepted", "review") | (F.col("reason") == "not_relevant"), F.col("bytes"))), F.lit(0)).alias("stored"),
        ).first()
        n, accepted, loaded, stored = n + counts["n"], accepted + counts["accepted"], loaded + counts["loaded"], stored + counts["stored"]
        judged = batch if judged is None else judged.unionByName(batch)
    return judged, "completed"
