"""Linking rips to catalogue references: scores, claims with margins, one-to-one assignment, review outcomes.

Rips are (grp, key, pos, text), references (grp, number, suspect, text) with numbers unique per group.  Keys are
expected lower-cased and trimmed at ingestion.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from catalogops.operators import vectors as V
from catalogops.operators.skew import int_slice, parts_by_rows, sliced_window
from catalogops.policy import AMBIGUOUS, CLEAR, CONTESTED, DECISIVE, MatchPolicy
from catalogops.session import cut_lineage, store

# The raw cosine lifts a score only from these two similarities on.
RAW_LIFT_MIN_RAW = 0.90
RAW_LIFT_MIN_WEIGHTED = 0.50
PENDING_PER_RIP = 2
HOLE_PENALTY = 0.08


def linked_vectors(rips: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vectors of rips and references over the terms that references have; idf comes from the references alone."""
    ref_raw = store(V.tf_vectors(refs.withColumnRenamed("number", "doc")), "reference-terms")
    table = store(V.idf(ref_raw), "idf")
    rip_raw = V.tf_vectors(rips.withColumnRenamed("key", "doc"))
    return store(V.known_vectors(rip_raw, table), "rip-vectors"), store(V.known_vectors(ref_raw, table), "reference-vectors")


def _scored(sums: DataFrame) -> DataFrame:
    """(grp, key, number, weighted, raw, score); nearly equal texts are lifted to the raw cosine."""
    lift = (F.col("raw") >= RAW_LIFT_MIN_RAW) & (F.col("weighted") >= RAW_LIFT_MIN_WEIGHTED)
    score = F.when(lift, F.greatest("weighted", "raw")).otherwise(F.col("weighted"))
    return sums.select("grp", F.col("a").alias("key"), F.col("b").alias("number"), "weighted", "raw", score.alias("score"))


def score_pairs(rips: DataFrame, refs: DataFrame) -> DataFrame:
    """(grp, key, number, weighted, raw, score) of every pair with a shared weighted term, in one pass over the shared terms.

    Claims need few of them: see `claim_pairs`.
    """
    return _scored(V.pair_sums(*linked_vectors(rips, refs)))


def _liftable(rip: DataFrame, ref: DataFrame, rip_bounds: DataFrame, least: float) -> DataFrame:
    """Pairs (grp, a, b) whose weighted cosine is `least` or more, or that the raw cosine may lift."""
    bar = F.lit(min(least, RAW_LIFT_MIN_WEIGHTED))
    return V.reaching(V.bounded_terms(ref, rip_bounds), bar, rip).select("grp", F.col("b").alias("a"), F.col("a").alias("b"))


def claim_pairs(rips: DataFrame, refs: DataFrame, policy: MatchPolicy = MatchPolicy()) -> DataFrame:
    """The part of `score_pairs` that claims depend on: pairs of the minimum similarity, and of their rips and references the two best
    partners and the neighbouring numbers.  Bounds per posting list leave out the rest."""
    least = policy.normalized().min_similarity
    rip, ref = linked_vectors(rips, refs)
    # each side is searched from the other one: one corpus of both, told apart in the group
    kinds = [F.lit(None).cast(v.schema["doc"].dataType) for v in (rip, ref)]

    def sided(v: DataFrame, side: str, is_rip: bool) -> DataFrame:
        key, number = (F.col("doc"), kinds[1]) if is_rip else (kinds[0], F.col("doc"))
        return v.select(F.struct(F.lit(side).alias("side"), "grp").alias("grp"), F.struct(key.alias("key"), number.alias("number")).alias("doc"), "term", "weight")

    corpus = sided(rip, "rip", True).unionByName(sided(ref, "ref", False))
    bounds = store(V.list_bounds(corpus), "list-bounds")
    rip_bounds = bounds.filter("grp.side = 'rip'").select("grp.grp", "term", "top")
    near = store(_scored(V.exact_sums(store(_liftable(rip, ref, rip_bounds, least), "reached"), rip, ref)), "near-pairs")
    base = near.filter(F.col("score") >= least)
    keys, numbers = (base.select("grp", F.col(c).alias("doc")).distinct() for c in ("key", "number"))
    queries = (sided(rip.join(keys, ["grp", "doc"], "left_semi"), "ref", True)
               .unionByName(sided(ref.join(numbers, ["grp", "doc"], "left_semi"), "rip", False)))
    best = V.best_partners(queries, corpus, bounds, 2).select("grp.grp", F.coalesce("a.key", "b.key").alias("a"), F.coalesce("a.number", "b.number").alias("b"))
    beside = base.select("grp", F.col("key").alias("a"), F.explode(F.array(F.col("number") - 1, F.col("number") + 1)).alias("b"))
    more = best.unionByName(beside).distinct()
    more = more.join(near.select("grp", F.col("key").alias("a"), F.col("number").alias("b")), ["grp", "a", "b"], "left_anti")
    return near.unionByName(_scored(V.exact_sums(store(more, "more-pairs"), rip, ref)))


def top_match(pairs: DataFrame) -> DataFrame:
    """Best reference per rip; the lower number wins a tie."""
    best = F.max_by(F.struct("number", "score", "weighted", "raw"), F.struct("score", -F.col("number")))
    return pairs.groupBy("grp", "key").agg(best.alias("m")).select("grp", "key", "m.*")


def _top_two(pairs: DataFrame, part: list[str], order: list[Column], prefix: str, value: str) -> DataFrame:
    """First and second row per partition; the rank filter is applied before the shuffle."""
    w = Window.partitionBy(*part).orderBy(*order)
    two = (pairs.filter("score > 0").withColumn("rn", F.row_number().over(w)).filter("rn <= 2"))
    row = F.struct(F.col(value).alias("v"), F.col("score").alias("s"))
    return two.groupBy(*part).agg(F.max(F.when(F.col("rn") == 1, row)).alias(f"{prefix}1"),
                                  F.max(F.when(F.col("rn") == 2, row)).alias(f"{prefix}2"))


def neighbour_scores(targets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Best score among the references numbered one below and one above; absent ones count 0, the lower wins ties."""
    around = targets.select("grp", "key", "number", F.explode(F.array(F.lit(-1), F.lit(1))).alias("step"))
    side = pairs.select("grp", "key", F.col("number").alias("near"), F.col("score").alias("s"))
    hit = (around.withColumn("near", F.col("number") + F.col("step")).join(side, ["grp", "key", "near"], "left")
           .groupBy("grp", "key", "number")
           .agg(F.coalesce(F.max(F.when(F.col("step") == -1, F.col("s"))), F.lit(0.0)).alias("lo"),
                F.coalesce(F.max(F.when(F.col("step") == 1, F.col("s"))), F.lit(0.0)).alias("hi")))
    return hit.select("grp", "key", "number", *_neighbour())


def _neighbour() -> tuple[Column, Column]:
    """Number and score of the better neighbour from the scores `lo` below and `hi` above."""
    number = (F.when(F.col("hi") > F.col("lo"), F.col("number") + 1)
              .when(F.col("lo") > 0, F.col("number") - 1).otherwise(F.lit(0)))
    return number.alias("neighbor_number"), F.greatest("lo", "hi").alias("neighbor_score")


def _runners_up(pairs: DataFrame) -> DataFrame:
    """`pairs` with the first and second number of their rip, `f1` and `f2`, and the scores `lo` and `hi` of the numbers beside."""
    rip = Window.partitionBy("grp", "key")
    best = rip.orderBy(F.desc("score"), F.asc("number")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    row = F.when(F.col("score") > 0, F.struct(F.col("number").alias("v"), F.col("score").alias("s")))

    def beside(step: int) -> Column:
        return F.coalesce(F.max("score").over(rip.orderBy("number").rangeBetween(step, step)), F.lit(0.0))

    return (pairs.withColumns({"f1": F.first(row).over(best), "f2": F.nth_value(row, 2).over(best)})
            .withColumns({"lo": beside(-1), "hi": beside(1)}))


def _penalty(margin: str, target: float, weight: float) -> Column:
    short = F.lit(weight) * (F.lit(target) - F.greatest(F.lit(0.0), F.col(margin))) / F.lit(target)
    return F.when(F.col(margin) >= target, F.lit(0.0)).otherwise(short)


def _clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def _clear_margins(p: MatchPolicy) -> Column:
    return ((F.col("rip_margin") >= p.clear_margin) & (F.col("ref_margin") >= p.clear_margin)
            & (F.col("neighbor_margin") >= p.clear_margin / 2))


def quality_label(p: MatchPolicy) -> Column:
    calm = ~F.col("suspect") & _clear_margins(p)
    return (F.when(calm & (F.col("confidence") >= p.clear_confidence), CLEAR)
            .when(calm & (F.col("confidence") >= p.auto_accept), DECISIVE)
            .when(F.col("suspect") | (F.col("confidence") < p.review_below)
                  | (F.col("neighbor_margin") < p.clear_margin * 0.4), CONTESTED)
            .otherwise(AMBIGUOUS))


def build_claims(pairs: DataFrame, rips: DataFrame, refs: DataFrame, policy: MatchPolicy = MatchPolicy()) -> DataFrame:
    """Pairs at or above the minimum similarity with runner-ups, margins, confidence, label and strength.

    Runner-ups look at all pairs, claimed or not, of which `claim_pairs` holds the ones that matter; absent pairs count as 0.
    """
    p = policy.normalized()
    # dealt by rip into tasks of so many pairs; all that a pair needs of its rip is then in its task
    pairs = store(pairs, "pairs")
    parts = parts_by_rows(pairs)
    pos = rips.select("grp", "key", "pos").repartition(parts, "grp", "key")
    pairs = store(pairs.repartition(parts, "grp", "key").join(pos, ["grp", "key"]), "claim-pairs")  # read twice below
    by_ref = _top_two(pairs, ["grp", "number"], [F.desc("score"), F.asc("pos")], "k", "key")
    by_ref = store(by_ref.join(refs.select("grp", "number", "suspect"), ["grp", "number"]), "reference-claims")
    base = _runners_up(pairs.repartition(parts, "grp", "key")).filter(F.col("score") >= p.min_similarity)
    alt_ref = F.when(F.col("f1.v") == F.col("number"), F.col("f2")).otherwise(F.col("f1"))
    alt_rip = F.when(F.col("k1.v") == F.col("key"), F.col("k2")).otherwise(F.col("k1"))
    zero = F.lit(0.0)
    c = (base.join(by_ref, ["grp", "number"])
         .select("grp", "key", "pos", "number", "suspect", "weighted", "raw", "score",
                 F.coalesce(alt_ref["v"], F.lit(0)).alias("runner_up_number"),
                 F.coalesce(alt_ref["s"], zero).alias("runner_up_score"),
                 alt_rip["v"].alias("rip_runner_up_key"),
                 F.coalesce(alt_rip["s"], zero).alias("rip_runner_up_score"),
                 *_neighbour()))
    for margin, other in (("rip_margin", "runner_up_score"), ("ref_margin", "rip_runner_up_score"),
                          ("neighbor_margin", "neighbor_score")):
        c = c.withColumn(margin, F.round(F.col("score") - F.col(other), V.PLACES))
    m, half = p.clear_margin, p.clear_margin / 2
    conf = (F.col("score") - _penalty("rip_margin", m, 0.20) - _penalty("ref_margin", m, 0.18)
            - _penalty("neighbor_margin", half, 0.16) - F.when(F.col("suspect"), 0.18).otherwise(0.0))
    c = c.withColumn("confidence", F.round(_clamp01(conf), V.PLACES)).withColumn("quality", quality_label(p))
    reasons = F.array(F.when(F.col("rip_margin") < m, "rip_margin"), F.when(F.col("ref_margin") < m, "episode_margin"),
                      F.when(F.col("neighbor_margin") < half, "neighbor_margin"),
                      F.when(F.col("suspect"), "suspect_reference"),
                      F.when(F.col("confidence") < p.auto_accept, "confidence_below_auto_accept_threshold"))
    gain = sum(F.lit(w) * F.greatest(zero, F.col(k))
               for w, k in ((0.10, "rip_margin"), (0.10, "ref_margin"), (0.05, "neighbor_margin")))
    strength = F.col("confidence") + gain - F.when(F.col("suspect"), 0.15).otherwise(0.0)
    return c.select("*", F.array_join(F.array_compact(reasons), ",").alias("reasons"),
                    (F.col("suspect") | (F.col("confidence") < p.auto_accept) | ~_clear_margins(p)).alias("needs_verify"),
                    F.round(strength, V.PLACES).alias("strength"),
                    (_clear_margins(p) & ~F.col("suspect") & (F.col("confidence") >= p.auto_accept)).alias("auto_accept"))


CLAIM_ORDER = ("strength", "score", "number", "key")


def _claim_rank() -> Column:
    return F.struct(-F.col("strength"), -F.col("score"), F.col("number"), F.col("key"))


def assign_greedy(candidates: DataFrame, rank: Callable[[], Column]) -> DataFrame:
    """Greedy one-to-one choice over a strict total order, as rounds of mutual best rows.

    A row that is first for its rip and first for its reference is taken; rows touching a taken rip or reference
    leave; the rest goes to the next round.  Both minima are plain aggregates, so no partition is gathered.
    Rows with a null group, key or number cannot be assigned.
    """
    open_rows = cut_lineage(candidates.dropna(subset=["grp", "key", "number"]))
    taken: list[DataFrame] = []
    while True:
        first_rip = open_rows.groupBy("grp", "key").agg(F.min(rank()).alias("r")).select("grp", "key", "r")
        first_ref = open_rows.groupBy("grp", "number").agg(F.min(rank()).alias("q")).select("grp", "number", "q")
        won = cut_lineage(open_rows.withColumn("_o", rank()).join(first_rip, ["grp", "key"])
                          .join(first_ref, ["grp", "number"])
                          .filter((F.col("_o") == F.col("r")) & (F.col("_o") == F.col("q")))
                          .select(*candidates.columns))
        taken.append(won)
        if won.isEmpty():
            break
        open_rows = cut_lineage(open_rows.join(won.select("grp", "key"), ["grp", "key"], "left_anti")
                                .join(won.select("grp", "number"), ["grp", "number"], "left_anti"))
        if open_rows.isEmpty():
            break
    out = taken[0]
    for more in taken[1:]:
        out = out.unionByName(more)
    return store(out, "assigned")


def assign_one_to_one(claims: DataFrame) -> DataFrame:
    """Auto-acceptable claims in order of strength, score, number, key; one per rip and one per reference."""
    auto = claims.filter("auto_accept")
    label = F.when(F.col("quality") == DECISIVE, "decisive_low_similarity_claim").otherwise("clear_claim")
    return assign_greedy(auto, _claim_rank).withColumn("accepted_by", label)


def pending_candidates(claims: DataFrame, accepted: DataFrame) -> DataFrame:
    """Best two claims per open rip among references that are not taken."""
    w = Window.partitionBy("grp", "key").orderBy(F.desc("strength"), F.desc("score"), "number")
    return (claims.join(accepted.select("grp", "key"), ["grp", "key"], "left_anti")
            .join(accepted.select("grp", "number"), ["grp", "number"], "left_anti")
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= PENDING_PER_RIP))


def unclaimed(rips: DataFrame, claims: DataFrame) -> DataFrame:
    """Rips without any claim: probable extras.

    One row of a claimed rip is enough; both sides are dealt into tasks of so many rips, however many claims they have.
    """
    keys = rips.select("grp", "key")
    parts = parts_by_rows(keys)
    claimed = claims.select("grp", "key").distinct()
    return keys.repartition(parts, "grp", "key").join(claimed.repartition(parts, "grp", "key"), ["grp", "key"], "left_anti")


def unresolved(pending: DataFrame, accepted: DataFrame) -> DataFrame:
    """Rips with candidates but no acceptance."""
    return (pending.select("grp", "key").distinct()
            .join(accepted.select("grp", "key"), ["grp", "key"], "left_anti"))


def single_missing(numbers: DataFrame) -> DataFrame:
    """(grp, missing) for groups whose distinct numbers leave exactly one hole between first and last."""
    g = (numbers.filter("number > 0").select("grp", "number").distinct().groupBy("grp")
         .agg(F.count(F.lit(1)).alias("n"), F.min("number").alias("lo"), F.max("number").alias("hi"),
              F.sum("number").alias("s")))
    total = F.expr("(lo + hi) * (hi - lo + 1) div 2")
    return g.filter("n >= 2 and hi - lo = n").select("grp", (total - F.col("s")).alias("missing"))


def single_hole_fill(accepted: DataFrame, pending: DataFrame, refs: DataFrame,
                     policy: MatchPolicy = MatchPolicy()) -> DataFrame:
    """The one open rip of a group takes the one missing number unless suspect or strongly contradicted."""
    p = policy.normalized()
    open_groups = (unresolved(pending, accepted).groupBy("grp").agg(F.count(F.lit(1)).alias("n_open"),
                                                                    F.max("key").alias("key"))
                   .filter("n_open = 1").select("grp", "key"))
    hole = single_missing(accepted).join(refs.select("grp", F.col("number").alias("missing")), ["grp", "missing"])
    cand = pending.join(open_groups, ["grp", "key"], "left_semi").join(hole, "grp")
    best = cand.filter("rank = 1").select("grp", F.col("number").alias("b_number"), F.col("score").alias("b_score"),
                                          F.col("confidence").alias("b_confidence"))
    blocked = ((F.col("b_number") != F.col("missing"))
               & ((F.col("b_score") >= F.col("score") + p.clear_margin)
                  | (F.col("b_confidence") >= p.clear_confidence)))
    return (cand.filter("number = missing and not suspect").join(best, "grp").filter(~blocked)
            .withColumn("confidence", F.round(_clamp01(F.col("confidence") - HOLE_PENALTY), V.PLACES))
            .withColumn("quality", quality_label(p))
            .withColumn("needs_verify", F.lit(False)).withColumn("reasons", F.lit(""))
            .withColumn("accepted_by", F.lit("single_hole_reconciliation"))
            .drop("missing", "b_number", "b_score", "b_confidence", "rank"))


def verdict_outcomes(pending: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Every pending pair with what the verdict queue does to it: verified, rejected, failed or skipped.

    The queue runs by (strength of the rip's first candidate desc, key, rank).  Positive verdicts are a greedy
    assignment over that order; a pair is skipped when its rip or its reference was taken earlier.
    """
    head = pending.filter("rank = 1").select("grp", "key", F.col("strength").alias("entry"))
    q = (pending.join(head, ["grp", "key"])
         .join(verdicts.select("grp", "key", "number", F.col("same").alias("verdict")), ["grp", "key", "number"], "left"))
    order = F.struct(-F.col("entry"), F.col("key"), F.col("rank"))
    q = cut_lineage(q.withColumn("turn", order))
    won = assign_greedy(q.filter("verdict"), lambda: F.col("turn"))
    by_rip = won.select("grp", "key", F.col("turn").alias("rip_turn"))
    by_ref = won.select("grp", "number", F.col("turn").alias("ref_turn"))
    earlier = (F.coalesce(F.col("rip_turn") < F.col("turn"), F.lit(False))
               | F.coalesce(F.col("ref_turn") < F.col("turn"), F.lit(False)))
    outcome = (F.when(earlier, "skipped").when(F.col("verdict").isNull(), "failed")
               .when(F.col("verdict"), "verified").otherwise("rejected"))
    return (q.join(by_rip, ["grp", "key"], "left").join(by_ref, ["grp", "number"], "left")
            .withColumn("outcome", outcome).drop("rip_turn", "ref_turn", "turn"))


def verdict_summary(outcomes: DataFrame) -> DataFrame:
    def n(*names: str) -> Column:
        return F.count_if(F.col("outcome").isin(*names))

    return outcomes.groupBy("grp").agg(
        n("verified", "rejected", "failed").alias("challenged"), n("verified").alias("verified"),
        n("rejected").alias("rejected"), n("failed").alias("failed"),
        (n("rejected", "failed") > 0).alias("needs_review"))


def confidence_counts(matches: DataFrame, lo: float, hi: float) -> DataFrame:
    """Matches per quality label and decisive ones with confidence in [lo, hi)."""
    q = F.col("quality")
    return matches.groupBy("grp").agg(
        *[F.count_if(q == label).alias(label) for label in (CLEAR, DECISIVE, AMBIGUOUS, CONTESTED)],
        F.count_if((q == DECISIVE) & (F.col("confidence") >= lo) & (F.col("confidence") < hi)).alias("decisive_in_band"))


def resolution_counts(accepted: DataFrame, pending: DataFrame, refs: DataFrame) -> DataFrame:
    """Per group: accepted clear / decisive, open rips by kind, suspect references."""
    a = accepted.groupBy("grp").agg(F.count_if(F.col("accepted_by") == "clear_claim").alias("clear_matches"),
                                    F.count_if(F.col("accepted_by") != "clear_claim").alias("decisive_matches"))
    rip = pending.groupBy("grp", "key").agg(F.count(F.lit(1)).alias("n"), F.min_by("quality", "rank").alias("q"))
    lone = (F.col("q") == DECISIVE) & (F.col("n") == 1)
    contested = ~lone & ((F.col("q") == CONTESTED) | (F.col("n") > 1))
    b = rip.groupBy("grp").agg(F.count_if(lone).alias("open_decisive"), F.count_if(contested).alias("contested"),
                               F.count_if(~lone & ~contested).alias("ambiguous"))
    s = refs.groupBy("grp").agg(F.count_if("suspect").alias("suspect_references"))

    def z(c: str) -> Column:
        return F.coalesce(c, F.lit(0))

    return (s.join(a, "grp", "left").join(b, "grp", "left")
            .select("grp", z("clear_matches").alias("clear_matches"),
                    (z("decisive_matches") + z("open_decisive")).alias("decisive_matches"),
                    z("ambiguous").alias("ambiguous"), z("contested").alias("contested"), "suspect_references"))


def apply_matches(episodes: DataFrame, accepted: DataFrame, no_claim: DataFrame, season: DataFrame,
                  policy: MatchPolicy = MatchPolicy()) -> DataFrame:
    """Episodes with their accepted number, title, scores and review reasons."""
    p = policy.normalized()
    m = accepted.select("grp", "key", F.col("number").alias("m_number"), F.col("score").alias("match_score"),
                        F.col("confidence").alias("match_confidence"))
    extra = no_claim.select("grp", "key").distinct().withColumn("extra", F.lit(True))
    names = season.select("grp", F.col("number").alias("m_number"), F.trim("name").alias("title"))
    hit = F.col("m_number").isNotNull()
    low = hit & (F.col("match_confidence") < p.review_below)
    reasons = F.array(
        F.when(~hit & F.col("extra"), "no reference claims it, probably an extra"),
        F.when(~hit & F.col("extra").isNull(), "claimed, but not decided"),
        F.when(low, F.format_string("decided with confidence %.3f, wanted %.2f", F.col("match_confidence"),
                                    F.lit(p.review_below))))
    status = (F.when(low, "low_confidence").when(hit, "matched").when(F.col("extra"), "probable_extra")
              .otherwise("unresolved"))
    return (episodes.join(m, ["grp", "key"], "left").join(extra, ["grp", "key"], "left")
            .join(names, ["grp", "m_number"], "left")
            .withColumn("number", F.coalesce("m_number", "number")).withColumn("status", status)
            .withColumn("reasons", F.array_compact(reasons)).drop("m_number", "extra"))


def apply_summary(applied: DataFrame) -> DataFrame:
    s = F.col("status")
    return applied.groupBy("grp").agg(
        F.count(F.lit(1)).alias("episodes"), F.count_if(s == "unresolved").alias("unresolved"),
        F.count_if(s == "probable_extra").alias("probable_extras"),
        F.count_if(s == "low_confidence").alias("low_confidence"))


def match_summary(applied: DataFrame, refs: DataFrame, policy: MatchPolicy = MatchPolicy()) -> DataFrame:
    """Matched, unresolved, low-confidence, references and contiguity of the accepted numbers per group."""
    p = policy.normalized()
    hit = F.col("match_score").isNotNull()
    g = applied.groupBy("grp").agg(
        F.count_if(F.coalesce(F.col("number") > 0, F.lit(False))).alias("matched"),
        F.count_if(~F.coalesce(F.col("number") > 0, F.lit(False))).alias("unresolved"),
        F.count_if((F.col("match_confidence") > 0) & (F.col("match_confidence") < p.review_below)).alias("low_confidence"),
        F.count_if(hit).alias("_n"), F.countDistinct(F.when(hit, F.col("number"))).alias("_d"),
        (F.max(F.when(hit, F.col("number"))) - F.min(F.when(hit, F.col("number")))).alias("_span"))
    contiguous = (F.col("_n") < 2) | ((F.col("_n") == F.col("_d")) & (F.col("_span") == F.col("_n") - 1))
    r = refs.groupBy("grp").agg(F.count(F.lit(1)).alias("references"))
    return (g.join(r, "grp", "left")
            .select("grp", "matched", "unresolved", "low_confidence", F.coalesce("references", F.lit(0)).alias("references"),
                    contiguous.alias("contiguous")))


def double_length(first: Column, median: Column) -> Column:
    """Between 1.8 and 2.4 times the median, both bars truncated to whole seconds."""
    return (first >= F.floor(median * 1.8)) & (first <= F.floor(median * 2.4))


def opening_double(episodes: DataFrame) -> DataFrame:
    """(grp, opens_double): the first of at least three episodes is double-length against the others."""
    from catalogops.operators.skew import upper_median_rank, value_at_ranks

    first = episodes.groupBy("grp").agg(F.min("pos").alias("pos"), F.min_by("duration", "pos").alias("first"),
                                        F.count(F.lit(1)).alias("members"))
    rest = (episodes.join(first.select("grp", F.col("pos").alias("p0")), "grp")
            .filter("pos > p0 and duration > 0"))
    med = value_at_ranks(rest, ["grp"], "duration", {"median": upper_median_rank()})
    flag = ((F.col("members") >= 3) & (F.col("first") > 0) & (F.coalesce("n", F.lit(0)) >= 2)
            & double_length(F.col("first"), F.col("median")))
    return first.join(med, "grp", "left").select("grp", "members", F.coalesce(flag, F.lit(False)).alias("opens_double"))


def block_candidates(episodes: DataFrame, season: DataFrame, discs: DataFrame) -> DataFrame:
    """Reference numbers in the first search scope of each group with the scope's reason.

    A resolved range widened to the rip count wins, else the disc's block with padding, else the first 2n numbers.
    `episodes` (grp, pos, number, duration), `season` (grp, number), `discs` (grp, disc).
    """
    s = season.filter("number > 0").select("grp", "number").distinct()
    s = sliced_window(s, ["grp"], ["number"], int_slice("number", 100_000), number="ord", total="season_size")
    ends = s.groupBy("grp").agg(F.min("number").alias("s_lo"), F.max("number").alias("s_hi"))
    e = episodes.groupBy("grp").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("number") > 0, F.col("number"))).alias("r_lo"),
        F.max(F.when(F.col("number") > 0, F.col("number"))).alias("r_hi"))
    b = (ends.join(e, "grp", "left").join(discs.select("grp", "disc"), "grp", "left")
         .join(opening_double(episodes).select("grp", "opens_double"), "grp", "left")
         .withColumn("n", F.coalesce("n", F.lit(0))))
    k = F.greatest(F.lit(0), F.col("n") - (F.col("r_hi") - F.col("r_lo") + 1))
    up_room, down_room = F.greatest(F.lit(0), F.col("s_hi") - F.col("r_hi")), F.greatest(F.lit(0), F.col("r_lo") - F.col("s_lo"))
    up_half, down_half = F.ceil(k / 2), F.floor(k / 2)
    up = F.least(up_room, up_half + F.greatest(F.lit(0), down_half - down_room))
    down = F.least(down_room, down_half + F.greatest(F.lit(0), up_half - up_room))
    block = F.when(F.col("n") <= 0, 4).when(F.col("opens_double"), F.col("n") + 1).otherwise(F.col("n"))
    pad = F.greatest(F.lit(2), F.floor(block / 4))
    b = b.select("grp", (F.col("r_lo") - down).alias("a_lo"), (F.col("r_hi") + up).alias("a_hi"),
                 F.when(F.col("disc") > 0, (F.col("disc") - 1) * block + 1 - pad).alias("b_lo"),
                 F.when(F.col("disc") > 0, F.col("disc") * block + pad).alias("b_hi"),
                 F.greatest(F.col("n") * 2, F.lit(1)).alias("prefix"))
    j = s.join(b, "grp").select(
        "grp", "number",
        F.coalesce(F.col("number").between(F.col("a_lo"), F.col("a_hi")), F.lit(False)).alias("in_a"),
        F.coalesce(F.col("number").between(F.col("b_lo"), F.col("b_hi")), F.lit(False)).alias("in_b"),
        (F.col("ord") <= F.col("prefix")).alias("in_c"))
    pick = j.groupBy("grp").agg(F.bool_or("in_a").alias("has_a"), F.bool_or("in_b").alias("has_b"))
    reason = (F.when(F.col("has_a"), "resolved_episode_scope").when(F.col("has_b"), "disc_block_estimate")
              .otherwise("season_prefix_fallback"))
    keep = F.when(F.col("has_a"), F.col("in_a")).when(F.col("has_b"), F.col("in_b")).otherwise(F.col("in_c"))
    return j.join(pick, "grp").filter(keep).select("grp", "number", reason.alias("scope"))


def expand_scope(scope: DataFrame, season: DataFrame, rips: DataFrame, accepted: DataFrame, refs: DataFrame) -> DataFrame:
    """(grp, reason) of groups whose first scope must be widened to the whole season."""
    part = scope.groupBy("grp").agg(F.count(F.lit(1)).alias("n_scope"))
    full = season.filter("number > 0").groupBy("grp").agg(F.countDistinct("number").alias("n_season"))
    r = rips.groupBy("grp").agg(F.count(F.lit(1)).alias("n_rips"))
    a = accepted.groupBy("grp").agg(F.count(F.lit(1)).alias("n_accepted"))
    used = refs.join(scope, ["grp", "number"], "left_semi").groupBy("grp").agg(F.count_if("suspect").alias("n_suspect"))
    reason = (F.when(F.coalesce("n_accepted", F.lit(0)) < F.coalesce("n_rips", F.lit(0)), "initial_scope_left_unresolved_titles")
              .when(F.coalesce("n_suspect", F.lit(0)) > 0, "initial_scope_contains_suspect_references"))
    return (part.join(full, "grp").filter("n_scope < n_season").join(r, "grp", "left").join(a, "grp", "left")
            .join(used, "grp", "left").select("grp", reason.alias("reason")).filter("reason is not null"))


def opening_double_shift(episodes: DataFrame, season: DataFrame) -> DataFrame:
    """Disc 1 that opens with a double-length title: it covers 1-2 and the others move up when needed.

    `episodes` (grp, disc, key, pos, number, duration); applied where every number is resolved and they run
    consecutively from 1 or 2.
    """
    e = sliced_window(episodes, ["grp"], ["pos"], int_slice("pos", 100_000), number="_rn")
    g = e.groupBy("grp").agg(F.min("number").alias("_lo"), F.min_by("number", "pos").alias("_start"),
                             F.min(F.col("number") - F.col("_rn")).alias("_d0"),
                             F.max(F.col("number") - F.col("_rn")).alias("_d1"),
                             F.max("disc").alias("_disc"))
    flag = (F.col("opens_double") & (F.col("_disc") == 1) & (F.col("_lo") > 0) & F.col("_start").isin(1, 2)
            & (F.col("_d0") == F.col("_d1")))
    g = (g.join(opening_double(episodes).select("grp", "opens_double"), "grp")
         .select("grp", "_start", F.coalesce(flag, F.lit(False)).alias("_shift")))
    first = F.col("_rn") == 1
    number = (F.when(F.col("_shift") & first, 1).when(F.col("_shift") & (F.col("_start") == 1), F.col("number") + 1)
              .otherwise(F.col("number")))
    names = season.select("grp", F.col("number").alias("new_number"), F.trim("name").alias("title"))
    second = season.filter("number = 2").select("grp", F.trim("name").alias("_t2"))
    out = (e.join(g, "grp").withColumn("new_number", number)
           .withColumn("number_end", F.when(F.col("_shift") & first, 2))
           .join(names, ["grp", "new_number"], "left").join(second, "grp", "left"))
    both = F.concat_ws(" / ", "title", "_t2")
    return out.select(*episodes.columns, F.col("new_number").cast("long").alias("new_number"), "number_end",
                      F.when(F.col("_shift") & first & F.col("title").isNotNull() & F.col("_t2").isNotNull(), both)
                      .otherwise(F.col("title")).alias("title"), F.col("_shift").alias("shifted"))
