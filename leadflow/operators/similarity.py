"""Similar-campaign index without enumerating campaign pairs.

Two campaigns are similar when they share at least one of the dimensions
``flag_program, jenis_leads, media_blasting`` (a null never matches). A
lookup returns, for a campaign X, the similar campaigns ordered by number
of shared dimensions (desc), take-up rate (desc), id (asc), 20 by default.

All-pairs comparison is quadratic inside a dimension value (a two-valued
program flag alone puts half the campaigns in one value), so we never build
it. Instead, for every non-empty subset M of the dimensions (7 of them):

1. *Lists*: campaigns keyed by their values on M; each key keeps its top
   ``k + 1`` members by (rate desc, id asc). The window limit runs partially
   before the shuffle, so a hot key costs at most ``k + 1`` rows per map task.
2. *Candidates*: each campaign X joins the list of its own M-key (an
   equi-join). A member Y is kept only from the list whose M is exactly the
   set of dimensions X and Y share.

Exact: let Y be in X's true top-k and S the set they share. Everything ranked
above Y in X's S-list agrees with X on all of S, so it shares at least as
many dimensions and has a higher rate (or equal rate and smaller id): it is
above Y in X's ranking too. Fewer than k campaigns are, so Y is within the
top ``k + 1`` of that list (one slot for X itself). The same argument holds
for a rate-only ranking and under a required-dimensions filter.

Per campaign at most ``7 * (k + 1)`` candidates, whatever the skew or the
cardinality of the dimensions; counts of similar campaigns come from the
7 key sizes by inclusion-exclusion, also without pairs.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leadflow.functions.domains import (MAX_SIMILAR_RESULTS, NO_SIMILAR_MESSAGE, NOT_AVAILABLE,
                                        SIMILARITY_DIMENSIONS)

DIMS = SIMILARITY_DIMENSIONS


SUBSETS = [c for r in range(len(DIMS), 0, -1) for c in combinations(DIMS, r)]
KEY = ["subset_id"] + [f"key_{i}" for i in range(len(DIMS))]


def _subset_keys(dim: DataFrame, subsets) -> DataFrame:
    """One row per (campaign, subset M) where the campaign has values on all
    of M: the key is (subset id, the values on M, '' outside M), so one
    window and one equi-join serve all subsets at once."""
    rows = []
    for i, m in subsets:
        present = reduce(lambda a, b: a & b, [F.col(d).isNotNull() for d in m])
        rows.append(F.struct(
            F.lit(i).alias("subset_id"),
            *[(F.col(d) if d in m else F.lit("")).alias(f"key_{j}") for j, d in enumerate(DIMS)],
            present.alias("_present")))
    return dim.select("*", F.inline(F.array(*rows))).filter("_present").drop("_present")


def _shares(d: str) -> F.Column:
    return F.coalesce(F.col(f"x_{d}") == F.col(f"y_{d}"), F.lit(False))


def similar_candidates(dim: DataFrame, k: int = MAX_SIMILAR_RESULTS,
                       required: list[str] | None = None, attributes: bool = False) -> DataFrame:
    """Every (X, similar campaign) pair that can reach X's top ``k``, at most
    ``7 * (k + 1)`` per X, optionally only those sharing all ``required``
    dimensions (F13)."""
    req = set(required or [])
    bad = sorted(req - set(DIMS))
    if bad:
        raise ValueError(f"invalid dimension(s) {bad}; allowed {sorted(DIMS)}")
    subsets = [(i, m) for i, m in enumerate(SUBSETS) if req <= set(m)]
    keyed = _subset_keys(dim, subsets)
    with_start = "periode_start" in dim.columns
    w = Window.partitionBy(*KEY).orderBy(F.col("take_up_rate").desc(), F.col("campaign_id").asc())
    lists = (keyed.select(*KEY, *[F.col(d).alias(f"y_{d}") for d in DIMS],
                          F.col("campaign_id").alias("similar_campaign_id"),
                          F.col("nama_program").alias("campaign_name"),
                          "take_up_rate", "total_leads", "total_take_up",
                          *([F.col("periode_start").alias("y_start")] if with_start else []),
                          F.row_number().over(w).alias("_pos"))
                  .filter(F.col("_pos") <= k + 1).drop("_pos"))
    xs = keyed.select("campaign_id", *KEY, *[F.col(d).alias(f"x_{d}") for d in DIMS])
    # keep Y only from the list of exactly the dimensions X and Y share
    in_m = {d: F.element_at(F.array(*[F.lit(d in m) for m in SUBSETS]), F.col("subset_id") + 1)
            for d in DIMS}
    exact = reduce(lambda a, b: a & b, [_shares(d) == in_m[d] for d in DIMS])
    shared = F.array_compact(F.array(*[F.when(in_m[d], F.lit(d)) for d in sorted(DIMS)]))
    n = F.size(shared)
    return (xs.join(lists, KEY)
              .filter((F.col("similar_campaign_id") != F.col("campaign_id")) & exact)
              .select("campaign_id", "similar_campaign_id", "campaign_name",
                      shared.alias("matching_dimensions"),
                      n.alias("dimension_count"),
                      (n / F.lit(float(len(DIMS)))).alias("similarity_score"),
                      "take_up_rate", "total_leads", "total_take_up",
                      *([F.col(f"y_{d}").alias(f"similar_{d}") for d in DIMS]
                        + ([F.col("y_start").alias("similar_periode_start")] if with_start else [])
                        if attributes else [])))


def similar_topk(dim: DataFrame, k: int | None = MAX_SIMILAR_RESULTS,
                 required: list[str] | None = None, attributes: bool = False) -> DataFrame:
    """O4 (+F13, J6): top-k similar campaigns per campaign, for any k >= 1
    (``None`` means 20), with the similar campaign's name, leads and take-ups."""
    k = MAX_SIMILAR_RESULTS if k is None else k
    if k < 1:
        raise ValueError("limit must be >= 1")
    cand = similar_candidates(dim, k, required, attributes)
    w = Window.partitionBy("campaign_id").orderBy(
        F.col("dimension_count").desc(), F.col("take_up_rate").desc(),
        F.col("similar_campaign_id").asc())
    return (cand.withColumn("rank", F.row_number().over(w))
                .filter(F.col("rank") <= k)
                .withColumn("similarity_score", F.round("similarity_score", 6))
                .withColumn("take_up_rate", F.round("take_up_rate", 6)))


def similarity_index(dim: DataFrame, k: int = MAX_SIMILAR_RESULTS) -> DataFrame:
    """S11/U1 re-aimed: the stored index holds, per campaign, the ``k`` entries
    a lookup can return (each campaign keyed on its own id, so both
    directions of a pair appear when both rank it)."""
    return similar_topk(dim, k)


def best_similar(dim: DataFrame) -> DataFrame:
    """Per campaign, the similar campaign with the highest take-up rate
    (id breaks ties) and how many similar campaigns there are."""
    cand = similar_candidates(dim, 1)
    w = Window.partitionBy("campaign_id").orderBy(
        F.col("take_up_rate").desc(), F.col("similar_campaign_id").asc())
    best = (cand.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")
                .select("campaign_id",
                        F.col("similar_campaign_id").alias("best_similar_id"),
                        F.col("campaign_name").alias("best_similar_name"),
                        F.col("take_up_rate").alias("best_similar_rate"),
                        F.col("similarity_score").alias("best_similar_score")))
    counts = similarity_counts(dim).groupBy("campaign_id").agg(
        F.sum("similar_campaigns").alias("similar_count"))
    return counts.join(best, "campaign_id", "left")


def similarity_counts(dim: DataFrame) -> DataFrame:
    """Per campaign and number of shared dimensions c, how many campaigns
    share exactly c dimensions with it.

    N_T = campaigns other than X agreeing with X on every dimension of T (a
    key size minus X itself; 0 when X has a null in T). Then, by
    inclusion-exclusion, the number sharing exactly c dimensions is
    sum over |T| >= c of (-1)^(|T|-c) * C(|T|, c) * N_T."""
    subsets = list(enumerate(SUBSETS))
    keyed = _subset_keys(dim.select("campaign_id", *DIMS), subsets)
    sizes = keyed.groupBy(*KEY).agg((F.count(F.lit(1)) - 1).alias("_others"))
    per_key = keyed.select("campaign_id", *KEY).join(sizes, KEY)
    aggs = []
    for c in range(1, len(DIMS) + 1):
        coefs = [(-1) ** (len(m) - c) * comb(len(m), c) if len(m) >= c else 0 for m in SUBSETS]
        coef = F.element_at(F.array(*[F.lit(int(v)) for v in coefs]), F.col("subset_id") + 1)
        aggs.append(F.sum(coef * F.col("_others")).alias(f"_c{c}"))
    per_x = per_key.groupBy("campaign_id").agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("dimension_count"), F.col(f"_c{c}").alias("similar_campaigns"))
                     for c in range(1, len(DIMS) + 1)])
    return (per_x.select("campaign_id", F.inline(rows))
                 .filter(F.col("similar_campaigns") > 0))


def similar_enriched(dim: DataFrame, k: int = MAX_SIMILAR_RESULTS) -> DataFrame:
    """Index rows with the similar campaign's own dimension values and
    start date. The lists carry them along, so nothing is joined on the similar
    campaign, which for a highly rated one is in nearly every list."""
    return similar_topk(dim, k, attributes=True)


def learning_summary(dim: DataFrame, required: list[str] | None = None) -> DataFrame:
    """X5 in O4: per campaign, the summary a lookup shows for its top-ranked
    similar campaign: that campaign's index rate (6 dp) as ``12.34%``; the
    segment and region are not in the index and read ``N/A``. A campaign
    with no similar campaign gets the "nothing similar" message instead.

    Only rank 1 is needed, so each subset list keeps two members.
    """
    top = (similar_topk(dim, 1, required)
           .select("campaign_id", "similar_campaign_id", "take_up_rate"))
    has = F.col("similar_campaign_id").isNotNull()
    return (dim.select("campaign_id").join(top, "campaign_id", "left")
               .select("campaign_id",
                       F.col("similar_campaign_id").alias("top_similar_campaign_id"),
                       F.when(has, F.format_string("%.2f%%", F.round("take_up_rate", 2)))
                        .alias("take_up_rate_formatted"),
                       F.when(has, F.lit(NOT_AVAILABLE)).alias("top_segment"),
                       F.when(has, F.lit(NOT_AVAILABLE)).alias("top_region"),
                       F.when(~has, F.lit(NO_SIMILAR_MESSAGE)).alias("message")))


def lookup(index: DataFrame, campaign_id: str, k: int = MAX_SIMILAR_RESULTS) -> DataFrame:
    """F10 on the stored index: the ``k`` best similar campaigns of one campaign.
    On a bucketed index the key picks one bucket."""
    if k < 1:
        raise ValueError("limit must be at least 1")
    return index.filter((F.col("campaign_id") == campaign_id) & (F.col("rank") <= k))


def with_own_rate(index: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Each similar campaign's rate beside the campaign's own; two tables that
    are bucketed by campaign_id alike join where they lie."""
    own = campaigns.select("campaign_id", F.col("take_up_rate").alias("own_take_up_rate"), F.col("total_leads").alias("own_total_leads"))
    return (index.join(own, "campaign_id")
            .select("campaign_id", "similar_campaign_id", "rank", "dimension_count", "take_up_rate", "own_take_up_rate", "own_total_leads",
                    (F.col("take_up_rate") - F.col("own_take_up_rate")).alias("rate_gain")))
