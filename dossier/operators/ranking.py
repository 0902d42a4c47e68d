"""Ranking evaluation against graded judgments, all metrics as aggregations.

Nothing is collected per resume: every metric is a sum over (resume, ...) groups that combine on the
map side, and the one running count (average precision) is cut into rank chunks first, so a resume
that owns a third of all result rows is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, seeded
from ..sources.checks import require_columns

# Evaluation parameters.
K_VALUES = (3, 5, 10)
RELEVANCE_THRESHOLD = 1.0
THRESHOLD_GRID = (0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.5, 2.0)
BUCKET_SIZE = 5
SAMPLE_RELEVANCE = ((0, 0.4), (1, 0.3), (2, 0.2), (3, 0.1))

CHUNK_RANKS = 4096


def load_judgments(df: DataFrame, ord: str = "ord") -> DataFrame:
    """``(resume_id, job_id, relevance)``, ids as text; the last row of a pair wins, of equal ones the best."""
    require_columns(df, ["resume_id", "job_id", "relevance"])
    return df.groupBy(
        F.col("resume_id").cast("string").alias("resume_id"), F.col("job_id").cast("string").alias("job_id")
    ).agg(F.max(F.struct(F.col(ord).alias("o"), F.col("relevance").cast("double").alias("r"))).alias("last")).select(
        "resume_id", "job_id", F.col("last.r").alias("relevance")
    )


def register_results(results: DataFrame, batch: str = "batch") -> DataFrame:
    """Results of the latest batch per resume; earlier lists of the same resume are replaced."""
    latest = results.groupBy("resume_id").agg(F.max(batch).alias("_latest"))
    return results.join(latest, "resume_id").filter(F.col(batch) == F.col("_latest")).drop("_latest")


def judge(results: DataFrame, judgments: DataFrame) -> DataFrame:
    """``(resume_id, rank, job_id, relevance)``: relevance is null where the pair was not judged.

    A resume with an empty result list is one row with null rank and job.
    """
    ids = [F.col(c).cast("string").alias(c) for c in ("resume_id", "job_id")]
    ranked = results.select(ids[0], F.col("rank").cast("long").alias("rank"), ids[1])
    return ranked.join(judgments.select(*ids, "relevance"), ["resume_id", "job_id"], "left").select(
        "resume_id", "rank", "job_id", "relevance"
    )


def _discounted(relevance: Column, rank: Column) -> Column:
    return relevance / F.log2(rank + F.lit(1.0))


def _judged_totals(judgments: DataFrame, ks: Sequence[int], t: float) -> DataFrame:
    """Per resume: judged relevant items and the ideal DCG at every k."""
    resume = F.col("resume_id").cast("string").alias("resume_id")
    relevant = judgments.groupBy(resume).agg(F.count_if(F.col("relevance") >= t).alias("n_relevant"))
    best = Window.partitionBy("resume_id").orderBy(F.desc("relevance"), "job_id")
    top = (
        judgments.select(resume, "job_id", "relevance")
        .withColumn("n", F.row_number().over(best))
        .filter(F.col("n") <= max(ks))
        .groupBy("resume_id")
        .agg(
            *[
                F.sum(F.when(F.col("n") <= k, _discounted(F.col("relevance"), F.col("n")))).alias(f"idcg_{k}")
                for k in ks
            ]
        )
    )
    return relevant.join(top, "resume_id")


def _list_totals(judged: DataFrame, ks: Sequence[int], t: float) -> DataFrame:
    """Per resume: discounted gain, hits and list length at every k, and the first relevant rank."""
    rank, relevance = F.col("rank"), F.col("relevance")
    columns = [F.min(F.when(relevance >= t, rank)).alias("first_hit")]
    for k in ks:
        inside = rank <= k
        columns += [
            F.sum(F.when(inside, _discounted(F.coalesce(relevance, F.lit(0.0)), rank))).alias(f"dcg_{k}"),
            F.count_if(inside & (relevance >= t)).alias(f"hits_{k}"),
            F.count_if(inside).alias(f"length_{k}"),
        ]
    return judged.groupBy("resume_id").agg(*columns)


def precision_sums(judged: DataFrame, t: float = RELEVANCE_THRESHOLD, chunk: int = CHUNK_RANKS) -> DataFrame:
    """Sum of the precision at each hit, per resume.

    Within a chunk of ranks a hit knows how many hits of its chunk came before it; the hits of earlier
    chunks are an offset that multiplies the chunk's sum of 1/rank. Only chunk totals meet per resume.
    """
    hits = judged.filter(F.col("relevance") >= t).select(
        "resume_id", "rank", F.floor((F.col("rank") - 1) / chunk).alias("chunk")
    )
    nth = F.row_number().over(Window.partitionBy("resume_id", "chunk").orderBy("rank"))
    totals = (
        hits.withColumn("nth", nth)
        .groupBy("resume_id", "chunk")
        .agg(
            F.count(F.lit(1)).alias("hits"),
            F.sum(F.col("nth") / F.col("rank")).alias("inner"),
            F.sum(F.lit(1.0) / F.col("rank")).alias("inverse"),
        )
    )
    before = F.sum("hits").over(
        Window.partitionBy("resume_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    )
    offset = totals.withColumn("offset", F.coalesce(before, F.lit(0)))
    return offset.groupBy("resume_id").agg(
        F.sum(F.col("inner") + F.col("offset") * F.col("inverse")).alias("precision_sum")
    )


def _label(t: float) -> Column:
    return F.when(F.col("relevance") >= t, F.col("relevance").cast("int")).otherwise(F.lit(0))


def _bucket() -> Column:
    return F.floor((F.col("rank") - 1) / BUCKET_SIZE) + 1


def cluster_agreement(judged: DataFrame, t: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """ARI and NMI per resume between judgment labels and rank buckets of five.

    A repeated job counts at its last rank. One pass with grouping sets gives the cells and both
    margins of every contingency table; both scores need only sums over those counts.
    """
    common = (
        judged.filter(F.col("relevance").isNotNull() & F.col("rank").isNotNull())
        .groupBy("resume_id", "job_id")
        .agg(F.max("rank").alias("rank"), F.max("relevance").alias("relevance"))
        .select("resume_id", _label(t).alias("label"), _bucket().alias("bucket"))
        .groupBy("resume_id", "label", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    resume, label, bucket = F.col("resume_id"), F.col("label"), F.col("bucket")
    tables = common.groupingSets(
        [[resume, label, bucket], [resume, label], [resume, bucket], [resume]], resume, label, bucket
    ).agg(F.sum("n").cast("double").alias("n"), F.grouping_id().alias("g"))
    cells, by_label, by_bucket, whole = 0, 1, 2, 3
    pairs, entropy = F.col("n") * (F.col("n") - 1) / 2, F.col("n") * F.log("n")

    def over(g: int, value: Column, name: str) -> Column:
        return F.sum(F.when(F.col("g") == g, value)).alias(name)

    sums = tables.groupBy("resume_id").agg(
        over(whole, F.col("n"), "n"),
        over(cells, pairs, "p"),
        over(by_label, pairs, "pa"),
        over(by_bucket, pairs, "pb"),
        over(cells, entropy, "l"),
        over(by_label, entropy, "la"),
        over(by_bucket, entropy, "lb"),
        over(by_label, F.lit(1), "na"),
        over(by_bucket, F.lit(1), "nb"),
    )
    n = F.col("n")
    few = n < 2
    expected = F.try_divide(F.col("pa") * F.col("pb"), n * (n - 1) / 2)
    spread = (F.col("pa") + F.col("pb")) / 2 - expected
    ari = F.when(few, 0.0).when(spread == 0, 1.0).otherwise(F.try_divide(F.col("p") - expected, spread))
    h = [F.log(n) - F.col(c) / n for c in ("la", "lb")]
    mi = F.log(n) + (F.col("l") - F.col("la") - F.col("lb")) / n
    nmi = (
        F.when(few, 0.0)
        .when((F.col("na") == 1) & (F.col("nb") == 1), 1.0)
        .when(mi < 1e-12, 0.0)
        .otherwise(F.try_divide(mi, (h[0] + h[1]) / 2))
    )
    return sums.select("resume_id", ari.alias("ari"), nmi.alias("nmi"))


def purity(judged: DataFrame, t: float = RELEVANCE_THRESHOLD) -> DataFrame:
    """Share of judged results that carry the majority label of their rank bucket; repeats count."""
    counts = (
        judged.filter(F.col("relevance").isNotNull() & F.col("rank").isNotNull())
        .groupBy("resume_id", _bucket().alias("bucket"), _label(t).alias("label"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    majority = counts.groupBy("resume_id", "bucket").agg(F.max("n").alias("m"), F.sum("n").alias("n"))
    return majority.groupBy("resume_id").agg((F.sum("m") / F.sum("n")).alias("purity"))


METRICS = ("ndcg", "precision", "recall", "mrr", "map", "ari", "nmi", "purity")
METRICS_AT_K = ("ndcg", "precision", "recall")


def _per_resume(
    judged: DataFrame, judgments: DataFrame, ks: Sequence[int], t: float, metrics: Sequence[str]
) -> DataFrame:
    """One row per resume with results and judgments: the scores and whether each counts."""
    base = _list_totals(judged, ks, t).join(_judged_totals(judgments, ks, t), "resume_id")
    if "map" in metrics:
        base = base.join(precision_sums(judged, t), "resume_id", "left")
    if "ari" in metrics or "nmi" in metrics:
        base = base.join(cluster_agreement(judged, t), "resume_id", "left")
    if "purity" in metrics:
        base = base.join(purity(judged, t), "resume_id", "left")

    relevant = F.col("n_relevant")

    def entry(metric: str, k: int | None) -> tuple[Column, Column]:
        ideal, hits, length = F.col(f"idcg_{k}"), F.col(f"hits_{k}"), F.col(f"length_{k}")
        if metric == "ndcg":
            return F.when(ideal > 0, F.col(f"dcg_{k}") / ideal), F.coalesce(ideal > 0, F.lit(False))
        if metric == "precision":
            return F.try_divide(hits, length), length > 0
        if metric == "recall":
            return F.when(relevant == 0, 1.0).otherwise(F.try_divide(hits, relevant)), F.lit(True)
        if metric == "mrr":
            return F.lit(1.0) / F.col("first_hit"), F.lit(True)
        if metric == "map":
            found = F.try_divide(F.col("precision_sum"), relevant)
            return F.when(relevant == 0, 1.0).otherwise(found), F.lit(True)
        return F.col(metric), F.lit(True)

    entries = []
    for metric, k in metric_order(ks, metrics):
        score, valid = entry(metric, k)
        entries.append(
            F.struct(
                F.lit(metric).alias("metric"),
                F.lit(k).cast("int").alias("k"),
                F.coalesce(score, F.lit(0.0)).alias("score"),
                valid.alias("valid"),
            )
        )
    return base.select("resume_id", F.array(*entries).alias("scores"))


def metric_order(ks: Sequence[int], metrics: Sequence[str] = METRICS) -> list[tuple[str, int | None]]:
    """Report order: the metrics at every k first, then the others."""
    return [(m, k) for m in METRICS if m in metrics for k in (ks if m in METRICS_AT_K else [None])]


def scores(
    judged: DataFrame,
    judgments: DataFrame,
    ks: Sequence[int] = K_VALUES,
    t: float = RELEVANCE_THRESHOLD,
    metrics: Sequence[str] = METRICS,
) -> DataFrame:
    """``(resume_id, metric, k, score, valid)``; the ``valid`` rows form the average."""
    return _per_resume(judged, judgments, ks, t, metrics).select("resume_id", F.inline("scores"))


def averages(scored: DataFrame, ks: Sequence[int] = K_VALUES) -> DataFrame:
    """``(metric, k, average, position)`` in report order; 0.0 where nothing was counted."""
    def mean(metric: str, k: int | None) -> Column:
        mine = (F.col("metric") == metric) & (F.col("k") == k if k is not None else F.col("k").isNull())
        total, valid = F.sum(F.when(mine, F.col("score"))), F.count_if(mine & F.col("valid"))
        return F.coalesce(F.try_divide(total, valid), F.lit(0.0))

    entries = [
        F.struct(
            F.lit(metric).alias("metric"),
            F.lit(k).cast("int").alias("k"),
            mean(metric, k).alias("average"),
            F.lit(i).alias("position"),
        )
        for i, (metric, k) in enumerate(metric_order(ks))
    ]
    return scored.agg(F.array(*entries).alias("a")).select(F.inline("a"))


def evaluate(
    results: DataFrame,
    judgments: DataFrame,
    ks: Sequence[int] = K_VALUES,
    t: float = RELEVANCE_THRESHOLD,
) -> DataFrame:
    """Average of every metric.

    The judged results feed several aggregations, which share the exchanges of the join. Results that
    are expensive to compute should be a written table.
    """
    return averages(scores(judge(results, judgments), judgments, ks, t), ks)


def report(results: DataFrame, judgments: DataFrame, averaged: DataFrame) -> DataFrame:
    """Averages in fixed order with the counts of evaluated and judged resumes."""
    def resumes(df: DataFrame, name: str) -> Column:
        return df.agg(F.count_distinct("resume_id").alias(name)).scalar().alias(name)

    return averaged.select(
        "position",
        "metric",
        "k",
        F.bround("average", 4).alias("average"),
        resumes(results, "resumes_evaluated"),
        resumes(judgments, "resumes_judged"),
    ).orderBy("position")


def threshold_grid(
    judged: DataFrame,
    judgments: DataFrame,
    ks: Sequence[int] = K_VALUES,
    thresholds: Sequence[float] = THRESHOLD_GRID,
) -> DataFrame:
    """``(threshold, precision, recall, f1)`` at the second k, all thresholds in one pass."""
    k = ks[1]
    resume = F.col("resume_id").cast("string").alias("resume_id")
    inside = F.col("rank") <= k
    lists = judged.groupBy("resume_id").agg(
        F.count_if(inside).alias("length"),
        *[F.count_if(inside & (F.col("relevance") >= t)).alias(f"hits_{i}") for i, t in enumerate(thresholds)],
    )
    relevant = judgments.groupBy(resume).agg(
        *[F.count_if(F.col("relevance") >= t).alias(f"relevant_{i}") for i, t in enumerate(thresholds)]
    )
    per_resume = lists.join(relevant, "resume_id")
    rows = []
    for i, t in enumerate(thresholds):
        hits, total = F.col(f"hits_{i}"), F.col(f"relevant_{i}")
        recall = F.when(total == 0, 1.0).otherwise(F.try_divide(hits, total))
        rows.append(
            F.struct(
                F.lit(float(t)).alias("threshold"),
                F.coalesce(F.avg(F.try_divide(hits, F.col("length"))), F.lit(0.0)).alias("precision"),
                F.coalesce(F.avg(recall), F.lit(0.0)).alias("recall"),
            )
        )
    p, r = F.col("precision"), F.col("recall")
    f1 = F.when(p + r > 0, 2 * (p * r) / (p + r)).otherwise(0.0)
    return per_resume.agg(F.array(*rows).alias("g")).select(F.inline("g")).withColumn("f1", f1)


def best_threshold(grid: DataFrame) -> DataFrame:
    """The threshold with the highest F1, the lowest one among equals; 1.0 if no F1 is above zero."""
    best = F.max_by(
        F.struct("threshold", "f1", "precision", "recall"), F.struct("f1", (-F.col("threshold")).alias("t"))
    )
    return grid.agg(best.alias("b")).select(
        F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(F.lit(RELEVANCE_THRESHOLD)).alias("threshold"),
        "b.f1",
        "b.precision",
        "b.recall",
    )


def sample_relevance(*parts: Column | str, seed: int = 0) -> Column:
    """Relevance 0-3 with shares .4/.3/.2/.1, drawn from a hash of the ids."""
    drawn = draw(seeded(seed, *parts), 10)
    upper, relevance = 0.0, None
    for value, share in SAMPLE_RELEVANCE:
        upper += share
        test = drawn < round(upper * 10)
        relevance = F.when(test, value) if relevance is None else relevance.when(test, value)
    return relevance.cast("double")


def sample_judgments(
    corpus: DataFrame,
    resumes: DataFrame,
    jobs_per_resume: int = 20,
    title: str = "title",
    ord: str = "ord",
    seed: int = 0,
) -> DataFrame:
    """Judgments of every resume for the first distinct titles, repeated while there are too few.

    Titles are ranked by first position; only ``jobs_per_resume`` of them are ever numbered.
    """
    first = (
        corpus.groupBy(title).agg(F.min(ord).alias("_first")).orderBy("_first", title).limit(jobs_per_resume)
    )
    numbered = first.select(
        F.col(title).alias("job_title"),
        (F.row_number().over(Window.orderBy("_first", title)) - 1).alias("_n"),
        F.count(F.lit(1)).over(Window.partitionBy()).alias("_total"),
    )
    jobs = numbered.select(
        "job_title",
        F.explode(F.sequence(F.col("_n").cast("int"), F.lit(jobs_per_resume - 1), F.col("_total").cast("int"))).alias("n"),
    )
    # Both sides of this equi-join are bounded by jobs_per_resume per resume.
    wanted = resumes.select(
        F.col("resume_id").cast("string").alias("resume_id"),
        F.explode(F.sequence(F.lit(0), F.lit(jobs_per_resume - 1))).alias("n"),
    )
    return wanted.join(F.broadcast(jobs), "n").select(
        "resume_id",
        F.concat(F.lit("job_"), F.col("n").cast("string")).alias("job_id"),
        "job_title",
        sample_relevance("resume_id", "n", seed=seed).alias("relevance"),
        F.col("n").alias("ord"),
    )
