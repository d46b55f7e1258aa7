"""Retrieval, classification and calibration metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.sources.shared import materialise


def retrieval_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """qid, mrr, and p, r, hit, ndcg at each k, from (qid, id, rank) hits and (qid, id) relevant rows.

    Precision divides by the number returned. Queries without relevant rows drop out.
    """
    n_rel = relevant.groupBy("qid").agg(F.count("*").alias("n_rel"))
    return _metrics(hits.join(relevant.select("qid", "id", F.lit(1).alias("rel")), ["qid", "id"], "left").withColumn("rel", F.coalesce("rel", F.lit(0))), n_rel, ks)


def retrieval_metrics_by_label(hits: DataFrame, queries: DataFrame, items: DataFrame, ks: tuple[int, ...] = (5, 10, 20)) -> DataFrame:
    """The same where the items of a query's label are its relevant ones: (qid, label) queries, (id, label) items.

    Labels are compared on the hits, and a label's relevant items only counted, so that no class is joined with itself.
    """
    n_rel = queries.join(items.groupBy("label").agg(F.count("*").alias("n_rel")), "label").select("qid", "n_rel")
    told = hits.join(queries.select("qid", F.col("label").alias("asked")), "qid").join(items.select("id", "label"), "id")
    return _metrics(told.withColumn("rel", (F.col("label") == F.col("asked")).cast("int")), n_rel, ks)


def _metrics(marked: DataFrame, n_rel: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    gain = F.col("rel") / F.log2(F.col("rank") + 1)
    sums = [F.coalesce(1.0 / F.min(F.when(F.col("rel") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr")]
    for k in ks:
        top = F.col("rank") <= k
        sums += [F.sum(F.when(top, F.col("rel")).otherwise(0)).alias(f"hits_{k}"), F.count_if(top).alias(f"n_{k}"), F.sum(F.when(top, gain).otherwise(0.0)).alias(f"dcg_{k}")]
    by = n_rel.join(marked.groupBy("qid").agg(*sums), "qid", "left").fillna(0)
    out = [F.round("mrr", 6).alias("mrr")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1.0 / F.log2(i + 1))
        out += [
            F.round(F.coalesce(F.try_divide(F.col(f"hits_{k}"), F.col(f"n_{k}")), F.lit(0.0)), 6).alias(f"p_{k}"), F.round(F.col(f"hits_{k}") / F.col("n_rel"), 6).alias(f"r_{k}"),
            (F.col(f"hits_{k}") > 0).cast("int").alias(f"hit_{k}"), F.round(F.col(f"dcg_{k}") / ideal, 6).alias(f"ndcg_{k}"),
        ]
    return by.select("qid", *out)


def mean_metrics(per_query: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: the mean of every metric, and the numbers of labelled and unlabelled queries."""
    names = [c for c in per_query.columns if c != "qid"]
    means = per_query.agg(*[F.round(F.avg(c), 6).alias(c) for c in names], F.count("*").alias("n_labelled"))
    return means.join(queries.agg(F.count("*").alias("n_queries"))).withColumn("n_unlabelled", F.col("n_queries") - F.col("n_labelled")).drop("n_queries")


def class_report(preds: DataFrame) -> DataFrame:
    """label, precision, recall, f1, support of (truth, pred) rows; divisions by zero are 0."""
    pairs = preds.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    truth = pairs.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("tp"))
    told = pairs.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("told"))
    rows = truth.join(told, "label", "full").fillna(0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("told")), ratio(F.col("tp"), F.col("support"))
    rows = rows.withColumn("precision", p).withColumn("recall", r)
    return rows.select("label", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6).alias("f1"), "support")


def accuracy(preds: DataFrame) -> DataFrame:
    """accuracy, macro_f1, n."""
    report = class_report(preds).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    return preds.agg(F.round(F.avg((F.col("truth") == F.col("pred")).cast("double")), 6).alias("accuracy"), F.count("*").alias("n")).join(report)


def confusion(preds: DataFrame) -> DataFrame:
    """truth, pred, share of the true class."""
    pairs = preds.groupBy("truth", "pred").agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("truth")), 6))


def expected_calibration_error(preds: DataFrame, bins: int = 15) -> DataFrame:
    """ece, n over bins (lo, hi] of conf."""
    right = (F.col("truth") == F.col("pred")).cast("double")
    per = preds.where("conf > 0").groupBy(F.ceil(F.col("conf") * bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(right).alias("acc"), F.avg("conf").alias("conf"))
    return per.agg(F.round(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))) / F.sum("n"), 6).alias("ece"), F.sum("n").cast("long").alias("n"))


def reliability(preds: DataFrame, bins: int = 10) -> DataFrame:
    """centre, n, acc, conf over bins [lo, hi); empty bins stay, and conf = 1 falls out."""
    right = (F.col("truth") == F.col("pred")).cast("double")
    per = preds.where("conf < 1").groupBy(F.floor(F.col("conf") * bins).cast("long").alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(right), 6).alias("acc"), F.round(F.avg("conf"), 6).alias("conf"))
    every = preds.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(per, "bin", "left").select(F.round((F.col("bin") + 0.5) / bins, 6).alias("centre"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "acc", "conf")


def threshold_sweep(preds: DataFrame, steps: tuple[float, ...] = tuple(round(0.10 + 0.05 * i, 2) for i in range(18))) -> DataFrame:
    """threshold, coverage, accuracy, macro_f1 of the rows with conf >= threshold; zeros where none are left.

    Rows are first counted by (truth, pred, number of thresholds reached), which bounds what meets the grid.
    """
    reach = sum(((F.col("conf") >= t).cast("int") for t in steps), F.lit(0))
    cells = preds.groupBy("truth", "pred", reach.alias("reach")).agg(F.count("*").alias("n"))
    grid = preds.sparkSession.createDataFrame([(float(t), i + 1) for i, t in enumerate(steps)], "threshold double, need int")
    kept = cells.join(F.broadcast(grid), F.col("reach") >= F.col("need")).groupBy("threshold", "truth", "pred").agg(F.sum("n").alias("n"))
    labels = F.explode(F.array_distinct(F.array("truth", "pred")))
    per = kept.select("threshold", "truth", "pred", "n", labels.alias("label")).groupBy("threshold", "label").agg(
        F.sum(F.when((F.col("truth") == F.col("label")) & (F.col("pred") == F.col("label")), F.col("n")).otherwise(0)).alias("tp"),
        F.sum(F.when(F.col("truth") == F.col("label"), F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)).alias("p"),
    )
    f1 = per.groupBy("threshold").agg(F.avg(2.0 * F.col("tp") / (F.col("t") + F.col("p"))).alias("macro_f1"))
    acc = kept.groupBy("threshold").agg(F.sum("n").alias("kept"), F.sum(F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)).alias("right"))
    out = grid.select("threshold").join(acc, "threshold", "left").join(f1, "threshold", "left").join(preds.agg(F.count("*").alias("total")))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return out.select("threshold", zero(F.try_divide("kept", "total")).alias("coverage"), zero(F.try_divide("right", "kept")).alias("accuracy"), zero(F.col("macro_f1")).alias("macro_f1"))


def best_threshold(sweep: DataFrame, coverage: float = 0.70) -> DataFrame:
    """The row with the best (macro_f1, accuracy) of those with enough coverage, or of all if none has; ties to the smaller threshold."""
    enough = (F.col("coverage") >= coverage).cast("int")
    return sweep.orderBy(F.desc(enough), F.desc("macro_f1"), F.desc("accuracy"), "threshold").limit(1)


def quantiles(rows: DataFrame, value: str, share: float, group: str | None = None, bins: int = 1024, most: int = 10_000) -> DataFrame:
    """group (or none), quantile: the exact quantile with linear interpolation of the finite values of each group.

    Each pass counts the values of the range that still holds the wanted places in ``bins`` bins and goes on in the bin that holds
    one; a range of at most ``most`` values is ranked. No task sees more than the counts of a range, or such a range, of a group.
    """
    data = rows.select((F.col(group) if group else F.lit(0)).alias("g"), F.col(value).cast("double").alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    place = (F.col("n") - 1) * F.lit(float(share))
    wanted = F.array(*[F.struct(F.lit(i).alias("which"), f(place).cast("long").alias("at")) for i, f in enumerate((F.floor, F.ceil))])
    sizes = data.groupBy("g").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    state = materialise(sizes.select("g", (place - F.floor(place)).alias("part"), F.inline(wanted), "lo", "hi", "n"), "quantile")
    names = state.columns
    inside = lambda ranges: data.join(ranges.withColumnRenamed("g", "_g"), F.col("g").eqNullSafe(F.col("_g")) & F.col("x").between(F.col("lo"), F.col("hi"))).drop("_g")
    while True:
        wide = (F.col("lo") < F.col("hi")) & (F.col("n") > most)
        if state.where(wide).isEmpty():
            break
        bin_ = F.least(F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1).cast("long"))
        cells = inside(state.where(wide)).groupBy("g", "part", "which", "at", bin_.alias("bin")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
        before = F.coalesce(F.sum("n").over(W.partitionBy("g", "which").orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))  # a group's bins
        held = cells.withColumn("before", before).where("at >= before and at < before + n").withColumn("at", F.col("at") - F.col("before"))
        state = materialise(state.where(~wide).unionByName(held.select(*names)), "quantile")
    ranked = inside(state.where("lo < hi")).withColumn("_r", F.row_number().over(W.partitionBy("g", "which").orderBy("x")) - 1).where("_r = at")
    found = state.where("lo = hi").select("g", "part", "which", F.col("lo").alias("x")).unionByName(ranked.select("g", "part", "which", "x"))
    lower, upper = (F.max(F.when(F.col("which") == i, F.col("x"))) for i in (0, 1))
    out = found.groupBy("g").agg((lower + F.max("part") * (upper - lower)).alias("quantile"))
    return out.withColumnRenamed("g", group) if group else out.drop("g")


def confidence_stats(preds: DataFrame, group: str | None = None, share: float = 0.95) -> DataFrame:
    """Mean, population deviation, extremes and exact percentile of conf."""
    grouped = preds.groupBy(group) if group else preds.groupBy()
    r = lambda c, name: F.round(c, 6).alias(name)
    stats = grouped.agg(r(F.avg("conf"), "mean"), r(F.stddev_pop("conf"), "std"), r(F.min("conf"), "least"), r(F.max("conf"), "most"), F.count("*").alias("n"))
    found = quantiles(preds, "conf", share, group).withColumn("percentile", F.round("quantile", 6)).drop("quantile")
    if not group:
        return stats.join(found, how="left")
    return stats.join(found.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")


def class_counts(rows: DataFrame, label: str) -> DataFrame:
    return rows.groupBy(label).agg(F.count("*").alias("n")).orderBy(F.desc("n"), label)


def described(rows: DataFrame, label: str, value: str) -> DataFrame:
    """label, n, mean, std (of a sample), least, p25, p50, p75, most of a value for each class; percentiles are exact."""
    r = lambda c, name: F.round(c, 6).alias(name)
    out = rows.groupBy(label).agg(F.count(value).alias("n"), r(F.avg(value), "mean"), r(F.stddev_samp(value), "std"), r(F.min(value), "least"), r(F.max(value), "most"))
    for share in (25, 50, 75):
        found = quantiles(rows, value, share / 100, label).select(F.col(label).alias("_g"), r(F.col("quantile"), f"p{share}"))
        out = out.join(found, F.col(label).eqNullSafe(F.col("_g")), "left").drop("_g")
    return out


def best_positive_ranks(ranks: DataFrame) -> DataFrame:
    """r_1, r_3, r_5, mrr, n, n_missing of (id, rank) rows, as ``vectors.own_label`` gives them; rank null where the positive label is missing."""
    at = lambda k: F.round(F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0))), 6).alias(f"r_{k}")
    return ranks.agg(at(1), at(3), at(5), F.round(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("n"), F.count_if(F.col("rank").isNull()).alias("n_missing"))


def margin_summary(margins: DataFrame) -> DataFrame:
    r = lambda c, name: F.round(c, 6).alias(name)
    found = quantiles(margins, "margin", 0.1).select(r(F.col("quantile"), "p10"))
    return margins.agg(r(F.avg((F.col("margin") > 0).cast("double")), "pass_rate"), r(F.avg("margin"), "mean"), F.count("*").alias("n")).join(found, how="left")


def consistency_summary(per_item: DataFrame, share: float = 0.9) -> DataFrame:
    """mean_std and the exact percentile p_std of the deviations of (id, std) rows, with their number."""
    found = quantiles(per_item, "std", share).select(F.round("quantile", 6).alias("p_std"))
    return per_item.agg(F.round(F.avg("std"), 6).alias("mean_std"), F.count("*").alias("n")).join(found, how="left")


def stability(variants: DataFrame, base: DataFrame, cosine: Column) -> DataFrame:
    """id, least, mean, agreement: (id, vec, label) variants against (id, base_vec, base_label)."""
    rows = variants.join(base, "id").select("id", cosine.alias("cos"), (F.col("label") == F.col("base_label")).cast("double").alias("same"))
    return rows.groupBy("id").agg(F.round(F.min("cos"), 6).alias("least"), F.round(F.avg("cos"), 6).alias("mean"), F.round(F.avg("same"), 6).alias("agreement"))


def scorecard(metrics: DataFrame) -> DataFrame:
    """(metric, value, target, direction) -> also passed, and n_pass over all gates."""
    passed = F.when(F.col("direction") == ">=", F.col("value") >= F.col("target")).otherwise(F.col("value") <= F.col("target"))
    return metrics.withColumn("passed", passed).withColumn("n_pass", F.count_if("passed").over(W.partitionBy()))


def fit_temperature(logits: DataFrame, lo: float = 0.05, hi: float = 10.0, points: int = 60) -> DataFrame:
    """temperature, nll: the T of a grid, then of a finer grid around it, that minimises the mean negative log likelihood.

    (truth, l0, l1) rows are first counted by value; each pass is one aggregation with a column a grid point.
    """
    cells = logits.groupBy("truth", "l0", "l1").agg(F.count("*").alias("n"))

    def best(grid: list[float]) -> tuple[float, float]:
        def nll(t: float) -> Column:
            a, b = F.col("l0") / t, F.col("l1") / t
            m = F.greatest(a, b)
            own = F.when(F.col("truth") == 1, b).otherwise(a)
            return F.sum(F.col("n") * (m + F.log(F.exp(a - m) + F.exp(b - m)) - own)) / F.sum("n")

        row = cells.agg(*[nll(t).alias(f"t{i}") for i, t in enumerate(grid)]).first()
        return min((v, t) for v, t in zip(row, grid, strict=True) if v is not None)[::-1] if row[0] is not None else (1.0, 0.0)

    step = (hi / lo) ** (1 / (points - 1))
    first, _ = best([lo * step**i for i in range(points)])
    fine, value = best([first * step ** (i / points) for i in range(-points, points + 1)])
    return logits.sparkSession.createDataFrame([(fine, value)], "temperature double, nll double").select(F.round("temperature", 4).alias("temperature"), F.round("nll", 6).alias("nll"))
