"""Ranking and classification metrics from grouped counts.

Windows run over distinct scores (after aggregation), or within a slice, not over raw rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.operators.tables import durable

#: Rows of a table of ranges that a join may broadcast.
MOST_RANGES = 100_000


def running(df: DataFrame, by: list[str], p: str, sums: dict[str, str], parts: int | None = None) -> DataFrame:
    """df plus running and total sums (``sums``: column -> name; total_<name> too) from the largest ``p`` down, by group.

    ``p`` must be distinct within a group.  Rows are cut into ranges of p by approximate
    quantiles, ranges are summed first, and windows run within a range only: the result
    is exact whatever the cuts, and no group passes through one task.  The input is
    checkpointed, as it is read three times and may come from a model or a long plan;
    ``parts`` follows from its size (about 50,000 rows each).
    """
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"__k{i}") for i, c in enumerate(by)] or [F.lit("").alias("__k0")]
    names = [f"__k{i}" for i in range(len(keys))]
    df = durable(df.select("*", *keys))
    parts = parts or min(1000, max(8, df.count() // 50_000))
    few = lambda ranges: F.broadcast(ranges) if ranges.count() <= MOST_RANGES else ranges
    edges = df.groupBy(*names).agg(F.percentile_approx(p, [i / parts for i in range(1, parts)], 1000).alias("__edges"))
    placed = df.join(few(durable(edges)), names).withColumn("__part", F.size(F.filter("__edges", lambda e: e > F.col(p)))).drop("__edges")
    whole = Window.partitionBy(*names)
    ranges = placed.groupBy(*names, "__part").agg(*[F.sum(c).alias(f"__s_{n}") for c, n in sums.items()])  # at most ``parts`` a group
    ahead = [(F.sum(f"__s_{n}").over(whole.orderBy("__part")) - F.col(f"__s_{n}")).alias(f"__b_{n}") for n in sums.values()]
    ranges = ranges.select(*names, "__part", *ahead, *[F.sum(f"__s_{n}").over(whole).alias(f"total_{n}") for n in sums.values()])
    down = Window.partitionBy(*names, "__part").orderBy(F.desc(p))
    out = placed.join(few(durable(ranges)), [*names, "__part"])
    return out.withColumns({n: F.sum(c).over(down) + F.col(f"__b_{n}") for c, n in sums.items()}).drop(*names, "__part", *[f"__b_{n}" for n in sums.values()])


def curve(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """One row per distinct score of each group: cumulative positives and rows from the top, and totals."""
    steps = df.groupBy(*by, p).agg(F.count("*").alias("n"), F.sum(y).cast("long").alias("pos"))
    out = running(steps, by, p, {"n": "cum_n", "pos": "cum_pos"})
    return out.select(*by, p, "n", "pos", "cum_n", "cum_pos", F.col("total_cum_n").alias("total"), F.col("total_cum_pos").alias("positives"))


def ranking_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Average precision (ties as one step) and ROC-AUC (ties half); AUC is null for a single class."""
    c = curve(df, by, y, p)
    neg = F.col("total") - F.col("positives")
    below = (F.col("total") - F.col("cum_n")) - (F.col("positives") - F.col("cum_pos"))
    wins = F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2)
    return c.groupBy(*by).agg(
        F.round(F.sum(F.try_divide(F.col("pos"), F.col("positives")) * F.col("cum_pos") / F.col("cum_n")), 6).alias("average_precision"),
        F.round(F.try_divide(F.sum(wins), F.max(F.col("positives") * neg)), 6).alias("roc_auc"),
    )


def slice_report(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """threshold_metrics plus average precision and AUC; a group with a single class has its accuracy only."""
    both = threshold_metrics(df, by, y, p).join(ranking_metrics(df, by, y, p), by)
    mixed = (F.col("positives") > 0) & (F.col("positives") < F.col("n"))
    always = (*by, "n", "positives", "accuracy", "positive_rate")
    return both.select(*[F.col(c) if c in always else F.when(mixed, F.col(c)).alias(c) for c in both.columns])


def threshold_metrics(df: DataFrame, by: list[str], y: str = "y", p: str = "p", at: float = 0.5) -> DataFrame:
    """Counts, accuracy, precision, recall, F1 (0 where undefined), Brier score and positive rate."""
    hit, true = F.col(p) >= at, F.col(y) == 1
    tp, fp, fn = F.count_if(hit & true), F.count_if(hit & ~true), F.count_if(~hit & true)
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(y).cast("long").alias("positives"), zero(F.avg((hit == true).cast("double"))).alias("accuracy"),
        zero(F.try_divide(tp, tp + fp)).alias("precision"), zero(F.try_divide(tp, tp + fn)).alias("recall"),
        zero(F.try_divide(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        F.round(F.avg(F.pow(F.col(p) - F.col(y), 2)), 6).alias("brier"), F.round(F.avg(y), 6).alias("positive_rate"),
    )


def top_k(df: DataFrame, ks: list[int], y: str = "y", p: str = "p", key: str = "doc_id") -> DataFrame:
    """precision and recall at k, k cut to the number of rows; the top rows come from a bounded sort, ties by key."""
    totals = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(y), F.lit(0)).cast("long").alias("positives"))
    head = df.select(y, p, key).orderBy(F.desc(p), key).limit(max(ks))
    ranked = head.withColumn("place", F.row_number().over(Window.orderBy(F.desc(p), key)))
    hits = ranked.agg(*[F.coalesce(F.sum(F.when(F.col("place") <= k, F.col(y))), F.lit(0)).cast("long").alias(f"h{k}") for k in ks])
    one = F.lit(1).alias("one")
    both = hits.withColumn("one", one).join(totals.withColumn("one", one), "one")
    rows = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"h{k}").alias("hits")) for k in ks])
    return both.select("n", "positives", F.explode(rows).alias("r")).select(
        "r.k", "r.hits",
        F.round(F.try_divide(F.col("r.hits"), F.least(F.col("n"), F.col("r.k"))), 6).alias("precision_at_k"),
        F.round(F.coalesce(F.try_divide(F.col("r.hits"), F.col("positives")), F.lit(0.0)), 6).alias("recall_at_k"),
    )


def baselines(features: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, stream and p: scores by CVSS, by EPSS, and by KEV with CVSS below it."""
    cvss = F.col("cvss_base_score")
    scores = {"cvss": cvss / 10, "epss": F.col("epss_score"), "kev": F.col("kev_flag") + cvss / 100}
    rows = F.array(*[F.struct(F.lit(n).alias("stream"), p.alias("p")) for n, p in scores.items()])
    return features.select(*keep, F.explode(rows).alias("r")).select(*keep, "r.stream", "r.p")


def clipped_brier(df: DataFrame, by: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Brier score of scores that may leave 0 to 1, which are cut to it."""
    inside = F.least(F.greatest(F.col(p), F.lit(0.0)), F.lit(1.0))
    return df.groupBy(*by).agg(F.round(F.avg(F.pow(inside - F.col(y), 2)), 6).alias("brier"))


def rank_fusion(df: DataFrame, streams: list[str], key: str = "doc_id", k: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (k + rank), rank counted over distinct scores' cumulative sizes (null scores have none)."""
    out = df.select(key, *streams)
    for s in streams:
        steps = running(df.where(F.col(s).isNotNull()).groupBy(s).agg(F.count("*").alias("n")), [], s, {"n": "upto"})
        ranks = steps.select(F.col(s).alias("__s"), (F.col("upto") - F.col("n") + 1).alias(f"rank_{s}"))
        out = out.join(ranks, F.col(s).eqNullSafe(F.col("__s")), "left").drop("__s")
    total = reduce(lambda a, b: a + b, (1.0 / (k + F.col(f"rank_{s}")) for s in streams))
    return out.select(key, *[f"rank_{s}" for s in streams], F.round(total, 8).alias("fused"))


def percentiles(df: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by and percentiles: for each share the exact percentile of the values that are not null, interpolated between neighbours.

    Equal values are counted first; the two places that a share lies between are then
    found by running counts over ranges of values, so no group's values meet in one buffer.
    """
    steps = df.where(F.col(value).isNotNull()).groupBy(*by, (-F.col(value)).alias("__v")).agg(F.count("*").alias("n"))
    upto = running(steps, by, "__v", {"n": "upto"})
    found = []
    for i, share in enumerate(shares):
        at = F.lit(share) * (F.col("total_upto") - 1)
        for name, place in (("low", F.floor(at)), ("high", F.ceil(at))):
            found.append(F.min(F.when(F.col("upto") > place, -F.col("__v"))).alias(f"{name}{i}"))
    out = upto.groupBy(*by).agg(F.max("total_upto").alias("__n"), *found)

    def between(i: int, share: float) -> Column:
        at = F.lit(share) * (F.col("__n") - 1)
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        return F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)

    return out.select(*by, F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("percentiles"))


def calibration(df: DataFrame, bins: int = 5, y: str = "y", p: str = "p") -> DataFrame:
    """Uniform bins: mean score and observed rate of each bin that has rows."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int")
    return df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_score"), F.round(F.avg(y), 6).alias("observed"))


def quantile_calibration(df: DataFrame, bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Bins by the scores' quantile edges (a value on an edge belongs to the bin above it), empty bins dropped."""
    edges = percentiles(df, [], p, [i / bins for i in range(1, bins)]).select(F.col("percentiles").alias("e"), F.lit(1).alias("one"))  # one row
    place = F.size(F.filter(F.array_distinct("e"), lambda e: e <= F.col(p)))
    return (
        df.withColumn("one", F.lit(1)).join(F.broadcast(edges), "one").groupBy(place.alias("bin"))
        .agg(F.count("*").alias("n"), F.round(F.avg(p), 6).alias("mean_score"), F.round(F.avg(y), 6).alias("observed"))
    )


def confusion(df: DataFrame, labels: tuple[str, ...], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """A row per true label and a column per predicted one, zero-filled; unknown labels are ignored."""
    fixed = df.sparkSession.createDataFrame([(x,) for x in labels], f"{true} string")
    counts = df.groupBy(true).agg(*[F.count_if(F.col(pred) == x).alias(x) for x in labels])
    return fixed.join(counts, true, "left").select(true, *[F.coalesce(x, F.lit(0)).alias(x) for x in labels])


def multiclass(df: DataFrame, labels: tuple[str, ...], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """precision, recall, F1 and support by class, in one pass."""
    out = df.agg(*[f(F.col(true), F.col(pred), x).alias(f"{n}_{x}") for x in labels for n, f in (("tp", _tp), ("p", _p), ("t", _t))])
    rows = F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"tp_{x}").alias("tp"), F.col(f"p_{x}").alias("p"), F.col(f"t_{x}").alias("t")) for x in labels])
    tp, p, t = F.col("r.tp"), F.col("r.p"), F.col("r.t")
    precision, recall = F.coalesce(F.try_divide(tp, p), F.lit(0.0)), F.coalesce(F.try_divide(tp, t), F.lit(0.0))
    f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-8))
    return out.select(F.explode(rows).alias("r")).select("r.label", F.round(precision, 6).alias("precision"), F.round(recall, 6).alias("recall"), F.round(f1, 6).alias("f1"), t.alias("support"))


def _tp(t: Column, p: Column, x: str) -> Column:
    return F.count_if((t == x) & (p == x))


def _p(t: Column, p: Column, x: str) -> Column:
    return F.count_if(p == x)


def _t(t: Column, p: Column, x: str) -> Column:
    return F.count_if(t == x)


def triage_shift(df: DataFrame, labels: tuple[str, ...], true: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """Accuracy and the shares of rows triaged above and below their true urgency (unknown actions count as the middle)."""
    place = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, labels)), F.col(c)), F.lit(0)), F.lit(3))
    n = F.count("*")
    return df.agg(
        n.alias("n"), F.round(F.count_if(F.col(true) == F.col(pred)) / n, 6).alias("accuracy"),
        F.round(F.count_if(place(pred) < place(true)) / n, 6).alias("over_triage"), F.round(F.count_if(place(pred) > place(true)) / n, 6).alias("under_triage"),
    )


def meta_features(df: DataFrame, streams: list[str]) -> DataFrame:
    """Stacking inputs: streams by name, maximum, mean, population deviation and all pairwise products."""
    names = sorted(streams)
    cols = [F.col(n) for n in names]
    mean = reduce(lambda a, b: a + b, cols) / len(cols)
    var = reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in cols]) / len(cols)
    products = [F.round(F.col(a) * F.col(b), 8).alias(f"{a}_x_{b}") for i, a in enumerate(names) for b in names[i + 1 :]]
    others = [c for c in df.columns if c not in names]
    return df.select(*others, *names, F.greatest(*cols).alias("p_max"), F.round(mean, 8).alias("p_mean"), F.round(F.sqrt(var), 8).alias("p_std"), *products)
