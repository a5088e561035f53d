"""Label support, group summaries, shared positions and similarity tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from prismal.functions import arrays as A
from prismal.operators import vectors as V
from prismal.operators.quantiles import quantiles


def label_support(df: DataFrame, labels: list[str], usable: Column | None = None, min_support: int = 100) -> DataFrame:
    """Per 0/1 label column: total, usable, fraction, status (unused, NO SUPPORT, thin or ok).

    A null label counts as 0.  All labels come from one pass.
    """
    ok = F.coalesce(usable, F.lit(False)) if usable is not None else F.lit(True)
    on = lambda c: F.coalesce(F.col(c), F.lit(0)) > 0
    one = df.agg(F.count("*").alias("_n"), *[F.count_if(on(c)).alias(f"{c}_t") for c in labels], *[F.count_if(on(c) & ok).alias(f"{c}_u") for c in labels])
    rows = one.select("_n", F.explode(F.array(*(F.struct(F.lit(c).alias("label"), F.col(f"{c}_t").alias("total"), F.col(f"{c}_u").alias("usable")) for c in labels))).alias("s"))
    status = F.when(F.col("s.total") == 0, "unused").when(F.col("s.usable") == 0, "NO SUPPORT").when(F.col("s.usable") < min_support, "thin").otherwise("ok")
    return rows.select("s.label", "s.total", "s.usable", F.try_divide("s.total", "_n").alias("fraction"), status.alias("status"))


def histogram_overlap(df: DataFrame, value: str, group: str, lo: float, width: float) -> DataFrame:
    """Sum of smaller bin shares for every pair of groups: ``a, b, overlap`` with a < b. Works on one row a group and bin."""
    h = df.filter(F.col(value).isNotNull()).groupBy(F.col(group).alias("g"), F.floor((F.col(value) - lo) / width).alias("bin")).count()
    h = h.withColumn("p", F.col("count") / F.sum("count").over(W.partitionBy("g")))
    a, b = h.select(F.col("g").alias("a"), "bin", F.col("p").alias("pa")), h.select(F.col("g").alias("b"), "bin", F.col("p").alias("pb"))
    groups = h.select("g").distinct()
    pairs = groups.select(F.col("g").alias("a")).join(groups.select(F.col("g").alias("b")), F.col("a") < F.col("b"))
    both = a.join(b, "bin").filter(F.col("a") < F.col("b")).groupBy("a", "b").agg(F.sum(F.least("pa", "pb")).alias("overlap"))
    return pairs.join(both, ["a", "b"], "left").fillna(0.0, ["overlap"])


def spread(df: DataFrame, value: str, by, name: str | None = None) -> DataFrame:
    """Count, median, quartile range, 10th and 90th percentile, least and greatest of a value per key."""
    n, by = name or value, [by] if isinstance(by, str) else by
    # one row a distinct value, weighted by its repeats
    levels = df.groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_k"))
    q = F.percentile("_v", F.array(*(F.lit(x) for x in (0.1, 0.25, 0.5, 0.75, 0.9))), F.col("_k"))
    out = levels.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("_v").isNotNull(), F.col("_k"))), F.lit(0)).alias("n"), F.min("_v").alias(f"{n}_min"), F.max("_v").alias(f"{n}_max"), q.alias("_q"))
    return out.select(*by, "n", f"{n}_min", f"{n}_max", *(F.get("_q", F.lit(i)).alias(f"{n}_{k}") for i, k in ((0, "p10"), (2, "median"), (4, "p90"))), (F.get("_q", F.lit(3)) - F.get("_q", F.lit(1))).alias(f"{n}_iqr")).drop("_q")


def text_stats(df: DataFrame, peaks: str, by: str, low_share: float = 0.2, position: float = 900.0) -> DataFrame:
    """Per key: peak counts, intensities, widths, shares of weak and of low-positioned peaks, and the strongest peak's place."""
    n = F.size(peaks)
    strongest = F.array_min(F.transform(peaks, lambda p, i: F.struct((-p["intensity"]).alias("k"), i.alias("i"), p["position"].alias("pos"))))
    rows = df.select(by, n.alias("n"), F.col(peaks).alias("p"), strongest["pos"].alias("top"))
    counts = rows.groupBy(by).agg(F.count("*").alias("records"), F.percentile("n", F.lit(0.5)).alias("peaks_median"), F.percentile("n", F.lit(0.1)).alias("peaks_p10"), F.percentile("n", F.lit(0.9)).alias("peaks_p90"), F.percentile("top", F.lit(0.5)).alias("strongest_median"))
    each = rows.select(by, F.explode("p").alias("p")).groupBy(by).agg(
        F.percentile("p.intensity", F.lit(0.5)).alias("intensity_median"), F.avg((F.col("p.intensity") < low_share).cast("double")).alias("weak_share"),
        F.percentile("p.width", F.lit(0.5)).alias("fwhm_median"), F.percentile("p.width", F.lit(0.1)).alias("fwhm_p10"), F.percentile("p.width", F.lit(0.9)).alias("fwhm_p90"),
        F.avg((F.col("p.position") < position).cast("double")).alias("low_share"))
    return counts.join(each, by, "left")


def gap_clusters(df: DataFrame, value: str, tol: float, by=None) -> DataFrame:
    """``*by, cluster, lo, hi, median, n``: sorted values cut where the gap to the last exceeds ``tol``.

    Distinct values are clustered in cells of a thousand tolerances and the cells
    are then put in order, so no task orders all values of a key; repeats count
    in ``n`` and the median.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    levels = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("k"))
    levels = levels.withColumn("_cell", F.floor(F.col("v") / (1000 * tol)) if tol > 0 else F.col("v"))
    w = W.partitionBy(*by, "_cell").orderBy("v")
    gap = F.coalesce((F.col("v") - F.lag("v").over(w) > tol).cast("int"), F.lit(0))
    rows = levels.withColumn("_new", gap).withColumn("_in", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    # a cell's first value may begin a cluster, too
    cells = rows.groupBy(*by, "_cell").agg(F.min("v").alias("_lo"), F.max("v").alias("_hi"), F.max("_in").alias("_more"))
    in_order = W.partitionBy(*by).orderBy("_cell")
    cells = cells.withColumn("_apart", F.coalesce((F.col("_lo") - F.lag("_hi").over(in_order) > tol).cast("int"), F.lit(0)))
    cells = cells.withColumn("_base", F.sum(F.col("_apart") + F.col("_more")).over(in_order.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("_more"))
    cells = cells.select(*(F.col(c).alias(f"_by{i}") for i, c in enumerate(by)), F.col("_cell").alias("_at"), "_base")
    same = F.col("_cell") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    c = rows.join(cells, same).withColumn("cluster", F.col("_base") + F.col("_in"))
    return c.groupBy(*by, "cluster").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.percentile("v", F.lit(0.5), F.col("k")).alias("median"), F.sum("k").alias("n"))


def shared_positions(df: DataFrame, position: str, analyte: str, tol: float = 5.0, min_share: float = 0.5) -> DataFrame:
    """Cluster medians with at least ``min_share`` of the analytes within ``tol``: ``median, share``; none for fewer than three analytes."""
    clusters = gap_clusters(df, position, tol).select("median")
    # positions in cells of tol: a match is in the same or a neighbouring cell
    cell = lambda c: F.floor(c / tol)
    near = df.select(F.col(position).alias("p"), F.col(analyte).alias("a"), cell(F.col(position)).alias("cell")).distinct()
    probe = clusters.withColumn("cell", F.explode(F.array(*(cell(F.col("median")) + d for d in (-1, 0, 1)))))
    hits = probe.join(near, "cell").filter(F.abs(F.col("p") - F.col("median")) <= tol).groupBy("median").agg(F.countDistinct("a").alias("k"))
    n = df.agg(F.countDistinct(analyte).alias("n"))
    return hits.crossJoin(F.broadcast(n)).filter((F.col("n") >= 3) & (F.col("k") >= min_share * F.col("n"))).select("median", (F.col("k") / F.col("n")).alias("share"))


def similarity_table(df: DataFrame, vector: str, side: str, left: str, right: str, key: str) -> DataFrame:
    """Cosines of mean vectors between two sides over their common keys: ``key_a, key_b, sim, rank, same``.

    Rank is 1 plus the number of right keys closer to the left key.
    """
    means = V.mean_vectors(df.filter(F.col(side).isin(left, right)), vector, [side, key]).select(side, key, A.unit(F.col("mean")).alias("u"))
    a, b = means.filter(F.col(side) == left), means.filter(F.col(side) == right)
    common = a.select(key).intersect(b.select(key))
    a = a.join(common, key, "left_semi").select(F.col(key).alias("key_a"), F.col("u").alias("ua"))
    b = b.join(common, key, "left_semi").select(F.col(key).alias("key_b"), F.col("u").alias("ub"))
    # one mean vector a key on both sides: the table asked for is all pairs of keys
    sims = a.crossJoin(b).select("key_a", "key_b", A.dot(F.col("ua"), F.col("ub")).alias("sim"))
    return sims.withColumn("rank", F.rank().over(W.partitionBy("key_a").orderBy(F.desc(F.round("sim", 9))))).withColumn("same", F.col("key_a") == F.col("key_b"))


def similarity_summary(table: DataFrame, by=None) -> DataFrame:
    """Mean cosine, median rank, and shares at rank 1 and within 3, of the pairs with equal keys."""
    by = [by] if isinstance(by, str) else list(by or [])
    own = table.filter("same")
    agg = (F.count("*").alias("n"), F.avg("sim").alias("mean_cosine"), F.percentile("rank", F.lit(0.5)).alias("median_rank"), F.avg((F.col("rank") <= 1).cast("double")).alias("top1"), F.avg((F.col("rank") <= 3).cast("double")).alias("top3"))
    return own.groupBy(*by).agg(*agg) if by else own.agg(*agg)


def nearest_by_jaccard(small: DataFrame, large: DataFrame, items: str, id_col: str, threshold: float = 0.5) -> DataFrame:
    """For each row of ``small`` its nearest set in ``large`` and the number at or over the threshold: ``id, nearest, sim, n_over``.

    Joined through shared items, so rows without one in common never meet.
    """
    a = small.select(F.col(id_col).alias("id"), F.array_distinct(items).alias("a"))
    b = large.select(F.col(id_col).alias("other"), F.array_distinct(items).alias("b"))
    common = a.select("id", F.size("a").alias("na"), F.explode("a").alias("x")).join(b.select("other", F.size("b").alias("nb"), F.explode("b").alias("x")), "x")
    sim = common.groupBy("id", "other", "na", "nb").agg(F.count("*").alias("k")).withColumn("sim", F.col("k") / (F.col("na") + F.col("nb") - F.col("k")))
    best = sim.groupBy("id").agg(F.min(F.struct((-F.col("sim")).alias("s"), "other")).alias("m"), F.count_if(F.col("sim") >= threshold).alias("n_over"))
    return a.select("id").join(best, "id", "left").select("id", F.col("m.other").alias("nearest"), (-F.col("m.s")).alias("sim"), F.coalesce("n_over", F.lit(0)).alias("n_over"))


def domain_reason(flags: dict[str, Column]) -> Column:
    """Why a row is out of domain: the names of the flags that hold."""
    return F.concat_ws("; ", *(F.when(c, F.lit(k)) for k, c in flags.items()))


def consensus(rows: DataFrame, vector: str, id_col: str, min_corr: float = 0.9, by=None) -> DataFrame:
    """A row ``*by, mean, p90, n, n_all`` of vectors whose correlation with the element-wise median is at least ``min_corr``.

    All rows of a key are used when fewer than three exist; fewer than half or than three left raises.
    """
    by = [by] if isinstance(by, str) else list(by or [])
    long = V.explode_vector(rows, vector, [*by, id_col])
    mid = quantiles(long, "v", [*by, "k"], (0.5,)).select(*by, "k", F.get("q", F.lit(0)).alias("m"))
    r = long.join(mid, [*by, "k"]).groupBy(*by, id_col).agg(A.correlation("v", "m").alias("r"))
    n = rows.select(*by, id_col).distinct().groupBy(*by).agg(F.count("*").alias("n_all"))
    joined = lambda df: df.join(F.broadcast(n), by) if by else df.crossJoin(F.broadcast(n))
    kept = joined(r).filter((F.col("n_all") < 3) | (F.col("r") >= min_corr))
    good = long.join(kept.select(*by, id_col), [*by, id_col])
    high = quantiles(good, "v", [*by, "k"], (0.9,)).select(*by, "k", F.get("q", F.lit(0)).alias("p90"))
    per = good.groupBy(*by, "k").agg(F.avg("v").alias("mean"), F.countDistinct(id_col).alias("n")).join(high, [*by, "k"])
    every = joined(per.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("k", "mean", "p90"))).alias("_p"), F.coalesce(F.max("n"), F.lit(0)).alias("n")))
    out = every.select(*by, F.transform("_p", lambda s: s["mean"]).alias("mean"), F.transform("_p", lambda s: s["p90"]).alias("p90"), "n", "n_all")
    few = (F.col("n_all") >= 3) & (F.col("n") < F.greatest(F.lit(3.0), F.col("n_all") * 0.5))
    return out.filter(F.when(few, F.raise_error(F.lit("too few rows agree with the median")).cast("boolean")).otherwise(True))
