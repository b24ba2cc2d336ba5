"""Comparing two labelled groups feature by feature, over the long table ``(doc_id, label, source, feature, value)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstat.functions.numbers import normal_tail
from inkstat.operators.blocks import feature_group

HUMAN, AI = "human", "ai"


def _h(c: str) -> Column:
    return F.when(F.col("label") == HUMAN, F.col(c))


def _a(c: str) -> Column:
    return F.when(F.col("label") == AI, F.col(c))


def pooled_d(n1: Column, m1: Column, v1: Column, n2: Column, m2: Column, v2: Column) -> Column:
    """Standardised difference, second minus first; 0 with fewer than two values on a side or no spread."""
    pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / F.nullif(n1 + n2 - 2, F.lit(0)))
    return F.when((n1 >= 2) & (n2 >= 2) & (pooled > 0), (m2 - m1) / pooled).otherwise(0.0)


def cohens_d(long: DataFrame, *by: str) -> DataFrame:
    """``(feature, n_human, n_ai, human_mean, ai_mean, cohens_d)``; one aggregation, combined before the shuffle."""
    keys = ["feature", *by]
    g = long.filter("value IS NOT NULL").groupBy(*keys).agg(
        F.count(_h("value")).alias("n_human"), F.count(_a("value")).alias("n_ai"), F.avg(_h("value")).alias("human_mean"), F.avg(_a("value")).alias("ai_mean"),
        F.var_samp(_h("value")).alias("vh"), F.var_samp(_a("value")).alias("va"),
    )
    d = pooled_d(F.col("n_human"), F.col("human_mean"), F.col("vh"), F.col("n_ai"), F.col("ai_mean"), F.col("va"))
    return g.withColumn("cohens_d", d).drop("vh", "va")


def counted_before(values: DataFrame, by: str | list[str], value: str, n: str, cells: int = 64) -> DataFrame:
    """Adds ``before``: how many there are with a smaller value, for rows of distinct values with counts.

    The order over all values is not one window: values are cut into ranges of about as many distinct values each (approximate
    quantiles are the edges, so that an outlier draws nothing together), the ranges are counted and ordered, and the place inside a
    range is added.
    """
    by = [by] if isinstance(by, str) else by
    edges = values.groupBy(*[F.col(k).alias(f"_{k}") for k in by]).agg(F.percentile_approx(value, [i / cells for i in range(1, cells)], 20 * cells).alias("_q"))
    cell = F.size(F.filter("_q", lambda e: e < F.col(value)))
    v = values.join(edges, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]).select(*values.columns, cell.alias("_cell"))
    c = v.groupBy(*by, "_cell").agg(F.sum(n).alias("_t"))
    ahead = W.partitionBy(*by).orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)
    c = c.withColumn("_ahead", F.coalesce(F.sum("_t").over(ahead), F.lit(0))).drop("_t")
    inside = W.partitionBy(*by, "_cell").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    v = v.withColumn("_within", F.coalesce(F.sum(n).over(inside), F.lit(0)))
    c = c.select(*[F.col(k).alias(f"_{k}") for k in by], F.col("_cell").alias("_c"), "_ahead")
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by] + [F.col("_cell") == F.col("_c")]
    v = v.join(c, on)
    return v.withColumn("before", F.col("_ahead") + F.col("_within")).drop("_cell", "_c", "_within", "_ahead", *[f"_{k}" for k in by])


def _places(long: DataFrame, by: str | list[str], value: str) -> DataFrame:
    """Distinct values of each group with their number ``_k``, ``before``, and the size ``_n`` of the group."""
    by = [by] if isinstance(by, str) else by
    v = long.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_k"))
    v = counted_before(v, by, value, "_k")
    n = v.groupBy(*by).agg(F.sum("_k").alias("_n")).select(*[F.col(k).alias(f"_{k}") for k in by], "_n")
    return v.join(n, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in by]).drop(*[f"_{k}" for k in by])


def _at(place: Column, value: str) -> Column:
    return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("_k")), F.col(value)))


def order_statistics(long: DataFrame, by: str | list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group and share q the value at rank floor(q (n - 1)), an element of the data."""
    keys = [by] if isinstance(by, str) else by
    return _places(long, by, value).groupBy(*keys).agg(*[_at(F.floor(F.lit(q) * (F.col("_n") - 1)), value).alias(k) for k, q in shares.items()])


def by_place(long: DataFrame, by: str, value: str, parts: dict[str, tuple[int, int]]) -> DataFrame:
    """``(by, n, ...)``: for each group the values at place ``n * a // b``, counted from 0."""
    place = {k: F.expr(f"_n * {a} div {b}") for k, (a, b) in parts.items()}
    return _places(long, by, value).groupBy(by).agg(F.max("_n").alias("n"), *[_at(p, value).alias(k) for k, p in place.items()])


def percentiles(long: DataFrame, by: str | list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """For each group and share q the percentile by linear interpolation, exact. No group's values come together in one task."""
    keys = [by] if isinstance(by, str) else by
    place = {k: F.lit(float(q)) * (F.col("_n") - 1) for k, q in shares.items()}
    cols = []
    for k, p in place.items():
        cols += [_at(F.floor(p), value).alias(f"_lo_{k}"), _at(F.ceil(p), value).alias(f"_hi_{k}"), F.max(p - F.floor(p)).alias(f"_part_{k}")]
    g = _places(long, by, value).groupBy(*keys).agg(*cols)
    between = [(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * F.col(f"_part_{k}")).cast("double").alias(k) for k in shares]
    return g.select(*keys, *between)


def rank_sums(long: DataFrame) -> DataFrame:
    """``(feature, n1, n2, u, tie_sum, auc)``: the rank-sum statistic of the humans with ties shared, and the share of pairs in
    which the machine side is larger. Equal values fold into one row before anything is ordered."""
    v = long.filter("value IS NOT NULL").groupBy("feature", "value").agg(F.count(_h("value")).alias("h"), F.count(_a("value")).alias("a"))
    v = counted_before(v.filter("h + a > 0").withColumn("t", F.col("h") + F.col("a")), "feature", "value", "t")
    rank = F.col("before") + (F.col("t") + 1) / 2.0
    g = v.withColumn("rank", rank).groupBy("feature").agg(
        F.sum("h").alias("n1"), F.sum("a").alias("n2"), F.sum(F.col("rank") * F.col("h")).alias("r1"), F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("tie_sum")
    )
    u = F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2.0
    auc = F.when((F.col("n1") > 0) & (F.col("n2") > 0), 1 - u / (F.col("n1").cast("double") * F.col("n2")))
    return g.select("feature", "n1", "n2", u.alias("u"), "tie_sum", auc.alias("auc"))


def mann_whitney(long: DataFrame) -> DataFrame:
    """``(feature, u, p_raw)``: two-sided, normal tail with continuity and tie correction. Tiny tie-free samples have an exact
    distribution elsewhere; here they too get the normal one."""
    r = rank_sums(long).filter("n1 > 0 AND n2 > 0")
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    sd = F.sqrt(n1 * n2 / 12.0 * ((n + 1) - F.col("tie_sum") / F.nullif(n * (n - 1), F.lit(0.0))))
    top = F.greatest(F.col("u"), n1 * n2 - F.col("u"))
    z = F.when(sd > 0, (top - n1 * n2 / 2.0 - 0.5) / sd)
    r = r.withColumn("z", F.greatest(z, F.lit(0.0)))
    return r.select("feature", "u", F.coalesce(F.least(normal_tail(F.col("z")), F.lit(1.0)), F.lit(1.0)).alias("p_raw"))


def benjamini_hochberg(p: DataFrame, column: str = "p_raw") -> DataFrame:
    """Adds ``p_adj``. One row for each feature: their number is that of the measures, so one ordered window holds them."""
    n = F.count("*").over(W.partitionBy())
    up = W.orderBy(column, "feature")
    p = p.withColumn("rk", F.row_number().over(up)).withColumn("x", F.col(column) * n / F.col("rk"))
    down = W.orderBy(F.desc("rk")).rowsBetween(W.unboundedPreceding, 0)
    return p.withColumn("p_adj", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.min("x").over(down)))).drop("rk", "x")


def separation(long: DataFrame, least: int = 5) -> DataFrame:
    """One row for each feature with ``least`` values on both sides: spread of either side, effect size, p and adjusted p."""
    v = long.filter("value IS NOT NULL")
    g = v.groupBy("feature").agg(
        F.count(_h("value")).alias("n_human"), F.count(_a("value")).alias("n_ai"), F.avg(_h("value")).alias("human_mean"), F.stddev_samp(_h("value")).alias("human_sd"),
        F.avg(_a("value")).alias("ai_mean"), F.stddev_samp(_a("value")).alias("ai_sd"),
    ).filter((F.col("n_human") >= least) & (F.col("n_ai") >= least))
    d = pooled_d(F.col("n_human"), F.col("human_mean"), F.col("human_sd") ** 2, F.col("n_ai"), F.col("ai_mean"), F.col("ai_sd") ** 2)
    p = percentiles(v.filter(F.col("label").isin(HUMAN, AI)), ["feature", "label"], "value", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    h = p.filter(F.col("label") == HUMAN).select("feature", *[F.col(c).alias(f"human_{c}") for c in ("p25", "p50", "p75")])
    a = p.filter(F.col("label") == AI).select("feature", F.col("p50").alias("ai_p50"))
    g = g.withColumn("cohens_d", d).join(mann_whitney(v).select("feature", "p_raw"), "feature").join(h, "feature").join(a, "feature")
    g = benjamini_hochberg(g)
    return g.select(
        "feature", feature_group(F.col("feature")).alias("group"), "human_mean", "human_sd", "human_p25", "human_p50", "human_p75",
        "ai_mean", "ai_sd", "ai_p50", "cohens_d", "p_raw", "p_adj", F.abs("cohens_d").alias("abs_d"),
    )


def group_summary(sep: DataFrame) -> DataFrame:
    return sep.groupBy("group").agg(F.avg("abs_d").alias("mean_abs_d"), F.max("abs_d").alias("max_abs_d"), F.count("*").alias("features"))


def policy_rules(sep: DataFrame, min_d: float = 0.5, top: int = 20) -> DataFrame:
    """Strong and significant features a writer can act on."""
    s = sep.filter((F.col("abs_d") >= min_d) & (F.col("p_adj") < 0.05) & ~F.col("group").isin("function", "detector", "lm", "formatting"))
    return s.orderBy(F.desc("abs_d"), "feature").limit(top)


def length_balance(long: DataFrame) -> DataFrame:
    """One row: medians of the word counts of either side, their effect size, flags; none under three documents a side."""
    v = long.filter("feature = 'n_words' AND value IS NOT NULL")
    g = v.groupBy().agg(
        F.count(_h("value")).alias("n1"), F.count(_a("value")).alias("n2"),
        F.avg(_h("value")).alias("m1"), F.avg(_a("value")).alias("m2"), F.var_samp(_h("value")).alias("v1"), F.var_samp(_a("value")).alias("v2"),
    ).filter("n1 >= 3 AND n2 >= 3")
    m = percentiles(v.filter(F.col("label").isin(HUMAN, AI)), "label", "value", {"m": 0.5})
    m = m.agg(F.max(_h("m")).alias("human_median"), F.max(_a("m")).alias("ai_median"))
    g = g.crossJoin(F.broadcast(m)).withColumn("cohens_d", pooled_d(*map(F.col, ("n1", "m1", "v1", "n2", "m2", "v2"))))  # one row each
    return g.select("human_median", "ai_median", "cohens_d", (F.abs("cohens_d") > 0.8).alias("severe"), (F.abs("cohens_d") > 0.3).alias("notable"))


def profile(long: DataFrame, least: int = 5) -> DataFrame:
    """``(feature, n, mean, sd, p05, p25, p50, p75, p95)`` of the human side."""
    v = long.filter((F.col("label") == HUMAN) & F.col("value").isNotNull())
    g = v.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")).filter(F.col("n") >= least)
    shares = {f"p{q:02d}": q / 100 for q in (5, 25, 50, 75, 95)}
    return g.join(percentiles(v, "feature", "value", shares), "feature").select("feature", "n", "mean", "sd", *shares)


def roc_auc(long: DataFrame, least: int = 20) -> DataFrame:
    """``(feature, auc_raw, auc_oriented, higher_means_ai, n_scored)``: exact, from ranks."""
    r = rank_sums(long).filter((F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n1") + F.col("n2") >= least))
    return r.select("feature", F.col("auc").alias("auc_raw"), F.greatest("auc", 1 - F.col("auc")).alias("auc_oriented"), (F.col("auc") >= 0.5).alias("higher_means_ai"), (F.col("n1") + F.col("n2")).alias("n_scored"))


def varying(long: DataFrame) -> DataFrame:
    """The long table without features that have one value (or none) in all documents."""
    keep = long.groupBy("feature").agg((F.count_distinct("value") + F.max(F.col("value").isNull().cast("int"))).alias("k")).filter("k > 1").select("feature")
    return long.join(F.broadcast(keep), "feature", "left_semi")  # at most one row for each measure


def paired(docs: DataFrame) -> DataFrame:
    """Rows of ``(doc_id, label, mirrors, ...)`` without humans that no machine text mirrors; all rows if none mirrors any."""
    m = docs.filter((F.col("label") == AI) & F.col("mirrors").isNotNull()).select(F.col("mirrors").alias("doc_id")).distinct()
    human = docs.filter(F.col("label") == HUMAN)
    some = m.limit(1).select(F.lit(True).alias("some"))
    keep = human.join(m, "doc_id", "left_semi").unionByName(human.join(some, F.lit(True), "left_anti"))  # the second part only where no mirror exists
    return docs.filter(~F.col("label").eqNullSafe(HUMAN)).unionByName(keep)


def replication(long: DataFrame, primary: list[str], top: int = 15) -> DataFrame:
    """``(source, n_human, n_ai, tested, agree, agreement)``: signs of the primary sources' strongest features in each other source
    with ten documents a side."""
    sep = cohens_d(long.filter(F.col("source").isin(primary))).filter("n_human >= 5 AND n_ai >= 5").orderBy(F.desc(F.abs("cohens_d")), "feature").limit(top)
    held = long.filter(~F.col("source").isin(primary) & F.col("source").isNotNull())
    sizes = held.groupBy("source").agg(F.count_distinct(_h("doc_id")).alias("n_human"), F.count_distinct(_a("doc_id")).alias("n_ai")).filter("n_human >= 10 AND n_ai >= 10")
    d2 = cohens_d(held.filter("value IS NOT NULL"), "source").filter("n_human >= 5 AND n_ai >= 5").select("feature", "source", F.col("cohens_d").alias("d2"))
    x = d2.join(F.broadcast(sep.select("feature", F.col("cohens_d").alias("d1"))), "feature").join(sizes, "source")
    g = x.groupBy("source", "n_human", "n_ai").agg(F.count("*").alias("tested"), F.count_if((F.col("d1") > 0) == (F.col("d2") > 0)).alias("agree"))
    return g.withColumn("agreement", F.col("agree") / F.col("tested"))
