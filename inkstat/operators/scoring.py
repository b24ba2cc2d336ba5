"""How far a draft is from a profile, and where."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.functions import lexicons as lx
from inkstat.operators.blocks import feature_group, phrase_pattern


def z_scores(drafts: DataFrame, profile: DataFrame, weights: DataFrame) -> DataFrame:
    """``(doc_id, feature, value, p25, p50, p75, z, weight, priority, actionable)`` of drafts in long form; measures of mere length
    are passed over. Profile and weights have one row for each measure."""
    p = profile.filter("sd > 0").select("feature", "sd", "p25", "p50", "p75")
    x = drafts.filter(F.col("value").isNotNull() & ~F.col("feature").isin(lx.LENGTH_FEATURES)).join(F.broadcast(p), "feature")
    x = x.join(F.broadcast(weights.select("feature", F.abs("cohens_d").alias("weight"))), "feature", "left").fillna(0.0, ["weight"])
    z = (F.col("value") - F.col("p50")) / F.col("sd")
    x = x.withColumns({"z": z, "priority": F.abs(z) * (0.25 + F.col("weight")), "actionable": feature_group(F.col("feature")) != "function"})
    return x.select("doc_id", "feature", "value", "p25", "p50", "p75", "z", "weight", "priority", "actionable")


def length_gap(scores: DataFrame, lengths: DataFrame, reference_median: float | None = None) -> DataFrame:
    """Scores without length-sensitive measures for drafts whose words are not within half and twice the reference."""
    l = lengths.select("doc_id", (F.lit(reference_median).isNotNull() & ~(F.col("n_words") / F.nullif(F.lit(reference_median), F.lit(0.0))).between(0.5, 2.0)).alias("gap"))
    return scores.join(l, "doc_id", "left").filter(~(F.coalesce("gap", F.lit(False)) & F.col("feature").isin(lx.LENGTH_SENSITIVE)))


def within_one(scores: DataFrame) -> DataFrame:
    return scores.groupBy("doc_id").agg(F.count_if(F.abs("z") <= 1).alias("inside"), F.count("*").alias("features"))


def phrase_hits(docs: DataFrame, around: int = 35) -> DataFrame:
    """``(doc_id, line_no, phrase, nth, context)``: each match of each stock phrase in each line, with what stands around it.

    Spark has no function for the places of all matches: the text between matches is what ``split`` leaves, so places are
    sums of lengths.
    """
    d = docs.filter(F.length("text") > 0).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    low = F.lower("line")
    any_ = None
    for p in lx.STOCK_PHRASES:
        c = F.contains(low, F.lit(max(p.split(), key=len)))
        any_ = c if any_ is None else any_ | c
    d = d.filter(any_)
    found = [F.struct(F.lit(p).alias("phrase"), F.split("line", phrase_pattern(p), -1).alias("rest"), F.regexp_extract_all("line", F.lit("(" + phrase_pattern(p) + ")"), F.lit(1)).alias("hits")) for p in lx.STOCK_PHRASES]
    x = d.select("doc_id", "i", "line", F.explode(F.array(*found)).alias("f")).filter(F.size("f.hits") > 0)
    x = x.select("doc_id", "i", "line", "f.phrase", "f.rest", "f.hits", F.explode(F.sequence(F.lit(1), F.size("f.hits"))).alias("nth"))

    def before(a, n):
        return F.aggregate(F.slice(a, 1, n), F.lit(0), lambda t, y: t + F.length(y))

    start = before(F.col("rest"), F.col("nth")) + before(F.col("hits"), F.col("nth") - 1)
    end = start + F.length(F.element_at("hits", F.col("nth")))
    a = F.greatest(start - around, F.lit(0))
    context = F.trim(F.substr("line", a + 1, end + around - a))
    return x.select("doc_id", (F.col("i") + 1).cast("bigint").alias("line_no"), "phrase", F.col("nth").cast("bigint").alias("nth"), context.alias("context"))
