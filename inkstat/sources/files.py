"""Documents, feature tables and profiles in files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstat.functions import text as tx

DOCUMENT = "doc_id string, label string, source string, text string, title string, year int, meta string"


def read_documents(spark: SparkSession, path: str, least_words: int | None = None) -> DataFrame:
    """Documents of JSON lines, one shard or a folder of them; blank lines are skipped, a key beyond the schema or a broken line is
    an error. ``meta`` is kept as JSON. With a floor, only documents of so many words."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    v = F.parse_json("value")
    keys = [c.split()[0] for c in DOCUMENT.split(", ")]
    extra = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, keys)))
    checked = F.when(F.size(extra) == 0, v).otherwise(F.raise_error(F.concat(F.lit("keys that no document has: "), F.array_join(extra, ", "))))
    d = lines.select(checked.alias("v"))
    d = d.select(
        *[F.variant_get("v", f"$.{k}", t).alias(k) for k, t in (("doc_id", "string"), ("label", "string"), ("source", "string"), ("text", "string"))],
        F.coalesce(F.variant_get("v", "$.title", "string"), F.lit("")).alias("title"), F.variant_get("v", "$.year", "int").alias("year"),
        F.coalesce(F.to_json(F.variant_get("v", "$.meta", "variant")), F.lit("{}")).alias("meta"),
    )
    if least_words is not None:
        d = d.filter(tx.count(F.col("text"), f"{tx.NOT_WS}+") >= least_words)
    return d


def write_documents(docs: DataFrame, path: str) -> None:
    """JSON lines, one file a partition; ``meta`` becomes an object where it is valid JSON."""
    meta = F.coalesce(F.try_parse_json("meta"), F.parse_json(F.lit("{}")))
    docs.select("doc_id", "label", "source", "text", "title", "year", meta.alias("meta")).write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """A feature table as parquet or as CSV with a header."""
    w = df.write.mode("overwrite")
    w.option("header", True).csv(path) if kind == "csv" else w.parquet(path)


def read_table(spark: SparkSession, path: str, schema: str | None = None, kind: str = "parquet") -> DataFrame:
    r = spark.read if schema is None else spark.read.schema(schema)
    return r.option("header", True).csv(path) if kind == "csv" else r.parquet(path)


def wide(long: DataFrame, names: list[str]) -> DataFrame:
    """One row a document and one column a feature, of the long table."""
    return long.groupBy("doc_id").pivot("feature", names).agg(F.first("value", ignorenulls=True))


def profile_json(profile: DataFrame, docs: DataFrame, separating: DataFrame) -> DataFrame:
    """One row, one column: the profile as a JSON object of features with their bands. Both sides have a row for each measure."""
    f = profile.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", F.struct(*[c for c in profile.columns if c != "feature"]))))).alias("features"))
    s = separating.groupBy().agg(F.array_sort(F.collect_list(F.struct(F.abs("cohens_d").alias("d"), "feature", "cohens_d"))).alias("s"))
    n = docs.groupBy().agg(F.count_distinct("doc_id").alias("n_documents"), F.percentile("n_words", 0.5).alias("median_words"), F.array_sort(F.collect_set("source")).alias("sources"))
    x = n.crossJoin(f).crossJoin(s)
    sep = F.transform(F.reverse("s"), lambda z: F.struct(z["feature"].alias("feature"), z["cohens_d"].alias("cohens_d")))
    return x.select(F.to_json(F.struct("n_documents", "median_words", "sources", "features", sep.alias("separating_features"))).alias("value"))


def read_profile(spark: SparkSession, path: str) -> DataFrame:
    """``(feature, n, mean, sd, p05 ... p95)`` of a written profile."""
    kind = "struct<features: map<string, struct<n: bigint, mean: double, sd: double, p05: double, p25: double, p50: double, p75: double, p95: double>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("p"))
    return d.select(F.explode("p.features").alias("feature", "b")).select("feature", "b.*")


def policy_markdown(rules: DataFrame, gloss: dict[str, str]) -> DataFrame:
    """``(place, value)``: the lines of a policy: a heading, target and direction for each rule (at most a few dozen)."""
    from pyspark.sql import Window as W

    name = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in gloss.items() for x in kv]), F.col("feature")), F.col("feature"))
    r = rules.withColumn("place", F.row_number().over(W.orderBy(F.desc("abs_d"), "feature")))
    line = F.format_string(
        "### %s\n\n- Target: **%.4f to %.4f** (human median %.4f)\n- Model corpus sits %s, at %.4f\n- `%s`, d = %+.2f, adjusted p = %.1e\n", name, "human_p25", "human_p75", "human_p50",
        F.when(F.col("cohens_d") > 0, "higher").otherwise("lower"), "ai_p50", "feature", "cohens_d", "p_adj",
    )
    return r.select(F.col("place").cast("bigint").alias("place"), line.alias("value"))
