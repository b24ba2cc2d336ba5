"""Preparing a corpus: floors, caps, resuming, shards, matching lengths, limits on requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstat.functions import text as tx
from inkstat.operators.statistics import by_place


def word_floor(docs: DataFrame, least: int = 200) -> DataFrame:
    """Documents of at least so many words between white space."""
    return docs.filter(tx.count(F.col("text"), f"{tx.NOT_WS}+") >= least)


def capped(docs: DataFrame, n: int, *by: str, order: str = "doc_id") -> DataFrame:
    """The first ``n`` rows of each group. Spark keeps only ``n`` rows a partition before the shuffle (window group limit)."""
    r = F.row_number().over(W.partitionBy(*by).orderBy(order))
    return docs.withColumn("_r", r).filter(F.col("_r") <= n).drop("_r")


def strided(docs: DataFrame, shards: int, shard: int, size: Column, parts: int = 64) -> DataFrame:
    """Every ``shards``-th row in order of size, from the ``shard``-th on. Rows are cut into ranges of size first and numbered range
    by range, so that no task orders everything."""
    d = docs.withColumn("_size", size)
    q = d.select(F.percentile_approx("_size", [i / parts for i in range(1, parts)], 1000).alias("q"))
    d = d.crossJoin(F.broadcast(q)).withColumn("_cell", F.size(F.filter("q", lambda x: x < F.col("_size")))).drop("q")
    cells = d.groupBy("_cell").agg(F.count("*").alias("_n"))
    cells = cells.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    place = F.col("_before") + F.row_number().over(W.partitionBy("_cell").orderBy("_size", "doc_id")) - 1
    x = d.join(F.broadcast(cells), "_cell").withColumn("_place", place)
    return x.filter(F.col("_place") % shards == shard).drop("_cell", "_before", "_place", "_size")


def resume(jobs: DataFrame, done: DataFrame, key: str = "doc_id", done_key: str = "mirrors") -> DataFrame:
    """Jobs whose key no finished row mirrors."""
    return jobs.join(done.select(F.col(done_key).alias(key)).distinct(), key, "left_anti")


def upsert(existing: DataFrame, batch: DataFrame, key: str = "mirrors") -> DataFrame:
    """Existing rows whose key the batch does not bring, and the batch. Rows without key stay."""
    return existing.join(batch.select(key).distinct(), key, "left_anti").select(existing.columns).unionByName(batch)


def length_matched(docs: DataFrame, bins: int = 10, seed: int = 0) -> DataFrame:
    """``(doc_id, label, n_words)`` with as many rows of either label in each bin of pooled length quantiles; the input itself if
    a label has no rows or there are fewer than three edges. Who stays is decided by hash."""
    q = docs.agg(F.percentile("n_words", [i / bins for i in range(bins + 1)]).alias("q"), F.count_distinct("label").alias("labels"))
    q = q.select(F.array_distinct("q").alias("edges"), "labels")
    d = docs.crossJoin(F.broadcast(q))  # one row
    b = F.least(F.greatest(F.size(F.filter("edges", lambda e: e <= F.col("n_words"))) - 1, F.lit(0)), F.size("edges") - 2)
    d = d.withColumns({"bin": b, "free": (F.size("edges") < 3) | (F.col("labels") < 2)})
    n = d.groupBy("bin").agg(F.count_if(F.col("label") == "human").alias("h"), F.count_if(F.col("label") == "ai").alias("a")).select("bin", F.least("h", "a").alias("k"))
    r = F.row_number().over(W.partitionBy("bin", "label").orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id"))
    d = d.withColumn("r", r).join(F.broadcast(n), "bin")  # one row a bin
    return d.filter(F.col("free") | (F.col("r") <= F.col("k"))).select("doc_id", "label", "n_words", "bin")


def sampled(docs: DataFrame, n: int, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """A sample that is the same on every engine that has the hash: the ``n`` smallest hashes."""
    return docs.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def accepted(docs: DataFrame, floor: int, target: str = "target_words", share: float = 0.6) -> DataFrame:
    """Generated texts of at least ``floor`` words and ``share`` of what was asked for."""
    n = tx.count(F.col("text"), f"{tx.NOT_WS}+")
    return docs.filter((n >= floor) & (n >= share * F.coalesce(F.col(target), F.lit(0))))


def length_ratios(docs: DataFrame, target: str = "target_words") -> DataFrame:
    """``(n, p10, median, p90, short)`` of the words of generated texts over those asked for, by place ``n // 10``, ``n // 2`` and
    ``9 n // 10``; ``short`` says that they fall materially short. Texts without a target are passed over."""
    n = tx.count(F.col("text"), f"{tx.NOT_WS}+")
    r = docs.filter(F.col(target) > 0).select(F.lit("all").alias("g"), (n / F.col(target)).alias("r"))
    x = by_place(r, "g", "r", {"p10": (1, 10), "median": (1, 2), "p90": (9, 10)})
    return x.select("n", "p10", "median", "p90", (F.col("median") < 0.7).alias("short"))


def usable_titles(docs: DataFrame, least: int = 800) -> DataFrame:
    """``(doc_id, title)``: clean titles of texts of ``least`` or more words, as prompts; once each."""
    x = word_floor(docs.filter("title IS NOT NULL AND text IS NOT NULL"), least).select("doc_id", tx.clean_title(F.col("title")).alias("title"))
    return x.filter("title <> ''").groupBy("doc_id").agg(F.min("title").alias("title"))


def repeats_existing(existing: Column, addition: Column, words: int = 12) -> Column:
    """Whether an addition begins with words the text already holds."""
    head = F.array_join(F.slice(tx.split_words(F.lower(addition)), 1, words), " ")
    return (head != "") & F.contains(F.array_join(tx.split_words(F.lower(existing)), " "), head)


def draft_register(register: Column) -> Column:
    """The register a draft is read in; paper where none of the three is asked for."""
    return F.when(register.isin("paper", "letter", "docs"), register).otherwise("paper")


def draft_status(text: Column, words: int = 5_000, chars: int = 40_000) -> Column:
    """200, 400 for fewer than five words, 413 beyond the limits."""
    n = tx.count(F.coalesce(text, F.lit("")), f"{tx.NOT_WS}+")
    return F.when(n < 5, 400).when((n > words) | (F.length(text) > chars), 413).otherwise(200)


def daily_quota(requests: DataFrame, per_key: int = 3, per_day: int = 200) -> DataFrame:
    """``(seq, day, visitor_key, served)`` of first-pass requests that succeed upstream, each delivery once, in order of arrival.

    Of a key's requests of a day the first ``per_key`` may pass, and of those of all keys the first ``per_day``. A busy
    key and a busy day are cut to their limits partition by partition before they meet (window group limit).
    """
    r = requests.filter(F.coalesce("upstream_ok", F.lit(False)) & (F.coalesce("pass_no", F.lit(1)) == 1))
    r = r.groupBy("seq").agg(F.min("ts").alias("ts"), F.min("visitor_key").alias("visitor_key"))
    r = r.withColumns({"day": F.to_date("ts"), "visitor_key": F.coalesce("visitor_key", F.lit("unknown"))})
    r = r.withColumn("k", F.row_number().over(W.partitionBy("day", "visitor_key").orderBy("seq"))).filter(F.col("k") <= per_key)
    r = r.withColumn("t", F.row_number().over(W.partitionBy("day").orderBy("seq"))).filter(F.col("t") <= per_day)
    return r.select("seq", "day", "visitor_key")


def word_budget(requests: DataFrame, budget: int) -> DataFrame:
    """``(visitor_key, seq, n_words, admitted, spent)``: a request that would go over the budget of its key is refused and takes
    nothing, so each decision hangs on those before it: a fold over the key's requests in order.

    The fold keeps one number for a key, so a key's rows stream through it in batches; none is collected.
    """
    import pandas as pd

    def run(it):
        key, spent = object(), 0
        for b in it:
            rows = []
            for k, q, n in zip(b["visitor_key"], b["seq"], b["n_words"]):
                if k != key:
                    key, spent = k, 0
                ok = spent + n <= budget
                spent += int(n) if ok else 0
                rows.append((k, q, n, ok, spent))
            yield pd.DataFrame(rows, columns=["visitor_key", "seq", "n_words", "admitted", "spent"])

    r = requests.select(F.coalesce("visitor_key", F.lit("unknown")).alias("visitor_key"), "seq", F.coalesce(F.col("draft_words").cast("bigint"), F.lit(0)).alias("n_words")).dropDuplicates(["seq"])
    return r.repartition("visitor_key").sortWithinPartitions("visitor_key", "seq").mapInPandas(run, "visitor_key string, seq bigint, n_words bigint, admitted boolean, spent bigint")
