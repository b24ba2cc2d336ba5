"""Sliding windows over the sentences of a document."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstat.functions import numbers as nu
from inkstat.functions import text as tx
from inkstat.operators import blocks as bl

WIDTH, STRIDE, UNIFORM_CV = 8, 1, 0.35
#: Which end of a measure is the uniform one: the low one, but for repetition of openers.
HIGH_IS_UNIFORM = ("w_head_repeat",)
METRICS = ("w_sent_len_mean", "w_sent_len_sd", "w_sent_len_cv", "w_sent_len_range", "w_neighbour_delta", "w_ttr", "w_head_repeat", "w_comma_rate", "w_n_words")


def _variation(ln: Column) -> Column:
    """Spread of lengths over their mean; 0 without words. The mean is the sum over the number, not the running one of the fold, which
    is off in its last places. What the fold of squares rounds is left, as in SQL: it can rank windows of equal spread."""
    return nu.moments(ln, lambda n, m, m2: F.when(m > 0, F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(0.0) / (nu.total(ln) / n)).otherwise(0.0))


def _field(c: str) -> Callable[[Column], Column]:
    return lambda x: x[c]


def _starts(d: DataFrame, width: int, stride: int) -> Column:
    """Where windows begin; a document of fewer sentences is one window."""
    return F.sequence(F.lit(0), F.greatest(F.size("lens") - width, F.lit(0)), F.lit(stride))


def _measures(i: Column, width: int) -> Column:
    """The struct of one window that begins at sentence ``i``."""

    def cut(c: str) -> Column:
        return F.slice(F.col(f"all.{c}"), i + 1, width)

    ln, words = cut("lens"), nu.total(cut("lens"))
    tokens = F.flatten(cut("sent_toks"))
    first = F.get("all.shown", i)
    values = {
        "w_sent_len_mean": nu.mean(ln), "w_sent_len_sd": nu.moments(ln, lambda n, m, m2: F.when(n > 1, F.sqrt(m2 / (n - 1))).otherwise(0.0)), "w_sent_len_cv": _variation(ln),
        "w_sent_len_range": (F.array_max(ln) - F.array_min(ln)).cast("double"), "w_neighbour_delta": nu.steps(ln),
        "w_ttr": F.size(F.array_distinct(tokens)) / F.size(tokens), "w_head_repeat": 1.0 - F.size(F.array_distinct(cut("heads"))) / F.size(ln),
        "w_comma_rate": 1000.0 * nu.total(cut("commas")) / words, "w_n_words": words,
    }
    preview = F.when(F.length(first) > 110, F.concat(F.substring(first, 1, 110), F.lit("..."))).otherwise(first)
    return F.struct(i.cast("bigint").alias("win_start"), F.size(ln).cast("bigint").alias("n_sentences"), preview.alias("preview"), *[values[c].alias(c) for c in METRICS])


def windows(docs: DataFrame, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """``(doc_id, ws)``: the measures of all windows of a document as one array, made inside its row, so that nothing is shuffled."""
    d = bl.prepared(docs).withColumn("commas", F.transform("sents", lambda s: F.length(s) - F.length(F.replace(s, F.lit(","), F.lit("")))))
    # one struct that is named many times: arrays named once would be made anew for every window
    d = d.withColumn("shown", F.transform("sents", tx.rejoined))
    d = d.filter(F.size("parts") > 0).select("doc_id", "lens", F.struct("shown", "lens", "sent_toks", "heads", "commas").alias("all"))
    return d.select("doc_id", F.transform(_starts(d, width, stride), lambda i: _measures(i, width)).alias("ws"))


def window_metrics(docs: DataFrame, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """``(doc_id, win_start, n_sentences, preview, nine measures)``: each window of ``width`` sentences; a shorter document is one
    window."""
    # not the column itself: from that a filter on its size is inferred, which would make the array once more
    some = F.filter("ws", lambda w: w["w_n_words"] > 0)
    return windows(docs, width, stride).select("doc_id", F.explode(some).alias("w")).select("doc_id", "w.*")


def window_tails(docs: DataFrame, width: int = WIDTH, stride: int = STRIDE) -> DataFrame:
    """Mean, deviation, worst and quarter of each measure over a document's windows, and its uniform share and runs."""
    w = windows(docs, width, stride)
    w = w.withColumns({f"up_{c}": F.array_sort(F.transform("ws", _field(c))) for c in METRICS})
    cols = [F.size("ws").cast("bigint").alias("n_windows")]
    for c in METRICS:
        high, up = c in HIGH_IS_UNIFORM, F.col(f"up_{c}")
        cols += [
            nu.mean(up).alias(f"{c}_mean"), nu.moments(up, lambda n, m, m2: F.sqrt(m2 / n)).alias(f"{c}_sd"), nu.linear(up, 0.95 if high else 0.05).alias(f"{c}_worst"),
            nu.linear(up, 0.75 if high else 0.25).alias(f"{c}_p75" if high else f"{c}_p25"),
        ]
    uniform = F.size(F.filter("ws", lambda x: x["w_sent_len_cv"] < UNIFORM_CV))
    return w.select("doc_id", *cols, (uniform / F.size("ws")).alias("frac_uniform_windows"))


def uniform_runs(docs: DataFrame, width: int = WIDTH, stride: int = STRIDE, cv: float = UNIFORM_CV) -> DataFrame:
    """``(doc_id, n_windows, longest_uniform_run, longest_uniform_run_frac)``: the longest run of uniform windows, found in one
    pass over the lengths of sentences."""
    d = bl.prepared(docs).filter(F.size("parts") > 0)
    even = F.transform(_starts(d, width, stride), lambda i: _variation(F.slice("lens", i + 1, width)) < cv)
    d = d.select("doc_id", even.alias("even"))

    def step(a: Column, e: Column) -> Column:
        run = F.when(e, a["run"] + 1).otherwise(F.lit(0))
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    best = F.aggregate("even", F.struct(F.lit(0).alias("run"), F.lit(0).alias("best")), step, lambda a: a["best"].cast("bigint"))
    d = d.select("doc_id", F.size("even").cast("bigint").alias("n_windows"), best.alias("longest_uniform_run"))
    return d.withColumn("longest_uniform_run_frac", F.col("longest_uniform_run") / F.col("n_windows"))


def most_uniform(docs: DataFrame, k: int = 3) -> DataFrame:
    """The ``k`` windows of each document with the least variation of sentence length."""
    first = F.slice(F.array_sort(F.transform("ws", lambda x: F.struct(x["w_sent_len_cv"].alias("cv"), x["win_start"].alias("at"), x.alias("w")))), 1, k)
    w = windows(docs).select("doc_id", F.posexplode(first).alias("place", "f"))
    return w.select("doc_id", (F.col("place") + 1).alias("place"), "f.w.*")
