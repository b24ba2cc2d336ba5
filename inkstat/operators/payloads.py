"""Scores of outside models: token statistics, detector answers, parses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstat.operators.statistics import percentiles

BINS = (10, 100, 1000)


def token_rows(tokens: DataFrame) -> DataFrame:
    """One row for each token of each document; repeated rows count once. NaN and infinite values are not defined, which is null."""
    lp = F.when(F.isnan("logprob") | (F.abs("logprob") == float("inf")), None).otherwise(F.col("logprob"))
    rk = F.when(F.isnan("tok_rank") | (F.col("tok_rank") < 1), None).otherwise(F.col("tok_rank"))
    return tokens.filter("doc_id IS NOT NULL AND tok_pos IS NOT NULL").groupBy("doc_id", "tok_pos").agg(F.max(lp).alias("lp"), F.max(rk).alias("rk"))


def lm_features(tokens: DataFrame) -> DataFrame:
    """Seventeen measures of how a language model reads each document, over its tokens with a defined log-probability."""
    t = token_rows(tokens)
    t = t.filter("lp IS NOT NULL").withColumn("d", F.abs(F.col("lp") - F.lag("lp").over(W.partitionBy("doc_id").orderBy("tok_pos"))))
    lo, aggs = 0, []
    for b in BINS:
        aggs.append(F.avg(((F.col("rk") > lo) & (F.col("rk") <= b)).cast("int")).alias(f"lm_rank_top{b}_frac"))
        lo = b
    g = t.groupBy("doc_id").agg(
        F.avg("lp").alias("m"), F.stddev_pop("lp").alias("lm_logprob_sd"), F.percentile("lp", [0.1, 0.25, 0.5, 0.75, 0.9]).alias("p"), F.avg((F.col("lp") < -5).cast("int")).alias("lm_surprise_frac"),
        F.count("*").cast("double").alias("lm_n_tokens"), F.coalesce(F.avg("d"), F.lit(0.0)).alias("lm_logprob_neighbour_delta"), *aggs,
        F.avg((F.col("rk") > lo).cast("int")).alias(f"lm_rank_beyond{lo}_frac"), F.avg(F.ln("rk")).alias("lm_log_rank_mean"), F.stddev_pop(F.ln("rk")).alias("lm_log_rank_sd"),
    )
    return g.select(
        "doc_id", F.exp(-F.col("m")).alias("lm_ppl"), F.col("m").alias("lm_logprob_mean"), "lm_logprob_sd", F.coalesce(F.try_divide("lm_logprob_sd", F.abs("m")), F.lit(0.0)).alias("lm_logprob_cv"),
        F.col("p")[0].alias("lm_logprob_p10"), F.col("p")[2].alias("lm_logprob_p50"), F.col("p")[4].alias("lm_logprob_p90"), (F.col("p")[3] - F.col("p")[1]).alias("lm_logprob_iqr"),
        *[c for c in g.columns if c not in ("doc_id", "m", "p", "lm_logprob_sd")],
    )


def context_windows(tokens: DataFrame, length: int = 512, stride: int = 256) -> DataFrame:
    """``(doc_id, win, start, end, first_scored, n_scored)``: windows a model reads, and the tokens each of them scores; every token but
    the first of a document is scored once, in the first window that reaches it."""
    n = token_rows(tokens).groupBy("doc_id").agg((F.max("tok_pos") + 1).alias("n")).filter("n >= 2")
    last = F.greatest(F.ceil((F.col("n") - length) / F.lit(stride)), F.lit(0)).cast("int")
    x = n.select("doc_id", "n", F.explode(F.sequence(F.lit(0), last)).alias("win"))
    end = F.least(F.col("win") * stride + length, F.col("n"))
    first = F.when(F.col("win") == 0, 1).otherwise(F.least((F.col("win") - 1) * stride + length, F.col("n")))
    x = x.select("doc_id", "win", (F.col("win") * stride).alias("start"), end.alias("end"), first.alias("first_scored"))
    return x.withColumn("n_scored", F.col("end") - F.col("first_scored"))


def chunk_scores(tokens: DataFrame, size: int = 512, least: int = 16) -> DataFrame:
    """``(doc_id, det_chunks)``: mean score over chunks of tokens; short last chunks are dropped unless there is no other. The score of
    a chunk stands in for a classifier: the logistic function of its mean log-probability plus 3."""
    t = token_rows(tokens).filter("lp IS NOT NULL").withColumn("chunk", F.floor(F.col("tok_pos") / size))
    c = t.groupBy("doc_id", "chunk").agg(F.count("*").alias("n"), F.avg("lp").alias("m"))
    best = W.partitionBy("doc_id")
    c = c.withColumn("long", F.max((F.col("n") >= least).cast("int")).over(best)).filter((F.col("n") >= least) | ((F.col("long") == 0) & (F.col("chunk") == 0)))
    return c.groupBy("doc_id").agg(F.avg(1 / (1 + F.exp(-(F.col("m") + 3)))).alias("det_chunks"))


def curvature(dist: DataFrame) -> DataFrame:
    """``(doc_id, det_curvature)`` from ``(doc_id, logprob, mu, var)`` of tokens: observed minus expected log-probability over the root
    of the summed variance."""
    g = dist.groupBy("doc_id").agg(F.sum(F.col("logprob") - F.col("mu")).alias("d"), F.sum("var").alias("v"))
    return g.select("doc_id", (F.col("d") / F.sqrt(F.greatest("v", F.lit(1e-9)))).alias("det_curvature"))


def cross_ratio(dist: DataFrame) -> DataFrame:
    """``(doc_id, det_ratio)`` from ``(doc_id, logprob, cross_entropy)``: mean surprise over mean expected surprise; null if that is 0."""
    g = dist.groupBy("doc_id").agg(F.avg(-F.col("logprob")).alias("a"), F.avg("cross_entropy").alias("b"))
    return g.select("doc_id", F.try_divide("a", "b").alias("det_ratio"))


def same_vocabulary(observer: DataFrame, performer: DataFrame) -> DataFrame:
    """``(same, only_observer, only_performer)`` of two vocabularies ``(word, id)``: a ratio of two models is defined only where both
    number the same tokens alike."""
    x = observer.select("word", F.col("id").alias("a")).join(performer.select("word", F.col("id").alias("b")), "word", "full_outer")
    g = x.agg(F.count_if(F.expr("a IS NOT NULL AND NOT a <=> b")).alias("only_observer"), F.count_if(F.expr("b IS NOT NULL AND NOT a <=> b")).alias("only_performer"))
    return g.select(((F.col("only_observer") == 0) & (F.col("only_performer") == 0)).alias("same"), "only_observer", "only_performer")


def fan_out(docs: DataFrame, detectors: dict[str, Callable[[str], float]]) -> DataFrame:
    """``(doc_id, det_<name>, det_<name>_error ...)``: each detector over each text. One that fails on a text gives null and an error
    flag of 1 for it and does not stop the others; a text that is null or empty has nulls and no flags."""
    names = list(detectors)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for i, t in zip(b["doc_id"], b["text"]):
                row = [i]
                for n in names:
                    v, e = None, None
                    if t:
                        try:
                            v = float(detectors[n](t))
                        except Exception:  # noqa: BLE001 - one bad model must not lose the run
                            e = 1.0
                    row += [None if v is None or v != v else v, e]
                rows.append(row)
            yield pd.DataFrame(rows, columns=["doc_id", *[c for n in names for c in (f"det_{n}", f"det_{n}_error")]])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, " + ", ".join(f"det_{n} double, det_{n}_error double" for n in names))


def detector_answers(payloads: DataFrame) -> DataFrame:
    """One flat row for each document, from its latest attempt that holds a document; what is missing or of another type is null.

    A probability counts if it is a JSON number, not a string that looks like one.
    """
    p = payloads.filter("doc_id IS NOT NULL AND payload IS NOT NULL").select("doc_id", "attempt", "fetched_at", "payload").dropDuplicates()

    v = F.try_parse_json("payload")
    doc = F.try_variant_get(v, "$.documents[0]", "variant")
    num = lambda base, path: F.when(F.schema_of_variant(F.try_variant_get(base, path, "variant")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$"), F.try_variant_get(base, path, "double"))
    d = p.withColumn("doc", doc).filter(F.col("doc").isNotNull())
    d = d.withColumn("r", F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("attempt"), F.desc("fetched_at"), "payload"))).filter("r = 1")
    sents = F.try_variant_get("doc", "$.sentences", "array<variant>")
    d = d.withColumn("s", F.array_sort(F.filter(F.transform(F.coalesce(sents, F.array()), lambda x: num(x, "$.generated_prob")), lambda x: x.isNotNull())))
    k = F.size("s")
    return d.select(
        "doc_id", num("doc", "$.completely_generated_prob").alias("completely_generated_prob"), num("doc", "$.class_probabilities.ai").alias("prob_ai"),
        num("doc", "$.class_probabilities.human").alias("prob_human"), num("doc", "$.class_probabilities.mixed").alias("prob_mixed"),
        F.try_variant_get("doc", "$.predicted_class", "string").alias("predicted_class"), k.cast("bigint").alias("n_sentences_scored"),
        F.when(k > 0, F.aggregate("s", F.lit(0.0), lambda a, x: a + x) / k).alias("sent_prob_mean"), F.get("s", F.floor(k / 2).cast("int")).alias("sent_prob_median"),
        F.get("s", F.floor(0.9 * (k - 1)).cast("int")).alias("sent_prob_p90"), F.when(k > 0, F.size(F.filter("s", lambda x: x > 0.5)) / k).alias("sent_frac_over_half"),
    )


def probe_medians(answers: DataFrame, docs: DataFrame) -> DataFrame:
    """``(source, n, median_prob)`` of the detector's verdicts by source."""
    x = answers.join(docs.select("doc_id", F.lower(F.trim("source")).alias("source")).dropDuplicates(["doc_id"]), "doc_id")
    n = x.groupBy("source").agg(F.count("completely_generated_prob").alias("n"))
    m = percentiles(x, "source", "completely_generated_prob", {"median_prob": 0.5}).withColumnRenamed("source", "_source")
    return n.join(m, F.col("source").eqNullSafe(F.col("_source")), "left").select("source", "n", "median_prob")


CLAUSES = ("ROOT", "ccomp", "xcomp", "advcl", "relcl", "acl")
PASSIVE = ("nsubjpass", "auxpass", "csubjpass")


def syntax_features(parse: DataFrame) -> DataFrame:
    """Twelve measures from a parse table ``(doc_id, sent, tok, pos, dep, head, is_punct, is_space)``; ``head`` is the place of the
    governing token in its sentence, that of a root its own. Depths are found in the row of each sentence by following heads."""
    s = parse.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("tok", "head", "pos", "dep", "is_punct", "is_space"))).alias("t"))
    head = F.map_from_entries(F.transform("t", lambda x: F.struct(x["tok"], x["head"])))
    s = s.withColumn("h", head)

    def depth(x):
        # a chain is no longer than its sentence; 100 steps at most, as a guard against loops
        z = F.aggregate(
            F.sequence(F.lit(1), F.least(F.size("t"), F.lit(100))), F.struct(x["tok"].cast("bigint").alias("at"), F.lit(0).alias("d")),
            lambda a, _: F.when(F.element_at("h", a["at"].cast("int")) == a["at"], a).otherwise(F.struct(F.element_at("h", a["at"].cast("int")).cast("bigint").alias("at"), (a["d"] + 1).alias("d"))),
        )
        return z["d"]

    s = s.withColumn("depth", F.array_max(F.transform("t", depth)))
    first = F.get(F.filter("t", lambda x: ~x["is_punct"] & ~x["is_space"]), 0)["pos"]
    s = s.withColumn("opener", F.coalesce(first, F.lit("X")))

    def n(*deps: str):
        return F.size(F.filter("t", lambda x: x["dep"].isin(*deps)))

    def p(*pos: str):
        return F.size(F.filter("t", lambda x: x["pos"].isin(*pos)))

    s = s.withColumns({
        "words": F.size(F.filter("t", lambda x: ~x["is_punct"] & ~x["is_space"])), "clauses": n(*CLAUSES), "passives": n(*PASSIVE), "subs": n("advcl", "relcl", "acl"), "coords": n("cc"),
        "nouns": p("NOUN", "PROPN"), "verbs": p("VERB"), "adjs": p("ADJ"), "advs": p("ADV"), "adps": p("ADP"),
    })
    o = s.groupBy("doc_id", "opener").agg(F.count("*").alias("c")).withColumn("p", F.col("c") / F.sum("c").over(W.partitionBy("doc_id")))
    o = o.groupBy("doc_id").agg(F.sum(-F.col("p") * F.log2("p")).alias("opener_pos_entropy"))
    g = s.groupBy("doc_id").agg(F.avg("depth").alias("dep_depth_mean"), F.stddev_pop("depth").alias("dep_depth_sd"), *[F.sum(c).alias(c) for c in ("words", "clauses", "passives", "subs", "coords", "nouns", "verbs", "adjs", "advs", "adps")])
    g = g.filter("words > 0")
    r = lambda c: 1000.0 * F.col(c) / F.col("words")
    g = g.select(
        "doc_id", "dep_depth_mean", "dep_depth_sd", F.coalesce(F.try_divide("passives", "clauses"), F.lit(0.0)).alias("passive_per_clause"), r("subs").alias("subordination_rate"),
        r("coords").alias("coordination_rate"), r("nouns").alias("noun_rate"), r("verbs").alias("verb_rate"), r("adjs").alias("adj_rate"), r("advs").alias("adv_rate"), r("adps").alias("adp_rate"),
        F.coalesce(F.try_divide("nouns", "verbs"), F.lit(0.0)).alias("noun_verb_ratio"),
    )
    return g.join(o, "doc_id")
