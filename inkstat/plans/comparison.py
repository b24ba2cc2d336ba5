"""Queries that compare labelled groups of the corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.functions import lexicons as lx
from inkstat.operators import blocks as bl
from inkstat.operators import models as mo
from inkstat.operators import scoring as sc
from inkstat.operators import statistics as st
from inkstat.plans import documents as dc
from inkstat.plans import sql as s
from inkstat.plans.documents import _rounded
from inkstat.runtime import cut, table

#: Measures are kept to so many places, so that equal ones tie in every engine.
PLACES = 6


def labelled(spark, d) -> DataFrame:
    """``(doc_id, label, source, feature, value)``: all measures of the corpus, written once; each document once. Repeated rows are
    dropped after the texts have become numbers, so that no text is shuffled."""
    c = table(spark, d, "corpus").withColumns({"label": F.lower("label"), "source": F.lower(F.trim("source"))})
    w, names = bl.measures(c, ("doc_id", "label", "source"), places=PLACES)
    return cut(bl.as_long(w.dropDuplicates(["doc_id"]), names, "doc_id", "label", "source"))


_LONG = f"""c AS (SELECT DISTINCT ON (doc_id) doc_id, lower(label) AS label, lower(trim(source)) AS source, text FROM corpus WHERE length(text) > 0),
documents AS (SELECT doc_id, text FROM c), every AS ({dc.ALL_MEASURES}),
f AS (SELECT doc_id, label, source, feature, round(value, {PLACES}) AS value FROM every JOIN c USING (doc_id))"""
_D = """CASE WHEN n_human >= 2 AND n_ai >= 2 AND sqrt(((n_human - 1) * vh + (n_ai - 1) * va) / (n_human + n_ai - 2)) > 0
  THEN (ai_mean - human_mean) / sqrt(((n_human - 1) * vh + (n_ai - 1) * va) / (n_human + n_ai - 2)) ELSE 0.0 END"""
_SIDES = """count(value) FILTER (label = 'human') AS n_human, count(value) FILTER (label = 'ai') AS n_ai, avg(value) FILTER (label = 'human') AS human_mean, avg(value) FILTER (label = 'ai') AS ai_mean,
  var_samp(value) FILTER (label = 'human') AS vh, var_samp(value) FILTER (label = 'ai') AS va"""
_DS = f"{_LONG}, g AS (SELECT feature, {_SIDES} FROM f GROUP BY feature), d AS (SELECT *, {_D} AS cohens_d FROM g)"


def cohens_d(spark, d):
    return _rounded(st.cohens_d(labelled(spark, d)))


_COHEN = f"WITH {_DS} SELECT feature, n_human, n_ai, round(human_mean, 4) AS human_mean, round(ai_mean, 4) AS ai_mean, round(cohens_d, 4) AS cohens_d FROM d"


def rank_sum_u(spark, d):
    return _rounded(st.rank_sums(labelled(spark, d)).drop("tie_sum"))


_RANKS = f"""{_LONG}, l AS (SELECT * FROM f WHERE label IN ('human', 'ai') AND value IS NOT NULL),
r AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM l),
u AS (SELECT feature, count(*) FILTER (label = 'human') AS n1, count(*) FILTER (label = 'ai') AS n2, sum(r) FILTER (label = 'human') AS r1 FROM r GROUP BY feature),
v AS (SELECT feature, n1, n2, (r1 - n1 * (n1 + 1) / 2.0)::DOUBLE AS u FROM u)"""
_RANK = f"WITH {_RANKS} SELECT feature, n1, n2, round(u, 4) AS u, round(1 - u / (n1::DOUBLE * n2), 4) AS auc FROM v"


def roc_auc(spark, d):
    return _rounded(st.roc_auc(labelled(spark, d)))


_AUC = f"""WITH {_RANKS} SELECT feature, round(1 - u / (n1::DOUBLE * n2), 4) AS auc_raw, round(greatest(1 - u / (n1::DOUBLE * n2), u / (n1::DOUBLE * n2)), 4) AS auc_oriented,
  1 - u / (n1::DOUBLE * n2) >= 0.5 AS higher_means_ai, n1 + n2 AS n_scored FROM v WHERE n1 + n2 >= 20"""


def bh_adjust(spark, d):
    """Adjusted values of a score between 0 and 1 made from the effect sizes."""
    x = st.cohens_d(labelled(spark, d)).select("feature", F.greatest(F.lit(0.0), 1 - F.sqrt(F.abs("cohens_d"))).alias("p_raw"))
    return _rounded(st.benjamini_hochberg(x))


_BH = f"""WITH {_DS}, p AS (SELECT feature, greatest(0.0, 1 - sqrt(abs(cohens_d))) AS p_raw FROM d), r AS (SELECT *, row_number() OVER (ORDER BY p_raw, feature) AS rk, count(*) OVER () AS n FROM p)
SELECT feature, round(p_raw, 4) AS p_raw, round(greatest(0.0, least(1.0, min(p_raw * n / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING))), 4) AS p_adj FROM r"""


def separation(spark, d):
    return _rounded(st.separation(labelled(spark, d)))


def separation_stats(spark, d):
    """The table without the p values, for which SQL has no error function."""
    return separation(spark, d).drop("p_raw", "p_adj", "group")


_SEP = f"""WITH {_LONG}, g AS (SELECT feature, {_SIDES}, stddev_samp(value) FILTER (label = 'human') AS human_sd, stddev_samp(value) FILTER (label = 'ai') AS ai_sd,
  quantile_cont(value, [0.25, 0.5, 0.75]) FILTER (label = 'human') AS hp, quantile_cont(value, 0.5) FILTER (label = 'ai') AS ap FROM f GROUP BY feature), d AS (SELECT *, {_D} AS cohens_d FROM g WHERE n_human >= 5 AND n_ai >= 5)
SELECT feature, round(human_mean, 4) AS human_mean, round(human_sd, 4) AS human_sd, round(hp[1], 4) AS human_p25, round(hp[2], 4) AS human_p50, round(hp[3], 4) AS human_p75, round(ai_mean, 4) AS ai_mean,
  round(ai_sd, 4) AS ai_sd, round(ap, 4) AS ai_p50, round(cohens_d, 4) AS cohens_d, round(abs(cohens_d), 4) AS abs_d FROM d"""


def separation_top(spark, d):
    """The twenty features that separate most."""
    return _rounded(st.cohens_d(labelled(spark, d)).select("feature", F.abs("cohens_d").alias("abs_d")).orderBy(F.desc("abs_d"), "feature").limit(20))


_TOP = f"WITH {_DS} SELECT feature, round(abs(cohens_d), 4) AS abs_d FROM d ORDER BY abs(cohens_d) DESC, feature LIMIT 20"


def group_summary(spark, d):
    x = st.cohens_d(labelled(spark, d)).select(bl.feature_group(F.col("feature")).alias("group"), F.abs("cohens_d").alias("abs_d"))
    return _rounded(st.group_summary(x))


_GROUP_OF = "CASE " + " ".join(f"WHEN regexp_matches(feature, {s.q('^(?:' + '|'.join(p) + ')')}) THEN '{g}'" for g, p in lx.FEATURE_GROUPS) + " ELSE 'other' END"
_GSUM = f'WITH {_DS} SELECT {_GROUP_OF} AS "group", round(avg(abs(cohens_d)), 4) AS mean_abs_d, round(max(abs(cohens_d)), 4) AS max_abs_d, count(*) AS features FROM d GROUP BY 1'


def policy_rules(spark, d):
    return _rounded(st.policy_rules(st.separation(labelled(spark, d)), 0.05))


def length_balance(spark, d):
    return _rounded(st.length_balance(labelled(spark, d)))


_BALANCE = f"""WITH {_LONG}, g AS (SELECT {_SIDES}, quantile_cont(value, 0.5) FILTER (label = 'human') AS hm, quantile_cont(value, 0.5) FILTER (label = 'ai') AS am FROM f WHERE feature = 'n_words'), d AS (SELECT *, {_D} AS cohens_d FROM g)
SELECT round(hm, 4) AS human_median, round(am, 4) AS ai_median, round(cohens_d, 4) AS cohens_d, abs(cohens_d) > 0.8 AS severe, abs(cohens_d) > 0.3 AS notable FROM d WHERE n_human >= 3 AND n_ai >= 3"""


def profile_bands(spark, d):
    return _rounded(st.profile(labelled(spark, d)))


_PROFILE = f"""{_LONG}, pr AS (SELECT feature, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd, quantile_cont(value, [0.05, 0.25, 0.5, 0.75, 0.95]) AS p FROM f WHERE label = 'human' GROUP BY feature HAVING count(value) >= 5)"""
_BANDS = f"WITH {_PROFILE} SELECT feature, n, round(mean, 4) AS mean, round(sd, 4) AS sd, " + ", ".join(f"round(p[{i}], 4) AS p{q}" for i, q in enumerate(("05", "25", "50", "75", "95"), 1)) + " FROM pr"


def zscore_ranking(spark, d):
    """Drafts against the profile of the human side."""
    long = labelled(spark, d)
    x = sc.z_scores(long.filter("source = 'draft'"), st.profile(long), st.cohens_d(long))
    return _rounded(x.select("doc_id", "feature", "value", "z", "priority"))


_Z = f"""WITH {_PROFILE}, g AS (SELECT feature, {_SIDES} FROM f GROUP BY feature), d AS (SELECT feature, {_D} AS cohens_d FROM g),
z AS (SELECT doc_id, f.feature, value, (value - p[3]) / sd AS z, abs(cohens_d) AS weight FROM f JOIN pr USING (feature) JOIN d USING (feature) WHERE source = 'draft' AND value IS NOT NULL AND sd > 0 AND f.feature NOT IN {s.values(lx.LENGTH_FEATURES)})
SELECT doc_id, feature, round(value, 4) AS value, round(z, 4) AS z, round(abs(z) * (0.25 + weight), 4) AS priority FROM z"""


def zscore_length_gap(spark, d):
    """The same without measures that drift with length, for drafts less than half or more than twice as long as the median paper."""
    long = labelled(spark, d)
    drafts = long.filter("source = 'draft'")
    median = st.percentiles(long.filter("label = 'human' AND feature = 'n_words'"), "feature", "value", {"m": 0.5}).first()
    x = sc.length_gap(sc.z_scores(drafts, st.profile(long), st.cohens_d(long)), drafts.filter("feature = 'n_words'").select("doc_id", F.col("value").alias("n_words")), median["m"] if median else None)
    return _rounded(x.select("doc_id", "feature", "z"))


def within_one_sd(spark, d):
    long = labelled(spark, d)
    return sc.within_one(sc.z_scores(long.filter("source = 'draft'"), st.profile(long), st.cohens_d(long)))


_ZGAP = f"""WITH {_PROFILE}, g AS (SELECT feature, {_SIDES} FROM f GROUP BY feature),
n AS (SELECT doc_id, value AS n_words, (SELECT p[3] FROM pr WHERE feature = 'n_words') AS median FROM f WHERE source = 'draft' AND feature = 'n_words')
SELECT doc_id, feature, round((value - p[3]) / sd, 4) AS z FROM f JOIN pr USING (feature) JOIN g USING (feature) JOIN n USING (doc_id) WHERE source = 'draft' AND value IS NOT NULL AND sd > 0
  AND feature NOT IN {s.values(lx.LENGTH_FEATURES)} AND (n_words / median BETWEEN 0.5 AND 2 OR feature NOT IN {s.values(lx.LENGTH_SENSITIVE)})"""
_WITHIN = f"SELECT doc_id, count(*) FILTER (abs(z) <= 1) AS inside, count(*) AS features FROM ({_Z}) GROUP BY doc_id"


def replication(spark, d):
    return _rounded(st.replication(labelled(spark, d), ["pmc", "generated"]))


_REPL = f"""WITH {_LONG}, g AS (SELECT feature, {_SIDES} FROM f WHERE source IN ('pmc', 'generated') GROUP BY feature), p AS (SELECT feature, {_D} AS d1 FROM g WHERE n_human >= 5 AND n_ai >= 5 ORDER BY abs(d1) DESC, feature LIMIT 15),
h AS (SELECT * FROM f WHERE source NOT IN ('pmc', 'generated')), z AS (SELECT source, count(DISTINCT doc_id) FILTER (label = 'human') AS n_human, count(DISTINCT doc_id) FILTER (label = 'ai') AS n_ai FROM h GROUP BY source),
g2 AS (SELECT source, feature, {_SIDES} FROM h GROUP BY source, feature), d2 AS (SELECT source, feature, {_D} AS d2 FROM g2 WHERE n_human >= 5 AND n_ai >= 5)
SELECT source, n_human, n_ai, count(*) AS tested, count(*) FILTER ((d1 > 0) = (d2 > 0)) AS agree, round(count(*) FILTER ((d1 > 0) = (d2 > 0))::DOUBLE / count(*), 4) AS agreement
FROM d2 JOIN p USING (feature) JOIN z USING (source) WHERE n_human >= 10 AND n_ai >= 10 GROUP BY ALL"""


def constant_features(spark, d):
    """Features that vary, with their number of values."""
    v = st.varying(labelled(spark, d))
    return v.groupBy("feature").agg(F.count_distinct("value").alias("n_distinct"))


_VARY = f"WITH {_LONG} SELECT feature, count(DISTINCT value) AS n_distinct FROM f GROUP BY feature HAVING count(DISTINCT value) + max((value IS NULL)::INT) > 1"


def discriminative_model(spark, d):
    return _rounded(mo.discriminative(labelled(spark, d)))


def permutation_null(spark, d):
    return _rounded(mo.permutation_null(labelled(spark, d)))


def feature_group_counts(spark, d):
    """Measures and values by group."""
    f = bl.features_long(table(spark, d, "documents"))
    return f.groupBy(bl.feature_group(F.col("feature")).alias("feature_group")).agg(F.count_distinct("feature").alias("features"), F.count("value").alias("n_values"))


_GCOUNT = f"SELECT {_GROUP_OF} AS feature_group, count(DISTINCT feature) AS features, count(value) AS n_values FROM ({dc.ALL_MEASURES}) GROUP BY 1"


QUERIES = {
    "feature_group_counts": (feature_group_counts, _GCOUNT), "cohens_d": (cohens_d, _COHEN), "rank_sum_u": (rank_sum_u, _RANK), "roc_auc": (roc_auc, _AUC), "bh_adjust": (bh_adjust, _BH), "separation": (separation, None),
    "separation_stats": (separation_stats, _SEP), "separation_top": (separation_top, _TOP), "group_summary": (group_summary, _GSUM), "policy_rules": (policy_rules, None), "length_balance": (length_balance, _BALANCE),
    "profile_bands": (profile_bands, _BANDS), "zscore_ranking": (zscore_ranking, _Z), "zscore_length_gap": (zscore_length_gap, _ZGAP), "within_one_sd": (within_one_sd, _WITHIN), "replication": (replication, _REPL),
    "constant_features": (constant_features, _VARY), "discriminative_model": (discriminative_model, None), "permutation_null": (permutation_null, None),
}
