"""Queries over windows of sentences and over n-grams."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstat.functions import lexicons as lx
from inkstat.functions import text as tx
from inkstat.operators import ngrams as ng
from inkstat.operators import windows as wi
from inkstat.plans import sql as s
from inkstat.plans.documents import _rounded
from inkstat.runtime import table


def _docs(spark, d):
    return table(spark, d, "documents")


def _drafts(spark, d):
    """Drafts of the corpus, each once."""
    c = table(spark, d, "corpus").filter("lower(trim(source)) = 'draft' AND length(text) > 0")
    return c.select("doc_id", "text").dropDuplicates(["doc_id"])


_SENT = f"""{s.DOCS}, ss AS (SELECT doc_id, {s.sentences('text')} AS ss FROM docs), sr AS (SELECT doc_id, len(ss) AS total, unnest(range(len(ss))) AS pos, unnest(ss) AS sent FROM ss),
r AS (SELECT *, len(low) AS n, lead(len(low)) OVER (PARTITION BY doc_id ORDER BY pos) AS nn FROM (SELECT *, {s.lower_tokens('sent')} AS low FROM sr)),
v AS (SELECT doc_id, pos, total, sent, count(*) OVER w AS n_sentences, avg(n) OVER w AS m, coalesce(stddev_samp(n) OVER w, 0) AS sd, sum(n) OVER w AS words, max(n) OVER w - min(n) OVER w AS rg,
  coalesce(avg(abs(nn - n)) OVER i, 0) AS nd, flatten(list(low) OVER w) AS lw, list(low[1]) OVER w AS hs, sum({s.mark_count('sent', ',')}) OVER w AS cs FROM r
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), i AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
m AS (SELECT doc_id, pos::BIGINT AS win_start, n_sentences::BIGINT AS n_sentences, CASE WHEN length(sent) > 110 THEN substr(sent, 1, 110) || '...' ELSE sent END AS preview, m AS w_sent_len_mean,
  sd AS w_sent_len_sd, CASE WHEN m > 0 THEN sd / m ELSE 0 END AS w_sent_len_cv, rg::DOUBLE AS w_sent_len_range, nd AS w_neighbour_delta, len(list_distinct(lw))::DOUBLE / len(lw) AS w_ttr,
  1.0::DOUBLE - len(list_distinct(hs))::DOUBLE / len(hs) AS w_head_repeat, 1000.0 * cs / words AS w_comma_rate, words::DOUBLE AS w_n_words FROM v WHERE pos <= greatest(total - 8, 0) AND words > 0)"""


def window_metrics(spark, d):
    return _rounded(wi.window_metrics(_docs(spark, d)))


_METRICS = f"WITH {_SENT} SELECT doc_id, win_start, n_sentences, preview, " + ", ".join(f"round({c}::DOUBLE, 4) AS {c}" for c in wi.METRICS) + " FROM m"


def window_tails(spark, d):
    return _rounded(wi.window_tails(_docs(spark, d)), places=6)


_TAILS = f"WITH {_SENT} SELECT doc_id, count(*)::BIGINT AS n_windows, " + ", ".join(
    f"round(avg({c}), 6) AS {c}_mean, round(stddev_pop({c}), 6) AS {c}_sd, round(quantile_cont({c}, {0.95 if c in wi.HIGH_IS_UNIFORM else 0.05}), 6) AS {c}_worst, "
    f"round(quantile_cont({c}, {0.75 if c in wi.HIGH_IS_UNIFORM else 0.25}), 6) AS {c}_{'p75' if c in wi.HIGH_IS_UNIFORM else 'p25'}"
    for c in wi.METRICS
) + f", round(avg((w_sent_len_cv < {wi.UNIFORM_CV})::INT), 6) AS frac_uniform_windows FROM m GROUP BY doc_id"


def uniform_runs(spark, d):
    return _rounded(wi.uniform_runs(_docs(spark, d)))


_RUNS = f"""WITH {_SENT}, u AS (SELECT doc_id, (w_sent_len_cv < {wi.UNIFORM_CV}) AS u, sum((w_sent_len_cv >= {wi.UNIFORM_CV})::INT) OVER (PARTITION BY doc_id ORDER BY win_start) AS island FROM m),
g AS (SELECT doc_id, island, count(*) AS k, sum(u::INT) AS run FROM u GROUP BY ALL)
SELECT doc_id, sum(k)::BIGINT AS n_windows, max(run)::BIGINT AS longest_uniform_run, round(max(run)::DOUBLE / sum(k), 4) AS longest_uniform_run_frac FROM g GROUP BY doc_id"""


def uniform_passages(spark, d):
    return _rounded(wi.most_uniform(_docs(spark, d)).select("doc_id", "place", "win_start", "preview", "w_sent_len_mean"))


_PASSAGES = f"""WITH {_SENT}, p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w_sent_len_cv, win_start) AS place FROM m)
SELECT doc_id, place::INTEGER AS place, win_start, preview, round(w_sent_len_mean, 4) AS w_sent_len_mean FROM p WHERE place <= 3"""


_GRAMS = f"""w AS (SELECT doc_id, {s.lower_tokens('text')} AS low FROM documents WHERE text IS NOT NULL),
g1 AS (SELECT unnest(low) AS gram FROM w), g2 AS (SELECT unnest(list_transform(range(1, len(low)), lambda i: low[i] || ' ' || low[i + 1])) AS gram FROM w),
g3 AS (SELECT unnest(list_transform(range(1, len(low) - 1), lambda i: low[i] || ' ' || low[i + 1] || ' ' || low[i + 2])) AS gram FROM w),
uni AS (SELECT gram, count(*) AS n FROM g1 GROUP BY gram HAVING count(*) >= 2), bi AS (SELECT gram, count(*) AS n FROM g2 GROUP BY gram HAVING count(*) >= 5),
tri AS (SELECT gram, count(*) AS n FROM g3 GROUP BY gram HAVING count(*) >= 4), total AS (SELECT sum(len(low)) AS total FROM w),
forms AS (SELECT gram, n, 1e6 * n / total AS per_million FROM tri, total WHERE len(list_filter(string_split(gram, ' '), lambda x: x IN {s.values(lx.FUNCTION_WORDS)})) >= 2
  AND len(list_filter(string_split(gram, ' '), lambda x: length(x) >= 14)) = 0 ORDER BY n DESC, gram DESC LIMIT 60),
drafts AS (SELECT DISTINCT ON (doc_id) doc_id, text FROM corpus WHERE lower(trim(source)) = 'draft' AND length(text) > 0),
dw AS (SELECT doc_id, text, {s.lower_tokens('text')} AS low FROM drafts),
dt AS (SELECT doc_id, list_transform(range(1, len(low) - 1), lambda i: low[i] || ' ' || low[i + 1] || ' ' || low[i + 2]) AS has FROM dw)"""


def ngram_reference(spark, d):
    return ng.reference(_docs(spark, d)).withColumn("size", F.col("size").cast("bigint"))


_REFERENCE = f"WITH {_GRAMS} SELECT 1::BIGINT AS size, gram, n FROM uni UNION ALL SELECT 2, gram, n FROM bi UNION ALL SELECT 3, gram, n FROM tri"


def missing_formulas(spark, d):
    return _rounded(ng.missing_formulas(_drafts(spark, d), _docs(spark, d)))


_MISSING = f"WITH {_GRAMS} SELECT doc_id, gram, round(per_million, 4) AS per_million FROM dt, forms WHERE NOT list_contains(has, gram)"


def formula_coverage(spark, d):
    return _rounded(ng.formula_coverage(_drafts(spark, d), _docs(spark, d)))


_COVERAGE = f"""WITH {_GRAMS}, c AS (SELECT doc_id, (60 - count(gram)) / 60.0 AS coverage FROM dt LEFT JOIN forms ON NOT list_contains(has, gram) GROUP BY doc_id)
SELECT doc_id, round(coverage::DOUBLE, 4) AS coverage, CASE WHEN coverage < 0.07 THEN 'low' ELSE 'in range' END AS verdict FROM c"""


def missing_shown(spark, d):
    return _rounded(ng.missing_shown(_drafts(spark, d), _docs(spark, d), low=0.5))


_SHOWN = f"""WITH {_GRAMS}, m AS (SELECT doc_id, gram, per_million FROM dt, forms WHERE NOT list_contains(has, gram)), l AS (SELECT doc_id FROM m GROUP BY doc_id HAVING (60 - count(*)) / 60.0 < 0.5)
SELECT doc_id, place, gram, round(per_million, 4) AS per_million FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY per_million DESC, gram DESC) AS place FROM m SEMI JOIN l USING (doc_id)) WHERE place <= 8"""


def unattested_pairs(spark, d):
    return ng.unattested_pairs(_drafts(spark, d), _docs(spark, d))


_PAIRS = f"""WITH {_GRAMS}, p AS (SELECT doc_id, unnest(list_transform(range(1, len(low)), lambda i: low[i] || ' ' || low[i + 1])) AS gram FROM dw), c AS (SELECT doc_id, gram, count(*) AS n FROM p GROUP BY ALL)
SELECT doc_id, gram, n FROM c ANTI JOIN bi USING (gram) WHERE n >= 2 AND length(split_part(gram, ' ', 1)) >= 3 AND length(split_part(gram, ' ', 2)) >= 3
  AND NOT (split_part(gram, ' ', 1) IN {s.values(lx.FUNCTION_WORDS)} AND split_part(gram, ' ', 2) IN {s.values(lx.FUNCTION_WORDS)})"""


def oov_words(spark, d):
    return _rounded(ng.out_of_vocabulary(_drafts(spark, d), table(spark, d, "vocabulary")))


_OOV = f"""WITH {_GRAMS}, t AS (SELECT sum(n) AS total FROM vocabulary), p AS (SELECT doc_id, unnest(low) AS word FROM dw), c AS (SELECT doc_id, word, count(*) AS used FROM p
  WHERE length(word) >= 4 AND word NOT IN {s.values(lx.FUNCTION_WORDS)} GROUP BY ALL)
SELECT doc_id, word, used, round(1e6 * coalesce(n, 0) / total, 4) AS per_million FROM c LEFT JOIN vocabulary USING (word), t WHERE 1e6 * coalesce(n, 0) / total < 1.0"""


def oov_report(spark, d):
    """The twelve rarest words of each draft and how many are absent."""
    from pyspark.sql import Window as W

    x = ng.out_of_vocabulary(_drafts(spark, d), table(spark, d, "vocabulary"))
    every = W.partitionBy("doc_id")
    x = x.withColumns({"place": F.row_number().over(every.orderBy("per_million", F.desc("used"), "word")), "absent": F.count_if(F.col("per_million") == 0).over(every)})
    return _rounded(x.filter("place <= 12")).select("doc_id", F.col("place").cast("bigint").alias("place"), "word", "used", "absent")


_OOV_REPORT = f"""WITH o AS ({_OOV}), x AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY per_million, used DESC, word) AS place, word, used,
  count(*) FILTER (per_million = 0) OVER (PARTITION BY doc_id) AS absent FROM o) SELECT * FROM x WHERE place <= 12"""


def continuations(spark, d):
    return ng.continuations(_drafts(spark, d), _docs(spark, d))


_GAP = rf"([.!?]){tx.WS}+([A-Z])"
_CONT = f"""WITH {_GRAMS}, sp AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, {s.q(rf'{tx.WS}*' + chr(10) + rf'{tx.WS}*')}, ' ', 'g'), {s.q(_GAP)}, chr(92) || '1' || chr(1) || chr(92) || '2', 'g'), chr(1)) AS ss FROM drafts),
st AS (SELECT doc_id, sent_no, {s.lower_tokens('sent')} AS low FROM (SELECT doc_id, unnest(range(len(ss))) AS sent_no, unnest(ss) AS sent FROM sp) WHERE len(regexp_extract_all(sent, {s.q(f'{tx.NOT_WS}+')})) > 3),
g AS (SELECT doc_id, sent_no, unnest(list_transform(range(1, len(low) - 1), lambda i: low[i] || ' ' || low[i + 1] || ' ' || low[i + 2])) AS gram FROM st),
k AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, word) AS place FROM (SELECT split_part(gram, ' ', 1) || ' ' || split_part(gram, ' ', 2) AS pair, split_part(gram, ' ', 3) AS word, n FROM tri)),
top AS (SELECT pair, string_agg(word || ' (' || n || ')', ', ' ORDER BY place) AS suggestions FROM k WHERE place <= 4 GROUP BY pair)
SELECT doc_id, sent_no::BIGINT AS sent_no, g.gram, bi.gram IS NOT NULL AS attested_pair, coalesce(suggestions, '') AS suggestions FROM (SELECT *, split_part(gram, ' ', 1) || ' ' || split_part(gram, ' ', 2) AS pair FROM g ANTI JOIN tri USING (gram)) g
LEFT JOIN top USING (pair) LEFT JOIN bi ON bi.gram = pair"""


def phrase_locations(spark, d):
    """Every stock phrase in every line: line number, phrase and up to 35 characters on either side."""
    from inkstat.operators.scoring import phrase_hits

    return phrase_hits(_docs(spark, d))


QUERIES = {
    "window_metrics": (window_metrics, _METRICS), "window_tails": (window_tails, _TAILS), "uniform_runs": (uniform_runs, _RUNS), "uniform_passages": (uniform_passages, _PASSAGES),
    "ngram_reference": (ngram_reference, _REFERENCE), "missing_formulas": (missing_formulas, _MISSING), "formula_coverage": (formula_coverage, _COVERAGE), "missing_shown": (missing_shown, _SHOWN),
    "unattested_pairs": (unattested_pairs, _PAIRS), "oov_words": (oov_words, _OOV), "oov_report": (oov_report, _OOV_REPORT), "continuations": (continuations, _CONT),
    "phrase_locations": (phrase_locations, None),
}
