"""Queries that prepare a corpus, flatten outside scores, count requests and measure citing."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkstat.functions import lexicons as lx
from inkstat.functions import text as tx
from inkstat.operators import citations as ci
from inkstat.operators import payloads as pa
from inkstat.operators import preparation as pr
from inkstat.operators import statistics as st
from inkstat.plans import sql as s
from inkstat.plans.documents import _rounded
from inkstat.runtime import table


def _meta(spark, d):
    """``(doc_id, label, source, mirrors)`` of the corpus, each document once; meta that is not JSON mirrors nothing."""
    c = table(spark, d, "corpus")
    m = F.try_variant_get(F.try_parse_json("meta"), "$.mirrors", "string")
    return c.select("doc_id", F.lower("label").alias("label"), F.lower(F.trim("source")).alias("source"), m.alias("mirrors")).dropDuplicates(["doc_id"])


_META = """m AS (SELECT DISTINCT ON (doc_id) doc_id, lower(label) AS label, lower(trim(source)) AS source, CASE WHEN json_valid(meta) THEN meta->>'$.mirrors' END AS mirrors FROM corpus)"""


def corpus_census(spark, d):
    return _meta(spark, d).groupBy("label", "source").agg(F.count("*").alias("n"))


_CENSUS = f"WITH {_META} SELECT label, source, count(*) AS n FROM m GROUP BY ALL"


def paired_semi(spark, d):
    return st.paired(_meta(spark, d)).select("doc_id", "label")


_PAIRED = f"""WITH {_META}, k AS (SELECT DISTINCT mirrors FROM m WHERE label = 'ai' AND mirrors IS NOT NULL)
SELECT doc_id, label FROM m WHERE label IS DISTINCT FROM 'human' OR doc_id IN (SELECT mirrors FROM k) OR (SELECT count(*) FROM k) = 0"""


def resume_anti(spark, d):
    """Papers nothing was generated for yet."""
    m = _meta(spark, d)
    return pr.resume(m.filter("source = 'pmc'"), m.filter("mirrors IS NOT NULL")).select("doc_id")


_RESUME = f"WITH {_META} SELECT doc_id FROM m WHERE source = 'pmc' AND doc_id NOT IN (SELECT mirrors FROM m WHERE mirrors IS NOT NULL)"


def upsert(spark, d):
    """Generated rows, those of one model replaced by a new batch."""
    m = _meta(spark, d).filter("label = 'ai'").select("doc_id", "mirrors")
    batch = m.filter("mirrors IS NOT NULL AND doc_id LIKE 'ai:tern-7b:%'").select(F.concat(F.lit("new:"), "doc_id").alias("doc_id"), "mirrors")
    return pr.upsert(m, batch)


_UPSERT = f"""WITH {_META}, a AS (SELECT doc_id, mirrors FROM m WHERE label = 'ai'), b AS (SELECT 'new:' || doc_id AS doc_id, mirrors FROM a WHERE mirrors IS NOT NULL AND doc_id LIKE 'ai:tern-7b:%')
SELECT * FROM a WHERE mirrors IS NULL OR mirrors NOT IN (SELECT mirrors FROM b) UNION ALL SELECT * FROM b"""


def source_filter(spark, d):
    return _meta(spark, d).filter(F.col("source").isin("pmc", "arxiv")).select("doc_id", "source")


def held_out_sources(spark, d):
    """Sources of the corpus that are not among those compared."""
    m = _meta(spark, d).select("source").filter("source IS NOT NULL").distinct()
    compared = _meta(spark, d).select("source").filter("source IN ('pmc', 'generated')").distinct()
    return m.join(compared, "source", "left_anti")


def word_floor(spark, d):
    return pr.word_floor(table(spark, d, "corpus").filter("text IS NOT NULL")).select("doc_id").distinct()


_FLOOR = f"SELECT DISTINCT doc_id FROM corpus WHERE len({s.WORDS}) >= 200"


def group_cap(spark, d):
    return pr.capped(_meta(spark, d), 5, "label", "source").select("doc_id", "label", "source")


_CAP = f"WITH {_META} SELECT doc_id, label, source FROM m QUALIFY row_number() OVER (PARTITION BY label, source ORDER BY doc_id) <= 5"


def strided_shards(spark, d):
    """The second of four shards in order of length."""
    return pr.strided(table(spark, d, "documents"), 4, 1, F.coalesce(F.length("text"), F.lit(0))).select("doc_id")


_STRIDE = "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY coalesce(length(text), 0), doc_id) - 1 AS i FROM documents) WHERE i % 4 = 1"


def _lengths(spark, d):
    c = table(spark, d, "corpus").filter("lower(label) IN ('human', 'ai') AND text IS NOT NULL")
    return c.select("doc_id", F.lower("label").alias("label"), tx.count(F.col("text"), f"{tx.NOT_WS}+").alias("n_words")).dropDuplicates(["doc_id"])


def length_matched(spark, d):
    """Rows kept in each bin and label."""
    return pr.length_matched(_lengths(spark, d)).groupBy("bin", "label").agg(F.count("*").alias("n")).withColumn("bin", F.col("bin").cast("bigint"))


_MATCH = f"""WITH l AS (SELECT DISTINCT ON (doc_id) doc_id, lower(label) AS label, len({s.WORDS}) AS n_words FROM corpus WHERE lower(label) IN ('human', 'ai') AND text IS NOT NULL),
e AS (SELECT list_sort(list_distinct(quantile_cont(n_words, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1]))) AS e FROM l),
b AS (SELECT label, least(greatest(len(list_filter(e, lambda x: x <= n_words)) - 1, 0), len(e) - 2) AS bin FROM l, e), n AS (SELECT bin, label, count(*) AS c FROM b GROUP BY ALL),
k AS (SELECT bin, least(coalesce(sum(c) FILTER (label = 'human'), 0), coalesce(sum(c) FILTER (label = 'ai'), 0)) AS k FROM n GROUP BY bin)
SELECT bin::BIGINT AS bin, label, least(c, k)::BIGINT AS n FROM n JOIN k USING (bin) WHERE k > 0"""


def usable_titles(spark, d):
    """Papers with a title, as prompts. The corpus has no text of 800 words, the floor of the operator, so 150 is asked for."""
    return pr.usable_titles(table(spark, d, "corpus").filter("lower(trim(source)) = 'pmc'"), 150)


def length_ratios(spark, d):
    """Words of generated texts over the words asked for."""
    c = table(spark, d, "corpus").filter("lower(label) = 'ai' AND text IS NOT NULL")
    t = F.coalesce(F.try_variant_get(F.try_parse_json("meta"), "$.target_words", "int"), F.lit(0))
    return _rounded(pr.length_ratios(c.select("doc_id", "text", t.alias("target_words")).distinct()))


_RATIOS = f"""WITH c AS (SELECT DISTINCT doc_id, text, coalesce(CASE WHEN json_valid(meta) THEN try_cast(meta->>'$.target_words' AS INT) END, 0) AS t FROM corpus WHERE lower(label) = 'ai' AND text IS NOT NULL),
r AS (SELECT list_sort(list(len({s.WORDS})::DOUBLE / t)) AS r FROM c WHERE t > 0)
SELECT len(r)::BIGINT AS n, round(r[len(r) // 10 + 1], 4) AS p10, round(r[len(r) // 2 + 1], 4) AS median, round(r[9 * len(r) // 10 + 1], 4) AS p90, r[len(r) // 2 + 1] < 0.7 AS short FROM r WHERE len(r) > 0"""


def draft_registers(spark, d):
    """Drafts by the register they are read in."""
    r = F.try_variant_get(F.try_parse_json("meta"), "$.register", "string")
    t = table(spark, d, "corpus").filter("lower(trim(source)) = 'draft'").select("doc_id", pr.draft_register(r).alias("register")).distinct()
    return t.groupBy("register").agg(F.count("*").alias("n"))


_REGISTERS = """SELECT CASE WHEN r IN ('paper', 'letter', 'docs') THEN r ELSE 'paper' END AS register, count(DISTINCT doc_id) AS n
FROM (SELECT doc_id, CASE WHEN json_valid(meta) THEN meta->>'$.register' END AS r FROM corpus WHERE lower(trim(source)) = 'draft') GROUP BY 1"""


def vocabulary_guard(spark, d):
    """The vocabulary numbered twice, the second time without its rare words: two models of these could not be compared."""
    v = table(spark, d, "vocabulary").filter("word IS NOT NULL").groupBy("word").agg(F.max("n").alias("n"))
    return pa.same_vocabulary(v.select("word", F.xxhash64("word").alias("id")), v.filter("n >= 20").select("word", F.xxhash64("word").alias("id")))


_GUARD = """WITH v AS (SELECT word, max(n) AS n FROM vocabulary WHERE word IS NOT NULL GROUP BY word)
SELECT count(*) FILTER (n < 20 OR n IS NULL) = 0 AS same, count(*) FILTER (n < 20 OR n IS NULL) AS only_observer, 0::BIGINT AS only_performer FROM v"""


def detector_fan_out(spark, d):
    """Two stand-in detectors over all documents; the second fails on texts without a full stop."""
    return pa.fan_out(table(spark, d, "documents"), {"length": lambda t: len(t) / 1000, "stops": lambda t: 1 / t.count(".")}).transform(_rounded)


_FAN = """SELECT doc_id, round(CASE WHEN length(text) > 0 THEN length(text) / 1000 END, 4) AS det_length, NULL::DOUBLE AS det_length_error,
  round(CASE WHEN k > 0 THEN 1.0::DOUBLE / k END, 4) AS det_stops, CASE WHEN length(text) > 0 AND k = 0 THEN 1.0::DOUBLE END AS det_stops_error
FROM (SELECT doc_id, text, length(text) - length(replace(text, '.', '')) AS k FROM documents)"""


def token_curvature(spark, d):
    """Curvature of each document against the mean and variance of its own tokens' neighbourhood of rank, which stand in for those of a
    model's distribution."""
    t = pa.token_rows(table(spark, d, "token_lm")).filter("lp IS NOT NULL AND rk IS NOT NULL")
    return _rounded(pa.curvature(t.select("doc_id", F.col("lp").alias("logprob"), (-F.ln("rk")).alias("mu"), F.ln(F.col("rk") + 1).alias("var"))))


def token_ratio(spark, d):
    """Mean surprise over the mean surprise by rank, which stands in for a second model's."""
    t = pa.token_rows(table(spark, d, "token_lm")).filter("lp IS NOT NULL AND rk IS NOT NULL")
    return _rounded(pa.cross_ratio(t.select("doc_id", F.col("lp").alias("logprob"), F.ln(F.col("rk") + 1).alias("cross_entropy"))))


def seeded_sample(spark, d):
    """Twenty documents, the same on every engine that has the hash."""
    return pr.sampled(table(spark, d, "documents"), 20).select("doc_id")


def accepted_generations(spark, d):
    c = table(spark, d, "corpus").filter("lower(label) = 'ai' AND text IS NOT NULL")
    t = F.coalesce(F.try_variant_get(F.try_parse_json("meta"), "$.target_words", "int"), F.lit(0))
    return pr.accepted(c.withColumn("target_words", t), 50).select("doc_id").distinct()


_ACCEPTED = f"""SELECT DISTINCT doc_id FROM corpus WHERE lower(label) = 'ai' AND len({s.WORDS}) >= 50
  AND len({s.WORDS}) >= 0.6 * coalesce(CASE WHEN json_valid(meta) THEN try_cast(meta->>'$.target_words' AS INT) END, 0)"""


def repeat_guard(spark, d):
    """Whether the last paragraph of a text begins as something earlier in it does."""
    t = table(spark, d, "corpus").filter("text IS NOT NULL").select("doc_id", "text").dropDuplicates(["doc_id"])
    p = F.split("text", "\n\n", -1)
    x = t.withColumn("p", p).filter(F.size("p") > 1)
    return x.select("doc_id", pr.repeats_existing(F.array_join(F.slice("p", 1, F.size("p") - 1), "\n\n"), F.element_at("p", -1)).alias("repeats"))


def draft_limits(spark, d):
    t = table(spark, d, "corpus").filter("lower(trim(source)) = 'draft'").select("doc_id", "text").dropDuplicates(["doc_id"])
    return t.select("doc_id", pr.draft_status(F.col("text")).cast("bigint").alias("status"))


_LIMITS = f"""WITH t AS (SELECT DISTINCT ON (doc_id) doc_id, text FROM corpus WHERE lower(trim(source)) = 'draft')
SELECT doc_id, (CASE WHEN text IS NULL OR len({s.WORDS}) < 5 THEN 400 WHEN len({s.WORDS}) > 5000 OR length(text) > 40000 THEN 413 ELSE 200 END)::BIGINT AS status FROM t"""


def quota_daily(spark, d):
    return pr.daily_quota(table(spark, d, "quota_requests")).withColumn("day", F.col("day").cast("string"))


_QUOTA = """WITH r AS (SELECT seq, min(ts) AS ts, min(visitor_key) AS visitor_key FROM quota_requests WHERE upstream_ok AND coalesce(pass_no, 1) = 1 GROUP BY seq),
k AS (SELECT seq, ts::DATE AS day, coalesce(visitor_key, 'unknown') AS visitor_key FROM r), a AS (SELECT *, row_number() OVER (PARTITION BY day, visitor_key ORDER BY seq) AS i FROM k QUALIFY i <= 3)
SELECT seq, day::VARCHAR AS day, visitor_key FROM a QUALIFY row_number() OVER (PARTITION BY day ORDER BY seq) <= 200"""


def quota_summary(spark, d):
    """Requests and words of each day and pass, each delivery once."""
    r = table(spark, d, "quota_requests").groupBy("seq").agg(F.min("ts").alias("ts"), F.min("pass_no").alias("pass_no"), F.max("draft_words").alias("w"))
    return r.groupBy(F.to_date("ts").cast("string").alias("day"), F.col("pass_no").cast("bigint").alias("pass_no")).agg(F.count("*").alias("n"), F.sum(F.coalesce("w", F.lit(0))).cast("bigint").alias("words"))


_QSUM = """WITH r AS (SELECT seq, min(ts) AS ts, min(pass_no) AS pass_no, max(draft_words) AS w FROM quota_requests GROUP BY seq)
SELECT ts::DATE::VARCHAR AS day, pass_no::BIGINT AS pass_no, count(*) AS n, sum(coalesce(w, 0))::BIGINT AS words FROM r GROUP BY ALL"""


def word_budget(spark, d):
    return pr.word_budget(table(spark, d, "quota_requests"), 2000)


def lm_features(spark, d):
    return _rounded(pa.lm_features(table(spark, d, "token_lm")), places=6)


_TOK = """t AS (SELECT doc_id, tok_pos, max(CASE WHEN isfinite(logprob) THEN logprob END) AS lp, max(CASE WHEN NOT isnan(tok_rank) AND tok_rank >= 1 THEN tok_rank END) AS rk FROM token_lm WHERE doc_id IS NOT NULL AND tok_pos IS NOT NULL GROUP BY ALL)"""
_LM = f"""WITH {_TOK}, d AS (SELECT *, abs(lp - lag(lp) OVER (PARTITION BY doc_id ORDER BY tok_pos)) AS d FROM t WHERE lp IS NOT NULL),
g AS (SELECT doc_id, avg(lp) AS m, stddev_pop(lp) AS sd, quantile_cont(lp, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p, avg((lp < -5)::INT) AS sf, count(*)::DOUBLE AS n, coalesce(avg(d), 0) AS nd,
  avg((rk > 0 AND rk <= 10)::INT) AS r1, avg((rk > 10 AND rk <= 100)::INT) AS r2, avg((rk > 100 AND rk <= 1000)::INT) AS r3, avg((rk > 1000)::INT) AS r4, avg(ln(rk)) AS lm, stddev_pop(ln(rk)) AS ls FROM d GROUP BY doc_id)
SELECT doc_id, round(exp(-m), 6) AS lm_ppl, round(m, 6) AS lm_logprob_mean, round(sd, 6) AS lm_logprob_sd, round(CASE WHEN m <> 0 THEN sd / abs(m) ELSE 0 END, 6) AS lm_logprob_cv, round(p[1], 6) AS lm_logprob_p10,
  round(p[3], 6) AS lm_logprob_p50, round(p[5], 6) AS lm_logprob_p90, round(p[4] - p[2], 6) AS lm_logprob_iqr, round(sf, 6) AS lm_surprise_frac, n AS lm_n_tokens, round(nd, 6) AS lm_logprob_neighbour_delta,
  round(r1, 6) AS lm_rank_top10_frac, round(r2, 6) AS lm_rank_top100_frac, round(r3, 6) AS lm_rank_top1000_frac, round(r4, 6) AS lm_rank_beyond1000_frac, round(lm, 6) AS lm_log_rank_mean, round(ls, 6) AS lm_log_rank_sd FROM g"""


def context_windows(spark, d):
    x = pa.context_windows(table(spark, d, "token_lm"))
    return x.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in x.columns if c != "doc_id"])


_CURVATURE = f"""WITH {_TOK} SELECT doc_id, round(sum(lp + ln(rk)) / sqrt(greatest(sum(ln(rk + 1)), 1e-9)), 4) AS det_curvature FROM t WHERE lp IS NOT NULL AND rk IS NOT NULL GROUP BY doc_id"""
_RATIO = f"""WITH {_TOK} SELECT doc_id, round(avg(-lp) / nullif(avg(ln(rk + 1)), 0), 4) AS det_ratio FROM t WHERE lp IS NOT NULL AND rk IS NOT NULL GROUP BY doc_id"""
_CTX = f"""WITH {_TOK}, n AS (SELECT doc_id, max(tok_pos) + 1 AS n FROM t GROUP BY doc_id HAVING n >= 2), w AS (SELECT doc_id, n, unnest(range((greatest(ceil((n - 512) / 256.0), 0) + 1)::BIGINT)) AS win FROM n),
x AS (SELECT doc_id, win, win * 256 AS start, least(win * 256 + 512, n)::BIGINT AS "end", (CASE WHEN win = 0 THEN 1 ELSE least((win - 1) * 256 + 512, n) END)::BIGINT AS first_scored FROM w)
SELECT doc_id, win, start, "end", first_scored, "end" - first_scored AS n_scored FROM x"""


def chunk_scores(spark, d):
    return _rounded(pa.chunk_scores(table(spark, d, "token_lm")))


_CHUNK = f"""WITH {_TOK}, c AS (SELECT doc_id, tok_pos // 512 AS chunk, count(*) AS n, avg(lp) AS m FROM t WHERE lp IS NOT NULL GROUP BY ALL), k AS (SELECT *, max((n >= 16)::INT) OVER (PARTITION BY doc_id) AS l FROM c)
SELECT doc_id, round(avg(1 / (1 + exp(-(m + 3)))), 4) AS det_chunks FROM k WHERE n >= 16 OR (l = 0 AND chunk = 0) GROUP BY doc_id"""


def detector_answers(spark, d):
    return _rounded(pa.detector_answers(table(spark, d, "detector_payloads")), places=6)


_NUM = "CASE WHEN json_type({0}) IN ('DOUBLE', 'BIGINT', 'UBIGINT', 'HUGEINT') THEN ({0})::DOUBLE END"
_DET = f"""WITH p AS (SELECT DISTINCT doc_id, attempt, fetched_at, payload FROM detector_payloads WHERE doc_id IS NOT NULL AND payload IS NOT NULL AND json_valid(payload)),
q AS (SELECT doc_id, attempt, fetched_at, payload, payload::JSON->'$.documents[0]' AS doc FROM p),
r AS (SELECT * FROM q WHERE doc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY attempt DESC, fetched_at DESC, payload) = 1),
v AS (SELECT doc_id, doc, list_sort(list_filter(list_transform(CASE WHEN json_type(doc->'$.sentences') = 'ARRAY' THEN (doc->'$.sentences')::JSON[] ELSE [] END,
  lambda x: {_NUM.format("(x->'$.generated_prob')")}), lambda y: y IS NOT NULL)) AS s FROM r)
SELECT doc_id, round({_NUM.format("(doc->'$.completely_generated_prob')")}, 6) AS completely_generated_prob, round({_NUM.format("(doc->'$.class_probabilities.ai')")}, 6) AS prob_ai,
  round({_NUM.format("(doc->'$.class_probabilities.human')")}, 6) AS prob_human, round({_NUM.format("(doc->'$.class_probabilities.mixed')")}, 6) AS prob_mixed, doc->>'$.predicted_class' AS predicted_class,
  len(s) AS n_sentences_scored, round(list_sum(s) / len(s), 6) AS sent_prob_mean, round(s[len(s) // 2 + 1], 6) AS sent_prob_median, round(s[floor(0.9 * (len(s) - 1))::INT + 1], 6) AS sent_prob_p90,
  round(len(list_filter(s, lambda x: x > 0.5))::DOUBLE / len(s), 6) AS sent_frac_over_half FROM v"""


def detector_medians(spark, d):
    return _rounded(pa.probe_medians(pa.detector_answers(table(spark, d, "detector_payloads")), table(spark, d, "corpus")), places=6)


_MED = f"""WITH a AS ({_DET}), m AS (SELECT DISTINCT ON (doc_id) doc_id, lower(trim(source)) AS source FROM corpus)
SELECT source, count(completely_generated_prob) AS n, round(quantile_cont(completely_generated_prob, 0.5), 6) AS median_prob FROM a JOIN m USING (doc_id) GROUP BY source"""


def _parse(spark, d):
    """A parse made by rule, as no parser is there: heads are the next word, the last word is the root; tags by ending."""
    x = table(spark, d, "documents").filter(F.length("text") > 0)
    t = x.select("doc_id", F.posexplode(tx.sentences(F.col("text"))).alias("sent", "s")).select("doc_id", "sent", F.size(tx.tokens(F.col("s"))).alias("n"), F.posexplode(tx.lower_tokens(F.col("s"))).alias("tok", "w"))
    pos = F.when(F.col("w").endswith("ed"), "VERB").when(F.col("w").endswith("ly"), "ADV").when(F.col("w").isin("of", "in", "at", "for"), "ADP").when(F.col("w").endswith("al"), "ADJ").otherwise("NOUN")
    dep = F.when(F.col("tok") == F.col("n") - 1, "ROOT").when(F.col("w") == "and", "cc").when(F.col("w") == "was", "auxpass").otherwise("dep")
    return t.select("doc_id", "sent", "tok", pos.alias("pos"), dep.alias("dep"), F.least(F.col("tok") + 1, F.col("n") - 1).alias("head"), F.lit(False).alias("is_punct"), F.lit(False).alias("is_space"))


def syntax_block(spark, d):
    return _rounded(pa.syntax_features(_parse(spark, d)))


_SYN = f"""WITH {s.DOCS}, ss AS (SELECT doc_id, {s.sentences('text')} AS ss FROM docs), t AS (SELECT doc_id, sent, {s.lower_tokens('s')} AS l FROM (SELECT doc_id, unnest(range(len(ss))) AS sent, unnest(ss) AS s FROM ss)),
w AS (SELECT doc_id, sent, len(l) AS n, unnest(range(len(l))) AS tok, unnest(l) AS w FROM t),
x AS (SELECT *, CASE WHEN w LIKE '%ed' THEN 'VERB' WHEN w LIKE '%ly' THEN 'ADV' WHEN w IN ('of', 'in', 'at', 'for') THEN 'ADP' WHEN w LIKE '%al' THEN 'ADJ' ELSE 'NOUN' END AS pos FROM w),
dd AS (SELECT doc_id, avg(d) AS m, stddev_pop(d) AS sd, count(*) AS roots FROM (SELECT doc_id, sent, least(max(n) - 1, 100) AS d FROM x GROUP BY ALL) GROUP BY doc_id),
o AS (SELECT doc_id, sum(-p * log2(p)) AS e FROM (SELECT doc_id, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY doc_id) AS p FROM x WHERE tok = 0 GROUP BY doc_id, pos) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (w = 'was' AND tok < n - 1) AS pas, count(*) FILTER (w = 'and' AND tok < n - 1) AS cc, count(*) FILTER (pos = 'NOUN') AS no, count(*) FILTER (pos = 'VERB') AS ve,
  count(*) FILTER (pos = 'ADJ') AS aj, count(*) FILTER (pos = 'ADV') AS av, count(*) FILTER (pos = 'ADP') AS ap FROM x GROUP BY doc_id)
SELECT doc_id, round(m, 4) AS dep_depth_mean, round(sd, 4) AS dep_depth_sd, round(pas::DOUBLE / roots, 4) AS passive_per_clause, 0.0::DOUBLE AS subordination_rate, round(1000.0 * cc / n, 4) AS coordination_rate,
  round(1000.0 * no / n, 4) AS noun_rate, round(1000.0 * ve / n, 4) AS verb_rate, round(1000.0 * aj / n, 4) AS adj_rate, round(1000.0 * av / n, 4) AS adv_rate, round(1000.0 * ap / n, 4) AS adp_rate,
  round(CASE WHEN ve > 0 THEN no::DOUBLE / ve ELSE 0 END, 4) AS noun_verb_ratio, round(e, 4) AS opener_pos_entropy FROM g JOIN dd USING (doc_id) JOIN o USING (doc_id)"""


def citation_density(spark, d):
    return _rounded(ci.density(table(spark, d, "corpus")))


_CT = "t AS (SELECT DISTINCT ON (doc_id) doc_id, replace(text, chr(10), ' ') AS text FROM corpus WHERE length(text) > 0)"
_MARK = ci.MARKER
_CSENT = f"""{_CT}, sp AS (SELECT doc_id, string_split(regexp_replace(text, {s.q(rf"([.!?]){tx.WS}+([A-Z])")}, chr(92) || '1' || chr(1) || chr(92) || '2', 'g'), chr(1)) AS ss FROM t),
se AS (SELECT doc_id, pos, sent, len(regexp_extract_all(sent, {s.q(_MARK)})) AS markers FROM (SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sent FROM sp) WHERE len(regexp_extract_all(sent, {s.q(f'{tx.NOT_WS}+')})) BETWEEN 5 AND 90)"""
_DENS = f"""WITH {_CSENT}, c AS (SELECT doc_id, count(*) FILTER (markers > 0) AS citing, count(*) AS n FROM se GROUP BY doc_id)
SELECT doc_id, {s.n_tokens('text')} AS words, {s.count('text', _MARK)} AS markers, round({s.rate(s.count('text', _MARK), s.n_tokens('text'))}, 4) AS per_1000, round(coalesce(citing::DOUBLE / n, 0), 4) AS citing_share,
  {s.count("' ' || text", f"[^{tx.WORD_CHARS}][A-Z][a-z]+ (?:et al[.]?|and (?:co-?workers|colleagues))")} AS named, {s.count('text', ci.QUOTE)} AS quotes FROM t LEFT JOIN c USING (doc_id)"""


def citation_bands(spark, d):
    return _rounded(ci.bands(table(spark, d, "corpus")))


def citation_markers(spark, d):
    return ci.markers(table(spark, d, "corpus"))


def citation_positions(spark, d):
    return ci.position_counts(table(spark, d, "corpus"))


def citation_before(spark, d):
    return ci.top_before(table(spark, d, "corpus"))


def citation_after(spark, d):
    return ci.top_after(table(spark, d, "corpus"))


def citation_named(spark, d):
    return _rounded(ci.named_with_verb(table(spark, d, "corpus")))


def citation_introducers(spark, d):
    return ci.introducers(table(spark, d, "corpus"))


def citation_examples(spark, d):
    return ci.citing_examples(table(spark, d, "corpus"))


_BEFORE_HIT = "array_to_string(list_transform(range(0, nth + 1), lambda i: (CASE WHEN i > 0 THEN hits[i] ELSE '' END) || rest[i + 1]), '')"
_BEHIND_HIT = "array_to_string(list_transform(range(nth + 1, len(rest)), lambda i: (CASE WHEN i > nth + 1 THEN hits[i] ELSE '' END) || rest[i + 1]), '')"
_CMARKS = f"""{_CSENT}, cr AS (SELECT doc_id, pos, regexp_split_to_array(sent, {s.q(_MARK)}) AS rest, regexp_extract_all(sent, {s.q(_MARK)}) AS hits FROM se WHERE markers > 0),
cn AS (SELECT *, unnest(range(len(hits))) AS nth FROM cr), ct AS (SELECT doc_id, pos, nth, hits[nth + 1] AS hit, {_BEFORE_HIT} AS head, {s.strip(_BEHIND_HIT)} AS tail FROM cn),
cp AS (SELECT *, CASE WHEN regexp_replace(tail, '^[ .]+|[ .]+$', '', 'g') = '' THEN 'sentence-final' WHEN left(tail, 1) IN (',', ';', ')') THEN 'before , ; or )' ELSE 'mid-sentence' END AS position FROM ct),
cm AS (SELECT doc_id, pos::BIGINT AS pos, nth::BIGINT AS nth, least(len(regexp_extract_all(hit, '[0-9]+')), 5)::BIGINT AS cluster, position,
  array_to_string(({s.lower_tokens('head')})[-2:], ' ') AS before, CASE WHEN position = 'mid-sentence' THEN coalesce({s.lower_tokens('tail')}[1], '') END AS after FROM cp)"""
_MARKS = f"WITH {_CMARKS} SELECT * FROM cm"
_POSITIONS = f"WITH {_CMARKS} SELECT position, cluster, count(*) AS n FROM cm GROUP BY ALL"
_BEFORE = f"WITH {_CMARKS} SELECT before, count(*) AS n FROM cm GROUP BY before ORDER BY n DESC, before LIMIT 40"
_AFTER = f"WITH {_CMARKS} SELECT after, count(*) AS n FROM cm WHERE after IS NOT NULL GROUP BY after ORDER BY n DESC, after LIMIT 20"
_INTRO = f"""WITH {_CSENT} SELECT lower(i) AS introducer, count(*) AS n FROM (SELECT unnest(regexp_extract_all(sent, {s.q(chr(92) + 'b(?i:' + '|'.join(lx.INTRODUCERS) + ')' + chr(92) + 'b')})) AS i FROM se WHERE markers > 0)
GROUP BY 1 ORDER BY n DESC, introducer LIMIT 40"""
_GUARDED = f"""WITH t AS (SELECT DISTINCT ON (doc_id) doc_id, string_split(text, chr(10) || chr(10)) AS p FROM corpus WHERE text IS NOT NULL),
w AS (SELECT doc_id, array_to_string(regexp_extract_all(lower(array_to_string(p[:-2], chr(10) || chr(10))), {s.q(f'{tx.NOT_WS}+')}), ' ') AS a, array_to_string(regexp_extract_all(lower(p[-1]), {s.q(f'{tx.NOT_WS}+')})[1:12], ' ') AS h FROM t WHERE len(p) > 1)
SELECT doc_id, h <> '' AND contains(a, h) AS repeats FROM w"""


QUERIES = {
    "corpus_census": (corpus_census, _CENSUS), "paired_semi": (paired_semi, _PAIRED), "resume_anti": (resume_anti, _RESUME), "upsert": (upsert, _UPSERT),
    "source_filter": (source_filter, f"WITH {_META} SELECT doc_id, source FROM m WHERE source IN ('pmc', 'arxiv')"), "held_out_sources": (held_out_sources, f"WITH {_META} SELECT DISTINCT source FROM m WHERE source IS NOT NULL AND source NOT IN ('pmc', 'generated')"), "word_floor": (word_floor, _FLOOR), "group_cap": (group_cap, _CAP),
    "strided_shards": (strided_shards, _STRIDE), "length_matched": (length_matched, _MATCH), "usable_titles": (usable_titles, None), "accepted_generations": (accepted_generations, _ACCEPTED),
    "repeat_guard": (repeat_guard, _GUARDED), "draft_limits": (draft_limits, _LIMITS), "quota_daily": (quota_daily, _QUOTA), "quota_summary": (quota_summary, _QSUM), "word_budget": (word_budget, None),
    "lm_features": (lm_features, _LM), "context_windows": (context_windows, _CTX), "chunk_scores": (chunk_scores, _CHUNK), "detector_answers": (detector_answers, _DET), "detector_medians": (detector_medians, _MED),
    "syntax_block": (syntax_block, _SYN), "citation_density": (citation_density, _DENS), "citation_bands": (citation_bands, None), "citation_markers": (citation_markers, _MARKS),
    "citation_positions": (citation_positions, _POSITIONS), "citation_before": (citation_before, _BEFORE), "citation_after": (citation_after, _AFTER), "citation_named": (citation_named, None), "citation_introducers": (citation_introducers, _INTRO), "citation_examples": (citation_examples, None),
    "length_ratios": (length_ratios, _RATIOS), "draft_registers": (draft_registers, _REGISTERS), "vocabulary_guard": (vocabulary_guard, _GUARD), "detector_fan_out": (detector_fan_out, _FAN),
    "token_curvature": (token_curvature, _CURVATURE), "token_ratio": (token_ratio, _RATIO), "seeded_sample": (seeded_sample, None),
}
