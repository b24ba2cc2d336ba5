"""Queries over single documents: the blocks of measures, cleaning, excerpts."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.functions import lexicons as lx
from inkstat.functions import numbers as nu
from inkstat.functions import text as tx
from inkstat.operators import blocks as bl
from inkstat.plans import sql as s
from inkstat.runtime import table


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


def _rounded(df: DataFrame, *keys: str, places: int = 4) -> DataFrame:
    """Doubles to so many places, so that engines agree to the digit."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" and c not in keys else F.col(c) for c, t in df.dtypes])


def doc_word_counts(spark, d):
    """Words, types, commas per thousand words of each document."""
    x = bl.prepared(_docs(spark, d))
    return x.select(
        "doc_id", F.col("n").cast("bigint").alias("n_words"), F.size(F.array_distinct("low")).cast("bigint").alias("n_types"),
        F.size("sents").cast("bigint").alias("n_sentences"),
        F.round(nu.rate(F.length("text") - F.length(F.replace("text", F.lit(","), F.lit(""))), F.col("n")), 4).alias("comma_rate"),
    )


_WORD_COUNTS = f"""WITH {s.DOCS}, x AS (SELECT doc_id, text, len(toks) AS n, len(list_distinct(low)) AS k, len({s.sentences('text')}) AS m FROM docs)
SELECT doc_id, n::BIGINT AS n_words, k::BIGINT AS n_types, m::BIGINT AS n_sentences, round({s.rate(s.mark_count('text', ','), 'n')}, 4) AS comma_rate FROM x"""


def tokens(spark, d):
    """One row for each word."""
    x = _docs(spark, d).select("doc_id", F.posexplode(tx.lower_tokens(F.col("text"))).alias("pos", "word"))
    return x.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "word")


_TOKENS = f"""SELECT doc_id, unnest(range(len(t)))::BIGINT AS pos, unnest(t) AS word FROM (SELECT doc_id, {s.lower_tokens('text')} AS t FROM documents WHERE text IS NOT NULL)"""


def sentences(spark, d):
    x = bl.prepared(_docs(spark, d)).select("doc_id", F.posexplode("sents").alias("pos", "sent"))
    return x.select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.n_tokens(F.col("sent")).cast("bigint").alias("n_words"))


_SENTENCES = f"""WITH {s.DOCS}, x AS (SELECT doc_id, {s.sentences('text')} AS ss FROM docs)
SELECT doc_id, pos::BIGINT AS pos, {s.n_tokens('sent')}::BIGINT AS n_words FROM (SELECT doc_id, unnest(range(len(ss))) AS pos, unnest(ss) AS sent FROM x)"""


def paragraphs(spark, d):
    x = _docs(spark, d).filter(F.length("text") > 0)
    return x.select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("pos", "para")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.n_tokens(F.col("para")).cast("bigint").alias("n_words"))


_PARAGRAPHS = f"""WITH x AS (SELECT doc_id, list_filter(regexp_split_to_array(text, {s.q(rf'\n{tx.WS}*\n')}), lambda p: {s.n_tokens('p')} >= 3) AS ps FROM documents WHERE length(text) > 0)
SELECT doc_id, pos::BIGINT AS pos, {s.n_tokens('para')}::BIGINT AS n_words FROM (SELECT doc_id, unnest(range(len(ps))) AS pos, unnest(ps) AS para FROM x)"""


def sentence_stats(spark, d):
    b = bl.block(_docs(spark, d), "surface")
    return _rounded(b.select("doc_id", *[c for c in b.columns if c.startswith("sent_len_")], "n_sentences", "short_sent_frac", "long_sent_frac"))


_STATS = f"""WITH {s.DOCS}, x AS (SELECT doc_id, list_transform({s.sentences('text')}, lambda t: {s.n_tokens('t')}) AS l FROM docs),
e AS (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS v FROM x),
st AS (SELECT doc_id, avg(v) AS m, coalesce(stddev_samp(v), 0) AS sd, quantile_cont(v, [0.1, 0.25, 0.5, 0.75, 0.9]) AS p, avg(dv) AS nd, count(*) AS n,
  avg((v <= 8)::INT) AS sf, avg((v >= 35)::INT) AS lf FROM (SELECT *, abs(v - lag(v) OVER (PARTITION BY doc_id ORDER BY pos)) AS dv FROM e) GROUP BY doc_id)
SELECT x.doc_id, round(coalesce(m, 0), 4) AS sent_len_mean, round(coalesce(sd, 0), 4) AS sent_len_sd, round(coalesce(CASE WHEN m > 0 THEN sd / m END, 0), 4) AS sent_len_cv,
  round(coalesce(CASE WHEN sd + m > 0 THEN (sd - m) / (sd + m) END, 0), 4) AS sent_len_burstiness, round(coalesce(p[1], 0), 4) AS sent_len_p10, round(coalesce(p[3], 0), 4) AS sent_len_p50,
  round(coalesce(p[5], 0), 4) AS sent_len_p90, round(coalesce(p[4] - p[2], 0), 4) AS sent_len_iqr, round(coalesce(nd, 0), 4) AS sent_len_neighbour_delta,
  coalesce(n, 0)::DOUBLE AS n_sentences, round(coalesce(sf, 0), 4) AS short_sent_frac, round(coalesce(lf, 0), 4) AS long_sent_frac
FROM x LEFT JOIN st USING (doc_id)"""


def surface_block(spark, d):
    """All of it, with paragraphs: undefined under two of them."""
    return _rounded(bl.block(_docs(spark, d), "surface"))


_PARAS = f"list_filter(list_transform(regexp_split_to_array(text, {s.q(chr(92) + 'n' + tx.WS + '*' + chr(92) + 'n')}), lambda p: {s.strip('p')}), lambda p: {s.n_tokens('p')} >= 3)"
_SURFACE = f"""WITH {s.DOCS}, y AS (SELECT doc_id, text, toks, {_PARAS} AS ps, list_transform({s.sentences('text')}, lambda t: {s.n_tokens('t')}) AS l FROM docs),
x AS (SELECT *, list_transform(ps, lambda p: greatest(1, len({s.sentences('p')}))) AS pn, list_transform(ps, lambda p: {s.n_tokens('p')}) AS pw FROM y)
SELECT doc_id, {s.list_stats('l', 'sent_len')}, {s.list_stats('pn', 'para_sents', 'len(ps) >= 2')}, {s.list_stats('pw', 'para_words', 'len(ps) >= 2')},
  (len(ps) >= 2)::INT::DOUBLE AS has_paragraph_breaks, len(l)::DOUBLE AS n_sentences, len(toks)::DOUBLE AS n_words,
  round(len(list_filter(l, lambda v: v <= 8))::DOUBLE / greatest(len(l), 1), 4) AS short_sent_frac, round(len(list_filter(l, lambda v: v >= 35))::DOUBLE / greatest(len(l), 1), 4) AS long_sent_frac FROM x"""


def lexical_profile(spark, d):
    return _rounded(bl.block(_docs(spark, d), "lexical").drop("mtld"))


_LEXICAL = f"""WITH {s.DOCS}, x AS (SELECT doc_id, text, toks, low FROM docs),
h AS (SELECT doc_id, count(*) AS types, sum((c = 1)::INT) AS once FROM (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(low) AS w FROM x) GROUP BY ALL) GROUP BY doc_id),
l AS (SELECT doc_id, avg(length(w)) AS m, stddev_pop(length(w)) AS sd, sum((length(w) >= 8)::INT) AS big FROM (SELECT doc_id, unnest(toks) AS w FROM x) GROUP BY doc_id)
SELECT x.doc_id, round(coalesce(CASE WHEN len(low) > 0 THEN len(list_distinct(low[1:500]))::DOUBLE / least(len(low), 500) END, 0), 4) AS ttr_500,
  round(coalesce(once::DOUBLE / types, 0), 4) AS hapax_rate, coalesce(types, 0)::DOUBLE AS type_count, round(coalesce(m, 0), 4) AS word_len_mean, round(coalesce(sd, 0), 4) AS word_len_sd,
  round({s.rate('coalesce(big, 0)', 'len(toks)')}, 4) AS long_word_rate,
  round({s.rate(f"len(list_filter(regexp_extract_all(text, {s.q(s.WORD_RUN)}), lambda w: regexp_matches(w, {s.q('(?i)^' + tx.WC + '{4,}(?:' + '|'.join(lx.NOMINAL_SUFFIXES) + ')s?$')})))", 'len(toks)')}, 4) AS nominalisation_rate
FROM x LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)"""


def mtld(spark, d):
    return _rounded(bl.prepared(_docs(spark, d)).select("doc_id", nu.mtld(F.col("low")).alias("mtld")))


_MTLD = f"WITH {s.DOCS} SELECT doc_id, round(mtld, 4) AS mtld FROM ({s.mtld('low', 'docs')})"


def punctuation_rates(spark, d):
    return _rounded(bl.block(_docs(spark, d), "punctuation"))


_PUNCT = (
    f"WITH {s.DOCS} SELECT doc_id, "
    + ", ".join(f"round({s.rate(s.mark_count('text', m), 'len(toks)')}, 4) AS punct_{k}_rate" for k, m in bl.MARKS)
    + f", round({s.rate(s.mark_count('text', '—') + ' + ' + s.mark_count('text', '–'), 'len(toks)').replace('1000.0 * ', '1000.0 * (').replace(' / len', ') / len')}, 4) AS punct_long_dash_rate FROM docs"
)


def function_word_rates(spark, d):
    return _rounded(bl.function_words(_docs(spark, d)))


_FUNCTION = f"""WITH {s.DOCS}, x AS (SELECT doc_id, low FROM docs),
c AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(low) AS w FROM x) GROUP BY ALL),
f AS (SELECT unnest([{', '.join(map(s.q, lx.FUNCTION_WORDS))}]) AS w)
SELECT x.doc_id, 'fw_' || f.w AS feature, round({s.rate('coalesce(c.c, 0)', 'len(low)')}, 4) AS value FROM x CROSS JOIN f LEFT JOIN c ON c.doc_id = x.doc_id AND c.w = f.w"""


def group_rates(spark, d):
    b = bl.block(_docs(spark, d), "discourse")
    return _rounded(b.select("doc_id", "hedge_rate", "booster_rate", "transition_rate", "first_person_rate"))


_GROUPS = f"WITH {s.DOCS}, x AS (SELECT doc_id, low FROM docs) SELECT doc_id, " + ", ".join(
    f"round({s.rate(f'len(list_filter(low, lambda w: w IN {s.values(v)}))', 'len(low)')}, 4) AS {k}_rate"
    for k, v in (("hedge", lx.HEDGES), ("booster", lx.BOOSTERS), ("transition", lx.TRANSITIONS), ("first_person", lx.FIRST_PERSON))
) + " FROM x"


def opener_stats(spark, d):
    b = bl.block(_docs(spark, d), "discourse")
    return _rounded(b.select("doc_id", "tricolon_rate", "sent_initial_transition_frac", "sent_initial_this_frac", "opener_entropy", "opener_top1_frac"))


_TRI = rf"(?i){tx.WC}+(?:{tx.WS}+{tx.WC}+){{0,2}},,{tx.WS}+{tx.WC}+(?:{tx.WS}+{tx.WC}+){{0,2}},,{tx.WS}+and{tx.WS}+{tx.WC}+"
_OPENERS = f"""WITH {s.DOCS}, x AS (SELECT doc_id, text, len(toks) AS n, list_transform({s.sentences('text')}, lambda t: lower({s.tokens('t')}[1])) AS h FROM docs),
c AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest(h) AS w FROM x) GROUP BY ALL),
e AS (SELECT doc_id, sum(-(c / t) * log2(c / t)) AS ent, max(c / t) AS top FROM (SELECT *, sum(c) OVER (PARTITION BY doc_id)::DOUBLE AS t FROM c) GROUP BY doc_id)
SELECT x.doc_id, round({s.rate(s.count(s.doubled('text'), '[^' + tx.WORD_CHARS + ']' + _TRI.replace('(?i)', '(?i:') + ')'), 'n')}, 4) AS tricolon_rate,
  round(len(list_filter(h, lambda w: w IN {s.values(lx.TRANSITIONS)}))::DOUBLE / greatest(len(h), 1), 4) AS sent_initial_transition_frac,
  round(len(list_filter(h, lambda w: w = 'this'))::DOUBLE / greatest(len(h), 1), 4) AS sent_initial_this_frac,
  round(coalesce(ent, 0), 4) AS opener_entropy, round(coalesce(top, 0), 4) AS opener_top1_frac FROM x LEFT JOIN e USING (doc_id)"""


def phrase_rates(spark, d):
    return _rounded(bl.block(_docs(spark, d), "tells"))


def _phrase_sql(p: str) -> str:
    return "(?i)" + "".join("''" if c == "'" else "--" if c == "-" else f"{tx.WS}+" if c == " " else c for c in p)


_PHRASES = (
    f"WITH {s.DOCS}, u AS (SELECT doc_id, {s.drop_quoted('text')} AS u FROM docs), x AS (SELECT doc_id, {s.n_tokens('u')} AS n, {s.doubled('u')} AS u FROM u), c AS (SELECT doc_id, n, "
    + ", ".join(f"{s.count('u', f'[^{tx.WORD_CHARS}](?:{_phrase_sql(p)})[^{tx.WORD_CHARS}]')} AS {bl.phrase_key(p)}" for p in lx.STOCK_PHRASES)
    + " FROM x) SELECT doc_id, "
    + ", ".join(f"round({s.rate(bl.phrase_key(p), 'n')}, 4) AS {bl.phrase_key(p)}" for p in lx.STOCK_PHRASES)
    + ", CASE WHEN n > 0 THEN ("
    + " + ".join(f"({bl.phrase_key(p)} > 0)::INT" for p in lx.STOCK_PHRASES)
    + ") ELSE 0 END::DOUBLE AS tell_distinct_count, round("
    + s.rate("(" + " + ".join(bl.phrase_key(p) for p in lx.STOCK_PHRASES) + ")", "n")
    + ", 4) AS tell_total_rate FROM c"
)


def specificity(spark, d):
    return _rounded(bl.block(_docs(spark, d), "specificity"))


_UNITS_DOUBLED = "|".join("".join(re.escape(c) if c.isalnum() or c == "_" else 2 * re.escape(c) for c in u) for u in lx.UNITS if u != "%")
_SPEC = f"""WITH {s.DOCS}, x AS (SELECT doc_id, text, len({s.WORDS}) AS n FROM docs) SELECT doc_id, """ + ", ".join(
    f"round(CASE WHEN n > 0 THEN 1000.0 * {v} / n END, 4) AS {k}"
    for k, v in {
        "numeric_token_rate": f"len(list_filter({s.WORDS}, lambda w: regexp_matches(w, '[0-9]')))",
        "decimal_rate": s.count(s.doubled("text"), rf"[^{tx.WORD_CHARS}][0-9]+\.\.[0-9]+[^{tx.WORD_CHARS}]"),
        "acronym_rate": s.count(s.doubled("text"), rf"[^{tx.WORD_CHARS}][A-Z]{{2,}}[0-9]*[^{tx.WORD_CHARS}]"),
        "digit_char_rate": s.count("text", r"\p{Nd}"),
        "quantity_rate": s.count(s.doubled("text"), rf"[^{tx.WORD_CHARS}][0-9]+(?:\.\.[0-9]+)?{tx.WS}*(?:(?:{_UNITS_DOUBLED})[^{tx.WORD_CHARS}]|%%{tx.WC})"),
    }.items()
) + " FROM x"


def specificity_rates(spark, d):
    """Without quantities."""
    return specificity(spark, d).drop("quantity_rate")


def register(spark, d):
    return _rounded(bl.block(_docs(spark, d), "register"))


_REGISTER = f"""WITH {s.DOCS}, x AS (SELECT doc_id, text, len(toks) AS n, {s.drop_quoted('text')} AS u, {s.sentences('text')} AS ss FROM docs)
SELECT doc_id, round(CASE WHEN n > 0 THEN 1000.0 * {s.count_bounded('u', '(?i)(?:' + '|'.join(lx.CONCESSIVES) + ')')} / n END, 4) AS concessive_rate,
  round(CASE WHEN n > 0 THEN 1000.0 * {s.count('u', '(?i)' + lx.COUNTERWEIGHT)} / n END, 4) AS counterweight_rate,
  round(CASE WHEN n > 0 THEN 1000.0 * {s.count('u', '(?i)' + lx.CONTRASTIVE)} / n END, 4) AS contrastive_rate,
  round(CASE WHEN n > 0 THEN 1000.0 * {s.count_bounded('u', '(?i)' + lx.ATTENUATOR.replace(' ', '  '))} / n END, 4) AS attenuator_rate,
  round(CASE WHEN n > 0 THEN len(list_filter(ss, lambda t: {s.count_bounded(s.drop_quoted('t'), '(?i)(?:' + '|'.join(lx.CONCESSIVES) + ')')} > 0
    OR regexp_matches({s.drop_quoted('t')}, {s.q('(?i)' + lx.COUNTERWEIGHT)})))::DOUBLE / greatest(len(ss), 1) END, 4) AS balanced_sentence_frac FROM x"""


def _unrounded(q: str) -> str:
    return q.replace("round(", "(").replace(", 4) AS", ") AS")


def _melted(q: str) -> str:
    return f"SELECT * FROM (SELECT doc_id, COLUMNS(* EXCLUDE doc_id)::DOUBLE FROM ({_unrounded(q)})) UNPIVOT INCLUDE NULLS (value FOR feature IN (COLUMNS(* EXCLUDE doc_id)))"


#: ``(doc_id, feature, value)`` of all blocks, over the table ``documents``.
ALL_MEASURES = " UNION ALL ".join([_unrounded(_FUNCTION), *map(_melted, (_SURFACE, _LEXICAL, _MTLD, _PUNCT, _GROUPS, _OPENERS, _PHRASES, _SPEC, _REGISTER))])
_FEATURES = f"SELECT doc_id, feature, round(value, 4) AS value FROM ({ALL_MEASURES})"


def features_long(spark, d):
    """All blocks in long form."""
    return _rounded(bl.features_long(_docs(spark, d)))


def quoted_drop(spark, d):
    x = _docs(spark, d).filter(F.length("text") > 0)
    return x.select("doc_id", F.length(tx.drop_quoted(F.col("text"))).cast("bigint").alias("chars_left"), F.md5(F.encode(tx.drop_quoted(F.col("text")), "utf-8")).alias("digest"))


_QUOTED = f"SELECT doc_id, length({s.drop_quoted('text')})::BIGINT AS chars_left, md5({s.drop_quoted('text')}) AS digest FROM documents WHERE length(text) > 0"


def excerpts(spark, d):
    """Consecutive pieces of 120 words, up to the first shorter than half of that."""
    w = tx.split_words(F.col("text"))
    x = _docs(spark, d).filter(F.length("text") > 0).select("doc_id", w.alias("w"))
    p = F.posexplode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(120)), lambda i: F.slice("w", i + 1, F.lit(120)))).alias("piece", "ws")
    x = x.select("doc_id", p).filter(F.size("ws") >= 60)
    return x.select("doc_id", F.col("piece").cast("bigint").alias("piece"), F.size("ws").cast("bigint").alias("n_words"), F.md5(F.encode(F.array_join("ws", " "), "utf-8")).alias("digest"))


_EXCERPTS = f"""WITH x AS (SELECT doc_id, {s.WORDS} AS w FROM documents WHERE length(text) > 0),
p AS (SELECT doc_id, i // 120 AS piece, w[i + 1 : i + 120] AS ws FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w), 1), 120)) AS i FROM x))
SELECT doc_id, piece::BIGINT AS piece, len(ws)::BIGINT AS n_words, md5(array_to_string(ws, ' ')) AS digest FROM p WHERE len(ws) >= 60"""


def first_excerpt(spark, d):
    """The first 100 words of texts that have as many."""
    e = tx.excerpt(F.col("text"), 100, 100)
    return _docs(spark, d).filter(F.length("text") > 0).select("doc_id", e.alias("excerpt")).filter("excerpt IS NOT NULL")


_FIRST = f"SELECT doc_id, array_to_string(w[1:100], ' ') AS excerpt FROM (SELECT doc_id, {s.WORDS} AS w FROM documents WHERE length(text) > 0) WHERE len(w) >= 100"


def char_truncation(spark, d):
    return _docs(spark, d).filter("text IS NOT NULL").select("doc_id", F.length(F.substring("text", 1, bl.MAX_CHARS)).cast("bigint").alias("n"))


def clean_text(spark, d):
    c = tx.clean(F.col("text"))
    return table(spark, d, "corpus").select("doc_id", "text").dropDuplicates().filter("text IS NOT NULL").select("doc_id", c.alias("clean"))


def clean_titles(spark, d):
    c = tx.clean_title(F.col("title"))
    return table(spark, d, "corpus").select("doc_id", "title").dropDuplicates().filter("title IS NOT NULL").select("doc_id", c.alias("clean_title"))


def markdown_strip(spark, d):
    """Mark-up made from each title and text, and taken off again."""
    t = table(spark, d, "documents").filter(F.length("text") > 0)
    m = F.concat(F.lit("# "), F.coalesce("title", F.lit("x")), F.lit("\n\n```\ncode\n```\n\n| a | b |\n\n* **bold** item\n1. [a link](http://x.y)\n\n"), F.col("text"))
    return t.select("doc_id", tx.strip_markdown(m).alias("plain"))


def pdf_clean(spark, d):
    t = table(spark, d, "corpus").filter("lower(trim(source)) = 'group' AND length(text) > 0").select("doc_id", "text").dropDuplicates()
    return t.select("doc_id", tx.clean_pdf(F.col("text")).alias("plain"))


def line_ratios(spark, d):
    """Notation and letters in each line of the corpus."""
    t = table(spark, d, "corpus").filter(F.length("text") > 0).select("doc_id", "text").dropDuplicates()
    x = t.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return _rounded(x.select("doc_id", F.col("line_no").cast("bigint").alias("line_no"), tx.math_ratio(F.col("line")).alias("math_ratio"), tx.alpha_ratio(F.col("line")).alias("alpha_ratio")))


_RE2_MATH = "[" + "".join("\\" + c if c in "[]\\^{}|+" else c for c in tx.MATH_CHARS) + "]"
_LINES = f"""WITH t AS (SELECT DISTINCT doc_id, text FROM corpus WHERE length(text) > 0), l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM t),
x AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM l)
SELECT doc_id, line_no::BIGINT AS line_no, round(CASE WHEN {s.strip('line')} = '' THEN 1.0 ELSE {s.count('line', _RE2_MATH)}::DOUBLE / length(line) END, 4) AS math_ratio,
  round(CASE WHEN {s.strip('line')} = '' THEN 0.0 ELSE {s.count('line', f'[{chr(92)}p{{L}}{chr(92)}p{{N}}{tx.SPACES}]')}::DOUBLE / length(line) END, 4) AS alpha_ratio FROM x"""


QUERIES = {
    "doc_word_counts": (doc_word_counts, _WORD_COUNTS), "tokens": (tokens, _TOKENS), "sentences": (sentences, _SENTENCES), "paragraphs": (paragraphs, _PARAGRAPHS),
    "sentence_stats": (sentence_stats, _STATS), "surface_block": (surface_block, _SURFACE), "lexical_profile": (lexical_profile, _LEXICAL), "mtld": (mtld, _MTLD),
    "punctuation_rates": (punctuation_rates, _PUNCT), "function_word_rates": (function_word_rates, _FUNCTION), "group_rates": (group_rates, _GROUPS),
    "opener_stats": (opener_stats, _OPENERS), "phrase_rates": (phrase_rates, _PHRASES), "specificity": (specificity, _SPEC), "specificity_rates": (specificity_rates, f"SELECT * EXCLUDE quantity_rate FROM ({_SPEC})"),
    "register": (register, _REGISTER), "features_long": (features_long, _FEATURES), "quoted_drop": (quoted_drop, _QUOTED),
    "excerpts": (excerpts, _EXCERPTS), "first_excerpt": (first_excerpt, _FIRST), "char_truncation": (char_truncation, f"SELECT doc_id, length(substr(text, 1, {bl.MAX_CHARS}))::BIGINT AS n FROM documents WHERE text IS NOT NULL"),
    "clean_text": (clean_text, None), "clean_titles": (clean_titles, None), "markdown_strip": (markdown_strip, None), "pdf_clean": (pdf_clean, None), "line_ratios": (line_ratios, _LINES),
}
