"""Queries of the nine problems and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstat.llm import leaks, mixture, quality, repetition, scans, sentences, skeletons, spans, truncation
from inkstat.llm.chars import LOOKALIKE
from inkstat.runtime import table

Query = Callable[[SparkSession, str], DataFrame]


def _over(f: Callable[..., DataFrame], *names: str, **more) -> Query:
    return lambda spark, d: f(*[table(spark, d, n) for n in names], **more)


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_ends(table(spark, d, "corpus"), ("arxiv", "gutenberg")).select("doc_id", "end_char")


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(repetition.repeating, "corpus"),
        "p1_scores": _over(repetition.scored, "corpus"),
        "p1_by_source": _over(repetition.by_source, "corpus"),
        "p2_found": _over(skeletons.same_reading_pairs, "corpus"),
        "p2_classes": _over(skeletons.classes, "corpus"),
        "p2_forms": _over(skeletons.consistent_forms, "corpus"),
        "p3_found": _over(truncation.cut_fields, "corpus"),
        "p3_by_source": _over(truncation.by_source, "corpus"),
        "p3_states": _over(truncation.by_state, "corpus"),
        "p4_found": _over(scans.repair_lines, "corpus", "vocabulary"),
        "p4_repaired": _over(scans.repaired_texts, "corpus", "vocabulary"),
        "p4_confusions": _over(scans.confusions, "corpus", "vocabulary"),
        "p5_found": _p5_found,
        "p5_sentences": _over(sentences.sentence_ends, "corpus"),
        "p6_found": _over(quality.not_prose, "corpus", "common_words"),
        "p6_types": _over(quality.typed, "corpus", "common_words"),
        "p6_accuracies": _over(quality.accuracies, "corpus", "common_words"),
        "p6_by_source": _over(quality.by_source, "corpus", "common_words"),
        "p7_found": _p7_found,
        "p7_items": _over(leaks.leak_report, "documents", "eval_items"),
        "p8_mixture": _over(mixture.mixture, "documents", "mix_targets"),
        "p8_shares": _over(mixture.shares, "documents", "mix_targets"),
        "p9_found": _over(spans.sharing_pairs, "documents"),
        "p9_passages": _over(spans.passages, "documents"),
        "p9_shares": _over(spans.shared_share, "documents"),
        "p9_copies": _over(spans.copies, "documents"),
    }


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_ONE = {k: v for k, v in LOOKALIKE.items() if len(v) == 1} | {chr(0xFEE0 + o): chr(o) for o in range(0x21, 0x7F) if o != 0x40} | {"K": "K"}
_STREAM = (
    "regexp_replace(strip_accents(lower(translate(replace(replace(replace(replace(regexp_replace(@, '<[!/]?[A-Za-z][^<>]{0,200}>', '', 'g'), "
    "'ﬃ', 'ffi'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬀ', 'ff'), " + _quoted("".join(_ONE)) + ", " + _quoted("".join(_ONE.values())) + "))), '[^\\p{L}\\p{N}]', '', 'g')"
)

_P7 = f"""
WITH words AS (
  SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda x: {_STREAM.replace("@", "x")}), lambda x: x <> '') AS ws
  FROM eval_items WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, array_to_string(list_slice(ws, i, i + 11), '') AS w
  FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM words WHERE len(ws) >= 12)),
docs AS (SELECT doc_id, {_STREAM.replace("@", "text")} AS s FROM documents WHERE text IS NOT NULL)
SELECT DISTINCT doc_id, item_id FROM docs JOIN windows ON contains(s, w)
"""

_P9_WINDOWS = """
WITH w AS (
  SELECT doc_id, i, md5_number(substr(text, i, 300)) AS h
  FROM (SELECT doc_id, text, unnest(range(1, length(text) - 298)) AS i FROM documents WHERE length(text) >= 300))
"""

_P9_COPIES = """
SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS rep
FROM (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300)
"""


_P9_SHARED = """
WITH r AS (SELECT text, min(doc_id) AS rep, count(*) AS copies FROM (SELECT DISTINCT doc_id, text FROM documents WHERE length(text) >= 300) GROUP BY text),
w AS (SELECT rep, i - 1 AS pos, md5_number(substr(text, i, 300)) AS h FROM (SELECT rep, text, unnest(range(1, length(text) - 298)) AS i FROM r)),
held AS (SELECT h, list_sort(list(rep)) AS who FROM w GROUP BY h HAVING min(rep) < max(rep)),
s AS (SELECT rep, pos, h, who, lag(pos) OVER x AS pos_before, lag(who) OVER x AS who_before FROM w JOIN held USING (h) WINDOW x AS (PARTITION BY rep ORDER BY pos))
"""

_P9_PASSAGES = _P9_SHARED + """,
runs AS (
  SELECT rep, pos, h, who, sum(CASE WHEN pos_before IS NULL OR pos_before <> pos - 1 OR who_before <> who THEN 1 ELSE 0 END) OVER (PARTITION BY rep ORDER BY pos) AS run FROM s),
g AS (SELECT rep, run, min(pos) AS start_char, max(pos) + 300 AS end_char, arg_min(h, pos) AS h, max(len(who)) AS holders FROM runs GROUP BY rep, run)
SELECT first_value(rep) OVER y AS passage_rep, first_value(start_char) OVER y AS passage_start, holders, rep, start_char, end_char
FROM g WINDOW y AS (PARTITION BY h, end_char - start_char ORDER BY rep, start_char)
"""

_P9_SHARES = _P9_SHARED + """,
stretches AS (SELECT rep, pos, sum(CASE WHEN pos_before IS NULL OR pos - pos_before > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY rep ORDER BY pos) AS run FROM s),
found AS (
  SELECT rep, count(*) AS passages, sum(chars) AS chars FROM (SELECT rep, run, max(pos) + 300 - min(pos) AS chars FROM stretches GROUP BY rep, run) GROUP BY rep),
d AS (SELECT DISTINCT doc_id, text, coalesce(length(text), 0) AS n_chars FROM documents WHERE doc_id IS NOT NULL),
x AS (
  SELECT doc_id, coalesce(r.rep, doc_id) AS rep, n_chars, coalesce(passages, CASE WHEN copies > 1 THEN 1 ELSE 0 END) AS passages,
    CASE WHEN copies > 1 THEN n_chars ELSE coalesce(chars, 0) END AS shared_chars
  FROM d LEFT JOIN r ON d.text = r.text LEFT JOIN found ON r.rep = found.rep)
SELECT doc_id, rep, n_chars, passages::BIGINT AS passages, shared_chars::BIGINT AS shared_chars, coalesce(shared_chars / nullif(n_chars, 0), 0.0)::DOUBLE AS share FROM x
"""

_P7_ITEMS = _P7.replace("SELECT DISTINCT doc_id, item_id FROM docs JOIN windows ON contains(s, w)", """,
runs AS (SELECT DISTINCT doc_id, item_id, i, n FROM docs JOIN (
  SELECT item_id, i, n, array_to_string(list_slice(ws, i, i + n - 1), '') AS w FROM (
    SELECT item_id, ws, i, unnest(range(12, len(ws) - i + 2)) AS n FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 10)) AS i FROM words WHERE len(ws) >= 12))) p
  ON contains(s, w))
SELECT item_id, any_value(suite) AS suite, count(DISTINCT doc_id) AS documents, coalesce(max(n), 0)::INTEGER AS longest_words
FROM (SELECT DISTINCT item_id, suite FROM eval_items WHERE item_id IS NOT NULL) LEFT JOIN runs USING (item_id) GROUP BY item_id
""")


def oracle_sql() -> dict[str, str]:
    return {
        "p7_found": _P7,
        "p7_items": _P7_ITEMS,
        "p9_found": _P9_WINDOWS + "SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM w a JOIN w b ON a.h = b.h AND a.doc_id < b.doc_id",
        "p9_copies": _P9_COPIES,
        "p9_passages": _P9_PASSAGES,
        "p9_shares": _P9_SHARES,
    }
