"""Problem 6: per-document text quality statistics and text types.

Method: each statistic with its thresholds is a noisy labelling function that votes or abstains. Two name a type by the
kinds of lines, eight say prose or not by other signs. Their accuracies are learned by expectation-maximization on how
they agree (votes are taken as independent given the type), from the majority of the votes on and with no belief in any
function beforehand, over the counts of vote patterns of all documents. Every document gets the posterior of each text
type, and that alone decides.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm.lines import CLOSERS, ENDS, SIGNS, STOPS, kind
from inkstat.llm.words import words
from inkstat.runtime import cut, spread

TYPES = ("prose", "list", "table", "junk")
KIND_TYPE = {
    "prose": "prose", "bullet": "list", "contents": "list", "menu": "list", "reference": "list", "keywords": "list",
    "table": "table", "record": "table", "log": "table", "formula": "junk", "junk": "junk",
}
#: The table of common words goes to every worker; it is refused beyond so many rows.
MOST_COMMON_WORDS = 100_000
_STOP = re.compile(rf"[{re.escape(STOPS)}]+[{re.escape(CLOSERS)}]*(?=\s|\Z)|[。！？।]")
_SPACELESS = re.compile("[぀-ヿ㐀-鿿฀-๿]")
_SHAPE = [(re.compile("[0-9]+"), "0"), (re.compile("[A-Z][a-z]+|[A-Z]+"), "A"), (re.compile("[a-z]+"), "a")]

STATS = [
    ("n_chars", "bigint"), ("n_lines", "bigint"), ("n_words", "bigint"), ("mean_word_length", "double"), ("symbol_ratio", "double"),
    ("digit_ratio", "double"), ("line_stop_share", "double"), ("stops_per_word", "double"), ("common_word_share", "double"),
    ("structured_char_share", "double"), ("structured_line_share", "double"), ("sentence_char_share", "double"), ("alike_line_share", "double"),
    ("words_per_line", "double"), ("main_kind", "string"), ("spaceless", "boolean"),
]


_AROUND = re.escape(CLOSERS + "([{„“.,;:!?")
_LETTER_WORD = re.compile(rf"(?<!\S)[{_AROUND}]*[^\W\d_]+[{_AROUND}]*(?!\S)")
_THAI_RUN = re.compile("[^\\s]*[฀-๿][^\\s]*")


VOTES = ("structure_chars", "structure_lines", "sentences", "stops", "common_words", "symbols", "digits", "line_ends", "alike", "width")
#: So many functions name a type by its place in TYPES; the others put out 0 for prose and 1 for anything else.
NAMING = 2


def _sentence_chars(text: str) -> int:
    """Characters of stretches up to a stop, of at least five words (in scripts without spaces: twelve characters), most of
    whose words are written in letters only; a line that ends without a stop ends its stretch only at a blank line.
    In Thai, which has no stops, each run without a space of twelve or more characters."""
    got = sum(len(x) for x in _THAI_RUN.findall(text) if len(x) >= 12)
    if got:
        return got
    for block in re.split(r"\n\s*\n", text):
        start = 0
        for m in _STOP.finditer(block):
            s = block[start : m.end()]
            start = m.end()
            ws = s.split()
            if len(ws) >= 5 and len(_LETTER_WORD.findall(s)) * 2 > len(ws) or len(ws) < 5 and len(_SPACELESS.findall(s)) >= 12:
                got += len("".join(ws))
    return got


def _alike(lines: list[str]) -> float:
    """Share of lines that begin like the line before: with the same shape of their first signs."""
    shapes = []
    for x in lines:
        x = x.strip()[:24]
        for pattern, sign in _SHAPE:
            x = pattern.sub(sign, x)
        shapes.append(x[:6])
    same = sum(a == b for a, b in zip(shapes, shapes[1:]))
    return same / (len(lines) - 1) if len(lines) > 1 else 0.0


def statistics(text: str | None, common: dict[str, set[str]]) -> tuple:
    """The statistics of one text in the order of STATS; without non-space characters all are 0."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip()]
    if not lines:
        return (len(text), 0, 0, *[0.0] * 11, "prose", False)
    ws = words(text)
    visible = len("".join(text.split()))
    chars: Counter[str] = Counter()
    kinds: Counter[str] = Counter()
    for x in lines:
        k = KIND_TYPE[kind(x)]
        chars[k] += len(x.strip())
        kinds[k] += 1
    n = len(ws)
    share, spaceless = 0.0, len(_SPACELESS.findall(text)) * 3 > visible
    if n:
        count = Counter(ws)
        for lang, some in common.items():
            if lang not in ("zh", "ja", "th"):
                share = max(share, sum(map(count.get, count.keys() & some)) / n)
            elif spaceless:
                share = max(share, sum(text.count(w) * len(w) for w in some) / max(visible, 1))
    total = sum(chars.values())
    signs = text.translate(SIGNS)
    digits = sum(map(str.isdigit, signs))
    # ties go to the type named first, so that the result is the same everywhere
    main = max(("list", "table", "junk"), key=lambda k: chars[k])
    return (
        len(text), len(lines), n, sum(map(len, ws)) / n if n else 0.0, (len(signs) - digits) / visible, digits / visible,
        sum(bool(ENDS.search(x.rstrip())) for x in lines) / len(lines), len(_STOP.findall(text)) / n if n else 0.0, share,
        1 - chars["prose"] / total, 1 - kinds["prose"] / len(lines), _sentence_chars(text) / visible, _alike(lines), n / len(lines),
        main if chars[main] else "prose", spaceless,
    )


def text_statistics(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """``(doc_id, source, statistics ...)`` once for each document; null and empty texts have zeros.

    Rows with null doc_id are left out; a null source stays null.
    """
    rows = common_words.select("lang", "word").dropna().distinct().limit(MOST_COMMON_WORDS + 1).collect()
    if len(rows) > MOST_COMMON_WORDS:
        raise ValueError(f"the table of common words has more than {MOST_COMMON_WORDS} rows")
    common: dict[str, set[str]] = {}
    for lang, w in rows:
        common.setdefault(lang.lower(), set()).update(words(w) if lang.lower() not in ("zh", "ja", "th") else [w])
    names = [n for n, _ in STATS]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            x = pd.DataFrame([statistics(t if isinstance(t, str) else None, common) for t in b["text"]], columns=names)
            x.insert(0, "doc_id", b["doc_id"].to_numpy())
            x.insert(1, "source", b["source"].to_numpy())
            yield x

    d = spread(docs.select("doc_id", "source", "text").filter("doc_id IS NOT NULL"), "doc_id")
    return d.mapInPandas(run, "doc_id string, source string, " + ", ".join(f"{n} {t}" for n, t in STATS)).dropDuplicates(["doc_id"])


def votes(stats: DataFrame) -> DataFrame:
    """A column ``v_...`` for each labelling function: its vote; -1 where it abstains."""

    def sides(c: str, low: float, high: float, low_is: int = 1):
        """One vote below ``low``, the other from ``high`` on."""
        return F.when(F.col(c) < low, low_is).when(F.col(c) >= high, 1 - low_is).otherwise(-1)

    def unless(condition, vote):
        return F.when(condition, -1).otherwise(vote)

    short, few, spaceless = F.col("n_words") < 8, F.col("n_lines") < 3, F.col("spaceless")
    code = F.when(F.col("main_kind") == "table", 2).when(F.col("main_kind") == "junk", 3).otherwise(1)
    v = {
        "structure_chars": F.when(F.col("structured_char_share") > 0.5, code).otherwise(0),
        "structure_lines": F.when(F.col("structured_line_share") >= 0.5, code).otherwise(0),
        "sentences": sides("sentence_char_share", 0.25, 0.75),
        # where words are single characters, stops, particles and lines have other measures, and Thai has no stops
        "stops": unless(short | spaceless, sides("stops_per_word", 0.004, 0.02)),
        "common_words": unless(short | spaceless, sides("common_word_share", 0.05, 0.15)),
        "symbols": F.when(F.col("symbol_ratio") >= 0.16, 1).otherwise(-1),
        "digits": F.when(F.col("digit_ratio") >= 0.25, 1).otherwise(-1),
        "line_ends": unless(spaceless | few, sides("line_stop_share", 0.02, 0.5)),
        "alike": unless(few, F.when(F.col("alike_line_share") >= 0.6, 1).otherwise(-1)),
        "width": unless(spaceless | few, sides("words_per_line", 6, 16)),
    }
    return stats.withColumns({f"v_{k}": c.cast("int") for k, c in v.items()})


def majority(patterns: np.ndarray, naming: int = NAMING) -> np.ndarray:
    """For each vote pattern the share of its votes that each type has; a vote against prose is shared by the others."""
    k = len(TYPES)
    post = np.full((len(patterns), k), 0.1 / k)
    for j in range(patterns.shape[1]):
        v = patterns[:, j]
        ok = np.flatnonzero(v >= 0)
        if j < naming:
            np.add.at(post, (ok, v[ok]), 1.0)
        else:
            post[ok, 0] += v[ok] == 0
            post[ok, 1:] += ((v[ok] == 1) / (k - 1))[:, None]
    return post / post.sum(1, keepdims=True)


def learn(patterns: np.ndarray, counts: np.ndarray, naming: int = NAMING, rounds: int = 300, tol: float = 1e-9) -> tuple[np.ndarray, list[np.ndarray]]:
    """Priors and, for each function, P(vote | type), by expectation-maximization over vote patterns, from the
    majority of the votes on. A function that abstains counts for nothing."""
    k, m = len(TYPES), patterns.shape[1]
    sizes = [k if j < naming else 2 for j in range(m)]
    post = majority(patterns, naming)
    prior, tables, last = np.full(k, 1 / k), [np.full((k, s), 1 / s) for s in sizes], -np.inf
    for _ in range(rounds):
        w = post * counts[:, None]
        prior = (w.sum(0) + 0.5) / (w.sum() + 0.5 * k)
        tables = []
        for j in range(m):
            t = np.full((k, sizes[j]), 0.05)
            ok = patterns[:, j] >= 0
            np.add.at(t.T, patterns[ok, j], w[ok])
            tables.append(t / t.sum(1, keepdims=True))
        logp = log_joint(patterns, prior, tables)
        top = logp.max(1, keepdims=True) if len(logp) else logp
        e = np.exp(logp - top)
        post = e / e.sum(1, keepdims=True)
        like = float(((top[:, 0] + np.log(e.sum(1))) * counts).sum()) if len(logp) else 0.0
        if like - last < tol * max(1.0, abs(like)):
            break
        last = like
    return prior, tables


def log_joint(patterns: np.ndarray, prior: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
    out = np.tile(np.log(prior), (len(patterns), 1))
    for j, t in enumerate(tables):
        ok = patterns[:, j] >= 0
        out[ok] += np.log(t[:, patterns[ok, j]]).T
    return out


def typed(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """``(doc_id, source, statistics ..., text_type, p_prose, p_list, p_table, p_junk)`` of each document.

    Documents without non-space characters are ``empty`` and take no part in learning.
    """
    names = [f"v_{v}" for v in VOTES]
    x = cut(votes(text_statistics(docs, common_words)))
    # vote patterns of all documents: their number is bounded by the symbols, not by the data
    pat = x.filter("n_lines > 0").groupBy(*names).count().toPandas().sort_values(names, kind="stable")
    p = pat[names].to_numpy(int).reshape(-1, len(names))
    prior, tables = learn(p, pat["count"].to_numpy(float))
    lj = log_joint(p, prior, tables)
    e = np.exp(lj - lj.max(1, keepdims=True)) if len(lj) else lj
    e = e / e.sum(1, keepdims=True) if len(lj) else e
    table = pat[names].copy()
    for j, t in enumerate(TYPES):
        table[f"p_{t}"] = e[:, j].round(12) if len(e) else []
    table["text_type"] = [TYPES[i] for i in e.argmax(1)] if len(e) else []
    cols = ", ".join(f"{n} int" for n in names) + ", " + ", ".join(f"p_{t} double" for t in TYPES) + ", text_type string"
    spark = docs.sparkSession
    post = spark.createDataFrame(table, cols) if len(table) else spark.createDataFrame([], cols)
    return x.join(F.broadcast(post), names, "left").select(
        "doc_id", "source", *[n for n, _ in STATS], F.when(F.col("n_lines") == 0, "empty").otherwise(F.col("text_type")).alias("text_type"),
        *[f"p_{t}" for t in TYPES],
    )


def not_prose(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """``(doc_id)`` of documents whose text is by its posterior rather list, table or junk than prose."""
    return typed(docs, common_words).filter("n_lines > 0 AND p_prose < 0.5").select("doc_id")


def accuracies(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """``(labelling_function, text_type, vote, probability)``: what expectation-maximization learnt of each function."""
    names = [f"v_{v}" for v in VOTES]
    pat = votes(text_statistics(docs, common_words)).filter("n_lines > 0").groupBy(*names).count().toPandas().sort_values(names, kind="stable")
    _, tables = learn(pat[names].to_numpy(int).reshape(-1, len(names)), pat["count"].to_numpy(float))
    rows = [(VOTES[j], TYPES[t], v, float(p)) for j, x in enumerate(tables) for t, line in enumerate(x) for v, p in enumerate(line)]
    return docs.sparkSession.createDataFrame(rows, "labelling_function string, text_type string, vote int, probability double")


def by_source(docs: DataFrame, common_words: DataFrame) -> DataFrame:
    """``(source, documents, prose, list, table, junk, mean_words, mean_word_length, mean_symbol_ratio)``."""
    t = typed(docs, common_words).filter("n_lines > 0")
    return t.groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.count("*").alias("documents"), *[F.count_if(F.col("text_type") == k).alias(k) for k in TYPES],
        F.avg("n_words").alias("mean_words"), F.avg("mean_word_length").alias("mean_word_length"), F.avg("symbol_ratio").alias("mean_symbol_ratio"),
    )
