"""Pieces of SQL the queries' counterparts share. RE2 has no look-around and its word edges are ASCII, so edges are
spelled out: separators are doubled, and a pattern takes one on either side."""

from __future__ import annotations

from inkstat.functions import lexicons as lx
from inkstat.functions.text import NOT_WS, TOKEN, WC, WORD_CHARS, WS


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def values(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def tokens(c: str) -> str:
    return f"regexp_extract_all({c}, {q(TOKEN)})"


def n_tokens(c: str) -> str:
    return f"len({tokens(c)})"


def strip(c: str) -> str:
    return f"regexp_replace({c}, {q(rf'^{WS}+|{WS}+$')}, '', 'g')"


def flat(c: str) -> str:
    return strip(f"regexp_replace({c}, {q(rf'{WS}*\n{WS}*')}, ' ', 'g')")


_ABBR = "|".join(a.replace(".", r"\.") for a in lx.ABBREVIATIONS)


def sentences(c: str, least: int = 3) -> str:
    """Mark each gap, take the mark back after abbreviations and initials (twice: a run of them shares its spaces)."""
    gap = rf"([.!?])[\"')\]]*{WS}+([A-Z0-9(\"'])"
    marked = f"regexp_replace({flat(c)}, {q(gap)}, chr(92) || '1' || chr(1) || chr(92) || '2', 'g')"
    back = rf"((?:^|{WS}|\x01)(?:(?i:{_ABBR})|[A-Z])\.)\x01"
    for _ in range(2):
        marked = f"regexp_replace({marked}, {q(back)}, chr(92) || '1 ', 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda s: {n_tokens('s')} >= {least})"


def doubled(c: str) -> str:
    """Every separator twice, so that two matches beside each other need not share one."""
    return f"regexp_replace(' ' || {c} || ' ', {q(f'([^{WORD_CHARS}])')}, chr(92) || '1' || chr(92) || '1', 'g')"


def count(c: str, pattern: str) -> str:
    return f"len(regexp_extract_all({c}, {q(pattern)}))"


def count_bounded(c: str, pattern: str) -> str:
    """Matches of a pattern (written for doubled separators) between the edges of words."""
    return count(doubled(c), rf"[^{WORD_CHARS}](?:{pattern})[^{WORD_CHARS}]")


def rate(n: str, words: str) -> str:
    return f"CASE WHEN {words} > 0 THEN 1000.0 * {n} / {words} ELSE 0.0 END"


def mark_count(c: str, m: str) -> str:
    return f"(length({c}) - length(replace({c}, {q(m)}, '')))"


QUOTED = "\"[^\"]{1,120}\"|'[^']{1,120}'|“[^”]{1,120}”"


def drop_quoted(c: str) -> str:
    return f"regexp_replace({c}, {q(QUOTED)}, ' ', 'g')"


def lower_tokens(c: str) -> str:
    return f"list_transform({tokens(c)}, lambda w: lower(w))"


DOCS = f"""docs AS (
  SELECT doc_id, text, {tokens('text')} AS toks, {lower_tokens('text')} AS low FROM documents WHERE length(text) > 0)"""
WORDS = f"regexp_extract_all(text, {q(f'{NOT_WS}+')})"
WORD_RUN = f"{WC}+"


def list_stats(items: str, prefix: str, null_unless: str = "true") -> str:
    """Nine statistics of a list of lengths in its order, as selected columns; all 0 of an empty one."""
    sd = f"coalesce(list_stddev_samp({items}), 0)"
    m = f"coalesce(list_avg({items}), 0)"
    p = {q: f"coalesce(list_aggregate({items}, 'quantile_cont', {q}), 0)" for q in (0.1, 0.25, 0.5, 0.75, 0.9)}
    values_ = {
        "mean": m, "sd": sd, "cv": f"CASE WHEN {m} > 0 THEN {sd} / {m} ELSE 0 END", "burstiness": f"CASE WHEN {sd} + {m} > 0 THEN ({sd} - {m}) / ({sd} + {m}) ELSE 0 END",
        "p10": p[0.1], "p50": p[0.5], "p90": p[0.9], "iqr": f"{p[0.75]} - {p[0.25]}",
        "neighbour_delta": f"coalesce(list_avg(list_transform(range(1, len({items})), lambda i: abs({items}[i + 1] - {items}[i]))), 0)",
    }
    return ", ".join(f"round(CASE WHEN {null_unless} THEN ({v})::DOUBLE END, 4) AS {prefix}_{k}" for k, v in values_.items())


_NEXT = "CASE WHEN list_contains(a.s, x) THEN a.s ELSE list_append(a.s, x) END"
_FULL = f"len({_NEXT}) <= 0.72::DOUBLE * (a.n + 1)"


def _one_way(tokens_: str) -> str:
    """The fold of lexical diversity over a list of tokens: words seen, their number, and runs so far."""
    return (
        f"list_reduce({tokens_}, lambda a, x: {{'s': CASE WHEN {_FULL} THEN []::VARCHAR[] ELSE {_NEXT} END, 'n': CASE WHEN {_FULL} THEN 0 ELSE a.n + 1 END, "
        f"'r': CASE WHEN {_FULL} THEN a.r + 1 ELSE a.r END}}, {{'s': []::VARCHAR[], 'n': 0, 'r': 0.0::DOUBLE}})"
    )


def mtld(low: str, docs: str) -> str:
    """``(doc_id, mtld)`` over a table with a list of lower-case tokens."""
    runs = "(r{0}.r + CASE WHEN r{0}.n > 0 THEN (1 - len(r{0}.s)::DOUBLE / r{0}.n) / (1 - 0.72::DOUBLE) ELSE 0 END)"
    one = "CASE WHEN {0} > 0 THEN n / {0} ELSE n END"
    a, b = (one.format(runs.format(i)) for i in (1, 2))
    return (
        f"SELECT doc_id, CASE WHEN n < 50 THEN 0.0 ELSE (({a}) + ({b})) / 2 END AS mtld FROM "
        f"(SELECT doc_id, len({low})::DOUBLE AS n, {_one_way(low)} AS r1, {_one_way(f'list_reverse({low})')} AS r2 FROM {docs})"
    )
