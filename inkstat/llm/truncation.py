"""Problem 3: text and metadata cut off by a field limit or a broken transfer.

Method: a stack automaton reads each value from its first character to its last. Opening quotes, brackets and elements are
pushed, closing ones pop; a blank line takes off the quotes and brackets prose left open, not elements. Inside a tag, an
entity, an escape or a character the automaton is in a state of its own, and in prose it is inside a sentence until a
terminator. What it ends in are the states ``quote``, ``bracket``, ``markup``, ``escape``, ``bytes`` and ``sentence``. A
state shows a cut only in a source whose texts seldom end in it (the baseline). Besides, a text is cut if it is shorter
than the size noted for it, or as long as its source cuts.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm.lines import ENDS, KIND_KEYWORDS, kind
from inkstat.llm.pages import furniture, wrapped
from inkstat.runtime import cut, spread

#: A length is a limit of a source if at least so many of its texts have it, ``LIMIT_TIMES`` as many as other lengths of
#: the same hundred have on average, and most of them end in some state of the automaton.
LIMIT_ROWS, LIMIT_TIMES = 4, 8
#: A state in which more than this share of a source's prose ends says nothing there.
STATE_SHARE = 0.5
STATES = ("quote", "bracket", "markup", "escape", "bytes", "sentence")

_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "「": "」", "『": "』", "«": "»", "„": "“”", "“": "”", "《": "》", "【": "】"}
_CLOSE = {c for v in _PAIRS.values() for c in v}
_QUOTES = "\"«„“「『"
# What the automaton reads at once: a blank line, either end of a comment, a tag, the beginning of one, an entity, an escape, a mark.
_READ = re.compile(
    r"(?P<blank>\n[^\S\n]*\n)|(?P<comment><!--|-->)|<(?P<end>/?)(?P<tag>[A-Za-z][A-Za-z0-9:]{0,30})(?:\s[^<>\n]{0,400})?(?P<void>/?)>"
    r"|(?P<open><[/!]?[A-Za-z][^<>\n]{0,400}\Z)"
    r"|(?P<whole>\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|\\[^ux]|&#?\w{1,10};|%[0-9A-Fa-f]{2})|(?P<broken>(?:\\(?:u[0-9A-Fa-f]{0,3}|x[0-9A-Fa-f]?)?|&(?:#?\w{1,6}|\#)?|%[0-9A-Fa-f]?)\Z)"
    r"|(?P<bytes>�\Z)|(?P<mark>[\"(){}\[\]（）「」『』«»„“”《》【】])"
)
# Elements that need no end.
_NO_END = {"br", "hr", "img", "input", "meta", "link", "wbr", "col", "p", "li", "dt", "dd", "td", "th", "tr", "option"}
_THAI = re.compile("[฀-๿]")
_SIGNATURE = re.compile(r"(?:[^\W\d_]\. ?){1,3}[^\W\d_][\w'’-]+\Z|[—–-] ?[^\W\d_]\S+(?: \S+){0,3}\Z")
_CITATION = re.compile(r"(?:\s*(?:\[\d{1,4}(?:[,–-] ?\d{1,4})*\]|\(\d{1,4}\)))+\Z")
_HEADING = re.compile(r"\d{1,2}(?:\.\d{1,2}){0,3}\.?\s+[^\W\d_]")
# Abbreviations that want something after them; a text that ends with one goes on.
_WANTS_MORE = re.compile(
    r"(?:\b(?:Dr|Prof|Mr|Mrs|Ms|Sra|Sr|Dra|Fig|Figs|Eq|Eqs|Sect|Vol|No|Nos|pp|cf|vs|approx|e\.g|i\.e|ca|Abb|Tab|Vgl|Nr|bzw|z\. ?B|d\. ?h|pág|p\. ?ej|p\. ?ex|aprox|env|St)|\bet al|\bU\.S|\b[ivx]?p"
    r"|(?<!\w)(?:см|рис|табл|ок|напр|стр|т|ص|د|डॉ))\.\Z"
)

_SCHEMA = """doc_id string, source string, n_chars bigint, n_bytes bigint, n_words bigint, short boolean,
    ended array<string>, tail string, meta_cut boolean, has_text boolean, has_meta boolean"""


def _take(stack: list[str], fits: Callable[[str], bool]) -> None:
    """Pop down to the topmost symbol that ``fits``; a closing mark without partner is forgiven."""
    for i in range(len(stack) - 1, -1, -1):
        if fits(stack[i]):
            del stack[i:]
            return


def end_states(text: str) -> tuple[list[str], str]:
    """What is on the stack at the end of a text, outermost first (elements as ``<name``), and the state of the reading
    head: ``text``, ``markup``, ``escape`` or ``bytes``."""
    stack: list[str] = []
    head = "text"
    for m in _READ.finditer(text):
        kind_ = m.lastgroup if m.lastgroup not in ("end", "tag", "void") else "tag"
        if kind_ == "mark":
            c = m.group()
            if c == '"':
                if '"' in stack:
                    del stack[stack.index('"') :]
                else:
                    stack.append(c)
            elif c in _CLOSE and any(c in _PAIRS.get(x, "") for x in stack):
                _take(stack, lambda x, c=c: c in _PAIRS.get(x, ""))
            elif c in _PAIRS:
                stack.append(c)
        elif kind_ == "blank":
            stack = [x for x in stack if x[0] == "<"]
        elif kind_ == "comment":
            if m.group() == "-->":
                _take(stack, lambda x: x == "<!--")
            else:
                stack.append("<!--")
        elif kind_ == "tag":
            name = "<" + m.group("tag").lower()
            if m.group("end"):
                _take(stack, lambda x, name=name: x == name)
            elif not m.group("void") and name[1:] not in _NO_END:
                stack.append(name)
        elif kind_ in ("open", "broken", "bytes"):
            head = {"open": "markup", "broken": "escape", "bytes": "bytes"}[kind_]
    return stack, head


def states_of(text: str) -> list[str]:
    """The states of STATES but ``sentence`` in which a text ends."""
    stack, head = end_states(text)
    has = {
        "quote": any(x in _QUOTES for x in stack), "bracket": any(x in _PAIRS and x not in _QUOTES for x in stack),
        "markup": head == "markup" or any(x[0] == "<" for x in stack), "escape": head == "escape", "bytes": head == "bytes",
    }
    return [s for s in STATES if has.get(s)]


def structure_open(value: str) -> bool:
    """Whether a JSON value (or one written with single quotes) lacks its end: a string, object or array still open,
    a broken escape, or nothing but a prefix of a literal."""
    s = value.strip()
    if not s:
        return False
    try:
        json.loads(s)
        return False
    except ValueError:
        pass
    if s[0] not in "{[\"'":
        return False
    stack: list[str] = []
    quote, i, n = "", 0, len(s)
    while i < n:
        c = s[i]
        if quote:
            if c == "\\":
                i += 1
            elif c == quote:
                quote = ""
        elif c in "\"'":
            quote = c
        elif c in "{[":
            stack.append(c)
        elif c in "}]":
            if stack:
                stack.pop()
        i += 1
    return bool(stack or quote) or i > n


def tail(text: str, quick: bool = False) -> tuple[str, bool]:
    """What the end of a text is, and whether prose lacks its terminator there. ``quick``: without asking what kind of
    text it is where it ends with a terminator."""
    lines = text.split("\n")
    whole = text.rstrip()
    if quick and ENDS.search(whole[-12:]) and not _WANTS_MORE.search(whole[-40:]):
        return "stop", False
    page = wrapped(lines)
    out = furniture(lines) if page else [False] * len(lines)
    body = [x for x, f in zip(lines, out) if not f]
    while body and not body[-1].strip():
        body.pop()
    if not body:
        return "furniture", False
    last = body[-1].strip()
    alone = len(body) < 2 or not body[-2].strip()
    if any(out[-3:]) and page and ENDS.search(last):
        return "page", False
    kinds = Counter()
    for x in body:
        k = kind(x)
        if k != "blank":
            kinds[k] += len(x)
    k = kind(body[-1])
    prose = kinds["prose"] / max(1, sum(kinds.values()))
    if k != "prose" and (prose < 0.6 or k in ("table", "contents", "log", "junk", "menu", "reference", "formula", "bullet")):
        return k, False
    if prose < 0.5:
        return max(kinds, key=kinds.get), False
    if KIND_KEYWORDS.match(last) and (alone or ":" in last[:40]):
        return "keywords", False
    if alone and _SIGNATURE.match(last) and len(last) < 60:
        return "signature", False
    if _THAI.search(last[-12:]):
        return "thai", False
    if not ENDS.search(last) and ENDS.search(_CITATION.sub("", last)):
        return "stop", False
    if ENDS.search(last):
        return ("abbreviation", True) if _WANTS_MORE.search(last) else ("stop", False)
    if page and _HEADING.match(last):
        return "heading", True
    return "open", True


def shorter(text: str, meta: str | None) -> bool:
    """Whether the text is smaller than the size its metadata note."""
    try:
        m = json.loads(meta) if meta else None
    except ValueError:
        return False
    if not isinstance(m, dict):
        return False
    for key, now in (("chars", len), ("bytes", lambda t: len(t.encode("utf-8", "surrogatepass"))), ("words", lambda t: len(t.split()))):
        v = m.get(key)
        if isinstance(v, (int, float)) and not isinstance(v, bool) and now(text) < v:
            return True
    return False


def inspect(text: str | None, meta: str | None) -> tuple:
    """One row of the inspection but for doc_id and source."""
    if text and text.strip():
        ended = states_of(text)
        kind_, missing = tail(text, quick=not ended)
        prose = kind_ in ("open", "stop", "abbreviation", "heading")
        if not prose:  # signs in lists, tables and junk mean nothing; half a character does, but in junk
            ended = [s for s in ended if s == "bytes" and kind_ != "junk"]
        if missing:
            ended.append("sentence")
        row = (len(text), len(text.encode("utf-8", "surrogatepass")), len(text.split()), shorter(text, meta), ended, kind_)
    else:
        row = (len(text or ""), len(text or ""), 0, False, [], "empty")
    return (*row, bool(meta) and structure_open(meta), bool(text and text.strip()), bool(meta and meta.strip()))


def inspected(docs: DataFrame) -> DataFrame:
    """What the automaton says of each document, once for each doc_id; rows with null doc_id are left out. A meta column
    that is not a string is read as its JSON."""
    meta = F.col("meta") if docs.schema["meta"].dataType.simpleString() == "string" else F.to_json("meta")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = [
                (i, s, *inspect(t if isinstance(t, str) else None, m if isinstance(m, str) else None))
                for i, s, t, m in zip(b["doc_id"], b["source"], b["text"], b["meta"])
            ]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SCHEMA.split(",")])

    d = docs.filter("doc_id IS NOT NULL").select("doc_id", F.lower(F.trim("source")).alias("source"), "text", meta.alias("meta"))
    return spread(d, "doc_id").mapInPandas(run, _SCHEMA).dropDuplicates(["doc_id"])


def limits(x: DataFrame) -> DataFrame:
    """``(source, unit, at)``: lengths at which a source cuts: many texts have just this length, most of them without
    a proper end. A source may have several."""
    units = F.explode(F.create_map(F.lit("chars"), F.col("n_chars"), F.lit("bytes"), F.col("n_bytes"), F.lit("words"), F.col("n_words"))).alias("unit", "at")
    c = x.filter("has_text").select("source", (F.size("ended") > 0).alias("bad"), units)
    c = c.groupBy("source", "unit", "at").agg(F.count("*").alias("n"), F.count_if("bad").alias("bad"))
    near = c.groupBy("source", "unit", F.floor(F.col("at") / 100).alias("hundred")).agg(F.sum("n").alias("all"), F.count("*").alias("lengths"))
    c = c.withColumn("hundred", F.floor(F.col("at") / 100)).join(near, ["source", "unit", "hundred"])
    other = (F.col("all") - F.col("n")) / F.greatest(F.col("lengths") - 1, F.lit(1))
    return c.filter((F.col("n") >= LIMIT_ROWS) & (F.col("n") >= LIMIT_TIMES * other) & (F.col("bad") >= 0.6 * F.col("n"))).select("source", "unit", "at")


def baselines(x: DataFrame) -> DataFrame:
    """``(source, silent)``: the states in which more than ``STATE_SHARE`` of the source's prose ends."""
    prose = x.filter("has_text AND tail IN ('open', 'stop', 'abbreviation', 'heading')")
    share = prose.groupBy("source").agg(*[F.avg(F.array_contains("ended", s).cast("int")).alias(s) for s in STATES])
    return share.select("source", F.array_compact(F.array(*[F.when(F.col(s) > STATE_SHARE, F.lit(s)) for s in STATES])).alias("silent"))


def judged(docs: DataFrame) -> DataFrame:
    """``(doc_id, source, ..., at_limit, shows, text_cut, meta_cut)`` of each document: ``shows`` are the states that show a
    cut by the source's baseline. Null and empty values are not cut."""
    x = cut(inspected(docs))
    lim = limits(x).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(":", "unit", "at"), F.lit(True)))).alias("limits"))
    src = x.select("source").distinct().join(baselines(x), "source", "left").join(lim, "source", "left")
    x = x.join(src, x["source"].eqNullSafe(src["source"]), "left").drop(src["source"])
    hit = [F.coalesce(F.try_element_at("limits", F.concat_ws(":", F.lit(u), F.col(c).cast("string"))), F.lit(False)) for u, c in (("chars", "n_chars"), ("bytes", "n_bytes"), ("words", "n_words"))]
    x = x.withColumn("at_limit", F.col("has_text") & (hit[0] | hit[1] | hit[2]))
    x = x.withColumn("shows", F.array_except("ended", F.coalesce("silent", F.array().cast("array<string>"))))
    return x.withColumn("text_cut", F.col("has_text") & (F.col("short") | F.col("at_limit") | (F.size("shows") > 0))).drop("limits", "silent")


def cut_fields(docs: DataFrame) -> DataFrame:
    """``(doc_id, field)`` of the values that lack their end; field is ``text`` or ``meta``."""
    x = judged(docs)
    f = F.explode(F.filter(F.array(F.when(F.col("text_cut"), "text"), F.when(F.col("meta_cut"), "meta")), lambda v: v.isNotNull())).alias("field")
    return x.select("doc_id", f)


def by_source(docs: DataFrame) -> DataFrame:
    """``(source, documents, text_cut, meta_cut, cut_share)``: cut_share is the share of documents with a cut value."""
    return judged(docs).groupBy("source").agg(
        F.count("*").alias("documents"), F.count_if("text_cut").alias("text_cut"), F.count_if("meta_cut").alias("meta_cut"),
        F.avg((F.col("text_cut") | F.col("meta_cut")).cast("int")).alias("cut_share"),
    )


def by_state(docs: DataFrame) -> DataFrame:
    """``(source, state, texts, shown, alone)``: texts that end in a state of the automaton, those of which it shows a cut,
    and those that nothing else shows to be cut."""
    x = judged(docs).filter("has_text")
    one = x.select("source", "short", "at_limit", "shows", F.explode("ended").alias("state"))
    shown = F.array_contains("shows", F.col("state"))
    return one.groupBy("source", "state").agg(
        F.count("*").alias("texts"), F.count_if(shown).alias("shown"), F.count_if(shown & (F.size("shows") == 1) & ~F.col("short") & ~F.col("at_limit")).alias("alone")
    )
