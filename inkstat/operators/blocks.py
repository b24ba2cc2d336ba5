"""Measures of one document, block by block, as Column expressions; the long table of all of them.

Everything is computed inside the document's row: tokens and sentences are arrays, so that no block shuffles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstat.functions import lexicons as lx
from inkstat.functions import numbers as nu
from inkstat.functions import text as tx
from inkstat.runtime import spread

MAX_CHARS = 200_000

def prepared(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token and sentence arrays of each document with text, once for all blocks. Of a text only its first ``MAX_CHARS``
    characters are measured, the default of the reference."""
    d = spread(docs.filter(F.length("text") > 0).select(*keep, F.substring("text", 1, MAX_CHARS).alias("text")), keep[0])
    d = d.withColumn("toks", tx.tokens(F.col("text"))).withColumn("parts", tx.sentences_with_tokens(F.col("text")))
    d = d.withColumns({
        "low": F.transform("toks", F.lower),
        "n": F.size("toks"),
        "sents": F.col("parts.s"),
        "lens": F.transform("parts", lambda p: F.size(p["t"])),
        "sent_toks": F.transform("parts", lambda p: F.transform(p["t"], F.lower)),
        "heads": F.transform("parts", lambda p: F.lower(F.get(p["t"], 0))),
        "unquoted": tx.drop_quoted(F.col("text")),
    })
    return d


def with_paragraphs(d: DataFrame) -> DataFrame:
    """Arrays of paragraphs and their lengths. Each array is a column of its own, made once: an expression over it that
    names it nine times would else split the text nine times."""
    d = d.withColumn("paras", tx.paragraphs(F.col("text")))
    d = d.withColumns({"para_sents": F.transform("paras", lambda p: F.greatest(F.lit(1), F.size(tx.sentences(p)))), "para_words": F.transform("paras", tx.n_tokens)})
    return d.withColumns({f"{c}_up": F.array_sort(c) for c in ("lens", "para_sents", "para_words")})


def surface(d: DataFrame) -> dict[str, Column]:
    lens, many = F.col("lens"), F.size("paras") >= 2
    out = nu.length_stats(lens, F.col("lens_up"), "sent_len")
    for prefix in ("para_sents", "para_words"):
        out |= {k: F.when(many, v) for k, v in nu.length_stats(F.col(prefix), F.col(prefix + "_up"), prefix).items()}
    n = F.greatest(F.size(lens), F.lit(1))
    return out | {
        "has_paragraph_breaks": many.cast("double"),
        "n_sentences": F.size("sents").cast("double"),
        "n_words": F.col("n").cast("double"),
        "short_sent_frac": F.size(F.filter(lens, lambda x: x <= 8)) / n,
        "long_sent_frac": F.size(F.filter(lens, lambda x: x >= 35)) / n,
    }


def _hapax() -> Column:
    """Words that come once: of the sorted tokens those unlike both neighbours."""
    s = F.col("low_up")
    once = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: ~F.coalesce(F.get(s, i - 1) == F.get(s, i - 2), F.lit(False)) & ~F.coalesce(F.get(s, i - 1) == F.get(s, i), F.lit(False)))
    return F.when(F.col("n") > 0, F.size(once)).otherwise(0)


NOMINAL = rf"(?iu)\A{tx.WC}{{4,}}(?:{'|'.join(lx.NOMINAL_SUFFIXES)})s?\z"


def lexical(d: DataFrame) -> dict[str, Column]:
    first = F.slice("low", 1, 500)
    types = F.size(F.array_distinct("low"))
    lens = F.transform("toks", F.length)
    n = F.col("n")
    return {
        "ttr_500": F.when(n > 0, F.size(F.array_distinct(first)) / F.size(first)).otherwise(0.0),
        "mtld": nu.mtld(F.col("low")),
        "hapax_rate": F.when(n > 0, _hapax() / types).otherwise(0.0),
        "type_count": types.cast("double"),
        "word_len_mean": nu.mean(lens),
        "word_len_sd": nu.deviation(lens, 0),
        "long_word_rate": nu.rate(F.size(F.filter("toks", lambda t: F.length(t) >= 8)), n),
        "nominalisation_rate": nu.rate(F.size(F.filter(F.regexp_extract_all("text", F.lit(f"({tx.WC}+)"), F.lit(1)), lambda w: w.rlike(NOMINAL))), n),
    }


MARKS = [
    ("comma", ","), ("semicolon", ";"), ("colon", ":"), ("em_dash", "—"), ("en_dash", "–"), ("hyphen", "-"), ("paren", "("), ("question", "?"),
    ("exclaim", "!"), ("quote", '"'), ("apostrophe", "'"),
]


def punctuation(d: DataFrame) -> dict[str, Column]:
    n = F.col("n")
    c = {k: F.length("text") - F.length(F.replace("text", F.lit(m), F.lit(""))) for k, m in MARKS}
    return {f"punct_{k}_rate": nu.rate(v, n) for k, v in c.items()} | {"punct_long_dash_rate": nu.rate(c["em_dash"] + c["en_dash"], n)}


def _among(words: list[str]) -> Column:
    return F.size(F.filter("low", lambda t: t.isin(words)))


TRICOLON = rf"(?iu)(?<!{tx.WC}){tx.WC}+(?:{tx.WS}+{tx.WC}+){{0,2}},{tx.WS}+{tx.WC}+(?:{tx.WS}+{tx.WC}+){{0,2}},{tx.WS}+and{tx.WS}+{tx.WC}+"


def discourse(d: DataFrame) -> dict[str, Column]:
    n, heads = F.col("n"), F.col("heads")
    ns = F.greatest(F.size("sents"), F.lit(1))
    kinds = F.array_distinct(heads)
    counts = F.transform(kinds, lambda k: F.size(F.filter(heads, lambda h: h == k)))
    share = F.transform(counts, lambda c: c / F.size(heads))
    out = {f"{k}_rate": nu.rate(_among(v), n) for k, v in (("hedge", lx.HEDGES), ("booster", lx.BOOSTERS), ("transition", lx.TRANSITIONS), ("first_person", lx.FIRST_PERSON))}
    return out | {
        "tricolon_rate": nu.rate(tx.count(F.col("text"), TRICOLON), n),
        "sent_initial_transition_frac": F.size(F.filter(heads, lambda h: h.isin(lx.TRANSITIONS))) / ns,
        "sent_initial_this_frac": F.size(F.filter(heads, lambda h: h == "this")) / ns,
        "opener_entropy": nu.total(F.transform(share, lambda p: -p * F.log2(p))),
        "opener_top1_frac": F.coalesce(F.array_max(counts) / F.size(heads), F.lit(0.0)),
    }


def phrase_pattern(phrase: str) -> str:
    return "(?iu)" + tx.bounded(re.escape(phrase).replace(r"\ ", rf"{tx.WS}+").replace("\\-", "-"))


def phrase_key(phrase: str) -> str:
    return "tell_" + re.sub(r"[^a-z0-9]+", "_", phrase.lower()).strip("_")


def with_phrase_counts(d: DataFrame) -> DataFrame:
    """Lower case and single spaces once for all phrases, then the count of each phrase once for all that is made of it."""
    d = d.withColumns({"flat_low": F.regexp_replace(F.lower("unquoted"), f"{tx.WS}+", " "), "n_used": tx.n_tokens(F.col("unquoted"))})
    flat = F.col("flat_low")

    def hits(p: str) -> Column:
        # most phrases are not there: a plain search spares the pattern
        return F.when(F.contains(flat, F.lit(p)), tx.count(flat, tx.bounded(re.escape(p).replace("\\-", "-").replace("\\ ", " ")))).otherwise(0)

    return d.withColumn("phrase_counts", F.array(*[hits(p) for p in lx.STOCK_PHRASES]))


def phrases(d: DataFrame) -> dict[str, Column]:
    """Rates of stock phrases that are used, not quoted."""
    n, every = F.col("n_used"), F.col("phrase_counts")
    out = {phrase_key(p): nu.rate(every[i], n) for i, p in enumerate(lx.STOCK_PHRASES)}
    used = F.when(n > 0, F.size(F.filter(every, lambda x: x > 0))).otherwise(0)
    return out | {"tell_distinct_count": used.cast("double"), "tell_total_rate": nu.rate(F.aggregate(every, F.lit(0), lambda a, x: a + x), n)}


_UNIT = "|".join(re.escape(u) for u in lx.UNITS)
#: The unit ends at the edge of a word; after % that is only before a letter or digit.
QUANTITY = rf"(?<!{tx.WC})\d+(?:\.\d+)?{tx.WS}*(?:(?:{_UNIT.replace('%|', '')})(?!{tx.WC})|%(?={tx.WC}))"


def specificity(d: DataFrame) -> dict[str, Column]:
    """Per thousand words between white space; no values at all for a text of none."""
    t, n = F.col("text"), tx.count(F.col("text"), f"{tx.NOT_WS}+")
    c = {
        "numeric_token_rate": tx.count(t, rf"{tx.NOT_WS}*\d{tx.NOT_WS}*"),
        "quantity_rate": tx.count(t, QUANTITY),
        "decimal_rate": tx.count(t, tx.bounded(r"\d+\.\d+")),
        "acronym_rate": tx.count(t, tx.bounded("[A-Z]{2,}[0-9]*")),
        "digit_char_rate": tx.count(t, r"\p{Nd}"),
    }
    return {k: F.when(n > 0, F.lit(1000.0) * v / n) for k, v in c.items()}


CONCESSIVE = tx.bounded("|".join(lx.CONCESSIVES))


def register(d: DataFrame) -> dict[str, Column]:
    n, u = F.col("n"), F.col("unquoted_low")  # patterns that need not fold case at every character
    used = F.transform("sents", lambda s: F.lower(tx.drop_quoted(s)))
    balanced = F.size(F.filter(used, lambda s: s.rlike(CONCESSIVE) | s.rlike(lx.COUNTERWEIGHT)))
    out = {
        "concessive_rate": tx.count(u, CONCESSIVE),
        "counterweight_rate": tx.count(u, lx.COUNTERWEIGHT),
        "contrastive_rate": tx.count(u, lx.CONTRASTIVE),
        "attenuator_rate": tx.count(u, tx.bounded(lx.ATTENUATOR)),
    }
    out = {k: F.when(n > 0, nu.rate(v, n)) for k, v in out.items()}
    return out | {"balanced_sentence_frac": F.when(n > 0, balanced / F.greatest(F.size("sents"), F.lit(1)))}


BLOCKS = {
    "surface": surface, "lexical": lexical, "punctuation": punctuation, "discourse": discourse, "tells": phrases, "specificity": specificity, "register": register,
}


def _needs(d: DataFrame, name: str) -> DataFrame:
    """The columns a block needs besides those of ``prepared``."""
    if name == "surface":
        return with_paragraphs(d)
    if name == "register":
        return d.withColumn("unquoted_low", F.lower("unquoted"))
    if name == "tells":
        return with_phrase_counts(d)
    return d.withColumn("low_up", F.array_sort("low")) if name == "lexical" else d


def block(docs: DataFrame, name: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One block in wide form."""
    d = _needs(prepared(docs, keep), name)
    return d.select(*keep, *[v.alias(k) for k, v in BLOCKS[name](d).items()])


def _used(low: Column, n: Column) -> dict[str, Column]:
    """Rates of function words; words not used have 0. ``low`` holds the function words of a text only."""
    return {f"fw_{w}": nu.rate(F.size(low) - F.size(F.array_remove(low, w)), n) for w in lx.FUNCTION_WORDS}


def function_words(docs: DataFrame) -> DataFrame:
    """``(doc_id, feature, value)`` for each document and function word in its first ``MAX_CHARS`` characters; words not used
    have 0."""
    d = spread(docs.filter(F.length("text") > 0).select("doc_id", F.substring("text", 1, MAX_CHARS).alias("text")), "doc_id")
    d = d.select("doc_id", tx.lower_tokens(F.col("text")).alias("low"))
    some = F.filter("low", lambda t: t.isin(lx.FUNCTION_WORDS))
    d = d.select("doc_id", F.size("low").alias("n"), some.alias("s"))
    kinds = d.select("doc_id", "n", "s", F.explode(F.array(*[F.lit(w) for w in lx.FUNCTION_WORDS])).alias("w"))
    c = F.size("s") - F.size(F.array_remove("s", F.col("w")))
    return kinds.select("doc_id", F.concat(F.lit("fw_"), "w").alias("feature"), nu.rate(c, F.col("n")).alias("value"))


def measures(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), names: tuple[str, ...] = tuple(BLOCKS), places: int | None = None) -> tuple[DataFrame, list[str]]:
    """``(keep ..., measures array<double>)`` and the names of the measures: all blocks of a document in one row, from one
    reading of its text. What is undefined for a document is null, which is not 0."""
    d = prepared(docs, keep).withColumn("fw", F.filter("low", lambda t: t.isin(lx.FUNCTION_WORDS)))
    for b in names:
        d = _needs(d, b)
    cols = _used(F.col("fw"), F.col("n"))
    for b in names:
        cols |= BLOCKS[b](d)
    none = F.lit(None).cast("double")
    values = [F.nanvl(v.cast("double"), none) for v in cols.values()]
    values = values if places is None else [F.round(v, places) for v in values]
    return d.select(*keep, F.array(*values).alias("measures")), list(cols)


def as_long(wide: DataFrame, names: list[str], *keep: str) -> DataFrame:
    """``(keep ..., feature, value)`` of rows of ``measures``."""
    label = F.array(*[F.lit(n) for n in names])
    # not the column itself: from that a filter on its size is inferred, which would make the array once more
    x = wide.select(*keep, F.posexplode(F.slice("measures", 1, len(names))).alias("i", "value"))
    return x.select(*keep, F.element_at(label, F.col("i") + 1).alias("feature"), "value")


def features_long(docs: DataFrame, names: tuple[str, ...] = tuple(BLOCKS)) -> DataFrame:
    """``(doc_id, feature, value)`` of the blocks."""
    w, cols = measures(docs, names=names)
    return as_long(w, cols, "doc_id")


def feature_group(name: Column) -> Column:
    """The first group with a prefix that fits, else ``other``."""
    c = None
    for g, prefixes in lx.FEATURE_GROUPS:
        hit = name.rlike("^(?:" + "|".join(map(re.escape, prefixes)) + ")")
        c = F.when(hit, g) if c is None else c.when(hit, g)
    return c.otherwise("other")
