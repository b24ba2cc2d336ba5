"""N-gram references and what a text has that they have not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkstat.functions import lexicons as lx
from inkstat.functions import text as tx
from inkstat.runtime import cut, spread


def grams(tokens: Column, n: int) -> Column:
    """The n-grams of a token array in order, made inside the row, so that counting them is the only shuffle."""
    parts = [F.slice(tokens, i + 1, F.greatest(F.size(tokens) - n + 1, F.lit(0))) for i in range(n)]
    if n == 1:
        return tokens
    return F.transform(F.arrays_zip(*[p.alias(f"w{i}") for i, p in enumerate(parts)]), lambda z: F.concat_ws(" ", *[z[f"w{i}"] for i in range(n)]))


def counts(docs: DataFrame, n: int, least: int = 1) -> DataFrame:
    """``(gram, n)``: n-grams of all documents, across sentences and not across documents, that come up ``least`` times."""
    low = spread(docs.filter("text IS NOT NULL").select("doc_id", "text"), "doc_id").select(tx.lower_tokens(F.col("text")).alias("low"))
    return low.select(F.explode(grams(F.col("low"), n)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def reference(docs: DataFrame, uni: int = 2, bi: int = 5, tri: int = 4) -> DataFrame:
    """``(size, gram, n)`` of the three orders with their thresholds, in one reading and one shuffle."""
    low = spread(docs.filter("text IS NOT NULL").select("doc_id", "text"), "doc_id").select(tx.lower_tokens(F.col("text")).alias("low"))
    all_ = F.concat(*[F.transform(grams(F.col("low"), k), _sized(k)) for k in (1, 2, 3)])
    g = low.select(F.explode(all_).alias("g")).groupBy("g.size", "g.gram").agg(F.count("*").alias("n"))
    return g.filter(F.col("n") >= F.when(F.col("size") == 1, uni).when(F.col("size") == 2, bi).otherwise(tri))


def _sized(k: int):
    return lambda g: F.struct(F.lit(k).alias("size"), g.alias("gram"))


def total_words(docs: DataFrame) -> DataFrame:
    return docs.filter("text IS NOT NULL").agg(F.sum(tx.n_tokens(F.col("text"))).cast("bigint").alias("total_words"))


def connective(gram: Column) -> Column:
    """At least two words of the function list, and none of 14 letters or more."""
    ws = F.split(gram, " ")
    return (F.size(F.filter(ws, lambda w: w.isin(lx.FUNCTION_WORDS))) >= 2) & (F.size(F.filter(ws, lambda w: F.length(w) >= 14)) == 0)


def formulas(docs: DataFrame, k: int = 60, tri: int = 4) -> DataFrame:
    """``(gram, n, per_million)``: the most frequent connective trigrams; ties by the later gram first."""
    t = counts(docs, 3, tri).filter(connective(F.col("gram"))).orderBy(F.desc("n"), F.desc("gram")).limit(k)
    return t.crossJoin(F.broadcast(total_words(docs))).select("gram", "n", (1e6 * F.col("n") / F.col("total_words")).alias("per_million"))


def missing_formulas(drafts: DataFrame, docs: DataFrame, k: int = 60) -> DataFrame:
    """``(doc_id, gram, per_million)``: formulas each draft does not use. The list has at most ``k`` rows."""
    f = formulas(docs, k).agg(F.collect_list(F.struct("gram", "per_million")).alias("forms"))  # one row of at most k
    d = drafts.filter("text IS NOT NULL").select("doc_id", F.array_distinct(grams(tx.lower_tokens(F.col("text")), 3)).alias("has"))
    lacks = F.explode(F.filter("forms", lambda z: ~F.array_contains("has", z["gram"]))).alias("z")
    return d.crossJoin(F.broadcast(f)).select("doc_id", lacks).select("doc_id", "z.gram", "z.per_million")


def formula_coverage(drafts: DataFrame, docs: DataFrame, k: int = 60, low: float = 0.07) -> DataFrame:
    """``(doc_id, coverage, verdict)``: the share of the ``k`` formulas used; ``k`` divides even if there are fewer."""
    m = missing_formulas(drafts, docs, k).groupBy("doc_id").agg(F.count("*").alias("missing"))
    d = drafts.filter("text IS NOT NULL").select("doc_id").join(m, "doc_id", "left")
    c = (F.lit(k) - F.coalesce("missing", F.lit(0))) / F.lit(k)
    return d.select("doc_id", c.alias("coverage"), F.when(c < low, "low").otherwise("in range").alias("verdict"))


def missing_shown(drafts: DataFrame, docs: DataFrame, k: int = 60, shown: int = 8, low: float = 0.07) -> DataFrame:
    """``(doc_id, place, gram, per_million)``: for drafts of low coverage the ``shown`` most frequent formulas they do not use."""
    low_ = formula_coverage(drafts, docs, k, low).filter("verdict = 'low'").select("doc_id")
    m = missing_formulas(drafts, docs, k).join(low_, "doc_id", "left_semi")
    place = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("per_million"), F.desc("gram")))
    return m.withColumn("place", place.cast("bigint")).filter(F.col("place") <= shown).select("doc_id", "place", "gram", "per_million")


def unattested_pairs(drafts: DataFrame, docs: DataFrame, twice: int = 2, bi: int = 5) -> DataFrame:
    """``(doc_id, gram, n)``: pairs a draft uses at least twice and the reference under five times; short words and
    pairs of function words are passed over."""
    d = drafts.filter("text IS NOT NULL").select("doc_id", F.explode(grams(tx.lower_tokens(F.col("text")), 2)).alias("gram"))
    d = d.groupBy("doc_id", "gram").agg(F.count("*").alias("n")).filter(F.col("n") >= twice)
    a, b = F.split_part("gram", F.lit(" "), F.lit(1)), F.split_part("gram", F.lit(" "), F.lit(2))
    d = d.filter((F.length(a) >= 3) & (F.length(b) >= 3) & ~(a.isin(lx.FUNCTION_WORDS) & b.isin(lx.FUNCTION_WORDS)))
    return d.join(counts(docs, 2, bi).select("gram"), "gram", "left_anti").select("doc_id", "gram", "n")


def out_of_vocabulary(drafts: DataFrame, vocabulary: DataFrame, per_million: float = 1.0) -> DataFrame:
    """``(doc_id, word, used, per_million)``: words of four letters or more, no function words, that the vocabulary
    ``(word, n)`` has less than once in a million; absent ones have 0."""
    total = vocabulary.agg(F.sum("n").alias("total"))
    d = drafts.filter("text IS NOT NULL").select("doc_id", F.explode(tx.lower_tokens(F.col("text"))).alias("word"))
    d = d.filter((F.length("word") >= 4) & ~F.col("word").isin(lx.FUNCTION_WORDS)).groupBy("doc_id", "word").agg(F.count("*").alias("used"))
    x = d.join(vocabulary.select("word", "n"), "word", "left").crossJoin(F.broadcast(total))
    rate = 1e6 * F.coalesce("n", F.lit(0)) / F.col("total")
    return x.select("doc_id", "word", "used", rate.alias("per_million")).filter(F.col("per_million") < per_million)


def continuations(drafts: DataFrame, docs: DataFrame, k: int = 4, bi: int = 5, tri: int = 4) -> DataFrame:
    """``(doc_id, sent_no, gram, attested_pair, suggestions)``: trigrams of a draft's sentences that the reference has not, and
    the ``k`` words the reference puts after their first two."""
    s = drafts.filter("text IS NOT NULL").select("doc_id", F.posexplode(tx.simple_sentences(F.col("text"))).alias("sent_no", "sent"))
    s = s.filter(F.size(tx.split_words(F.col("sent"))) > 3)
    s = s.select("doc_id", "sent_no", F.explode(grams(tx.lower_tokens(F.col("sent")), 3)).alias("gram"))
    both = cut(reference(docs, 1 << 30, bi, tri))  # pairs and trigrams counted once
    ref = both.filter("size = 3").select("gram", "n")
    miss = s.join(ref.select("gram"), "gram", "left_anti").withColumn("pair", F.substring_index("gram", " ", 2))
    by = W.partitionBy("pair").orderBy(F.desc("n"), "word")
    asked = miss.select("pair").distinct()  # nothing is suggested for other pairs
    top = ref.withColumn("pair", F.substring_index("gram", " ", 2)).join(asked, "pair", "left_semi")
    top = top.select("pair", F.substring_index("gram", " ", -1).alias("word"), "n").withColumn("place", F.row_number().over(by)).filter(F.col("place") <= k)
    top = top.groupBy("pair").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word", "n"))), lambda z: F.concat(z["word"], F.lit(" ("), z["n"].cast("string"), F.lit(")"))), ", ").alias("suggestions"))
    pairs = both.filter("size = 2").select(F.col("gram").alias("pair"), F.lit(True).alias("known"))
    x = miss.join(top, "pair", "left").join(pairs, "pair", "left")
    return x.select("doc_id", F.col("sent_no").cast("bigint").alias("sent_no"), "gram", F.coalesce("known", F.lit(False)).alias("attested_pair"), F.coalesce("suggestions", F.lit("")).alias("suggestions"))
