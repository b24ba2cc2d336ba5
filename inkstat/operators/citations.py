"""How a cited corpus cites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.functions import lexicons as lx
from inkstat.functions import text as tx
from inkstat.operators.statistics import order_statistics

MARKER = r"\[(?:\d{1,3}|n)(?:[ ]?[,–-][ ]?\d{1,3})*\]"
NAMED = r"(?<![\p{L}\p{N}_])[A-Z][a-z]+ (?:et al\.?|and (?:co-?workers|colleagues))"
NAMED_VERB = rf"{NAMED}{tx.WS}*(?:\[[^\]]+\])?{tx.WS}*(?:have |has |also |recently |first )?(?:{'|'.join(lx.REPORTING_VERBS)})(?!{tx.WC})"
_EDGE = rf"(?:(?<={tx.WC})(?!{tx.WC})|(?<!{tx.WC})(?={tx.WC}))"
INTRODUCER = rf"(?i){_EDGE}({'|'.join(lx.INTRODUCERS)}){_EDGE}"
QUOTE = "[\"“][^\"”]{30,}[\"”]"


def texts(docs: DataFrame) -> DataFrame:
    return docs.filter(F.length("text") > 0).select("doc_id", F.replace("text", F.lit("\n"), F.lit(" ")).alias("text")).dropDuplicates(["doc_id"])


def sentences(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, sent, n_words, markers)`` of sentences of 5 to 90 words."""
    s = texts(docs).select("doc_id", F.posexplode(tx.simple_sentences(F.col("text"))).alias("pos", "sent"))
    s = s.withColumn("n_words", tx.count(F.col("sent"), f"{tx.NOT_WS}+")).filter(F.col("n_words").between(5, 90))
    return s.withColumn("markers", tx.count(F.col("sent"), MARKER))


def density(docs: DataFrame) -> DataFrame:
    """``(doc_id, words, markers, per_1000, citing_share, named, quotes)`` of each document."""
    d = texts(docs).select("doc_id", *[c.cast("bigint").alias(k) for k, c in (("words", tx.n_tokens(F.col("text"))), ("markers", tx.count(F.col("text"), MARKER)), ("named", tx.count(F.col("text"), NAMED)), ("quotes", tx.count(F.col("text"), QUOTE)))])
    s = sentences(docs).groupBy("doc_id").agg(F.count_if(F.col("markers") > 0).alias("citing"), F.count("*").alias("sents"))
    x = d.join(s, "doc_id", "left").fillna(0, ["citing", "sents"])
    return x.select(
        "doc_id", "words", "markers", F.when(F.col("words") > 0, 1000.0 * F.col("markers") / F.col("words")).otherwise(0.0).alias("per_1000"),
        (F.col("citing") / F.greatest("sents", F.lit(1))).alias("citing_share"), "named", "quotes",
    )


def bands(docs: DataFrame) -> DataFrame:
    """``(measure, p05, p25, p50, p75, p95)`` by lower rank."""
    x = density(docs)
    long = x.select(F.explode(F.array(F.struct(F.lit("per_1000").alias("measure"), F.col("per_1000").alias("v")), F.struct(F.lit("citing_share").alias("measure"), F.col("citing_share").alias("v")))).alias("m")).select("m.*")
    return order_statistics(long, "measure", "v", {f"p{int(q * 100):02d}": q for q in (0.05, 0.25, 0.5, 0.75, 0.95)})


def markers(docs: DataFrame) -> DataFrame:
    """``(doc_id, pos, nth, cluster, position, before, after)``: one row for each marker of a citing sentence. A range counts its two
    ends, ``[n]`` counts none; ``before`` are the two words in front, ``after`` is the word behind one in mid-sentence."""
    s = sentences(docs).filter("markers > 0")
    s = s.select("doc_id", "pos", "sent", F.split("sent", MARKER, -1).alias("rest"), F.regexp_extract_all("sent", F.lit(f"({MARKER})"), F.lit(1)).alias("hits"))
    s = s.select("doc_id", "pos", "rest", "hits", F.posexplode("hits").alias("nth", "hit"))
    head = F.aggregate(F.sequence(F.lit(0), F.col("nth")), F.lit(""), lambda a, i: F.concat(a, F.when(i > 0, F.get("hits", i - 1)).otherwise(""), F.get("rest", i)))
    rest_after = F.slice("rest", F.col("nth") + 2, F.size("rest"))
    tail = F.aggregate(F.sequence(F.lit(1), F.size(rest_after)), F.lit(""), lambda a, i: F.concat(a, F.when(i > 1, F.get("hits", F.col("nth") + i - 1)).otherwise(""), F.get(rest_after, i - 1)))
    s = s.withColumns({"head": head, "tail": tx.strip(tail)})
    bare = F.regexp_replace("tail", r"\A[ .]+|[ .]+\z", "") == ""
    stop = F.substring("tail", 1, 1).isin(",", ";", ")")
    words = tx.lower_tokens(F.col("head"))
    position = F.when(bare, "sentence-final").when(stop, "before , ; or )").otherwise("mid-sentence")
    return s.select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("nth").cast("bigint").alias("nth"), F.least(tx.count(F.col("hit"), r"\d+"), F.lit(5)).cast("bigint").alias("cluster"), position.alias("position"),
        F.array_join(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), 2), " ").alias("before"), F.when(position == "mid-sentence", F.coalesce(F.get(tx.lower_tokens(F.col("tail")), 0), F.lit(""))).alias("after"),
    )


def position_counts(docs: DataFrame) -> DataFrame:
    return markers(docs).groupBy("position", "cluster").agg(F.count("*").alias("n"))


def top_before(docs: DataFrame, k: int = 40) -> DataFrame:
    return markers(docs).groupBy("before").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "before").limit(k)


def top_after(docs: DataFrame, k: int = 20) -> DataFrame:
    """``(after, n)``: the words that most often follow a marker in mid-sentence."""
    return markers(docs).filter("after IS NOT NULL").groupBy("after").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "after").limit(k)


def named_with_verb(docs: DataFrame) -> DataFrame:
    """``(documents, named, named_with_verb, markers, words, share)``: one row; share is that of citations which name an author and
    report by a verb."""
    d = texts(docs).select(*[c.alias(n) for n, c in (("named", tx.count(F.col("text"), NAMED)), ("verb", tx.count(F.col("text"), NAMED_VERB)), ("markers", tx.count(F.col("text"), MARKER)), ("words", tx.n_tokens(F.col("text"))))])
    g = d.agg(F.count("*").alias("documents"), *[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("named", "named"), ("verb", "named_with_verb"), ("markers", "markers"), ("words", "words"))])
    return g.withColumn("share", F.coalesce(F.try_divide(F.col("named_with_verb"), F.col("named_with_verb") + F.col("markers")), F.lit(0.0)))


def introducers(docs: DataFrame, k: int = 40) -> DataFrame:
    """``(introducer, n)``: what most often leads into a citation, over citing sentences."""
    s = sentences(docs).filter("markers > 0")
    x = s.select(F.explode(F.regexp_extract_all("sent", F.lit(INTRODUCER), F.lit(1))).alias("i"))
    return x.groupBy(F.lower("i").alias("introducer")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "introducer").limit(k)


def citing_examples(docs: DataFrame, k: int = 40, seed: int = 7) -> DataFrame:
    """``(doc_id, pos, sent)``: a sample, by hash, of citing sentences of 8 to 38 words with at most two markers."""
    s = sentences(docs).filter("markers BETWEEN 1 AND 2 AND n_words BETWEEN 8 AND 38")
    return s.select("doc_id", F.col("pos").cast("bigint").alias("pos"), tx.strip(F.col("sent")).alias("sent")).orderBy(F.xxhash64("doc_id", "pos", F.lit(seed)), "doc_id", "pos").limit(k)
