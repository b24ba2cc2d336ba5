"""Queries that go through sources, sinks and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from inkstat.functions import lexicons as lx
from inkstat.functions import text as tx
from inkstat.operators import statistics as st
from inkstat.plans import comparison as co
from inkstat.plans import sql as s
from inkstat.plans.documents import _rounded
from inkstat.runtime import shared_dir, table
from inkstat.sources import articles as ar
from inkstat.sources import files as fi
from inkstat.streaming import quota as qu


def _path(spark, kind):
    return f"{shared_dir(spark)}/inkstat/{kind}-{uuid.uuid4().hex}"


def _corpus(spark, d):
    return table(spark, d, "corpus").dropDuplicates(["doc_id"])


def jsonl_round_trip(spark, d):
    """The corpus written as JSON lines and read again with a floor of words."""
    p = _path(spark, "jsonl")
    fi.write_documents(_corpus(spark, d), p)
    return fi.read_documents(spark, p, 200).select("doc_id", "label", F.length("text").cast("bigint").alias("n_chars"), F.coalesce(F.col("year").cast("string"), F.lit("none")).alias("year"))


_JSONL = f"SELECT DISTINCT doc_id, label, length(text)::BIGINT AS n_chars, coalesce(year::INT::VARCHAR, 'none') AS year FROM corpus WHERE len({s.WORDS}) >= 200"


def csv_round_trip(spark, d):
    p = _path(spark, "csv")
    fi.write_table(_rounded(st.cohens_d(co.labelled(spark, d))), p, "csv")
    return fi.read_table(spark, p, "feature string, n_human bigint, n_ai bigint, human_mean double, ai_mean double, cohens_d double", "csv")


def profile_round_trip(spark, d):
    """A profile written as JSON and read again."""
    long = co.labelled(spark, d)
    n = long.filter("feature = 'n_words' AND label = 'human'").select("doc_id", "source", F.col("value").alias("n_words"))
    p = _path(spark, "profile")
    fi.profile_json(_rounded(st.profile(long)), n, _rounded(st.cohens_d(long))).write.text(p)
    return fi.read_profile(spark, p)


def policy_markdown(spark, d):
    return fi.policy_markdown(st.policy_rules(st.separation(co.labelled(spark, d)), 0.0), lx.GLOSS)


def feature_gloss(spark, d):
    """Readable names of the features, their own where there is none."""
    x = co.labelled(spark, d).select("feature").distinct()
    g = spark.createDataFrame(list(lx.GLOSS.items()), "feature string, gloss string")
    return x.join(F.broadcast(g), "feature", "left").select("feature", F.coalesce("gloss", "feature").alias("gloss"))


_GLOSS = f"""WITH {co._LONG}, g AS (SELECT unnest([{', '.join(map(s.q, lx.GLOSS))}]) AS feature, unnest([{', '.join(map(s.q, lx.GLOSS.values()))}]) AS gloss)
SELECT feature, coalesce(gloss, feature) AS gloss FROM (SELECT DISTINCT feature FROM f) LEFT JOIN g USING (feature)"""


def feature_table(spark, d):
    """The wide table of features of the corpus."""
    long = co.labelled(spark, d)
    names = sorted(r[0] for r in long.select("feature").distinct().collect())  # one row a measure
    return _rounded(fi.wide(long, names))


def _xml(spark, d):
    """Articles made from the documents: several to an answer."""
    esc = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    t = table(spark, d, "documents").filter(F.length("text") > 0)
    one = F.concat(
        F.lit('<article><front><article-id pub-id-type="pmcid">PMC'), F.col("doc_id").cast("string"), F.lit("</article-id><article-title>"), esc(F.coalesce("title", F.lit("x"))),
        F.lit(' *</article-title><pub-date pub-type="epub"><year>'), F.coalesce(F.col("year").cast("string"), F.lit("n")), F.lit('</year></pub-date></front><body><sec><title>Results</title><p>'), esc(F.col("text")),
        F.lit(' as <xref ref-type="bibr" rid="b12">12</xref> found.</p></sec><sec><title>1. References</title><p>gone</p><sec><p>kept inside.</p></sec></sec><p>At last.</p></body></article>'),
    )
    return t.select("doc_id", one.alias("xml"))


def jats_articles(spark, d):
    """Title and body of each article."""
    x = _xml(spark, d).select("doc_id", ar.parsed(F.col("xml")).alias("a"))
    return x.select("doc_id", "a.title", F.length("a.body").cast("bigint").alias("n_chars"), F.col("a.body").contains("kept inside.").alias("nested"), F.col("a.body").contains("gone").alias("dropped"))


def jats_cited(spark, d):
    """With citations kept as markers."""
    x = _xml(spark, d).select("doc_id", ar.parsed(F.col("xml"), True).alias("a"))
    return x.select("doc_id", tx.count(F.col("a.body"), r"\[12\]").cast("bigint").alias("markers"))


_CITED = "SELECT doc_id, 1 + len(regexp_extract_all(text, '[[]12[]]')) AS markers FROM documents WHERE length(text) > 0"


def article_split(spark, d):
    """Answers of two articles each, split again; the year of each."""
    x = _xml(spark, d).select(F.explode(ar.split_articles(F.concat(F.lit("<set>"), "xml", "xml", F.lit("</set>")))).alias("xml"))
    return x.groupBy(F.coalesce(ar.year(F.col("xml")).cast("string"), F.lit("none")).alias("year")).agg(F.count("*").alias("n"))


_SPLIT = "SELECT coalesce(year::INT::VARCHAR, 'none') AS year, 2 * count(*) AS n FROM documents WHERE length(text) > 0 GROUP BY 1"


def licence_strip(spark, d):
    """Texts put between licence marks, and taken out again."""
    t = table(spark, d, "documents").filter(F.length("text") > 0)
    m = F.concat(F.lit("Front\n*** START OF THE PROJECT GUTENBERG EBOOK X ***\n"), "text", F.lit("\n*** END OF THE PROJECT GUTENBERG EBOOK X ***\nBack"))
    return t.select("doc_id", F.md5(F.encode(ar.strip_licence(m), "utf-8")).alias("digest"))


_LICENCE = f"SELECT doc_id, md5({s.strip('text')}) AS digest FROM documents WHERE length(text) > 0"


def answer_rows(spark, d):
    """Question rows made from the corpus, exploded, with a floor and a cap."""
    t = _corpus(spark, d).filter("lower(trim(source)) = 'hc3' AND text IS NOT NULL")
    r = t.withColumn("row", F.split_part("doc_id", F.lit(":"), F.lit(3)).cast("int")).groupBy("row").agg(
        F.lit("x").alias("source"), F.array_sort(F.collect_list(F.when(F.col("doc_id").contains(":h:"), F.col("text")))).alias("human_answers"),
        F.array_sort(F.collect_list(F.when(F.col("doc_id").contains(":a:"), F.col("text")))).alias("chatgpt_answers"),
    )
    return ar.answers(r, 20, 50).groupBy("label").agg(F.count("*").alias("n"))


_ANSWERS = f"""SELECT label, least(count(*), 20) AS n FROM (SELECT DISTINCT ON (doc_id) CASE WHEN contains(doc_id, ':h:') THEN 'human' ELSE 'ai' END AS label
  FROM corpus WHERE lower(trim(source)) = 'hc3' AND len({s.WORDS}) >= 50) GROUP BY label"""


def generation_rows(spark, d):
    t = _corpus(spark, d).filter("lower(trim(source)) = 'raid' AND text IS NOT NULL")
    m = F.try_parse_json("meta")
    r = t.select(F.col("doc_id").alias("id"), F.try_variant_get(m, "$.domain", "string").alias("domain"), F.lit(None).cast("string").alias("attack"), F.coalesce(F.try_variant_get(m, "$.model", "string"), F.lit("human")).alias("model"), F.col("text").alias("generation"))
    return ar.generations(r, "abstracts", 10).select("doc_id", "label")


_GENERATIONS = """WITH t AS (SELECT DISTINCT ON (doc_id) 'raid:' || doc_id AS doc_id, CASE WHEN json_valid(meta) THEN meta->>'$.domain' END AS domain, CASE WHEN json_valid(meta) THEN meta->>'$.model' END AS model
  FROM corpus WHERE lower(trim(source)) = 'raid' AND text IS NOT NULL)
SELECT doc_id, label FROM (SELECT doc_id, CASE WHEN coalesce(model, 'human') = 'human' THEN 'human' ELSE 'ai' END AS label FROM t WHERE domain = 'abstracts') QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id) <= 10"""


def ligature_repair(spark, d):
    """Torn ligatures in the corpus, joined by the vocabulary of at most some thousand words."""
    v = table(spark, d, "vocabulary").select("word", "n").dropna().limit(1_000_001).collect()  # a larger one is refused
    total = sum(r["n"] for r in v)
    rates = {r["word"]: 1e6 * r["n"] / total for r in v}
    t = _corpus(spark, d).filter("text IS NOT NULL")
    torn = F.replace("text", F.lit("fit"), F.lit(" ﬁt"))
    return t.select("doc_id", F.length(ar.repair_ligatures(torn, rates)).cast("bigint").alias("n_chars"))


_REQUEST = "seq bigint, visitor_key string, ts timestamp, received_at timestamp, upstream_ok boolean, pass_no int, draft_words int"


def quota_stream(spark, d):
    """Requests of each key and day, counted by a stream with a watermark; read back as a batch."""
    r = spark.readStream.schema(_REQUEST).parquet(d, pathGlobFilter="quota_requests.parquet", recursiveFileLookup=True)
    out = qu.run_once(spark, qu.daily_counts(r, "40 days"), _path(spark, "checkpoint"), _path(spark, "quota"), "complete")
    return out.select(F.col("day").cast("string").alias("day"), "visitor_key", "n")


_QSTREAM = """SELECT ts::DATE::VARCHAR AS day, coalesce(visitor_key, 'unknown') AS visitor_key, count(*) AS n FROM (SELECT DISTINCT seq, ts, visitor_key FROM quota_requests WHERE upstream_ok AND coalesce(pass_no, 1) = 1) GROUP BY ALL"""


QUERIES = {
    "jsonl_round_trip": (jsonl_round_trip, _JSONL), "csv_round_trip": (csv_round_trip, co._COHEN), "profile_round_trip": (profile_round_trip, co._BANDS), "policy_markdown": (policy_markdown, None),
    "feature_gloss": (feature_gloss, _GLOSS), "feature_table": (feature_table, None), "jats_articles": (jats_articles, None), "jats_cited": (jats_cited, _CITED), "article_split": (article_split, _SPLIT), "licence_strip": (licence_strip, _LICENCE),
    "answer_rows": (answer_rows, _ANSWERS), "generation_rows": (generation_rows, _GENERATIONS), "ligature_repair": (ligature_repair, None), "quota_stream": (quota_stream, _QSTREAM),
}
