"""Hand-made cases for the measures, cleaning, statistics and preparation."""

import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstat.functions import numbers as nu
from inkstat.functions import text as tx
from inkstat.operators import blocks as bl
from inkstat.operators import citations as ci
from inkstat.operators import ngrams as ng
from inkstat.operators import payloads as pa
from inkstat.operators import preparation as pr
from inkstat.operators import scoring as sc
from inkstat.operators import statistics as st
from inkstat.operators import windows as wi
from inkstat.sources import articles as ar
from inkstat.sources import files as fi


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"]


def docs(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("As in Fig. 2 we see it. Then it went away.", 2), ("Smith et al. Found the thing here.", 1), ("J. Smith said the words here.", 1),
        ("He said it and no. It was late then.", 1), ("One two. Three four five.", 1), ("", 0),
    ],
)
def test_sentences(spark, text, n):
    assert len(one(spark, tx.sentences(F.col("t")), t=text)) == n


def test_length_stats(spark):
    d = spark.createDataFrame([([],), ([5],), ([1, 2, 4, 8],)], "x array<int>")
    s = nu.length_stats(F.col("x"), F.array_sort("x"), "l")
    empty, single, many = d.select(*[v.alias(k) for k, v in s.items()]).collect()
    assert set(empty) == {0.0}
    assert (single["l_sd"], single["l_burstiness"], single["l_p50"]) == (0.0, -1.0, 5.0)
    assert [round(many[f"l_{k}"], 6) for k in ("p10", "p50", "p90", "iqr", "neighbour_delta")] == [1.3, 3.0, 6.8, 3.25, round(7 / 3, 6)]


def test_percentile_definitions(spark):
    a = F.array(*map(F.lit, (1, 2, 3, 4)))
    r = spark.range(1).select(nu.linear(a, 0.5), nu.lower_rank(a, 0.5), nu.upper_middle(a)).first()
    assert tuple(r) == (2.5, 2, 3)


def test_paragraphs_undefined_is_not_zero(spark):
    b = bl.block(docs(spark, "One block of words here.", "First block of words.\n\nSecond block of words."), "surface").orderBy("doc_id").collect()
    assert b[0]["para_words_mean"] is None and b[0]["has_paragraph_breaks"] == 0.0
    assert b[1]["para_words_mean"] == 4.0 and b[1]["has_paragraph_breaks"] == 1.0


def test_phrases_used_not_quoted(spark):
    b = bl.block(docs(spark, 'In conclusion it is pivotal. They say "in conclusion" often.'), "tells").first()
    assert b["tell_distinct_count"] == 2.0
    n = 8
    assert b["tell_in_conclusion"] == pytest.approx(1000 / n)
    assert b["tell_total_rate"] == pytest.approx(2000 / n)


def test_quoted_contractions_blank_the_text_between(spark):
    assert one(spark, tx.drop_quoted(F.col("t")), t="we don't say however and can't") == "we don t"


def test_specificity(spark):
    b = bl.block(docs(spark, "4.2 mmol at 298 K, COF2 5 % here"), "specificity").first()
    n = 9
    assert b["numeric_token_rate"] == pytest.approx(4000 / n)
    assert b["quantity_rate"] == pytest.approx(1000 / n)  # 298 K; mmol is no unit, and % wants a letter behind it
    assert b["acronym_rate"] == pytest.approx(1000 / n)
    assert bl.block(docs(spark, " \n "), "specificity").first()["numeric_token_rate"] is None


def plain_mtld(words):
    """By looking at every prefix anew."""

    def share(part):
        return len(set(part)) / len(part)

    def one_way(rest):
        whole, runs = len(rest), 0.0
        while rest:
            k = next((k for k in range(1, len(rest) + 1) if share(rest[:k]) <= 0.72), None)
            if k is None:
                runs += (1 - share(rest)) / 0.28
                break
            runs, rest = runs + 1, rest[k:]
        return whole / runs if runs else float(whole)

    return (one_way(words) + one_way(words[::-1])) / 2


def test_mtld():
    assert nu.mtld_of(["a"] * 49) == 0.0
    distinct = [f"w{i}" for i in range(60)]
    assert nu.mtld_of(distinct) == 60.0
    mixed = [f"w{i * i % 17}" for i in range(200)]
    assert nu.mtld_of(mixed) == pytest.approx(plain_mtld(mixed))


@pytest.mark.parametrize(("n", "windows"), [(0, 0), (5, 1), (8, 1), (9, 2), (12, 5)])
def test_window_counts(spark, n, windows):
    text = " ".join(f"Word number {chr(97 + i)} is here." for i in range(n)) or "x"
    assert wi.window_metrics(docs(spark, text)).count() == windows


def test_uniform_runs(spark):
    short, long_ = "We saw it all.", "We saw it all and then we went on and on to see what was there and more."
    d = docs(spark, " ".join([short] * 10), " ".join([short, long_] * 6))
    r = {x["doc_id"]: x for x in wi.uniform_runs(d).collect()}
    assert (r[0]["n_windows"], r[0]["longest_uniform_run"], r[0]["longest_uniform_run_frac"]) == (3, 3, 1.0)
    assert r[1]["longest_uniform_run"] == 0


def test_clean(spark):
    t = "See https://x.y/z and [1, 2] here (Smith et al., 2019) , in Fig. 3a ( ; ) [,  ] end .\n\n\n\nNext"
    assert one(spark, tx.clean(F.col("t")), t=t) == "See and here, in end.\n\nNext"
    assert one(spark, tx.clean(F.col("t"), keep_citations=True), t="as [3] says") == "as [3] says"
    assert one(spark, tx.clean_title(F.col("t")), t="A “title” here\n now *†") == 'A "title" here now'


def test_markdown(spark):
    t = "# Head\n\n```\ncode\n```\n* **bold** [link](u)\n1. two $x$\n| a | b |\n"
    assert one(spark, tx.strip_markdown(F.col("t")), t=t) == "bold link\ntwo"


def test_pdf(spark):
    t = "Journal of Things 3\nA proper line of argued prose that is long eno-\nugh to stay here.\nFigure 2 shows something very long indeed.\nx = ∑ ∂ρ/∂r ± α² = β ≤ γ ∞ √\n\nREFERENCES\ngone with everything that follows it"
    assert one(spark, tx.clean_pdf(F.col("t")), t=t) == "A proper line of argued prose that is long enough to stay here."


def test_boilerplate_heading(spark):
    d = spark.createDataFrame([("2. Funding:",), ("Results",), (" ORCID ",)], "h string").select(tx.boilerplate_heading(F.col("h")).alias("b"))
    assert [r["b"] for r in d.collect()] == [True, False, True]


def long_table(spark, rows):
    return spark.createDataFrame(rows, "doc_id string, label string, source string, feature string, value double")


def test_statistics(spark):
    rows = [(f"h{i}", "human", "a", "f", float(i)) for i in range(10)] + [(f"m{i}", "ai", "a", "f", float(i + 10)) for i in range(10)]
    rows += [(f"h{i}", "human", "a", "c", 1.0) for i in range(10)] + [(f"m{i}", "ai", "a", "c", 1.0) for i in range(10)]
    t = long_table(spark, rows)
    d = {r["feature"]: r["cohens_d"] for r in st.cohens_d(t).collect()}
    assert d["c"] == 0.0 and d["f"] == pytest.approx(10 / math.sqrt(9.166666666666666))
    auc = {r["feature"]: r["auc_raw"] for r in st.roc_auc(t).collect()}
    assert auc == {"f": 1.0, "c": 0.5}
    s = {r["feature"]: r for r in st.separation(t).collect()}
    assert s["f"]["p_raw"] < 0.001 and s["c"]["p_raw"] == 1.0
    assert st.varying(t).select("feature").distinct().count() == 1


def test_benjamini_hochberg(spark):
    p = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03)], "feature string, p_raw double")
    assert {r["feature"]: round(r["p_adj"], 6) for r in st.benjamini_hochberg(p).collect()} == {"a": 0.03, "b": 0.04, "c": 0.04}


def test_paired(spark):
    d = spark.createDataFrame([("h1", "human", None), ("h2", "human", None), ("a1", "ai", "h1"), ("x", None, None)], "doc_id string, label string, mirrors string")
    assert sorted(r["doc_id"] for r in st.paired(d).collect()) == ["a1", "h1", "x"]
    none = d.withColumn("mirrors", F.lit(None).cast("string"))
    assert st.paired(none).count() == 4


def test_group_of_feature(spark):
    d = spark.createDataFrame([("sent_len_cv", "surface"), ("fw_the", "function"), ("lm_ppl", "lm"), ("nothing", "other"), ("w_ttr_mean", "window")], "f string, g string")
    assert all(r["g"] == r["x"] for r in d.select("g", bl.feature_group(F.col("f")).alias("x")).collect())


def test_ngrams(spark):
    d = docs(spark, *["in order to see in order to go"] * 2)
    t = {r["gram"]: r["n"] for r in ng.counts(d, 3, 4).collect()}
    assert t == {"in order to": 4}
    draft = docs(spark, "in order to be", "nothing at all")
    assert {r["doc_id"] for r in ng.missing_formulas(draft, d).collect()} == {1}
    cov = {r["doc_id"]: r["coverage"] for r in ng.formula_coverage(draft, d).collect()}
    assert cov == {0: 1.0, 1: pytest.approx(59 / 60)}
    assert ng.grams(F.array(F.lit("a")), 3) is not None


def test_length_matched(spark):
    rows = [(f"h{i}", "human", 100 + i) for i in range(40)] + [(f"a{i}", "ai", 120 + i) for i in range(40)]
    d = spark.createDataFrame(rows, "doc_id string, label string, n_words int")
    n = pr.length_matched(d).groupBy("bin").pivot("label", ["human", "ai"]).count().collect()
    assert n and all(r["human"] == r["ai"] for r in n)
    assert pr.length_matched(d.filter("label = 'human'")).count() == 40


def test_strided(spark):
    d = spark.createDataFrame([(i, "x" * (i * 7 % 50)) for i in range(100)], "doc_id int, text string")
    parts = [set(r["doc_id"] for r in pr.strided(d, 3, k, F.length("text")).collect()) for k in range(3)]
    assert sorted(map(len, parts)) == [33, 33, 34] and len(set().union(*parts)) == 100


def test_quota(spark):
    rows = [(i, f"k{i % 2}", f"2020-01-0{1 + i // 10}", True, 1) for i in range(20)] + [(3, "k1", "2020-01-01", True, 1), (30, "k0", "2020-01-01", False, 1)]
    d = spark.createDataFrame(rows, "seq bigint, visitor_key string, d string, upstream_ok boolean, pass_no int").withColumn("ts", F.to_timestamp("d"))
    got = sorted(r["seq"] for r in pr.daily_quota(d, 3, 5).collect())
    assert got == [0, 1, 2, 3, 4, 10, 11, 12, 13, 14]


def test_word_budget(spark):
    d = spark.createDataFrame([(1, "a", 60), (2, "a", 50), (3, "a", 40), (4, "b", 101), (4, "b", 101), (5, None, None)], "seq bigint, visitor_key string, draft_words int")
    got = {r["seq"]: (r["admitted"], r["spent"]) for r in pr.word_budget(d, 100).collect()}
    assert got == {1: (True, 60), 2: (False, 60), 3: (True, 100), 4: (False, 0), 5: (True, 0)}


def test_citations(spark):
    d = docs(spark, "They saw this in all cases [1-3], and then more of it [n]. Then nothing else was seen by them.")
    m = ci.markers(d).orderBy("nth").collect()
    assert [(r["cluster"], r["position"], r["before"]) for r in m] == [(2, "before , ; or )", "all cases"), (0, "sentence-final", "of it")]
    assert ci.density(d).first()["citing_share"] == 0.5


def test_lm_features(spark):
    rows = [("d", 0, -1.0, 1.0), ("d", 1, -3.0, 20.0), ("d", 1, -3.0, 20.0), ("d", 2, float("nan"), None), ("d", 3, -6.0, 2000.0)]
    r = pa.lm_features(spark.createDataFrame(rows, "doc_id string, tok_pos int, logprob double, tok_rank double")).first()
    assert r["lm_n_tokens"] == 3.0 and r["lm_ppl"] == pytest.approx(math.exp(10 / 3)) and r["lm_logprob_neighbour_delta"] == 2.5
    assert r["lm_surprise_frac"] == pytest.approx(1 / 3) and r["lm_rank_beyond1000_frac"] == pytest.approx(1 / 3)


def test_detector_answers(spark):
    rows = [("a", 1, '{"documents": [{"completely_generated_prob": 0.5, "class_probabilities": {"ai": "0.9"}, "sentences": [{"generated_prob": 0.1}, {"generated_prob": 0.9}, {"generated_prob": "x"}]}]}'), ("a", 2, "broken{"), ("b", 1, '{"error": 1}')]
    d = spark.createDataFrame(rows, "doc_id string, attempt int, payload string").withColumn("fetched_at", F.lit(None).cast("timestamp"))
    r = pa.detector_answers(d).collect()
    assert len(r) == 1 and r[0]["completely_generated_prob"] == 0.5 and r[0]["prob_ai"] is None
    assert (r[0]["n_sentences_scored"], r[0]["sent_prob_median"], r[0]["sent_prob_p90"]) == (2, 0.9, 0.1)


def test_syntax(spark):
    rows = [("d", 0, 0, "NOUN", "nsubjpass", 1, False, False), ("d", 0, 1, "VERB", "ROOT", 1, False, False), ("d", 0, 2, "ADV", "advmod", 3, False, False), ("d", 0, 3, "ADJ", "acomp", 1, False, False), ("d", 0, 4, "PUNCT", "punct", 1, True, False)]
    r = pa.syntax_features(spark.createDataFrame(rows, "doc_id string, sent int, tok int, pos string, dep string, head int, is_punct boolean, is_space boolean")).first()
    assert (r["dep_depth_mean"], r["passive_per_clause"], r["noun_rate"], r["noun_verb_ratio"], r["opener_pos_entropy"]) == (2.0, 1.0, 250.0, 1.0, 0.0)


def test_jats():
    xml = (
        '<article><front><article-title>A <b>title</b></article-title></front><body><sec><title>Results</title><p>We saw <xref ref-type="bibr" rid="b7">x</xref> this. <table>no</table>Tail stays.</p></sec>'
        "<sec><title>2. Funding</title><p>gone</p><sec><p>inside stays</p></sec></sec><p>body last</p></body></article>"
    )
    assert ar.article(xml) == ("A title", "We saw  this. Tail stays.\n\ninside stays\n\nbody last")
    assert "[7]" in ar.article(xml, citations=True)[1]
    assert ar.article("<broken") == ("", "") and ar.article(None) == ("", "")


def test_source_helpers(spark):
    assert ar.ids(lambda q, a, n: (7, [str(i) for i in range(a, min(a + n, 7))]), "q", 100, page=3) == [str(i) for i in range(7)]
    x = '<article a="1"><article-id pub-id-type="pmcid">PMC5</article-id></article>'
    got = ar.fetched(spark, spark.createDataFrame([("5",), ("6",)], "id string"), lambda w: "<set>" + x + "</set>", 40).collect()
    assert {r["id"] for r in got} == {"5"}
    lig = one(spark, ar.repair_ligatures(F.col("t"), {"different": 10.0, "the": 9000.0, "thefiber": 1.0}), t="di ﬀerent the ﬁber")
    assert lig == "diﬀerent the ﬁber"


def test_documents_round_trip(spark, tmp_path):
    d = spark.createDataFrame([("a", "human", "pmc", "one two three", "T", 1999, '{"k": [1]}'), ("b", None, None, None, None, None, "no json")], fi.DOCUMENT)
    p = str(tmp_path / "docs")
    fi.write_documents(d, p)
    got = {r["doc_id"]: r for r in fi.read_documents(spark, p).collect()}
    assert got["a"]["meta"] == '{"k":[1]}' and got["b"]["text"] is None and got["b"]["title"] == ""
    (tmp_path / "bad.jsonl").write_text('{"doc_id": "a", "other": 1}\n')
    with pytest.raises(Exception, match="other"):
        fi.read_documents(spark, str(tmp_path / "bad.jsonl")).collect()


def test_phrase_hits(spark):
    h = sc.phrase_hits(docs(spark, "nothing\nthis realm and that realm here")).orderBy("nth").collect()
    assert [(r["line_no"], r["phrase"], r["nth"]) for r in h] == [(2, "realm", 1), (2, "realm", 2)]


def test_z_scores(spark):
    profile = spark.createDataFrame([("f", 2.0, 1.0, 3.0, 5.0), ("n_words", 1.0, 1.0, 1.0, 1.0)], "feature string, sd double, p25 double, p50 double, p75 double")
    draft = spark.createDataFrame([("d", "f", 7.0), ("d", "n_words", 9.0)], "doc_id string, feature string, value double")
    w = spark.createDataFrame([("f", -0.75)], "feature string, cohens_d double")
    r = sc.z_scores(draft, profile, w).collect()
    assert len(r) == 1 and (r[0]["z"], r[0]["priority"]) == (2.0, 2.0)


def test_empty_tables(spark):
    e = spark.createDataFrame([], "doc_id bigint, text string, source string, label string")
    assert bl.features_long(e).count() == 0 and wi.window_tails(e).count() == 0 and ng.reference(e).count() == 0
    t = long_table(spark, [])
    assert st.separation(t).count() == 0 and st.length_balance(t).count() == 0


def test_streams(spark, tmp_path):
    from inkstat.streaming import quota as qu

    rows = [(i, f"k{i % 2}", datetime.datetime(2020, 1, 1 + i // 8), True, 1) for i in range(16)]
    spark.createDataFrame(rows, "seq bigint, visitor_key string, ts timestamp, upstream_ok boolean, pass_no int").write.parquet(str(tmp_path / "r"))
    s = spark.readStream.schema("seq bigint, visitor_key string, ts timestamp, upstream_ok boolean, pass_no int").parquet(str(tmp_path / "r"))
    got = qu.run_once(spark, qu.admitted(s, 3), str(tmp_path / "c1"), str(tmp_path / "t1")).collect()
    assert len(got) == 12
    n = qu.run_once(spark, qu.daily_counts(s, "9 days"), str(tmp_path / "c2"), str(tmp_path / "t2"), "complete")
    assert {r["n"] for r in n.collect()} == {4}
    docs_ = spark.createDataFrame([("a", "h1"), ("b", "h2")], "doc_id string, mirrors string")
    docs_.write.json(str(tmp_path / "in"))
    a = qu.arriving(spark, str(tmp_path / "in"), "doc_id string, mirrors string")
    qu.upsert_shards(a, str(tmp_path / "out"), str(tmp_path / "c3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/state-0")).count() == 2


def test_permutation_null_of_separate_groups(spark):
    from inkstat.operators import models as mo

    rng = random.Random(4)
    rows = []
    for i in range(120):
        label = ("human", "ai")[i % 3 == 0]
        rows += [(f"d{i}", label, k, rng.gauss((i % 3 == 0) * s, 1.0)) for k, s in (("a", 2.0), ("b", 0.3), ("c", 0.0))]
    long = spark.createDataFrame(rows, "doc_id string, label string, feature string, value double")
    r = mo.permutation_null(long).first()
    assert r["n_perm"] == 20 and r["p_value"] == 1 / 21 and abs(r["null_mean"] - 0.5) < 0.1 and r["null_sd"] > 0
    assert r["observed"] == mo.discriminative(long).first()["auc_mean"]
    # the fits made together are those made one by one, on the same labels and folds
    wide, names = mo.matrix(long)
    d = mo._dealt(wide, names, 1, 3).cache()
    labels = {tuple(np.round(x["x"], 9)): x for x in d.collect()}
    scaled = {x["doc_id"]: [x[k] for k in names] for x in wide.collect()}
    z = np.array(list(scaled.values()))
    z = (z - z.mean(0)) / z.std(0, ddof=1)
    dealt = [(i, "ai" if labels[tuple(np.round(v, 9))]["y"][0] else "human", *scaled[i]) for i, v in zip(scaled, z)]
    dealt = spark.createDataFrame(dealt, ["doc_id", "label", *names])
    assert abs(mo.null_aucs(wide, names, 1, 3)[0] - np.mean(mo.cross_validated(dealt, names, 3, 0))) < 1e-3
    assert mo.permutation_null(long.filter("label = 'ai'")).count() == 0


# ---- places of values, places of citations, what was added since ----


def test_exact_percentiles_of_uneven_groups(spark):
    rng = np.random.default_rng(5)
    sides = {"a": [*rng.normal(size=400).round(2), 1e9], "b": [3.0], "c": [1.0, 1.0, 2.0], None: [5.0, 7.0]}
    d = spark.createDataFrame([(k, float(v)) for k, vs in sides.items() for v in vs] + [("a", None)], "g string, value double")
    got = {r["g"]: r for r in st.percentiles(d, "g", "value", {"lo": 0.1, "mid": 0.5, "hi": 0.95}).collect()}
    for k, vs in sides.items():
        assert [got[k][c] for c in ("lo", "mid", "hi")] == pytest.approx([np.percentile(vs, q) for q in (10, 50, 95)])
    o = {r["g"]: r["x"] for r in st.order_statistics(d, "g", "value", {"x": 0.5}).collect()}
    assert all(o[k] == sorted(vs)[int(0.5 * (len(vs) - 1))] for k, vs in sides.items())
    assert st.percentiles(d.limit(0), "g", "value", {"x": 0.5}).count() == 0


def test_percentile_ranges_hold_where_one_value_is_far_off(spark):
    """An outlier does not draw all other values into one range."""
    d = spark.range(5000).select(F.lit("g").alias("g"), F.when(F.col("id") == 0, 1e12).otherwise(F.rand(3)).alias("v"), F.lit(1).alias("n"))
    r = st.counted_before(d, "g", "v", "n").orderBy("v").select("before").collect()
    assert [x["before"] for x in r] == list(range(5000))


def test_windows_by_hand(spark):
    d = docs(spark, *[" ".join(f"{'A' * (i + 1)} two, {'three ' * (i % 4)}words here." .capitalize() for i in range(n)) for n in (1, 8, 12)], "", "Hm.")
    rows = wi.window_metrics(d).orderBy("doc_id", "win_start").collect()
    assert [(r["doc_id"], r["win_start"], r["n_sentences"]) for r in rows] == [(0, 0, 1), (1, 0, 8), *[(2, i, 8) for i in range(5)]]
    lens = [4 + i % 4 for i in range(12)]
    for r in rows[2:]:
        w = lens[r["win_start"] : r["win_start"] + 8]
        assert r["w_n_words"] == sum(w) and r["w_sent_len_sd"] == pytest.approx(np.std(w, ddof=1)) and r["w_sent_len_range"] == max(w) - min(w)
    t = wi.window_tails(d).filter("doc_id = 2").first()
    assert t["n_windows"] == 5 and t["w_n_words_mean"] == pytest.approx(np.mean([sum(lens[i : i + 8]) for i in range(5)]))
    runs = {r["doc_id"]: (r["n_windows"], r["longest_uniform_run"]) for r in wi.uniform_runs(d).collect()}
    assert runs[2][0] == 5 and len(runs) == 3


@pytest.mark.parametrize("lens", [(20, 15, 14, 6, 21, 21, 9, 15, 20), (16, 16, 19, 22, 13, 19, 9, 28, 16), (9, 14, 3, 3, 17, 17, 13, 10, 9)])
def test_windows_of_the_same_lengths_in_turn_rank_by_their_start(spark, lens):
    d = docs(spark, " ".join("Word" + " word" * (n - 1) + "." for n in lens))
    assert [(r["place"], r["win_start"]) for r in wi.most_uniform(d).orderBy("place").collect()] == [(1, 0), (2, 1)]


def test_preview_has_one_space_after_an_abbreviation(spark):
    d = docs(spark, "The bed of No.\u2002 2 by J.  Smith, see (as in Fig.) 3, was\u2009open. Then it went away.")
    assert wi.most_uniform(d).first()["preview"] == "The bed of No. 2 by J. Smith, see (as in Fig. 3, was\u2009open."


def test_uniform_passages_agree_with_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from inkstat.plans import sequences as sq

    rng = random.Random(5)
    words = ["pore", "was", "here", "Fig.  3", "al.\u2002(a)", "J.  Smith"]
    text = [" ".join("The " + " ".join(rng.choices(words, k=rng.randint(2, 6))) + "." for _ in range(rng.randint(1, 30))) for _ in range(200)]
    docs(spark, *text).write.parquet(str(tmp_path / "documents.parquet"))
    run, sql = sq.QUERIES["uniform_passages"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert sorted(map(tuple, run(spark, str(tmp_path)).collect())) == sorted(con.execute(sql).fetchall())


def test_all_measures_agree_with_their_blocks(spark):
    d = docs(spark, "The cold pore was open. However, we saw 4.2 K of it; perhaps this fell.\n\nThis second block of words may be short.", "Words.", "")
    long = {(r["doc_id"], r["feature"]): r["value"] for r in bl.features_long(d).collect()}
    for name in bl.BLOCKS:
        for r in bl.block(d, name).collect():
            for c, v in r.asDict().items():
                if c != "doc_id":
                    got = long[r["doc_id"], c]
                    assert (got is None and (v is None or v != v)) or got == pytest.approx(v), c
    assert {k for k, _ in long} == {0, 1} and long[0, "fw_the"] > 0 == long[0, "fw_with"]


def test_ligature_vocabulary_and_ratios(spark):
    d = spark.createDataFrame([("a", "one two three", 6), ("b", "one two", 1), ("c", "one", 0), ("d", "w " * 9, 10)], "doc_id string, text string, target_words int")
    r = pr.length_ratios(d).first()
    assert (r["n"], r["p10"], r["median"], r["p90"], r["short"]) == (3, 0.5, 0.9, 2.0, False)
    assert pr.length_ratios(d.limit(0)).count() == 0
    assert [one(spark, pr.draft_register(F.col("x")), x=x) for x in ("letter", "poem")] == ["letter", "paper"]


def test_detectors(spark):
    d = spark.createDataFrame([(1, "a b."), (2, None), (3, ""), (4, "boom")], "doc_id bigint, text string")

    def fails(t):
        if t == "boom":
            raise ValueError
        return float("nan")

    got = {r["doc_id"]: tuple(r)[1:] for r in pa.fan_out(d, {"n": len, "f": fails}).collect()}
    assert got == {1: (4.0, None, None, None), 2: (None,) * 4, 3: (None,) * 4, 4: (4.0, None, None, 1.0)}
    v = spark.createDataFrame([("a", 1), ("b", 2)], "word string, id bigint")
    w = spark.createDataFrame([("a", 1), ("b", 3), ("c", 4)], "word string, id bigint")
    assert tuple(pa.same_vocabulary(v, v).first()) == (True, 0, 0) and tuple(pa.same_vocabulary(v, w).first()) == (False, 1, 2)
    t = spark.createDataFrame([("a", -1.0, -2.0, 4.0, 2.0), ("a", -3.0, -2.0, 5.0, 2.0)], "doc_id string, logprob double, mu double, var double, cross_entropy double")
    assert pa.curvature(t).first()["det_curvature"] == 0.0 and pa.cross_ratio(t).first()["det_ratio"] == 1.0


def test_how_authors_are_cited(spark):
    t = ["Smith et al. [3] reported that pores were open here. As shown by Li and coworkers it fell [4]. It has been shown often [5, 6].", None, ""]
    d = docs(spark, *t)
    r = ci.named_with_verb(d).first()
    assert (r["named"], r["named_with_verb"], r["markers"]) == (2, 1, 3) and r["share"] == 0.25
    got = {r["introducer"]: r["n"] for r in ci.introducers(d).collect()}
    assert got["as shown by"] == 1 and got["has been shown"] == 1 and got["often"] == 1
    assert [tuple(r) for r in ci.top_after(d).collect()] == [("reported", 1)]
    assert ci.citing_examples(d).count() == 2 and ci.introducers(d.limit(0)).count() == 0


def test_books_queries_and_urls(spark):
    b = spark.createDataFrame([(7, "T" * 300, "*** START OF THE PROJECT GUTENBERG EBOOK X ***\n" + "word " * 30), (8, "S", "word"), (9, None, None)], "id int, title string, text string")
    r = ar.books(b, 10, 20).collect()
    assert len(r) == 1 and r[0]["doc_id"] == "gutenberg:7" and len(r[0]["title"]) == 200 and len(r[0]["text"].split()) == 20
    u = spark.createDataFrame([(1, {"text/html": "h", "text/plain; charset=utf-8": "a.txt", "text/plain": "a.zip"}), (2, {"text/html": "h"})], "id int, formats map<string,string>")
    assert [tuple(r) for r in ar.book_urls(u).collect()] == [(1, "a.txt")]
    q = ar.topic_query(["pore", "cold film"], 1990, 2000)
    assert '"pore"[Title/Abstract] OR "cold film"[Title/Abstract]' in q and '("1990"[pdat] : "2000"[pdat])' in q
    pages = {0: ["a", "b"], 2: ["c"]}
    assert ar.ids(lambda q, at, n: (3, pages.get(at, [])), "q", 10) == ["a", "b", "c"]


def test_pdf_folder(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"good")
    (tmp_path / "b.pdf").write_bytes(b"bad")
    got = ar.pdf_texts(spark, str(tmp_path), lambda b: {b"good": "text"}[b]).collect()
    assert [r["text"] for r in got] == ["text"]


def test_samples_and_lengths(spark):
    d = spark.createDataFrame([(f"d{i}", "w " * i, "T*") for i in range(10)], "doc_id string, text string, title string")
    assert {r["doc_id"] for r in pr.sampled(d, 4).collect()} == {r["doc_id"] for r in pr.sampled(d.repartition(3), 4).collect()}
    assert {(r["doc_id"], r["title"]) for r in pr.usable_titles(d, 8).collect()} == {("d8", "T"), ("d9", "T")}
    x = spark.createDataFrame([("a", "mtld", 1.0), ("a", "hedge_rate", 1.0), ("b", "mtld", 1.0)], "doc_id string, feature string, z double")
    n = spark.createDataFrame([("a", 100.0), ("b", 900.0)], "doc_id string, n_words double")
    assert {(r["doc_id"], r["feature"]) for r in sc.length_gap(x, n, 1000.0).collect()} == {("a", "hedge_rate"), ("b", "mtld")}
