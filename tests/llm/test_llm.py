"""The nine problems: brute force on small tables, hand-made cases, and what may come in any column."""

import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from inkstat.llm import leaks, mixture, pages, quality, repetition, scans, sentences, skeletons, spans, truncation
from inkstat.llm.arrays import code_points, gram_hashes, sliding_min
from inkstat.llm.chars import consistent, skeleton
from inkstat.llm.forest import IsolationForest
from inkstat.llm.lines import kind
from inkstat.llm.words import words

DOC = "doc_id string, label string, source string, text string, title string, year int, meta string"
WORDS = "the rigid pore of sample held about seven litres while each cold lattice drifted slowly under argon and no valve was open".split()


def prose(rng, n=60):
    out = []
    for i in range(n):
        out.append(rng.choice(WORDS) + ("." if i % 12 == 11 else ""))
    return " ".join(out).capitalize()


def corpus(spark, rows, extra=True):
    full = [(i, None, s, t, ti, None, m) for i, s, t, ti, m in rows]
    d = spark.createDataFrame(full, DOC)
    # names that clash with those the operators make
    return d.withColumns({"h": F.lit("x"), "at": F.lit(1), "skeleton": F.lit("y"), "n": F.lit(2), "field": F.lit("z"), "score": F.lit(0)}) if extra else d


def odd(spark):
    """Nulls in every column, empty texts, whole rows twice."""
    rows = [(None, None, None, None, None), ("a", None, None, None, None), ("b", "pmc", "", "", ""), ("c", None, " \n\n ", None, "{"), ("d", "group", "x", "t", "{}"), ("d", "group", "x", "t", "{}")]
    return corpus(spark, rows)


def documents(spark, texts):
    d = spark.createDataFrame([(i, t, "Pmc" if t else None) for i, t in enumerate(texts)], "doc_id bigint, text string, source string")
    return d.withColumns({"rep": F.lit(5), "h": F.lit(6), "t": F.lit("t"), "u": F.lit("u"), "sig": F.lit(0)})


# ---- 1 ----


def plain_share(ws, n=8):
    cover = [False] * len(ws)
    for i in range(len(ws) - n + 1):
        if any(ws[j : j + n] == ws[i : i + n] for j in range(i)):
            cover[i : i + n] = [True] * n
    return sum(cover) / len(ws) if ws else 0.0


@settings(max_examples=60, deadline=None)
@given(some.lists(some.integers(0, 2), max_size=60))
def test_repeated_words_by_brute_force(xs):
    ids = np.array(xs, np.int64)
    for n in (3, 5, 8):
        got = repetition.repeated(ids, n)
        assert (float(got.mean()) if len(xs) else 0.0) == pytest.approx(plain_share(xs, n))


def test_repetition(spark):
    rng = random.Random(1)
    rows = [(f"d{i}", "pmc", prose(rng), "", None) for i in range(60)]
    loop = "Each cold lattice drifted slowly under argon and no valve was open. "
    rows += [(f"r{i}", "raid", prose(rng, 20) + " " + loop.upper() * 2 + loop * (4 + i), "", None) for i in range(6)] + [rows[0]]
    d = corpus(spark, rows)
    assert sorted(r["doc_id"] for r in repetition.repeating(d).collect()) == [f"r{i}" for i in range(6)]
    s = {r["source"]: r for r in repetition.by_source(d).collect()}
    assert s["pmc"]["documents"] == 60 and s["raid"]["repeating"] == 6
    assert repetition.scored(odd(spark)).count() == 4 and repetition.repeating(odd(spark)).count() == 0
    assert repetition.repeating(corpus(spark, [])).count() == 0
    long = repetition.statistics(["word " * 200_000, None, "", "one two."])
    assert long[0, 0] > 0.99 and repetition.repeated_share("word " * 200_000) > 0.99 and not long[1:3].any() and long[3, -1] == 2
    assert repetition.repeated_share(None) == repetition.repeated_share(" . ") == 0.0


def plain_statistics(text):
    ws = words(text)
    n, grams = len(ws), lambda k: [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]
    dup = lambda xs: [x in xs[:i] for i, x in enumerate(xs)]
    def cover(k):
        hit = {j for i, x in enumerate(dup(grams(k))) if x for j in range(i, i + k)}
        return len(hit) / n
    def parts(pattern):
        ps = [tuple(words(p)) for p in re.split(pattern, text)]
        ps = [p for p in ps if p]
        return sum(sum(map(len, p)) for p, x in zip(ps, dup(ps)) if x) / sum(map(len, ws))
    mean = lambda xs: sum(xs) / max(1, len(xs))
    return [cover(6), mean(dup(grams(6))), cover(12), mean(dup(grams(12))), mean(dup(grams(16))), parts(r"[.!?]+|\n\s*\n"), parts(r"\n"), parts(r"\n\s*\n")]


def test_batch_statistics_by_brute_force():
    rng = random.Random(5)
    texts = [None]
    for _ in range(40):
        texts.append(rng.choice(["", "a "]) + rng.choice([" ", ". ", "\n", "\n\n"]).join("".join(rng.choice(["x y ", "x ", "y z ", "z. "]) for _ in range(rng.randint(1, 30))).strip() for _ in range(rng.randint(1, 6))))
    got = repetition.statistics(texts)
    for t, g in zip(texts[1:], got[1:]):
        assert g[:8].tolist() == pytest.approx(plain_statistics(t)), t


def test_detector_keeps_its_order_where_a_third_repeats():
    rng = np.random.default_rng(3)
    share = np.where(rng.random(900) < 0.33, rng.uniform(0.4, 1, 900), rng.uniform(0, 0.2, 900) ** 2)
    x = np.clip(share[:, None] + rng.normal(0, 0.02, (900, 6)), 0, 1)
    m = repetition.Detector(x, share)
    true, both, chosen = m.held_out
    assert both >= 0.99 * true and chosen <= 2.5 * true
    assert repetition.Detector(x[share < 0.3], share[share < 0.3]).held_out[1:] == (0, 0)


def test_forest_sets_outliers_apart():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(0, 1, (500, 3)), [[9, 9, 9]]])
    s = IsolationForest().fit(x).score(x)
    assert s.argmax() == 500 and (s <= 1).all() and (s >= 0).all()
    assert len(IsolationForest().fit(np.zeros((0, 2))).score(np.zeros((3, 2)))) == 3


# ---- 2 ----


def test_skeletons(spark):
    pairs = [("naïve co-op", "naïve co‐op"), ("Sofa fit", "Ѕоfа ﬁt"), ("ab 12", "ａb ​１２"), ("й ё", "й ё"), ("a\nb", "a \r\nb"), ("K", "K")]
    for a, b in pairs:
        assert skeleton(a) == skeleton(b), (a, b)
    for a, b in [("cm3", "cm³"), ("a-b", "a–b"), ("A", "a"), ("10", "1O"), ("a b", "a  b"), ("a\nb", "a b"), ("x", "x*"), ("l", "1")]:
        assert skeleton(a) != skeleton(b), (a, b)
    assert consistent("Ѕоfа ﬁt​ и мoрe") == "Sofa fit и море" and consistent(None) is None
    rows = [("a", "s", "naïve", "t", None), ("b", "s", "naïve", "t", None), ("c", "s", "naïve", "t", None), ("d", "s", "naïve", None, None), ("e", "s", "Naïve", "t", None), ("a", "s", "naïve", "t", None)]
    d = corpus(spark, rows)
    assert sorted(map(tuple, skeletons.same_reading_pairs(d).collect())) == [("a", "b"), ("b", "c")]
    assert {r["doc_id"]: r["class_id"] for r in skeletons.classes(d).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e"}
    assert skeletons.same_reading_pairs(odd(spark)).count() == 0 and skeletons.same_reading_pairs(corpus(spark, [])).count() == 0
    assert skeletons.consistent_forms(odd(spark)).count() == 5


@settings(max_examples=80, deadline=None)
@given(some.text(max_size=40))
def test_skeleton_of_a_skeleton(t):
    assert skeleton(skeleton(t)) == skeleton(t)


# ---- 3 ----


@pytest.mark.parametrize(
    ("text", "meta", "cut"),
    [
        ("It was cold. It was late.", None, False), ("It was cold. It was la", None, True), ("It was cold. He said \"it was late.", None, True), ("It was cold. Ask Prof.", None, True),
        ("It was cold. It wa�", None, True), ("It was cold.", '{"chars": 40}', True), ("It was cold.", '{"chars": 12}', False), ("It was cold.\n\nKeywords: pore, film, gas", None, False),
        ("It was cold.\n\nJ. Norlemark", None, False), ("* one\n* two\n* three", None, False), ("a | b |\nc | d | e", None, False), ("It was cold (see Sect. 2", None, True), ("粉末と膜は変わらなかった。湿度は部分的に湿度を", None, True),
        ("ผลึกจำกัดตัวอย่างเสมอ สำหรับ", None, False), ("It was cold [12].", None, False), ("It was cold. [12]", None, False),
    ],
)
def test_cut_texts(spark, text, meta, cut):
    x = truncation.inspect(text, meta)
    names = [c.split()[0] for c in truncation._SCHEMA.split(",")][2:]
    r = dict(zip(names, x))
    assert bool(r["short"] or r["ended"]) == cut


@pytest.mark.parametrize(
    ("text", "stack", "head"),
    [
        ("a (b [c", ["(", "["], "text"), ("a (b [c) d", [], "text"), ("(a\n\nb", [], "text"), ("<i>a (b", ["<i", "("], "text"), ("<i>a\n\nb", ["<i"], "text"), ("<i>a</i> <br> <p>b", [], "text"),
        ('a <span class="x', [], "markup"), ("a <!-- b", ["<!--"], "text"), ("a <!-- b --> c", [], "text"), ("a &am", [], "escape"), ("a &amp;", [], "text"), ("a \\u00", [], "escape"), ("a \\u00e4", [], "text"),
        ("a\\", [], "escape"), ("a%2", [], "escape"), ("a \ufffd", [], "bytes"), ("a \ufffd b", [], "text"), ("„a“ «b", ["«"], "text"), (") a", [], "text"), ("<a/>b", [], "text"), ("</b> c < d", [], "text"),
    ],
)
def test_automaton(text, stack, head):
    assert truncation.end_states(text) == (stack, head)


def test_automaton_reads_long_texts_once():
    for t in ("<!--" * 50_000, "<a " * 50_000, '("' * 50_000, "&" * 100_000):
        truncation.end_states(t)


@settings(max_examples=200, deadline=None)
@given(some.text(alphabet="ab ()[]«»\"<i>/&;\\u0%.\n", max_size=60))
def test_automaton_by_steps(t):
    """Brackets alone, by a plain stack, where no tag, quote or blank line is in the way."""
    t = re.sub(r'[<>"&\\%/\n«»]', "", t)
    plain = []
    for c in t:
        if c in "([":
            plain.append(c)
        elif c in ")]" and "([" [")]".index(c)] in plain:
            while plain.pop() != "([" [")]".index(c)]:
                pass
    assert truncation.end_states(t) == (plain, "text")


def test_a_state_most_texts_of_a_source_end_in_shows_nothing(spark):
    rows = [(f"m{i}", "raid", "<i>It was cold. It was late.", "", None) for i in range(5)] + [("n", "raid", "It was cold and la", "", None)]
    rows += [(f"o{i}", "pmc", "It was cold. It was late.", "", None) for i in range(5)] + [("p", "pmc", "It was <i>cold.", "", None)]
    d = corpus(spark, rows)
    assert sorted(map(tuple, truncation.cut_fields(d).collect())) == [("n", "text"), ("p", "text")]
    got = {(r["source"], r["state"]): (r["texts"], r["shown"], r["alone"]) for r in truncation.by_state(d).collect()}
    assert got == {("raid", "markup"): (5, 0, 0), ("raid", "sentence"): (1, 1, 1), ("pmc", "markup"): (1, 1, 1)}
    assert truncation.by_state(corpus(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(some.recursive(some.none() | some.booleans() | some.integers() | some.text(max_size=6), lambda c: some.lists(c, max_size=3) | some.dictionaries(some.text(max_size=4), c, max_size=3), max_leaves=8), some.data())
def test_cut_json(value, data):
    import json

    s = json.dumps({"k": value})
    assert not truncation.structure_open(s)
    n = data.draw(some.integers(1, len(s) - 1))
    assert truncation.structure_open(s[:n])


def test_truncation(spark):
    rng = random.Random(2)
    rows = [(f"a{i}", "raid", prose(rng, 36 + i % 24 // 12 * 12), "", '{"k": 1}') for i in range(40)]
    rows += [(f"x{i}", "raid", (prose(rng, 200))[:100], "", '{"k": ') for i in range(6)]
    rows = [(i, s, t if t.endswith(".") or i[0] == "x" else t + ".", ti, m) for i, s, t, ti, m in rows] + [rows[0]]
    got = sorted(map(tuple, truncation.cut_fields(corpus(spark, rows)).collect()))
    assert got == sorted([(f"x{i}", f) for i in range(6) for f in ("meta", "text")])
    r = truncation.by_source(corpus(spark, rows)).first()
    assert (r["documents"], r["text_cut"], r["meta_cut"]) == (46, 6, 6)
    # the only text of its source has no stop: the source's baseline says nothing is missing
    assert sorted(map(tuple, truncation.cut_fields(odd(spark)).collect())) == [("c", "meta")]
    assert truncation.cut_fields(corpus(spark, [])).count() == 0
    assert not truncation.structure_open("{'a': 1}") and truncation.structure_open("{'a': '")


# ---- 4 ----

PAGE = """    Once the cold lattice drifted slowly un-
der argon, no va1ve was open while the rigid
p o r e held about seven litres under argon and
145
A Rigid Pore For Argon
each lattice drifted whiIe no valve was open be-

2.2 The pore of sample G7
cause the sample heId seven litres of argon and
the va1ve was about open."""


def vocabulary(spark):
    return spark.createDataFrame([(w, 1000) for w in {*WORDS, "once", "because", "while", "it"}] + [("der", 4), (None, None)], "word string, n bigint")


def test_scans(spark):
    rng = random.Random(3)
    rows = [(f"p{i}", "pmc", prose(rng), "", None) for i in range(20)] + [("g", "Group", PAGE, "", None), ("g", "Group", PAGE, "", None)]
    d = corpus(spark, rows)
    got = sorted((r["line_no"], r["kind"]) for r in scans.repair_lines(d, vocabulary(spark)).collect())
    assert got == [(0, "hyphen"), (1, "misread"), (2, "misread"), (3, "furniture"), (4, "furniture"), (5, "hyphen"), (5, "misread"), (8, "misread"), (9, "misread")]
    text = {r["doc_id"]: r["text"] for r in scans.repaired_texts(d, vocabulary(spark)).collect()}["g"]
    assert text.startswith("Once the cold lattice drifted slowly under argon, no valve was open while the rigid pore held about seven litres under argon and each lattice")
    assert scans.repair_lines(odd(spark), vocabulary(spark)).count() == 0 and scans.repair_lines(corpus(spark, []), vocabulary(spark)).count() == 0
    assert scans.repaired_texts(odd(spark), vocabulary(spark)).count() == 0


def test_carried_words_as_printed():
    words = {w: 1000 for w in {*WORDS, "once", "because", "while"}}
    m = scans.model_of(list(words.items()), [])
    page = """once the cold lattice drifted slowly under argon and the lat-
tlce held about seven litres of argon while no sam-
145
p1e was open and the rigid pore held about (se-
v3n) litres; each valve was open while the la-
tt1ce drifted slowly under cold argon and the s1ow-
1y drifted sample was open because argon was cold."""
    got = scans.repaired(page, m)
    assert "the lattice held" in got and "no sample was" in got and "-" not in got, got
    assert "the slowly drifted" in got and "the lattice drifted" in got and "about (seven) litres; each" in got, got


def test_bigrams_decide_between_words():
    """Where two words are as likely by the channel, and where a word is read that is one, the words beside it decide."""
    words = {w: 1000 for w in {*WORDS, "hot", "bot", "gate", "gale", "arm"}}
    big = [("the", "bot", 900), ("bot", "drifted", 900), ("cold", "gale", 900), ("gale", "drifted", 900), ("the", "pore", 900)]
    line = "the hot drifted while the cold gate drifted"
    m = scans.model_of(list(words.items()), big)
    one = lambda model: [(s, p) for _, _, s, p in scans.read([line], [False], [False], model)]
    chances = [0.02] * len(m.chances)
    m.use(chances)
    assert one(m) == [("hot", "bot"), ("gate", "gale")] and one(scans.model_of(list(words.items()), [], chances)) == []


def test_channel_is_learnt(spark):
    """Confusions at work on the pages gain, the others lose."""
    rng = random.Random(6)
    page = lambda: "\n".join(" ".join(w.replace("c", "e") if rng.random() < 0.3 else w for w in (rng.choice(WORDS) for _ in range(9))) for _ in range(12))
    rows = [(f"p{i}", "pmc", prose(rng), "", None) for i in range(20)] + [(f"s{i}", None, page(), "", None) for i in range(20)]
    d = corpus(spark, rows)
    c = {(r["seen"], r["printed"]): r["chance"] for r in scans.confusions(d, vocabulary(spark)).collect()}
    assert c["e", "c"] > 5 * max(c["c", "e"], c["1", "l"], c["m", "rn"])
    assert scans.confusions(corpus(spark, []), vocabulary(spark)).count() == len(scans.CONFUSIONS) + 2


def test_source_and_year_do_not_matter(spark):
    d = corpus(spark, [("a", "raid", PAGE, "", None), ("b", None, PAGE, "", None)])
    n = {r["doc_id"]: r["count"] for r in scans.repair_lines(d, vocabulary(spark)).groupBy("doc_id").count().collect()}
    assert n == {"a": 9, "b": 9}


def test_carried_before_a_conjunction():
    known = {"detector"}.__contains__
    assert pages.carried(["the detect-", "or was open"], [False, False], known) == [True, False]
    assert pages.carried(["two-", "or threefold"], [False, False], known) == [False, False]


def test_headers_of_long_texts():
    lines = [f"THE RIGID PORE NUMBER {i}" if i % 3 else "the rigid pore held about seven litres of argon and drifted." for i in range(6000)]
    out = pages.furniture(lines)
    assert all(o == bool(i % 3) for i, o in enumerate(out))


def test_furniture_forms():
    body = "the rigid pore held about seven litres of argon and drifted."
    for s in ("145", "xii", "— 21 —", "- 21 -", "Page 3 of 412", "[p. 87]", "57   Norlemark and Holvik", "Norlemark and Holvik   57", "378 | Review of Things 9 (1979)", "THE RIGID PORE OF ARGON   57"):
        assert pages.furniture([body, s, body]) == [False, True, False], s
    assert pages.furniture([body, "2.2 The pore of sample G7", body]) == [False] * 3


# ---- 5 ----


@pytest.mark.parametrize(
    "parts",
    [
        ["It was 3.5 bar.", "Then Dr. Li saw Fig. 2 (cf. Eq. 4) vs. the rest.", "J. A. Smith left."], ['"Is it dry?" asked Prof. Li.', "He left at 9 a.m. and came back."], ["At 113 K.", "Warum verändert der Träger die Pore?"],
        ["Am 6. März 1982 kam z. B. Dr. Li.", "„Schluss!“, rief er."], ["« Fermez la vanne ! » cria X.", "C'est le cas, p. ex., de H6."], ["¡Qué rápido!", "La Sra. Li dijo: «ya está.»", "Véase la pág. 3."],
        ["«Закройте кран!» — крикнул он.", "В 1963 г. было и т. д.", "См. рис. 8."], ["“快关阀门！”操作员喊道，共4次。", "记录写道：“样品。”", "经过4分钟。"], ["「弁を閉めろ！」と操作員は叫んだ。", "終わった。"],
        ["डॉ. Li ने जाँच की।", "क्या हुआ?"], ["راجع د. Li في ص. 55.", "لماذا؟"], ["It fell ... and then rose.", "The file run.48.csv lists it."], ["It rose.", "pH was set.", "m-Xylene fell."],
    ],
)
def test_sentences(parts):
    sep = "" if re.search("[぀-ヿ㐀-鿿]", parts[0]) else " "
    text = sep.join(parts)
    e = sentences.ends(text)
    assert [text[a:z].strip() for a, z in zip([0, *e], e)] == parts


def test_sentence_edges(spark):
    assert sentences.ends("One fell.Then two fell.\n\nA heading\n\nlast words \n") == [9, 23, 34, 46]
    assert sentences.ends("") == sentences.ends(None) == sentences.ends(" \n\n ") == []
    assert sentences.ends("ผลึก เปลี่ยน\nแล้ว") == [4, 12, 17]
    d = corpus(spark, [("a", "arxiv", "One. Two.", None, None), ("a", "arxiv", "One. Two.", None, None), ("b", "pmc", "X.", None, None)])
    assert sorted((r["doc_id"], r["end_char"]) for r in sentences.sentence_ends(d, ("arxiv",)).collect()) == [("a", 4), ("a", 9)]
    assert sentences.sentence_ends(odd(spark)).count() == 1 and sentences.sentence_ends(corpus(spark, [])).count() == 0


@settings(max_examples=100, deadline=None)
@given(some.text(alphabet="aB .!?\n\"”“」。１​", max_size=60))
def test_sentences_cover_the_text(t):
    e = sentences.ends(t)
    assert e == sorted(set(e)) and all(not t[z - 1].isspace() for z in e)
    if e:  # after the last sentence comes white space only, or what is not seen
        assert not t[e[-1] :].replace("\u200b", "").strip()
    else:
        assert not t.replace("\u200b", "").strip()


# ---- 6 ----


@pytest.mark.parametrize(
    ("line", "k"),
    [
        ("It was cold and the valve was open.", "prose"), ("* no fibrous moisture", "bullet"), ("11. the gauge", "bullet"), ("The pore ........ 129", "contents"), ("| a | b |", "table"), ("G28\t0.5\t8.27", "table"),
        ("FS;1.8;6.9;2.1", "table"), ("Binder: 5.0 min", "record"), ("pore=45.7; step(88) -> ok", "log"), ("Deep > Open > Rapid", "menu"), ("[9] P. Li, K. Mo, Reviews 175 (2002) 107-5", "reference"),
        ("20.1 = 4.3 × ρ4 − ∂x / ∂r ≥ 238", "formula"), ("be9^oxdes]%6oct4=b~h]c2%kv82}gvc", "junk"), ("pore, film, gas, cold lattice, argon", "keywords"), ("", "blank"),
    ],
)
def test_line_kinds(line, k):
    assert kind(line) == k


def test_quality(spark):
    rng = random.Random(4)
    rows = [(f"p{i}", "pmc", prose(rng, 80), "", None) for i in range(40)]
    rows += [(f"l{i}", "raid", "A list follows here:\n" + "\n".join(f"{k}. the {rng.choice(WORDS)}" for k in range(12)), "", None) for i in range(6)]
    rows += [(f"t{i}", "raid", "\n".join(f"G{k}\t{k}.5\t{i}.2\t7" for k in range(12)), "", None) for i in range(6)]
    common = spark.createDataFrame([("en", w) for w in ("the", "of", "and", "was", "no", "under")] + [(None, None)], "lang string, word string")
    d = corpus(spark, [*rows, rows[0]])
    assert sorted(r["doc_id"] for r in quality.not_prose(d, common).collect()) == sorted([f"l{i}" for i in range(6)] + [f"t{i}" for i in range(6)])
    types = {r["doc_id"]: r["text_type"] for r in quality.typed(d, common).collect()}
    assert types["p0"] == "prose" and types["l0"] == "list" and types["t0"] == "table"
    o = {r["doc_id"]: r["text_type"] for r in quality.typed(odd(spark), common).collect()}
    assert o["a"] == o["b"] == o["c"] == "empty" and len(o) == 4
    assert quality.not_prose(corpus(spark, []), common).count() == 0 and quality.by_source(corpus(spark, []), common).count() == 0
    assert quality.not_prose(d, common.limit(0)).count() == 12
    assert quality.accuracies(d, common).count() == 4 * (2 * 4 + 8 * 2) and quality.accuracies(corpus(spark, []), common).count() == 96


def test_agreement_outvotes_a_structure_function():
    """What decides is the posterior: where a structure function is alone against the others, they overrule it."""
    prose_, entry = [0, 0, 0, 0, 0, -1, -1, 0, -1, 0], [1, 1, 1, 1, 1, -1, -1, 1, 1, 1]
    alone = [1, 0, 0, 0, 0, -1, -1, 0, -1, 0]
    p = np.array([prose_, entry, alone])
    prior, tables = quality.learn(p, np.array([900.0, 90.0, 10.0]))
    assert quality.log_joint(p, prior, tables).argmax(1).tolist() == [0, 1, 0]


def test_kinds_count_signs_as_before():
    assert quality.statistics("ab 12 +=\n", {})[4:6] == (2 / 6, 2 / 6)
    assert quality.statistics("สวัสดี ครับผมชื่อสมชายนะครับ", {})[11] > 0.7 and quality.statistics(None, {})[:3] == (0, 0, 0)


def test_label_model_learns_accuracies():
    rng = np.random.default_rng(0)
    true = rng.integers(0, 4, 4000)
    noisy = lambda p: np.where(rng.random(4000) < p, true, rng.integers(0, 4, 4000))
    votes = np.stack([noisy(0.9), noisy(0.9), noisy(0.7), np.where(rng.random(4000) < 0.5, -1, noisy(0.8))], 1)
    p, c = np.unique(votes, axis=0, return_counts=True)
    prior, tables = quality.learn(p, c.astype(float), naming=4)
    guess = quality.log_joint(votes, prior, tables).argmax(1)
    assert (guess == true).mean() > 0.93 and abs(prior - 0.25).max() < 0.05


# ---- 7 ----


def test_winnowing_guarantee():
    rng = np.random.default_rng(1)
    k, w = 4, 6
    for _ in range(60):
        shared = rng.integers(97, 100, k + w - 1).astype(np.uint32)
        a = np.concatenate([rng.integers(97, 123, 30), shared, rng.integers(97, 123, 9)]).astype(np.uint32)
        b = np.concatenate([rng.integers(97, 123, 3), shared, rng.integers(97, 123, 40)]).astype(np.uint32)
        assert set(leaks.winnow(a, k, w)[1].tolist()) & set(leaks.winnow(b, k, w)[1].tolist())


def plain_leaks(texts, items, n):
    out = set()
    for (i, t), (j, q) in itertools.product(enumerate(texts), items):
        if t and q:
            s, ws = leaks.stream(t), leaks.words_of(q)
            if any("".join(ws[a : a + n]) in s for a in range(len(ws) - n + 1)):
                out.add((i, j))
    return out


def test_leaks(spark):
    rng = random.Random(5)
    items = [(k, " ".join(f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.randrange(90)}" for _ in range(20))) for k in range(12)] + [(90, "too short"), (91, None)]
    texts = [None, "", prose(rng)]
    for k in range(60):
        q = items[k % 12][1].split()
        n, a = rng.choice((11, 12, 13, 20)), rng.randrange(0, 1)
        piece = " ".join(q[a : a + n])
        piece = [piece, piece.upper(), piece.replace(" ", "\n"), "<b>" + piece.replace(" ", "</b> <i>", 1) + "</i>", piece.replace("a", "а").replace(" ", " ​"), piece.replace(" ", ", ")][k % 6]
        texts.append(prose(rng, 15) + " " + piece + " " + prose(rng, 15))
    d, e = documents(spark, texts), spark.createDataFrame(items, "item_id bigint, text string").withColumns({"h": F.lit(1), "words": F.lit(2), "suite": F.lit("s")})
    want = plain_leaks(texts, items, 12)
    got = leaks.leaked(d.unionByName(d), e)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want
    assert {(r["doc_id"], r["item_id"]) for r in leaks.leaked(d, e, most=1).collect()} == want  # by shuffle
    assert leaks.leak_report(d, e).count() == 14
    assert leaks.leaked(d.limit(0), e).count() == 0 and leaks.leaked(d, e.limit(0)).count() == 0


# ---- 8 ----


def test_pivot_keeps_mass():
    rng = np.random.default_rng(2)
    for _ in range(50):
        f, s = rng.random(200), rng.integers(1, 500, 200).astype(float)
        g, at = mixture.pivot(f, s, rng)
        assert (g * s).sum() == pytest.approx((f * s).sum())
        assert sum((g > 0) & (g < 1)) <= 1 and (at < 0) == (not ((g > 0) & (g < 1)).any())
    assert mixture.pivot(np.zeros(0), np.zeros(0), rng)[1] == -1


def test_pivot_is_unbiased():
    f, s = np.array([0.2, 0.7, 0.5, 0.9, 0.4]), np.array([3.0, 1.0, 2.0, 5.0, 4.0])
    got = np.mean([mixture.pivot(f, s, np.random.default_rng(k))[0] for k in range(4000)], 0)
    assert np.abs(got - f).max() < 0.03


def test_mixture(spark):
    rng = random.Random(6)
    rows = [(i, prose(rng, 20 + i % 30), [" A", "b", "B", "c", None][min(i % 9, 4)]) for i in range(900)] + [(1000, None, "a"), (1001, "", "b")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({"tokens": F.lit(1), "copies": F.lit(2), "frac": F.lit("z")})
    t = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 2), ("c", 0.1, 1), ("missing", 0.1, 5)], "source string, target_share double, max_repeats int")
    m = mixture.mixture(d, t)
    assert m.filter("copies > CASE source WHEN 'a' THEN 3 WHEN 'b' THEN 2 ELSE 1 END").count() == 0
    assert m.count() == m.select("doc_id").distinct().count() and sorted(map(tuple, m.collect())) == sorted(map(tuple, mixture.mixture(d.repartition(7), t).collect()))
    s = {r["source"]: r for r in mixture.shares(d, t).collect()}
    for k, share in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert s[k]["actual_share"] == pytest.approx(share / 0.9, abs=0.003)
    assert s["missing"]["used_tokens"] == 0
    assert mixture.mixture(d.limit(0), t).count() == 0 and mixture.mixture(d, t.limit(0)).count() == 0
    over = {r["source"]: r for r in mixture.shares(d, t, total_tokens=10**7).collect()}
    assert over["c"]["used_tokens"] == over["c"]["source_tokens"]


def test_reduction_tree(spark, monkeypatch):
    monkeypatch.setattr(mixture, "ROWS_PER_BUCKET", 10)
    monkeypatch.setattr(mixture, "FAN_IN", 3)
    rng = random.Random(7)
    d = spark.createDataFrame([(i, prose(rng, 20 + i % 30), "a" if i % 3 else "b") for i in range(600)], "doc_id bigint, text string, source string")
    t = spark.createDataFrame([("a", 0.2, 1), ("b", 0.8, 1)], "source string, target_share double, max_repeats int")
    s = {r["source"]: r["actual_share"] for r in mixture.shares(d, t).collect()}
    assert s["a"] == pytest.approx(0.2, abs=0.003)


def test_tokens_of_long_texts():
    t = "word  and word " * 20_000
    enc = mixture.encoding(mixture.TOKENIZERS, mixture.VOCABULARY)
    assert mixture.count_tokens(t, mixture.TOKENIZERS, mixture.VOCABULARY) == len(enc.encode_ordinary(t))


# ---- 9 ----


def plain_pairs(texts, n):
    out = set()
    for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2):
        if a and b and any(a[k : k + n] in b for k in range(len(a) - n + 1)):
            out.add((i, j))
    return out


def test_code_points_and_hashes():
    c, b = code_points(pa.array(["aé", None, "", "日本\U0001f600"]))
    assert b.tolist() == [0, 2, 2, 2, 5] and "".join(map(chr, c)) == "aé日本\U0001f600"
    x = np.array([ord(ch) for ch in "abcdefgabcdefg"], np.uint32)
    for q in (1, 2, 3, 5, 7):
        h = gram_hashes(x, q)
        assert len(h) == 15 - q and (h[:-7] == h[7:]).all() if len(h) > 7 else True
    v = np.random.default_rng(3).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 7, 50):
        assert sliding_min(v, w).tolist() == [v[i : i + w].min() for i in range(51 - w)]


@settings(max_examples=150, deadline=None)
@given(some.lists(some.lists(some.integers(0, 5), max_size=30), max_size=5), some.integers(1, 9))
def test_cartesian_trees_by_brute_force(parts, t):
    h = np.array([x for p in parts for x in p], np.uint64)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    got = spans.min_hashes(h, ends - [len(p) for p in parts], ends, t)
    want = [min(p[i : i + t]) if i + t <= len(p) else 0 for p in parts for i in range(len(p))]
    assert got.tolist() == want


def test_cartesian_tree_of_a_loop():
    h = np.tile(np.arange(7, dtype=np.uint64), 50_000)
    assert (spans.min_hashes(h, np.array([0]), np.array([len(h)]), 285)[: len(h) - 284] == 0).all()


def test_passages_by_brute_force(spark):
    rng = random.Random(11)
    n, a, b = 60, prose(rng, 40), prose(rng, 40)
    texts = [a, "x " + a[:150], b + "1" + a[20:160], "none of these at all", b[3:] + "2", a, None]
    places = {}
    for i, t in enumerate(texts):
        for k in range(len(t or "") - n + 1):
            if i != 5:  # a copy of text 0
                places.setdefault(t[k : k + n], []).append((i, k))
    shared = {(i, k): sorted(j for j, _ in v) for v in places.values() if len({j for j, _ in v}) > 1 for i, k in v}
    runs = {}
    for i, k in sorted(shared):
        if shared.get((i, k - 1)) != shared[i, k]:
            runs[i, k] = first = k
        runs[i, k] = first
    size = {}
    for (i, k), f in runs.items():
        size[i, f] = max(size.get((i, f), 0), k + n)
    want = set()
    for (i, f), end in size.items():
        same = [p for p, e in size.items() if texts[p[0]][p[1] : e] == texts[i][f:end]]
        want.add((*min(same), len(shared[i, f]), i, f, end))
    got = spans.passages(documents(spark, texts), n, q=16).select("passage_rep", "passage_start", "holders", "rep", "start_char", "end_char")
    assert set(map(tuple, got.collect())) == want and len(want) >= 6


@pytest.mark.parametrize("seed", range(3))
def test_spans_by_brute_force(spark, seed):
    rng = random.Random(seed)
    n = 60
    passages = [prose(rng, 40)[: rng.choice((n - 1, n, n + 1, 150))] for _ in range(8)]
    texts = [None, "", "short"]
    for _ in range(60):
        t = "".join(rng.choice("abcdefgh 日é") for _ in range(rng.randrange(20, 120)))
        for p in rng.sample(passages, rng.randrange(0, 3)):
            t = t[: len(t) // 2] + p + t[len(t) // 2 :]
        texts.append(t)
    texts += texts[5:9] + [texts[5]] + ["x" * 500, "x" * 400 + "y"]
    d = documents(spark, texts)
    want = plain_pairs(texts, n)
    assert set(map(tuple, spans.sharing_pairs(d.unionByName(d.limit(10)), n).collect())) == want
    assert set(map(tuple, spans.sharing_pairs(d, n, q=16, k=3).collect())) == want
    s = {r["doc_id"]: r for r in spans.shared_share(d, n).collect()}
    assert len(s) == len(texts) and {i for i, r in s.items() if r["shared_chars"]} == {i for p in want for i in p}
    for i, t in enumerate(texts):  # characters in shared windows
        if t:
            hit = np.zeros(len(t), bool)
            for k in range(len(t) - n + 1):
                if any(j != i and u and t[k : k + n] in u for j, u in enumerate(texts)):
                    hit[k : k + n] = True
            assert s[i]["shared_chars"] == hit.sum()


def test_spans_of_a_hot_passage(spark, monkeypatch):
    monkeypatch.setattr(spans, "SALT_ROWS", 7)
    rng = random.Random(9)
    hot = prose(rng, 30)
    texts = [f"{k} {prose(rng, 5)} " + (hot if k % 3 == 0 else "") + prose(rng, 6) for k in range(90)]
    assert set(map(tuple, spans.sharing_pairs(documents(spark, texts), 80).collect())) == plain_pairs(texts, 80)
    assert spans.sharing_pairs(documents(spark, texts).limit(0), 80).count() == 0


def test_spans_of_rotated_loops(spark):
    """Two texts that are one loop at two phases, a looped notice among other words, and stretches that stand twice."""
    rng = random.Random(3)
    loop = prose(rng, 6) + " "
    a, b, c = prose(rng, 30), prose(rng, 30), prose(rng, 30)
    n = 80
    size = n - 1 + 2 * len(loop)  # each phase of the loop begins two windows
    whole, turned = (loop * 20)[:size], ((loop[7:] + loop[:7]) * 20)[:size]
    texts = [("- " * 60)[: n + 39], (" -" * 60)[: n + 39], whole, turned, "Q1 " + whole + "#1", "Z2 " + turned + "%2"]
    texts += [a + "1" + b + "2" + a, b + "3" + a + "4" + c, c + "5" + c, "none of these"]
    for t in (texts, texts[::-1]):
        got = spans.sharing_pairs(documents(spark, t), n).collect()
        assert len(got) == len(set(got)) and set(map(tuple, got)) == plain_pairs(t, n)
