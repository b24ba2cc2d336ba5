"""Full-text articles in XML, their split, year and licence; raw rows of public collections; PDF folders."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstat.functions import lexicons as lx
from inkstat.functions import text as tx
from inkstat.functions.text import fold

ARTICLE = T.StructType([T.StructField("title", T.StringType()), T.StructField("body", T.StringType())])
# Elements that are no prose.
NOT_PROSE = {
    "table-wrap", "table", "fig", "graphic", "disp-formula", "inline-formula", "media", "supplementary-material", "ref-list", "xref", "tex-math",
    "mml:math", "array", "alternatives",
}


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _marker(x: ET.Element) -> str:
    """A citation as a marker in brackets: its label if that is numbers, else the digits of what it refers to, else n."""
    label = "".join(x.itertext()).strip()
    if not all(c.isdigit() or c in ",-– " for c in label) or not any(c.isdigit() for c in label):
        label = "".join(c for c in x.get("rid") or "" if c.isdigit()) or "n"
    return f"[{label}]"


def prose_of(e: ET.Element, citations: bool) -> str:
    """The text of an element without what is no prose. Text that follows a removed element belongs to its parent and stays."""
    parts = [e.text or ""]
    for c in e:
        kind = _name(c)
        if kind == "xref" and citations and c.get("ref-type", "bibr") == "bibr":
            parts.append(_marker(c))
        elif kind not in NOT_PROSE:
            parts.append(prose_of(c, citations))
        parts.append(c.tail or "")
    return "".join(parts)


def _inside(e: ET.Element) -> Iterator[ET.Element]:
    """An element and all below it that are prose, in document order."""
    yield e
    for c in e:
        if _name(c) not in NOT_PROSE:
            yield from _inside(c)


def _boilerplate(heading: str) -> bool:
    key = heading.strip().lower().rstrip(":.").strip()
    head = key.lstrip("0123456789")
    if head != key:
        head = head[1:] if head[:1] in (".", ")") else head
        key = head.lstrip()
    return key in lx.BOILERPLATE_HEADINGS


def article(xml: str | None, citations: bool = False, drop_boilerplate: bool = True) -> tuple[str, str]:
    """Title and body of an article; two empty strings if the XML is broken.

    Each section gives its own paragraphs: those of a section inside a dropped one stay. Paragraphs that stand in the body
    itself come last.
    """
    try:
        root = ET.fromstring(xml or "")
    except ET.ParseError:
        return "", ""
    t = root.find(".//article-title")
    title = "" if t is None else "".join(t.itertext())
    body = root.find(".//body")
    if body is None:
        return title, ""
    out: list[str] = []
    for sec in _inside(body):
        if _name(sec) != "sec":
            continue
        head = sec.find("title")
        if drop_boilerplate and head is not None and _boilerplate(prose_of(head, citations)):
            continue
        out += [prose_of(p, citations).strip() for p in sec.findall("./p")]
    out += [prose_of(p, citations).strip() for p in body.findall("./p")]
    return title, "\n\n".join(p for p in out if p)


def parsed(xml: Column, citations: bool = False) -> Column:
    """Title and body of each article, cleaned: parsing is all that happens in Python."""

    @F.pandas_udf(ARTICLE)
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([tuple(map(fold, article(v, citations))) for v in x], columns=["title", "body"])

    a = run(xml)
    return F.struct(tx.clean_title(a["title"], folded=True).alias("title"), tx.clean(a["body"], citations, folded=True).alias("body"))


def split_articles(response: Column) -> Column:
    """The articles of one answer that holds several."""
    return F.filter(F.split(response, r"(?=<article[\s>])", -1), lambda p: p.startswith("<article"))


def year(xml: Column) -> Column:
    """The year of the first publication date, or null."""
    return F.regexp_extract(xml, r"(?s)<pub-date[^>]*>.*?<year>(\d{4})</year>", 1).try_cast("int")


def strip_licence(text: Column) -> Column:
    """A book without what stands up to its START mark and from its END mark on."""
    t = F.regexp_replace(text, r"(?is)\A.*?\*\*\*\s*START OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*?\*\*\*", "")
    return tx.strip(F.regexp_replace(t, r"(?is)\*\*\*\s*END OF (?:THE|THIS) PROJECT GUTENBERG EBOOK.*\z", ""))


def answers(rows: DataFrame, per_label: int, least_words: int = 50) -> DataFrame:
    """Documents of question rows ``(row, source, human_answers, chatgpt_answers)``: each answer with enough words, capped a label."""
    from inkstat.operators.preparation import capped, word_floor

    sides = []
    for label, col, letter in (("human", "human_answers", "h"), ("ai", "chatgpt_answers", "a")):
        x = rows.select("row", F.col("source").alias("domain"), F.posexplode(col).alias("i", "text"))
        sides.append(x.select(F.concat_ws(":", F.lit("hc3"), F.lit(letter), "row", "i").alias("doc_id"), F.lit(label).alias("label"), "domain", "text", "row", "i"))
    return capped(word_floor(sides[0].unionByName(sides[1]), least_words), per_label, "label", order="row").select("doc_id", "label", "domain", "text")


def generations(rows: DataFrame, domain: str, per_label: int) -> DataFrame:
    """Documents of ``(id, domain, attack, model, generation)``: rows of one domain without attack, capped a label by id."""
    from inkstat.operators.preparation import capped

    label = F.when(F.col("model") == "human", "human").otherwise("ai")
    r = rows.filter((F.col("domain") == domain) & (F.coalesce("attack", F.lit("none")) == "none"))
    r = r.select(F.concat(F.lit("raid:"), "id").alias("doc_id"), label.alias("label"), F.col("generation").alias("text"))
    return capped(r, per_label, "label")


def books(texts: DataFrame, least: int = 1_000, most: int = 5_000) -> DataFrame:
    """``(doc_id, title, text)`` of fetched books ``(id, title, text)``: without licence, of at least ``least`` words, cut to the first
    ``most``, titles to 200 characters."""
    x = texts.filter("text IS NOT NULL").select(F.concat(F.lit("gutenberg:"), F.col("id").cast("string")).alias("doc_id"), F.substring("title", 1, 200).alias("title"), tx.excerpt(strip_licence(F.col("text")), most, least).alias("text"))
    return x.filter("text IS NOT NULL")


def book_urls(index: DataFrame) -> DataFrame:
    """``(id, url)`` of an index ``(id, formats map<string, string>)``: the first plain text that is no archive."""
    e = F.filter(F.map_entries("formats"), lambda z: z["key"].startswith("text/plain") & ~z["value"].endswith(".zip"))
    return index.select("id", F.get(F.array_sort(e), 0)["value"].alias("url")).filter("url IS NOT NULL")


def topic_query(topics: list[str], first_year: int, last_year: int) -> str:
    """A boolean query: any of the topics, open access, a range of dates."""
    any_of = " OR ".join(f'"{t}"[Title/Abstract]' for t in topics)
    return f'({any_of}) AND "open access"[filter] AND ("{first_year}"[pdat] : "{last_year}"[pdat])'


def ids(search: Callable[[str, int, int], tuple[int, list[str]]], query: str, most: int, page: int = 5_000) -> list[str]:
    """Ids of a paged search, up to its count or ``most``. The caller's function does the request and keeps the pace."""
    out: list[str] = []
    while len(out) < most:
        total, got = search(query, len(out), min(page, most - len(out)))
        out += got
        if not got or len(out) >= total:
            break
    return out[:most]


def fetched(spark: SparkSession, wanted: DataFrame, fetch: Callable[[list[str]], str], batch: int = 40) -> DataFrame:
    """``(id, xml)`` of the articles with these ids, in requests of ``batch`` ids from the executors; a failing batch gives no rows. The
    id is read from each article, so that an article missing from an answer shifts nothing."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            w = b["id"].tolist()
            for i in range(0, len(w), batch):
                try:
                    yield pd.DataFrame({"answer": [fetch(w[i : i + batch])]})
                except Exception:  # noqa: BLE001 - one batch must not lose the run
                    continue

    a = wanted.select("id").mapInPandas(run, "answer string").select(F.explode(split_articles(F.col("answer"))).alias("xml"))
    number = F.regexp_extract("xml", r'<article-id[^>]*pub-id-type="pmc(?:id|aid)?"[^>]*>(?:PMC)?(\d+)', 1)
    return a.select(F.nullif(number, F.lit("")).alias("id"), "xml")


def pdf_texts(spark: SparkSession, folder: str, reader: Callable[[bytes], str] | None = None) -> DataFrame:
    """``(path, text)`` of the PDF files of a folder; unreadable files are left out. The reader is pypdf where it is installed."""

    def default(b: bytes) -> str:
        import io

        from pypdf import PdfReader

        return "\n".join(p.extract_text() or "" for p in PdfReader(io.BytesIO(b)).pages)

    read = reader or default

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            rows = []
            for p, c in zip(b["path"], b["content"]):
                try:
                    rows.append((p, read(c)))
                except ImportError:
                    raise
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(rows, columns=["path", "text"])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder).select("path", "content").mapInPandas(run, "path string, text string")


def repair_ligatures(text: Column, vocabulary: dict[str, float]) -> Column:
    """Joins what an extracted ligature tore apart, where the joined word is in the vocabulary (rates per million) and the left part is
    too rare to be a word. The vocabulary goes to the workers and is refused beyond a million words."""
    import re

    if len(vocabulary) > 1_000_000:
        raise ValueError("the vocabulary is too large to send to the workers")
    torn = re.compile("([A-Za-z]{1,6})\\s+([ﬀ-ﬆ][a-z]{1,14})")

    def join(m: re.Match) -> str:
        whole = (m.group(1) + fold(m.group(2))).lower()
        known = vocabulary.get(whole, 0.0) > 0 and vocabulary.get(m.group(1).lower(), 0.0) < 500
        return m.group(1) + m.group(2) if known else m.group()

    @F.pandas_udf(T.StringType())
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: torn.sub(join, v) if isinstance(v, str) else None)

    return run(text)
