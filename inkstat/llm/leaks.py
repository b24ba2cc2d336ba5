"""Problem 7: passages of evaluation items inside training text.

Method: winnowing. Both sides become streams of letters and digits (case, punctuation, mark-up, spacing and the choice
among look-alike or unseen characters removed); of every ``w`` consecutive ``k``-gram hashes the least is kept. With
``k + w - 1 <= t`` each shared stretch of ``t`` characters holds a kept hash on both sides; ``t`` is the shortest
stretch that ``min_words`` words of any item fill, so no passage of that many words is missed. Joined fingerprints
are extended to both sides as far as the streams agree, and the item's words inside are counted.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstat.llm.arrays import gram_hashes, sliding_min
from inkstat.llm.chars import LOOKALIKE
from inkstat.runtime import cut, spread

#: Items whose fingerprints number at most so many (16 bytes each) go to every worker; more are joined by shuffle.
BROADCAST_FINGERPRINTS = 2_000_000
#: Of every worker's copy of the items' streams, in characters.
BROADCAST_CHARS = 32_000_000
LONGEST_K = 24
SALTS = 16

_TAG = re.compile(r"<[!/]?[A-Za-z][^<>]{0,200}>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9A-Fa-f]{1,6}|[A-Za-z]{2,8}\d{0,2});")
_NOT_WORD = re.compile(r"[\W_]+")


class _Fold(dict):
    """Keeps letters and digits, puts prototypes for look-alikes, drops everything else."""

    def __missing__(self, o: int) -> str | None:
        c = LOOKALIKE.get(chr(o), chr(o))
        self[o] = r = "".join(x for x in c.casefold() if x.isalnum()) or None
        return r


_FOLD = _Fold()


def stream(text: str) -> str:
    """Letters and digits of a text, case folded, look-alikes by prototype, without mark-up."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    if text.isascii():
        return _NOT_WORD.sub("", text).lower()
    return unicodedata.normalize("NFKD", text).translate(_FOLD)


def words_of(text: str) -> list[str]:
    """The streams of the words of an item; signs standing alone are no words."""
    return [s for s in map(stream, text.split()) if s]


def codes_of(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def winnow(codes: np.ndarray, k: int, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the kept k-grams: each least hash of ``w`` consecutive ones (all places of equal least
    hashes); of a stream with fewer than ``w`` k-grams the least of all."""
    g = gram_hashes(codes, k)
    if not len(g):
        return np.zeros(0, np.int64), g
    w = min(w, len(g))
    low = sliding_min(g, w)
    # a place is kept if its hash is the least of some window that covers it
    cover = np.full(len(g), 0, np.uint64)
    padded = np.concatenate([np.zeros(w - 1, np.uint64), low, np.zeros(w - 1, np.uint64)])
    cover = ~sliding_min(~padded, w)
    at = np.flatnonzero(g == cover)
    return at, g[at]


def extend(doc: np.ndarray, item: np.ndarray, p: int, q: int, k: int) -> tuple[int, int]:
    """The bounds in the item of the agreeing stretch around the equal k-grams at ``p`` and ``q``; empty where the
    k-grams differ in fact."""
    if not np.array_equal(doc[p : p + k], item[q : q + k]):
        return q, q
    n = min(p, q)
    d = np.flatnonzero(doc[p - n : p] != item[q - n : q])
    left = n - (int(d[-1]) + 1) if len(d) else n
    m = min(len(doc) - p, len(item) - q)
    d = np.flatnonzero(doc[p : p + m] != item[q : q + m])
    right = int(d[0]) if len(d) else m
    return q - left, q + right


def _words_inside(starts: np.ndarray, ends: np.ndarray, a: int, b: int) -> int:
    return max(0, int(np.searchsorted(ends, b, "right") - np.searchsorted(starts, a, "left")))


class Items:
    """The items' streams, word bounds and fingerprints."""

    def __init__(self, rows: list[tuple[int, str]], k: int, w: int):
        self.k, self.w, self.ids, self.codes, self.starts, self.ends = k, w, [], [], [], []
        hs, who, at = [], [], []
        for item, text in rows:
            ws = words_of(text or "")
            lens = np.array([len(x) for x in ws], np.int64)
            self.ends.append(np.cumsum(lens))
            self.starts.append(np.cumsum(lens) - lens)
            self.codes.append(codes_of("".join(ws)))
            p, h = winnow(self.codes[-1], k, w)
            hs.append(h)
            at.append(p)
            who.append(np.full(len(p), len(self.ids)))
            self.ids.append(item)
        h = np.concatenate(hs) if hs else np.zeros(0, np.uint64)
        o = np.argsort(h, kind="stable")
        self.h = h[o]
        self.who = np.concatenate(who)[o] if who else np.zeros(0, np.int64)
        self.at = np.concatenate(at)[o] if at else np.zeros(0, np.int64)

    def find(self, text: str, min_words: int) -> dict[int, int]:
        """Item index to the largest number of its consecutive words in the text."""
        doc = codes_of(stream(text))
        p, h = winnow(doc, self.k, self.w)
        lo = np.searchsorted(self.h, h, "left")
        hi = np.searchsorted(self.h, h, "right")
        best: dict[int, int] = {}
        done = defaultdict(int)
        for j in np.flatnonzero(hi > lo):
            for e in range(lo[j], hi[j]):
                i, q = int(self.who[e]), int(self.at[e])
                line = (i, int(p[j]) - q)
                if done.get(line, -1) >= q:  # inside the stretch found before on this alignment
                    continue
                a, b = extend(doc, self.codes[i], int(p[j]), q, self.k)
                done[line] = b - self.k if b > a else q
                n = _words_inside(self.starts[i], self.ends[i], a, b)
                if n >= min_words and n > best.get(i, 0):
                    best[i] = n
        return best


@F.pandas_udf(T.IntegerType())
def _stream_length(text: pd.Series) -> pd.Series:
    return text.map(lambda t: len(stream(t)) if t else 0).astype("int32")


def _shortest(min_words: int):
    @F.pandas_udf(T.IntegerType())
    def run(text: pd.Series) -> pd.Series:
        def least(t: str | None) -> int | None:
            n = np.cumsum([0, *map(len, words_of(t or ""))])
            return int((n[min_words:] - n[:-min_words]).min()) if len(n) > min_words else None

        return text.map(least).astype("Int32")

    return run


def parameters(items: DataFrame, min_words: int) -> tuple[int, int, int] | None:
    """``(k, w, items' characters)``, or None if no item has ``min_words`` words."""
    r = items.select(_shortest(min_words)("text").alias("s"), _stream_length("text").alias("n")).agg(F.min("s").alias("t"), F.sum("n").alias("n")).first()
    if r["t"] is None:
        return None
    t = int(r["t"])
    k = max(1, min(LONGEST_K, (t + 1) // 2))
    return k, t - k + 1, int(r["n"])


def leaked(docs: DataFrame, items: DataFrame, min_words: int = 12, most: int = BROADCAST_FINGERPRINTS) -> DataFrame:
    """``(doc_id, item_id, words)``: the documents that hold ``min_words`` or more consecutive words of an item, and the
    longest run of its words.

    Null texts on either side, and items of fewer words, give no rows; repeated rows count once. The items' index is sent
    to the workers only if it has at most ``most`` fingerprints (their number is bounded by the characters counted
    first); otherwise fingerprints of both sides are joined by shuffle.
    """
    items = items.select("item_id", "text").filter("item_id IS NOT NULL AND text IS NOT NULL").distinct()
    d = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, words int"
    par = parameters(items, min_words)
    if par is None:
        return docs.sparkSession.createDataFrame([], kinds)
    k, w, chars = par
    d = spread(d, "doc_id")
    if chars <= min(most, BROADCAST_CHARS):  # there are no more fingerprints than characters
        index = docs.sparkSession.sparkContext.broadcast(Items([(r[0], r[1]) for r in items.collect()], k, w))

        def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            x = index.value
            for b in it:
                rows = [(i, x.ids[j], n) for i, t in zip(b["doc_id"], b["text"]) for j, n in x.find(t, min_words).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"])

        found = d.mapInPandas(run, kinds)
    else:
        found = _by_shuffle(d, items, k, w, min_words, kinds)
    return found.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))


def _fingerprints(key: str, k: int, w: int):
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for i, t in zip(b[key], b["text"]):
                p, h = winnow(codes_of("".join(words_of(t)) if key == "item_id" else stream(t)), k, w)
                yield pd.DataFrame({key: [i] * len(p), "h": h.view(np.int64), f"at_{key}": p.astype("int64")})

    return run


def _by_shuffle(d: DataFrame, items: DataFrame, k: int, w: int, min_words: int, kinds: str) -> DataFrame:
    """Join of all fingerprints; then each candidate document meets its items one at a time. Alignments are folded into
    one row for each (document, item, offset) before texts are joined in. A fingerprint that very many documents hold is
    spread over ``SALTS`` tasks."""
    a, b = (x.schema[c].dataType.simpleString() for x, c in ((d, "doc_id"), (items, "item_id")))
    fd = d.mapInPandas(_fingerprints("doc_id", k, w), f"doc_id {a}, h bigint, at_doc_id bigint")
    fi = cut(items.mapInPandas(_fingerprints("item_id", k, w), f"item_id {b}, h bigint, at_item_id bigint"))
    fd = fd.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    hits = fd.join(fi.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["h", "salt"]).groupBy("doc_id", "item_id", (F.col("at_doc_id") - F.col("at_item_id")).alias("off"))
    hits = hits.agg(F.collect_set("at_item_id").alias("at"))
    j = hits.join(d, "doc_id").join(items.withColumnRenamed("text", "item_text"), "item_id")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            rows = []
            for i, item, off, at, t, q in zip(x["doc_id"], x["item_id"], x["off"], x["at"], x["text"], x["item_text"]):
                one, doc = Items([(item, q)], k, w), codes_of(stream(t))
                best = 0
                for s in at:
                    lo, hi = extend(doc, one.codes[0], int(s + off), int(s), k)
                    best = max(best, _words_inside(one.starts[0], one.ends[0], lo, hi))
                if best >= min_words:
                    rows.append((i, item, best))
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "words"])

    return j.mapInPandas(run, kinds)


def leak_report(docs: DataFrame, items: DataFrame, min_words: int = 12) -> DataFrame:
    """``(item_id, suite, documents, longest_words)`` for every item, also those that did not leak."""
    x = leaked(docs, items, min_words).groupBy("item_id").agg(F.count("*").alias("documents"), F.max("words").alias("longest_words"))
    i = items.filter("item_id IS NOT NULL").select("item_id", "suite").dropDuplicates(["item_id"])
    return i.join(x, "item_id", "left").select("item_id", "suite", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest_words", F.lit(0)).alias("longest_words"))
