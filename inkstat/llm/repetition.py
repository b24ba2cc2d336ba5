"""Problem 1: repetition inside a single document.

Method: isolation forest on rule statistics. Each document gets the shares of its text that repeated n-grams, lines,
sentences and paragraphs hold, computed over whole batches at once. A forest fitted on a bounded sample scores how soon
random splits set a document apart; a threshold calibrated on labelled rows of that sample selects the anomalous ones.
Labels come from an exact measure that is no feature of the forest: ranks by prefix doubling, as in a suffix array, say
which words belong to stretches that occurred earlier. The same exact measure is then taken of the selected documents,
and of no others.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm.arrays import BASE, mix
from inkstat.llm.chars import skeleton
from inkstat.llm.forest import IsolationForest
from inkstat.llm.words import WORD, words
from inkstat.runtime import spread

#: At most so many documents (the first by hash of doc_id) fit the forest and calibrate its threshold.
FIT_ROWS = 4096
STRETCH = 8
#: Where words are single characters, so many of them count as one word in the length of a stretch.
CHARS_A_WORD = 2
SHARE = 0.3
#: The forest is fitted on samples in which at most this share of rows is labelled repeating, however many there are.
CONTAMINATION = 0.03
#: Of the labelled rows at or above the threshold at least this share must be repeating ones.
CANDIDATE_PRECISION = 0.5
FOREST = ["cover_6", "dup_6gram", "cover_12", "dup_12gram", "dup_16gram", "dup_sentence_share"]
FEATURES = [*FOREST, "dup_line_share", "dup_paragraph_share", "top_3gram_share", "type_ratio"]
_PIECES = re.compile(rf"{WORD.pattern}|[.!?。！？।؟…;；]+|\n\s*\n|\n")
_ONE_CHAR = re.compile("[々〇぀-ヿ㐀-鿿豈-﫿ก-๛]")


def _ids(ws: list[str]) -> np.ndarray:
    seen: dict[str, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in ws), np.int64, len(ws))


def _ngram_ids(ids: np.ndarray, n: int) -> np.ndarray:
    """A number for the n-gram from each place on, equal for equal n-grams and for no others, by prefix doubling."""

    def ranks(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.unique(a * (int(b.max()) + 1 if len(b) else 1) + b, return_inverse=True)[1].reshape(-1)

    level, size, out, done = ids, 1, None, 0
    count = len(ids) - n + 1
    while True:
        if n & size:
            part = level[done : done + count]
            out = part if out is None else ranks(out, part)
            done += size
        if 2 * size > n:
            return out
        level = ranks(level[: len(level) - size], level[size:])
        size *= 2


def repeated(ids: np.ndarray, n: int = STRETCH) -> np.ndarray:
    """Which words belong to a stretch of ``n`` or more words that occurred earlier in the same text."""
    out = np.zeros(len(ids) + 1, np.int64)
    if len(ids) > n:
        g = _ngram_ids(ids, n)
        again = np.ones(len(g), bool)
        again[np.unique(g, return_index=True)[1]] = False
        at = np.flatnonzero(again)
        np.add.at(out, at, 1)
        np.subtract.at(out, at + n, 1)
    return np.cumsum(out)[:-1] > 0


def repeated_share(text: str | None) -> float:
    """The exact share of the words of a text that belong to stretches which occurred earlier in it."""
    ws = words(text) if text else []
    if not ws:
        return 0.0
    scale = CHARS_A_WORD if sum(map(bool, map(_ONE_CHAR.match, ws))) * 2 > len(ws) else 1
    return float(repeated(_ids(ws), STRETCH * scale).mean())


def _grams(h: np.ndarray, n: int) -> np.ndarray:
    """A polynomial hash of the ``n`` values from each place on."""
    size, power, out, done, count = 1, BASE, np.zeros(len(h) - n + 1, np.uint64), 0, len(h) - n + 1
    while True:
        if n & size:
            out = out * np.uint64(power) + h[done : done + count]
            done += size
        if 2 * size > n:
            return mix(out, 9)
        h = h[: len(h) - size] * np.uint64(power) + h[size:]
        power = power * power & 0xFFFFFFFFFFFFFFFF
        size *= 2


def _again(key: np.ndarray) -> np.ndarray:
    """Which values occurred before."""
    o = np.argsort(key, kind="stable")
    s = key[o]
    out = np.zeros(len(key), bool)
    out[o[1:]] = s[1:] == s[:-1]
    return out


def statistics(texts: list[str | None]) -> np.ndarray:
    """The rule statistics of a batch of texts, in the order of FEATURES, then the number of words; all 0 without
    words. N-grams are twice as long where words are single characters."""
    pieces = [_PIECES.findall(skeleton(t).casefold()) if t else [] for t in texts]
    many = len(pieces)
    doc = np.repeat(np.arange(many), np.fromiter(map(len, pieces), np.int64, many))
    codes, distinct = pd.factorize(np.array([x for p in pieces for x in p] or [""], object))
    codes = codes[: len(doc)]
    # 0: word, 1: stop, 2: line break, 3: blank line
    sort = np.fromiter((3 if x.count("\n") > 1 else 2 if x[:1] == "\n" else 0 if WORD.match(x) else 1 for x in distinct), np.int8, len(distinct))[codes]
    size = np.fromiter(map(len, distinct), np.int64, len(distinct))[codes]
    one = np.fromiter((bool(_ONE_CHAR.match(x)) for x in distinct), bool, len(distinct))[codes]
    word = sort == 0
    h, d, size = mix(codes[word].astype(np.uint64), 3), doc[word], size[word]
    salt = mix(d.astype(np.uint64), 5)
    n = np.bincount(d, minlength=many)
    some = np.maximum(n, 1)
    scale = np.where(np.bincount(d, one[word], minlength=many) * 2 > n, CHARS_A_WORD, 1)
    chars = np.maximum(np.bincount(d, size, minlength=many), 1)
    out = np.zeros((many, len(FEATURES) + 1))
    out[:, -1] = n

    def duplicates(length: int) -> tuple[np.ndarray, np.ndarray]:
        cover, dup = np.zeros(many), np.zeros(many)
        for k in np.unique(scale):
            w = int(length * k)
            if len(h) < w:
                continue
            at = np.flatnonzero((d[: len(d) - w + 1] == d[w - 1 :]) & (scale[d[: len(d) - w + 1]] == k))
            at = at[_again(_grams(h, w)[at] ^ salt[at])]
            step = np.zeros(len(h) + 1, np.int64)
            np.add.at(step, at, 1)
            np.subtract.at(step, at + w, 1)
            cover += np.bincount(d[np.cumsum(step)[:-1] > 0], minlength=many) / some
            dup += np.bincount(d[at], minlength=many) / np.maximum(n - w + 1, 1)
        return cover, dup

    out[:, 0], out[:, 1] = duplicates(6)
    out[:, 2], out[:, 3] = duplicates(12)
    out[:, 4] = duplicates(16)[1]
    for j, level in ((5, (1, 3)), (6, (2, 3)), (7, (3,))):
        new = np.isin(sort, level)
        new[1:] |= doc[1:] != doc[:-1]
        part = np.cumsum(new)[word]
        if not len(part):
            continue
        first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
        place = np.arange(len(part)) - np.repeat(first, np.diff(np.append(first, len(part))))
        key = mix(np.add.reduceat(mix(h ^ mix(place.astype(np.uint64), 6), 7), first), 8) ^ salt[first]
        weight = np.add.reduceat(size, first)
        out[:, j] = np.bincount(d[first], np.where(_again(key), weight, 0), minlength=many) / chars
    if len(h) >= 3:
        at = np.flatnonzero(d[:-2] == d[2:])
        if len(at):
            key, inverse, count = np.unique(_grams(h, 3)[at] ^ salt[at], return_inverse=True, return_counts=True)
            weight = np.where(count > 1, np.bincount(inverse, (size[at] + size[at + 1] + size[at + 2]).astype(float)), 0.0)
            top = np.zeros(many)
            np.maximum.at(top, d[at], weight[inverse])
            out[:, 8] = np.minimum(top / chars, 1.0)
    out[:, 9] = np.bincount((np.unique(d * (len(distinct) + 1) + codes[word]) // (len(distinct) + 1)), minlength=many) / some
    return out


class Detector:
    """A forest and its threshold. ``x`` holds the forest's statistics of the sample, ``share`` the exact measure.

    The even rows calibrate the threshold: the least score at and above which at least ``CANDIDATE_PRECISION`` of the
    rows are repeating ones. ``held_out`` says of the odd rows how many repeat, how many of these are selected and
    how many rows are selected in all. Without repeating rows only what scores above all of the sample is selected.
    """

    def __init__(self, x: np.ndarray, share: np.ndarray, seed: int = 7):
        label = share >= SHARE
        rare = max(1, int(CONTAMINATION * (~label).sum()))
        self.forest = IsolationForest(seed=seed).fit(np.vstack([x[~label], x[label][:rare]]))
        s = self.forest.score(x)
        even = np.arange(len(x)) % 2 == 0
        self.threshold = self._threshold(s[even], label[even]) if label[even].any() else float(np.nextafter(s.max(), 2))
        odd = ~even
        self.held_out = (int(label[odd].sum()), int((label & (s >= self.threshold))[odd].sum()), int((s >= self.threshold)[odd].sum()))

    @staticmethod
    def _threshold(s: np.ndarray, label: np.ndarray) -> float:
        o = np.argsort(-s, kind="stable")
        true = np.cumsum(label[o])
        last = np.append(s[o][1:] != s[o][:-1], True)  # equal scores are selected together
        ok = np.flatnonzero(last & (true >= CANDIDATE_PRECISION * np.arange(1, len(s) + 1)))
        return float(s[o][ok[-1]]) if len(ok) else float(s[label].max())


_SCHEMA = "doc_id string, source string, {}, n_words bigint".format(", ".join(f"{f} double" for f in FEATURES))


def _stats_frame(b: pd.DataFrame) -> pd.DataFrame:
    x = pd.DataFrame(statistics([t if isinstance(t, str) else None for t in b["text"]]), columns=[*FEATURES, "n_words"])
    x.insert(0, "doc_id", b["doc_id"].to_numpy())
    x.insert(1, "source", b["source"].to_numpy())
    return x.astype({"n_words": "int64"})


def _labelled(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in it:
        yield _stats_frame(b).assign(share=[repeated_share(t) for t in b["text"]])


def fit(docs: DataFrame, rows: int = FIT_ROWS) -> Detector | None:
    """Fit on the ``rows`` documents with the smallest hashes; None for a table without texts.

    Ids are chosen first, by a bound on their hash that lets some more than ``rows`` through; only then texts are read.
    """
    d = docs.select("doc_id", "text", "source").filter("doc_id IS NOT NULL")
    part = min(1.0, 1.5 * rows / max(d.count(), 1))
    h = F.xxhash64("doc_id")
    ids = docs.select("doc_id").filter("doc_id IS NOT NULL").filter(F.pmod(h, F.lit(1 << 40)) < int(part * (1 << 40)) + 1).distinct()
    ids = ids.orderBy(F.pmod(h, F.lit(1 << 40)), "doc_id").limit(rows)
    x = d.filter(F.length("text") > 0).join(F.broadcast(ids), "doc_id", "left_semi")  # at most ``rows`` ids
    x = x.repartition(2 * docs.sparkSession.sparkContext.defaultParallelism, "doc_id").mapInPandas(_labelled, _SCHEMA + ", share double")
    x = x.filter("n_words > 0").select("doc_id", *FOREST, "share").toPandas().drop_duplicates("doc_id")
    x = x.assign(h=pd.util.hash_array(x["doc_id"].to_numpy(object), categorize=False)).sort_values(["h", "doc_id"])
    return Detector(x[FOREST].to_numpy(float), x["share"].to_numpy(float)) if len(x) else None


def scored(docs: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id, source, statistics ..., n_words, score, anomalous, repeated_share)`` once for each document.

    ``repeated_share`` is measured exactly of anomalous documents and null for all others. Null and empty texts have no
    words and score 0; rows with null doc_id are left out. Columns beside doc_id, source and text are not read.
    """
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs, rows)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(packed.value)
        for b in it:
            x = _stats_frame(b)
            some = x["n_words"].to_numpy() > 0
            s = np.zeros(len(x))
            if m is not None:
                s[some] = m.forest.score(x.loc[some, FOREST].to_numpy(float))
            odd = some & (s >= (m.threshold if m else 2.0))
            share = [repeated_share(t) if o else None for t, o in zip(b["text"], odd)]
            yield x.assign(score=s, anomalous=odd, repeated_share=pd.Series(share, dtype="float64"))

    d = spread(docs.select("doc_id", "text", "source").filter("doc_id IS NOT NULL"), "doc_id")
    return d.mapInPandas(run, _SCHEMA + ", score double, anomalous boolean, repeated_share double").dropDuplicates(["doc_id"])


def repeating(docs: DataFrame, share: float = SHARE, rows: int = FIT_ROWS) -> DataFrame:
    """``(doc_id)`` of the documents the forest sets apart of whose words at least ``share`` are repeated."""
    return scored(docs, rows).filter(F.col("repeated_share") >= share).select("doc_id")


def by_source(docs: DataFrame, share: float = SHARE, rows: int = FIT_ROWS) -> DataFrame:
    """``(source, documents, anomalous, repeating, mean_cover, mean_dup_sentences)`` of each source."""
    s = scored(docs, rows).filter("n_words > 0")
    return s.groupBy(F.lower(F.trim("source")).alias("source")).agg(
        F.count("*").alias("documents"), F.count_if("anomalous").alias("anomalous"), F.count_if(F.col("repeated_share") >= share).alias("repeating"),
        F.avg("cover_12").alias("mean_cover"), F.avg("dup_sentence_share").alias("mean_dup_sentences"),
    )
