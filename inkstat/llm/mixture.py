"""Problem 8: a training mixture whose sources have target shares of all tokens.

Method: pivotal dependent rounding. A source that must give ``x`` copies of its tokens has ``floor(x)`` copies of each
row for sure and a fraction ``x - floor(x)`` of one more. Rows meet in pairs: mass moves between their two fractions,
at random and weighed by tokens so that the expected and the total number of tokens stay, until one of them is 0 or 1.
Each bucket of rows leaves at most one fraction; those are paired again, bucket by bucket, in a reduction tree of
applyInPandas stages until a source has a single one left, which is rounded at random.
"""

from __future__ import annotations

import base64
import functools
import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkstat.runtime import cut, spread

#: Folder of public tokenizers' vocabularies; the file is one of byte-level ranks.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: The pattern that goes with the vocabulary (a fixed value of it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ROWS_PER_BUCKET = 20_000
FAN_IN = 64


@functools.lru_cache(maxsize=2)
def encoding(folder: str, name: str):
    """The tokenizer, once for each worker."""
    import tiktoken

    with open(os.path.join(folder, name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: The tokenizer is handed at most so many characters at a time, cut where white space follows a non-space, where its
#: pattern never joins; one call over a text without such a place is not bounded.
PIECE = 100_000


def count_tokens(text: str, folder: str, name: str) -> int:
    enc = encoding(folder, name)
    text = text.encode("utf-8", "replace").decode("utf-8")
    n, i = 0, 0
    while len(text) - i > PIECE:
        j = text.rfind(" ", i + 1, i + PIECE)
        while j > i and (text[j - 1].isspace() or j + 1 < len(text) and text[j + 1].isspace()):
            j = text.rfind(" ", i + 1, j)
        if j <= i:
            break
        n += len(enc.encode_ordinary(text[i:j]))
        i = j
    return n + len(enc.encode_ordinary(text[i:]))


def _counter(folder: str, name: str):
    @F.pandas_udf(T.LongType())
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([count_tokens(t, folder, name) if t else 0 for t in text], dtype="int64")

    return run


def source_name(c):
    """One spelling of a source: lower case, no space around it; an empty one is null."""
    s = F.lower(F.trim(c))
    return F.when(s != "", s)


def sizes(docs: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens)``, written once: repeated rows count once; a null or empty text has 0 tokens."""
    d = spread(docs.select("doc_id", "source", "text"), "doc_id").filter("doc_id IS NOT NULL")
    d = d.select("doc_id", source_name(F.col("source")).alias("source"), _counter(folder, vocabulary)("text").alias("tokens"))
    return cut(d.groupBy("doc_id").agg(F.min("source").alias("source"), F.max("tokens").alias("tokens")))


def plan(size: DataFrame, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """``(source, target_share, max_repeats, rows, tokens, copies, wanted)`` for each source of the targets.

    ``copies`` is how often the tokens of a source are used on average. Without ``total_tokens`` the mixture is the
    largest in which every source that has tokens reaches its share within its repeats; shares of sources without
    tokens go to the others in proportion. With it, a source stops at its repeats and falls short.
    """
    t = targets.select(source_name(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("share"), "max_repeats")
    t = t.filter("source IS NOT NULL").groupBy("source").agg(F.sum("share").alias("share"), F.max("max_repeats").alias("max_repeats"))
    s = size.filter("tokens > 0").groupBy("source").agg(F.count("*").alias("rows"), F.sum("tokens").alias("tokens"))
    x = t.join(s, "source", "left").select(
        "source", F.col("share").alias("target_share"), "max_repeats", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("tokens", F.lit(0)).alias("tokens")
    )
    live = (F.col("tokens") > 0) & (F.col("target_share") > 0) & (F.col("max_repeats") > 0)
    sums = x.agg(F.sum(F.when(live, F.col("target_share"))).alias("all"), F.min(F.when(live, F.col("tokens") * F.col("max_repeats") / F.col("target_share"))).alias("most"))
    total = F.col("most") * F.col("all") if total_tokens is None else F.lit(float(total_tokens))
    x = x.crossJoin(F.broadcast(sums))  # one row
    wanted = F.when(live, total * F.col("target_share") / F.col("all")).otherwise(0.0)
    x = x.withColumn("wanted", wanted)
    copies = F.when(live, F.least(F.col("wanted") / F.col("tokens"), F.col("max_repeats").cast("double"))).otherwise(0.0)
    return x.withColumn("copies", copies).select("source", "target_share", "max_repeats", "rows", "tokens", "copies", "wanted")


def pivot(frac: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Round fractions in pairs; sum(frac * size) stays. Returns the fractions, and the place of the one that may be
    left between 0 and 1 (or -1)."""
    f, size = frac.astype(float).tolist(), size.astype(float).tolist()
    eps, open_at = 1e-9, -1
    draws = rng.random(len(f))
    for j in range(len(f)):
        if f[j] <= eps or f[j] >= 1 - eps:
            f[j] = float(f[j] > 0.5)
            continue
        if open_at < 0:
            open_at = j
            continue
        i = open_at
        # mass in tokens that may move from i to j (up) or from j to i (down)
        up = min(f[i] * size[i], (1 - f[j]) * size[j])
        down = min((1 - f[i]) * size[i], f[j] * size[j])
        m = up if draws[j] < down / (up + down) else -down
        f[i] -= m / size[i]
        f[j] += m / size[j]
        closed_i = f[i] <= eps or f[i] >= 1 - eps
        closed_j = f[j] <= eps or f[j] >= 1 - eps
        if closed_i:
            f[i] = float(f[i] > 0.5)
        if closed_j:
            f[j] = float(f[j] > 0.5)
        open_at = j if not closed_j else i if not closed_i else -1
    return np.array(f), open_at


def _round(seed: int, level: int, last: bool):
    def run(key, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("doc_id", kind="stable")
        name = f"{seed}/{level}/{'/'.join(map(str, key))}".encode()
        rng = np.random.default_rng(np.frombuffer(name.ljust((len(name) + 3) // 4 * 4, b"\0"), np.uint32))
        f, at = pivot(g["frac"].to_numpy(), g["tokens"].to_numpy(), rng)
        if last and at >= 0:
            f[at] = float(rng.random() < f[at])
        return g.assign(frac=f)

    return run


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, source, tokens, copies)`` of the rows used, ``copies`` from 1 to the source's max_repeats.

    Rows of sources that have no target, of null source, and rows without tokens are not used. An empty table gives
    no rows. The same seed gives the same rows, however the input is split.
    """
    size = sizes(docs, folder, vocabulary)
    return _mix(size, plan(size, targets, total_tokens), seed)


def _mix(size: DataFrame, goal: DataFrame, seed: int) -> DataFrame:
    x = size.filter("tokens > 0").join(goal.filter("copies > 0").select("source", "copies", "rows"), "source")
    x = x.withColumns({"base": F.floor("copies").cast("int"), "frac": F.col("copies") - F.floor("copies")})
    buckets = F.ceil(F.col("rows") / ROWS_PER_BUCKET)
    x = x.withColumn("bucket", F.pmod(F.xxhash64("doc_id", F.lit(seed)), buckets).cast("bigint"))
    most = max(1, -(-int(goal.agg(F.max("rows")).first()[0] or 0) // ROWS_PER_BUCKET))
    x = x.select("doc_id", "source", "tokens", "base", "bucket", "frac")
    level, parts = 0, []
    while True:
        last = most == 1
        x = cut(x.groupBy("source", "bucket").applyInPandas(_round(seed, level, last), x.schema))
        done = (F.col("frac") == 0) | (F.col("frac") == 1)
        parts.append(x.filter(done))
        if last:
            break
        x = x.filter(~done).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
        most, level = -(-most // FAN_IN), level + 1
    out = functools.reduce(DataFrame.unionByName, parts)
    return out.select("doc_id", "source", "tokens", (F.col("base") + F.col("frac").cast("int")).alias("copies")).filter("copies > 0")


def shares(docs: DataFrame, targets: DataFrame, total_tokens: float | None = None, seed: int = 17, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(source, target_share, max_repeats, source_tokens, used_tokens, used_rows, actual_share)`` for each target."""
    size = sizes(docs, folder, vocabulary)
    goal = plan(size, targets, total_tokens)
    used = _mix(size, goal, seed).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("used_tokens"), F.count("*").alias("used_rows"))
    x = goal.join(used, "source", "left").fillna(0, ["used_tokens", "used_rows"])
    return x.crossJoin(F.broadcast(x.agg(F.sum("used_tokens").alias("all")))).select(
        "source", "target_share", "max_repeats", F.col("tokens").alias("source_tokens"), "used_tokens", "used_rows",
        F.coalesce(F.try_divide("used_tokens", "all"), F.lit(0.0)).alias("actual_share"),
    )
