"""Problem 9: long exact spans shared between records.

Method: compact windows. A text is the sequence of its character q-grams. Under a hash function the Cartesian tree over
the hashed sequence has the least gram at its root and the parts beside it as subtrees; a node with the part it spans is a
compact window: all subsequences of the part that hold the node share it as min-hash. Only nodes that span ``t`` or more
q-grams matter; they are the top of the tree. Under each function the windows say which starting places of subsequences of
``t`` q-grams have which min-hash; joining these intervals across the functions gives intervals of starting places with one
signature. Two texts that share a span of ``min_chars`` characters share ``t = min_chars - q + 1`` q-grams in a row and so
a signature under every function: joining the intervals of all texts by signature loses no such pair. What differs is removed
by comparing the windows of the joined intervals by two hashes, together 128 bits, of all their characters; holders are counted by
the first 64 of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkstat.llm.arrays import code_points, gram_hashes, mix
from inkstat.llm.skew import salted_join
from inkstat.runtime import cut, spread

Q = 64
FUNCTIONS = 2
SECOND_BASE = 0x1B873593CC9E2D51
SALT_ROWS = 1000
SALTS = 16


def _within(a: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places ``a, a + 1, ...`` (``n`` of them) of every part, and to which part each belongs."""
    part = np.repeat(np.arange(len(a)), n)
    return np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + a[part], part


def min_hashes(h: np.ndarray, a: np.ndarray, b: np.ndarray, t: int) -> np.ndarray:
    """The min-hash of the ``t`` values from each place on, by the top of the Cartesian tree over each part ``a:b``; 0 at
    places from which no ``t`` values of a part go.

    The least value of a part is its node (equal least values are one node with more than two subtrees) and the part its
    compact window; the parts beside it are its subtrees as far as they span ``t`` or more values.
    """
    out = np.zeros(len(h), h.dtype)
    todo = [(i, j) for i, j in zip(a.tolist(), b.tolist()) if j - i >= t]
    while todo:
        i, j = todo.pop()
        part = h[i:j]
        low = part.min()
        out[i : j - t + 1] = low
        at = np.flatnonzero(part == low)
        if len(at) == 1:
            c = i + int(at[0])
            if c - i >= t:
                todo.append((i, c))
            if j - c > t:
                todo.append((c + 1, j))
        else:
            edge = np.concatenate([[i - 1], at + i, [j]])
            todo += [(int(edge[g]) + 1, int(edge[g + 1])) for g in np.flatnonzero(np.diff(edge) > t)]
    return out


def _intervals(codes: np.ndarray, bounds: np.ndarray, span: int, q: int, k: int) -> tuple[np.ndarray, ...]:
    """Intervals of starting places with one signature: row, first and last place inside the row, signature."""
    grams = gram_hashes(codes, q)
    t = span - q + 1
    a, b = bounds[:-1], np.maximum(bounds[1:] - q + 1, bounds[:-1])
    long = np.flatnonzero(b - a >= t)
    places, part = _within(a[long], (b - a - t + 1)[long])
    if not len(places):
        return (np.zeros(0, np.int64),) * 4
    signature = np.zeros(len(places), np.uint64)
    for f in range(k):
        signature = mix(signature ^ min_hashes(mix(grams, 11 + f), a[long], b[long], t)[places], 5)
    row = long[part]
    new = np.ones(len(places), bool)
    new[1:] = (signature[1:] != signature[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(places)) - 1
    r = row[first]
    return r, places[first] - bounds[r], places[last] - bounds[r], signature[first].view(np.int64)


def _batches(it: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Split batches so that each holds about ``most`` bytes of text; one longer text makes a batch of its own."""
    for b in it:
        col = b.column("text").cast(pa.large_string()).fill_null("")
        off = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
        i = 0
        while i < len(col):
            j = max(int(np.searchsorted(off, off[i] + most, "right")) - 1, i + 1)
            yield b.slice(i, j - i)
            i = j


def _emit_intervals(span: int, q: int, k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(it):
            codes, bounds = code_points(b.column("text"))
            r, s, e, sig = _intervals(codes, bounds, span, q, k)
            at = pa.array(r)
            yield pa.record_batch(
                [*(b.column(c).take(at) for c in ("doc_id", "t", "u")), pa.array(sig), pa.array(s.astype(np.int32)), pa.array(e.astype(np.int32))],
                ["doc_id", "t", "u", "sig", "s", "e"],
            )

    return run


def _repeats(less: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Whether all but the last character of the windows at ``p`` (of one text) come again in these windows; ``less`` has the
    hashes of so many characters."""
    at = np.union1d(p, p + 1)  # where windows begin, and where the ends of those before them do
    _, group, n = np.unique(less[at], return_inverse=True, return_counts=True)
    return (n[group] > 1)[np.searchsorted(at, p)]


def _emit_windows(span: int):
    """Two hashes of all characters of every window whose start lies in a joined interval, and whether it may be part of a loop."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(it):
            codes, bounds = code_points(b.column("text"))
            h, h2 = gram_hashes(codes, span), gram_hashes(codes, span, SECOND_BASE)
            less = gram_hashes(codes, span - 1)
            rows, places, loops = [], [], []
            for i, todo in enumerate(b.column("todo").to_pylist()):
                p = np.unique(np.concatenate([np.arange(x["s"], x["e"] + 1) for x in todo])) + bounds[i]
                places.append(p)
                rows.append(np.full(len(p), i))
                loops.append(_repeats(less, p))
            if rows:
                r, p = np.concatenate(rows), np.concatenate(places)
                yield pa.record_batch(
                    [b.column("rep").take(pa.array(r)), pa.array(h[p].view(np.int64)), pa.array(h2[p].view(np.int64)), pa.array((p - bounds[r]).astype(np.int32)), pa.array(np.concatenate(loops))],
                    ["rep", "h", "h2", "at", "loops"],
                )

    return run


def _texts(docs: DataFrame, min_chars: int) -> DataFrame:
    d = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") >= min_chars))
    return d.withColumns({"t": F.xxhash64("text"), "u": F.hash("text")})


def copies(docs: DataFrame, min_chars: int = 300) -> DataFrame:
    """``(doc_id, rep)``: each document of ``min_chars`` or more characters, and the smallest doc_id of its text.

    Repeated rows count once; rows with null doc_id or null text are left out. Only ids and 96 bits of hash move.
    """
    k = _texts(docs, min_chars).select("doc_id", "t", "u").distinct()
    return k.join(k.groupBy("t", "u").agg(F.min("doc_id").alias("rep")), ["t", "u"]).select("doc_id", "rep")


def shared_windows(docs: DataFrame, min_chars: int = 300, q: int = Q, k: int = FUNCTIONS) -> DataFrame:
    """``(rep, h, h2, at, holders, mark, loops)``: each window of ``min_chars`` characters, beginning at ``at``, that more than one
    text holds; ``rep`` stands for all copies of a text, ``holders`` is the number of texts (places) that hold the
    window and ``mark`` a number that differs where the holders do. ``loops`` is true where all but the last character of
    the window come again in one of its holders."""
    q = min(q, min_chars)
    d = _texts(spread(docs.select("doc_id", "text"), "doc_id"), min_chars)
    kind = d.schema["doc_id"].dataType.simpleString()
    iv = cut(d.mapInArrow(_emit_intervals(min_chars, q, k), f"doc_id {kind}, t bigint, u int, sig bigint, s int, e int"))
    # intervals that only one text has leave first; then copies of one text fold into one, on the map side already
    hot = iv.groupBy("sig").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).filter("lo < hi").select("sig")
    texts = iv.join(hot, "sig", "left_semi").groupBy("t", "u", "s", "e").agg(F.min("doc_id").alias("rep"))
    todo = texts.groupBy("rep").agg(F.collect_set(F.struct("s", "e")).alias("todo"))
    w = d.select("doc_id", "text").join(todo, d["doc_id"] == todo["rep"]).select("rep", "text", "todo")
    w = cut(w.mapInArrow(_emit_windows(min_chars), f"rep {kind}, h bigint, h2 bigint, at int, loops boolean"))
    held = w.groupBy("h").agg(
        F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("holders"),
        F.sum(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)).cast("double")).alias("mark"),
        F.max("loops").alias("loops"),
    )
    # one row on the right for each window: what very many texts hold is split on the left by adaptive execution
    return w.drop("loops").join(held.filter("lo < hi").drop("lo", "hi"), "h").select("rep", "h", "h2", "at", "holders", "mark", "loops")


def _runs(w: DataFrame) -> DataFrame:
    """Shared windows with ``first``: whether the window before, in the same text, is shared by other texts or by none."""
    before = W.partitionBy("rep").orderBy("at")
    w = w.withColumns({"p_at": F.lag("at").over(before), "p_mark": F.lag("mark").over(before), "p_n": F.lag("holders").over(before)})
    return w.withColumn("first", F.expr("p_at IS NULL OR p_at <> at - 1 OR p_mark <> mark OR p_n <> holders")).drop("p_at", "p_mark", "p_n")


def _text_pairs(w: DataFrame) -> DataFrame:
    """Pairs of different texts. The leftmost window of text a that text b holds is first in its run, for b does not hold the
    one before. In b it is first too, or the window before it has the same holders; then all of it but its first character
    comes again in a, and the window loops. So first windows of a meet the first and the looping ones of b. Windows with
    many holders are salted."""
    w = _runs(w).filter("first OR loops")
    w = w.groupBy("rep", "h", "h2").agg(F.max("first").alias("first"), F.ceil(F.max("holders") / SALT_ROWS).cast("int").alias("salts"))
    a = w.filter("first").withColumn("salt", F.pmod(F.xxhash64("rep"), "salts").cast("int")).select("h", "h2", "salt", F.col("rep").alias("ra"))
    b = w.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("h", "h2", "salt", F.col("rep").alias("rb"))
    return a.join(b, ["h", "h2", "salt"]).where("ra < rb").select("ra", "rb").distinct()


def _with_copies(pairs: DataFrame, m: DataFrame, rep: str, name: str) -> DataFrame:
    """``pairs`` with the copies of ``rep`` as ``name``."""
    return salted_join(pairs, m.select(F.col("rep").alias(rep), F.col("doc_id").alias(name)), [rep], name, SALT_ROWS)


def sharing_pairs(docs: DataFrame, min_chars: int = 300, q: int = Q, k: int = FUNCTIONS) -> DataFrame:
    """``(doc_id_a, doc_id_b)``, ids ascending: two texts with ``min_chars`` or more equal characters in a row.

    Texts that are equal as a whole are pairs too; they are searched once and put in again at the end. Null and
    shorter texts have no pairs; repeated rows count once; an empty table gives none.
    """
    pairs = _text_pairs(shared_windows(docs, min_chars, q, k))
    m = cut(copies(docs, min_chars))
    out = _with_copies(_with_copies(pairs, m, "ra", "da"), m, "rb", "db").select("da", "db")
    inside = m.join(m.filter("doc_id <> rep").select("rep").distinct(), "rep", "left_semi")
    inside = _with_copies(inside.select(F.col("rep").alias("r"), F.col("doc_id").alias("da")), inside, "r", "db").where("da < db")
    out = out.unionByName(inside.select("da", "db"))
    return out.select(F.least("da", "db").alias("doc_id_a"), F.greatest("da", "db").alias("doc_id_b"))


def passages(docs: DataFrame, min_chars: int = 300, q: int = Q, k: int = FUNCTIONS) -> DataFrame:
    """``(passage_rep, passage_start, holders, rep, start_char, end_char)``: the longest stretches that one set of different texts
    holds, with a row for each place where a text holds one (ends exclusive).

    Rows of one passage have the same ``passage_rep`` and ``passage_start``, its first place by id and start; ``holders`` is
    the number of places that hold its windows. ``rep`` stands for all copies of a text (see ``copies``).
    """
    w = _runs(shared_windows(docs, min_chars, q, k))
    before = W.partitionBy("rep").orderBy("at")
    w = w.withColumn("run", F.sum(F.col("first").cast("int")).over(before))
    head = F.min(F.struct("at", "h", "h2"))
    r = w.groupBy("rep", "run").agg(head.alias("head"), F.max("at").alias("last"), F.max("holders").alias("holders"))
    r = r.select("rep", F.col("head.at").alias("start_char"), (F.col("last") + min_chars).alias("end_char"), "holders", "head.h", "head.h2", (F.col("last") - F.col("head.at")).alias("size"))
    name = r.groupBy("h", "h2", "size").agg(F.min(F.struct("rep", "start_char")).alias("name"))
    name = name.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    r = r.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(name, ["h", "h2", "size", "salt"])
    places = [F.col(c).cast("bigint").alias(n) for c, n in (("name.start_char", "passage_start"), ("start_char", "start_char"), ("end_char", "end_char"))]
    return r.select(F.col("name.rep").alias("passage_rep"), "holders", "rep", *places)


def _covered(w: DataFrame, min_chars: int) -> DataFrame:
    """``(rep, start_char, end_char)``: the stretches of each different text that other texts hold, joined where they
    touch."""
    before = W.partitionBy("rep").orderBy("at")
    w = w.select("rep", "at").distinct().withColumn("gap", F.coalesce(F.col("at") - F.lag("at").over(before) > min_chars, F.lit(True)))
    w = w.withColumn("run", F.sum(F.col("gap").cast("int")).over(before))
    return w.groupBy("rep", "run").agg(F.min("at").alias("start_char"), (F.max("at") + min_chars).alias("end_char")).drop("run")


def shared_share(docs: DataFrame, min_chars: int = 300, q: int = Q, k: int = FUNCTIONS) -> DataFrame:
    """``(doc_id, rep, n_chars, passages, shared_chars, share)`` for every document with a doc_id, once each.

    Null and empty texts have no characters and share 0.0; a text with copies is shared as a whole.
    """
    d = docs.filter("doc_id IS NOT NULL").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_chars")).distinct()
    m = copies(docs, min_chars)
    many = m.groupBy("rep").agg((F.count("*") > 1).alias("copied"))
    p = _covered(shared_windows(docs, min_chars, q, k), min_chars).groupBy("rep").agg(
        F.count("*").alias("passages"), F.sum(F.col("end_char") - F.col("start_char")).alias("found")
    )
    x = d.join(m.join(many, "rep").join(p, "rep", "left"), "doc_id", "left")
    shared = F.when(F.col("copied"), F.col("n_chars")).otherwise(F.coalesce("found", F.lit(0))).cast("bigint")
    x = x.withColumn("shared_chars", F.coalesce(shared, F.lit(0).cast("bigint")))
    return x.select(
        "doc_id", F.coalesce("rep", "doc_id").alias("rep"), "n_chars",
        F.coalesce("passages", F.when(F.col("copied"), F.lit(1)).otherwise(F.lit(0))).cast("bigint").alias("passages"), "shared_chars",
        F.coalesce(F.try_divide("shared_chars", "n_chars"), F.lit(0.0)).alias("share"),
    )
