"""Problem 4: noise in text from scanned pages.

Method: noisy channel. Every word of a line has candidates: itself, and the words of the vocabulary that the scanner turns
into what is read by the confusions below. A candidate costs the logarithm of its confusions' chances, which
expectation-maximization learns from the unknown words of all scanned pages; a bigram model of the corpus, smoothed by its
unigrams, scores words beside each other; Viterbi picks the best sequence of every line. Pages are told by their layout:
running headers and page numbers are taken out and words carried over a line end are put together, over a page break too.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstat.llm.chars import consistent
from inkstat.llm.lines import kind
from inkstat.llm.pages import _HEADING, HYPHENS, carried, furniture, next_content, page_marks, wrapped
from inkstat.runtime import cut, spread

#: Words of the vocabulary that come up less often are taken for fragments.
MIN_COUNT = 20
#: The vocabulary goes to every worker; it is refused beyond so many rows.
MOST_WORDS = 20_000
#: Only bigrams that make up at least one in so many of all bigrams are kept, so there are at most so many.
MOST_BIGRAMS = 400_000
EM_ROUNDS = 4

# What is seen, and what was printed: fixed list of the confusions of scanned type.
CONFUSIONS = [
    ("1", "l"), ("1", "i"), ("0", "o"), ("5", "s"), ("6", "b"), ("8", "b"), ("9", "g"), ("9", "q"), ("4", "a"),
    ("3", "e"), ("2", "z"), ("7", "t"), ("|", "l"), ("!", "l"), ("!", "i"), ("l", "i"), ("i", "l"), ("l", "t"), ("t", "l"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("h", "b"), ("b", "h"), ("n", "u"), ("u", "n"), ("o", "e"),
    ("a", "o"), ("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"),
    ("li", "h"), ("h", "li"), ("nn", "m"), ("in", "m"), ("m", "in"), ("ri", "n"), ("n", "ri"), ("tl", "d"), (".", ""),
    ("fi", "fl"), ("y", "v"), ("v", "y"), ("q", "g"), ("g", "q"), ("ni", "m"), ("s", "a"),
]
#: Numbers of the classes that are no pair of the list: a letter of the wrong case, a letter read as any other.
CASE, ANY = len(CONFUSIONS), len(CONFUSIONS) + 1
#: Before learning each confusion has the same chance; learning starts from so many misread words of it.
START, PRIOR_WORDS = 0.005, 2.0
UNKNOWN_LOWER, UNKNOWN_NAME = 1e-9, 1e-7

#: In bigrams a stop and a number have one sign each.
MARKS = (".", "0")
_TOKEN = re.compile(r"\S+")
_SYMBOL = re.compile(r"[a-z]+|[.!?;]|\d[\d.,]*")
_STOPPED = re.compile(r"[.!?;][)\]\"'”’»]*\Z")
_EDGE = "()[]{}\"'“”„«»‘’,;:.!?"
_CODE = re.compile(r"(?:[A-Z]+\d*-?\d*|[A-Z][a-z]?-[a-z]{2,4}\d+|(?:[A-Z][a-z]?\d*){1,6}|\d[\d.,±–-]*|[a-z]{1,3}\d|run\.\d+\.csv|(?:[A-Za-z]\.){1,4}[A-Za-z]?)\Z")
_DIGIT_IN_NAME = re.compile(r"(?:[01568!|][a-z]{4,}|[A-Z]?[a-z]{2,}[01568!|][a-z]{2,}|l[bcdfghjkmnpqrstvwxz][a-z]{4,})\Z")
_NAME_LETTERS = str.maketrans("01568!|", "oisbbil")
_SOFT_HYPHEN = re.compile("[­¬](\\s*)\\Z")
_SINGLE = re.compile(r"[^\W\d_]\Z")


class Model:
    """Words with counts, their bigrams, the chances of confusions, and what may have been printed."""

    def __init__(self, words: dict[str, int], bigrams: dict[tuple[str, str], int], chances: list[float] | None = None):
        self.words, self.bigrams, self.total = words, bigrams, sum(words.values()) or 1
        self.letters = sorted({c for w in words for c in w if c.isalpha()})
        self.before: Counter[str] = Counter()
        self.kinds: Counter[str] = Counter()
        self.count = Counter(words)  # of words, stops and numbers
        for (a, b), n in bigrams.items():
            self.before[a] += n
            self.kinds[a] += 1
            if b in MARKS:
                self.count[b] += n
        self.paths: dict[str, dict[str, tuple[int, ...]]] = {}
        self.use(chances or [START] * (ANY + 1))

    def use(self, chances: list[float]) -> None:
        self.chances = list(chances)
        self.cost = [math.log(p) for p in chances]
        self.cache: dict[str, dict[str, float]] = {}
        self.states: dict[tuple[str, bool], list[tuple[str, float, str | None]]] = {}

    def known(self, w: str) -> bool:
        return w.lower() in self.words

    def word(self, w: str) -> float:
        return math.log((self.words.get(w, 0) + 0.01) / self.total)

    def follows(self, a: str, b: str) -> float:
        """The logarithm of the chance of ``b`` after ``a``: bigrams, interpolated with unigrams."""
        n = self.before[a]
        p = (self.count.get(b, 0) + 0.01) / self.total
        if not n:
            return math.log(p)
        weight = min(0.9, n / (n + self.kinds[a]))  # Witten-Bell, but never all
        return math.log(weight * self.bigrams.get((a, b), 0) / n + (1 - weight) * p)

    def candidates(self, seen: str) -> dict[str, float]:
        """Words that may have been printed where ``seen`` is read, with the logarithm of the channel's chance."""
        got = self.cache.get(seen)
        if got is None:
            got = {w: sum(self.cost[i] for i in path) for w, path in self.changes(seen).items()}
            if len(self.cache) > 100_000:
                self.cache.clear()
            self.cache[seen] = got
        return got

    def changes(self, seen: str) -> dict[str, tuple[int, ...]]:
        """Words that may have been printed where ``seen`` is read, each with the confusions on the way, the fewest
        that lead there."""
        got = self.paths.get(seen)
        if got is None:
            got = self._changes(seen)
            if len(self.paths) > 100_000:
                self.paths.clear()
            self.paths[seen] = got
        return got

    def _changes(self, seen: str) -> dict[str, tuple[int, ...]]:
        out: dict[str, tuple[int, ...]] = {}
        low = seen.lower()
        flips = sum(a != b for a, b in zip(seen[1:], low[1:])) and not seen.isupper()
        layer: dict[str, tuple[int, ...]] = {seen: ()}
        if seen != low:
            layer[low] = (CASE,) if flips else ()
        whole = low in self.words
        for _ in range(1 if whole else 2):  # of what is a word already one confusion away
            after: dict[str, tuple[int, ...]] = {}
            for s, path in layer.items():
                for k, (a, b) in enumerate(CONFUSIONS):
                    i = s.find(a)
                    while i >= 0:
                        after.setdefault(s[:i] + b + s[i + len(a) :], (*path, k))
                        i = s.find(a, i + 1)
                if s[:1] == "l" and s != low:
                    after.setdefault("I" + s[1:], (*path, 15))
            for t, path in (*layer.items(), *after.items()):
                w = t.lower()
                if w in self.words and w != seen and (not whole or w != low):
                    out.setdefault(w, path)
            layer = after
            if out:
                break
        if not out and not whole and len(low) >= 5 and low.isalpha() and seen == low:
            for t in self._edits(low):
                if t in self.words:
                    out[t] = (ANY,)
        return out

    def _edits(self, s: str) -> Iterator[str]:
        for i in range(len(s)):
            for c in self.letters:
                if c != s[i]:
                    yield s[:i] + c + s[i + 1 :]

    def keep(self, c: str) -> float:
        """The logarithm of the chance of an unknown word that is printed as it is read."""
        return math.log(UNKNOWN_NAME if c[:1].isupper() and c[1:].islower() and c.isalpha() else UNKNOWN_LOWER)

    def expected(self, seen: str, n: float) -> dict[int, float]:
        """How often each confusion is at work in ``n`` readings of an unknown word, by the chances so far."""
        options = [(self.keep(seen), ())] + [(self.word(w) + sum(self.cost[i] for i in path), path) for w, path in self.changes(seen).items()]
        top = max(p for p, _ in options)
        weights = [math.exp(p - top) for p, _ in options]
        out: Counter[int] = Counter()
        for x, (_, path) in zip(weights, options):
            for k in path:
                out[k] += n * x / sum(weights)
        return out

    def openings(self) -> list[float]:
        """For each confusion, how often in a printed word it could happen."""
        out = [sum(n * w.count(b) for w, n in self.words.items()) / self.total if b else 1.0 for _, b in CONFUSIONS]
        letters = sum(n * len(w) for w, n in self.words.items()) / self.total
        return [*out, letters, letters]


def model_of(words: list[tuple[str, int]], bigrams: list[tuple[str, str, int]], chances: list[float] | None = None) -> Model:
    v = {w: int(n) for w, n in words if n >= MIN_COUNT and re.fullmatch(r"[a-z][a-z'-]*[a-z]|a", w)}
    return Model(v, {(a, b): int(n) for a, b, n in bigrams}, chances)


def _normal_case(w: str) -> bool:
    return w.islower() or w.isupper() or (w[:1].isupper() and w[1:].islower())


class _Word:
    """A word as printed: its text, where it stands, the line of its first and last letter, and whether a stop follows."""

    __slots__ = ("core", "line", "line2", "cut", "torn", "stop")

    def __init__(self, core: str, line: int, line2: int, cut: int = 0, torn: bool = False, stop: bool = False):
        self.core, self.line, self.line2, self.cut, self.torn, self.stop = core, line, line2, cut, torn, stop


def _core(token: str, m: Model) -> str:
    """A token without the marks around it; ``!`` before a small letter stays if it stands for a letter."""
    c = token.strip(_EDGE)
    if c[:1].islower() and token.lstrip(_EDGE.replace("!", ""))[:1] == "!" and not m.known(c) and m.candidates("!" + c):
        return "!" + c
    return c


def _words_of(lines: list[str], out: list[bool], over: list[bool], m: Model) -> list[_Word]:
    """Words of the lines that are not furniture, in order; carried words are put together, torn letters joined."""
    words: list[_Word] = []
    pending: tuple[str, int] | None = None
    for i, s in enumerate(lines):
        if out[i] or not s.strip():
            continue
        toks = _TOKEN.findall(s)
        first = True
        j = 0
        while j < len(toks):
            k = j
            while k < len(toks) and len(toks[k]) <= 6 and _SINGLE.match(toks[k].strip(_EDGE) if k > j or toks[k][:1] in "(\"'“«" else toks[k]) and (k == j or toks[k - 1][-1:].isalpha()):
                k += 1
            if k - j >= 3:
                run = "".join(t.strip(_EDGE) for t in toks[j:k])
                # a single letter that is a word or unit may stand before or after the torn one
                for a, b in ((0, 0), (1, 0), (0, 1), (1, 1)):
                    part = run[a : len(run) - b]
                    if len(part) >= 3 and (m.known(part) or (len(part) >= 4 and m.candidates(part))):
                        words.append(_Word(part, i, i, torn=True))
                        j = k
                        break
                if j == k:
                    first = False
                    continue
            t = toks[j]
            if j + 1 < len(toks) and toks[j + 1][0].islower() and not (first and pending) and not (j + 2 == len(toks) and over[i]):
                # a word torn in two, of which one part at least is no word
                a, b = t.lstrip(_EDGE), toks[j + 1].rstrip(_EDGE)
                c = toks[j + 2].strip(_EDGE) if j + 2 < len(toks) else ""
                if (
                    m.known(a + b) and min(len(a), len(b)) > 1 and a.isalpha() and b.isalpha() and b.islower() and not (m.known(a) and m.known(b))
                    and not (m.known(a) and c.isalpha() and m.known(b + c))
                ):
                    words.append(_Word(a + b, i, i, torn=True, stop=bool(_STOPPED.search(toks[j + 1]))))
                    first = False
                    j += 2
                    continue
            if first and pending:
                a, line = pending
                words.append(_Word((a + t).strip(_EDGE), line, i, cut=len(a.lstrip(_EDGE)), stop=bool(_STOPPED.search(t))))
                pending = None
            elif j == len(toks) - 1 and over[i]:
                pending = (t.rstrip().rstrip(HYPHENS), i)
            else:
                c = _core(t, m)
                if c:
                    words.append(_Word(c, i, i, stop=bool(_STOPPED.search(t))))
            first = False
            j += 1
    return words


def _plain(c: str) -> bool:
    """Whether a token is written as a word: no number, code, formula or compound."""
    if len(c) < 2 or not any(x.isalpha() for x in c) or _CODE.match(c) or "/" in c or "%" in c or "±" in c:
        return False
    if "-" in c or "–" in c or not c.isascii():
        return False
    return not re.search(r"[a-z]{2}[.!?][A-Z]", c)  # two sentences without a space between them


def _states(w: _Word, m: Model) -> list[tuple[str, float, str | None]]:
    got = m.states.get((w.core, w.torn))
    if got is None:
        if len(m.states) > 100_000:
            m.states.clear()
        got = m.states[w.core, w.torn] = _states_of(w, m)
    return got


def _states_of(w: _Word, m: Model) -> list[tuple[str, float, str | None]]:
    """What may have been printed where a word is read: the word for its neighbours, the channel's cost, and the word as
    printed or None where what is read stands. One state where there is nothing to decide."""
    c, low = w.core, w.core.lower()
    if w.torn:
        return [(low, 0.0, low)] if m.known(c) else [(t, v, t) for t, v in m.candidates(c).items()] or [("", 0.0, None)]
    if not _plain(c):
        return [(low if low in m.words else "0" if low[:1].isdigit() else "", 0.0, None)]
    if m.known(c):
        if not _normal_case(c) and len(c) >= 4:
            return [(low, m.cost[CASE], low)]
        return [(low, 0.0, None), *((t, v, t) for t, v in (m.candidates(c) if _normal_case(c) else {}).items())]
    s: list[tuple[str, float, str | None]] = [("", m.keep(c), None), *((t, v, t) for t, v in m.candidates(c).items())]
    if len(s) == 1 and _DIGIT_IN_NAME.match(c):  # a name with a sign no name has; its letters by the first confusion
        s = [("", 0.0, c.translate(_NAME_LETTERS).capitalize())]
    return s


def read(lines: list[str], out: list[bool], over: list[bool], m: Model) -> list[tuple[int, int, str, str]]:
    """Misread words: first and last line, the core as read, the word as printed."""
    return [(*_where(w, printed), seen, printed) for w, seen, printed in _misread(lines, out, over, m)]


def _foreign(words: list[_Word], m: Model) -> set[int]:
    """Lines in which, with the line before and after, less than half of the words are of the vocabulary's language."""
    known: Counter[int] = Counter()
    total: Counter[int] = Counter()
    for w in words:
        if w.core.isalpha():
            total[w.line] += 1
            if w.core.lower() in m.words:
                known[w.line] += 1
    near = lambda c, i: c[i - 1] + c[i] + c[i + 1]
    return {i for i in total if near(known, i) < 0.5 * near(total, i)}


def _misread(lines: list[str], out: list[bool], over: list[bool], m: Model) -> list[tuple[_Word, str, str]]:
    """Misread words, their core as read and the word as printed, by Viterbi over the candidates of each line."""
    words = _words_of(lines, out, over, m)
    foreign = _foreign(words, m)
    wrong: list[tuple[_Word, str, str]] = []
    i, before = 0, ""
    while i < len(words):
        j = i
        while j < len(words) and words[j].line == words[i].line:
            j += 1
        if words[i].line in foreign:
            before = ""
        else:
            states = [_states(w, m) for w in words[i:j]]
            best = _viterbi(states, [w.stop for w in words[i:j]], before, words[j].core.lower() if j < len(words) else "", m)
            wrong += [(w, w.core, p) for w, (_, _, p) in zip(words[i:j], best) if p is not None]
            before = "." if words[j - 1].stop else best[-1][0]
        i = j
    return wrong


def _viterbi(
    states: list[list[tuple[str, float, str | None]]], stops: list[bool], before: str, after: str, m: Model
) -> list[tuple[str, float, str | None]]:
    """The most likely states of a line, between the last word of the line before and the first of the next. Words with
    one state need no decision, so the lattice falls apart at them."""
    best: list[tuple[str, float, str | None]] = []

    def step(a: str, b: str) -> float:
        return m.follows(a, b) if b else 0.0

    i = 0
    while i < len(states):
        if len(states[i]) == 1:
            best.append(states[i][0])
            before = "." if stops[i] else states[i][0][0]
            i += 1
            continue
        paths = [(step(before, x[0]) + x[1], [x]) for x in states[i]]
        j = i + 1
        while j < len(states) and len(states[j]) > 1 and not stops[j - 1]:
            paths = [max(((p + step(h[-1][0], x[0]) + x[1], [*h, x]) for p, h in paths), key=lambda z: z[0]) for x in states[j]]
            j += 1
        last = "." if stops[j - 1] else states[j][0][0] if j < len(states) and len(states[j]) == 1 else after if j == len(states) else ""
        last = last if last in m.words or last in MARKS else ""
        got = max(((p + (step(h[-1][0], last) if h[-1][0] else step("", last)), h) for p, h in paths), key=lambda z: z[0])[1]
        best += got
        before = "." if stops[j - 1] else got[-1][0]
        i = j
    return best


def _where(w: _Word, printed: str) -> tuple[int, int]:
    """The lines that hold wrong letters: of a carried word only those of the part that differs."""
    if w.line == w.line2:
        return w.line, w.line
    c = w.core.lower() if w.core.lower() != printed else w.core
    p = 0
    while p < min(len(c), len(printed)) and c[p] == printed[p]:
        p += 1
    q = 0
    while q < min(len(c), len(printed)) - p and c[-1 - q] == printed[-1 - q]:
        q += 1
    first, last = p, max(p, len(c) - q - 1)
    return (w.line if first < w.cut else w.line2), (w.line2 if last >= w.cut else w.line)


def page_lines(text: str) -> list[str]:
    """The lines of a text in consistent characters; a soft hyphen at a line end is kept as a hyphen."""
    plain = not any(c in text for c in "\r\x0b\x0c")
    return [x.rstrip(" ") if plain and x.isascii() else consistent(_SOFT_HYPHEN.sub(r"-\1", x)) for x in text.split("\n")]


_Read = tuple[list[str], list[bool], list[bool], list[tuple[_Word, str, str]]]


def scanned(text: str | None, m: Model) -> _Read | None:
    """Lines, furniture, carried lines and misread words of a text that comes from a scan; None for any other.

    A scan is set in lines of bounded width, holds prose for the most part, and has a trace of a page: a line that ends within a
    word, a line in the form of a page number or of a header with one, or two lines with misread words.
    """
    if not text or text.count("\n") < 2:
        return None
    lines = page_lines(text)
    if not wrapped(lines):
        return None
    kinds = [kind(x) for x in lines if x.strip()]
    if kinds.count("prose") < 0.6 * len(kinds):
        return None  # tables, lists and menus have lines like headers and no paragraphs
    out = furniture(lines)
    over = carried(lines, out, m.known)

    def split_word(i: int) -> bool:  # a text broken at hyphens its words had before is no scan
        j = next_content(lines, out, i)
        a, b = lines[i].split()[-1].rstrip(HYPHENS + " ").lstrip(_EDGE), lines[j].split()[0].strip(_EDGE)
        return m.known(a + b) and not (m.known(a) and m.known(b))

    if not any(page_marks(lines)) and not any(over[i] and split_word(i) for i in range(len(lines))):
        if not _may_be_misread(lines, m):
            return None
        wrong = _misread(lines, out, over, m)
        return (lines, out, over, wrong) if len({w.line for w, _, _ in wrong}) >= 2 else None
    return lines, out, over, _misread(lines, out, over, m)


def _may_be_misread(lines: list[str], m: Model) -> bool:
    """Whether two lines hold a word that may be read as another one, or letters torn apart."""
    n = 0
    for x in lines:
        toks = x.split()
        n += any(len(a) == 1 or len(a) > 1 and not m.known(a.strip(_EDGE)) and (len(_states(_Word(_core(a, m), 0, 0), m)) > 1 or m.known(a + b)) for a, b in zip(toks, [*toks[1:], ""]))
        if n >= 2:
            return True
    return False


def repairs(text: str | None, m: Model) -> list[tuple[int, str]]:
    """``(line_no, kind)`` of the lines that need repair."""
    x = scanned(text, m)
    if x is None:
        return []
    _, out, over, wrong = x
    got = {(i, "furniture") for i, f in enumerate(out) if f} | {(i, "hyphen") for i, f in enumerate(over) if f}
    for w, _, printed in wrong:
        got |= {(i, "misread") for i in _where(w, printed)}
    return sorted(got)


def _cased(seen: str, printed: str) -> str:
    return printed.capitalize() if seen[:1].isupper() else printed


def _put_whole(head: str, s: str, seen: str, printed: str) -> tuple[str, str]:
    """The parts of a carried word at the end of a line and at the start of the next, with the word as printed between what
    stands before and after it."""
    word, _, rest = s.partition(" ")
    whole = (head + word).replace(seen, _cased(seen, printed), 1)
    return whole, (" " + rest if rest else "")


def repaired(text: str | None, m: Model) -> str | None:
    """Continuous paragraphs: without furniture, carried words whole, misread words as printed. A text that is no scan
    is returned as it is."""
    x = scanned(text, m)
    if x is None:
        return text
    lines, out, over, wrong = x
    fixes: dict[int, list[tuple[str, str]]] = {}
    joined: dict[int, tuple[str, str]] = {}  # words carried over the end of a line, by that line
    for w, seen, printed in wrong:
        if w.line == w.line2:
            fixes.setdefault(w.line, []).append((seen, printed))
        else:
            joined[w.line] = (seen, printed)
    body: list[str] = []
    width = max(map(len, lines))
    glue, end = False, None
    for i, s in enumerate(lines):
        if out[i]:
            continue
        s = re.sub(r"[ \t]+", " ", s.strip())
        for seen, printed in fixes.get(i, ()):
            word = _cased(seen, printed)
            pattern = re.escape(seen) if seen in s else r"\s?".join(map(re.escape, seen))
            s = re.sub(rf"(?<![^\W\d_]){pattern}(?![^\W\d_])", word, s, count=1)
        if not s or _HEADING.match(s) and len(s) < 0.85 * width and not s.endswith((".", "-")) and not glue:
            body += ["", s, ""] if s else [""]
            glue, end = False, None
            continue
        if glue and body:
            head = body[-1].rsplit(" ", 1)[-1]
            a, b = head.rstrip(HYPHENS).strip(_EDGE), s.split()[0].strip(_EDGE)
            keep = not m.known(a + b) and (b[:1].isdigit() or a[:1].isupper() and len(a) <= 3 or m.known(a) and m.known(b))
            if end in joined:
                head, s = _put_whole(head.rstrip(HYPHENS), s, *joined[end])
                body[-1] = body[-1][: len(body[-1]) - len(body[-1].rsplit(" ", 1)[-1])] + head + s
            else:
                body[-1] = (body[-1] if keep else body[-1].rstrip(HYPHENS)) + s
        elif body and body[-1]:
            body[-1] += " " + s
        else:
            body.append(s)
        glue, end = over[i], i
    return re.sub(r"\n{2,}", "\n\n", "\n".join(x if x else "\n" for x in body)).strip()


def _counts(known: frozenset[str], most: int = 500_000):
    """Bigrams of known words in texts that are not set like pages, and the unknown words of those that are."""
    sign = {**{w: w for w in known}, **{x: "." for x in ".!?;"}}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: Counter[tuple[str, str]] = Counter()
        words: Counter[str] = Counter()
        for b in it:
            for t in b["text"]:
                if t.count("\n") >= 2 and wrapped(lines := page_lines(t)):
                    for x in lines:
                        cores = [w.strip(_EDGE) for w in x.split()]
                        strange = [c for c in cores if c.lower() not in known]
                        letters = sum(map(str.isalpha, cores))
                        if letters and sum(map(str.isalpha, strange)) * 2 < letters:  # in the language of the vocabulary
                            words[""] += len(cores)
                            words.update(c for c in strange if _plain(c))
                else:
                    ws = [sign.get(w) or ("0" if w[0].isdigit() else "") for w in _SYMBOL.findall(t.lower())]
                    pairs.update(zip(ws, ws[1:]))
            if len(pairs) + len(words) >= most:  # what a worker holds is bounded
                yield _count_frame(pairs, words)
                pairs.clear()
                words.clear()
        yield _count_frame(pairs, words)

    return run


def _count_frame(pairs: Counter, words: Counter) -> pd.DataFrame:
    rows = [(x, y, False, n) for (x, y), n in pairs.items() if x and y] + [(x, "", True, n) for x, n in words.items()]
    return pd.DataFrame(rows, columns=["a", "b", "page", "n"])


def _expected(packed) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(packed.value)
        total: Counter[int] = Counter()
        for b in it:
            for c, n in zip(b["a"], b["n"]):
                total.update(m.expected(c, n))
        yield pd.DataFrame([(k, n) for k, n in total.items()], columns=["k", "n"]).astype({"k": "int32", "n": "float64"})

    return run


def fit(docs: DataFrame, vocabulary: DataFrame) -> Model:
    """Unigrams of the vocabulary table, bigrams of its words over all texts that are not set like pages, and the chances of
    confusions by expectation-maximization over the unknown words of all that are.

    The driver holds the vocabulary, at most ``MOST_BIGRAMS`` bigrams and one number for each confusion.
    """
    spark = docs.sparkSession
    v = vocabulary.select("word", "n").dropna().limit(MOST_WORDS + 1).collect()
    if len(v) > MOST_WORDS:
        raise ValueError(f"the vocabulary has more than {MOST_WORDS} rows")
    words = [(r[0], r[1]) for r in v]
    known = frozenset(model_of(words, []).words)
    d = docs.select("doc_id", "text").filter(F.col("text").isNotNull())
    c = spread(d, "doc_id").select("text").mapInPandas(_counts(known), "a string, b string, page boolean, n bigint").groupBy("a", "b", "page").agg(F.sum("n").alias("n"))
    c = cut(c)
    least = (c.filter("NOT page").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) / MOST_BIGRAMS
    m = model_of(words, [tuple(r) for r in c.filter(~F.col("page") & (F.col("n") > least)).select("a", "b", "n").collect()])
    pages = c.filter("page AND a <> ''").select("a", "n")
    printed = c.filter("page AND a = ''").agg(F.sum("n")).first()[0]  # words on pages
    if not printed:
        return m
    openings = m.openings()
    for _ in range(EM_ROUNDS):
        e = dict(pages.mapInPandas(_expected(spark.sparkContext.broadcast(pickle.dumps(m))), "k int, n double").groupBy("k").agg(F.sum("n")).collect())
        m.use([min(0.2, (e.get(k, 0.0) + PRIOR_WORDS) / (openings[k] * printed + PRIOR_WORDS / START)) for k in range(ANY + 1)])
    return m


def _texts(docs: DataFrame) -> DataFrame:
    return spread(docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull() & (F.length("text") > 0)), "doc_id")


def repair_lines(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(doc_id, line_no, kind)``: lines of scanned texts that need repair; kind is furniture, hyphen or misread.

    Null and empty texts, null doc_ids and texts that are no scans give no rows; repeated rows count once.
    """
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs, vocabulary)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(model.value)
        for b in it:
            rows = [(i, n, k) for i, t in zip(b["doc_id"], b["text"]) for n, k in repairs(t, m)]
            yield pd.DataFrame(rows, columns=["doc_id", "line_no", "kind"])

    return _texts(docs).mapInPandas(run, "doc_id string, line_no int, kind string").distinct()


def repaired_texts(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(doc_id, text)`` of the documents that come from scans, in continuous readable paragraphs, once each."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(fit(docs, vocabulary)))

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = pickle.loads(model.value)
        for b in it:
            rows = [(i, repaired(t, m)) for i, t in zip(b["doc_id"], b["text"]) if scanned(t, m) is not None]
            yield pd.DataFrame(rows, columns=["doc_id", "text"])

    return _texts(docs).mapInPandas(run, "doc_id string, text string").dropDuplicates(["doc_id"])


def confusions(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(seen, printed, chance)``: what was learnt of the channel."""
    m = fit(docs, vocabulary)
    names = [*CONFUSIONS, ("a letter of the other case", "a letter"), ("any other letter", "a letter")]
    return docs.sparkSession.createDataFrame([(a, b, float(p)) for (a, b), p in zip(names, m.chances)], "seen string, printed string, chance double")
