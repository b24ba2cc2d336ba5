"""Layout of scanned pages: running headers, footers, page numbers, words carried over a line end."""

from __future__ import annotations

import difflib
import re
from collections import Counter
from collections.abc import Callable, Iterable

from inkstat.llm.lines import Kept

_ROMAN = r"[ivxlc]{1,8}"
_NUMBER = re.compile(
    rf"(?:\d{{1,4}}|{_ROMAN}|[–—-]\s?\d{{1,4}}\s?[–—-]|[Pp](?:age|p?\.)\s?\d{{1,4}}(?:\s(?:of|/)\s\d{{1,5}})?|\[\s?[Pp]p?\.\s?\d{{1,4}}\s?\]|\d{{1,4}}\s?/\s?\d{{1,5}})\Z"
)
_NAME = r"[^\W\d_a-z][^\W\d_]+"
_NAMES = re.compile(rf"{_NAME} and {_NAME}(?: / .{{3,}}| et al\.)?\Z")
_NUMBER_NAMES = re.compile(rf"(?:\d{{1,4}}\s{{2,}}{_NAME}(?: and {_NAME}| et al\.)|{_NAME}(?: and {_NAME}| et al\.)\s{{2,}}\d{{1,4}})\Z")
_JOURNAL = re.compile(r"(?:\d{1,4}\s?\|\s?\S.{3,60}\(\d{4}\)|\S.{3,60}\(\d{4}\)\s?\|\s?\d{1,4})\Z")
_HEADING = re.compile(r"\d{1,2}(?:\.\d{1,2}){0,3}\.?\s+[^\W\d_]")
HYPHENS = "-¬­‐‑"
_PAGE_NUMBER = re.compile(r"\s{2,}\d{1,4}\Z|\A\d{1,4}\s{2,}")
_CLAUSE_END = re.compile(r"[.!?,;]\s*\Z")
_WORD_GAP = re.compile(r"[\s/]+")
_LOOKS_L, _LOOKS_0 = re.compile(r"(?<![^\s/-])l(?=[b-df-hj-np-tv-xz][a-z]|n\b)"), re.compile(r"(?<![^\s/-])0(?=[a-z])")
_UPPER, _LOWER = Kept(str.isupper), Kept(str.islower)
_LETTERS, _LAST_LETTERS = re.compile(r"[^\W_]+"), re.compile(r"[^\W_]*\Z")
_CONJUNCTIONS = {"and", "or", "und", "oder", "et", "ou", "y", "o"}
_NUMBERED = re.compile(r"\d{1,4}\s{2,}.*")
_SPLIT = re.compile(rf"[^\W_][{HYPHENS}]\s*\Z")


def _caps(s: str) -> bool:
    """A line set in capitals, with or without a page number after a gap."""
    t = _PAGE_NUMBER.sub("", s)
    upper, lower = len(t.translate(_UPPER)), len(t.translate(_LOWER))
    return upper + lower >= 8 and upper >= 0.85 * (upper + lower) and len(t.split()) >= 2


def _title_case(s: str) -> bool:
    """Every word begins with a capital (or digit), as in the title at the head of a page."""
    t = _PAGE_NUMBER.sub("", s)
    if _CLAUSE_END.search(t):
        return False
    ws = [w for w in _WORD_GAP.split(t) if any(map(str.isalpha, w))]
    if len(ws) < 3:
        return False
    low = sum(not (w.lstrip("(\"'")[:1].isupper() or w[:1].isdigit()) for w in ws)
    return low <= (1 if len(ws) >= 5 else 0) and sum(len(w) > 3 for w in ws) >= (2 if len(ws) < 4 else 1)


def _key(s: str) -> str:
    return re.sub(r"\d+", "0", "".join(c for c in s.casefold() if c.isalnum()))


def _firm(s: str) -> bool:
    """Whether a line has the form of a page number, or of a header or footer with one."""
    if not s or len(s) > 120 or _HEADING.match(s) and not _NUMBERED.fullmatch(s):
        return False
    if _NUMBER.match(s) and s not in ("l", "c") or s in ("i", "v", "x"):
        return True
    return bool(_NUMBER_NAMES.match(s) or _JOURNAL.match(s) or (_PAGE_NUMBER.search(s) and _caps(s)))


def furniture(lines: list[str]) -> list[bool]:
    """Which lines are running headers, footers or page numbers.

    Page numbers go by their form; names, titles in capitals or title case and journal lines by form too if they stand
    beside a page number, at either end of the text, carry a number themselves, or come again (nearly) alike.
    """
    out = [False] * len(lines)
    # a capital O or I at the head of a word is often misread
    text = [_LOOKS_L.sub("I", _LOOKS_0.sub("O", x.strip())) for x in lines]
    weak: dict[int, str] = {}
    for i, s in enumerate(text):
        if not s or len(s) > 120:
            continue
        if _HEADING.match(s) and not _NUMBERED.fullmatch(s):
            continue
        if _firm(s):
            out[i] = True
        elif _NAMES.match(s) or _caps(s) or _title_case(s):
            weak[i] = _key(s)
    firm = list(out)

    def near(i: int, step: int) -> int | None:
        j = i + step
        while 0 <= j < len(text) and not text[j]:
            j += step
        return j if 0 <= j < len(text) else None

    alike = _Alike(weak.values())
    for i, k in weak.items():
        a, b = near(i, -1), near(i, 1)
        beside = any(j is not None and firm[j] for j in (a, b))
        edge = a is None or b is None
        if beside or alike.again(k, 0.8) or (edge and (_caps(text[i]) or "/" in text[i] or _title_case(text[i]) or _NAMES.match(text[i]))):
            out[i] = True
    keys = _Alike(k for i in range(len(text)) if out[i] and len(k := _key(text[i])) >= 8)
    for i, s in enumerate(text):  # a misread copy of a header
        if s and not out[i] and len(s) <= 120 and not ENDS_STOP.search(s):
            k = _key(s)
            out[i] = len(k) >= 8 and keys.near(k, 0.85, 2)
    return out


class _Alike:
    """Keys of lines, found by nearly equal ones: two keys are compared if they begin alike, end alike, or have equal
    middles, so that a long text's lines do not all meet."""

    def __init__(self, keys: Iterable[str]):
        self.count = Counter(keys)
        self.blocks: dict[tuple[int, str], set[str]] = {}
        for k in self.count:
            for b in self._blocks(k):
                self.blocks.setdefault(b, set()).add(k)

    @staticmethod
    def _blocks(k: str) -> set[tuple[int, str]]:
        m = len(k) // 2
        return {(0, k[:4]), (1, k[-4:]), *((2, k[j : j + 4]) for j in range(max(0, m - 3), m + 2))}

    def _others(self, k: str) -> set[str]:
        return {o for b in self._blocks(k) for o in self.blocks.get(b, ())} - {k}

    def again(self, k: str, ratio: float) -> bool:
        """Whether a key of the collection comes again in it, or nearly."""
        return self.count[k] > 1 or any(_ratio(k, o) > ratio for o in self._others(k))

    def near(self, k: str, ratio: float, length: int) -> bool:
        return k in self.count or any(abs(len(k) - len(o)) <= length and _ratio(k, o) > ratio for o in self._others(k))


def _ratio(a: str, b: str) -> float:
    m = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return m.ratio() if m.quick_ratio() > 0.8 else 0.0


def page_marks(lines: list[str]) -> list[bool]:
    """Which lines have the form of a page number, or of a header or footer with one."""
    return [_firm(_LOOKS_L.sub("I", _LOOKS_0.sub("O", x.strip()))) for x in lines]


ENDS_STOP = re.compile(r"[.!?,;:]\s*\Z")


def next_content(lines: list[str], out: list[bool], i: int) -> int | None:
    """The next line that is neither furniture nor empty."""
    j = i + 1
    while j < len(lines) and (out[j] or not lines[j].strip()):
        j += 1
    return j if j < len(lines) else None


def carried(lines: list[str], out: list[bool], known: Callable[[str], bool] = lambda w: False) -> list[bool]:
    """Which lines end in a hyphen whose word goes on in the next line that is not furniture. Before a conjunction a hyphen
    stands for a part left out (two- or threefold), unless the parts together are a ``known`` word (detect-or)."""
    got = [False] * len(lines)
    for i, s in enumerate(lines):
        if out[i] or not _SPLIT.search(s):
            continue
        j = next_content(lines, out, i)
        if j is None:
            continue
        m = _LETTERS.match(lines[j].lstrip())
        if m and m.group() in _CONJUNCTIONS:
            got[i] = known(_LAST_LETTERS.search(s.rstrip().rstrip(HYPHENS)).group() + m.group())
        else:
            got[i] = bool(m)
    return got


def wrapped(lines: list[str]) -> bool:
    """Whether a text is set in lines of a bounded width, as on a page."""
    full = [len(x.rstrip()) for x in lines if x.strip()]
    if len(full) < 3:
        return False
    return max(full) <= 130 and sum(n > 0.6 * max(full) for n in full) >= 0.5 * len(full)
