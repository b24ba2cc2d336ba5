"""What a line of text is: prose, or an entry of a list, a table, a record and the like."""

from __future__ import annotations

import re
from collections.abc import Callable

STOPS = ".!?。！？।؟…"
CLOSERS = "\"'”’»)」』］】）]›“"
_MARKS = re.escape(CLOSERS)
ENDS = re.compile(rf"[{re.escape(STOPS)}][{_MARKS}\s]*\Z")

_BULLET = re.compile(r"\s*(?:[*•‣▪◦·–—+»>→o-]\s+\S|\(?(?:\d{1,3}|[a-z]|[ivx]{1,5})[.):]\s+\S)")
_LEADER = re.compile(r"(?:\.\s?){4,}\s*\d+\s*\Z|\s\.{3,}\s*\d+\s*\Z")
_RECORD = re.compile(r"\s*[^\s:：.!?][^:：.!?]{0,48}[:：]\s*(?:[-+]?\d[\d.,]*(?:\s*±\s*[\d.,]+)?\s*[^\s.]{0,12}(?:\s?[^\s.]{1,6})?|\S+(?:\s\S+){0,3})\s*\Z")
_NUMBER_RECORD = re.compile(r"\s*[^\s:：.!?][^:：.!?]{0,48}[:：]\s*[-+]?\d[\d.,]*(?:\s*±\s*[\d.,]+)?\s*\S{0,12}\s*\Z")
_LOG = re.compile(r"\w+\s*=\s*[-+]?\d[\d.]*\s*;|->\s*\w+\s*\Z|\A\s*[\w.]+\s*=\s*\S+\s*\Z")
_MENU = re.compile(r"\S\s+[>›»|/]\s+\S")
_REFERENCE = re.compile(r"\b\d+\s*\(\d{4}\)\s*\d+|\(\d{4}\)\.?\s*\Z|\A\s*\[\d+\]\s+\w|\bdoi:\s?10\.|, \d{4}, \d+")
_MATH = re.compile(r"[=≈≥≤≠∂∑∫√×÷±→∇∞^<>]|\s[-−+/*]\s")
_MOJIBAKE = re.compile(r"[ÃÂâÐÑ][\u0080-¿‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ¢€¤]")
_WORDLIKE = re.compile(r"[^\W\d_]{2,}")
_COLUMNS = re.compile(r"\S(?:\t+|\s{3,})\S")
_GAP = re.compile(r"\t|\s\s\s")
_MIXED = re.compile(r"[A-Za-z]\d|\d[A-Za-z]")
_BAR = re.compile(r"[|:\-+=\s]{3,}")
_FIELDS = re.compile(r"[;\t]")
_DIGIT = re.compile(r"\d")
_CSV = re.compile(r"\S{0,24}(?:,[-+]?\d[\d.]*){3,}")
_MENU_GAP = re.compile(r"\s[>›»|/]\s")
_COMMAS = re.compile(r",\s+|، |、|，|;\s+")
KIND_KEYWORDS = re.compile(r"\s*[^\W\d_][\w\s-]{2,30}\s?[:：]\s*[^.!?。]+\Z")


class Kept(dict):
    """For ``str.translate``: keeps the characters of which ``test`` holds, decided once each."""

    def __init__(self, test: Callable[[str], bool]):
        super().__init__()
        self.test = test

    def __missing__(self, o: int) -> int | None:
        self[o] = r = o if self.test(chr(o)) else None
        return r


def _combining(c: str) -> bool:
    return 0x300 <= ord(c) < 0x370 or 0x900 <= ord(c) < 0xE80


_PUNCTUATION = ".,;:'\"()-–—„“”«»‚‘’!?%/±。，、；：（）「」…·।"
_ODD = Kept(lambda c: not c.isspace() and not c.isalnum() and c not in _PUNCTUATION and not _combining(c))
#: Symbols and digits of a text.
SIGNS = Kept(lambda c: c.isdigit() or not (c.isalnum() or c.isspace() or _combining(c)))


def junk(s: str) -> bool:
    """Mostly signs and digits among letters, as in damaged or encoded data."""
    t = len("".join(s.split()))
    if t < 8:
        return False
    odd = len(s.translate(_ODD))
    if odd / t > 0.18:
        return True
    if not s.isascii() and len(_MOJIBAKE.findall(s)) * 2 / t > 0.04:
        return True
    return odd / t > 0.05 and len(_MIXED.findall(s)) / t > 0.15


def kind(line: str) -> str:
    """blank, bullet, contents, table, record, log, menu, reference, formula, keywords, junk, or prose."""
    s = line.strip()
    if not s:
        return "blank"
    stop = bool(ENDS.search(s))
    if s[-1].isdigit() and _LEADER.search(s):
        return "contents"
    if s.count("|") >= 2 or _BAR.fullmatch(s):
        return "table"
    if s.count("\t") >= 2 or _GAP.search(line) and len(_COLUMNS.findall(line.rstrip())) >= 2:
        return "table"
    fields = _FIELDS.split(s)
    if len(fields) >= 3 and sum(bool(_DIGIT.search(f)) and len(f.split()) <= 2 for f in fields) >= len(fields) - 1:
        return "table"
    if s.count(",") >= 3 and _CSV.fullmatch(s):
        return "table"
    if ("=" in s or "->" in s) and _LOG.search(s):
        return "log"
    if junk(s):
        return "junk" if len(_MATH.findall(s)) < 3 or len(s.split()) < 5 else "formula"
    if not stop and _MENU.search(s) and all(len(p.split()) <= 4 for p in _MENU_GAP.split(s)):
        return "menu"
    toks = s.split()
    if len(_MATH.findall(s)) >= 3 and sum(len(w) > 3 and w.isalpha() for w in toks) < len(toks) * 0.3:
        return "formula"
    if s.count(",") >= 2 and _REFERENCE.search(s):
        return "reference"
    if _BULLET.match(line) and len(toks) <= 14 and not (stop and len(toks) > 9):
        return "bullet"
    if _NUMBER_RECORD.match(s) and len(toks) <= 8:
        return "record"
    commas = [] if stop else _COMMAS.split(s.rstrip(",;"))
    if len(commas) >= 4 and sum(len(p.split()) for p in commas) / len(commas) <= 2.2:
        return "keywords"
    return "prose"
