"""Characters that look alike or are not seen: the skeleton and its parts."""

from __future__ import annotations

import re
import unicodedata

# Characters of other scripts and signs that are drawn like the ASCII one beside them.
# After the tables of Unicode Technical Standard 39, restricted to letters and hyphens of identical shape.
LOOKALIKE = {
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ү": "y",
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P",
    "Ѕ": "S", "Т": "T", "Х": "X", "Ү": "Y", "Ԍ": "G", "Ԛ": "Q", "Ԝ": "W", "Ѵ": "V",
    "ο": "o", "ν": "v", "ρ": "p", "ι": "i", "α": "a", "υ": "u", "γ": "y", "κ": "k", "χ": "x",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P",
    "Τ": "T", "Υ": "Y", "Χ": "X",
    "ı": "i", "ȷ": "j", "ɡ": "g", "ɑ": "a", "ʋ": "v", "օ": "o", "ս": "u", "հ": "h", "ո": "n",
    "‐": "-", "‑": "-", "⁃": "-", "﹣": "-",
    "ˈ": "'", "＇": "'", "∶": ":", "ː": ":", "․": ".", "⁄": "/", "∕": "/",
}

#: Kinds of compatibility decomposition that leave the look of a character unchanged. Superscripts, subscripts,
#: circles, fractions and squares are seen, so they stay.
SAME_LOOK = {"<wide>", "<narrow>", "<noBreak>", "<compat>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
LINE_ENDS = re.compile("\r\n|[\r\x0b\x0c\x85\u2028\u2029]")
SPACE_AT_END = re.compile(r" +(?=\n|\Z)")


def unseen(ch: str) -> bool:
    """Whether a character leaves no mark and no room on the page."""
    o = ord(ch)
    return (
        unicodedata.category(ch) == "Cf" and not 0x0600 <= o <= 0x0605 and o not in (0x06DD, 0x070F, 0x08E2)
    ) or o == 0x034F or 0xFE00 <= o <= 0xFE0F or o in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x180B, 0x180C, 0x180D)


def unfold(ch: str) -> str:
    """Decompose one character as far as its look stays the same."""
    d = unicodedata.decomposition(ch)
    if not d:
        return ch
    parts = d.split()
    if parts[0][0] == "<":
        if parts[0] not in SAME_LOOK:
            return ch
        parts = parts[1:]
    return "".join(unfold(chr(int(p, 16))) for p in parts)


def prototype(ch: str) -> str:
    """What stands for a decomposed character in a skeleton."""
    if unseen(ch):
        return ""
    if ch == "\n" or ch == "\t":
        return ch
    if unicodedata.category(ch) == "Zs":
        return " "
    return "".join(LOOKALIKE.get(c, "" if unseen(c) else " " if unicodedata.category(c) == "Zs" else c) for c in unfold(ch))


class _Prototypes(dict):
    def __missing__(self, o: int) -> str:
        self[o] = p = prototype(chr(o))
        return p


_PROTOTYPES = _Prototypes()


def skeleton(text: str | None) -> str:
    """Decompose, put the prototype for every character, decompose again.

    A null reads as the empty string. Runs of spaces keep their length, spaces before a line end go (they are
    not seen), line ends become one kind.
    """
    if not text:
        return ""
    if not text.isascii():
        text = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(_PROTOTYPES))
    return SPACE_AT_END.sub("", LINE_ENDS.sub("\n", text))


_CYRILLIC_OF = {"a": "а", "c": "с", "e": "е", "i": "і", "j": "ј", "o": "о", "p": "р", "s": "ѕ", "x": "х", "y": "у",
                "A": "А", "B": "В", "C": "С", "E": "Е", "H": "Н", "I": "І", "J": "Ј", "K": "К", "M": "М", "O": "О",
                "P": "Р", "S": "Ѕ", "T": "Т", "X": "Х"}
_GREEK_OF = {"a": "α", "i": "ι", "k": "κ", "o": "ο", "p": "ρ", "u": "υ", "v": "ν", "x": "χ", "y": "γ",
             "A": "Α", "B": "Β", "E": "Ε", "H": "Η", "I": "Ι", "K": "Κ", "M": "Μ", "N": "Ν", "O": "Ο", "P": "Ρ",
             "T": "Τ", "X": "Χ", "Y": "Υ", "Z": "Ζ"}
# Words with a Cyrillic or Greek letter; all others are of one script.
_WORD = re.compile("(?:(?![Ͱ-ϿЀ-ԯ])[^\\W\\d_])*[Ͱ-ϿЀ-ԯ][^\\W\\d_]*")
_SHARED_CYR = set("асеіјорѕхуАВСЕНІЈКМОРЅТХ")
_SHARED_GRK = set("οιρναυγκχΑΒΕΖΗΙΚΜΝΟΡΤΥΧ")


def _script(c: str) -> str:
    o = ord(c)
    return "c" if 0x400 <= o < 0x530 else "g" if 0x370 <= o < 0x400 else "l"


def _one_script(m: re.Match) -> str:
    """Put a word of mixed scripts into the script of its letters that have no twin elsewhere."""
    w = m.group()
    kinds = {_script(c) for c in w}
    if len(kinds) == 1 and (kinds == {"l"} or any(c not in _SHARED_CYR and c not in _SHARED_GRK for c in w)):
        return w
    own_c = sum(_script(c) == "c" and c not in _SHARED_CYR for c in w)
    own_g = sum(_script(c) == "g" and c not in _SHARED_GRK for c in w)
    own_l = sum(_script(c) == "l" and c not in _CYRILLIC_OF and c not in _GREEK_OF for c in w)
    if own_c > max(own_g, own_l):
        return "".join(_CYRILLIC_OF.get(c, c) for c in w)
    if own_g > max(own_c, own_l):
        return "".join(_GREEK_OF.get(c, c) for c in w)
    if kinds == {"c"} or kinds == {"g"}:
        return w
    return "".join(LOOKALIKE.get(c, c) for c in w)


class _Visible(dict):
    def __missing__(self, o: int) -> str:
        ch = chr(o)
        if unseen(ch):
            r = ""
        elif ch not in "\n\t" and unicodedata.category(ch) == "Zs":
            r = " "
        elif ch in "‐‑":
            r = "-"
        else:
            r = unfold(ch)
        self[o] = r
        return r


_VISIBLE = _Visible()


def consistent(text: str | None) -> str | None:
    """Readable consistent form: composed characters, ordinary spaces and letters, nothing unseen, each word in
    one script. A null stays null."""
    if text is None:
        return None
    if text.isascii():
        return SPACE_AT_END.sub("", LINE_ENDS.sub("\n", text))
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(_VISIBLE))
    return SPACE_AT_END.sub("", LINE_ENDS.sub("\n", _WORD.sub(_one_script, text)))


def visible_with_offsets(text: str) -> tuple[str, list[int]]:
    """The text without unseen characters and with ordinary spaces, and for each of its characters the place in
    the original. One character stands for one: nothing is decomposed, full-width letters and digits become narrow,
    and words of mixed scripts get one script."""
    if text.isascii():
        return text, list(range(len(text)))
    out, at = [], []
    for i, c in enumerate(text):
        if c == "\n" or c.isascii():
            out.append(c)
            at.append(i)
        elif unseen(c):
            continue
        else:
            o = ord(c)
            wide = 0xFF10 <= o <= 0xFF19 or 0xFF21 <= o <= 0xFF3A or 0xFF41 <= o <= 0xFF5A
            out.append(" " if c.isspace() else chr(o - 0xFEE0) if wide else c)
            at.append(i)
    return _WORD.sub(_one_script, "".join(out)), at
