"""Words of a text in any script."""

from __future__ import annotations

import re

from inkstat.llm.chars import skeleton

# Han, kana and Thai (a consonant or vowel sign with the marks on it) by character; else runs of letters, marks, digits.
_MARK = "̀-ͯऀ-ःऺ-ॏॕ-ॗॢॣً-ٰٟۖ-ۭ"
WORD = re.compile(
    "[々〇぀-ヿ㐀-鿿豈-﫿]"
    "|[ก-ะาำเ-ๆ๐-๙][ัิ-ฺ็-๎]*"
    f"|(?:(?![々〇぀-ヿ㐀-鿿豈-﫿฀-๿_])[\\w{_MARK}])+"
)


def words(text: str) -> list[str]:
    """Case-folded words of the skeleton of a text; spacing, punctuation, look-alikes do not matter."""
    return WORD.findall(skeleton(text).casefold())
