"""Plain words of texts as they come from forums: markup, quotes, broken encoding and disguised letters undone."""

from __future__ import annotations

import html
import re
import unicodedata

# Letters of other scripts that look like Latin ones, and the letters they stand for.
_LOOKALIKE_FROM = "АВЕЅІЈКМНОРСТУХаеоріјѕсухкмнтвԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορνικτυγƖɑɡɩıłøØĸſ"
_LOOKALIKE_TO = "ABESIJKMHOPCTYXaeopijscyxkmhtbdqwhABEZHIKMNOPTYXaopviktuylaglilooks"
_LOOKALIKE = str.maketrans(_LOOKALIKE_FROM, _LOOKALIKE_TO)

_BLOCK_TAG = re.compile(r"</?(?:br|p|div|blockquote|li|ul|ol|tr|td|th|table|h[1-6]|hr|pre)\b[^<>]{0,300}>|\[/?(?:quote|list|code|\*|hr|center|indent)\b[^\[\]]{0,100}\]", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]{0,300}>|<!--.{0,2000}?-->|\[/?[a-zA-Z]{1,10}(?:=[^\[\]]{0,200})?\]", re.S)
_MOJIBAKE = re.compile("[ÂÃÄÅÐÑâð][\u0080-ÿŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_QUOTE_MARK = re.compile(r"^[ \t]*(?:[>|:»]+[ \t]?)+", re.M)
_APOSTROPHE = re.compile(r"(?<=\w)['’ʼ`´](?=\w)")
_WORD = re.compile(r"[a-z0-9]+")
# Vowel signs that are marks with a width, as in Devanagari: parts of a word. Scripts without spaces: each sign is a word.
MARKS = "".join(chr(c) for c in range(0x300, 0x12000) if unicodedata.category(chr(c)) == "Mc")
_SIGNS = "\u0e00-\u0eff\u3041-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ANY_WORD = re.compile(rf"[^\W_]" rf"(?<=[{_SIGNS}])|(?:(?![{_SIGNS}])(?:[^\W_]|[{MARKS}]))+")


def _repair(m: re.Match) -> str:
    s = m.group()
    for n in range(len(s), 1, -1):
        for codec in ("cp1252", "latin-1"):
            try:
                return s[:n].encode(codec).decode("utf-8") + s[n:]
            except (UnicodeEncodeError, UnicodeDecodeError):
                continue
    return s


def plain(text: str) -> str:
    """Markup, entities and broken encoding undone; compatible and look-alike letters as plain ones; nothing invisible."""
    if "&" in text:
        text = html.unescape(html.unescape(text))
    if "<" in text or "[" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub("\n", text))
    if text.isascii():
        return text
    text = unicodedata.normalize("NFKD", _MOJIBAKE.sub(_repair, text)).translate(_LOOKALIKE)
    return "".join(c for c in text if c.isascii() or unicodedata.category(c) not in ("Cf", "Mn", "Me", "Cc"))


def unquoted_marks(text: str) -> str:
    """The same text without the marks that begin quoted lines."""
    return _QUOTE_MARK.sub("", text)


def words(text: str | None) -> list[str]:
    """Lower-case words of letters and digits of any script, in order, quoted parts included."""
    if not text:
        return []
    own = _APOSTROPHE.sub("", plain(text)).casefold()
    return (_WORD if own.isascii() else _ANY_WORD).findall(own)
