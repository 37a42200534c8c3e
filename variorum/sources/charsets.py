"""A1: the character set of a text without a label.

A set is possible if all bytes are valid in it. Of several the likeliest is that in which most characters are frequent
ones: national sets keep those in rows of their own, apart from rare ones, so the tables follow from the rows.
"""

from __future__ import annotations

import codecs
from collections import Counter

#: Rows (first to last lead byte, ranges of trail bytes) of frequent characters in each national set.
ROWS = {
    "gb18030": (0xB0, 0xD7, [(0xA1, 0xFE)]),
    "big5": (0xA4, 0xC6, [(0x40, 0x7E), (0xA1, 0xFE)]),
    "shift_jis": (0x88, 0x97, [(0x40, 0x7E), (0x80, 0xFC)]),
    "euc_jp": (0xB0, 0xCF, [(0xA1, 0xFE)]),
}
MARKS = {codecs.BOM_UTF8: "utf-8-sig", codecs.BOM_UTF16_LE: "utf-16", codecs.BOM_UTF16_BE: "utf-16"}
#: Shared by all: marks of East Asian texts and wide forms. Kana stand in Chinese sets too, but hardly in Chinese texts.
SHARED = [(0x3000, 0x303F), (0xFF01, 0xFF5E), (0x2014, 0x2026)]
KANA = range(0x3041, 0x30FF)


def _frequent(charset: str) -> frozenset[str]:
    first, last, trails = ROWS[charset]
    pairs = (bytes([h, t]).decode(charset, "ignore") for h in range(first, last + 1) for a, b in trails for t in range(a, b + 1))
    return frozenset(c for c in pairs if len(c) == 1 and c > "　")


_SHARED = frozenset(chr(c) for a, b in SHARED for c in range(a, b + 1))
_KANA = frozenset(map(chr, KANA))
FREQUENT = {c: _frequent(c) | _SHARED | (_KANA if c.endswith("jis") or c.endswith("jp") else frozenset()) for c in ROWS}
_ANY = frozenset().union(*FREQUENT.values()) | {chr(c) for c in (9, 10, 13, *range(32, 127))}


def score(text: str, charset: str) -> float:
    """The share of frequent characters in what is not ASCII; in the wide Unicode forms ASCII counts too, since there it tells them apart."""
    wide = charset.startswith("utf-16")
    n = Counter(text)
    good = _ANY if wide else FREQUENT[charset]
    seen = {c: k for c, k in n.items() if wide or ord(c) > 127}
    return sum(k for c, k in seen.items() if c in good) / max(1, sum(seen.values()))


def detect(data: bytes) -> tuple[str, str] | None:
    """Charset and text: what a byte order mark says; else UTF-8 where it is valid and has no NUL; else the best score among those that are valid, of equal ones the first in the order of ROWS, then UTF-16. None where nothing is valid."""
    for mark, charset in MARKS.items():
        if data.startswith(mark):
            try:
                return charset, data.decode(charset)
            except UnicodeDecodeError:
                break
    if b"\0" not in data:
        try:
            return "utf-8", data.decode("utf-8")
        except UnicodeDecodeError:
            pass
    found = []
    for charset in (*ROWS, "utf-16-le", "utf-16-be"):
        try:
            text = data.decode(charset)
        except UnicodeDecodeError:
            continue
        found.append((score(text, charset), charset, text))
    best = max(found, key=lambda x: x[0], default=None)
    return best and best[1:]
