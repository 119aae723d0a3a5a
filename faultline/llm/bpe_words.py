"""Pre-tokens of the lower-casing word BPE vocabulary, as its library forms them.

White space always ends a pre-token, so a text's result is the sum (or concatenation) of those of its blank-separated
chunks, which repeat and are worth remembering.  That holds for plain texts: Latin letters and ASCII without the four
separators that Python but not the library counts as blanks, and without the special strings.  Every other text takes the
library's own normaliser and pre-tokeniser.
"""

from __future__ import annotations

import re
import sys
import unicodedata

#: Up to here no character combines, changes under NFC or differs between versions of Unicode.
LAST_PLAIN = 0x24F
_CODES = range(LAST_PLAIN + 1)
_LETTERS = "".join(re.escape(chr(i)) for i in _CODES if unicodedata.category(chr(i))[0] == "L")
_NUMBERS = "".join(re.escape(chr(i)) for i in _CODES if unicodedata.category(chr(i))[0] == "N")
_BLANKS = "\\t-\\r \x85\xa0"
#: The pre-tokeniser's pattern with its classes written out.
PRE_TOKENS = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^{_BLANKS}{_LETTERS}{_NUMBERS}]+").findall
_ODD = re.compile(f"[^\t-\r -{chr(LAST_PLAIN)}]").search


def is_plain(text: str, specials: list[str]) -> bool:
    return _ODD(text) is None and not any(s in text for s in specials)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in out:
            out[b] = chr(256 + len(out) - len(shown))
    return [sys.intern(out[b]) for b in range(256)]
