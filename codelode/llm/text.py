"""Text helpers of the training-data operators: plain functions on strings, used inside Arrow batches."""

from __future__ import annotations

import html
import re

#: What stands for a letter, sign or line break in escaped texts.
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-fA-F]{1,6}|[A-Za-z]{2,10});")
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|[nrt\"'`])")
_PLAIN = {"\\n": "\n", "\\r": "\n", "\\t": " ", '\\"': '"', "\\'": "'", "\\`": "`"}


def _unescape(m: re.Match) -> str:
    found = m.group()
    plain = _PLAIN.get(found)
    return plain if plain is not None else chr(int(found[2:], 16))


def unescaped(text: str) -> str:
    """Entities and backslash escapes turned back into what they stand for."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    return _ESCAPE.sub(_unescape, text) if "\\" in text else text
