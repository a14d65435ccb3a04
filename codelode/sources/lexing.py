"""Lexers for Rust, TypeScript and JavaScript: one pass of a compiled pattern per file, brackets matched on the way.

Python sources use the standard library's own tokenizer and parser.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Unlexable(ValueError):
    """The text is no token sequence of the language, or its brackets don't match. ``at`` is the place."""

    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


class Tokens(NamedTuple):
    """Parallel lists. ``kind``: the text itself for words of the language and signs, else one of i (identifier), n (number), s (string), r (regular expression),
    c (character), l (lifetime), t (template), t( t, t) (parts of a template), and a last one that is empty. ``newline``: a line break stands before. ``match``: the partner of a bracket."""

    kind: list[str]
    text: list[str]
    start: list[int]
    newline: list[bool]
    match: dict[int, int]
    comments: list[tuple[int, int]]


# Reserved words and signs of the languages.
JS_WORDS = frozenset(
    """break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw
true try typeof var void while with""".split()
)
RUST_WORDS = frozenset(
    """as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while
async await dyn""".split()
)
_JS_SIGNS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ++ -- += -= *= /= %= &= |= ^= << >> ** ?. { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #".split()
_RUST_SIGNS = "<<= >>= ... ..= :: -> => == != <= >= && || += -= *= /= %= ^= &= |= << >> .. + - * / % ^ ! & | = < > @ . , ; : # $ ? ~ { } ( ) [ ]".split()
CLOSING = {")": "(", "]": "[", "}": "{"}


def _signs(signs: list[str]) -> str:
    return "|".join(re.escape(s) for s in signs)


_JS = re.compile(
    r"""(?P<w>[ \t\r\n\f\v\u00a0\ufeff\u2028\u2029]+)|(?P<i>(?:[A-Za-z_$]|[^\W\d_]|\\u[0-9a-fA-F]{4})(?:[\w$\u200c\u200d]|\\u[0-9a-fA-F]{4})*)|(?P<k>//[^\n\u2028\u2029]*|/\*(?s:.*?)\*/)"""
    r"""|(?P<n>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d[\d_]*)?|\d[\d_]*\.?(?:[eE][+-]?\d[\d_]*)?)n?(?![\w$]))"""
    r"""|(?P<s>"(?:[^"\\\n\r]|\\(?:\r\n|(?s:.)))*"|'(?:[^'\\\n\r]|\\(?:\r\n|(?s:.)))*')|(?P<t>`)|(?P<p>"""
    + _signs(_JS_SIGNS).replace(r"\?\.", r"\?\.(?!\d)")
    + ")"
)
_JS_REGEX = re.compile(r"/(?![*/])(?:[^\\/\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:[^`\\$]|\\(?s:.)|\$(?!\{))*(`|\$\{)")
_RUST = re.compile(
    r"""(?P<w>\s+)|(?P<k>//[^\n]*)|(?P<b>/\*)"""
    r"""|(?P<s>(?:b|c)?"(?:[^"\\]|\\(?s:.))*"|(?:br|cr|r)(?P<h>\#*)"(?s:.*?)"(?P=h))|(?P<c>b?'(?:[^'\\\n\r\t]|\\(?:[nrt0'"\\]|x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]{1,8}\}))')"""
    r"""|(?P<l>'[^\W\d]\w*(?!'))|(?P<n>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.(?![.\w])|(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?))(?:[iuf](?:8|16|32|64|128|size))?(?!\w))"""
    r"""|(?P<i>(?:r\#)?(?:[^\W\d])\w*)|(?P<p>"""
    + _signs(_RUST_SIGNS)
    + ")"
)
_RUST_COMMENT = re.compile(r"/\*|\*/")
#: After one of these a slash divides; elsewhere it begins a regular expression.
_ENDS_VALUE = frozenset(["i", "n", "s", "r", "t", "t)", ")", "]", "this", "super", "null", "true", "false", "++", "--"])


def js_tokens(source: str, broken: list[Unlexable] | None = None) -> Tokens:
    """Tokens of a script or module, TypeScript included. With ``broken`` a text that breaks off gives the tokens so far, open brackets closed at the end, and its error in that list."""
    kinds: list[str] = []
    texts: list[str] = []
    starts: list[int] = []
    breaks: list[bool] = []
    match: dict[int, int] = {}
    comments: list[tuple[int, int]] = []
    open_: list[int] = []
    at, end = 0, len(source)
    newline = False
    scan = _JS.match
    words = JS_WORDS
    if source.startswith("#!"):
        at = source.find("\n")
        at = end if at < 0 else at
    try:
        while at < end:
            m = scan(source, at)
            if m is None:
                raise Unlexable("unexpected character", at)
            group = m.lastgroup
            if group == "w":
                newline = newline or "\n" in m.group()
                at = m.end()
                continue
            text = m.group()
            if group == "i":
                kind = text if text in words else "i"
            elif group == "p":
                kind = text
                if text == "/" or text == "/=":
                    before = kinds[-1] if kinds else ""
                    if before not in _ENDS_VALUE:
                        m = _JS_REGEX.match(source, at)
                        if m is None:
                            raise Unlexable("unterminated regular expression", at)
                        text, kind = m.group(), "r"
                elif text in "([{":
                    open_.append(len(kinds))
                elif text in CLOSING:
                    if not open_:
                        raise Unlexable("unexpected " + text, at)
                    partner = open_.pop()
                    if kinds[partner] in ("t(", "t,"):
                        if text != "}":
                            raise Unlexable("unexpected " + text, at)
                        m = _TEMPLATE.match(source, at + 1)
                        if m is None:
                            raise Unlexable("unterminated template", at)
                        if m.group(1) == "`":
                            kind = "t)"
                        else:
                            kind = "t,"
                            open_.append(len(kinds))
                    elif kinds[partner] != CLOSING[text]:
                        raise Unlexable("unexpected " + text, at)
                    else:
                        match[partner] = len(kinds)
                        match[len(kinds)] = partner
            elif group == "n" or group == "s":
                kind = group
            elif group == "k":
                comments.append((at, m.end()))
                newline = newline or text.startswith("//") or "\n" in text
                at = m.end()
                continue
            else:
                m = _TEMPLATE.match(source, at + 1)
                if m is None:
                    raise Unlexable("unterminated template", at)
                kind = "t"
                if m.group(1) != "`":
                    kind = "t("
                    open_.append(len(kinds))
            kinds.append(kind)
            texts.append(text)
            starts.append(at)
            breaks.append(newline)
            newline = False
            at = m.end()
    except Unlexable as error:
        if broken is None:
            raise
        broken.append(error)
    if open_ and broken is None:
        raise Unlexable("never closed " + kinds[open_[-1]], starts[open_[-1]])
    if open_ and not broken:
        broken.append(Unlexable("never closed " + kinds[open_[-1]], starts[open_[-1]]))
    for k in open_:
        match[k] = len(kinds)
    kinds.append("")
    texts.append("")
    starts.append(end)
    breaks.append(True)
    return Tokens(kinds, texts, starts, breaks, match, comments)


def rust_tokens(source: str, broken: list[Unlexable] | None = None) -> Tokens:
    """Tokens of a Rust file; ``broken`` as in ``js_tokens``."""
    kinds: list[str] = []
    texts: list[str] = []
    starts: list[int] = []
    match: dict[int, int] = {}
    comments: list[tuple[int, int]] = []
    open_: list[int] = []
    at, end = 0, len(source)
    scan = _RUST.match
    words = RUST_WORDS
    if source.startswith("#!") and not source[2:].lstrip().startswith("["):
        at = source.find("\n")
        at = end if at < 0 else at
    try:
        while at < end:
            m = scan(source, at)
            if m is None:
                raise Unlexable("unexpected character", at)
            group = m.lastgroup
            if group == "w":
                at = m.end()
                continue
            text = m.group()
            if group == "i":
                kind = text if text in words else "i"
            elif group == "p":
                kind = text
                if text in "([{":
                    open_.append(len(kinds))
                elif text in CLOSING:
                    if not open_ or kinds[open_[-1]] != CLOSING[text]:
                        raise Unlexable("unexpected " + text, at)
                    partner = open_.pop()
                    match[partner] = len(kinds)
                    match[len(kinds)] = partner
            elif group == "k":
                comments.append((at, m.end()))
                at = m.end()
                continue
            elif group == "b":
                depth, place = 1, at + 2
                while depth:
                    c = _RUST_COMMENT.search(source, place)
                    if c is None:
                        raise Unlexable("unterminated comment", at)
                    depth += 1 if c.group() == "/*" else -1
                    place = c.end()
                comments.append((at, place))
                at = place
                continue
            else:
                kind = "s" if group == "h" else group
            kinds.append(kind)
            texts.append(text)
            starts.append(at)
            at = m.end()
    except Unlexable as error:
        if broken is None:
            raise
        broken.append(error)
    if open_ and broken is None:
        raise Unlexable("never closed " + kinds[open_[-1]], starts[open_[-1]])
    if open_ and not broken:
        broken.append(Unlexable("never closed " + kinds[open_[-1]], starts[open_[-1]]))
    for k in open_:
        match[k] = len(kinds)
    kinds.append("")
    texts.append("")
    starts.append(end)
    return Tokens(kinds, texts, starts, [], match, comments)
