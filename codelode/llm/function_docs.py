"""Functions paired with their documentation.

A string- and comment-aware scanner finds functions and methods in a source text, matches braces (or indentation) to delimit them and attaches the
documentation comment that stands immediately before them (in Python the string that opens the body). The pairs are those of the scanner; the file's parse record names
them (qualified name, signature) and can only take away what it knows to be undocumented. Pairs whose documentation tells nothing beyond the name are dropped.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codelode.common import current_records
from codelode.sources.grammar import language_of

_BRACE_SCAN = {
    "Rust": re.compile(
        r"(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<string>b?\"(?:[^\"\\]|\\(?s:.))*(?:\"|\Z)|b?r(?P<h>#*)\"(?s:.*?)(?:\"(?P=h)|\Z)|'(?:[^'\\\n]|\\[^\n]{1,8}?)')|(?P<def>\bfn\s+(?P<name>\w+))|(?P<p>[(){};\[\]])"
    ),
    "TypeScript": re.compile(
        r"(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\(?s:.))*(?:\"|$)|'(?:[^'\\\n]|\\(?s:.))*(?:'|$)|`(?:[^`\\]|\\(?s:.))*(?:`|\Z))"
        r"|(?P<def>\bfunction\s*\*?\s*(?P<name>[\w$]+)\s*(?=[(<])|(?:^|(?<=[;{}]))[ \t]*(?:(?:public|private|protected|static|async|get|set|override|abstract|readonly)[ \t]+)*\*?(?P<method>#?[\w$]+)[ \t]*(?:<[^>\n(]*>)?(?=\()"
        r"|\b(?:const|let|var)\s+(?P<bound>[\w$]+)\s*(?::[^=\n]*)?=\s*(?:async\s+)?(?=function\b|\([^()\n]*\)\s*(?::[^=\n]*)?=>|[\w$]+\s*=>))|(?P<p>[(){};\[\]])",
        re.M,
    ),
}
_BRACE_SCAN["JavaScript"] = _BRACE_SCAN["TypeScript"]
_PYTHON_SCAN = re.compile(r"(?P<comment>#[^\n]*)|(?P<string>(?:[rRbBuUfF]{0,2})(?:\"\"\"(?s:(?:[^\\]|\\.)*?)(?:\"\"\"|\Z)|'''(?s:(?:[^\\]|\\.)*?)(?:'''|\Z)|\"(?:[^\"\\\n]|\\(?s:.))*(?:\"|$)|'(?:[^'\\\n]|\\(?s:.))*(?:'|$)))|(?P<def>^(?P<indent>[ \t]*)(?:async[ \t]+)?def[ \t]+(?P<name>\w+))|(?P<p>[()\[\]{}:])", re.M)
#: Words that look like a method's name before a bracket and are none.
_NO_METHOD = frozenset("if for while switch catch return function with await typeof new throw super constructor_ else do case delete void yield in of".split())
_BETWEEN = re.compile(r"(?:\s|#!?\[[^\n]*\]|@[\w.]+(?:\([^\n]*\))?|\bpub\([^)]*\)|\b(?:pub|export|default|async|const|unsafe|static|extern|declare|abstract|public|private|protected|override|readonly|get|set)\b|\"C\")*")
_DOC_COMMENT = {"Rust": ("///", "/**"), "TypeScript": ("/**",), "JavaScript": ("/**",)}
#: An empty line between a comment and a function: the comment belongs to the file, not to the function.
_EMPTY_LINE = re.compile(r"\n[ \t\r]*\n")


def _belongs(text: str, doc_end: int, start: int) -> bool:
    """Whether only modifiers and attributes stand between a comment and a function; before a function in the same line damaged ones count as such too."""
    between = _BETWEEN.match(text, doc_end)
    return not _EMPTY_LINE.search(text, doc_end, start) and (between.end() >= start or "\n" not in text[between.end() : start] and "\n" in text[doc_end : between.end()] and not re.search(r"[;{}]", text[between.end() : start]))


def _braced(text: str, language: str, comments: list[tuple[int, str]]) -> list[tuple[str, int, int, str | None]]:
    """Functions; documentation comments go to ``comments`` with their ends."""
    docs = _DOC_COMMENT[language]
    found: list[list] = []
    open_: list[tuple[str, int | None]] = []
    pending: int | None = None
    pending_depth = 0
    body_at: int | None = None
    partners: dict[int, int] | None = None
    doc: list[str] = []
    doc_end = -1
    for m in _BRACE_SCAN[language].finditer(text):
        group = m.lastgroup
        if group == "comment":
            body = m.group()
            if body.startswith(docs) and not body.startswith(("////", "/**/")):
                if doc and not (body.startswith("//") and doc[-1].startswith(body[:3]) and not text[doc_end : m.start()].strip()):
                    doc = []
                doc.append(body)
                doc_end = m.end()
                if len(doc) > 1:
                    comments.pop()
                comments.append((doc_end, "\n".join(doc)))
            continue
        if group == "string" or group == "h":
            continue
        if group == "p":
            c = m.group()
            if c in "([{":
                if c == "{" and pending is not None and len(open_) == pending_depth and body_at in (None, m.start()):
                    open_.append((c, pending))
                    pending = None
                else:
                    open_.append((c, None))
            elif c == ";":
                if pending is not None and len(open_) == pending_depth:
                    pending = None
            elif open_:
                _, owner = open_.pop()
                if owner is not None:
                    found[owner][2] = m.end()
            continue
        name = m.groupdict()
        who = name.get("name") or name.get("bound") or name.get("method")
        if who is None or name.get("method") and who in _NO_METHOD:
            continue
        body = None
        if name.get("method"):
            if partners is None:
                partners = _partners(text, _BRACE_SCAN[language])
            body = _body_of(text, partners.get(m.end()))
            if body is None:
                continue
        body_at = body
        start = m.start() + len(m.group()) - len(m.group().lstrip())
        mine = "\n".join(doc) if doc and _belongs(text, doc_end, start) else None
        doc = []
        found.append([who, start, len(text), mine])
        pending, pending_depth = len(found) - 1, len(open_)
    return [tuple(f) for f in found]


def _partners(text: str, scan: re.Pattern) -> dict[int, int]:
    """Where each round bracket outside strings and comments is closed."""
    found: dict[int, int] = {}
    open_: list[int] = []
    for m in scan.finditer(text):
        if m.lastgroup == "p":
            if m.group() == "(":
                open_.append(m.start())
            elif m.group() == ")" and open_:
                found[open_.pop()] = m.start()
    return found


_TYPE_SCAN = re.compile(r"(?P<comment>//[^\n]*|/\*(?s:.*?)(?:\*/|\Z))|(?P<string>\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`[^`]*`)|(?P<p>=>|\n|[^\w\s])|(?P<word>\w+)")
#: A type goes on after these, and before those.
_GOES_ON, _GOES_ON_BEFORE = frozenset((":", "|", "&", "=>", "?", ".", "is", "keyof", "typeof", "extends", "asserts", "readonly")), frozenset(("|", "&", "?", "=>", ".", "is", "extends"))


def _body_of(text: str, closed: int | None) -> int | None:
    """Where the body begins of a method whose parameters end at ``closed``; a return type may stand between, over any lines. None if no body follows."""
    if closed is None:
        return None
    depth, last, broken = 0, "", False
    for m in _TYPE_SCAN.finditer(text, closed + 1):
        if m.lastgroup == "comment":
            continue
        c = m.group()
        if c == "\n":
            broken = True
            continue
        if not last and c not in ("{", ":"):
            return None
        if depth == 0:
            if c == "{" and last not in _GOES_ON:
                return m.start()
            if c in (";", ",", ")", "]", "}", "=") or broken and last and last not in _GOES_ON and c not in _GOES_ON_BEFORE:
                return None
        if c in ("(", "[", "{", "<"):
            depth += 1
        elif c in (")", "]", "}", ">"):
            depth -= 1
        last, broken = c, False
    return None


def _indented(text: str) -> list[tuple[str, int, int, str | None]]:
    found: list[list] = []
    open_: list[list] = []
    depth = 0
    header: list | None = None
    awaiting: list | None = None
    ends: list[tuple[int, int]] = []
    for m in _PYTHON_SCAN.finditer(text):
        group = m.lastgroup
        if group == "comment":
            continue
        if group == "string":
            # a damaged header may end anywhere; the string that opens the line after it is its documentation all the same
            opened = awaiting or header
            if opened is not None and text.count("\n", opened[1], m.start()) == 1 and not text[text.rfind("\n", 0, m.start()) : m.start()].strip():
                opened[3], header, awaiting, depth = m.group(), None, None, 0
                continue
            if awaiting is not None:
                if not text[awaiting[4] : m.start()].strip() or not re.sub(r"#[^\n]*", "", text[awaiting[4] : m.start()]).strip():
                    awaiting[3] = m.group()
                awaiting = None
            continue
        if group == "p":
            c = m.group()
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth = max(0, depth - 1)
            elif header is not None and depth == 0:
                header[4] = m.end()
                awaiting, header = header, None
            continue
        if group in ("def", "name", "indent") or m.group("name"):
            entry = [m.group("name"), m.start() + len(m.group("indent")), len(text), None, m.end(), len(m.group("indent").expandtabs())]
            found.append(entry)
            header, awaiting, depth = entry, None, 0
    # a function ends before the next line that is not deeper than its header
    lines = [(m.start(), len(m.group(1).expandtabs())) for m in re.finditer(r"^([ \t]*)(?=[^\s#])", text, re.M)]
    starts = [a for a, _ in lines]
    for entry in found:
        k = bisect.bisect_right(starts, entry[4])
        while k < len(lines) and lines[k][1] > entry[5]:
            k += 1
        if k < len(lines):
            entry[2] = lines[k][0]
    return [(e[0], e[1], e[2], e[3]) for e in found]


def functions_of(text: str, language: str, comments: list[tuple[int, str]] | None = None) -> list[tuple[str, int, int, int, str | None]]:
    """(name, first line, start, end, documentation as written) of each function and method, in order; tolerant of broken files. ``comments`` takes all documentation comments with their ends."""
    found = _indented(text) if language == "Python" else _braced(text, language, comments if comments is not None else [])
    breaks = [m.start() for m in re.finditer("\n", text)]
    return [(name, bisect.bisect_left(breaks, start) + 1, start, end, doc) for name, start, end, doc in found]


class Scanned:
    """The functions of one text, to be asked by the name and line that a parse record gives."""

    def __init__(self, text: str, language: str) -> None:
        self.text, self.comments = text, []
        self.functions = functions_of(text, language, self.comments)
        self.at = {(name, line): (start, end, doc) for name, line, start, end, doc in reversed(self.functions)}
        self.named: dict[str, list[tuple[int, int, str | None]]] = {}
        self.on_line: dict[int, tuple[int, int, str | None]] = {}
        for name, line, start, end, doc in self.functions:
            self.named.setdefault(name, []).append((start, end, doc))
            self.on_line.setdefault(line, (start, end, doc))
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def ask(self, name: str, line: int | None) -> tuple[int | None, int | None, str | None]:
        """(start, end, documentation) of a function. Where its header is damaged, so that no function of this name was found, only the comment right before the line (or the string after it)."""
        found = self.at.get((name, line))
        if found is None and len(self.named.get(name, ())) == 1:
            found = self.named[name][0]
        if found is not None:
            return found
        if line is None or line != line or not 1 <= line <= len(self.starts):
            return None, None, None
        start = self.starts[int(line) - 1]
        near = self.on_line.get(int(line))
        if near is not None:
            return near
        start += len(self.text[start:]) - len(self.text[start:].lstrip(" \t"))
        k = bisect.bisect_right(self.comments, (start, "")) - 1
        return None, None, self.comments[k][1] if k >= 0 and self.comments[k][0] <= start and _belongs(self.text, self.comments[k][0], start) else None


# --- what documentation tells

_MARKS = re.compile(r"^[ \t]*(?:/\*\*?|\*/|///?!?|\*|#+|--+|<!--|\"\"\"|''')?[ \t]*|[ \t]*(?:\*/|\"\"\"|'''|-->)[ \t]*$", re.M)
# Tags and placeholders.
_PARAM_TAG = re.compile(r"^[@\\](?:param|arg|argument|prop|property|typeparam|template|throws|raises|exception)\b[ \t]*(?:\{[^}\n]*\}[ \t]*)?(?:\[?[\w$.]+\]?)?(?:[ \t]*=[^ \n]*)?[ \t]*[-:]?[ \t]*|^:(?:param|type|arg|raises|var)\b[^:\n]*:[ \t]*", re.I)
_TAG = re.compile(r"^[@\\](?:returns?|type|deprecated|override|private|public|internal|see|inheritdoc|brief|summary|test|async|async|class|function|method|name|since|author|version)\b[ \t]*(?:\{[^}\n]*\}[ \t]*)?|^:(?:returns?|rtype|return)\b[^:\n]*:[ \t]*", re.I)
_SECTION = re.compile(r"^(?:args|arguments|parameters|params|returns?|yields|raises|throws|examples?|notes?|attributes)[ \t]*:[ \t]*", re.I)
_NAMES_ONLY = re.compile(r"^[\w$]+(?:[ \t]*,[ \t]*[\w$]+)*$")
_ENTRY = re.compile(r"^[*-]?[ \t]*[\w$]+[ \t]*(?:\([^)\n]*\))?[ \t]*:[ \t]*")
_BRACKETED_NAMES = re.compile(r"\([ \t]*[\w$]+(?:[ \t]*,[ \t]*[\w$]+)*[ \t]*\)\.?[ \t]*$", re.M)
_POINTER = re.compile(r"\b(?:see|cf\.?|refer to|same as|compare|documented|described|docs?) (?:the )?(?:above|below|elsewhere|there|parent|base|super|other|readme|docs?|documentation|wiki|interface|header|module|`[^`]*`|[\w./:#]*[./:#_]\w+|\w+\(\))(?: (?:class|docs?|documentation|file|module|method|implementation|declaration|for details|instead))*|\{@(?:inheritdoc|link|see)[^}]*\}|\binheritdoc\b", re.I)
_PLACEHOLDER = re.compile(
    r"\b(?:todo|fixme|tbd|xxx+|hack|wip)\b(?:\([^)]*\))?[:.!]*(?:[ \t]*(?:write|add|document|describe|fill|complete|explain|update|improve)\b[^\n]*)?|\bn/?a\b|\bto be (?:done|documented|written|determined)\b|\b(?:no|missing|needs?|add|write|insert) (?:docs?|documentation|docstring|description|comments?)\b(?: (?:yet|here|available|needed|me))*"
    r"|\b(?:docs?|documentation|description|docstring) (?:missing|needed|pending|here|goes here|tbd|to follow|follows)\b|\bwrite me\b|\bauto-?generated (?:method|function|constructor)? ?stub\b|\bplaceholder(?: (?:docstring|docs?|comment|text))?\b|\bnot (?:yet )?documented\b|\bundocumented\b|\blorem ipsum[^\n]*|\bfoo ?bar\b|\bdummy\b|\bnone\b", re.I,
)
_EMPTY_WORDS = frozenset(
    """a an the this that these it its is are be will can should do does to of for in on at by from with and or as your my our given
function functions func fn method methods routine procedure helper utility constructor implementation implements implement implementing definition defines define class struct
which used use called name named value values parameter parameters param params arg args argument arguments return returns returned result results description docstring docs doc summary""".split()
)
_TODO_SENTENCE = re.compile(r"^\s*todo\b\s*[a-z]+ [a-z]+,", re.I)
_SPLIT = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-zß-ÿ]+|\d+|[^\W\d_a-zA-Z]+")


def _stem(word: str) -> str:
    word = word.lower()
    while True:
        for end in ("ing", "ies", "es", "ed", "s", "er", "or", "e", "y"):
            if word.endswith(end) and len(word) - len(end) >= 3:
                word = word[: -len(end)]
                break
        else:
            return word[:-1] if len(word) > 3 and word[-1] == word[-2] else word


def _stems(name: str) -> set[str]:
    return {_stem(w) for w in _SPLIT.findall(name)}


def plain_doc(doc: str) -> str:
    """The documentation without comment marks, quotes and decoration."""
    lines = [_MARKS.sub("", line).strip() for line in doc.replace("\r", "").split("\n")]
    return "\n".join(line for line in lines if line.strip("-=~#*_./\\ \t\"'`")).strip()


def _untagged(text: str) -> str:
    """The text without tags, section titles and the parameter names they introduce."""
    out, inside = [], False
    for line in text.split("\n"):
        line = line.strip()
        section = _SECTION.match(line)
        if section:
            rest = line[section.end() :]
            inside = True
            out.append("" if _NAMES_ONLY.match(rest) else rest)
            continue
        if inside:
            entry = _ENTRY.match(line)
            if entry or _NAMES_ONLY.match(line) and " " not in line:
                out.append(line[entry.end() :] if entry else "")
                continue
        out.append(_TAG.sub("", _PARAM_TAG.sub("", line)))
    return "\n".join(out)


def informs(doc: str | None, name: str, signature: str | None = None, parameters: Sequence[str] | None = None) -> bool:
    """Whether the documentation tells something that name, signature and parameter names do not.

    Not: missing, blank and decorative texts, placeholders, bare tags, pointers elsewhere, repetitions of the name. Short texts and other languages do if they add a word.
    """
    if not doc:
        return False
    text = plain_doc(doc)
    if not re.search(r"\w", text):
        return False
    # a sentence may begin with the word todo without being a note to oneself
    if not _TODO_SENTENCE.match(text):
        text = _PLACEHOLDER.sub(" ", text)
    text = _untagged(_POINTER.sub(" ", text))
    text = _BRACKETED_NAMES.sub(" ", text)
    known = _stems(name)
    for p in parameters if parameters is not None else ():
        known |= _stems(p or "")
    known |= _stems(signature or "")
    left = [w for w in _SPLIT.findall(re.sub(r"\b(\w+)'s\b", r"\1", text)) if w.lower() not in _EMPTY_WORDS and _stem(w) not in known and (len(w) > 1 or not w.isascii())]
    return any(not w.isdigit() for w in left)


PAIRS = "repo STRING, path STRING, qualified_name STRING, signature STRING, docstring STRING, code STRING, start_line BIGINT"


def documented_functions(documents: DataFrame, file_parse: DataFrame) -> DataFrame:
    """``repo, path, qualified_name, signature, docstring, code, start_line``: one row per function or method that the scanner finds documented in a file's text and the file's current record knows.

    ``docstring`` is the comment in the text without its marks, ``code`` the function as delimited in the text: null where its header is damaged, so that only the comment was found. A function without a comment in the
    text gives no pair whatever the record says, nor does one that the record has without any documentation (a comment that belongs to something else). Functions that share a qualified name are all kept.
    Files without text or record, empty files, null symbols and unknown extensions give nothing; very long files are scanned whole.
    """
    # fields by path, so that the scan reads these alone
    parts = F.arrays_zip(*[F.col(f"symbols.{c}").alias(c) for c in ("kind", "name", "qualified_name", "signature", "parameters", "docstring", "start_line")])
    symbols = F.transform(F.filter(parts, lambda x: x["kind"].isin("Function", "Method") & x["docstring"].isNotNull()), lambda x: F.struct(x["name"].alias("name"), x["qualified_name"].alias("qualified_name"), x["signature"].alias("signature"), F.transform(x["parameters"], lambda q: q["name"]).alias("parameters"), x["start_line"].alias("start_line")))
    with_doc = current_records(file_parse, symbols.alias("symbols")).where(F.size("symbols") > 0)
    texts = documents.where((F.col("source") == "repo_file") & F.col("path").isNotNull() & (F.col("text") != "")).select("repo", "path", "text")
    f, t = with_doc.alias("f"), texts.alias("t")
    files = f.join(t, F.col("f.repo").eqNullSafe(F.col("t.repo")) & (F.col("f.path") == F.col("t.path"))).select("f.repo", "f.path", "t.text", "f.symbols")
    return files.mapInPandas(_pair, PAIRS)


def _pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for repo, path, text, symbols in zip(batch["repo"], batch["path"], batch["text"], batch["symbols"], strict=True):
            language = language_of(path)
            if not language:
                continue
            scanned = Scanned(text, language)
            for s in symbols:
                start, end, doc = scanned.ask(s["name"] or "", s["start_line"])
                if doc is not None and informs(doc, s["name"] or "", s["signature"], s["parameters"]):
                    out.append((repo, path, s["qualified_name"], s["signature"], plain_doc(doc), None if start is None else text[start:end].rstrip(), s["start_line"]))
        yield pd.DataFrame(out, columns=["repo", "path", "qualified_name", "signature", "docstring", "code", "start_line"])
