"""Parse records from source texts: symbols, calls, imports, documentation, diagnostics, line counts.

Python sources go through the standard library's parser; Rust, TypeScript and JavaScript through this package's lexers and a walk over the tokens, which also works on files that break off. Runs inside Arrow batches, one text at a time.
"""

from __future__ import annotations

import ast
import bisect
import hashlib
import re
import warnings
from typing import Any

from codelode.operators.files import MOST_CALLS, MOST_DIAGNOSTICS, MOST_IMPORTS, MOST_SYMBOLS
from codelode.schema import VERSION
from codelode.sources.grammar import language_of, parses, tokens_follow
from codelode.sources.lexing import Tokens, Unlexable, js_tokens, rust_tokens

_TEST_PATH = {
    "Rust": re.compile(r"(^|/)tests/|(^|/)tests\.rs$|_test\.rs$"),
    "Python": re.compile(r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.py$"),
    "TypeScript": re.compile(r"(^|/)__tests__/|\.(test|spec)\.[jt]sx?$"),
    "JavaScript": re.compile(r"(^|/)__tests__/|\.(test|spec)\.[jt]sx?$"),
}


class _Text:
    """A source with byte offsets and line numbers."""

    def __init__(self, source: str) -> None:
        self.source, self.ascii = source, source.isascii()
        self.breaks = [m.start() for m in re.finditer("\n", source)]

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.breaks, at) + 1

    def column(self, at: int) -> int:
        k = bisect.bisect_left(self.breaks, at)
        start = self.breaks[k - 1] + 1 if k else 0
        return at - start if self.ascii else len(self.source[start:at].encode())

    def byte(self, at: int) -> int:
        return at if self.ascii else len(self.source[:at].encode())


class _Walk:
    """What all token walks share: the record's lists, and slices of the text by token."""

    def __init__(self, path: str, source: str, tokens: Tokens) -> None:
        self.path, self.text, self.t = path, _Text(source), tokens
        self.kind, self.word, self.start, self.match = tokens.kind, tokens.text, tokens.start, tokens.match
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.imports: list[dict] = []
        self.ends = [c[1] for c in tokens.comments]

    def end(self, k: int) -> int:
        return self.start[k] + len(self.word[k])

    def slice(self, a: int, b: int) -> str:
        """Text from token a to the end of token b - 1."""
        return self.text.source[self.start[a] : self.end(b - 1)] if b > a else ""

    def before(self, at: int) -> list[str]:
        """Comments that directly precede a place, the nearest first."""
        out = []
        k = bisect.bisect_right(self.ends, at) - 1
        while k >= 0 and not self.text.source[self.t.comments[k][1] : at].strip():
            a, b = self.t.comments[k]
            out.append(self.text.source[a:b])
            at, k = a, k - 1
        return out

    def symbol(self, key: str, name: str, kind: str, a: int, b: int, test: bool, signature: str | None = None, parameters: list | None = None, returns: str | None = None, doc: str | None = None) -> None:
        first, last = self.start[a], self.end(max(a, b - 1))
        self.symbols.append({
            "local_key": key, "name": name, "qualified_name": key, "kind": kind, "start_line": self.text.line(first), "end_line": self.text.line(last), "start_byte": self.text.byte(first), "end_byte": self.text.byte(last),
            "signature": signature, "parameters": parameters or [], "return_type": returns, "docstring": doc, "is_test": test,
        })

    def call(self, caller: str, name: str, at: int) -> None:
        self.calls.append({"caller_local_key": caller, "callee_name": name, "callee_local_key": None, "callee_file": None, "callee_external": False, "line": self.text.line(self.start[at]), "column": self.text.column(self.start[at])})

    def imported(self, name: str, module: str, kind: str, at: int) -> None:
        self.imports.append({"import_name": name, "target_module": module, "kind": kind, "line": self.text.line(self.start[at]), "column": self.text.column(self.start[at]), "resolved": None})

    def close(self, k: int) -> int:
        partner = self.match.get(k, -1)
        return partner if partner > k else len(self.kind) - 1

    def split(self, a: int, b: int, sign: str = ",") -> list[tuple[int, int]]:
        """Ranges between top-level signs; brackets and angle brackets are kept together."""
        out, at, k, angle = [], a, a, 0
        while k < b:
            c = self.kind[k]
            if c in "([{" and c:
                k = min(self.close(k), b)
            elif c == "<":
                angle += 1
            elif c == ">" and angle:
                angle -= 1
            elif c == ">>" and angle:
                angle = max(0, angle - 2)
            elif c == sign and not angle:
                out.append((at, k))
                at = k + 1
            k += 1
        if at < b:
            out.append((at, b))
        return out


def _block_doc(comment: str) -> list[str]:
    return [re.sub(r"^\*", "", line.strip()).strip() for line in comment[3:].removesuffix("*/").split("\n")]


# --- Rust


class _Rust(_Walk):
    def docs(self, a: int) -> str | None:
        """Documentation before token a, back to the first other comment or attribute. A block's lines come in reverse order."""
        lines: list[str] = []
        at = self.start[a]
        while True:
            comments = self.before(at)
            if not comments:
                attribute = self._attribute_before(at)
                if attribute is None or not attribute[1].startswith("#[doc"):
                    break
                quoted = re.search(r'"(.*)"', attribute[1], re.S)
                lines += [quoted.group(1)] if quoted else []
                at = attribute[0]
                continue
            stop = False
            for c in comments:
                if c.startswith(("///", "//!")):
                    lines.append(c[3:].strip())
                elif c.startswith("/**"):
                    lines += _block_doc(c)
                else:
                    stop = True
                    break
                at = self.text.source.rfind(c, 0, at)
            if stop:
                break
        return "\n".join(lines[::-1]) if lines else None

    def _attribute_before(self, at: int) -> tuple[int, str] | None:
        k = bisect.bisect_left(self.start, at) - 1
        if k < 0 or self.kind[k] != "]" or k not in self.match or self.text.source[self.end(k) : at].strip():
            return None
        a = self.match[k] - 1
        return (self.start[a], self.slice(a, k + 1)) if a >= 0 and self.kind[a] == "#" else None

    def run(self) -> None:
        self.items(0, len(self.kind) - 1, [], None, None, bool(_TEST_PATH["Rust"].search(self.path)))

    def items(self, a: int, b: int, mods: list[str], owner: str | None, caller: str | None, test: bool) -> None:
        """Items and expressions of a range of tokens."""
        k, begin, attributes = a, a, []
        while k < b:
            c = self.kind[k]
            tested = test or any("test" in x for x in attributes[-2:])
            if c == "#" and self.kind[k + 1] in ("[", "!"):
                q = k + 1 if self.kind[k + 1] == "[" else k + 2
                e = self.close(q) + 1
                attributes.append(self.slice(k, e))
                k = begin = e
            elif c == "mod" and self.kind[k + 1] == "i":
                name, q = self.word[k + 1], k + 2
                if self.kind[q] == "{":
                    self.items(q + 1, self.close(q), [*mods, name], owner, caller, tested or name == "tests")
                    q = self.close(q)
                k = begin = q + 1
            elif c == "fn" and self.kind[k + 1] == "i":
                k = begin = self.function(begin, k, b, mods, owner, tested)
            elif c in ("struct", "enum", "trait") and self.kind[k + 1] == "i":
                q = k + 2
                while q < b and self.kind[q] not in ("{", ";", "("):
                    q += 1
                if q < b and self.kind[q] == "(":
                    q = self.close(q)
                    while q < b and self.kind[q] != ";":
                        q += 1
                e = (self.close(q) if q < b and self.kind[q] == "{" else q) + 1
                self.symbol("::".join([*mods, self.word[k + 1]]), self.word[k + 1], c.capitalize(), begin, min(e, b), tested, doc=self.docs(begin))
                if c == "trait" and self.kind[q] == "{":
                    self.items(q + 1, self.close(q), mods, owner, caller, test)
                k = begin = e
            elif c == "impl" and caller is None or c == "impl" and self.kind[k - 1] in ("", ";", "}", "]", "{"):
                q, name_at, depth = k + 1, k + 1, 0
                if self.kind[q] == "<":
                    q = self.angle(q)
                    name_at = q
                while q < b and self.kind[q] not in ("{", ";", "where"):
                    if self.kind[q] == "for":
                        name_at = q + 1
                    q += 1
                of = self.slice(name_at, q)
                while q < b and self.kind[q] not in ("{", ";"):
                    q += 1
                if q < b and self.kind[q] == "{":
                    self.items(q + 1, self.close(q), mods, of or owner, caller, test)
                    q = self.close(q)
                k = begin = q + 1
            elif c == "use":
                q = k
                while q < b and self.kind[q] != ";":
                    q += 1
                self.use(k, q)
                k = begin = q + 1
            elif c in (";", "{", "}"):
                k = begin = k + 1
            elif caller is not None:
                k = self.expression(k, b, mods, owner, caller, test)
            else:
                k += 1

    def angle(self, k: int) -> int:
        depth = 0
        while self.kind[k]:
            depth += {"<": 1, ">": -1, ">>": -2}.get(self.kind[k], 0)
            k += 1
            if depth <= 0:
                return k
        return k

    def function(self, begin: int, k: int, b: int, mods: list[str], owner: str | None, test: bool) -> int:
        name, q = self.word[k + 1], k + 2
        if self.kind[q] == "<":
            q = self.angle(q)
        if self.kind[q] != "(":
            return q
        parameters = []
        for x, y in self.split(q + 1, min(self.close(q), b)):
            while self.kind[x] == "#":
                x = self.close(x + 1) + 1
            words = [self.kind[z] for z in range(x, min(y, x + 4))]
            if "self" in words and ":" not in words[: words.index("self")]:
                parameters.append({"name": "self", "type_annotation": None, "default_value": None})
                continue
            colon = next((z for z in range(x, y) if self.kind[z] == ":"), None)
            if colon is not None:
                parameters.append({"name": self.slice(x, colon), "type_annotation": self.slice(colon + 1, y), "default_value": None})
        q = self.close(q) + 1
        returns, r = None, q
        while q < b and self.kind[q] not in ("{", ";", "where"):
            q += 2 if self.kind[q] == "[" and False else 1
        if r < q and self.kind[r] == "->":
            returns = self.slice(r + 1, q)
        while q < b and self.kind[q] not in ("{", ";"):
            q += 1
        if q >= b or self.kind[q] == ";":
            return q + 1  # a method without body is no symbol
        key = "::".join([*mods, *([owner] if owner else []), name])
        signature = " ".join(line.strip() for line in self.text.source[self.start[begin] : self.start[q]].strip().split("\n"))
        e = self.close(q)
        self.symbol(key, name, "Method" if owner else "Function", begin, min(e + 1, b), test, signature, parameters, returns, self.docs(begin))
        self.items(q + 1, min(e, b), mods, owner, key, test)
        return e + 1

    def expression(self, k: int, b: int, mods: list[str], owner: str | None, caller: str, test: bool) -> int:
        """A step over an expression; the outermost call of a chain is recorded, its arguments are not looked at, nor are macros."""
        c = self.kind[k]
        if c == "let":
            while k < b and self.kind[k] not in ("=", ";"):
                k = self.close(k) + 1 if self.kind[k] in ("(", "[", "{") else k + 1
            return k + (k < b and self.kind[k] == "=")
        if c == "for":
            while k < b and self.kind[k] != "in":
                k = self.close(k) + 1 if self.kind[k] in ("(", "[") else k + 1
            return k + 1
        if c == "match":
            q = k + 1
            while q < b and self.kind[q] != "{":
                q = self.close(q) + 1 if self.kind[q] in ("(", "[") else q + 1
            self.items(k + 1, q, mods, owner, caller, test)
            if q >= b:
                return b
            e, q = min(self.close(q), b), q + 1
            while q < e:
                guard = None
                while q < e and self.kind[q] != "=>":
                    guard = q if self.kind[q] == "if" else guard
                    q = self.close(q) + 1 if self.kind[q] in ("(", "[", "{") else q + 1
                if guard is not None:
                    self.items(guard, q, mods, owner, caller, test)
                q += 1
                a = q
                if q < e and self.kind[q] == "{":
                    q = self.close(q) + 1
                else:
                    while q < e and self.kind[q] != ",":
                        q = self.close(q) + 1 if self.kind[q] in ("(", "[", "{") else q + 1
                self.items(a, min(q, e), mods, owner, caller, test)
                q += q < e and self.kind[q] == ","
            return e + 1
        if c not in ("i", "self", "Self", "super", "crate"):
            return k + 1
        if self.kind[k + 1] == "!" and self.kind[k + 2] in ("(", "[", "{"):
            return self.close(k + 2) + 1
        a, q = k, k + 1
        last = None
        while q < b:
            if self.kind[q] == "::":
                q += 1
                q = self.angle(q) if self.kind[q] == "<" else q + 1
            elif self.kind[q] == "." and self.kind[q + 1] in ("i", "n", "await"):
                q += 2
            elif self.kind[q] == "(":
                last = q
                q = self.close(q) + 1
            elif self.kind[q] == "?" or self.kind[q] == "[":
                q = self.close(q) + 1 if self.kind[q] == "[" else q + 1
            else:
                break
        if last is None:
            # an index may hold calls
            for x in range(a, q):
                if self.kind[x] == "[":
                    self.items(x + 1, self.close(x), mods, owner, caller, test)
            return q
        plain = all(self.kind[x] not in ("(", "[", "?") for x in range(a, last))
        name = re.sub(r"\s+", "", self.slice(a, last)) if plain else self.slice(a, last)
        self.call(caller, name, a)
        return q

    def use(self, k: int, e: int) -> None:
        """Names of a use declaration: a single path has its last part as name; in a list only plain and scoped names count."""
        words = lambda a, b: re.sub(r"\s+", "", self.slice(a, b))
        a = k + 1
        brace = next((x for x in range(a, e) if self.kind[x] == "{"), None)
        if brace is None:
            parts = words(a, e) if not any(self.kind[x] == "as" for x in range(a, e)) else None
            if parts is None:
                at = next(x for x in range(a, e) if self.kind[x] == "as")
                self.imported(self.word[at + 1], words(a, at), "Named", k)
            elif parts.endswith("*"):
                self.imported("*", parts[:-3], "Star", k)
            else:
                module, _, name = parts.rpartition("::")
                self.imported(name, module, "Named", k)
            return
        prefix = words(a, brace).removesuffix("::")
        for x, y in self.split(brace + 1, min(self.close(brace), e)):
            if any(self.kind[z] in ("{", "*", "self") for z in range(x, y)):
                continue
            if any(self.kind[z] == "as" for z in range(x, y)):
                at = next(z for z in range(x, y) if self.kind[z] == "as")
                self.imported(self.word[at + 1], f"{prefix}::{words(x, at)}", "Named", k)
                continue
            part = words(x, y)
            if part:
                below, _, name = part.rpartition("::")
                self.imported(name, f"{prefix}::{below}" if below else f"{prefix}::{name}", "Named", k)


# --- TypeScript and JavaScript


class _Script(_Walk):
    def __init__(self, path: str, source: str, tokens: Tokens, typed: bool) -> None:
        super().__init__(path, source, tokens)
        self.typed, self.joint = typed, "." if typed else "::"
        self.test = bool(_TEST_PATH["TypeScript"].search(path))

    def run(self) -> None:
        self.walk(0, len(self.kind) - 1, None, None)

    def docs(self, a: int) -> str | None:
        """The doc comment right before a declaration (or its export); lines of a block in reverse order."""
        if a and self.kind[a - 1] in ("export", "default"):
            return self.docs(a - 1)
        lines: list[str] = []
        for c in self.before(self.start[a]):
            if not c.startswith("/**"):
                break
            lines += _block_doc(c)
        return "\n".join(lines[::-1]) if lines else None

    def parameters(self, q: int) -> list[dict]:
        out = []
        for x, y in self.split(q + 1, self.close(q)):
            while self.typed and self.kind[x] == "i" and self.word[x] in ("public", "private", "protected", "readonly") and x + 1 < y and self.kind[x + 1] == "i":
                x += 1
            equals = next((z for z in range(x, y) if self.kind[z] == "="), None)
            colon = next((z for z in range(x, equals or y) if self.kind[z] == ":"), None) if self.typed and self.kind[x] not in ("{", "[") else None
            stop = min(z for z in (colon, equals, y) if z is not None)
            name = self.slice(x, stop).rstrip("?")
            out.append({"name": name, "type_annotation": self.slice(colon, equals or y) if colon is not None else None, "default_value": self.slice(equals + 1, y) if equals is not None and self.typed else None})
        return out

    def returns(self, q: int, stop: int) -> str | None:
        return self.slice(q, stop) if self.typed and self.kind[q] == ":" else None

    def body_after(self, q: int, b: int) -> int | None:
        """The brace of a body that follows a parameter list's end, past a return type."""
        if q < b and self.kind[q] == ":":
            q += 1
            while q < b and self.kind[q] not in ("{", ";", "=>") or q < b and self.kind[q] == "{" and self.kind[q - 1] in (":", "|", "&", "<"):
                q = self.close(q) + 1 if self.kind[q] in ("(", "[", "{") else q + 1
        return q if q < b and self.kind[q] == "{" else None

    def signature(self, a: int, q: int, name: str, parameters: list[dict]) -> str | None:
        if self.typed:
            text = self.text.source[self.start[a] : self.start[q]].strip()
            return None if len(text.encode()) > 2000 else " ".join(line.strip() for line in text.split("\n"))
        return f"function {name}({', '.join(p['name'] for p in parameters)})"

    def function(self, a: int, name_at: int, b: int, owner: str | None, kind: str) -> int | None:
        q = name_at + 1
        if self.kind[q] == "<":
            q = _Rust.angle(self, q)  # type: ignore[arg-type]
        if self.kind[q] != "(":
            return None
        e = self.close(q) + 1
        body = self.body_after(e, b)
        if body is None:
            return None
        name = self.word[name_at]
        key = f"{owner}{self.joint}{name}" if owner else name
        parameters = self.parameters(q)
        end = self.close(body)
        self.symbol(key, name, kind, a, end + 1, self.test, self.signature(a, body, name, parameters), parameters, self.returns(e, body), self.docs(a))
        self.walk(body + 1, end, key, None)
        return end + 1

    def walk(self, a: int, b: int, caller: str | None, owner: str | None) -> None:
        k = a
        while k < b:
            c, w = self.kind[k], self.word[k]
            if c == "function" and self.kind[k + 1] in ("i", "*"):
                at = k + 2 if self.kind[k + 1] == "*" else k + 1
                first = k - 1 if k and self.word[k - 1] == "async" else k
                k = self.function(first, at, b, None, "Function") or k + 1
            elif c == "class":
                q = k + 1
                while q < b and self.kind[q] != "{":
                    q += 1
                name = self.word[k + 1] if self.kind[k + 1] == "i" and self.word[k + 1] != "implements" else None
                e = min(self.close(q), b)
                if name:
                    self.symbol(name, name, "Class", k, e + 1, self.test, doc=self.docs(k))
                self.members(q + 1, e, caller, name)
                k = e + 1
            elif self.typed and c == "i" and w == "interface" and self.kind[k + 1] == "i":
                q = k + 2
                while q < b and self.kind[q] != "{":
                    q += 1
                self.symbol(self.word[k + 1], self.word[k + 1], "Interface", k, min(self.close(q) + 1, b), self.test, doc=self.docs(k))
                k = self.close(q) + 1
            elif self.typed and c == "enum" and self.kind[k + 1] == "i":
                e = self.close(k + 2) + 1 if self.kind[k + 2] == "{" else k + 2
                first = k - 1 if k and self.kind[k - 1] == "const" else k
                self.symbol(self.word[k + 1], self.word[k + 1], "Enum", first, min(e, b), self.test)
                k = e
            elif self.typed and c == "i" and w == "type" and self.kind[k + 1] == "i" and self.kind[k + 2] in ("=", "<"):
                e = self.statement_end(k, b)
                self.symbol(self.word[k + 1], self.word[k + 1], "TypeAlias", k, e, self.test)
                k = e
            elif c in ("const", "var") and self.kind[k + 1] != "enum" or c == "i" and w == "let" and self.kind[k + 1] in ("i", "{", "["):
                k = self.variables(k + 1, b, caller)
            elif c == "import" and self.kind[k + 1] not in ("(", "."):
                k = self.import_(k, b)
            elif caller is not None and (c in ("i", "this", "super", "new") or c == "("):
                k = self.chain(k, b, caller)
            else:
                k += 1

    def statement_end(self, k: int, b: int) -> int:
        while k < b and self.kind[k] != ";":
            k = self.close(k) + 1 if self.kind[k] in ("(", "[", "{") else k + 1
            if k < b and self.t.newline[k] and self.kind[k] not in ("|", "&", ".", "?", ":", "=>", "=") and self.kind[k - 1] not in ("=", "|", "&", "=>", ",", "<", ":"):
                return k
        return min(k, b)

    def members(self, a: int, b: int, caller: str | None, owner: str | None) -> None:
        k = first = a
        while k < b:
            c = self.kind[k]
            if c == ";":
                k = first = k + 1
            elif c == "@":
                k += 2
                while k < b and self.kind[k] == ".":
                    k += 2
                k = first = self.close(k) + 1 if k < b and self.kind[k] == "(" else k
            elif (c in ("i", "s", "n") or c.isalpha()) and self.kind[k + 1] in ("(", "<"):
                done = self.function(first, k, b, owner, "Method")
                k = first = done if done is not None else self.close(k + 1) + 1 if self.kind[k + 1] == "(" else k + 2
            elif c == "=":
                e = self.statement_end(k + 1, b)
                self.walk(k + 1, e, caller, None)
                k = first = e
            elif c in ("{", "[", "("):
                k = self.close(k) + 1
            else:
                k += 1

    def variables(self, k: int, b: int, caller: str | None) -> int:
        while k < b:
            name_at = k
            q = self.close(k) + 1 if self.kind[k] in ("{", "[") else k + 1
            while q < b and self.kind[q] not in ("=", ",", ";") and not (self.t.newline[q] and self.kind[q] not in ("=",)) and self.word[q] not in ("of", "in"):
                q = self.close(q) + 1 if self.kind[q] in ("(", "[", "{") else q + 1
            value, e = None, q
            if q < b and self.kind[q] == "=":
                value = q + 1
                e = self.value_end(value, b)
            arrow = self.arrow(value, e) if value is not None else None
            name = self.slice(name_at, name_at + 1) if self.kind[name_at] == "i" else self.slice(name_at, self.close(name_at) + 1)
            if arrow is not None:
                opened, body = arrow
                parameters = self.parameters(opened) if self.kind[opened] == "(" else [{"name": self.word[opened], "type_annotation": None, "default_value": None}]
                if self.typed:
                    signature, returns = self.signature(value, body, name, parameters), self.returns(self.close(opened) + 1, body - 1) if self.kind[opened] == "(" and self.kind[body - 1] == "=>" else None
                else:
                    signature, returns = f"const {name}(...)", None
                self.symbol(name, name, "Function", name_at, e, self.test, signature, parameters, returns)
                self.walk(body, e, name, None)
            else:
                if self.typed:
                    self.symbol(name, name, "Constant", name_at, e, self.test)
                if value is not None:
                    self.walk(value, e, caller, None)
            if e < b and self.kind[e] == ",":
                k = e + 1
                continue
            return e
        return b

    def value_end(self, k: int, b: int) -> int:
        first = k
        while k < b and self.kind[k] not in (";", ",", ")", "]", "}"):
            if k > first and self.t.newline[k] and self.kind[k] not in (".", "?.", "?", ":", "=>", "+", "-", "*", "/", "&&", "||", "??", "|", "&", "=", "(", "[", "t") and self.kind[k - 1] not in ("=", "=>", "(", "+", "-", "*", "/", "&&", "||", "??", "?", ":", ".", "new", "await", "typeof"):
                break
            k = self.close(k) + 1 if self.kind[k] in ("(", "[", "{") else k + 1
        return min(k, b)

    def arrow(self, k: int, e: int) -> tuple[int, int] | None:
        """(parameters, body) if the value from k on is a function."""
        if self.word[k] == "async" and k + 1 < e:
            k += 1
        if self.kind[k] == "i" and self.kind[k + 1] == "=>":
            return k, k + 2
        if self.kind[k] == "<":
            k = _Rust.angle(self, k)  # type: ignore[arg-type]
        if self.kind[k] == "(":
            q = self.close(k) + 1
            if self.typed and q < e and self.kind[q] == ":":
                while q < e and self.kind[q] != "=>":
                    q = self.close(q) + 1 if self.kind[q] in ("(", "[", "{") else q + 1
            if q < e and self.kind[q] == "=>":
                return k, q + 1
        return None

    def chain(self, k: int, b: int, caller: str) -> int:
        """A value with its members and calls. TypeScript records every call, outer ones first, and looks at arguments; JavaScript the outermost only, and arguments of ``new``."""
        if self.kind[k] == "new":
            q = k + 1
            while q < b and (self.kind[q] in ("i", "this") or self.kind[q] == "."):
                q += 1
            if q > k + 1:
                self.call(caller, "new " + self.slice(k + 1, q), k)
            if q < b and self.kind[q] == "<" and self.typed:
                q = _Rust.angle(self, q)  # type: ignore[arg-type]
            if q < b and self.kind[q] == "(":
                self.walk(q + 1, self.close(q), caller, None)
                return self.close(q) + 1
            return max(q, k + 1)
        steps: list[tuple[int, int, str]] = []  # bracket, end, name so far
        if self.kind[k] == "(":
            e = self.close(k)
            if e + 1 < b and self.kind[e + 1] == "=>":
                return e + 2
            self.walk(k + 1, e, caller, None)
            name, q = self.slice(k, e + 1), e + 1
        else:
            name, q = self.word[k], k + 1
        others: list[tuple[int, int]] = []
        while q < b:
            if self.kind[q] in (".", "?.") and (self.kind[q + 1] == "i" or self.kind[q + 1].isalpha()):
                name += "." + self.word[q + 1]
                q += 2
            elif self.kind[q] == "(" and not (self.kind[k] == "(" and self.t.newline[q]):
                steps.append((q, self.close(q), name))
                q = self.close(q) + 1
            elif self.kind[q] == "[" and not self.t.newline[q]:
                name += self.slice(q, self.close(q) + 1)
                others.append((q + 1, self.close(q)))
                q = self.close(q) + 1
            elif self.kind[q] == "!" and self.typed and self.kind[q + 1] in (".", "("):
                q += 1
            else:
                break
        if not steps:
            for x, y in others:
                self.walk(x, y, caller, None)
            return max(q, k + 1)
        if not self.typed:
            x, _, full = steps[-1]
            self.call(caller, self.slice(k, x) if len(steps) > 1 else full, k)
            return q
        for _, _, full in reversed(steps):
            self.call(caller, full, k)
        for x, y, _ in steps:
            self.walk(x + 1, y, caller, None)
        return q

    def import_(self, k: int, b: int) -> int:
        e = k + 1
        while e < b and self.kind[e] != "s" and self.kind[e] != ";":
            e += 1
        if e >= b or self.kind[e] != "s":
            return e + 1
        module = self.word[e].strip("'\"`")
        rows: list[tuple[str, str]] = []
        q = k + 1
        if self.typed and self.word[q] == "type" and self.kind[q + 1] in ("{", "*", "i") and self.word[q + 1] != "from":
            q += 1
        stop = e - 1 if self.word[e - 1] == "from" else e
        if self.kind[q] == "i" and q < stop:
            rows.append((self.word[q], "Default"))
        brace = next((x for x in range(q, stop) if self.kind[x] == "{"), None)
        star = next((x for x in range(q, stop) if self.kind[x] == "*"), None)
        if brace is not None:
            for x, y in self.split(brace + 1, self.close(brace)):
                x += self.word[x] == "type" and y - x > 1 and self.word[x + 1] != "as"
                rows.append((self.word[x], "Named"))
        if star is not None:
            rows.append((self.word[star + 2] if not self.typed else "", "Star"))
        if not self.typed:
            order = {"Named": 0, "Star": 1, "Default": 2}
            rows.sort(key=lambda r: order[r[1]])
            if q < stop and self.kind[q] != "i":
                rows.append((self.slice(q, stop), "Default"))
        for name, kind in rows:
            if name:
                self.imported(name, module, kind, k)
        return e + 1


# --- Python


class _Python:
    def __init__(self, path: str, source: str) -> None:
        self.path, self.source, self.text = path, source, _Text(source)
        self.symbols: list[dict] = []
        self.calls: list[dict] = []
        self.imports: list[dict] = []
        self.bytes = source.encode()
        self.starts = [0, *(k + 1 for k, c in enumerate(self.bytes) if c == 10)]
        self.in_tests = bool(_TEST_PATH["Python"].search(path))

    def offset(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def slice(self, node: ast.AST) -> str:
        return self.bytes[self.offset(node.lineno, node.col_offset) : self.offset(node.end_lineno, node.end_col_offset)].decode(errors="replace")

    def run(self) -> None:
        tree = self.tree()
        if tree is not None:
            self.body(tree.body, None, None)

    def tree(self) -> ast.Module | None:
        """The parsed module; of a broken file the part before the statement that breaks."""
        lines = self.source.split("\n")
        end = len(lines)
        for _ in range(50):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    return ast.parse("\n".join(lines[:end]))
            except SyntaxError as error:
                stop = min(end, error.lineno or end) - 1
                while stop > 0 and (not lines[stop].strip() or lines[stop][:1] in " \t)]}#@"):
                    stop -= 1
                if stop <= 0 or stop >= end:
                    return None
                end = stop
            except (ValueError, RecursionError, MemoryError):
                return None
        return None

    def doc(self, node: ast.AST) -> str | None:
        first = node.body[0] if node.body else None
        if not isinstance(first, ast.Expr) or not isinstance(first.value, ast.Constant) or not isinstance(first.value.value, str):
            return None
        text = self.slice(first.value)
        for mark in ('"""', "'''"):
            if text.startswith(mark) and text.endswith(mark) and len(text) >= 6:
                return text[3:-3].strip()
        return text[1:-1] if text[:1] in "\"'" and text[-1:] == text[:1] else None

    def symbol(self, node: ast.AST, key: str, kind: str, signature: str | None, parameters: list, returns: str | None) -> None:
        name = node.name
        test = self.in_tests or (name.startswith("Test") if kind == "Class" else name.startswith("test_"))
        self.symbols.append({
            "local_key": key, "name": name, "qualified_name": key, "kind": kind, "start_line": node.lineno, "end_line": node.end_lineno, "start_byte": self.offset(node.lineno, node.col_offset), "end_byte": self.offset(node.end_lineno, node.end_col_offset),
            "signature": signature, "parameters": parameters, "return_type": returns, "docstring": self.doc(node), "is_test": test,
        })

    def parameters(self, a: ast.arguments) -> list[dict]:
        plain = [*a.posonlyargs, *a.args]
        defaults = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
        text = lambda n: None if n is None else self.slice(n)
        one = lambda x, d: {"name": x.arg, "type_annotation": text(x.annotation), "default_value": text(d)}
        out = [one(x, d) for x, d in zip(plain, defaults, strict=True)]
        if a.vararg:
            out.append({"name": "*" if a.vararg.annotation is None else "*" + a.vararg.arg, "type_annotation": text(a.vararg.annotation), "default_value": None})
        out += [one(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults, strict=True)]
        if a.kwarg:
            out.append({"name": "**" if a.kwarg.annotation is None else "**" + a.kwarg.arg, "type_annotation": text(a.kwarg.annotation), "default_value": None})
        return out

    def body(self, nodes: list, owner: str | None, caller: str | None) -> None:
        for node in nodes:
            self.visit(node, owner, caller)

    def visit(self, node: ast.AST, owner: str | None, caller: str | None) -> None:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            key = f"{owner}.{node.name}" if owner else node.name
            head = self.source_head(node)
            self.symbol(node, key, "Method" if owner else "Function", head, self.parameters(node.args), None if node.returns is None else self.slice(node.returns))
            self.body(node.body, owner, key)
        elif isinstance(node, ast.ClassDef):
            self.symbol(node, node.name, "Class", None, [], None)
            self.body(node.body, node.name, caller)
        elif isinstance(node, ast.Call):
            if caller is not None:
                self.calls.append({"caller_local_key": caller, "callee_name": self.callee(node.func), "callee_local_key": None, "callee_file": None, "callee_external": False, "line": node.lineno, "column": node.col_offset})
        elif isinstance(node, ast.Import):
            for x in node.names:
                self.imported(x.name, "", "Named", node)
        elif isinstance(node, ast.ImportFrom):
            module = "." * node.level + (node.module or "")
            for x in node.names:
                if x.name == "*":
                    self.imported("*", module, "Star", node)
                elif x.name != module or x.asname:
                    self.imported(x.name, module, "Named", node)
        else:
            for child in ast.iter_child_nodes(node):
                self.visit(child, owner, caller)

    def imported(self, name: str, module: str, kind: str, node: ast.AST) -> None:
        self.imports.append({"import_name": name, "target_module": module, "kind": kind, "line": node.lineno, "column": node.col_offset, "resolved": None})

    def callee(self, node: ast.AST) -> str:
        if isinstance(node, ast.Attribute):
            return f"{self.callee(node.value)}.{node.attr}"
        return node.id if isinstance(node, ast.Name) else self.slice(node)

    def source_head(self, node: ast.AST) -> str:
        """From ``def`` to the bracket that closes the parameters."""
        text = self.slice(node)
        at = text.index("(")
        depth, quote, k = 0, "", at
        while k < len(text):
            c = text[k]
            if quote:
                k += c == "\\"
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    break
            k += 1
        return " ".join(line.strip() for line in text[: k + 1].split("\n"))


# --- the record


def _resolved(calls: list[dict], symbols: list[dict], language: str) -> None:
    """Fills in the symbol of the same file that a call means, by the language's rules; the first of equal names holds."""
    by_name: dict[str, str] = {}
    by_qualified: dict[str, str] = {}
    for s in symbols:
        by_name.setdefault(s["name"], s["local_key"])
        by_qualified.setdefault(s["qualified_name"], s["local_key"])
    for c in calls:
        name, found = c["callee_name"], None
        if language == "Rust":
            if "::" in name:
                found = by_qualified.get(name)
                c["callee_external"] = found is None
            else:
                scope = c["caller_local_key"].rpartition("::")[0]
                found = by_qualified.get(f"{scope}::{name}") if scope else None
                found = found or (by_qualified.get(name) if "::" not in name else None)
        else:
            found = by_name.get(name) or by_qualified.get(name)
            if found is None and language == "JavaScript" and "." in name:
                found = by_name.get(name.split(".", 1)[0])
            if found is None and language == "TypeScript" and "::" in name:
                c["callee_external"] = True
        c["callee_local_key"] = found


def _metrics(source: str, comments: list[tuple[int, int]]) -> dict[str, int]:
    """Lines by kind: comment lines are those whose first sign begins a comment, and all lines of that comment."""
    if not source:
        return {"code_lines": 0, "comment_lines": 0, "blank_lines": 0}
    lines = source.split("\n")
    at = 0
    starts = []
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    inside = set()
    for a, b in comments:
        k = bisect.bisect_right(starts, a) - 1
        if not source[starts[k] : a].strip():
            inside.update(range(k, bisect.bisect_right(starts, max(a, b - 1))))
    begins = {k for k in inside if k < len(lines)}
    blank = sum(1 for k, line in enumerate(lines) if k not in begins and not line.strip(" \t\r\f\v"))
    return {"code_lines": len(lines) - len(begins) - blank, "comment_lines": len(begins), "blank_lines": blank}


def _python_comments(source: str) -> list[tuple[int, int]]:
    return [(m.start(1), m.end(1)) for m in re.finditer(r"(?:\"\"\"(?s:.*?)(?:\"\"\"|\Z)|'''(?s:.*?)(?:'''|\Z)|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*')|(#[^\n]*)", source) if m.group(1) is not None]


def _module_doc(source: str, language: str) -> str | None:
    """Documentation at the head of the file."""
    head = re.sub(r"\A#!(?!\[)[^\n]*\n?", "", source).lstrip()
    if language == "Python":
        head = re.sub(r"\A(?:[ \t]*#[^\n]*\n|\s*\n)*", "", head)
        m = re.match(r'"""(.*?)"""|\'\'\'(.*?)\'\'\'', head, re.S)
        return ((m.group(1) or m.group(2) or "").strip() or None) if m else None
    marks = ("//!", "///") if language == "Rust" else ("//",)
    if language != "Rust":
        m = re.match(r"/\*\*(.*?)\*/", head, re.S)
        if m:
            return "\n".join(x for x in (re.sub(r"^\s*\*?", "", line).strip() for line in m.group(1).split("\n")) if x) or None
    for mark in marks:
        lines = []
        for line in head.split("\n"):
            if not line.strip().startswith(mark):
                break
            lines.append(line.strip()[len(mark) :].strip())
        if lines:
            return "\n".join(lines).strip() or None
    return None


def _capped(record: dict[str, Any]) -> None:
    for name, most in (("symbols", MOST_SYMBOLS), ("calls", MOST_CALLS), ("imports", MOST_IMPORTS)):
        n = len(record[name])
        if n > most:
            record[name] = record[name][:most]
            warning = {"severity": "Warning", "message": f"{name} truncated: {n} exceeds {most}", "line": None, "byte_span": None}
            record["diagnostics"] = [*record["diagnostics"][: MOST_DIAGNOSTICS - 1], warning]


def parse_text(path: str, text: str | None) -> list[Any]:
    """The record of a text, as a list in the order of the record's fields, cards left empty.

    A null text or an unknown extension gives an empty record of language ``unknown`` with a warning. A broken text gives what could be found and an Error; where the grammar is broken is told by line where
    that is known.
    """
    language = language_of(path.rsplit("\x00", 1)[-1])
    card = {"card_version": 1, "est_tokens": 0, "text": ""}
    record: dict[str, Any] = {
        "ir_version": VERSION, "path": path, "language": language or "unknown", "content_hash": "", "byte_len": 0, "line_count": 0, "metrics": {"code_lines": 0, "comment_lines": 0, "blank_lines": 0}, "docstring": None,
        "symbols": [], "calls": [], "imports": [], "diagnostics": [], "retrieval_card": card, "symbol_cards": [],
    }
    if text is None or language is None:
        record["language"] = "unknown"
        record["diagnostics"] = [{"severity": "Warning", "message": "no text" if text is None else "unknown language", "line": None, "byte_span": None}]
        return list(record.values())
    raw = text.encode(errors="replace")
    record |= {"content_hash": hashlib.sha256(raw).hexdigest(), "byte_len": len(raw), "line_count": text.count("\n") + 1}
    broken: list[Unlexable] = []
    comments: list[tuple[int, int]]
    tokens: Tokens | None = None
    if language == "Python":
        walk: Any = _Python(path, text)
        comments = _python_comments(text)
    else:
        tokens = rust_tokens(text, broken) if language == "Rust" else js_tokens(text, broken)
        comments = tokens.comments
        walk = _Rust(path, text, tokens) if language == "Rust" else _Script(path, text, tokens, language == "TypeScript")
    try:
        walk.run()
    except RecursionError:
        record["diagnostics"].append({"severity": "Warning", "message": "nested too deeply", "line": None, "byte_span": None})
    imports = walk.imports * 2 if language == "TypeScript" else walk.imports  # both passes over a module's imports are kept
    record |= {"metrics": _metrics(text, comments), "docstring": _module_doc(text, language), "symbols": walk.symbols, "calls": walk.calls, "imports": imports}
    _resolved(record["calls"], record["symbols"], language)
    if broken or not (parses(text, language) if tokens is None or text.startswith("\ufeff") else tokens_follow(tokens, language)):
        at = broken[0].at if broken else None
        where = _Text(text)
        record["diagnostics"].insert(0, {"severity": "Error", "message": str(broken[0]) if broken else "syntax error", "line": where.line(at) if at is not None else None, "byte_span": [where.byte(at), len(raw)] if at is not None else None})
    _capped(record)
    return list(record.values())
