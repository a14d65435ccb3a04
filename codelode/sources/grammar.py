"""Whether a source text can be parsed in a language, and which languages' grammars it follows."""

from __future__ import annotations

import ast
import re
import warnings
from collections import Counter

from codelode.sources.lexing import Tokens, Unlexable, js_tokens, rust_tokens
from codelode.sources.rust_grammar import Broken, check_rust
from codelode.sources.script_grammar import check_script

#: Language of a path's extension, and other spellings of the languages.
EXTENSIONS = {"rs": "Rust", "ts": "TypeScript", "tsx": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "js": "JavaScript", "jsx": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "py": "Python", "pyi": "Python"}
LANGUAGES = ("Rust", "TypeScript", "JavaScript", "Python")

# Tokens that speak for a language, counted to rank languages; words first, then signs.
_SIGNS = {
    "Rust": (*"fn let mut impl pub use crate match struct enum trait self".split(), "::", "->", "=>", "!(", "#["),
    "TypeScript": (*"const let function import from export interface type readonly return new throw".split(), ": string", ": number", ": boolean", ": void", ": any", "=>", "===", ";\n"),
    "JavaScript": (*"const let var function import from export return new throw require module".split(), "=>", "===", ";\n"),
    "Python": (*"def import from self return raise None True False elif in not and".split(), ":\n", '"""', "\n@"),
}
_SIGN = re.compile("|".join([r"\w+", *(re.escape(x) + (r"\b" if x[-1].isalpha() else "") for x in sorted({x for signs in _SIGNS.values() for x in signs if not x.isalpha()}, key=lambda x: (-len(x), x)))]))
_SPEAKS = {x: [name for name, signs in _SIGNS.items() if x in signs] for signs in _SIGNS.values() for x in signs}
#: Characters of a text's beginning that may settle that it does not follow a grammar.
BEGINNING = 300


def language_of(path: str | None) -> str | None:
    """The language of a path's extension, None for any other."""
    return EXTENSIONS.get(path.rsplit(".", 1)[-1].lower()) if path and "." in path else None


def ranked(text: str) -> list[str]:
    """The languages, the one whose tokens are most frequent first."""
    points = dict.fromkeys(LANGUAGES, 0)
    for token, n in Counter(_SIGN.findall(text)).items():
        for language in _SPEAKS.get(token, ()):
            points[language] += n
    return sorted(LANGUAGES, key=lambda language: (-points[language], LANGUAGES.index(language)))


def _tokens(text: str, script: bool, known: dict) -> Tokens | None:
    """Tokens of a text, each kind once per text; None for a text that is no token sequence."""
    if script not in known:
        try:
            known[script] = js_tokens(text) if script else rust_tokens(text)
        except Unlexable:
            known[script] = None
    return known[script]


def _check(tokens: Tokens, language: str) -> None:
    check_rust(tokens) if language == "Rust" else check_script(tokens, language == "TypeScript")


def tokens_follow(tokens: Tokens, language: str) -> bool:
    """Whether tokens that were read already follow the grammar of a language other than Python; see ``parses``."""
    try:
        _check(tokens, language)
    except Broken:
        return False
    except (RecursionError, MemoryError):
        return True
    return True


def _broken_from_the_start(text: str, language: str, known: dict) -> bool:
    """Whether the text's beginning settles that it breaks the grammar: the parser fails before any bracket that the beginning leaves open, so nothing that follows can mend it."""
    script = language != "Rust"
    if len(text) < 1.5 * BEGINNING or script in known:
        return False
    if ("start", script) not in known:
        known["start", script] = js_tokens(text[:BEGINNING], []) if script else rust_tokens(text[:BEGINNING], [])
    tokens = known["start", script]
    last = len(tokens.kind) - 1
    settled = min([last - 3, *(a for a, b in tokens.match.items() if b == last)])
    try:
        _check(tokens, language)
    except Broken as error:
        return error.at < settled
    except (RecursionError, MemoryError, IndexError):  # an open bracket has no partner to look at
        return False
    return False


def _follows(text: str, language: str, known: dict, likely: bool = True) -> bool | None:
    if "\x00" in text and language == "Python":
        return False
    try:
        if language == "Python":
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                ast.parse(text)
        elif not likely and _broken_from_the_start(text, language, known):
            return False
        else:
            tokens = _tokens(text, language != "Rust", known)
            if tokens is None:
                return False
            _check(tokens, language)
    except SyntaxError as error:
        # limits of this parser, not of the language
        return None if "too many" in str(error.msg) else False
    except (Broken, ValueError):
        return False
    except (RecursionError, MemoryError):
        return None
    return True


def grammars(text: str) -> dict[str, bool | None]:
    """All languages, the likeliest by its tokens first, and whether the text follows the grammar; None where it is nested deeper than the parser can follow. An empty text follows all."""
    text = text.removeprefix("\ufeff")
    known: dict = {}
    return {language: _follows(text, language, known, k == 0) for k, language in enumerate(ranked(text))}


def parses(text: str, language: str) -> bool:
    """Whether the text follows the language's grammar. Names and types need not resolve; an empty text is valid; a text nested deeper than this parser can follow counts as valid."""
    return _follows(text.removeprefix("\ufeff"), language, {}) is not False
