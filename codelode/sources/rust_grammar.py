"""Does a token sequence follow the grammar of Rust? A recursive descent over token kinds that builds nothing."""

from __future__ import annotations

from codelode.sources.lexing import Tokens


class Broken(ValueError):
    """The grammar is broken at token ``at``."""

    def __init__(self, at: int) -> None:
        super().__init__(at)
        self.at = at


# Signs that join two values, and words that begin items.
_BINARY = frozenset("+ - * / % ^ & | << >> && || == != < > <= >= = += -= *= /= %= ^= &= |= <<= >>=".split())
_ITEM_WORDS = frozenset("fn struct enum impl trait mod use const static type extern pub".split())
_BLOCK_LIKE = frozenset("if match loop while for unsafe {".split())
_LITERALS = frozenset("n s c true false".split())
_PATH_START = frozenset("i self Self super crate ::".split())
_NO_VALUE = frozenset(["}", ")", "]", ";", ",", "", "=>", "{"])


def check_rust(tokens: Tokens) -> None:
    """Raises Broken unless the tokens form a Rust file."""
    kind, text, match = tokens.kind, tokens.text, tokens.match
    p = 0

    def need(k: str) -> None:
        nonlocal p
        if kind[p] != k:
            raise Broken(p)
        p += 1

    def close_angle() -> None:
        nonlocal p
        k = kind[p]
        if k == ">":
            p += 1
        elif k and k[0] == ">" and len(k) > 1:
            kind[p] = k[1:]
        else:
            raise Broken(p)

    def attributes(inner: bool) -> None:
        nonlocal p
        while kind[p] == "#":
            q = p + 1
            if kind[q] == "!":
                if not inner:
                    raise Broken(p)
                q += 1
            if kind[q] != "[":
                raise Broken(p)
            p = match[q] + 1

    def visibility() -> None:
        nonlocal p
        if kind[p] == "pub":
            p += 1
            if kind[p] == "(" and kind[p + 1] in ("crate", "self", "super", "in"):
                p = match[p] + 1

    # --- paths and types

    def generic_args() -> None:
        nonlocal p
        p += 1
        while kind[p] not in (">", ">>", ">=", ">>="):
            if kind[p] == "l":
                p += 1
                if kind[p] == "+":
                    p -= 1
                    type_()
            elif kind[p] in _LITERALS:
                p += 1
            elif kind[p] == "-" and kind[p + 1] == "n":
                p += 2
            elif kind[p] == "{":
                block()
            elif kind[p] == "i" and kind[p + 1] == "=":
                p += 2
                type_()
            elif kind[p] == "i" and kind[p + 1] == ":" :
                p += 2
                bounds()
            else:
                type_()
                if kind[p] == "=":
                    p += 1
                    type_()
            if kind[p] == ",":
                p += 1
            else:
                break
        close_angle()

    def path_type() -> None:
        nonlocal p
        if kind[p] == "<":
            p += 1
            type_()
            if kind[p] == "as":
                p += 1
                path_type()
            close_angle()
            need("::")
        elif kind[p] == "::":
            p += 1
        while True:
            if kind[p] not in ("i", "self", "Self", "super", "crate"):
                raise Broken(p)
            p += 1
            if kind[p] == "::" and kind[p + 1] == "<":
                p += 1
            if kind[p] == "<":
                generic_args()
            elif kind[p] == "(" :
                p += 1
                types_until(")")
                if kind[p] == "->":
                    p += 1
                    type_(False)
            if kind[p] == "::":
                p += 1
            else:
                return

    def types_until(end: str) -> None:
        nonlocal p
        while kind[p] != end:
            if kind[p] == "i" and kind[p + 1] == ":":
                p += 2
            elif kind[p] == "..." :
                p += 1
                break
            type_()
            if kind[p] == ",":
                p += 1
            else:
                break
        need(end)

    def bounds() -> None:
        nonlocal p
        while kind[p] in ("l", "?", "for", "(", "~") or kind[p] in _PATH_START or kind[p] == "<":
            if kind[p] == "l":
                p += 1
            elif kind[p] == "(":
                p += 1
                bounds()
                need(")")
            else:
                if kind[p] == "?":
                    p += 1
                if kind[p] == "for":
                    p += 1
                    generics()
                path_type()
            if kind[p] == "+":
                p += 1
            else:
                return

    def type_(plus: bool = True) -> None:
        nonlocal p
        k = kind[p]
        if k == "i" or k in _PATH_START or k == "<":
            if k == "i" and kind[p + 1] == "!":
                p += 2
                tree()
                return
            path_type()
            if plus and kind[p] == "+" and (kind[p + 1] == "l" or kind[p + 1] == "i"):
                p += 1
                bounds()
        elif k == "&" or k == "&&":
            p += 1
            if kind[p] == "l":
                p += 1
            if kind[p] == "mut":
                p += 1
            type_(False)
        elif k == "[":
            p += 1
            type_()
            if kind[p] == ";":
                p += 1
                expression()
            need("]")
        elif k == "(":
            p += 1
            types_until(")")
        elif k == "*":
            p += 1
            if kind[p] not in ("const", "mut"):
                raise Broken(p)
            p += 1
            type_(False)
        elif k == "!":
            p += 1
        elif k in ("impl", "dyn"):
            p += 1
            bounds()
        elif k in ("fn", "unsafe", "extern"):
            while kind[p] in ("unsafe", "extern", "s"):
                p += 1
            need("fn")
            need("(")
            types_until(")")
            if kind[p] == "->":
                p += 1
                type_(False)
        elif k == "for":
            p += 1
            generics()
            type_()
        else:
            raise Broken(p)

    def generics() -> None:
        nonlocal p
        if kind[p] != "<":
            return
        p += 1
        while kind[p] not in (">", ">>", ">=", ">>="):
            attributes(False)
            if kind[p] == "const":
                p += 1
                need("i")
                need(":")
                type_()
                if kind[p] == "=":
                    p += 1
                    if kind[p] == "{":
                        block()
                    else:
                        if kind[p] == "-":
                            p += 1
                        p += 1
            else:
                if kind[p] not in ("l", "i"):
                    raise Broken(p)
                p += 1
                if kind[p] == ":":
                    p += 1
                    bounds()
                if kind[p] == "=":
                    p += 1
                    type_()
            if kind[p] == ",":
                p += 1
            else:
                break
        close_angle()

    def where() -> None:
        nonlocal p
        if kind[p] != "where":
            return
        p += 1
        while kind[p] not in ("{", ";", "=", ""):
            if kind[p] == "l":
                p += 1
            else:
                if kind[p] == "for":
                    p += 1
                    generics()
                type_()
            need(":")
            bounds()
            if kind[p] == ",":
                p += 1
            else:
                return

    # --- patterns

    def pattern() -> None:
        nonlocal p
        if kind[p] == "|":
            p += 1
        pattern_one()
        while kind[p] == "|":
            p += 1
            pattern_one()

    def pattern_range() -> None:
        nonlocal p
        if kind[p] in ("..=", "...", ".."):
            p += 1
            if kind[p] == "-":
                p += 1
            if kind[p] in _LITERALS:
                p += 1
            elif kind[p] in _PATH_START:
                path_expression()

    def patterns_until(end: str) -> None:
        nonlocal p
        while kind[p] != end:
            attributes(False)
            pattern()
            if kind[p] == ",":
                p += 1
            else:
                break
        need(end)

    def pattern_one() -> None:
        nonlocal p
        k = kind[p]
        if k in ("&", "&&"):
            p += 1
            if kind[p] == "mut":
                p += 1
            pattern_one()
        elif k in ("ref", "mut"):
            p += 1
            if kind[p] == "mut":
                p += 1
            if kind[p] not in ("i", "self"):
                raise Broken(p)
            p += 1
            if kind[p] == "@":
                p += 1
                pattern_one()
        elif k in _LITERALS or k == "-":
            if k == "-":
                p += 1
                if kind[p] != "n":
                    raise Broken(p)
            p += 1
            pattern_range()
        elif k in ("..", "..="):
            if k == "..":
                p += 1
                if kind[p] in _LITERALS:
                    p += 1
            else:
                pattern_range()
        elif k == "(":
            p += 1
            patterns_until(")")
        elif k == "[":
            p += 1
            patterns_until("]")
        elif k in _PATH_START or k == "<":
            if k == "i" and kind[p + 1] == "@":
                p += 2
                pattern_one()
                return
            path_expression()
            if kind[p] == "(":
                p += 1
                patterns_until(")")
            elif kind[p] == "{":
                p += 1
                while kind[p] != "}":
                    attributes(False)
                    if kind[p] == "..":
                        p += 1
                        break
                    if kind[p] in ("ref", "mut"):
                        pattern_one()
                    else:
                        if kind[p] not in ("i", "n"):
                            raise Broken(p)
                        p += 1
                        if kind[p] == ":":
                            p += 1
                            pattern()
                    if kind[p] == ",":
                        p += 1
                    else:
                        break
                need("}")
            elif kind[p] == "!":
                p += 1
                tree()
            else:
                pattern_range()
        else:
            raise Broken(p)

    # --- expressions

    def tree() -> None:
        nonlocal p
        if kind[p] not in ("(", "[", "{"):
            raise Broken(p)
        p = match[p] + 1

    def path_expression() -> None:
        nonlocal p
        if kind[p] == "<":
            p += 1
            type_()
            if kind[p] == "as":
                p += 1
                path_type()
            close_angle()
            need("::")
        elif kind[p] == "::":
            p += 1
        while True:
            if kind[p] not in ("i", "self", "Self", "super", "crate"):
                raise Broken(p)
            p += 1
            while kind[p] == "::" and kind[p + 1] == "<":
                p += 1
                generic_args()
            if kind[p] == "::":
                p += 1
            else:
                return

    def expressions_until(end: str) -> None:
        nonlocal p
        while kind[p] != end:
            attributes(False)
            expression()
            if kind[p] == ",":
                p += 1
            else:
                break
        need(end)

    def struct_fields() -> None:
        nonlocal p
        p += 1
        while kind[p] != "}":
            attributes(False)
            if kind[p] == "..":
                p += 1
                if kind[p] != "}":
                    expression()
                break
            if kind[p] not in ("i", "n"):
                raise Broken(p)
            p += 1
            if kind[p] == ":":
                p += 1
                expression()
            if kind[p] == ",":
                p += 1
            else:
                break
        need("}")

    def condition() -> None:
        """Condition of if or while; ``let`` chains."""
        expression(False)

    def if_() -> None:
        nonlocal p
        p += 1
        condition()
        block()
        while kind[p] == "else":
            p += 1
            if kind[p] == "if":
                p += 1
                condition()
                block()
            else:
                block()
                return

    def match_() -> None:
        nonlocal p
        p += 1
        expression(False)
        need("{")
        attributes(True)
        while kind[p] != "}":
            attributes(False)
            pattern()
            if kind[p] == "if":
                p += 1
                expression()
            need("=>")
            if kind[p] == "{":
                start = p
                block()
                if kind[p] == ",":
                    p += 1
                elif kind[p] in (".", "?"):
                    p = start
                    expression()
                    if kind[p] == ",":
                        p += 1
                    elif kind[p] != "}":
                        raise Broken(p)
            else:
                block_like = kind[p] in _BLOCK_LIKE
                expression()
                if kind[p] == ",":
                    p += 1
                elif kind[p] != "}" and not (block_like and kind[p - 1] == "}"):
                    raise Broken(p)
        p += 1

    def closure() -> None:
        nonlocal p
        if kind[p] == "||":
            p += 1
        else:
            need("|")
            while kind[p] != "|":
                attributes(False)
                pattern_one()
                if kind[p] == ":":
                    p += 1
                    type_()
                if kind[p] == ",":
                    p += 1
                else:
                    break
            need("|")
        if kind[p] == "->":
            p += 1
            type_(False)
            block()
        else:
            expression(struct)

    struct = True

    def block_expression() -> bool:
        """A block-like expression at this place, if there is one."""
        nonlocal p
        k = kind[p]
        if k == "l" and kind[p + 1] == ":":
            p += 2
            k = kind[p]
            if k not in ("loop", "while", "for", "{"):
                raise Broken(p)
        if k == "{":
            block()
        elif k == "if":
            if_()
        elif k == "match":
            match_()
        elif k == "loop":
            p += 1
            block()
        elif k == "while":
            p += 1
            condition()
            block()
        elif k == "for":
            p += 1
            pattern()
            need("in")
            expression(False)
            block()
        elif k == "unsafe" and kind[p + 1] == "{":
            p += 1
            block()
        elif k == "const" and kind[p + 1] == "{":
            p += 1
            block()
        elif k == "async" and (kind[p + 1] == "{" or kind[p + 1] == "move" and kind[p + 2] == "{"):
            p += 2 if kind[p + 1] == "move" else 1
            block()
        else:
            return False
        return True

    def postfix() -> None:
        nonlocal p
        while True:
            k = kind[p]
            if k == ".":
                p += 1
                k = kind[p]
                if k == "i" or k == "self":
                    p += 1
                    if kind[p] == "::":
                        p += 1
                        if kind[p] != "<":
                            raise Broken(p)
                        generic_args()
                        if kind[p] != "(":
                            raise Broken(p)
                elif k == "n" or k == "await":
                    p += 1
                else:
                    raise Broken(p)
            elif k == "(":
                p += 1
                with_struct(expressions_until, ")")
            elif k == "[":
                p += 1
                with_struct(index)
            elif k == "?":
                p += 1
            else:
                return

    def index() -> None:
        expression()
        need("]")

    def with_struct(f, *args) -> None:  # noqa: ANN001, ANN002
        nonlocal struct
        before, struct = struct, True
        f(*args)
        struct = before

    def in_parentheses() -> None:
        expressions_until(")")

    def in_brackets() -> None:
        nonlocal p
        if kind[p] == "]":
            p += 1
            return
        expression()
        if kind[p] == ";":
            p += 1
            expression()
            need("]")
            return
        if kind[p] == ",":
            p += 1
            expressions_until("]")
        else:
            need("]")

    def unary() -> None:
        nonlocal p
        while True:
            k = kind[p]
            if k in ("-", "!", "*"):
                p += 1
            elif k in ("&", "&&"):
                p += 1
                if kind[p] == "i" and text[p] == "raw" and kind[p + 1] in ("const", "mut"):
                    p += 2
                elif kind[p] == "mut":
                    p += 1
            else:
                break
        if k == "i" or k in _PATH_START or k == "<":
            path_expression()
            if kind[p] == "!" and kind[p + 1] in ("(", "[", "{"):
                p += 1
                tree()
            elif kind[p] == "{" and struct and struct_like():
                with_struct(struct_fields)
        elif k in _LITERALS:
            p += 1
        elif k == "(":
            p += 1
            with_struct(in_parentheses)
        elif k == "[":
            p += 1
            with_struct(in_brackets)
        elif k in ("|", "||"):
            closure()
            return
        elif k == "move" or k == "static" and kind[p + 1] in ("|", "||", "move"):
            p += 1
            unary()
            return
        elif k == "async" and kind[p + 1] in ("|", "||") or k == "async" and kind[p + 1] == "move" and kind[p + 2] in ("|", "||"):
            p += 1
            unary()
            return
        elif k == "return":
            p += 1
            if kind[p] not in _NO_VALUE or kind[p] == "{" and struct:
                expression(struct)
            return
        elif k == "break":
            p += 1
            if kind[p] == "l":
                p += 1
            if kind[p] not in _NO_VALUE or kind[p] == "{" and struct:
                expression(struct)
            return
        elif k == "continue":
            p += 1
            if kind[p] == "l":
                p += 1
            return
        elif k == "let":
            p += 1
            pattern()
            need("=")
            unary()
            return
        elif k in ("..", "..="):
            return
        elif not block_expression():
            raise Broken(p)
        postfix()
        while kind[p] == "as":
            p += 1
            type_(False)

    def struct_like() -> bool:
        """``{`` after a path: fields follow, or nothing."""
        a, b = kind[p + 1], kind[p + 2]
        return a == "}" or a == "#" or a in ("i", "n") and b in (":", ",", "}") or a == ".."

    def expression(with_struct_literals: bool = True) -> None:
        nonlocal p, struct
        before, struct = struct, with_struct_literals
        while True:
            if kind[p] not in ("..", "..="):
                unary()
            if kind[p] in ("..", "..="):
                p += 1
                if kind[p] in _NO_VALUE and not (kind[p] == "{" and struct):
                    break
                continue
            if kind[p] in _BINARY:
                p += 1
                continue
            break
        struct = before

    # --- statements and items

    def block() -> None:
        nonlocal p, struct
        need("{")
        before, struct = struct, True
        attributes(True)
        while kind[p] != "}":
            statement()
        p += 1
        struct = before

    def is_item() -> bool:
        k = kind[p]
        if k not in _ITEM_WORDS:
            if k in ("unsafe", "async"):
                return kind[p + 1] in ("fn", "impl", "trait", "extern", "mod") or kind[p + 1] == "unsafe"
            return k == "i" and (text[p] == "macro_rules" and kind[p + 1] == "!" or text[p] in ("union", "auto", "default") and kind[p + 1] in ("i", "trait", "impl", "fn"))
        return not (k == "const" and kind[p + 1] in ("{", "|", "||")) and not (k == "static" and kind[p + 1] in ("|", "||", "move"))

    def statement() -> None:
        nonlocal p
        if kind[p] == ";":
            p += 1
            return
        attributes(False)
        k = kind[p]
        if k == "let":
            p += 1
            pattern()
            if kind[p] == ":":
                p += 1
                type_()
            if kind[p] == "=":
                p += 1
                expression()
                if kind[p] == "else":
                    p += 1
                    block()
            need(";")
            return
        if is_item():
            item()
            return
        if k in _BLOCK_LIKE or k in ("l", "async", "const"):
            start = p
            if block_expression():
                if kind[p] == ";":
                    p += 1
                elif kind[p] in (".", "?"):
                    p = start
                    expression()
                    if kind[p] == ";":
                        p += 1
                    elif kind[p] != "}":
                        raise Broken(p)
                return
        if k == "i" and kind[p + 1] == "!" and kind[p + 2] == "{":
            p = match[p + 2] + 1
            if kind[p] == ";":
                p += 1
            elif kind[p] in (".", "?"):
                postfix()
                need(";")
            return
        expression()
        if kind[p] == ";":
            p += 1
        elif kind[p] != "}":
            raise Broken(p)

    def parameters() -> None:
        nonlocal p
        need("(")
        while kind[p] != ")":
            attributes(False)
            if kind[p] == "...":
                p += 1
                break
            q = p
            if kind[q] in ("&", "&&"):
                q += 1
                if kind[q] == "l":
                    q += 1
            if kind[q] == "mut":
                q += 1
            if kind[q] == "self":
                p = q + 1
                if kind[p] == ":":
                    p += 1
                    type_()
            else:
                pattern_one()
                need(":")
                if kind[p] == "...":
                    p += 1
                else:
                    type_()
            if kind[p] == ",":
                p += 1
            else:
                break
        need(")")

    def function() -> None:
        nonlocal p
        need("fn")
        need("i")
        generics()
        parameters()
        if kind[p] == "->":
            p += 1
            type_()
        where()
        if kind[p] == ";":
            p += 1
        else:
            block()

    def fields(end: str) -> None:
        nonlocal p
        p += 1
        while kind[p] != end:
            attributes(False)
            visibility()
            if end == "}":
                need("i")
                need(":")
            type_()
            if kind[p] == ",":
                p += 1
            else:
                break
        need(end)

    def use_tree() -> None:
        nonlocal p
        if kind[p] == "::":
            p += 1
        while True:
            if kind[p] == "*":
                p += 1
                return
            if kind[p] == "{":
                p += 1
                while kind[p] != "}":
                    use_tree()
                    if kind[p] == ",":
                        p += 1
                    else:
                        break
                need("}")
                return
            if kind[p] not in ("i", "self", "super", "crate", "Self"):
                raise Broken(p)
            p += 1
            if kind[p] == "as":
                p += 1
                need("i")
                return
            if kind[p] == "::":
                p += 1
            else:
                return

    def items_in_braces() -> None:
        nonlocal p
        need("{")
        attributes(True)
        while kind[p] != "}":
            item()
        p += 1

    def item() -> None:
        nonlocal p
        attributes(False)
        visibility()
        k = kind[p]
        if k == "i" and text[p] in ("default", "auto"):
            p += 1
            k = kind[p]
        if k == "use":
            p += 1
            use_tree()
            need(";")
        elif k == "struct" or k == "i" and text[p] == "union" and kind[p + 1] == "i":
            p += 1
            need("i")
            generics()
            where()
            if kind[p] == "{":
                fields("}")
            elif kind[p] == "(":
                fields(")")
                where()
                need(";")
            else:
                need(";")
        elif k == "enum":
            p += 1
            need("i")
            generics()
            where()
            need("{")
            while kind[p] != "}":
                attributes(False)
                visibility()
                need("i")
                if kind[p] == "{":
                    fields("}")
                elif kind[p] == "(":
                    fields(")")
                if kind[p] == "=":
                    p += 1
                    expression()
                if kind[p] == ",":
                    p += 1
                else:
                    break
            need("}")
        elif k == "impl" or k == "unsafe" and kind[p + 1] == "impl":
            p += 2 if k == "unsafe" else 1
            if kind[p] == "<" and kind[p + 1] != "i" or kind[p] == "<" and kind[p + 2] != "as":
                generics()
            if kind[p] == "!":
                p += 1
            if kind[p] == "const":
                p += 1
            type_()
            if kind[p] == "for":
                p += 1
                type_()
            where()
            items_in_braces()
        elif k == "trait" or k == "unsafe" and kind[p + 1] in ("trait", "i"):
            p += 2 if k == "unsafe" else 1
            need("i")
            generics()
            if kind[p] == ":":
                p += 1
                bounds()
            where()
            items_in_braces()
        elif k == "mod":
            p += 1
            need("i")
            if kind[p] == ";":
                p += 1
            else:
                items_in_braces()
        elif k == "type":
            p += 1
            need("i")
            generics()
            if kind[p] == ":":
                p += 1
                bounds()
            where()
            if kind[p] == "=":
                p += 1
                type_()
                where()
            need(";")
        elif k == "static" or k == "const" and kind[p + 1] not in ("fn", "unsafe", "async", "extern"):
            p += 1
            if kind[p] == "mut":
                p += 1
            need("i")
            if kind[p] == ":":
                p += 1
                type_()
            if kind[p] == "=":
                p += 1
                expression()
            need(";")
        elif k == "extern" and kind[p + 1] == "crate":
            p += 2
            if kind[p] not in ("i", "self"):
                raise Broken(p)
            p += 1
            if kind[p] == "as":
                p += 1
                need("i")
            need(";")
        elif k == "extern" and (kind[p + 1] == "{" or kind[p + 1] == "s" and kind[p + 2] == "{"):
            p += 1 if kind[p + 1] == "{" else 2
            items_in_braces()
        elif k in ("fn", "const", "async", "unsafe", "extern"):
            while kind[p] in ("const", "async", "unsafe", "extern", "s"):
                p += 1
            function()
        elif k == "i" and text[p] == "macro_rules" and kind[p + 1] == "!" and kind[p + 2] == "i":
            p += 3
            brace = kind[p] == "{"
            tree()
            if not brace:
                need(";")
        elif k in _PATH_START:
            path_expression()
            need("!")
            brace = kind[p] == "{"
            tree()
            if not brace:
                need(";")
        else:
            raise Broken(p)

    attributes(True)
    while kind[p]:
        if kind[p] == ";":
            p += 1
            continue
        item()
