"""Does a token sequence follow the grammar of JavaScript (module or script) or TypeScript? A recursive descent over token kinds that builds nothing."""

from __future__ import annotations

from codelode.sources.lexing import JS_WORDS, Tokens
from codelode.sources.rust_grammar import Broken

# Signs and words that join two values; those before a value; what a value may begin with.
_BINARY = frozenset("+ - * / % ** & | ^ << >> >>> && || ?? == != === !== < > <= >= instanceof in".split())
_ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
_PREFIX = frozenset("! - + ~ typeof void delete".split())
_SIMPLE = frozenset("n s r t this null true false".split())
_STARTS = frozenset("i n s r t t( this null true false ( [ { function class new import super ! - + ~ typeof void delete ++ -- #".split())
_MODIFIERS = frozenset("public private protected readonly static abstract override declare async get set accessor".split())
_PARAMETER_MODIFIERS = frozenset("public private protected readonly override".split())
_TYPE_WORDS = frozenset("void null true false this n s t typeof".split())
_NAME_ENDS = frozenset(["(", "=", ";", ":", "}", "?", "!", ",", "<", ""])


def check_script(tokens: Tokens, typed: bool) -> None:
    """Raises Broken unless the tokens form a module or script; ``typed``: TypeScript."""
    kind, text, newline, match = list(tokens.kind), tokens.text, tokens.newline, tokens.match
    p = 0
    functions = 0
    allow_in = True

    def need(k: str) -> None:
        nonlocal p
        if kind[p] != k:
            raise Broken(p)
        p += 1

    def word(w: str) -> bool:
        return kind[p] == "i" and text[p] == w

    def end_statement() -> None:
        nonlocal p
        if kind[p] == ";":
            p += 1
        elif not (newline[p] or kind[p] == "}"):
            raise Broken(p)

    def tried(f) -> bool:  # noqa: ANN001
        """Runs ``f``; back to where it began if that breaks."""
        nonlocal p
        start, saved = p, None
        try:
            f()
        except Broken:
            p = start
            return False
        return True

    # --- types

    def close_angle() -> None:
        nonlocal p
        k = kind[p]
        if k == ">":
            p += 1
        elif k[:1] == ">" and len(k) > 1:
            kind[p] = k[1:]
        else:
            raise Broken(p)

    def type_arguments() -> None:
        nonlocal p
        need("<")
        while True:
            type_()
            if kind[p] == ",":
                p += 1
            else:
                break
        close_angle()

    def type_parameters() -> None:
        nonlocal p
        need("<")
        while kind[p] != ">":
            while word("in") or kind[p] in ("in", "const") or word("out") and kind[p + 1] == "i":
                p += 1
            need("i")
            if kind[p] == "extends":
                p += 1
                type_()
            if kind[p] == "=":
                p += 1
                type_()
            if kind[p] == ",":
                p += 1
            else:
                break
        close_angle()

    def type_() -> None:
        nonlocal p
        if kind[p] == "i" and text[p] == "asserts" and kind[p + 1] in ("i", "this") and not newline[p + 1]:
            p += 2
            if word("is"):
                p += 1
                type_()
            return
        if kind[p] in ("i", "this") and kind[p + 1] == "i" and text[p + 1] == "is" and not newline[p + 1]:
            p += 2
            type_()
            return
        if kind[p] == "new" or kind[p] == "i" and text[p] == "abstract" and kind[p + 1] == "new":
            p += 1 if kind[p] == "new" else 2
            if kind[p] == "<":
                type_parameters()
            parameters()
            need("=>")
            type_()
            return
        if kind[p] == "<":
            type_parameters()
            parameters()
            need("=>")
            type_()
            return
        if kind[p] == "(" and kind[match[p] + 1] == "=>":
            parameters()
            need("=>")
            type_()
            return
        union()
        if kind[p] == "extends" and not newline[p]:
            p += 1
            union()
            need("?")
            type_()
            need(":")
            type_()

    def union() -> None:
        nonlocal p
        if kind[p] in ("|", "&"):
            p += 1
        operand()
        while kind[p] in ("|", "&"):
            p += 1
            if kind[p] == "(" and kind[match[p] + 1] == "=>":
                type_()
            else:
                operand()

    def operand() -> None:
        nonlocal p
        k = kind[p]
        if k == "i" and text[p] in ("keyof", "unique", "readonly", "infer") and (kind[p + 1] in ("i", "{", "[", "(", "typeof", "this") and not newline[p + 1]):
            p += 1
            operand()
            if text[p - 2] == "infer" and kind[p] == "extends":
                tried(infer_bound)
            return
        if k == "i":
            p += 1
            while kind[p] == "." :
                p += 1
                name()
            if kind[p] == "<" and not newline[p]:
                type_arguments()
        elif k == "typeof":
            p += 1
            if kind[p] not in ("i", "this", "import"):
                raise Broken(p)
            p += 1
            if kind[p] == "(":
                p = match[p] + 1
            while kind[p] == ".":
                p += 1
                name()
            if kind[p] == "<" and not newline[p]:
                type_arguments()
        elif k in _TYPE_WORDS:
            p += 1
        elif k == "-":
            p += 1
            need("n")
        elif k == "t(":
            p += 1
            type_()
            while kind[p] == "t,":
                p += 1
                type_()
            need("t)")
        elif k == "(":
            p += 1
            type_()
            need(")")
        elif k == "[":
            p += 1
            while kind[p] != "]":
                if kind[p] == "...":
                    p += 1
                if kind[p] == "i" and (kind[p + 1] == ":" or kind[p + 1] == "?" and kind[p + 2] == ":"):
                    p += 2 if kind[p + 1] == ":" else 3
                type_()
                if kind[p] == "?":
                    p += 1
                if kind[p] == ",":
                    p += 1
                else:
                    break
            need("]")
        elif k == "{":
            object_type()
        elif k == "import":
            p += 1
            need("(")
            type_()
            need(")")
            while kind[p] == ".":
                p += 1
                name()
            if kind[p] == "<":
                type_arguments()
        else:
            raise Broken(p)
        while kind[p] == "[" and not newline[p]:
            p += 1
            if kind[p] != "]":
                type_()
            need("]")

    def infer_bound() -> None:
        nonlocal p
        p += 1
        union()
        if kind[p] == "?":
            raise Broken(p)

    def object_type() -> None:
        nonlocal p
        p += 1
        while kind[p] != "}":
            type_member()
            if kind[p] in (";", ","):
                p += 1
            elif kind[p] != "}" and not newline[p]:
                raise Broken(p)
        p += 1

    def type_member() -> None:
        nonlocal p
        while kind[p] in ("+", "-") or word("readonly") and kind[p + 1] not in _NAME_ENDS:
            p += 1
        if kind[p] == "(" or kind[p] == "<":
            signature()
            return
        if kind[p] == "new" and kind[p + 1] in ("(", "<"):
            p += 1
            signature()
            return
        if kind[p] == "i" and text[p] in ("get", "set") and kind[p + 1] not in _NAME_ENDS:
            p += 1
        if kind[p] == "[" and kind[p + 1] == "i" and kind[p + 2] in (":", "in"):
            p += 3
            type_()
            if word("as"):
                p += 1
                type_()
            need("]")
            if kind[p] in ("+", "-"):
                p += 1
        else:
            property_name()
        if kind[p] == "?":
            p += 1
        if kind[p] == "(" or kind[p] == "<":
            signature()
        elif kind[p] == ":":
            p += 1
            type_()

    def signature() -> None:
        nonlocal p
        if kind[p] == "<":
            type_parameters()
        parameters()
        if kind[p] == ":":
            p += 1
            type_()

    def annotation() -> None:
        nonlocal p
        if typed and kind[p] == ":":
            p += 1
            type_()

    # --- names, patterns, parameters

    def name() -> None:
        """Any word."""
        nonlocal p
        if kind[p] == "i" or kind[p] in JS_WORDS:
            p += 1
        else:
            raise Broken(p)

    def property_name() -> None:
        nonlocal p
        k = kind[p]
        if k == "i" or k == "s" or k == "n" or k in JS_WORDS:
            p += 1
        elif k == "[":
            p += 1
            assignment_in()
            need("]")
        elif k == "#" and kind[p + 1] == "i":
            p += 2
        else:
            raise Broken(p)

    def pattern() -> None:
        nonlocal p
        k = kind[p]
        if k == "i":
            p += 1
        elif k == "[":
            p += 1
            while kind[p] != "]":
                if kind[p] == ",":
                    p += 1
                    continue
                if kind[p] == "...":
                    p += 1
                pattern()
                default()
                if kind[p] == ",":
                    p += 1
                else:
                    break
            need("]")
        elif k == "{":
            p += 1
            while kind[p] != "}":
                if kind[p] == "...":
                    p += 1
                    pattern()
                else:
                    plain = kind[p] == "i"
                    property_name()
                    if kind[p] == ":":
                        p += 1
                        pattern()
                    elif not plain:
                        raise Broken(p)
                    default()
                if kind[p] == ",":
                    p += 1
                else:
                    break
            need("}")
        else:
            raise Broken(p)

    def default() -> None:
        nonlocal p
        if kind[p] == "=":
            p += 1
            assignment_in()

    def parameters() -> None:
        nonlocal p
        need("(")
        while kind[p] != ")":
            decorators()
            if typed:
                while kind[p] == "i" and text[p] in _PARAMETER_MODIFIERS and kind[p + 1] in ("i", "{", "["):
                    p += 1
            rest = kind[p] == "..."
            if rest:
                p += 1
            if kind[p] == "this" and typed:
                p += 1
            else:
                pattern()
            if typed and kind[p] == "?":
                p += 1
            annotation()
            if not rest:
                default()
            if kind[p] == "," and not rest:
                p += 1
            else:
                break
        need(")")

    def body() -> None:
        nonlocal functions, allow_in
        functions += 1
        before, allow_in = allow_in, True
        block()
        allow_in = before
        functions -= 1

    def function_rest(may_lack_body: bool = False) -> None:
        nonlocal p
        if typed and kind[p] == "<":
            type_parameters()
        parameters()
        annotation()
        if may_lack_body and kind[p] != "{":
            end_statement()
        else:
            body()

    def function() -> None:
        nonlocal p
        p += 1
        if kind[p] == "*":
            p += 1
        if kind[p] == "i":
            p += 1
        function_rest()

    def decorators() -> None:
        nonlocal p
        while kind[p] == "@":
            p += 1
            if kind[p] == "(":
                p = match[p] + 1
                continue
            need("i")
            while kind[p] == ".":
                p += 1
                name()
            if kind[p] == "(":
                arguments()

    # --- classes

    def class_() -> None:
        nonlocal p
        need("class")
        if kind[p] == "i" and not (text[p] == "implements" and kind[p + 1] == "i"):
            p += 1
        if typed and kind[p] == "<":
            type_parameters()
        if kind[p] == "extends":
            p += 1
            call_chain()
            if typed and kind[p] == "<":
                type_arguments()
        if typed and word("implements"):
            p += 1
            while True:
                operand()
                if kind[p] == ",":
                    p += 1
                else:
                    break
        need("{")
        while kind[p] != "}":
            if kind[p] == ";":
                p += 1
            else:
                member()
        p += 1

    def member() -> None:
        nonlocal p
        decorators()
        if word("static") and kind[p + 1] == "{":
            p += 1
            block()
            return
        while kind[p] == "i" and text[p] in _MODIFIERS and kind[p + 1] not in _NAME_ENDS and (kind[p + 1] != "*" or text[p] in ("async", "static")):
            if not typed and text[p] not in ("static", "async", "get", "set", "accessor"):
                break
            if newline[p + 1] and text[p] in ("async", "get", "set") and kind[p + 1] != "*":
                break
            p += 1
        if kind[p] == "*":
            p += 1
        if typed and kind[p] == "[" and kind[p + 1] == "i" and kind[p + 2] == ":":
            p += 3
            type_()
            need("]")
            annotation()
            end_statement()
            return
        property_name()
        if typed and kind[p] in ("?", "!"):
            p += 1
        if kind[p] == "(" or typed and kind[p] == "<":
            function_rest(typed)
            return
        annotation()
        if kind[p] == "=":
            nonlocal functions
            p += 1
            functions += 1
            assignment_in()
            functions -= 1
        end_statement()

    # --- expressions

    def assignment_in() -> None:
        nonlocal allow_in
        before, allow_in = allow_in, True
        assignment()
        allow_in = before

    def expression() -> None:
        nonlocal p
        assignment()
        while kind[p] == ",":
            p += 1
            assignment()

    def expression_in() -> None:
        nonlocal allow_in
        before, allow_in = allow_in, True
        expression()
        allow_in = before

    def arrow_body() -> None:
        nonlocal p
        if newline[p]:
            raise Broken(p)
        need("=>")
        if kind[p] == "{":
            body()
        else:
            assignment()

    def typed_arrow() -> None:
        nonlocal p
        if kind[p] == "<":
            type_parameters()
        parameters()
        if kind[p] == ":":
            p += 1
            type_()
        if kind[p] != "=>":
            raise Broken(p)
        arrow_body()

    def assignment() -> None:
        nonlocal p
        k = kind[p]
        if k == "i":
            if kind[p + 1] == "=>":
                p += 1
                arrow_body()
                return
            t = text[p]
            if t == "async" and not newline[p + 1]:
                if kind[p + 1] == "i" and kind[p + 2] == "=>":
                    p += 2
                    arrow_body()
                    return
                if kind[p + 1] == "(" and kind[match[p + 1] + 1] == "=>" or typed and (kind[p + 1] == "<" or kind[p + 1] == "(" and kind[match[p + 1] + 1] == ":"):
                    start = p
                    p += 1
                    if tried(typed_arrow):
                        return
                    p = start
            elif t == "yield" and functions:
                p += 1
                if kind[p] == "*":
                    p += 1
                    assignment()
                elif not newline[p] and kind[p] in _STARTS:
                    assignment()
                return
        elif k == "(":
            after = kind[match[p] + 1]
            if after == "=>":
                parameters()
                arrow_body()
                return
            if typed and after == ":" and tried(typed_arrow):
                return
        elif k == "<" and typed:
            if tried(typed_arrow):
                return
            type_arguments()
            unary()
            return
        start = p
        target = binary()
        k = kind[p]
        if k == "?":
            p += 1
            assignment_in()
            need(":")
            assignment()
        elif k in _ASSIGN:
            if not target or kind[start] in _PREFIX:
                raise Broken(p)
            p += 1
            assignment()

    def binary() -> bool:
        """Whether the value could be assigned to."""
        nonlocal p
        target = unary()
        while True:
            k = kind[p]
            if k in _BINARY:
                if k == "in" and not allow_in:
                    return target
                p += 1
                if kind[p] == "#" and kind[p + 1] == "i":
                    p += 2
                else:
                    unary()
                target = False
            elif k == "i" and typed and not newline[p] and text[p] in ("as", "satisfies"):
                p += 1
                if kind[p] == "const":
                    p += 1
                else:
                    type_()
            else:
                return target

    def unary() -> bool:
        nonlocal p
        prefixed = False
        while True:
            k = kind[p]
            if k in _PREFIX:
                p += 1
            elif k == "++" or k == "--":
                p += 1
                if not unary():
                    raise Broken(p)
                return False
            elif k == "i" and text[p] == "await" and kind[p + 1] in _STARTS and not newline[p + 1] and kind[p + 1] not in ("(", "[", "-", "+", "t", "t(", "++", "--"):
                p += 1
            elif k == "<" and typed and prefixed:
                type_arguments()
            else:
                break
            prefixed = True
        target = call_chain()
        if kind[p] in ("++", "--") and not newline[p]:
            if not target:
                raise Broken(p)
            p += 1
            return False
        return target and not prefixed

    def generic_call() -> None:
        type_arguments()
        if kind[p] not in ("(", "t", "t(", ")", "]", "}", ",", ";", ":", "=", "?", "", "."):
            raise Broken(p)

    def call_chain() -> bool:
        nonlocal p
        target = primary()
        while True:
            k = kind[p]
            if k == "." or k == "?.":
                p += 1
                if k == "?." and kind[p] in ("(", "["):
                    continue
                if kind[p] == "#":
                    p += 1
                name()
                target = k == "."
            elif k == "(":
                arguments()
                target = False
            elif k == "[":
                p += 1
                expression_in()
                need("]")
                target = True
            elif k == "t":
                p += 1
                target = False
            elif k == "t(":
                template()
                target = False
            elif k == "!" and typed and not newline[p] and kind[p + 1] not in ("i",):
                p += 1
            elif k == "<" and typed:
                if not tried(generic_call):
                    return target
                target = False
            else:
                return target

    def template() -> None:
        nonlocal p
        p += 1
        expression_in()
        while kind[p] == "t,":
            p += 1
            expression_in()
        need("t)")

    def arguments() -> None:
        nonlocal p, allow_in
        p += 1
        before, allow_in = allow_in, True
        while kind[p] != ")":
            if kind[p] == "...":
                p += 1
            assignment()
            if kind[p] == ",":
                p += 1
            else:
                break
        allow_in = before
        need(")")

    def primary() -> bool:
        nonlocal p, allow_in
        k = kind[p]
        if k == "i":
            if text[p] == "async" and kind[p + 1] == "function" and not newline[p + 1]:
                p += 1
                function()
                return False
            p += 1
            return True
        if k in _SIMPLE:
            p += 1
            return False
        if k == "(":
            p += 1
            before, allow_in = allow_in, True
            start = p
            target = False
            if kind[p] == ")":
                raise Broken(p)
            expression()
            # a bracketed name or member may be assigned to
            target = kind[start] in ("i", "this") and kind[p - 1] in ("i", "]")
            allow_in = before
            need(")")
            return target
        if k == "[":
            p += 1
            before, allow_in = allow_in, True
            while kind[p] != "]":
                if kind[p] == ",":
                    p += 1
                    continue
                if kind[p] == "...":
                    p += 1
                assignment()
                if kind[p] == ",":
                    p += 1
                else:
                    break
            allow_in = before
            need("]")
            return kind[p] == "="
        if k == "{":
            object_()
            return kind[p] == "="
        if k == "function":
            function()
            return False
        if k == "class":
            class_()
            return False
        if k == "@":
            decorators()
            class_()
            return False
        if k == "new":
            p += 1
            if kind[p] == ".":
                p += 1
                need("i")
                return False
            if kind[p] == "new":
                primary()
            else:
                primary()
            while True:
                k = kind[p]
                if k == ".":
                    p += 1
                    if kind[p] == "#":
                        p += 1
                    name()
                elif k == "[":
                    p += 1
                    expression_in()
                    need("]")
                elif k == "<" and typed:
                    if not tried(generic_call):
                        break
                else:
                    break
            if kind[p] == "(":
                arguments()
            return False
        if k == "t(":
            template()
            return False
        if k == "super":
            p += 1
            if kind[p] not in ("(", ".", "["):
                raise Broken(p)
            return False
        if k == "import":
            p += 1
            if kind[p] == ".":
                p += 1
                need("i")
                return False
            if kind[p] != "(":
                raise Broken(p)
            return False
        raise Broken(p)

    def object_() -> None:
        nonlocal p, allow_in
        p += 1
        before, allow_in = allow_in, True
        while kind[p] != "}":
            if kind[p] == "...":
                p += 1
                assignment()
            else:
                if kind[p] == "i" and text[p] in ("get", "set", "async") and kind[p + 1] not in ("(", ",", ":", "}", "=", "<"):
                    p += 1
                if kind[p] == "*":
                    p += 1
                plain = kind[p] == "i"
                property_name()
                if kind[p] == ":":
                    p += 1
                    assignment()
                elif kind[p] == "(" or typed and kind[p] == "<":
                    function_rest()
                elif kind[p] == "=" and plain:
                    p += 1
                    assignment()
                elif not plain:
                    raise Broken(p)
            if kind[p] == ",":
                p += 1
            else:
                break
        allow_in = before
        need("}")

    # --- statements

    def block() -> None:
        nonlocal p
        need("{")
        while kind[p] != "}":
            statement()
        p += 1

    def declarations(in_for: bool = False) -> None:
        nonlocal p
        while True:
            simple = kind[p] == "i"
            pattern()
            if typed and kind[p] == "!" and kind[p + 1] == ":":
                p += 1
            annotation()
            if kind[p] == "=":
                p += 1
                assignment()
            elif not simple and not in_for:
                raise Broken(p)
            if kind[p] == ",":
                p += 1
            else:
                return

    def parenthesised() -> None:
        need("(")
        expression_in()
        need(")")

    def for_() -> None:
        nonlocal p, allow_in
        p += 1
        if word("await"):
            p += 1
        need("(")
        if kind[p] != ";":
            allow_in = False
            if kind[p] in ("var", "const") or word("let") and kind[p + 1] in ("i", "[", "{"):
                p += 1
                declarations(True)
            else:
                expression()
            allow_in = True
        if kind[p] == "in" or word("of"):
            p += 1
            expression()
            need(")")
        else:
            need(";")
            if kind[p] != ";":
                expression()
            need(";")
            if kind[p] != ")":
                expression()
            need(")")
        statement()

    def module_name() -> None:
        need("s")
        nonlocal p
        if (kind[p] == "with" or word("assert")) and kind[p + 1] == "{" and not newline[p]:
            p = match[p + 1] + 1

    def specifiers() -> None:
        nonlocal p
        need("{")
        while kind[p] != "}":
            if typed and word("type") and (kind[p + 1] == "i" and text[p + 1] != "as" or kind[p + 1] in JS_WORDS or kind[p + 1] == "i" and kind[p + 2] == "i"):
                p += 1
            if kind[p] == "s":
                p += 1
            else:
                name()
            if word("as"):
                p += 1
                if kind[p] == "s":
                    p += 1
                else:
                    name()
            if kind[p] == ",":
                p += 1
            else:
                break
        need("}")

    def import_() -> None:
        nonlocal p
        p += 1
        if kind[p] == "s":
            module_name()
            end_statement()
            return
        if typed and word("type") and (kind[p + 1] in ("{", "*") or kind[p + 1] == "i" and text[p + 1] != "from"):
            p += 1
        more = True
        if kind[p] == "i":
            p += 1
            if typed and kind[p] == "=":
                p += 1
                call_chain()
                end_statement()
                return
            more = kind[p] == ","
            if more:
                p += 1
        if more:
            if kind[p] == "*":
                p += 1
                if not word("as"):
                    raise Broken(p)
                p += 1
                need("i")
            else:
                specifiers()
        if not word("from"):
            raise Broken(p)
        p += 1
        module_name()
        end_statement()

    def export() -> None:
        nonlocal p
        p += 1
        if kind[p] == "default":
            p += 1
            if kind[p] == "function" or word("async") and kind[p + 1] == "function":
                if kind[p] != "function":
                    p += 1
                p += 1
                if kind[p] == "*":
                    p += 1
                if kind[p] == "i":
                    p += 1
                function_rest(typed)
            elif kind[p] in ("class", "@"):
                decorators()
                class_()
            elif typed and word("abstract") and kind[p + 1] == "class":
                p += 1
                class_()
            elif typed and word("interface") and kind[p + 1] == "i":
                statement()
            else:
                assignment()
                end_statement()
            return
        if typed and word("type") and kind[p + 1] in ("{", "*"):
            p += 1
        if kind[p] == "*":
            p += 1
            if word("as"):
                p += 1
                name()
            if not word("from"):
                raise Broken(p)
            p += 1
            module_name()
            end_statement()
        elif kind[p] == "{":
            specifiers()
            if word("from"):
                p += 1
                module_name()
            end_statement()
        elif typed and kind[p] == "=":
            p += 1
            assignment()
            end_statement()
        elif typed and word("as") and kind[p + 1] == "i" and text[p + 1] == "namespace":
            p += 2
            need("i")
            end_statement()
        elif typed and kind[p] == "import":
            import_()
        elif kind[p] in ("var", "const", "function", "class", "enum", "@") or kind[p] == "i" and text[p] in ("let", "async", "type", "interface", "namespace", "module", "declare", "abstract"):
            if kind[p] == "i" and kind[p + 1] in (";", "=", ".", "("):
                raise Broken(p)
            statement()
        else:
            raise Broken(p)

    def enum() -> None:
        nonlocal p
        need("enum")
        need("i")
        need("{")
        while kind[p] != "}":
            property_name()
            if kind[p] == "=":
                p += 1
                assignment_in()
            if kind[p] == ",":
                p += 1
            else:
                break
        need("}")

    def typed_statement() -> bool:
        """A declaration that only TypeScript has, if one begins here."""
        nonlocal p
        t = text[p]
        if kind[p + 1] == "" or newline[p + 1]:
            return False
        if t == "interface" and kind[p + 1] == "i":
            p += 2
            if kind[p] == "<":
                type_parameters()
            if kind[p] == "extends":
                p += 1
                while True:
                    operand()
                    if kind[p] == ",":
                        p += 1
                    else:
                        break
            if kind[p] != "{":
                raise Broken(p)
            object_type()
        elif t == "type" and kind[p + 1] == "i":
            p += 2
            if kind[p] == "<":
                type_parameters()
            need("=")
            type_()
            end_statement()
        elif t in ("namespace", "module") and kind[p + 1] in ("i", "s"):
            p += 2
            while kind[p] == ".":
                p += 1
                need("i")
            if kind[p] == "{":
                block()
            else:
                end_statement()
        elif t == "declare" and (kind[p + 1] in ("i", "var", "const", "function", "class", "enum")):
            p += 1
            if word("global"):
                p += 1
                block()
            elif kind[p] in ("var", "const") and kind[p + 1] != "enum" or word("let"):
                p += 1
                declarations(True)
                end_statement()
            else:
                statement()
        elif t == "abstract" and kind[p + 1] == "class":
            p += 1
            class_()
        else:
            return False
        return True

    def statement() -> None:
        nonlocal p
        k = kind[p]
        if k == "i":
            t = text[p]
            if kind[p + 1] == ":" :
                p += 2
                statement()
                return
            if t == "let" and kind[p + 1] in ("i", "[", "{") and not (kind[p + 1] == "i" and text[p + 1] in ("in", "of")):
                p += 1
                declarations()
                end_statement()
                return
            if t == "async" and kind[p + 1] == "function" and not newline[p + 1]:
                p += 2
                if kind[p] == "*":
                    p += 1
                need("i")
                function_rest(typed)
                return
            if typed and t in ("interface", "type", "namespace", "module", "declare", "abstract") and typed_statement():
                return
            expression()
            end_statement()
        elif k == "const" or k == "var":
            p += 1
            if typed and kind[p] == "enum":
                enum()
                return
            declarations()
            end_statement()
        elif k == "return":
            if not functions:
                raise Broken(p)
            p += 1
            if kind[p] not in (";", "}", "") and not newline[p]:
                expression()
            end_statement()
        elif k == "if":
            p += 1
            parenthesised()
            statement()
            if kind[p] == "else":
                p += 1
                statement()
        elif k == "for":
            for_()
        elif k == "{":
            block()
        elif k == "function":
            p += 1
            if kind[p] == "*":
                p += 1
            need("i")
            function_rest(typed)
        elif k == "class" or k == "@":
            decorators()
            if typed and word("abstract"):
                p += 1
            if kind[p] == "export":
                export()
                return
            if kind[p + 1] != "i":
                raise Broken(p)
            class_()
        elif k == "throw":
            p += 1
            if newline[p]:
                raise Broken(p)
            expression()
            end_statement()
        elif k == "import" and kind[p + 1] not in ("(", "."):
            if depth_of(p):
                raise Broken(p)
            import_()
        elif k == "export":
            export()
        elif k == ";":
            p += 1
        elif k == "while":
            p += 1
            parenthesised()
            statement()
        elif k == "do":
            p += 1
            statement()
            need("while")
            parenthesised()
            if kind[p] == ";":
                p += 1
        elif k == "break" or k == "continue":
            p += 1
            if kind[p] == "i" and not newline[p]:
                p += 1
            end_statement()
        elif k == "switch":
            p += 1
            parenthesised()
            need("{")
            while kind[p] != "}":
                if kind[p] == "default":
                    p += 1
                else:
                    need("case")
                    expression()
                need(":")
                while kind[p] not in ("case", "default", "}"):
                    statement()
            p += 1
        elif k == "try":
            p += 1
            block()
            if kind[p] == "catch":
                p += 1
                if kind[p] == "(":
                    p += 1
                    pattern()
                    annotation()
                    need(")")
                block()
                if kind[p] == "finally":
                    p += 1
                    block()
            else:
                need("finally")
                block()
        elif k == "debugger":
            p += 1
            end_statement()
        elif k == "with":
            p += 1
            parenthesised()
            statement()
        elif k == "enum" and typed:
            enum()
        else:
            expression()
            end_statement()

    def depth_of(_: int) -> int:
        return functions

    while kind[p]:
        statement()
