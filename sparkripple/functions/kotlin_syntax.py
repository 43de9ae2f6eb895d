"""Reads a Kotlin source file: its package, imports, declarations and the types it names.

The lexer keeps a stack of modes, for templates inside strings inside templates,
and counts nested comments. The reader descends the grammar: a line break ends a
statement where the grammar lets it, and not inside round or square brackets.
Types count where they stand as types, as after colons, is, as and in type
arguments; calls of constructors and references by :: name none. Classes inside
functions and object expressions are no declarations of the file. A text that the
grammar doesn't take is a fault.
"""

from __future__ import annotations

import re
from contextlib import contextmanager

from sparkripple.functions.reading import END, Reader, SyntaxFault

#: The language's hard keywords. Fixed values.
KEYWORDS = frozenset("as break class continue do else false for fun if in interface is null object package return super this throw true try typealias typeof val var when while".split())
#: Words that are modifiers where a declaration follows. Fixed values.
MODIFIERS = frozenset(
    """public private internal protected abstract final open override lateinit enum sealed annotation data inner value
    companion const external actual expect infix inline noinline crossinline operator reified suspend tailrec vararg""".split()
)
DECLARES = frozenset("class interface object fun val var typealias constructor init".split())
BINARY = frozenset("* / % + - .. ..< < > <= >= == != === !== = += -= *= /= %= in !in".split())
#: Operators that may begin a line and go on with the expression before it.
LEADING = frozenset("?: && ||".split())
TOKEN = re.compile(
    r"""(?P<skip>[^\S\n]+|//[^\n]*)
    |(?P<line>\n)
    |(?P<comment>/\*)
    |(?P<quote>\"\"\"|")
    |(?P<n>'(?:[^'\\\n]|\\u[0-9a-fA-F]{4}|\\.)'|0[xX][0-9a-fA-F_]+[uU]?L?|0[bB][01_]+[uU]?L?|(?:[0-9][0-9_]*)?\.[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?[fF]?|[0-9][0-9_]*(?:[eE][+-]?[0-9_]+)?[fFuU]?L?)
    |(?P<cast>as\?)
    |(?P<jump>(?:return|break|continue|this|super)@(?:\w+|`[^`\n]+`))
    |(?P<label>(?:\w+|`[^`\n]+`)@(?![\w\[]))
    |(?P<i>[^\W\d]\w*|`[^`\n]+`)
    |(?P<o>!in\b|!is\b|\.\.<|\.\.|===|!==|->|\?\.|\?:|::|!!|\+\+|--|&&|\|\||[=!<>]=|[-+*/%]=|[-+*/%&!?:;,.(){}\[\]@=<>\#])""",
    re.X,
)
PIECE = {'"': re.compile(r'(?:[^"\\\n$]|\\.|\$(?!\{))*+'), '"""': re.compile(r'(?:[^"$]|\$(?!\{)|"(?!""))*+')}
COMMENT = re.compile(r"/\*|\*/")


def tokens(text: str) -> tuple[list[str], list[str], list[bool]]:
    """Kinds, texts, and whether a token is the first of its line; a string with templates is its q(uote), ${ expressions }, and the closing q."""
    kinds, texts, lines = [], [], []
    fresh, at, modes = True, 0, []  # of each open template the quote it stands in, and how many braces were open

    def put(kind: str, token: str) -> None:
        nonlocal fresh
        kinds.append(kind)
        texts.append(token)
        lines.append(fresh)
        fresh = False

    def string(quote: str) -> None:
        """From behind a quote or template to the end of the string or the next template."""
        nonlocal at
        at = PIECE[quote].match(text, at).end()
        if text.startswith("${", at):
            at += 2
            put("o", "${")
            modes.append([quote, 0])
        elif text.startswith(quote, at):
            at += len(quote)
            while quote == '"""' and text.startswith('"', at):  # quotes that belong to the text
                at += 1
            put("q", quote)
        else:
            raise SyntaxFault("unclosed string")

    if text.startswith("#!"):
        at = len(text.partition("\n")[0])
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SyntaxFault(f"unreadable at {text[at : at + 20]!r}")
        at, kind, token = m.end(), m.lastgroup, m.group()
        if kind == "line":
            fresh = True
        elif kind == "comment":
            depth = 1
            while depth:
                m = COMMENT.search(text, at)
                if not m:
                    raise SyntaxFault("unclosed comment")
                fresh = fresh or "\n" in text[at : m.start()]
                at, depth = m.end(), depth + (1 if m.group() == "/*" else -1)
        elif kind == "quote":
            put("q", token)
            string(token)
        elif kind == "cast":
            put("o", token)
        elif kind == "jump":
            put("k", token.partition("@")[0])
        elif kind == "i":
            put("k" if token in KEYWORDS else "i", token.strip("`"))
        elif kind in "no":
            put(kind, token)
            if modes and token == "{":
                modes[-1][1] += 1
            elif modes and token == "}":
                modes[-1][1] -= 1
                if modes[-1][1] < 0:
                    string(modes.pop()[0])
    if modes:
        raise SyntaxFault("unclosed template")
    return kinds, texts, lines


class Kotlin(Reader):
    def __init__(self, *found: list):
        super().__init__(*found)
        self.lines_end, self.hidden, self.trailing = True, 0, True
        self.top: list[tuple[bool, str]] = []
        self.jvm_name = False

    def fresh(self) -> bool:
        """Whether the token begins a line and line breaks count here."""
        return self.lines_end and self.first_of_line[self.at]

    @contextmanager
    def mode(self, lines_end: bool, hidden: bool = True):
        before = self.lines_end, self.trailing
        self.lines_end, self.trailing = lines_end, True
        self.hidden += hidden
        try:
            yield
        finally:
            self.lines_end, self.trailing = before
            self.hidden -= hidden

    def closed(self, one, opening: str, closing: str) -> None:
        """Items between brackets, a last comma allowed."""
        self.need(opening)
        with self.mode(False):
            while self.peek() != closing or self.kind() == "q":
                one()
                if not self.take(","):
                    break
            self.need(closing)

    # --- types ---

    def type(self) -> None:
        self.annotations()
        if self.peek() == "suspend" and self.kind(1) != "o" or self.peek() == "suspend" and self.peek(1) == "(":
            self.at += 1
        if self.peek() == "(":
            self.closed(self.type_parameter_or_type, "(", ")")
            if self.take("->"):
                return self.type()
        else:
            self.user_type()
        while self.take("?"):
            pass
        if self.peek() in (".", "?.") and self.peek(1) == "(":  # a function with a receiver
            self.at += 1
            self.closed(self.type_parameter_or_type, "(", ")")
            self.need("->")
            return self.type()
        if self.take("&"):
            self.type()
        return None

    def type_parameter_or_type(self) -> None:
        if self.kind() == "i" and self.peek(1) == ":":
            self.at += 2
        self.type()

    def user_type(self) -> str:
        place = len(self.refs)
        whole = self.name()
        if self.peek() == "<":
            self.type_arguments()
        while self.peek() == "." and self.kind(1) == "i":
            self.at += 1
            whole += "." + self.next()
            if self.peek() == "<":
                self.type_arguments()
        self.refs.insert(place, whole)
        return whole.rpartition(".")[2]

    def type_arguments(self) -> None:
        def one() -> None:
            if not self.take("*"):
                self.annotations()
                if self.peek() == "in" or self.peek() == "out" and self.kind(1) in "ik":
                    self.at += 1
                self.type()

        self.closed(one, "<", ">")

    def type_parameters(self) -> None:
        def one() -> None:
            self.modifiers(("in", "out", "reified"))
            self.name()
            if self.take(":"):
                self.type()

        if self.peek() == "<":
            self.closed(one, "<", ">")

    def where(self) -> None:
        if self.peek() == "where" and self.kind() == "i":
            self.at += 1
            self.listed(lambda: (self.annotations(), self.name(), self.need(":"), self.type()))

    # --- annotations and modifiers ---

    def annotations(self, file: bool = False) -> None:
        while self.peek() == "@" and (not file or self.peek(1) == "file" and self.peek(2) == ":"):
            self.at += 1
            if self.kind() == "i" and self.peek(1) == ":":
                self.at += 2
            if self.take("["):
                while not self.take("]"):
                    self.annotation(file)
            else:
                self.annotation(file)

    def annotation(self, file: bool) -> None:
        name = self.user_type()
        self.jvm_name |= file and name == "JvmName"
        if self.peek() == "(" and not self.first_of_line[self.at]:
            self.arguments()

    def modifiers(self, more: tuple[str, ...] = ()) -> list[str]:
        """Words that are modifiers, as one of more words follows on each."""
        out = []
        while True:
            self.annotations()
            word = self.peek()
            if word in more or self.kind() == "i" and word in MODIFIERS and (self.kind(1) in "ik" or self.peek(1) in ("@", "<", "(") and word in ("suspend", "inline")):
                out.append(self.next())
            elif word == "context" and self.peek(1) == "(" and self.kind() == "i":
                self.at += 1
                self.closed(self.type_parameter_or_type, "(", ")")
            else:
                return out

    # --- declarations ---

    def unit(self) -> tuple[str, list[tuple[str, bool, bool]]]:
        self.annotations(file=True)
        pkg, imports = "", []
        if self.take("package"):
            pkg = self.dotted()
            self.end_of_statement()
        while self.peek() == "import" and self.kind() == "i" and self.kind(1) == "i":
            self.at += 1
            name, star = self.dotted(), False
            if self.take("."):
                self.need("*")
                star = True
            elif self.take("as"):
                self.name()
            self.end_of_statement()
            imports.append((name, False, star))
        while self.peek() != END:
            if not self.take(";"):
                self.member(top=True)
                self.end_of_statement()
        return pkg, imports

    def end_of_statement(self) -> None:
        if not (self.take(";") or self.first_of_line[self.at] or self.peek() in ("}", END)):
            raise self.fault()

    def starts_declaration(self) -> bool:
        word = self.peek()
        if word in ("constructor", "init") and self.kind() == "i":
            return self.peek(1) == ("(" if word == "constructor" else "{")
        if self.kind() != "k" or word not in DECLARES:
            return False
        if word == "object":
            return self.kind(1) == "i" or self.texts[self.at - 1] == "companion"
        return word != "fun" or self.peek(1) != "(" or self.receiver_in_brackets()

    def receiver_in_brackets(self) -> bool:
        """Whether a function's name comes behind brackets, which are its receiver's then."""
        end = self.mate[self.at + 1]
        return self.texts[end + 1] in (".", "?.") or self.texts[end + 1] == "?" and self.texts[end + 2] == "."

    def member(self, top: bool = False) -> None:
        said = self.modifiers()
        if not self.starts_declaration():
            raise self.fault()
        self.declaration(said, top)

    def declaration(self, said: list[str], top: bool = False) -> None:
        word = self.next()
        if word == "fun" and self.peek() == "interface":
            word = self.next()
        if word in ("class", "interface", "object"):
            self.classifier(word, said, top)
        elif word == "fun":
            self.function()
        elif word in ("val", "var"):
            self.property()
        elif word == "typealias":
            self.name()
            self.type_parameters()
            self.need("=")
            self.type()
        elif word == "init":
            self.block()
        else:
            self.closed(self.parameter, "(", ")")
            if self.take(":"):
                self.need("this", "super")
                self.arguments()
            if self.peek() == "{":
                self.block()

    def classifier(self, word: str, said: list[str], top: bool) -> None:
        generic = word == "object" and "companion" in said and (self.kind() != "i" or self.peek() == "Companion")
        name = self.name() if self.kind() == "i" or word != "object" else ""
        supertypes: list[str] = []
        if not self.hidden and not generic:
            self.decls.append((name, supertypes))
            if top:
                self.top.append((word == "object", name))
        self.type_parameters()
        self.attempt(lambda: (self.modifiers(), self.need("constructor")), lambda: self.peek() == "(")
        if self.peek() == "(":
            self.closed(self.parameter, "(", ")")
        if self.take(":"):
            self.supertypes(supertypes)
        self.where()
        if self.peek() == "{":
            self.body("enum" in said)

    def supertypes(self, into: list[str]) -> None:
        def one() -> None:
            place = len(self.refs)
            plain = self.peek() != "(" and self.peek() != "suspend"
            self.type()
            if plain and self.texts[self.at - 1] != "?" and self.refs[place:]:
                into.append(self.super_name(place))
            if self.peek() == "(" and not self.first_of_line[self.at]:
                self.arguments()
            elif self.take("by"):
                with self.mode(self.lines_end):
                    self.trailing = False
                    self.expression()

        self.listed(one)

    def super_name(self, place: int) -> str:
        return self.refs[place].rpartition(".")[2]

    def body(self, enum: bool = False) -> None:
        with self.mode(True, hidden=False):
            self.need("{")
            if enum:
                self.enum_entries()
            while not self.take("}"):
                if not self.take(";"):
                    self.member()
                    self.end_of_statement()

    def enum_entries(self) -> None:
        while self.peek() not in (";", "}"):
            self.annotations()
            if self.kind() == "k":
                return
            name = self.name()
            if not self.hidden:
                self.decls.append((name, []))
            if self.peek() == "(":
                self.arguments()
            if self.peek() == "{":
                self.body()
            if not self.take(","):
                break
        if self.peek() != "}":
            self.need(";")

    def parameter(self) -> None:
        self.modifiers()
        self.take("val", "var")
        self.name()
        self.need(":")
        self.type()
        if self.take("="):
            self.expression()

    def named(self) -> None:
        """The name of a function or property behind its receiver, if it has one."""
        self.annotations()
        place, whole, receiver = len(self.refs), "", ""
        if self.peek() == "(":
            self.closed(self.type_parameter_or_type, "(", ")")
            self.take("?")
            self.need(".", "?.")
        while True:
            part = self.name()
            whole = f"{whole}.{part}" if whole else part
            if self.peek() == "<":
                self.type_arguments()
            self.take("?")
            if not self.take(".", "?."):
                break
            receiver = whole
            if self.peek() == "(":
                raise self.fault()
        if receiver:
            self.refs.insert(place, receiver)

    def function(self) -> None:
        self.type_parameters()
        self.named()
        self.function_rest()

    def function_rest(self) -> None:
        self.closed(self.parameter, "(", ")")
        if self.take(":"):
            self.type()
        self.where()
        if self.take("="):
            self.expression()
        elif self.peek() == "{":
            self.block()

    def property(self) -> None:
        self.type_parameters()
        if self.peek() == "(" and not self.receiver_at(self.at):
            self.closed(self.variable, "(", ")")
        else:
            self.named()
        if self.take(":"):
            self.type()
        self.where()
        if self.take("=") or self.take("by"):
            self.expression()
        while self.accessor():
            pass

    def receiver_at(self, at: int) -> bool:
        return self.texts[self.mate[at] + 1] in (".", "?.", "?")

    def accessor(self) -> bool:
        def one() -> None:
            self.take(";")
            self.modifiers()
            if not self.take("get", "set"):
                raise self.fault()

        if not self.attempt(one, lambda: self.peek() == "(" or self.first_of_line[self.at] or self.peek() in ("}", ";")):
            return False
        if self.peek() == "(" and not self.first_of_line[self.at]:
            self.closed(lambda: (self.modifiers(), self.variable()), "(", ")")
            if self.take(":"):
                self.type()
            if self.take("="):
                self.expression()
            else:
                self.block()
        return True

    def variable(self) -> None:
        self.annotations()
        self.name()
        if self.take(":"):
            self.type()
        if self.peek() == "=" and not self.lines_end:
            self.at += 1
            self.expression()

    # --- statements ---

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        with self.mode(True):
            while self.peek() != "}" or self.kind() == "q":
                if self.peek() == END:
                    raise self.fault()
                if not self.take(";"):
                    self.statement()
                    self.end_of_statement()

    def statement(self) -> None:
        said: list[str] = []
        if self.attempt(lambda: said.extend(self.modifiers()), self.starts_declaration):
            self.declaration(said)
        else:
            self.expression()

    def controlled(self) -> None:
        """The body of a loop or branch."""
        if self.peek() == "{":
            self.block()
        else:
            self.statement()

    # --- expressions ---

    def expression(self) -> None:
        self.hidden += 1
        self.unary()
        while True:
            word, kind = self.peek(), self.kind()
            if kind == "q" or kind == "n" or self.fresh() and word not in LEADING:
                break
            if word in LEADING or word in BINARY:
                self.at += 1
                self.unary()
            elif word in ("is", "!is", "as", "as?"):
                self.at += 1
                self.type()
            elif kind == "i" and (self.trailing or word != "where"):
                self.at += 1
                self.unary()
            else:
                break
        self.hidden -= 1

    def unary(self) -> None:
        while True:
            if self.peek() == "@":
                self.annotations()
            elif not self.take("+", "-", "++", "--", "!", "!!"):
                break
        self.primary()
        self.postfix()

    def postfix(self) -> None:
        while True:
            word = self.peek()
            if self.kind() == "q":
                return
            if word in (".", "?."):
                self.at += 1
                if self.peek() == "(":
                    self.in_brackets()
                elif not self.take("class"):
                    self.name()
            elif self.fresh():
                return
            elif word in ("++", "--", "!!"):
                self.at += 1
            elif word == "?" and self.peek(1) == "::":
                self.at += 1
            elif word == "::":
                self.at += 1
                if not self.take("class"):
                    self.name()
            elif word == "(":
                self.arguments()
            elif word == "[":
                self.closed(self.expression, "[", "]")
            elif word == "{" and self.trailing:
                self.lambda_()
            elif not (word == "<" and self.attempt(self.type_arguments, self.after_type_arguments)):
                return

    def after_type_arguments(self) -> bool:
        return self.first_of_line[self.at] or self.kind() == "o" and self.peek() in ("(", "{", ".", "?.", "::", "?", "!!", "?:", ")", "]", "}", ",", ";", ":", END)

    def arguments(self) -> None:
        def one() -> None:
            self.take("*")
            self.expression()

        self.closed(one, "(", ")")

    def in_brackets(self) -> None:
        self.need("(")
        with self.mode(False):
            self.expression()
            self.need(")")

    def primary(self) -> None:
        word, kind = self.peek(), self.kind()
        own = getattr(self, f"{word}_expression", None) if kind == "k" else None
        if kind == "q":
            self.at += 1
            while self.take("${"):
                self.statements()
                self.need("}")
            self.at += 1
        elif kind == "n" or word in ("true", "false", "null", "this"):
            self.at += 1
        elif own:
            self.at += 1
            own()
        elif word == "(":
            self.in_brackets()
        elif word == "{":
            self.lambda_()
        elif word == "[":
            self.closed(self.expression, "[", "]")
        elif word == "::":
            self.at += 1
            if not self.take("class"):
                self.name()
        else:
            self.name()

    def lambda_(self) -> None:
        self.need("{")
        with self.mode(False):
            self.attempt(self.lambda_head, lambda: self.take("->"))
        self.statements()
        self.need("}")

    def lambda_head(self) -> None:
        while self.peek() != "->":
            self.closed(self.variable, "(", ")") if self.peek() == "(" else self.variable()
            if self.take(":"):
                self.type()
            if not self.take(","):
                break

    def super_expression(self) -> None:
        if self.peek() == "<":
            self.type_arguments()

    def object_expression(self) -> None:
        if self.take(":"):
            self.supertypes([])
        self.body()

    def fun_expression(self) -> None:
        if self.peek() != "(" or self.texts[self.mate[self.at] + 1] == ".":
            if self.peek() == "(":
                self.type()
            else:
                self.user_type()
            self.take("?")
            self.need(".", "?.")
        self.function_rest()

    def if_expression(self) -> None:
        self.in_brackets()
        if not (self.peek() == "else" or self.peek() == ";"):
            self.controlled()
        if self.peek() == ";" and self.peek(1) == "else":
            self.at += 1
        if self.take("else"):
            if self.peek() != ";":
                self.controlled()

    def when_expression(self) -> None:
        if self.peek() == "(":
            self.need("(")
            with self.mode(False):
                if self.attempt(lambda: (self.annotations(), self.need("val"))):
                    self.name()
                    if self.take(":"):
                        self.type()
                    self.need("=")
                self.expression()
                self.need(")")
        self.need("{")
        with self.mode(True):
            while not self.take("}"):
                while not self.take("else"):
                    self.condition()
                    if not self.take(",") or self.peek() == "->":
                        break
                if self.take("if"):
                    self.expression()
                self.need("->")
                self.controlled()
                self.end_of_statement()

    def condition(self) -> None:
        if self.take("is", "!is"):
            self.type()
        else:
            self.take("in", "!in")
            self.expression()

    def try_expression(self) -> None:
        self.block()
        handled = False
        while self.take("catch"):
            self.closed(lambda: (self.modifiers(), self.name(), self.need(":"), self.type()), "(", ")")
            self.block()
            handled = True
        if self.peek() == "finally" and self.peek(1) == "{":
            self.at += 1
            self.block()
            handled = True
        if not handled:
            raise self.fault()

    def for_expression(self) -> None:
        self.need("(")
        with self.mode(False):
            self.annotations()
            self.take("val")
            if self.peek() == "(":
                self.closed(self.variable, "(", ")")
            else:
                self.name()
            if self.take(":"):
                self.type()
            self.need("in")
            self.expression()
            self.need(")")
        self.loop_body()

    def while_expression(self) -> None:
        self.in_brackets()
        self.loop_body()

    def loop_body(self) -> None:
        if self.peek() not in (";", "}"):
            self.controlled()

    def do_expression(self) -> None:
        if self.peek() != "while":
            self.controlled()
            self.take(";")
        self.need("while")
        self.in_brackets()

    def return_expression(self) -> None:
        if not (self.first_of_line[self.at] or self.kind() != "q" and self.peek() in ("}", ")", "]", ";", ",", "else", END, "?:", "->")):
            self.expression()

    def throw_expression(self) -> None:
        self.expression()

    def break_expression(self) -> None:
        return

    continue_expression = break_expression


def read(text: str, file_name: str) -> dict:
    """The metadata of a Kotlin text; a SyntaxFault if it is none."""
    reader = Kotlin(*tokens(text))
    pkg, imports = reader.unit()
    stem = file_name.rpartition(".")[0] or file_name
    primary = next((n for is_object, n in reader.top if not is_object), None) or next((n for _, n in reader.top), f"{stem}Kt")
    return reader.found(pkg, primary, imports, reader.jvm_name)
