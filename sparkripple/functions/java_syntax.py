"""Reads a Java source file: its package, imports, declarations and the types it names.

A recursive descent over the language's grammar up to record patterns and switch
expressions. It decides nothing by meaning: where a text could be an expression
or a type, as before :: or in a cast, what follows tells, as the grammar has it.
A text that the grammar doesn't take is a fault.
"""

from __future__ import annotations

import re

from sparkripple.functions.reading import END, Reader, SyntaxFault

#: The language's reserved words. Fixed values.
KEYWORDS = frozenset(
    """abstract assert boolean break byte case catch char class const continue default do double else enum extends false
    final finally float for goto if implements import instanceof int interface long native new null package private
    protected public return short static strictfp super switch synchronized this throw throws transient true try void
    volatile while _""".split()
)
PRIMITIVES = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("abstract default final native private protected public static strictfp synchronized transient volatile".split())
ASSIGNS = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
BINARY = frozenset("|| && | ^ & == != < > <= >= << + - * / %".split())
LEXER = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<n>\"\"\"(?:[^\\"]|\\.|"(?!""))*+\"\"\"|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\[^\n])++'|0[xX][0-9a-fA-F_.]+(?:[pP][+-]?[0-9_]+)?[lLfFdD]?|(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)(?:[eE][+-]?[0-9_]+)?[lLfFdDbB]?[01_]*[lL]?)
    |(?P<i>[^\W\d][\w$]*|\$[\w$]*)
    |(?P<o>->|::|\.\.\.|\+\+|--|&&|\|\||<<=|[=!<>]=|[-+*/%&|^]=|<<|[-+*/%&|^!~?:;,.(){}\[\]@=<>])""",
    re.S | re.X,
)


def tokens(text: str) -> tuple[list[str], list[str]]:
    kinds, texts, at = [], [], 0
    for m in LEXER.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        kind = m.lastgroup
        if kind != "skip":
            t = m.group()
            kinds.append("k" if kind == "i" and t in KEYWORDS else kind)
            texts.append(t)
    if at != len(text):
        raise SyntaxFault(f"unreadable at {text[at : at + 20]!r}")
    return kinds, texts


class Java(Reader):
    # --- types ---

    def type(self, void: bool = False) -> None:
        self.annotations()
        if not (self.take("void") if void and self.peek() == "void" else self.take(*PRIMITIVES)):
            self.class_type()
        self.dims()

    def dims(self) -> bool:
        some = False
        while self.peek() == "[" and self.peek(1) == "]" or self.peek() == "@" and self.peek(1) != "interface":
            self.annotations()
            self.need("[")
            self.need("]")
            some = True
        return some

    def class_type(self) -> str:
        whole = ""
        while True:
            self.annotations()
            whole += self.name()
            if whole != "var":
                self.refs.append(whole)
            if self.peek() == "<":
                self.type_arguments()
            if not (self.peek() == "." and (self.kind(1) == "i" or self.peek(1) == "@")):
                return whole.rpartition(".")[2]
            self.at += 1
            whole += "."

    def type_arguments(self) -> None:
        def one() -> None:
            self.annotations()
            if not self.take("?"):
                self.type()
            elif self.take("extends", "super"):
                self.type()

        self.need("<")
        if not self.take(">"):
            self.listed(one)
            self.need(">")

    def type_parameters(self) -> None:
        def one() -> None:
            self.annotations()
            self.name()
            if self.take("extends"):
                self.listed(self.type, "&")

        if self.take("<"):
            self.listed(one)
            self.need(">")

    def types_after(self, *words: str) -> list[str]:
        return self.listed(self.class_type) if self.take(*words) else []

    # --- annotations and modifiers ---

    def annotations(self) -> None:
        while self.peek() == "@" and self.peek(1) != "interface":
            self.at += 1
            self.dotted()
            if self.take("("):
                if self.kind() == "i" and self.peek(1) == "=":
                    self.listed(lambda: (self.name(), self.need("="), self.element()))
                elif self.peek() != ")":
                    self.element()
                self.need(")")

    def element(self) -> None:
        if self.peek() == "@":
            self.annotations()
        elif self.take("{"):
            while self.peek() != "}":
                self.element()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.ternary()

    def modifiers(self) -> None:
        while True:
            self.annotations()
            if self.peek() in MODIFIERS and not (self.peek() == "default" and self.peek(1) in (":", "->")) and not (self.peek() == "synchronized" and self.peek(1) == "("):
                self.at += 1
            elif self.peek() == "sealed" and self.kind(1) in "ik":
                self.at += 1
            elif self.peek() == "non" and self.peek(1) == "-" and self.peek(2) == "sealed":
                self.at += 3
            else:
                return

    # --- declarations ---

    def unit(self) -> tuple[str, list[tuple[str, bool, bool]]]:
        pkg, imports = "", []
        if self.attempt(lambda: (self.annotations(), self.need("package"))):
            pkg = self.dotted()
            self.need(";")
        while self.peek() in ("import", ";"):
            if self.take(";"):
                continue
            self.at += 1
            if self.peek() == "module" and self.kind(1) == "i":
                self.at += 1
            static = self.take("static")
            name, star = self.dotted(), False
            if self.take("."):
                self.need("*")
                star = True
            self.need(";")
            imports.append((name, static, star))
        if self.attempt(lambda: (self.annotations(), self.take("open"), self.need("module"), self.dotted(), self.need("{"))):
            self.at = self.mate[self.at - 1] + 1
        while self.peek() != END:
            if not self.take(";"):
                self.modifiers()
                if not self.declared():
                    raise self.fault()
        return pkg, imports

    def declared(self) -> bool:
        """Read a declaration of a type, its modifiers already read, if there is one."""
        word = self.peek()
        if word == "@" and self.peek(1) == "interface":
            self.at += 2
            self.body([], self.member)
        elif word in ("class", "interface", "enum"):
            self.at += 1
            self.body(["extends", "implements"] if word != "enum" else ["implements"], self.member, word == "enum")
        elif word == "record" and self.kind(1) == "i" and self.peek(2) in ("(", "<"):
            self.at += 1
            self.body(["implements"], self.member, record=True)
        else:
            return False
        return True

    def body(self, words: list[str], member, enum: bool = False, record: bool = False) -> None:
        name, supertypes = self.name(), []
        self.decls.append((name, supertypes))
        self.type_parameters()
        if record:
            self.parameters()
        for word in words:
            supertypes += self.types_after(word)
        if self.peek() == "permits":
            self.types_after("permits")
        self.members(enum)

    def members(self, enum: bool = False) -> None:
        self.need("{")
        if enum:
            while self.peek() not in (";", "}"):
                self.annotations()
                self.name()
                if self.peek() == "(":
                    self.arguments()
                if self.peek() == "{":
                    self.members()
                if not self.take(","):
                    break
            if not self.take(";") and self.peek() != "}":
                raise self.fault()
        while not self.take("}"):
            self.member()

    def member(self) -> None:
        if self.take(";"):
            return
        self.modifiers()
        if self.peek() == "{":
            return self.block()
        if self.declared():
            return None
        self.type_parameters()
        self.annotations()
        if self.kind() == "i" and self.peek(1) in ("(", "{"):  # a constructor, or a record's short one
            self.at += 1
            if self.peek() == "(":
                self.parameters()
                self.thrown()
            return self.block()
        self.type(void=True)
        self.name()
        if self.peek() != "(":
            self.declarators()
            return self.need(";")
        self.parameters()
        self.dims()
        self.thrown()
        if self.take("default"):
            self.element()
        if not self.take(";"):
            self.block()
        return None

    def thrown(self) -> None:
        if self.take("throws"):
            self.listed(self.type)

    def parameters(self) -> None:
        def one() -> None:
            self.modifiers()
            self.type()
            self.annotations()
            self.take("...")
            if self.kind() == "i" and self.peek(1) == ".":
                self.at += 2
            if not self.take("this", "_"):
                self.name()
            self.dims()

        self.need("(")
        if not self.take(")"):
            self.listed(one)
            self.need(")")

    def declarators(self) -> None:
        """What follows the first name of a field or local variable."""
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.variable()

    def variable(self) -> None:
        if not self.take("_"):
            self.name()

    def initializer(self) -> None:
        if not self.take("{"):
            return self.expression()
        while self.peek() != "}":
            self.initializer()
            if not self.take(","):
                break
        return self.need("}")

    # --- statements ---

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def is_local(self) -> bool:
        """Read a local variable's modifiers, type and name, if they are there."""
        return self.attempt(lambda: (self.modifiers(), self.type(), self.variable()), lambda: self.peek() in ("=", ";", ",", ":", "["))

    def condition(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def statement(self) -> None:
        word = self.peek()
        own = getattr(self, f"{word}_statement", None) if self.kind() == "k" else None
        if word == "{":
            self.block()
        elif self.take(";"):
            pass
        elif own:
            if word != "switch":
                self.at += 1
            own()
        elif word == "yield" and self.peek(1) not in ("=", ".", "(", "[", "++", "--", "::"):
            self.at += 1
            self.expression()
            self.need(";")
        elif self.kind() == "i" and self.peek(1) == ":":
            self.at += 2
            self.statement()
        elif not self.attempt(lambda: (self.modifiers(), self.declared() or self.need("class"))):
            if self.is_local():
                self.declarators()
            else:
                self.effect()
            self.need(";")

    def effect(self) -> None:
        """An expression that may stand as a statement."""
        if self.expression() not in ("call", "assign", "step", "new", "switch"):
            raise self.fault()

    def if_statement(self) -> None:
        self.condition()
        self.statement()
        while self.take("else"):
            if not self.take("if"):
                return self.statement()
            self.condition()
            self.statement()
        return None

    def while_statement(self) -> None:
        self.condition()
        self.statement()

    def do_statement(self) -> None:
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def for_statement(self) -> None:
        self.need("(")
        if self.is_local():
            if self.take(":"):
                self.expression()
                self.need(")")
                return self.statement()
            self.declarators()
        elif self.peek() != ";":
            self.listed(self.effect)
        self.need(";")
        if self.peek() != ";":
            self.expression()
        self.need(";")
        if self.peek() != ")":
            self.listed(self.effect)
        self.need(")")
        return self.statement()

    def try_statement(self) -> None:
        def resource() -> None:
            if self.is_local():
                self.declarators()
            else:
                self.expression()

        handled = self.take("(")
        if handled:
            while self.peek() != ")":
                resource()
                if not self.take(";"):
                    break
            self.need(")")
        self.block()
        while self.take("catch"):
            handled = True
            self.need("(")
            self.modifiers()
            self.listed(self.type, "|")
            self.variable()
            self.need(")")
            self.block()
        if self.take("finally"):
            handled = True
            self.block()
        if not handled:
            raise self.fault()

    def switch_statement(self) -> None:
        """As an expression, to which a postfix may belong."""
        self.expression()
        self.take(";")

    def return_statement(self) -> None:
        if self.peek() != ";":
            self.expression()
        self.need(";")

    def throw_statement(self) -> None:
        self.expression()
        self.need(";")

    def break_statement(self) -> None:
        if self.kind() == "i":
            self.at += 1
        self.need(";")

    continue_statement = break_statement

    def assert_statement(self) -> None:
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def synchronized_statement(self) -> None:
        self.condition()
        self.block()

    # --- expressions: each gives its form, of which calls, assignments, steps, creations and switches may be statements ---

    def expression(self) -> str:
        form = self.ternary()
        if self.take(*ASSIGNS) or self.peek() == ">" and self.shift_assign():
            self.expression()
            return "assign"
        return form

    def shift_assign(self) -> bool:
        return self.attempt(lambda: (self.need(">"), self.take(">"), self.need(">=")))

    def ternary(self) -> str:
        if self.is_lambda():
            return self.lambda_()
        form = self.binary()
        if self.take("?"):
            self.lambda_() if self.is_lambda() else self.expression()
            self.need(":")
            self.lambda_() if self.is_lambda() else self.ternary()
            return "value"
        return form

    def is_lambda(self) -> bool:
        if self.kind() == "i" or self.peek() == "_":
            return self.peek(1) == "->"
        return self.peek() == "(" and self.kind() == "o" and self.texts[self.mate[self.at] + 1] == "->"

    def lambda_(self) -> str:
        if self.take("("):
            end = self.mate[self.at - 1]
            if not self.attempt(lambda: self.listed(self.variable), lambda: self.at == end) and self.at != end:
                self.at -= 1
                self.parameters()
                self.at -= 1
            self.need(")")
        else:
            self.variable()
        self.need("->")
        self.block() if self.peek() == "{" else self.expression()
        return "lambda"

    def binary(self) -> str:
        form = self.unary()
        while True:
            if self.take("instanceof"):
                self.pattern()
            elif self.peek() in BINARY and self.kind() == "o":
                at = self.at
                if self.peek() == ">":
                    while self.take(">"):
                        pass
                    if self.peek() == ">=" and self.at > at and self.shift_assign_at(at):
                        return form
                    self.take(">=")
                else:
                    self.at += 1
                self.lambda_() if self.is_lambda() else self.unary()
            else:
                return form
            form = "value"

    def shift_assign_at(self, at: int) -> bool:
        """> and >> before >= are an assignment, which expression() reads."""
        self.at = at
        return True

    def pattern(self) -> None:
        self.modifiers()
        if self.take("_"):
            return
        self.type()
        if self.take("("):
            if not self.take(")"):
                self.listed(self.pattern)
                self.need(")")
        elif self.peek() == "_" or self.kind() == "i" and self.peek() != "when":
            self.at += 1

    def unary(self) -> str:
        if self.take("+", "-", "!", "~"):
            self.unary()
            return "value"
        if self.take("++", "--"):
            self.unary()
            return "step"
        if self.peek() == "(" and self.kind() == "o" and self.is_cast():
            self.lambda_() if self.is_lambda() else self.unary()
            return "value"
        form = self.primary()
        while True:
            if self.take("++", "--"):
                form = "step"
            elif (after := self.selector()) is None:
                return form
            else:
                form = after

    def is_cast(self) -> bool:
        """Read a cast's brackets, if that is what they are."""
        end = self.mate[self.at]
        after, kind = self.texts[end + 1], self.kinds[end + 1]
        plain = self.texts[self.at + 1] in PRIMITIVES
        starts = kind in "in" or after in ("(", "!", "~") or kind == "k" and after in ("new", "this", "super", "switch", "true", "false", "null", *PRIMITIVES, "void")
        if not starts and not (plain and after in ("+", "-", "++", "--")):
            return False
        return self.attempt(lambda: (self.need("("), self.listed(self.type, "&"), self.need(")")), lambda: self.at == end + 1)

    def selector(self) -> str | None:
        if self.peek() == "[" and self.kind() == "o":
            self.at += 1
            self.expression()
            self.need("]")
            return "value"
        if self.take("::"):
            if self.peek() == "<":
                self.type_arguments()
            if not self.take("new"):
                self.name()
            return "value"
        if not self.take("."):
            return None
        if self.take("new"):
            return self.creator()
        if self.take("this", "class"):
            return "value"
        if self.take("super"):
            if self.peek() == "(":
                self.arguments()
                return "call"
            return "value"
        if self.peek() == "<":
            self.type_arguments()
            if self.take("super"):
                self.arguments()
                return "call"
        self.name()
        if self.peek() == "(":
            self.arguments()
            return "call"
        return "value"

    def arguments(self) -> None:
        self.need("(")
        if not self.take(")"):
            self.listed(self.expression)
            self.need(")")

    def primary(self) -> str:
        word, kind = self.peek(), self.kind()
        if kind == "n" or word in ("true", "false", "null"):
            self.at += 1
            return "value"
        if self.take("("):
            self.expression()
            self.need(")")
            return "value"
        if self.take("new"):
            return self.creator()
        if self.take("switch"):
            return self.switch()
        if self.take("this", "super"):
            if self.peek() == "(":
                self.arguments()
                return "call"
            if word == "super" and self.peek() not in (".", "::"):
                raise self.fault()
            return "value"
        if word in PRIMITIVES or word == "void":
            self.type(void=True)
            if self.peek() != "::":
                self.need(".")
                self.need("class")
            return "value"
        if kind != "i" and word != "@":
            raise self.fault()
        if self.is_type_expression():
            return "value"
        self.name()
        if self.peek() == "(":
            self.arguments()
            return "call"
        return "value"

    def is_type_expression(self) -> bool:
        """Read a type before :: or .class, if that is what comes; .class is read too."""
        ahead = 1
        while self.peek(ahead) == "." and self.kind(ahead + 1) == "i":
            ahead += 2
        if self.peek() != "@" and self.peek(ahead) not in ("::", "<", "[") and not (self.peek(ahead) == "." and self.peek(ahead + 1) in ("class", "@")):
            return False
        if self.peek(ahead) == "[" and self.peek(ahead + 1) != "]":
            return False
        return self.attempt(self.type, lambda: self.peek() == "::" or self.take(".") and self.take("class"))

    def creator(self) -> str:
        if self.peek() == "<":
            self.type_arguments()
        self.annotations()
        if not self.take(*PRIMITIVES):
            self.class_type()
        if self.peek() == "(":
            self.arguments()
            if self.peek() == "{":
                self.members()
            return "new"
        if self.dims():
            self.need("{")
            self.at -= 1
            self.initializer()
            return "value"
        sized = False
        while self.peek() in ("[", "@"):
            self.annotations()
            self.need("[")
            if self.peek() != "]":
                self.expression()
                sized = True
            self.need("]")
        if not sized:
            raise self.fault()
        return "value"

    def switch(self) -> str:
        self.condition()
        self.need("{")
        while not self.take("}"):
            if not self.take("default"):
                self.need("case")
                self.listed(self.label)
                if self.take("when"):
                    self.expression()
            if self.take("->"):
                if self.peek() == "{":
                    self.block()
                elif self.take("throw"):
                    self.throw_statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while self.peek() not in ("case", "default", "}"):
                    self.statement()
        return "switch"

    def label(self) -> None:
        def named() -> bool:
            """Whether what was read ends with a record's brackets, or with a type and a name, and the label with it."""
            kind, before = self.kinds[self.at - 1], self.texts[self.at - 2]
            bound = (kind == "i" or self.texts[self.at - 1] == "_") and (self.kinds[self.at - 2] == "i" or before in (">", "]") or before in PRIMITIVES)
            return (bound or self.texts[self.at - 1] == ")") and self.peek() in (",", "->", ":", "when")

        if self.take("default") or self.attempt(self.pattern, named):
            return
        self.binary()
        if self.take("?"):
            self.binary()
            self.need(":")
            self.binary()


def read(text: str, file_name: str) -> dict:
    """The metadata of a Java text; a SyntaxFault if it is none."""
    reader = Java(*tokens(text))
    pkg, imports = reader.unit()
    return reader.found(pkg, file_name.rpartition(".")[0] or None, imports)
