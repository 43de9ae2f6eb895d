"""What the readers of Java and Kotlin text share: a cursor over tokens, and what they find."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

CLOSES = {")": "(", "]": "[", "}": "{"}
END = ""


class SyntaxFault(Exception):
    """The text is not of the language."""


class Reader:
    """A cursor over tokens, where a token's kind is i(dentifier), k(eyword), n (a literal) or o(ther), and the end is an empty o.

    Names of types go into refs, each with what stands before it, so Map.Entry gives
    Map and Map.Entry; decls are (name, supertypes) in order of their heads.
    """

    def __init__(self, kinds: list[str], texts: list[str], lines: list[bool] | None = None):
        self.kinds, self.texts = [*kinds, "o"], [*texts, END]
        self.first_of_line = [*(lines or [False] * len(texts)), True]
        self.at = 0
        self.refs: list[str] = []
        self.decls: list[tuple[str, list[str]]] = []
        self.mate = matches(self.texts)

    def fault(self) -> SyntaxFault:
        return SyntaxFault(f"at token {self.at}: {self.texts[self.at][:40]!r}")

    def peek(self, ahead: int = 0) -> str:
        try:
            return self.texts[self.at + ahead]
        except IndexError:
            return END

    def kind(self, ahead: int = 0) -> str:
        try:
            return self.kinds[self.at + ahead]
        except IndexError:
            return "o"

    def next(self) -> str:
        self.at += 1
        return self.texts[self.at - 1]

    def take(self, *texts: str) -> bool:
        """Step over the token if it is one of texts and no literal."""
        if self.texts[self.at] in texts and self.kinds[self.at] != "n":
            self.at += 1
            return True
        return False

    def need(self, *texts: str) -> None:
        if not self.take(*texts):
            raise self.fault()

    def name(self) -> str:
        if self.kinds[self.at] != "i":
            raise self.fault()
        return self.next()

    def dotted(self) -> str:
        out = self.name()
        while self.peek() == "." and self.kind(1) == "i":
            self.at += 1
            out += "." + self.next()
        return out

    def listed(self, one: Callable[[], object], separator: str = ",") -> list:
        out = [one()]
        while self.take(separator):
            out.append(one())
        return out

    @contextmanager
    def undone(self):
        """Go back to where the block began, and forget what it found, if it fails; the block's outcome is in the list it gets."""
        at, n_refs, n_decls, went = self.at, len(self.refs), len(self.decls), []
        try:
            yield went
        except SyntaxFault:
            went.clear()
        if not went:
            self.at = at
            del self.refs[n_refs:]
            del self.decls[n_decls:]

    def attempt(self, what: Callable[[], object], then: Callable[[], bool] = lambda: True) -> bool:
        """Whether what can be read here and then holds after it; otherwise nothing is read."""
        with self.undone() as went:
            what()
            if then():
                went.append(True)
        return bool(went)

    def found(self, pkg: str, primary: str | None, imports: list[tuple[str, bool, bool]], jvm_name: bool = False) -> dict:
        simple = {r.rpartition(".")[2] for r in self.refs}
        return {
            "pkg": pkg,
            "primary_type": primary,
            "imports": [{"name": n, "is_static": s, "is_asterisk": a} for n, s, a in dict.fromkeys(imports)],
            "type_decls": [{"simple_name": n, "supertypes": list(dict.fromkeys(s))} for n, s in self.decls],
            "type_ref_simple": sorted(simple),
            "type_ref_dotted": sorted({r for r in self.refs if "." in r}),
            "jvm_name": jvm_name,
        }


def matches(texts: list[str]) -> dict[int, int]:
    """Place of each opening bracket's closing one; a fault where they don't pair."""
    mate, open_ones = {}, []
    for i, t in enumerate(texts):
        if t in ("(", "[", "{", "${"):
            open_ones.append(i)
        elif t in CLOSES:
            if not open_ones or texts[open_ones[-1]].lstrip("$") != CLOSES[t]:
                raise SyntaxFault(f"unpaired {t} at token {i}")
            mate[open_ones.pop()] = i
    if open_ones:
        raise SyntaxFault(f"unclosed {texts[open_ones[-1]]}")
    return mate
