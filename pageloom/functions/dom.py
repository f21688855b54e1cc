"""A small element tree over the standard HTML parser, with texts and CSS selectors, for use inside Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

# Elements without end tag, elements whose text is never shown.
VOID = frozenset(("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"))
UNSEEN = frozenset(("script", "style", "noscript", "template"))


class Node:
    """An element with its children in document order; texts are plain strings."""

    __slots__ = ("attrs", "children", "parent", "tag", "_text")

    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self._text = tag, attrs, parent, [], None

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order, without recursion."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def strings(self, skip: Callable[[Node], bool] | None = None) -> Iterator[Node | str]:
        """Texts and elements below this one in document order; elements that ``skip`` names are left out whole."""
        stack = list(reversed(self.children))
        while stack:
            n = stack.pop()
            if isinstance(n, str):
                yield n
            elif skip is None or not skip(n):
                yield n
                stack.extend(reversed(n.children))

    def text(self) -> str:
        """All texts, one blank between them."""
        if self._text is None:
            self._text = " ".join(" ".join(s for s in self.strings() if isinstance(s, str)).split())
        return self._text

    def get(self, name: str) -> str:
        return self.attrs.get(name) or ""

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def up(self) -> Iterator[Node]:
        """The elements around this one, nearest first."""
        n = self.parent
        while n is not None:
            yield n
            n = n.parent


def hidden(attrs: dict) -> bool:
    """Whether an element's own attributes hide it from people."""
    if "hidden" in attrs:
        return True
    style = attrs.get("style")
    if not style:
        return False
    style = "".join(style.lower().split())
    return "display:none" in style or "visibility:hidden" in style


class _Builder(HTMLParser):
    """Builds the tree; with ``seen`` elements that nobody sees are left out while they are read."""

    def __init__(self, seen: bool):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.seen, self.skipped = seen, []

    def handle_starttag(self, tag, attrs):
        if self.skipped:
            if tag not in VOID:
                self.skipped.append(tag)
            return
        got = dict(attrs)
        if self.seen and (tag in UNSEEN or hidden(got)):
            if tag not in VOID:
                self.skipped.append(tag)
            return
        node = Node(tag, got, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.skipped:
            if tag in self.skipped:
                while self.skipped.pop() != tag:
                    pass
                return
            # The element around the hidden one ends, and the hidden one with it.
            self.skipped = []
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        if not self.skipped:
            self.at.children.append(data)


def tree(html: str | None, seen: bool = True) -> Node:
    """The element tree of a page; an empty tree for NULL, what was read so far for broken input.

    seen: leave out scripts, styles, templates and what is hidden from people.
    """
    b = _Builder(seen)
    try:
        b.feed(html or "")
        b.close()
    except (AssertionError, ValueError):
        pass
    return b.root


# ------------------------------------------------------------------ selectors
Test = Callable[[Node], bool]
_NAME = re.compile(r"-?[A-Za-z_\u0080-￿][\w\u0080-￿-]*|\*")
_ATTRIBUTE = re.compile(r"""\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*("[^"]*"|'[^']*'|[^\s\]"']+)\s*([iIsS])?\s*)?\]""")
_COMBINATOR = re.compile(r"\s*([>+~])\s*|\s+")
_NTH = re.compile(r"\s*(?:(odd|even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*$", re.I)


def _attribute(name: str, op: str | None, raw: str | None, flag: str | None) -> Test:
    name = name.lower()
    value = raw[1:-1] if raw and raw[0] in "\"'" else raw or ""
    fold = (lambda v: v.lower()) if (flag or "").lower() == "i" else (lambda v: v)
    want = fold(value)
    how = {
        None: lambda v: True, "=": lambda v: v == want, "~=": lambda v: bool(want) and want in v.split(), "|=": lambda v: v == want or v.startswith(want + "-"),
        "^=": lambda v: bool(want) and v.startswith(want), "$=": lambda v: bool(want) and v.endswith(want), "*=": lambda v: bool(want) and want in v,
    }[op]
    return lambda n: name in n.attrs and how(fold(n.attrs[name] or ""))


def _place(n: Node) -> tuple[int, int]:
    """Number of an element among its siblings, from 1, and how many there are."""
    if n.parent is None:
        return 1, 1
    all_ = n.parent.elements()
    return next(i for i, c in enumerate(all_, 1) if c is n), len(all_)


def _nth(text: str) -> Callable[[int], bool]:
    m = _NTH.match(text)
    if not m:
        raise ValueError(f"unsupported position: {text}")
    if m[1]:
        a, b = 2, int(m[1].lower() == "odd")
    elif m[5]:
        a, b = 0, int(m[5])
    else:
        a = int(m[2] + "1") if m[2] in ("", "+", "-") else int(m[2])
        b = int((m[3] or "+") + (m[4] or "0"))
    return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


class _Parser:
    """Recursive descent over a selector list: compounds joined by descendant, child, next and later-sibling marks."""

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def fail(self):
        raise ValueError(f"unsupported selector: {self.text}")

    def listed(self, end: str = "") -> Test:
        choices = []
        while True:
            choices.append(self.complex(end))
            if self.at < len(self.text) and self.text[self.at] == ",":
                self.at += 1
                continue
            break
        return lambda n: any(c(n) for c in choices)

    def complex(self, end: str) -> Test:
        self.blanks()
        steps: list[tuple[str, Test]] = [("", self.compound())]
        while self.at < len(self.text) and self.text[self.at] not in "," + end:
            m = _COMBINATOR.match(self.text, self.at)
            if not m:
                self.fail()
            self.at = m.end()
            if self.at >= len(self.text) or self.text[self.at] in "," + end:
                if m[1]:
                    self.fail()
                break
            steps.append((m[1] or " ", self.compound()))
        self.blanks()
        return self.matcher(steps)

    @staticmethod
    def matcher(steps: list[tuple[str, Test]]) -> Test:
        def match(n: Node, k: int) -> bool:
            if not steps[k][1](n):
                return False
            how = steps[k][0]
            if k == 0:
                return True
            if how == " ":
                return any(match(p, k - 1) for p in n.up())
            if how == ">":
                return n.parent is not None and match(n.parent, k - 1)
            before = n.parent.elements() if n.parent is not None else []
            before = before[: next((i for i, c in enumerate(before) if c is n), 0)]
            return any(match(p, k - 1) for p in (before[-1:] if how == "+" else before))

        return lambda n: match(n, len(steps) - 1)

    def blanks(self):
        while self.at < len(self.text) and self.text[self.at].isspace():
            self.at += 1

    def compound(self) -> Test:
        tests: list[Test] = []
        m = _NAME.match(self.text, self.at)
        if m:
            self.at, tag = m.end(), m[0].lower()
            tests.append((lambda n: n.tag != "") if tag == "*" else (lambda n: n.tag == tag))
        while self.at < len(self.text):
            c = self.text[self.at]
            if c in ".#":
                m = _NAME.match(self.text, self.at + 1)
                if not m or m[0] == "*":
                    self.fail()
                self.at, want = m.end(), m[0]
                tests.append((lambda n, want=want: want in n.get("class").split()) if c == "." else (lambda n, want=want: n.attrs.get("id") == want))
            elif c == "[":
                m = _ATTRIBUTE.match(self.text, self.at)
                if not m:
                    self.fail()
                self.at = m.end()
                tests.append(_attribute(*m.groups()))
            elif c == ":":
                tests.append(self.pseudo())
            else:
                break
        if not tests:
            self.fail()
        return lambda n: all(t(n) for t in tests)

    def pseudo(self) -> Test:
        m = re.compile(r":([a-z-]+)(\()?").match(self.text, self.at)
        if not m:
            self.fail()
        self.at, name = m.end(), m[1]
        if m[2] and name in ("not", "is", "where", "has"):
            inner = self.listed(")")
            self.close()
            if name == "has":
                return lambda n: any(inner(c) for c in n.walk() if c is not n)
            return (lambda n: not inner(n)) if name == "not" else inner
        if m[2] and name in ("nth-child", "nth-last-child"):
            end = self.text.find(")", self.at)
            good = _nth(self.text[self.at : end if end >= 0 else None])
            self.at = max(end, self.at)
            self.close()
            return (lambda n: good(_place(n)[0])) if name == "nth-child" else (lambda n: good(_place(n)[1] - _place(n)[0] + 1))
        simple = {
            "first-child": lambda n: _place(n)[0] == 1, "last-child": lambda n: _place(n)[0] == _place(n)[1], "only-child": lambda n: _place(n)[1] == 1,
            "empty": lambda n: not any(isinstance(c, Node) or c for c in n.children), "root": lambda n: n.parent is not None and n.parent.parent is None,
        }
        if m[2] or name not in simple:
            self.fail()
        return simple[name]

    def close(self):
        self.blanks()
        if self.at >= len(self.text) or self.text[self.at] != ")":
            self.fail()
        self.at += 1


def selector(text: str) -> Test:
    """A predicate for a CSS selector list; ValueError for what is no selector or not supported.

    Types, classes, ids, attributes (all operators, the i flag, quoted blanks and commas), descendant, child and sibling
    marks, :not, :is, :where, :has, :nth-child, :first-, :last-, :only-child, :empty, :root.
    """
    p = _Parser(text)
    out = p.listed()
    if p.at != len(text):
        p.fail()
    return out


def select(root: Node, test: Test, most: int | None = None) -> list[Node]:
    """Elements below the root that a selector matches, in document order; at most so many."""
    out = []
    for n in root.walk():
        if n is not root and test(n):
            out.append(n)
            if most is not None and len(out) >= most:
                break
    return out
