"""A tree of a page's elements, for rules that need ancestors and siblings.

It follows the extractor's void and implied-end rules; comments are left out.
A tree lives only while its page is looked at, inside a batch."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from html import escape
from html.parser import HTMLParser

from .html import CLOSES, HIDDEN, VOID


class Node:
    __slots__ = ("tag", "at", "kids", "up")

    def __init__(self, tag: str, at: dict[str, str] | None = None, up: Node | None = None):
        self.tag, self.at, self.up = tag, at or {}, up
        self.kids: list[Node | str] = []

    def walk(self) -> Iterator[Node]:
        """This element and those below it, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo += [k for k in reversed(node.kids) if isinstance(k, Node)]

    def visit(self, state, enter: Callable) -> None:
        """Call enter(node, state) for this element and those below it, in
        document order; what it returns is the state of the node's children."""
        todo = [(self, state)]
        while todo:
            node, given = todo.pop()
            below = enter(node, given)
            todo += [(k, below) for k in reversed(node.kids) if isinstance(k, Node)]

    def above(self) -> Iterator[Node]:
        node = self.up
        while node is not None:
            yield node
            node = node.up

    def find(self, wanted: Callable[[Node], bool]) -> Node | None:
        return next((n for n in self.walk() if wanted(n)), None)

    def classes(self) -> list[str]:
        return self.at.get("class", "").split()

    def texts(self) -> Iterator[tuple[Node, str]]:
        """Text runs with the element that holds each."""
        todo: list = [(self, k) for k in reversed(self.kids)]
        while todo:
            owner, item = todo.pop()
            if isinstance(item, str):
                yield owner, item
            else:
                todo += [(item, k) for k in reversed(item.kids)]

    def text(self, between: str = "") -> str:
        return between.join(t for _, t in self.texts())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.now = Node("#document")
        self.open: Counter[str] = Counter()  # elements that an end tag could close

    def leave(self) -> None:
        self.open[self.now.tag] -= 1
        self.now = self.now.up

    def handle_starttag(self, tag: str, attrs: list) -> None:
        while tag in CLOSES.get(self.now.tag, ()):
            self.leave()
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, self.now)
        self.now.kids.append(node)
        if tag not in VOID:
            self.now = node
            self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if self.open[tag]:
            while self.now.tag != tag:
                self.leave()
            self.leave()

    def handle_data(self, data: str) -> None:
        self.now.kids.append(data)


def tree(html: str | None) -> Node:
    builder = _Builder()
    builder.feed(html or "")
    builder.close()
    return builder.root


def markup(node: Node) -> str:
    """The element as HTML text."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        item = todo.pop()
        if isinstance(item, str):
            out.append(item)
        elif isinstance(item, tuple):
            owner, text = item
            out.append(text if owner.tag in HIDDEN else escape(text, quote=False))
        else:
            if item.tag != "#document":
                out.append("<" + item.tag + "".join(f' {k}="{escape(v)}"' for k, v in reversed(item.at.items())) + ">")
                if item.tag not in VOID:
                    todo.append(f"</{item.tag}>")
            todo += [(item, k) if isinstance(k, str) else k for k in reversed(item.kids)]
    return "".join(out)
