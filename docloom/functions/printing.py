"""Topics of a combined print document: layout marks, ids and links."""

from __future__ import annotations

from .dom import Node, markup, tree

# Elements and class names that print layout knows.
CODE_CLASSES = {"pre", "codeblock", "screen"}
BLOCKS = {"p", "ul", "ol", "pre", "table", "div", "dl", "figure", "blockquote", "section", "article", "h1", "h2", "h3", "h4", "h5", "h6"}
HOLDERS = {"li", "div", "section", "article", "blockquote", "figure", "dd", "td", "th"}
KEEP_LINES = 8
BLANK = " \t\n\f\r\xa0"


def is_code(n: Node | str | None) -> bool:
    return isinstance(n, Node) and (n.tag == "pre" or bool(CODE_CLASSES & set(n.classes())))


def _mark(n: Node, name: str) -> None:
    if name not in n.classes():
        n.at["class"] = " ".join([*n.classes(), name])


def _after(n: Node) -> Node | None:
    kids = n.up.kids
    at = next(i for i, k in enumerate(kids) if k is n)
    return next((k for k in kids[at + 1 :] if isinstance(k, Node)), None)


def _lines(n: Node) -> int:
    return len(n.text().strip("\n").split("\n")) + sum(k.tag == "br" for k in n.walk())


def marked(content: Node) -> None:
    """Mark what print must keep together: short code boxes (print-keep),
    text before a code box or list in the same element (print-leadin), and a
    paragraph that ends with a colon before a table, or before one more
    paragraph and a code box or list (print-chain); blank paragraphs and those
    of images alone are named as such."""
    found: list[tuple[Node, bool]] = []

    def enter(n: Node, inside: bool) -> bool:
        found.append((n, inside))
        return inside or is_code(n)

    content.visit(any(map(is_code, content.above())), enter)
    for n, inside_code in found:
        if inside_code:
            continue
        if is_code(n):
            if _lines(n) <= KEEP_LINES:
                _mark(n, "print-keep")
            continue
        if n.tag == "p":
            text = n.text().strip(BLANK)
            images = any(k.tag in ("img", "svg") for k in n.walk())
            if not text:
                _mark(n, "print-image" if images else "print-blank")
            elif not images and text.endswith(":"):
                second = _after(n)
                third = _after(second) if second is not None else None
                to_list = third is not None and (is_code(third) or third.tag in ("ul", "ol"))
                if second is not None and (second.tag == "table" or second.tag == "p" and second.text().strip(BLANK) and to_list):
                    _mark(n, "print-chain")
        if n.tag in HOLDERS:
            out: list[Node | str] = []
            run: list[Node | str] = []
            for kid in n.kids:
                if not isinstance(kid, Node) or kid.tag not in BLOCKS:
                    run.append(kid)
                    continue
                text = "".join(k if isinstance(k, str) else k.text() for k in run)
                if text.strip(BLANK) and (is_code(kid) or kid.tag in ("ul", "ol")):
                    span = Node("span", {"class": "print-leadin"}, n)
                    span.kids = run
                    for k in run:
                        if isinstance(k, Node):
                            k.up = span
                    run = [span]
                out += [*run, kid]
                run = []
            n.kids = [*out, *run]


def section(html: str | None, anchor: str, destinations: dict[str, str] | None) -> list[tuple]:
    """(html, bookmarks, inside, outside): a topic as a section of the combined
    document. Ids get the anchor before them, the first of equal ones stays;
    links with a destination lead inside, others stay; scripts go."""
    doc, known, seen = tree(html), dict(destinations or {}), {}
    inside = outside = 0
    for n in list(doc.walk()):
        n.kids = [k for k in n.kids if not (isinstance(k, Node) and k.tag in ("script", "noscript", "template", "base", "meta", "link", "title"))]
        for key in [k for k in n.at if k.startswith("on")]:
            del n.at[key]
        old = n.at.pop("id", None) or (n.at.pop("name", None) if n.tag == "a" else None)
        if old and old not in seen:
            seen[old] = n.at["id"] = f"{anchor}-{old}"
    for n in doc.walk():
        href = n.at.get("href") if n.tag == "a" else None
        if href is None:
            continue
        target = seen.get(href[1:]) if href.startswith("#") else known.get(href)
        if target:
            n.at["href"] = f"#{target}"
            inside += 1
        else:
            outside += 1
    marked(doc)
    return [(f'<section id="{anchor}">{markup(doc)}</section>', list(seen.values()), inside, outside)]
