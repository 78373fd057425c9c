"""What generated pages must not hold; deep nesting costs no more than breadth."""

import time

import pytest

from docloom.functions import content, dom, policy, printing


def problems(html, name="a.html", **kw):
    found = policy.policy_problems(name, html, **kw)
    assert [i for i, _ in found] == list(range(len(found))) and all(p.startswith(f"{name}: ") for _, p in found)
    return [p.removeprefix(f"{name}: ") for _, p in found]


@pytest.mark.parametrize(
    "html, want",
    [
        ('<head><meta charset="utf-8"><base target="x"><link rel="StyleSheet x" href="/a.css"></head>', []),
        ('<head><base href="/"></head>', ["active <base> element remains in archived output", "unsanitized href attribute on <base>: /"]),
        ('<head><meta http-equiv="Refresh" content="0"></head>', ["active <meta> element remains in archived output", "unsanitized http-equiv attribute on <meta>: Refresh"]),
        ('<head><meta http-equiv="Content-Security-Policy" content="x"></head>', []),
        ('<link rel="stylesheet" href="a.css">', ["active <link> element remains in archived output", "unsanitized href attribute on <link>: a.css"]),
        ('<aside class="archive-toc"><iframe src="../toc.html"></iframe></aside>', []),
        ("<iframe src='toc.html'></iframe>", ["active <iframe> element remains in archived output"]),
        ('<a href="https://x/y">a</a><a href="mailto:x">b</a><a href="/x">c</a><a href="tel:1">d</a>', []),
        ('<a href="https:/x">a</a><area href="JavaScript:x">', ["unsanitized href attribute on <a>: https:/x", "unsanitized href attribute on <area>: JavaScript:x"]),
        ('<img src="a.png" srcset="b.png 2x, c.png"><img src="data:image/png;base64,x">', []),
        ('<img src="//h/a.png" srcset="a.png, https://h/b.png 2x">', ["unsanitized src attribute on <img>: //h/a.png", "unsanitized srcset attribute on <img>: a.png, https://h/b.png 2x"]),
        ('<object data="a"></object><video poster="p"></video>', ["active <object> element remains in archived output", "unsanitized data attribute on <object>: a", "unsanitized poster attribute on <video>: p"]),
        ('<p onClick="x" style="background:url(https://h/x)">t</p>', ["event handler attribute onclick on <p>", "style attribute on <p>: https://h/x"]),
        ("<style>a{background:url(https://h/x)}</style>", ["stylesheet: https://h/x"]),
        ('<img usemap="#m"><img usemap="m">', ["unsanitized usemap attribute on <img>: m"]),
        (f'<q cite="{"x" * 300}">', [f"unsanitized cite attribute on <q>: {'x' * 197}..."]),
        (None, []),
    ],
)
def test_pages(html, want):
    assert problems(html) == want


def test_index_page_may_search():
    html = '<head><script src="search.js"></script></head><input data-guide-search>'
    assert problems(html, "index.html") == [] and len(problems(html)) == 2
    assert problems('<head><script src="a.js">x</script></head>', "index.html") == ["active <script> element remains in archived output"]


@pytest.mark.parametrize(
    "svg, want",
    [
        ('<linearGradient id="a" xmlns:x="u"/><use href="#a"/><image href="data:image/png;base64,x"/><a xlink:href="https://h/">t</a>', []),
        ("<script>x</script><foreignObject><p>t</p></foreignObject>", ["unsupported SVG element <script>", "unsupported SVG element <foreignObject>", "unsupported SVG element <p>"]),
        ('<title><b>t</b></title><g onload="x" foo:bar="y" xml:space="preserve"/>', ["unsupported SVG element <b>", "unsupported SVG attribute onload on <g>", "unsupported SVG attribute bar on <g>"]),
        ('<use href="https://h/x#a"/><feImage href="data:text/html,x"/><path href="b"/>', ["SVG <use> reference is not local https://h/x#a", "SVG <feImage> reference is not local data:text/html,x", "SVG <path> reference is not local b"]),
        ('<set attributeName="HREF"/><animate attributeName="fill" to="url(https://h/x)"/><animate attributeName="fill" to="red"/>', ["unsupported SVG element <set>", "unsupported SVG element <animate>"]),
        ('<rect fill="url(https://h/x)" style="fill:url(#a)"/><style>g{mask:url(//h/x)}</style>', ["SVG fill attribute: https://h/x", "SVG stylesheet: //h/x"]),
    ],
)
def test_vectors(svg, want):
    assert problems(f"<div><svg>{svg}</svg></div>") == want


def test_vector_attributes_by_a_list():
    assert problems('<svg viewBox="0" odd="1" data-x="2"></svg>', svg_attributes=frozenset({"viewbox"})) == ["unsupported SVG attribute odd on <svg>"]
    assert problems("<svg></svg><form></form>") == ["active <form> element remains in archived output"]


def test_twenty_thousand_nested_elements():
    html = "<div>" * 20_000 + "text</p></b>" + "</span>" * 5_000 + "</div>" * 20_000
    start = time.process_time()
    assert policy.policy_problems("a", html) == [] and content.evidence(html) == [("text", "text")]
    assert printing.section(html, "a", {})[0][0].count("<div>") == 20_000
    root = dom.tree(html)
    assert sum(1 for _ in root.walk()) == 20_001 and time.process_time() - start < 4


def test_visit_hands_states_down():
    seen = []
    dom.tree("<a><b>x</b></a><c></c>").visit(0, lambda n, depth: seen.append((n.tag, depth)) or depth + 1)
    assert seen == [("#document", 0), ("a", 1), ("b", 2), ("c", 1)]
