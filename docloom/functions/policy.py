"""What generated pages must not hold: one pass over a page's tree.

Each element is looked at once, with the state that its ancestors hand down
(inside the head, inside a vector image, inside foreign content of one), so deep
nesting costs no more than breadth."""

from __future__ import annotations

import re
import unicodedata

from .content import set_members
from .css import problem as css_problem
from .dom import Node, tree
from .text import SPACE

# Elements and attributes as the rules name them.
REMOVED = set("base bgsound button fencedframe form frame frameset input keygen link meta noembed noframes noscript param portal script select template textarea".split())
EMBEDDED = {"object", "embed", "applet"}
URL_KEYS = set("action archive attributionsrc background cite classid codebase data dynsrc formaction href http-equiv imagesrcset longdesc lowsrc manifest ping poster profile src srcdoc srcset usemap xlink:href".split())
SVG_ELEMENTS = (
    "a animate animateMotion animateTransform circle clipPath defs desc ellipse feBlend feColorMatrix feComponentTransfer feComposite feConvolveMatrix "
    "feDiffuseLighting feDisplacementMap feDistantLight feDropShadow feFlood feFuncA feFuncB feFuncG feFuncR feGaussianBlur feImage feMerge feMergeNode "
    "feMorphology feOffset fePointLight feSpecularLighting feSpotLight feTile feTurbulence filter g image line linearGradient marker mask metadata mpath "
    "path pattern polygon polyline radialGradient rect set stop style svg switch symbol text textPath title tspan use view"
).split()
SVG_ANIMATIONS = {"animate", "animateMotion", "animateTransform", "set"}
SVG_URL_KEYS = set("clip-path cursor fill filter marker marker-end marker-mid marker-start mask stroke".split())
#: Elements of a vector image whose content is markup of the page again.
SVG_HOLES = {"foreignobject", "desc", "title"}

_SVG_NAMES = {n.lower(): n for n in [*SVG_ELEMENTS, "foreignObject"]}


def local_reference(value: str) -> bool:
    """A reference that stays in the archive: empty, a fragment, data, or an
    address without scheme and host."""
    v = value.strip()
    if not v or v.startswith("#") or v.lower().startswith("data:"):
        return True
    if v.startswith(("//", "\\\\")) or any(unicodedata.category(c) == "Cc" for c in v):
        return False
    plain = re.sub(r"\?[^#]*", "", v)
    return not re.match(r"[A-Za-z][A-Za-z\d+.\-]*:|:", v) and not re.search(r"%(?![\dA-Fa-f]{2})", plain)


def navigable(value: str) -> bool:
    """A link that a reader may follow: local, or named as http(s) with a host,
    mail or telephone."""
    v = value.strip()
    lower = v.lower()
    if lower.startswith(("mailto:", "tel:")):
        return True
    return not lower.startswith("data:") and (local_reference(v) or bool(re.match(r"https?://[^/?#]", lower)))


def bounded(value: str, limit: int = 200) -> str:
    v = re.sub(SPACE, " ", value).strip()
    return v if len(v) <= limit else v[: limit - 3] + "..."


def _allowed(name: str, n: Node, head: bool) -> bool:
    at = n.at
    match n.tag:
        case "script":
            return head and name == "index.html" and bool(at.get("src")) and not n.kids
        case "meta":
            return head and at.get("http-equiv", "content-security-policy").lower() == "content-security-policy"
        case "base":
            return head and "href" not in at
        case "link":
            return head and "stylesheet" in at.get("rel", "").lower().split()
        case "iframe":
            return n.up is not None and "archive-toc" in n.up.classes()
        case "input":
            return name == "index.html" and "data-guide-search" in at
    return n.tag not in EMBEDDED and n.tag not in REMOVED


def _attribute(n: Node, key: str, value: str, head: bool) -> str | None:
    data = value.strip().lower().startswith("data:")
    if key.startswith("on"):
        return f"event handler attribute {key} on <{n.tag}>"
    if key == "style":
        found = css_problem(value)
        return f"style attribute on <{n.tag}>: {found}" if found else None
    if key == "http-equiv" and head and n.tag == "meta" and value.strip().lower() == "content-security-policy":
        return None
    if key not in URL_KEYS and not key.startswith("xlink:"):
        return None
    fine = {
        "href": n.tag in ("a", "area") and navigable(value) or n.tag == "link" and head and not data and local_reference(value),
        "src": n.tag in ("img", "source") and local_reference(value) or n.tag in ("iframe", "script") and not data and local_reference(value),
        "srcset": n.tag in ("img", "source") and all(map(local_reference, set_members(value))),
        "background": local_reference(value),
        "usemap": value.strip().startswith("#"),
    }
    return None if fine.get(key) else f"unsanitized {key} attribute on <{n.tag}>: {bounded(value)}"


def _animation(n: Node) -> bool:
    target = n.at.get("attributename", "").strip().lower().rpartition(":")[2]
    return target not in ("href", "style") and not target.startswith("on") and not any(css_problem(n.at.get(k, "")) for k in ("from", "to", "by", "values"))


def _svg_reference(tag: str, value: str) -> bool:
    v = value.strip()
    data = v.lower().startswith("data:")
    if not v or v.startswith("#"):
        return True
    if tag == "a":
        return navigable(v)
    if tag in ("image", "feImage"):
        return v.lower().startswith("data:image/") or not data and local_reference(v)
    return tag == "use" and not data and local_reference(v)


def _svg(n: Node, hole: bool, attributes: frozenset[str] | None) -> list[str]:
    """Problems of one element inside a vector image. Only with a list of
    attributes are others than handlers and foreign ones refused."""
    tag, out = _SVG_NAMES.get(n.tag, n.tag), []
    if hole or tag not in SVG_ELEMENTS or tag in SVG_ANIMATIONS and not _animation(n):
        return [f"unsupported SVG element <{tag}>"]
    for key, value in reversed(n.at.items()):
        space, _, bare = key.rpartition(":")
        known = attributes is None or bare in ("href", "style") or bare in attributes or bare.startswith(("aria-", "data-"))
        kept = {"": not key.startswith("on") and known, "xlink": bare == "href", "xml": bare in ("space", "lang"), "xmlns": True}.get(space, False)
        if not kept:
            out.append(f"unsupported SVG attribute {bare} on <{tag}>")
        elif bare == "href":
            if not _svg_reference(tag, value):
                out.append(f"SVG <{tag}> reference is not local {value}")
        elif not space and (key == "style" or key in SVG_URL_KEYS) and (found := css_problem(value)):
            out.append(f"SVG {key} attribute: {found}")
    if tag == "style" and (found := css_problem(n.text())):
        out.append(f"SVG stylesheet: {found}")
    return out


def policy_problems(name: str, html: str | None, svg_attributes: frozenset[str] | None = None) -> list[tuple]:
    """(ord, problem): what could run script, load or submit to an address
    outside the archive, or redirect a generated page."""
    out: list[str] = []

    def enter(n: Node, state: tuple[bool, bool, bool]) -> tuple[bool, bool, bool]:
        head, svg, hole = state
        if svg or n.tag == "svg":
            out.extend(_svg(n, hole, svg_attributes))
            return head, True, hole or n.tag in SVG_HOLES
        head = head or n.tag == "head"
        if n.tag != "#document":
            if not _allowed(name, n, head):
                out.append(f"active <{n.tag}> element remains in archived output")
            out.extend(p for key, value in reversed(n.at.items()) if (p := _attribute(n, key, value, head)))
            if n.tag == "style" and (found := css_problem(n.text())):
                out.append(f"stylesheet: {found}")
        return head, False, False

    tree(html).visit((False, False, False), enter)
    return [(i, f"{name}: {p}") for i, p in enumerate(out)]
