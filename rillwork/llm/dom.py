"""HTML to a tree of blocks with features of each block, and the text that each block holds."""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass, field
from html.parser import HTMLParser

# Fixed values of HTML: elements without an end tag, elements that are never shown as text, elements that can stand
# in a head, elements inside a line of text, and start tags that end an open element.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = frozenset("head title script style template noscript iframe object svg math canvas audio video".split())
HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strike strong sub "
    "sup time tt u var wbr".split())
ENDS_P = frozenset(
    "address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hr main menu nav ol p pre section table ul".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody"}, "tfoot": {"tbody"}}
SCOPE = frozenset("html body table ul ol dl div section article main td th aside nav form blockquote".split())
SPACE = re.compile(r"\s+")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Node:
    """A block element. ``text`` are the finished blocks of text that it holds itself, with their place."""

    tag: str
    parent: int
    names: frozenset
    label: int | None = None
    text: list[tuple[int, str]] = field(default_factory=list)
    chars: int = 0
    links: int = 0


class Blocks(HTMLParser):
    """Tree of block elements; inline elements only count as text of the block around them.

    As in browsers, what cannot stand in a head closes it and opens a body that the page left out. Loose text of a body
    is a block of its own, up to the next block element, and is scored as a paragraph.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.nodes = [Node("root", -1, frozenset())]
        self.open: list[tuple[str, int]] = [("root", 0)]  # every open element and its block
        self.places: dict[str, list[int]] = defaultdict(list)  # where in ``open`` the elements of a tag stand
        self.held: list[str] = []
        self.hidden = 0  # open elements that are not shown
        self.in_link = 0
        self.place = 0
        self.loose: int | None = None  # the block of the loose text that is held

    def _in_body(self) -> None:
        """Close an open head and open the body if what follows stands above it."""
        if self.open[-1][0] == "head":
            self._pop(len(self.open) - 1)
        if self.open[-1][0] in ("root", "html"):
            self._flush()
            tag, at = self.open[-1]
            self.nodes.append(Node("body", at, frozenset({"tag=body", f"in={tag}"})))
            self._push("body", len(self.nodes) - 1)

    def _push(self, tag: str, node: int) -> None:
        self.places[tag].append(len(self.open))
        self.open.append((tag, node))

    def _last(self, tags: set | frozenset) -> int:
        """Place of the innermost open element of these tags, 0 if there is none. No search: deep pages stay cheap."""
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)

    def _block(self) -> Node:
        """The block that text belongs to."""
        at = self.open[-1][1]
        if self.nodes[at].tag != "body":
            return self.nodes[at]
        if self.loose is None:
            self.nodes.append(Node("p", at, frozenset({"tag=p", "in=body"})))
            self.loose = len(self.nodes) - 1
        return self.nodes[self.loose]

    def _flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.held)).strip()
        self.held.clear()
        if text:
            self._block().text.append((self.place, text))
            self.place += 1
        self.loose = None

    def _pop(self, at: int) -> None:
        """Close the open elements from ``at`` on."""
        if any(tag not in INLINE for tag, _ in self.open[at:]):
            self._flush()
        for tag, _ in self.open[at:]:
            self.hidden -= tag in UNSEEN
            self.in_link -= tag == "a"
            self.places[tag].pop()
        del self.open[at:]

    def _end_within_scope(self, tags: set | frozenset, scope: frozenset) -> None:
        at = self._last(tags)
        if at and at >= self._last(scope):
            self._pop(at)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("html", "head", "body"):
            if any(t == "body" for t, _ in self.open[1:3]):
                return
        elif tag not in HEAD:
            self._in_body()
        if tag == "br":
            self.held.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self._end_within_scope({"p"}, SCOPE)
                self._flush()
            return
        if tag in ENDS_P:
            self._end_within_scope({"p"}, SCOPE)
        if tag in ENDS:
            self._end_within_scope(ENDS[tag], frozenset({"table", "ul", "ol", "dl", "select", "tr" if tag in ("td", "th") else "table"}))
        if tag == "body":
            self._end_within_scope({"head"}, frozenset())
        if tag in INLINE:
            self.in_link += tag == "a"
            self._push(tag, self.open[-1][1])
            return
        self._flush()
        values = {k: v or "" for k, v in attrs}
        names = {f"tag={tag}", f"in={self.nodes[self.open[-1][1]].tag}"}
        for key in ("class", "id", "role", "aria-label", "itemprop"):
            names |= {f"name={t.lower()}" for t in TOKEN.findall(values.get(key, ""))}
        style = values.get("style", "").replace(" ", "").lower()
        if "hidden" in values or values.get("aria-hidden") == "true" or "display:none" in style:
            names.add("name=hidden")
        label = int(values["data-content"]) if values.get("data-content") in ("0", "1") else None
        self.nodes.append(Node(tag, self.open[-1][1], frozenset(names), label))
        self.hidden += tag in UNSEEN
        self._push(tag, len(self.nodes) - 1)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and tag in ("svg", "math", "iframe", "object"):
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        at = self._last({tag})
        if at and (tag not in INLINE or at > self._last(SCOPE)):
            self._pop(at)

    def handle_data(self, data: str) -> None:
        shown = len(data.strip().strip("\ufeff"))
        if shown and self.open[-1][0] in ("root", "html", "head"):
            self._in_body()
        if self.hidden:
            return
        self.held.append(data)
        if not shown:
            return
        node = self._block()
        node.chars += shown
        node.links += shown if self.in_link else 0

    def finish(self) -> list[Node]:
        self.close()
        self._flush()
        return self.nodes


def parse(html: str) -> list[Node]:
    blocks = Blocks()
    blocks.feed(html)
    return blocks.finish()


def features(nodes: list[Node]) -> list[list[str]]:
    """Names of each node's features: its tag, names and roles, those of the two elements around it,
    and what text its subtree holds."""
    chars = [n.chars for n in nodes]
    links = [n.links for n in nodes]
    for at in range(len(nodes) - 1, 0, -1):
        chars[nodes[at].parent] += chars[at]
        links[nodes[at].parent] += links[at]
    out = []
    for at, node in enumerate(nodes):
        size = "none" if not chars[at] else "short" if chars[at] < 40 else "line" if chars[at] < 160 else "long"
        share = "none" if not links[at] else "some" if 2 * links[at] < chars[at] else "most"
        above: set[str] = set()
        parent = node.parent
        for _ in range(2):
            if parent >= 0:
                above |= {f"under-{n}" for n in nodes[parent].names if n.startswith("name=")}
                parent = nodes[parent].parent
        out.append([*node.names, *above, f"size={size}", f"links={share}", f"{node.tag}:{share}", "bias"])
    return out
