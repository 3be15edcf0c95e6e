"""A small HTML tree over the standard library's tokenizer.

It knows void elements, implied ends (paragraphs, list items, table cells, definitions, options), raw text in scripts and
styles, plain text in titles and text areas, and unclosed formatting. Formatting that is closed out of order isn't
re-parented, which changes the structure but not the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEAD = frozenset("title meta link style script base noscript template".split())
BLOCKS = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split())
#: For a starting tag: which open elements it ends, and up to which containers they are looked for.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "table"}), "dt": ({"dt", "dd"}, {"dl", "table"}), "dd": ({"dt", "dd"}, {"dl", "table"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
    "thead": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}), "tfoot": ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption"}, {"table"}),
}
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u span".split())


class Node:
    """An element: its tag, attributes, parent and children (elements and texts)."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def get(self, name: str, default: str | None = None) -> str | None:
        return self.attrs.get(name, default)

    def walk(self) -> Iterator[Node]:
        """All elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node))

    def find(self, *tags: str) -> Iterator[Node]:
        """Elements of some tags below this one."""
        return (n for n in self.walk() if n.tag in tags)

    def up(self) -> Iterator[Node]:
        """The elements around this one, nearest first."""
        node = self.parent
        while node is not None:
            yield node
            node = node.parent

    def texts(self, skip: frozenset[str] = frozenset()) -> Iterator[str]:
        """The texts below this element in order, without those inside some tags."""
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                yield item
            elif item.tag not in skip:
                stack.extend(reversed(item.children))

    def text(self) -> str:
        """The words of all texts, joined by single spaces."""
        return " ".join(w for t in self.texts() for w in t.split())

    def has(self, attribute: str, part: str) -> bool:
        """Whether an attribute holds a text, in any case."""
        return part in (self.attrs.get(attribute) or "").lower()

    def html(self) -> str:
        """The element as markup."""
        inner = "".join(c.html() if isinstance(c, Node) else c for c in self.children)
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>{inner}" + ("" if self.tag in VOID else f"</{self.tag}>")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {}, None)
        self.head = Node("head", {}, self.root)
        self.body = Node("body", {}, self.root)
        self.root.children = [self.head, self.body]
        self.open: list[Node] = [self.root, self.head]

    def _into_body(self) -> None:
        if len(self.open) == 2 and self.open[1] is self.head:
            self.open = [self.root, self.body]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open[-1].tag in ("title", "textarea"):
            self._put(self.get_starttag_text() or "")
            return
        found: dict[str, str] = {}
        for k, v in attrs:
            found.setdefault(k, v or "")
        if tag in ("html", "head", "body"):
            own = {"html": self.root, "head": self.head, "body": self.body}[tag]
            for k, v in found.items():
                own.attrs.setdefault(k, v)
            if tag == "body":
                self._into_body()
            return
        if tag not in HEAD:
            self._into_body()
        if tag in BLOCKS:
            self._end("p", stop={"table", "td", "th", "caption", "button", "object"})
        if tag in IMPLIED:
            ends, stop = IMPLIED[tag]
            self._imply(ends, stop)
        node = Node(tag, found, self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        # only foreign elements can end themselves
        if tag not in VOID and self.open[-1].tag == tag and any(n.tag in ("svg", "math") for n in self.open):
            self.open.pop()

    def _imply(self, ends: set[str], stop: set[str]) -> None:
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].tag in stop:
                return
            if self.open[k].tag in ends:
                del self.open[k:]
                return self._imply(ends, stop)
        return None

    def _end(self, tag: str, stop: set[str] | frozenset[str] = frozenset()) -> bool:
        for k in range(len(self.open) - 1, 1, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return True
            if self.open[k].tag in stop:
                return False
        return False

    def handle_endtag(self, tag: str) -> None:
        inner = self.open[-1].tag
        if inner in ("title", "textarea") and tag != inner:
            self._put(f"</{tag}>")
        elif tag == "head":
            self._into_body()
        elif tag in ("html", "body") or tag in VOID:
            return
        else:
            self._end(tag, BLOCKS | {"td", "th"} if tag in FORMATTING else {"td", "th"} - {tag} if tag not in ("table", "tr", "thead", "tbody", "tfoot") else frozenset())

    def handle_data(self, data: str) -> None:
        if len(self.open) == 2 and data.strip():
            self._into_body()
        self._put(data)

    def _put(self, text: str) -> None:
        """Adds text; neighbouring texts are one."""
        children = self.open[-1].children
        if children and isinstance(children[-1], str):
            children[-1] += text
        else:
            children.append(text)


def parse(html: str) -> Node:
    """The tree of a document; any text gives one, with a head and a body."""
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
    except (AssertionError, ValueError):  # of broken declarations; what was read so far stays
        pass
    return builder.root


_SCHEMES = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}
_KEEP = "!#$%&'()*+,/:;=?@[]~|"



def absolute(base: str, href: str) -> str | None:
    """``href`` as an absolute URL seen from ``base``, in normal form; null if it can't be one."""
    href = re.sub(r"[\t\n\r]", "", href).strip()
    try:
        scheme = urlsplit(base).scheme
        if scheme in _SCHEMES and not re.match(r"[A-Za-z][A-Za-z0-9+.\-]*:", href):
            cut = re.search(r"[?#]", href)
            head = href if cut is None else href[: cut.start()]
            href = head.replace("\\", "/") + ("" if cut is None else href[cut.start() :])
        parts = urlsplit(urljoin(base, href))
        if not parts.scheme:
            return None
        if parts.scheme not in _SCHEMES:
            return parts.geturl()
        name = (parts.hostname or "").encode("idna").decode() if parts.hostname and not parts.hostname.isascii() else parts.hostname
        if not name:
            return None
        port = parts.port
        login = parts.netloc.rpartition("@")[0]
        netloc = (login + "@" if login else "") + (f"[{name}]" if ":" in name else name) + (f":{port}" if port and port != _SCHEMES[parts.scheme] else "")
        path = quote(parts.path or "/", safe=_KEEP) if parts.path != "" else "/"
        return urlunsplit((parts.scheme, netloc, path, quote(parts.query, safe=_KEEP), quote(parts.fragment, safe=_KEEP)))
    except (ValueError, UnicodeError):
        return None


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, or an empty text."""
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""
