"""What one page's markup gives: metadata, links, navigation, footer, styles, typed content blocks."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable

from pagemill.functions.tables import CODE_LANGUAGES, EMBEDS, SHARE_MARKS, SOCIAL, UTILITY_LABELS
from pagemill.sources.html_tree import Node, absolute, host_of, parse

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
NOT_LINKS = ("javascript:", "#", "mailto:", "tel:")
CONTAINERS = frozenset(("blockquote", "pre", "dl", "table", "video", "audio"))
CLONES = frozenset(("swiper-slide-duplicate", "swiper-slide-duplicate-active", "slick-cloned"))
SKIPPED = frozenset(("nav", "header", "footer", "script", "style", "noscript"))
SKIPPED_ROLES = frozenset(("navigation", "banner", "contentinfo"))


def size(text: str) -> int:
    """Length in bytes, the measure of all thresholds."""
    return len(text) if text.isascii() else len(text.encode())


class Page:
    """One parsed page and its address."""

    def __init__(self, url: str, html: str):
        self.url, self.html = url, html
        self.root = parse(html)
        self.nodes = list(self.root.walk())
        self.body = next(n for n in self.nodes if n.tag == "body")

    def join(self, href: str) -> str | None:
        return absolute(self.url, href)

    def select(self, *tags: str) -> Iterable[Node]:
        return (n for n in self.nodes if n.tag in tags)

    def zones(self, tags: tuple[str, ...], roles: tuple[str, ...]) -> list[Node]:
        return [n for n in self.nodes if n.tag in tags or n.get("role") in roles]

    # metadata

    def meta(self) -> dict:
        """Titles, description, robots, image and card of the head."""
        first = next(self.select("title"), None)
        title = first.text() if first is not None else "No title"
        out: dict[str, str | None] = {"meta_title": "", "meta_description": "", "og_image_url": None, "twitter_card": None, "meta_robots": None}

        def keep(key: str, value: str) -> None:
            if value.strip() and out[key] is None:
                out[key] = value.strip()

        for n in self.select("meta"):
            content = n.get("content") or ""
            name = n.get("property")
            if name is not None:
                if name == "og:title":
                    out["meta_title"] = content
                elif name == "og:description":
                    out["meta_description"] = out["meta_description"] or content
                elif name == "og:image":
                    keep("og_image_url", content)
                continue
            name = n.get("name")
            if name in ("title", "description"):
                out["meta_" + name] = out["meta_" + name] or content
            elif name == "twitter:card":
                keep("twitter_card", content)
            elif name == "twitter:image":
                keep("og_image_url", content)
            elif name == "robots":
                keep("meta_robots", content.lower())
        return out | {"title": title, "meta_title": out["meta_title"] or title}

    def canonical_url(self) -> str | None:
        link = next((n for n in self.select("link") if n.get("rel") == "canonical"), None)
        return self.join(link.get("href")) if link is not None and link.get("href") is not None else None

    def language(self) -> str | None:
        return self.root.get("lang") or None

    def favicon_url(self) -> str | None:
        """The icon of the best kind: touch icon, plain icon, shortcut, others."""
        best: tuple[int, str] | None = None
        for n in self.select("link"):
            rel, href = n.get("rel") or "", n.get("href") or ""
            if not href or "icon" not in rel.split() and rel != "apple-touch-icon":
                continue
            low = rel.lower()
            rank = 3 if "apple-touch-icon" in low else 2 if low == "icon" else 1 if "shortcut" in low else 0
            url = self.join(href)
            if url and (best is None or rank > best[0]):
                best = (rank, url)
        return best[1] if best else None

    def hreflang_alternates(self) -> list[dict]:
        pairs: dict[tuple[str, str], None] = {}
        for n in self.select("link"):
            lang, href = n.get("hreflang"), n.get("href")
            if n.get("rel") == "alternate" and lang and href is not None and (url := self.join(href)):
                pairs.setdefault((lang.lower(), url))
        return [{"lang": a, "url": b} for a, b in pairs]

    def structured(self) -> list:
        """Valid JSON-LD values."""
        out = []
        for n in self.select("script"):
            if n.get("type") == "application/ld+json":
                try:
                    out.append(json.loads("".join(n.texts())))
                except (ValueError, RecursionError):
                    continue
        return out

    def logo_url(self) -> str | None:
        """The first picture of a header, logo or home link, else the logo that structured data name."""
        for n in self.select("img", "svg"):
            around = list(n.up())
            framed = any(a.tag == "header" or "logo" in (a.get("class") or "") or "logo" in (a.get("id") or "") for a in around)
            if not framed and n.tag == "img":
                framed = any(a.tag == "a" and (a.has("aria-label", "home") or a.get("href") == "/") for a in around)
            if not framed:
                continue
            if n.tag == "svg":
                return "inline-svg://logo"
            src = n.get("src") if n.get("src") is not None else n.get("data-src")
            if src and (url := self.join(src)):
                return url
        for value in _objects(self.structured()):
            if str(value.get("@type")).lower() in ("organization", "localbusiness", "website") and isinstance(value.get("@type"), str):
                logo = value.get("logo")
                logo = logo.get("url") if isinstance(logo, dict) else logo
                if isinstance(logo, str):
                    return logo
        return None

    # links

    def internal_links(self) -> list[str]:
        """Distinct links to the page's own host, without fragments."""
        own, out = host_of(self.url), {}
        for n in self.select("a"):
            href = n.get("href")
            if href is None or href.startswith(NOT_LINKS) or not own:
                continue
            url = self.join(href)
            if url and host_of(url) == own:
                out.setdefault(url.split("#", 1)[0])
        return list(out)

    def crawl_links(self) -> list[str]:
        """All links a crawler would follow, repeated ones too."""
        hrefs = (n.get("href") for n in self.select("a"))
        urls = (self.join(h) for h in hrefs if h and not h.startswith(NOT_LINKS))
        return [u.split("#", 1)[0] for u in urls if u and u.startswith(("http://", "https://"))]

    def stylesheet_urls(self) -> list[str]:
        hrefs = (n.get("href") for n in self.select("link") if n.get("rel") == "stylesheet")
        return list(dict.fromkeys(u for h in hrefs if h and not h.startswith("javascript:") and (u := self.join(h))))

    def nav_links(self) -> list[dict]:
        """Links of navigation with a label, the blurb of mega menus and a role."""
        out: dict[tuple[str, str], dict] = {}
        for zone in self.zones(("nav", "header"), ("navigation", "banner")):
            for n in zone.find("a"):
                href = n.get("href") or ""
                if not href or href.startswith(NOT_LINKS):
                    continue
                label, description = _label(n)
                url = self.join(href)
                if not label or not url or (label, url) in out:
                    continue
                host = host_of(url)
                if any(host == d or host.endswith("." + d) for _, d in SOCIAL):
                    role = "social"
                elif description is not None:
                    role = "mega_menu"
                else:
                    role = "utility" if label.lower() in UTILITY_LABELS else "footer" if zone.tag == "footer" else "header"
                out[label, url] = {"text": label, "href": url, "description": description, "role": role}
        return list(out.values())

    # texts

    def body_text(self) -> str:
        """Texts of the body outside scripts, styles and drawings, each followed by a space."""
        return "".join(t + " " for t in self.body.texts(frozenset(("script", "style", "svg", "noscript"))))

    def chrome_text(self) -> str:
        """Words of navigation, footer and of zones named for contact, address or footer."""
        zones = self.zones(("nav", "header"), ("navigation", "banner")) + self.zones(("footer",), ("contentinfo",))
        for n in self.nodes:
            if any(n.has(a, k) for a in ("class", "id") for k in ("contact", "address", "footer")) and not any(a.tag in ("nav", "header", "footer") for a in n.up()):
                zones.append(n)
        return "".join(z.text() + " " for z in zones)

    def style_text(self) -> str:
        """Style sheets of the page, style attributes of the body and all in it, and old colour attributes as style."""
        lines = ["".join(n.texts()) for n in self.select("style")]
        for n in (self.body, *self.body.walk()):
            if n.get("style") is not None:
                lines.append(n.get("style"))
            for name in ("bgcolor", "color"):
                value = (n.get(name) or "").strip()
                if value:
                    lines.append(f"background:{'' if value.startswith(('#', 'rgb', 'hsl')) else '#'}{value};")
        return "".join(line + "\n" for line in lines)

    def contact_links(self) -> list[str]:
        """Targets of mail and telephone links, in order."""
        return [h for n in self.select("a") if (h := n.get("href")) and h.startswith(("mailto:", "tel:"))]

    def social_links(self) -> list[dict]:
        """Profiles on social platforms that navigation or footer link to."""
        out: dict[tuple[str, str], None] = {}
        for zone in self.zones(("nav", "header"), ("navigation", "banner")) + self.zones(("footer",), ("contentinfo",)):
            for n in zone.find("a"):
                href = n.get("href")
                if href is None or any(m in href.lower() for m in SHARE_MARKS) or not (url := self.join(href)):
                    continue
                host = host_of(url)
                platform = next((p for p, d in SOCIAL if host == d or host.endswith("." + d)), None)
                if platform:
                    out.setdefault((platform, url))
        return [{"platform": p, "url": u} for p, u in out]

    def addresses(self) -> list[str]:
        """Postal addresses of structured data, sorted."""
        keys = ("streetAddress", "postOfficeBoxNumber", "addressLocality", "postalCode", "addressRegion", "addressCountry")
        found = set()
        for value in _objects(self.structured()):
            if isinstance(value.get("@type"), str) and value["@type"].lower() == "postaladdress":
                parts = [value[k] for k in keys if isinstance(value.get(k), str)]
                if parts:
                    found.add(", ".join(parts))
        return sorted(found)

    def organization(self) -> str | None:
        """The first organization of structured data, as JSON."""
        kinds = ("organization", "localbusiness")
        return next((json.dumps(v, ensure_ascii=False) for v in _objects(self.structured()) if isinstance(v.get("@type"), str) and v["@type"].lower() in kinds), None)

    # blocks

    def footer_blocks(self) -> list[dict]:
        """Headings, paragraphs and lists of the footer; without a footer, of what is named so."""
        zones = self.zones(("footer",), ("contentinfo",))
        if not zones:
            named = [n for n in self.nodes if n.has("class", "footer") or n.has("id", "footer")]
            zones = [n for n in named if not any(a.tag != n.tag and (a.has("class", "footer") or a.has("id", "footer")) for a in n.up())]
        out: list[dict] = []
        seen: set[str] = set()
        for zone in zones:
            for n in zone.walk():
                if any(a.tag in ("script", "style", "noscript") or a.get("aria-hidden") == "true" for a in n.up()):
                    continue
                if n.tag in HEADINGS or n.tag == "p":
                    text = n.text()
                    if text and text not in seen and (n.tag != "p" or size(text) > 5):
                        seen.add(text)
                        out.append({"type": "paragraph", "text": text} if n.tag == "p" else {"type": "heading", "level": int(n.tag[1]), "text": text})
                elif n.tag in ("ul", "ol") and (items := _items(n)):
                    out.append({"type": "list", "items": items})
        return out

    def content_blocks(self, max_images: int = 100, legacy_container_guard: bool = False) -> list[dict]:
        """Typed blocks of the main part, in document order."""
        root = next((n for n in self.nodes if n.tag in ("main", "article") or n.get("role") == "main"), self.body)
        made = _Blocks(self, max_images)
        hidden = any(_skipped(a) for a in (root, *root.up()))
        # element, whether it is inside a skipped zone, number of containers around it
        stack = [(c, hidden, sum(a.tag in CONTAINERS for a in (root, *root.up()))) for c in reversed(root.children) if isinstance(c, Node)]
        while stack:
            n, off, inside = stack.pop()
            off = off or _skipped(n)
            if not off:
                owned = inside - (n.parent.tag in CONTAINERS) if legacy_container_guard else inside
                if n.tag in CONTAINERS or not owned:
                    made.add(n)
            stack.extend((c, off, inside + (n.tag in CONTAINERS)) for c in reversed(n.children) if isinstance(c, Node))
        return without_repeats(made.blocks)


def _objects(value) -> Iterable[dict]:
    """All JSON objects in a value, outer ones first."""
    stack = [value]
    while stack:
        item = stack.pop()
        if isinstance(item, dict):
            yield item
            stack.extend(reversed(item.values()))
        elif isinstance(item, list):
            stack.extend(reversed(item))


def _label(link: Node) -> tuple[str, str | None]:
    full = link.text()
    heading = next(link.find(*HEADINGS), None)
    if heading is not None:
        label = heading.text()
        rest = full
        while label and rest.startswith(label):
            rest = rest[len(label) :]
        rest = rest.strip()
        return label, rest if rest and size(rest) < 500 else None
    mark = next((m for m in (". ", ": ") if m in full), None)
    if size(full) > 80 and mark:
        at = full.index(mark)
        return full[:at].strip(), full[at:].lstrip(":. ").strip() or None
    return full, None


def _items(n: Node) -> list[str]:
    """Items of a list that is in no other list."""
    if n.parent is not None and n.parent.tag in ("ul", "ol", "li"):
        return []
    return [t for li in n.find("li") if (t := li.text())]


def _skipped(n: Node) -> bool:
    return n.tag in SKIPPED or n.get("role") in SKIPPED_ROLES or n.get("aria-hidden") == "true" or not CLONES.isdisjoint((n.get("class") or "").split())


def without_repeats(blocks: list[dict]) -> list[dict]:
    """Blocks without long headings and paragraphs that only repeat the block before them."""
    out: list[dict] = []
    for b in blocks:
        same = out and b["type"] in ("heading", "paragraph") and size(b["text"]) > 30 and (out[-1]["type"], out[-1].get("level"), out[-1].get("text")) == (b["type"], b.get("level"), b["text"])
        if not same:
            out.append(b)
    return out


def embed_provider(src: str) -> str:
    """The platform of an embed."""
    low = src.lower()
    return next((name for name, marks in EMBEDS if any(m in low for m in marks)), "iframe")


def form_purpose(fields: list[dict], submit: str, action: str) -> str:
    """What a form is for, from its fields, button and target."""
    low = [{k: (f.get(k) or "").lower() for k in ("name", "label", "placeholder", "field_type")} for f in fields]
    whole = [f"{f['name']} {f['label']} {f['placeholder']} {f['field_type']}" for f in low]
    action, submit, n = action.lower(), submit.lower(), len(fields)

    def said(in_action: tuple[str, ...], in_submit: tuple[str, ...]) -> bool:
        return any(w in action for w in in_action) or any(w in submit for w in in_submit)

    def any_field(*words: str) -> bool:
        return any(w in text for text in whole for w in words)

    email = any_field("email", "e-mail")
    message = any(f["field_type"] == "textarea" for f in low) or any_field("message", "comment", "zpráv", "komentář")
    password = any(f["field_type"] == "password" for f in low)
    signup = said(("signup", "register"), ("sign up", "create account", "register", "registrovat"))
    login = said(("login", "signin"), ("log in", "sign in", "přihlásit"))
    rules = (
        ("search", n <= 2 and any(f["field_type"] == "search" or f["name"] in ("q", "s", "query", "search") for f in low)),
        ("payment", any("card" in f["name"] or "cc-number" in f["name"] for f in low) or any_field("credit card", "card number", "cvv", "cvc")),
        ("comment", said(("comment", "wp-comments-post"), ("comment", "odeslat komentář"))),
        ("login", password and (login or not signup) and n <= 4),
        ("signup", password and signup),
        ("newsletter", said(("subscribe", "newsletter"), ("subscribe", "odebírat")) or email and not message and n <= 2),
        ("contact", email and message),
    )
    return next((name for name, holds in rules if holds), "generic")


class _Blocks:
    """Makes blocks of elements; keeps what must be known of the whole page."""

    def __init__(self, page: Page, max_images: int):
        self.page, self.max_images = page, max_images
        self.blocks: list[dict] = []
        self.images: set[str] = set()
        self.kept = 0
        self.labels: dict[str, str] | None = None

    def add(self, n: Node) -> None:
        kind = "heading" if n.tag in HEADINGS else {"ul": "list", "ol": "list", "video": "media", "audio": "media"}.get(n.tag, n.tag)
        make = getattr(self, "_" + kind, None)
        block = make(n) if make else None
        if block:
            self.blocks.append(block)

    def _full(self) -> bool:
        return 0 < self.max_images <= self.kept

    def _heading(self, n: Node) -> dict | None:
        text = n.text()
        return {"type": "heading", "level": int(n.tag[1]), "text": text} if text else None

    def _p(self, n: Node) -> dict | None:
        text = n.text()
        return {"type": "paragraph", "text": text} if size(text) > 20 else None

    def _iframe(self, n: Node) -> dict | None:
        raw = n.get("src") if n.get("src") is not None else n.get("data-src") or ""
        if not raw or raw.startswith("about:"):
            return None
        src = self.page.join(raw) or raw
        return {"type": "embed", "provider": embed_provider(src), "src": src, "title": n.get("title") or ""}

    def _svg(self, n: Node) -> dict | None:
        markup = n.html()
        if not 50 <= size(markup) <= 200_000:
            return None
        name = hashlib.sha256(markup.encode()).hexdigest()[:16]
        url = f"inline-svg://{name}"
        if url in self.images:
            return None
        self.images.add(url)
        if self._full():
            return None
        self.kept += 1
        alt = n.get("aria-label") or next((t.text() for t in n.find("title")), "")
        return {"type": "image", "original_url": url, "local_path": f"images/svg-{name}.svg", "alt_text": alt}

    def _img(self, n: Node) -> dict | None:
        candidates: list[str] = []
        if n.parent is not None and n.parent.tag == "picture":
            widest, width = None, 0
            for source in n.parent.children:
                if isinstance(source, Node) and source.tag == "source":
                    for bits in (part.split() for part in (source.get("srcset") or "").split(",")):
                        w = int(bits[1].rstrip("w")) if len(bits) > 1 and bits[1].rstrip("w").isdigit() else 0
                        if bits and (widest is None or w > width):
                            widest, width = bits[0], w
            candidates += [widest] if widest else []
        candidates += [n.get(k) for k in ("src", "data-src") if n.get(k) is not None]
        candidates += [bits[0] for bits in (part.split() for part in (n.get("srcset") or "").split(",")) if bits]
        alt = n.get("alt") or ""
        if not alt:
            figure = next((a for a in n.up() if a.tag == "figure"), None)
            alt = next((c.text() for c in figure.find("figcaption")), "") if figure is not None else ""
        for raw in candidates:
            url = self.page.join(raw)
            if url is None or url.startswith("data:") or "1x1" in url or "placeholder" in url:
                continue
            if url in self.images:
                return None
            self.images.add(url)
            if self._full():
                return None
            self.kept += 1
            return {"type": "image", "original_url": url, "local_path": "", "alt_text": alt}
        return None

    def _list(self, n: Node) -> dict | None:
        items = _items(n)
        return {"type": "list", "items": items} if items else None

    def _form(self, n: Node) -> dict:
        raw = n.get("action") or ""
        action = (self.page.join(raw) or raw) if raw else ""
        fields = []
        for f in n.find("input", "textarea", "select"):
            kind = f.get("type") if f.get("type") is not None else f.tag
            if kind in ("hidden", "submit", "button"):
                continue
            options = [t for o in f.find("option") if (t := o.text())] if f.tag == "select" else []
            fields.append({"field_type": kind, "name": f.get("name") or "", "label": self._label_of(f), "placeholder": f.get("placeholder") or "", "required": f.get("required") is not None, "options": options})
        submit = "Submit"
        for b in n.find("button", "input"):
            if b.get("type") == "submit" or b.tag == "button" and b.get("type") is None:
                submit = b.get("value", "Submit") if b.tag == "input" else b.text() or "Submit"
                break
        return {"type": "form", "action": action, "method": (n.get("method") or "get").upper(), "fields": fields, "submit_text": submit, "purpose": form_purpose(fields, submit, action)}

    def _label_of(self, field: Node) -> str:
        if self.labels is None:
            self.labels = {}
            for n in self.page.select("label"):
                if n.get("for") is not None:
                    self.labels.setdefault(n.get("for"), n.text())
        named = self.labels.get(field.get("id"), "") if field.get("id") is not None else ""
        return named or next((a.text() for a in field.up() if a.tag == "label"), "")

    def _pre(self, n: Node) -> dict | None:
        code = next(n.find("code"), None)
        classes = (code.get("class") if code is not None and code.get("class") is not None else n.get("class") or "").split()
        language = next((re.sub("^lang(?:uage)?-", "", c) for c in classes if c.startswith(("language-", "lang-"))), None)
        if language is None:
            language = next((c.lower() for c in classes if c.lower() in CODE_LANGUAGES), None)
        text = "".join((code if code is not None else n).texts())
        return {"type": "code", "language": language, "text": text.rstrip()} if size(text.strip()) >= 4 else None

    def _blockquote(self, n: Node) -> dict | None:
        text = n.text()
        return {"type": "quote", "text": text, "cite": n.get("cite") or None} if size(text) >= 8 else None

    def _media(self, n: Node) -> dict | None:
        raw = n.get("src")
        if raw is None:
            raw = next((s.get("src") for s in n.find("source")), None)
        if raw is None:
            return None
        poster = self.page.join(n.get("poster")) if n.get("poster") is not None else None
        return {"type": "media", "kind": n.tag, "src": self.page.join(raw) or raw, "poster": poster, "title": n.get("title") or ""}

    def _dl(self, n: Node) -> dict | None:
        pairs: list[tuple[str, str]] = []
        term = None
        for c in n.children:
            if isinstance(c, Node) and c.tag == "dt":
                term = c.text() or term
            elif isinstance(c, Node) and c.tag == "dd" and term is not None and (d := c.text()):
                pairs.append((term, d))
        if not pairs:
            pairs = [(a.text(), b.text()) for a, b in zip(n.find("dt"), n.find("dd"), strict=False)]
        found = [{"term": a, "description": b} for a, b in pairs if a and b]
        return {"type": "definitionlist", "definitions": found} if found else None

    def _table(self, n: Node) -> dict | None:
        if any(a.tag == "table" for a in n.up()):
            return None
        headers: list[str] = []
        rows: list[list[str]] = []
        for tr in n.find("tr"):
            if sum(a.tag == "table" for a in tr.up()) > 1:
                continue
            heads = [c.text() for c in tr.find("th")]
            if heads and not headers and not rows:
                headers = heads
                continue
            cells = [c.text() for c in tr.find("td")]
            if cells:
                rows.append(cells)
        if not rows or len(rows) < 2 and len(rows[0]) < 2 and not headers:
            return None
        caption = next((c.text() for c in n.find("caption")), None)
        return {"type": "table", "caption": caption or None, "headers": headers, "rows": rows}
