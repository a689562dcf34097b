"""A small document tree on the standard HTML parser, and the extraction of articles from it.

Trees of malformed pages follow simple rules (void elements, implied ends of
paragraphs, list items and table parts); they are not those of any browser.
Removed elements take their subtrees with them; what lies inside is not looked
at again.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

# Fixed values.
BLOCKED_TAGS = frozenset("script style noscript iframe object embed applet canvas video audio track source svg math form input button select textarea label fieldset legend".split())
SEMANTIC_NOISE = frozenset("nav header footer aside figure".split())
SKIPPED_PARENTS = frozenset("script style noscript iframe nav header footer aside form button select textarea figcaption".split())
NOISE_TESTED = frozenset("div section span ul li p".split())
NOISE = re.compile(
    "|".join(
        [
            r"\bad(s|vert(is(ement)?)?)?[-_ ]",
            r"\bcookie[-_ ]",
            r"\bbanner[-_ ]",
            r"\bpopup[-_ ]",
            r"\bmodal\b",
            r"\boverlay\b",
            r"\bnewsletter\b",
            r"\bsubscribe\b",
            r"\bsocial[-_ ](share|media|button)",
            r"\bshare[-_ ]",
            r"\brelated[-_ ](article|post|story)",
            r"\brecommend",
            r"\bcomment[-_ ]",
            r"\bsidebar\b",
            r"\bwidget\b",
            r"\bmenu\b",
            r"\bnav(igation)?\b",
            r"\bheader\b",
            r"\bfooter\b",
            r"\bbreatcrumb\b",
            r"\bpagination\b",
            r"\btag[-_]cloud\b",
            r"\bcategory[-_]list\b",
        ]
    )
)
CONTAINER_NOISE = re.compile(r"comment|sidebar|widget|social|share|related|recommend|ad[s\-_]|advert|cookie|banner|popup|newsletter|subscribe|nav(igation)?|menu|footer|header|breadcrumb", re.I)
IMAGE_NOISE = re.compile(r"pixel|tracker|beacon|logo|icon|avatar|favicon|spinner|loading|ad[s_\-]", re.I)
BODY_CLASSES = ["article-body", "post-content", "entry-content", "story-body", "article__body", "content-body"]
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Open elements that a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
PARAGRAPH_ENDERS = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = frozenset("ul ol table div section article body html td th dl".split())

_WORD = re.compile(r"\b\w+\b")


class Node:
    __slots__ = ("attrs", "kids", "parent", "tag")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent, self.kids = tag, attrs, parent, []

    def walk(self) -> Iterator[Node]:
        """Elements below this one in document order."""
        stack = [k for k in reversed(self.kids) if isinstance(k, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack += [k for k in reversed(n.kids) if isinstance(k, Node)]

    def strings(self) -> Iterator[tuple[str, str]]:
        """(tag of the direct parent, text) of all text below."""
        stack: list = [(self, k) for k in reversed(self.kids)]
        while stack:
            parent, k = stack.pop()
            if isinstance(k, str):
                yield parent.tag, k
            else:
                stack += [(k, x) for x in reversed(k.kids)]

    def joined(self) -> str:
        return "".join(t.strip() for _, t in self.strings())

    def get(self, name: str) -> str:
        return self.attrs.get(name, "")


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {}, None)
        self.at = self.root

    def _end(self, tags: set[str] | frozenset[str]) -> None:
        n = self.at
        while n.parent and n.tag not in tags and n.tag not in SCOPES:
            n = n.parent
        if n.tag in tags and n.parent:
            self.at = n.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in PARAGRAPH_ENDERS:
            self._end({"p"})
        if tag in ENDS:
            self._end(ENDS[tag])
        merged: dict[str, str] = {}
        for k, v in attrs:
            merged.setdefault(k, v or "")
        n = Node(tag, merged, self.at)
        self.at.kids.append(n)
        if tag not in VOID:
            self.at = n

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        n = self.at
        while n.parent and n.tag != tag:
            n = n.parent
        if n.parent:
            self.at = n.parent

    def handle_data(self, data: str) -> None:
        self.at.kids.append(data)


def parse(html: str) -> Node:
    """DOM-01: the tree of a page; comments (DOM-03) are never part of it."""
    b = _Builder()
    b.feed(html)
    b.close()
    return b.root


def is_noise(n: Node) -> bool:
    """DOM-02, 04, 05: whether an element goes."""
    if n.tag in BLOCKED_TAGS or n.tag in SEMANTIC_NOISE:
        return True
    return n.tag in NOISE_TESTED and bool(NOISE.search(f"{n.get('class')} {n.get('id')} {n.get('role')}".lower()))


def clean(root: Node) -> Node:
    """The tree without its noise, in place."""
    stack = [root]
    while stack:
        n = stack.pop()
        n.kids = [k for k in n.kids if isinstance(k, str) or not is_noise(k)]
        stack += [k for k in n.kids if isinstance(k, Node)]
    return root


def first(root: Node, tag: str | None = None, **attrs: str) -> Node | None:
    return next((n for n in root.walk() if (tag is None or n.tag == tag) and all(n.attrs.get(k) == v for k, v in attrs.items())), None)


def opengraph(root: Node) -> dict[str, str]:
    """EXT-05: content by property, else name, of every meta element; the last wins."""
    out = {}
    for n in root.walk():
        if n.tag == "meta" and (key := n.get("property") or n.get("name")) and n.get("content"):
            out[key] = n.get("content")
    return out


def _scripts(root: Node) -> Iterator[object]:
    for n in root.walk():
        if n.tag == "script" and n.get("type") == "application/ld+json":
            try:
                yield json.loads("".join(t for _, t in n.strings()))
            except ValueError:
                continue


def jsonld(root: Node) -> dict:
    """EXT-04: all blocks merged, later keys winning; malformed blocks are left out. Cleaned trees have none."""
    out: dict = {}
    for block in _scripts(root):
        for item in block if isinstance(block, list) else [block]:
            if isinstance(item, dict):
                out |= item
    return out


def metadata(root: Node, url: str) -> dict:
    """EXT-01, EXT-06."""
    og, ld = opengraph(root), jsonld(root)
    title = first(root, "title")
    link = first(root, "link", rel="canonical")
    image = ld.get("image")
    words = next((n.get("content") for n in root.walk() if n.tag == "meta" and n.get("name") == "keywords"), "")
    return {
        "og_title": og.get("og:title") or ld.get("headline") or (title.joined() if title else None) or None,
        "og_description": og.get("og:description") or ld.get("description") or og.get("description") or None,
        "og_image": og.get("og:image") or (image if isinstance(image, str) else None) or None,
        "canonical_url": og.get("og:url") or (link.get("href") if link else None) or url,
        "keywords": [w.strip() for w in re.split("[,;]", words) if w.strip()],
    }


def author(root: Node) -> str | None:
    """EXT-02."""
    for block in _scripts(root):
        for item in block if isinstance(block, list) else [block]:
            who = item.get("author") if isinstance(item, dict) else None
            who = who[0] if isinstance(who, list) and who else who
            name = who.get("name") if isinstance(who, dict) else who
            if isinstance(name, str) and name.strip():
                return name.strip()
    for key in ({"name": "author"}, {"name": "article:author"}, {"property": "article:author"}):
        n = first(root, "meta", **key)
        if n and n.get("content"):
            return n.get("content").strip()
    n = first(root, None, itemprop="author")
    return ((first(n, None, itemprop="name") or n).joined() or None) if n else None


def published(root: Node) -> list[str]:
    """EXT-03: the dates to try in order; a date of JSON-LD is final, parsable or not."""
    ld = jsonld(root)
    if raw := ld.get("datePublished") or ld.get("dateModified"):
        return [str(raw)]
    out = []
    for key in ({"property": "article:published_time"}, {"name": "published_time"}, {"name": "date"}, {"itemprop": "datePublished"}):
        n = first(root, "meta", **key)
        if n and n.get("content"):
            out.append(n.get("content"))
    n = next((n for n in root.walk() if n.tag == "time" and "datetime" in n.attrs), None)
    return [*out, n.get("datetime")] if n else out


def text_of(n: Node) -> str:
    """EXT-10."""
    return " ".join(s for tag, t in n.strings() if tag not in SKIPPED_PARENTS and (s := t.strip()))


def score(n: Node) -> float:
    """EXT-08: paragraphs and their text, less the share of links in it."""
    paras, links, n_paras = 0, 0, 0
    for x in n.walk():
        if x.tag == "p":
            n_paras += 1
            paras += len(x.joined())
        elif x.tag == "a":
            links += len(x.joined())
    return density(n_paras, paras, links)


def density(n_paras: int, paras: int, links: int) -> float:
    if not n_paras:
        return 0.0
    return (10 * n_paras + paras / 5) * max(0.0, 1 - links / paras) if paras else 10.0 * n_paras


def body(root: Node) -> str | None:
    """EXT-07, EXT-09: the main text, by the usual containers, then by density, then all of it."""
    nodes = list(root.walk())

    def pick(test) -> Node | None:
        return next((n for n in nodes if test(n)), None)

    tests = [lambda n: n.tag == "article", lambda n: n.tag == "main", lambda n: n.get("role") == "main"]
    tests += [lambda n, c=c: c in n.get("class").split() for c in BODY_CLASSES]
    for test in tests:
        n = pick(test)
        if n is not None and score(n) > 100 and len(t := text_of(n)) > 200:
            return t
    best, top = None, 0.0
    for n in nodes:
        if n.tag in ("div", "section", "article") and not CONTAINER_NOISE.search(f"{n.get('class')} {n.get('id')}") and (s := score(n)) > top:
            best, top = n, s
    if best is not None and top > 50 and len(t := text_of(best)) > 200:
        return t
    whole = pick(lambda n: n.tag == "body")
    if whole is not None and len(t := text_of(whole)) > 100:
        return t
    return None


def image_url(base: str, src: str) -> str:
    """URL-08."""
    return "https:" + src if src.startswith("//") else src if src.startswith("http") else urljoin(base, src)


def dimension(v: str) -> int | None:
    """EXT-13."""
    try:
        return int(v.replace("px", "").strip())
    except ValueError:
        return None


def images(root: Node, base: str, most: int = 10) -> list[dict]:
    """EXT-11, EXT-12."""
    out: list[dict] = []
    seen: set[str] = set()
    for n in root.walk():
        if n.tag != "img":
            continue
        src = (n.get("src") or n.get("data-src") or n.get("data-lazy-src")).strip()
        if not src or src.startswith("data:"):
            continue
        url = image_url(base, src)
        if url in seen or IMAGE_NOISE.search(f"{src} {n.get('class')} {n.get('alt')}"):
            continue
        seen.add(url)
        out.append({"url": url, "alt": n.get("alt").strip() or None, "width": dimension(n.get("width")), "height": dimension(n.get("height"))})
        if len(out) >= most:
            break
    return out


def article(html: str, url: str, cleaned: bool = True) -> dict:
    """EXT-15: the fields of an article from a page, or `error` if it breaks a constraint of the schema (EXT-16).

    Only a tree that is not cleaned first still has its JSON-LD (EXT-04).
    """
    root = clean(parse(html)) if cleaned else parse(html)
    meta = metadata(root, url)
    pics = images(root, url)
    og = opengraph(root)
    text = body(root)
    words = len(_WORD.findall(text)) if text else 0
    title = meta["og_title"] or ""
    out = {
        "title": title,
        "author": author(root),
        "dates": published(root),
        "body": text,
        "snippet": meta["og_description"],
        "images": pics,
        "thumbnail_url": og.get("og:image") or og.get("twitter:image") or (pics[0]["url"] if pics else None),
        "metadata": {**meta, "language": None, "word_count": words, "reading_time_minutes": round(words / 200, 1) if words else None},
        "error": None,
    }
    if len(title) < 3:
        out["error"] = "Parse error: title must have at least 3 characters"
    elif not text and not out["snippet"]:
        out["error"] = "Parse error: body or snippet must be there"
    return out
