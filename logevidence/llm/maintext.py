"""Main text of web pages by scoring their tree of blocks.

A page is read by a tolerant tokeniser into a tree of block elements whose leaves are paragraphs: runs of inline text. Parts that
never belong to an article (scripts, forms, menus, adverts, comments of readers) are left out by element, role or name.
Every other paragraph has points for its length and its commas, less the share of its text that is links; it passes them to
its ancestors, halved at each step. A container's score is discounted by the link density of all its text. The best container,
or the article element that holds it, is kept with those siblings that read like its continuation; menus within it go.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, table
from .textbytes import chunks

SCHEMA = "page_id long, url string, text string, n_chars long"

# Element names of HTML, and the words that web pages use for parts of a page in classes, ids and roles.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "nobr", "picture", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
NEVER = {
    "aside", "audio", "button", "canvas", "datalist", "dialog", "fieldset", "footer", "form", "head", "map", "menu", "nav", "noscript", "object",
    "select", "svg", "template", "video",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
ROLES = {
    "alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search", "status",
    "tablist", "toolbar",
}
NOISE = {
    "ad", "ads", "adsbygoogle", "adsense", "advert", "advertisement", "advertisements", "advertising", "adverts", "alert", "alerts", "aside",
    "banner", "banners", "breadcrumb", "breadcrumbs", "comment", "commentlist", "comments", "consent", "cookie", "cookies", "discussion",
    "disclaimer", "disqus", "feedback", "footer", "gdpr", "login", "masthead", "menu", "menus", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "notices", "notification", "overlay", "pager", "pagination", "paywall", "popup", "promo", "promotion", "recommendations", "recommended",
    "related", "replies", "reply", "respond", "responses", "search", "share", "sharing", "sidebar", "sidenav", "signup", "skip", "social", "sponsor",
    "sponsored", "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
#: Words that follow the telling word of a name (ad-container, related-posts).
GENERIC = {
    "area", "articles", "bar", "block", "body", "bottom", "box", "button", "buttons", "card", "cards", "column", "container", "content", "form", "group",
    "holder", "icons", "inner", "item", "items", "left", "link", "links", "list", "message", "module", "news", "outer", "panel", "posts", "primary",
    "region", "right", "secondary", "section", "slot", "stories", "text", "thread", "title", "top", "unit", "wrap", "wrapper", "zone",
}
NEGATION = {"has", "hide", "no", "non", "with", "without"}
CONTENT = {"article", "content", "entry", "main", "post", "story"}
LIST_ITEMS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}

VALUE = r"\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s>\"'][^\s>]*+)"
ATTRIBUTE = rf"([^\s/>=][^\s/>=]*+)(?:\s*+=\s*+(?:{VALUE}|(?=>)))?+"
NO_GROUPS = re.sub(r"\((?!\?)", "(?:", ATTRIBUTE)
TOKEN = re.compile(rf"<(?:(?P<comment>!--)|(?P<other>[!?]|/(?![a-zA-Z]))|(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[\s/=]++|{NO_GROUPS})*+)(?:>|\Z))")
ATTRIBUTES = re.compile(ATTRIBUTE)
RAW_END = {name: re.compile(f"</{name}(?=[\\s/>])[^>]*+>?", re.I) for name in RAW}
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
NAME_WORD = re.compile("[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
COMMA = re.compile("[,،、，;；]")
SENTENCE_END = re.compile(r"[.!?…。！？][\"'”’»)]*$")

#: Points of a paragraph: one, one for each comma and one for each so many characters.
CHARS_A_POINT = 100
#: A sibling of the best container stays if it has this share of its score, or is a paragraph of so many characters or a sentence.
SIBLING_SHARE, SIBLING_CHARS = 0.2, 80
#: A container or a sibling with more than this share of links is a menu.
MENU_DENSITY = 0.5
#: Steps after which halved points no longer matter; deeper trees must not cost more.
STEPS = 32


class Block:
    """An element, or a paragraph where ``text`` is set. ``chars`` and ``linked`` cover everything below once ``measure`` ran."""

    __slots__ = ("name", "parent", "children", "text", "chars", "linked", "points", "article", "inside")

    def __init__(self, name: str, parent: Block | None, text: str | None = None, linked: int = 0, article: bool = False, main: bool = False):
        self.name, self.parent, self.text, self.article = name, parent, text, article
        self.children: list[Block] = []
        self.chars, self.linked, self.points = len(text or ""), linked, 0.0
        self.inside = article or main or (parent is not None and parent.inside)
        if parent is not None:
            parent.children.append(self)

    @property
    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0

    @property
    def score(self) -> float:
        return self.points * (1 - self.density)


def attributes(rest: str) -> dict[str, str]:
    """Names and decoded values of the attributes of a tag; the first of a name counts."""
    out: dict[str, str] = {}
    for m in ATTRIBUTES.finditer(rest):
        out.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return out


def _noise_name(name: str, inside: bool) -> bool:
    """Whether a class or an id names a part that is no article: its last word that says something decides."""
    words = [w.lower() for w in NAME_WORD.findall(name)]
    if NEGATION & set(words):
        return False
    while len(words) > 1 and words[-1] in GENERIC:
        words.pop()
    if not words:
        return False
    return words[-1] in NOISE or (words[-1] == "header" and not inside and not CONTENT & set(words))


def left_out(name: str, a: dict[str, str], inside: bool) -> bool:
    """Whether an element is no part of an article by its kind, role, name or style; ``inside``: an article or main holds it."""
    if name in NEVER or (name == "header" and not inside):
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or HIDDEN_STYLE.search(a.get("style", "")):
        return True
    if a.get("role", "").lower() in ROLES:
        return True
    return name not in ("html", "body", "main") and any(_noise_name(n, inside) for k in ("id", "class") for n in a.get(k, "").split())


class Page:
    """The tree of a page. Parts that are left out have no blocks; ``blocks`` lists parents before children."""

    def __init__(self, html: str):
        self.root = self.here = Block("html", None)
        self.blocks = [self.root]
        self.open: Counter[str] = Counter()
        self.skipped: list[str] = []
        self.skipped_open: Counter[str] = Counter()
        self.pieces: list[str] = []
        self.linked, self.in_link = 0, False
        self.read(html)
        self.flush()
        self.measure()

    def add(self, block: Block) -> Block:
        self.blocks.append(block)
        return block

    def flush(self) -> None:
        """Ends the paragraph that is being read."""
        text = " ".join("".join(self.pieces).split())
        if text:
            self.add(Block("", self.here, text, min(self.linked, len(text))))
        self.pieces.clear()
        self.linked = 0

    def say(self, text: str) -> None:
        if text and not self.skipped:
            text = unescape(text)
            self.pieces.append(text)
            if self.in_link:
                self.linked += len(" ".join(text.split()))

    def skip(self, name: str) -> None:
        self.skipped.append(name)
        self.skipped_open[name] += 1

    def read(self, html: str) -> None:
        at = 0
        while True:
            less = html.find("<", at)
            if less < 0:
                self.say(html[at:])
                return
            self.say(html[at:less])
            m = TOKEN.match(html, less)
            if m is None:
                self.say("<")
                at = less + 1
            elif m["comment"] or m["other"]:
                mark = "-->" if m["comment"] else ">"
                stop = html.find(mark, less + 2)
                at = stop + len(mark) if stop >= 0 else len(html)
            else:
                at, name = m.end(), m["name"].lower()
                if m["close"]:
                    self.close(name)
                elif name in RAW:
                    end = RAW_END[name].search(html, at)
                    at = end.end() if end else len(html)
                else:
                    self.start(name, m["rest"])

    def start(self, name: str, rest: str) -> None:
        if self.skipped and name == "body":  # an open head ends here
            self.skipped.clear()
            self.skipped_open.clear()
        if self.skipped:
            if name not in VOID and not rest.endswith("/"):
                self.skip(name)
            return
        a = attributes(rest) if rest else {}
        if name in INLINE:
            if name not in VOID and left_out(name, a, True):
                self.skip(name)
            elif name == "a":
                self.in_link = True
            return
        if name == "br":
            self.say(" ")
            return
        self.flush()
        self.in_link = False
        if name in VOID or name == "html":
            return
        if self.here.name == "p" or self.here.name in LIST_ITEMS.get(name, ()):  # their end tags may be missing
            self.up()
        if left_out(name, a, self.here.inside):
            if not (name == "svg" and rest.endswith("/")):
                self.skip(name)
            return
        article = name == "article" or a.get("role", "").lower() == "article" or "articlebody" in a.get("itemprop", "").lower()
        main = name == "main" or a.get("role", "").lower() == "main"
        self.here = self.add(Block(name, self.here, article=article, main=main))
        self.open[name] += 1

    def up(self) -> None:
        self.open[self.here.name] -= 1
        self.here = self.here.parent or self.here

    def close(self, name: str) -> None:
        if self.skipped:
            if self.skipped_open[name]:
                gone = None
                while gone != name:
                    gone = self.skipped.pop()
                    self.skipped_open[gone] -= 1
                return
            if name in INLINE or not self.open[name]:
                return
            self.skipped.clear()  # the element around the part that is left out ends
            self.skipped_open.clear()
        if name == "a":
            self.in_link = False
        if name in INLINE or name == "br":
            return
        self.flush()
        self.in_link = False
        if self.open[name]:
            while self.here.name != name:
                self.up()
            self.up()

    def measure(self) -> None:
        """Points of every container, and the text and links below it."""
        for block in reversed(self.blocks):
            above = block.parent
            if above is None:
                continue
            above.chars += block.chars
            above.linked += block.linked
            if block.text is None or above.name in HEADINGS:
                continue
            points = (1 + len(COMMA.findall(block.text)) + block.chars / CHARS_A_POINT) * (1 - block.density)
            to = above.parent if above.name == "p" and above.parent is not None else above
            for _ in range(STEPS):
                to.points += points
                points /= 2
                if to.parent is None:
                    break
                to = to.parent


def _belongs(sibling: Block, best: Block, before: bool) -> bool:
    """Whether a sibling of the best container reads like its continuation, or is its headline."""
    if sibling.name in HEADINGS:
        return before and not sibling.linked
    if best.article and not sibling.article:
        return False
    if sibling.density > MENU_DENSITY:
        return False
    if sibling.name in ("p", "") and not best.article:
        if sibling.chars >= SIBLING_CHARS:
            return True
        text = sibling.text or " ".join(c.text or "" for c in sibling.children)
        return not sibling.linked and bool(SENTENCE_END.search(text))
    return sibling.score >= SIBLING_SHARE * best.score


def main_text(html: str | None) -> str:
    """The text of the article of a page; empty for null, and for a page without text."""
    if not html:
        return ""
    page = Page(html)
    best = max(page.blocks, key=lambda b: b.score if b.text is None else -1.0)  # of equal ones the first, hence the outer
    if best.score <= 0:
        best = page.root
    holder: Block | None = best
    while holder is not None and not holder.article:
        holder = holder.parent
    best = holder or best
    if best.parent is None:
        kept = [best]
    else:
        here = best.parent.children.index(best)
        kept = [s for i, s in enumerate(best.parent.children) if s is best or _belongs(s, best, i < here)]
    out: list[str] = []
    pending = kept[::-1]
    while pending:
        block = pending.pop()
        if block.text is not None:
            out.append(block.text)
        elif block is best or block.name == "p" or block.name in HEADINGS or block.density <= MENU_DENSITY:
            pending += block.children[::-1]
    return " ".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in chunks(batches, "html"):
        texts = [main_text(h.as_py()) for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars``: the main text of every page, its blocks in page order joined by a space.

    ``pages`` has ``page_id, url, html``; other columns are ignored. Every row gives one row, repeated rows and rows with a null
    id too; a null or empty ``html``, or one without text outside the parts that are left out, gives an empty text. A page
    without a paragraph that scores keeps all text that is not left out. Broken markup is read as far as it goes: missing end
    tags are supplied, an open script or comment reaches to the end. The work for a page is linear in its length, however deep
    its elements are nested. Of containers with equal scores the outer, then the first, is taken. An empty table gives no rows.
    """
    return map_arrow(pages.select(F.col("page_id").cast("long"), "url", "html"), _extracted, SCHEMA)


def op13_maintext(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
