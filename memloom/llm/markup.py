"""Blocks of a web page: runs of text between block-level tags, each with the path of the elements around it (and where each of them starts)."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
QUOTED = re.compile(r""""[^"]*"|'[^']*'""")
HIDDEN = re.compile(r"(?<![\w-])hidden(?![\w-])", re.I)
UNSEEN = re.compile(r"""(?<![\w-])style\s*=\s*(?:"[^"]*|'[^']*|)display\s*:\s*none""", re.I)
SPACES = re.compile(r"\s+")
LETTERS = re.compile(r"[a-z]+")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Fixed values of HTML: elements without content, elements whose content is not text, elements inside a line, what a new element closes, and what may stand in a head.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "svg", "annotation", "annotation-xml", "object", "canvas", "audio", "video"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span",
    "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "img",
    "math", "semantics", "mi", "mn", "mo", "ms", "mtext", "mrow", "mstyle", "mspace", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "mover", "munder", "munderover", "mtable", "mtr", "mtd",
}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
IN_HEAD = {"html", "head", "base", "link", "meta", "title", "script", "style", "noscript", "template"}
FENCE = {"ul": {"li"}, "ol": {"li"}, "dl": {"dt", "dd"}, "table": {"tr", "td", "th"}, "select": {"option"}}

#: Elements and class, id or role words that mark what is not the article.
NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "label", "fieldset"}
NOISE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus", "footer", "header", "masthead",
    "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "popup", "promo", "related", "reply", "respond", "share", "sharing", "sidebar", "social", "sponsor", "sponsored",
    "subscribe", "toolbar", "widget", "contentinfo", "complementary", "search", "adv", "cookiebar",
}
HEADER_WORDS = {"header", "masthead"}
#: Words that say where or in what shape a thing stands, not what it is about.
LAYOUT_WORDS = {
    "area", "article", "articles", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "center", "col", "column", "container", "content", "count", "div", "form", "grid", "group", "icon", "icons", "inline",
    "inner", "item", "items", "large", "left", "link", "links", "list", "main", "media", "module", "outer", "page", "panel", "post", "posts", "reader", "right", "row", "section", "signup", "site", "slot", "small", "sticky", "stories",
    "story", "text", "thread", "title", "top", "unit", "user", "wrap", "wrapper",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that hold text themselves: what names them need not say what they are for.
TEXTUAL = {*HEADINGS, "p", "li", "dt", "dd", "td", "th", "pre", "blockquote", "figure", "figcaption", "caption"}
WHOLE = {"html", "body", "main", "article"}


@dataclass
class Block:
    path: str
    elements: tuple[int, ...]
    text: str
    link: int
    noise: bool


def noisy(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element starts something that is not the article.

    Hidden elements and those of ``NOISE_TAGS`` do, and headers outside the article. Outside it, containers do whose class, id or role has a word
    of ``NOISE_WORDS``. Inside it, and for elements of text and lines anywhere, a name as a whole must be about noise: ``share-bar``
    is, ``share-price`` is not. Ids of headings repeat their text and say nothing; what the classes of the page as a whole say is about its layout.
    """
    if tag in WHOLE:
        return False
    if tag in NOISE_TAGS or (tag == "header" and not inside):
        return True
    if not attributes:
        return False
    if HIDDEN.search(QUOTED.sub("", attributes)) or UNSEEN.search(attributes):
        return True
    noise = NOISE_WORDS - HEADER_WORDS if inside else NOISE_WORDS
    whole_names = inside or tag in TEXTUAL or tag in INLINE
    for attribute, value in ATTRIBUTE.findall(attributes):
        if tag in HEADINGS and attribute.lower() == "id":
            continue
        for name in value.strip("\"'").split():
            words = {w.lower() for w in WORDS.findall(name)}
            if words & noise and (not whole_names or words <= noise | LAYOUT_WORDS):
                return True
    return False


def blocks_of(page: str | None) -> list[Block]:
    """All text blocks in page order; white space inside a block is one space, character references are decoded."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, str, bool, int]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    link = 0

    def finish() -> None:
        nonlocal link
        text = SPACES.sub(" ", entities.unescape("".join(parts))).strip() if parts else ""
        if text:
            out.append(Block("/".join(step for _, step, _, _ in stack if step), tuple(n for _, step, _, n in stack if step), text, min(link, len(text)), bool(stack) and stack[-1][2]))
        parts.clear()
        link = 0

    def say(text: str) -> None:
        nonlocal link
        if text:
            parts.append(text)
            if opened["a"]:
                link += len(text)

    def start(tag: str, step: str, noise: bool) -> None:
        stack.append((tag, step, noise or bool(stack) and stack[-1][2], at))
        opened[tag] += 1

    def close(names: set[str], fence: set[str] = frozenset()) -> None:
        if not any(opened[name] for name in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                if any(name not in INLINE for name, *_ in stack[i:]):
                    finish()
                opened.subtract(name for name, *_ in stack[i:])
                del stack[i:]
                return
            if stack[i][0] in fence:
                return

    def leave_head(found: bool) -> None:
        if found and opened["head"]:
            close({"head"})

    at = 0
    while True:
        match = TAG.search(page, at)
        text = page[at : match.start() if match else len(page)]
        leave_head(bool(text.strip()))
        say(text)
        if match is None:
            break
        at = match.end()
        if match[2] is None:
            continue
        tag = match[2].lower()
        if match[1]:
            close({tag})
            if tag in ("br", "p"):
                finish()
            continue
        leave_head(tag not in IN_HEAD)
        if tag in RAW:
            if not match[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE:
            if tag not in VOID and not match[3].endswith("/"):
                start(tag, "", noisy(tag, match[3], bool(opened["article"] or opened["main"])))
            continue
        if tag not in ("br", "hr"):
            close({"p"}, {"table", "button", "object"})
        if tag in CLOSES:
            close(CLOSES[tag], {outer for outer, inner in FENCE.items() if inner & CLOSES[tag]})
        finish()
        if tag in VOID:
            continue
        marks = [(name.lower(), value.strip("\"'").lower()) for name, value in ATTRIBUTE.findall(match[3])] if match[3] else []
        label = "".join(("#" if name == "id" else ".") + "-".join(LETTERS.findall(value)) for name, value in sorted(marks) if name != "role")
        start(tag, tag + label, noisy(tag, match[3], bool(opened["article"] or opened["main"])))
    finish()
    return out
