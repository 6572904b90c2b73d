"""Lines of a web page: one for each block of text, with the place it stands in."""

from __future__ import annotations

import html
import re

#: Fixed values of the HTML standard: elements whose text is no prose, elements without content, and elements that begin a new block.
RAW = ("script", "style", "noscript", "template", "svg", "math", "textarea", "iframe", "object", "select", "button", "canvas", "audio", "video")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements and roles that hold no main text.
ASIDE = frozenset("nav footer aside form head dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog menu menubar alert".split())
#: Words in class and id that name what is not the article.
NAMES = re.compile(
    r"(?:^|[\s_-])(?<!no-)(?<!has-)(?<!with-)(?<!without-)(?:nav|navbar|navigation|menu\w*|masthead|header|footer|side|sidebar\w*|aside|notices?|cookies?\w*|consent|gdpr|banner|ads?|adverts?|advertis\w+|"
    r"sponsor\w*|promo\w*|popup|modal|overlay|comments?|commentlist|comment\w+|disqus\w*|respond|replies|form|search|login|signup|subscribe|subscription|newsletter|"
    r"share|sharing|social|related|recommended|breadcrumbs?|pagination|pager|widgets?|toolbar|skip|copyright)(?:$|[\s_-])"
)
#: A header of the article itself holds its title.
OWN_HEADER = re.compile(r"(?:article|entry|post|story|content|page)[_-]?header")
CONTENT = re.compile(r"(?:^|[\s_-])(?:(?:article|post|entry|story|page|main)[_-]?(?:body|content|text)|content|article|main)(?:$|[\s_-])")

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][\w:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)>|<[!?][^>]*>",
    re.S | re.I,
)
ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)

#: Where a line stands: nowhere in particular, in a part that is no main text, in <main>, in a container named as content, in <article>.
NEUTRAL, APART, CONTAINER, MAIN, ARTICLE = 0, 1, 2, 3, 4


def _place(name: str, attrs: str, inside: bool) -> int | None:
    """What an element makes of its content, or None if nothing."""
    if name == "article":
        place = ARTICLE
    elif name == "main":
        place = MAIN
    elif name == "body":
        place = NEUTRAL
    elif name in ASIDE or name == "header" and not inside:
        place = APART
    else:
        place = None
    if attrs and (found := {k.lower(): (a or b or c).lower() for k, a, b, c in ATTR.findall(attrs)}):
        names = f"{found.get('class', '')} {found.get('id', '')}"
        hidden = "hidden" in found or found.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", found.get("style", ""))
        if found.get("role") in ROLES or hidden:
            return APART
        if found.get("role") == "main":
            return MAIN
        if name not in ("article", "main", "body", "html") and NAMES.search(names) and not (inside and OWN_HEADER.search(names)):
            return APART
        if place is None and CONTENT.search(names):
            return CONTAINER
    return place


def lines(page: str | None) -> list[tuple[int, str]]:
    """(place, text) of each block with text, in page order: references decoded, white space made one space."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    open_: list[tuple[str, int]] = []  # element, place of its content
    place = NEUTRAL
    page = page or ""

    def end_block() -> None:
        if text:
            line = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((place, line))

    at = 0
    for token in TOKEN.finditer(page):
        if token.start() > at:
            text.append(page[at : token.start()])
        at = token.end()
        name = (token["name"] or "").lower()
        if not name:
            continue
        if name == "br":
            text.append(" ")
        if name in BLOCK:
            end_block()
        if token["end"]:
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == name:
                    if open_[i][1] != place or name in BLOCK:
                        changed = (open_[i - 1][1] if i else NEUTRAL) != place
                        if changed:
                            end_block()
                    del open_[i:]
                    break
        elif name not in VOID and not token["attrs"].endswith("/"):
            new = _place(name, token["attrs"], any(p >= CONTAINER for _, p in open_))
            if new is not None and new != place:
                end_block()
                # a container within another keeps the stronger place
                new = max(new, place) if new >= CONTAINER and place >= CONTAINER else new
            if name == "p" and open_ and open_[-1][0] == "p":
                open_.pop()
            open_.append((name, place if new is None else new))
        place = open_[-1][1] if open_ else NEUTRAL
    rest = page[at:]
    text.append(rest[: rest.rfind("<")] if re.search(r"<[/!a-zA-Z]?[^<>]*\Z", rest) else rest)
    end_block()
    return out


def longest_common(a: list, b: list) -> list[int]:
    """Places in `a` of one longest common subsequence with `b`: rows of differences kept as bits of integers."""
    head = 0
    while head < len(a) and head < len(b) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    x, y = a[head : len(a) - tail], b[head : len(b) - tail]
    at: dict = {}
    for j, value in enumerate(y):
        at[value] = at.get(value, 0) | 1 << j
    full = (1 << len(y)) - 1
    rows, v = [], full
    for value in x:  # a zero bit: one more common line up to this column
        u = v & at.get(value, 0)
        v = ((v + u) | (v - u)) & full
        rows.append(v)
    found, i, j = [], len(x), len(y)
    while i and j:
        if x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
            found.append(head + i)
        elif rows[i - 1] >> (j - 1) & 1:
            j -= 1
        else:
            i -= 1
    return [*range(head), *reversed(found), *range(len(a) - tail, len(a))]
