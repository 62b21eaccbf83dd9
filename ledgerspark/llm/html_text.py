"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one for each block element. A line's size is its length
times a weight that the markup gives it: nothing in menus, headers, footers, sidebars,
notices, adverts, forms, comments, scripts and styles, and for lines that are mostly
links; where the page marks its article, SURGE inside it and nothing outside. Tags
without text between them make no line. Sizes are summed over sliding windows of WINDOW
lines. Text dives where a window's sum is nothing, so what lies between two dives is
a stretch; a stretch in which some window surges, to SURGE or the page's largest sum,
or that holds a sentence of its own, is text, and is kept whole: its short lines too, and
its lines of links. Between the first and the last such stretch every line with a size
stays. Where no article is marked, legal and cookie lines at either end of the text go.

So a marked article is all text, as each of its lines surges, and its tags do most of
the work there. On other pages the sums alone tell text from what is between.

Null and empty pages have an empty text. Unclosed and crossing tags are allowed; a
comment that isn't closed takes the rest of the page. Very long pages are read whole, in
time proportional to their length, whatever they hold. Repeated rows give repeated
results, so there are no ties; an empty table gives no rows. Other columns pass
unchanged, whatever their names; one that has the name of the result is replaced."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from ledgerspark.llm.common import with_text_struct

#: Lines of a window; the sum over a window that makes a stretch text.
WINDOW, SURGE = 3, 80

BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup and not text.
RAW = frozenset("script style noscript template textarea title svg iframe object".split())
#: Of these, what takes the rest of the page if it isn't closed.
CODE = frozenset("script style".split())
#: Elements whose text isn't the article's.
ASIDE = frozenset("nav header footer aside form menu button select dialog head".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
#: Words of a class or id that mark what isn't the article: first or last of the words
#: of one name, or only last (a form for search, but not what is said of search engines).
MARKS = re.compile(
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|masthead|foot(?:er)?|colophon|copyright|legal|sidebar\w*|aside|comment\w*|disqus|cookie\w*|consent|gdpr|"
    r"popup|modal|overlay|newsletter|subscri\w*|signup|share|sharing|social|related|recommend\w*|widget\w*|toolbar|pagination|pager",
    re.I,
)
LAST_MARKS = re.compile(r"header|side|repl(?:y|ies)|respond|notices?|alerts?|login|form|search", re.I)
_WORDS = re.compile(r"[_-]+")
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*+>", re.S)
#: One attribute after the other from the start of the tag: its whole name and its value.
#: Every character is taken by some match, so that none is looked at from several starts.
_ATTRIBUTE = re.compile(r"""[\s/]++|=|([^\s/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|(\S++)))?+""")
#: A value without quotes at the end of a tag, whose last character is a slash.
_BARE_VALUE = re.compile(r"=[^\s\"'=]*+(?<=/)\Z")
#: Decimal references of so many digits that they name no character, or but zeros first.
_LONG_REFERENCE = re.compile(r"&#([0-9]{8,})")
#: What makes a line a sentence: words, and a stop at its end.
_SENTENCE = re.compile(r"(?:\S+\s+){4,}\S*[.!?…][\"'”’»)\]]*\Z")
#: Lines that belong to the site, where they stand first or last in a text.
_SITE_LINE = re.compile(r"\A(?:©|\(c\)|copyright\b)|\A(?:privacy policy|terms of (?:use|service))\b", re.I)
_COOKIES, _CONSENT = re.compile(r"\bcookies?\b", re.I), re.compile(r"\b(?:accept|agree|consent|experience|policy|settings)\b", re.I)
#: An element that a start tag of the same kind closes.
_SIBLING = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}

RESULT = T.StructType([T.StructField("text", T.StringType(), False), T.StructField("n_chars", T.LongType(), False)])


def is_marked(attributes: str) -> bool:
    seen = set()
    for m in _ATTRIBUTE.finditer(attributes):
        if not m[1] or m[1].lower() in seen:  # the first of a name counts
            continue
        seen.add(m[1].lower())
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "role" and value.lower() in ROLES):
            return True
        if name in ("class", "id") and any(map(names_aside, value.split())):
            return True
    return False


def names_aside(name: str) -> bool:
    words = [w for w in _WORDS.split(name) if w]
    return bool(words) and any(MARKS.fullmatch(w) for w in (words[0], words[-1])) or bool(words and LAST_MARKS.fullmatch(words[-1]))


def is_site_line(text: str) -> bool:
    return bool(_SITE_LINE.search(text) or (_COOKIES.search(text) and _CONSENT.search(text)))


def decoded(text: str) -> str:
    """Text with its character references decoded."""

    def short(m: re.Match) -> str:
        digits = m[1].lstrip("0") or "0"
        return f"&#{digits}" if len(digits) < 8 else "&#xFFFFFFF"

    return unescape(_LONG_REFERENCE.sub(short, text))


def lines(page: str) -> Iterator[tuple[str, bool, bool, float]]:
    """The page's lines: text, whether aside, whether in an article, share of links."""
    stack: list[tuple[str, bool]] = []  # open elements, and whether each is aside
    opened: Counter[str] = Counter()
    unclosed: set[str] = set()
    aside = article = link = 0
    parts: list[str] = []
    linked = 0

    def flush(was_aside: bool, was_article: bool):
        nonlocal linked
        text = " ".join("".join(parts).split())
        share, linked = (linked / len(text) if text else 0.0), 0
        parts.clear()
        return text, was_aside, was_article, share

    # No tag ends behind the last bracket, so nothing is looked for there.
    at, n, tags = 0, len(page), page.rfind(">") + 1
    while at < n:
        m = _TAG.search(page, at, tags) if at < tags else None
        end = m.start() if m else n
        if not m and (comment := page.find("<!--", at)) >= 0:
            end = n = comment
        if end > at:
            text = decoded(page[at:end])
            parts.append(text)
            if link:
                linked += len(text.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in BLOCKS:
            yield flush(aside > 0, article > 0)
        elif name == "br":
            parts.append(" ")
            continue
        if closing:
            if opened[name]:
                while stack:
                    x, out = stack.pop()
                    opened[x] -= 1
                    aside -= out
                    article -= x in ("article", "main")
                    link -= x == "a"
                    if x == name:
                        break
            continue
        if name in VOID or (m[3].endswith("/") and not _BARE_VALUE.search(m[3])):
            continue
        if name in RAW:
            close = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if close:
                at = close.end()
            elif name in CODE:
                at = n
            else:
                unclosed.add(name)
            continue
        while stack and name in _SIBLING and stack[-1][0] in _SIBLING[name]:
            x, was = stack.pop()
            opened[x] -= 1
            aside -= was
        out = (name in ASIDE and not (name == "header" and article > 0)) or is_marked(m[3])
        out = out and name not in ("html", "body", "article", "main")
        stack.append((name, out))
        opened[name] += 1
        aside += out
        article += name in ("article", "main")
        link += name == "a"
    yield flush(aside > 0, article > 0)


def sized(found: list[tuple[str, bool, bool, float]]) -> list[float]:
    """Sizes of lines: their length by the weight that the markup gives them."""
    marked = any(inside and not aside for _, aside, inside, _ in found)
    out = []
    for text, aside, inside, share in found:
        own = len(text) if share < 0.5 or (1 - share) * len(text) >= SURGE else 0
        out.append(0 if aside else (len(text) * SURGE if inside else 0) if marked else own)
    return out


def main_text(page: str | None) -> str:
    """The text between surge and dive points, one line per block."""
    found = [line for line in lines(page or "") if line[0]]
    sizes = sized(found)
    n, sums, total = len(sizes), [], 0
    for i, size in enumerate(sizes):  # of the windows that end at each line
        total += size - (sizes[i - WINDOW] if i >= WINDOW else 0)
        sums.append(total)
    surge = min(SURGE, max(sums, default=0))
    kept: set[int] = set()
    at = 0
    while at < n:
        if not sizes[at]:
            at += 1
            continue
        end, top, last = at, 0, at
        while end < n and (end - last < WINDOW):  # WINDOW lines of no size are a dive
            if sizes[end]:
                last = end
            top = max(top, sums[end])
            end += 1
        marked = sizes[at] >= SURGE * len(found[at][0])
        if top >= surge or any(sizes[i] and _SENTENCE.search(found[i][0]) for i in range(at, last + 1)):
            kept.update(i for i in range(at, last + 1) if sizes[i] or not (found[i][1] or marked))
        at = max(end, last + 1)
    text = [i for i in range(min(kept), max(kept) + 1) if i in kept or sizes[i]] if kept else []
    if text and not any(inside and not aside for _, aside, inside, _ in found):
        first, past = 0, len(text)
        while first < past and is_site_line(found[text[first]][0]):
            first += 1
        while past > first and is_site_line(found[text[past - 1]][0]):
            past -= 1
        text = text[first:past]
    return "\n".join(found[i][0] for i in text)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "main") -> DataFrame:
    """pages with a struct column: the main text and its length in code points."""

    def make():
        def one(page: str | None) -> tuple[str, int]:
            text = main_text(page)
            return text, len(text)

        return one

    return with_text_struct(pages, html_col, out, RESULT, make)
