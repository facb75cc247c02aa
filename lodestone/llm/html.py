"""Operator 5, HTML extraction by two passes of block rules.

A page becomes blocks: runs of text between block-level tags, with their link
characters, stop words and the containers around them. Blocks in containers
that never hold an article (menus, forms, adverts, ...) are barred. The first
pass decides the clear ones of all others: links without a word beside them are
bad, long blocks with many stop words and few links are good; where the page's
own text shows no known language, length and links decide alone. Everything
else stays open, such as headings, short lines, code and sentences that are
mostly a link, and in the second pass takes the label of the nearest decided
neighbours that aren't barred. On a page without an article element one good
neighbour is enough for a block that isn't short, and for a short heading or
paragraph if no bad one stands on its other side; the page's edges are on
neither side, and where nothing is decided everything open stays. Next to an article element, open
blocks in it need one good neighbour or no decided one, blocks outside it two.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import small_batches, text_of

# Element names and the words in class, id and role that mark what is not the article.
SILENT = "script style noscript template svg math iframe object canvas select option textarea button head title audio video map"
NEVER = "nav footer aside form menu dialog"
BLOCKS = "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul"
BAD_NAMES = (
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup sidebar sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager masthead topbar toolbar header footer "
    "share sharing social related recommended recommendations comment comments commentlist discussion disqus respond reply replies login search copyright disclaimer skip hidden"
)
GOOD_NAMES = "article content post entry main story body text"
BAD_ROLES = "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar"
STOP_WORDS = {
    "en": "the of and to in a is that for it as with was on are by this be at from or have an not they which you were but has had their one all we can her there been if more when will would who so no",
    "fr": "le la les de des du un une et en est que qui dans pour par sur au aux avec ne pas plus se ce cette son sa ses il elle ils nous vous on ou mais été être sont comme tout",
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über so",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también",
}

SILENT_TAGS, NEVER_TAGS, BLOCK_TAGS = (frozenset(x.split()) for x in (SILENT, NEVER, BLOCKS))
BAD_WORDS, GOOD_WORDS, BAD_ROLE_WORDS = (frozenset(x.split()) for x in (BAD_NAMES, GOOD_NAMES, BAD_ROLES))
STOPS = frozenset(w for x in STOP_WORDS.values() for w in x.split())
RAW_TAGS = frozenset(["script", "style", "textarea", "title"])
#: Silent elements that don't hold one of their own kind: the next one ends one that is still open.
FLAT_TAGS = frozenset(["head", "noscript", "iframe", "select", "option", "button", "audio", "video"])
PROSE_TAGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6", "p", "pre", "blockquote", "figcaption"])
VOID_TAGS = frozenset(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z))|<[!?/][^>]*+(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
WORD = re.compile(r"[^\W\d_]+")

#: Pass one: characters of a short and of a long block, the share of stop words of running text, and the most link text.
SHORT, LONG = 70, 200
MANY_STOPS = 0.2
MOST_LINK = 0.33
MOST_ARTICLE_LINK = 0.66
#: A page with fewer stop words than this share is in no language with a list.
KNOWN_STOPS = 0.05


@dataclass
class Block:
    text: str
    link_chars: int
    in_article: bool
    barred: bool
    #: Whether a word stands outside the links.
    own_words: bool = True
    #: Whether it is a heading, a paragraph or the like, and not a bare division.
    prose: bool = True

    def stop_words(self) -> tuple[int, int]:
        """Stop words and words."""
        words = WORD.findall(self.text.lower())
        return sum(w in STOPS for w in words), len(words)

    def decide(self, known: bool) -> bool | None:
        """Pass one: True for good, False for bad, None where the neighbours decide. ``known``: the page has stop words."""
        size, share = len(self.text), self.link_chars / len(self.text)
        if self.barred or (self.link_chars and not self.own_words):
            return False
        if size < SHORT or share > (MOST_ARTICLE_LINK if self.in_article else MOST_LINK):
            return None
        if not known:
            return True if size > LONG or self.in_article else None
        stops, words = self.stop_words()
        return True if stops >= MANY_STOPS * max(1, words) and (size > LONG or self.in_article) else None


def _barred(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element and all in it are outside any article."""
    if tag in NEVER_TAGS or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body") or "=" not in attributes and "hidden" not in attributes:
        return False
    words: set[str] = set()
    for name, a, b, c in ATTRIBUTE.findall(attributes):
        value = (a or b or c).lower()
        name = name.lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            return True
        if name == "role" and value.strip() in BAD_ROLE_WORDS:
            return True
        if name in ("class", "id"):
            words.update(NAME_WORD.findall(value))
    return bool(words & BAD_WORDS) and (not words & GOOD_WORDS or bool(words & {"comment", "comments", "sidebar", "related", "ad", "ads"}))


def _tags(page: str) -> list[tuple[int, int, bool, str, str]]:
    """(start, end, whether an end tag, element, attributes) of all markup; the element is empty for comments and for raw text with its tags."""
    tags, at, drawn = [], 0, 0
    endless: set[str] = set()
    while m := MARKUP.search(page, at):
        at, tag, alone = m.end(), (m[2] or "").lower(), (m[3] or "").rstrip(">").endswith("/")
        if tag in ("svg", "math") and not (alone and not m[1]):
            drawn = max(0, drawn - 1) if m[1] else drawn + 1
        if tag in RAW_TAGS and not m[1]:
            end = None
            if not alone or tag in ("script", "style") and not drawn:
                end = None if tag in endless else re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
                if not end:
                    endless.add(tag)
            if end:
                at = end.end()
            elif tag in ("script", "style") and not (alone and drawn):
                at = len(page)
            if end or alone or tag in ("script", "style"):
                tag = ""
        tags.append((m.start(), at, bool(m[1]), tag, m[3] or ""))
    return tags


def _ends(tags: list[tuple[int, int, bool, str, str]]) -> dict[int, tuple[int, bool]]:
    """For each silent start tag the tag that ends it at the latest, and whether that is its own end tag.

    One without its own is ended by the end of a block around it, by the next of
    its kind where it can't hold one, or for a head by a body or a block.
    """
    held: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    found: dict[int, tuple[int, bool]] = {}

    def end(kind: str, i: int, own: bool) -> None:
        while True:
            tag, k = held.pop()
            count[tag] -= 1
            if tag in SILENT_TAGS:
                found[k] = (i, own and tag == kind)
            if tag == kind:
                break

    for i, (_, _, closing, tag, attributes) in enumerate(tags):
        if tag not in SILENT_TAGS and tag not in BLOCK_TAGS:
            continue
        if closing:
            if count[tag]:
                end(tag, i, True)
            continue
        if count["head"] and (tag == "body" or (held[-1][0] == "head" and tag in BLOCK_TAGS)):
            end("head", i, False)
        if tag in FLAT_TAGS and count[tag]:
            end(tag, i, False)
        if tag not in VOID_TAGS and not (tag in SILENT_TAGS and attributes.rstrip(">").endswith("/")):
            held.append((tag, i))
            count[tag] += 1
    found |= {k: (len(tags), False) for tag, k in held if tag in SILENT_TAGS}
    return found


def blocks(page: str) -> list[Block]:
    """The non-empty blocks of a page in order; markup may be broken or cut off anywhere.

    A silent element with an end tag is left out whole. One without is silent up
    to the first block, the body or the end of what is around it.
    """
    found: list[Block] = []
    parts: list[tuple[str, bool]] = []
    stack: list[tuple[str, bool, bool]] = []  # element, barred, in article
    links, at, silent = 0, 0, None
    barred = in_article = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(x for x, _ in parts)).split())
        if text:
            linked = sum(len(" ".join(html.unescape(x).split())) for x, y in parts if y)
            own = any(WORD.search(html.unescape(x)) for x, y in parts if not y)
            element = next((x for x, _, _ in reversed(stack) if x in BLOCK_TAGS), "")
            found.append(Block(text, min(linked, len(text)), in_article, barred, own, element in PROSE_TAGS))
        parts.clear()

    def closed(to: int) -> None:
        nonlocal barred, in_article
        del stack[to:]
        barred, in_article = stack[-1][1:] if stack else (False, False)

    tags = _tags(page)
    ends = _ends(tags)
    i = 0
    while at < len(page):
        start, end, closing, tag, attributes = tags[i] if i < len(tags) else (len(page), len(page), False, "", "")
        text = page[at:start]
        if silent is not None and (i >= silent or (not closing and (tag in BLOCK_TAGS or tag == "body"))):
            text, silent = "", None
        if text and silent is None:
            parts.append((text, links > 0))
        at = end
        i += 1
        if not tag:
            continue
        if closing:
            if silent is None:
                if tag == "a":
                    links = max(0, links - 1)
                if tag in BLOCK_TAGS:
                    flush()
                depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
                if depth is not None:
                    closed(depth)
            continue
        if tag in SILENT_TAGS:
            last, own = ends.get(i - 1, (i, None))
            if own:  # what it holds is left out
                i = last + 1
                at = tags[last][1]
            elif own is False and silent is None:
                silent = last
            continue
        if silent is not None:
            continue
        if tag == "br":
            parts.append((" ", links > 0))
        if tag == "a":
            links = 1
        if tag in BLOCK_TAGS:
            flush()
            links = 0
            if tag == "p" and stack and stack[-1][0] == "p":
                closed(len(stack) - 1)
        if tag not in VOID_TAGS and (tag in BLOCK_TAGS or "class" in attributes or "hidden" in attributes):
            inside = in_article or tag in ("article", "main") or 'role="main"' in attributes
            if _barred(tag, attributes, inside) and not barred:
                flush()
                barred = True
            in_article = inside
            stack.append((tag, barred, in_article))
    flush()
    return found


def _nearest(labels: list[bool | None]) -> list[bool | None]:
    """For each place the last decided label before it."""
    found, last = [], None
    for x in labels:
        found.append(last)
        last = x if x is not None else last
    return found


def judged(found: list[Block]) -> list[bool]:
    """Both passes over a page's blocks: which of them are its main text."""
    candidates = [b for b in found if not b.barred]
    counts = [b.stop_words() for b in candidates]
    known = sum(s for s, _ in counts) >= KNOWN_STOPS * sum(n for _, n in counts)
    has_article = any(b.in_article for b in candidates)
    labels = [b.decide(known) for b in candidates]
    before, after = _nearest(labels), _nearest(labels[::-1])[::-1]
    final = {}
    for b, x, left, right in zip(candidates, labels, before, after, strict=True):
        if x is None:  # a page's edge is on neither side, unless it has an article elsewhere
            if b.in_article:
                x = bool(left or right) or (left is None and right is None)
            elif has_article:
                x = bool(left and right)
            elif left is None and right is None:
                x = True
            else:
                x = bool(left and right) or (bool(left or right) and (len(b.text) >= SHORT or (b.prose and left is not False and right is not False)))
        final[id(b)] = x
    return [final.get(id(b), False) for b in found]


def main_text(page: str) -> str:
    """The article's blocks joined by newlines; empty if there is none."""
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, judged(found), strict=True) if good)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each row.

    A null or empty page, or one without an article, gives the empty text.
    Repeated rows each give a row; an empty table gives none; other columns
    are not read.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    schema = rows.drop("html").schema.add("text", "string").add("n_chars", "long")
    return rows.mapInArrow(run, schema).select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
