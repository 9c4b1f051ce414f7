"""Main text of web pages by two passes of block rules.

A page is cut into blocks at its block elements; what containers of menus, adverts, comments
and so on hold is left out. The first pass decides the other blocks, inside an article or
not, by the share of their text in links, by length and by the density of stop words. The
second pass gives blocks that stay ambiguous the label of the nearest neighbour decided so.
Inside an article only neighbours in the article count that are text, so that a line beside
a list of links stays. Few stop words alone decide nothing: they are also few in languages
without a list, in lists, tables and code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Rules of the first pass.
SHORT_CHARS = 70
LONG_CHARS = 200
MOST_LINKS = 0.5
FEW_LINKS = 0.2
LEAST_STOP_WORDS = 0.1
MANY_STOP_WORDS = 0.25

STOP_WORDS = frozenset("""
a all an and are as at be been but by can for from had has have he her his if in into is it its more no not of on one or
she so than that the their there they this to was we were what when which who will with would you
aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer es für hat ich im ist mit nach nicht
noch nur oder sich sie sind so um und von vor war wie wird zu zum zur über
au aux avec ce ces cette dans de des du elle en est et il ils je la le les leur lui mais ne nous on ou par pas plus pour
que qui sa se ses son sont sur un une vous à été
al como con del donde el ella ellos en entre era es esta este fue ha hay la las lo los más mi muy no o para pero por que
se si sin sobre son su sus también un una y ya
""".split())

BLOCKS = frozenset("""
address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 head header hr html iframe label legend li main menu nav noscript object ol option p pre search
section select summary svg table tbody td template tfoot th thead tr ul video audio canvas
""".split())
# Their content is no markup; it ends at the closing tag only.
RAW = frozenset(["script", "style", "textarea", "title", "xmp", "noembed", "noframes"])
# Elements that never hold main text.
NEVER = frozenset("""
audio button canvas dialog footer head iframe label legend menu nav aside noscript object option search select svg template
video
""".split())
NEVER_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# Words of class and id names that mark a container as beside the article.
BESIDE = frozenset("""
ad ads adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist
consent cookie cookies disclaimer discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter
notice notices notification overlay pager pagination popup promo promotion recommended related replies reply respond search
share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget
""".split())
# Words that may stand beside those in one class name; any other word makes the name say nothing.
NEUTRAL = frozenset("""
area article bar blog block body bottom box c card center column container content copy desktop div element entry fixed foot
for form frame global group head header holder id info inner item items js l label left link links list main message mobile
module my new news our outer page panel placeholder post primary reader region right row second secondary section site slot
space sticky story sub text the thread title top ui unit user wrap wrapper your zone
""".split())
ARTICLE = frozenset(["article", "main"])
HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORDS = re.compile(r"[^\W\d_]+")
_SPACE_OUT = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    linked: int
    beside: bool
    article: bool
    form: bool
    heading: bool


def _is_beside(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element starts a part of the page that is not its main text."""
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for name, value in _NAMES.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True
        if name == "style" and _SPACE_OUT.search(value):
            return True
        if name == "role" and value.lower() in NEVER_ROLES:
            return True
        if name in ("class", "id"):
            for token in value.split():
                parts = {p.lower() for p in _PARTS.findall(token)}
                # An article may be named after what surrounds it, but comments are never the article.
                if tag in ARTICLE:
                    parts &= {"comment", "comments", "reply", "teaser"}
                # "site-footer" names a container, "has-sidebar" and "notice-board" do not.
                if parts & BESIDE and not parts - BESIDE - NEUTRAL:
                    return True
                if "header" in parts and not in_article and not parts - NEUTRAL:
                    return True
    return False


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, content): kind is text, start or end."""
    pattern, at, size = _TAG, 0, len(page)
    lower = None
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            yield "text", "", page[at:]
            return
        if begin > at:
            yield "text", "", page[at:begin]
        if page.startswith("<!--", begin):
            end = page.find("-->", begin + 4)
            at = size if end < 0 else end + 3
            continue
        if begin + 1 < size and page[begin + 1] in "!?":
            end = page.find(">", begin)
            at = size if end < 0 else end + 1
            continue
        found = pattern.match(page, begin)
        if not found and pattern is _TAG and begin + 1 < size and (page[begin + 1].isalpha() or page[begin + 1] == "/"):
            found = _PLAIN_TAG.match(page, begin)
            if found and found[3].count('"') % 2:
                # A quote that never closes: from here on quotes do not protect a sign.
                pattern = _PLAIN_TAG
        if not found:
            if begin + 1 < size and (page[begin + 1].isalpha() or page[begin + 1] == "/"):
                end = page.find(">", begin)
                if end < 0:
                    # The page ends inside a tag.
                    return
                at = end + 1
                continue
            yield "text", "", "<"
            at = begin + 1
            continue
        closing, name, attributes = found[1], found[2].lower(), found[3]
        at = found.end()
        if closing:
            yield "end", name, ""
        else:
            yield "start", name, attributes
            if name in RAW:
                lower = page.lower() if lower is None else lower
                end = lower.find(f"</{name}", at) if len(lower) == size else page.find(f"</{name}", at)
                at = size if end < 0 else end


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order: white space within is one blank, character references are decoded."""
    out: list[Block] = []
    # Open elements: tag, whether beside, whether in the article, whether in a form outside it.
    stack: list[tuple[str, bool, bool, bool]] = []
    pieces: list[str] = []
    linked, links, heading, raw, seen_article = 0, 0, False, False, False

    def flush() -> None:
        nonlocal linked, heading
        if pieces:
            text = " ".join(unescape("".join(pieces)).split())
            if text:
                _, beside, article, form = stack[-1] if stack else ("", False, False, False)
                out.append(Block(text, linked, beside, article, form, heading))
            pieces.clear()
        linked, heading = 0, False

    for kind, name, content in _tokens(page):
        if kind == "text":
            if not raw:
                pieces.append(content)
                if links:
                    linked += len("".join(unescape(content).split()))
            continue
        if kind == "start":
            if name in RAW:
                raw = True
                continue
            if name == "br":
                pieces.append(" ")
                continue
            if name == "a":
                links = 1
                continue
            if name in VOID and name != "hr":
                continue
            if name not in BLOCKS and name != "span":
                continue
            if name != "span":
                flush()
                # A new block ends an open paragraph, a new item its predecessor.
                while stack and stack[-1][0] in ("p", "span", *HEADINGS):
                    stack.pop()
                if name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
                    stack.pop()
            if name == "hr":
                continue
            _, beside, article, form = stack[-1] if stack else ("", False, False, False)
            own = _is_beside(name, content, article)
            if name == "span" and own:
                flush()
            if name in ARTICLE and not own and not seen_article:
                structural = any(t in NEVER for t, *_ in stack)
                seen_article, article, form = True, True, False
                beside = beside and structural
            elif name in ARTICLE and not own and not beside:
                article = True
            stack.append((name, beside or own, article, form or (name == "form" and not article)))
            heading = name in HEADINGS or (heading and name == "span")
            if content.rstrip().endswith("/") and name in ("svg", "iframe"):
                stack.pop()
            continue
        if name in RAW:
            raw = False
        elif name == "a":
            links = 0
        elif name in BLOCKS or name == "span":
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if name != "span":
                flush()
            if at is not None and (name != "span" or stack[at][1] or at == len(stack) - 1):
                if name == "span" and stack[at][1]:
                    flush()
                del stack[at:]
    flush()
    return out


def first_pass(block: Block) -> bool | None:
    """Whether a block is main text; None if links, length and density do not tell."""
    if block.beside:
        return False
    size = len(block.text.replace(" ", ""))
    links = block.linked / max(size, 1)
    if links > MOST_LINKS:
        return False
    if len(block.text) < SHORT_CHARS:
        return None
    words = _WORDS.findall(block.text.lower())
    density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
    if density >= MANY_STOP_WORDS:
        return True if len(block.text) > LONG_CHARS or links <= FEW_LINKS else None
    if density >= LEAST_STOP_WORDS and len(block.text) > LONG_CHARS and links <= FEW_LINKS:
        return True
    return None


def second_pass(found: list[Block], labels: list[bool | None], decided: list[int], inside: bool) -> None:
    """Give ambiguous blocks (those of articles, or the others) the label of the nearest decided one."""
    k = 0
    for i, block in enumerate(found):
        if labels[i] is not None or block.article != inside:
            continue
        while k < len(decided) and decided[k] < i:
            k += 1
        before, after = decided[k - 1] if k else None, decided[k] if k < len(decided) else None
        if before is None or after is None:
            nearest = after if before is None else before
        else:
            # A heading belongs to what follows; ties go there, too.
            nearest = after if block.heading or after - i <= i - before else before
        labels[i] = labels[nearest]


def labelled(found: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    labels = [first_pass(b) for b in found]
    # A form is beside the text, unless the page has its text nowhere else.
    if any(b.article and not b.beside for b in found) or any(label and not b.form for b, label in zip(found, labels, strict=True)):
        labels = [False if b.form else label for b, label in zip(found, labels, strict=True)]
        beside = [b.beside or b.form for b in found]
    else:
        beside = [b.beside for b in found]
    # What stands beside the article says nothing about the blocks between.
    first = list(labels)
    for inside in (True, False):
        decided = [
            i for i, b in enumerate(found)
            if first[i] is not None and not beside[i] and (not inside or (b.article and first[i]))
        ]
        if any(first[i] for i in decided):
            second_pass(found, labels, decided, inside)
    return [label is not False for label in labels]


def main_text(page: str | None) -> str:
    """Main text of a page, one line per block; empty if there is none."""
    found = blocks(page or "")
    return "\n".join(b.text for b, kept in zip(found, labelled(found), strict=True) if kept)


def extracted(html: Column) -> Column:
    """Main text of an html column; a null or empty page has the empty text.

    The whole page is read, however long. Where density finds no main text, all blocks stay
    that neither stand beside the article nor consist of links. A form is beside the text,
    but an article in it is not, nor is a form that holds all there is. A page that ends
    inside a tag loses that tag only. Repeated pages give a text each; no rows give none.
    """

    @F.arrow_udf(T.StringType())
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text(p) for p in pages.to_pylist()], pa.string())

    return extract.asNondeterministic()(html.cast("string"))
