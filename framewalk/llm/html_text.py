"""HTML extraction by minimum-cut labelling.

A page is cut into blocks of text.  A linear classifier over a block's text and
its place in the document gives log odds of being content; these become the
capacities of the block's links to the two terminals.  Blocks that follow each
other, and blocks of the same container, are linked too, the closer the stronger.
The minimum cut, found by maximum flow, parts content from boilerplate.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewalk.llm.common import Workspace, table

# Elements by their part in a page.
BREAKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("nav footer aside menu dialog template noscript button select textarea option svg math object canvas head title search".split())
ALWAYS = frozenset("article main".split())
HEAD_ONLY = frozenset("title noscript template".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_SAME = {"li": "li", "dd": "dd dt", "dt": "dd dt", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

# Words in class, id and role that tell what a container is.
BAD_WORDS = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars rail footer foot cookie cookies consent gdpr privacy notice notices notification notifications alert alerts announcement popup popups modal overlay subscribe subscription newsletter signup signin login register share sharing social socials related recommended recommendations recommend trending popular breadcrumb breadcrumbs pagination pager paging comment comments commentlist disqus reply replies respond discussion responses widget widgets toolbar skip copyright legal masthead topbar navbar nav navigation navigational menu menus submenu outbrain taboola search searchbox form contactform complementary contentinfo dialog teaser teasers paywall print hidden".split())
HEADS = frozenset("header heading hd head".split())
GOOD_WORDS = frozenset("content article post entry story body main maintext text".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond responses discussion".split())
LAYOUT = frozenset("with without has no none and page layout wrapper wrap outer".split())

RAW = re.compile(r"<!--|<!\[CDATA\[|<(script|style|title|textarea|iframe|xmp|noembed|noframes)\b", re.I)
SHUT = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in "script style title textarea iframe xmp noembed noframes".split()}
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
NO_TAG = re.compile(r"<[!?/][^>]*(?:>|\Z)")
MARK = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
RIGHTS = re.compile(r"©|\bcopyright\b|all rights reserved", re.I)

#: Log odds that a block's place gives: in readers' comments or out of sight; in an element that is no content; in one that only its class
#: (or being a form) makes such; in an article; in what its class calls content.
READER, ELEMENT, CLASS, GOOD, HINT = -5.0, -4.5, -3.5, 2.5, 1.6
#: Strength of the link between neighbours of one container, halved for each step between their containers; between a block and the one before it in its container.
NEXT, SAME = 0.8, 0.7
#: What only its class makes bad, a form, or an element that is never closed is believed the less, the more of a page's text it
#: holds: by 1 - share ** HOLDS.
HOLDS = 4
#: What a block's links cost at most, and how much less for each unit of good odds: a linked item of an article is a part of it.
LINKED, IN_PLACE = 4.0, 1.2


class Block:
    __slots__ = ("text", "links", "tag", "path", "good", "bad")

    def __init__(self, text: str, links: float, tag: str, path: tuple[int, ...], good: float, bad: int):
        self.text, self.links, self.tag, self.path, self.good, self.bad = text, links, tag, path, good, bad


class Bad:
    """A container that is no content by itself, inside another such one (by its place in the list)."""

    __slots__ = ("inside", "odds", "soft", "held")

    def __init__(self, inside: int, odds: float, soft: bool):
        self.inside, self.odds, self.soft, self.held = inside, odds, soft, 0


def without_raw(page: str) -> str:
    """A page without comments and the elements whose content is not markup; each search goes on where the last one ended."""
    out, at, unclosed = [], 0, set()
    while m := RAW.search(page, at):
        tag = (m[1] or "").lower()
        end = -1
        if tag:
            start = page.find(">", m.end())
            if start >= 0 and tag not in unclosed:
                found = SHUT[tag].search(page, start)
                end = found.end() if found else -1
        else:
            mark = "-->" if m[0] == "<!--" else "]]>"
            found_at = page.find(mark, m.end() - (2 if mark == "-->" else 0))
            end = found_at + 3 if found_at >= 0 else -1
        if end < 0 and tag not in ("", "script", "style"):  # read as any other element
            unclosed.add(tag)
            out.append(page[at : m.end()])
            at = m.end()
            continue
        out += (page[at : m.start()], " ")
        if end < 0:
            return "".join(out)
        at = end
    out.append(page[at:])
    return "".join(out)


class Tags:
    """Finds where the tags of a page end, past the ">" in quoted values.

    A quote opens a value only after "=".  One that is not closed up to the page's end is none.  A tag without an end
    outside of its values ends at its first ">", or with the page.  All searches together pass over the page a few times at
    most: they go forward, and a place from which there was no end is not searched from again.
    """

    def __init__(self, page: str):
        self.page, self.last, self.unclosed, self.endless = page, page.rfind(">"), set(), set()

    def end(self, at: int) -> tuple[int, int]:
        """(end of the attributes, end of the tag) of the tag whose name ends at `at`."""
        page, k, passed = self.page, at, [at]
        if at > self.last:
            return len(page), len(page)
        while k not in self.endless and (m := MARK.search(page, k)):
            k = m.end()
            if m[0] == ">":
                return k - 1, k
            before = k - 2
            while before >= at and page[before].isspace():
                before -= 1
            if page[before] == "=" and before >= at and m[0] not in self.unclosed:
                close = page.find(m[0], k)
                if close >= 0:
                    k = close + 1
                else:
                    self.unclosed.add(m[0])
            passed.append(k)
        self.endless.update(passed)
        first = page.find(">", at)
        return first, first + 1


def evidence(tag: str, attributes: str, inside: bool) -> tuple[float, bool, float]:
    """What a container tells of the blocks in it: (bad odds or 0, whether only softly so, good odds or 0)."""
    words: set[str] = set()
    bad: set[str] = set()
    if attributes:
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and UNSEEN.search(value):
                return READER, False, 0.0
            if name in ("class", "id", "role"):
                for token in value.split():
                    own = {w.lower() for w in WORD.findall(token)}
                    words |= own
                    if not own & LAYOUT:  # "content-with-sidebar" holds more than a sidebar
                        bad |= own & BAD_WORDS
    if tag in NEVER:
        return ELEMENT, False, 0.0
    if tag not in ("html", "body", "main"):
        if bad & READERS:
            return READER, False, 0.0
        if bad or tag == "form":
            return CLASS, True, GOOD if tag in ALWAYS else 0.0
        if (tag == "header" or words & HEADS) and not (inside or words & GOOD_WORDS):
            return (ELEMENT, False, 0.0) if tag == "header" else (CLASS, True, 0.0)
    return 0.0, False, GOOD if tag in ALWAYS else HINT if words & GOOD_WORDS else 0.0


def blocks_of(page: str) -> tuple[list[Block], list[Bad]]:
    """The blocks of text of a page, in order, and the containers that are no content by themselves (the first one is none)."""
    page = without_raw(page)
    out: list[Block] = []
    bads = [Bad(0, 0.0, False)]
    stack: list[tuple[str, int, float, bool, int]] = [("", 0, 0.0, False, 0)]  # tag, number, good odds, inside an article, bad container
    text: list[str] = []
    size = [0, 0]  # characters: all, linked
    link = made = at = look = 0
    tags = Tags(page)
    skipped: list[str] = []  # open inline elements that are bad by themselves, up to the next block

    def flush() -> None:
        if text:
            words = " ".join("".join(text).split())
            if words:
                top = stack[-1]
                bads[top[4]].held += len(words)
                out.append(Block(words, size[1] / max(1, size[0]), top[0], tuple(x[1] for x in stack[-4:]), top[2], top[4]))
            text.clear()
            size[:] = 0, 0

    def leave(k: int, shut: bool) -> None:
        """Ends the containers from the k-th on; one that has no end of its own is not believed as firmly."""
        for j in range(k + shut, len(stack)):
            if stack[j][0] in NEVER and stack[j][4] and stack[j][4] != stack[j - 1][4]:
                bads[stack[j][4]].soft = True
        del stack[k:]

    while (start := page.find("<", look)) >= 0:
        m = TAG.match(page, start)
        if m:
            stop, look = tags.end(m.end())
        elif other := NO_TAG.match(page, start):
            look = other.end()
        else:
            look = start + 1
            continue
        if start > at and not skipped:
            piece = page[at:start]
            text.append(entities.unescape(piece) if "&" in piece else piece)
            size[0] += len(piece)
            size[1] += len(piece) if link else 0
        at = look
        if not m:
            continue
        shut, tag, attributes = m[1], m[2].lower(), page[m.end() : stop]
        if tag not in BREAKS and tag not in NEVER:
            if skipped:
                if shut and tag in skipped:
                    del skipped[len(skipped) - 1 - skipped[::-1].index(tag) :]
                elif not shut and tag == skipped[0]:
                    skipped.append(tag)
            elif not shut and attributes and tag not in VOID and evidence(tag, attributes, True)[0] < 0:
                skipped.append(tag)
            if tag == "a":
                link = 0 if shut else 1
            elif tag == "br":
                text.append(" ")
            continue
        skipped.clear()
        flush()
        if shut:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    leave(k, True)
                    break
            continue
        if tag in VOID:
            continue
        if tag == "body":
            leave(1, False)
        while stack[-1][0] in ("head", "title") and tag not in HEAD_ONLY:  # neither needs an end tag
            stack.pop()
        if stack[-1][0] in CLOSED_BY_BLOCK:
            stack.pop()
        same = CLOSED_BY_SAME.get(tag)
        if same and stack[-1][0] in same.split():
            stack.pop()
        above = stack[-1]
        made += 1
        bad, soft, good = evidence(tag, attributes, above[3])
        if bad:
            bads.append(Bad(above[4], bad, soft))
        stack.append((tag, made, max(above[2], good), above[3] or tag in ALWAYS, len(bads) - 1 if bad else above[4]))
    if at < len(page) and not skipped:
        text.append(entities.unescape(page[at:]))
        size[0] += len(page) - at
    flush()
    leave(1, False)
    return out, bads


def places_of(blocks: list[Block], bads: list[Bad]) -> list[float]:
    """The log odds that each block's place gives: bad ones as far as they are believed, good ones for the rest."""
    for k in range(len(bads) - 1, 0, -1):  # what is inside comes later
        bads[bads[k].inside].held += bads[k].held
    total = max(1, bads[0].held)
    odds, believed = [0.0], [0.0]
    for b in bads[1:]:
        sure = 1 - (b.held / total) ** HOLDS if b.soft else 1.0
        worse = b.odds * sure < odds[b.inside]
        odds.append(b.odds * sure if worse else odds[b.inside])
        believed.append(sure if worse else believed[b.inside])
    return [odds[b.bad] + (1 - believed[b.bad]) * b.good for b in blocks]


def log_odds(b: Block, place: float) -> float:
    """The classifier: log odds that the block is content, by its own text and its place."""
    words = b.text.count(" ") + 1
    out = place - 0.6 + min(2.5, 0.9 * math.log(words)) - (LINKED - IN_PLACE * max(0.0, place)) * b.links
    if b.text[-1] in ".!?…:;\"”»":
        out += 0.6
    if b.tag in ("p", "pre", "blockquote"):
        out += 0.7
    elif b.tag in ("li", "td", "th", "dt"):
        out -= 0.3
    elif b.tag[:1] == "h" and b.tag[1:].isdigit():
        out += 0.5
    if words < 40 and RIGHTS.search(b.text):
        out -= 4.0
    return out


def min_cut(odds: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """Whether each node lies on the source's side of the minimum cut (maximum flow by blocking flows)."""
    n = len(odds)
    give, take = [max(x, 0.0) for x in odds], [max(-x, 0.0) for x in odds]
    head: list[list[int]] = [[] for _ in range(n)]
    to: list[int] = []
    room: list[float] = []
    for a, b, w in links:
        head[a].append(len(to))
        head[b].append(len(to) + 1)
        to += (b, a)
        room += (w, w)
    tiny = 1e-9
    while True:
        level = [-1] * n
        front = [i for i in range(n) if give[i] > tiny]
        for i in front:
            level[i] = 0
        reached, depth = False, 0
        while front:
            depth += 1
            later = []
            for i in front:
                reached = reached or take[i] > tiny
                for e in head[i]:
                    if room[e] > tiny and level[to[e]] < 0:
                        level[to[e]] = depth
                        later.append(to[e])
            front = later
        if not reached:
            return [x >= 0 for x in level]
        tried = [0] * n
        for s in range(n):
            while level[s] == 0 and give[s] > tiny:
                path: list[int] = []
                i = s
                while take[i] <= tiny:
                    while tried[i] < len(head[i]):
                        e = head[i][tried[i]]
                        if room[e] > tiny and level[to[e]] == level[i] + 1:
                            break
                        tried[i] += 1
                    else:
                        if not path:
                            break
                        i = to[path.pop() ^ 1]
                        tried[i] += 1
                        continue
                    path.append(e)
                    i = to[e]
                if take[i] <= tiny:
                    break
                flow = min([give[s], take[i], *(room[e] for e in path)])
                give[s] -= flow
                take[i] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow


def smoothness(blocks: list[Block]) -> list[tuple[int, int, float]]:
    """Links of neighbours (weaker the farther apart in the tree), and of each block to the one before it in its container."""
    out, last = [], {}
    for k, b in enumerate(blocks):
        path = b.path
        if k:
            before = blocks[k - 1].path
            steps = max(len(path), len(before)) - len(set(path) & set(before))
            out.append((k - 1, k, NEXT / 2 ** max(0, steps - 1)))
        home = path[-2] if len(path) > 1 else 0
        j = last.get(home)
        if j is not None:
            out.append((j, k, SAME))
        last[home] = k
    return out


def labels_of(blocks: list[Block], bads: list[Bad]) -> tuple[list[float], list[bool]]:
    """The classifier's log odds of each block, and which blocks are content by the minimum cut."""
    odds = [log_odds(b, place) for b, place in zip(blocks, places_of(blocks, bads))]
    if all(x > 0 for x in odds):
        return odds, [True] * len(odds)
    return odds, min_cut(odds, smoothness(blocks))


def main_text(page: str | None) -> str:
    """The content blocks of a page, one a line."""
    if not page:
        return ""
    blocks, bads = blocks_of(page)
    return "\n".join(b.text for b, kept in zip(blocks, labels_of(blocks, bads)[1]) if kept)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: (page_id, url, text).

    Character references are decoded; white space inside a block (a line break
    too) is one space.  A null or empty page, or one without content, gives the
    empty text.
    """
    Workspace(pages.sparkSession, "html")

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(x) for x in batch], dtype="object")

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text(F.col(html_col)).alias("text"))


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))
