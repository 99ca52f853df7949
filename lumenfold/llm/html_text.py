"""Main text of web pages by consensus host paths.

A page is parsed into blocks of text, each below a path of containers (tag and class, digits and order left out, so that
pages of one template share paths). Each page's containers are scored by the text directly in them, outside links. From the
best one the page climbs to what holds the article (always to an enclosing article or main element, else to ancestors that
add a heading or other text that isn't links) and votes for that path. Votes are summed by host in Spark. Every page is then
parsed again and its text taken from all containers at one of its host's winning paths, chosen by the votes of other pages
and by how much of the page's text lies there; a page without such a path (another template) gives its own.
Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and reader comments are left out by their
tags and by the words of their class, id and role. Words can mislead ("page sidebar-right"), so a marked element is let in
again where it holds what the page is about: a main element, most of the text, or all text that there is. Inside an article
parts of a name don't mark headings and paragraphs ("page-header"), and a section named as a discussion or reply is the
article's unless comments, a form or an article in it say otherwise. Of an article's own header its headings are kept (the
title), the rest (authors, dates) isn't. An article of nothing but links gives their text; links outside articles are no text.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, written

#: Tags whose content is no text of the page, and is skipped up to their end tag.
RAW = frozenset("script style textarea title noscript template iframe object svg math canvas audio video xmp noframes noembed".split())
#: Tags that aren't part of the article.
LEFT_OUT = frozenset("nav header footer aside form button select menu dialog fieldset head option optgroup datalist".split())
#: Of those, ones that some sites put around the page: an article or main element in them counts, and they are like marked ones.
WRAPPERS = frozenset("form header fieldset".split())
#: Words of a class, id or role that mark what isn't part of the article.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion banner banners "
    "sidebar sidebars aside rail menu menus nav navbar navigation navlist breadcrumb breadcrumbs header masthead topbar toolbar footer footers foot bottombar colophon "
    "notice notices cookie cookies consent gdpr alert popup modal overlay newsletter subscribe subscription signup login paywall "
    "comment comments commentlist disqus reply replies respond discussion share sharing shares social related recommended recommendations teaser teasers widget widgets "
    "search searchbox form forms pagination pager tags taglist hidden complementary contentinfo dialog search".split()
)
#: Of those, words of what readers write, however long that is.
COMMENTS = frozenset("comment comments commentlist disqus reply replies respond discussion".split())
#: Of these, words that are as well a part of an article ("discussion"), where nothing else there is readers'.
PARTS = frozenset("discussion respond reply replies".split())
#: Blocks of text that part of a name ("page-header") doesn't mark inside an article.
PLAIN_BLOCKS = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd pre blockquote caption figcaption".split())
#: Words that say that a mark is about the layout or a state only ("with-sidebar", "comments-open").
LAYOUT = frozenset("with has no without open closed enabled disabled".split())
#: Class names and ids of what the page is about, whatever stands beside them.
CONTENT = frozenset("page wrap wrapper container content main post entry hentry story site layout".split())
#: Kinds of marks: by part of a name ("header-fixed"), by a whole name ("sidebar"), by readers' words.
LOOSE, PLAIN, READERS = 1, 2, 3
#: How many times the text outside marks an element must hold to be let in again, by kind of mark.
TIMES = {LOOSE: 1, PLAIN: 3}
#: Containers that make up paths.
CONTAINERS = frozenset("body main article section div td center".split())
#: Tags that end a block of text, besides containers.
BLOCKS = frozenset(
    "p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote table thead tbody tfoot tr th caption figure figcaption address hr br html details summary hgroup".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Characters outside links from which on a box beside the best one is part of the article.
PROSE = 40
#: Share of a host's votes from which on a path is a template's (a host so has 100 at most, besides its first), and share of
#: the most text at such a path of a page below which another one is a small box.
TEMPLATE, SMALL = 0.01, 0.2
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
#: What is left out of a class name in a path: digits and the separator of paths.
_PLACE = re.compile(r"[\d>]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?|</{t}\Z", re.I) for t in RAW}


def _names(attributes: str) -> tuple[str, int, bool]:
    """Generalised class of a tag, the kind of mark that its class, id and role are (0 if none), and whether only PARTS make it readers'."""
    classes, kind, content, parts = "", 0, False, True
    if attributes:
        for m in _NAMES.finditer(attributes):
            value = m[2] or m[3] or m[4] or ""
            for token in value.split():
                own = set(_WORD.findall(_CAMEL.sub(" ", token).lower()))
                content = content or token.lower() in CONTENT
                if own & MARKS and not LAYOUT & own:
                    parts = parts and not own & (COMMENTS - PARTS)
                    kind = max(kind, READERS if own & COMMENTS else PLAIN if own <= MARKS else LOOSE)
            if m[1].lower() == "class":
                classes = ".".join(sorted({_PLACE.sub("", t.lower()) for t in value.split()}))
    kind = min(kind, LOOSE) if content else kind
    return classes, kind, parts and kind == READERS


class Page:
    """Containers of a page (tag, path, parent, characters outside and in links, headings) and its blocks of text (container, text).

    A path is the number of a pair (path around it, tag and class): its text is made for the voted one alone, so a page's
    memory and time grow with its length, however deep its elements lie in each other.
    """

    def __init__(self, html: str):
        self.tags, self.paths, self.parents, self.size, self.linked, self.heads, self.blocks = [""], [0], [-1], [0], [0], [0], []
        self.marks, self.freed = [0], [False]  # kind of mark; whether wrappers around it don't count
        self.part = [False]  # whether it is readers' by a word that may be an article's part, in an article
        self.steps: list[tuple[int, str]] = [(-1, "")]  # of a path: the path around it, tag and class
        self.known: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, bool, bool]] = [("", 0, False, True)]  # tag, container, left out, whether only wrappers around it are marked
        opened: dict[str, int] = {}  # how often a tag is in the stack
        text: list[str] = []
        links = [0, 0]  # open links, characters in them
        heading = [False]  # whether the text is that of a heading
        at, n = 0, len(html)

        def flush() -> None:
            if text:
                block = " ".join("".join(text).split())
                text.clear()
                if block and not stack[-1][2]:
                    c = stack[-1][1]
                    self.blocks.append((c, block))
                    self.size[c] += max(0, len(block) - links[1])
                    self.linked[c] += min(len(block), links[1])
                    self.heads[c] += heading[0]
            links[1] = 0
            heading[0] = False

        def push(tag: str, container: int, left: bool) -> None:
            opened[tag] = opened.get(tag, 0) + 1
            stack.append((tag, container, left, stack[-1][3] and (tag in WRAPPERS or not (left or self.marks[container]))))

        def pop() -> None:
            opened[stack.pop()[0]] -= 1

        def enter(tag: str, classes: str, mark: int, freed: bool = False, part: bool = False, up: int | None = None) -> None:
            up = stack[-1][1] if up is None else up
            step = (self.paths[up], f"{tag}.{classes}" if classes else tag)
            path = self.known.get(step)
            if path is None:
                path = self.known[step] = len(self.steps)
                self.steps.append(step)
            self.parents.append(up)
            self.tags.append(tag)
            self.paths.append(path)
            self.marks.append(mark)
            self.freed.append(freed)
            self.part.append(part)
            for counts in (self.size, self.linked, self.heads):
                counts.append(0)
            push(tag, len(self.paths) - 1, stack[-1][2])

        def say(part: str) -> None:
            if not stack[-1][2]:
                part = html_lib.unescape(part) if "&" in part else part
                text.append(part)
                if links[0]:
                    links[1] += len(part)

        while at < n:
            m = _MARKUP.search(html, at)
            if m is None:
                say(html[at:])
                break
            if m.start() > at:
                say(html[at : m.start()])
            at = m.end()
            name = m[2] or m[5]
            if not name:
                continue
            tag, closing, attributes = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
            if closing:
                if tag == "a":
                    links[0] = 0
                elif tag in CONTAINERS or tag in LEFT_OUT:
                    if opened.get(tag):
                        flush()
                        while stack[-1][0] != tag:
                            pop()
                        pop()
                elif tag in BLOCKS or stack[-1][0] == tag:
                    flush()
                    if stack[-1][0] == tag:  # an element that was left out
                        pop()
                continue
            if tag in RAW:
                end = _ENDS[tag].search(html, at) if not attributes.endswith("/") or tag in ("script", "style") else None
                if end or tag in ("script", "style") or not attributes.endswith("/"):
                    at = end.end() if end else n
                continue
            if tag == "a":
                links[0] = 1
            block = tag in CONTAINERS or tag in LEFT_OUT or tag in BLOCKS
            if block:
                flush()
                if stack[-1][0] == "p":  # a paragraph ends where a block begins
                    pop()
                heading[0] = tag in HEADINGS
            up, left = stack[-1][1:3]
            if tag in CONTAINERS:
                if tag == "body":
                    while len(stack) > 1:
                        pop()
                classes, mark, part = _names(attributes)
                inside = opened.get("article") or opened.get("main")
                enter(tag, classes, 0 if tag in ("body", "main") else mark, tag in ("main", "article") and stack[-1][3], bool(part and inside))
            elif tag in LEFT_OUT:
                if attributes.endswith("/"):
                    pass
                elif tag in WRAPPERS:
                    enter(tag, "", PLAIN)
                else:
                    push(tag, up, True)
            elif tag not in VOID and tag != "html":
                # Classes mark blocks, and elements that a site named itself: a marked word in a sentence belongs to it.
                named = (block or "-" in tag) and "=" in attributes and not attributes.endswith("/")
                classes, mark, _ = _names(attributes) if named else ("", 0, False)
                inside = opened.get("article") or opened.get("main")
                if inside and tag in PLAIN_BLOCKS and mark == LOOSE:
                    mark = 0
                if tag in HEADINGS and not mark and not left and opened.get("article") and self.tags[up] == "header":
                    flush()  # the title in an article's own header is the article's
                    enter(tag, classes, 0, up=self.parents[up])
                    heading[0] = True
                elif mark and not left:
                    flush()
                    enter(tag, classes, mark)
                    heading[0] = tag in HEADINGS
                elif tag == stack[-1][0]:
                    flush()
                    push(tag, up, left)
        flush()
        self.outer = [-1]  # the outermost article or main element around a container, or -1
        for c in range(1, len(self.tags)):
            up = self.outer[self.parents[c]]
            self.outer.append(up if up >= 0 else c if self.tags[c] in ("article", "main") else -1)
        self._leave_out()
        self.total = self._with_inner(self.size)

    def path(self, container: int) -> str:
        """The tags and classes from the page to a container."""
        names, k = [], self.paths[container]
        while k:
            k, name = self.steps[k]
            names.append(name)
        return "".join(f">{name}" for name in reversed(names))

    def number(self, path: str) -> int:
        """The number of a path's text; -1 if the page hasn't such a path."""
        k = 0
        for name in path.split(">")[1:]:
            k = self.known.get((k, name), -1)
            if k < 0:
                break
        return k

    def _leave_out(self) -> None:
        """Drop the text of marked elements, after letting in again those that hold what the page is about."""
        if not any(self.marks):
            return
        if any(self.part):
            readers = [self.tags[c] in ("article", "form") or (self.marks[c] == READERS and not self.part[c]) for c in range(len(self.tags))]
            signs = self._with_inner([int(x) for x in readers])
            for c in range(len(self.part)):
                if self.part[c] and not signs[c]:
                    self.marks[c] = 0
        total, n, holds = self._with_inner(self.size), len(self.parents), None
        while True:
            most = [0] * n  # the strongest mark on an element or around it
            for c in range(1, n):
                most[c] = max(self.marks[c], 0 if self.freed[c] else most[self.parents[c]])
            plain = sum(self.size[c] for c in range(n) if not most[c])
            plain = plain or sum(self.linked[c] for c in range(n) if not most[c] and self.outer[c] >= 0)  # an article of links
            outer = [c for c in range(1, n) if self.marks[c] and (self.freed[c] or not most[self.parents[c]])]
            if not outer:
                return
            chosen = self._misleading(outer, most, plain, total)
            if not chosen:
                break
            for c in chosen:
                kind, self.marks[c] = self.marks[c], 0
            if len(chosen) == 1:  # the same holds for those in it, one in the other, that hold its whole text
                holds = holds or self._holders(total)
                while (c := holds[c]) >= 0 and not (self.marks[c] and (self.tags[c] in WRAPPERS or self.marks[c] > (kind if not plain else LOOSE))):
                    self.marks[c] = 0
        for c in range(n):
            if most[c]:
                self.size[c] = self.linked[c] = self.heads[c] = 0
        self.blocks = [(c, t) for c, t in self.blocks if not most[c]]

    def _misleading(self, outer: list[int], most: list[int], plain: int, total: list[int]) -> list[int]:
        """Of the outermost marked elements those to let in, all of one path: the ones with most text, if that is enough."""
        n = len(self.parents)
        inner = [0] * n  # the strongest mark in an element's way from the outermost marked one, without that one's
        top = [-1] * n
        for c in outer:
            top[c] = c
        own = any(self.tags[c] in ("main", "article") and not most[c] and total[c] for c in range(n))
        held: dict[int, list[int]] = {}  # path: text not below whole-name marks, whether a main, an article is in it
        for c in range(1, n):
            if top[c] < 0 and most[c]:
                top[c], inner[c] = top[self.parents[c]], max(inner[self.parents[c]], self.marks[c])
            if top[c] >= 0:
                x = held.setdefault(self.paths[top[c]], [0, 0, 0])
                x[0] += self.size[c] if inner[c] <= LOOSE else 0
                if total[c]:
                    x[1] |= self.tags[c] == "main"
                    x[2] |= self.tags[c] == "article" and inner[c] <= LOOSE and self.marks[c] <= LOOSE
        best = None
        for c in outer:
            text, main, article = held[self.paths[c]]
            mark = self.marks[c]
            if main and not own and self.tags[c] not in WRAPPERS:
                enough = True
            elif mark == READERS:
                enough = False
            else:
                enough = text > plain * (1 if article and not own else TIMES[mark])
            if enough and (best is None or (main, text) > best[0]):
                best = (main, text), self.paths[c]
        if best is None and not plain:  # no text but in marked elements
            whole: dict[tuple[bool, int], int] = {}
            for c in outer:
                key = (self.marks[c] != READERS, self.paths[c])
                whole[key] = whole.get(key, 0) + total[c]
            key = max((k for k in whole if whole[k]), key=lambda k: (k[0], whole[k]), default=None)
            best = key and (None, key[1])
        return [c for c in outer if self.paths[c] == best[1]] if best else []

    def _holders(self, total: list[int]) -> list[int]:
        """For each container the one directly in it that holds all its text, or -1."""
        out = [-1] * len(self.parents)
        for c in range(1, len(out)):
            up = self.parents[c]
            if total[c] and total[c] == total[up]:
                out[up] = c
        return out

    def _with_inner(self, counts: list[int]) -> list[int]:
        """The sum of counts over each container and all in it."""
        out = list(counts)
        for c in range(len(out) - 1, 0, -1):  # a container comes after its parent
            out[self.parents[c]] += out[c]
        return out

    def scores(self) -> list[float]:
        """Text in each container itself, and half of that in the containers directly in it."""
        out = [float(x) for x in self.size]
        for c, up in enumerate(self.parents):
            if up >= 0:
                out[up] += self.size[c] / 2
        return out

    def best(self) -> int:
        """The container of the highest score, or -1; the first of equals."""
        scores = self.scores()
        return max((c for c in range(len(scores)) if scores[c] > 0), key=lambda c: (scores[c], -c), default=-1)

    def element(self, container: int) -> int:
        """The outermost article or main element around a container, or the container itself."""
        return self.outer[container] if self.outer[container] >= 0 else container

    def article(self) -> int:
        """The container that holds the article, or -1.

        Outside article and main elements this is the last ancestor of the best container that adds to it: text of its own
        (in body a heading, or as much as a box must have), or a box with a heading or prose that isn't mostly links.
        """
        c = self.best()
        if c < 0:  # an article of nothing but links, if any
            whole = self._with_inner(self.linked)
            return max((k for k in range(len(whole)) if whole[k] and self.outer[k] == k), key=lambda k: (whole[k], -k), default=-1)
        if self.tags[self.element(c)] in ("article", "main"):
            return self.element(c)
        linked, heads = self._with_inner(self.linked), self._with_inner(self.heads)
        adds = [0] * len(self.parents)  # boxes directly in it that would add to the article
        for k in range(1, len(adds)):
            adds[self.parents[k]] += self._adds(self.total[k], linked[k], heads[k])
        found = c
        while self.parents[c] >= 0:
            up = self.parents[c]
            own = self.size[up] > self.linked[up] if self.tags[up] not in ("", "body") else self._adds(self.size[up], self.linked[up], self.heads[up])
            if own or adds[up] > self._adds(self.total[c], linked[c], heads[c]):
                found = up
            c = up
        return found

    @staticmethod
    def _adds(prose: int, linked: int, heads: int) -> bool:
        return prose > linked and (heads > 0 or prose >= PROSE)

    def at(self, path: int) -> list[int]:
        """The containers at a path, or the article or main elements around them; none if there is no text outside links."""
        found = [c for c in range(len(self.paths)) if self.paths[c] == path]
        return sorted({self.element(c) for c in found}) if any(self.total[c] for c in found) else []

    def within(self, containers: list[int]) -> list[bool]:
        """Of each container whether it is one of these or in one."""
        inside = [False] * len(self.parents)
        for c in containers:
            inside[c] = True
        for c, up in enumerate(self.parents):  # a container comes after its parent
            inside[c] = inside[c] or (up >= 0 and inside[up])
        return inside

    def text(self, containers: list[int]) -> str:
        """The blocks in the containers, in page order, one space between them."""
        inside = self.within(containers)
        return " ".join([t for c, t in self.blocks if inside[c]])


def main_text(page: Page, winners: list[tuple[str, int]]) -> str:
    """Text of a page, given its host's winning paths and their votes; the page's own vote says nothing about a template."""
    c = page.article()
    own = page.paths[c] if c >= 0 else -1
    found = []  # votes times text, path, text, containers
    for name, count in winners:
        path = page.number(name)
        count -= path == own
        at = page.at(path) if count and path >= 0 else []
        if at:
            text = sum(page.total[k] for k in at)
            found.append((count * text, path, text, at))
    if found:
        most = max(x[2] for x in found)
        at = max((x for x in found if x[2] >= SMALL * most), key=lambda x: x[0])[3]
        if any(x[1] == own for x in found):
            inside = page.within([c])
            if all(inside[k] for k in at):  # other pages back the larger choice too
                at = page.at(own)
        return page.text(at)
    return page.text(page.at(own) or [c]) if c >= 0 else ""


def host(url):
    """Host of a URL, lower-case; empty if there is none."""
    return F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)


def votes(pages: DataFrame) -> DataFrame:
    """host, path, votes, score: one vote a page, summed in each batch before they are shuffled."""

    def run(batches):
        for b in batches:
            sums: dict[tuple[str, str], list[float]] = {}
            for i in range(b.num_rows):
                page = Page(b.column(1)[i].as_py())
                c = page.article()
                if c >= 0 and page.total[c]:
                    x = sums.setdefault((b.column(0)[i].as_py(), page.path(c)), [0, 0.0])
                    x[0] += 1
                    x[1] += page.total[c]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.string()), pa.array([v[0] for v in sums.values()], pa.int64()), pa.array([v[1] for v in sums.values()], pa.float64())], ["host", "path", "votes", "score"])

    each = pages.select("host", "html").mapInArrow(run, "host string, path string, votes long, score double")
    return each.groupBy("host", "path").agg(F.sum("votes").alias("votes"), F.sum("score").alias("score"))


def winning_paths(of: DataFrame) -> DataFrame:
    """host, paths (path, votes): a host's first path by votes (then by name) and all with the share of a template."""
    ranked = of.selectExpr("*", "row_number() over (partition by host order by votes desc, path) as r", "sum(votes) over (partition by host) as n")
    top = ranked.where((F.col("r") == 1) | (F.col("votes") >= TEMPLATE * F.col("n"))).groupBy("host").agg(F.array_sort(F.collect_list(F.struct("r", "votes", "path"))).alias("p"))
    return top.select("host", F.transform("p", lambda x: F.struct(x.path.alias("path"), x.votes.alias("votes"))).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null or empty html: empty text. Null url: the pages without a host vote together. Repeated rows and null page_ids are
    kept as they are; other columns are not read. Pages of any length are parsed whole, one at a time. Winners go to the
    pages by a join on the host: Spark broadcasts them only below its size limit, and splits a host that has most pages.
    """
    own = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("host", host(F.col("url")))
    best = written(winning_paths(votes(own)), shared_dir(pages.sparkSession), "winners")  # its size is known: if small, pages stay where they are

    def run(batches):
        for b in batches:
            texts = [main_text(Page(b.column(2)[i].as_py()), [(w["path"], w["votes"]) for w in b.column(3)[i].as_py() or []]) for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return own.join(best, "host", "left").select("page_id", "url", "html", "paths").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
