"""Main text of web pages, from containers on which the pages of a host agree.

1. Each page's containers (article, main, section, div, table cell, body) are scored by the text
   of their blocks that is neither link text nor part of menus, headers, footers, sidebars,
   notices, adverts, forms or comments. A block counts for the container next above it, and a
   tenth less for each one further up; ``article`` and ``main`` count more, ``body`` half.
2. A container's path is that of its tags and classes from the root, without numbers, as a hash.
   Each page votes for its paths by their score relative to its best one, and Spark adds the
   votes of each host.
3. The text is taken anew from the containers on the path that won the host; a page without
   text there uses its own best path. Boilerplate inside the container is left out.
4. From there the text climbs to the container around, up to an ``article`` or ``main``, as long as
   what that adds is text with at most a quarter in links. It must stand in that container itself,
   or bring the first ``h1`` with it: containers beside the article that do not are not part of it.

A form, or an element that is boilerplate only by its names, is none if it is a wrapper of the
page: if it holds the ``main`` or the longest ``article`` (with a quarter of the page's text that is
not link text), or more than half of that text (nine tenths, if its name has no other words).
Inside an article a name such as "related-work" or "search-results" does not count either, where the
element is a paragraph or holds ``PROSE`` characters, with at most a tenth in links and no controls.
Comments may be longer than the article, so they are no wrapper by their length. If nothing else of
a page is left, names and forms do not count.

Character references are decoded, white space inside a block becomes one space, and blocks are
joined in page order by one space. Nothing else is dropped. A null or empty page has the text
``""``; a page without a usable url belongs to the host ``""``. Each row has its own result, so
repeated rows have equal ones.

The table of winners has one row per host: it is broadcast up to ``FEW_HOSTS`` rows and joined by
shuffle beyond.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.scratch import written
from .words import slices

FEW_HOSTS = 200_000
VOTE = 1000

# Elements by their role.
CONTAINERS = frozenset("article main section div td body".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
                   "strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template noframes xmp".split())
APART = frozenset("nav aside footer button select option input dialog menu svg canvas object audio video head".split())
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table tbody thead tfoot select html body article main section div td th".split())
HEAD = frozenset("head meta title base link style script noscript template".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset("nav navbar navigation menu breadcrumb breadcrumbs footer sidebar aside ad ads advert adverts advertisement advertising adsense adbox "
                  "banner promo promotion sponsor sponsored cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup login "
                  "share sharing social related recommended recommendations comment comments disqus respond reply replies widget toolbar pagination "
                  "pager search form skip alert masthead topbar".split())
COMMENTS = frozenset("comment comments disqus respond reply replies".split())
#: Names that sections of an article have as well ("related-work", "search-results"); prose of this length decides for these.
AMBIGUOUS, PROSE = frozenset("related search reply respond".split()), 200
#: Names with these words tell what a page has, not what an element is.
HAS, STATE = frozenset("no has with without".split()), frozenset("open opened closed enabled disabled on off".split())
#: Parts of the page's text beyond which an element is a wrapper: for mixed names and forms, for names of nothing else, for comments.
MIXED, PURE, NEVER = 0.5, 0.9, 2.0

# What a quote opens is closed again only right behind "="; what has matched is not tried another way, so a page is read once.
TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
                 r"""|<(/?)([a-zA-Z][^\s/>]*+)((?>(?:[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+))>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
HOST = r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@cache
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I)


def host_of(url: str) -> Column:
    """The host of a url column, in lower case; empty if there is none."""
    found = F.regexp_extract(F.coalesce(F.col(f"`{url}`").cast("string"), F.lit("")), HOST, 1)
    return F.lower(found)


def _set_apart(tag: str, attributes: dict[str, str], inside: bool) -> float:
    """0 for an element that is no boilerplate, -1 for one that is, else the part of the page's text above which it is none;
    ``inside``: it lies in an article or main, or in two other containers."""
    if tag in APART or (tag == "header" and not inside):
        return -1
    if attributes.get("role", "").lower() in ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return -1
    if re.search(r"display\s*:\s*none", attributes.get("style", ""), re.I):
        return -1
    if tag in ("html", "body", "main"):
        return 0
    part = MIXED if tag == "form" else 0
    for name in f"{attributes.get('class', '')} {attributes.get('id', '')}".split():
        words = [w.lower() for w in NAME.findall(name)]
        named = NAMES.intersection(words)
        if named and not (HAS.intersection(words[:-1]) or words[-1] in STATE):
            part = max(part, NEVER if named <= COMMENTS else PURE if named.issuperset(words) else MIXED)
        if words == ["header"] and not inside:
            part = max(part, PURE)
    return part


class Page:
    """Elements and pieces of text of a page, in page order."""

    def __init__(self, html: str) -> None:
        #: per element: parent, tag, path, containers around it (an article or main counts as two), boilerplate
        self.parent, self.tag, self.path, self.around, self.apart = [-1], [""], [0], [0], [False]
        #: elements that may be boilerplate by their names or as forms, with the part of the text that makes them wrappers
        self.named: dict[int, float] = {}
        #: those of them whose names sections of an article may have
        self.ambiguous: set[int] = set()
        #: (element, text, link): text None is the edge of a block
        self.pieces: list[tuple[int, str | None, bool]] = []
        self._read(html)
        if self.named:
            self._set_named_apart()

    def _open(self, tag: str, attributes: dict[str, str], above: int) -> int:
        around = self.around[above] + (2 if tag in ("article", "main") else tag in CONTAINERS and tag != "body")
        classes = sorted(re.sub(r"\d+", "#", c.lower()) for c in attributes.get("class", "").split())
        step = f"{self.path[above]}/{tag}.{'.'.join(classes)}"
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(int.from_bytes(blake2b(step.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True))
        self.around.append(around)
        part = _set_apart(tag, attributes, self.around[above] > 1)
        self.apart.append(self.apart[above] or part < 0)
        if part > 0 and not self.apart[-1]:
            self.named[len(self.apart) - 1] = part
            words = {w.lower() for c in ("class", "id") for w in NAME.findall(attributes.get(c, ""))}
            if around > 1 and tag != "form" and words & NAMES <= AMBIGUOUS:
                self.ambiguous.add(len(self.apart) - 1)
        return len(self.parent) - 1

    def _read(self, html: str) -> None:
        #: open elements, the places in it of each tag, of all that are not inline, and of those that end an implied end's reach
        stack, where, blocks, scopes = [0], {}, [], []
        links, at, last = 0, 0, html.rfind(">") + 1

        def cut(place: int) -> None:
            nonlocal links
            for e in reversed(stack[place:]):
                tag = self.tag[e]
                where[tag].pop()
                links -= tag == "a"
                if tag not in INLINE:
                    blocks.pop()
                if tag in SCOPE:
                    scopes.pop()
            del stack[place:]

        while True:
            found = TAG.search(html, at, last) if at < last else None
            text = html[at:found.start() if found else len(html)]
            if not found:
                # a comment that never ends
                text = re.split(r"<!--|<!\[CDATA\[", text, maxsplit=1)[0]
            if text:
                if where.get("head") and not text.isspace():
                    cut(where["head"][-1])
                self.pieces.append((stack[-1], unescape(text), links > 0))
            if not found:
                return
            at = found.end()
            closing, tag, rest = (found[1], found[2], found[3]) if found[2] else (found[4], found[5], found[6])
            if not tag:
                if found[0].startswith("<!--") and not found[0].endswith("-->"):
                    return
                if found[0].startswith("<![CDATA["):
                    self.pieces.append((stack[-1], found[0][9:].removesuffix("]]>"), links > 0))
                continue
            tag = tag.lower()
            if tag not in INLINE:
                self.pieces.append((stack[-1], None, False))
            if closing:
                place = where[tag][-1] if where.get(tag) else 0
                # an inline element does not end outside of the block it is in
                if place and not (tag in INLINE and blocks and blocks[-1] > place):
                    cut(place)
                continue
            if tag not in HEAD and where.get("head"):
                # the end of the head may be left out
                cut(where["head"][-1])
            if tag in VOID:
                continue
            if tag in RAW:
                end = _raw_end(tag).search(html, at)
                gt = html.find(">", end.end()) if end else -1
                if gt < 0:
                    return
                at = gt + 1
                continue
            if tag not in INLINE or tag == "a":
                # an open paragraph ends where a block begins, a list entry where the next begins
                closes = (*CLOSES.get(tag, ()), "p") if tag not in INLINE else ("a",)
                while place := max((where[t][-1] for t in closes if where.get(t)), default=0):
                    if scopes and scopes[-1] > place:
                        break
                    ended = self.tag[stack[place]]
                    cut(place)
                    if ended != "td":
                        break
            attributes: dict[str, str] = {}
            for m in ATTRIBUTE.finditer(rest):
                attributes.setdefault(m[1].lower(), m[2] or m[3] or m[4] or "")
            if not rest.rstrip().endswith("/") or tag not in ("svg", "path"):
                where.setdefault(tag, []).append(len(stack))
                if tag not in INLINE:
                    blocks.append(len(stack))
                if tag in SCOPE:
                    scopes.append(len(stack))
                stack.append(self._open(tag, attributes, stack[-1]))
                links += tag == "a"

    def _sums(self, values: list[float]) -> list[float]:
        """Per element the sum over it and all in it; elements come after those they lie in."""
        out = values[:]
        for element in range(len(out) - 1, 0, -1):
            out[self.parent[element]] += out[element]
        return out

    def _prose(self) -> set[int]:
        """Elements of ambiguous names inside an article that hold its text: a paragraph, or much text, with hardly a link and no controls."""
        n = len(self.parent)
        free, linked, controls = [0.0] * n, [0.0] * n, [0.0] * n
        for e, text, link in self.pieces:
            if text:
                (controls if self.apart[e] else linked if link else free)[e] += len(" ".join(text.split()))
        for e in range(1, n):
            controls[e] += self.tag[e] in ("form", "button", "select", "textarea")
        free, linked, controls = self._sums(free), self._sums(linked), self._sums(controls)
        return {e for e in self.ambiguous if free[e] >= (1 if self.tag[e] == "p" else PROSE) and linked[e] * 10 <= free[e] and not controls[e]}

    def _set_named_apart(self) -> None:
        n = len(self.parent)
        comments, covered = [False] * n, [False] * n
        for e in range(1, n):
            comments[e] = comments[self.parent[e]] or self.named.get(e) == NEVER
            covered[e] = covered[self.parent[e]] or self.tag[self.parent[e]] in ("article", "main")
        own = [0.0] * n
        for e, text, link in self.pieces:
            if text and not link and not self.apart[e] and not comments[e]:
                own[e] += len(" ".join(text.split()))
        sizes = self._sums(own)
        prose = self._prose() if self.ambiguous else set()
        articles = [e for e in range(1, n) if self.tag[e] == "article" and not (covered[e] or self.apart[e] or e in self.named)]
        wrapped = [e for e in range(1, n) if self.tag[e] == "main" and not (covered[e] or self.apart[e])]
        longest = max((sizes[e] for e in articles), default=0.0)
        wrapped += [e for e in articles if sizes[e] == longest and longest > sizes[0] / 4]
        wrappers = {e for e, part in self.named.items() if sizes[e] > part * sizes[0]} | prose
        seen = set()
        for e in wrapped:
            while e > 0 and e not in seen:
                seen.add(e)
                e = self.parent[e]
                wrappers.add(e)
        apart = self.apart[:]
        for e in range(1, n):
            apart[e] = apart[e] or apart[self.parent[e]] or (e in self.named and e not in wrappers)
        if any(text and not link and not apart[e] and not text.isspace() for e, text, link in self.pieces):
            self.apart = apart

    def scores(self) -> dict[int, float]:
        """path -> the best score of a container on it."""
        own: dict[int, float] = {}
        for element, text, link in self.pieces:
            if text and not link and not self.apart[element]:
                size = len(" ".join(text.split()))
                if size:
                    own[element] = own.get(element, 0.0) + size
        total: dict[int, float] = {}
        # elements come after those they lie in; what reaches a container goes on to the next one a tenth smaller
        value = [0.0] * len(self.parent)
        for element, size in own.items():
            value[element] = size
        for element in range(len(value) - 1, 0, -1):
            if size := value[element]:
                if self.tag[element] in CONTAINERS:
                    total[element] = size
                    size *= 0.9
                value[self.parent[element]] += size
        best: dict[int, float] = {}
        for element, score in total.items():
            tag = self.tag[element]
            score *= 1.4 if tag == "article" else 1.2 if tag == "main" else 0.5 if tag == "body" else 1.0
            best[self.path[element]] = max(best.get(self.path[element], 0.0), score)
        return best

    def _climbed(self, path: int) -> list[int]:
        """The containers on a path, or those around them that add only text of the article."""
        n = len(self.parent)
        above = [0] * n
        for e in range(1, n):
            up = self.parent[e]
            above[e] = up if self.tag[up] in CONTAINERS else above[up]
        roots = [e for e in range(1, n) if self.path[e] == path and self.tag[e] in CONTAINERS and not self.apart[e]]
        around = {above[e] for e in roots if self.tag[e] not in ("article", "main")} - {0}
        if not around:
            return roots
        free, linked, direct = [0.0] * n, [0.0] * n, [0.0] * n
        for e, text, link in self.pieces:
            if text and not self.apart[e]:
                size = len(" ".join(text.split()))
                (linked if link else free)[e] += size
                direct[e if self.tag[e] in CONTAINERS else above[e]] += 0 if link else size
        free, linked = self._sums(free), self._sums(linked)
        titles = self._sums([float(tag == "h1" and not apart) for tag, apart in zip(self.tag, self.apart)])
        last = list(range(n))
        for e in range(n - 1, 0, -1):
            last[self.parent[e]] = max(last[self.parent[e]], last[e])
        while around:
            up = max(around)
            around.discard(up)
            # elements are numbered in page order, so those in one follow it; roots don't lie in each other
            low, high = bisect_left(roots, up), bisect_right(roots, last[up])
            within = roots[low:high]
            if up in within or self.apart[up]:
                continue
            text, links = free[up] - sum(free[e] for e in within), linked[up] - sum(linked[e] for e in within)
            titled = titles[up] > 0 and not sum(titles[e] for e in within)
            if links * 3 <= text and (text <= direct[up] or titled):
                roots[low:high] = [up]
                if self.tag[up] not in ("article", "main") and above[up]:
                    around.add(above[up])
        return roots

    def text(self, path: int | None) -> str:
        """The text in the containers on a path and around them (None: of the whole page)."""
        roots = set() if path is None else set(self._climbed(path))
        within = [path is None]
        for element in range(1, len(self.parent)):
            within.append(within[self.parent[element]] or element in roots)
        out = [" " if text is None else text for element, text, _ in self.pieces
               if text is None or (within[element] and not self.apart[element])]
        return " ".join("".join(out).split())


def main_text(html: str, agreed: int | None) -> str:
    page = Page(html)
    if agreed is not None:
        text = page.text(agreed)
        if text:
            return text
    scores = page.scores()
    return page.text(max(scores, key=lambda p: (scores[p], p)) if scores else None)


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, path): the path that has most votes of each host."""
    source = pages.select(host_of(url_col).alias("host"), F.col(f"`{html_col}`").cast("binary").alias("raw"))

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "raw"):
            votes: dict[tuple[str, int], int] = {}
            for host, raw in zip(piece.column("host").to_pylist(), piece.column("raw").to_pylist()):
                scores = Page((raw or b"").decode("utf-8", "replace")).scores()
                best = max(scores.values(), default=0.0)
                for path, score in scores.items():
                    votes[host, path] = votes.get((host, path), 0) + int(VOTE * score / best)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in votes], pa.string()), pa.array([k[1] for k in votes], pa.int64()),
                                              pa.array(list(votes.values()), pa.int64())], ["host", "path", "votes"])

    votes = source.mapInArrow(vote, "host string, path bigint, votes bigint").groupBy("host", "path").agg(F.sum("votes").alias("votes"))
    return votes.groupBy("host").agg(F.max_by("path", F.struct("votes", "path")).alias("path"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text): the main text of every row."""
    winners = written(host_paths(pages, url_col, html_col), "host-paths")
    if winners.limit(FEW_HOSTS + 1).count() <= FEW_HOSTS:
        winners = F.broadcast(winners)
    source = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                          F.col(f"`{html_col}`").cast("binary").alias("raw"), host_of(url_col).alias("host"))
    id_type = dict(source.dtypes)["id"]
    joined = source.join(winners, "host", "left").select("id", "url", "raw", "path")

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "raw"):
            texts = [main_text((raw or b"").decode("utf-8", "replace"), path)
                     for raw, path in zip(piece.column("raw").to_pylist(), piece.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])

    return joined.mapInArrow(take, f"id {id_type}, url string, text string")
