"""Main texts of web pages, by paths on which the pages of a host agree.

Each page's containers are scored by the running text under them. The paths of the best, as tags and
classes with their numbers taken out, are votes, added up per host in Spark; then every page is read
again and gives the text under the most voted path of its host that it has.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import met, slices, written

#: A path needs this share of its host's votes; a page's votes are one in all, so a host has at most 1 / SHARE paths.
SHARE = 0.1
#: Up to so many hosts their paths are broadcast; beyond it only those of hosts that hold over a thousandth of the pages.
FEW_HOSTS = 20_000
#: What a container passes on of its score to the one around it, and the least share of the best that still votes.
PASSED, NEAR_BEST = 0.6, 0.8
#: A list of three links or more, this share of it links, is a menu unless an article holds it.
MENU_LINKS = 0.9

# Element names of HTML and words by which pages name what is no main text.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("html body main article section div td center blockquote dd".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = HEADINGS | frozenset("p pre blockquote ul ol li dl dt dd figure figcaption table thead tbody tfoot tr td th hgroup".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
DROPPED = frozenset("aside audio button canvas dialog footer form head menu nav noscript object search select svg template video".split())
NEVER_CLOSED = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}}
BOILERPLATE = frozenset(
    "ad ads adsense adslot adv advert advertisement adverts alert banner breadcrumb breadcrumbs comment commentlist comments consent cookie cookies disqus footer gdpr menu modal nav navbar "
    "navigation newsletter notice notices overlay pagination pager popup promo promoted promotion recommended related reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget widgets".split()
)
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())

_TAG = re.compile(r"<(?:!--.*?(?:-->|\Z)|(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+)(?:>|\Z)|[!?/][^>]*(?:>|\Z))", re.S)
_ATTR = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_CLASS = re.compile(r"[A-Za-z][\w-]*\Z")


class Page:
    """A page's elements (parents before children) and blocks of text, with white space made one space.

    ``drop``: 2 for what is never main text, 1 for headers, of which an article keeps headings.
    """

    def __init__(self, source: str) -> None:
        self.tag, self.parent, self.drop, self.path, self.names = ["html"], [-1], [0], [0], [""]
        self.blocks: list[tuple[int, str, int]] = []  # (element, text, characters of links)
        self._paths: dict[tuple[int, str], int] = {}
        self._read(source)

    def _read(self, s: str) -> None:
        stack, opened = [0], {"html": [0]}  # where in the stack each open tag is
        parts: list[str] = []
        links: list[int] = []
        in_link, at = False, 0

        def say(text: str) -> None:
            if text:
                parts.append(html.unescape(text) if "&" in text else text)
                if in_link:
                    links.append(len(parts) - 1)

        def flush() -> None:
            if parts:
                text = " ".join("".join(parts).split())
                if text:
                    self.blocks.append((stack[-1], text, sum(len("".join(parts[i].split())) for i in links)))
                parts.clear()
                links.clear()

        def close(n: int) -> None:
            while len(stack) > n:
                opened[self.tag[stack.pop()]].pop()

        find = _TAG.search
        while m := find(s, at):
            say(s[at : m.start()])
            at = m.end()
            if not (name := m["name"]):
                continue
            name = name.lower()
            if m["end"]:
                if name == "a":
                    in_link = False
                elif name == "br":
                    say(" ")
                elif name in BLOCKS or name in DROPPED:
                    flush()
                    in_link = False
                    own = opened.get(name)
                    cell = max((opened[t][-1] for t in ("td", "th") if opened.get(t)), default=0)
                    if own and own[-1] > 0 and (own[-1] >= cell or name in ("table", "tr", "tbody", "thead", "tfoot", "body")):
                        close(own[-1])
                continue
            if name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(s, at)
                at = end.start() if end else len(s)
            elif name == "a":
                in_link = True
            elif name == "br" or name == "hr" or name == "img":
                say(" ")
                if name == "hr":
                    flush()
            elif (name in BLOCKS or name in DROPPED) and name not in ("html", "body") or name == "body" and not opened.get("body"):
                flush()
                in_link = False
                if name != "head" and opened.get("head"):
                    close(opened["head"][-1])
                if opened.get("p") and name in BLOCKS:
                    close(opened["p"][-1])
                if shut := CLOSED_BY.get(name):
                    scope = max((opened[t][-1] for t in SCOPES.get(name, ()) if opened.get(t)), default=0)
                    inner = [opened[t][-1] for t in shut if opened.get(t) and opened[t][-1] > scope]
                    if inner:
                        close(min(inner))
                opened.setdefault(name, []).append(len(stack))
                self._add(name, stack[-1], m["attrs"])
                stack.append(len(self.tag) - 1)
            elif name not in NEVER_CLOSED and ("class" in m["attrs"] or "hidden" in m["attrs"]) and self._dropped(name, dict(self._attributes(m["attrs"]))) == 2:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(s, at)  # an inline element that is hidden or an advert
                at = end.start() if end and not re.search(r"<(?:p|div|/p|/div|/article|li|/li)\b", s[at : end.start()], re.I) else at
        say(s[at:])
        flush()

    @staticmethod
    def _attributes(text: str) -> Iterator[tuple[str, str]]:
        for m in _ATTR.finditer(text):
            yield m[1].lower(), html.unescape(m[2] or m[3] or m[4] or "")

    @staticmethod
    def _dropped(tag: str, a: dict[str, str]) -> int:
        if tag in DROPPED or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
            return 2
        if tag in ("html", "body", "main"):
            return 0
        said = {w.lower() for w in _WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")}
        if tag == "article":
            return 2 if said & {"comment", "comments"} else 0
        if said & BOILERPLATE or a.get("role", "").lower() in ROLES:
            return 2
        return 1 if tag == "header" or "header" in said and tag not in HEADINGS else 0

    def _add(self, tag: str, parent: int, attrs: str) -> None:
        a = dict(self._attributes(attrs)) if attrs and attrs != "/" else {}
        names = sorted({re.sub(r"\d+", "#", c) for c in a.get("class", "").split() if _CLASS.match(c) and len(re.findall(r"\d+", c)) < 2})
        key = (self.path[parent], ".".join([tag, *names]))
        if key not in self._paths:
            self._paths[key] = len(self.names)
            self.names.append(key[1])
        self.tag.append(tag)
        self.parent.append(parent)
        self.drop.append(max(self._dropped(tag, a), self.drop[parent]))
        self.path.append(self._paths[key])

    def scores(self) -> dict[int, float]:
        """Container element -> score: characters of running text under it, less the further down they are."""
        score = [0.0] * len(self.tag)
        for e, text, linked in self.blocks:
            if not self.drop[e]:
                score[e] += max(len(text) - 2 * linked, 0)
        for e in range(len(self.tag) - 1, 0, -1):
            score[self.parent[e]] += score[e] * (1 if self.tag[e] in PARAGRAPHS else PASSED)
        more = {"article": 1.5, "main": 1.2}
        return {e: score[e] * more.get(self.tag[e], 1) for e in range(len(self.tag)) if self.tag[e] in CONTAINERS and score[e] > 0}

    def spelled(self, e: int) -> str:
        out = []
        while e > 0:
            out.append(self.names[self.path[e]])
            e = self.parent[e]
        return ">".join(reversed(out))

    def found(self, path: str) -> int | None:
        """The number of a path here, if the page has it."""
        at: int | None = 0
        for name in path.split(">") if path else ():
            at = self._paths.get((at, name))
            if at is None:
                return None
        return at

    def votes(self) -> list[tuple[str, float]]:
        """(path, weight) of the best containers, weights one in all."""
        scores = self.scores()
        best = max(scores.values(), default=0)
        near: dict[str, float] = {}
        for e, x in scores.items():
            if x >= NEAR_BEST * best:
                p = self.spelled(e)
                near[p] = max(near.get(p, 0), x)
        return [(p, x / sum(near.values())) for p, x in near.items()]

    def text(self, path: int, only: int | None = None) -> str:
        """The blocks under the elements of a path, or under ``only``, without what is no main text."""
        inside, drop = [False] * len(self.tag), [0] * len(self.tag)
        chosen = lambda e: e == only if only is not None else self.path[e] == path
        plain = False
        menus = self._menus()
        for e in range(len(self.tag)):
            up = self.parent[e]
            if e and inside[up]:
                own = 0 if self.drop[e] == self.drop[up] else self.drop[e]
                inside[e], drop[e] = True, max(drop[up], own, 2 if plain and e in menus else 0)
            elif chosen(e):
                inside[e] = True
                plain = self.tag[e] not in ("article", "main")
        bare = any(self.tag[e] in ("html", "body") for e in range(len(self.tag)) if chosen(e))
        keeps = lambda e: inside[e] and (drop[e] == 0 or drop[e] == 1 and not bare and self.tag[e] in HEADINGS)
        return "\n".join(text for e, text, _ in self.blocks if keeps(e))

    def _menus(self) -> set[int]:
        items, size, linked = [0] * len(self.tag), [0] * len(self.tag), [0] * len(self.tag)
        for e, text, links in self.blocks:
            size[e] += len("".join(text.split()))
            linked[e] += links
        for e in range(len(self.tag) - 1, 0, -1):
            up = self.parent[e]
            size[up] += size[e]
            linked[up] += linked[e]
            items[up] += self.tag[e] == "li"
        return {e for e, t in enumerate(self.tag) if t in ("ul", "ol") and items[e] > 2 and linked[e] >= MENU_LINKS * size[e]}


def main_text(source: str | None, paths: list[tuple[float, str]]) -> str:
    """The main text of a page whose host voted for ``paths`` (votes, path), best first."""
    if not source:
        return ""
    page = Page(source)
    for _, path in paths:
        if (at := page.found(path)) is not None and (text := page.text(at)):
            return text
    scores = page.scores()
    best = max(scores, key=lambda e: scores[e], default=None)
    return page.text(0, only=best) if best is not None else ""


def with_host(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, host): the url's host in lower case, empty without one."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return pages.select("page_id", "url", "html", F.coalesce(host, F.lit("")).alias("host"))


def host_paths(pages: DataFrame) -> DataFrame:
    """(host, n, paths): every host's number of pages and its paths with their votes, best first.

    Votes of a path are summed within tasks before they are shuffled, so a host of a third of the
    pages is no group of its pages. Pages without a host don't vote.
    """

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(h, p, v) for h, s in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True) if h for p, v in Page(s or "").votes()]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64())], names=["host", "path", "vote"])

    rows = with_host(pages)
    counts = rows.groupBy("host").agg(F.count("*").alias("n"))
    # Rounded, as the order of a sum of doubles may change from run to run.
    votes = rows.select("host", "html").mapInArrow(go, "host string, path string, vote double").groupBy("host", "path").agg(F.round(F.sum("vote"), 6).alias("votes"))
    held = met(votes, counts, "host", "n").where(F.col("votes") >= SHARE * F.col("n"))
    best = held.groupBy("host").agg(F.reverse(F.array_sort(F.collect_list(F.struct("votes", "path")))).alias("paths"))
    return counts.join(best, "host", "left")


def extracted(pages: DataFrame, few_hosts: int = FEW_HOSTS) -> DataFrame:
    """(page_id, url, text): the main text of every page.

    ``pages``: page_id, url, html; other columns are ignored, rows with one id or url give a row each.
    A null html is empty and gives an empty text, as does a page without running text. A page without
    a host, or with none of its host's paths, gives the text under its own best container. White space
    is what Unicode calls so, no-break spaces included. Very long pages are read whole.
    """
    paths = written(host_paths(pages))
    rows = with_host(pages)
    few = paths.limit(few_hosts + 1).count() <= few_hosts
    both = rows.join(F.broadcast(paths.drop("n")), "host") if few else met(rows, paths, "host", "n")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            paths = [[(p["votes"], p["path"]) for p in x or []] for x in b.column("paths").to_pylist()]
            texts = [main_text(s, p) for s, p in zip(b.column("html").to_pylist(), paths, strict=True)]
            yield pa.record_batch([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return both.select("page_id", "url", "html", "paths").mapInArrow(go, "page_id long, url string, text string")


def digest(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars): the main text of every page and its code points."""
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))
