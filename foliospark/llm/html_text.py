"""HTML extraction by composite text density (link-adjusted characters per tag, density sums, body-path threshold)."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of HTML elements, and words in class, id or role that mark what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript iframe noembed noframes xmp template svg annotation annotation-xml".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr caption ul".split())
CLOSES_P = BLOCK - frozenset("body head html li dd dt tr tbody thead tfoot caption legend option optgroup".split())
NOISE = frozenset("nav header footer aside button select input dialog menu object embed canvas audio video map head fieldset".split()) | RAW
NOISE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist complementary contentinfo cookie cookies consent disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion related respond search share sharing sidebar social sponsor sponsored subscribe toolbar widget widgets".split()
)
COMMENTS = "comments? commentaires? comentarios? kommentare? replies responses discussion réponses respuestas antworten".split()
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
ENDS_BEFORE = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}}
SCOPES = frozenset("table ul ol dl select article section div main aside nav form body html blockquote button td th".split())

_TOKEN = re.compile(r"<!--(?:.*?--!?>|.*\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)(?:>|\Z)|</[^>]*+(?:>|\Z)", re.S)
_MARKING = re.compile(r"(?:^|[\s\"'/])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|[\s\"'/])hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORDS = re.compile(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])")
_FOR = re.compile(r"(?:^|[\s\"'/])for\s*=", re.I)
_COMMENTS = re.compile(rf"\W*(?:\d+\W+)?(?:{'|'.join(COMMENTS)})\W*\d*\W*", re.I)
#: Words in a block that make it running text; a branch with a greater share of links isn't.
RUNNING_WORDS, LINK_SHARE = 5, 0.4


class Page:
    """Nodes of a page in document order (a node comes after its parent), and its texts as (node, block, text)."""

    def __init__(self, source: str):
        self.tag, self.parent, self.noise, self.texts = ["body"], [-1], [False], []
        self.titled: set[int] = set()  # headers of articles, whose headings are titles
        doubtful: list[int] = []
        stack, block, at = [0], 0, 0
        end = len(source)
        while at < end:
            m = _TOKEN.search(source, at)
            stop = m.start() if m else end
            if stop > at:
                self.texts.append((stack[-1], block, html.unescape(source[at:stop])))
            if m is None:
                break
            at = m.end()
            closing, name, attrs = m.group(1), m.group(2), m.group(3)
            if name is None:
                continue
            name = name.lower()
            if closing:
                depth = next((d for d in range(len(stack) - 1, 0, -1) if self.tag[stack[d]] == name), 0)
                if depth:
                    if any(self.tag[x] in BLOCK for x in stack[depth:]):
                        block += 1
                    del stack[depth:]
                continue
            if name in ("html", "body"):
                continue
            if name == "br":
                self.texts.append((stack[-1], block, " "))
            if name in CLOSES_P or name in ENDS_BEFORE:
                self._imply(stack, {"p"} if name in CLOSES_P else ENDS_BEFORE[name])
            if name in BLOCK:
                block += 1
            elif name in ("td", "th"):
                self.texts.append((stack[-1], block, " "))
            self.tag.append(name)
            self.parent.append(stack[-1])
            mark = 0 if name in ("article", "main") else self._marked(attrs)
            if name == "form" or name == "label" and (_FOR.search(attrs) or any(self.tag[x] == "form" for x in stack)):
                mark = max(mark, 1 if name == "form" else 2)
            self.noise.append(name in NOISE or mark > 0)
            if mark == 1 and name not in NOISE:
                doubtful.append(len(self.tag) - 1)
            if name == "header" and not mark and any(self.tag[x] == "article" for x in stack):
                self.titled.add(len(self.tag) - 1)
            if name in RAW:
                over = re.compile(rf"</{name}(?=[\s/>])", re.I).search(source, at)
                at = over.start() if over else end
                if over:
                    at = (_TOKEN.match(source, at) or over).end()
                if name in ("noscript", "template", "iframe", "svg", "math", "noframes", "noembed"):
                    block += name in BLOCK
                continue
            if name not in VOID and not (attrs.endswith("/") and name not in BLOCK):
                stack.append(len(self.tag) - 1)
        self._settle(doubtful)

    def _settle(self, doubtful: list[int]) -> None:
        """Forms, and noise words that are a part of a class, id or role only ('has-sidebar'), don't count for elements that hold an article or main element or most of the text outside links and noise; then noise goes down to all descendants, but not from an article's header to the headings in it."""
        if doubtful:
            n, maybe = len(self.tag), set(doubtful)
            sure = [self.noise[i] and i not in maybe for i in range(n)]
            held, chars = [t in ("article", "main") for t in self.tag], [0] * n
            for i in range(1, n):
                sure[i] |= sure[self.parent[i]]
            for node, _, text in self.texts:
                if not sure[node] and self.tag[node] != "a":
                    chars[node] += len("".join(text.split()))
            for i in range(n - 1, 0, -1):
                chars[self.parent[i]] += chars[i]
                held[self.parent[i]] |= held[i]
            for i in doubtful:
                self.noise[i] = not (held[i] or 2 * chars[i] > chars[0])
        heads: set[int] = set()  # headers of articles, and what is in them outside headings
        for i in range(1, len(self.tag)):
            p = self.parent[i]
            if i in self.titled and not self.noise[p]:
                heads.add(i)
            elif p in heads:
                if not self.noise[i] and self.tag[i] not in HEADINGS:
                    heads.add(i)
                    self.noise[i] = True
            else:
                self.noise[i] |= self.noise[p]
        self._drop_comments()

    def _drop_comments(self) -> None:
        """A heading that only says that comments follow, and what follows it in the same element, is noise."""
        said: dict[int, list[str]] = {}
        for node, _, text in self.texts:
            while node and self.tag[node] not in HEADINGS:
                node = self.parent[node]
            if node:
                said.setdefault(node, []).append(text)
        begun: set[int] = set()  # elements whose further children are comments
        for i in range(1, len(self.tag)):
            if i in said and _COMMENTS.fullmatch(" ".join("".join(said[i]).split())):
                begun.add(self.parent[i])
            if self.parent[i] in begun:
                self.noise[i] = True
                begun.add(i)

    def _imply(self, stack: list[int], ends: set[str]) -> None:
        """Closes the open element of `ends` nearest to the top, unless a scope lies between."""
        for d in range(len(stack) - 1, 0, -1):
            name = self.tag[stack[d]]
            if name in ends:
                if ends != {"p"} and len(ends) > 1:  # a row ends its cell and the row
                    while d > 1 and self.tag[stack[d - 1]] in ends:
                        d -= 1
                del stack[d:]
                return
            if name in SCOPES:
                return

    @staticmethod
    def _marked(attrs: str) -> int:
        """2: hidden, or a class, id or role is a noise word; 1: a noise word is a part of one; 0: neither."""
        if not attrs:
            return 0
        if _HIDDEN.search(attrs):
            return 2
        names = [x for m in _MARKING.finditer(attrs) for x in (m.group(1) or m.group(2) or m.group(3) or "").split()]
        if any(x.lower() in NOISE_WORDS for x in names):
            return 2
        return int(any(w.lower() in NOISE_WORDS for x in names for w in _WORDS.split(x)))

    def measure(self) -> None:
        """Characters, tags, characters and tags of links, density, and density sum of every node; noise counts nothing."""
        n = len(self.tag)
        own, self.chars, self.tags, self.links, link_tags = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
        links = self.links
        for node, _, text in self.texts:
            if not self.noise[node]:
                own[node] += len("".join(text.split()))
        for i in range(n):
            self.chars[i] = own[i]
        self.last = list(range(n))
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.last[p] = max(self.last[p], self.last[i])
            if self.noise[i]:
                continue
            is_link = self.tag[i] == "a"
            if is_link:
                links[i], link_tags[i] = self.chars[i], link_tags[i] + 1
            self.chars[p] += self.chars[i]
            self.tags[p] += self.tags[i] + 1
            links[p] += links[i]
            link_tags[p] += link_tags[i]
        #: Blocks of links only, three at least: menus that no tag or class marks.
        self.menu = [self.tag[i] in BLOCK and self.tag[i] != "body" and link_tags[i] >= 3 and links[i] >= 0.8 * self.chars[i] for i in range(n)]
        for i in range(1, n):
            self.menu[i] |= self.menu[self.parent[i]]
        share = links[0] / self.chars[0] if self.chars[0] else 0.0
        self.density = [0.0] * n
        self.total = [float(x) for x in own]  # a node's own text is like a child without tags
        for i in range(n - 1, -1, -1):
            c = self.chars[i]
            if c and not self.noise[i]:
                lc, plain = links[i], max(1, c - links[i])
                base = math.log(c / plain * lc + share * c + math.e)
                self.density[i] = c / max(1, self.tags[i]) * max(0.0, math.log(c / max(1, lc) * max(1, self.tags[i]) / max(1, link_tags[i]))) / math.log(base) if base > math.e else c / max(1, self.tags[i]) * max(1.0, math.log(max(c, 1)))
            if i:
                self.total[self.parent[i]] += self.density[i]

    def path(self, node: int) -> list[int]:
        """From a node up to the body."""
        out = [node]
        while out[-1]:
            out.append(self.parent[out[-1]])
        return out

    def _runs(self) -> list[bool]:
        """Whether a node has running text in it: a paragraph, or a block of some words, that isn't noise, a menu or mostly links."""
        words: dict[int, int] = {}
        runs = [False] * len(self.tag)
        for node, block, text in self.texts:
            if not self.noise[node] and not self.menu[node] and self.tag[node] != "a":
                words[block] = words.get(block, 0) + len(text.split())
        for node, block, text in self.texts:
            if not self.noise[node] and not self.menu[node] and text.strip():
                at, in_p = node, False
                while at and not in_p:
                    in_p, at = self.tag[at] in ("p", "pre", "blockquote"), self.parent[at]
                runs[node] |= in_p or words.get(block, 0) >= RUNNING_WORDS
        for i in range(len(self.tag) - 1, 0, -1):
            runs[self.parent[i]] |= runs[i] and not self.noise[i]
        return [r and links <= LINK_SHARE * max(1, chars) for r, links, chars in zip(runs, self.links, self.chars, strict=True)]

    def root(self) -> int:
        """The node whose subtree is the article.

        The node of the greatest density sum in the body begins it. From there up to the highest node below
        the body, and within the nearest article or main element if there is one, that has a further branch
        with running text, however short; and to the highest node at all that has a further branch as dense as
        the least dense node between the body and the maximum, or a heading ahead of the branch that leads
        down (a title block). Above an article element only other articles and headings ahead of it count.
        """
        self.measure()
        best = max((i for i in range(len(self.tag)) if not self.noise[i]), key=lambda i: (self.total[i], -i), default=0)
        if best:  # lists of links that follow text within the densest node are text too
            begun = next((node for node, _, text in self.texts if best <= node <= self.last[best] and not self.noise[node] and not self.menu[node] and text.strip()), self.last[best])
            self.menu[begun : self.last[best] + 1] = [False] * (self.last[best] + 1 - begun)
        up = self.path(best)
        threshold = min(self.density[i] for i in up)
        children: dict[int, list[int]] = {}
        for i in range(1, len(self.tag)):
            children.setdefault(self.parent[i], []).append(i)
        runs, top, bounded, in_article = self._runs(), up[0], self.tag[best] in ("article", "main"), self.tag[best] == "article"
        for child, node in zip(up, up[1:], strict=False):
            others = [c for c in children[node] if c != child and not self.noise[c] and not self.menu[c] and self.chars[c]]
            dense = [c for c in others if self.density[c] >= threshold and (not in_article or self.tag[c] == "article")]
            title = any(c < child and self.tag[c] in HEADINGS for c in others)
            more = not bounded and any(runs[c] and (node or self.tag[c] == self.tag[child] == "section") for c in others)
            if dense or title or more or self.tag[top] not in BLOCK:
                top = node
            if self.tag[node] == "article":
                top = node
                in_article = True
            bounded |= self.tag[node] in ("article", "main")
        return top


def main_text(source: str | None) -> str:
    """The article of a page: its blocks, white space made single spaces, joined by empty lines. Null, empty, or without text: ''."""
    if not source:
        return ""
    page = Page(source)
    root = page.root()
    blocks: list[list] = []
    for node, block, text in page.texts:
        if root <= node <= page.last[root] and not page.noise[node] and not page.menu[node]:
            if blocks and blocks[-1][0] == block:
                blocks[-1][1].append(text)
            else:
                blocks.append([block, [text]])
    lines = (" ".join("".join(parts).split()) for _, parts in blocks)
    return "\n\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) for every row of pages(page_id, url, html, ...).

    Null html is empty. Null page_id or url come back null. Repeated rows: a row each. Equal density
    sums: the first node. Empty table: no rows. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    out = pages.select(pages["page_id"].cast("bigint"), pages["url"].cast("string"), pages["html"].cast("string"))
    return out.mapInArrow(run, "page_id bigint, url string, text string").withColumn("n_chars", F.length("text").cast("bigint"))
