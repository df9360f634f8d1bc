"""Markdown tables to HTML, and a small CommonMark subset to safe HTML."""

from __future__ import annotations

import html
import re
from html.parser import HTMLParser
from urllib.parse import quote, unquote, urlsplit

from .formulas import scan_spans
from .text import per_value

# What safe HTML may hold.
ALLOWED_TAGS = frozenset("a blockquote br code del em h1 h2 h3 h4 h5 h6 hr img li ol p pre strong sub sup table tbody td tfoot th thead tr ul".split())
ALLOWED_ATTRIBUTES = {"a": ("href", "title"), "img": ("src", "alt", "title"), "td": ("rowspan", "colspan"), "th": ("rowspan", "colspan")}
DROPPED_WITH_CONTENT = frozenset("script style iframe form object".split())
SCHEMES = ("http", "https")
# What a reader's math renderer is given, so that it shows the formulas that are scanned and validated here.
MATH_SETTINGS = {
    "delimiters": [{"left": "$$", "right": "$$", "display": True}, {"left": "$", "right": "$", "display": False}, {"left": "\\(", "right": "\\)", "display": False}, {"left": "\\[", "right": "\\]", "display": True}],
    "throwOnError": False, "trust": False, "maxSize": 20, "maxExpand": 500,
}
LINK_REL = "noopener noreferrer"
VOID = frozenset(("br", "hr", "img"))

_RULE = re.compile(r"\s*\|?\s*:?-+:?\s*(?:\|\s*:?-+:?\s*)*\|?\s*")


def _cells(line: str) -> list[str]:
    line = line.strip()
    line = line.removeprefix("|")
    if line.endswith("|") and not line.endswith("\\|"):
        line = line[:-1]
    return [c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", line)]


def table_to_html(source: str) -> str | None:
    """A pipe table (header, rule, rows) as HTML, row cells cut or filled up to the header's number; null if the text is anything else."""
    lines = source.strip().split("\n")
    if len(lines) < 2 or "|" not in lines[0] or not _RULE.fullmatch(lines[1]) or any(not x.strip() for x in lines):
        return None
    head, rule = _cells(lines[0]), _cells(lines[1])
    if len(head) != len(rule):
        return None
    align = [("center" if c[-1:] == ":" else "left") if c[:1] == ":" else "right" if c[-1:] == ":" else None for c in rule]

    def row(tag: str, cells: list[str]) -> str:
        style = lambda a: f' style="text-align:{a}"' if a else ""
        padded = (cells + [""] * len(head))[: len(head)]
        return "<tr>\n" + "".join(f"<{tag}{style(a)}>{_inline(c)}</{tag}>\n" for c, a in zip(padded, align, strict=True)) + "</tr>\n"

    body = "".join(row("td", _cells(x)) for x in lines[2:])
    return f"<table>\n<thead>\n{row('th', head)}</thead>\n" + (f"<tbody>\n{body}</tbody>\n" if body else "") + "</table>"


markdown_table = per_value(table_to_html, "string")


def _inline(text: str) -> str:
    """Code, images, links, strong, emphasis and line breaks; HTML tags pass, other markup is escaped."""
    kept: list[str] = []

    def keep(value: str) -> str:
        kept.append(value)
        return f"\x00{len(kept) - 1}\x00"

    text = text.replace("\x00", "\ufffd")
    text = re.sub(r"(`+)(.+?)(?<!`)\1(?!`)", lambda m: keep(f"<code>{html.escape(m[2].strip())}</code>"), text, flags=re.S)
    text = re.sub(r"\\([!-/:-@\[-`{-~])", lambda m: keep(html.escape(m[1])), text)
    text = re.sub(r"<!--.*?-->|</?[A-Za-z][^<>]*>", lambda m: keep(m[0]), text, flags=re.S)
    text = re.sub(r"!\[([^\]]*)\]\(\s*<?([^\s)>]*)>?\s*\)", lambda m: keep(f'<img src="{html.escape(m[2])}" alt="{html.escape(m[1])}" />'), text)
    text = re.sub(r"\[([^\]]+)\]\(\s*<?([^\s)>]*)>?\s*\)", lambda m: keep(f'<a href="{html.escape(m[2])}">') + m[1] + keep("</a>"), text)
    text = re.sub(r"&(?!#?\w+;)", "&amp;", text).replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    text = re.sub(r"\*\*(?=\S)(.+?)(?<=\S)\*\*", r"<strong>\1</strong>", text, flags=re.S)
    text = re.sub(r"\*(?=\S)(.+?)(?<=\S)\*", r"<em>\1</em>", text, flags=re.S)
    text = re.sub(r"(?: {2,}|\\)\n", "<br />\n", text)
    while re.search(r"\x00\d+\x00", text):
        text = re.sub(r"\x00(\d+)\x00", lambda m: kept[int(m[1])], text)
    return text


_HEADING = re.compile(r" {0,3}(#{1,6})(?:\s+(.*?))?(?:\s+#+)?\s*")
_BREAK = re.compile(r" {0,3}(?:(?:\*\s*){3,}|(?:-\s*){3,}|(?:_\s*){3,})")
_FENCE = re.compile(r" {0,3}(```+|~~~+)(.*)")
_ITEM = re.compile(r" {0,3}(?:([-*+])|(\d{1,9})[.)])\s+(.*)")
_HTML_START = re.compile(r" {0,3}</?(?:address|article|aside|blockquote|body|caption|center|col|colgroup|dd|details|dir|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|iframe|legend|li|link|main|menu|nav|ol|option|p|pre|script|section|style|summary|table|tbody|td|tfoot|th|thead|title|tr|ul)(?:[\s/>]|$)| {0,3}<(?:!--|![A-Za-z]|\?)", re.I)


def to_html(source: str) -> str:
    """Headings, rules, fenced code, quotes, flat lists, HTML blocks (up to an empty line) and paragraphs."""
    lines, out, i = source.split("\n"), [], 0
    while i < len(lines):
        line = lines[i]
        if not line.strip():
            i += 1
        elif m := _FENCE.fullmatch(line):
            end = next((j for j in range(i + 1, len(lines)) if lines[j].strip().startswith(m[1]) and not lines[j].strip().strip(m[1][0])), len(lines))
            out.append("<pre><code>" + html.escape("".join(x + "\n" for x in lines[i + 1 : end])) + "</code></pre>")
            i = end + 1
        elif m := _HEADING.fullmatch(line):
            out.append(f"<h{len(m[1])}>{_inline((m[2] or '').strip())}</h{len(m[1])}>")
            i += 1
        elif _BREAK.fullmatch(line):
            out.append("<hr />")
            i += 1
        elif _HTML_START.match(line):
            j = next((j for j in range(i, len(lines)) if not lines[j].strip()), len(lines))
            out.append("\n".join(lines[i:j]))
            i = j
        elif line.lstrip().startswith(">"):
            j = next((j for j in range(i, len(lines)) if not lines[j].lstrip().startswith(">")), len(lines))
            out.append("<blockquote>\n" + to_html("\n".join(re.sub(r"^\s*> ?", "", x) for x in lines[i:j])) + "</blockquote>")
            i = j
        elif m := _ITEM.fullmatch(line):
            ordered, items = m[2] is not None, []
            while i < len(lines) and (m := _ITEM.fullmatch(lines[i])) and (m[2] is not None) == ordered:
                items.append(m[3])
                i += 1
                while i < len(lines) and lines[i].strip() and not _ITEM.fullmatch(lines[i]):
                    items[-1] += "\n" + lines[i].strip()
                    i += 1
            tag = "ol" if ordered else "ul"
            out.append(f"<{tag}>\n" + "".join(f"<li>{_inline(x)}</li>\n" for x in items) + f"</{tag}>")
        else:
            j = i + 1
            while j < len(lines) and lines[j].strip() and not (_HEADING.fullmatch(lines[j]) or _FENCE.fullmatch(lines[j]) or _BREAK.fullmatch(lines[j]) or _HTML_START.match(lines[j]) or lines[j].lstrip().startswith(">")):
                j += 1
            out.append(f"<p>{_inline(chr(10).join(x.lstrip() for x in lines[i:j]).rstrip())}</p>")
            i = j
    return "".join(x + "\n" for x in out)


def safe_url(url: str, base: str) -> str | None:
    """http and https urls as they are; relative ones under base; absolute paths, parent folders and other schemes dropped."""
    try:
        parts = urlsplit(url.strip())
    except ValueError:
        return None
    if parts.scheme or parts.netloc:
        return url if parts.scheme in SCHEMES else None
    path = unquote(parts.path)
    names = [p for p in path.split("/") if p not in ("", ".")]
    if path.startswith("/") or ".." in names or not names:
        return None
    return "/".join([base.rstrip("/"), *(quote(p, safe="") for p in names)])


class _Cleaner(HTMLParser):
    def __init__(self, base: str):
        super().__init__(convert_charrefs=True)
        self.base, self.out, self.open, self.inside = base, [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in DROPPED_WITH_CONTENT:
            self.inside += 1
        if self.inside or tag not in ALLOWED_TAGS:
            return
        kept = []
        for name, value in attrs:
            if name not in ALLOWED_ATTRIBUTES.get(tag, ()):
                continue
            if name in ("href", "src"):
                value = safe_url(value or "", self.base)
            if value is not None:
                kept.append(f' {name}="{html.escape(value)}"')
        rel = f' rel="{LINK_REL}"' if tag == "a" else ""
        self.out.append(f"<{tag}{''.join(kept)}{rel}>")
        if tag not in VOID:
            self.open.append(tag)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag in DROPPED_WITH_CONTENT:
            self.inside -= 1
        elif tag not in VOID and tag in ALLOWED_TAGS:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in DROPPED_WITH_CONTENT:
            self.inside = max(0, self.inside - 1)
        elif not self.inside and tag in self.open:
            while True:
                top = self.open.pop()
                self.out.append(f"</{top}>")
                if top == tag:
                    return

    def handle_data(self, data: str) -> None:
        if not self.inside:
            self.out.append(html.escape(data, quote=False))


def clean_html(source: str, base: str) -> str:
    """Only allowed tags and attributes, text escaped, open elements closed."""
    cleaner = _Cleaner(base)
    cleaner.feed(source)
    cleaner.close()
    return "".join(cleaner.out) + "".join(f"</{t}>" for t in reversed(cleaner.open))


def safe_markdown(source: str, base: str) -> str:
    """Markdown with formulas as safe HTML. Formulas go around Markdown as tokens, which must come back once each and in order, and come out escaped."""
    token = "FOLIOMATH"
    while token in source:
        token += "X"
    spans = scan_spans(source)
    out, at = [], 0
    for k, s in enumerate(spans):
        out += [source[at : s[3]], f"{token}{k:08d}TOKEN"]
        at = s[4]
    rendered = to_html("".join([*out, source[at:]]))
    found = re.findall(rf"{token}(\d{{8}})TOKEN", rendered)
    if found != [f"{k:08d}" for k in range(len(spans))]:
        raise ValueError("formula tokens changed in Markdown")
    return clean_html(re.sub(rf"{token}(\d{{8}})TOKEN", lambda m: html.escape(spans[int(m[1])][0]), rendered), base)


#: (Markdown, base of relative urls) -> safe HTML.
safe_html = per_value(safe_markdown, "string")
