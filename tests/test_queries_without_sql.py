"""The queries that SQL can't express, over their whole tables, against plain versions that look at one character at a time."""

import re
from html.parser import HTMLParser

from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.functions import formulas, sentences
from foliospark.functions.formulas import VOID_TAGS
from foliospark.plans.catalogue import QUERIES

from .conftest import SF


KINDS = {"$$": ("$$", "$$"), "$": ("$", "$"), "(": ("\\(", "\\)"), "[": ("\\[", "\\]")}


def places(text, sign):
    """Where a sign stands that no backslash escapes; a lone $ isn't the first of two."""
    found = [p for p in range(len(text)) if text.startswith(sign, p)]
    found = [p for p in found if len(re.search(r"\\*\Z", text[:p])[0]) % 2 == 0]
    return [p for p in found if sign != "$" or text[p + 1 : p + 2] != "$"]


def no_formula(inner):
    """What a pair of lone $ holds that isn't a formula."""
    markup = {name.lower() for name in formulas._TAG.findall(inner)} - VOID_TAGS
    return bool(markup) or formulas._AMOUNT.match(inner) is not None and formulas._TEX_SIGN.search(inner) is None


def pair_spans(text):
    """Formula spans from all pairs of an opening and a closing place: of one opening place the nearest pair counts, if its content is a formula; of spans that overlap the one that begins first."""
    pairs = []
    for kind, (opening, closing) in KINDS.items():
        ends = places(text, closing)
        for start in places(text, opening):
            fits = [end for end in ends if end >= start + len(opening)]
            if fits and not (kind == "$" and no_formula(text[start + 1 : min(fits)])):
                end = min(fits) + len(closing)
                pairs.append((start, end, kind in ("$$", "["), text[start:end]))
    out = []
    for span in sorted(pairs):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


def test_spans_of_noise(spark):
    got: dict = {}
    for r in QUERIES["q_formula_spans_noise"](spark, SF).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.end, r.is_block, r.raw_formula))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text and len(r.text) < 6000}
    for d, text in docs.items():
        assert sorted(got.get(d, [])) == pair_spans(text), d


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(["$", "$$", "\\", "\\(", "\\)", "\\[", "\\]", "a", "12", "1,000", " ", "<b>", "<br>", "=", "x_1", "\n"]), max_size=14).map("".join))
def test_spans_of_any_signs(text):
    assert [(s[3], s[4], s[2], s[0]) for s in formulas.scan_spans(text)] == pair_spans(text)


def naive_sentences(text):
    out, start, at = [], 0, 0
    while at < len(text):
        c = text[at]
        if c in ".!?":
            word = re.search(r"(?<![A-Za-z])([A-Za-z][A-Za-z.]*)$", text[max(0, at - 64) : at])
            word = word[1].lower() if word else ""
            short = c == "." and (word in sentences.ABBREVIATIONS or re.fullmatch(r"(?:[a-z]\.){2,}[a-z]?", word + ".") or re.search(r"\bet\s+al$", text[max(0, at - 64) : at], re.I))
            number = c == "." and at and text[at - 1].isdigit() and text[at + 1 : at + 2].isdigit()
            end = at + 1
            while end < len(text) and text[end] in sentences.CLOSERS:
                end += 1
            if not short and not number and (end == len(text) or text[end].isspace()):
                out.append(text[start:end])
                start = at = end
                continue
        at += 1
    return [*out, text[start:]] if start < len(text) else out


def test_sentence_counts(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}
    for r in QUERIES["q_sentence_split_counts"](spark, SF).collect():
        if r.doc_id in docs:
            parts = naive_sentences(docs[r.doc_id])
            chunks, size = 0, 0
            for p in parts:
                if not chunks or size + len(p) > sentences.MAX_CHARS:
                    chunks, size = chunks + 1, 0
                size += len(p)
            assert (r.n_sentences, r.n_chunks) == (len(parts), chunks), r.doc_id


class Seen(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tags, self.attrs, self.text = set(), set(), []

    def handle_starttag(self, tag, attrs):
        self.tags.add(tag)
        self.attrs |= {(tag, k, v) for k, v in attrs}

    def handle_data(self, data):
        self.text.append(data)


def test_safe_pages(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for r in QUERIES["q_safe_html"](spark, SF).collect():
        seen = Seen()
        seen.feed(r.html)
        assert not seen.tags & {"script", "style", "iframe", "object", "embed", "form", "input", "meta", "link", "base"}
        assert all(not k.startswith("on") and k != "style" for _, k, _ in seen.attrs)
        assert all(v.startswith(("http://", "https://", "/assets/", "#")) for _, k, v in seen.attrs if k in ("href", "src") and v)
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        plain = Seen()
        plain.feed(article)
        letters = lambda parts: re.sub(r"[\W_]", "", "".join(parts))  # noqa: E731  Markdown takes some marks away
        assert "$" in article or letters(plain.text) in letters(seen.text)
