import hashlib
import html as html_lib
import io
import math
import random
import re
import tarfile
import zlib

import pytest
from pyarrow.fs import FileSystem
from pyspark.sql import functions as F

from foliospark.llm import chat, html_text, media, queries, url_rules
from foliospark.llm.html_text import main_text

from ..conftest import SF


def test_chat_same_as_sql(same_rows):
    same_rows(queries.op3_chat_formatting, chat.chat_sql())


@pytest.mark.parametrize("text", ["<|im_end|>", "<\\|x", "<\\\\|", "a\\b <", "|", "<|", "<<||>>", "$1 \\1", ""])
def test_escaping_is_reversible(spark, text):
    r = spark.createDataFrame([(text,)], "t string").select(chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("b"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("r")).first()
    assert r.b == text == r.r and "<|" not in r.e


def test_examples(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi <|im_end|>"), (1, 2, "assistant", "yo"), (1, 3, "assistant", None), (1, 4, "user", "bye"), (2, 0, "user", "only"), (None, None, None, None), (3, 1, "a\nb%0A<|", "x"), (3, 1, "a\nb%0A<|", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.format_conversations(df)
    ex = {(r.conv_id, r.example_no): r for r in got.collect()}
    assert ex[1, 0].text == "<|im_start|>system\ns<|im_end|>\n<|im_start|>user\nhi <\\|im_end|><|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert ex[1, 0].text[ex[1, 0].loss_start :][: ex[1, 0].loss_length] == "yo" and ex[1, 1].loss_length == 0 and ex[1, 2].loss_length is None and ex[1, 2].is_last
    assert ex[2, 0].loss_length is None
    back = {r.conv_id: r for r in chat.read_back(got).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert back[1].turns_sha256 == sha("system\ns\nuser\nhi <|im_end|>\nassistant\nyo\nassistant\n\nuser\nbye\n") and back[1].n_turns == 5 and back[1].loss_sha256 == sha("yo") and back[1].loss_chars == 2
    assert back[3].turns_sha256 == sha("a\nb%0A<|\nx\n" * 2) and back[2].loss_sha256 == sha("") and back[None].n_turns == 1
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


# -- urls


def test_urls_same_as_sql(same_rows):
    same_rows(queries.op4_url_filters, queries.url_sql())


def brute_rule(url, rules):
    rest = url.split("://", 1)[1] if url and "://" in url else None
    host = re.match(r"[^/?#]*", rest)[0] if rest is not None else ""
    path = re.match(r"[^?#]*", rest[len(host) :])[0] if rest is not None else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and h and path.startswith(p)]
    return (host, path, *(max(fits)[3:] if fits else (None, "allow")))


def test_rules_against_brute_force(spark):
    rng = random.Random(7)
    names = ["a", "b", "net", "com", "example"]
    host = lambda n: ".".join(rng.choice(names) for _ in range(rng.randint(1, n)))
    path = lambda: "".join(rng.choice(["/", "/x", "/y/", "z"]) for _ in range(rng.randint(0, 3)))
    rules = list({(host(3), "/" + path(), rng.choice(["allow", "block"])) for _ in range(60)})
    urls = [f"http://{host(5)}{'/' + path() if rng.random() < 0.9 else ''}{rng.choice(['', '?q=/x', '#f'])}" for _ in range(600)]
    urls += [None, "", "nothing", "://", "HTTP://A.NET/x", "x://é.net/x", "a://net", "http://net./", "http://.net/"] + ["http://hot.example.com/x"] * 300
    df = spark.createDataFrame(list(enumerate(urls)) + [(None, "http://net/")], "page_id bigint, url string").withColumn("host", F.lit(1))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    assert len(got) == len(urls) + 1
    for i, u in enumerate(urls):
        assert got[i] == brute_rule(u, rules), u


def test_rules_in_several_parts(spark, monkeypatch):
    """A host part with most urls is dealt to several parts, with and without broadcasts; rules of other hosts stay away."""
    rules = [("net", "/", "block"), ("hot.net", "/a/", "allow"), ("hot.net", "/a/b/", "block"), ("rare.org", "/", "block"), ("unused.com", "/", "block")]
    urls = [f"http://{h}/{p}" for i in range(200) for h, p in (("hot.net", "a/b/c"), ("www.hot.net", "a/x"), ("x.rare.org", ""), ("other.de", "a/"))]
    urls.append("http://hot.net/a/" + "b/" * 20_000)
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    r = spark.createDataFrame(rules, "host string, path string, verdict string")
    monkeypatch.setattr(url_rules, "PART_ROWS", 7)
    for sites in (0, 10_000):
        monkeypatch.setattr(url_rules, "BROADCAST_SITES", sites)
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_rules.judge(df, r).collect()}
        assert got == {i: brute_rule(u, rules) for i, u in enumerate(urls)}


def test_rule_edges(spark):
    pages = spark.createDataFrame([(1, "http://a.net/x"), (1, "http://a.net/x")], "page_id bigint, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r.host, r.rule, r.verdict) for r in url_rules.judge(pages, none).collect()] == [("a.net", None, "allow")] * 2
    assert url_rules.judge(pages.limit(0), none).count() == 0
    twice = spark.createDataFrame([("net", "/", "allow"), ("net", "/", "block"), ("NET", None, "allow")], none.schema)
    assert {(r.rule, r.verdict) for r in url_rules.judge(pages, twice).collect()} == {("net/", "block")}


def test_native_plans(spark):
    for f in (queries.op3_chat_formatting, queries.op4_url_filters):
        run = f(spark, SF)._jdf.queryExecution()
        assert not re.search("Python|Pandas|Arrow|ExistingRDD|CartesianProduct|NestedLoop", run.executedPlan().toString())
        assert "PythonRDD" not in run.toRdd().toDebugString()


def test_a_long_conversation_and_clashing_columns(spark):
    turns = [(1, i, "assistant" if i % 2 else "user", f"turn {i}") for i in range(600)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("no", F.lit(1)).withColumn("marked", F.lit("x")).withColumn("end", F.lit(2))
    r = chat.read_back(chat.format_conversations(df)).first()
    want = "".join(f"{a}\n{t}\n" for _, _, a, t in turns)
    assert r.n_turns == 600 and r.n_examples == 300 and r.turns_sha256 == hashlib.sha256(want.encode()).hexdigest()
    assert r.loss_sha256 == hashlib.sha256("".join(t for _, _, a, t in turns if a == "assistant").encode()).hexdigest()


def test_a_very_long_text_in_one_turn(spark):
    long = "word <|im_end|> " * 100_000
    r = chat.read_back(chat.format_conversations(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long)], "conv_id bigint, turn bigint, role string, text string"))).first()
    assert r.loss_chars == len(long) and r.loss_sha256 == hashlib.sha256(long.encode()).hexdigest()


# -- media


def test_media_round_trip(spark):
    texts = {1: None, 2: "", 3: "x" * 64, 4: "é" * 40, 5: "\x00" * 70, 6: "same", 7: "same", 8: "long " * 50_000}
    df = spark.createDataFrame(list(texts.items()) + [(None, "same")], "doc_id bigint, text string").repartition(3).withColumn("offset", F.lit(1))
    got = media.media_columns(df).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        raw = (texts[r.doc_id] or "").encode() if r.doc_id else b"same"
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
        fs, path = FileSystem.from_uri(r.shard)
        whole = fs.open_input_file(path).read()
        assert hashlib.sha256(whole[r.offset : r.offset + r.length]).hexdigest() == r.media_sha256
        members = dict(media.tar_members(whole))
        assert media.from_png(members[f"{r.digest}.png"]).tobytes() == data
        assert tarfile.open(fileobj=io.BytesIO(whole)).getmembers()
    same = {tuple(r)[1:] for r in got if r.doc_id in (6, 7, None)}
    assert len(same) == 1
    heads = {r.digest.hex(): (r.width, r.height, r.depth) for r in media.media_headers(media.store_media(df)).collect()}
    assert all(heads[r.digest] == (64, r.payload_bytes // 64, 8) for r in got)
    assert media.media_columns(df.limit(0)).count() == 0


def test_rows_of_one_id_with_different_texts(spark):
    texts = ["a", "b", "b", None, "c" * 100]
    df = spark.createDataFrame([(7, t) for t in texts], "doc_id bigint, text string").withColumn("digest", F.lit("clash")).withColumn("shard", F.lit(1))
    pad = lambda t: (t or "").encode() + bytes(-len(t or "") % 64 if t else 64)
    assert sorted(r.payload_sha256 for r in media.media_columns(df).collect()) == sorted(hashlib.sha256(pad(t)).hexdigest() for t in texts)


def test_small_shards(spark):
    df = spark.createDataFrame([(i, f"text {i}" * 50) for i in range(40)], "doc_id bigint, text string")
    places = media.store_media(df, shard_bytes=4096)
    assert places.select("shard").distinct().count() > 3 and media.read_media(places).count() == 40


def test_media_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = queries.op5_media_columns(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = (docs[r.doc_id] or "").encode()
        data = raw + bytes(-len(raw) % 64 if raw else 64)
        media_bytes = media.to_png(data)
        lines = media.from_png(media_bytes)
        want = (len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(media_bytes), hashlib.sha256(media_bytes).hexdigest())
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) == want and lines.tobytes() == data
        mean = sum(data) / len(data)
        std = (sum((x - mean) ** 2 for x in data) / len(data)) ** 0.5
        assert r.feature == f"64x{len(data) // 64}x8;mean={mean:.4f};std={std:.4f};zero={data.count(0) / len(data):.4f}"


def test_the_sweep_opens_and_closes_rules(spark):
    """Nested and neighbouring intervals, keys that only look alike, the greatest sign there is, several groups."""
    rng = random.Random(3)
    alphabet = ["a", "b", "\U0010ffff", "\uffff", "é", "/", "\x00"]
    word = lambda n: "".join(rng.choice(alphabet) for _ in range(rng.randint(0, n)))
    rules = {(g, word(4)) for g in range(3) for _ in range(60)}
    keys = [(rng.randrange(4), word(7), k) for k in range(1500)]
    r = spark.createDataFrame([(g, k, (len(k), k)) for g, k in rules], "g int, key string, entry struct<n:int,rule:string>")
    got = url_rules.sweep(r, spark.createDataFrame(keys, "g int, key string, no int"), ["g"]).collect()
    assert len(got) == len(keys)
    for row in got:
        fits = [k for g, k in rules if g == row.g and row.key.startswith(k)]
        assert (row.top.rule if row.top else None) == max(fits, key=len, default=None), row
    assert sorted((x.g, x.key, x.no) for x in got) == sorted(keys)


# -- html


def brute_article(source):
    """The article of the given pages, by their markup."""
    inside = re.search(r"<article>(.*?)</article>", source, re.S)[1]
    blocks = (" ".join(html_lib.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inside))
    return "\n\n".join(b for b in blocks if b)


def test_pages_against_brute_force(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op9_html_extraction(spark, SF).collect()
    assert {r.page_id: r.text for r in got} == {i: brute_article(h) for i, h in pages.items()}
    assert all(r.n_chars == len(r.text) for r in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="x"><div id="cookie-notice">We use cookies</div>
<header><h1>Site</h1></header><nav><a href="/">Home</a></nav><div class="sidebar"><ul><li><a href=1>one</a><li><a href=2>two</a></ul></div>
<div class="content"><h2>Title &amp; more</h2><p>First paragraph with quite a few words in it.<p>Second <b>bold</b> &eacute;&#33;<br>line.
<script>var t="</p>";</script><!-- <p>no</p> --><form><input><button>Go</button></form><div class="ad">Buy</div><p>Ok.</p><div id="comments"><p>nice one, reader says a lot of words here</p></div></div>
<aside>related</aside><footer>(c)</footer>"""


def test_page_without_an_article():
    assert main_text(PAGE) == "Title & more\n\nFirst paragraph with quite a few words in it.\n\nSecond bold é! line.\n\nOk."


def test_unmarked_menus_and_links_in_text():
    page = "<body><ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><h1>Head</h1><p>Long text with <a>a link</a>, <a>another</a> and <a>a third</a> in a sentence.</p><p><a>only</a></p></body>"
    assert main_text(page) == "Head\n\nLong text with a link, another and a third in a sentence.\n\nonly"


LONG = [f"Paragraph {i} of the main text goes on for quite a while, with many plain words and no link in it at all." for i in range(6)]
MAIN = "".join(f"<p>{x}</p>" for x in LONG)


@pytest.mark.parametrize(
    "page",
    [
        f"<div id=content>{MAIN}</div><article><p>A teaser of another page.</p></article>",
        f"<article><a href=1>A teaser</a><p>of another page.</p></article><div id=content><div>{MAIN}</div></div>",
        f"<main>{MAIN}</main><div><article><p>A reader says a few words.</p></article><article><p>Another reader, too.</p></article></div>",
        f"<div><div><div>{MAIN}</div></div></div>",
        "<body>" + "".join(f"<article><p>{x}</p><p>{x}</p></article>" for x in LONG),
        f"<article>{MAIN}</article>",
    ],
)
def test_no_article_element_hides_the_main_text(page):
    got = main_text(page).split("\n\n")
    assert set(LONG) <= set(got)


def test_the_densest_article_bounds_the_text():
    page = f"<div><a href=1>one</a> <a href=2>two</a></div><article><h1>Head</h1><div>{MAIN}</div><p>End.</p></article><footer>f</footer>"
    assert main_text(page) == "\n\n".join(["Head", *LONG, "End."])


@pytest.mark.parametrize("name", ["layout has-sidebar", "page-with-nav", "no-comments"])
@pytest.mark.parametrize("inside", [f"<article>{MAIN}</article>", f"<main>{MAIN}</main>", f"<div>{MAIN}</div>"])
def test_a_part_of_a_name_hides_no_main_text(name, inside):
    page = f'<div class="{name}"><div class="sidebar"><p>side</p></div>{inside}<div id="comments"><article><p>{LONG[0]} {LONG[1]} nice</p></article></div></div>'
    assert main_text(page) == "\n\n".join(LONG)


def test_a_list_of_sources_in_the_article_stays():
    page = f"<ul><li><a>one</a><li><a>two</a><li><a>three</a></ul><article>{MAIN}<ul><li><a>Source A</a><li><a>Source B</a><li><a>Source C</a></ul></article>"
    assert main_text(page) == "\n\n".join([*LONG, "Source A", "Source B", "Source C"])


@pytest.mark.parametrize("source,text", [(None, ""), ("", ""), ("plain &lt; text", "plain < text"), ("<p>a<p>b", "a\n\nb"), ("<script>x", ""), ("<!-- x", ""), ("<p title='a>b'>q</p", "q"), ("<div><div>", ""), ("<" * 50, "<" * 50), ("a < b", "a < b"), ("<article>x</article>", "x")])
def test_odd_pages(source, text):
    assert main_text(source) == text


def test_deep_and_long_pages():
    assert main_text("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"
    assert len(main_text("<article>" + "<p>word word</p>" * 20_000 + "</article>")) == 20_000 * 11 - 2


def test_html_edges(spark):
    df = spark.createDataFrame([(None, None, None), (1, "u", "<p>x"), (1, "u", "<p>x")], "page_id bigint, url string, html string").withColumn("text", F.lit(1))
    assert sorted((r.text, r.n_chars) for r in html_text.extract(df).collect()) == [("", 0), ("x", 1), ("x", 1)]
    assert html_text.extract(df.limit(0)).count() == 0


def brute_measures(page):
    """Density and density sum of every node, by sums over all pairs of nodes."""
    n = len(page.tag)

    def under(i, j):
        while j > i:
            j = page.parent[j]
        return j == i

    seen = [[j for j in range(n) if under(i, j) and (j == i or not page.noise[j])] for i in range(n)]
    own = [sum(len("".join(t.split())) for node, _, t in page.texts if node == i and not page.noise[i]) for i in range(n)]
    chars = [sum(own[j] for j in seen[i]) for i in range(n)]
    tags = [len(seen[i]) - 1 for i in range(n)]
    anchors = [[j for j in seen[i] if page.tag[j] == "a" and not page.noise[j]] for i in range(n)]
    links = [sum(own[j] for j in seen[i] if any(under(a, j) for a in anchors[i])) for i in range(n)]
    share = links[0] / chars[0] if chars[0] else 0.0
    density = [0.0] * n
    for i in range(n):
        if chars[i] and not page.noise[i]:
            c, lc = chars[i], links[i]
            base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
            density[i] = c / max(1, tags[i]) * (max(0.0, math.log(c / max(1, lc) * max(1, tags[i]) / max(1, len(anchors[i])))) / math.log(base) if base > math.e else max(1.0, math.log(c)))
    total = [own[i] + sum(density[j] for j in range(n) if j and page.parent[j] == i) for i in range(n)]
    return chars, density, total


def test_densities_against_brute_force():
    rng = random.Random(8)
    word = lambda: rng.choice(["word", "longer", "x", "&amp;"])

    def element(depth):
        name = rng.choice(["div", "p", "a", "b", "section", "ul", "nav", "h2"])
        inside = "".join(rng.choice([lambda: f" {word()} ", lambda: element(depth - 1) if depth else word()])() for _ in range(rng.randint(0, 5)))
        return f"<{name}>{inside}</{name}>"

    for _ in range(60):
        page = html_text.Page("".join(element(4) for _ in range(rng.randint(1, 5))))
        page.measure()
        chars, density, total = brute_measures(page)
        for i in range(len(page.tag)):
            if not page.noise[i]:
                assert page.chars[i] == chars[i] and page.density[i] == pytest.approx(density[i]) and page.total[i] == pytest.approx(total[i])


def test_pages_whose_article_has_no_tag_of_its_own(spark):
    """The given pages with their article elements turned into plain ones: densities alone find the same texts."""
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    for name in ("div", "section", "span"):
        renamed = {i: re.sub(r"<(/?)article>", rf"<\1{name}>", h) for i, h in pages.items()}
        assert {i: main_text(h) for i, h in renamed.items()} == {i: brute_article(h) for i, h in pages.items()}


def dealt(source, groups, name):
    """The article's paragraphs in several elements of their own, the article itself a plain one."""
    head, inside, rest = re.match(r"(.*)<article>(.*)</article>(.*)", source, re.S).groups()
    title, paragraphs = re.match(r"(\s*(?:<h1>.*?</h1>)?)(.*)", inside, re.S).groups()
    blocks = re.findall(r"<p>.*?</p>", paragraphs, re.S)
    if re.sub(r"<p>.*?</p>|\s", "", paragraphs, flags=re.S):
        return source  # not of paragraphs alone
    cut = [blocks[len(blocks) * k // groups : len(blocks) * (k + 1) // groups] for k in range(groups)]
    return f"{head}<div>{title}{''.join(f'<{name}>{chr(10).join(b)}</{name}>' for b in cut if b)}</div>{rest}"


@pytest.mark.parametrize("name,groups", [("div", 2), ("section", 3), ("div", 5)])
def test_pages_whose_paragraphs_are_dealt_to_several_elements(spark, name, groups):
    pages = [r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for page in pages:
        assert main_text(dealt(page, groups, name)) == brute_article(page)


@pytest.mark.parametrize("around", ["{}", "<article>{}</article>", "<div id=main>{}</div>", "<form action=/x><input type=hidden>{}</form>"])
def test_lead_and_end_and_short_sections_stay(around):
    lead, end = "<p>A lead.</p>", "<p>The end.</p>"
    page = around.format(f'<div class="all"><div class="lead">{lead}</div><div class="text">{MAIN}</div><div class="end">{end}</div></div>')
    assert main_text(f"<nav>menu</nav>{page}<footer>f</footer>") == "\n\n".join(["A lead.", *LONG, "The end."])
    parts = f"<section><h2>One</h2>{lead}</section><section><h2>Two</h2>{MAIN}</section><section>{end}</section>"
    assert main_text(f"<ul><li><a>a</a><li><a>b</a><li><a>c</a></ul>{around.format(parts)}") == "\n\n".join(["One", "A lead.", "Two", *LONG, "The end."])


def test_forms():
    assert main_text(f"<form><div><label for=q>Search</label><input id=q></div><div>{MAIN}</div></form>") == "\n\n".join(LONG)
    assert main_text(f"<div>{MAIN}</div><form><p>Write to us today, we would like it.</p><label>Name</label><input></form>") == "\n\n".join(LONG)
    assert main_text(f"<article>{MAIN}<form><p>Your mail</p></form></article>") == "\n\n".join(LONG)


def test_formulas_labels_and_titles_in_the_article_stay():
    page = "<article><header><h1>Title</h1><p>By A. Writer</p><div><h2>Second</h2>Share</div></header>" + MAIN
    page += "<p>So <math><mi>x</mi><mo>=</mo><mn>1</mn><annotation encoding=t>x=1</annotation></math> holds, see <label>note</label> one.</p></article>"
    assert main_text(f"<header><h1>Site</h1></header>{page}") == "\n\n".join(["Title", "Second", *LONG, "So x=1 holds, see note one."])


@pytest.mark.parametrize(
    "comments",
    [
        "<h3>3 Comments</h3><div><p>A reader says that this is well said, thank you.</p></div><p>Another one is of the same mind, he says.</p>",
        "<div><h2>Kommentare</h2><p>Ein Leser meint, das sei gut gesagt, und dankt sehr.</p></div>",
        "<div class=x><p>A reader says that this is well said, thank you.</p><p>Another one is of the same mind, he says.</p></div>",
    ],
)
def test_unmarked_comments_after_the_article_are_out(comments):
    assert main_text(f"<main><article><h1>Head</h1>{MAIN}</article>{comments}</main>") == "\n\n".join(["Head", *LONG])
    if "<h" in comments:
        assert main_text(f"<div><div><h1>Head</h1>{MAIN}</div>{comments}</div>") == "\n\n".join(["Head", *LONG])


def test_equal_densities_take_the_first():
    page = f"<div>{MAIN}</div><div class='ad'>{MAIN}</div>"
    assert main_text(page) == "\n\n".join(LONG) and main_text(page + page).startswith(LONG[0])
