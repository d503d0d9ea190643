"""HTML extraction, token counts, WARC, top-k search and chat formatting against brute force and exact round trips."""

import hashlib
import io
import math
import random
import time

import numpy as np
import pytest

from sanctum.llm import chat, html, tokens, topk, warc

# == HTML ==


def page(host, i, article, extra="", wrap="article", aside=True):
    side = f'<aside><h3>Side {i}</h3><ul><li>Side link {i}</li></ul></aside><div class="right-sidebar">More {i}</div>' if aside else ""
    return (
        f'<!DOCTYPE html><html lang="en"><head><title>T{i}</title><style>p{{a:b}}</style><script>var t="</p><article>no</article>";</script></head><body class="has-sidebar">'
        f'<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home {i}</a></li></ul></nav><!-- <p>gone</p> --><div class="cookie-notice">We use cookies {i}</div>'
        f'<div class="ad">Buy {i}<div class="content-with-sidebar"><{wrap}>{article}{extra}</{wrap}>{side}</div>'
        f'<form><p>Name</p><input name=x><button>Send</button></form><section id="comments"><h2>Replies</h2><article><p>I disagree {i}</p></article></section><footer>&copy; {host}</footer>'
    )


ARTICLE = "<h1>Head &amp; tail</h1><p>One <b>bo</b>ld\n  &lt;x&gt; &#233; &nbsp;end<p>Two<br>lines<ul><li>a</li><li>b</li></ul><table><tr><td>c<td>d</table><div class='share'>Share</div>"
WANT = "Head & tail One bold <x> é end Two lines a b c d"


def texts(spark, rows):
    df = spark.createDataFrame([(i, u, h, "clash", "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, host string, wrapper string").repartition(3)
    return {r["page_id"]: " ".join(r["blocks"]) for r in html.main_text(df).collect()}


def test_html_regions(spark):
    rows = [(f"http://h{i % 2}.org/{i}", page("h", i, ARTICLE, aside=i % 3 > 0)) for i in range(8)]
    rows += [("http://h0.org/x", page("h", 9, "<p>Other</p><dl><dt>t1</dt><dd>d1</dd><dt>t2</dt><dd>d2</dd></dl>")), (None, None), ("bad", ""), ("http://h1.org/cut", "<p>a</p><article><p>text<p"), ("http://h1.org/cut", "<p>a</p><article><p>text<p")]
    rows += [("http://m.org/", page("m", 1, ARTICLE, wrap="main")), ("http://c.org/", page("c", 1, ARTICLE).replace("<article>" + ARTICLE + "</article>", f'<div class="entry-content">{ARTICLE}</div>').replace("Buy 1", "Buy 1</div>"))]
    got = texts(spark, rows)
    assert [got[i] for i in range(8)] == [WANT] * 8
    assert got[8] == "Other t1 d1 t2 d2" and got[9] == got[10] == "" and got[11] == got[12] == "text"
    assert got[13] == got[14] == WANT


def test_html_without_article_uses_the_hosts_pages(spark):
    rows = [(f"http://plain.org/{i}", f"<body><div>Always here</div><div><p>Story {i} of words.</p><p>More {i}</p></div><div><a href=x>Link {i}</a> <a href=y>Link</a></div><div>{'<p>' if i % 2 else ''}</div></body>") for i in range(6)]
    rows += [("http://plain.org/copy", "<body><div>Always here</div><div><p>Copied.</p></div><dl><dt>Term</dt></dl></body>")] * 4
    got = texts(spark, rows)
    assert got[6] == got[9] == "Copied. Term"  # copies of one page are one page
    assert got[0] == "Story 0 of words. More 0" and got[3] == "Story 3 of words. More 3"


def test_html_alignment_covers_every_page():
    rng = random.Random(4)

    def make(depth):
        tags = ["p", "div", "ul", "section", "dt", "dd", "table"]
        return "".join(f"<{(t := rng.choice(tags))}>{make(depth - 1) if rng.random() < 0.5 and depth else f'w{rng.random()}'}</{t}>" for _ in range(rng.randrange(1, 7)))

    pages = [f"<article>{make(3)}</article>" for _ in range(60)]
    w = None
    for p in pages:
        w = html.merge(w, html.skeleton(html.parse(p))) if w else html.skeleton(html.parse(p))
    done = html.finish(w)
    for p in pages:
        import re

        assert " ".join(html.extract(html.parse(p), done)).split() == re.sub("<[^>]*>", " ", p).split()
    assert html.expression(html.skeleton(html.parse("<ul><li>a<li>b</ul><dl><dt>1<dd>2<dt>3<dd>4</dl>"))) == "<#page>(<ul>(<li>(#)+) <dl>((<dt>(#) <dd>(#))+))"


@pytest.mark.parametrize("source", ["<", "<a", "<a b='", "</", "<!--", "<script>x", "&", "&am", "<p" * 3000, "<div>" * 2000 + "x", "<p>a</div></span></p>" * 10, "<table><td><p>x<li>y</table>z", "\x00<p>\x00"])
def test_html_odd_markup(source):
    html.extract(html.parse(source), html.finish(html.skeleton(html.parse(source))))


# == token counts ==


def brute_count(word, scores, byte_score):
    text = tokens.MARK + word
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(text)
    for i in range(1, len(text) + 1):
        n = len(text[i - 1].encode())
        options = [(best[i - 1][0] + n * byte_score, best[i - 1][1] - n)]
        options += [(best[j][0] + scores[text[j:i]], best[j][1] - 1) for j in range(i) if text[j:i] in scores]
        best[i] = max(options)
    return -best[-1][1]


def test_token_counts(spark):
    rng = random.Random(1)
    scores = tokens.load(tokens.default_vocabulary())
    words = ["".join(rng.choice("abcdethirnosé▁日🙂Q.,'") for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    rows = [None, "", " ", "x" * 5000] + [" ".join(rng.choice(words) for _ in range(30)) for _ in range(40)]
    df = spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "doc_id long, text string, n_tokens int").repartition(2)
    byte_score = min(scores.values()) - 1
    got = {r["doc_id"]: (r["n_words"], r["n_tokens"]) for r in tokens.token_counts(df).collect()}
    for i, t in enumerate(rows):
        ws = (t or "").split()
        assert got[i] == (len(ws), sum(brute_count(w, scores, byte_score) for w in ws))
    small = tokens.TrieCounter(scores, limit=50)
    assert [n for _, n in small.counts([r.encode() for r in rows[4:]])] == [got[i][1] for i in range(4, len(rows))]


# == WARC ==


def test_warc_round_trip(spark, tmp_path):
    big, long_ = "é" * 60, "abc\r\n\r\nWARC/1.1\r\n" * 20_000
    bodies = [None, "", "x" * 99, "x" * 99, big, big, "q" * 100, long_, big, "q" * 100, long_, ""]
    rows = [(i, f"http://a/{i}\r\nX: y" if i % 2 else None, h, "clash", 0) for i, h in enumerate(bodies)] + [(4, "http://a/4", big, "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, first string, frame int").repartition(3)
    index = warc.write(df, f"file://{tmp_path}/out", frame_bytes=4000, bundle_bytes=3000)
    back = warc.read(index).collect()
    assert len(back) == len(rows)
    for r in back:
        i = int(r["page_id"])
        data = (bodies[i] or "").encode()
        first = min(j for j, b in enumerate(bodies) if (b or "").encode() == data)
        revisit = len(data) >= 100 and i != first
        assert (r["payload_bytes"], r["payload_digest"]) == (len(data), hashlib.sha256(data).hexdigest())
        assert r["record_type"] == ("revisit" if revisit else "response") and r["refers_to"] == (str(first) if revisit else None)
        assert r["payload"] == (None if revisit else data)
    for e in index.collect():  # one record by its index entry alone
        fs, path = warc.open_fs(e["bundle"])
        record = warc.BundleReader(fs.open_input_file(path)).record(e["frame"], e["offset"], e["length"])
        assert next(warc.parse_records(record))[1]["WARC-Record-ID"] == f"<urn:page:{e['page_id']}>"
    assert warc.read(warc.write(df.where("false"), f"file://{tmp_path}/none")).collect() == []


def test_bundle_without_seek_table():
    class Source(io.BytesIO):
        def size(self):
            return len(self.getvalue())

    with pytest.raises(ValueError):
        warc.BundleReader(Source(b"x" * 100))


# == top-k search ==


def brute_top(vectors, k=10, every=100):
    ok = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for qi, q in ok:
        if qi % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(q, c)), i) for i, c in ok if i != qi)[:k]
            out |= {(qi, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


@pytest.mark.parametrize("n", [0, 5, 900])
def test_top_k(spark, n):
    rng = np.random.default_rng(n)
    centers = rng.normal(size=(5, 24))
    vectors = [(i, (centers[i % 5] + 0.3 * rng.normal(size=24)).astype(np.float32).tolist()) for i in range(n)]
    if n > 100:
        vectors[7] = (7, None)
        vectors[8] = (8, [None] * 24)
        vectors[9] = (9, [float("nan")] + [0.0] * 23)
        vectors[100] = (100, [float("inf")] * 24)
        vectors[10] = (10, vectors[11][1])
        vectors[12] = (12, vectors[11][1][:5])
        vectors[13] = (13, [])
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors], "vec_id long, embedding array<float>, score int, rank int").repartition(3)
    got = {tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0")).collect()}
    assert got == brute_top(vectors)


def test_top_k_beyond_doubles(spark):
    vectors = [(i, [float(3**i), 1e9 + i, -1e8 * i]) for i in range(0, 30, 2)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in topk.top_k(df, df.where("vec_id % 100 = 0"), k=3, scale=0.5).collect()} == {
        (0, r + 1, i, s) for r, (s, i) in enumerate(sorted(((sum(math.floor(a / 2) * math.floor(b / 2) for a, b in zip(vectors[0][1], v)), i) for i, v in vectors[1:]), key=lambda x: (-x[0], x[1]))[:3])
    }


# == chat formatting ==


def test_template_language():
    go = lambda source, **v: "".join(p for p, _ in chat.compile_template(source)(**v))
    assert go("{% for x in xs %}{{ loop.index }}{{ x.a }}{% if not loop.last %}, {% endif %}{% endfor %}", xs=iter([{"a": "p"}, {"a": None}, {}])) == "1p, 2, 3"
    assert go("{% set y = 'q' + \"}}\" %}{{ y ~ 1 | trim }}{# no #}  {%- if a == 1 and b in [2, 3] or false -%} yes {%- elif c %}c{% else %}no{% endif %}", a=1, b=3, c=0) == "q}}1yes"
    assert go("{% if 1 < 2 %}{{ 'a' | upper }}{% endif %}{% if none %}x{% endif %}") == "A"
    assert chat.fold(chat.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}e", {}), {}) == [("text", "abcde")]
    for bad in ("{{ x.__class__ }}", "{{ x() }}", "{{ x | nope }}", "{% for x in y %}", "{{ x", "{% import os %}", "{{ missing }}", "{{ 'a' 'b' }}"):
        with pytest.raises(chat.TemplateError):
            go(bad, x="s", y=[])


ODD = [None, "", chat.PROBE, "\\", "\\\\### ", "</turn>\n### User: ", "é\n", "<\\/turn>", "#\\## x", "### ### </turn></turn>", "a: b"]


def test_chat_round_trip(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for c in [*range(40), None]:
        turns = [(t, rng.choice(["user", "assistant", "system", "we:ird\\ ### ", None]), rng.choice(ODD)) for t in range(rng.randrange(1, 8))]
        rows += [(c, t, r, x, "clash") for t, r, x in turns]
        want[c] = [(r or "", x or "") for _, r, x in turns]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["conv_id"]: tuple(r)[1:] for r in chat.read_back(df).collect()}
    for r in chat.format_conversations(df).collect():
        turns, text = want[r["conv_id"]], r["formatted"]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert got[r["conv_id"]] == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss), len(text))
        assert "".join(chat.unescape(text[s["start"] : s["end"]]) for s in r["loss_spans"]) == loss
        reader = chat.Reader()
        assert list(reader.feed(text)) == turns
    assert chat.read_back(df.where("false")).collect() == []
    tied = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, None, "user", "c"), (1, 0, "user", "a")], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(tied).first()["formatted"] == "".join(f"### User: {x}</turn>\n" for x in "caab")


def page_text(source):
    page = html.parse(source)
    return " ".join(html.extract(page, html.finish(html.skeleton(page))))


@pytest.mark.parametrize("quote", ['"', "'"])
@pytest.mark.parametrize("n", [10, 2040, 2100, 300_000])
def test_html_quotes_hide_markup_at_any_length(n, quote):
    value = f"{quote}{'a' * n}<b>x</b><nav>tail{quote}"
    for start in (f"<div data-props={value}>", f"<div data-props = {value} class=x>", f"<div data-props={value}/>"):
        assert page_text(f"<article><p>Before.</p>{start}Real</div><p>After.</p></article>") == "Before. Real After."
    # a quote counts only where a value begins, and an open one ends at the next '>'
    assert page_text(f"<article><p don{quote}t {'b' * n}>It{quote}s</p><p>so{quote}s <b>told</b></p></article>") == f"It{quote}s so{quote}s told"
    assert page_text(f"<article><p>One</p><p title={quote}{'a' * n}>Two</p></article>") == "One Two"


@pytest.mark.parametrize("source", ['<a x=">" ' * 60_000, "<p a='>\" b=\"' " * 60_000, '<a x="' * 60_000 + ">", "<div>" * 60_000 + "<td>x</td>" * 60_000, "<p><div>" * 60_000])
def test_html_is_linear(source):
    began = time.time()
    html.parse(source)
    assert time.time() - began < 10


def test_html_regions_below_the_deepest_block():
    deep = 700
    inner = "<nav>menu<div>more</div></nav><div class=comments><article>said</article></div><header>top<h2>Head</h2></header><div>kept</div>"
    source = "<article><p>First.</p>" + "<div>" * deep + inner + "</div>" * deep + "<p>Last.</p></article><footer>end</footer>"
    assert page_text(source) == "First. Head kept Last."
    assert page_text("<nav>" + "<div>" * deep + "menu<main>Main</main>" + "</div>" * deep + "menu</nav>") == "Main"


def test_html_hidden_is_an_attribute():
    assert page_text('<article data-title="The hidden cost of X"><p>A <a title="A hidden Markov model">model</a> of it.</p></article>') == "A model of it."
    assert page_text("<article><p>Seen</p><p hidden>a</p><p class=x hidden=until-found>b</p><p class=x HIDDEN/>c</article>") == "Seen"
    assert page_text("""<article><p data-1="class='ad' hidden=x" class=a class=ad>Seen</p></article>""") == "Seen"


def test_html_ids_of_parts_of_an_article_class_nothing():
    parts = ['<h2 id="discussion">Discussion</h2>', '<p>See <span id="Discussion">there</span></p>', '<section id="related-work"><p>Work</p></section>', '<h2 id="search">Search</h2>', '<section id="social-history"><p>History</p></section>']
    assert page_text(f'<article id="share">{"".join(parts)}<div class="section" id="http-header"><p>Header</p></div></article>') == "Discussion See there Work Search History Header"
    outside = '<section id="related"><p>no</p></section><div id="share">no</div><section id="comments"><article><p>no</p></article></section>'
    assert page_text(f'<article><p>Yes</p><div id="share">no</div><section class="related">no</section><section id="comments">no</section></article>{outside}') == "Yes"
    assert page_text(f"<h2 id=search>Search</h2><p>Found</p>{outside}") == "Search Found"
