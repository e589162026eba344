"""Packing and main text of pages."""

import time
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from roomtide.llm import html_text, packing, pieces


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(packing.default_vocabulary())


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def check_pieces(pieces, ids, window):
    """Each id lies in one piece, sequences have no gaps, and only powers of two are shorter than the window."""
    at, fill = defaultdict(int), defaultdict(list)
    for doc, start, length, crc, total, sequence, offset in sorted(pieces, key=lambda p: (p[0], p[1])):
        assert start == at[doc] and length > 0 and total == len(ids[doc])
        assert crc == zlib.crc32(np.array(ids[doc][start : start + length], "<u4").tobytes())
        at[doc] += length
        fill[sequence].append((offset, length))
    assert {d: at[d] for d in ids} == {d: len(x) for d, x in ids.items()}
    sizes = []
    for parts in fill.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        sizes.append(end)
        assert end <= window and (end == window or end & (end - 1) == 0)
    return sizes


def test_documents(spark, documents, prose, tokenizer):
    rows = [*prose, (5000, "<|endoftext|> it's 'll x|y |    ΑΣ é")]
    found = packing.pack_documents(documents(rows)).collect()
    check_pieces([tuple(r) for r in found], {i: ids_of(tokenizer, t) for i, t in rows}, packing.WINDOW)
    assert packing.pack_documents(documents([(1, "a")]).filter("doc_id = 2")).count() == 0


def test_repeated_rows(documents, tokenizer):
    found = packing.pack_documents(documents([(1, "a b"), (1, "a b"), (None, None)])).collect()
    lengths = defaultdict(int)
    for r in found:
        lengths[r["doc_id"]] += r["length"]
        assert r["doc_tokens"] == (1 if r["doc_id"] is None else 3)
    assert lengths == {None: 1, 1: 6}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 200), min_size=0, max_size=60), st.sampled_from([8, 32, 64]))
def test_stream(sizes, window):
    ids = {i: list(range(i, i + n)) for i, n in enumerate(sizes)}
    pieces = list(packing.pack_stream(((i, np.array(x, np.uint32)) for i, x in ids.items()), window))
    check_pieces(pieces, ids, window)


def test_place_minimises_the_sum_of_squares():
    rng = np.random.default_rng(0)
    packer = packing.SumOfSquares(32)
    for size in rng.integers(1, 32, 2000):
        before = packer.counts[1:32].copy()
        _, level = packer.place(int(size))
        after = (packer.counts[1:32] ** 2).sum()
        for h in [0, *np.flatnonzero(before) + 1]:
            if h + size <= 32:
                other = before.copy()
                if h:
                    other[h - 1] -= 1
                if h + size < 32:
                    other[h + size - 1] += 1
                assert after <= (other**2).sum()


def split_ids(known, texts, end=packing.END_ID):
    ids, sizes = known.of(pa.array(texts, pa.string()), end)
    return [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]


@given(st.lists(st.text("aBb|'é½٣ \n\t.,*#$Á <>", max_size=40), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_texts_of_pieces(texts):
    known = pieces.piece_ids(packing.default_vocabulary())
    want = [[*e.ids, packing.END_ID] for e in known.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert split_ids(known, texts) == want


def test_pieces():
    found, first = pieces.pieces(pa.array(["Ab, AB!? a1, .. ,x é.", None, "", "Z"]))
    assert found.to_pylist() == ["ab", ",", "ab", "!?", "a1,", "..", ",x", "é.", "z"]
    assert first.tolist() == [0, 8, 8, 8, 9]


def test_table_of_pieces_starts_anew(monkeypatch, tokenizer):
    monkeypatch.setattr(pieces, "KNOWN_PIECES", 10)
    known = pieces.PieceIds(packing.default_vocabulary())
    for text in ("a b c d", "Hello, worlds! e f g", "a b c d x y z 1 2 3 4 5 6 7 8 9"):
        assert split_ids(known, [text])[0] == ids_of(tokenizer, text)
    assert len(known.known) <= 16


PAGES = {
    "": "",
    "<p>": "",
    "plain &amp; text": "plain & text",
    "<title>t</title><style>p{}</style><script>var a='<p>x</p>'</script><p>a  b<br>c\n d</p>": "a b c d",
    "<nav><a href=x>menu</a></nav><article><h1>T</h1><p>One <b>two.<br><p>Three.</p></article><footer>&copy;</footer>": "T\n\nOne two.\n\nThree.",
    "<article><p>Text &lt;b&gt; &eacute;</p><div class='comments'><p>no</p></div><aside>no</aside><form>no</form></article>": "Text <b> é",
    "<div class=sidebar>side</div><main><p>A long enough paragraph.</p><div id=ad-1>buy</div></main><p>tail": "A long enough paragraph.",
    "<header><h1>Site</h1></header><div role=banner>x</div><p hidden>x</p><p>Body text here.</p><!-- <p>no</p> -->": "Body text here.",
    "<p>kept</p><a href='": "kept",
    "<article><p>x</p></section></b></article>": "x",
    "<div class='site has-sidebar'><article class='post no-comments'><p>Kept.</p><p class=notice>no</p></article></div>": "Kept.",
    "<main><p>Kept.</p><section id='reader-comments'><article class=comment><p>no</p></article></section></main>": "Kept.",
    "<body class=menu-open><p>Kept.</p><div class=cookieNotice>no</div><ul class='main-nav'><li>no</ul></body>": "Kept.",
    "<p class='lead'>Leading words of the page.</p>": "Leading words of the page.",
}


@pytest.mark.parametrize("html", PAGES)
def test_pages(html):
    assert html_text.main_text(html) == PAGES[html]


BODY = "".join(f"<p>{'word ' * 60}{i}.</p>" for i in range(5))
TEXT = "\n\n".join(f"{'word ' * 60}{i}." for i in range(5))
AROUND_THE_PAGE = [
    f'<body><div class="layout-sidebar-right"><article><h1>T</h1>{BODY}</article></div><div class=sidebar>no</div></body>',
    f'<div class="social-science"><h1>T</h1>{BODY}</div><div class="social-links"><a href=x>share</a></div>',
    f'<form id="aspnetForm"><div class=menu><a href=x>menu</a></div><h1>T</h1>{BODY}<div class=footer>foot</div><form>q</form></form>',
    f"<table><tr><td class=sidebar>menu<td><article><h1>T</h1>{BODY}</article></table>",
    f"<table><tbody><tr><td class=nav>menu<td><h1>T</h1>{BODY}<tr><td class=footer>foot</table>",
    f'<div class="main-widget"><h1>T</h1>{BODY}</div><div class=widget>weather</div>',
    f'<article><div class="post-header"><h1>T</h1></div>{BODY}</article><div class="site-header"><h1>Site</h1></div>',
    f'<div class="article-header"><h1>T</h1></div><div class="article-body">{BODY}</div><section class=comments>{BODY}{BODY}</section>',
]


@pytest.mark.parametrize("html", AROUND_THE_PAGE)
def test_names_around_the_page_leave_nothing_out(html):
    assert html_text.main_text(html) == "T\n\n" + TEXT


def test_omitted_end_tags():
    assert html_text.main_text("<table><tr><td class=sidebar>menu<td>article text is here") == "article text is here"
    assert html_text.main_text("<ul><li class=ad>buy<li>text stays</ul>") == "text stays"
    assert html_text.main_text("<ul><li>a<ul><li class=ad>b<li>c</ul><li>d</ul>") == "a\n\nc\n\nd"
    assert html_text.main_text("<dl><dt class=ad>a<dd>b<dt>c</dl>") == "b\n\nc"


def test_inline_elements_are_never_left_out_by_name():
    html = "<article><p>See <span class='share'>our share</span> price; <em class='ad'>ad hoc</em> work.</p></article>"
    assert html_text.main_text(html) == "See our share price; ad hoc work."


@pytest.mark.parametrize(
    "html",
    ["<div>" * 50_000 + "<p>x", "<p>" + "<b>x " * 50_000, "<ul>" + "<li>x " * 50_000, "<div>" * 50_000 + "<p>x</p></b>" * 20_000, "<ul><li>" * 25_000 + "x"],
)
def test_time_grows_with_the_page(html):
    start = time.monotonic()
    assert html_text.main_text(html).startswith("x")
    assert time.monotonic() - start < 5


def test_ratios_decide(monkeypatch):
    """Without an article element the smoothed ratios choose the region: with others, another text comes out."""
    links = "".join(f"<li>see <a href='/{i}'>link {i}</a></li>" for i in range(30))
    html = f"<body><div><ul>{links}</ul></div><div><h2>T</h2>{BODY}</div></body>"
    assert html_text.main_text(html) == "T\n\n" + TEXT
    smoothed = html_text.smoothed
    monkeypatch.setattr(html_text, "smoothed", lambda ratios: smoothed(1 / (1 + ratios)))
    assert "link 3" in html_text.main_text(html)


def test_article_without_its_element():
    """Without an article element long blocks make the region, and lists of links beside them go."""
    links = "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12))
    body = "".join(f"<p>{'word ' * 60}{i}.</p>" for i in range(5))
    text = html_text.main_text(f"<body><div><ul>{links}</ul></div><div id=content><h2>Title</h2>{body}<p>Short.</p></div></body>")
    assert text.startswith("Title\n\nword") and text.endswith("Short.") and "link" not in text


def test_nothing_but_boilerplate_is_dropped():
    """Paragraphs around a very long one, and titles and leads outside the inner container or before an article, stay."""
    short, long = [f"{i} " + "ab " * 66 for i in range(10)], "word " * 1000
    want = "\n\n".join(x.strip() for x in [*short[:5], long, *short[5:]])
    texts = [*short[:5], long, *short[5:]]
    assert html_text.main_text("<body>" + "".join(f"<p>{x}</p>" for x in texts)) == want
    assert html_text.main_text("".join(f"<pre>{x}</pre>" for x in texts)) == want
    lead = "<h1>Title</h1><p>A lead.</p>"
    body = "".join(f"<p>{'word ' * 60}{i}.</p>" for i in range(5))
    links = "<ul>" + "".join(f"<li><a href='/{i}'>link {i}</a></li>" for i in range(12)) + "</ul>"
    for html in (f"<body>{links}<div>{lead}<div>{body}</div></div>{links}", f"<main>{links}{lead}<article>{body}</article></main>"):
        text = html_text.main_text(html)
        assert text.startswith("Title\n\nA lead.\n\nword") and text.endswith("4.") and "link" not in text


def test_given_pages(spark):
    """In the test pages the main text is that of the article element."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    found = {r["page_id"]: r for r in html_text.extract_text(pages).collect()}
    for page in pages.collect():
        inner = re.search("<article>(.*)</article>", page["html"], re.DOTALL)[1]
        blocks = [html.unescape(re.sub("<[^>]*>", "", re.sub("<br>", " ", b))) for b in re.split("</?(?:p|h1)>", inner)]
        want = "\n\n".join(" ".join(b.split()) for b in blocks if b.split())
        assert (found[page["page_id"]]["text"], found[page["page_id"]]["n_chars"]) == (want, len(want))


def test_rows_of_pages(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, None, None, "x", 1), (None, "u", "<p>a</p>", "x", 1), (None, "u", "<p>a</p>", "x", 1), (2, "v", "<p>é" + "b" * 10**6, "x", 1)]
    found = html_text.extract_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted(((r["page_id"] or 0), r["n_chars"]) for r in found) == [(0, 1), (0, 1), (1, 0), (2, 10**6 + 1)]
    assert html_text.extract_text(spark.createDataFrame([], schema)).count() == 0


def test_smoothing_keeps_the_mean_of_a_constant():
    assert np.allclose(html_text.smoothed(np.full(9, 3.0)), 3.0) and len(html_text.smoothed(np.ones(1))) == 1
