"""Block splitting on small pages, and the field's accuracy on labelled pages it has not seen."""

import time

import pytest

from optrail.llm.html import blocks_of, extract_main_text, features, labelled_pages, main_text, trained

PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><script>var x='</p>';</script><style>p{}</style></head><body><nav><ul><li><a href=/>Home</a></li></ul></nav>"
    "<div class=ad>Buy now, cheap.</div><article><h1>A &amp; B</h1><p><b>First\n  line<br>goes on &lt;here&gt;.<p>Second &ampersand.</p><!-- no --><ul><li>one<li>two</ul>"
    "<div class='ad'>Sponsored words here</div><p>Last.</p></article><section class=comments><p>Nice one!</p></section><footer>&copy; me</footer></body></html>"
)


def test_main_text():
    assert main_text(PAGE, trained()) == "A & B\nFirst line goes on <here>.\nSecond &ersand.\none\ntwo\nLast."


#: Written by hand, not by the generator of the training pages.
PLAIN = {
    '<div class="c1"><h1>Title here</h1><p>One paragraph of text, with a comma.</p><p>And two.</p></div>': "Title here\nOne paragraph of text, with a comma.\nAnd two.",
    "<p>Just a paragraph.</p>": "Just a paragraph.",
    "Plain text only, no tags.": "Plain text only, no tags.",
    '<p class="x>Hello</p><p>World</p>': "Hello\nWorld",
    "<table><tr><td><a href=/>Home</a></td></tr><tr><td><p>Body text of the article goes here.</p><p>More of it.</p></td></tr></table>": "Body text of the article goes here.\nMore of it.",
    "<body><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul><h1>Big story</h1><p>First paragraph of the story.</p><p>Second one.</p><footer>&copy; me</footer></body>": "Big story\nFirst paragraph of the story.\nSecond one.",
    "<html><body><nav><a href=/>Start</a> <a href=/b>Blog</a></nav><div><div><h2>On rivers</h2><p>Rivers run to the sea.</p><blockquote>So it is said.</blockquote></div></div><form><input> Search</form></body></html>": "On rivers\nRivers run to the sea.\nSo it is said.",
}


PLAIN |= {
    "<body><h1>Big story</h1><p>First paragraph of it, long enough.</p><p>Second one here.</p><div><h3>Comments</h3><p>User1: nice work</p><p>User2: I agree, really.</p></div></body>": "Big story\nFirst paragraph of it, long enough.\nSecond one here.",
    "<body><h1>Big story</h1><p>First paragraph of it, long enough.</p><p>Second one here.</p><div>Copyright 2020 Some Firm. All rights reserved.</div></body>": "Big story\nFirst paragraph of it, long enough.\nSecond one here.",
    '<body><article><h1>Big story</h1><p>First paragraph of it.</p><div style="display:none">Words that are not shown.</div><p hidden>Nor these.</p><p>Second one here.</p></article></body>': "Big story\nFirst paragraph of it.\nSecond one here.",
    '<body><h1>Big story</h1><p>First paragraph.</p><div style="display: none"><p>Words that are not shown.</p></div><p>Second one here.</p></body>': "Big story\nFirst paragraph.\nSecond one here.",
    "<body><article><h1>On cells</h1><p>What it is about.</p><h2>Discussion</h2><p>We found that cells divide.</p><p>More on that.</p><p>All rights reserved.</p></article><footer>&copy; me</footer></body>": "On cells\nWhat it is about.\nDiscussion\nWe found that cells divide.\nMore on that.\nAll rights reserved.",
}


@pytest.mark.parametrize("page", sorted(PLAIN))
def test_pages_without_telling_markup(page):
    assert main_text(page, trained()) == PLAIN[page]


@pytest.mark.parametrize("page", ["<div>x" * 100_000, "".join(f"<x{i}>y" for i in range(50_000)), "<p class='" * 50_000, "<div>" * 100_000 + "a" + "</div>" * 100_000])
def test_deep_and_broken_pages_take_linear_time(page):
    begin = time.perf_counter()
    main_text(page, trained())
    assert time.perf_counter() - begin < 20


@pytest.mark.parametrize("page", [None, "", "   ", "<", "<p", "</", "<!--", "<script>x", "<a href='", "&#xD800;&#0;", "<div>" * 5000])
def test_odd_pages(page):
    assert isinstance(main_text(page, trained()), str)


def test_blocks():
    assert [b.text for b in blocks_of("a<b>b</b>c<div>d e<br>f</div>g<p>h<div>i</div>&amp")] == ["abc", "d e f", "g", "h", "i", "&"]


def test_held_out_labels():
    crf, right, n = trained(), 0, 0
    for page, labels in labelled_pages(150, 4242):
        blocks = blocks_of(page)
        got = crf.viterbi(features(blocks))
        right += sum(g == labels.get(b.text, labels.get(b.text.removeprefix("© "), 0)) for g, b in zip(got, blocks, strict=True))
        n += len(blocks)
    assert right / n > 0.98


def test_viterbi_is_the_best_of_all_labelings():
    import itertools

    crf = trained()
    page = features(blocks_of(PAGE))[:8]
    u = crf.scores(page)
    value = lambda y: sum(u[i, a] for i, a in enumerate(y)) + sum(crf.pair[a, b] for a, b in zip(y, y[1:], strict=False))
    best = max(itertools.product((0, 1), repeat=len(page)), key=value)
    assert crf.viterbi(page) == list(best)


def test_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, 5), (2, None, None, 5), (None, "u", "", 5), (1, "u", PAGE, 5)], "page_id long, url string, html string, N_Chars int")
    got = extract_main_text(df).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 0), (1, len(main_text(PAGE, trained()))), (1, len(main_text(PAGE, trained()))), (2, 0)]
    assert extract_main_text(df.limit(0)).count() == 0
