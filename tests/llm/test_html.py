"""Pages that other markup than one marked article carries, and pages that are long or broken."""

import time

import pytest

from voxelith.llm.htmltext import DEEPEST, Tags, main_text

P = "A paragraph of some length that says what the article is about, at last. " * 4
T = P.strip()


@pytest.mark.parametrize("page, want", [
    (f'<body><div id="content"><h1><a href="/x">The Title</a></h1><p>{P}</p><p>{P}</p></div></body>', f"The Title\n{T}\n{T}"),
    (f'<body><a name="top"><div class="content"><p>{P}</p><p>{P}</p></div></body>', f"{T}\n{T}"),
    (f'<body><div class="content"><p>{P}</p><p>{P}<a href="/x">more</p><p>{P}</p><p>Last words.</p></div></body>', f"{T}\n{T} more\n{T}\nLast words."),
    (f'<body><div class="content"><p>{P}<a href="/x">one<a href="/y">two</a> and on, {P}</p></div></body>', f"{T} onetwo and on, {T}"),
    (f'<body><div id="content"><div><p>{P}</p><p>{P}</p></div><div class="advert">Buy</div><div class="x"><p>The end.</p></div></div></body>', f"{T}\n{T}\nThe end."),
    (f'<body><div><div><p>{P}</p><p>{P}</p></div><div class="advert">Buy</div><div><p>The end.</p></div></div></body>', f"{T}\n{T}\nThe end."),
    (f'<article><p>{P}</p><div id="social-history"><p>History.</p></div><p class="privacy-law">Law.</p><p>So <math><mi>x</mi></math> is.</p></article>', f"{T}\nHistory.\nLaw.\nSo x is."),
    (f'<article><p>{P}</p><div class="share sidebar"><p>Side.</p></div><div role="navigation">Nav</div></article>', T),
    (f'<article><h2><a href="/x">Linked</a></h2><p>{P}</p></article>', f"Linked\n{T}"),
    ("<p>a < b and c > d <e", "a < b and c > d"),
    ('<p>one</p><p class="never closed>two</p>', 'one\n<p class="never closed>two'),
    (f"<article><p>{P}</p><!-- cut", T),
])
def test_markup(page, want):
    assert main_text(page) == want


def test_tags_are_found_in_order():
    page = """<p a='>' b=">">x</p><!-- <b> --><script>"<i>"</script ><br/><x y=1><!doctype z><a href="'">"""
    assert [(n, e, a) for *_, n, e, a in Tags(page)] == [("p", False, " a='>' b=\">\""), ("p", True, ""), ("", False, ""), ("", False, ""), ("br", False, "/"), ("x", False, " y=1"), ("", False, ""), ("a", False, " href=\"'\"")]


@pytest.mark.parametrize("piece", ["<p class='a", '<p class="a', "<p class='a\"", "<p class=\"a'b", "<", "<a ", "<!--", "<div>a", "<p>a<b>", "<a href=x>", "&amp;", "<p>word word</p>\n", "<script>", "</p", "<li><a href='x'>y</a>"])
def test_a_megabyte_of_anything_is_read_in_proportion(piece):
    began = time.perf_counter()
    main_text(piece * (1_000_000 // len(piece)))
    assert time.perf_counter() - began < 6


def test_a_long_article_and_a_deep_one():
    body = "".join(f"<p>{P}{i}</p>" for i in range(3500))
    assert len(body) > 1_000_000
    began = time.perf_counter()
    assert main_text(f"<body><nav>x</nav><article>{body}</article></body>").count("\n") == 3499
    assert time.perf_counter() - began < 2
    assert main_text("<div>" * (3 * DEEPEST) + f"<p>{P}</p><p>{P}</p>") == f"{T}\n{T}"
