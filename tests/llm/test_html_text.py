import math
import time

import pytest

from terrapix.llm import html_text as html
from terrapix.llm.html_text import html_text, main_text

PROSE = "The tide went out past the old harbour wall, and the boats lay on the mud until evening came."
CHROME = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><div class="ad">Buy now, while stocks last, at our shop.</div>'
FOOT = "<footer>&copy; example &middot; All rights reserved.</footer>"


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{CHROME}{body}{FOOT}</body></html>"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        (f"<article><h1>Head</h1><p><b>{PROSE}<br><p>Two &amp;  three\n four.</p></article>", f"Head\n{PROSE}\nTwo & three four."),
        (f"<article><p>One.</p></article>", "One."),
        ("<article></article>", ""),
        (f"<div class='content'><p>{PROSE}</p><p>{PROSE}</p><p>Short <i>last</i> one.</p></div><div class='sidebar'><p>{PROSE}</p></div>", f"{PROSE}\n{PROSE}\nShort last one."),
        (f"<main><article><p>{PROSE}</p><form>Name <input></form></article><section class='comments'><p>{PROSE} I agree!</p></section></main>", PROSE),
        (f"<div><div class='cookie-notice'><p>We use cookies. {PROSE}</p></div><div id=post><h2>H</h2><p>{PROSE}</p><ul><li>x<li>y</ul></div></div>", f"H\n{PROSE}\nx\ny"),
    ],
)
def test_main_text(body, want):
    assert main_text(page(body)) == want


LINKS = "<div><h3>More</h3><ul>" + "".join(f"<li><a href='/{k}'>Another page of this place {k}</a></li>" for k in range(9)) + "</ul></div>"


@pytest.mark.parametrize("n", [4, 40])
@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<div><div>{many}</div><div><p>{one}</p></div></div>", "{many}\n{one}"),
        ("<div>{many}</div><div><p>Short end.</p></div>", "{many}\nShort end."),
        ("<div><h1>Title</h1><p>Lead.</p><div>{many}</div><p>Loose.</p><ul><li>x<li>y</ul><table><tr><td>1<td>2</table><blockquote>Quote.</blockquote></div>", "Title\nLead.\n{many}\nLoose.\nx\ny\n1\n2\nQuote."),
        ("<h1>Title</h1><div>{many}</div>Bare <b>words</b> after.", "Title\n{many}\nBare words after."),
        ("<h1><a href='/'>Title</a></h1>{links}<h2><a href='/p'>Part</a></h2><div>{many}</div>{links}", "Title\nPart\n{many}"),
        ("<a href='/'>Home</a> | <a href='/n'>News</a><div>{many}</div>", "{many}"),
        ("<h1>Title</h1><article>{many}</article><div><article><p>Short.</p></article></div>{links}", "Title\n{many}\nShort."),
    ],
)
def test_blocks_beside_the_densest(body, want, n):
    assert main_text(page(body.format(many=f"<p>{PROSE}</p>" * n, one=PROSE, links=LINKS))) == want.format(many="\n".join([PROSE] * n), one=PROSE)


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<article><p class='ad'>Buy<p>{one}</p><p>More</p></article>", "{one}\nMore"),
        ("<article><p>{one}<p class=ad>Buy <b>now<ul><li class='share'>Share<li>x<li>y</ul><p>More</article>", "{one}\nx\ny\nMore"),
        ("<article><p>{one}<table><caption class=ad>Buy<tr><td class='social'>Share<td>1<tr class=hidden><td>3<tr><td>2</table><p>More</article>", "{one}\n1\n2\nMore"),
        ("<article><p>{one}<dl><dt class=ad>Buy<dd>x<dd class=ad>Buy<dt>y</dl></article>", "{one}\nx\ny"),
        ("<div><nav><ul><li>Home</ul></div><div><p>{one}<p>{one}</div>", "{one}\n{one}"),
        ("<div><div><aside>Aside</div><p>{one}</p><p>More</p></div>", "{one}\nMore"),
        ("<article><section><div class='ad'>Buy<div>now</div></section><p>{one}</p><select><option>1<option>2</select><p>More</p></article>", "{one}\nMore"),
        ("<article><ul><li>x <nav><li>Home</nav> z</ul><p>{one}</p></article>", "x z\n{one}"),
        ("<article><div class='ad'><p>Buy</p><script>'</div>'</script> now</div><p>{one}</p></article>", "{one}"),
    ],
)
def test_dropped_elements_end(body, want):
    assert main_text(page(body.format(one=PROSE))) == want.format(one=PROSE)


@pytest.mark.parametrize("head", ["<head><title>T</title><meta charset=x><body>", "<head><title>T</title>", "<html><head>\n<style>p{}</style>\n", "<title>T</title>"])
def test_head_without_end_tag(head):
    assert main_text(f"<!DOCTYPE html>{head}<p>{PROSE}<p>More</p>") == f"{PROSE}\nMore"


@pytest.mark.parametrize("odd", ["", "plain words only", "<", "<p", "<!-- never closed", "<a href='x", "</p></p></div>", "<div>" * 3000 + "deep" + "</div>" * 10, "<script>x", "&#0; &bogus; &#x110000;"])
def test_odd_input_does_not_fail(odd):
    assert isinstance(main_text(odd), str)


def test_table(spark):
    rows = [(1, "u", page(f"<article><p>{PROSE} é</p></article>"), "x"), (2, None, None, "x"), (2, None, None, "x"), (3, "v", page("<article><p>" + "w " * 200_000 + "</p></article>"), "x")]
    got = html_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id, r.url or "", r.n_chars) for r in got) == [(1, "u", len(PROSE) + 2), (2, "", 0), (2, "", 0), (3, "v", 399_999)]
    assert html_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize(
    "body",
    [
        "<div class='post no-sidebar'>{many}</div>", "<div id='content' class='has-ads'>{many}</div>", "<article><div class='post social-share-enabled'>{many}</div></article>",
        "<div class='sidebar'>{many}</div>", "<form action='/'>{many}</form>", "<div class='content'><div class='comment-list'><p>Nice.</p></div>{many}<p class='share'>Tell a friend</p></div>",
        "<div class='related-posts'><article><p>Another one.</p></article></div><article>{many}</article>",
    ],
)
def test_names_hint_but_density_decides(body):
    many = f"<p>{PROSE}</p>" * 5
    assert main_text(page(body.format(many=many))) == "\n".join([PROSE] * 5)


def test_density_decides(monkeypatch):
    """Two blocks without names or articles: one of text, one of cards. With all densities alike, another is chosen."""
    cards = "<div>" + "".join(f"<div><h3><a href='/{k}'>Card {k}</a></h3><a href='/{k}'>more of this</a></div>" for k in range(30)) + "</div>"
    body = f"<div><div>{cards}</div><div><p>{PROSE}</p><p>{PROSE}</p></div></div>"
    assert main_text(page(body)) == f"{PROSE}\n{PROSE}"

    def level(root):
        nodes = html.counted(root)
        for x in nodes:
            x.density = 1.0
        for x in nodes:
            x.total = sum(isinstance(k, html.Node) for k in x.items)
        return nodes

    monkeypatch.setattr(html, "measure", level)
    assert main_text(page(body)) != f"{PROSE}\n{PROSE}"


def test_densities_against_plain_recursion():
    tree = html.parse(f"<body><div class=ad>Buy now</div><main><p>{PROSE}</p><p>A <a href=x>link here</a> and <b>more</b></p><ul><li><a>x</a><li>y</ul></main><div><p>{PROSE}</p></div></body>")
    html.measure(tree)

    def counts(x):
        chars, tags, links, link_tags = 0, 0, 0, 0
        for k in x.items:
            if isinstance(k, str):
                chars += len("".join(k.split()))
            else:
                c, t, lc, lt = counts(k)
                chars, tags, links, link_tags = chars + c, tags + t + 1, links + lc, link_tags + lt + (k.tag == "a")
        return (chars, tags, chars if x.tag == "a" else links, link_tags)

    total, _, total_links, _ = counts(tree)

    def density(x, weight):
        own = 0.02 if x.hint else 10.0 if x.tag == "main" else 1.0
        weight = 0.02 if 0.02 in (weight, own) else max(weight, own)
        c, t, lc, lt = counts(x)
        if c:
            base = math.log(c / max(c - lc, 1) * lc + total_links / total * c + math.e)
            want = weight * c / max(t, 1) * max(math.log(max(c / max(lc, 1) * max(t, 1) / max(lt, 1), 1 + 1e-9)) / base, 0)
            assert x.density == pytest.approx(want)
        kids = [k for k in x.items if isinstance(k, html.Node)]
        for k in kids:
            density(k, weight)
        assert x.total == pytest.approx(sum(k.density for k in kids))

    density(tree, 1.0)


@pytest.mark.parametrize("piece", ["<![CDATA[", '<a href="', "<a '>", "<!--", "<p><a \">", "</p>", "<b>", "<hr>", "<li>", "<textarea>x"])
def test_time_grows_with_length_alone(piece):
    odd = "<div>" * 600 + "<ul><li><p>" + "<b>" * 600 + piece * (1_000_000 // len(piece))
    began = time.process_time()
    main_text(odd)
    assert time.process_time() - began < 20


def test_deep_elements_lose_nothing():
    assert main_text("<div>" * 3000 + f"<p>{PROSE}</p><p>More</p>" + "</div>" * 3000 + "<p>End</p>") == f"{PROSE}\nMore\nEnd"
