"""HTML extraction over pages whose article text is known, with marked headings, sections and links in it."""

import random

import pytest

from lumenfold.llm import html_text as H

WORDS = [f"word{i}" for i in range(200)]


def one(html):
    return H.main_text(H.Page(html), [])


@pytest.mark.parametrize(
    ("inner", "text"),
    [
        ('<h1 class="page-header">Title</h1><p>Prose that goes on for a while here.</p>', "Title Prose that goes on for a while here."),
        ('<p>Prose that goes on.</p><h2 class="section-header">Part</h2><h3 class="banner-title">Sub</h3><p>More of it.</p>', "Prose that goes on. Part Sub More of it."),
        ('<p>We did things.</p><section class="discussion"><h2>Discussion</h2><p>They mean much.</p></section><section class="references"><p>None.</p></section>', "We did things. Discussion They mean much. None."),
        ('<p>We did things.</p><section class="discussion"><p>So they say.</p></section>', "We did things. So they say."),
        ('<p>We did things.</p><div class="discussion"><article><p>First!</p></article></div>', "We did things."),
        ('<p>We did things.</p><div class="discussion"><div class="comment">First!</div></div>', "We did things."),
        ('<p>We did things.</p><div id="respond"><form><p>Your name</p></form>Leave a reply</div>', "We did things."),
        ('<p>We did things.</p><section class="comments"><p>So they say.</p></section>', "We did things."),
        ('<p><a href="/x">All of this article is one link.</a></p>', "All of this article is one link."),
        ('<header><h1>The title</h1><p>By A. Writer, 3 May</p></header><p>Prose that goes on.</p><footer>Filed under x</footer>', "The title Prose that goes on."),
        ('<p>Prose that goes on.</p><ul class="related-posts"><li>Another</li></ul><p>End of it.</p>', "Prose that goes on. End of it."),
        ('<p class="notice">Cookies!</p><p>Prose that goes on.</p>', "Prose that goes on."),
    ],
)
def test_articles(inner, text):
    page = f'<html><head><title>t</title></head><body><header><h1>Site</h1></header><nav><a href=/>Home</a></nav><article>{inner}</article><aside>Read more</aside><footer>(c)</footer></body></html>'
    assert one(page) == text


def test_a_page_of_links_alone_is_no_article():
    assert one("<body><div><a href=/a>One</a></div></body>") == ""


def generated(rng):
    """A page and its article's text."""
    out, text = [], []
    prose = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    for _ in range(rng.randint(2, 8)):
        kind, body = rng.randrange(7), prose(rng.randint(8, 40))
        head = prose(3)
        mark = rng.choice(["", ' class="page-header"', ' class="section-header"', ' class="banner-title"', ' class="title"'])
        if kind == 0:
            out.append(f"<h2{mark}>{head}</h2><p>{body}</p>")
            text += [head, body]
        elif kind == 1:
            out.append(f'<section class="{rng.choice(["discussion", "results", "part"])}"><h3{mark}>{head}</h3><p>{body}</p></section>')
            text += [head, body]
        elif kind == 2:
            out.append(f"<p><a href=/x>{head}</a> {body}</p>")
            text.append(f"{head} {body}")
        elif kind == 3:
            out.append(f"<ul><li>{head}<li>{body}</ul>")
            text += [head, body]
        elif kind == 4:
            out.append(f'<div class="{rng.choice(["share", "advert", "related-posts", "newsletter"])}">{head}</div><p>{body}</p>')
            text.append(body)
        elif kind == 5:
            out.append(f"<div><div><p>{body}</div></div>")
            text.append(body)
        else:
            out.append(f"<blockquote>{body}</blockquote>")
            text.append(body)
    lead = prose(30)
    top = f"<p>{lead}</p>"
    comments = "".join(f'<div class="comment"><p>{prose(5)}</p></div>' for _ in range(rng.randrange(4)))
    page = f'<body><div class="topbar">{prose(3)}</div><nav><ul><li><a>{prose(2)}</a></ul></nav><article>{top}{"".join(out)}</article><section class="comments">{comments}</section><div class="sidebar">{prose(6)}</div><footer>{prose(4)}</footer></body>'
    return page, " ".join([lead, *text])


def test_generated_articles(spark):
    rng = random.Random(11)
    made = [generated(rng) for _ in range(300)]
    assert all(one(html) == text for html, text in made)
    pages = spark.createDataFrame([(i, f"http://h{i % 4}/{i}", html) for i, (html, _) in enumerate(made)], "page_id long, url string, html string")
    found = {r.page_id: r.text for r in H.extract(pages).collect()}
    assert found == {i: text for i, (_, text) in enumerate(made)}
