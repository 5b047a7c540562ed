import re
import time
from collections import Counter
from html import unescape

from quirefold.llm import htmltext

from .data import SF

RICH = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header>
<nav><ul><li><a href=/x>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div><aside class="sidebar"><p>Side text that is rather long, longer than some.</p></aside>
<div id="wrap"><div class="post-123 content"><h1>Title &amp; more</h1><p>First  paragraph<br>goes
on with <b>bold</b> and <a href="#">a link</a>.<p>Second &lt;p&gt; one.<div class="ad">Buy now</div><form><input value=">"><p>Name</p></form>
<script>var a = "</div><p>no</p>";</script><ul><li>One<li>Two</ul><table><tr><td>A<td>B</table><!-- <p>hidden</p> --></div>
<section class="comments"><article class="comment"><p>Nice post, thank you very much for writing all of this.</p></article></section></div>
<footer>&copy; me</footer></body></html>"""
TEXT = "Title & more\nFirst paragraph goes on with bold and a link.\nSecond <p> one.\nOne\nTwo\nA\nB"


def simple(page):
    """The text of the tables' pages by regular expressions alone."""
    body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    lines = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(p|h1)>", "\n", body))).split("\n")
    return "\n".join(x for x in (" ".join(unescape(line).split()) for line in lines) if x)


def test_tables_match_regular_expressions(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r["page_id"]: (r["url"], simple(r["html"]), len(simple(r["html"]))) for r in pages.collect()}
    assert {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in htmltext.main_text(pages).collect()} == want


def test_rich_page():
    path = htmltext.best_path(RICH)
    assert path.endswith("div.content.post-")
    assert htmltext.extract(RICH, path) == TEXT


def test_host_decides_for_a_page_that_would_choose_otherwise(spark):
    def page(n, extra):
        return f"<body><div class=main><p>{'Article text here. ' * n}</p></div><div class=extra><p>{'Other. ' * extra}</p></div>"

    rows = [(i, "http://a.net/x", page(30, 1)) for i in range(5)] + [(9, "http://a.net/y", page(1, 20)), (10, "http://b.net/", "<p>plain")]
    rows += [(11, None, None), (12, "http://a.net/z", ""), (13, "http://a.net/z", "no markup at all"), (14, "http://c.net", "<div" * 50), (9, "http://a.net/y", page(1, 20))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in htmltext.main_text(pages).collect()}
    assert got[9] == "Article text here." and got[10] == "plain" and got[11] == "" and got[12] == "" and got[13] == "no markup at all"
    assert htmltext.main_text(pages).count() == len(rows)
    assert htmltext.main_text(pages.limit(0)).count() == 0


def test_winners_beyond_the_broadcast_bound(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = sorted(r["text"] for r in htmltext.main_text(pages).collect())
    monkeypatch.setattr(htmltext, "BROADCAST_BYTES", -1)
    assert sorted(r["text"] for r in htmltext.main_text(pages).collect()) == want


def whole(page):
    return htmltext.extract(page, htmltext.best_path(page))


def test_names_that_only_contain_a_listed_word():
    body = "Article text that goes on and on. " * 30
    for opened in ("<article class='post has-comments'>", "<div id=content class='with-sidebar'>", "<div class='entry social-share-on'>", "<div class=sidebar>"):
        page = f"<body><div class=site-footer><p>Imprint</div><div id=x>{opened}<h1>Title</h1><p>{body}</p></div></body>"
        assert whole(page) == f"Title\n{body.strip()}"
    header = "<article><header class=entry-header><h1>Title</h1></header><p>Some text.</p><div class='comments-area'><p>Nice</div></article>"
    assert whole(header) == "Title\nSome text."
    comments = f"<div id=x><div class=text><p>{body}</p></div><div class=comments><p>{'Nice. ' * 900}</p></div></div>"
    assert whole(comments) == body.strip()
    assert whole("<div class=comment><p>One</div><div class=comment><p>Two</div>") == "One\nTwo"


def test_headline_and_lead_outside_the_text_container():
    text = "x" * 99 + " "
    for n in (20, 2000):
        body = (text * n).strip()
        assert whole(f"<body><div class=post><h1>A headline of 20 char</h1><div class=text>{body}</div></div>") == f"A headline of 20 char\n{body}"
        inner = f"<div class=post><div class=head><h1>Head</h1></div><p>Lead</p><div><div class=text>{body}</div></div></div>"
        menu = "<div class=links><a href=/a>One link</a><p><a href=/b>and another</a></p></div>"
        assert whole(f"<body><div id=page>{menu}{inner}</div><div class=extra>Other</div></body>") == f"Head\nLead\n{body}"
    assert whole(f"<main><h1>Head</h1><article><p>{text}</p></article></main>") == f"Head\n{text.strip()}"
    assert whole(f"<main><article><p>{text}</p></article><div>Other</div></main>") == text.strip()


def test_containers_of_the_host_without_text_here():
    empty = "<body><div class=main><div class=pic><img src=x></div></div><div class=story><p>The text is here.</p></div></body>"
    assert htmltext.extract(empty, "/body/div.main") == "The text is here."
    assert htmltext.extract("<body><div class=main><div class=ad>Buy</div></div><div class=story><p>The text.</p></div></body>", "/body/div.main") == "The text."


def test_time_grows_with_the_page_whatever_its_markup():
    """A megabyte of unclosed tags, open quotes or deep nesting takes seconds."""
    n = 1 << 20
    odd = ("<script", "<script>", "<a", "<div class='x'>", "<a b=\"'", "<a '", "<!--", "<noscript>", "<header>x", "<div class=related>x", "<p>x", "</", "<", "<p a=")
    for piece in odd:
        page = piece * (n // len(piece))
        began = time.process_time()
        htmltext.extract(page, htmltext.best_path(page))
        htmltext.extract(page + ">", htmltext.best_path(page + ">"))
        assert time.process_time() - began < 20, piece
    for page in ("<div>" * 50_000 + "</section>" * 50_000 + "<p>end", "<p " + "a" * n + ">end", "<p a=" + " " * n + ">end", "<div class=\"" + "class=\"" * 90_000 + "\">end"):
        began = time.process_time()
        assert htmltext.extract(page, htmltext.best_path(page)) == "end"
        assert time.process_time() - began < 20
    assert htmltext.extract("<p>&#" + "9" * n + "; &#65; &#x110000;", None) == "� A �"


def test_names_alone_drop_no_part_of_an_article():
    body = "Article text that goes on and on. " * 20
    inner = f"<div class=article-header><h1>Title</h1></div><p>{body}</p><section class=related-work><p>Earlier work on this.</p></section><section class=discussion><h2>Discussion</h2><p>What it means.</p></section>"
    want = f"Title\n{body.strip()}\nEarlier work on this.\nDiscussion\nWhat it means."
    for page in (f"<body><nav>x</nav><article>{inner}</article></body>", f"<body><div class=post>{inner}</div><footer>f</footer></body>", f"<main>{inner}</main>"):
        assert whole(page) == want
    assert whole(f"<article><div class=header><h1>Title</h1></div><p>{body}</p><div class=related><h3>Prior art</h3><p>In plain words.</p></div></article>") == f"Title\n{body.strip()}\nPrior art\nIn plain words."


def test_parts_of_the_page_go_by_place_and_score():
    body = "Article text that goes on and on. " * 20
    links = "<a href=/1>One other story</a><a href=/2>Another story</a>"
    replies = "<div class=post-reply><p>First!</p></div><div class=post-reply><p>Second.</p></div>"
    page = f"<body><header><h1>Site name</h1></header><p>{body}</p><p class=notice>Prices are not up to date.</p><div class=related>{links}</div><section class=discussion>{replies}</section><div class=newsletter><p>Sign up</p></div></body>"
    assert whole(page) == body.strip()
    assert whole(f"<div id=page><header><h1>Site</h1></header><main><h1>Head</h1><p>{body}</p></main><footer>f</footer></div>") == f"Head\n{body.strip()}"
    assert whole(f"<div class=post><header><h1>Head</h1></header><p>{body}</p></div>") == f"Head\n{body.strip()}"


def test_votes_match_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    page = lambda tag, n: f"<body><{tag}><p>{'Text here. ' * n}</p></{tag}><div class=b{n}>{'More. ' * 9}</div></body>"
    made = [(i, f"http://h{i % 3}.net/{i}", page("article" if i % 2 else "section", i % 7)) for i in range(60)] + [(60, None, "<p>x"), (61, "http://h1.net/", None)]
    rows = [(r["url"], r["html"]) for r in pages.collect()] + [(u, h) for _, u, h in made]
    votes = {}
    for url, html in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        if (path := htmltext.best_path(html)) is not None:
            votes.setdefault(re.split("[/?#]", rest)[0].lower(), Counter())[path] += 1
    both = pages.select("url", "html").union(spark.createDataFrame(made, "page_id long, url string, html string").select("url", "html"))
    want = {host: max((n, path) for path, n in c.items()) for host, c in votes.items()}
    assert {r["host"]: (r["votes"], r["path"]) for r in htmltext.host_paths(both).collect()} == want


def test_clashing_columns_and_a_very_long_page(spark):
    long = f"<body><nav>menu</nav><article>{'<p>Some words of a very long page.</p>' * 60_000}</article></body>"
    pages = spark.createDataFrame([(1, "http://a.net/", long, "h", "p", "t", 5, "v"), (2, None, "<p>b", None, None, None, None, None)], "page_id long, url string, html string, host string, path string, `text` string, n_chars long, `my votes` string")
    got = {r["page_id"]: r for r in htmltext.main_text(pages).collect()}
    assert got[1]["text"] == "\n".join(["Some words of a very long page."] * 60_000) and got[1]["n_chars"] == len(got[1]["text"])
    assert got[2]["text"] == "b" and htmltext.main_text(pages).columns == ["page_id", "url", "text", "n_chars", "path"]


ARTICLE = "<h1>The headline</h1><p>{a}</p><p>{b}</p>"
OTHER = {
    "comments": '<div class="comments"><div class="comment">{x}</div><div class="comment">{y}</div></div>', "post-comments": '<div class="post-comments"><p>{x}</p><p>{y}</p></div>',
    "user-comments": '<section class="user-comments"><article class="comment-body"><p>{x}</p></article><article class="comment-body"><p>{y}</p></article></section>',
    "commentlist": '<ol class="commentlist"><li>{x}</li><li>{y}</li></ol>', "left-sidebar": '<div class="left-sidebar"><p>{x}</p></div>', "sidebar-left": '<div class="sidebar-left"><p>{x}</p><p>{y}</p></div>',
    "share": '<div class="share-buttons"><span>Send it</span> {x}</div>', "footer": '<div class="post-footer">Filed under {x}</div>', "ad": '<div class="ad-slot">{x}</div>', "ads": '<div id="google_ads_1">{x}</div>',
    "consent": '<div class="cookie-consent"><p>{x}</p><p>{y}</p></div>', "related": '<div class="related-posts"><a href="/1">{x}</a><a href="/2">{y}</a></div>', "role": '<div role="dialog"><p>{x}</p></div>',
    "notice": '<div class="notice"><p>Short {x}</p></div>',
}


def filled(template, n, seed):
    import random

    r = random.Random(seed)
    words = lambda k: " ".join("".join(r.choice("abcdefg") for _ in range(5)) for _ in range(k))
    return template.format(a=words(n), b=words(n), x=words(n), y=words(n))


def test_blocks_go_by_evidence_at_any_length():
    """Readers' comments, sidebars, adverts and notices go, within the article element and beside it, also when they are longer than a short article; the same at half and fifty times the length."""
    for name, other in OTHER.items():
        if name == "notice":
            pages = ["<body><div class=content>{0}{1}</div></body>"]
        else:
            pages = ["<body><article>{0}{1}</article></body>", "<body><div class=content>{0}</div>{1}</body>", "<body><nav><a href=/>Home</a></nav>{1}<div class=content>{0}</div></body>"]
        for page in pages:
            for n, m in ((20, 20), (10, 10), (1000, 1000), *(((12, 60),) if name not in ("related", "notice", "ads", "footer") else ())):
                whole = page.format(filled(ARTICLE, n, 1), filled(other, m, 2))
                want = "\n".join(re.findall(r">([^<>]+)<", filled(ARTICLE, n, 1)))
                assert htmltext.extract(whole, htmltext.best_path(whole)) == want, (name, page, n, m)


def test_article_blocks_with_telling_names_stay():
    for name in ("dialog", "banner", "promotion", "has-comments", "article-with-sidebar", "commentary", "content-sidebar", "sponsored-article", "no-ads", "dialog-scene"):
        for page in ("<body><article><h1>The headline</h1><div class={0}>{1}</div><p>Behind it.</p></article></body>", "<body><div class={0}>{1}<p>Behind it.</p></div><footer>All rights</footer></body>"):
            for n in (10, 500):
                body = filled("<p>{a}</p><p>{b}</p>", n, 3)
                whole = page.format(name, body)
                text = htmltext.extract(whole, htmltext.best_path(whole))
                assert all(x in text for x in re.findall(r"<p>([^<]+)", body)) and "Behind it." in text, (name, page, n)
