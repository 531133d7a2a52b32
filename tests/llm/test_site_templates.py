import html
import random
import re

from loomgraph.llm import site_templates as S
from loomgraph.llm.html_tree import Page


def text(source):
    return S.Outline(S.Page(source)).text()


def pages(spark, rows):
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in rows], "page_id long, url string, html string, text string")
    return {r["page_id"]: r["text"] for r in S.extract_texts(df).collect()}


def test_markup_as_browsers_read_it():
    assert text("<article><h1>T &amp; U</h1><p><b>a<br>b \n c<p>d&nbsp;e<table><tr><td>1<td>2</table></article><p>out") == "T & U\na b c\nd e\n1\n2"
    assert text('<body><script>var t="</p>";</script><style>p{}</style><!-- x <p>no</p> --><p title="a>b">y</p><p>cut') == "y\ncut"
    assert text("<article>1 < 2 & 3 &lt;b&gt; &#233;&#x41; &copy;</article>") == "1 < 2 & 3 <b> éA ©"
    assert text("<article><p>a<script>x") == "a" and text("<article><p>a<!-- never ends") == "a" and text('<article><p>a<a href="cut') == "a"
    assert text("") == text("<nav>x</nav>") == text("<html><head><title>t</title></head><body></body></html>") == ""
    assert text("<div>" * 30_000 + "deep") == "deep"


def test_what_html_names_as_no_article():
    foreign = [f'<{t}><p>no</p></{t}>' for t in ("nav", "aside", "footer", "form", "header")] + [f'<div {a}><p>no</p></div>' for a in ('class="ad"', 'id="cookieBanner"', "class=reader-comments", 'class="box sidebar"', 'role="complementary"', "class='site_notice'")]
    for x in foreign:
        for page in (f"<body>{x}<article><p>yes</p>{x}</article>{x}</body>", f"<body>{x}<p>yes</p>{x}</body>"):
            assert text(page) == "yes", page
    assert text('<body><main><article class="has-sidebar"><header><h1>T</h1></header><p>x</p></article></main><section class="comments"><article>c</article></section>') == "T\nx"
    assert text('<div class="with-sidebar" id="content"><div class="article-header"><h1>T</h1></div>x</div><div>y</div>') == "T\nx"


def test_templates_of_a_host_go(spark):
    r = random.Random(1)
    words = lambda n: " ".join(r.choice(["oak", "elm", "fir", "ash", "yew", "box"]) + str(r.randrange(1000)) for _ in range(n))
    menu, note = "<div><ul><li>Home</li><li>About</li></ul></div>", "<div>We value your <b>privacy</b></div>"
    rows, want = [], {}
    for k in range(40):
        body = [words(12), words(30)]
        rows.append((k, f"http://site{k % 2}.example/{k}", f"<body>{menu}<div><p>{body[0]}</p><p>{body[1]}</p>{note}</div></body>"))
        want[k] = "\n".join(body)
    rows.append((100, "http://other.example/", f"<body>{menu}<p>alone</p></body>"))  # too few pages to tell
    want[100] = "Home\nAbout\nalone"
    rows += [(101, None, None), (102, "http://site0.example/", ""), (None, "http://other.example/2", "<p>x</p>")]
    want |= {101: "", 102: "", None: "x"}
    assert pages(spark, rows) == want


def test_passages_and_copies_of_articles_stay(spark):
    passage = "a passage of many words that a third of all articles of this host repeat word for word"
    rows = [(k, "http://h.example/", f"<html><body><nav>{k}</nav><article><h1>{k // 3}</h1><p>{passage}</p><p>own {k % 4}</p></article></body></html>") for k in range(60)]
    rows += [(100 + k, "http://h.example/c", "<body><p>one page, many times</p></body>") for k in range(100)]
    got = pages(spark, rows)
    assert all(got[k] == f"{k // 3}\n{passage}\nown {k % 4}" for k in range(60)) and got[150] == "one page, many times"


def test_templates_by_join_when_there_are_many(spark, monkeypatch):
    rows = [(k, "http://a.example/", f"<body><div>menu</div><p>text {k}</p></body>") for k in range(9)]
    want = pages(spark, rows)
    monkeypatch.setattr(S, "BROADCAST_ROWS", 0)
    assert pages(spark, rows) == want == {k: f"text {k}" for k in range(9)}
    assert S.extract_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_articles_of_the_sample_match_a_plain_reading(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inner = re.search("<article>(.*?)</article>", r["html"], re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", "", x.replace("<br>", " "))).split()) for x in re.split("</?(?:p|h1)>", inner)]
        assert text(r["html"]) == "\n".join(x for x in blocks if x)


def test_events_nest():
    r = random.Random(3)
    for _ in range(300):
        source = "".join(r.choice(["<p>", "</p>", "<div>", "</div>", "<b>", "</b>", "<li>", "<ul>", "</ul>", "<td>", "<table>", "</table>", "<br/>", "x", "<script>", "</script>", "<!--", "-->", "<", ">", "&am", '"']) for _ in range(30))
        open_ = []
        for e in Page(source).events:
            if not isinstance(e, str):
                if e >= 0:
                    open_.append(e)
                else:
                    assert open_.pop() == ~e
        assert not open_


def test_near_copies_of_an_article_are_one(spark):
    part = "<ul><li>one</li><li>two</li></ul><table><tr><td>cell</td></tr></table><div>bare</div>"
    near = lambda k: f"<html><body><div>menu {k}</div><article><h1>Same</h1><time>May {k}</time><p>shared text</p>{part}<div>Advert {k}</div></article></body></html>"
    other = lambda k: f"<html><body><article><h1>T{k}</h1><p>own {k}</p><div>boilerplate</div></article></body></html>"
    rows = [(k, "http://a.example/", near(k) if k < 3 else other(k)) for k in range(10)]
    # without an article element: three near copies on a host of four pages
    plain = lambda k: f"<body><ul><li>menu {k}</li></ul><h1>Head</h1><p>a first paragraph that they share</p><p>a second one, shared as well</p><div>Ad {k}</div></body>"
    rows += [(20 + k, "http://b.example/", plain(k)) for k in range(3)] + [(23, "http://b.example/", "<body><p>another page</p></body>")]
    got = pages(spark, rows)
    for k in range(3):
        assert got[k] == f"Same\nMay {k}\nshared text\none\ntwo\ncell\nbare\nAdvert {k}"
        assert got[20 + k] == f"menu {k}\nHead\na first paragraph that they share\na second one, shared as well\nAd {k}"
    # what different articles have in common goes as before
    assert all(got[k] == f"T{k}\nown {k}" for k in range(3, 10)) and got[23] == "another page"


def telling_nothing(k, r, site="a"):
    """A page whose tags and names do not tell what is template: divs and tables all over."""
    words = lambda n: " ".join(f"{r.choice(['oak', 'elm', 'fir', 'ash'])}{r.randrange(10**6)}" for _ in range(n))
    body = [words(9), words(25), words(14)]
    page = f"<body><table><tr><td>{site} Home</td><td>{site} Contact</td></tr></table><div><div>{site} says hello to readers</div><div>{body[0]}</div><div>{body[1]}<br>{body[2]}</div><div>{site} - all rights reserved</div></div></body>"
    return page, f"{body[0]}\n{body[1]} {body[2]}"


def test_recurrence_alone_tells(spark):
    r = random.Random(4)
    rows, want = [], {}
    for k in range(60):
        page, want[k] = telling_nothing(k, r, "ab"[k % 2])
        rows.append((k, f"http://{'ab'[k % 2]}.example/{k}", page))
    assert pages(spark, rows) == want


def test_boilerplate_inside_an_article_goes_by_its_share(spark):
    notes = "<p>All of our articles are free to read for everybody.</p><p>Please tell a friend about this site.</p>"
    rows = [(k, "http://h.example/", f"<article><h1>T{k}</h1><p>own text {k}</p>{notes if k % 8 else ''}</article>") for k in range(150)]
    # the same on a host with fewer articles than TEXT_PAGES stays
    rows += [(200 + k, "http://i.example/", f"<article><h1>T{k}</h1><p>own text {k}</p>{notes}</article>") for k in range(10)]
    got = pages(spark, rows)
    assert all(got[k] == f"T{k}\nown text {k}" for k in range(150))
    assert all(got[200 + k].count("\n") == 3 for k in range(10))


def test_templates_against_brute_force(spark):
    r = random.Random(8)
    blocks = [f"<div><ul><li>item {x}</li></ul></div>" for x in range(6)] + [f"<p>passage {x}</p>" for x in range(4)]
    rows = []
    for k in range(80):
        mine = [b for x, b in enumerate(blocks) if r.random() < 0.08 * (x + 1)]
        rows.append((k, f"http://h{r.randrange(2)}.example/", f"<body><h1>T{k // 2}</h1><p>own {k // 2}</p>{''.join(mine)}</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(x["host"], x["h"]) for x in S.site_templates(df).collect()}
    articles, having = {}, {}
    for _, url, source in rows:
        o, host = S.Outline(S.Page(source)), url.split("/")[2]
        found = {h + kind for _, h, kind in o.subtrees()}
        articles.setdefault(host, set()).add(o.identity)
        for h in found:
            having.setdefault((host, h), set()).add(o.identity)
    want = {(host, h) for (host, h), ids in having.items() if len(ids) >= (S.TEXT_PAGES if h & 3 == S.NAMED_TEXT else S.LEAST_PAGES) and len(ids) >= (S.BESIDE_SHARE, S.SHARE, S.TEXT_SHARE, S.TEXT_SHARE)[h & 3] * len(articles[host])}
    assert got == want and 4 < len(want) < len(having)


def test_quotes_open_values_only_behind_an_equals_sign():
    text = lambda body: S.Outline(Page(f"<html><body><article>{body}</article></body></html>")).text()
    assert text('<p title=5">Text one is here.</p><p title=6">Text two.</p>') == "Text one is here.\nText two."
    assert text("<p>one</p><img alt=it's><p>two</p><p>three it's</p>") == "one\ntwo\nthree it's"
    assert text("""<p title="a > b" class='x>y'>one</p><p "a' b>two</p><p a = "q>r" b= 'x' c=d>three</p><p x=>four</p>""") == "one\ntwo\nthree\nfour"
    assert text('<p class="a" "b">one</p><p title="open>two</p>') == "one\ntwo"
    assert text("<a href=/x?a=b&c='d'>link</a> <a href=x/>more</a>") == "link more"


def test_only_whole_known_names_remove_from_an_article():
    text = lambda body: S.Outline(Page(f"<html><body><article>{body}</article></body></html>")).text()
    assert text('<section class="related-work"><p>kept</p></section><div class="comments-on-design"><p>kept too</p></div><p title="x class=ad">three</p>') == "kept\nkept too\nthree"
    gone = ["ad", "ad-slot", "related-articles", "share-buttons", "commentList", "sidebar left", "cookie-banner2"]
    assert text("".join(f'<div class="{c}"><p>gone</p></div>' for c in gone) + "<p>kept</p>") == "kept"
