import random
from itertools import combinations

import pytest

from findrift.llm import wrappers as w

HEAD = "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body>"


def rules(*pages):
    out = None
    for p in pages:
        one = w.shape(w.parse(p))
        out = one if out is None else w.align(out, one)
    return w.Rules.load(w.Rules(w.load(w.dump(out))).dump())


def test_article_among_the_rest():
    page = HEAD + (
        "<nav><ul><li><a href=/a>Home</a></li><li><a>Two</a></li></ul></nav><!-- <p>no</p> --><div class='ad'>Buy</div>"
        "<article><h1>Title &amp; more</h1><p><b>One<br><p>Two   <i>x</i>\n&eacute;</p><div class=share-box>Share</div>"
        "<ul><li>a<li>b</ul><section id=comments-12><p>Great post</p></section><form><p>Name</p></form></article>"
        "<aside><p>Other</p></aside><footer>&copy; me</footer></body></html>"
    )
    assert rules(page).text(page) == "Title & more\nOne\nTwo x é\na\nb"


def test_slots_repeats_and_options():
    def page(title, paragraphs, notice):
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        extra = f"<div class='x-box'>{notice}</div>" if notice else ""
        return f"{HEAD}<div id=top>Site name</div><div class=wrap><h2>{title}</h2>{extra}{body}<p>All rights kept</p></div></body></html>"

    pages = [page("A", ["one is long enough", "two"], "n1"), page("B", ["three"], ""), page("C", ["four", "five", "six words"], "")]
    shapes = [w.shape(w.parse(p)) for p in pages]
    wrapper = w.align(w.align(shapes[0], shapes[1]), shapes[2])
    body = wrapper.kids[0].kids[1]
    div = body.kids[1]
    assert [(k.tag, k.many, k.maybe) for k in div.kids] == [("h2", False, False), ("div", False, True), ("p", True, False)]
    assert body.kids[0].kids[0].string == "Site name" and div.kids[0].kids[0].string is None
    r = rules(*pages)
    assert r.text(pages[1]).split("\n")[:2] == ["B", "three"]
    assert "Site name" not in r.text(pages[0])


def test_order_of_pages_does_not_change_the_verdict():
    a = HEAD + "<main><p>x</p></main><footer>f</footer></body></html>"
    b = HEAD + "<header>h</header><main><h1>t</h1><p>y</p><p>z</p></main></body></html>"
    assert rules(a, b).text(b) == rules(b, a).text(b) == "t\ny\nz"
    assert rules(a, b).text(a) == "x"


def test_a_page_unlike_its_host():
    a = HEAD + "<article><p>x</p></article></body></html>"
    b = HEAD + "<div class=nav>menu</div><div class=post><p>y</p></div></body></html>"
    assert rules(a, a, b).text(b) == "y"


@pytest.mark.parametrize("page", ["", "   ", "<", "<p", "plain", "<!--", "</div></p>", "<p>" * 3000, "<script>var a", "a<b>c</i>d"])
def test_broken_pages(page):
    r = rules(page) if page else w.Rules(None)
    assert isinstance(r.text(page), str)


def test_copies_of_one_page_keep_their_text():
    page = HEAD + "<article><h1>same</h1><p>text</p></article></body></html>"
    assert rules(page, page, page, page).text(page) == "same\ntext"


def test_in_spark(spark):
    def page(i):
        return f"{HEAD}<nav>m</nav><article><h1>T{i}</h1>" + "".join(f"<p>p{i} {k}</p>" for k in range(i % 5 + 1)) + "</article></body></html>"

    rows = [(i, f"http://H{i % 3}.org:80/{i}", page(i), 1, "x") for i in range(60)]
    rows += [(None, None, page(1), 1, "x"), (70, "http://h1.org/z", None, 1, "x"), (71, "no address", "", 1, "x"), (3, "http://h0.org/3", page(3), 1, "x")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, host int, rules string")
    got = w.extract(df.repartition(5)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["page_id"] is not None and r["page_id"] < 60:
            i = r["page_id"]
            assert r["text"] == "\n".join([f"T{i}"] + [f"p{i} {k}" for k in range(i % 5 + 1)])
            assert r["n_chars"] == len(r["text"])
        if r["page_id"] in (70, 71):
            assert r["text"] == "" and r["n_chars"] == 0
    assert w.infer(df).count() == 4
    assert w.extract(df.where("1 = 0")).count() == 0


def test_unmarked_pages_keep_all_of_their_text():
    def page(i):
        long = "".join(f"<p>{i} {k} a long paragraph of the page's own</p>" for k in range(12))
        return (
            f"{HEAD}<h1>Head {i}</h1><p>Lead {i}</p><div class=a><p>First {i}</p><div class=b>{long}</div></div>"
            f"<div class=sidebar><p>Side {i}</p></div></body></html>"
        )

    got = rules(*map(page, range(5))).text(page(2)).split("\n")
    assert got[:3] == ["Head 2", "Lead 2", "First 2"] and len(got) == 15


def test_copies_with_different_adverts_keep_their_text():
    def page(i, wrap, tail=""):
        return f"{HEAD}<div class=advert>Buy {i}</div><{wrap}><h1>same</h1><pre>block</pre></{wrap}>{tail}</body></html>"

    copies = [page(i, "article") for i in range(5)]
    assert rules(*copies).text(copies[0]) == "same\nblock"
    unnamed = [page(i, "article", f"<div class=x>Offer {i}</div>") for i in range(5)]
    assert rules(*unnamed).text(unnamed[0]).startswith("same\nblock")
    plain = [page(i, "div") for i in range(5)]
    assert rules(*plain).text(plain[0]) == "same\nblock"


def test_three_copies_and_another_page():
    p = HEAD + "<div class=x><h2>Shared head</h2><p>one</p></div></body></html>"
    q = HEAD + "<div class=x><h2>Shared head</h2><p>two</p></div></body></html>"
    assert rules(p, p, p, q).text(p) == "Shared head\none"


def test_a_block_of_some_pages_is_not_template():
    def page(i):
        extra = "<blockquote>quoted thrice</blockquote>" if i < 3 else ""
        return f"{HEAD}<div class=foo>Site</div><h2>T{i}</h2>{extra}<p>p{i}</p></body></html>"

    pages = [page(i) for i in range(9)]
    assert rules(*pages).text(pages[1]) == "T1\nquoted thrice\np1"
    assert rules(*pages).text(pages[5]) == "T5\np5"


def test_texts_that_begin_alike_are_not_template():
    opening = "The same standard opening of every notice. " * 8

    def page(i):
        return f"{HEAD}<div class=foo>{opening}</div><div class=x><p>{opening}number {i}</p></div></body></html>"

    pages = [page(i) for i in range(5)]
    assert rules(*pages).text(pages[3]) == f"{opening}number 3"


def test_a_host_with_unique_ids(spark):
    def page(i):
        slug = "".join(chr(97 + int(c)) for c in str(i))
        return (
            f"{HEAD}<div id=head-{slug}>Our journal</div><div class='x cat-{slug}' id=my-{slug}>"
            f"<h2>T{i}</h2><p>p{i}</p><p>q{i}</p></div></body></html>"
        )

    def sizes(n):
        df = spark.createDataFrame([(i, f"http://one.org/{i}", page(i)) for i in range(n)], "page_id int, url string, html string")
        got = {r["page_id"]: r["text"] for r in w.extract(df.repartition(4)).collect()}
        assert got == {i: f"T{i}\np{i}\nq{i}" for i in range(n)}
        return [len(r["rules"]) for r in w.infer(df).collect()]

    assert sizes(12) == sizes(120)


def test_copies_in_spark(spark):
    p = HEAD + "<div class=x><h2>Shared head</h2><p>one</p></div></body></html>"
    q = HEAD + "<div class=x><h2>Shared head</h2><p>two</p></div></body></html>"
    rows = [(i, f"http://{h}.org/{i}", x) for h in "ab" for i, x in enumerate([p, p, p, q])]
    rows += [(9, "http://b.org/z", q.replace("two", "three")), (9, "http://a.org/e", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {(r["url"], r["text"]) for r in w.extract(df.repartition(3)).collect()}
    assert ("http://a.org/0", "Shared head\none") in got and ("http://b.org/0", "one") in got
    assert ("http://b.org/z", "three") in got and ("http://a.org/e", "") in got


def test_deep_pages():
    def page(depth):
        inner = "<div>" * depth + "<p>deep</p><aside>no</aside><div class=comments>no</div>" + "</div>" * depth
        return f"{HEAD}<div class=page><article><h1>t</h1>{'<b>' * depth}{inner}<p>rest</p></article><p>after</p></div></body></html>"

    for depth in (1, 250, 5000):
        assert w.Rules(None).text(page(depth)) == "t\ndeep\nrest"


def test_deep_pages_in_spark(spark):
    def page(i):
        return f"{HEAD}<div class=x><h2>Site</h2>{'<div>' * 1500}<p>deep {i}</p>{'</div>' * 1500}</div></body></html>"

    df = spark.createDataFrame([(i, "http://deep.org/", page(i)) for i in range(4)], "page_id int, url string, html string")
    assert {(r["page_id"], r["text"]) for r in w.extract(df).collect()} == {(i, f"deep {i}") for i in range(4)}


def test_common_places_against_all_subsequences():
    def longest(a, b):
        for n in range(min(len(a), len(b)), 0, -1):
            if {tuple(a[i] for i in c) for c in combinations(range(len(a)), n)} & {tuple(b[i] for i in c) for c in combinations(range(len(b)), n)}:
                return n
        return 0

    draw = random.Random(3)
    for _ in range(400):
        a, b = ([draw.choice("abc") for _ in range(draw.randrange(8))] for _ in "ab")
        got = w.common_places(a, b)
        assert len(got) == longest(a, b) and all(a[i] == b[j] for i, j in got)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(got, got[1:], strict=False))


def test_votes_keep_a_majority_in_any_order():
    draw = random.Random(5)
    for _ in range(200):
        said = ["x"] * 6 + [draw.choice("yz") for _ in range(5)]
        draw.shuffle(said)
        texts = [w.Text(s, s) for s in said]
        while len(texts) > 1:
            a, b = (texts.pop(draw.randrange(len(texts))) for _ in "ab")
            a.vote(b)
            texts.append(a)
        assert (texts[0].digest, texts[0].seen) == ("x", 11) and texts[0].string is None


def plain(i, kinds=3):
    """An unmarked page: nothing tells the site's name, the line below it and the last line but that all pages have them."""
    extra = f"<div class=k><b>Note {i}</b></div>" if i % kinds == 1 else ""
    body = "".join(f"<p>par {i} {k}</p>" for k in range(i % 4 + 1))
    page = f"{HEAD}<div class=a>Site name here</div><div class=b><h2>T{i}</h2>{extra}{body}</div><div class=c>All rights kept</div></body></html>"
    own = [f"T{i}", *([f"Note {i}"] if extra else []), *[f"par {i} {k}" for k in range(i % 4 + 1)]]
    return page, "\n".join(own)


def extracted(spark, pages, parts=4):
    df = spark.createDataFrame([(i, f"http://{h}/{i}", p) for i, (h, p) in enumerate(pages)], "page_id int, url string, html string")
    return [r["text"] for r in sorted(w.extract(df.repartition(parts)).collect(), key=lambda r: r["page_id"])]


def test_one_odd_page_changes_nothing(spark):
    pages = [plain(i) for i in range(200)]
    rows = [("big.org", p) for p, _ in pages] + [("big.org", "<p>503 try later</p>"), ("big.org", "  "), ("big.org", None)]
    got = extracted(spark, rows, 7)
    assert got == [t for _, t in pages] + ["503 try later", "", ""]
    # without the template the same pages say more
    assert "Site name here" in w.Rules(None).text(pages[0][0])


def test_a_text_of_some_kinds_of_pages_is_the_templates_by_share(spark):
    def page(i):
        site = "Site" if i % 20 else "Our site, renewed"
        return f"{HEAD}<div class=a>{site}</div><div class=b><h2>T{i}</h2><p>p{i}</p></div></body></html>"

    got = extracted(spark, [("h.org", page(i)) for i in range(100)])
    assert got == [f"T{i}\np{i}" if i % 20 else f"Our site, renewed\nT{i}\np{i}" for i in range(100)]


def test_template_against_counting_all_pages(spark):
    """Brute force: align the pages of each host one by one, then look at each page for each text."""
    draw = random.Random(11)

    def page(i, host):
        blocks = [f"<div class=a>Site {host}</div>", f"<div class=b><h2>T{i}</h2><p>p{i}</p></div>", f"<pre>Terms of {host}</pre>"]
        if draw.random() < 0.3:
            blocks.insert(1, f"<div class=x>{draw.choice(['Offer', 'News'])}</div>")
        if draw.random() < 0.05:
            blocks.pop(0)
        if draw.random() < 0.02:
            blocks[-1] = "<pre>Other terms</pre>"
        return HEAD + "".join(blocks) + "</body></html>"

    rows = [(h, page(i, h)) for i in range(60) for h in ("one.org", "two.org", "three.org")]
    want = []
    for h, p in rows:
        found = [w.blocks(w.parse(q)) for g, q in rows if g == h]
        here = [dict((path, s) for path, _, s in f) for f in found]
        template = set()
        for path in {x for f in here for x in f}:
            said = [f[path] for f in here if path in f]
            for s in set(said):
                if said.count(s) >= 3 and 100 * said.count(s) >= w.SHARE * len(said) and 2 * said.count(s) >= len(here):
                    template.add((path, s))
        want.append("\n".join(s for path, _, s in w.blocks(w.parse(p)) if (path, s) not in template))
    assert extracted(spark, rows, 5) == want


def test_wrappers_stay_small_however_pages_differ():
    draw = random.Random(2)

    def page(i):
        kids = "".join(f"<div class={draw.choice('abcdefghij')}{draw.choice('klmnopqrst')}>x{i}</div>" for _ in range(12))
        return f"{HEAD}<div class=site>Site</div>{kids}</body></html>"

    def size(n):
        tree = w.merged([w.shape(w.parse(page(i))) for i in range(n)])
        marks = []
        w.outline(tree, [], marks)
        assert ("Site" in {k.shown for _, k in w.candidates(tree)}) and tree.seen == n
        return len(marks)

    assert size(600) < w.KEEP * size(1)


def test_empty_and_lone_hosts(spark):
    pages = [plain(i) for i in range(2)]
    got = extracted(spark, [("a.org", pages[0][0]), ("a.org", pages[1][0]), ("b.org", "")])
    assert got[0].startswith("Site name here\nT0") and got[2] == ""
