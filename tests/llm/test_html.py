from tracemill.llm import html

LONG = "The committee met on Tuesday, and after a long debate, it agreed on the plan, which pleased most members of the town."


def test_article_of_a_plain_page():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
    <nav><ul><li><a href="/a">Home</a></li></ul></nav><!-- ad --><div class="ad">Buy, now, this, that.</div>
    <article><h1>Title &amp; more</h1><p><b>{LONG}<br>next   line<br><p>Short.</article><footer>&copy; x</footer></body></html>"""
    assert html.main_text(page) == f"Title & more\n{LONG} next line\nShort."


def test_without_article_container_and_siblings():
    page = f"""<body class="has-sidebar"><header><h1>Site</h1></header><div id="wrap"><h1>Head</h1><div class="post-content"><p>{LONG}</p><p>{LONG}</p></div>
    <div class="sidebar"><p>{LONG}</p></div><div id="comments"><p>{LONG}</p><form><p>Write, a, comment</p></form></div></div>
    <div class="cookie-notice">We use, cookies, yes</div></body>"""
    assert html.main_text(page) == f"Head\n{LONG}\n{LONG}"


def test_comments_and_menus_within_article():
    page = f"""<main><article><header><h1>Head</h1></header><p>{LONG} <button>Share</button></p><aside>Ad, ad, ad</aside>
    <ul><li><a href=x>more</a></li><li><a href=y>other</a></li></ul><ul><li>One point</li><li>Two</li></ul>
    <section class="comments"><article class="comment"><p>{LONG}</p></article></section></article></main>"""
    assert html.main_text(page) == f"Head\n{LONG}\nOne point\nTwo"


def test_common_words_in_ids_and_classes_lose_nothing():
    page = f'''<article><h1 class="banner">T</h1><h2 id="related-work">Related</h2><p id="notice-1">{LONG}</p><p class="share-price">{LONG}</p><section id="comments"><h2>Comments on the plan</h2><p>{LONG}</p></section>
    <div class="related-work"><p>{LONG}</p></div><ul><li><a href=x>One source of it</a></li></ul><ol><li><a href=a>A long reference to another paper, 1999</a></li><li><a href=b>A second reference to a book, 2001</a></li></ol>
    <div class="cookie-notice"><p>We use, cookies</p></div><p>No\xa0break&nbsp;here</p></article>'''
    want = ["T", "Related", LONG, LONG, "Comments on the plan", LONG, LONG, "One source of it", "A long reference to another paper, 1999", "A second reference to a book, 2001", "No\xa0break\xa0here"]
    assert html.main_text(page) == "\n".join(want)


def test_a_marked_container_with_most_of_the_page_stays():
    page = f'<body><div class="sidebar-left"><p>{LONG}</p><p>{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div></body>'
    assert html.main_text(page) == f"{LONG}\n{LONG}"


def test_cut_off_and_odd_pages():
    assert html.main_text(f"<article><p>{LONG}</p><p>Last &amp; words</p></artic") == f"{LONG}\nLast & words"
    assert html.main_text("<article><p>a < b &lt; c</p") == "a < b < c"
    assert html.main_text(None) == html.main_text("") == html.main_text("<p></p><scr") == html.main_text("<script>x") == ""
    assert html.main_text("plain text") == "plain text"
    assert html.main_text("<p>" * 3000 + "x" + "<div>" * 2000) == "x"


def test_table_and_nulls(spark):
    rows = [(1, "u", None), (None, None, f"<p>{LONG}"), (1, "u", ""), (1, "u", "")]
    got = html.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as text"))
    assert sorted(r["n_chars"] for r in got.collect()) == [0, 0, 0, len(LONG)]
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert html.main_texts(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_whole_table_keeps_articles(spark):
    import html as entities
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html.main_texts(pages).collect():
        body = re.search(r"<article>(.*?)(</article>|\Z)", source[r["page_id"]], re.S)
        parts = re.split(r"</?(?:p|h1)>", re.sub(r"<[^>]*\Z", "", body[1]) if body else "")
        want = [" ".join(entities.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in parts]
        assert r["text"] == "\n".join(x for x in want if x)


def test_comment_threads_of_articles():
    thread = f'<article class="comment-body"><p>{LONG}</p><p>{LONG}</p></article>'
    assert html.main_text(f'<article><p>A</p></article><section class="comments"><article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></article></section>') == "A"
    assert html.main_text(f'<main><article><p>{LONG}</p></article><section id="comments"><ol class="comment-list"><li>{thread}</li></ol></section></main>') == LONG
    assert html.main_text(f'<main><h1>T</h1><p>{LONG}</p><div class="comments">{thread}{thread}</div></main>') == f"T\n{LONG}"


def test_adverts_and_marks_within_an_article():
    for part in ('<div class="user-comments"><p>X</p></div>', '<div class="advert-slot">X</div>', '<div class="related-posts">X</div>', '<p class="advert">X</p>', '<span class="ad">X</span>'):
        assert html.main_text(f"<article><p>{LONG}</p>{part}<p>Z</p></article>") == f"{LONG}\nZ", part


def test_all_of_an_article():
    assert html.main_text(f"<article><p>{LONG}</p><h2>Refs</h2><ul><li><a href=x>Smith 2001</a></li><li><a href=y>Jones 2002</a></li></ul></article>") == f"{LONG}\nRefs\nSmith 2001\nJones 2002"
    assert html.main_text(f"<body><section><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></section><section><h2>End</h2><p>A short closing part.</p></section></body>").endswith("End\nA short closing part.")
    assert html.main_text(f"<body><article><p>{LONG}</p></article><article><p>Two, short</p></article></body>") == f"{LONG}\nTwo, short"


def test_time_follows_length():
    import time

    for part in ("<div>", "<div><p>", "<span>", '<b><div class="x">', "<p><table><div>", "<header><h1>", "<ul><li>", "</p>", "<a>"):
        start = time.time()
        html.main_text(part * 20_000 + "x")
        assert time.time() - start < 8, part  # seconds of a slow machine; a quadratic walk takes minutes


class Node:
    """A page's tree for the slow scorer, which walks all ancestors of all paragraphs."""

    def __init__(self, tag, *children):
        self.tag, self.children, self.up = tag, children, None
        for c in children:
            if isinstance(c, Node):
                c.up = self

    def html(self):
        return f"<{self.tag}>" + "".join(c.html() if isinstance(c, Node) else c for c in self.children) + f"</{self.tag}>"

    def all(self):
        yield self
        for c in self.children:
            if isinstance(c, Node):
                yield from c.all()

    def chain(self):
        return [self, *(self.up.chain() if self.up else [])]

    def text(self, linked=False, within=False):
        """All text, or that of links only."""
        within = within or self.tag == "a"
        return "".join(c.text(linked, within) if isinstance(c, Node) else c if within or not linked else "" for c in self.children)


def slow_text(body):
    """Main text of a page of div, section, p, ul, li and a, each p or li holding text and links only."""
    leaves = [n for n in body.all() if n.tag in ("p", "li")]
    under = lambda n: [x for x in leaves if n in x.chain()]
    chars = lambda n: sum(len(x.text()) for x in under(n))
    density = lambda n: sum(len(x.text(linked=True)) for x in under(n)) / chars(n) if chars(n) else 0.0

    def points(n):
        total = 0.0
        for x in leaves:
            above = x.chain()[1:]
            if n in above:
                t = x.text()
                total += (1 + t.count(",") + min(len(t) // 100, 3)) / 2 ** above.index(n)
        return total

    def score(n):
        return (points(n) + html.WEIGHTS.get(n.tag, 0)) * (1 - density(n)) if points(n) else 0.0

    order = list(body.all())
    best = max(order, key=lambda n: (round(score(n), 9), -order.index(n)))
    kept = {best}
    for n in order:
        if n is not best and best.up and n.up is best.up and chars(n):
            plain = n.tag == "p" and density(n) < 0.25 and (chars(n) > 80 or not density(n))
            part = n.tag == "section" and density(n) < 0.25 and score(n) > 0
            if score(n) >= max(10.0, 0.2 * score(best)) or plain or part:
                kept.add(n)
    out = []
    for x in leaves:
        above = x.chain()
        if not kept & set(above):
            continue
        inner = above[: next(k for k, n in enumerate(above) if n in kept)]
        menu = any(n.tag == "ul" and density(n) > 0.9 and len(under(n)) > 1 and chars(n) < 25 * len(under(n)) for n in inner)
        if not menu:
            out.append(x.text())
    return "\n".join(out)


def test_scores_against_a_slow_tree():
    import random

    rng = random.Random(11)
    words = "lorem, ipsum dolor, sit amet consectetur adipiscing elit, sed do eiusmod tempor".split()

    def prose(most):
        return " ".join(rng.choices(words, k=rng.randrange(1, most)))

    def tree(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.45:
            return Node("p", prose(40), *([Node("a", prose(12))] if rng.random() < 0.3 else []))
        if kind < 0.6:
            return Node("ul", *(Node("li", *([Node("a", prose(3))] if rng.random() < 0.7 else [prose(15)])) for _ in range(rng.randrange(1, 5))))
        return Node(rng.choice(["div", "section"]), *(tree(depth - 1) for _ in range(rng.randrange(1, 5))))

    some = 0
    for _ in range(300):
        body = Node("body", *(tree(4) for _ in range(rng.randrange(1, 5))))
        want = slow_text(body)
        assert html.main_text(body.html()) == want, body.html()
        some += want != "\n".join(n.text() for n in body.all() if n.tag in ("p", "li"))
    assert some > 50
