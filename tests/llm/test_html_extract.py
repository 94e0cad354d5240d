import pytest

from winnow.llm import html_extract as X

CASES = {
    "": "", "plain <3 text &amp; more": "plain <3 text & more",
    "<p>a<p>b<ul><li>c<li>d</ul>": "a b c d",
    "<nav>menu</nav><div class='post-12'><h2>T</h2><p>Hello <b>wor</b>ld&nbsp;x</p>"
    "<div id=comments><p>nice</p></div></div><div class='side sidebar'>s</div>": "T Hello world x",
    "<script>var a='<p>x</p>'</script><style>p{}</style><p>y": "y",
    "<main><article><section><p>aaaaaaaa</p></section><section><p>bb</p></section></article>"
    "<aside>n</aside></main><footer>z</footer>": "aaaaaaaa bb",
    "<header>site</header><article><header><h1>T</h1></header><p>x y</p></article>": "T x y",
    "<div class=cookie-notice>We use</div><p>text</p><form>Name <input></form>": "text",
    "<div class='ad'>Buy</div><div><p>one</p><p>two <br>three</p></div>": "one two three",
    "<article><p>unclosed <i>it": "unclosed it",
    "<div hidden>q</div><p>r</p><!-- c --> s": "r s",
    "<a title='a>b' href=x>link</a> text": "link text",
    "<p>a</p>b <!-- c": "a b", "<p>a</p><i b": "a <i b", "<p>a <!-- b > c": "a",
}


@pytest.mark.parametrize("page", CASES)
def test_one_page(page):
    nodes, pieces = X.parse(page)
    assert X.text_of(nodes, pieces, None) == CASES[page]


def test_tags_that_never_end_are_read_once():
    nodes, pieces = X.parse("<p>x</p>" + "<a " * 50_000)
    assert X.text_of(nodes, pieces, None) == "x " + "<a " * 49_999 + "<a"


def test_host_consensus_beats_a_page_of_its_own(spark):
    # most pages of the host keep their text in .body; one has a longer box elsewhere
    page = "<article class='body{i}'><p>{text}</p></article><div class='bio'><p>{bio}</p></div>"
    rows = [(i, f"https://h.example/{i}", page.format(i=i, text="good text " * 9, bio="me"))
            for i in range(8)]
    rows.append((8, "https://u@H.example:80/8", page.format(i=3, text="short", bio="me " * 60)))
    rows += [(9, "https://other.example", "<p>else</p>"), (10, None, None), (11, "x", ""),
             (None, None, "<p>no host</p>"), (0, rows[0][1], rows[0][2])]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn(
        "text", pages_text()).repartition(3)
    got = {(r.page_id, r.url): r.text for r in X.extract(pages).collect()}
    assert got[8, "https://u@H.example:80/8"] == "short"
    assert got[9, "https://other.example"] == "else" and got[None, None] == "no host"
    assert got[10, None] == "" and got[11, "x"] == ""
    assert X.extract(pages).count() == len(rows) and X.extract(pages.limit(0)).count() == 0


def pages_text():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_shuffled_hosts_give_the_same(spark, sf, monkeypatch):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = sorted(map(tuple, X.extract(pages).collect()))
    monkeypatch.setattr(X, "HOSTS_BROADCAST", 0)
    assert sorted(map(tuple, X.extract(pages).collect())) == want


NOISE_WORDS = {
    "<main class='overflow-hidden'><p>a b</p></main>": "a b",
    "<div class='content no-sidebar'><p>a b</p></div>": "a b",
    "<body><div id='page' class='has-header'><p>a</p><div class='sidebar-left'>s</div></div>": "a",
    "<article class='post with-comments'><p>a b</p><div class=comments>c</div></article>": "a b",
    "<article class='comments-open'><p>a b</p></article>": "a b",
    "<div class='sidebar-right'><h1>T</h1><p>long text</p><div class=sidebar>s</div></div>"
    "<p>x</p>": "T long text x",
    "<div class=site-footer>f</div><p>long text</p>": "long text",
}
NO_ARTICLE = {
    "<main><section><h2>A</h2><div><p>aaaaaaaa</p></div></section><section class=x><h2>B</h2>"
    "<div><p>bb</p></div></section></main>": "A aaaaaaaa B bb",
    "<main><section><p>" + "a" * 90 + "</p></section><section><p>b</p></section></main>":
        "a" * 90 + " b",
    "<div><div class=a><div><p>aaaa</p></div></div><div class=b><div><p>bbb</p></div></div></div>":
        "aaaa bbb",
    "<div><section><p>" + "a" * 90 + "</p></section><section><p>b</p></section></div>":
        "a" * 90 + " b",
}


@pytest.mark.parametrize("page", NOISE_WORDS)
def test_words_inside_other_classes_drop_nothing(page):
    assert X.text_of(*X.parse(page), None) == NOISE_WORDS[page]


@pytest.mark.parametrize("page", NO_ARTICLE)
def test_sections_without_article_are_whole(page):
    assert X.text_of(*X.parse(page), None) == NO_ARTICLE[page]


WHOLE = {
    # a server-side form around the page, and forms that are never closed
    "<form action=x><div class=nav>m</div><div><h1>T</h1><p>long text here</p></div></form>":
        "T long text here",
    "<div><p>first part of the text</p></div><form><input><p>second part</p>":
        "first part of the text second part",
    "<p>long enough text</p><form>Name <input></form>": "long enough text",
    # a menu that is never closed ends at the next part of the text
    "<nav><ul><li><a>m</a></ul><main><p>a b</p></main>": "a b",
    "<nav><ul><li><a>m</a></ul><h1>T</h1><div>x y</div>": "T x y",
    "<div><aside>note <p>a</p></div><p>b c d e</p>": "a b c d e",
    # articles beside each other, whatever their classes; one inside another counts once
    "<article class='post first'><p>aaaaaa</p></article><article class=post><p>b</p></article>":
        "aaaaaa b",
    "<article class=a><p>xx</p><article class=b><p>yyyy</p></article></article><p>z</p>": "xx yyyy",
    # headlines in the header of a part
    "<header>site</header><main><header><h1>T</h1></header><p>x y</p></main>": "T x y",
    "<section><header><h2>T</h2></header><p>x y</p></section>": "T x y",
    # nothing is left out for being small
    "<div class=a><p>" + "a " * 200 + "</p></div><div class=b><p>b</p></div>": "a " * 200 + "b",
    "<div><div>" + "w " * 500 + "</div></div><span>x</span>": "w " * 500 + "x",
}


@pytest.mark.parametrize("page", WHOLE)
def test_nothing_else_is_dropped(page):
    assert X.text_of(*X.parse(page), None) == WHOLE[page]


def test_deep_nesting_takes_memory_in_proportion():
    import tracemalloc

    peaks = []
    for depth in (5_000, 10_000):
        page = "<div class=a>" * depth + "text" + "</div>" * depth
        tracemalloc.start()
        nodes, pieces = X.parse(page)
        assert X.text_of(nodes, pieces, None) == "text"
        best = X.best_container(nodes)
        assert X.text_of(nodes, pieces, [best.path]) == "text"
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 3 * peaks[0] < 60_000_000


class Plain:
    """A plain extractor for well-formed pages, over a tree: what is skipped goes, then the text of
    the outermost articles beside the largest one, of main, or of all that is left."""

    SKIP = set("nav footer aside form button select menu script style".split())

    def __init__(self, page):
        from html.parser import HTMLParser

        root = self.root = ["root", "", []]
        stack = [root]

        class P(HTMLParser):
            def handle_starttag(self, tag, attrs):
                node = [tag, dict(attrs).get("class") or "", []]
                stack[-1][2].append(node)
                stack.append(node)

            def handle_endtag(self, tag):
                assert stack.pop()[0] == tag

            def handle_data(self, data):
                stack[-1][2].append(data)

        P(convert_charrefs=True).feed(page)

    def kept(self, node, part=False):
        out = []
        part = part or node[0] in ("article", "main", "section")
        for c in node[2]:
            if isinstance(c, str):
                out.append(c)
            elif not (c[0] in self.SKIP or c[0] == "header" and not part
                      or set(c[1].split()) & {"sidebar", "comments", "ad", "cookie"}):
                out.append([c[0], c[1], self.kept(c, part)])
        return out

    def words(self, kids):
        return " ".join(" ".join(c if isinstance(c, str) else f" {self.words(c[2])} "
                                 for c in kids).split())

    def found(self, kids, tag):
        out = []
        for c in kids:
            if not isinstance(c, str):
                out += [c] if c[0] == tag else self.found(c[2], tag)
        return out

    def text(self):
        kids = self.kept(self.root)
        for tag in ("article", "main"):
            hits = self.found(kids, tag)
            if hits:
                return " ".join(self.words(h[2]) for h in hits if self.words(h[2]))
        return self.words(kids)


@pytest.mark.parametrize("seed", range(60))
def test_random_pages_against_a_plain_extractor(seed):
    import random

    r = random.Random(seed)

    def words(n):
        return " ".join(f"w{r.randrange(99)}" for _ in range(n))

    def body(depth=0):
        kinds = ["<p>%s</p>", "<h2>%s</h2>", "<ul><li>%s</li></ul>", "<blockquote>%s</blockquote>"]
        out = []
        for _ in range(r.randint(1, 4)):
            if depth < 3 and r.random() < 0.35:
                tag = r.choice(["div", "div class='c%d'" % r.randrange(4), "section"])
                out.append(f"<{tag}>{body(depth + 1)}</{tag.split()[0]}>")
            else:
                out.append(r.choice(kinds) % words(r.randint(1, 12)))
            if r.random() < 0.3:
                out.append(r.choice([
                    "<nav>m n</nav>", "<aside><p>side</p></aside>", "<script>s()</script>",
                    "<div class='ad'>buy</div>", "<div class='sidebar'>side</div>",
                    "<form>Name</form>", "<section class='comments'><p>hi</p></section>"]))
        return "".join(out)

    kind = r.choice(["article", "articles", "main", "none"])
    if kind == "article":
        core = f"<article class='x{r.randrange(3)}'><p>{words(40)}</p>{body()}</article>"
    elif kind == "articles":
        core = "".join(f"<article class='k{i}'><p>{words(30)}</p>{body()}</article>"
                       for i in range(r.randint(2, 3)))
    elif kind == "main":
        core = f"<main><header><h1>{words(3)}</h1></header><p>{words(30)}</p>{body()}</main>"
    else:
        core = f"<div><p>{words(30)}</p>{body()}</div>{body()}"
    page = (f"<body><header><div>{words(2)}</div></header><nav><ul><li>m</li></ul></nav>{core}"
            f"<footer>{words(4)}</footer></body>")
    assert X.text_of(*X.parse(page), None) == Plain(page).text()
