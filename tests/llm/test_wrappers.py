import html as escapes
import re

from binledger.llm import catalog, markup, wrappers
from binledger.llm.markup import align, fold, merge, parse, pattern, shape


def plain(source):
    """The article of the table's pages, which have one article element, read without any tree."""
    body = re.search(r"(?s)<article>(.*?)</article>", source)[1]
    blocks = re.split(r"</?(?:p|h\d|div|ul|ol|li|blockquote)\b[^>]*>", body)
    blocks = [" ".join(escapes.unescape(re.sub(r"<[^>]*>", " " if "<br" in b else "", b)).split()) for b in blocks]
    return "\n".join(b for b in blocks if b)


def test_articles_of_the_table(spark, sf_dir):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rows = catalog.op2_html_extraction(spark, sf_dir).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, plain(pages[r.page_id].html), len(r.text))


def test_sites_of_other_shapes(spark):
    def page(i):
        paragraphs = "".join(f"<p>Paragraph {i}.{j} has <em>some</em> words &amp; more&nbsp;of\n them.</p>" for j in range(1 + i % 4))
        return (
            f"<html><head><title>x</title><style>p{{}}</style></head><body><header class='site'>Site name<h1>Daily</h1></header>"
            f"<div id=menu><a href=/>Home</a> <a href=/b>News</a></div><div class='layout'><div class='post-content'><h2>Title {i}</h2>"
            f"{paragraphs}{'<blockquote>Quote %d</blockquote>' % i if i % 3 == 0 else ''}<div class='ad-box'>Buy {i}!</div>"
            f"<ul><li>One {i}<li>Two {i}</ul></div><div class=sidebar><p>Other story {i}</p></div></div>"
            f"<section id=comments><p>Reader {i} says hi</p></section><form>Search</form><footer>All rights</footer>"
            f"<script>var a = '<p>no</p>';</script></body></html>"
        )

    def want(i):
        lines = [f"Title {i}"] + [f"Paragraph {i}.{j} has some words & more of them." for j in range(1 + i % 4)]
        return "\n".join(lines + [f"Quote {i}"] * (i % 3 == 0) + [f"One {i}", f"Two {i}"])

    rows = [(i, "http://s.example/%d" % i, page(i), "x") for i in range(60)]
    rows += [(100, None, None, "y"), (101, "", "", "y"), (102, "http://t.example/", "just <b>text</b> &lt;here", "y"),
             (103, "http://t.example/2", "<article><p>a<p>b<div>c", "y"), (103, "http://t.example/2", "<article><p>a<p>b<div>c", "y"),
             (104, "http://u.example/", "<<>< " + "<div>" * 300 + "deep" + "<p>" + "long " * 50_000, "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string").repartition(4)
    got = wrappers.main_texts(pages).collect()
    by = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    for i in range(60):
        assert by[i] == want(i)
    assert by[100] == by[101] == "" and by[102] == "just text <here" and by[103] == "a\nb\nc"
    assert by[104].split("\n")[-1] == ("long " * 50_000).strip()
    assert wrappers.main_texts(pages.limit(0)).count() == 0


def test_patterns_are_union_free_and_cover_their_pages():
    a = pattern(parse("<div><h2>A</h2><p>1</p><p>2</p><h2>B</h2><p>3</p></div>"))
    div = a[3][1][0]
    assert [i[0] for i in div[3][1]] == ["g"] and div[3][1][0][2] == 1  # (h2 p+)+
    b = pattern(parse("<div><h2>A</h2><p>1</p></div><hr><ul><li>x<li>y</ul>"))
    both = merge(a, b)
    ul = [i for i in both[3][1] if shape(i) == "eul"][0]
    assert ul[1] == 1 and ul[3][1][0][2] == 1
    assert fold([["t", 0, 0, [1, 1, 0, "a"]]]) == [["t", 0, 0, [1, 1, 0, "a"]]]
    assert align([], div[3][1])[0][1] == 1


def texts(spark, sources, host="http://s.example/"):
    rows = [(i, f"{host}{i}", source) for i, source in enumerate(sources)]
    found = wrappers.main_texts(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)).collect()
    return [r.text for r in sorted(found, key=lambda r: r.page_id)]


def test_nothing_beside_the_largest_child_is_lost(spark):
    body = [f"Long body {i} " + f"word{i} " * 80 + "end" for i in range(12)]
    got = texts(spark, [
        f"<body><div class=nav>Menu</div><div class=slogan>All the same</div><div class=content><h1>Title {i}</h1><div class=lead>Lead {i}</div>"
        f"<div class=text><p>{body[i]}</p><p>More {i}</p></div></div></body>" for i in range(12)
    ])
    assert got == [f"Title {i}\nLead {i}\n{body[i]}\nMore {i}" for i in range(12)]


def test_all_articles_side_by_side_are_extracted_in_order(spark):
    got = texts(spark, [
        f"<body><div><article class=story><p>{f's{i} ' * 300}</p></article></div><p>Beside</p><article class=analysis><p>{f'a{i} ' * 250}</p></article>"
        f"<article class=brief>Brief {i}</article></body>" for i in range(8)
    ])
    assert got == [f"{(f's{i} ' * 300).strip()}\n{(f'a{i} ' * 250).strip()}\nBrief {i}" for i in range(8)]
    got = texts(spark, [
        f"<main><h1>Title {i}</h1><article><p>{f'b{i} ' * 300}</p></article></main>" for i in range(8)
    ])
    assert got == [f"Title {i}\n{(f'b{i} ' * 300).strip()}" for i in range(8)]


def test_long_blocks_that_differ_late_are_kept(spark):
    start = "The same opening words of every story of this site " * 5
    got = texts(spark, [f"<div class=content><h2>Title {i}</h2><p>Same line</p><div>{start}{i}</div></div>" for i in range(30)])
    assert got == [f"Title {i}\n{start}{i}" for i in range(30)]
    both = [f"{start}a", f"{start}b"]  # one opening, two endings, each on many pages
    got = texts(spark, [f"<div class=content><h2>Title {i}</h2><div>{both[i % 2]}</div></div>" for i in range(30)])
    assert got == [f"Title {i}\n{both[i % 2]}" for i in range(30)]


def test_copies_of_a_page_are_one_page(spark):
    copy = "<div class=content><h2>Copied</h2><p>One block</p><blockquote>Only here</blockquote><pre>code</pre></div>"
    others = [f"<div class=content><h2>Title {i}</h2><p>Text {i}</p></div>" for i in range(20)]
    whole = "Copied\nOne block\nOnly here\ncode"
    assert texts(spark, [copy] * 9 + others) == [whole] * 9 + [f"Title {i}\nText {i}" for i in range(20)]
    assert texts(spark, [copy] * 7) == [whole] * 7
    rare = [f"<div class=content><h2>Title {i}</h2><p>Text {i}</p>{'<pre>rare</pre>' if i < 6 else ''}</div>" for i in range(20)]
    assert texts(spark, rare) == [f"Title {i}\nText {i}" + "\nrare" * (i < 6) for i in range(20)]


def test_copies_count_once_when_joined_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BROADCAST_COPIES", 0)
    pages = [f"<div><h2>Slogan</h2><p>Text {i}</p></div>" for i in range(6) for _ in range(3)]
    assert texts(spark, pages) == [f"Text {i}" for i in range(6) for _ in range(3)]
    assert texts(spark, pages[:12]) == [f"Slogan\nText {i}" for i in range(4) for _ in range(3)]


def texts_of(node):
    return [t for c in node.children for t in ([c.text] if isinstance(c, markup.Text) else texts_of(c))]


def test_deep_pages_keep_their_text_in_order(spark):
    html = "<article>" + "".join(f"<div>a{i} " for i in range(3000)) + "".join(f"b{i}</div> " for i in range(3000)) + "</article>after"
    words = " ".join(texts_of(markup.parse(html))).split()
    assert words == [f"a{i}" for i in range(3000)] + [f"b{i}" for i in range(3000)] + ["after"]
    docs = spark.createDataFrame([(1, "http://h/x", html), (2, "http://h/y", "<div>" * 1500 + "text")], "page_id long, url string, html string")
    got = {r.page_id: r.text.split() for r in wrappers.main_texts(docs).collect()}
    assert got[1] == words[:-1] and got[2] == ["text"]


def test_optional_tags_and_foreign_elements():
    def words(html):
        return " ".join(texts_of(markup.parse(html)))

    assert words("<html><head><title>T</title><article><p>Body text</p></article>") == "Body text"
    assert words("<head><meta x><script>'<div>'</script><style>p</style><body>x") == "x"
    assert words("<head><title>T</title> </head><p>x") == "x"
    assert words("<article>a <svg class=i/> b <svg><svg/><g>no</g></svg> c</article>") == "a b c"
    assert words("<p>for <math><mi>x</mi></math> holds") == "for x holds"


def test_buttons_are_no_text(spark):
    html = "<article><p>One <button>Subscribe</button></p><p>Two</p></article>"
    docs = spark.createDataFrame([(1, "http://h/x", html)], "page_id long, url string, html string")
    assert wrappers.main_texts(docs).first().text == "One\nTwo"
