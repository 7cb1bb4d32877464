"""HTML extraction over layouts, wide levels and deep trees."""

import random

import pytest

from tidemark.llm import html


@pytest.mark.parametrize("page", ['<div class="content has-sidebar"><article>{}</article></div>', '<main class="no-sidebar">{}</main>', '<article class="post comment-enabled">{}</article>', '<div id="widget"><div class="search"><article>{}</article></div></div>', '<div class="sidebar"><main class="menu">{}</main></div>'])
def test_a_layout_wrapper_keeps_its_article(page):
    assert html.main_text(html.parse(page.format("<p>Some text"))) == "Some text"


def test_page_parts_are_still_dropped():
    parts = '<div class="box cookie-banner">a</div><div id="comments"><article class="comment">b</article></div><div class="related"><article>c</article></div>'
    assert html.main_text(html.parse("<p>Some longer text</p>" + parts)) == "Some longer text"
    assert html.main_text(html.parse("<article>Text</article>" + parts)) == "Text"


def test_wide_levels_match_exactly():
    reference, page = "<p>a</p>" * 5 + "<div>x</div>" + "<p>b</p>" * 195, "<p>a</p>" * 19 + "<div>x</div>" + "<p>b</p>" * 230
    left, right = html.parse(page), html.parse(reference)
    pairs = html.match(html.shape(left), html.shape(right))
    assert sum(j >= 0 for j in pairs) == 202 and right[pairs[20]].tag == "div"


def test_deep_elements_stay_inside_their_parents():
    page = "<div>" * 400 + "<nav><p>menu</p></nav>text" + "</div>" * 400
    nodes = html.parse(page)
    assert html.main_text(nodes) == "text" and html.match(html.shape(nodes), html.shape(nodes)) == tuple(range(len(nodes)))


def test_matches_equal_those_of_plain_tables():
    rng = random.Random(5)

    def tree(depth):
        tag = rng.choice(["div", "span", "b"])
        return f"<{tag}>" + "".join(tree(depth - 1) for _ in range(rng.randrange(5) if depth else 0)) + f"</{tag}>"

    for _ in range(150):
        left, right = (html.parse("".join(tree(3) for _ in range(rng.randrange(1, 6)))) for _ in range(2))

        def align(a, b):
            x, y = ([c for c in n.children if not isinstance(c, str)] for n in (a, b))
            best = [[(0, [])] * (len(y) + 1) for _ in range(len(x) + 1)]
            table = [[align(c, d) if c.tag == d.tag else (0, []) for d in y] for c in x]
            for i in range(1, len(x) + 1):
                for k in range(1, len(y) + 1):
                    s, pairs = table[i - 1][k - 1]
                    old = best[i - 1][k - 1]
                    # of equal totals: without the last right node, then without the last left one
                    best[i][k] = max(best[i][k - 1], best[i - 1][k], (old[0] + s, old[1] + pairs), key=lambda t: t[0])
            total, pairs = best[-1][-1]
            return 1 + total, [(a.number, b.number), *pairs]

        got = html.match(html.shape(left), html.shape(right))
        assert sorted((i, j) for i, j in enumerate(got) if j >= 0) == sorted(align(left[0], right[0])[1])


def test_induction_finds_the_article_without_names(spark):
    """Element names, classes and roles taken away, the main slot is the same."""
    import re

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    bare = [(i, u, re.sub(r' class="[^"]*"', "", re.sub(r"<(/?)(?:article|nav|footer)\b", r"<\1div", h))) for i, u, h in rows]
    named, plain = ({r.page_id: r for r in html.extract(spark.createDataFrame(x, "page_id bigint, url string, html string")).collect()} for x in (rows, bare))
    induced = [i for i, r in plain.items() if r.induced]
    assert len(induced) > 0.8 * len(rows) and any(plain[i].n_template for i in induced)
    assert sum(plain[i].text == named[i].text for i in induced) >= 0.9 * len(induced)


def test_repeated_lines_go_and_copies_prove_nothing(spark):
    from tests.llm.conftest import prose

    line, notice = "<div>Follow us for 3 more stories</div>", "<div>Edition 7</div>"
    one = [(i, f"http://a.example/{i}", f"<body><div>{notice}<p>{prose(i, 40)}</p>{line if i % 3 else ''}<p>{prose(i + 50, 60)}</p></div></body>") for i in range(12)]
    copies = [(100 + i, f"http://b.example/{i}", f"<body><div><p>{prose(7, 40)}</p><p>{prose(8, 60)}</p></div><div>{prose(i, 3)}</div></body>") for i in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(one + copies + one[:2], "page_id bigint, url string, html string")).collect()}
    assert all(got[i] == f"{prose(i, 40)}\n{prose(i + 50, 60)}" for i in range(12))
    assert all(f"{prose(7, 40)}\n{prose(8, 60)}" in got[100 + i] for i in range(9))


@pytest.mark.parametrize("bad", ["<a '" * 20000, '<a "x' * 20000, "<" * 100_000, "<div>" * 20000 + "</b>" * 20000, "<b>" * 20000 + "<p>x" * 20000])
def test_odd_markup_is_read_in_one_pass(bad):
    import time

    began = time.time()
    html.main_text(html.parse(bad))
    assert time.time() - began < 5


def test_quotes_hold_brackets_and_open_quotes_do_not_swallow_the_page():
    assert html.main_text(html.parse('<p title="a > b">x</p><p>y</p>')) == "x\ny"
    assert html.main_text(html.parse("<p>x</p><p title='open>y</p><p>z</p>")) == "x\ny\nz"
    assert html.main_text(html.parse("1 < 2 <3 and <p>x")) == "1 < 2 <3 and\nx"


PAGE = "page_id bigint, url string, html string"


def texts_of(spark, pages):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(pages, PAGE)).collect()}


def test_varying_sentences_and_headings_of_articles_stay(spark):
    from tests.llm.conftest import prose

    def article(i):
        report = f"On day {i} a crowd of {1000 + 7 * i} people came to the old stadium by the river to see the match between the two teams of the town which was won at the very end by {['Ann', 'Bob', 'Cy'][i % 3]} alone"
        return [prose(i, 40), "Background", f"The index closed at {8857 + i} points today, {91 + i} more than yesterday.", report, prose(i + 100, 50)]

    def page(i, wrap):
        a, h, s, r, b = article(i)
        body = f"<p>{a}</p><h2>{h}</h2><p>{s}</p><p>{r}</p><p>{b}</p>"
        return f"<body><div><ul><li>Home</li><li>World</li></ul></div>{wrap.format(body)}<div>All rights reserved</div></body>"

    pages = [(i, f"http://a.example/{i}", page(i, "<article>{}</article>")) for i in range(20)]
    pages += [(100 + i, f"http://b.example/{i}", page(i, "<div>{}</div>")) for i in range(20)]
    got = texts_of(spark, pages)
    assert all(got[k + i] == "\n".join(article(i)) for i in range(20) for k in (0, 100))


def test_what_most_pages_say_goes_even_if_the_reference_page_does_not(spark):
    from tests.llm.conftest import prose

    notice = " ".join(f"word{i}" for i in range(36)) + "."
    other = "A text of its own that stands at the place of the notice on this page."

    def page(i, inside):
        return f"<body><div>Menu</div><div><p>{prose(i, 40)}</p>{inside}<p>{prose(i + 50, 60)}</p></div></body>"

    pages = [(i, f"http://a.example/{i}", page(i, f"<section>{notice}</section>" if i else "")) for i in range(20)]
    pages += [(100 + i, f"http://b.example/{i}", page(i, f"<div>{notice if i else other}</div>")) for i in range(20)]
    got = texts_of(spark, pages)
    assert all(got[k + i] == f"{prose(i, 40)}\n{prose(i + 50, 60)}" for i in range(1, 20) for k in (0, 100))
    assert got[100] == f"{prose(0, 40)}\n{other}\n{prose(50, 60)}"


def test_random_templates(spark):
    """Pages made from templates without names give back what was put into their slots."""
    from tests.llm.conftest import prose

    rng, pages, want = random.Random(12), [], {}
    for host in range(12):
        fixed = [f"{prose(1000 * host + k, rng.randint(1, 30))} {host}" for k in range(6)]
        tag, around = rng.choice(["div", "section"]), rng.choice(["div", "center"])
        places = {rng.randrange(3): fixed[k] for k in (3, 4)}
        heading = rng.random() < 0.7
        for i in range(15):
            number = 1000 * host + i
            body, text = "", []
            for k in range(3):
                if k in places:
                    body += f"<div>{places[k]}</div>"
                if heading and k == 1:
                    body += "<h3>In <b>short</b></h3>"
                    text.append("In short")
                for x in range(rng.randint(1, 3)):
                    words = prose(9 * number + 3 * k + x + 77, rng.randint(20, 60)) + f" no. {number}{k}{x}"
                    body += f"<p><i>{words[:5]}</i>{words[5:]}</p>"
                    text.append(words)
            html_ = f"<body><{around}>{fixed[0]}</{around}><div><ul>" + "".join(f"<li>{w}</li>" for w in fixed[1].split()) + f"</ul></div><{tag}>{body}</{tag}><{around}><p>{fixed[2]}</p></{around}></body>"
            pages.append((number, f"https://h{host}.example/{i}", html_))
            want[number] = "\n".join(text)
    assert texts_of(spark, pages) == want


@pytest.mark.parametrize("n", [5, 12])
def test_many_pairs_match_as_few_do(n, monkeypatch):
    rng = random.Random(n)

    def page():
        return "<ul>" + "".join("<li>" + "".join(f"<{t}>x</{t}>" for t in rng.choices(["b", "i", "em"], k=rng.randint(0, 4))) + "</li>" for _ in range(n)) + "</ul>"

    for _ in range(30):
        left, right = (html.shape(html.parse(page())) for _ in range(2))
        found = []
        for together, cells in ((1, 7), (10**9, 1)):
            monkeypatch.setattr(html, "TOGETHER", together)
            monkeypatch.setattr(html, "CELLS", cells)
            html.match.cache_clear()
            found.append(html.match(left, right))
        assert found[0] == found[1]


def test_long_lists_of_differing_items_take_little_time():
    import time

    def page(seed):
        rng = random.Random(seed)
        return "<ul>" + "".join("<li>" + "".join(f"<{t}>x</{t}>" for t in rng.choices(["b", "i", "em", "a", "u"], k=rng.randint(3, 9))) + "</li>" for _ in range(800)) + "</ul>"

    left, right = (html.shape(html.parse(page(k))) for k in (1, 2))
    began = time.process_time()
    html.match(left, right)
    assert time.process_time() - began < 2
