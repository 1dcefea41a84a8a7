import random
import re
from collections import Counter

from strataprof.llm import html_text


PAGE = (
    "<!DOCTYPE html><html><head><title>no</title><style>p{}</style></head><body><header>Site</header><nav><ul><li>menu</ul></nav><div class='ad'>buy</div>"
    "<article><h1>T &amp; t</h1><p>One&nbsp; two<br>three<p>Four <b>x</b>y<script>var t='</p>'</script><div class='comments'><p>reader</div></article><footer>&copy; f</footer></body></html>"
)


def test_main_text():
    assert html_text.main_text(PAGE) == "T & t\nOne two three\nFour xy"
    assert html_text.main_text("<article><p>a<article class='comment'><p>b</article></article><article id=comment-2><p>c</article>") == "a"
    for bad in ("", "<", "<p", "a < b &am", "</div>x", "<div><p>a</div>b", "<!-- open", "<script>x"):
        html_text.main_text(bad)
    assert html_text.main_text("a < b &am") == "a < b &am"
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    root = html_text.parse(deep)
    html_text.hash_subtrees(root)
    assert html_text.main_text(deep) == "x"


def test_marks_and_names_that_only_look_like_chrome():
    assert html_text.main_text('<p title="a>Hi</p><p>there</p>') == "Hi\nthere"  # a quote that is never closed
    assert html_text.main_text("<p title=it's>a</p><p>don't") == "a\ndon't"
    assert html_text.main_text('<p title="a>b">c') == "c"
    text = '<article><p class="menu-of-the-day">Soup<section class="related-work"><p>Others</section><p><math><mi>y</mi></math></article>'
    assert html_text.main_text(text) == "Soup\nOthers\ny"
    assert len(html_text.main_text("<p>" + "word " * 400_000 + "<div a='" * 20_000)) == 5 * 400_000 - 1


ARTICLE = "".join(f"<p>Sentence {i} of a text that is long enough to matter" for i in range(12))
WANT = "\n".join(f"Sentence {i} of a text that is long enough to matter" for i in range(12))


def test_a_form_or_a_name_does_not_take_the_page():
    low = "<div class='cookie-notice'>We use cookies</div><form><label>Search</label><input></form>"
    for body in (
        f"<form action='/x.aspx'><nav>menu</nav><h1>T</h1><div>{ARTICLE}</div>{low}</form>", f"<div id='modal'><h1>T</h1>{ARTICLE}</div>{low}",
        f"<h1>T</h1><section class='ad-hoc'>{ARTICLE}</section>{low}", f"<h1>T</h1><div class='social-history'>{ARTICLE}</div>{low}",
        f"<h1>T</h1><div id='modal-logic'>{ARTICLE}</div>{low}", f"<h1>T</h1><div id='social-media'>{ARTICLE}</div>{low}",
    ):
        page = f"<html><body>{body}</body></html>"
        assert html_text.main_text(page) == "T\n" + WANT, body
        assert html_text.main_text(page, html_text.Template()) == "T\n" + WANT, body
    page = f"<h1>T</h1><p>Short text<div class='comments'>{ARTICLE}</div><div class='social-media'><a href=x>Post it</a> <a>Pin it</a></div>"
    assert html_text.main_text(page) == "T\nShort text"  # a block that outweighs the text, without the title
    assert html_text.main_text(f"<h1>Log in</h1><form>{ARTICLE}</form>") == "Log in"


def test_hosts_of_few_pages(spark):
    rows, want = [], {}
    for n in (1, 2, 3, 7, 8, 9):
        for i, (url, page, text) in enumerate(site(f"h{n}.example", n, random.Random(n))):
            rows.append((100 * n + i, url, page.replace("<div class=low>", "<div class='footer-links'>").replace("<div class=top>", "<div class='site-nav'>")))
            want[100 * n + i] = text
    copy = f"<html><body><div>{ARTICLE}</div></body></html>"  # two tellings of one article on a host of their own
    rows += [(1, "https://twin.example/1", copy), (2, "https://twin.example/2", copy.replace("Sentence 3", "Phrase 3"))]
    rows += [(10 + i, f"https://forms.example/{i}", f"<html><body><form><h1>T{i}</h1><div id='social-media'>{ARTICLE}<p>{i}</div></form></body></html>") for i in range(3)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    for i, text in want.items():
        assert got[i] == text or i < 200 and got[i] == text + "\nAll rights belong to us", i  # one page cannot tell what recurs
    assert got[1] == WANT and got[2] == WANT.replace("Sentence 3", "Phrase 3")
    assert all(got[10 + i] == f"T{i}\n{WANT}\n{i}" for i in range(3))


def test_templates(spark):
    box = "<div>Everything on this site is free of charge</div>"
    rows = [(i, f"https://a.example/{i}", f"<html><body>{box}<section><p>Text number {i}</section></body></html>") for i in range(20)]
    rows += [(100 + i, "https://b.example/", rows[0][2]) for i in range(20)] + [(200, None, rows[0][2]), (201, "https://a.example/x", None), (202, "nonsense", "<p>x")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert got[3] == "Text number 3"
    assert got[100] == got[200] == "Everything on this site is free of charge\nText number 0"  # copies of one page show no template
    assert got[201] == "" and got[202] == "x" and len(got) == len(rows)
    assert html_text.extract(df.limit(0)).count() == 0


def site(host, n, rng):
    """Pages without semantic tags: boxes whose texts differ on each page, a box that recurs, and prose."""
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    say = lambda k: " ".join(word() for _ in range(k))
    pages = []
    for i in range(n):
        ps = [say(rng.randint(20, 60)) for _ in range(rng.randint(2, 5))]
        comments = f"<div class='comments'><p>{say(9)}</div>" if i % 9 == 0 else ""
        top = f"<div class=top><a href=/{word()}>{word()}</a> <a>{word()}</a></div>"
        body = f"<div class=x><div class=text><h1>{say(3)}</h1>{''.join(f'<p>{p}' for p in ps)}{comments}<div>All rights belong to us</div></div></div>"
        html = f"<html><body>{top}{body}<div class=low>{say(4)}</div></body></html>"
        pages.append((f"https://{host}/{i}", html, "\n".join([html.split("<h1>")[1].split("</h1>")[0], *ps])))
    return pages


def test_the_template_decides(spark):
    rng = random.Random(3)
    rows = [(i, *p) for i, p in enumerate(site("a.example", 30, rng) + site("b.example", 25, rng))]
    df = spark.createDataFrame([(i, u, h) for i, u, h, _ in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
    assert all(got[i] == want for i, _, _, want in rows)
    assert all(html_text.main_text(h, html_text.Template()) != got[i] for i, _, h, _ in rows)


def test_counts_of_subtrees_against_brute_force(spark):
    rows = [(i, u, h) for i, (u, h, _) in enumerate(site("a.example", 12, random.Random(5)))]
    rows += [(50, rows[0][1], rows[0][2]), (51, "https://A.example/y", rows[3][2].replace("All", "No")), (52, "https://a.example/z", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    counts, hosts = html_text.subtree_counts(df)
    want, chars = Counter(), Counter()
    for html in {h for _, _, h in rows if h}:
        for k, size in html_text.hash_subtrees(html_text.parse(html)).items():
            want[k] += 1
            chars[k] += size
    assert {(r["kind"], r["key"]): (r["c"], r["chars"]) for r in counts.collect()} == {k: (c, chars[k]) for k, c in want.items()}
    assert hosts.first()["n"] == 13
    plain = Counter(x for h in {h for _, _, h in rows if h} for x in set(re.findall(r"<div>[^<]*</div>", h)))
    box = {(r["kind"], r["c"]) for r in counts.where("c in (1, 12)").collect()}
    assert plain["<div>All rights belong to us</div>"] == 12 and (html_text.BOX, 12) in box
