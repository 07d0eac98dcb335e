"""The text of pages by counts alone against a second reader, made of html.parser, plain tuples and counters."""

import random
from collections import defaultdict
from html.parser import HTMLParser

from loomgrid.llm import htmltext

SCHEMA = "page_id long, url string, html string"
PROSE = {"p", "h1", "h3", "li", "article", "main", "body", "html"}


class Node:
    def __init__(self, tag, names, up):
        self.tag, self.names, self.up, self.kids = tag, names, up, []
        self.inside = tag in ("article", "main") or (up is not None and up.inside)

    def nodes(self):
        yield self
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.nodes()

    def texts(self):
        """(text, is a link, the node) in page order."""
        for k in self.kids:
            if isinstance(k, Node):
                yield from k.texts()
            else:
                yield (*k, self)

    def size(self):
        return sum(len(t[0]) for t in self.texts())

    def words(self):
        return (self.tag, *(k.words() if isinstance(k, Node) else k[0] for k in self.kids))

    def shape(self):
        inner = dict.fromkeys(k.shape() for k in self.kids if isinstance(k, Node))
        return (self.tag, self.names, *inner)

    def holds(self):
        return any(n.tag in ("article", "main") for n in self.nodes() if n is not self)

    def running(self):
        return any(n.tag in ("p", "h1", "h3") or (n.tag == "li" and not link) for _, link, n in self.texts())


class Reader(HTMLParser):
    """Well-formed pages of block elements and links."""

    def __init__(self, page):
        super().__init__()
        self.top, self.link = Node("", (), None), False
        self.root = self.top
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        names = "".join(c for c in dict(attrs).get("class") or "" if not c.isdigit()).split()
        child = Node(tag, tuple(sorted(names)), self.top)
        self.top.kids.append(child)
        self.top = child

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        else:
            self.top = self.top.up

    def handle_data(self, data):
        self.top.kids.append((data, self.link))


def candidates(root):
    """(key, node) of every subtree that may be a template."""
    known = root.holds()
    able = [n for n in root.nodes() if n.tag not in ("", "html", "body") and not n.holds()]
    for n in able:
        if not (n.tag in PROSE and n.inside) and ((known and not n.inside) or 2 * n.size() <= root.size()):
            yield ("words", n.words()), n
    outside = [n for n in able if not n.inside]
    total = defaultdict(int)
    for n in outside:
        total[n.shape()] += n.size()
    for n in outside:
        links = sum(len(t) for t, link, _ in n.texts() if link)
        if known or (not n.running() and 2 * links >= n.size() and 2 * total[n.shape()] <= root.size()):
            yield ("shape", n.shape()), n


def plain_texts(pages):
    read = {k: (url.split("/")[2], Reader(page).root) for k, url, page in pages}
    seen = defaultdict(set)
    for host, root in read.values():
        for key, _ in candidates(root):
            seen[host, key].add(root.words())
    out = {}
    for k, (host, root) in read.items():
        gone = {id(n) for key, m in candidates(root) if len(seen[host, key]) >= htmltext.LEAST_PAGES for n in m.nodes()}
        out[k] = "\n".join(t for t, _, n in root.texts() if id(n) not in gone)
    return out


def made_pages(seed, n):
    r = random.Random(seed)
    words = lambda k: " ".join(r.choice("red green blue white black grey".split()) + str(r.randrange(50)) for _ in range(k))
    out = []
    for k in range(n):
        menu = "<div class=top><ul>" + "".join(f"<li><a href=x>{words(1)}</a></li>" for _ in range(r.randrange(2, 6))) + "</ul></div>"
        slot = f"<div class=\"slot{r.randrange(9)} box\">{words(4)}</div>" if r.random() < 0.5 else ""
        rare = f"<div class={r.choice('abcdefghij')}{r.choice('klmnopqrst')}>{words(5)}</div>"
        news = f"<section><h3>More</h3><p>{words(6)}</p></section>" if r.random() < 0.4 else "<section><p>Same on many pages</p></section>" if r.random() < 0.3 else ""
        story = f"<h1>{words(3)}</h1>" + "".join(f"<p>{words(9)}</p>" for _ in range(r.randrange(1, 5))) + r.choice(["", "<div>Share this</div>", f"<div>{words(2)}</div>", f"<ul><li>{words(3)}</li></ul>"])
        part = r.choice(["article", "main", "div", "section"])
        foot = f"<div class=foot>{r.choice(['All rights', words(3)])}</div>"
        out.append((k, f"http://h{r.choice([0, 0, 0, 1, 1, 2 + k % 4])}.example/{k}", f"<html><body>{menu}{slot}{rare}<{part}>{story}</{part}>{news}{foot}</body></html>"))
    return out


def test_counts_alone_against_a_second_reader(spark):
    for seed, n in ((1, 30), (2, 150)):
        pages = made_pages(seed, n)
        got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(pages, SCHEMA), markup=False).collect()}
        assert got == plain_texts(pages)
    whole = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(pages, SCHEMA), least=10**6, markup=False).collect()}
    # on the other pages nothing is a template: no article, no menu of mostly links apart from the rest
    assert sum(got[k] != whole[k] for k in got) >= 0.95 * n


def test_counts_choose_the_text_of_counted_hosts(spark):
    page = lambda k: f"<body><ul><li><a href=/>Item {k}</a></ul><div class=slot-{k}>Buy {k}</div><article><p>Story {k}</p><form>mail {k}</form></article><div class=foot>Foot {k}</div></body>"
    once = page(7).replace("<article>", "<section class=lead><p>Only here</p></section><div class=cookie-notice>Cookies</div><article>")
    pages = [(k, f"http://h.example/{k}", once if k == 7 else page(k)) for k in range(12)]
    df = spark.createDataFrame(pages, SCHEMA)
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(df).collect()}
    # what no other page has stays unless a rule names it; the form inside the article goes by a rule
    assert all(got[k] == ("Only here\n" if k == 7 else "") + f"Story {k}" for k in range(12))
    known = frozenset(h for r in htmltext.page_templates(df).collect() for h in r["templates"])
    assert dict(htmltext.choose(once, known)) == {"Item 7": "count", "Buy 7": "count", "Only here": "keep", "Cookies": "rule", "Story 7": "keep", "mail 7": "rule", "Foot 7": "count"}


def test_long_running_text_without_article_stays(spark):
    page = lambda k: f"<body><ul><li><a href=/>Item {k}</a></ul>" + "".join(f"<div class=t>Sentence {j} of page {k} goes on</div><ul><li>Point {j}{k} with <a href=/>one</a> link</ul>" for j in range(6)) + "</body>"
    pages = [(k, f"http://h.example/{k}", page(k)) for k in range(9)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_text(spark.createDataFrame(pages, SCHEMA), markup=False).collect()}
    assert all(got[k] == "\n".join(f"Sentence {j} of page {k} goes on\nPoint {j}{k} with one link" for j in range(6)) for k in range(9))
