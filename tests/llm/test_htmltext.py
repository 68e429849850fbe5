"""Main text: what the cut decides, odd markup, and large pages."""

import itertools
import random
import re
import time
from html.parser import HTMLParser

import pytest

from strandloom.llm import htmltext


def texts_of(page):
    found = htmltext.blocks(page)
    return [(b.text, b.score > 0, good) for b, good in zip(found, htmltext.labels(found), strict=True)]


def test_the_cut_relabels_blocks_for_the_better(spark):
    """By text alone short paragraphs look like boilerplate and prose in a footer or an advert like
    content. These pages' main text is what stands in their article."""
    changed = 0
    for row in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect():
        found = htmltext.blocks(row.html or "")
        for block, good in zip(found, htmltext.labels(found), strict=True):
            assert good == block.node.inside or good == (block.node.tag == "article")
            changed += (block.score > 0) != good
    assert changed > 500


def test_neighbours_decide_without_marks():
    long = "A sentence that is long enough stands here, as in any article of some length. " * 2 + "Another one follows it and says somewhat more. And a third one ends it."
    page = f"<div><p>{long}</p><p>So it is</p><p>{long}</p></div><div><div><a href=1>One</a></div><div><a href=2>Two two</a></div><div>Three.</div><div><a href=4>Four</a></div></div>"
    got = texts_of(page)
    assert ("So it is", False, True) in got and htmltext.main_text(page) == f"{long}\n\nSo it is\n\n{long}"


@pytest.mark.parametrize("odd", ["<p class='share-price'>Kept text.</p>", '<p class="form">Kept text.</p>', "<p id=header>Kept text.</p>", "<p title=it's>Kept text.</p>", '<p><img alt=5">Kept text.</p>', "<div class='has-form'>Kept text.</div>"])
def test_marks_that_say_nothing(odd):
    page = "<body class='no-sidebar'><article><p>Before it. It is a sentence here.</p>{}<p>The rest stays. It is kept whole.</p></article>"
    assert htmltext.main_text(page.format(odd)) == "Before it. It is a sentence here.\n\nKept text.\n\nThe rest stays. It is kept whole."


@pytest.mark.parametrize("odd", ["<p class='cookie-notice'>Gone text.</p>", "<div class='adBanner'>Gone text.</div>", "<div id=comments-list><p>Gone text. It is long. It has sentences.</p></div>", "<div class='menu'>Gone text.</div>", "<div role=search>Gone text.</div>", "<p hidden>Gone text.</p>"])
def test_marks_that_count(odd):
    page = "<body class='sidebar'><article><p>Before it. It is a sentence here.</p>{}<p>The rest stays. It is kept whole.</p></article>"
    assert htmltext.main_text(page.format(odd)) == "Before it. It is a sentence here.\n\nThe rest stays. It is kept whole."


def test_a_sign_that_is_no_tag():
    start = "<article><p>It is a sentence. "
    assert htmltext.main_text(start + "If a <b and c") == "It is a sentence. If a <b and c"
    assert htmltext.main_text(start + "If a <b and c</p><p>More of it. Yes.</p>") == "It is a sentence. If a <b and c\n\nMore of it. Yes."
    assert htmltext.main_text(start + "If 1 < 2 and 3 > 2 &lt;p&gt;") == "It is a sentence. If 1 < 2 and 3 > 2 <p>"
    assert htmltext.main_text(start + 'x <a href="y') == "It is a sentence. x"


def test_random_markup_loses_no_words():
    """Words outside tags, in an article, all come through, whatever the tags look like."""
    dice = random.Random(4)
    tags = ["<b>", "</b>", "<i x=1>", "</i>", "<p title=it's>", '<p alt=5">', "<br>", "<span a='x'>", "</span>", "<li>", "<h2>", "</h2>", "<em/>", "<a href='x y'>", "</a>", "<img alt='a > b'>", "<!-- no -->", "<wbr>"]
    for _ in range(300):
        words = [f"word{i}" for i in range(dice.randint(1, 30))]
        page = "<article><p>Start here. A sentence is good. " + " ".join(w + dice.choice(["", ".", " " + dice.choice(tags)]) for w in words)
        assert re.findall(r"word\d+", htmltext.main_text(page)) == words


def test_large_pages_take_linear_time():
    dice = random.Random(5)
    parts = ["<p>Of.</p>", "<div><p>A sentence that is here. And one more stands there. So on it goes.</p></div>", "<p><a href=x>link</a></p>", "<div>x<p>y</p>"]
    n = 100_000
    for page in ("".join(dice.choice(parts) for _ in range(n)), "<ul>" + "<li>an item of a list" * n, "<div>x" * n, "<a b " * n, "<a b<" * n + ">", "<p" * n, "<svg>" * n, "<!--" * n, "&amp" * n, "<p a='" * n):
        began = time.time()
        htmltext.main_text(page)
        assert time.time() - began < 20


def test_flow_on_chains_trees_and_grids():
    """Large graphs against a plain shortest-path maximum flow's value."""
    dice = random.Random(6)
    for kind in ("chain", "tree", "chords", "grid"):
        n = 60
        edges = {"chain": [(i, i + 1) for i in range(n - 1)], "tree": [(dice.randrange(i), i) for i in range(1, n)], "chords": [(i, i + 1) for i in range(n - 1)] + [(i, i + 5) for i in range(0, n - 5, 5)], "grid": [(i, i + 1) for i in range(n - 1) if i % 6 != 5] + [(i, i + 6) for i in range(n - 6)]}[kind]
        edges = [(a, b, dice.randint(1, 6) * 1.0) for a, b in edges]
        source, sink = [dice.randint(0, 9) * 1.0 for _ in range(n)], [dice.randint(0, 9) * 1.0 for _ in range(n)]
        side = htmltext.maximum_flow(n, source, sink, edges)
        cut = sum(sink[i] if side[i] else source[i] for i in range(n)) + sum(c for a, b, c in edges if side[a] != side[b])
        assert abs(cut - plain_flow(n, source, sink, edges)) < 1e-6


def plain_flow(n, source, sink, edges):
    room = [[0.0] * (n + 2) for _ in range(n + 2)]
    for i in range(n):
        room[n][i], room[i][n + 1] = source[i], sink[i]
    for a, b, c in edges:
        room[a][b] += c
        room[b][a] += c
    value = 0.0
    while True:
        came, queue = {n: None}, [n]
        for i in queue:
            for j in range(n + 2):
                if room[i][j] > 1e-9 and j not in came:
                    came[j] = i
                    queue.append(j)
        if n + 1 not in came:
            return value
        path, j = [], n + 1
        while came[j] is not None:
            path.append((came[j], j))
            j = came[j]
        amount = min(room[a][b] for a, b in path)
        for a, b in path:
            room[a][b] -= amount
            room[b][a] += amount
        value += amount


# -- The whole against a plain version: html.parser, and all labellings tried ---------------------------


class Plain(HTMLParser):
    """Blocks of well-formed pages: (text, share of links, path of (number, tag, class))."""

    def __init__(self):
        super().__init__()
        self.path, self.out, self.said, self.linked, self.link, self.n = [], [], "", 0, False, 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
            return
        self.end()
        self.n += 1
        self.path.append((self.n, tag, dict(attrs).get("class", "")))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
            return
        self.end()
        self.path.pop()

    def handle_data(self, data):
        self.said += data
        self.linked += len(data.strip()) if self.link else 0

    def end(self):
        text = " ".join(self.said.split())
        if text:
            self.out.append((text, min(1.0, self.linked / len(text)), tuple(self.path)))
        self.said, self.linked = "", 0


SURE = 1e9
PLAIN_MARKS = {"nav": (-SURE, 8.0), "footer": (-SURE, 8.0), "article": (SURE, 4.0), "main": (SURE, 3.0), "ad": (-SURE, 8.0), "comments": (-SURE, 8.0), "notice": (-4.0, 8.0), "related": (-4.0, 8.0), "post": (3.0, 2.0)}


def plain_main_text(page):
    parser = Plain()
    parser.feed(page)
    parser.close()
    parser.end()
    found = parser.out
    costs = []
    for text, share, path in found:
        tag = path[-1][1] if path else ""
        ends = text.count(". ") + text.count("! ") + text.count("? ") + (text[-1] in ".!?")
        costs.append(-1.2 + {"h1": 0.8, "h2": 0.4}.get(tag, 0.0) + 0.35 * min(8, len(text) / 40) - 2.5 * share + 0.4 * min(3, ends))

    def marked(path):
        """Numbers of the marked elements around, the outer ones first, and their worth."""
        held = []
        for number, tag, name in path:
            worth = PLAIN_MARKS.get(tag)
            other = PLAIN_MARKS.get(name)
            if other and tag in ("p", "h1", "h2", "li"):
                other = (-4.0, 4.0) if other[0] < 0 and name in ("ad", "comments", "notice", "related") else None
            if other and (worth is None or other[0] < min(worth[0], 0)):
                worth = other
            if worth and not (worth[0] > 0 and held and held[-1][1][0] <= -SURE):
                held.append((number, worth))
        return held

    chains = [marked(path) for _, _, path in found]
    bare = not any(tag in ("article", "main") for _, _, path in found for _, tag, _ in path)
    ties = {number: worth[0] for chain in chains for number, worth in chain} | ({"page": SURE} if bare else {})
    edges = []
    for i, (chain, (_, _, path)) in enumerate(zip(chains, found, strict=True)):
        if chain:
            edges.append((i, ("m", chain[-1][0]), chain[-1][1][1]))
        elif bare:
            edges.append((i, ("m", "page"), 1.5))
        sure = [next((n for n, worth in reversed(c) if abs(worth[0]) >= SURE), None) for c in chains[: i + 1]]
        if i and sure[i - 1] == sure[i]:
            common = sum(a == b for a, b in zip(path, found[i - 1][2], strict=False))
            edges.append((i - 1, i, 1.6 / max(2, len(path) + len(found[i - 1][2]) - 2 * common)))
        same = [j for j in range(i) if found[j][2][:-1] == path[:-1]]
        if same and sure[same[-1]] == sure[i]:
            edges.append((same[-1], i, 0.6))
    ups = {}
    for chain in chains:
        for (outer, _), (inner, _) in zip(chain, chain[1:], strict=False):
            ups[inner] = outer
        if chain and bare:
            ups[chain[0][0]] = "page"
    edges += [(("m", inner), ("m", outer), 1.0) for inner, outer in ups.items()]
    free = [*range(len(found)), *(("m", m) for m, tie in ties.items() if abs(tie) < SURE)]
    fixed = {("m", m): tie > 0 for m, tie in ties.items() if abs(tie) >= SURE}
    best = None
    for signs in itertools.product((False, True), repeat=len(free)):
        side = dict(zip(free, signs, strict=True)) | fixed
        # What the side of the sink costs is what is lost of the costs' difference.
        cost = sum(max(c, 0) if not side[i] else max(-c, 0) for i, c in enumerate(costs))
        cost += sum(max(ties[m[1]], 0) if not side[m] else max(-ties[m[1]], 0) for m in free if isinstance(m, tuple))
        cost += sum(c for a, b, c in edges if side[a] != side[b])
        if best is None or cost < best[0] - 1e-9:
            best = (cost, side)
    return "\n\n".join(t for i, (t, _, _) in enumerate(found) if best[1][i]), sum((c > 0) != best[1][i] for i, c in enumerate(costs))


def test_the_whole_equals_a_plain_version():
    dice = random.Random(7)
    words = "Some words that stand here and go on for a while until they end somewhere near".split()

    def text():
        said = [" ".join(dice.choices(words, k=dice.randint(1, 14))) for _ in range(dice.randint(1, 4))]
        return ". ".join(said) + dice.choice(["", "."])

    def element(depth):
        tag = dice.choice(["p", "p", "p", "h2", "li", "div", "section", "article", "nav", "footer", "main"] if depth < 3 else ["p", "h1", "li"])
        name = dice.choice(["", "", "", "", "ad", "notice", "related", "comments", "post", "x-y"])
        if tag in ("p", "h1", "h2", "li"):
            inner = dice.choice([text(), text(), f"<a>{text()}</a>", f"{text()} <a>{text()}</a>"])
        else:
            inner = "".join(element(depth + 1) for _ in range(dice.randint(0, 3)))
        return f"<{tag}{f' class={name}' if name else ''}>{inner}</{tag}>"

    changed = tried = 0
    while tried < 150:
        page = "".join(element(0) for _ in range(dice.randint(1, 4)))
        parser = Plain()
        parser.feed(page)
        if len(parser.out) > 8 or page.count("class=") > 5:
            continue
        tried += 1
        want, moved = plain_main_text(page)
        assert htmltext.main_text(page) == want, page
        changed += moved
    assert changed > 100


def test_short_unmarked_and_doubtful_text_stays():
    assert htmltext.main_text("<p>Hello world</p>") == "Hello world"
    assert htmltext.main_text("<body><p>Short</p></body>") == "Short"
    assert htmltext.main_text("Bare text") == "Bare text"
    assert htmltext.main_text("<nav><a href=x>Home</a></nav><p>Short</p><footer>Imprint</footer>") == "Short"
    notice = "The notice of 1912 was the first of its kind. It named the ships."
    assert htmltext.main_text(f"<article><p id='notice'>{notice}</p></article>") == notice
    long = "The promotion of officers was slow in those years. Few had hoped for more. It took the war to change that, and then it went fast enough."
    assert htmltext.main_text(f"<article><h1>Ranks of the fleet</h1><section id='promotion'><p>{long}</p></section></article>") == f"Ranks of the fleet\n\n{long}"
    assert htmltext.main_text(f"<article><p>{long}</p><p class='related-work'>{long}</p></article>") == f"{long}\n\n{long}"
    assert htmltext.main_text(f"<article><p>{long}</p><div class='promotion'><p>{long}</p><p>{long}</p><p>{long}</p></div></article>").count(long) == 4
    assert htmltext.main_text(f"<article><p>{long}</p><div class='promotion'><p>Buy now.</p></div></article>") == long
    assert htmltext.main_text(f"<article><p>{long}</p></article><div class='comments'>" + f"<p>{long}</p>" * 9 + "</div>") == long
    assert htmltext.main_text(f"<article><p>{long}</p></article><aside><article><p>{long}</p></article></aside>") == long


def test_many_blocks_in_a_doubtful_element():
    dice = random.Random(9)
    page = "<div class='notice'>" + "".join(dice.choice(["<p>Of.</p>", "<p>A sentence that is here. And one more stands there. So on it goes.</p>"]) for _ in range(20_000)) + "</div>"
    began = time.time()
    htmltext.main_text(page)
    assert time.time() - began < 20
