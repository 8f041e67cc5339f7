import random
from html.parser import HTMLParser

from newsline.llm import html_text as rules
from newsline.llm.html_text import main_text, op5_html_text

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>'
    "<article><h1>Head &amp; line</h1><p><b>First\n  one.<br><p>Be.</p><p>Two&nbsp;words &lt;b&gt;</p><form><input>Name</form><div class='comments'><p>Nice!</p></div></article><footer>&copy; me</footer></body></html>"
)


def test_article():
    assert main_text(PAGE) == "Head & line\nFirst one.\nBe.\nTwo words <b>"


def test_cut_off_page():
    assert main_text(PAGE[: PAGE.index("Two&nbsp;") + 12]) == "Head & line\nFirst one.\nBe.\nTwo wor"
    assert main_text("<article><p>Only this<di") == "Only this"
    assert main_text("<article><p>a<!-- never closed <p>b") == "a"
    assert main_text("<article><script>x") == ""


def test_two_passes_without_article():
    long = "The cat was on the mat and it had a hat that was in the way of all that is to be said. " * 4
    page = f"<body><div>Menu</div><ul><li><a href=x>One link here</a></li></ul><div><p>{long}</p><p>Short line.</p><p>{long}</p></div><div><a href=y>Other page</a> <a href=z>More</a></div><p>End</p></body>"
    assert main_text(page) == f"{long.strip()}\nShort line.\n{long.strip()}"


def test_query(spark, write):
    rows = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 1), (None, "w", "", 1), (3, "x", "<p>" + "The best of the world is in the sea and on the land. " * 30_000, 1)]
    got = op5_html_text(spark, write("pages", rows, "page_id long, url string, html string, text int")).collect()
    assert len(got) == 5
    assert {(r.page_id, r.n_chars) for r in got} == {(1, len(main_text(PAGE))), (2, 0), (None, 0), (3, 53 * 30_000 - 1)}
    assert op5_html_text(spark, write("pages", [], "page_id long, url string, html string")).count() == 0


class Tree(HTMLParser):
    """A well-formed page as nested (name, attributes, children)."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.top = ("", {}, [])
        self.path = [self.top]
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = (tag, dict(attrs), [])
        self.path[-1][2].append(node)
        if tag not in ("br", "input"):
            self.path.append(node)

    def handle_endtag(self, tag):
        self.path.pop()

    def handle_data(self, data):
        self.path[-1][2].append(data)


def slow_main_text(page):
    """The same rules from a tree, every number computed afresh where it is needed."""
    found = [[]]  # runs of (piece, ancestors)
    edge = set(rules._BLOCKS)

    def walk(node, above):
        above = [*above, node]
        for x in node[2]:
            if isinstance(x, str):
                found[-1].append((x, above))
            elif x[0] == "br":
                found[-1].append((" ", above))
            elif x[0] not in ("script", "style", "input"):
                if x[0] in edge:
                    found.append([])
                walk(x, above)
                if x[0] in edge:
                    found.append([])

    walk(Tree(page).top, [])
    is_main = lambda n: (n[0] in ("article", "main") or n[1].get("role") == "main") and "comment" not in n[1].get("class", "")
    holds = lambda n: any(not isinstance(x, str) and (is_main(x) or holds(x)) for x in n[2])
    runs = []
    for run in found:
        text = " ".join("".join(p for p, _ in run).split())
        if text:
            above = [n for n in run[-1][1] if n[0]]
            own = [n for n in above if n[0] in edge or n[0] in ("div", "span")]
            linked = sum(len("".join(p.split())) for p, up in run if any(n[0] == "a" for n in up))
            inside = [i for i, n in enumerate(own) if is_main(n)]
            out = any(n[0] in rules._OUT and not (n[0] == "header" and any(j < i for j in inside)) for i, n in enumerate(own)) or any("hidden" in n[1] for n in own)
            names = [rules.named(f"{n[1].get('class', '')} {n[1].get('id', '')}") for n in own if not is_main(n) and not holds(n)]
            runs.append((text, linked / len(text.replace(" ", "")), linked, out, bool(inside), any(n[0] == "li" for n in own), min([0, *names])))
    free = [r for r in runs if not r[3] and r[6] > -9]
    article = any(r[4] for r in free) and sum(len(r[0]) for r in free if r[4]) * 3 >= sum(len(r[0]) for r in free)
    share = lambda t: sum(w.strip(".,;:!?()\"'«»„“”") in rules.STOP_WORDS for w in t.lower().split()) / len(t.split())
    long = [r[0] for r in free if len(r[0]) >= 70]
    covered = sum(share(t) * len(t) for t in long) >= 0.1 * sum(map(len, long))
    marks = []
    for text, density, _, out, main, item, name in runs:
        if density > 0.9:
            own = -3 if item else -2
        elif density > 0.2:
            own = -1
        elif len(text) < 70:
            own = 0
        elif covered:
            own = 2 if share(text) >= 0.2 else -1 if share(text) < 0.08 else 0
        else:
            own = 2 if len(text) >= 200 else 0
        score = -99 if out else own + name + (2 if article and main else -3 if article else 0)
        marks.append((score > 0) - (score < 0))
    if 1 not in marks:
        keep = [m == 0 and r[2] * 2 <= len(r[0]) for m, r in zip(marks, runs)]
    else:
        keep = []
        for i, m in enumerate(marks):
            near = sorted((abs(i - j), j) for j, x in enumerate(marks) if x)
            left, right = ([x for x in near if (x[1] < i) == side] for side in (True, False))
            keep.append(m > 0 if m else marks[min([*left[:1], *right[:1]])[1]] > 0)
    return "\n".join(r[0] for r, k in zip(runs, keep) if k)


def random_page(rng):
    say = lambda k, stops: " ".join(rng.choice(["the", "and", "of", "que", "und"]) if rng.random() < stops else "".join(rng.choice("abcdé&<") for _ in range(5)).replace("&", "&amp;").replace("<", "&lt;") for _ in range(k)) + "."

    def some(depth):
        kind = rng.choice(["p", "p", "p", "div", "ul", "span", "header", "nav", "form", "section", "script"] if depth < 4 else ["p"])
        if kind == "p":
            body = say(rng.choice([1, 3, 10, 30, 60]), rng.choice([0, 0.1, 0.4]))
            return f"<p>{body}</p>" if rng.random() < 0.6 else f"<p>{body}<br>{say(2, 0)} <a href='x'>{say(rng.choice([1, 4, 40]), 0)}</a></p>"
        if kind == "ul":
            return "<ul>" + "".join(f"<li><a href='y'>{say(2, 0)}</a></li>" if rng.random() < 0.6 else f"<li>{say(4, 0.3)}</li>" for _ in range(3)) + "</ul>"
        if kind == "script":
            return "<script>var a = '<p>';</script>"
        mark = rng.choice(["", "", " class='main-nav'", " class='with-sidebar x'", " id='social-history'", " class='share box'", " class='comments'", " hidden"])
        return f"<{kind}{mark}>" + "".join(some(depth + 1) for _ in range(rng.randint(1, 4))) + f"</{kind}>"

    body = [some(0) for _ in range(rng.randint(1, 5))]
    if rng.random() < 0.6:
        body.insert(rng.randint(0, len(body)), f"<div class='{rng.choice(['sidebar', 'wrap', 'promo'])}'><article>" + "".join(some(1) for _ in range(rng.randint(1, 5))) + "</article></div>")
    return "<html><body>" + "".join(body) + "</body></html>"


def test_against_slow_version():
    rng, kept = random.Random(3), 0
    for _ in range(1500):
        page = random_page(rng)
        assert main_text(page) == slow_main_text(page)
        kept += bool(main_text(page))
    assert kept > 800


def test_names_and_places():
    prose = "The cat was on the mat and it had a hat that was in the way of all that is to be said. " * 4
    assert main_text(f'<div class="layout with-sidebar"><article><p>{prose}</p></article><div class="sidebar"><p>{prose}</p></div></div>') == prose.strip()
    assert main_text(f'<article><section id="social-history"><p>Short.</p></section><p>{prose}</p></article>') == f"Short.\n{prose.strip()}"
    assert main_text(f'<div class="site-content promo"><article><p>{prose}</p></article></div>') == prose.strip()
    assert main_text("<body><ul><li><a href=x>Home</a></li></ul><p>Only this here.</p><p>And that.</p></body>") == "Only this here.\nAnd that."
    polish = "Ala ma kota i psa, a kot nie lubi się bawić z psem w domu, ale jest to jego dom. " * 4
    klingon = "tlhIngan maH taHjaj Heghlu meH QaQ jajvam batlh bIHeghjaj nuqneH qapla wo batlh yIn. " * 4
    for text in (polish, klingon):
        assert main_text(f"<nav>Menu</nav><div><p>{text}</p></div><footer>x</footer>") == text.strip()
    assert main_text(f"<p>{prose}<math><mi>x</mi></math></p>") == prose.strip() + " x"
    deep = "<div>" * 20_000 + prose + "</div>" * 20_000
    assert main_text(deep) == prose.strip()
