import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from vitrina.llm.extraction import STOP_WORDS, extracted, main_text

PROSE = "The quick brown fox and the dog were in the house of the man who had all of the things that we would like to have for the rest of the day."

CASES = [
    (None, ""), ("", ""), ("plain", "plain"), ("<p>a &lt;b&gt;&nbsp;&amp;amp; &#x41;</p>", "a <b> &amp; A"),
    ("<p>one<br>two\n\t three</p><p>four", "one two three\nfour"),
    (f"<nav><ul><li><a href='/'>Home of the site</a></ul></nav><article><h1>Title</h1><p>{PROSE}<p>Short.</article><footer>The end of it</footer>", f"Title\n{PROSE}\nShort."),
    (f"<header><h2>Site</h2></header><article><header><h1>T</h1></header><p>{PROSE}</p><aside>{PROSE}</aside></article>", f"T\n{PROSE}"),
    (f"<article><p>{PROSE}</p><section id='comments'><article class='comment'><p>{PROSE}</p></article></section></article>", PROSE),
    (f"<body class='has-sidebar'><div class='main'><h1>Title</h1><p>{PROSE}</p><p>Yes.</p><p>{PROSE}</p></div><div class='cookie-notice'>{PROSE}</div>", f"Title\n{PROSE}\nYes.\n{PROSE}"),
    (f"<div><p>{PROSE}</p></div><form><p>{PROSE}</p></form><div role='navigation'>{PROSE}</div><p hidden>{PROSE}</p><div style='display:none'>{PROSE}</div>", PROSE),
    ("<script>if (a<b) { x = '</p>'; }</script><style>p{}</style><p>text</p><!-- <p>no</p> --><!-- open", "text"),
    (f"<p>{PROSE}</p><p><a href=x>{PROSE}</a></p>", PROSE),
    ("<div class=x>1 < 2 & 3</div>", "1 < 2 & 3"), (f"<article><p>{PROSE}</p><p>cut <b", f"{PROSE}\ncut"),
    ("<TITLE>no</TITLE><P CLASS='a>b'>Upper</P>", "Upper"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages(page, text):
    assert main_text(page) == text


def test_short_blocks_follow_their_neighbours():
    page = f"<p>{PROSE}</p><p>Near.</p><p>x</p><div><a href=1>{PROSE}</a></div><p>Other.</p><div><a href=2>{PROSE}</a></div>"
    assert main_text(page) == f"{PROSE}\nNear."


FINNISH = "Vanha kalastaja lähti aamulla merelle ja palasi vasta illalla, kun aurinko laski saarten taakse. Verkoissa oli tusinoittain ahvenia."
CODE = "result = compute(matrix, vector); print(result.shape); assert result.shape == expected_shape; total += result.sum()"


@pytest.mark.parametrize("page, text", [
    ("<nav>Home</nav><p>Short text.</p><footer>Imprint</footer>", "Short text."),
    (f"<nav>Home</nav><p>{PROSE}</p><p>The end.</p><footer>Imprint</footer>", f"{PROSE}\nThe end."),
    (f"<nav>Home</nav><h1>Meri</h1><p>{FINNISH}</p><p>{FINNISH * 3}</p><footer>Imprint</footer>", f"Meri\n{FINNISH}\n{FINNISH * 3}"),
    (f"<div><p>{PROSE}</p><pre>{CODE}</pre><p>{PROSE}</p></div>", f"{PROSE}\n{CODE}\n{PROSE}"),
    (f"<p>{FINNISH}</p><div><a href=1>{FINNISH}</a></div><nav>Home</nav>", FINNISH),
    ("<nav>Home</nav><footer>Imprint</footer>", ""),
])
def test_pages_without_an_article(page, text):
    assert main_text(page) == text


LINKS = "".join(f"<li><a href='/{i}'>Another story of the day number {i}</a></li>" for i in range(4))


@pytest.mark.parametrize("page, text", [
    # One form round the page, with and without an article; a form beside the text goes.
    (f"<form id='aspnetForm'><nav>Home</nav><article><p>{PROSE}</p></article><label>Name</label></form>", PROSE),
    (f"<form><nav>Home</nav><h1>T</h1><p>{PROSE}</p><p>Yes.</p><label>Your name</label><button>Go</button></form>", f"T\n{PROSE}\nYes."),
    (f"<p>{PROSE}</p><form><p>Sign here and {PROSE}</p></form>", PROSE),
    # Class names count as a whole.
    (f"<div class='has-sidebar no-comments'><p>{PROSE}</p><div class='sidebar-left'>{PROSE}</div></div>", PROSE),
    (f"<article><p>{PROSE}</p><div class='notice-board'><p>{PROSE}</p></div><div class='search-results'>{PROSE}</div></article>", f"{PROSE}\n{PROSE}\n{PROSE}"),
    (f"<article><p>{PROSE}</p><div class='post-comments'><p>{PROSE}</p></div><div id='siteFooter'>{PROSE}</div></article>", PROSE),
    # Links inside an article.
    (f"<article><h1>T</h1><p>{PROSE}</p><ul>{LINKS}</ul><p>{PROSE}</p></article>", f"T\n{PROSE}\n{PROSE}"),
    (f"<article><p>{PROSE}</p><p>Share: <a href=1>Mail this story</a> <a href=2>Print it</a></p><p>One <a href=1>link</a>.</p></article>", f"{PROSE}\nOne link."),
    (f"<article><p>{FINNISH}</p><p>Loppu.</p></article><footer>{PROSE}</footer>", f"{FINNISH}\nLoppu."),
])
def test_forms_names_and_links(page, text):
    assert main_text(page) == text


class Plain(HTMLParser):
    """Blocks of well-formed pages: (text, share of links, beside, in the article, heading)."""

    def __init__(self):
        super().__init__()
        self.open, self.found, self.text, self.linked = [], [], "", 0

    def cut(self):
        words = " ".join(self.text.split())
        if words:
            beside, article = any(t in ("nav", "footer") for t in self.open), "article" in self.open
            self.found.append((words, self.linked / len(words.replace(" ", "")), beside, article, "h2" in self.open))
        self.text, self.linked = "", 0

    def handle_starttag(self, tag, attributes):
        if tag != "a":
            self.cut()
        self.open.append(tag)

    def handle_endtag(self, tag):
        if tag != "a":
            self.cut()
        self.open.pop()

    def handle_data(self, data):
        self.text += data
        if "a" in self.open:
            self.linked += len("".join(data.split()))


def plain_text(page):
    """The rule, each ambiguous block looking at all decided ones."""
    parser = Plain()
    parser.feed(page)
    found = parser.found
    first = []
    for text, links, beside, _, _ in found:
        words = re.findall(r"[^\W\d_]+", text.lower())
        density = sum(w in STOP_WORDS for w in words) / max(len(words), 1)
        prose = len(text) >= 70 and ((density >= 0.25 and (len(text) > 200 or links <= 0.2)) or (density >= 0.1 and len(text) > 200 and links <= 0.2))
        first.append(False if beside or links > 0.5 else True if prose else None)
    out = []
    for i, (text, _, _, article, heading) in enumerate(found):
        label = first[i]
        near = [j for j, b in enumerate(found) if first[j] is not None and not b[2] and (not article or (b[3] and first[j]))]
        if label is None and any(first[j] for j in near):
            gap = min(abs(j - i) for j in near)
            sides = [j for j in near if abs(j - i) == gap]
            label = first[sides[-1]]
            if heading and any(j > i for j in near):
                label = first[min(j for j in near if j > i)]
        if label is not False:
            out.append(text)
    return "\n".join(out)


def test_against_a_plain_version():
    rng = random.Random(5)
    parts = [
        lambda: f"<p>{PROSE}</p>", lambda: f"<p>{PROSE} {PROSE}</p>", lambda: f"<p>Short {rng.randint(0, 9)}.</p>", lambda: "<h2>Title</h2>",
        lambda: f"<ul>{LINKS}</ul>", lambda: f"<p>{FINNISH}</p>", lambda: f"<p>See <a>this other page</a> and <a>that</a></p>",
        lambda: f"<nav><p>{PROSE}</p></nav>", lambda: f"<footer><ul>{LINKS}</ul></footer>", lambda: f"<div>{CODE}</div>",
        lambda: f"<p>{PROSE[:90]} <a>{PROSE[:rng.randint(5, 90)]}</a></p>",
    ]
    some = lambda n: "".join(rng.choice(parts)() for _ in range(rng.randint(0, n)))
    for _ in range(1500):
        page = some(6) + rng.choice([f"<article>{some(9)}</article>", ""]) + some(5)
        assert main_text(page) == plain_text(page), page


def test_column(spark):
    rows = [(1, *CASES[5]), (1, *CASES[5]), (2, None, ""), (3, f"<article>{'<p>' + PROSE + '</p>'}" * 3000, None)]
    frame = spark.createDataFrame(rows, "page_id long, html string, text string").select("page_id", F.col("text").alias("url"), "html")
    found = frame.select("page_id", extracted(F.col("html")).alias("text")).collect()
    assert [r.text for r in found if r.page_id == 1] == [CASES[5][1]] * 2
    assert [r.text for r in found if r.page_id == 2] == [""]
    assert [r.text.count("\n") for r in found if r.page_id == 3] == [2999]
    assert frame.limit(0).select(extracted(F.col("html"))).count() == 0


def test_unclosed_markup_stays_linear():
    for page in ("<a href=\"" * 50_000, "<div>" * 50_000 + "x", "<!-" * 50_000, "<" * 50_000, "<p>x</span>" * 50_000):
        main_text(page)
