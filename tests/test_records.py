"""Articles of nested pages, objects of cut-off answers, poll tables: each against a plain version."""

import json
import random

import pytest
from pyspark.sql import functions as F

from psephos.functions import html, records
from psephos.sources import polls

WORDS = " ".join(f"w{i}" for i in range(40))


@pytest.mark.parametrize("page, want", [
    (f"<article><p>{WORDS}</p><nav>menu</nav></article><p>after</p>", WORDS),
    (f"<nav>open menu <div><article><p>{WORDS}</p></article></div>", WORDS),  # an unclosed nav hides nothing
    (f"<div><form>field <p>short</div><article>{WORDS}</article>", WORDS),
    (f"<article>too short</article><div class='x entry-content'>{WORDS}</div>", WORDS),
    (f"<main>{WORDS} main</main><div class='my-story-body-2'>{WORDS} story</div>", f"{WORDS} story"),  # selectors in their order
    (f"<div class='article-body-x'>{WORDS} part</div><div class='article-body'>{WORDS} whole</div>", f"{WORDS} whole"),
    (f"<aside><article>{WORDS} aside</article></aside><p>one <b>two</b><p>three</p>", "one two three"),
    ("<title>t</title><p>a<script>var x = '</p>';</script>b</p><footer><p>c</p></footer>", "a b"),
    ("<div>plain &amp; simple</div><style>p{}</style>", "plain & simple"),
    ("</div></p>text<br/>more<p/>", "text more"),
    ("", ""),
])
def test_article_text(page, want):
    assert html.parsed(page)[0] == want


@pytest.mark.parametrize("page, title, date", [
    ("<meta property='og:title' content=' Og '><title>T</title>", "Og", None),
    ("<title>T  x</title><h1>H</h1><time datetime='2024-03-05'>x</time>", "T x", "2024-03-05"),
    ("<h1>H <i>i</i></h1><meta name='DC.date' content='March 5, 2024'><time datetime='2020-01-01'>", "H i", "March 5, 2024"),
    ('<script type="application/ld+json">{cut</script><script type="application/ld+json">[{"a": 1}, {"dateModified": "2024-03-05T06:07:08Z"}]</script>', "", "2024-03-05T06:07:08Z"),
    ('<script>{"datePublished": "2024"}</script>', "", None),
])
def test_title_and_date(page, title, date):
    assert html.parsed(page)[1:] == (title, date)


@pytest.mark.parametrize("said, want", [
    ("a&amp", "a&amp"), ("a&am", "a&am"), ("&lt &#39 &copy=1", "&lt &#39 &copy=1"), ("&ampx; &nosuch; &", "&ampx; &nosuch; &"),
    ("&amp;lt; &&amp; &#39;&#x41;&eacute;", "&lt; && 'Aé"),
])
def test_only_whole_references_count(said, want):
    page = f"<title>{said}</title><meta property='og:image' content='x?a=1&copy=2'><!-- <script> --><article>{said} {WORDS}</article>"
    assert html.parsed(page)[:2] == (f"{want} {WORDS}", want)
    assert html.parsed('<script type="application/ld+json">{"datePublished": "a&amp"}</script>')[2] == "a&amp"


def test_nested_pages_against_a_tree():
    """Random well-formed pages: the text equals that of a plain recursive walk."""
    rng = random.Random(5)

    def node(depth):
        if not depth or rng.random() < 0.2:
            return " ".join(f"x{rng.randint(0, 99)}" for _ in range(rng.randint(1, 12)))
        return (rng.choice(["div", "p", "article", "nav", "section", "footer", "b", "main"]), [node(depth - 1) for _ in range(rng.randint(1, 4))])

    def shown(n):
        return n if isinstance(n, str) else f"<{n[0]}>" + " ".join(map(shown, n[1])) + f"</{n[0]}>"

    def words(n, inside=True):
        if isinstance(n, str):
            return n.split() if inside else []
        return [] if n[0] in html.NOISE else [w for c in n[1] for w in words(c, inside or n[0] == "p")]

    def find(n, tag):
        if isinstance(n, str) or n[0] in html.NOISE:
            return None
        return n if n[0] == tag else next((f for c in n[1] if (f := find(c, tag))), None)

    for _ in range(300):
        tree = ("body", [node(5) for _ in range(4)])
        for tag in ("article", "main"):
            if (f := find(tree, tag)) and len(words(f)) >= 30:
                want = words(f)
                break
        else:
            want = words(tree, False) or words(tree)
        assert html.parsed(shown(tree))[0] == " ".join(want)


def test_article_columns(spark):
    rows = spark.createDataFrame([(1, f"<article>{WORDS}</article><time datetime='2024-03-05T06:00:00Z'>"), (2, None), (3, "<meta name=date content='Mar 5, 2024'>")], "id int, html string")
    got = rows.select("id", html.article(F.col("html")).alias("a")).select("id", "a.*", F.date_format(html.article_time(F.col("a.date_said")), "yyyy-MM-dd HH").alias("at")).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, WORDS, "", "2024-03-05T06:00:00Z", "2024-03-05 06"), (2, None, None, None, None), (3, "", "", "Mar 5, 2024", "2024-03-05 00")]


ITEMS = [{"a": 'he said "}{" \\ [', "b": {"c": [1, {"d": "```"}]}}, {}, {"e": "ünï\n{"}, {"f": None}]


def test_every_prefix_gives_its_whole_objects():
    text = json.dumps(ITEMS)
    ends, at = [], 1
    for i in ITEMS:
        at = text.index(json.dumps(i), at) + len(json.dumps(i))
        ends.append(at)
    for n in range(len(text) + 1):
        assert [json.loads(o) for o in records.whole_objects(text[:n])] == ITEMS[: sum(e <= n for e in ends)], text[:n]


def test_objects_among_words(spark):
    text = 'The "answer":\n```json\n[{"a": 1}, {"a": "x"}, {bad}, {"a": 2, "b": "s"}]\n```\nDone } and {open'
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, '{"a": 3'), (5, '"' * 3000 + '{"b": "' + "\\\\" * 9000 + '"}')], "id int, said string")
    got = records.object_rows(rows, "id", "said", "a int, b string").orderBy("id", "place").collect()
    assert [tuple(r) for r in got if r.id == 1] == [(1, 0, 1, None), (1, 1, None, None), (1, 2, 2, "s")]
    assert [(r.id, r.b and len(r.b)) for r in got if r.id > 1] == [(5, 9000)]


def test_kept_flags(spark):
    rows = [("1. yes\n2) no\n 3: Nope\n4 yes", 5), ("2. no\n2. Yes\n9. no\n0. no", 2), (None, 2), ("", 1), ("no numbers", 2), ("1. no", 0)]
    got = spark.createDataFrame(rows, "said string, n int").select(records.kept_flags(F.col("said"), F.col("n")).alias("k")).collect()
    assert [r.k for r in got] == [[True, False, False, True, True], [True, True], [True, True], [True], [True, True], []]


def test_poll_tables(spark):
    lines = [("t1", 1, "Q1", "a", "48%", "<1%", None), ("t1", 2, None, "b", "--", "51.5", None), ("t1", 3, " ", None, "7", "x", "100"), ("t1", 4, "Q2", None, "1 000", "2", None), ("t2", 1, None, "z", "3", None, None), (None, 1, "N", None, "4", None, None)]
    rows = spark.createDataFrame(lines, "t string, line int, question string, sub string, yes string, no string, other string").repartition(3)
    got = {tuple(r) for r in polls.long_rows(rows, "t", "line", ["question", "sub"], ["yes", "no", "other"]).collect()}
    assert got == {("t1", 1, "Q1", "a", "yes", 48.0), ("t1", 1, "Q1", "a", "no", 1.0), ("t1", 2, "Q1", "b", "no", 51.5), ("t1", 3, "Q1", "b", "yes", 7.0), ("t1", 3, "Q1", "b", "other", 100.0), ("t1", 4, "Q2", "b", "no", 2.0), ("t2", 1, None, "z", "yes", 3.0), (None, 1, "N", None, "yes", 4.0)}


def test_nested_polls(spark, tmp_path):
    poll = {"metadata": {"source": "S", "dates": "d", "sample_size": 900, "moe": 3.2}, "questions": [{"question_num": "1", "question_text": "Q?", "responses": [{"label": "Yes", "pct": 60}, {"label": "No", "pct": None}]}, {"question_num": "2", "question_text": "R?", "notes": "n", "responses": []}, {"question_num": "3", "question_text": "T?", "notes": "n", "responses": [{"label": "A", "pct": 1.5}]}]}
    (tmp_path / "p.json").write_text(json.dumps(poll))
    got = polls.nested_rows(spark.read.schema(polls.POLL).option("multiLine", True).json(str(tmp_path))).collect()
    assert [tuple(r) for r in got] == [("S", "d", 900, 3.2, "1", "Q?", "Yes", 60.0, ""), ("S", "d", 900, 3.2, "1", "Q?", "No", None, ""), ("S", "d", 900, 3.2, "3", "T?", "A", 1.5, "n")]
    urls = spark.createDataFrame([(1, "u", "b"), (2, "u", "a"), (3, None, "c"), (4, None, "c")], "n int, url string, x string")
    assert {r.n for r in polls.first_by_url(urls, "url", "n").collect()} == {1, 3, 4}
