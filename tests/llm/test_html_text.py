import random

import pytest

from memograph.llm import html_text

NAV = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in "home news sport about".split()) + "</ul></nav>"
HEAD = "<!DOCTYPE html><html><head><title>The title</title><style>p{margin:0}</style><script>var t='</p><article>';</script></head><body>"


def page(body, mark=True):
    a, b = ("<article>", "</article>") if mark else ('<div class="content">', "</div>")
    return (f"{HEAD}<header>Site name</header>{NAV}<!-- ad --><div class='ad'>Buy this thing now.</div>{a}{body}{b}"
            "<div id='cookieBanner'>We use cookies, accept them.</div><section class='comments'><p>First!</p><p>Nice article, I like it a lot.</p></section>"
            "<footer>&copy; example</footer></body></html>")


BODIES = {
    "<h1>A &amp; B</h1><p><b>Bold</b>ly  go<br>on</p><p>Be.</p>": "A & B Boldly go on Be.",
    "<h1>One</h1><p>Two &lt;b&gt; &#233; &eacute; &am x</p>": "One Two <b> é é &am x",
    "<p>Open<p>paragraphs <b>never closed<br><p>end": "Open paragraphs never closed end",
    "<p>Before it all began <aside>aside text here</aside> there were many words</p><form><label>Your mail address</label></form><p>last words of it</p>": "Before it all began there were many words last words of it",
    "<p>x < y and y > z</p><script>if (a<b) {}</script><p>tail</p>": "x < y and y > z tail",
    "<p>" + "word " * 40000 + "</p>": ("word " * 40000).strip(),
}


@pytest.fixture(scope="module")
def weights(spark):
    rows = [(i, "u", page(b)) for i, b in enumerate(list(BODIES) * 3)]
    return html_text.learn(spark.createDataFrame(rows, "page_id long, url string, html string"))


@pytest.mark.parametrize("mark", [True, False])
def test_bodies(weights, mark):
    for body, text in BODIES.items():
        assert html_text.extract(page(body, mark), weights) == text


def all_runs(scores):
    """The largest sum of a run, and the first run that has it, by trying each."""
    runs = [(sum(scores[i:j]), -i, -j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)]
    best = max(runs, default=(0.0, 0, 0))
    return best[0], (-best[1], -best[2])


def test_scan_is_the_best_run_of_any_scores():
    rng = random.Random(3)
    for n in [0, 1, 2, *range(3, 60)]:
        scores = [float(rng.randint(-6, 5)) for _ in range(n)]
        since, until = html_text.best_run(scores)
        assert sum(scores[since:until]) == max(0.0, all_runs(scores)[0])
    assert html_text.best_run([-1.0, -2.0]) == (0, 0) and html_text.best_run([]) == (0, 0)


@pytest.mark.parametrize("mark", [True, False])
def test_scan_is_the_best_run(weights, mark):
    """The text of a page is that of the run with the largest score of all."""
    for body in list(BODIES)[:5]:
        source = page(body, mark)
        scores, texts = html_text.scored(source, weights)
        most, (since, until) = all_runs(scores)
        found = html_text.best_run(scores)
        assert most > 0 and abs(sum(scores[slice(*found)]) - most) < 1e-9
        assert html_text.extract(source, weights) == " ".join("".join(texts[since:until]).split())


def test_rows(spark, weights):
    rows = [(1, "u", page("<p>same text</p>")), (1, "u", page("<p>same text</p>")), (2, None, None), (3, "x", ""), (None, "y", "<nav><a>menu</a></nav>"), (4, "z", "plain words only")]
    pages = spark.createDataFrame([(*r, "clash", 5) for r in rows], "page_id long, url string, html string, text string, n_chars long")
    got = sorted(((r["page_id"] or 0, r["text"], r["n_chars"]) for r in html_text.main_text(pages, weights).collect()))
    assert got == [(0, "", 0), (1, "same text", 9), (1, "same text", 9), (2, "", 0), (3, "", 0), (4, "plain words only", 16)]
    assert html_text.main_text(pages.limit(0), weights).count() == 0
    assert html_text.learn(pages.limit(0)) == {}
