"""Main text: the parser's blocks, the gradient, held-out pages and pages of another build."""

from __future__ import annotations

import html
import re

import numpy as np
import pytest
from ledgerlake.llm import html_blocks
from ledgerlake.llm.html_blocks import BlockLabeller, WIDTH, blocks_of, extract_main_text, features, sample_pages, train_labeller

FOLDER = "/root/testdata/sf0.01"

OTHER = """<html><body><header><h1>Site name</h1><p>Best news of all</p></header><div class="cookie-notice"><p>We use cookies here. Accept them.</p></div>
<nav><ul><li><a href=x>Home</a><li><a>News</a></ul></nav>{open}<h1>The title of the story</h1><p>First paragraph with a few words &amp; more, and then
some others that follow here.</p><div class="advert">Buy now cheap things</div><p>Second   paragraph<br>of the story is here and it goes on for a
while.</p><blockquote>Quoted words of a person who said this.</blockquote><ul><li>One thing is said</li><li>Another thing is said</li></ul><p>Short
one.</p>{close}<section class="comments"><h2>Comments</h2><div class="comment"><p>I do not agree with this article at all, it is wrong.</p></div><div
class="comment"><p>Nice.</p></div></section><aside class="sidebar"><h3>Popular</h3><p>Other story teaser text here.</p></aside><form><label>Name</label>
<input><button>Send</button></form><script>var a = "<p>no</p>";</script><footer><p>Copyright someone</p></footer></body></html>"""

MAIN = [
    "The title of the story", "First paragraph with a few words & more, and then some others that follow here.", "Second paragraph of the story is here and it goes on for a while.",
    "Quoted words of a person who said this.", "One thing is said", "Another thing is said", "Short one.",
]


def article_of(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S).group(1)
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(b for b in blocks if b)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet(f"{FOLDER}/pages.parquet")


@pytest.fixture(scope="module")
def labeller(pages):
    return train_labeller(sample_pages(pages, "html"))


def test_blocks():
    assert [b.text for b in blocks_of("<p>one<p>two <b>bold</b> x<li>a<li>b</ul>tail<br>end &eacute;&#33;")] == ["one", "two bold x", "a", "b", "tail end é!"]
    assert blocks_of("") == [] and [b.text for b in blocks_of("<p")] == ["<p"] and blocks_of("<!-- c --><script>x</script>") == []
    assert [b.text for b in blocks_of("<div>a<span> b</span><div>c</div>d</div></div></p>e")] == ["a b", "c", "d", "e"]
    link = blocks_of("<nav><a href='x'>here</a></nav>")[0]
    assert link.linked == 1 and link.path == ("nav",) or link.path == ("nav", "a")


def test_gradient():
    rng = np.random.default_rng(1)
    model = BlockLabeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, mask = rng.random((2, 4, WIDTH)) * 0.2, np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = np.array([[1, 0, 1, 0], [0, 1, 0, 0.0]])

    def loss():
        said = model.probabilities([x[0], x[1, :2]])
        return -sum(float((t * np.log(p) + (1 - t) * np.log(1 - p)).sum()) for p, t in zip(said, (y[0], y[1, :2]))) / mask.sum()

    gradient = model._gradient(x, mask, y)
    for name in ("ahead_w", "ahead_u", "back_u", "back_b", "out"):
        flat = model.p[name].reshape(-1)
        at = int(np.abs(gradient[name]).argmax())
        kept = flat[at]
        sides = []
        for step in (1e-3, -1e-3):
            flat[at] = kept + step
            sides.append(loss())
        flat[at] = kept
        assert (sides[0] - sides[1]) / 2e-3 == pytest.approx(float(gradient[name].reshape(-1)[at]), rel=0.05, abs=1e-4)


def test_held_out_pages(pages):
    every = [r["html"] for r in pages.orderBy("page_id").collect()]
    labeller = train_labeller(every[:150])
    parsed = [blocks_of(p) for p in every[150:]]
    said = labeller.probabilities([features(b) for b in parsed])
    got = ["\n".join(b.text for b, p in zip(blocks, s) if p > 0.5) for blocks, s in zip(parsed, said)]
    assert np.mean([g == article_of(p) for g, p in zip(got, every[150:])]) >= 0.98


@pytest.mark.parametrize("around", [("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>")])
def test_pages_of_another_build(labeller, around):
    blocks = blocks_of(OTHER.format(open=around[0], close=around[1]))
    said = labeller.probabilities([features(blocks)])[0]
    got = [b.text for b, p in zip(blocks, said) if p > 0.5]
    assert set(got) <= set(MAIN) and len(got) >= len(MAIN) - 1


def test_odd_rows(rows, pages, labeller):
    page = pages.orderBy("page_id").first()["html"]
    long = page.replace("<article>", "<article>" + "<p>Many words stand here in one more paragraph.</p>" * 3000)
    frame = rows(
        "page_id INT, url STRING, html STRING, text INT, n_chars STRING",
        (1, "u", page, 1, "x"), (1, "u", page, 1, "x"), (None, None, None, None, None), (3, "u", "", 1, "x"), (4, "u", "<", 1, "x"), (5, "u", long, 1, "x"),
    )
    out = extract_main_text(frame, labeller=labeller)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r["text"] for r in out.collect()}
    assert out.count() == 6 and got[None] == got[3] == "" and got[1] == article_of(page)
    assert got[5].count("Many words stand here") == 3000
    assert extract_main_text(frame.limit(0)).count() == 0
    assert {r["text"] for r in extract_main_text(frame.where("page_id = 3")).collect()} == {""}


def test_sample_of_long_pages_and_copies(rows, pages, monkeypatch):
    every = [r["html"] for r in pages.orderBy("page_id").limit(40).collect()]
    long = [p.replace("<article>", "<article>" + "<p>Many words stand here in one more paragraph.</p>" * 1500) for p in every]
    frame = rows("page_id INT, html STRING", *enumerate(long))
    sample = sample_pages(frame, "html")
    assert len(sample) == 40 and all(0 < len(blocks) <= html_blocks.FIT_BLOCKS and {0, 1} == set(said) for blocks, said in sample)
    got = {r["page_id"]: r["text"] for r in extract_main_text(frame).collect()}
    assert np.mean([got[n] == article_of(p) for n, p in enumerate(long)]) >= 0.9
    monkeypatch.setattr(html_blocks, "FIT_PAGES", 10)
    copies = rows("page_id INT, html STRING", *((n, every[0]) for n in range(300)), *enumerate(every))
    assert len(sample_pages(copies, "html")) >= 5


def test_nothing_to_learn_from():
    with pytest.raises(ValueError, match="cannot be trained"):
        train_labeller(["<script>x</script>"])


def test_nested_elements_take_little_memory():
    """Open elements of any depth: memory and time grow with their number."""
    import tracemalloc

    tracemalloc.start()
    for page in ("<div>" * 40_000 + "text", "<div class='a b'><p>x" * 15_000, "<b><i>" * 15_000 + "end" + "</i></b>" * 15_000):
        blocks = blocks_of(page)
        assert blocks and blocks[-1].text in ("text", "x", "end")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000


def test_names_of_closed_elements_leave_the_path():
    first, second, third = blocks_of("<div class='a'><div class='a b'><p>one</p></div><p>two</p></div><p>three</p>")
    assert first.path == ("div", ".a", ".b", "p") and second.path == ("div", ".a", "p") and third.path == ("p",)
