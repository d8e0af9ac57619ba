import random

import numpy as np
import pytest

from tallyzone.llm import mainmatter as mm
from tallyzone.llm.common import shared_dir

WORDS = "the of rain house élan green water &amp; stone over running quietly morning".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).replace("&amp;", "&")


def page(rng):
    """A page like those of the table, and its article's text."""
    blocks = [prose(rng, rng.randint(3, 8))] + [prose(rng, rng.randint(1, 90)) for _ in range(rng.randint(1, 12))]
    esc = [b.replace("&", "&amp;") for b in blocks]
    body = f"<h1>{esc[0]}</h1>" + "".join(f"<p><b>{b}<br>" if rng.random() < 0.2 else f"<p>{b}</p>\n" for b in esc[1:])
    menu = "".join(f"<li><a href='/x'>{prose(rng, 1)}</a></li>" for _ in range(6))
    return (f"<!DOCTYPE html><html><head><title>{esc[0]}</title><style>p{{margin:0}}</style><script>var t=\"</p>\";"
            f"</script></head><body><nav><ul>{menu}</ul></nav><!-- ad --><div class=\"ad\">{prose(rng, 12)}</div>"
            f"<article>{body}</article><footer>&copy; x &middot; {prose(rng, 12)}</footer></body></html>",
            "\n".join(blocks))


@pytest.fixture(scope="module")
def sample():
    rng = random.Random(3)
    return [page(rng) for _ in range(120)]


@pytest.fixture(scope="module")
def model(sample):
    return mm.learn([h for h, _ in sample[:80]])


def test_pages_of_the_table(sample, model):
    got = mm.extract([h for h, _ in sample[80:]], model)
    assert np.mean([g == w for g, (_, w) in zip(got, sample[80:])]) > 0.95


def overlap(got, want):
    a, b = got.split(), want.split()
    from collections import Counter
    both = sum((Counter(a) & Counter(b)).values())
    return 2 * both / max(1, len(a) + len(b))


def test_other_layouts(model):
    rng = random.Random(9)
    scores = []
    for _ in range(60):
        blocks = [("h1", prose(rng, 6))] + [("p", prose(rng, rng.randint(15, 80))) for _ in range(rng.randint(3, 8))]
        html, truth = mm.relaid(blocks, [prose(rng, 200)], rng)
        runs = mm.Page(html).runs
        want = "\n".join(t for (_, t, _), yes in zip(runs, truth) if yes)
        scores.append(overlap(mm.extract([html], model)[0], want))
    assert np.mean(scores) > 0.93


def test_a_layout_it_was_not_taught(model):
    rng = random.Random(2)
    body = [prose(rng, 60) for _ in range(5)]
    html = ("<body><div class='topbar'><a href=x>Home</a> <a href=y>News</a></div><div class='cookie-consent'><p>"
            + prose(rng, 20) + "</p></div><div class='article-content'>" + "".join(f"<p>{b}" for b in body)
            + "<form><p>" + prose(rng, 6) + "</p></form></div><div class='comments-list'>"
            + "".join(f"<p>{prose(rng, 40)}</p>" for _ in range(4)) + "</div></body>")
    assert overlap(mm.extract([html], model)[0], " ".join(body)) > 0.9


def test_no_kept_block_lies_in_a_dropped_one(sample, model):
    rng = np.random.default_rng(1)
    for html, _ in sample[:20]:
        p = mm.Page(html)
        kept = mm.decode(p, rng.normal(0, 3, len(p.tag)))
        left = {i for i in range(len(p.tag)) if i not in kept}
        for i in kept:  # from a kept block up: kept ones, then only others
            above, out = p.parent[i], False
            while above > 0:
                out = out or above in left
                assert not (out and above in kept)
                above = p.parent[above]


def test_parsing():
    p = mm.Page("<p>a&nbsp;&amp; b<p>c <b>d<br>e</p>x<script>if (a<b) '<p>'</script> y<ul><li>1<li>2</ul><textarea>t</textarea>")
    assert [t for _, t, _ in p.runs] == ["a & b", "c d e", "x y", "1", "2"]
    for odd in ("", "<", "</p></div>", "<div" * 50, "<p>" * 3000 + "z", "&#0;&#x110000;&bogus;", "<!-- open"):
        mm.extract([odd], None)


def test_elements_left_open():
    of = lambda html: [t for _, t, _ in mm.Page(html).runs]
    assert of("<html><head><title>T</title><article><p>text</p></article>") == ["text"]
    assert of("<head><meta charset=x><title>a <b> c</title><link rel=y><noscript><img><p>n</p></noscript><p>x") == ["x"]
    assert of("<head><title>T</title> bare") == ["bare"]
    assert of("<head><title>T</title></head><body><p>x") == ["x"]
    for tag in ("select", "button"):
        assert of(f"<div>a<{tag}><option>o<div>i</div></div><p>x</p>") == ["a", "x"]
        assert of(f"<div>a<{tag}><b>o</b></{tag}> b</div><p>x</p>") == ["a b", "x"]


def test_table_with_odd_rows(spark, sample):
    rows = [(i, f"u{i}", h, "x") for i, (h, _) in enumerate(sample[:40])]
    rows += [(900, None, None, None), (901, "u", "", ""), (902, "u", "<p>" + "word " * 100_000, ""), (0, "u0", rows[0][2], "")]
    folder = shared_dir(spark, "test")
    spark.createDataFrame(rows, "page_id long, url string, html string, text string").write.parquet(
        f"{folder}/pages.parquet")
    found = mm.op6_html_extraction(spark, folder).collect()
    assert len(found) == len(rows)
    by = {r["page_id"]: r for r in found}
    assert by[900]["text"] == by[901]["text"] == "" and by[900]["n_chars"] == 0
    assert np.mean([by[i]["text"] == w for i, (_, w) in enumerate(sample[:40])]) > 0.95
    assert all(r["n_chars"] == len(r["text"]) for r in found)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert mm.train(none) is None and mm.main_text(none, None).count() == 0


def test_decoding_has_the_best_sum_of_all_labelings():
    """Every labeling of small trees that the rules allow, by brute force."""
    from itertools import product
    from types import SimpleNamespace

    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(2, 7)
        parent = [-1] + [rng.randrange(i) for i in range(1, n)]
        tree = SimpleNamespace(tag=["#"] * n, parent=parent, runs=[
            (rng.randrange(1, n), "x" * rng.choice([0, 5, 60, 300]), 0) for _ in range(rng.randint(0, 6))])
        odds = np.array([rng.gauss(0, 2) for _ in range(n)])
        size = [sum(len(t) for b, t, _ in tree.runs if b == i) for i in range(n)]
        value = [o * (min(1, s / 200) + 0.1) for o, s in zip(odds, size)]
        kept = mm.decode(tree, odds)
        total = lambda inside: sum(v if i in inside else -v for i, v in enumerate(value) if i)
        best = -1e9
        for states in product("oid", repeat=n - 1):
            states = ("o", *states)
            allowed = {"o": "oid", "i": "id", "d": "d"}
            if all(states[i] in allowed[states[parent[i]]] for i in range(1, n)):
                best = max(best, total({i for i in range(1, n) if states[i] == "i"}))
        assert abs(total(kept) - best) < 1e-9


def test_long_pages_and_pages_without_marks_are_learned_from(spark):
    rng = random.Random(6)
    rows = []
    for i in range(5):
        body = [prose(rng, 900) for _ in range(19)]
        rows.append((i, f"u{i}", "<nav><ul><li><a href=x>a</a></ul></nav><article>" + "".join(f"<p>{b}</p>" for b in body)
                     + "</article><footer>f</footer>", "\n".join(body)))
    assert min(len(r[2]) for r in rows) > 60_000
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    model = mm.train(pages)
    assert model is not None
    for r in mm.main_text(pages, model).collect():
        assert overlap(r["text"], rows[r["page_id"]][3]) > 0.95
    rows = []
    for i in range(30):
        body = [prose(rng, rng.randint(20, 60)) for _ in range(6)]
        rows.append((i, f"u{i}", "<ul class='menu'><li><a href=x>a</a></ul><div class='content'>"
                     + "".join(f"<p>{b}</p>" for b in body) + "</div>", "\n".join(body)))
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, want string")
    model = mm.train(pages)
    assert model is not None
    assert np.mean([overlap(r["text"], rows[r["page_id"]][3]) for r in mm.main_text(pages, model).collect()]) > 0.9


def test_attribute_words_that_no_list_holds_are_learned():
    rng = random.Random(12)
    assert not {"inhalt", "werbung"} & (mm.MAIN_WORDS | mm.OTHER_WORDS)

    def parts(tag):
        body = [prose(rng, rng.randint(10, 50)) for _ in range(rng.randint(2, 5))]
        other = [prose(rng, rng.randint(10, 50)) for _ in range(rng.randint(2, 5))]
        boxes = [f"<{tag} class='inhalt'>" + "".join(f"<p>{b}</p>" for b in body) + f"</{tag}>",
                 "<div class='werbung'>" + "".join(f"<p>{b}</p>" for b in other) + "</div>"]
        rng.shuffle(boxes)
        return "<body>" + "".join(boxes) + "</body>", "\n".join(body)

    model = mm.learn([parts("article")[0] for _ in range(80)])
    assert model.tokens[mm.bucket("inhalt")] > 1 and model.tokens[mm.bucket("werbung")] < -1
    pages = [parts("div") for _ in range(40)]  # nothing but the words tells the two apart
    got = mm.extract([h for h, _ in pages], model)
    assert np.mean([overlap(g, w) for g, (_, w) in zip(got, pages)]) > 0.9


def test_token_weights_match_plain_counts():
    page = mm.Page("<div class='a b'><p>x</p><p class='c'>y</p></div><ul id='c'><li>z</ul><section class='b'></section>")
    main = np.array([t == "p" for t in page.tag])
    yes, no = mm.token_counts(page, main)
    count = lambda c, w: c[mm.bucket(w)]
    assert [(count(yes, w), count(no, w)) for w in ("a", "b", "c", "<p", "<div", "<li", "<ul", "<section")] == [
        (2, 0), (2, 0), (1, 1), (2, 0), (2, 0), (0, 1), (0, 1), (0, 0)]
    weights = mm.token_weights(yes, no)
    share = 3 / 5
    assert abs(weights[mm.bucket("a")] - np.log((2 + share * mm.PRIOR) / ((1 - share) * mm.PRIOR) * (1 - share) / share)) < 1e-12
    assert mm.bucket("<section") not in weights
