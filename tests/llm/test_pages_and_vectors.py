"""Web pages and vectors against plain expectations."""
import numpy as np
import pytest

from pitscreen.llm import html_extract, nearest
from pitscreen.llm.html_extract import page_blocks

PAGE = """<!DOCTYPE html><html><head><title>x &am</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy <p>now</p></div><article><h1>Title &amp; more</h1><p><b>First
 line.<br><p>Second&nbsp;&eacute; <i>word</i>s &lt;b&gt;.</p><aside>side</aside><div class="cookie-notice">cookies</div><form><p>form</p></form><ul><li>one<li>two</ul>
<section id="comments"><p>reader</p></section><p>Last</article><div id="comments"><article class="comment"><p>hm</p></article></div><footer>&copy; x</footer></body></html>"""


def text_of(page):
    return "\n".join(t for t, _ in page_blocks(page))


def test_article_blocks():
    assert text_of(PAGE) == "Title & more\nFirst line.\nSecond é words <b>.\none\ntwo\nLast"


@pytest.mark.parametrize("page,want", [
    ("", ""), ("plain <b>text", "plain text"), ("<article><p>a</p></article><p>out</p><article>b", "a\nb"), ("<main><p>m</p></main><p>x</p>", "m"),
    ("<p>a<script>if (a<b) {}</script>b</p><!-- c", "ab"), ("<p hidden>h</p><p style='display: none'>n</p><p>v", "v"), ("<article><header><h2>T</h2><p>by x</p></header><p>b</p></article>", "T\nb"),
    ("<p>1 < 2 &amp; 3</p><div role=banner>", "1 < 2 & 3"), ("<article><p>a</nav></div>b</p></article>", "a\nb")])
def test_odd_pages(page, want):
    assert text_of(page).replace("a\nb", "a\nb") == want


@pytest.mark.parametrize("page,want", [
    ('<article><p>a</p><section id="related-work"><h2 id="related">r</h2><p id="notice">b</p></section><section id="search-algorithms"><p>c</p></section></article>', "a\nr\nb\nc"),
    ('<article><h2 id="form-of-the-poem">h</h2><section id="search"><p>s</p></section><p class="social-history">p</p></article>', "h\ns\np"),
    ('<div class="layout has-sidebar"><article><p>a</p></article></div>', "a"), ('<div class="sidebar"><article><p>a</p></article></div>', "a"),
    ('<form id="aspnet"><nav>n</nav><article><p>a</p><form>f</form></article></form>', "a"), ('<form><nav>n</nav><div>t<p>u</p></div></form>', "t\nu"),
    ('<div id="search"><main><p>m</p></main></div>', "m"), ('<article><p>a</p></article><div class="related"><article><p>r</p></article></div>', "a"),
    ('<article><p>a</p><section id="comments"><p>c</p></section><div class="share-buttons">s</div><div class="comment-list">l</div></article>', "a"),
    ('<div hidden class="sidebar"><article><p>x</p></article></div><p>v</p>', "v"), ('<div>t</div><div id="comments"><article class="comment-body"><p>c</p></article></div>', "t"),
    ('<p>b</p><form><p>f</p></form>', "b"), ('<main><div class="sidebar"><article><p>a</p></article><p>s</p></div></main>', "a")])
def test_everyday_words_in_names_drop_no_text(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("page,want", [
    ('<article><table><thead><tr class="header"><th>Name</th></tr></thead><tr><td>x</td></tr></table></article>', "Name\nx"),
    ('<article><div class="article-header"><p>Lead</p></div><p>b</p></article>', "Lead\nb"),
    ("<article><p>Let <math><mi>x</mi>=<mn>3</mn></math> hold</p></article>", "Let x=3 hold"),
    ('<article><p>a <span class="search">find</span> b <a class="related" href="x">c</a></p><p class="notice">d</p></article>', "a find b c\nd"),
    ('<div><p>The main text of the page is here and it is long.</p></div><article class="teaser"><p>Short.</p></article>', "The main text of the page is here and it is long.\nShort."),
    ('<article><p>a</p><p class="advertisement">buy</p><div class="notice">n</div></article>', "a"), ("<p>a</p><div class='header'><p>site</p></div>", "a"),
    ("<p a='unclosed>x</p><p>b</p>", "x\nb"), ("<p title='a>b'>c</p>", "c"), ("<p>x</p><p a=\"1", 'x\n<p a="1'), ("<p>a</p></script><p>b</p><!x", "a\nb\n<!x")])
def test_text_of_the_article_stays(page, want):
    assert text_of(page) == want


@pytest.mark.parametrize("piece", ["<p a='", '<p a="1" b=\'', "<p a='>' ", "<!-", "<a <b ", "<script", "<p a=\"'\" ", "<div>" * 3, "'<p>"])
def test_broken_markup_costs_one_pass(piece):
    import time
    page = "<p>start</p>" + piece * (1_000_000 // len(piece)) if piece[:5] != "<div>" else "<p>start</p>" + piece * 2000
    begin = time.process_time()
    blocks = page_blocks(page)
    assert blocks[0][0].startswith("start") and time.process_time() - begin < 10


def test_host_suffix_array_removes_repeated_runs(spark):
    common = "This site uses many words on each of its pages to say nothing at all"
    pages = [(i, f"https://h.example/{i}", f"<div>{common}</div><div>Unique {i} body text that stands only on page {i} of this host, number {i * 7}</div>", "c", "c") for i in range(6)]
    pages += [(10, "https://other.example/1", f"<div>{common}</div>", "c", "c"), (11, "https://m.example/1", "<div>a mirrored page with its own text in two copies here</div>", "c", "c"),
              (12, "https://m.example/2", "<div>a mirrored page with its own text in two copies here</div>", "c", "c"), (13, None, None, None, None), (None, "x", PAGE, "c", "c"), (13, None, None, None, None)]
    got = html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text string, host string").repartition(4)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == len(pages) and all(r.n_chars == len(r.text) for r in got)
    assert all(text[i] == f"Unique {i} body text that stands only on page {i} of this host, number {i * 7}" for i in range(6))
    assert text[10] == common and text[11] == text[12] == "a mirrored page with its own text in two copies here" and text[13] == ""
    assert text[None].startswith("Title & more\n")
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_near_mirrors_and_shared_passages_stay(spark):
    words = lambda name, n: " ".join(f"{name}{j}" for j in range(n))
    mirrors = [words("m", 40) + f" edit{i} " + words("n", 40) for i in range(4)]
    passage, footer = words("quote", 50), words("foot", 12)
    own = [words(f"u{i}x", 60) + (" " + passage if i < 3 else "") for i in range(8)]
    pages = [(i, f"https://a.example/{i}", f"<article><div>{t}</div></article>") for i, t in enumerate(mirrors)]
    pages += [(10 + i, f"https://b.example/{i}", f"<div>{t}</div><div>{footer}</div>") for i, t in enumerate(own)]
    pages += [(20 + i, f"https://c.example/{i}", f"<table><tr><td>x{i}</td></tr></table><div>{passage}</div>") for i in range(2)]
    for n in (1, 5):
        text = {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(n)).collect()}
        assert [text[i] for i in range(4)] == mirrors and [text[10 + i] for i in range(8)] == own
        assert [text[20 + i] for i in range(2)] == [f"x{i}\n{passage}" for i in range(2)]


def brute(ids, x, query, k):
    score = (x * query[1]).sum(axis=1)
    other = ids != query[0]
    order = np.lexsort((ids[other], -score[other]))[:k]
    return list(zip(ids[other][order].tolist(), score[other][order].tolist()))


def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 24)).astype(np.float32)
    x *= rng.uniform(0.2, 3, (3000, 1)).astype(np.float32)     # norms differ
    x[100:160] = x[99]                                          # ties
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, score int").repartition(6)
    got = nearest.nearest(frame, shard=700).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    ids, wide = np.arange(3000), x.astype(float)
    assert sorted(by) == list(range(0, 3000, 20))
    hits = 0
    for q, found in by.items():
        want = brute(ids, wide, (q, wide[q]), 20)
        exact = {int(i): float(s) for i, s in zip(ids, (wide * wide[q]).sum(axis=1))}
        assert len(found) == 20 and found == sorted(found, key=lambda t: (-t[1], t[0])) and all(exact[i] == s for i, s in found)
        hits += len({i for i, _ in want} & {i for i, _ in found})
    assert hits >= 0.95 * 20 * len(by)
    assert [i for i, _ in by[100]][:20] == [99, *range(101, 120)]


def test_nearest_with_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, []), (7, [1.0]), (None, [1.0, 1.0]), (20, [0.5, 0.5]), (20, [0.5, 0.5]), (40, [float("inf"), 1.0]), (60, [0.0, 0.0])]
    got = [tuple(r) for r in nearest.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 7, 1.0), (0, 2, 1, 0.5), (0, 3, 20, 0.5), (20, 1, 0, 0.5), (20, 2, 1, 0.5), (20, 3, 7, 0.5)]
    assert nearest.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def test_boxes_beyond_the_test_are_never_opened():
    rng = np.random.default_rng(4)
    centre = rng.normal(0, 10, (40, 8))
    x = np.concatenate([c + rng.normal(0, 0.05, (200, 8)) for c in centre])
    most = float((x * x).sum(axis=1).max())
    matrix = nearest.projection(8)
    tree = nearest.Tree(nearest.lift(x, most) @ matrix)
    opened, members = [], tree.members
    tree.members = lambda leaves: opened.append(len(leaves)) or members(leaves)
    query = x[0] * np.sqrt(most) / np.linalg.norm(x[0])            # as long as the longest: its neighbours are its own cluster
    ids, score = nearest.search(tree, tree.order, x[tree.order], most, -1, query, np.append(query, 0.0) @ matrix, 10, nearest.chi_square_point(0.95))
    assert np.allclose(score, np.sort(x @ query)[::-1][:10]) and sum(opened) < len(tree.sizes) / 2
    assert sorted(members(np.arange(len(tree.sizes))).tolist()) == list(range(len(x)))


def test_a_block_of_queries_shares_its_passes_over_the_tree(monkeypatch):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((4000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[1000:1400] = x[7]                                           # copies: ties beyond the k-th place
    ids, most = rng.permutation(4000) * 3, float((x * x).sum(axis=1).max())
    matrix = nearest.projection(32)
    tree = nearest.Tree(nearest.lift(x, most) @ matrix)
    asked = np.r_[0:200, 1000:1100]
    projected = np.concatenate([x[asked], np.zeros((300, 1))], axis=1) @ matrix
    passes, members = [], tree.members
    tree.members = lambda leaves: passes.append(len(leaves)) or members(leaves)
    results = []
    for crowd in (nearest.CROWD, 500):
        monkeypatch.setattr(nearest, "CROWD", crowd)
        passes.clear()
        results.append(nearest.search_block(tree, ids[tree.order], x[tree.order], most, ids[asked], x[asked], projected, 20, nearest.chi_square_point(0.95)))
        assert len(passes) < 10 and sum(passes) <= len(passes) * len(tree.sizes)    # not one pass and more for each of 300 queries
    assert all(np.array_equal(a, b) for a, b in zip(*results))
    asker, found, score = results[0]
    hits = 0
    for place, row in enumerate(asked):
        got = list(zip(found[asker == place].tolist(), score[asker == place].tolist()))
        want = brute(ids, x, (ids[row], x[row]), 20)
        if row >= 1000:
            assert got == want
        exact = dict(zip(ids.tolist(), (x * x[row]).sum(axis=1).tolist()))
        assert len(got) == 20 and got == sorted(got, key=lambda t: (-t[1], t[0])) and all(exact[i] == s for i, s in got)
        hits += len({i for i, _ in got} & {i for i, _ in want})
    assert hits >= 0.95 * 20 * len(asked)


def test_nearest_ships_each_vector_once_and_a_shard_to_a_partition(spark, monkeypatch):
    def counted(*_):
        def run(batches):
            import pyarrow as pa
            tasks, members, asked = set(), 0, 0
            for batch in batches:
                tasks |= set(batch.column(0).to_pylist())
                members += sum(b < 0 for b in batch.column(1).to_pylist())
                asked += sum(b >= 0 for b in batch.column(1).to_pylist())
            assert len(tasks) == 1
            yield pa.RecordBatch.from_arrays([pa.array([min(tasks)]).cast("int64"), pa.array([members]), pa.array([float(asked)])], names=["query_id", "vec_id", "score"])
        return run

    monkeypatch.setattr(nearest, "_shard_search", counted)
    rng = np.random.default_rng(12)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((6000, 4)))], "vec_id long, embedding array<double>").repartition(4)
    rows = nearest.nearest(frame, shard=500).collect()
    assert sorted(r.query_id for r in rows) == list(range(12))
    assert sum(r.vec_id for r in rows) == 6000 and {r.score for r in rows} == {300.0}


def test_nearest_with_every_row_a_query_and_huge_vectors(spark):
    rng = np.random.default_rng(13)
    x = rng.standard_normal((2500, 6))
    x[5] *= 1e160                                                  # its square is beyond a double's range
    ids = np.arange(2500) * 20
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(3)
    by = {}
    for r in nearest.nearest(frame, k=5, shard=1000).orderBy("query_id", "rank").collect():
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(by) == ids.tolist()
    assert all(by[20 * n] == brute(ids, x, (20 * n, x[n]), 5) for n in range(2500))


def test_chi_square_closed_form():
    rng = np.random.default_rng(0)
    draws = (rng.standard_normal((200_000, nearest.DIMENSIONS)) ** 2).sum(axis=1)
    for p in (0.1, 0.5, 0.97):
        assert abs((draws <= nearest.chi_square_point(p)).mean() - p) < 0.01
