"""Operators that compare texts, vectors or pages, against brute force."""

import itertools
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickerloom.llm import components, html_extract, jaccard_join, line_dedup, permutation_index, sharding, toxicity
from tickerloom.llm.staging import Stages


# ---- line dedup ----


def leftovers(texts, least):
    """Runs of at least `least` words that equal an earlier run."""
    seen, found = set(), []
    for text in texts:
        lines = [x for x in (text or "").split("\n") if x.strip()]
        for a in range(len(lines)):
            total = 0
            for b in range(a, len(lines)):
                total += len(lines[b].split())
                if total >= least:
                    run = tuple(lines[a : b + 1])
                    if run in seen:
                        found.append(run)
                    seen.add(run)
                    break
    return found


def test_line_dedup_removes_repeated_runs_and_nothing_else(spark, words):
    passage = [" ".join(words(n, 100 + n)) for n in (20, 18, 25)]
    single = " ".join(words(60, 200))
    rows = []
    for i in range(40):
        own = [" ".join(words(12, 1000 * i + j)) for j in range(12)]
        if i % 3 == 0:
            own[4:4] = passage
        if i % 5 == 0:
            own.insert(2, single)
        if i % 4 == 0:
            own.insert(0, "Short line of four")
        rows.append((i, "\n".join(own)))
    rows.append((40, rows[7][1]))
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not leftovers([out[i].text for i in range(41)], line_dedup.WINDOW_WORDS)
    assert single in out[0].text and passage[0] in out[0].text
    for i in range(1, 40):
        assert single not in out[i].text and passage[1] not in out[i].text
        original, kept = rows[i][1].split("\n"), out[i].text.split("\n")
        assert [x for x in original if x not in passage and x != single] == kept
        assert out[i].n_removed == len(original) - len(kept)
    assert out[40].text == "" and out[40].n_removed == out[40].n_lines


def test_line_dedup_finds_the_run_around_a_common_unit(spark, words):
    for seed in range(2):
        common, before, after = (" ".join(words(n, 10 * seed + i)) for i, n in enumerate((25, 20, 20)))
        rows = [(1, f"{' '.join(words(60, 700 + seed))}\n{common}\n{' '.join(words(60, 800 + seed))}")]
        rows += [(i, f"{' '.join(words(9, 900 + i))}\n{before}\n{common}\n{after}\n{' '.join(words(9, 950 + i))}") for i in (2, 3)]
        out = {r.doc_id: r.text for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert before not in out[3] and common not in out[3] and after not in out[3]


def test_line_dedup_inside_a_document_and_odd_rows(spark, words, odd_docs, no_docs):
    block = "\n".join(" ".join(words(20, 7 + j)) for j in range(3))
    docs = spark.createDataFrame([(1, f"{block}\nbetween\n\n{block}\n{block}")], "doc_id long, text string")
    assert line_dedup.dedup_lines(docs).first().text == f"{block}\nbetween\n"
    out = line_dedup.dedup_lines(odd_docs.withColumn("n_removed", F.lit("mine")))
    assert sorted((str(r.doc_id), str(r.text)) for r in out.collect()) == sorted((str(r.doc_id), str(r.text)) for r in odd_docs.collect())
    assert line_dedup.dedup_lines(no_docs).count() == 0


# ---- similarity join ----


def shingles(text):
    folded = (text or "").translate({c: c + 32 for c in range(65, 91)})
    found = re.findall(r"[^\x20\x09-\x0D]+", folded)
    if len(found) < 5:
        return frozenset([tuple(found)] if found else [])
    return frozenset(tuple(found[i : i + 5]) for i in range(len(found) - 4))


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            parent[find(j)] = find(i)
    out = []
    for i, (key, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((key, len(sets[i]), (min(ids) if ids else None) if sets[i] else key))
    return out


def families(words):
    """Stars whose copies are like the original but not like each other, chains, exact copies, shared passages."""
    r, rows = random.Random(3), []
    passage = words(60, 500)

    def changed(text, n):
        text = list(text)
        for _ in range(n):
            text[r.randrange(len(text))] = f"w{r.random()}"
        return text

    for f in range(5):
        base = words(120, 900 + f)
        rows += [changed(base, 2) for _ in range(12)] + [base]
        link = base
        for _ in range(6):
            link = changed(link, 3)
            rows.append(link)
    for i in range(40):
        rows.append(words(30, 2000 + i) + passage + words(30, 3000 + i))
    rows += [words(3, 1), words(3, 1), words(4, 2), words(5, 3), [w.upper() for w in words(5, 3)]]
    rows += [rows[0]] * 6
    r.shuffle(rows)
    return [(i * 3 % 1009, " ".join(x)) for i, x in enumerate(rows)]


@pytest.mark.parametrize("piece", [512, 8])
def test_components_equal_brute_force(spark, words, monkeypatch, piece):
    monkeypatch.setattr(jaccard_join, "PIECE", piece)
    monkeypatch.setattr(jaccard_join, "HUBS", 1)
    rows = families(words)
    out = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute_components(rows))


def of_four_hubs():
    """A text linked with the last of four that are each the hub of a block of two with it."""
    r = random.Random(11)

    def made(n):
        return ["".join(r.choices("abcdefghij", k=8)) for _ in range(n)]

    def read(text):
        values, of = jaccard_join.shingle_sets(pa.array([" ".join(text)]))
        node = int(jaccard_join.set_ids(values, of, 1)[0].view(np.int64)[0])
        order = np.argsort(jaccard_join.ranks(values, (values[:0], values[:0])))
        return node, set(values[order][: len(values) - (4 * len(values) + 4) // 5 + 1].tolist())

    while True:
        near = made(16)
        text = near + made(3)
        (node, prefix), (last, near_prefix) = read(text), read(near)
        own = [read(text[i : i + 5])[1].pop() for i in (12, 13, 14)]
        if len(prefix & set(own)) == 3 and len(prefix & near_prefix) == 1 and last < node:
            break
    rows = [text, near]
    for i, key in zip((12, 13, 14), own):
        while True:
            quoting = made(20) + text[i : i + 5] + made(20)
            hub, held = read(quoting)
            if hub < last and key in held:
                rows.append(quoting)
                break
    return [(i, " ".join(x)) for i, x in enumerate(rows)]


def test_a_pair_behind_three_hubs_is_linked(spark):
    rows = of_four_hubs()
    out = jaccard_join.similarity_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(tuple(r) for r in out.collect()) == sorted(brute_components(rows))


def test_join_with_odd_rows(odd_docs, odd_rows, no_docs):
    key = lambda r: tuple(map(str, r))
    out = jaccard_join.similarity_components(odd_docs)
    assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(brute_components([(r[0], r[1]) for r in odd_rows]), key=key)
    kept = jaccard_join.one_of_each(odd_docs.withColumn("label", F.lit(1)))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, 6, None, 7, 8])) and "label" in kept.columns
    assert jaccard_join.similarity_components(no_docs).count() == 0 and jaccard_join.one_of_each(no_docs).count() == 0


def test_tree_passes_every_point_that_may_link():
    r = np.random.default_rng(2)
    points = r.poisson(3, (500, jaccard_join.GROUPS)).astype(np.int32)
    points[100:200] = points[0] + r.integers(0, 2, (100, jaccard_join.GROUPS)) * r.integers(0, 2, (100, 1))
    sizes = points.sum(axis=1)
    tree = jaccard_join.CountTree(points, sizes)
    for i in range(0, 500, 25):
        plain = np.flatnonzero(jaccard_join._may_link(points, sizes, points[i], int(sizes[i])))
        assert sorted(tree.search(points[i], int(sizes[i]))) == plain.tolist()
    visited = sum(np.minimum(tree.levels[-1][0], points[300]).sum(axis=1) >= jaccard_join.needed(tree.levels[-1][1], int(sizes[300])))
    assert visited < len(tree.levels[-1][1])


def test_components_of_long_chains(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 200)] + [(1000, 1005), (1005, 1002), (7, 7)], "a long, b long")
    out = {r.node: r.label for r in components.components(links, Stages(spark, "test")).collect()}
    assert all(out[i] == 0 for i in range(201)) and {out[i] for i in (1000, 1002, 1005)} == {1000} and len(out) == 204


# ---- permutation index ----


def test_search_recall_and_scores(spark, monkeypatch):
    r = np.random.default_rng(4)
    held = r.normal(size=(3000, 24))
    held[1000:2000] = held[7]
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(held)]
    rows += [(5000, None), (5100, [0.0] * 24), (5200, [float("nan")] + [1.0] * 23), (5300, [1.0, 2.0]), (None, rows[0][1]), (100, rows[100][1]), (5400, [None] + [1.0] * 23)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("rank", F.lit("mine")).repartition(5)
    out = permutation_index.search(vectors, F.col("vec_id") % 100 == 0, settings=permutation_index.Settings(cell_rows=500, query_rows=7)).toPandas()
    assert set(out.query_id) == set(range(0, 3000, 100))
    hits = 0
    for q, own in out.groupby("query_id"):
        far = np.sqrt(((held - held[q]) ** 2).sum(axis=1))
        order = [i for i in np.lexsort((np.arange(3000), far)) if i != q][:10]
        own = own.sort_values("rank")
        assert own["rank"].tolist() == list(range(1, 11)) and (own.score.values == far[own.vec_id.values]).all()
        assert own.sort_values(["score", "vec_id"]).vec_id.tolist() == own.vec_id.tolist()
        hits += len(set(order) & set(own.vec_id))
    assert hits >= 0.95 * 10 * out.query_id.nunique()
    # A query among its copies finds those with the least ids.
    assert out[out.query_id == 1500].sort_values("rank").vec_id.tolist() == [7, *range(1000, 1009)]


def test_an_index_posts_under_few_pivots_and_cells_are_tasks(spark):
    r = np.random.default_rng(5)
    centres = r.normal(size=(40, 24)) * 4
    held = centres[r.integers(0, 40, 4000)] + r.normal(size=(4000, 24))
    settings = permutation_index.Settings(pivots=128, places=8, cell_rows=500)
    vectors = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(held)], "vec_id long, embedding array<double>")
    out = permutation_index.search(vectors, F.col("vec_id") % 100 == 0, settings=settings)
    hits = 0
    for q, own in out.toPandas().groupby("query_id"):
        far = ((held - held[q]) ** 2).sum(axis=1)
        far[q] = np.inf
        hits += len(set(np.argsort(far)[:10]) & set(own.vec_id))
    assert hits >= 0.95 * 400
    # Each vector is posted `places` times, and a query reads about places / pivots of the postings.
    orders = permutation_index.nearest_pivots(held, held[:128], settings.places)
    files = np.bincount(orders.ravel(), minlength=128)
    assert np.mean([files[orders[q]].sum() for q in range(0, 4000, 100)]) < 0.25 * orders.size


def test_search_with_few_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (100, [0.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = permutation_index.search(few, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in rows] == [(0, 1, 3, 1.0), (0, 2, 100, 2**0.5), (100, 1, 3, 1.0), (100, 2, 0, 2**0.5)]
    assert permutation_index.search(few.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# ---- columns of the caller ----


@pytest.mark.parametrize("call, names", [
    (line_dedup.dedup_lines, ["_key", "_runs"]), (jaccard_join.one_of_each, ["_key", "_KEY2"]),
    (lambda d: sharding.assign(d, "doc_id", [1.0, 1.0]), ["_part", "_row", "_local", "_begin", "_n"]),
])
def test_columns_with_names_of_ours_pass_through(spark, call, names):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, "some other text of six words")], "doc_id long, text string")
    out = call(docs.withColumns({n: F.lit(f"mine {n}") for n in names} | {"_aside_key": F.lit("held")})).collect()
    assert len(out) == 2 and all(r[n] == f"mine {n}" for r in out for n in names) and all(r["_aside_key"] == "held" for r in out)


# ---- toxicity ----


def test_toxicity_learns_words_and_pairs(spark, words):
    r, rows, labels = random.Random(1), [], []
    common = words(300, 1)
    for i in range(3000):
        text, kind = r.choices(common, k=r.randint(20, 60)), r.random()
        toxic = int(kind < 0.2)
        if kind < 0.1:
            text[5:5] = ["Vile,", r.choice(common), "Creature!"]
        elif kind < 0.2:
            text.insert(3, "scoundrel")
        elif kind < 0.3:
            text.insert(3, "creature")
        rows.append((i, " ".join(text)))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = spark.createDataFrame([*labels, (1, None), (None, 1), (77777, 1), (2, 5)], "doc_id long, toxic int")
    model = toxicity.fit(docs, given)
    long = toxicity.fit(docs, given.withColumn("toxic", F.col("toxic").cast("long")))
    assert np.array_equal(long.weights, model.weights)
    assert 0 < len(model.buckets) < 500
    out = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"), 5)).toPandas()
    truth = out.doc_id.map(dict(labels))
    held = out[out.held]
    assert ((held.score >= 0.5) == (truth[held.index] == 1)).mean() > 0.98
    turned = spark.createDataFrame([(i, 1 - t if i % 2 else t) for i, t in labels], "doc_id long, toxic int").filter(toxicity.held_out(F.col("doc_id"), 5))
    again = toxicity.fit(docs, given.join(turned, "doc_id", "left_anti").union(turned))
    assert np.array_equal(again.weights, model.weights)


def test_toxicity_of_odd_rows(spark, odd_docs, no_docs):
    model = toxicity.Model(20, -2.0, np.array([5]), np.array([1.0]))
    out = toxicity.score(odd_docs.withColumn("score", F.lit("mine")), model)
    scores = out.collect()
    assert len(scores) == odd_docs.count() and all(0 <= r.score <= 1 for r in scores)
    assert toxicity.filter_toxic(odd_docs, model).columns == odd_docs.columns
    none = toxicity.fit(odd_docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.score(odd_docs, none).collect()} == {0.5} and toxicity.score(no_docs, none).count() == 0


# ---- pages ----


def texts_of(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r.page_id: r.text for r in html_extract.extract(pages).collect()}


def test_article_without_chrome(spark):
    page = """<!doctype html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>no</article>";</script></head><body class="has-sidebar">
      <header>Site</header><nav><ul><li><a href='/x>y'>Menu</a></ul></nav><!-- <p>hidden</p> --><div class="cookie-notice">Accept</div>
      <article><h1>Title &amp; more</h1><p>One <b>two</b>\n three<p>Four&nbsp;five<br>six<aside>Side</aside><ul><li>a<li>b &lt;tag&gt;</ul>
      <form><input value="q">Search</form><table><tr><td>c<td>d</table><div id="comments"><p>Reader</p></div></article>
      <aside>More</aside><footer>&copy; 2020</footer>"""
    expected = "Title & more\n\nOne two three\n\nFour five six\n\na\n\nb <tag>\n\nc\n\nd"
    out = texts_of(spark, [(1, "http://a.example/1", page), (2, None, page), (3, "x", None), (4, "http://a.example/2", ""), (5, "http://a.example/2", "plain <i>text"), (1, "http://a.example/1", page)])
    assert out == {1: expected, 2: expected, 3: "", 4: "", 5: "plain text"}


def test_parts_of_a_story_stay():
    def texts(page):
        return [t for _, _, t in html_extract.blocks_of(page)[0]]

    assert texts('<article><header><h1>Head</h1></header><p title="the hidden truth">A</p><p class="foot legal">B</p><div class="article-header">C</div></article>') == ["Head", "A", "B", "C"]
    assert texts('<article><p hidden>no</p><p class="advert">no</p><div class="share">no</div><p>A <span hidden>no</span>b<button>no</button></article>') == ["A b"]
    assert texts('<header><h1>Site</h1></header><div class="site-header">no</div><p>A') == ["A"]
    assert texts('<p class="x>broken') == ["broken"] and texts('<p class="x>a</p><p>b') == ["a", "b"]
    assert texts("<p data-a='>' b=\">\" c=d>1 < 2 & 3 <4>") == ["1 < 2 & 3 <4>"] and texts("<p") == [] and texts("a<!-- b") == ["a"]


@pytest.mark.parametrize("page, n", [
    ("<p a" + "=\"" * 500_000 + ">x", None), ("<p " + "\"" * 1_000_000, None), ("<div>" * 40_000 + "deep" + "</div>" * 40_000, 1),
    ("<div>a" * 40_000, 40_000), ("<div>" * 20_000 + "</p></span>" * 20_000 + "a", 1), ("<" * 1_000_000, 1), ("<!--" * 250_000, 0), ("<p a=\"" * 150_000, None),
])
def test_long_and_hostile_pages_are_read_in_linear_time(page, n):
    begin = time.process_time()
    blocks, _ = html_extract.blocks_of(page)
    html_extract.branches_of(blocks)
    assert n is None or len(blocks) == n
    assert time.process_time() - begin < 20


def test_tree_drops_what_a_site_repeats(spark):
    rows = [(i, f"http://Site.example:80/{i}", f"<div class=top>Welcome to our site</div><div class=body><p>Story {i} of many</p><p>and {i * i} words</p></div>"
             f"<div class=low><p>All rights</p><p>Reserved</p></div>") for i in range(30)]
    rows += [(100, "http://other.example/1", "<div class=top>Welcome to our site</div><p>Alone</p>")]
    out = texts_of(spark, rows)
    assert out[3] == "Story 3 of many\n\nand 9 words"
    assert out[100] == "Welcome to our site\n\nAlone"
    assert texts_of(spark, [(i, "http://copy.example/", "<article><p>Same article</p></article>") for i in range(20)])[4] == "Same article"
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_tree_judges_inside_articles(spark):
    def page(i):
        return f"<article><h1>Title {i}</h1><p>Story {i} of many<div class=zz><p>Read more of this</p></div><p>and {i * i} words</article>"

    out = texts_of(spark, [(i, "http://small.example/", page(i)) for i in range(6)] + [(i, "http://few.example/", page(i)) for i in (10, 11)])
    assert out[3] == "Title 3\n\nStory 3 of many\n\nand 9 words"
    assert out[10] == "Title 10\n\nStory 10 of many\n\nRead more of this\n\nand 100 words"
    # An article of which nothing else would be left stays.
    alike = [(i, "http://alike.example/", f"<article><p>Same article</p>{'<div class=n>' + str(i) + '</div>' if i else ''}</article>") for i in range(20)]
    assert texts_of(spark, alike)[0] == "Same article"
