"""The corpus operators on small inputs: edge cases, brute-force versions, held-out accuracy."""

import random

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from memlake.llm.best_fit import best_fit, pack
from memlake.llm.common import sampled
from memlake.llm.chosen_path import COORDS, chosen_path_join, sketch_diff
from memlake.llm.impact_index import impact_topk
from memlake.llm.language_mixture import language_mixture
from memlake.llm.license_index import TEMPLATES, license_scan
from memlake.llm.main_text import Weights, extract, main_text
from memlake.llm.mixing import mix, mixed, nameless
from memlake.llm.multi_index import multi_index_links, multi_sequence
from memlake.llm.pii_labelers import expectation_maximisation, pii_report
from memlake.llm.toxicity_fm import toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int, cid string"


def words(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa mu nu xi".split()) + str(r.randrange(50)) for _ in range(n))


def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    base = words(1, 120)
    texts = [None, "", " \t\n", "one", "one", "One  TWO", base, base, base.replace("alpha", "ALPHA"), base + " tail", words(2, 30_000), base[5:], "!!! ... 123", "x" * 20_000]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "s1", 5, 1, "c") for i, t in enumerate(texts)]
    rows += [(None, base, "en", None, None, None, None), (None, "a nameless text of its own", None, None, None, None, None), rows[6], rows[6]]
    return spark.createDataFrame(rows, DOCS)


def empty_docs(spark):
    return spark.createDataFrame([], DOCS)


def test_chosen_path_matches_brute_force(spark):
    r = random.Random(5)
    docs = {}
    for g in range(12):
        w = words(g, 100).split()
        for c in range(r.randrange(1, 8)):
            v = w[:]
            for _ in range(r.randrange(0, 4)):
                v[r.randrange(len(v))] = f"new{r.random()}"
            docs[len(docs)] = " ".join(v)
    shared = words(99, 40)
    for i in range(60):
        docs[len(docs)] = shared + " " + words(1000 + i, 100)
    got = chosen_path_join(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near_groups(docs)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_sketch_keeps_pairs_at_the_threshold(percent):
    """The exact distribution of differing sketch bits: each of 64 coordinates agrees, or has four random bits."""
    apart = 1 - percent / 100
    bits, one = np.ones(1), np.array([1 - apart, 0, 0, 0, 0]) + apart * np.array([1, 4, 6, 4, 1]) / 16
    for _ in range(COORDS):
        bits = np.convolve(bits, one)
    assert bits[sketch_diff(percent) + 1 :].sum() < 1e-5 / 2


def test_chosen_path_at_eighty_percent(spark):
    r, docs = random.Random(11), {}
    for g in range(40):
        w = words(500 + g, 100).split()
        for c in range(4):
            v = w[:]
            for j in r.sample(range(len(v)), r.randrange(0, 3)):
                v[j] = f"new{r.random()}"
            docs[len(docs)] = " ".join(v)
    got = chosen_path_join(spark.createDataFrame(list(docs.items()), "doc_id long, text string"), percent=80).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near_groups(docs, 80)
    assert brute.near_groups(docs, 80) != brute.near_groups(docs, 85)


def test_chosen_path_large_group_of_near_misses(spark):
    """Many members of a node are just below the threshold: they meet in blocks, and every link is found."""
    r = random.Random(8)
    base, docs = words(4, 150).split(), {}
    for i in range(300):
        v = base[:]
        for _ in range(r.randrange(1, 4)):
            v[r.randrange(len(v))] = f"new{r.random()}"
        docs[i] = " ".join(v)
    got = chosen_path_join(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near_groups(docs)


def test_chosen_path_large_group_of_near_copies(spark):
    w = words(3, 150).split()
    docs = {i: " ".join(w[:j] + [f"z{i}"] + w[j + 1 :]) for i, j in ((i, (i * 7) % 150) for i in range(150))}
    got = chosen_path_join(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {x.doc_id: (x.n_shingles, x.component_id) for x in got} == brute.near_groups(docs)


def test_chosen_path_odd_rows(spark):
    rows = chosen_path_join(odd_docs(spark)).collect()
    by = {x.doc_id: x for x in rows if x.doc_id is not None}
    assert len(rows) == 18
    assert all(by[i].n_shingles == 0 and by[i].component_id == i for i in (0, 1, 2))
    assert by[4].component_id == 3 and by[5].component_id == 5 and {by[i].component_id for i in (6, 7, 8, 9, 11)} == {6}
    assert sorted(str(x.component_id) for x in rows if x.doc_id is None) == ["6", "None"]
    assert chosen_path_join(empty_docs(spark)).count() == 0


def test_pii_base_spans(spark):
    texts = [
        None, "", "a@b.c_d@e.f", "x@y", "mail me.you+z@sub-1.example.com.", "1.2.3.4.5.6.7.8", "256.1.1.1 000255.0.0.1", "4111 1111-1111 1111", "4111111111111112",
        "+1 (017) 555-7713 and +4930", "+1+2 345 678 901 2", "é 10.0.0.1 ü a@b.de", "card 4111111111111111, ip 1.1.1.1", "1 2 3 4 5 6 7 8 9 0 1 2 3", "@" * 500, "1." * 3000, "a." * 3000 + "@b.c", "+1((((((" * 400,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for x in pii_report(docs).collect():
        want = brute.base_spans(texts[x.doc_id])
        assert x.base_sha256 == brute.span_digest(want), texts[x.doc_id]
        assert [x.n_email, x.n_ip, x.n_card, x.n_phone] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert set(f"{k}:{a}:{b}" for k, a, b in want) <= set(x.spans.split(","))
    assert pii_report(odd_docs(spark)).count() == 18 and pii_report(empty_docs(spark)).count() == 0


def test_expectation_maximisation_separates_reliable_votes():
    table = [(0, (1, 1, 1, 1), 900), (0, (-1, 0, -1, -1), 800), (0, (0, 1, 1, 1), 30), (0, (0, 0, -1, -1), 30)]
    prob, _ = expectation_maximisation(table)
    assert prob[0] > 0.9 and prob[1] < 0.1 and prob[2] > 0.5 > prob[3]


def test_license_base(spark):
    texts = [None, "", "MIT License", "the mit-license; MIT  LICENSE", "apache license general public license", "gnu general public licenses", "Licensed under CC BY-NC 4.0.", "mit é license", "license " * 2000 + "mit license"]
    got = license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for x in got:
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute.license_base(texts[x.doc_id]), texts[x.doc_id]
        assert set(filter(None, x.base_labels.split(","))) <= set(x.labels.split(",")) and 0 <= x.score <= 1
    assert next(x.labels for x in got if x.doc_id == 6) == "cc-by-nc"
    assert license_scan(odd_docs(spark)).count() == 18 and license_scan(empty_docs(spark)).count() == 0


def mix_by_hand(rows, weights, share, epochs):
    """Recursive water-filling over (path, tokens): leaf -> budget."""
    supply = {}
    for path, n in rows:
        supply[path] = supply.get(path, 0) + n

    def limit(node):
        return sum(n * epochs for p, n in supply.items() if p[: len(node)] == node)

    out = {}

    def fill(node, given):
        if len(node) == len(next(iter(supply))):
            out[node] = int(given + 1e-6)
            return
        kids = {p[: len(node) + 1] for p in supply if p[: len(node)] == node}
        open_, left, take = set(kids), given, {}
        weight = lambda k: weights.get(k[-1], 1.0)
        while open_:
            full = {k for k in open_ if limit(k) <= left * weight(k) / sum(map(weight, open_)) + 1e-9}
            if not full:
                take |= {k: left * weight(k) / sum(map(weight, open_)) for k in open_}
                break
            take |= {k: limit(k) for k in full}
            left -= sum(limit(k) for k in full)
            open_ -= full
        for k in kids:
            fill(k, take[k])

    fill((), min(limit(()), int(sum(supply.values()) * share)))
    return out


@pytest.mark.parametrize("share", [0.3, 1.0, 2.5])
def test_mixing_budgets_and_prefixes(spark, share):
    r = random.Random(8)
    rows = [(i, r.choice("ab"), r.choice(["en", "fr", "de"]), f"s{r.randrange(4)}", r.randrange(1, 90)) for i in range(400)]
    weights = {"a": 0.8, "b": 0.2, "en": 0.5, "fr": 0.4, "de": 0.1}
    docs = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n long")
    got = mix(docs, ["domain", "lang", "source"], weights, share, 3, 1, count_col="n").collect()
    want = mix_by_hand([(x[1:4], x[4]) for x in rows], weights, share, 3)
    taken = {}
    for x in got:
        key = (x.domain, x.lang, x.source)
        taken[key] = taken.get(key, 0) + x.taken
        assert 0 < x.taken <= x.n_tokens
    assert taken == {k: v for k, v in want.items() if v}
    for key in taken:
        parts = [x for x in got if (x.domain, x.lang, x.source) == key and x.taken < x.n_tokens]
        assert len(parts) <= 1
        size = sum(1 for x in rows if x[1:4] == key)
        last = max(x.epoch for x in got if (x.domain, x.lang, x.source) == key)
        assert all(sum(1 for x in got if (x.domain, x.lang, x.source) == key and x.epoch == e) == size for e in range(last))


def test_mixing_odd_rows(spark):
    got = mix(odd_docs(spark), ["lang", "source"], {}, 1.0, 2).collect()
    assert all(x.taken > 0 and x.lang in ("en", "null") for x in got)
    assert mix(empty_docs(spark), ["lang", "source"], {}).count() == 0


@pytest.mark.parametrize("share", [1.0, 0.3])
def test_mixed_rows_follow_their_units(spark, share):
    r = random.Random(3)
    text = lambda: r.choice([None, " ".join("w" for _ in range(r.randrange(9)))])
    rows = [(r.choice([None] * 30 + list(range(250))), text(), r.choice(["en", "fr", None]), r.choice("ab"), n) for n in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, unit long")
    levels, weights = ["lang", "source"], {"en": 0.7, "fr": 0.2}
    units = docs.withColumn("of", nameless(F.col("doc_id"), [F.col(c) for c in levels], F.col("text"))).collect()
    times = {}
    for x in mix(docs, levels, weights, share, 3).collect():
        times[x.doc_id, x.unit] = times.get((x.doc_id, x.unit), 0) + 1
    want = sorted(x.unit for x in units for _ in range(times.get((x.doc_id, x.of), 0)))
    got = mixed(docs, levels, weights, share, 3)
    assert got.columns == docs.columns
    assert sorted(x.unit for x in got.collect()) == want and want
    assert mixed(empty_docs(spark), levels, {}).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    both = language_mixture(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (both.lang == both.lang_pred).mean() > 0.95
    odd = language_mixture(odd_docs(spark)).collect()
    assert len(odd) == 18 and {x.lang_pred for x in odd if x.doc_id in (0, 1, 2)} == {"und"} and all(0 <= x.score <= 1 for x in odd)
    assert language_mixture(empty_docs(spark)).count() == 0


def test_toxicity_held_out(spark):
    folder = SF.replace("0.001", "0.1")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    known = toxicity(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    bad, good = known[known.toxic == 1].score.to_numpy(), known[known.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good).mean() > 0.95 and (good >= 0.5).mean() < 0.01
    none = spark.createDataFrame([], labels.schema)
    assert {x.score < 1e-6 for x in toxicity(odd_docs(spark), none).collect()} == {True}
    assert toxicity(empty_docs(spark), labels).count() == 0


def test_main_text(spark):
    article = "<article><h1>A &amp; B</h1><p>one <b>tw</b>o<br>three\n four</p><script>var x='</p>';</script><p>five &lt;six&gt;</p></article>"
    page = f"<html><head><title>T</title></head><body><nav><ul><li><a href='/'>home</a></li></ul></nav><div class='ad'>buy buy now</div>{article}<footer>bye bye</footer></body></html>"
    assert extract(page, Weights({}, {})) == "A & B one two three four five <six>"
    plain = page.replace("<article>", "<div>").replace("</article>", "</div>")
    assert extract(plain, Weights({}, {})) == "A & B one two three four five <six>"
    assert extract(None, Weights({}, {})) == extract("", Weights({}, {})) == extract("<p></p>", Weights({}, {})) == ""
    extract("<" * 5000 + '<a "' * 300 + "<!--", Weights({}, {}))
    rows = main_text(spark.createDataFrame([(1, "u", page), (1, "u", page), (None, None, None), (2, "v", "")], "page_id long, url string, html string")).collect()
    assert [x.n_chars for x in sorted(rows, key=lambda x: str(x.page_id))] == [35, 35, 0, 0]
    assert main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_keeps_lists_links_and_tables_of_articles(spark):
    """Also where the labelled pages have lists, links and tables only in their boilerplate."""
    row = "<tr><td>cell</td><td>data</td></tr>"
    nav = f"<nav><ul>{'<li><a href=/>home</a></li>' * 5}</ul><table>{row * 5}</table></nav>"
    learnt = [(i, "u", f"<html><body>{nav}<article><p>{words(i, 80)}</p></article></body></html>") for i in range(60)]
    inner = "<p>see <a href=x>the link</a> here</p><ul><li>first item</li><li>second item</li></ul><table><tr><td>left</td><td>right</td></tr></table><p>short tail</p>"
    text = "see the link here first item second item left right short tail"
    asked = [(100, "u", f"<html><body>{nav}<article><p>{words(7, 80)}</p>{inner}</article></body></html>"), (101, "u", f"<html><body>{nav}<div><p>{words(7, 80)}</p>{inner}</div></body></html>")]
    rows = main_text(spark.createDataFrame(learnt + asked, "page_id long, url string, html string")).where("page_id >= 100").collect()
    assert [x.text for x in rows] == [f"{words(7, 80)} {text}"] * 2


@pytest.mark.parametrize(
    "wrapper",
    ["<body class='post has-sidebar'>@</body>", "<html class='nav-open'><body>@</body></html>", "<div class='layout header-fixed'>@</div>", "<div id='page' class='comments-open'>@</div>", "<div role=main class=menu-left><div class='tags'>@</div></div>", "<form id=login><div class=page>@</div></form>"],
)
@pytest.mark.parametrize("article", ["article", "main", "div"])
def test_main_text_inside_wrappers_with_boilerplate_names(wrapper, article):
    inner = "<p class='meta'>By someone</p><div class='alert'>mind the gap</div><section id='related-work'><p>others did too</p></section>" if article != "div" else ""
    page = f"<nav>home</nav><{article}><p>{words(1, 60)}</p>{inner}<div class='share'>like this</div></{article}><div class='comments'>me first</div><footer>bye</footer>"
    text = words(1, 60) + (" By someone mind the gap others did too" if inner else "")
    assert extract(wrapper.replace("@", page), Weights({}, {})) == text


def test_main_text_without_teasers_and_comments():
    page = f"<main><article><p>{words(1, 60)}</p></article><div id='comments'><article>me first</article></div></main><aside><article>a teaser</article></aside>"
    assert extract(page, Weights({}, {})) == words(1, 60)
    assert extract("<ul><li class='menu'>home<li>first<li>second</ul>", Weights({}, {})) == "first second"


ARTICLE = f"<h1>The title</h1><p>{words(1, 60)}</p><p>{words(2, 30)}</p>"
TEXT = f"The title {words(1, 60)} {words(2, 30)}"


@pytest.mark.parametrize("n", [5, 400])
@pytest.mark.parametrize("learnt", [False, True])
@pytest.mark.parametrize(
    "page",
    [
        "<article>@<div class='comments'>#</div></article>",
        "<article>@</article><section id='comments'><article class='comment-body'><p>#</p></article><article class='comment-body'>#</article></section>",
        "<main>@<section class='comments'><article>#</article><article><h1>a reader's title</h1>#</article></section></main>",
        "<div class='entry'>@</div><div class='comments'><h2>Comments</h2><p>#</p></div>",
        "<div class='entry'>@</div><ol class='comment-list'><li id='comment-7'>#</li></ol><div id='respond'>#</div>",
        "<article>@<div class='sidebar'><p>#</p></div></article>",
        "<article class='post comments-open'>@<aside>#</aside></article><article class='user-comment'>#</article>",
        "<div class='page has-sidebar'><div class='sidebar'>#</div><div>@</div></div>",
        "<body class='single'><main><article>@</article><div class='related-posts'><h2>Read on</h2><ul><li>#</li></ul></div></main><footer>#</footer></body>",
        "<div id='page' class='comments-open'><div class='menu'>#</div><article>@<nav class='pagination'>#</nav></article><div id='disqus_thread'>#</div></div>",
    ],
)
def test_main_text_does_not_depend_on_the_size_of_boilerplate(page, learnt, n):
    weights = Weights({"w:p": 900.0, "p": 90.0, "w:article": 100.0}, {"w:p": 1000.0, "p": 100.0, "w:article": 110.0, "w:p~": 900.0, "p~": 90.0}) if learnt else Weights({}, {})
    assert extract(page.replace("@", ARTICLE).replace("#", words(9, n)), weights) == TEXT


def test_best_run_matches_every_run():
    """The linear scan against all runs of tokens."""
    from memlake.llm.main_text import parse

    r = random.Random(6)
    for _ in range(150):
        page = "".join(r.choice(["<p>", "</p>", "<li>", "<a href=x>", "</a>", "<div class=ad>", "</div>", "one two ", "three ", "<nav>", "</nav>", "<hr>"]) for _ in range(r.randrange(1, 16)))
        weights = Weights({"w:p": 5.0, "w:li": 0.0}, {"w:p": 6.0, "w:li": 30.0, "a": 8.0})
        found = [(w, k, m, x, d) for w, k, m, x, d in parse(page) if not (w and not d.split()) and not (x and m)]
        value = [weights.of(w, k, x, len(d.split()) if w else 1) for w, k, m, x, d in found]
        runs = [(sum(value[a:b]), -a, b) for a in range(len(found)) for b in range(a + 1, len(found) + 1)]
        best = max((v for v, _, _ in runs), default=0)
        kept = {" ".join("".join(d if w and not x else " " if not w and d not in ("a",) else "" for w, _, _, x, d in found[-a:b]).split()) for v, a, b in runs if abs(v - best) < 1e-9}
        assert extract(page, weights) in (kept if best > 1e-9 else {""})


def test_packing(spark):
    r = random.Random(2)
    sizes = sorted((r.randrange(1, 65) for _ in range(500)), reverse=True)
    placed = pack(sizes, (16, 32, 64), 4)
    spots = {}
    for n, (b, at, cap) in zip(sizes, placed, strict=True):
        spots.setdefault((b, cap), []).append((at, n))
    for (_, cap), own in spots.items():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0
        used = sum(n for _, n in own)
        assert used <= cap and cap == min(c for c in (16, 32, 64) if c >= used)
    assert sum(sizes) / sum(c for _, c in spots) > 0.95
    rows = best_fit(odd_docs(spark)).collect()
    assert sum(x.n_tokens for x in rows if x.doc_id == 10) == 30_000 and max(x.copy for x in rows) == 3
    assert {x.doc_id for x in rows}.isdisjoint({0, 1, 2}) and best_fit(empty_docs(spark)).count() == 0


def vectors(spark, n=300):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 16))
    x[n // 2 :] = x[rng.integers(0, 6, n - n // 2)] + rng.normal(scale=0.12, size=(n - n // 2, 16))
    rows = [(i, [float(np.float32(v)) for v in x[i]], int(i % 2)) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, [None] * 16, 0), (n + 4, [float("inf")] * 16, 1), (n + 5, rows[0][1], None), (n + 6, [], 0), (n + 8, [2 * v for v in rows[0][1]], 0), (n + 10, rows[0][1], 0), (n + 12, rows[0][1], 0)]
    return rows + odd


def test_multi_index_matches_brute_force(spark):
    rows = vectors(spark)
    got = {x.vec_id: x for x in multi_index_links(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()}
    ok = [(i, np.array(v, dtype=float), c) for i, v, c in rows if v and c is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    edges = [(a, b) for j, (a, v, c) in enumerate(ok) for b, w, d in ok[:j] if c == d and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= 0.93]
    comp = brute.least_reachable([r[0] for r in rows], edges)
    for i, _, _ in rows:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(i in e for e in edges), comp[i], comp[i] == i)
    assert multi_index_links(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_multi_sequence_visits_nearest_first():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(7)
    order = sorted(range(49), key=lambda c: a[c // 7] + b[c % 7])
    assert multi_sequence(a, b, 20) == order[:20]


def test_impact_index_matches_brute_force(spark):
    rows = vectors(spark, 900)
    got = impact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), every=50).collect()
    ok = [(i, np.floor(1024 * np.array(v, dtype=float)).astype(int)) for i, v, _ in rows if v and None not in v and np.isfinite(v).all()]
    for q, v in ok:
        if q % 50 == 0:
            want = sorted(((-int(v @ w), i) for i, w in ok if i != q))[:10]
            assert [(-x.score, x.vec_id) for x in sorted((x for x in got if x.query_id == q), key=lambda x: x.rank)] == want
    assert impact_topk(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    mixed = odd_docs(spark)
    columns = mixed.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, mixed, SF)
        assert out.columns == columns, name
        assert stage(spark, empty_docs(spark), SF).count() == 0, name
    kept = corpus_pipeline.drop_near_duplicates(spark, mixed, SF).collect()
    assert sorted(x.doc_id for x in kept if x.doc_id is not None) == [0, 1, 2, 3, 5, 6, 10, 12, 13]
    pii = spark.createDataFrame([(1, "call +1 (017) 555-7713 or a@b.de", "en", "s", 32)], docs.schema)
    assert corpus_pipeline.redact_personal_data(spark, pii, SF).first().text == "call [PHONE] or [EMAIL]"
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_near_duplicates_of_rows_without_or_with_one_id(spark):
    a, b, c, d = (words(i, 100) for i in (201, 202, 203, 204))
    rows = [(None, a), (None, a), (None, a + " tail"), (3, b), (None, b + " tail"), (7, c), (7, d), (7, d), (8, ""), (8, ""), (8, None), (None, " ")]
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, None, None, None, None, None) for i, t in rows], DOCS)
    kept = [(x.doc_id, x.text) for x in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()]
    nameless = [t for i, t in kept if i is None]
    assert len(nameless) == 2 and " " in nameless and (a in nameless or a + " tail" in nameless)
    assert sorted(((i, str(t)) for i, t in kept if i is not None)) == sorted([(3, b), (7, c), (7, d), (8, ""), (8, "None")])
    got = {(x.doc_id, x.n_shingles): (x.component_id, x.kept) for x in chosen_path_join(spark.createDataFrame([(3, b), (None, b + " tail")], "doc_id long, text string")).collect()}
    assert got == {(3, 96): (3, True), (None, 97): (3, False)}


def test_samples_do_not_empty_at_any_size(spark):
    rows = spark.range(2000)
    assert rows.where(sampled(["id"], 10**9, 10**10)).count() in range(120, 280)
    assert rows.where(sampled(["id"], 5000, 2000)).count() == 2000
    chosen = lambda n: {x.id for x in rows.repartition(n).where(sampled(["id"], 100, 2000)).collect()}
    assert chosen(1) == chosen(7) and 60 < len(chosen(1)) < 150
    assert spark.range(1).select(sampled(["id"], 800, 10**10).alias("x")).first().x in (True, False)


def test_pii_many_matches(spark):
    text = " ".join(f"write to user{i}@mail{i}.example.com or 10.0.0.{i % 250} or 555-123-{1000 + i} now" for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = pii_report(docs).first()
    assert (got.n_email, got.n_ip, got.base_sha256) == (3000, 3000, brute.span_digest(brute.base_spans(text)))


def test_pages_with_many_open_and_stray_tags():
    import time

    took = []
    for n in (4000, 8000, 16000):
        began = time.perf_counter()
        extract("<div>" * n + "x " + "</p>" * n, Weights({}, {}))
        took.append(time.perf_counter() - began)
    assert took[2] < 8 * took[0] + 0.5
    headline = f"<article><header><h1>The headline</h1><p>by someone</p></header><p>{words(1, 60)}</p></article>"
    assert extract(headline, Weights({}, {})) == "The headline " + words(1, 60)


def test_stages_carry_columns_of_any_name(spark):
    import corpus_pipeline

    extra = "candidates string, spans string, base_spans string, score double, _score int, _id long, row long, doc string, times int, unit string, rank int"
    text = "call +1 (017) 555-7713 or a@b.de"
    own = ("c", "s", "b", 0.9, 1, 2, 3, "d", 4, "u", 5)
    docs = spark.createDataFrame([(1, text, "en", "s", 32, *own), (None, words(5, 50), "en", "s", 9, *own)], "doc_id long, text string, lang string, source string, n_chars long, " + extra)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and {tuple(x)[5:] for x in out.collect()} == {own}, name


def test_licence_notices_near_and_whole(spark):
    mit = next(t for t in TEMPLATES if t[0] == "mit" and len(t[1].split()) > 50)[1].split()
    texts = [" ".join(mit), " ".join(mit[:70] + ["really"] + mit[70:]), " ".join(mit[:70] + mit[71:]), " ".join(mit[::-1]), " ".join(mit[:30])]
    got = {x.doc_id: x for x in license_scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all("mit" in got[i].labels.split(",") for i in (0, 1, 2)) and got[0].score == 1.0 and got[3].labels == ""


def test_multi_index_recall_at_twenty_thousand(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(20_000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    side = rng.normal(size=(4000, 32))
    side -= (side * x[:4000]).sum(1, keepdims=True) * x[:4000]
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    c = rng.uniform(0.931, 0.96, (4000, 1))
    x[16_000:] = c * x[:4000] + np.sqrt(1 - c**2) * side
    rows = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links = sum(r.n_links for r in multi_index_links(rows).select("n_links").collect()) // 2
    want = sum(int(np.triu(x[i : i + 2000] @ x.T >= 0.93, i + 1).sum()) for i in range(0, 20_000, 2000))
    assert want >= 4000 and 0.97 * want <= links <= want
