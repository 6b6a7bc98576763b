"""Classifier, extraction, decontamination, mixing and the pipeline."""

import html
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from grovekit.llm.decontaminate import find_leaks
from grovekit.llm.html_extract import blocks, extract_main_text, labelled_pages, main_text, trained_field
from grovekit.llm.mixing import Mix, entropy, mix_sources, mixed_texts, solve_exponent, weights_at
from grovekit.llm.quality import fit_quality

SF = "/root/testdata/sf0.01"


def words(r, k, stems="ba co di fu ga le mi no".split()):
    return " ".join("".join(r.choices(stems, k=r.randint(1, 4))) for _ in range(k))


def test_quality_on_held_out_rows(spark):
    r = random.Random(4)
    docs, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        docs.append((i, words(r, 60) + "." if good else " ".join(f"{w.upper()}!!" for w in words(r, 60).split()), 1.0))
        if i % 2:
            labels.append((i, int(good), None))
    docs += [(700, None, 0.0), (701, "", 0.0), (None, "ba co", 0.0), (1, docs[1][1], 0.0)]
    docs_df = spark.createDataFrame(docs, "doc_id bigint, text string, score double")
    model = fit_quality(docs_df, spark.createDataFrame(labels + [(5, None, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int"))
    got = model.score(docs_df).collect()
    assert len(got) == len(docs) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.7) for x in got)
    truth = {i: q for i, q, _ in labels}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 4 == 2) for x in got)
    assert len(held) > 40 and sum(x.predicted == truth[x.doc_id] for x in held) >= 0.95 * len(held)
    assert model.keep(docs_df).columns == docs_df.columns and model.keep(docs_df).count() == sum(x.predicted for x in got)
    none = fit_quality(docs_df, spark.createDataFrame([], "doc_id bigint, quality int"))
    assert {x.score for x in none.score(docs_df).collect()} == {1.0}
    assert model.score(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def test_quality_of_the_table(spark):
    """Held-out labels of the table, whole texts; a very long text is scored like its own kind."""
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_quality(docs, labels)
    got = model.score(docs).where("held_out").join(labels, "doc_id").where("quality is not null").toPandas()
    assert len(got) > 60 and (got.predicted == got.quality).mean() >= 0.9
    good = docs.join(labels.where("quality = 1"), "doc_id").orderBy("doc_id").first().text
    x = model.score(spark.createDataFrame([(1, good), (2, f"{good} " * (2_000_000 // len(good)))], "doc_id bigint, text string")).collect()
    assert x[0].predicted == x[1].predicted == 1


def test_blocks():
    page = "<html><head><title>t</title><script>var a='</p>';</script></head><body><!-- <p>no</p> --><p>a&amp;b <b>c</b>d<br>e\n  f<p>g<div>h<a href='>'>i</a></div>j</body>"
    assert [(b.text, b.linked) for b in blocks(page)] == [("a&b cd e f", 0), ("g", 0), ("hi", 1), ("j", 0)]
    assert blocks("") == [] and [b.text for b in blocks("plain &lt;text&gt;")] == ["plain <text>"]


def test_held_out_pages():
    field, right, all_words, found = trained_field(), 0, 0, 0
    for page, truth in labelled_pages(150, seed=77):
        want, got = Counter(" ".join(truth).split()), Counter(main_text(page, field).split())
        right += sum((want & got).values())
        all_words += sum(want.values())
        found += sum(got.values())
    assert right / all_words > 0.9 and right / found > 0.97


@pytest.mark.parametrize("name", "button select svg math object iframe template noscript textarea title".split())
def test_unclosed_elements_hide_nothing_else(name):
    field = trained_field()
    page = f"<article><h1>Head of it</h1><{name}>Share<p>First paragraph of the text, long enough.</p><p>A second one is here.</p></article>"
    kept = "" if name not in ("textarea", "title") else "Share "
    assert main_text(page, field).replace("Share ", kept) == f"Head of it {kept}First paragraph of the text, long enough. A second one is here."
    closed = f"<article><p>One sentence <{name}>Share<p>not this</p></{name}> of the text.</p><p>And a second one.</p></article>"
    assert "not this" not in main_text(closed, field) and "Share" not in main_text(closed, field)


def test_unbalanced_quotes_end_with_the_tag():
    field = trained_field()
    assert main_text("<article><p class=\"x>Text of the paragraph is here.</p><p class=\"y\">And more of it.</p></article>", field) == "Text of the paragraph is here. And more of it."
    assert [b.text for b in blocks("<p title='a > b' data-x=\"<p>no</p>\">yes</p>")] == ["yes"]


def test_deep_and_long_pages():
    field = trained_field()
    deep = "<div class='w1 w2'>" * 20_000 + "<p>word " * 20_000
    assert len(blocks(deep, field.index)) == 20_000
    assert len(blocks("<span>" * 20_000 + "</b>" * 20_000 + "<button>" * 20_000 + "text")) == 0
    long = "<article><h1>Title of it</h1>" + "<p>One sentence of the text, with some words.</p>" * 20_000 + "</article>"
    assert main_text(long, field).count("sentence") == 20_000


def test_pages_of_another_generator():
    """The article of each page of the table, by its tags, and pages written by hand."""
    field, same, n = trained_field(), 0, 0
    for (page,) in duckdb.sql(f"select html from '{SF}/pages.parquet'").fetchall():
        article = re.sub("<[^>]*>", "", re.sub("<br>|</?(?:p|h1)>", " ", re.search("<article>(.*)</article>", page, re.S)[1]))
        same += " ".join(html.unescape(article).split()) == main_text(page, field)
        n += 1
    assert same >= 0.98 * n > 100
    hand = """<html><body><header class="site-header"><a href="/">The Daily</a><nav><ul><li><a href="/w">World</a></li><li><a href="/s">Sport</a></li></ul></nav></header>
    <div class="cookie-banner"><p>We use cookies on this site.</p><button>Accept</button></div><div class="container"><main><article class="story"><h1>Rain ends the match</h1>
    <p>The match was stopped after twenty minutes, when the pitch was under water.</p><aside class="related"><h4>Read more</h4><ul><li><a href="/a">Old match</a></li></ul></aside>
    <p>It will be played again in June, the league said on Monday.</p></article></main><div class="sidebar"><h3>Popular</h3><ul><li><a href="/p">Most read story</a></li></ul></div></div>
    <section class="comments"><h3>2 comments</h3><div class="comment"><p>What a pity!</p></div></section><footer><p>&copy; 2024 The Daily</p></footer></body></html>"""
    assert main_text(hand, field) == "Rain ends the match The match was stopped after twenty minutes, when the pitch was under water. It will be played again in June, the league said on Monday."


def test_extraction_rows(spark):
    article = "<article><h1>Head line</h1><p>One &eacute;two,  three words of the text here.</p><p>And another sentence.</p></article>"
    page = f"<html><body><nav><ul><li><a href='/'>Home</a></li><li><a href='/x'>More</a></li></ul></nav>{article}<div class='comments'><p>Nice one!</p></div><footer>&copy; 2020 site</footer></body></html>"
    rows = [(1, "u", page, "t"), (2, None, None, "t"), (3, "v", "", "t"), (1, "u", page, "t"), (None, "w", "<p></p>", "t")]
    got = extract_main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.text) for r in got if r.page_id == 1] == [(1, "u", "Head line One étwo, three words of the text here. And another sentence.")] * 2
    assert [(r.page_id, r.text, r.n_chars) for r in got if r.page_id != 1] == [(2, "", 0), (3, "", 0), (None, "", 0)]
    assert extract_main_text(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_leaks(spark):
    r = random.Random(6)
    item = "A farmer named Anna sells 12 apples for 3 euros each and then buys 5 kg of flour from Anna again before the market closes at noon"
    items = [(1, item), (2, words(r, 30)), (3, "tiny item here"), (4, None)]
    docs = [
        (1, f"{words(r, 20)} {item} {words(r, 20)}"),
        (2, words(r, 15) + " " + item.replace("Anna", "Peter").replace("12", "40").replace("3", "7").replace("kg", "lb")),  # new parameters
        (3, words(r, 15) + " " + item.replace("Anna", "Peter", 1).replace("12", "5").replace("3", "5")),  # slots that clash
        (4, words(r, 200)),
        (5, None),
        (6, ""),
        (None, item),
        (7, "so, tiny item here it is"),
        (8, item),
        (8, item),
    ]
    leaks = find_leaks(spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id bigint, text string, cover int"), spark.createDataFrame(items, "item_id bigint, text string"))
    got = {(x.doc_id, x.item_id): x.reparameterised for x in leaks.collect()}
    assert got == {(1, 1): False, (2, 1): True, (7, 3): False, (8, 1): False}
    assert find_leaks(spark.createDataFrame([], "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")).count() == 0
    assert find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([], "item_id bigint, text string")).count() == 0


def test_leaks_of_poor_windows_names_and_clashes(spark):
    r = random.Random(7)
    fill = lambda: words(r, 20)
    tom = "Tom has 5 apples. Tom gives Ann 2 apples. Ann buys 3 pears."
    long = f"{words(r, 20)} 12 {words(r, 10)} 12 {words(r, 8)}"
    part = words(r, 25)
    lined = f"{words(r, 5)} Anna {words(r, 3)} Peter {words(r, 3)} Carla {words(r, 3)} Maria {words(r, 3)}"
    table = "Paris 12 14 Rome 15 19 Berlin 8 11 Madrid 20 25 Oslo 2 4"
    items = [(1, "What is 12 times 7?"), (2, table), (3, f"{part} {words(r, 30)}"), (4, tom), (5, lined), (6, long)]
    docs = [
        (1, f"{fill()} What is 12 times 7? {fill()}"),
        (2, f"{fill()} {table} {fill()}"),
        (3, f"{fill()} {part} {fill()}"),  # a long verbatim run, less than half of the item
        (4, f"{fill()}. {tom.replace('Tom', 'Bob').replace('Ann', 'Eve').replace('5', '9')} {fill()}"),
        (5, f"{fill()} {lined.lower()} {fill()}"),
        (6, lined.replace(" Anna", "\nAnna").replace(" Peter", "\nPeter").replace(" Carla", "\nCarla")),
        (7, f"{fill()} {long[::-1].replace('21', '31', 1)[::-1]} {fill()}"),  # one of two equal numbers changed
        (8, f"{fill()} What is 13 times 8? {fill()}"),
    ]
    got = find_leaks(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"))
    assert {(x.doc_id, x.item_id) for x in got.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 5), (7, 6)}


def test_leaks_against_containment(spark):
    docs, items = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    plain = lambda t: " ".join(t.lower().split())
    texts = [(d.doc_id, plain(d.text)) for d in docs.collect()]
    inside = {(i, b.item_id) for b in items.collect() for i, t in texts if plain(b.text) in t}
    assert {(x.doc_id, x.item_id) for x in find_leaks(docs, items).collect()} == inside


def test_exponent():
    tokens = {"a": 900, "b": 90, "c": 10}
    a = solve_exponent(tokens, Mix(entropy_share=0.8, max_epochs=1e9))
    assert entropy(weights_at(tokens, a)) == pytest.approx(0.8 * 1.0986, abs=1e-3)
    b = solve_exponent(tokens, Mix(entropy_share=1.0, max_epochs=3.0))
    assert max(w * 1000 / tokens[s] for s, w in weights_at(tokens, b).items()) == pytest.approx(3.0, abs=1e-3)
    assert solve_exponent({"a": 5, "b": 5}, Mix()) == 1.0


def test_exponent_beyond_one_and_limits():
    even = {"a": 50, "b": 40, "c": 45}
    a = solve_exponent(even, Mix(entropy_share=0.7, max_epochs=1e9))
    assert a > 1 and entropy(weights_at(even, a)) == pytest.approx(0.7 * 1.0986, abs=1e-3)
    b = solve_exponent(even, Mix(entropy_share=0.5, max_epochs=1.2))
    assert max(w * 135 / even[s] for s, w in weights_at(even, b).items()) == pytest.approx(1.2, abs=1e-3)
    with pytest.raises(ValueError):
        solve_exponent({"a": 900, "b": 100}, Mix(max_epochs=2.0, budget=9090))


def test_mixed_texts_keep_columns(spark):
    rows = [(i, f"text {i} of this", "a" if i % 3 else "b", i * 10, "own") for i in range(40)] + [(None, "no id", "a", 1, "own"), (None, None, "a", 1, "own")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, epoch int, `my col` string")
    got = mixed_texts(docs).collect()
    assert {(x.doc_id, x.text, x.doc_epoch, x["my col"]) for x in got} <= {(i, t, e, c) for i, t, _, e, c in rows}
    taken = Counter((x.doc_id, x.epoch, x.place) for x in mix_sources(docs).collect())
    assert taken == Counter((x.doc_id, x.epoch, x.place) for x in got) and set(taken.values()) == {1}


def test_many_blocks_in_parts(spark, monkeypatch):
    import grovekit.llm.mixing as m

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('w ', repeat('x ', cast(id % 7 as int))) as text", "'s' as source")
    mix = Mix(block_tokens=20, budget=30_000)
    monkeypatch.setattr(m, "PART", 16)
    got = mix_sources(docs, mix).toPandas().sort_values("place")
    total = int(got[got.epoch == 0].n_tokens.sum())
    assert (got[got.epoch == 0].groupby("doc_id").size() == 1).all() and (got.epoch == 0).sum() == 3000
    # places are the running sums: nothing overlaps and nothing is left out
    assert (got.place * 30_000).round().astype(int).tolist() == [0, *got.n_tokens.cumsum().tolist()][:-1]
    assert abs(got.n_tokens.sum() - 30_000) < 10 and total == sum(1 + i % 7 for i in range(3000))


@pytest.mark.parametrize("mix", [Mix(), Mix(entropy_share=1.0, block_tokens=300), Mix(entropy_share=0.95, max_epochs=2.5, block_tokens=200, budget=9000)])
def test_budgets(spark, mix):
    r = random.Random(9)
    rows = [(i, words(r, r.randint(1, 60)), r.choices(["a", "b", None], [10, 3, 1])[0], i) for i in range(400)] + [(900, None, "a", 0), (901, "  ", "b", 0), (None, "ba co", "a", 0), (5, "ba", "a", 0), (5, "ba", "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, epoch int")
    got = mix_sources(docs, mix).collect()
    tokens = Counter()
    for _, t, s, _ in rows:
        tokens[s] += len((t or "").split())
    weights = weights_at(tokens, solve_exponent(tokens, mix))
    budget = mix.budget or sum(tokens.values())
    for s in tokens:
        mine = [x for x in got if x.source == s]
        assert 0 <= sum(x.n_tokens for x in mine) - weights[s] * budget + 1e-6 < 61
        epochs = Counter((x.doc_id, x.epoch) for x in mine if x.doc_id not in (5,))
        assert max(epochs.values()) == 1
        last = max(x.epoch for x in mine)
        whole = sum(bool((t or "").split()) for _, t, q, _ in rows if q == s)
        assert all(sum(x.epoch == e for x in mine) == whole for e in range(last))
    assert all(0 <= x.place < 1 for x in got)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mix_sources(docs.repartition(3), mix).collect()), key=str)
    assert mixed_texts(docs, mix).count() == len(got)
    assert mix_sources(spark.createDataFrame([], docs.schema)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.write_table(stage(spark, docs, SF), f"test-{name}")
        if name != "mixing":
            assert docs.columns == columns
            assert 0 < docs.count() <= kept
            kept = docs.count()
    assert {"doc_id", "text", "epoch", "place"} <= set(docs.columns)
