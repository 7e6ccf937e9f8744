"""Quality rules, mixing, classifiers and page text."""

import collections
import random
import re

import numpy as np
import pytest
from samples import collected, frame, rows, spaced, texts

from geoalbums.llm import language, main_text, quality_classifier
from geoalbums.llm.mixing import MixConfig, mix_sources
from geoalbums.llm.page_blocks import blocks
from geoalbums.llm.quality_rules import QualityConfig, quality_rules


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark).cache()


def test_quality_rules(docs):
    cfg = QualityConfig(line_share=0.1, line_documents=3)
    data = rows()
    texts_of, count = collections.defaultdict(set), collections.defaultdict(set)
    for i, r in enumerate(data):
        document = ("row", i) if r[0] is None else r[0]
        texts_of[r[3]].add(document)
        for line in (r[1] or "").split("\n"):
            key = tuple(spaced(line.lower()))
            if key:
                count[r[3], key].add(document)
    expected = []
    for r in data:
        text = r[1] or ""
        w, seen, dup, gone, left = spaced(text), set(), 0, [], []
        for number, line in enumerate(text.split("\n")):
            key = tuple(spaced(line.lower()))
            if key:
                dup += line in seen
                seen.add(line)
                n = len(count[r[3], key])
                if n >= 3 and n > 0.1 * len(texts_of[r[3]]):
                    gone.append(number)
                    continue
            left.append(line)
        grams = collections.Counter(tuple(w[s : s + 5]) for s in range(len(w) - 4))
        again = {p for s in range(len(w) - 4) if grams[tuple(w[s : s + 5])] > 1 for p in range(s, s + 5)}
        failed = len(w) < 10 or 100 * len(again) > 20 * len(w)
        n_left = len(spaced("\n".join(left)))
        kept = not failed and n_left >= 10 and 100 * n_left >= 30 * len(w)
        symbols = len(re.findall(r"[#*$%&|<>]", text))
        expected.append((r[0], len(w), sum(map(len, w)), symbols, dup, len(again), failed, n_left, gone, kept, None if r[1] is None else "\n".join(left)))
    out = quality_rules(docs, cfg, with_text=True)
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "removed_lines", "kept", "text")
    assert collected(out, *names) == sorted(expected, key=repr)
    assert any(r[8] for r in expected)


def test_mix(spark):
    rng = random.Random(2)
    data = [(i, f"s{i % 6}" if i % 6 < 5 else None, " ".join("w" * rng.randrange(0, 60))) for i in range(3000)]
    data += [(9999, "s0", "one row many times over")] * 200
    docs = spark.createDataFrame(data, "doc_id long, source string, text string").repartition(5)
    found = mix_sources(docs, MixConfig(block=8)).collect()
    assert len(found) == len(data)
    sizes = collections.Counter()
    for doc, source, text in data:
        sizes[source] += len(spaced(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: share * weight[s] for s in open_}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        open_ -= over
    taken, largest = collections.Counter(), collections.Counter()
    for r in found:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * target[r["source"]]
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in order:
        assert abs(taken[s] - target[s]) <= 3 < largest[s] / 2
    again = mix_sources(docs.repartition(2), MixConfig(block=8))
    assert collected(again, "doc_id", "size", "taken") == sorted(((r["doc_id"], r["size"], r["taken"]) for r in found), key=repr)
    other = mix_sources(docs, MixConfig(block=8, seed=3))
    assert collected(other, "doc_id", "size", "taken") != sorted(((r["doc_id"], r["size"], r["taken"]) for r in found), key=repr)


def test_mix_with_one_long_document(spark):
    """A long document that is left open does not take its source off the target."""
    rng = random.Random(8)
    data = [(i, f"s{i % 9}", " ".join("w" * rng.randrange(20, 200))) for i in range(900)]
    data += [(1000 + i, f"s{i}", " ".join("w" * 5000)) for i in range(9)]
    docs = spark.createDataFrame(data, "doc_id long, source string, text string")
    for seed in (1, 2):
        sums = collections.defaultdict(lambda: [0, 0.0])
        for r in mix_sources(docs, MixConfig(seed=seed)).collect():
            assert 0 <= r["taken"] <= 2 * r["size"]
            sums[r["source"]][0] += r["taken"]
            sums[r["source"]][1] = r["target"]
        assert all(abs(taken - target) <= 20 for taken, target in sums.values())


def test_mix_odds(spark):
    """Every document has its source's odds, over many draws."""
    docs = spark.createDataFrame([(i, "a" if i < 40 else "b", "w " * (1 + i % 7)) for i in range(80)], "doc_id long, source string, text string").cache()
    total = collections.Counter()
    for seed in range(25):
        for r in mix_sources(docs, MixConfig(seed=100 * seed, weights=(1, 3), factor=0.5, block=8)).collect():
            total[r["doc_id"]] += r["copies"]
    low = [total[i] / 25 for i in range(40)]
    assert abs(np.mean(low) - 0.25) < 0.05 and max(low) < 0.7


def test_mix_has_no_python(docs):
    from pyspark.sql import DataFrame

    plan = mix_sources(docs)._jdf.queryExecution().executedPlan().toString()
    assert isinstance(docs, DataFrame) and not re.search("Python|Pandas|Arrow", plan)


def test_odd_rows_are_mixed(docs):
    found = mix_sources(docs)
    assert found.count() == len(rows())
    assert found.where("size = 0 AND taken > 0").count() == 0


def test_language(spark, docs):
    unseen = language.held_out(docs.doc_id, 4, 2)
    model = language.train(docs.where(~unseen).select("doc_id", "text", "lang"))
    assert model.languages == ("de", "en", "fr")
    out = language.identify(docs, model)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "lang_pred", "score"]
    found = out.collect()
    assert len(found) == len(rows())
    for r in found:
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert 1 / 3 <= r["score"] <= 1
    held = [(lang, text) for text, lang in texts(77, 30) if lang]
    judged = language.identify(spark.createDataFrame(held, "lang string, text string"), model).collect()
    letters = [r for r in judged if re.search("[a-z]{3}", r["text"])]
    assert np.mean([r["lang"] == r["lang_pred"] for r in letters]) > 0.95


def test_language_scores_by_hand(spark):
    """A known word counts by its frequency, an unseen one by its longest known pieces."""
    data = [(i, "aa bb aa", "x") for i in range(4)] + [(10 + i, "cc bb", "y") for i in range(4)]
    model = language.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    counts = {"aa": (8, 0), "bb": (4, 4), "cc": (0, 4)}
    total = [sum(c[j] for c in counts.values()) + 0.5 * 4 for j in (0, 1)]
    text = np.frombuffer(b"aa bb cca", dtype=np.uint8)
    got = language.word_scores(model, text, np.array([0, 3, 6]), np.array([2, 5, 9]))
    for i, w in enumerate(("aa", "bb")):
        assert np.allclose(got[i], [np.log((counts[w][j] + 0.5) / total[j]) for j in (0, 1)])
    # " cca " is unseen, and so are its pieces of 5 and 4 bytes; of those of 3, " cc" is known
    three = {" aa": (8, 0), "aa ": (8, 0), " bb": (4, 4), "bb ": (4, 4), " cc": (0, 4), "cc ": (0, 4)}
    total = [sum(c[j] for c in three.values()) + 0.5 * 7 for j in (0, 1)]
    assert np.allclose(got[2], [np.log(0.5 / total[0]), np.log(4.5 / total[1])])


def test_language_by_characters(spark):
    """Pieces are cut between characters, and letters beyond ASCII have one case."""
    data = [(1, "Éa ÜÜ", "x"), (2, "éa üß", "y"), (3, "漢字", "z")]
    model = language.train(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    assert len(model.known[0]) == 4  # éa, üü, üß, 漢字
    pieces = [{p for w in ("éa", "üü", "üß", "漢字") for p in [f" {w} "[i : i + n] for i in range(5 - n)]} for n in (5, 4, 3, 2, 1)]
    assert [len(k) for k in model.known[1:]] == [len(p) for p in pieces]
    text = np.frombuffer("é字".encode(), dtype=np.uint8)
    got = language.word_scores(model, text, np.array([0]), np.array([5]))[0]
    # of " é字 " two pieces of two characters are known: " é" (once in x, once in y) and "字 " (once in z)
    counts = {" é": (1, 1, 0), "字 ": (0, 0, 1)}
    each = [{}, {}, {}]
    for words, own in ((("éa", "üü"), each[0]), (("éa", "üß"), each[1]), (("漢字",), each[2])):
        for w in words:
            for i in range(3):
                piece = f" {w} "[i : i + 2]
                own[piece] = own.get(piece, 0) + 1
    size = len(model.known[4])
    total = [sum(own.values()) + 0.5 * (size + 1) for own in each]
    expected = [np.mean([np.log((c[j] + 0.5) / total[j]) for c in counts.values()]) for j in range(3)]
    assert np.allclose(got, expected)


def test_nothing_to_learn_from(spark):
    empty = frame(spark, [])
    model = language.train(empty)
    assert model.languages == ()
    assert language.identify(empty, model).collect() == []
    assert {r["lang_pred"] for r in language.identify(frame(spark), model).collect()} == {"und"}


def test_boosting_learns():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(quality_classifier.STATISTICS)))
    y = ((x[:, 3] > 0.5) ^ (x[:, 7] > 0.3)).astype(float)
    model = quality_classifier.fit(x[:2000], y[:2000])
    found = quality_classifier.scores(model, x[2000:])
    assert np.mean((found > 0.5) == (y[2000:] > 0.5)) > 0.95
    binned = quality_classifier.to_bins(x[:50], model.edges)
    for row, got in zip(binned, quality_classifier.scores(model, x[:50])):  # one row, one node at a time
        total = model.base
        for feature, above, leaf in zip(model.feature, model.bin, model.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + 1 + int(row[feature[node]] > above[node])
            total += leaf[node - len(feature)]
        assert np.isclose(got, 1 / (1 + np.exp(-total)))


def test_quality_classifier(spark, docs):
    labels = [(r[0], int("!!" not in (r[1] or "") and "##" not in (r[1] or "")), None) for r in rows()] + [(None, 1, 0), (1, None, 1)]
    model = quality_classifier.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    out = quality_classifier.score_quality(docs, model)
    found = out.collect()
    assert len(found) == len(rows()) and all(0 <= r["score"] <= 1 for r in found)
    none = spark.createDataFrame([], "doc_id long, quality int")
    flat = quality_classifier.score_quality(docs, quality_classifier.train(docs, none)).collect()
    assert {r["score"] for r in flat} == {0.5}
    assert quality_classifier.score_quality(frame(spark, []), model).collect() == []


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x = "</p>";</script></head><body>
<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav><div class="ad">Buy</div>
<article><h1>Head  &amp; line</h1><p>One <b>two</b>
three&nbsp;four<br>five<p>Six &lt;seven&gt; &#8364;<!-- note --><p>Eight</article><footer>&copy; us</footer></body></html>"""


def test_blocks():
    found = [(b.path[-1], b.text, b.linked) for b in blocks(PAGE)]
    assert found == [
        ("title", "T", 0), ("a", "Home", 4), ("a", "News", 4), (".ad", "Buy", 0), ("h1", "Head & line", 0),
        ("p", "One two three four five", 0), ("p", "Six <seven> €", 0), ("p", "Eight", 0), ("footer", "© us", 0),
    ] or found == [
        ("title", "T", 0), ("li", "Home", 4), ("li", "News", 4), (".ad", "Buy", 0), ("h1", "Head & line", 0),
        ("p", "One two three four five", 0), ("p", "Six <seven> €", 0), ("p", "Eight", 0), ("footer", "© us", 0),
    ]
    assert blocks("") == [] and blocks("<p") == [] and blocks("a < b <br") == blocks("a < b")


@pytest.mark.parametrize("inside, kept", [
    ('<svg width="1" viewBox="0 0 1 1"/>', ""), ("<svg/>", ""), ("<svg><path d='M0'/><text>gone</text></svg>", ""), ("<SVG><g></svg >", ""),
    ("<svg-icon>i</svg-icon>", "i"), ("<object-view/>", ""), ("<template-x>t</template-x>", "t"), ("<script_x>s</script_x>", "s"),
    ("<math><mi>x</mi><mo>=</mo><mn>1</mn></math>", "x=1"), ('<object data="a.pdf">instead</object>', "instead"),
    ("<svg><path>", ""), ("<template>", ""), ("<noscript>", ""), ("<iframe src='a'>", ""), ("<math>", ""), ("<object>", ""),
    ("<template>gone</template>", ""), ("<script>if (a < b) '<p>'</script>", ""), ("<style>p > a {}</style >", ""),
    ("<svg><foreignObject><p>gone</p></foreignObject></svg>", ""),
])
def test_text_after_dropped_elements(inside, kept):
    page = f"<body><p>before {inside} after</p><p>more</p><svg><g/></svg><p>last</p></body>"
    text = " ".join(b.text for b in blocks(page))
    assert text.split() == ["before", *kept.split(), "after", "more", "last"]
    assert [b.text for b in blocks("<p>a</p><script>b<p>c</p>")] == ["a"]


def test_lstm_gradients():
    """Against differences of the loss."""
    rng = np.random.default_rng(1)
    x, mask = rng.standard_normal((5, 3, 4)), np.ones((5, 3), dtype=bool)
    mask[3:, 1] = mask[1:, 2] = False
    weights = [rng.standard_normal(s) * 0.5 for s in ((4, 8), (2, 8), (8,))]
    d_out = rng.standard_normal((5, 3, 2))
    loss = lambda: float((main_text._lstm(x, mask, weights) * d_out).sum())
    _, tape = main_text._lstm(x, mask, weights, keep=True)
    grads = main_text._lstm_gradients(x, mask, weights, tape, d_out)
    for p, g in zip(weights, grads):
        for at in [tuple(rng.integers(0, s) for s in p.shape) for _ in range(6)]:
            before = p[at]
            p[at] = before + 1e-5
            up = loss()
            p[at] = before - 1e-5
            down = loss()
            p[at] = before
            assert np.isclose((up - down) / 2e-5, g[at], atol=1e-5)


def test_main_text(spark):
    rng = random.Random(9)
    pages, expected = [], []
    for i in range(140):
        body = [" ".join(rng.choice("alpha beta gamma delta of the".split()) for _ in range(rng.randrange(3, 60))) + "." for _ in range(rng.randrange(1, 7))]
        html = PAGE[: PAGE.index("<article>")] + "<article>" + "".join(f"<p>{b}" for b in body) + "</article><footer>end</footer>"
        pages.append((i, f"u{i}", html))
        expected.append("\n\n".join(body))
    pages += [(None, None, None), (200, "e", ""), (3, "u3", pages[3][2])]
    frame_ = spark.createDataFrame([(*p, 1) for p in pages], "page_id long, url string, html string, text int")
    model = main_text.train(frame_)
    found = main_text.main_text(frame_, model)
    got = {r["page_id"]: r for r in found.collect()}
    assert found.count() == len(pages)
    assert np.mean([got[i]["text"] == expected[i] for i in range(140)]) > 0.97
    assert got[None]["text"] == got[200]["text"] == "" and got[200]["n_chars"] == 0
    nothing = frame_.where("false")
    assert main_text.train(nothing) is None
    assert main_text.main_text(nothing, None).collect() == []


def test_long_pages_are_learned_from():
    rng = random.Random(3)
    body = lambda: " ".join(rng.choice("alpha beta gamma delta of the".split()) for _ in range(rng.randrange(5, 40))) + "."
    pages = []
    for n in (130, 260, 151, 400):
        inner = "".join(f"<p>{body()}</p>" for _ in range(n))
        pages.append(blocks(f"<nav><a>Home</a></nav><article>{inner}</article><div class=comments><p>{body()}</div><footer>end</footer>"))
    model = main_text.fit(pages, main_text.LabellerConfig(rounds=20, batch=4))
    assert model is not None
    right = [main_text.label(model, [page])[0] == main_text.rule_labels(page) for page in pages]
    assert np.mean(np.concatenate(right)) > 0.97


def test_rules_label_where_nothing_is_learned():
    page = blocks("<nav><a>Home</a></nav><article><p>One two three.</p></article><footer>end</footer>")
    assert main_text.fit([[], []]) is None
    assert [b.text for b, main in zip(page, main_text.label(None, [page, []])[0]) if main] == ["One two three."]


@pytest.mark.parametrize("apply", [quality_rules, mix_sources])
def test_empty_tables(spark, apply):
    assert apply(frame(spark, [])).collect() == []
