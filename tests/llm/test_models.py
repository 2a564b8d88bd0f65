"""Toxicity, main text, nearest neighbours and packing against plain versions."""

import random
import re
import time
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kinfolk.llm import html, neighbours, packing, toxicity
from tests.llm.helpers import ODD, documents, folder, prose

BAD = ["stupid", "idiot", "trash"]


def labelled(n, seed=0):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic = int(r.random() < 0.25)
        w = prose(seed * 10_000 + i, 60).split(" ")
        for _ in range(3 * toxic):
            w[r.randrange(60)] = r.choice(BAD)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, toxic))
    return rows, labels


def test_toxicity_held_out(spark, tmp_path):
    rows, labels = labelled(500)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    path = folder(spark, tmp_path / "t", rows + ODD, labels=lab)
    got = toxicity.op2_toxicity(spark, path).collect()
    assert len(got) == 500 + len(ODD)
    truth = {i: t for i, _, t in labels}
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    # labels of the held-out third change nothing
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    d = documents(spark, rows)
    a, b = toxicity.train(d, lab), toxicity.train(d, flipped)
    assert a.bias == b.bias and (a.weights == b.weights).all()


@pytest.mark.parametrize("labels", [[], [(1, 1, 0)], [(1, 1, 1), (2, 1, 1)], [(1, 1, None)]])
def test_toxicity_with_few_labels(spark, labels):
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    d = documents(spark, [(1, "a b c"), (2, None), (3, "")]).withColumn("score", F.lit("mine"))
    got = toxicity.score(d, toxicity.train(d, lab)).collect()
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert toxicity.score(d.limit(0), toxicity.train(d, lab)).count() == 0


def test_grams_do_not_cross_texts():
    whole = toxicity.present(["abc", "def", "", "é𝒳z"])
    parts = [toxicity.present([t])[1].tolist() for t in ["abc", "def", "", "é𝒳z"]]
    for i, want in enumerate(parts):
        assert whole[1][whole[0] == i].tolist() == want


def plain_grams(text):
    """Hash slots of the n-grams of a text by plain loops over whole numbers."""
    out = set()
    low = text.lower()
    for n in toxicity.SIZES:
        for i in range(len(low) - n + 1):
            h = ord(low[i]) + 1
            for c in low[i + 1 : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
            out.add((h * 0xD6E8FEB86659FD93 + n) % 2**64 >> (64 - toxicity.HASH_BITS))
    return out


def test_model_by_plain_loops():
    """Ratios, features and scores of a plain version; its regression ends at the same loss or above."""
    rows, labels = labelled(80, 4)
    texts, y = [t for _, t in rows] + ["é𝒳 ÄÖ", "ab"], np.array([t for _, _, t in labels] + [0, 1], float)
    model = toxicity.fit(texts, y)
    grams = [plain_grams(t) for t in texts]
    pos = Counter(g for s, t in zip(grams, y) if t for g in s)
    neg = Counter(g for s, t in zip(grams, y) if not t for g in s)
    often = {g for g in pos.keys() | neg.keys() if pos[g] + neg[g] >= toxicity.MIN_DOCUMENTS}
    assert set(model.slots.tolist()) <= often
    ratio = {g: np.log((pos[g] + 0.5) / (y.sum() + 1)) - np.log((neg[g] + 0.5) / (len(y) - y.sum() + 1)) for g in often}
    weight = dict(zip(model.slots.tolist(), model.weights))
    z = [model.bias + sum(weight.get(g, 0) for g in sorted(s)) for s in grams]
    assert toxicity.score_texts(model, texts) == pytest.approx(1 / (1 + np.exp(-np.array(z))), abs=1e-9)
    # weights are those of a regression on features scaled by the ratios: plain steps on its loss do not get below
    index = {g: k for k, g in enumerate(model.slots.tolist())}
    x = np.zeros((len(texts), len(index)))
    for i, s in enumerate(grams):
        for g in s & index.keys():
            x[i, index[g]] = ratio[g]
    loss = lambda w, b: np.mean(np.logaddexp(0, -(2 * y - 1) * (x @ w + b))) + toxicity.PENALTY / 2 * w @ w
    w, b = np.zeros(len(index)), float(np.log(y.mean() / (1 - y.mean())))
    for _ in range(300):
        g = 1 / (1 + np.exp(-(x @ w + b))) - y
        w, b = w - 4 / np.percentile((x**2).sum(1), 99) * (x.T @ g / len(y) + toxicity.PENALTY * w), b - g.mean()
    own = np.array([weight[g] / ratio[g] if ratio[g] else 0.0 for g in index])
    assert loss(own, model.bias) <= loss(w, b) + 1e-6


def test_scores_are_calibrated_on_rows_not_seen():
    """Slope and shift of a plain logistic regression on log-odds; the order of scores stays that of the model."""
    r = np.random.default_rng(3)
    odds = r.normal(0, 3, 400)
    y = (r.random(400) < 1 / (1 + np.exp(-(0.5 * odds + 1)))).astype(float)
    slope, shift = toxicity.calibration(odds, y)
    n = np.array([y.sum(), (1 - y).sum()])
    target = np.where(y > 0, (n[0] + 1) / (n[0] + 2), 1 / (n[1] + 2))
    a, b = 1.0, 0.0
    for _ in range(20_000):
        g = 1 / (1 + np.exp(-(a * odds + b))) - target
        a, b = a - 0.1 * (g * odds).mean(), b - 0.1 * g.mean()
    assert (slope, shift) == (pytest.approx(a, abs=1e-3), pytest.approx(b, abs=1e-3))
    assert all(np.isfinite(toxicity.calibration(np.array([-3.0, 2.0, 5.0]), np.array([0.0, 1.0, 1.0]))))
    rows, labels = labelled(90, 8)
    texts, t = [x for _, x in rows], np.array([x for _, _, x in labels], float)
    raw, own = toxicity.fit(texts, t), toxicity.fit_calibrated(texts, t)
    ratio = own.weights[raw.weights != 0] / raw.weights[raw.weights != 0]
    assert (own.slots == raw.slots).all() and ratio == pytest.approx(ratio[0]) and ratio[0] > 0
    # a fold that holds all toxic rows leaves a model without any
    alone = toxicity.fit_calibrated(["a bad one", "fine", "fine", "a bad one", "fine", "good"], np.array([1, 0, 0, 1, 0, 0], float))
    assert all(np.isfinite(alone.weights)) and np.isfinite(alone.bias)


def test_a_repeated_id_and_very_long_texts_are_one_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 3000)
    rows, labels = labelled(60, 5)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    d = documents(spark, rows + [(0, rows[0][1])] * 50)
    assert (toxicity.train(d, lab).weights == toxicity.train(documents(spark, rows), lab).weights).all()


def test_columns_of_any_name_stay(spark):
    rows, labels = labelled(60, 6)
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    d = documents(spark, rows).withColumns({n: F.lit("mine") for n in ("score", "__score", "toxic", "slots")})
    out = toxicity.without_toxic(d, lab)
    assert out.columns == d.columns and {(r.score, r["__score"], r.toxic, r.slots) for r in out.collect()} == {("mine",) * 4}


PAGE = (
    '<!DOCTYPE html><html><head><title>T {i}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/x">menu {i}</a></li></ul></nav>'
    '<div class="ad">buy {i}</div><{main}><h1>Head {i}</h1><p><b>One &amp; {i}.<br><p>Two\n  {i} <i>in</i>line &copy; it</p>{more}</{close}><footer>foot {i}</footer></body></html>'
)


def page(i, main="article", more="", close=None):
    return PAGE.format(i=i, main=main, more=more, close=close or main.split()[0])


def test_article_text():
    got = html.extract_group([page(i) for i in range(6)])
    assert got == [f"Head {i}\nOne & {i}.\nTwo {i} inline © it" for i in range(6)]


def test_template_without_article_names():
    got = html.extract_group([page(i, 'div class="x9"') for i in range(6)])
    assert got == [f"Head {i}\nOne & {i}.\nTwo {i} inline © it" for i in range(6)]


def test_furniture_inside_the_article_goes():
    more = '<aside>side</aside><form>f<input></form><div class="comments"><p>nice</p></div><!-- c --><noscript>n</noscript><p>end</p>'
    assert html.extract_group([page(1, more=more)]) == ["Head 1\nOne & 1.\nTwo 1 inline © it\nend"]


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (None, ""), ("", ""), ("plain  text\n here", "plain text here"), ("<p>a<p>b", "a\nb"), ("<ul><li>a<li>b</ul>c", "a\nb\nc"),
        ("<article>cut off <p>here", "cut off\nhere"), ("a < b &lt; c &#x41;&eacute", "a < b < c Aé"), ("<p title='x>y'>z</p>", "z"), ("</div>x</p>", "x"),
        ("<script>never ends <p>x", ""), ("<!-- open", ""), ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n2\n3"), ('<p title="open>x</p>', "x"),
    ],
)
def test_odd_markup(source, want):
    assert html.extract_group([source]) == [want]


def test_equivalence_classes_need_one_order():
    known = html.Words()
    pages = [html.parse(page(i), known) for i in range(4)]
    made = html.deduce([p.tokens for p in pages])
    tags = [tag for _, _, tag in html.elements(made, known)]
    assert tags.index("nav") < tags.index("article") < tags.index("footer")
    swapped = [html.parse("<a1></a1><b1></b1>", known), html.parse("<b1></b1><a1></a1>", known)]
    for c in html.equivalence_classes([p.tokens for p in swapped]):
        assert len({known["<", known["p", -1, t], frozenset()] for t in ("a1", "b1")} & set(c)) < 2


def plain(source):
    """The page without tags and attributes that tell what is what."""
    source = re.sub(r"<(/?)(?:article|nav|header|footer|aside|main)\b", r"<\1div", source)
    return re.sub(r'\s(?:class|id|role)="[^"]*"', "", source)


def test_roles_tell_like_tags_apart():
    """Four elements of one path are four elements of the template; nested classes have a slot."""
    known = html.Words()
    pages = [html.parse(plain(page(i, more="<p>x</p>" * i)), known) for i in range(6)]
    made = html.deduce([p.tokens for p in pages])
    assert [t for _, _, t in html.elements(made, known)].count("div") == 4
    name = {n: k for k, n in known.items()}
    assert {name[made.token[r]][0] for r in made.nested} == {"<", "="} and len(set(made.nested.values())) == 1


def sentences(seed, n):
    r = random.Random(seed)
    return ["".join(prose(r.randrange(10**6), r.randint(8, 30))) for _ in range(n)]


def test_the_template_finds_the_text_without_names():
    pages = [page(i, more="".join(f"<p>{t}</p>" for t in sentences(i, 2 + i % 4))) for i in range(8)]
    assert html.extract_group([plain(x) for x in pages]) == html.extract_group(pages)
    # alone, such a page keeps its menu, advert and footer
    assert [html.extract_group([plain(x)]) for x in pages[:1]] != [html.extract_group(pages[:1])]


def test_driver_pages_without_names_have_the_same_text(spark, data):
    hosts = {}
    for r in spark.read.parquet(f"{data}/pages.parquet").orderBy("page_id").collect():
        hosts.setdefault(r.url.split("/")[2], []).append(r.html)
    for pages in (p[:48] for p in hosts.values() if len(p) > 2):
        assert html.extract_group([plain(x) for x in pages]) == html.extract_group(pages)


def test_the_template_decides_against_an_even_look():
    """A varying box beside the text goes, a heading before it stays."""
    shape = "<body><div><span>Box {i} says {w}</span></div><h1>Head {i}</h1><div><p>{a}</p><p>{b}</p></div><div>Foot {i}</div></body>"
    texts = [sentences(50 + i, 2) for i in range(6)]
    got = html.extract_group([shape.format(i=i, w=i * 7, a=a, b=b) for i, (a, b) in enumerate(texts)])
    assert got == [f"Head {i}\n{a}\n{b}" for i, (a, b) in enumerate(texts)]


def test_words_of_nested_classes_go_with_their_element():
    """A box that each record of an article repeats is no text of its own, though it has no telling name."""
    record = '<p>{t}</p><div class="z3">Mark this</div>'
    pages = [page(i, more="".join(record.format(t=t) for t in sentences(i, 1 + i % 3))) for i in range(6)]
    assert html.extract_group(pages) == [f"Head {i}\nOne & {i}.\nTwo {i} inline © it\n" + "\n".join(sentences(i, 1 + i % 3)) for i in range(6)]


@pytest.mark.parametrize(
    ("inner", "stays"),
    [
        ('<p class="reply">said {i}</p>', True), ('<div class="share-price"><p>cost {i}</p></div>', True), ('<div class="comment-list"><p>c {i}</p></div>', False),
        ('<div class="site-header">h {i}</div>', False), ('<section id="comments">c {i}</section>', False), ('<span class="ad">n {i}</span>', True),
    ],
)
def test_names_of_text_and_of_furniture(inner, stays):
    own = re.sub("<[^>]*>", "", inner)
    for group in (1, 6):
        got = html.extract_group([page(i, 'div class="post"', more=inner.format(i=i)) for i in range(group)])
        assert [t.endswith("\n" + own.format(i=i)) for i, t in enumerate(got)] == [stays] * group


def test_deep_and_long_pages_take_linear_time():
    for deep in ("<div>" * 10_000, "<p><object>" + "<div>" * 10_000, "<li>" * 10_000, "<b><td>" * 5000, "</x><div class=a>" * 5000 + "</div>" * 5000, "<ul><li>" * 5000):
        began = time.process_time()
        assert html.extract_group([deep + "end", deep + "fin"]) == ["end", "fin"]
        assert time.process_time() - began < 4
    text = "word " * 400_000
    assert html.extract_group([f"<p>{text}</p>"]) == [text.strip()]


class Plain(HTMLParser):
    """Main text by the standard library's parser: what stands inside an article and not inside furniture."""

    def __init__(self):
        super().__init__()
        self.depth, self.skip, self.blocks = 0, 0, [[]]

    def handle_starttag(self, tag, attrs):
        self.depth += tag == "article"
        self.skip += tag in ("script", "style", "nav", "footer", "aside", "form")
        if tag in html.BLOCKS:
            self.blocks.append([])

    def handle_endtag(self, tag):
        self.depth -= tag == "article"
        self.skip -= tag in ("script", "style", "nav", "footer", "aside", "form")
        if tag in html.BLOCKS:
            self.blocks.append([])

    def handle_data(self, data):
        if self.depth and not self.skip:
            self.blocks[-1].append(data)


def test_driver_pages_against_another_parser(spark, data):
    rows = spark.read.parquet(f"{data}/pages.parquet").collect()
    got = {r.page_id: r.text for r in html.op3_html_extraction(spark, data).collect()}
    for r in rows:
        p = Plain()
        p.feed(r.html)
        p.close()
        assert got[r.page_id] == "\n".join(t for t in (" ".join("".join(b).split()) for b in p.blocks) if t)


def test_elements_of_the_template_inside_an_article_go():
    more = '<div class="zq7"><h3>Mind this</h3><p>the same <b>words</b> everywhere</p></div><p class="k2">more of us</p><p>End {i}</p>'
    pages = [page(i, more=more.format(i=i)) for i in range(6)]
    assert html.extract_group(pages) == [f"Head {i}\nOne & {i}.\nTwo {i} inline © it\nEnd {i}" for i in range(6)]


def test_named_elements_of_an_article_stay_if_they_vary_or_are_copies():
    quote = '<div class="zq7"><p>a quote</p></div>'
    copies = [page(7, more=quote)] * 4
    others = [page(i, more=f'<div class="k2">own {i}</div>') for i in range(3)]
    whole = "Head 7\nOne & 7.\nTwo 7 inline © it\na quote"
    assert html.extract_group(copies) == [whole] * 4
    assert html.extract_group(copies + others) == [*[whole] * 4, *[f"Head {i}\nOne & {i}.\nTwo {i} inline © it\nown {i}" for i in range(3)]]


def test_long_texts_with_one_opening_are_different_tokens():
    known = html.Words()
    a, b, c = (html.parse(f"<p>{'one opening ' * 30}{end}</p>", known).tokens[1] for end in ("x", "y", "x"))
    assert a == c != b
    more = '<div class="zq7"><p>' + "one opening " * 30 + "{i}</p></div>"
    got = html.extract_group([page(i, more=more.format(i=i)) for i in range(6)])
    assert [t.split("\n")[-1] for t in got] == ["one opening " * 30 + str(i) for i in range(6)]


def test_copies_of_an_article_keep_their_text():
    assert html.extract_group([page(7)] * 5) == ["Head 7\nOne & 7.\nTwo 7 inline © it"] * 5


SECOND = '<html><body class="b2"><section class="q1"><h2>Name {i}</h2><p>Words of {i}</p></section></body></html>'


@pytest.mark.parametrize("main", ["article", 'div class="x9"'])
@pytest.mark.parametrize(
    ("odd", "want"),
    [
        (["plain text\n here"], ["plain text here"]), (["<p>a fragment</p>"], ["a fragment"]), ([SECOND.format(i=1)], ["Name 1\nWords of 1"]),
        ([SECOND.format(i=i) for i in (1, 2, 3)], [f"Name {i}\nWords of {i}" for i in (1, 2, 3)]),
        (["plain one", "plain two", "<p>a</p>", "<p>b</p>", None, ""], ["plain one", "plain two", "a", "b", "", ""]),
        (["<p>same</p>", "<p>same</p>"], ["same", "same"]),
    ],
)
def test_pages_beside_the_template_keep_their_text(main, odd, want):
    own = [page(i, main) for i in range(7)]
    texts = [f"Head {i}\nOne & {i}.\nTwo {i} inline © it" for i in range(7)]
    assert html.extract_group([*own, *odd]) == [*texts, *want]
    assert html.extract_group([*odd, *own]) == [*want, *texts]


def test_a_page_with_its_text_in_another_slot_keeps_it():
    pages = [f"<html><body><article><p>Words {i}</p></article><hr><i>fixed</i></body></html>" for i in range(5)]
    pages.append("<html><body><article></article><hr><i>fixed</i><div>Late words</div></body></html>")
    assert html.extract_group(pages) == [*[f"Words {i}" for i in range(5)], "Late words"]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_pages_by_host(spark, monkeypatch, broadcast):
    monkeypatch.setattr(html, "BROADCAST_HOSTS", broadcast)
    rows = [(i, f"http://h{i % 2}.example.com/{i}", page(i)) for i in range(120)] + [(120, None, page(120)), (121, "http://h0.example.com/", None), (121, "http://h0.example.com/", None)]
    d = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("host", F.lit("mine")).withColumn("group", F.lit(1))
    got = sorted(tuple(r) for r in html.main_texts(d).collect() if r.url)
    want = [(i, u, t := "" if h is None else f"Head {i}\nOne & {i}.\nTwo {i} inline © it", len(t)) for i, u, h in rows if u]
    assert got == sorted(want)
    assert html.main_texts(d.limit(0)).count() == 0


def test_nearest_recall(spark):
    r = np.random.default_rng(2)
    x = (r.normal(size=(1500, 24)) * r.uniform(0.5, 2, size=(1500, 1))).astype("f4")
    d = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>")
    got = {}
    for row in neighbours.nearest(d, F.col("vec_id") % 20 == 0, shard_rows=400).collect():
        got.setdefault(row.query_id, []).append((row["rank"], row.vec_id, row.score))
    x = x.astype("f8")
    hits = []
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = sorted(range(1500), key=lambda i: (-s[i], i))[:20]
        mine = sorted(got[q])
        assert [k for k, _, _ in mine] == list(range(1, 21))
        assert all(abs(s[i] - v) < 1e-9 for _, i, v in mine) and mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        hits.append(len({i for _, i, _ in mine} & set(best)) / 20)
    assert np.mean(hits) >= 0.9


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (40, None), (60, [0.0, -0.0]), (80, [float("nan"), 1.0]), (1, [0.5, 0.5]), (2, [1.0, -0.0]), (3, [2.0, 2.0]),
            (4, [1.0, None]), (5, [-1.0, 0.0]), (6, [float("inf"), 0.0]), (100, [1.0, 2.0, 3.0]), (0, [1.0, 0.0])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("vec", F.lit("x")).withColumn("rank", F.lit(1))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in neighbours.nearest(d, F.col("vec_id") % 20 == 0, k=3).collect())
    assert got == [(0, 1, 3, 2.0), (0, 2, 2, 1.0), (0, 3, 20, 1.0), (20, 1, 3, 2.0), (20, 2, 0, 1.0), (20, 3, 2, 1.0)]
    assert neighbours.nearest(d.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_nearest_of_many_copies(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)] + [(1000, [2.0, 0.5])]
    d = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    got = {}
    for r in neighbours.nearest(d, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sorted(got[100]) == [*range(19), 1000] and sorted(got[0]) == [*range(1, 20), 1000]


@pytest.fixture(scope="module")
def tok():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.vocabulary_path())


@pytest.mark.parametrize(
    "text",
    ["a\x0bb", "Don't STOP'S", "É é́ ́x  y z", "<|endoftext|> hi", "İstanbul ΣΑΣ İx", "a\x0c b", "x\ty\r\nz 's", "the,.' x a,́ b.", "I'll, 3.14, a1, b!?", "x" * 12_000 + " yes,"],
)
def test_word_ids_equal_text_ids(tok, text):
    assert packing.WordTokenizer(packing.vocabulary_path()).ids(text).tolist() == tok.encode(text, add_special_tokens=False).ids


def test_random_texts_have_equal_ids(tok):
    r = random.Random(1)
    w = packing.WordTokenizer(packing.vocabulary_path())
    for _ in range(1500):
        t = "".join(r.choice("abXYéÉßÑ 01.,;:!?|%$#*&()'\"-_\n\t́가") for _ in range(r.randint(0, 30)))
        assert w.ids(t).tolist() == tok.encode(t, add_special_tokens=False).ids


def test_blocks_of_a_batch_have_equal_ids(tok, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 300)
    texts = [prose(i, 5 + i) + " É ñ Ünd" * (i % 4) if i % 5 else None for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60)), pa.array(texts, pa.string())], names=["doc_id", "text"])
    for b in (batch, batch.slice(7, 40)):
        (out,) = packing._cut(iter([b]), packing.vocabulary_path(), 4096, True)
        got = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in out.to_pylist()}
        assert got == {i: [*tok.encode(texts[i] or "", add_special_tokens=False).ids, 2] for i in b.column(0).to_pylist()}


def best_sum(counts, window):
    first = max(counts)
    sums = {first}
    for x, n in counts.items():
        for _ in range(n - (x == first)):
            sums |= {s + x for s in sums if s + x <= window}
    return max(sums)


@pytest.mark.parametrize("seed", range(5))
def test_best_fill_is_the_largest_sum(seed):
    r = random.Random(seed)
    counts = {r.randint(3, 60): r.randint(1, 4) for _ in range(8)}
    pattern = packing.best_fill(counts, 64)
    assert sum(x * n for x, n in pattern.items()) == best_sum(counts, 64) and all(n <= counts[x] for x, n in pattern.items())


def test_plan_uses_every_piece():
    r = random.Random(1)
    counts = Counter(r.randint(1, 4096) for _ in range(3000)) + Counter({4096: 50, 7: 5000})
    used = Counter()
    for times, pattern in packing.plan(dict(counts)):
        assert sum(x * n for x, n in pattern.items()) <= 4096
        for x, n in pattern.items():
            used[x] += times * n
    assert used == counts


@pytest.mark.parametrize("seed", range(5))
def test_best_fill_takes_as_many_pieces_as_fit(seed):
    r = random.Random(seed)
    counts = {r.randint(2, 9): r.randint(10, 60), r.randint(10, 40): 1, 41: 2}
    sums = {41}
    for x, n in counts.items():
        sums = {s + k * x for s in sums for k in range(n - (x == 41) + 1) if s + k * x <= 300}
    pattern = packing.best_fill(counts, 300)
    assert sum(x * n for x, n in pattern.items()) == max(sums) and all(n <= counts[x] for x, n in pattern.items())


@pytest.mark.parametrize(("length", "n"), [(60, 100_000), (1, 50_000), (1500, 999)])
def test_many_pieces_of_one_length_fill_windows(length, n):
    made = packing.plan({length: n})
    assert sum(times for times, _ in made) == -(-n // (4096 // length))
    assert sum(times * pattern[length] for times, pattern in made) == n


def test_short_pieces_fill_beside_long_ones():
    r = random.Random(3)
    counts = Counter(min(4096, max(1, int(r.lognormvariate(6, 1)))) for _ in range(20_000)) + Counter({40: 10_000})
    made = packing.plan(dict(counts))
    assert sum(x * n for x, n in counts.items()) > 0.99 * 4096 * sum(times for times, _ in made)


def test_packing(spark, tok, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_BYTES", 5000)
    rows = ODD + [(i, prose(i, 20 + 37 * i % 900)) for i in range(120)] + [(500 + i, "same words here") for i in range(200)]
    d = documents(spark, rows).withColumn("rank", F.lit("x")).withColumn("length", F.lit(1))
    cut = packing.pieces(d, window=256).cache()
    out = packing.pack(cut, window=256).collect()
    ids = {}
    for i, t in rows:
        ids.setdefault(i, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 2])
    total, fill = 0, {}
    for p in out:
        own = np.frombuffer(p.ids, "<u4")
        assert len(own) == p.length and zlib.crc32(p.ids) == p.ids_crc32
        assert any(own.tolist() == x[p.start : p.start + p.length] and len(x) == p.doc_tokens for x in ids[p.doc_id])
        total += p.length
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert total == sum(len(x) for v in ids.values() for x in v)
    for spans in fill.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 256
    assert 1 - total / (256 * len(fill)) < 0.02
    assert packing.pack(packing.pieces(d.limit(0))).count() == 0
