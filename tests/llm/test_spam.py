import random
import time

import pyarrow as pa
import pytest
from conftest import rows
from pyspark.ml.classification import RandomForestClassifier
from pyspark.sql import functions as F

from foldstone.llm import spam
from foldstone.llm.spam import FEATURES, LIST, SENTENCE, spam_pages, spam_report, spam_scores, stretches

S = "doc_id bigint, text string, host string"


@pytest.mark.parametrize("text", ["a-" * 200_000, "a." * 200_000, "<!--" * 100_000, "x@" * 100_000, "." * 300_000, "www." * 100_000, "a\n" * 200_000, "#a" * 200_000])
def test_long_odd_texts_take_linear_time(text):
    began = time.process_time()
    spam.Forms([stretches(text)])
    assert time.process_time() - began < 20


@pytest.mark.parametrize(
    "text",
    [
        "tent sale tent sale tent sale tent sale tent cheap tent sale",
        "http://a.test/x www.b.example/y hxxp://c.invalid/z d.test/w e.test/v f.test/u",
        "#tent | #sale | #cheap | #buy | #online | #offer | #deal",
        "red\nsmall\nheavy\nsoft\nlarge\nround\nblue",
        "cheap tent, buy tent, best tent, sale tent, cheap kettle, best lamp",
        "colour: red; weight: 3 kg; size: XL; brand: Nolo; motor: 12 V",
    ],
)
def test_clear_lists(text):
    assert {*spam.Forms([stretches(text)]).kinds} == {LIST}


@pytest.mark.parametrize("text", ["The lid broke after two days. The lid broke after two days.", "Nobody there answered my mails, so it went back and the money never came!", "Das Gerät läuft seit drei Wochen ohne jede Störung."])
def test_clear_sentences(text):
    assert {*spam.Forms([stretches(text)]).kinds} == {SENTENCE}


@pytest.mark.parametrize("text", ["Plain words, here: some | more; and... an end! No stop\nnext line\n\nlast = one", "a 。b。c", " - a - b * c\n", "it's: \n , x"])
def test_both_ways_to_cut_agree(text):
    shown = lambda cut: [(s.tokens, s.parts, s.stopped, s.lined) for s in cut]
    assert shown(spam._plain(text)) == shown(spam._marked(text, spam._LINKED)) == shown(spam._marked(text, spam._TAGGED))


@pytest.mark.parametrize("text", [None, "", "!!!", " \n\n "])
def test_texts_without_words(text):
    assert stretches(text) == [] and spam.Forms([[]]).features.tolist() == [[0.0] * len(FEATURES)]


def test_pages_are_measured_together_as_alone():
    texts = [None, "One two three. One two three. a b a b a b", "#x #y http://a.test/q, c | d | e | f", "", "It broke after two days, sadly. x; y; z; u", "same same same same same same same same same"] * 3
    alone = [spam.Forms([stretches(t)]).features[0].tolist() for t in texts]
    assert spam.Forms([stretches(t) for t in texts]).features.tolist() == alone


def test_features_of_a_page():
    f = dict(zip(FEATURES, spam.Forms([stretches("One two three four five. One two three four five. a b, a b; a b\nhttp://q.test/z")]).features[0].tolist(), strict=True))
    assert f["links"] == 1 / 17 and f["separators"] == 2 / 17 and f["stops"] == 2 / 17 and f["unstopped"] == 7 / 17 and f["sentences"] == 10 / 17
    assert f["variety"] == 8 / 12 and f["top"] == 3 / 12 and f["recurring"] == 6 / 12 and f["small"] == 8 / 12 and f["anchored"] == 1 / 17 and f["short"] == 1 / 17
    assert f["pairs"] == 1 - 6 / 9


def test_labels_come_from_other_pages_only():
    """A word is worth what the other pages do with it: the page's own stretch is taken out again."""
    code = spam._Hashes()
    counts = {spam._generic(spam._ANY): (50, 50), code["tent"]: (9, 1), code["the"]: (1, 9), code["alone"]: (4, 0), spam._generic(spam._TAG_TOKEN): (9, 1)}
    of = lambda tokens, kinds: spam.evidence(counts)(pa.array([[code[t] for t in tokens]], pa.list_(pa.int64())), pa.array([kinds], pa.list_(pa.int8())))[0].as_py()
    assert of(["tent"] * 9, [LIST] * 9) == {"share": 1.0, "known": 1.0} and of(["the"] * 9, [LIST] * 9) == {"share": 0.0, "known": 1.0}
    assert of(["alone"] * 3, [LIST] * 3)["known"] == 1.0 and of(["never", "said"], [LIST] * 2) == {"share": 0.0, "known": 0.0}
    assert of(["#never"], [LIST]) == {"share": 1.0, "known": 1.0} and of(["@never"], [LIST]) == {"share": 0.0, "known": 0.0}  # as tags do; of links nothing is known
    counts[code["alone"]] = (3, 0)
    assert of(["alone"] * 3, [LIST] * 3) == {"share": 0.0, "known": 0.0}  # three pages, of which one is this


WHO, DID, WHAT, WHY = ("my sister", "our neighbour", "the whole office", "an old friend"), ("sent back", "bought", "never used", "really likes"), ("the tent", "the kettle", "this lamp", "that grey bag"), ("after a week", "because of the price", "and that says a lot", "without any reason")
NOUNS = ["tent", "kettle", "lamp", "bag", "phone case", "mirror", "carpet", "drill"]


def sentence(r):
    return f"{r.choice(WHO).capitalize()} {r.choice(DID)} {r.choice(WHAT)} {r.choice(WHY)}{r.choice('..!')}"


def keywords(r, n):
    return [f"{r.choice(('cheap', 'buy', 'best', 'sale', 'online', 'discount'))} {r.choice(NOUNS)}" for _ in range(n)]


# shapes that the operator was never tried on while it was written: (text of a spam page, text of a good one that resembles it)
HELD_OUT = {
    "numbered": (lambda r: "\n".join(f"{i}) {k}" for i, k in enumerate(keywords(r, 20), 1)), lambda r: "\n".join(f"{i}) {sentence(r)}" for i in range(1, 6))),
    "arrows": (lambda r: " » ".join(keywords(r, 25)), lambda r: " » ".join(sentence(r) for _ in range(4))),
    "markup links": (lambda r: "<ul>" + "".join(f'<li>http://shop{r.randrange(30)}.example/{r.choice(NOUNS)[:4]}{i}</li>' for i in range(9)) + "</ul>", lambda r: f"<p>{sentence(r)} {sentence(r)} See http://shop{r.randrange(30)}.example/faq for more.</p>"),
    "attributes": (lambda r: ", ".join(f"{r.choice(('weight', 'colour', 'size', 'power'))}={r.randrange(90)}" for _ in range(15)), lambda r: f"{sentence(r)} Weight: 3 kg, colour: red. {sentence(r)} {sentence(r)}"),
    "tags behind a line": (lambda r: sentence(r) + "\n" + " ".join("#" + k.replace(" ", "") for k in keywords(r, 30)), lambda r: " ".join(sentence(r) for _ in range(4)) + " #tent #sale"),
    "no marks": (lambda r: " ".join(keywords(r, 40)), lambda r: " ".join([sentence(r)] * 4)),
}


def corpus(seed, n=900, spammed=0.1):
    r = random.Random(seed)
    out, truth = [], set()
    for i in range(n):
        kind = r.choice(sorted(HELD_OUT))
        if r.random() < spammed:
            truth.add(i)
            out.append((i, HELD_OUT[kind][0](r), f"host{i % 9}"))
        else:
            out.append((i, HELD_OUT[kind][1](r) if r.random() < 0.3 else " ".join(sentence(r) for _ in range(r.randrange(2, 8))), f"host{i % 9}"))
    return out, truth


@pytest.mark.parametrize("seed", [3, 8])
def test_held_out_accuracy(spark, seed):
    docs, truth = corpus(seed)
    got = {r["doc_id"] for r in spam_pages(spark.createDataFrame(docs, S), "host").collect()}
    assert len(got & truth) >= 0.95 * len(truth) and len(got - truth) <= 0.05 * len(truth)


def test_trees_decide(spark, monkeypatch):
    """Trees that learn the opposite find the opposite: no rule stands behind them."""
    docs, truth = corpus(4)
    df = spark.createDataFrame(docs, S)
    assert set(FEATURES) < set(spam_scores(df, "host").columns)
    fit = RandomForestClassifier.fit
    monkeypatch.setattr(RandomForestClassifier, "fit", lambda self, train: fit(self, train.withColumn("label", 1 - F.col("label"))))
    got = {r["doc_id"] for r in spam_pages(df, "host").collect()}
    assert len(got & truth) <= 0.05 * len(truth) and len(got - truth) >= 0.9 * (len(docs) - len(truth))


def test_hosts_change_verdicts(spark):
    """The same page, half a list: spam on a host of spam, good on a host of good pages."""
    docs, truth = corpus(5, 1200)
    docs = [(i, t, "bad" if i in truth and i % 2 else "good") for i, t, _ in docs]
    r = random.Random(1)
    half = [f"{sentence(r)} {sentence(r)}\n" + ", ".join(keywords(r, n)) for n in range(1, 14)]
    docs += [(5000 + k, t, "bad") for k, t in enumerate(half)] + [(6000 + k, t, "good") for k, t in enumerate(half)]
    scores = spam_scores(spark.createDataFrame(docs, S), "host", pull=1.0)
    report = spam_report(scores).first()
    assert report["added"] > 0
    by = {x["doc_id"]: x for x in scores.where("doc_id >= 5000").collect()}
    assert all(by[5000 + k]["score"] == by[6000 + k]["score"] for k in range(13))
    assert all(by[5000 + k]["smoothed"] > by[6000 + k]["smoothed"] for k in range(13) if by[5000 + k]["score"] > 0)
    assert any(by[5000 + k]["smoothed"] >= 0.5 > by[6000 + k]["smoothed"] for k in range(13))


def test_a_rare_language_is_judged_by_form(spark):
    """Pages whose words no other page has get no label, but a score like any other."""
    docs, _ = corpus(6)
    r = random.Random(2)
    word = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    docs += [(7000, ", ".join(f"{word()} {word()}" for _ in range(20)), None), (7001, " ".join(f"{word().capitalize()} si {word()} la {word()} {word()} en {word()}." for _ in range(5)), None)]
    assert rows(spam_pages(spark.createDataFrame(docs, S), "host").where("doc_id >= 7000")) == [(7000,)]


def test_sampled_classes_keep_their_weight():
    assert spam.class_weight(96_000, 10_000) == 9.6 and spam.class_weight(400, 10_000) == 1.0 and spam.class_weight(0, 10_000) == 1.0


def test_a_small_sample_finds_the_same(spark):
    docs, truth = corpus(7)
    got = {r["doc_id"] for r in spam_pages(spark.createDataFrame(docs, S), "host", sample=40).collect()}
    assert len(got & truth) >= 0.9 * len(truth) and len(got - truth) <= 0.1 * len(truth)


def test_nulls_repeats_empty_and_clashes(spark):
    odd = [(1, None, None), (2, "", "h"), (2, "", "h"), (3, "x" * 300_000, None), (None, "some text here.", "h")]
    r = spam_scores(spark.createDataFrame([(*o, 1.0, "w") for o in odd], S + ", score double, word string"), "host")
    assert r.count() == 5 and r.where(F.col("smoothed") > 0).count() == 0 and spam_pages(spark.createDataFrame(odd, S), "host").count() == 0
    assert rows(spam_pages(spark.createDataFrame([], S), "host")) == []
    docs, truth = corpus(9, 500)
    twice = spark.createDataFrame(docs + docs[:50] + [(900, None, None), (901, "", "host1")], S)
    scores = spam_scores(twice, "host")
    assert scores.where("doc_id >= 900 and smoothed > 0").count() == 0 and scores.groupBy("doc_id").agg(F.count_distinct("score").alias("n")).where("n > 1").count() == 0
