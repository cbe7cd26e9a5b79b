import random

import pyarrow as pa
import pytest
from conftest import rows

from foldstone.llm import leakage
from foldstone.llm.leakage import Leaks, postings
from foldstone.llm.words import words

D, I = "doc_id bigint, text string", "item_id bigint, text string"


@pytest.mark.parametrize(
    "text, want",
    [
        (None, []),
        ("", []),
        ("Crème BRÛLÉE", ["creme", "brulee"]),
        ("ｆｕｌｌ width", ["full", "width"]),
        ("in­vis​ible", ["invisible"]),
        ("a&nbsp;b&amp;c &eacute;t&eacute;", ["a", "b", "c", "ete"]),
        ("<p>one<br/>two</p><b>th</b>", ["one", "two", "th"]),
        ("don't_stop,it's", ["don", "t", "stop", "it", "s"]),
        ("Straße", ["strasse"]),
        ("2 < 3 > 1", ["2", "3", "1"]),
        ("a<!-- x <b> y -->b<!-- open", ["a", "b", "open"]),
        ("&lt;b&gt;bold&lt;/b&gt;", ["bold"]),
    ],
)
def test_words(text, want):
    assert words(text) == want


def brute(docs, items, n):
    out = set()
    for i, t in items:
        ws = words(t)
        grams = {tuple(ws[k : k + n]) for k in range(len(ws) - n + 1)}
        for d, x in docs:
            wd = words(x)
            if any(tuple(wd[k : k + n]) in grams for k in range(len(wd) - n + 1)):
                out.add((d, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(12 if seed else 4)]  # few words: many chance meetings
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    items = [(i, say(r.randrange(3, 40))) for i in range(8)]
    docs = [(d, say(r.randrange(0, 30)) + ". " + (" ".join(r.choice(items)[1].split()[r.randrange(4) :]) if d % 2 else "") + " " + say(5)) for d in range(40)]
    found = Leaks(spark.createDataFrame(docs, D), spark.createDataFrame(items, I)).exact(6)
    assert rows(found.select("doc_id", "item_id")) == brute(docs, items, 6)


def test_longest_run_and_disguises(spark):
    item = " ".join(f"word{i}" for i in range(20))
    docs = [(1, "x <b>" + item.upper().replace(" ", ", ") + "</b>"), (2, item.replace("word", "wo​rd")), (3, " ".join(item.split()[:11])), (4, None), (5, ""), (6, "filler " * 200_000 + item)]
    leaks = Leaks(spark.createDataFrame(docs, D), spark.createDataFrame([(7, item), (8, None), (9, "")], I))
    assert rows(leaks.exact(12)) == [(1, 7, 20), (2, 7, 20), (6, 7, 20)]


def test_near_matches_allow_changes(spark):
    ws = [f"word{i}" for i in range(16)]
    changed = [w if i not in (3, 9) else "other" for i, w in enumerate(ws)]
    added = ws[:5] + ["extra"] + ws[5:]
    docs = [(1, " ".join(changed)), (2, " ".join(added)), (3, " ".join(ws[:8])), (4, " ".join(reversed(ws)))]
    leaks = Leaks(spark.createDataFrame(docs, D), spark.createDataFrame([(1, " ".join(ws))], I))
    assert rows(leaks.near().select("doc_id")) == [(1,), (2,)] and leaks.exact(12).count() == 0


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d", "x", 1)], D + ", term string, pos int")
    assert Leaks(docs, spark.createDataFrame([], I)).exact(2).count() == 0
    assert Leaks(docs.limit(0), spark.createDataFrame([(1, "a b c")], I)).exact(2).count() == 0
    assert rows(Leaks(docs, spark.createDataFrame([(1, "b c"), (1, "b c")], I)).exact(2)) == [(1, 1, 2)]


def test_a_full_index_has_every_word(spark):
    got = postings(spark.createDataFrame([(1, "b a b")], D))
    assert rows(got) == [("a", 1, [1]), ("b", 1, [0, 2])]


def near_brute(docs, items, least, window, slack):
    """A window of an item, and a shift at which one of its rarest words stands in the document exactly."""
    said = {d: words(x) for d, x in docs}
    df = {}
    for ws in said.values():
        for w in set(ws):
            df[w] = df.get(w, 0) + 1
    out = set()
    for i, t in items:
        ws = words(t)
        for s in range(len(ws) - window + 1):
            span = range(s, s + window)
            rare = sorted((df.get(ws[o], 0), o, ws[o]) for o in span)[: window - least + 1]
            for d, wd in said.items():
                shifts = {p - o for _, o, w in rare for p, x in enumerate(wd) if x == w}
                at = lambda p, wd=wd: wd[p] if 0 <= p < len(wd) else None
                if any(sum(any(at(sh + o + k) == ws[o] for k in range(-slack, slack + 1)) for o in span) >= least for sh in shifts):
                    out.add((d, i))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", range(2))
def test_near_equals_brute_force(spark, seed):
    r = random.Random(seed)
    say = lambda n: [f"w{r.randrange(30)}" for _ in range(n)]
    items = [(i, say(20)) for i in range(5)]
    docs = []
    for d in range(30):
        ws = list(r.choice(items)[1])
        for _ in range(r.randrange(6)):
            k = r.randrange(len(ws))
            ws[k : k + r.randrange(2)] = say(r.randrange(2))
        docs.append((d, " ".join(say(3) + ws + say(3))))
    items = [(i, " ".join(ws)) for i, ws in items]
    found = Leaks(spark.createDataFrame(docs, D), spark.createDataFrame(items, I)).near(7, 9, 1)
    assert rows(found.select("doc_id", "item_id")) == near_brute(docs, items, 7, 9, 1)


@pytest.mark.parametrize("limit, value", [("MOST_TERMS", 5), ("FLUSH", 7)])
def test_limits_of_memory_change_no_row(spark, monkeypatch, limit, value):
    """Beyond MOST_TERMS every word is indexed; with a small FLUSH every list and layout is cut."""
    r = random.Random(3)
    say = lambda n: " ".join(f"w{r.randrange(20)}" for _ in range(n))
    items = [(i, say(30)) for i in range(4)]
    docs = [(d, say(10) + " " + r.choice(items)[1][20:] + " " + say(10)) for d in range(20)]
    leaks = lambda: Leaks(spark.createDataFrame(docs, D), spark.createDataFrame(items, I))
    want = rows(leaks().exact(6)), rows(leaks().near(7, 9, 1))
    monkeypatch.setattr(leakage, limit, value)
    assert (rows(leaks().exact(6)), rows(leaks().near(7, 9, 1))) == want and want[0]


def test_an_id_with_several_texts_is_searched_for_each(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "w x y z"), (3, "a x c z")], D)
    found = Leaks(docs, spark.createDataFrame([(7, "a b c d"), (7, "w x y z q")], I)).exact(3)
    assert rows(found) == [(1, 7, 4), (2, 7, 4)]


@pytest.mark.parametrize("seed", range(5))
def test_dense_places_equal_brute_force(seed):
    """Also where a pair reaches over the ends of batches, and rows repeat."""
    r = random.Random(seed)
    met = [(d, i, r.randrange(-5, 12), r.randrange(8), r.random() < 0.5) for d, i in sorted((r.randrange(3), r.randrange(2)) for _ in range(r.randrange(200)))]
    want = {}
    for d, i, s, o, strong in met:
        about = {x[2:4] for x in met if x[:2] == (d, i) and abs(x[2] - s) <= 2}
        if strong and len(about) >= 3:
            want.setdefault((d, i), set()).add((s, o))
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("shift", pa.int32()), ("off", pa.int32()), ("strong", pa.bool_())])
    n = r.randrange(1, 30)
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, x, strict=True)) for x in met[k : k + n]], schema) for k in range(0, len(met), n)]
    got = [((x["doc_id"], x["item_id"]), {(p["shift"], p["anchor"]) for p in x["places"]}) for b in leakage._dense(3, 2)(iter(batches)) for x in b.to_pylist()]
    assert dict(got) == want and len(got) == len(want)
