"""Keyword-stuffed pages, link lists and tag lists: bagged trees on weak labels, smoothed by host.

Two views of a page are kept apart. The trees see its *form*: links, tags, stops, separators, repetition. The weak labels come from
its *words*, by what other pages do with them: a word that others use in lists speaks for a list, one that others use in sentences
for a sentence. What a page's own form says has no part in its label, and what its words are has none in its features.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from foldstone.llm.words import visible
from foldstone.session import broadcast_if_small, materialise, spread

FEATURES = ["links", "tags", "separators", "stops", "unstopped", "itemised", "sentences", "lists", "variety", "top", "recurring", "pairs", "small", "short", "pace", "anchored", "size"]
#: Weakly labelled pages of each class that the trees are fitted to, the first in a hashed order.
SAMPLE = 10_000
#: Tokens of the corpus that weak labels know, those on most pages first: this bounds what is sent to the tasks.
VOCABULARY = 200_000
#: Other pages on which a token must stand in a clear list or sentence before it says anything.
LEAST = 3
#: A token's evidence is that of the tokens up to REACH places around it; a page's label is the share of tokens whose evidence is for a list.
REACH, LIST_FROM, SENTENCES_TO, KNOWN = 4, 0.7, 0.2, 0.5

_IS_WORD, _IS_STOP, _IS_SEP = r"[^\W_]+(?:['’][^\W_]+)*", r"[.!?…]+(?=\s|$)|[。！？]", r"[|;•·,、，；\\/:=]|->|\s[-–—*+]\s"
_WORD, _END, _SEP = re.compile(_IS_WORD), re.compile(f"({_IS_STOP}|\n)"), re.compile(_IS_SEP)
_WORDY = f"(?P<word>{_IS_WORD})|(?P<stop>{_IS_STOP})|(?P<line>\n)|(?P<sep>{_IS_SEP})"
_TAGS = r"(?P<tag>[#＃][^\W_]+(?:_+[^\W_]+)*)|"
_LINKS = r"(?P<link>(?:h(?:tt|xx)ps?://|www\.)\S+|(?<![\w.@-])[\w-]{1,63}(?:\.[\w-]{1,63}){0,8}\.[a-z]{2,15}(?:/\S*)?(?=[\s|,;<>\")\]!?.:]|$))|"
_TAGGED, _LINKED = re.compile(_TAGS + _WORDY), re.compile(_LINKS + _TAGS + _WORDY)
_DOMAIN = re.compile(r"(?:\w+://)?(?:www\.)?([^/\s?#]+)")
_DOTTED = re.compile(r"\.[a-z]{2}")

LIST, SENTENCE, UNCLEAR = 1, 2, 0


class Stretch:
    """What stands between two full stops or line ends: its tokens, and the sizes of its parts between separators."""

    __slots__ = ("tokens", "links", "tags", "parts", "stopped", "lined")

    def __init__(self) -> None:
        self.tokens: list[str] = []
        self.links = self.tags = 0
        self.parts = [0]
        self.stopped = self.lined = False


def stretches(text: str | None) -> list[Stretch]:
    """The text cut once, in linear time. A list with an item a line is one stretch."""
    text = visible(text or "").lower()
    text = text if text.isascii() else unicodedata.normalize("NFKC", text)
    linked = "://" in text or _DOTTED.search(text) is not None
    out = _marked(text, _LINKED if linked else _TAGGED) if linked or "#" in text else _plain(text)
    return _joined(out) if len(out) > 2 else out


def _plain(text: str) -> list[Stretch]:
    """The stretches of a text without links and tags, split by whole patterns."""
    out: list[Stretch] = []
    cut = _END.split(text)
    for piece, end in zip(cut[::2], [*cut[1::2], "\n"], strict=True):
        cut_up = [_WORD.findall(x) for x in _SEP.split(piece)]
        tokens = cut_up[0] if len(cut_up) == 1 else [t for x in cut_up for t in x]
        if not tokens:
            continue
        now = Stretch()
        now.tokens, now.parts, now.lined, now.stopped = tokens, [len(x) for x in cut_up], end == "\n", end != "\n"
        out.append(now)
    return out


def _marked(text: str, pattern: re.Pattern) -> list[Stretch]:
    """The stretches of a text in which links, or tags, are told from words."""
    out: list[Stretch] = []
    now = Stretch()
    for m in pattern.finditer(text):
        kind = m.lastgroup
        if kind == "word":
            now.tokens.append(m.group())
            now.parts[-1] += 1
        elif kind == "sep":
            now.parts.append(0)
        elif kind == "link":
            now.tokens.append("@" + _DOMAIN.match(m.group()).group(1))
            now.links += 1
            now.parts[-1] += 1
        elif kind == "tag":
            now.tokens.append("#" + m.group()[1:])
            now.tags += 1
            now.parts[-1] += 1
        elif now.tokens:
            now.stopped, now.lined = kind == "stop", kind == "line"
            out.append(now)
            now = Stretch()
    if now.tokens:
        now.lined = True
        out.append(now)
    return out


def _joined(parts: list[Stretch]) -> list[Stretch]:
    """Three or more neighbouring lines of up to four words without a full stop are the items of one list."""
    out: list[Stretch] = []
    run: list[Stretch] = []
    for p in [*parts, Stretch()]:
        if p.lined and len(p.tokens) <= 4:
            run.append(p)
            continue
        if len(run) >= 3:
            whole = Stretch()
            whole.tokens = [t for x in run for t in x.tokens]
            whole.links, whole.tags, whole.lined = sum(x.links for x in run), sum(x.tags for x in run), True
            whole.parts = [n for x in run for n in x.parts]
            out.append(whole)
        else:
            out += run
        run = []
        if p.tokens:
            out.append(p)
    return out


#: Two bits of a token's hash say what it is; a hash that is nothing else stands for all of its kind, and the fourth for every page.
_LINK_TOKEN, _TAG_TOKEN, _ANY = 1, 2, 3
#: Distinct tokens whose hashes a task remembers, and tokens that it measures at once.
_HELD = 500_000


class _Hashes(dict):
    """64-bit hashes of tokens, those met before remembered."""

    def __missing__(self, token: str) -> int:
        if len(self) > _HELD:
            self.clear()
        kind = _LINK_TOKEN if token[0] == "@" else _TAG_TOKEN if token[0] == "#" else 0
        self[token] = made = (xxh3_64_intdigest(token) & ~3 | kind) - (1 << 63)
        return made


def _generic(kind: int) -> int:
    return kind - (1 << 63)


def _runs(codes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the distinct codes of each group, in any order: the place of one, and how often it occurs. Both are told apart by one 64-bit mix of them."""
    if not len(codes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    with np.errstate(over="ignore"):
        key = codes.view(np.uint64) ^ ((group.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        key = (key ^ (key >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
    order = np.argsort(key)
    sorted_ = key[order]
    at = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return order[at], np.diff(at, append=len(order))


class Forms:
    """Many pages, cut into stretches, measured together: ``features`` (a row a page), ``kinds`` (of each stretch) and the tokens.

    Features are mostly shares of a page's tokens. Stretches that repeat as a whole count once where repetition is measured.
    """

    def __init__(self, pages: list[list[Stretch]], hashed: _Hashes | None = None):
        hashed = _Hashes() if hashed is None else hashed
        every = [s for page in pages for s in page]
        self.page = np.repeat(np.arange(len(pages)), [len(page) for page in pages])
        self.n = n = np.array([len(s.tokens) for s in every], dtype=np.int64)
        words = [t for s in every for t in s.tokens]
        self.codes = codes = np.array([hashed[t] for t in words], dtype=np.int64)
        self.of = of = np.repeat(np.arange(len(every)), n)
        links, tags, stopped = (np.array([getattr(s, x) for s in every], dtype=np.int64) for x in ("links", "tags", "stopped"))
        cut = np.array([len(s.parts) for s in every], dtype=np.int64)
        part, part_of = np.array([x for s in every for x in s.parts], dtype=np.int64), np.repeat(np.arange(len(every)), cut)
        by_stretch = lambda at, weights=None: np.bincount(at, weights=weights, minlength=len(every))
        by_page = lambda weights: np.bincount(self.page, weights=weights, minlength=len(pages))

        first, _ = _runs(codes, of)
        distinct, marked = by_stretch(of[first]), links + tags
        filled, in_small = by_stretch(part_of, part > 0), by_stretch(part_of, part * (part <= 3))
        lists = (n >= 4) & ((marked >= 0.4 * n) | ((n >= 8) & (distinct <= 0.5 * n)) | ((filled >= 4) & (in_small >= 0.8 * n)))
        said = ~lists & (stopped > 0) & (marked == 0) & (n >= 5) & (distinct >= 0.7 * n) & (n >= 3 * filled)
        self.kinds = np.where(lists, LIST, np.where(said, SENTENCE, UNCLEAR)).astype(np.int8)

        # a stretch's tokens in their order as one number: equal ones of a page count once
        place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        with np.errstate(over="ignore"):
            weight = (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes.view(np.uint64) * weight, dtype=np.uint64)])
            ends = np.cumsum(n)
            whole = sums[ends] - sums[ends - n]
            follows = np.flatnonzero(place[1:] > 0)
            pair = codes.view(np.uint64)[follows] * np.uint64(0xBF58476D1CE4E5B9) + codes.view(np.uint64)[follows + 1]
        once = np.zeros(len(every), dtype=bool)
        once[_runs(whole, self.page)[0]] = True
        kept, page_of = once[of], self.page[of]
        seen, often = _runs(codes[kept], page_of[kept])
        word_page = page_of[kept][seen]
        sums_of = lambda at, weights=None: np.bincount(at, weights=weights, minlength=len(pages))
        again = kept[follows]
        pairs = sums_of(page_of[follows][again][_runs(pair[again], page_of[follows][again])[0]])
        top = np.zeros(len(pages))
        np.maximum.at(top, word_page, often)
        small = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) <= 3
        held = by_page(n * once)
        total, some = np.maximum(by_page(n), 1), np.maximum(held, 1)
        columns = [
            by_page(links) / total, by_page(tags) / total, by_page(cut - 1) / total, by_page(stopped) / total, by_page(n * (stopped == 0)) / total, by_page(in_small * (cut >= 4)) / total, by_page(n * said) / total, by_page(n * lists) / total,
            sums_of(word_page) / some, top / some, sums_of(word_page, often * (often >= 3)) / some, 1 - np.minimum(1.0, pairs / np.maximum(1, held - by_page(once))), sums_of(page_of[kept], small[kept]) / some, by_page(n * (n <= 3)) / total,
            np.log1p(total / np.maximum(1, by_page(np.ones(len(every))))), by_page(n * ((links > 0) & (n <= 7 * links))) / total, np.log1p(by_page(n)),
        ]
        self.features = np.stack(columns, axis=1) * (by_page(n) > 0)[:, None]

    def tokens_by_kind(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of clear lists, then of clear sentences: the tokens of each page once, with how many pages have each; links, tags and all pages too."""
        out = []
        for kind in (LIST, SENTENCE):
            on = self.kinds[self.of] == kind
            page, codes = self.page[self.of][on], self.codes[on]
            classes = (codes & 3) > 0
            page = np.concatenate([page, page[classes], page])
            codes = np.concatenate([codes, (codes[classes] & 3) + np.int64(_generic(0)), np.full(len(codes), _generic(_ANY), dtype=np.int64)])
            first, _ = _runs(codes, page)
            out.append(np.unique(codes[first], return_counts=True))
        return out


_PAGE = "doc_id bigint, host string, f array<double>, tokens array<bigint>, kinds array<tinyint>, word bigint, listed bigint, said bigint"


def _cut_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One pass over the texts: a row a page, and rows of tokens of clear lists and clear sentences with the pages that have them."""
    names = [c.split()[0] for c in _PAGE.split(", ")]
    hashed = _Hashes()

    def lists(sizes: np.ndarray, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values))

    def measured(rows: pa.RecordBatch, cut: list[list[Stretch]]) -> Iterator[pa.RecordBatch]:
        forms, n = Forms(cut, hashed), len(cut)
        sizes = np.bincount(forms.page, weights=forms.n, minlength=n).astype(np.int64)
        features = lists(np.full(n, len(FEATURES)), forms.features.ravel())
        nothing = pa.nulls(n, pa.int64())
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("host"), features, lists(sizes, forms.codes), lists(sizes, forms.kinds[forms.of]), nothing, nothing, nothing], names)
        for k, (codes, pages) in enumerate(forms.tokens_by_kind()):
            n = len(codes)
            none = [pa.nulls(n, t) for t in (pa.int64(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int8()))]
            both = [pa.array(pages), pa.array(np.zeros(n, dtype=np.int64))]
            yield pa.RecordBatch.from_arrays([*none, pa.array(codes), *(both if k == 0 else both[::-1])], names)

    for batch in batches:
        start, held, cut = 0, 0, []
        for at, text in enumerate(batch.column("text")):
            cut.append(stretches(text.as_py()))
            held += sum([len(s.tokens) for s in cut[-1]])
            if held > _HELD or at == batch.num_rows - 1:
                yield from measured(batch.slice(start, at + 1 - start), cut)
                start, held, cut = at + 1, 0, []


def evidence(counts: dict[int, tuple[int, int]], least: int = LEAST):
    """A function over Arrow arrays that gives, of each page, the share of tokens whose surroundings speak for a list, and the share of tokens known.

    ``counts``: pages that have a token in a clear list, and in a clear sentence. A token weighs the log of how
    much likelier lists are to have it than sentences, from -3 to 3, without the page's own stretch; a link or tag that
    too few pages have weighs as links or tags do.
    """
    words = np.array(sorted(counts), dtype=np.int64)
    table = np.array([counts[w] for w in words.tolist()] or [(0, 0)], dtype=np.float64).reshape(-1, 2)
    whole = np.maximum(np.array(counts.get(_generic(_ANY), (0, 0)), dtype=np.float64), 1.0)

    def own_counts(codes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        place = np.searchsorted(words, codes)
        there = (place < len(words)) & (words[np.minimum(place, len(words) - 1)] == codes) if len(words) else np.zeros(len(codes), bool)
        of = np.where(there[:, None], table[np.minimum(place, len(table) - 1)], 0.0)
        of[:, 0] -= kinds == LIST
        of[:, 1] -= kinds == SENTENCE
        return np.maximum(of, 0.0)

    def run(tokens: pa.Array, kinds: pa.Array) -> pa.Array:
        sizes = np.diff(tokens.offsets.to_numpy())
        codes, own = tokens.flatten().to_numpy(), kinds.flatten().to_numpy()
        of = own_counts(codes, own)
        rare = np.flatnonzero((of.sum(axis=1) < least) & (codes & 3 > 0))
        of[rare] = own_counts((codes[rare] & 3) + np.int64(-(1 << 63)), own[rare])
        known = of.sum(axis=1) >= least
        rate = (of + 0.5) / (whole + 1.0)
        weight = np.where(known, np.clip(np.log(rate[:, 0] / rate[:, 1]), -3.0, 3.0), 0.0)

        page = np.repeat(np.arange(len(sizes)), sizes)
        ends = np.cumsum(sizes)
        here = np.arange(len(codes))
        low, high = np.maximum(here - REACH, (ends - sizes)[page]), np.minimum(here + REACH + 1, ends[page])
        upto = np.concatenate([[0.0], np.cumsum(weight)])
        around = upto[high] - upto[low]
        n = np.maximum(sizes, 1)
        share = np.bincount(page, weights=around > 1e-9, minlength=len(sizes)) / n
        return pa.StructArray.from_arrays([pa.array(share), pa.array(np.bincount(page, weights=known, minlength=len(sizes)) / n)], ["share", "known"])

    run.__annotations__ = {"tokens": pa.Array, "kinds": pa.Array, "return": pa.Array}
    return run


def class_weight(pages: int, sample: int) -> float:
    """How many of a label's ``pages`` each of its at most ``sample`` training pages stands for."""
    return max(1.0, pages / sample)


def odds(p: Column) -> Column:
    """Log odds of a share kept between a thousandth and 1 less that."""
    p = F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))
    return F.ln(p / (1 - p))


def spam_scores(docs: DataFrame, host: str, trees: int = 24, seed: int = 11, sample: int = SAMPLE, pull: float = 0.5, prior: float = 20.0) -> DataFrame:
    """``doc_id``, the features, ``score`` of the trees and ``smoothed`` by the host.

    ``docs``: ``doc_id, text`` and the column ``host``. One pass cuts each whole text into stretches, measures its form and counts in
    how many pages each token stands in a clear list and in a clear sentence. A page of which at least KNOWN of the tokens are
    known from other pages is weakly labelled spam if at least LIST_FROM of its tokens stand where these speak for a list, and good at SENTENCES_TO or
    less. Bagged trees are fitted to the features of at most ``sample`` pages of each label, weighted by how many pages
    have the label, so that a score means the same at every size; they score every page, also of languages too rare for labels.

    ``smoothed`` moves the log odds of the score by ``pull`` times how much the log odds of the host's other pages, eased
    by ``prior`` average pages, differ from the corpus'. A NULL host is no host: its pages keep their score.
    Without pages of both labels nothing can be learned, and all scores are 0. NULL and empty texts have no words and score 0.
    Repeated ids are scored alike.
    """
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    spark = docs.sparkSession
    source = spread(docs.select("doc_id", "text", F.col(host).cast("string").alias("host")))
    cut = materialise(source.mapInArrow(_cut_pages, _PAGE), "cut")
    pages = cut.where("word is null").select("doc_id", "host", "f", "tokens", "kinds")
    counted = cut.where("word is not null").groupBy("word").agg(F.sum("listed").alias("listed"), F.sum("said").alias("said"))
    counted = counted.where(F.col("listed") + F.col("said") > LEAST).orderBy(F.desc(F.col("listed") + F.col("said")), "word").limit(VOCABULARY)
    known = {r["word"]: (r["listed"], r["said"]) for r in counted.collect()}

    speak = F.arrow_udf(evidence(known), "struct<share double, known double>")
    judged = pages.where(F.size("tokens") > 0).select("doc_id", "f", speak("tokens", "kinds").alias("e")).where(F.col("e.known") >= KNOWN)
    label = F.when(F.col("e.share") >= LIST_FROM, 1.0).when(F.col("e.share") <= SENTENCES_TO, 0.0)
    weak = materialise(judged.select("doc_id", "f", label.alias("label")).where("label is not null"), "weak")
    sizes = {r["label"]: r["n"] for r in weak.groupBy("label").agg(F.count("*").alias("n")).collect()}
    shown = [F.element_at("f", i + 1).alias(name) for i, name in enumerate(FEATURES)]
    if len(sizes) == 2:
        first = lambda x: weak.where(F.col("label") == x).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(sample).withColumn("weight", F.lit(class_weight(sizes[x], sample)))
        train = materialise(first(1.0).unionByName(first(0.0)).select(array_to_vector("f").alias("__features"), "label", "weight"), "train")
        forest = RandomForestClassifier(featuresCol="__features", weightCol="weight", numTrees=trees, maxDepth=7, minInstancesPerNode=3, featureSubsetStrategy="onethird", bootstrap=True, seed=seed)
        model = forest.fit(train)
        vectors = pages.select("doc_id", "host", "f", array_to_vector("f").alias("__features"))
        score = F.when(F.element_at("f", len(FEATURES)) > 0, vector_to_array("probability")[1]).otherwise(F.lit(0.0))
        scored = model.transform(vectors).select("doc_id", "host", *shown, score.alias("score"))
    else:
        scored = pages.select("doc_id", "host", *shown, F.lit(0.0).alias("score"))
    scored = materialise(scored, "scored")
    mean = scored.agg(F.coalesce(F.avg("score"), F.lit(0.0))).first()[0]
    rates = scored.where("host is not null").groupBy("host").agg(F.sum("score").alias("of_host"), F.count("*").alias("in_host"))
    joined = scored.join(broadcast_if_small(rates, "hosts"), "host", "left")
    rest = (F.col("of_host") - F.col("score") + F.lit(prior * mean)) / (F.col("in_host") - 1 + F.lit(prior))
    shift = F.coalesce(F.lit(pull) * (odds(rest) - odds(F.lit(mean))), F.lit(0.0))
    moved = 1 / (1 + F.exp(-(odds(F.col("score")) + shift)))
    return joined.select("doc_id", *FEATURES, "score", F.when((F.col("score") > 0) & (F.abs(shift) > 0), moved).otherwise(F.col("score")).alias("smoothed"))


def spam_pages(docs: DataFrame, host: str, threshold: float = 0.5, **options) -> DataFrame:
    """``doc_id`` of the pages that trees and host rate together hold for spam."""
    return spam_scores(docs, host, **options).where(F.col("smoothed") >= F.lit(threshold)).select("doc_id").distinct()


def spam_report(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row: pages that the trees alone suspect, and those that the hosts' rates add and remove."""
    alone, both = F.col("score") >= F.lit(threshold), F.col("smoothed") >= F.lit(threshold)
    kinds = {"trees": alone, "added": ~alone & both, "removed": alone & ~both}
    return scores.agg(*(F.count_if(c).alias(name) for name, c in kinds.items()))
