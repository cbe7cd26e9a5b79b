"""Evaluation texts inside training text: a positional inverted index, searched from the rarest terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldstone.llm.words import words
from foldstone.session import broadcast_if_small, materialise, spread

#: Distinct terms of all test items for which the vocabulary goes to the tasks; beyond, every word is indexed.
MOST_TERMS = 500_000
#: Positions that a task holds before it hands them on.
FLUSH = 500_000
#: Of the rarest words of a near match, so many must stand about their places before the other words' lists are read.
SUPPORT = 3


def postings(docs: DataFrame, vocabulary: frozenset[str] | None = None) -> DataFrame:
    """The positional index ``term, doc_id, positions``, of the words in ``vocabulary`` or of all words.

    ``docs``: ``doc_id`` bigint, ``text``; the whole text is read. The index is split by document, as search
    engines do: each task writes the lists of its own documents, sorted by term, so building it shuffles
    nothing and a term that stands in every document is spread like the documents.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary) if vocabulary is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value if shared is not None else None
        terms, ids, places, held = [], [], [], 0

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.array(places, pa.list_(pa.int32()))], ["term", "doc_id", "positions"])

        for batch in batches:
            for doc, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                at: dict[str, list[int]] = {}
                for n, w in enumerate(words(text.as_py())):
                    if wanted is None or w in wanted:
                        at.setdefault(w, []).append(n)
                        held += 1
                terms += at
                ids += [doc.as_py()] * len(at)
                places += at.values()
                if held > FLUSH:
                    yield listed()
                    terms, ids, places, held = [], [], [], 0
        yield listed()

    whole = spread(docs.select("doc_id", "text").where("doc_id is not null and text is not null"))
    return whole.mapInArrow(run, "term string, doc_id bigint, positions array<int>").sortWithinPartitions("term")


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id, off, term``: the words of the test items in order."""

    @F.pandas_udf("array<string>")
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(words)

    return items.where("item_id is not null").select("item_id", F.posexplode(split("text")).alias("off", "term"))


def anchors(terms: DataFrame, index: DataFrame, window: int, strong: int, support: int = 0) -> DataFrame:
    """``item_id, off, term, strong``: the ``strong + support`` rarest terms of every window of ``window`` words of an item.

    Rarity is the number of corpus documents with the term, over all documents. ``strong`` are those among the first
    ``strong`` of some window: of a match that lacks fewer words than that, at least one stands there.
    """
    counts = index.groupBy("term").agg(F.count("*").alias("df"))
    counted = terms.join(broadcast_if_small(counts.join(terms.select("term").distinct(), "term", "left_semi"), "frequencies"), "term", "left")
    here = F.struct(F.coalesce("df", F.lit(0)).alias("df"), "off", "term")
    # an item's own words: a test text, never the corpus
    ahead = Window.partitionBy("item_id").orderBy("off").rowsBetween(0, window - 1)
    windows = counted.withColumn("__in", F.sort_array(F.collect_list(here).over(ahead))).where(F.size("__in") == window)
    rare = windows.select("item_id", F.posexplode(F.slice("__in", 1, strong + support)).alias("rank", "x"))
    return rare.groupBy("item_id", F.col("x.off").alias("off"), F.col("x.term").alias("term")).agg(F.max(F.col("rank") < strong).alias("strong"))


def _dense(support: int, slack: int):
    """Of rows ``doc_id, item_id, shift, off, strong``, sorted by document and item: each pair with its strong places about which ``support`` rows stand within ``slack``.

    A task holds one batch and the pair that reaches over its end.
    """

    def pairs(rows: pa.Table) -> pa.RecordBatch:
        doc, item, shift, off, strong = (rows.column(c).to_numpy() for c in ("doc_id", "item_id", "shift", "off", "strong"))
        group = np.concatenate([[0], np.cumsum((doc[1:] != doc[:-1]) | (item[1:] != item[:-1]))])
        order = np.lexsort((~strong, off, shift, group))
        doc, item, shift, off, strong, group = (x[order] for x in (doc, item, shift, off, strong, group))
        # one number for group and shift, groups far enough apart that no shift reaches from one into another
        apart = int(shift.max() - shift.min()) + 2 * slack + 1
        line = group * apart + (shift - shift.min())
        fresh = np.concatenate([[True], (line[1:] != line[:-1]) | (off[1:] != off[:-1])])  # repeated rows count once
        upto = np.concatenate([[0], np.cumsum(fresh)])
        about = upto[np.searchsorted(line, line + slack, side="right")] - upto[np.searchsorted(line, line - slack, side="left")]
        kept = np.flatnonzero(fresh & strong & (about >= support))
        first = np.flatnonzero(np.concatenate([[True], group[kept][1:] != group[kept][:-1]])) if len(kept) else kept
        ends = pa.array(np.append(first, len(kept)).astype(np.int32))
        places = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(shift[kept]), pa.array(off[kept])], ["shift", "anchor"]))
        return pa.RecordBatch.from_arrays([pa.array(doc[kept][first]), pa.array(item[kept][first]), places], ["doc_id", "item_id", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, item = (batch.column(c).to_numpy() for c in ("doc_id", "item_id"))
            last = int(np.argmax((doc == doc[-1]) & (item == item[-1])))  # where the batch's last pair begins
            goes_on = last == 0 and held and (held[-1].column("doc_id")[-1].as_py(), held[-1].column("item_id")[-1].as_py()) == (int(doc[0]), int(item[0]))
            if not goes_on and (held or last):
                yield pairs(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            held.append(batch.slice(last))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def longest_run(hit: np.ndarray) -> np.ndarray:
    """The longest run of hits in each row."""
    run = best = np.zeros(len(hit), dtype=np.int32)
    for column in hit.T:
        run = (run + 1) * column
        best = np.maximum(best, run)
    return best


def fullest(hit: np.ndarray, window: int) -> np.ndarray:
    """The most hits in any ``window`` neighbouring places of each row."""
    upto = np.concatenate([np.zeros((len(hit), 1), dtype=np.int32), np.cumsum(hit, axis=1, dtype=np.int32)], axis=1)
    return (upto[:, window:] - upto[:, :-window]).max(axis=1) if hit.shape[1] > window else upto[:, -1]


def _offsets(array: pa.Array) -> np.ndarray:
    """Where each list begins and ends in the flattened array."""
    at = array.offsets.to_numpy().astype(np.int64)
    return at - at[0]


def _verify(reach: int, slack: int, window: int | None):
    """An Arrow function: of a document's postings, an item's words and the places (shift, anchor) where they may meet, the words that do.

    The lists are laid out by position, and the item's words within ``reach`` of the anchor are compared with what stands at their offset-adjusted
    places, up to ``slack`` beside, for all places of many pairs at once. With ``window``, the most words in one; without, the longest run: a
    run that fills the reach is followed to its ends.
    """
    wide = 2 * reach + 1

    def run(lists: pa.Array, words: pa.Array, places: pa.Array) -> pa.Array:
        out = np.zeros(len(lists), dtype=np.int32)
        inner = lists.flatten()
        of_list = _offsets(inner.field("positions"))
        positions = inner.field("positions").flatten().to_numpy()
        terms = np.repeat(inner.field("t").to_numpy(), np.diff(of_list))
        of_doc = of_list[_offsets(lists)]
        said, of_item = words.flatten().to_numpy(), _offsets(words)
        met, of_pair = places.flatten(), _offsets(places)
        shift, anchor = met.field("shift").to_numpy().astype(np.int64), met.field("anchor").to_numpy().astype(np.int64)
        sizes = np.array([positions[a:b].max(initial=-1) + 1 for a, b in zip(of_doc, of_doc[1:], strict=False)], dtype=np.int64)
        room_to = np.concatenate([[0], np.cumsum(sizes + np.diff(of_pair) * wide)])
        start = 0
        while start < len(out):  # so many pairs as fit the room of one layout
            stop = max(start + 1, int(np.searchsorted(room_to, room_to[start] + FLUSH, side="right")) - 1)
            base = np.concatenate([[0], np.cumsum(sizes[start:stop])])
            room = np.zeros(base[-1] + 1, dtype=np.int64)
            which = np.repeat(np.arange(stop - start), np.diff(of_doc[start : stop + 1]))
            inside = slice(of_doc[start], of_doc[stop])
            room[base[which] + positions[inside]] = terms[inside]
            for lo in range(of_pair[start], of_pair[stop], max(1, FLUSH // wide)):
                hi = min(of_pair[stop], lo + max(1, FLUSH // wide))
                pair = np.searchsorted(of_pair, np.arange(lo, hi), side="right") - 1
                off = anchor[lo:hi, None] + np.arange(-reach, reach + 1)
                known = (off >= 0) & (off < (of_item[pair + 1] - of_item[pair])[:, None])
                word = said[np.where(known, of_item[pair][:, None] + off, 0)]
                hit = np.zeros(off.shape, dtype=bool)
                for drift in range(-slack, slack + 1):
                    pos = shift[lo:hi, None] + off + drift
                    there = known & (pos >= 0) & (pos < sizes[pair][:, None])
                    hit |= there & (room[np.where(there, base[pair - start][:, None] + pos, -1)] == word)
                if window is not None:
                    np.maximum.at(out, pair, fullest(hit, window))
                    continue
                runs = longest_run(hit)
                np.maximum.at(out, pair, runs)
                long = np.flatnonzero(runs > reach)
                for p, sh in {*zip(pair[long].tolist(), shift[lo:hi][long].tolist(), strict=True)}:
                    text, item = room[base[p - start] : base[p - start + 1]], said[of_item[p] : of_item[p + 1]]
                    first, last = max(0, -sh), min(len(item), len(text) - sh)
                    out[p] = max(out[p], longest_run((text[first + sh : last + sh] == item[first:last])[None, :])[0])
            start = stop
        return pa.array(out)

    run.__annotations__ = {"lists": pa.Array, "words": pa.Array, "places": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "int")


class Leaks:
    """The index of ``docs`` for the words of ``items``, written once, and the searches over it.

    ``docs``: ``doc_id, text``; ``items``: ``item_id, text``. Items without words and documents without text
    match nothing; a repeated document is found as often as it occurs under different ids. Other columns are
    ignored.
    """

    def __init__(self, docs: DataFrame, items: DataFrame):
        texts = materialise(items.where("item_id is not null and text is not null").select("item_id", "text", F.xxhash64("item_id", "text").alias("unit")).distinct(), "texts")
        self.units = texts.select("unit", "item_id")  # an id with several texts is searched for each
        self.terms = materialise(item_terms(texts.select(F.col("unit").alias("item_id"), "text")), "items")
        distinct = self.terms.select("term").distinct().limit(MOST_TERMS + 1).collect()
        vocabulary = frozenset(r["term"] for r in distinct) if len(distinct) <= MOST_TERMS else None
        self.index = materialise(postings(docs, vocabulary), "postings")

    def _met(self, window: int, strong: int, support: int = 0) -> DataFrame:
        """``doc_id, item_id, off, strong, shift``: where the postings of anchors put an item in a document."""
        start = broadcast_if_small(anchors(self.terms, self.index, window, strong, support), "anchors")
        met = self.index.join(start, "term").select("doc_id", "item_id", "off", "strong", F.explode("positions").alias("pos"))
        return met.select("doc_id", "item_id", "off", "strong", (F.col("pos") - F.col("off")).alias("shift"))

    def _verified(self, pairs: DataFrame, name: str, reach: int, slack: int, window: int | None, least: int) -> DataFrame:
        """``doc_id, item_id, words`` of ``pairs`` (``doc_id, item_id, places``): both lists are fetched once and intersected in one place.

        A document's postings are one row, as its text was; so are an item's words.
        """
        pairs = materialise(pairs, name).where(F.size("places") > 0)
        ids = broadcast_if_small(pairs.select("doc_id").distinct(), "documents")
        lists = self.index.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct(F.xxhash64("term").alias("t"), "positions")).alias("lists"))
        items = self.terms.groupBy("item_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("off", F.xxhash64("term").alias("t")))), lambda x: x["t"]).alias("words"))
        both = pairs.join(broadcast_if_small(items, "items"), "item_id").join(lists, "doc_id")
        found = both.select("doc_id", "item_id", _verify(reach, slack, window)("lists", "words", "places").alias("words")).where(F.col("words") >= least)
        named = found.withColumnRenamed("item_id", "unit").join(broadcast_if_small(self.units, "units"), "unit")
        return named.groupBy("doc_id", "item_id").agg(F.max("words").alias("words"))

    def exact(self, least: int = 12) -> DataFrame:
        """``doc_id, item_id, words``: documents with ``least`` or more consecutive words of an item; ``words`` is the longest such run.

        Postings of the rarest term of every window give (document, item, shift); there, the lists of the
        other terms around are intersected at the same shift, and the longest run of matching offsets is measured.
        Rare terms keep the candidates near the true matches however large the corpus; only their
        documents' lists are read for the intersection. Terms are compared by 64-bit hashes: a false run would need ``least`` collisions in a row.
        """
        place = F.struct("shift", F.col("off").alias("anchor"))
        pairs = self._met(least, 1).groupBy("doc_id", "item_id").agg(F.collect_set(place).alias("places"))
        return self._verified(pairs, "candidates", least - 1, 0, None, least)

    def near(self, least: int = 12, window: int = 16, slack: int = 2) -> DataFrame:
        """``doc_id, item_id, words``: documents with ``least`` of ``window`` consecutive words of an item, in
        order up to ``slack`` words added or dropped; ``words`` is the greatest number found in a window.

        As up to ``window - least`` words may be missing, one of each window's ``window - least + 1`` rarest terms
        starts the search. Of these and the SUPPORT - 1 next rarest, SUPPORT must stand within ``slack`` of its shift, else the document's lists are
        not read: a match cannot lack more of them than the rest of the window.
        """
        support = min(SUPPORT, least)
        met = self._met(window, window - least + 1, support - 1).select("doc_id", "item_id", "shift", "off", "strong")
        width = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        pairs = met.repartition(width, "doc_id", "item_id").sortWithinPartitions("doc_id", "item_id").mapInArrow(_dense(support, slack), "doc_id bigint, item_id bigint, places array<struct<shift int, anchor int>>")
        return self._verified(pairs, "near-candidates", window - 1, slack, window, least)
