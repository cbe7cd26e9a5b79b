"""Has this key been seen before? Sealed perfect-hash partitions with fingerprints, then an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.llm.mph import SealedSet
from foldstone.session import materialise, qualified, scratch
from foldstone.sources.formats import located

#: Distinct keys that one sealed partition of one batch holds at most, roughly: this bounds a task's memory.
KEYS_A_PART = 250_000
#: Batches of one call: the exact set of a call has a column for each.
MOST_BATCHES = 64

_JUDGED = "src int, batch int, id bigint, match int, before boolean, part int, payload binary"
_ARROW = pa.schema([("src", pa.int32()), ("batch", pa.int32()), ("id", pa.int64()), ("match", pa.int32()), ("before", pa.bool_()), ("part", pa.int32()), ("payload", pa.binary())])


def _stored(folders: list[str], part: int) -> Iterator[tuple[int, int, SealedSet]]:
    """``src, batch, set`` of what earlier calls sealed in ``part``, read by the task itself."""
    for folder in folders:
        store, path = located(f"{folder}/part={part}")
        if store.get_file_info(path).type == pa.fs.FileType.NotFound:
            continue
        for row in pq.read_table(path, filesystem=store, columns=["src", "batch", "payload"], partitioning=None).to_pylist():
            yield row["src"], row["batch"], SealedSet.from_bytes(row["payload"])


def _judge(bits: int, folders: list[str]):
    """Stream rows sorted by source, part and batch: ask the sealed batches of the part, then seal what is new."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs  # noqa: F401

        part, sealed, held, now = None, [], [], None

        def finish() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            place, check = (rows.column(c).to_numpy().view(np.uint64) for c in ("h2", "h1"))
            match = np.full(len(place), -1, dtype=np.int32)
            for number, earlier in sealed:
                open_ = match < 0
                if open_.any():
                    at = np.flatnonzero(open_)
                    match[at[earlier.contains(place[at], check[at])]] = number
            new = match < 0
            n = len(match)
            columns = [rows.column("src"), rows.column("batch"), rows.column("id"), pa.array(match), rows.column("before"), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
            yield from pa.table(columns, names=_ARROW.names).cast(_ARROW).to_batches()
            if new.any():
                made = SealedSet(place[new], check[new], bits)
                sealed.append((now[2], made))
                yield pa.RecordBatch.from_pylist([{"src": now[0], "batch": now[2], "part": now[1], "payload": made.to_bytes()}], _ARROW)

        for batch in batches:
            if not batch.num_rows:
                continue
            s, p, b = (batch.column(c).to_numpy() for c in ("src", "part", "batch"))
            edges = np.flatnonzero((s[1:] != s[:-1]) | (p[1:] != p[:-1]) | (b[1:] != b[:-1])) + 1
            for lo, hi in zip([0, *edges], [*edges, batch.num_rows], strict=True):
                group = (int(s[lo]), int(p[lo]), int(b[lo]))
                if group != now:
                    if held:
                        yield from finish()
                    if group[:2] != part:
                        part = group[:2]
                        sealed = [(n, known) for src, n, known in _stored(folders, group[1]) if src == group[0]]
                    held, now = [], group
                held.append(batch.slice(lo, hi - lo))
        if held:
            yield from finish()

    return run


@dataclass(frozen=True)
class Seen:
    """``rows`` (src, id): every row whose key had occurred; ``answers``: what each batch's probes said, and what was true."""

    rows: DataFrame
    answers: DataFrame


class KeyMemory:
    """What has been seen, in a shared folder: sealed sets at ``sealed/call=N/part=P``, about 3.3 bytes a key, and, for exact checks alone, the keys at ``keys/call=N``.

    A call judges new records against all earlier calls. It reads the sealed sets of each part once, where the part's new keys are,
    and no earlier key; only yes answers that point into earlier calls look their key up there. With ``keep=False`` no key is kept, and
    such answers stand as the fingerprints gave them, wrong at most once in ``2**bits`` for each earlier batch.
    ``parts`` is fixed when the folder is made; choose it so that a part's sealed sets fit a task.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int, bits: int = 16, keep: bool = True):
        self.spark, self.root, self.bits, self.keep = spark, qualified(spark, root), bits, keep
        p = spark._jvm.org.apache.hadoop.fs.Path
        fs = p(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._names = lambda folder: sorted(x.getPath().getName() for x in (fs.listStatus(p(f"{self.root}/{folder}")) if fs.exists(p(f"{self.root}/{folder}")) else []))
        made = [n for n in self._names("") if n.startswith("parts-")]
        if made:
            self.parts = int(made[0].split("-")[1])
        else:
            self.parts = parts
            fs.mkdirs(p(f"{self.root}/parts-{parts}"))

    def _calls(self) -> list[tuple[int, int]]:
        """(first batch, one beyond the last) of each call that ended."""
        return [(int(n.split("-")[1]), int(n.split("-")[2])) for n in self._names("done")]

    def take(self, records: DataFrame, batches: int = 1) -> Seen:
        """Judge and remember ``records``: ``src, scope, key`` (texts) and ``id`` (bigint, unique within ``src``; the order).

        Ids of a call lie beyond those of earlier calls. Each source's ids are cut into ``batches`` ranges, which arrive one after the other:

        1. the exact set of the call: distinct (scope, key) with the first id in each batch, summed on the map side,
           so a key that holds a third of the rows is one row before the shuffle; the only shuffle of texts;
        2. their hashes alone are spread over parts and read in batch order; a part asks the sealed sets of earlier
           batches (slot by minimal perfect hash, then ``bits`` of fingerprint), and seals what none knew. A task
           holds one batch of one part and sealed sets, never earlier keys;
        3. an exact check of the yes answers alone: an equal key must stand in an earlier batch.

        A row was seen before unless it is the first of its key in its batch and new to all earlier ones; that is
        an anti-join on the unique id, which no hot key can skew.

        ``answers``: ``src, batch, probes, yes, wrong``: a wrong answer is a yes that the exact check refuted; a
        no is never wrong. Rows with a NULL ``key``, ``scope`` or ``id`` are not judged and never returned.
        Repeated rows are judged like any other. An empty input gives no rows. A call that fails leaves nothing behind that counts.
        """
        if not 0 < batches <= MOST_BATCHES:
            raise ValueError(f"1 to {MOST_BATCHES} batches")
        spark, calls = self.spark, self._calls()
        base = max((end for _, end in calls), default=0)
        folders = [f"{self.root}/sealed/call={n}" for n, _ in calls]
        whole = records.where(F.col("key").isNotNull() & F.col("scope").isNotNull() & F.col("id").isNotNull()).select("src", "scope", "key", "id")
        spans = whole.groupBy("src").agg(F.min("id").alias("a"), F.max("id").alias("b")).orderBy("src").collect()  # a row a source
        code = lambda names: F.coalesce(*(F.when(F.col("src") == n, F.lit(i)) for i, n in enumerate(names)), F.lit(-1))
        names = self._sources([r["src"] for r in spans])
        number = F.lit(0)
        for r in spans:
            step = max(1, -(-(r["b"] - r["a"] + 1) // batches))
            number = F.when(F.col("src") == r["src"], F.floor((F.col("id") - F.lit(r["a"])) / F.lit(step)).cast("int")).otherwise(number)
        keyed = whole.select(code(names).alias("src"), "scope", "key", "id", number.alias("batch"))
        firsts = keyed.groupBy("src", "scope", "key").agg(*(F.min(F.when(F.col("batch") == i, F.col("id"))).alias(f"b{i}") for i in range(batches)))
        if self.keep:
            firsts = materialise(firsts, "firsts")
        each = [F.when(F.col(f"b{i}").isNotNull(), F.struct(F.lit(base + i).alias("batch"), F.col(f"b{i}").alias("id"), (F.coalesce(*(F.col(f"b{j}") for j in range(i)), F.lit(None)).isNotNull() if i else F.lit(False)).alias("before"))) for i in range(batches)]
        hashes = [F.xxhash64("scope", "key").alias("h1"), F.xxhash64("key", F.lit("#"), "scope").alias("h2")]
        hashed = firsts.select("src", *hashes, F.inline(F.array_compact(F.array(*each))))
        width = int(spark.conf.get("spark.sql.shuffle.partitions"))
        spread = hashed.withColumn("part", F.pmod("h1", F.lit(self.parts)).cast("int")).repartition(width, "src", "part").sortWithinPartitions("src", "part", "batch")
        judged = materialise(spread.mapInArrow(_judge(self.bits, folders), _JUDGED), "judged")

        answers = judged.where("payload is null").select("src", "batch", "id", "before", (F.col("match") >= 0).alias("yes"), ((F.col("match") >= 0) & (F.col("match") < base) & ~F.col("before")).alias("far"))
        true = F.col("yes") & F.col("before")
        if base and self.keep:
            asked = firsts.select("src", "scope", "key", F.coalesce(*(F.col(f"b{i}") for i in range(batches)), F.lit(None)).alias("id")).join(answers.where("far").select("src", "id"), ["src", "id"], "left_semi")
            held = spark.read.schema("src int, scope string, key string").parquet(*(f"{self.root}/keys/call={n}" for n, _ in calls))
            sure = materialise(asked.join(held, ["src", "scope", "key"], "left_semi").select("src", "id", F.lit(True).alias("sure")), "sure")
            answers = answers.join(sure, ["src", "id"], "left")
            true = F.col("yes") & (F.col("before") | F.coalesce("sure", F.lit(False)))
        elif base:
            true = F.col("yes") & (F.col("before") | F.col("far"))
        answers = answers.withColumn("true", true)
        first = answers.where(~F.col("true")).select("src", "id")
        named = F.array(*(F.lit(n) for n in names))[F.col("src")] if names else F.lit(None).cast("string")
        rows = whole.select(code(names).alias("src"), "id").join(first, ["src", "id"], "left_anti").select(named.alias("src"), "id")
        told = answers.groupBy("src", "batch").agg(F.count("*").alias("probes"), F.count_if("yes").alias("yes"), F.count_if(F.col("yes") & ~F.col("true")).alias("wrong"))
        self._keep(judged, firsts, base, batches)
        return Seen(rows, told.select(named.alias("src"), "batch", "probes", "yes", "wrong"))

    def _sources(self, new: list[str]) -> list[str]:
        """The names of the sources, each at its number, those of this call added."""
        path = f"{self.root}/sources"
        known = [r["name"] for r in self.spark.read.schema("number int, name string").json(path).orderBy("number").collect()] if self._names("sources") else []
        added = [n for n in new if n not in known]
        if added:
            self.spark.createDataFrame([(len(known) + i, n) for i, n in enumerate(added)], "number int, name string").coalesce(1).write.mode("append").json(path)
        return known + added

    def _keep(self, judged: DataFrame, firsts: DataFrame, base: int, batches: int) -> None:
        """Store what was sealed, then the name that makes the call count."""
        judged.where("payload is not null").select("src", "batch", "payload", "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/sealed/call={base}")
        if self.keep:
            firsts.select("src", "scope", "key").write.mode("overwrite").parquet(f"{self.root}/keys/call={base}")
        p = self.spark._jvm.org.apache.hadoop.fs.Path
        p(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration()).mkdirs(p(f"{self.root}/done/call-{base}-{base + batches}"))


def seen_before(records: DataFrame, batches: int = 6, bits: int = 16) -> Seen:
    """``KeyMemory.take`` from an empty memory: each batch of ``records`` against the batches before it."""
    spark = records.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = records.count()
    parts = max(8 * width, -(-n // (KEYS_A_PART * max(1, batches // 2))))
    return KeyMemory(spark, scratch(spark, "memory"), parts, bits, keep=False).take(records, batches)
