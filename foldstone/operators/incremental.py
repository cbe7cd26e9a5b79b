"""Processing only what is new: work ranges with pending, leased and done states."""

from __future__ import annotations

import json
from dataclasses import dataclass
from hashlib import sha256

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldstone.session import broadcast_if_small, materialise

#: A scope's marks are cut into at least about this many pieces, so that one hot scope is spread over many tasks.
PIECES = 16


def _blocks(low: Column, high: Column, levels: int) -> Column:
    """The dyadic blocks that make up the integers [low, high]: at most two a level."""

    def level(n: Column) -> Column:
        first = F.call_function("negative", F.call_function("shiftright", F.call_function("negative", low), n))
        end = F.call_function("shiftright", high + F.lit(1), n)
        odd = lambda x: F.pmod(x, F.lit(2)) == 1
        open_ = first < end
        return F.array(F.when(open_ & odd(first), F.struct(n.alias("level"), first.alias("block"))), F.when(open_ & odd(end), F.struct(n.alias("level"), (end - 1).alias("block"))))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), level)))


def done_ranges(runs: DataFrame) -> DataFrame:
    """The ledger that past runs leave: disjoint ranges ``(low, high]`` of a scope with ``done_at``.

    ``runs``: ``scope, low`` (exclusive, NULL: from the beginning), ``high`` (inclusive), ``started_at``,
    ``status``. Only succeeded runs count (failed and aborted ones, also those that never finished, return
    their range to pending); where several span a range, the latest start stands, as it has seen the most.
    A run without ``high`` or ``started_at`` handled nothing that could be named. NULL ``low`` stays NULL.

    Overlaps are resolved without pairing runs: a run is spread over the dyadic blocks of its interval, each
    elementary range looks up the blocks above it, and the latest start wins.
    """
    ok = runs.where((F.lower(F.trim("status")) == "succeeded") & F.col("high").isNotNull() & F.col("started_at").isNotNull() & (F.col("low").isNull() | (F.col("low") < F.col("high"))))
    ok = ok.select(F.coalesce("scope", F.lit("")).alias("scope"), "low", "high", "started_at")
    bounds = ok.agg(F.min(F.least(F.coalesce("low", "high"), "high")).alias("a"), F.max("high").alias("b")).first()
    least = (bounds["a"] if bounds and bounds["a"] is not None else 0) - 1
    most = bounds["b"] if bounds and bounds["b"] is not None else 0
    levels = max(1, (most - least + 1).bit_length())
    based = ok.select("scope", (F.coalesce("low", F.lit(least)) - F.lit(least)).alias("low"), (F.col("high") - F.lit(least)).alias("high"), "started_at")
    cover = (
        based.select("scope", "started_at", F.explode(_blocks(F.col("low") + 1, F.col("high"), levels)).alias("x"))
        .groupBy("scope", F.col("x.level").alias("level"), F.col("x.block").alias("block"))
        .agg(F.max("started_at").alias("started_at"))
    )
    edges = based.select("scope", F.col("low").alias("edge")).unionByName(based.select("scope", F.col("high").alias("edge"))).distinct()
    # the edge before: within a stretch of the axis, or the greatest of the stretches before, so that a hot scope is no single window
    cut = edges.withColumn("cut", F.call_function("shiftright", F.col("edge"), F.lit(max(0, levels - 8))))
    ends = cut.groupBy("scope", "cut").agg(F.max("edge").alias("end"))
    carried = ends.select("scope", "cut", F.lag("end").over(Window.partitionBy("scope").orderBy("cut")).alias("carried"))  # at most 512 a scope
    near = F.lag("edge").over(Window.partitionBy("scope", "cut").orderBy("edge"))
    ranges = cut.withColumn("near", near).join(carried, ["scope", "cut"]).select("scope", F.coalesce("near", "carried").alias("low"), "edge").where("low is not null")
    looked = ranges.select("scope", "low", F.col("edge").alias("high"), F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(levels)), lambda n: F.call_function("shiftright", F.col("edge"), n))).alias("level", "block"))
    done = looked.join(cover, ["scope", "level", "block"]).groupBy("scope", "low", "high").agg(F.max("started_at").alias("done_at"))
    return materialise(done.select("scope", F.when(F.col("low") > 0, F.col("low") + F.lit(least)).alias("low"), (F.col("high") + F.lit(least)).alias("high"), "done_at"), "done")


def pending_marks(feed: DataFrame, ledger: DataFrame) -> DataFrame:
    """The distinct (``scope``, ``mark``) of ``feed`` that no done range has handled.

    ``feed``: ``scope, mark`` (bigint), ``arrived_at``, ``run_scope`` (the scope under which runs record
    it). A mark is handled if the range that spans it was done by a run which started at or after the
    arrival of one of its deliveries. Rows without ``scope`` or ``mark`` cannot be recorded and are left out; without ``arrived_at``
    a delivery is never known to have been there, so it stays pending. Empty tables: no feed, no rows; no ledger, every mark.

    Deliveries are reduced to distinct marks before the shuffle; ranges are cut into pieces, so the lookup
    is an equi-join on (scope, piece), and the ledger is broadcast only if its written size allows it.
    """
    marks = feed.where(F.col("scope").isNotNull() & F.col("mark").isNotNull()).groupBy("run_scope", "scope", "mark").agg(F.min("arrived_at").alias("arrived_at"))
    span = ledger.agg(F.min(F.coalesce("low", "high")).alias("a"), F.max("high").alias("b"), F.count("*").alias("n"), F.approx_count_distinct("scope").alias("scopes")).first()
    floor, top = (span["a"], span["b"]) if span and span["b"] is not None else (0, 0)
    pieces = max(PIECES, 2 * span["n"] // max(1, span["scopes"]))  # as many as ranges a scope: so many copies a range, and so many ranges a piece, on average
    shift = max(0, (top - floor).bit_length() - (pieces - 1).bit_length())
    piece = lambda c: F.call_function("shiftright", F.greatest(c, F.lit(floor)), F.lit(shift))
    cut = ledger.select(F.col("scope").alias("__scope"), "low", "high", "done_at", F.explode(F.sequence(piece(F.coalesce("low", F.lit(floor))), piece(F.col("high")))).alias("__piece"))
    cut = broadcast_if_small(cut, "ledger")
    spans = (F.col("run_scope") == F.col("__scope")) & (piece(F.col("mark")) == F.col("__piece")) & (F.col("mark") <= F.col("high")) & (F.col("low").isNull() | (F.col("mark") > F.col("low")))
    joined = marks.join(cut, spans, "left")
    return joined.where(F.col("done_at").isNull() | F.col("arrived_at").isNull() | (F.col("done_at") < F.col("arrived_at"))).select("scope", "mark")


def run_transitions(runs: DataFrame) -> DataFrame:
    """What recorded runs did to their items, as the ledger's transitions: each run is one item, its range.

    ``runs``: ``item`` (unique), ``started_at``, ``finished_at``, ``status``. A run adds its item, leases it at its start with token 1,
    and makes it done if it succeeded; else it gives the item back, or, if it has no such end, its lease is over at its start.
    """
    at, end = (F.unix_millis(F.col(c).cast("timestamp")) for c in ("started_at", "finished_at"))
    word = F.lower(F.trim("status"))
    kind = F.when(word == "succeeded", "done").when(word.isin("failed", "aborted"), "released")
    step = lambda token, kind, at_ms, until_ms: F.struct(F.lit(token).cast("bigint").alias("token"), kind.alias("kind"), at_ms.alias("at_ms"), until_ms.cast("bigint").alias("until_ms"))
    steps = F.array(step(0, F.lit("pending"), at, F.lit(None)), step(1, F.lit("leased"), at, at), step(1, kind, F.coalesce(end, at), F.lit(None)))
    return runs.select("item", F.inline(steps)).where("kind is not null")


def _digest(item: str) -> str:
    return sha256(item.encode()).hexdigest()


@dataclass(frozen=True)
class Lease:
    """The right to process one item until ``until_ms``; ``token`` fences every earlier holder."""

    item: str
    token: int
    until_ms: int
    path: str


class Ledger:
    """Work items and their transitions in a shared folder: pending, leased, done.

    A transition is a small file ``steps/<digest of the item>/token.kind``, created only if absent, so of two workers that race for one the file
    system lets one win. Their fold is the state. A file that a crash left empty says nothing, but its token is used up.
    Leases that ran out return to pending; a writer whose token is no longer the latest is refused; the output path
    depends on item and token alone, so a retried write overwrites what its earlier attempt left, and what is done is never written again.
    Many transitions of the past are ``record``-ed as one table beside. Items may have any name.
    """

    _schema = "item string, token bigint, kind string, until_ms bigint"

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("steps", "record", "output"):
            self._fs.mkdirs(self._path(f"{self.root}/{part}"))

    def _steps(self, item: str):
        return self._path(f"{self.root}/steps/{_digest(item)}")

    def _append(self, item: str, token: int, kind: str, at_ms: int, until_ms: int | None, worker: str) -> bool:
        """False if that transition is there already. Any other failure is an error, not a lost race."""
        try:
            out = self._fs.create(self._path(self._steps(item), f"{token:09d}.{kind}"), False)
        except Py4JJavaError as e:
            if e.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
                return False
            raise
        try:
            out.write(bytearray(json.dumps({"item": item, "at_ms": at_ms, "until_ms": until_ms, "worker": worker}), "utf-8"))
        finally:
            out.close()
        return True

    def transitions(self) -> DataFrame:
        """``item, token, kind, until_ms``: those recorded and those of the steps, each once."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/steps")
        name = lambda i: F.regexp_extract("path", r"([0-9]+)\.([a-z]+)$", i)
        said = F.from_json(F.decode("content", "UTF-8"), "item string, until_ms bigint")
        steps = files.select(said.alias("said"), name(1).cast("bigint").alias("token"), name(2).alias("kind")).where("said.item is not null")
        steps = steps.select("said.item", "token", "kind", "said.until_ms")
        return steps.unionByName(self.spark.read.schema(self._schema).parquet(f"{self.root}/record"))

    def add(self, items: list[str], at_ms: int) -> None:
        """Register items once; an item that is already there stays as it is."""
        for item in items:
            self._append(item, 0, "pending", at_ms, None, "")

    def record(self, transitions: DataFrame) -> None:
        """Append many transitions of the past at once, as ``run_transitions`` gives them."""
        transitions.select("item", "token", "kind", "until_ms").write.mode("append").parquet(f"{self.root}/record")

    def states(self, now_ms: int) -> DataFrame:
        """``item, token, state`` at ``now_ms``: pending, leased or done."""
        rank = F.when(F.col("kind") == "done", 2).when(F.col("kind") == "released", 1).otherwise(0)
        last = self.transitions().groupBy("item").agg(F.max(F.struct("token", rank.alias("rank"), "kind", "until_ms")).alias("x"))
        state = F.when(F.col("x.kind") == "done", "done").when((F.col("x.kind") == "leased") & (F.col("x.until_ms") > F.lit(now_ms)), "leased").otherwise("pending")
        return last.select("item", F.col("x.token").alias("token"), state.alias("state"))

    def lease(self, now_ms: int, ttl_ms: int, worker: str, limit: int = 1) -> list[Lease]:
        """Take up to ``limit`` pending items."""
        won = []
        for row in self.states(now_ms).where("state = 'pending'").orderBy("item").limit(limit).toLocalIterator():
            token = row["token"] + 1
            while self._torn(row["item"], token):  # whoever still writes it is fenced by the greater token
                token += 1
            if self._append(row["item"], token, "leased", now_ms, now_ms + ttl_ms, worker):
                won.append(Lease(row["item"], token, now_ms + ttl_ms, self._output(row["item"], token)))
        return won

    def _torn(self, item: str, token: int) -> bool:
        path = self._path(self._steps(item), f"{token:09d}.leased")
        return self._fs.exists(path) and self._fs.getFileStatus(path).getLen() == 0

    def _own(self, item: str) -> set[tuple[int, str]]:
        """(token, kind) of one item's steps: a listing of its folder, no job over all files."""
        names = [s.getPath().getName() for s in self._fs.listStatus(self._steps(item))]
        return {(int(n.split(".")[0]), n.split(".")[1]) for n in names if n[:1].isdigit()}

    def _open(self, lease: Lease) -> bool:
        """The lease's token is the item's latest, and neither done nor given back."""
        own = self._own(lease.item)
        return max(t for t, _ in own) == lease.token and not {(lease.token, "done"), (lease.token, "released")} & own

    def commit(self, lease: Lease, df: DataFrame, now_ms: int) -> bool:
        """Write the item's output under its token's path, then record done: that one file makes it visible.

        False, and nothing written, if the token is stale, given back or done already: what it published stays. False after
        the write if a later token came meanwhile: it outranks this one when the states are folded, so a stale writer's files are never
        read. A lease that ran out but that nobody took over may still commit.
        """
        if not self._open(lease):
            return False
        df.write.mode("overwrite").parquet(lease.path)
        return self._open(lease) and self._append(lease.item, lease.token, "done", now_ms, None, "") and max(t for t, _ in self._own(lease.item)) == lease.token

    def published(self, schema, now_ms: int) -> DataFrame:
        """The rows of all that is done, with ``item`` and ``token``; partitions of other tokens are pruned, no list of paths is made."""
        fields = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        whole = T.StructType([*fields.fields, T.StructField("ledger_of", T.StringType()), T.StructField("token", T.LongType())])
        done = self.states(now_ms).where("state = 'done'").select(F.sha2("item", 256).alias("ledger_of"), "item", "token")
        return self.spark.read.schema(whole).parquet(f"{self.root}/output").join(done, ["ledger_of", "token"]).select(*fields.names, "item", "token")

    def _output(self, item: str, token: int) -> str:
        return f"{self.root}/output/ledger_of={_digest(item)}/token={token}"

    def release(self, lease: Lease, now_ms: int) -> bool:
        """Give an item back before its lease ends."""
        return self._open(lease) and self._append(lease.item, lease.token, "released", now_ms, None, "")
