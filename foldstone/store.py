"""A store on a file system: an append-only log, and generations of folded state behind one pointer."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldstone.operators import fold

LOG = "seq bigint, op string, key string, value binary, expires_at bigint, tenant string"


class Store:
    """``root/log/upto-N-...``: what each append brought, N its highest sequence; ``root/gen-N``: the fold of all up to ``high``; ``root/current-N``: the pointer.

    An append is written aside and then renamed, so it is there whole or not at all. A
    generation is complete before its pointer file exists, and pointers are created, never changed: a crash
    at any point leaves the former generation in force. Sequences never start over, also not after the log is trimmed.
    One writer assigns sequences; readers may be many.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._p(f"{self.root}/log"))

    def _names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._p(folder)))

    def append(self, rows: DataFrame) -> None:
        """Append log rows; ``seq`` is the caller's, unique and rising."""
        have, aside = rows.columns, f"{self.root}/aside/{uuid.uuid4().hex}"
        cols = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in LOG.split(", "))]
        rows.select(*cols).write.parquet(aside)
        top = self.spark.read.schema(LOG).parquet(aside).agg(F.max("seq")).first()[0]
        if top is not None:
            self._fs.rename(self._p(aside), self._p(f"{self.root}/log/upto-{top:020d}-{uuid.uuid4().hex[:8]}"))

    def put(self, key: str, value: bytes, now_ms: int = 0, ttl_ms: int | None = None, tenant: str | None = None) -> int:
        """Append one put and give its sequence."""
        return self._one("put", key, value, None if ttl_ms is None else now_ms + ttl_ms, tenant)

    def delete(self, key: str) -> int:
        """Append one delete, whether the key is there or not, and give its sequence."""
        return self._one("delete", key, None, None, None)

    def _one(self, op: str, key: str, value: bytes | None, expires_at: int | None, tenant: str | None) -> int:
        seq = self.next_seq()
        self.append(self.spark.createDataFrame([(seq, op, key, value, expires_at, tenant)], LOG))
        return seq

    def put_record(self, kind: str, name: str, record: dict) -> int:
        """Keep a volume's, a setting's or any other description under ``kind/name``, replacing the former one."""
        return self.put(f"{kind}/{name}", json.dumps(record, sort_keys=True).encode())

    def get_record(self, kind: str, name: str) -> dict | None:
        value = self.get(f"{kind}/{name}")
        return None if value is None else json.loads(value)

    def records(self, kind: str, schema: str) -> DataFrame:
        """``name`` and the fields of ``schema`` of every record of a kind."""
        held = self.state().where(F.startswith("key", F.lit(f"{kind}/")))
        return held.select(F.substring("key", len(kind) + 2, 1 << 30).alias("name"), F.from_json(F.decode("value", "UTF-8"), schema).alias("r")).select("name", "r.*")

    def get(self, key: str, now_ms: int = 0) -> bytes | None:
        """The value of ``key``; None if it is absent, deleted or expired. Generations are sorted and have a Bloom filter on the key."""
        generation, high = self._pointer()
        tail = self.log().where((F.col("key") == F.lit(key)) & (F.col("seq") > F.lit(high)))
        if generation >= 0:
            tail = tail.unionByName(self.spark.read.schema(LOG).parquet(self._path(generation, high)).where(F.col("key") == F.lit(key)))
        row = fold.fold_state(tail).where(fold.live(now_ms)).first()
        return None if row is None else bytes(row["value"] or b"")

    def _pointer(self) -> tuple[int, int]:
        """(generation, high); (-1, -1) before the first."""
        return max(((int(n.split("-")[1]), int(n.split("-")[2])) for n in self._names(self.root) if n.startswith("current-")), default=(-1, -1))

    def log(self) -> DataFrame:
        """What was appended and not trimmed."""
        parts = self._names(f"{self.root}/log")
        return self.spark.read.schema(LOG).parquet(*(f"{self.root}/log/{n}" for n in parts)) if parts else self.spark.createDataFrame([], LOG)

    def state(self) -> DataFrame:
        """The present state: the current generation and the log's tail beyond it."""
        generation, high = self._pointer()
        if generation < 0:
            return fold.fold_state(self.log())
        return fold.restore(self.spark.read.schema(LOG).parquet(self._path(generation, high)), high, self.log())

    def next_seq(self) -> int:
        """One beyond the last: the appends' names and the pointer say it, no row is read."""
        tops = [int(n.split("-")[1]) for n in self._names(f"{self.root}/log")]
        return max([*tops, self._pointer()[1]]) + 1

    def _path(self, generation: int, high: int) -> str:
        found = self._p(f"{self.root}/current-{generation:08d}-{high}")
        stream = self._fs.open(found)
        try:
            name = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return f"{self.root}/{name}"

    def write_generation(self, now_ms: int) -> str:
        """Fold, drop what expired before ``now_ms``, and write; not in force yet."""
        high = self.next_seq() - 1
        name = f"gen-{self._pointer()[0] + 1:08d}-{high}-{uuid.uuid4().hex[:8]}"
        self.state().where(F.col("seq") <= high).where(fold.live(now_ms)).repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.root}/{name}")
        return name

    def swap(self, name: str) -> None:
        """Put a written generation in force by creating its pointer."""
        _, generation, high, _ = name.split("-")
        out = self._fs.create(self._p(f"{self.root}/current-{generation}-{high}"), False)
        out.write(bytearray(name, "utf-8"))
        out.close()

    def compact(self, now_ms: int, trim: bool = True) -> str:
        """A new generation in force, and with ``trim`` the log up to it dropped."""
        name = self.write_generation(now_ms)
        self.swap(name)
        if trim:
            self.trim()
        return name

    def trim(self) -> list[str]:
        """Drop the appends that the current generation holds whole, and the generations and pointers before it; their names. A reader that began before may have to read anew."""
        generation, high = self._pointer()
        if generation < 0:
            return []
        kept = self._path(generation, high).rsplit("/", 1)[1]
        gone = [f"log/{n}" for n in self._names(f"{self.root}/log") if int(n.split("-")[1]) <= high]
        gone += [n for n in self._names(self.root) if (n.startswith("current-") and int(n.split("-")[1]) < generation) or (n.startswith("gen-") and n != kept and int(n.split("-")[1]) <= generation)]
        for n in gone:
            self._fs.delete(self._p(f"{self.root}/{n}"), True)
        return gone
