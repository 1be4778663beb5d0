"""Stored keys of an ingest target: a table bucketed by key hash and partitioned by chunk.

A micro-batch asks which of its keys are stored already.  The answer joins the batch, dealt by the same hash, with the
buckets of the chunks it spans: the stored side is neither shuffled nor broadcast, and chunks outside the batch's time span
are not listed in the plan.

Bucket count and chunk width belong to the key table and are fixed when it is made (``_keys_made`` beside it), whatever
widths the data of the target are stored in, so batches of several widths see each other's keys.

Every batch adds one file per bucket and chunk it touches.  A chunk with more than ``MAX_DELTAS`` batches of files
is rewritten into one, so the files to list do not grow with the number of micro-batches.  The rewrite adds the
new files before it deletes the old ones; a stop in between leaves keys twice, which changes no answer.
Each key carries its batch, and a replayed batch does not see its own keys.
"""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.sources.storage import _fs, chunk_of, with_chunk

MAX_DELTAS = 8
CHUNK = "7 days"


class KeyTable:
    """The keys of one target, under ``<target>/_keys`` (a folder that readers of the target skip)."""

    def __init__(self, spark: SparkSession, target: str, keys=("tag_id", "timestamp"), types: dict | None = None,
                 buckets: int | None = None, chunk: str = CHUNK):
        self.spark, self.keys, self.ts = spark, list(keys), keys[1]
        self.path = os.path.join(target, "_keys")
        self.name = "ferrule_keys_" + hashlib.sha256(self.path.encode()).hexdigest()[:16]
        self.buckets, self.chunk = self._settled(buckets or int(spark.conf.get("spark.sql.shuffle.partitions")), chunk)
        columns = ", ".join(f"`{k}` {(types or {}).get(k, 'timestamp_ntz' if k == self.ts else 'int')}" for k in self.keys)
        by = ", ".join(f"`{k}`" for k in self.keys)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, batch bigint, key_chunk bigint) USING parquet "
                  f"PARTITIONED BY (key_chunk) CLUSTERED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'")
        spark.catalog.refreshTable(self.name)  # another session may have written

    def _settled(self, buckets: int, chunk: str) -> tuple[int, str]:
        """Bucket count and chunk width as recorded when the table was made."""
        mark = f"{self.path}_made"
        fs, hpath, _ = _fs(self.spark, mark)
        if not fs.exists(hpath):
            self.spark.createDataFrame([(buckets, chunk)], "buckets int, chunk string").coalesce(1).write.mode("overwrite").json(mark)
        row = self.spark.read.schema("buckets int, chunk string").json(mark).first()
        return row["buckets"], row["chunk"]

    def _dealt(self, rows: DataFrame) -> DataFrame:
        return rows.repartition(self.buckets, *self.keys)

    def stored(self, lo, hi, batch_id: int) -> DataFrame:
        """Keys of other batches in the chunks that ``[lo, hi]`` spans."""
        span = F.col("key_chunk").between(chunk_of(lo, self.chunk), chunk_of(hi, self.chunk))
        return self.spark.table(self.name).where(span & (F.col("batch") != batch_id)).select(*self.keys)

    def known(self, rows: DataFrame, lo, hi, batch_id: int) -> DataFrame:
        """The keys of ``rows`` that another batch has stored."""
        # the merge hint keeps the stored side from being broadcast; its buckets are read as they lie
        return self._dealt(rows.select(*self.keys)).join(self.stored(lo, hi, batch_id).hint("merge"), self.keys, "left_semi")

    def add(self, rows: DataFrame, batch_id: int) -> None:
        """Store the keys of ``rows`` under a batch, and rewrite chunks with many files."""
        keyed = with_chunk(rows.select(*self.keys), self.chunk, self.ts).withColumnRenamed("chunk", "key_chunk")
        out = keyed.select(*self.keys, F.lit(batch_id).cast("bigint").alias("batch"), "key_chunk")
        self._dealt(out).write.insertInto(self.name)
        self._compact()

    def _files(self) -> dict[str, list]:
        """Files of every chunk folder."""
        fs, root, jvm = _fs(self.spark, self.path)
        out: dict[str, list] = {}
        for item in fs.globStatus(jvm.org.apache.hadoop.fs.Path(root, "key_chunk=*/*.parquet")) or []:
            out.setdefault(item.getPath().getParent().getName(), []).append(item.getPath())
        return out

    def _compact(self) -> None:
        found = self._files()
        full = [c for c, files in found.items() if _deltas(files) > MAX_DELTAS]
        if not full:
            return
        fs, _, _ = _fs(self.spark, self.path)
        chunks = [int(c.split("=", 1)[1]) for c in full]
        self.spark.catalog.refreshTable(self.name)
        old = self.spark.table(self.name).where(F.col("key_chunk").isin(chunks))
        self._dealt(old.groupBy(*self.keys, "key_chunk").agg(F.min("batch").alias("batch")).select(
            *self.keys, "batch", "key_chunk")).write.insertInto(self.name)
        for chunk in full:
            for path in found[chunk]:
                fs.delete(path, False)
        self.spark.catalog.refreshTable(self.name)


def _deltas(files) -> int:
    """Writes that left files in a folder (a bucketed file's name holds its write's id)."""
    return len({f.getName().split("-", 2)[2].split("_")[0] for f in files})

