"""The page cache as a bucketed table: look-ups that don't move it, merges that touch what they change.

The table is Parquet, clustered by ``canonical_url`` into a fixed number of
buckets and sorted within them, and partitioned by generation.  A merge adds a
generation that has files for the buckets of its pages only.  A generation
counts once its commit file is there, which is written last: a merge that is
killed is invisible, and the same one again replaces it.

Where a bucket has pages in ``levels`` generations, the merge that adds another
rewrites that bucket, and no other, into the generation it commits; then the
older files of the bucket go.  Rows of one page in several generations are
settled by the newest ``fetched_at``, so a kill between these steps leaves
double rows at most, which no reader sees.

Look-ups of many requests are a join by bucket: only the requests are
exchanged.  Those of few (``POINTS``) name their pages in the scan, which reads
the buckets and row groups that may have them.

Edge cases: pages without an address are left out; a table without generations
has no rows; one writer at a time is assumed, as the reference's lock enforces.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cache

#: Requests that are looked up by name; beyond them the requests are joined.
POINTS = 200


class CacheTable:
    """A cache in a folder; ``schema`` has ``canonical_url`` and ``fetched_at`` and is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, schema: str, name: str = "page_cache", buckets: int = 64, levels: int = 4) -> None:
        self.spark, self.path, self.name, self.buckets, self.levels = spark, path.rstrip("/"), name, buckets, levels
        self.columns = [f.name for f in spark.createDataFrame([], schema).schema]
        fs, folder = self._fs(f"{self.path}/pages")
        fs.mkdirs(folder)
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # external: the files stay
        spark.sql(
            f"CREATE TABLE {name} ({schema}, generation INT) USING parquet OPTIONS ('parquet.bloom.filter.enabled#canonical_url' = 'true') "
            f"PARTITIONED BY (generation) CLUSTERED BY (canonical_url) SORTED BY (canonical_url) INTO {buckets} BUCKETS LOCATION '{self.path}/pages'"
        )
        spark.catalog.recoverPartitions(name)

    def _fs(self, path: str) -> tuple:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def generations(self) -> list[int]:
        """Numbers of the committed generations, in order."""
        fs, folder = self._fs(f"{self.path}/commits")
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def files(self, generation: int) -> dict[int, list[str]]:
        """The files of each bucket that a generation has."""
        fs, folder = self._fs(f"{self.path}/pages/generation={generation}")
        out: dict[int, list[str]] = {}
        for s in fs.listStatus(folder) if fs.exists(folder) else []:
            m = re.search(r"_(\d{5})\.c\d+\.", s.getPath().getName())
            if m:
                out.setdefault(int(m[1]), []).append(s.getPath().toString())
        return out

    def rows(self, upto: int | None = None) -> DataFrame:
        """The rows of all committed generations, some pages in more than one."""
        known = [g for g in self.generations() if upto is None or g <= upto]
        return self.spark.table(self.name).where(F.col("generation").isin(known)).select(*self.columns)

    def pages(self) -> DataFrame:
        """The newest row of each page; an aggregate within buckets."""
        return cache.latest(self.rows())

    def bucket(self, url: Column) -> Column:
        """The bucket of an address, as Spark's writer deals it."""
        return F.pmod(F.hash(url), F.lit(self.buckets))

    def merge(self, pages: DataFrame, number: int | None = None) -> int:
        """Add pages as one generation; its number, which a retry may name again."""
        known = self.generations()
        number = number if number is not None else max(known, default=-1) + 1
        known = [g for g in known if g < number]
        new = cache.latest(pages.where("canonical_url IS NOT NULL").select(*self.columns))
        # the buckets of the batch, and those of them that are deep enough to rewrite
        touched = [r[0] for r in new.select(self.bucket(F.col("canonical_url"))).distinct().collect()]  # at most ``buckets`` numbers
        held = {g: self.files(g) for g in known}
        deep = [b for b in touched if sum(b in held[g] for g in known) >= self.levels]
        if deep:
            old = self.rows(number - 1).where(self.bucket(F.col("canonical_url")).isin(deep))
            new = cache.latest(new.unionByName(old))
        out = new.repartition(self.buckets, "canonical_url").withColumn("generation", F.lit(number))
        before = self.spark.conf.get("spark.sql.sources.partitionOverwriteMode")
        self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        try:
            out.write.mode("overwrite").insertInto(self.name)
        finally:
            self.spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
        self.commit(number)
        for g in known:
            for b in deep:
                for f in held[g].get(b, []):
                    fs, p = self._fs(f)
                    fs.delete(p, False)
        self.spark.catalog.refreshTable(self.name)
        return number

    def commit(self, number: int) -> None:
        """Make a generation visible: one file, created last."""
        fs, p = self._fs(f"{self.path}/commits/{number}")
        fs.create(p, True).close()

    def writer(self, batch: DataFrame, number: int) -> None:
        """For ``foreachBatch``: a batch that runs again replaces its own generation."""
        if number not in self.generations():
            self.merge(batch, number)

    def looked_up(self, requests: DataFrame, now: Column, ttl: int = cache.TTL, stale: int = cache.STALE, failed: str | None = None) -> DataFrame:
        """``cache.looked_up`` of requests (``canonical_url`` and others)."""
        few = [r[0] for r in requests.select("canonical_url").distinct().limit(POINTS + 1).collect()]
        rows = self.rows()
        if len(few) <= POINTS:
            rows = rows.where(F.col("canonical_url").isin([u for u in few if u is not None]))
        else:
            rows = rows.hint("merge")
        return cache.looked_up(requests, cache.latest(rows), now, ttl, stale, failed)
