"""Sharding by size-tiered compaction.

A store is a folder of immutable shard folders and versioned manifests. An
arrival is written as small shards; runs of similarly sized shards (a tier holds
sizes within a factor of FANOUT) are merged into files of about the target size;
each change is one new manifest version, committed by renaming a finished file
to its final name, which fails if another writer took the version. Readers see
the shards of one version only. Shards that no kept version names can be
collected.

Defined results: null and empty texts are rows like others and repeated rows are
all kept; columns of any name pass through; an empty arrival adds no shard, and
an empty store has a version without shards.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = 64 << 20
FANOUT = 4


@dataclass(frozen=True)
class Shard:
    path: str  # below the store, without the file's suffix
    rows: int
    size: int

    def tier(self, target: int, fanout: int) -> int:
        """0 for sizes from target / fanout on, one more for each factor of fanout below."""
        tier, edge = 0, target // fanout
        while self.size < edge and tier < 12:
            tier, edge = tier + 1, edge // fanout
        return tier


class Store:
    def __init__(self, spark: SparkSession, path: str, target: int = TARGET, fanout: int = FANOUT, codec: str = "zstd"):
        self.spark, self.path, self.target, self.fanout, self.codec = spark, path.rstrip("/"), target, fanout, codec
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.path}/{p}")
        self.fs = self._path("x").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests -------------------------------------------------------------
    def versions(self) -> list[int]:
        folder = self._path("manifest")
        if not self.fs.exists(folder):
            return []
        names = (s.getPath().getName() for s in self.fs.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> list[Shard]:
        known = self.versions()
        if version is None and not known:
            return []
        stream = self.fs.open(self._path(f"manifest/{known[-1] if version is None else version:012d}.json"))
        try:
            raw = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [Shard(**x) for x in json.loads(raw)["shards"]]

    def commit(self, shards: list[Shard], base: int) -> int:
        """Publish the version after base; fails if there is one already."""
        version = base + 1
        final, draft = self._path(f"manifest/{version:012d}.json"), self._path(f"manifest/.draft-{uuid.uuid4().hex}")
        stream = self.fs.create(draft, False)
        stream.write(bytearray(json.dumps({"version": version, "shards": [asdict(s) for s in shards]}).encode()))
        stream.close()
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {version} was committed by another writer")
        return version

    # data --------------------------------------------------------------------
    def _written(self, folder: str) -> list[Shard]:
        """The shards of a finished folder, from their files' footers."""
        if not any(s.getPath().getName().startswith("part-") for s in self.fs.listStatus(self._path(folder))):
            return []
        read = self.spark.read.parquet(f"{self.path}/{folder}")
        rows = read.select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size")).groupBy("file", "size").count()
        return [Shard(f"{folder}/{r['file']}", r["count"], r["size"]) for r in rows.orderBy("file").toLocalIterator()]

    def append(self, rows: DataFrame) -> int:
        """Add an arrival as it is partitioned, one immutable shard a partition."""
        base = (self.versions() or [0])[-1]
        folder = f"data/{uuid.uuid4().hex}"
        rows.write.option("compression", self.codec).parquet(f"{self.path}/{folder}")
        return self.commit([*self.manifest(), *self._written(folder)], base)

    def plan(self, shards: list[Shard]) -> list[list[Shard]]:
        """Groups to merge: fanout or more shards of one tier, filled up to the target size each."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.size < self.target // 2:
                tiers.setdefault(s.tier(self.target, self.fanout), []).append(s)
        groups = []
        for _, own in sorted(tiers.items()):
            if len(own) < self.fanout:
                continue
            group, held = [], 0
            for s in sorted(own, key=lambda s: s.path):
                if group and held + s.size > self.target:
                    groups.append(group)
                    group, held = [], 0
                group.append(s)
                held += s.size
            groups.append(group)
        return [g for g in groups if len(g) > 1]

    def compact(self) -> int:
        """Merge tier by tier until no tier has enough shards; each round is one commit."""
        while True:
            base = (self.versions() or [0])[-1]
            shards = self.manifest()
            groups = self.plan(shards)
            if not groups:
                return base
            merged = {s.path: k for k, g in enumerate(groups) for s in g}
            folder = f"data/{uuid.uuid4().hex}"
            # One row a merged shard; the plan is metadata, as long as the list of files.
            names = F.create_map(*(F.lit(x) for p, k in merged.items() for x in (p.rsplit("/", 1)[1], k)))
            read = self.spark.read.parquet(*(f"{self.path}/{p}" for p in merged))
            group = F.element_at(names, F.col("_metadata.file_name"))
            columns = read.columns
            dealt = read.select(F.struct(*columns).alias("row"), group.alias("group"))
            dealt = dealt.repartitionById(len(groups), F.col("group")).select("row.*")
            dealt.write.option("compression", self.codec).parquet(f"{self.path}/{folder}")
            self.commit([*(s for s in shards if s.path not in merged), *self._written(folder)], base)
            self.collect(keep=1)

    def collect(self, keep: int = 1) -> None:
        """Delete the files that none of the last versions names, and older manifests."""
        known = self.versions()
        live = {s.path for v in known[-keep:] for s in self.manifest(v)}
        folders = {p.rsplit("/", 1)[0] for p in live}
        for status in self.fs.listStatus(self._path("data")):
            folder = f"data/{status.getPath().getName()}"
            if folder not in folders:
                self.fs.delete(self._path(folder), True)
        for v in known[:-keep]:
            self.fs.delete(self._path(f"manifest/{v:012d}.json"), False)

    def figures(self, version: int | None = None) -> list[Column]:
        """Columns for rows read from a version: their shard's tier, rows and bytes."""
        shards = self.manifest(version)
        if not shards:
            return [F.lit(None).cast(t).alias(n) for n, t in (("tier", "int"), ("shard_rows", "int"), ("shard_bytes", "int"))]
        pick = lambda f: F.create_map(*(F.lit(x) for s in shards for x in (s.path.rsplit("/", 1)[1], f(s))))
        file = F.col("_metadata.file_name")
        return [
            F.try_element_at(pick(lambda s: s.tier(self.target, self.fanout)), file).alias("tier"),
            F.try_element_at(pick(lambda s: s.rows), file).alias("shard_rows"),
            F.try_element_at(pick(lambda s: s.size), file).alias("shard_bytes"),
        ]

    def read(self, version: int | None = None, schema=None) -> DataFrame:
        """The rows of a version; an empty one needs a schema."""
        shards = self.manifest(version)
        if not shards:
            return self.spark.createDataFrame([], schema or "doc_id long")
        return self.spark.read.parquet(*(f"{self.path}/{s.path}" for s in shards))
