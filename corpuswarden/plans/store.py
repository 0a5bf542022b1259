"""Facts kept from scan to scan: only files that changed are read again.

The store remembers which version of which file was scanned, (repo, rel, digest), and
the facts its text left. An update gets a listing of all files with their digests, finds
by an anti-join what it has not scanned yet, and asks for those texts alone. What a
changed or deleted file left before stays stored and drops out by a semi-join with the
listing; a version that comes back finds its facts again.

Every update is a generation of its own and is there once its listing is written. An
update that broke off is made again under the same number. `compact` leaves only what
the last listing needs. Facts depend on the probes, so another set of them is another
store beside the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from corpuswarden.plans import audit
from corpuswarden.plans.facts import FileColumns, extract
from corpuswarden.schema import FACTS
from corpuswarden.session import BROADCAST_ROWS, fine_scans, settings, write_once

VERSION = ["repo", "rel", "digest"]
Load = Callable[[DataFrame], DataFrame]

_TEXT = [T.StructField(name, T.StringType()) for name in VERSION]
LISTING = T.StructType([*_TEXT, T.StructField("gen", T.IntegerType())])
STORED = T.StructType([*FACTS.fields, T.StructField("digest", T.StringType()),
                       T.StructField("gen", T.IntegerType())])


def digests(files: DataFrame) -> DataFrame:
    """(repo, rel, digest) of files whose texts are at hand; a listing that knows them is cheaper."""
    return files.select("repo", "rel", F.sha2("text", 256).alias("digest"))


class FactStore:
    """Facts of the probes below `path`."""

    def __init__(self, spark: SparkSession, path: str, probes=None):
        probes = audit.all_probes() if probes is None else probes
        columns = FileColumns()
        told = "\n".join([*(probe(columns) for probe in probes), *columns.made()])
        self.spark, self.probes = spark, probes
        self.path = f"{path}/probes={hashlib.sha256(told.encode()).hexdigest()[:16]}"

    def generations(self) -> list[int]:
        """Numbers of the updates that are whole."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/listing/gen=*/_SUCCESS")
        system = place.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = system.globStatus(place) or []
        return sorted(int(status.getPath().getParent().getName().removeprefix("gen=")) for status in found)

    def _read(self, table: str, schema: T.StructType, gens: list[int]) -> DataFrame:
        if not gens:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(
            *[f"{self.path}/{table}/gen={gen}" for gen in gens])

    def changed(self, listing: DataFrame) -> DataFrame:
        """The rows of a listing whose version was never scanned."""
        scanned = self._read("scanned", LISTING, self.generations()).select(VERSION)
        return listing.select(VERSION).join(scanned, VERSION, "left_anti")

    def update(self, listing: DataFrame, load: Load) -> int:
        """Scan what changed; `load` gives the (repo, rel, text) of the (repo, rel) it is asked for.

        Files that `load` has no text for count as scanned and leave no facts.
        """
        gens = self.generations()
        gen = gens[-1] + 1 if gens else 0
        listing = write_once(listing.select(VERSION).distinct())
        self.changed(listing).write.mode("overwrite").parquet(f"{self.path}/scanned/gen={gen}")
        wanted = self.spark.read.schema(T.StructType(_TEXT)).parquet(f"{self.path}/scanned/gen={gen}")
        known = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
        facts = extract(load(wanted.select("repo", "rel")), *self.probes).join(known, ["repo", "rel"])
        with settings(self.spark, fine_scans(self.spark)):
            facts.hint("rebalance", "kind").write.mode("overwrite").partitionBy("kind").parquet(
                f"{self.path}/facts/gen={gen}")
        listing.write.mode("overwrite").parquet(f"{self.path}/listing/gen={gen}")
        return gen

    def listing(self) -> DataFrame:
        """(repo, rel, digest) of the last update."""
        return self._read("listing", LISTING, self.generations()[-1:]).select(VERSION)

    def stale(self) -> DataFrame:
        """Versions that were scanned and are not in the last listing: few, unless much has changed."""
        scanned = self._read("scanned", LISTING, self.generations()).select(VERSION)
        return scanned.join(self.listing(), VERSION, "left_anti")

    def facts(self) -> DataFrame:
        """The facts of the files in the last listing; they stay where they lie."""
        return self._held(write_once(self.stale()))[0]

    def _held(self, stale: DataFrame) -> tuple[DataFrame, bool]:
        """The facts that count, and whether they are read in place.

        Every version with facts was scanned, so all count but those of stale versions.
        """
        few = stale.count() <= BROADCAST_ROWS
        stored = self._read("facts", STORED, self.generations()).where("digest is not null")
        return stored.join(F.broadcast(stale) if few else stale.hint("merge"), VERSION, "left_anti").select(
            FACTS.names), few

    def findings(self, paths: DataFrame, load: Load, **tables: DataFrame) -> DataFrame:
        """The whole audit of the last listing; `tables` are those of `audit.findings_all`.

        `paths` is every (repo, rel), ignored files included. `load` is asked once more, for
        the texts of the blocks that repeat most. The checks read the stored facts, which lie
        by kind already; only if too many versions are stale are those that count written anew.
        """
        named = audit.path_facts(paths)
        facts, in_place = self._held(write_once(self.stale()))
        if in_place:
            facts = facts.unionByName(write_once(named, partition_by="kind"))
        else:
            facts = write_once(facts.unionByName(named), partition_by="kind")
        return audit.findings_all(load, paths, facts=facts, **tables)

    def compact(self) -> None:
        """Keep only the last listing and its facts, as one generation."""
        gens = self.generations()
        if len(gens) < 2:
            return
        gen = gens[-1] + 1
        listing = self.listing()
        held = self._read("facts", STORED, gens).drop("gen").join(listing, VERSION, "left_semi")
        listing.write.mode("overwrite").parquet(f"{self.path}/scanned/gen={gen}")
        held.hint("rebalance", "kind").write.mode("overwrite").partitionBy("kind").parquet(
            f"{self.path}/facts/gen={gen}")
        listing.write.mode("overwrite").parquet(f"{self.path}/listing/gen={gen}")
        # The new generation holds all that counts; a listing goes first, so that none is half there.
        for table in ("listing", "facts", "scanned"):
            for old in gens:
                place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/gen={old}")
                place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
