"""Objects of a store that arrive in parts: listed, merged and deleted in two phases, with a manifest that makes a rerun safe.

Parts lie at <root>/parts/upload=<name>/part=<number>/<file>, or, where they are many and small, packed as the rows of Parquet files below
<root>/packs (`pack`): a file for each part costs the store, and the driver that commits, lists and deletes it, far more than a row. A run

1. lists the parts that no committed version has consumed, and takes the uploads whose parts are all there;
2. writes their merged contents and the list of the parts that went into them, to folders of the next version;
3. commits: the version's manifest is written last, and counts once its success mark is there;
4. deletes the folders of uploads, and the packs, that committed versions have consumed.

If a run breaks off before its commit, what it wrote is ignored and written anew by the next one; if it breaks off after it, the next
run deletes what is left and merges nothing twice. Contents pass through tasks only; the driver sees one row for each version and,
to delete it, the path of each consumed upload's folder, or of each consumed pack, that is still there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED = "path string, upload string, part int, length long"
PACKED = "upload string, part int, length long, content binary"


class PartStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    # ---- the store's files ----

    def _file_system(self, path: str):
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, path: str) -> bool:
        target, store = self._file_system(path)
        return store.exists(target)

    def _delete(self, path: str) -> None:
        target, store = self._file_system(path)
        store.delete(target, True)

    def versions(self) -> list[int]:
        """The committed versions."""
        target, store = self._file_system(f"{self.root}/manifest")
        if not store.exists(target):
            return []
        names = [s.getPath().getName() for s in store.listStatus(target)]
        return sorted(int(n.removeprefix("v=")) for n in names if n.startswith("v=") and self._exists(f"{self.root}/manifest/{n}/_SUCCESS"))

    def _versions_of(self, folder: str, schema: str) -> DataFrame:
        paths = [f"{self.root}/{folder}/v={v}" for v in self.versions()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    # ---- what is there ----

    def pack(self, parts: DataFrame) -> None:
        """Adds parts (upload, part, content binary), those of an upload in one file."""
        rows = parts.select("upload", F.col("part").cast("int").alias("part"), F.coalesce(F.length("content"), F.lit(0)).cast("long").alias("length"), F.coalesce("content", F.lit(b"")).alias("content"))
        rows.repartition("upload").write.mode("append").parquet(f"{self.root}/packs")

    def _packs(self) -> DataFrame:
        """(path, upload, part, length, content): a packed part's path is its file's, with its name behind it."""
        if not self._exists(f"{self.root}/packs"):
            return self.spark.createDataFrame([], f"path string, {PACKED}")
        path = F.concat(F.lit(f"{self.root}/packs/"), F.col("_metadata.file_name"), F.lit("#"), "upload", F.lit("/"), F.col("part").cast("string"))
        return self.spark.read.schema(PACKED).parquet(f"{self.root}/packs").select(path.alias("path"), "upload", "part", "length", "content")

    def _files(self) -> DataFrame | None:
        if not self._exists(f"{self.root}/parts"):
            return None
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{self.root}/parts")

    def listed(self) -> DataFrame:
        """(path, upload, part, length) of all parts that are there, of files those that hold something; contents are not read."""
        packed, files = self._packs().select("path", "upload", "part", "length"), self._files()
        if files is None:
            return packed
        found = files.select("path", F.regexp_extract("path", "/upload=([^/]+)/part=([0-9]+)/[^/]+$", 1).alias("upload"), F.regexp_extract("path", "/upload=([^/]+)/part=([0-9]+)/[^/]+$", 2).alias("part"), "length")
        return found.where("upload <> '' AND length > 0").withColumn("part", F.col("part").cast("int")).union(packed)

    def consumed(self) -> DataFrame:
        return self._versions_of("consumed", LISTED)

    def merged(self) -> DataFrame:
        """(upload, content binary, parts) of all committed versions."""
        return self._versions_of("merged", "upload string, content binary, parts int")

    # ---- the phases ----

    def complete(self) -> DataFrame:
        """The parts of uploads that can be merged now: numbered from 1 without a gap, none of them consumed before."""
        new = self.listed().join(self.consumed().select("path"), "path", "left_anti")
        whole = new.groupBy("upload").agg(F.max("part").alias("last"), F.count_distinct("part").alias("n"), F.min("part").alias("first")).where("first = 1 AND last = n")
        return new.join(whole.select("upload"), "upload", "left_semi").select("path", "upload", "part", "length")

    def write(self, version: int) -> None:
        """Writes what the version consists of; nothing of it counts before its commit."""
        self.complete().write.mode("overwrite").parquet(f"{self.root}/consumed/v={version}")
        taken = self.spark.read.parquet(f"{self.root}/consumed/v={version}")
        contents, files = self._packs().select("path", "content"), self._files()
        if files is not None:
            contents = contents.union(files.select("path", "content"))
        parts = taken.join(contents, "path").groupBy("upload").agg(F.array_sort(F.collect_list(F.struct("part", "path", "content"))).alias("p"))

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                made = [[x["content"] for x in p] for p in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([b"".join(m) for m in made], pa.binary()), pa.array([len(m) for m in made], pa.int32())], names=["upload", "content", "parts"])

        parts.mapInArrow(join, "upload string, content binary, parts int").write.mode("overwrite").parquet(f"{self.root}/merged/v={version}")

    def commit(self, version: int) -> None:
        told = self.spark.read.parquet(f"{self.root}/consumed/v={version}").agg(F.count_distinct("upload").alias("uploads"), F.count("*").alias("parts"), F.sum("length").alias("bytes"))
        told.coalesce(1).write.mode("overwrite").json(f"{self.root}/manifest/v={version}")

    def clean(self) -> int:
        """Deletes the folders of uploads, and the packs, whose every part is consumed; returns how many were there."""
        if not self._exists(f"{self.root}/parts") and not self._exists(f"{self.root}/packs"):
            return 0
        pack = F.regexp_extract("path", r"^(.*/packs/[^/#]*[.]parquet)#", 1)
        folder = F.when(pack != "", pack).otherwise(F.regexp_replace("path", "/part=[^/]*/[^/]*$", ""))
        left = self.listed().join(self.consumed().select("path", F.lit(True).alias("gone")), "path", "left")
        done = left.groupBy(folder.alias("folder")).agg(F.bool_and(F.coalesce("gone", F.lit(False))).alias("done")).where("done")
        n = 0
        for row in done.toLocalIterator():
            self._delete(row["folder"])
            n += 1
        return n

    def run(self) -> DataFrame:
        """One run: cleans what an earlier one has left, merges what is complete, commits, cleans. Returns what is merged by now."""
        self.clean()
        version = max(self.versions(), default=0) + 1
        self.write(version)
        self.commit(version)
        self.clean()
        return self.merged()
