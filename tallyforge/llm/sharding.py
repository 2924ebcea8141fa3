"""Size-tiered compaction of document shards, with a versioned manifest.

Arrivals are appended as small immutable shards, one folder of Parquet files
each. Sizes are bytes of files. The tier of a shard is the power of FAN_IN below
the target that its size reaches; when a tier below the target holds FAN_IN
shards, or some that reach the target together, they are merged. A shard stays
as it is once its files hold the target each; one in more files than that, however
large, is written anew in as many as fit.

A merge writes its new shard first; then the next version of the manifest, one
file that names all live shards, is moved to a name that mustn't exist, so of
two writers one fails. Shards that a version names are never changed; the last
KEPT_VERSIONS versions stay readable, and a sweep deletes older manifests and the
shards that only they name. Readers take the highest version, so a lost
executor or driver leaves the last version whole.

The main path consists of DataFrame reads and writes. The small merges of a round
share jobs: a job unites many runs, each read and written by one task without a
shuffle. What was written is counted and its files are listed by Spark, once a
write; the driver sees the manifest, a row for each shard. A merge that holds
other rows than its run is an error, and no version names it.

Defined results: null and empty texts are rows like others; rows are kept as
they are, repeated ones too, with all columns, whatever their names or types; a
very long text is a row of one file; of shards of equal size those of lesser path are
merged first; an empty table gives one empty shard.
"""

from __future__ import annotations

import json
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .blocks import ensure_checkpoint_dir

FAN_IN = 4
TARGET_BYTES = 128 << 20
#: Arrivals that the query deals its table into at least; large tables make more, each of a bounded size.
ARRIVALS = 16
#: Powers of FAN_IN below the target that are tiers of their own.
TIERS = 6
#: Runs that one job merges, and such jobs that run at once.
RUNS_A_JOB, JOBS = 64, 4
#: Versions that stay readable.
KEPT_VERSIONS = 2


@dataclass(frozen=True)
class Shard:
    path: str
    rows: int
    bytes: int
    tier: int
    files: int


def _unused(name: str, taken: list[str]) -> str:
    """`name`, longer by underscores where a column has it already."""
    while name.lower() in {c.lower() for c in taken}:
        name += "_"
    return name


def parent(path: str) -> str:
    return path.rsplit("/", 1)[0]


class ShardStore:
    """A folder of immutable shards and manifests `v00000001.json`, `v00000002.json`, ...; the highest is the state."""

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = FAN_IN, target: int = TARGET_BYTES, kept: int = KEPT_VERSIONS):
        self.spark, self.folder, self.fan_in, self.target, self.kept = spark, folder, fan_in, target, kept
        self._jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)
        self._fs.mkdirs(self._path(f"{folder}/manifest"))
        self._fs.mkdirs(self._path(f"{folder}/shards"))

    def _names(self, sub: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.folder}/{sub}"))]

    def versions(self) -> list[int]:
        return sorted(int(n[1:9]) for n in self._names("manifest") if n.startswith("v"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def live(self, version: int | None = None) -> list[Shard]:
        """The shards that a version names; their number is bounded by the arrivals and by the bytes over the target."""
        version = self.version() if version is None else version
        if not version:
            return []
        schema = "path string, rows long, bytes long, tier int, files int"
        rows = self.spark.read.schema(schema).json(f"{self.folder}/manifest/v{version:08d}.json").orderBy("path").collect()
        return [Shard(r.path, r.rows, r.bytes, r.tier, r.files) for r in rows]

    def commit(self, shards: list[Shard], base: int) -> int:
        """Publish the next version; fails if another writer published it first."""
        staged, final = (self._path(f"{self.folder}/manifest/{n}") for n in (f"_{uuid.uuid4().hex}", f"v{base + 1:08d}.json"))
        out = self._fs.create(staged, False)
        out.write(bytearray("".join(json.dumps(asdict(s)) + "\n" for s in shards).encode()))
        out.close()
        try:  # a move that doesn't overwrite
            self._context.rename(staged, final, self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0))
        except Py4JJavaError as e:
            self._fs.delete(staged, False)
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            raise RuntimeError(f"version {base + 1} was published by another writer") from None
        return base + 1

    def sweep(self) -> None:
        """Delete the manifests before the last `kept` ones, and the shards that only they name."""
        versions = self.versions()
        old, new = versions[: -self.kept], versions[-self.kept :]
        named = {s.path for v in new for s in self.live(v)}
        # Shards are folders, or files in a folder of one job; such a folder goes with its last shard.
        gone = {s.path for v in old for s in self.live(v)} - named
        jobs = {parent(p) for p in gone if parent(p) != f"{self.folder}/shards"} - {parent(p) for p in named}
        for path in [*jobs, *(p for p in gone if parent(p) not in jobs)]:
            self._fs.delete(self._path(path), True)
        for v in old:
            self._fs.delete(self._path(f"{self.folder}/manifest/v{v:08d}.json"), False)

    def _files(self, name: str, schema: StructType) -> DataFrame:
        """(file, rows, bytes) of the files of one write, the file by its path below the folder of shards."""
        below = lambda path: F.regexp_extract(path, "/shards/([^/]+/.*)$", 1).alias("file")
        read = self.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*")
        sizes = read.format("binaryFile").load(name).select(below(F.col("path")), F.col("length").alias("bytes"))
        rows = read.format("parquet").schema(schema).load(name).groupBy(below(F.input_file_name())).agg(F.count(F.lit(1)).alias("rows"))
        return sizes.join(rows, "file", "left").select("file", F.coalesce("rows", F.lit(0)).alias("rows"), "bytes")

    def _folders(self, name: str, schema: StructType) -> list[Shard]:
        """The folders of one write as shards."""
        each = self._files(name, schema).groupBy(F.regexp_replace("file", "/[^/]*$", "").alias("at"))
        each = each.agg(F.sum("rows").alias("rows"), F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("files")).orderBy("at").collect()
        return [Shard(f"{self.folder}/shards/{r['at']}", r["rows"], r["bytes"], self.tier(r["bytes"]), r["files"]) for r in each]

    def tier(self, size: int) -> int:
        """TIERS and more for sizes that reach the target, one less for each power of `fan_in` below it, 0 at least."""
        tier, top = 0, self.target
        while size >= top:
            tier, top = tier + 1, top * self.fan_in
        if tier:
            return TIERS + tier - 1
        tier = TIERS
        while tier and size * self.fan_in ** (TIERS - tier) < self.target:
            tier -= 1
        return tier

    def _fitting(self, size: int) -> int:
        """The files of a shard of that size: each holds the target at least, where the shard does."""
        return max(1, size // self.target)

    def _write(self, df: DataFrame, size: int) -> Shard:
        files = self._fitting(size)
        name = f"{self.folder}/shards/{uuid.uuid4().hex}"
        # One file is written by one task without a shuffle. Several are dealt evenly without a key: no source or length can fill one.
        (df.coalesce(1) if files == 1 else df.repartition(files)).write.parquet(name)
        return self._folders(name, df.schema)[0]

    def append(self, df: DataFrame) -> Shard:
        """One arrival becomes a shard."""
        base = self.version()
        name = f"{self.folder}/shards/{uuid.uuid4().hex}"
        df.write.parquet(name)
        shard = self._folders(name, df.schema)[0]
        self.commit([*self.live(base), shard], base)
        return shard

    def append_many(self, df: DataFrame, arrival: str) -> list[Shard]:
        """Many arrivals at once, told apart by the column `arrival`: one shard each, one write, one version."""
        base = self.version()
        name = f"{self.folder}/shards/{uuid.uuid4().hex}"
        df.write.partitionBy(arrival).parquet(name)
        schema = df.drop(arrival).schema
        shards = self._folders(name, schema) or [self._write(self.spark.createDataFrame([], schema), 0)]
        self.commit([*self.live(base), *shards], base)
        return shards

    def runs(self, shards: list[Shard]) -> list[list[Shard]]:
        """What is to be merged: runs of a tier below the target, and shards in more files than fit."""
        tiers: dict[int, list[Shard]] = {}
        for s in shards:
            if s.bytes < self.target:
                tiers.setdefault(s.tier, []).append(s)
        out = []
        for _, members in sorted(tiers.items()):
            run: list[Shard] = []
            for s in sorted(members, key=lambda s: (s.bytes, s.path)):
                run.append(s)
                if len(run) == self.fan_in or sum(x.bytes for x in run) >= self.target:  # below twice the target: one file
                    out.append(run)
                    run = []
        gone = {s for run in out for s in run}
        return out + [[s] for s in shards if s not in gone and s.files > self._fitting(s.bytes)]

    def _merge(self, job: list[list[Shard]], schema: StructType) -> list[Shard]:
        """One new shard for each run of a job."""
        parts = [self.spark.read.schema(schema).parquet(*[s.path for s in run]) for run in job]
        if len(parts) == 1:
            out = [self._write(parts[0], sum(s.bytes for s in job[0]))]
        else:
            name = f"{self.folder}/shards/{uuid.uuid4().hex}"
            # A union of single partitions alone would be one partition; with an empty range, which has none, each keeps its task.
            none = self.spark.range(0).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
            reduce(DataFrame.union, [*(part.coalesce(1) for part in parts), none]).write.parquet(name)
            # The number of a file is that of its task, thus of its run.
            number = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).cast("int")
            files = self._files(name, schema).orderBy(number).collect()  # one row a run
            out = [Shard(f"{self.folder}/shards/{r.file}", r.rows, r.bytes, self.tier(r.bytes), 1) for r in files]
        if [s.rows for s in out] != [sum(s.rows for s in run) for run in job]:
            raise RuntimeError(f"a merge wrote {[s.rows for s in out]} rows of {[sum(s.rows for s in run) for run in job]}")
        return out

    def compact(self, schema: StructType) -> int:
        """Merge until nothing is left to be merged; returns the version reached."""
        version = self.version()

        while True:
            shards = self.live(version)
            runs = self.runs(shards)
            if not runs:
                return version
            # Runs of several files deserve a job of their own; so do empty ones, as an empty task leaves a file only if it is the first.
            alone = [run for run in runs if self._fitting(sum(s.bytes for s in run)) > 1 or not sum(s.rows for s in run)]
            small = [run for run in runs if run not in alone]
            jobs = [[run] for run in alone] + [small[k : k + RUNS_A_JOB] for k in range(0, len(small), RUNS_A_JOB)]
            merge = inheritable_thread_target(self.spark)(lambda job: self._merge(job, schema))
            with ThreadPoolExecutor(JOBS) as pool:
                merged = [s for shards in pool.map(merge, jobs) for s in shards]
            gone = {s for run in runs for s in run}
            version = self.commit([s for s in shards if s not in gone] + merged, version)
            self.sweep()

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version's shards, the last one's by default."""
        return self.spark.read.schema(schema).parquet(*[s.path for s in self.live(version)])


def compact_documents(docs: DataFrame, arrivals: int = ARRIVALS, fan_in: int = FAN_IN, target: int = TARGET_BYTES, folder: str | None = None) -> DataFrame:
    """Append the documents as `arrivals` shards or more, compact them, and read the live version back.

    Each task of the input deals its rows into as many arrivals as keep one below about the target divided by
    `fan_in`, so their number grows with the table, each is one file, and nothing is shuffled.

    Returns (doc_id, n_bytes, text_sha256) of every row as the final shards hold it, with the rows that the manifest
    counts and whether it is settled: no shard is left to be merged, and every file of a shard beyond the target holds it.
    """
    spark = docs.sparkSession
    folder = folder or f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    store = ShardStore(spark, folder, fan_in, target, kept=1)  # nobody else reads this folder
    parts = max(1, docs.rdd.getNumPartitions())
    size = docs.agg(F.coalesce(F.sum(F.octet_length(F.col("text").cast("string"))), F.lit(0)).alias("b")).first().b
    each = max(-(-arrivals // parts), -(-size * 4 * fan_in // (5 * target * parts)))
    dealt = F.spark_partition_id() * F.lit(each) + F.pmod(F.monotonically_increasing_id(), F.lit(each))
    arrival = _unused("_arrival", docs.columns)
    store.append_many(docs.withColumn(arrival, dealt.cast("int")), arrival)
    store.compact(docs.schema)
    live = store.live()
    settled = not store.runs(live) and all(s.bytes >= s.files * store.target for s in live if s.bytes >= store.target)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return store.read(docs.schema).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("text_sha256"),
        F.lit(sum(s.rows for s in live)).cast("long").alias("manifest_rows"), F.lit(settled).alias("settled"),
    )


ORACLE = "SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, sha256(coalesce(text, '')) AS text_sha256, CAST(count(*) OVER () AS BIGINT) AS manifest_rows, true AS settled FROM documents"
