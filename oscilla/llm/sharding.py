"""Sharding by size-tiered compaction, with DataFrame operations only.

A store is a folder of immutable Parquet shards and of manifests. ``append`` writes arrivals as small
shards; ``compact`` merges ``fan_in`` or more shards of one size tier into files of about the target
size; each commits a manifest of the next version, and the highest version is the store. A manifest's
rows are a Parquet table, written first; the commit is one small file that names it, made in full under a
draft's name and given its final name by an operation that fails where the name is taken. So of any
number of writers of one version exactly one succeeds, and readers see the old or the new state, never a
half-written one. An append that lost a race commits its shards to the version after; a merge that did
does so only if the shards it merged are all still live, and else gives up. Files of a failed or lost attempt
are in no manifest and so in no shard.

A shard's size is the UTF-8 bytes of its texts plus 16 a row, so the layout follows from the data
alone. An arrival's rows go to its small shards by a hash of their id, so no source or group is hot;
merges move whole shards. Every task writes files of about the target size in all, however large the
store; plans and numbers come from running sums over ranges of the manifest, which is never collected: the
driver holds one sum for ``RANGE_SHARDS`` shards, the names of live batches, one for each append or merge, and
Spark's own list of files. Files are numbered within their batch; the names of shards, which begin with those of
their arrivals, stand in manifests alone, so that they may have any length and characters.

Edge cases: null texts count 16 bytes; null ids hash as '' and null names of arrivals are ''; repeated
rows stay repeated; an empty arrival has no shards but commits a version; a text larger than a target
file has a larger file. A store refuses documents with columns of the names in ``OWN``, or with a column whose type has changed; columns that an arrival lacks are null. ``sharded`` takes any
columns: its own ones get further underscores in front where their names are taken.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import new_path, removed, written

MANIFEST = "shard string, file long, tier int, size long, n long, batch string, of long"
ROW_BYTES = 16
#: Tables of shards or arrivals up to so many bytes are broadcast; larger ones are joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of a row of such a table, without names.
SLIM_BYTES = 128
#: Shards in a range of the manifest on average.
RANGE_SHARDS = 100_000


#: Columns that a store adds to documents while it writes or reads them.
OWN = {"_shard", "_batch", "_task"}


class Conflict(RuntimeError):
    """Another writer has committed what this one was to commit."""


def _small(rows: DataFrame, size: int) -> DataFrame:
    return F.broadcast(rows) if size <= BROADCAST_BYTES else rows


def _ahead(rows: DataFrame, name: str, weight: Column) -> DataFrame:
    """``rows``, one for each ``name``, with ``_ahead``: the weights of those before, in the order of a digest; written.

    Each range of rows sums up on its own, and the driver adds up one sum a range.
    """
    spark = rows.sparkSession
    ranges = 1 + rows.count() // RANGE_SHARDS
    mark = F.sha2(F.col(name), 256)
    dealt = rows.withColumn("_mark", mark).withColumn("_weight", weight.cast("long")).repartitionByRange(ranges, "_mark").withColumn("_range", F.spark_partition_id())
    dealt = written(dealt, "ranges")
    total, firsts = 0, []
    for at, size in sorted((r._range, r.size) for r in dealt.groupBy("_range").agg(F.sum("_weight").alias("size")).collect()):
        firsts.append((at, total))
        total += size
    first = spark.createDataFrame(firsts, "_range int, _first long")
    inside = F.sum("_weight").over(Window.partitionBy("_range").orderBy("_mark", name).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = dealt.withColumn("_inside", inside - F.col("_weight")).join(F.broadcast(first), "_range")
    return written(out.withColumn("_ahead", F.col("_first") + F.col("_inside")).drop("_first", "_inside", "_range", "_weight"), "numbered")


class ShardStore:
    """A versioned store of shards under ``root``."""

    def __init__(self, spark: SparkSession, root: str, *, id_col: str = "doc_id", text: str = "text", small: int = 2 << 20, target: int = 64 << 20, fan_in: int = 4) -> None:
        self.spark, self.root, self.id_col, self.text = spark, root.rstrip("/"), id_col, text
        self.small, self.target, self.fan_in = small, target, fan_in

    # --- manifests

    def _fs(self):
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        return hadoop.Path, hadoop.Path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The highest committed version; 0 where there is none yet."""
        path, fs = self._fs()
        folder = path(f"{self.root}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        return max([int(x) for x in names if x.isdigit()], default=0)

    def _pointer(self, version: int) -> dict:
        path, fs = self._fs()
        stream = fs.open(path(f"{self.root}/manifests/{version:010d}"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def manifest(self, version: int | None = None) -> DataFrame:
        """(shard, file, tier, size, n, batch, of) of a version, by default of the last one; ``file`` is a shard's number in its batch, which has ``of`` shards."""
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], MANIFEST)
        return self.spark.read.schema(MANIFEST).parquet(f"{self.root}/states/{self._pointer(version)['state']}")

    def schema(self, version: int | None = None) -> T.StructType:
        """The columns of the documents of a version."""
        version = self.version() if version is None else version
        return T.StructType.fromJson(json.loads(self._pointer(version)["schema"])) if version else T.StructType([])

    def _named(self, draft: str, final: str) -> bool:
        """Give a finished file its final name unless that is taken; whether it was free."""
        path, fs = self._fs()
        jvm, hadoop = self.spark._jvm, self.spark._jvm.org.apache.hadoop.fs
        try:
            if fs.getScheme() == "file":  # a rename would overwrite there; a hard link doesn't
                source, target = (jvm.java.io.File(path(x).toUri().getPath()).toPath() for x in (draft, final))
                jvm.java.nio.file.Files.createLink(target, source)
            else:
                none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
                context = hadoop.FileContext.getFileContext(path(self.root).toUri(), self.spark._jsc.hadoopConfiguration())
                context.rename(path(draft), path(final), none)
        except Py4JJavaError as e:
            if not e.java_exception.getClass().getSimpleName().endswith("FileAlreadyExistsException"):
                raise
            return False
        return True

    def commit(self, manifest: DataFrame, version: int, schema: T.StructType) -> int:
        """Make ``manifest`` the state of ``version``; ``Conflict`` if that exists already."""
        path, fs = self._fs()
        state = uuid.uuid4().hex
        manifest.write.parquet(f"{self.root}/states/{state}")
        fs.mkdirs(path(f"{self.root}/manifests"))
        draft = f"{self.root}/drafts/{state}"
        stream = fs.create(path(draft), False)
        stream.write(json.dumps({"state": state, "schema": schema.json()}).encode())
        stream.close()
        won = self._named(draft, f"{self.root}/manifests/{version:010d}")
        removed(self.spark, draft)
        if not won:
            removed(self.spark, f"{self.root}/states/{state}")
            raise Conflict(f"version {version} is committed already")
        return version

    def _commit_next(self, change: Callable[[DataFrame], DataFrame], schema: T.StructType) -> int:
        """Commit what ``change`` makes of the last version, and of the one after if another writer was first."""
        while True:
            version = self.version()
            try:
                return self.commit(change(self.manifest(version)), version + 1, self._merged(self.schema(version), schema))
            except Conflict:
                if self.version() == version:
                    raise

    @staticmethod
    def _merged(old: T.StructType, new: T.StructType) -> T.StructType:
        known = {f.name: f.dataType for f in old.fields}
        for field in new.fields:
            if known.setdefault(field.name, field.dataType) != field.dataType:
                raise ValueError(f"the type of {field.name} has changed")
        return T.StructType([T.StructField(name, kind) for name, kind in known.items()])

    # --- shards

    def _size(self) -> Column:
        return (F.coalesce(F.octet_length(self.text), F.lit(0)) + ROW_BYTES).cast("long")

    def _tier(self, size: Column) -> Column:
        """How many times a shard has grown by ``fan_in`` from the small size."""
        tier, step = F.lit(0), self.small * self.fan_in
        while step <= self.target:
            tier, step = tier + (size >= step).cast("int"), step * self.fan_in
        return tier.cast("int")

    def _write(self, rows: DataFrame, tasks: int) -> str:
        """Write ``rows`` by their ``_shard``, those of one ``_task`` in one of ``tasks`` tasks; the batch's name."""
        batch = f"b{uuid.uuid4().hex}"
        dealt = rows.withColumn("_task", F.col("_task").cast("int")).repartitionById(max(1, tasks), F.col("_task")).drop("_task")
        dealt.write.option("compression", "zstd").partitionBy("_shard").parquet(f"{self.root}/data/_batch={batch}")
        return batch

    def _rows(self, batches: list[str], schema: T.StructType) -> DataFrame:
        own = T.StructType([*schema.fields, T.StructField("_batch", T.StringType()), T.StructField("_shard", T.LongType())])
        folders = [f"{self.root}/data/_batch={b}" for b in sorted(batches)]
        return self.spark.read.option("basePath", f"{self.root}/data").schema(own).parquet(*folders)

    def append(self, arrivals: DataFrame, name: Column | None = None) -> int:
        """Write rows as small shards and commit them; ``name`` tells the arrivals apart. The new version."""
        if OWN & set(arrivals.columns):
            raise ValueError(f"{', '.join(sorted(OWN))} are the store's own columns")
        self._merged(self.schema(), arrivals.schema)
        name = F.lit(f"v{self.version() + 1}") if name is None else F.coalesce(name.cast("string"), F.lit(""))
        sums = arrivals.select(name.alias("_name"), self._size().alias("size")).groupBy("_name").agg(F.sum("size").alias("size"))
        sums = sums.select("_name", F.greatest(F.lit(1), F.expr(f"(size + {self.small - 1}) div {self.small}")).alias("_pieces"))
        sums = _ahead(sums, "_name", F.col("_pieces"))
        names, pieces = sums.agg(F.count("*"), F.coalesce(F.sum("_pieces"), F.lit(0))).first()
        key = F.conv(F.substring(F.md5(F.coalesce(F.col(self.id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
        slots = {c: f"c{i}" for i, c in enumerate(arrivals.columns)}
        rows = arrivals.select(*[F.col(c).alias(slot) for c, slot in slots.items()], F.sha2(name, 256).alias("_mark"), key.alias("_key")).join(_small(sums.drop("_name"), names * SLIM_BYTES), "_mark")
        together = max(1, self.target // self.small)  # so many small shards a task
        rows = rows.withColumn("_shard", F.col("_ahead") + F.col("_key") % F.col("_pieces"))
        rows = rows.select(*[F.col(slot).alias(c) for c, slot in slots.items()], "_shard", F.floor(F.col("_shard") / together).alias("_task"))
        fresh = self.spark.createDataFrame([], MANIFEST)
        if pieces:
            batch = self._write(rows, -(-pieces // together))
            sized = self._rows([batch], arrivals.schema).groupBy(F.col("_shard").alias("file")).agg(F.sum(self._size()).alias("size"), F.count("*").alias("n"))
            named = sums.select("_name", "_ahead", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)).alias("piece"))
            named = named.select(F.concat("_name", F.lit("-"), F.lpad(F.col("piece").cast("string"), 8, "0")).alias("shard"), (F.col("_ahead") + F.col("piece")).alias("file"))
            fresh = self._described(sized.join(named, "file"), batch)
        return self._commit_next(lambda live: live.unionByName(fresh), arrivals.schema)

    def _described(self, sized: DataFrame, batch: str) -> DataFrame:
        """(shard, file, size, n) as rows of a manifest."""
        sized = written(sized, "shards")
        return sized.select("shard", "file", self._tier(F.col("size")).alias("tier"), "size", "n", F.lit(batch).alias("batch"), F.lit(sized.count()).cast("long").alias("of"))

    def plan(self, manifest: DataFrame | None = None) -> DataFrame:
        """The merges that are due: the manifest's rows with the shard ``into`` which they go. Shards of half the target size are never merged again.

        In a tier of ``fan_in`` or more, shards in order of name fill files one after the other: a shard's file is
        the running size before it over the target. Running sizes are summed over ranges of names first.
        """
        due = (self.manifest() if manifest is None else manifest).where(2 * F.col("size") < self.target)
        tiers = due.groupBy("tier").count().where(F.col("count") >= self.fan_in).select("tier")
        due = due.join(F.broadcast(tiers), "tier")  # as many rows as sizes between small and target
        ranges = 1 + due.count() // RANGE_SHARDS
        due = written(due.repartitionByRange(ranges, "tier", "shard", "batch").withColumn("range", F.spark_partition_id()), "due")
        ahead = due.groupBy("tier", "range").agg(F.sum("size").alias("sum"))
        ahead = ahead.withColumn("before", F.sum("sum").over(Window.partitionBy("tier").orderBy("range")) - F.col("sum")).drop("sum")
        inside = F.sum("size").over(Window.partitionBy("tier", "range").orderBy("shard", "batch")) - F.col("size")
        due = due.join(ahead, ["tier", "range"]).withColumn("bin", F.floor((F.col("before") + inside) / F.lit(self.target)).cast("long"))
        file = Window.partitionBy("tier", "bin")
        due = due.withColumn("into", F.concat(F.min("shard").over(file), F.lit("+"))).withColumn("m", F.count("*").over(file)).where("m > 1")
        # two files of one name, from batches with shards of the same names, are told apart
        files = due.groupBy("into", "tier", "bin").agg(F.sum("size").alias("file_size")).withColumn("k", F.row_number().over(Window.partitionBy("into").orderBy("tier", "bin")))
        into = F.when(F.col("k") > 1, F.concat("into", F.lit("~"), F.col("k").cast("string"))).otherwise(F.col("into"))
        return due.join(files.drop("file_size"), ["into", "tier", "bin"]).select("shard", "file", "tier", "size", "n", "batch", "of", into.alias("into"))

    def compact(self) -> int | None:
        """Carry out the merges that are due and commit; None if none are. Merged-away files stay until ``vacuum``."""
        version = self.version()
        plan = written(self.plan(self.manifest(version)), "merges")
        due = plan.count()
        if not due:
            return None
        merged = plan.groupBy(F.col("into").alias("shard")).agg(F.sum("size").alias("size"), F.sum("n").alias("n"))
        merged = _ahead(merged, "shard", F.lit(1)).withColumnRenamed("_ahead", "file")
        into = plan.withColumn("_mark", F.sha2("into", 256)).join(merged.select("_mark", F.col("file").alias("_into")), "_mark")
        mapping = into.select(F.col("batch").alias("_batch"), F.col("file").alias("_shard"), "_into")
        schema = self.schema(version)
        batches = [r.batch for r in plan.select("batch").distinct().collect()]
        rows = self._rows(batches, schema).join(_small(mapping, due * SLIM_BYTES), ["_batch", "_shard"])
        rows = rows.select(*schema.names, F.col("_into").alias("_shard"), F.col("_into").alias("_task"))
        batch = self._write(rows, merged.count())
        fresh = self._described(merged.drop("_mark"), batch)

        def change(live: DataFrame) -> DataFrame:
            gone = plan.select("batch", "file")
            if live.join(gone, ["batch", "file"], "left_semi").count() != due:
                raise RuntimeError("another writer has merged the same shards")
            return live.join(gone, ["batch", "file"], "left_anti").unionByName(fresh)

        return self._commit_next(change, schema)

    def read(self) -> DataFrame:
        """The rows of the live shards, with ``_batch`` and ``_shard``, its file's number there.

        Batches whose shards are all live are read as they are; of the others, the live shards by a join.
        """
        version = self.version()
        live, schema = self.manifest(version), self.schema(version)
        sizes = live.groupBy("batch").agg(F.count("*").alias("k"), F.first("of").alias("of"))
        found = sizes.collect()
        whole, part = [r.batch for r in found if r.k == r.of], [r.batch for r in found if r.k < r.of]
        if not found:
            raise ValueError("the store is empty")
        out = self._rows(whole, schema) if whole else None
        if part:
            # the filter on this side lets Spark prune the folders that the join would drop
            wanted = live.where("n > 0").join(sizes.where("k < of").select("batch"), "batch", "left_semi")
            wanted = wanted.select(F.col("batch").alias("_batch"), F.col("file").alias("_shard"))
            rows = self._rows(part, schema)
            rows = rows.join(_small(wanted, SLIM_BYTES * sum(r.k for r in found if r.k < r.of)), ["_batch", "_shard"], "left_semi").select(*rows.columns)
            out = rows if out is None else out.unionByName(rows)
        return out

    def vacuum(self, min_age: float = 3600.0) -> None:
        """Delete the data of batches that the last version no longer names and that are ``min_age`` seconds old; younger ones may be about to be committed."""
        path, fs = self._fs()
        live = {f"_batch={r.batch}" for r in self.manifest().select("batch").distinct().collect()}
        folder = path(f"{self.root}/data")
        for status in fs.listStatus(folder) if fs.exists(folder) else []:
            if status.getPath().getName() not in live and status.getModificationTime() <= 1000 * (time.time() - min_age):
                fs.delete(status.getPath(), True)


def _free(name: str, taken: set[str]) -> str:
    while name in taken:
        name = "_" + name
    return name


def sharded(docs: DataFrame, name: Column | None = None, *, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Build a store of ``docs`` in the shared folder, compact it fully and read it back.

    The columns of ``docs`` with ``shard``, ``shard_docs`` and ``shard_bytes`` of its manifest.
    """
    spark = docs.sparkSession
    slots = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(*[docs[c].alias(slot) for c, slot in slots.items()], (F.lit("v1") if name is None else name).alias("arrival"))
    store = ShardStore(spark, new_path(spark, "shards"), id_col=slots[id_col], text=slots[text], **how)
    store.append(rows, F.col("arrival"))
    while store.compact():
        store.vacuum(0.0)
    live = store.manifest()
    own = [_free(x, set(docs.columns)) for x in ("shard", "shard_docs", "shard_bytes")]
    if not live.take(1):
        return docs.select("*", F.lit("").alias(own[0]), F.lit(0).cast("long").alias(own[1]), F.lit(0).cast("long").alias(own[2]))
    sizes = live.select(F.col("batch").alias("_batch"), F.col("file").alias("_shard"), "shard", F.col("n").alias("shard_docs"), F.col("size").alias("shard_bytes"))
    weight = live.agg(F.sum(F.octet_length("shard") + SLIM_BYTES)).first()[0]
    out = store.read().join(_small(sizes, weight), ["_batch", "_shard"])
    return out.select(*[F.col(slot).alias(c) for c, slot in slots.items()], *[F.col(x).alias(y) for x, y in zip(("shard", "shard_docs", "shard_bytes"), own)])


#: Arrivals of the query: documents by the remainder of their id by six, two thirds in the first.
ARRIVAL = "concat('a', cast(case when doc_id is null then 0 else array(0, 0, 0, 0, 1, 2)[cast(pmod(doc_id, 6) as int)] end as string))"


def op9_sharding(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes (its size in a shard), shard, shard_docs, shard_bytes for every document."""
    out = sharded(documents, F.expr(ARRIVAL))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long")
    return out.select("doc_id", size.alias("n_bytes"), "shard", "shard_docs", "shard_bytes")


def _sql(rounds: int = 3) -> str:
    """The layout in DuckDB: small shards by hash, then rounds of merges by tiers."""
    small, target = 2 << 20, 64 << 20
    parts = [
        f"""d as (select doc_id, cast(coalesce(strlen(text), 0) + {ROW_BYTES} as bigint) as n_bytes, 'a' || cast([0, 0, 0, 0, 1, 2][doc_id % 6 + 1] as varchar) as name from documents)""",
        f"p as (select name, greatest(1, (cast(sum(n_bytes) as bigint) + {small - 1}) // {small}) as pieces from d group by name)",
        "r0 as (select doc_id, n_bytes, name || '-' || lpad(cast(cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 8) as bigint) % pieces as varchar), 8, '0') as shard from d join p using (name))",
    ]
    for k in range(rounds):
        parts.append(f"""m{k} as (select shard, cast(sum(n_bytes) as bigint) as size, case when sum(n_bytes) >= {small * 16} then 2 when sum(n_bytes) >= {small * 4} then 1 else 0 end as tier from r{k} group by shard),
k{k} as (select *, count(*) over (partition by tier) as k, (cast(sum(size) over (partition by tier order by shard) as bigint) - size) // {target} as bin from m{k} where 2 * size < {target}),
i{k} as (select shard, min(shard) over (partition by tier, bin) || '+' as next, count(*) over (partition by tier, bin) as m from k{k} where k >= 4),
r{k + 1} as (select doc_id, n_bytes, coalesce(next, r{k}.shard) as shard from r{k} left join (select * from i{k} where m > 1) x on x.shard = r{k}.shard)""")
    parts.append(f"z as (select shard, count(*) as shard_docs, cast(sum(n_bytes) as bigint) as shard_bytes from r{rounds} group by shard)")
    return "with " + ",\n".join(parts) + f"\nselect doc_id, n_bytes, shard, shard_docs, shard_bytes from r{rounds} join z using (shard)"


ORACLE = _sql()
