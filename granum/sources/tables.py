"""Sources and sinks: tables, files, keyed values, dictionaries, schemas."""

from __future__ import annotations

import hashlib
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def placed(table: DataFrame, name: str = "place") -> DataFrame:
    """A table as read from files with each row's place in it, file and row of the file: a tie-break that no plan changes."""
    return table.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index"))


def list_files(spark: SparkSession, folder: str, page: int = 1, size: int = 100, glob: str = "*") -> DataFrame:
    """A page of a folder's entries by name: path, length, modified. Pages start at 1; a page holds 100 entries by default and 1000 at most.

    A folder in it is one entry, with the sum of its files' lengths and the latest of their times; one without files is
    none. Names that begin with _ or . are hidden, as Spark's readers have it.
    """
    size = min(size if size > 0 else 100, 1000)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    top, wanted = fs.makeQualified(path(folder)).toString().rstrip("/") + "/", path(path(folder), glob)
    found = bool(fs.globStatus(wanted))  # without a match Spark's reader would refuse the path
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(wanted.toString() if found else folder).where(F.lit(found))
    name = F.substring_index(F.substring("path", len(top) + 1, 2**31 - 1), "/", 1)
    entries = files.where(~name.rlike("^[_.]")).groupBy(F.concat(F.lit(top), name).alias("path")).agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modified"))
    return entries.orderBy("path").offset((max(page, 1) - 1) * size).limit(size)


def content_keys(values: DataFrame, value: str) -> DataFrame:
    """A content-addressed table: SHA-256 of each distinct value, with how many rows refer to it."""
    return values.groupBy(F.sha2(F.col(value), 256).alias("key")).agg(F.first(value).alias("value"), F.count("*").alias("refs"))


def keys_with_value(store: DataFrame, key: str, value: str, wanted: object, offset: int = 0, limit: int = 100) -> DataFrame:
    return store.where(F.col(value) == F.lit(wanted)).select(key).orderBy(key).offset(offset).limit(limit)


def overlay_value(store: DataFrame, key: str, value: str, wanted: object, at: int, text: str) -> DataFrame:
    """Part of one key's value replaced from character `at` (1-based) on."""
    return store.withColumn(value, F.when(F.col(key) == F.lit(wanted), F.overlay(F.col(value), F.lit(text), F.lit(at))).otherwise(F.col(value)))


def evolve(old: DataFrame, schema: StructType, defaults: dict[str, object]) -> DataFrame:
    """Rows of an older schema under a newer one: missing columns take their default, dropped ones go."""
    return old.select(*[(F.col(f.name) if f.name in old.columns else F.lit(defaults.get(f.name))).cast(f.dataType).alias(f.name) for f in schema])


def schema_digest(schema: StructType) -> str:
    return hashlib.sha256(schema.json().encode()).hexdigest()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors share; only local mode does without that setting."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if folder is None and sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
            folder = tempfile.mkdtemp(prefix="granum-checkpoint-")
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df checkpointed in the shared folder, so that what depends on where rows lie can't change."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def register_schema(registry: DataFrame, name: str, schema: StructType) -> DataFrame:
    """The registry (name, version, digest, json) with a schema as the next version of its name, unless it is the latest already."""
    spark = registry.sparkSession
    new = spark.createDataFrame([(name, schema_digest(schema), schema.json())], "name string, digest string, json string")
    latest = registry.where(F.col("name") == name).agg(F.coalesce(F.max("version"), F.lit(0)).alias("v"), F.max_by("digest", "version").alias("d"))
    fresh = new.crossJoin(F.broadcast(latest)).where("not digest <=> d")  # one row
    return registry.unionByName(fresh.select("name", (F.col("v") + 1).alias("version"), "digest", "json"))


def put_values(store: DataFrame, puts: DataFrame, key: str, at: str) -> DataFrame:
    """Keyed values after puts: of several for a key the latest by `at` counts."""
    last = puts.groupBy(key).agg(F.max_by(F.struct(*[c for c in puts.columns if c != key]), at).alias("_x"))
    last = last.select(key, *[F.col(f"_x.{c}").alias(c) for c in store.columns if c != key])
    return store.join(last.select(key), key, "left_anti").unionByName(last)


def contains_key(store: DataFrame, key: str, wanted: object) -> DataFrame:
    return store.where(F.col(key) == F.lit(wanted)).limit(1).agg((F.count("*") > 0).alias("found"))


def text_dictionary(values: DataFrame, value: str, first: int = 1) -> DataFrame:
    """Distinct texts with whole-number ids in order of text, and how many rows hold each."""
    from granum.operators.mutate import numbered_rows

    counted = values.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("text")).agg(F.count("*").alias("refs"))
    return numbered_rows(counted, [F.col("text")], "id").select((F.col("id") + first).alias("id"), "text", "refs")


def change_references(dictionary: DataFrame, changes: DataFrame) -> DataFrame:
    """The dictionary after retains and releases (text, by: +1 or -1); texts that none holds any more go."""
    total = changes.groupBy("text").agg(F.sum("by").alias("_by"))
    out = dictionary.join(total, "text", "left").withColumn("refs", F.col("refs") + F.coalesce("_by", F.lit(0)))
    return out.where("refs > 0").select(dictionary.columns)


def members_of(edges: DataFrame, group: str, member: str, wanted: object) -> DataFrame:
    return edges.where(F.col(group) == F.lit(wanted)).select(member).distinct()


def leave_group(members: DataFrame, admins: DataFrame, leaving: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Memberships and administrations without those that leave; who leaves is no administrator either."""
    gone = leaving.select(*keys).distinct()
    return members.join(gone, keys, "left_anti"), admins.join(gone, keys, "left_anti")


def tagged(files: DataFrame, tags: DataFrame, file_key: str, tag: str) -> DataFrame:
    """Files that bear a tag, by a bridge table (file_key, tag)."""
    return files.join(tags.where(F.col("tag") == tag).select(file_key).distinct(), file_key, "left_semi")


def tags_of(tags: DataFrame, file_key: str) -> DataFrame:
    """Per file its tags in order."""
    return tags.groupBy(file_key).agg(F.array_sort(F.collect_set("tag")).alias("tags"))
