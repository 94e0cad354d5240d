"""Sources and sinks on Spark's own file formats."""

from __future__ import annotations

import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.functions.exprs import canonical, no_nan
from winnow.operators.primitives import settle, shared_folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the session's checkpoints, where all executors can write."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, time_col: str,
                 step_s: float) -> DataFrame:
    """Parquet records under an explicit schema: NaN becomes NULL, step = ceil(t / dt)."""
    df = spark.read.schema(schema).parquet(path)
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType,
                                                                          T.FloatType))}
    df = df.select(*[no_nan(c).alias(c) if c in floats else F.col(c) for c in df.columns])
    return df.withColumn("step", F.ceil(F.col(time_col) / F.lit(float(step_s))))


COMMITS = "commits"
_COMMIT = "config_hash string, version int, attempt string, tables array<string>, at_ns bigint"


def write_attempt(tables: Mapping[str, DataFrame], folder: str, key: str, version: int,
                  attempt: str) -> None:
    """The tables of one attempt; nothing reads them before their commit record is there."""
    for name, df in tables.items():
        if name == COMMITS:
            raise ValueError(f"{COMMITS} is the name of the commit records")
        (df.withColumns({"config_hash": F.lit(key), "version": F.lit(version),
                         "attempt": F.lit(attempt)})
         .write.mode("append").partitionBy("config_hash", "version", "attempt")
         .parquet(f"{folder}/{name}"))


def save_result_set(tables: Mapping[str, DataFrame], folder: str, key: str,
                    version: int) -> str:
    """Store the tables of one run under its content key, all or none.

    The commit record over all tables is written last and names the attempt, so a run that died
    half-way leaves files that no reader sees, and a repeated run is a new attempt.
    """
    attempt = uuid.uuid4().hex
    write_attempt(tables, folder, key, version, attempt)
    spark = next(iter(tables.values())).sparkSession
    (spark.createDataFrame([(key, version, attempt, sorted(tables), time.time_ns())], _COMMIT)
     .coalesce(1).write.mode("append").parquet(f"{folder}/{COMMITS}"))
    return attempt


def committed(spark: SparkSession, folder: str, key: str, version: int):
    """The newest commit record (attempt, tables) of a key in this version, or None."""
    try:
        records = spark.read.schema(_COMMIT).parquet(f"{folder}/{COMMITS}")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return None  # nothing was ever stored here
    return (records.filter((F.col("config_hash") == key) & (F.col("version") == version))
            .orderBy(F.desc("at_ns"), "attempt").select("attempt", "tables").first())


def load_result_set(spark: SparkSession, folder: str, schema: T.StructType | str, name: str,
                    key: str, version: int) -> DataFrame:
    """One stored table; empty when the key is missing or was stored by another version."""
    return load_result_tables(spark, folder, {name: schema}, key, version)[name]


def load_result_tables(spark: SparkSession, folder: str,
                       schemas: Mapping[str, T.StructType | str], key: str, version: int
                       ) -> dict[str, DataFrame]:
    """Tables of one committed attempt; all are empty without a commit of key and version."""
    found = committed(spark, folder, key, version)
    out = {}
    for name, schema in schemas.items():
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        if found is None or name not in found.tables:
            out[name] = spark.createDataFrame([], schema)
            continue
        full = T.StructType([*schema.fields, T.StructField("config_hash", T.StringType()),
                             T.StructField("version", T.IntegerType()),
                             T.StructField("attempt", T.StringType())])
        out[name] = (spark.read.schema(full).parquet(f"{folder}/{name}")
                     .filter((F.col("config_hash") == key) & (F.col("version") == version)
                             & (F.col("attempt") == found.attempt))
                     .drop("config_hash", "version", "attempt"))
    return out


def missing_keys(cases: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Cases whose content key has no stored result: only these need computing."""
    return cases.join(stored.select(key).distinct(), key, "left_anti")


def content_key(cols: Sequence[str], version: int):
    """SHA-256 of what a case depends on, and of the version of the code that computes it."""
    named = {c: F.col(c) for c in cols}
    return F.sha2(canonical({**named, "~version": F.lit(version)}), 256)


def write_log(df: DataFrame, path: str) -> None:
    """Append entries as JSON lines; nothing stored is rewritten."""
    df.write.mode("append").option("ignoreNullFields", "false").json(path)


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a column for lines that are not valid JSON; blank lines are skipped."""
    return (spark.read.schema(f"{schema}, _malformed string").option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_malformed").json(path))


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("error").option("header", True).csv(path)


def read_report(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def export_timeline(df: DataFrame, path: str, by: str, digits: int = 4) -> DataFrame:
    """Write a timeline as one JSON file set per scenario and return the exported rows."""
    out = export_rows(df, digits)
    out.write.mode("error").partitionBy(by).option("ignoreNullFields", "false").json(path)
    return out


def export_rows(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*[
        F.round(no_nan(f.name), digits).alias(f.name) if isinstance(f.dataType, T.DoubleType)
        else F.col(f.name) for f in df.schema.fields])


def newest(spark: SparkSession, path: str, reader: str, pattern: str) -> DataFrame:
    """Rows of the most recently modified file among those a glob matches."""
    df = spark.read.format(reader).option("pathGlobFilter", pattern).load(path)
    meta = df.select("*", F.col("_metadata.file_path").alias("_path"),
                     F.col("_metadata.file_modification_time").alias("_time"))
    last = (spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
            .select("path", "modificationTime")
            .agg(F.max_by("path", F.struct("modificationTime", "path")).alias("_newest")))
    bare = F.regexp_replace
    return (meta.withColumn("_one", F.lit(1))
            .join(F.broadcast(last.withColumn("_one", F.lit(1))), "_one")
            .filter(bare("_path", "^file:/+", "/") == bare("_newest", "^file:/+", "/"))
            .drop("_one", "_path", "_time", "_newest"))


def _sha256_of_file(spark: SparkSession, path: Column) -> Column:
    """SHA-256 of the file at a path, read as a stream by the task that asks for it.

    ``binaryFile`` puts a file into one value, which ends at 2 GB and needs the file several times
    over in memory.  Spark has no function over a stream, so the calls (open the path with the
    session's file systems, digest the stream, close it at its end) are put together as one column.
    """
    jvm, of = spark._jvm, spark._jvm.java.lang.Class.forName
    catalyst = jvm.org.apache.spark.sql.catalyst.expressions
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils

    def seq(*items):
        return jvm.PythonUtils.toSeq(list(items))

    def kind(cls: str):
        return jvm.org.apache.spark.sql.types.ObjectType(of(cls))

    def call(target, method: str, cls: str, *args):
        return catalyst.objects.Invoke(target, method, kind(cls), seq(*args), seq(), True, True, True)

    def static(cls: str, method: str, returns, *args):
        return catalyst.objects.StaticInvoke(of(cls), returns, method, seq(*args), seq(), True, True,
                                             True, getattr(jvm.scala, "None$").__getattr__("MODULE$"))

    def new(cls: str, *args):
        return catalyst.objects.NewInstance(of(cls), seq(*args), seq(), True, kind(cls),
                                            getattr(jvm.scala, "None$").__getattr__("MODULE$"))

    shipped = "org.apache.spark.util.SerializableConfiguration"
    conf = call(catalyst.Literal(jvm.org.apache.spark.util.SerializableConfiguration(
        spark._jsparkSession.sessionState().newHadoopConf()), kind(shipped)),
        "value", "org.apache.hadoop.conf.Configuration")
    at = new("org.apache.hadoop.fs.Path", call(utils.expression(path._jc), "toString",
                                               "java.lang.String"))
    opened = call(call(at, "getFileSystem", "org.apache.hadoop.fs.FileSystem", conf), "open",
                  "org.apache.hadoop.fs.FSDataInputStream", at)
    digest = static("org.apache.commons.codec.digest.DigestUtils", "sha256Hex",
                    kind("java.lang.String"),
                    new("org.apache.commons.io.input.AutoCloseInputStream", opened))
    text = static("org.apache.spark.unsafe.types.UTF8String", "fromString",
                  jvm.org.apache.spark.sql.types.DataType.fromDDL("string"), digest)
    return type(path)(utils.column(text))


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file, hashed where it is read; path relative to the root.

    A file is one task's, as the digest is a chain over its blocks, but never in memory as a whole.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(root))
    base = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), base, -1)
    return files.select(rel.alias("path"), _sha256_of_file(spark, F.col("path")).alias("sha256"),
                        "length")


def integrity(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """ok, missing, unlisted or mismatch for every path of either side."""
    f = found.select("path", F.col("sha256").alias("_found"))
    m = manifest.select("path", F.col("sha256").alias("_want"))
    status = (F.when(F.col("_found").isNull(), "missing").when(F.col("_want").isNull(), "unlisted")
              .when(F.col("_found") != F.col("_want"), "mismatch").otherwise("ok"))
    return f.join(m, "path", "full").select("path", status.alias("status"))


#: Lines one digest is made of, about.
LINES_PER_DIGEST = 1000


def tree_hash(files: DataFrame, lines_per_digest: int = LINES_PER_DIGEST) -> DataFrame:
    """(tree, files): one digest over many files (path, sha256), folder by folder from below.

    A folder's digest is over the lines of its files and folders.  They are dealt into buckets by a
    hash of the name, so that a bucket has about ``lines_per_digest`` lines; a bucket's sorted lines
    give a digest, and digests of neighbouring buckets are folded again until one is left.  How
    often depends on the number of lines of that folder alone.  No row holds more than a bucket.
    """
    depth = F.size(F.split("path", "/"))
    nodes = settle(files.select("path", depth.alias("depth"), F.concat_ws(
        " ", F.lit("file"), F.substring_index("path", "/", -1), "sha256").alias("line")))
    first = nodes.agg(F.max("depth").alias("most"), F.count("*").alias("n")).first()
    below = None
    for level in range(first.most or 0, 0, -1):
        here = nodes.filter(F.col("depth") == level).select("path", "line")
        if below is not None:
            here = here.unionByName(below)
        lines = here.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "line")
        below = _folded(lines, lines_per_digest).select(
            F.col("folder").alias("path"), F.concat_ws(
                " ", F.lit("folder"), F.substring_index("folder", "/", -1), "digest").alias("line"))
    spark = files.sparkSession
    if below is None:
        return spark.createDataFrame([], "tree string, files bigint")
    return below.select(F.substring_index("line", " ", -1).alias("tree"),
                        F.lit(first.n).cast("bigint").alias("files"))


def _folded(lines: DataFrame, per_digest: int) -> DataFrame:
    """(folder, digest) of lines (folder, line)."""
    key = F.conv(F.substring(F.md5("line"), 1, 12), 16, 10).cast("bigint")
    counts = lines.groupBy("folder").agg(F.count("*").alias("n"))
    parts = F.ceil(F.col("n") / per_digest).cast("bigint")
    # the number of a bucket follows the order of the hash
    rows = lines.withColumn("_key", key).join(counts, "folder").select(
        "folder", "line", F.floor(F.col("_key") * parts / F.lit(float(1 << 48))).alias("bucket"),
        parts.alias("left"))
    done = None
    while True:
        text = F.concat_ws("\n", F.array_sort(F.collect_list("line")))
        digests = settle(rows.groupBy("folder", "left", "bucket").agg(
            F.sha2(text, 256).alias("digest")))
        single = digests.filter("left = 1").select("folder", "digest")
        done = single if done is None else done.unionByName(single)
        rows = digests.filter("left > 1").select(
            "folder", F.concat_ws(" ", F.lpad(F.col("bucket").cast("string"), 12, "0"), "digest")
            .alias("line"), F.floor(F.col("bucket") / per_digest).alias("bucket"),
            F.ceil(F.col("left") / per_digest).cast("bigint").alias("left"))
        if rows.isEmpty():
            return done
