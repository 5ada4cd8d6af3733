"""Readers and writers: nested JSON, JSON lines, CSV, catalogs, idempotent tables, audits."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"

PLAYER = T.StructType([T.StructField("jerseyNum", T.StringType()), T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("visibility", T.StringType())])
BALL = T.StructType([T.StructField(c, T.DoubleType()) for c in "xyz"])
TRACKING = T.StructType(
    [
        T.StructField("gameRefId", T.DoubleType()),
        T.StructField("frameNum", T.LongType()),
        T.StructField("period", T.IntegerType()),
        T.StructField("videoTimeMs", T.DoubleType()),
        T.StructField("periodGameClockTime", T.DoubleType()),
        T.StructField("game_event", T.StructType([T.StructField("home_ball", T.BooleanType()), T.StructField("player_id", T.LongType())])),
        T.StructField("homePlayers", T.ArrayType(PLAYER)),
        T.StructField("awayPlayers", T.ArrayType(PLAYER)),
        T.StructField("balls", T.ArrayType(BALL)),
    ]
)


def json_documents(spark: SparkSession, path: str, schema: T.StructType | None = None, id_pattern: str | None = None) -> DataFrame:
    """Files that hold one object or an array of objects. Without a schema all rows are looked
    at for one. ``id_pattern`` takes a match_id from the file's path."""
    reader = spark.read.option("multiLine", True)
    df = reader.schema(schema).json(path) if schema else reader.option("samplingRatio", 1.0).json(path)
    return df if id_pattern is None else df.withColumn("match_id", F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).try_cast("long"))


def json_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines, compressed or not (bz2 is split); lines that don't parse are kept in
    ``_corrupt_record`` instead of failing the read."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    # parsed from text lines: the JSON source itself refuses to count by the corrupt column alone
    parsed = F.from_json("value", with_corrupt, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return spark.read.text(path).where(F.trim("value") != "").select(parsed.alias("r")).select("r.*")


def peeked_lines(spark: SparkSession, path: str, rows: int = 1000) -> DataFrame:
    """JSON lines under the schema that the first ``rows`` of them show; keys that come later
    are left out, so give a schema where it is known."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(rows)
    shape = spark.read.json(head.rdd.map(lambda r: r[0])).schema  # the head only
    return json_lines(spark, path, shape).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def with_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order, cast where safe or not; missing ones are null,
    values that can't be cast too."""
    have = set(df.columns)
    return df.select(*[(F.col(f.name).try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields])


def tagged_union(frames: dict[str, DataFrame], tag: str) -> DataFrame:
    """One table of several, each row with its source's name in ``tag``."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(name)) for name, df in frames.items()])


def tree(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All JSON lines below a folder, however deep."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def allowed(df: DataFrame, column: str, value: str, values: tuple[str, ...]) -> DataFrame:
    """Rows with a value out of a closed list; a value outside it is an error, not an empty answer."""
    if value not in values:
        raise ValueError(f"{column} must be one of {', '.join(values)}")
    return df.where(F.col(column) == value)


def extract_all(spark: SparkSession, jobs: dict[str, Callable[[], DataFrame]], folder: str) -> dict[str, DataFrame]:
    """Writes each table below ``folder`` unless it is there, and returns them as read back."""
    return {name: materialize(spark, f"{folder}/{name}", build) for name, build in jobs.items()}


def text_card(row_columns: dict[str, str], title: str):
    """An expression for a text card: the title column, then "label: value" lines."""
    lines = [F.concat(F.lit(f"{label}: "), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for label, c in row_columns.items()]
    return F.concat_ws("\n", F.coalesce(F.col(title), F.lit("?")), *lines)


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null, n_rows) of every column, in one pass."""
    names = df.columns
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return one.select("_n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null")) for c in names])).alias("x")).select("x.*", F.col("_n").alias("n_rows"))


def sampled_agreement(a: DataFrame, b: DataFrame, key: str, share: float) -> DataFrame:
    """(n_sampled, n_same): rows of a hash sample by key that are the same in both tables. The
    sample is a feature of the audit; each side is sampled where it is read."""
    names = sorted(a.columns)
    pick = lambda df: df.where(F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") < int(share * (1 << 32))).select(key, F.to_json(F.struct(*names)).alias("row")).distinct()
    both = pick(a).join(pick(b).withColumnRenamed("row", "other"), key, "full")
    return both.agg(F.count(F.lit(1)).alias("n_sampled"), F.count_if(F.col("row").eqNullSafe(F.col("other"))).alias("n_same"))


def tracking_frames(spark: SparkSession, path: str) -> DataFrame:
    """Well-formed tracking frames; the schema is fixed, so a key that comes late isn't lost."""
    return json_lines(spark, path, TRACKING).where(F.col(CORRUPT).isNull()).drop(CORRUPT)


def catalog(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """Catalog entries that parse, and the number of those that don't (one row, n_corrupt), so
    that a caller can warn."""
    lines = json_lines(spark, path, schema)
    bad = F.col(CORRUPT).isNotNull()
    return lines.where(~bad).drop(CORRUPT), lines.agg(F.count_if(bad).alias("n_corrupt"))


def csv_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.option("header", True).option("mode", "PERMISSIVE").schema(schema).csv(path)


def scan(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Parquet tables of different optional columns as one, numbers widened."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [spark.read.parquet(p) for p in paths])


def partition(df: DataFrame, column: str, value: object) -> DataFrame:
    """One partition; raises if there is none, as an empty answer would hide a wrong id."""
    part = df.where(F.col(column) == value)
    if part.isEmpty():
        raise LookupError(f"no rows with {column} = {value}")
    return part


def write(df: DataFrame, path: str, by: list[str] | None = None, overwrite: bool = False, max_rows_per_file: int = 5_000_000) -> None:
    """Parquet with statistics. Without ``overwrite`` an existing table is an error; with it
    and ``by`` only the partitions at hand are replaced."""
    writer = df.write.mode("overwrite" if overwrite else "errorifexists").option("maxRecordsPerFile", max_rows_per_file)
    if by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*by)
    writer.parquet(path)


def materialize(spark: SparkSession, path: str, build: Callable[[], DataFrame], refresh: bool = False) -> DataFrame:
    """The table at ``path``, built and written if it isn't there or a refresh is asked for.
    Only a finished write counts (its success mark), so a broken run is built again."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    done = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS"))
    if refresh or not done:
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def without_sentinels(df: DataFrame, sentinels: tuple[str, ...] = ("", "null")) -> DataFrame:
    """Null for sentinel texts in every string leaf of the schema, structs and arrays included."""

    def clean(col, dtype):
        if isinstance(dtype, T.StringType):
            return F.when(~col.isin(*sentinels), col)
        if isinstance(dtype, T.StructType):
            return F.when(col.isNotNull(), F.struct(*[clean(col[f.name], f.dataType).alias(f.name) for f in dtype.fields]))
        if isinstance(dtype, T.ArrayType):
            return F.transform(col, lambda x: clean(x, dtype.elementType))
        return col

    return df.select(*[clean(F.col(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def round_trip(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, n): rows, as a multiset, that only one of two tables has; none means a lossless copy."""
    names = sorted(a.columns)
    h = lambda df: df.select(F.to_json(F.struct(*[F.col(c) for c in names])).alias("row")).groupBy(F.xxhash64("row").alias("h"), F.sha2("row", 256).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    both = h(a).join(h(b).withColumnRenamed("n", "m"), ["h", "k"], "full").select((F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0))).alias("d")).where("d <> 0")
    return both.groupBy(F.when(F.col("d") > 0, "left").otherwise("right").alias("side")).agg(F.sum(F.abs("d")).alias("n"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, modified) of a tree, without reading the files."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
