"""Tables, JSON chunks and text sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import escape_quoted


def ordered_scan(table: DataFrame, project: int, order: str = "id") -> DataFrame:
    """A project's rows by id."""
    return table.where(F.col("project_id") == project).orderBy(order)


def setting(table: DataFrame, key: str) -> DataFrame:
    """A value by key, blank as null."""
    return table.where(F.col("key") == key).select(F.nullif(F.trim("value"), F.lit("")).alias("value"))


def read_json_batch(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON arrays, one for each file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """S26."""
    return spark.read.schema(schema).json(path)


def write_chunks(rows: DataFrame, path: str, order: str, chunk: int = 500) -> None:
    """JSON lines in files of at most ``chunk`` rows, in order, committed as a whole."""
    rows.repartitionByRange(order).sortWithinPartitions(order).write.option("maxRecordsPerFile", min(max(chunk, 1), 10_000)).json(path)


def string_lines(lines: DataFrame, number: str, text: str, sound: str) -> Column:
    """A line of a string table: ``@n = ~text~ [SOUND]``."""
    named = F.concat(F.lit("@"), F.col(number).cast("string"), F.lit(" = ~"), escape_quoted(F.col(text)), F.lit("~"))
    return F.when(F.col(sound).isNotNull(), F.concat(named, F.lit(" ["), F.upper(F.col(sound)), F.lit("]"))).otherwise(named)


def manifest(rows: DataFrame, key: str) -> DataFrame:
    """One JSON document for each key with its rows in order of name."""
    entry = F.struct(*[c for c in rows.columns if c != key])
    return rows.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("entries")).select(key, F.to_json(F.struct(key, "entries")).alias("manifest"))


def corpus_errors(voices: DataFrame, lines: DataFrame, required: tuple[str, ...], least_voices: int = 4, least_lines: int = 20) -> list[str]:
    """What a benchmark corpus lacks; empty if it will do."""
    v = voices.agg(F.count_distinct("id").alias("n")).first()["n"]
    got = lines.agg(F.count_distinct("id").alias("n"), F.collect_set(F.when(F.col("category").isin(*required), F.col("category"))).alias("found")).first()
    unknown = lines.join(voices.select(F.col("id").alias("voice_id")), "voice_id", "left_anti").count()
    errors = [f"{v} voices, {least_voices} needed"] * (v < least_voices) + [f"{got['n']} lines, {least_lines} needed"] * (got["n"] < least_lines)
    return errors + [f"no line of category {c}" for c in required if c not in got["found"]] + [f"{unknown} lines of unknown voices"] * (unknown > 0)


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """Path and length of the files of a folder, by Spark's reader."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length")


def choose_locale(paths: DataFrame, locale: str, fallback: str = "en_US") -> DataFrame:
    """The path of a locale's string table (locale, path), or of the fallback."""
    rank = F.when(F.lower("locale") == locale.lower(), 0).when(F.lower("locale") == fallback.lower(), 1).otherwise(2)
    return paths.withColumn("_r", rank).where("_r < 2").orderBy("_r", "path").limit(1).select("path")
