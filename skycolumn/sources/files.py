"""File-level sources: safe reads, selection by name, delimited tables, sounding texts."""

from __future__ import annotations

import io
import re
from collections.abc import Iterator, Sequence
from urllib.parse import unquote

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names in the header of a sounding text with the columns they become; columns of the side tables.
SOUNDING_COLUMNS = {"Time": "time_sec", "UTC Time": "time_UTC", "P": "P_hPa", "T": "T_degC", "Hu": "RH_perc", "Ws": "Wsp_mps", "Wd": "Wd_deg",
                    "Long.": "lon_deg", "Lat.": "lat_deg", "Geopot": "elv_masl", "Dewp.": "Tdew_degC"}
ZDR_CORRECTIONS = "filename string, datetime timestamp_ntz, correction_dB double, std_dB double"
DFR_CORRECTIONS = ("time timestamp_ntz, num_valid_points bigint, correlation double, mean_DFR double, "
                   "ratio_DFR_var double, cloudtop_ranges string, cloudtop_times string, DFR string")
# A Parquet file without rows is a footer alone; a longer one that gives no row is corrupt.
FOOTER_BYTES = 64 << 20


def _without_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (source_file, content) the files that open and hold no rows."""
    for batch in batches:
        sound = []
        for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            try:
                if pq.ParquetFile(io.BytesIO(content.as_py())).metadata.num_rows == 0:
                    sound.append(file)
            except (pa.ArrowException, OSError):
                pass
        yield pa.RecordBatch.from_arrays([pa.array(sound, pa.string())], names=["source_file"])


def read_many_safe(spark: SparkSession, paths: Sequence[str], schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, excluded files): files that do not open, corrupt ones or ones of no bytes, are skipped and listed.

    The listing is the file index Spark builds anyway (a listing by ``binaryFile`` would miss files of no bytes). The files that
    give no row are found while this is called, from the footers alone; of these, the ones that open are sound and not excluded.
    """
    reader = spark.read.schema(schema).option("ignoreCorruptFiles", "true").parquet(*paths)
    rows = reader.withColumn("source_file", F.col("_metadata.file_path"))
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    listed = spark.createDataFrame([(f,) for f in reader.inputFiles()], "listed string").withColumn("source_file", plain("listed"))
    read = rows.select(plain("source_file").alias("source_file")).distinct()
    silent = [tuple(r) for r in listed.join(read, "source_file", "left_anti").select("source_file", "listed").collect()]
    excluded = spark.createDataFrame([(f,) for f, _ in silent], "source_file string")
    if silent:
        # names are no patterns
        names = [re.sub(r"([\[\]{}*?\\])", r"\\\1", unquote(f)) for _, f in silent]
        whole = spark.read.format("binaryFile").load(names).filter(F.col("length") <= FOOTER_BYTES)
        sound = whole.select(plain(F.col("_metadata.file_path")).alias("source_file"), "content").mapInArrow(_without_rows, "source_file string")
        excluded = excluded.join(sound, "source_file", "left_anti")
    return rows, excluded


def select_files(manifest: DataFrame, name: str, pattern: str, fmt: str, start: str, end: str) -> DataFrame:
    """Files whose name time lies in [start, end], and the last one before it."""
    stamped = manifest.withColumn("file_time", F.try_to_timestamp(F.regexp_extract(name, pattern, 1), F.lit(fmt)).cast("timestamp_ntz"))
    lo, hi = F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")
    inside = stamped.filter(F.col("file_time").between(lo, hi))
    before = stamped.filter(F.col("file_time") < lo)
    last = before.agg(F.max_by(F.struct(*stamped.columns), F.struct("file_time", name)).alias("_f"))
    return inside.unionByName(last.filter(F.col("_f").isNotNull()).select("_f.*"))


def read_csv_table(spark: SparkSession, path: str | Sequence[str], schema: str, sep: str = ",") -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a typed delimited table; malformed lines go to the reject table as text."""
    typed = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    header = sep.join(typed.fieldNames())
    lines = spark.read.text(path).filter((F.trim("value") != "") & (F.col("value") != header))
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_reject"}
    parsed = lines.select("value", F.from_csv("value", f"{schema}, _reject string", options).alias("_row"))
    bad = F.col("_row._reject").isNotNull()
    return parsed.filter(~bad).select(*[F.col("_row")[n].alias(n) for n in typed.fieldNames()]), parsed.filter(bad).select("value")


def parse_soundings(texts: DataFrame, text: str = "value", file: str = "file") -> DataFrame:
    """Rows of sounding texts, one text per row of ``texts``.

    The preamble ends with the line "Profile Data:", the block from "Tropopause" on is dropped. The next line names the columns, which
    are separated by single tabs and found by these names in any order; a column that is not there is NULL, and so are
    empty fields and what is no number. Lines whose first field is no number (units, remarks) are no rows. The date comes from the file name
    (yyyymmdd), the time of day from the table.
    """
    body = F.regexp_replace(F.regexp_replace(F.col(text), "\r", ""), r"(?s)^.*?Profile Data:[^\n]*\n", "")
    body = F.regexp_replace(body, r"(?s)\n[^\n]*Tropopause.*$", "")
    lines = texts.select(file, F.split(body, "\n").alias("_lines")).withColumn("_names", F.transform(F.split(F.get("_lines", F.lit(0)), "\t"), lambda x: F.trim(x)))
    lines = lines.select(file, "_names", F.posexplode("_lines").alias("line", "_l")).withColumn("_p", F.split("_l", "\t"))

    def field(name: str) -> Column:
        place = F.array_position("_names", name).cast("int")
        value = F.when(place > 0, F.trim(F.get("_p", place - 1)))
        return F.when(value != "", value)

    number = lambda name: F.nanvl(field(name).try_cast("double"), F.lit(None).cast("double"))
    rows = lines.filter((F.col("line") > 0) & F.trim(F.get("_p", F.lit(0))).try_cast("double").isNotNull())
    named = [(field(n) if c == "time_UTC" else number(n)).alias(c) for n, c in SOUNDING_COLUMNS.items()]
    day = F.regexp_extract(file, r"(\d{8})", 1)
    return rows.select(file, "line", *named).withColumn(
        "time", F.try_to_timestamp(F.concat(day, F.lit(" "), "time_UTC"), F.lit("yyyyMMdd HH:mm:ss")).cast("timestamp_ntz"))


def read_soundings(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """All sounding texts under a path; a text is as large as one ascent, so it is read whole."""
    paths = [path] if isinstance(path, str) else list(path)
    texts = spark.read.text(paths, wholetext=True).withColumn("file", F.col("_metadata.file_name"))
    return parse_soundings(texts)
