"""Reading sensor files: encodings, prefixes, time and number columns, tariffs, prediction banks."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slotwise.functions import time as t
from slotwise.sources import workbook

ENCODINGS = workbook.ENCODINGS
#: File prefixes and names of time columns.
PREFIXES = ("", "Pre_", "Pre_test_")
TIME_NAMES = ("datetime", "timestamp", "time", "date", "时间", "日期", "datatime", "collecttime", "recordtime")


def encoding_of(spark: SparkSession, path: str) -> str:
    """The first accepted encoding in which all lines under path decode strictly. Files are split into lines (no encoding's characters hold a line feed), and only lines that are no UTF-8 are looked at twice."""
    lines = spark.read.text(path)
    odd = lines.where(~F.is_valid_utf8("value")).select(F.col("value").cast("binary").alias("line"))
    if odd.isEmpty():
        return "utf-8"

    @F.udf("boolean")
    def fits(line: bytes) -> bool:
        try:
            line.decode("gb18030")
            return True
        except UnicodeDecodeError:
            return False

    if odd.where(~fits("line")).isEmpty():
        return "gb18030"
    raise ValueError(f"{path}: none of {', '.join(ENCODINGS)} fits")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, in the first encoding that fits; a byte order mark is taken off the header."""
    encoding = encoding_of(spark, path)
    if encoding == "gb18030":  # beyond the charsets that Spark allows by default
        spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    df = spark.read.csv(path, header=True, encoding={"gb18030": "GB18030"}.get(encoding, encoding))
    return df.toDF(*[c.lstrip("\ufeff").strip() for c in df.columns])


def list_files(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark knows."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []


def discover(spark: SparkSession, folder: str, names: Iterable[str] = ("gas", "gas_holder", "gas_user", "load"), required: Iterable[str] = ("load",)) -> dict[str, str]:
    """Path of each source; more than one prefix for a name, or a missing required one, is an error."""
    there = set(list_files(spark, folder))
    found: dict[str, str] = {}
    for name in names:
        hits = [f"{p}{name}.csv" for p in PREFIXES if f"{p}{name}.csv" in there]
        if len(hits) > 1:
            raise ValueError(f"{name}: several files: {', '.join(hits)}")
        if hits:
            found[name] = f"{folder}/{hits[0]}"
        elif name in required:
            raise FileNotFoundError(f"{name}.csv")
    return found


def time_column(columns: list[str]) -> str:
    """The first column whose name, without case and punctuation, is a time name, else the first of all."""
    return next((c for c in columns if re.sub(r"[\W_]+", "", c).lower() in TIME_NAMES), columns[0])


def parse_time(df: DataFrame, column: str, out: str = "ts") -> DataFrame:
    """Text timestamps, or numbers since 1970 in the unit that puts at least half of the rows in the years 2000 to 2100."""
    text = F.col(f"`{column}`").cast("string")
    as_text = F.coalesce(F.try_to_timestamp(text), F.try_to_timestamp(text, F.lit("yyyy/M/d H:mm")), F.try_to_timestamp(text, F.lit("yyyy/M/d H:mm:ss"))).cast("timestamp_ntz")
    number = text.try_cast("double")
    units = {"s": 1e6, "ms": 1e3, "us": 1.0, "ns": 1e-3}
    low, high = 946_684_800e6, 4_102_444_800e6
    row = df.agg(F.count_if(number.isNotNull()).alias("n"), F.count(text).alias("all"), *[F.count_if((number * u).between(low, high)).alias(k) for k, u in units.items()]).first()
    if row["n"] * 2 > row["all"]:
        unit = next((k for k in units if row[k] * 2 >= row["n"]), None)
        if unit is None:
            raise ValueError(f"{column}: numbers are no plausible times")
        return df.withColumn(out, t.from_micros((number * units[unit]).cast("long")))
    return df.withColumn(out, as_text)


def parse_numbers(df: DataFrame, columns: list[str]) -> tuple[DataFrame, list[str]]:
    """Columns as doubles; one that has text but no number goes, one that is all null stays."""
    number = lambda c: F.col(f"`{c}`").cast("string").try_cast("double")
    row = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"t{i}") for i, c in enumerate(columns)], *[F.count(number(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    kept = [c for i, c in enumerate(columns) if row[f"n{i}"] or not row[f"t{i}"]]
    others = [c for c in df.columns if c not in columns]
    finite = lambda c: F.when(~F.isnan(number(c)) & (F.abs(number(c)) != float("inf")), number(c))
    return df.select(*[F.col(f"`{c}`") for c in others], *[finite(c).alias(c) for c in kept]), kept


def observations(spark: SparkSession, path: str) -> DataFrame:
    """Long rows series, ts, value of a wide sensor file."""
    raw = read_csv(spark, path)
    at = time_column(raw.columns)
    typed, kept = parse_numbers(parse_time(raw, at), [c for c in raw.columns if c != at])
    return typed.unpivot(["ts"], kept, "series", "value").where("ts is not null")


def sensor_roles(names: DataFrame, name: str = "series") -> DataFrame:
    """Gas and role of each sensor from its name."""
    n = F.lower(F.col(name))
    has = lambda *words: F.greatest(*[n.contains(w) for w in words], F.lit(False))
    # fixed values: short names of the gases, and heaters that burn blast furnace gas
    gas = F.when(n.startswith("air_heater_") | has("blast") | n.rlike("(^|_)bf(g|_)"), "blast_furnace").when(has("coke") | n.rlike("(^|_)co(g|_)"), "coke").when(has("converter") | n.rlike("(^|_)ldg($|_)"), "converter").when(has("mixed"), "mixed")
    role: Column = F.when(has("generator_use") | has("generator") & has("gas"), "generator").when(has("holder", "gasometer"), "holder").when(has("mixed") & has("into"), "mixed_in")
    role = role.when(has("user", "heater", "consume"), "user").when(n.rlike(r"(blast_furnace|coke_oven|converter)_\d+$") | has("produce", "generation", "output", "supply"), "production")
    return names.withColumns({"gas": gas, "role": F.when(gas.isNotNull(), F.coalesce(role, F.lit("other"))).otherwise(F.lit("other"))})


def read_tariff(spark: SparkSession, path: str) -> DataFrame:
    """Rows month, step, price (see dispatch.price_table) of a tariff: Parquet with these columns or with step and a column a month; else the
    tables of a workbook, or of the CSV files there, as workbook.monthly_prices reads them."""
    if not path.rstrip("/").endswith(".parquet"):
        prices = workbook.monthly_prices(workbook.read_tables(spark, path))
        return spark.createDataFrame([(m, i, x) for m, values in sorted(prices.items()) for i, x in enumerate(values)], "month int, step int, price double")
    df = spark.read.parquet(path)
    if {"month", "step", "price"} <= set(df.columns):
        return df.select(F.col("month").cast("int"), F.col("step").cast("int"), F.col("price").cast("double"))
    months = {c: m for c in df.columns if (m := workbook.month_of(c))}
    if not months or "step" not in df.columns:
        raise ValueError("a tariff needs month, step and price, or step and a column for each month")
    long = df.unpivot(["step"], list(months), "_c", "price")
    names = F.create_map(*[F.lit(x) for pair in months.items() for x in pair])
    return long.select(names[F.col("_c")].alias("month"), F.col("step").cast("int"), F.col("price").cast("double"))


def read_origins(spark: SparkSession, path: str) -> DataFrame:
    raw = read_csv(spark, path)
    return parse_time(raw, time_column(raw.columns), "b").select("b").where("b is not null").distinct().orderBy("b")


def read_bank(spark: SparkSession, path: str) -> DataFrame:
    """Member predictions in JSON lines, gzip or not: series, b, h, member, p."""
    return spark.read.schema("series string, b timestamp_ntz, h int, member string, p double").json(path)


def read_bank_document(spark: SparkSession, path: str, minutes: int = 15) -> DataFrame:
    """Member predictions from JSON documents, gzip or not, that hold the origins and per member the values of each <target>_t+<minutes>_pred."""
    kind = "origins array<string>, members map<string, map<string, array<double>>>"
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("d")).select("d.origins", F.explode("d.members").alias("member", "_m"))
    d = d.select("origins", "member", F.explode("_m").alias("_k", "_v")).select("member", "_k", F.explode(F.arrays_zip(F.col("origins").alias("o"), F.col("_v").alias("p"))).alias("x"))
    h = (F.regexp_extract("_k", r"(\d+)_pred$", 1).cast("int") / minutes).cast("int")
    return d.select(F.regexp_extract("_k", r"^(.*)_t\+", 1).alias("series"), F.to_timestamp_ntz(F.col("x")["o"]).alias("b"), h.alias("h"), "member", F.col("x")["p"].alias("p"))


def find_dataset(spark: SparkSession, root: str, name: str = "Pre_load.csv") -> str:
    """The only folder below root that holds a file of this name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", name).load(root).select("path").collect()
    if len(files) != 1:
        raise ValueError(f"{len(files)} files named {name} below {root}")
    return files[0]["path"].rsplit("/", 1)[0]


def schema_of(spark: SparkSession, path: str) -> list[str]:
    """Column names alone; no row is read."""
    return (spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.csv(path, header=True)).columns
