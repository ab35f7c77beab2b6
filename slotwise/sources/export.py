"""Writing results: tables whose files appear at once, split JSON, archives of two files, manifests."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"


def formatted(df: DataFrame, decimals: int | None = 6) -> DataFrame:
    """Times as text, doubles with fixed decimals (None: the shortest form that reads back the same)."""
    out = []
    for f in df.schema:
        c, kind = F.col(f"`{f.name}`"), f.dataType.simpleString()
        if kind in ("timestamp", "timestamp_ntz"):
            c = F.date_format(c, TIME_FORMAT)
        elif kind in ("double", "float") and decimals is not None:
            c = F.format_string(f"%.{decimals}f", c)
        out.append(c.alias(f.name))
    return df.select(*out)


def wide_predictions(predictions: DataFrame, targets: list[str], steps: list[int], minutes: int = 15) -> DataFrame:
    """datetime and a column <target>_t+<minutes>_pred for each target and step."""
    key = F.concat(F.col("series"), F.lit("_t+"), (F.col("h") * minutes).cast("string"), F.lit("_pred"))
    names = [f"{s}_t+{h * minutes}_pred" for s in targets for h in steps]
    return predictions.where(F.col("h").isin(steps)).withColumn("_k", key).groupBy(F.col("b").alias("datetime")).pivot("_k", names).agg(F.first("p")).orderBy("datetime")


def split_results(predictions: DataFrame, targets: list[str], short: list[int], long: list[int], minutes: int = 15) -> tuple[DataFrame, DataFrame]:
    """The wide tables of the short and of the long horizons."""
    return wide_predictions(predictions, targets, short, minutes), wide_predictions(predictions, targets, long, minutes)


def write_folder(df: DataFrame, path: str, kind: str = "csv") -> None:
    """Written beside the target and renamed, so that readers see all of it or nothing; an existing target is an error."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(to):
        raise FileExistsError(path)
    part = f"{path}.part"
    getattr(df.write.mode("overwrite").option("header", True) if kind == "csv" else df.write.mode("overwrite"), kind)(part)
    if not fs.rename(jvm.org.apache.hadoop.fs.Path(part), to):
        raise OSError(f"{part} was not renamed")


def _replace(path: str | Path, data: bytes) -> None:
    path = Path(path)
    fd, part = tempfile.mkstemp(dir=path.parent)
    with os.fdopen(fd, "wb") as f:
        f.write(data)
    os.replace(part, path)


def split_json(df: DataFrame, limit: int = 100_000) -> str:
    """{columns, data} of a small result; more than `limit` rows are an error, not cut."""
    rows = formatted(df, None).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    return json.dumps({"columns": df.columns, "data": [list(r) for r in rows]}, ensure_ascii=False)


def write_json(path: str | Path, value: object) -> None:
    _replace(path, json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True).encode())


def write_archive(path: str | Path, files: dict[str, bytes]) -> None:
    """A ZIP of exactly these files with fixed times, checked after writing."""
    part = f"{path}.part"
    with zipfile.ZipFile(part, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(files):
            z.writestr(zipfile.ZipInfo(name, (2020, 1, 1, 0, 0, 0)), files[name], zipfile.ZIP_DEFLATED)
    with zipfile.ZipFile(part) as z:
        if z.testzip() is not None or sorted(z.namelist()) != sorted(files):
            raise ValueError("the archive is not what was written")
    os.replace(part, path)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """name, bytes, sha256 of all files below a folder, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(found: DataFrame, stated: DataFrame) -> DataFrame:
    """Rows that are missing, added or changed."""
    x = found.alias("f").join(stated.alias("s"), "name", "full_outer")
    status = F.when(F.col("f.sha256").isNull(), "missing").when(F.col("s.sha256").isNull(), "added").when(~((F.col("f.sha256") == F.col("s.sha256")) & (F.col("f.bytes") == F.col("s.bytes"))), "changed")
    return x.select("name", status.alias("status")).where("status is not null")


def fingerprint(settings: dict, inputs: str) -> str:
    """Key of a cached table: settings and the content hash of its inputs."""
    return hashlib.sha256(json.dumps([settings, inputs], sort_keys=True).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, key: str, make) -> DataFrame:
    """The table under folder/key, made and written first where it isn't there."""
    path = f"{folder}/{key}"
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(to):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_bank_document(predictions: DataFrame, path: str, minutes: int = 15) -> None:
    """Member predictions as one gzip JSON document, as tables.read_bank_document reads it: origins, and per member the values of each
    target and step in their order. A document is one row of one task, so a bank is as small as members x targets x steps x origins are."""
    key = F.concat(F.col("series"), F.lit("_t+"), (F.col("h") * minutes).cast("string"), F.lit("_pred"))
    origins = predictions.select("b").distinct().agg(F.sort_array(F.collect_list("b")).alias("_o"))
    cells = predictions.groupBy("member", key.alias("_k")).agg(F.map_from_entries(F.collect_list(F.struct("b", "p"))).alias("_v"))
    aligned = cells.join(F.broadcast(origins)).select("member", "_k", F.transform("_o", lambda o: F.col("_v")[o]).alias("_v"))  # one row on the right
    each = aligned.groupBy("member").agg(F.map_from_entries(F.collect_list(F.struct("_k", "_v"))).alias("_m"))
    members = each.agg(F.map_from_entries(F.collect_list(F.struct("member", "_m"))).alias("members"))
    times = F.transform("_o", lambda o: F.date_format(o, "yyyy-MM-dd HH:mm:ss")).alias("origins")
    members.join(F.broadcast(origins)).select(F.to_json(F.struct(times, "members"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1).write.text(path, compression="gzip")


def write_bank(predictions: DataFrame, path: str) -> None:
    """Member predictions as gzip JSON lines, as tables.read_bank reads them."""
    predictions.select("series", "b", "h", "member", "p").write.json(path, compression="gzip")
