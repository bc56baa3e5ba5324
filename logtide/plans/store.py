"""The store that search works on: logs, templates, incident and files as Parquet, with a manifest.

It is written to a new folder that becomes current by renaming the manifest, so a reader
sees the old store or the new one.  The manifest has the schema's version and a stamp of the
inputs; a store with the same stamp isn't built again.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.functions.text import line_id

VERSION = 1
MANIFEST = "store.json"
TABLES = ("logs", "templates", "incident", "files")


class StoreError(ValueError):
    """The store is missing or of another version."""


def stamp(paths: Sequence[str], settings: object = None, spark: SparkSession | None = None) -> list[str]:
    """Name, size and time of change of each input, and a digest of the settings."""
    out = []
    for p in sorted(paths):
        if "://" in p:
            at = spark._jvm.org.apache.hadoop.fs.Path(p)
            s = at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at)
            out.append(f"{p}:{s.getLen()}:{s.getModificationTime()}")
        else:
            s = os.stat(p)
            out.append(f"{p}:{s.st_size}:{s.st_mtime_ns}")
    return out if settings is None else [*out, hashlib.sha256(repr(settings).encode()).hexdigest()]


def logs_table(records: DataFrame, templates: DataFrame) -> DataFrame:
    """Records (with seq and template_id) joined to what templates say of noise; extra lines as one text."""
    noisy = templates.select("template_id", F.col("noise_reason").isNotNull().alias("noise"))
    return records.join(noisy, "template_id", "left").select(
        "seq",
        line_id(F.col("file"), F.col("lineno")).alias("line_id"),
        "file",
        "alias",
        F.col("lineno").cast("int").alias("lineno"),
        "ts",
        "level",
        F.col("severity").cast("byte").alias("severity"),
        "component",
        "template_id",
        F.coalesce("noise", F.lit(False)).alias("noise"),
        "message",
        F.when(F.size("extra") > 0, F.array_join("extra", "\n")).alias("extra"),
        (F.size("extra") + F.col("extra_dropped")).cast("int").alias("extra_lines"),
    )


def build(folder: str, tables: dict[str, DataFrame], made_of: Sequence[str] = (), about: dict | None = None) -> dict:
    """Write the tables and the manifest.  Logs are sorted by time inside their files, so that filters on ts skip row groups.

    Executors write to the folder, so on a cluster it must be one that they share with the
    driver, such as a mount; ``spark.logtide.sharedFolders`` says which folders are, by commas.
    """
    spark = tables["logs"].sparkSession
    root = Path(folder).resolve()
    shared = [Path(p.strip()) for p in spark.conf.get("spark.logtide.sharedFolders", "").split(",") if p.strip()]
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) and not any(root.is_relative_to(p) for p in shared):
        raise StoreError(f"{folder} isn't in a folder that driver and executors share; spark.logtide.sharedFolders names these")
    root.mkdir(parents=True, exist_ok=True)
    data = f"store-{uuid.uuid4().hex}"
    for name in TABLES:
        df = tables[name]
        if name == "logs":
            df = df.repartitionByRange("ts", "seq").sortWithinPartitions("ts", "seq")
        df.write.parquet(f"file://{root.resolve()}/{data}/{name}")
    manifest = {"version": VERSION, "data": data, "stamp": list(made_of), "built": datetime.now().isoformat(timespec="seconds"), "about": about or {}}
    temporary = root / f".{MANIFEST}.{uuid.uuid4().hex}"
    temporary.write_text(json.dumps(manifest, indent=1))
    os.replace(temporary, root / MANIFEST)
    return manifest


def manifest(folder: str) -> dict:
    path = Path(folder) / MANIFEST
    if not path.is_file():
        raise StoreError(f"no store in {folder}")
    found = json.loads(path.read_text())
    if found.get("version") != VERSION:
        raise StoreError(f"the store's version is {found.get('version')}, not {VERSION}")
    return found


def is_fresh(folder: str, made_of: Sequence[str]) -> bool:
    """Whether the store is there, of this version, and made of what the stamp says."""
    try:
        return bool(made_of) and manifest(folder)["stamp"] == list(made_of)
    except (StoreError, OSError):
        return False


def opened(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the current store."""
    data = Path(folder).resolve() / manifest(folder)["data"]
    return {name: spark.read.parquet(f"file://{data}/{name}") for name in TABLES}


def export_records(logs: DataFrame, path: str) -> None:
    """Records as gzipped JSON lines in order of time, the hand-over format; one folder of part files, sorted across them."""
    columns = ["seq", "file", "alias", "lineno", "ts", "level", "severity", "component", "template_id", "message", "extra", "extra_lines"]
    logs.select(columns).orderBy("ts", "seq").write.option("compression", "gzip").option("ignoreNullFields", "false").option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(path)


def import_records(spark: SparkSession, path: str) -> DataFrame:
    """What export_records wrote, with its fixed schema."""
    schema = "seq long, file string, alias string, lineno int, ts timestamp_ntz, level string, severity byte, component string, template_id string, message string, extra string, extra_lines int"
    return spark.read.schema(schema).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").json(path)
