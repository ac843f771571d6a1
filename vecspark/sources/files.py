"""Folders of text files as documents."""

from __future__ import annotations

import os
import shutil
import urllib.request
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.functions import text

#: Known datasets and where they can be had (fixed public address).
DATASETS = {"bbc": "http://mlg.ucd.ie/files/datasets/bbc-fulltext.zip"}


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(name, content, metadata, created_at, updated_at): one row per file
    below ``path``; the file's name, its stripped text, and its size in
    characters.  Files are read whole and in parallel."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(
        F.col("value"), F.col("_metadata.file_name").alias("name"),
        F.unix_timestamp(F.col("_metadata.file_modification_time")).alias("at"), F.col("_metadata.file_path").alias("file"),
    )
    content = text.strip(F.col("value"))
    return raw.select(
        "name", content.alias("content"),
        F.to_json(F.struct(F.col("file"), F.length(content).alias("content_length"))).alias("metadata"),
        F.col("at").alias("created_at"), F.col("at").alias("updated_at"),
    )


def download_dataset(name: str, folder: str, *, overwrite: bool = False) -> str:
    """Fetch and unpack a known dataset on the driver; returns its folder."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {sorted(DATASETS)}")
    target = os.path.join(folder, name)
    if os.path.isdir(target):
        if not overwrite:
            return target
        shutil.rmtree(target)
    os.makedirs(folder, exist_ok=True)
    archive = os.path.join(folder, f"{name}.zip")
    with urllib.request.urlopen(DATASETS[name]) as response, open(archive, "wb") as out:
        shutil.copyfileobj(response, out)
    return unpack(archive, target)


def unpack(archive: str, target: str) -> str:
    """Unpack a zip; members that would leave the folder are an error."""
    root = os.path.realpath(target)
    with zipfile.ZipFile(archive) as z:
        for member in z.namelist():
            if not os.path.realpath(os.path.join(root, member)).startswith(root + os.sep):
                raise ValueError(f"unsafe path in archive: {member!r}")
        z.extractall(root)
    return target
