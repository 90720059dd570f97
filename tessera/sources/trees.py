"""Text trees for scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders that no scan enters, and suffixes that it reads.
SKIPPED = (".git", ".venv", "venv", "node_modules", "__pycache__", ".pytest_cache", ".mypy_cache", "dist", "build", ".idea", ".vscode", "logs")
SUFFIXES = ("md", "txt", "py", "json", "yaml", "yml", "toml", "sql", "sh", "ps1", "js", "ts", "html", "css", "cfg", "ini", "env")


def text_tree(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text) of the text files under a folder."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").text(folder, wholetext=True)
    skip = r"/(?:" + "|".join(s.replace(".", r"\.") for s in SKIPPED) + r")/"
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(~F.rlike("path", F.lit(skip)))
