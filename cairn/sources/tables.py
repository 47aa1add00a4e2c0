"""Text sources: CSV by the catalogue's rules, and the text cache of project summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.hashing import parse_hash


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings. Doubled quotes are quotes, leading space goes, blank lines are skipped, a row of another
    length is an error. Where a cell of the first line is a content hash there is no header, and columns are
    named "Column #i"."""
    options = {"escape": '"', "quote": '"', "ignoreLeadingWhiteSpace": True, "mode": "FAILFAST", "inferSchema": False}
    first = spark.read.options(**options).csv(path, header=False).limit(1)
    cells = [F.coalesce(F.col(c), F.lit("")) for c in first.columns]
    row = first.select(F.array(*cells).alias("cells"), F.exists(F.array(*cells), lambda x: parse_hash(x).isNotNull()).alias("hashed")).head()
    if row is None:
        return spark.createDataFrame([], T.StructType())
    names = [f"Column #{i}" for i in range(len(row["cells"]))] if row["hashed"] else row["cells"]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.options(**options).schema(schema).csv(path, header=not row["hashed"], enforceSchema=True)


def download_list(rows: DataFrame) -> DataFrame:
    """hash, passphrase, pattern and folder of each row of a CSV that names data sets.

    Columns are found by what their names contain (pass, hash, regex, subdir, in this order; of several the last). Rows whose cell is no
    hash are left out; without a hash column this is an error.
    """
    found: dict[str, str] = {}
    for c in rows.columns:
        for part in ("pass", "hash", "regex", "subdir"):
            if part in c.lower():
                found[part] = c
                break
    if "hash" not in found:
        raise ValueError("no hash column")
    cell = lambda part: F.nullif(F.trim(F.col(f"`{found[part]}`")), F.lit("")) if part in found else F.lit(None).cast("string")
    bare = F.trim(F.regexp_replace(F.col(f"`{found['hash']}`"), "^[\"']|[\"']$", ""))
    out = rows.select(parse_hash(bare).alias("hash"), cell("pass").alias("passphrase"), cell("regex").alias("pattern"), cell("subdir").alias("folder"))
    return out.where("hash IS NOT NULL")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("escape", '"').option("header", True).csv(path)


# Labels of the summary cache's lines.
_TEXT = {"title": "TITLE", "description": "DESC", "uploader": "SIGS", "hash": "HASH", "old_version": "OLD", "new_version": "NEW", "type": "TYPE"}
_NUMBERS = {"size": "SIZE", "files": "FILES", "uploaded": "DATE"}


def read_project_cache(spark: SparkSession, path: str) -> DataFrame:
    """Project summaries from text: records between lines that begin with ----- or PROJECT, a labelled value on each line.

    A cache file is one summary of all projects, read whole.
    """
    whole = spark.read.text(path, wholetext=True)
    records = whole.select(F.explode(F.split("value", r"(?m)^(?:-----|PROJECT).*$")).alias("value")).where(F.col("value").contains("HASH: "))
    value = lambda label: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{label}: (.*)$", 1)), F.lit(""))
    crypt = F.lower(F.coalesce(value("ENCRYPTED"), F.lit("")))
    return records.select(
        *[value(label).alias(name) for name, label in _TEXT.items()],
        *[F.coalesce(value(label).try_cast("long"), F.lit(0)).alias(name) for name, label in _NUMBERS.items()],
        (crypt.contains("true") | crypt.contains("published")).alias("encrypted"),
        crypt.contains("published").alias("published"),
        F.lower(F.coalesce(value("DELETED"), F.lit(""))).contains("true").alias("hidden"),
        F.lower(F.coalesce(value("SHARE"), F.lit(""))).contains("true").alias("share"),
    ).withColumns({"title": F.coalesce("title", F.lit("?")), "description": F.coalesce(F.replace("description", F.lit("\\n"), F.lit("\n")), F.lit(""))})
