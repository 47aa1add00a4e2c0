"""Metadata of uploads and summaries of projects.

An upload is a row with a hash, its uploader (user, ts, path), encodings (name, hash, passphrase in the order they were applied), properties (a map
of strings) and annotations (name, value).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..scratch import written

# Names of encodings.
PLAIN, ENCRYPTED = "None", "AES"
#: Kinds of properties and how their text is read.
TYPES = {"string": "string", "long": "bigint", "int": "int", "boolean": "boolean"}
#: Sort keys of a project table; text is compared without case.
SORT_KEYS = {"title": "text", "encrypted": "value", "hidden": "value", "size": "value", "files": "value", "uploaded": "value", "uploader": "text"}


def data_hash(encodings: Column) -> Column:
    """The hash of the data itself: that of the encoding named None."""
    return F.get(F.filter(encodings, lambda e: e["name"] == PLAIN), F.lit(0))["hash"]


def stored_hash(encodings: Column) -> Column:
    """The hash of what is stored: that of the last encoding."""
    return F.when(F.size(encodings) > 0, F.element_at(encodings, -1)["hash"])


def is_encrypted(encodings: Column) -> Column:
    return F.exists(encodings, lambda e: e["name"] == ENCRYPTED)


def is_published(encodings: Column) -> Column:
    """Encrypted with a passphrase that anyone may read."""
    return F.exists(encodings, lambda e: (e["name"] == ENCRYPTED) & e["passphrase"].isNotNull())


def is_shareable(encodings: Column) -> Column:
    """Not encrypted, or published."""
    return ~is_encrypted(encodings) | is_published(encodings)


def with_passphrase(encodings: Column, passphrase: Column) -> Column:
    """Encodings with the passphrase published; null leaves them as they are."""
    return F.transform(encodings, lambda e: F.when((e["name"] == ENCRYPTED) & passphrase.isNotNull(), e.withField("passphrase", passphrase)).otherwise(e))


def property_of(properties: Column, name: str, kind: str = "string", default=None) -> Column:
    """A property read as its kind; the default where it is missing or does not parse."""
    return F.coalesce(F.try_element_at(properties, F.lit(name)).try_cast(TYPES[kind]), F.lit(default).cast(TYPES[kind]))


def annotation_values(annotations: Column, name: str) -> Column:
    """All values of annotations of a name, in order."""
    return F.transform(F.filter(annotations, lambda a: a["name"] == name), lambda a: a["value"])


def padded_length(length: Column, padding: Column) -> Column:
    """Bytes of content without the padding that encryption added."""
    return length - F.coalesce(padding, F.lit(0))


def relative_name(root: Column, file: Column, root_is_directory: Column) -> Column:
    """A file's name in an upload of root: below root's own name; a single file goes under a folder of its name."""
    base = lambda p: F.substring_index(p, "/", -1)
    below = F.replace(F.substring(file, F.length(root) + 2, F.length(file)), F.lit("\\"), F.lit("/"))
    return F.when(~root_is_directory, F.concat_ws("/", base(root), base(file))).when(root == file, base(file)).otherwise(F.concat_ws("/", base(root), below))


def sticky_servers(uploads: DataFrame) -> DataFrame:
    """hash and servers: the distinct sticky servers of all uploaders, sorted."""
    return uploads.select("hash", F.explode("sticky").alias("s")).groupBy("hash").agg(F.array_sort(F.collect_set("s")).alias("servers"))


def pattern_of(names: DataFrame, by: str, name: str = "name") -> DataFrame:
    """by and pattern: a regular expression that matches exactly the names of each group. For many names use a join instead."""
    special = r"([\\.\[\]{}()*+?^$|])"
    quoted = F.concat(F.lit("^"), F.regexp_replace(name, special, r"\\$1"), F.lit("$"))
    return names.groupBy(by).agg(F.array_join(F.array_sort(F.collect_set(quoted)), "|").alias("pattern"))


def matching(names: DataFrame, pattern: str = ".", name: str = "name") -> DataFrame:
    """Rows whose name has a match of the pattern anywhere, both lower-cased."""
    return names.where(F.lower(F.col(name)).rlike(pattern.lower()))


def summaries(uploads: DataFrame) -> DataFrame:
    """A summary of each upload: of the data set where it is a project file, else of the single file."""
    project = F.col("is_project")
    kept = lambda c, other: F.when(project, F.col(c)).otherwise(other)
    return uploads.select(
        "hash",
        kept("data_set_name", F.col("name")).alias("title"),
        kept("data_set_description", F.lit(None)).alias("description"),
        kept("data_set_size", F.col("length")).cast("long").alias("size"),
        kept("data_set_files", F.lit(1)).cast("long").alias("files"),
        F.col("ts").alias("uploaded"),
        F.col("user").alias("uploader"),
        is_encrypted(F.col("encodings")).alias("encrypted"),
        is_published(F.col("encodings")).alias("published"),
        "hidden",
    )


def with_project_files(summary: DataFrame, parts: DataFrame, projects: DataFrame) -> DataFrame:
    """Summaries with what project files (hash, name, description) and their parts (hash, length, padding) say: counts and sizes always, texts
    where the summary has none."""
    totals = parts.groupBy("hash").agg(F.count("*").alias("_files"), F.sum(padded_length(F.col("length"), F.col("padding"))).alias("_size"))
    own = projects.select("hash", F.col("name").alias("_name"), F.col("description").alias("_description"), F.lit(True).alias("_parsed")).join(totals, "hash", "left")
    j = summary.join(own, "hash", "left")
    parsed = F.coalesce("_parsed", F.lit(False))
    return j.withColumns(
        {
            "files": F.when(parsed, F.coalesce("_files", F.lit(0))).otherwise(F.col("files")),
            "size": F.when(parsed, F.coalesce("_size", F.lit(0))).otherwise(F.col("size")).cast("long"),
            "title": F.coalesce(F.nullif("title", F.lit("")), F.when(parsed, F.col("_name")), F.col("title")),
            "description": F.coalesce(F.nullif("description", F.lit("")), F.when(parsed, F.col("_description")), F.col("description")),
        }
    ).drop("_files", "_size", "_name", "_description", "_parsed")


def project_sizes(files: DataFrame, by: str, length: Column, padding: Column) -> DataFrame:
    """Per project: bytes without padding, as an exact sum (0 of nothing), and how many files."""
    own = padded_length(length, padding).cast("decimal(20,0)")
    return files.groupBy(by).agg(F.coalesce(F.sum(own), F.lit(0)).cast("decimal(38,0)").alias("size"), F.count("*").alias("files"))


def distinct_hashes(files: DataFrame, by: str) -> DataFrame:
    """Per group, how many different hashes there are."""
    return files.groupBy(by).agg(F.count_distinct("hash").alias("n"))


def sorted_parts(files: DataFrame, by: str, name: str = "name") -> DataFrame:
    """Files with n, their place in their project by name."""
    return files.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(name)).cast("long"))


def shown(summary: DataFrame) -> DataFrame:
    """What a table shows: size and date as text (none of an encrypted, unpublished project) and its state."""
    closed = F.col("encrypted") & ~F.col("published")
    return summary.select(
        "hash",
        "title",
        F.when(closed, "").otherwise(F.col("size").cast("string")).alias("size_shown"),
        F.when(closed, "").otherwise(F.date_format(F.timestamp_millis("uploaded"), "yyyy-MM-dd")).alias("date_shown"),
        F.when(closed, "encrypted").when(F.col("encrypted"), "published").otherwise("open").alias("state"),
    )


def browse(summary: DataFrame, pattern: str = ".", user: str | None = None) -> DataFrame:
    """Projects whose title (without case) or hash has a match; hidden ones only for their uploader."""
    found = F.lower("title").rlike(pattern.lower()) | F.col("hash").rlike(pattern)
    return summary.where(found & (~F.col("hidden") | (F.col("uploader") == F.lit(user))))


def sort_columns(key: str, descending: bool = False) -> list[Column]:
    """Order of a project table by one of SORT_KEYS; ties by hash."""
    value = F.lower(key) if SORT_KEYS[key] == "text" else F.col(key)
    return [value.desc_nulls_last() if descending else value.asc_nulls_first(), F.col("hash")]


def numbered(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """rows with their number, from 1, in a total order: sorted by ranges over all tasks, then counted range by range."""
    ranges = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # Written once, as ranges are drawn from a sample; a row's id has its range in the high bits.
    dealt = written(rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33)
    counts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    counts = counts.select("_part", F.expr("sum(_n) OVER (ORDER BY _part) - _n").alias("_before"))  # one row for each range
    own = dealt.withColumn("_part", part).join(F.broadcast(counts), "_part")
    return own.withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_before")


def download(projects: DataFrame, uploads: DataFrame, parts: DataFrame, stored: DataFrame) -> DataFrame:
    """Files of projects put together: project, name, hash, text, n_chunks and valid.

    projects (project, name, hash) name files; uploads say which encoding is the data; parts (hash, pos, chunk_hash) list a file's chunks in order,
    stored has their bytes. A file whose metadata or chunks are missing has a null text.
    """
    from ..functions.hashing import content_hash

    one = uploads.groupBy("hash").agg(F.first(data_hash(F.col("encodings"))).alias("data"))
    named = projects.join(one, "hash", "left")
    chunks = parts.join(stored.select(F.col("hash").alias("chunk_hash"), "chunk"), "chunk_hash", "left")
    put = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "chunk"))), lambda x: x["chunk"]), "")
    whole = chunks.groupBy(F.col("hash").alias("data")).agg(F.when(F.count("*") == F.count("chunk"), put).alias("text"), F.count("*").alias("n_chunks"))
    out = named.join(whole, "data", "left").select("project", "name", "hash", "text", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
    return out.withColumn("valid", F.coalesce(content_hash(F.col("text")) == F.col("hash"), F.lit(False)))


def files_to_write(files: DataFrame, present: DataFrame) -> DataFrame:
    """Files (name, hash and content) that a folder does not have yet with the same hash; present: name and hash of what is there."""
    return files.join(present.select("name", "hash").distinct(), ["name", "hash"], "left_anti")
