"""The content-addressed domain laid over the sample tables, in Spark and as DuckDB WITH clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import content_hash, prefix


#: Rows of line items in one task.
TASK_ROWS = 1 << 19


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    name = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return d.select("doc_id", name.alias("name"), F.col("source").alias("project"), F.col("lang").alias("user"), text.alias("text"), content_hash(text).alias("hash"))


def activity(spark: SparkSession, sf: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """The log; with a range in epoch millis, only what may lie in it is read (the bounds reach the Parquet scan)."""
    e = table(spark, sf, "events")
    if start is not None:
        at = lambda ms: F.timestamp_millis(F.lit(ms)).cast(e.schema["ts"].dataType)
        e = e.where((F.col("ts") >= at(start)) & (F.col("ts") < at(end + 1)))
    action = F.expr("CASE event_type WHEN 'signup' THEN 33 WHEN 'view' THEN 34 WHEN 'error' THEN 65 WHEN 'click' THEN 66 ELSE 50 END")
    hash_ = content_hash(F.col("event_id").cast("string"))
    return e.select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), action.alias("action"), "user_id", hash_.alias("hash")).withColumn("place", prefix(F.col("hash")))


def servers(spark: SparkSession, sf: str) -> DataFrame:
    s, n = table(spark, sf, "supplier"), table(spark, sf, "nation")
    k = F.col("s_suppkey")
    first, tfirst = F.pmod(k * 37, F.lit(256)).cast("int"), F.pmod(k * 53, F.lit(256)).cast("int")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey"), "left").select(
        k.alias("suppkey"), F.col("s_name").alias("host"), F.col("n_name").alias("grp"),
        F.greatest(F.floor("s_acctbal"), F.lit(1)).cast("long").alias("capacity"),
        (k % 3 != 0).alias("is_core"), (k % 7 != 0).alias("is_online"), (k % 5 != 0).alias("is_readable"), (k % 4 != 0).alias("is_writable"),
        (k % 11).alias("outstanding"), first.alias("first"), F.least(first + 40, F.lit(255)).alias("last"),
        tfirst.alias("tfirst"), F.least(tfirst + 30, F.lit(255)).alias("tlast"), F.pmod(k * 13, F.lit(32)).cast("int").alias("flags"),
    )


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    """Uploads: some zipped, some encrypted, some of them published; some are project files."""
    f, k = files(spark, sf), F.col("doc_id")
    of = lambda letter: content_hash(F.concat(F.lit(letter), k.cast("string")))
    step = lambda name, hash_, phrase=None: F.struct(F.lit(name).alias("name"), hash_.alias("hash"), (F.lit(None) if phrase is None else phrase).cast("string").alias("passphrase"))
    none = F.array().cast("array<struct<name:string,hash:string,passphrase:string>>")
    encodings = F.concat(
        F.array(step("None", F.col("hash"))), F.when(k % 2 == 0, F.array(step("GZIP", of("z")))).otherwise(none),
        F.when(k % 4 == 0, F.array(step("AES", of("a"), F.when(k % 12 == 0, "secret")))).otherwise(none),
    )
    length = F.octet_length("text").cast("long")
    return f.select(
        "doc_id", "hash", "user", (k % 5).alias("ts"), F.col("project").alias("path"), "name", length.alias("length"), encodings.alias("encodings"),
        (k % 7 == 0).alias("hidden"), (k % 6 == 0).alias("is_project"),
        F.when(k % 18 == 0, None).when(k % 18 == 6, "").otherwise(F.concat(F.lit("Set "), (k % 10).cast("string"))).alias("data_set_name"),
        F.when(k % 4 == 0, F.concat(F.lit("About "), "user")).alias("data_set_description"), (length * 3).alias("data_set_size"), (k % 9).alias("data_set_files"),
        F.map_from_arrays(F.array(F.lit("name"), F.lit("timestamp"), F.lit("size"), F.lit("public")), F.array(F.col("name"), F.when(k % 3 == 0, "soon").otherwise(k.cast("string")), length.cast("string"), (k % 2 == 0).cast("string"))).alias("properties"),
        F.transform(F.sequence(F.lit(0).cast("long"), k % 3), lambda i: F.concat(F.lit("s"), ((k + i) % 4).cast("string"))).alias("sticky"),
    )


def targets(srv: DataFrame) -> DataFrame:
    return srv.select("host", F.col("tfirst").alias("first"), F.col("tlast").alias("last"))


def chunk_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Keys of chunks. The file is small for its rows: they are dealt to all tasks before they are hashed. Its size says nothing of the hashes made
    from it, which are about 20 times as wide, so a join never broadcasts them."""
    p = table(spark, sf, "part").select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "p_partkey")
    text = F.col("p_partkey").cast("string").cast("binary")
    # A hash begins with its MD5, so a filter on places need not make the whole hash.
    return p.select("p_partkey", content_hash(text).alias("hash"), prefix(F.md5(text)).alias("place")).hint("merge")


def line_tasks(spark: SparkSession, sf: str) -> int:
    """Tasks that line items are dealt to: about half a million rows each (the files' footers count them), however few the session's partitions are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-table(spark, sf, "lineitem").count() // TASK_ROWS))


def supplied(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair of part and supplier of the line items once. Few repeat, so they are dealt out first and made distinct in small tasks."""
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").repartition(line_tasks(spark, sf), "l_partkey").distinct()


def placed(spark: SparkSession, sf: str) -> DataFrame:
    """p_partkey and host: placement before keys are hashed."""
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_name").alias("host"))
    return supplied(spark, sf).join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.col("l_partkey").alias("p_partkey"), "host")


def placement(spark: SparkSession, sf: str) -> DataFrame:
    return placed(spark, sf).join(chunk_keys(spark, sf), "p_partkey").select("hash", "place", "host")


def requests(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(
        F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("host"), F.col("event_type").alias("description"),
        F.round(F.col("value") * 100).cast("long").alias("millis"), F.col("event_id").alias("seq"), "ts", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
    )


def versions(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.lead("o_orderkey").over(W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")).alias("next"))


def directories(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part")
    k = F.col("p_partkey")
    return p.select(F.concat(F.lit("h"), (k % 40).cast("string")).alias("host"), F.concat(F.lit("/d"), k.cast("string")).alias("directory"), F.lit(1000).cast("long").alias("size_limit"), F.pmod(k * 7919, F.lit(1000)).alias("used"))


def uploaders(spark: SparkSession, sf: str) -> DataFrame:
    """Two uploads of most files: by the file's language as user, and some by a second one."""
    f = files(spark, sf)
    return f.select("hash", "user", (F.col("doc_id") % 5).alias("ts"), F.col("project").alias("path"), "doc_id")


# --- DuckDB ---------------------------------------------------------------------------------------------------


def h(x: str) -> str:
    return f"(md5({x}) || sha1({x}) || sha256({x}) || lpad(lower(to_hex(octet_length(encode({x})))), 16, '0'))"


def place(x: str) -> str:
    return f"xor(CAST('0x' || substr({x}, 1, 2) AS INTEGER), 128)"


def key(x: str) -> str:
    return f"array_to_string(list_transform(range(0, 76), lambda i: translate(substr({x}, CAST(i * 2 + 1 AS INTEGER), 1), '0123456789abcdef', '89abcdef01234567') || substr({x}, CAST(i * 2 + 2 AS INTEGER), 1)), '')"


SQL = {
    "files": f"files AS (SELECT doc_id, source || '/' || doc_id || '.txt' AS name, source AS project, lang AS \"user\", coalesce(text, '') AS text, {h('coalesce(text, chr(0)[1:0])')} AS hash FROM documents)",
    "activity": f"activity AS (SELECT *, {place('hash')} AS place FROM (SELECT event_id, epoch_us(ts) // 1000 AS ts, CASE event_type WHEN 'signup' THEN 33 WHEN 'view' THEN 34 WHEN 'error' THEN 65 WHEN 'click' THEN 66 ELSE 50 END AS action, user_id, {h('CAST(event_id AS VARCHAR)')} AS hash FROM events))",
    "servers": """servers AS (SELECT s_suppkey AS suppkey, s_name AS host, n_name AS grp, CAST(greatest(floor(s_acctbal), 1) AS BIGINT) AS capacity,
        s_suppkey % 3 <> 0 AS is_core, s_suppkey % 7 <> 0 AS is_online, s_suppkey % 5 <> 0 AS is_readable, s_suppkey % 4 <> 0 AS is_writable,
        s_suppkey % 11 AS outstanding, CAST(s_suppkey * 37 % 256 AS INTEGER) AS first, CAST(least(s_suppkey * 37 % 256 + 40, 255) AS INTEGER) AS last,
        CAST(s_suppkey * 53 % 256 AS INTEGER) AS tfirst, CAST(least(s_suppkey * 53 % 256 + 30, 255) AS INTEGER) AS tlast, CAST(s_suppkey * 13 % 32 AS INTEGER) AS flags
        FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey)""",
    "keys": f"keys AS (SELECT *, {place('hash')} AS place FROM (SELECT p_partkey, {h('CAST(p_partkey AS VARCHAR)')} AS hash FROM part))",
    "placement": "placement AS (SELECT hash, place, s_name AS host FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) JOIN supplier ON l_suppkey = s_suppkey JOIN keys ON l_partkey = p_partkey)",
    "requests": "requests AS (SELECT 'h' || user_id % 20 AS host, event_type AS description, CAST(round(value * 100) AS BIGINT) AS millis, event_id AS seq, ts, epoch_us(ts) // 1000 AS ms FROM events)",
    "versions": "versions AS (SELECT o_orderkey AS id, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next FROM orders)",
    "directories": "directories AS (SELECT 'h' || p_partkey % 40 AS host, '/d' || p_partkey AS directory, 1000 AS size_limit, p_partkey * 7919 % 1000 AS used FROM part)",
    "metadata": f"""metadata AS (SELECT doc_id, hash, "user", doc_id % 5 AS ts, project AS path, name, octet_length(encode(text)) AS length, doc_id % 4 = 0 AS encrypted, doc_id % 12 = 0 AS published,
        {h("'z' || doc_id")} AS zip_hash, {h("'a' || doc_id")} AS aes_hash, doc_id % 7 = 0 AS hidden, doc_id % 6 = 0 AS is_project,
        CASE doc_id % 18 WHEN 0 THEN NULL WHEN 6 THEN '' ELSE 'Set ' || doc_id % 10 END AS data_set_name, CASE WHEN doc_id % 4 = 0 THEN 'About ' || "user" END AS data_set_description,
        octet_length(encode(text)) * 3 AS data_set_size, doc_id % 9 AS data_set_files FROM files)""",
    "uploaders": "uploaders AS (SELECT hash, \"user\", doc_id % 5 AS ts, project AS path, doc_id FROM files)",
}
SQL["files"] = SQL["files"].replace("coalesce(text, chr(0)[1:0])", "coalesce(text, '')")


def with_(*names: str) -> str:
    return "WITH RECURSIVE " + ", ".join(SQL[n] for n in names) + " "
