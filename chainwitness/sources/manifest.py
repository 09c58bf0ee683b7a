"""Hash lists: reading the files and parsing their lines."""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V


def read_manifests(spark, path, max_bytes=None):
    """Text files of a folder as (path, size, body, accepted).

    Accepted are ``.txt`` files, with ``max_bytes`` only those of at most that size. The
    condition on size reaches the reader, which does not open refused files; a second scan
    without contents lists them.
    """
    files = spark.read.format("binaryFile").load(path)
    accepted = F.lower(F.substring_index("path", ".", -1)) == "txt"
    read = files.where(accepted)
    if max_bytes is not None:
        accepted = accepted & (F.col("length") <= max_bytes)
        read = read.where(F.col("length") <= max_bytes)
    size = F.col("length").alias("size")
    taken = read.select("path", size, F.decode("content", "UTF-8").alias("body"), F.lit(True).alias("accepted"))
    refused = files.where(~accepted).select("path", size, F.lit(None).cast("string").alias("body"), F.lit(False).alias("accepted"))
    return taken.union(refused)


def _trimmed(line):
    return F.regexp_replace(line, f"^[{V.BLANKS}]+|[{V.BLANKS}]+$", "")


def parse(manifests, list_id="list_id", body="body", max_hashes=None):
    """One row per list: its entries (line, hash) or the error that rejects it.

    A list is one text and is parsed inside its row, so no shuffle is needed. The first
    failing line, or with ``max_hashes`` one entry more than that, rejects the whole list.
    """
    text = F.regexp_replace(body, r"^\x{FEFF}", "")
    lines = F.transform(
        F.split(text, r"\r?\n"),
        lambda raw, i: F.struct((i + 1).alias("line"), _trimmed(raw).alias("text")),
    )
    filled = F.filter(lines, lambda x: x["text"] != "")
    parsed = F.transform(
        filled,
        lambda x: F.struct(
            x["line"].alias("line"),
            F.lower(F.regexp_extract(x["text"], V.MANIFEST_LINE_PATTERN, 1)).alias("hash"),
        ),
    )
    rows = manifests.select(list_id, parsed.alias("_lines"))
    rows = rows.withColumn(
        "_bad", F.array_min(F.transform(F.filter("_lines", lambda x: x["hash"] == ""), lambda x: x["line"]))
    )
    before = F.when(F.col("_bad").isNull(), F.size("_lines")).otherwise(
        F.size(F.filter("_lines", lambda x: x["line"] < F.col("_bad")))
    )
    too_long = F.lit(False) if max_hashes is None else before > max_hashes
    error = (
        F.when(too_long, V.MANIFEST_TOO_LONG)
        .when(F.col("_bad").isNotNull(), F.format_string(V.MANIFEST_BAD_LINE, "_bad"))
        .when(F.size("_lines") == 0, V.MANIFEST_EMPTY)
    )
    return rows.withColumn("error", error).select(
        list_id, "error",
        F.when(F.col("error").isNull(), F.col("_lines")).alias("entries"),
    )


def entries(parsed, list_id="list_id"):
    """Lines of the accepted lists as rows (list_id, line, hash)."""
    return parsed.where(F.col("error").isNull()).select(
        list_id, F.explode("entries").alias("_e")
    ).select(list_id, F.col("_e.line").alias("line"), F.col("_e.hash").alias("hash"))
