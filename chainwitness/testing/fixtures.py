"""Test inputs that Spark derives from the given tables."""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import records as R
from chainwitness.operators.chain import build_chains
from chainwitness.operators.ordered import block_of, running_count
from chainwitness.session import spread, stage
from chainwitness.testing.signing import public_key_udf, sign_udf

ZEROS = "0" * 64
N_DEVICES = 8
_staged = {}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def once(spark, sf_dir, name, make):
    """Build a fixture once per session and input folder, as a stored table."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _staged:
        _staged[key] = stage(make(), f"fixture-{name}")
    return _staged[key]


def uuid_of(tag, ident):
    h = F.sha2(F.concat(F.lit(tag + "|"), ident.cast("string")), 256)
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in cuts])


def millis_to_timestamp(ms):
    return F.timestamp_millis(ms)


# -- conversations: ledger, devices, submissions ---------------------------------


def conversation_segments(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    numbered = running_count(
        turns, ["conv_id"], ["turn"], "_n", block_of(F.col("turn"))
    ).withColumn("seq", (F.col("_n") - 1).cast("int"))
    conv = F.col("conv_id")
    k = conv % 10
    place = F.when(k != 5, (conv % 1000) / 1000.0)
    content = F.encode(F.concat_ws("|", conv.cast("string"), F.col("turn").cast("string"), "text"), "UTF-8")
    start = F.lit(1700000000000) + conv * 3600000 + F.col("seq") * 5000
    return numbered.select(
        "conv_id",
        "seq",
        content.alias("content"),
        uuid_of("ROW", F.concat_ws(":", conv.cast("string"), F.col("seq").cast("string"))).alias("id"),
        uuid_of("DEV", conv % N_DEVICES).alias("device_id"),
        uuid_of("SES", conv).alias("session_id"),
        start.alias("started_at"),
        (start + 5000).alias("ended_at"),
        F.lit(75).alias("frame_count"),
        F.octet_length(content).cast("bigint").alias("byte_size"),
        F.lit("video/webm").alias("mime_type"),
        F.lit(1280).alias("width"),
        F.lit(720).alias("height"),
        (place + 49).alias("latitude"),
        (place + 1).alias("longitude"),
        F.sha2(content, 256).alias("segment_hash"),
    )


def _conversation_ledger(spark, sf_dir):
    core = conversation_segments(spark, sf_dir).drop("content")
    k, seq = F.col("conv_id") % 10, F.col("seq")
    chained = build_chains(core)
    cut = (k == 6) & (seq == 1)
    chained = (
        chained.where(~((k == 3) & (seq == 1)))
        .withColumn("prev_chain_hash", F.when(cut, ZEROS).otherwise(F.col("prev_chain_hash")))
        .withColumn("chain_hash", F.when(cut, R.chain_hash()).otherwise(F.col("chain_hash")))
    )
    moved = F.when((k == 2) & (seq == 1), 60000).otherwise(0)
    delay = F.when(k == 1, 90000).otherwise(800)
    created = millis_to_timestamp(F.col("ended_at") + delay)
    signer = F.when((k == 4) & (seq == 0), "EVIL").otherwise("KEY")
    return (
        chained.withColumn("signature", sign_udf(signer, F.col("device_id"), F.col("chain_hash")))
        .withColumn("created_at", created)
        .withColumn("expires_at", F.col("created_at") + F.expr(f"INTERVAL {V.LEDGER_RETENTION_DAYS} DAYS"))
        .withColumn("started_at", F.col("started_at") - moved)
        .withColumn("ended_at", F.col("ended_at") - moved)
    )


def conv_ledger(spark, sf_dir):
    """Signed, chained ledger with one kind of defect per tenth of the sessions."""
    return once(spark, sf_dir, "ledger", lambda: _conversation_ledger(spark, sf_dir))


def _devices(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select((F.col("conv_id") % N_DEVICES).alias("n")).distinct()
    device = uuid_of("DEV", F.col("n"))
    return ids.select(
        device.alias("id"),
        F.concat(F.lit("device "), F.col("n").cast("string")).alias("label"),
        public_key_udf(F.lit("KEY"), device).alias("public_key"),
        millis_to_timestamp(F.lit(1690000000000)).alias("created_at"),
    )


def devices(spark, sf_dir):
    return once(spark, sf_dir, "devices", lambda: _devices(spark, sf_dir))


def conv_files(spark, sf_dir):
    """Submitted files, one submission per conversation."""
    return once(spark, sf_dir, "files", lambda: _conversation_files(spark, sf_dir))


def _conversation_files(spark, sf_dir):
    segments = conversation_segments(spark, sf_dir).select("conv_id", "seq", "session_id", "content")
    sizes = segments.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))
    k, conv, seq = F.col("conv_id") % 10, F.col("conv_id"), F.col("seq")
    withheld = (
        ((k == 3) & (seq == 1))
        | ((conv % 20 == 11) & (F.col("n") >= 3) & (seq == 1))
    )
    changed = (k == 8) & (seq == 1)
    swapped = (conv % 20 == 10) & (seq < 2)
    named = F.when(swapped, 1 - seq).otherwise(seq)
    own = segments.join(sizes, "conv_id").where(~withheld).select(
        conv.alias("submission_id"),
        seq.alias("ord"),
        R.segment_file_name(F.col("session_id"), named, F.lit("video/webm")).alias("name"),
        F.when(changed, F.concat(F.col("content"), F.encode(F.lit("!"), "UTF-8")))
        .otherwise(F.col("content")).alias("content"),
    )
    first = segments.where(seq == 0)
    again = first.where(k == 7).select(
        conv.alias("submission_id"),
        F.lit(1000000).alias("ord"),
        R.segment_file_name(F.col("session_id"), seq, F.lit("video/webm")).alias("name"),
        "content",
    )
    strange = first.where(k == 9).select(
        conv.alias("submission_id"),
        F.lit(1000000).alias("ord"),
        F.concat(F.lit("holiday_"), conv.cast("string"), F.lit(".webm")).alias("name"),
        F.encode(F.concat(F.lit("unregistered "), conv.cast("string")), "UTF-8").alias("content"),
    )
    return (
        own.unionByName(again).unionByName(strange)
        .withColumn("origin", F.lit("local"))
        .withColumn("note", F.lit(None).cast("string"))
    )


def conv_manifests(spark, sf_dir):
    """One hash list per conversation with varied line ends, case, marks and defects."""
    return once(spark, sf_dir, "manifests", lambda: _conversation_manifests(spark, sf_dir))


def _conversation_manifests(spark, sf_dir):
    lines = conversation_segments(spark, sf_dir).groupBy("conv_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("seq", "segment_hash"))), lambda s: s["segment_hash"]
        ).alias("h")
    )
    conv, h = F.col("conv_id"), F.col("h")
    none = F.array().cast("array<string>")
    full = F.concat(
        F.slice(h, 1, 1),
        F.when(conv % 50 == 49, F.array(F.lit("not-a-hash"))).otherwise(none),
        F.slice(h, 2, F.size(h)),
        F.slice(h, 1, 1),
        F.when(conv % 4 == 0, F.array(F.lit(ZEROS))).otherwise(none),
    )
    cased = F.when(conv % 2 == 1, F.transform(full, F.upper)).otherwise(full)
    suffixed = F.when(
        conv % 7 == 0, F.transform(cased, lambda x: F.concat(x, F.lit("  *clip.webm")))
    ).otherwise(cased)
    body = F.when(conv % 3 == 0, F.array_join(suffixed, "\r\n")).otherwise(F.array_join(suffixed, "\n"))
    mark = F.when(conv % 5 == 0, F.decode(F.unhex(F.lit("EFBBBF")), "UTF-8")).otherwise("")
    return lines.select(conv.alias("list_id"), F.concat(mark, body).alias("body"))


# -- events: arrival ledger without chains ------------------------------------------


def evt_rows(spark, sf_dir):
    ev, user = F.col("event_id"), F.col("user_id")
    start = F.unix_millis(F.col("ts").cast("timestamp"))
    end = start + 1000 + ev % 4000
    late = F.when(ev % 37 == 0, 61000).when(ev % 41 == 0, 60000).otherwise(800)
    return table(spark, sf_dir, "events").select(
        ev.cast("string").alias("id"),
        "event_id",
        "event_type",
        user.cast("string").alias("session_id"),
        (user % N_DEVICES).cast("string").alias("device_id"),
        F.col("ts").alias("_ts"),
        start.alias("started_at"),
        end.alias("ended_at"),
        millis_to_timestamp(end + late).alias("created_at"),
        F.when(ev % 53 == 0, "bad").otherwise("ok").alias("check"),
        (ev % 11 == 0).alias("locked"),
        F.octet_length("props").cast("bigint").alias("byte_size"),
    )


def evt_ledger(spark, sf_dir):
    """``evt_rows`` with sequence numbers per session in time order."""
    day = F.floor(F.col("started_at") / 86_400_000)
    numbered = running_count(evt_rows(spark, sf_dir), ["session_id"], ["_ts", "event_id"], "_n", day)
    return numbered.withColumn("seq", (F.col("_n") - 1).cast("int")).drop("_n")


def incidents(spark, sf_dir):
    return (
        evt_rows(spark, sf_dir)
        .where((F.col("event_type") == "error") & (F.col("event_id") % 97 == 0))
        .select(
            F.col("event_id").alias("incident_id"), "device_id", F.col("started_at").alias("pressed_at")
        )
    )


# -- frames and vectors -----------------------------------------------------------------


def embedding_frames(spark, sf_dir):
    """Each embedding as doubles and as an 8x8 frame of greys."""
    x = F.col("embedding").cast("array<double>")
    grey = F.transform(
        x, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v * 220 + 128))).cast("int")
    )
    return spread(table(spark, sf_dir, "embeddings")).select(
        "vec_id", "label", x.alias("vector"), grey.alias("grey"),
        F.lit(8).alias("width"), F.lit(8).alias("height"),
    )


def document_frames(spark, sf_dir):
    """The bytes of each whole text as a packed frame 64 wide, the last row filled with zeros."""
    content = F.encode("text", "UTF-8")
    n = F.octet_length(content)
    padded = F.concat(content, F.unhex(F.repeat(F.lit("00"), F.pmod(-n, F.lit(64)))))
    return spread(table(spark, sf_dir, "documents")).select(
        "doc_id", content.alias("content"), padded.alias("grey"),
        F.lit(64).alias("width"), F.ceil(n / 64).cast("int").alias("height"),
    )


def anchored_pairs(spark, sf_dir):
    """Each embedding beside the first embedding of its label and of the next label."""
    rows = embedding_frames(spark, sf_dir)
    anchors = rows.groupBy("label").agg(
        F.min_by(F.struct("vec_id", "vector", "grey"), "vec_id").alias("anchor")
    )
    asked = rows.withColumn("is_genuine", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn(
        "_at", F.when(F.col("is_genuine"), F.col("label")).otherwise((F.col("label") + 1) % 10)
    )
    return asked.join(anchors.withColumnRenamed("label", "_at"), "_at").drop("_at")
