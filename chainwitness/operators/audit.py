"""Record checks and session audits over whole ledgers.

Every step is keyed by (session, seq) or (session, block of seq), never by session
alone on raw rows, so one hot session is spread over many tasks. Full rows are
shuffled once; between blocks one small row per block is carried.
"""

from pyspark.sql import Window
from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import records as R
from chainwitness.functions.ecdsa import signature_ok
from chainwitness.operators.ordered import BEFORE, BLOCK, BLOCK_ROWS, block_of
from chainwitness.operators.ranges import range_parts, runs

SEQ_KEY = ["session_id", "seq"]


def texts(*pairs):
    """Array of the texts whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, text) for cond, text in pairs]))


def ordered_records(ledger, devices=None, block_rows=BLOCK_ROWS):
    """Ledger rows with is_first, prev and session_device, the device of the session's first record.

    Rows of one sequence number stand in (created_at, id) order; only one of them is the
    first, also among copies that agree in all columns. ``prev`` (seq, chain_hash, ended_at) is
    the row before a first one. With ``devices``, the key of session_device is added.
    """
    here = F.struct("seq", "chain_hash", "ended_at")
    position = F.struct("seq", "created_at", "id")
    blocks = ledger.groupBy("session_id", block_of(F.col("seq"), block_rows).alias(BLOCK)).agg(
        F.max_by(here, position).alias("_tail"), F.min_by("device_id", position).alias("_head")
    )
    across = Window.partitionBy("session_id").orderBy(BLOCK)
    blocks = blocks.select(
        "session_id",
        BLOCK,
        F.lag("_tail").over(across).alias("_carried"),
        F.first("_head").over(across.rowsBetween(BEFORE, 0)).alias("session_device"),
    )
    if devices is not None:
        key = F.col("public_key")
        blocks = blocks.join(
            devices.select(
                F.col("id").alias("session_device"), F.col("label").alias("device_label"),
                key["kty"].alias("kty"), key["crv"].alias("crv"),
                key["x"].alias("x"), key["y"].alias("y"), F.lit(True).alias("has_key"),
            ),
            "session_device",
            "left",
        )
    within = Window.partitionBy("session_id", BLOCK).orderBy("seq", "created_at", "id")
    return (
        ledger.withColumn(BLOCK, block_of(F.col("seq"), block_rows))
        .withColumn("_near", F.lag(here).over(within))
        .join(blocks, ["session_id", BLOCK], "left")
        .withColumn("is_first", F.coalesce(F.col("_near.seq") != F.col("seq"), F.lit(True)))
        .withColumn("prev", F.when(F.col("is_first"), F.coalesce("_near", "_carried")))
        .drop(BLOCK, "_near", "_carried")
    )


def link_state():
    """True or false where the link can be judged, null after a gap or a copy; a missing hash is no match."""
    genesis = R.genesis_hash(F.col("session_id"))
    adjacent = F.col("is_first") & (F.col("prev.seq") == F.col("seq") - 1)
    return F.when(F.col("seq") == 0, F.col("prev_chain_hash").eqNullSafe(genesis)).when(
        adjacent, F.col("prev_chain_hash").eqNullSafe(F.col("prev.chain_hash"))
    )


def _linked(rows):
    """Adds link_ok, repeated_seq and gap_ms (time since the record before)."""
    adjacent = F.col("is_first") & (F.col("seq") != 0) & (F.col("prev.seq") == F.col("seq") - 1)
    return (
        rows.withColumn("link_ok", link_state())
        .withColumn("repeated_seq", ~F.col("is_first"))
        .withColumn("gap_ms", F.when(adjacent, F.col("started_at") - F.col("prev.ended_at")))
    )


def check_links(ledger, block_rows=BLOCK_ROWS):
    """Ledger rows with link_ok, repeated_seq and gap_ms (time since the record before)."""
    return _linked(ordered_records(ledger, None, block_rows)).drop("prev", "is_first", "session_device")


def check_records(
    ledger, devices, protocol=V.DEFAULT_PROTOCOL, exact_coordinates=True,
    block_rows=BLOCK_ROWS, verify_with=signature_ok, keep=(),
):
    """One row per ledger record with chain_ok, signature_ok, link_ok and problems.

    ``keep`` names further ledger columns to carry along. ``verify_with`` is the
    signature check, a column function of (kty, crv, x, y, chain_hash, signature).
    """
    slim = ledger.select(
        "id", "device_id", *SEQ_KEY, "created_at", "started_at", "ended_at",
        "prev_chain_hash", "chain_hash", "signature",
        *[c for c in keep if c not in (
            "id", "device_id", "session_id", "seq", "created_at", "started_at", "ended_at",
            "prev_chain_hash", "chain_hash", "signature")],
        R.chain_hash(protocol, exact_coordinates).eqNullSafe(F.col("chain_hash")).alias("chain_ok"),
    )
    checked = (
        _linked(ordered_records(slim, devices, block_rows))
        .withColumn("has_key", F.coalesce("has_key", F.lit(False)))
        .withColumn(
            "signature_ok", verify_with("kty", "crv", "x", "y", "chain_hash", "signature")
        )
        .withColumn(
            "n_missing_before",
            F.when(F.col("is_first"), F.greatest(F.col("seq") - F.col("prev.seq") - 1, F.lit(0)))
            .otherwise(0).cast("bigint"),
        )
        .withColumn("prev_seq", F.col("prev.seq"))
    )
    return checked.withColumn(
        "problems",
        texts(
            (~F.col("chain_ok"), F.lit(V.RECORD_BAD_CHAIN)),
            (~F.col("signature_ok"), F.lit(V.RECORD_BAD_SIGNATURE)),
            (F.col("device_id") != F.col("session_device"), F.lit(V.RECORD_OTHER_DEVICE)),
            (~F.col("link_ok"), F.lit(V.RECORD_BAD_LINK)),
            (F.col("repeated_seq"), F.lit(V.RECORD_REPEATED_SEQ)),
        ),
    ).drop("prev", "is_first", "signature")


def time_gaps(checks):
    """One warning per record that starts too long after the one before it."""
    gap = F.col("gap_ms")
    return checks.where(gap > V.TIME_GAP_WARN_MS).select(
        *SEQ_KEY, gap.cast("bigint").alias("gap_ms"),
        F.format_string(V.SESSION_TIME_GAP, R.duration_text(gap), F.col("seq")).alias("warning"),
    )


def missing_ranges(checks):
    """Ranges of sequence numbers absent from the ledger between neighbours."""
    return checks.where(F.col("n_missing_before") > 0).select(
        "session_id",
        (F.col("prev_seq") + 1).cast("bigint").alias("from_seq"),
        (F.col("seq") - 1).cast("bigint").alias("to_seq"),
        F.col("n_missing_before").alias("n_missing"),
    )


def session_counts(checks):
    """Counters of each session in one aggregate; no texts."""
    when = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    fingerprint = F.when(F.col("has_key"), R.key_fingerprint(F.col("crv"), F.col("x"), F.col("y")))
    at_genesis = F.when(F.col("seq") == 0, F.struct("created_at", "id"))
    return checks.groupBy("session_id").agg(
        F.first("session_device").alias("device_id"),
        F.first("device_label").alias("device_label"),
        F.first(fingerprint).alias("key_fingerprint"),
        F.bool_and("has_key").alias("has_key"),
        F.count(F.lit(1)).alias("n_records"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
        when(F.col("signature_ok")).alias("n_signature_ok"),
        when(F.col("chain_ok")).alias("n_chain_ok"),
        when(~F.col("link_ok")).alias("n_links_broken"),
        F.max_by("link_ok", at_genesis).alias("genesis_ok"),
        F.sum("n_missing_before").alias("n_missing_in_db"),
        when(F.size("problems") > 0).alias("n_bad"),
        when(F.col("gap_ms") > V.TIME_GAP_WARN_MS).alias("n_time_gaps"),
    )


def session_texts(checks, block_rows=BLOCK_ROWS):
    """Ranges of missing and of failing numbers as text parts: (session_id, part, missing_in_db, bad_seqs)."""
    sid = ["session_id"]
    bad = checks.where(F.size("problems") > 0).select(*SEQ_KEY)
    bad_parts = range_parts(runs(bad, sid, "seq", block_rows), sid, "bad_seqs", block_rows=block_rows)
    missing = range_parts(missing_ranges(checks), sid, "missing_in_db", block_rows=block_rows)
    return missing.join(bad_parts, ["session_id", "part"], "full")


def judged(rows):
    """Adds problems, warnings and clean to rows with counters and texts of a session."""
    first = F.col("first_seq")
    rows = rows.withColumn("missing_in_db", F.coalesce("missing_in_db", F.lit(""))).withColumn(
        "bad_seqs", F.coalesce("bad_seqs", F.lit(""))
    )
    return rows.withColumn(
        "problems",
        texts(
            (~F.col("has_key"), F.lit(V.SESSION_NO_KEY)),
            (F.col("missing_in_db") != "", F.format_string(V.SESSION_MISSING, "missing_in_db")),
            (F.col("bad_seqs") != "", F.format_string(V.SESSION_BAD, "n_bad", "bad_seqs")),
        ),
    ).withColumn(
        "warnings", texts((first > 0, F.format_string(V.SESSION_HEAD_EXPIRED, first, first)))
    ).withColumn("clean", F.col("has_key") & (F.col("n_missing_in_db") == 0) & (F.col("n_bad") == 0))


def audit_sessions(checks, block_rows=BLOCK_ROWS):
    """Counters of each session with its range texts, problems and warnings, a row per text part.

    A session with few ranges is one row, part 0. Long texts go on in further parts, which
    repeat the counters. Time-gap warnings are one row each in ``time_gaps``; here they are counted.
    """
    audit = session_counts(checks).join(session_texts(checks, block_rows), "session_id", "left")
    return judged(audit.withColumn("part", F.coalesce("part", F.lit(0))))
