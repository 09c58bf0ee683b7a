"""Column functions on segment records, names, durations and delivery states."""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V


def genesis_hash(session_id):
    return F.sha2(F.concat(F.lit(V.GENESIS_PREFIX), session_id), 256)


def _whole(col):
    return F.coalesce(col.cast("bigint").cast("string"), F.lit(""))


def _coordinate(col, exact):
    text = coordinate_text(col) if exact else F.format_string("%.6f", col)
    usable = col.isNotNull() & ~F.isnan(col)
    return F.when(usable, text).otherwise("")


def coordinate_text(col):
    """Six decimals of the exact binary value of a double, half away from zero.

    The magnitude is cut into two whole numbers of 38 bits, which doubles hold exactly, and
    rounded in decimal arithmetic. Values beyond a million are no coordinates and are
    formatted from their shortest decimal text.
    """
    size = F.abs(col.cast("double"))
    high = F.floor(size * F.lit(2.0**38))
    low = F.floor((size * F.lit(2.0**38) - high) * F.lit(2.0**38))
    whole = lambda n, digits=38: F.lit(str(n)).cast(f"decimal({digits},0)")
    units = high.cast("decimal(20,0)") * whole(2**38, 12) + low.cast("decimal(12,0)")
    doubled = units.cast("decimal(30,0)") * whole(10**6, 7) + whole(2**75)
    millionths = F.call_function("div", doubled, whole(2**76, 23))
    text = F.concat(
        F.when(col < 0, "-").otherwise(""), F.floor(millionths / 10**6).cast("string"), F.lit("."),
        F.lpad((millionths % 10**6).cast("string"), 6, "0"),
    )
    return F.when(size < 10**6, text).otherwise(F.format_string("%.6f", col))


def canonical_record(protocol=V.DEFAULT_PROTOCOL, exact_coordinates=True, prefix=""):
    """The serialised record that the chain hash covers; nulls become empty fields."""

    def c(name):
        return F.col(prefix + name)

    return F.concat_ws(
        "|",
        F.lit(protocol),
        F.coalesce(c("device_id"), F.lit("")),
        F.coalesce(c("session_id"), F.lit("")),
        _whole(c("seq")),
        _whole(c("started_at")),
        _whole(c("ended_at")),
        _whole(c("frame_count")),
        _whole(c("byte_size")),
        F.coalesce(c("mime_type"), F.lit("")),
        _whole(c("width")),
        _whole(c("height")),
        _coordinate(c("latitude"), exact_coordinates),
        _coordinate(c("longitude"), exact_coordinates),
        F.coalesce(c("segment_hash"), F.lit("")),
        F.coalesce(c("prev_chain_hash"), F.lit("")),
    )


def chain_hash(protocol=V.DEFAULT_PROTOCOL, exact_coordinates=True):
    return F.sha2(canonical_record(protocol, exact_coordinates), 256)


def key_fingerprint(crv, x, y):
    """Four groups of four hex digits that identify a public key."""
    digest = F.sha2(F.concat_ws("|", crv, x, y), 256)
    return F.concat_ws(":", *[F.substring(digest, 1 + 4 * i, 4) for i in range(4)])


def is_sha256_hex(col):
    return F.coalesce(col.rlike(V.HEX64_PATTERN), F.lit(False))


def bytes_to_hex(col):
    return F.lower(F.hex(col))


def file_extension(mime):
    return F.when(F.contains(mime, F.lit("mp4")), "mp4").otherwise("webm")


def segment_file_name(session_id, seq, mime, prefix=V.DEFAULT_FILE_PREFIX):
    return F.concat(
        F.lit(prefix + "_"), session_id, F.lit("_"), F.format_string("%05d", seq),
        F.lit("."), file_extension(mime),
    )


def _hint_pattern(prefix):
    return rf"(?i){prefix}_({V.UUID_PATTERN})_(\d+)\."


def hinted_session(name, prefix=V.DEFAULT_FILE_PREFIX):
    found = F.regexp_extract(name, _hint_pattern(prefix), 1)
    return F.when(found != "", F.lower(found))


def hinted_seq(name, prefix=V.DEFAULT_FILE_PREFIX):
    """Sequence number in a file name; null where absent or beyond a 64-bit integer."""
    found = F.regexp_extract(name, _hint_pattern(prefix), 2)
    return F.when(found != "", found.try_cast("bigint"))


def segment_key(session_id, seq):
    return F.concat(session_id, F.lit(":"), F.format_string("%06d", seq))


def base_mime(mime):
    return F.split_part(mime, F.lit(";"), F.lit(1))


def duration_text(ms):
    """``12 s``, ``3 min 4 s`` or ``2 h 5 min``, seconds rounded half up."""
    s = F.floor(ms / 1000 + F.lit(0.5)).cast("bigint")
    m = F.floor(s / 60).cast("bigint")
    return (
        F.when(s < 60, F.format_string("%d s", s))
        .when(m < 60, F.format_string("%d min %d s", m, s - m * 60))
        .otherwise(
            F.format_string(
                "%d h %d min", F.floor(m / 60).cast("bigint"), m - F.floor(m / 60) * 60
            )
        )
    )


def round6(col):
    """Six decimals, halves towards positive infinity."""
    return F.floor(col * 1e6 + F.lit(0.5)) / F.lit(1e6)


def epoch_ms(ts):
    return F.unix_millis(ts.cast("timestamp"))


def anchor_delay_ms():
    return epoch_ms(F.col("created_at")) - F.col("ended_at")


def is_late_anchor(delay):
    return delay > V.ANCHOR_DELAY_WARN_MS


def is_transient_failure(status):
    """Failures worth a retry: none reported, server side, timeout or rate limit."""
    s = F.coalesce(status, F.lit(0))
    return (s == 0) | (s >= 500) | (s == 408) | (s == 429)


def backoff_ms(failures_in_row):
    """Delay before the next try after n failures in a row; n is 0 after a success."""
    steps = F.least(failures_in_row - 1, F.lit(20)).cast("int")
    return F.when(
        failures_in_row > 0,
        F.least(
            F.lit(V.BACKOFF_MAX_MS).cast("bigint"),
            (F.lit(V.BACKOFF_FIRST_MS) * F.pow(F.lit(2.0), steps)).cast("bigint"),
        ),
    ).otherwise(F.lit(0).cast("bigint"))


def seconds_left(ended_at, now_ms, retention_ms):
    """Whole seconds until a cached clip expires, at least 0; 0 means expiring."""
    left = ended_at + F.lit(retention_ms) - now_ms
    return F.when(left > 0, F.ceil(left / 1000)).otherwise(0).cast("bigint")


def is_video_file(name, mime=None):
    by_name = name.rlike(V.VIDEO_NAME_PATTERN)
    if mime is None:
        return by_name
    return by_name | F.coalesce(F.startswith(mime, F.lit("video/")), F.lit(False))
