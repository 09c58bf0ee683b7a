"""Verification of submitted files against the ledger: file, session and overall verdicts.

One job verifies any number of submissions. Every result is keyed by submission_id.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import records as R
from chainwitness.functions.ecdsa import signature_ok
from chainwitness.operators.audit import (
    SEQ_KEY, check_records, judged, session_counts, session_texts, texts, time_gaps,
)
from chainwitness.operators.ordered import BLOCK_ROWS
from chainwitness.operators.ranges import gaps, range_parts
from chainwitness.session import release, stage
from chainwitness.sources.evidence import hashed
from chainwitness.sources.ledger import find_by_hashes, find_sessions, one_record_per_hash

RECORD_FIELDS = ("segment_hash", "byte_size", "created_at", "ended_at")
STATUSES = ("AUTHENTIC", "MODIFIED", "FORGED", "UNKNOWN", "DUPLICATE")
BAD_STATUSES = ("MODIFIED", "UNKNOWN", "FORGED")


@dataclass
class Verification:
    """Results of one run; each is a DataFrame."""

    files: DataFrame
    checks: DataFrame
    involved: DataFrame
    gaps: DataFrame
    verdicts: DataFrame
    block_rows: int = BLOCK_ROWS
    staged: tuple = ()

    def release(self):
        """Delete the tables staged for this run; its results can no longer be computed."""
        release(*self.staged)

    def sessions(self):
        """Audit of each session in each submission that involves it, a row per part of its range texts."""
        key = ["submission_id", "session_id"]
        coverage = evidence_coverage(self.files, self.gaps)
        in_ledger = session_texts(self.checks, self.block_rows)
        missing = range_parts(self.gaps, key, "missing_in_evidence", block_rows=self.block_rows)
        parts = (
            self.involved.select(*key, F.lit(0).cast("bigint").alias("part"))
            .union(self.involved.join(in_ledger, "session_id").select(*key, "part"))
            .union(missing.select(*key, "part"))
            .distinct()
        )
        joined = judged(
            parts.join(session_counts(self.checks), "session_id", "left")
            .join(in_ledger, ["session_id", "part"], "left")
        ).join(coverage, key, "left").join(missing, [*key, "part"], "left")
        zero, none = F.lit(0), F.array().cast("array<string>")
        absent = F.col("n_records").isNull()
        for name in ("n_records", "n_signature_ok", "n_chain_ok", "n_links_broken",
                     "n_missing_in_db", "n_bad", "n_time_gaps", "n_submitted",
                     "n_missing_in_evidence"):
            joined = joined.withColumn(name, F.coalesce(name, zero).cast("bigint"))
        text = F.coalesce("missing_in_evidence", F.lit(""))
        return (
            joined.withColumn("missing_in_evidence", text)
            .withColumn("problems", F.concat(
                F.coalesce("problems", none),
                texts((text != "", F.format_string(V.SESSION_EVIDENCE_GAP, text)))))
            .withColumn("warnings", F.when(absent, F.array(F.lit(V.SESSION_EMPTY))).otherwise(F.col("warnings")))
            .withColumn("summary", F.format_string(
                V.SUMMARY_SESSION, F.substring("session_id", 1, 8), "n_records",
                "n_signature_ok", "n_links_broken", "n_missing_in_evidence"))
        )


def match_by_hash(files, ledger):
    """Left join of hashed files to one record per content hash, as ``matched``."""
    hits = find_by_hashes(ledger, files, "actual_hash")
    best = one_record_per_hash(hits, *RECORD_FIELDS).select(
        F.col("segment_hash").alias("actual_hash"), F.col("record").alias("matched")
    )
    return files.join(best, "actual_hash", "left")


def involved_sessions(matched):
    """(submission, session) pairs named by a content match or else by a file name."""
    session = F.coalesce("matched.session_id", "hint_session")
    return matched.select("submission_id", session.alias("session_id")).where(
        session.isNotNull()
    ).distinct()


def audited_records(checks):
    """One checked record per (session, seq): the last in (created_at, id) order."""
    fields = F.struct(*RECORD_FIELDS, "chain_ok", "signature_ok", "link_ok")
    return checks.groupBy(*SEQ_KEY).agg(
        F.max_by(fields, F.struct("created_at", "id")).alias("audited")
    )


def file_verdicts(matched, checks):
    """Status, problems and warnings of every submitted file."""
    keyed = matched.withColumn(
        "session_id", F.coalesce("matched.session_id", "hint_session")
    ).withColumn(
        "seq", F.when(F.col("matched").isNotNull(), F.col("matched.seq").cast("bigint"))
        .otherwise(F.col("hint_seq")),
    )
    records = audited_records(checks).withColumn("seq", F.col("seq").cast("bigint"))
    joined = keyed.join(records, SEQ_KEY, "left")

    by_hash, known = F.col("matched").isNotNull(), F.col("audited").isNotNull()
    hinted = F.col("hint_session").isNotNull()
    by_name = ~by_hash & hinted & known

    def field(name):
        own = F.col("audited." + name)
        return F.when(known, own).when(by_hash, F.col("matched." + name))

    chain_bad = by_hash & known & ~F.col("audited.chain_ok")
    signature_bad = by_hash & known & ~F.col("audited.signature_ok")
    link_bad = by_hash & known & ~F.coalesce("audited.link_ok", F.lit(True))
    hash_changed = by_hash & (field("segment_hash") != F.col("actual_hash"))
    size_differs = field("byte_size") != F.col("size")
    renamed = by_hash & hinted & (
        (F.col("hint_session") != F.col("session_id"))
        | ~F.col("hint_seq").eqNullSafe(F.col("seq"))
    )
    delay = F.when(by_hash, R.epoch_ms(field("created_at")) - field("ended_at"))

    turn = F.struct("ord", "name", "actual_hash")
    firsts = joined.where(by_hash).groupBy("submission_id", "session_id", "seq").agg(F.min(turn).alias("first_turn"))
    joined = joined.join(firsts, ["submission_id", "session_id", "seq"], "left").withColumn(
        "is_first", turn == F.col("first_turn")
    )
    repeated = by_hash & ~F.col("is_first")

    status = (
        F.when(repeated, "DUPLICATE")
        .when(chain_bad | signature_bad, "FORGED")
        .when(hash_changed | by_name, "MODIFIED")
        .when(by_hash, "AUTHENTIC")
        .otherwise("UNKNOWN")
    )
    grouped = lambda n: F.format_number(n, 0)
    return joined.select(
        "submission_id", "ord", "name", *[c for c in ("origin", "note") if c in matched.columns],
        "actual_hash", "size",
        status.alias("status"),
        F.when(by_hash | by_name, F.col("session_id")).alias("session_id"),
        F.when(by_hash | by_name, F.col("seq")).alias("seq"),
        F.when(by_hash, "hash").when(by_name, "filename").alias("matched_by"),
        renamed.alias("renamed"),
        delay.alias("anchor_delay_ms"),
        texts(
            (hash_changed, F.lit(V.FILE_HASH_CHANGED)),
            (by_hash & size_differs, F.lit(V.FILE_SIZE_CHANGED)),
            (signature_bad, F.lit(V.FILE_BAD_SIGNATURE)),
            (chain_bad, F.lit(V.FILE_BAD_CHAIN)),
            (link_bad, F.lit(V.FILE_BAD_LINK)),
            (by_name, F.lit(V.FILE_CONTENT_DIFFERS)),
            (by_name & size_differs,
             F.format_string(V.FILE_SIZE_DIFFERS, grouped("size"), grouped(field("byte_size")))),
            (~by_hash & hinted & ~known, F.lit(V.FILE_NO_RECORD)),
            (~by_hash & ~hinted, F.lit(V.FILE_NO_HINT)),
        ).alias("problems"),
        texts(
            (renamed, F.format_string(V.FILE_RENAMED, "hint_seq", "seq")),
            (R.is_late_anchor(delay), F.format_string(V.FILE_LATE_ANCHOR, R.duration_text(delay))),
            (repeated, F.lit(V.FILE_REPEATED)),
        ).alias("warnings"),
    )


def submitted_seqs(files):
    """Distinct (submission, session, seq) that count as submitted."""
    counted = F.col("session_id").isNotNull() & (F.col("status") != "DUPLICATE")
    return files.where(counted).select("submission_id", "session_id", "seq").distinct()


def evidence_gaps(files, block_rows=BLOCK_ROWS):
    """Ranges missing between the first and last submitted record of a session."""
    return gaps(submitted_seqs(files), ["submission_id", "session_id"], "seq", block_rows)


def evidence_coverage(files, missing):
    key = ["submission_id", "session_id"]
    have = submitted_seqs(files).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_submitted"),
        F.min("seq").alias("first_submitted"),
        F.max("seq").alias("last_submitted"),
    )
    lost = missing.groupBy(*key).agg(F.sum("n_missing").alias("n_missing_in_evidence"))
    return have.join(lost, key, "left").withColumn(
        "n_missing_in_evidence", F.coalesce("n_missing_in_evidence", F.lit(0)).cast("bigint")
    )


def status_counts(files):
    """One row per submission with every status counted, zeros included."""
    has_problem = F.size("problems") > 0
    bad = F.col("status").isin(*BAD_STATUSES) | has_problem
    return files.groupBy("submission_id").agg(
        F.count(F.lit(1)).alias("n_files"),
        *[F.count_if(F.col("status") == s).alias("n_" + s.lower()) for s in STATUSES],
        F.bool_or(bad).alias("file_bad"),
    ).withColumn(
        "summary",
        F.format_string(V.SUMMARY_FILES, "n_files", *["n_" + s.lower() for s in STATUSES]),
    )


def session_flags(checks, strict=False):
    """Per session: does any record fail, and are records missing.

    A repeated sequence number or a foreign device alone fails a session only when
    ``strict`` is set.
    """
    failing = ~F.col("chain_ok") | ~F.col("signature_ok") | ~F.coalesce("link_ok", F.lit(True))
    if strict:
        failing = failing | (F.size("problems") > 0)
    return checks.groupBy("session_id").agg(
        F.bool_or(failing).alias("audit_bad"),
        (F.sum("n_missing_before") > 0).alias("db_gap"),
    )


def global_verdicts(files, involved, checks, missing, strict=False):
    """TAMPERED, INCOMPLETE or AUTHENTIC per submission, with file counts."""
    audits = involved.join(session_flags(checks, strict), "session_id").groupBy("submission_id").agg(
        F.bool_or("audit_bad").alias("audit_bad"), F.bool_or("db_gap").alias("db_gap")
    )
    lost = missing.groupBy("submission_id").agg(F.lit(True).alias("evidence_gap"))
    no = F.lit(False)
    tampered = F.coalesce("file_bad", no) | F.coalesce("audit_bad", no)
    incomplete = F.coalesce("db_gap", no) | F.coalesce("evidence_gap", no)
    return (
        status_counts(files)
        .join(audits, "submission_id", "left")
        .join(lost, "submission_id", "left")
        .select(
            "submission_id",
            F.when(tampered, "TAMPERED").when(incomplete, "INCOMPLETE")
            .otherwise("AUTHENTIC").alias("verdict"),
            "n_files",
            *["n_" + s.lower() for s in STATUSES],
            "summary",
        )
    )


def verify_evidence(
    files, ledger, devices, *, mutate=None, protocol=V.DEFAULT_PROTOCOL,
    prefix=V.DEFAULT_FILE_PREFIX, exact_coordinates=True, verify_with=signature_ok,
    strict=False, block_rows=BLOCK_ROWS, staged=stage,
):
    """Verify submissions: ``files`` has submission_id, ord, name and content.

    ``mutate`` is applied to the ledger rows before they are audited. ``staged``
    stores what several branches read (hash matches, rows of the sessions involved,
    record checks, file verdicts); pass ``lambda df: df`` to keep one lazy plan.
    """
    matched = staged(match_by_hash(hashed(files, prefix), ledger))
    involved = involved_sessions(matched)
    kept = rows = staged(find_sessions(ledger, involved))
    if mutate is not None:
        rows = rows.transform(mutate)
    checks = staged(
        check_records(
            rows, devices, protocol, exact_coordinates, block_rows, verify_with,
            keep=("segment_hash", "byte_size"),
        )
    )
    verdicts = staged(file_verdicts(matched, checks))
    missing = evidence_gaps(verdicts, block_rows)
    return Verification(
        files=verdicts, checks=checks, involved=involved, gaps=missing,
        verdicts=global_verdicts(verdicts, involved, checks, missing, strict),
        block_rows=block_rows, staged=(matched, kept, checks, verdicts) if staged is stage else (),
    )


def compare_variants(variants, ledger, devices, **options):
    """Verify originals and altered copies side by side in one job.

    ``variants`` has a text column ``variant`` beside the file columns; each
    (submission, variant) becomes a submission of its own.
    """
    files = variants.withColumn("submission_id", F.struct("submission_id", "variant")).drop("variant")
    verdicts = verify_evidence(files, ledger, devices, **options).verdicts
    rest = [c for c in verdicts.columns if c != "submission_id"]
    return verdicts.select("submission_id.submission_id", "submission_id.variant", *rest)


def document(part, order, *fields):
    """Columns of a JSON document: its kind, its place (a column, or 0 for the only one) and its text."""
    place = F.col(order) if order else F.lit(0)
    return F.lit(part).alias("part"), place.cast("bigint").alias("ord"), F.to_json(F.struct(*fields)).alias("document")


SESSION_FIELDS = (
    "session_id", "part", "device_id", "device_label", "key_fingerprint", "first_seq", "last_seq", "n_records", "n_signature_ok",
    "n_chain_ok", "n_links_broken", "genesis_ok", "n_time_gaps", "missing_in_db", "problems", "warnings",
)


def audit_documents(owners, checks, *owner):
    """Time gaps and record checks of the sessions of each owner, a document each; ``owners`` is (owner, session_id)."""
    gaps = owners.join(time_gaps(checks), "session_id").select(*owner, *document("time_gap", "seq", "session_id", "seq", "gap_ms", "warning"))
    fields = ("session_id", "seq", "id", "chain_ok", "signature_ok", "link_ok", "problems")
    return gaps.unionByName(owners.join(checks, "session_id").select(*owner, *document("record", "seq", *fields)))


def report_documents(verification):
    """JSON documents of every submission: verdict, files, sessions, and time gaps and record checks of those sessions.

    ``part`` names the kind, ``ord`` the place of a file or the sequence number. Details stay separate rows, so a
    large submission or session is never gathered into one document. A field that is unknown (such as ``genesis_ok`` once
    the first record has expired) is absent.
    """
    heads = verification.verdicts.select("submission_id", *document("verdict", None, "verdict", "summary", "n_files"))
    files = verification.files.select(
        "submission_id",
        *document("file", "ord", "name", "status", F.col("actual_hash").alias("sha256"), "session_id", "seq", "problems", "warnings"),
    )
    sessions = verification.sessions().select(
        "submission_id", *document("session", None, *SESSION_FIELDS, "n_submitted", "n_missing_in_evidence", "missing_in_evidence", "summary"),
    )
    audits = audit_documents(verification.involved, verification.checks, "submission_id")
    return heads.unionByName(files).unionByName(sessions).unionByName(audits)


def write_report(verification, path):
    """Write the report documents as JSON lines, partitioned by part."""
    documents = report_documents(verification).select("part", "document")
    documents.write.mode("errorifexists").partitionBy("part").text(path)
