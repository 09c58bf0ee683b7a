"""Registration check of hash lists: which hashes are in the ledger, under valid records."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions.ecdsa import signature_ok
from chainwitness.operators.audit import SEQ_KEY, audit_sessions, check_records
from chainwitness.operators.ordered import BLOCK_ROWS
from chainwitness.plans.evidence import SESSION_FIELDS, audit_documents, document
from chainwitness.session import release, stage
from chainwitness.sources.ledger import find_by_hashes, find_sessions
from chainwitness.sources.manifest import entries, parse

MANIFEST_STATUSES = ("REGISTERED", "NOT_FOUND", "DUPLICATE", "INVALID_RECORD")


@dataclass
class ManifestReport:
    errors: DataFrame
    entries: DataFrame
    checks: DataFrame
    block_rows: int = BLOCK_ROWS
    staged: tuple = ()

    def release(self):
        """Delete the tables staged for this run; its results can no longer be computed."""
        release(*self.staged)

    def sessions(self):
        """Audit of every session that holds a listed hash."""
        return audit_sessions(self.checks, self.block_rows)


def session_is_clean(checks):
    """Sessions whose records, keys and sequence have no problem at all."""
    fails = (F.size("problems") > 0) | ~F.col("has_key") | (F.col("n_missing_before") > 0)
    return checks.groupBy("session_id").agg((~F.bool_or(fails)).alias("session_clean"))


def registered_hashes(candidates, checks):
    """Per hash: is any record valid in a clean session; and which record is shown."""
    by_age = F.struct("created_at", "id")
    first = checks.groupBy(*SEQ_KEY).agg(
        F.min_by(F.size("problems") == 0, by_age).alias("record_clean")
    )
    judged = (
        candidates.select("segment_hash", *SEQ_KEY, "created_at")
        .join(first, SEQ_KEY, "left")
        .join(session_is_clean(checks), "session_id", "left")
        .withColumn(
            "_valid",
            F.coalesce("record_clean", F.lit(False)) & F.coalesce("session_clean", F.lit(False)),
        )
    )
    rank = F.struct((~F.col("_valid")).alias("invalid"), "created_at", "session_id", "seq")
    return judged.groupBy(F.col("segment_hash").alias("hash")).agg(
        F.bool_or("_valid").alias("valid"),
        F.min_by(F.struct("session_id", "seq"), rank).alias("shown"),
    )


def verify_manifests(
    manifests, ledger, devices, *, list_id="list_id", body="body",
    protocol=V.DEFAULT_PROTOCOL, exact_coordinates=True, verify_with=signature_ok,
    block_rows=BLOCK_ROWS, staged=stage, max_hashes=None,
):
    """Check any number of hash lists in one job; video bytes are never looked at.

    ``max_hashes`` rejects longer lists; without it a list may have any length.
    """
    parsed = parse(manifests, list_id, body, max_hashes)
    listed = staged(entries(parsed, list_id))
    candidates = staged(find_by_hashes(ledger, listed, "hash"))
    rows = staged(find_sessions(ledger, candidates))
    checks = staged(
        check_records(rows, devices, protocol, exact_coordinates, block_rows, verify_with)
    )
    known = registered_hashes(candidates, checks)
    first = listed.groupBy(list_id, "hash").agg(F.min("line").alias("_first"))
    status = (
        F.when(F.col("line") > F.col("_first"), "DUPLICATE")
        .when(F.col("valid").isNull(), "NOT_FOUND")
        .when(F.col("valid"), "REGISTERED")
        .otherwise("INVALID_RECORD")
    )
    shown = F.col("line") == F.col("_first")
    matched = (
        listed.join(first, [list_id, "hash"])
        .join(known, "hash", "left")
        .select(
            list_id, "line", "hash", status.alias("status"),
            F.when(shown, F.col("shown.session_id")).alias("session_id"),
            F.when(shown, F.col("shown.seq")).alias("seq"),
        )
    )
    errors = parsed.where(F.col("error").isNotNull()).select(list_id, "error")
    kept = (listed, candidates, rows, checks) if staged is stage else ()
    return ManifestReport(errors=errors, entries=matched, checks=checks, block_rows=block_rows, staged=kept)


def manifest_counts(matched, list_id="list_id"):
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    return matched.groupBy(list_id).agg(
        F.count(F.lit(1)).alias("n_supplied"),
        count("REGISTERED").alias("n_registered"),
        count("NOT_FOUND", "INVALID_RECORD").alias("n_not_valid"),
        count("DUPLICATE").alias("n_repeated"),
    )


def manifest_documents(report, list_id="list_id"):
    """JSON documents of every hash list: counts, entries or the error that rejects it, and the audit of the sessions that its hashes lead to.

    The contents of the files behind the hashes are not looked at, which the counts say.
    """
    counts = manifest_counts(report.entries, list_id).select(
        list_id, *document("list", None, "n_supplied", "n_registered", "n_not_valid", "n_repeated", F.lit(False).alias("content_checked")))
    listed = report.entries.select(list_id, *document("entry", "line", "line", "hash", "status", "session_id", "seq"))
    errors = report.errors.select(list_id, *document("error", None, "error"))
    owners = report.entries.where("session_id is not null").select(list_id, "session_id").distinct()
    sessions = owners.join(report.sessions(), "session_id").select(list_id, *document("session", None, *SESSION_FIELDS))
    return counts.unionByName(listed).unionByName(errors).unionByName(sessions).unionByName(audit_documents(owners, report.checks, list_id))
