"""Queries on records, chains and sequences."""

from pyspark.sql import functions as F

from chainwitness.catalog import sql as S
from chainwitness.functions import records as R
from chainwitness.functions.ecdsa import signature_ok
from chainwitness.operators import audit, ranges
from chainwitness.operators.chain import build_chains
from chainwitness.sources import ledger as src
from chainwitness.testing import fixtures as X

SEP = " | "


def big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


def canonical_record(spark, d):
    return X.conv_ledger(spark, d).select("conv_id", *big("seq"), R.canonical_record().alias("record"))


def chain_hash_check(spark, d):
    return X.conv_ledger(spark, d).select(
        "conv_id", *big("seq"), (R.chain_hash() == F.col("chain_hash")).alias("chain_ok")
    )


def chain_build_fold(spark, d):
    built = build_chains(X.conversation_segments(spark, d).drop("content"))
    return built.select("conv_id", *big("seq"), "prev_chain_hash", "chain_hash")


def link_check(spark, d):
    checked = audit.check_links(X.conv_ledger(spark, d))
    return checked.select("conv_id", *big("seq"), "link_ok", "repeated_seq", *big("gap_ms"))


def _checks(spark, d):
    return audit.check_records(X.conv_ledger(spark, d), X.devices(spark, d), keep=("conv_id",))


def record_problems(spark, d):
    return _checks(spark, d).select(
        "conv_id", *big("seq"), "chain_ok", "signature_ok", "link_ok",
        F.array_join("problems", SEP).alias("problems"),
    )


def signature_check(spark, d):
    known = src.with_devices(X.conv_ledger(spark, d), X.devices(spark, d))
    key = F.col("public_key")
    ok = signature_ok(key["kty"], key["crv"], key["x"], key["y"], "chain_hash", "signature")
    return known.select("conv_id", *big("seq"), ok.alias("signature_ok"))


def genesis_status(spark, d):
    links = audit.check_links(X.conv_ledger(spark, d))
    at_start = F.when(F.col("seq") == 0, F.struct("created_at", "id"))
    return links.groupBy("session_id").agg(F.max_by("link_ok", at_start).alias("genesis_ok"))


def session_audit(spark, d):
    from chainwitness.session import stage

    rows = audit.audit_sessions(stage(_checks(spark, d), "checks"))
    return rows.select(
        "session_id", *big("part"), "device_id", "device_label",
        *big("n_records", "first_seq", "last_seq", "n_signature_ok", "n_chain_ok", "n_links_broken"),
        "genesis_ok", *big("n_missing_in_db"), "missing_in_db", *big("n_bad"), "bad_seqs",
        *big("n_time_gaps"), F.array_join("problems", SEP).alias("problems"),
        F.array_join("warnings", SEP).alias("warnings"), "clean",
    )


def time_gap_warnings(spark, d):
    links = audit.check_links(X.conv_ledger(spark, d))
    return audit.time_gaps(links).select("session_id", *big("seq"), "gap_ms", "warning")


def _lines(spark, d):
    return X.table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").cast("bigint").alias("seq")
    )


def seq_gaps(spark, d):
    return ranges.gaps(_lines(spark, d), ["l_orderkey"])


def missing_seqs(spark, d):
    return ranges.expand(ranges.gaps(_lines(spark, d), ["l_orderkey"]), ["l_orderkey"])


def seq_duplicates(spark, d):
    counts = _lines(spark, d).groupBy("l_orderkey", "seq").agg((F.count(F.lit(1)) - 1).alias("n_repeats"))
    return counts.where("n_repeats > 0")


def compact_ranges(spark, d):
    key = ["l_orderkey"]
    return ranges.range_parts(ranges.runs(_lines(spark, d), key), key, "ranges")


def find_by_hashes(spark, d):
    wanted = X.conv_files(spark, d).select(F.sha2("content", 256).alias("h"))
    return src.find_by_hashes(X.conv_ledger(spark, d), wanted, "h").select("conv_id", *big("seq"), "segment_hash")


def session_scan(spark, d):
    """All records of the sessions that submitted an unregistered file."""
    files = X.conv_files(spark, d).where(F.col("name").startswith("holiday_"))
    sessions = files.select(X.uuid_of("SES", F.col("submission_id")).alias("session_id"))
    return src.find_sessions(X.conv_ledger(spark, d), sessions).select("session_id", *big("seq"), "id").orderBy("session_id", "seq")


def device_lookup(spark, d):
    known = src.with_devices(X.conv_ledger(spark, d), X.devices(spark, d))
    return known.select("id", "device_id", "device_label", F.col("public_key").isNotNull().alias("has_key"))


def device_fingerprint(spark, d):
    return X.table(spark, d, "customer").select(
        "c_custkey", R.key_fingerprint(F.lit("P-256"), F.col("c_name"), F.col("c_mktsegment")).alias("fingerprint")
    )


def hash_list_export(spark, d):
    return src.hash_list(X.conv_ledger(spark, d))


def name_formats(spark, d):
    cust, bal = F.col("c_custkey"), F.col("c_acctbal")
    session = X.uuid_of("SES", cust)
    mime = F.when(cust % 2 == 0, "video/mp4;codecs=avc1").otherwise("video/webm;codecs=vp8")
    seq = (cust * 37).cast("int")
    name = R.segment_file_name(session, seq, R.base_mime(mime))
    return X.table(spark, d, "customer").select(
        "c_custkey", name.alias("file_name"), R.segment_key(session, seq).alias("key"),
        R.base_mime(mime).alias("mime"), R.hinted_session(F.upper(name), "CLIP").alias("hint_session"),
        R.hinted_seq(name).alias("hint_seq"),
        R.duration_text((F.abs(bal) * 1000).cast("bigint")).alias("duration"),
        R.round6(bal / 7).alias("rounded"),
        R.is_sha256_hex(F.sha2(name, 256)).alias("is_hash"),
        F.base64(F.encode(name, "UTF-8")).alias("base64"),
        R.bytes_to_hex(F.encode(name, "UTF-8")).alias("hex"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        canonical_record, chain_hash_check, chain_build_fold, link_check, record_problems,
        signature_check, genesis_status, session_audit, time_gap_warnings, seq_gaps, missing_seqs,
        seq_duplicates, compact_ranges, find_by_hashes, session_scan, device_lookup,
        device_fingerprint, hash_list_export, name_formats,
    )
}

_GAPS = """select l_orderkey, seq, lag(seq) over (partition by l_orderkey order by seq) as prev
  from (select distinct l_orderkey, l_linenumber::bigint as seq from lineitem) t"""
_RUNS = """select l_orderkey, min(seq) as a, max(seq) as b from (
    select l_orderkey, seq, seq - row_number() over (partition by l_orderkey order by seq) as island
    from (select distinct l_orderkey, l_linenumber::bigint as seq from lineitem) t) u group by l_orderkey, island"""


def _text_of_runs(source, condition):
    """Range text per session of the records that meet a condition."""
    return f"""select session_id, string_agg(case when a = b then '#' || a else '#' || a || '–#' || b end, ', ' order by a) as txt
      from (select session_id, min(seq) as a, max(seq) as b from (
        select session_id, seq, seq - row_number() over (partition by session_id order by seq) as island
        from {source} where {condition}) t group by session_id, island) u group by session_id"""


AUDIT_SELECT = f"""
  select s.*, coalesce(b.txt, '') as bad_seqs, coalesce(m.txt, '') as missing_in_db
  from (
    select session_id, arg_min(device_id, seq) as device_id, count(*) as n_records,
      'device ' || any_value(conv_id % 8) as device_label,
      min(seq)::bigint as first_seq, max(seq)::bigint as last_seq,
      count(*) filter (signature_ok) as n_signature_ok, count(*) filter (chain_ok) as n_chain_ok,
      count(*) filter (not link_ok) as n_links_broken, arg_max(link_ok, seq) filter (seq = 0) as genesis_ok,
      sum(n_missing_before)::bigint as n_missing_in_db, count(*) filter (problems <> '') as n_bad,
      count(*) filter (gap_ms > 2000) as n_time_gaps
    from chk group by session_id) s
  left join ({_text_of_runs('chk', "problems <> ''")}) b using (session_id)
  left join (select session_id, string_agg(case when n_missing_before = 1 then '#' || (seq - 1)
       else '#' || (prev_seq + 1) || '–#' || (seq - 1) end, ', ' order by seq) as txt
     from chk where n_missing_before > 0 group by session_id) m using (session_id)"""

SESSION_PROBLEMS = S.joined(
    ("n_missing_in_db > 0", "'Server chain has missing record(s): ' || missing_in_db || '.'"),
    ("n_bad > 0", "n_bad || ' server record(s) fail integrity checks: seq ' || bad_seqs || '.'"),
)

ORACLES = {
    "canonical_record": S.with_ledger(f"select conv_id, seq, {S.canonical()} as record from led", checks=False),
    "chain_hash_check": S.with_ledger("select conv_id, seq, chain_ok from chk"),
    "chain_build_fold": f"with recursive {S.SEGMENTS}, {S.CHAINS} select conv_id, seq, prev_chain_hash, chain_hash from fold",
    "link_check": S.with_ledger("select conv_id, seq, link_ok, false as repeated_seq, gap_ms from chk"),
    "record_problems": S.with_ledger("select conv_id, seq, chain_ok, signature_ok, link_ok, problems from chk"),
    "signature_check": S.with_ledger("select conv_id, seq, signature_ok from chk"),
    "genesis_status": S.with_ledger("select session_id, arg_max(link_ok, seq) filter (seq = 0) as genesis_ok from chk group by 1"),
    "session_audit": S.with_ledger(f"""
select session_id, 0::bigint as part, device_id, device_label, n_records, first_seq, last_seq, n_signature_ok, n_chain_ok,
  n_links_broken, genesis_ok, n_missing_in_db, missing_in_db, n_bad, bad_seqs, n_time_gaps,
  {SESSION_PROBLEMS} as problems, '' as warnings, n_bad = 0 and n_missing_in_db = 0 as clean
from ({AUDIT_SELECT}) a"""),
    "time_gap_warnings": S.with_ledger(
        f"select session_id, seq, gap_ms, 'Time gap of ' || {S.duration('gap_ms')} || ' before seq ' || seq || '.' as warning from chk where gap_ms > 2000"
    ),
    "seq_gaps": f"select l_orderkey, prev + 1 as from_seq, seq - 1 as to_seq, seq - prev - 1 as n_missing from ({_GAPS}) g where seq > prev + 1",
    "missing_seqs": f"select l_orderkey, unnest(range(prev + 1, seq)) as seq from ({_GAPS}) g where seq > prev + 1",
    "seq_duplicates": "select l_orderkey, l_linenumber::bigint as seq, count(*) - 1 as n_repeats from lineitem group by 1, 2 having count(*) > 1",
    "compact_ranges": f"""select l_orderkey, part, string_agg(case when a = b then '#' || a else '#' || a || '–#' || b end, ', ' order by a) as ranges
from (select *, (row_number() over (partition by l_orderkey order by a) - 1) // {ranges.PART_RANGES} as part from ({_RUNS}) r) p group by 1, 2""",
    "find_by_hashes": S.with_ledger("select conv_id, seq, segment_hash from led where segment_hash in (select sha256(body) from files)", S.FILES, checks=False),
    "session_scan": S.with_ledger("select session_id, seq, id from led where k = 9", checks=False),
    "device_lookup": S.with_ledger("select id, device_id, 'device ' || (conv_id % 8) as device_label, true as has_key from led", checks=False),
    "device_fingerprint": """select c_custkey, substr(h,1,4) || ':' || substr(h,5,4) || ':' || substr(h,9,4) || ':' || substr(h,13,4) as fingerprint
from (select c_custkey, sha256('P-256|' || c_name || '|' || c_mktsegment) as h from customer) t""",
    "hash_list_export": S.with_ledger("select segment_hash from led", checks=False),
    "name_formats": f"""select c_custkey, name as file_name, sid || ':' || printf('%06d', seq) as key, mime, sid as hint_session,
  seq::bigint as hint_seq, {S.duration("trunc(abs(c_acctbal) * 1000)::bigint")} as duration,
  floor(c_acctbal / 7 * 1000000.0::double + 0.5::double) / 1000000.0::double as rounded, true as is_hash,
  to_base64(encode(name)) as base64, lower(hex(encode(name))) as hex
from (select *, 'clip_' || sid || '_' || printf('%05d', seq) || case when c_custkey % 2 = 0 then '.mp4' else '.webm' end as name
  from (select c_custkey, c_acctbal, (c_custkey * 37)::int as seq, {S.uuid('SES', 'c_custkey')} as sid,
    case when c_custkey % 2 = 0 then 'video/mp4' else 'video/webm' end as mime from customer) t) u""",
}
