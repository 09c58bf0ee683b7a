"""Queries on submitted files, verdicts and hash lists."""

from pyspark.sql import functions as F

from chainwitness.catalog import sql as S
from chainwitness.catalog.ledger import AUDIT_SELECT, SEP, SESSION_PROBLEMS, big
from chainwitness.functions import records as R
from chainwitness.functions import tamper
from chainwitness.operators.ordered import mark_first
from chainwitness.plans import evidence as plan
from chainwitness.plans import lifecycle, manifest, monitor
from chainwitness.session import new_dir
from chainwitness.sources import evidence as src
from chainwitness.sources import ledger as ledgers
from chainwitness.sources import manifest as lists
from chainwitness.sources.objects import ObjectStore
from chainwitness.testing import fixtures as X


def verification(spark, d, **options):
    return plan.verify_evidence(X.conv_files(spark, d), X.conv_ledger(spark, d), X.devices(spark, d), **options)


def global_verdict(spark, d):
    return verification(spark, d).verdicts


def file_verdicts(spark, d):
    return verification(spark, d).files.select(
        "submission_id", *big("ord"), "name", "actual_hash", "size", "status", "session_id", "seq",
        "matched_by", "renamed", "anchor_delay_ms",
        F.array_join("problems", SEP).alias("problems"), F.array_join("warnings", SEP).alias("warnings"),
    )


def status_summary(spark, d):
    return plan.status_counts(verification(spark, d).files).drop("file_bad")


def evidence_coverage(spark, d):
    v = verification(spark, d)
    return plan.evidence_coverage(v.files, v.gaps)


def session_report(spark, d):
    return verification(spark, d).sessions().select(
        "submission_id", "session_id", *big("part"),
        *big("n_records", "n_signature_ok", "n_links_broken", "n_missing_in_db", "n_submitted", "n_missing_in_evidence"),
        "missing_in_evidence", F.array_join("problems", SEP).alias("problems"),
        F.array_join("warnings", SEP).alias("warnings"), "summary",
    )


def mutated_ledger_verdict(spark, d):
    """Verdicts after the stored times of sequence number 2 were moved."""
    return verification(spark, d, mutate=tamper.shift_times(2)).verdicts.select("submission_id", "verdict", "n_forged")


def review_report(spark, d):
    return plan.report_documents(verification(spark, d))


def _fields(documents, part, key, schema):
    """The fields of one kind of document of a report."""
    return documents.where(F.col("part") == part).select(key, F.from_json("document", schema).alias("_f")).select(key, "_f.*")


def report_sessions(spark, d):
    """Sessions as the review report gives them."""
    schema = """session_id string, part long, device_id string, device_label string, first_seq long, last_seq long, n_records long,
        genesis_ok boolean, n_time_gaps long, missing_in_db string"""
    return _fields(review_report(spark, d), "session", "submission_id", schema)


def report_time_gaps(spark, d):
    schema = "session_id string, seq long, gap_ms long, warning string"
    return _fields(review_report(spark, d), "time_gap", "submission_id", schema)


def report_records(spark, d):
    schema = "session_id string, seq long, id string, chain_ok boolean, signature_ok boolean, link_ok boolean, problems array<string>"
    found = _fields(review_report(spark, d), "record", "submission_id", schema)
    return found.withColumn("problems", F.array_join("problems", SEP))


def manifest_report(spark, d):
    """Entries of every hash list as its report gives them."""
    return _fields(manifest.manifest_documents(_manifest_report(spark, d)), "entry", "list_id", "line long, hash string, status string, session_id string, seq long")


def file_hash_lookup(spark, d):
    """Each document's content looked up in a ledger where contents repeat."""
    docs = X.table(spark, d, "documents")
    ledger = docs.select(
        F.sha2("text", 256).alias("segment_hash"), F.col("source").alias("session_id"),
        F.col("doc_id").alias("seq"), F.timestamp_millis(F.col("doc_id") % 97).alias("created_at"),
    )
    files = docs.select("doc_id", F.sha2("text", 256).alias("actual_hash"))
    best = ledgers.one_record_per_hash(ledgers.find_by_hashes(ledger, files, "actual_hash"))
    return files.join(best, files["actual_hash"] == best["segment_hash"], "left").select(
        "doc_id", "actual_hash", F.col("record.session_id").alias("session_id"), F.col("record.seq").alias("seq")
    )


def duplicate_submissions(spark, d):
    """Second and later documents with the same content, in document order."""
    docs = X.table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return mark_first(docs, ["content_hash"], ["doc_id"], "_first").where(~F.col("_first")).drop("_first")


def filename_hint(spark, d):
    files = src.hashed(X.conv_files(spark, d))
    return files.select("submission_id", *big("ord"), "name", "hint_session", "hint_seq")


def _variants(spark, d):
    files = X.conv_files(spark, d)
    content = F.col("content")
    altered = {
        "bit": tamper.flip_one_bit(content), "block": tamper.zero_block(content),
        "cut": tamper.truncate(content), "shift": tamper.shift_block(content),
        "invert": tamper.invert_block(content),
    }
    out = files.withColumn("variant", F.lit("original"))
    for name, column in altered.items():
        out = out.unionByName(files.withColumn("content", column).withColumn("variant", F.lit(name)))
    omitted = lifecycle.omit(files, ["submission_id"], "ord").withColumn("variant", F.lit("omit"))
    return out.unionByName(omitted)


def variant_comparison(spark, d):
    report = plan.compare_variants(_variants(spark, d), X.conv_ledger(spark, d), X.devices(spark, d))
    return report.select("submission_id", "variant", "verdict", "n_files", "n_modified", "n_unknown")


def size_change(spark, d):
    files = X.conv_files(spark, d).withColumn("size", F.octet_length("content").cast("bigint"))
    cut = files.withColumn("size", F.octet_length(tamper.truncate(F.col("content"))).cast("bigint"))
    return monitor.size_change(files, cut, "submission_id")


def omit_middle(spark, d):
    left = lifecycle.omit(X.conv_files(spark, d), ["submission_id"], "ord")
    return left.select("submission_id", *big("ord"), "name")


def swapped_names(spark, d):
    files = X.conv_files(spark, d).select("submission_id", "ord", "name")
    pairs = files.withColumn("pair", F.floor(F.col("ord") / 2))
    return tamper.swap_names(pairs, ["submission_id", "pair"]).select("submission_id", *big("ord"), "name")


def selected_footage(spark, d):
    files = X.conv_files(spark, d).withColumn("size", F.octet_length("content").cast("bigint"))
    return src.grouped_selection(files)


def _objects(spark, d):
    page = F.col("page_id")
    name = F.when(page % 17 == 0, F.concat(page.cast("string"), F.lit(".webm"))).otherwise(
        F.concat_ws("/", (page % 40).cast("string"), F.concat(page.cast("string"), F.lit(".webm")))
    )
    return X.table(spark, d, "pages").select(
        F.lit("evidence").alias("bucket_id"), name.alias("name"),
        F.octet_length("html").cast("bigint").alias("size"), F.timestamp_millis(page * 1000).alias("created_at"),
    )


def folder_listing(spark, d):
    return src.folder_listing(_objects(spark, d)).select("folder", "file_name", "path", "size")


def admitted_files(spark, d):
    page = F.col("page_id")
    ending = F.element_at(F.array(*[F.lit(e) for e in (".webm", ".MP4", ".mkv", ".mov", ".avi", ".txt", "webm")]), (page % 7 + 1).cast("int"))
    mime = F.when(page % 10 == 4, "video/x-msvideo")
    files = X.table(spark, d, "pages").select(F.concat(page.cast("string"), ending).alias("name"), mime.alias("mime"))
    return src.admit(files, F.col("mime")).select("name")


def session_sources(spark, d):
    """Cache for half of the sessions, bucket for a quarter, placeholders for the rest."""
    rows = X.conv_ledger(spark, d)
    conv = F.col("conv_id")
    key = R.segment_key(F.col("session_id"), F.col("seq"))
    name = R.segment_file_name(F.col("session_id"), F.col("seq"), F.col("mime_type"))
    cached = rows.where((conv % 4 < 2) & (F.col("seq") % 2 == 0)).select(key.alias("key"), name.alias("file_name"), F.col("byte_size").alias("size"))
    objects = rows.where(conv % 4 < 3).select(
        F.lit("evidence").alias("bucket_id"), F.concat_ws("/", "session_id", name).alias("name"),
        F.col("byte_size").alias("size"), "created_at",
    )
    return src.session_files(rows, cached, objects)


def upload_objects(spark, d):
    """Objects that an upload adds: new names only, first copy of each."""
    objects = _objects(spark, d)
    stored = objects.where(F.col("size") % 2 == 0)
    again = objects.withColumn("created_at", F.col("created_at") + F.expr("INTERVAL 1 HOUR"))
    added = ledgers.append_objects(objects.unionByName(again), stored)
    return added.select("name", "size", F.unix_millis("created_at").alias("created_ms"))


def stored_objects(spark, d):
    """Texts stored as objects in two uploads, the first sent twice; two texts want each name. Bytes are read back."""
    store = ObjectStore(spark, new_dir(spark, "objects"), buckets=32)
    files = X.table(spark, d, "documents").select(
        F.lit(src.EVIDENCE_BUCKET).alias("bucket_id"), F.concat(F.lit("doc/"), F.floor(F.col("doc_id") / 2).cast("string"), F.lit(".txt")).alias("name"),
        F.encode("text", "UTF-8").alias("content"), "doc_id",
    )
    for batch, rows in ((0, files.where("doc_id % 3 = 0")), (0, files), (1, files)):
        store.put(rows, batch, F.timestamp_millis(F.lit(1000 * (batch + 1))), order=("doc_id",))
    return store.get().select(
        "name", "size", "address", F.sha2("content", 256).alias("content_hash"), F.unix_millis("created_at").alias("created_ms"))


def _in_files(rows, spark, key):
    """A folder with a text file for each value of ``key``, a whole number; returns its path."""
    path = new_dir(spark, "files")
    rows.write.partitionBy(key).text(path)
    return path


def _key_in(path, key):
    return F.regexp_extract(path, f"/{key}=([0-9]+)/", 1).cast("bigint").alias(key)


def content_read(spark, d):
    """Conversations stored as one file each, read back with their bytes."""
    turns = X.table(spark, d, "conversations").select("conv_id", "turn", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "text")
    files = src.hashed(src.read_contents(spark, _in_files(turns.drop("turn"), spark, "conv_id")))
    named = F.endswith("path", F.concat(F.lit("/"), "name"))
    return files.select(_key_in("path", "conv_id"), "size", F.col("actual_hash").alias("content_hash"), named.alias("named_by_path"))


def manifest_files(spark, d):
    """Hash lists read from text files of at most a million bytes, and parsed."""
    bodies = X.conv_manifests(spark, d).select("list_id", "body")
    read = lists.read_manifests(spark, _in_files(bodies, spark, "list_id"), max_bytes=1_000_000)
    taken = read.where("accepted").select(_key_in("path", "list_id"), "body")
    return lists.entries(lists.parse(taken)).select("list_id", *big("line"), "hash")


def manifest_parse(spark, d):
    return lists.entries(lists.parse(X.conv_manifests(spark, d))).select("list_id", *big("line"), "hash")


def manifest_errors(spark, d):
    return lists.parse(X.conv_manifests(spark, d)).where(F.col("error").isNotNull()).select("list_id", "error")


def _manifest_report(spark, d):
    return manifest.verify_manifests(X.conv_manifests(spark, d), X.conv_ledger(spark, d), X.devices(spark, d))


def manifest_verify(spark, d):
    return _manifest_report(spark, d).entries.select("list_id", *big("line"), "hash", "status", "session_id", *big("seq"))


def manifest_counts(spark, d):
    return manifest.manifest_counts(_manifest_report(spark, d).entries)


QUERIES = {
    f.__name__: f
    for f in (
        global_verdict, file_verdicts, status_summary, evidence_coverage, session_report,
        mutated_ledger_verdict, review_report, report_sessions, report_time_gaps, report_records, file_hash_lookup, duplicate_submissions, filename_hint,
        variant_comparison, size_change, omit_middle, swapped_names, selected_footage, folder_listing,
        admitted_files, session_sources, upload_objects, stored_objects, content_read, manifest_files, manifest_parse, manifest_errors,
        manifest_verify, manifest_counts, manifest_report,
    )
}

_COUNTS = """count(*) as n_files, count(*) filter (status = 'AUTHENTIC') as n_authentic,
  count(*) filter (status = 'MODIFIED') as n_modified, count(*) filter (status = 'FORGED') as n_forged,
  count(*) filter (status = 'UNKNOWN') as n_unknown, count(*) filter (status = 'DUPLICATE') as n_duplicate"""
_SUMMARY = """n_files || ' file(s) checked: ' || n_authentic || ' authentic, ' || n_modified || ' modified, ' || n_forged ||
  ' forged, ' || n_unknown || ' unknown, ' || n_duplicate || ' duplicate.'"""
_GLOBAL = f"""select c.submission_id, case when file_bad or coalesce(audit_bad, false) then 'TAMPERED'
    when coalesce(db_gap, false) or coalesce(ev_gap, false) then 'INCOMPLETE' else 'AUTHENTIC' end as verdict,
  n_files, n_authentic, n_modified, n_forged, n_unknown, n_duplicate, {_SUMMARY} as summary
from (select submission_id, {_COUNTS},
    bool_or(status in ('MODIFIED', 'UNKNOWN', 'FORGED') or problems <> '') as file_bad from verdict group by 1) c
left join (select submission_id, bool_or(audit_bad) as audit_bad, bool_or(n_missing_in_db > 0) as db_gap
    from involved join session_stats using (session_id) group by 1) a using (submission_id)
left join (select submission_id, bool_or(n_missing_in_evidence > 0) as ev_gap from cover group by 1) g using (submission_id)"""

_OBJECTS = """objects as (select case when page_id % 17 = 0 then page_id || '.webm' else (page_id % 40) || '/' || page_id || '.webm' end as name,
  strlen(html)::bigint as size, page_id * 1000 as created_ms from pages)"""

_MANIFEST = f"""
lines as (
  select list_id, unnest(items) as raw, generate_subscripts(items, 1) as line from (
    select conv_id as list_id, list_concat(h[1:1], case when conv_id % 50 = 49 then ['not-a-hash'] else [] end,
      h[2:], h[1:1], case when conv_id % 4 = 0 then ['{S.ZEROS}'] else [] end) as items
    from (select conv_id, list(segment_hash order by seq) as h from seg group by 1) t) u
),
listed as (select list_id, line, lower(raw) as hash from lines where list_id % 50 <> 49),
clean as (select session_id, bool_and(problems = '') and sum(n_missing_before) = 0 as session_clean from chk group by 1),
known as (
  select segment_hash as hash, bool_or(valid) as valid, arg_min(session_id, (not valid)::int) as session_id, arg_min(seq, (not valid)::int) as seq
  from (select c.segment_hash, c.session_id, c.seq, c.problems = '' and session_clean as valid
        from chk c join clean using (session_id)) t group by 1),
matched as (
  select list_id, line, l.hash, turn,
    case when turn > 1 then 'DUPLICATE' when valid is null then 'NOT_FOUND' when valid then 'REGISTERED' else 'INVALID_RECORD' end as status,
    case when turn = 1 then k.session_id end as session_id, case when turn = 1 then k.seq end as seq
  from (select *, row_number() over (partition by list_id, hash order by line) as turn from listed) l
  left join known k on l.hash = k.hash)"""

# any altered byte changes the hash, so a marked body stands for each altered variant
_VARIANT_FILES = S.FILES.replace("files as (", "plain as (", 1) + """,
files as (
  select submission_id * 10 + v.i as submission_id, v.name as variant, submission_id as submission, k, ord, p.name,
    case when v.i between 1 and 5 then v.name || '|' || body else body end as body
  from (select *, row_number() over (partition by submission_id order by ord) - 1 as pos, count(*) over (partition by submission_id) // 2 as mid from plain) p
  cross join (values (0, 'original'), (1, 'bit'), (2, 'block'), (3, 'cut'), (4, 'shift'), (5, 'invert'), (6, 'omit')) v(i, name)
  where v.i <> 6 or (pos <> mid and pos <> mid + 1)
)"""

ORACLES = {
    "variant_comparison": S.with_ledger(
        "select submission as submission_id, variant, verdict, n_files, n_modified, n_unknown from (select distinct submission, variant, submission_id from files) f join ("
        + _GLOBAL + ") g using (submission_id)", _VARIANT_FILES, S.VERDICTS),
    "global_verdict": S.with_verdicts(_GLOBAL),
    "file_verdicts": S.with_verdicts("""select submission_id, ord, name, actual_hash, size, status, c_session as session_id, c_seq as seq,
  matched_by, renamed, anchor_delay_ms, problems, warnings from verdict"""),
    "status_summary": S.with_verdicts(f"select *, {_SUMMARY} as summary from (select submission_id, {_COUNTS} from verdict group by 1) t"),
    "evidence_coverage": S.with_verdicts("select * from cover"),
    "session_report": S.with_verdicts(f"""
select submission_id, session_id, 0::bigint as part, n_records, n_signature_ok, n_links_broken, n_missing_in_db, n_submitted, n_missing_in_evidence,
  missing_in_evidence, concat_ws(' | ', nullif({SESSION_PROBLEMS}, ''), case when missing_in_evidence <> ''
    then 'Evidence is missing segment(s) ' || missing_in_evidence || ' inside the submitted time range.' end) as problems, '' as warnings,
  'Session ' || substr(session_id, 1, 8) || ': ' || n_records || ' server record(s), ' || n_signature_ok || ' valid signature(s), ' ||
  n_links_broken || ' broken link(s), ' || n_missing_in_evidence || ' segment(s) missing from evidence.' as summary
from involved join ({AUDIT_SELECT}) a using (session_id) join cover using (submission_id, session_id)
join (select submission_id, session_id, coalesce(string_agg(case when seq - prev = 2 then '#' || (seq - 1)
      else '#' || (prev + 1) || '–#' || (seq - 1) end, ', ' order by seq) filter (seq > prev + 1), '') as missing_in_evidence
    from (select *, lag(seq) over (partition by submission_id, session_id order by seq) as prev from have) t group by 1, 2) m
  using (submission_id, session_id)"""),
    "report_sessions": S.with_verdicts(f"""
select submission_id, session_id, 0::bigint as part, device_id, device_label, first_seq, last_seq, n_records, genesis_ok, n_time_gaps, missing_in_db
from involved join ({AUDIT_SELECT}) a using (session_id)"""),
    "report_time_gaps": S.with_verdicts(f"""select submission_id, session_id, seq, gap_ms, 'Time gap of ' || {S.duration('gap_ms')} || ' before seq ' || seq || '.' as warning
from involved join chk using (session_id) where gap_ms > 2000"""),
    "report_records": S.with_verdicts("""select submission_id, session_id, seq, id, chain_ok, signature_ok, link_ok, problems
from involved join chk using (session_id)"""),
    "mutated_ledger_verdict": S.with_verdicts(_GLOBAL).replace("from led window w", "from moved window w").replace(
        "chk as (", """moved as (select * exclude (started_at, ended_at), started_at - case when seq = 2 then 60000 else 0 end as started_at,
  ended_at - case when seq = 2 then 60000 else 0 end as ended_at from led),
chk as (""", 1).replace("select c.submission_id, case", "select submission_id, verdict, n_forged from (select c.submission_id, case", 1) + ") q",
    "file_hash_lookup": """select doc_id, h as actual_hash, s as session_id, q as seq from (
  select doc_id, sha256(text) as h, first_value(source) over w as s, first_value(doc_id) over w as q from documents
  window w as (partition by text order by doc_id % 97 desc, source desc, doc_id desc)) t""",
    "duplicate_submissions": "select doc_id, sha256(text) as content_hash from (select *, row_number() over (partition by text order by doc_id) as r from documents) t where r > 1",
    "filename_hint": S.with_verdicts("select submission_id, ord, name, hint_session, hint_seq from hinted"),
    "size_change": f"""with {S.SEGMENTS}, {S.FILES} select submission_id, count(*) as n_before, count(*) as n_after,
  sum(size)::bigint as bytes_before, sum(cut)::bigint as bytes_after, 0::bigint as n_removed,
  floor((1 - sum(cut)::double / sum(size)::double) * 100 + 0.5::double)::bigint as percent_smaller
from (select submission_id, strlen(body) as size, floor(strlen(body) * 0.8::double)::bigint as cut from files) t group by 1""",
    "omit_middle": f"""with {S.SEGMENTS}, {S.FILES} select submission_id, ord, name from (
  select *, row_number() over (partition by submission_id order by ord) - 1 as pos, count(*) over (partition by submission_id) // 2 as mid from files) t
where pos <> mid and pos <> mid + 1""",
    "swapped_names": f"""with {S.SEGMENTS}, {S.FILES} select submission_id, ord, coalesce(lead(name) over w, lag(name) over w, name) as name
from files window w as (partition by submission_id, ord // 2 order by ord)""",
    "selected_footage": S.with_verdicts("select coalesce(hint_session, 'unidentified') as session_id, count(*) as n_files, sum(size)::bigint as n_bytes from hinted group by 1"),
    "folder_listing": f"with {_OBJECTS} select split_part(name, '/', 1) as folder, split_part(name, '/', 2) as file_name, name as path, size from objects where contains(name, '/')",
    "admitted_files": """select name from (select page_id, page_id || (['.webm', '.MP4', '.mkv', '.mov', '.avi', '.txt', 'webm'])[page_id % 7 + 1] as name from pages) t
where page_id % 10 = 4 or regexp_matches(name, '(?i)\\.(webm|mp4|mkv|mov)$')""",
    "session_sources": S.with_ledger("""
select session_id, 'clip_' || session_id || '_' || printf('%05d', seq::int) || '.webm' as file_name,
  case when conv_id % 4 < 3 then byte_size end as size, case when conv_id % 4 = 2 then 'cloud' else 'local' end as origin,
  case when conv_id % 4 = 3 then 'Synthetic placeholder (video not available locally or in the cloud)' end as note
from led where conv_id % 4 >= 2 or seq % 2 = 0""", checks=False),
    "upload_objects": f"with {_OBJECTS} select name, size, created_ms from objects where size % 2 <> 0",
    "stored_objects": """select 'doc/' || (doc_id // 2) || '.txt' as name, strlen(text)::bigint as size, sha256(text) as address, sha256(text) as content_hash,
  case when doc_id % 3 = 0 then 1000 else 2000 end::bigint as created_ms
from (select *, row_number() over (partition by doc_id // 2 order by (doc_id % 3 <> 0)::int, doc_id) as r from documents where text is not null) t where r = 1""",
    "content_read": """select conv_id, strlen(body)::bigint as size, sha256(body) as content_hash, true as named_by_path
from (select conv_id, string_agg(coalesce(text, '') || chr(10), '' order by turn, text) as body from conversations group by 1) t""",
    "manifest_parse": f"with recursive {S.SEGMENTS}, {S.CHAINS}, {S.LEDGER}, {S.CHECKS}, {_MANIFEST} select list_id, line, hash from listed",
    "manifest_files": f"with recursive {S.SEGMENTS}, {S.CHAINS}, {S.LEDGER}, {S.CHECKS}, {_MANIFEST} select list_id, line, hash from listed",
    "manifest_errors": "select distinct conv_id as list_id, 'Line 2 must start with a 64-character SHA-256 hash.' as error from conversations where conv_id % 50 = 49",
    "manifest_verify": S.with_ledger("select list_id, line, hash, status, session_id, seq from matched", _MANIFEST),
    "manifest_report": S.with_ledger("select list_id, line, hash, status, session_id, seq from matched", _MANIFEST),
    "manifest_counts": S.with_ledger("""select list_id, count(*) as n_supplied, count(*) filter (status = 'REGISTERED') as n_registered,
  count(*) filter (status in ('NOT_FOUND', 'INVALID_RECORD')) as n_not_valid, count(*) filter (status = 'DUPLICATE') as n_repeated
from matched group by 1""", _MANIFEST),
}
