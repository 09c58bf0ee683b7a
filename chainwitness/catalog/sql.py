"""SQL building blocks of the oracle statements."""

from chainwitness import fixed_values as V

PROTOCOL = V.DEFAULT_PROTOCOL
ZEROS = "0" * 64


def uuid(tag, ident):
    h = f"sha256('{tag}|' || ({ident})::varchar)"
    return " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))


def text(value):
    return "'" + value.replace("'", "''") + "'"


def duration(ms):
    s = f"floor(({ms})/1000.0::double + 0.5)::bigint"
    return (
        f"(case when {s} < 60 then {s} || ' s' when {s} // 60 < 60 "
        f"then ({s} // 60) || ' min ' || ({s} % 60) || ' s' "
        f"else ({s} // 3600) || ' h ' || (({s} // 60) % 60) || ' min' end)"
    )


def joined(*pairs, sep=" | "):
    """The texts whose condition holds, in order."""
    items = ", ".join(f"case when {cond} then {value} end" for cond, value in pairs)
    return f"concat_ws('{sep}', {items})"


def canonical(prev="prev_chain_hash"):
    fields = [
        f"'{PROTOCOL}'", "device_id", "session_id", "seq::varchar", "started_at::varchar",
        "ended_at::varchar", "'75'", "byte_size::varchar", "'video/webm'", "'1280'", "'720'",
        "coalesce(printf('%.6f', lat), '')", "coalesce(printf('%.6f', lon), '')", "segment_hash", prev,
    ]
    return " || '|' || ".join(fields)


# session segments, hash chains, the ledger with its defects, and its checks
SEGMENTS = f"""
seg as (
  select conv_id, conv_id % 10 as k, seq, n, txt, session_id, device_id,
    {uuid('ROW', "conv_id || ':' || seq")} as id,
    sha256(txt) as segment_hash, strlen(txt)::bigint as byte_size,
    1700000000000 + conv_id * 3600000 + seq * 5000 as started_at,
    1700000000000 + conv_id * 3600000 + seq * 5000 + 5000 as ended_at,
    case when conv_id % 10 <> 5 then 49 + (conv_id % 1000) / 1000.0::double end as lat,
    case when conv_id % 10 <> 5 then 1 + (conv_id % 1000) / 1000.0::double end as lon
  from (
    select conv_id, row_number() over (partition by conv_id order by turn) - 1 as seq,
      count(*) over (partition by conv_id) as n,
      conv_id || '|' || turn || '|' || text as txt,
      {uuid('SES', 'conv_id')} as session_id, {uuid('DEV', 'conv_id % 8')} as device_id
    from conversations) t
)"""
CHAINS = f"""
fold as (
  select conv_id, seq, sha256('GENESIS|' || session_id) as prev_chain_hash,
    sha256({canonical("sha256('GENESIS|' || session_id)")}) as chain_hash
  from seg where seq = 0
  union all
  select s.conv_id, s.seq, f.chain_hash, sha256({canonical('f.chain_hash').replace('seq::varchar', 's.seq::varchar')})
  from seg s join fold f on s.conv_id = f.conv_id and s.seq = f.seq + 1
)"""
LEDGER = f"""
base as (
  select s.*, case when k = 6 and s.seq = 1 then '{ZEROS}' else f.prev_chain_hash end as prev_chain_hash,
    f.chain_hash as built
  from seg s join fold f on s.conv_id = f.conv_id and s.seq = f.seq
  where not (k = 3 and s.seq = 1)
),
led as (
  select * exclude (built, started_at, ended_at),
    case when k = 6 and seq = 1 then sha256({canonical()}) else built end as chain_hash,
    case when k = 2 and seq = 1 then started_at - 60000 else started_at end as started_at,
    case when k = 2 and seq = 1 then ended_at - 60000 else ended_at end as ended_at,
    ended_at + case when k = 1 then 90000 else 800 end as created_ms
  from base
)"""
CHECKS = f"""
chk as (
  select *, chain_ok and signature_ok and coalesce(link_ok, true) as fine,
    case when seq <> 0 and prev_seq = seq - 1 then started_at - prev_ended end as gap_ms,
    case when prev_seq is not null then greatest(seq - prev_seq - 1, 0) else 0 end as n_missing_before,
    {joined(("not chain_ok", text(V.RECORD_BAD_CHAIN)), ("not signature_ok", text(V.RECORD_BAD_SIGNATURE)),
            ("not coalesce(link_ok, true)", text(V.RECORD_BAD_LINK)))} as problems
  from (
    select *, sha256({canonical()}) = chain_hash as chain_ok,
      not (k = 4 and seq = 0) as signature_ok,
      case when seq = 0 then prev_chain_hash = sha256('GENESIS|' || session_id)
           when prev_seq = seq - 1 then prev_chain_hash = prev_chain end as link_ok
    from (
      select *, lag(seq) over w as prev_seq, lag(chain_hash) over w as prev_chain,
        lag(ended_at) over w as prev_ended
      from led window w as (partition by session_id order by seq)) t) u
)"""


def with_ledger(select, *more, checks=True):
    parts = [SEGMENTS, CHAINS, LEDGER] + ([CHECKS] if checks else []) + list(more)
    return "with recursive " + ",".join(parts) + "\n" + select


# submitted files and what the verification derives from them
FILES = """
files as (
  select conv_id as submission_id, k, seq as ord, txt || case when k = 8 and seq = 1 then '!' else '' end as body,
    'clip_' || session_id || '_' || printf('%05d', (case when conv_id % 20 = 10 and seq < 2 then 1 - seq else seq end)::int) || '.webm' as name
  from seg
  where not (k = 3 and seq = 1) and not (conv_id % 20 = 11 and n >= 3 and seq = 1)
  union all
  select conv_id, k, 1000000, txt, 'clip_' || session_id || '_00000.webm' from seg where seq = 0 and k = 7
  union all
  select conv_id, k, 1000000, 'unregistered ' || conv_id, 'holiday_' || conv_id || '.webm' from seg where seq = 0 and k = 9
)"""
VERDICTS = f"""
hinted as (
  select *, sha256(body) as actual_hash, strlen(body)::bigint as size,
    nullif(lower(regexp_extract(name, '(?i)clip_([0-9a-f-]{{36}})_(\\d+)\\.', 1)), '') as hint_session,
    nullif(regexp_extract(name, '(?i)clip_([0-9a-f-]{{36}})_(\\d+)\\.', 2), '')::bigint as hint_seq
  from files
),
best as (
  select segment_hash, session_id, seq from (
    select *, row_number() over (partition by segment_hash order by created_ms desc, session_id desc, seq desc) as r from led) t
  where r = 1
),
looked as (
  select h.*, b.segment_hash is not null as by_hash, h.hint_session is not null as named,
    c.session_id is not null as known, c.session_id as c_session, c.seq as c_seq, c.byte_size as c_size,
    c.segment_hash as c_hash, c.chain_ok, c.signature_ok, coalesce(c.link_ok, true) as link_fine,
    c.created_ms - c.ended_at as delay
  from hinted h left join best b on h.actual_hash = b.segment_hash
  left join chk c on c.session_id = coalesce(b.session_id, h.hint_session) and c.seq = coalesce(b.seq, h.hint_seq)
),
verdict as (
  select *, case when by_hash and again > 1 then 'DUPLICATE'
      when by_hash and not (chain_ok and signature_ok) then 'FORGED'
      when by_hash and c_hash <> actual_hash then 'MODIFIED'
      when by_hash then 'AUTHENTIC' when known then 'MODIFIED' else 'UNKNOWN' end as status,
    case when by_hash then 'hash' when known then 'filename' end as matched_by,
    by_hash and named and (hint_session <> c_session or hint_seq <> c_seq) as renamed,
    case when by_hash then delay end as anchor_delay_ms,
    {joined(
        ("by_hash and c_hash <> actual_hash", text(V.FILE_HASH_CHANGED)),
        ("by_hash and c_size <> size", text(V.FILE_SIZE_CHANGED)),
        ("by_hash and not signature_ok", text(V.FILE_BAD_SIGNATURE)),
        ("by_hash and not chain_ok", text(V.FILE_BAD_CHAIN)),
        ("by_hash and not link_fine", text(V.FILE_BAD_LINK)),
        ("not by_hash and known", text(V.FILE_CONTENT_DIFFERS)),
        ("not by_hash and known and c_size <> size",
         "'Size ' || format('{:,}', size) || ' B ≠ recorded ' || format('{:,}', c_size) || ' B.'"),
        ("not by_hash and named and not known", text(V.FILE_NO_RECORD)),
        ("not by_hash and not named", text(V.FILE_NO_HINT)))} as problems,
    {joined(
        ("by_hash and named and (hint_session <> c_session or hint_seq <> c_seq)",
         "'File name says seq ' || hint_seq || ' but content is seq ' || c_seq || ' — file renamed or reordered.'"),
        ("by_hash and delay > 60000",
         "'Hash anchored ' || " + duration('delay') + " || ' after capture (buffered while offline).'"),
        ("by_hash and again > 1", text(V.FILE_REPEATED)))} as warnings
  from (
    select *, row_number() over (partition by submission_id, by_hash, c_session, c_seq order by ord) as again
    from looked) t
),
involved as (select distinct submission_id, coalesce(c_session, hint_session) as session_id from looked
             where coalesce(c_session, hint_session) is not null),
have as (select distinct submission_id, c_session as session_id, c_seq as seq from verdict
         where c_session is not null and status <> 'DUPLICATE'),
cover as (
  select submission_id, session_id, count(*) as n_submitted, min(seq) as first_submitted,
    max(seq) as last_submitted, max(seq) - min(seq) + 1 - count(*) as n_missing_in_evidence
  from have group by 1, 2),
session_stats as (
  select session_id, count(*) as n_records, min(seq) as first_seq, max(seq) as last_seq,
    count(*) filter (signature_ok) as n_signature_ok, count(*) filter (chain_ok) as n_chain_ok,
    count(*) filter (not link_ok) as n_links_broken, sum(n_missing_before)::bigint as n_missing_in_db,
    count(*) filter (problems <> '') as n_bad, bool_or(not fine) as audit_bad
  from chk group by 1)"""


def with_verdicts(select):
    return with_ledger(select, FILES, VERDICTS)


# arrival rows of the events table
EVENTS = f"""
evt as (
  select event_id::varchar as id, event_id, event_type, user_id::varchar as session_id,
    (user_id % 8)::varchar as device_id, ts, started_at, ended_at,
    ended_at + case when event_id % 37 = 0 then 61000 when event_id % 41 = 0 then 60000 else 800 end as created_ms,
    case when event_id % 53 = 0 then 'bad' else 'ok' end as "check", event_id % 11 = 0 as locked,
    strlen(props)::bigint as byte_size,
    row_number() over (partition by user_id order by ts, event_id) - 1 as seq
  from (select *, epoch_us(ts) // 1000 as started_at,
          epoch_us(ts) // 1000 + 1000 + event_id % 4000 as ended_at from events) t
)"""


def with_events(select, *more):
    return "with " + ",".join([EVENTS, *more]) + "\n" + select
