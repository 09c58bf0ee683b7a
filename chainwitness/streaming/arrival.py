"""Check on arrival with state: each record meets the chain hash of the one before it.

State is keyed by a session and a stretch of its sequence numbers, so that a busy session spreads over
state partitions. Under a key lie the chain hashes that records of the stretch refer to, the
records that wait for theirs, and the ids seen; each entry ends ``ttl`` after it was written. A stream may
start warm: the newest records of a stored ledger enter as initial state.

The RocksDB state store is needed: ``session_for_state`` gives a session that has it.
"""

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from chainwitness import fixed_values as V

STRETCH = 1024
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RESULT = "id string, session_id string, seq int, note string, link_ok boolean"
_KEY = ["session_id", "stretch"]


def session_for_state(spark):
    """A session beside ``spark`` with the state store that this module needs; the settings of ``spark`` stay."""
    own = spark.newSession()
    for name in ("spark.sql.session.timeZone", "spark.sql.shuffle.partitions"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # state with an end in processing time asks for batches without data for ever, so that a drained stream would not end
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    return own


def _stretch(seq):
    return F.floor(seq / F.lit(STRETCH)).cast("long")


def _places(rows, note):
    """Each record where it is judged, and, as the one before, where the next one is judged."""
    place = lambda shift, before: F.struct(_stretch(F.col("seq") + shift).alias("stretch"), F.lit(before).alias("before"))
    places = F.explode(F.array(place(0, False), place(1, True))).alias("_place")
    return rows.select("session_id", F.col("seq").cast("int").alias("seq"), "id", "prev_chain_hash", "chain_hash", note.alias("note"), places).select(
        "session_id", "_place.stretch", "seq", "id", "prev_chain_hash", "chain_hash", "note", "_place.before")


class _Links(StatefulProcessor):
    """State: ``chains`` seq -> chain hash, ``waiting`` seq -> records that came before their predecessor, ``ids`` seen."""

    def __init__(self, ttl_ms):
        self.ttl_ms = ttl_ms

    def init(self, handle):
        self.chains = handle.getMapState("chains", "seq int", "chain_hash string", self.ttl_ms)
        self.waiting = handle.getMapState("waiting", "seq int", "records string", self.ttl_ms)
        self.ids = handle.getMapState("ids", "id string", "seq int", self.ttl_ms)

    def _known(self, seq):
        return self.chains.getValue((seq,))[0] if self.chains.containsKey((seq,)) else None

    def _late(self, seq):
        return json.loads(self.waiting.getValue((seq,))[0]) if self.waiting.containsKey((seq,)) else []

    def handleInitialState(self, key, initialState, timerValues):
        for seq, chain_hash in zip(initialState["seq"].tolist(), initialState["chain_hash"].tolist()):
            if chain_hash is not None and not self.chains.containsKey((seq,)):
                self.chains.updateValue((seq,), (chain_hash,))

    def handleInputRows(self, key, rows, timerValues):
        found, records, chains = [], [], {}
        for frame in rows:
            for seq, ident, prev, chain, note, before in zip(*(frame[c].tolist() for c in ("seq", "id", "prev_chain_hash", "chain_hash", "note", "before"))):
                if before:
                    chains.setdefault(seq, chain)  # of several with one number the first stands
                else:
                    records.append((seq, ident, prev, note))
        for seq, chain in list(chains.items()):
            known = self._known(seq)
            if known is not None:
                chains[seq] = known
            elif chain is not None:
                self.chains.updateValue((seq,), (chain,))
                late = self._late(seq + 1)
                found += [(ident, key[0], seq + 1, note, prev == chain) for ident, prev, note in late]
                if late:
                    self.waiting.removeKey((seq + 1,))
        late, seen = {}, set()
        for seq, ident, prev, note in records:
            if ident in seen or self.ids.containsKey((ident,)):
                continue
            seen.add(ident)
            self.ids.updateValue((ident,), (seq,))
            before = None if seq == 0 else chains.get(seq - 1) or self._known(seq - 1)
            if before is None and seq > 0:
                late.setdefault(seq, []).append((ident, prev, note))
            found.append((ident, key[0], seq, note, None if before is None else prev == before))
        for seq, more in late.items():
            self.waiting.updateValue((seq,), (json.dumps(self._late(seq) + more),))
        if found:
            ids, sessions, seqs, notes, oks = zip(*found)
            yield pd.DataFrame({"id": ids, "session_id": sessions, "seq": pd.array(seqs, "int32"), "note": notes, "link_ok": pd.array(oks, "boolean")})

    def close(self):
        pass


def check_links(checked, known=None, ttl_ms=86_400_000):
    """One row for each record as it arrives, and one more if its link becomes known later.

    ``checked`` is the stream of ``live.arrival_checks``; ``known`` a DataFrame of stored records whose successors may
    arrive. ``link_ok`` is null while the record before has not arrived within ``ttl_ms`` of processing time, and for first
    records, whose link ``arrival_checks`` judges. A repeated id is dropped, wherever its copy is.
    Of several records with one number the first to arrive is what later ones link to. Append mode.
    """
    from chainwitness.session import ship_package

    ship_package(checked.sparkSession)
    rows = _places(checked, F.col("note")).groupBy(*_KEY)
    initial = None
    if known is not None:
        initial = _places(known, F.lit(None).cast("string")).where("before").select(*_KEY, "seq", "chain_hash").groupBy(*_KEY)
    return rows.transformWithStateInPandas(_Links(ttl_ms), RESULT, "Append", "ProcessingTime", initialState=initial)


def status(results):
    """The state of every record that ``check_links`` has given rows for: its arrival's notes and its link."""
    latest = results.groupBy("id", "session_id", "seq").agg(F.max("note").alias("note"), F.bool_and("link_ok").alias("link_ok"))
    broken = F.when(~F.coalesce("link_ok", F.lit(True)), V.LIVE_BAD_LINK)
    note = F.concat_ws(", ", F.when(F.col("note") != "", F.col("note")), broken)
    return latest.withColumn("note", note).withColumn("check", F.when(note == "", "ok").otherwise("bad"))
