"""Tables of the distinct chunks of texts and their token ids, kept as numpy arrays between batches.

A chunk is a span of bytes at whose ends every encoding has a token boundary. A table has a
fixed number of slots; a chunk's 64-bit name picks the slot, the latest chunk there stays. All
known chunks of a batch are found by one gather, and only the distinct unknown ones are encoded.
"""

import numpy as np

from chainwitness.llm.words import byte_names

SLOTS = 1 << 21  # 16 bytes each
POOL = 12_000_000  # ids of 4 bytes
LONG = 64  # longer chunks are not kept


def spans(starts, sizes):
    """All places of the spans of ``sizes`` from ``starts``, one span after the other."""
    stops = np.cumsum(sizes)
    return np.repeat(starts - stops + sizes, sizes) + np.arange(int(stops[-1]) if len(stops) else 0)


def taken(data, starts, ends):
    """The bytes of each span."""
    whole = data.tobytes()
    return [whole[b:e] for b, e in zip(starts.tolist(), ends.tolist())]


class ChunkTable:
    """Token ids of chunks; ``encode_new`` gives the ids (one array) and their number of each span of some bytes."""

    def __init__(self, encode_new, slots=SLOTS, pool=POOL):
        self.encode_new, self.shift = encode_new, np.uint64(64 - (slots.bit_length() - 1))
        self.names, self.starts, self.sizes = np.zeros(slots, np.uint64), np.zeros(slots, np.int32), np.full(slots, -1, np.int32)
        self.pool, self.used = np.empty(pool, np.int32), 0

    def encode(self, data, begins, ends):
        """Ids of all chunks [begin, end) of ``data`` in one array, and the number of ids of each chunk."""
        names = byte_names(data, begins, ends)
        slot = (names >> self.shift).astype(np.int64)
        starts, sizes = self.starts[slot].astype(np.int64), self.sizes[slot].astype(np.int64)
        unknown = np.flatnonzero((self.names[slot] != names) | (sizes < 0))
        if not len(unknown):
            return self.pool[spans(starts, sizes)], sizes
        _, index, inverse = np.unique(names[unknown], return_index=True, return_inverse=True)
        new = unknown[index]
        ids, counts = self.encode_new(data, begins[new], ends[new])
        counts = np.asarray(counts, np.int64)
        places, full = self.used + np.cumsum(counts) - counts, self.used + len(ids) > len(self.pool)
        pool = np.concatenate((self.pool[:self.used], ids)) if full else self.pool
        pool[self.used:self.used + len(ids)] = ids
        starts[unknown], sizes[unknown] = places[inverse], counts[inverse]
        found = pool[spans(starts, sizes)]
        if full:  # begin again; chunks that are frequent come back with the next batch
            self.sizes[:], self.used = -1, 0
        else:
            self.used += len(ids)
            kept = np.flatnonzero(ends[new] - begins[new] <= LONG)
            at = slot[new[kept]]
            self.names[at], self.starts[at], self.sizes[at] = names[new[kept]], places[kept], counts[kept]
            # of several new chunks with one slot numpy keeps the last in each array, so the three stay together
        return found, sizes
