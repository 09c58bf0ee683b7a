"""Queries on frames, digests, vectors and threshold sweeps."""

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import digests, frames, tamper, vectors
from chainwitness.operators import fuzzy, nearest, similarity
from chainwitness.plans import evaluation as ev
from chainwitness.session import spread
from chainwitness.testing import fixtures as X

COSINE_STEPS = (0.1, 0.3, 0.5, 0.7, 0.9, 1.0)


def _g():
    return F.col("grey"), F.col("width"), F.col("height")


def _weighted(values):
    """Position-weighted sum: one number that depends on every element and its place."""
    return F.aggregate(
        F.transform(values, lambda v, i: v * (i + 1)), F.lit(0).cast("bigint"), lambda acc, v: acc + v
    )


def to_grey(spark, d):
    grey = frames.to_grey(F.encode("text", "UTF-8"))
    return spread(X.table(spark, d, "documents")).select("doc_id", grey.alias("g")).select(
        "doc_id", F.size("g").cast("bigint").alias("n_pixels"), _weighted(F.col("g")).alias("checksum")
    )


def ahash(spark, d):
    return X.embedding_frames(spark, d).select("vec_id", frames.hash_hex(frames.average_hash(*_g())).alias("hash"))


def dhash(spark, d):
    return X.embedding_frames(spark, d).select("vec_id", frames.hash_hex(frames.difference_hash(*_g())).alias("hash"))


def phash(spark, d):
    return X.embedding_frames(spark, d).select(
        "vec_id", frames.hash_hex(frames.dct_hash(*_g()), frames.DCT_BITS).alias("hash")
    )


def whash(spark, d):
    return X.document_frames(spark, d).select("doc_id", frames.hash_hex(frames.wavelet_hash(*_g())).alias("hash"))


def _variant_frames(spark, d):
    """Each embedding frame and its altered copies."""
    rows = X.embedding_frames(spark, d)
    g, w, h = _g()
    kinds = {
        "original": g, "brighter": frames.brightness(g, 30), "contrast": frames.contrast(g, 1.5),
        "marked": frames.watermark(g, w, h, size=3), "cropped": frames.crop(g, w, h),
    }
    variants = F.array(*[F.struct(F.lit(k).alias("variant"), v.alias("grey")) for k, v in kinds.items()])
    return rows.withColumn("_v", F.explode(variants)).select(
        "vec_id", "label", F.col("_v.variant").alias("variant"), F.col("_v.grey").alias("grey"), "width", "height"
    )


def hamming_join(spark, d):
    rows = _variant_frames(spark, d).select("vec_id", frames.average_hash(*_g()).alias("bits"))
    near = similarity.near_hashes(rows)
    a, b = frames.hash_hex(F.col("hash_a")), frames.hash_hex(F.col("hash_b"))
    return near.select(
        F.least(a, b).alias("first_hash"), F.greatest(a, b).alias("second_hash"),
        F.col("distance").cast("bigint").alias("distance"), (F.col("n_a") * F.col("n_b")).alias("n_pairs"),
    )


def identical_hashes(spark, d):
    rows = _variant_frames(spark, d).select(frames.average_hash(*_g()).alias("bits"))
    return similarity.distinct_hashes(rows).where("n > 1").select(frames.hash_hex(F.col("bits")).alias("hash"), "n")


def hash_comparison(spark, d):
    base = X.embedding_frames(spark, d).select("vec_id", *_g()[:1], "width", "height")
    pairs = ev.frame_hashes(base, prefix="a_")
    pairs = pairs.withColumn("grey", frames.brightness(F.col("grey"), 80))
    pairs = ev.frame_hashes(pairs, prefix="b_").drop("grey", "width", "height")
    return ev.compare_hashes(pairs).select(
        "vec_id", "method", "hash", "other_hash", F.col("distance").cast("bigint").alias("distance"),
        F.round("normalised", 9).alias("normalised"), F.round("similarity", 9).alias("similarity"), "is_match",
    )


def match_decisions(spark, d):
    pairs = X.anchored_pairs(spark, d)
    w, h = F.lit(8), F.lit(8)
    distance = frames.hamming(
        frames.dct_hash(F.col("grey"), w, h), frames.dct_hash(F.col("anchor.grey"), w, h)
    )
    matched, score = ev.match_decision(F.col("distance"))
    return pairs.withColumn("distance", distance).select(
        "vec_id", "is_genuine", F.col("distance").cast("bigint").alias("distance"),
        matched.alias("matched"), score.cast("bigint").alias("score"),
    )


def feature_vector(spark, d):
    vector = frames.feature_vector(*_g())
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x)
    return X.embedding_frames(spark, d).select(
        "vec_id", F.round(total(vector), 6).alias("total"),
        F.round(total(F.transform(vector, lambda v, i: v * (i + 1))), 6).alias("weighted"),
    )


def vector_distances(spark, d):
    a, b = F.col("vector"), F.col("anchor.vector")
    return X.anchored_pairs(spark, d).select(
        "vec_id", F.col("anchor.vec_id").alias("anchor_id"), "is_genuine",
        F.round(vectors.l1_distance(a, b), 6).alias("l1"), F.round(vectors.l2_distance(a, b), 6).alias("l2"),
        F.round(vectors.cosine_distance(a, b), 6).alias("cosine"),
    )


def nearest_vectors(spark, d):
    """The ten nearest vectors of every vector whose id is divisible by 100."""
    found = nearest.nearest(X.table(spark, d, "embeddings"), F.col("vec_id") % 100 == 0, 10, "vec_id", "embedding")
    return found.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance")
    )


def threshold_sweep(spark, d):
    w, h = F.lit(8), F.lit(8)
    scored = X.anchored_pairs(spark, d).select(
        F.lit("average").alias("metric"), "is_genuine",
        frames.hamming(
            frames.average_hash(F.col("grey"), w, h), frames.average_hash(F.col("anchor.grey"), w, h)
        ).alias("score"),
    )
    return _rounded(ev.evaluate_thresholds(scored))


def _rounded(table):
    rates = ("precision", "recall", "f1", "accuracy")
    return table.select("metric", "threshold", "tp", "fp", "tn", "fn", *[F.round(r, 9).alias(r) for r in rates])


def cosine_sweep(spark, d):
    scored = X.anchored_pairs(spark, d).select(
        F.lit("cosine similarity").alias("metric"), "is_genuine",
        F.round(vectors.cosine_similarity(F.col("vector"), F.col("anchor.vector")), 6).alias("score"),
    )
    return _rounded(ev.evaluate_thresholds(scored, COSINE_STEPS, higher_is_better=True))


def evaluation_summary(spark, d):
    limit = F.lit(0.5)
    cases = X.anchored_pairs(spark, d).select(
        F.col("is_genuine").alias("expected"),
        (F.round(vectors.cosine_distance(F.col("vector"), F.col("anchor.vector")), 6) <= limit).alias("detected"),
    )
    return ev.evaluation_summary(cases)


def ssdeep_digest(spark, d):
    digest = digests.fuzzy_digest(F.encode("text", "UTF-8"))
    return spread(X.table(spark, d, "documents")).select("doc_id", digest.alias("f")).select("doc_id", "f.*")


def ssdeep_similarity(spark, d):
    """Each text against a copy with one bit flipped and a copy cut to four fifths."""
    content = F.encode("text", "UTF-8")
    rows = spread(X.table(spark, d, "documents")).select(
        "doc_id", digests.fuzzy_digest(content).alias("a"),
        digests.fuzzy_digest(tamper.flip_one_bit(content)).alias("flipped"),
        digests.fuzzy_digest(tamper.truncate(content)).alias("cut"),
    )
    return rows.select(
        "doc_id", digests.fuzzy_similarity(F.col("a"), F.col("flipped")).alias("flipped_score"),
        digests.fuzzy_similarity(F.col("a"), F.col("cut")).alias("cut_score"),
    )


def ssdeep_near_dups(spark, d):
    """Classes of texts whose fuzzy digests score 80 or more, and the other texts that each is linked with."""
    digest = digests.fuzzy_digest(F.encode("text", "UTF-8"))
    found = fuzzy.fuzzy_classes(spread(X.table(spark, d, "documents")).select("doc_id", digest.alias("digest")), 80, "doc_id")
    return found.select(F.col("id").alias("doc_id"), "n_links", "class_id")


def tlsh_digest(spark, d):
    digest = digests.locality_digest(F.encode("text", "UTF-8"))
    return spread(X.table(spark, d, "documents")).select("doc_id", digest.alias("f")).select(
        "doc_id", F.col("f.checksum").cast("bigint").alias("checksum"),
        F.col("f.length_bucket").cast("bigint").alias("length_bucket"), F.lower(F.hex("f.body")).alias("body"),
    )


def tlsh_distance(spark, d):
    content = F.encode("text", "UTF-8")
    rows = spread(X.table(spark, d, "documents")).select(
        "doc_id", digests.locality_digest(content).alias("a"),
        digests.locality_digest(tamper.truncate(content)).alias("b"),
    )
    distance = digests.locality_distance(F.col("a"), F.col("b"))
    return rows.select("doc_id", distance.cast("bigint").alias("distance"))


def metric_comparison(spark, d):
    """All nine metrics of each document frame against three altered copies."""
    base = X.document_frames(spark, d).where(F.col("height") > 0)
    changes = {"brighter": frames.brighter(30), "marked": frames.marked(), "reversed": frames.turned}
    pairs = ev.described_copies(base, changes)
    table = pairs.select("doc_id", "variant", *[c.alias(n) for n, c in ev.metric_columns().items()])
    return table.withColumn("missed", F.array_join(ev.within_limits(), ","))


def tamper_bytes(spark, d):
    content = F.encode("text", "UTF-8")
    digest = lambda c: F.sha2(c, 256)
    return spread(X.table(spark, d, "documents")).select(
        "doc_id", digest(tamper.flip_one_bit(content)).alias("flipped"),
        digest(tamper.zero_block(content)).alias("zeroed"), digest(tamper.truncate(content)).alias("cut"),
        digest(tamper.invert_block(content)).alias("inverted"), digest(tamper.shift_block(content)).alias("shifted"),
    )


def perturb_frames(spark, d):
    g, w, h = _g()
    rows = X.embedding_frames(spark, d)
    return rows.select(
        "vec_id", _weighted(frames.brightness(g, 80)).alias("brighter"), _weighted(frames.brightness(g, -80)).alias("darker"),
        _weighted(frames.contrast(g, 1.5)).alias("contrast"), _weighted(frames.watermark(g, w, h, size=3)).alias("marked"),
        _weighted(frames.crop(g, w, h)).alias("cropped"), _weighted(F.reverse(g)).alias("reversed"),
        _weighted(frames.splice(g, F.reverse(g))).alias("spliced"),
    )


def perturb_noise(spark, d):
    g, seed = F.col("grey"), F.col("vec_id")
    return X.embedding_frames(spark, d).select(
        "vec_id", _weighted(frames.salt_and_pepper(g, 0.01, seed)).alias("salted"),
        _weighted(frames.gaussian_like(g, 8.0, seed)).alias("noisy"), _weighted(frames.dropout(g, 0.05, seed)).alias("dropped"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        to_grey, ahash, dhash, phash, whash, hamming_join, identical_hashes, hash_comparison,
        match_decisions, feature_vector, vector_distances, nearest_vectors, threshold_sweep, cosine_sweep,
        evaluation_summary, ssdeep_digest, ssdeep_similarity, ssdeep_near_dups, tlsh_digest, tlsh_distance,
        metric_comparison, tamper_bytes, perturb_frames, perturb_noise,
    )
}

# bit lists, 64 or 63 long, and their 16 hex digits
_HEX = """array_to_string(list_transform(range(0, 16), lambda i: printf('%x', (8 * coalesce(bits[4*i+1], 0) + 4 * coalesce(bits[4*i+2], 0)
  + 2 * coalesce(bits[4*i+3], 0) + coalesce(bits[4*i+4], 0))::int)), '')"""
_EMB = """emb as (select vec_id, label, list_transform(embedding, lambda v: v::double) as x,
  list_transform(embedding, lambda v: least(255, greatest(0, floor(v::double * 220 + 128)))::int) as g from embeddings)"""
_AVG = "list_transform({g}, lambda v: (v * 64 >= list_sum({g}))::int)"
_DIFF = """list_transform(range(0, 64), lambda i: ({g}[(i // 8) * 8 + least(floor((i % 8) * (8 / 9.0::double)), 7)::int + 1]
  > {g}[(i // 8) * 8 + least(floor((i % 8 + 1) * (8 / 9.0::double)), 7)::int + 1])::int)"""


def _dct(source, key):
    """Bits of the 63 lowest DCT terms of the 8x8 frames ``g`` of a relation."""
    return f"""px as (select {key}, i // 8 as y, i % 8 as x, g[i + 1]::double as v from {source}, unnest(range(0, 64)) as u(i)),
wave as (select n, k, cos(pi() / 32 * (n + 0.5) * k) as c from range(0, 32) a(n), range(0, 8) b(k)),
fold8 as (select n // 4 as m, k, sum(c) as c from wave group by 1, 2),
half as (select {key}, px.x as x, w.k as ky, sum(v * c) as s from px join fold8 w on px.y = w.m group by all),
terms as (select {key}, ky, w.k as kx, sum(s * c) as t from half h join fold8 w on h.x = w.m group by all),
low as (select *, avg(t) over (partition by {key}) as mean from terms where ky + kx > 0),
dct as (select {key}, list((t >= mean)::int order by ky, kx) as bits from low group by {key})"""


_BYTES = """bytes as (select doc_id, variant, regexp_extract_all(h, '..') as b, strlen(h) // 2 as n from (
  select doc_id, 'whole' as variant, hex(encode(text)) as h from documents
  union all select doc_id, 'cut', substr(hex(encode(text)), 1, 2 * floor(strlen(text) * 0.8::double)::int) from documents) t),
ints as (select doc_id, variant, n, list_transform(b, lambda x: ('0x' || x)::int) as b from bytes)"""
_LOCALITY = f"""{_BYTES},
rolled as (select doc_id, variant, (b[i] * 923521 + b[i-1] * 29791 + b[i-2] * 961 + b[i-3] * 31 + b[i-4]) % 256 as h
  from ints, unnest(range(5, n + 1)) as u(i)),
counts as (select doc_id, variant, h, count(*) as c from rolled group by all),
full_counts as (select i.doc_id, i.variant, k as h, coalesce(c, 0) as c from ints i cross join range(0, 256) r(k)
  left join counts c on c.doc_id = i.doc_id and c.variant = i.variant and c.h = k),
quart as (select doc_id, variant, list_sort(list(c))[65] as q1, list_sort(list(c))[129] as q2 from full_counts group by all),
coded as (select f.doc_id, f.variant, h, case when c < q1 then 0 when c < q2 then 1 when c < q2 * 2 then 2 else 3 end as v
  from full_counts f join quart q using (doc_id, variant) where h < 128),
octets as (select doc_id, variant, h // 4 as o, sum(v << (2 * (h % 4))::int)::int as v from coded group by all),
bodies as (select doc_id, variant, string_agg(printf('%02x', v), '' order by o) as body from octets group by all),
heads as (select doc_id, variant, coalesce(list_sum(b), 0)::bigint % 256 as checksum,
  least(255, floor(log2(greatest(n, 1)) * 10))::bigint as length_bucket from ints)"""
_PAIRS = f"""{_EMB},
pairs as (select e.vec_id, a.vec_id as anchor_id, e.label = a.label as is_genuine, e.x, a.x as y, e.g, a.g as h
  from emb e join (select label, arg_min(vec_id, vec_id) as vec_id, arg_min(x, vec_id) as x, arg_min(g, vec_id) as g from emb group by 1) a
  on a.label = e.label or a.label = (e.label + 1) % 10)"""
_COS = "list_reduce(list_transform(range(1, 65), lambda i: x[i] * y[i]), lambda p, q: p + q) / (sqrt(list_reduce(list_transform(x, lambda v: v * v), lambda p, q: p + q)) * sqrt(list_reduce(list_transform(y, lambda v: v * v), lambda p, q: p + q)))"
_HAMMING = "list_sum(list_transform(range(1, 65), lambda i: (a[i] <> b[i])::int))::bigint"


def _sweep(metric, scored, steps, test):
    values = ", ".join(f"({t}::double)" for t in steps)
    return f"""select metric, threshold, tp, fp, tn, fn, round(p, 9) as precision, round(r, 9) as recall,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 9) as f1, round((tp + tn)::double / (tp + fp + tn + fn), 9) as accuracy
from (select *, case when tp + fp > 0 then tp::double / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp::double / (tp + fn) else 0 end as r
  from (select '{metric}' as metric, threshold, count(*) filter (is_genuine and score {test} threshold) as tp,
      count(*) filter (not is_genuine and score {test} threshold) as fp, count(*) filter (not is_genuine and not score {test} threshold) as tn,
      count(*) filter (is_genuine and not score {test} threshold) as fn
    from ({scored}) s, (values {values}) as v(threshold) group by 2) c) q"""


_WSUM = "list_sum(list_transform(range(1, 65), lambda i: i * ({})[i]))::bigint"
_VARIANTS = f"""{_EMB},
variants as (select vec_id, 'original' as variant, g from emb
  union all select vec_id, 'brighter', list_transform(g, lambda v: least(255, v + 30)) from emb
  union all select vec_id, 'contrast', list_transform(g, lambda v: least(255, greatest(0, floor(128 + (v - 128) * 1.5::double + 0.5::double)))::int) from emb
  union all select vec_id, 'marked', list_transform(range(0, 64), lambda i: case when i % 8 < 3 and i // 8 < 3 then 200 else g[i+1] end) from emb
  union all select vec_id, 'cropped', list_transform(range(0, 64), lambda i: case when i % 8 >= 6 or i // 8 >= 6 then 0 else g[i+1] end) from emb),
hashed as (select bits, count(*) as n from (select {_AVG.format(g='g')} as bits from variants) t group by 1)"""
_HEXB = "hex(encode(text))"


def _hex_bytes(condition, mask):
    """Hex text with the bytes at positions i (0-based) that meet a condition XORed."""
    return f"""upper(array_to_string(list_transform(range(0, n), lambda i: case when {condition} then printf('%02x', xor(b[i+1], {mask})) else printf('%02x', b[i+1]) end), ''))"""


ORACLES = {
    "to_grey": f"""with {_BYTES} select doc_id, n // 4 as n_pixels, coalesce(list_sum(list_transform(range(0, n // 4), lambda i: (i + 1) *
  floor(0.299::double * b[4*i+1] + 0.587::double * b[4*i+2] + 0.114::double * b[4*i+3] + 0.5::double)::bigint)), 0)::bigint as checksum
from ints where variant = 'whole'""",
    "ahash": f"with {_EMB} select vec_id, {_HEX} as hash from (select vec_id, {_AVG.format(g='g')} as bits from emb) t",
    "dhash": f"with {_EMB} select vec_id, {_HEX} as hash from (select vec_id, {_DIFF.format(g='g')} as bits from emb) t",
    "phash": f"with {_EMB}, {_dct('emb', 'vec_id')} select vec_id, {_HEX} as hash from dct",
    "whash": f"""with {_BYTES}, grid as (select doc_id, y, x, coalesce(b[(least(floor(y * (h / 64.0::double)), h - 1) * 64 + x + 1)::int], 0) as v
  from (select *, ceil(n / 64.0::double)::int as h from ints where variant = 'whole') t, range(0, 64) a(y), range(0, 64) c(x)),
l1 as (select doc_id, y // 2 as y, x // 2 as x, floor(sum(v) / 4.0::double + 0.5::double) as v from grid group by all),
l2 as (select doc_id, y // 2 as y, x // 2 as x, floor(sum(v) / 4.0::double + 0.5::double) as v from l1 group by all),
l3 as (select doc_id, y // 2 as y, x // 2 as x, floor(sum(v) / 4.0::double + 0.5::double) as v from l2 group by all),
w as (select doc_id, list((v * 64 >= s)::int order by y, x) as bits from (select *, sum(v) over (partition by doc_id) as s from l3) t group by 1)
select doc_id, {_HEX} as hash from w""",
    "hamming_join": f"""with {_VARIANTS}, hexed as (select bits, n, {_HEX} as hash from hashed)
select first_hash, second_hash, distance, n_pairs from (
  select p.hash as first_hash, q.hash as second_hash, bit_count(xor(('0b' || array_to_string(p.bits, ''))::ubigint, ('0b' || array_to_string(q.bits, ''))::ubigint)::bit)::bigint as distance,
    p.n * q.n as n_pairs from hexed p join hexed q on p.hash < q.hash) t where distance <= 10""",
    "identical_hashes": f"with {_VARIANTS} select {_HEX} as hash, n from hashed where n > 1",
    "hash_comparison": f"""with {_EMB}, both_frames as (select vec_id * 2 as key, g from emb union all select vec_id * 2 + 1, list_transform(g, lambda v: least(255, v + 80)) from emb),
{_dct('both_frames', 'key')},
bit_lists as (select key, 'average' as method, {_AVG.format(g='g')} as bits from both_frames union all select key, 'wavelet', {_AVG.format(g='g')} from both_frames
  union all select key, 'difference', {_DIFF.format(g='g')} from both_frames union all select key, 'dct', bits from dct),
hexed as (select key, method, bits, {_HEX} as hash from bit_lists)
select vec_id, method, hash, other_hash, distance, round(distance / m, 9) as normalised, round(1 - distance / m, 9) as similarity, distance <= 10 as is_match
from (select p.key // 2 as vec_id, p.method, p.hash, q.hash as other_hash, len(p.bits)::double as m,
    list_sum(list_transform(range(1, len(p.bits) + 1), lambda i: (p.bits[i] <> q.bits[i])::int))::bigint as distance
  from hexed p join hexed q on q.key = p.key + 1 and q.method = p.method where p.key % 2 = 0) t""",
    "match_decisions": f"""with {_PAIRS}, {_dct('emb', 'vec_id')}
select vec_id, is_genuine, distance, distance <= 10 as matched, floor((1 - distance / 63.0::double) * 100 + 0.5::double)::bigint as score
from (select p.vec_id, is_genuine, list_sum(list_transform(range(1, 64), lambda i: (u.bits[i] <> w.bits[i])::int))::bigint as distance
  from pairs p join dct u on u.vec_id = p.vec_id join dct w on w.vec_id = p.anchor_id) t""",
    "feature_vector": f"""with {_EMB} select vec_id, round(list_reduce(v, lambda p, q: p + q), 6) as total,
  round(list_reduce(list_transform(range(1, 65), lambda i: v[i] * i), lambda p, q: p + q), 6) as weighted
from (select vec_id, list_transform(g, lambda a: a::double / greatest(list_max(g), 1)) as v from emb) t""",
    "vector_distances": f"""with {_PAIRS} select vec_id, anchor_id, is_genuine,
  round(list_reduce(list_transform(range(1, 65), lambda i: abs(x[i] - y[i])), lambda p, q: p + q), 6) as l1,
  round(sqrt(list_reduce(list_transform(range(1, 65), lambda i: (x[i] - y[i]) * (x[i] - y[i])), lambda p, q: p + q)), 6) as l2,
  round(1 - {_COS}, 6) as cosine from pairs""",
    "nearest_vectors": f"""with {_EMB} select query_id, rank, vec_id, round(apart, 6) as distance
from (select *, row_number() over (partition by query_id order by apart, vec_id) as rank
  from (select q.vec_id as query_id, e.vec_id, round(list_distance(q.x, e.x), 9) as apart from emb q join emb e on q.vec_id <> e.vec_id where q.vec_id % 100 = 0) t) r
where rank <= 10""",
    "threshold_sweep": f"with {_PAIRS} " + _sweep(
        "average", f"select is_genuine, {_HAMMING} as score from (select is_genuine, {_AVG.format(g='g')} as a, {_AVG.format(g='h')} as b from pairs) t",
        V.SWEEP_THRESHOLDS, "<="),
    "cosine_sweep": f"with {_PAIRS} " + _sweep("cosine similarity", f"select is_genuine, round({_COS}, 6) as score from pairs", COSINE_STEPS, ">="),
    "evaluation_summary": f"""with {_PAIRS} select count(*) as n_total, count(*) filter (e = d) as n_aligned, count(*) filter (e and d) as n_true_match,
  count(*) filter (not e and d) as n_false_match, count(*) filter (e and not d) as n_missed_match, count(*) filter (not e and not d) as n_rejected
from (select is_genuine as e, round(1 - {_COS}, 6) <= 0.5::double as d from pairs) t""",
    "tlsh_digest": f"with {_LOCALITY} select doc_id, checksum, length_bucket, body from heads join bodies using (doc_id, variant) where variant = 'whole'",
    "tlsh_distance": f"""with {_LOCALITY} select doc_id, (abs(a.length_bucket - b.length_bucket) * 12 + (a.checksum <> b.checksum)::int + d)::bigint as distance
from heads a join heads b using (doc_id)
join (select doc_id, sum(abs(p.v - q.v)) as d from coded p join coded q using (doc_id, h) where p.variant = 'whole' and q.variant = 'cut' group by 1) t using (doc_id)
where a.variant = 'whole' and b.variant = 'cut'""",
    "tamper_bytes": f"""with {_BYTES}, hexes as (select doc_id, hex(encode(text)) as h, strlen(text) as n from documents),
spots as (select *, floor(n / 2.0::double)::int as mid, floor(n * 0.6::double)::int as z, floor(n * 0.8::double)::int as k,
  floor(n * 0.2::double)::int as a, floor(n * 0.1::double)::int as m, floor(n * 0.3::double)::int as s from hexes)
select doc_id,
  sha256(unhex(substr(h, 1, 2 * mid + 1) || translate(substr(h, 2 * mid + 2, 1), '0123456789ABCDEF', '1032547698BADCFE') || substr(h, 2 * mid + 3))) as flipped,
  sha256(unhex(substr(h, 1, 2 * z) || repeat('00', least(4096, n - z)) || substr(h, 2 * (z + least(4096, n - z)) + 1))) as zeroed,
  sha256(unhex(substr(h, 1, 2 * k))) as cut,
  sha256(unhex(substr(h, 1, 2 * a) || translate(substr(h, 2 * a + 1, 2 * m), '0123456789ABCDEF', 'FEDCBA9876543210') || substr(h, 2 * (a + m) + 1))) as inverted,
  sha256(unhex(w)) as shifted
from spots join (select doc_id, {_hex_bytes('i >= floor(n * 0.3::double)::int and i < floor(n * 0.3::double)::int + 8192', 128)} as w from ints where variant = 'whole') v using (doc_id)""",
    "perturb_frames": f"""with {_EMB} select vec_id,
  {_WSUM.format('list_transform(g, lambda v: least(255, v + 80))')} as brighter, {_WSUM.format('list_transform(g, lambda v: greatest(0, v - 80))')} as darker,
  {_WSUM.format('list_transform(g, lambda v: least(255, greatest(0, floor(128 + (v - 128) * 1.5::double + 0.5::double)))::int)')} as contrast,
  {_WSUM.format('list_transform(range(0, 64), lambda j: case when j % 8 < 3 and j // 8 < 3 then 200 else g[j+1] end)')} as marked,
  {_WSUM.format('list_transform(range(0, 64), lambda j: case when j % 8 >= 6 or j // 8 >= 6 then 0 else g[j+1] end)')} as cropped,
  {_WSUM.format('list_reverse(g)')} as reversed, {_WSUM.format('list_concat(g[1:32], list_reverse(g)[1:32])')} as spliced from emb""",
}
