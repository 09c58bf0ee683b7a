"""Comparison of frame pairs by all metrics, and threshold sweeps over their scores."""

from dataclasses import dataclass

from pyspark.sql import functions as F

from chainwitness import fixed_values as V
from chainwitness.functions import digests, frames, vectors


@dataclass(frozen=True)
class Thresholds:
    """Limits of a match per metric; any of them may be replaced."""

    max_hamming: int = V.MAX_HAMMING
    min_fuzzy_score: int = V.MIN_FUZZY_SCORE
    max_locality_distance: int = V.MAX_LOCALITY_DISTANCE
    max_cosine_distance: float = V.MAX_COSINE_DISTANCE
    max_euclidean: float = V.MAX_EUCLIDEAN


DEFAULTS = Thresholds()
METHODS = ("average", "difference", "dct", "wavelet")


def _hashes(grey, width, height, packed=False):
    return {
        "average": frames.average_hash(grey, width, height, packed),
        "difference": frames.difference_hash(grey, width, height, packed),
        "dct": frames.dct_hash(grey, width, height),
        "wavelet": frames.wavelet_hash(grey, width, height),
    }


def frame_hashes(df, grey="grey", width="width", height="height", prefix=""):
    """Add the four perceptual hashes of a frame."""
    made = _hashes(F.col(grey), F.col(width), F.col(height))
    return df.withColumns({prefix + name: column for name, column in made.items()})


def compare_hashes(pairs, a="a_", b="b_", limits=DEFAULTS):
    """One row per pair and hash method with distance, similarity and match."""
    rows = []
    for method in METHODS:
        n_bits = frames.DCT_BITS if method == "dct" else frames.HASH_BITS
        x, y = F.col(a + method), F.col(b + method)
        distance = frames.hamming(x, y)
        rows.append(
            F.struct(
                F.lit(method).alias("method"),
                frames.hash_hex(x, n_bits).alias("hash"),
                frames.hash_hex(y, n_bits).alias("other_hash"),
                distance.alias("distance"),
                (distance / F.lit(n_bits)).alias("normalised"),
                frames.hamming_similarity(x, y, n_bits).alias("similarity"),
                (distance <= limits.max_hamming).alias("is_match"),
            )
        )
    keys = [c for c in pairs.columns if not c.startswith((a, b))]
    return pairs.select(*keys, F.inline(F.array(*rows)))


def fingerprints(grey, width, height, content, packed=False):
    """Every fingerprint of a frame by name (``packed``: it is binary, one byte per grey)."""
    return _hashes(grey, width, height, packed) | {
        "fuzzy": digests.fuzzy_digest(content),
        "locality": digests.locality_digest(content),
        "vector": frames.feature_vector(grey, width, height, packed),
    }


def describe(df, grey="grey", width="width", height="height", content="content", prefix="", packed=False):
    """Add every fingerprint of a frame: hashes, digests and the feature vector."""
    made = fingerprints(F.col(grey), F.col(width), F.col(height), F.col(content), packed)
    return df.withColumns({prefix + name: column for name, column in made.items()})


def described_copies(df, changes, grey="grey", width="width", height="height", content_col="content"):
    """One row per packed frame and changed copy (``variant``): columns ``a_`` tell of the frame, ``b_`` of the copy.

    A frame and its copies are fingerprinted side by side, by one worker of a task, and only fingerprints are multiplied.
    """
    g, w, h = F.col(grey), F.col(width), F.col(height)
    # one array, so that Spark has no reason to part the frame's own fingerprints from the others
    packed = F.concat(F.array(F.col(content_col), g), frames.altered(g, w, list(changes.values())))
    copies = df.withColumn("_packed", packed)
    content, own = (F.get("_packed", F.lit(i)) for i in (0, 1))
    made = {"a_" + name: column for name, column in fingerprints(own, w, h, content, True).items()}
    rest, variants = [c for c in df.columns if c not in (grey, content_col)] + list(made), []
    for i, kind in enumerate(changes):
        copy = F.get("_packed", F.lit(i + 2))
        found = {f"_{i}_{name}": column for name, column in fingerprints(copy, w, h, copy, True).items()}
        variants.append(F.struct(F.lit(kind).alias("variant"), *[F.col(c).alias("b_" + c[3:]) for c in found]))
        made |= found
    return copies.withColumns(made).select(*rest, F.inline(F.array(*variants)))


def metric_columns(a="a_", b="b_"):
    """The nine metrics of a described pair."""
    x, y = (lambda n: F.col(a + n)), (lambda n: F.col(b + n))
    return {
        **{m: frames.hamming(x(m), y(m)) for m in METHODS},
        "fuzzy": digests.fuzzy_similarity(x("fuzzy"), y("fuzzy")),
        "locality": digests.locality_distance(x("locality"), y("locality")),
        "l1": F.round(vectors.l1_distance(x("vector"), y("vector")), 3),
        "l2": F.round(vectors.l2_distance(x("vector"), y("vector")), 3),
        "cosine": F.round(vectors.cosine_distance(x("vector"), y("vector")), 4),
    }


def match_decision(distance, n_bits=frames.DCT_BITS, limits=DEFAULTS):
    """(matched, score): the DCT hash decides; the score is its similarity in percent."""
    score = F.floor((1 - distance / F.lit(n_bits)) * 100 + F.lit(0.5)).cast("int")
    return distance <= limits.max_hamming, score


def within_limits(limits=DEFAULTS):
    """Names of the metrics of a compared pair that miss their limit."""
    misses = [
        (F.col("dct") > limits.max_hamming, "dct"),
        (F.col("fuzzy") < limits.min_fuzzy_score, "fuzzy"),
        (F.col("locality") > limits.max_locality_distance, "locality"),
        (F.col("cosine") > limits.max_cosine_distance, "cosine"),
        (F.col("l2") > limits.max_euclidean, "l2"),
    ]
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in misses]))


def evaluate_thresholds(
    scored, thresholds=V.SWEEP_THRESHOLDS, higher_is_better=False,
    score="score", label="is_genuine", metric="metric",
):
    """Confusion counts, precision, recall, F1 and accuracy per metric and threshold.

    All thresholds are counted in one aggregate, so rows are not multiplied by them.
    """
    counts, genuine = [], F.col(label)
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= F.lit(float(t)) if higher_is_better else F.col(score) <= F.lit(float(t))
        counts += [
            F.count_if(genuine & hit).alias(f"tp{i}"),
            F.count_if(~genuine & hit).alias(f"fp{i}"),
            F.count_if(~genuine & ~hit).alias(f"tn{i}"),
            F.count_if(genuine & ~hit).alias(f"fn{i}"),
        ]
    table = scored.groupBy(metric).agg(*counts)
    rows = [
        F.struct(
            F.lit(float(t)).alias("threshold"),
            *[F.col(f"{c}{i}").alias(c) for c in ("tp", "fp", "tn", "fn")],
        )
        for i, t in enumerate(thresholds)
    ]
    return with_rates(table.select(metric, F.inline(F.array(*rows))))


def with_rates(counts):
    """Add precision, recall, F1 (0 without a denominator) and accuracy (null if empty)."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    share = lambda n, d: F.when(d > 0, n / d)
    zero = F.lit(0.0)
    out = counts.withColumn("precision", F.coalesce(share(tp, tp + fp), zero)).withColumn(
        "recall", F.coalesce(share(tp, tp + fn), zero)
    )
    p, r = F.col("precision"), F.col("recall")
    return out.withColumn("f1", F.coalesce(share(2 * p * r, p + r), zero)).withColumn(
        "accuracy", share(tp + tn, tp + fp + tn + fn)
    )


def evaluation_summary(cases, expected="expected", detected="detected"):
    e, d = F.col(expected), F.col(detected)
    return cases.agg(
        F.count(F.lit(1)).alias("n_total"),
        F.count_if(e == d).alias("n_aligned"),
        F.count_if(e & d).alias("n_true_match"),
        F.count_if(~e & d).alias("n_false_match"),
        F.count_if(e & ~d).alias("n_missed_match"),
        F.count_if(~e & ~d).alias("n_rejected"),
    )
