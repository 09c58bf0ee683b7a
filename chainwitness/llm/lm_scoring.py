"""Log probabilities of texts under a hashed maximum-entropy model with classes of words.

A token's probability is that of its class, times that of its leaf among the words of the class, times its
smoothed share of the leaf. Classes are bins of word frequency; the leaf is found digit by digit of the
word's name, so that a choice is always one of few. Class and digits are each a softmax over hashed
n-gram and skip features of the three *words* before; the class starts from a model of class runs, the digits from
the counts of words. One pass over the training texts counts words, one counts class runs, and each
further one adds up how often every feature came with an outcome and how often the model expects
it. Counts of words are a table that grows with the corpus: the most frequent ones, a
fixed number, are broadcast with their classes, all others are joined.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwitness.llm.common import arrow_rows, let_go, small_slices, stage
from chainwitness.llm.words import _LOWERED, Words, mixed

CLASSES = 32  # class 0 is the end of a text, and what stands before its start; the last one holds all words that are not frequent
FEATURE_ROWS = 1 << 14
UPDATES = 8
STEP = 0.25
PASSES = 3  # over the training texts, for the features of words
DIGITS, CHILDREN = 3, 16  # a class has up to CHILDREN ** DIGITS leaves
WORD_ROWS = 1 << 16
TOKENS = 1 << 13  # handled side by side
SUMS = 1 << 16  # numbers of the tables of sums that travel as one row
TASKS_A_CORE = 4  # that give out tables of sums
FREQUENT = 1 << 16
BUCKET_BITS = 18
FOLDS, HELD_OUT = 7, 2
_END = np.uint64(0x2545F4914F6CDD1D)  # the name of the end token
#: Which of the three tokens before each feature looks at: n-grams and skips.
_FEATURES = ((), (1,), (2,), (3,), (1, 2), (1, 3), (2, 3), (1, 2, 3))
_WORD_FEATURES = ((1,), (2,), (1, 2), (1, 3), (1, 2, 3))
_LEAVES = CHILDREN ** DIGITS


def held_out(id_col):
    """Whether a document takes no part in training; documents without id do."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def _tokens(column):
    """Names and texts of all tokens, the end of each text included."""
    words = Words(column, lower=True)
    text = words.text_of()
    at = words.first[1:]  # one end after the words of each text
    return np.insert(words.names, at, _END), np.insert(text, at, np.arange(len(at)))


class _Vocabulary:
    """Classes and leaves of words, from the counts of the most frequent ones (``names`` sorted) and the number of all others.

    Words in order of frequency are cut into classes of like sums of square roots of their counts. All other words, seen or
    not, are the last class, with fewer leaves where these would hold less than CHILDREN words each.
    """

    def __init__(self, names, counts, others):
        self.names, self.counts = names, counts
        buckets = np.searchsorted(names, np.arange(1 << BUCKET_BITS, dtype=np.uint64) << np.uint64(64 - BUCKET_BITS))
        self.starts, self.longest = buckets, int(np.diff(np.append(buckets, len(names))).max())  # names are found from their first bits
        order = np.lexsort((names, -counts))
        mass = np.cumsum(np.sqrt(counts[order]))
        self.classes = np.zeros(len(names), np.int64)
        if len(names):
            self.classes[order] = 1 + np.minimum(((mass - mass[0]) / mass[-1] * (CLASSES - 2)).astype(np.int64), CLASSES - 3)
        self.classes[names == _END] = 0
        self.levels = 0
        while self.levels < DIGITS and CHILDREN ** (self.levels + 2) <= others:
            self.levels += 1

    def find(self, tokens):
        """Class and leaf of each token, its place among the frequent words, and whether it is one of them."""
        place = self.starts.take((tokens >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
        for _ in range(self.longest if len(self.names) else 0):
            place += self.names.take(place, mode="clip") < tokens
        place = np.minimum(place, max(len(self.names) - 1, 0))
        common = self.names[place] == tokens if len(self.names) else np.zeros(len(tokens), bool)
        classes = np.where(common, self.classes[place], CLASSES - 1) if len(self.names) else np.full(len(tokens), CLASSES - 1)
        classes[tokens == _END] = 0  # without training texts as well
        code = (mixed(tokens) % np.uint64(_LEAVES)).astype(np.int64)
        few = CHILDREN ** (DIGITS - self.levels)
        code = np.where(classes == CLASSES - 1, code // few * few, code)
        return classes, np.where(classes == 0, 0, code), place, common

    def masses(self, per_leaf):
        """Mass of each leaf, (class, code): counts and kinds of its words, and in the last class one for an unseen one."""
        mass = per_leaf.reshape(CLASSES, _LEAVES).copy()
        mass[-1, ::CHILDREN ** (DIGITS - self.levels)] += 1
        mass[0, 0] = max(mass[0, 0], 1)
        return mass


def _contexts(classes, texts):
    """Code of the three classes before each token; a text starts after ends."""
    code, first = np.zeros(len(classes), np.int64), np.append(True, texts[1:] != texts[:-1])[: len(texts)]
    place = np.arange(len(texts)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(texts) else code
    for back in (1, 2, 3):
        code[back:] += np.where(place[back:] >= back, classes[:-back], 0) * CLASSES ** (back - 1)
    return code


def _feature_rows(contexts):
    """The row of weights of each feature of each context."""
    past = {back: contexts // CLASSES ** (back - 1) % CLASSES for back in (1, 2, 3)}
    rows = []
    for number, parts in enumerate(_FEATURES):
        key = np.full(len(contexts), number, np.uint64)
        for back in parts:
            key = mixed(key * np.uint64(CLASSES + 1) + past[back].astype(np.uint64))
        rows.append((mixed(key) % np.uint64(FEATURE_ROWS)).astype(np.int64))
    return np.stack(rows, axis=1)


def _log_probabilities(weights, contexts):
    scores = weights[_feature_rows(contexts)].sum(axis=1)
    scores -= scores.max(axis=1, keepdims=True)
    return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))


def _word_counts(docs):
    """Counts of all words of all given texts: ``word`` (its name), ``c``."""
    schema = pa.schema([("word", pa.int64()), ("c", pa.int64())])

    def run(batches):
        for batch in small_slices(batches):
            names, counts = np.unique(_tokens(batch.column("_text"))[0], return_counts=True)
            yield arrow_rows(schema, pa.array(names.view(np.int64)), counts)

    return stage(docs.select("_text").mapInArrow(run, "word bigint, c bigint").groupBy("word").agg(F.sum("c").alias("c")), "counts")


def _leaf_counts(words, shared):
    """Counts plus kinds of the words of each leaf; as many rows as leaves, whatever the corpus."""
    schema = pa.schema([("leaf", pa.int32()), ("n", pa.int64())])

    def run(batches):
        for batch in batches:
            classes, code, _, _ = shared.value.find(batch.column("word").to_numpy().view(np.uint64))
            leaves, back = np.unique(classes * _LEAVES + code, return_inverse=True)
            sums = np.bincount(back, batch.column("c").to_numpy() + 1.0, len(leaves))
            yield arrow_rows(schema, leaves.astype(np.int32), sums.astype(np.int64))

    rows = words.mapInArrow(run, "leaf int, n bigint").groupBy("leaf").agg(F.sum("n").alias("n")).toArrow()
    return np.bincount(rows.column("leaf").to_numpy(), rows.column("n").to_numpy(), CLASSES * _LEAVES)


def _class_runs(docs, shared):
    """Counts of class runs of all given texts: ``key`` (code), ``n``."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches):
        runs = np.zeros(CLASSES ** 4, np.int64)
        for batch in small_slices(batches):
            names, texts = _tokens(batch.column("_text"))
            classes = shared.value.find(names)[0]
            runs += np.bincount(_contexts(classes, texts) * CLASSES + classes, minlength=len(runs))
        used = np.flatnonzero(runs)
        yield arrow_rows(schema, used, runs[used])

    return docs.select("_text").mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def train(runs: DataFrame, per_class, updates=UPDATES, step=STEP):
    """Weights fitted to the counts of class runs (``key``, ``n``).

    The first guess is the frequency of each class, ``per_class``. Every update is one job: each part of the table sums, over its contexts, how often each class
    came and how often the model expects it; the sums of a feature are added up across parts
    and move its weights by their difference, scaled by their mass. Table and gradient have
    at most CLASSES ** 4 and FEATURE_ROWS * CLASSES entries, whatever the corpus.
    """
    spark = runs.sparkSession
    parts = stage(runs.repartition(8, F.floor(F.col("key") / CLASSES)), "runs")
    weights = np.zeros((FEATURE_ROWS, CLASSES))
    weights[_feature_rows(np.zeros(1, np.int64))[0, 0]] = np.log((per_class + 1) / (per_class + 1).sum())
    schema = pa.schema([("feature", pa.int32()), ("class", pa.int32()), ("seen", pa.float64()), ("expected", pa.float64())])
    for _ in range(updates):
        shared = spark.sparkContext.broadcast(weights.astype(np.float32))

        def run(batches, shared=shared):
            seen = np.zeros((CLASSES ** 3, CLASSES))
            for batch in batches:
                keys, n = batch.column("key").to_numpy(), batch.column("n").to_numpy()
                np.add.at(seen, (keys // CLASSES, keys % CLASSES), n)
            contexts = np.flatnonzero(seen.any(axis=1))
            seen = seen[contexts]
            expected = np.exp(_log_probabilities(shared.value, contexts)) * seen.sum(axis=1, keepdims=True)
            sums = np.zeros((2, FEATURE_ROWS, CLASSES))
            for rows in _feature_rows(contexts).T:
                np.add.at(sums[0], rows, seen)
                np.add.at(sums[1], rows, expected)
            feature, kind = np.nonzero(sums.any(axis=0))
            yield arrow_rows(
                schema, feature.astype(np.int32), kind.astype(np.int32), sums[0][feature, kind], sums[1][feature, kind]
            )

        gradient = parts.mapInArrow(run, "feature int, class int, seen double, expected double").groupBy(
            "feature", "class").agg(F.sum("seen").alias("seen"), F.sum("expected").alias("expected")).toArrow()
        shared.destroy()
        seen, expected = gradient.column("seen").to_numpy(), gradient.column("expected").to_numpy()
        weights = weights.copy()
        weights[gradient.column("feature").to_numpy(), gradient.column("class").to_numpy()] += (
            step * (seen - expected) / (np.maximum(seen, expected) + 1)
        )
        let_go(spark)
    return weights


def _add_rows(table, rows, parts):
    """Add each row of ``parts`` to its row of ``table``; both are 32-bit numbers in rows of one even width.

    Rows of the table that come once among ``rows`` are read, raised and written as a whole, one of each of the others as
    well, a few times over; what is left are rows that come often, added one after another.
    """
    wide = table.shape[1]
    whole, turn = table.view(np.dtype((np.void, 4 * wide))).reshape(-1), np.empty(len(table), np.int32)
    for _ in range(3):
        order = np.arange(len(rows), dtype=np.int32)
        turn[rows] = order
        own = turn.take(rows, mode="clip") == order
        if 4 * np.count_nonzero(own) < len(rows):
            break
        first = np.flatnonzero(own)
        at = rows.take(first)
        raised = table.take(at, axis=0, mode="clip")  # which skips a second look at each place
        raised += parts.take(first, axis=0, mode="clip")
        whole[at] = raised.view(whole.dtype).reshape(-1)
        rest = np.flatnonzero(~own)
        rows, parts = rows.take(rest), parts.take(rest, axis=0, mode="clip")
    places = (rows * (wide // 2))[:, None] + np.arange(wide // 2)  # two numbers are added at a time
    np.add.at(table.view(np.complex64).reshape(-1), places.reshape(-1), parts.view(np.complex64).reshape(-1))


class _Model:
    """Log probabilities of tokens up to their leaves, and what features and outcomes came together or were expected to.

    A softmax of a sum of weights is a product of factors, brought to the sum 1: factors are taken once for a table of
    weights, and so are the shares that each class run and each node starts from, so that a token costs no exponential.
    """

    def __init__(self, vocabulary, mass, class_weights):
        self.vocabulary, self.mass = vocabulary, mass
        runs = np.arange(CLASSES ** 3).reshape(-1, TOKENS)
        self.bases = [np.concatenate([np.exp(_log_probabilities(class_weights, run)) for run in runs]).astype(np.float32)]
        self.parted = []  # per level: the nodes of more than one child
        for level in range(DIGITS):
            masses = mass.reshape(CLASSES * CHILDREN ** (level + 1), -1).sum(axis=1).reshape(-1, CHILDREN)
            self.bases.append((masses / np.maximum(masses.sum(axis=1, keepdims=True), 1)).astype(np.float32))
            self.parted.append((masses > 0).sum(axis=1) > 1)
        self.weights = [np.zeros((WORD_ROWS // 4, CLASSES), np.float32), np.zeros((WORD_ROWS, CHILDREN), np.float32)]

    def _before(self, names, texts):
        """Names of the three tokens before each token; ends before a text starts."""
        first = np.append(True, texts[1:] != texts[:-1])[: len(texts)]
        place = np.arange(len(texts)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(texts) else texts
        past = {}
        for back in (1, 2, 3):
            past[back] = np.full(len(names), _END)
            past[back][back:] = np.where(place[back:] >= back, names[:-back], _END)
        return past

    def _softmax(self, base, start, table, factors, keys, target, sums):
        """Log probabilities of the targets; ``sums`` (expected and, if wanted, seen), if given, get a part for each feature."""
        rows = [(mixed(key) & np.uint64(len(factors) - 1)).astype(np.int64) for key in keys]
        shares, at = base.take(start, axis=0, mode="clip"), np.arange(len(target)) * factors.shape[1] + target
        factor = np.empty_like(shares)
        for row in rows if self.fitted else ():
            shares *= factors.take(row, axis=0, mode="clip", out=factor)
        mass, hit = np.einsum("ij->i", shares), shares.reshape(-1).take(at)
        far = np.flatnonzero(~((mass > 1e-30) & (mass < 1e30) & (hit > 1e-30)))
        found = np.log(np.maximum(hit, 1e-38)) - np.log(np.maximum(mass, 1e-38))
        if len(far):  # beyond what 32 bits hold as a product
            scores = np.log(np.maximum(base[start[far]], 1e-26)) + sum(self.weights[table][row[far]] for row in rows)
            scores -= scores.max(axis=1, keepdims=True)
            shares[far] = np.exp(scores)
            mass[far] = shares[far].sum(axis=1)
            found[far] = scores[np.arange(len(far)), target[far]] - np.log(mass[far])
        if sums is not None:
            shares *= (1 / mass)[:, None]
            for row in rows:
                _add_rows(sums[table][0], row, shares)
                if len(sums[table]) > 1:
                    np.add.at(sums[table][1].reshape(-1), row * shares.shape[1] + target, np.float32(1))
        return found

    def log_probabilities(self, names, texts, classes, code, sums=None):
        """Of the class and the leaf of each token, given the tokens before it in its text."""
        past, run = self._before(names, texts), _contexts(classes, texts)
        self.fitted = any(weights.any() for weights in self.weights)  # else all factors are 1
        factors = [np.exp(weights) for weights in self.weights]
        found = np.zeros(len(names))
        for at in range(0, len(names), TOKENS):
            part = slice(at, at + TOKENS)
            keys = []
            for number, backs in enumerate(_WORD_FEATURES):
                key = np.full(len(names[part]), number + 1, np.uint64)
                for back in backs:
                    key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + past[back][part])
                keys.append(key)
            found[part] = self._softmax(self.bases[0], run[part], 0, factors[0], keys, classes[part], sums)
            for level, parted in enumerate(self.parted):
                node = classes[part] * CHILDREN ** level + code[part] // CHILDREN ** (DIGITS - level)
                open_ = np.flatnonzero(parted[node])  # the others have one child
                digit = code[part][open_] // CHILDREN ** (DIGITS - 1 - level) % CHILDREN
                node = node[open_]
                name = mixed(node.astype(np.uint64) + np.uint64((level + 1) << 40))
                below = [key[open_] + name for key in keys]
                found[part][open_] += self._softmax(self.bases[level + 1], node, 1, factors[1], below, digit, sums)
        return found


def train_words(docs: DataFrame, model, passes=PASSES):
    """Fit the weights of word features, by iterative scaling over all texts of ``docs``.

    Each pass is a job: a task adds up, for each row of features and each outcome, how often it came and how often the
    model expects it, and gives out its tables in parts of SUMS numbers; the parts are added up by tasks, a few at
    a time; neighbouring parts of the input share a task, so that the tables in all grow with the cores and not with the
    input. What came does not depend on the weights, and the first pass alone counts it. A weight moves by the logarithm
    of both numbers' ratio, shared among the features of a token.
    """
    spark = docs.sparkSession
    schema = pa.schema([("part", pa.int32()), ("sums", pa.binary())])
    seen, tasks = None, TASKS_A_CORE * spark.sparkContext.defaultParallelism
    for _ in range(passes):
        kinds = 2 if seen is None else 1
        shared = spark.sparkContext.broadcast(model)  # a few MB, gone after the pass

        def run(batches, shared=shared, kinds=kinds):
            sums = [np.zeros((kinds, *w.shape), np.float32) for w in shared.value.weights]
            for batch in small_slices(batches):
                names, texts = _tokens(batch.column("_text"))
                classes, code, _, _ = shared.value.vocabulary.find(names)
                shared.value.log_probabilities(names, texts, classes, code, sums)
            flat = np.concatenate([s.reshape(-1) for s in sums])
            for part in range(len(flat) // SUMS):
                numbers = flat[part * SUMS:(part + 1) * SUMS]
                if numbers.any():
                    yield arrow_rows(schema, [part], [numbers.tobytes()])

        def add_up(batches):
            found = {}
            for batch in batches:
                for part, numbers in zip(batch.column("part").to_pylist(), batch.column("sums")):
                    found[part] = found.get(part, 0) + np.frombuffer(numbers.as_buffer(), np.float32).astype(np.float64)
            for part, numbers in found.items():
                yield arrow_rows(schema, [part], [numbers.astype(np.float32).tobytes()])

        parts = docs.select("_text").coalesce(tasks).mapInArrow(run, "part int, sums binary")
        added = parts.repartition(16, "part").mapInArrow(add_up, "part int, sums binary").toArrow()
        shared.destroy()
        let_go(spark)
        flat = np.zeros(kinds * sum(w.size for w in model.weights), np.float32)
        for part, numbers in zip(added.column("part").to_pylist(), added.column("sums")):
            flat[part * SUMS:(part + 1) * SUMS] = np.frombuffer(numbers.as_buffer(), np.float32)
        ends = np.cumsum([kinds * w.size for w in model.weights])[:-1]
        sums = [own.reshape(kinds, *w.shape) for own, w in zip(np.split(flat, ends), model.weights)]
        seen = [own[1] for own in sums] if seen is None else seen
        model.weights = [
            w + np.log((came + 1) / (own[0] + 1)) * np.float32(1 / len(_WORD_FEATURES)) for w, came, own in zip(model.weights, seen, sums)
        ]
    return model


def score(docs: DataFrame, updates=UPDATES, passes=PASSES) -> DataFrame:
    """Base and model score of every whole text, learned from the texts that are not held out.

    ``docs`` comes from ``common.identified``. Result, one row per input row: ``_id``, ``_hash``,
    ``held_out``, ``n_tokens`` (words and one end), ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` (log10). Null and empty texts are an end alone; documents without id take part in
    training. Repeated rows each count in training and get the same scores. With no training
    text no word is known and nothing is fitted. Long texts are numpy arrays of
    one task, with a few numbers per word.
    """
    spark = docs.sparkSession
    docs = docs.select("_id", "_hash", "_text")
    learned = docs.where(~held_out(F.col("_id")))
    words = _word_counts(learned)
    total, distinct = (int(n or 0) for n in words.agg(F.sum("c"), F.count(F.lit(1))).first())
    frequent = words.orderBy(F.desc("c"), "word").limit(FREQUENT).toArrow()
    names, c = frequent.column("word").to_numpy().view(np.uint64), frequent.column("c").to_numpy()
    order = np.argsort(names)
    vocabulary = _Vocabulary(names[order], c[order], distinct - len(names))
    known = spark.sparkContext.broadcast(vocabulary)
    mass = vocabulary.masses(_leaf_counts(words, known))
    class_weights = train(_class_runs(learned, known), mass.sum(axis=1), updates)
    known.destroy()
    model = train_words(learned, _Model(vocabulary, mass, class_weights), passes)
    shared = spark.sparkContext.broadcast(model)
    schema = pa.schema([
        ("_id", pa.int64()), ("_hash", pa.binary()), ("rows", pa.int64()), ("word", pa.int64()), ("times", pa.int64()),
        ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("logs", pa.float64()), ("class_score", pa.float64()),
    ])

    def run(batches):
        model, c = shared.value, shared.value.vocabulary.counts
        shares = np.log10(np.maximum(model.mass, 1))
        for batch in small_slices(batches):
            tokens, texts = _tokens(batch.column("_text"))
            classes, code, place, common = model.vocabulary.find(tokens)
            chosen = model.log_probabilities(tokens, texts, classes, code) / np.log(10) - shares[classes, code]
            n = batch.num_rows
            known = np.bincount(texts[common], minlength=n)
            sums = np.bincount(texts[common], np.log10(c[place[common]] + 1.0), n) if len(c) else np.zeros(n)
            nulls = pa.nulls(n, pa.int64())
            yield arrow_rows(
                schema, batch.column("_id"), batch.column("_hash"), np.ones(n, np.int64), nulls, nulls,
                np.bincount(texts, minlength=n), known, sums, np.bincount(texts, chosen, n),
            )
            rare, of = tokens[~common], texts[~common]
            key = mixed(rare) + mixed(of.astype(np.uint64) + np.uint64(1))
            _, at, times = np.unique(key, return_index=True, return_counts=True)
            beside = np.argsort(of[at], kind="stable")  # rows of one text side by side compress well
            at, times = at[beside], times[beside]
            rows, zeros = pa.array(of[at]), np.zeros(len(at), np.int64)
            yield arrow_rows(
                schema, batch.column("_id").take(rows), batch.column("_hash").take(rows), zeros,
                pa.array(rare[at].view(np.int64)), times, zeros, zeros, zeros.astype(float), zeros.astype(float),
            )

    found = docs.mapInArrow(
        run, "_id bigint, _hash binary, rows bigint, word bigint, times bigint, n_tokens bigint, n_known bigint, "
        "logs double, class_score double",
    ).join(words.select("word", "c"), "word", "left")
    sums = found.groupBy("_id", "_hash").agg(
        F.sum("rows").alias("rows"), F.sum("n_tokens").alias("n_tokens"), F.sum("class_score").alias("class_score"),
        F.sum(F.col("n_known") + F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("n_known"),
        F.sum(F.col("logs") + F.coalesce(F.col("times") * F.log10(F.col("c") + 1), F.lit(0.0))).alias("logs"),
    )
    each = [(F.col(k) / F.col("rows")).cast("long").alias(k) for k in ("n_tokens", "n_known")]
    each += [(F.col(k) / F.col("rows")).alias(k) for k in ("class_score", "logs")]
    return sums.select("_id", "_hash", *each, F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("row")).select(
        "_id", "_hash", held_out(F.col("_id")).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(float(np.log10(total + distinct + 1)))).alias("base_score"),
        (F.col("class_score") + F.col("logs")).alias("score"),
    )
