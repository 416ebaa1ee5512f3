"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j), the pairwise
part in linear time as half of (sum_i v_i x_i)^2 - sum_i v_i^2 x_i^2 per factor.

Features of a text: its distinct words, hashed into ``BUCKETS`` (together of unit length);
its structure statistics; its size as metadata.  A statistic counts as a number and as the interval it
falls into, cut at quantiles of the training sample.  Labels, language, source and id are
never features.  The model is fitted by mini-batch Adagrad on at most ``train_rows`` labelled rows.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratus.llm.words import blocks, split_words

BUCKETS = 4096
FACTORS = 8
BINS = 8
TRAIN_ROWS = 6000
BLOCK_BYTES = 4 << 20
# The order of the statistics in a row's array.
STATISTICS = ("log_words", "log_chars", "bytes_per_char", "mean_word", "upper", "digits", "symbols", "end_symbols", "all_upper",
              "doubled", "distinct", "lone_bars", "log_line", "most_frequent")


def _word_table(words: list[str]) -> np.ndarray:
    """Per distinct word: present, characters, upper-case, digits, symbols, ends in a symbol run, all upper-case, is a bar."""
    out = np.zeros((len(words), 8), np.float64)
    for i, w in enumerate(words):
        if w:
            letters = sum(map(str.isalpha, w))
            digits = 0 if letters == len(w) else sum(map(str.isdigit, w))
            upper = 0 if w.islower() else sum(map(str.isupper, w))
            other = len(w) - letters - digits
            out[i] = (1, len(w), upper, digits, other, other >= 2, letters > 1 and upper == letters, w == "|")
    return out


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word feature of each text and the end, distinct hashed words, statistics) of a block of whole texts."""
    n = len(texts)
    filled = pc.fill_null(texts.cast(pa.large_string()), "")
    chars = pc.utf8_length(filled).to_numpy(zero_copy_only=False).astype(np.float64)
    octets = pc.binary_length(filled).to_numpy(zero_copy_only=False).astype(np.float64)
    lines = pc.count_substring(filled, "\n").to_numpy(zero_copy_only=False) + 1.0
    first, codes, distinct = split_words(texts)
    words = distinct.to_pylist()
    table = _word_table(words)
    owner = np.repeat(np.arange(n), np.diff(first))
    sums = np.stack([np.bincount(owner, table[codes, k], n) for k in range(table.shape[1])], axis=1)
    same = np.flatnonzero((codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])) if len(codes) else np.zeros(0, int)
    doubled = np.bincount(owner[same], minlength=n)
    pair, times = np.unique(owner.astype(np.int64) * max(1, len(words)) + codes, return_counts=True)
    pair_owner, pair_word = pair // max(1, len(words)), pair % max(1, len(words))
    real = table[pair_word, 0] > 0 if len(words) else np.zeros(0, bool)
    pair_owner, pair_word, times = pair_owner[real], pair_word[real], times[real]
    kinds = np.bincount(pair_owner, minlength=n)
    most = np.zeros(n)
    np.maximum.at(most, pair_owner, times)
    count, total = sums[:, 0], np.maximum(1, chars)
    some = np.maximum(1, count)
    stats = np.stack([np.log1p(count), np.log1p(chars), octets / total, sums[:, 1] / some, sums[:, 2] / total, sums[:, 3] / total,
                      sums[:, 4] / total, sums[:, 5] / some, sums[:, 6] / some, doubled / some, kinds / some, sums[:, 7] / some,
                      np.log1p(chars / lines), most / some], axis=1)
    hashed = np.array([zlib.crc32(w.encode()) % BUCKETS for w in words], np.int32) if words else np.zeros(0, np.int32)
    bucket = np.unique(pair_owner * BUCKETS + hashed[pair_word])
    return np.searchsorted(bucket, np.arange(n + 1) * BUCKETS), (bucket % BUCKETS).astype(np.int32), stats


@dataclass
class Machine:
    """A fitted model: bias, linear weights, factors, and how statistics become features."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    edges: np.ndarray
    trained: bool = False

    def rows(self, first: np.ndarray, hashed: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first entry of each row and the end, feature numbers, values)."""
        n, k = stats.shape
        numbers = np.clip((stats - self.mean) / self.scale, -4, 4) / 4
        bins = np.stack([np.searchsorted(self.edges[j], stats[:, j]) for j in range(k)], axis=1) if n else np.zeros((0, k), int)
        dense_i = np.concatenate([np.broadcast_to(BUCKETS + np.arange(k), (n, k)), BUCKETS + k + np.arange(k) * BINS + bins], axis=1)
        dense_x = np.concatenate([numbers, np.full((n, k), 0.5)], axis=1)
        lengths = np.diff(first)
        to = np.concatenate([[0], np.cumsum(lengths + 2 * k)])
        index, value = np.empty(to[-1], np.int64), np.empty(to[-1])
        dense = (to[1:] - 2 * k)[:, None] + np.arange(2 * k)
        index[dense], value[dense] = dense_i, dense_x
        words = np.ones(to[-1], bool)
        words[dense] = False
        index[words] = hashed
        value[words] = np.repeat(1 / np.sqrt(np.maximum(1, lengths)), lengths)
        return to, index, value

    def margins(self, to: np.ndarray, index: np.ndarray, value: np.ndarray) -> np.ndarray:
        vx = self.factors[index] * value[:, None]
        total = np.add.reduceat(vx, to[:-1], axis=0)
        squares = np.add.reduceat((vx * vx).sum(axis=1), to[:-1])
        return self.bias + np.add.reduceat(self.linear[index] * value, to[:-1]) + 0.5 * ((total * total).sum(axis=1) - squares)

    def scores(self, texts: pa.Array) -> np.ndarray:
        if not len(texts):
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.margins(*self.rows(*features(texts))), -30, 30)))


def fit(first: np.ndarray, hashed: np.ndarray, stats: np.ndarray, labels: np.ndarray, epochs: int = 12, rate: float = 0.1,
        ridge: float = 1e-5, batch: int = 64, seed: int = 7) -> Machine:
    """Log-loss by mini-batch Adagrad.  Without rows, or with one class only, every score is near that class's share."""
    n, k = stats.shape
    rng = np.random.default_rng(seed)
    share = (labels.sum() + 0.5) / (n + 1)
    size = BUCKETS + k + k * BINS
    if n:
        edges = np.quantile(stats, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
        mean, scale = stats.mean(axis=0), np.maximum(stats.std(axis=0), 1e-6)
    else:
        edges, mean, scale = np.zeros((k, BINS - 1)), np.zeros(k), np.ones(k)
    m = Machine(float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), mean, scale, edges)
    if n == 0 or labels.min() == labels.max():
        m.factors[:] = 0
        return m
    m.trained = True
    to, index, value = m.rows(first, hashed, stats)
    g_bias, g_linear, g_factors = 1e-8, np.full(size, 1e-8), np.full((size, FACTORS), 1e-8)
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, batch):
            pick = order[at:at + batch]
            lengths = to[pick + 1] - to[pick]
            ends = np.cumsum(lengths)
            where = np.arange(ends[-1]) + np.repeat(to[pick] - (ends - lengths), lengths)
            i, x = index[where], value[where]
            starts = np.concatenate([[0], ends])
            row = np.repeat(np.arange(len(pick)), lengths)
            vx = m.factors[i] * x[:, None]
            total = np.add.reduceat(vx, starts[:-1], axis=0)
            z = m.bias + np.add.reduceat(m.linear[i] * x, starts[:-1]) + 0.5 * ((total * total).sum(axis=1) - np.add.reduceat((vx * vx).sum(axis=1), starts[:-1]))
            err = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels[pick]) / len(pick)
            step = err.sum()
            g_bias += step * step
            m.bias -= rate * step / np.sqrt(g_bias)
            used, inverse = np.unique(i, return_inverse=True)
            dl = np.bincount(inverse, err[row] * x, len(used)) + ridge * m.linear[used]
            g_linear[used] += dl * dl
            m.linear[used] -= rate * dl / np.sqrt(g_linear[used])
            dv = (total[row] - vx) * (err[row] * x)[:, None]
            grad = np.stack([np.bincount(inverse, dv[:, f], len(used)) for f in range(FACTORS)], axis=1) + ridge * m.factors[used]
            g_factors[used] += grad * grad
            m.factors[used] -= rate * grad / np.sqrt(g_factors[used])
    return m


def held_out(id_col: Column) -> Column:
    """crc32 of the id as text is divisible by 5 (false for a null id)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality") -> Machine:
    """Fit on at most ``train_rows`` labelled rows that are not held out, the first by a hash of the id.

    The rows' features are computed on the executors; only those of the sample (at most
    ``BUCKETS`` words each) reach the driver.  Null labels and ids are left
    out; an id with several labels counts with the smallest, with several documents by each.
    """
    known = labels.select(labels[f"`{id_col}`"].cast("long").alias("id"), labels[f"`{label_col}`"].cast("int").alias("y")).dropna()
    chosen = known.filter(~held_out(F.col("id"))).groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(train_rows)

    def extract(batches):
        for batch in batches:
            for a, b in blocks(batch.column(1), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                first, hashed, stats = features(part.column(1))
                words = [hashed[first[i]:first[i + 1]].tolist() for i in range(b - a)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(words, pa.list_(pa.int32())), pa.array(stats.tolist(), pa.list_(pa.float64()))],
                                                 names=["id", "y", "words", "stats"])

    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), docs[f"`{text_col}`"].alias("text"))
    # The sample has at most train_rows rows.
    sample = rows.join(F.broadcast(chosen), "id").select("id", "text", "y").mapInArrow(extract, "id long, y int, words array<int>, stats array<double>") \
        .orderBy(F.xxhash64("id"), "id", "y", F.xxhash64("stats")).limit(train_rows).collect()
    first = np.concatenate([[0], np.cumsum([len(r.words) for r in sample])]).astype(np.int64)
    hashed = np.array([w for r in sample for w in r.words], np.int32)
    stats = np.array([r.stats for r in sample]) if sample else np.zeros((0, len(STATISTICS)))
    return fit(first, hashed, stats, np.array([float(r.y) for r in sample]))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.3, text_col: str = "text",
          score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """Every row of ``docs`` with its score and prediction (1 if the score reaches ``threshold``).

    Null and empty texts are scored by the statistics of an empty text; an empty table gives no rows.
    Input columns of the new columns' names are replaced.
    """
    model = docs.sparkSession.sparkContext.broadcast(machine)  # of fixed size
    kept = [c for c in docs.columns if c.lower() not in (score_col.lower(), predicted_col.lower())]
    rows = docs.select(*[docs[f"`{c}`"] for c in kept])
    at = kept.index(text_col)

    def judge(batches):
        for batch in batches:
            for a, b in blocks(batch.column(at), BLOCK_BYTES):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.value.scores(part.column(at)))], names=[*part.schema.names, score_col])

    schema = rows.withColumn(score_col, F.lit(0.0)).schema
    return rows.mapInArrow(judge, schema).withColumn(predicted_col, (F.col(score_col) >= threshold).cast("int"))
