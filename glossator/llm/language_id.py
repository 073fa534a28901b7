"""Language identification by a byte convolutional network.

A text is cut into fixed-length windows of bytes that cover all of it. Filters
of several widths run over a window, each is max-pooled over its positions,
and a softmax over the pooled values gives the window's language. A document
has the mean of its windows' probabilities, weighted by their bytes.

The filters act on one-hot bytes, so a filter is a table of 256 values for each
of its bytes. For inference two neighbouring bytes share a table of 65,536
rows, which halves the lookups. The network is trained in numpy on labelled
rows; how many is a parameter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
TRAIN_ROWS = 1500
ROW_WINDOWS = 6
MIN_CONFIDENCE = 0.5


@dataclass
class ByteCNN:
    """Filter tables by width (offset x byte x filter), their biases, and the softmax layer."""

    languages: list[str]
    tables: dict[int, np.ndarray]
    biases: dict[int, np.ndarray]
    dense: np.ndarray
    dense_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> np.ndarray:
        """Max-pooled, rectified filter values (windows x filters) of byte windows; byte 0 is padding."""
        narrow = windows.astype(np.int32)
        two = narrow[:, :-1] * 256 + narrow[:, 1:]
        out = []
        for width in self.tables:
            pairs = self._pairs()[width]
            last = windows.shape[1] - width + 1
            total = np.take(pairs[0], two[:, :last], axis=0)
            for j in range(2, width, 2):
                total += np.take(pairs[j // 2], two[:, j : j + last], axis=0) if j + 1 < width else np.take(pairs[j // 2], narrow[:, j : j + last], axis=0)
            out.append(np.maximum(total.max(axis=1) + self.biases[width], 0))
        return np.concatenate(out, axis=1)

    def _pairs(self) -> dict[int, list[np.ndarray]]:
        if not hasattr(self, "_pair_tables"):
            self._pair_tables = {
                w: [
                    np.ascontiguousarray((t[j][:, None, :] + t[j + 1][None]).reshape(65536, -1)) if j + 1 < w else t[j]
                    for j in range(0, w, 2)
                ]
                for w, t in self.tables.items()
            }
        return self._pair_tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        logits = self.pooled(windows) @ self.dense + self.dense_bias
        logits -= logits.max(axis=1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(axis=1, keepdims=True)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pair_tables"}


def cut(raw: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, row of each window, bytes in it) of rows ``raw[offsets[i]:offsets[i+1]]``.

    The last window of a row is padded with 0. An empty row has none.
    """
    sizes = np.diff(offsets)
    counts = -(-sizes // window)
    row = np.repeat(np.arange(len(sizes)), counts)
    step = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    begin = offsets[:-1][row] + step * window
    held = np.minimum(window, offsets[1:][row] - begin)
    padded = np.concatenate([raw, np.zeros(window, dtype=np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, window)[begin].copy()
    short = np.flatnonzero(held < window)
    windows[short] *= np.arange(window)[None] < held[short][:, None]
    return windows, row, held


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], filters: int = FILTERS, widths=WIDTHS, steps: int = 500, batch: int = 96, rate: float = 0.02, seed: int = 11) -> ByteCNN:
    """Fit the network by Adam on the cross-entropy; the same input gives the same network."""
    rng = np.random.default_rng(seed)
    k = len(languages)
    net = ByteCNN(
        list(languages),
        {w: (rng.standard_normal((w, 256, filters)) * 0.3).astype(np.float32) for w in widths},
        {w: np.zeros(filters, dtype=np.float32) for w in widths},
        (rng.standard_normal((filters * len(widths), k)) * 0.3).astype(np.float32),
        np.zeros(k, dtype=np.float32),
    )
    params = [*net.tables.values(), *net.biases.values(), net.dense, net.dense_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    if k < 2 or not len(windows):
        return net
    for step in range(1, steps + 1):
        pick = rng.integers(0, len(windows), batch)
        x, y = windows[pick].astype(np.int64), labels[pick]
        pools, argmaxes = [], []
        for w in widths:
            last = x.shape[1] - w + 1
            total = sum(net.tables[w][j][x[:, j : j + last]] for j in range(w)) + net.biases[w]
            arg = total.argmax(axis=1)
            pools.append(np.take_along_axis(total, arg[:, None, :], axis=1)[:, 0])
            argmaxes.append(arg)
        z = np.concatenate(pools, axis=1)
        hidden = np.maximum(z, 0)
        logits = hidden @ net.dense + net.dense_bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        delta = e / e.sum(axis=1, keepdims=True)
        delta[np.arange(batch), y] -= 1
        delta /= batch
        grad_dense, grad_bias = hidden.T @ delta, delta.sum(0)
        back = (delta @ net.dense.T) * (z > 0)
        grad_tables, grad_biases = [], []
        for n, w in enumerate(widths):
            own = back[:, n * filters : (n + 1) * filters]
            grad = np.zeros_like(net.tables[w])
            for j in range(w):
                met = np.take_along_axis(x, argmaxes[n] + j, axis=1)
                np.add.at(grad[j], (met, np.arange(filters)[None]), own)
            grad_tables.append(grad)
            grad_biases.append(own.sum(0))
        slow = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for p, g, m, v in zip(params, [*grad_tables, *grad_biases, grad_dense, grad_bias], first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= (slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return net


def _edges(keyed: DataFrame, total: dict[str, int], wanted: int) -> dict[str, int]:
    """For each label the hash up to which its ``wanted`` smallest hashes go; all of it where there are fewer.

    No row is ranked among all rows of its label: a share of the hashes that
    should hold about twice what is wanted is looked at, and doubled for the
    labels for which it held too few, as with many repeated rows.
    """
    low, high = -(2**63), 2**63 - 1
    share = {label: min(1.0, 2 * wanted / n + 1e-6) for label, n in total.items()}
    edge: dict[str, int] = {}
    while left := {label: s for label, s in share.items() if label not in edge}:
        cut = F.lit(False)
        for label, s in left.items():
            cut = cut | ((F.col("label") == label) & (F.col("h") <= (high if s >= 1 else low + int(s * 2.0**64))))
        found: dict[str, list[int]] = {label: [] for label in left}
        for r in keyed.select("label", "h").filter(cut).distinct().collect():
            found[r.label].append(r.h)
        for label, hashes in found.items():
            if len(hashes) >= wanted:
                edge[label] = sorted(hashes)[wanted - 1]
            elif left[label] >= 1:
                edge[label] = high
            else:
                share[label] = min(1.0, 2 * left[label])
    return edge


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = TRAIN_ROWS, row_windows: int = ROW_WINDOWS, window: int = WINDOW, seed: int = 11, **options) -> ByteCNN:
    """Train on at most ``train_rows`` labelled rows of each label.

    Of each label those with the smallest hashes of id and text train, whatever
    order the table is in; repeated rows train once. Each gives at most
    ``row_windows`` windows, spread evenly over the whole text. Rows with a
    null label, or a null or empty text, give none. Without two labels the
    network knows the one label it has seen, or none. Labels are assumed to be
    few: one count for each is held on the driver.
    """
    text = F.col(text_col).cast("binary")
    keyed = docs.select(F.xxhash64(F.col(id_col), text).alias("h"), F.col(label_col).cast("string").alias("label"), text.alias("t")).filter("label is not null and octet_length(t) > 0")
    total = {r.label: r.n for r in keyed.groupBy("label").agg(F.count("*").alias("n")).collect()}
    languages = sorted(total)
    if not languages:
        return train(np.empty((0, window), np.uint8), np.empty(0, np.int64), [])
    edge = _edges(keyed, total, train_rows)
    within = F.lit(False)
    for label in languages:
        within = within | ((F.col("label") == label) & (F.col("h") <= edge[label]))
    size = F.octet_length("t")
    last = F.least(F.lit(row_windows), F.ceil(size / window)).cast("int") - 1
    places = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("t"), F.floor(i * F.greatest(size - window, F.lit(0)) / F.greatest(last, F.lit(1))).cast("int") + 1, F.lit(window)))
    # Rows of one hash are one row; of repeats, however many, each task sends one.
    chosen = keyed.filter(within).groupBy("label", "h").agg(F.min(places).alias("ws"))
    rows = [(r.label, r.h, t) for r in chosen.collect() for t in r.ws]
    rows.sort(key=lambda r: (r[0], r[1], bytes(r[2])))
    raw = np.frombuffer(b"".join(r[2] for r in rows), dtype=np.uint8)
    windows, row, _ = cut(raw, np.r_[0, np.cumsum([len(r[2]) for r in rows])], window)
    label = np.array([languages.index(r[0]) for r in rows], dtype=np.int64)[row]
    return train(windows, label, languages, seed=seed, **options)


def _scorer(net, window: int):
    piece = 1024

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cnn = net.value
        k = len(cnn.languages)
        for batch in batches:
            text = batch.column("t").cast(pa.binary()).fill_null(b"")
            _, where, data = text.buffers()
            offsets = np.frombuffer(where, dtype=np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64) if len(text) else np.zeros(1, np.int64)
            raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
            total = np.zeros((batch.num_rows, max(k, 1)))
            # Rows are taken so many at a time that their windows stay small; a longer row is taken in parts.
            spans = []
            for i in range(batch.num_rows):
                for lo in range(int(offsets[i]), int(offsets[i + 1]), window * piece):
                    spans.append((i, lo, min(lo + window * piece, int(offsets[i + 1]))))
            at = 0
            while at < len(spans):
                end, weight = at, 0
                while end < len(spans) and (end == at or weight < window * piece):
                    weight += spans[end][2] - spans[end][1]
                    end += 1
                part = spans[at:end]
                own = np.concatenate([raw[a:b] for _, a, b in part])
                windows, row, held = cut(own, np.r_[0, np.cumsum([b - a for _, a, b in part])], window)
                if k:
                    np.add.at(total, np.array([p[0] for p in part])[row], cnn.probabilities(windows) * held[:, None])
                at = end
            size = np.diff(offsets)
            mean = total / np.maximum(size, 1)[:, None]
            best = mean.argmax(axis=1)
            known = (size > 0) & (k > 0)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c) for c in batch.schema.names if c != "t"),
                    pa.array([cnn.languages[b] if ok else None for b, ok in zip(best, known)], type=pa.string()),
                    pa.array(np.where(known, mean.max(axis=1), 0.0)),
                ],
                names=[*(c for c in batch.schema.names if c != "t"), "language", "confidence"],
            )

    return score


def identified(docs: DataFrame, net: ByteCNN, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, accepted: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(doc_id, text_hash, language, confidence, accepted), one row for each input row.

    ``accepted``: the language is in the list (any language the network knows,
    without a list) and its probability is at least ``min_confidence``. A null
    or empty text has no language, confidence 0, and is rejected. Texts are
    read whole, however long; ties go to the first language of the alphabet. A
    null id passes through, repeated rows each have their row, an empty table
    gives none. Other columns are not looked at.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(net)
    src = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col).cast("string")).alias("text_hash"), F.col(text_col).cast("string").alias("t"))
    kind = src.schema["doc_id"].dataType.simpleString()
    found = src.mapInArrow(_scorer(shared, window), f"doc_id {kind}, text_hash long, language string, confidence double")
    good = F.col("language").isNotNull() & (F.col("confidence") >= min_confidence)
    if accepted is not None:
        good = good & F.col("language").isin(accepted)
    return found.withColumn("accepted", good)


def keep_identified(docs: DataFrame, net: ByteCNN, text_col: str = "text", window: int = WINDOW, accepted: list[str] | None = None, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """The rows of ``docs`` whose language is accepted, all columns kept (see :func:`identified`).

    Rows are judged where they are read: nothing is shuffled or joined.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)
    names = docs.columns
    at = names.index(text_col)
    score = _scorer(shared, window)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for batch in batches:
            seen = next(score(iter([pa.RecordBatch.from_arrays([batch.column(at).cast(pa.string())], names=["t"])])))
            good = pc.and_(pc.is_valid(seen.column("language")), pc.greater_equal(seen.column("confidence"), min_confidence))
            if accepted is not None:
                good = pc.and_(good, pc.is_in(seen.column("language"), value_set=pa.array(accepted, type=pa.string())))
            yield batch.filter(good)

    private = docs.toDF(*[f"c{i}" for i in range(len(names))])
    return private.mapInArrow(keep, private.schema).toDF(*names)


def accuracy(docs: DataFrame, net: ByteCNN, label_col: str = "lang", text_col: str = "text") -> pd.DataFrame:
    """Rows by label and predicted language."""
    both = docs.select(F.col(label_col).alias("doc_id"), F.col(text_col).alias("text"))
    return identified(both, net).groupBy(F.col("doc_id").alias("label"), "language").count().toPandas()
