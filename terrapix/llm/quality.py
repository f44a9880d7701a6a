"""Quality classifier: a regularised quadratic discriminant over transformed statistics of a document.

Each class has its own mean and covariance over the statistics; covariances shrink towards the pooled one, and that
towards its diagonal. The score is the logistic of the difference of the two log densities and priors, taken from
Mahalanobis distances by Cholesky factors that are worked out once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, NOT_SPACE, Rolling, bytes_of, documents, passes, prepare, stored, words

#: Shrinkage of a class's covariance to the pooled one and of that to its diagonal; ridge.
TO_POOLED, TO_DIAGONAL, RIDGE = 0.2, 0.1, 1e-3
#: Bins of the histogram that log-density differences are calibrated by: so many to a unit of their inverse hyperbolic sine.
BINS = 50

#: Classes of bytes that are counted, by a bit each.
UPPER, LOWERCASE, DIGIT, SPACE, LINE, MARK, SIGN, WIDE = (1 << k for k in range(8))
KIND = np.zeros(256, np.uint8)
KIND[65:91], KIND[97:123], KIND[48:58], KIND[128:] = UPPER, LOWERCASE, DIGIT, WIDE
KIND[[9, 11, 12, 13, 32]], KIND[10] = SPACE, LINE
KIND[33:48] = KIND[58:65] = KIND[91:97] = KIND[123:127] = SIGN
KIND[[ord(c) for c in ".,;:!?'\"-()"]] = MARK
NAMES = (
    "log_bytes log_words log_lines upper lower digit wide mark sign space word_len word_len_sd long_words distinct distinct_pairs top_word "
    "repeated_lines words_a_line line_sd entropy caps_words sign_ends mark_ends pipes"
).split()


def row_sums(values: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(rows, values, n)


def distinct_by_row(keys: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each row, and the count of the commonest."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, rows))
    k, r = keys[order], rows[order]
    first = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (r[1:] != r[:-1])))
    top = np.zeros(n)
    np.maximum.at(top, r[first], np.diff(np.append(first, len(k))))
    return np.bincount(r[first], minlength=n).astype(float), top


def statistics(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text; shares become square roots, counts logarithms."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    rows = np.repeat(np.arange(n), np.diff(offsets))
    kind = KIND[raw]
    whole = np.maximum(size, 1)
    share = lambda k: np.sqrt(row_sums(kind == k, rows, n) / whole)
    low = LOWER[raw]
    starts, ends, of = words(low, offsets, NOT_SPACE)
    length = (ends - starts).astype(float)
    n_words = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(n_words, 1)
    mean = row_sums(length, of, n) / some
    spread = np.sqrt(np.maximum(row_sums(length**2, of, n) / some - mean**2, 0))
    rolling = Rolling(low)
    h = rolling.ranges(starts, ends) if len(starts) else np.zeros(0, np.uint64)
    distinct, top = distinct_by_row(h, of, n)
    together = of[1:] == of[:-1]
    pairs = (h[:-1] * np.uint64(3) + h[1:])[together]
    distinct_pairs, _ = distinct_by_row(pairs, of[:-1][together], n)
    line_bytes = np.ones(256, bool)
    line_bytes[10] = False
    ls, le, lo = words(raw, offsets, line_bytes)
    n_lines = np.maximum(np.bincount(lo, minlength=n), 1).astype(float)
    distinct_lines, _ = distinct_by_row(rolling.ranges(ls, le) if len(ls) else np.zeros(0, np.uint64), lo, n)
    line_mean = row_sums((le - ls).astype(float), lo, n) / n_lines
    line_sd = np.sqrt(np.maximum(row_sums((le - ls).astype(float) ** 2, lo, n) / n_lines - line_mean**2, 0))
    cells = np.bincount(rows * 256 + raw, minlength=n * 256).reshape(n, 256) / whole[:, None]
    entropy = -(cells * np.log2(np.maximum(cells, 1e-12))).sum(1)
    last = kind[ends - 1]
    ups = np.append(0, np.cumsum(kind == UPPER))
    caps = (ups[ends] - ups[starts] >= 2) & (2 * (ups[ends] - ups[starts]) > length)
    of_words = lambda x: np.sqrt(row_sums(x, of, n) / some)
    columns = [
        np.log1p(size), np.log1p(n_words), np.log1p(n_lines), share(UPPER), share(LOWERCASE), share(DIGIT), share(WIDE), share(MARK), share(SIGN), share(SPACE),
        np.log1p(mean), np.log1p(spread), of_words(length > 15), distinct / some, distinct_pairs / np.maximum(n_words - 1, 1), np.sqrt(top / some),
        np.sqrt(np.maximum(np.bincount(lo, minlength=n) - distinct_lines, 0) / n_lines), np.log1p(n_words / n_lines), np.log1p(line_sd), entropy,
        of_words(caps), of_words(last == SIGN), of_words(last == MARK), np.sqrt(row_sums(raw == ord("|"), rows, n) / whole),
    ]
    return np.stack(columns, 1)


@dataclass
class Discriminant:
    """A fitted model: per class the log of prior and determinant, mean and inverse Cholesky factor."""

    centre: np.ndarray
    scale: np.ndarray
    classes: list[tuple[float, np.ndarray, np.ndarray]]
    temperature: float = 1.0

    def difference(self, x: np.ndarray) -> np.ndarray:
        """Log density and prior of class 1 less those of class 0; 0 where a class is missing from the labels."""
        if len(self.classes) < 2:
            return np.zeros(len(x))
        z = (x - self.centre) / self.scale
        log0, log1 = (c - 0.5 * (((z - mean) @ inverse.T) ** 2).sum(1) for c, mean, inverse in self.classes)
        return log1 - log0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1."""
        return 1 / (1 + np.exp(-np.clip(self.difference(x) / self.temperature, -500, 500)))


def calibrated(d: np.ndarray, n0: np.ndarray, n1: np.ndarray) -> float:
    """The temperature of largest likelihood for differences d with n0 and n1 rows of each class.

    Each class's rows count as (n + 1) / (n + 2) sure of it, so that classes far apart don't ask for certainty.
    """
    t0, t1 = 1 / (n0.sum() + 2), (n1.sum() + 1) / (n1.sum() + 2)
    grid = np.exp(np.linspace(np.log(0.1), np.log(1000.0), 400))
    z = np.clip(d[:, None] / grid[None, :], -500, 500)
    low, high = np.logaddexp(0, -z), np.logaddexp(0, z)  # minus the logs of p and 1 - p
    loss = (n0[:, None] * (t0 * low + (1 - t0) * high) + n1[:, None] * (t1 * low + (1 - t1) * high)).sum(0)
    return float(grid[loss.argmin()])


def fit(sums: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float = TO_POOLED, to_diagonal: float = TO_DIAGONAL) -> Discriminant:
    """From count, sum and sum of products of each class."""
    p = len(NAMES)
    total = sum(n for n, _, _ in sums.values())
    if len(sums) < 2 or total < 2:
        return Discriminant(np.zeros(p), np.ones(p), [])
    centre = sum(s for _, s, _ in sums.values()) / total
    scale = np.sqrt(np.maximum(np.diag(sum(q for _, _, q in sums.values())) / total - centre**2, 1e-6))
    means, covs = {}, {}
    for k, (n, s, q) in sums.items():
        m = s / n
        means[k] = (m - centre) / scale
        covs[k] = (q / n - np.outer(m, m)) / np.outer(scale, scale)
    pooled = sum(sums[k][0] * covs[k] for k in sums) / total
    pooled = (1 - to_diagonal) * pooled + to_diagonal * np.diag(np.diag(pooled))
    classes = []
    for k in (0, 1):
        cov = (1 - to_pooled) * covs[k] + to_pooled * pooled + RIDGE * np.eye(p)
        factor = np.linalg.cholesky(cov)
        classes.append((np.log(sums[k][0] / total) - np.log(np.diag(factor)).sum(), means[k], np.linalg.inv(factor)))
    return Discriminant(centre, scale, classes)


def _statistics(batches):
    for batch in batches:
        raw, offsets = bytes_of(batch.column("text"))
        for i, j in passes(offsets):
            x = statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, len(NAMES), dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), lists], ["doc_id", "x"])


def _moments(batches):
    """Count, sums and products of each class, as one flat array per class and task."""
    p = len(NAMES)
    held = {k: np.zeros(1 + p + p * p) for k in (0, 1)}
    for batch in batches:
        x = batch.column("x").flatten().to_numpy().reshape(-1, p)
        y = batch.column("quality").to_numpy(zero_copy_only=False)
        for k in (0, 1):
            z = x[y == k]
            held[k] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
    for k, v in held.items():
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k, np.int32)), pa.array(np.arange(len(v), dtype=np.int32)), pa.array(v)], ["quality", "at", "v"])


def _histogram(model: Discriminant):
    """Binned differences of labelled rows, counted by class; their number follows the bins, not the rows."""

    def go(batches):
        for batch in batches:
            d = model.difference(batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES)))
            bins = np.clip(np.rint(np.arcsinh(d) * BINS), -20 * BINS, 20 * BINS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bins), batch.column("quality")], ["bin", "quality"])

    return go


def features(df: DataFrame) -> DataFrame:
    """doc_id and its statistics."""
    prepare(df.sparkSession)
    return documents(df).mapInArrow(_statistics, "doc_id long, x array<double>")


def in_training(doc_id: Column) -> Column:
    """Rows that may teach: crc32 of the id as text, mod 3, isn't 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1


def fit_quality(stats: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit and calibrate on every labelled row that may teach; just sums of fixed size reach the driver."""
    known = labels.where(in_training(F.col("doc_id")) & F.col("quality").isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("quality"))
    taught = stats.join(known, "doc_id").select("x", "quality")
    sums = taught.mapInArrow(_moments, "quality int, at int, v double").groupBy("quality", "at").agg(F.sum("v").alias("v"))
    p = len(NAMES)
    flat = {k: np.zeros(1 + p + p * p) for k in (0, 1)}
    for r in sums.collect():
        flat[r.quality][r.at] = r.v
    model = fit({k: (v[0], v[1 : 1 + p], v[1 + p :].reshape(p, p)) for k, v in flat.items() if v[0] > 0})
    if model.classes:
        counts = taught.mapInArrow(_histogram(model), "bin int, quality int").groupBy("bin").agg(*(F.count_if(F.col("quality") == k).alias(f"n{k}") for k in (0, 1))).collect()
        bins, n0, n1 = (np.array([r[k] for r in counts], float) for k in ("bin", "n0", "n1"))
        model.temperature = calibrated(np.sinh(bins / BINS), n0, n1)
    return model


def _scores(model: Discriminant):
    def go(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return go


def score_quality(df: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted of every document; labels: doc_id, quality.

    Statistics of the whole text are the only inputs. Null and empty texts score as texts of length 0. Without labels of
    both classes every score is 0.5. A document with several labels counts once, by the largest. Repeated rows score
    alike; an empty table gives an empty result; other columns are ignored. Rows without doc_id are left out.
    """
    stats = stored(features(df), "op7-statistics")
    scored = stats.mapInArrow(_scores(fit_quality(stats, labels)), "doc_id long, score double")
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def _keep(model: Discriminant):
    def go(batches):
        for batch in batches:
            raw, offsets = bytes_of(batch.column("text"))
            for i, j in passes(offsets):
                good = model.score(statistics(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])) >= 0.5
                yield batch.slice(i, j - i).filter(pa.array(good))

    return go


def keep_good(df: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows that the classifier, fitted on df's labelled rows, predicts as 1, with all their columns.

    Rows are scored where they are read; just the labelled ones' texts are shuffled, and their statistics stored. Null
    and empty texts are scored as texts of length 0, so such rows stay or go like others; ties at 0.5 stay; repeated
    rows stay or go alike; rows without doc_id are scored too. Without labels of both classes every row stays. An empty
    table gives an empty result.
    """
    prepare(df.sparkSession)
    known = labels.where(in_training(F.col("doc_id")) & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    labelled = documents(df).join(known, "doc_id", "left_semi")
    return df.mapInArrow(_keep(fit_quality(stored(features(labelled), "quality-statistics"), labels)), df.schema)
