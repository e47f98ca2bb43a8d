"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated isotonically.

Statistics of the whole text are standardised and mapped to cosines of random projections, which
approximate a Gaussian kernel. Each partition sums its part of the normal equations, the driver adds
these and solves; part of the labelled rows is held back to calibrate the ridge scores by isotonic
regression (pool adjacent violators on a histogram of bounded size). Only the text is looked at.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import if_small, map_arrow, stored, texts

#: Fourier features; width of the kernel in standard deviations; ridge penalty a row.
FEATURES, WIDTH, PENALTY = 256, 4.0, 1e-4
#: At most about so many labelled rows are fitted on, chosen by a hash of doc_id; the rest of the corpus is only scored.
FIT_ROWS = 200_000
#: Tasks that sum normal equations, and bins of scores for calibration: bounds of what the driver gets.
FIT_TASKS, BINS = 16, 2048
#: Labelled rows whose hash is 0 modulo this calibrate, the others fit.
CALIBRATE = 4

STATISTICS = ("chars", "words", "word_length", "distinct", "top_word", "adjacent", "bigrams", "lines", "line_repeats", "line_length", "short", "upper", "digits", "signs", "odd_signs", "entropy", "deflated", "end")


def statistics(text: str) -> list[float]:
    """Numbers that describe a text; all 0 for an empty or blank one, apart from its length."""
    words = text.split()
    if not words:
        return [math.log1p(len(text))] + [0.0] * (len(STATISTICS) - 1)
    n, chars = len(words), len(text)
    counts = Counter(words)
    raw = text.encode("utf-8", "surrogatepass")
    hist = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = hist[hist > 0] / len(raw)
    lines = [x for x in text.split("\n") if x.strip()]
    letters, upper, digits, space = int(hist[97:123].sum() + hist[128:].sum()), int(hist[65:91].sum()), int(hist[48:58].sum()), int(hist[[9, 10, 11, 12, 13, 32]].sum())
    signs = len(raw) - letters - upper - digits - space
    plain = int(hist[[33, 39, 44, 46, 58, 59, 63]].sum())
    lengths = sum(map(len, words))
    return [
        math.log1p(chars), math.log1p(n), lengths / n, len(counts) / n, max(counts.values()) / n,
        sum(map(str.__eq__, words, words[1:])) / n, len(set(zip(words, words[1:], strict=False))) / max(1, n - 1),
        math.log1p(len(lines)), 1 - len(set(lines)) / max(1, len(lines)), math.log1p(chars / max(1, len(lines))),
        sum(c for w, c in counts.items() if len(w) <= 3) / n, upper / len(raw), digits / len(raw), signs / len(raw), (signs - plain) / len(raw),
        float(-(p * np.log2(p)).sum()), len(zlib.compress(raw, 1)) / len(raw), float(words[-1][-1] in ".!?…\"'»)"),
    ]


def document_statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, stats (array of doubles) and the columns to keep of every row; a null text is the empty one."""
    keep = keep or []

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in texts(batch.column(1))], np.float64).reshape(-1, len(STATISTICS))
            stats = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS), rows.reshape(-1))
            yield pa.RecordBatch.from_arrays([batch.column(0), stats, *batch.columns[2:]], names=["doc_id", "stats", *keep])

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("stats", T.ArrayType(T.DoubleType())), *(docs.schema[c] for c in keep)])
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *keep), run, schema)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass
class QualityModel:
    mean: np.ndarray
    scale: np.ndarray
    frequencies: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    #: Scores and calibrated probabilities between which scores are interpolated.
    knots: tuple[np.ndarray, np.ndarray]

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.frequencies + self.phases) * math.sqrt(2 / len(self.phases)), np.ones((len(z), 1))], 1)

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.ridge(stats), *self.knots), 0.0, 1.0)


def pool_adjacent(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rising sequence nearest to values, weighted by counts."""
    blocks: list[list[float]] = []
    for v, c in zip(values.tolist(), counts.tolist(), strict=True):
        blocks.append([v * c, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, c, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + c, blocks[-1][2] + n]
    return np.repeat([s / c for s, c, _ in blocks], [n for *_, n in blocks])


def training_rows(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id and label of labels (doc_id, quality) that aren't held out, about fit_rows of them at most, by a hash of doc_id; the lower one where labels contradict each other."""
    known = labels.where("doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("label"))
    known = stored(known.where("label in (0, 1)"), "labels")
    share = min(1.0, fit_rows / max(1, known.count()))
    part = F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 20))
    return if_small(known.where(part < int(share * (1 << 20))))


def fit(labelled: DataFrame, seed: int = 7) -> QualityModel:
    """labelled: doc_id, stats, label (0 or 1). Without rows of both labels the score is the labels' mean (0.5 if there are none)."""
    kept = stored(labelled.where("label in (0, 1)").withColumn("held", F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(CALIBRATE)) == 0).select("stats", F.col("label").cast("double").alias("label"), "held").repartition(FIT_TASKS), "quality-rows")
    k = len(STATISTICS)
    moments = kept.agg(F.count("*"), F.avg("label"), *(F.avg(F.get("stats", F.lit(i))) for i in range(k)), *(F.stddev_pop(F.get("stats", F.lit(i))) for i in range(k))).first()
    rng = np.random.default_rng(seed)
    mean = np.array([x or 0.0 for x in moments[2 : 2 + k]])
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in moments[2 + k :]])
    model = QualityModel(mean, scale, rng.normal(0, 1 / WIDTH, (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES), np.zeros(FEATURES + 1), (np.array([0.0, 1.0]), np.array([moments[1] if moments[0] else 0.5] * 2, float)))
    if not moments[0] or moments[1] in (0.0, 1.0):
        return model
    d = FEATURES + 1

    def normal(batches):
        a, b = np.zeros((d, d)), np.zeros(d)
        for batch in batches:
            x = model.features(_matrix(batch.column(0)))
            a += x.T @ x
            b += x.T @ batch.column(1).to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())], names=["a", "b"])

    sums = map_arrow(kept.where("not held").select("stats", "label").coalesce(FIT_TASKS), normal, "a binary, b binary").collect()
    a, b = (sum(np.frombuffer(r[i]) for r in sums) for i in (0, 1))
    a = a.reshape(d, d)
    rows = max(1.0, a[-1, -1])
    ridge = np.eye(d) * PENALTY * rows
    ridge[-1, -1] = 1e-9
    model.weights = np.linalg.solve(a + ridge, b)

    def scored(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(model.ridge(_matrix(batch.column(0)))), batch.column(1)], names=["ridge", "label"])

    bins = map_arrow(kept.where("held").select("stats", "label"), scored, "ridge double, label double").groupBy(F.floor(F.col("ridge") * (BINS // 8)).alias("bin")).agg(F.count("*").alias("n"), F.avg("label").alias("label"), F.avg("ridge").alias("ridge")).orderBy("bin").collect()
    if bins:
        at, n, y = (np.array([r[c] for r in bins], float) for c in ("ridge", "n", "label"))
        # one row of either label at the ends keeps scores off 0 and 1
        level = pool_adjacent((y * n + np.array([moments[1]] * len(n))) / (n + 1), n)
        starts = np.flatnonzero(np.concatenate([[True], level[1:] > level[:-1]]))
        ends = np.append(starts[1:], len(level))
        centres = np.array([(at[s:e] * n[s:e]).sum() / n[s:e].sum() for s, e in zip(starts, ends, strict=True)])
        probability = level[starts]
        # beyond the outer blocks scores go on to 0 and 1, so that ranks there aren't lost
        model.knots = (np.concatenate([[min(centres[0], 0.0) - 1.0], centres, [max(centres[-1], 1.0) + 1.0]]), np.concatenate([[0.0], probability, [1.0]]))
    return model


def score(stats: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    return map_arrow(stats.select("doc_id", "stats"), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: QualityModel, least: float) -> DataFrame:
    """The rows of docs whose text scores least or more, with all their columns."""
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            rows = np.array([statistics(t) for t in texts(batch.column(at))], np.float64).reshape(-1, len(STATISTICS))
            yield batch.filter(pa.array(model.score(rows) >= least))

    return map_arrow(docs, run, docs.schema)


def held_out(doc_id: F.Column) -> F.Column:
    """Rows that no model may learn from: crc32 of the id as text leaves 1 modulo 3."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "utf-8")) % 3 == 1


def fit_and_score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score of every row of docs (doc_id, text), learned from labels (doc_id, quality) that aren't held out.

    Null texts count as empty; every row gets a score. Where labels contradict each other for a doc_id, the lower counts.
    """
    stats = stored(document_statistics(docs), "statistics")
    model = fit(stats.join(training_rows(labels), "doc_id"))
    return score(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score")
