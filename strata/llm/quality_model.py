"""Operator 5: a quality classifier.

Document statistics (the counts of the quality rules, as ratios) are scaled
and mapped by random Fourier features, which approximate a Gaussian kernel.
Each task adds its labelled rows into normal equations; their sums over all
tasks have a fixed size (features squared), and one small system gives the
ridge weights.  Isotonic regression over the binned training scores turns a
raw score into the share of good documents at that score, and every document
is scored.  All labelled training rows are used; nothing is sampled.

Learning leaves out held-out rows, crc32(doc_id as text) mod 5 = 0.  Labels,
lang, source and doc_id are no inputs of a score.

Defined results: a null, empty or blank text has statistics of zero and a
score like any other; a null doc_id is never held out nor labelled; labels
of one document are averaged, null ones ignored; without labels every score is
0.5; repeated rows are scored alike; other columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import Scratch, map_rows, shared
from strata.llm.quality_rules import quality_rules

STATISTICS = ("words", "lines", "line_length", "word_length", "symbols", "shouts", "capitals", "stop_words",
              "dup_lines", "repeats")
FEATURES = 192  # random features
BINS = 1000  # of a raw score's unit, for the calibration


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id and x, the array of statistics."""
    c = quality_rules(docs)
    words, lines, chars = (F.greatest(F.col(k), F.lit(1)) for k in ("n_words", "n_lines", "word_chars"))
    x = {"words": F.log1p("n_words"), "lines": F.log1p("n_lines"), "line_length": F.log1p(F.col("n_words") / lines),
         "word_length": F.col("word_chars") / words, "symbols": F.least(F.col("n_symbols") / words, F.lit(4)),
         "shouts": F.least(F.col("n_shouts") / words, F.lit(4)), "capitals": F.col("n_upper") / chars,
         "stop_words": F.col("n_stop") / words, "dup_lines": F.col("n_dup_lines") / lines,
         "repeats": F.col("n_repeat_words") / words}
    return c.select("doc_id", F.array(*[x[k].cast("double") for k in STATISTICS]).alias("x"))


class Kernel:
    """The map from scaled statistics to random Fourier features and a constant."""

    def __init__(self, mean, scale, features: int, width: float, seed: int):
        import numpy as np

        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.array(mean), np.array(scale)
        self.w = rng.normal(0, 1 / width, (len(self.mean), features))
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, rows):
        import numpy as np

        x = np.clip((np.array(rows, dtype=float).reshape(-1, len(self.mean)) - self.mean) / self.scale, -6, 6)
        z = np.sqrt(2 / len(self.b)) * np.cos(x @ self.w + self.b)
        return np.hstack([z, np.ones((len(z), 1))])


def _normal_equations(train: DataFrame, kernel: Kernel) -> tuple:
    """Sums of z z' and z y over all rows: each task's sums, then Spark's."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        total = 0
        for b in batches:
            if b.num_rows:
                z = kernel(b["x"].to_pylist())
                total = total + z.T @ np.column_stack([z, b["y"].to_numpy(zero_copy_only=False)])
        if not isinstance(total, int):
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_pydict({"i": i.ravel().astype("int32"), "j": j.ravel().astype("int32"),
                                              "v": total.ravel()})

    import numpy as np

    cells = train.select("x", "y").mapInArrow(run, "i int, j int, v double")
    cells = cells.groupBy("i", "j").agg(F.sum("v").alias("v")).groupBy("i").agg(
        F.sort_array(F.collect_list(F.struct("j", "v"))).alias("r"))
    rows = [r["r"] for r in cells.select("i", F.col("r")["v"].alias("r")).orderBy("i").collect()]
    both = np.array(rows)
    return both[:, :-1], both[:, -1]


def _isotonic(bins: list[tuple[float, float, float]]) -> tuple[list[float], list[float]]:
    """(score, rows, positives) ascending -> scores and rising values, pooled."""
    pools: list[list[float]] = []
    for s, n, y in bins:
        pools.append([s * n, n, y])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return [p[0] / p[1] for p in pools], [p[2] / p[1] for p in pools]


class Model:
    def __init__(self, kernel: Kernel | None, weights=None, at=(), value=()):
        self.kernel, self.weights, self.at, self.value = kernel, weights, at, value

    def raw(self, rows):
        return self.kernel(rows) @ self.weights

    def score(self, rows):
        import numpy as np

        if self.kernel is None:
            return np.full(len(rows), 0.5)
        raw = self.raw(rows)
        # the calibrated value; within a pool, a millionth part keeps the order
        return np.clip((1 - 1e-6) * np.interp(raw, self.at, self.value) + 1e-6 / (1 + np.exp(-np.clip(raw, -30, 30))), 0, 1)


def fit(rows: DataFrame, labels: DataFrame, ridge: float = 1e-3, width: float = 3.0,
        features: int = FEATURES, seed: int = 42) -> Model:
    """``rows``: doc_id, x; ``labels``: doc_id, quality."""
    known = labels.select("doc_id", F.col("quality").cast("double").alias("quality")).groupBy("doc_id").agg(
        F.avg("quality").alias("y")).where("y IS NOT NULL")
    train = rows.join(known, "doc_id").where(~held_out())
    size = len(STATISTICS)
    got = train.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("x")[i]).alias(f"{k}{i}") for i in range(size)
                                                   for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not got["n"]:
        return Model(None)
    kernel = Kernel([got[f"m{i}"] for i in range(size)], [got[f"s{i}"] or 1.0 for i in range(size)], features, width, seed)
    import numpy as np

    a, c = _normal_equations(train, kernel)
    weights = np.linalg.solve(a + ridge * got["n"] * np.eye(len(a)) / features, c)
    model = Model(kernel, weights)
    scored = map_rows(train.select("x", "y"), lambda b: {
        "bin": np.clip(np.rint(model.raw(b["x"]) * BINS), -BINS, 2 * BINS).astype(int).tolist(), "y": b["y"]}, "bin long, y double")
    bins = scored.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).orderBy("bin").collect()
    model.at, model.value = _isotonic([(r["bin"] / BINS, r["n"], r["y"]) for r in bins])  # at most 3 * BINS rows
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scratch = Scratch(docs.sparkSession, "quality-model")
    rows = scratch.keep(statistics(docs))
    sent = shared(docs.sparkSession, fit(rows, labels))
    scored = map_rows(rows, lambda b: {"doc_id": b["doc_id"], "score": sent().score(b["x"]).tolist()},
                      "doc_id long, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
