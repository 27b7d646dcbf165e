"""What the classifiers share: folds, bounded samples of labelled rows, counts, calibration."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.workspace import Workspace


def held_out(modulus: int, remainder: int) -> Column:
    """Rows whose labels are never looked at: crc32 of the id as text leaves ``remainder``. A null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def sample(documents: DataFrame, labels: DataFrame, label: str, hidden: Column, per_class: int, ws: Workspace):
    """At most ``per_class`` labelled documents of either class, by the smallest hashes of their ids, as a table of
    (doc_id, label, text); and how many labelled rows each class has. Several labels of an id count as their largest."""
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~hidden)
        .groupBy("doc_id")
        .agg((F.max(label) > 0).cast("int").alias("label"))
    )
    known = ws.table(known, "labels")
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    # two bounded lists of ids
    picked = None
    for value in (0, 1):
        part = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = documents.where("doc_id IS NOT NULL").select("doc_id", "text").join(picked, "doc_id")
    return ws.table(texts.dropDuplicates(["doc_id"]), "sample"), totals


def class_weights(y: np.ndarray, totals: dict) -> np.ndarray:
    """Each example stands for its share of the labelled rows of its class."""
    weight = np.ones(len(y))
    for value in (0, 1):
        mine = y == value
        if mine.any():
            weight[mine] = totals.get(value, mine.sum()) / mine.sum()
    return weight


def document_frequencies(documents: DataFrame, features, names: list[str]) -> tuple[np.ndarray, int]:
    """In how many of all documents each of the bounded list of features occurs, and the number of documents.

    ``features(batches)`` yields (document, feature, count) arrays and the number of documents of each chunk.
    """
    n = len(names)

    def count(batches):
        total, seen = np.zeros(n, np.int64), 0
        for _, feature, _, docs in features(batches):
            total += np.bincount(feature, minlength=n)
            seen += docs
        yield pa.record_batch([pa.array(np.arange(n + 1)), pa.array(np.append(total, seen))], names=["feature", "n"])

    rows = documents.select("text").mapInArrow(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    out = np.zeros(n + 1, np.int64)
    for r in rows.collect():  # one row per listed feature
        out[r["feature"]] = r["n"]
    return out[:n], int(out[n])


class Isotonic:
    """Monotone calibration of votes to probabilities (pool adjacent violators), with one example's pull to the base rate."""

    def __init__(self, votes: np.ndarray, y: np.ndarray, weight: np.ndarray):
        base = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
        value, index = np.unique(votes, return_inverse=True)
        mass = np.bincount(index, weight)
        mean = np.bincount(index, weight * y) / mass if len(y) else mass
        pools: list[list[float]] = []  # [mean, mass, values]
        for m, w in zip(mean.tolist(), mass.tolist(), strict=True):
            pools.append([m, w, 1])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                m2, w2, k2 = pools.pop()
                m1, w1, k1 = pools.pop()
                pools.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, k1 + k2])
        unit = float(np.mean(weight)) if len(weight) else 1.0
        self.knots = value
        self.levels = np.repeat([(m * w + base * unit) / (w + unit) for m, w, _ in pools], [int(k) for _, _, k in pools])

    def __call__(self, votes: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.zeros(len(votes))
        return np.clip(np.interp(votes, self.knots, self.levels), 0.0, 1.0)
