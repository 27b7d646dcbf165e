"""Quality by nearest neighbours in a latent-semantic space: exact blocked cosines, votes by similarity.

Terms are forms, since quality shows in how words are written and repeated rather than in
which they are: the shape of a word (letter case, digits, marks), two shapes in a row, and a
word that repeats the one before it. ``fit`` takes a bounded sample of labelled rows, lists
its commonest terms, counts their document frequencies over all documents, and takes the leading
right singular vectors of the sample's TF-IDF matrix (eigenvectors of its Gram matrix). The
labelled vectors are broadcast (at most 2 * PER_CLASS rows of RANK numbers); every document is
projected, and its cosines with all of them are matrix products over blocks. The nearest
``NEIGHBOURS`` vote with their similarity and what they stand for in their class; votes are
calibrated on the sample, each row without its own vote.

Defined cases: a null or empty text, or one without listed terms, has no neighbours and gets
the calibrated score of such rows. Without labelled rows every score is 0. Rows are scored one
by one, so repeated rows get the same score.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.labelled import Isotonic, class_weights, document_frequencies, held_out, sample
from quercus.llm.words import chunks, column, split
from quercus.workspace import Workspace

PER_CLASS = 2500
TERMS = 768
RANK = 48
NEIGHBOURS = 25
#: Power of the similarity in a vote: near rows count for more than many far ones.
SHARPNESS = 8
GOOD = 0.7
ROWS = 512

_LETTERS = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"\d+")
_RUNS = re.compile(r"([^\w])\1+")
REPEAT = "="


def form(word: str) -> str:
    """Aa, a, A and 0 for runs of letters and digits; marks as they are, once."""
    word = _LETTERS.sub(lambda m: "A" if m[0].isupper() else "a" if m[0].islower() else "Aa", word)
    return _RUNS.sub(r"\1", _DIGITS.sub("0", word))[:12]


def form_terms(texts: pa.Array):
    """(document, local term, count) triples and the names of the local terms."""
    words = split(texts)
    names: dict[str, int] = {}
    of_word = np.array([names.setdefault(form(w), len(names)) for w in words.vocab.to_pylist()], np.int64)
    listed = list(names)
    forms = of_word[words.codes] if len(words.codes) else np.zeros(0, np.int64)
    owner, n = words.owners(), max(1, len(listed))
    inside = owner[1:] == owner[:-1]
    pairs, which = np.unique((forms[:-1] * n + forms[1:])[inside], return_inverse=True)
    repeats = inside & (words.codes[1:] == words.codes[:-1])
    total = n + len(pairs) + 1
    key = np.concatenate((owner * total + forms, owner[1:][inside] * total + n + which, owner[1:][repeats] * total + total - 1))
    key, count = np.unique(key, return_counts=True)
    names_ = (listed or [""]) + [f"{listed[p // n]} {listed[p % n]}" for p in pairs.tolist()] + [REPEAT]
    return key // total, key % total, count, names_


class Features:
    """(document, term, count) of each chunk for a list of terms."""

    def __init__(self, names: list[str]):
        self.place = {t: i for i, t in enumerate(names)}

    def of(self, texts: pa.Array):
        doc, term, count, names = form_terms(texts)
        place = np.array([self.place.get(t, -1) for t in names], np.int64)[term]
        has = place >= 0
        return doc[has], place[has], count[has]

    def __call__(self, batches):
        for table in chunks(batches):
            yield *self.of(column(table, "text")), table.num_rows


def _term_documents(batches):
    for table in chunks(batches):
        _, term, _, names = form_terms(column(table, "text"))
        df = np.bincount(term, minlength=len(names))
        yield pa.record_batch([pa.array(names), pa.array(df)], names=["term", "n"])


def matrix(doc, term, count, idf, n) -> np.ndarray:
    """Dense TF-IDF rows of unit length."""
    out = np.zeros((n, len(idf)), np.float32)
    out[doc, term] = (1 + np.log(count)) * idf[term]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


class Model:
    """Labelled vectors, and the projection to them."""

    def __init__(self, names, idf, basis):
        self.features, self.idf, self.basis = Features(names), idf, basis

    def project(self, texts: pa.Array) -> np.ndarray:
        doc, term, count = self.features.of(texts)
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        out = np.zeros((len(texts), self.basis.shape[1]), np.float32)
        for a in range(0, len(texts), ROWS):
            b = min(a + ROWS, len(texts))
            part = slice(bounds[a], bounds[b])
            out[a:b] = matrix(doc[part] - a, term[part], count[part], self.idf, b - a) @ self.basis
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)

    def votes(self, vectors: np.ndarray, skip_self: bool = False) -> np.ndarray:
        """Weighted share of label 1 among the nearest rows; NaN where nothing is near."""
        out = np.full(len(vectors), np.nan)
        k = min(NEIGHBOURS, len(self.labels) - skip_self)
        if k < 1:
            return out
        for a in range(0, len(vectors), ROWS):
            sims = vectors[a : a + ROWS] @ self.vectors.T
            if skip_self:
                sims[np.arange(len(sims)), a + np.arange(len(sims))] = -1
            near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            pull = np.maximum(np.take_along_axis(sims, near, 1), 0).astype(np.float64) ** SHARPNESS * self.weights[near]
            total = pull.sum(1)
            found = total > 0
            out[a : a + ROWS][found] = (pull * self.labels[near]).sum(1)[found] / total[found]
        return out

    def learn(self, vectors, labels, weights):
        self.vectors, self.labels, self.weights = vectors, labels, weights
        votes = self.votes(vectors, skip_self=True)
        none = np.isnan(votes)
        self.calibrated = Isotonic(votes[~none], labels[~none], weights[~none])
        base = float((weights * labels).sum() / weights.sum())
        self.empty = float((weights * labels)[none].sum() + base) / float(weights[none].sum() + 1)

    def score(self, texts: pa.Array) -> np.ndarray:
        votes = self.votes(self.project(texts))
        none = np.isnan(votes)
        return np.where(none, self.empty, self.calibrated(np.where(none, 0, votes)))


def fit(documents: DataFrame, labels: DataFrame, ws: Workspace, hidden, per_class: int = PER_CLASS) -> Model | None:
    examples, totals = sample(documents, labels, "quality", hidden, per_class, ws)
    counted = examples.select("text").mapInArrow(_term_documents, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    names = [r["term"] for r in counted.where("n >= 3").orderBy(F.desc("n"), "term").limit(TERMS).collect()]
    if not names:
        return None
    features = Features(names)
    df, total = document_frequencies(documents, features, names)
    idf = np.log((total + 1) / (df + 1)) + 1

    def vectors(batches):
        for table in chunks(batches):
            doc, term, count = features.of(column(table, "text"))
            dense = np.zeros((table.num_rows, len(names)), np.float32)
            dense[doc, term] = count
            yield pa.record_batch(
                [column(table, "doc_id"), column(table, "label"), pa.array([r.tobytes() for r in dense], pa.binary())],
                names=["doc_id", "label", "counts"],
            )

    # at most 2 * per_class rows of len(names) counts
    rows = examples.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, counts binary").collect()
    rows.sort(key=lambda r: r["doc_id"])
    counts = np.stack([np.frombuffer(r["counts"], np.float32) for r in rows])
    doc, term = np.nonzero(counts)
    dense = matrix(doc, term, counts[doc, term], idf, len(rows))
    _, vectors_ = np.linalg.eigh(dense.T.astype(np.float64) @ dense)
    basis = np.ascontiguousarray(vectors_[:, ::-1][:, :RANK]).astype(np.float32)
    latent = dense @ basis
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-12)
    y = np.array([r["label"] for r in rows])
    model = Model(names, idf, basis)
    model.learn(latent, y, class_weights(y, totals))
    return model


def digest(documents: DataFrame, labels: DataFrame, ws: Workspace, modulus: int = 4, remainder: int = 2) -> DataFrame:
    """Per document whether its label was hidden, its score, and the verdict."""
    model = fit(documents, labels, ws, held_out(modulus, remainder))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for table in chunks(batches):
            texts = column(table, "text")
            score = np.zeros(len(texts)) if shared.value is None else shared.value.score(texts)
            yield pa.record_batch([column(table, "doc_id"), pa.array(score, pa.float64())], names=["doc_id", "score"])

    scored = documents.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(documents.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))
