"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

``fit`` takes a bounded sample of labelled rows. Terms are the words and word beginnings whose documents differ in
label far beyond chance (chi-square over the sample) towards toxic, and not for being copied
together; their document frequencies are counted
over all documents. The examples' vectors lie in an inverted index whose lists are cut in
blocks of examples, each with every term's largest weight. A document visits blocks in the order of
their bounds, scores their postings exactly, and stops when no block left can better its ``k``
nearest: the neighbours are those of a full search. Votes weighted by similarity (a distance
weight, and by what an example stands for in its class) are calibrated on the examples themselves,
each without its own vote. The nearest examples come along as evidence.

Defined cases: a null or empty text, or one without any term, has no neighbours and gets the
calibrated score of such examples. Equally near examples rank by doc_id. Without labelled rows
every score is 0. Rows are scored one by one, so repeated rows get the same score; other columns
are carried along.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.labelled import Isotonic, class_weights, document_frequencies, held_out, sample
from quercus.llm.words import chunks, column, split
from quercus.workspace import Workspace

#: Labelled rows per class that the index holds at most.
PER_CLASS = 3000
#: Terms at most, and the chi-square that a term needs (one degree of freedom; p below 1e-9).
TERMS = 2048
CHI_SQUARE = 40.0
#: How many times more often a word, or a beginning of words, must occur among toxic documents.
LEAN, LEAN_BEGINNING = 8.0, 25.0
#: Beginnings of words that count as terms besides the words, in letters.
BEGINNINGS = (4, 6)
NEIGHBOURS = 15
BLOCK = 64
REJECT = 0.5


@dataclass
class BlockMaxIndex:
    """Postings of unit vectors by block and term, and each block's largest weight of each term."""

    bounds: np.ndarray  # terms x blocks
    starts: np.ndarray  # block * terms + term -> first posting
    places: np.ndarray  # posting -> example within its block
    weights: np.ndarray
    sizes: np.ndarray  # examples in each block
    first: np.ndarray  # first example of each block

    @classmethod
    def of(cls, example: np.ndarray, term: np.ndarray, weight: np.ndarray, n: int, terms: int) -> "BlockMaxIndex":
        """Examples must be numbered so that like ones lie together; a block is ``BLOCK`` in a row."""
        blocks = max(1, -(-n // BLOCK))
        block = example // BLOCK
        key = block * terms + term
        order = np.lexsort((example, key))
        bounds = np.zeros((terms, blocks))
        np.maximum.at(bounds, (term, block), weight)
        starts = np.searchsorted(key[order], np.arange(blocks * terms + 1))
        sizes = np.minimum(BLOCK, n - np.arange(blocks) * BLOCK)
        return cls(bounds, starts, (example % BLOCK)[order], weight[order], sizes, np.arange(blocks) * BLOCK)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int = -1):
        """The k examples of largest positive cosine, by (cosine, example)."""
        bound = weight @ self.bounds[term]
        order = np.argsort(-bound, kind="stable")
        best_sim, best = np.zeros(0), np.zeros(0, np.int64)
        terms = len(self.bounds)
        for b in order:
            if bound[b] <= 0 or len(best) >= k and bound[b] * (1 + 1e-12) < best_sim[-1]:
                break
            sims = np.zeros(self.sizes[b])
            for t, w in zip(term, weight, strict=True):
                a, e = self.starts[b * terms + t], self.starts[b * terms + t + 1]
                if e > a:
                    sims[self.places[a:e]] += w * self.weights[a:e]
            found = np.flatnonzero(sims > 0)
            ids = found + self.first[b]
            if skip >= 0:
                found, ids = found[ids != skip], ids[ids != skip]
            best_sim, best = np.append(best_sim, sims[found]), np.append(best, ids)
            rank = np.lexsort((best, -np.round(best_sim, 12)))[:k]
            best_sim, best = best_sim[rank], best[rank]
        return best_sim, best


def spellings(vocab: pa.Array) -> list[pa.Array]:
    """The terms of each word: itself, and its beginnings (marked ~); a word no longer than a beginning has none."""
    vocab = vocab.cast(pa.large_string())
    length = pc.utf8_length(vocab)
    out = [vocab]
    for n in BEGINNINGS:
        begin = pc.binary_join_element_wise(pc.utf8_slice_codeunits(vocab, 0, n), pa.scalar("~", pa.large_string()), pa.scalar("", pa.large_string()))
        out.append(pc.if_else(pc.greater(length, n), begin, pa.scalar(None, pa.large_string())))
    return out


class Features:
    """(document, term, count) of each chunk for a list of words."""

    def __init__(self, names: list[str]):
        self.names = names

    def places(self, words):
        """(term, word position) of every occurrence, one array pair per spelling."""
        names = pa.array(self.names, pa.large_string())
        for spelled in spellings(words.vocab):
            known = pc.index_in(spelled, names).fill_null(-1).to_numpy(zero_copy_only=False)
            # a null spelling is no term, whatever the list holds
            term = known[words.codes] if len(words.codes) else np.zeros(0, np.int64)
            has = np.flatnonzero(term >= 0)
            yield term[has], has

    def of(self, texts: pa.Array):
        words, n = split(texts, fold=True), max(1, len(self.names))
        keys = [(np.searchsorted(words.offsets, at, "right") - 1) * n + term for term, at in self.places(words)]
        key, count = np.unique(np.concatenate(keys), return_counts=True)
        return key // n, key % n, count

    def __call__(self, batches):
        for table in chunks(batches):
            yield *self.of(column(table, "text")), table.num_rows


def weighted(doc, term, count, idf, n):
    """Unit TF-IDF weights of (doc, term, count) triples."""
    weight = (1 + np.log(count)) * idf[term]
    norm = np.sqrt(np.bincount(doc, weight**2, n))
    return weight / np.maximum(norm[doc], 1e-12)


class Model:
    def __init__(self, names, idf, index, labels, ids, weights, calibrated, empty):
        self.features, self.idf, self.index = Features(names), idf, index
        self.labels, self.ids, self.weights, self.calibrated, self.empty = labels, ids, weights, calibrated, empty

    def vote(self, sim, near):
        pull = sim**2 * self.weights[near]
        return float((pull * self.labels[near]).sum() / pull.sum())

    def score(self, texts: pa.Array):
        """Scores, and the ids of the nearest examples."""
        n = len(texts)
        doc, term, count = self.features.of(texts)
        votes, evidence = np.full(n, np.nan), [[] for _ in range(n)]
        if len(doc):
            weight = weighted(doc, term, count, self.idf, n)
            bounds = np.searchsorted(doc, np.arange(n + 1))
            for i in np.flatnonzero(np.diff(bounds)):
                part = slice(bounds[i], bounds[i + 1])
                sim, near = self.index.nearest(term[part], weight[part], NEIGHBOURS)
                if len(near):
                    votes[i] = self.vote(sim, near)
                    evidence[i] = self.ids[near[:3]].tolist()
        none = np.isnan(votes)
        return np.where(none, self.empty, self.calibrated(np.where(none, 0, votes))), evidence


def _term_counts(batches):
    """Per word the sample's documents of either label that hold it."""
    for table in chunks(batches):
        words = split(column(table, "text"), fold=True)
        label = column(table, "label").to_numpy(zero_copy_only=False)
        owner = words.owners()
        for spelled in spellings(words.vocab):
            terms = spelled.dictionary_encode()
            code = terms.indices.fill_null(-1).to_numpy(zero_copy_only=False)[words.codes]
            n = max(1, len(terms.dictionary))
            pair = np.unique((owner * n + code)[code >= 0])
            ones = np.bincount(pair % n, label[pair // n], n).astype(np.int64)
            both = np.bincount(pair % n, minlength=n)
            if len(terms.dictionary):
                yield pa.record_batch([terms.dictionary.cast(pa.string()), pa.array(ones), pa.array(both - ones)], names=["term", "ones", "zeros"])


def _context_counts(features):
    """(term, hash of the word before it, label); -1 at the start of a text."""

    def run(batches):
        for table in chunks(batches):
            words = split(column(table, "text"), fold=True)
            label = column(table, "label").to_numpy(zero_copy_only=False)
            hashes = words.hashes().view(np.int64)
            opening = np.zeros(len(words.codes) + 1, bool)
            opening[words.offsets] = True
            for term, at in features.places(words):
                before = np.where(opening[at], -1, hashes[words.codes[at - 1]]) if len(at) else np.zeros(0, np.int64)
                mine = label[np.searchsorted(words.offsets, at, "right") - 1]
                rows = np.unique(np.stack((term, before, mine)), axis=1)
                yield pa.record_batch([pa.array(x) for x in rows[:2]] + [pa.array(rows[2].astype(np.int32))], names=["term", "before", "label"])

    return run


def fit(documents: DataFrame, labels: DataFrame, ws: Workspace, hidden, per_class: int = PER_CLASS) -> Model | None:
    examples, totals = sample(documents, labels, "toxic", hidden, per_class, ws)
    sizes = {r["label"]: r["count"] for r in examples.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 + n0:
        return None
    counted = examples.select("text", "label").mapInArrow(_term_counts, "term string, ones long, zeros long")
    counted = counted.groupBy("term").agg(F.sum("ones").cast("double").alias("a"), F.sum("zeros").cast("double").alias("b"))
    n = float(n1 + n0)
    chi = F.try_divide(
        n * F.pow(F.col("a") * (n0 - F.col("b")) - F.col("b") * (n1 - F.col("a")), F.lit(2)),
        (F.col("a") + F.col("b")) * F.greatest(n - F.col("a") - F.col("b"), F.lit(1.0)) * F.lit(float(n1) * n0),
    )
    lean = F.col("a") * n0 >= F.when(F.col("term").endswith("~"), LEAN_BEGINNING).otherwise(LEAN) * F.col("b") * n1
    likely = counted.withColumn("chi", chi).where((F.col("chi") >= CHI_SQUARE) & lean).orderBy(F.desc("chi"), "term").limit(4 * TERMS)
    rank = {r["term"]: r["chi"] for r in likely.collect()}
    names = sorted(rank)
    # words of a copied passage always stand behind the same words: a term counts once for each word before it
    contexts = (
        examples.select("text", "label").mapInArrow(_context_counts(Features(names)), "term long, before long, label int").distinct()
        .groupBy("term").agg(F.expr("double(count_if(label = 1)) AS a"), F.expr("double(count_if(label = 0)) AS b"))
        .withColumn("chi", chi)
        .where((F.col("chi") >= CHI_SQUARE) & (F.col("a") * n0 >= LEAN * F.col("b") * n1))
    )
    sound = sorted((names[r["term"]] for r in contexts.collect()), key=lambda t: (-rank[t], t))
    names = sorted(sound[:TERMS])
    features = Features(names)
    df, total = document_frequencies(documents, features, names)
    idf = np.log((total + 1) / (df + 1)) + 1

    def vectors(batches):
        for table in chunks(batches):
            doc, term, count = features.of(column(table, "text"))
            starts = np.searchsorted(doc, np.arange(table.num_rows + 1)).astype(np.int32)
            yield pa.record_batch(
                [
                    column(table, "doc_id"), column(table, "label"),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(term.astype(np.int32))),
                    pa.ListArray.from_arrays(pa.array(starts), pa.array(count.astype(np.int32))),
                ],
                names=["doc_id", "label", "terms", "counts"],
            )

    # at most 2 * per_class rows of at most TERMS terms each
    rows = examples.select("doc_id", "label", "text").mapInArrow(vectors, "doc_id long, label int, terms array<int>, counts array<int>").collect()
    return _model(rows, names, idf, totals)


def _model(rows, names, idf, totals) -> Model:
    # like examples side by side: by label, heaviest term, then id
    def heaviest(r):
        return max(range(len(r["terms"])), key=lambda i: (1 + np.log(r["counts"][i])) * idf[r["terms"][i]]) if r["terms"] else -1

    rows = sorted(rows, key=lambda r: (r["terms"][heaviest(r)] if r["terms"] else -1, r["label"], r["doc_id"]))
    sizes = np.array([len(r["terms"]) for r in rows])
    example = np.repeat(np.arange(len(rows)), sizes)
    term = np.array([t for r in rows for t in r["terms"]], np.int64)
    count = np.array([c for r in rows for c in r["counts"]], np.int64)
    y = np.array([r["label"] for r in rows])
    ids = np.array([r["doc_id"] for r in rows], np.int64)
    weight = class_weights(y, totals)
    unit = weighted(example, term, count, idf, len(rows)) if len(term) else np.zeros(0)
    index = BlockMaxIndex.of(example, term, unit, len(rows), max(1, len(names)))
    model = Model(names, idf, index, y, ids, weight, None, 0.0)
    bounds = np.searchsorted(example, np.arange(len(rows) + 1))
    votes = np.full(len(rows), np.nan)
    for i in np.flatnonzero(sizes):
        part = slice(bounds[i], bounds[i + 1])
        sim, near = index.nearest(term[part], unit[part], NEIGHBOURS, skip=i)
        if len(near):
            votes[i] = model.vote(sim, near)
    none = np.isnan(votes)
    model.calibrated = Isotonic(votes[~none], y[~none], weight[~none])
    base = float((weight * y).sum() / weight.sum())
    model.empty = float((weight * y)[none].sum() + base) / float(weight[none].sum() + 1)
    return model


#: Text bytes of whole rows that a task scores together.
SCORED_BYTES = 8 << 20


def scored(documents: DataFrame, labels: DataFrame, ws: Workspace, modulus: int = 5, remainder: int = 0, evidence: bool = True) -> DataFrame:
    """``documents`` with their score (_quercus_score) and, if asked for, evidence (_quercus_evidence): doc_ids of the nearest labelled examples."""
    model = fit(documents, labels, ws, held_out(modulus, remainder))
    shared = documents.sparkSession.sparkContext.broadcast(model)
    names = documents.columns

    def run(batches):
        for table in chunks(batches, most=SCORED_BYTES):
            texts = column(table, "text")
            if shared.value is None:
                score, near = np.zeros(len(texts)), [[] for _ in range(len(texts))]
            else:
                score, near = shared.value.score(texts)
            table = table.append_column("_quercus_score", pa.array(score))
            yield from (table.append_column("_quercus_evidence", pa.array(near, pa.list_(pa.int64()))) if evidence else table).to_batches()

    added = ["0D AS _quercus_score", *["array(0L) AS _quercus_evidence"] * evidence]
    return documents.select(*names).mapInArrow(run, documents.selectExpr("*", *added).schema)


def digest(documents: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """Per document whether its label was hidden, its score, and the verdict."""
    return scored(documents.select("doc_id", "text"), labels, ws).select(
        "doc_id",
        held_out(5, 0).alias("held_out"),
        F.col("_quercus_score").alias("score"),
        (F.col("_quercus_score") >= REJECT).cast("int").alias("predicted"),
        F.col("_quercus_evidence").alias("evidence"),
    )


def kept(documents: DataFrame, labels: DataFrame, ws: Workspace) -> DataFrame:
    """``documents`` that score below ``REJECT``."""
    return scored(documents, labels, ws, evidence=False).where(F.col("_quercus_score") < REJECT).select(*documents.columns)
