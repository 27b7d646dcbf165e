"""Hard negatives by segment summaries: bounds on inner products, refined segment by segment before exact scoring.

``build_index`` packs the vectors that take part into blocks, sorted by label, and stores for every
segment of a vector its mean and its deviation (scaled by the segment's length, so that both
add up). The inner product of two segments is their means' product plus or minus their deviations'
product at most (Cauchy and Schwarz on what is left when the mean is taken out), and neighbouring segments merge to
coarser ones. A search bounds every pair from one segment, refines the pairs whose bounds do not decide on 4, then on
16 segments, and only scores what is left, in whole numbers.

``mine`` takes the anchors in blocks of bounded size. A first pass over all blocks of vectors
finds every anchor's best rows of its own label; each of them opens a window of scores, and a second pass
finds the best rows of other labels in each window. Every task keeps the best so far and raises
its bars with them, so a task returns a bounded number of rows per anchor, and these are ranked again.

Defined cases: rows without an id, a label or a vector, or with a component that is null or not finite, take no part; an empty
vector scores 0 with every row; a vector that is shorter than another counts as filled up with zeros; ties go to the smaller id;
rows that repeat are rows of their own, each with its own results; scores beyond 63 bits stop at the largest number of that size; other
columns are ignored; an empty table, or one without anchors, gives no rows.
"""

import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.workspace import Workspace

#: Segments of a vector, coarse to fine.
SEGMENTS = (1, 4, 16)
#: Bytes of the components of a block of vectors, of a block of anchors, and pairs that are bounded at once.
BLOCK_BYTES = 4 << 20
ANCHOR_BYTES = 8 << 20
TILE = 1 << 20
#: Pairs are refined one by one when fewer than this share of a tile is left.
SPARSE = 0.05

LABELS = 10
POSITIVES, NEGATIVES = 5, 3
FOUND = "anchor long, window int, score long, vec_id long, row long"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def prepared(embeddings: DataFrame) -> DataFrame:
    """(row, vec_id, label, vector) of the rows that take part: whole numbers, and the labels that count."""
    x, usable = F.col("embedding"), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label").cast("long"))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull())
    return rows.where(F.forall(x, lambda v: usable(v.cast("double")))).select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"),
        F.transform(x, lambda v: F.floor(v.cast("double") * 256).cast("long")).alias("vector"),
    )


class Vectors:
    """Rows with their components and the summaries of their segments."""

    def __init__(self, state: dict):
        self.__dict__.update(state)

    @classmethod
    def of(cls, row, vec_id, label, lists: pa.Array):
        order = np.lexsort((row, vec_id, label))
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        width = -(-max(1, int(sizes.max(initial=0))) // SEGMENTS[-1]) * SEGMENTS[-1]
        x = np.zeros((len(row), width), np.int64)
        x[np.arange(width) < sizes[:, None]] = pc.list_flatten(lists).to_numpy(zero_copy_only=False)
        x = x[order]
        wide = x.astype(np.float64)
        parts = wide.reshape(len(row), SEGMENTS[-1], -1)
        mean = parts.sum(2) / np.sqrt(parts.shape[2])
        return cls(
            {
                "row": row[order], "vec_id": vec_id[order], "label": label[order], "mean": mean,
                "x": x.astype(np.int32) if np.abs(wide).max(initial=0) < 1 << 31 else x,
                "norm": np.sqrt((wide * wide).sum(1)), "deviation": np.sqrt(np.maximum((parts * parts).sum(2) - mean**2, 0)),
            }
        )

    def widened(self, width: int):
        """Components and finest summaries of the vectors filled up with zeros to ``width``."""
        if width == self.x.shape[1]:
            return self
        full = np.zeros((len(self.row), width), np.int64)
        full[:, : self.x.shape[1]] = self.x
        flat = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * width), pa.array(full.ravel()))
        return Vectors.of(self.row, self.vec_id, self.label, flat)

    def levels(self):
        """(means, deviations) from one segment to the finest ones."""
        out = []
        for n in SEGMENTS:
            mean = self.mean.reshape(len(self.row), n, -1)
            merged = mean.sum(2) / np.sqrt(mean.shape[2])
            square = (self.deviation**2 + self.mean**2).reshape(len(self.row), n, -1).sum(2)
            out.append((merged, np.sqrt(np.maximum(square - merged**2, 0))))
        return out

    def __len__(self):
        return len(self.row)


def products(a: np.ndarray, b: np.ndarray, most: float, paired: bool = False) -> np.ndarray:
    """Exact inner products of all rows, or of row i with row i; ``most`` bounds every sum of them."""
    kind = np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object
    a, b = a.astype(kind), b.astype(kind)
    out = (a * b).sum(1) if paired else a @ b.T
    return np.clip(out, -(1 << 63), (1 << 63) - 1).astype(np.int64) if kind is object else np.rint(out).astype(np.int64)


def bounded_pairs(rows: Vectors, anchors: Vectors, fine_rows, fine_anchors, r: slice, a: slice, low, high):
    """(row, anchor, score) of the pairs of two slices whose score lies in [low, high] of the anchor.

    ``fine_rows`` and ``fine_anchors`` are ``levels()``. Bounds are kept half a unit apart from
    whole numbers, more than their rounding.
    """
    top = rows.norm[r].max(initial=0) * anchors.norm[a].max(initial=0)
    slack = 0.5 + 1e-9 * top
    least, most = low - slack, high + slack
    i = j = None  # pairs one by one; None while the whole tile is looked at
    own, others = np.arange(r.start, r.stop), np.arange(a.start, a.stop)
    for (mean_r, dev_r), (mean_a, dev_a) in zip(fine_rows, fine_anchors, strict=True):
        if i is None:
            middle, reach = mean_r[own] @ mean_a[others].T, dev_r[own] @ dev_a[others].T
            alive = (middle + reach >= least[others - a.start]) & (middle - reach <= most[others - a.start])
            if alive.sum() <= SPARSE * alive.size:
                i, j = np.nonzero(alive)
                i, j = own[i], others[j]
            else:
                own, others = own[alive.any(1)], others[alive.any(0)]
        else:
            middle, reach = (mean_r[i] * mean_a[j]).sum(1), (dev_r[i] * dev_a[j]).sum(1)
            alive = (middle + reach >= least[j - a.start]) & (middle - reach <= most[j - a.start])
            i, j = i[alive], j[alive]
    if i is None:
        score = products(rows.x[own], anchors.x[others], top)
        i, j = np.nonzero((score >= low[others - a.start]) & (score <= high[others - a.start]))
        return own[i], others[j], score[i, j]
    score = products(rows.x[i], anchors.x[j], top, paired=True)
    fits = (score >= low[j - a.start]) & (score <= high[j - a.start])
    return i[fits], j[fits], score[fits]


class Best:
    """The best rows of every (anchor, window) so far."""

    def __init__(self, anchors: int, windows: int, keep: int, low, high):
        self.windows, self.keep, self.low, self.high = windows, keep, low.copy(), high
        self.key = self.score = self.vec_id = self.row = np.zeros(0, np.int64)
        self.bars()

    def bars(self):
        """What a row must score to matter for an anchor, and may score at most."""
        self.least, self.most = self.low.min(1, initial=NEVER), self.high.max(1, initial=-NEVER)

    def add(self, anchor, score, vec_id, row):
        fits = (score[:, None] >= self.low[anchor]) & (score[:, None] <= self.high[anchor])
        at, window = np.nonzero(fits)
        if not len(at):
            return
        key = np.append(self.key, anchor[at] * self.windows + window)
        score, vec_id, row = np.append(self.score, score[at]), np.append(self.vec_id, vec_id[at]), np.append(self.row, row[at])
        order = np.lexsort((row, vec_id, -score, key))
        key = key[order]
        first = np.searchsorted(key, key)
        kept = order[np.arange(len(key)) - first < self.keep]
        self.key, self.score, self.vec_id, self.row = key[np.arange(len(key)) - first < self.keep], score[kept], vec_id[kept], row[kept]
        full, at = np.unique(self.key, return_index=True)
        last = np.append(at[1:], len(self.key)) - 1
        done = last - at + 1 == self.keep
        self.low[full[done] // self.windows, full[done] % self.windows] = self.score[last[done]]
        self.bars()


#: Beyond every score.
NEVER = np.iinfo(np.int64).max


def _blocks(batches):
    """Arrow batches as packed blocks of bounded size."""
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("vector")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < batch.num_rows:
            widest = np.maximum.accumulate(np.maximum(sizes[start:], SEGMENTS[-1]))
            stop = start + max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1) * 8, BLOCK_BYTES, "right")))
            part, start = batch.slice(start, stop - start), stop
            yield Vectors.of(*(part.column(c).to_numpy(zero_copy_only=False) for c in ("row", "vec_id", "label")), part.column("vector"))


def build_index(rows: DataFrame, ws: Workspace) -> DataFrame:
    """Blocks of vectors with the summaries of their segments, written once."""

    def run(batches):
        for block in _blocks(batches):
            yield pa.record_batch([pa.array([pickle.dumps(block.__dict__, 5)], pa.binary())], names=["block"])

    return ws.table(rows.mapInArrow(run, "block binary"), "segments")


def _searcher(shared, same_label: bool, keep: int):
    """Best rows per anchor and window among the blocks of a task."""

    def run(batches):
        anchors, low, high = shared.value
        best, width, fine = Best(len(anchors), low.shape[1], keep, low, high), 0, None
        for batch in batches:
            for data in batch.column("block"):
                block = Vectors(pickle.loads(data.as_py()))
                if fine is None or width < block.x.shape[1]:
                    width = max(width, block.x.shape[1], anchors.x.shape[1])
                    anchors = anchors.widened(width)
                    fine = anchors.levels()
                block = block.widened(width)
                _search_block(block, anchors, fine, best, same_label)
        yield pa.record_batch(
            [
                pa.array(anchors.row[best.key // best.windows]), pa.array((best.key % best.windows).astype(np.int32)),
                pa.array(best.score), pa.array(best.vec_id), pa.array(best.row),
            ],
            names=["anchor", "window", "score", "vec_id", "row"],
        )

    return run


def _search_block(block: Vectors, anchors: Vectors, fine, best: Best, same_label: bool):
    levels = block.levels()
    labels, firsts = np.unique(anchors.label, return_index=True)
    for label, first, last in zip(labels.tolist(), firsts.tolist(), np.append(firsts[1:], len(anchors)).tolist(), strict=True):
        start, stop = np.searchsorted(block.label, [label, label + 1]).tolist()
        for begin, end in [(start, stop)] if same_label else [(0, start), (stop, len(block))]:
            for a in range(first, last, 4096):
                of = slice(a, min(a + 4096, last))
                step = max(1, TILE // (of.stop - of.start))
                for r in range(begin, end, step):
                    tile = slice(r, min(r + step, end))
                    i, j, score = bounded_pairs(block, anchors, levels, fine, tile, of, best.least[of], best.most[of])
                    other = block.row[i] != anchors.row[j]
                    i, j, score = i[other], j[other], score[other]
                    best.add(j, score, block.vec_id[i], block.row[i])


def _ranked(found: DataFrame, keep: int) -> DataFrame:
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "vec_id", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine(
    embeddings: DataFrame, ws: Workspace, every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES,
    least: int = 50, most: int = 95, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """For every anchor and positive the best rows of other labels that score ``least`` to ``most`` per cent of the positive."""
    spark = embeddings.sparkSession
    rows = ws.table(prepared(embeddings), "vectors")
    index = build_index(rows, ws)
    asking = rows.where(F.col("vec_id") % every == 0)
    size = asking.agg(F.sum(F.greatest(F.size("vector"), F.lit(SEGMENTS[-1])) * F.lit(8))).first()[0] or 0
    parts, out = -(-size // anchor_bytes), ws.path("negatives")
    for part in range(parts):  # a block of anchors against all vectors
        table = asking.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == part).toArrow().combine_chunks()
        if not table.num_rows:
            continue
        lists = pa.concat_arrays(table.column("vector").chunks)
        anchors = Vectors.of(*(table.column(c).to_numpy() for c in ("row", "vec_id", "label")), lists)
        low, high = np.full((len(anchors), 1), -NEVER), np.full((len(anchors), 1), NEVER)
        shared = spark.sparkContext.broadcast((anchors, low, high))
        found = _ranked(index.mapInArrow(_searcher(shared, True, positives), FOUND), positives).toArrow()
        shared.destroy()
        # at most ``positives`` windows per anchor of this block
        place = {r: i for i, r in enumerate(anchors.row.tolist())}
        low, high = np.full((len(anchors), positives), NEVER), np.full((len(anchors), positives), -NEVER)
        windows = []
        for anchor, score, vec_id, rank in zip(*(found.column(c).to_pylist() for c in ("anchor", "score", "vec_id", "rank")), strict=True):
            at, window = place[anchor], rank - 1
            if score >= 0:  # a negative score has an empty window
                low[at, window], high[at, window] = -(-least * score // 100), most * score // 100
                windows.append((anchor, window, int(anchors.vec_id[at]), vec_id, score))
        if not windows:
            continue
        shared = spark.sparkContext.broadcast((anchors, low, high))
        named = spark.createDataFrame(windows, "anchor long, window int, anchor_id long, positive_id long, positive_score long")
        ranked = _ranked(index.mapInArrow(_searcher(shared, False, negatives), FOUND), negatives)
        ranked.join(named, ["anchor", "window"]).select(
            "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        ).write.mode("append").parquet(out)
        shared.destroy()
    return spark.read.schema(RESULT).parquet(out) if _exists(spark, out) else spark.createDataFrame([], RESULT)


def _exists(spark, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


#: DuckDB SQL for ``mine`` over the table ``embeddings``.
ORACLE = """
WITH usable AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, r.vec_id AS vec_id, a.label = r.label AS same,
         list_dot_product(a.q, r.q)::BIGINT AS score
  FROM usable a JOIN usable r ON a.vec_id % 50 = 0 AND a.vec_id <> r.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score
QUALIFY rank <= 3
"""
