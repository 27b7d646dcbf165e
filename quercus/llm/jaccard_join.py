"""N-gram Jaccard join by MinHash banding: all links of similarity 0.8 and more.

``choose_bands`` picks rows per band and bands for a target recall at the threshold.
Documents shuffle on band hashes; pairs that share one are verified on their full sets of
five-word shingles. Equal texts are one class and enter once, so copies cost nothing; a
bucket larger than a block is split into blocks, every pair of blocks is one work unit, and
units are dealt over all tasks: no bucket has to fit anywhere. A pair counts in the first band
that it shares. Buckets with the same members are verified once. What a unit returns is, per
text, the number of linked documents and one edge towards its component's root: never pairs.

Words lie between ASCII white space and are taken as they are. A text of one to four words
has one shingle, all its words. Defined cases: null and empty texts have no shingles and link
to nothing; rows with a null doc_id take no part (class null, no links). Rows that repeat
(doc_id, text) are copies of each other. A class is named by its smallest doc_id. Shingles are
64-bit hashes, texts are identified by MD5.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.components import components
from quercus.llm.words import chunks, column, grams, joined, ranges, split
from quercus.workspace import Workspace

GRAM = 5
THRESHOLD = 0.8
#: Share of pairs right at the threshold that meet in a band; above it more do.
RECALL = 0.9995
#: Hash functions at most.
HASHES = 96
#: Sets and words in a block of a bucket.
BLOCK_SETS = 384
BLOCK_WORDS = 400_000
#: Parts that the copies of a text are dealt to.
PARTS = 64


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows, so the fewest chance meetings, whose bands reach the recall within ``hashes``."""
    best = None
    for rows in range(1, hashes + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows <= hashes:
            best = bands, rows
    if best is None:
        raise ValueError("no banding reaches the recall with so many hashes")
    return best


def shingles(texts: pa.Array):
    """Hashes of the shingles of every text, flat, with offsets and word counts."""
    words = split(texts)
    h = words.hashes()[words.codes] if len(words.codes) else np.zeros(0, np.uint64)
    sizes = np.diff(words.offsets)
    many = np.where(sizes == 0, 0, np.maximum(sizes - GRAM, 0) + 1)
    full = grams(h, GRAM)
    at = ranges(words.offsets[:-1], many)
    out = np.zeros(len(at), np.uint64)
    offsets = np.concatenate(([0], np.cumsum(many)))
    short = np.flatnonzero((sizes > 0) & (sizes < GRAM))
    long_ = np.ones(len(at), bool)
    long_[offsets[short]] = False
    out[long_] = full[at[long_]]
    for i in short:
        value = np.zeros(1, np.uint64)
        for k in range(words.offsets[i], words.offsets[i + 1]):
            value = joined(value, h[k : k + 1])
        out[offsets[i]] = value[0]
    return out, offsets, sizes


def _sketcher(bands: int, rows: int):
    def sketch(batches):
        rng = np.random.default_rng(20240229)
        a = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
        for table in chunks(batches, most=12 << 20):
            values, offsets, sizes = shingles(column(table, "text"))
            has = np.flatnonzero(np.diff(offsets))
            keys = np.zeros((len(has), bands), np.uint64)
            for k in range(bands * rows if len(has) else 0):
                low = np.minimum.reduceat(values * a[k] + b[k], offsets[has])
                band = k // rows
                keys[:, band] = joined(keys[:, band], low)
            ends = np.zeros(len(sizes) + 1, np.int32)
            ends[1:][has] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
            yield pa.record_batch(
                [column(table, "doc_id"), column(table, "node"), pa.array(sizes.astype(np.int32)), lists],
                names=["doc_id", "node", "n_words", "bands"],
            )

    return sketch


def _gram_sets(batches):
    for table in chunks(batches, most=12 << 20):
        values, offsets, _ = shingles(column(table, "text"))
        sets = [np.unique(values[s:e]).tobytes() for s, e in zip(offsets[:-1], offsets[1:], strict=True)]
        yield pa.record_batch([column(table, "node"), pa.array(sets, pa.binary())], names=["node", "grams"])


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes. Shingles in many sets go through a matrix product, others pair by pair."""
    n = len(sets)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    head = np.append(True, flat[1:] != flat[:-1])
    first = np.flatnonzero(head)
    degree = np.diff(np.append(first, len(flat)))
    out = np.zeros(n * n, np.int64)
    many = np.repeat(degree, degree)
    column_ = np.cumsum(head) - 1
    few = (many > 1) & (many <= 24)
    own, col = owner[few], column_[few]
    for k in range(1, 24):
        same = np.flatnonzero(col[k:] == col[:-k]) if len(col) > k else ()
        if not len(same):
            break
        out += np.bincount(own[same] * n + own[same + k], minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    thick = np.flatnonzero(degree > 24)
    for at in range(0, len(thick), 4096):
        part = thick[at : at + 4096]
        cols = np.repeat(np.arange(len(part)), degree[part])
        matrix = np.zeros((n, len(part)), np.float32)
        matrix[owner[ranges(first[part], degree[part])], cols] = 1
        out += np.rint(matrix @ matrix.T).astype(np.int64)
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each node's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        label = label[label]
        if (label == before).all():
            return label


def verify(band: int, blocks, copies, bands, sets, split_: bool, threshold: float):
    """Links of one work unit: per text its linked documents, and its root. ``blocks``: which block each text is of."""
    size = np.array([len(s) for s in sets])
    common = intersections(sets)
    need = np.ceil(threshold / (1 + threshold) * (size[:, None] + size[None, :]) - 1e-9)
    linked = np.triu(common >= need, 1)
    if split_:  # pairs inside a block belong to the block's own unit
        linked &= blocks[:, None] != blocks[None, :]
    a, b = np.nonzero(linked)
    if band and len(a):
        new = np.ones(len(a), bool)
        for k in range(band):
            new &= bands[a, k] != bands[b, k]
        count_a, count_b = a[new], b[new]
    else:
        count_a, count_b = a, b
    links = np.bincount(count_a, copies[count_b], len(sets)) + np.bincount(count_b, copies[count_a], len(sets))
    root = _roots(len(sets), a, b)
    keep = np.flatnonzero((links > 0) | (root != np.arange(len(sets))))
    return keep, links[keep].astype(np.int64), root[keep]


def _verifier(threshold: float):
    def run(unit, rows):
        rows = rows.combine_chunks()
        nodes = rows.column("node").to_pylist()
        sets = [np.frombuffer(g, np.uint64) for g in rows.column("grams").to_pylist()]
        bands = rows.column("bands").combine_chunks()
        bands = (bands.chunk(0) if isinstance(bands, pa.ChunkedArray) else bands).flatten().to_numpy().reshape(len(nodes), -1)
        left, right = rows.column("left")[0].as_py(), rows.column("right")[0].as_py()
        keep, links, root = verify(
            rows.column("band")[0].as_py(), rows.column("block").to_numpy(), rows.column("copies").to_numpy(), bands, sets,
            left != right, threshold,
        )
        return pa.record_batch(
            [
                pa.array([nodes[i] for i in keep], pa.binary()),
                pa.array([nodes[i] for i in root], pa.binary()),
                pa.array(links, pa.int64()),
            ],
            names=["node", "root", "links"],
        )

    def verify_units(batches):
        """Rows arrive sorted by unit; a unit may span batches."""
        held, unit = [], None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("band", "bucket", "left", "right")), strict=True))
            start = 0
            for i in range(len(keys) + 1):
                if i < len(keys) and keys[i] == (unit if i == start and held else keys[start]):
                    continue
                if i > start:
                    held.append(batch.slice(start, i - start))
                    unit = keys[start]
                if i < len(keys):
                    if held:
                        yield run(unit, pa.Table.from_batches(held))
                    held, unit, start = [], None, i
        if held:
            yield run(unit, pa.Table.from_batches(held))

    return verify_units


def _node():
    """What a text is known by."""
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def links(documents: DataFrame, ws: Workspace, threshold: float = THRESHOLD, recall: float = RECALL):
    """(one row per document with its text's MD5, one row per linked text with links and component)."""
    bands, rows = choose_bands(threshold, recall)
    keyed = documents.where("doc_id IS NOT NULL").select("doc_id", _node().alias("node"), "text")
    id_type = dict(documents.dtypes)["doc_id"]
    sketches = ws.table(
        keyed.mapInArrow(_sketcher(bands, rows), f"doc_id {id_type}, node binary, n_words int, bands array<long>"), "sketches"
    )
    classes = ws.table(
        sketches.groupBy("node").agg(
            F.min("doc_id").alias("doc_id"),
            F.count("*").alias("copies"),
            F.first("n_words").alias("n_words"),
            F.first("bands").alias("bands"),
        ),
        "classes",
    )
    members = classes.select("node", "n_words", F.posexplode("bands").alias("band", "bucket"))
    buckets = (
        members.groupBy("band", "bucket")
        .agg(
            F.count("*").alias("n"),
            F.sum("n_words").alias("words"),
            F.bit_xor(F.xxhash64("node")).alias("print_a"),
            F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("print_b"),
        )
        .where("n > 1")
        .groupBy("n", "words", "print_a", "print_b")
        .agg(F.min(F.struct("band", "bucket")).alias("b"))  # same members: the first band's bucket stands for all
        .select(
            "b.band",
            "b.bucket",
            F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("words") / BLOCK_WORDS)).cast("int").alias("blocks"),
        )
    )
    placed = ws.table(
        members.join(buckets, ["band", "bucket"])
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int"))
        .select("node", "band", "bucket", "blocks", "block"),
        "placed",
    )
    wanted = placed.select("node").distinct().join(classes, "node").select(F.col("doc_id").alias("rep_id"), F.col("node").alias("rep_node"))
    sets = (
        keyed.join(wanted, (F.col("doc_id") == F.col("rep_id")) & (F.col("node") == F.col("rep_node")), "left_semi")
        .select("node", "text")
        .mapInArrow(_gram_sets, "node binary, grams binary")
        .groupBy("node")
        .agg(F.first("grams").alias("grams"))
        .join(classes.select("node", "copies", "bands"), "node")
    )
    units = (
        placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("node", "band", "bucket", "block", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"))
        .join(sets, "node")
        .select("band", "bucket", "left", "right", "node", "block", "copies", "bands", "grams")
    )
    found = ws.table(
        units.repartition("band", "bucket", "left", "right")
        .sortWithinPartitions("band", "bucket", "left", "right", "node")
        .mapInArrow(_verifier(threshold), "node binary, root binary, links long"),
        "links",
    )
    roots = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")), ws)
    counted = found.groupBy("node").agg(F.sum("links").alias("links"))
    rooted = classes.select("node", "doc_id", "copies").join(counted, "node", "left").join(roots.withColumnsRenamed({"u": "node", "v": "root"}), "node", "left")
    rooted = rooted.select(
        "node", "doc_id", F.coalesce("root", "node").alias("root"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    named = rooted.groupBy("root").agg(F.min("doc_id").alias("class_id"))
    return sketches.select("doc_id", "node", "n_words"), rooted.join(named, "root").select("node", "class_id", "n_links")


def _classed(documents: DataFrame, ws: Workspace, threshold: float) -> DataFrame:
    """(doc_id, node, class_id, n_links) of the rows with an id."""
    docs, texts = links(documents, ws, threshold)
    # a text with very many copies meets its links part by part
    docs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)))
    parts = docs.select("node", "part").distinct().join(texts, "node")
    return docs.join(parts, ["node", "part"]).select(
        "doc_id",
        "node",
        F.when(F.col("n_words") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(F.col("n_words") > 0, F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"),
    )


def classes_and_links(documents: DataFrame, ws: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: its class (the smallest doc_id it is linked to, over any number of links) and its links."""
    id_type = dict(documents.dtypes)["doc_id"]
    left_out = documents.where("doc_id IS NULL").select(
        "doc_id", F.lit(None).cast(id_type).alias("class_id"), F.lit(0).cast("long").alias("n_links")
    )
    return _classed(documents, ws, threshold).drop("node").unionByName(left_out)


def one_of_each(documents: DataFrame, ws: Workspace, threshold: float = THRESHOLD) -> DataFrame:
    """``documents`` with the smallest doc_id of each class, once; rows without an id stay."""
    keep = (
        _classed(documents, ws, threshold).where("doc_id = class_id")
        .select(F.col("doc_id").alias("_quercus_id"), F.col("node").alias("_quercus_node")).distinct()
    )
    keyed = documents.withColumn("_quercus_key", _node())
    kept = keyed.join(
        keep, (F.col("doc_id") == F.col("_quercus_id")) & (F.col("_quercus_key") == F.col("_quercus_node")), "left_semi"
    ).dropDuplicates(["doc_id", "_quercus_key"])
    return kept.drop("_quercus_key").unionByName(documents.where("doc_id IS NULL"))
