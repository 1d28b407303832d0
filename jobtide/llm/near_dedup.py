"""Near-duplicate classes by DartMinHash signatures, banded buckets and exact checks.

A text is the weighted set of its five-word shingles. Every element owns a region, as wide
as its weight, into which darts are thrown by hash: cells of unit weight and unit rank get a
Poisson number of darts at hashed places. Of the darts inside the region the one of
lowest rank is kept for each coordinate. Only ranks up to a bound that the total weight
sets are thrown, so the work per text is its number of elements plus k log k.

Texts of equal words are one node from the start. Bands of coordinates put nodes into
buckets. In each bucket every member is compared with one centre, the one that shares most
places in buckets with others; the links found make components. A bucket whose members are
all in one component is done. In the others, only pairs from different components are looked
at, in tiles of bounded size inside a task, in the first bucket a pair shares, and those
whose signatures allow the threshold are compared exactly until their components meet. Only
links leave a task. A bucket thus costs its size while it holds one class, no bucket is
capped, and no link between components that shares a bucket is lost. Equal copies and large
classes never make pairs among themselves.

Words are those of the decontamination: A-Z lower-cased, letters, digits and non-ASCII. A
text of one to four words has one shingle.

Defined results: null and empty texts, and those without words, are each alone. Copies and
repeated rows share a class. ``class_id`` is the least id of the class. A pair just at the
threshold shares no bucket with a chance of about 3e-6.
"""

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobtide.llm import scratch, texts
from jobtide.llm.columns import numbered, restored
from jobtide.llm.decontamination import gram_hashes, word_hashes

BANDS, ROWS = 32, 5
SHINGLE = 5
TILE = 512

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LAYER = np.uint64(0xC2B2AE3D27D4EB4F)
_RANK = np.uint64(0x165667B19E3779F9)
_CELLS = 1 << 20  # cells that are thrown at once
_POISSON = np.cumsum([math.exp(-1) / math.factorial(n) for n in range(18)])


def _unit(values: np.ndarray) -> np.ndarray:
    """64-bit hashes as numbers from 0 to 1."""
    return (values >> np.uint64(11)).astype(np.float64) * 2.0 ** -53


def dart_signature(elements: np.ndarray, weights: np.ndarray | None, k: int) -> np.ndarray:
    """k coordinates; two sets agree in each with the chance of their weighted Jaccard similarity."""
    if weights is None:
        total, owner, layer = float(len(elements)), np.arange(len(elements)), None
        base = texts.mixed(elements)
    else:
        total = float(weights.sum())
        layers = np.ceil(weights).astype(np.int64)
        owner = np.repeat(np.arange(len(elements)), layers)
        layer = np.arange(len(owner)) - np.repeat(np.cumsum(layers) - layers, layers)
        base = texts.mixed(texts.mixed(elements)[owner] + layer.astype(np.uint64) * _LAYER)
    bound = k * (math.log(k) + 2) / total
    out = np.zeros(k, np.uint64)
    best = np.full(k, np.inf)
    low = 0.0
    while True:
        # cells [rank, rank + 1) of every layer, as far as the bound reaches
        ranks = np.arange(int(low), math.ceil(bound))
        for some in np.array_split(ranks, -(-len(ranks) * len(base) // _CELLS)):
            cell = texts.mixed(base + (some.astype(np.uint64) * _RANK)[:, None]).ravel()
            darts = np.searchsorted(_POISSON, _unit(cell), side="right")
            at = np.repeat(np.arange(len(cell)), darts)
            number = np.arange(len(at)) - (np.cumsum(darts) - darts)[at]
            dart = texts.mixed(cell[at] + (number + 1).astype(np.uint64) * _STEP)
            height = some[at // len(base)] + _unit(texts.mixed(dart + _LAYER))
            inside = (height >= low) & (height < bound)
            if weights is not None:
                within = at % len(base)
                inside &= layer[within] + _unit(texts.mixed(dart + _RANK)) < weights[owner[within]]
            dart, height = dart[inside], height[inside]
            place = (dart % np.uint64(k)).astype(np.int64)
            np.minimum.at(best, place, height)
            lowest = height == best[place]
            out[place[lowest]] = dart[lowest]
        if not np.isinf(best).any():
            return out
        low, bound = bound, 2 * bound


def shingle_sets(column: pa.Array, size: int = SHINGLE):
    """Per row: a hash of its word sequence, and its shingles, sorted, with their counts."""
    words, counts = word_hashes(column)
    rows = np.repeat(np.arange(len(counts)), counts)
    grams, places = gram_hashes(words, rows, size)
    marks = np.searchsorted(rows[places], np.arange(len(counts) + 1))
    ends = np.cumsum(counts)
    for row, end in enumerate(ends.tolist()):
        own = words[end - counts[row]:end]
        key = texts.mixed(np.array([_sequence(own)], np.uint64))[0] if len(own) else np.uint64(0)
        shingles = grams[marks[row]:marks[row + 1]]
        if len(own) and not len(shingles):
            shingles = np.array([key], np.uint64)
        yield key, *np.unique(shingles, return_counts=True)


def _sequence(words: np.ndarray) -> np.uint64:
    powers = texts.powers(len(words))
    return (words * powers).sum(dtype=np.uint64) + np.uint64(len(words))


def _sketch(batches: Iterator[pa.RecordBatch], text: str, weighted: bool):
    k = BANDS * ROWS
    number = np.arange(BANDS, dtype=np.uint64) * _LAYER
    for batch in batches:
        names = batch.schema.names
        for piece in texts.pieces(batch, text):
            nodes, sizes, bands, sketches = [], [], [], []
            for key, shingles, counts in shingle_sets(piece.column(text)):
                nodes.append(int(key.view(np.int64)))
                sizes.append(len(shingles))
                if not len(shingles):
                    bands.append(np.zeros(0, np.int64))
                    sketches.append(b"")
                    continue
                signature = dart_signature(shingles, counts.astype(float) if weighted else None, k)
                mixed = np.zeros(BANDS, np.uint64)
                for column in signature.reshape(BANDS, ROWS).T:
                    mixed = texts.mixed(mixed * _STEP + column + number)
                bands.append(mixed.view(np.int64))
                sketches.append(texts.mixed(signature).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays(
                [*[piece.column(n) for n in names], pa.array(nodes, pa.int64()),
                 pa.array(sizes, pa.int32()), pa.array(bands, pa.list_(pa.int64())),
                 pa.array(sketches, pa.binary())],
                [*names, "_n_node", "_n_size", "_n_bands", "_n_sketch"])


def _shingles(batches: Iterator[pa.RecordBatch], weighted: bool):
    for batch in batches:
        for piece in texts.pieces(batch, "text"):
            sets = [np.concatenate([shingles, counts.astype(np.uint64)] if weighted else [shingles]).tobytes()
                    for _, shingles, counts in shingle_sets(piece.column("text"))]
            yield pa.RecordBatch.from_arrays(
                [piece.column("node"), pa.array(sets, pa.binary()), piece.column("_n_sketch"),
                 piece.column("_n_bands")], ["node", "shingles", "sketch", "bands"])


def similarity(left: bytes, right: bytes, weighted: bool) -> float:
    a, b = np.frombuffer(left, np.uint64), np.frombuffer(right, np.uint64)
    if not weighted:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both / (len(a) + len(b) - both)
    (a, m), (b, n) = a.reshape(2, -1), b.reshape(2, -1)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    both = int(np.minimum(m[i], n[j]).sum())
    return both / (int(m.sum()) + int(n.sum()) - both)


def _linked(pairs: DataFrame, sets: DataFrame, threshold: float, weighted: bool) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by their whole shingle sets."""
    def check(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            good = [similarity(x.as_py(), y.as_py(), weighted) >= threshold
                    for x, y in zip(batch.column("left"), batch.column("right"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    both = (pairs.join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("right")), "b")
            .join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("left")), "a"))
    return both.select("a", "b", "left", "right").mapInArrow(check, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node in ``links`` (a, b); the label is the component's least node.

    Each round takes the least label among neighbours and then that label's own label, so
    chains shorten by half; every round is written to the shared folder.
    """
    both = scratch.stored(links.union(links.select("b", "a")).distinct(), "links")
    labels = scratch.stored(
        both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        .select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy("a")
                .agg(F.min("label").alias("low")))
        lower = (labels.join(near, labels.node == near.a)
                 .select("node", "label", F.least("label", "low").alias("next")))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = scratch.stored(
            lower.join(jump, lower.next == jump["at"], "left")
            .select("node", F.coalesce(F.least("next", "far"), "next").alias("to"),
                    F.col("label").alias("was")), "labels")
        changed = moved.filter("to <> was").limit(1).count()
        labels = moved.select("node", F.col("to").alias("label"))
        if not changed:
            return labels


def _tiles(batches: Iterator[pa.RecordBatch], least: int, threshold: float, weighted: bool):
    """Links between different labels in each tile; rows come sorted by tile."""
    held = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held = table if held is None else pa.concat_tables([held, table])
        keys = held.column("tile").to_numpy()
        done = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0
        if done:
            yield from _tile_links(held.slice(0, done), least, threshold, weighted)
            held = held.slice(done)
    if held is not None and held.num_rows:
        yield from _tile_links(held, least, threshold, weighted)


def _tile_links(table: pa.Table, least: int, threshold: float, weighted: bool):
    table = table.combine_chunks()
    tile, node, side, band = (table.column(c).to_numpy() for c in ("tile", "node", "side", "band"))
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(tile), -1)
    bands = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(tile), BANDS)
    sets = table.column("shingles")
    edges = np.flatnonzero(np.diff(tile, prepend=tile[0] - 1, append=tile[-1] + 1))
    links = []
    for low, high in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        label = table.column("label").to_numpy()[low:high].copy()
        inner = bool(table.column("inner")[low].as_py())
        for i in range(high - low):
            if side[low + i] == 1:
                continue
            other = np.arange(i + 1, high - low) if inner else np.flatnonzero(side[low:high] == 1)
            other = other[label[other] != label[i]]
            # a pair is looked at in the first bucket it shares
            mine = (bands[low + other] == bands[low + i]).argmax(axis=1) == band[low]
            other = other[mine]
            agree = (sketch[low + other] == sketch[low + i]).sum(axis=1)
            keep = agree >= least
            for j in other[keep][np.argsort(-agree[keep], kind="stable")].tolist():
                if label[j] != label[i] and similarity(
                        sets[low + i].as_py(), sets[low + j].as_py(), weighted) >= threshold:
                    links.append((int(node[low + i]), int(node[low + j])))
                    label[label == label[j]] = label[i]  # one component from now on
    if links:
        a, b = np.array(links, np.int64).T
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members whose buckets hold several labels, dealt into tiles of bounded size.

    The centre has been compared with all. Members with its label meet those with others,
    and these meet one another; blocks of the former are copied once for each block of the
    latter, which are few in a bucket with one large class.
    """
    low = labels.select(F.col("node").alias("centre"), F.col("label").alias("centre_label"))
    named = (members.filter("node <> centre").join(labels, "node", "left").join(low, "centre", "left")
             .select("bucket", "band", "node", F.coalesce("label", "node").alias("label"),
                     F.coalesce("centre_label", "centre").alias("centre_label"))
             .withColumn("other", F.col("label") != F.col("centre_label")))
    counts = (named.groupBy("bucket").agg(
        F.sum(F.col("other").cast("int")).alias("others"), F.sum((~F.col("other")).cast("int")).alias("same"),
        F.min("label").alias("l"), F.max("label").alias("h"))
        .filter("others > 0 and l <> h").select("bucket", "others", "same"))
    rows = named.join(counts, "bucket")
    other_blocks = F.ceil(F.col("others") / TILE).cast("int")
    same_blocks = F.ceil(F.col("same") / TILE).cast("int")
    block = F.pmod(F.xxhash64("node"), F.when(F.col("other"), other_blocks).otherwise(same_blocks)).cast("int")

    def place(i, j, inner, side):
        return F.struct(i.alias("i"), j.alias("j"), F.lit(inner).alias("inner"), side.alias("side"))

    def upto(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    among = F.transform(upto(other_blocks), lambda j: F.struct(
        F.least(block, j).alias("i"), F.greatest(block, j).alias("j"), (block == j).alias("inner"),
        F.when(block <= j, 0).otherwise(1).alias("side")))
    across = F.transform(upto(same_blocks), lambda j: place(block, -1 - j, False, F.lit(0)))
    same = F.transform(upto(other_blocks), lambda i: place(i, -1 - block, False, F.lit(1)))
    tiles = F.when(F.col("other"), F.concat(among, across)).otherwise(same)
    return rows.withColumn("t", F.explode(tiles)).select(
        F.xxhash64("bucket", "t.i", "t.j").alias("tile"), "t.side", "t.inner", "band", "node", "label")


def _classified(docs: DataFrame, text: str, doc_id: str, threshold: float, weighted: bool):
    """The stored rows with a number each, and (_n_row, id and number of its class's head)."""
    k = BANDS * ROWS
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    extra = "_n_row long, _n_node long, _n_size int, _n_bands array<long>, _n_sketch binary"
    rows = scratch.stored(
        docs.withColumn("_n_row", F.monotonically_increasing_id()).mapInArrow(
            lambda batches: _sketch(batches, text, weighted), f"{schema}, {extra}"), "sketches")
    nodes = (rows.filter("_n_size > 0").groupBy(F.col("_n_node").alias("node"))
             .agg(F.min(F.struct(F.col("_n_row").alias("row"), F.col("_n_size").alias("size"),
                                 F.col("_n_bands").alias("bands"))).alias("m")))
    banded = nodes.select("node", "m.row", "m.size", F.posexplode("m.bands").alias("band", "bucket"))
    amounts = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("amount")).filter("amount > 1")
    shared = scratch.stored(banded.join(amounts, "bucket"), "buckets")
    # the text the others are copies of meets more of them than they meet one another
    company = shared.groupBy("node").agg(F.sum(F.col("amount") - 1).alias("company"))
    met = shared.join(company, "node")
    centres = met.groupBy("bucket").agg(F.max(F.struct("company", "node", "size")).alias("c"))
    members = scratch.stored(
        shared.join(centres, "bucket").select(
            "bucket", "band", "node", "row", "size", F.col("c.node").alias("centre"),
            F.col("c.size").alias("centre_size")), "members")

    # one row and text for each node that shares a bucket
    wanted = members.select("row", "node").distinct().hint("shuffle_hash")
    chosen = (rows.select(F.col("_n_row").alias("row"), F.col(text).alias("text"), "_n_sketch", "_n_bands")
              .join(wanted, "row").select("node", "text", "_n_sketch", "_n_bands"))
    sets = scratch.stored(chosen.mapInArrow(
        lambda batches: _shingles(batches, weighted),
        "node long, shingles binary, sketch binary, bands array<long>"), "shingles")

    apart = F.lit(False)
    if not weighted:  # sizes so far apart cannot reach the threshold
        apart = F.least("size", "centre_size") < threshold * F.greatest("size", "centre_size")
    near = members.filter((F.col("node") != F.col("centre")) & ~apart).select(
        F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    first = components(_linked(near, sets, threshold, weighted))

    # a pair at the threshold agrees in fewer places with a chance under 1e-5
    least = int(k * threshold - 4.3 * math.sqrt(k * threshold * (1 - threshold)))
    dealt = _open_buckets(members, first).join(sets, "node")
    more = dealt.repartition("tile").sortWithinPartitions("tile").mapInArrow(
        lambda batches: _tiles(batches, least, threshold, weighted), "a long, b long")
    # links between components: each is one node now
    low = first.select(F.col("node").alias("a"), F.col("label").alias("la"))
    high = first.select(F.col("node").alias("b"), F.col("label").alias("lb"))
    bridges = (more.join(low, "a", "left").join(high, "b", "left")
               .select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")))
    second = components(bridges).select(F.col("node").alias("l"), F.col("label").alias("m"))

    slim = rows.select("_n_row", F.col(f"`{doc_id}`").alias("_n_id"), "_n_node", "_n_size")
    labelled = scratch.stored(
        slim.join(first, F.col("_n_node") == F.col("node"), "left")
        .withColumn("l", F.coalesce("label", "_n_node")).drop("node", "label")
        .join(second, "l", "left")
        .select("_n_row", "_n_id", F.when(F.col("_n_size") > 0, F.coalesce("m", "l")).alias("class")), "classes")
    heads = (labelled.filter("class is not null").groupBy("class")
             .agg(F.min(F.struct(F.col("_n_id").isNull().alias("none"), F.col("_n_id").alias("id"),
                                 F.col("_n_row").alias("row"))).alias("head"),
                  F.count(F.lit(1)).alias("class_size")))
    return rows, labelled.join(heads, "class", "left")


def near_classes(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8,
    weighted: bool = False,
) -> DataFrame:
    """(``doc_id``, class_id, class_size) for each row of ``docs``.

    With ``weighted`` shingles count as often as they occur, otherwise once.
    """
    _, classed = _classified(docs.select(doc_id, text), text, doc_id, threshold, weighted)
    return classed.select(
        F.col("_n_id").alias(doc_id), F.coalesce("head.id", "_n_id").alias("class_id"),
        F.coalesce("class_size", F.lit(1)).alias("class_size"))


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = 0.8,
) -> DataFrame:
    """One row of each class, the one of least id; rows without words all stay."""
    rows, classed = _classified(numbered(docs, text, doc_id), text, doc_id, threshold, False)
    kept = classed.filter("head.row is null or head.row = _n_row").select("_n_row")
    return restored(rows.join(kept, "_n_row"), docs, text, doc_id)
