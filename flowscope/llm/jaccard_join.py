"""Exact Jaccard join of documents on word shingles, by pivots, Voronoi regions and triangle-inequality windows.

Jaccard distance is a metric, but texts lie so thinly in it that nearly all distances are exactly 1, and a pivot drawn
at random says nothing about them.  So the pivots of the first level come from the shingles themselves:

1. Every shingle's number of distinct sets is counted; a shingle of one set alone cannot be shared.  A set of which more
   than a quarter is unshared has no partner and leaves.
2. The other sets order their shingles from rare to common.  Linked sets share one of their first quarter, plus one.
   The pivot of such a shingle is its smallest set; a set enters the region of every pivot it meets so, which puts both
   ends of every link into a common region.
3. A region that fits a task is joined there: distances to its pivot cut the pairs (two sets whose distances differ by
   more than the radius are not linked), and pairs that are already connected are skipped.
4. A larger region takes several of its sets as pivots.  Each set goes to its nearest pivot, and is repeated in every
   region whose pivot is at most twice the radius further than that one.  Sets within the radius of their pivot are
   linked to it; they stay only if the distances leave room for a link to a set outside it.  The pivots themselves are
   done.  The regions made so are joined in the same way; where windows would repeat most of a region everywhere, it is
   cut into blocks and all pairs of blocks are joined instead, which is as exact.

Shingles are shuffled as packed arrays, one entry per distinct shingle and set of a block of documents, so a shingle or
set that fills a third of the table costs one entry per block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowscope.llm.common import materialize, mix, shingle_hashes, ship_code, shuffle_width, text_bytes, text_column
from flowscope.llm.components import connected_components

BLOCK_SHINGLES, BLOCK_DOCS = 1_000_000, 4096  # what is combined before the shuffle
REGION_SETS = 1024  # sets joined in one task
REGION_BYTES = 64 << 20
PIVOTS = 16
REPEATED = 3.0  # average copies of a set beyond which windows no longer pay
LOW = np.uint64((1 << 40) - 1)

NAME = np.dtype([("n", "<u4"), ("hash", "<u8")])  # a set: its size and 64 hash bits of its elements

_BLOCKS = "part int, doc_id bigint, n int, set_id bigint, sets binary, count binary, low binary, high binary"
_REPLIES = "part int, bucket int, doc_id bigint, n int, set_id bigint, sets binary, count binary, low binary, high binary, df binary"
_SETS = "id bigint, n int, ids binary, prefix array<bigint>"


def set_digest(sorted_hashes: np.ndarray) -> bytes:
    """The name of a set."""
    return np.array([(len(sorted_hashes), np.add.reduce(mix(sorted_hashes), dtype=np.uint64))], NAME).tobytes()


def _blob(column, dtype) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), dtype) for x in column]


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _arrow_schema(text: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in text.split(", "))])


def _block_rows(sets: dict[bytes, np.ndarray], parts: int) -> Iterator[tuple]:
    """The shingles of a block's sets by part, and in a part by set."""
    digests = np.frombuffer(b"".join(sets), NAME)
    hashes = np.concatenate(list(sets.values()))
    owner = np.repeat(np.arange(len(digests)), [len(h) for h in sets.values()])
    part = ((hashes >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    order = np.argsort(part, kind="stable")
    owner, low = owner[order], hashes[order] & LOW
    border = np.searchsorted(part[order], np.arange(parts + 1, dtype=np.uint64))
    for p in np.flatnonzero(np.diff(border)):
        at = slice(border[p], border[p + 1])
        here, count = np.unique(owner[at], return_counts=True)
        yield (int(p), None, None, None, digests[here].tobytes(), _packed(count), low[at].astype(np.uint32).tobytes(),
               (low[at] >> np.uint64(32)).astype(np.uint8).tobytes())


def _packed(count: np.ndarray) -> bytes:
    """Counts as bytes if they fit, else as 32-bit numbers."""
    return count.astype(np.uint8 if count.max() < 256 else np.uint32).tobytes()


def _unpacked(blob: np.ndarray, n: int) -> np.ndarray:
    return blob if len(blob) == n else blob.view(np.uint32)


def shingle_blocks(size: int, parts: int):
    """Mapper: texts to one row per document and packed shingles per block and part."""
    schema = _arrow_schema(_BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets, waiting = {}, 0
        for batch in batches:
            data, border = text_bytes(batch.column(1))
            rows = []
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                hashes = shingle_hashes(data[border[i] : border[i + 1]], size)
                digest = set_digest(hashes) if len(hashes) else None
                set_id = None if digest is None else int(np.frombuffer(digest, NAME)["hash"].view(np.int64)[0])
                rows.append((i % parts, doc_id, len(hashes), set_id, None, None, None, None))
                if doc_id is not None and digest is not None and digest not in sets:
                    sets[digest] = hashes
                    waiting += len(hashes)
                if waiting >= BLOCK_SHINGLES or len(sets) >= BLOCK_DOCS:
                    rows.extend(_block_rows(sets, parts))
                    sets, waiting = {}, 0
            yield from _table(rows, schema).to_batches()
        if sets:
            yield from _table(list(_block_rows(sets, parts)), schema).to_batches()

    return run


def _gather(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct set names in the rows' tables, and the set of every entry as a place among them."""
    tables = _blob(rows["sets"], NAME)
    names, at = np.unique(np.concatenate(tables), return_inverse=True)
    count = [_unpacked(c, len(t)) for c, t in zip(_blob(rows["count"], np.uint8), tables, strict=True)]
    return names, np.repeat(at, np.concatenate(count).astype(np.int64))


def count_sets(buckets: int):
    """Reducer of a part: per set, its shingles that other sets have too, with their number of sets."""
    schema = _arrow_schema(_REPLIES)

    def run(key, rows):
        part = key[0].as_py()
        known = pa.compute.is_null(rows["sets"])
        docs, blocks = rows.filter(known), rows.filter(pa.compute.invert(known))
        none = pa.nulls(len(docs), pa.binary())
        no = pa.nulls(len(docs), pa.int32())
        passed = pa.table([no, no, docs["doc_id"], docs["n"], docs["set_id"], none, none, none, none, none], schema=schema)
        if not len(blocks):
            return passed
        names, owner = _gather(blocks)
        ids = np.concatenate(_blob(blocks["low"], np.uint32)).astype(np.int64)
        ids |= np.concatenate(_blob(blocks["high"], np.uint8)).astype(np.int64) << 32
        order = np.lexsort((owner, ids))
        ids, owner = ids[order], owner[order]
        keep = np.append(True, (ids[1:] != ids[:-1]) | (owner[1:] != owner[:-1]))
        ids, owner = ids[keep], owner[keep]
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        count = np.diff(np.append(start, len(ids)))
        df = np.repeat(count, count)
        shared = df > 1
        ids, owner, df = ids[shared], owner[shared], df[shared]
        bucket = (names["hash"] % np.uint64(buckets)).astype(np.int64)
        by = np.lexsort((owner, bucket[owner]))
        ids, owner, df = ids[by], owner[by], df[by]
        border = np.searchsorted(bucket[owner], np.arange(buckets + 1))
        out = []
        for b in np.flatnonzero(np.diff(border)):
            cut = slice(border[b], border[b + 1])
            here, each = np.unique(owner[cut], return_counts=True)
            out.append((part, int(b), None, None, None, names[here].tobytes(), _packed(each), ids[cut].astype(np.uint32).tobytes(),
                        (ids[cut] >> 32).astype(np.uint8).tobytes(), _packed(df[cut])))
        return pa.concat_tables([passed, _table(out, schema)])

    return run


def linkable_sets(percent: int):
    """Reducer of a bucket: sets of which enough is shared, with the rare shingles of which a partner must have one."""
    schema = _arrow_schema(_SETS)

    def run(key, rows):
        names, owner = _gather(rows)
        low, high = _blob(rows["low"], np.uint32), _blob(rows["high"], np.uint8)
        ids = np.concatenate(low).astype(np.int64) | (np.concatenate(high).astype(np.int64) << 32)
        ids |= np.repeat(rows["part"].to_numpy().astype(np.int64) << 40, [len(x) for x in low])
        df = np.concatenate([_unpacked(d, len(x)).astype(np.int64) for d, x in zip(_blob(rows["df"], np.uint8), low, strict=True)])
        size = names["n"].astype(np.int64)
        spare = size - -(-percent * size // 100)  # shingles a set may have for itself
        first = spare + 1 - (size - np.bincount(owner, minlength=len(names)))
        keep = (first > 0)[owner]
        ids, df, owner = ids[keep], df[keep], owner[keep]
        order = np.lexsort((ids, df, owner))
        ids, owner = ids[order], owner[order]
        border = np.searchsorted(owner, np.arange(len(names) + 1))
        out = []
        for i in np.flatnonzero(first > 0):
            mine = ids[border[i] : border[i + 1]]
            out.append((int(names["hash"][i].view(np.int64)), int(size[i]), pack_ids(np.sort(mine)), mine[: first[i]]))
        return _table(out, schema)

    return run


def pack_ids(ids: np.ndarray) -> bytes:
    """Sorted shingle numbers as bytes: six each while they fit, which the first byte tells."""
    if len(ids) and ids[-1] >= 1 << 48:
        return b"\x08" + ids.tobytes()
    return b"\x06" + ids.astype(np.uint32).tobytes() + (ids >> 32).astype(np.uint16).tobytes()


def unpack_ids(blob) -> np.ndarray:
    blob = memoryview(blob)
    if blob[0] == 8:
        return np.frombuffer(blob[1:], np.int64)
    n = (len(blob) - 1) // 6
    high = np.frombuffer(blob[1 + 4 * n :], np.uint16).astype(np.int64)
    return np.frombuffer(blob[1 : 1 + 4 * n], np.uint32).astype(np.int64) | (high << 32)


def _id_sets(column) -> list[np.ndarray]:
    return [unpack_ids(x.as_buffer()) for x in column]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays of distinct numbers."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def is_link(common: int, m: int, n: int, percent: int) -> bool:
    return 100 * common >= percent * (m + n - common)


def _root(parent: list[int], i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def join_region(ids: list[int], sizes: list[int], sets: list[np.ndarray], stars: list[int | None], percent: int,
                side: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that connect what is linked in one region; sets with the same star are connected already.

    ``side`` (0 or 1), if given, joins only sets of different sides.
    """
    radius = 1 - percent / 100
    parent, by_star = list(range(len(ids))), {}
    for i, star in enumerate(stars):
        if star is not None:
            parent[i] = by_star.setdefault(star, i)
    links = []
    common = [shared(sets[0], s) for s in sets]
    distance = [1 - c / max(1, sizes[0] + n - c) for c, n in zip(common, sizes, strict=True)]
    order = sorted(range(len(ids)), key=distance.__getitem__)
    low = 0
    for k, j in enumerate(order):
        while distance[order[low]] < distance[j] - radius - 1e-9:
            low += 1
        for i in order[low:k]:
            if side and side[i] == side[j]:
                continue
            if min(sizes[i], sizes[j]) * 100 < percent * max(sizes[i], sizes[j]):
                continue
            a, b = _root(parent, i), _root(parent, j)
            if a != b and is_link(shared(sets[i], sets[j]), sizes[i], sizes[j], percent):
                parent[a] = b
                links.append((ids[i], ids[j]))
    return links


def _local_join(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(key, rows):
        side = rows["side"].to_pylist()
        links = join_region(rows["id"].to_pylist(), rows["n"].to_pylist(), _id_sets(rows["ids"]),
                            rows["star"].to_pylist(), percent, side if any(s is not None for s in side) else None)
        return _table(links, schema)

    return run


def _to_pivots(percent: int):
    """Co-group: the sets of a slice of a region against the region's pivots."""
    radius = 1 - percent / 100

    def run(key, sets, pivots):
        names, pivot_sets, pivot_sizes = pivots["pivot"].to_pylist(), _id_sets(pivots["pivot_ids"]), pivots["pivot_n"].to_pylist()
        out = []
        for i, n, mine in zip(sets["id"].to_pylist(), sets["n"].to_pylist(), _id_sets(sets["ids"]), strict=True):
            common = [shared(mine, p) for p in pivot_sets]
            far = [1 - c / max(1, n + m - c) for c, m in zip(common, pivot_sizes, strict=True)]
            links = [p for p, c, m in zip(names, common, pivot_sizes, strict=True) if p != i and is_link(c, n, m, percent)]
            near = min(far)
            cells = [] if i in names else [k for k, d in enumerate(far) if d <= near + 2 * radius + 1e-9]
            out.append((i, links, [names[k] for k in cells], [far[k] for k in cells]))
        schema = pa.schema([("id", pa.int64()), ("links", pa.list_(pa.int64())), ("cells", pa.list_(pa.int64())),
                            ("far", pa.list_(pa.float64()))])
        return _table(out, schema)

    return run


def _split_regions(large: DataFrame, percent: int, level: int) -> tuple[DataFrame, DataFrame]:
    """One level of pivots: (links to pivots, sets of the regions that the pivots make)."""
    radius = 1 - percent / 100
    draw = F.xxhash64("id", F.lit(level))
    ranked = large.withColumn("place", F.row_number().over(W.partitionBy("region").orderBy(draw, "id")))
    pivots = ranked.where(F.col("place") <= PIVOTS).select(
        F.col("region").alias("region"), F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("ids").alias("pivot_ids"),
        F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
    )
    slices = large.withColumn("slice", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int"))
    placed = slices.groupBy("region", "slice").cogroup(pivots.groupBy("region", "slice")).applyInArrow(
        _with_region(_to_pivots(percent)), "region string, id bigint, links array<bigint>, cells array<bigint>, far array<double>"
    )
    placed = materialize(placed, "jaccard-cells")
    links = placed.select(F.col("id").alias("a"), F.explode("links").alias("b"))
    copies = placed.groupBy("region").agg((F.sum(F.size("cells")) > REPEATED * F.count("*")).alias("blocks"))
    sets = large.select("region", "id", "n", "star", "slices").join(placed, ["region", "id"]).join(copies, "region")
    near = F.col("far") <= radius
    cells = sets.where("not blocks").select(
        "region", "id", "n", "star", F.explode(F.arrays_zip("cells", "far")).alias("cell")
    ).select(
        F.concat_ws("/", "region", F.col("cell.cells").cast("string")).alias("region"), "id", "n", "star",
        F.col("cell.cells").alias("pivot"), F.col("cell.far").alias("far"),
    )
    outside = cells.groupBy("region").agg(F.min(F.when(~near, F.col("far"))).alias("edge"))
    # sets around the pivot are connected; without an outsider within reach they have nothing left to find
    cells = cells.join(outside, "region").where(~near | (F.col("far") >= F.col("edge") - radius - 1e-9))
    cells = cells.select("region", "id", "n", F.when(near, F.col("pivot")).otherwise(F.col("star")).alias("star"),
                         F.lit(None).cast("int").alias("side"))
    # pairs of blocks: i < j joins across, i = j within
    i, j = F.col("pair.i"), F.col("pair.j")
    mine = F.pmod(F.xxhash64("id", F.lit(level)), F.col("slices")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("slices") - 1),
        lambda other: F.struct(F.least(other, F.col("mine")).alias("i"), F.greatest(other, F.col("mine")).alias("j")),
    )
    blocks = sets.where("blocks and size(cells) > 0").withColumn("mine", mine).withColumn("pair", F.explode(pairs)).select(
        F.concat_ws("/", "region", i.cast("string"), F.concat(F.lit("x"), j.cast("string"))).alias("region"), "id", "n",
        "star", F.when(i != j, (F.col("mine") == j).cast("int")).alias("side"),
    )
    return links, cells.unionByName(blocks)


def _with_region(function):
    def run(key, left, right):
        out = function(key, left, right)
        return out.add_column(0, "region", pa.array([key[0].as_py()] * len(out), pa.string()))

    return run


def _sized(members: DataFrame) -> DataFrame:
    """Members of regions of two and more, with the number of slices that the region needs."""
    size = members.groupBy("region").agg(
        F.count("*").alias("size"), F.sum(F.col("n") * F.lit(8)).alias("bytes"), F.max(F.col("side").isNotNull()).alias("sided")
    )
    slices = F.greatest(F.ceil(F.col("size") / REGION_SETS), F.ceil(F.col("bytes") / REGION_BYTES)).cast("int")
    # two blocks that were paired are small enough by their making
    size = size.where("size > 1").select("region", F.when(F.col("sided"), 1).otherwise(slices).alias("slices"))
    return members.join(size, "region")


def region_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect what is linked inside each region.

    ``members`` (region, id, n, star, side) name the sets of every region; the elements come from ``sets`` (id, ids)
    only where a region is joined.
    """
    found, level = None, 0
    while True:
        sized = materialize(_sized(members), "jaccard-regions")
        small = sized.where("slices <= 1").drop("slices").join(sets.select("id", "ids"), "id")
        links = small.groupBy("region").applyInArrow(_local_join(percent), "a bigint, b bigint")
        found = links if found is None else found.union(links)
        large = sized.where("slices > 1").drop("side")
        if large.limit(1).count() == 0:
            return found
        more, members = _split_regions(large.join(sets.select("id", "ids"), "id"), percent, level)
        found = materialize(found.union(more), "jaccard-links")
        level += 1


def jaccard_sets(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(one row per document: doc_id, n, set_id; one row per set that may have partners: id, n, ids, prefix)."""
    spark = docs.sparkSession
    ship_code(spark)
    width = shuffle_width(spark)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_column(docs, text).alias("text"))
    blocks = rows.mapInArrow(shingle_blocks(shingle, width), _BLOCKS)
    replies = materialize(blocks.groupBy("part").applyInArrow(count_sets(width), _REPLIES), "jaccard-shingles")
    named = replies.where("bucket is null").select("doc_id", "n", "set_id")
    sets = replies.where("bucket is not null").groupBy("bucket").applyInArrow(linkable_sets(percent), _SETS)
    return named, materialize(sets, "jaccard-sets")


def jaccard_links(sets: DataFrame, percent: int = 75) -> DataFrame:
    """Links between different sets that connect all that is linked; ``sets`` as ``jaccard_sets`` gives them."""
    postings = sets.select("id", F.explode("prefix").alias("shingle"))
    pivots = postings.groupBy("shingle").agg(F.min("id").alias("pivot"), F.count("*").alias("sets")).where("sets > 1")
    met = postings.join(pivots, "shingle").select("id", "pivot").distinct()
    members = met.join(sets.select("id", "n"), "id").select(
        F.col("pivot").cast("string").alias("region"), "id", "n", F.lit(None).cast("bigint").alias("star"),
        F.lit(None).cast("int").alias("side"),
    )
    return region_links(members, sets, percent)


def jaccard_components(docs: DataFrame, shingle: int = 5, percent: int = 75, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) for every row of ``docs``.

    Words are lower-cased (A-Z) runs between ASCII white space; a text with fewer words than a shingle is one shingle,
    one without words is an empty set that is linked with nothing.  Two rows are linked if 100 * common shingles are at
    least ``percent`` * all shingles of both; equal sets always are.  ``component_id`` is the smallest id a row reaches.
    A row without an id is counted but not linked (null component).  Repeated rows stay; rows that share an id are one
    document, linked with whatever one of its texts is.  Shingles are compared by at least 40 hash bits, sets named by 64.
    """
    named, sets = jaccard_sets(docs, shingle, percent, id_col, text)
    classes = named.where("set_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("node"))
    mixed = _mixed_ids(named)
    links = jaccard_links(sets, percent).union(_links_of_ids(named, mixed))
    for end in ("a", "b"):
        links = links.join(classes.select(F.col("set_id").alias(end), F.col("node").alias(f"node_{end}")), end)
    components = materialize(connected_components(links, "node_a", "node_b"), "jaccard-components")
    classes = classes.join(components, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    of_mixed = mixed.join(classes.withColumnRenamed("set_id", "lowest"), "lowest").select("doc_id", F.col("component_id").alias("of_id"))
    rows = named.join(classes, "set_id", "left").join(of_mixed, "doc_id", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_id", "component_id", "doc_id"))
    return rows.select(F.col("doc_id").alias(id_col), F.col("n").cast("bigint").alias("n_shingles"), own.alias("component_id"))


def _mixed_ids(named: DataFrame) -> DataFrame:
    """(doc_id, lowest): ids whose rows have different sets, or sets and none, and the lowest of their sets."""
    per_id = named.where("doc_id is not null").groupBy("doc_id").agg(
        F.min("set_id").alias("lowest"), F.max("set_id").alias("highest"), F.count("set_id").alias("filled"), F.count("*").alias("rows")
    )
    return materialize(per_id.where("lowest <> highest or filled between 1 and rows - 1").select("doc_id", "lowest"), "jaccard-mixed-ids")


def _links_of_ids(named: DataFrame, mixed: DataFrame) -> DataFrame:
    """Links between the sets of one id."""
    return named.join(mixed, "doc_id").where("set_id <> lowest").select(F.col("set_id").alias("a"), F.col("lowest").alias("b")).distinct()
