"""Near-duplicate documents by an LSH forest, confirmed on full shingle sets.

Every distinct shingle set gets one min-hash signature. The forest reads it in several orders; sets that
share the first values of an order (a common prefix) share a region, and a region with too many sets is
cut again at a deeper prefix until it is small. Inside a region sketches find likely partners, of which
only a spanning forest leaves the task. Deeper prefixes only order the work: in a crowded region every two
sets that are not connected by then are compared in block pairs. The families that arise are then compared
exactly, on the shingles of their whole texts, large ones in block pairs as well.

With `MIN_DEPTH` 4 and 16 orders a pair of similarity 0.85 shares no region with probability 7e-6, one of
0.8 with 2e-4.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reelwise.llm.batches import binary_rows, settle, slices, stream_groups
from reelwise.llm.components import components
from reelwise.llm.wordhash import Tokens, fits, mix, tokens, windows
from reelwise.session import cut_lineage

VALUES = 128  # min-hash values of a signature
ORDERS = 16
MIN_DEPTH = 4
DEPTHS = (4, 6, 8, 12, 18, 27, 40, 60, 90, 128)
REGION = 2000  # most sets of a region that are compared in one group
FAMILY = 1000  # most sets of a family that are compared exactly in one group
NO_ID = -(2**63)


def _constants(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) | np.uint64(1)


FACTORS, SHIFTS, PREFIX = _constants(11, VALUES), _constants(12, VALUES), _constants(13, VALUES)


def shingles(found: Tokens, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted within it, and their bounds."""
    counts = np.diff(found.bounds)
    hashes = np.where(fits(found.bounds, size), windows(found.hashes, size), np.uint64(0))
    n = np.maximum(counts - size + 1, np.minimum(counts, 1))
    for words in range(1, size):
        short = found.bounds[:-1][counts == words]
        if len(short):
            hashes[short] = windows(found.hashes, words)[short]
    starts = np.cumsum(n) - n
    own = np.repeat(found.bounds[:-1] - starts, n) + np.arange(int(n.sum()))
    values = hashes[own]
    for start, size_of in zip(starts.tolist(), n.tolist()):
        if size_of > 1:
            values[start : start + size_of].sort()
    first = np.ones(len(values), bool)
    first[1:] = values[1:] != values[:-1]
    first[starts[n > 0]] = True
    bounds = np.concatenate([[0], np.cumsum(first)])[np.concatenate([starts, [len(values)]])]
    return values[first], bounds


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Min-hash values (rows x VALUES) of the non-empty sets."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.empty((len(starts), VALUES), np.uint32)
    if len(starts):
        with np.errstate(over="ignore"):
            for k in range(VALUES):
                out[:, k] = np.minimum.reduceat(((values * FACTORS[k] + SHIFTS[k]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def prefix_keys(signs: np.ndarray, depth: int) -> np.ndarray:
    """(rows x ORDERS) hash of the first `depth` values of every order."""
    keys = np.empty((len(signs), ORDERS), np.int64)
    step = VALUES // ORDERS
    with np.errstate(over="ignore"):
        for order in range(ORDERS):
            places = (order * step + np.arange(depth)) % VALUES
            keys[:, order] = mix((signs[:, places].astype(np.uint64) * PREFIX[:depth]).sum(1) + PREFIX[order] * np.uint64(depth)).view(np.int64)
    return keys


def _read_signs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(len(column), VALUES)


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, "text"):
                values, bounds = shingles(tokens(data, offsets, lower=True), size)
                n = np.diff(bounds)
                full = np.flatnonzero(n)
                marks = np.zeros((2, len(n)), np.uint64)
                if len(full):
                    with np.errstate(over="ignore"):
                        marks[0, full] = np.add.reduceat(mix(values), bounds[:-1][full])
                        marks[1, full] = np.add.reduceat(mix(values + np.uint64(0x5851F42D4C957F2D)), bounds[:-1][full])
                signs = signatures(values, bounds)
                ends = np.cumsum(n > 0) * VALUES
                yield pa.RecordBatch.from_arrays(
                    [rows.column("doc"), rows.column("row"), pa.array(n), pa.array(marks[0].view(np.int64)), pa.array(marks[1].view(np.int64)), binary_rows(signs.ravel(), ends)],
                    names=["doc", "row", "n", "mark_a", "mark_b", "signs"],
                )

    return run


def _keys(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = prefix_keys(_read_signs(batch.column("signs")), depth)
            ids = batch.column("id")
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.tile(np.arange(ORDERS, dtype=np.int32), len(keys))), ids.take(pa.array(np.repeat(np.arange(len(keys)), ORDERS)))],
                names=["region", "order", "id"],
            )

    return run


def regions(classes: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(region, id) of all small regions with company, star pairs (a, b) of sets alike in every value, and
    (region, id, c) of the crowded regions at the shallow depth, if any."""
    left, parts = classes, []
    stars = crowded = None
    pending = None
    for depth in DEPTHS:
        members = left.mapInArrow(_keys(depth), "region long, order int, id long")
        if pending is not None:
            members = members.join(pending, ["order", "id"], "left_semi")
        members = settle(members, 4)
        counted = members.groupBy("region").agg(F.count("*").alias("c"), F.min("id").alias("least")).filter("c > 1")
        joined = settle(members.join(counted, "region"))
        parts.append(joined.filter(F.col("c") <= REGION).select("region", "id"))
        large = joined.filter(F.col("c") > REGION)
        if large.isEmpty():
            break
        if crowded is None:
            crowded = large.select("region", "id", "c")
        if depth == DEPTHS[-1]:
            stars = large.select(F.col("least").alias("a"), F.col("id").alias("b"))
            break
        pending = large.select("order", "id")
        left = classes.join(pending.select("id").distinct(), "id", "left_semi")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    if stars is None:
        stars = whole.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    return whole, stars, crowded


def blocks(members: DataFrame, size: int) -> DataFrame:
    """(region, id): the members (group, id, c) of each group of `c` dealt into blocks of about `size`."""
    own = F.pmod(F.xxhash64("id", "group"), F.ceil(F.col("c") / max(size, 2)))
    return members.select(F.xxhash64("group", own).alias("region"), "id")


def across(members: DataFrame, size: int) -> DataFrame:
    """(region, id): block pairs in which every two members (group, id, label) of a group with different labels meet.

    Members of a group's most frequent label are known to be connected, so only the others meet everyone; a
    group with one label needs nothing.
    """
    size = max(size, 2)
    counted = members.groupBy("group", "label").agg(F.count("*").alias("c"))
    groups = counted.groupBy("group").agg(
        F.sum("c").alias("c"), F.max("c").alias("most"), F.max_by("label", F.struct("c", "label")).alias("bulk")
    ).filter("c > most")
    found = settle(members.join(groups, "group"))
    n, n_other = F.ceil(F.col("c") / size), F.ceil((F.col("c") - F.col("most")) / size)
    every = found.select("group", "id", F.explode(F.sequence(F.lit(1), n_other)).alias("i"), (F.pmod(F.xxhash64("id", "group"), n) + 1).alias("j"))
    other = found.filter("label <> bulk").select(
        "group", "id", (F.pmod(F.xxhash64("group", "id"), n_other) + 1).alias("i"), F.explode(F.sequence(F.lit(1), n)).alias("j")
    )
    return every.unionByName(other).select(F.xxhash64("group", "i", "j").alias("region"), "id")


def labelled(members: DataFrame, found: DataFrame) -> DataFrame:
    """Add `label`, the component (node, component) of each member's id, or the id itself."""
    known = found.select(F.col("node").alias("id"), F.col("component").alias("label"))
    return members.join(known, "id", "left").withColumn("label", F.coalesce("label", "id"))


def _likely(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A spanning forest of the likely pairs in each region, most alike pairs first.

        What a task has joined goes out as (set, smallest set it hangs together with), which saves rounds later.
        """
        joined: dict[int, int] = {}

        def out() -> pa.RecordBatch:
            nodes = list(joined)
            heads = [root(joined, node) for node in nodes]
            joined.clear()
            return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(heads, pa.int64())], names=["a", "b"])

        for group in stream_groups(batches, "region"):
            group = group.combine_chunks()
            region = group.column("region").to_numpy()
            ids = group.column("id").to_numpy()
            signs = np.frombuffer(b"".join(group.column("sketch").to_pylist()), np.uint8).reshape(len(ids), VALUES)
            heads = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
            sizes = np.diff(np.concatenate([heads, [len(ids)]]))
            out_a, out_b = [], []
            pairs = heads[sizes == 2]
            same = (signs[pairs] == signs[pairs + 1]).mean(1)
            good = pairs[same >= least]
            out_a.append(ids[good])
            out_b.append(ids[good + 1])
            for head, size in zip(heads[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
                own, block = ids[head : head + size], signs[head : head + size]
                alike = np.zeros((size, size), np.float32)
                for k in range(size - 1):
                    alike[k, k + 1 :] = (block[k + 1 :] == block[k]).mean(1)
                a, b = np.nonzero(alike >= least)
                parent = list(range(size))
                edges = []
                for k in np.argsort(-alike[a, b], kind="stable"):
                    x, y = root(parent, int(a[k])), root(parent, int(b[k]))
                    if x != y:
                        parent[x] = y
                        edges.append(k)
                        if len(edges) == size - 1:
                            break
                out_a.append(own[a[edges]])
                out_b.append(own[b[edges]])
            for a, b in zip(np.concatenate(out_a).tolist(), np.concatenate(out_b).tolist()):
                x, y = root(joined, joined.setdefault(a, a)), root(joined, joined.setdefault(b, b))
                joined[max(x, y)] = min(x, y)
            if len(joined) > 500_000:
                yield out()
        yield out()

    return run


def root(parent: list[int] | dict[int, int], node: int) -> int:
    while parent[node] != node:
        parent[node] = parent[parent[node]]
        node = parent[node]
    return node


def linked(values: np.ndarray, bounds: np.ndarray, percent: int) -> np.ndarray:
    """Smallest row that each set is connected with by exact links (intersection >= percent of the union)."""
    n = len(bounds) - 1
    sizes = np.diff(bounds)
    rows = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    ranked = values[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) if len(ranked) else np.zeros(0, bool)
    number = np.cumsum(new) - 1
    shared = np.bincount(number)[number] > 1 if len(number) else np.zeros(0, bool)
    row, column = rows[order][shared], number[shared]
    column = np.unique(column, return_inverse=True)[1] if len(column) else column
    both = np.zeros((n, n), np.float32)
    width = max(256, (1 << 22) // max(n, 1))
    for low in range(0, int(column.max()) + 1 if len(column) else 0, width):
        part = (column >= low) & (column < low + width)
        block = np.zeros((n, min(width, int(column.max()) + 1 - low)), np.float32)
        block[row[part], column[part] - low] = 1
        both += block @ block.T
    union = sizes[:, None] + sizes[None, :] - both
    link = (100 * both.astype(np.float64) >= percent * union) & (sizes[:, None] > 0) & (sizes[None, :] > 0)
    labels = np.arange(n)
    while True:
        least = np.minimum(np.where(link, labels[None, :], n).min(1, initial=n), labels)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def _confirmed(size: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in stream_groups(batches, "family"):
            group = group.combine_chunks()
            family = group.column("family").to_numpy()
            ids = group.column("id").to_numpy()
            cuts = np.flatnonzero(np.concatenate([[True], family[1:] != family[:-1], [True]]))
            texts = group.column("text").combine_chunks()
            least = np.empty(len(ids), np.int64)
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                batch = pa.RecordBatch.from_arrays([texts.slice(low, high - low)], names=["text"])
                parts = [shingles(tokens(data, offsets, lower=True), size) for _, data, offsets in slices(batch, "text")]
                sizes = np.concatenate([np.diff(bounds) for _, bounds in parts])
                values = np.concatenate([v for v, _ in parts])
                labels = linked(values, np.concatenate([[0], np.cumsum(sizes)]), percent)
                smallest = np.full(high - low, np.iinfo(np.int64).max)
                np.minimum.at(smallest, labels, ids[low:high])
                least[low:high] = smallest[labels]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], names=["id", "least"])

    return run


def _large(members: DataFrame, small: DataFrame, exact: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, component) by exact links of the families beyond the bound; members (group, id, c).

    Small regions, blocks of members and then rounds of one representative per component find most links; at
    the end members not yet connected meet in block pairs, so that every two members of a family are compared.
    """

    def merged(found: DataFrame | None, groups: DataFrame) -> DataFrame:
        pairs = exact(groups).select(F.col("id").alias("a"), F.col("least").alias("b"))
        if found is not None:
            pairs = pairs.unionByName(found.select(F.col("node").alias("a"), F.col("component").alias("b")))
        return settle(components(pairs))

    found = merged(None, small.join(members.select("id"), "id", "left_semi").select("region", "id").unionByName(blocks(members, FAMILY // 2)))
    before = None
    while True:
        heads = settle(labelled(members.select("group", "id"), found).select("group", F.col("label").alias("id")).distinct())
        counts = heads.groupBy("group").agg(F.count("*").alias("c")).filter("c > 1")
        left = counts.agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
        if left == 0:
            return found
        if before is not None and 2 * left > before:
            break
        before = left
        found = merged(found, blocks(heads.join(counts, "group"), FAMILY))
    return merged(found, across(labelled(members.select("group", "id"), found), FAMILY // 2))


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Add `n_shingles`, `component_id` and `kept` (the row's id is its component's id).

    A text's set holds its distinct `shingle`-word sequences after lowering A-Z; a text with fewer words has its
    whole sequence as the one element; a null or blank text has no element and is linked with nothing. Two sets are
    linked if 100 * intersection >= `percent` * union. The component id is the smallest document id reachable.
    Equal sets are one node. Rows that share an id count as one document with several texts. A null id is smaller
    than any other and comes back as null. Columns with the added names are replaced; no rows give no rows.
    """
    added = ("n_shingles", "component_id", "kept")
    own = [f for f in df.schema.fields if f.name not in added]
    quoted = [F.col("`" + f.name.replace("`", "``") + "`") for f in own]
    id_of = F.coalesce(F.col(doc).cast("long"), F.lit(NO_ID))
    rows = df.select(*[c.alias(f"c{i}") for i, c in enumerate(quoted)], id_of.alias("doc"), F.xxhash64(F.col(text)).alias("row"))
    texts = df.select(id_of.alias("doc"), F.xxhash64(F.col(text)).alias("row"), F.col(text).alias("text"))
    sets = cut_lineage(texts.mapInArrow(_sets(shingle), "doc long, row long, n long, mark_a long, mark_b long, signs binary"))
    classes = settle(
        sets.filter("n > 0").groupBy("mark_a", "mark_b").agg(F.min(F.struct("doc", "signs")).alias("least"))
        .select(F.col("least.doc").alias("id"), F.col("least.signs").alias("signs"))
    )
    small, stars, crowded = regions(classes)

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            signs = _read_signs(batch.column("signs"))
            ends = np.arange(1, len(signs) + 1) * VALUES
            yield pa.RecordBatch.from_arrays([batch.column("id"), binary_rows((signs & 0xFF).astype(np.uint8).ravel(), ends)], names=["id", "sketch"])

    level = percent / 100
    least = level - 5 * (level * (1 - level) / VALUES) ** 0.5
    least += (1 - least) / 256  # byte-sized values also agree by chance

    def likely(where: DataFrame) -> DataFrame:
        return (
            where.join(classes.mapInArrow(sketches, "id long, sketch binary"), "id")
            .repartition("region").sortWithinPartitions("region").select("region", "id", "sketch").mapInArrow(_likely(least), "a long, b long")
        )

    def exact(groups: DataFrame) -> DataFrame:
        return (
            texts.join(groups, texts["doc"] == groups["id"]).select(F.col("region").alias("family"), "id", "text")
            .repartition("family").sortWithinPartitions("family").mapInArrow(_confirmed(shingle, percent), "id long, least long")
        )

    if crowded is not None:
        crowded = crowded.withColumnRenamed("region", "group")
        joined = components(likely(small.unionByName(blocks(crowded, REGION // 8))).unionByName(stars))
        rest = likely(across(labelled(crowded.select("group", "id"), joined), REGION // 4))
        pairs = rest.unionByName(joined.select(F.col("node").alias("a"), F.col("component").alias("b")))
    else:
        pairs = likely(small).unionByName(stars)
    families = settle(components(pairs).withColumnRenamed("component", "family"))
    sizes = families.groupBy("family").agg(F.count("*").alias("c"))
    too_large = settle(sizes.filter(F.col("c") > FAMILY))
    confirmed = exact(families.join(too_large, "family", "left_anti").select(F.col("family").alias("region"), F.col("node").alias("id")))
    if not too_large.isEmpty():
        members = settle(families.join(too_large, "family").select(F.col("family").alias("group"), F.col("node").alias("id"), "c"))
        confirmed = confirmed.unionByName(_large(members, small, exact).select(F.col("node").alias("id"), F.col("component").alias("least")))
    # Every class leads to its component; a document with several texts takes the smallest.
    heads = confirmed.groupBy("id").agg(F.min("least").alias("least"))
    ids = sets.filter("n > 0").groupBy("mark_a", "mark_b").agg(F.min("doc").alias("id"))
    marked = ids.join(heads, "id", "left").select("mark_a", "mark_b", F.coalesce("least", "id").alias("least"))
    found = sets.select("doc", "row", "n", "mark_a", "mark_b").join(marked, ["mark_a", "mark_b"], "left")
    found = found.groupBy("doc", "row").agg(F.first("n").alias("n"), F.min("least").alias("least"))
    least = F.coalesce("least", "doc")
    return rows.join(found, ["doc", "row"]).select(
        *[F.col(f"c{i}").alias(f.name) for i, f in enumerate(own)],
        F.col("n").alias("n_shingles"),
        F.nullif(least, F.lit(NO_ID)).alias("component_id"),
        (F.col("doc") == least).alias("kept"),
    )
