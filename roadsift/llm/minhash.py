"""Near-duplicate components from HyperMinHash registers.

A document is the set of its distinct ``words``-word shingles.  One hash per shingle picks a bucket; the bucket keeps its least
remaining hash as the number of leading zeros and ``MANTISSA`` bits after them, 16 bits in all.  Bands of registers give
candidates, an estimate of the Jaccard similarity that is corrected for chance collisions drops most of them, and shared shingles of
the full sets decide.

Equal sets are one class, so copies are never paired.  Inside a band's bucket all members are first compared with the smallest one.
What these links leave apart is compared in blocks inside tasks, by registers first: of the pairs that pass the estimate a task
returns a spanning forest, whose trees are the candidate clusters.  The full sets of a cluster then meet, again in blocks, and a task
returns at most one link for two components.  So the rows that leave a task grow with its members, not with their pairs.

With ``BANDS`` bands of ``ROWS`` registers that agree independently a pair at similarity 0.85 shares no band with probability 1e-10, at 0.8
with 5e-8.  Registers of small sets are borrowed and repeat, and shingles that meet in a bucket shift the similarity a little, so for those
the figure isn't derived but simulated: no pair lost of 5,000 at each of 13 sizes from 5 to 500 shingles, at similarities 0.8 to 0.92.  The
estimate errs by more than ``SIGMAS`` standard errors with probability 3e-5.

Defined results: a text without words, null and empty included, is an empty set and linked with nothing; fewer words than a
shingle needs are one shingle; ids are integers; a null id has a null component and is linked with nothing; rows with one id are
one document whose texts all count; repeated rows each give one row; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadsift.functions.durable import stored
from roadsift.llm.components import components
from roadsift.llm.text import Words, mixed, slices, window_hashes

BUCKET_BITS = 8
MANTISSA = 10
BANDS, ROWS = 32, 4
SIGMAS = 4.0
BLOCK = 1024
SET_BLOCK = 256
COLUMNS = 4096
# fixed values: the order in which each bucket asks all buckets for a register
LENDERS = np.argsort(mixed(np.arange(1, (1 << 2 * BUCKET_BITS) + 1, dtype=np.uint64)).reshape(1 << BUCKET_BITS, -1), axis=1).astype(np.uint8)
# fixed value of the published collision estimate for one bucket of two sets of equal size
CHANCE = 0.169919487159739093975315012348


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words = Words(column, lower=True)
    hashes, _ = window_hashes(words.hashes, words.doc, size)
    bounds = words.bounds.tolist()
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            yield np.unique(hashes[a:b - size + 1])
        elif b > a:  # the whole sequence
            total = np.uint64(b - a)
            with np.errstate(over="ignore"):
                for h in words.hashes[a:b]:
                    total = total * np.uint64(0x9E3779B97F4A7C15) + h
            yield mixed(np.array([total]))
        else:
            yield np.zeros(0, np.uint64)


def registers(shingles: np.ndarray) -> np.ndarray:
    """Leading zeros and mantissa of the least hash in each bucket; 0 for an empty bucket."""
    out = np.zeros(1 << BUCKET_BITS, np.uint16)
    bucket = (shingles >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    rest = np.maximum(shingles[first] << np.uint64(BUCKET_BITS), np.uint64(1)).astype(np.float64).view(np.int64)  # its exponent and mantissa
    zeros = 63 - ((rest >> 52) - 1023)
    out[bucket[first]] = ((np.clip(zeros, 0, 61) + 1) << MANTISSA) | ((rest >> (52 - MANTISSA)) & ((1 << MANTISSA) - 1))
    return out


def estimate(a: np.ndarray, b: np.ndarray, n_a, n_b) -> tuple[np.ndarray, np.ndarray]:
    """Jaccard estimates of register rows and the buckets they rest on, corrected for registers that agree by chance."""
    used = ((a != 0) | (b != 0)).sum(-1)
    equal = ((a == b) & (a != 0)).sum(-1)
    ratio = n_a / n_b
    chance = 4 * ratio / (1 + ratio) ** 2 * CHANCE / (1 << MANTISSA)
    return (equal - chance * used) / np.maximum(used - chance * used, 1), used


def plausible(a, b, n_a, n_b, percent: int) -> np.ndarray:
    """Whether sets with these registers may reach the similarity."""
    goal = percent / 100
    jaccard, used = estimate(a, b, n_a, n_b)
    near = jaccard >= goal - SIGMAS * np.sqrt(goal * (1 - goal) / np.maximum(used, 1))
    return near & (100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b))


def band_keys(rows: np.ndarray) -> np.ndarray:
    """One key for each band of each document; an empty bucket borrows the register of the first full one in its own order of all buckets.

    The orders are independent, so what differs in one bucket of a small set isn't lent to its neighbours and to all bands together."""
    width = rows.shape[1] // ROWS
    used = np.array([[band * width // BANDS + k * width for k in range(ROWS)] for band in range(BANDS)]).ravel()
    full = rows[:, used].astype(np.uint64)
    doc, place = np.nonzero(full == 0)
    for attempt in range(rows.shape[1]):
        if not len(doc):
            break
        lent = rows[doc, LENDERS[used[place], attempt]]
        full[doc, place] = lent
        doc, place = doc[lent == 0], place[lent == 0]
    full = full.reshape(len(rows), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(rows), BANDS))
    for k in range(ROWS):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + full[:, :, k])
    return keys


def sketches(docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """Set size, a 128-bit name of the set, and its registers for each row."""
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                n, one, two, regs = [], [], [], []
                for s in shingle_sets(part.column("text"), size):
                    n.append(len(s))
                    one.append(int(mixed(s).sum().view(np.int64)))
                    two.append(int(mixed(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum().view(np.int64)))
                    regs.append(registers(s).tobytes())
                yield pa.record_batch([part.column("id"), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(regs, pa.binary())],
                                      ["id", "n", "one", "two", "regs"])

    return slim.mapInArrow(run, "id long, n long, one long, two long, regs binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, 1 << BUCKET_BITS)


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch.column("regs")))
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(ids, BANDS))], ["key", "id"])


def with_registers(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.col("regs").alias(f"r_{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a")


def likely(pairs: DataFrame, percent: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("n_a", "n_b"))
                ok = plausible(_matrix(batch.column("r_a")), _matrix(batch.column("r_b")), n_a, n_b, percent)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    return pairs.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long")


def full_sets(ids: DataFrame, docs: DataFrame, id: str, text: str, size: int) -> DataFrame:
    """``id``, ``items``: the sets of some ids, made again from their texts; an id may stand for rows with different texts."""
    slim = docs.select(F.col(id).cast("long").alias("id"), F.col(text).cast("string").alias("text")).join(ids, "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = pa.array([s.view(np.int64) for s in shingle_sets(part.column("text"), size)], pa.list_(pa.int64()))
                yield pa.record_batch([part.column("id"), sets], ["id", "items"])

    return slim.mapInArrow(run, "id long, items array<long>").where(F.size("items") > 0)


def confirmed(pairs: DataFrame, docs: DataFrame, id: str, text: str, size: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = stored(full_sets(ids, docs, id, text, size).dropDuplicates(), "sets")
    both = pairs.join(sets.select(F.col("id").alias("b"), F.col("items").alias("of_b")), "b").join(sets.select(F.col("id").alias("a"), F.col("items").alias("of_a")), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    union = F.size("of_a") + F.size("of_b") - F.col("shared")
    return both.withColumn("shared", shared).where(100 * F.col("shared") >= percent * union).select("a", "b").distinct()


class Forest:
    """Union-find over arbitrary labels."""

    def __init__(self):
        self.up: dict = {}

    def root(self, x):
        up = self.up
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above] if above in up else above
            x = above
        return x

    def join(self, a, b) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def in_blocks(members: DataFrame, key: str, count: str, block: int, columns: list[str], compare) -> DataFrame:
    """Bring the members of a key together in blocks: a pair of blocks is one unit, and ``compare`` gets the units of a task one by one.

    A key with n members is dealt to (n / block) ** 2 / 2 units; each member is copied n / block times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, {}
        names = ["block", *columns]

        def flush():
            if now is not None and len(held["id"]) > 1:
                edges = compare(now[1] == now[2], {c: held[c] for c in names})
                if edges:
                    a, b = zip(*edges)
                    yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            units = list(zip(*[batch.column(c).to_pylist() for c in ("key", "i", "j")]))
            lists = {c: batch.column(c).to_pylist() if c != "items" else [batch.column(c)[r].values.to_numpy() for r in range(batch.num_rows)] for c in names}
            for r, unit in enumerate(units):
                if unit != now:
                    yield from flush()
                    now, held = unit, {c: [] for c in names}
                for c in names:
                    held[c].append(lists[c][r])
        yield from flush()

    placed = members.withColumn("blocks", F.ceil(F.col(count) / block).cast("long")).withColumn("block", F.pmod(F.xxhash64("id", F.lit(7)), F.col("blocks")))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    placed = placed.select(F.col(key).alias("key"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", *columns)
    return placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def apart(members: DataFrame, percent: int) -> DataFrame:
    """A spanning forest of the pairs in one bucket, but different components, that may be similar."""

    def compare(alone: bool, held: dict) -> list[tuple[int, int]]:
        ids, n, comp, block = (np.array(held[c]) for c in ("id", "n", "component", "block"))
        regs = np.frombuffer(b"".join(held["regs"]), np.uint16).reshape(len(ids), -1)
        forest, edges = Forest(), []
        for k in range(len(ids) - 1):
            rest = np.arange(k + 1, len(ids))
            rest = rest[(comp[rest] != comp[k]) & (alone | (block[rest] != block[k]))]
            if len(rest):
                mine = int(ids[k])
                edges += [(mine, other) for other in ids[rest[plausible(regs[rest], regs[k], n[rest], n[k], percent)]].tolist() if forest.join(mine, other)]
        return edges

    return in_blocks(members, "key", "members", BLOCK, ["id", "n", "component", "regs"], compare)


def linked_in(members: DataFrame, percent: int) -> DataFrame:
    """Links between different components of a cluster, from full sets; at most one for two components of a unit."""

    def compare(alone: bool, held: dict) -> list[tuple[int, int]]:
        ids, comp, block = (np.array(held[c]) for c in ("id", "component", "block"))
        sizes = np.array([len(x) for x in held["items"]])
        items, place, n = np.unique(np.concatenate(held["items"]), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), sizes)
        common = n > 1  # an item of one set is in no intersection
        column = (np.cumsum(common) - 1)[place]
        row, column = row[common[place]], column[common[place]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        shared = np.zeros((len(ids), len(ids)), np.float32)
        for begin in range(0, int(common.sum()), COLUMNS):
            a, b = np.searchsorted(column, (begin, begin + COLUMNS))
            dense = np.zeros((len(ids), COLUMNS), np.float32)
            dense[row[a:b], column[a:b] - begin] = 1
            shared += dense @ dense.T
        hit = 100 * shared.astype(np.int64) >= percent * (sizes[:, None] + sizes[None, :] - shared.astype(np.int64))
        hit &= comp[:, None] != comp[None, :]
        if not alone:
            hit &= block[:, None] != block[None, :]
        forest = Forest()
        return [(int(ids[x]), int(ids[y])) for x, y in np.argwhere(np.triu(hit)).tolist() if forest.join(int(comp[x]), int(comp[y]))]

    return in_blocks(members, "cluster", "members", SET_BLOCK, ["id", "component", "items"], compare)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 85) -> DataFrame:
    """``id``, ``n_shingles``, ``component_id``, ``kept`` for every row: documents with ``100 * shared >= percent * union`` are linked."""
    rows = stored(sketches(docs, id, text, words), "sketches")
    full = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    name = ["n", "one", "two"]
    classes = stored(full.groupBy(*name).agg(F.min("id").alias("id"), F.first("regs").alias("regs")), "classes")
    bands = classes.select("id", "regs").mapInArrow(_bands, "key long, id long")
    hubs = bands.groupBy("key").agg(F.min("id").alias("hub"), F.count("*").alias("members")).where("members > 1")
    buckets = stored(bands.join(hubs, "key").where("id <> hub"), "buckets")
    stars = buckets.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(confirmed(stored(likely(with_registers(stars, classes), percent), "pairs"), docs, id, text, words, percent), "links")
    # what the stars leave apart
    found = components(links)
    placed = buckets.where("members > 2").join(found, "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    members = placed.join(open_keys, "key").join(classes.select("id", "n", "regs"), "id")
    clusters = components(apart(members, percent)).withColumnRenamed("component", "cluster")
    clusters = stored(clusters.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "clusters")
    sized = clusters.join(clusters.groupBy("cluster").agg(F.count("*").alias("members")), "cluster")
    more = linked_in(full_sets(clusters.select("id"), docs, id, text, words).join(sized, "id"), percent)
    # rows that share an id tie the classes of their sets together
    ties = full.join(classes.withColumnRenamed("id", "b").select(*name, "b"), name).where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    everything = links.unionByName(more).unionByName(ties)
    found = components(everything)
    out = rows.join(found, "id", "left").withColumn("component_id", F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", (F.col("id") == F.col("component_id")).alias("kept"))
