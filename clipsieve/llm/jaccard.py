"""Similarity join of documents on word shingles (Jaccard), by vertical partitioning.

All shingles stand in one global order: rarer ones first (by the number of sets
that have them), then by hash. Documents with equal sets are one class.

1. Frequencies. Shingles are counted by bucket in a distributed table (see
   ``buckets``), and every chunk of texts looks its own up. A shingle that is
   alone in its bucket is in one set only and can't be shared. A class in which
   such shingles fill the prefix can't link, and goes no further.
2. Fragments. The global order is cut where the counted mass is even; each
   class's shared shingles are kept as one segment a fragment.
3. Candidates. Two sets with Jaccard similarity t or more share one of each
   one's first ``n - ceil(t n) + 1`` shingles. Of every such shingle's list of
   classes (of similar size), only the pairs with its least class, the hub, are made.
4. Overlaps. In each fragment separately a hub's segment meets those of its
   partners, which pass by as a stream; partial counts are summed per pair.
5. Closing. Links make components. In a hub's group, two classes in different
   components are compared by what sets each apart from the hub: their overlap
   follows from the overlaps with the hub and the number of differences that they
   share. Groups are cut into blocks, and only links leave a block.

Every pair that shares a leading shingle is tested, or found in one component
already; no pair is lost, and no pair is made within a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import buckets, shingles
from .common import Scratch, free, join_by_size
from .components import components

#: Similarity in hundredths from which two sets are linked.
PERCENT = 80
#: Bits of a bucket's number, at least; there is a bucket for every character at least, some six for each shingle, at any size.
MIN_BITS = 16
#: Fragments of the global order in which overlaps are counted.
FRAGMENTS = 8
#: Rounds in which texts look their shingles up, so that a round's files are a part of the whole.
ROUNDS = 3
#: The level of a bucket that was counted once: its shingle is in one set only.
ALONE = 2
#: Members of a hub's group that are compared with how many others in one task.
BLOCK = (128, 128)
#: Partners of a hub that one task meets, unless they are less than a 10,000th of all.
PARTNERS = 500

_SETS = T.StructType([
    T.StructField("key", T.LongType()), T.StructField("n", T.LongType()), T.StructField("shared", T.LongType()),
    T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("segments", T.ArrayType(T.BinaryType())),
])


def least_overlap(total: int | np.ndarray, percent: int = PERCENT):
    """The least overlap of two sets of ``total`` elements together for 100 * overlap >= percent * union."""
    return -(-percent * total // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """A linked set of n elements shares one of its first so many with its partner."""
    return n - -(-percent * n // 100) + 1 if n else 0


# -- frequencies ------------------------------------------------------------------


def _levels(counts: np.ndarray) -> np.ndarray:
    """Steps of half a power of two, one byte each; 1 gives ALONE."""
    return np.ceil(2 * np.log2(counts + 1.0)).astype(np.uint8)


def _distinct_sets(texts: pa.Array, seen: set[tuple[int, int]]) -> Iterator[np.ndarray]:
    """The sets of ``texts`` that ``seen`` lacks, which gets them."""
    for s in shingles.shingle_sets(texts):
        if len(s) and (name := (shingles.set_key(s), len(s))) not in seen:
            seen.add(name)
            yield s


def frequencies(docs: DataFrame, bits: int) -> DataFrame:
    """``piece, levels, mass``: how many sets of ``docs`` (``text``) have a shingle of each bucket, as levels, and the sum of counts by level.

    Equal sets count once within a chunk; that they count again elsewhere only
    makes a class go on that could have been left out.
    """
    low, shift = buckets.low_bits(bits), np.uint64(64 - bits)
    sent = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("places", T.BinaryType()), T.StructField("counts", T.BinaryType())])
    schema = T.StructType([T.StructField("piece", T.IntegerType()), T.StructField("levels", T.BinaryType()), T.StructField("mass", T.ArrayType(T.LongType()))])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, seen = [], 0, set()

        def packed() -> pa.RecordBatch:
            at, counts = np.unique((np.concatenate(held) >> shift).astype(np.int64), return_counts=True)
            rows = [(k, places, buckets.pack(counts[lo:hi].astype(np.uint32))) for k, lo, hi, places in buckets.cut(at, low)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary()), strict=True)], sent.names)

        for batch in batches:
            for s in _distinct_sets(batch.column(0), seen):
                held.append(s)
                n += len(s)
                if n >= buckets.CHUNK or len(held) >= buckets.TEXTS:
                    yield packed()
                    held, n = [], 0
                    seen.clear()
        if n:
            yield packed()

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, np.zeros(0, np.int64)

        def summed() -> pa.RecordBatch:
            level = _levels(sums)
            mass = np.bincount(level, sums, 256).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([buckets.pack(level)], pa.binary()), pa.array([mass.tolist()], pa.list_(pa.int64()))], schema.names)

        for batch in batches:
            for k, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if k != now:
                    if now is not None:
                        yield summed()
                    now, sums = k, np.zeros(1 << low, np.int64)
                sums[buckets.places_of(places)] += buckets.unpack(counts, np.uint32)
        if now is not None:
            yield summed()

    return docs.select("text").mapInArrow(count, sent).repartition("piece").sortWithinPartitions("piece").mapInArrow(add_up, schema)


def fragment_cuts(table: DataFrame) -> np.ndarray:
    """The FRAGMENTS - 1 places (level, then the hash's top 56 bits) that cut the mass of shared shingles evenly."""
    mass = np.zeros(256)
    for r in table.select(F.posexplode("mass").alias("level", "n")).groupBy("level").agg(F.sum("n").alias("n")).collect():
        mass[r["level"]] = r["n"]
    mass[: ALONE + 1] = 0
    until = np.cumsum(mass)
    out = []
    for k in range(1, FRAGMENTS):
        goal = until[-1] * k / FRAGMENTS
        level = int(np.searchsorted(until, goal, "right"))
        inside = (goal - (until[level] - mass[level])) / mass[level] if level < 256 and mass[level] else 0.0
        out.append(min(level, 255) << 56 | int(inside * (2**56 - 1)))
    return np.array(out, np.uint64)


def _sets(asked: DataFrame, answered: DataFrame, bits: int, cuts: np.ndarray, percent: int, id_type: T.DataType) -> DataFrame:
    """``doc_id, key, n, shared, prefix, segments`` of every document.

    The last three stand at a class's first row in its chunk, if the class may
    link: the number of shingles that other sets may have, those of them that lead
    in the global order, and all of them as one segment a fragment.
    """
    shift, schema = np.uint64(64 - bits), T.StructType([T.StructField("doc_id", id_type), *_SETS])

    def use(batch: pa.RecordBatch, levels: np.ndarray) -> Iterator[pa.RecordBatch]:
        sets = list(shingles.shingle_sets(batch.column(1)))
        at = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) >> shift, return_inverse=True)[1]
        seen: set[tuple[int, int]] = set()
        keys, sizes, shared, leads, segments, begin = [], [], [], [], [], 0
        for s in sets:
            n, key = len(s), shingles.set_key(s)
            level, begin = levels[at[begin : begin + n]], begin + n
            many = level > ALONE
            r, p = int(many.sum()), prefix_length(n, percent)
            lead = parts = None
            if n and n - r < p and (key, n) not in seen:
                seen.add((key, n))
                of = s[many]
                place = level[many].astype(np.uint64) << np.uint64(56) | of >> np.uint64(8)
                order = np.lexsort((of, place))
                of, place = of[order], place[order]
                lead = of[: p - (n - r)].view(np.int64)
                parts = [np.sort(x.view(np.int64)).tobytes() for x in np.split(of, np.searchsorted(place, cuts))]
            for column, x in ((keys, key), (sizes, n), (shared, r if parts else None), (leads, lead), (segments, parts)):
                column.append(x)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(shared, pa.int64()),
                                          pa.array(leads, pa.list_(pa.int64())), pa.array(segments, pa.list_(pa.binary()))], schema.names)

    return buckets.met(asked, answered, np.uint8, use, schema)


# -- overlaps by fragment ---------------------------------------------------------


def _beside(pairs: DataFrame, classes: DataFrame, scratch: Scratch, name: str, differ: bool) -> DataFrame:
    """``pairs`` (``hub, key`` and more) with ``overlap``, and if ``differ`` with ``apart``, the shingles that only one of both has.

    In each fragment the hub's segment comes first and its partners' follow as a
    stream, so a task holds one segment besides the passing batch. A hub with many
    partners is dealt to several tasks.
    """
    count = pairs.groupBy("hub").agg(F.count(F.lit(1)).alias("m"))
    sized = scratch.write(count, f"{name}_hubs")
    most = max(PARTNERS, (sized.agg(F.sum("m")).first()[0] or 0) // 10_000)
    parts = F.ceil(F.col("m") / most).cast("int")
    large = F.broadcast(sized.filter(F.col("m") > most).select("hub", parts.alias("parts")))  # 10,000 at most
    segments = classes.select("key", "segments")
    member = pairs.select("hub", "key").join(large, "hub", "left").join(segments, "key").select(
        "hub", F.pmod(F.xxhash64("key"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"), F.lit(True).alias("member"), "key", F.posexplode("segments").alias("fragment", "segment"))
    own = sized.select("hub", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")).join(segments.withColumnRenamed("key", "hub"), "hub").select(
        "hub", "part", F.lit(False).alias("member"), F.col("hub").alias("key"), F.posexplode("segments").alias("fragment", "segment"))
    schema = T.StructType([T.StructField("hub", T.LongType()), T.StructField("key", T.LongType()), T.StructField("shared", T.LongType()), T.StructField("apart", T.BinaryType())])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(0, np.int64)
        for batch in batches:
            out: tuple[list, list, list, list] = ([], [], [], [])
            for hub, is_member, key, segment in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                other = np.frombuffer(segment, np.int64)
                if not is_member:
                    mine = other
                    continue
                at = np.searchsorted(mine, other)
                there = mine[np.minimum(at, len(mine) - 1)] == other if len(mine) else np.zeros(len(other), bool)
                apart = None
                if differ:
                    left = np.ones(len(mine), bool)
                    left[at[there]] = False
                    apart = np.concatenate([mine[left], other[~there]]).tobytes()
                for column, x in zip(out, (hub, key, int(there.sum()), apart), strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], schema.names)

    stream = member.unionByName(own).repartition("hub", "fragment", "part").sortWithinPartitions("hub", "fragment", "part", "member")
    found = stream.select("hub", "member", "key", "segment").mapInArrow(meet, schema).groupBy("hub", "key").agg(
        F.sum("shared").alias("overlap"), *([F.collect_list("apart").alias("apart")] if differ else []))
    out = scratch.write(pairs.join(found, ["hub", "key"]), name)
    free(pairs)
    return out


# -- closing ----------------------------------------------------------------------


def _close(groups: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` between members of one hub's group that lie in different components.

    ``groups``: ``hub, hub_shared, key, n, overlap, root, open, apart`` (the
    shared shingles in which the member and the hub differ; open: the member is
    not in the hub's component). For members x and y, overlap(x, y) = overlap(x,
    hub) + overlap(y, hub) - hub_shared + (differences they share): shared ones
    are missing in both, or extra in both. Two members whose overlap is enough
    without any shared difference are both linked to the hub, so one of each
    pair is open. Open members are dealt to blocks, and every member goes to each
    block of its hub; a pair of open ones is made once, where its smaller key is
    in the block.
    """
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
    sized = groups.groupBy("hub").agg(F.count(F.lit(1)).alias("members"), F.sum(F.col("open").cast("long")).alias("opened")).filter("opened > 0")
    rows, cols = BLOCK
    cut = groups.join(sized, "hub").withColumns({
        "ups": F.ceil(F.col("opened") / rows).cast("int"), "downs": F.ceil(F.col("members") / cols).cast("int")})
    u = F.pmod(F.xxhash64("key"), F.col("ups")).cast("int")
    g = F.pmod(F.xxhash64("key", F.lit(1)), F.col("downs")).cast("int")
    keep = ["hub", "hub_shared", "key", "n", "overlap", "root", "apart"]
    left = cut.filter("open").select(*keep, F.lit(True).alias("query"), u.alias("up"), F.explode(F.sequence(F.lit(0), F.col("downs") - 1)).alias("down"))
    right = cut.select(*keep, F.col("open"), g.alias("down"), F.explode(F.sequence(F.lit(0), F.col("ups") - 1)).alias("up"))
    cells = left.withColumn("open", F.lit(True)).unionByName(right.withColumn("query", F.lit(False)))
    # small groups share a cell: a task's call costs more than their few pairs
    lot = F.when((F.col("up") + F.col("down") == 0), F.pmod(F.xxhash64("hub"), F.lit(4096))).otherwise(F.xxhash64("hub"))

    def link(frame: pd.DataFrame) -> pd.DataFrame:
        pairs: list[tuple[int, int]] = []
        frame["apart"] = [np.frombuffer(b"".join(x), np.int64) for x in frame["apart"]]
        for _, group in frame.groupby(["hub", "up", "down"], sort=False):
            pairs += _block(group[group["query"]], group[~group["query"]], percent)
        return pd.DataFrame(pairs, columns=["a", "b"], dtype="int64")

    return cells.withColumn("lot", lot).groupBy("lot", "up", "down").applyInPandas(link, schema)


def _block(queries: pd.DataFrame, members: pd.DataFrame, percent: int) -> list[tuple[int, int]]:
    """Links between the open members in ``queries`` and ``members``."""
    if not len(queries) or not len(members):
        return []
    sizes = queries["apart"].map(len).to_numpy()
    tokens = np.concatenate(queries["apart"].to_list())
    owner = np.repeat(np.arange(len(queries)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    q_key, q_n, q_o, q_root = (queries[c].to_numpy() for c in ("key", "n", "overlap", "root"))
    hub_shared = int(queries["hub_shared"].iloc[0])
    out = []
    for key, n, o, root, open_, apart in members[["key", "n", "overlap", "root", "open", "apart"]].itertuples(index=False, name=None):
        mine = (q_root != root) & (np.minimum(q_n, n) * 100 >= percent * np.maximum(q_n, n))
        if open_:
            mine &= q_key < key
        if not mine.any():
            continue
        lo, hi = np.searchsorted(tokens, apart, "left"), np.searchsorted(tokens, apart, "right")
        count = hi - lo
        at = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else np.zeros(0, np.int64)
        shared = np.bincount(owner[at], minlength=len(queries))
        overlap = q_o + o - hub_shared + shared
        for k in np.flatnonzero(mine & (100 * overlap >= percent * (q_n + n - overlap))):
            out.append((int(q_key[k]), int(key)))
    return out


# -- the join ---------------------------------------------------------------------


def similar_classes(docs: DataFrame, scratch: Scratch, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs`` (``doc_id, text``).

    ``component_id`` is the smallest doc_id that is reachable by links, itself
    included; documents link when 100 * overlap >= percent * union of their sets
    of distinct 5-word shingles (see ``shingles``). Null, empty and wordless
    texts have no shingles and link with nothing. Rows that repeat an id with
    different texts are nodes of their own and share nothing by the id. Null ids
    take part; a component of null ids only has a null ``component_id``. An empty
    table gives no rows; other columns are not read. Ids may be of any type that has an order.
    """
    docs = docs.select("doc_id", "text")
    bits = max(MIN_BITS, (docs.agg(F.sum(F.length("text"))).first()[0] or 0).bit_length())
    table = scratch.write(frequencies(docs, bits), "frequencies")
    free(docs)
    cuts = fragment_cuts(table)
    shift = np.uint64(64 - bits)

    def of(texts: pa.Array) -> Iterator[np.ndarray]:
        return ((s >> shift).astype(np.int64) for s in shingles.shingle_sets(texts))

    rows = None
    for k in range(ROUNDS):
        asked = scratch.write(buckets.asks(docs.filter(F.pmod(F.xxhash64("text"), F.lit(ROUNDS)) == k), bits, of, 1), f"asks{k}")
        answered = buckets.answers(asked, table, ("levels",), lambda held: buckets.unpack(held[0], np.uint8))
        part = scratch.write(_sets(asked, answered, bits, cuts, percent, docs.schema["doc_id"].dataType), f"sets{k}")
        scratch.drop(f"asks{k}")
        free(docs)
        rows = part if rows is None else rows.unionByName(part)
    # A set shares at most its shared shingles, so it links with sets of at most ``most`` shingles.
    most = F.floor((100 + percent) * F.col("shared") / percent).cast("long") - F.col("n")
    live = rows.filter("prefix IS NOT NULL")
    classes = scratch.write(live.select("key", "n", "shared", most.alias("most"), "prefix", "segments").dropDuplicates(["key"]), "classes")
    # Sizes of linked sets differ by less than 100 / percent, so they lie in the same class of sizes or in
    # neighbouring ones: a list has the sets of one class, whose least key is its hub, and those of the class below.
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent)) * 1.000001)).cast("int")
    sides = F.array(F.struct(size.alias("size"), F.lit(True).alias("own")), F.struct((size + 1).alias("size"), F.lit(False).alias("own")))
    sided = classes.select(F.explode("prefix").alias("token"), "key", "n", "shared", "most", sides.alias("sides")).select("*", F.explode("sides").alias("s")).select(
        "token", "key", "n", "shared", "most", "s.size", "s.own")
    hubs = scratch.write(sided.groupBy("token", "size").agg(
        F.min(F.when(F.col("own"), F.struct("key", "n", "shared", "most"))).alias("hub"), F.count(F.lit(1)).alias("m")).filter("m > 1 AND hub IS NOT NULL"), "hubs")
    can = (F.col("most") >= F.col("hub.n")) & (F.col("hub.most") >= F.col("n")) & (100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    lists = scratch.write(join_by_size(sided, hubs, ["token", "size"]).filter("key != hub.key").select(
        "token", "size", F.col("hub.key").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.shared").alias("hub_shared"), "key", "n", "most", can.alias("can")), "lists")
    stars = scratch.write(lists.filter("can").select("hub", "hub_n", "key", "n").distinct(), "stars")
    overlaps = _beside(stars, classes, scratch, "overlaps", differ=False)
    enough = 100 * F.col("overlap") >= percent * (F.col("n") + F.col("hub_n") - F.col("overlap"))
    links = scratch.write(overlaps.filter(enough).select(F.col("hub").alias("a"), F.col("key").alias("b")), "links")
    roots = components(links, scratch, "first")
    # lists with members in different components, besides the hub, that can link by their sizes
    placed = scratch.write(lists.join(roots.select(F.col("node").alias("key"), "root"), "key", "left").withColumn("root", F.coalesce("root", "key")), "placed")
    unsettled = scratch.write(placed.groupBy("token", "size").agg(
        F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least_n"), F.max("most").alias("most_most"), F.count(F.lit(1)).alias("m")).filter("lo < hi").drop("lo", "hi"), "unsettled")
    members = join_by_size(placed, unsettled, ["token", "size"]).filter("most >= least_n AND most_most >= n").select("hub", "hub_shared", "key", "n", "root").distinct()
    groups = members.join(roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root")), "hub", "left")
    groups = scratch.write(groups.withColumn("open", F.col("root") != F.coalesce("hub_root", "hub")).drop("hub_root"), "groups")
    more = scratch.write(_close(_beside(groups, classes, scratch, "apart", differ=True), percent).distinct(), "more")
    free(docs)
    if more.limit(1).count():
        roots = components(links.unionByName(more), scratch, "second")
    return _named(rows.select("doc_id", "key", "n"), roots, scratch)


def _named(rows: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """Each row with its component's least id, found by class first, so that common classes and large components are no task's burden."""
    by_class = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    by_class = by_class.join(roots, F.col("key") == F.col("node"), "left").select("key", "least", "rows", F.coalesce("root", "key").alias("root"))
    by_class = scratch.write(by_class, "by_class")
    by_root = scratch.write(by_class.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("m")), "by_root")
    named = scratch.write(join_by_size(by_class.select("key", "rows", "root"), by_root, ["root"]).select("key", "rows", "component_id"), "named")
    out = ["doc_id", F.col("n").alias("n_shingles"), "component_id"]
    return join_by_size(rows.filter("n > 0"), named, ["key"], "rows").select(*out).unionByName(
        rows.filter("n = 0").withColumn("component_id", F.col("doc_id")).select(*out))
