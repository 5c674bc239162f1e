"""Near-duplicate documents by bottom-k sketches of one hash function.

A document's set is its distinct word shingles.  Equal sets form a class, and classes are
what is compared.  The ``k`` least hashes of a set are its sketch; inverted lists of the
retained values give candidate pairs, the sketch of a pair's union estimates its similarity,
and full sets decide.

Two sets of similarity s share about s * k of the k least values of their union.  ``needed``
says how many they share at least, but for a chance below 10**-9; so only the rarest
``k - needed + 1`` values of a sketch are listed, values that no other sketch retains counting
as the rarest.  A passage that many documents hold is thus not listed by a document of which
it is a minor part, however many hold it.

Lists are not expanded into pairs.  The least node of a list leads it, and lists with one
leader count as one group.  Members are first compared with their leaders, and components
follow.  Only groups that still hold several components are compared inside, in blocks of
bounded size, by counting common values: first those of sketches, which leaves the members
that may have a link to another component, then those of their full sets.  A block hands on
the links that join components, not its pairs.  So no link between components is lost, and n
near copies make about n rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.bits import MOST, bits
from tessella.llm.store import keep, table
from tessella.llm.text import Block, blocks, spans_hash
from tessella.plans.ship import ship

K = 64
MISS = 1e-9
#: Members of a group that are compared with each other at once, and values of their full sets, about.
GROUP = 1024
GROUP_VALUES = 4 << 20
#: Parts that the members of one leader are dealt into where they meet the leader's row.
SALTS = 16
#: A value held by more members of a block than this is counted by a matrix product, else pair by pair.
DENSE = 16


def shingle_sets(block: Block, words: int) -> Iterator[np.ndarray]:
    """Of each text, the distinct hashes of its runs of ``words`` words, ascending; of a shorter text, its one whole run."""
    hashes = block.hashes()
    at, h = block.windows(hashes, words)
    h = h.view(np.int64)
    first = np.searchsorted(at, block.first)
    short = (block.counts > 0) & (block.counts < words)
    whole = iter(spans_hash(hashes, block.first[:-1][short], block.first[1:][short]).view(np.int64))
    for i in range(len(block)):
        yield np.array([next(whole)]) if short[i] else np.unique(h[first[i] : first[i + 1]])


def _fingerprint(values: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes: two sums of unrelated scramblings, each modulo 2**64."""
    x = values.view(np.uint64)
    a = x * np.uint64(0xD6E8FEB86659FD93)
    b = (x ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return np.array([(a ^ (a >> np.uint64(32))).sum(dtype=np.uint64), (b ^ (b >> np.uint64(29))).sum(dtype=np.uint64)]).tobytes()


@cache
def needed(n: int, k: int, threshold: float) -> int:
    """How many retained values a set of size ``n`` shares at least with any set of that similarity.

    Where both are retained whole, this is exact; else it is the count that a binomial
    of k draws falls below with a chance of ``MISS``.
    """
    if n / threshold <= k:
        return math.ceil(threshold * n - 1e-9)
    total = 0.0
    for i in range(k + 1):
        total += math.comb(k, i) * threshold**i * (1 - threshold) ** (k - i)
        if total > MISS:
            return min(i, math.ceil(threshold * n - 1e-9))
    return 0


def sketches(docs: DataFrame, words: int, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, n, fp, sketch) of each row: the size of its set, the set's fingerprint and its ``k`` least hashes."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, block in blocks(batch, text_col, lower=True):
                n, fp, kept = [], [], []
                for values in shingle_sets(block, words):
                    n.append(len(values))
                    fp.append(_fingerprint(values))
                    kept.append(values[:k])
                ends = np.r_[0, np.cumsum([len(x) for x in kept])].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(kept)))
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array(n, pa.int64()), pa.array(fp, pa.binary()), lists], ["id", "n", "fp", "sketch"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(sketch, f"id {kind}, n long, fp binary, sketch array<long>")


def full_sets(docs: DataFrame, nodes: DataFrame, words: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set): the whole set, as sorted 64-bit hashes, of each row whose id is one of ``nodes`` (node).

    Tasks leave out what a bit table of the nodes rules out, so that texts are not shuffled;
    too many nodes for the largest table are joined instead.
    """
    nodes = nodes.select(F.col("node").alias("id")).distinct()
    count = nodes.count()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(id_col).alias("key"))
    if count > 1 << (MOST - 2):
        docs, wanted = docs.join(nodes, "id", "left_semi"), None
    else:
        wanted = docs.sparkSession.sparkContext.broadcast(bits(nodes.select(F.xxhash64("id")), count))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if wanted is not None:
                batch = batch.filter(pa.array(wanted.value.has(batch.column(2).to_numpy(zero_copy_only=False))))
            for low, high, block in blocks(batch, "text", lower=True):
                yield pa.RecordBatch.from_arrays([batch.column(0)[low:high], pa.array([v.tobytes() for v in shingle_sets(block, words)], pa.binary())], ["id", "set"])

    kind = dict(docs.dtypes)["id"]
    return docs.mapInArrow(sets, f"id {kind}, set binary").join(nodes, "id", "left_semi")


def index(classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """(v, node, n): each class under the values that it must be listed by."""
    values = classes.select("node", "n", F.explode("sketch").alias("v"))
    shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    rare = values.join(shared, "v").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"))
    # needed() has few distinct results: small sets one by one, then one for all larger.
    small = [needed(n, k, threshold) for n in range(int(k / threshold) + 2)]
    need = F.coalesce(F.get(F.lit(small), F.col("n").cast("int")), F.lit(needed(10**9, k, threshold)))
    room = F.least("n", F.lit(k)) - need + 1 - (F.least("n", F.lit(k)) - F.size("vs"))
    listed = rare.select("node", "n", F.explode(F.slice("vs", F.lit(1), F.greatest(room, F.lit(0)).cast("int"))).alias("x"))
    return listed.select(F.col("x.v").alias("v"), "node", "n")


def components(links: DataFrame) -> DataFrame:
    """(node, component): the least node that each node of ``links`` (a, b) reaches.

    Labels go to neighbours, then jump to their label's label, until none changes.  Each
    round is a written table.
    """
    both = keep(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("component"))
    labels = keep(labels, "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("m"))
        step = labels.join(near, "node").select("node", "component", F.least("component", "m").alias("to"))
        jump = labels.select(F.col("node").alias("to"), F.col("component").alias("far"))
        step = keep(step.join(jump, "to", "left").select("node", F.least("to", "far").alias("component"), (F.least("to", "far") < F.col("component")).alias("moved")), "labels")
        labels = step.select("node", "component")
        if step.where("moved").isEmpty():
            return labels


def estimated(pairs: DataFrame, classes: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose union sketch does not rule them out, with the estimate."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    found = pairs.join(side("b"), "b").join(side("a"), "a")
    union = F.slice(F.sort_array(F.array_union("s_a", "s_b")), 1, k)
    found = found.withColumn("union", union).withColumn("both", F.size(F.array_intersect(F.array_intersect("union", "s_a"), "s_b")))
    least = F.when(F.size("union") < k, F.lit(threshold) * F.size("union") - 1e-9).otherwise(needed(10**9, k, threshold))
    return found.where((F.col("both") >= least) & (F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b") - 1e-9)).select("a", "b", (F.col("both") / F.size("union")).alias("estimate"))


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose full sets have at least that Jaccard similarity."""
    percent = round(threshold * 100)
    side = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"set_{x}"))
    found = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "b", "set_a", "set_b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep_rows = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                both = int(np.count_nonzero(y[np.minimum(at, len(y) - 1)] == x)) if len(x) else 0
                keep_rows.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep_rows, pa.bool_()))

    kind = dict(pairs.dtypes)
    return found.mapInArrow(check, f"a {kind['a']}, b {kind['b']}").distinct()


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two of the sets share, as a symmetric matrix."""
    n = len(sets)
    values = np.concatenate(sets)
    member = np.repeat(np.arange(n), [len(x) for x in sets])
    order = np.argsort(values, kind="stable")
    values, member = values[order], member[order]
    begin = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    held = np.diff(np.r_[begin, len(values)])
    out = np.zeros(n * n, np.int64)
    for c in range(2, min(DENSE, n) + 1):
        at = begin[held == c]
        if len(at):
            rows = member[at[:, None] + np.arange(c)]
            for i in range(c):
                for j in range(i + 1, c):
                    out += np.bincount(rows[:, i] * n + rows[:, j], minlength=n * n)
    out = out.reshape(n, n)
    out = out + out.T
    dense = np.flatnonzero(held > DENSE)
    for low in range(0, len(dense), 2048):
        some = dense[low : low + 2048]
        marks = np.zeros((n, len(some)), np.float32)
        for k, v in enumerate(some):
            marks[member[begin[v] : begin[v] + held[v]], k] = 1
        out += (marks @ marks.T).astype(np.int64)
    return out


def in_blocks(groups: DataFrame) -> DataFrame:
    """(leader, p, q, node, component, n, sketch): members of groups that hold several components, once for each two blocks.

    ``groups`` has (leader, node, component, n, sketch).  A group's members are dealt into
    blocks by a hash of the node; block p meets each block q, itself included.
    """
    sizes = groups.groupBy("leader").agg(F.count(F.lit(1)).alias("many"), F.sum("n").alias("values"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    most = F.greatest(F.ceil(F.col("many") / GROUP), F.ceil(F.col("values") / GROUP_VALUES)).cast("int")
    # A leader of many nodes is met in parts.
    sizes = sizes.select("leader", most.alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    members = groups.withColumn("salt", F.pmod(F.xxhash64("node", F.lit(1)), F.lit(SALTS)).cast("int")).join(sizes, ["leader", "salt"])
    members = members.withColumn("p", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.withColumn("q", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return members.select("leader", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), "node", "component", "n", "sketch")


def likely_members(members: DataFrame, k: int, threshold: float) -> DataFrame:
    """(leader, p, q, node, component) of members whose sketch does not rule out a link to a member of another component."""
    most = needed(10**9, k, threshold)

    def look(block: pa.Table) -> pa.Table:
        lists = block.column("sketch").combine_chunks()
        ends = lists.offsets.to_numpy()
        flat = lists.values.to_numpy(zero_copy_only=False)
        both = common_counts([flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)])
        n = block.column("n").to_numpy()
        _, component = np.unique(block.column("component").to_pylist(), return_inverse=True)
        kept = np.minimum(n, k)
        # The union sketch shares no more than the sketches do.
        union = kept[:, None] + kept[None, :] - both
        near = both >= np.where(union < k, threshold * union - 1e-9, most)
        near &= (np.minimum(n[:, None], n[None, :]) >= threshold * np.maximum(n[:, None], n[None, :]) - 1e-9) & (component[:, None] != component[None, :])
        return block.select(["leader", "p", "q", "node", "component"]).filter(pa.array(near.any(axis=1)))

    kind = dict(members.dtypes)
    return members.groupBy("leader", "p", "q").applyInArrow(look, f"leader {kind['leader']}, p int, q int, node {kind['node']}, component {kind['component']}")


def joining_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different components of a block; ``members`` has (leader, p, q, node, component)."""
    members = members.join(sets.select(F.col("id").alias("node"), "set"), "node")

    def compare(block: pa.Table) -> pa.Table:
        nodes, component = block.column("node").to_pylist(), block.column("component").to_pylist()
        found = [np.frombuffer(x.as_buffer(), np.int64) for x in block.column("set").combine_chunks()]
        both = common_counts(found)
        size = np.array([len(x) for x in found])
        near = np.triu(100 * both >= percent * (size[:, None] + size[None, :] - both), 1) & (both > 0)
        root = {c: c for c in component}

        def top(c):
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        links = []
        for i, j in zip(*np.nonzero(near), strict=True):
            a, b = top(component[i]), top(component[j])
            if a != b:
                root[a] = b
                links.append((nodes[i], nodes[j]))
        kind = block.column("node").type
        return pa.table({"a": pa.array([x[0] for x in links], kind), "b": pa.array([x[1] for x in links], kind)})

    kind = dict(members.dtypes)["node"]
    return members.groupBy("leader", "p", "q").applyInArrow(compare, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.75, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, component_id, kept) of each row of ``docs``.

    Texts are lower-cased (A-Z) and cut at ASCII white space.  ``component_id`` is the least
    id that links of at least that Jaccard similarity reach, the row's own included, and
    ``kept`` marks the row that bears it.  Texts without words (null, empty) link with nothing.
    A row without id links with nothing: its component is null and it is kept.  Rows that
    share an id are one node: what one of them links to, all do; and of fully equal rows all
    are kept or none is.
    """
    ship(docs.sparkSession)
    rows = keep(sketches(docs, words, k, id_col, text_col), "sketches")
    classes = rows.where("n > 0 and id is not null").groupBy("fp").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = keep(classes, "classes")
    listed = keep(index(classes, k, threshold), "lists")
    leaders = listed.groupBy("v").agg(F.min("node").alias("leader"), F.count(F.lit(1)).alias("c")).where("c > 1").select("v", "leader")
    groups = keep(listed.join(leaders, "v").select("leader", "node").distinct(), "groups")
    pairs = groups.where("leader <> node").select(F.col("leader").alias("a"), F.col("node").alias("b"))
    best = keep(estimated(pairs, classes, k, threshold).groupBy("b").agg(F.max_by("a", F.struct("estimate", "a")).alias("a")), "best")
    sets = keep(full_sets(docs, best.select(F.col("a").alias("node")).union(best.select("b")), words, id_col, text_col), "sets")
    links = keep(verified(best, sets, threshold), "links")
    first = components(links)
    groups = groups.join(first, "node", "left").select("leader", "node", F.coalesce("component", "node").alias("component"))
    members = keep(likely_members(in_blocks(groups.join(classes.select("node", "n", "sketch"), "node")), k, threshold), "members")
    more = keep(full_sets(docs, members, words, id_col, text_col), "sets")
    found = components(links.union(joining_links(members, more, round(threshold * 100))))

    whole = classes.select("fp", "node").join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component"))
    out = rows.select("id", "n", "fp").join(whole, "fp", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
