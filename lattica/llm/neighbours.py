"""Near-duplicate vectors by NN-descent: a graph of neighbours that is refined through neighbours of neighbours, and audited."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .storage import discard, join_counted, materialize

THRESHOLD = 0.95
#: Neighbours in a list; a list whose neighbours all link is saturated and doubles, up to MOST. Nodes with that many links are compared in blocks.
LISTS, MOST, BLOCK = 12, 96, 512
#: The first graph: orders of the vectors by the signs of random projections, of which runs of RUN are compared, and the neighbours that a vector keeps of each.
ORDERS, RUN, KEPT, SIGNS = 8, 128, 6, 32
#: Neighbours of one vector that meet in one task at once; more are dealt out.
MEET = 64
ROUNDS = 12
#: Vectors of the audit, the share of their links that has to be found, and how often more orders are added to reach it.
AUDITED, RECALL, ATTEMPTS = 1_000, 0.99, 4


def usable(vector: str = "embedding"):
    """Whether a vector has a direction: not null, no null and non-finite component, not zero."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _units(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length 1, padded with 0 to the longest, and their numbers of components."""
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
    if len(sizes) and (sizes == sizes[0]).all():
        x = flat.reshape(len(sizes), -1)
    else:
        x = np.zeros((len(sizes), int(sizes.max(initial=0))))
        x[np.arange(x.shape[1]) < sizes[:, None]] = flat
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=1e-300)  # no overflow in the squares
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True)), sizes


def _cosines(x: np.ndarray, sizes: np.ndarray, y: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Vectors of different length have no cosine: -2."""
    s = x @ y.T
    if len(sizes) and len(other) and (sizes.min() != other.max() or sizes.max() != other.min()):
        s[sizes[:, None] != other[None, :]] = -2
    return s


def _edges(src: np.ndarray, dst: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64()), pa.array(sim, pa.float64())], ["src", "dst", "sim"])


def _first_graph(nodes: DataFrame, seed: int) -> DataFrame:
    """Candidate edges from runs of vectors in several orders. An order is a sort, so a common direction fills many runs and no task."""
    kind = nodes.schema["embedding"].dataType.simpleString()
    dim = nodes.agg(F.max(F.size("embedding"))).first()[0] or 0
    planes = np.random.default_rng(seed).normal(size=(dim, ORDERS * SIGNS))

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = (1 << np.arange(SIGNS)).astype(np.int64)
        for batch in batches:
            x, _ = _units(batch.column("embedding"))
            signs = (x @ planes[: x.shape[1]] > 0).reshape(len(x), ORDERS, SIGNS) @ weights
            for t in range(ORDERS):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t), pa.int32()), pa.array(signs[:, t]), batch.column("node"), batch.column("embedding")], ["t", "signs", "node", "embedding"])

    def compared(rows: pa.Table) -> pa.RecordBatch:
        t, node = rows["t"].to_numpy(), rows["node"].to_numpy()
        x, sizes = _units(rows["embedding"].combine_chunks())
        s = _cosines(x, sizes, x, sizes)
        s[t[:, None] != t[None, :]] = -2
        np.fill_diagonal(s, -2)
        k = min(KEPT, len(s) - 1)
        best = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else np.zeros((len(s), 0), int)
        sim = np.take_along_axis(s, best, 1).ravel()
        ok = sim > -1.5
        return _edges(np.repeat(node, k)[ok], node[best.ravel()][ok], sim[ok])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            own = pa.Table.from_batches([batch])
            held = own if held is None else pa.concat_tables([held, own])
            while held.num_rows >= 2 * RUN:  # so that no run is short, but where all rows are few
                yield compared(held.slice(0, RUN))
                held = held.slice(RUN)
        if held is not None and held.num_rows:
            yield compared(held)

    ordered = nodes.select("node", "embedding").mapInArrow(signed, f"t int, signs long, node long, embedding {kind}")
    ordered = ordered.repartitionByRange("t", "signs", "node").sortWithinPartitions("t", "signs", "node")
    return ordered.mapInArrow(runs, "src long, dst long, sim double")


def _lists(edges: DataFrame, threshold: float, lists: int, most: int) -> DataFrame:
    """The best edges of each src: `lists` of them, and further links up to `most`. Edges found again stay as they are (new is false)."""
    once = edges.groupBy("src", "dst").agg(F.max("sim").alias("sim"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("sim"), "dst"))
    return once.withColumn("rank", rank).filter((F.col("rank") <= lists) | (F.col("rank") <= most) & (F.col("sim") >= threshold)).drop("rank")


def _refined(nodes: DataFrame, graph: DataFrame, edges: int, threshold: float, lists: int, limit: int, turn: int) -> DataFrame:
    """Candidate edges between vectors that are both neighbours, in either direction, of a third one, at least one of them since the last turn.

    Only what a list can use is emitted: what is better than its worst neighbour, or links while the list may grow.
    """
    kind = nodes.schema["embedding"].dataType.simpleString()
    both = graph.select(F.col("src").alias("centre"), F.col("dst").alias("member"), "new")
    both = both.unionByName(both.select(F.col("member").alias("centre"), F.col("centre").alias("member"), "new"))
    both = both.groupBy("centre", "member").agg(F.max("new").alias("new"))
    counts = both.groupBy("centre").agg(F.count("*").alias("copies"), F.count("*").alias("degree"), F.max("new").alias("active")).filter("active").drop("active")
    met = join_counted(both, counts, ["centre"], 2 * edges)
    met = met.withColumn("part", F.pmod(F.xxhash64("member", F.lit(turn)), F.ceil(F.col("degree") / MEET)))
    # what a list takes: all while it is short; then what is better than its last; any link while it is saturated and may grow
    linked = F.count_if(F.col("sim") >= threshold)
    below = F.when(linked >= limit, float("inf")).when(linked >= lists, float(np.nextafter(threshold, 0))).when(F.count("*") >= lists, F.min("sim")).otherwise(-1.5)
    worst = graph.groupBy("src").agg(below.alias("worst"), (linked >= lists).alias("saturated")).withColumnRenamed("src", "member")
    known = nodes.select(F.col("node").alias("member"), "embedding").join(worst, "member", "left")
    rows = met.join(known, "member").select("centre", "part", F.struct("member", "new", F.coalesce("worst", F.lit(-1.5)).alias("worst"), F.coalesce("saturated", F.lit(False)).alias("saturated"), "embedding").alias("x"))
    groups = rows.groupBy("centre", "part").agg(F.collect_list("x").alias("x")).select("x")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(turn)
        for batch in batches:
            ends = np.cumsum(batch.column("x").value_lengths().to_numpy(zero_copy_only=False))
            flat = batch.column("x").flatten()
            member, new, worst, full = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            x, sizes = _units(flat.field(4))
            found = []
            for a, b in zip([0, *ends[:-1]], ends):
                if not new[a:b].any():
                    continue
                s = _cosines(x[a:b], sizes[a:b], x[a:b], sizes[a:b])
                take = (s > worst[a:b, None]) & (new[a:b, None] | new[None, a:b])
                np.fill_diagonal(take, False)
                # a list that grows takes some links of each meeting; the next meetings bring others
                many = full[a:b] & (take.sum(1) > 2 * lists)
                for i in np.flatnonzero(many):
                    at = np.flatnonzero(take[i])
                    take[i, rng.permutation(at)[2 * lists :]] = False
                i, j = np.nonzero(take)
                found.append((member[a:b][i], member[a:b][j], s[i, j]))
            if found:
                yield _edges(*(np.concatenate(c) for c in zip(*found)))

    return groups.mapInArrow(joined, "src long, dst long, sim double")


def _counted_in_blocks(dense: DataFrame, threshold: float) -> DataFrame:
    """The links within a component of which one end at least has a full list (is dense), exactly: node, links.

    dense: node, embedding, copies, component, dense. Each component is dealt into blocks, each pair of blocks is one
    group, and only counts leave it.
    """
    sizes = dense.groupBy("component").agg(F.count("*").alias("copies"), F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    dealt = join_counted(dense.withColumnRenamed("copies", "times"), sizes, ["component"], dense.count())
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = dealt.groupBy("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")).agg(F.collect_list(F.struct("node", "times", "block", "dense", "embedding")).alias("x"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high, held in zip(batch.column("low").to_pylist(), batch.column("high").to_pylist(), batch.column("x")):
                node, times, block, full = (held.values.field(k).to_numpy(zero_copy_only=False) for k in range(4))
                x, sizes = _units(held.values.field(4))
                a, b = block == low, block == high
                linked = (_cosines(x[a], sizes[a], x[b], sizes[b]) >= threshold) & (full[a][:, None] | full[b][None, :])
                if low == high:
                    np.fill_diagonal(linked, False)
                    out = [(node[a], linked @ times[b])]
                else:
                    out = [(node[a], linked @ times[b]), (node[b], times[a] @ linked)]
                for n, links in out:
                    yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(links, pa.int64())], ["node", "links"])

    return pairs.select("low", "high", "x").mapInArrow(counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def _linked(nodes: DataFrame, graph: DataFrame, threshold: float, most: int) -> DataFrame:
    """Per node with links: node, links (to rows of other nodes), component (smallest node)."""
    near = graph.filter(F.col("sim") >= threshold).select("src", "dst")
    edges = materialize(near.unionByName(near.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(), "neighbour-links")
    parts = materialize(components(edges.filter("src < dst").select(F.col("src").alias("a"), F.col("dst").alias("b")), "neighbours"), "neighbour-parts")
    full = near.groupBy("src").count().filter(F.col("count") >= most).select(F.col("src").alias("node"), F.lit(True).alias("dense"))
    full = materialize(full, "neighbour-dense")
    ends = edges
    for end in ("src", "dst"):
        ends = ends.join(full.select(F.col("node").alias(end), F.col("dense").alias(f"dense_{end}")), end, "left")
    # links of full lists are counted in blocks, with all that a full list or its reverse names; the others are in the lists
    sparse = ends.filter("dense_src is null and dense_dst is null")
    links = sparse.join(nodes.select(F.col("node").alias("dst"), "copies"), "dst").groupBy(F.col("src").alias("node")).agg(F.sum("copies").alias("links"))
    near_full = ends.filter("dense_dst").groupBy(F.col("src").alias("node")).agg(F.coalesce(F.max("dense_src"), F.lit(False)).alias("dense"))
    dense = materialize(nodes.select("node", "embedding", "copies").join(near_full, "node").join(parts, "node"), "neighbour-blocks")
    links = links.unionByName(_counted_in_blocks(dense, threshold)).groupBy("node").agg(F.sum("links").alias("links"))
    out = materialize(parts.join(links, "node"), "neighbour-counts")
    for df in (edges, parts, full, dense):
        discard(df)
    return out


def _audit(nodes: DataFrame, threshold: float, n: int) -> DataFrame:
    """The true number of links of up to n vectors, chosen by a hash of their node, by comparing them with all: node, true_links."""
    chosen = nodes.select("node", "embedding").orderBy(F.xxhash64("node"), "node").limit(n).toArrow()
    ids = chosen["node"].to_numpy()
    y, lengths = _units(chosen["embedding"].combine_chunks()) if len(ids) else (np.zeros((0, 0)), np.zeros(0, np.int64))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(ids), np.int64)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                x, sizes = _units(part.column("embedding"))
                wide = max(x.shape[1], y.shape[1])
                s = _cosines(np.pad(x, ((0, 0), (0, wide - x.shape[1]))), sizes, np.pad(y, ((0, 0), (0, wide - y.shape[1]))), lengths) >= threshold
                s &= part.column("node").to_numpy()[:, None] != ids[None, :]
                total += part.column("copies").to_numpy() @ s
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["node", "true_links"])

    return nodes.select("node", "embedding", "copies").mapInArrow(counted, "node long, true_links long").groupBy("node").agg(F.sum("true_links").alias("true_links"))


def _recall(truth: DataFrame, linked: DataFrame) -> float:
    """Over the audited vectors: the lower of the share of all their links, and the mean of each one's share."""
    found = F.least(F.coalesce("links", F.lit(0)), F.col("true_links"))
    r = truth.filter("true_links > 0").join(linked, "node", "left").agg(F.sum(found) / F.sum("true_links"), F.avg(found / F.col("true_links"))).first()
    return min(1.0 if x is None else float(x) for x in r)


def _sizes(graph: DataFrame, threshold: float, limit: int) -> tuple[int, int, int]:
    """Links, lists of `limit` links or more, and edges."""
    lists = graph.groupBy("src").agg(F.count_if(F.col("sim") >= threshold).alias("links"), F.count("*").alias("edges"))
    r = lists.agg(F.sum("links"), F.count_if(F.col("links") >= limit), F.sum("edges")).first()
    return tuple(x or 0 for x in r)


def descend(nodes: DataFrame, threshold: float = THRESHOLD, lists: int = LISTS, most: int = MOST, rounds: int = ROUNDS, seed: int = 17, graph: DataFrame | None = None) -> DataFrame:
    """The neighbour graph of nodes (node, embedding): src, dst, sim, new. Ends when a turn adds hardly any link, and no saturated list may grow.

    The best `lists` neighbours of each node, and for one whose list is saturated its links, in lists that double each turn up to `most`.
    """
    found = _first_graph(nodes, seed).withColumn("new", F.lit(True))
    graph_before, limit = graph, lists
    graph = materialize(_lists(found if graph is None else found.unionByName(graph.withColumn("new", F.lit(False))), threshold, lists, limit if graph is None else most), "neighbour-graph")
    links, _, edges = _sizes(graph, threshold, limit)
    for turn in range(rounds):
        limit = min(most, 2 * limit)
        more = _refined(nodes, graph, edges, threshold, lists, limit, seed + turn).withColumn("new", F.lit(True))
        new = materialize(_lists(graph.withColumn("new", F.lit(False)).unionByName(more), threshold, lists, limit), "neighbour-graph")
        if graph is not graph_before:
            discard(graph)
        graph = new
        before = links
        links, saturated, edges = _sizes(graph, threshold, limit)
        if links - before <= links // 1_000 and (limit >= most or not saturated):
            break
    return graph


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, lists: int = LISTS, most: int = MOST, audited: int = AUDITED, recall: float = RECALL) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): vec_id, n_links, component_id, kept.

    Two rows link where the cosine of their vectors, in double precision, is `threshold` or more. Equal vectors are one
    node and link with one another. Null and zero vectors, those with a null or non-finite component, and vectors of
    different lengths link with nothing. component_id is the smallest vec_id reachable (null ids don't count; a
    component of null ids alone has none), kept whether it is the row's own. Rows of one id are rows of their own. Each
    link is verified; that all are found is likely, not certain: up to `audited` nodes are compared with all others, and
    while less than `recall` of their links is found, the graph starts again from more orders of the vectors, up to
    ATTEMPTS times (then a warning says what was reached). Other columns don't take part.
    """
    rows = vectors.select("vec_id", "embedding", usable().alias("usable"))
    good = rows.filter("usable").drop("usable")
    nodes = good.groupBy("embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "neighbour-nodes")
    truth = materialize(_audit(nodes, threshold, audited), "neighbour-audit")
    graph, linked = None, None
    for attempt in range(ATTEMPTS):
        before, graph = graph, descend(nodes, threshold, lists, most, seed=17 + 100 * attempt, graph=graph)
        for df in (before, linked):
            if df is not None:
                discard(df)
        linked = _linked(nodes, graph, threshold, most)
        reached = _recall(truth, linked)
        if reached >= recall:
            break
    else:
        warnings.warn(f"the audit found {reached:.3f} of the links", stacklevel=2)
    known = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = known.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("copies"))
    known = join_counted(known.withColumnRenamed("copies", "times"), least, ["component"], nodes.count())
    known = known.select("embedding", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "component_id", F.col("times").alias("copies"))
    out = join_counted(good, known, ["embedding"], good.count()).select("vec_id", "n_links", "component_id")
    rest = rows.filter(~F.col("usable")).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
