"""Histogram gradient boosting over tables: rows are binned once, tasks add up histograms, and trees grow leaf by leaf.

Many models (folds x seeds) grow in the same passes: a pass reads the binned rows once, whatever the number of models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import positive_weight, zero_if_missing
from ..sources.tables import scratch
from .models import Forest, Tree

#: Rows of a chunk, the unit that tasks work on; trees after which the margins are written anew.
CHUNK, WRITE_EVERY = 8_192, 10
#: Most distinct values of a categorical feature.
MOST_CATEGORIES = 4_096


@dataclass(frozen=True)
class Settings:
    """How trees grow.

    A split needs `least_rows` rows on either side. Leaves are -sum(g) / (sum(h) + l2), times `rate`; g = w (margin - y), cut at
    +-huber before it is weighted if that is given; h = w. `row_share` of the rows, by a hash of their keys, and `column_share` of the features
    are drawn anew for each tree. With `patience`, a model ends when its score on the validation rows has not risen for so
    many trees, and keeps those up to the best.
    """

    rounds: int = 20
    leaves: int = 15
    rate: float = 0.1
    l2: float = 0.0
    least_rows: int = 20
    bins: int = 255
    huber: float | None = None
    row_share: float = 1.0
    column_share: float = 1.0
    patience: int | None = None
    smooth: float = 10.0


@dataclass(frozen=True)
class Job:
    """One model: its name, its seed, closed ranges of time to train on and to validate on, and the features it may use (None: all)."""

    name: tuple
    seed: int = 0
    train: tuple[int, int] | None = None
    valid: tuple[int, int] | None = None
    features: tuple[int, ...] | None = None


@dataclass
class _Node:
    """A node of a tree that grows: g, h, n of its rows; its best split once a pass has found it; its children once they are wanted."""

    g: float = 0.0
    h: float = 0.0
    n: float = 0.0
    split: tuple | None = None
    gain: float = -np.inf
    known: bool = False
    left: int = -1
    right: int = -1


@dataclass
class _Binned:
    """A tree over bins, as tasks walk it: which bins of a feature go left, per node; children; values (0 inside)."""

    feature: np.ndarray
    goes_left: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def walk(self, bins: np.ndarray) -> np.ndarray:
        node = np.zeros(bins.shape[1], np.int64)
        rows = np.flatnonzero(np.full(len(node), self.left[0] >= 0))
        while len(rows):
            at = node[rows]
            node[rows] = np.where(self.goes_left[at, bins[self.feature[at], rows]], self.left[at], self.right[at])
            rows = rows[self.left[node[rows]] >= 0]
        return node


@dataclass
class _State:
    """A job while it grows."""

    job: Job
    start: float = 0.0
    nodes: list[_Node] = field(default_factory=list)
    leaves: list[int] = field(default_factory=list)
    binned: list[_Binned] = field(default_factory=list)
    trees: list[Tree] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    done: bool = False
    could_split: bool = False


def fit_edges(df: DataFrame, features: Sequence[str], bins: int = 255) -> dict[str, list[float]]:
    """Upper ends of all bins but the last: values of the table at even ranks (one pass for all columns, by mergeable summaries). Missing values count as 0."""
    at = F.array(*[F.lit(k / bins) for k in range(1, bins)])
    row = df.agg(*[F.percentile_approx(zero_if_missing(F.col(f)), at, F.lit(10_000)).alias(f"_{k}") for k, f in enumerate(features)], *[F.max(zero_if_missing(F.col(f))).alias(f"_max{k}") for k, f in enumerate(features)]).first()
    return {f: sorted({float(v) for v in row[f"_{k}"] or () if v < row[f"_max{k}"]}) for k, f in enumerate(features)}


def fit_categories(df: DataFrame, feature: str) -> list[float]:
    """The values of a categorical feature, in order. They have to be whole numbers of 0 or more, and few."""
    found = sorted(r[0] for r in df.select(zero_if_missing(F.col(feature))).distinct().limit(MOST_CATEGORIES + 1).collect())
    if len(found) > MOST_CATEGORIES or any(v < 0 or v != int(v) for v in found):
        raise ValueError(f"{feature} has too many categories, or some that aren't whole numbers of 0 or more")
    return [float(v) for v in found]


def _bin(x: np.ndarray, edges: np.ndarray, categorical: bool) -> np.ndarray:
    """Numbers: how many edges are below x. Categories: their place, and one place more for others."""
    at = np.searchsorted(edges, x, "left")
    if categorical:
        known = (at < len(edges)) & (edges[np.minimum(at, len(edges) - 1)] == x) if len(edges) else np.zeros(len(x), bool)
        at = np.where(known, at, len(edges))
    return at


def chunked(df: DataFrame, features: Sequence[str], edges: dict[str, list[float]], categorical: Sequence[str], target: str, weight: str | None, keys: Sequence[str]) -> DataFrame:
    """Rows of chunks: bins (one line of 16-bit numbers per feature), target, weight, time (the first key) and a hash of the keys. Written once, read by each pass."""
    names = list(features)
    all_edges = [np.array(edges[f], float) for f in names]
    kinds = [f in set(categorical) for f in names]
    w = positive_weight(F.col(weight)) if weight else F.lit(1.0)
    own = df.select(*[zero_if_missing(F.col(f)).cast("double").alias(f"_x{k}") for k, f in enumerate(names)], zero_if_missing(F.col(target)).cast("double").alias("_y"), w.cast("double").alias("_w"), F.col(keys[0]).cast("long").alias("_t"), F.xxhash64(*keys).alias("_id"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                bins = np.stack([_bin(part.column(k).to_numpy(zero_copy_only=False), e, c) for k, (e, c) in enumerate(zip(all_edges, kinds))]).astype("<u2")
                rest = [part.column(c).to_numpy(zero_copy_only=False) for c in ("_y", "_w", "_t", "_id")]
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (bins, *rest)], ["bins", "y", "w", "t", "id"])

    return _written(own.mapInArrow(packed, "bins binary, y binary, w binary, t binary, id binary").withColumn("margins", F.lit(None).cast("binary")), "boost-rows")


def _written(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _dropped(df: DataFrame) -> None:
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass
class _Chunk:
    bins: np.ndarray
    y: np.ndarray
    w: np.ndarray
    t: np.ndarray
    id: np.ndarray
    margins: np.ndarray | None

    def inside(self, span: tuple[int, int] | None, none: bool) -> np.ndarray:
        return np.full(len(self.t), none) if span is None else (self.t >= span[0]) & (self.t <= span[1])


def _chunks(batches: Iterator[pa.RecordBatch], features: int) -> Iterator[_Chunk]:
    for batch in batches:
        for k in range(batch.num_rows):
            raw = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
            margins = None if raw["margins"] is None else np.frombuffer(raw["margins"]).reshape(-1, len(raw["y"]) // 8)
            yield _Chunk(np.frombuffer(raw["bins"], "<u2").reshape(features, -1), np.frombuffer(raw["y"]), np.frombuffer(raw["w"]), np.frombuffer(raw["t"], np.int64), np.frombuffer(raw["id"], np.uint64), margins)


def _margin(chunk: _Chunk, at: int, start: float, recent: Sequence[_Binned]) -> np.ndarray:
    out = np.full(len(chunk.y), start) if chunk.margins is None else chunk.margins[at].copy()
    for tree in recent:
        out += tree.value[tree.walk(chunk.bins)]
    return out


def _drawn(ids: np.ndarray, seed: int, turn: int, share: float) -> np.ndarray:
    """Which rows a tree takes: by a hash of their keys, the seed and the number of the tree."""
    if share >= 1:
        return np.ones(len(ids), bool)
    x = ids ^ np.uint64((seed * 1_000_003 + turn) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * 2**64))


def best_split(hist: np.ndarray, categorical: bool, settings: Settings) -> tuple[float, np.ndarray | int, np.ndarray]:
    """The best split of one feature's histogram (g, h, n per bin): its gain, the last bin that goes left (or which bins do), and sums of the left.

    Of equal gains the first counts. Categories are put in order of g / (h + smooth) first. Without a valid split the gain is -inf.
    """
    order = np.arange(hist.shape[1])
    if categorical:
        filled = order[hist[2] > 0]
        order = filled[np.argsort(hist[0, filled] / (hist[1, filled] + settings.smooth), kind="stable")]
    total = hist.sum(axis=1)
    left = np.cumsum(hist[:, order], axis=1)[:, :-1]
    right = total[:, None] - left
    ok = (left[2] >= settings.least_rows) & (right[2] >= settings.least_rows) & (left[1] > 0) & (right[1] > 0)
    if not ok.any():
        return -np.inf, 0, total * 0
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left[0] ** 2 / (left[1] + settings.l2) + right[0] ** 2 / (right[1] + settings.l2) - total[0] ** 2 / (total[1] + settings.l2)
    gain = np.where(ok, gain, -np.inf)
    at = int(np.argmax(gain))
    mask = np.zeros(hist.shape[1], bool)
    mask[order[: at + 1]] = True
    return float(gain[at]), mask if categorical else at, left[:, at]


def _walkable(nodes: Sequence[_Node], width: int, values: Sequence[float] | None = None) -> _Binned:
    """The known part of a tree for the tasks."""
    goes = np.zeros((len(nodes), width), bool)
    for k, n in enumerate(nodes):
        if n.left >= 0:
            goes[k, : len(n.split[1])] = n.split[1]
    return _Binned(np.array([n.split[0] if n.left >= 0 else 0 for n in nodes]), goes, np.array([n.left for n in nodes]), np.array([n.right for n in nodes]), np.array(values if values is not None else np.zeros(len(nodes))))


def _pass(chunks: DataFrame, states: list[_State], wanted: dict[int, list[int]], recent: dict[int, list[_Binned]], turn: int, settings: Settings, widths: list[int], kinds: list[bool], score: bool) -> tuple[dict, dict]:
    """One reading of all chunks: the best split of each wanted node of each job, and each job's error and energy on its validation rows.

    Histograms of a task meet per (job, node, feature) in the order of the tasks, so reruns give the same bits; each is searched where it is
    added up, and one row per node reaches the driver.
    """
    width = max(widths)
    plans = []
    for k, nodes in wanted.items():
        job = states[k].job
        features = list(range(len(widths))) if job.features is None else list(job.features)
        if settings.column_share < 1:
            rng = np.random.default_rng([job.seed, turn])
            features = sorted(rng.choice(features, max(1, round(settings.column_share * len(features))), replace=False).tolist())
        plans.append((k, job, states[k].start, recent[k], _walkable(states[k].nodes, width) if nodes else None, nodes, features))

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        scores = {k: np.zeros(2) for k, *_ in plans}
        for chunk in _chunks(batches, len(widths)):
            for k, job, start, trees, tree, nodes, features in plans:
                margin = _margin(chunk, k, start, trees)
                if score and job.valid is not None:
                    v = chunk.inside(job.valid, False)
                    scores[k] += [(chunk.w[v] * (chunk.y[v] - margin[v]) ** 2).sum(), (chunk.w[v] * chunk.y[v] ** 2).sum()]
                if not nodes:
                    continue
                place = np.full(len(tree.left), -1)
                place[nodes] = np.arange(len(nodes))
                at = place[tree.walk(chunk.bins)]
                rows = np.flatnonzero((at >= 0) & chunk.inside(job.train, True) & _drawn(chunk.id, job.seed, turn, settings.row_share))
                g = margin[rows] - chunk.y[rows]
                if settings.huber is not None:
                    g = np.clip(g, -settings.huber, settings.huber)
                w = chunk.w[rows]
                hist = sums.setdefault(k, np.zeros((len(nodes), len(features), 3, width)))
                for j, f in enumerate(features):
                    key = at[rows] * width + chunk.bins[f, rows]
                    for i, v in enumerate((g * w, w, None)):
                        hist[:, j, i] += np.bincount(key, v, len(nodes) * width).reshape(len(nodes), width)
        part = TaskContext.get().partitionId()
        for k, job, _, _, _, nodes, features in plans:
            out = [(n, f, sums[k][i, j, :, : widths[f]].tobytes()) for i, n in enumerate(nodes) for j, f in enumerate(features)] if k in sums else []
            out += [(-1, -1, scores[k].tobytes())] if score else []
            if out:
                node, feature, values = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(out), pa.int32()), pa.array(node, pa.int32()), pa.array(feature, pa.int32()), pa.array([part] * len(out), pa.int32()), pa.array(values, pa.binary())], ["job", "node", "feature", "part", "sums"])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None

        def found():
            job, node, feature = key
            if node < 0:
                row = (job, node, feature, 0.0, b"", *total, 0.0, 0.0, 0.0, 0.0)
            else:
                hist = total.reshape(3, -1)
                gain, split, left = best_split(hist, kinds[feature], settings)
                mask = split if kinds[feature] else np.arange(hist.shape[1]) <= split
                row = (job, node, feature, gain, np.asarray(mask, np.uint8).tobytes(), *left, *hist.sum(axis=1))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.int32()] * 3 + [pa.float64(), pa.binary()] + [pa.float64()] * 6)], names)

        names = ["job", "node", "feature", "gain", "mask", "gl", "hl", "nl", "g", "h", "n"]
        for batch in batches:
            for job, node, feature, values in zip(*(batch.column(c).to_pylist() for c in ("job", "node", "feature", "sums"))):
                if key != (job, node, feature):
                    if key is not None:
                        yield found()
                    key, total = (job, node, feature), 0
                total = total + np.frombuffer(values)
        if key is not None:
            yield found()

    parts = chunks.mapInArrow(added, "job int, node int, feature int, part int, sums binary").repartition("job", "node", "feature").sortWithinPartitions("job", "node", "feature", "part")
    splits = parts.mapInArrow(searched, "job int, node int, feature int, gain double, mask binary, gl double, hl double, nl double, g double, h double, n double")
    best = splits.groupBy("job", "node").agg(F.max_by(F.struct("feature", "gain", "mask", "gl", "hl", "nl", "g", "h", "n"), F.struct("gain", -F.col("feature"))).alias("x")).collect()
    return {(r["job"], r["node"]): r["x"] for r in best if r["node"] >= 0}, {r["job"]: (r["x"]["gl"], r["x"]["hl"]) for r in best if r["node"] < 0}


def _advance(state: _State, settings: Settings) -> list[int]:
    """Split leaves, best first, as far as all that compete are known. Returns the nodes to look at next: none if the tree is complete.

    Nodes are asked for ahead: besides leaves that aren't known, the children of those that may be split later. So a tree takes
    about as many passes as it is deep, and is still the one that grows leaf by leaf.
    """
    nodes = state.nodes

    def children(k: int) -> list[int]:
        if nodes[k].left < 0:
            feature, mask, left = nodes[k].split
            nodes[k].left, nodes[k].right = len(nodes), len(nodes) + 1
            nodes.append(_Node(*left))
            nodes.append(_Node(nodes[k].g - left[0], nodes[k].h - left[1], nodes[k].n - left[2]))
            for c in (nodes[k].left, nodes[k].right):
                nodes[c].known = nodes[c].n < 2 * settings.least_rows
        return [nodes[k].left, nodes[k].right]

    while len(state.leaves) < settings.leaves and all(nodes[k].known for k in state.leaves):
        best = max(state.leaves, key=lambda k: (nodes[k].gain, -k))
        if nodes[best].gain <= 0:
            return []
        state.leaves.remove(best)
        state.leaves += children(best)
    left = settings.leaves - len(state.leaves)
    if left <= 0:
        return []
    ahead = sorted((k for k in state.leaves if nodes[k].known and nodes[k].gain > 0), key=lambda k: -nodes[k].gain)[:left]
    asked = [k for k in state.leaves if not nodes[k].known]
    return sorted({*asked, *(c for k in ahead if left > 1 for c in children(k) if not nodes[c].known)})


def _finish(state: _State, settings: Settings, edges: list[np.ndarray], kinds: list[bool], width: int) -> None:
    """Keep the tree of the chosen leaves, in bins for the next passes and in values for the result; the first one holds the start."""
    chosen, splits, leaves = set(state.leaves), [], []

    def number(k: int) -> int:
        if k in chosen:
            leaves.append(k)
            return -len(leaves)
        splits.append([k, 0, 0])
        own = splits[-1]
        at = len(splits) - 1
        own[1], own[2] = number(state.nodes[k].left), number(state.nodes[k].right)
        return at

    number(0)
    value = {k: -settings.rate * state.nodes[k].g / (state.nodes[k].h + settings.l2) if state.nodes[k].h > 0 and len(chosen) > 1 else 0.0 for k in chosen}
    kept = [_Node(n.g, n.h, n.n, n.split, n.gain, n.known, *((-1, -1) if k in chosen else (n.left, n.right))) for k, n in enumerate(state.nodes)]
    state.binned.append(_walkable(kept, width, [value.get(k, 0.0) for k in range(len(kept))]))
    categories, threshold = {}, []
    for at, (k, _, _) in enumerate(splits):
        feature, mask, _ = state.nodes[k].split
        if kinds[feature]:
            categories[at] = frozenset(int(edges[feature][b]) for b in np.flatnonzero(mask[: len(edges[feature])]))
            threshold.append(0.0)
        else:
            threshold.append(float(edges[feature][int(mask.sum()) - 1]))
    first = state.start if not state.trees else 0.0
    state.trees.append(Tree(np.array([state.nodes[k].split[0] for k, _, _ in splits], np.int64), np.array(threshold), np.array([s[1] for s in splits], np.int64), np.array([s[2] for s in splits], np.int64), np.array([value[k] + first for k in leaves]), categories))


def boost(df: DataFrame, features: Sequence[str], jobs: Sequence[Job], settings: Settings = Settings(), target: str = "target", weight: str | None = "weight", categorical: Sequence[str] = (), edges: dict[str, list[float]] | None = None, keys: Sequence[str] = ("time_id", "asset_id")) -> dict[tuple, Forest]:
    """Forests by the names of their jobs. Missing features and targets are 0, missing and negative weights too.

    edges: upper ends of the bins of numeric features, fitted on df where not given. Jobs without rows to train on are an error. Chunks and margins are
    Parquet under spark.checkpoint.dir, deleted at the end; a lost executor costs the tasks it ran.
    """
    if len({j.name for j in jobs}) < len(jobs):
        raise ValueError("two jobs have one name")
    numeric = [f for f in features if f not in set(categorical) and f not in (edges or {})]
    found = dict(edges or {}) | (fit_edges(df, numeric, settings.bins) if numeric else {}) | {f: fit_categories(df, f) for f in categorical}
    kinds = [f in set(categorical) for f in features]
    all_edges = [np.array(found[f], float) for f in features]
    widths = [len(e) + 1 for e in all_edges]
    chunks = chunked(df, features, found, categorical, target, weight, keys)
    states = [_State(j) for j in jobs]
    for state, (w, y) in zip(states, _starts(chunks, jobs, len(features))):
        if w <= 0:
            raise ValueError(f"job {state.job.name} has no rows to train on")
        state.start = y / w
    done_before = 0  # trees that the margins hold
    for turn in range(settings.rounds + 1):
        live = [k for k, s in enumerate(states) if not s.done]
        last = turn == settings.rounds
        watched = settings.patience is not None and turn > 0
        if not live or last and not watched:
            break
        for k in live:
            states[k].nodes, states[k].leaves = [_Node()], [0]
        wanted = {k: [] if last else [0] for k in live}
        recent = {k: states[k].binned[done_before:] for k in live}
        first = True
        while wanted:
            splits, scores = _pass(chunks, states, wanted, recent, turn, settings, widths, kinds, first and watched)
            for k in list(wanted) if first and watched else ():
                if _tired(states[k], scores.get(k), settings):
                    states[k].done = True
                    del wanted[k]
            first = False
            for k, asked in list(wanted.items()):
                for n in asked:
                    node, x = states[k].nodes[n], splits.get((k, n))
                    node.known = True
                    if x is not None:
                        if n == 0:
                            node.g, node.h, node.n = x["g"], x["h"], x["n"]
                        node.gain = x["gain"]
                        node.split = (x["feature"], np.frombuffer(x["mask"], np.uint8).astype(bool), (x["gl"], x["hl"], x["nl"]))
                wanted[k] = [] if last else _advance(states[k], settings)
                if not wanted[k]:
                    del wanted[k]
        if last:
            break
        for k in live:
            if not states[k].done:
                states[k].could_split |= bool(states[k].nodes[0].gain > -np.inf)
                _finish(states[k], settings, all_edges, kinds, max(widths))
        if (turn + 1) % WRITE_EVERY == 0 and turn + 1 < settings.rounds:
            written = _with_margins(chunks, states, done_before, len(features))
            _dropped(chunks)
            chunks, done_before = written, turn + 1
    _dropped(chunks)
    return {s.job.name: Forest(s.trees[: 1 + int(np.argmax(s.scores))] if settings.patience is not None and s.scores else s.trees, could_split=s.could_split) for s in states}


def _tired(state: _State, sums: tuple[float, float] | None, settings: Settings) -> bool:
    """Note the score after the last tree; whether none of the last `patience` ones was better than the best before."""
    if sums is None or sums[1] <= 0:
        return False
    state.scores.append(1 - sums[0] / sums[1])
    return len(state.scores) - 1 - int(np.argmax(state.scores)) >= settings.patience


def _starts(chunks: DataFrame, jobs: Sequence[Job], features: int) -> list[tuple[float, float]]:
    """Sums of weights and of weighted targets of each job's training rows."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(jobs), 2))
        for c in _chunks(batches, features):
            for k, job in enumerate(jobs):
                rows = c.inside(job.train, True)
                sums[k] += [c.w[rows].sum(), (c.w[rows] * c.y[rows]).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(jobs))), pa.array(sums[:, 0]), pa.array(sums[:, 1])], ["job", "w", "y"])

    found = {r["job"]: (r["w"], r["y"]) for r in chunks.mapInArrow(added, "job long, w double, y double").groupBy("job").agg(F.sum("w").alias("w"), F.sum("y").alias("y")).collect()}
    return [found.get(k, (0.0, 0.0)) for k in range(len(jobs))]


def _with_margins(chunks: DataFrame, states: list[_State], done_before: int, features: int) -> DataFrame:
    """The chunks with the margins of all jobs after all trees so far."""
    plans = [(s.start, s.binned[done_before:]) for s in states]
    names = ["bins", "y", "w", "t", "id"]

    def advanced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = batch.slice(k, 1)
                chunk = next(_chunks(iter([part]), features))
                margins = np.stack([_margin(chunk, j, start, trees) for j, (start, trees) in enumerate(plans)])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array([margins.tobytes()], pa.binary())], [*names, "margins"])

    return _written(chunks.mapInArrow(advanced, chunks.schema), "boost-rows")


def seed_forests(forests: dict[tuple, Forest]) -> Forest:
    """The mean over models of different seeds, as one forest: all their trees, with leaves divided by their number."""
    n = len(forests)
    return Forest([Tree(t.feature, t.threshold, t.left, t.right, t.leaves / n, t.categories) for f in forests.values() for t in f.trees[: f.rounds]], could_split=any(f.could_split for f in forests.values()))


def forest_text(forest: Forest) -> str:
    """A forest in the text format that models.parse_forest() reads; numbers come back as they are."""
    sections = []
    for k, t in enumerate(forest.trees[: forest.rounds]):
        lines = [f"Tree={k}", f"num_leaves={len(t.leaves)}"]
        if len(t.feature):
            borders, words, threshold, decision = [0], [], [], []
            for at in range(len(t.feature)):
                if at in t.categories:
                    own = [0] * (max(t.categories[at], default=0) // 32 + 1)
                    for c in t.categories[at]:
                        own[c // 32] |= 1 << c % 32
                    threshold.append(str(len(borders) - 1))
                    decision.append("1")
                    words += own
                    borders.append(len(words))
                else:
                    threshold.append(repr(float(t.threshold[at])))
                    decision.append("2")
            lines += [f"split_feature={' '.join(map(str, t.feature.tolist()))}", f"threshold={' '.join(threshold)}", f"decision_type={' '.join(decision)}", f"left_child={' '.join(map(str, t.left.tolist()))}", f"right_child={' '.join(map(str, t.right.tolist()))}"]
            if t.categories:
                lines += [f"cat_boundaries={' '.join(map(str, borders))}", f"cat_threshold={' '.join(map(str, words))}"]
        lines.append(f"leaf_value={' '.join(repr(float(v)) for v in t.leaves)}")
        sections.append("\n".join(lines))
    return "\n\n".join(sections) + "\n"
