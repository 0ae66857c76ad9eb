"""Second-order gradient boosting on gradient histograms.

Rows are binned once (at most 64 cuts a feature, bin 0 for missing values) and
written in blocks of rows, features with few bins sharing a byte, and of a one-hot
group only the hot slot's number.  A pass is one scan of
the blocks: every task adds up, for each open node of each
model's current tree, the first and second derivatives of the log loss per
feature bin, the partial histograms are added and searched for the best cut per
node, and the driver receives one candidate per node and feature block.  A tree
of depth d takes d passes, for all its nodes at once, and all models of a call
share the passes, on whichever subsets of the rows each is fitted; on large tables
two groups of subsets have passes beside each other.

Between passes only the models are carried and, on large tables, the margins of
finished trees: now and then they are written beside the rows, so that a pass walks
a few trees and not all, and a cut node's histograms are kept by the driver, so that
only the lighter child's rows are counted and the other's sums are the rest.  Margins are
read back as they were added up, sums are integers, and a lost executor costs the
tasks it ran.  Derivatives are added as integers: given the cuts, which are
approximate quantiles, the trees do not depend on the partitioning.

Three learners differ in how a tree grows:
``level``      every node of a level is cut where that pays;
``leaf``       of all cuts the best are kept, one at a time, up to ``leaves``;
``symmetric``  all nodes of a level share the one cut that pays most in sum.
Cuts try missing values on both sides and keep the better.
"""

import heapq
import json
import math
import sys
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# functions that run in tasks travel with the task
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CUTS = 64
BLOCK_FEATURES = 256
FAN_IN = 64


@dataclass(frozen=True)
class Growth:
    """How one model grows.  ``l2`` is added to second-derivative sums, a cut must
    gain more than ``least_gain`` and leave ``least_weight`` on either side."""
    growth: str = "level"
    rounds: int = 25
    depth: int = 3
    leaves: int = 0
    step: float = 0.2
    l2: float = 1.0
    least_gain: float = 0.0
    least_weight: float = 1.0
    row_share: float = 1.0
    feature_share: float = 1.0
    seed: int = 42


LEARNERS = {
    "boost_level": Growth("level", rounds=25, depth=3),
    "boost_leaf": Growth("leaf", rounds=12, depth=6, leaves=24),
    "boost_symmetric": Growth("symmetric", rounds=20, depth=5, row_share=0.7),
}


class Tree:
    """A tree as arrays over heap numbers (root 1, children 2i and 2i + 1):
    feature (-1: none), last bin that goes left, side of missing values, value."""

    FIELDS = ("feature", "bin", "missing_left", "value", "gain")

    def __init__(self, depth: int):
        n = 1 << (depth + 1)
        self.feature, self.bin = np.full(n, -1, np.int32), np.zeros(n, np.int32)
        self.missing_left, self.value, self.gain = np.zeros(n, bool), np.zeros(n), np.zeros(n)

    @classmethod
    def of(cls, fields: dict) -> "Tree":
        t = cls.__new__(cls)
        t.__dict__.update(fields)
        return t

    def reach(self, columns, n: int, levels: int) -> tuple[np.ndarray, np.ndarray]:
        """Where ``n`` rows get in at most ``levels`` steps: a number per row into
        the second array, heap numbers.  ``columns`` gives a feature's bins of all
        rows."""
        walk = Walk(self, levels)
        return walk.at(columns if isinstance(columns, Bins) else Bins(columns), n), walk.ends

    def _cut_of_each_level(self, levels: int) -> list[int] | None:
        """A node per level if all of a level's nodes have the same cut, as in
        symmetric growth."""
        out = []
        for level in range(levels):
            row = np.arange(1 << level, 2 << level)
            row = row[self.feature[row] >= 0]
            if not len(row):
                break
            for v in (self.feature, self.bin, self.missing_left):
                if (v[row] != v[row[0]]).any():
                    return None
            out.append(int(row[0]))
        return out

    def _ends_by_bits(self, levels: int) -> np.ndarray:
        """Heap numbers by the sides taken, first level's side first; a node that
        is not cut ends the walk."""
        at = np.ones(1 << levels, np.int64)
        for level in range(levels):
            bit = np.arange(1 << levels) >> (levels - 1 - level) & 1
            at = np.where(self.feature[at] >= 0, 2 * at + bit, at)
        return at


class Bins(dict):
    """Bins by feature.  They are under 255."""

    def __init__(self, columns=()):
        super().__init__(enumerate(columns))
        self._last: dict[int, np.ndarray] = {}

    def missing_last(self, f: int) -> np.ndarray:
        """A feature's bins less one, so that bin 0, missing, becomes the last."""
        if f not in self._last:
            self._last[f] = self[f] - np.uint8(1)
        return self._last[f]


class Walk:
    """A tree's cuts as plain numbers, taken from it once for all chunks of a task.
    Whole columns are compared and merged, so a node costs a few vector instructions
    and no row is looked up by itself.  ``ends`` are the heap numbers of the places
    where a row may end, ``values`` theirs."""

    def __init__(self, tree: Tree, levels: int):
        self.kind, ends = np.uint8 if levels <= 8 else np.uint32, []
        cut = lambda node: (int(tree.feature[node]), np.uint8(tree.bin[node]), bool(tree.missing_left[node]))

        def numbered(node, left_to_go):
            if tree.feature[node] < 0 or not left_to_go:
                ends.append(node)
                return len(ends) - 1
            return numbered(2 * node, left_to_go - 1), numbered(2 * node + 1, left_to_go - 1), cut(node)

        shared = tree._cut_of_each_level(levels)
        self.shared = None if shared is None else [cut(node) for node in shared]
        self.root = numbered(1, levels) if shared is None else 0
        self.ends = np.array(ends, np.int64) if shared is None else tree._ends_by_bits(len(shared))
        self.values = tree.value[self.ends]

    def _right(self, columns: Bins, cut: tuple) -> np.ndarray:
        """1 for rows that go right, in an array of its own."""
        f, b, missing_left = cut
        side = columns[f] > b if missing_left else columns.missing_last(f) >= b
        return side.view(np.uint8).astype(self.kind, copy=False)

    def _number(self, node, columns: Bins):
        """Place among the ends; those right of a node are greater than those left of it."""
        if isinstance(node, int):
            return node
        left, right, cut = node
        a, b, side = self._number(left, columns), self._number(right, columns), self._right(columns, cut)
        if isinstance(a, int) and isinstance(b, int):  # b = a + 1
            side += self.kind(a)
            return side
        side *= self.kind(b) if isinstance(b, int) else b
        return np.maximum(side, self.kind(a) if isinstance(a, int) else a, out=side)

    def at(self, columns: Bins, n: int) -> np.ndarray:
        """A number per row, of its end in ``ends``."""
        if self.shared is None:
            at = self._number(self.root, columns)
            return np.full(n, at, self.kind) if isinstance(at, int) else at
        at = np.zeros(n, self.kind)
        for cut in self.shared:  # a level's side is the next bit of the number
            at <<= self.kind(1)
            at |= self._right(columns, cut)
        return at


@dataclass
class _Job:
    """A model being fitted: its rows, its finished trees and the current one."""
    subset: int
    how: Growth
    base: float = 0.0
    scale: float = 1.0
    trees: list = field(default_factory=list)
    tree: Tree | None = None
    level: int = 0
    open: np.ndarray | None = None
    round: int = 0
    kept: int = 0  # trees whose margins are in the blocks, and the place there
    place: int = -1
    halves: bool = False  # of two children one is counted
    counted: np.ndarray | None = None  # nodes whose rows are counted, if not all open ones
    parents: dict | None = None  # histograms of the nodes above

    def begin(self) -> None:
        self.tree, self.level, self.open, self.round = Tree(self.how.depth), 0, np.array([1]), len(self.trees)
        self.counted = self.parents = None

    def to_count(self) -> np.ndarray:
        return self.open if self.counted is None else self.counted

    def keeps_sums(self) -> bool:
        return self.halves and self.level + 1 < self.how.depth

    def whole(self, counted: np.ndarray, f0: int) -> np.ndarray:
        """Sums (2, open nodes, bins) of a block that begins at bin ``f0`` from those
        of the counted nodes."""
        if self.counted is None:
            return counted
        at = {int(node): i for i, node in enumerate(self.counted)}
        rest = lambda node: self.parents[node // 2][:, f0:f0 + counted.shape[2]] - counted[:, at[node ^ 1]]
        return np.stack([counted[:, at[node]] if node in at else rest(node) for node in self.open.tolist()], axis=1)

    def without_trees(self) -> "_Job":
        """What the search for cuts needs."""
        return replace(self, trees=[], tree=None, kept=0)

    def done(self) -> bool:
        return len(self.trees) >= self.how.rounds

    def walked(self) -> list:
        """Finished trees that a pass walks."""
        return self.trees[self.kept:]

    def passes_left(self) -> int:
        return (self.how.rounds - len(self.trees)) * self.how.depth - self.level

    def without_open_tree(self) -> "_Job":
        """What margins need."""
        return replace(self, tree=None, open=None, counted=None)

    def start(self, margins: np.ndarray | None):
        """Margins of a chunk's rows before the walked trees."""
        return self.base if self.place < 0 else margins[:, self.place]

    def __getstate__(self) -> dict:
        """Every task of a pass reads the trees it walks: they travel as one array
        per field, not as thousands of small ones."""
        walked = self.walked()
        return {**self.__dict__, "parents": None, "trees": {a: np.array([getattr(t, a) for t in walked]) for a in Tree.FIELDS}, "count": len(walked)}

    def __setstate__(self, state: dict) -> None:
        fields, count = state.pop("trees"), state.pop("count")
        self.__dict__.update(state, trees=[None] * state["kept"] + [Tree.of({a: v[i] for a, v in fields.items()}) for i in range(count)])

    def features(self, n: int) -> np.ndarray:
        """Features that the current tree may cut."""
        if self.how.feature_share >= 1:
            return np.ones(n, bool)
        rng = np.random.default_rng([self.how.seed, self.round])
        out = np.zeros(n, bool)
        out[rng.choice(n, max(1, round(n * self.how.feature_share)), replace=False)] = True
        return out

    def take(self, code: np.ndarray) -> np.ndarray:
        """Rows that the current tree is fitted on, by their repeatable code."""
        if self.how.row_share >= 1:
            return np.ones(len(code), bool)
        z = code.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * (self.how.seed * 1_000_003 + self.round + 1) % (1 << 64))
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            z = (z ^ (z >> np.uint64(shift))) * np.uint64(by)
        z ^= z >> np.uint64(31)
        return (z >> np.uint64(11)).astype(np.float64) / (1 << 53) < self.how.row_share


def margin(base, walks: Sequence[Walk], columns: Bins, n: int) -> np.ndarray:
    """``base``, a number or one per row, and the trees' values, added in their order."""
    out, value = np.full(n, base, float), np.empty(n)
    for w in walks:
        out += np.take(w.values, w.at(columns, n), out=value, mode="clip")  # in range; clipping skips a copy
    return out


# ------------------------------------------------------------------ binning
def cut_points(rows: DataFrame, slots: int, binary: Sequence[int] = ()) -> tuple[dict[int, list[np.ndarray]], dict]:
    """Per subset and feature the ascending cuts, from approximate quantiles, and per
    subset the sums that fits begin with, in one aggregate; features of ``binary``
    hold 0 and 1 and are cut between."""
    probs = [float(v) for v in (np.arange(1, CUTS + 1) / (CUTS + 1))]
    numeric = [i for i in range(slots) if i not in set(binary)]
    x = lambda i: F.when(~F.isnan(F.col("x")[i]), F.col("x")[i])
    aggs = [F.percentile_approx(x(i), probs, 10_000).alias(f"q{i}") for i in numeric]
    fixed = lambda c: F.sum(F.round(c * (1 << 20)).cast("decimal(28,0)"))
    out, stats = {}, {}
    for r in rows.groupBy("subset").agg(fixed(F.col("w")).alias("w"), fixed(F.col("w") * F.col("y")).alias("wy"), F.count(F.lit(1)).alias("n"),
                                        F.max("w").alias("top"), *aggs).collect():
        out[r["subset"]] = [np.unique(np.array(r[f"q{i}"] or [], float)) if i in numeric else np.array([0.5]) for i in range(slots)]
        stats[r["subset"]] = {c: r[c] for c in ("w", "wy", "n", "top")}
    return out, stats


def bins_of(x: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """0 for missing, else 1 + the number of cuts below the value."""
    return np.where(np.isnan(x), 0, 1 + np.searchsorted(cuts, x, side="left")).astype(np.uint8)


class Layout:
    """Features with few bins share a byte (mixed radix, at most 256 codes), so a
    pass counts codes, not features; a feature's histogram is the sum of its
    byte's over the others' bins.  Features of ``binary`` hold 0 and 1 and are
    never missing; of each group of ``exclusive``, binary ones of which a row has
    at most one, the number of the hot one is kept."""

    def __init__(self, sizes: Sequence[int], binary: Sequence[int] = (), exclusive: Sequence[Sequence[int]] = ()):
        self.sizes = np.array(sizes, np.int64)
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        two = {f for f in binary if sizes[f] == 3}  # missing, 0, 1
        hot = [[f for f in g if f in two] for g in exclusive]
        units = [(g[i:i + 255], "hot") for g in hot for i in range(0, len(g), 255) if len(g) > 1]
        units += [([f], "bit") for f in sorted(two - {f for u, _ in units for f in u})]
        units += [([f], "bins") for f in range(len(sizes)) if f not in two]
        count = {"hot": lambda fs: len(fs) + 1, "bit": lambda fs: 2, "bins": lambda fs: int(sizes[fs[0]])}
        self.units = sorted(((fs, kind, count[kind](fs)) for fs, kind in units), key=lambda u: (-u[2], u[0]))
        self.groups: list[list[int]] = []
        self.codes: list[int] = []
        self.place: list[tuple[int, int]] = []  # of a unit: byte, stride
        for u, (_, _, codes) in enumerate(self.units):
            k = next((k for k, c in enumerate(self.codes) if c * codes <= 256), len(self.codes))
            if k == len(self.codes):
                self.groups.append([])
                self.codes.append(1)
            self.place.append((k, self.codes[k]))
            self.groups[k].append(u)
            self.codes[k] *= codes
        self.unit_of = {f: (u, i) for u, (fs, _, _) in enumerate(self.units) for i, f in enumerate(fs)}

    def packed(self, bins: np.ndarray) -> np.ndarray:
        """Rows of bytes from bins by feature."""
        out = np.zeros((bins.shape[1], len(self.groups)), np.uint8)
        for (fs, kind, _), (k, stride) in zip(self.units, self.place):
            if kind == "bins":
                code = bins[fs[0]]
            else:
                one = bins[fs] == 2
                if not (bins[fs] > 0).all() or (one.sum(axis=0) > 1).any():
                    raise ValueError(f"features {fs} are not what the layout was told: 0 and 1, and one of a group")
                code = (one * np.arange(1, len(fs) + 1, dtype=np.uint8)[:, None]).sum(axis=0, dtype=np.uint8)
            out[:, k] += code * np.uint8(stride)
        return out

    def bins_by_code(self, f: int) -> tuple[int, np.ndarray]:
        """A feature's byte, and its bin by that byte's code."""
        u, i = self.unit_of[f]
        (_, kind, codes), (k, stride) = self.units[u], self.place[u]
        code = np.arange(256) // stride % codes
        return k, (code if kind == "bins" else 1 + (code == i + 1)).astype(np.uint8)

    def spread(self, byte: int, sums: np.ndarray, out: np.ndarray) -> None:
        """Histograms of a byte's features (last axis: their bins) from its own."""
        group = self.groups[byte]
        s = sums.reshape(*sums.shape[:2], *[self.units[u][2] for u in reversed(group)])
        for i, u in enumerate(group):
            others = tuple(2 + k for k in range(len(group)) if k != len(group) - 1 - i)
            own, (fs, kind, _) = s.sum(axis=others), self.units[u]
            if kind == "bins":
                out[:, :, self.first[fs[0]]:self.first[fs[0] + 1]] = own
                continue
            total = own.sum(axis=2)
            for j, f in enumerate(fs):
                at = self.first[f]
                out[:, :, at], out[:, :, at + 1], out[:, :, at + 2] = 0, total - own[:, :, j + 1], own[:, :, j + 1]


class Columns(Bins):
    """Bins by feature of packed rows, unpacked on first use."""

    def __init__(self, packed: np.ndarray, layout: Layout):
        super().__init__()
        self.bytes, self.layout = np.ascontiguousarray(packed.T), layout
        self._wide = None

    def wide(self) -> np.ndarray:
        """The bytes as counting takes them, widened once for all models."""
        if self._wide is None:
            self._wide = self.bytes.astype(np.int64)
        return self._wide

    def __missing__(self, f):
        k, bins = self.layout.bins_by_code(int(f))
        self[f] = np.take(bins, self.bytes[k], mode="clip")
        return self[f]


BLOCK_ROWS = 256
BLOCK = "subset int, y binary, w binary, code binary, bins binary"


def binned(rows: DataFrame, cuts: dict[int, list[np.ndarray]], layout: Layout) -> DataFrame:
    """Blocks of up to ``BLOCK_ROWS`` rows of one subset from ``subset, y, w, code,
    x``: the columns' values one after another, ``bins`` as bytes of
    :class:`Layout`, row by row.  A pass reads blocks, so Spark handles no row."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            subset = b.column("subset").to_numpy()
            columns = [b.column(c).to_numpy() for c in ("y", "w", "code")]
            out = []
            for s in np.unique(subset).tolist():
                mine = np.flatnonzero(subset == s)
                packed = layout.packed(np.array([bins_of(x[mine, f], c) for f, c in enumerate(cuts[s])], np.uint8).reshape(-1, len(mine)))
                for k in range(0, len(mine), BLOCK_ROWS):
                    some = mine[k:k + BLOCK_ROWS]
                    out.append((s, *[c[some].tobytes() for c in columns], packed[k:k + BLOCK_ROWS].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), (pa.int32(), *[pa.binary()] * 4))],
                                             names=["subset", "y", "w", "code", "bins"])

    return rows.select("subset", "y", "w", "code", "x").mapInArrow(run, BLOCK)


# ------------------------------------------------------------------- passes
CHUNK = 1 << 15


def _values(column: pa.Array, kind) -> np.ndarray:
    """The values of a column of blocks, one block after another."""
    ends = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[ends[0]:ends[-1]].view(kind)


def _chunks(batches):
    """(subset, y, w, code, bytes of the rows, carried margins of the rows if there are
    any) of about ``CHUNK`` rows of one subset."""
    for b in batches:
        if not b.num_rows:
            continue
        subset = b.column("subset").to_numpy()
        runs = np.concatenate([[0], np.flatnonzero(np.diff(subset)) + 1, [len(subset)]])
        step = max(1, CHUNK // BLOCK_ROWS)
        for a, z in zip(runs, runs[1:]):
            for k in range(a, z, step):
                c = b.slice(k, min(step, z - k))
                y, w, code = (_values(c.column(n), kind) for n, kind in (("y", np.float64), ("w", np.float64), ("code", np.int64)))
                if len(y):
                    margins = _values(c.column("margins"), np.float64).reshape(len(y), -1) if "margins" in b.schema.names else None
                    yield int(subset[k]), y, w, code, _values(c.column("bins"), np.uint8).reshape(len(y), -1), margins


def _histograms(jobs: list[_Job], layout: Layout):
    """Task: partial histograms of all jobs' open nodes, one row per job and
    feature block."""
    first, sizes = layout.first, layout.sizes
    by_subset: dict[int, list[int]] = {}
    walks: dict[int, tuple[Walk, list[Walk]]] = {}
    for k, job in enumerate(jobs):
        by_subset.setdefault(job.subset, []).append(k)

    def add(k, columns, y, w, code, margins, sums):
        """One job's rows of a chunk; rows that its tree is not fitted on or
        that are in no open node add nothing."""
        job, n = jobs[k], len(y)
        if k not in walks:
            walks[k] = Walk(job.tree, job.level), [Walk(t, job.how.depth) for t in job.walked()]
        current, finished = walks[k]
        at, ends = current.at(columns, n), current.ends
        nodes = len(job.to_count())
        place = np.full(1 << (job.how.depth + 1), nodes)
        place[job.to_count()] = np.arange(nodes)
        node, m = np.take(place[ends] * 256, at, mode="clip"), margin(job.start(margins), finished, columns, n)
        some = None
        if job.how.row_share < 1 or (place[ends] == nodes).any():
            some = np.flatnonzero(node < nodes * 256)
            if job.how.row_share < 1:
                some = some[job.take(code[some])]
            node, m, y, w = node[some], m[some], y[some], w[some]
        p = 1.0 / (1.0 + np.exp(-m))
        g, h = np.rint(w * (p - y) * job.scale), np.rint(w * p * (1 - p) * job.scale)
        total = sums.setdefault(k, np.zeros((len(layout.codes), 2, nodes, 256), np.int64))
        flat = np.empty(len(node), np.int64)
        for byte, codes in enumerate(columns.wide()):
            np.add(node, codes, out=flat) if some is None else np.add(node, np.take(codes, some, out=flat, mode="clip"), out=flat)
            for i, v in enumerate((g, h)):
                total[byte, i] += np.bincount(flat, v, minlength=nodes * 256).astype(np.int64).reshape(nodes, 256)

    def run(batches):
        from pyspark import TaskContext
        sums: dict[int, np.ndarray] = {}
        for subset, y, w, code, packed, margins in _chunks(batches):
            if subset in by_subset:
                columns = Columns(packed, layout)
                for k in by_subset[subset]:
                    add(k, columns, y, w, code, margins, sums)
        rows = []
        for k, total in sums.items():
            whole = np.zeros((2, len(jobs[k].to_count()), int(first[-1])), np.int64)
            for byte, codes in enumerate(layout.codes):
                layout.spread(byte, total[byte, :, :, :codes], whole)
            rows += [(k, block, TaskContext.get().partitionId(), np.ascontiguousarray(whole[:, :, first[f]:first[min(f + BLOCK_FEATURES, len(sizes))]]).tobytes())
                     for block, f in enumerate(range(0, len(sizes), BLOCK_FEATURES))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary()))],
                                             names=["job", "block", "part", "sums"])

    return run


def _total(t: pa.Table) -> np.ndarray:
    out = None
    for v in t.column("sums"):
        a = np.frombuffer(v.as_buffer(), np.int64)
        out = a.copy() if out is None else out + a
    return out


def _added(t: pa.Table) -> pa.Table:
    return pa.table({"job": t.column("job").slice(0, 1).cast(pa.int32()), "block": t.column("block").slice(0, 1).cast(pa.int32()),
                     "part": t.column("part").slice(0, 1), "sums": pa.array([_total(t).tobytes()], pa.binary())})


def gains(g: np.ndarray, h: np.ndarray, total_g, total_h, l2: float) -> np.ndarray:
    score = lambda a, b: a * a / (b + l2)
    return 0.5 * (score(g, h) + score(total_g - g, total_h - h) - score(total_g, total_h))


CANDIDATE = ("job int, node int, gain double, feature int, bin int, missing_left boolean, g double, h double, left_g double, left_h double, "
             "block int, sums binary")


def _candidates(mine: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of features with ``mine`` bins, one after another, all cuts in the order in which
    the first of equal gain is taken: feature, last bin that goes left (never the last
    one), the place of that bin and of the feature's bin 0, side of missing values."""
    first = np.concatenate([[0], np.cumsum(mine)])
    cuts = [(f, b, first[f] + b, first[f], side) for f in np.flatnonzero(allowed & (mine >= 3)).tolist() for side in (0, 1) for b in range(1, int(mine[f]) - 1)]
    return tuple(np.array(c, np.int64) for c in zip(*cuts)) if cuts else (np.zeros(0, np.int64),) * 5


def _cuts_of(jobs: list[_Job], sizes: np.ndarray, parents: Sequence[dict | None] = ()):
    """Group of one job and block: the best cut of every open node in it, all cuts of
    all nodes compared at once, and the sums that the children's are taken from."""
    starts = np.concatenate([[0], np.cumsum(sizes)])

    def run(t: pa.Table) -> pa.Table:
        k, block = t.column("job")[0].as_py(), t.column("block")[0].as_py()
        job, f0 = jobs[k], block * BLOCK_FEATURES
        if job.counted is not None:
            job = replace(job, parents=parents[k])
        mine, allowed = sizes[f0:f0 + BLOCK_FEATURES], job.features(len(sizes))[f0:f0 + BLOCK_FEATURES]
        n = len(job.open)
        sums = job.whole(_total(t).reshape(2, len(job.to_count()), -1), int(starts[f0]))
        total = sums[:, :, :mine[0]].sum(axis=2) / job.scale  # every feature holds all rows
        feature, last, at, first, side = _candidates(mine, allowed)
        upto = np.cumsum(sums, axis=2)
        left = (upto[:, :, at] - upto[:, :, first] + side * sums[:, :, first]) / job.scale
        gain = gains(left[0], left[1], total[0][:, None], total[1][:, None], job.how.l2)
        gain[np.isnan(gain)] = -math.inf  # nothing on one side, and no l2
        if job.how.growth == "symmetric":
            whole = gain.sum(axis=0)
            best = np.full(n, int(np.argmax(whole)) if len(feature) else -1)
            most = np.full(n, whole[best[0]] if len(feature) and n else -math.inf)
        else:
            low = np.minimum(left[1], total[1][:, None] - left[1]) < job.how.least_weight
            gain = np.where(low, -math.inf, gain)
            best = np.argmax(gain, axis=1) if len(feature) else np.full(n, -1)
            most = gain[np.arange(n), best] if len(feature) else np.full(n, -math.inf)
        rows = []
        for i, node in enumerate(job.open):
            b, found = best[i], most[i] > -math.inf
            c = (most[i], f0 + feature[b], last[b], side[b], left[0][i, b], left[1][i, b]) if found else (-math.inf, -1, 0, False, 0.0, 0.0)
            rows.append((k, int(node), float(c[0]), int(c[1]), int(c[2]), bool(c[3]), total[0][i], total[1][i], float(c[4]), float(c[5]),
                         block, np.ascontiguousarray(sums[:, i]).tobytes() if job.keeps_sums() else None))
        kinds = (pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.float64()] * 4, pa.int32(), pa.binary())
        return pa.table([pa.array(v, kind) for v, kind in zip(zip(*rows), kinds)], names=[c.split()[0] for c in CANDIDATE.split(", ")])

    return run


def one_pass(matrix: DataFrame, jobs: list[_Job], layout: Layout, parts: int) -> list:
    """Best cut per job, open node and block."""
    d = matrix.mapInArrow(_histograms(jobs, layout), "job int, block int, part long, sums binary")
    while parts > FAN_IN:  # partial histograms add up in a tree
        parts = -(-parts // FAN_IN)
        d = d.groupBy("job", "block", F.pmod("part", F.lit(parts)).alias("group")).applyInArrow(_added, "job int, block int, part long, sums binary")
    cuts = _cuts_of([j.without_trees() for j in jobs], layout.sizes, [j.parents for j in jobs] if any(j.parents for j in jobs) else ())
    return d.groupBy("job", "block").applyInArrow(cuts, CANDIDATE).collect()


CARRIED = 8
KEPT_BYTES = 1 << 28  # histograms of all open nodes, above which every node is counted


def _carry_pays(jobs: list[_Job]) -> bool:
    """After ``CARRIED`` trees a model, unless few passes are left.  Writing a row's
    margin costs about as much as walking 20 trees, reading it as walking two."""
    walked, left = (np.array([v(j) for j in jobs]) for v in (lambda j: len(j.walked()), _Job.passes_left))
    return walked.sum() >= CARRIED * len(jobs) and (walked * left).sum() > 2 * (20 + 2 * left).sum()


def carried(matrix: DataFrame, jobs: list[_Job], layout: Layout) -> DataFrame:
    """The blocks of the jobs' subsets with the margins of their finished trees, row by
    row, one for each of a subset's jobs."""
    by_subset: dict[int, list[_Job]] = {}
    for j in jobs:
        by_subset.setdefault(j.subset, []).append(j.without_open_tree())

    def run(batches):
        walks = {s: [[Walk(t, j.how.depth) for t in j.walked()] for j in js] for s, js in by_subset.items()}
        for subset, y, w, code, packed, margins in _chunks(batches):
            if subset not in by_subset:
                continue
            n, columns = len(y), Columns(packed, layout)
            m = np.column_stack([margin(j.start(margins), ws, columns, n) for j, ws in zip(by_subset[subset], walks[subset])])
            out = [(subset, *[v[k:k + BLOCK_ROWS].tobytes() for v in (y, w, code, packed, m)]) for k in range(0, n, BLOCK_ROWS)]
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(zip(*out), (pa.int32(), *[pa.binary()] * 5))],
                                             names=["subset", "y", "w", "code", "bins", "margins"])

    return matrix.mapInArrow(run, BLOCK + ", margins binary")


def _grow(job: _Job, found: list) -> None:
    """Put the level's best cuts into the job's tree; close it when finished."""
    t, how = job.tree, job.how
    by: dict[int, list] = {}
    for r in found:
        by.setdefault(r["node"], []).append(r)
    ahead, counted, parents = [], [], {}
    for node in job.open.tolist():
        best = max(by[node], key=lambda r: (r["gain"], -r["feature"])) if node in by else None
        if best is None:
            continue
        t.value[node] = -best["g"] / (best["h"] + how.l2) * how.step
        if best["gain"] > how.least_gain and best["feature"] >= 0:
            t.feature[node], t.bin[node], t.missing_left[node], t.gain[node] = best["feature"], best["bin"], best["missing_left"], best["gain"]
            lightest = []
            for child, (g, h) in ((2 * node, (best["left_g"], best["left_h"])), (2 * node + 1, (best["g"] - best["left_g"], best["h"] - best["left_h"]))):
                t.value[child] = -g / (h + how.l2) * how.step
                if h > 0:  # a symmetric cut may leave one side of a node empty
                    ahead.append(child)
                    lightest.append((h, child))
            if job.keeps_sums() and lightest:
                counted.append(min(lightest)[1])
                parents[node] = np.concatenate([np.frombuffer(r["sums"], np.int64).reshape(2, -1) for r in sorted(by[node], key=lambda r: r["block"])], axis=1)
    job.counted, job.parents = (np.array(counted, np.int64), parents) if counted else (None, None)
    job.level += 1
    job.open = np.array(ahead, np.int64)
    if not ahead or job.level == how.depth:
        if how.growth == "leaf":
            _keep_best(t, how.leaves)
        job.trees.append(t)
        if not job.done():
            job.begin()


def _keep_best(t: Tree, leaves: int) -> None:
    """Leaf-wise growth replayed on a tree with every paying cut: the open leaf
    of the greatest gain is cut next, until there are ``leaves``."""
    kept, ready = set(), [(-t.gain[1], 1)] if t.feature[1] >= 0 else []
    while ready and len(kept) + 1 < leaves:
        _, node = heapq.heappop(ready)
        kept.add(node)
        for child in (2 * node, 2 * node + 1):
            if t.feature[child] >= 0:
                heapq.heappush(ready, (-t.gain[child], child))
    t.feature[[i for i in range(len(t.feature)) if i not in kept]] = -1


@dataclass
class Binned:
    """Rows ready for passes, for any number of fits."""
    matrix: DataFrame
    layout: Layout
    cuts: dict
    stats: dict
    slots: int
    parts: int


def ready(rows: DataFrame, binary: Sequence[int] = (), name: str = "boost", written: bool = False, exclusive: Sequence[Sequence[int]] = (),
          slots: int | None = None) -> Binned:
    """Bin ``rows`` (``subset, y, w, code, x``) and write the blocks.  ``binary``
    features hold 0 and 1, ``exclusive`` groups of them at most one 1.
    ``written``: the rows come from a written table and need not be written again.
    With ``slots``, the length of ``x``, the rows are read twice: for cuts and
    sums, and for the blocks."""
    from .learn import write_and_read
    if not written:
        rows = write_and_read(rows.select("subset", "y", "w", "code", "x"), f"{name}-rows")
    if slots is None:
        slots = rows.agg(F.max(F.size("x"))).first()[0] or 0
    cuts, stats = cut_points(rows, slots, binary)
    layout = Layout([max([len(c[f]) for c in cuts.values()], default=0) + 2 for f in range(slots)], binary, exclusive)
    matrix = write_and_read(binned(rows, cuts, layout), f"{name}-bins")
    return Binned(matrix, layout, cuts, stats, slots, matrix.select(F.spark_partition_id().alias("p")).distinct().count())


GROUPS, GROUP_ROWS = 2, 1 << 20


def _groups(jobs: list[_Job], stats: dict, rows_from: int = GROUP_ROWS) -> list[list[_Job]]:
    """Jobs whose passes run beside each other, so that one group's tasks fill the
    cores while the other's cuts are searched.  A subset's jobs stay together: they
    share its unpacked rows, and no row is counted in both groups.  Below ``rows_from``
    rows a pass is mostly start-up, and all jobs share one scan."""
    if sum(stats[s]["n"] for s in {j.subset for j in jobs}) < rows_from:
        return [jobs] if jobs else []
    out: list[list[_Job]] = [[] for _ in range(GROUPS)]
    rows = [0] * GROUPS
    for s in sorted({j.subset for j in jobs}, key=lambda s: (-stats[s]["n"], s)):
        k = rows.index(min(rows))
        rows[k] += stats[s]["n"]
        out[k] += [j for j in jobs if j.subset == s]
    return [g for g in out if g]


def fit_ready(data: Binned, models: list[tuple[int, Growth]], rows_from: int = GROUP_ROWS) -> list["BoostedModel"]:
    """Fit all ``models`` (subset, growth) in shared passes: a row counts for the
    models of its subset.  From ``rows_from`` rows on, two groups of subsets have
    passes of their own, beside each other, margins are carried and one child of two
    is counted; trees do not depend on it."""
    from .learn import remove_table, write_table
    jobs = [_Job(s, how) for s, how in models]
    for j in jobs:
        if j.subset in data.stats and data.stats[j.subset]["w"]:
            s = data.stats[j.subset]
            share = min(max(float(s["wy"] / s["w"]), 1e-6), 1 - 1e-6)
            j.base = math.log(share / (1 - share))
            # sums of all rows stay below 2^61, those of a chunk, added as doubles, below 2^53
            j.scale = 2.0 ** min(30, 61 - math.ceil(math.log2(max(1.0, s["n"] * s["top"]))), 52 - math.ceil(math.log2(max(1.0, CHUNK * s["top"]))))
        j.begin()
    groups = _groups([j for j in jobs if j.subset in data.stats], data.stats, rows_from)

    def passes(left: list[_Job]) -> None:
        matrix, parts, large = data.matrix, data.parts, sum(data.stats[s]["n"] for s in {j.subset for j in left}) >= rows_from // GROUPS
        if len(groups) > 1:
            matrix = matrix.filter(F.col("subset").isin(sorted({j.subset for j in left})))
        spark, old = matrix.sparkSession, None
        for j in left:
            j.halves = large and 16 * int(data.layout.first[-1]) * sum(1 << j.how.depth for j in left) <= KEPT_BYTES
        while left:
            found: dict[int, list] = {}
            for r in one_pass(matrix, left, data.layout, parts):
                found.setdefault(r["job"], []).append(r)
            for k, j in enumerate(left):
                _grow(j, found.get(k, []))
            left = [j for j in left if not j.done()]
            if left and large and _carry_pays(left):
                path = write_table(carried(matrix, left, data.layout), "boost-margins")
                if old:
                    remove_table(spark, old)
                matrix, old = spark.read.parquet(path), path
                parts = matrix.rdd.getNumPartitions()
                places: dict[int, int] = {}
                for j in left:
                    j.kept, j.place = len(j.trees), places.setdefault(j.subset, 0)
                    places[j.subset] += 1
        if old:
            remove_table(spark, old)

    with ThreadPoolExecutor(max_workers=max(1, len(groups))) as pool:
        list(pool.map(passes, groups))
    return [BoostedModel.of(j.base, j.trees, j.how, data.cuts.get(j.subset, [np.array([])] * data.slots)) for j in jobs]


def fit_many(rows: DataFrame, models: list[tuple[int, Growth]], binary: Sequence[int] = (), name: str = "boost",
             written: bool = False, exclusive: Sequence[Sequence[int]] = (), slots: int | None = None) -> list["BoostedModel"]:
    """:func:`ready` and :func:`fit_ready` in one."""
    return fit_ready(ready(rows, binary, name, written, exclusive, slots), models)


# -------------------------------------------------------------------- model
class BoostedModel(Model, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted model as a persistable pipeline stage: adds ``prob_<tag>`` (vector),
    ``raw_<tag>`` (margin) and ``pred_<tag>`` (cancel at or above ``threshold``)."""

    learned = Param(Params._dummy(), "learned", "trees, cuts and base as JSON", typeConverter=TypeConverters.toString)
    featuresCol = Param(Params._dummy(), "featuresCol", "vector of features", typeConverter=TypeConverters.toString)
    tag = Param(Params._dummy(), "tag", "suffix of the output columns", typeConverter=TypeConverters.toString)
    threshold = Param(Params._dummy(), "threshold", "least probability of class 1", typeConverter=TypeConverters.toFloat)

    def __init__(self):
        super().__init__()
        self._setDefault(featuresCol="features", tag="boost", threshold=0.5)

    @classmethod
    def of(cls, base: float, trees: Sequence[Tree], how: Growth, cuts: list[np.ndarray]) -> "BoostedModel":
        split = lambda t, i: t.feature[i] >= 0
        state = {"base": base, "how": asdict(how), "cuts": [c.tolist() for c in cuts],
                 "trees": [{str(i): [int(t.feature[i]), int(t.bin[i]), bool(t.missing_left[i]), float(t.value[i]), float(t.gain[i])]
                            for i in range(1, len(t.feature)) if split(t, i) or i == 1 or split(t, i // 2)} for t in trees]}
        return cls()._set(learned=json.dumps(state))

    def named(self, tag: str, threshold: float = 0.5) -> "BoostedModel":
        return self._set(tag=tag, threshold=threshold)

    def state(self) -> dict:
        return json.loads(self.getOrDefault(self.learned))

    def trees(self) -> list[Tree]:
        s = self.state()
        out = []
        for nodes in s["trees"]:
            t = Tree(s["how"]["depth"])
            for i, (f, b, left, value, gain) in nodes.items():
                i = int(i)
                t.feature[i], t.bin[i], t.missing_left[i], t.value[i], t.gain[i] = f, b, left, value, gain
            out.append(t)
        return out

    def gain_shares(self, slots: int) -> np.ndarray:
        """Share of each feature in the gain of all cuts."""
        total = np.zeros(slots)
        for t in self.trees():
            cut = t.feature >= 0
            np.add.at(total, t.feature[cut], t.gain[cut])
        return total / total.sum() if total.sum() else total

    def _transform(self, df: DataFrame) -> DataFrame:
        tag = self.getOrDefault(self.tag)
        d = df.withColumn(f"raw_{tag}", margins([self], F.col(self.getOrDefault(self.featuresCol)))[0])
        p = 1.0 / (1.0 + F.exp(-F.col(f"raw_{tag}")))
        return (d.withColumn(f"prob_{tag}", array_to_vector(F.array(1.0 - p, p)))
                .withColumn(f"pred_{tag}", (p >= self.getOrDefault(self.threshold)).cast("double")))


def margins(models: Sequence[BoostedModel], features: Column) -> Column:
    """Array of the margins of several models with the same cuts, evaluated batch
    by batch: a row is binned once and all trees are walked column by column."""
    states = [m.state() for m in models]
    cuts = [np.array(c, float) for c in states[0]["cuts"]]
    parts = [(s["base"], [Walk(t, s["how"]["depth"]) for t in m.trees()]) for s, m in zip(states, models)]

    def run(x: pa.Array) -> pa.Array:
        n = len(x)
        v = x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        columns = Bins(bins_of(v[:, f], c) for f, c in enumerate(cuts)) if n else Bins()
        m = np.column_stack([margin(*p, columns, n) for p in parts]) if n else np.zeros((0, len(parts)))
        return pa.ListArray.from_arrays(np.arange(0, m.size + 1, m.shape[1], dtype=np.int32), m.ravel())

    return F.arrow_udf(run, "array<double>")(vector_to_array(features))
