"""How well a classifier tells each group's cells from reference cells, for groups of any size.

Every group, within every level, meets as many reference cells as it has cells of its own. Folds keep replicates whole. A
fold's model reads the features with the largest ANOVA F on its training rows and is an L2 logistic regression with balanced
classes, fitted by Newton steps. All models step together: a pass sums each model's gradient and curvature over its rows, part by
part, so a group of a third of all cells is many parts and no task holds more than one of them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.cut import cut
from platewise.operators.nulls import numbered
from platewise.operators.stats import average_rank, join_fit

#: Rows of a part at most, nearly.
PART = 20_000
TOLERANCE, STEPS = 1e-6, 25


def _samples(rows: DataFrame, keys: list[str], min_cells: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """(sizes, sample): every key's cells with y = 1 and as many reference cells of its level with y = 0.

    Reference cells of a level stand in the order of a hash, and a group takes a run of them, from a place that is a hash of its
    name: a simple random sample that needs no list of all groups by all reference cells.
    """
    level = keys[:-1]
    cells = rows.where("not __ref")
    ref = numbered(rows.where("__ref"), level, F.xxhash64(F.lit(seed), "__id"), "__id").withColumn("__k", F.col("__k") - 1)
    have = ref.groupBy(*level).agg(F.count(F.lit(1)).alias("n_all"))
    sizes = join_fit(cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_cells")), have, level)
    sizes = sizes.withColumn("n_reference", F.coalesce(F.least("n_cells", "n_all"), F.lit(0)))
    run = sizes.where((F.col("n_cells") >= min_cells) & (F.col("n_reference") > 0))
    start = F.pmod(F.xxhash64(F.lit(seed + 1), *[F.col(k).cast("string") for k in keys]), F.col("n_all"))
    places = run.select(*keys, F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_reference") - 1), lambda j: F.pmod(start + j, F.col("n_all")))).alias("__k"))
    right = ref.select(*[F.col(k).alias(f"__l_{k}") for k in level], F.col("__k").alias("__at"), "__id", "__rep", "x")
    cond = F.col("__k") == F.col("__at")
    for k in level:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__l_{k}"))
    drawn = places.join(right, cond).select(*keys, "__id", "__rep", "x", F.lit(0).alias("y"))
    own = join_fit(cells, run.select(*keys), keys, "inner").select(*keys, "__id", "__rep", "x", F.lit(1).alias("y"))
    return sizes, own.unionByName(drawn)


def _folds(sample: DataFrame, keys: list[str], n_folds: int, seed: int) -> DataFrame:
    """fold and folds: the replicates of each side dealt in turn; at most as many folds as the smaller side has replicates."""
    units = sample.select(*keys, "y", "__rep").distinct()
    order = Window.partitionBy(*keys, "y").orderBy(F.xxhash64(F.lit(seed + 2), "__rep"), "__rep")
    units = units.withColumn("__n", F.row_number().over(order) - 1)
    sides = units.groupBy(*keys).agg(F.count(F.when(F.col("y") == 1, 1)).alias("a"), F.count(F.when(F.col("y") == 0, 1)).alias("b"))
    sides = sides.select(*keys, F.least(F.lit(n_folds), "a", "b").alias("folds")).where("folds >= 2")
    dealt = join_fit(units, sides, keys, "inner").withColumn("fold", (F.col("__n") % F.col("folds")).cast("int")).drop("__n")
    return join_fit(sample, dealt, [*keys, "y", "__rep"], "inner")


def _merge(batches):
    """Adds up vectors of equal key as they stream by."""
    key, total = None, None
    for b in batches:
        for k, v in zip(b.column(0).to_pylist(), b.column(1)):
            x = np.frombuffer(v.as_buffer())
            if k != key:
                if key is not None:
                    yield _vector(key, total)
                key, total = k, x.copy()
            else:
                total = total + x
    if key is not None:
        yield _vector(key, total)


def _vector(key: int, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([v.tobytes()], pa.binary())], names=["task", "v"])


def _parts(batches):
    """(task, folds, state, x, y, fold) of runs of rows of one task, a batch in memory at a time."""
    for b in batches:
        task = b.column(0).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, task[1:] != task[:-1]]) if len(task) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(task)]):
            part = b.slice(lo, hi - lo)
            state = part.column(5)[0].as_py() if part.num_columns > 5 else None
            yield int(task[lo]), int(part.column(1)[0].as_py()), state, np.stack(part.column(2).to_numpy(zero_copy_only=False)), part.column(3).to_numpy(zero_copy_only=False), part.column(4).to_numpy(zero_copy_only=False)


def _summed(rows: DataFrame, what) -> DataFrame:
    """(task, v): what(folds, state, x, y, fold) added up over the rows of each task."""

    def run(batches):
        key, total = None, None
        for task, folds, state, x, y, fold in _parts(batches):
            v = what(folds, state, x, y, fold)
            if task != key:
                if key is not None:
                    yield _vector(key, total)
                key, total = task, v
            else:
                total = total + v
        if key is not None:
            yield _vector(key, total)

    parts = rows.mapInArrow(run, "task long, v binary")
    return parts.repartition("task").sortWithinPartitions("task").mapInArrow(_merge, "task long, v binary")


def best_features(stats: np.ndarray, folds: int, p: int, k: int) -> list[np.ndarray]:
    """Columns of the largest F on the rows outside each fold; stats (folds, 2 sides, 1 + 2 p): n, sums, squares."""
    s = stats.reshape(folds, 2, 1 + 2 * p)
    whole, out = s.sum(0), []
    everything = whole.sum(0)
    n, one, two = everything[0], everything[1 : 1 + p], everything[1 + p :]
    varies = two / n - (one / n) ** 2 > 1e-12 * np.maximum(two / n, 1e-300)
    for f in range(folds):
        t = whole - s[f]
        count, sums, squares = t[:, 0], t[:, 1 : 1 + p], t[:, 1 + p :].sum(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            total = sums.sum(0)
            between = (sums**2 / count[:, None]).sum(0) - total**2 / count.sum()
            within = squares - total**2 / count.sum() - between
            score = between / (within / (count.sum() - 2))
        score = np.where(varies, np.where(np.isnan(score), -np.inf, score), -np.inf)
        order = np.argsort(score, kind="stable")[-k:]
        out.append(np.sort(order[varies[order]]))
    return out


def _design(x: np.ndarray, columns: np.ndarray) -> np.ndarray:
    return np.column_stack((x[:, columns], np.ones(len(x))))


def model_sums(x: np.ndarray, y: np.ndarray, weight: tuple[float, float], w: np.ndarray) -> np.ndarray:
    """Loss, gradient and curvature of training rows at w, without the penalty."""
    c = np.where(y == 1, weight[1], weight[0])
    z = x @ w
    m = np.where(y == 1, z, -z)
    p = 1.0 / (1.0 + np.exp(-np.clip(z, -500, 500)))
    return np.concatenate(([(c * np.logaddexp(0.0, -m)).sum()], x.T @ (c * (p - y)), ((x * (c * p * (1 - p))[:, None]).T @ x).ravel()))


class Model:
    """State of one fold's model: columns, class weights, and Newton steps that are halved while they do not help."""

    def __init__(self, columns: np.ndarray, counts: np.ndarray):
        n = counts.sum()
        self.columns, self.weight = columns, tuple(float(n / (2.0 * c)) if c else 0.0 for c in counts)
        self.w = np.zeros(len(columns) + 1)
        self.before, self.step, self.loss, self.done = self.w, np.zeros_like(self.w), np.inf, not (len(columns) and counts.all())
        self.fit = bool(len(columns) and counts.all())

    def update(self, sums: np.ndarray) -> None:
        k = len(self.w)
        loss, g, h = sums[0] + self.w @ self.w / 2.0, sums[1 : 1 + k] + self.w, sums[1 + k :].reshape(k, k) + np.eye(k)
        if self.done:
            return
        if loss > self.loss + 1e-12 * abs(self.loss):  # the step went too far
            self.step = self.step / 2.0
            self.w = self.before + self.step
            self.done = bool(np.abs(self.step).max() < TOLERANCE)
            return
        self.before, self.loss, self.step = self.w, loss, -np.linalg.solve(h, g)
        self.w = self.w + self.step
        self.done = bool(np.abs(self.step).max() < TOLERANCE)


def perturbation_score(df: DataFrame, features: Sequence[str], group: str, control: Column, row_id: str, n_features: int = 200, n_folds: int = 5, min_cells: int = 50, seed: int = 0, replicate: str | None = None, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, cells): ([by,] group, n_cells, n_reference, n_folds, auc), and ([by,] group, row_id, score) of scored cells.

    A cell's score is its probability of belonging to its group, from the model that was fitted without its fold. replicate:
    rows of one value stay in one fold; None: every row is its own. by: levels are scored apart, each with reference cells of its
    own. Groups of fewer than min_cells cells, or without two folds, have no AUC. Features are read as they are.
    """
    import pickle

    feats, p = list(features), len(features)
    keys = [*([by] if by else []), group]
    bad = F.exists(F.array(*[F.col(f).cast("double") for f in feats]), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    if not df.where(bad).isEmpty():
        raise ValueError("missing or infinite feature values; drop or fill them first")
    rows = df.select(*keys, F.col(row_id).alias("__id"), F.coalesce(F.col(replicate or row_id).cast("string"), F.lit("")).alias("__rep"), F.coalesce(control, F.lit(False)).alias("__ref"), F.array(*[F.col(f).cast("double") for f in feats]).alias("x"))
    sizes, sample = _samples(rows, keys, min_cells, seed)
    sizes = cut(sizes)
    dealt = _folds(sample, keys, n_folds, seed)
    named = cut(dealt.select(*keys, "folds").distinct().withColumn("task", F.xxhash64(*[F.col(k).cast("string") for k in keys])))
    dealt = join_fit(dealt.drop("folds"), named, keys, "inner").withColumn("part", F.pmod(F.xxhash64("__id"), F.lit(64)))
    counted = join_fit(dealt, dealt.groupBy("task").agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / PART)).alias("parts")), ["task"], "inner")
    dealt = cut(counted.withColumn("part", F.col("part") % F.col("parts")).repartition("task", "part").sortWithinPartitions("task", "part"))
    held = dealt.select("task", "folds", "x", "y", "fold")

    def moments(folds, state, x, y, fold):
        out = np.zeros((folds, 2, 1 + 2 * p))
        for f in range(folds):
            for side in (0, 1):
                own = x[(fold == f) & (y == side)]
                out[f, side] = np.concatenate(([len(own)], own.sum(0), (own * own).sum(0)))
        return out.ravel()

    def begin(batches):
        for b in batches:
            for task, v in zip(b.column(0).to_pylist(), b.column(1)):
                s = np.frombuffer(v.as_buffer())
                folds = len(s) // (2 * (1 + 2 * p))
                counts = s.reshape(folds, 2, -1)[:, :, 0]
                models = [Model(c, counts.sum(0) - counts[f]) for f, c in enumerate(best_features(s, folds, p, n_features))]
                yield _state(task, models)

    def _state(task, models):
        return pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([pickle.dumps(models)], pa.binary()), pa.array([all(m.done for m in models)])], names=["task", "state", "done"])

    def sums(folds, state, x, y, fold):
        return np.concatenate([model_sums(_design(x[fold != f], m.columns), y[fold != f], m.weight, m.w) if not m.done else np.zeros(1 + len(m.w) + len(m.w) ** 2) for f, m in enumerate(pickle.loads(state))])

    def advance(batches):
        for b in batches:
            for task, v, state in zip(b.column(0).to_pylist(), b.column(1), b.column(2)):
                s, models, at = np.frombuffer(v.as_buffer()), pickle.loads(state.as_py()), 0
                for m in models:
                    size = 1 + len(m.w) + len(m.w) ** 2
                    m.update(s[at : at + size])
                    at += size
                yield _state(task, models)

    kind = "task long, state binary, done boolean"
    states = cut(_summed(held, moments).mapInArrow(begin, kind))
    for _ in range(STEPS):
        if states.where("not done").isEmpty():
            break
        open_ones = states.where("not done").select("task", "state")
        step = _summed(held.join(open_ones, "task").select("task", "folds", "x", "y", "fold", "state").sortWithinPartitions("task"), sums)
        moved = step.join(open_ones, "task").select("task", "v", "state").mapInArrow(advance, kind)
        states = cut(states.where("done").unionByName(moved))

    def score(batches):
        for b in batches:
            out = np.empty(b.num_rows)
            state = b.column(3)
            seen, models = None, None
            fold, x = b.column(2).to_numpy(zero_copy_only=False), b.column(1)
            for i in range(b.num_rows):
                task = b.column(0)[i].as_py()
                if task != seen:
                    seen, models = task, pickle.loads(state[i].as_py())
                m = models[fold[i]]
                out[i] = np.nan if not all(o.fit for o in models) else 1.0 / (1.0 + np.exp(-np.clip(np.append(np.asarray(x[i].values)[m.columns], 1.0) @ m.w, -500, 500)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(4), b.column(5), pa.array(out, from_pandas=True)], names=["task", "__id", "y", "score"])

    id_kind = dict(df.dtypes)[row_id]
    found = dealt.select("task", "x", "fold", "y", "__id").join(states.select("task", "state"), "task").select("task", "x", "fold", "state", "__id", "y")
    scored = cut(found.mapInArrow(score, f"task long, __id {id_kind}, y int, score double").where("score is not null"))
    ranked = scored.withColumn("r", average_rank("score", ["task"]))
    one, zero = F.sum("y"), F.sum(1 - F.col("y"))
    auc = ranked.groupBy("task").agg(((F.sum(F.col("r") * F.col("y")) - one * (one + 1) / 2.0) / (one * zero)).alias("auc"))
    table = join_fit(sizes.select(*keys, "n_cells", "n_reference"), named.join(auc, "task").select(*keys, F.col("folds").cast("long").alias("n_folds"), "auc"), keys)
    table = table.withColumn("n_folds", F.coalesce("n_folds", F.lit(0).cast("long")))
    cells = scored.where("y = 1").join(named, "task").select(*keys, F.col("__id").alias(row_id), "score")
    return table, cells
