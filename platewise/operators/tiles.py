"""All-pairs products in tiles, and an exact join of nearest neighbours that leaves most tiles out.

`pair_tiles` deals rows into blocks of bounded size and pairs the blocks: a tile is one matrix product in one task, and a
rule is applied before anything leaves it. Work grows with the square of the rows, as it must, but no side is
broadcast, no task holds more than two blocks, and what is shuffled is blocks, not pairs. Where no single pair is wanted, see
`folds`.

`nearest_neighbours` deals rows into cells around pivots. The triangle inequality bounds the distance from a row to
everything in a cell, so a row visits only cells that could hold one of its k nearest. Distances and ties are those of all
pairs.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.cut import cut
from platewise.operators.folds import best_pairs

#: Rows of a block.
BLOCK = 1024
#: Pivots at most: their vectors and the cells' few numbers are sent to every worker. Fewer where cells would be too small.
PIVOTS, PER_CELL = 256, 24


def _matrix(column: pd.Series, dim: int | None = None) -> np.ndarray:
    return np.array([np.asarray(v, float) for v in column]) if len(column) else np.empty((0, dim or 0))


def _fields(df: DataFrame, columns: Sequence[str], renamed: Callable[[str], str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"`{renamed(c)}` {kinds[c]}" for c in columns)


def n_blocks(rows: int, block: int = BLOCK) -> int:
    return max(1, math.ceil(rows / block))


def _block(row_id: str, blocks: int, seed: int = 0):
    return F.pmod(F.xxhash64(F.lit(seed), F.col(row_id)), F.lit(blocks)).cast("int")


def _rule(left: pd.DataFrame, right: pd.DataFrame, a: np.ndarray, b: np.ndarray, rules) -> np.ndarray:
    """Which of the pairs (a of left, b of right) satisfy one of the rules (columns equal, columns different).

    Missing values are neither equal to nor different from anything.
    """
    keep = np.zeros(len(a), bool)
    for same, diff in rules:
        ok = np.ones(len(a), bool)
        for c in {*same, *diff}:
            x, y = left[c].to_numpy(), right[c].to_numpy()
            codes, _ = pd.factorize(np.concatenate((x, y)))
            x, y = codes[: len(x)][a], codes[len(x) :][b]
            ok &= (x >= 0) & (y >= 0)
            if c in same:
                ok &= x == y
            if c in diff:
                ok &= x != y
        keep |= ok
    return keep


def best_of(i: np.ndarray, score: np.ndarray, j: np.ndarray, k: int) -> np.ndarray:
    """Places of each i's k highest scores, ties to the lowest j."""
    order = np.lexsort((j, -score, i))
    start = np.r_[True, i[order][1:] != i[order][:-1]] if len(order) else np.empty(0, bool)
    first = np.flatnonzero(start)
    rank = np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)]))
    return order[rank < k]


def pair_tiles(rows: DataFrame, row_id: str, vector: str, keep: Sequence[str] = (), ordered: bool = False, digits: int = 6, rules=None, k: int | None = None, block: int | None = None) -> DataFrame:
    """(i, j, keep_i…, keep_j…, sim): rounded dot products of all pairs i < j, or of i <> j if ordered.

    rules: pairs are kept that satisfy one of these (columns that are equal, columns that differ). k: only the k most
    similar of each i, ties to the lowest j; needs ordered. Vectors are finite and of one length.
    """
    keep = list(dict.fromkeys(keep))
    if k is not None:
        return best_pairs(rows, row_id, vector, k, keep, rules, digits=digits, block=block).drop("r")
    block = block or BLOCK
    used = list(dict.fromkeys([*keep, *(c for same, diff in rules or () for c in (*same, *diff))]))
    blocks = n_blocks(rows.count(), block)
    rows = rows.select(F.col(row_id).alias("__id"), F.col(vector).alias("__u"), *used).withColumn("__block", _block("__id", blocks))
    dealt = rows.withColumn("__o", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.withColumns({"__a": F.least("__block", "__o"), "__b": F.greatest("__block", "__o")}).drop("__o")
    kind = dict(rows.dtypes)["__id"]
    schema = ", ".join(x for x in (f"i {kind}, j {kind}", _fields(rows, keep, lambda c: f"{c}_i"), _fields(rows, keep, lambda c: f"{c}_j"), "sim double") if x)

    names = ["i", "j", *(f"{c}_i" for c in keep), *(f"{c}_j" for c in keep), "sim"]

    def product(df: pd.DataFrame) -> pd.DataFrame:
        a, b = df["__a"].iloc[0], df["__b"].iloc[0]
        left, right = (df[df["__block"] == x].reset_index(drop=True) for x in (a, b))
        parts = []
        for lo in range(0, len(left), 256):  # a strip of the tile at a time
            strip = left.iloc[lo : lo + 256].reset_index(drop=True)
            sim = np.round(_matrix(strip["__u"]) @ _matrix(right["__u"]).T, digits) + 0.0 if len(right) else np.empty((len(strip), 0))
            x, y = strip["__id"].to_numpy(), right["__id"].to_numpy()
            if a == b:
                p, q = np.nonzero(x[:, None] < y[None, :])
            else:
                p, q = (v.ravel() for v in np.indices(sim.shape))
            sims = sim[p, q]
            if ordered:
                both = [(strip, right, p, q), (right, strip, q, p)]
            else:
                swap = x[p] > y[q]
                both = [(strip, right, p[~swap], q[~swap]), (right, strip, q[swap], p[swap])]
                sims = [sims[~swap], sims[swap]]
            for n, (one, other, r, s) in enumerate(both):
                value = sims if ordered else sims[n]
                if rules is not None:
                    ok = _rule(one, other, r, s, rules)
                    r, s, value = r[ok], s[ok], value[ok]
                one_r, other_s = one.take(r), other.take(s)
                out = {"i": one_r["__id"].array, "j": other_s["__id"].array}
                out |= {f"{c}_i": one_r[c].array for c in keep} | {f"{c}_j": other_s[c].array for c in keep}
                parts.append(pd.DataFrame(out | {"sim": value}))
        return pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({c: [] for c in names})

    return dealt.groupBy("__a", "__b").applyInPandas(product, schema)


def apart(df: DataFrame) -> DataFrame:
    """The same columns under identities of their own, so that a table can meet what came of itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])


# ---------------------------------------------------------------- nearest neighbours


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances by one product; rounding is left to the caller's slack."""
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2.0 * (x @ y.T), 0.0)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of paired rows, summed dimension by dimension."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        gap = x[:, d] - y[:, d]
        total += gap * gap
    return np.sqrt(total)


def _slack(x: np.ndarray, y: np.ndarray) -> float:
    """What rounding can move a squared distance of `_distances` by."""
    scale = max((x * x).sum(1).max(initial=0.0), (y * y).sum(1).max(initial=0.0))
    return 1e-12 * (1.0 + x.shape[1]) * (scale + 1e-300)


def pivots_of(points: DataFrame, row_id: str, vector: str, count: int, seed: int = 0) -> np.ndarray:
    """Vectors of `count` rows, the first in a hash order of their ids: a bounded sample, denser where rows are."""
    first = points.select(F.xxhash64(F.lit(seed), F.col(row_id)).alias("h"), F.col(row_id).alias("id"), F.col(vector).alias("v")).orderBy("h", "id").limit(count).toPandas()
    x = _matrix(first["v"])
    return np.unique(x, axis=0) if len(x) else x


def _visits(x: np.ndarray, radius: np.ndarray, to: np.ndarray, own: np.ndarray, between: np.ndarray, cells: np.ndarray, near: np.ndarray, far: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, cell) where the cell may hold something within the row's radius.

    to: distances from rows to pivots. A cell's rows lie between near and far from its pivot, and nearer to it than to any
    other pivot, so nearer than to the row's own.
    """
    t = to[:, cells]
    ring = np.maximum(t - far[None, :], near[None, :] - t) - 4.0 * np.sqrt(slack)
    apart = between[own][:, cells]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = np.where(apart > 0, (t**2 - to[np.arange(len(x)), own][:, None] ** 2 - 4.0 * slack) / (2.0 * apart), 0.0)
    rows, places = np.nonzero(np.maximum(ring, plane) <= radius[:, None])
    return rows, cells[places]


def nearest_neighbours(points: DataFrame, row_id: str, vector: str, k: int, by: Sequence[str] = (), pivots: int | None = None, block: int = BLOCK, seed: int = 0, counted: list | None = None) -> DataFrame:
    """(by…, id, o_id, d, r): the k nearest other rows of each row by Euclidean distance, ties by id; as all pairs would say.

    1. Rows go to the cell of their nearest pivot, cells to blocks of bounded size; the k nearest within a row's block bound
       the distance of its k-th neighbour. 2. The row visits the blocks of every cell that the bound does not rule out; each
       visit returns k rows at most. Where the bounds rule out less than half of all pairs, all pairs are compared in tiles
       instead, as visits would carry each row into nearly every cell. Of rows with one vector, only the k + 1 of lowest id can be anyone's neighbours, so a
       crowd of equal rows is not compared with itself. `counted` gets the number of pairs whose distance was computed.
    """
    by = list(by)
    rows = points.select(*by, F.col(row_id).alias("id"), F.transform(vector, lambda v: v.cast("double")).alias("v"))
    kinds = dict(rows.dtypes)
    total = rows.count()
    per_group = total // max(1, rows.select(*by).distinct().count()) if by else total
    x = pivots_of(rows, "id", "v", min(pivots or PIVOTS, PIVOTS, max(1, per_group // PER_CELL)) if total else 0, seed)
    if not len(x):
        return rows.select(*by, "id", F.col("id").alias("o_id"), F.lit(0.0).alias("d"), F.lit(1).alias("r")).limit(0)
    between = np.sqrt(_distances(x, x))
    keys = _fields(rows, by, str)
    head = f"{keys}, " if keys else ""

    def cell(frames):
        for df in frames:
            to = _distances(_matrix(df["v"]), x) if len(df) else np.empty((0, len(x)))
            yield df.assign(cell=to.argmin(1).astype("int32"), to=np.sqrt(to.min(1)) if len(df) else [])

    placed = rows.mapInPandas(cell, f"{head}id {kinds['id']}, v array<double>, cell int, to double")
    # of equal vectors the k + 1 lowest ids are candidates; two levels, as one vector may be a large part of all rows
    low = lambda part: F.row_number().over(Window.partitionBy(*by, "cell", "__h", "v", part).orderBy("id")) <= k + 1
    placed = placed.withColumns({"__h": F.xxhash64("v"), "__salt": F.pmod(F.xxhash64("id"), F.lit(32))})
    placed = placed.withColumn("__low", low("__salt"))
    placed = placed.withColumn("__salt", F.when(F.col("__low"), F.lit(-1)).otherwise(F.col("__salt")))
    placed = cut(placed.select(*by, "id", "v", "cell", "to", (F.col("__low") & low("__salt")).alias("candidate")))
    others = placed.where("candidate").drop("candidate")
    placed = placed.drop("candidate")
    sizes = others.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("near"), F.max("to").alias("far"))
    crowd = placed.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("rows"))
    sizes = sizes.join(crowd.withColumnsRenamed({c: f"__{c}" for c in [*by, "cell"]}), _null_safe([*by, "cell"])).drop(*[f"__{c}" for c in [*by, "cell"]])
    sizes = sizes.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    sizes = cut(sizes.withColumn("parts", F.ceil(F.col("rows") / (F.col("blocks") * block)).cast("int")).drop("rows"))

    def with_sizes(df: DataFrame, sizes: DataFrame) -> DataFrame:
        right = sizes.select(*[F.col(c).alias(f"__{c}") for c in [*by, "cell"]], *[c for c in sizes.columns if c not in [*by, "cell"]])
        cond = F.col("cell") == F.col("__cell")
        for c in by:
            cond = cond & F.col(c).eqNullSafe(F.col(f"__{c}"))
        return df.join(right, cond).drop("__cell", *[f"__{c}" for c in by])

    deal = lambda what, salt: F.pmod(F.xxhash64(F.lit(seed + salt), "id"), F.col(what)).cast("int")
    blocked = with_sizes(others, sizes.select(*by, "cell", "blocks", "parts")).withColumn("block", deal("blocks", 1))

    # 1: a bound for every row from one block of its cell
    asked = with_sizes(placed, sizes.select(*by, "cell", "blocks", "parts")).withColumns({"block": deal("blocks", 1), "part": deal("parts", 2)}).drop("blocks", "parts")
    tile = [*by, "cell", "block", "part"]
    copies = blocked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("blocks", "parts")
    blocked = blocked.drop("blocks", "parts")

    def radius(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        a, b = _matrix(ask["v"]), _matrix(have["v"], 0)
        out = np.full(len(a), np.inf)
        if len(b) > k:
            for lo in range(0, len(a), 512):
                d = _distances(a[lo : lo + 512], b) + _slack(a[lo : lo + 512], b)
                out[lo : lo + 512] = np.sqrt(np.partition(d, k, axis=1)[:, k])  # the row itself may be among them
        return ask[[*by, "id", "v", "cell"]].assign(radius=out)

    bounded = cut(asked.groupBy(*tile).cogroup(apart(copies).groupBy(*tile)).applyInPandas(radius, f"{head}id {kinds['id']}, v array<double>, cell int, radius double"))

    # 2: the cells that a row has to visit; cells of its group only
    stat_of = lambda df: tuple(df[c].to_numpy(float) for c in ("cell", "n", "near", "far"))
    if by:
        packed = sizes.groupBy(*by).agg(F.collect_list(F.struct("cell", "n", "near", "far")).alias("s"))
        packed = packed.select(*[F.col(c).alias(f"__{c}") for c in by], *[F.col(f"s.{c}").cast("array<double>").alias(f"s_{c}") for c in ("cell", "n", "near", "far")])
        joined = bounded.join(packed, _null_safe(by)).drop(*[f"__{c}" for c in by])
        every = None
    else:
        joined, every = bounded, stat_of(sizes.select("cell", "n", "near", "far").toPandas())  # a row for each pivot

    def places(df: pd.DataFrame):
        """(rows of a group, their radius, place and cell of each visit, rows of that cell)"""
        for _, part in df.groupby(by, dropna=False) if by else [(None, df)] if len(df) else []:
            which, n, near, far = every or tuple(part[f"s_{c}"].iloc[0] for c in ("cell", "n", "near", "far"))
            which = np.asarray(which).astype(int)
            v, own, r = _matrix(part["v"]), part["cell"].to_numpy(), part["radius"].to_numpy().copy()
            to, slack = np.sqrt(_distances(v, x)), _slack(v, x)
            lost = np.isinf(r)
            if lost.any():  # too few rows in the block: the nearest cells that have k + 1 rows between them
                reach = to[lost][:, which] + far[None, :] + 4.0 * np.sqrt(slack)
                order = np.argsort(reach, axis=1)
                enough = np.cumsum(n[order], axis=1) > k
                place = np.take_along_axis(order, enough.argmax(1)[:, None], 1)
                r[lost] = np.where(enough.any(1), np.take_along_axis(reach, place, 1)[:, 0], np.inf)
            a, c = _visits(v, r, to, own, between, which, near, far, slack)
            size = np.zeros(len(x))
            size[which] = n
            yield part, r, a, c, size[c]

    def visit(frames):
        for df in frames:
            out = [df.iloc[:0][[*by, "id", "v", "cell", "radius"]]]
            out += [part.iloc[a][[*by, "id", "v"]].assign(cell=c.astype("int32"), radius=r[a]) for part, r, a, c, _ in places(df)]
            yield pd.concat(out)

    def weigh(frames):
        for df in frames:
            yield pd.DataFrame({"pairs": [float(sum(n.sum() for *_, n in places(df)))]})

    if not by and total > block:
        pairs = joined.mapInPandas(weigh, "pairs double").agg(F.sum("pairs")).first()[0] or 0.0
        if pairs > 0.5 * total * total:
            if counted is not None:
                counted.append(total * total)
            found = best_pairs(rows, "id", "v", k, kind="euclidean", digits=None)
            return found.select(F.col("i").alias("id"), F.col("j").alias("o_id"), "d", "r")

    visits = cut(joined.mapInPandas(visit, f"{head}id {kinds['id']}, v array<double>, cell int, radius double"))
    asked_of = visits.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("asked"))
    plan = sizes.drop("parts").join(asked_of.withColumnsRenamed({c: f"__{c}" for c in [*by, "cell"]}), _null_safe([*by, "cell"])).drop(*[f"__{c}" for c in [*by, "cell"]])
    plan = plan.withColumn("parts", F.ceil(F.col("asked") / block).cast("int"))
    if counted is not None:
        counted.append(int(plan.agg(F.coalesce(F.sum(F.col("asked") * F.col("n")), F.lit(0))).first()[0]))
    questions = with_sizes(visits, plan.select(*by, "cell", "blocks", "parts")).withColumn("part", deal("parts", 3))
    questions = questions.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks", "parts")
    answers = with_sizes(blocked, plan.select(*by, "cell", "parts")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def closest(ask: pd.DataFrame, have: pd.DataFrame) -> pd.DataFrame:
        a, b = _matrix(ask["v"]), _matrix(have["v"], 0)
        out = []
        for lo in range(0, len(a) if len(b) else 0, 512):
            q = a[lo : lo + 512]
            limit = ask["radius"].to_numpy()[lo : lo + 512]
            near = _distances(q, b) - 2.0 * _slack(q, b) <= (limit**2 * (1 + 1e-9))[:, None]
            p, s = np.nonzero(near)
            i, j = ask["id"].to_numpy()[lo : lo + 512][p], have["id"].to_numpy()[s]
            other = i != j
            p, s, i, j = p[other], s[other], i[other], j[other]
            d = _exact(q[p], b[s])
            best = best_of(i, -d, j, k)
            out.append(pd.DataFrame({**{c: ask[c].iloc[0] for c in by}, "id": i[best], "o_id": j[best], "d": d[best]}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in [*by, "id", "o_id", "d"]})

    found = questions.groupBy(*tile).cogroup(apart(answers).groupBy(*tile)).applyInPandas(closest, f"{head}id {kinds['id']}, o_id {kinds['id']}, d double")
    rank = F.row_number().over(Window.partitionBy(*by, "id").orderBy("d", "o_id"))
    return found.withColumn("r", rank).where(F.col("r") <= k)


def _null_safe(columns: Sequence[str]):
    cond = None
    for c in columns:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        cond = one if cond is None else cond & one
    return cond
