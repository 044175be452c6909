"""Variance, integration and calibration metrics, and clustering of consensus profiles."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from platewise.operators.folds import SCALE, best_pairs, class_sums
from platewise.operators.stats import correlation, to_long


def anova_r2(df: DataFrame, components: Sequence[str], key: str) -> DataFrame:
    """(feature, r2, variance): share of each component's variance between the levels of a label; variance has ddof 1."""
    long = to_long(df.withColumn("__k", F.coalesce(F.col(key).cast("string"), F.lit("\0"))), ["__k"], components)
    each = long.groupBy("feature", "__k").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    t = each.groupBy("feature").agg(F.sum("n").alias("N"), F.sum(F.col("n") * F.col("v")).alias("w"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.count(F.lit(1)).alias("g"))
    between = F.col("ss") - F.col("s") * F.col("s") / F.col("N")
    total = between + F.col("w")
    return t.select("feature", F.when(F.col("g") > 1, between / F.when(total > 0, total)).alias("r2"), (total / (F.col("N") - 1)).alias("variance"))


def pearson_r2(df: DataFrame, components: Sequence[str], key: str) -> DataFrame:
    """(feature, r2, variance) against a numeric key; 0 if constant."""
    stats = [F.struct(F.lit(c).alias("feature"), F.coalesce(F.pow(correlation(c, key), F.lit(2.0)), F.lit(0.0)).alias("r2"), F.var_samp(c).alias("variance")) for c in components]
    return df.agg(F.array(*stats).alias("a")).select(F.explode("a").alias("s")).select("s.*")


def pc_regression(df: DataFrame, components: Sequence[str], key: str) -> DataFrame:
    """(key, score): R squared of the components weighted by their variance; NULL for a constant label."""
    numeric = dict(df.dtypes)[key] in ("double", "float", "int", "bigint", "smallint")
    each = pearson_r2(df, components, key) if numeric else anova_r2(df, components, key)
    return each.agg((F.sum(F.col("r2") * F.col("variance")) / F.sum("variance")).alias("score")).select(F.lit(key).alias("key"), "score")


def batch_variance_explained(df: DataFrame, components: Sequence[str], keys: Sequence[str]) -> DataFrame:
    out = None
    for k in keys:
        part = pc_regression(df, components, k)
        out = part if out is None else out.unionByName(part)
    return out


def variance_carried(df: DataFrame, components: Sequence[str], targets: Sequence[str], row_id: str, n_splits: int = 5, penalty: float = 1.0) -> DataFrame:
    """(feature, r2): out-of-fold ridge R squared of each named feature on the components; folds by a hash of the id.

    Normal equations are summed for each fold in one aggregation; only those reach the driver.
    """
    comps, k = list(components), len(components) + 1
    x = [F.lit(1.0), *[F.col(c).cast("double") for c in comps]]
    fold = F.pmod(F.xxhash64(row_id), F.lit(n_splits))
    rows = df.dropna(subset=[*comps, *targets]).select(fold.alias("fold"), F.array(*x).alias("x"), F.array(*[F.col(t).cast("double") for t in targets]).alias("y"))
    sums = rows.groupBy("fold").agg(
        F.array(*[F.sum(F.col("x")[i] * F.col("x")[j]) for i in range(k) for j in range(k)]).alias("xx"), F.array(*[F.sum(F.col("x")[i] * F.col("y")[j]) for i in range(k) for j in range(len(targets))]).alias("xy"),
        F.array(*[F.sum(F.col("y")[j] * F.col("y")[j]) for j in range(len(targets))]).alias("yy"),
    ).collect()
    xx = {r["fold"]: np.array(r["xx"]).reshape(k, k) for r in sums}
    xy = {r["fold"]: np.array(r["xy"]).reshape(k, len(targets)) for r in sums}
    yy = {r["fold"]: np.array(r["yy"]) for r in sums}
    sse = np.zeros(len(targets))
    ridge = np.eye(k) * penalty
    ridge[0, 0] = 0.0
    for f in xx:
        a, b = sum(xx.values()) - xx[f], sum(xy.values()) - xy[f]
        beta = np.linalg.solve(a + ridge + 1e-12 * np.eye(k), b)
        sse += yy[f] - 2 * (beta * xy[f]).sum(0) + np.einsum("ij,ik,kj->j", beta, xx[f], beta)
    n, sy = sum(m[0, 0] for m in xx.values()), sum(m[0] for m in xy.values())
    tss = sum(yy.values()) - sy**2 / max(1, n)
    out = [(t, float(1.0 - s / v) if v > 0 else None) for t, s, v in zip(targets, sse, tss)]
    return df.sparkSession.createDataFrame(out, "feature string, r2 double")


def silhouette(pairs: DataFrame, label: str) -> DataFrame:
    """(score): mean silhouette from ordered pairs with label_i, label_j and distance d."""
    mean = pairs.groupBy("i", F.col(f"{label}_i").alias("own"), F.col(f"{label}_j").alias("other")).agg(F.avg("d").alias("m"))
    row = mean.groupBy("i").agg(F.max(F.when(F.col("own") == F.col("other"), F.col("m"))).alias("a"), F.min(F.when(F.col("own") != F.col("other"), F.col("m"))).alias("b"))
    return row.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.when(F.greatest("a", "b") > 0, F.greatest("a", "b")), F.lit(0.0))).alias("score"))


def lisi(pairs: DataFrame, label: str, k: int = 30) -> DataFrame:
    """(score): median over rows of the inverse Simpson index of the labels of the k nearest (equal weights)."""
    near = pairs.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("r") <= k)
    each = near.groupBy("i", f"{label}_j").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("i"))
    return each.withColumn("p2", share * share).groupBy("i").agg((1.0 / F.sum("p2")).alias("lisi")).agg(F.median("lisi").alias("score"))


def silhouette_rows(df: DataFrame, row_id: str, vector: str, label: str) -> DataFrame:
    """`silhouette` from the rows by rounded Euclidean distances, which are summed for each row and label in tiles."""
    sums = class_sums(df.withColumn("__other", F.col(label)), row_id, vector, ["__other"], "euclidean").withColumn("m", F.col("s") / F.col("n") / float(SCALE))
    own = df.select(F.col(row_id).alias("__i"), F.col(label).alias("__own"))
    rows = sums.join(own, F.col("id") == F.col("__i"))
    row = rows.groupBy("id").agg(F.max(F.when(F.col("__own") == F.col("__other"), F.col("m"))).alias("a"), F.min(F.when(F.col("__own") != F.col("__other"), F.col("m"))).alias("b"))
    return row.agg(F.avg(F.coalesce((F.col("b") - F.col("a")) / F.when(F.greatest("a", "b") > 0, F.greatest("a", "b")), F.lit(0.0))).alias("score"))


def lisi_rows(df: DataFrame, row_id: str, vector: str, label: str, k: int = 30) -> DataFrame:
    """`lisi` from the rows: the k nearest by rounded Euclidean distance are found in tiles."""
    return lisi(best_pairs(df, row_id, vector, k, [label], kind="euclidean").drop("r"), label, k)


def evaluate_integration(bio: dict[str, float], batch: dict[str, float], map_score: float | None = None) -> dict[str, float]:
    """Totals of a metric panel: 0.4 batch + 0.6 biology, and the same with mAP among the biology scores."""
    b, c = float(np.mean(list(bio.values()))) if bio else math.nan, float(np.mean(list(batch.values()))) if batch else math.nan
    out = {**bio, **batch, "bio": b, "batch": c, "total": 0.4 * c + 0.6 * b}
    if map_score is not None:
        with_map = float(np.mean([*bio.values(), map_score]))
        out |= {"map": map_score, "total_with_map": 0.4 * c + 0.6 * with_map}
    return out


def diagnose_testing(df: DataFrame, caller: Callable[[DataFrame, Column], DataFrame], control: Column, row_id: str, n_draws: int = 8, threshold: float = 0.05) -> DataFrame:
    """(check, value, expected, verdict, note): controls are split into pseudo-groups by hash and called as treatments;
    the share of small p-values and of hits should stay near the threshold."""
    small, hits, n = 0.0, 0.0, 0
    for d in range(n_draws):
        group = F.pmod(F.xxhash64(F.lit(d), row_id), F.lit(4))
        rows = df.where(control).withColumns({"__pseudo": F.concat(F.lit("g"), group.cast("string")), "__ref": group == 0})
        out = caller(rows, F.col("__ref")).agg(F.avg((F.col("pvalue") <= threshold).cast("double")), F.avg((F.col("qvalue") <= threshold).cast("double"))).first()
        if out[0] is not None:
            small, hits, n = small + out[0], hits + out[1], n + 1
    rows = [("null p-values below threshold", small / max(1, n), threshold), ("null hits", hits / max(1, n), threshold)]
    table = [(c, float(v), float(e), "ok" if v <= 2 * e + 0.05 else "anti-conservative", f"{n} draws") for c, v, e in rows]
    return df.sparkSession.createDataFrame(table, "check string, value double, expected double, verdict string, note string")


# ---------------------------------------------------------------- clustering of profiles


def linkage(d: np.ndarray, method: str = "average") -> np.ndarray:
    """Merges (a, b, height, size) of a distance matrix by Lance-Williams updates; ties to the first pair."""
    n = len(d)
    d = d.astype(float).copy()
    if not np.isfinite(d).all():
        raise ValueError("distances must be finite")
    np.fill_diagonal(d, np.inf)
    ids, size, live, out = list(range(n)), np.ones(n), np.ones(n, bool), []
    for step in range(n - 1):
        i, j = divmod(int(np.where(live[:, None] & live[None, :], d, np.inf).argmin()), n)
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        a, b = sorted((ids[i], ids[j]))
        out.append((a, b, h, size[i] + size[j]))
        if method == "average":
            new = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        elif method == "single":
            new = np.minimum(d[i], d[j])
        elif method == "complete":
            new = np.maximum(d[i], d[j])
        else:  # ward, on Euclidean distances
            t = size[i] + size[j] + size
            new = np.sqrt(np.maximum(0.0, ((size[i] + size) * d[i] ** 2 + (size[j] + size) * d[j] ** 2 - size * h * h) / t))
        d[i], d[:, i] = new, new
        d[i, i], live[j] = np.inf, False
        size[i] += size[j]
        ids[i] = n + step
    return np.array(out).reshape(-1, 4)


def cut_tree(z: np.ndarray, n: int, n_clusters: int | None = None, height: float | None = None) -> np.ndarray:
    """Cluster of each leaf, numbered by first appearance."""
    keep = n - n_clusters if n_clusters is not None else int((z[:, 2] <= height).sum())
    parent = list(range(n + len(z)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for k in range(keep):
        parent[root(int(z[k, 0]))] = parent[root(int(z[k, 1]))] = n + k
    names: dict[int, int] = {}
    return np.array([names.setdefault(root(i), len(names)) for i in range(n)])


def silhouette_matrix(d: np.ndarray, labels: np.ndarray) -> float:
    out = []
    for i in range(len(d)):
        own = (labels == labels[i]) & (np.arange(len(d)) != i)
        if not own.any():
            out.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, labels == x].mean() for x in set(labels) - {labels[i]})
        out.append((b - a) / max(a, b) if max(a, b) > 0 else 0.0)
    return float(np.mean(out))


def adjusted_rand(a: np.ndarray, b: np.ndarray) -> float:
    """Agreement of two labelings of the same rows, 1 if equal, 0 as by chance."""
    _, x = np.unique(a, return_inverse=True)
    _, y = np.unique(b, return_inverse=True)
    table = np.zeros((x.max() + 1, y.max() + 1))
    np.add.at(table, (x, y), 1)
    pairs = lambda n: (n * (n - 1) / 2).sum()
    rows, cols, both, every = pairs(table.sum(1)), pairs(table.sum(0)), pairs(table), len(a) * (len(a) - 1) / 2
    chance = rows * cols / every
    most = (rows + cols) / 2
    return float((both - chance) / (most - chance)) if most != chance else 1.0


def cluster(profiles: DataFrame, name: str, features: Sequence[str], metric: str = "correlation", method: str = "average", n_clusters: int | None = None, cut: float | None = None, max_rows: int = 5000, criterion: str = "silhouette", n_draws: int = 10, seed: int = 0) -> tuple[DataFrame, np.ndarray]:
    """(name, cluster) and the linkage of consensus profiles; the number of clusters by `criterion` if not given.

    silhouette: the largest mean silhouette. stability: the largest mean adjusted Rand index between the clusters of all
    profiles and those of random four fifths of them. The smaller number wins ties.

    Clustering needs all distances, so it takes consensus profiles of a checked number (max_rows).
    """
    pdf = profiles.select(name, *features).orderBy(name).limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ValueError(f"more than {max_rows} profiles; take a consensus first")
    x = np.nan_to_num(pdf[list(features)].to_numpy(float))
    if metric == "correlation":
        x = x - x.mean(1, keepdims=True)
    if metric in ("correlation", "cosine"):
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        d = np.clip(1.0 - u @ u.T, 0.0, 2.0)
    else:
        d = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T))
    np.fill_diagonal(d, 0.0)
    z = linkage(d, method)
    if cut is not None:
        labels = cut_tree(z, len(d), height=cut)
    elif n_clusters is not None:
        labels = cut_tree(z, len(d), n_clusters)
    else:
        ks = range(2, min(len(d) - 1, 25) + 1)
        if criterion == "stability":
            rng, agree = np.random.default_rng(seed), dict.fromkeys(ks, 0.0)
            for _ in range(n_draws):
                part = np.sort(rng.choice(len(d), max(2, len(d) * 4 // 5), replace=False))
                own = linkage(d[np.ix_(part, part)], method)
                for k in ks:
                    if k < len(part):
                        agree[k] += adjusted_rand(cut_tree(z, len(d), k)[part], cut_tree(own, len(part), k)) / n_draws
            tries = [(round(v, 12), -k) for k, v in agree.items()]
        elif criterion == "silhouette":
            tries = [(silhouette_matrix(d, cut_tree(z, len(d), k)), -k) for k in ks]
        else:
            raise ValueError("criterion is silhouette or stability")
        labels = cut_tree(z, len(d), -max(tries)[1]) if tries else np.zeros(len(d), int)
    kind = dict(profiles.dtypes)[name]
    out = profiles.sparkSession.createDataFrame(pd.DataFrame({name: pdf[name], "cluster": labels.astype(int)}), f"`{name}` {kind}, cluster long")
    return out, z


def communities(edges: DataFrame, resolution: float = 1.0, max_edges: int = 2_000_000, seed: int = 0) -> DataFrame:
    """(id, cluster): modularity communities of a weighted neighbour graph (a, b, weight) by local moves and merging.

    The graph of consensus profiles is bounded (max_edges, checked) and handled on the driver.
    """
    e = edges.select("a", "b", "weight").limit(max_edges + 1).toPandas()
    if len(e) > max_edges:
        raise ValueError(f"more than {max_edges} edges; take a consensus first")
    nodes = sorted(set(e["a"]) | set(e["b"]))
    at = {x: i for i, x in enumerate(nodes)}
    links = [(at[a], at[b], float(w)) for a, b, w in e.itertuples(index=False)]
    label = np.arange(len(nodes))
    rng = np.random.default_rng(seed)
    while True:
        k = int(label.max()) + 1 if len(label) else 0
        adj: list[dict[int, float]] = [{} for _ in range(k)]
        for a, b, w in links:
            a, b = int(label[a]), int(label[b])
            adj[a][b] = adj[a].get(b, 0.0) + w
            if a != b:
                adj[b][a] = adj[b].get(a, 0.0) + w
        deg = np.array([sum(v * (2 if y == x else 1) for y, v in n.items()) for x, n in enumerate(adj)])
        two_m, com, tot, moved = max(deg.sum(), 1e-300), np.arange(k), deg.copy(), False
        for _ in range(20):
            again = False
            for x in rng.permutation(k):
                near: dict[int, float] = {}
                for y, w in adj[x].items():
                    if y != x:
                        near[com[y]] = near.get(com[y], 0.0) + w
                old = com[x]
                tot[old] -= deg[x]
                gain = {c: w - resolution * deg[x] * tot[c] / two_m for c, w in {old: near.get(old, 0.0), **near}.items()}
                new = max(sorted(gain), key=gain.get)
                if gain[new] <= gain[old] + 1e-12:
                    new = old
                tot[new] += deg[x]
                if new != old:
                    com[x], again, moved = new, True, True
            if not again:
                break
        _, com = np.unique(com, return_inverse=True)
        label = com[label] if len(label) else label
        if not moved:
            break
    names: dict[int, int] = {}
    rows = [(x, names.setdefault(int(c), len(names))) for x, c in zip(nodes, label)]
    return edges.sparkSession.createDataFrame(rows, f"id {dict(edges.dtypes)['a']}, cluster long")


def phate(profiles: DataFrame, name: str, features: Sequence[str], n_components: int = 2, knn: int = 5, decay: float = 40.0, t: int = 10, max_rows: int = 3000) -> DataFrame:
    """(name, phate1…): alpha-decay affinities, diffusion to power t, log potential, classical scaling; bounded profiles."""
    pdf = profiles.select(name, *features).orderBy(name).limit(max_rows + 1).toPandas()
    if len(pdf) > max_rows:
        raise ValueError(f"more than {max_rows} profiles")
    x = np.nan_to_num(pdf[list(features)].to_numpy(float))
    d = np.sqrt(np.maximum(0.0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T))
    eps = np.maximum(np.sort(d, 1)[:, min(knn, len(d) - 1)], 1e-12)
    k = np.exp(-((d / eps[:, None]) ** decay))
    k = (k + k.T) / 2.0
    p = np.linalg.matrix_power(k / k.sum(1, keepdims=True), t)
    u = -np.log(p + 1e-7)
    g = ((u[:, None, :] - u[None, :, :]) ** 2).sum(2) if len(u) <= 400 else np.maximum(0.0, (u * u).sum(1)[:, None] + (u * u).sum(1)[None, :] - 2 * u @ u.T)
    c = np.eye(len(g)) - 1.0 / len(g)
    w, v = np.linalg.eigh(-0.5 * c @ g @ c)
    y = v[:, ::-1][:, :n_components] * np.sqrt(np.maximum(w[::-1][:n_components], 0.0))
    y = y * np.where(y[np.abs(y).argmax(0), np.arange(y.shape[1])] < 0, -1.0, 1.0)
    out = pd.DataFrame({name: pdf[name], **{f"phate{i + 1}": y[:, i] for i in range(n_components)}})
    return profiles.sparkSession.createDataFrame(out, f"`{name}` {dict(profiles.dtypes)[name]}" + "".join(f", phate{i + 1} double" for i in range(n_components)))


def robust_covariance(x: np.ndarray, support: float = 0.5, n_starts: int = 50, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(location, scatter) of the subset of least determinant: random starts, concentration steps, consistency factor."""
    from platewise.functions.special import gammaincc

    n, p = x.shape
    h = min(n, max(math.ceil(support * n), (n + p + 1) // 2))
    rng, best = np.random.default_rng(seed), (np.inf, x.mean(0), np.cov(x.T).reshape(p, p))
    for _ in range(n_starts):
        rows = rng.choice(n, min(n, p + 1), replace=False)
        for _ in range(30):
            m, c = x[rows].mean(0), np.cov(x[rows].T).reshape(p, p) + 1e-12 * np.eye(p)
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.pinv(c), x - m)
            new = np.argsort(d, kind="stable")[:h]
            if len(new) == len(rows) and (np.sort(new) == np.sort(rows)).all():
                break
            rows = new
        m, c = x[rows].mean(0), np.cov(x[rows].T).reshape(p, p)
        det = np.linalg.slogdet(c)[1]
        if det < best[0]:
            best = (det, m, c)
    q, lo, hi = h / n, 0.0, 1000.0
    for _ in range(200):  # chi-square quantile by bisection
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - float(gammaincc(p / 2, mid / 2)) < q else (lo, mid)
    factor = q / max(1e-12, 1 - float(gammaincc(p / 2 + 1, lo / 2))) if q < 1 else 1.0
    return best[1], best[2] * factor
