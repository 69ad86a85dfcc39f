"""Hierarchical mixtures of normals: priors, cluster parameters, predictive densities, sampling.

Vectors lie in groups; a group's vectors sit at tables, tables are served
dishes, and a dish is a normal with a normal-inverse-Wishart prior.  A model is
a table of vectors ``(vec_id, group_id, table_id, dish_id, x)``; the dishes'
sufficient statistics (n, sum, sum of outer products) are sums, so partial sums
of batches are combined and no dish is gathered.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Prior:
    mu: np.ndarray
    scatter: np.ndarray
    kappa: float
    nu: float
    tau: float = 1.0
    gamma: float = 1.0


@dataclass(frozen=True)
class Dish:
    n: int
    tables: int
    mu: np.ndarray
    scatter: np.ndarray
    kappa: float
    nu: float


def moments(vectors: DataFrame, by: str) -> DataFrame:
    """``(by, n, total, outer)`` for vectors ``x``: counts, sums and flattened sums of outer products."""

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, part in frame.groupby("k", sort=False, dropna=False):
                x = np.array(part["x"].tolist(), float)
                rows.append((key, len(x), x.sum(axis=0), (x.T @ x).ravel()))
            yield pd.DataFrame(rows, columns=["k", "n", "total", "outer"])

    def whole(part: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(
            {"k": [part["k"].iloc[0]], "n": [int(part["n"].sum())], "total": [np.sum(part["total"].tolist(), axis=0)], "outer": [np.sum(part["outer"].tolist(), axis=0)]}
        )

    schema = "k long, n long, total array<double>, outer array<double>"
    rows = vectors.where("x is not null").select(F.col(by).cast("long").alias("k"), F.col("x").cast("array<double>").alias("x"))
    return rows.mapInPandas(partial, schema).groupBy("k").applyInPandas(whole, schema).withColumnRenamed("k", by)


def niw_prior(n: int, total: np.ndarray, outer: np.ndarray, kappa: float = 1.0, nu: float | None = None) -> Prior:
    """Prior with the mean and scatter of all vectors."""
    d = len(total)
    mean = np.asarray(total) / n
    scatter = np.asarray(outer).reshape(d, d) - n * np.outer(mean, mean)
    return Prior(mean, scatter / n, kappa, nu if nu is not None else d + 2.0)


def uninformative(mean: np.ndarray, scale: float = 1.0, kappa: float = 0.01) -> Prior:
    """Prior with a scatter proportional to the identity."""
    d = len(mean)
    return Prior(np.asarray(mean, float), scale * np.eye(d), kappa, d + 0.1)


def posterior(prior: Prior, n: int, total: np.ndarray, outer: np.ndarray, tables: int = 1) -> Dish:
    """Parameters of a dish with n vectors."""
    d = len(prior.mu)
    if n == 0:
        return Dish(0, tables, prior.mu, prior.scatter, prior.kappa, prior.nu)
    mean = np.asarray(total) / n
    inner = np.asarray(outer).reshape(d, d) - n * np.outer(mean, mean)
    off = mean - prior.mu
    kappa = prior.kappa + n
    scatter = prior.scatter + inner + prior.kappa * n / kappa * np.outer(off, off)
    return Dish(n, tables, (prior.kappa * prior.mu + n * mean) / kappa, scatter, kappa, prior.nu + n)


def without(dish: Dish, x: np.ndarray) -> Dish:
    """The dish's parameters with one of its vectors taken out."""
    kappa = dish.kappa - 1
    mu = (dish.kappa * dish.mu - x) / kappa
    scatter = dish.scatter - dish.kappa / kappa * np.outer(x - dish.mu, x - dish.mu)
    return Dish(dish.n - 1, dish.tables, mu, scatter, kappa, dish.nu - 1)


def log_predictive(x: np.ndarray, dish: Dish | Prior) -> np.ndarray:
    """Log density of each row of ``x``: a multivariate t with nu - d + 1 degrees of freedom."""
    x = np.atleast_2d(x)
    d = x.shape[1]
    df = dish.nu - d + 1
    scale = dish.scatter * (dish.kappa + 1) / (dish.kappa * df)
    low = np.linalg.cholesky(scale)
    z = np.linalg.solve(low, (x - dish.mu).T)
    log_det = 2 * np.log(np.diag(low)).sum()
    head = math.lgamma((df + d) / 2) - math.lgamma(df / 2) - d / 2 * math.log(df * math.pi) - log_det / 2
    return head - (df + d) / 2 * np.log1p((z * z).sum(axis=0) / df)


def log_marginal(prior: Prior, dish: Dish) -> float:
    """Log probability of all vectors of a dish."""
    d = len(prior.mu)
    multi = lambda a: d * (d - 1) / 4 * math.log(math.pi) + sum(math.lgamma(a - j / 2) for j in range(d))
    log_det = lambda m: np.linalg.slogdet(m)[1]
    return float(
        multi(dish.nu / 2)
        - multi(prior.nu / 2)
        + prior.nu / 2 * log_det(prior.scatter)
        - dish.nu / 2 * log_det(dish.scatter)
        + d / 2 * (math.log(prior.kappa) - math.log(dish.kappa))
        - dish.n * d / 2 * math.log(math.pi)
    )


def log_joint(x: np.ndarray, dish: Dish, prior: Prior) -> float:
    """Log density of all rows of ``x`` together, given a dish: what they add to its log probability."""
    total = dish.kappa * dish.mu - prior.kappa * prior.mu
    # the dish's sums, from its parameters
    outer = dish.scatter - prior.scatter + dish.kappa * np.outer(dish.mu, dish.mu) - prior.kappa * np.outer(prior.mu, prior.mu)
    more = posterior(prior, dish.n + len(x), total + x.sum(axis=0), (outer + x.T @ x).ravel())
    return log_marginal(prior, more) - log_marginal(prior, dish)


def mixed_vector(x: np.ndarray, model: dict[int, Dish], weights: dict[int, float], share: float) -> np.ndarray:
    """(1 - share) * x plus share times the mean of the dishes' centres, weighted by the vector's cluster probabilities."""
    known = {k: w for k, w in weights.items() if k in model and w > 0}
    if not known:
        return np.asarray(x, float)
    centre = sum(w * model[k].mu for k, w in known.items()) / sum(known.values())
    return (1 - share) * np.asarray(x, float) + share * centre


def log_probability(model: dict[int, Dish], prior: Prior) -> float:
    """Log probability of all vectors of a model given its clusters."""
    return sum(log_marginal(prior, d) for d in model.values())


def sample_scale(prior: Prior, sums: list[tuple[int, np.ndarray, np.ndarray]], name: str, rng: np.random.Generator) -> Prior:
    """``prior`` with ``kappa`` or ``nu`` drawn anew given the dishes' (n, total, outer), by slice sampling under 1 / x."""
    low = 0.0 if name == "kappa" else len(prior.mu) - 1.0

    def with_value(v: float) -> Prior:
        return Prior(**{**prior.__dict__, name: v})

    def log_f(v: float) -> float:
        new = with_value(v)
        return -math.log(v) + sum(log_marginal(new, posterior(new, *s)) for s in sums)

    return with_value(slice_sample(log_f, getattr(prior, name), 1.0, rng, low))


def to_json(prior: Prior, model: dict[int, Dish]) -> str:
    """A model's parameters as one JSON text."""
    plain = lambda d: {k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in d.__dict__.items()}
    return json.dumps({"prior": plain(prior), "dishes": {str(k): plain(d) for k, d in model.items()}})


def from_json(text: str) -> tuple[Prior, dict[int, Dish]]:
    """The inverse of ``to_json``."""
    spec = json.loads(text)
    made = lambda kind, d: kind(**{k: np.array(v) if isinstance(v, list) else v for k, v in d.items()})
    return made(Prior, spec["prior"]), {int(k): made(Dish, d) for k, d in spec["dishes"].items()}


def dishes(vectors: DataFrame, prior: Prior) -> dict[int, Dish]:
    """All dishes of a model, on the driver: as many as there are clusters."""
    tables = {r.dish_id: r.m for r in vectors.groupBy("dish_id").agg(F.count_distinct("group_id", "table_id").alias("m")).collect()}
    return {r.dish_id: posterior(prior, r.n, np.array(r.total), np.array(r.outer), tables[r.dish_id]) for r in moments(vectors, "dish_id").collect()}


def menu_consistent(vectors: DataFrame) -> bool:
    """Every table of a group has one dish, and nobody is without."""
    bad = vectors.groupBy("group_id", "table_id").agg(F.count_distinct("dish_id").alias("d")).where("d <> 1")
    return bad.isEmpty() and vectors.where("dish_id is null or table_id is null").isEmpty()


def cluster_priors(sizes: DataFrame, gamma: float) -> DataFrame:
    """Prior of each dish, n / (gamma + sum n), and of a new one (dish -1)."""
    whole = sizes.agg(F.sum("n").alias("t"))
    old = sizes.crossJoin(F.broadcast(whole)).select("dish_id", (F.col("n") / (gamma + F.col("t"))).alias("prior"))
    return old.union(whole.select(F.lit(-1).cast("long"), (gamma / (gamma + F.col("t"))).alias("prior")))


def predictive_clusters(vectors: DataFrame, model: dict[int, Dish], prior: Prior, groups: int, top: int) -> DataFrame:
    """For each vector its ``top`` - 1 most probable dishes and, last, a new one (-1): ``(vec_id, rank, dish_id, prob)``.

    Weights are n (m + gamma) + J m_k tau for a dish and J tau gamma for a new
    one, with m tables in all, m_k of the dish and J groups.
    """
    order = sorted(model)
    total = sum(model[k].tables for k in order)
    weight = np.log([model[k].n * (total + prior.gamma) + groups * model[k].tables * prior.tau for k in order] + [groups * prior.tau * prior.gamma])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if frame.empty:
                continue
            x = np.array(frame["x"].tolist(), float)
            logs = np.stack([log_predictive(x, model[k]) for k in order] + [log_predictive(x, prior)], axis=1) + weight
            p = np.exp(logs - logs.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            best = np.argsort(-p[:, :-1], axis=1, kind="stable")[:, : top - 1]
            k = best.shape[1]
            ids = np.concatenate([np.array(order)[best], np.full((len(x), 1), -1)], axis=1)
            probs = np.concatenate([np.take_along_axis(p, best, 1), p[:, -1:]], axis=1)
            yield pd.DataFrame(
                {"vec_id": np.repeat(frame["vec_id"].to_numpy(), k + 1), "rank": np.tile(np.arange(1, k + 2), len(x)), "dish_id": ids.ravel(), "prob": probs.ravel()}
            )

    rows = vectors.where("x is not null").select("vec_id", F.col("x").cast("array<double>").alias("x"))
    return rows.mapInPandas(run, "vec_id long, rank long, dish_id long, prob double")


def gibbs_scan(vectors: DataFrame, model: dict[int, Dish], prior: Prior, seed: int) -> DataFrame:
    """One scan over all vectors, group by group, with the dishes as they were at its start.

    A vector joins a table with weight n_t p(x | its dish) or opens one with
    weight tau, whose dish is drawn by tables served (a new dish by gamma).  A
    dish that is new in this scan is judged by the vectors it has so far.
    Groups are scanned at the same time, so counts of other groups are those of
    the scan's start; ids of new tables and dishes are drawn from 62 bits.
    """
    order = sorted(model)
    served = np.array([model[k].tables for k in order], float)

    def scan(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("vec_id").reset_index(drop=True)
        gid = int(group["group_id"].iloc[0])
        rng = np.random.default_rng([seed, gid & 0xFFFFFFFF])
        x = np.array(group["x"].tolist(), float)
        own = group["dish_id"].to_numpy().copy()
        table = group["table_id"].to_numpy().copy()
        logs = np.stack([log_predictive(x, model[k]) for k in order], axis=1)
        fresh = log_predictive(x, prior)
        for i in range(len(x)):
            if own[i] in model and model[own[i]].n > 1:
                logs[i, order.index(own[i])] = log_predictive(x[i], without(model[own[i]], x[i]))[0]
        dish_of = dict(zip(table.tolist(), own.tolist(), strict=True))
        size = pd.Series(table).value_counts().to_dict()
        new_dish: dict[int, list[int]] = {}

        def judged(k: int, i: int) -> float:
            rows = [j for j in new_dish.get(k, []) if j != i]
            if not rows:
                return fresh[i]
            return log_predictive(x[i], posterior(prior, len(rows), x[rows].sum(axis=0), (x[rows].T @ x[rows]).ravel()))[0]

        for i in range(len(x)):
            size[table[i]] -= 1
            if not size[table[i]]:
                del size[table[i]], dish_of[table[i]]
            known = {k: judged(k, i) for k in set(dish_of.values()) if k not in model}
            shift = max([logs[i].max(), fresh[i], *known.values()])
            p = np.exp(logs[i] - shift)
            p_new = math.exp(fresh[i] - shift)
            open_dish = np.append(served * p, prior.gamma * p_new) / (served.sum() + prior.gamma)
            names = list(size)
            like = [p[order.index(dish_of[t])] if dish_of[t] in model else math.exp(known[dish_of[t]] - shift) for t in names]
            w = np.append([size[t] * v for t, v in zip(names, like, strict=True)], prior.tau * open_dish.sum())
            at = rng.choice(len(w), p=w / w.sum())
            if at < len(names):
                table[i] = names[at]
            else:
                table[i] = rng.integers(1 << 62)
                k = rng.choice(len(open_dish), p=open_dish / open_dish.sum())
                dish_of[table[i]] = order[k] if k < len(order) else rng.integers(1 << 62)
            size[table[i]] = size.get(table[i], 0) + 1
            own[i] = dish_of[table[i]]
            if own[i] not in model:
                new_dish.setdefault(own[i], []).append(i)
        return group.assign(table_id=table, dish_id=own)[["vec_id", "group_id", "table_id", "dish_id", "x"]]

    rows = vectors.select(
        *(F.col(c).cast("long").alias(c) for c in ("vec_id", "group_id", "table_id", "dish_id")), F.col("x").cast("array<double>").alias("x")
    )
    return rows.groupBy("group_id").applyInPandas(scan, "vec_id long, group_id long, table_id long, dish_id long, x array<double>")


def table_scan(vectors: DataFrame, model: dict[int, Dish], prior: Prior, seed: int) -> DataFrame:
    """One scan over tables: all vectors of a table get one dish, by m_k times their joint density."""
    order = sorted(model)

    def scan(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["x"].tolist(), float)
        rng = np.random.default_rng([seed, int(part["group_id"].iloc[0]) & 0xFFFFFFFF, int(part["table_id"].iloc[0]) & 0xFFFFFFFF])
        fresh = posterior(prior, 0, np.zeros(x.shape[1]), np.zeros(x.shape[1] ** 2))
        logs = [math.log(model[k].tables) + log_joint(x, model[k], prior) for k in order]
        logs = np.array([*logs, math.log(prior.gamma) + log_joint(x, fresh, prior)])
        p = np.exp(logs - logs.max())
        at = rng.choice(len(p), p=p / p.sum())
        dish = order[at] if at < len(order) else int(rng.integers(1 << 62))
        return part.assign(dish_id=dish)

    cols = ["vec_id", "group_id", "table_id", "dish_id", "x"]
    return vectors.select(*cols).groupBy("group_id", "table_id").applyInPandas(scan, "vec_id long, group_id long, table_id long, dish_id long, x array<double>")


def split_merge(x: np.ndarray, labels: np.ndarray, prior: Prior, rng: np.random.Generator, scans: int = 3) -> tuple[np.ndarray, bool]:
    """One Metropolis-Hastings proposal on the vectors of one or two dishes: split them, or merge them.

    Two vectors are drawn; restricted Gibbs scans from a random start give the
    split that is proposed, or the one a merge is weighed against.
    """
    i, j = rng.choice(len(x), 2, replace=False)
    same = labels[i] == labels[j]
    both = np.flatnonzero((labels == labels[i]) | (labels == labels[j]))
    rest = both[(both != i) & (both != j)]

    def stats(rows: np.ndarray) -> Dish:
        return posterior(prior, len(rows), x[rows].sum(axis=0), (x[rows].T @ x[rows]).ravel())

    side = np.zeros(len(x), bool)
    side[i] = True
    side[rest] = rng.random(len(rest)) < 0.5

    def sweep(target: np.ndarray | None) -> float:
        log_q = 0.0
        for r in rest:
            a, b = (np.array([k for k in both if k != r and side[k] == s]) for s in (True, False))
            la, lb = math.log(len(a)) + log_predictive(x[r], stats(a))[0], math.log(len(b)) + log_predictive(x[r], stats(b))[0]
            pa = 1 / (1 + math.exp(min(700.0, lb - la)))
            side[r] = target[r] if target is not None else rng.random() < pa
            log_q += math.log(max(pa if side[r] else 1 - pa, 1e-300))
        return log_q

    for _ in range(scans):
        sweep(None)
    log_q = sweep(None if same else labels == labels[i])
    a, b = both[side[both]], both[~side[both]]
    parts = [log_marginal(prior, stats(k)) for k in (a, b, both)]
    ratio = math.log(prior.gamma) + math.lgamma(len(a)) + math.lgamma(len(b)) - math.lgamma(len(both)) + parts[0] + parts[1] - parts[2]
    accept = math.log(rng.random()) < (ratio - log_q if same else log_q - ratio)
    out = labels.copy()
    if accept and same:
        out[a] = labels.max() + 1
    elif accept:
        out[both] = labels[j]
    return out, bool(accept)


def _added(prior: Prior, dish: tuple, table: tuple) -> float:
    """What a table's sums (n, total, outer) add to the log probability of a dish given by its sums."""
    both = tuple(a + b for a, b in zip(dish, table, strict=True))
    return log_marginal(prior, posterior(prior, *both)) - log_marginal(prior, posterior(prior, *dish))


def _sided(tables: DataFrame, prior: Prior, ends: tuple[int, int], sides: tuple[tuple, tuple], seed: int | None, forced: bool) -> DataFrame:
    """``tables`` with ``side`` (true: the first end's) and ``log_q``, the log probability of that side.

    Without ``seed`` a table takes its likelier side, with it one drawn by a hash
    of the table; ``forced`` keeps ``was``.  Both ends stay where they are.
    """
    names = ["k", "was", "n", "total", "outer", "side", "log_q"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            side, log_q = [], []
            for row in frame.itertuples():
                if row.k in ends:
                    side.append(row.k == ends[0])
                    log_q.append(0.0)
                    continue
                sums = (row.n, np.asarray(row.total), np.asarray(row.outer))
                a, b = (math.log(m) + _added(prior, whole, sums) for m, whole in sides)
                p = 1 / (1 + math.exp(min(700.0, max(-700.0, b - a))))
                u = 0.5 if seed is None else np.random.default_rng([seed, row.k & 0xFFFFFFFFFFFFFFFF]).random()
                side.append(bool(row.was) if forced else u < p)
                log_q.append(math.log(max(p if side[-1] else 1 - p, 1e-300)))
            yield frame.assign(side=side, log_q=log_q)[names]

    return tables.mapInPandas(run, "k long, was boolean, n long, total array<double>, outer array<double>, side boolean, log_q double")


def _side_sums(sided: DataFrame) -> dict[bool, tuple[int, tuple, float]]:
    """For both sides the number of tables, the sums (n, total, outer), and the sum of ``log_q``; two rows reach the driver."""
    schema = "side boolean, m long, n long, total array<double>, outer array<double>, log_q double"

    def added(frame: pd.DataFrame) -> pd.DataFrame:
        sums = {c: [np.sum(frame[c].tolist(), axis=0)] for c in ("total", "outer")}
        return pd.DataFrame({"side": [frame["side"].iloc[0]], "m": [frame["m"].sum()], "n": [frame["n"].sum()], **sums, "log_q": [frame["log_q"].sum()]})

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for _, part in frame.assign(m=1).groupby("side"):
                yield added(part)

    rows = sided.mapInPandas(partial, schema).groupBy("side").applyInPandas(added, schema).collect()
    return {r.side: (r.m, (r.n, np.array(r.total), np.array(r.outer)), r.log_q) for r in rows}


def weighted_draw(rows: DataFrame, key: Column, weight: Column, seed: int) -> DataFrame:
    """One row of ``rows``, drawn with chances in proportion to ``weight``: the least of exponential times with these rates.

    Times come from a hash of ``key`` and ``seed``, so each partition sends its
    least one.  Rows without a positive weight are drawn only where no row has
    one, and then all alike.
    """
    u = (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 53)) + 0.5) / float(1 << 53)
    held = F.coalesce(weight, F.lit(0.0)) > 0
    return rows.orderBy(F.when(held, 0).otherwise(1), -F.log(u) / F.when(held, weight).otherwise(1.0), key).limit(1)


def _distance(x: Column, to: list[float]) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(x, F.array(*map(F.lit, to)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda t, d: t + d))


def partner(vectors: DataFrame, first: Row, seed: int) -> DataFrame:
    """A second vector of the dish of ``first(vec_id, dish_id, x)``, drawn by its distance from it; all alike if none differs."""
    others = vectors.where((F.col("dish_id") == first.dish_id) & (F.col("vec_id") != first.vec_id) & F.col("x").isNotNull())
    return weighted_draw(others, F.col("vec_id"), _distance(F.col("x"), list(first.x)), seed)


def split_merge_tables(
    vectors: DataFrame, prior: Prior, seed: int, cut: Callable[[DataFrame, str], DataFrame], launches: int = 2, by_distance: bool = False
) -> tuple[DataFrame, bool]:
    """One Metropolis-Hastings proposal on whole tables, and whether it was taken: split a dish, or merge two.

    Two tables are drawn, all alike, or with ``by_distance`` the second by the
    distance of its mean from the first one's.  If they share a dish, its tables are dealt to both,
    else both dishes are joined.  Tables are dealt at the same time, each by its
    joint density under two launch dishes; these start from the two drawn tables
    and take every table's likelier side ``launches`` times, so they depend on
    the drawn tables and the tables at hand, not on the present sides, and a
    merge is weighed by the chance that a split deals the present sides.  Only
    sums of tables are formed; the driver sees two rows of sums.
    """
    key = F.xxhash64("group_id", "table_id")
    keyed = vectors.where("x is not null").withColumn("k", key)
    if by_distance:
        sums = cut(moments(keyed, "k").join(keyed.groupBy("k").agg(F.min("dish_id").alias("dish_id")), "k"), "means")
        means = sums.select("k", "dish_id", F.transform("total", lambda t: t / F.col("n")).alias("x"))
        drawn = weighted_draw(means, F.col("k"), F.lit(1.0), seed).collect()
        drawn += weighted_draw(means.where(F.col("k") != drawn[0].k), F.col("k"), _distance(F.col("x"), drawn[0].x), seed + 1).collect() if drawn else []
    else:
        drawn = keyed.select("k", "dish_id").distinct().orderBy(F.xxhash64("k", F.lit(seed)), "k").limit(2).collect()
    if len(drawn) < 2:
        return vectors, False
    (one, dish), (two, other) = ((r.k, r.dish_id) for r in drawn)
    same = dish == other
    parts = [moments(keyed.where(F.col("dish_id") == d), "k").withColumn("was", F.lit(d == dish)) for d in {dish, other}]
    tables = parts[0] if same else parts[0].unionByName(parts[1])
    tables = cut(tables.select("k", "was", "n", "total", "outer"), "tables")
    begun = {r.k: (1, (r.n, np.array(r.total), np.array(r.outer))) for r in tables.where(F.col("k").isin(one, two)).collect()}
    sides = begun[one], begun[two]
    for _ in range(launches):
        found = _side_sums(_sided(tables, prior, (one, two), sides, None, False))
        sides = found[True][:2], found[False][:2]
    dealt = cut(_sided(tables, prior, (one, two), sides, seed, not same), "dealt")
    (m, a, q), (l, b, r) = (lambda f: (f[True], f[False]))(_side_sums(dealt))
    whole = tuple(x + y for x, y in zip(a, b, strict=True))
    left, right, both = (log_marginal(prior, posterior(prior, *t)) for t in (a, b, whole))
    ratio = math.log(prior.gamma) + math.lgamma(m) + math.lgamma(l) - math.lgamma(m + l) + left + right - both
    rng = np.random.default_rng([seed, 1])
    taken = math.log(rng.random()) < (ratio - q - r if same else q + r - ratio)
    if not taken:
        return vectors, False
    if same:
        moved = keyed.join(dealt.select("k", "side"), "k", "left")
        new = F.when(F.col("side"), F.lit(int(rng.integers(1 << 62)))).otherwise(F.col("dish_id"))
    else:
        moved, new = keyed, F.when(F.col("dish_id") == dish, F.lit(other)).otherwise(F.col("dish_id"))
    return cut(moved.withColumn("dish_id", new).select(*vectors.columns), "state"), True


def slice_sample(log_f: Callable[[float], float], x0: float, width: float, rng: np.random.Generator, low: float = 0.0, steps: int = 50) -> float:
    """One draw by stepping out and shrinking, for a density known up to a factor on (low, infinity)."""
    level = log_f(x0) + math.log(rng.random())
    left = max(low + 1e-12, x0 - width * rng.random())
    right = left + width
    for _ in range(steps):
        if left <= low + 1e-12 or log_f(left) < level:
            break
        left = max(low + 1e-12, left - width)
    for _ in range(steps):
        if log_f(right) < level:
            break
        right += width
    while True:
        x = left + rng.random() * (right - left)
        if log_f(x) >= level:
            return x
        left, right = (x, right) if x < x0 else (left, x)


def log_concentration(alpha: float, draws: list[int], kinds: int, shape: float = 1.0, rate: float = 1.0, times: list[int] | None = None) -> float:
    """Log posterior of a concentration given sizes of restaurants and the number of tables (gamma prior).

    ``times`` says how many restaurants have each size; one by default.
    """
    known = sum(t * (math.lgamma(alpha) - math.lgamma(alpha + n)) for n, t in zip(draws, times or [1] * len(draws), strict=True))
    return (shape - 1 + kinds) * math.log(alpha) - rate * alpha + known


def one_round(
    vectors: DataFrame, prior: Prior, r: int, seed: int, cut: Callable[[DataFrame, int | str], DataFrame], proposals: int = 0, scales: bool = False, by_distance: bool = False
) -> tuple[DataFrame, Prior]:
    """Round ``r`` of a fit: what it draws depends on the state, ``seed`` and ``r`` alone."""
    rng = np.random.default_rng([seed, r])
    for t in range(proposals):
        vectors, _ = split_merge_tables(
            vectors, prior, int(rng.integers(1 << 31)), lambda df, name, tag=f"{r}-{t}": cut(df, f"proposal-{tag}-{name}"), by_distance=by_distance
        )
    model = dishes(vectors, prior)
    sizes = vectors.groupBy("group_id").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("times")).orderBy("n").collect()
    held, times = [x.n for x in sizes], [x.times for x in sizes]
    tables = sum(d.tables for d in model.values())
    tau = slice_sample(lambda a: log_concentration(a, held, tables, times=times), prior.tau, 1.0, rng)
    gamma = slice_sample(lambda a: log_concentration(a, [tables], len(model)), prior.gamma, 1.0, rng)
    prior = Prior(prior.mu, prior.scatter, prior.kappa, prior.nu, tau, gamma)
    if scales:
        sums = [(x.n, np.array(x.total), np.array(x.outer)) for x in moments(vectors, "dish_id").collect()]
        for name in ("kappa", "nu"):
            prior = sample_scale(prior, sums, name, rng)
        model = dishes(vectors, prior)
    vectors = cut(gibbs_scan(vectors, model, prior, seed + 2 * r), 2 * r)
    return cut(table_scan(vectors, dishes(vectors, prior), prior, seed + 2 * r + 1), 2 * r + 1), prior


def fit(
    vectors: DataFrame,
    prior: Prior,
    scans: int,
    seed: int,
    cut: Callable[[DataFrame, int | str], DataFrame],
    keep_best: bool = False,
    proposals: int = 0,
    scales: bool = False,
) -> DataFrame:
    """``scans`` rounds of vector and table scans; ``cut`` writes a state so that a round does not recompute the last.

    Concentrations are drawn anew before each round, with ``scales`` also the
    prior's kappa and nu; ``proposals`` splits or merges of dishes are tried
    before its scans.  The last state is returned, or with ``keep_best`` the one
    with the highest log probability.  The driver sees the dishes, and how many
    groups there are of each size.  ``states.fit`` keeps states on disk.
    """
    best, at = vectors, -math.inf
    for r in range(scans):
        vectors, prior = one_round(vectors, prior, r, seed, cut, proposals, scales)
        if keep_best and (now := log_probability(dishes(vectors, prior), prior)) > at:
            best, at = vectors, now
    return best if keep_best else vectors
