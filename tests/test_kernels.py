"""Kernels against slow recursions, identities and known values."""

import itertools
import math

import numpy as np
import pytest

from tessella.functions import special as S
from tessella.functions import vectors as V
from tessella.operators import align, hdp, search, seg, statistics


def slow_local(scores, tq, ts, allowed):
    """The best score and its end by the recurrences, cell by cell."""
    rows, cols = scores.shape
    tab = np.zeros((5, rows + 1, cols + 1))
    for n in range(1, rows + 1):
        for m in range(1, cols + 1):
            if not allowed[n, m]:
                continue
            a, b, c, d = tq[n - 1], ts[m - 1], tq[n], ts[m]
            x, up, left = tab[:, n - 1, m - 1], tab[:, n - 1, m], tab[:, n, m - 1]
            best = max(x[0] + a[0] + b[0], x[1] + a[0] + b[3], x[2] + a[3] + b[0], x[3] + a[6] + b[0], x[4] + a[0] + b[6])
            tab[0, n, m] = max(0, best + scores[n - 1, m - 1])
            tab[1, n, m] = max(0, up[0] + a[0] + d[1], up[1] + a[0] + d[4])
            tab[2, n, m] = max(0, left[0] + c[1] + b[0], left[2] + c[4] + b[0])
            tab[3, n, m] = max(0, up[0] + a[2], up[3] + a[8])
            tab[4, n, m] = max(0, left[0] + b[2], left[4] + b[8])
    return tab[0].max()


@pytest.mark.parametrize("seed", range(6))
def test_local_alignment(seed):
    rng = np.random.default_rng(seed)
    rows, cols = rng.integers(3, 9, 2)
    scores = rng.normal(0.3, 2, (rows, cols))
    tq, ts = (np.log(rng.uniform(0.05, 0.95, (k + 1, 9))) for k in (rows, cols))
    found = align.local(scores, tq, ts)
    assert found.score == pytest.approx(slow_local(scores, tq, ts, align.allowed(rows, cols)))
    path = found.path
    assert all(0 <= b[0] - a[0] <= 1 and 0 <= b[1] - a[1] <= 1 and a != b for a, b in zip(path, path[1:]))
    assert found.matches <= len(path)


def all_local_paths(scores, tq, ts):
    """Sum of exp(score) over all local alignments, and the part of each matched pair, by listing them."""
    rows, cols = scores.shape
    total, part = 0.0, np.zeros(scores.shape)
    step = {0: (1, 1), 1: (1, 0), 2: (0, 1), 3: (1, 0), 4: (0, 1)}

    def cost(s, t, n, m):
        a, b = tq[n], ts[m]
        table = {
            (0, 0): a[0] + b[0], (1, 0): a[0] + b[3], (2, 0): a[3] + b[0], (3, 0): a[6] + b[0], (4, 0): a[0] + b[6],
            (0, 3): a[2], (3, 3): a[8], (0, 4): b[2], (4, 4): b[8],
        }
        if (s, t) in table:
            return table[s, t]
        if (s, t) in ((0, 1), (1, 1)):
            return a[0] + ts[m][1 if s == 0 else 4]
        if (s, t) in ((0, 2), (2, 2)):
            return tq[n][1 if s == 0 else 4] + b[0]
        return None

    def walk(state, n, m, weight, seen):
        nonlocal total
        if state == 0:
            total += weight
            for x in seen:
                part[x] += weight
        for t in range(5):
            n2, m2 = n + step[t][0], m + step[t][1]
            c = cost(state, t, n, m)
            if c is None or n2 > rows or m2 > cols:
                continue
            extra = scores[n2 - 1, m2 - 1] if t == 0 else 0.0
            walk(t, n2, m2, weight * math.exp(c + extra), seen + [(n2 - 1, m2 - 1)] if t == 0 else seen)

    for n, m in itertools.product(range(1, rows + 1), range(1, cols + 1)):
        walk(0, n, m, math.exp(scores[n - 1, m - 1]), [(n - 1, m - 1)])
    return total, part / total


def test_posteriors():
    rng = np.random.default_rng(3)
    scores = rng.normal(0, 1, (3, 4))
    tq, ts = (np.log(rng.uniform(0.1, 0.9, (k + 1, 9))) for k in (3, 4))
    total, part = all_local_paths(scores, tq, ts)
    got, log_total = align.posteriors(scores, tq, ts)
    assert log_total == pytest.approx(math.log(total))
    assert np.allclose(got, part)
    value, path = align.most_accurate(got, 0.05)
    assert value >= got.max() - 0.05 - 1e-12 and path


def test_rendering():
    text = align.rendered("ARND", "ARD", [(1, 1), (2, 2), (3, 2), (4, 3)], lambda a, b: False, 60)
    assert text == "ARND\nAR D\nAR-D"


def test_lambda_and_entropy():
    scores, probs = [-2, -1, 0, 1, 3], [0.3, 0.3, 0.2, 0.15, 0.05]
    lam = statistics.find_lambda(scores, probs)
    assert sum(p * math.exp(lam * s) for s, p in zip(scores, probs)) == pytest.approx(1)
    assert statistics.find_lambda([1, 2], [0.5, 0.5]) is None and statistics.find_lambda([-1, -2], [0.5, 0.5]) is None
    assert statistics.scale_to_lambda(scores, probs, lam / 2) == pytest.approx(2)
    h = lam * sum(s * p * math.exp(lam * s) for s, p in zip(scores, probs))
    assert 0 < statistics.karlin_k(scores, probs, lam, h) < 1
    up, down = 0.2, 0.5  # steps of one: K has a closed form
    assert statistics.karlin_k([-1, 0, 1], [down, 0.3, up], math.log(down / up), 1.0) == pytest.approx((up - down) ** 2 / down)


def test_length_adjustment():
    got = search.length_adjustment(0.267, 0.041, 1.9 * 0.267, -30.0, 250, 1_000_000, 3000)
    f = lambda x: 1.9 * (math.log(0.041) + math.log((250 - x) * (1_000_000 - 3000 * x))) - 30
    assert got >= 0 and f(got) >= got and f(got + 2) < got + 2
    assert search.length_adjustment(0.267, 0.041, 1.0, 0.0, 0, 10, 1) == 0


def test_special_functions():
    assert S.gamma_p(2.5, 0) == 0 and S.gamma_p(1, 2.0) == pytest.approx(1 - math.exp(-2))
    assert S.gamma_p(3, 9.0) + S.gamma_q(3, 9.0) == pytest.approx(1)
    assert S.gamma_p(0.5, 1.7) == pytest.approx(math.erf(math.sqrt(1.7)))
    assert S.beta_i(2, 3, 0.4) == pytest.approx(sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5)))
    assert S.digamma(0.5) == pytest.approx(-0.5772156649015329 - 2 * math.log(2))
    assert S.digamma(-0.5) == pytest.approx(S.digamma(0.5) + 2)
    assert S.polygamma(2, 1.0) == pytest.approx(-2 * S.zeta(3))
    assert S.zeta(4) == pytest.approx(math.pi**4 / 90) and S.zeta(-3) == pytest.approx(1 / 120) and S.eta(1) == pytest.approx(math.log(2))
    assert S.expint(1, 1.0) == pytest.approx(0.21938393439552) and S.expint(3, 0.5) == pytest.approx((math.exp(-0.5) - 0.5 * S.expint(2, 0.5)) / 2)
    assert S.expint(2, 3.0) == pytest.approx(math.exp(-3) - 3 * S.expint(1, 3.0))
    assert S.exprel(1, 0.3) == pytest.approx(math.expm1(0.3) / 0.3) and S.exprel(2, 0.7) == pytest.approx(2 * (math.exp(0.7) - 1.7) / 0.49)
    assert S.log_erfc(3.0) == pytest.approx(math.log(math.erfc(3.0))) and S.hazard(0) == pytest.approx(math.sqrt(2 / math.pi))
    assert S.double_factorial(7) == 105 and S.ln_choose(10, 3) == pytest.approx(math.log(120))
    assert S.chebyshev([2.0, 0.0, 1.0], 0.5) == pytest.approx(1 + 2 * 0.25 - 1)
    assert S.find_root(lambda x: (x * x - 2, 2 * x), 0, 2) == pytest.approx(math.sqrt(2))
    assert S.gamma_star(10.0) == pytest.approx(math.gamma(10) / (math.sqrt(2 * math.pi) * 10**9.5 * math.exp(-10)))


def test_geometric_weights():
    w = V.geometric_weights(3, 0.4)
    assert sum(w) == pytest.approx(1) and w[3] == 0.4 and w[0] == w[6] < w[1]


def test_window_log_probability():
    """Over all windows of a length the probabilities of their composition kinds sum to 1."""
    kinds = {}
    for w in itertools.product("abc", repeat=4):
        kinds[tuple(sorted((w.count(x) for x in set(w)), reverse=True))] = math.exp(seg.window_log_probability(list(w), 3))
    assert sum(kinds.values()) == pytest.approx(1)
    left, right, p = seg.best_part(list("abcaaaaaaaabc"), 3)
    assert (left, right) == (3, 10) and p < 0
    assert seg.vector_classes([[0, 0], [3, 0], [0.5, 0], [3.2, 0]], 1.0) == [0, 1, 0, 1]


def test_mixture_densities():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(30, 2))
    prior = hdp.niw_prior(30, x.sum(axis=0), (x.T @ x).ravel())
    dish = hdp.posterior(prior, 30, x.sum(axis=0), (x.T @ x).ravel())
    less = hdp.posterior(prior, 29, x[1:].sum(axis=0), (x[1:].T @ x[1:]).ravel())
    out = hdp.without(dish, x[0])
    assert np.allclose(out.mu, less.mu) and np.allclose(out.scatter, less.scatter) and out.n == 29
    # the joint density is the product of predictive densities, one vector after another
    steps = 0.0
    for k in range(30):
        d = hdp.posterior(prior, k, x[:k].sum(axis=0), (x[:k].T @ x[:k]).ravel())
        steps += hdp.log_predictive(x[k], d)[0]
    assert hdp.log_marginal(prior, dish) == pytest.approx(steps)
    grid = np.linspace(-12, 12, 241)
    mesh = np.stack(np.meshgrid(grid, grid), -1).reshape(-1, 2)
    assert np.exp(hdp.log_predictive(mesh, dish)).sum() * 0.01 == pytest.approx(1, abs=1e-3)


def test_split_merge_and_slice_sampling():
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(-6, 1, (15, 2)), rng.normal(6, 1, (15, 2))])
    prior = hdp.uninformative(x.mean(axis=0))
    labels = np.zeros(30, int)
    for _ in range(40):
        labels, _ = hdp.split_merge(x, labels, prior, rng)
    assert len(set(labels[:15])) >= 1 and not set(labels[:15]) & set(labels[15:])
    draws, now = [], 1.0
    for _ in range(3000):
        now = hdp.slice_sample(lambda a: -a, now, 1.0, rng)
        draws.append(now)
    assert np.mean(draws) == pytest.approx(1.0, abs=0.15)


def test_joint_density_and_model_text():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(12, 3))
    prior = hdp.uninformative(x.mean(axis=0), 2.0, 0.5)
    dish = hdp.posterior(prior, 8, x[:8].sum(axis=0), (x[:8].T @ x[:8]).ravel(), 2)
    steps = 0.0
    for k in range(8, 12):
        d = hdp.posterior(prior, k, x[:k].sum(axis=0), (x[:k].T @ x[:k]).ravel())
        steps += hdp.log_predictive(x[k], d)[0]
    assert hdp.log_joint(x[8:], dish, prior) == pytest.approx(steps)
    back_prior, back = hdp.from_json(hdp.to_json(prior, {4: dish}))
    assert np.allclose(back_prior.scatter, prior.scatter) and back[4].n == 8 and np.allclose(back[4].mu, dish.mu)
    assert hdp.log_probability({4: dish}, prior) == pytest.approx(hdp.log_marginal(prior, dish))
    assert np.allclose(hdp.mixed_vector(x[0], {4: dish}, {4: 0.7, -1: 0.3}, 0.25), 0.75 * x[0] + 0.25 * dish.mu)
    sums = [(8, x[:8].sum(axis=0), (x[:8].T @ x[:8]).ravel())]
    assert hdp.sample_scale(prior, sums, "kappa", rng).kappa > 0 and hdp.sample_scale(prior, sums, "nu", rng).nu > 2


def test_shares_that_sum_to_one():
    assert V.summing_to_one([0.5, 0.5 + 5e-7]) == pytest.approx([0.5 - 5e-7, 0.5 + 5e-7], abs=1e-12)
    assert V.summing_to_one([0.5, 0.0, 0.46]) == pytest.approx([0.52, 0.0, 0.48])
    assert V.summing_to_one([0.99, 0.05, 0.0]) == pytest.approx([0.97, 0.03, 0.0])
    with pytest.raises(ValueError):
        V.summing_to_one([0.5, 0.1])
