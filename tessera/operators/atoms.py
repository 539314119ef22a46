"""Local clusterers on one dense block, in numpy: what runs inside a group on an executor.

An atom maps a block (n x m) to row labels and column labels; -1 is unassigned. Every random start has an explicit seed.
Factor updates are Gauss-Seidel (F, then G, then S), each set to 0 where it is not finite.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

import numpy as np

EPS = 1e-10
Labels = tuple[np.ndarray, np.ndarray]


def finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0.0)


def mu(b: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return finite(b * num / (den + EPS))


def mu_sqrt(b: np.ndarray, num: np.ndarray, den: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return finite(b * np.sqrt(num / (den + EPS)))


def argmax_last(x: np.ndarray) -> np.ndarray:
    """Place of the greatest value of each row, the last of equals."""
    return x.shape[1] - 1 - np.argmax(x[:, ::-1], axis=1)


# -- k-means ------------------------------------------------------------------------------------------------------------


def kmeans(x: np.ndarray, k: int, max_iter: int = 100, n_init: int = 1, tol: float = 1e-4, seed: int = 0) -> np.ndarray:
    """Labels of the best of ``n_init`` runs of Lloyd's iterations from k-means++ starts; ties go to the least centre."""
    rng = np.random.default_rng(seed)
    k, best = max(1, min(k, len(x))), (np.inf, np.zeros(len(x), np.int64))
    for _ in range(n_init):
        c = x[[rng.integers(len(x))]]
        while len(c) < k:
            d = ((x[:, None] - c[None]) ** 2).sum(-1).min(1)
            p = d / d.sum() if d.sum() > 0 else np.full(len(x), 1 / len(x))
            c = np.vstack([c, x[rng.choice(len(x), p=p)]])
        for _ in range(max_iter):
            d = ((x[:, None] - c[None]) ** 2).sum(-1)
            label = d.argmin(1)
            new = np.array([x[label == a].mean(0) if (label == a).any() else c[a] for a in range(k)])
            moved, c = ((new - c) ** 2).sum(), new
            if moved <= tol * tol:
                break
        d = ((x[:, None] - c[None]) ** 2).sum(-1)
        if (cost := d.min(1).sum()) < best[0]:
            best = (cost, d.argmin(1))
    return best[1]


# -- spectral -------------------------------------------------------------------------------------------------------------


def truncated_svd(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """U, sigma, V of the k largest singular values; by the eigenvectors of X^T X if LAPACK fails. Of each pair of
    vectors the entry of V of largest size is positive."""
    k = min(k, *x.shape)
    try:
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        u, s, v = u[:, :k], s[:k], vt[:k].T
    except np.linalg.LinAlgError:
        w, v = np.linalg.eigh(x.T @ x)
        order = np.argsort(-w)[:k]
        s, v = np.sqrt(np.maximum(w[order], 0)), v[:, order]
        u = x @ v / np.where(s > 0, s, 1)
    sign = np.sign(v[np.abs(v).argmax(0), np.arange(v.shape[1])]) if v.size else np.ones(k)
    sign[sign == 0] = 1
    return u * sign, s, v * sign


def binormalized(x: np.ndarray) -> np.ndarray:
    def scale(t):
        with np.errstate(all="ignore"):
            return np.where(np.abs(t) < EPS, 0.0, np.abs(t) ** -0.5)

    return x * scale(x.sum(1))[:, None] * scale(x.sum(0))[None]


def unit_rows(z: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(z, axis=1, keepdims=True)
    return np.where(n > 1e-15, z / np.where(n > 1e-15, n, 1), z)


@dataclass(frozen=True)
class Scc:
    """Spectral co-clustering: joint k-means on the normalised first k singular vectors of the bi-normalised block.
    ``tol`` is accepted and changes nothing. Rows without a non-zero embedding are unassigned."""

    k: int
    n_vectors: int | None = None
    seed: int = 0
    tol: float = 1e-4

    def __call__(self, x: np.ndarray) -> Labels:
        if (x < 0).any():
            raise ValueError("negative value")
        keep_r, keep_c = np.flatnonzero((np.abs(x) > 1e-15).any(1)), np.flatnonzero((np.abs(x) > 1e-15).any(0))
        rows, cols = np.full(x.shape[0], -1), np.full(x.shape[1], -1)
        if not len(keep_r):
            return rows, cols
        u, _, v = truncated_svd(binormalized(x[np.ix_(keep_r, keep_c)]), self.n_vectors or self.k)
        z = np.vstack([u, v])
        some = (np.abs(z) >= 1e-15).any(1)
        label = np.full(len(z), -1)
        label[some] = kmeans(unit_rows(z[some]), self.k, 100, 5, seed=self.seed)
        rows[keep_r], cols[keep_c] = label[: len(u)], label[len(u) :]
        return rows, cols


@dataclass(frozen=True)
class Spectral:
    """Laplacian spectral co-clustering: singular vectors 1..min(nr, nc) of the normalised adjacency, rows and columns
    clustered separately (10 starts, 300 iterations)."""

    n_row: int
    n_col: int
    n_init: int = 10
    max_iter: int = 300
    tol: float = 1e-4
    seed: int = 0

    def __call__(self, x: np.ndarray) -> Labels:
        # Beside the first, vectors of the bipartite adjacency are those of the bi-normalised block, so its SVD serves.
        k = min(self.n_row, self.n_col)
        u, _, v = truncated_svd(binormalized(x), min(k + 1, *x.shape))
        u, v = (u[:, 1:], v[:, 1:]) if u.shape[1] > 1 else (u, v)
        return kmeans(u, self.n_row, self.max_iter, self.n_init, self.tol, self.seed), kmeans(v, self.n_col, self.max_iter, self.n_init, self.tol, self.seed + 1)


@dataclass(frozen=True)
class Basic:
    """k contiguous diagonal blocks."""

    k: int

    def __call__(self, x: np.ndarray) -> Labels:
        if self.k <= 0:
            raise ValueError("k must be positive")
        edges = lambda n: np.repeat(np.arange(self.k), [(i + 1) * n // self.k - i * n // self.k for i in range(self.k)])
        return edges(x.shape[0]), edges(x.shape[1])


# -- tri-factorisation ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class TriConfig:
    n_row: int = 2
    n_col: int = 2
    max_iter: int = 100
    inner_iter: int = 10
    n_init: int = 1
    tol: float = 1e-9
    seed: int = 42
    timeout: float | None = None


@dataclass
class TriResult:
    F: np.ndarray
    S: np.ndarray
    G: np.ndarray
    criterion: float
    rows: np.ndarray
    cols: np.ndarray


def error2(x: np.ndarray, f: np.ndarray, s: np.ndarray, g: np.ndarray) -> float:
    """||X - F S G^T||^2 without the product."""
    return float((x * x).sum() - 2 * ((x @ g) * (f @ s)).sum() + ((s.T @ (f.T @ f) @ s) * (g.T @ g)).sum())


def scaled_columns(a: np.ndarray) -> np.ndarray:
    t = a.sum(0)
    with np.errstate(all="ignore"):
        return a * np.where(np.abs(t) < 1e-30, 0.0, np.abs(t) ** -0.5)


def normalize_standard(x, f, s, g):
    """F scaled by column sums^-1/2; S = F^T X G with G not yet scaled; then G."""
    f = scaled_columns(f)
    return f, f.T @ x @ g, scaled_columns(g)


def normalize_probability(x, f, s, g):
    """Columns of F and G to sum 1, their sums moved into S."""
    a, b = f.sum(0), g.sum(0)
    one = lambda t: np.where(np.abs(t) < 1e-30, 0.0, 1 / np.where(np.abs(t) < 1e-30, 1, t))
    return f * one(a), s * a[:, None] * b[None], g * one(b)


@dataclass(frozen=True)
class TriFactor:
    """X ~ F S G^T with non-negative factors; subclasses give the updates of F, G and S."""

    config: TriConfig = field(default_factory=TriConfig)

    def step(self, x, f, s, g):
        raise NotImplementedError

    normalize = staticmethod(normalize_standard)

    def criterion(self, x, f, s, g) -> float:
        return error2(x, f, s, g)

    def run(self, x: np.ndarray) -> TriResult:
        """The restart of the lowest criterion; one that runs out of time does not count."""
        c, (n, m) = self.config, x.shape
        best = TriResult(np.zeros((n, c.n_row)), np.zeros((c.n_row, c.n_col)), np.zeros((m, c.n_col)), np.inf, None, None)
        began = time.monotonic()
        for k in range(c.n_init):
            rng = np.random.default_rng(c.seed + k)
            f, s, g = rng.random((n, c.n_row)), rng.random((c.n_row, c.n_col)), rng.random((m, c.n_col))
            last, now, late = -np.inf, np.inf, False
            for _ in range(c.max_iter):
                if late := c.timeout is not None and time.monotonic() - began > c.timeout:
                    break
                for _ in range(c.inner_iter):
                    f, s, g = self.step(x, f, s, g)
                f, s, g = self.normalize(x, f, s, g)
                now = self.criterion(x, f, s, g)
                if abs(now - last) <= c.tol:
                    break
                last = now
            if not late and now < best.criterion:
                best = TriResult(f, s, g, now, None, None)
        best.rows, best.cols = argmax_last(best.F), argmax_last(best.G)
        return best

    def __call__(self, x: np.ndarray) -> Labels:
        r = self.run(x)
        return r.rows, r.cols


def _s_update(x, f, s, g, how):
    return how(s, f.T @ x @ g, (f.T @ f) @ s @ (g.T @ g))


@dataclass(frozen=True)
class Nbvd(TriFactor):
    """Block value decomposition."""

    def step(self, x, f, s, g):
        f = mu(f, x @ g @ s.T, f @ (s @ (g.T @ g) @ s.T))
        g = mu(g, x.T @ f @ s, g @ (s.T @ (f.T @ f) @ s))
        return f, _s_update(x, f, s, g, mu), g


@dataclass(frozen=True)
class Onm3f(TriFactor):
    """Orthogonal tri-factorisation with square-root updates."""

    def step(self, x, f, s, g):
        a = x @ g @ s.T
        f = mu_sqrt(f, a, f @ (f.T @ a))
        b = x.T @ f @ s
        g = mu_sqrt(g, b, g @ (g.T @ b))
        return f, _s_update(x, f, s, g, mu_sqrt), g


@dataclass(frozen=True)
class Onmtf(TriFactor):
    """Orthogonal tri-factorisation on the Stiefel manifold; products associate through k x k."""

    def step(self, x, f, s, g):
        f = mu(f, x @ g @ s.T, (f @ s) @ ((g.T @ x.T) @ f))
        g = mu(g, x.T @ f @ s, (g @ s.T) @ ((f.T @ x) @ g))
        return f, _s_update(x, f, s, g, mu), g


@dataclass(frozen=True)
class Pnmtf(TriFactor):
    """Penalised tri-factorisation: tau, eta and gamma weigh the overlap of F, of G and the size of S."""

    tau: float = 0.0
    eta: float = 0.0
    gamma: float = 0.0
    normalize = staticmethod(normalize_probability)

    @staticmethod
    def _others(a):
        return a.sum(1, keepdims=True) - a

    def step(self, x, f, s, g):
        f = mu_sqrt(f, x @ g @ s.T, f @ (s @ (g.T @ g) @ s.T) + self.tau * self._others(f))
        g = mu_sqrt(g, x.T @ f @ s, g @ (s.T @ (f.T @ f) @ s) + self.eta * self._others(g))
        return f, mu_sqrt(s, f.T @ x @ g, (f.T @ f) @ s @ (g.T @ g) + self.gamma * s), g

    def criterion(self, x, f, s, g):
        pen = lambda a: float((a.sum(1) ** 2).sum() - (a * a).sum())
        return 0.5 * (error2(x, f, s, g) + self.tau * pen(f) + self.eta * pen(g) + self.gamma * float((s * s).sum()))


@dataclass(frozen=True)
class Dnmf(TriFactor):
    """X ~ F F^T X G G^T: double projection, with S = F^T X G."""

    def step(self, x, f, s, g):
        a = x @ g @ (g.T @ x.T @ f)
        f = mu_sqrt(f, a, f @ (f.T @ a))
        b = x.T @ f @ (f.T @ x @ g)
        g = mu_sqrt(g, b, g @ (g.T @ b))
        return f, f.T @ x @ g, g


@dataclass(frozen=True)
class Alpha(TriFactor):
    """Tri-factorisation under the alpha-divergence, updates raised to 1 / alpha. ``orth_f`` and ``orth_g`` penalise the
    overlap of columns (orthogonal variants), ``sum_f`` and ``sum_g`` their size."""

    alpha: float = 1.0
    orth_f: float = 0.0
    orth_g: float = 0.0
    sum_f: float = 0.0
    sum_g: float = 0.0
    normalize = staticmethod(normalize_probability)

    def _ratio(self, x, f, s, g):
        with np.errstate(all="ignore"):
            return finite((x / (f @ s @ g.T + EPS)) ** self.alpha)

    def step(self, x, f, s, g):
        power = lambda b, num, den: finite(b * (np.maximum(num, 0) / (den + EPS)) ** (1 / self.alpha))
        gs = g @ s.T
        f = power(f, self._ratio(x, f, s, g) @ gs, gs.sum(0)[None] + self.orth_f * Pnmtf._others(f) + self.sum_f * f)
        fs = f @ s
        g = power(g, self._ratio(x, f, s, g).T @ fs, fs.sum(0)[None] + self.orth_g * Pnmtf._others(g) + self.sum_g * g)
        return f, power(s, f.T @ self._ratio(x, f, s, g) @ g, np.outer(f.sum(0), g.sum(0))), g

    def criterion(self, x, f, s, g):
        y = f @ s @ g.T + EPS
        if abs(self.alpha - 1) < 1e-12:
            with np.errstate(all="ignore"):
                return float(finite(x * np.log(x / y)).sum() - x.sum() + y.sum())
        a = self.alpha
        return float((x**a * y ** (1 - a) - a * x + (a - 1) * y).sum() / (a * (a - 1)))


# -- non-negative least squares and two-factor models ----------------------------------------------------------------------


def normal_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A x = b for a Gram matrix: a slightly ridged solve, else least squares."""
    if not a.size:
        return np.zeros_like(b)
    try:
        x = np.linalg.solve(a + np.eye(len(a)) * (1e-10 * max(np.abs(np.diag(a)).max(), 1e-300)), b)
        if np.isfinite(x).all():
            return x
    except np.linalg.LinAlgError:
        pass
    return np.linalg.lstsq(a, b, rcond=None)[0]


def _solve_by_pattern(ata: np.ndarray, atb: np.ndarray, passive: np.ndarray) -> np.ndarray:
    """X on the passive sets; columns with one pattern are solved together."""
    x = np.zeros_like(atb)
    patterns, inverse = np.unique(passive.T, axis=0, return_inverse=True)
    inverse = np.ravel(inverse)
    for k, p in enumerate(patterns):
        if p.any():
            cols = np.flatnonzero(inverse == k)
            x[np.ix_(p, cols)] = normal_solve(ata[np.ix_(p, p)], atb[np.ix_(p, cols)])
    return x


def nnls_bpp(ata: np.ndarray, atb: np.ndarray, init: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    """min ||A X - B|| with X >= 0 from the normal equations, by block principal pivoting; whether it converged."""
    k, q = atb.shape
    passive = np.zeros((k, q), bool) if init is None else init > 0
    x = _solve_by_pattern(ata, atb, passive)
    y = ata @ x - atb
    budget, least = np.full(q, 3), np.full(q, k + 1)
    for _ in range(5 * k + 1):
        x[np.abs(x) < 1e-12] = 0
        y[np.abs(y) < 1e-12] = 0
        wrong = ((y < 0) & ~passive) | ((x < 0) & passive)
        bad = wrong.sum(0)
        left = np.flatnonzero(bad)
        if not len(left):
            return np.maximum(x, 0), True
        for c in left:
            rows = np.flatnonzero(wrong[:, c])
            if bad[c] < least[c]:
                least[c], budget[c] = bad[c], 3
            elif budget[c] >= 1:
                budget[c] -= 1
            else:
                rows = rows[-1:]
            passive[rows, c] ^= True
        x[:, left] = _solve_by_pattern(ata, atb[:, left], passive[:, left])
        y[:, left] = ata @ x[:, left] - atb[:, left]
        x[~passive] = 0
        y[passive] = 0
    return np.maximum(x, 0), False


def nnls(a: np.ndarray, b: np.ndarray, init: np.ndarray | None = None) -> tuple[np.ndarray, bool]:
    return nnls_bpp(a.T @ a, a.T @ b, init)


def nnls_active_set(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The classic active-set method, a column at a time."""
    ata, atb = a.T @ a, a.T @ b
    out = np.zeros((a.shape[1], b.shape[1]))
    for c in range(b.shape[1]):
        x, passive = np.zeros(len(ata)), np.zeros(len(ata), bool)
        w = atb[:, c] - ata @ x
        for _ in range(10 * len(ata)):
            if passive.all() or w[~passive].max(initial=-np.inf) <= 1e-10:
                break
            passive[np.where(passive, -np.inf, w).argmax()] = True
            while True:
                s = np.zeros_like(x)
                s[passive] = normal_solve(ata[np.ix_(passive, passive)], atb[passive, c])
                if s[passive].min(initial=1) > 0:
                    break
                neg = passive & (s <= 0)
                t = (x[neg] / np.maximum(x[neg] - s[neg], 1e-300)).min()
                x = x + t * (s - x)
                passive &= x > 1e-12
            x = s
            w = atb[:, c] - ata @ x
        out[:, c] = x
    return out


def two_factor_error(x, w, h) -> float:
    d2 = (x * x).sum() - 2 * ((x @ h) * w).sum() + ((w.T @ w) * (h.T @ h)).sum()
    return float(np.sqrt(max(0.0, d2) / max((x * x).sum(), 1e-300)))


def unit_columns(w, h):
    n = np.linalg.norm(w, axis=0)
    ok = n > 1e-30
    return np.where(ok, w / np.where(ok, n, 1), w), np.where(ok, h * n, h)


def nmf(x: np.ndarray, k: int, max_iter: int = 50, seed: int = 42, method: str = "anls_bpp") -> tuple[np.ndarray, np.ndarray, float]:
    """X ~ W H^T by one of anls_bpp, anls_as, anls_group (the same solver with pattern grouping), hals, mu."""
    rng = np.random.default_rng(seed)
    w, h = rng.random((x.shape[0], k)), rng.random((x.shape[1], k))
    for _ in range(max_iter):
        if method in ("anls_bpp", "anls_group"):
            h = nnls_bpp(w.T @ w, w.T @ x, h.T)[0].T
            w = nnls_bpp(h.T @ h, h.T @ x.T, w.T)[0].T
        elif method == "anls_as":
            h = nnls_active_set(w, x).T
            w = nnls_active_set(h, x.T).T
        elif method == "hals":
            for a, b, y in ((h, w, x.T), (w, h, x)):
                p, q = y @ b, b.T @ b
                for r in range(k):
                    a[:, r] = np.maximum(a[:, r] + (p[:, r] - a @ q[:, r]) / max(q[r, r], EPS), EPS)
        elif method == "mu":
            h = mu(h, x.T @ w, h @ (w.T @ w))
            w = mu(w, x @ h, w @ (h.T @ h))
        else:
            raise ValueError(method)
        w, h = unit_columns(w, h)
    return w, h, two_factor_error(x, w, h)


@dataclass(frozen=True)
class Fnmf:
    """Two-factor NMF of rank max(nr, nc); labels from the first nr and nc columns of the restart of least error."""

    n_row: int
    n_col: int
    max_iter: int = 50
    n_init: int = 1
    seed: int = 42
    method: str = "anls_bpp"

    def __call__(self, x: np.ndarray) -> Labels:
        runs = [nmf(x, max(self.n_row, self.n_col), self.max_iter, self.seed + k, self.method) for k in range(self.n_init)]
        w, h, _ = min(runs, key=lambda r: r[2])
        return argmax_last(w[:, : self.n_row]), argmax_last(h[:, : self.n_col])


# -- co-clusters from labels ------------------------------------------------------------------------------------------------


def joint_blocks(rows: np.ndarray, cols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """One co-cluster per label that has rows and columns, by label."""
    return [(r, c) for k in sorted(set(rows.tolist()) - {-1}) if len(r := np.flatnonzero(rows == k)) and len(c := np.flatnonzero(cols == k))]


def cross_blocks(rows: np.ndarray, cols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """One co-cluster per pair of a row label and a column label."""
    return [(np.flatnonzero(rows == a), np.flatnonzero(cols == b)) for a in sorted(set(rows.tolist()) - {-1}) for b in sorted(set(cols.tolist()) - {-1})]


def blocks_of(atom, x: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    rows, cols = atom(x)
    return (joint_blocks if isinstance(atom, (Scc, Basic)) else cross_blocks)(rows, cols)
