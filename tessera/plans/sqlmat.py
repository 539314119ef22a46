"""A small builder of matrix expressions in SQL, for oracles: every matrix is a query of r, c, v."""

from __future__ import annotations


class SqlMatrix:
    def __init__(self, *start: str):
        self.parts = list(start)
        self.k = 0

    def add(self, sql: str) -> str:
        self.k += 1
        self.parts.append(f"m{self.k} AS MATERIALIZED ({sql})")
        return f"m{self.k}"

    def mul(self, *names: str) -> str:
        out = names[0]
        for b in names[1:]:
            out = self.add(f"SELECT a.r, b.c, sum(a.v * b.v) AS v FROM {out} a JOIN {b} b ON a.c = b.r GROUP BY 1, 2")
        return out

    def t(self, a: str) -> str:
        return self.add(f"SELECT c AS r, r AS c, v FROM {a}")

    def update(self, base: str, num: str, den: str, root: bool) -> str:
        ratio = "n.v / (d.v + 1e-10)"
        ratio = f"sqrt({ratio})" if root else ratio
        return self.add(f"SELECT b.r, b.c, b.v * {ratio} AS v FROM {base} b JOIN {num} n USING (r, c) JOIN {den} d USING (r, c)")

    def plus_others(self, den: str, base: str, weight: float) -> str:
        return self.add(f"SELECT d.r, d.c, d.v + {weight} * (sum(b.v) OVER (PARTITION BY b.r) - b.v) AS v FROM {den} d JOIN {base} b USING (r, c)")

    def plus(self, den: str, base: str, weight: float) -> str:
        return self.add(f"SELECT d.r, d.c, d.v + {weight} * b.v AS v FROM {den} d JOIN {base} b USING (r, c)")

    def query(self, last: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + last


def tri_step(m: SqlMatrix, kind: str, x: str, f: str, s: str, g: str, w: float) -> tuple[str, str, str]:
    """One update of F, G and S by the textbook products, nothing re-associated for speed."""
    root = kind in ("onm3f", "pnmtf")
    st, gt, xt = m.t(s), m.t(g), m.t(x)
    num = m.mul(x, g, st)
    if kind == "onm3f":
        den = m.mul(f, m.mul(m.t(f), num))
    elif kind == "onmtf":
        den = m.mul(m.mul(f, s), m.mul(m.mul(gt, xt), f))
    else:
        den = m.mul(f, m.mul(m.mul(s, gt), m.mul(g, st)))
    den = m.plus_others(den, f, w) if kind == "pnmtf" else den
    f = m.update(f, num, den, root)
    ft = m.t(f)
    num = m.mul(xt, f, s)
    if kind == "onm3f":
        den = m.mul(g, m.mul(gt, num))
    elif kind == "onmtf":
        den = m.mul(m.mul(g, st), m.mul(m.mul(ft, x), g))
    else:
        den = m.mul(g, m.mul(m.mul(st, ft), m.mul(f, s)))
    den = m.plus_others(den, g, w) if kind == "pnmtf" else den
    g = m.update(g, num, den, root)
    num, den = m.mul(ft, x, g), m.mul(m.mul(ft, f), s, m.mul(m.t(g), g))
    den = m.plus(den, s, w) if kind == "pnmtf" else den
    return f, m.update(s, num, den, root), g
