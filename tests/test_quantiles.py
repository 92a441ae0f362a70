"""The interpolated quantile transform against its rule on arrays."""

from statistics import NormalDist

import numpy as np
import pytest

from sparkrank.operators import encode


def by_rule(x, most):
    """Quantiles at even steps by linear interpolation; a value's place is the mean of what is found from below and from above."""
    there = x[np.isfinite(x)]
    q = np.quantile(there, np.linspace(0, 1, min(most, len(there))))
    part = np.linspace(0, 1, len(q))
    out = []
    for v in x:
        if not np.isfinite(v):
            out.append(0.0)
            continue
        below, above = np.flatnonzero(q <= v)[-1], np.flatnonzero(q >= v)[0]
        p = (part[below] + part[above]) / 2 if q[below] == q[above] else part[below] + (part[above] - part[below]) * (v - q[below]) / (q[above] - q[below])
        p = 1.0 if v + 1e-7 > q[-1] else 0.0 if v - 1e-7 < q[0] else p
        out.append(NormalDist().inv_cdf(min(max(p, 1e-7), 1 - 1e-7)))
    return out


@pytest.mark.parametrize("most", [7, 40, 1000])
def test_equals_the_rule(spark, most):
    rng = np.random.default_rng(most)
    cols = {"even": rng.normal(size=300), "ties": rng.integers(0, 5, 300).astype(float), "wide": np.exp(8 * rng.normal(size=300)), "few": np.full(300, np.nan), "one": np.full(300, 3.0)}
    cols["even"][::9], cols["few"][:8], cols["ties"][0] = np.nan, np.arange(8.0), np.inf
    rows = [(i, *(None if np.isnan(c[i]) else float(c[i]) for c in cols.values())) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols))
    tables = encode.quantile_tables(df, list(cols), most)
    for c in ("even", "ties", "wide"):
        there = cols[c][np.isfinite(cols[c])]
        assert tables[c] == pytest.approx(np.quantile(there, np.linspace(0, 1, min(most, len(there)))), rel=1e-12)
    got = {r["id"]: r for r in encode.quantile_gauss(df, list(cols), most=most).collect()}
    for c in ("even", "ties", "wide"):
        assert [got[i][f"{c}__gauss"] for i in range(300)] == pytest.approx(by_rule(cols[c], most), abs=1e-6)
    assert {got[i]["few__gauss"] for i in range(300)} == {0.0}  # too few values
    other = encode.quantile_gauss(df.where("id < 50"), ["even"], most=most, fit=df).where("id = 7").first()
    assert other["even__gauss"] == got[7]["even__gauss"]
