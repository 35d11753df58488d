"""Building blocks of the SQL twins."""

from __future__ import annotations

SCORES = """round(avg(abs(pred - y)), 4) AS mae, round(sqrt(avg((pred - y) * (pred - y))), 4) AS rmse,
       round(1 - avg((pred - y) * (pred - y)) / var_pop(y), 6) AS r2"""


def drawn(name: str, src: str, seed: int) -> str:
    """``src`` with its rank ``rk`` in the draw of ``seed`` and the row count ``n``."""
    return f"""{name} AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY md5('{seed}:' || id)) AS rk, count(*) OVER () AS n FROM {src})"""


def fit(name: str, src: str, kind: str, x: str, y: str = "y") -> str:
    """CTEs holding a fitted model."""
    if kind == "ols":
        return f"""{name} AS MATERIALIZED (
  SELECT round(regr_slope({y}, {x}), 6) AS b, round(regr_intercept({y}, {x}), 6) AS a FROM {src})"""
    return f"""{name} AS MATERIALIZED (SELECT {x} AS k, round(avg({y}), 6) AS v FROM {src} GROUP BY 1),
{name}_all AS MATERIALIZED (SELECT round(sum({y}) / count({y}), 6) AS o FROM {src})"""


def predict(name: str, src: str, kind: str, x: str, pred: str = "pred") -> str:
    """A select that adds the model's prediction to ``src``."""
    if kind == "ols":
        return f"SELECT t.*, a + b * t.{x} AS {pred} FROM {src} t CROSS JOIN {name}"
    return f"SELECT t.*, coalesce(v, o) AS {pred} FROM {src} t CROSS JOIN {name}_all LEFT JOIN {name} ON k = t.{x}"


def prune_sql(
    fixture: str, src: str, n_iter: int, train_size: float, threshold: str, result: str,
    model=("ols", "n_lines"), second=None, join_model=False, threshold2: str | None = None,
    min_drop: str = "(SELECT count(*) // 100 FROM pool)", drop_max: int = 0, fixed: str | None = None,
    min_remaining: int = 300,
) -> str:
    """The pruning loop unrolled. ``threshold`` and ``threshold2`` are SQL scalars over
    ``pool`` and ``test``; ``fixed`` is a condition for rows that always train."""
    ctes = [fixture]
    body = src
    if fixed:
        ctes.append(f"fixed AS MATERIALIZED (SELECT * FROM {src} WHERE {fixed})")
        ctes.append(f"free AS MATERIALIZED (SELECT * FROM {src} WHERE NOT ({fixed}))")
        body = "free"
    ctes += [
        drawn("d", body, 0),
        "test AS MATERIALIZED (SELECT * EXCLUDE (rk, n) FROM d WHERE rk <= ceil(CAST(0.1 AS DOUBLE) * n))",
        "pool AS MATERIALIZED (SELECT * EXCLUDE (rk, n) FROM d WHERE rk > ceil(CAST(0.1 AS DOUBLE) * n))",
        fit("full_a", "pool", *model),
        f"thr AS MATERIALIZED (SELECT CAST({threshold} AS DOUBLE) AS t)",
    ]
    if second:
        ctes.append(fit("full_b", "pool", *second))
    if threshold2:
        ctes.append(f"thr2 AS MATERIALIZED (SELECT CAST({threshold2} AS DOUBLE) AS t2)")
    joined = lambda rows: f"(SELECT * FROM {rows} UNION ALL SELECT * FROM fixed)" if fixed else rows
    scores, chosen = [], []
    for i in range(n_iter):
        if i == 0:
            ctes.append("rem0 AS MATERIALIZED (SELECT * FROM pool)")
        else:
            ctes.append(f"rem{i} AS MATERIALIZED (SELECT * FROM rem{i-1} WHERE id NOT IN (SELECT id FROM del{i-1}))")
        ctes.append(drawn(f"d{i}", f"rem{i}", i))
        size = f"floor(CAST({train_size} AS DOUBLE) * n)"
        ctes.append(f"tr{i} AS MATERIALIZED (SELECT * EXCLUDE (rk, n) FROM d{i} WHERE rk <= {size})")
        ctes.append(f"nv{i} AS MATERIALIZED (SELECT * EXCLUDE (rk, n) FROM d{i} WHERE rk > {size})")
        ctes.append(fit(f"a{i}", joined(f"tr{i}"), *model))
        ctes.append(f"p{i} AS MATERIALIZED ({predict(f'a{i}', f'nv{i}', *model)})")
        errs = f"SELECT id, y, round(abs(pred - y), 6) AS err, round(abs(pred - y), 6) AS drv FROM p{i}"
        small = "err < (SELECT t FROM thr)"
        if join_model:
            ctes.append(fit(f"b{i}", joined(f"tr{i}"), *second))
            ctes.append(f"q{i} AS MATERIALIZED ({predict(f'b{i}', f'p{i}', *second, pred='pred2')})")
            errs = f"SELECT id, y, round(abs(pred - y), 6) AS err, round(abs(pred2 - y), 6) AS drv FROM q{i}"
            small += " AND drv < (SELECT t2 FROM thr2)"
        ctes.append(f"""e{i} AS MATERIALIZED (SELECT *, {small} AS small, row_number() OVER (ORDER BY drv, id) AS up,
  row_number() OVER (ORDER BY drv DESC, id) AS down FROM ({errs}))""")
        keep = f"CASE WHEN (SELECT count(*) FILTER (WHERE small) FROM e{i}) < {min_drop} THEN up <= {min_drop} ELSE small END"
        if drop_max:
            keep = f"({keep}) OR down <= {drop_max}"
        ctes.append(f"cand{i} AS MATERIALIZED (SELECT id, drv AS err FROM e{i} WHERE {keep})")
        go = f"(SELECT count(*) FROM cand{i}) <= (SELECT count(*) FROM rem{i}) - {min_remaining}"
        if i:
            go += f" AND (SELECT ok FROM go{i-1})"
        ctes.append(f"go{i} AS MATERIALIZED (SELECT {go} AS ok)")
        ctes.append(f"del{i} AS MATERIALIZED (SELECT * FROM cand{i} WHERE (SELECT ok FROM go{i}))")
        chosen.append(f"SELECT id, CAST({i} AS INTEGER) AS iter, err FROM del{i}")
        frame = "SELECT *, 'test' AS split FROM test"
        if i:
            gone = " UNION ALL ".join(f"SELECT id FROM del{j}" for j in range(i))
            frame += f" UNION ALL SELECT *, 'removed' AS split FROM pool WHERE id IN ({gone})"
        ctes.append(f"fr{i} AS MATERIALIZED ({frame})")
        for name, m in (("m1", model), ("m2", second)):
            if m is None:
                continue
            ctes.append(fit(f"f{name}{i}", joined(f"rem{i}"), *m))
            scores.append(
                f"SELECT CAST({i} AS INTEGER) AS iter, split, '{name}' AS model, count(*) AS n, {SCORES} "
                f"FROM ({predict(f'f{name}{i}', f'fr{i}', *m)}) WHERE (SELECT ok FROM go{i}) GROUP BY split"
            )
    ctes.append(f"chosen AS MATERIALIZED ({' UNION ALL '.join(chosen)})")
    ctes.append(f"scores AS MATERIALIZED ({' UNION ALL '.join(scores)})")
    return "WITH " + ",\n".join(ctes) + "\n" + result


def half_mae(name: str, model: tuple[str, str], frac: float = 0.5) -> str:
    return f"(SELECT round(avg(abs(pred - y)) * {frac}, 6) FROM ({predict(name, 'test', *model)}))"
