"""DuckDB SQL for every SQL-checkable query in ``queries`` (same column names).

Written independently of the Spark plans: plain SQL over the registered views.  The
ADMM traces are unrolled CTE chains (a fixed pass count, the 2 x 2 solve written out).
"""

from __future__ import annotations

from concord.plans.queries import CEE, KAPPA, OPTIMUM_LAMBDAS, PASSES, PATH_LAMBDAS, RHO, SGD, W3, W_LR, WIDE_LAMBDA, Z2, Z2_PREV, Z3


def rnd(expr: str, digits: int) -> str:
    return f"(round({expr}, {digits}) + 0.0)"


def r6(expr: str) -> str:
    return rnd(expr, 6)


def r3(expr: str) -> str:
    return rnd(expr, 3)


def _d(v: float) -> str:
    return f"CAST({float(v)!r} AS DOUBLE)"


def _values_z(z: list[float], name: str = "z") -> str:
    rows = ", ".join(f"({j}, {_d(v)})" for j, v in enumerate(z))
    return f"(SELECT * FROM (VALUES {rows}) AS t(j, {name}))"


LI = """li AS (
  SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax, l_extendedprice,
         CAST(((l_orderkey % 4) + 4) % 4 AS INTEGER) AS block_id,
         l_quantity / 50.0 - 0.5 AS a,
         l_discount * 10.0 - 0.5 AS c,
         l_tax * 12.5 - 0.5 AS t,
         3.0 * (l_quantity / 50.0 - 0.5) - 2.0 * (l_discount * 10.0 - 0.5) + (l_extendedprice / 100000.0 - 0.5) AS b
  FROM lineitem)"""

CLS = LI + """,
cls AS (SELECT *, CASE WHEN b > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
               CASE WHEN b > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS ypm FROM li)"""

TEXT = LI + """,
tok AS (
  SELECT l_orderkey, l_linenumber, l_quantity,
         CASE WHEN b > 0 THEN '+1' ELSE '-1' END AS lab,
         CAST(CAST(round(l_quantity) AS INTEGER) AS VARCHAR) AS q,
         CAST(round(l_discount * 100) AS INTEGER) AS d,
         CAST(round(l_tax * 100) AS INTEGER) AS tt
  FROM li),
txt0 AS (
  SELECT l_orderkey, l_linenumber, l_quantity, lab, q, tt,
    CASE
      WHEN l_linenumber = 4 THEN '  ' || lab || '  ' || ('1:' || q) || '  ' || coalesce(CASE WHEN tt <> 0 THEN '3:' || CAST(tt AS VARCHAR) END, '') || ' '
      WHEN l_linenumber = 5 THEN lab
      WHEN l_linenumber = 6 THEN '# order ' || CAST(l_orderkey AS VARCHAR)
      WHEN l_linenumber = 7 THEN '   '
      ELSE concat_ws(' ', lab, '1:' || q, CASE WHEN d <> 0 THEN '2:' || CAST(d AS VARCHAR) END,
                     CASE WHEN tt <> 0 THEN '3:' || CAST(tt AS VARCHAR) END)
    END AS value
  FROM tok)"""

BAD_TEXT = TEXT + """,
txt AS (
  SELECT l_orderkey, l_linenumber,
    CASE
      WHEN l_linenumber = 1 AND l_quantity < 5 THEN concat_ws(' ', lab, '1:' || q, '1:' || q)
      WHEN l_linenumber = 2 AND l_quantity < 5 THEN lab || ' ' || q
      WHEN l_linenumber = 3 AND l_quantity < 5 THEN chr(9) || '# order ' || CAST(l_orderkey AS VARCHAR)
      WHEN l_linenumber = 4 AND l_quantity < 5 THEN concat_ws(' ', lab, '3:' || CAST(tt AS VARCHAR), '1:' || q)
      WHEN l_linenumber = 5 AND l_quantity < 5 THEN lab || ' 0:' || q
      WHEN l_linenumber = 6 AND l_quantity < 5 THEN 'label 1:' || q
      WHEN l_linenumber = 7 AND l_quantity < 5 THEN lab || ' 1:x'
      ELSE value
    END AS value
  FROM txt0)"""

GOOD_TEXT = TEXT + """,
txt AS (SELECT l_orderkey, l_linenumber, value FROM txt0)"""

PARSED = """,
clean AS (SELECT l_orderkey, l_linenumber, trim(value, chr(9) || ' ') AS line FROM txt
          WHERE NOT (length(trim(value, chr(9) || ' ')) = 0 OR starts_with(trim(value, chr(9) || ' '), '#'))),
split AS (SELECT *, string_split(line, ' ') AS toks FROM clean),
items AS (SELECT *, TRY_CAST(toks[1] AS DOUBLE) AS raw_label,
                 list_filter(toks[2:], lambda x: x <> '') AS its FROM split),
parsed AS (
  SELECT l_orderkey, l_linenumber, line, raw_label,
         its, list_transform(its, lambda x: TRY_CAST(split_part(x, ':', 1) AS INTEGER) - 1) AS indices,
         list_transform(its, lambda x: TRY_CAST(split_part(x, ':', 2) AS DOUBLE)) AS vals
  FROM items),
flagged AS (
  SELECT *, (raw_label IS NULL
             OR len(list_filter(indices, lambda i: i IS NULL)) > 0
             OR len(list_filter(vals, lambda v: v IS NULL)) > 0
             OR len(list_filter(its, lambda x: len(string_split(x, ':')) <> 2)) > 0
             OR len(list_filter(range(1, len(indices) + 1),
                                lambda k: indices[k] <= CASE WHEN k = 1 THEN -1 ELSE indices[k - 1] END)) > 0) AS bad
  FROM parsed)"""


def _vsum(col: str) -> str:
    return f"coalesce(list_sum({col}), 0.0)"


STATE2 = LI + """,
st AS (
  SELECT block_id, [avg(a * b), avg(c * b)] AS x, [avg(a) - avg(c), avg(a * c)] AS y
  FROM li GROUP BY block_id),
stl AS (
  SELECT block_id, j - 1 AS j, x[j] AS x, y[j] AS y FROM st, range(1, 3) AS r(j))"""

STATE3 = CLS + """,
st AS (
  SELECT block_id, [avg(ypm * a), avg(ypm * c), avg(ypm * t)] AS x,
         [avg(a) / 10.0, avg(c) / 10.0, avg(t) / 10.0] AS y
  FROM cls GROUP BY block_id),
stl AS (SELECT block_id, j - 1 AS j, x[j] AS x, y[j] AS y FROM st, range(1, 4) AS r(j)),
rows3 AS (
  SELECT cls.block_id, label, ypm, [a, c, t] AS f, st.x AS w,
         a * st.x[1] + c * st.x[2] + t * st.x[3] AS m
  FROM cls JOIN st USING (block_id))"""


def _prox(z: list[float]) -> str:
    return f""",
zt AS {_values_z(z)},
prox AS (SELECT block_id, j, x - zt.z + y / {_d(RHO)} AS d FROM stl JOIN zt USING (j)),
proxv AS (SELECT block_id, {_d(RHO / 2.0)} * sum(d * d) AS prox FROM prox GROUP BY block_id)"""


def _unrolled_ridge(lam: float, l1: bool, adaptive: bool, passes: int = PASSES) -> tuple[str, list[str]]:
    """CTE chain for ADMM on reg_small (p = 2, N = 4 blocks) from x = y = z = 0."""
    n_blocks = 4
    ctes = [LI, """g AS (SELECT block_id, count(*)::DOUBLE AS n, sum(a * a) AS g11, sum(a * c) AS g12, sum(c * c) AS g22,
                 sum(a * b) AS q1, sum(c * b) AS q2 FROM li GROUP BY block_id)""",
            """s0 AS (SELECT block_id, n, g11, g12, g22, q1, q2, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2,
                  0.0::DOUBLE AS y1, 0.0::DOUBLE AS y2 FROM g)""",
            f"z0 AS (SELECT 0.0::DOUBLE AS z1, 0.0::DOUBLE AS z2, {_d(RHO)} AS rho)"]
    traces = []
    base = f"({_d(1e-3)} * sqrt({_d(2 * n_blocks)}))"
    for k in range(1, passes + 1):
        p, s, z = k - 1, f"s{k - 1}", f"z{k - 1}"
        # x-update with z_{k-1}, y_{k-1}, rho_{k-1}: (G/n + rho I) x = q/n + rho z - y
        ctes.append(f"""x{k} AS (
  SELECT block_id, n, g11, g12, g22, q1, q2, y1, y2, rho,
         (h22 * r1 - h12 * r2) / (h11 * h22 - h12 * h12) AS x1,
         (h11 * r2 - h12 * r1) / (h11 * h22 - h12 * h12) AS x2
  FROM (SELECT {s}.*, {z}.rho, g11 / n + {z}.rho AS h11, g12 / n AS h12, g22 / n + {z}.rho AS h22,
               q1 / n + {z}.rho * {z}.z1 - y1 AS r1, q2 / n + {z}.rho * {z}.z2 - y2 AS r2
        FROM {s}, {z}))""")
        if l1:
            kap = f"({_d(lam)} / (rho * {n_blocks}))"
            ctes.append(f"""u{k} AS (SELECT sum(x1 + y1 / rho) / {n_blocks} AS m1, sum(x2 + y2 / rho) / {n_blocks} AS m2,
                 any_value(rho) AS rho FROM x{k})""")
            zexpr = lambda m: f"(CASE WHEN {m} > {kap} THEN {m} - {kap} WHEN {m} < -{kap} THEN {m} + {kap} ELSE 0.0::DOUBLE END)"
            ctes.append(f"zn{k} AS (SELECT {zexpr('m1')} AS z1, {zexpr('m2')} AS z2, rho FROM u{k})")
        else:
            ctes.append(f"""zn{k} AS (SELECT rr / (rr * {n_blocks} + {_d(2 * lam)}) * s1 AS z1, rr / (rr * {n_blocks} + {_d(2 * lam)}) * s2 AS z2,
                  rr AS rho FROM (SELECT any_value(rho) AS rr, sum(x1 + y1 / rho) AS s1, sum(x2 + y2 / rho) AS s2 FROM x{k}))""")
        ctes.append(f"""s{k} AS (SELECT x{k}.block_id, n, g11, g12, g22, q1, q2, x1, x2,
                  y1 + zn{k}.rho * (x1 - zn{k}.z1) AS y1, y2 + zn{k}.rho * (x2 - zn{k}.z2) AS y2
           FROM x{k}, zn{k})""")
        ctes.append(f"""t{k} AS (
  SELECT {p} AS iter, r, ep, s, ed, zn{k}.rho AS rho
  FROM (SELECT sqrt(sum((x1 - zn{k}.z1) * (x1 - zn{k}.z1) + (x2 - zn{k}.z2) * (x2 - zn{k}.z2))) AS r,
               {_d(1e-3)} * greatest(sqrt(sum(x1 * x1 + x2 * x2)), sqrt({_d(n_blocks)}) * sqrt(any_value(zn{k}.z1 * zn{k}.z1 + zn{k}.z2 * zn{k}.z2))) + {base} AS ep
        FROM x{k}, zn{k}) pr,
       (SELECT {_d(1e-3)} * sqrt(sum(y1 * y1 + y2 * y2)) + {base} AS ed FROM s{k}) du,
       (SELECT zn{k}.rho * sqrt({_d(n_blocks)}) * sqrt((zn{k}.z1 - {z}.z1) * (zn{k}.z1 - {z}.z1) + (zn{k}.z2 - {z}.z2) * (zn{k}.z2 - {z}.z2)) AS s
        FROM zn{k}, {z}) dl,
       zn{k})""")
        if adaptive:
            rho_next = f"""(SELECT CASE WHEN s < ed THEN r2 * 1.2 ELSE r2 END AS rho FROM (
                 SELECT s, ed, CASE WHEN r < ep THEN r1 / 1.2 ELSE r1 END AS r2 FROM (
                   SELECT r, ep, s, ed, CASE WHEN r / ep > 10.0 * s / ed THEN rho * 2.0
                                             WHEN s / ed > 10.0 * r / ep THEN rho / 2.0 ELSE rho END AS r1
                   FROM t{k})))"""
            ctes.append(f"z{k} AS (SELECT zn{k}.z1, zn{k}.z2, rn.rho FROM zn{k}, {rho_next} rn)")
        else:
            ctes.append(f"z{k} AS (SELECT z1, z2, rho FROM zn{k})")
        traces.append(f"t{k}")
    return ",\n".join(ctes), traces


def _trace_sql(lam, l1, adaptive=False) -> str:
    ctes, traces = _unrolled_ridge(lam, l1, adaptive)
    cols = ", ".join(f"{r6(c)} AS {n}" for c, n in [("r", "resid_primal"), ("ep", "eps_primal"), ("s", "resid_dual"),
                                                     ("ed", "eps_dual"), ("rho", "rho")])
    union = " UNION ALL ".join(f"SELECT iter, {cols} FROM {t}" for t in traces)
    return f"WITH {ctes}\n{union}"


def _weights_sql(lam, l1) -> str:
    ctes, _ = _unrolled_ridge(lam, l1, False)
    last = f"z{PASSES}"
    return (f"WITH {ctes}\nSELECT 0 AS j, {r6('z1')} AS weight FROM {last} "
            f"UNION ALL SELECT 1 AS j, {r6('z2')} AS weight FROM {last}")


def _path_sql() -> str:
    parts = []
    for lam in PATH_LAMBDAS:
        ctes, _ = _unrolled_ridge(lam, False, False)
        last = f"z{PASSES}"
        parts.append(f"""(WITH {ctes}
SELECT {_d(lam)} AS lambda, 0 AS j, {r6('z1')} AS weight FROM {last}
UNION ALL SELECT {_d(lam)} AS lambda, 1 AS j, {r6('z2')} AS weight FROM {last})""")
    return "\nUNION ALL\n".join(f"SELECT * FROM {p}" for p in parts)


def _rho_update_sql() -> str:
    ctes, traces = _unrolled_ridge(1.0, False, False)
    union = " UNION ALL ".join(f"SELECT iter, r, ep, s, ed, rho FROM {t}" for t in traces)
    return f"""WITH {ctes}, tr AS ({union})
SELECT iter, {r6('CASE WHEN s < ed THEN r2 * 1.2 ELSE r2 END')} AS rho_next FROM (
  SELECT iter, s, ed, CASE WHEN r < ep THEN r1 / 1.2 ELSE r1 END AS r2 FROM (
    SELECT iter, r, ep, s, ed, CASE WHEN r / ep > 10.0 * s / ed THEN rho * 2.0
                                    WHEN s / ed > 10.0 * r / ep THEN rho / 2.0 ELSE rho END AS r1 FROM tr))"""


def _dot3(w: list[float], a="a", c="c", t="t") -> str:
    return f"({a} * {_d(w[0])} + {c} * {_d(w[1])} + {t} * {_d(w[2])})"


def _sigmoid(m: str) -> str:
    return f"(1.0 / (1.0 + exp(-({m}))))"


def _logloss(m: str) -> str:
    return f"(CASE WHEN {m} > 0 THEN ln(1 + exp(-({m}))) ELSE -({m}) + ln(1 + exp({m})) END)"


SCORED = CLS + f""",
scored AS (SELECT l_orderkey, l_linenumber, label, {_sigmoid(_dot3(W_LR))} AS score FROM cls),
pred AS (SELECT *, CASE WHEN score > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS prediction FROM scored)"""

BY_SCORE = SCORED + """,
conf AS (SELECT round(score, 12) AS score, sum(CASE WHEN label > 0.5 THEN 1 ELSE 0 END) AS tp,
                sum(CASE WHEN label > 0.5 THEN 0 ELSE 1 END) AS fp FROM pred GROUP BY 1),
cum AS (SELECT score, tp, fp, sum(tp) OVER (ORDER BY score DESC) AS cum_tp, sum(fp) OVER (ORDER BY score DESC) AS cum_fp FROM conf),
tot AS (SELECT sum(tp)::DOUBLE AS P FROM conf)"""

REG_PRED = LI + """,
rp AS (SELECT b AS label, a * 3.0 + c * (-2.0) AS prediction FROM li)"""


def _gram_lines() -> str:
    return LI + """,
g AS (SELECT block_id, count(*) AS n, sum(a * a) AS g00, sum(a * c) AS g01, sum(c * c) AS g11,
             sum(a * b) AS q0, sum(c * b) AS q1 FROM li GROUP BY block_id)"""


def _ls_x_update_sql() -> str:
    return f"""WITH {_gram_lines()},
stt AS (SELECT block_id, avg(a * b) AS x1, avg(c * b) AS x2, avg(a) - avg(c) AS y1, avg(a * c) AS y2 FROM li GROUP BY block_id),
h AS (SELECT g.block_id, g00 / n + {_d(RHO)} AS h11, g01 / n AS h12, g11 / n + {_d(RHO)} AS h22,
             q0 / n + {_d(RHO)} * {_d(Z2[0])} - y1 AS r1, q1 / n + {_d(RHO)} * {_d(Z2[1])} - y2 AS r2
      FROM g JOIN stt USING (block_id))
SELECT block_id, 0 AS j, {r6('(h22 * r1 - h12 * r2) / (h11 * h22 - h12 * h12)')} AS x FROM h
UNION ALL
SELECT block_id, 1 AS j, {r6('(h11 * r2 - h12 * r1) / (h11 * h22 - h12 * h12)')} AS x FROM h"""


def _loss_terms(kind: str, w: list[str]) -> tuple[str, str]:
    """(derivative by the margin, curvature) of a row's loss at weights ``w``."""
    m = f"({w[0]} * a + {w[1]} * c + {w[2]} * t)"
    if kind == "lr":
        mu = f"(1.0 / (1.0 + exp(-{m})))"
        return f"({mu} - label)", f"({mu} * (1.0 - {mu}))"
    active = f"(CASE WHEN 1.0 - ypm * {m} > 0 THEN {_d(2 * CEE)} ELSE 0.0::DOUBLE END)"
    return f"({active} * ({m} - ypm))", active


def _newton_chain(kind: str, lam2: float, shift: list[str], free: int, mean: bool, source: str, name: str, steps: int = 60) -> str:
    """Recursive Newton iterations over the whole table: gradient and Hessian of the summed
    loss + lam2 |w|^2 + shift . w over the first ``free`` coordinates, 3 x 3 solve by cofactors;
    other coordinates stay 0."""
    d, h = _loss_terms(kind, ["w1", "w2", "w3"])
    wt = "wt" if mean else "1.0::DOUBLE"
    x = ["a", "c", "t"]
    grads = ", ".join(f"sum({wt} * {d} * {x[i]}) + 2 * {_d(lam2)} * w{i + 1} + {shift[i]} AS g{i + 1}" if i < free else f"0.0::DOUBLE AS g{i + 1}"
                      for i in range(3))
    hess = ", ".join((f"sum({wt} * {h} * {x[i]} * {x[j]})" + (f" + 2 * {_d(lam2)}" if i == j else "") if j < free
                      else ("1.0::DOUBLE" if i == j else "0.0::DOUBLE")) + f" AS h{i + 1}{j + 1}" for i in range(3) for j in range(i, 3))
    det = "(h11 * (h22 * h33 - h23 * h23) - h12 * (h12 * h33 - h23 * h13) + h13 * (h12 * h23 - h22 * h13))"
    s1 = f"((h22 * h33 - h23 * h23) * g1 + (h13 * h23 - h12 * h33) * g2 + (h12 * h23 - h13 * h22) * g3) / {det}"
    s2 = f"((h13 * h23 - h12 * h33) * g1 + (h11 * h33 - h13 * h13) * g2 + (h12 * h13 - h11 * h23) * g3) / {det}"
    s3 = f"((h12 * h23 - h13 * h22) * g1 + (h12 * h13 - h11 * h23) * g2 + (h11 * h22 - h12 * h12) * g3) / {det}"
    # half steps while far from the optimum keep the iteration monotone
    step = "(CASE WHEN k < 40 THEN 0.5 ELSE 1.0 END)"
    return f"""{name}(k, w1, w2, w3) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, w1 - {step} * {s1}, w2 - {step} * {s2}, w3 - {step} * {s3}
  FROM (SELECT k, w1, w2, w3, {grads}, {hess} FROM {name}, {source} WHERE k < {steps} GROUP BY k, w1, w2, w3))"""


CLS_MAT = CLS.replace("cls AS (", "clsv AS (") + """,
cls AS MATERIALIZED (SELECT a, c, t, label, ypm, 1.0 / count(*) OVER (PARTITION BY block_id) AS wt FROM clsv)"""


def _newton_sql(kind: str, lam: float, mean: bool = False) -> str:
    chain = _newton_chain(kind, lam, ["0.0"] * 3, 3, mean, "cls", "it")
    union = " UNION ALL ".join(f"SELECT {j} AS j, {r3(f'w{j + 1}')} AS weight FROM it WHERE k = 60" for j in range(3))
    return f"WITH RECURSIVE {CLS_MAT},\n{chain}\n{union}"


def _newton_l1_sql(kind: str, lam: float) -> str:
    """Weights 1 and 2 have the planted signs (+, -).  Without weight 3 first; if the gradient
    there is beyond lam, all three with the sign it then takes."""
    two = _newton_chain(kind, 0.0, [_d(lam), _d(-lam), "0.0"], 2, False, "cls", "two")
    three = _newton_chain(kind, 0.0, [_d(lam), _d(-lam), f"{_d(lam)} * any_value(s3)"], 3, False, "(SELECT cls.*, s3 FROM cls, side)", "three")
    d, _ = _loss_terms(kind, ["w1", "w2", "0.0::DOUBLE"])
    pick = lambda j: f"CASE WHEN abs(g3) <= {_d(lam)} THEN two.w{j} ELSE three.w{j} END"
    union = " UNION ALL ".join(f"SELECT {j} AS j, {r3(pick(j + 1))} AS weight FROM two, three, side WHERE two.k = 60 AND three.k = 60"
                               for j in range(3))
    return f"""WITH RECURSIVE {CLS_MAT},
{two},
side AS MATERIALIZED (SELECT g3, -sign(g3) AS s3 FROM (SELECT sum({d} * t) AS g3 FROM cls, two WHERE k = 60)),
{three}
{union}"""


def _wide_newton_mean_sql(lam: float, width: int = 64, steps: int = 120) -> str:
    """Mean logistic loss per block + lam |w|^2 over the embeddings by gradient descent: the
    loss curvature is small against 2 lam, so a fixed step contracts fast."""
    return f"""WITH RECURSIVE rows AS MATERIALIZED (
  SELECT embedding::DOUBLE[] AS f, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
         1.0 / count(*) OVER (PARTITION BY vec_id % 4) AS wt FROM embeddings),
it(k, w) AS (
  SELECT 0, list_transform(range({width}), lambda x: 0.0::DOUBLE)
  UNION ALL
  SELECT k + 1, list(wj - {_d(0.8 / (2 * lam))} * (g + {_d(2 * lam)} * wj) ORDER BY j)
  FROM (SELECT k, j, any_value(w[j]) AS wj, sum(e * f[j]) AS g
        FROM (SELECT k, w, f, wt * (1.0 / (1.0 + exp(-list_dot_product(w, f))) - y) AS e FROM it, rows WHERE k < {steps}),
             range(1, {width + 1}) AS r(j) GROUP BY k, j)
  GROUP BY k)
SELECT CAST(j - 1 AS INTEGER) AS j, {rnd('w[j]', 4)} AS weight FROM it, range(1, {width + 1}) AS r(j) WHERE k = {steps}"""


def _slots_newton_sql(lam: float, width: int = 4096, steps: int = 40) -> str:
    """Mean logistic loss per block + lam w^2, slot by slot: one-dimensional Newton steps, halved at first."""
    return f"""WITH RECURSIVE {LI.replace("l_extendedprice,", "l_extendedprice, l_partkey,", 1)},
rows AS MATERIALIZED (
  SELECT CAST(((l_partkey % {width}) + {width}) % {width} AS INTEGER) AS j, 1.0 + t AS v, CASE WHEN b > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
         1.0 / count(*) OVER (PARTITION BY block_id) AS wt FROM li),
it(k, j, w) AS (
  SELECT 0, j, 0.0::DOUBLE FROM (SELECT DISTINCT j FROM rows)
  UNION ALL
  SELECT k + 1, j, w - CASE WHEN k < 20 THEN 0.5 ELSE 1.0 END * (g + {_d(2 * lam)} * w) / (h + {_d(2 * lam)})
  FROM (SELECT k, rows.j, w, sum(wt * v * (1.0 / (1.0 + exp(-w * v)) - label)) AS g,
               sum(wt * v * v * (1.0 / (1.0 + exp(-w * v))) * (1.0 - 1.0 / (1.0 + exp(-w * v)))) AS h
        FROM it JOIN rows USING (j) WHERE k < {steps} GROUP BY k, rows.j, w))
SELECT CAST(s.j AS INTEGER) AS j, {rnd('coalesce(w, 0.0)', 2)} AS weight FROM range(0, {width}) AS s(j) LEFT JOIN (SELECT j, w FROM it WHERE k = {steps}) f ON f.j = s.j"""


REG_MEANS = """m AS (SELECT avg(a * a) AS aa, avg(a * c) AS ac, avg(c * c) AS cc, avg(a * b) AS ab, avg(c * b) AS cb FROM li GROUP BY block_id),
h AS (SELECT sum(aa) AS p, sum(ac) AS q, sum(cc) AS r, sum(ab) AS u, sum(cb) AS v FROM m)"""


def _ridge_closed_sql(lam: float, digits: int = 3) -> str:
    """(sum of block means of x x^T + 2 lam I) w = sum of block means of b x, 2 x 2."""
    return f"""WITH {LI}, {REG_MEANS}, {_ridge_weights(lam)}
SELECT 0 AS j, {rnd('w0', digits)} AS weight FROM w UNION ALL SELECT 1, {rnd('w1', digits)} FROM w"""


def _ridge_weights(lam: float, name: str = "w") -> str:
    p, r = f"(p + {_d(2 * lam)})", f"(r + {_d(2 * lam)})"
    return f"{name} AS (SELECT ({r} * u - q * v) / ({p} * {r} - q * q) AS w0, ({p} * v - q * u) / ({p} * {r} - q * q) AS w1 FROM h)"


def _lasso_weights(lam: float, name: str = "w", steps: int = 300) -> str:
    """Coordinate descent: each weight in turn is the soft-thresholded solution for it."""
    def soft(t: str, by: str) -> str:
        return f"(sign({t}) * greatest(abs({t}) - {_d(lam)}, 0.0) / {by})"

    return f"""{name}_it(k, w0, w1) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, w0, {soft("(v - q * w0)", "r")} FROM (
    SELECT k, {soft("(u - q * w1)", "p")} AS w0, p, q, r, u, v FROM {name}_it, h WHERE k < {steps})),
{name} AS (SELECT w0, w1 FROM {name}_it WHERE k = {steps})"""


def _lasso_optimum_sql(lam: float) -> str:
    return f"""WITH RECURSIVE {LI}, {REG_MEANS}, {_lasso_weights(lam)}
SELECT 0 AS j, {rnd('w0', 4)} AS weight FROM w UNION ALL SELECT 1, {rnd('w1', 4)} FROM w"""


def _optimum_path_sql(weights) -> str:
    ctes = ", ".join(weights(lam, f"w_{k}") for k, lam in enumerate(OPTIMUM_LAMBDAS))
    rows = " UNION ALL ".join(f"SELECT {_d(lam)} AS lambda, {j} AS j, {rnd(f'w{j}', 4)} AS weight FROM w_{k}"
                              for k, lam in enumerate(OPTIMUM_LAMBDAS) for j in (0, 1))
    return f"WITH RECURSIVE {LI}, {REG_MEANS}, {ctes} {rows}"


def _sgd_sql() -> str:
    """The steps of mini-batch SGD, unrolled by recursion: the batch of step t holds the rows whose
    bucket of md5(key:t) is below the fraction."""
    m = "(w1 * a + w2 * c + w3 * t)"
    bucket = "CAST('0x' || substr(md5(l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR || ':' || (k + 1)::VARCHAR), 1, 8) AS BIGINT) % 1000000"
    s = f"({_d(SGD['step'])} / sqrt((k + 1)::DOUBLE))"
    grad = [f"sum(CASE WHEN ypm * {m} < 1.0 THEN -ypm * {x} ELSE 0.0::DOUBLE END) / count(*) AS g{i}" for i, x in enumerate("act", 1)]
    new = [f"(1.0 - {s} * {_d(SGD['lam'])}) * w{i} - {s} * g{i}" for i in (1, 2, 3)]
    return f"""WITH RECURSIVE {CLS},
it(k, w1, w2, w3) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, {", ".join(new)}
  FROM (SELECT k, w1, w2, w3, {", ".join(grad)} FROM it, cls WHERE k < {SGD['iterations']} AND {bucket} < {int(1_000_000 * SGD['fraction'])} GROUP BY k, w1, w2, w3))
""" + " UNION ALL ".join(f"SELECT {j} AS j, {r6(f'w{j + 1}')} AS weight FROM it WHERE k = {SGD['iterations']}" for j in range(3))


def _lasso_intercept_sql(reg: float) -> str:
    """min 1/(2n) |b - w.x - i|^2 + reg |w|_1 by coordinate descent on the centred moments."""
    soft = lambda v, q: f"(CASE WHEN {v} > {_d(reg)} THEN ({v} - {_d(reg)}) / {q} WHEN {v} < -{_d(reg)} THEN ({v} + {_d(reg)}) / {q} ELSE 0.0::DOUBLE END)"
    return f"""WITH RECURSIVE {LI},
m AS MATERIALIZED (SELECT avg(a) AS ma, avg(c) AS mc, avg(b) AS mb, covar_pop(a, a) AS aa, covar_pop(a, c) AS ac, covar_pop(c, c) AS cc,
             covar_pop(a, b) AS ab, covar_pop(c, b) AS cb FROM li),
it(k, w1, w2) AS (
  SELECT 0, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k + 1, n1, {soft('(cb - ac * n1)', 'cc')} FROM (SELECT k, {soft('(ab - ac * w2)', 'aa')} AS n1, ac, cc, cb FROM it, m WHERE k < 100))
SELECT 0 AS j, {r3('w1')} AS weight FROM it WHERE k = 100
UNION ALL SELECT 1, {r3('w2')} FROM it WHERE k = 100
UNION ALL SELECT -1, {r3('mb - w1 * ma - w2 * mc')} FROM it, m WHERE k = 100"""


def oracle_sql() -> dict[str, str]:
    sq: dict[str, str] = {}

    # ---------------- sources
    sq["libsvm_clean_lines"] = f"""WITH {GOOD_TEXT}
SELECT l_orderkey, l_linenumber, trim(value) AS line FROM txt
WHERE NOT (length(trim(value)) = 0 OR starts_with(trim(value), '#'))"""
    sq["libsvm_parse"] = f"""WITH {GOOD_TEXT}{PARSED}
SELECT l_orderkey, l_linenumber, {r6('raw_label')} AS label, len(indices) AS nnz,
       array_to_string(indices, ',') AS idx, {r6(_vsum('vals'))} AS val_sum FROM parsed"""
    sq["libsvm_bad_rows"] = f"""WITH {BAD_TEXT}{PARSED}
SELECT l_orderkey, l_linenumber, line FROM flagged WHERE bad"""
    for name, relabel in [("libsvm_load_binary", True), ("libsvm_load_raw", False)]:
        lab = "CASE WHEN raw_label = -1.0 THEN 0.0::DOUBLE ELSE raw_label END" if relabel else "raw_label"
        sq[name] = f"""WITH {GOOD_TEXT}{PARSED},
width AS (SELECT max(CASE WHEN len(indices) = 0 THEN 0 ELSE indices[-1] END) + 1 AS d FROM parsed)
SELECT l_orderkey, l_linenumber, {r6(lab)} AS label, CAST(d AS INTEGER) AS size, len(indices) AS nnz,
       array_to_string(indices, ',') AS idx, {r6(_vsum('vals'))} AS val_sum
FROM parsed, width"""
    sq["libsvm_good_rows"] = f"""WITH {BAD_TEXT}{PARSED},
width AS (SELECT max(CASE WHEN len(indices) = 0 THEN 0 ELSE indices[-1] END) + 1 AS d FROM flagged WHERE NOT bad)
SELECT l_orderkey, l_linenumber, {r6("CASE WHEN raw_label = -1.0 THEN 0.0::DOUBLE ELSE raw_label END")} AS label, CAST(d AS INTEGER) AS size,
       len(indices) AS nnz, array_to_string(indices, ',') AS idx, {r6(_vsum('vals'))} AS val_sum
FROM flagged, width WHERE NOT bad"""
    last = "CASE WHEN len(indices) = 0 THEN 0 ELSE indices[-1] END"
    sq["libsvm_load_files"] = f"""WITH {GOOD_TEXT}{PARSED}
SELECT count(*) AS n_rows, count(*) FILTER (raw_label = 1.0) AS n_positive, sum(len(indices))::BIGINT AS nnz, {r3(f"sum({_vsum('vals')})")} AS val_sum,
       CAST(max({last}) + 1 AS INTEGER) AS size, CAST(max({last}) + 1 AS INTEGER) AS width FROM parsed"""
    sq["load_datasets_width"] = f"""WITH {GOOD_TEXT}{PARSED}
SELECT count(*) FILTER (l_linenumber <> 1) AS n_train, count(*) FILTER (l_linenumber = 1) AS n_test,
       CAST(max({last}) FILTER (l_linenumber <> 1) + 1 AS INTEGER) AS width, count(*) FILTER (l_linenumber = 1) AS n_builtin,
       CAST(max({last}) FILTER (l_linenumber <> 1) + 1 AS INTEGER) AS builtin_width, {r3(f"sum({_vsum('vals')}) FILTER (l_linenumber = 1)")} AS builtin_sum
FROM parsed"""
    sq["num_features"] = f"""WITH {GOOD_TEXT}{PARSED}
SELECT CAST(max(CASE WHEN len(indices) = 0 THEN 0 ELSE indices[-1] END) + 1 AS INTEGER) AS num_features FROM parsed"""
    sq["dense_points_parse"] = f"""WITH {LI},
pts AS (SELECT l_orderkey, l_linenumber, CASE WHEN b > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label,
               [round(l_quantity), round(l_discount * 100), round(l_tax * 100)] AS f FROM li)
SELECT l_orderkey, l_linenumber, {r6('label')} AS label, len(f) AS n, {r6('list_sum(f)')} AS f_sum,
       {r6('list_sum(list_transform(f, lambda v: v * v))')} AS f_sq FROM pts"""
    bucket = "CAST(CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 8)) AS BIGINT) % 1000000 AS INTEGER)"
    sq["hash_split"] = f"""SELECT o_orderkey, {bucket} AS bucket,
       CASE WHEN {bucket} < 200000 THEN 'test' ELSE 'train' END AS split FROM orders"""
    sq["split_counts"] = f"""SELECT CASE WHEN {bucket} < 200000 THEN 'test' ELSE 'train' END AS split, count(*) AS n
FROM orders GROUP BY 1"""

    # ---------------- labels, vectors, scalar functions
    sq["label_pm1"] = f"""WITH {CLS}
SELECT l_orderkey, l_linenumber, {r6('label')} AS label, {r6('2.0 * label - 1.0')} AS label_pm1 FROM cls"""
    sq["label_violations"] = f"""WITH {GOOD_TEXT}{PARSED}
SELECT count(*) AS n_rows, count(*) FILTER (WHERE raw_label NOT IN (0.0, 1.0)) AS n_bad FROM parsed"""
    sq["sparse_dot"] = f"""WITH {CLS}
SELECT l_orderkey, l_linenumber, {r6(_dot3(W3))} AS dot FROM cls"""
    sq["dense_dot"] = sq["sparse_dot"]
    sq["sparse_sparse_dot"] = f"""WITH {LI}
SELECT l_orderkey, l_linenumber, {r6('t * exp(b)')} AS dot FROM li"""
    sq["weighted_feature_sum"] = f"""WITH {LI},
long AS (SELECT block_id, b, 0 AS j, a AS v FROM li UNION ALL SELECT block_id, b, 1, c FROM li
         UNION ALL SELECT block_id, b, 2, t FROM li)
SELECT block_id, j, {r3('sum(b * v)')} AS s FROM long WHERE v <> 0.0 GROUP BY block_id, j"""
    three = """SELECT l_orderkey, l_linenumber, 0 AS k, {0} AS v FROM {3} UNION ALL
SELECT l_orderkey, l_linenumber, 1 AS k, {1} AS v FROM {3} UNION ALL
SELECT l_orderkey, l_linenumber, 2 AS k, {2} AS v FROM {3}"""
    sq["sparse_to_dense"] = f"WITH {CLS}\n" + three.format(r6("a"), r6("c"), r6("t"), "cls")
    sq["vector_scale"] = f"WITH {CLS}\n" + three.format(r6("2.5 * a"), r6("2.5 * c"), r6("2.5 * t"), "cls")
    sq["vector_axpy"] = f"WITH {CLS}\n" + three.format(r6("1.0 + 0.5 * a"), r6("1.0 + 0.5 * c"), r6("1.0 + 0.5 * t"), "cls")
    m = _dot3(W_LR)
    sq["sigmoid_scores"] = f"""WITH {CLS}
SELECT l_orderkey, l_linenumber, {r6(_sigmoid(m))} AS score, {r6(_logloss(m))} AS log_loss FROM cls"""
    kap = _d(KAPPA)
    st = lambda v: f"(CASE WHEN {v} > {kap} THEN {v} - {kap} WHEN {v} < -{kap} THEN {v} + {kap} ELSE 0.0::DOUBLE END)"
    sq["soft_threshold"] = f"WITH {CLS}\n" + three.format(r6(st("a")), r6(st("c")), r6(st("t")), "cls")

    # ---------------- blocks, block-local
    sq["block_sizes"] = f"WITH {LI}\nSELECT block_id, count(*) AS n_rows FROM li GROUP BY block_id"
    sq["block_state_join"] = f"""WITH {STATE2}
SELECT li.block_id, count(*) AS n_rows, {r3('sum(a * st.x[1] + c * st.x[2])')} AS sum_margin
FROM li JOIN st USING (block_id) GROUP BY li.block_id"""
    sq["block_gram"] = f"""WITH {_gram_lines()}
SELECT block_id, n, 0 AS r, 0 AS c, {r6('g00 / n')} AS g_mean FROM g UNION ALL
SELECT block_id, n, 0, 1, {r6('g01 / n')} FROM g UNION ALL
SELECT block_id, n, 1, 0, {r6('g01 / n')} FROM g UNION ALL
SELECT block_id, n, 1, 1, {r6('g11 / n')} FROM g"""
    sq["block_xty"] = f"""WITH {_gram_lines()}
SELECT block_id, 0 AS j, {r6('q0 / n')} AS q_mean FROM g UNION ALL SELECT block_id, 1, {r6('q1 / n')} FROM g"""
    sq["ls_x_update"] = _ls_x_update_sql()
    sq["lr_objective"] = f"""WITH {STATE3}{_prox(Z3)},
loss AS (SELECT block_id, sum({_logloss('ypm * m')}) AS loss FROM rows3 GROUP BY block_id)
SELECT block_id, {r3('loss + prox')} AS objective FROM loss JOIN proxv USING (block_id)"""
    grad_rows = """,
gl AS (SELECT block_id, 0 AS j, sum(coef * f[1]) AS g FROM gc GROUP BY block_id UNION ALL
       SELECT block_id, 1, sum(coef * f[2]) FROM gc GROUP BY block_id UNION ALL
       SELECT block_id, 2, sum(coef * f[3]) FROM gc GROUP BY block_id)"""
    sq["lr_gradient"] = f"""WITH {STATE3}{_prox(Z3)},
gc AS (SELECT block_id, f, ypm * ({_sigmoid('ypm * m')} - 1.0) AS coef FROM rows3){grad_rows}
SELECT block_id, j, {r3(f'g + {_d(RHO)} * d')} AS gradient FROM gl JOIN prox USING (block_id, j)"""
    sq["svm_objective"] = f"""WITH {STATE3}{_prox(Z3)},
loss AS (SELECT block_id, sum({_d(CEE)} * greatest(1.0 - ypm * m, 0.0) * greatest(1.0 - ypm * m, 0.0)) AS loss
         FROM rows3 GROUP BY block_id)
SELECT block_id, {r3('loss + prox')} AS objective FROM loss JOIN proxv USING (block_id)"""
    sq["svm_gradient"] = f"""WITH {STATE3}{_prox(Z3)},
gc AS (SELECT block_id, f, CASE WHEN 1.0 - ypm * m > 0 THEN {_d(2 * CEE)} * (m - ypm) ELSE 0.0::DOUBLE END AS coef FROM rows3){grad_rows}
SELECT block_id, j, {r3(f'g + {_d(RHO)} * d')} AS gradient FROM gl JOIN prox USING (block_id, j)"""
    sq["lr_newton_hessian"] = f"""WITH {STATE3},
hw AS (SELECT block_id, f, {_sigmoid('m')} AS mu FROM rows3),
pairs AS (SELECT block_id, r - 1 AS r, c - 1 AS c, mu * (1 - mu) * f[r] * f[c] AS v
          FROM hw, range(1, 4) AS rr(r), range(1, 4) AS cc(c))
SELECT block_id, CAST(r AS INTEGER) AS r, CAST(c AS INTEGER) AS c,
       {r6(f'sum(v) / count(*) + CASE WHEN r = c THEN {_d(RHO)} ELSE 0.0::DOUBLE END')} AS h
FROM pairs GROUP BY block_id, r, c"""

    sq["block_assign_counts"] = "SELECT count(DISTINCT l_orderkey) AS n_rows FROM lineitem"
    sq["split_hot_counts"] = "SELECT count(*)::DECIMAL(38,0)::BIGINT AS n_rows, true AS bounded FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)"

    # ---------------- consensus steps
    sq["z_update_l2"] = f"""WITH {STATE2}
SELECT j, {r6(f'{_d(RHO)} / ({_d(RHO)} * count(*) + {_d(2.0)}) * sum(x + y / {_d(RHO)})')} AS z FROM stl GROUP BY j"""
    k1 = f"({_d(0.1)} / ({_d(RHO)} * count(*)))"
    mean = f"(sum(x + y / {_d(RHO)}) / count(*))"
    sq["z_update_l1"] = f"""WITH {STATE2}
SELECT j, {r6(f'CASE WHEN {mean} > {k1} THEN {mean} - {k1} WHEN {mean} < -{k1} THEN {mean} + {k1} ELSE 0.0::DOUBLE END')} AS z
FROM stl GROUP BY j"""
    sq["dual_update"] = f"""WITH {STATE2}, zt AS {_values_z(Z2)}
SELECT block_id, j, {r6(f'y + {_d(RHO)} * (x - zt.z)')} AS y FROM stl JOIN zt USING (j)"""
    sq["admm_residuals"] = f"""WITH {STATE2}, zt AS {_values_z(Z2)}, zp AS {_values_z(Z2_PREV, 'z_prev')}
SELECT {r6('(SELECT sqrt(sum((x - zt.z) * (x - zt.z))) FROM stl JOIN zt USING (j))')} AS resid_primal,
       {r6(f'{_d(RHO)} * sqrt((SELECT count(DISTINCT block_id) FROM stl)::DOUBLE) * (SELECT sqrt(sum((z - z_prev) * (z - z_prev))) FROM zt JOIN zp USING (j))')} AS resid_dual"""
    sq["admm_tolerances"] = f"""WITH {STATE2}, zt AS {_values_z(Z2)},
s AS (SELECT sum(x * x) AS xx, sum(y * y) AS yy, count(DISTINCT block_id) AS n, count(DISTINCT j) AS p FROM stl),
zz AS (SELECT sum(z * z) AS zz FROM zt)
SELECT {r6(f'{_d(1e-3)} * greatest(sqrt(xx), sqrt(n::DOUBLE) * sqrt(zz)) + {_d(1e-3)} * sqrt((p * n)::DOUBLE)')} AS eps_primal,
       {r6(f'{_d(1e-3)} * sqrt(yy) + {_d(1e-3)} * sqrt((p * n)::DOUBLE)')} AS eps_dual FROM s, zz"""

    for name in ("lr_objective", "lr_gradient", "svm_objective", "svm_gradient"):
        sq[f"{name}_sparse"] = sq[name]
    mu = "(1.0 / (1.0 + exp(-m)))"
    along = f"list_dot_product(f, [{', '.join(_d(v) for v in W3)}])"
    sq["lr_hessian_product"] = f"""WITH {STATE3}
SELECT block_id, CAST(j - 1 AS INTEGER) AS j, {r6(f"avg({mu} * (1.0 - {mu}) * {along} * f[j]) + {_d(RHO)} * any_value([{', '.join(_d(v) for v in W3)}][j])")} AS hd
FROM rows3, range(1, 4) AS r(j) GROUP BY block_id, j"""

    # ---------------- whole trainers
    sq["admm_ridge_trace"] = _trace_sql(1.0, False)
    sq["admm_ridge_weights"] = _weights_sql(1.0, False)
    sq["admm_lasso_trace"] = _trace_sql(0.1, True)
    sq["admm_lasso_weights"] = _weights_sql(0.1, True)
    sq["admm_ridge_adaptive_trace"] = _trace_sql(1.0, False, adaptive=True)
    sq["admm_ridge_path"] = _path_sql()
    sq["admm_ridge_sparse_weights"] = _weights_sql(1.0, False)
    sq["rho_update"] = _rho_update_sql()
    sq["admm_lr_l2"] = _newton_sql("lr", 1.0)
    sq["admm_lr_newton"] = _newton_sql("lr", 0.1, mean=True)
    sq["admm_lr_newton_split"] = sq["admm_lr_newton"]
    sq["admm_ridge_split"] = _ridge_closed_sql(1.0)
    sq["admm_ridge_optimum"] = _ridge_closed_sql(0.3, 4)
    sq["admm_lasso_optimum"] = _lasso_optimum_sql(0.05)
    sq["admm_ridge_path_warm"] = _optimum_path_sql(_ridge_weights)
    sq["admm_lasso_path_warm"] = _optimum_path_sql(_lasso_weights)
    sq["admm_lr_newton_wide"] = _slots_newton_sql(WIDE_LAMBDA)
    sq["admm_lr_docs_newton"] = """SELECT count(*) AS n_rows, sum(quality)::BIGINT AS n_good, true AS stationary
FROM documents JOIN labels USING (doc_id) WHERE len(regexp_extract_all(text, '\\S')) > 0"""
    sq["baseline_svm_sgd"] = _sgd_sql()
    sq["admm_svm"] = _newton_sql("svm", 1.0)
    sq["admm_lr_l1"] = _newton_l1_sql("lr", 1.0)
    sq["admm_svm_adaptive"] = _newton_l1_sql("svm", 1.0)
    sq["baseline_lr"] = _newton_sql("lr", 1.0) + f" UNION ALL SELECT -1, 0.0::DOUBLE"
    sq["admm_lr_wide_dense"] = _wide_newton_mean_sql(1.0)
    sq["baseline_linreg"] = _lasso_intercept_sql(0.1)
    sq["admm_custom_updater"] = f"""WITH {LI}, m AS (SELECT avg(b) AS m FROM li GROUP BY block_id)
SELECT count(*)::INTEGER AS n_blocks, {r6('avg(m)')} AS mean FROM m"""
    sq["lambda_grid"] = f"""WITH n AS (SELECT count(*)::DOUBLE AS n FROM orders),
p AS (SELECT ln({_d(1.0)} * n) AS lmax, ln({_d(0.001)} * n) AS lmin FROM n)
SELECT CAST(i AS INTEGER) AS i, {r6('exp(lmax - i * (lmax - lmin) / 49.0)')} AS lambda FROM p, range(0, 50) AS r(i)"""

    # ---------------- scoring, evaluation
    sq["predict_lr"] = f"""WITH {SCORED}
SELECT l_orderkey, l_linenumber, {r6('label')} AS label, {r6('score')} AS score, {r6('prediction')} AS prediction FROM pred"""
    sq["predict_svm"] = f"""WITH {CLS}, s AS (SELECT l_orderkey, l_linenumber, label, {_dot3(W_LR)} AS score FROM cls)
SELECT l_orderkey, l_linenumber, {r6('label')} AS label, {r6('score')} AS score,
       {r6('CASE WHEN score > 0.0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')} AS prediction FROM s"""
    sq["predict_reg"] = f"""WITH {LI}
SELECT l_orderkey, l_linenumber, {rnd('b', 7)} AS label, {r6('a * 3.0 + c * (-2.0)')} AS prediction FROM li"""
    sq["predict_wide"] = f"""WITH {LI.replace("l_extendedprice,", "l_extendedprice, l_partkey,", 1)},
s AS (SELECT l_orderkey, l_linenumber,
  (1.0 + a) * (((l_partkey * 97) % 500000 * 7919 % 1000) / 500.0 - 1.0)
  + c * ((((l_orderkey * 31 + l_linenumber) % 500000 + 500000) * 7919 % 1000) / 500.0 - 1.0) AS m FROM li),
p AS (SELECT l_orderkey, l_linenumber, {_sigmoid('m')} AS score FROM s)
SELECT l_orderkey, l_linenumber, {r6('score')} AS score, {r6('CASE WHEN score > 0.5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END')} AS prediction FROM p"""
    sq["accuracy"] = f"""WITH {SCORED}
SELECT count(*) AS n, {r6('avg(CASE WHEN prediction = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS accuracy FROM pred"""
    sq["pr_curve"] = f"""WITH {BY_SCORE}
SELECT {r6('score')} AS threshold, {r6('CASE WHEN P = 0 THEN 0.0::DOUBLE ELSE cum_tp / P END')} AS recall,
       {r6('cum_tp / (cum_tp + cum_fp)')} AS precision FROM cum, tot"""
    sq["area_under_pr"] = f"""WITH {BY_SCORE},
seg AS (SELECT cum_tp / P AS rec, (cum_tp - tp) / P AS prev_rec, cum_tp / (cum_tp + cum_fp) AS prec,
               CASE WHEN cum_tp + cum_fp - tp - fp = 0 THEN cum_tp / (cum_tp + cum_fp)
                    ELSE (cum_tp - tp) / (cum_tp + cum_fp - tp - fp) END AS prev_prec FROM cum, tot)
SELECT {r6('sum((rec - prev_rec) * (prec + prev_prec) / 2.0)')} AS area_under_pr FROM seg"""
    sq["regression_metrics"] = f"""WITH {REG_PRED},
m AS (SELECT count(*) AS n, avg(label) AS mean_label FROM rp)
SELECT n, {r6('mean_label')} AS mean_label, {r3('sum((label - mean_label) * (label - mean_label))')} AS sst,
       {r3('sum((label - prediction) * (label - prediction))')} AS sse,
       {r6('sum((label - prediction) * (label - prediction)) / n')} AS mse,
       {r6('1.0 - sum((label - prediction) * (label - prediction)) / sum((label - mean_label) * (label - mean_label))')} AS r2
FROM rp, m GROUP BY n, mean_label"""
    return sq
