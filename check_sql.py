"""SQL that gives the result of each query in ``check_queries``, for DuckDB.

The SQL takes other roads than the engine where it can: tails by numerical integration,
inverses by cofactors, the stepwise loop by a sweep operator in a recursive query.
"""

from __future__ import annotations

from check_queries import COPIED, LASSO_PENALTY, LINE_NUMBERS, MODEL_TERM, NOISE, PAIR_THRESHOLD, PAIRED, SINGLE_THRESHOLD, STAND_IN

POINTS = 2000
LABEL_ONLY = "ph = 'label'"
WIDTH = 64


def sig(x: str, digits: int = 8) -> str:
    return f"(CAST(printf('%.{digits - 1}e', ({x})::DOUBLE) AS DOUBLE) + 0.0)"


def rnd(x: str, digits: int = 7) -> str:
    return f"(round(({x})::DOUBLE, {digits}) + 0.0)"


def simpson(f: str, length: str, i: str) -> str:
    weight = f"(CASE WHEN {i} = 0 OR {i} = {POINTS} THEN 1.0 WHEN {i} % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    return f"(({length}) / (3.0 * {POINTS}) * list_sum(list_transform(range({POINTS + 1}), lambda {i}: {weight} * {f})))"


def t_tail(t: str, df: str, i: str = "qi") -> str:
    """Two-tailed: t = sqrt(df) tan(theta) turns the density into a power of the cosine."""
    theta = f"atan(abs({t}) / sqrt(({df})::DOUBLE))"
    length = f"least(pi() / 2 - {theta}, 14.0 / sqrt(({df})::DOUBLE))"
    f = f"exp((({df}) - 1.0) * ln(greatest(cos({theta} + {length} * {i} / {POINTS}), 1e-300)))"
    const = f"exp(lgamma((({df}) + 1) / 2.0) - lgamma(({df}) / 2.0)) / sqrt(pi())"
    return f"(2.0 * {const} * {simpson(f, length, i)})"


def f_tail(f: str, d1: str, d2: str) -> str:
    """Upper tail for d1 >= 2, from the incomplete beta integral with u = x exp(-s)."""
    x = f"(({d2}) / (({d2}) + ({d1}) * ({f})))"
    a, b = f"(({d2}) / 2.0)", f"(({d1}) / 2.0)"
    length = f"(45.0 / {a})"
    body = f"exp(-{a} * {length} * qi / {POINTS}) * pow(1.0 - {x} * exp(-{length} * qi / {POINTS}), {b} - 1.0)"
    const = f"exp({a} * ln({x}) + lgamma({a} + {b}) - lgamma({a}) - lgamma({b}))"
    return f"({const} * {simpson(body, length, 'qi')})"


# ---- views ---------------------------------------------------------------------------

CALLS = """calls AS (
  SELECT vec_id, label::DOUBLE AS label, (label % 2)::DOUBLE AS odd, u.i::INT - 1 AS pos,
         printf('e%02d', u.i::INT - 1) AS name, u.v::DOUBLE AS value
  FROM (SELECT vec_id, label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) u
)"""

LONG = "SELECT name, 's' || vec_id AS sample, value FROM calls"

PHENO_LONG = """SELECT 'label' AS name, 's' || vec_id AS sample, label::DOUBLE AS value FROM embeddings
UNION ALL SELECT 'odd', 's' || vec_id, (label % 2)::DOUBLE FROM embeddings"""

PED = """ped AS (
  SELECT o_orderkey, 'm0' AS marker, o_orderpriority[1] AS a, o_orderstatus AS b FROM orders
  UNION ALL SELECT o_orderkey, 'm1', CASE WHEN o_custkey % 10 = 0 THEN '0' WHEN o_orderkey % 3 = 0 THEN 'C' ELSE 'A' END,
                   CASE WHEN o_custkey % 10 = 0 THEN '0' WHEN o_custkey % 3 = 0 THEN 'C' ELSE 'A' END FROM orders
  UNION ALL SELECT o_orderkey, 'm2', 'G', 'G' FROM orders
)"""


def allele_ctes(source: str, marker: str, a: str, b: str) -> str:
    return f"""counts AS (
  SELECT marker, allele, count(*) AS n FROM (
    SELECT {marker} AS marker, {a} AS allele FROM {source} UNION ALL SELECT {marker}, {b} FROM {source}
  ) WHERE allele <> '0' GROUP BY ALL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY marker ORDER BY n DESC, allele) AS r FROM counts
), top AS (
  SELECT marker, max(allele) FILTER (r = 1) AS major, coalesce(max(allele) FILTER (r = 2), '') AS minor
  FROM ranked GROUP BY marker
)"""


LI_ALLELES = allele_ctes("lineitem", "l_linenumber", "l_returnflag", "l_linestatus")


def code(a: str, b: str) -> str:
    ok = f"{a} IN (major, minor) AND {b} IN (major, minor)"
    return f"CASE WHEN {ok} THEN CASE WHEN {a} <> {b} THEN 1.0::DOUBLE WHEN {a} = major THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END END"


TALL = "d AS (SELECT 'price' AS ph, l_quantity AS x1, l_discount AS x2, l_tax AS x3, l_extendedprice AS y FROM lineitem)"
REPORT = """d AS (
  SELECT 'label' AS ph, embedding[1]::DOUBLE AS x1, embedding[2]::DOUBLE AS x2, embedding[3]::DOUBLE AS x3, label::DOUBLE AS y FROM embeddings
  UNION ALL SELECT 'odd', embedding[1]::DOUBLE, embedding[2]::DOUBLE, embedding[3]::DOUBLE, (label % 2)::DOUBLE FROM embeddings
)"""

# Three predictors: centred sums, inverse by cofactors, all statistics.
OLS3 = """m AS (SELECT ph, count(*) AS n, avg(x1) AS m1, avg(x2) AS m2, avg(x3) AS m3, avg(y) AS my FROM d GROUP BY ph),
s AS (
  SELECT ph, any_value(n) AS n, any_value(m1) AS m1, any_value(m2) AS m2, any_value(m3) AS m3, any_value(my) AS my,
    sum((x1-m1)*(x1-m1)) AS s11, sum((x1-m1)*(x2-m2)) AS s12, sum((x1-m1)*(x3-m3)) AS s13,
    sum((x2-m2)*(x2-m2)) AS s22, sum((x2-m2)*(x3-m3)) AS s23, sum((x3-m3)*(x3-m3)) AS s33,
    sum((x1-m1)*(y-my)) AS c1, sum((x2-m2)*(y-my)) AS c2, sum((x3-m3)*(y-my)) AS c3, sum((y-my)*(y-my)) AS syy
  FROM d JOIN m USING (ph) GROUP BY ph
), det AS (
  SELECT *, s11*(s22*s33-s23*s23) - s12*(s12*s33-s23*s13) + s13*(s12*s23-s22*s13) AS det FROM s
), inv AS (
  SELECT *, (s22*s33-s23*s23)/det AS i11, (s13*s23-s12*s33)/det AS i12, (s12*s23-s13*s22)/det AS i13,
    (s11*s33-s13*s13)/det AS i22, (s12*s13-s11*s23)/det AS i23, (s11*s22-s12*s12)/det AS i33 FROM det
), beta AS (
  SELECT *, i11*c1+i12*c2+i13*c3 AS b1, i12*c1+i22*c2+i23*c3 AS b2, i13*c1+i23*c2+i33*c3 AS b3 FROM inv
), ss AS (
  SELECT *, my - b1*m1 - b2*m2 - b3*m3 AS b0, b1*c1+b2*c2+b3*c3 AS ssm, syy - (b1*c1+b2*c2+b3*c3) AS rss, n - 4 AS dfe FROM beta
), fit AS (
  SELECT *, rss/dfe AS mse, ssm/3 AS msm,
    ssm - (c2*c2*s33 - 2*c2*c3*s23 + c3*c3*s22)/(s22*s33-s23*s23) AS t1,
    ssm - (c1*c1*s33 - 2*c1*c3*s13 + c3*c3*s11)/(s11*s33-s13*s13) AS t2,
    ssm - (c1*c1*s22 - 2*c1*c2*s12 + c2*c2*s11)/(s11*s22-s12*s12) AS t3 FROM ss
), terms AS (
  SELECT ph, 0 AS row, 1 AS x, b1 AS est, sqrt(mse*i11) AS se, dfe FROM fit
  UNION ALL SELECT ph, 1, 2, b2, sqrt(mse*i22), dfe FROM fit
  UNION ALL SELECT ph, 2, 3, b3, sqrt(mse*i33), dfe FROM fit
  UNION ALL SELECT ph, 3, 0, b0, sqrt(mse*(1.0/n + m1*m1*i11 + m2*m2*i22 + m3*m3*i33 + 2*m1*m2*i12 + 2*m1*m3*i13 + 2*m2*m3*i23)), dfe FROM fit
), anova AS (
  SELECT ph, 0 AS row, 1 AS x, 1 AS df, t1 AS ss, t1 AS ms, t1/mse AS f, sqrt(t1/mse) AS t, dfe FROM fit
  UNION ALL SELECT ph, 1, 2, 1, t2, t2, t2/mse, sqrt(t2/mse), dfe FROM fit
  UNION ALL SELECT ph, 2, 3, 1, t3, t3, t3/mse, sqrt(t3/mse), dfe FROM fit
  UNION ALL SELECT ph, 3, -1, dfe, rss, mse, NULL, NULL, dfe FROM fit
  UNION ALL SELECT ph, 4, -2, n - 1, rss + ssm, (rss + ssm)/3, msm/mse, NULL, dfe FROM fit
)"""

ANOVA_P = f"CASE WHEN x > 0 THEN {t_tail('t', 'dfe')} WHEN x = -2 THEN {f_tail('f', '3.0', 'dfe')} END"


def names3(a: str, b: str, c: str, intercept: str = "(Intercept)") -> str:
    return (
        f"CASE x WHEN 1 THEN '{a}' WHEN 2 THEN '{b}' WHEN 3 THEN '{c}' WHEN 0 THEN '{intercept}' "
        "WHEN -1 THEN 'Error' WHEN -2 THEN 'Total' END"
    )


TALL_NAME = names3("quantity", "discount", "tax")
E_NAME = names3("e00", "e01", "e02")

# Columns of the wide matrix as centred lists, singles first, then pairs in order.
WIDE_LISTS = """base AS (
  SELECT i::INT - 1 AS pos, list(v::DOUBLE ORDER BY vec_id) AS v FROM (
    SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i
), resp AS (
  SELECT 'label' AS ph, list(label::DOUBLE ORDER BY vec_id) AS y FROM embeddings
  UNION ALL SELECT 'odd', list((label % 2)::DOUBLE ORDER BY vec_id) FROM embeddings
), cols AS (
  SELECT pos AS a, -1 AS b, v FROM base
  UNION ALL SELECT x.pos, z.pos, list_transform(list_zip(x.v, z.v), lambda q: q[1] * q[2]) FROM base x JOIN base z ON x.pos < z.pos
), raw AS (
  SELECT row_number() OVER (ORDER BY b >= 0, a, b) AS k, a, b, list_dot_product(v, v) AS zz, list_avg(v) AS mean,
    list_transform(v, lambda q: q - list_avg(v)) AS v FROM cols
), num AS (SELECT * FROM raw WHERE {keep}),
respc AS (SELECT ph, list_avg(y) AS my, list_transform(y, lambda q: q - list_avg(y)) AS y FROM resp)"""

FORWARD = f"""WITH {WIDE_LISTS.format(keep='true')}, held AS (SELECT v AS x FROM num WHERE a = 3 AND b < 0),
sums AS (
  SELECT ph, a, b, zz AS zz_raw, len(v) AS n, list_dot_product(v, v) AS zz, list_dot_product(v, x) AS zx,
    list_dot_product(x, x) AS xx, list_dot_product(v, y) AS zy, list_dot_product(x, y) AS xy, list_dot_product(y, y) AS yy
  FROM num, held, respc WHERE NOT (a = 3 AND b < 0)
), part AS (
  SELECT *, zz - zx*zx/xx AS s, zy - zx*xy/xx AS c, yy - xy*xy/xx AS rss, n - 3 AS df FROM sums
), scored AS (
  SELECT ph, a, b, df, c / sqrt(s * (rss - c*c/s) / df) AS t FROM part WHERE s > 1e-8 * zz
)"""
SCORED = f"""SELECT ph AS response, printf('e%02d', a) AS a, CASE WHEN b >= 0 THEN printf('e%02d', b) END AS b,
  {rnd('t')} AS t, {rnd(t_tail('t', 'df'), 6)} AS p FROM """

TERM_NAME = "(SELECT printf('e%02d', a) || CASE WHEN b >= 0 THEN printf('_e%02d', b) ELSE '' END FROM num WHERE k = {k})"


ALL_USABLE = "usable AS (SELECT ph, (SELECT list(true ORDER BY k) FROM num) AS ok FROM resp)"


def stepwise(keep: str, responses: str, threshold: float, usable: str = ALL_USABLE) -> str:
    """CTEs of the whole loop. The state is the matrix swept on the model's terms: diagonal and
    last column then hold inverse, coefficients and residual square sum. One sweep per step."""
    return f"""{WIDE_LISTS.format(keep=keep)}, {usable}, size AS (SELECT count(*) + 1 AS t FROM num),
vars AS (
  SELECT ph, k, v FROM num, respc WHERE {responses}
  UNION ALL SELECT ph, (SELECT t FROM size), y FROM respc WHERE {responses}
), gram AS (
  SELECT l.ph, list(list_dot_product(l.v, r.v) ORDER BY l.k, r.k) AS m FROM vars l JOIN vars r ON l.ph = r.ph GROUP BY l.ph
), start AS (
  SELECT gram.ph, m, (SELECT t FROM size)::BIGINT AS t, (SELECT count(*) FROM embeddings)::BIGINT AS n,
    (SELECT list(zz ORDER BY k) FROM num) AS zz, ok FROM gram JOIN usable ON usable.ph = gram.ph
), steps AS (
  SELECT ph, m, t, n, zz, ok, 0::BIGINT AS iter, []::BIGINT[] AS added, []::BIGINT[] AS skipped, []::BIGINT[] AS pending, false AS done,
    []::STRUCT(iteration BIGINT, event VARCHAR, k BIGINT, t DOUBLE, p DOUBLE)[] AS events FROM start
  UNION ALL
  SELECT ph, m2, t, n, zz, ok, CASE WHEN leaving THEN iter ELSE iter + 1 END, added2, 
    CASE WHEN leaving THEN skipped WHEN enters THEN weak ELSE skipped END,
    CASE WHEN leaving THEN pending[2:] WHEN enters THEN weak ELSE []::BIGINT[] END,
    NOT leaving AND NOT enters,
    CASE WHEN leaving OR best IS NULL THEN []
      WHEN NOT enters THEN [{{'iteration': iter + 1, 'event': 'stop', 'k': best, 't': bt, 'p': bp}}]
      ELSE list_concat([{{'iteration': iter + 1, 'event': 'enter', 'k': best, 't': bt, 'p': bp}}],
        list_transform(weak, lambda k: {{'iteration': iter + 1, 'event': 'leave', 'k': k,
          't': m2[(k-1)*t+t] / sqrt(m2[(k-1)*t+k] * m2[t*t] / (n - len(added2) - 1)),
          'p': {t_tail('(m2[(k-1)*t+t] / sqrt(m2[(k-1)*t+k] * m2[t*t] / (n - len(added2) - 1)))', '(n - len(added2) - 1)')}}})) END
  FROM (
    SELECT *, CASE WHEN enters THEN list_filter(added2, lambda k:
        {t_tail('(m2[(k-1)*t+t] / sqrt(m2[(k-1)*t+k] * m2[t*t] / (n - len(added2) - 1)))', '(n - len(added2) - 1)')} >= {threshold})
      ELSE []::BIGINT[] END AS weak
    FROM (
      SELECT *, CASE WHEN leaving THEN list_filter(added, lambda k: k <> pv) WHEN enters THEN list_append(added, pv) ELSE added END AS added2,
        CASE WHEN pv IS NULL THEN m ELSE list_transform(range(t*t), lambda q: CASE
          WHEN q // t + 1 = pv AND q % t + 1 = pv THEN 1.0 / m[q+1]
          WHEN q % t + 1 = pv THEN -m[q+1] / m[(pv-1)*t+pv]
          WHEN q // t + 1 = pv THEN m[q+1] / m[(pv-1)*t+pv]
          ELSE m[q+1] - m[(q // t)*t+pv] * m[(pv-1)*t + q % t + 1] / m[(pv-1)*t+pv] END) END AS m2
      FROM (
        SELECT *, CASE WHEN leaving THEN pending[1] WHEN enters THEN best END AS pv FROM (
          SELECT *, NOT leaving AND best IS NOT NULL AND bp < {threshold} AS enters FROM (
            SELECT *, {t_tail('bt', '(n - len(added) - 2)')} AS bp FROM (
              SELECT *, ts[best] AS bt FROM (
                SELECT *, list_position(ranks, list_max(ranks)) AS best FROM (
                  SELECT *, list_transform(ts, lambda z: CAST(printf('%.9e', abs(z)) AS DOUBLE)) AS ranks FROM (
                    SELECT *, len(pending) > 0 AS leaving,
                      list_transform(range(1, t), lambda j: CASE WHEN ok[j] AND NOT list_contains(added, j) AND NOT list_contains(skipped, j)
                          AND m[(j-1)*t+j] > 1e-8 * zz[j]
                        THEN m[(j-1)*t+t] / sqrt(m[(j-1)*t+j] * (m[t*t] - m[(j-1)*t+t] * m[(j-1)*t+t] / m[(j-1)*t+j]) / (n - len(added) - 2)) END) AS ts
                    FROM steps WHERE NOT done
                  ))))))))
  )
)"""


TRACE = f"""SELECT ph AS phenotype, e.iteration::INT AS iteration, e.event AS event,
  {TERM_NAME.format(k='e.k')} AS term, {rnd('e.t')} AS t, {rnd('e.p')} AS p
FROM (SELECT ph, unnest(events) AS e FROM steps)"""

STEP_TERMS = f"""SELECT ph AS phenotype, row::INT AS row, term, {sig('est', 7)} AS estimate, {sig('se', 7)} AS std_error,
  {sig('est / se', 7)} AS t, {rnd(t_tail('(est / se)', 'df'))} AS p
FROM (
  SELECT ph, i - 1 AS row, {TERM_NAME.format(k='z.k')} AS term, m[(k-1)*t+t] AS est, sqrt(m[(k-1)*t+k] * m[t*t] / (n - len(added) - 1)) AS se,
    n - len(added) - 1 AS df
  FROM (SELECT *, unnest(added) AS k, generate_subscripts(added, 1) AS i FROM steps WHERE done) z
  UNION ALL
  SELECT ph, len(added), '(Intercept)', my - coalesce(list_sum(list_transform(added, lambda k: m[(k-1)*t+t] * means[k])), 0),
    sqrt(m[t*t] / (n - len(added) - 1) * (1.0 / n + coalesce(list_sum(list_transform(added, lambda k:
      list_sum(list_transform(added, lambda l: means[k] * means[l] * m[(k-1)*t+l])))), 0))), n - len(added) - 1
  FROM steps JOIN respc USING (ph), (SELECT list(mean ORDER BY k) AS means FROM num) WHERE done AND len(added) > 0
)"""

# Full-batch gradient descent with soft threshold on X'X / n and X'y / n.
SGD_STEPS = f"""ux AS (SELECT pos + 1 AS k, v FROM base),
xx AS (SELECT list(r ORDER BY k) AS g FROM (
  SELECT a.k, list(list_dot_product(a.v, b.v) / len(a.v) ORDER BY b.k) AS r FROM ux a, ux b GROUP BY a.k)),
target AS (SELECT ph, list(list_dot_product(v, y) / len(v) ORDER BY k) AS xy FROM ux, resp GROUP BY ph),
descent AS (
  SELECT ph, xy, g, 0 AS step, list_transform(xy, lambda q: 0.0::DOUBLE) AS w, false AS done FROM target, xx
  UNION ALL
  SELECT ph, xy, g, step + 1, w2, step + 1 >= 100 OR (step >= 1 AND sqrt(list_sum(list_transform(list_zip(w2, w), lambda q: pow(q[1] - q[2], 2))))
    < 0.001 * greatest(sqrt(list_dot_product(w2, w2)), 1.0))
  FROM (
    SELECT *, list_transform(moved, lambda q: CASE WHEN q < 0 THEN -1.0 ELSE 1.0 END * greatest(abs(q) - {LASSO_PENALTY} / sqrt(step + 1), 0.0)) AS w2 FROM (
      SELECT *, list_transform(range(1, len(w) + 1), lambda j: w[j] - (list_dot_product(g[j], w) - xy[j]) / sqrt(step + 1)) AS moved
      FROM descent WHERE NOT done))
), weights AS MATERIALIZED (
  SELECT ph AS phenotype, u.i::INT - 1 AS pos, printf('e%02d', u.i::INT - 1) AS name, u.weight FROM (
    SELECT ph, unnest(w) AS weight, generate_subscripts(w, 1) AS i FROM descent WHERE done) u
)"""

SGD = f"{WIDE_LISTS.format(keep='b < 0')}, {SGD_STEPS}"

LASSO_USABLE = f"""{SGD_STEPS}, usable AS MATERIALIZED (
  SELECT r.ph, list(list_contains(kept.at, num.a) AND (num.b < 0 OR list_contains(kept.at, num.b)) ORDER BY num.k) AS ok
  FROM resp r JOIN (SELECT phenotype AS ph, list(pos) AS at FROM weights WHERE weight <> 0 GROUP BY phenotype) kept ON kept.ph = r.ph, num
  GROUP BY r.ph
)"""

# Exact LASSO: proximal gradient steps on the centred normal equations, run to convergence.
EXACT = f"""{WIDE_LISTS.format(keep='b < 0')},
g AS (SELECT list(r ORDER BY k) AS g FROM (
  SELECT a.k, list(list_dot_product(a.v, b.v) / len(a.v) ORDER BY b.k) AS r FROM num a, num b GROUP BY a.k)),
target AS (SELECT ph, list(list_dot_product(v, y) / len(v) ORDER BY k) AS xy FROM num, respc GROUP BY ph),
descent AS (
  SELECT ph, xy, g, list_max(list_transform(g, lambda r: list_sum(list_transform(r, lambda q: abs(q))))) AS l, 0 AS step,
    list_transform(xy, lambda q: 0.0::DOUBLE) AS w FROM target, g
  UNION ALL
  SELECT ph, xy, g, l, step + 1,
    list_transform(moved, lambda q: CASE WHEN q < 0 THEN -1.0 ELSE 1.0 END * greatest(abs(q) - {LASSO_PENALTY} / l, 0.0))
  FROM (SELECT *, list_transform(range(1, len(w) + 1), lambda j: w[j] - (list_dot_product(g[j], w) - xy[j]) / l) AS moved
    FROM descent WHERE step < 1500)
)
SELECT ph AS phenotype, printf('e%02d', u.i::INT - 1) AS name, {rnd('u.weight', 4)} AS weight FROM (
  SELECT ph, unnest(w) AS weight, generate_subscripts(w, 1) AS i FROM descent WHERE step = 1500) u"""

PART_FEATURES = """f AS (
  SELECT 'p' || p_partkey AS name, p_partkey::INT AS pos, p_size::DOUBLE AS v0, (p_retailprice > 1000)::INT::DOUBLE AS v1 FROM part
), g AS (SELECT *, first_value(name) OVER (PARTITION BY v0, v1 ORDER BY pos) AS kept FROM f)"""

TERMS = """terms AS (
  SELECT s_name AS a, s_suppkey::INT AS pos_a, NULL::VARCHAR AS b, NULL::INT AS pos_b, s_name AS label FROM supplier
  UNION ALL SELECT x.s_name, x.s_suppkey::INT, y.s_name, y.s_suppkey::INT, x.s_name || '_' || y.s_name
  FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey
)"""

LOW_MEAN = "low AS (SELECT name FROM calls GROUP BY name HAVING avg(value) < 0)"


def _gram_sql() -> str:
    cols = {
        "quantity": "l_quantity", "discount": "l_discount", "tax": "l_tax", "price": "l_extendedprice",
        "quantity_discount": "l_quantity*l_discount", "quantity_tax": "l_quantity*l_tax", "discount_tax": "l_discount*l_tax",
    }
    names = list(cols)
    base = ", ".join(f"{v} AS {k}" for k, v in cols.items())
    means = ", ".join(f"avg({k}) AS m_{k}" for k in names)
    rows = "\nUNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, {sig(f'sum(({a}-m_{a})*({b}-m_{b}))', 6)} AS cross_product FROM d, m"
        for i, a in enumerate(names) for b in names[i:]
    )
    return f"WITH d AS (SELECT {base} FROM lineitem), m AS (SELECT {means} FROM d) {rows}"


def _text(pattern: str, x: str) -> str:
    return f"printf('{pattern}', ({x})::DOUBLE)"


def _summary_sql() -> str:
    cells = (
        f"SELECT ph, row + 2 AS line_no, {E_NAME} AS c0, {_text('%.6f', 'est')} AS c1, {_text('%.6f', 'se')} AS c2, "
        f"{_text('%.3f', 'est/se')} AS c3, {_text('%.6f', t_tail('(est/se)', 'dfe'))} AS c4 FROM terms"
    )
    padded = "rpad(c0, w0::INT, ' ')" + "".join(f" || lpad(c{i}, w{i}::INT + 3, ' ')" for i in range(1, 5))
    widths = ", ".join(f"max(len(c{i})) AS w{i}" for i in range(5))
    return f"""WITH {REPORT}, {OLS3}, cells AS (
  {cells}
  UNION ALL SELECT ph, 1, 'Name', 'Estimate', 'Std. Error', 't value', 'Pr(>|t|)' FROM m
), w AS (SELECT ph, {widths} FROM cells GROUP BY ph)
SELECT ph AS phenotype, line_no::INT AS line_no, {padded} AS line FROM cells JOIN w USING (ph)
UNION ALL SELECT ph, 0, 'The Response variable: ' || ph FROM m"""


def _report_sql() -> str:
    p = f"CASE WHEN x <> -1 THEN printf('%.5f', {ANOVA_P}) || chr(9) ELSE '-' END"
    f = "CASE WHEN f IS NOT NULL THEN printf('%.5f', f) || chr(9) ELSE '-' || chr(9) END"
    return f"""WITH {REPORT}, {OLS3}
SELECT ph AS phenotype, {E_NAME} || chr(9) || df || chr(9) || printf('%.4f', ss) || chr(9) || printf('%.4f', ms) || chr(9) || {f} || {p} AS line FROM anova
UNION ALL SELECT ph, 'ANOVA table:' FROM m
UNION ALL SELECT ph, '-' || chr(9) || 'df' || chr(9) || 'SS' || chr(9) || 'MS' || chr(9) || 'F' FROM m"""


# OLS on the kept variables: sweep them all in, then read terms and ANOVA rows off the matrix.
LASSO_ANOVA = f"""{SGD}, kept AS (
  SELECT phenotype AS ph, row_number() OVER (PARTITION BY phenotype ORDER BY pos) AS k, name, v FROM weights JOIN base USING (pos) WHERE weight <> 0
), sz AS (SELECT ph, count(*) AS t0 FROM kept GROUP BY ph),
vars AS (
  SELECT ph, k, list_transform(v, lambda q: q - list_avg(v)) AS v FROM kept
  UNION ALL SELECT ph, t0 + 1, y FROM respc JOIN sz USING (ph)
), sweeps AS (
  SELECT l.ph, 0 AS step, t0 + 1 AS t, any_value(len(l.v)) AS n, list(list_dot_product(l.v, r.v) ORDER BY l.k, r.k) AS m
  FROM vars l JOIN vars r USING (ph) JOIN sz USING (ph) GROUP BY l.ph, t0
  UNION ALL
  SELECT ph, step + 1, t, n, list_transform(range(t*t), lambda q: CASE
    WHEN q // t + 1 = step + 1 AND q % t + 1 = step + 1 THEN 1.0 / m[q+1]
    WHEN q % t + 1 = step + 1 THEN -m[q+1] / m[step*t+step+1]
    WHEN q // t + 1 = step + 1 THEN m[q+1] / m[step*t+step+1]
    ELSE m[q+1] - m[(q // t)*t+step+1] * m[step*t + q % t + 1] / m[step*t+step+1] END)
  FROM sweeps WHERE step < t - 1
), fin AS (
  SELECT ph, t - 1 AS k, n, n - t AS dfe, m, t, m[t*t] AS rss, (SELECT list_dot_product(y, y) FROM respc WHERE respc.ph = sweeps.ph) AS sst
  FROM sweeps WHERE step = t - 1
), rows_ AS (
  SELECT f.ph, name AS source, 1::BIGINT AS df, pow(m[(kept.k-1)*t+t], 2) / m[(kept.k-1)*t+kept.k] AS ss,
    pow(m[(kept.k-1)*t+t], 2) / m[(kept.k-1)*t+kept.k] AS ms, pow(m[(kept.k-1)*t+t], 2) / m[(kept.k-1)*t+kept.k] / (rss/dfe) AS f,
    sqrt(pow(m[(kept.k-1)*t+t], 2) / m[(kept.k-1)*t+kept.k] / (rss/dfe)) AS tt, dfe, f.k AS d1 FROM fin f JOIN kept USING (ph)
  UNION ALL SELECT ph, 'Error', dfe, rss, rss/dfe, NULL, NULL, dfe, k FROM fin
  UNION ALL SELECT ph, 'Total', n - 1, sst, sst/k, (sst-rss)/k/(rss/dfe), NULL, dfe, k FROM fin
)
SELECT ph AS phenotype, source, df, {sig('ss', 7)} AS ss, {sig('ms', 7)} AS ms, {sig('f', 7)} AS f,
  {rnd(f"CASE WHEN source = 'Error' THEN NULL WHEN tt IS NOT NULL OR d1 = 1 THEN {t_tail('coalesce(tt, sqrt(f))', 'dfe')} ELSE {f_tail('f', 'd1', 'dfe')} END")} AS p
FROM rows_"""

MARGINAL = f"""WITH {CALLS}, c AS (
  SELECT name, count(*) AS n, regr_slope(label, value) AS slope, regr_intercept(label, value) AS intercept,
    regr_sxx(label, value) AS sxx, regr_syy(label, value) AS syy, sum(value*value) AS zz FROM calls GROUP BY name
), e AS (SELECT *, syy - slope*slope*sxx AS rss, n - 2 AS df FROM c WHERE sxx > 1e-20 * zz),
t AS (SELECT *, slope / sqrt(rss / df / sxx) AS t FROM e)
SELECT name, n, {rnd('slope')} AS slope, {rnd('intercept')} AS intercept, {rnd('t')} AS t,
  {rnd(t_tail('t', 'df'))} AS p, {sig('rss')} AS rss FROM t"""

# Six terms on lineitem, on a Gram matrix made by sums.
TALL_COLS = ["l_quantity", "l_discount", "l_tax", "l_quantity*l_discount", "l_quantity*l_tax", "l_discount*l_tax", "l_extendedprice"]
TALL_NAMES = ["quantity", "discount", "tax", "quantity_discount", "quantity_tax", "discount_tax"]


def _stepwise_tall_sql() -> str:
    """No term passes the gate on this data unless one does: compare the first scan, then stop."""
    means = ", ".join(f"avg({c}) AS m{i}" for i, c in enumerate(TALL_COLS))
    parts = "\nUNION ALL ".join(
        f"SELECT {i} AS k, '{n}' AS term, count(*) AS n, sum(pow({c}-m{i}, 2)) AS s, sum(({c}-m{i})*(l_extendedprice-m6)) AS c, "
        f"sum(pow(l_extendedprice-m6, 2)) AS yy FROM lineitem, m"
        for i, (c, n) in enumerate(zip(TALL_COLS, TALL_NAMES))
    )
    return f"""WITH m AS (SELECT {means} FROM lineitem), z AS ({parts}),
t AS (SELECT *, c / sqrt(s * (yy - c*c/s) / (n - 2)) AS t, n - 2 AS df FROM z),
best AS (SELECT * FROM t ORDER BY abs(t) DESC, k LIMIT 1)
SELECT 'price' AS phenotype, 1 AS iteration, 'stop' AS event, term, {sig('t')} AS t, {rnd(t_tail('t', 'df'))} AS p FROM best"""


def stepwise_on(made: str, keep: str, responses: str, threshold: float = 0.05) -> str:
    """The loop on another wide matrix (vec_id, label, embedding)."""
    return f"made AS ({made}), " + stepwise(keep, responses, threshold).replace("FROM embeddings", "FROM made")


def _removal_sql(name: str) -> str:
    def e(i: int) -> str:
        return f"embedding[{i + 1}]::DOUBLE"

    stand_in = f"{e(5)} + {e(10)} + {e(STAND_IN)}"
    y = f"{e(5)} + {e(10)} + 0.012::DOUBLE * {e(STAND_IN)} + 0.25::DOUBLE * {e(15)} + 0.1::DOUBLE * {e(NOISE)}"
    made = {STAND_IN: stand_in, NOISE: e(COPIED)}
    columns = ", ".join(made.get(i, e(i)) for i in range(WIDTH))
    trace = TRACE.replace("ph AS phenotype", f"'{name}' AS phenotype")
    return f"WITH RECURSIVE {stepwise_on(f'SELECT vec_id, {y} AS label, [{columns}] AS embedding FROM embeddings', 'b < 0', LABEL_ONLY)} {trace}"


# Next to e03: columns that e03 and the intercept span share their direction by the least-norm solution.
SCAN_PINV = f"""WITH made AS (
  SELECT vec_id, label, list_concat(embedding::DOUBLE[], [2.5::DOUBLE, embedding[{MODEL_TERM[0] + 1}]::DOUBLE]) AS embedding FROM embeddings
), {WIDE_LISTS.format(keep='b < 0').replace('FROM embeddings', 'FROM made')}, held AS (SELECT v AS x, mean AS mx FROM num WHERE a = {MODEL_TERM[0]}),
sums AS (
  SELECT ph, a, zz AS raw, mean, mx, my, len(v) AS n, list_dot_product(v, v) AS zz, list_dot_product(v, x) AS zx,
    list_dot_product(x, x) AS xx, list_dot_product(v, y) AS zy, list_dot_product(x, y) AS xy, list_dot_product(y, y) AS yy
  FROM num, held, respc WHERE a <> {MODEL_TERM[0]}
), part AS (
  SELECT *, zz - zx*zx/xx AS s, zy - zx*xy/xx AS c, yy - xy*xy/xx AS rss, n - 3 AS df, zx/xx AS w, mean - zx/xx*mx AS b, xy/xx AS b1, my - xy/xx*mx AS b0 FROM sums
), scored AS (
  SELECT *, CASE WHEN s > 1e-8 * zz AND zz > 1e-13 * raw THEN c / sqrt(s * (rss - c*c/s) / df)
    ELSE (w*b1 + b*b0) / sqrt(rss / df * (w*w/xx - 2*w*b*mx/xx + b*b*(1.0/n + mx*mx/xx))) END AS t FROM part
)
SELECT ph AS response, printf('e%02d', a) AS a, {rnd('t')} AS t, {rnd(t_tail('t', 'df'), 6)} AS p FROM scored"""

# Quantity as it is: what is added to it may change nothing.
SHIFTED = f"""WITH d AS (
  SELECT l_quantity::DOUBLE AS q, l_discount::DOUBLE AS dc, l_tax::DOUBLE AS x, (l_extendedprice + 1000 * l_quantity)::DOUBLE AS y FROM lineitem
), m AS (SELECT count(*) AS n, avg(q) AS mq, avg(dc) AS md, avg(x) AS mx, avg(y) AS my FROM d
), s AS (
  SELECT any_value(n) AS n, sum((q-mq)*(q-mq)) AS qq, sum((q-mq)*(y-my)) AS qy, sum((y-my)*(y-my)) AS yy, sum((dc-md)*(dc-md)) AS dd,
    sum((dc-md)*(q-mq)) AS dq, sum((dc-md)*(y-my)) AS dy, sum((x-mx)*(x-mx)) AS xx, sum((x-mx)*(q-mq)) AS xq, sum((x-mx)*(y-my)) AS xy FROM d, m
), a AS (
  SELECT 1 AS iteration, 'enter' AS event, 'quantity' AS term, qy / sqrt(qq * (yy - qy*qy/qq) / (n - 2)) AS t, n - 2 AS df FROM s
), z AS (
  SELECT 'discount' AS term, n, dd - dq*dq/qq AS s, dy - dq*qy/qq AS c, yy - qy*qy/qq AS rss FROM s
  UNION ALL SELECT 'tax', n, xx - xq*xq/qq, xy - xq*qy/qq, yy - qy*qy/qq FROM s
), b AS (SELECT 2 AS iteration, 'stop' AS event, term, c / sqrt(s * (rss - c*c/s) / (n - 3)) AS t, n - 3 AS df FROM z ORDER BY abs(t) DESC LIMIT 1
), r AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT 'price' AS phenotype, iteration, event, term, {sig('t', 6)} AS t, {rnd(t_tail('t', 'df'))} AS p FROM r"""

# A copy takes half of the estimate, the constant 2 shares with the intercept as 2 to 1; two more degrees of freedom are gone.
OLS_PINV = f"""WITH {TALL}, {OLS3}, more AS (
  SELECT {TALL_NAME} AS term, est, se * sqrt(dfe / (dfe - 2.0)) AS se, dfe - 2 AS df FROM terms
), shared AS (
  SELECT term, est * CASE term WHEN 'quantity' THEN 0.5 WHEN '(Intercept)' THEN 0.2 ELSE 1 END AS est,
    se * CASE term WHEN 'quantity' THEN 0.5 WHEN '(Intercept)' THEN 0.2 ELSE 1 END AS se, df FROM more
  UNION ALL SELECT 'quantity_again', est * 0.5, se * 0.5, df FROM more WHERE term = 'quantity'
  UNION ALL SELECT 'two', est * 0.4, se * 0.4, df FROM more WHERE term = '(Intercept)'
)
SELECT term, {sig('est', 7)} AS estimate, {sig('se', 7)} AS std_error, {sig('est / se', 7)} AS t, {rnd(t_tail('(est / se)', 'df'))} AS p FROM shared"""

# OLS on all variables: the same sweeps.
WIDE_ANOVA = f"""WITH RECURSIVE {WIDE_LISTS.format(keep='b < 0')}, kept AS (
  SELECT ph, row_number() OVER (PARTITION BY ph ORDER BY pos) AS k, printf('e%02d', pos) AS name, v FROM base, respc
), {LASSO_ANOVA[LASSO_ANOVA.index("sz AS (SELECT ph"):LASSO_ANOVA.rindex(chr(10) + "SELECT ph AS phenotype")]}"""
_WIDE_P = f"CASE WHEN tt IS NOT NULL THEN {t_tail('tt', 'dfe')} ELSE {f_tail('f', 'd1', 'dfe')} END"
WIDE_REPORT = f"""{WIDE_ANOVA}
SELECT ph AS phenotype, source || chr(9) || df || chr(9) || printf('%.4f', ss) || chr(9) || printf('%.4f', ms) || chr(9) ||
  CASE WHEN f IS NOT NULL THEN printf('%.5f', f) || chr(9) ELSE '-' || chr(9) END ||
  CASE WHEN source <> 'Error' THEN printf('%.5f', {_WIDE_P}) || chr(9) ELSE '-' END AS line FROM rows_
UNION ALL SELECT ph, 'ANOVA table:' FROM respc
UNION ALL SELECT ph, '-' || chr(9) || 'df' || chr(9) || 'SS' || chr(9) || 'MS' || chr(9) || 'F' FROM respc"""

DEFAULT_PAIRS = stepwise_on(f"SELECT vec_id, label, embedding[1:{PAIRED}] AS embedding FROM embeddings", "true", "true")

ORACLES = {
    "scan_epiq": f"WITH {CALLS} {LONG}",
    "scan_pheno": PHENO_LONG,
    "scan_delimited": f"WITH {CALLS} {LONG}",
    "scan_pedmap": f"WITH {PED}, {allele_ctes('ped', 'marker', 'a', 'b')} SELECT marker AS name, 'f' || o_orderkey AS sample, "
    f"{code('a', 'b')} AS value FROM ped JOIN top USING (marker)",
    "write_epiq": """SELECT 'HeaderLine' || chr(9) || string_agg('s' || vec_id, chr(9) ORDER BY vec_id) AS line FROM embeddings
UNION ALL SELECT 'label' || chr(9) || string_agg(label::DOUBLE::VARCHAR, chr(9) ORDER BY vec_id) FROM embeddings
UNION ALL SELECT 'odd' || chr(9) || string_agg((label % 2)::DOUBLE::VARCHAR, chr(9) ORDER BY vec_id) FROM embeddings""",
    "model_report": _report_sql(),
    "model_report_wide": WIDE_REPORT,
    "column_catalogue_all": "\nUNION ALL ".join(
        f"SELECT '{c}' AS name, {i} AS pos, l_orderkey AS sample, {c}::DOUBLE AS value FROM lineitem" for i, c in enumerate(LINE_NUMBERS)
    ),
    "ols_summary_text": _summary_sql(),
    "lasso_model_json": f"WITH RECURSIVE {SGD} SELECT phenotype, 0.0::DOUBLE AS intercept, name, {rnd('weight')} AS weight FROM weights",
    "delete_columns": "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_shipdate FROM lineitem",
    "select_column": "SELECT l_extendedprice FROM lineitem",
    "column_catalogue": """SELECT 'p_size' AS name, 0 AS pos, p_partkey AS sample, p_size::DOUBLE AS value FROM part
UNION ALL SELECT 'p_retailprice', 1, p_partkey, p_retailprice FROM part""",
    "transpose_matrix": "SELECT vec_id, " + ", ".join(f"embedding[{i + 1}]::DOUBLE AS e{i:02d}" for i in range(WIDTH)) + " FROM embeddings",
    "exclude_variants": f"WITH {CALLS}, {LOW_MEAN} SELECT name, vec_id::INT AS sample_idx, value FROM calls ANTI JOIN low USING (name)",
    "keep_variants": f"WITH {CALLS}, {LOW_MEAN} SELECT name, vec_id::INT AS sample_idx, value FROM calls SEMI JOIN low USING (name)",
    "encode_genotypes": f"WITH {LI_ALLELES} SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, "
    f"{code('l_returnflag', 'l_linestatus')} AS genotype FROM lineitem JOIN top ON marker = l_linenumber",
    "allele_counts": f"WITH {LI_ALLELES} SELECT marker, allele, n FROM counts",
    "major_minor": f"WITH {LI_ALLELES} SELECT marker, major, minor FROM top",
    "sample_mismatch": """WITH r AS (SELECT DISTINCT o_custkey AS sample, o_custkey - CASE WHEN o_custkey % 7 = 0 THEN 1 ELSE 0 END AS right_idx FROM orders)
SELECT coalesce(c_custkey, sample) AS sample, c_custkey AS left_idx, right_idx FROM customer FULL JOIN r ON c_custkey = sample
WHERE c_custkey IS DISTINCT FROM right_idx""",
    "align_samples": "SELECT c_custkey, c_acctbal, 1000000000 - c_custkey AS idx FROM customer",
    "join_tables": """SELECT c_custkey AS sample, c_acctbal, count(*) AS n_orders, max(o_totalprice) AS top_price
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY ALL""",
    "dedup_features": f"WITH {PART_FEATURES} SELECT name, pos, v0, v1 FROM g WHERE name = kept",
    "duplicate_groups": f"WITH {PART_FEATURES} SELECT kept, name AS duplicate FROM g WHERE name <> kept",
    "pairwise_terms": """SELECT x.s_name AS name_a, x.s_suppkey::INT AS pos_a, y.s_name AS name_b, y.s_suppkey::INT AS pos_b
FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey""",
    "all_terms": f"WITH {TERMS} SELECT * FROM terms",
    "candidate_terms": f"""WITH {TERMS} SELECT a, b, label FROM terms
WHERE NOT (b IS NULL AND pos_a % 5 = 0) AND (b IS NULL OR pos_b <> pos_a + 1)""",
    "pair_product": f"""WITH {CALLS} SELECT x.name AS a, y.name AS b, count(*)::INT AS n, {sig('sum(x.value * y.value)')} AS total,
  {sig('sum(x.value * y.value * x.value * y.value)')} AS sum_squares, max(x.value * y.value) AS top
FROM calls x JOIN calls y ON x.vec_id = y.vec_id AND x.pos < y.pos GROUP BY ALL""",
    "feature_moments": f"WITH {CALLS} SELECT name, count(*) AS n, {sig('sum(value)')} AS total, {sig('avg(value)')} AS mean, "
    f"{sig('sum(value*value)')} AS sum_squares FROM calls GROUP BY name",
    "gram_matrix": _gram_sql(),
    "ols_coefficients": f"WITH {TALL}, {OLS3} SELECT {TALL_NAME} AS term, {sig('est')} AS estimate FROM terms",
    "ols_terms": f"WITH {TALL}, {OLS3} SELECT {TALL_NAME} AS term, {sig('est')} AS estimate, {sig('se')} AS std_error, "
    f"{sig('est/se')} AS t, {rnd(t_tail('(est/se)', 'dfe'))} AS p FROM terms",
    "ols_terms_pinv": OLS_PINV,
    "scan_pinv": SCAN_PINV,
    "stepwise_removal": _removal_sql("y"),
    "stepwise_removal_tall": _removal_sql("y"),
    "stepwise_default_pairs": f"WITH RECURSIVE {DEFAULT_PAIRS} {TRACE}",
    "stepwise_shifted": SHIFTED,
    "ols_fit_stats": f"""WITH {TALL}, {OLS3} SELECT n, 3::BIGINT AS df_model, dfe AS df_error, {sig('ssm')} AS ss_model, {sig('rss')} AS rss,
  {sig('rss+ssm')} AS sst, {sig('msm')} AS ms_model, {sig('mse')} AS ms_error, {sig('sqrt(mse)')} AS rse, {sig('ssm/(rss+ssm)')} AS r2,
  {sig('1 - mse/((rss+ssm)/(n-1))')} AS adj_r2, {sig('msm/mse')} AS f, {rnd(f_tail('(msm/mse)', '3.0', 'dfe'))} AS p FROM fit""",
    "ols_information": f"""WITH {TALL}, {OLS3}, l AS (SELECT *, -n/2.0*(ln(2*pi()) + 1 + ln(rss/n)) AS ll FROM fit)
SELECT {sig('ll')} AS log_likelihood, {sig('-2*ll + 10')} AS aic, {sig('-2*ll + ln(n)*5')} AS bic FROM l""",
    "ols_fitted": f"""WITH {TALL}, {OLS3} SELECT l_orderkey, l_linenumber, round(b0 + b1*l_quantity + b2*l_discount + b3*l_tax, 1) AS fitted,
  {rnd('l_extendedprice - (b0 + b1*l_quantity + b2*l_discount + b3*l_tax)', 1)} AS residual FROM lineitem, fit""",
    "anova_type3": f"WITH {TALL}, {OLS3} SELECT {TALL_NAME} AS source, df::BIGINT AS df, {sig('ss')} AS ss, {sig('ms')} AS ms, "
    f"{sig('f')} AS f, {rnd(ANOVA_P)} AS p FROM anova",
    "marginal_scan": MARGINAL,
    "forward_scan": f"{FORWARD} {SCORED} scored",
    "best_candidate": f"""{FORWARD} {SCORED} (SELECT *, row_number() OVER (
  PARTITION BY ph ORDER BY CAST(printf('%.9e', abs(t)) AS DOUBLE) DESC, b >= 0, a, b) AS r FROM scored) WHERE r = 1""",
    "stepwise_terms": f"WITH RECURSIVE {stepwise('true', 'true', PAIR_THRESHOLD)} {STEP_TERMS}",
    "stepwise_trace": f"WITH RECURSIVE {stepwise('true', 'true', PAIR_THRESHOLD)} {TRACE}",
    "stepwise_multi": f"WITH RECURSIVE {stepwise('true', 'true', PAIR_THRESHOLD)} {TRACE}",
    "stepwise_additive": f"WITH RECURSIVE {stepwise('b < 0', 'true', SINGLE_THRESHOLD)} {TRACE}",
    "stepwise_tall": _stepwise_tall_sql(),
    "lasso_weights_sgd": f"WITH RECURSIVE {SGD} SELECT phenotype, name, {rnd('weight')} AS weight FROM weights",
    "lasso_keep": f"WITH RECURSIVE {SGD} SELECT phenotype, name FROM weights WHERE weight <> 0",
    "lasso_remove": f"WITH RECURSIVE {SGD} SELECT phenotype, name FROM weights WHERE weight = 0",
    "lasso_weights": f"WITH RECURSIVE {EXACT}",
    "lasso_then_stepwise": f"WITH RECURSIVE {stepwise('true', 'true', PAIR_THRESHOLD, LASSO_USABLE)} {TRACE}",
    "lasso_anova": f"WITH RECURSIVE {LASSO_ANOVA}",
}
