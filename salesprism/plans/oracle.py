"""The same questions as plain SQL over the input tables.

Each text runs on another engine against the same Parquet files and is
written from the definitions, not from the Spark plans.
"""

from __future__ import annotations

from salesprism.functions import fixed_values as fixed
from salesprism.plans.dirty import DIRTY

TRANSACTIONS = """
SELECT
  l.l_orderkey                                        AS transaction_id,
  o.o_custkey                                         AS customer_id,
  l.l_partkey                                         AS product_id,
  p.p_name                                            AS product_name,
  p.p_brand                                           AS brand,
  p.p_type                                            AS category,
  o.o_orderdate                                       AS order_date,
  year(o.o_orderdate)                                 AS order_year,
  month(o.o_orderdate)                                AS order_month,
  l.l_quantity                                        AS quantity,
  l.l_extendedprice / l.l_quantity                    AS original_price_inr,
  l.l_extendedprice / l.l_quantity * (1 - l.l_discount) AS discounted_price_inr,
  l.l_discount * 100                                  AS discount_percent,
  l.l_extendedprice                                   AS subtotal_inr,
  l.l_extendedprice * (1 - l.l_discount)              AS final_amount_inr,
  o.o_orderpriority                                   AS payment_method,
  c.c_mktsegment                                      AS customer_tier,
  CAST(floor(c.c_acctbal / 2500) AS INT)              AS customer_age_group,
  c.c_acctbal >= 5000                                 AS is_prime_member,
  n.n_name                                            AS customer_state,
  concat(n.n_name, '-C', CAST(c.c_custkey % 5 AS STRING)) AS customer_city,
  concat(n.n_name, '-C', CAST(c.c_custkey % 5 AS STRING)) AS city,
  r.r_name                                            AS zone,
  s.s_name                                            AS delivery_partner,
  (l.l_linenumber + l.l_suppkey) % 11                 AS delivery_days,
  p.p_size                                            AS stock,
  CASE WHEN l.l_returnflag = 'R' THEN 'Returned' ELSE 'Delivered' END AS return_status,
  l.l_linestatus                                      AS return_reason,
  CASE month(o.o_orderdate) WHEN 10 THEN 'Diwali' WHEN 3 THEN 'Holi' WHEN 12 THEN 'Christmas' WHEN 1 THEN 'New Year' END AS festival_name,
  month(o.o_orderdate) IN (1, 3, 10, 12)              AS is_festival_sale
FROM lineitem l
JOIN orders   o ON l.l_orderkey  = o.o_orderkey
JOIN customer c ON o.o_custkey   = c.c_custkey
JOIN nation   n ON c.c_nationkey = n.n_nationkey
JOIN region   r ON n.n_regionkey = r.r_regionkey
JOIN part     p ON l.l_partkey   = p.p_partkey
JOIN supplier s ON l.l_suppkey   = s.s_suppkey
"""

AMT = "final_amount_inr"
REV = f"round(coalesce(sum({AMT}), 0), 4) AS revenue"
LINE = "transaction_id, customer_id, product_id, CAST(order_date AS DATE) AS order_date, round(final_amount_inr, 4) AS final_amount_inr"
PANEL = ("order_year IN (1999, 2000, 2001) AND category IN ('ECONOMY', 'LARGE', 'PROMO') "
         "AND payment_method IN ('1-URGENT', '2-HIGH')")


def q(body: str, *ctes: str) -> str:
    """A query over ``t``, with more named steps."""
    return "WITH " + ", ".join([f"t AS ({TRANSACTIONS})", *ctes]) + " " + body


DIRTY_CTE = "d AS (SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in DIRTY.items()) + " FROM t)"


def dirty(body: str, *ctes: str) -> str:
    return q(body, DIRTY_CTE, *ctes)


def by(keys: str, extra: str = "", where: str = "TRUE") -> str:
    return q(f"SELECT {keys}, {REV}{extra} FROM t WHERE {where} GROUP BY {keys}")


def top(keys: str, k: int, metric: str = f"sum({AMT})", name: str = "revenue", order: str = "DESC",
        where: str = "TRUE", extra: str = "") -> str:
    return q(f"SELECT {keys}, round({metric}, 4) AS {name}{extra} FROM t WHERE {where} "
             f"GROUP BY {keys} ORDER BY {metric} {order}, {keys} LIMIT {k}")


# Cleaning rules

def any_of(words, text: str) -> str:
    return f"{text} IN (" + ", ".join(f"'{w}'" for w in words) + ")"


def spaces(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def number(text: str) -> str:
    return (f"CASE WHEN regexp_full_match(trim({text}), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') "
            f"THEN TRY_CAST(trim({text}) AS DOUBLE) END")


def price(c: str) -> str:
    bare = f"trim(regexp_replace({c}, '[₹$,]', '', 'g'))"
    words = "(?i)(price.*request|na|n/?a|none|null)"
    return f"CASE WHEN {bare} = '' OR regexp_matches({bare}, '{words}') THEN NULL ELSE {number(bare)} END"


def bucket(c: str) -> str:
    text = f"replace(replace(replace(lower({spaces(c)}), '&', ' '), '/', ' '), '-', ' ')"
    whens = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{label}'" for p, label in fixed.CATEGORY_KEYWORDS)
    return f"CASE {whens} END"


def category(*columns: str) -> str:
    return "coalesce(" + ", ".join(bucket(c) for c in columns) + ", 'Other')"


def city(c: str) -> str:
    def words(text: str, sep: str, inner) -> str:
        return f"array_to_string(list_transform(string_split({text}, '{sep}'), lambda w{ord(sep)}: {inner(f'w{ord(sep)}')}), '{sep}')"

    def cap(w: str) -> str:
        return f"concat(upper(left({w}, 1)), lower(substr({w}, 2)))"

    title = words(spaces(c), " ", lambda w: words(w, "-", cap))
    fixes = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.CITY_FIXES.items())
    return f"CASE WHEN {c} IS NULL OR {spaces(c)} = '' THEN 'Unknown' ELSE CASE {title} {fixes} ELSE {title} END END"


def payment(c: str, pairs=fixed.PAYMENT_PATTERNS) -> str:
    text = f"upper({spaces(c)})"
    whens = " ".join(f"WHEN regexp_matches({text}, '{p}') THEN '{label}'" for p, label in pairs)
    return f"CASE {whens} ELSE 'Other' END"


def yes(c: str) -> str:
    return f"coalesce({any_of(fixed.YES_WORDS, f'lower(trim({c}))')}, FALSE)"


def flag(c: str) -> str:
    text = f"lower(trim({c}))"
    return (f"CASE WHEN {any_of(fixed.FLAG_ONE_WORDS, text)} THEN 1 WHEN {any_of(fixed.FLAG_ZERO_WORDS, text)} THEN 0 "
            f"ELSE coalesce(CAST(trunc({number(text)}) AS INT), 0) END")


def rating(c: str) -> str:
    text = f"lower(trim({c}))"
    for noise in ("stars", "star", "/5.0", "/5", "out of 5"):
        text = f"replace({text}, '{noise}', '')"
    text = f"trim({text})"
    pattern = "^(\\d+(\\.\\d+)?) */ *(\\d+(\\.\\d+)?)"
    a, b = (f"TRY_CAST(regexp_extract({text}, '{pattern}', {i}) AS DOUBLE)" for i in (1, 3))
    return (f"CASE WHEN {number(text)} <= 0 THEN NULL WHEN {number(text)} IS NOT NULL THEN least({number(text)}, 5.0) "
            f"WHEN {b} > 0 THEN round_even(least({a} / {b} * 5.0, 5.0), 2) END")


def date(c: str) -> str:
    formats = ("%d/%m/%Y", "%d-%m-%Y", "%Y-%m-%d", "%Y-%m-%d %H:%M:%S", "%m/%d/%Y")
    long = "coalesce(" + ", ".join(f"try_strptime({c}, '{f}')" for f in formats) + ")"
    return f"CASE WHEN regexp_full_match({c}, '\\d\\d?-\\d\\d?-\\d\\d') THEN try_strptime({c}, '%d-%m-%y') ELSE {long} END"


def delivery(c: str) -> str:
    text = f"lower(trim({c}))"
    a, b = (f"TRY_CAST(regexp_extract({text}, '^(\\d+)\\s*-\\s*(\\d+)', {i}) AS DOUBLE)" for i in (1, 2))
    lead = f"TRY_CAST(regexp_extract({text}, '^(\\d+)', 1) AS DOUBLE)"
    return (f"CASE WHEN {any_of(fixed.SAME_DAY_WORDS, text)} THEN 0.0 WHEN {b} IS NOT NULL THEN ({a} + {b}) / 2 "
            f"WHEN {lead} <= 30 THEN {lead} END")


def segment(c: str) -> str:
    whens = " ".join(f"WHEN {c} <= {bound} THEN '{label}'" for bound, label in fixed.VALUE_SEGMENTS)
    return f"CASE WHEN {c} IS NULL THEN 'Unknown' {whens} ELSE 'Luxury' END"


def returned(c: str, report: str) -> str:
    if report == "insights":
        return f"coalesce({c} = 'Returned', FALSE)"
    text = f"lower(trim({c}))" if report == "returns" else f"lower({c})"
    return f"coalesce({any_of(fixed.RETURN_WORDS[report], text)}, FALSE)"


PRICE_ORDER = ("final_amount_inr", "discounted_price_inr", "subtotal_inr", "original_price_inr")
CLEAN_AMOUNT = "coalesce(" + ", ".join(price(c) for c in PRICE_ORDER) + ", 0.0)"


def cleaned(raw: str, rule: str) -> str:
    return dirty(f"SELECT {raw} AS raw, {rule} AS cleaned, count(*) AS rows FROM d GROUP BY ALL")


CLEAN_CTE = (
    f"c0 AS (SELECT *, {date('order_date')} AS parsed, {CLEAN_AMOUNT} AS amount FROM d), "
    f"c1 AS (SELECT transaction_id, customer_id, product_id, parsed, amount, {category('category', 'subcategory', 'product_name')} AS category, "
    f"{city('city')} AS city, {payment('payment_method')} AS payment_method, CAST(year(parsed) AS INT) AS order_year, "
    f"{segment('amount')} AS order_value_segment, {yes('is_prime_member')} AS is_prime, "
    f"{rating('customer_rating')} AS rating, {delivery('delivery_days')} AS days "
    "FROM c0 WHERE parsed IS NOT NULL)"
)

# Customers

LATEST = "(SELECT max(order_date) FROM t)"
PROFILE = (
    "p AS (SELECT customer_id, max(order_date) AS last_order, count(transaction_id) AS orders, "
    f"count(DISTINCT transaction_id) AS distinct_orders, sum({AMT}) AS monetary FROM t GROUP BY customer_id)"
)


def days(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch({later}) - epoch({earlier})) / 86400) AS INT)"


def rank_bin(value: str, reverse: bool = False) -> str:
    rn, n = f"row_number() OVER (ORDER BY {value}, customer_id)", "count(*) OVER ()"
    score = f"CAST(greatest(1, (5 * ({rn} - 1) + {n} - 2) // ({n} - 1)) AS INT)"
    return f"6 - {score}" if reverse else score


def value_bin(value: str, table: str, reverse: bool = False) -> str:
    over = " + ".join(f"CAST({value} > (SELECT quantile_cont({value}, {p}) FROM {table}) AS INT)" for p in (0.2, 0.4, 0.6, 0.8))
    return f"6 - (1 + {over})" if reverse else f"1 + {over}"


RFM_SEGMENT = ("CASE WHEN r_score >= 4 AND f_score >= 4 THEN 'Champion' WHEN r_score >= 4 AND f_score <= 2 THEN 'New Customer' "
               "WHEN r_score <= 2 AND f_score >= 4 THEN 'At Risk' WHEN r_score <= 2 AND f_score <= 2 THEN 'Lost' ELSE 'Loyal' END")
RFM_V1 = (
    PROFILE,
    f"b AS (SELECT customer_id, {days(f'({LATEST} + INTERVAL 1 DAY)', 'last_order')} AS recency, orders AS frequency, monetary FROM p)",
    f"s AS (SELECT *, {value_bin('recency', 'b', True)} AS r_score, {rank_bin('frequency')} AS f_score, {value_bin('monetary', 'b')} AS m_score FROM b)",
    f"v AS (SELECT customer_id, recency, frequency, monetary, r_score, f_score, m_score, "
    f"concat(r_score, f_score, m_score) AS rfm_score, {RFM_SEGMENT} AS segment FROM s)",
)
RFM_V2 = (
    PROFILE,
    f"b AS (SELECT customer_id, {days(LATEST, 'last_order')} AS recency, distinct_orders AS frequency, monetary FROM p)",
    f"s AS (SELECT *, {rank_bin('recency', True)} AS r_score, {rank_bin('frequency')} AS f_score, {rank_bin('monetary')} AS m_score FROM b)",
    "v AS (SELECT *, r_score + f_score + m_score AS rfm_score FROM s)",
)


def scaled(c: str, table: str) -> str:
    low, high = f"(SELECT min({c}) FROM {table})", f"(SELECT max({c}) FROM {table})"
    return f"CASE WHEN {high} = {low} THEN 0.5 ELSE CAST({c} - {low} AS DOUBLE) / ({high} - {low}) END"


CHURN = (
    PROFILE,
    f"b AS (SELECT customer_id, last_order AS last_purchase, distinct_orders AS frequency, monetary, {days(LATEST, 'last_order')} AS recency_days FROM p)",
    f"ch AS (SELECT *, CAST(recency_days >= 182 AS INT) AS is_churned, CASE WHEN recency_days >= 182 THEN 'Churned' ELSE 'Active' END AS status, "
    f"round_even((0.5 * {scaled('recency_days', 'b')} + 0.25 * (1 - {scaled('frequency', 'b')}) + 0.25 * (1 - {scaled('monetary', 'b')})) * 100, 1) AS churn_risk_score FROM b)",
)
CHURN_COLUMNS = ("customer_id, status, recency_days, frequency, round(monetary, 4) AS monetary, churn_risk_score, "
                 "CAST(last_purchase AS DATE) AS last_purchase")
HEAT = (
    *CHURN,
    f"hb AS (SELECT *, {rank_bin('recency_days')} AS r_bin, {rank_bin('frequency')} AS f_bin FROM ch)",
    "g AS (SELECT r.i AS r_bin, f.i AS f_bin FROM range(1, 6) r(i), range(1, 6) f(i))",
    "h AS (SELECT list_extract(['Best','Good','Mid','Low','Worst'], CAST(g.r_bin AS INT)) AS r_bucket, list_extract(['Worst','Low','Mid','Good','Best'], CAST(g.f_bin AS INT)) AS f_bucket, "
    "avg(churn_risk_score) AS avg_risk, count(customer_id) AS customers FROM g LEFT JOIN hb ON hb.r_bin = g.r_bin AND hb.f_bin = g.f_bin GROUP BY g.r_bin, g.f_bin)",
)
LAST_CATEGORY = (
    "lc AS (SELECT customer_id, category AS last_category FROM (SELECT *, row_number() OVER (PARTITION BY customer_id "
    "ORDER BY order_date DESC, transaction_id DESC, product_id DESC, category DESC) AS r FROM t) WHERE r = 1)"
)


def describe_part(c: str) -> str:
    return (f"SELECT '{c}' AS metric, count({c}) AS count, round(avg({c}), 4) AS mean, CAST(round(min({c}), 4) AS DOUBLE) AS min, "
            f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, "
            f"CAST(round(max({c}), 4) AS DOUBLE) AS max, round(stddev_samp({c}), 4) AS std FROM cs")


CUSTOMER_SUMMARY = (PROFILE, f"cs AS (SELECT customer_id, last_order AS last_order_date, orders, monetary AS lifetime_value, {days(LATEST, 'last_order')} AS recency_days FROM p)")

# Prices

PRICED = (
    "pr AS (SELECT *, discounted_price_inr AS price FROM t WHERE discounted_price_inr > 0 AND quantity >= 0)",
    "bd AS (SELECT *, CAST(least(20, greatest(1, ceil((price - (SELECT min(price) FROM pr)) / (((SELECT max(price) FROM pr) - (SELECT min(price) FROM pr)) / 20)))) AS INT) AS price_bin FROM pr)",
    f"pb AS (SELECT product_name, price_bin, avg(price) AS avg_price, sum(quantity) AS total_qty, sum({AMT}) AS revenue FROM bd GROUP BY ALL)",
    "vp AS (SELECT product_name, count(DISTINCT avg_price) FILTER (avg_price > 0 AND total_qty > 0) AS usable, "
    "regr_slope(ln(total_qty), ln(avg_price)) FILTER (avg_price > 0 AND total_qty > 0) AS slope FROM pb GROUP BY 1 "
    "HAVING count(DISTINCT avg_price) >= 5 AND sum(total_qty) > 0)",
    "el AS (SELECT product_name, round_even(slope, 3) AS elasticity, CASE WHEN round_even(slope, 3) <= -1 THEN 'Elastic (|E| ≥ 1)' "
    "WHEN round_even(slope, 3) < 0 THEN 'Inelastic (0 > E > -1)' ELSE 'Positive/Zero (Atypical)' END AS label FROM vp WHERE usable >= 5 AND slope IS NOT NULL)",
    f"rc AS (SELECT price_bin, avg(price) AS avg_price, sum({AMT}) AS revenue FROM bd GROUP BY 1)",
)
ELIGIBLE = "SELECT product_name, count(DISTINCT price) AS prices, round(sum(quantity), 4) AS sold FROM pr GROUP BY 1 HAVING count(DISTINCT price) >= 5 AND sum(quantity) > 0"

# Returns and profit

LOSS = f"CASE WHEN return_status = 'Returned' THEN {AMT} ELSE 0.0 END"
PROFIT = (
    f"pf AS (SELECT *, {AMT} * 0.70 AS cost, {LOSS} AS return_loss, "
    f"{AMT} - {AMT} * 0.70 - (original_price_inr - discounted_price_inr) * quantity - {LOSS} AS profit FROM t)"
)
SLABS = list(zip(fixed.DISCOUNT_EDGES, fixed.DISCOUNT_EDGES[1:]))


def loss_by(key: str, k: int) -> str:
    return top(key, k, f"sum({LOSS})", "return_loss")


# Series

MONTH = "CAST(date_trunc('month', order_date) AS DATE)"
SERIES = f"m AS (SELECT {MONTH} AS month, sum({AMT}) AS value, count(transaction_id) AS orders FROM t GROUP BY 1)"


def forecast_ctes(key: str) -> tuple[str, ...]:
    """Trend plus calendar-month residual for each ``key`` of series ``m(key, month, value)``."""
    return (
        f"f1 AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY month) - 1 AS i, count(*) OVER (PARTITION BY {key}) AS n FROM m)",
        f"f2 AS (SELECT {key}, max(n) AS n, max(month) AS last_month, regr_slope(value, i) AS slope, regr_intercept(value, i) AS icept, avg(value) FILTER (i >= n - 3) AS flat FROM f1 GROUP BY 1)",
        f"f3 AS (SELECT f1.{key}, month(month) AS moy, avg(value - (icept + slope * i)) AS seas FROM f1 JOIN f2 ON f1.{key} = f2.{key} GROUP BY 1, 2)",
        f"fc AS (SELECT f2.{key}, CAST(last_month + to_months(CAST(h.s AS INT)) AS DATE) AS month, CASE WHEN n < 15 THEN flat ELSE icept + slope * (n - 1 + h.s) + coalesce(seas, 0) END AS forecast "
        f"FROM f2 CROSS JOIN range(1, 13) h(s) LEFT JOIN f3 ON f3.{key} = f2.{key} AND f3.moy = month(last_month + to_months(CAST(h.s AS INT))))",
    )


ALL_SERIES = f"m AS (SELECT 'all' AS k, {MONTH} AS month, sum({AMT}) AS value FROM t GROUP BY 1, 2)"
BRAND_SERIES = f"m AS (SELECT brand AS k, {MONTH} AS month, sum({AMT}) AS value FROM t GROUP BY 1, 2)"


def seasonal_ctes(source: str) -> tuple[str, ...]:
    """Seasonal autoregression by recursion over lists."""
    return (
        "RECURSIVE_MARK AS (SELECT 1)", source,
        "sp AS (SELECT k, unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS mo FROM m GROUP BY k)",
        "y AS (SELECT sp.k, CAST(sp.mo AS DATE) AS month, coalesce(m.value, 0.0) AS v FROM sp LEFT JOIN m ON m.k = sp.k AND m.month = CAST(sp.mo AS DATE))",
        "w AS (SELECT *, v - lag(v, 1) OVER o - lag(v, 12) OVER o + lag(v, 13) OVER o AS w FROM y WINDOW o AS (PARTITION BY k ORDER BY month))",
        "x AS (SELECT *, lag(w, 1) OVER o AS x1, lag(w, 12) OVER o AS x2 FROM w WINDOW o AS (PARTITION BY k ORDER BY month))",
        "mo AS (SELECT k, sum(x1 * x1) AS s11, sum(x1 * x2) AS s12, sum(x2 * x2) AS s22, sum(x1 * w) AS s1w, sum(x2 * w) AS s2w FROM x WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY k)",
        "co AS (SELECT k, (s1w * s22 - s2w * s12) / (s11 * s22 - s12 * s12) AS a, (s2w * s11 - s1w * s12) / (s11 * s22 - s12 * s12) AS b FROM mo)",
        "st AS (SELECT y2.k, list(y2.v ORDER BY y2.month) AS ys, list(coalesce(y2.w, 0.0) ORDER BY y2.month) AS ws, max(y2.month) AS last_month FROM w y2 GROUP BY y2.k)",
        "roll AS (SELECT 0 AS i, k, ys, ws, last_month FROM st UNION ALL SELECT i + 1, r.k, "
        "list_append(ys, a * ws[-1] + b * ws[-12] + ys[-1] + ys[-12] - ys[-13]), list_append(ws, a * ws[-1] + b * ws[-12]), last_month FROM roll r JOIN co ON co.k = r.k WHERE i < 12)",
    )


def normal_ctes(name: str, table: str, target: str, regressors: list[str]) -> list[str]:
    """Least squares by elimination, one step a named table; the coefficients are ``c`` of ``name``."""
    n, columns = len(regressors), [*regressors, target]
    ready = " AND ".join(f"{c} IS NOT NULL" for c in columns)
    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    sums = ", ".join(f"coalesce(sum({columns[i]} * {columns[j]}) FILTER ({ready}), 0.0) AS m{i}_{j}" for i, j in cells)
    out = [f"{name}_s AS (SELECT k, {sums} FROM {table} GROUP BY k)",
           f"{name}_0 AS (SELECT *, " + ", ".join(f"abs(m{i}_{i}) AS z{i}" for i in range(n)) + f" FROM {name}_s)"]
    scales = ", ".join(f"z{i}" for i in range(n))
    for p in range(n):
        pivot = f"(CASE WHEN abs(m{p}_{p}) > 1e-9 * z{p} THEN m{p}_{p} END)"
        now = ", ".join(f"m{p}_{j} / {pivot} AS m{i}_{j}" if i == p else f"m{i}_{j} - m{p}_{j} / {pivot} * m{i}_{p} AS m{i}_{j}" for i, j in cells)
        out.append(f"{name}_{p + 1} AS (SELECT k, {scales}, {now} FROM {name}_{p})")
    found = ", ".join(f"coalesce(m{i}_{n}, 0.0)" for i in range(n))
    return [*out, f"{name} AS (SELECT k, [{found}] AS c FROM {name}_{n})"]


def arma_ctes(source: str) -> tuple[str, ...]:
    """Long autoregression, shocks, second regression, and the roll forward."""
    long, short = (1, 2, 3, 12, 13, 14), (1, 12)
    over = " FROM {0} WINDOW o AS (PARTITION BY k ORDER BY month)"
    named = [f"a{n}" for n in long]
    terms = " + ".join(f"c[{i + 1}] * {c}" for i, c in enumerate(named))
    steps = [f"coalesce({v}[-{n}], 0.0)" for v in ("ws", "es") for n in short]
    ahead = " + ".join(f"c[{i + 1}] * {x}" for i, x in enumerate(steps))
    return (
        *seasonal_ctes(source)[:5],
        "x AS (SELECT *, " + ", ".join(f"lag(w, {n}) OVER o AS a{n}" for n in long) + over.format("w") + ")",
        *normal_ctes("lr", "x", "w", named),
        f"sh AS (SELECT x.k, month, v, w, w - (0.0 + {terms}) AS e FROM x JOIN lr ON lr.k = x.k)",
        "x2 AS (SELECT *, " + ", ".join(f"lag({v}, {n}) OVER o AS {v}{n}" for v in "we" for n in short) + over.format("sh") + ")",
        *normal_ctes("ar", "x2", "w", ["w1", "w12", "e1", "e12"]),
        "st AS (SELECT sh.k, list(v ORDER BY month) AS ys, list(coalesce(w, 0.0) ORDER BY month) AS ws, list(coalesce(e, 0.0) ORDER BY month) AS es, "
        "max(month) AS last_month, any_value(c) AS c FROM sh JOIN ar ON ar.k = sh.k GROUP BY sh.k)",
        "roll AS (SELECT 0 AS i, * FROM st UNION ALL SELECT i + 1, k, "
        f"list_append(ys, CASE WHEN len(ys) - i > 12 THEN (0.0 + {ahead}) + ys[-1] + ys[-12] - ys[-13] ELSE ys[-1] END), list_append(ws, 0.0 + {ahead}), "
        "list_append(es, 0.0), last_month, c FROM roll WHERE i < 12)",
    )


def recursive(sql: str) -> str:
    return sql.replace("WITH t AS", "WITH RECURSIVE t AS", 1).replace("RECURSIVE_MARK AS (SELECT 1), ", "", 1)


# Baskets

def pairs(item: str) -> str:
    return q("SELECT a.i AS item_a, b.i AS item_b, count(*) AS baskets, round(count(*) / (SELECT count(DISTINCT transaction_id) FROM bi), 4) AS support "
             "FROM bi a JOIN bi b ON a.transaction_id = b.transaction_id AND a.i < b.i GROUP BY 1, 2 "
             "HAVING count(*) >= 0.01 * (SELECT count(DISTINCT transaction_id) FROM bi)",
             f"bi AS (SELECT DISTINCT transaction_id, {item} AS i FROM t)")


def sets_to_three(item: str) -> str:
    """Frequent sets of one to three items; complete when no set of three is frequent."""
    n = "(SELECT count(DISTINCT transaction_id) FROM bi)"
    joins = ["bi a", "bi b ON a.transaction_id = b.transaction_id AND a.i < b.i",
             "bi c ON b.transaction_id = c.transaction_id AND b.i < c.i"]
    parts = []
    for size in (1, 2, 3):
        names = "concat_ws('|', " + ", ".join(f"{x}.i" for x in "abc"[:size]) + ")"
        parts.append(f"SELECT {names} AS items, count(*) AS freq, round(count(*) / {n}, 4) AS support "
                     f"FROM {' JOIN '.join(joins[:size])} GROUP BY 1 HAVING count(*) >= 0.01 * {n}")
    return q(" UNION ALL ".join(parts), f"bi AS (SELECT DISTINCT transaction_id, {item} AS i FROM t)")


SETS = (
    "cats AS (SELECT category, row_number() OVER (ORDER BY category) - 1 AS bit FROM (SELECT DISTINCT category FROM t))",
    "bm AS (SELECT transaction_id, bit_or(CAST(1 << bit AS INT)) AS mask FROM t JOIN cats USING (category) GROUP BY 1)",
    "pm AS (SELECT mask, count(*) AS c FROM bm GROUP BY 1)",
    "ss AS (SELECT CAST(s AS INT) AS s FROM range(1, CAST(power(2, (SELECT count(*) FROM cats)) AS BIGINT)) r(s))",
    "fs AS (SELECT s, CAST(sum(c) AS BIGINT) AS freq, sum(c) / (SELECT sum(c) FROM pm) AS support FROM ss JOIN pm ON (mask & s) = s GROUP BY 1 "
    "HAVING sum(c) >= 0.01 * (SELECT sum(c) FROM pm))",
    "nm AS (SELECT s, string_agg(category, '|' ORDER BY category) AS items FROM ss JOIN cats ON ((s >> CAST(bit AS INT)) & 1) = 1 GROUP BY 1)",
    "ru AS (SELECT na.items AS antecedent, nc.items AS consequent, a.support AS antecedent_support, c.support AS consequent_support, u.support AS support, "
    "u.support / a.support AS confidence, u.support / a.support / c.support AS lift, u.support - a.support * c.support AS leverage, "
    "CASE WHEN u.support / a.support >= 1 THEN CAST('inf' AS DOUBLE) ELSE (1 - c.support) / (1 - u.support / a.support) END AS conviction "
    "FROM fs u JOIN fs a ON (u.s & a.s) = a.s AND a.s <> u.s JOIN fs c ON c.s = u.s - a.s JOIN nm na ON na.s = a.s JOIN nm nc ON nc.s = c.s "
    "WHERE u.support / a.support >= 0.3)",
)
RULE_COLUMNS = ("antecedent, consequent, round(antecedent_support, 4) AS antecedent_support, round(consequent_support, 4) AS consequent_support, "
                "round(support, 4) AS support, round(confidence, 4) AS confidence, round(lift, 4) AS lift, round(leverage, 4) AS leverage, "
                "round(conviction, 4) AS conviction")

# Sentences


def rupees(x: str) -> str:
    return f"concat('₹', format('{{:,.0f}}', CAST({x} AS DOUBLE)))"


def fmt(x: str, digits: int) -> str:
    return f"format('{{:,.{digits}f}}', CAST({x} AS DOUBLE))"


def best(dim: str, n: int, where: str = "TRUE") -> str:
    return (f"(SELECT string_agg(concat({dim}, ' (', {rupees('rev')}, ')'), ', ' ORDER BY rev DESC, {dim}) AS listed, max(rev) AS top_rev, "
            f"first({dim} ORDER BY rev DESC, {dim}) AS top_key FROM (SELECT {dim}, sum({AMT}) AS rev FROM t WHERE {where} AND {dim} IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {n}))")


def rule(n: int, text: str, value: str, source: str, where: str = "TRUE") -> str:
    return f"SELECT {n} AS rule, {text} AS text, round(CAST({value} AS DOUBLE), 2) AS value FROM {source} WHERE {where}"


TOTALS = (
    f"a AS (SELECT sum({AMT}) AS rev, count(*) AS n, avg(delivery_days) AS dd, avg(delivery_days) FILTER (is_festival_sale) - avg(delivery_days) FILTER (NOT is_festival_sale) AS delta, "
    f"100.0 * count(*) FILTER (return_status = 'Returned') / count(*) AS rr, 100.0 * sum({AMT}) FILTER (is_festival_sale) / sum({AMT}) AS fshare FROM t)"
)
GROWTH = ("gr AS (SELECT count(*) AS months, CASE WHEN count(*) >= 24 THEN 100.0 * (sum(value) FILTER (r <= 12) - sum(value) FILTER (r BETWEEN 13 AND 24)) / sum(value) FILTER (r BETWEEN 13 AND 24) "
          "WHEN count(*) >= 2 THEN 100.0 * (sum(value) FILTER (r = 1) - sum(value) FILTER (r = 2)) / sum(value) FILTER (r = 2) ELSE 0 END AS g "
          "FROM (SELECT *, row_number() OVER (ORDER BY month DESC) AS r FROM m))")
AOV6 = ("ao AS (SELECT min(month) AS first_month, max(month) AS last_month, arg_max(value / orders, month) - arg_min(value / orders, month) AS ch, count(*) AS n "
        "FROM (SELECT * FROM m ORDER BY month DESC LIMIT 6))")

INSIGHTS = " UNION ALL ".join([
    rule(1, f"concat('Year-over-year revenue ', CASE WHEN g >= 0 THEN 'grew' ELSE 'declined' END, ' by ', {fmt('abs(g)', 1)}, '% based on the latest window.')", "g", "gr"),
    rule(2, "concat('Top categories by revenue: ', listed, '.')", "top_rev", best("category", 3)),
    rule(3, "concat('Top cities by revenue: ', listed, '.')", "top_rev", best("city", 3)),
    rule(4, f"concat('Most revenue came via ', top_key, ' (~', {fmt('100.0 * top_rev / rev', 1)}, '% share).')", "100.0 * top_rev / rev", f"{best('payment_method', 1)} CROSS JOIN a"),
    rule(5, f"concat('Average delivery time is ', {fmt('dd', 1)}, ' days.')", "dd", "a", "dd IS NOT NULL"),
    rule(6, f"concat('Festival orders are ', {fmt('abs(delta)', 1)}, ' days ', CASE WHEN delta > 0 THEN 'slower' ELSE 'faster' END, ' than normal.')", "delta", "a", "abs(delta) >= 0.3"),
    rule(7, f"concat('Overall return rate is ', {fmt('rr', 2)}, '%.')", "rr", "a"),
    rule(8, f"concat('Highest return rate is in ', category, ' at ', {fmt('r', 2)}, '%.')", "r",
         "(SELECT category, 100.0 * count(*) FILTER (return_status = 'Returned') / count(*) AS r FROM t GROUP BY 1 HAVING count(*) >= greatest(100, 0.01 * (SELECT count(*) FROM t)) ORDER BY 2 DESC, 1 LIMIT 1)"),
    rule(9, f"concat('Peak monthly revenue was ', {rupees('value')}, ' in ', strftime(month, '%b %Y'), '.')", "value", "(SELECT * FROM m ORDER BY value DESC, month LIMIT 1)"),
    rule(10, f"concat('Festival orders contribute ', {fmt('fshare', 1)}, '% of total revenue.')", "fshare", "a"),
    rule(11, f"concat('Top festival by revenue: ', top_key, ' (', {rupees('top_rev')}, ').')", "top_rev", best("festival_name", 1, "is_festival_sale")),
    rule(12, f"concat('Avg order value has ', CASE WHEN ch > 0 THEN 'increased' ELSE 'decreased' END, ' by ', {rupees('abs(ch)')}, ' in the last 6 months.')", "ch", "ao", "n >= 6 AND abs(ch) > 1"),
])
OVERVIEW = " UNION ALL ".join([
    rule(1, f"concat('Total revenue: ', {rupees('rev')})", "rev", "a"),
    rule(2, f"concat('Total orders: ', {fmt('n', 0)})", "n", "a"),
    rule(3, f"concat('Avg order value: ', {rupees('rev / n')})", "rev / n", "a"),
    rule(4, "concat('Top city: ', top_key)", "top_rev", best("city", 1)),
    rule(5, "concat('Top category: ', top_key)", "top_rev", best("category", 1)),
])


def sentences(body: str, digits: int) -> str:
    """The same rules with the value rounded to ``digits``."""
    return body.replace("AS DOUBLE), 2) AS value", f"AS DOUBLE), {digits}) AS value")


RETURN_INSIGHTS = sentences(" UNION ALL ".join([
    rule(1, f"concat('Highest monthly return loss was ', {rupees('l')}, ' in ', strftime(month, '%b %Y'), '.')", "l", f"(SELECT {MONTH} AS month, sum({LOSS}) AS l FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)", "l > 0"),
    rule(2, f"concat(category, ' contributes the most to return loss (', {rupees('l')}, ').')", "l", f"(SELECT category, sum({LOSS}) AS l FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"),
    rule(3, f"concat('Overall return rate is ', {fmt('rr', 2)}, '%, causing ', {fmt('lp', 2)}, '% revenue loss.')", "rr", f"(SELECT 100.0 * count(*) FILTER (return_status = 'Returned') / count(*) AS rr, 100.0 * sum({LOSS}) / sum({AMT}) AS lp FROM t)"),
]), 4)
CHURN_INSIGHTS = sentences(" UNION ALL ".join([
    rule(1, f"concat('Snapshot date: ', strftime({LATEST}, '%d %b %Y'), '; churn threshold: 6 months (~182 days).')", "182", "(SELECT 1)"),
    rule(2, f"concat('Churn rate is ', {fmt('100.0 * c / n', 2)}, '% (', {fmt('c', 0)}, ' of ', {fmt('n', 0)}, ').')", "100.0 * c / n", "(SELECT sum(is_churned) AS c, count(*) AS n FROM ch)"),
    rule(3, f"concat('Highest-risk segment: R=', r_bucket, ' × F=', f_bucket, ' with avg risk ', {fmt('avg_risk', 1)}, ' across ', {fmt('customers', 0)}, ' customers.')", "avg_risk", "(SELECT * FROM h WHERE customers > 0 ORDER BY avg_risk DESC, r_bucket, f_bucket LIMIT 1)"),
    rule(4, "concat('Highest churn share observed among last-purchased ', last_category, ' customers.')", "s", "(SELECT last_category, avg(is_churned) AS s FROM ch JOIN lc USING (customer_id) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)"),
]), 4)

TOP_VALUES = ("(SELECT string_agg(concat(coalesce({c}, 'nan'), '(', n, ')'), '; ' ORDER BY n DESC, {c}) FROM "
              "(SELECT {c}, count(*) AS n FROM c1 GROUP BY 1 ORDER BY 2 DESC, 1 NULLS LAST LIMIT 5))")

CATEGORY_PERFORMANCE = by("category", f", count({AMT}) AS count, round(avg({AMT}), 4) AS avg")

REJECTS = (
    f"r0 AS (SELECT {date('order_date')} IS NULL AS bad_date, coalesce(trim(final_amount_inr) <> '' AND {price('final_amount_inr')} IS NULL, FALSE) AS bad_price, "
    f"coalesce(trim(customer_rating) <> '' AND {rating('customer_rating')} IS NULL, FALSE) AS bad_rating, FALSE AS broken FROM d "
    "UNION ALL SELECT FALSE, FALSE, FALSE, TRUE FROM t WHERE transaction_id % 97 = 0)",
    "r1 AS (SELECT unnest([CASE WHEN broken THEN 'broken_record' END, CASE WHEN bad_date THEN 'unparsed_date' END, CASE WHEN bad_price THEN 'unparsed_price' END, "
    "CASE WHEN bad_rating THEN 'unparsed_rating' END, 'all']) AS reason, broken OR bad_date AS gone FROM r0)",
)
SQL: dict[str, str] = {
    # sources and sinks
    "scan_csv": dirty("SELECT payment_method, count(*) AS rows, count(nullif(final_amount_inr, '')) AS amounts, count(DISTINCT nullif(city, '')) AS cities FROM d GROUP BY 1"),
    "scan_table": q("SELECT zone, count(*) AS rows, round(sum(quantity), 4) AS quantity FROM t GROUP BY 1"),
    "sink_table": by("order_year", ", count(transaction_id) AS orders"),
    "sink_csv": CATEGORY_PERFORMANCE,
    "clustered_lookup": q(" UNION ALL ".join(
        f"SELECT '{name}' AS lookup, {LINE} FROM t WHERE " + " AND ".join(f"{c} = (SELECT min({c}) FROM t)" for c in columns)
        for name, columns in (("place", ("category", "city")), ("customer", ("customer_id",)), ("product", ("product_id",))))),
    "refresh_year": by("order_year", ", count(transaction_id) AS orders", "order_year > 1995 OR transaction_id % 2 = 1"),
    "rejects": dirty("SELECT reason, count(*) AS rows, count(*) FILTER (gone) AS rejected, count(*) FILTER (NOT gone) AS kept FROM r1 WHERE reason IS NOT NULL GROUP BY 1", *REJECTS),
    "report_revenue": q(" UNION ALL ".join(
        f"SELECT '{report}' AS report, '{columns}' AS columns, zone, round(sum({amount}), 4) AS revenue FROM t GROUP BY zone" for report, columns, amount in (
            ("trends", "all", "discounted_price_inr"), ("trends", "some", "discounted_price_inr"), ("trends", "unit", "discounted_price_inr"),
            ("products", "all", AMT), ("products", "some", "subtotal_inr"), ("products", "unit", "discounted_price_inr * quantity"),
            ("regions", "all", AMT), ("regions", "some", "subtotal_inr"), ("regions", "unit", "0.0"),
            ("returns", "all", AMT), ("returns", "some", "subtotal_inr"), ("export", "all", AMT), ("export", "some", "subtotal_inr")))),
    "filter_places": q(f"SELECT 'state' AS panel, {LINE} FROM t WHERE customer_state = (SELECT min(customer_state) FROM t) "
        f"UNION ALL SELECT 'city', {LINE} FROM t WHERE city = (SELECT max(city) FROM t)"),
    "export_churned": q(f"SELECT {CHURN_COLUMNS} FROM ch WHERE is_churned = 1", *CHURN),
    "report_export": q(
        f"SELECT 'filtered_data' AS table_name, count(*) AS rows FROM f UNION ALL SELECT 'kpis', 1 UNION ALL "
        "SELECT 'monthly_revenue', count(DISTINCT date_trunc('month', order_date)) FROM f UNION ALL SELECT 'categories', count(DISTINCT category) FROM f UNION ALL "
        "SELECT 'products', count(DISTINCT product_name) FROM f UNION ALL SELECT 'states', count(DISTINCT customer_state) FROM f UNION ALL SELECT 'returns', count(DISTINCT return_status) FROM f",
        f"f AS (SELECT * FROM t WHERE {PANEL})"),
    "report_filtered_data": q(f"SELECT {LINE} FROM t WHERE {PANEL}"),
    "report_kpis": q(f"SELECT round(sum({AMT}), 2) AS total_revenue, count(*) AS total_orders, count(DISTINCT customer_id) AS unique_customers, round(sum({AMT}) / count(*), 2) AS avg_order_value FROM t WHERE {PANEL}"),
    "report_monthly": q(f"SELECT strftime(order_date, '%Y-%m') AS month_label, {REV} FROM t WHERE {PANEL} GROUP BY 1"),
    "report_categories": by("category", where=PANEL),
    "report_products": by("product_name", where=PANEL),
    "report_states": by("customer_state", where=PANEL),
    "report_returns": q(f"SELECT {returned('return_status', 'export')} AS is_returned, count({AMT}) AS orders, {REV} FROM t WHERE {PANEL} GROUP BY 1"),
    "insights": q(INSIGHTS, TOTALS, SERIES, GROWTH, AOV6),
    "overview": q(OVERVIEW, TOTALS),
    "return_insights": q(RETURN_INSIGHTS),
    "churn_insights": q(CHURN_INSIGHTS, *HEAT, LAST_CATEGORY),
    "shape": q("SELECT count(*) AS rows, 30 AS columns FROM t"),
    # schema and projection
    "normalize_columns": CATEGORY_PERFORMANCE,
    "resolve_schema": q(f"SELECT customer_state, product_name, round(sum(quantity), 4) AS quantity, {REV} FROM t GROUP BY 1, 2"),
    "default_columns": q("SELECT 'Unknown' AS category, 'Unknown' AS payment_method, FALSE AS is_festival_sale, CAST(order_year AS INT) AS order_year, count(*) AS rows, CAST(0 AS BIGINT) AS with_days FROM t GROUP BY order_year"),
    "derive_revenue": q("SELECT brand, round(sum(discounted_price_inr * quantity), 4) AS revenue FROM t GROUP BY 1"),
    "derive_price": q("SELECT brand, round(avg(p), 4) AS avg_price, count(p) AS priced_rows, count(*) AS rows FROM (SELECT brand, CASE WHEN transaction_id % 7 <> 0 AND quantity <> 0 THEN final_amount_inr / quantity END AS p FROM t) GROUP BY 1"),
    # filters
    "filter_panel": q(f"SELECT {LINE} FROM t WHERE {PANEL}"),
    "filter_panel_default": by("category", f", count({AMT}) AS count, round(avg({AMT}), 4) AS avg",
                               "order_year IN (SELECT DISTINCT order_year FROM t ORDER BY 1 DESC LIMIT 3) AND category IN (SELECT DISTINCT category FROM t ORDER BY 1 LIMIT 5)"),
    "filter_domain": q("SELECT DISTINCT city FROM t WHERE city IS NOT NULL"),
    "drop_bad_dates": dirty(f"SELECT payment_method, count(*) AS rows FROM d WHERE {date('order_date')} IS NOT NULL GROUP BY 1"),
    "festival_keyword": dirty("SELECT event_name, count(*) AS rows FROM d WHERE " + " OR ".join(f"event_name ILIKE '%{w}%'" for w in fixed.FESTIVAL_WORDS) + " GROUP BY 1"),
    "price_guard": q("SELECT brand, count(*) AS rows, round(sum(quantity - 3), 4) AS quantity FROM t WHERE discounted_price_inr - 500 > 0 AND quantity - 3 >= 0 GROUP BY 1"),
    "return_flag": dirty("SELECT return_status AS raw, " + ", ".join(f"{returned('return_status', r)} AS in_{r}" for r in ("returns", "export", "profit", "insights")) + ", count(*) AS rows FROM d GROUP BY ALL"),
    "elasticity_eligible": q(ELIGIBLE, *PRICED[:1]),
    "worst_return_category": q("SELECT category, count(*) AS orders, round(avg(CAST(return_status = 'Returned' AS INT)), 4) AS return_rate FROM t GROUP BY 1 HAVING count(*) >= greatest(100, 0.01 * (SELECT count(*) FROM t)) ORDER BY avg(CAST(return_status = 'Returned' AS INT)) DESC, 1 LIMIT 1"),
    "iqr_outliers": q(f"SELECT {LINE} FROM t WHERE {AMT} > (SELECT quantile_cont({AMT}, 0.75) + 0.3 * (quantile_cont({AMT}, 0.75) - quantile_cont({AMT}, 0.25)) FROM t) ORDER BY t.{AMT} DESC, transaction_id, product_id LIMIT 1000"),
    "iqr_outliers_default": q(f"SELECT {LINE} FROM t WHERE {AMT} > (SELECT quantile_cont({AMT}, 0.75) + 5 * (quantile_cont({AMT}, 0.75) - quantile_cont({AMT}, 0.25)) FROM t) ORDER BY t.{AMT} DESC, transaction_id, product_id LIMIT 1000"),
    "low_stock": q("SELECT DISTINCT product_name, stock FROM t WHERE stock < 10 ORDER BY 1, 2 LIMIT 20"),
    # cleaning
    "clean_price": dirty(f"SELECT final_amount_inr AS raw, round({price('final_amount_inr')}, 4) AS cleaned, count(*) AS rows FROM d GROUP BY ALL"),
    "clean_category": dirty(f"SELECT category, subcategory, product_name, {category('category', 'subcategory', 'product_name')} AS cleaned, count(*) AS rows FROM d GROUP BY ALL"),
    "clean_city": cleaned("city", city("city")),
    "clean_payment": dirty(f"SELECT payment_method AS raw, {payment('payment_method')} AS cleaned, {payment('payment_method', fixed.STRICT_PAYMENT_PATTERNS)} AS strict, count(*) AS rows FROM d GROUP BY ALL"),
    "clean_bool": dirty(f"SELECT is_prime_member AS raw, {yes('is_prime_member')} AS cleaned, {flag('is_prime_member')} AS flag, count(*) AS rows FROM d GROUP BY ALL"),
    "clean_rating": cleaned("customer_rating", rating("customer_rating")),
    "parse_dates": cleaned("order_date", f"CAST({date('order_date')} AS DATE)"),
    "clean_delivery": cleaned("delivery_days", delivery("delivery_days")),
    "value_segment": q(f"SELECT {segment('a')} AS segment, count(*) AS rows, round(sum(a), 4) AS revenue FROM (SELECT CASE WHEN transaction_id % 11 <> 0 THEN {AMT} END AS a FROM t) GROUP BY 1"),
    "final_amount": dirty(f"SELECT customer_state, count(*) AS rows, round(sum({CLEAN_AMOUNT}), 4) AS amount, count(*) FILTER ({CLEAN_AMOUNT} = 0) AS zero_rows FROM d GROUP BY 1"),
    "date_parts": q("SELECT CAST(year(order_date) AS INT) AS order_year, CAST(month(order_date) AS INT) AS order_month_num, CAST(quarter(order_date) AS INT) AS order_quarter, strftime(order_date, '%Y-%m') AS month_label, strftime(order_date, '%b') AS month_name, count(*) AS rows FROM t GROUP BY ALL"),
    "dup_flag": q(f"SELECT zone, n > 1 AS is_possible_duplicate, count(*) AS rows, round(sum({AMT}), 4) AS revenue FROM (SELECT *, count(transaction_id) OVER (PARTITION BY customer_id, category, order_date) AS n FROM t) GROUP BY 1, 2"),
    "qa_report": dirty(
        "SELECT 'rows_before' AS metric, CAST(count(*) AS STRING) AS value FROM d UNION ALL SELECT 'rows_after', CAST(count(*) AS STRING) FROM c1 UNION ALL "
        "SELECT 'rows_dropped_due_to_invalid_dates', CAST((SELECT count(*) FROM d) - (SELECT count(*) FROM c1) AS STRING) UNION ALL "
        + " UNION ALL ".join(f"SELECT 'top_{c}_after', {TOP_VALUES.format(c=c)}" for c in ("category", "city", "payment_method")), CLEAN_CTE),
    "clean_pipeline": dirty(
        "SELECT category, city, payment_method, order_year, order_value_segment, is_prime, count(*) AS rows, round(sum(amount), 4) AS revenue, round(sum(rating), 4) AS ratings, round(sum(days), 4) AS days, "
        "count(*) FILTER (copies > 1) AS duplicates FROM (SELECT *, count(transaction_id) OVER (PARTITION BY customer_id, product_id, parsed, amount) AS copies FROM c1) GROUP BY ALL", CLEAN_CTE),
    # aggregates
    "kpis": q(f"SELECT round(sum({AMT}), 2) AS total_revenue, count(*) AS total_orders, round(sum({AMT}) / count(*), 2) AS avg_order_value, round(avg({AMT}), 2) AS mean_amount FROM t"),
    "category_performance": CATEGORY_PERFORMANCE,
    "city_revenue": by("city", ", count(transaction_id) AS orders"),
    "payment_share": by("payment_method", f", count(transaction_id) AS orders, round(100 * sum({AMT}) / (SELECT sum({AMT}) FROM t), 4) AS share_pct"),
    "payment_counts": q("SELECT payment_method, count(*) AS orders FROM t GROUP BY 1"),
    "payment_top_share": q(f"SELECT payment_method, round(100 * sum({AMT}) / (SELECT sum({AMT}) FROM t), 4) AS share_pct, {REV} FROM t GROUP BY 1 ORDER BY sum({AMT}) DESC LIMIT 1"),
    "sales_by_year": by("order_year", ", count(transaction_id) AS orders"),
    "monthly_revenue": q(f"SELECT strftime(order_date, '%Y-%m') AS month_label, {REV} FROM t GROUP BY 1"),
    "daily_revenue": q(f"SELECT CAST(order_date AS DATE) AS order_day, {REV} FROM t GROUP BY 1"),
    "sales_monthly": by("order_year, order_month"),
    "month_year_pivot": q("SELECT order_month, " + ", ".join(f"round(coalesce(sum({AMT}) FILTER (order_year = {y}), 0), 4) AS y{y}" for y in range(1995, 2002)) + " FROM t GROUP BY 1"),
    "month_seasonality": q(f"SELECT CAST(i AS INT) AS order_month, round(coalesce(sum({AMT}), 0), 4) AS revenue FROM range(1, 13) r(i) LEFT JOIN t ON order_month = i GROUP BY 1"),
    "category_trends": by("order_year, category"),
    "category_monthly": q(f"SELECT concat(order_year, '-', lpad(CAST(order_month AS STRING), 2, '0')) AS period, category, {REV} FROM t GROUP BY 1, 2"),
    "prime_summary": q(f"SELECT is_prime_member, {REV}, count(transaction_id) AS orders, CASE WHEN is_prime_member THEN 'Prime' ELSE 'Non-Prime' END AS label, round(sum({AMT}) / count(transaction_id), 4) AS avg_order_value, round(100.0 * count(*) / (SELECT count(*) FROM t), 4) AS order_pct FROM t GROUP BY 1"),
    "customer_kpis": q(f"SELECT count(*) AS total_customers, count(*) FILTER (n > 1) AS repeat_customers, count(*) FILTER (prime) AS prime_customers, count(*) FILTER (NOT prime) AS non_prime_customers, round(avg(s), 4) AS avg_spend FROM (SELECT customer_id, count(*) AS n, bool_or(is_prime_member) AS prime, sum({AMT}) AS s FROM t GROUP BY 1)"),
    "tier_revenue": by("customer_tier"),
    "age_revenue": by("customer_age_group"),
    "scan_limit": q(f"SELECT {LINE} FROM t ORDER BY transaction_id, product_id, customer_id, t.order_date, t.final_amount_inr LIMIT 1"),
    "preview": q(f"SELECT {LINE} FROM t ORDER BY transaction_id, customer_id, product_id, t.order_date, t.final_amount_inr LIMIT 100"),
    "price_scatter": q("SELECT product_name, price, quantity, round(final_amount_inr, 4) AS revenue FROM (SELECT *, row_number() OVER (PARTITION BY product_name ORDER BY h, price, quantity) AS r "
        "FROM (SELECT *, md5(concat_ws('|', '42', concat('=', transaction_id), concat('=', product_id), concat('=', customer_id), concat('=', delivery_days))) AS h FROM pr)) "
        "WHERE r <= greatest(1, 50000 // (SELECT count(DISTINCT product_name) FROM pr)) ORDER BY h, price, quantity LIMIT 50000", PRICED[0]),
    "distinct_rollup": q("SELECT 'category' AS segment, category AS name, count(DISTINCT customer_id) AS customers FROM t GROUP BY category "
        "UNION ALL SELECT 'year', CAST(order_year AS VARCHAR), count(DISTINCT customer_id) FROM t GROUP BY order_year "
        "UNION ALL SELECT 'panel', 'all', count(DISTINCT customer_id) FROM t WHERE order_year IN (1999, 2000, 2001) AND category IN ('ECONOMY', 'LARGE', 'PROMO') "
        "UNION ALL SELECT 'both', 'ECONOMY and PROMO', count(*) FROM (SELECT customer_id FROM t WHERE category = 'ECONOMY' INTERSECT SELECT customer_id FROM t WHERE category = 'PROMO')"),
    "quantile_rollup": q("SELECT order_year, p, rows, round(value, 4) AS value FROM (SELECT order_year, count(*) AS rows, unnest(CAST([0.05, 0.25, 0.5, 0.75, 0.95] AS DOUBLE[])) AS p, "
        "unnest(quantile_disc(final_amount_inr, [0.05, 0.25, 0.5, 0.75, 0.95])) AS value FROM t GROUP BY 1)"),
    "top_values_bounded": q(" UNION ALL ".join(f"SELECT * FROM (SELECT '{c}' AS dim, CAST({c} AS VARCHAR) AS value, count(*) AS rows FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY 3 DESC, {c} LIMIT 5)"
        for c in ("product_name", "brand", "customer_id", "category"))),
    "distinct_counts": q("SELECT count(DISTINCT product_name) AS n_product_name, count(DISTINCT product_id) AS n_product_id, count(DISTINCT customer_state) AS n_customer_state, count(DISTINCT date_trunc('month', order_date)) AS n_month FROM t"),
    "delivery_by_state": q("SELECT customer_state, round(avg(delivery_days), 4) AS avg_delivery_days FROM t GROUP BY 1"),
    "festival_delivery_delta": q("SELECT round(avg(delivery_days), 4) AS avg_delivery, round(f, 4) AS festival, round(n, 4) AS normal, round(f - n, 4) AS delta, abs(f - n) >= 0.3 AS notable FROM (SELECT avg(delivery_days) AS delivery_days, avg(delivery_days) FILTER (is_festival_sale) AS f, avg(delivery_days) FILTER (NOT is_festival_sale) AS n FROM t) GROUP BY f, n"),
    "delivery_hist": q("SELECT delivery_days, count(*) AS rows FROM t GROUP BY 1"),
    "delivery_types": q("SELECT return_reason AS delivery_type, count(*) AS count FROM t GROUP BY 1"),
    "delivery_box": q("SELECT CASE WHEN is_prime_member THEN 'Prime' ELSE 'Non-Prime' END AS member, CAST(min(delivery_days) AS DOUBLE) AS lowest, quantile_cont(CAST(delivery_days AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(delivery_days AS DOUBLE), 0.5) AS median, quantile_cont(CAST(delivery_days AS DOUBLE), 0.75) AS q3, CAST(max(delivery_days) AS DOUBLE) AS highest FROM t GROUP BY 1"),
    "return_kpis": q(f"SELECT round(sum({LOSS}), 2) AS total_return_loss, count(*) FILTER (return_status = 'Returned') AS returned_orders, count(*) AS total_orders, round(100.0 * count(*) FILTER (return_status = 'Returned') / count(*), 2) AS return_rate_pct, round(100 * sum({LOSS}) / sum({AMT}), 2) AS loss_pct_of_revenue, (SELECT category FROM t GROUP BY 1 ORDER BY sum({LOSS}) DESC, 1 LIMIT 1) AS most_affected_category FROM t"),
    "return_status_counts": q("SELECT return_status, count(*) AS count FROM t GROUP BY 1"),
    "return_loss_category": loss_by("category", 10),
    "return_loss_state": loss_by("customer_state", 15),
    "return_loss_product": loss_by("product_name", 10),
    "return_loss_reason": loss_by("return_reason", 12),
    "return_loss_month": q(f"SELECT {MONTH} AS month, round(sum({LOSS}), 4) AS return_loss, count(*) FILTER (return_status = 'Returned') AS return_count FROM t GROUP BY 1"),
    "return_summary": q(f"SELECT {returned('return_status', 'export')} AS is_returned, count({AMT}) AS orders, {REV} FROM t GROUP BY 1"),
    "profit_kpis": q(f"SELECT round(sum({AMT}), 2) AS total_revenue, round(sum(cost), 2) AS total_cost, round(sum(profit), 2) AS total_profit, round(100 * sum(profit) / sum({AMT}), 2) AS margin_pct, round(sum(return_loss), 2) AS total_return_loss FROM pf", PROFIT),
    "profit_by_category": q("SELECT category, round(sum(profit), 5) AS profit FROM pf GROUP BY 1 ORDER BY sum(profit) DESC, 1 LIMIT 10", PROFIT),
    "profit_monthly": q(f"SELECT strftime(order_date, '%Y-%m') AS month_label, round(sum(final_amount_inr), 5) AS revenue, round(sum(profit), 5) AS profit FROM pf GROUP BY 1", PROFIT),
    "discount_profit_points": q(f"SELECT round(discount_percent, 5) AS discount_percent, round(profit, 5) AS profit, round({AMT}, 5) AS final_amount_inr FROM pf WHERE discount_percent IS NOT NULL", PROFIT),
    "discount_slab": q(" UNION ALL ".join(f"SELECT '({a}, {b}]' AS slab, round(coalesce(sum({AMT}), 0), 4) AS revenue FROM t WHERE discount_percent > {a} AND discount_percent <= {b}" for a, b in SLABS)),
    "festival_revenue": top("festival_name", 10, where="is_festival_sale AND festival_name IS NOT NULL"),
    "festival_share": q(f"SELECT round(sum({AMT}) FILTER (is_festival_sale), 2) AS festival_revenue, count(*) FILTER (is_festival_sale) AS festival_orders, round_even(sum({AMT}) FILTER (is_festival_sale) / count(*) FILTER (is_festival_sale), 2) AS avg_festival_order, round(100 * sum({AMT}) FILTER (is_festival_sale) / sum({AMT}), 2) AS share_pct FROM t"),
    "festival_spike": q(f"SELECT CASE WHEN is_festival_sale THEN 'Festival' ELSE 'Non-Festival' END AS label, round_even(avg({AMT}), 2) AS avg_amount FROM t GROUP BY 1"),
    "festival_monthly": q(f"SELECT order_year, order_month, concat(order_year, '-', order_month) AS period, CASE WHEN is_festival_sale THEN 'Festival' ELSE 'Non-Festival' END AS label, {REV} FROM t GROUP BY 1, 2, 3, 4"),
    "event_revenue": by("festival_name", where="festival_name IN ('Diwali', 'Holi', 'Christmas', 'New Year')"),
    "state_revenue": by("customer_state"),
    "state_share_top10": q(f"SELECT customer_state, round(rev, 4) AS revenue, round(100 * rev / sum(rev) OVER (), 4) AS share_pct FROM (SELECT customer_state, sum({AMT}) AS rev FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)"),
    "customer_summary": q("SELECT customer_id, CAST(last_order_date AS DATE) AS last_order_date, orders, round(lifetime_value, 4) AS lifetime_value, recency_days FROM cs", *CUSTOMER_SUMMARY),
    "customer_describe": q(" UNION ALL ".join(describe_part(c) for c in ("orders", "lifetime_value", "recency_days")), *CUSTOMER_SUMMARY),
    "monthly_demand": q(f"SELECT {MONTH} AS month, round(sum(quantity), 4) AS value FROM t GROUP BY 1"),
    "product_demand": q(f"SELECT product_name, {MONTH} AS month, round(sum(quantity), 4) AS value FROM t GROUP BY 1, 2"),
    "price_kpis": q(f"SELECT round(avg(price), 4) AS avg_price, round(min(price), 4) AS min_price, round(max(price), 4) AS max_price, (SELECT count(*) FROM ({ELIGIBLE})) AS eligible_products FROM pr", *PRICED[:1]),
    "topn": q("SELECT brand, count(*) AS count FROM t GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    # ranks, bins and positions
    "order_rank": q("SELECT customer_id, CAST(order_date AS DATE) AS order_date, transaction_id, product_id, row_number() OVER (PARTITION BY customer_id ORDER BY t.order_date, transaction_id, product_id) AS order_rank FROM t"),
    "new_customers": q("SELECT count(DISTINCT customer_id) AS new_customers, count(DISTINCT customer_id) AS total_customers, CAST(0 AS BIGINT) AS returning_customers FROM t"),
    "new_vs_returning": q(f"SELECT month, count(*) FILTER (month = fm) AS new_customers, count(*) FILTER (month > fm) AS returning_customers FROM (SELECT DISTINCT customer_id, {MONTH} AS month, min({MONTH}) OVER (PARTITION BY customer_id) AS fm FROM t) GROUP BY 1"),
    "rfm_quintiles": q(f"SELECT customer_id, frequency, {rank_bin('frequency')} AS quintile FROM (SELECT customer_id, count(*) AS frequency FROM t GROUP BY 1)"),
    "value_quintiles": q(f"SELECT customer_id, round(monetary, 4) AS monetary, {value_bin('monetary', 'p')} AS quintile FROM p", PROFILE),
    "price_bins": q("SELECT price_bin, count(*) AS rows, round(sum(quantity), 4) AS quantity FROM bd GROUP BY 1", *PRICED[:2]),
    "minmax": q(f"SELECT customer_id, round({scaled('monetary', 'p')}, 4) AS scaled FROM p", PROFILE),
    "demand_ma3": q(f"SELECT product_name, CAST(floor(avg(v)) AS BIGINT) AS forecast_units FROM (SELECT product_name, {MONTH} AS mo, sum(quantity) AS v, row_number() OVER (PARTITION BY product_name ORDER BY {MONTH} DESC) AS r FROM t GROUP BY 1, 2) WHERE r <= 3 GROUP BY 1 HAVING count(*) >= 3"),
    "yoy_growth": q("SELECT months, round(g, 4) AS growth_pct FROM gr", SERIES, GROWTH),
    "aov_trend_6m": q("SELECT first_month, last_month, round(ch, 4) AS aov_change FROM ao", SERIES, AOV6),
    "last_category": q("SELECT * FROM lc", LAST_CATEGORY),
    "peak_month": q(f"SELECT strftime(order_date, '%Y-%m') AS month_label, {REV} FROM t GROUP BY 1 ORDER BY sum({AMT}) DESC LIMIT 1"),
    "top_dims": q(" UNION ALL ".join(f"SELECT * FROM (SELECT '{d}' AS dim, {d} AS name, {REV} FROM t GROUP BY 2 ORDER BY sum({AMT}) DESC LIMIT 1)" for d in ("city", "category", "product_name", "brand", "customer_state"))),
    "monthly_spine": q("SELECT k AS brand, CAST(mo AS DATE) AS month, round(coalesce(value, 0), 4) AS value FROM (SELECT k, unnest(generate_series(CAST(min(month) AS TIMESTAMP), CAST(max(month) AS TIMESTAMP), INTERVAL 1 MONTH)) AS mo FROM m GROUP BY 1) sp LEFT JOIN m USING (k) WHERE FALSE".replace(
        " LEFT JOIN m USING (k) WHERE FALSE", " LEFT JOIN (SELECT k AS k2, month, value FROM m) ON k2 = k AND month = CAST(mo AS DATE)"),
        f"m AS (SELECT brand AS k, {MONTH} AS month, sum({AMT}) AS value FROM t WHERE order_month NOT IN (2, 7) GROUP BY 1, 2)"),
    # joins and reshapes
    "churn_by_last_category": q("SELECT last_category, round(avg(is_churned), 4) AS churn_share, count(*) AS customers FROM ch JOIN lc USING (customer_id) GROUP BY 1", *CHURN, LAST_CATEGORY),
    "distinct_pairs": q("SELECT DISTINCT transaction_id, category FROM t"),
    "profit_monthly_long": q("SELECT strftime(order_date, '%Y-%m') AS month_label, 'revenue' AS metric, round(sum(final_amount_inr), 5) AS value FROM pf GROUP BY 1 UNION ALL SELECT strftime(order_date, '%Y-%m'), 'profit', round(sum(profit), 5) FROM pf GROUP BY 1", PROFIT),
    "return_monthly_long": q(f"SELECT {MONTH} AS month, 'return_loss' AS metric, round(sum({LOSS}), 4) AS value FROM t GROUP BY 1 UNION ALL SELECT {MONTH}, 'return_count', CAST(count(*) FILTER (return_status = 'Returned') AS DOUBLE) FROM t GROUP BY 1"),
    "forecast_union": q("SELECT month, round(value, 4) AS value, 'actual' AS kind FROM m UNION ALL SELECT month, round(forecast, 4), 'forecast' FROM fc", ALL_SERIES, *forecast_ctes("k")),
    # top-k lists
    "top_products": top("product_id, product_name", 50),
    "top_products_500": top("product_id", 500, extra=", count(transaction_id) AS orders"),
    "top_customers": top("customer_id", 50),
    "top_brands": top("brand", 10),
    "top_product_names": top("product_name", 10),
    "top_categories": top("category", 10),
    "top_cities": top("city", 15),
    "top_states": top("customer_state", 10),
    "courier_performance": top("delivery_partner", 10, "avg(delivery_days)", "avg_delivery_days", "ASC"),
    "top_churn_risk": q(f"SELECT {CHURN_COLUMNS} FROM ch ORDER BY is_churned DESC, ch.churn_risk_score DESC, ch.recency_days DESC, customer_id LIMIT 50", *CHURN),
    "top_rfm": q("SELECT * REPLACE (round(monetary, 4) AS monetary) FROM v ORDER BY v.rfm_score DESC, v.monetary DESC, customer_id LIMIT 10", *RFM_V1),
    "top_clv": q("SELECT * REPLACE (round(monetary, 4) AS monetary) FROM v ORDER BY v.rfm_score DESC, customer_id LIMIT 10", *RFM_V2),
    "elasticity_rank": q("SELECT * FROM (SELECT product_name, elasticity, label, 'most elastic' AS side FROM el ORDER BY elasticity, product_name LIMIT 10) UNION ALL SELECT * FROM (SELECT product_name, elasticity, label, 'least elastic' FROM el ORDER BY elasticity DESC, product_name LIMIT 10)", *PRICED),
    "top_qty_products": top("product_name", 10, "sum(quantity)", "quantity"),
    # composite analytics
    "rfm_v1": q("SELECT * REPLACE (round(monetary, 4) AS monetary) FROM v", *RFM_V1),
    "rfm_segments": q("SELECT segment, count(*) AS customers FROM v GROUP BY 1", *RFM_V1),
    "rfm_v2": q("SELECT * REPLACE (round(monetary, 4) AS monetary) FROM v", *RFM_V2),
    "rfm_v2_kpis": q("SELECT count(*) AS total_customers, round(avg(monetary), 4) AS avg_monetary, max(rfm_score) AS best_score FROM v", *RFM_V2),
    "churn_scores": q("SELECT * REPLACE (round(monetary, 4) AS monetary, CAST(last_purchase AS DATE) AS last_purchase) FROM ch", *CHURN),
    "churn_kpis": q("SELECT count(*) AS total_customers, count(*) FILTER (is_churned = 0) AS active_customers, count(*) FILTER (is_churned = 1) AS churned_customers, round(100.0 * sum(is_churned) / count(*), 4) AS churn_rate FROM ch", *CHURN),
    "churn_status": q("SELECT status, count(*) AS customers FROM ch GROUP BY 1", *CHURN),
    "risk_heatmap": q("SELECT r_bucket, f_bucket, round(avg_risk, 4) AS avg_risk, customers FROM h", *HEAT),
    "recency_hist": q("SELECT bin, count(*) AS customers, round(lo + (bin - 1) * (hi - lo) / 40, 4) AS low, round(lo + bin * (hi - lo) / 40, 4) AS high FROM (SELECT *, CAST(least(40, greatest(1, ceil((recency_days - lo) / ((hi - lo) / 40)))) AS INT) AS bin FROM ch CROSS JOIN (SELECT CAST(min(recency_days) AS DOUBLE) AS lo, CAST(max(recency_days) AS DOUBLE) AS hi FROM ch)) GROUP BY bin, lo, hi", *CHURN),
    "price_elasticity": q("SELECT * FROM el", *PRICED),
    "elasticity_labels": q("SELECT label, count(*) AS products FROM el GROUP BY 1", *PRICED),
    "revenue_curve": q("SELECT price_bin, round(avg_price, 2) AS avg_price, round(revenue, 4) AS revenue FROM rc", *PRICED),
    "best_price_band": q("SELECT price_bin, round(avg_price, 2) AS avg_price, round(revenue, 4) AS revenue FROM rc ORDER BY rc.revenue DESC LIMIT 1", *PRICED),
    "product_bands": q("SELECT product_name, price_bin, round(avg_price, 2) AS avg_price, round(total_qty, 4) AS total_qty, round(revenue, 4) AS revenue FROM pb", *PRICED),
    "product_best_band": q("SELECT product_name, arg_max(price_bin, revenue) AS price_bin, round(arg_max(avg_price, revenue), 2) AS avg_price, round(max(revenue), 4) AS revenue FROM pb WHERE product_name IN (SELECT product_name FROM vp) GROUP BY 1", *PRICED),
    "trend_season_forecast": q("SELECT month, round(forecast, 4) AS forecast FROM fc", ALL_SERIES, *forecast_ctes("k")),
    "brand_forecast": q("SELECT k AS brand, month, round(forecast, 4) AS forecast FROM fc", BRAND_SERIES, *forecast_ctes("k")),
    "seasonal_ar_forecast": recursive(q("SELECT CAST(last_month + to_months(i) AS DATE) AS month, round(ys[-1], 1) AS forecast FROM roll WHERE i > 0", *seasonal_ctes(ALL_SERIES))),
    "brand_seasonal_ar_forecast": recursive(q("SELECT k AS brand, CAST(last_month + to_months(i) AS DATE) AS month, round(ys[-1], 1) AS forecast FROM roll WHERE i > 0", *seasonal_ctes(BRAND_SERIES))),
    "seasonal_arma_forecast": recursive(q("SELECT CAST(last_month + to_months(i) AS DATE) AS month, round(ys[-1], 1) AS forecast FROM roll WHERE i > 0", *arma_ctes(ALL_SERIES))),
    "brand_seasonal_arma_forecast": recursive(q("SELECT k AS brand, CAST(last_month + to_months(i) AS DATE) AS month, round(ys[-1], 1) AS forecast FROM roll WHERE i > 0", *arma_ctes(BRAND_SERIES))),
    "basket_pairs": pairs("category"),
    "basket_pairs_brand": pairs("brand"),
    "freq_itemsets": q("SELECT items, freq, round(support, 4) AS support FROM fs JOIN nm USING (s)", *SETS),
    "freq_itemsets_brand": sets_to_three("brand"),
    "assoc_rules": q(f"SELECT {RULE_COLUMNS} FROM ru", *SETS),
    "top_rules": q(f"SELECT {RULE_COLUMNS} FROM ru ORDER BY round(ru.lift, 8) DESC, antecedent, consequent LIMIT 10", *SETS),
}


# stored otherwise, the same answers
SQL["customer_summary_bucketed"] = SQL["customer_summary"]
SQL["last_category_bucketed"] = SQL["last_category"]


def all_oracles() -> dict[str, str]:
    return dict(SQL)
