"""DuckDB oracle: one independent SQL text per query key.

The raw layer is the very same adapter text the Spark engine runs; everything after it (cleaning,
filters, KPIs, charts) is re-stated here in plain SQL. Arithmetic mirrors the engine's exactness
rules: money summed as DECIMAL and converted to double after rounding to 4 decimals, rounded
percentages of counts by integer arithmetic, averages as sum / count.
"""

from __future__ import annotations

import math

from marketlens.sources.adapter import duckdb_sql

# a word is a run of letters and digits; what lies between is kept as it is
WORD_OR_GAP = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"
# numerical integration of the test distributions
STEPS, NORMAL_SPAN, T_CUTOFF = 2000, 12.0, 40.0

# ---------------------------------------------------------------- expression helpers
WS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"
DELIVERED = "order_status = 'Delivered'"


def tc(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '{WORD_OR_GAP}', 0), "
            f"lambda w: upper(w[1:1]) || w[2:]), '')")


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def money(x: str) -> str:
    return f"try_cast({x} AS DECIMAL(22,6))"


def rate(x: str) -> str:
    return f"try_cast({x} AS DECIMAL(12,8))"


def msum(x: str) -> str:
    return f"coalesce(sum({money(x)}), 0)"


def td(x: str) -> str:
    return f"cast(round({x}, 4) AS DOUBLE)"


def nu(x: str) -> str:
    return f"(count(DISTINCT {x}) + coalesce(max(CASE WHEN {x} IS NULL THEN 1 ELSE 0 END), 0))"


def dbl(x: str) -> str:
    return f"cast({x} AS DOUBLE)"


def ratio(a: str, b: str) -> str:
    return f"({dbl(a)} / {dbl(b)})"


def pct(a: str, b: str) -> str:
    return f"({dbl(a)} / {dbl(b)} * 100)"


def pct0(a: str, b: str) -> str:
    return f"(CASE WHEN {b} = 0 THEN 0.0 ELSE {dbl(a)} / {dbl(b)} * 100 END)"


def rpct(a: str, b: str, scale: int = 1) -> str:
    unit = 10 ** scale
    return (f"(CASE WHEN {b} = 0 THEN NULL ELSE "
            f"cast((cast({2 * 100 * unit} AS BIGINT) * cast({a} AS BIGINT) + cast({b} AS BIGINT)) // (2 * cast({b} AS BIGINT)) AS DOUBLE) / {unit} END)")


def cnt(cond: str) -> str:
    return f"coalesce(sum(CASE WHEN {cond} THEN 1 ELSE 0 END), 0)"


def avg(x: str) -> str:
    return f"({dbl(f'sum({x})')} / count({x}))"


def lit(v: float) -> str:
    return f"cast({v!r} AS DOUBLE)"


NET_REV = (f"({money('order_value')} * {rate('commission_rate')} + {money('delivery_fee')} - "
           f"{money('delivery_cost_to_rider')} - {money('payment_gateway_fee')} - {money('discount_amount')})")
COMMISSION = f"({money('order_value')} * {rate('commission_rate')})"


def simpson(lo: str, hi: str, f) -> str:
    h = f"(({hi}) - ({lo})) / {STEPS}"
    w = f"(CASE WHEN i = 0 OR i = {STEPS} THEN 1.0 WHEN i % 2 = 1 THEN 4.0 ELSE 2.0 END)"
    terms = f"list_transform(range(0, {STEPS + 1}), lambda i: {w} * {f(f'(({lo}) + cast(i AS DOUBLE) * {h})')})"
    return f"(list_reduce(list_prepend(0.0, {terms}), lambda a, b: a + b) * {h} / 3.0)"


def normal_p(z: str) -> str:
    a = f"abs({z})"
    tail = simpson(a, f"{a} + {lit(NORMAL_SPAN)}", lambda x: f"exp(-({x} * {x}) / 2.0)")
    return f"least(1.0, greatest(0.0, {tail} * {lit(2.0 / math.sqrt(2.0 * math.pi))}))"


def student_p(t: str, df: str) -> str:
    root = f"sqrt({df})"
    theta0 = f"atan(abs({t}) / {root})"
    tmax = f"(CASE WHEN {df} <= 30 THEN {lit(math.pi / 2)} ELSE atan({lit(T_CUTOFF)} / {root}) END)"
    dens = lambda th: f"pow(cos({th}), {df} - 1.0)"
    upper = f"(CASE WHEN {theta0} >= {tmax} THEN 0.0 ELSE {simpson(theta0, tmax, dens)} END)"
    whole = simpson("0.0", tmax, dens)
    return f"least(1.0, greatest(0.0, {upper} / {whole}))"


# ---------------------------------------------------------------- base layer
USER_COLS = ["user_id", "user_name", "signup_date", "acquisition_channel", "city", "device_type", "age", "gender",
             "profession", "income_bracket", "is_subscriber", "ab_test_group"]
ORDER_COLS = ["order_id", "user_id", "restaurant_id", "delivery_partner_id", "order_placed_time", "order_accepted_time",
              "promised_delivery_time", "ready_time", "pickup_time", "delivered_time", "order_status", "cancel_reason",
              "items_count", "order_value", "discount_amount", "delivery_fee", "delivery_cost_to_rider",
              "payment_gateway_fee", "commission_rate", "payment_method", "payment_status", "distance_km",
              "refund_amount", "rating", "complaint_flag", "wrong_item_flag", "is_promo_used", "is_scheduled_order",
              "ab_test_group", "device_type", "city"]
TS_COLS = ["order_placed_time", "order_accepted_time", "promised_delivery_time", "ready_time", "pickup_time",
           "delivered_time"]
FLAG_COLS = ["complaint_flag", "wrong_item_flag", "is_promo_used", "is_scheduled_order"]
NPS_COLS = ["response_id", "user_id", "response_date", "nps_score"]


def dedup(table: str, key: str, cols: list[str]) -> str:
    order = ", ".join(f"{c} ASC NULLS LAST" for c in cols if c != key)
    return (f"SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {order}) AS _rn "
            f"FROM {table}) WHERE _rn = 1")


def age_band(x: str) -> str:
    return (f"CASE WHEN {x} < 25 THEN '18-24' WHEN {x} < 35 THEN '25-34' WHEN {x} < 45 THEN '35-44' "
            f"WHEN {x} < 55 THEN '45-54' ELSE '55+' END")


def _orders_d_select() -> str:
    cols = []
    for c in ORDER_COLS:
        if c in TS_COLS:
            cols.append(f"try_cast({c} AS TIMESTAMP) AS {c}")
        elif c == "payment_method":
            cols.append(f"{tc(c)} AS {c}")
        elif c == "delivery_fee":
            cols.append(f"abs({c}) AS {c}")
        else:
            cols.append(c)
    return ", ".join(cols)


def _orders_c_select() -> str:
    cols = []
    for c in ORDER_COLS:
        if c == "order_value":
            cols.append("CASE WHEN order_value > f.upper_fence THEN f.upper_fence ELSE order_value END AS order_value")
        elif c in FLAG_COLS:
            cols.append(f"try_cast({c} AS BIGINT) <> 0 AS {c}")
        else:
            cols.append(c)
    cols += ["cast(order_placed_time AS DATE) AS order_date", "strftime(order_placed_time, '%Y-%m') AS order_month"]
    return ", ".join(cols)


BASE_CTES = [
    ("raw_users", duckdb_sql("users")),
    ("raw_restaurants", duckdb_sql("restaurants")),
    ("raw_orders", duckdb_sql("orders")),
    ("raw_events", duckdb_sql("events")),
    ("raw_nps", duckdb_sql("nps")),
    ("users_d", dedup("raw_users", "user_id", USER_COLS)),
    ("users_c0", f"""SELECT user_id, user_name,
        coalesce(try_strptime(signup_date, '%Y-%m-%d')::DATE, try_strptime(signup_date, '%d/%m/%Y')::DATE) AS signup_date,
        acquisition_channel, {tc(strip('city'))} AS city, coalesce(device_type, 'Unknown') AS device_type,
        coalesce(cast(age AS DOUBLE), (SELECT median(cast(age AS DOUBLE)) FROM users_d)) AS age,
        coalesce({tc(strip('gender'))}, 'Unknown') AS gender,
        coalesce({tc(strip('profession'))}, 'Unknown') AS profession,
        coalesce(income_bracket, 'Unknown') AS income_bracket,
        try_cast(is_subscriber AS BIGINT) <> 0 AS is_subscriber, ab_test_group
        FROM users_d"""),
    ("users_c", f"SELECT *, {age_band('age')} AS age_group FROM users_c0"),
    ("orders_d", f"SELECT {_orders_d_select()} FROM ({dedup('raw_orders', 'order_id', ORDER_COLS)}) WHERE order_value IS NOT NULL"),
    ("ov", "SELECT order_value AS v, row_number() OVER (ORDER BY order_value) AS rn, count(*) OVER () AS n FROM orders_d"),
    ("fence", "SELECT q1, q3, q3 + 1.5 * (q3 - q1) AS upper_fence FROM ("
              "SELECT max(CASE WHEN rn = floor(cast(n - 1 AS DOUBLE) * 0.25 + 0.5) + 1 THEN v END) AS q1, "
              "max(CASE WHEN rn = floor(cast(n - 1 AS DOUBLE) * 0.75 + 0.5) + 1 THEN v END) AS q3 FROM ov)"),
    ("orders_c", f"SELECT {_orders_c_select()} FROM orders_d CROSS JOIN (SELECT upper_fence FROM fence) f"),
    ("events_c", "SELECT DISTINCT * FROM raw_events"),
    ("nps_c", f"SELECT response_id, user_id, try_cast(response_date AS DATE) AS response_date, nps_score "
              f"FROM ({dedup('raw_nps', 'response_id', NPS_COLS)}) WHERE nps_score BETWEEN 0 AND 10"),
    ("restaurants_c", "SELECT * FROM raw_restaurants"),
]


def q(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    ctes = BASE_CTES + (extra or [])
    return "WITH " + ",\n".join(f"{name} AS (\n{sql}\n)" for name, sql in ctes) + "\n" + body


# ---------------------------------------------------------------- filters
def inlist(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


SLICE = {
    "cuisines": ["Italian", "Bakery"], "dates": ("1997-01-01", "1998-12-31"), "devices": ["Android"],
    "ab_groups": ["Treatment"], "cities": ["NATION_3", "NATION_7"], "genders": ["Female"],
    "professions": ["Student", "Self-Employed"], "income_brackets": ["Mid (3-8L)", "High (8-15L)"],
    "age_groups": ["25-34", "35-44"],
}
ORDER_SLICE_COLUMNS = ["order_id", "user_id", "restaurant_id", "city", "device_type", "ab_test_group", "order_date",
                       "order_status", "order_value"]


def slice_ctes(prefix: str, cuisines=None, dates=None, cities=None, devices=None, ab_groups=None,
               channels=None, genders=None, professions=None, income_brackets=None, age_groups=None) -> list[tuple[str, str]]:
    """CTEs {prefix}_orders/_users/_events/_nps for a filter selection (same cascade as the engine)."""
    conds = []
    if cuisines:
        conds.append(f"restaurant_id IN (SELECT restaurant_id FROM restaurants_c WHERE cuisine_type IN {inlist(cuisines)})")
    if dates:
        conds.append(f"order_date BETWEEN DATE '{dates[0]}' AND DATE '{dates[1]}'")
    for col, vals in (("city", cities), ("device_type", devices), ("ab_test_group", ab_groups)):
        if vals:
            conds.append(f"{col} IN {inlist(vals)}")
    uconds = [f"{col} IN {inlist(vals)}" for col, vals in (
        ("acquisition_channel", channels), ("gender", genders), ("profession", professions),
        ("income_bracket", income_brackets), ("age_group", age_groups)) if vals]
    users0 = "SELECT * FROM users_c" + (" WHERE " + " AND ".join(uconds) if uconds else "")
    if uconds:
        conds.append(f"user_id IN (SELECT user_id FROM {prefix}_users0)")
    orders = "SELECT * FROM orders_c" + (" WHERE " + " AND ".join(conds) if conds else "")
    remaining = f"(SELECT DISTINCT user_id FROM {prefix}_orders)"
    return [(f"{prefix}_users0", users0), (f"{prefix}_orders", orders),
            (f"{prefix}_users", f"SELECT * FROM {prefix}_users0 WHERE user_id IN {remaining}"),
            (f"{prefix}_events", f"SELECT * FROM events_c WHERE user_id IN {remaining}"),
            (f"{prefix}_nps", f"SELECT * FROM nps_c WHERE user_id IN {remaining}")]


OPTION_DIMENSIONS = [("cities", "orders_c", "city"), ("cuisines", "restaurants_c", "cuisine_type"),
                     ("channels", "users_c", "acquisition_channel"), ("devices", "orders_c", "device_type"),
                     ("ab_groups", "orders_c", "ab_test_group"), ("genders", "users_c", "gender"),
                     ("professions", "users_c", "profession"), ("income_brackets", "users_c", "income_bracket"),
                     ("age_groups", "users_c", "age_group")]


def filter_options_sql() -> str:
    parts = ["SELECT 'date_min' AS dimension, cast(min(order_date) AS VARCHAR) AS value FROM orders_c",
             "SELECT 'date_max' AS dimension, cast(max(order_date) AS VARCHAR) AS value FROM orders_c"]
    parts += [f"SELECT DISTINCT '{n}' AS dimension, cast({c} AS VARCHAR) AS value FROM {t} WHERE {c} IS NOT NULL"
              for n, t, c in OPTION_DIMENSIONS]
    return q("\nUNION ALL\n".join(parts))


def order_slice_sql(**spec) -> str:
    return q(f"SELECT {', '.join(ORDER_SLICE_COLUMNS)} FROM s_orders", slice_ctes("s", **spec))


def population_sql(**spec) -> str:
    parts = [f"SELECT '{name}' AS table_name, count(*) AS rows, cast(coalesce(sum({key}), 0) AS BIGINT) AS key_sum, "
             f"{nu('user_id')} AS distinct_users FROM s_{name}"
             for name, key in (("orders", "order_id"), ("users", "user_id"), ("events", "event_id"), ("nps", "response_id"))]
    return q("\nUNION ALL\n".join(parts), slice_ctes("s", **spec))


def scope_sql(**spec) -> str:
    return q("SELECT (SELECT count(*) FROM s_orders) AS orders, (SELECT count(*) FROM s_users) AS users, true AS filtered",
             slice_ctes("s", **spec))


# ---------------------------------------------------------------- KPI families over (o, u, e, n, r)
def user_roll(o: str) -> str:
    return f"""SELECT user_id, sum(n) AS n_orders, min(order_date) AS first_order_date, max(order_date) AS last_order_date,
      {nu("strftime(order_date, '%Y-%m')")} AS active_months, sum(monetary) AS monetary, sum(ltv) AS ltv,
      coalesce(max(sched), 0) AS has_scheduled,
      max(cast(date_diff('day', f, order_date) BETWEEN 1 AND 7 AS INT)) AS retained_d7,
      max(cast(date_diff('day', f, order_date) BETWEEN 1 AND 30 AS INT)) AS retained_d30
    FROM (SELECT *, min(order_date) OVER (PARTITION BY user_id) AS f FROM (
      SELECT user_id, order_date, count(*) AS n, {msum('order_value')} AS monetary,
             coalesce(sum({NET_REV}), 0) AS ltv, max(cast(is_scheduled_order AS INT)) AS sched
      FROM {o} GROUP BY user_id, order_date))
    GROUP BY user_id"""


def acquisition_parts(o: str, u: str) -> str:
    return f"""SELECT b.n_users, b.n_order_users, t.avg_ttfo, mo.months_covered,
      {lit(50000.0)} * mo.months_covered / b.n_order_users AS cac
    FROM (SELECT (SELECT count(*) FROM {u}) AS n_users, (SELECT {nu('user_id')} FROM {o}) AS n_order_users) b,
      (SELECT {avg('d')} AS avg_ttfo FROM (SELECT date_diff('day', uu.signup_date, r.first_order_date) AS d
        FROM {u} uu JOIN ({user_roll(o)}) r ON uu.user_id = r.user_id) WHERE d >= 0) t,
      (SELECT {nu("strftime(signup_date, '%Y-%m')")} AS months_covered FROM {u}) mo"""


def kpi_acquisition(o="orders_c", u="users_c", e="events_c", n="nps_c", r="restaurants_c", **_) -> str:
    return f"""SELECT {pct('n_order_users', 'n_users')} AS activation_rate, avg_ttfo, cac FROM ({acquisition_parts(o, u)})"""


def kpi_engagement(o="orders_c", u="users_c", e="events_c", n="nps_c", r="restaurants_c", **_) -> str:
    def active(period: str) -> str:
        return f"(SELECT {avg('a')} AS v FROM (SELECT {period} AS p, {nu('user_id')} AS a FROM {o} GROUP BY {period}))"

    return f"""SELECT dau.v AS avg_dau, wau.v AS avg_wau, mau.v AS avg_mau, dau.v / mau.v * 100 AS stickiness,
      opu.v AS orders_per_user, sf.v AS avg_session_frequency, sd.v AS avg_session_duration_sec
    FROM {active('order_date')} dau, {active("strftime(order_date, '%Y-W%V')")} wau, {active('order_month')} mau,
      (SELECT {ratio('count(*)', nu('user_id'))} AS v FROM {o}) opu,
      (SELECT {avg('s')} AS v FROM (SELECT user_id, {nu('session_id')} AS s FROM {e} GROUP BY user_id)) sf,
      (SELECT {avg('d')} AS v FROM (SELECT session_id, date_sub('second', min(event_time), max(event_time)) AS d
        FROM {e} GROUP BY session_id)) sd"""


def stage_counts(e: str) -> str:
    return f"SELECT event_name, {nu('session_id')} AS sessions FROM {e} GROUP BY event_name"


def kpi_conversion(o="orders_c", u="users_c", e="events_c", n="nps_c", r="restaurants_c", **_) -> str:
    stages = ", ".join(f"coalesce(max(CASE WHEN event_name = '{s}' THEN sessions END), 0) AS {s}"
                       for s in ("menu_view", "add_to_cart", "checkout_started"))
    return f"""SELECT {pct0('n_orders', 'total_sessions')} AS visitor_to_order_conv,
      {pct0('add_to_cart', 'menu_view')} AS menu_to_cart_rate,
      CASE WHEN add_to_cart = 0 THEN 0.0 ELSE (1 - {dbl('checkout_started')} / {dbl('add_to_cart')}) * 100 END AS cart_abandonment,
      {pct('n_delivered', 'n_orders')} AS order_completion_rate
    FROM (SELECT count(*) AS n_orders, {cnt(DELIVERED)} AS n_delivered FROM {o}) b,
      (SELECT {stages} FROM ({stage_counts(e)})) s,
      (SELECT {nu('session_id')} AS total_sessions FROM {e}) t"""


def revenue_parts(o: str, u: str) -> str:
    return f"""SELECT (SELECT count(*) FROM {u}) AS n_users, (SELECT count(*) FROM {o}) AS n_orders,
      (SELECT {nu('user_id')} FROM {o}) AS n_order_users, d.*,
      {td('d.g')} AS gmv, {td('d.c + d.f')} AS platform, {td('d.g')} / d.nv AS aov,
      {td('d.mg')} / d.nm AS avg_contribution_margin
    FROM (SELECT {msum('order_value')} AS g, coalesce(sum({COMMISSION}), 0) AS c, {msum('delivery_fee')} AS f,
      sum({NET_REV}) AS mg, count({NET_REV}) AS nm, count(order_value) AS nv FROM {o} WHERE {DELIVERED}) d"""


def kpi_revenue(o="orders_c", u="users_c", e="events_c", n="nps_c", r="restaurants_c", **_) -> str:
    return f"""SELECT gmv, aov, platform / n_users AS arpu, platform / n_order_users AS arppu,
      {td('c')} / gmv * 100 AS take_rate, avg_contribution_margin FROM ({revenue_parts(o, u)})"""


def kpi_retention(o="orders_c", u="users_c", e="events_c", n="nps_c", r="restaurants_c", **_) -> str:
    d30 = f"({dbl('d30n')} / {dbl('n_users')} * 100)"
    avg_ltv = f"({td('ltv')} / {dbl('customers')})"
    retained = f"""(SELECT user_id FROM {o} GROUP BY user_id HAVING {nu("strftime(order_date, '%Y-%m')")} >= 2)"""
    return f"""SELECT {pct('d7n', 'n_users')} AS d7, {d30} AS d30, 100 - {d30} AS churn_d30,
      {pct('rep', 'customers')} AS repeat_rate,
      CASE WHEN ret_users = 0 THEN 0.0 ELSE {ratio('ret_orders', 'ret_users')} END AS order_frequency_retained,
      {avg_ltv} AS avg_ltv, {avg_ltv} / cac AS ltv_cac_ratio,
      CASE WHEN resp = 0 THEN 0.0 ELSE ({dbl('prom')} / {dbl('resp')} - {dbl('detr')} / {dbl('resp')}) * 100 END AS nps_score
    FROM (SELECT n_users, cac FROM ({acquisition_parts(o, u)})) a,
      (SELECT count(DISTINCT CASE WHEN days BETWEEN 1 AND 7 THEN user_id END) AS d7n,
              count(DISTINCT CASE WHEN days BETWEEN 1 AND 30 THEN user_id END) AS d30n
       FROM (SELECT x.user_id, date_diff('day', f.first_day, x.order_date) AS days FROM {o} x
             JOIN (SELECT user_id, min(order_date) AS first_day FROM {o} GROUP BY user_id) f ON x.user_id = f.user_id)) back,
      (SELECT {cnt('c >= 2')} AS rep, count(*) AS customers FROM (SELECT user_id, count(DISTINCT order_id) AS c FROM {o} GROUP BY user_id)) cust,
      (SELECT (SELECT count(*) FROM {o} WHERE user_id IN (SELECT user_id FROM {retained})) AS ret_orders,
              (SELECT count(*) FROM {retained}) AS ret_users
       FROM (SELECT 1)) kept,
      (SELECT sum(ltv) AS ltv FROM ({user_roll(o)})) r,
      (SELECT {cnt('nps_score >= 9')} AS prom, {cnt('nps_score <= 6')} AS detr, count(*) AS resp FROM {n}) p"""


def kpi_operations(o="orders_c", u="users_c", e="events_c", n="nps_c", r="restaurants_c", **_) -> str:
    dmin = "date_sub('minute', order_placed_time, delivered_time)"
    pmin = "date_sub('minute', order_accepted_time, ready_time)"
    on_time = "cast(delivered_time <= promised_delivery_time AS INT)"
    wrong = "cast(wrong_item_flag AS INT)"
    return f"""SELECT {pct('cancelled', 'n')} AS cancellation_rate, avg_delivery_time, ontime * 100 AS on_time_rate,
      avg_prep_time, (1 - wrong) * 100 AS order_accuracy_rate, {td('rider')} / {dbl('nd')} AS cost_per_delivery
    FROM (SELECT {cnt("order_status = 'Cancelled'")} AS cancelled, count(*) AS n FROM {o}) a,
      (SELECT {avg(dmin)} AS avg_delivery_time, {avg(on_time)} AS ontime, {avg(pmin)} AS avg_prep_time,
        {avg(wrong)} AS wrong, {msum('delivery_cost_to_rider')} AS rider, count(*) AS nd FROM {o} WHERE {DELIVERED}) d"""


def kpi_marketplace(o="orders_c", u="users_c", e="events_c", n="nps_c", r="restaurants_c", split="2001-05-01", **_) -> str:
    h1 = f"order_date < DATE '{split}'"
    return f"""SELECT active_restaurants, total_restaurants, {ratio('nd', 'active_restaurants')} AS restaurant_utilization,
      {pct0('lost', 'h1')} AS restaurant_churn_rate, overall_avg_rating, {td('top')} / {td('gmv')} * 100 AS top10_share
    FROM (SELECT {nu('restaurant_id')} AS active_restaurants, {cnt(DELIVERED)} AS nd,
        {avg(f"CASE WHEN {DELIVERED} THEN rating END")} AS overall_avg_rating,
        coalesce(sum(CASE WHEN {DELIVERED} THEN {money('order_value')} END), 0) AS gmv FROM {o}) a,
      (SELECT {nu('restaurant_id')} AS total_restaurants FROM {r}) t,
      (SELECT {cnt('in_h1 = 1')} AS h1, {cnt('in_h1 = 1 AND in_h2 = 0')} AS lost FROM (
        SELECT restaurant_id, max(CASE WHEN {h1} THEN 1 ELSE 0 END) AS in_h1, max(CASE WHEN {h1} THEN 0 ELSE 1 END) AS in_h2
        FROM {o} GROUP BY restaurant_id)) h,
      (SELECT coalesce(sum(g), 0) AS top FROM (SELECT restaurant_id, {msum('order_value')} AS g FROM {o}
        WHERE {DELIVERED} GROUP BY restaurant_id ORDER BY g DESC, restaurant_id ASC LIMIT 10)) k"""


def kpi_product(o="orders_c", u="users_c", e="events_c", n="nps_c", r="restaurants_c", **_) -> str:
    return f"""SELECT {pct('sched', 'active')} AS scheduled_order_adoption, {pct('subs', 'active')} AS subscriber_adoption,
      {pct('promo', 'n')} AS promo_dependency, avg_basket_size
    FROM (SELECT {nu('user_id')} AS active, {cnt('is_promo_used')} AS promo, count(*) AS n,
        {avg('items_count')} AS avg_basket_size FROM {o}) a,
      (SELECT {nu('user_id')} AS sched FROM {o} WHERE is_scheduled_order) s,
      (SELECT count(*) AS subs FROM {u} WHERE is_subscriber AND user_id IN (SELECT user_id FROM {o})) b"""


def kpi_clv(o="orders_c", u="users_c", e="events_c", n="nps_c", r="restaurants_c", **_) -> str:
    years = f"greatest({dbl('days')} / {lit(365.25)}, {lit(1 / 365.25)})"
    return f"""SELECT aov * ({ratio('n_orders', 'n_order_users')} / {years}) * (avg_contribution_margin / aov) * {lit(2.0)}
        AS clv_formulaic, {lit(2.0)} AS assumed_lifespan_years
    FROM ({revenue_parts(o, u)}) rv, (SELECT date_diff('day', min(order_date), max(order_date)) AS days FROM {o}) sp"""


def ab_stats(o: str) -> str:
    wide = "cast(order_value AS DECIMAL(38,4))"  # squares need more than 18 digits
    aggs = []
    for p, g in (("c", "Control"), ("t", "Treatment")):
        grp = f"ab_test_group = '{g}'"
        dv = f"{grp} AND {DELIVERED}"
        aggs += [f"{cnt(grp)} AS {p}_n", f"{cnt(dv)} AS {p}_x",
                 f"count(CASE WHEN {dv} THEN order_value END) AS {p}_k",
                 f"coalesce(sum(CASE WHEN {dv} THEN {money('order_value')} END), 0) AS {p}_s1",
                 f"coalesce(sum(CASE WHEN {dv} THEN {wide} * {wide} END), 0) AS {p}_s2"]
    mean = {p: f"({td(f'{p}_s1')} / {p}_k)" for p in "ct"}
    var = {p: f"(({td(f'{p}_s2')} - {td(f'{p}_s1')} * {td(f'{p}_s1')} / {p}_k) / ({p}_k - 1))" for p in "ct"}
    sa, sb = f"({var['t']} / t_k)", f"({var['c']} / c_k)"
    se2 = f"({sa} + {sb})"
    t = f"(CASE WHEN {se2} > 0 THEN ({mean['t']} - {mean['c']}) / sqrt({se2}) END)"
    dof = f"(CASE WHEN {se2} > 0 THEN ({se2} * {se2}) / ({sa} * {sa} / (t_k - 1) + {sb} * {sb} / (c_k - 1)) END)"
    p1, p2 = f"({dbl('c_x')} / c_n)", f"({dbl('t_x')} / t_n)"
    pool = f"({dbl('c_x + t_x')} / (c_n + t_n))"
    se = (f"(CASE WHEN {pool} > 0 AND {pool} < 1 THEN sqrt({pool} * (1 - {pool}) * (1 / {dbl('c_n')} + 1 / {dbl('t_n')})) "
          f"ELSE 0.0 END)")
    z = f"(CASE WHEN {se} <> 0 THEN ({p2} - {p1}) / {se} ELSE 0.0 END)"
    return f"""SELECT (c_n > 0 AND t_n > 0 AND c_k >= 2 AND t_k >= 2) AS ab_available, {p1} AS p1, {p2} AS p2,
        z, CASE WHEN {se} <> 0 THEN {normal_p('z')} ELSE 1.0 END AS p_completion,
        {mean['c']} AS control_mean, {mean['t']} AS treat_mean, t, df,
        CASE WHEN {se2} > 0 THEN {student_p('t', 'df')} END AS p_aov
      FROM (SELECT *, {z} AS z, {t} AS t, {dof} AS df FROM (SELECT {', '.join(aggs)} FROM {o}))"""


def kpi_ab_test(o="orders_c", **_) -> str:
    def g(x: str, name: str) -> str:
        return f"CASE WHEN ab_available THEN {x} END AS {name}"

    return f"""SELECT ab_available, {g('p1', 'ab_p1')}, {g('p2', 'ab_p2')}, {g('round(p_completion, 10)', 'ab_p_value_completion')},
      {g('control_mean', 'ab_control_aov_mean')}, {g('treat_mean', 'ab_treat_aov_mean')},
      {g('round(p_aov, 10)', 'ab_p_value_aov')} FROM ({ab_stats(o)})"""


def p_text(p: str) -> str:
    return f"CASE WHEN {p} < 0.0001 THEN '< 0.0001' ELSE printf('%.4f', round({p}, 4)) END"


def ab_verdict_sql() -> str:
    sig = "(ab_p_value_completion < 0.05 AND ab_p_value_aov < 0.05)"
    return q(f"""SELECT ab_available, {p_text('ab_p_value_completion')} AS completion_p_text,
      {p_text('ab_p_value_aov')} AS aov_p_text, CASE WHEN ab_available THEN {sig} END AS both_significant,
      CASE WHEN NOT ab_available THEN 'not available' WHEN {sig} THEN 'significant lift on both metrics'
           ELSE 'not all metrics significant' END AS verdict
    FROM ({kpi_ab_test()})""")


DEMO_KPI_PREFIX = {"gender": "top_gender", "profession": "top_profession", "income_bracket": "top_income",
                   "age_group": "top_age_group"}


def demo_breakdown(dim: str, o="orders_c", u="users_c") -> str:
    return f"""SELECT {dim}, {nu('user_id')} AS users, count(*) AS orders, {td(msum('order_value'))} AS gmv,
      round({td(msum('order_value'))} / count(order_value), 2) AS aov
    FROM (SELECT oo.user_id, oo.order_value, uu.{dim} FROM {o} oo JOIN {u} uu ON oo.user_id = uu.user_id
      WHERE oo.{DELIVERED}) GROUP BY {dim}"""


def kpi_demographics(o="orders_c", u="users_c", **_) -> str:
    cols, froms = [], [f"(SELECT {msum('order_value')} AS total FROM {o} WHERE {DELIVERED}) tt"]
    for dim, prefix in DEMO_KPI_PREFIX.items():
        froms.append(f"(SELECT max(k) AS {prefix}, max(g) AS _{prefix} FROM (SELECT {dim} AS k, gmv AS g FROM "
                     f"({demo_breakdown(dim, o, u)}) ORDER BY gmv DESC, {dim} ASC LIMIT 1)) x_{prefix}")
        share = f"CASE WHEN {td('total')} = 0 THEN 0.0 ELSE _{prefix} / {td('total')} * 100 END"
        cols += [prefix, f"CASE WHEN {prefix} IS NOT NULL THEN {share} END AS {prefix}_gmv_share"]
    return f"SELECT {', '.join(cols)} FROM {', '.join(froms)}"


FAMILIES = {
    "acquisition": (kpi_acquisition, ["activation_rate", "avg_ttfo", "cac"]),
    "engagement": (kpi_engagement, ["avg_dau", "avg_wau", "avg_mau", "stickiness", "orders_per_user",
                                    "avg_session_frequency", "avg_session_duration_sec"]),
    "conversion": (kpi_conversion, ["visitor_to_order_conv", "menu_to_cart_rate", "cart_abandonment",
                                    "order_completion_rate"]),
    "revenue": (kpi_revenue, ["gmv", "aov", "arpu", "arppu", "take_rate", "avg_contribution_margin"]),
    "retention": (kpi_retention, ["d7", "d30", "churn_d30", "repeat_rate", "order_frequency_retained", "avg_ltv",
                                  "ltv_cac_ratio", "nps_score"]),
    "operations": (kpi_operations, ["cancellation_rate", "avg_delivery_time", "on_time_rate", "avg_prep_time",
                                    "order_accuracy_rate", "cost_per_delivery"]),
    "marketplace": (kpi_marketplace, ["active_restaurants", "total_restaurants", "restaurant_utilization",
                                      "restaurant_churn_rate", "overall_avg_rating", "top10_share"]),
    "product": (kpi_product, ["scheduled_order_adoption", "subscriber_adoption", "promo_dependency", "avg_basket_size"]),
    "clv": (kpi_clv, ["clv_formulaic", "assumed_lifespan_years"]),
    "ab_test": (kpi_ab_test, ["ab_available", "ab_p1", "ab_p2", "ab_p_value_completion", "ab_control_aov_mean",
                              "ab_treat_aov_mean", "ab_p_value_aov"]),
    "demographics": (kpi_demographics, [c for p in DEMO_KPI_PREFIX.values() for c in (p, f"{p}_gmv_share")]),
}
TEXT_KPIS = set(DEMO_KPI_PREFIX.values())


def kpi_all_sql() -> str:
    parts = []
    for family, (fn, cols) in FAMILIES.items():
        for c in cols:
            if c in TEXT_KPIS:
                value, text = "cast(NULL AS DOUBLE)", c
            else:
                value, text = f"cast({c} AS DOUBLE)", "cast(NULL AS VARCHAR)"
            parts.append(f"SELECT '{family}' AS family, '{c}' AS kpi, {value} AS value, {text} AS value_text FROM f_{family}")
    extra = [(f"f_{family}", fn()) for family, (fn, _) in FAMILIES.items()]
    return q("\nUNION ALL\n".join(parts), extra)


def kpi_filtered_sql() -> str:
    ctes = slice_ctes("s", cuisines=SLICE["cuisines"], dates=SLICE["dates"], genders=SLICE["genders"])
    tables = dict(o="s_orders", u="s_users", e="s_events", n="s_nps")
    return q(f"SELECT * FROM ({kpi_revenue(**tables)}) CROSS JOIN ({kpi_retention(**tables)})", ctes)


# ---------------------------------------------------------------- dirty money
DIRTY_ORDERS = """SELECT * REPLACE (
    CASE order_id % 1009 WHEN 3 THEN cast(12 AS DOUBLE) WHEN 9 THEN cast(20000 AS DOUBLE) ELSE commission_rate END AS commission_rate,
    CASE WHEN order_id % 1009 = 5 THEN cast(1e15 AS DOUBLE) ELSE delivery_fee END AS delivery_fee,
    CASE WHEN order_id % 1009 = 7 THEN cast('nan' AS DOUBLE) ELSE discount_amount END AS discount_amount,
    CASE WHEN order_id % 1009 = 11 THEN cast('inf' AS DOUBLE) ELSE delivery_cost_to_rider END AS delivery_cost_to_rider,
    CASE WHEN (order_id % 1009) % 11 = 1 THEN cast(1.234567 AS DOUBLE) ELSE payment_gateway_fee END AS payment_gateway_fee)
  FROM orders_c"""


def dirty_money_sql() -> str:
    of = [f"({fn(o='orders_x')})" for fn in (kpi_revenue, kpi_retention, kpi_clv)]
    return q(f"SELECT * FROM {' CROSS JOIN '.join(of)}", [("orders_x", DIRTY_ORDERS)])


def money_quality_sql() -> str:
    def of(c: str, kind) -> str:
        return (f"SELECT '{c}' AS column_name, count(*) AS rows, cast({cnt(f'{c} IS NULL')} AS BIGINT) AS missing, "
                f"cast({cnt(f'{c} IS NOT NULL AND {kind(c)} IS NULL')} AS BIGINT) AS rejected, "
                f"cast({cnt(f'{money(c)} < 0')} AS BIGINT) AS negative FROM orders_x")

    amounts = ["order_value", "discount_amount", "delivery_fee", "delivery_cost_to_rider", "payment_gateway_fee", "refund_amount"]
    return q("\nUNION ALL\n".join([*[of(c, money) for c in amounts], of("commission_rate", rate)]), [("orders_x", DIRTY_ORDERS)])


# ---------------------------------------------------------------- charts
def chart_sql() -> dict[str, str]:
    d = f"SELECT * FROM orders_c WHERE {DELIVERED}"
    perf = lambda key, src: f"SELECT {key}, count(*) AS orders, cast(round({msum('order_value')}, 0) AS DOUBLE) AS gmv FROM ({src}) GROUP BY {key}"
    funnel = ", ".join(f"({i + 1}, '{s}')" for i, s in enumerate(
        ["app_open", "menu_view", "add_to_cart", "checkout_started", "payment_completed"]))
    cohort = f"""SELECT a.cohort_month, a.month_offset, a.active_users, s.cohort_size,
        {rpct('a.active_users', 's.cohort_size')} AS retention_pct
      FROM (SELECT cohort_month, month_offset, count(*) AS active_users FROM (
          SELECT m.user_id, strftime(u.signup_date, '%Y-%m') AS cohort_month,
            cast((year(m.ms) - year(u.signup_date)) * 12 + (month(m.ms) - month(u.signup_date)) AS INTEGER) AS month_offset
          FROM (SELECT DISTINCT user_id, date_trunc('month', order_date) AS ms FROM orders_c) m
          JOIN users_c u ON m.user_id = u.user_id) WHERE month_offset >= 0 GROUP BY cohort_month, month_offset) a
      JOIN (SELECT strftime(signup_date, '%Y-%m') AS cohort_month, count(*) AS cohort_size FROM users_c GROUP BY 1) s
        ON a.cohort_month = s.cohort_month"""
    bands = ["18-24", "25-34", "35-44", "45-54", "55+"]
    band_sum = lambda b: td(f"sum(CASE WHEN age_group = '{b}' THEN {money('ov')} END)")
    cross_cols = ", ".join(f'coalesce({band_sum(b)}, 0.0) AS "{b}"' for b in bands)
    return {
        "channel_acq": q(f"""SELECT acquisition_channel, new_users, {rpct('new_users', 'total')} AS share_pct
            FROM (SELECT acquisition_channel, count(*) AS new_users FROM users_c GROUP BY 1)
            CROSS JOIN (SELECT count(*) AS total FROM users_c)"""),
        "monthly_active": q(f"SELECT order_month, {nu('user_id')} AS mau FROM orders_c GROUP BY order_month"),
        "funnel_counts": q(f"""SELECT st.stage, st.event_name, coalesce(c.sessions, 0) AS sessions,
              {rpct('coalesce(c.sessions, 0)', 'tp')} AS conversion_from_top_pct
            FROM (VALUES {funnel}) st(stage, event_name)
            LEFT JOIN ({stage_counts('events_c')}) c ON c.event_name = st.event_name
            CROSS JOIN (SELECT CASE WHEN coalesce(max(sessions), 0) = 0 THEN 1 ELSE max(sessions) END AS tp
                        FROM ({stage_counts('events_c')}) WHERE event_name = 'app_open')"""),
        "gmv_trend": q(f"SELECT order_month, {td(msum('order_value'))} AS gmv FROM ({d}) GROUP BY order_month"),
        "gmv_trend_daily": q(f"SELECT order_date, {td(msum('order_value'))} AS gmv FROM ({d}) GROUP BY order_date"),
        "orders_trend_daily": q("SELECT order_date, count(*) AS orders FROM orders_c GROUP BY order_date"),
        "cancel_reasons": q("SELECT cancel_reason, count(*) AS count FROM orders_c WHERE order_status = 'Cancelled' GROUP BY 1"),
        "restaurant_gmv": q(f"SELECT restaurant_id, {td(msum('order_value'))} AS restaurant_gmv FROM ({d}) GROUP BY 1"),
        "restaurant_top10": q(f"""SELECT restaurant_id, {td('g')} AS restaurant_gmv, rank FROM (
            SELECT restaurant_id, g, row_number() OVER (ORDER BY g DESC, restaurant_id ASC) AS rank
            FROM (SELECT restaurant_id, {msum('order_value')} AS g FROM ({d}) GROUP BY 1)) WHERE rank <= 10"""),
        "cuisine_perf": q(perf("cuisine_type", f"SELECT dd.order_value, r.cuisine_type FROM ({d}) dd JOIN restaurants_c r ON dd.restaurant_id = r.restaurant_id")),
        "city_perf": q(perf("city", d)),
        "cohort_retention": q(cohort),
        "cohort_matrix": q("""SELECT c.cohort_month, m.month_offset, cr.retention_pct
            FROM (SELECT DISTINCT cohort_month FROM cr) c
            CROSS JOIN (SELECT cast(unnest(range(0, (SELECT max(month_offset) FROM cr) + 1)) AS INTEGER) AS month_offset) m
            LEFT JOIN cr ON cr.cohort_month IS NOT DISTINCT FROM c.cohort_month AND cr.month_offset = m.month_offset""", [("cr", cohort)]),
        "rating_dist": q(f"SELECT rating, count(*) AS count FROM ({d}) WHERE rating IS NOT NULL GROUP BY rating"),
        **{f"demo_{dim}": q(f"SELECT *, round(gmv / (SELECT sum(gmv) FROM d) * 100, 6) AS gmv_share FROM d", [("d", demo_breakdown(dim))])
           for dim in ("gender", "age_group", "profession", "income_bracket")},
        "gender_age_cross": q(f"""SELECT gender, {cross_cols} FROM (SELECT o.order_value AS ov, u.gender, u.age_group
            FROM ({d}) o JOIN users_c u ON o.user_id = u.user_id) GROUP BY gender"""),
        "users_by_gender": q("SELECT gender, count(*) AS users FROM users_c GROUP BY 1"),
        "users_by_profession": q("SELECT profession, count(*) AS users FROM users_c GROUP BY 1"),
        "users_by_income": q("SELECT income_bracket, count(*) AS users FROM users_c GROUP BY 1"),
        "unknown_share": q(f"""SELECT g AS gender_unknown_share, p AS profession_unknown_share, (g > 0.5 OR p > 0.5) AS mostly_unknown
            FROM (SELECT {avg("cast(gender = 'Unknown' AS INT)")} AS g, {avg("cast(profession = 'Unknown' AS INT)")} AS p FROM users_c)"""),
        "growth_trend": q(f"""SELECT 'GMV' AS metric, 'Daily' AS grain, cast(order_date AS VARCHAR) AS period, {td(msum('order_value'))} AS value FROM ({d}) GROUP BY order_date
            UNION ALL SELECT 'GMV', 'Monthly', order_month, {td(msum('order_value'))} FROM ({d}) GROUP BY order_month
            UNION ALL SELECT 'Orders', 'Daily', cast(order_date AS VARCHAR), cast(count(*) AS DOUBLE) FROM orders_c GROUP BY order_date
            UNION ALL SELECT 'Orders', 'Monthly', order_month, cast(count(*) AS DOUBLE) FROM orders_c GROUP BY order_month"""),
    }


# ---------------------------------------------------------------- RFM
def rfm_base() -> str:
    return f"""SELECT r.user_id, cast(date_diff('day', r.last_order_date, s.snap) AS INTEGER) AS recency_days,
        cast(r.n_orders AS BIGINT) AS frequency,
        r.monetary AS mdec, {td('r.monetary')} AS monetary
      FROM ({user_roll('orders_c')}) r CROSS JOIN (SELECT max(order_date) AS snap FROM orders_c) s"""


def bins(rank: str, n: str) -> str:
    b = f"greatest(least(5, {n}), 1)"
    return f"(CASE WHEN {n} <= 1 THEN 1 ELSE greatest(1, (({rank} - 1) * {b} + {n} - 2) // ({n} - 1)) END)"


def rfm_sql() -> str:
    frac = lambda s: f"(CASE WHEN nb > 1 THEN ({s} - 1) / {dbl('nb - 1')} ELSE 1.0 END)"
    rf, ff = frac("R_score"), frac("F_score")
    label = (f"CASE WHEN {rf} >= 0.75 AND {ff} >= 0.75 THEN 'Champions' "
             f"WHEN {rf} >= 0.75 AND {ff} <= 0.25 THEN 'New / Promising' "
             f"WHEN {rf} <= 0.25 AND {ff} >= 0.75 THEN 'At Risk (was loyal)' "
             f"WHEN {rf} <= 0.25 AND {ff} <= 0.25 THEN 'Lost / Hibernating' ELSE 'Regular' END")
    return f"""SELECT *, {label} AS segment_label FROM (
      SELECT user_id, recency_days, frequency, mdec, monetary,
        {bins('rr', 'n')} AS R_score, {bins('fr', 'n')} AS F_score, {bins('mr', 'n')} AS M_score, greatest(least(5, n), 1) AS nb
      FROM (SELECT *, row_number() OVER (ORDER BY recency_days DESC, user_id ASC) AS rr,
              row_number() OVER (ORDER BY frequency ASC, user_id ASC) AS fr,
              row_number() OVER (ORDER BY mdec ASC, user_id ASC) AS mr, count(*) OVER () AS n FROM ({rfm_base()})))"""


# ---------------------------------------------------------------- engine primitives
QUANTILES = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def primitives_sql() -> dict[str, str]:
    qrows = "\nUNION ALL\n".join(
        f"SELECT {lit(qv)} AS q, max(CASE WHEN rn = floor({dbl('n - 1')} * {lit(qv)} + 0.5) + 1 THEN v END) AS value FROM ovc"
        for qv in QUANTILES)
    quant = q(qrows, [("ovc", "SELECT order_value AS v, row_number() OVER (ORDER BY order_value) AS rn, count(*) OVER () AS n FROM orders_c")])
    welch = f"""SELECT 'completion_z' AS test, round(z, 8) AS statistic, cast(NULL AS DOUBLE) AS dof, round(p_completion, 10) AS p_value FROM s
      UNION ALL SELECT 'aov_welch', round(t, 8), round(df, 6), round(p_aov, 10) FROM s"""
    return {
        "ordinal_rank": q("SELECT order_id, order_value, row_number() OVER (ORDER BY order_value ASC, order_id ASC) AS rank FROM orders_c"),
        "quantile_nearest": quant,
        "equal_frequency_bins": q(f"""SELECT user_id, frequency, {bins('r', 'n')} AS bin FROM (
            SELECT user_id, frequency, row_number() OVER (ORDER BY frequency ASC, user_id ASC) AS r, count(*) OVER () AS n
            FROM (SELECT user_id, count(*) AS frequency FROM orders_c GROUP BY user_id))"""),
        "title_case": q(f"""SELECT DISTINCT source, raw_value, {tc('raw_value')} AS title FROM (
            SELECT 'city' AS source, city AS raw_value FROM raw_users
            UNION ALL SELECT 'gender', gender FROM raw_users
            UNION ALL SELECT 'profession', profession FROM raw_users
            UNION ALL SELECT 'payment_method', payment_method FROM raw_orders) WHERE raw_value IS NOT NULL"""),
        "week_key": q("""SELECT DISTINCT order_date, strftime(order_date, '%Y-W%V') AS week_key,
            strftime(order_date, '%G-W%V') AS iso_week_key FROM orders_c WHERE order_date IS NOT NULL"""),
        "welch_test": q(welch, [("s", ab_stats("orders_c"))]),
    }


# ---------------------------------------------------------------- registry
def oracle_sql() -> dict[str, str]:
    fam = {f"kpi_{name}": q(fn()) for name, (fn, _) in FAMILIES.items()}
    fam["kpi_marketplace"] = q(kpi_marketplace(split="2001-05-01"))
    out = {
        "clean_users": q("SELECT * FROM users_c"),
        "clean_orders": q("SELECT * FROM orders_c"),
        "clean_events": q("SELECT * FROM events_c"),
        "clean_nps": q("SELECT * FROM nps_c"),
        "order_value_fence": q("SELECT q1, q3, upper_fence FROM fence"),
        "filter_options": filter_options_sql(),
        "filter_cuisine": order_slice_sql(cuisines=SLICE["cuisines"]),
        "filter_date_range": order_slice_sql(dates=SLICE["dates"]),
        "filter_orders_in": order_slice_sql(devices=SLICE["devices"], ab_groups=SLICE["ab_groups"], cities=SLICE["cities"]),
        "filter_demographics": order_slice_sql(genders=SLICE["genders"], professions=SLICE["professions"],
                                               income_brackets=SLICE["income_brackets"], age_groups=SLICE["age_groups"]),
        "filter_population": population_sql(cuisines=SLICE["cuisines"], dates=SLICE["dates"]),
        "scope": scope_sql(cuisines=SLICE["cuisines"], dates=SLICE["dates"]),
        **fam,
        "kpi_filtered": kpi_filtered_sql(),
        "kpi_dirty_money": dirty_money_sql(),
        "money_quality": money_quality_sql(),
        "ab_verdict": ab_verdict_sql(),
        "kpi_all": kpi_all_sql(),
        "first_order_flag": q("""SELECT o.order_id, o.user_id, o.order_id = f.fid AS is_first_order FROM orders_c o
            LEFT JOIN (SELECT user_id, order_id AS fid FROM (SELECT user_id, order_id, row_number() OVER (
              PARTITION BY user_id ORDER BY order_placed_time ASC NULLS FIRST, order_id ASC NULLS FIRST) AS rn
              FROM orders_c) WHERE rn = 1) f ON o.user_id IS NOT DISTINCT FROM f.user_id"""),
        **chart_sql(),
        "rfm_scores": q("SELECT user_id, recency_days, frequency, monetary, R_score, F_score, M_score, segment_label FROM rfm",
                        [("rfm", rfm_sql())]),
        "segment_summary": q(f"""SELECT segment_label, count(*) AS users, round({td('sum(mdec)')} / count(mdec), 0) AS avg_spend,
            round({avg('recency_days')}, 0) AS avg_recency_days FROM rfm GROUP BY segment_label""", [("rfm", rfm_sql())]),
        **primitives_sql(),
    }
    return out
