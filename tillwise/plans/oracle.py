"""The same results as SQL for DuckDB, over views named like the test tables.

Written as plain joins with COUNT(DISTINCT ...) and NTILE, not in the shape of
the Spark plans.  Money is whole cents and ratios are rounded by integer
division, as in ``functions.numeric``.
"""

from __future__ import annotations

import re

# Fixed values, written out a second time so that a wrong one in the operators does not pass.
FEATURES = [
    "frequency",
    "monetary",
    "avg_order_value",
    "avg_review_score",
    "active_months",
    "avg_installments",
    "avg_freight_ratio",
    "unique_products",
    "gave_review",
    "max_order_value",
    "min_order_value",
]
SEGMENT_ACTIONS = {
    "Champions": "🏆 VIP loyalty programme + early access",
    "Loyal Customers": "🔄 Subscription model + referral incentives",
    "Potential Loyalists": "📈 Personalised recommendations + discounts",
    "New Customers": "👋 Onboarding campaign + first purchase offer",
    "At Risk": "⚠️ Win-back campaign + personalised discount",
    "Need Attention": "📧 Low-cost email reactivation",
}
CLUSTER_ACTIONS = {
    "High Value Active": "VIP loyalty programme + early access offers",
    "Loyal Regulars": "Subscription model + referral incentives",
    "Lapsed High Value": "Win-back campaign + personalised discount",
    "Churned Low Value": "Low-cost email reactivation only",
    "Occasional Buyers": "Category-based push notifications",
}
DEFAULT_ACTION = "Monitor and analyse further"


def m(c: str) -> str:
    """Cents to an amount."""
    return f"(({c})::DOUBLE / 100.0::DOUBLE)"


def ri(num: str, den: str, digits: int = 0) -> str:
    """round(num / den, digits) in units of the last digit."""
    size = f"((2 * abs(({num})::HUGEINT) * {10**digits} + ({den})::HUGEINT) // nullif(2 * ({den})::HUGEINT, 0))"
    return f"(CASE WHEN ({num}) < 0 THEN -{size} ELSE {size} END)"


def rr(num: str, den: str, digits: int = 0) -> str:
    return f"({ri(num, den, digits)}::DOUBLE / {10**digits}::DOUBLE)"


def day(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


def second(t: str) -> str:
    return f"strftime({t}, '%Y-%m-%d %H:%M:%S')"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lookup(col: str, pairs: dict[str, str]) -> str:
    cases = " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in pairs.items())
    return f"CASE {col} {cases} ELSE {quoted(DEFAULT_ACTION)} END"


# fixed values: labels and bounds of the segments
_SEGMENT = """CASE WHEN r_score + f_score + m_score >= 13 THEN 'Champions'
    WHEN r_score + f_score + m_score >= 10 THEN 'Loyal Customers'
    WHEN r_score + f_score + m_score >= 7 THEN 'Potential Loyalists'
    WHEN r_score >= 4 AND f_score + m_score <= 4 THEN 'New Customers'
    WHEN r_score <= 2 AND f_score + m_score >= 8 THEN 'At Risk'
    ELSE 'Need Attention' END"""

_CTES = {
    # ------------------------------------------------------------ raw tables
    "customers_raw": """SELECT c_custkey AS customer_id,
        CASE WHEN c_custkey % 5 = 4 THEN c_custkey - 1 ELSE c_custkey END AS customer_unique_id,
        n_name AS customer_city, r_name AS customer_state
        FROM customer JOIN nation ON c_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "orders_raw": """SELECT *, CASE WHEN order_status = 'delivered' THEN carrier
            + to_days(((order_id * 7 + customer_id) % 23)::INT) END AS arrived
        FROM (SELECT o_orderkey AS order_id, o_custkey AS customer_id,
            CASE o_orderstatus WHEN 'F' THEN 'delivered' WHEN 'O' THEN 'shipped'
                ELSE 'processing' END AS order_status,
            o_orderdate AS bought,
            CASE WHEN NOT (o_orderstatus = 'P' AND o_orderkey % 2 = 0)
                THEN o_orderdate + to_hours(o_orderkey % 48) END AS approved,
            CASE WHEN o_orderstatus IN ('O', 'F') THEN o_orderdate + to_hours(o_orderkey % 48)
                + to_days((o_custkey % 7)::INT) END AS carrier,
            o_orderdate + to_days(18) AS estimated
            FROM orders)""",
    "items_raw": """SELECT l_orderkey AS order_id, l_partkey AS product_id, l_suppkey AS seller_id,
        l_linenumber AS line, l_returnflag AS payment_type,
        round(l_extendedprice * 100)::BIGINT AS p,
        round(l_extendedprice * 100)::BIGINT * round(l_tax * 100)::BIGINT // 100 AS f
        FROM lineitem""",
    "reviews_once": """SELECT o_orderkey AS order_id,
        CASE WHEN o_orderpriority <> '5-LOW' THEN substr(o_orderpriority, 1, 1)::BIGINT
            WHEN o_totalprice < 250000 THEN 4 ELSE 5 END AS review_score
        FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED'""",
    "reviews_raw": """SELECT order_id, 0 AS review_seq,
            CASE WHEN review_score = 2 THEN 3 ELSE review_score END AS review_score FROM reviews_once
        UNION ALL SELECT order_id, 1, CASE review_score WHEN 2 THEN 2 ELSE 5 END
            FROM reviews_once WHERE review_score IN (2, 3)
        UNION ALL SELECT order_id, 2, 1 FROM reviews_once WHERE review_score = 2""",
    "products_raw": """SELECT p_partkey AS product_id,
        CASE WHEN lower(p_type) <> 'promo' THEN lower(p_type) END AS product_category_name,
        length(p_name) AS name_len, length(p_brand) AS brand_len, p_size AS size
        FROM part""",
    "category": """SELECT DISTINCT lower(p_type) AS product_category_name,
        'en_' || lower(p_type) AS product_category_name_english
        FROM part WHERE lower(p_type) <> 'small'""",
    # ------------------------------------------------------------ star tables
    "dim_customers": """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (
        PARTITION BY customer_unique_id ORDER BY customer_id) AS rn FROM customers_raw)
        WHERE rn = 1""",
    "dim_sellers": """SELECT s_suppkey AS seller_id, n_name AS seller_city, r_name AS seller_state
        FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "dim_products": """SELECT product_id, p.product_category_name,
        coalesce(product_category_name_english, 'unknown') AS english
        FROM products_raw p LEFT JOIN category c
        ON p.product_category_name = c.product_category_name""",
    "fact_orders": """SELECT *, floor((epoch_us(arrived) - epoch_us(estimated))
        / 86400000000.0)::BIGINT AS delay FROM orders_raw WHERE order_status = 'delivered'""",
    "fact_payments": """SELECT order_id, sum(c)::BIGINT AS pay,
        string_agg(payment_type, ',' ORDER BY q, payment_type) AS payment_types,
        max(inst)::BIGINT AS installments
        FROM (SELECT order_id, payment_type, min(line) AS q, sum(p + f) AS c,
            max(line + 1) AS inst FROM items_raw GROUP BY ALL) GROUP BY order_id""",
    "fact_reviews": """SELECT order_id, review_score FROM reviews_raw
        QUALIFY row_number() OVER (PARTITION BY order_id ORDER BY review_seq) = 1""",
    "ref": "SELECT max(bought)::DATE AS d FROM fact_orders",
    # ------------------------------------------------------------ views
    "rfm": """SELECT c.customer_unique_id, (SELECT d FROM ref) - max(o.bought)::DATE AS recency_days,
        count(DISTINCT o.order_id) AS frequency, sum(p.pay)::BIGINT AS c
        FROM dim_customers c JOIN fact_orders o ON c.customer_id = o.customer_id
        JOIN fact_payments p ON o.order_id = p.order_id GROUP BY 1""",
    "scored": """SELECT *,
        ntile(5) OVER (ORDER BY recency_days, customer_unique_id) AS r_score,
        ntile(5) OVER (ORDER BY frequency DESC, customer_unique_id) AS f_score,
        ntile(5) OVER (ORDER BY c DESC, customer_unique_id) AS m_score FROM rfm""",
    "segments": f"SELECT *, {_SEGMENT} AS segment FROM scored",
    "monthly": f"""SELECT date_trunc('month', o.bought)::DATE AS month,
        count(DISTINCT o.order_id) AS total_orders, count(DISTINCT o.customer_id) AS unique_customers,
        sum(p.pay)::BIGINT AS c, {ri("sum(p.pay)", "count(*)")} AS aov
        FROM fact_orders o JOIN fact_payments p ON o.order_id = p.order_id GROUP BY 1""",
    "churn_risk": """SELECT *, CASE WHEN days > 180 THEN 'High Risk' WHEN days > 90
        THEN 'Medium Risk' ELSE 'Low Risk' END AS churn_risk_label
        FROM (SELECT c.customer_unique_id, count(DISTINCT o.order_id) AS total_orders,
            sum(p.pay)::BIGINT AS c, max(o.bought)::DATE AS last,
            (SELECT d FROM ref) - max(o.bought)::DATE AS days
            FROM dim_customers c JOIN fact_orders o ON c.customer_id = o.customer_id
            JOIN fact_payments p ON o.order_id = p.order_id GROUP BY 1)""",
    "categories": f"""SELECT english AS category, count(DISTINCT o.order_id) AS total_orders,
        sum(p.pay)::BIGINT AS c, {ri("sum(p.pay)", "count(*)")} AS aov,
        {rr("sum(r.review_score)", "count(r.review_score)", 2)} AS avg_review_score
        FROM items_raw i JOIN dim_products d ON i.product_id = d.product_id
        JOIN fact_orders o ON i.order_id = o.order_id
        JOIN fact_payments p ON o.order_id = p.order_id
        LEFT JOIN fact_reviews r ON o.order_id = r.order_id GROUP BY 1""",
    "seller_figures": f"""SELECT s.seller_id, s.seller_city, s.seller_state,
        count(DISTINCT o.order_id) AS total_orders,
        {rr("sum(o.delay)", "count(o.delay)", 1)} AS avg_delay_days,
        {rr("sum(r.review_score)", "count(r.review_score)", 2)} AS avg_review_score,
        sum(CASE WHEN o.delay > 0 THEN 1 ELSE 0 END)::BIGINT AS late_deliveries,
        {rr("sum(CASE WHEN o.delay > 0 THEN 1 ELSE 0 END) * 100", "count(DISTINCT o.order_id)", 1)}
            AS late_pct
        FROM dim_sellers s JOIN items_raw i ON s.seller_id = i.seller_id
        JOIN fact_orders o ON i.order_id = o.order_id
        LEFT JOIN fact_reviews r ON o.order_id = r.order_id
        GROUP BY 1, 2, 3 HAVING count(DISTINCT o.order_id) >= 50""",
    "seller_rated": """SELECT *, CASE WHEN late_pct >= 50 THEN 'High Risk' WHEN late_pct >= 25
        THEN 'Medium Risk' ELSE 'Good' END AS rating FROM seller_figures""",
    "segment_figures": f"""SELECT segment, count(*) AS customer_count,
        {ri("sum(c)", "count(*)")}::BIGINT AS avg_c, sum(c)::BIGINT AS c FROM segments GROUP BY 1""",
    "churn_figures": f"""SELECT churn_risk_label, count(*) AS customer_count,
        {ri("sum(c)", "count(*)")}::BIGINT AS avg_c FROM churn_risk GROUP BY 1""",
    "growth": """SELECT month, c, (c::DOUBLE / 100 / (nullif(lag(c) OVER (ORDER BY month), 0)::DOUBLE
        / 100) - 1) * 100 AS g FROM monthly""",
    "revenue_row": f"""SELECT {m("sum(c)")} AS total_rev, {m(ri("sum(c)", "count(*)"))} AS avg_rev,
        count(*) AS n_months, first(month ORDER BY c DESC, month) AS max_month,
        {m("max(c)")} AS max_rev, first(month ORDER BY c, month) AS min_month,
        {m("min(c)")} AS min_rev, count(*) FILTER (g > 0) AS positive_months,
        count(*) FILTER (g < 0) AS negative_months, avg(g) AS avg_growth FROM growth""",
    "anomalies": f"""SELECT month, {m("c")} AS revenue,
        CASE WHEN c / 100.0 > mean THEN 'spike' ELSE 'drop' END AS direction,
        {rr("abs(n * c - total) * 100", "abs(total)", 1)} AS pct_diff
        FROM (SELECT month, c, avg(c / 100.0) OVER () AS mean, stddev_samp(c / 100.0) OVER () AS std,
            sum(c::HUGEINT) OVER () AS total, count(*) OVER () AS n FROM monthly)
        WHERE abs(c / 100.0 - mean) > 2 * std""",
    "segment_row": f"""SELECT sum(customer_count)::BIGINT AS total_customers, count(*) AS n_segments,
        first(segment ORDER BY customer_count DESC, segment) AS largest_segment,
        max(customer_count) AS largest_count,
        {rr("max(customer_count) * 100", "sum(customer_count)", 1)} AS largest_share_pct,
        first(segment ORDER BY avg_c DESC, segment) AS best_segment,
        {m("max(avg_c)")} AS best_avg_monetary FROM segment_figures""",
    "winback": f"""SELECT customer_count AS high_risk_customers, {m("avg_c")} AS avg_spend,
        {m(ri("customer_count * avg_c * 15", "100"))} AS recoverable_revenue
        FROM churn_figures WHERE churn_risk_label = 'High Risk'""",
    "top_five": "SELECT * FROM categories ORDER BY c DESC NULLS FIRST, category LIMIT 5",
    "category_row": f"""SELECT first(category ORDER BY c DESC, category) AS top_category,
        {m("max(c)")} AS top_revenue, first(total_orders ORDER BY c DESC, category) AS top_orders,
        first(avg_review_score ORDER BY c DESC, category) AS top_review_score,
        last(category ORDER BY c DESC, category) AS bottom_category,
        last(avg_review_score ORDER BY c DESC, category) AS bottom_review_score FROM top_five""",
    "seller_row": """SELECT count(*) FILTER (rating = 'High Risk') AS high_risk_sellers,
        count(*) FILTER (rating = 'Medium Risk') AS medium_risk_sellers FROM seller_rated""",
    "order_months": """SELECT c.customer_unique_id, date_trunc('month', o.bought)::DATE AS month
        FROM dim_customers c JOIN fact_orders o ON c.customer_id = o.customer_id""",
    "first_months": """SELECT customer_unique_id, min(month) AS cohort_month FROM order_months
        GROUP BY 1""",
    "cohort_counts": """SELECT f.cohort_month,
        datediff('month', f.cohort_month, j.month) AS month_number,
        count(DISTINCT j.customer_unique_id) AS customers
        FROM first_months f JOIN order_months j ON f.customer_unique_id = j.customer_unique_id
        GROUP BY 1, 2""",
    # ------------------------------------------------------------ features
    "features": f"""SELECT c.customer_unique_id, count(DISTINCT o.order_id) AS frequency,
        {m("sum(p.pay)")} AS monetary, (SELECT d FROM ref) - max(o.bought)::DATE AS recency_days,
        {m(ri("sum(p.pay)", "count(*)"))} AS avg_order_value,
        {rr("sum(r.review_score)", "count(r.review_score)", 2)} AS avg_review_score,
        count(DISTINCT date_trunc('month', o.bought)) AS active_months,
        {rr("sum(p.installments)", "count(p.installments)", 2)} AS avg_installments,
        {rr("sum(i.f * 1000000000 // nullif(i.p, 0))", "count(nullif(i.p, 0)) * 1000000000", 4)}
            AS avg_freight_ratio,
        count(DISTINCT i.product_id) AS unique_products,
        (avg(r.review_score) IS NOT NULL)::BIGINT AS gave_review,
        {m("max(p.pay)")} AS max_order_value, {m("min(p.pay)")} AS min_order_value
        FROM dim_customers c JOIN fact_orders o ON c.customer_id = o.customer_id
        JOIN fact_payments p ON o.order_id = p.order_id
        JOIN items_raw i ON o.order_id = i.order_id
        LEFT JOIN fact_reviews r ON o.order_id = r.order_id GROUP BY 1""",
    "labelled": "SELECT *, (recency_days > 180)::BIGINT AS churned FROM features",
    "complete": "SELECT * FROM labelled WHERE "
    + " AND ".join(f"{f} IS NOT NULL" for f in FEATURES),
    "score_rows": """SELECT churned AS label, 1.0::DOUBLE / (1 + frequency) AS score,
        (frequency <= 4)::INT AS prediction FROM complete""",
    "score_groups": """SELECT score, sum(label)::BIGINT AS pos, sum(1 - label)::BIGINT AS neg
        FROM score_rows GROUP BY 1""",
    "banded": """SELECT *, least(frequency, 3) AS cluster FROM rfm""",
    "profile": f"""SELECT cluster, count(*) AS customer_count,
        {rr("sum(recency_days)", "count(*)", 2)} AS avg_recency,
        {rr("sum(frequency)", "count(*)", 2)} AS avg_frequency,
        {m(ri("sum(c)", "count(*)"))} AS avg_monetary FROM banded GROUP BY 1""",
    "profile_labelled": """SELECT *, CASE
        WHEN avg_recency < 60 AND avg_monetary > 200 THEN 'High Value Active'
        WHEN avg_recency < 90 AND avg_frequency > 1 THEN 'Loyal Regulars'
        WHEN avg_recency > 150 AND avg_monetary > 150 THEN 'Lapsed High Value'
        WHEN avg_recency > 150 THEN 'Churned Low Value' ELSE 'Occasional Buyers' END AS label
        FROM profile""",
    "weekly": """SELECT date_trunc('week', o.bought)::DATE AS ds, sum(p.pay)::BIGINT AS c
        FROM fact_orders o JOIN fact_payments p ON o.order_id = p.order_id GROUP BY 1""",
    "horizon": """SELECT ds + ((7 - isodow(ds)) % 7)::INT AS w, sum(c)::BIGINT AS c FROM weekly
        WHERE ds > DATE '2001-01-01' GROUP BY 1""",
    "week_grid": """SELECT g::DATE AS w, coalesce(c, 0) AS c FROM (SELECT unnest(generate_series(
        (SELECT min(w) FROM horizon), (SELECT max(w) FROM horizon), INTERVAL 7 DAYS)) AS g)
        LEFT JOIN horizon ON g::DATE = w""",
    "review_rows": """SELECT r.order_id, r.review_score, o.bought, c.customer_unique_id,
        (SELECT d FROM ref) - max(o.bought)::DATE AS recency_days
        FROM fact_reviews r JOIN fact_orders o ON r.order_id = o.order_id
        JOIN dim_customers c ON o.customer_id = c.customer_id GROUP BY 1, 2, 3, 4""",
    "review_labelled": """SELECT *, (recency_days > 180)::BIGINT AS churned,
        CASE WHEN review_score > 0 AND review_score <= 2 THEN 'Negative'
            WHEN review_score > 2 AND review_score <= 3 THEN 'Neutral'
            WHEN review_score > 3 AND review_score <= 5 THEN 'Positive' END AS sentiment_label
        FROM review_rows""",
    "review_parts": """SELECT review_score, churned, row_number() OVER (PARTITION BY churned
        ORDER BY md5(order_id || '-42')) <= (2 * count(*) OVER (PARTITION BY churned) * 200
        + 1000) // 2000 AS is_test FROM review_labelled WHERE review_score IS NOT NULL""",
    "review_side": """SELECT sign(avg(review_score) FILTER (churned = 1)
        - avg(review_score) FILTER (churned = 0)) AS side FROM review_parts WHERE NOT is_test""",
    "review_groups": """SELECT review_score * side AS score, sum(churned)::BIGINT AS pos,
        sum(1 - churned)::BIGINT AS neg FROM review_parts CROSS JOIN review_side WHERE is_test
        GROUP BY 1""",
    "sentiment": f"""SELECT sentiment_label, {ri("sum(churned)", "count(*)", 4)}::BIGINT AS rate,
        count(*) AS n FROM review_labelled WHERE sentiment_label IS NOT NULL GROUP BY 1""",
}


def _with(body: str) -> str:
    """``body`` behind the common table expressions it needs."""
    needed: set[str] = set()

    def visit(sql: str) -> None:
        for name, cte in _CTES.items():
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                needed.add(name)
                visit(cte)

    visit(body)
    ctes = ",\n".join(f"{name} AS ({_CTES[name]})" for name in _CTES if name in needed)
    return f"WITH {ctes}\n{body}" if ctes else body


def _profile_orders() -> str:
    columns = {
        "order_id": "order_id",
        "customer_id": "customer_id",
        "order_status": "order_status",
        "order_purchase_timestamp": "bought",
        "order_approved_at": "approved",
        "order_delivered_carrier_date": "carrier",
        "order_delivered_customer_date": "arrived",
        "order_estimated_delivery_date": "estimated",
    }
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_nulls "
        "FROM orders_raw"
        for name, c in columns.items()
    )


def _profile_all() -> str:
    tables = {
        "customers": ("customers_raw", "customer_id customer_unique_id customer_city customer_state"),
        "orders": (
            "orders_raw",
            "order_id customer_id order_status order_purchase_timestamp=bought order_approved_at=approved "
            "order_delivered_carrier_date=carrier order_delivered_customer_date=arrived "
            "order_estimated_delivery_date=estimated",
        ),
        "order_items": (
            "items_raw",
            "order_id product_id seller_id shipping_limit_date=line price=p freight_value=f",
        ),
        "payments": (
            "items_raw",
            "order_id payment_sequential=line payment_type payment_installments=line payment_value=p",
        ),
        "reviews": ("reviews_raw", "order_id review_seq review_score"),
        "products": (
            "products_raw",
            "product_id product_category_name product_name_lenght=name_len "
            "product_description_lenght=brand_len product_photos_qty=size",
        ),
        "sellers": ("dim_sellers", "seller_id seller_city seller_state"),
        "category": ("category", "product_category_name product_category_name_english"),
    }
    parts = []
    for table, (source, columns) in tables.items():
        for c in columns.split():
            name, _, expr = c.partition("=")
            parts.append(
                f"SELECT '{table}' AS \"table\", '{name}' AS \"column\", count(*) AS n_rows, "
                f"count(*) - count({expr or name}) AS n_nulls FROM {source}"
            )
    return "\nUNION ALL\n".join(parts)


def _unique_star() -> str:
    keys = {
        "customers": ("dim_customers", "customer_id"),
        "orders": ("fact_orders", "order_id"),
        "products": ("dim_products", "product_id"),
        "sellers": ("dim_sellers", "seller_id"),
        "items": ("items_raw", "order_id"),
    }
    return "\nUNION ALL\n".join(
        f"SELECT '{name}' AS name, {key} AS key, count(*) AS n FROM {table} GROUP BY 2 HAVING count(*) > 1"
        for name, (table, key) in keys.items()
    )


def _funnel() -> str:
    def hours(later: str, earlier: str) -> str:
        took = f"epoch_us({later}) - epoch_us({earlier})"
        return ri(f"sum({took})", f"count({took}) * 3600000000", 1)

    return f"""SELECT s1 AS stage_1_placed, s2 AS stage_2_approved, s3 AS stage_3_dispatched,
        s4 AS stage_4_delivered, s1 - s2 AS drop_placed_to_approved,
        s2 - s3 AS drop_approved_to_dispatched, s3 - s4 AS drop_dispatched_to_delivered,
        {rr("s2 * 100", "s1", 1)} AS pct_approved, {rr("s3 * 100", "s1", 1)} AS pct_dispatched,
        {rr("s4 * 100", "s1", 1)} AS pct_delivered,
        h1::DOUBLE / 10::DOUBLE AS avg_hours_to_approval,
        h2::DOUBLE / 10::DOUBLE AS avg_hours_to_dispatch,
        h3::DOUBLE / 10::DOUBLE AS avg_hours_to_delivery,
        (h1 + h2 + h3)::DOUBLE / 10::DOUBLE AS avg_total_fulfillment_hours
        FROM (SELECT count(*) AS s1, count(approved) AS s2, count(carrier) AS s3,
            count(arrived) AS s4, {hours("approved", "bought")} AS h1,
            {hours("carrier", "approved")} AS h2, {hours("arrived", "carrier")} AS h3
            FROM orders_raw)"""


def _metrics() -> str:
    pairs = "sum(neg * (2 * (above - pos) + pos))"
    return f"""SELECT {rr("pairs", "2 * p * n", 4)} AS "AUC-ROC", {rr("tp", "tp + fp", 4)} AS "Precision",
        {rr("tp", "tp + fn", 4)} AS "Recall", {rr("2 * tp", "2 * tp + fp + fn", 4)} AS "F1-Score"
        FROM (SELECT {pairs} AS pairs, sum(pos) AS p, sum(neg) AS n FROM (
            SELECT *, sum(pos) OVER (ORDER BY score DESC) AS above FROM score_groups)),
        (SELECT count(*) FILTER (label = 1 AND prediction = 1) AS tp,
            count(*) FILTER (label = 0 AND prediction = 1) AS fp,
            count(*) FILTER (label = 1 AND prediction = 0) AS fn FROM score_rows)"""


def _score_only() -> str:
    """A model of one input ranks by it, upwards or downwards: the area is that of the ranks."""
    return f"""SELECT {rr("sum(neg * (2 * (above - pos) + pos))", "2 * sum(pos) * sum(neg)", 4)}
        AS score_only_auc FROM (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS above
        FROM review_groups)"""


STUMP_FEATURES = ["frequency", "active_months", "unique_products"]
STUMP_ROUNDS = 3
_UNIT = "1073741824"  # 2**30


def _stumps() -> str:
    """Boosting by gradients and hessians with one split a tree: L2 term 1, rate 0.3, margin 0 at first."""
    cols = ", ".join(STUMP_FEATURES)
    ctes = [f"m0 AS (SELECT customer_unique_id, churned, {cols}, 0.0::DOUBLE AS margin FROM complete)"]
    for i in range(STUMP_ROUNDS):
        long = " UNION ALL ".join(
            f"SELECT {n} AS f, least({c}, 61) AS v, a, h FROM g{i}" for n, c in enumerate(STUMP_FEATURES)
        )
        side = "CASE f " + " ".join(f"WHEN {n} THEN {c}" for n, c in enumerate(STUMP_FEATURES)) + " END"
        ctes += [
            f"""g{i} AS (SELECT *, round((churned - p) * {_UNIT}) AS a, round(p * (1 - p) * {_UNIT}) AS h
            FROM (SELECT *, 1 / (1 + exp(-margin)) AS p FROM m{i}))""",
            f"""c{i} AS (SELECT f, v, sum(a) AS a, sum(h) AS h FROM ({long}) GROUP BY f, v)""",
            f"""s{i} AS (SELECT f, v, sum(a) OVER up AS al, sum(h) OVER up AS hl, sum(a) OVER whole AS t,
            sum(h) OVER whole AS ht FROM c{i}
            WINDOW up AS (PARTITION BY f ORDER BY v), whole AS (PARTITION BY f))""",
            f"""q{i} AS (SELECT *, t - al AS ar, ht - hl AS hr, al * al / (hl + {_UNIT})
            + (t - al) * (t - al) / (ht - hl + {_UNIT}) - t * t / (ht + {_UNIT}) AS gain FROM s{i})""",
            f"""b{i} AS (SELECT * FROM q{i} WHERE hl >= {_UNIT} AND hr >= {_UNIT} AND gain > 0.000001 * {_UNIT}
            ORDER BY gain DESC, f, v LIMIT 1)""",
            f"""m{i + 1} AS (SELECT customer_unique_id, churned, {cols}, margin + 0.3 * coalesce(CASE
            WHEN {side} <= v THEN al / (hl + {_UNIT}) ELSE ar / (hr + {_UNIT}) END,
            (SELECT sum(a) / (sum(h) + {_UNIT}) FROM g{i})) AS margin FROM m{i} LEFT JOIN b{i} ON true)""",
        ]
    return f"""SELECT customer_unique_id, round(margin, 6) AS margin FROM (WITH {", ".join(ctes)}
        SELECT * FROM m{STUMP_ROUNDS})"""


def _correlation() -> str:
    cols = [*FEATURES, "churned"]
    cells = ", ".join(
        f"{{'x': '{a}', 'y': '{b}', 'corr': corr({a}, {b})}}" for a in cols for b in cols
    )
    return f"""SELECT x, y, CASE WHEN NOT isnan(corr) THEN round(corr, 6) END AS corr
        FROM (SELECT unnest([{cells}], recursive := true) FROM complete)"""


def _histogram(source: str, col: str, upper: float, by: str | None) -> str:
    over = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    return f"""SELECT {lead}least(floor((v - lo) / (hi - lo) * 50), 49)::BIGINT AS bin, count(*) AS count
        FROM (SELECT {lead}v, min(v) OVER ({over}) AS lo, max(v) OVER ({over}) AS hi
            FROM (SELECT {lead}least({col}, {upper}::DOUBLE) AS v FROM {source}))
        GROUP BY ALL"""


def _standardized() -> str:
    cols = {"recency_days": "recency_days::DOUBLE", "frequency": "frequency::DOUBLE", "monetary": m("c")}
    parts = ", ".join(
        f"round(coalesce(({x} - avg({x}) OVER ()) / nullif(stddev_pop({x}) OVER (), 0), 0), 6) AS z_{c}"
        for c, x in cols.items()
    )
    return f"SELECT customer_unique_id, {parts} FROM rfm"


def _report() -> str:
    def amount(x: str) -> str:
        return f"'R$' || format('{{:,.2f}}', {x})"

    def whole(x: str) -> str:
        return f"format('{{:,}}', {x})"

    def one(x: str) -> str:
        return f"format('{{:.1f}}', {x})"

    def name(x: str) -> str:
        return f"strftime({x}, '%B %Y')"

    titles = [
        "REVENUE PERFORMANCE",
        "ANOMALY DETECTION",
        "CUSTOMER SEGMENTATION",
        "CHURN RISK ANALYSIS",
        "CATEGORY PERFORMANCE",
        "SELLER RISK",
        "STRATEGIC RECOMMENDATIONS",
    ]
    lines: list[tuple[int, int, str, str]] = [
        (0, 0, "'AUTOMATED INSIGHT REPORT'", ""),
        (0, 1, "'Generated: 01 Aug 2001, 12:00'", ""),
        (0, 2, f"'{'=' * 60}'", ""),
    ]
    for n, title in enumerate(titles, start=1):
        lines += [(n, 0, "''", ""), (n, 1, f"'{n}. {title}'", ""), (n, 2, f"'{'-' * 40}'", "")]
    r, s, w, c, v = "revenue_row", "segment_row", "winback", "category_row", "seller_row"
    lines += [
        (1, 3, f"'The platform generated ' || {amount('total_rev')} || ' in total revenue across ' || n_months || ' months, averaging ' || {amount('avg_rev')} || ' per month.'", r),
        (1, 4, f"'Revenue grew in ' || positive_months || ' months and declined in ' || negative_months || ' months, with an average month-over-month growth rate of ' || {one('avg_growth')} || '%.'", r),
        (1, 5, f"'Peak revenue was recorded in ' || {name('max_month')} || ' at ' || {amount('max_rev')} || ', while the lowest month was ' || {name('min_month')} || ' at ' || {amount('min_rev')} || '.'", r),
        (3, 3, f"'RFM analysis segmented ' || {whole('total_customers')} || ' customers into ' || n_segments || ' distinct groups.'", s),
        (3, 4, f"'The largest segment is ''' || largest_segment || ''' with ' || {whole('largest_count')} || ' customers (' || {one('largest_share_pct')} || '% of base).'", s),
        (3, 5, f"'The highest-value segment is ''' || best_segment || ''' with avg spend of ' || {amount('best_avg_monetary')} || ' per customer.'", s),
        (4, 3, f"{whole('high_risk_customers')} || ' customers are classified as High Risk (inactive 180+ days), with an average historical spend of ' || {amount('avg_spend')} || '.'", w),
        (4, 4, f"'A targeted win-back campaign achieving a conservative 15% reactivation rate could recover ' || {amount('recoverable_revenue')} || ' in revenue.'", w),
        (5, 3, f"'The top revenue category is ''' || top_category || ''' generating ' || {amount('top_revenue')} || ' across ' || {whole('top_orders')} || ' orders with an avg review score of ' || top_review_score || '.'", c),
        (5, 4, "'Among the top 5 categories, ''' || bottom_category || ''' has the lowest review score (' || bottom_review_score || ') — a quality improvement opportunity worth investigating.'", c),
        (6, 3, "'Seller risk analysis identified ' || high_risk_sellers || ' high-risk sellers and ' || medium_risk_sellers || ' medium-risk sellers among those with 50+ orders.'", v),
        (6, 4, "'The ' || medium_risk_sellers || ' medium-risk sellers show 25-50% late delivery rates with direct correlation to below-average review scores. Immediate operational review recommended.'", v + " WHERE medium_risk_sellers > 0"),
        (7, 3, f"'1. Launch win-back campaign targeting High Risk segment — ' || coalesce((SELECT {amount('recoverable_revenue')} FROM winback), 'R$0.00') || ' recoverable revenue opportunity.'", ""),
        (7, 4, "'2. Invest in ''' || top_category || ''' category expansion — highest revenue with growth potential.'", c),
        (7, 5, "'3. Review medium-risk seller contracts — late deliveries directly reduce review scores and repeat purchase rates.'", ""),
        (7, 6, "'4. Build loyalty programme for top RFM segments — protect the highest-value customer base.'", ""),
    ]
    selects = [
        f"SELECT {section}::BIGINT AS section, {seq} AS seq, {text} AS line" + (f" FROM {source}" if source else "")
        for section, seq, text, source in lines
    ]
    selects.append(
        f"""SELECT 2 AS section, 2 + row_number() OVER (ORDER BY month) AS seq,
        'ANOMALY DETECTED: ' || {name('month')} || ' shows a revenue ' || direction || ' of ' || {one('pct_diff')}
        || '% from the monthly average (' || {amount('revenue')} || ' vs avg '
        || (SELECT {amount('avg_rev')} FROM revenue_row)
        || '). Investigate for external factors or data issues.' AS line FROM anomalies"""
    )
    selects.append(
        "SELECT 2 AS section, 3 AS seq, 'No significant revenue anomalies detected.' AS line "
        "WHERE NOT EXISTS (SELECT 1 FROM anomalies)"
    )
    return "\nUNION ALL\n".join(selects)


_CATEGORY_COLUMNS = f"""category, total_orders, {m("c")} AS total_revenue,
    {m("aov")} AS avg_order_value, avg_review_score"""
_RFM_COLUMNS = f"customer_unique_id, recency_days, frequency, {m('c')} AS monetary"
_SELLER_COLUMNS = """seller_id, seller_city, seller_state, total_orders, avg_delay_days,
    avg_review_score, late_pct, rating AS risk_rating"""
_FEATURE_COLUMNS = "customer_unique_id, recency_days, " + ", ".join(FEATURES)
_PLACE = "customer_unique_id, customer_city, customer_state"

_QUERIES = {
    "profile_orders": _profile_orders(),
    "clean_customers": "SELECT * FROM dim_customers",
    "parse_timestamps": f"""SELECT order_id, {second("bought")} AS order_purchase_timestamp,
        {second("approved")} AS order_approved_at, {second("carrier")} AS order_delivered_carrier_date,
        {second("arrived")} AS order_delivered_customer_date,
        {second("estimated")} AS order_estimated_delivery_date FROM orders_raw""",
    "filter_delivered": """SELECT order_id, customer_id, order_status FROM orders_raw
        WHERE order_status = 'delivered'""",
    "delivery_delay_days": """SELECT order_id, floor((epoch_us(arrived) - epoch_us(estimated))
        / 86400000000.0)::BIGINT AS delivery_delay_days FROM orders_raw""",
    "item_total_value": f"""SELECT order_id, product_id, seller_id, {m("p")} AS price,
        {m("f")} AS freight_value, {m("p + f")} AS total_value FROM items_raw""",
    "aggregate_payments": f"""SELECT order_id, {m("pay")} AS total_payment, payment_types,
        installments FROM fact_payments""",
    "translate_category": """SELECT product_id, p.product_category_name, product_category_name_english
        FROM products_raw p LEFT JOIN category c
        ON p.product_category_name = c.product_category_name""",
    "fill_unknown": """SELECT product_id, product_category_name,
        english AS product_category_name_english FROM dim_products""",
    "clean_reviews": "SELECT order_id, review_score FROM fact_reviews",
    "drop_incomplete": f"SELECT {_FEATURE_COLUMNS} FROM complete",
    "profile_all": _profile_all(),
    "check_unique_star": _unique_star(),
    "check_unique": """SELECT order_id, line::BIGINT AS payment_sequential, count(*) AS n FROM items_raw
        GROUP BY 1, 2 HAVING count(*) > 1""",
    "check_foreign_key": """SELECT 'items_orders' AS name, order_id AS key, count(*) AS n_rows
        FROM items_raw WHERE order_id NOT IN (SELECT order_id FROM fact_orders) GROUP BY 2
        UNION ALL SELECT 'items_products', product_id, count(*) FROM items_raw
        WHERE product_id NOT IN (SELECT product_id FROM dim_products) GROUP BY 2
        UNION ALL SELECT 'items_sellers', seller_id, count(*) FROM items_raw
        WHERE seller_id NOT IN (SELECT seller_id FROM dim_sellers) GROUP BY 2""",
    "orphan_orders": """SELECT customer_id, count(*) AS n_rows FROM fact_orders
        WHERE customer_id NOT IN (SELECT customer_id FROM dim_customers) GROUP BY 1""",
    "single_purchase_rate": """SELECT count(*) FILTER (frequency = 1) * 100.0::DOUBLE / count(*)
        AS single_pct FROM features""",
    "load_star": f"""SELECT {day("month")} AS month, total_orders, unique_customers,
        {m("c")} AS revenue, {m("aov")} AS avg_order_value FROM monthly""",
    "register_views": """SELECT churn_risk_label, customer_state, count(*) AS customers
        FROM churn_risk v JOIN dim_customers c ON v.customer_unique_id = c.customer_unique_id
        GROUP BY 1, 2""",
    "rfm_base": f"""SELECT {_PLACE}, recency_days, frequency, {m("c")} AS monetary
        FROM (SELECT c.customer_unique_id, c.customer_city, c.customer_state,
            (SELECT d FROM ref) - max(o.bought)::DATE AS recency_days,
            count(DISTINCT o.order_id) AS frequency, sum(p.pay) AS c
            FROM dim_customers c JOIN fact_orders o ON c.customer_id = o.customer_id
            JOIN fact_payments p ON o.order_id = p.order_id
            WHERE o.bought IS NOT NULL GROUP BY 1, 2, 3)""",
    "rfm_scored": f"SELECT {_RFM_COLUMNS}, r_score, f_score, m_score FROM scored",
    "rfm_scored_five_is_best": f"""SELECT {_RFM_COLUMNS}, 6 - r_score AS r_score,
        6 - f_score AS f_score, 6 - m_score AS m_score FROM scored""",
    "rfm_segments": f"""SELECT {_RFM_COLUMNS}, r_score, f_score, m_score,
        {rr("r_score + f_score + m_score", "3", 2)} AS rfm_avg, segment FROM segments""",
    "rfm_summary": f"""SELECT segment, count(*) AS customer_count,
        {rr("sum(recency_days)", "count(*)")} AS avg_recency_days,
        {rr("sum(frequency)", "count(*)", 2)} AS avg_frequency,
        {m(ri("sum(c)", "count(*)"))} AS avg_monetary, {m("sum(c)")} AS total_revenue
        FROM segments GROUP BY 1""",
    "cohort_retention": f"""SELECT strftime(d.cohort_month, '%Y-%m') AS cohort, d.month_number, d.customers,
            s.customers AS cohort_size, {rr("d.customers * 100", "s.customers", 1)} AS retention_rate
        FROM cohort_counts d JOIN cohort_counts s ON d.cohort_month = s.cohort_month AND s.month_number = 0
        WHERE d.cohort_month >= DATE '1995-01-01' AND d.month_number <= 6""",
    "revenue_trends": f"""SELECT strftime(month, '%Y-%m') AS month, total_orders, unique_customers,
        {m("c")} AS revenue, {m("b")} AS prev_month_revenue,
        {rr("(c - b) * 100", "b", 1)} AS mom_growth_pct
        FROM (SELECT *, lag(c) OVER (ORDER BY month) AS b FROM monthly)""",
    "top_categories": f"""SELECT {_CATEGORY_COLUMNS}, rank() OVER (ORDER BY c DESC) AS revenue_rank
        FROM categories ORDER BY c DESC NULLS FIRST, category LIMIT 15""",
    "top_categories_three": f"""SELECT {_CATEGORY_COLUMNS}, rank() OVER (ORDER BY c DESC) AS revenue_rank
        FROM categories ORDER BY c DESC NULLS FIRST, category LIMIT 3""",
    "seller_delivery": """SELECT seller_id, seller_city, seller_state, total_orders, avg_delay_days,
        late_deliveries, late_pct, avg_review_score, rating AS seller_risk_rating FROM seller_rated
        ORDER BY late_pct DESC NULLS FIRST, seller_id LIMIT 20""",
    "order_funnel": _funnel(),
    "v_monthly_revenue": f"""SELECT {day("month")} AS month, total_orders, unique_customers,
        {m("c")} AS revenue, {m("aov")} AS avg_order_value FROM monthly""",
    "v_churn_risk": f"""SELECT customer_unique_id, total_orders, {m("c")} AS total_spent,
        {day("last")} AS last_order_date, days AS days_since_last_order, churn_risk_label
        FROM churn_risk""",
    "v_rfm_segments": f"SELECT {_RFM_COLUMNS}, r_score, f_score, m_score, segment FROM segments",
    "published_segments": f"SELECT {_RFM_COLUMNS}, r_score, f_score, m_score, segment FROM segments",
    "v_category_performance": f"SELECT {_CATEGORY_COLUMNS} FROM categories",
    "v_category_performance_per_order": f"""SELECT english AS category, count(*) AS total_orders,
        {m("sum(pay)")} AS total_revenue, {m(ri("sum(pay)", "count(*)"))} AS avg_order_value,
        {rr("sum(review_score)", "count(review_score)", 2)} AS avg_review_score
        FROM (SELECT DISTINCT english, o.order_id, p.pay, r.review_score
            FROM items_raw i JOIN dim_products d ON i.product_id = d.product_id
            JOIN fact_orders o ON i.order_id = o.order_id
            JOIN fact_payments p ON o.order_id = p.order_id
            LEFT JOIN fact_reviews r ON o.order_id = r.order_id) GROUP BY 1""",
    "v_seller_risk": f"SELECT {_SELLER_COLUMNS} FROM seller_rated",
    "v_seller_risk_tight": """SELECT * REPLACE (CASE WHEN late_pct >= 38 THEN 'High Risk'
        WHEN late_pct >= 33 THEN 'Medium Risk' ELSE 'Good' END AS risk_rating)
        FROM (SELECT seller_id, seller_city, seller_state, total_orders, avg_delay_days,
            avg_review_score, late_pct, rating AS risk_rating FROM seller_rated)""",
    "kpi_summary": f"""SELECT (SELECT {m("sum(c)")} FROM monthly) AS total_revenue,
        (SELECT sum(total_orders)::BIGINT FROM monthly) AS total_orders,
        (SELECT count(*) FROM rfm) AS total_customers,
        (SELECT count(*) FROM churn_risk WHERE churn_risk_label = 'High Risk') AS at_risk_customers""",
    "segment_overview": f"""SELECT segment, customer_count, {m("avg_c")} AS avg_monetary,
        {m("c")} AS total_revenue FROM segment_figures""",
    "churn_overview": f"""SELECT churn_risk_label, customer_count, {m("avg_c")} AS avg_spent
        FROM churn_figures""",
    "top_n_categories": f"""SELECT {_CATEGORY_COLUMNS} FROM categories
        ORDER BY c DESC NULLS FIRST, category LIMIT 10""",
    "worst_sellers": f"""SELECT {_SELLER_COLUMNS} FROM seller_rated
        ORDER BY late_pct DESC NULLS FIRST, seller_id LIMIT 20""",
    "seller_risk_counts": "SELECT rating AS risk_rating, count(*) AS count FROM seller_rated GROUP BY 1",
    "seller_risk_counts_worst": """SELECT rating AS risk_rating, count(*) AS count
        FROM (SELECT * FROM seller_rated ORDER BY late_pct DESC NULLS FIRST, seller_id LIMIT 20)
        GROUP BY 1""",
    "customer_sample": f"""SELECT {_RFM_COLUMNS}, r_score, f_score, m_score, segment FROM segments
        ORDER BY customer_unique_id LIMIT 5000""",
    "customer_sample_hundred": f"""SELECT {_RFM_COLUMNS}, r_score, f_score, m_score, segment FROM segments
        ORDER BY customer_unique_id LIMIT 100""",
    "mom_growth": f"""SELECT {day("month")} AS month, total_orders, unique_customers,
        {m("c")} AS revenue, {m("aov")} AS avg_order_value, round(g, 6) AS mom_growth
        FROM monthly JOIN (SELECT month AS k, g FROM growth) ON month = k""",
    "revenue_cards": f"""SELECT {m("sum(c)")} AS total_revenue,
        {m(ri("sum(c)", "count(*)"))} AS avg_monthly_revenue,
        {day("first(month ORDER BY c DESC, month)")} AS peak_month FROM monthly""",
    "segment_actions": f"""SELECT segment, customer_count, {lookup("segment", SEGMENT_ACTIONS)} AS action
        FROM segment_figures""",
    "revenue_facts": f"""SELECT * REPLACE ({day("max_month")} AS max_month,
        {day("min_month")} AS min_month, round(avg_growth, 6) AS avg_growth) FROM revenue_row""",
    "revenue_anomalies": f"SELECT * REPLACE ({day('month')} AS month) FROM anomalies",
    "segment_facts": "SELECT * FROM segment_row",
    "winback_value": "SELECT * FROM winback",
    "category_facts": "SELECT * FROM category_row",
    "seller_facts": "SELECT * FROM seller_row",
    "insight_report": _report(),
    "reference_date": f"SELECT {day('d')} AS ref_date FROM ref",
    "churn_features": f"SELECT {_FEATURE_COLUMNS} FROM features",
    "churn_label": "SELECT customer_unique_id, recency_days, churned FROM labelled",
    "churn_breakdown": f"""SELECT churned, count(*) AS customers,
        {rr("count(*) * 100", "(SELECT count(*) FROM labelled)", 1)} AS pct FROM labelled GROUP BY 1""",
    "stratified_split": """SELECT customer_unique_id, churned, row_number() OVER (PARTITION BY churned
        ORDER BY md5(customer_unique_id || '-42')) <= (2 * count(*) OVER (PARTITION BY churned) * 200
        + 1000) // 2000 AS is_test FROM complete""",
    "classification_metrics": _metrics(),
    "roc_curve": """SELECT score AS threshold,
        sum(neg) OVER (ORDER BY score DESC)::DOUBLE / sum(neg) OVER () AS fpr,
        sum(pos) OVER (ORDER BY score DESC)::DOUBLE / sum(pos) OVER () AS tpr FROM score_groups
        UNION ALL SELECT 'infinity'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE""",
    "score_only_model": _score_only(),
    "boosted_stumps": _stumps(),
    "explained_sums": """SELECT count(*) AS n_rows, 0::BIGINT AS n_off FROM (SELECT row_number() OVER (
        PARTITION BY churned ORDER BY md5(customer_unique_id || '-42')) <= (2 * count(*) OVER (
        PARTITION BY churned) * 200 + 1000) // 2000 AS is_test FROM complete) WHERE is_test""",
    "clusters_settled": """SELECT count(*) AS n_rows, 3::BIGINT AS n_clusters, 0::BIGINT AS n_off
        FROM rfm""",
    "business_impact": f"""SELECT n AS total_at_risk, {m(ri("s", "n"))} AS avg_spend,
        {m(ri("s * 15", "100"))} AS recoverable_15, {m(ri("s * 25", "100"))} AS recoverable_25,
        h AS hv_n, {m(ri("hs * 20", "100"))} AS hv_recoverable
        FROM (SELECT count(*) AS n, sum(c) AS s, count(*) FILTER (monetary > 500) AS h,
            sum(c) FILTER (monetary > 500) AS hs
            FROM (SELECT monetary, round(monetary * 100)::BIGINT AS c FROM complete WHERE churned = 1))""",
    "correlation_matrix": _correlation(),
    "label_correlation": f"""SELECT y AS feature, corr FROM ({_correlation()})
        WHERE x = 'churned' AND y <> 'churned'""",
    "clipped_histogram": _histogram("complete", "monetary", 1000000, "churned"),
    "clipped_histogram_freight": _histogram("complete", "avg_freight_ratio", 2, None),
    "eda_stats": f"""SELECT count(*) AS customers, count(*) FILTER (churned = 0) AS active,
        count(*) FILTER (churned = 1) AS churned,
        {rr("sum(churned) * 100", "count(*)", 1)} AS churn_rate_pct,
        {m(ri("sum(c) FILTER (churned = 0)", "count(*) FILTER (churned = 0)"))} AS avg_spend_active,
        {m(ri("sum(c) FILTER (churned = 1)", "count(*) FILTER (churned = 1)"))} AS avg_spend_churned,
        {ri("sum(q)", "count(q)")}::DOUBLE / 10000::DOUBLE AS avg_freight_ratio
        FROM (SELECT churned, round(monetary * 100)::BIGINT AS c,
            round(avg_freight_ratio * 10000)::BIGINT AS q FROM complete)""",
    "standardize": _standardized(),
    "cluster_profile": "SELECT * FROM profile",
    "cluster_label": "SELECT cluster, label FROM profile_labelled",
    "cluster_actions": f"""SELECT cluster, label, {lookup("label", CLUSTER_ACTIONS)} AS action
        FROM profile_labelled""",
    "weekly_revenue": f"SELECT {day('ds')} AS ds, {m('c')} AS y FROM weekly",
    "forecast_summary": f"""SELECT {m("sum(c)")} AS total, {m(ri("sum(c)", "count(*)"))} AS avg_week,
        {day("first(w ORDER BY c DESC, w)")} AS peak_week, {day("first(w ORDER BY c, w)")} AS low_week
        FROM week_grid""",
    "review_churn": f"""SELECT order_id, review_score, {second("bought")} AS order_purchase_timestamp,
        customer_unique_id, recency_days, churned FROM review_labelled""",
    "sentiment_bucket": "SELECT order_id, review_score, sentiment_label FROM review_labelled",
    "sentiment_distribution": """SELECT sentiment_label, count(*) AS count FROM review_labelled
        GROUP BY 1""",
    "churn_by_sentiment": f"""SELECT sentiment_label, rate::DOUBLE / 10000::DOUBLE AS churn_rate,
        n AS count, {rr("rate", "100", 1)} AS churn_pct FROM sentiment""",
    "sentiment_gap": f"""SELECT negative_pct, positive_pct,
        round(negative_pct - positive_pct, 1) AS gap_pp FROM (
        SELECT max({rr("rate", "100", 1)}) FILTER (sentiment_label = 'Negative') AS negative_pct,
            max({rr("rate", "100", 1)}) FILTER (sentiment_label = 'Positive') AS positive_pct
        FROM sentiment)""",
    "score_churn_corr": """SELECT round(corr(review_score, churned), 6) AS corr FROM review_labelled""",
    "score_histogram": """SELECT review_score, count(*) AS count FROM review_labelled
        WHERE review_score IS NOT NULL GROUP BY 1""",
}


def oracle_queries() -> dict[str, str]:
    return {name: _with(body) for name, body in _QUERIES.items()}
