"""The registered queries once more, as DuckDB SQL, for comparison.

Each text starts from the raw star tables. It states the plain definition of a
result (direct joins, window functions over whole tables) rather than the
shape the Spark plans take.
"""

from tillroll import fixed_values as fixed
from tillroll.schema import FLAT_SCHEMA
from tillroll.sources.star_schema import GENDERS, STATES, TYPED_GENDERS, TYPED_PAYMENTS

AS_OF = "2001-08-15"
WIDE_BANDS = (
    ("Small", 50000),
    ("Medium", 100000),
    ("Large", 200000),
    ("Huge", None),
)


def text(value):
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def listed(values):
    return "[" + ", ".join(text(v) for v in values) + "]"


def dec(expression):
    return f"CAST({expression} AS DECIMAL(18,2))"


def dbl(expression):
    return f"CAST({expression} AS DOUBLE)"


def rounded(expression, places=2):
    return f"CAST(ROUND(CAST({expression} AS DECIMAL(38,6)), {places}) AS DOUBLE)"


def cents_per(cents, count):
    """Whole cents over a count in whole numbers, rounded once, half away from zero."""
    c, n = f"CAST({cents} AS HUGEINT)", f"CAST({count} AS HUGEINT)"
    size = f"((2 * abs({c}) + {n}) // (2 * {n}))"
    return f"(CASE WHEN {c} < 0 THEN -{size} ELSE {size} END / 100.0)::DOUBLE"


def big(expression):
    return f"CAST({expression} AS BIGINT)"


def days(end, start):
    return f"CAST(EXTRACT(DAYS FROM ({end} - {start})) AS BIGINT)"


def banded(column, bands):
    arms = [f"WHEN {column} < {top} THEN {text(label)}" for label, top in bands[:-1]]
    return f"CASE {' '.join(arms)} ELSE {text(bands[-1][0])} END"


def members(column, groups, default=None):
    arms = [
        f"WHEN {column} IN ({', '.join(text(v) if isinstance(v, str) else str(v) for v in vs)}) "
        f"THEN {text(label)}"
        for label, vs in groups.items()
    ]
    return f"CASE {' '.join(arms)} ELSE {text(default)} END"


S_ORDERS = f"""s_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS order_date,
         {dec("o_totalprice")} AS total_amount, o_orderpriority AS payment_method,
         o_orderstatus AS shipping_method,
         CAST({dec("o_orderkey % 2500")} * 0.01 AS DECIMAL(18,2)) AS shipping_cost,
         first_line.shipped_date, first_line.product_id
  FROM orders LEFT JOIN (
    SELECT l_orderkey, MIN(l_shipdate) AS shipped_date, MIN(l_partkey) AS product_id
    FROM lineitem GROUP BY l_orderkey) first_line ON l_orderkey = o_orderkey)"""
S_ITEMS = f"""s_items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, {big("l_quantity")} AS quantity,
         {dec("l_extendedprice")} AS unit_price FROM lineitem)"""
S_PRODUCTS = f"""s_products AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS product_category,
         {dec("p_retailprice")} AS cost_price FROM part)"""
S_CUSTOMERS = f"""s_customers AS (
  SELECT c_custkey AS customer_id,
         CASE WHEN cents % 17 <> 0 THEN 18 + cents % 60 END AS customer_age,
         ({listed(GENDERS)})[cents % 3 + 1] AS customer_gender,
         n_name AS customer_city, ({listed(STATES)})[c_nationkey + 1] AS customer_state
  FROM (SELECT *, {big("ROUND(ABS(c_acctbal) * 100)")} AS cents FROM customer)
  LEFT JOIN nation ON c_nationkey = n_nationkey)"""
S_LINES = """s_lines AS (
  SELECT i.order_id, i.product_id, i.quantity, i.unit_price, i.quantity * i.unit_price AS line_total,
         o.customer_id, o.order_date, o.total_amount,
         p.product_name, p.product_category, p.cost_price
  FROM s_items i JOIN s_orders o ON o.order_id = i.order_id
  JOIN s_products p ON p.product_id = i.product_id)"""


def on(tables, body):
    """Put the named shop tables in front of a query (which may add own CTEs)."""
    parts = {
        "o": (S_ORDERS,),
        "oc": (S_ORDERS, S_CUSTOMERS),
        "ip": (S_ITEMS, S_PRODUCTS),
        "oip": (S_ORDERS, S_ITEMS, S_PRODUCTS, S_LINES),
        "oipc": (S_ORDERS, S_ITEMS, S_PRODUCTS, S_LINES, S_CUSTOMERS),
    }[tables]
    body = body.strip()
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body


AMOUNT_AVG = rounded("AVG(total_amount)")
AMOUNT_SUM = dbl("SUM(total_amount)")


def revenue_distribution(bands):
    return on(
        "o",
        f"""SELECT {banded("total_amount", bands)} AS revenue_category, COUNT(*) AS order_count,
        {AMOUNT_AVG} AS avg_order_value, {AMOUNT_SUM} AS total_revenue FROM s_orders GROUP BY 1""",
    )


PER_CUSTOMER = f"""per_customer AS (
  SELECT customer_id, COUNT(*) AS n, SUM(total_amount) AS spent, AVG(total_amount) AS mean_amount,
         COUNT(total_amount) AS amounts,
         MIN(order_date) AS since, MAX(order_date) AS until,
         {days(f"CAST('{AS_OF}' AS TIMESTAMP)", "MAX(order_date)")} AS idle
  FROM s_orders GROUP BY customer_id)"""

RFM = f"""WITH {PER_CUSTOMER}, scored AS (
  SELECT customer_id, idle, n, spent,
    NTILE(5) OVER (ORDER BY idle DESC NULLS FIRST, customer_id) AS r,
    NTILE(5) OVER (ORDER BY n NULLS LAST, customer_id) AS f,
    NTILE(5) OVER (ORDER BY spent NULLS LAST, customer_id) AS m
  FROM per_customer)"""


def rfm_label():
    arms = [
        f"WHEN r BETWEEN {r[0]} AND {r[1]} AND f BETWEEN {f[0]} AND {f[1]} "
        f"AND m BETWEEN {m[0]} AND {m[1]} THEN {text(label)}"
        for label, r, f, m in fixed.RFM_SEGMENTS
    ]
    return f"CASE {' '.join(arms)} ELSE {text(fixed.RFM_OTHER)} END"


def cohorts(month_number):
    return on(
        "o",
        f"""WITH firsts AS (
          SELECT customer_id, DATE_TRUNC('month', MIN(order_date)) AS start
          FROM s_orders GROUP BY customer_id),
        sizes AS (SELECT start, COUNT(customer_id) AS members FROM firsts GROUP BY start),
        seen AS (
          SELECT start, customer_id, {month_number} AS step
          FROM s_orders JOIN firsts USING (customer_id))
        SELECT CAST(start AS TIMESTAMP) AS cohort_month, members AS cohort_size,
               step AS month_number, COUNT(DISTINCT customer_id) AS customers,
               {rounded("COUNT(DISTINCT customer_id) * 100.0 / members")} AS retention_rate
        FROM seen JOIN sizes USING (start) GROUP BY start, members, step""",
    )


def recased(body, column):
    """The query with the column in title case for products of even number."""
    return body.replace(
        f"AS {column}",
        f"AS plain_{column}, CASE WHEN p_partkey % 2 = 0 THEN upper(plain_{column}[1]) "
        f"|| lower(plain_{column}[2:]) ELSE plain_{column} END AS {column}",
        1,
    )


def baskets(item, minimum, limit, collation=None):
    """Pairs of one item column, from the list of items and their times in each order."""
    times = "COUNT(DISTINCT product_category)" if item == "product_name" else "1"
    place = f"item COLLATE {collation}, item" if collation else "item"
    named = (
        "best"
        if item == "product_name"
        else """(SELECT best.*, a.product_name AS product_a_name, b.product_name AS product_b_name
          FROM best
          JOIN (SELECT DISTINCT product_id, product_name FROM s_products) a
            ON a.product_id = product_a
          JOIN (SELECT DISTINCT product_id, product_name FROM s_products) b
            ON b.product_id = product_b)"""
    )
    return on(
        "oip",
        f"""WITH bought AS (
          SELECT order_id, {item} AS item, {times} AS times FROM s_lines GROUP BY order_id, item),
        known AS (
          SELECT item, COUNT(*) AS orders, ROW_NUMBER() OVER (ORDER BY {place}) AS place
          FROM bought GROUP BY item),
        lists AS (
          SELECT list({{'place': place, 'times': times}}) AS content
          FROM bought JOIN known USING (item) GROUP BY order_id),
        couples AS (
          SELECT unnest(flatten([
            [{{'a': x.place, 'b': y.place, 'n': x.times * y.times}}
             for y in content if x.place < y.place] for x in content])) AS c
          FROM lists),
        best AS (
          SELECT a.item AS product_a, b.item AS product_b,
                 {big("SUM(c.n)")} AS together_frequency,
                 a.orders AS product_a_frequency, b.orders AS product_b_frequency,
                 {rounded("SUM(c.n) * 100.0 / a.orders")} AS confidence_a_to_b,
                 {rounded("SUM(c.n) * 100.0 / b.orders")} AS confidence_b_to_a
          FROM couples JOIN known a ON a.place = c.a JOIN known b ON b.place = c.b
          GROUP BY a.place, b.place, product_a, product_b, a.orders, b.orders
          HAVING SUM(c.n) >= {minimum}
          ORDER BY together_frequency DESC, confidence_a_to_b DESC, a.place, b.place
          {f"LIMIT {limit}" if limit else ""})
        SELECT * FROM {named}""",
    )


def quarters(filled):
    source = (
        """calendar AS (
          SELECT UNNEST(generate_series(MIN(start), MAX(start), INTERVAL 3 MONTH)) AS start
          FROM sums),
        periods AS (
          SELECT CAST(start AS TIMESTAMP) AS start, COALESCE(revenue, 0) AS revenue
          FROM calendar LEFT JOIN sums USING (start))"""
        if filled
        else "periods AS (SELECT * FROM sums)"
    )
    return on(
        "o",
        f"""WITH sums AS (
          SELECT CAST(DATE_TRUNC('quarter', order_date) AS TIMESTAMP) AS start,
                 SUM(total_amount) AS revenue FROM s_orders GROUP BY 1),
        {source},
        paired AS (SELECT *, LAG(revenue) OVER (ORDER BY start) AS before FROM periods)
        SELECT EXTRACT(YEAR FROM start) AS year, EXTRACT(QUARTER FROM start) AS quarter,
               {dbl("revenue")} AS revenue, {dbl("before")} AS prev_quarter_revenue,
               {rounded("(revenue - before) * 100 / NULLIF(before, 0)")} AS growth_percentage
        FROM paired""",
    )


def moving_average(filled):
    source = (
        """calendar AS (
          SELECT UNNEST(generate_series(MIN(month), MAX(month), INTERVAL 1 MONTH)) AS month
          FROM sums),
        periods AS (
          SELECT CAST(month AS TIMESTAMP) AS month, COALESCE(revenue, 0) AS revenue
          FROM calendar LEFT JOIN sums USING (month))"""
        if filled
        else "periods AS (SELECT * FROM sums)"
    )
    trailing = "AVG(revenue) OVER (ORDER BY month ROWS {} PRECEDING)"
    before = "LAG(revenue) OVER (ORDER BY month)"
    return on(
        "o",
        f"""WITH sums AS (
          SELECT CAST(DATE_TRUNC('month', order_date) AS TIMESTAMP) AS month,
                 SUM(total_amount) AS revenue FROM s_orders GROUP BY 1),
        {source}
        SELECT month, {dbl("revenue")} AS revenue,
               {rounded(trailing.format(2))} AS three_month_moving_avg,
               {rounded(trailing.format(5))} AS six_month_moving_avg,
               {rounded(f"(revenue - {before}) * 100 / NULLIF({before}, 0)")}
                 AS month_over_month_growth
        FROM periods""",
    )


def top_products(amount):
    return on(
        "oip",
        f"""SELECT product_id, product_name, product_category,
          {big("SUM(quantity)")} AS total_quantity_sold, COUNT(*) AS times_ordered,
          {dbl(f"SUM({amount})")} AS total_revenue,
          {rounded("AVG(unit_price)")} AS avg_unit_price,
          {rounded(f"SUM({amount}) / SUM(quantity)")} AS revenue_per_unit
        FROM s_lines GROUP BY product_id, product_name, product_category
        ORDER BY SUM({amount}) DESC NULLS FIRST, product_id LIMIT 20""",
    )


def categories(amount):
    return on(
        "oip",
        f"""SELECT product_category, COUNT(DISTINCT product_id) AS unique_products,
          {big("SUM(quantity)")} AS total_quantity_sold, {dbl(f"SUM({amount})")} AS category_revenue,
          {rounded("AVG(unit_price)")} AS avg_product_price, COUNT(*) AS total_orders,
          COUNT(DISTINCT customer_id) AS unique_customers,
          {rounded(f"SUM({amount}) / COUNT(DISTINCT customer_id)")} AS revenue_per_customer
        FROM s_lines GROUP BY product_category""",
    )


def seasons(amount):
    label = members("EXTRACT(MONTH FROM order_date)", fixed.SEASON_MONTHS)
    return on(
        "oip",
        f"""SELECT product_category, {label} AS season, {big("SUM(quantity)")} AS total_quantity,
          {dbl(f"SUM({amount})")} AS seasonal_revenue,
          COUNT(DISTINCT customer_id) AS unique_customers FROM s_lines GROUP BY 1, 2""",
    )


def genders(amount, collation=None):
    place = f"product_category COLLATE {collation}" if collation else "product_category"
    wanted = ", ".join(text(g) for g in fixed.REPORTED_GENDERS)
    return on(
        "oipc",
        f"""SELECT customer_gender, COUNT(DISTINCT customer_id) AS unique_customers,
          COUNT(*) AS total_orders, {dbl(f"SUM({amount})")} AS total_revenue,
          {rounded(f"AVG({amount})")} AS avg_order_value,
          (SELECT STRING_AGG(c, ', ' ORDER BY {place.replace("product_category", "c")}, c)
           FROM (SELECT unnest(list_distinct(LIST(product_category))) AS c)) AS popular_categories
        FROM s_lines JOIN s_customers USING (customer_id)
        WHERE customer_gender IN ({wanted}) GROUP BY customer_gender""",
    )


CUSTOMER_JOIN = "s_orders JOIN s_customers USING (customer_id)"


def lifetime_values(limit):
    return on(
        "o",
        f"""WITH {PER_CUSTOMER}, active AS (
          SELECT *, {days("until", "since")} + 1 AS span FROM per_customer WHERE n > 1)
        SELECT customer_id, n AS total_orders, {dbl("spent")} AS total_revenue,
        CAST(ROUND(mean_amount, 8) AS DOUBLE) AS avg_order_value, span AS customer_lifespan_days,
        CASE WHEN span > 0 THEN {rounded("n * 365.0 / span")} ELSE 0 END AS annual_order_frequency,
        CASE WHEN span > 0 THEN {cents_per("spent * 100 * n * 365", "amounts * span")}
          ELSE {dbl("spent")} END AS estimated_annual_clv FROM active
        ORDER BY estimated_annual_clv DESC NULLS FIRST, customer_id {limit}""",
    )


def profits(limit):
    gain = "(SUM(unit_price) - cost_price * COUNT(unit_price))"
    return on(
        "ip",
        f"""SELECT product_id, product_name, product_category, {dbl("cost_price")} AS cost_price,
        {rounded("AVG(unit_price)")} AS avg_selling_price,
        {rounded("AVG(unit_price) - cost_price")} AS profit_per_unit,
        {rounded("(AVG(unit_price) - cost_price) / cost_price * 100")} AS profit_margin_percentage,
        {big("SUM(quantity)")} AS total_units_sold,
        {cents_per(f"{gain} * 100 * SUM(quantity)", "COUNT(unit_price)")} AS total_profit
        FROM s_items JOIN s_products USING (product_id)
        GROUP BY product_id, product_name, product_category, cost_price
        HAVING SUM(quantity) >= 10 ORDER BY total_profit DESC NULLS FIRST, product_id {limit}""",
    )


def ages(exact):
    quotient = "COUNT(*) {} COUNT(DISTINCT customer_id)"
    each = rounded(quotient.format("* 1.0 /")) if exact else big(quotient.format("//"))
    return on(
        "oc",
        f"""SELECT {banded("customer_age", fixed.AGE_BANDS)} AS age_group,
          COUNT(DISTINCT customer_id) AS unique_customers, COUNT(*) AS total_orders,
          {AMOUNT_SUM} AS total_revenue, {AMOUNT_AVG} AS avg_order_value,
          {each} AS avg_orders_per_customer
        FROM {CUSTOMER_JOIN} WHERE customer_age IS NOT NULL GROUP BY 1""",
    )


def kpis(exact):
    each = rounded("n * 1.0 / customers") if exact else big("n // customers")
    return on(
        "o",
        f"""WITH t AS (SELECT COUNT(DISTINCT customer_id) AS customers, COUNT(*) AS n,
          SUM(total_amount) AS revenue, AVG(total_amount) AS mean_amount,
          MIN(order_date) AS since, MAX(order_date) AS until FROM s_orders)
        SELECT customers AS total_customers, n AS total_orders, {dbl("revenue")} AS total_revenue,
          {rounded("mean_amount")} AS avg_order_value, {each} AS avg_orders_per_customer,
          since AS first_order_date, until AS last_order_date,
          {days("until", "since")} AS business_days,
          {rounded(f"revenue / {days('until', 'since')}")} AS daily_avg_revenue FROM t""",
    )


# --- flat rows and cleaning -------------------------------------------------------------

FLAT = f"""flat AS (
  SELECT lpad(l_orderkey::VARCHAR, 15, '0') || '-' || lpad(l_linenumber::VARCHAR, 2, '0') || '-'
      || lpad(l_partkey::VARCHAR, 12, '0') || '-' || lpad(l_suppkey::VARCHAR, 12, '0')
      AS source_row,
    CASE WHEN (l_orderkey + l_linenumber) % 41 <> 0 THEN 'ORD' || l_orderkey END AS order_id,
    CASE WHEN (l_orderkey + l_linenumber) % 43 <> 0 THEN 'CUST' || c_custkey END AS customer_id,
    CASE WHEN c_custkey % 29 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'not an address'
         ELSE 'buyer.' || c_custkey || '@mail.example.com' END AS customer_email,
    CAST(CASE WHEN c_custkey % 17 <> 0 THEN 16 + c_custkey % 90 END AS DOUBLE) AS customer_age,
    ({listed(TYPED_GENDERS)})[c_custkey % 11 + 1] AS customer_gender,
    n_name AS customer_city, ({listed(STATES)})[c_nationkey + 1] AS customer_state,
    CASE WHEN c_custkey % 31 = 0 THEN 'no phone' ELSE '+1 (555) 01-' || c_custkey END
      AS customer_phone,
    CASE WHEN (l_orderkey + l_linenumber) % 97 = 0 THEN 'unknown'
         WHEN (l_orderkey + l_linenumber) % 23 = 0 THEN strftime(o_orderdate, '%d/%m/%Y')
         ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
    'PROD' || p_partkey AS product_id, p_name AS product_name,
    CASE p_partkey % 5 WHEN 0 THEN '  ' || lower(p_type) || chr(9) WHEN 1 THEN upper(p_type)
         WHEN 2 THEN p_type || ' women''s e-commerce x1y' WHEN 3 THEN p_type END
      AS product_category,
    CAST(CASE WHEN (l_orderkey * 7 + l_linenumber) % 53 = 0 THEN 0
         WHEN (l_orderkey * 7 + l_linenumber) % 59 = 0 THEN -1 ELSE l_quantity END AS BIGINT)
      AS quantity,
    CASE WHEN (l_orderkey + 3 * l_linenumber) % 61 <> 0 THEN {dec("l_extendedprice")}
         ELSE {dec("0")} END AS unit_price,
    CASE WHEN l_orderkey % 47 = 0 THEN NULL
         WHEN l_orderkey % 101 = 0 THEN CAST({dec("l_extendedprice")} * 25 AS DECIMAL(18,2))
         ELSE {dec("l_extendedprice")} END AS total_amount,
    ({listed(TYPED_PAYMENTS).replace(chr(9), "' || chr(9) || '")})[l_orderkey % 4 + 1]
      AS payment_method,
    o_orderstatus AS shipping_method,
    CAST({dec("l_orderkey % 2500")} * 0.01 AS DECIMAL(18,2)) AS shipping_cost
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in fixed.CRITICAL_COLUMNS)
EMAIL = fixed.EMAIL_PATTERN.replace("'", "''")

SCREENED = f"""complete AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY source_row) AS copy
  FROM flat WHERE {COMPLETE}),
screened AS (
  SELECT * EXCLUDE (copy) REPLACE (
    CAST(try_strptime(order_date, '%Y-%m-%d') AS TIMESTAMP) AS order_date,
    COALESCE(customer_age, (SELECT MEDIAN(customer_age) FROM flat)) AS customer_age,
    COALESCE(product_category, 'Unknown') AS product_category,
    NULLIF(regexp_replace(customer_phone, '[^0-9]', '', 'g'), '') AS customer_phone)
  FROM complete
  WHERE copy = 1 AND try_strptime(order_date, '%Y-%m-%d') IS NOT NULL
    AND regexp_matches(customer_email, '{EMAIL}')
    AND quantity > 0 AND unit_price > 0 AND total_amount > 0)"""


def titled(column):
    return (
        f"trim(array_to_string(list_transform(regexp_extract_all({column}, "
        "'[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(w[1]) || lower(w[2:])), ''), ' ' || chr(9))"
    )


def cleaned(gender_map=fixed.GENDER_MAP):
    labels = {}
    for typed, label in gender_map.items():
        labels.setdefault(label, []).append(typed)
    groups = " ".join(
        f"WHEN customer_age > {low} AND customer_age <= {high} THEN {text(label)}"
        for label, low, high in fixed.CLEAN_AGE_GROUPS
    )
    return f"""bounds AS (
  SELECT AVG(CAST(total_amount AS DOUBLE)) AS mid, STDDEV_SAMP(CAST(total_amount AS DOUBLE)) AS sd
  FROM screened),
cleaned AS (
  SELECT * EXCLUDE (mid, sd) REPLACE (
    {titled("product_category")} AS product_category,
    {titled("payment_method")} AS payment_method,
    {members("customer_gender", labels, fixed.UNKNOWN)} AS customer_gender),
    EXTRACT(YEAR FROM order_date) AS order_year, EXTRACT(MONTH FROM order_date) AS order_month,
    EXTRACT(DAY FROM order_date) AS order_day, dayname(order_date) AS order_weekday,
    EXTRACT(QUARTER FROM order_date) AS order_quarter,
    CASE {groups} END AS age_group,
    CAST(ROUND(total_amount / quantity, 8) AS DOUBLE) AS revenue_per_item
  FROM screened, bounds
  WHERE abs(CAST(total_amount AS DOUBLE) - mid) <= 3 * sd)"""


MONEY = "unit_price, total_amount, shipping_cost"
AS_DOUBLES = (
    f"REPLACE ({', '.join(f'{dbl(c)} AS {c}' for c in MONEY.split(', '))})"
)

FLAT_TYPES = (
    ("source_row", "string"), ("order_id", "string"), ("customer_id", "string"),
    ("customer_email", "string"), ("customer_age", "double"), ("customer_gender", "string"),
    ("customer_city", "string"), ("customer_state", "string"), ("customer_phone", "string"),
    ("order_date", "string"), ("product_id", "string"), ("product_name", "string"),
    ("product_category", "string"), ("quantity", "bigint"), ("unit_price", "decimal(18,2)"),
    ("total_amount", "decimal(18,2)"), ("payment_method", "string"),
    ("shipping_method", "string"), ("shipping_cost", "decimal(18,2)"),
)


def flat_profile():
    rows = [
        f"""SELECT {big(i)} AS position, '{name}' AS column_name, '{kind}' AS data_type,
        COUNT(*) - COUNT({name}) AS null_count,
        {rounded(f"(COUNT(*) - COUNT({name})) * 100.0 / COUNT(*)", 1)} AS null_percentage,
        COUNT(DISTINCT {name}) AS unique_count FROM flat"""
        for i, (name, kind) in enumerate(FLAT_TYPES, start=1)
    ]
    return f"WITH {FLAT}\n" + "\nUNION ALL ".join(rows)


def flat_kinds():
    """The type each column of the flat file has by its text: kinds of values as bits."""
    rows = []
    for name, kind in FLAT_TYPES:
        shown = f"CAST({name} AS VARCHAR)"
        declared = {"source_row": "string", "customer_phone": "string"}.get(name, "")
        if not declared:
            declared = FLAT_SCHEMA[name].dataType.simpleString()
        rows.append(
            f"""SELECT '{name}' AS column_name, '{declared}' AS declared, bit_or(CASE
            WHEN {shown} IS NULL THEN 1 WHEN {shown} IN ('True', 'False') THEN 2
            WHEN regexp_matches({shown}, '^[+-]?[0-9]+$') THEN 4
            WHEN regexp_matches({shown}, '^[+-]?[0-9]+[.][0-9]*$') THEN 8 ELSE 16 END) AS kinds
            FROM flat"""
        )
    return f"""WITH {FLAT}
    SELECT column_name, declared, CASE WHEN kinds = 4 THEN 'bigint' WHEN kinds = 2 THEN 'boolean'
      WHEN kinds & 18 = 0 THEN 'double' ELSE 'string' END AS inferred
    FROM ({" UNION ALL ".join(rows)})"""


MALFORMED = """
SELECT 'ORD' || l_orderkey AS order_id, CASE l_orderkey % 5
    WHEN 0 THEN 'plain' WHEN 1 THEN 'two' || chr(10) || 'lines' WHEN 2 THEN 'long'
    WHEN 4 THEN 'a, "b"' END AS note,
  CASE WHEN l_orderkey % 5 = 2 THEN
    'ORD' || l_orderkey || ',' || l_linenumber || ',long,extra' END AS record,
  COUNT(*) AS lines
FROM lineitem GROUP BY ALL
"""


def flat_nulls():
    rows = [
        f"SELECT '{name}' AS column_name, COUNT(*) - COUNT({name}) AS null_count FROM flat"
        for name, _ in FLAT_TYPES
    ]
    return f"WITH {FLAT}\n" + "\nUNION ALL ".join(rows)


def latest(key, columns, source="cleaned"):
    return f"""SELECT {columns} FROM (
      SELECT *, ROW_NUMBER() OVER (PARTITION BY {key}
        ORDER BY order_date DESC NULLS LAST, order_id DESC NULLS LAST) AS place
      FROM {source} WHERE {key} IS NOT NULL) WHERE place = 1"""


CLEAN = f"WITH {FLAT}, {SCREENED}, {cleaned()}\n"
FRACTIONS = f"""WITH {FLAT.replace("flat AS", "stated AS", 1)}, flat AS (
  SELECT * REPLACE (quantity + 0.5 AS quantity, CAST(unit_price * 0.001 AS DECIMAL(24,6)) AS unit_price) FROM stated),
{SCREENED}, {cleaned()}
"""


def oracle_sql():
    line, total = "line_total", "total_amount"
    risk = " ".join(f"WHEN idle > {d} THEN {text(label)}" for label, d in fixed.CHURN_RISKS)
    risk = f"CASE {risk} ELSE {text(fixed.CHURN_ACTIVE)} END"
    kind = " ".join(f"WHEN n <= {n} THEN {text(label)}" for label, n in fixed.CUSTOMER_TYPES)
    kind = f"CASE {kind} ELSE {text(fixed.CUSTOMER_FREQUENT)} END"
    texts = {
        "dataset_overview": on(
            "o",
            f"""SELECT COUNT(*) AS total_records, COUNT(DISTINCT customer_id) AS unique_customers,
            COUNT(DISTINCT product_id) AS unique_products, MIN(order_date) AS earliest_order,
            MAX(order_date) AS latest_order, {AMOUNT_SUM} AS total_revenue FROM s_orders""",
        ),
        "data_quality": on(
            "o",
            f"""SELECT 'orders' AS table_name, {big("COUNT(*) - COUNT(order_id)")} AS null_order_id,
            {big("COUNT(*) - COUNT(customer_id)")} AS null_customer_id,
            {big("COUNT(*) - COUNT(order_date)")} AS null_order_date,
            {big("COUNT(*) - COUNT(total_amount)")} AS null_total_amount,
            COUNT(*) FILTER (total_amount <= 0) AS invalid_amounts FROM s_orders""",
        ),
        "revenue_distribution": revenue_distribution(fixed.REVENUE_BANDS),
        "revenue_distribution_custom_bands": revenue_distribution(WIDE_BANDS),
        "monthly_sales": on(
            "o",
            f"""SELECT EXTRACT(YEAR FROM order_date) AS year, EXTRACT(MONTH FROM order_date) AS month,
            COUNT(*) AS total_orders, {AMOUNT_SUM} AS monthly_revenue,
            {AMOUNT_AVG} AS avg_order_value, COUNT(DISTINCT customer_id) AS unique_customers
            FROM s_orders GROUP BY 1, 2""",
        ),
        "day_of_week": on(
            "o",
            f"""SELECT EXTRACT(DOW FROM order_date) AS day_of_week, dayname(order_date) AS day_name,
            COUNT(*) AS total_orders, {AMOUNT_SUM} AS daily_revenue,
            {AMOUNT_AVG} AS avg_order_value FROM s_orders GROUP BY 1, 2""",
        ),
        "quarterly_growth": quarters(False),
        "quarterly_growth_filled": quarters(True),
        "revenue_moving_avg": moving_average(False),
        "revenue_moving_avg_filled": moving_average(True),
        "top_customers": on(
            "o",
            f"""WITH {PER_CUSTOMER}
            SELECT customer_id, n AS total_orders, {dbl("spent")} AS total_spent,
            {rounded("mean_amount")} AS avg_order_value, since AS first_order_date,
            until AS last_order_date, {days("until", "since")} AS customer_lifespan_days
            FROM per_customer ORDER BY spent DESC NULLS FIRST, customer_id LIMIT 20""",
        ),
        "rfm_segments": on(
            "o",
            f"""{RFM} SELECT {rfm_label()} AS customer_segment, COUNT(*) AS customer_count,
            {rounded("AVG(spent)")} AS avg_monetary_value, {rounded("AVG(n)")} AS avg_frequency,
            {rounded("AVG(idle)")} AS avg_recency_days FROM scored GROUP BY 1""",
        ),
        "rfm_scores": on(
            "o",
            f"""{RFM} SELECT customer_id, idle AS recency_days, n AS frequency,
            {dbl("spent")} AS monetary_value, r AS recency_score, f AS frequency_score,
            m AS monetary_score FROM scored""",
        ),
        "customer_clv": lifetime_values("LIMIT 50"),
        "customer_clv_all": lifetime_values(""),
        "churn_risk": on(
            "o",
            f"""WITH {PER_CUSTOMER}
            SELECT {risk} AS churn_risk, {kind} AS customer_type, COUNT(*) AS customer_count,
            {rounded("AVG(spent)")} AS avg_total_spent,
            {rounded("AVG(mean_amount)")} AS avg_order_value,
            {rounded("AVG(idle)", 0)} AS avg_days_since_last_order,
            {dbl("SUM(spent)")} AS segment_revenue FROM per_customer GROUP BY 1, 2""",
        ),
        "cohort_retention": cohorts("EXTRACT(MONTH FROM AGE(order_date, start))"),
        "cohort_retention_elapsed": cohorts("DATE_DIFF('month', start, order_date)"),
        "top_products": top_products(total),
        "top_products_by_line": top_products(line),
        "category_performance": categories(total),
        "category_performance_by_line": categories(line),
        "seasonal_performance": seasons(total),
        "seasonal_performance_by_line": seasons(line),
        "gender_patterns": genders(total),
        "gender_patterns_by_line": genders(line),
        "market_basket": baskets("product_name", 5, 20),
        "market_basket_in_parts": baskets("product_name", 5, 20),
        "market_basket_all_pairs": baskets("product_name", 5, None),
        "market_basket_by_product": baskets("product_id", 2, 20),
        "market_basket_collated": recased(baskets("product_name", 5, 500, "en"), "product_name"),
        "gender_patterns_collated": recased(genders(total, "en"), "product_category"),
        "sales_by_city": on(
            "oc",
            f"""SELECT customer_city, customer_state,
            COUNT(DISTINCT customer_id) AS unique_customers, COUNT(*) AS total_orders,
            {AMOUNT_SUM} AS total_revenue, {AMOUNT_AVG} AS avg_order_value,
            {rounded("SUM(total_amount) / COUNT(DISTINCT customer_id)")} AS revenue_per_customer
            FROM {CUSTOMER_JOIN} GROUP BY customer_city, customer_state HAVING COUNT(*) >= 10
            ORDER BY SUM(total_amount) DESC NULLS FIRST, customer_city, customer_state LIMIT 20""",
        ),
        "regional_performance": on(
            "oc",
            f"""SELECT {members("customer_state", fixed.REGION_STATES, fixed.OTHER_REGION)} AS region,
            COUNT(DISTINCT customer_id) AS unique_customers, COUNT(*) AS total_orders,
            {AMOUNT_SUM} AS total_revenue, {AMOUNT_AVG} AS avg_order_value,
            {rounded("SUM(total_amount) / COUNT(*)")} AS revenue_per_order
            FROM {CUSTOMER_JOIN} GROUP BY 1""",
        ),
        "payment_methods": on(
            "o",
            f"""SELECT payment_method, COUNT(*) AS transaction_count, {AMOUNT_SUM} AS total_revenue,
            {AMOUNT_AVG} AS avg_transaction_value, COUNT(DISTINCT customer_id) AS unique_customers,
            {rounded("COUNT(*) * 100.0 / (SELECT COUNT(*) FROM s_orders)")} AS percentage_of_orders
            FROM s_orders GROUP BY payment_method""",
        ),
        "shipping": on(
            "o",
            f"""SELECT shipping_method, COUNT(*) AS order_count, {AMOUNT_SUM} AS total_revenue,
            {AMOUNT_AVG} AS avg_order_value, {rounded("AVG(shipping_cost)")} AS avg_shipping_cost,
            {rounded(f"AVG({days('shipped_date', 'order_date')})", 1)} AS avg_processing_days
            FROM s_orders WHERE shipped_date IS NOT NULL GROUP BY shipping_method""",
        ),
        "product_profit": profits("LIMIT 20"),
        "product_profit_all": profits(""),
        "monthly_profit": on(
            "oip",
            f"""SELECT CAST(DATE_TRUNC('month', order_date) AS TIMESTAMP) AS month,
            {dbl("SUM(unit_price * quantity)")} AS total_revenue,
            {dbl("SUM(cost_price * quantity)")} AS total_cost,
            {dbl("SUM((unit_price - cost_price) * quantity)")} AS total_profit,
            {rounded("AVG((unit_price - cost_price) / cost_price * 100)")} AS avg_profit_margin
            FROM s_lines GROUP BY 1""",
        ),
        "age_groups": ages(False),
        "age_groups_exact_ratio": ages(True),
        "kpi_summary": kpis(False),
        "kpi_summary_exact_ratio": kpis(True),
        "order_calendar": on(
            "o",
            f"""SELECT order_id, EXTRACT(YEAR FROM order_date) AS year,
            EXTRACT(QUARTER FROM order_date) AS quarter, EXTRACT(MONTH FROM order_date) AS month,
            EXTRACT(DAY FROM order_date) AS day, EXTRACT(DOW FROM order_date) AS day_of_week,
            dayname(order_date) AS day_name,
            CAST(DATE_TRUNC('month', order_date) AS TIMESTAMP) AS month_start,
            EXTRACT(MONTH FROM AGE(order_date, TIMESTAMP '1995-01-01')) AS age_months,
            {days("shipped_date", "order_date")} AS processing_days,
            {days(f"CAST('{AS_OF}' AS TIMESTAMP)", "order_date")} AS days_ago FROM s_orders""",
        ),
        "screened_orders": f"WITH {FLAT}, {SCREENED}\nSELECT * {AS_DOUBLES} FROM screened",
        "cleaned_orders": f"{CLEAN}SELECT * {AS_DOUBLES} FROM cleaned",
        "cleaned_orders_identity_genders": (
            f"WITH {FLAT}, {SCREENED}, {cleaned(fixed.GENDER_MAP_WITH_IDENTITY)}\n"
            "SELECT customer_gender, COUNT(*) AS orders FROM cleaned GROUP BY customer_gender"
        ),
        "cleaning_job": f"{CLEAN}SELECT * {AS_DOUBLES[:-1]}, {dbl('quantity')} AS quantity) FROM cleaned",
        "csv_inferred_types": flat_kinds(),
        "csv_malformed": MALFORMED,
        "cleaned_twice": f"""{CLEAN}, again AS (
              SELECT AVG(CAST(total_amount AS DOUBLE)) AS mid,
                STDDEV_SAMP(CAST(total_amount AS DOUBLE)) AS sd FROM cleaned)
            SELECT ROW_NUMBER() OVER (ORDER BY source_row) AS place, source_row, order_id,
              order_date, product_category, age_group, {dbl("total_amount")} AS total_amount
            FROM cleaned, again WHERE abs(CAST(total_amount AS DOUBLE) - mid) <= 3 * sd""",
        "cleaning_report": f"""{CLEAN}SELECT
            (SELECT COUNT(*) FROM flat) AS original_rows, COUNT(*) AS final_rows,
            (SELECT COUNT(*) FROM flat) - COUNT(*) AS rows_removed,
            (SELECT COUNT(*) FROM complete WHERE copy > 1) AS duplicates_removed,
            {big("SUM((customer_phone IS NULL)::INT + (payment_method IS NULL)::INT "
                 "+ (age_group IS NULL)::INT)")} AS missing_values,
            COUNT(*) - COUNT(DISTINCT order_id) AS duplicate_order_ids,
            MIN(order_date) AS first_order_date, MAX(order_date) AS last_order_date
            FROM cleaned""",
        "null_counts": flat_nulls(),
        "profile_columns": flat_profile(),
        "profile_summary": f"""WITH {FLAT} SELECT COUNT(*) AS total_rows,
            CAST({len(FLAT_TYPES)} AS BIGINT) AS total_columns, {AMOUNT_SUM} AS total_revenue,
            {AMOUNT_AVG} AS avg_order_value, {rounded("MEDIAN(total_amount)")} AS median_order_value,
            COUNT(DISTINCT customer_id) AS total_customers, COUNT(*) AS total_orders,
            {rounded("COUNT(*) * 1.0 / COUNT(DISTINCT customer_id)")} AS orders_per_customer
            FROM flat""",
        "csv_round_trip": f"""WITH {FLAT}
            SELECT * {AS_DOUBLES[:-1]}, {dbl("quantity")} AS quantity) FROM flat""",
        "profile_columns_estimated": f"SELECT *, TRUE AS estimate_is_near FROM ({flat_profile()})",
        "cleaned_date_times": f"""{CLEAN}SELECT order_id,
            order_date + INTERVAL '10 hours 30 minutes' AS order_date FROM cleaned""",
        "cleaned_fractions": f"""{FRACTIONS}SELECT order_id, {dbl("quantity")} AS quantity,
            {dbl("unit_price")} AS unit_price,
            revenue_per_item FROM cleaned""",
        "cleaned_csv_reread_monthly": f"""{CLEAN}, again AS (
              SELECT AVG(CAST(total_amount AS DOUBLE)) AS mid,
                STDDEV_SAMP(CAST(total_amount AS DOUBLE)) AS sd FROM cleaned),
            kept AS (SELECT * FROM cleaned, again
              WHERE abs(CAST(total_amount AS DOUBLE) - mid) <= 3 * sd)
            SELECT EXTRACT(YEAR FROM order_date) AS year, EXTRACT(MONTH FROM order_date) AS month,
            COUNT(*) AS total_orders, {AMOUNT_SUM} AS monthly_revenue,
            {AMOUNT_AVG} AS avg_order_value, COUNT(DISTINCT customer_id) AS unique_customers
            FROM kept GROUP BY 1, 2""",
        "normalized_customers": CLEAN
        + latest(
            "customer_id",
            "customer_id, customer_age, customer_gender, customer_city, customer_state",
        ),
        "normalized_products": f"""{CLEAN}SELECT product_id, product_name, product_category,
            {dbl("CAST(p_retailprice AS DECIMAL(18,2))")} AS cost_price
            FROM ({latest("product_id", "product_id, product_name, product_category")})
            LEFT JOIN part ON product_id = 'PROD' || p_partkey""",
        "normalized_order_items": f"""{CLEAN}SELECT order_id, product_id, quantity,
            {dbl("unit_price")} AS unit_price FROM cleaned""",
        "normalized_orders": f"""{CLEAN}SELECT order_id, customer_id, order_date,
            {dbl("total_amount")} AS total_amount, payment_method, shipping_method,
            {dbl("shipping_cost")} AS shipping_cost, CAST(NULL AS TIMESTAMP) AS shipped_date,
            product_id FROM cleaned""",
        "normalized_repeated_orders": f"""WITH {FLAT}, stated AS (
              SELECT * REPLACE (CAST(try_strptime(order_date, '%Y-%m-%d') AS TIMESTAMP)
                AS order_date) FROM flat),
            placed AS (
              SELECT *, SUM(total_amount) OVER (PARTITION BY order_id) AS amount,
                ROW_NUMBER() OVER (PARTITION BY order_id ORDER BY product_id, customer_id
                  NULLS LAST, order_date NULLS LAST, payment_method NULLS LAST, shipping_method,
                  shipping_cost) AS place
              FROM stated)
            SELECT order_id, customer_id, order_date, {dbl("amount")} AS total_amount,
            payment_method, shipping_method, {dbl("shipping_cost")} AS shipping_cost,
            CAST(NULL AS TIMESTAMP) AS shipped_date, product_id FROM placed WHERE place = 1""",
        "cleaned_monthly_sales": f"""{CLEAN}SELECT EXTRACT(YEAR FROM order_date) AS year,
            EXTRACT(MONTH FROM order_date) AS month, COUNT(*) AS total_orders,
            {AMOUNT_SUM} AS monthly_revenue, {AMOUNT_AVG} AS avg_order_value,
            COUNT(DISTINCT customer_id) AS unique_customers FROM cleaned GROUP BY 1, 2""",
    }
    return texts | {"cleaning_job_report": texts["cleaning_report"]}
