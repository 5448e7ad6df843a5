"""For each query the same rows in DuckDB's SQL, written from the definition of the operators."""

from __future__ import annotations

# Accepted categories (one is spelt as in the source) and the bounds of the region.
CATEGORIES = (
    "Severe Storm",
    "Tsunami",
    "Landslide",
    "Envionmental",
    "Environmental",
    "Earthquake",
    "Cyclone",
    "Bushfire",
    "Tornado",
    "Hail",
    "Flood",
)
LATITUDES = (-43.38, -10.41)
LONGITUDES = (113.09, 153.38)


def with_ctes(ctes: list[tuple], final: str) -> str:
    """A CTE is a name and a body; one with a third entry is computed once and kept."""
    listed = (f"{name} AS {'' if kept else 'NOT '}MATERIALIZED ({body})" for name, body, *kept in ctes)
    return "WITH RECURSIVE " + ",\n".join(listed) + "\n" + final


def lowess_ctes(name: str, source: str, s: str, x: str, y: str, frac: float = 0.2, it: int = 3, delta: float = 0):
    """CTEs ending in ``{name}_fit(s, x, fit)``: every target paired with all of its neighbours."""
    ctes = [
        (
            f"{name}_n",
            f"SELECT s, x, y, row_number() OVER (PARTITION BY s ORDER BY x, y) - 1 AS i, "
            f"count(*) OVER (PARTITION BY s) AS n FROM (SELECT {s} AS s, CAST({x} AS DOUBLE) AS x, "
            f"CAST({y} AS DOUBLE) AS y FROM {source}) WHERE x IS NOT NULL AND y IS NOT NULL",
        ),
        (
            f"{name}_k",
            f"SELECT *, least(greatest(CAST(floor({frac} * n + 1e-10) AS BIGINT), 2), n) AS k FROM {name}_n",
        ),
        (
            f"{name}_mid",
            f"SELECT a.s, (a.x + b.x) / 2 AS m FROM {name}_k a JOIN {name}_k b ON a.s = b.s AND b.i = a.i + a.k",
        ),
        (
            f"{name}_left",
            f"SELECT p.s, p.x, p.k, count(m.m) AS l FROM (SELECT DISTINCT s, x, k FROM {name}_k) p "
            f"LEFT JOIN {name}_mid m ON p.s = m.s AND m.m < p.x GROUP BY p.s, p.x, p.k",
        ),
        (
            f"{name}_rad",
            f"SELECT t.s, t.x, t.k, t.l, greatest(t.x - a.x, b.x - t.x) AS rad FROM {name}_left t "
            f"JOIN {name}_k a ON a.s = t.s AND a.i = t.l JOIN {name}_k b ON b.s = t.s AND b.i = t.l + t.k - 1",
        ),
        (
            f"{name}_d",
            f"SELECT t.s, t.x, p.i, p.x - t.x AS dx, p.y, "
            f"CASE WHEN t.rad = 0 THEN 0 ELSE abs(p.x - t.x) / t.rad END AS d, t.rad "
            f"FROM {name}_rad t JOIN {name}_k p ON p.s = t.s "
            f"AND (p.i BETWEEN t.l AND t.l + t.k - 1 OR (t.rad = 0 AND p.x = t.x))",
        ),
        (
            f"{name}_w",
            f"SELECT s, x, i, dx, y, rad, CASE WHEN d <= 0.001 THEN 1 ELSE pow(1 - d * d * d, 3) END AS w "
            f"FROM {name}_d WHERE d < 0.999",
        ),
        (f"{name}_own", f"SELECT s, x, min(y) AS y FROM {name}_k GROUP BY s, x"),
        (f"{name}_r0", f"SELECT s, i, 1.0::DOUBLE AS r FROM {name}_k"),
    ]
    if delta:
        ctes += [
            (
                f"{name}_next",
                f"SELECT a.s, a.x, coalesce(max(CASE WHEN b.x <= a.x + {delta} THEN b.x END), min(b.x)) AS y "
                f"FROM {name}_own a JOIN {name}_own b ON a.s = b.s AND b.x > a.x GROUP BY a.s, a.x",
            ),
            (
                f"{name}_chain",
                f"SELECT s, min(x) AS x FROM {name}_own GROUP BY s UNION ALL "
                f"SELECT c.s, n.y FROM {name}_chain c JOIN {name}_next n ON c.s = n.s AND c.x = n.x",
            ),
            (
                f"{name}_ends",
                f"SELECT p.s, p.x, max(CASE WHEN c.x <= p.x THEN c.x END) AS a, min(CASE WHEN c.x >= p.x THEN c.x END) AS b "
                f"FROM {name}_own p JOIN {name}_chain c ON p.s = c.s GROUP BY p.s, p.x",
            ),
        ]
    for step in range(it + 1):
        fit = f"{name}_fit" if step == it else f"{name}_f{step}"
        fitted = f"{name}_g{step}" if delta else fit
        ctes += [
            (
                f"{name}_s{step}",
                f"SELECT w.s, w.x, max(rad) AS rad, sum(w * r) AS t, sum(w * r * dx) / sum(w * r) AS m, "
                f"sum(w * r * dx * dx) / sum(w * r) AS q, sum(w * r * y) / sum(w * r) AS my, "
                f"sum(w * r * dx * y) / sum(w * r) AS c "
                f"FROM {name}_w w JOIN {name}_r{step} r ON w.s = r.s AND w.i = r.i GROUP BY w.s, w.x",
            ),
            (
                fitted,
                f"SELECT a.s, a.x, CASE WHEN t > 0 THEN my - CASE WHEN q - m * m <= 1e-13 * rad * rad THEN 0 "
                f"ELSE m * (c - m * my) / greatest(q - m * m, 1e-12) END ELSE o.y END AS fit "
                f"FROM {name}_s{step} a JOIN {name}_own o ON a.s = o.s AND a.x = o.x",
            ),
        ]
        if delta:
            line = "f.fit + CASE WHEN e.b > e.a THEN (e.x - e.a) / (e.b - e.a) * (g.fit - f.fit) ELSE 0 END"
            ends = f"JOIN {fitted} f ON f.s = e.s AND f.x = e.a JOIN {fitted} g ON g.s = e.s AND g.x = e.b"
            ctes.append((fit, f"SELECT e.s, e.x, {line} AS fit FROM {name}_ends e {ends}"))
        if step < it:
            ctes += [
                (
                    f"{name}_a{step}",
                    f"SELECT p.s, p.i, abs(p.y - f.fit) AS a FROM {name}_k p JOIN {fit} f ON p.s = f.s AND p.x = f.x",
                ),
                (f"{name}_md{step}", f"SELECT s, median(a) AS md FROM {name}_a{step} GROUP BY s"),
                (
                    f"{name}_u{step}",
                    f"SELECT a.s, a.i, CASE WHEN md > 0 THEN a / (6 * md) WHEN a > 0 THEN 1 ELSE 0 END AS u "
                    f"FROM {name}_a{step} a JOIN {name}_md{step} m ON a.s = m.s",
                ),
                (
                    f"{name}_r{step + 1}",
                    f"SELECT s, i, CASE WHEN u <= 0.001 THEN 1 WHEN u >= 0.999 THEN 0 "
                    f"ELSE pow(1 - u * u, 2) END AS r FROM {name}_u{step}",
                ),
            ]
    return [(*cte, True) for cte in ctes]


def quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


DAY = "date_diff('day', DATE '1970-01-01', CAST(ts AS DATE))"
MONTH = "year({0}) * 100 + month({0})"
MIXED = (
    "CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%-d/%-m/%Y 0:00') "
    "WHEN 1 THEN strftime(o_orderdate, '%-m/%-d/%Y 0:00') ELSE strftime(o_orderdate, '%-d/%-m/%Y') END"
)


def mixed_date(token: str) -> str:
    return (
        f"coalesce(CAST(try_strptime({token}, '%m/%d/%Y') AS DATE), CAST(try_strptime({token}, '%d/%m/%Y') AS DATE))"
    )


def category(title: str) -> str:
    return (
        f"CASE WHEN regexp_matches({title}, '\\s-') THEN regexp_extract({title}, '(.*?)\\s-', 1) "
        f"WHEN regexp_matches({title}, '\\s') THEN regexp_extract({title}, '(.*?)\\s', 1) END"
    )


def refined(name: str, title: str) -> str:
    return (
        f"CASE WHEN {name} IN ('Environmental', 'Envionmental') THEN CASE "
        f"WHEN contains(lower({title}), 'heatwave') THEN 'Heatwave' WHEN contains(lower({title}), 'drought') THEN 'Drought' "
        f"WHEN contains(lower({title}), 'bushfire') THEN 'Bushfire' ELSE 'Others' END ELSE {name} END"
    )


NAMES = [*CATEGORIES, "Meteor", "Shipwreck"]
WORDS = ["near the coast", "HEATWAVE in the city", "long Drought inland", "a bushfire, spreading", 'the "great" one']

RECORDS = (
    "records",
    f"""SELECT o_orderkey AS key,
    CASE WHEN o_orderkey % 17 = 0 THEN 'Flood ' || o_orderpriority
         ELSE list_extract([{quoted(NAMES)}], o_orderkey % {len(NAMES)} + 1) || ' - ' ||
              list_extract([{quoted(WORDS)}], o_orderkey % {len(WORDS)} + 1) END AS title,
    CASE WHEN o_orderkey % 5 = 4 THEN strftime(o_orderdate, '%Y') ELSE {MIXED} END AS "startDate",
    strftime(o_orderdate, '%-d/%-m/%Y') AS "endDate",
    CASE WHEN o_orderkey % 19 = 0 THEN 'abc' ELSE CAST(-45 + o_custkey % 40 AS VARCHAR) END AS lat,
    CAST(105 + CAST(floor(o_totalprice) AS BIGINT) % 60 AS VARCHAR) AS lon,
    CAST(o_orderkey AS VARCHAR) AS note FROM orders""",
)
SILVER = [
    RECORDS,
    (
        "named",
        f"""SELECT title, {category("title")} AS category, regexp_extract("startDate", '^(.*?)\\s', 1) AS token, lat, lon
        FROM records WHERE TRY_CAST(lat AS DOUBLE) BETWEEN {LATITUDES[0]} AND {LATITUDES[1]}
        AND TRY_CAST(lon AS DOUBLE) BETWEEN {LONGITUDES[0]} AND {LONGITUDES[1]}""",
    ),
    (
        "silver",
        f"""SELECT {refined("category", "title")} AS "Category", {mixed_date("token")} AS "Date", lat AS "Lat", lon AS "Lon"
        FROM named WHERE category IN ({quoted(CATEGORIES)})""",
    ),
]
BLANKS = [
    ("raw", RECORDS[1]),
    (
        "records",
        """SELECT CASE WHEN key % 7 = 0 THEN '  ' ELSE '' END || title || ' ' || key || ' ' || chr(9) AS title, "startDate", "endDate",
        lat, lon, ' } one' || chr(10) || chr(10) || '"two", ' || key || chr(13) || chr(10) || '[ { ' AS note, key FROM raw""",
    ),
]
LANDED_SILVER = [
    ("raw", RECORDS[1]),
    ("records", 'SELECT title, "startDate", "endDate", lat, lon, min(key) AS key FROM raw GROUP BY ALL'),
    *SILVER[1:],
]
SHARES = [
    *SILVER,
    ("counted", 'SELECT "Category", count("Date") AS "Count" FROM silver GROUP BY "Category"'),
    (
        "shares",
        'SELECT * FROM counted WHERE "Count" * 100.0 / (SELECT nullif(sum("Count"), 0) FROM counted) > 5',
    ),
]
MONTHS = [
    (
        "months",
        f"""SELECT {MONTH.format("o_orderdate")} AS month, CAST(date_trunc('month', o_orderdate) AS DATE) AS day,
        round(avg(o_totalprice)) AS mean FROM orders GROUP BY ALL""",
    ),
    *lowess_ctes("sm", "months", "0", "month", "mean"),
    (
        "series",
        """SELECT day AS "Date", mean AS "Anomaly", fit AS "Anomaly_Lowess"
        FROM months JOIN sm_fit ON CAST(month AS DOUBLE) = x""",
    ),
]
CONSOLIDATED = [
    ("per_month", f"SELECT {MONTH.format('o_orderdate')} AS month, count(*) AS orders, avg(o_totalprice) / 1000 AS price FROM orders GROUP BY ALL"),
    ("shipped", f"SELECT {MONTH.format('l_shipdate')} AS month, avg(l_quantity) AS mean_quantity FROM lineitem GROUP BY ALL"),
    *lowess_ctes("o", "per_month", "0", "month", "orders"),
    *lowess_ctes("p", "per_month", "0", "month", "price"),
    (
        "measures",
        """SELECT CAST(month AS INTEGER) AS month, round(mean_quantity, 6) AS mean_quantity, round(o_fit.fit, 6) AS orders_smooth,
        round(p_fit.fit, 6) AS price_smooth
        FROM shipped JOIN o_fit ON CAST(month AS DOUBLE) = o_fit.x JOIN p_fit ON CAST(month AS DOUBLE) = p_fit.x""",
    ),
]


def yearly(events: list[tuple], index: str, frac: float) -> list[tuple]:
    return [
        *events,
        *MONTHS,
        ("years", 'SELECT year("Date") AS y, count("Date") AS n FROM silver GROUP BY ALL'),
        *lowess_ctes("yr", "years", "0", "y", "n", frac),
        ("index_years", index),
        (
            "measures",
            """SELECT CAST(i.y AS INTEGER) AS "Year", i.v AS "Global_Temp_Index_Lowess",
            round(yr_fit.fit, 6) AS "Disaster_Count_Lowess", round(a.v, 4) AS "Temp_Anomaly_Lowess"
            FROM index_years i JOIN yr_fit ON CAST(i.y AS DOUBLE) = yr_fit.x
            JOIN (SELECT year("Date") AS y, avg("Anomaly_Lowess") AS v FROM series GROUP BY ALL) a ON a.y = i.y""",
        ),
    ]


PAIRS = [("mean_quantity", "orders_smooth"), ("mean_quantity", "price_smooth"), ("orders_smooth", "price_smooth")]
SERIES_COLUMNS = '"Date", "Anomaly", round("Anomaly_Lowess", 4) AS "Anomaly_Lowess"'

ORACLES = {
    "category_from_title": f"""SELECT p_partkey, {category("title")} AS category FROM (SELECT p_partkey,
        CASE p_size % 3 WHEN 0 THEN p_type || ' - ' || p_name WHEN 1 THEN p_name ELSE replace(p_name, ' ', '') END AS title
        FROM part)""",
    "refine_category": f"""SELECT p_partkey, {refined("c", "t")} AS category FROM (SELECT p_partkey,
        CASE p_partkey % 4 WHEN 0 THEN 'Environmental' WHEN 1 THEN 'Envionmental' ELSE p_type END AS c,
        p_name || CASE p_partkey % 5 WHEN 0 THEN ' Bushfire after DROUGHT' WHEN 1 THEN ' heatWave'
        WHEN 2 THEN ' bushfire' ELSE '' END AS t FROM part)""",
    "mixed_dates": f"""SELECT o_orderkey, token, {mixed_date("token")} AS day
        FROM (SELECT o_orderkey, regexp_extract({MIXED}, '^(.*?)\\s', 1) AS token FROM orders)""",
    "month_key_date": """SELECT o_orderkey, month_key, day, CAST(year(day) * 100 + month(day) AS INTEGER) AS month_number,
        CAST(year(day) * 12 + month(day) - 1 AS INTEGER) AS month_index FROM (SELECT o_orderkey, month_key,
        CAST(try_strptime(month_key || '01', '%Y%m%d') AS DATE) AS day FROM (SELECT o_orderkey,
        strftime(o_orderdate, '%Y') || CASE WHEN o_orderkey % 13 = 0 THEN '13' ELSE strftime(o_orderdate, '%m') END AS month_key
        FROM orders))""",
    "tolerant_casts": """SELECT o_orderkey, CAST(trunc(TRY_CAST(t AS DOUBLE)) AS INTEGER) AS whole,
        CAST(TRY_CAST(t AS FLOAT) AS DOUBLE) AS number FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0
        THEN o_orderpriority ELSE CAST(CAST(o_totalprice AS DECIMAL(12, 2)) AS VARCHAR) END AS t FROM orders)""",
    "space_tokens": """SELECT doc_id, CAST(len(t) AS INTEGER) AS tokens, t[1] AS "first" FROM (SELECT doc_id,
        list_filter(string_split(text, ' '), lambda p: p <> '') AS t FROM documents)""",
    "whitelist": "SELECT p_partkey, p_brand FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#12', 'Brand#99')",
    "whitelist_table": """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem
        WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size <= 10)""",
    "bounding_box": """SELECT * FROM (SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'abc'
        ELSE CAST(CAST(c_acctbal AS DECIMAL(12, 2)) AS VARCHAR) END AS balance, c_nationkey FROM customer)
        WHERE TRY_CAST(balance AS DOUBLE) BETWEEN 1000 AND 4000.5 AND c_nationkey BETWEEN 3 AND 12""",
    "share_over": """WITH c AS (SELECT p_brand, count(p_partkey) AS n FROM part GROUP BY p_brand)
        SELECT * FROM c WHERE n * 100.0 / (SELECT sum(n) FROM c) > 4""",
    "dedup_first": """SELECT doc_id, text, lang, source, n_chars FROM (SELECT *, row_number() OVER
        (PARTITION BY text, lang ORDER BY doc_id) AS r FROM documents) WHERE r = 1""",
    "dedup_full": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem",
    "drop_all_null": """SELECT quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
        WHERE quality IS NOT NULL OR toxic IS NOT NULL""",
    "sanitise_names": """SELECT o_orderkey AS "Order_Key", o_custkey AS "Customer_Key", o_totalprice AS "Price5" FROM orders""",
    "project_rename": "SELECT o_totalprice AS price, o_orderkey AS key, o_orderstatus FROM orders",
    "denorm_dates": """SELECT o_orderkey, o_orderdate, CAST(year(o_orderdate) AS INTEGER) AS "Year",
        CAST(month(o_orderdate) AS INTEGER) AS "Month" FROM orders""",
    "yearly_count": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(o_orderdate) AS n FROM orders GROUP BY ALL",
    "yearly_mean": "SELECT CAST(year(l_shipdate) AS INTEGER) AS year, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL",
    "exact_means": """SELECT l_returnflag, round(favg(CASE WHEN l_linenumber % 2 = 0 THEN -1 ELSE 1 END
        * (l_extendedprice * (1 - l_discount))), 6) AS mean FROM lineitem GROUP BY ALL""",
    "skewed_join": "SELECT s_nationkey AS key, c_custkey, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey",
    "yearly_join": """SELECT CAST(a.year AS INTEGER) AS year, n, mean FROM
        (SELECT year(o_orderdate) AS year, count(o_orderdate) AS n FROM orders GROUP BY ALL) a JOIN
        (SELECT year(l_shipdate) AS year, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY ALL) b ON a.year = b.year""",
    "fan_out_join": """SELECT s_nationkey AS key, s_suppkey, n_name, customers FROM supplier JOIN nation
        ON s_nationkey = n_nationkey JOIN (SELECT c_nationkey, count(c_custkey) AS customers FROM customer GROUP BY ALL)
        ON s_nationkey = c_nationkey""",
    "lowess_monthly": with_ctes(
        [
            ("src", f"SELECT {MONTH.format('o_orderdate')} AS month, count(*) AS n FROM orders GROUP BY ALL"),
            *lowess_ctes("l", "src", "0", "month", "n"),
        ],
        "SELECT CAST(month AS INTEGER) AS month, n, round(fit, 6) AS fit FROM src JOIN l_fit ON CAST(month AS DOUBLE) = x",
    ),
    "lowess_grouped": with_ctes(
        [
            ("src", f"SELECT event_type, {DAY} * 24 + hour(ts) AS hour, count(value) AS n FROM events GROUP BY ALL"),
            *lowess_ctes("l", "src", "event_type", "hour", "n"),
        ],
        """SELECT event_type, CAST(hour AS INTEGER) AS hour, n, round(fit, 6) AS fit
        FROM src JOIN l_fit ON event_type = s AND CAST(hour AS DOUBLE) = x""",
    ),
    "lowess_jumps": with_ctes(
        [
            ("src", f"SELECT event_type, {DAY} * 24 + hour(ts) AS hour, sum(value) AS total FROM events GROUP BY ALL"),
            *lowess_ctes("l", "src", "event_type", "hour", "total", delta=30),
        ],
        """SELECT event_type, CAST(hour AS INTEGER) AS hour, round(fit, 6) AS fit
        FROM src JOIN l_fit ON event_type = s AND CAST(hour AS DOUBLE) = x""",
    ),
    "lowess_mixed": with_ctes(
        [
            (
                "src",
                f"SELECT event_id, CASE WHEN user_id % 4 = 0 THEN -1 ELSE user_id END AS who, value, "
                f"{DAY} + (hour(ts) * 60 + minute(ts)) / 1440 AS day FROM events",
            ),
            *lowess_ctes("l", "src", "who", "day", "value", 0.5, 2),
        ],
        "SELECT event_id, who, round(fit, 6) AS fit FROM src JOIN l_fit ON who = s AND day = x",
    ),
    "lowess_users": with_ctes(
        [
            ("src", f"SELECT event_id, user_id, value, {DAY} * 24 + hour(ts) AS hour FROM events"),
            *lowess_ctes("l", "src", "user_id", "hour", "value", 0.5),
        ],
        "SELECT event_id, user_id, round(fit, 6) AS fit FROM src JOIN l_fit ON user_id = s AND CAST(hour AS DOUBLE) = x",
    ),
    "lowess_long": with_ctes(
        [
            ("src", f"SELECT event_id, event_type, value, {DAY} + (hour(ts) * 60 + minute(ts)) / 1440 AS day FROM events"),
            *lowess_ctes("l", "src", "event_type", "day", "value"),
        ],
        "SELECT event_id, event_type, round(fit, 6) AS fit FROM src JOIN l_fit ON event_type = s AND day = x",
    ),
    "consolidated": with_ctes(CONSOLIDATED, "SELECT * FROM measures"),
    "json_records": """SELECT event_id, event_type, value, CAST(regexp_extract(props, '-?[0-9]+') AS INTEGER) AS props_k
        FROM events""",
    "text_table": """SELECT CAST(o_orderkey AS VARCHAR) AS "Key", replace(o_orderpriority, 'NOT SPECIFIED', 'NONE') AS "Priority",
        CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) AS "Cents5" FROM orders""",
    "text_series": """SELECT strftime(o_orderdate, '%Y%m') AS "Date", CAST(CAST(round(-o_totalprice) AS BIGINT) AS VARCHAR)
        AS "Anomaly" FROM orders""",
    "bronze_events": with_ctes(
        BLANKS,
        """SELECT title, "startDate", "endDate", lat, lon, note, CAST(key AS VARCHAR) AS source_key,
        ' ]' || lat || chr(10) AS source_of_state FROM records""",
    ),
    "silver_blanks": with_ctes([*BLANKS, *SILVER[1:]], "SELECT * FROM silver"),
    "csv_round_trip": """SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang, source, CAST(n_chars AS VARCHAR) AS n_chars
        FROM documents""",
    "clustered_box": """SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount FROM lineitem
        WHERE l_quantity BETWEEN 10 AND 15 AND l_extendedprice BETWEEN 5000 AND 20000""",
    "table_round_trip": "SELECT * FROM orders",
    "table_sql": "SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
    "manifest_rows": "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL",
    "landed_events": with_ctes(
        [RECORDS],
        """SELECT title, "startDate", "endDate", lat, lon, note FROM (SELECT *, row_number() OVER
        (PARTITION BY title, "startDate", "endDate", lat, lon ORDER BY key) AS r FROM records) WHERE r = 1""",
    ),
    "landed_index": """SELECT CAST(year(l_shipdate) AS INTEGER) AS "Year", CAST(l_quantity AS INTEGER) AS "Lowess5",
        min(l_orderkey) AS raw FROM lineitem GROUP BY 1, 2""",
    "landed_series": """SELECT DISTINCT strftime(o_orderdate, '%Y%m') AS "Date", o_orderstatus AS "Anomaly" FROM orders""",
    "silver_events": with_ctes(SILVER, "SELECT * FROM silver"),
    "silver_index": """SELECT CAST(year(l_shipdate) AS INTEGER) AS "Year",
        CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_quantity AS FLOAT) END AS "Global_Temp_Index_Lowess" FROM lineitem""",
    "silver_series": with_ctes(MONTHS, f"SELECT {SERIES_COLUMNS} FROM series"),
    "gold_series": with_ctes(
        MONTHS,
        f"""SELECT {SERIES_COLUMNS}, CAST(year("Date") AS INTEGER) AS "Year", CAST(month("Date") AS INTEGER) AS "Month"
        FROM series""",
    ),
    "gold_category": with_ctes(SHARES, "SELECT * FROM shares"),
    "gold_measures": with_ctes(
        yearly(SILVER, "SELECT year(l_shipdate) AS y, round(avg(l_quantity), 6) AS v FROM lineitem GROUP BY ALL", 0.8),
        "SELECT * FROM measures",
    ),
    "full_run": with_ctes(
        yearly(LANDED_SILVER, "SELECT year(l_shipdate) AS y, CAST(CAST(sum(l_linenumber) AS FLOAT) AS DOUBLE) AS v FROM lineitem GROUP BY ALL", 0.2),
        "SELECT * FROM measures",
    ),
    "measure_corr": with_ctes(
        CONSOLIDATED,
        " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS corr FROM measures" for a, b in PAIRS),
    ),
    "yoy_change": with_ctes(
        CONSOLIDATED,
        """SELECT t.month, t.orders_smooth, round(t.orders_smooth - p.orders_smooth, 5) AS change
        FROM measures t LEFT JOIN measures p ON p.month + 100 = t.month""",
    ),
    "category_rank": with_ctes(SHARES, 'SELECT * FROM shares ORDER BY "Count" DESC, "Category"'),
}
