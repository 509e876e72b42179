"""SQL twins of the registered queries, for DuckDB on the same tables."""

from __future__ import annotations

from typing import NamedTuple

# The twins import nothing from the engine: maps, lags and orders stand here a second time, so a change on one side shows.
ACF_LAGS = 365

# Part type -> fleet role.
PART_ROLES = {
    "ECONOMY": "Passenger",
    "LARGE": "Freighter",
    "MEDIUM": "Combi",
    "PROMO": "Corporate/Government",
    "SMALL": "Utility",
    "STANDARD": "Space tug",
}

# Fleet role -> report role, for the roles that parts have.
ROLE_LABELS = {
    "Combi": "Combi",
    "Corporate/Government": "Non Commercial",
    "Freighter": "Cargo",
    "Passenger": "Passenger",
    "Utility": "Non Commercial",
}

# Aircraft type -> manufacturer.
MANUFACTURERS = {
    "B350": "Beech Aircraft Corporation",
    "B77W": "Boeing",
    "BE20": "Beech Aircraft Corporation",
    "C550": "Cessna Aerospace",
    "F2TH": "Dassault Aviation",
    "RJ85": "Avro",
}


class Published(NamedTuple):
    """A published model, written out: lags of both parts, differences, and the weights that undo them."""

    long_order: int
    ar_lags: list[int]
    ma_lags: list[int]
    difference_lags: list[int]
    constant: bool
    weights: dict[int, int]


# Fixed values: (3,1,3)(1,0,0)[31] and (2,1,1)(0,1,0)[31].
MOVEMENTS = Published(37, [1, 2, 3, 31, 32, 33, 34], [1, 2, 3], [1], True, {1: -1})
CO2 = Published(5, [1, 2], [1], [1, 31], False, {1: -1, 31: -1, 32: 1})

# name -> (body, names it builds on)
PARTS: dict[str, tuple[str, list[str]]] = {}
ORACLES: dict[str, str] = {}


def part(name: str, body: str, *needs: str) -> None:
    PARTS[name] = (body, list(needs))


def oracle(name: str, body: str, *needs: str) -> None:
    order: list[str] = []

    def add(need: str) -> None:
        for deeper in PARTS[need][1]:
            add(deeper)
        if need not in order:
            order.append(need)

    for need in needs:
        add(need)
    ctes = ",\n".join(f"{need} AS ({PARTS[need][0]})" for need in order)
    ORACLES[name] = (f"WITH RECURSIVE {ctes}\n{body}" if ctes else body).strip()


def case(value: str, labels: dict[str, str], otherwise: str = "NULL") -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in labels.items())
    return f"CASE {value} {whens} ELSE {otherwise} END"


def rounded(value: str, digits: int) -> str:
    return f"CASE WHEN round({value}, {digits}) = 0 THEN CAST(0 AS DOUBLE) ELSE round({value}, {digits}) END"


CENTS = "CAST(round({} * 100) AS BIGINT)"

# --- stand-in tables -----------------------------------------------------------------------------

part(
    "airports",
    """SELECT 'N' || n_nationkey AS ICAO, n_name AS name,
    CAST(((n_nationkey * 7) % 25) * 5 - 60 AS DOUBLE) AS latitude_deg,
    n_nationkey * CAST(14.4 AS DOUBLE) - CAST(172.8 AS DOUBLE) AS longitude_deg,
    CAST(n_nationkey * 100 AS DOUBLE) AS elevation_ft,
    CASE r_name WHEN 'EUROPE' THEN 'EU' WHEN 'AFRICA' THEN 'AF' WHEN 'ASIA' THEN 'AS'
      WHEN 'AMERICA' THEN NULL ELSE 'OC' END AS continent
  FROM nation JOIN region ON n_regionkey = r_regionkey""",
)
part(
    "flights",
    """SELECT 'a' || l_partkey AS icao24, 'C' || o_custkey || '-' || l_linenumber AS callsign,
    CASE s_nationkey WHEN 24 THEN 'ZZZZ' WHEN 22 THEN NULL ELSE 'N' || s_nationkey END AS dep,
    'N' || c_nationkey AS arr, l_partkey,
    l_shipdate AS day, o_orderdate AS firstseen, o_orderdate + to_hours(l_linenumber) AS lastseen
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN supplier ON l_suppkey = s_suppkey""",
)


def _distance(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    chord = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) "
        f"* pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    # a coordinate that is null must stay null, and least() skips nulls
    return (
        f"CASE WHEN {lon1} + {lat1} + {lon2} + {lat2} IS NOT NULL THEN asin(sqrt(least({chord}, 1))) END"
        " * 2 * 6378137 * CAST(0.000539956803 AS DOUBLE)"
    )


part(
    "eu",
    f"""SELECT f.*, d.continent AS dep_continent, a.continent AS arr_continent,
    {_distance('d.longitude_deg', 'd.latitude_deg', 'a.longitude_deg', 'a.latitude_deg')} AS distance
  FROM flights f LEFT JOIN airports d ON f.dep = d.ICAO LEFT JOIN airports a ON f.arr = a.ICAO
  WHERE f.dep <> f.arr AND (d.continent = 'EU' OR a.continent = 'EU')""",
    "flights", "airports",
)
part(
    "aircraft",
    """SELECT 'a' || p_partkey AS icao24, CASE WHEN p_size < 50 THEN 'R' || p_partkey END AS registration
  FROM part""",
)
part(
    "fleet",
    f"""SELECT 'R' || p_partkey AS registration, {case('p_type', PART_ROLES)} AS role, p_brand AS type, p_type AS manu
  FROM part""",
)
part(
    "typed",
    """SELECT DISTINCT day AS flight_day, firstseen AS flight_firstseen, lastseen AS flight_lastseen,
    eu.icao24 AS aircraft_ICAO24, aircraft.registration AS aircraft_registration, type AS aircraft_type,
    role AS aircraft_role, dep AS flight_departure, arr AS flight_arrival, distance AS flight_distance
  FROM eu JOIN aircraft ON eu.icao24 IS NOT DISTINCT FROM aircraft.icao24
    JOIN fleet ON aircraft.registration = fleet.registration""",
    "eu", "aircraft", "fleet",
)
part(
    "obs",
    """SELECT l_quantity, l_extendedprice, l_shipdate, p_brand, p_type
  FROM lineitem JOIN part ON l_partkey = p_partkey""",
)
part(
    "cells",
    """SELECT p_brand AS type, l_quantity * 220 AS distance,
    max(CASE WHEN p_brand <> 'Brand#15' THEN l_extendedprice END) AS fuelburn
  FROM obs GROUP BY ALL""",
    "obs",
)
part("split_types", "SELECT DISTINCT type FROM cells WHERE CAST(substring(type, 7, 2) AS INT) <= 15", "cells")
part("points", "SELECT type, distance, fuelburn FROM cells WHERE fuelburn IS NOT NULL", "cells")


def gauss_jordan(name: str, source: str, key: str, size: int) -> None:
    """Parts ``<name>_gj`` and ``<name>``: solve the matrix ``m`` of each row of ``source`` into ``c``."""
    part(
        f"{name}_gj",
        f"""SELECT {key}, 1 AS k, m FROM {source}
    UNION ALL
    SELECT {key}, k + 1, list_transform(m, lambda r, i: CASE WHEN i = k
        THEN list_transform(r, lambda v: v / m[k][k])
        ELSE list_transform(list_zip(r, m[k]), lambda z: z[1] - r[k] / m[k][k] * z[2]) END)
    FROM {name}_gj WHERE k <= {size}""",
        source,
    )
    part(
        name,
        f"SELECT {key}, list_transform(m, lambda r: r[{size + 1}]) AS c FROM {name}_gj WHERE k = {size + 1}",
        f"{name}_gj",
    )


def cubic_fit(name: str, source: str, key: str, x: str, y: str) -> None:
    """Part ``name`` with ``key, c0..c3, n``."""
    part(
        f"{name}_cells",
        f"""SELECT {key}, CAST({x} AS DOUBLE) AS x, count(*) AS n, sum({y}) AS sy FROM {source}
    WHERE {x} IS NOT NULL AND {y} IS NOT NULL GROUP BY ALL""",
        source,
    )
    # polynomials that are orthogonal on the cells, by their three-term recurrence
    steps = [
        ("p1", "cells", "sum(n * x) / sum(n) AS a0", "x - a0"),
        ("p2", "p1", "sum(n * x * p1 * p1) / sum(n * p1 * p1) AS a1, sum(n * p1 * p1) / sum(n) AS b1", "(x - a1) * p1 - b1"),
        (
            "p3", "p2", "sum(n * x * p2 * p2) / sum(n * p2 * p2) AS a2, sum(n * p2 * p2) / sum(n * p1 * p1) AS b2",
            "(x - a2) * p2 - b2 * p1",
        ),
    ]
    for made, source_part, sums, formula in steps:
        part(
            f"{name}_{made}",
            f"""SELECT *, {formula} AS {made} FROM {name}_{source_part}
    JOIN (SELECT {key}, {sums} FROM {name}_{source_part} GROUP BY {key}) USING ({key})""",
            f"{name}_{source_part}",
        )
    part(
        f"{name}_d",
        f"""SELECT {key}, CAST(sum(n) AS BIGINT) AS n, count(*) AS nx, any_value(a0) AS a0, any_value(a1) AS a1,
    any_value(a2) AS a2, any_value(b1) AS b1, any_value(b2) AS b2, sum(sy) / sum(n) AS d0,
    sum(sy * p1) / sum(n * p1 * p1) AS d1, sum(sy * p2) / sum(n * p2 * p2) AS d2, sum(sy * p3) / sum(n * p3 * p3) AS d3
    FROM {name}_p3 GROUP BY {key}""",
        f"{name}_p3",
    )
    part(
        name,
        f"""SELECT {key}, CASE WHEN nx > 3 THEN d0 - d1 * a0 + d2 * (a0 * a1 - b1) + d3 * (b2 * a0 - a2 * (a0 * a1 - b1)) END AS c0,
    CASE WHEN nx > 3 THEN d1 - d2 * (a0 + a1) + d3 * (a0 * a1 - b1 + a2 * (a0 + a1) - b2) END AS c1,
    CASE WHEN nx > 3 THEN d2 - d3 * (a0 + a1 + a2) END AS c2, CASE WHEN nx > 3 THEN d3 END AS c3, n FROM {name}_d""",
        f"{name}_d",
    )


cubic_fit("model", "points", "type", "distance", "fuelburn")
part(
    "rates",
    """SELECT type, max(rate) AS rate FROM (SELECT p_brand AS type, p_retailprice / 100 AS rate FROM part)
  WHERE type NOT IN (SELECT type FROM split_types) GROUP BY type""",
    "split_types",
)

# --- flights to emissions ------------------------------------------------------------------------

oracle(
    "eu_flights",
    """SELECT icao24, callsign, dep AS estdepartureairport, arr AS estarrivalairport, CAST(day AS DATE) AS day,
  CAST(firstseen AS DATE) AS firstseen, strftime(lastseen, '%Y-%m-%d %H:%M:%S') AS lastseen FROM eu""",
    "eu",
)
oracle(
    "flight_distance",
    f"""SELECT CAST(day AS DATE) AS day, icao24, registration, callsign, dep AS departure, arr AS arrival,
  CAST(firstseen AS DATE) AS firstseen, {rounded('distance', 6)} AS distance
FROM eu LEFT JOIN aircraft USING (icao24)""",
    "eu", "aircraft",
)
oracle(
    "fleet_dedup",
    f"""SELECT CAST(flight_day AS DATE) AS flight_day, CAST(flight_firstseen AS DATE) AS flight_firstseen,
  strftime(flight_lastseen, '%Y-%m-%d %H:%M:%S') AS flight_lastseen, aircraft_ICAO24, aircraft_registration,
  aircraft_type, aircraft_role, flight_departure, flight_arrival, {rounded('flight_distance', 6)} AS flight_distance
FROM typed""",
    "typed",
)
oracle(
    "null_safe_join",
    """SELECT l_orderkey, l_linenumber, l.icao24, registration
FROM (SELECT l_orderkey, l_linenumber, 'a' || nullif(l_partkey, 0) AS icao24 FROM lineitem) l
LEFT JOIN (SELECT 'a' || nullif(p_partkey, 0) AS icao24, 'R' || p_partkey AS registration FROM part) a
  ON l.icao24 IS NOT DISTINCT FROM a.icao24""",
)
cubic_fit("price_fit", "obs", "p_type", "l_quantity", "l_extendedprice")
oracle(
    "fuel_fit",
    f"""SELECT p_type, {rounded('c0', 4)} AS c0, {rounded('c1', 4)} AS c1, {rounded('c2', 5)} AS c2,
  {rounded('c3', 6)} AS c3, n FROM price_fit""",
    "price_fit",
)
# the orthogonal polynomials' coefficients are uncorrelated, so the variance of a sum is the sum of variances
part(
    "price_lengths",
    """SELECT p_type, sum(n * p1 * p1) AS q1, sum(n * p2 * p2) AS q2, sum(n * p3 * p3) AS q3
  FROM price_fit_p3 GROUP BY 1""",
    "price_fit_p3",
)
part(
    "price_fitted",
    """SELECT p_type, x, p1, p2, p3, d.n, d0 + d1 * p1 + d2 * p2 + d3 * p3 AS fitted, d0, d.a0, d.a1, d.a2, d.b1, d.b2
  FROM price_fit_p3 c JOIN price_fit_d d USING (p_type)""",
    "price_fit_p3", "price_fit_d",
)
part(
    "price_sigma",
    """SELECT p_type, n, n - 4 AS freedom, sqrt(rss / (n - 4)) AS sigma, 1 - rss / tss AS r2,
    1 - rss / tss * (n - 1) / (n - 4) AS adjusted_r2, a0, a1, a2, b1, b2
  FROM (SELECT p_type, any_value(n) AS n, sum(pow(l_extendedprice - fitted, 2)) AS rss, sum(pow(l_extendedprice - d0, 2)) AS tss,
      any_value(a0) AS a0, any_value(a1) AS a1, any_value(a2) AS a2, any_value(b1) AS b1, any_value(b2) AS b2
    FROM obs JOIN price_fitted USING (p_type) WHERE l_quantity = x GROUP BY 1)""",
    "obs", "price_fitted",
)
oracle(
    "fuel_fit_statistics",
    f"""SELECT p_type, n, freedom, {rounded('sigma', 4)} AS sigma, {rounded('r2', 8)} AS r2, {rounded('adjusted_r2', 8)} AS adjusted_r2,
  {rounded('sigma * sqrt(1 / n + a0 * a0 / q1 + pow(a0 * a1 - b1, 2) / q2 + pow(b2 * a0 - a2 * (a0 * a1 - b1), 2) / q3)', 4)} AS se0,
  {rounded('sigma * sqrt(1 / q1 + pow(a0 + a1, 2) / q2 + pow(a0 * a1 - b1 + a2 * (a0 + a1) - b2, 2) / q3)', 5)} AS se1,
  {rounded('sigma * sqrt(1 / q2 + pow(a0 + a1 + a2, 2) / q3)', 6)} AS se2, {rounded('sigma * sqrt(1 / q3)', 7)} AS se3
FROM price_sigma JOIN price_lengths USING (p_type)""",
    "price_sigma", "price_lengths",
)
oracle(
    "fuel_fit_predicted",
    f"""SELECT p_type, x AS l_quantity, {rounded('fitted', 4)} AS fitted, {rounded('sigma * sqrt(reach)', 4)} AS fit_error,
  {rounded('sigma * sqrt(1 + reach)', 4)} AS prediction_error
FROM (SELECT p_type, x, fitted, sigma, 1 / f.n + p1 * p1 / q1 + p2 * p2 / q2 + p3 * p3 / q3 AS reach
  FROM price_fitted f JOIN price_sigma USING (p_type) JOIN price_lengths USING (p_type))""",
    "price_fitted", "price_sigma", "price_lengths",
)
part("far", "SELECT p_type, l_quantity + 1000 AS l_quantity, l_extendedprice FROM obs", "obs")
cubic_fit("far_fit", "far", "p_type", "l_quantity", "l_extendedprice")
oracle(
    "fuel_fit_far",
    f"""SELECT p_type, {rounded('c0', -2)} AS c0, {rounded('c1', 1)} AS c1, {rounded('c2', 4)} AS c2,
  {rounded('c3', 7)} AS c3, n FROM far_fit""",
    "far_fit",
)
oracle(
    "fuel_grid_fit",
    f"""SELECT type, {rounded('c0', 4)} AS c0, {rounded('c1', 6)} AS c1, {rounded('c2', 9)} AS c2,
  {rounded('c3', 13)} AS c3, n FROM model""",
    "model",
)

AS_WRITTEN = "c0 + c1 * flight_distance + c2 * flight_distance + c3"
CUBIC = (
    "c0 + c1 * flight_distance + c2 * flight_distance * flight_distance"
    " + c3 * flight_distance * flight_distance * flight_distance"
)
RATED = """SELECT typed.*, flight_distance * rate AS fuel FROM typed JOIN rates ON aircraft_type = type"""


def flight_emissions(source: str) -> str:
    return f"""SELECT * REPLACE ({case('aircraft_role', ROLE_LABELS)} AS aircraft_role), fuel * CAST(3.16 AS DOUBLE) AS co2
  FROM ({source}) WHERE {case('aircraft_role', ROLE_LABELS)} IS NOT NULL AND fuel IS NOT NULL"""


def modelled(formula: str) -> str:
    return f"""SELECT typed.*, {formula} AS fuel FROM typed JOIN model ON aircraft_type = type
    WHERE type IN (SELECT type FROM split_types)"""


part("em_written", flight_emissions(f"{modelled(AS_WRITTEN)} UNION ALL {RATED}"), "typed", "model", "rates")
part("em_cubic", flight_emissions(f"{modelled(CUBIC)} UNION ALL {RATED}"), "typed", "model", "rates")
part("em_rate", flight_emissions(RATED), "typed", "rates")
part("em_union", "SELECT DISTINCT * FROM em_written", "em_written")
for _name, _source in (
    ("emissions_as_written", "em_written"), ("emissions_cubic", "em_cubic"),
    ("emissions_rate", "em_rate"), ("emissions_union", "em_union"),
):
    oracle(
        _name,
        f"""SELECT CAST(flight_day AS DATE) AS flight_day, CAST(flight_firstseen AS DATE) AS flight_firstseen,
  aircraft_ICAO24, aircraft_registration, aircraft_type, aircraft_role, flight_departure, flight_arrival,
  {rounded('flight_distance', 6)} AS flight_distance, {rounded('fuel', 1)} AS aircraft_fuelburn,
  {rounded('co2', 1)} AS CO2 FROM {_source}""",
        _source,
    )
oracle(
    "co2_day_role",
    f"""SELECT CAST(flight_day AS DATE) AS flight_day, aircraft_role, {rounded('sum(co2)', 0)} AS CO2_daily
FROM em_written GROUP BY 1, 2""",
    "em_written",
)

# --- dimensions and classification ---------------------------------------------------------------

oracle("unpivot_grid", "SELECT type, distance, fuelburn FROM points", "points")
part(
    "wide_customer",
    """SELECT c_custkey AS "Type", CASE WHEN c_acctbal > 0 THEN c_acctbal END AS "100",
    CAST(nullif(c_nationkey, 3) AS DOUBLE) AS "200" FROM customer""",
)
oracle(
    "unpivot_keep_nulls",
    """SELECT "Type", CAST(distance AS DOUBLE) AS distance, fuelburn
FROM wide_customer UNPIVOT INCLUDE NULLS (fuelburn FOR distance IN ("100", "200"))""",
    "wide_customer",
)
part(
    "limits",
    """SELECT o_custkey, min(o_totalprice) AS min_price, max(o_totalprice) AS max_price
  FROM orders GROUP BY o_custkey""",
)
oracle("unpivot_named", "SELECT * FROM limits UNPIVOT INCLUDE NULLS (price FOR name IN (min_price, max_price))", "limits")
oracle(
    "nest_grid",
    """SELECT type, CAST(count(*) AS INT) AS n,
  string_agg(CAST(distance AS BIGINT) || ':' || CAST(round(fuelburn * 100) AS BIGINT), ' ' ORDER BY distance) AS points
FROM points GROUP BY type""",
    "points",
)
_price = CENTS.format("o_totalprice")
oracle(
    "pivot_wide",
    "SELECT o_orderstatus, "
    + ", ".join(
        f"CAST(sum(CASE WHEN o_orderpriority = '{priority}' THEN {_price} END) AS BIGINT) AS {name}"
        for priority, name in (
            ("1-URGENT", "urgent"), ("2-HIGH", "high"), ("3-MEDIUM", "medium"),
            ("4-NOT SPECIFIED", "not_specified"), ("5-LOW", "low"),
        )
    )
    + " FROM orders GROUP BY o_orderstatus",
)
oracle("select_prefix", "SELECT p_partkey, p_size, p_type FROM part")
oracle("rate_table", "SELECT type, rate AS fuelburn FROM rates", "rates")
part(
    "priced",
    """SELECT p_partkey, p_brand, p_size,
    CASE WHEN NOT (p_size = 7 AND p_type = 'PROMO') THEN p_retailprice END AS price FROM part""",
)
oracle(
    "group_max_rows",
    """SELECT p.* FROM priced p JOIN (
  SELECT p_brand, p_size, max(price) AS peak FROM priced GROUP BY ALL HAVING count(*) = count(price)) g
  ON p.p_brand = g.p_brand AND p.p_size = g.p_size AND p.price = g.peak""",
    "priced",
)
oracle(
    "rate_anti_join",
    """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (
  SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P' AND o_totalprice > 300000)""",
)
oracle(
    "regex_prefix",
    "SELECT type, rate AS fuelburn FROM rates WHERE regexp_matches(type, '^Brand#1') OR regexp_matches(type, '^Brand#20')",
    "rates",
)
part("manus", "SELECT DISTINCT type, manu FROM fleet", "fleet")
for _name, _map in (("type_override", {"Brand#1": "Avro", "Brand#2": "Boeing"}), ("grid_manufacturer", MANUFACTURERS)):
    oracle(
        _name,
        f"""SELECT p.type, {case('p.type', _map, 'm.manu')} AS manu, distance, fuelburn
FROM points p LEFT JOIN manus m ON p.type = m.type""",
        "points", "manus",
    )
oracle(
    "role_map",
    f"SELECT registration, role AS fleet_role, {case('role', ROLE_LABELS)} AS role FROM fleet",
    "fleet",
)
oracle(
    "unmapped_roles",
    f"SELECT role, count(*) AS n FROM fleet WHERE {case('role', ROLE_LABELS)} IS NULL GROUP BY role",
    "fleet",
)
oracle("sentinel_null", "SELECT p_partkey, nullif(p_type, 'PROMO') AS p_type FROM part")
part(
    "gaps",
    """SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, nullif(o_orderpriority, '5-LOW') AS priority
  FROM orders""",
)
oracle(
    "drop_nulls",
    """SELECT *, 'status' AS rule FROM gaps WHERE status IS NOT NULL
UNION ALL SELECT *, 'all' AS rule FROM gaps WHERE status IS NOT NULL AND priority IS NOT NULL""",
    "gaps",
)
oracle(
    "parse_timestamp",
    """SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') OR o_orderpriority <> '5-LOW'
  THEN CAST(o_orderdate AS DATE) END AS seen FROM orders""",
)
oracle(
    "union_by_name",
    """SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'
UNION ALL BY NAME SELECT o_totalprice, o_orderpriority, o_orderkey FROM orders WHERE o_orderstatus <> 'F'""",
)

# --- prototype -----------------------------------------------------------------------------------

part(
    "proto",
    """SELECT f.*, CASE WHEN p_size < 50 THEN 'R' || l_partkey END AS registration,
    CASE WHEN p_type IN ('ECONOMY', 'LARGE') THEN p_brand END AS typecode
  FROM eu f JOIN part ON l_partkey = p_partkey""",
    "eu",
)
# the prototype keeps flights without a known departure airport only if both codes differ, as "eu" does
oracle(
    "airport_attributes",
    "SELECT f.icao24, CAST(f.day AS DATE) AS day, f.dep AS origin, f.arr AS destination, "
    + ", ".join(
        f"{rounded(f'{alias}.longitude_deg', 6)} AS {role}_longitude_deg, {alias}.name AS {role}_name, "
        f"{alias}.latitude_deg AS {role}_latitude_deg, {alias}.elevation_ft AS {role}_elevation_ft, "
        f"{alias}.continent AS {role}_continent"
        for role, alias in (("departure", "d"), ("arrival", "a"))
    )
    + " FROM eu f LEFT JOIN airports d ON f.dep = d.ICAO LEFT JOIN airports a ON f.arr = a.ICAO",
    "eu",
)
oracle(
    "first_per_key",
    """SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) = 1""",
)
part(
    "callsigns",
    """SELECT callsign, registration, typecode FROM proto
  WHERE callsign IS NOT NULL AND registration IS NOT NULL AND typecode IS NOT NULL
    AND dep IS NOT NULL AND arr IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY callsign ORDER BY firstseen, icao24, registration, typecode, dep, arr) = 1""",
    "proto",
)
part(
    "imputed",
    """SELECT p.* REPLACE (coalesce(p.typecode, c.typecode) AS typecode,
    coalesce(p.registration, c.registration) AS registration)
  FROM proto p LEFT JOIN callsigns c ON p.callsign = c.callsign""",
    "proto", "callsigns",
)
oracle(
    "impute_coalesce",
    """SELECT icao24, callsign, CAST(day AS DATE) AS day, CAST(firstseen AS DATE) AS firstseen, dep AS origin,
  arr AS destination, registration, typecode FROM imputed""",
    "imputed",
)
part(
    "unresolved",
    """SELECT * FROM imputed WHERE typecode IS NULL
  QUALIFY row_number() OVER (PARTITION BY callsign ORDER BY firstseen, icao24, day, lastseen, dep NULLS LAST, arr,
    registration NULLS LAST) = 1""",
    "imputed",
)
oracle(
    "unresolved_links",
    """SELECT callsign, typecode, 'https://planefinder.net/data/flight/' || coalesce(callsign, 'NA') AS link
FROM unresolved""",
    "unresolved",
)
oracle(
    "unresolved_new",
    """SELECT callsign, dep AS origin, arr AS destination FROM unresolved WHERE NOT EXISTS (
  SELECT 1 FROM customer WHERE c_mktsegment = 'BUILDING' AND callsign = 'C' || c_custkey || '-1')""",
    "unresolved",
)
oracle(
    "prototype_co2_day_role",
    f"""SELECT CAST(day AS DATE) AS day, role AS aircraft_role, {rounded('sum(co2)', 0)} AS CO2
FROM (
  SELECT i.day, f.role, (c0 + c1 * distance + c2 * distance + c3) * CAST(3.16 AS DOUBLE) AS co2
  FROM imputed i JOIN fleet f ON i.registration = f.registration JOIN model m ON f.type = m.type
  WHERE dep IS NOT NULL) WHERE co2 IS NOT NULL GROUP BY ALL""",
    "imputed", "fleet", "model",
)

# --- reports -------------------------------------------------------------------------------------

part(
    "facts",
    f"""SELECT CAST(l_shipdate AS DATE) AS flight_day, p_brand AS aircraft_type, p_type AS aircraft_role,
    {CENTS.format('l_extendedprice')} AS co2 FROM obs""",
    "obs",
)
part(
    "days_only",
    f"SELECT CAST(l_shipdate AS DATE) AS flight_day, {CENTS.format('l_extendedprice')} AS co2 FROM lineitem",
)
part(
    "daily_role",
    "SELECT flight_day, aircraft_role, CAST(sum(co2) AS DOUBLE) AS v FROM facts GROUP BY ALL",
    "facts",
)
oracle("daily_co2", "SELECT flight_day, CAST(sum(co2) AS DOUBLE) AS daily_CO2 FROM days_only GROUP BY 1", "days_only")
oracle(
    "daily_outliers_removed",
    """SELECT flight_day, aircraft_role, v AS CO2_daily FROM daily_role JOIN (
  SELECT aircraft_role, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM daily_role GROUP BY 1)
  USING (aircraft_role)
WHERE v > 0 AND v >= q1 - 1.5 * (q3 - q1) AND v <= q3 + 1.5 * (q3 - q1)""",
    "daily_role",
)
oracle(
    "role_quartiles",
    """SELECT aircraft_role, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3,
  quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM daily_role GROUP BY 1""",
    "daily_role",
)
part(
    "near",
    """SELECT aircraft_role, x0, x - x0 AS dx, v, pow(1 - pow(abs(x - x0) / 90.0, 3), 3) AS w FROM (
    SELECT aircraft_role, v, datediff('day', DATE '1970-01-01', flight_day) AS x,
      unnest(generate_series(CAST(ceil((x - 89) / 7.0) AS BIGINT), CAST(floor((x + 89) / 7.0) AS BIGINT))) * 7 AS x0
    FROM daily_role)""",
    "daily_role",
)
part(
    "sums",
    """SELECT aircraft_role, x0, sum(w) AS sw, sum(w * dx) AS sd, sum(w * dx * dx) AS sdd, sum(w * v) AS sv,
    sum(w * dx * v) AS sdv FROM near GROUP BY ALL""",
    "near",
)
oracle(
    "local_trend",
    f"""SELECT aircraft_role, DATE '1970-01-01' + CAST(x0 AS INT) AS flight_day,
  {rounded('CASE WHEN sw * sdd - sd * sd > 1e-9 THEN (sdd * sv - sd * sdv) / (sw * sdd - sd * sd) ELSE sv / sw END', 0)}
    AS trend
FROM sums JOIN (SELECT aircraft_role, datediff('day', DATE '1970-01-01', min(flight_day)) AS lo,
  datediff('day', DATE '1970-01-01', max(flight_day)) AS hi FROM daily_role GROUP BY 1) USING (aircraft_role)
WHERE x0 BETWEEN lo AND hi""",
    "sums", "daily_role",
)
part(
    "year_days",
    """SELECT aircraft_role, CAST(datediff('day', DATE '1970-01-01', flight_day) AS DOUBLE) AS x, v FROM daily_role
  WHERE flight_day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    "daily_role",
)
part(
    "loess_places",
    """SELECT aircraft_role, near, unnest(list_concat(list_transform(xs, lambda x: {'x0': x, 'seen': TRUE}),
      list_transform(range(80), lambda i: {'x0': lo + (hi - lo) * i / 79, 'seen': FALSE})), recursive := TRUE)
  FROM (SELECT aircraft_role, list(x) AS xs, min(x) AS lo, max(x) AS hi, CAST(floor(count(*) * 0.75 + 1e-5) AS BIGINT) AS near
    FROM year_days GROUP BY 1) WHERE near >= 3""",
    "year_days",
)
part(
    "loess_ranked",
    """SELECT aircraft_role, x0, seen, near, x, v, abs(x - x0) AS gap,
    row_number() OVER (PARTITION BY aircraft_role, x0, seen ORDER BY abs(x - x0)) AS place
  FROM loess_places JOIN year_days USING (aircraft_role)""",
    "loess_places", "year_days",
)
part(
    "loess_pairs",
    """SELECT aircraft_role, x0, seen, x, v, (x - x0) / h AS u, pow(greatest(1 - pow(gap / h, 3), 0), 3) AS w
  FROM (SELECT *, max(gap) FILTER (place = near) OVER (PARTITION BY aircraft_role, x0, seen) AS h FROM loess_ranked)""",
    "loess_ranked",
)
part(
    "loess_sums",
    f"""SELECT aircraft_role, x0, seen, count(DISTINCT x) FILTER (w > 0) AS places, any_value(v) FILTER (x = x0) AS own_v,
    {', '.join(f'sum(w * pow(u, {k})) AS s{k}, sum(w * w * pow(u, {k})) AS r{k}' for k in range(5))},
    {', '.join(f'sum(w * v * pow(u, {k})) AS t{k}' for k in range(3))} FROM loess_pairs GROUP BY ALL""",
    "loess_pairs",
)
# first row of the inverse of the 3 x 3 normal matrix by cofactors
part(
    "loess_rows",
    """SELECT *, c0 / det AS e0, c1 / det AS e1, c2 / det AS e2 FROM (SELECT *, s0 * c0 + s1 * c1 + s2 * c2 AS det
  FROM (SELECT *, s2 * s4 - s3 * s3 AS c0, s2 * s3 - s1 * s4 AS c1, s1 * s3 - s2 * s2 AS c2 FROM loess_sums))""",
    "loess_sums",
)
part(
    "loess_fits",
    """SELECT aircraft_role, x0, seen, places, own_v, e0, e0 * t0 + e1 * t1 + e2 * t2 AS fit,
    e0 * e0 * r0 + 2 * e0 * e1 * r1 + (2 * e0 * e2 + e1 * e1) * r2 + 2 * e1 * e2 * r3 + e2 * e2 * r4 AS len FROM loess_rows""",
    "loess_rows",
)
part(
    "loess_whole",
    """SELECT aircraft_role, freedom, sqrt(rss / freedom) AS sigma FROM (SELECT aircraft_role, sum(pow(own_v - fit, 2)) AS rss,
    count(*) - 2 * sum(e0) + sum(len) AS freedom FROM loess_fits WHERE seen GROUP BY 1 HAVING min(places) >= 3)""",
    "loess_fits",
)
oracle(
    "role_trend_loess",
    f"""SELECT aircraft_role, {rounded('x0', 6)} AS x, {rounded('fit', 0)} AS trend, {rounded('sigma * sqrt(len)', 0)} AS error,
  {rounded('sigma', 0)} AS sigma, {rounded('freedom', 6)} AS freedom
FROM loess_fits JOIN loess_whole USING (aircraft_role) WHERE NOT seen""",
    "loess_fits", "loess_whole",
)
oracle(
    "price_quantiles",
    f"""SELECT l_returnflag, l_linestatus, probability, {rounded('quantile', 6)} AS quantile
FROM (SELECT l_returnflag, l_linestatus, unnest([0, 0.25, 0.5, 0.75, 0.99, 1]::DOUBLE[]) AS probability,
    unnest(quantile_cont(CAST(l_extendedprice AS DOUBLE), [0, 0.25, 0.5, 0.75, 0.99, 1])) AS quantile
  FROM lineitem GROUP BY l_returnflag, l_linestatus)""",
)
oracle(
    "yearly_by_type",
    """SELECT aircraft_type, round_even(CAST(sum(co2) AS DOUBLE) / 1e6, 0) AS total_CO2 FROM facts
WHERE flight_day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' GROUP BY 1""",
    "facts",
)
oracle(
    "daily_count_sum",
    "SELECT flight_day, count(*) AS flights, CAST(sum(co2) AS DOUBLE) AS CO2_daily FROM days_only GROUP BY 1",
    "days_only",
)
oracle(
    "total_in_range",
    """SELECT coalesce(CAST(sum(co2) AS DOUBLE), 0) AS CO2 FROM days_only
WHERE flight_day BETWEEN DATE '1998-01-01' AND DATE '1998-12-31'""",
    "days_only",
)
oracle(
    "date_filter_from",
    "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate FROM orders WHERE o_orderdate >= DATE '2000-01-01'",
)
oracle(
    "date_filter_or",
    """SELECT * FROM (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day FROM orders)
WHERE day >= DATE '1998-01-01' OR day <= DATE '1999-12-31'""",
)
part(
    "balances",
    f"""SELECT c_mktsegment, c_nationkey, CASE WHEN c_nationkey <> 7
    THEN CAST(sum({CENTS.format("c_acctbal")}) AS BIGINT) END AS balance FROM customer GROUP BY c_mktsegment, c_nationkey""",
)
oracle(
    "sorted_rank",
    """SELECT *,
  CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY balance ASC NULLS LAST, c_nationkey) AS INT) AS place_up,
  CAST(row_number() OVER (PARTITION BY c_mktsegment ORDER BY balance DESC NULLS LAST, c_nationkey) AS INT) AS place_down
FROM balances""",
    "balances",
)
oracle(
    "null_strict_sum",
    f"""SELECT o_custkey, CAST(CASE WHEN count(*) = count(price) THEN sum(price) END AS DOUBLE) AS total
FROM (SELECT o_custkey, CASE WHEN o_totalprice < 490000 THEN {_price} END AS price FROM orders) GROUP BY 1""",
)

# --- series --------------------------------------------------------------------------------------


def daily(name: str, measure: str, bounds: tuple[str, str] | None = None) -> None:
    where = "" if bounds is None else f"WHERE flight_day BETWEEN DATE '{bounds[0]}' AND DATE '{bounds[1]}'"
    part(
        name,
        f"""SELECT aircraft_role AS series_key, flight_day AS date, CAST({measure} AS DOUBLE) AS value,
    CAST(row_number() OVER (PARTITION BY aircraft_role ORDER BY flight_day) AS INT) AS t
  FROM facts {where} GROUP BY 1, 2""",
        "facts",
    )


daily("co2_series", "sum(co2)")
daily("moves", "count(*)")
daily("train", "sum(co2)", ("1998-01-01", "1999-12-31"))
daily("actual", "sum(co2)", ("2000-01-01", "2000-12-31"))
oracle("series_index", "SELECT * FROM co2_series", "co2_series")
oracle(
    "co2_series_as_written",
    """SELECT 'all' AS series_key, t, date, value FROM (
  SELECT flight_day AS date, CAST(row_number() OVER (ORDER BY flight_day) AS INT) AS t, CAST(sum(co2) AS DOUBLE) AS value
  FROM days_only GROUP BY flight_day) WHERE t <= 731""",
    "days_only",
)
oracle("series_truncate", "SELECT * FROM co2_series WHERE t <= 731", "co2_series")


def second_difference(name: str, source: str, value: str) -> None:
    part(
        name,
        f"""SELECT series_key, t, date, dv - lag(dv) OVER (PARTITION BY series_key ORDER BY t) AS value
  FROM (SELECT *, {value} - lag({value}) OVER (PARTITION BY series_key ORDER BY t) AS dv FROM {source})
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY t) > 2""",
        source,
    )


second_difference("co2_diff2", "co2_series", "value")
second_difference("moves_diff2", "moves", "ln(value)")
oracle("series_diff2", "SELECT * FROM co2_diff2", "co2_diff2")
oracle(
    "series_logdiff2",
    f"SELECT series_key, t, date, {rounded('value', 8)} AS value FROM moves_diff2",
    "moves_diff2",
)


def dated(position: str, start: int) -> str:
    """Date of a position, over the real length of its year."""
    year = f"({start} + CAST(floor(({position} - 1) / 365.0) AS INT))"
    length = f"datediff('day', make_date({year}, 1, 1), make_date({year} + 1, 1, 1))"
    share = f"(({position} - 1) % 365) / CAST(365 AS DOUBLE)"
    return f"make_date({year}, 1, 1) + CAST(floor(round({share} * {length} * 86400) / 86400) AS INT)"


oracle("decimal_year_date", f"SELECT series_key, t, value, {dated('t', 1995)} AS date FROM moves", "moves")
part(
    "centred",
    """SELECT series_key, t, value - avg(value) OVER (PARTITION BY series_key) AS x,
    count(*) OVER (PARTITION BY series_key) AS n FROM moves_diff2""",
    "moves_diff2",
)
part(
    "acf_rows",
    f"""SELECT a.series_key, lag, sum(a.x * b.x) / any_value(p.power) AS acf
  FROM (SELECT *, unnest(generate_series(1, {ACF_LAGS})) AS lag FROM centred) a
  JOIN centred b ON a.series_key = b.series_key AND b.t = a.t + a.lag
  JOIN (SELECT series_key, sum(x * x) AS power FROM centred GROUP BY 1) p ON a.series_key = p.series_key
  GROUP BY 1, 2""",
    "centred",
)
oracle("acf", f"SELECT series_key, CAST(lag AS INT) AS lag, {rounded('acf', 6)} AS acf FROM acf_rows", "acf_rows")
part("acf_lists", "SELECT series_key, list(acf ORDER BY lag) AS r FROM acf_rows GROUP BY 1", "acf_rows")
part(
    "levinson",
    """SELECT series_key, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS v, CAST(NULL AS DOUBLE) AS p, r
    FROM acf_lists
  UNION ALL
  SELECT series_key, k + 1, list_append(list_transform(phi, lambda a, i: a - q * phi[k + 1 - i]), q), v * (1 - q * q), q, r
  FROM (SELECT *, (r[k + 1] - coalesce(list_sum(list_transform(phi, lambda a, i: a * r[k + 1 - i])), 0)) / v AS q
    FROM levinson WHERE k < len(r))""",
    "acf_lists",
)
oracle(
    "pacf",
    f"SELECT series_key, k AS lag, {rounded('p', 6)} AS pacf FROM levinson WHERE k > 0",
    "levinson",
)
def power_transform(name: str, source: str) -> None:
    """Parts ``<name>_lambdas`` (exponent per series) and ``name`` (the series with ``lam`` and ``z``)."""
    part(
        f"{name}_blocks",
        f"""SELECT series_key, b, avg(value) AS m, stddev_samp(value) AS s FROM (
    SELECT *, (max(t) OVER (PARTITION BY series_key) - t) // 7 AS b FROM {source})
  GROUP BY ALL HAVING count(value) = 7 AND avg(value) > 0""",
        source,
    )
    part(
        f"{name}_spread",
        f"""SELECT series_key, lam, stddev_samp(s / pow(m, 1 - lam)) / avg(s / pow(m, 1 - lam)) AS cv
  FROM {name}_blocks, (SELECT round(-1 + i * CAST(0.1 AS DOUBLE), 6) AS lam FROM generate_series(0, 30) g(i))
  GROUP BY 1, 2""",
        f"{name}_blocks",
    )
    part(
        f"{name}_lambdas",
        f"""SELECT series_key, lam, cv FROM {name}_spread WHERE cv IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY series_key ORDER BY cv, lam) = 1""",
        f"{name}_spread",
    )
    part(
        name,
        f"""SELECT s.*, CASE WHEN lam = 1 THEN value WHEN value > 0 THEN
    CASE WHEN lam = 0 THEN ln(value) ELSE (pow(value, lam) - 1) / lam END END AS z
  FROM (SELECT series_key, t, date, value, coalesce(lam, 1) AS lam
    FROM {source} LEFT JOIN {name}_lambdas USING (series_key)) s""",
        source, f"{name}_lambdas",
    )


power_transform("scaled", "co2_series")
oracle(
    "boxcox_lambda",
    f"SELECT series_key, {rounded('lam', 6)} AS lam, {rounded('cv', 8)} AS cv FROM scaled_lambdas",
    "scaled_lambdas",
)
part(
    "spiked",
    """SELECT series_key, t, date, 1.0 AS lam,
    CASE WHEN day(date) = 1 THEN value * 10 + 100 ELSE value END AS value,
    CASE WHEN day(date) = 1 THEN value * 10 + 100 ELSE value END AS z FROM moves""",
    "moves",
)


def cleaned(name: str, source: str) -> None:
    """Parts for cleaning the scaled series ``source``; ``name`` holds the result."""
    part(
        f"{name}_levels",
        f"""SELECT *, max(t) OVER (PARTITION BY series_key) AS n,
    median(z) OVER (PARTITION BY series_key ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l FROM {source}""",
        source,
    )
    part(
        f"{name}_rest",
        f"""SELECT *, z - level - median(z - level) OVER (PARTITION BY series_key, t % 7) AS rest
  FROM (SELECT series_key, t, date, value, lam, z, CASE WHEN t < t_first THEN l_first WHEN t > t_last THEN l_last ELSE l END
      AS level
    FROM {name}_levels LEFT JOIN (SELECT series_key, min(t) AS t_first, arg_min(l, t) AS l_first, max(t) AS t_last,
      arg_max(l, t) AS l_last FROM {name}_levels WHERE t > 3 AND t <= n - 3 GROUP BY 1) USING (series_key))""",
        f"{name}_levels",
    )
    part(
        f"{name}_flags",
        f"""SELECT r.*, coalesce(rest < q1 - 3 * (q3 - q1) OR rest > q3 + 3 * (q3 - q1), false) AS is_outlier
  FROM {name}_rest r JOIN (SELECT series_key, quantile_cont(rest, 0.25) AS q1, quantile_cont(rest, 0.75) AS q3
    FROM {name}_rest GROUP BY 1) q ON r.series_key = q.series_key""",
        f"{name}_rest",
    )
    back = "ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    ahead = "ORDER BY t DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    good = "CASE WHEN NOT is_outlier AND z IS NOT NULL THEN {} END"

    def nearest(column: str, frame: str) -> str:
        return f"last_value({good.format(column)} IGNORE NULLS) OVER (PARTITION BY series_key {frame})"

    part(
        f"{name}_near",
        f"""SELECT *, {nearest('t', back)} AS t0, {nearest('z', back)} AS z0,
    {nearest('t', ahead)} AS t1, {nearest('z', ahead)} AS z1 FROM {name}_flags""",
        f"{name}_flags",
    )
    part(
        name,
        f"""SELECT series_key, t, date, value, is_outlier, CASE WHEN NOT is_outlier THEN value WHEN lam = 1 THEN filled
    WHEN lam = 0 THEN exp(filled) ELSE pow(greatest(lam * filled + 1, 0), 1 / lam) END AS cleaned
  FROM (SELECT *, coalesce(z0 + (z1 - z0) / (t1 - t0) * (t - t0), z0, z1) AS filled FROM {name}_near)""",
        f"{name}_near",
    )


cleaned("tidy", "scaled")
cleaned("tidy_spiked", "spiked")
oracle(
    "series_clean",
    f"SELECT series_key, t, date, value, is_outlier, {rounded('cleaned', 0)} AS cleaned FROM tidy",
    "tidy",
)
oracle("series_clean_spikes", "SELECT * FROM tidy_spiked", "tidy_spiked")
part("ends", "SELECT series_key, max(t) AS last FROM train GROUP BY 1", "train")
part(
    "real",
    """SELECT series_key, t, value FROM train UNION ALL
  SELECT series_key, CAST(t + coalesce(last, 0) AS INT) AS t, value FROM actual LEFT JOIN ends USING (series_key)""",
    "train", "actual", "ends",
)
oracle("series_concat", "SELECT * FROM real", "real")
part("train_lists", "SELECT series_key, list(value ORDER BY t) AS y FROM train GROUP BY 1", "train")
part(
    "naive",
    """SELECT series_key, y, 0 AS h FROM train_lists
  UNION ALL SELECT series_key, list_append(y, y[-1] + y[-7] - y[-8]), h + 1 FROM naive WHERE h < 365""",
    "train_lists",
)
part(
    "planned",
    """SELECT series_key, t, value FROM train UNION ALL
  SELECT series_key, CAST(last + h AS INT) AS t, y[-1] AS value FROM naive JOIN ends USING (series_key) WHERE h > 0""",
    "train", "naive", "ends",
)
oracle(
    "forecast_vs_actual",
    f"""SELECT series_key, date, data_source, value / 1000 AS CO2 FROM (
  SELECT p.series_key, p.date, r.value AS real, p.value AS forecast
  FROM (SELECT *, {dated('t', 1998)} AS date FROM planned) p
  LEFT JOIN (SELECT *, {dated('t', 1998)} AS date FROM real) r ON p.series_key = r.series_key AND p.date = r.date)
UNPIVOT INCLUDE NULLS (value FOR data_source IN (real, forecast))
WHERE date BETWEEN DATE '1999-06-01' AND DATE '2000-04-20'""",
    "planned", "real",
)

# order-two autoregression of first differences, standardised as the Spark side does it
part(
    "steps",
    """SELECT * FROM (SELECT series_key, t, value - lag(value) OVER (PARTITION BY series_key ORDER BY t) AS x FROM moves)
  WHERE x IS NOT NULL""",
    "moves",
)
part("steps_mean", "SELECT series_key, avg(x) AS mu, count(*) + 1 AS n FROM steps GROUP BY 1", "steps")
part(
    "steps_scale",
    """SELECT series_key, mu, any_value(n) AS n, sqrt(avg(pow(x - mu, 2))) AS sd
  FROM steps JOIN steps_mean USING (series_key)
  GROUP BY ALL""",
    "steps", "steps_mean",
)
part(
    "lagged",
    """SELECT * FROM (SELECT series_key, (x - mu) / sd AS z0, lag(z0) OVER w AS z1, lag(z0, 2) OVER w AS z2
    FROM steps JOIN steps_scale USING (series_key) WINDOW w AS (PARTITION BY series_key ORDER BY t))
  WHERE z2 IS NOT NULL""",
    "steps", "steps_scale",
)
part(
    "ar_matrix",
    """SELECT series_key, [[1.0, avg(z1), avg(z2), avg(z0)], [avg(z1), avg(z1 * z1), avg(z1 * z2), avg(z1 * z0)],
    [avg(z2), avg(z2 * z1), avg(z2 * z2), avg(z2 * z0)]] AS m FROM lagged GROUP BY 1""",
    "lagged",
)
gauss_jordan("ar_solved", "ar_matrix", "series_key", 3)
part(
    "ar_fit",
    """SELECT series_key, CAST(n AS INT) AS n, c[1] * sd + mu * (1 - c[2] - c[3]) AS constant, c[2] AS ar_1, c[3] AS ar_2
  FROM ar_solved JOIN steps_scale USING (series_key)""",
    "ar_solved", "steps_scale",
)
oracle(
    "sarima_fit",
    f"""SELECT series_key, n, {rounded('constant', 8)} AS constant, {rounded('ar_1', 8)} AS ar_1,
  {rounded('ar_2', 8)} AS ar_2 FROM ar_fit""",
    "ar_fit",
)
part(
    "ar_path",
    """SELECT series_key, 0 AS h, y[-1] AS y, y[-1] - y[-2] AS x1, y[-2] - y[-3] AS x2
    FROM (SELECT series_key, list(value ORDER BY t) AS y FROM moves GROUP BY 1)
  UNION ALL
  SELECT series_key, h + 1, y + constant + ar_1 * x1 + ar_2 * x2, constant + ar_1 * x1 + ar_2 * x2, x1
  FROM ar_path JOIN ar_fit USING (series_key) WHERE h < 60""",
    "ar_fit", "moves",
)
oracle(
    "sarima_forecast",
    f"SELECT series_key, h AS t, {rounded('y', 6)} AS value FROM ar_path WHERE h > 0",
    "ar_path",
)

# --- seasonal models: two-stage least squares, written for the published orders ------------------


def two_stage(name: str, source: str, model, horizon: int) -> None:
    """Parts ``<name>_fit`` (``c``: solved coefficients) and ``<name>_path`` (forecasts) of a model on a series."""
    order, ar, ma = model.long_order, model.ar_lags, model.ma_lags
    part(
        f"{name}_y",
        f"SELECT series_key, list(value ORDER BY t) AS y FROM {source} GROUP BY 1",
        source,
    )
    x = "y"
    for lag in model.difference_lags:
        x = f"list_transform(list_zip(({x})[{lag + 1}:], ({x})[:len({x}) - {lag}]), lambda p: p[1] - p[2])"
    part(f"{name}_x", f"SELECT series_key, y, {x} AS x FROM {name}_y", f"{name}_y")
    centre = "list_avg(x)" if model.constant else "CAST(0 AS DOUBLE)"
    part(f"{name}_mu", f"SELECT *, {centre} AS mu FROM {name}_x", f"{name}_x")
    part(
        f"{name}_sd",
        f"SELECT *, sqrt(list_avg(list_transform(x, lambda v: (v - mu) * (v - mu)))) AS sd FROM {name}_mu",
        f"{name}_mu",
    )
    part(
        f"{name}_z",
        f"SELECT *, list_transform(x, lambda v: (v - mu) / sd) AS z FROM {name}_sd",
        f"{name}_sd",
    )
    part(
        f"{name}_rows",
        f"""SELECT series_key, unnest(generate_series(1, len(z))) AS t, unnest(z) AS z0 FROM {name}_z""",
        f"{name}_z",
    )
    part(
        f"{name}_acf",
        f"""SELECT series_key, list(r ORDER BY lag) AS r FROM (
    SELECT a.series_key, lag, sum(a.z0 * b.z0) / any_value(p.power) AS r
    FROM (SELECT *, unnest(generate_series(1, {order})) AS lag FROM {name}_rows) a
    JOIN {name}_rows b ON a.series_key = b.series_key AND b.t = a.t + a.lag
    JOIN (SELECT series_key, sum(z0 * z0) AS power FROM {name}_rows GROUP BY 1) p ON a.series_key = p.series_key
    GROUP BY 1, 2) GROUP BY 1""",
        f"{name}_rows",
    )
    part(
        f"{name}_levinson",
        f"""SELECT series_key, 0 AS k, CAST([] AS DOUBLE[]) AS phi, CAST(1 AS DOUBLE) AS v, r FROM {name}_acf
    UNION ALL
    SELECT series_key, k + 1, list_append(list_transform(phi, lambda a, i: a - q * phi[k + 1 - i]), q), v * (1 - q * q), r
    FROM (SELECT *, (r[k + 1] - coalesce(list_sum(list_transform(phi, lambda a, i: a * r[k + 1 - i])), 0)) / v AS q
      FROM {name}_levinson WHERE k < {order})""",
        f"{name}_acf",
    )
    part(
        f"{name}_e",
        f"""SELECT series_key, y, x, z, mu, sd, list_transform(z, lambda v, t: CASE WHEN t > {order} THEN
    v - list_sum(list_transform(phi, lambda f, i: f * z[t - i])) END) AS e
  FROM {name}_z JOIN (SELECT series_key, phi FROM {name}_levinson WHERE k = {order}) USING (series_key)""",
        f"{name}_z", f"{name}_levinson",
    )
    start = max([*ar, *(lag + order for lag in ma)])
    past = [f"z[t - {lag}]" for lag in ar] + [f"e[t - {lag}]" for lag in ma]
    terms = (["CAST(1 AS DOUBLE)"] if model.constant else []) + past
    part(
        f"{name}_design",
        f"""SELECT series_key, [{', '.join(terms)}, z[t]] AS d
  FROM (SELECT *, unnest(generate_series({start + 1}, len(z))) AS t FROM {name}_e)""",
        f"{name}_e",
    )
    size = len(terms)
    rows = ", ".join(
        "[" + ", ".join(f"avg(d[{i + 1}] * d[{j + 1}])" for j in range(size + 1)) + "]" for i in range(size)
    )
    part(f"{name}_matrix", f"SELECT series_key, [{rows}] AS m FROM {name}_design GROUP BY 1", f"{name}_design")
    gauss_jordan(f"{name}_solved", f"{name}_matrix", "series_key", size)
    first = 1 if model.constant else 0
    ar_sum = " + ".join(f"c[{first + i + 1}]" for i in range(len(ar))) or "0"
    constant = f"c[1] * sd + mu * (1 - ({ar_sum}))" if model.constant else "CAST(0 AS DOUBLE)"
    part(
        f"{name}_fit",
        f"""SELECT series_key, len(y) AS n, {constant} AS constant, c[{first + 1}:] AS b, y, x,
    list_transform(e, lambda v: v * sd) AS e FROM {name}_e JOIN {name}_solved USING (series_key)""",
        f"{name}_e", f"{name}_solved",
    )
    step = "constant" + "".join(f" + b[{i + 1}] * x[-{lag}]" for i, lag in enumerate(ar))
    step += "".join(f" + b[{len(ar) + i + 1}] * e[-{lag}]" for i, lag in enumerate(ma))
    level = "nx" + "".join(f" - ({weight}) * y[-{lag}]" for lag, weight in model.weights.items())
    keep = max([*ar, *ma, *model.weights]) + 1
    part(
        f"{name}_path",
        f"""SELECT series_key, 0 AS h, constant, b, y[-{keep}:] AS y, x[-{keep}:] AS x, e[-{keep}:] AS e FROM {name}_fit
    UNION ALL
    SELECT series_key, h + 1, constant, b, list_append(y, {level})[2:], list_append(x, nx)[2:], list_append(e, 0)[2:]
    FROM (SELECT *, {step} AS nx FROM {name}_path WHERE h < {horizon})""",
        f"{name}_fit",
    )


two_stage("seasonal", "moves", MOVEMENTS, 0)
_lags = [f"ar_{lag}" for lag in MOVEMENTS.ar_lags] + [f"ma_{lag}" for lag in MOVEMENTS.ma_lags]
oracle(
    "sarima_fit_seasonal",
    f"SELECT series_key, CAST(n AS INT) AS n, {rounded('constant', 6)} AS constant, "
    + ", ".join(f"{rounded(f'b[{i + 1}]', 6)} AS {lag}" for i, lag in enumerate(_lags))
    + " FROM seasonal_fit",
    "seasonal_fit",
)


def forecast_report(query: str, measure: str, model, value: str, divisor: int, digits: int) -> None:
    """Twin of a published forecast: daily table, cleaning, fit, path, comparison."""
    for stage, bounds in (("train", ("1998-01-01", "1999-12-31")), ("actual", ("2000-01-01", "2000-12-31"))):
        name = f"{query}_{stage}"
        part(
            f"{name}_raw",
            f"""SELECT 'all' AS series_key, flight_day AS date, CAST({measure} AS DOUBLE) AS value,
    CAST(row_number() OVER (ORDER BY flight_day) AS INT) AS t FROM days_only
  WHERE flight_day BETWEEN DATE '{bounds[0]}' AND DATE '{bounds[1]}' GROUP BY flight_day""",
            "days_only",
        )
        power_transform(f"{name}_power", f"{name}_raw")
        cleaned(f"{name}_tidy", f"{name}_power")
        part(name, f"SELECT series_key, t, date, cleaned AS value FROM {name}_tidy", f"{name}_tidy")
    two_stage(query, f"{query}_train", model, 365)
    train, actual = f"{query}_train", f"{query}_actual"
    last = f"(SELECT max(t) FROM {train})"
    part(
        f"{query}_planned",
        f"""SELECT series_key, t, value FROM {train} UNION ALL
  SELECT series_key, CAST({last} + h AS INT), y[-1] FROM {query}_path WHERE h > 0""",
        train, f"{query}_path",
    )
    part(
        f"{query}_real",
        f"""SELECT series_key, t, value FROM {train} UNION ALL
  SELECT series_key, CAST({last} + t AS INT), value FROM {actual}""",
        train, actual,
    )
    oracle(
        query,
        f"""SELECT series_key, date, data_source, {rounded(f'value / {divisor}', digits)} AS {value} FROM (
  SELECT p.series_key, p.date, r.value AS real, p.value AS forecast
  FROM (SELECT *, {dated('t', 1998)} AS date FROM {query}_planned) p
  LEFT JOIN (SELECT *, {dated('t', 1998)} AS date FROM {query}_real) r USING (series_key, date))
UNPIVOT INCLUDE NULLS (value FOR data_source IN (real, forecast)) WHERE date >= DATE '1999-06-01'""",
        f"{query}_planned", f"{query}_real",
    )


forecast_report("movements_forecast", "count(*)", MOVEMENTS, "ATM", 1, 4)
forecast_report("co2_forecast", "sum(co2)", CO2, "CO2", 1000, 1)

# --- tests, likelihood and decomposition of series -----------------------------------------------

part(
    "lik_w",
    """SELECT series_key, row_number() OVER (PARTITION BY series_key ORDER BY t) AS k, w FROM (
    SELECT series_key, t, c - 0.3 * lag(c) OVER s + 0.1 * lag(c, 2) OVER s AS w
    FROM (SELECT series_key, t, x - mu AS c FROM steps JOIN steps_mean USING (series_key))
    WINDOW s AS (PARTITION BY series_key ORDER BY t)) WHERE w IS NOT NULL""",
    "steps", "steps_mean",
)
part(
    "lik_path",
    """SELECT series_key, CAST(0 AS BIGINT) AS k, CAST(0 AS DOUBLE) AS e1, CAST(0 AS DOUBLE) AS e2, CAST(0 AS DOUBLE) AS e3,
    CAST(0 AS DOUBLE) AS e4, CAST(0 AS DOUBLE) AS e5, CAST(0 AS DOUBLE) AS e6, CAST(0 AS DOUBLE) AS e7, CAST(0 AS DOUBLE) AS e8
  FROM steps_mean
  UNION ALL
  SELECT p.series_key, p.k + 1, w - 0.4 * e1 - 0.2 * e7 - 0.08 * e8, e1, e2, e3, e4, e5, e6, e7
  FROM lik_path p JOIN lik_w w ON w.series_key = p.series_key AND w.k = p.k + 1""",
    "lik_w", "steps_mean",
)
part("lik_e", "SELECT series_key, k, e1 AS e FROM lik_path WHERE k > 0", "lik_path")
part(
    "lik_sum",
    """SELECT *, -0.5 * used * (ln(2 * pi() * sigma2) + 1) AS loglik
  FROM (SELECT series_key, count(*) AS used, avg(e * e) AS sigma2 FROM lik_e GROUP BY 1)""",
    "lik_e",
)
oracle(
    "sarima_likelihood",
    f"""SELECT series_key, CAST(used AS INT) AS used, {rounded('sigma2', 6)} AS sigma2, {rounded('loglik', 6)} AS loglik,
  {rounded('14 - 2 * loglik', 6)} AS aic, {rounded('14 - 2 * loglik + 112 / (used - 8.0)', 6)} AS aicc,
  {rounded('7 * ln(used) - 2 * loglik', 6)} AS bic FROM lik_sum""",
    "lik_sum",
)
part(
    "lb_r",
    """SELECT a.series_key, lag, any_value(n) AS n, sum(a.c * b.c) / any_value(power) AS r
  FROM (SELECT series_key, k, e - avg(e) OVER (PARTITION BY series_key) AS c, unnest(generate_series(1, 20)) AS lag FROM lik_e) a
  JOIN (SELECT series_key, k, e - avg(e) OVER (PARTITION BY series_key) AS c FROM lik_e) b
    ON a.series_key = b.series_key AND b.k = a.k + a.lag
  JOIN (SELECT series_key, count(*) AS n, sum(e * e) - sum(e) * sum(e) / count(*) AS power FROM lik_e GROUP BY 1) p
    ON a.series_key = p.series_key
  GROUP BY 1, 2""",
    "lik_e",
)
part(
    "lb_q",
    """SELECT series_key, lag, r, greatest(lag - 5, 0) AS freedom,
    n * (n + 2) * sum(r * r / (n - lag)) OVER (PARTITION BY series_key ORDER BY lag) AS statistic FROM lb_r""",
    "lb_r",
)
# the lower incomplete gamma function by its power series; far beyond the shape the tail is 0 to all digits shown
LOWER = (
    "list_sum(list_transform(range(800), lambda i: exp(-statistic / 2 + (freedom / 2.0 + i) * ln(statistic / 2)"
    " - lgamma(freedom / 2.0 + i + 1))))"
)
oracle(
    "ljung_box",
    f"""SELECT series_key, CAST(lag AS INT) AS lag, {rounded('r', 8)} AS r, {rounded('statistic', 6)} AS statistic,
  CAST(freedom AS INT) AS freedom, CASE WHEN freedom >= 1 THEN CASE WHEN statistic > 500 THEN 0.0
    ELSE {rounded(f'greatest(0.0, 1 - {LOWER})', 8)} END END AS p_value FROM lb_q""",
    "lb_q",
)
part(
    "kp_c",
    """SELECT series_key, d, row_number() OVER (PARTITION BY series_key, d ORDER BY t) AS k,
    y - avg(y) OVER (PARTITION BY series_key, d) AS c, count(*) OVER (PARTITION BY series_key, d) AS n
  FROM (SELECT series_key, 0 AS d, t, value AS y FROM moves UNION ALL SELECT series_key, 1, t, x FROM steps)""",
    "moves", "steps",
)
part(
    "kp_walk",
    """SELECT series_key, d, any_value(n) AS n, sum(s * s) AS walk FROM (
    SELECT series_key, d, n, sum(c) OVER (PARTITION BY series_key, d ORDER BY k) AS s FROM kp_c) GROUP BY 1, 2""",
    "kp_c",
)
part(
    "kp_var",
    """SELECT series_key, d, any_value(most) AS lags,
    sum(cov * CASE WHEN lag = 0 THEN 1 ELSE 2 * (1 - lag / (most + 1.0)) END) AS variance FROM (
    SELECT a.series_key, a.d, a.lag, any_value(a.most) AS most, sum(a.c * b.c) / any_value(a.n) AS cov
    FROM (SELECT *, unnest(generate_series(0, most)) AS lag
      FROM (SELECT *, CAST(floor(4 * pow(n / 100.0, 0.25)) AS INT) AS most FROM kp_c)) a
    JOIN kp_c b ON a.series_key = b.series_key AND a.d = b.d AND b.k = a.k + a.lag GROUP BY 1, 2, 3) GROUP BY 1, 2""",
    "kp_c",
)
oracle(
    "kpss_levels",
    f"""SELECT series_key, d, CAST(n AS INT) AS n, lags, {rounded('walk / (n * n * variance)', 8)} AS statistic
  FROM kp_walk JOIN kp_var USING (series_key, d)""",
    "kp_walk", "kp_var",
)
part(
    "ar_sigma",
    """SELECT series_key, avg(e * e) AS sigma2 FROM (
    SELECT series_key, x - constant - ar_1 * lag(x) OVER w - ar_2 * lag(x, 2) OVER w AS e
    FROM steps JOIN ar_fit USING (series_key) WINDOW w AS (PARTITION BY series_key ORDER BY t)) GROUP BY 1""",
    "steps", "ar_fit",
)
part(
    "ar_psi",
    """SELECT series_key, 1 AS h, CAST(1 AS DOUBLE) AS p1, CAST(0 AS DOUBLE) AS p2, CAST(0 AS DOUBLE) AS p3, CAST(1 AS DOUBLE) AS total
  FROM ar_fit
  UNION ALL
  SELECT series_key, h + 1, (1 + ar_1) * p1 + (ar_2 - ar_1) * p2 - ar_2 * p3, p1, p2,
    total + pow((1 + ar_1) * p1 + (ar_2 - ar_1) * p2 - ar_2 * p3, 2)
  FROM ar_psi JOIN ar_fit USING (series_key) WHERE h < 60""",
    "ar_fit",
)
WIDTH = "1.959963984540054 * sqrt(sigma2 * total)"
oracle(
    "forecast_intervals",
    f"""SELECT series_key, h AS t, {rounded('y', 6)} AS value, {rounded('sqrt(sigma2 * total)', 6)} AS se,
  {rounded(f'y - {WIDTH}', 6)} AS low, {rounded(f'y + {WIDTH}', 6)} AS high
  FROM ar_path JOIN ar_psi USING (series_key, h) JOIN ar_sigma USING (series_key)""",
    "ar_path", "ar_psi", "ar_sigma",
)


def local_lines(name: str, source: str, span: int, beyond: int) -> None:
    """Part ``name`` (key, pt, v): local lines over ``source`` (key, place, y, n), up to ``beyond`` places outside it."""
    part(
        name,
        f"""SELECT key, pt, swy / sw + CASE WHEN swdd / sw - pow(swd / sw, 2) > pow(0.001 * greatest(1, n - 1), 2)
      THEN -swd / sw * (swdy / sw - swd / sw * swy / sw) / (swdd / sw - pow(swd / sw, 2)) ELSE 0 END AS v
  FROM (SELECT key, pt, n, sum(w) AS sw, sum(w * d) AS swd, sum(w * d * d) AS swdd, sum(w * y) AS swy, sum(w * d * y) AS swdy
    FROM (SELECT key, pt, n, y, place - pt AS d, CASE WHEN abs(place - pt) <= 0.001 * reach THEN 1
        WHEN abs(place - pt) > 0.999 * reach THEN 0 ELSE pow(1 - pow(abs(place - pt) / reach, 3), 3) END AS w
      FROM (SELECT *, greatest(pt - low, low + q - 1 - pt) + greatest(0, {span} - n) // 2 AS reach
        FROM (SELECT *, least(greatest(pt - {(span - 1) // 2}, 0), n - q) AS low
          FROM (SELECT key, n, least({span}, n) AS q, unnest(generate_series({-beyond}, n - 1 + {beyond})) AS pt
            FROM (SELECT DISTINCT key, n FROM {source})))) p
      JOIN (SELECT key AS k2, place, y FROM {source}) s ON k2 = key AND place BETWEEN low AND low + q - 1)
    GROUP BY 1, 2, 3)""",
        source,
    )


def moving(name: str, source: str, width: int) -> None:
    """Part ``name`` (key, i, v): means of ``width`` values of ``source`` in a row, from the first."""
    part(
        name,
        f"""SELECT key, i, v FROM (SELECT key, i, avg(v) OVER w AS v, count(*) OVER w AS have FROM {source}
    WINDOW w AS (PARTITION BY key ORDER BY i ROWS BETWEEN CURRENT ROW AND {width - 1} FOLLOWING)) WHERE have = {width}""",
        source,
    )


part("stl_y", "SELECT series_key, t, t - 1 AS k, value AS y, count(*) OVER (PARTITION BY series_key) AS n FROM moves", "moves")
part(
    "stl_sub",
    """SELECT {'s': series_key, 'p': k % 7} AS key, k // 7 AS place, y, count(*) OVER (PARTITION BY series_key, k % 7) AS n
  FROM stl_y""",
    "stl_y",
)
local_lines("stl_smooth", "stl_sub", 7, 1)
part("stl_cycle", "SELECT key.s AS key, key.p + (pt + 1) * 7 AS i, v FROM stl_smooth", "stl_smooth")
moving("stl_low1", "stl_cycle", 7)
moving("stl_low2", "stl_low1", 7)
moving("stl_low3", "stl_low2", 3)
part("stl_flat", "SELECT key, i AS place, v AS y, count(*) OVER (PARTITION BY key) AS n FROM stl_low3", "stl_low3")
local_lines("stl_low", "stl_flat", 7, 0)
part(
    "stl_season",
    """SELECT y.series_key, y.t, y.k, y.y, y.n, c.v - l.v AS seasonal FROM stl_y y
  JOIN stl_cycle c ON c.key = y.series_key AND c.i = y.k + 7 JOIN stl_low l ON l.key = y.series_key AND l.pt = y.k""",
    "stl_y", "stl_cycle", "stl_low",
)
part("stl_left", "SELECT series_key AS key, k AS place, y - seasonal AS y, n FROM stl_season", "stl_season")
local_lines("stl_trend", "stl_left", 15, 0)
oracle(
    "stl_pass",
    f"""SELECT series_key, t, {rounded('seasonal', 6)} AS seasonal, {rounded('v', 6)} AS trend,
  {rounded('y - seasonal - v', 6)} AS remainder FROM stl_season JOIN stl_trend ON key = series_key AND pt = k""",
    "stl_season", "stl_trend",
)
