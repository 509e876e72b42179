"""Named queries on the driver's tables, one per operator or report."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flightlens.functions import classify, nulls, scalars
from flightlens.operators import (
    aggregate, arima_ml, clean, correlation, diagnostics, enrich, polyfit, quantiles, reshape, sarima, series, smooth, stl, trend,
)
from flightlens.plans import emissions as em
from flightlens.plans import forecasts, prototype, reports
from flightlens.plans import standins as st
from flightlens.session import stored, stored_lookup

QUERIES = {}
YEAR = (date(1998, 1, 1), date(1998, 12, 31))
TRAIN = (date(1998, 1, 1), date(1999, 12, 31))
ACTUAL = (date(2000, 1, 1), date(2000, 12, 31))
ACF_LAGS = 365
SEASONAL_NAIVE = sarima.Sarima((0, 1, 0), (0, 1, 0), 7, with_constant=False)
SHORT_AR = sarima.Sarima((2, 1, 0), (0, 0, 0), 7)


def query(build):
    QUERIES[build.__name__] = build
    return build


def _days(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("date") for c in columns})


def _rounded(df: DataFrame, **digits: int) -> DataFrame:
    """Round below the noise of floating-point sums; adding zero turns -0.0 into 0.0."""
    return df.withColumns({c: F.round(c, n) + F.lit(0.0) for c, n in digits.items()})


# --- flights to emissions ------------------------------------------------------------------------


def _inputs(spark: SparkSession, d: str):
    aircraft = enrich.aircraft_lookup(st.aircraft(spark, d), st.fleet(spark, d))
    return st.flights(spark, d), st.airports(spark, d), stored_lookup(aircraft, "aircraft")


def _lookup(spark: SparkSession, d: str) -> DataFrame:
    return stored_lookup(em.fuel_lookup(stored(st.split_grid(spark, d), "grid"), st.fuel_rates(spark, d)), "fuel")


def _emissions(spark: SparkSession, d: str, form: str, lookup: DataFrame | None = None) -> DataFrame:
    return em.emissions(*_inputs(spark, d), _lookup(spark, d) if lookup is None else lookup, form)


def _emission_rows(df: DataFrame) -> DataFrame:
    shown = _days(df, "flight_day", "flight_firstseen").drop("flight_lastseen")
    return _rounded(shown, flight_distance=6, aircraft_fuelburn=1, CO2=1)


@query
def eu_flights(spark, d):
    """Flights from or to the region."""
    found = em.eu_flights(st.flights(spark, d), st.airports(spark, d))
    return _days(found, "day", "firstseen").withColumn("lastseen", F.col("lastseen").cast("string"))


@query
def airport_attributes(spark, d):
    """All airport columns at both ends."""
    found = prototype.located_flights(st.prototype_flights(spark, d), st.airports(spark, d))
    ends = [f"{role}_{a}" for role in ("departure", "arrival") for a in prototype.AIRPORT_ATTRIBUTES]
    return _days(_rounded(found, departure_longitude_deg=6, arrival_longitude_deg=6), "day").select(
        "icao24", "day", "origin", "destination", *ends
    )


@query
def flight_distance(spark, d):
    """Region flights with registration and great-circle distance."""
    found = em.enriched_flights(st.flights(spark, d), st.airports(spark, d), st.aircraft(spark, d))
    return _rounded(_days(found, "day", "firstseen").drop("lastseen"), distance=6)


@query
def fleet_dedup(spark, d):
    """Distinct flights with official type and role."""
    found = em.typed_flights(*_inputs(spark, d)).withColumn("flight_lastseen", F.col("flight_lastseen").cast("string"))
    return _rounded(_days(found, "flight_day", "flight_firstseen"), flight_distance=6)


@query
def null_safe_join(spark, d):
    """Registration by address, where an unknown address matches an unknown address."""
    flights = st.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("a"), F.nullif("l_partkey", F.lit(0))).alias("icao24")
    )
    aircraft = st.table(spark, d, "part").select(
        F.concat(F.lit("a"), F.nullif("p_partkey", F.lit(0))).alias("icao24"),
        F.concat(F.lit("R"), "p_partkey").alias("registration"),
    )
    return enrich.attach_registration(flights, aircraft)


@query
def fuel_fit(spark, d):
    """Cubic of price on quantity per part type, over all line items."""
    fitted = polyfit.fit_polynomial(st.observations(spark, d), "p_type", "l_quantity", "l_extendedprice")
    return _rounded(fitted, c0=4, c1=4, c2=5, c3=6)


@query
def fuel_fit_far(spark, d):
    """The same fit with quantities far from zero, where plain powers lose the answer.

    Coefficients of powers of x itself are large here and cancel; they are compared to seven to nine digits.
    """
    far = st.observations(spark, d).withColumn("l_quantity", F.col("l_quantity") + 1000)
    return _rounded(polyfit.fit_polynomial(far, "p_type", "l_quantity", "l_extendedprice"), c0=-2, c1=1, c2=4, c3=7)


@query
def fuel_fit_statistics(spark, d):
    """Residual error, explained share and standard errors of the cubic per part type."""
    found = polyfit.fit_statistics(st.observations(spark, d), "p_type", "l_quantity", "l_extendedprice")
    shown = found.select("p_type", "n", "freedom", "sigma", "r2", "adjusted_r2", "se0", "se1", "se2", "se3")
    return _rounded(shown, sigma=4, r2=8, adjusted_r2=8, se0=4, se1=5, se2=6, se3=7)


@query
def fuel_fit_predicted(spark, d):
    """The cubic's value at every quantity of a part type, with the errors of the mean and of a new value."""
    seen = st.observations(spark, d)
    model = polyfit.fit_statistics(seen, "p_type", "l_quantity", "l_extendedprice")
    at = seen.select("p_type", F.col("l_quantity").cast("double").alias("l_quantity")).distinct()
    return _rounded(polyfit.predict(at, model, "p_type", "l_quantity"), fitted=4, fit_error=4, prediction_error=4)


@query
def fuel_grid_fit(spark, d):
    """Cubic per type of the wide fuel grid."""
    return _rounded(em.fuel_model(st.fuel_grid(spark, d)), c0=4, c1=6, c2=9, c3=13)


@query
def emissions_as_written(spark, d):
    """CO2 per flight, polynomial without powers."""
    return _emission_rows(_emissions(spark, d, "as_written"))


@query
def emissions_cubic(spark, d):
    """CO2 per flight, true cubic."""
    return _emission_rows(_emissions(spark, d, "cubic"))


@query
def emissions_rate(spark, d):
    """CO2 of the flights whose type has a rate per mile."""
    rates = em.rate_table(st.fuel_rates(spark, d), st.split_grid(spark, d))
    blank = {c: F.lit(None).cast("double") for c in ("c0", "c1", "c2", "c3")}
    lookup = rates.withColumnsRenamed({"type": "aircraft_type", "fuelburn": "rate"}).withColumns(blank)
    return _emission_rows(_emissions(spark, d, "cubic", stored_lookup(lookup, "rates")))


@query
def emissions_union(spark, d):
    """Both fuel methods computed apart, united and made distinct; equal to the single lookup."""
    lookup = _lookup(spark, d)
    typed = em.typed_flights(*_inputs(spark, d))
    parts = [lookup.filter(F.col("rate").isNull()), lookup.filter(F.col("rate").isNotNull())]
    both = [em.with_emissions(enrich.only_types(typed, part), part, "as_written") for part in parts]
    return _emission_rows(reshape.bind_distinct(*both))


@query
def co2_day_role(spark, d):
    """Flagship: CO2 per day and role, from raw flights."""
    daily = reports.co2_day_role(_emissions(spark, d, "as_written"))
    return _rounded(_days(daily, "flight_day"), CO2_daily=0)


# --- dimensions and classification ---------------------------------------------------------------


@query
def unpivot_grid(spark, d):
    """Wide fuel grid to points, numbers from header text, empty cells dropped."""
    return reshape.grid_points(st.fuel_grid(spark, d))


@query
def unpivot_keep_nulls(spark, d):
    """Numbers of a customer as rows, empty ones kept."""
    wide = st.table(spark, d, "customer").select(
        F.col("c_custkey").alias("Type"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("100"),
        F.nullif("c_nationkey", F.lit(3)).cast("double").alias("200"),
    )
    return reshape.unpivot_all_but(wide, ["Type"], "distance", "fuelburn").withColumn(
        "distance", scalars.to_number(F.col("distance"))
    )


@query
def unpivot_named(spark, d):
    """Smallest and largest order of each customer as two rows."""
    limits = st.table(spark, d, "orders").groupBy("o_custkey").agg(
        F.min("o_totalprice").alias("min_price"), F.max("o_totalprice").alias("max_price")
    )
    return reshape.unpivot_named(limits, ["min_price", "max_price"], "price")


@query
def nest_grid(spark, d):
    """Fuel grid points gathered per type, shown as text."""
    nested = reshape.nest_points(reshape.grid_points(st.fuel_grid(spark, d)))
    point = lambda p: F.concat(
        p["distance"].cast("long").cast("string"), F.lit(":"), F.round(p["fuelburn"] * 100).cast("long").cast("string")
    )
    return nested.select("type", F.size("data").alias("n"), F.array_join(F.transform("data", point), " ").alias("points"))


@query
def pivot_wide(spark, d):
    """Order totals per status with one column per priority."""
    orders = st.table(spark, d, "orders").withColumn("price", st.cents("o_totalprice"))
    names = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    wide = reshape.pivot_wide(orders, ["o_orderstatus"], "o_orderpriority", names, F.sum("price"))
    return wide.toDF("o_orderstatus", "urgent", "high", "medium", "not_specified", "low")


@query
def select_prefix(spark, d):
    """Columns chosen by prefix in any case."""
    return reshape.select_prefix(st.table(spark, d, "part"), ["P_S", "p_TYPE"], ["p_partkey"])


@query
def rate_table(spark, d):
    """Highest rate of each type outside the fuel grid."""
    return em.rate_table(st.fuel_rates(spark, d), st.split_grid(spark, d))


@query
def group_max_rows(spark, d):
    """Dearest parts of each brand and size, ties kept; a group with an unknown price is dropped."""
    price = F.when(~((F.col("p_size") == 7) & (F.col("p_type") == "PROMO")), F.col("p_retailprice"))
    parts = st.table(spark, d, "part").select("p_partkey", "p_brand", "p_size", price.alias("price"))
    return clean.keep_group_max(parts, ["p_brand", "p_size"], "price")


@query
def rate_anti_join(spark, d):
    """Customers without a large pending order."""
    large = st.table(spark, d, "orders").filter((F.col("o_orderstatus") == "P") & (F.col("o_totalprice") > 300000))
    return enrich.unknown_to(st.table(spark, d, "customer").select("c_custkey", "c_name"), large, "c_custkey", "o_custkey")


@query
def regex_prefix(spark, d):
    """Rates of the types that begin with one of two prefixes."""
    rates = em.rate_table(st.fuel_rates(spark, d), st.split_grid(spark, d))
    return reports.selected_rates(rates, ["Brand#1", "Brand#20"])


@query
def type_override(spark, d):
    """Fuel grid points with manufacturer; a type with several manufacturers fans out, a constant map overrides."""
    points = reshape.grid_points(st.fuel_grid(spark, d))
    joined = points.join(enrich.type_manufacturers(st.fleet(spark, d)), "type", "left")
    overrides = {"Brand#1": "Avro", "Brand#2": "Boeing"}
    return joined.select(
        "type", classify.manufacturer(F.col("type"), F.col("manu"), overrides).alias("manu"), "distance", "fuelburn"
    )


@query
def grid_manufacturer(spark, d):
    """Report table of fuel grid points with manufacturer."""
    return reports.grid_with_manufacturer(st.fuel_grid(spark, d), st.fleet(spark, d))


@query
def role_map(spark, d):
    """Report role of every part's fleet role."""
    return st.fleet(spark, d).select(
        F.col("Tail/Registration Number").alias("registration"), F.col("Role").alias("fleet_role"),
        classify.role_label(F.col("Role")).alias("role"),
    )


@query
def unmapped_roles(spark, d):
    """Fleet roles without a report role."""
    return em.unmapped_roles(st.fleet(spark, d))


@query
def sentinel_null(spark, d):
    """A token that stands for a missing value becomes null."""
    return st.table(spark, d, "part").select(
        "p_partkey", nulls.sentinel_to_null(F.col("p_type"), "PROMO").alias("p_type")
    )


@query
def drop_nulls(spark, d):
    """Rows complete in one column, and rows complete in all."""
    orders = st.table(spark, d, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("priority"),
    )
    subset = clean.drop_na(orders, ["status"]).withColumn("rule", F.lit("status"))
    whole = clean.drop_na(orders).withColumn("rule", F.lit("all"))
    return subset.union(whole)


@query
def parse_timestamp(spark, d):
    """Times from ISO text, text with zone, epoch text and junk."""
    stamp = F.col("o_orderdate").cast("timestamp")
    text = (
        F.when(F.col("o_orderstatus") == "F", F.date_format(stamp, "yyyy-MM-dd HH:mm:ssXXX"))
        .when(F.col("o_orderstatus") == "O", F.unix_timestamp(stamp).cast("string"))
        .when(F.col("o_orderpriority") == "5-LOW", F.lit("no time"))
        .otherwise(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    )
    parsed = scalars.parse_timestamps(st.table(spark, d, "orders").select("o_orderkey", text.alias("seen")), ["seen"])
    return parsed.withColumn("seen", F.col("seen").cast("date"))


@query
def union_by_name(spark, d):
    """Two parts of the orders with different columns, bound by name."""
    orders = st.table(spark, d, "orders")
    final = F.col("o_orderstatus") == "F"
    return reshape.bind_rows(
        orders.filter(final).select("o_orderkey", "o_totalprice"),
        orders.filter(~final).select("o_totalprice", "o_orderpriority", "o_orderkey"),
    )


# --- prototype -----------------------------------------------------------------------------------


def _located(spark, d):
    return prototype.located_flights(st.prototype_flights(spark, d), st.airports(spark, d))


def _imputed(spark, d):
    return prototype.impute_types(_located(spark, d))


@query
def first_per_key(spark, d):
    """First order of each customer by date, with all its columns."""
    first = clean.first_per_key(st.table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return _days(first, "o_orderdate")


@query
def impute_coalesce(spark, d):
    """Type and registration filled in from the first complete flight of the callsign."""
    filled = _days(_imputed(spark, d), "day", "firstseen")
    return filled.select("icao24", "callsign", "day", "firstseen", "origin", "destination", "registration", "typecode")


@query
def unresolved_links(spark, d):
    """Lookup links of callsigns that stay without a type."""
    return prototype.lookup_links(prototype.unresolved_flights(_located(spark, d)))


@query
def unresolved_new(spark, d):
    """Unresolved callsigns an earlier lookup does not hold."""
    missing = prototype.unresolved_flights(_located(spark, d))
    return prototype.not_looked_up(missing, st.known_callsigns(spark, d)).select("callsign", "origin", "destination")


@query
def prototype_co2_day_role(spark, d):
    """Daily CO2 per fleet role from imputed flights."""
    model = stored_lookup(em.fuel_model(st.fuel_grid(spark, d)), "model")
    rows = prototype.prototype_emissions(_imputed(spark, d), st.fleet(spark, d), model, "as_written")
    return _rounded(_days(prototype.co2_per_day_and_role(rows), "day"), CO2=0)


# --- reports -------------------------------------------------------------------------------------


@query
def daily_co2(spark, d):
    return reports.daily_co2(st.daily_emissions(spark, d))


@query
def daily_outliers_removed(spark, d):
    """Daily CO2 per role without outliers."""
    return reports.daily_co2_by_role_clean(st.emissions(spark, d))


@query
def role_quartiles(spark, d):
    """Quartiles and interquartile range of daily CO2 per role."""
    daily = reports.co2_day_role(st.emissions(spark, d))
    q1, q3 = aggregate.quartiles(F.col("CO2_daily"))
    return daily.groupBy("aircraft_role").agg(q1.alias("q1"), q3.alias("q3"), (q3 - q1).alias("iqr"))


@query
def local_trend(spark, d):
    """Smoothed daily CO2 per role."""
    return _rounded(reports.role_trend(reports.co2_day_role(st.emissions(spark, d))), trend=0)


@query
def role_trend_loess(spark, d):
    """Nearest-neighbour local quadratic of one year's daily CO2 per role, with standard errors."""
    daily = clean.date_range(reports.co2_day_role(st.emissions(spark, d)), "flight_day", *YEAR)
    dated = daily.withColumn("x", F.unix_date(F.col("flight_day").cast("date")))
    return _rounded(trend.loess(dated, ["aircraft_role"], "x", "CO2_daily"), x=6, trend=0, error=0, sigma=0, freedom=6)


@query
def role_trend_spline(spark, d):
    """Penalised spline of all days' CO2 per role, with standard errors."""
    dated = reports.co2_day_role(st.emissions(spark, d)).withColumn("x", F.unix_date(F.col("flight_day").cast("date")))
    return trend.spline(dated, ["aircraft_role"], "x", "CO2_daily")


@query
def price_quantiles(spark, d):
    """Exact quartiles and extremes of all line prices per flag and status, without gathering a group."""
    lines = st.table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    found = quantiles.exact_quantiles(
        lines, ["l_returnflag", "l_linestatus"], "l_extendedprice", [0.0, 0.25, 0.5, 0.75, 0.99, 1.0], gathered=1000
    )
    return _rounded(found, quantile=6)


@query
def yearly_by_type(spark, d):
    """CO2 per type in one year, in 10^6 units, largest first."""
    return reports.co2_by_type(st.emissions(spark, d), *YEAR)


@query
def daily_count_sum(spark, d):
    """Flights and CO2 per day."""
    return reports.daily_flights_and_co2(st.daily_emissions(spark, d))


@query
def total_in_range(spark, d):
    return reports.total_co2(st.daily_emissions(spark, d), *YEAR)


@query
def date_filter_from(spark, d):
    orders = st.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return _days(clean.date_range(orders, "o_orderdate", start=ACTUAL[0]), "o_orderdate")


@query
def date_filter_or(spark, d):
    """A range whose bounds are joined by "or" keeps every known day."""
    orders = st.table(spark, d, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderdate").cast("date")).alias("day")
    )
    return clean.date_range(orders, "day", *TRAIN, combine="or")


@query
def sorted_rank(spark, d):
    """Place of each nation's balance within a segment, unknown balances last in both directions."""
    sums = st.table(spark, d, "customer").groupBy("c_mktsegment", "c_nationkey").agg(
        F.sum(st.cents("c_acctbal")).alias("balance")
    )
    sums = sums.withColumn("balance", F.when(F.col("c_nationkey") != 7, F.col("balance")))
    segment = Window.partitionBy("c_mktsegment")
    return sums.withColumns(
        {
            "place_up": F.row_number().over(segment.orderBy(*aggregate.ascending("balance", "c_nationkey"))),
            "place_down": F.row_number().over(segment.orderBy(*aggregate.descending("balance"), "c_nationkey")),
        }
    )


@query
def null_strict_sum(spark, d):
    """Sum per status and priority, unknown if one price is unknown."""
    orders = st.table(spark, d, "orders").select(
        "o_custkey", F.when(F.col("o_totalprice") < 490000, st.cents("o_totalprice")).alias("price")
    )
    return aggregate.sum_by(orders, ["o_custkey"], "price", "total")


# --- series --------------------------------------------------------------------------------------


def _role_series(spark, d):
    return series.daily_series(st.emissions(spark, d), "flight_day", "CO2", "aircraft_role")


def _movements(spark, d):
    return series.daily_series(st.emissions(spark, d), "flight_day", None, "aircraft_role")


def _train_and_actual(rows: DataFrame, value: str | None, key: str | None, cleaned: bool):
    """Daily series of both periods; the facts are read once, into a stored daily table."""
    both = clean.date_range(rows, "flight_day", TRAIN[0], ACTUAL[1])
    daily = stored(series.daily_series(both, "flight_day", value, key), "daily")
    prepare = forecasts.cleaned_series if cleaned else lambda part: part
    return [prepare(series.period(daily, *bounds)) for bounds in (TRAIN, ACTUAL)]


@query
def series_index(spark, d):
    """Daily series per role, numbered without filling gaps."""
    return _role_series(spark, d)


@query
def series_truncate(spark, d):
    """Two years and one day of each series."""
    return series.truncate(_role_series(spark, d), 1995, 1997)


@query
def co2_series_as_written(spark, d):
    """Daily CO2 whose bounds are joined by "or" and which is cut at the decimal year after them: 731 days."""
    daily = series.daily_series(st.daily_emissions(spark, d), "flight_day", "CO2")
    return series.truncate(series.period(daily, *TRAIN, combine="or"), TRAIN[0].year, TRAIN[1].year + 1)


@query
def series_diff2(spark, d):
    return series.difference(_role_series(spark, d), [1, 1])


@query
def series_logdiff2(spark, d):
    return _rounded(series.difference(_movements(spark, d), [1, 1], log=True), value=8)


@query
def decimal_year_date(spark, d):
    """Dates from positions by way of the decimal year."""
    return series.with_decimal_dates(_movements(spark, d).drop("date"), 1995)


@query
def acf(spark, d):
    """Autocorrelation of twice differenced log movements."""
    changes = series.difference(_movements(spark, d), [1, 1], log=True)
    return _rounded(correlation.autocorrelation(changes, ACF_LAGS), acf=6)


@query
def pacf(spark, d):
    """Partial autocorrelation of twice differenced log movements."""
    changes = series.difference(_movements(spark, d), [1, 1], log=True)
    return _rounded(correlation.correlogram(changes, ACF_LAGS).drop("acf"), pacf=6)


@query
def boxcox_lambda(spark, d):
    return _rounded(smooth.boxcox_lambda(_role_series(spark, d), 7), cv=8)


@query
def series_clean(spark, d):
    """Outliers of daily CO2 replaced, on the scale of the chosen power transform."""
    raw = stored(_role_series(spark, d), "daily")
    cleaned = smooth.clean_series(raw, smooth.boxcox_lambda(raw, 7))
    return _rounded(cleaned, cleaned=0)


@query
def series_clean_spikes(spark, d):
    """Outliers on the plain scale, with the first day of each month raised tenfold beforehand."""
    raw = _movements(spark, d)
    spiked = F.when(F.dayofmonth("date") == 1, F.col("value") * 10 + 100).otherwise(F.col("value"))
    return smooth.clean_series(raw.withColumn("value", spiked))


@query
def series_concat(spark, d):
    """Second period continues the positions of the first."""
    return series.concat(*_train_and_actual(st.emissions(spark, d), "CO2", "aircraft_role", False))


@query
def forecast_vs_actual(spark, d):
    """Forecast by differences alone against the next year."""
    train, actual = _train_and_actual(st.emissions(spark, d), "CO2", "aircraft_role", False)
    return forecasts.forecast_vs_actual(
        train, actual, SEASONAL_NAIVE, 1998, value="CO2", divisor=1000.0,
        shown_from=date(1999, 6, 1), shown_to=date(2000, 4, 20),
    )


def _coefficients(fitted: DataFrame, model: sarima.Sarima) -> DataFrame:
    named = [F.get("ar", F.lit(i)).alias(f"ar_{lag}") for i, lag in enumerate(model.ar_lags)]
    named += [F.get("ma", F.lit(i)).alias(f"ma_{lag}") for i, lag in enumerate(model.ma_lags)]
    return fitted.select("series_key", "n", "constant", *named)


@query
def sarima_fit(spark, d):
    """Autoregression of order two on first differences, with constant."""
    fitted = _coefficients(sarima.fit(_movements(spark, d), SHORT_AR), SHORT_AR)
    return _rounded(fitted, constant=8, ar_1=8, ar_2=8)


@query
def sarima_forecast(spark, d):
    """Forecast of the order-two autoregression for 60 days."""
    return _rounded(sarima.forecast(sarima.fit(_movements(spark, d), SHORT_AR), SHORT_AR, 60), value=6)


@query
def sarima_fit_seasonal(spark, d):
    """All coefficients of the published movements model."""
    model = forecasts.MOVEMENTS
    fitted = _coefficients(sarima.fit(_movements(spark, d), model), model)
    return _rounded(fitted, **{c: 6 for c in fitted.columns if c not in ("series_key", "n")})


@query
def movements_forecast(spark, d):
    """Daily movements: published model against the next year."""
    train, actual = _train_and_actual(st.daily_emissions(spark, d), None, None, True)
    table = forecasts.forecast_vs_actual(
        train, actual, forecasts.MOVEMENTS, 1998, value="ATM", shown_from=date(1999, 6, 1)
    )
    return _rounded(table, ATM=4)


@query
def co2_forecast(spark, d):
    """Daily CO2 in thousands: published model against the next year."""
    train, actual = _train_and_actual(st.daily_emissions(spark, d), "CO2", None, True)
    table = forecasts.forecast_vs_actual(
        train, actual, forecasts.CO2, 1998, value="CO2", divisor=1000.0, shown_from=date(1999, 6, 1)
    )
    return _rounded(table, CO2=1)


# Weights of the past at which the likelihood is computed; a seasonal moving average, multiplied out.
GIVEN_AR, GIVEN_MA = {1: 0.3, 2: -0.1}, {1: 0.4, 7: 0.2, 8: 0.08}
GIVEN = sarima.Sarima((2, 1, 1), (0, 0, 1), 7)


def _given_likelihood(spark, d):
    return diagnostics.conditional_likelihood(_movements(spark, d), GIVEN, GIVEN_AR, GIVEN_MA)


@query
def sarima_likelihood(spark, d):
    """Conditional likelihood and criteria of a given seasonal model, per role."""
    return _rounded(_given_likelihood(spark, d).drop("e"), sigma2=6, loglik=6, aic=6, aicc=6, bic=6)


@query
def ljung_box(spark, d):
    """Ljung-Box test of the errors of that model for each lag."""
    return _rounded(diagnostics.ljung_box(_given_likelihood(spark, d), 20, fitted=5), r=8, statistic=6, p_value=8)


@query
def kpss_levels(spark, d):
    """Level test of daily movements and of their differences."""
    daily = stored(_movements(spark, d), "daily")
    both = [diagnostics.kpss(daily, k).withColumn("d", F.lit(k)) for k in (0, 1)]
    return _rounded(both[0].unionByName(both[1]), statistic=8)


@query
def forecast_intervals(spark, d):
    """Forecast of the order-two autoregression with standard errors and 95 % intervals."""
    fitted = sarima.fit(_movements(spark, d), SHORT_AR)
    past = lambda v, i: v - F.col("constant") - F.get("ar", F.lit(0)) * F.get("x", i - 1) - F.get("ar", F.lit(1)) * F.get("x", i - 2)
    errors = F.filter(F.transform("x", past), lambda v: v.isNotNull())
    sigma2 = F.aggregate(errors, F.lit(0.0), lambda s, v: s + v * v) / F.size(errors)
    ahead = arima_ml.forecast_intervals(fitted.withColumn("sigma2", sigma2), SHORT_AR, 60)
    return _rounded(ahead, value=6, se=6, low=6, high=6)


@query
def stl_pass(spark, d):
    """One pass of the seasonal-trend decomposition of daily movements by week."""
    parts = stl.stl(_movements(spark, d), 7, seasonal_span=7, inner=1).drop("value", "weight")
    return _rounded(parts, seasonal=6, trend=6, remainder=6)


@query
def series_clean_decomposed(spark, d):
    """Outliers of daily CO2 found after a weekly season and a smooth of variable span are taken off."""
    raw = stored(_role_series(spark, d), "daily")
    return _rounded(stl.clean_by_decomposition(raw, 7, smooth.boxcox_lambda(raw, 7)), cleaned=0)
