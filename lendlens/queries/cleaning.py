from pyspark.sql import functions as F

from lendlens import codes
from lendlens.functions import lending as L, numbers as N, text as X
from lendlens.operators import cleaning, enrich, features, profiling, quality
from lendlens.operators.schema import enforce_schema, infer_numeric
from lendlens.plans import staging
from lendlens.queries.registry import query
from lendlens.queries.standin import LOANS, RACE, digits, loans, table
from lendlens.sources import responses

ID = "loan_application_id"


@query(
    "surrogate_key",
    LOANS
    + """SELECT loan_application_id, md5(CAST(activity_year AS VARCHAR) || '-' || lender_entity_name || '-' || state_code
      || '-' || coalesce(applicant_sex_category, '') || '-' || CAST(loan_amount AS VARCHAR)) AS k FROM loans""",
)
def _(spark, sf):
    parts = ["activity_year", "lender_entity_name", "state_code", "applicant_sex_category", "loan_amount"]
    return loans(spark, sf).select(ID, X.surrogate_key(parts).alias("k"))


@query(
    "code_decode",
    """WITH d AS (SELECT 'nation' AS column_name, n_nationkey + 5 AS category_value, n_name AS category_title FROM nation
      UNION ALL SELECT 'region', r_regionkey, r_name FROM region)
    SELECT c_custkey, n.category_title AS nation_name, r.category_title AS region_name
    FROM customer LEFT JOIN d n ON n.column_name = 'nation' AND c_nationkey = n.category_value
    LEFT JOIN d r ON r.column_name = 'region' AND c_custkey % 7 = r.category_value""",
)
def _(spark, sf):
    # shifted, so that some keys of either side have no partner
    nations = table(spark, sf, "nation").select(
        F.lit("nation").alias("column_name"), (F.col("n_nationkey") + 5).alias("category_value"), F.col("n_name").alias("category_title")
    )
    regions = table(spark, sf, "region").select(F.lit("region"), "r_regionkey", "r_name")
    people = table(spark, sf, "customer").withColumn("rk", F.col("c_custkey") % 7)
    lookups = {"nation_name": ("c_nationkey", "nation"), "region_name": ("rk", "region")}
    return cleaning.decode(people, nations.union(regions), lookups).select("c_custkey", *lookups)


@query(
    "enrich_left",
    """SELECT c_custkey, n_name, r_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey + 5
    LEFT JOIN region ON n_regionkey = r_regionkey""",
)
def _(spark, sf):
    nation = table(spark, sf, "nation").withColumn("c_nationkey", F.col("n_nationkey") + 5)
    region = table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    joined = table(spark, sf, "customer").join(nation, "c_nationkey", "left").join(region, "n_regionkey", "left")
    return joined.select("c_custkey", "n_name", "r_name")


@query(
    "case_insensitive_join",
    """SELECT p_partkey, s_name FROM part LEFT JOIN supplier
    ON upper('supplier#' || lpad(CAST(p_partkey % 200 AS VARCHAR), 9, '0')) = upper(s_name)""",
)
def _(spark, sf):
    parts = table(spark, sf, "part").select(
        "p_partkey", F.concat(F.lit("supplier#"), digits(F.col("p_partkey") % 200, 9)).alias("who")
    )
    dim = table(spark, sf, "supplier").select(F.col("s_name").alias("lei"), "s_name")
    # the same lender once more in lower case, without a name
    dim = dim.unionByName(dim.select(F.lower("lei").alias("lei"), F.lit(None).cast("string").alias("s_name")))
    return enrich.attach_upper(parts, dim, "who", "lei").select("p_partkey", "s_name")


@query(
    "fill_state",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN 'S' || CAST(c_nationkey AS VARCHAR) ELSE n_name END AS state_code,
      CASE WHEN c_custkey % 2 = 0 THEN lpad(CAST(c_custkey % 999 AS VARCHAR), 3, '0') ELSE 'C' END AS county_code
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey + 5
    WHERE c_custkey % 3 <> 0 OR n_name IS NOT NULL""",
)
def _(spark, sf):
    key, nat = F.col("c_custkey"), F.col("c_nationkey")
    apps = table(spark, sf, "customer").select(
        "c_custkey",
        F.when(key % 3 != 0, F.concat(F.lit("S"), nat.cast("string"))).alias("state_code"),
        F.when(key % 2 != 0, "C").alias("county_code"),
        F.concat(digits(nat, 2), digits(key % 999, 3), F.lit("000100")).alias("census_tract"),
    )
    fips = table(spark, sf, "nation").select(
        digits(F.col("n_nationkey") + 5, 2).alias("fips"), F.col("n_name").alias("usps")
    )
    return enrich.fill_state(apps, fips).select("c_custkey", "state_code", "county_code")


@query("anti_ids", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    used = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return enrich.exclude_ids(table(spark, sf, "orders").select("o_orderkey"), used, "o_orderkey")


@query("semi_ids", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def _(spark, sf):
    used = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return enrich.only_ids(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), used, "o_orderkey")


@query(
    "registry_filter",
    "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def _(spark, sf):
    seen = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return responses.filter_registry(table(spark, sf, "customer"), seen, "c_custkey", "o_custkey").select("c_custkey", "c_name")


@query(
    "union_years",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CASE WHEN year(o_orderdate) >= 1995 THEN o_orderpriority END AS late
    FROM orders""",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("late"))
    early, late = orders.filter("y < 1995").drop("late"), orders.filter("y >= 1995")
    return enrich.union_years([early, late]).select("o_orderkey", "y", "late")


@query("drop_duplicates", "SELECT DISTINCT l_returnflag, l_linestatus, l_quantity, l_linenumber FROM lineitem")
def _(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_linenumber").dropDuplicates()


@query(
    "null_tokens",
    """SELECT event_id, CASE event_id % 9 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN NULL WHEN 3 THEN NULL
      WHEN 4 THEN 'a.b' ELSE event_type END AS cleaned,
      CASE WHEN event_id % 9 = 5 THEN 'Yes' WHEN event_id % 9 < 4 THEN NULL WHEN event_id % 9 = 4 THEN 'A.b'
        ELSE upper(substr(event_type, 1, 1)) || lower(substr(event_type, 2)) END AS titled
    FROM events""",
)
def _(spark, sf):
    nine = F.col("event_id") % 9
    raw = (
        F.when(nine == 0, " N/A ").when(nine == 1, "").when(nine == 2, "Unknown").when(nine == 3, ".").when(nine == 4, "A.b")
        .otherwise(F.concat(F.lit(" "), F.upper("event_type")))
    )
    flagged = F.when(nine == 5, "y").otherwise(raw)
    return table(spark, sf, "events").select(
        "event_id", X.clean_text(raw).alias("cleaned"), X.clean_text(flagged, "title", {"Y": "Yes"}).alias("titled")
    )


@query(
    "number_cleaning",
    """SELECT event_id, CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN -value ELSE value END AS any_sign,
      CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN CASE WHEN value = 0 THEN value END ELSE value END AS positive,
      CASE event_id % 6 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE CAST(event_id AS BIGINT) END AS whole,
      CAST(event_id % 6 * 10 AS DOUBLE) AS pct, value * 1000::DOUBLE AS scaled FROM events""",
)
def _(spark, sf):
    six = F.col("event_id") % 6
    text = lambda c: F.when(six == 0, "Exempt").when(six == 1, "n.v.").otherwise(F.concat(F.lit(" "), c.cast("string")))
    signed = text(F.when(six == 2, -F.col("value")).otherwise(F.col("value")))
    return table(spark, sf, "events").select(
        "event_id",
        X.clean_number(signed).alias("any_sign"),
        X.clean_number(signed, allow_negative=False).alias("positive"),
        X.to_whole(text(F.concat(F.col("event_id").cast("string"), F.lit(".0")))).alias("whole"),
        X.percent_number(F.concat((six * 10).cast("string"), F.lit("%"))).alias("pct"),
        N.scaled(F.col("value"), 1000.0).alias("scaled"),
    )


@query(
    "split_trim_pad",
    """SELECT p_partkey, split_part(p_name, ' ', 2) AS noun, split_part(p_name, ' ', 9) AS absent,
      lpad(CAST(p_partkey AS VARCHAR), 3, '0') AS padded, substr(p_brand, 1, 5) AS stem, upper(trim(p_name)) AS up,
      lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0') || lpad(CAST(p_size AS VARCHAR), 3, '0') || lpad(CAST(p_partkey * 7 % 1000000 AS VARCHAR), 6, '0') AS tract,
      CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_partkey AS VARCHAR) END AS tract_text FROM part""",
)
def _(spark, sf):
    key = F.col("p_partkey")
    seven = key * 7 % 1000000
    dotted = F.concat(digits(F.floor(seven / 100), 4), F.lit("."), digits(seven % 100, 2))
    return table(spark, sf, "part").select(
        "p_partkey",
        X.part(F.col("p_name"), " ", 2).alias("noun"),
        X.part(F.col("p_name"), " ", 9).alias("absent"),
        X.pad_code(key.cast("string"), 3).alias("padded"),
        F.substring("p_brand", 1, 5).alias("stem"),
        F.upper(F.trim("p_name")).alias("up"),
        X.fips_tract((key % 100).cast("string"), F.concat(F.col("p_size").cast("string"), F.lit(".0")), dotted).alias("tract"),
        X.tract_text(F.when(key % 5 == 0, "Na").otherwise(F.concat(key.cast("string"), F.lit(".0")))).alias("tract_text"),
    )


@query(
    "json_props",
    """SELECT event_type, CAST(sum(CAST(regexp_extract(props, '[0-9]+') AS BIGINT)) AS BIGINT) AS total_k, count(*) AS n
    FROM events GROUP BY 1""",
)
def _(spark, sf):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf, "events").groupBy("event_type").agg(F.sum(k).alias("total_k"), F.count(F.lit(1)).alias("n"))


@query(
    "acs_json",
    """SELECT c_name AS name, c_custkey AS total_population, CASE WHEN c_custkey % 4 <> 0 THEN 0.5::DOUBLE END
      AS gini_index_of_income_inequality, CAST(c_nationkey AS VARCHAR) AS state FROM customer""",
)
def _(spark, sf):
    header = ["NAME", "B03002_001E", "B19083_001E", "state"]
    gini = F.when(F.col("c_custkey") % 4 == 0, "null").otherwise("0.5")
    row = F.array("c_name", F.col("c_custkey").cast("string"), gini, F.col("c_nationkey").cast("string"))
    body = F.to_json(F.array(F.array(*[F.lit(h) for h in header]), row))
    return responses.parse_acs_json(table(spark, sf, "customer").select(body.alias("body")), header)


@query(
    "crosswalk_json",
    """SELECT lpad(CAST(s_suppkey AS VARCHAR), 11, '0') AS census_tract, 'Z' || CAST(i AS VARCHAR) AS zip_code,
      i::DOUBLE / 4 AS residential_ratio, s_name AS city_name FROM supplier, (SELECT unnest([0, 1, 2]) AS i)""",
)
def _(spark, sf):
    entry = lambda i: F.struct(
        digits(F.col("s_suppkey"), 11).alias("tract"), F.lit(f"Z{i}").alias("geoid"), F.lit(i / 4).alias("res_ratio"), F.col("s_name").alias("city")
    )
    body = F.to_json(F.struct(F.struct(F.array(*[entry(i) for i in range(3)]).alias("results")).alias("data")))
    parsed = responses.parse_crosswalk_json(table(spark, sf, "supplier").select(body.alias("body")))
    return parsed.select("census_tract", "zip_code", "residential_ratio", "city_name")


@query(
    "lei_json",
    """SELECT s_suppkey AS lei, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS entity_name,
      CASE WHEN s_suppkey % 5 = 0 THEN 'Error' WHEN s_suppkey % 5 = 1 THEN NULL ELSE 'ISSUED' END AS registration_status,
      CASE WHEN s_suppkey % 5 <> 0 THEN '1 Main St|Suite ' || CAST(s_nationkey AS VARCHAR) END AS address FROM supplier""",
)
def _(spark, sf):
    supplier = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "lei")
    five = F.col("lei") % 5
    entity = F.struct(
        F.struct(F.col("s_name").alias("name")).alias("legalName"),
        F.struct(F.array(F.lit("1 Main St"), F.concat(F.lit("Suite "), F.col("s_nationkey").cast("string"))).alias("addressLines")).alias(
            "headquartersAddress"
        ),
    )
    registration = F.struct(F.when(five != 1, "ISSUED").alias("status"))
    record = F.struct(F.struct(F.struct(entity.alias("entity"), registration.alias("registration")).alias("attributes")).alias("data"))
    found = supplier.select("lei", F.when(five != 0, F.to_json(record)).alias("body"))
    return responses.parse_lei_json(found, supplier).select(
        "lei", "entity_name", "registration_status", F.array_join("headquarters_address", "|").alias("address")
    )


@query(
    "ring_centroids",
    """SELECT 'T' || CAST(s_suppkey AS VARCHAR) AS tract_fips,
      round(((s_suppkey % 90) * 3 + 4 + s_suppkey % 3)::DOUBLE / 3, 6) AS centroid_lat,
      round((s_nationkey * 3 + 6 + s_suppkey % 5)::DOUBLE / 3, 6) AS centroid_lon FROM supplier""",
)
def _(spark, sf):
    key, nat = F.col("s_suppkey"), F.col("s_nationkey")
    lon, lat = nat.cast("double"), (key % 90).cast("double")
    corners = [(lon, lat), (lon + 6, lat), (lon + key % 5, lat + 4 + key % 3)]
    vertices = table(spark, sf, "supplier").select(
        F.concat(F.lit("T"), key.cast("string")).alias("tract_fips"),
        F.lit(0).alias("ring_id"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("seq"), x.alias("lon"), y.alias("lat")) for i, (x, y) in enumerate(corners)])).alias("v"),
    ).select("tract_fips", "ring_id", "v.*")
    return responses.ring_centroids(vertices).select(
        "tract_fips", F.round("centroid_lat", 6).alias("centroid_lat"), F.round("centroid_lon", 6).alias("centroid_lon")
    )


_MARKET = """market AS (SELECT 'Z' || CAST(l_partkey % 97 AS VARCHAR) AS zip_code, CAST(l_shipdate AS DATE) AS period_begin,
  floor(l_extendedprice) AS median_sale_price, l_quantity AS inventory FROM lineitem)"""


def market(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("Z"), (F.col("l_partkey") % 97).cast("string")).alias("zip_code"),
        F.col("l_shipdate").cast("date").alias("period_begin"),
        F.floor("l_extendedprice").cast("double").alias("median_sale_price"),
        F.col("l_quantity").alias("inventory"),
    )


@query(
    "market_yearly",
    f"""WITH {_MARKET} SELECT zip_code, CAST(year(period_begin) AS INTEGER) AS year,
      avg(median_sale_price) AS avg_median_sale_price, avg(inventory) AS avg_inventory FROM market GROUP BY 1, 2""",
)
def _(spark, sf):
    return enrich.market_yearly(market(spark, sf), measures=["median_sale_price", "inventory"])


@query(
    "latest_market_row",
    f"""WITH {_MARKET}, y AS (SELECT zip_code, year(period_begin) AS year, avg(inventory) AS avg_inventory FROM market GROUP BY 1, 2)
    SELECT zip_code, CAST(year AS INTEGER) AS year, avg_inventory FROM
      (SELECT *, row_number() OVER (PARTITION BY zip_code ORDER BY year DESC) AS rn FROM y) WHERE rn = 1""",
)
def _(spark, sf):
    yearly = enrich.market_yearly(market(spark, sf), measures=["inventory"])
    return enrich.latest_row(yearly, "zip_code", "year")


@query(
    "best_candidate",
    """WITH x AS (SELECT 'T' || CAST(l_partkey AS VARCHAR) AS census_tract, 'Z' || CAST(l_suppkey AS VARCHAR) AS zip_code,
      sum(l_quantity) % 16 / 16 AS residential_ratio FROM lineitem GROUP BY 1, 2),
    z AS (SELECT 'Z' || CAST(s_suppkey AS VARCHAR) AS zip_code FROM supplier WHERE s_acctbal > 1000),
    r AS (SELECT x.*, row_number() OVER (PARTITION BY census_tract ORDER BY CASE WHEN residential_ratio > 0 THEN 1 ELSE 0 END DESC,
      residential_ratio DESC, zip_code) AS rn FROM x JOIN z USING (zip_code))
    SELECT census_tract, zip_code, residential_ratio FROM r WHERE rn = 1""",
)
def _(spark, sf):
    z = lambda c: F.concat(F.lit("Z"), F.col(c).cast("string")).alias("zip_code")
    crosswalk = table(spark, sf, "lineitem").groupBy(F.concat(F.lit("T"), F.col("l_partkey").cast("string")).alias("census_tract"), z("l_suppkey")).agg(
        (F.sum("l_quantity") % 16 / 16).alias("residential_ratio")
    ).withColumns({"city_name": F.lit(None).cast("string"), "state_name": F.lit(None).cast("string")})
    known = table(spark, sf, "supplier").filter("s_acctbal > 1000").select(z("s_suppkey"))
    return enrich.best_zip(crosswalk, known).select("census_tract", "zip_code", "residential_ratio")


@query(
    "enrich_market",
    LOANS
    + f""", {_MARKET}, y AS (SELECT zip_code, year(period_begin) AS year, avg(median_sale_price) AS avg_median_sale_price,
      avg(inventory) AS avg_inventory FROM market GROUP BY 1, 2),
    x AS (SELECT census_tract, min(zip_code) AS zip_code FROM loans GROUP BY 1)
    SELECT loan_application_id, CASE WHEN y.zip_code IS NOT NULL THEN x.zip_code END AS zip_code, avg_median_sale_price, avg_inventory
    FROM loans LEFT JOIN x USING (census_tract) LEFT JOIN y ON x.zip_code = y.zip_code AND loans.activity_year = y.year""",
)
def _(spark, sf):
    apps = loans(spark, sf)
    zips = apps.groupBy("census_tract").agg(F.min("zip_code").alias("zip_code"))
    yearly = enrich.market_yearly(market(spark, sf), measures=["median_sale_price", "inventory"])
    return enrich.enrich_market(apps.drop("zip_code"), zips, yearly).select(
        ID, "zip_code", "avg_median_sale_price", "avg_inventory"
    )


@query(
    "enrich_distress",
    LOANS
    + """, f AS (SELECT DISTINCT census_tract, activity_year, 1 AS is_distressed, CAST(activity_year % 2 AS INTEGER) AS is_underserved
      FROM loans WHERE loan_amount > 450000)
    SELECT loan_application_id, f.is_distressed, f.is_underserved FROM loans LEFT JOIN f USING (census_tract, activity_year)""",
)
def _(spark, sf):
    apps = loans(spark, sf).drop("is_distressed")
    flags = apps.filter("loan_amount > 450000").select(
        "census_tract", F.col("activity_year").alias("report_year"), F.lit(1).alias("is_distressed"),
        (F.col("activity_year") % 2).alias("is_underserved"),
    ).distinct()
    return enrich.enrich_distress(apps, flags).select(ID, "is_distressed", "is_underserved")


@query(
    "entity_age",
    """SELECT 'N' || CAST(o_orderkey AS VARCHAR) AS lei, CAST(o_orderdate AS DATE) AS registration_initial_date,
      CAST(2024 - year(o_orderdate) AS INTEGER) AS entity_age, upper(o_orderpriority) AS entity_name FROM orders""",
)
def _(spark, sf):
    raw = table(spark, sf, "orders").select(
        F.concat(F.lit("N"), F.col("o_orderkey").cast("string")).alias("lei"),
        F.lower("o_orderpriority").alias("entity_name"),
        F.lit("issued").alias("registration_status"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("registration_initial_date"),
        F.lit("not a date").alias("registration_last_update"),
    )
    return staging.lender_dimension(raw, "2024-06-30").select("lei", "registration_initial_date", "entity_age", "entity_name")


@query(
    "stage_market",
    """SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS period_begin, CAST(l_partkey AS VARCHAR) AS zip_code,
      ' City' || CAST(l_suppkey AS VARCHAR) AS parent_metro_region_city, l_quantity AS median_days_on_market
    FROM lineitem WHERE l_linenumber IN (6, 13) AND l_shipdate > '2018-01-01' AND l_shipdate < '2024-01-31'
    UNION ALL
    SELECT l_orderkey, l_linenumber, CAST(l_shipdate + INTERVAL 20 YEAR AS DATE), CAST(l_partkey AS VARCHAR),
      ' City' || CAST(l_suppkey AS VARCHAR), l_quantity FROM lineitem
    WHERE l_linenumber IN (6, 13) AND l_shipdate + INTERVAL 20 YEAR > '2018-01-01' AND l_shipdate + INTERVAL 20 YEAR < '2024-01-31'""",
)
def _(spark, sf):
    lines = table(spark, sf, "lineitem")
    shift = F.col("l_shipdate").cast("date")
    both = lines.withColumn("d", shift).unionByName(lines.withColumn("d", F.add_months(shift, 240)))
    blank = "median_sale_price median_sale_price_yoy median_list_price median_list_price_yoy median_ppsf median_ppsf_yoy inventory new_listings homes_sold pending_sales price_drops avg_sale_to_list off_market_in_two_weeks".split()
    raw = both.select(
        "l_orderkey",
        F.col("d").cast("string").alias("period_begin"),
        F.col("d").cast("string").alias("period_end"),
        F.concat(F.lit("zipcode:United States:"), F.col("l_partkey").cast("string")).alias("region"),
        F.lit("WI").alias("state_code"),
        F.concat(F.lit("Wisconsin, City"), F.col("l_suppkey").cast("string")).alias("parent_metro_region"),
        # carries the order key through staging so that rows can be compared
        F.col("l_orderkey").cast("string").alias("property_type"),
        F.col("l_linenumber").alias("property_type_id"),
        F.col("l_quantity").alias("median_dom"),
        *[F.lit(None).cast("double").alias(c) for c in blank],
    )
    return staging.stage_market(raw).select(
        F.col("property_type").cast("bigint").alias("l_orderkey"),
        F.col("property_type_id").alias("l_linenumber"),
        "period_begin", "zip_code", "parent_metro_region_city", "median_days_on_market",
    )


@query(
    "stage_acs",
    """WITH a AS (SELECT *, c_custkey % 100 AS total, c_custkey % 37 AS white, c_custkey % 11 AS bach, c_custkey % 7 AS grad FROM customer)
    SELECT c_name AS name, total AS total_population,
      CASE WHEN total > 0 THEN round(white::DOUBLE / total * 100, 2) END AS white_population_pct,
      total - white AS minority_population,
      CASE WHEN total > 0 THEN round((total - white)::DOUBLE / total * 100, 2) END AS minority_population_pct,
      CASE WHEN total > 0 THEN round((bach + grad)::DOUBLE / total * 100, 2) END AS pct_bachelors_or_higher,
      CASE WHEN c_custkey % 10 <> 0 THEN CAST(floor(c_acctbal) + 1000 AS BIGINT) END AS median_household_income,
      lpad(CAST(c_nationkey AS VARCHAR), 2, '0') || '007' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') AS census_tract FROM a""",
)
def _(spark, sf):
    key = F.col("c_custkey")
    zero = "black_population latinx_population high_school_diploma_population total_population_below_poverty_level total_population_receiving_federal_assistance median_home_value".split()
    raw = table(spark, sf, "customer").select(
        F.col("c_name").alias("name"),
        (key % 100).alias("total_population"),
        (key % 37).alias("white_population"),
        (key % 11).alias("bachelors_degree_population"),
        (key % 7).alias("graduate_degree_population"),
        F.when(key % 10 == 0, -666666666).otherwise(F.floor("c_acctbal") + 1000).alias("median_household_income"),
        F.lit(0.4).alias("gini_index_of_income_inequality"),
        F.col("c_nationkey").cast("string").alias("state"),
        F.lit("7").alias("county"),
        (key % 1000000).cast("string").alias("tract"),
        *[F.lit(0).alias(z) for z in zero],
    )
    return staging.stage_acs(raw).select(
        "name", "total_population", "white_population_pct", "minority_population", "minority_population_pct",
        "pct_bachelors_or_higher", "median_household_income", "census_tract",
    )


@query(
    "distressed_tracts",
    """SELECT l_orderkey, l_linenumber, lpad(CAST(l_suppkey % 50 AS VARCHAR), 2, '0') || lpad(CAST(l_partkey % 999 AS VARCHAR), 3, '0')
      || lpad(CAST(l_orderkey % 10000 AS VARCHAR), 4, '0') || '02' AS tract_fips,
      CASE WHEN l_returnflag = 'R' OR l_linestatus = 'F' THEN 1 ELSE 0 END AS is_distressed,
      CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS is_underserved FROM lineitem WHERE l_linenumber <> 3""",
)
def _(spark, sf):
    mark = lambda c: F.when(c, "X")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        (F.col("l_suppkey") % 50).cast("string").alias("state_code"),
        (F.col("l_partkey") % 999).cast("string").alias("county_code"),
        F.when(F.col("l_linenumber") == 3, "none").otherwise(
            F.concat((F.col("l_orderkey") % 10000).cast("string"), F.lit(".02"))
        ).alias("tract_code"),
        mark(flag == "R").alias("poverty"), mark(status == "F").alias("unemployment"),
        F.lit(None).cast("string").alias("population_loss"), mark(flag == "A").alias("remote_rural"),
    )
    return responses.clean_distressed(raw).select("l_orderkey", "l_linenumber", "tract_fips", "is_distressed", "is_underserved")


@query(
    "distressed_by_year",
    """SELECT l_orderkey, l_linenumber, lpad(CAST(l_suppkey % 50 AS VARCHAR), 2, '0') || '007000100' AS tract_fips,
      CAST(year(l_shipdate) AS INTEGER) AS report_year, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_distressed FROM lineitem""",
)
def _(spark, sf):
    nothing = F.lit(None).cast("string")
    raw = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_suppkey") % 50).cast("string").alias("state_code"),
        F.lit("7").alias("county_code"), F.lit("1.00").alias("tract_code"), F.when(F.col("l_returnflag") == "R", "X").alias("poverty"),
        nothing.alias("unemployment"), nothing.alias("population_loss"), nothing.alias("remote_rural"),
    )
    marked = responses.clean_distressed(raw, F.year("l_shipdate"))
    return marked.select("l_orderkey", "l_linenumber", "tract_fips", "report_year", "is_distressed")


@query(
    "replace_and_map",
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'one' END AS code_category,
      CASE o_orderkey % 4 WHEN 1 THEN 10::BIGINT WHEN 2 THEN 20::BIGINT END AS code FROM orders""",
)
def _(spark, sf):
    coded = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).cast("string").alias("code"))
    return cleaning.replace_and_map(coded, "code", {0: ("none", None), 1: ("one", 10), 2: (None, 20)})


@query("co_applicant_present", "SELECT c_custkey, CAST(c_nationkey % 6 <> 5 AS INTEGER) AS joint FROM customer")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", L.co_applicant_present(F.col("c_nationkey") % 6).alias("joint"))


@query("select_features", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    fixed = features.select_features(orders, ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"], drop=["o_orderstatus"])
    return fixed.select(features.select_features(orders, drop=[c for c in orders.columns if c not in fixed.columns]).columns)


@query("null_counts_by_kind", "SELECT count(*) AS total_rows, count(*) FILTER (o_orderkey IS NULL) AS o_orderkey_null_count, count(*) FILTER (o_totalprice > 100000) AS price_null_count FROM orders")
def _(spark, sf):
    """The columns are found by their type: every number, no text."""
    price = F.when(F.col("o_totalprice") <= 100000, F.col("o_totalprice")).alias("price")
    found = table(spark, sf, "orders").select("o_orderkey", price, "o_orderstatus")
    return profiling.null_counts(found, profiling.numeric_columns(found))


@query("assertions", "SELECT count(*) AS n, true AS lost_found, true AS stray_found FROM orders")
def _(spark, sf):
    """Both assertions let the right frames pass and stop the wrong ones."""
    orders, people = table(spark, sf, "orders"), table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")

    def stopped(check, *given):
        try:
            check(*given)
        except AssertionError:
            return True
        return False

    quality.assert_same_count(orders, orders.withColumn("x", F.lit(1)))
    quality.assert_covered(orders, people, "o_custkey")
    lost = stopped(quality.assert_same_count, orders, orders.filter("o_orderkey > 1"))
    stray = stopped(quality.assert_covered, orders.withColumn("o_custkey", -F.col("o_custkey")), people, "o_custkey")
    return orders.agg(F.count(F.lit(1)).alias("n"), F.lit(lost).alias("lost_found"), F.lit(stray).alias("stray_found"))


_RAW_LAR = """raw AS (SELECT o_custkey AS ck, o_orderkey AS ok, c_nationkey AS nk,
  CAST(year(o_orderdate) AS VARCHAR) AS activity_year, CAST(1 + o_custkey % 8 AS VARCHAR) AS action_taken,
  CASE o_custkey % 4 WHEN 0 THEN CAST(o_custkey + 3000000000 AS VARCHAR) || '.0' WHEN 1 THEN 'Exempt' WHEN 2 THEN CAST(o_custkey AS VARCHAR) || '.5' ELSE CAST(o_custkey AS VARCHAR) END AS loan_amount,
  CASE o_custkey % 5 WHEN 0 THEN '0' WHEN 1 THEN '-5' ELSE '85' END AS income,
  CAST(floor(o_totalprice) AS BIGINT) AS pv
  FROM orders JOIN customer ON o_custkey = c_custkey)"""


@query(
    "stage_lar",
    f"""WITH {_RAW_LAR}, keyed AS (SELECT *, md5(activity_year || '-' || action_taken || '-LEI' || CAST(ck % 20 AS VARCHAR) || '---'
      || CASE ck % 3 WHEN 0 THEN '37057061600.0' WHEN 1 THEN '7057061600' ELSE 'Na' END || '-' || coalesce(loan_amount, '') || '-'
      || income || '-' || '2' || '-' || '5' || '-' || CAST(ck % 3 AS VARCHAR)) AS k FROM raw),
    one AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN ck % 7 = 0 THEN 1 ELSE 0 END, pv) AS rn FROM keyed)
    SELECT k AS loan_application_id, CAST(activity_year AS INTEGER) AS activity_year, CAST(action_taken AS INTEGER) AS action_taken,
      CASE ck % 3 WHEN 0 THEN '37057061600' WHEN 1 THEN '07057061600' ELSE '000000000Na' END AS census_tract,
      CAST(CASE ck % 4 WHEN 0 THEN ck + 3000000000 WHEN 2 THEN ck + 1 WHEN 3 THEN ck END AS BIGINT) AS loan_amount,
      CAST(pv AS BIGINT) AS property_value,
      CASE ck % 5 WHEN 0 THEN NULL WHEN 1 THEN -5000 ELSE 85000 END::BIGINT AS income,
      CASE WHEN ck % 2 = 0 THEN NULL ELSE '25-34' END AS applicant_age,
      CASE WHEN ck % 6 = 0 THEN NULL ELSE '30%-<36%' END AS debt_to_income_ratio,
      CASE WHEN ck % 6 = 0 THEN NULL ELSE 4.25 END::DOUBLE AS interest_rate,
      CASE WHEN ck % 7 = 0 THEN NULL ELSE 2 END::INTEGER AS balloon_payment
    FROM one WHERE rn = 1""",
)
def _(spark, sf):
    from lendlens.schemas import LAR_TEXT_COLUMNS

    ck = F.col("o_custkey")
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), ck == F.col("c_custkey"))
    made = {
        "activity_year": F.year("o_orderdate").cast("string"),
        "action_taken": (ck % 8 + 1).cast("string"),
        "lei": F.concat(F.lit("LEI"), (ck % 20).cast("string")),
        "census_tract": F.when(ck % 3 == 0, "37057061600.0").when(ck % 3 == 1, "7057061600").otherwise("Na"),
        "loan_amount": F.when(ck % 4 == 0, F.concat((ck + 3000000000).cast("string"), F.lit(".0"))).when(ck % 4 == 1, "Exempt").when(ck % 4 == 2, F.concat(ck.cast("string"), F.lit(".5"))).when(
            ck % 4 == 3, ck.cast("string")
        ),
        "property_value": F.floor("o_totalprice").cast("string"),
        "income": F.when(ck % 5 == 0, "0").when(ck % 5 == 1, "-5").otherwise("85"),
        "applicant_ethnicity_1": F.lit("2"),
        "applicant_race_1": F.lit("5"),
        "applicant_sex": (ck % 3).cast("string"),
        "applicant_age": F.when(ck % 2 == 0, "8888").otherwise("25-34"),
        "debt_to_income_ratio": F.when(ck % 6 == 0, "EXEMPT").otherwise("30%-<36%"),
        "interest_rate": F.when(ck % 6 == 0, "exempt").otherwise("4.25"),
        "balloon_payment": F.when(ck % 7 == 0, "1111").otherwise("2"),
    }
    raw = joined.select(*[made.get(c, F.lit(None).cast("string")).alias(c) for c in LAR_TEXT_COLUMNS])
    return staging.stage_lar(raw).select(
        "loan_application_id", "activity_year", "action_taken", "census_tract", "loan_amount", "property_value",
        "income", "applicant_age", "debt_to_income_ratio", "interest_rate", "balloon_payment",
    )


@query(
    "filter_applications",
    """SELECT o_orderkey, CAST(o_orderkey % 9 AS INTEGER) AS action_taken FROM orders
    WHERE o_orderkey % 9 IN (1, 2, 3, 7, 8) AND o_orderkey % 4 <> 0 AND o_orderkey % 5 <> 0""",
)
def _(spark, sf):
    key = F.col("o_orderkey")
    apps = table(spark, sf, "orders").select(
        key, (key % 9).cast("int").alias("action_taken"),
        F.when(key % 4 != 0, 1).alias("loan_amount"), F.when(key % 5 != 0, 1).alias("income"),
    )
    return staging.filter_applications(apps).select("o_orderkey", "action_taken")


def _sql_map(code, labels):
    return "CASE " + code + " " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in labels.items()) + " END"


@query(
    "clean_lar",
    f"""SELECT o_orderkey AS id, {_sql_map('o_orderkey % 9', codes.ACTION_TAKEN)} AS action_taken_category,
      CASE WHEN o_orderkey % 46 IN (6, 7, 8) THEN NULL ELSE o_orderkey % 46 END AS applicant_race_1,
      {_sql_map('o_orderkey % 46', codes.RACE)} AS applicant_race_1_category,
      {_sql_map('o_orderkey % 46', codes.RACE_GROUP)} AS applicant_race_1_category_grouped,
      {_sql_map('o_orderkey % 11', codes.DENIAL_REASON)} AS denial_reason_1_category,
      CASE WHEN o_orderkey % 11 = 10 THEN NULL ELSE o_orderkey % 11 END AS denial_reason_1,
      CASE o_orderkey % 4 WHEN 1 THEN 1 WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE 0 END::BIGINT AS balloon_payment,
      CASE o_orderkey % 4 WHEN 1 THEN 'Balloon Payment' WHEN 2 THEN 'No Balloon Payment' END AS balloon_payment_category,
      CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE floor(o_totalprice) * 1000 END::DOUBLE AS income,
      CASE WHEN o_orderkey % 5 = 0 THEN 95.5 WHEN o_orderkey % 5 = 1 THEN 80.25 END::DOUBLE AS effective_ltv,
      CASE WHEN o_orderkey % 70 < 20 THEN '<20%' WHEN o_orderkey % 70 < 30 THEN '20%-<30%' WHEN o_orderkey % 70 < 36 THEN '30%-<36%'
        WHEN o_orderkey % 70 < 40 THEN '36%-<40%' WHEN o_orderkey % 70 < 46 THEN '40%-<46%' WHEN o_orderkey % 70 < 50 THEN '46%-<50%'
        WHEN o_orderkey % 70 <= 60 THEN '50%-60%' ELSE '>60%' END AS debt_to_income_ratio,
      CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE '25-34' END AS applicant_age,
      CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS applicant_age_above_62
    FROM orders""",
)
def _(spark, sf):
    key = F.col("o_orderkey")
    text = lambda c: c.cast("string")
    raw = table(spark, sf, "orders").select(
        key.alias("id"),
        text(key % 9).alias("action_taken"),
        (key % 46).alias("applicant_race_1"),
        F.concat(text(key % 11), F.lit(".0")).alias("denial_reason_1"),
        F.when(key % 4 == 3, 1111).otherwise(key % 4).alias("balloon_payment"),
        F.when(key % 3 == 0, "Exempt").otherwise(text(F.floor("o_totalprice"))).alias("income"),
        F.when(key % 5 == 0, "95.5").alias("loan_to_value_ratio"),
        F.when(key % 5 < 2, "80.25").alias("combined_loan_to_value_ratio"),
        text(key % 70).alias("debt_to_income_ratio"),
        F.when(key % 2 == 0, "8888.0").otherwise("25-34").alias("applicant_age"),
        F.when(key % 2 == 0, "Yes").otherwise("No").alias("applicant_age_above_62"),
    )
    return cleaning.clean_lar(raw).select(
        "id", "action_taken_category", "applicant_race_1", "applicant_race_1_category", "applicant_race_1_category_grouped",
        "denial_reason_1_category", "denial_reason_1",
        "balloon_payment", "balloon_payment_category", "income", "effective_ltv", "debt_to_income_ratio", "applicant_age", "applicant_age_above_62",
    )


@query(
    "enforce_schema",
    """SELECT CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderkey AS BIGINT) END AS code,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS amount, CAST(o_custkey AS VARCHAR) AS name,
      CAST(NULL AS BIGINT) AS absent FROM orders""",
)
def _(spark, sf):
    from pyspark.sql import types as T

    key = F.col("o_orderkey")
    messy = table(spark, sf, "orders").select(
        F.when(key % 4 == 0, "x").otherwise(key.cast("string")).alias("code"),
        F.when(key % 5 == 0, float("inf")).otherwise(F.col("o_totalprice")).alias("amount"),
        F.col("o_custkey").alias("name"),
    )
    kinds = [("code", T.LongType()), ("amount", T.DoubleType()), ("name", T.StringType()), ("absent", T.LongType())]
    return enforce_schema(messy, T.StructType([T.StructField(n, t) for n, t in kinds]))


@query(
    "infer_numeric",
    """SELECT CAST(o_orderkey AS DOUBLE) AS id_text, o_orderpriority, CAST(o_custkey AS VARCHAR) AS lei FROM orders""",
)
def _(spark, sf):
    texts = table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("id_text"), "o_orderpriority", F.col("o_custkey").cast("string").alias("lei")
    )
    return infer_numeric(texts, preserve=["lei"])


@query(
    "like_filters",
    f"""{LOANS} SELECT loan_application_id, {RACE} FROM loans
    WHERE {RACE} NOT LIKE 'HOUSEHOLD' AND {RACE} ILIKE '%u%' AND census_tract NOT IN ('000000000Na', '000000000nA')
      AND score BETWEEN 0.25 AND 0.75 AND loan_purpose = 1 AND income > 0""",
)
def _(spark, sf):
    df = loans(spark, sf)
    wanted = (
        ~F.col(RACE).like("HOUSEHOLD") & F.col(RACE).ilike("%u%") & ~F.col("census_tract").isin(L.BAD_TRACTS)
        & F.col("score").between(0.25, 0.75) & (F.col("loan_purpose") == 1) & (F.col("income") > 0)
    )
    return df.filter(wanted).select(ID, RACE)
