"""Round trips through files: what is written, landed or appended has to come back whole."""

import uuid

from pyspark.sql import Window as W, functions as F, types as T

from lendlens.operators import enrich, schema as S
from lendlens.operators.ranks import top_k
from lendlens.queries.registry import query
from lendlens.queries.standin import LOANS, loans, table
from lendlens.schemas import COUNTY_FIPS
from lendlens.shared import new_path, settle
from lendlens.sources import files, ledger, sinks
from lendlens.streaming.landing import ingest_new, stream_id

ID = "loan_application_id"
_YEAR_PURPOSE = ["activity_year", "loan_purpose"]


@query("partitioned_write", LOANS + "SELECT loan_application_id, loan_amount, activity_year, loan_purpose FROM loans")
def _(spark, sf):
    path = new_path(spark)
    sinks.write_partitioned(loans(spark, sf).select(ID, "loan_amount", *_YEAR_PURPOSE), path, _YEAR_PURPOSE, files=4)
    return spark.read.parquet(path).select(ID, "loan_amount", *_YEAR_PURPOSE)


@query("chunked_write", "SELECT count(*) AS n_rows, true AS bounded FROM lineitem")
def _(spark, sf):
    path = new_path(spark)
    sinks.write_chunks(table(spark, sf, "lineitem"), path, rows=1000)
    per_file = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return per_file.agg(F.sum("n").alias("n_rows"), (F.max("n") <= 1000).alias("bounded"))


@query("append_new_ids", "SELECT o_orderkey, o_orderstatus FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    path = new_path(spark)
    sinks.append_new(orders.filter("o_orderkey % 3 <> 0"), path, "o_orderkey")
    sinks.append_new(orders.filter("o_orderkey % 2 = 0"), path, "o_orderkey")
    sinks.append_new(orders, path, "o_orderkey")
    return spark.read.schema(orders.schema).parquet(path)


@query(
    "append_new_by_year",
    "SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, min(l_extendedprice) AS price FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2",
)
def _(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    rows = joined.select("o_orderkey", F.year("o_orderdate").alias("y"), F.col("l_extendedprice").alias("price"))
    path = new_path(spark)
    for part in (rows.filter("y % 2 = 0"), rows.filter("y > 1995"), rows):
        sinks.append_new(part, path, "o_orderkey", [F.col("price")], partition="y")
    return spark.read.schema(rows.schema).parquet(path).select("o_orderkey", "y", "price")


@query("incremental_landing", "SELECT o_orderkey, o_custkey, o_orderstatus, 3::BIGINT AS n_batches FROM orders")
def _(spark, sf):
    """Three batches that share ids; the second had been half written before, and the id lists are merged before the third."""
    schema = "o_orderkey bigint, o_custkey bigint, o_orderstatus string"
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    source, target, checkpoint = new_path(spark), new_path(spark), new_path(spark)

    def arrive(rows):
        rows.write.mode("append").parquet(source)
        ingest_new(spark, source, target, checkpoint, schema, "o_orderkey", format="parquet", options={})

    arrive(orders.filter("o_orderkey % 3 <> 0"))
    half = orders.limit(10).withColumn("o_orderkey", -F.col("o_orderkey"))
    half.write.parquet(f"{target}/data/batch={stream_id(spark, checkpoint)}-1")
    arrive(orders.filter("o_orderkey % 2 = 0"))
    ledger.merge_ids(spark, target, "1", "bigint")
    arrive(orders)
    ingest_new(spark, source, target, checkpoint, schema, "o_orderkey", format="parquet", options={})  # finds nothing new
    batches = ledger.manifest(spark, target).filter("landed_rows IS NOT NULL").count()
    return ledger.landed(spark, target, orders.schema).withColumn("n_batches", F.lit(batches).cast("bigint"))


@query("land_by_id", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(min(l_extendedprice) AS DOUBLE) AS price FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2 UNION ALL SELECT NULL, 0, 0")
def _(spark, sf):
    """Null is a key like any other, a batch of known keys adds nothing, and a batch is landed once."""
    kind = "l_orderkey bigint, l_linenumber bigint, price double"
    items = table(spark, sf, "lineitem").filter("l_linenumber = 1").selectExpr("l_orderkey", "l_linenumber", "l_extendedprice AS price")
    target = new_path(spark)
    nulls = spark.range(2).selectExpr("CAST(NULL AS bigint) AS l_orderkey", "0 AS l_linenumber", "0 AS price")
    typed = lambda df: df.to(spark.createDataFrame([], kind).schema)
    for name, part in (("a", items.filter("l_orderkey % 4 = 1")), ("b", items.unionByName(nulls)), ("c", nulls), ("b", items)):
        ledger.land_batch(typed(part), target, "l_orderkey", name, [F.col("price")])
    return ledger.landed(spark, target, typed(items).schema)


@query(
    "lar_csv_scan",
    """SELECT CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END AS status,
      CAST(year(o_orderdate) + 22 AS INTEGER) AS file_year FROM orders""",
)
def _(spark, sf):
    path = new_path(spark)
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        key.cast("string").alias("id"),
        F.when(key % 3 == 0, "Exempt").otherwise(F.col("o_orderstatus")).alias("status"),
        (F.year("o_orderdate") + 22).alias("landed"),
    )
    raw.write.option("header", True).partitionBy("landed").csv(path)  # one folder per year
    return files.read_lar_csv(spark, f"{path}/*", ["id", "status"])


_PREAMBLE = ["Notice 2021", "", "Tract,Town"]


@query(
    "preamble_scan",
    "SELECT CAST(n_nationkey AS VARCHAR) AS tract, 'Notice 2021 ' || n_name AS town FROM nation UNION ALL SELECT 'Tract', 'Town'",
)
def _(spark, sf):
    path = new_path(spark)
    nation = table(spark, sf, "nation").select(F.concat_ws(",", "n_nationkey", F.concat(F.lit("Notice 2021 "), "n_name")).alias("value"))
    lead = spark.createDataFrame([(x,) for x in [*_PREAMBLE, "Tract,Town"]], "value string").coalesce(1)
    lead.union(nation).coalesce(1).write.text(path)
    return files.read_csv_skip(spark, path, 2).select("tract", "town")


@query("pipe_scan", "SELECT c_name, CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3")
def _(spark, sf):
    path = new_path(spark)
    names = ["id", "c_name", "segment", "nation"]
    table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey").write.option("sep", "|").csv(path)
    return files.read_pipe_lar(spark, path, "BUILDING", "3", names, "segment", "nation").select("c_name", "id")


@query(
    "valid_files",
    "SELECT count(*) AS n_rows, 3::BIGINT AS loaded, 1::BIGINT AS skipped FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT n_nationkey FROM nation)",
)
def _(spark, sf):
    path = new_path(spark)
    table(spark, sf, "supplier").select(F.col("s_suppkey").cast("bigint").alias("rn")).coalesce(1).write.parquet(f"{path}/a")
    table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("rn")).coalesce(1).write.parquet(f"{path}/b")
    spark.range(0).select(F.col("id").alias("rn")).coalesce(1).write.parquet(f"{path}/empty")
    # a text file posing as Parquet
    table(spark, sf, "region").select("r_name").coalesce(1).write.text(f"{path}/c")
    names = [
        r.f
        for r in spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.col("path").alias("f")).collect()
    ]
    rows, audit = files.load_valid_files(spark, sorted(names))
    counts = audit.agg(F.count_if("loaded").alias("loaded"), F.count_if(~F.col("loaded")).alias("skipped"))
    return settle(counts).withColumn("n_rows", rows.agg(F.count(F.lit(1))).scalar())


@query(
    "schema_audit",
    """WITH parts AS (SELECT CAST(o_orderkey % 4 AS INTEGER) AS part, count(*) AS n_rows FROM orders GROUP BY 1),
    wanted(part, column_name, issue, actual, expected) AS (VALUES (1, 'o_custkey', 'TypeMismatch', 'string', 'bigint'),
      (1, 'o_orderstatus', 'Missing', NULL, 'string'), (1, 'extra', 'Unexpected', 'int', NULL), (3, 'o_orderkey', 'TypeMismatch', 'double', 'bigint'))
    SELECT part, column_name, issue, actual, expected, n_rows FROM wanted JOIN parts USING (part)""",
)
def _(spark, sf):
    """Four files, of which the second and the fourth differ from the first; each issue with the rows it concerns."""
    from lendlens.operators.schema import schema_audit

    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    changes = {
        1: lambda df: df.select("o_orderkey", F.col("o_custkey").cast("string").alias("o_custkey"), F.lit(1).alias("extra")),
        3: lambda df: df.withColumn("o_orderkey", F.col("o_orderkey").cast("double")),
    }
    paths = {i: new_path(spark) for i in range(4)}
    for i, path in paths.items():
        changes.get(i, lambda df: df)(orders.filter(F.col("o_orderkey") % 4 == i)).write.parquet(path)
    part = F.lit(None).cast("int")
    for i, path in paths.items():
        part = F.when(F.col("file") == path, i).otherwise(part)
    sizes = orders.groupBy((F.col("o_orderkey") % 4).cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n_rows"))
    return schema_audit(spark, list(paths.values())).withColumn("part", part).drop("file").join(sizes, "part")


@query("parquet_dir_scan", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END AS o_orderstatus FROM orders")
def _(spark, sf):
    path = new_path(spark)
    orders = table(spark, sf, "orders")
    orders.filter("o_orderkey % 2 = 0").select("o_orderkey", "o_orderstatus").write.parquet(f"{path}/part=0")
    orders.filter("o_orderkey % 2 <> 0").select("o_orderkey").write.parquet(f"{path}/part=1")
    return files.read_parquet_dir(spark, path).select("o_orderkey", "o_orderstatus")


@query("market_tsv_scan", "SELECT CAST(p_partkey AS VARCHAR) AS period_begin, p_name AS median_ppsf FROM part")
def _(spark, sf):
    path = new_path(spark)
    table(spark, sf, "part").selectExpr("p_partkey AS PERIOD_BEGIN", "p_name AS `MEDIAN PPSF`").write.option("sep", "\t").option("header", True).csv(path)
    return files.read_market_tsv(spark, path).select("period_begin", "median_ppsf")


@query("fips_scans", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') || '00' || CAST(n_regionkey AS VARCHAR) AS code, 'N' || n_name AS name FROM nation")
def _(spark, sf):
    path = new_path(spark)
    nation = table(spark, sf, "nation")
    names = T.StructType.fromDDL(COUNTY_FIPS).names
    fields = [F.lit("").alias(f"x{i}") for i in range(len(names))]
    by_name = {"state_fips_cd": F.lpad(F.col("n_nationkey").cast("string"), 2, "0"), "county_fips_cd": F.lpad(F.col("n_regionkey").cast("string"), 3, "0")}
    text = "county_name"
    by_name[text] = F.concat(F.lit("N"), "n_name")
    row = [by_name.get(n, x).alias(n) for n, x in zip(names, fields)]
    nation.select(*row).write.option("sep", "|").option("header", True).csv(path)
    return files.read_county_fips(spark, path).select(F.col("census_county_cd").alias("code"), F.col(text).alias("name"))


@query("state_fips_scan", "SELECT lpad(CAST(n_nationkey AS VARCHAR), 2, '0') AS fips, left(n_name, 2) AS usps, n_name AS state_name FROM nation")
def _(spark, sf):
    path = new_path(spark)
    nation = table(spark, sf, "nation").selectExpr("lpad(CAST(n_nationkey AS string), 2, '0') AS STATE", "left(n_name, 2) AS STUSAB", "n_name AS STATE_NAME", "'0' AS STATENS")
    nation.write.option("sep", "|").option("header", True).csv(path)
    return files.read_state_fips(spark, path).drop("gnisid")


@query("seed_scan", "SELECT CAST(r_regionkey AS VARCHAR) AS code, r_name AS label FROM region")
def _(spark, sf):
    path = new_path(spark)
    sinks.write_csv(table(spark, sf, "region").select("r_regionkey", "r_name"), path)
    return files.load_seed(spark, path, {"r_regionkey": "code", "r_name": "label"})


@query("pipe_scan_header", "SELECT CAST(c_custkey AS VARCHAR) AS id, c_name FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(spark, sf):
    path = new_path(spark)
    rows = table(spark, sf, "customer").selectExpr("c_custkey AS id", "c_name", "c_mktsegment AS segment")
    rows.write.option("sep", "|").option("header", True).csv(path)
    return files.read_pipe_lar(spark, path, "BUILDING", None, None, "segment").select("id", "c_name")


@query("range_export", "SELECT count(*) AS n_rows, 8::BIGINT AS n_files, true AS contiguous FROM lineitem")
def _(spark, sf):
    path = new_path(spark)
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("rn")
    sinks.write_range_chunks(table(spark, sf, "lineitem").select(number, "l_quantity"), path, chunks=8)
    spans = spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).agg(
        F.count(F.lit(1)).alias("n"), F.min("rn").alias("lo"), F.max("rn").alias("hi")
    )
    after = F.lag("hi").over(W.orderBy("lo"))  # one row per file
    return spans.withColumn("apart", F.coalesce(after < F.col("lo"), F.lit(True))).agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_files"), F.bool_and("apart").alias("contiguous")
    )


@query("table_create_append", "SELECT o_orderkey, o_orderstatus FROM orders UNION ALL SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    stored = settle(orders.filter("o_orderkey % 2 = 0"))
    name = f"landed_{uuid.uuid4().hex}"
    sinks.write_table(stored, name)
    sinks.write_table(orders, name)  # replaces what was there
    sinks.write_table(orders.filter("o_orderkey % 3 = 0"), name, "append")
    out = settle(spark.table(name))
    spark.sql(f"DROP TABLE {name}")
    return out


@query("materialize_view", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    return sinks.materialize(counts, f"counts_{uuid.uuid4().hex}", "view")


@query("log_append", "SELECT CAST(o_orderstatus AS VARCHAR) AS model, CAST(count(*) AS DOUBLE) AS score FROM orders GROUP BY 1 UNION ALL SELECT 'all', CAST(count(*) AS DOUBLE) FROM orders")
def _(spark, sf):
    path, schema = new_path(spark), "model string, score double"
    orders = table(spark, sf, "orders")
    sinks.append_log(orders.groupBy(F.col("o_orderstatus").alias("model")).agg(F.count(F.lit(1)).alias("score")), path, schema)
    sinks.append_log(orders.agg(F.lit("all").alias("model"), F.count(F.lit(1)).alias("score")), path, schema)
    return spark.read.schema(schema).parquet(path)


def _mixed(spark, sf):
    return table(spark, sf, "orders").selectExpr("o_orderkey", "CAST(o_custkey AS string) AS o_custkey", "CAST(o_totalprice AS string) AS o_totalprice", "'n' AS note")


@query("coerce_to_first", "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey, 'n' AS note, CAST(NULL AS VARCHAR) AS gone FROM orders")
def _(spark, sf):
    first = T.StructType.fromDDL("o_orderkey bigint, o_custkey int, gone string")
    frame = _mixed(spark, sf).drop("o_totalprice")
    S.validate_schema(S.coerce_schema(frame, first), first)
    return S.coerce_schema(frame, first)


@query(
    "align_with_log",
    """SELECT column_name, action FROM (VALUES ('o_custkey', 'cast'), ('note', 'dropped'), ('gone', 'filled'), ('o_totalprice', 'dropped')) v(column_name, action)
    UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM orders""",
)
def _(spark, sf):
    wanted = T.StructType.fromDDL("o_orderkey bigint, o_custkey int, gone string")
    aligned, log = S.align(_mixed(spark, sf), wanted, "orders")
    rows = aligned.agg(F.lit("rows").alias("column_name"), F.count(F.lit(1)).cast("string").alias("action"))
    return log.select("column_name", "action").unionByName(rows)


@query("unify_years", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus FROM orders")
def _(spark, sf):
    orders = table(spark, sf, "orders")
    frames = [
        orders.filter("o_orderkey % 2 = 0").selectExpr("CAST(o_orderkey AS int) AS o_orderkey", "CAST(o_custkey AS double) AS o_custkey", "o_orderstatus"),
        orders.filter("o_orderkey % 2 <> 0").selectExpr("o_orderkey", "CAST(o_custkey AS bigint) AS o_custkey", "o_orderstatus"),
    ]
    wide = S.unify_schemas([f.schema for f in frames])
    return enrich.union_years([S.enforce_schema(f, wide) for f in frames])


@query("rename_columns", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders")
def _(spark, sf):
    return S.rename_map(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), {"o_orderkey": "id", "o_orderstatus": "status"})


@query("infer_numeric_strict", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS a, CASE WHEN o_orderkey % 10 = 0 THEN 'x' ELSE CAST(o_custkey AS VARCHAR) END AS b FROM orders")
def _(spark, sf):
    key = F.col("o_orderkey")
    text = table(spark, sf, "orders").select(
        "o_orderkey", F.col("o_custkey").cast("string").alias("a"), F.when(key % 10 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("b")
    )
    return S.infer_numeric(text, threshold=0.95, strict=True)


@query("top_models", "SELECT model, auc FROM (SELECT 'M' || CAST(o_custkey % 50 AS VARCHAR) AS model, CAST(max(o_orderkey) AS DOUBLE) / 1024 AS auc FROM orders GROUP BY 1) ORDER BY auc DESC LIMIT 2")
def _(spark, sf):
    results = table(spark, sf, "orders").groupBy(F.concat(F.lit("M"), (F.col("o_custkey") % 50).cast("string")).alias("model")).agg((F.max("o_orderkey").cast("double") / 1024).alias("auc"))
    return top_k(results, [F.desc("auc"), F.col("model")], 2)
