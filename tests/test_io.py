"""Readers, writers, schema operators and incremental landing on small files."""

import json

import pytest
from pyspark.sql import functions as F, types as T

from lendlens import shared
from lendlens.operators import schema as S
from lendlens.schemas import IMPORTANCE_LOG, PIPE_LAR_COLUMNS, canonical_lar
from lendlens.shared import settle
from lendlens.sources import files, ledger, responses, sinks
from lendlens.streaming.landing import ingest_new


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_lar_csv_tokens_and_year(spark, tmp_path):
    p = write(tmp_path / "lar_2019.csv", "lei,income,rate\nA,Exempt,1.5\nB,85,NA\n")
    rows = files.read_lar_csv(spark, p).orderBy("lei").collect()
    assert [tuple(r) for r in rows] == [("A", None, "1.5", 2019), ("B", "85", None, 2019)]


def test_pipe_lar_filters_by_place(spark, tmp_path):
    def line(state, county):
        values = [""] * len(PIPE_LAR_COLUMNS)
        values[0], values[9], values[10] = "2023", state, county
        return "|".join(values)

    p = write(tmp_path / "mlar.txt", "\n".join([line("WI", "55079"), line("WI", "55001"), line("IL", "17031")]))
    assert files.read_pipe_lar(spark, p, "WI", "55079").count() == 1
    headed = write(tmp_path / "headed.txt", "a|property_state|property_county\n1|WI|55079\n2|IL|1\n")
    assert [r.a for r in files.read_pipe_lar(spark, headed, "WI", names=None).collect()] == ["1"]


def test_fips_and_market(spark, tmp_path):
    p = write(tmp_path / "state.txt", "STATE|STUSAB|STATE_NAME|STATENS\n01|AL|Alabama|1\n")
    assert files.read_state_fips(spark, p).collect()[0].usps == "AL"
    p = write(tmp_path / "county.txt", "a|b|c|d|e|f|g\nWI|55|079|1|Milwaukee County|H1|A\n")
    assert files.read_county_fips(spark, p).collect()[0].census_county_cd == "55079"
    p = write(tmp_path / "market.tsv", "PERIOD_BEGIN\tMEDIAN_PPSF\n2019-01-01\t5\n")
    assert files.read_market_tsv(spark, p).columns == ["period_begin", "median_ppsf"]


def test_preamble_csv(spark, tmp_path):
    header = "State-Code, County Code,Tract Code,Distressed,Under served"
    for year in (2022, 2023):
        write(tmp_path / f"{year}.csv", f"A title line\nSecond line\n{header}\n55,79,0101.02,X,\n55,79,total,,\n")
    raw = files.read_csv_skip(spark, str(tmp_path), 2)
    assert raw.count() == 4
    got = responses.clean_distressed(raw, files.path_year(F.col("source_file"))).select("tract_fips", "is_distressed", "is_underserved")
    assert [tuple(r) for r in got.collect()] == [("55079010102", 1, 0)] * 2


def test_preamble_is_skipped_by_position(spark, tmp_path):
    write(tmp_path / "a.csv", '2021\n\n"Name, full",N\n2021 Town,1\n2021\n"Name, full",N\n\nB,2\n')
    write(tmp_path / "b.csv", 'other\nlines\n"Name, full",N\nC,3\n')
    got = files.read_csv_skip(spark, str(tmp_path), 2)
    assert got.columns == ["name,_full", "n", "source_file"]
    assert sorted(((r[0], r[1]) for r in got.collect()), key=str) == sorted(
        [("2021 Town", "1"), ("2021", None), ("Name, full", "N"), ("B", "2"), ("C", "3")], key=str
    )
    with pytest.raises(ValueError):
        files.read_csv_skip(spark, str(tmp_path), 50)
    write(tmp_path / "c.csv", 'x\ny\nn, "NAME, full"\n3,C\n')
    with pytest.raises(ValueError, match="different headers"):
        files.read_csv_skip(spark, str(tmp_path), 2)


def test_parquet_dir_unions_by_name(spark, tmp_path):
    spark.range(2).write.parquet(str(tmp_path / "t" / "y=1"))
    spark.range(3).withColumn("extra", F.lit("x")).write.parquet(str(tmp_path / "t" / "y=2"))
    df = files.read_parquet_dir(spark, str(tmp_path / "t"))
    assert df.count() == 5 and "extra" in df.columns


def test_valid_files_are_loaded_and_bad_ones_reported(spark, tmp_path):
    good = tmp_path / "part_1_3.parquet"
    spark.createDataFrame([(1,), (2,), (3,)], "rn bigint").toPandas().to_parquet(good)
    bad = write(tmp_path / "part_4_6.parquet", "not parquet")
    rows, audit = files.load_valid_files(spark, [str(good), bad])
    assert rows.count() == 3
    got = {r.file: (r.loaded, r.rows_read, r.min_rn, r.max_rn, r.expected_to) for r in audit.collect()}
    assert got == {"part_1_3.parquet": (True, 3, 1, 3, 3), "part_4_6.parquet": (False, None, None, None, 6)}


def test_valid_files_with_equal_names_empty_and_damaged(spark, tmp_path):
    frame = spark.range(50_000).selectExpr("id AS rn", "uuid() AS x").toPandas()
    for folder in ("2018", "2019 a+b", "empty", "cut", "hurt"):
        (tmp_path / folder).mkdir()
    frame[:5].to_parquet(tmp_path / "2018" / "x.parquet")
    write(tmp_path / "2019 a+b" / "x.parquet", "garbage")
    frame[:0].to_parquet(tmp_path / "empty" / "x.parquet")
    frame.to_parquet(tmp_path / "cut" / "x.parquet", row_group_size=5000)
    whole = (tmp_path / "cut" / "x.parquet").read_bytes()
    (tmp_path / "cut" / "x.parquet").write_bytes(whole[: len(whole) // 2])
    middle = len(whole) // 2
    (tmp_path / "hurt" / "x.parquet").write_bytes(whole[:middle] + b"\xff" * 4000 + whole[middle + 4000 :])
    names = ["2018", "2019 a+b", "empty", "cut", "hurt"]
    rows, audit = files.load_valid_files(spark, [str(tmp_path / n / "x.parquet") for n in names])
    got = {r.path.split("/")[-2]: (r.loaded, r.rows_read) for r in audit.collect()}
    assert got["2018"] == (True, 5) and got["empty"] == (True, 0)
    assert got["2019 a+b"] == got["cut"] == got["hurt"] == (False, None)
    assert rows.count() == 5 and audit.count() == 5


def test_year_of_folder_or_file(spark):
    paths = ["file:/a/2019/lar.csv", "file:/a/lar_2020.csv", "s3://b/year=2018/part-00000-2021.csv", "file:/a/lar.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(files.path_year(F.col("p"))).collect()] == [2019, 2020, 2018, None]


def test_settled_tables_can_be_cleared(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(shared, "shared_folder", lambda _: str(tmp_path))
    kept = settle(spark.range(3))
    assert kept.count() == 3 and list(tmp_path.rglob("*.parquet"))
    assert shared.clear_settled(spark)
    assert not list(tmp_path.rglob("*.parquet")) and not list((tmp_path / "lendlens").iterdir())


def test_lei_responses(spark, tmp_path):
    body = {"data": {"attributes": {"entity": {"legalName": {"name": "Acme"}, "headquartersAddress": {"addressLines": ["1 St"]}}, "registration": {"status": "ISSUED"}}}}
    found = spark.createDataFrame([("A", json.dumps(body)), ("B", None)], "lei string, body string")
    asked = spark.createDataFrame([("A",), ("B",), ("C",), ("C",)], "lei string")
    got = {r.lei: (r.entity_name, r.registration_status, r.headquarters_address) for r in responses.parse_lei_json(found, asked).collect()}
    assert got == {"A": ("Acme", "ISSUED", ["1 St"]), "B": (None, "Error", None), "C": (None, "Error", None)}


def test_acs_response_files(spark, tmp_path):
    header = ["NAME", "B03002_001E", "B19083_001E", "state", "county", "tract"]
    write(tmp_path / "01.json", json.dumps([header, ["T1", "12", "0.4", "01", "001", "000100"], ["T2", "bad", None, "01", "001", "000200"]]))
    rows = responses.parse_acs_json(files_docs(spark, tmp_path), header).orderBy("name").collect()
    assert [(r.total_population, r.gini_index_of_income_inequality) for r in rows] == [(12, 0.4), (None, None)]


def files_docs(spark, path):
    return responses.read_documents(spark, str(path))


def test_centroid_of_a_square_with_a_hole(spark):
    outer = [(0, 0), (4, 0), (4, 4), (0, 4)]
    hole = [(3, 1), (1, 1), (1, 3), (3, 3)]
    rows = [("T", r, i, float(x), float(y)) for r, ring in enumerate([outer, hole]) for i, (x, y) in enumerate(ring)]
    got = responses.ring_centroids(spark.createDataFrame(rows, "tract_fips string, ring_id int, seq int, lon double, lat double")).collect()[0]
    assert (got.centroid_lat, got.centroid_lon) == pytest.approx((2, 2))


def test_chunked_write_limits_rows_per_file(spark, tmp_path):
    sinks.write_chunks(spark.range(1000).coalesce(1), str(tmp_path / "c"), rows=300)
    sizes = [r["count"] for r in spark.read.parquet(str(tmp_path / "c")).groupBy(F.input_file_name()).count().collect()]
    assert sum(sizes) == 1000 and max(sizes) <= 300
    with pytest.raises(TypeError):
        S.validate_schema(spark.range(1), T.StructType([T.StructField("id", T.StringType())]))


def test_partitioned_write_prunes(spark, tmp_path):
    df = spark.range(100).withColumns({"activity_year": F.col("id") % 3 + 2018, "loan_purpose_grouped": F.lit("Other")})
    sinks.write_partitioned(df, str(tmp_path / "p"), files=2)
    back = spark.read.parquet(str(tmp_path / "p")).filter("activity_year = 2019")
    assert back.count() == 33
    assert "PartitionFilters: [isnotnull(activity_year" in back._jdf.queryExecution().toString()


def test_range_chunks_are_contiguous(spark, tmp_path):
    sinks.write_range_chunks(spark.range(100).withColumnRenamed("id", "rn"), str(tmp_path / "r"), chunks=4)
    spans = spark.read.parquet(str(tmp_path / "r")).groupBy(F.input_file_name().alias("f")).agg(F.min("rn").alias("a"), F.max("rn").alias("b"), F.count("*").alias("n")).collect()
    assert all(s.b - s.a + 1 == s.n for s in spans)


def test_append_new_is_idempotent(spark, tmp_path):
    path = str(tmp_path / "s")
    sinks.append_new(spark.range(5), path, "id")
    sinks.append_new(spark.range(3, 8), path, "id")
    sinks.append_new(spark.range(3, 8), path, "id")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(8))


def test_append_new_works_rows_out_once(spark, tmp_path):
    """Every further pass over a join of large tables would shuffle them again."""
    seen = spark.sparkContext.accumulator(0)

    def tick(i):
        seen.add(1)
        return i % 10

    key = F.udf(tick, "bigint").asNondeterministic()
    rows = spark.range(40).select(key("id").alias("k"), (F.col("id") % 2).alias("y"), (100 - F.col("id")).alias("price"))
    path = str(tmp_path / "once")
    for _ in range(2):
        sinks.append_new(rows, path, "k", [F.col("price")], partition="y")
    assert seen.value == 80
    assert sorted((r.k, r.price) for r in spark.read.parquet(path).collect()) == [(i, 70 - i) for i in range(10)]


def test_logs_and_csv(spark, tmp_path):
    row = spark.createDataFrame([("f", 0.5, "e", "m", 0)], IMPORTANCE_LOG)
    for _ in range(2):
        sinks.append_log(row, str(tmp_path / "log"), IMPORTANCE_LOG)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.write_csv(row, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == row.columns


def test_materialize_view(spark):
    assert sinks.materialize(spark.range(4), "lendlens_view", "view").count() == 4


def test_enforce_schema(spark):
    want = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.DoubleType()), T.StructField("c", T.StringType())])
    df = spark.createDataFrame([("1.0", float("inf"), 5), ("x", 2.0, 6)], "a string, b double, x_category int")
    got = S.enforce_schema(df, want, keep_extra=True)
    assert [tuple(r) for r in got.collect()] == [(1, None, None, "5"), (None, 2.0, None, "6")]
    S.validate_schema(got, want)


def test_schema_audit_and_align(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    spark.createDataFrame([(1, "x")], "k bigint, v string").write.parquet(a)
    spark.createDataFrame([("1", 2.0)], "k string, w double").write.parquet(b)
    issues = {(r.column_name, r.issue) for r in S.schema_audit(spark, [a, b]).collect()}
    assert issues == {("k", "TypeMismatch"), ("w", "Unexpected"), ("v", "Missing")}
    aligned, diag = S.align(spark.read.parquet(b), spark.read.parquet(a).schema, "b")
    assert aligned.collect()[0].k == 1 and {r.action for r in diag.collect()} == {"cast", "dropped", "filled"}


def test_unify_schemas(spark):
    ddl = lambda s: spark.createDataFrame([], s).schema
    got = S.unify_schemas([ddl("a int, b string"), ddl("a double, c bigint, total_units int")], {"total_units": T.StringType()})
    assert got.simpleString() == "struct<a:double,b:string,c:bigint,total_units:string>"
    assert "a double" in S.create_table_ddl("t", got)


def test_infer_numeric_threshold(spark):
    rows = [(str(i), "x" if i < 2 else str(i), str(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "a string, b string, lei string")
    kinds = lambda **k: dict(S.infer_numeric(df, preserve=["lei"], **k).dtypes)
    assert kinds() == {"a": "double", "b": "double", "lei": "string"}
    assert kinds(strict=True) == {"a": "double", "b": "string", "lei": "string"}


def test_canonical_schema():
    assert len(canonical_lar()) == 134 and len(PIPE_LAR_COLUMNS) == 85


def test_stream_lands_each_file_and_id_once(spark, tmp_path):
    src, out, ck = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "ck")
    run = lambda: ingest_new(spark, str(src), out, ck, "id string, v string", "id")
    write(src / "2018.csv", "id,v\n1,a\n2,b\n1,a\n")
    run()
    run()
    write(src / "2019.csv", "id,v\n2,b\n3,c\n")
    run()
    schema = spark.createDataFrame([], "id string, v string").schema
    assert sorted((r.id, r.v) for r in ledger.landed(spark, out, schema).collect()) == [("1", "a"), ("2", "b"), ("3", "c")]


def test_land_batch_counts_once_and_reads_touched_prefixes_only(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    schema = spark.range(1).schema
    ids = lambda: sorted(r.id for r in ledger.landed(spark, out, schema).collect())
    assert ids() == []
    assert ledger.land_batch(spark.range(50), out, "id", "s-0")
    # a writer that died: rows and ids without a manifest row
    spark.range(900, 910).write.parquet(f"{out}/data/batch=s-1")
    spark.range(900, 910).withColumnRenamed("id", "key").withColumn("prefix", F.lit(0)).write.partitionBy("prefix").parquet(f"{out}/ids/batch=s-1")
    assert ids() == list(range(50))
    assert ledger.land_batch(spark.range(40, 60), out, "id", "s-1")
    assert not ledger.land_batch(spark.range(1000), out, "id", "s-1")
    assert ids() == list(range(60))
    entries = ledger.manifest(spark, out).collect()
    assert len(ledger._id_paths(entries, out, {3})) <= 2 < len(ledger._id_paths(entries, out))
    ledger.merge_ids(spark, out, "0", "bigint")
    ledger.merge_ids(spark, out, "1", "bigint")
    entries = ledger.manifest(spark, out).collect()
    assert all("merged=1" in p for p in ledger._id_paths(entries, out))
    assert ledger.land_batch(spark.range(70), out, "id", "s-2")
    assert ids() == list(range(70))
    assert ledger.land_batch(spark.range(5), out, "id", "s-3")
    assert ids() == list(range(70))
