from pyspark.sql import functions as F

from lendlens.operators import ranks, sampling
from lendlens.queries.registry import query
from lendlens.queries.standin import LOANS, RACE, SPAN, loans, order_key, table
from lendlens.shared import settle

ID = "loan_application_id"
_KEY = "(loan_application_id * 7919) % 1000003, loan_application_id"


def _keyed() -> dict:
    return {"key": order_key(), "span": SPAN}


@query("global_row_number", LOANS + "SELECT loan_application_id, row_number() OVER (ORDER BY loan_amount, loan_application_id) AS rn FROM loans")
def _(spark, sf):
    return ranks.row_numbers(loans(spark, sf).select(ID, "loan_amount"), ["loan_amount", ID]).select(ID, "rn")


@query("row_ids", LOANS + "SELECT activity_year, count(*) AS n_ids, (SELECT count(*) FROM loans) AS n_all FROM loans GROUP BY 1")
def _(spark, sf):
    """Ids of a year, and of all years together, are as many as the rows."""
    ids = settle(ranks.row_ids(loans(spark, sf).select("activity_year")))
    return ids.groupBy("activity_year").agg(F.count_distinct("row_id").alias("n_ids")).withColumn("n_all", ids.agg(F.count_distinct("row_id")).scalar())


@query(
    "row_number_in_group",
    LOANS
    + f"SELECT loan_application_id, row_number() OVER (PARTITION BY {RACE} ORDER BY loan_amount, loan_application_id) AS rn FROM loans",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, RACE, "loan_amount")
    return ranks.row_numbers(df, ["loan_amount", ID], [RACE]).select(ID, "rn")


@query(
    "random_rank_in_class",
    LOANS + f"SELECT loan_application_id, row_number() OVER (PARTITION BY loan_approved ORDER BY {_KEY}) AS rn FROM loans",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "loan_approved")
    return ranks.rank_by_key(df, order_key(), ID, SPAN, ["loan_approved"]).select(ID, "rn")


@query(
    "chunks",
    LOANS
    + f""", n AS (SELECT loan_application_id, row_number() OVER (ORDER BY {_KEY}) AS global_row_number FROM loans)
    SELECT *, CAST((global_row_number - 1) // 1000 AS BIGINT) AS chunk_number FROM n""",
)
def _(spark, sf):
    return sampling.assign_chunks(loans(spark, sf).select(ID), 1000, ID, **_keyed())


@query(
    "chunk_page",
    LOANS
    + f""", n AS (SELECT loan_application_id, row_number() OVER (ORDER BY {_KEY}) AS rn FROM loans)
    SELECT loan_application_id FROM n WHERE (rn - 1) // 500 = 2""",
)
def _(spark, sf):
    return sampling.assign_chunks(loans(spark, sf).select(ID), 500, ID, **_keyed()).filter("chunk_number = 2").select(ID)


@query(
    "interleave",
    LOANS
    + f""", r AS (SELECT loan_application_id, loan_approved,
      row_number() OVER (PARTITION BY loan_approved ORDER BY {_KEY}) AS rn_within_class FROM loans),
    g AS (SELECT *, row_number() OVER (ORDER BY rn_within_class, loan_approved) AS global_row_number FROM r)
    SELECT *, CAST((global_row_number - 1) // 400 AS BIGINT) AS chunk_number FROM g""",
)
def _(spark, sf):
    return sampling.interleave(loans(spark, sf).select(ID, "loan_approved"), "loan_approved", 400, ID, **_keyed())


@query(
    "sample_n_per_year",
    LOANS
    + f"""SELECT loan_application_id, activity_year FROM (SELECT *, row_number() OVER
      (PARTITION BY activity_year ORDER BY {_KEY}) AS rn FROM loans) WHERE rn <= 100""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "activity_year")
    return sampling.sample_n_per_group(df, ["activity_year"], 100, ID, **_keyed())


@query(
    "balanced_sample",
    LOANS
    + f"""SELECT loan_application_id, loan_approved FROM (SELECT *, row_number() OVER
      (PARTITION BY loan_approved ORDER BY {_KEY}) AS rn FROM loans) WHERE rn <= 500""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "loan_approved")
    return sampling.sample_n_per_group(df, ["loan_approved"], 500, ID, **_keyed())


@query(
    "hold_out_rest",
    LOANS
    + f"""SELECT loan_application_id, activity_year FROM (SELECT *, row_number() OVER
      (PARTITION BY activity_year ORDER BY {_KEY}) AS rn FROM loans) WHERE rn > 100""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "activity_year")
    return sampling.hold_out_per_group(df, ["activity_year"], 100, ID, **_keyed())[1]


@query(
    "sample_n",
    LOANS + f"SELECT loan_application_id FROM loans ORDER BY {_KEY} LIMIT 777",
)
def _(spark, sf):
    return sampling.sample_n(loans(spark, sf).select(ID), 777, ID, **_keyed())


@query(
    "sample_fraction",
    LOANS
    + f"""SELECT loan_application_id, loan_approved FROM (SELECT *, row_number() OVER
      (PARTITION BY loan_approved ORDER BY {_KEY}) AS rn, count(*) OVER (PARTITION BY loan_approved) AS n FROM loans)
    WHERE rn <= floor(n * 0.1::DOUBLE)""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "loan_approved")
    return sampling.sample_fraction_per_group(df, ["loan_approved"], 0.1, ID, **_keyed())


_SHARES = f"""shares AS (SELECT activity_year, {RACE}, count(*) AS total_count, CAST(sum(loan_approved) AS BIGINT) AS approved_count,
  CAST(sum(1 - loan_approved) AS BIGINT) AS denied_count, sum(loan_approved)::DOUBLE / count(*) AS approval_rate,
  CAST(round(2000::DOUBLE * (count(*)::DOUBLE / (SELECT count(*) FROM loans))) AS BIGINT) AS sample_size_group
  FROM loans GROUP BY 1, 2)"""


@query("sample_allocation", LOANS + f", {_SHARES} SELECT * FROM shares")
def _(spark, sf):
    return sampling.allocate(loans(spark, sf), ["activity_year", RACE], "loan_approved", 2000)


@query(
    "proportional_sample",
    LOANS
    + f""", {_SHARES}, r AS (SELECT *, row_number() OVER
      (PARTITION BY activity_year, {RACE}, loan_approved ORDER BY {_KEY}) AS rn FROM loans)
    SELECT loan_application_id, activity_year, {RACE}, loan_approved FROM r JOIN shares USING (activity_year, {RACE})
    WHERE (loan_approved = 1 AND rn <= sample_size_group * approval_rate)
      OR (loan_approved = 0 AND rn <= sample_size_group * (1 - approval_rate))""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "activity_year", RACE, "loan_approved")
    return sampling.stratified_sample(df, ["activity_year", RACE], "loan_approved", 2000, ID, **_keyed())


@query(
    "split_stratified",
    LOANS
    + f"""SELECT loan_application_id, loan_approved, row_number() OVER (PARTITION BY loan_approved ORDER BY {_KEY})
      <= floor(count(*) OVER (PARTITION BY loan_approved) * 0.1::DOUBLE) AS is_test FROM loans""",
)
def _(spark, sf):
    df = loans(spark, sf).select(ID, "loan_approved")
    return sampling.split_stratified(df, ["loan_approved"], 0.1, ID, **_keyed())


@query(
    "strata_label",
    LOANS
    + """SELECT loan_application_id, CAST(activity_year AS VARCHAR) || '_' || CAST(loan_purpose AS VARCHAR) || '-' ||
      CAST(loan_approved AS VARCHAR) AS strata_bin FROM loans""",
)
def _(spark, sf):
    df = loans(spark, sf).withColumn("purpose", F.col("loan_purpose").cast("string"))
    return df.select(ID, sampling.strata_label("activity_year", "purpose", "loan_approved").alias("strata_bin"))


@query(
    "seeded_split",
    LOANS + "SELECT count(*) AS n_rows, true AS by_edges, true AS in_range, true AS about_even, true AS repeatable FROM loans",
)
def _(spark, sf):
    """The parts follow the edges on the weight, and the weight is even and the same for every partitioning."""
    cut = lambda df: df.select(ID, sampling.split_column(ID), sampling.random_weight(ID))
    df, w = loans(spark, sf), F.col("sample_weight")
    first = cut(df)
    again = cut(df.repartition(7)).select(ID, w.alias("again"))
    return first.join(again, ID).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bool_and(F.col("split") == (w >= 0.98).cast("int") + (w >= 0.99).cast("int")).alias("by_edges"),
        F.bool_and((w >= 0) & (w < 1)).alias("in_range"),
        (F.abs(F.avg(w) - 0.5) < 0.05).alias("about_even"),
        F.bool_and(w == F.col("again")).alias("repeatable"),
    )


@query(
    "first_event_per_user",
    """SELECT user_id, event_id, ts, event_type, value, props FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, sf):
    return ranks.best_row(table(spark, sf, "events"), ["user_id"], [F.col("ts"), F.col("event_id")])


@query(
    "top_event_per_user",
    """SELECT user_id, event_id, ts, event_type, value, props FROM (SELECT *, row_number() OVER
      (PARTITION BY user_id ORDER BY value DESC NULLS LAST, event_id) AS rn FROM events) WHERE rn = 1""",
)
def _(spark, sf):
    return ranks.best_row(table(spark, sf, "events"), ["user_id"], [ranks.descending("value"), F.col("event_id")])
