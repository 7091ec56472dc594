"""Sources, sinks, samples and scalar projections."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import functions as F

from tablewright.functions.columns import col
from tablewright.operators import completeness
from tablewright.sources import readers
from tablewright.sources.sampling import sample_rows
from tablewright.sources.storage import materialise, shared_folder

from .tables import ORDER_COLUMNS, ORDER_ID, dirty_orders, table, with_dirty

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


@query(
    """SELECT value, CAST(user_id AS DOUBLE) AS user_id, CAST(CAST(event_id AS INTEGER) AS VARCHAR) AS event_id,
       CAST(hour(ts) AS DOUBLE) AS hour_of_day, CAST(dayofweek(ts) + 1 AS DOUBLE) AS day_of_week
       FROM events WHERE value IS NOT NULL"""
)
def typed_projection(spark, folder):
    events = table(spark, folder, "events")
    return readers.project_typed(events, ["value", "user_id"], ["event_id"], "ts", required="value")


@query(
    r"""SELECT conv_id, turn, nullif(trim(regexp_replace(text, '\.$', '')), '?') AS text FROM conversations"""
)
def token_cleaning(spark, folder):
    df = table(spark, folder, "conversations")
    return df.select("conv_id", "turn", readers.clean_token(F.col("text")).alias("text"))


@query(
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, 'customer' AS origin FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier' FROM supplier"""
)
def union_provenance(spark, folder):
    names = ("id", "name", "balance")
    parts = {
        "customer": table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal").toDF(*names),
        "supplier": table(spark, folder, "supplier").select("s_suppkey", "s_name", "s_acctbal").toDF(*names),
    }
    return readers.union_sources(parts, "origin")


@query(
    """SELECT CAST(l_orderkey AS DOUBLE) AS order_key, l_quantity AS quantity, l_extendedprice AS extended_price,
       l_discount AS discount FROM lineitem"""
)
def delimited_numbers(spark, folder):
    """Write a delimited file with a header that needs tidying, and read it back."""
    path = f"{shared_folder(spark)}/delimited-{uuid4().hex}"
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount")
    named = lines.toDF("order key", "quantity", "extended price", "discount")
    named.write.option("header", "true").option("sep", ";").csv(path)
    return readers.read_delimited_numbers(spark, path)


@query(
    with_dirty(
        "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM dirty"
    )
)
def headerless_csv(spark, folder):
    """Write nulls as the null token and labels with a trailing mark, and read them back."""
    path = f"{shared_folder(spark)}/headerless-{uuid4().hex}"
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    text = dirty_orders(spark, folder).select(*names).withColumn("o_orderstatus", F.concat("o_orderstatus", F.lit(".")))
    text.select(*[F.coalesce(col(c).cast("string"), F.lit("?")).alias(c) for c in names]).write.csv(path)
    types = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_totalprice": "double"}
    return readers.read_headerless_csv(spark, path, names, types)


@query(
    with_dirty(
        " UNION ALL ".join(
            f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count FROM dirty" for c in ORDER_COLUMNS
        )
    )
)
def materialised_table(spark, folder):
    stored = materialise(dirty_orders(spark, folder), "dirty")
    return completeness.missingness(stored.df).select("column", "missing_count")


_SAMPLE = 5000


@query(
    f"""SELECT o_orderkey, o_totalprice FROM orders
        ORDER BY CAST('0x' || substr(md5('42:' || CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) LIMIT {_SAMPLE}"""
)
def fixed_size_sample(spark, folder):
    df = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return sample_rows(df, _SAMPLE, 42, ORDER_ID)


@query(
    with_dirty(
        f"""SELECT o_orderkey, 'bucket_' || (o_custkey % 20) AS bucket,
            greatest(100000.0::DOUBLE, o_totalprice) AS floored,
            CASE WHEN o_totalprice < 100000 THEN 'small' WHEN o_totalprice > 400000 THEN 'large' ELSE 'medium' END AS size,
            CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' WHEN 'P' THEN 'pending' END AS status,
            TRY_CAST(o_orderpriority AS INTEGER) AS priority_number,
            nullif(regexp_replace(o_orderpriority, '^[0-9]-', ''), 'LOW') AS priority_name,
            CAST(hour(o_orderdate) AS INTEGER) AS hour, CAST(dayofweek(o_orderdate) + 1 AS INTEGER) AS weekday,
            o_totalprice IS NULL AS unpriced
        FROM dirty WHERE o_orderstatus IS NOT NULL"""
    )
)
def scalar_projections(spark, folder):
    price = F.col("o_totalprice")
    names = F.create_map(*[F.lit(x) for x in ("F", "finished", "O", "open", "P", "pending")])
    return dirty_orders(spark, folder).filter(F.col("o_orderstatus").isNotNull()).select(
        "o_orderkey",
        F.concat(F.lit("bucket_"), (F.col("o_custkey") % 20).cast("string")).alias("bucket"),
        F.greatest(F.lit(100000.0), price).alias("floored"),
        F.when(price < 100000, "small").when(price > 400000, "large").otherwise("medium").alias("size"),
        names[F.col("o_orderstatus")].alias("status"),
        F.col("o_orderpriority").try_cast("int").alias("priority_number"),
        F.nullif(F.regexp_replace("o_orderpriority", "^[0-9]-", ""), F.lit("LOW")).alias("priority_name"),
        F.hour("o_orderdate").alias("hour"),
        F.dayofweek("o_orderdate").alias("weekday"),
        price.isNull().alias("unpriced"),
    )
