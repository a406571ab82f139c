"""Declared schemas. Nothing in this library infers a schema."""

from pyspark.sql import types as T

TRADE = T.StructType(
    [
        T.StructField("trade_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("quantity", T.DoubleType()),
        T.StructField("side", T.StringType()),
        T.StructField("account_id", T.StringType()),
        T.StructField("counterparty_id", T.StringType()),
        T.StructField("venue", T.StringType()),
        T.StructField("currency", T.StringType()),
    ]
)

# One alert as an element of a per-trade array; ``details`` is a JSON object
# whose keys depend on the detector.
ALERT_DDL = "struct<detector:string,rank:int,position:int,severity:string,score:double,reason:string,details:string>"

AUDIT = T.StructType(
    [
        T.StructField("ts", T.TimestampType()),
        T.StructField("level", T.StringType()),
        T.StructField("logger", T.StringType()),
        T.StructField("msg", T.StringType()),
        T.StructField("request_id", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("outcome", T.StringType()),
        T.StructField("audit", T.BooleanType()),
        T.StructField("client", T.StringType()),
        T.StructField("symbol", T.StringType()),
        T.StructField("reason", T.StringType()),
        T.StructField("code", T.StringType()),
        T.StructField("trade_id", T.StringType()),
        T.StructField("anomalous", T.BooleanType()),
        T.StructField("alerts", T.IntegerType()),
        T.StructField("path", T.StringType()),
    ]
)

JOB_RUN = T.StructType(
    [
        T.StructField("epoch", T.LongType()),
        T.StructField("last_cycle", T.StringType()),
        T.StructField("cycle", T.LongType()),
        T.StructField("seed", T.LongType()),
        T.StructField("trades", T.LongType()),
        T.StructField("mr_anomalies", T.LongType()),
        T.StructField("spark", T.StringType()),
    ]
)
