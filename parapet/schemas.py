"""Row schemas shared by readers, writers and streams."""

from pyspark.sql import types as T

MESSAGE = T.StructType([
    T.StructField("message_id", T.StringType()),
    T.StructField("seq", T.LongType()),
    T.StructField("content", T.StringType()),
    T.StructField("from_agent", T.StringType()),
    T.StructField("to_agent", T.StringType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("ts", T.TimestampType()),
])

# the six columns every labelled dataset is reduced to
DATASET_COLUMNS = ["message_id", "content", "from_agent", "to_agent", "label", "attack_type"]

AUDIT = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("message_id", T.StringType()),
    T.StructField("from_agent", T.StringType()),
    T.StructField("to_agent", T.StringType()),
    T.StructField("attack_type", T.StringType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("content_preview", T.StringType()),
])
