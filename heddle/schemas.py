"""Schemas of the transaction model."""

from pyspark.sql import types as T

#: Names of the raw fields, by position; the file's own header repeats a name and is not used.
RAW_NAMES = "timestamp from_bank from_acct to_bank to_acct amt_received recv_ccy amt_paid pay_ccy payment_format is_laundering".split()
RAW = T.StructType([T.StructField(n, T.StringType()) for n in RAW_NAMES])
TIMESTAMP_FORMAT = "yyyy/MM/dd HH:mm"

#: What identifies a payment apart from its label.
KEY_COLUMNS = RAW_NAMES[:-1]

_STRINGS = T.ArrayType(T.StringType())


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


TRANSACTIONS = _struct(
    txn_id=T.LongType(), timestamp=T.TimestampType(), from_bank=T.StringType(), from_acct=T.StringType(), to_bank=T.StringType(), to_acct=T.StringType(),
    src=T.StringType(), dst=T.StringType(), amt_received=T.DoubleType(), recv_ccy=T.StringType(), amt_paid=T.DoubleType(), pay_ccy=T.StringType(),
    payment_format=T.StringType(), is_laundering=T.ByteType(), is_self_loop=T.BooleanType(),
)
FINDINGS = _struct(
    detector=T.StringType(), account_ids=_STRINGS, txn_ids=T.ArrayType(T.LongType()), start_ts=T.TimestampType(), end_ts=T.TimestampType(),
    total_usd=T.DoubleType(), score=T.DoubleType(), detail=T.StringType(),
)
DETECTORS = ["temporal_cycle", "fan_in", "fan_out", "scatter_gather", "gather_scatter", "pass_through"]
