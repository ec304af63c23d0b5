"""Listed laundering attempts: a text of blocks, and its rows' transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from heddle import schemas
from heddle.functions import scans

# The lines of the file format.
BEGIN = r"^BEGIN LAUNDERING ATTEMPT - ([A-Z-]+)(?::\s*(.*))?$"
END = r"^END LAUNDERING ATTEMPT - ([A-Z-]+)$"


def parse(spark: SparkSession, path: str) -> DataFrame:
    """attempt_id, typology, detail, seq and the raw fields, typed; ValueError for a malformed file.

    Lines are numbered by file position; running sums over bins of lines tell which block a line is in.
    """
    lines = scans.numbered(spark.read.text(path).select(F.trim("value").alias("line")), "at").where("line <> ''")
    lines = lines.withColumns({"one": F.lit(1), "begins": F.col("line").rlike(BEGIN).cast("int"), "ends": F.col("line").rlike(END).cast("int")})
    lines = lines.withColumn("row", 1 - F.col("begins") - F.col("ends"))
    lines = scans.global_sums(lines.withColumns({"opened": F.col("begins"), "closed": F.col("ends"), "rows": F.col("row")}), "at", ["opened", "closed", "rows"], descending=False)
    lines = lines.withColumn("attempt_id", F.col("opened").cast("int") - 1)
    heads = lines.where("begins = 1").select("attempt_id", F.regexp_extract("line", BEGIN, 1).alias("typology"), F.trim(F.regexp_extract("line", BEGIN, 2)).alias("detail"), F.col("rows").alias("rows_before"))
    d = lines.join(heads, "attempt_id", "left")
    depth = F.col("opened") - F.col("closed")
    problem = (
        F.when((F.col("begins") == 1) & (depth > 1), "BEGIN inside an open attempt")
        .when((F.col("ends") == 1) & ((depth < 0) | (F.regexp_extract("line", END, 1) != F.col("typology"))), "unmatched END line")
        .when((F.col("row") == 1) & (depth != 1), "row outside an attempt")
        .when((F.col("row") == 1) & (F.size(F.split("line", ",")) != len(schemas.RAW_NAMES)), f"a row needs {len(schemas.RAW_NAMES)} fields")
    )
    bad = d.select("at", problem.alias("problem")).where("problem is not null").orderBy("at").first()
    if bad is not None:
        raise ValueError(f"{path}, line {bad['at'] + 1}: {bad.problem}")
    still = lines.agg(F.sum("begins") - F.sum("ends")).first()[0]
    if still:
        raise ValueError(f"{path}: the file ends inside an open attempt")
    f = F.split("line", ",")
    raw = [f[i].alias(n) for i, n in enumerate(schemas.RAW_NAMES)]
    rows = d.where("row = 1").select("attempt_id", "typology", "detail", (F.col("rows") - F.col("rows_before") - 1).cast("int").alias("seq"), *raw)
    return rows.withColumns({
        "timestamp": F.to_timestamp("timestamp", schemas.TIMESTAMP_FORMAT),
        "amt_received": F.col("amt_received").cast("double"),
        "amt_paid": F.col("amt_paid").cast("double"),
        "is_laundering": F.col("is_laundering").cast("byte"),
    })


def match(attempts: DataFrame, txns: DataFrame) -> DataFrame:
    """Adds txn_id, null if there is none: the n-th attempt row with a key takes the (n mod k)-th of its k laundering transactions."""
    keys = schemas.KEY_COLUMNS
    by = Window.partitionBy(*keys)
    known = txns.where("is_laundering = 1").select("txn_id", *keys)
    known = known.withColumns({"__rank": F.row_number().over(by.orderBy("txn_id")) - 1, "__k": F.count("*").over(by)})
    a = attempts.withColumn("__nth", F.row_number().over(by.orderBy("attempt_id", "seq")) - 1)
    sizes = known.where("__rank = 0").select(*keys, "__k")
    a = a.join(sizes, keys, "left").withColumn("__rank", F.col("__nth") % F.col("__k")).drop("__k")
    return a.join(known.drop("__k"), [*keys, "__rank"], "left").select(*attempts.columns, "txn_id")
