"""Status codes, column names and result StructTypes."""

from pyspark.sql import types as T

# Queue / page status codes (must equal the reference's enum).
PENDING = 0
PROCESSING = 1
FINISHED = 2
ERROR = 3
UNINDEXABLE = 4

# Full-text columns in index order, and the weights used for
# ordering search results (the returned rank uses weight 1 everywhere).
FTS_COLUMNS = ["url", "title", "description", "content"]
ORDER_WEIGHTS = [1.0, 3.0, 0.8, 1.0]
RANK_WEIGHTS = [1.0, 1.0, 1.0, 1.0]

# BM25 parameters and the idf floor.
BM25_K1 = 1.2
BM25_B = 0.75
IDF_FLOOR = 1e-6

# Results per page, RRF constant and vector weight.
PAGE_SIZE = 10
RRF_K = 60
RRF_VEC_WEIGHT = 0.5

# Stale claim timeout in seconds.
STALE_SECONDS = 60

MATCH = T.StructType([
    T.StructField("highlighted", T.BooleanType(), False),
    T.StructField("content", T.StringType(), False),
])
SEGMENTS = T.ArrayType(MATCH, False)

PAGES = T.StructType([
    T.StructField("page", T.LongType(), False),
    T.StructField("source", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("title", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("content", T.StringType(), True),
    T.StructField("depth", T.IntegerType(), False),
    T.StructField("status", T.ByteType(), False),
    T.StructField("crawled_at", T.TimestampType(), True),
    T.StructField("error_info", T.StringType(), True),
])
