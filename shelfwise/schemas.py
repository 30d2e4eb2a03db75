"""One declared schema per table, used by batch and streaming readers alike."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_S, _D, _I = T.StringType(), T.DoubleType(), T.IntegerType()

RAW_PRODUCT = _struct(
    ("product_id", _S), ("name", _S), ("price", _S), ("rating", _D), ("sold", _S),
    ("location", _S), ("url", _S), ("category", _S), ("brand", _S), ("description", _S),
    ("image_url", _S), ("timestamp", _S),
)
RAW_REVIEW = _struct(
    ("review_id", _S), ("product_id", _S), ("username", _S), ("rating", _I),
    ("comment", _S), ("time", _S), ("timestamp", _S),
)
RAW_EVENT = _struct(("user_id", _S), ("product_id", _S), ("action", _S), ("timestamp", _S))
USER = _struct(("user_id", _S), ("name", _S), ("email", _S), ("registration_date", _S))
RECOMMENDATION = _struct(
    ("user_id", _S), ("product_id", _S), ("name", _S), ("price", _S), ("rating", _D),
    ("cb_score", _D), ("cf_score", _D), ("mf_score", _D), ("hybrid_score", _D),
    ("popularity_score", _D), ("recommendation_score", _D), ("algorithm", _S),
)
# Column left in raw reads so that unparsable lines are kept for inspection.
CORRUPT = T.StructField("_corrupt_record", T.StringType(), True)


def with_corrupt(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, CORRUPT])


RAW = {"products": RAW_PRODUCT, "reviews": RAW_REVIEW, "user_behavior": RAW_EVENT}
