"""The schema of raw sales: text throughout, codes and numbers included; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# The columns of raw sales.
RAW_SALE = T.StructType([T.StructField(c, T.StringType()) for c in ("address", "city", "price", "surface", "rooms", "sale_date", "property_type", "property_url")])
