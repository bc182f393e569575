"""Byte statistics of whole columns, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F, types as T


_STATS = T.StructType([T.StructField("entropy", T.DoubleType()), T.StructField("top_byte", T.LongType()), T.StructField("longest_run", T.LongType())])


@F.pandas_udf(_STATS)
def byte_stats(text: pd.Series) -> pd.DataFrame:
    """Shannon entropy of the bytes in bits, count of the commonest byte, longest run of one byte; zeros for a null or empty text."""
    out = np.zeros((len(text), 3))
    for k, t in enumerate(text):
        if t:
            b = np.frombuffer(t.encode(), np.uint8)
            n = np.bincount(b)
            p = n[n > 0] / len(b)
            edge = np.flatnonzero(np.diff(b, prepend=b[0] ^ 1, append=b[-1] ^ 1))
            out[k] = -(p * np.log2(p)).sum(), n.max(), np.diff(edge).max()
    return pd.DataFrame({"entropy": out[:, 0], "top_byte": out[:, 1].astype(np.int64), "longest_run": out[:, 2].astype(np.int64)})


#: DuckDB's twin: a frame of ``doc_id`` with the three statistics.
BYTE_STATS_SQL = """
SELECT doc_id, list_sum(list_transform(map_values(h), lambda c: -(c / n) * log2(c / n))) AS entropy, list_max(map_values(h)) AS top_byte, longest_run
FROM (SELECT doc_id, len(b) AS n, list_aggregate(b, 'histogram') AS h FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents WHERE text <> ''))
JOIN (SELECT doc_id, max(c) AS longest_run FROM (
  SELECT doc_id, count(*) AS c FROM (
    SELECT doc_id, x, p - row_number() OVER (PARTITION BY doc_id, x ORDER BY p) AS g FROM (
      SELECT doc_id, unnest(b) AS x, unnest(range(1, len(b) + 1)) AS p FROM (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents WHERE text <> '')))
  GROUP BY doc_id, x, g) GROUP BY doc_id) USING (doc_id)
"""
