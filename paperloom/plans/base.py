"""Tables that many queries start from, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.sources.tables import chunks_flat, last_wins, table

#: Current chunks: the last row of each id.
CUR = """WITH cur AS (SELECT id, text, line_no, split_part(id, '-', 1) AS file, metadata.source AS source, metadata.page AS page,
  metadata.article AS article, metadata.category AS category, metadata.collection AS collection, extracted_at
  FROM (SELECT *, rank() OVER (PARTITION BY id ORDER BY line_no DESC) AS rn FROM chunks
        WHERE id IS NOT NULL AND line_no IS NOT NULL) WHERE rn = 1)
"""

#: Valid vectors, the last row of each id.
VEC = """, vec AS (SELECT row_no, id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY row_no DESC) AS rn FROM chunk_vectors
  WHERE id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0) WHERE rn = 1),
 unit AS (SELECT row_no, id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM vec)
"""

#: A strip of all white space, as SQL.
def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


#: What compatibility composition makes of the characters that the tables hold and of some more.
COMPOSED = {"…": "...", "ﬁ": "fi", "①": "1", "Ａ": "A", "½": "1⁄2", "㎏": "kg", "ﬀ": "ff", "²": "2"}


def sql_composed(x: str) -> str:
    for a, b in COMPOSED.items():
        x = f"replace({x}, '{a}', '{b}')"
    return x


def sql_visible(x: str) -> str:
    x = sql_composed(x)
    for ch in "\u00ad\u200b\u200c\u200d\ufeff":
        x = f"replace({x}, '{ch}', '')"
    return f"replace({x}, '\u00a0', ' ')"


def sql_clean(x: str) -> str:
    return f"coalesce({sql_strip(f'''regexp_replace({sql_visible(x)}, '[ \\t]+', ' ', 'g')''')}, '')"


def current(spark: SparkSession, d: str, *columns) -> DataFrame:
    df = last_wins(chunks_flat(spark, d), "id", "line_no")
    return df.select(*columns) if columns else df


def vectors(spark: SparkSession, d: str) -> DataFrame:
    """(row_no, id, embedding) of the last valid row of each id."""
    from paperloom.operators.dense import valid

    v = table(spark, d, "chunk_vectors").where(valid(F.col("embedding"), 64))
    return last_wins(v.where(F.col("id").isNotNull()), "id", "row_no")
