"""Tables that stand in for images: planes, pixels, deep samples, bytes, sizes and channel names.

embeddings: a plane of one row per vector, and pixels of four interleaved values; orders and lineitem: deep pixels
and their samples; documents: byte sequences; part: image sizes and channel names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v"))


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), "embedding")


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lucidframe.operators.grid import deinterleave

    return deinterleave(packed(spark, sf_dir), "embedding", list("RGBA"), ["y"])


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Widths, heights and tiles from part sizes."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", (F.col("p_size") * 37).alias("w"), (F.col("p_size") * 11 + 3).alias("h"), (F.col("p_size") % 7 * 8 + 8).alias("t"), (F.col("p_partkey") % 2).cast("int").alias("up"), (F.col("p_partkey") % 3).cast("int").alias("mode"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Channel names of one part each: with, without and with misplaced dots."""
    p = table(spark, sf_dir, "part")
    c = F.element_at(F.array(*[F.lit(x) for x in "RGBAZ"]), (F.col("p_partkey") % 5 + 1).cast("int"))
    kind = F.col("p_partkey") % 6
    name = F.when(kind == 0, c).when(kind == 1, F.concat(F.lit("."), c)).when(kind == 2, F.concat(c, F.lit("."))).when(kind == 3, F.concat("p_brand", F.lit(".a."), c)).when(kind == 4, F.concat(F.lit("x"), "p_brand", F.lit("."), c)).otherwise(F.concat("p_brand", F.lit("."), c))
    return p.select("p_partkey", "p_brand", name.alias("name"))


SQL_PLANE = "plane AS (SELECT vec_id AS y, CAST(unnest(range(0, len(embedding))) AS INTEGER) AS x, unnest(embedding) AS v FROM embeddings)"
SQL_RGBA = "rgba AS (SELECT y, CAST(p AS INTEGER) AS x, e[4 * p + 1] AS R, e[4 * p + 2] AS G, e[4 * p + 3] AS B, e[4 * p + 4] AS A FROM (SELECT vec_id AS y, embedding AS e, unnest(range(0, len(embedding) // 4)) AS p FROM embeddings))"
SQL_SIZES = "sizes AS (SELECT p_partkey, p_size * 37 AS w, p_size * 11 + 3 AS h, p_size % 7 * 8 + 8 AS t, CAST(p_partkey % 2 AS INTEGER) AS up, CAST(p_partkey % 3 AS INTEGER) AS mode FROM part)"
SQL_NAMES = """names AS (SELECT p_partkey, p_brand, CASE p_partkey % 6 WHEN 0 THEN c WHEN 1 THEN '.' || c WHEN 2 THEN c || '.' WHEN 3 THEN p_brand || '.a.' || c WHEN 4 THEN 'x' || p_brand || '.' || c ELSE p_brand || '.' || c END AS name
  FROM (SELECT *, (['R', 'G', 'B', 'A', 'Z'])[p_partkey % 5 + 1] AS c FROM part))"""
SQL_BYTES = "bytes AS (SELECT doc_id, CAST(unnest(range(0, strlen(text))) AS INTEGER) AS i, CAST('0x' || unnest(regexp_extract_all(hex(encode(text)), '..')) AS INTEGER) AS b FROM documents WHERE text IS NOT NULL)"
SQL_DEEP = "deep AS (SELECT o_orderkey, o_orderkey // 100 AS line, o_orderkey % 100 AS x, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey)"
