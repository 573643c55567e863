"""The driver's tables in the roles of bibliographic ones.

An order is a document, its suppliers are the authors, their nations the countries, words of its parts' names and types
the keywords, a brand the source, quantities the citations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Roles:
    """Role tables over the Parquet files of ``folder``; each is a lazy DataFrame."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def lines(self) -> DataFrame:
        """Lines with the brand, name and type of their part."""
        part = self.table("part").select("p_partkey", "p_brand", "p_name", "p_type")
        line = self.table("lineitem").select("l_orderkey", "l_partkey", "l_quantity")
        return line.join(part, line["l_partkey"] == part["p_partkey"]).drop("p_partkey")

    def records(self) -> DataFrame:
        """``doc, year, citations, source, doc_type``: one row a document."""
        cited = self.lines().groupBy(F.col("l_orderkey").alias("doc")).agg(F.floor(F.sum("l_quantity")).cast("long").alias("citations"), F.min("p_brand").alias("source"))
        orders = self.table("orders").select(F.col("o_orderkey").alias("doc"), F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("doc_type"))
        return orders.join(cited, "doc", "left").withColumn("citations", F.coalesce("citations", F.lit(0)))

    def authors(self) -> DataFrame:
        """``doc, author``, each once."""
        return self.table("lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_suppkey").alias("author")).distinct()

    def nations(self) -> DataFrame:
        """``author, country, region``."""
        supplier, nation, region = self.table("supplier"), self.table("nation"), self.table("region")
        joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).join(region, nation["n_regionkey"] == region["r_regionkey"])
        return joined.select(F.col("s_suppkey").alias("author"), F.col("n_name").alias("country"), F.col("r_name").alias("region"))

    def regions(self) -> DataFrame:
        """``country, region``."""
        nation, region = self.table("nation"), self.table("region")
        return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("country"), F.col("r_name").alias("region"))

    def countries(self) -> DataFrame:
        """``doc, country``, each once."""
        return self.authors().join(self.nations(), "author").select("doc", "country").distinct()

    def keywords(self) -> DataFrame:
        """``doc, keyword``, each once: words of part names and types, lower case."""
        words = F.split(F.lower(F.concat_ws(" ", "p_name", "p_type")), " ")
        return self.lines().select(F.col("l_orderkey").alias("doc"), F.explode(words).alias("keyword")).distinct()


#: The same roles as common table expressions, for the SQL that checks queries.
PRELUDE = """
WITH RECURSIVE lines AS (SELECT l_orderkey AS doc, l_suppkey, l_quantity, p_brand, p_name, p_type FROM lineitem JOIN part ON l_partkey = p_partkey),
cited AS (SELECT doc, CAST(floor(sum(l_quantity)) AS BIGINT) AS citations, min(p_brand) AS source FROM lines GROUP BY doc),
records AS (SELECT o_orderkey AS doc, CAST(year(o_orderdate) AS INTEGER) AS year, o_orderpriority AS doc_type, coalesce(citations, 0) AS citations, source
            FROM orders LEFT JOIN cited ON o_orderkey = doc),
authors AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey AS author FROM lineitem),
nations AS (SELECT s_suppkey AS author, n_name AS country, r_name AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
regions AS (SELECT n_name AS country, r_name AS region FROM nation JOIN region ON n_regionkey = r_regionkey),
countries AS (SELECT DISTINCT doc, country FROM authors JOIN nations USING (author)),
keywords AS (SELECT DISTINCT doc, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) AS keyword FROM lines)"""
