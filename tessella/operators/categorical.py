"""Categorical columns: codes into a small table of categories, with a code for missing values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators.position import with_position


class Categorical:
    """``data`` has a ``code`` column; ``categories`` is (code, category), and code -1 is missing."""

    def __init__(self, data: DataFrame, categories: DataFrame, column: str):
        self.data, self.categories, self.column = data, categories, column

    @classmethod
    def of(cls, df: DataFrame, column: str) -> Categorical:
        """Categories are the values in order."""
        categories = with_position(df.select(F.col(column).alias("category")).dropna().distinct(), ["category"], "code")
        coded = df.join(categories.withColumnRenamed("category", column), column, "left").withColumn("code", F.coalesce("code", F.lit(-1)))
        return cls(coded.drop(column), categories, column)

    @classmethod
    def from_codes(cls, df: DataFrame, categories: Sequence[str], column: str, code: str = "code") -> Categorical:
        table = df.sparkSession.createDataFrame(list(enumerate(categories)), "code long, category string")
        return cls(df.withColumnRenamed(code, "code"), table, column)

    def to_strings(self) -> DataFrame:
        return self.data.join(self.categories, "code", "left").withColumnRenamed("category", self.column).drop("code")

    def set_categories(self, names: Sequence[str]) -> Categorical:
        """Values outside the new categories become missing."""
        table = self.data.sparkSession.createDataFrame(list(enumerate(names)), "__new long, category string")
        moved = self.categories.join(table, "category").select("code", "__new")
        data = self.data.join(moved, "code", "left").withColumn("code", F.coalesce("__new", F.lit(-1))).drop("__new")
        return Categorical(data, table.withColumnRenamed("__new", "code"), self.column)

    def reset_categories(self) -> Categorical:
        """Only the categories in use, numbered anew."""
        return Categorical.of(self.to_strings(), self.column)

    def matching(self, test: Column) -> DataFrame:
        """Rows whose category meets a test on ``category``: decided once a category."""
        return self.data.join(self.categories.where(test).select("code"), "code", "left_semi")

    def contains(self, text: str) -> DataFrame:
        return self.matching(F.col("category").contains(text))

    def startswith(self, text: str) -> DataFrame:
        return self.matching(F.col("category").startswith(text))

    def endswith(self, text: str) -> DataFrame:
        return self.matching(F.col("category").endswith(text))

    def isin(self, values: Sequence[str]) -> DataFrame:
        return self.matching(F.col("category").isin(list(values)))

    def isna(self) -> Column:
        return F.col("code") == -1

    def counts(self) -> DataFrame:
        return self.data.groupBy("code").count().join(self.categories, "code", "left").select(F.col("category").alias(self.column), F.col("count").alias("n"))

    def sort_values(self) -> DataFrame:
        return self.to_strings().orderBy(self.column)

    @staticmethod
    def standardize(*parts: Categorical) -> list[Categorical]:
        """The same categories and codes for all."""
        values = parts[0].categories.select("category")
        for p in parts[1:]:
            values = values.union(p.categories.select("category"))
        shared = with_position(values.distinct(), ["category"], "__new")
        out = []
        for p in parts:
            moved = p.categories.join(shared, "category").select("code", "__new")
            data = p.data.join(moved, "code", "left").withColumn("code", F.coalesce("__new", F.lit(-1))).drop("__new")
            out.append(Categorical(data, shared.withColumnRenamed("__new", "code"), p.column))
        return out
