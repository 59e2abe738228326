"""The query surface for operators of the system: listings, totals and series as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.functions.json_filter import call_filter
from tallyline.plans import catalog
from tallyline.sources.calls import cdr

c = F.col


class Engine:
    """Queries over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def query(self, name: str) -> DataFrame:
        return catalog.QUERIES[name](self.spark, self.sf_dir)

    def calls(self, where: dict | None = None) -> DataFrame:
        return cdr(self.spark, self.sf_dir).where(call_filter(where or {}))

    def list_calls(self, where: dict | None = None, sort: str = "b_us", descending: bool = False, limit: int = 100) -> DataFrame:
        """A page of calls; ties by id in the sort's direction."""
        order = F.desc if descending else F.asc
        return self.calls(where).orderBy(order(sort), order("call_id")).limit(limit)

    def list_calls_json(self, where: dict | None = None, sort: str = "b_us", descending: bool = False, limit: int = 100) -> str:
        """The page as a JSON array: column names, the total before the limit, then rows. Bounded by the limit."""
        import json

        page = self.list_calls(where, sort, descending, limit)
        total = self.calls(where).count()
        return json.dumps([page.columns, [{"total": total}], *[list(r) for r in page.collect()]])

    def total_calls(self, where: dict | None = None) -> int:
        return self.calls(where).count()

    def active_at(self, second: int) -> DataFrame:
        """Calls that go on at a second."""
        us = second * 1_000_000
        return self.calls().where((c("b_us") <= us) & (c("e_us") > us))

    def history(self, caller: str) -> DataFrame:
        return self.calls().where(c("caller") == caller).orderBy("b_us", "call_id")

    def masked(self, df: DataFrame) -> DataFrame:
        """The listing with its numbers shortened for users who may not see them."""
        hide = lambda k: F.concat(F.substring(k, 1, 5), F.lit("***")).alias(k)
        return df.select(*(hide(k) if k in ("caller", "called") else c(k) for k in df.columns))
