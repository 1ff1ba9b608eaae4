"""Registration of queries and access to their inputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lurelens.session import stored
from lurelens.sources.brands import BRANDS, brands
from lurelens.sources.suffixes import suffix_rules
from workload.inputs import INPUTS

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
)
#: Inputs that several others and several steps of one query read: worked out once and written.
STORED = ("case_states", "case_transitions")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Inputs:
    """Tables of one folder and the inputs derived from them, as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._kept: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.table(name)
        if name in STORED:
            return self._stored(name)
        if name in INPUTS:
            return self.sql(f"select * from {name}")
        raise AttributeError(name)

    def _stored(self, name: str) -> DataFrame:
        """A derived input as this query has written it; the same rows for every step that reads it."""
        if name not in self._kept:
            # small files of many short rows: their size is no reason to broadcast them
            self._kept[name] = stored(self.sql(INPUTS[name]), name).hint("merge")
        return self._kept[name]

    def sql(self, body: str) -> DataFrame:
        """Run SQL over the tables and derived inputs it names."""
        text = with_inputs(body, STORED)
        for name in STORED:
            if _names(text, name):
                self._stored(name).createOrReplaceTempView(name)
        for name in TABLES:
            if name in text:
                self.table(name).createOrReplaceTempView(name)
        return self.spark.sql(text)

    @property
    def brands(self) -> DataFrame:
        return brands(self.spark)

    @property
    def rules(self) -> DataFrame:
        return suffix_rules(self.spark)


def with_inputs(body: str, but: tuple[str, ...] = ()) -> str:
    """Put the derived inputs a statement names in front of it as common table expressions, all ``but`` some."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, sql in INPUTS.items():
            if name not in needed and name not in but and _names(text, name):
                visit(sql)
                needed.append(name)

    visit(body)
    if not needed:
        return body
    parts = ",\n".join(f"{name} as ({INPUTS[name]})" for name in needed)
    body = body.strip()
    if body.startswith("with recursive "):
        return f"with recursive {parts}, {body.removeprefix('with recursive ')}"
    if body.startswith("with "):
        return f"with {parts}, {body.removeprefix('with ')}"
    return f"with {parts}\n{body}"


def _names(text: str, name: str) -> bool:
    words = text.replace("(", " ").replace(")", " ").replace(",", " ").replace(".", " ").split()
    return name in words


def query(oracle: str | None = None) -> Callable:
    """Register a function of ``Inputs`` under its own name, with the SQL that must give the same rows."""
    def register(build: Callable[[Inputs], DataFrame]) -> Callable:
        name = build.__name__
        QUERIES[name] = lambda spark, folder: build(Inputs(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_inputs(oracle)
        return build

    return register


def brand_values() -> str:
    """The brand list as SQL rows ``(brand, domain, ord)``."""
    rows = [
        f"('{brand}', '{domain}', {i * 1000 + j})"
        for i, (brand, domains) in enumerate(BRANDS) for j, domain in enumerate(domains)
    ]
    return "(values " + ", ".join(rows) + ") as b(brand, domain, ord)"
