"""Driver products as a key: one panel row carries every product's variables.

A configuration is a product and a list of its variables. All configurations are fitted
from one pass over the rows and forecast in the same row, so comparing two of them needs
no join.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame

from ..functions.stage import stage
from ..operators.joins import with_drivers


@dataclass(frozen=True)
class Configuration:
    product: str
    variables: tuple[str, ...]

    def columns(self) -> list[str]:
        return [of_product(v, self.product) for v in self.variables]


def of_product(variable: str, product: str) -> str:
    return f"{variable}__{product}"


def product_table(products: dict[str, DataFrame], variables: Sequence[str]) -> DataFrame:
    """One row a slot with every product's variables; a slot that a product lacks has nulls."""
    parts = [t.select("slot", *[t[v].alias(of_product(v, p)) for v in variables]) for p, t in products.items()]
    return reduce(lambda a, b: a.join(b, "slot", "full"), parts)


def with_products(rows: DataFrame, panel: DataFrame, products: dict[str, DataFrame], variables: Sequence[str]) -> DataFrame:
    """``rows`` with every product's variables, filled inside each series' span as the panel's own
    drivers are. ``panel`` is the panel with its spans; the products are joined to it once."""
    table = stage(product_table(products, variables), "products")
    columns = [of_product(v, p) for p in products for v in variables]
    spans = panel.select("series_id", "slot", "first_slot", "last_slot")
    filled = with_drivers(spans, table, columns).drop("first_slot", "last_slot")
    return rows.join(filled, ["series_id", "slot"])


def variants(configurations: dict[str, Configuration]) -> dict[str, list[str]]:
    return {name: c.columns() for name, c in configurations.items()}
