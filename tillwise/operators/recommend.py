"""Choosing the recommendation method a table supports."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from tillwise.operators import baskets as market
from tillwise.operators.neighbours import recommend_to_users
from tillwise.operators.popularity import popular_items

# fixed values: code -> display name
ALGORITHMS = {
    "apriori": "Market Basket Analysis (Apriori)",
    "collaborative": "User-Based Collaborative Filtering (Cosine Similarity)",
    "popularity": "Popularity-Based Engine (Top Sellers)",
}


@dataclass
class Recommendations:
    algorithm_code: str
    popular_items: DataFrame
    association_rules: DataFrame | None = None
    user_recommendations: DataFrame | None = None

    @property
    def algorithm_used(self) -> str:
        return ALGORITHMS[self.algorithm_code]


def recommend(
    df: DataFrame,
    item_col: str | None,
    user_col: str | None = None,
    invoice_col: str | None = None,
    qty_col: str | None = None,
    top_n: int = 5,
    targets: DataFrame | None = None,
) -> Recommendations:
    """Baskets when an invoice column yields a frequent itemset, else similar customers when
    there is a customer column (for the customers in ``targets``, by default all), else best sellers. Failures are raised, not skipped."""
    if not item_col or item_col not in df.columns:
        raise ValueError("a valid product/item column is required")
    popular = popular_items(df, item_col, qty_col, top_n)
    if invoice_col and invoice_col in df.columns:
        found = market.build_baskets(df, invoice_col, item_col, qty_col)
        # an item that reaches the minimum support is itself a frequent itemset
        if found.names:
            rules = market.top_rules(market.association_rules(found), top_n)
            return Recommendations("apriori", popular, association_rules=rules)
    if user_col and user_col in df.columns:
        # the caller and the customers' method read the same few rows
        sellers = popular.collect()
        popular = df.sparkSession.createDataFrame(sellers, popular.schema)
        served = recommend_to_users(df, user_col, item_col, qty_col, targets, top_n, [r["item"] for r in sellers])
        return Recommendations("collaborative", popular, user_recommendations=served)
    return Recommendations("popularity", popular)
