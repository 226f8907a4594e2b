"""Row predicates. Each is a plain comparison, so price, rating and facets reach the file scan."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from wareseek.schemas import PRICE_RANGE


def price_between(lowest: float, highest: float, price: str = "price") -> Column:
    return F.col(price).between(lowest, highest)


def rating_at_least(floor: float, rating: str = "rating") -> Column:
    """Spark sorts NaN above every number; a missing rating must not pass the floor."""
    return (F.col(rating) >= floor) & ~F.isnan(rating)


def facet_required(facet: str, labels: Sequence[str] | None) -> Column:
    """Membership that must hold: no labels, no rows."""
    return F.col(facet).isin(list(labels)) if labels else F.lit(False)


def facet_optional(facet: str, labels: Sequence[str] | None) -> Column:
    """Membership that an empty or missing list switches off."""
    return F.col(facet).isin(list(labels)) if labels else F.lit(True)


@dataclass(frozen=True)
class Conditions:
    """The metadata conditions of a search request."""

    min_price: float = PRICE_RANGE[0]
    max_price: float = PRICE_RANGE[1]
    min_rating: float = 0.0
    categories: Sequence[str] | None = None
    colors: Sequence[str] | None = None
    seasons: Sequence[str] | None = None

    def _facets(self) -> Iterable[tuple[str, Sequence[str] | None]]:
        return (("category", self.categories), ("color", self.colors), ("season", self.seasons))

    def _with(self, facet) -> Column:
        facets = [facet(name, labels) for name, labels in self._facets()]
        return reduce(
            and_,
            facets,
            price_between(self.min_price, self.max_price) & rating_at_least(self.min_rating),
        )

    def strict(self) -> Column:
        """Form used before a vector search: every facet list is binding."""
        return self._with(facet_required)

    def lenient(self) -> Column:
        """Form used for browsing and text search: empty facet lists are ignored."""
        return self._with(facet_optional)


# Columns of a product that conditions look at, and the columns in which a table of requests
# states its own conditions.
FILTER_COLUMNS = ("price", "rating", "category", "color", "season")
REQUEST_COLUMNS = ("min_price", "max_price", "min_rating", "categories", "colors", "seasons")
FACET_LISTS = {"category": "categories", "color": "colors", "season": "seasons"}


def nan_to_null(df: DataFrame) -> DataFrame:
    """Missing numbers get one spelling on ingest."""
    floats = {
        f.name: F.when(~F.isnan(f.name), F.col(f.name))
        for f in df.schema
        if isinstance(f.dataType, (T.DoubleType, T.FloatType))
    }
    return df.withColumns(floats) if floats else df


def drop_incomplete(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Keep the rows in which every column, or every one of ``columns``, has a value."""
    return df.filter(reduce(and_, [F.col(c).isNotNull() for c in columns or df.columns]))
