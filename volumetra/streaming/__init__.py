"""Standing queries over streams of elements.

The same predicates filter a streaming table: nothing is kept between rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.shapes import condition, element_shape


def standing_query(stream: DataFrame, element_type: str, shape, accuracy: str = "best_effort") -> DataFrame:
    """Elements of a (streaming) table that intersect a fixed shape."""
    box_test, exact = condition(shape, element_shape(element_type), accuracy)
    return stream.where(box_test).where(exact)
