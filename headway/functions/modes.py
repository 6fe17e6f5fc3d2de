"""Labels of route types."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the timetable format: route_type and the kind of vehicle.
ROUTE_TYPES = {0: "tram", 1: "metro", 2: "rail", 3: "bus", 4: "ferry", 5: "cable tram", 6: "aerial lift", 7: "funicular", 11: "trolleybus", 12: "monorail"}


def route_type_label(route_type: Column) -> Column:
    """The label of a route type; `other` for other codes, null for null."""
    labels = F.create_map(*map(F.lit, chain.from_iterable(ROUTE_TYPES.items())))
    return F.when(route_type.isNotNull(), F.coalesce(F.try_element_at(labels, route_type.cast("int")), F.lit("other")))


def with_mode(rows: DataFrame, routes: DataFrame) -> DataFrame:
    """Rows with `mode`, the label of their route's type; null where the route is unknown. routes: (route_id, route_type)."""
    return rows.join(routes.select("route_id", route_type_label(F.col("route_type")).alias("mode")).dropDuplicates(["route_id"]), "route_id", "left")
