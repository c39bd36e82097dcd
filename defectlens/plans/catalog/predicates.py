"""Checks that results keep to their filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...operators import search as Q
from ..registry import query
from .search import labelled


@query(
    "e21_assert_filters",
    """SELECT count(*) AS n_rows, 0::bigint AS n_violations, true AS holds FROM (
         SELECT row_number() OVER (PARTITION BY p.query_id ORDER BY p.distance, p.id) AS rank FROM fx_pairs p JOIN fx_vectors v ON v.id = p.id
         WHERE p.query_id <> p.id AND v.vehicle_zone = '4' AND v.has_damage) WHERE rank <= 5""",
)
def _(v):
    filters = {"vehicle_zone": "4", "has_damage": True}
    hits = Q.knn(v.queries, labelled(v), 5, exclude_self=True, filters=filters)
    return Q.assert_filters(hits.join(labelled(v).drop("embedding"), "id"), filters)
