"""All registered queries; importing the modules fills the registry."""

from . import aggregations, evaluation, predicates, projections, regions, scans, search, splits, texts  # noqa: F401
