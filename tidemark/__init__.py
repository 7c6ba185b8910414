"""Subscription analytics on Spark.

Every analytics view is a plain function ``(Tables, Params) -> DataFrame``;
see ``tidemark.plans.registry`` for the full list and
``tidemark.plans.materialize`` for writing them out in dependency order.
"""

from tidemark.params import Params
from tidemark.sources.star import Tables, load_star

__all__ = ["Params", "Tables", "load_star"]
