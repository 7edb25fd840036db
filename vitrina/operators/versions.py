"""The prediction pipeline of a version, V1 to V8, and its output.

V1 scores the pairs of a sample of customers with the ranker, V2 to V4 those of all customers;
their lists are padded from cohort and global best sellers.  V5 to V8 are cascades.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.functions.retail import age_bin_case
from vitrina.operators import audit, recall, waterfall

RANKED = ("v1", "v2", "v3", "v4")


def lists(version: str, tx: DataFrame, customers: DataFrame, scored: Callable[[], DataFrame] | None = None, specs: dict[str, waterfall.Cascade] | None = None, sample: int = 2000, sample_days: int = 365) -> DataFrame:
    """``(customer_idx, article_id, rank, level)``.  ``scored`` gives ``(customer_idx, article_id, score)`` and is asked by
    the ranked versions only; ``specs`` are the cascades' parameters."""
    version, specs = version.lower().strip(), specs or waterfall.VERSIONS
    if version in specs:
        return waterfall.cascade(tx, customers, specs[version])
    if version not in RANKED or scored is None:
        raise ValueError(f"no version {version!r} with what is given: {', '.join([*RANKED, *specs])}")
    users, pairs = customers, scored()
    if version == "v1":
        own = audit.stratified_sample(tx, sample, sample_days).select("customer_idx")
        users, pairs = users.join(own, "customer_idx", "left_semi"), pairs.join(own, "customer_idx", "left_semi")
    bins = users.select("customer_idx", age_bin_case(F.col("age")).alias("age_bin"))
    return waterfall.assemble(pairs, recall.fallback_cohorts(tx, customers), bins)


def predict(version: str, tx: DataFrame, customers: DataFrame, scored: Callable[[], DataFrame] | None = None, **options) -> DataFrame:
    """``(customer_idx, prediction)`` of a version."""
    return waterfall.as_prediction(lists(version, tx, customers, scored, **options))
