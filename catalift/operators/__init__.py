"""DataFrame operators: profile, governance, ranking, series and model scoring."""

from catalift.operators.governance import cleanup_candidates, owned_not_marked
from catalift.operators.modeling import (
    compare_versions,
    conform,
    fit_forest,
    fit_linear,
    holdout,
    holdout_tail,
    mse,
    score,
    score_by_alias,
)
from catalift.operators.network import fit_network
from catalift.operators.profile import inventory_profile, sample_head, top_n
from catalift.operators.ranking import number_within
from catalift.operators.series import (
    forecast_vs_actual,
    forecast_window,
    label_split,
    slice_inclusive,
    time_split,
)

__all__ = [
    "cleanup_candidates",
    "compare_versions",
    "conform",
    "fit_forest",
    "fit_linear",
    "fit_network",
    "forecast_vs_actual",
    "forecast_window",
    "holdout",
    "holdout_tail",
    "inventory_profile",
    "label_split",
    "mse",
    "number_within",
    "owned_not_marked",
    "sample_head",
    "score",
    "score_by_alias",
    "slice_inclusive",
    "time_split",
    "top_n",
]
