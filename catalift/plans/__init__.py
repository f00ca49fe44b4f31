"""Plans built from metadata: table migration and registry upgrade."""

from catalift.plans.catalogue import Registry, apply_plan, read_registry
from catalift.plans.compare import differences
from catalift.plans.migrate import (
    classify_copy,
    pivot_description,
    plan_sync,
    reconcile,
    run_sync,
    sync_journal,
)
from catalift.plans.registry import latest_version, stage_alias, upgrade_plan

__all__ = [
    "Registry",
    "apply_plan",
    "classify_copy",
    "differences",
    "latest_version",
    "pivot_description",
    "plan_sync",
    "read_registry",
    "reconcile",
    "run_sync",
    "stage_alias",
    "sync_journal",
    "upgrade_plan",
]
