"""Column expressions and small identifier helpers shared by the operators."""

from catalift.functions.names import quoted, scratch_dir
from catalift.functions.predicates import (
    complexity,
    glob_match,
    is_root_storage,
    name_contains_any,
    name_glob,
    owned_by,
)

__all__ = [
    "complexity",
    "glob_match",
    "is_root_storage",
    "name_contains_any",
    "name_glob",
    "owned_by",
    "quoted",
    "scratch_dir",
]
