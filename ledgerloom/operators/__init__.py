"""Reusable relational building blocks, all composed from DataFrame operators."""

from .buckets import bucket_index, zero_filled  # noqa: F401
from .changes import Rule, apply_changes, fold_changes  # noqa: F401
from .documents import child_lines, parent_lines, positions, write_documents  # noqa: F401
from .dims import get_or_create, name_key  # noqa: F401
from .latest import keep_last, latest_per_key  # noqa: F401
from .rollup import child_rollup, nest_children  # noqa: F401
from .cumulative import global_running, global_running_min  # noqa: F401
