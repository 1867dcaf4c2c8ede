"""Small generated tables (poses, turns, frames) carried inside a plan as one constant."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def constant_rows(rows: Sequence[dict], fields: str) -> Column:
    """Array-of-struct literal; Catalyst folds it, so it costs one expression whatever its length."""
    return F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{fields}>>")
