"""Shared scratch tables: how the operators cut lineage.

Everything that must outlive a stage is a Parquet table under
``spark.checkpoint.dir``, the folder that all executors share, so a lost
executor never loses it.  Results read these tables lazily; whoever owns the
job drops them after its last action (``drop_written``), as the pipeline does
after each stage.
"""

from __future__ import annotations

from ..sources.tables import drop_written, mark, scratch as shared_dir, written

__all__ = ["drop_written", "mark", "shared_dir", "written"]
