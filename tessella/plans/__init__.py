"""Plan helpers: staging tables in the shared folder, stable row ids, fixed points."""

from tessella.plans.storage import Rounds, anchored, release, row_id, shared_folder, stage

__all__ = ["Rounds", "anchored", "release", "row_id", "shared_folder", "stage"]
