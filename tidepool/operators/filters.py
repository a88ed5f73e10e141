"""Eligibility of notes: built only from the options given, as one conjunction that the scan can prune by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepool.functions.text import any_glob


def eligible(
    *, recall: bool = False, project: str | None = None, status: str | None = None, kind: str | None = None,
    module: str | None = None, path: str | None = None, folder: str | None = None,
) -> Column:
    """A predicate on columns path, kind, status, project, module, path_globs (missing values are empty)."""
    ok = F.lit(True)
    if recall:
        ok = ok & (F.col("kind") == "lesson") & (F.col("status") == "active")
    if project:
        ok = ok & F.col("project").isin(project, "global")
    if status and status != "all":
        ok = ok & (F.col("status") == status)
    if kind:
        ok = ok & (F.col("kind") == kind)
    if module:
        ok = ok & ((F.col("module") == "") | (F.col("module") == module))
    if folder:
        root = folder.rstrip("/")
        ok = ok & ((F.col("path") == root) | F.col("path").startswith(root + "/"))
    if path:
        ok = ok & ((F.size("path_globs") == 0) | any_glob(F.col("path_globs"), F.lit(path)))
    return ok


def historical(project: str | None, module: str | None, path: str | None, folder: str | None) -> Column:
    """Superseded notes in scope: they lend their wording to a recall, whatever their kind."""
    return (F.col("status") == "superseded") & eligible(project=project, module=module, path=path, folder=folder)
