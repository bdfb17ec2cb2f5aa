"""Planning, running, logging and undoing removals.

Plans are DataFrames. Moving files is a side effect of a bounded, user-confirmed list, so it runs on the driver, row by row from
an iterator, through a mover that callers pass in.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.display import file_name
from ..storage import materialise


def in_folder(path: Column, folder: Column) -> Column:
    """Whether a path is a folder or lies in it, by whole components; ``/`` holds everything."""
    return (path == folder) | F.startswith(path, F.when(folder == "/", folder).otherwise(F.concat(folder, F.lit("/"))))


def unique_root_names(roots: Iterable[str]) -> dict[str, str]:
    """A folder name for each scan root: its last component, with `` 2``, `` 3``... for names that are taken, in path order."""
    names: dict[str, str] = {}
    for path in sorted(set(roots)):
        base = path.rstrip("/").rpartition("/")[2] or "/"
        n, name = 2, base
        while name in names.values():
            name, n = f"{base} {n}", n + 1
        names[path] = name
    return names


def plan(tracks: DataFrame, folder: str | None = None) -> DataFrame:
    """``track_id, source, destination``: to the bin (no destination), or to ``folder`` with the path below the scan root kept.

    A track without a scan root goes below its parent folder's name, one outside its root goes to the root's name. Scan roots
    are the folders that a user picked, so their distinct list is small and is named on the driver.
    """
    if folder is None:
        return tracks.select(F.col("id").alias("track_id"), F.col("path").alias("source"), F.lit(None).cast("string").alias("destination"))
    names = unique_root_names(r.scan_root for r in tracks.select("scan_root").distinct().filter("scan_root IS NOT NULL").collect())
    rows = tracks.sparkSession.createDataFrame(list(names.items()), "scan_root string, root_name string")
    named = tracks.join(rows, "scan_root", "left")
    root = F.regexp_replace("scan_root", "/+$", "")
    relative = F.when(F.startswith(F.col("path"), F.concat(root, F.lit("/"))), F.substring(F.col("path"), F.length(root) + 2, F.length("path"))).otherwise(file_name(F.col("path")))
    parent = F.element_at(F.split("path", "/"), -2)
    below = F.when(F.col("scan_root").isNull(), F.concat_ws("/", F.nullif(parent, F.lit("")), file_name(F.col("path")))).otherwise(F.concat_ws("/", "root_name", relative))
    return named.select(F.col("id").alias("track_id"), F.col("path").alias("source"), F.concat(F.lit(folder.rstrip("/") + "/"), below).alias("destination"))


def moves_into_folders(planned: DataFrame, folders: list[str]) -> DataFrame:
    """The first planned move (lowest id) whose destination lies in a scanned folder; at most one row."""
    inside = F.lit(False)
    for f in folders:
        inside = inside | in_folder(F.col("destination"), F.lit(f))
    return planned.filter(inside).orderBy("track_id").limit(1)


def unique_destination(path: str, exists: Callable[[str], bool]) -> str:
    """The path, or the first of ``name 2.ext``, ``name 3.ext``... that is free."""
    if not exists(path):
        return path
    folder, _, name = path.rpartition("/")
    stem, dot, ext = name.rpartition(".") if "." in name[1:] else (name, "", "")
    n = 2
    while exists(candidate := f"{folder}/{stem} {n}{dot}{ext}"):
        n += 1
    return candidate


class Mover(Protocol):
    def exists(self, path: str) -> bool: ...
    def move(self, source: str, destination: str) -> None: ...
    def bin(self, source: str) -> str: ...


@dataclass
class Operation:
    """One removal: what was moved where, and what failed."""

    mode: str
    records: list[dict] = field(default_factory=list)
    failures: list[dict] = field(default_factory=list)
    id: str = field(default_factory=lambda: str(uuid.uuid4()))
    date: str = field(default_factory=lambda: datetime.now(timezone.utc).isoformat(timespec="seconds").replace("+00:00", "Z"))
    undone_at: str | None = None
    undo_failures: list[dict] = field(default_factory=list)


def execute(planned: DataFrame, mover: Mover, progress: Callable[[int], None] | None = None, cancelled: Callable[[], bool] = lambda: False) -> Operation:
    """Moves file after file in plan order; a failure is recorded and the rest goes on; cancelling stops before the next file."""
    operation = Operation("bin")
    for n, row in enumerate(planned.orderBy("track_id").toLocalIterator(), 1):
        if cancelled():
            break
        try:
            if row.destination is None:
                to = mover.bin(row.source)
            else:
                operation.mode = "folder"
                to = unique_destination(row.destination, mover.exists)
                mover.move(row.source, to)
            operation.records.append({"trackID": row.track_id, "original": row.source, "destination": to})
        except OSError as e:
            operation.failures.append({"trackID": row.track_id, "path": row.source, "message": str(e)})
        if progress:
            progress(n)
    return operation


def undo(operation: Operation, mover: Mover) -> tuple[list[dict], list[dict]]:
    """(restored records, failures), last move first; a file that is gone or a place that is taken is a failure."""
    restored, failures = [], []
    for record in reversed(operation.records):
        problem = None
        if not record.get("destination") or not mover.exists(record["destination"]):
            problem = "The moved file is gone."
        elif mover.exists(record["original"]):
            problem = "Another file is in its place."
        else:
            try:
                mover.move(record["destination"], record["original"])
            except OSError as e:
                problem = str(e)
        if problem:
            failures.append({"trackID": record["trackID"], "path": record["original"], "message": problem})
        else:
            restored.append(record)
    return restored, failures


class RemovalLog:
    """The operations in order, as a JSON file that is replaced as a whole."""

    def __init__(self, operations: list[Operation] | None = None) -> None:
        self.operations = operations or []

    def append(self, operation: Operation) -> None:
        self.operations.append(operation)

    def first_undoable(self) -> Operation | None:
        return next((o for o in reversed(self.operations) if o.undone_at is None and o.records), None)

    def mark_undone(self, operation_id: str, at: str, failures: list[dict]) -> None:
        """Marks an operation once; later calls change nothing."""
        for o in self.operations:
            if o.id == operation_id and o.undone_at is None:
                o.undone_at, o.undo_failures = at, failures

    def save(self, path: str) -> None:
        write_json(path, {"operations": [asdict(o) for o in self.operations]})

    @staticmethod
    def load(path: str) -> RemovalLog:
        raw = read_json(path) or {"operations": []}
        return RemovalLog([Operation(**{"undo_failures": [], **o}) for o in raw["operations"]])


def write_json(path: str, value: dict) -> None:
    """Sorted keys, indented, replaced in one step."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path + ".new", "w", encoding="utf-8") as f:
        json.dump(value, f, sort_keys=True, indent=2, ensure_ascii=False)
    os.replace(path + ".new", path)


def read_json(path: str) -> dict | None:
    """None if there is no file; an unreadable one raises ValueError."""
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_or_set_aside(path: str) -> tuple[dict | None, str | None]:
    """(content, where an unreadable file was moved to): such a file is renamed, never overwritten."""
    try:
        return read_json(path), None
    except ValueError:
        aside = unique_destination(path + ".unreadable", os.path.exists)
        os.rename(path, aside)
        return None, aside


def _files(n: int) -> str:
    return f"{n:,} {'file' if n == 1 else 'files'}"


# The texts of the two summaries.
def summary(operation: Operation, planned: int | None = None, folder: str | None = None) -> str:
    """What was moved where, and what went wrong. planned: how many files the plan had, if it may have been stopped."""
    moved, bad = len(operation.records), len(operation.failures)
    place = f"“{folder.rstrip('/').rpartition('/')[2]}”" if folder else "the Bin"
    if planned is not None and moved + bad < planned:
        done = f"Stopped after moving {moved:,} of {_files(planned)} to {place}."
    elif not moved:
        return "The file couldn't be moved." if bad == 1 else f"None of the {bad:,} files could be moved."
    else:
        done = f"Moved {_files(moved)} to {place}."
    return done + (f" {_files(bad)} couldn't be moved." if bad else "")


def restored_summary(restored: int, failed: int) -> str:
    if not failed:
        return f"Put back {_files(restored)}."
    if not restored:
        return "The file couldn't be put back." if failed == 1 else f"None of the {failed:,} files could be put back."
    return f"Put back {_files(restored)}. {_files(failed)} couldn't be put back."


@dataclass
class Report:
    """After a removal: what it says, the groups and marks that are left, and whether every file of the plan was tried."""

    text: str
    operation: Operation
    groups: DataFrame
    marks: DataFrame
    finished: bool


def remove_marked(
    groups: DataFrame, tracks: DataFrame, marks: DataFrame, mover: Mover, log: RemovalLog, folder: str | None = None,
    progress: Callable[[int], None] | None = None, cancelled: Callable[[], bool] = lambda: False,
) -> Report | None:
    """Moves the marked tracks (``id``) away, in the order of ids; None if nothing is marked.

    What was moved leaves the groups and the marks, and the operation goes to the log if it did anything.
    """
    from .views import drop_copies

    planned = materialise(plan(tracks.join(marks.select("id").distinct(), "id", "left_semi"), folder))
    if not (n := planned.count()):
        return None
    operation = execute(planned, mover, progress, cancelled)
    if operation.records or operation.failures:
        log.append(operation)
    moved = tracks.sparkSession.createDataFrame([(r["trackID"],) for r in operation.records], "id long")
    left = materialise(drop_copies(groups, moved))
    marked = marks.select("id").distinct().join(moved, "id", "left_anti").join(left.select(F.explode("track_ids").alias("id")), "id", "left_semi")
    return Report(summary(operation, n, folder), operation, left, marked, len(operation.records) + len(operation.failures) == n)
