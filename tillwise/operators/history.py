"""Edits to a table with undo: a list of lazy frames, no data copied."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from tillwise.functions.text import col
from tillwise.plans import scratch
from tillwise.sources.tables import write_csv

LINEAGE_LIMIT = 20


@dataclass
class EditHistory:
    """``apply`` adds a version, ``undo`` drops the last, ``save`` exports the newest as CSV and keeps only it.

    Saving changes no value: the version that is kept is a typed table, the CSV is for others.

    Every LINEAGE_LIMIT edits the version is written to the shared folder, so plans stay short
    and lost executors do not replay the whole history. ``close``, or the end of a ``with`` block, drops what was written, the
    tables of the operators included; frames of the history are not to be used after it.
    """

    base: DataFrame
    versions: list[DataFrame] = field(default_factory=list)
    since_cut: int = 0
    tables: scratch.Scope = field(default_factory=scratch.Scope)

    def __post_init__(self) -> None:
        self.versions = [self.base]

    @property
    def current(self) -> DataFrame:
        return self.versions[-1]

    @property
    def unsaved(self) -> int:
        return len(self.versions) - 1

    def apply(self, operator: Callable[..., DataFrame], *args: object, **options: object) -> DataFrame:
        with self.tables:
            changed = operator(self.current, *args, **options)
            self.since_cut += 1
            if self.since_cut >= LINEAGE_LIMIT:
                changed, self.since_cut = scratch.save(changed), 0
        self.versions.append(changed)
        return changed

    def undo(self) -> DataFrame:
        if not self.unsaved:
            raise ValueError("nothing to undo")
        self.versions.pop()
        return self.current

    def save(self, path: str) -> DataFrame:
        with self.tables:
            kept = scratch.save(self.current)
        write_csv(kept, path)
        # column metadata (such as a category mark) is not a part of the file
        self.versions = [kept.select(*[col(f.name).alias(f.name, metadata=f.metadata) for f in self.current.schema])]
        self.since_cut = 0
        return self.current

    def close(self) -> None:
        self.versions = [self.base]
        self.tables.drop()

    def __enter__(self) -> EditHistory:
        return self

    def __exit__(self, *error: object) -> None:
        self.close()
