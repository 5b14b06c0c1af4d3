"""Files in any store that Arrow can open, and sinks whose files appear all at once or not at all."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSourceArrowWriter, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the place in it that a path or URI names."""
    return fs.FileSystem.from_uri(path)


def files_of(path: str, suffix: str) -> list[tuple[str, int]]:
    """(place, bytes) of the files of a folder, or of one file, in order of name; a manifest says which count."""
    store, root = located(path)
    info = store.get_file_info(root)
    if info.type == fs.FileType.File:
        return [(root, info.size)]
    found = {f.base_name: (f.path, f.size) for f in store.get_file_info(fs.FileSelector(root)) if f.type == fs.FileType.File and f.base_name.endswith(suffix) and f.base_name[0] not in "._"}
    if store.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
        with store.open_input_stream(f"{root}/{MANIFEST}") as f:
            listed = json.loads(f.read())["files"]
        return [found[n] for n in sorted(listed) if n in found]
    return [found[n] for n in sorted(found)]


@dataclass
class Stretch(InputPartition):
    """One of ``parts`` equal stretches of a file, for a task of its own."""

    place: str
    size: int
    part: int
    parts: int

    def __init__(self, place: str, size: int, part: int, parts: int):
        self.place, self.size, self.part, self.parts = place, size, part, parts

    @property
    def bounds(self) -> tuple[int, int]:
        return self.size * self.part // self.parts, self.size * (self.part + 1) // self.parts


def stretches(path: str, suffix: str, wide: int) -> list[Stretch]:
    """Stretches of about ``wide`` bytes over all files of a folder; only names and sizes are looked at."""
    out = []
    for place, size in files_of(path, suffix):
        parts = max(1, -(-size // wide))
        out += [Stretch(place, size, k, parts) for k in range(parts)]
    return out


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class StagedWriter(DataSourceArrowWriter):
    """Writes files below a staging folder; commit moves them and publishes a manifest, abort leaves nothing.

    The manifest is what readers go by, and it is put in place by one rename after all files
    are there. A task that dies, is tried again or outlives the abort leaves at most files in
    the staging folder, under a name of its own attempt, where no reader looks. Overwritten files go once the new manifest stands.
    """

    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path, overwrite
        self.staging = f"_staging-{uuid.uuid4().hex[:12]}"

    def put(self, batches: Iterator[pa.RecordBatch], begin) -> Iterator[str]:  # noqa: ANN001
        """Write files by ``begin(name) -> stream``; yields their names. For subclasses."""
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = located(self.path)
        task = TaskContext.get()
        own = f"{root}/{self.staging}/{task.partitionId():05d}-{task.taskAttemptId()}"
        store.create_dir(own, recursive=True)
        names = list(self.put(iterator, lambda name: store.open_output_stream(f"{own}/{name}")))
        return Written([f"{own.removeprefix(root + '/')}/{n}" for n in names])

    def commit(self, messages: list[Written | None]) -> None:
        store, root = located(self.path)
        store.create_dir(root, recursive=True)
        before = [f for f, _ in files_of(self.path, "")]
        job, names = self.staging.removeprefix("_staging-"), [] if self.overwrite else [f.rsplit("/", 1)[1] for f in before]
        for place in sorted(n for m in messages if m is not None for n in m.names):
            name = place.rsplit("/", 1)[1]
            stem, dot, rest = name.partition(".")
            name = f"{stem}-{job}{dot}{rest}"
            store.move(f"{root}/{place}", f"{root}/{name}")
            names.append(name)
        with store.open_output_stream(f"{root}/{self.staging}-manifest") as f:
            f.write(json.dumps({"files": names}).encode())
        store.move(f"{root}/{self.staging}-manifest", f"{root}/{MANIFEST}")
        for place in before if self.overwrite else []:
            store.delete_file(place)
        self._clear(store, root)

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*located(self.path))

    def _clear(self, store: fs.FileSystem, root: str) -> None:
        if store.get_file_info(f"{root}/{self.staging}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.staging}")
