"""The merged label tree as files that a trainer opens: ``<split>/labels/<stem>.txt`` and a manifest."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from lanternflow.sources import sinks

#: Where tasks list what they have written, until the job is committed or given up.
LISTS, MANIFEST = "_written", "data.yaml"


@dataclass
class Written(WriterCommitMessage):
    splits: list[str]


class LabelWriter(DataSourceArrowWriter):
    """A file for each row.

    A task lists the files of a batch before it writes them.  If the job fails,
    ``abort`` deletes all that is listed; a task that runs again writes the same
    files.  A worker that outlives its killed task may still write after that:
    the manifest is written last, and a tree without one does not count.
    """

    def __init__(self, path: str, names: Sequence[str]) -> None:
        self.path, self.names = path, list(names)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pafs.FileSystem.from_uri(self.path)
        fs.create_dir(f"{root}/{LISTS}", recursive=True)
        made: set[str] = set()
        for batch in iterator:
            splits, stems, labels = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("split", "image_stem", "label"))
            names = [f"{split}/labels/{stem}.txt" for split, stem in zip(splits, stems, strict=True)]
            with fs.open_output_stream(f"{root}/{LISTS}/{uuid.uuid4().hex}") as out:
                out.write(json.dumps(names).encode())
            for split in set(splits) - made:
                fs.create_dir(f"{root}/{split}/labels", recursive=True)
            made |= set(splits)
            for name, label in zip(names, labels, strict=True):
                with fs.open_output_stream(f"{root}/{name}") as out:
                    out.write((label + "\n" if label else "").encode())
        return Written(sorted(made))

    def commit(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        splits = {s for m in messages if m for s in m.splits}
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(sinks.merged_manifest(root, self.names, sorted(splits)).encode())
        self._forget(fs, root)

    def abort(self, messages: list[Written | None]) -> None:
        fs, root = pafs.FileSystem.from_uri(self.path)
        for found in fs.get_file_info(pafs.FileSelector(f"{root}/{LISTS}", allow_not_found=True)):
            with fs.open_input_stream(found.path) as f:
                listed = f.read()
            for name in json.loads(listed) if listed else []:
                if fs.get_file_info(f"{root}/{name}").type == pafs.FileType.File:
                    fs.delete_file(f"{root}/{name}")
        self._forget(fs, root)

    @staticmethod
    def _forget(fs: pafs.FileSystem, root: str) -> None:
        if fs.get_file_info(f"{root}/{LISTS}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{LISTS}")


class LabelTree(DataSource):
    """``df.write.format("label_tree")`` of (split, image_stem, label); options: path, names (JSON)."""

    @classmethod
    def name(cls) -> str:
        return "label_tree"

    def writer(self, schema, overwrite: bool) -> LabelWriter:  # noqa: ANN001
        return LabelWriter(self.options["path"], json.loads(self.options.get("names", "[]")))


def write_tree(lines: DataFrame, images: DataFrame, path: str, names: Sequence[str] = ()) -> None:
    """Write a text file for each image, empty without a kept line, and the manifest.  ``path`` is a URI that pyarrow opens."""
    rows = sinks.label_texts(lines, images).select("split", "image_stem", "label")
    rows.sparkSession.dataSource.register(LabelTree)
    rows.write.format("label_tree").option("names", json.dumps(list(names))).mode("append").save(path)
