"""Documents written as files by a Spark data source, whole or not at all.

Each task writes its rows to a folder of its own beside the target and tells the driver their names; only when all tasks are
done are the files moved, one rename each, to where readers look.  A task that fails removes its folder, and a job that fails
removes all, so what a reader finds is whole and from a job that ended.  A task that outlives its failed job may leave a folder,
whose name begins with _job-; readers pass over such names, and later jobs remove those older than STALE_DAYS.  Paths are of any file system that pyarrow opens.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

DOCUMENT = "name string, content binary"
STALE_DAYS = 2


@dataclass
class Written(WriterCommitMessage):
    folder: str
    names: list[str]


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


class _Writer(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> WriterCommitMessage:
        files, root = _open(self.path)
        folder, names = f"{root}/{self.job}/{uuid.uuid4().hex}", []
        files.create_dir(folder)
        try:
            for row in iterator:
                name, content = row[0], row[1]
                if not name or "/" in name or name[0] in "._":
                    raise ValueError(f"no name for a document: {name!r}")
                # Only new names are counted, so that a task's file is never written twice.
                if name in names:
                    raise ValueError(f"two documents are called {name}")
                with files.open_output_stream(f"{folder}/{name}") as out:
                    out.write(b"" if content is None else content.encode() if isinstance(content, str) else bytes(content))
                names.append(name)
        except BaseException:
            files.delete_dir(folder)
            raise
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        from pyarrow import fs

        files, root = _open(self.path)
        done = [m for m in messages if m is not None]
        twice = [n for n, k in Counter(n for m in done for n in m.names).items() if k > 1]
        if twice:
            self.abort(messages)
            raise ValueError(f"two documents are called {min(twice)}")
        names = {n for m in done for n in m.names}
        before = {f.base_name for f in files.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.type == fs.FileType.File and f.base_name[0] not in "._"}
        if not self.overwrite and names & before:
            self.abort(messages)
            raise ValueError(f"a document is there already: {min(names & before)}")
        for m in done:
            for name in m.names:
                files.move(f"{m.folder}/{name}", f"{root}/{name}")
        for name in before - names if self.overwrite else ():
            files.delete_file(f"{root}/{name}")
        self._clear(files, root)
        oldest = datetime.now(UTC) - timedelta(days=STALE_DAYS)
        for left in files.get_file_info(fs.FileSelector(root)):
            if left.type == fs.FileType.Directory and left.base_name.startswith("_job-") and left.mtime and left.mtime < oldest:
                files.delete_dir(left.path)
        with files.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(str(len(names)).encode())

    def abort(self, messages: list) -> None:
        self._clear(*_open(self.path))

    def _clear(self, files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            files.delete_dir(f"{root}/{self.job}")


class Documents(DataSource):
    """spark.dataSource.register(Documents), then df.write.format("timedtext_documents").mode("append" or "overwrite").save(path)
    for rows of name and content.  overwrite: documents that were there before go once the new ones are in place."""

    @classmethod
    def name(cls) -> str:
        return "timedtext_documents"

    def schema(self) -> str:
        return DOCUMENT

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if [f.name for f in schema.fields][:2] != ["name", "content"]:
            raise ValueError(f"rows must be {DOCUMENT}")
        return _Writer(self.options["path"], overwrite)


def write_documents(documents, path: str, mode: str = "overwrite") -> None:
    documents.sparkSession.dataSource.register(Documents)
    documents.select("name", "content").write.format(Documents.name()).mode(mode).save(path)
