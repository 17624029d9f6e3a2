"""Files on shared storage that Spark has no reader or writer for, through pyarrow
(local mounts, object stores, HDFS)."""

from __future__ import annotations

import json
import uuid

from pyarrow import fs as pafs

MANIFEST = "_manifest.json"


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI (also in Spark's ``file:/...`` form) or of a path."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)


def list_folders(uri: str) -> list[int]:
    """The subfolders that are named by a number; none if the folder isn't there."""
    fs, path = open_fs(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted(int(f.base_name) for f in found if f.type == pafs.FileType.Directory and f.base_name.isdigit())


class FolderWrite:
    """One write of a folder of files: all of it or nothing.

    Every write has a subfolder of its own that readers don't look into.  Tasks create
    files there under names of their own, also those of repeated attempts.  The commit
    replaces the manifest, one small file that lists what counts, and only then drops what
    earlier writes have left; an abort drops this write's files.
    """

    def __init__(self, folder: str):
        self.folder, self.name = folder, f"_write-{uuid.uuid4().hex}"

    def create(self):
        """-> (name below the folder, open stream); runs in a task."""
        fs, path = open_fs(self.folder)
        fs.create_dir(f"{path}/{self.name}", recursive=True)
        name = f"{self.name}/{uuid.uuid4().hex}.bin"
        return name, fs.open_output_stream(f"{path}/{name}", compression=None)

    def commit(self, names: list[str]) -> None:
        fs, path = open_fs(self.folder)
        fs.create_dir(path, recursive=True)
        draft = f"{path}/{self.name}.json"
        with fs.open_output_stream(draft, compression=None) as f:
            f.write(json.dumps(names).encode())
        fs.move(draft, f"{path}/{MANIFEST}")
        for old in fs.get_file_info(pafs.FileSelector(path)):
            if old.base_name.startswith("_write-") and old.base_name != self.name:
                fs.delete_dir(old.path) if old.type == pafs.FileType.Directory else fs.delete_file(old.path)

    def abort(self) -> None:
        fs, path = open_fs(self.folder)
        if fs.get_file_info(f"{path}/{self.name}").type != pafs.FileType.NotFound:
            fs.delete_dir(f"{path}/{self.name}")


def committed_files(folder: str) -> list[str] | None:
    """Files of the last committed write, in order; None for what wasn't written so."""
    fs, path = open_fs(folder)
    if fs.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.NotFound:
        return None
    with fs.open_input_stream(f"{path}/{MANIFEST}", compression=None) as f:
        return [f"{folder.rstrip('/')}/{n}" for n in json.loads(f.read())]
