"""Files of our own formats in any store that tasks can reach: written by tasks, published by one manifest."""

from __future__ import annotations

import json
import re
import uuid

import pyarrow.fs as pafs

MANIFEST = "manifest.json"


def at(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it, from a plain path or a URI (file, hdfs, viewfs, s3, gs)."""
    local = re.match(r"file:/*(/.*)", path)
    if local:
        return pafs.LocalFileSystem(), local[1]
    if re.match(r"\w[\w+.-]+://", path):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def new_name(kind: str, partition: int) -> str:
    """A name no other attempt of the task takes; names sort by partition."""
    return f"{kind}-{partition:06d}-{uuid.uuid4().hex}"


def remove(fs: pafs.FileSystem, paths) -> None:
    for path in paths:
        if fs.get_file_info(path).type == pafs.FileType.File:
            fs.delete_file(path)


def publish(path: str, content: dict, names: set[str], ours: str = "") -> None:
    """Write the manifest, which alone makes files readable, and remove what lost attempts left behind: the other files
    whose names match `ours` (all, by default)."""
    fs, root = at(path)
    fs.create_dir(root)
    staged = f"{root}/.{uuid.uuid4().hex}"
    with fs.open_output_stream(staged) as out:
        out.write(json.dumps(content).encode("utf-8"))
    fs.move(staged, f"{root}/{MANIFEST}")
    clear(path, names | {MANIFEST}, ours)


def clear(path: str, keep: set[str] = frozenset(), ours: str = "") -> None:
    """Remove the files of a folder whose names match `ours`, but for those to keep."""
    fs, root = at(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    remove(fs, [f.path for f in found if f.base_name not in keep and re.search(ours, f.base_name)])


def manifest(path: str) -> dict:
    fs, root = at(path)
    with fs.open_input_file(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())
