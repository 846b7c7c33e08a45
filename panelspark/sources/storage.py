"""Files as tasks open them: found, read from any place, and written whole."""

from __future__ import annotations

import fnmatch
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    scheme, named, rest = path.partition(":")
    if not named or "/" in scheme:
        return fs.LocalFileSystem(), path
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{scheme}:{quote(rest)}")


def found(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files that a path names: itself, those under it, or those that a pattern in its last part fits."""
    system, own = opened(path)
    folder, _, last = own.rpartition("/")
    if any(c in last for c in "*?["):
        infos = [i for i in system.get_file_info(fs.FileSelector(folder or "/")) if fnmatch.fnmatch(i.base_name, last)]
    else:
        info = system.get_file_info(own)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        infos = [info] if info.is_file else system.get_file_info(fs.FileSelector(own, recursive=True))
    prefix = "" if path == own else path[: path.index(own)] if own in path else ""
    return sorted((prefix + i.path, i.size) for i in infos if i.is_file and not i.base_name.startswith(("_", ".")))


def write_files(frame: DataFrame, folder: str) -> int:
    """Write the ``content`` (bytes) of each row to the file ``name`` in a folder, and return their number.

    A file is moved into place when it is whole, so a task that is run again, or twice, leaves one."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, own = opened(folder)
        system.create_dir(own, recursive=True)
        for batch in batches:
            for name, content in zip(batch["name"], batch["content"], strict=True):
                part = f"{own}/.{name}-{uuid.uuid4().hex}"
                with system.open_output_stream(part) as out:
                    out.write(content)
                system.move(part, f"{own}/{name}")
            yield pd.DataFrame({"written": [len(batch)]})

    return sum(r["written"] for r in frame.select("name", "content").mapInPandas(write, "written long").groupBy().sum("written").toDF("written").collect() if r["written"])
