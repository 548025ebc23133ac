"""Files through Arrow's file systems, for data sources whose tasks read or write parts of files."""

from __future__ import annotations

import re

from pyarrow import fs


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the folder's path in it; a path without a scheme is local."""
    return fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")


def listed(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """All files below a path, by path."""
    found = system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)
