"""Opening files by path inside tasks: local folders and any store that ``pyarrow.fs`` knows."""

from __future__ import annotations

import re
from urllib.parse import quote, urlsplit

import pyarrow.fs as pafs


def open_path(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path inside it.  The path is taken as it is (not percent-encoded), so names
    may hold blanks, percent signs and any letters."""
    scheme = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", path)
    if scheme is None or scheme[1].lower() == "file":
        return pafs.LocalFileSystem(), re.sub(r"^(?i:file):/*", "/", path)
    parts = urlsplit(path.split("/", 3)[0] + "//" + path.split("/", 3)[2])
    inner = path.split("/", 3)[3] if path.count("/") > 2 else ""
    return pafs.FileSystem.from_uri(f"{parts.scheme}://{parts.netloc}/{quote(inner)}")
