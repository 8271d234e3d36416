"""Whole files in the shared folder, written by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def write_file(uri: str, data: bytes) -> None:
    """Write and rename: a file is whole or absent, and a repeated task replaces its own file."""
    system, path = fs.FileSystem.from_uri(uri)
    folder, _, name = path.rpartition("/")
    system.create_dir(folder, recursive=True)
    held = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(held) as out:
        out.write(data)
    system.move(held, path)
