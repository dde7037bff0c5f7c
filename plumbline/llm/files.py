"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place_of(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path, and the path in it."""
    return fs.FileSystem.from_uri(uri)


class Appender:
    """A new file under a name of its own, kept apart from other attempts."""

    def __init__(self, folder: str, name: str):
        system, base = place_of(folder)
        system.create_dir(base, recursive=True)
        self.system, self.path = system, f"{base}/{name}-{uuid.uuid4().hex}"
        self.stream, self.size = system.open_output_stream(self.path), 0

    def write(self, data: bytes) -> int:
        """Append; the offset at which `data` starts."""
        at, self.size = self.size, self.size + len(data)
        self.stream.write(data)
        return at

    def close(self, final: str | None = None) -> str:
        """Close; with `final`, take that name, whole or not at all."""
        self.stream.close()
        if final:
            target = self.path.rsplit("/", 1)[0] + "/" + final
            self.system.move(self.path, target)
            self.path = target
        return self.path


def read_ranges(folder: str, path: str, ranges: list[tuple[int, int]], gap: int, most: int):
    """The bytes of sorted (offset, length) ranges, with near ones read together.

    Ranges at most `gap` bytes apart share a read of up to `most` bytes.
    """
    system, _ = place_of(folder)
    with system.open_input_file(path) as source:
        i = 0
        while i < len(ranges):
            start, stop, j = ranges[i][0], ranges[i][0] + ranges[i][1], i + 1
            while j < len(ranges) and ranges[j][0] - stop <= gap and ranges[j][0] + ranges[j][1] - start <= most:
                stop, j = max(stop, ranges[j][0] + ranges[j][1]), j + 1
            block = source.read_at(stop - start, start)
            for offset, length in ranges[i:j]:
                yield block[offset - start : offset - start + length]
            i = j
