"""Files in the shared folder, written by tasks: complete or absent, whoever writes them."""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    system, path = pafs.FileSystem.from_uri(uri)
    return system, path.rstrip("/")


class Whole:
    """A file that appears under its name only once it is complete.

    A task that is run again, or twice at once, writes the same bytes to a name of its
    own and moves them over the same final name.
    """

    def __init__(self, system: pafs.FileSystem, path: str):
        self.system, self.path = system, path
        self.parts = f"{path}.{uuid.uuid4().hex}.part"
        self.out = system.open_output_stream(self.parts, compression=None)

    def write(self, data: bytes) -> None:
        self.out.write(data)

    def close(self) -> None:
        self.out.close()
        try:
            self.system.move(self.parts, self.path)
        except OSError:  # some systems do not move over a file
            if self.system.get_file_info(self.path).type == pafs.FileType.NotFound:
                raise
            self.system.delete_file(self.parts)
