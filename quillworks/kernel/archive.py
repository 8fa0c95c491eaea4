"""ZIP containers within a budget of entries and expanded bytes."""

from __future__ import annotations

import io
import zipfile
import zlib

from quillworks.kernel import invalid

CHUNK = 1 << 16


class Archive:
    def __init__(self, data: bytes, name: str, options) -> None:
        self.name, self.options, self.expanded = name, options, 0
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError, EOFError, RuntimeError):
            raise invalid(f"Could not open {name} ZIP archive.") from None
        if len(self.zip.infolist()) > options.max_archive_entry_count:
            raise invalid(f"{name} archive contains too many entries; max {options.max_archive_entry_count}.")
        self.entries = {i.filename: i for i in reversed(self.zip.infolist())}

    def __contains__(self, path: str) -> bool:
        return path in self.entries

    def read(self, path: str) -> bytes | None:
        """An entry's bytes, None if there is no such entry.  Declared sizes are checked before reading, real ones while reading."""
        info = self.entries.get(path)
        if info is None:
            return None
        if info.is_dir():
            raise invalid(f"{self.name} archive entry is a directory: {path}.")
        most, left = self.options.max_archive_entry_bytes, self.options.max_expanded_archive_bytes - self.expanded
        if info.file_size > most:
            raise invalid(f"{self.name} archive entry exceeds maxArchiveEntryBytes: {path} expands to {info.file_size} bytes, max {most}.")
        if info.file_size > left:
            raise invalid(f"{self.name} expanded content exceeds maxExpandedArchiveBytes ({self.options.max_expanded_archive_bytes}).")
        parts, size = [], 0
        try:
            with self.zip.open(info) as f:
                while chunk := f.read(CHUNK):
                    size += len(chunk)
                    if size > most:
                        raise invalid(f"{self.name} archive entry exceeds maxArchiveEntryBytes while extracting: {path}.")
                    if size > left:
                        raise invalid(f"{self.name} expanded content exceeds maxExpandedArchiveBytes while extracting.")
                    parts.append(chunk)
        except (zipfile.BadZipFile, zlib.error, OSError, EOFError, NotImplementedError, RuntimeError, ValueError):
            raise invalid(f"Could not extract {self.name} archive entry: {path}.") from None
        self.expanded += size
        return b"".join(parts)
