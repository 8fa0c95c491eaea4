"""Parsers that need Python: pure functions of bytes, run over Arrow batches by quillworks.operators."""


class Unreadable(Exception):
    """A document that can't be read: an error code with its reason, never a failed task."""

    def __init__(self, code: str, reason: str) -> None:
        super().__init__(reason)
        self.code, self.reason = code, reason


def invalid(reason: str) -> Unreadable:
    return Unreadable("invalidDocument", reason)
