"""What can be wrong with a snapshot. Each message begins with a tag, as only the text of an error survives the way from
a Python worker to the driver."""

from __future__ import annotations


class SnapshotError(Exception):
    tag = "[SNAPSHOT]"

    def __init__(self, text: str):
        super().__init__(text if text.startswith("[SNAPSHOT") else f"{self.tag} {text}")


class InvalidMagic(SnapshotError):
    tag = "[SNAPSHOT_MAGIC]"


class UnsupportedVersion(SnapshotError):
    tag = "[SNAPSHOT_VERSION]"


class CorruptData(SnapshotError):
    tag = "[SNAPSHOT_CORRUPT]"


class Truncated(SnapshotError):
    """The file ends in the middle."""

    tag = "[SNAPSHOT_ENDS]"


class Unreadable(SnapshotError):
    """The file can't be opened or read."""

    tag = "[SNAPSHOT_IO]"


class UnknownType(SnapshotError):
    """An object type that is skipped; the one error after which reading goes on."""

    tag = "[SNAPSHOT_TYPE]"


KINDS = (InvalidMagic, UnsupportedVersion, CorruptData, Truncated, Unreadable, UnknownType)


def from_message(text: str) -> SnapshotError | None:
    """The error that a message from a worker tells of, or None."""
    for kind in KINDS:
        at = text.find(kind.tag)
        if at >= 0:
            return kind(text[at:].splitlines()[0])
    return None
