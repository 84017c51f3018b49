"""Files in the shared folder, for executors and driver alike."""

from __future__ import annotations

import pyarrow.fs as pafs


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI as Spark names it; Spark's s3a and s3n are s3 here."""
    scheme, _, rest = uri.partition("://")
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)
