"""Texts of Arrow batches."""

from __future__ import annotations

import pyarrow as pa


def strings(column: pa.Array) -> list[str | None]:
    """The strings of a column; bytes that are no UTF-8 become U+FFFD, as everywhere a text is decoded here."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]
