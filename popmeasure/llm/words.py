"""Word splitting on bytes, for work that runs in Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_LETTERS_DIGITS = frozenset(b"0123456789" + _LOWER)
# every ASCII byte that is no letter or digit becomes a space; bytes of other characters stay
_TO_WORDS = bytes(
    b + 32 if b in _UPPER else b if b >= 128 or b in _LETTERS_DIGITS else 32 for b in range(256)
)


def spaced_words(text: str | None) -> list[bytes]:
    """Runs of `[^\\x20\\x09-\\x0D]` after A-Z are lowered. bytes.lower and bytes.split know ASCII only."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """Runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z are lowered."""
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def texts(frame: pd.DataFrame, column: str = "text") -> Iterator[str | None]:
    for value in frame[column]:
        yield value if isinstance(value, str) else None


def gathered(frames: Iterator[pd.DataFrame], rows: int = 20_000) -> Iterator[pd.DataFrame]:
    """The same rows in frames of about `rows`, for work on short values that gains from long arrays."""
    held, n = [], 0
    for frame in frames:
        held.append(frame)
        n += len(frame)
        if n >= rows:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)
