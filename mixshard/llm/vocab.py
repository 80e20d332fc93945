"""Public tokenizer files: read once on the driver, shipped as one bounded broadcast."""

from __future__ import annotations

from pathlib import Path

#: Largest tokenizer file that is broadcast (the public ones have 0.5 to 2 MB).
MOST_BYTES = 64 << 20


def default_path(name: str) -> str:
    """Place of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_file(path: str) -> bytes:
    data = Path(path).read_bytes()
    if len(data) > MOST_BYTES:
        raise ValueError(f"{path}: {len(data)} bytes, more than the bound {MOST_BYTES} of a broadcast")
    return data
