"""Where vocabulary files of public tokenizers are; they are never copied into the repository."""

from __future__ import annotations

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str) -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
