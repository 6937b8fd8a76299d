"""Files of public vocabularies; where they are is a parameter."""

from __future__ import annotations

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def installed(name: str) -> str:
    """Place of a vocabulary file of the installed collection."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def read_file(path: str) -> bytes:
    """A vocabulary of at most a few MB; it travels to the tasks with their code."""
    with open(path, "rb") as file:
        return file.read()
