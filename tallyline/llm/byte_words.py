"""Words of UTF-8 texts as bytes: every byte that is part of no word becomes a space, A-Z become a-z, nothing is decoded."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text that are split into words at once; longer texts are taken in pieces.
PIECE_BYTES = 1 << 20
LETTERS = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))


def word_table(ascii_kept: bytes) -> bytes:
    """For bytes.translate: kept ASCII bytes and all bytes of other characters stay, A-Z are lower-cased if a-z are kept."""
    lower = lambda b: b + 32 if 65 <= b <= 90 else b
    return bytes(lower(b) if b >= 128 or lower(b) in ascii_kept else 32 for b in range(256))


def word_pieces(text: bytes, table: bytes) -> Iterator[list[bytes]]:
    """The words of text in order, in lists of about PIECE_BYTES; a word longer than that is in one list whole."""
    if len(text) <= PIECE_BYTES:
        yield text.translate(table).split()
        return
    view, at = memoryview(text), 0
    rest = b""
    while at < len(text):
        part = rest + bytes(view[at : at + PIECE_BYTES]).translate(table)
        at += PIECE_BYTES
        end = len(part) if at >= len(text) else part.rfind(b" ") + 1
        rest = part[end:]
        if end:
            yield part[:end].split()
