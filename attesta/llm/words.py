"""Words of a text: maximal runs of anything but space, tab, newline, vertical tab, form feed, carriage return."""

from __future__ import annotations

from collections.abc import Iterator

#: Bytes of a text whose words are held at once.
PIECE = 1 << 20
BLANKS = b" \t\n\x0b\x0c\r"


def utf8(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words in order, piece by piece, each piece ending at white space."""
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and text[end] not in BLANKS:
            end += 1
        yield text[at:end].split()
        at = end
