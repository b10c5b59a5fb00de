"""A SQLite file and its write-ahead log as one image.

A log holds whole pages. Pages up to the last frame that ends a transaction are in force, as far as salts and checksums
hold; later frames belong to no finished transaction and stay out. The image is marked as having no log, so that it can
be read as a private immutable copy. Format as published by SQLite ("Database File Format", section 4).
"""

from __future__ import annotations

import struct

_MAGIC = {0x377F0682: "<", 0x377F0683: ">"}


def _sum(data: bytes, order: str, s: tuple[int, int]) -> tuple[int, int]:
    a, b = s
    words = struct.unpack(f"{order}{len(data) // 4}I", data)
    for x, y in zip(words[::2], words[1::2]):
        a = (a + x + b) & 0xFFFFFFFF
        b = (b + y + a) & 0xFFFFFFFF
    return a, b


def merged(db: bytes, log: bytes | None) -> bytes:
    """The database with all finished transactions of its log; without a usable log the database as it is."""
    image, pages, size, page = bytearray(db), {}, None, 0
    order = _MAGIC.get(struct.unpack(">I", log[:4])[0]) if log and len(log) >= 32 else None
    if order:
        page, _, *salts = struct.unpack(">4I", log[8:24])
        total = _sum(log[:24], order, (0, 0))
        at, waiting = 32, {}
        if total != struct.unpack(">2I", log[24:32]):
            at = len(log)
        while at + 24 + page <= len(log):
            number, commit, *frame_salts = struct.unpack(">4I", log[at : at + 16])
            body = log[at + 24 : at + 24 + page]
            total = _sum(body, order, _sum(log[at : at + 8], order, total))
            if frame_salts != salts or total != struct.unpack(">2I", log[at + 16 : at + 24]):
                break
            waiting[number] = body
            if commit:
                pages |= waiting
                size, waiting = commit, {}
            at += 24 + page
    if size is not None:
        image.extend(bytes(max(0, size * page - len(image))))
        for number, body in pages.items():
            if number <= size:
                image[(number - 1) * page : number * page] = body
        del image[size * page :]
    if len(image) >= 20:
        image[18:20] = b"\x01\x01"
    return bytes(image)
