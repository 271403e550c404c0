"""crc32 in the SQL that checks queries."""

from __future__ import annotations


def crc32_sql(text: str) -> str:
    """crc32 of an ASCII string, bit by bit."""
    return (
        f"xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte: "
        "list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, bit: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295::BIGINT)"
    )
