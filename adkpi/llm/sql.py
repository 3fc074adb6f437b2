"""Pieces of DuckDB SQL that several twins share."""

from __future__ import annotations

# The reversed polynomial of CRC-32, a fixed value; the table follows from it.
_POLYNOMIAL = 0xEDB88320

CRC_TABLE = f"""
crc_table AS (
  SELECT list(crc ORDER BY byte) AS entries FROM (
    SELECT byte, list_reduce(list_prepend(byte, range(8)), lambda crc, step:
      CASE WHEN crc & 1 = 1 THEN xor({_POLYNOMIAL}, crc >> 1) ELSE crc >> 1 END) AS crc
    FROM range(256) AS bytes(byte)))"""


def crc32(text: str) -> str:
    """Unsigned CRC-32 of a text's UTF-8 bytes; needs ``CRC_TABLE`` in the FROM clause."""
    octets = (
        f"list_transform(range(strlen({text})), lambda i:"
        f" ('0x' || substr(hex(encode({text})), (2 * i + 1)::INTEGER, 2))::BIGINT)"
    )
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295, {octets}), lambda crc, byte:"
        f" xor(entries[(xor(crc, byte) & 255) + 1], crc >> 8)))"
    )
