"""DuckDB expressions that the SQL of several corpus operators shares."""

#: A common table of one row, the CRC-32 table of 256 entries by its rule (reversed polynomial).
CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce(list_prepend(i::UBIGINT, range(8)::UBIGINT[]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::UBIGINT) ELSE a >> 1 END) ORDER BY i) AS crc FROM range(256) r(i)
)"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; the query reads from crc_table too."""
    byte = f"('0x' || substr(hex(encode({text})), 2 * k + 1, 2))::UBIGINT"
    step = "xor(a >> 8, crc[CAST(xor(a, b) & 255 AS BIGINT) + 1])"
    return f"CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen({text})), lambda k: {byte})), lambda a, b: {step}), 4294967295) AS BIGINT)"
