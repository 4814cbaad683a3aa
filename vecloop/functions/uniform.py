"""Random numbers that depend on (seed, id, position) only, never on how rows are partitioned.

A number comes from the md5 of the text ``seed:id:position``; all functions give SQL text.
"""

from __future__ import annotations

from vecloop.functions.vectors import UNROLL_WIDTH

# 13 hex digits are 52 bits, all of which a double holds exactly.
HEX_DIGITS = 13
RANGE = 16**HEX_DIGITS


def prefix(seed: int, id_col: str) -> str:
    """The text before the position, computed once per row."""
    return f"concat('{seed}:', {id_col}, ':')"


def uniform(key: str) -> str:
    """Uniform in [0, 1) from the text ``key``."""
    return f"CAST(conv(left(md5({key}), {HEX_DIGITS}), 16, 10) AS DOUBLE) / {RANGE}D"


def uniforms(prefix_col: str, first: int, width: int) -> str:
    """``width`` uniforms as an array, at the positions from ``first`` on."""
    if width <= UNROLL_WIDTH:
        keys = [f"concat({prefix_col}, '{i}')" for i in range(first, first + width)]
        return f"array({', '.join(uniform(k) for k in keys)})"
    key = uniform(f"concat({prefix_col}, pos)")
    return f"transform(sequence({first}, {first + width - 1}), pos -> {key})"
