"""A network whose weights follow from a rule, so that SQL can state it too."""

from __future__ import annotations

import numpy as np

from trialnum.functions.features import OTHER_FEATURES
from trialnum.functions.tokens import TAGS

DIM = 2
INPUTS = 4 * DIM + 2 * len(TAGS) + len(OTHER_FEATURES)
HIDDEN = 3


def weight(layer: int, output: int, place: int) -> float:
    return ((place + 1) * (output + 2) * 7 + layer * 5) % 13 / 40 - 0.15


def layers(kind: str) -> list[tuple[np.ndarray, np.ndarray]]:
    sizes = [INPUTS, 1] if kind == "logistic" else [INPUTS, HIDDEN, 2]
    return [
        (
            np.array([[weight(k, j, i) for i in range(n_in)] for j in range(n_out)]),
            np.array([weight(k, j, n_in) for j in range(n_out)]),
        )
        for k, (n_in, n_out) in enumerate(zip(sizes, sizes[1:]))
    ]


def _first_sum(matrix: np.ndarray, bias: np.ndarray, output: int) -> str:
    row = matrix[output]
    columns = [f"{c}_{part}" for c in ("ll", "l", "rr", "r") for part in ("len", "id")]
    terms = [repr(float(bias[output]))] + [f"{c} * {float(w)!r}" for c, w in zip(columns, row)]
    for side, start in (("left_pos", 4 * DIM), ("right_pos", 4 * DIM + len(TAGS))):
        known = [f"WHEN '{tag.replace(chr(39), chr(39) * 2)}' THEN {float(row[start + k])!r}" for k, tag in enumerate(TAGS)]
        terms.append(f"CASE {side} {' '.join(known)} ELSE 0.0 END")
    terms += [f"{c} * {float(w)!r}" for c, w in zip(OTHER_FEATURES, row[4 * DIM + 2 * len(TAGS) :])]
    return " + ".join(f"CAST({t} AS DOUBLE)" for t in terms)


def confidence_sql(kind: str) -> str:
    """Confidence over columns ll_len .. r_id, left_pos, right_pos and the numeric features."""
    first, *rest = layers(kind)
    sums = [f"({_first_sum(*first, j)})" for j in range(len(first[1]))]
    for matrix, bias in rest:
        hidden = [f"(1 / (1 + exp(-{s})))" for s in sums]
        sums = [f"({float(b)!r} + {' + '.join(f'{h} * {float(w)!r}' for h, w in zip(hidden, row))})" for row, b in zip(matrix, bias)]
    z = f"{sums[1]} - {sums[0]}" if len(sums) == 2 else sums[0]
    return f"1 / (1 + exp(-({z})))"
