"""The scalar factor of one point's gradient term; the term itself is ``factor * x``.

As SQL text over the label ``y`` and ``d = w . x``: the trainers build these expressions anew in every
iteration, and one piece of text costs the driver far less than a tree of column calls.
"""

from __future__ import annotations


def logistic_factor(y: str, d: str) -> str:
    """``(1 / (1 + exp(-y d)) - 1) y``.

    A large negative ``y d`` makes ``exp`` infinite and the fraction 0, so nothing overflows.
    """
    return f"(1D / (1D + exp(-{y} * ({d}))) - 1D) * {y}"


def alternate_factor(y: str, d: str) -> str:
    """``(1 - 1 / (1 + (-y) exp(d))) (-y)``, the second rule; it is not the logistic gradient.

    At ``y = 1, d = 0`` the denominator is 0 and the fraction is taken as infinite, as IEEE
    division has it, where SQL division would raise an error.
    """
    denominator = f"(1D - {y} * exp({d}))"
    fraction = f"CASE WHEN {denominator} = 0D THEN double('Infinity') ELSE 1D / {denominator} END"
    return f"(1D - {fraction}) * -{y}"


FACTORS = {"logistic": logistic_factor, "alt": alternate_factor}
