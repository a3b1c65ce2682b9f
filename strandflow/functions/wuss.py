"""RNA secondary structure notation. Brackets pair with their own kind; a lower-case letter opens and
the upper-case one closes a pseudoknot."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alphabet import col

OPEN, CLOSE = "<([{", ">)]}"
_LOW, _UP = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_OPENS, _CLOSES = OPEN + _LOW, CLOSE + _UP


def without_pseudoknots(ss) -> Column:
    return F.regexp_replace(col(ss), "[A-Za-z]", ".")


def reverse(ss) -> Column:
    return F.reverse(F.translate(col(ss), _OPENS + _CLOSES, _CLOSES + _OPENS))


def count_pairs(ss) -> Column:
    return F.length(F.regexp_replace(col(ss), r"[^<(\[{a-z]", ""))


def pair_list(ss: str) -> list[int] | None:
    """Each place's 0-based partner, -1 for none; None if brackets do not match."""
    stacks: dict[str, list[int]] = {}
    out = [-1] * len(ss)
    for i, c in enumerate(ss):
        if c in _OPENS:
            stacks.setdefault(c, []).append(i)
        elif c in _CLOSES:
            stack = stacks.get(_OPENS[_CLOSES.index(c)])
            if not stack:
                return None
            j = stack.pop()
            out[i], out[j] = j, i
        elif not c.isprintable() or c == " ":
            return None
    return None if any(stacks.values()) else out


def simple(partners: list[int]) -> str:
    return "".join("." if p < 0 else "(" if p > i else ")" for i, p in enumerate(partners))


def layers(partners: list[int], limit: int | None = None) -> list[list[tuple[int, int]]]:
    """The pairs in layers without crossings, each pair in the first layer it fits, in order of opening."""
    out: list[list[tuple[int, int]]] = []
    for i, j in ((i, p) for i, p in enumerate(partners) if p > i):
        fits = (layer for layer in out if not any(a < i < b < j or i < a < j < b for a, b in layer))
        layer = next(fits, None)
        if layer is None:
            out.append(layer := [])
        layer.append((i, j))
    if limit is not None and len(out) > limit:
        raise ValueError("too many crossing layers")
    return out


def bracketed(partners: list[int]) -> str:
    """Four layers of brackets."""
    out = ["."] * len(partners)
    for (a, b), layer in zip(("()", "<>", "[]", "{}"), layers(partners, 4)):
        for i, j in layer:
            out[i], out[j] = a, b
    return "".join(out)


def lettered(partners: list[int]) -> str:
    """<> for the nested layer, letters for the crossing ones."""
    out = ["."] * len(partners)
    for n, layer in enumerate(layers(partners, 27)):
        a, b = ("<", ">") if n == 0 else (_LOW[n - 1], _UP[n - 1])
        for i, j in layer:
            out[i], out[j] = a, b
    return "".join(out)


def full(partners: list[int]) -> str:
    """Structural notation of the nested pairs: <> for a pair with none inside, () for one around others;
    ``_`` in a hairpin, ``-`` in a bulge or interior loop, ``,`` in a multifurcation, ``:`` outside.
    Crossing layers are [] and {}."""
    nested, *crossing = layers(partners, 3) or [[]]
    close = dict(nested)
    out, directly = [":"] * len(partners), {i: 0 for i in close}
    owner, open_ = [-1] * len(partners), []
    for at in range(len(partners)):
        if open_ and close[open_[-1]] == at:
            open_.pop()
        elif at in close:
            if open_:
                directly[open_[-1]] += 1
            open_.append(at)
        elif open_:
            owner[at] = open_[-1]
    for i, j in nested:
        out[i], out[j] = "<>" if not directly[i] else "()"
    for at, i in enumerate(owner):
        if i >= 0:
            out[at] = "_-,"[min(directly[i], 2)]
    for (a, b), layer in zip(("[]", "{}"), crossing):
        for i, j in layer:
            out[i], out[j] = a, b
    return "".join(out)


def drop_broken(ss: str, keep: list[bool]) -> str:
    """Both partners become dots where either column is dropped."""
    partners = pair_list(ss)
    if partners is None:
        raise ValueError("unbalanced structure")
    return "".join("." if p >= 0 and not (keep[i] and keep[p]) else c for i, (c, p) in enumerate(zip(ss, partners)))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def partners(ss: pd.Series) -> pd.Series:
    """0-based partners, -1 for none; null for unbalanced text."""
    return ss.map(lambda x: None if x is None else pair_list(x))


@F.pandas_udf(T.BooleanType())
def valid(ss: pd.Series) -> pd.Series:
    return ss.map(lambda x: None if x is None else pair_list(x) is not None)


def _writer(f):
    @F.pandas_udf(T.StringType())
    def run(p: pd.Series) -> pd.Series:
        return p.map(lambda x: None if x is None else f([int(i) for i in x]))

    return run


to_simple, to_brackets, to_letters, to_full = map(_writer, (simple, bracketed, lettered, full))
