"""Expressions on distributions held as arrays or as long rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldshift.functions.vectors import let, total

KL_EPS = 1e-9


def alr(p: Column, ref: int) -> Column:
    """Additive log-ratio of an array distribution, reference entry left out."""
    def ratios(logs: Column) -> Column:
        kept = F.concat(F.slice(logs, 1, ref), F.slice(logs, ref + 2, 1 << 30))
        return F.transform(kept, lambda x: x - F.element_at(logs, ref + 1))

    return let(F.transform(p, lambda x: F.log(x)), ratios)


def inv_alr(y: Column, ref: int) -> Column:
    """Back to the simplex: softmax with a zero at the reference."""
    return let(
        y, lambda v: softmax(F.concat(F.slice(v, 1, ref), F.array(F.lit(0.0)), F.slice(v, ref + 1, 1 << 30)))
    )


def softmax(x: Column) -> Column:
    e = let(x, lambda v: let(F.array_max(v), lambda top: F.transform(v, lambda z: F.exp(z - top))))
    return normalized(e)


def normalized(x: Column) -> Column:
    """Entries over their sum."""
    return let(x, lambda v: let(total(v), lambda t: F.transform(v, lambda z: z / t)))


def kl_bits(p: Column, q: Column, eps: float = KL_EPS) -> Column:
    """Aggregate: KL(p || q) in bits over the rows of a group.

    Both sides get ``eps`` and are renormalised; the normalisers factor out, so
    one pass over the group is enough.
    """
    pe, qe = p + F.lit(eps), q + F.lit(eps)
    cross = F.sum(pe * (F.log2(pe) - F.log2(qe)))
    return cross / F.sum(pe) - F.log2(F.sum(pe)) + F.log2(F.sum(qe))
