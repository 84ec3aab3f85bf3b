"""Equi-joins on one key, with a fixed rule for the output schema.

A shared key stands once, where the left key stood; the right key goes. Its
value is the left one (inner, left), the right one (right), or the left else
the right one (full). Null keys never match, nor does NaN unless a canonical
form says so.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from orrery.errors import ColumnConflictError, ColumnNotFoundError, ColumnTypeError, InvalidNameError, UnsupportedError
from orrery.functions.numeric import is_float
from orrery.operators.series import Series
from orrery.plans.ordinal import HIDDEN

KINDS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}


@dataclass(frozen=True)
class JoinKey:
    left: str | Series
    right: str | Series
    out: str | None = None
    canon: Callable[[Column], Column] | None = None


def _canon(canon):
    if not callable(canon):
        raise UnsupportedError("a canonical form is needed")
    return canon


def on(left: Series, right: Series) -> JoinKey:
    """Any two expressions; all columns of both sides stay."""
    return JoinKey(left, right)


def on_by(left: Series, right: Series, canon) -> JoinKey:
    return JoinKey(left, right, canon=_canon(canon))


def using(name: str) -> JoinKey:
    return JoinKey(name, name, name)


def using_by(name: str, canon) -> JoinKey:
    return JoinKey(name, name, name, _canon(canon))


def using_columns(out: str, left: str, right: str) -> JoinKey:
    return JoinKey(left, right, out)


def using_columns_by(out: str, left: str, right: str, canon) -> JoinKey:
    return JoinKey(left, right, out, _canon(canon))


def join(left, right, key: JoinKey, kind: str):
    from orrery.operators.frame import Frame

    if key.out is not None and not key.out:
        raise InvalidNameError("the key's name is empty")
    sides = []
    for frame, k in ((left, key.left), (right, key.right)):
        if isinstance(k, str) and k not in frame.df.columns:
            raise ColumnNotFoundError(k)
        sides.append(frame.column(k) if isinstance(k, str) else k)
    a, b = sides
    if a.dtype != b.dtype:
        raise ColumnTypeError(f"keys of {a.dtype.simpleString()} and {b.dtype.simpleString()}")
    # Sides of one lineage would share attributes; new names keep each column apart.
    l_names, r_names = left.df.columns, right.df.columns
    ldf = left.base.select(*[F.col(_q(n)).alias(f"l{i}") for i, n in enumerate(l_names)], *_places(left, "lo"), *(() if isinstance(key.left, str) else (a.expr.alias("lk"),)))
    rdf = right.base.select(*[F.col(_q(n)).alias(f"r{i}") for i, n in enumerate(r_names)], *_places(right, "ro"), *(() if isinstance(key.right, str) else (b.expr.alias("rk"),)))
    lk = F.col(f"l{l_names.index(key.left)}" if isinstance(key.left, str) else "lk")
    rk = F.col(f"r{r_names.index(key.right)}" if isinstance(key.right, str) else "rk")
    if key.canon:
        same = key.canon(lk) == key.canon(rk)
    else:
        same = lk == rk
        if is_float(a.dtype):
            same = same & ~F.isnan(lk)
    shared = key.out is not None
    if kind in ("semi", "anti"):
        out = ldf.join(rdf, same, KINDS[kind])
        mine = [F.col(f"lo{i}").alias(n) for i, n in enumerate(left.order) if n.startswith(HIDDEN)]
        return Frame(out.select(*[F.col(f"l{i}").alias(n) for i, n in enumerate(l_names)], *mine), left.order)
    merged = {"right": rk, "full": F.coalesce(lk, rk)}.get(kind, lk)
    columns = [merged.alias(key.out) if shared and n == key.left else F.col(f"l{i}").alias(n) for i, n in enumerate(l_names)]
    columns += [F.col(f"r{i}").alias(n) for i, n in enumerate(r_names) if not (shared and n == key.right)]
    names = [key.out if shared and n == key.left else n for n in l_names] + [n for n in r_names if not (shared and n == key.right)]
    if twice := next((n for n in names if names.count(n) > 1), None):
        raise ColumnConflictError(f"both sides have {twice!r}")
    # The driving side's order first; of a full join, the right rows without partner come last.
    mine, theirs = [F.col(f"lo{i}") for i in range(len(left.order))], [F.col(f"ro{i}") for i in range(len(right.order))]
    places = theirs + mine if kind == "right" else mine + theirs
    if kind == "full" and mine:
        places.insert(0, mine[0].isNull())
    places = [c.alias(f"{HIDDEN}{i}") for i, c in enumerate(places)]
    return Frame(ldf.join(rdf, same, KINDS[kind]).select(*columns, *places), [f"{HIDDEN}{i}" for i in range(len(places))])


def cross(left, right):
    from orrery.operators.frame import Frame

    if both := set(left.df.columns) & set(right.df.columns):
        raise ColumnConflictError(f"both sides have {min(both)!r}")
    ldf, rdf = (f.base.select(*map(_q, f.df.columns), *_places(f, s)) for f, s in ((left, "lo"), (right, "ro")))
    places = [f"lo{i}" for i in range(len(left.order))] + [f"ro{i}" for i in range(len(right.order))]
    hidden = [F.col(n).alias(f"{HIDDEN}{i}") for i, n in enumerate(places)]
    return Frame(ldf.crossJoin(rdf).select(*map(_q, left.df.columns + right.df.columns), *hidden), [f"{HIDDEN}{i}" for i in range(len(places))])


def _places(frame, side: str) -> list[Column]:
    return [F.col(_q(n)).alias(f"{side}{i}") for i, n in enumerate(frame.order)]


def _q(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
