"""Selection conditions as data: what a saved query stores, and what other programs send.

A condition is a tree of {"op": name, "args": [...]}, {"var": name} and plain values, as read from JSON:

    {"op": "and", "args": [{"op": "<", "args": [{"var": "hfr"}, {"op": "median", "args": [{"var": "hfr"}]}]},
                           {"op": "not like", "args": [{"var": "path"}, "%/Reject/%"]}]}

It builds the same columns as a predicate written in Python, so case, unknown values and dates mean the same.
"""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

from nightledger.operators.predicates import Num, as_flag

_COMPARE = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
_ARITHMETIC = {"+": operator.add, "-": operator.sub, "*": operator.mul, "/": operator.truediv, "%": operator.mod, "**": operator.pow}
_OF_VALUE = {
    "between": lambda x, lo, hi: x.between(lo, hi), "not between": lambda x, lo, hi: x.not_between(lo, hi),
    "like": lambda x, pattern: x.like(pattern), "not like": lambda x, pattern: x.not_like(pattern),
    "in": lambda x, *values: x.isin(*values), "missing": lambda x: x.missing(), "present": lambda x: x.present(),
}
#: Functions and statistics of the selection variables.
_OF_VARS = {"abs", "sqrt", "log", "log10", "angsep", "contains", "percentile", "median", "mean", "avg", "std", "sigma", "min", "max", "sum", "count", "mad", "madstd"}


def predicate_of(tree) -> Callable:
    """The predicate that a condition stands for; ValueError if it is none."""

    def build(v, node):
        if isinstance(node, (str, int, float)):
            return node
        if not isinstance(node, dict):
            raise ValueError(f"not part of a condition: {node!r}")
        if "var" in node:
            try:
                return getattr(v, str(node["var"]))
            except AttributeError as unknown:
                raise ValueError(str(unknown)) from None
        op, args = node.get("op"), [build(v, x) for x in node.get("args", [])]
        if op in ("and", "or"):
            return reduce(operator.and_ if op == "and" else operator.or_, map(as_flag, args))
        if op == "not":
            return ~as_flag(*args)
        if op in _OF_VARS:
            return getattr(v, op)(*args)
        for table in (_COMPARE, _ARITHMETIC, _OF_VALUE):
            if op in table:
                return table[op](*args)
        raise ValueError(f"unknown operation: {op!r}")

    def predicate(v):
        out = build(v, tree)
        if isinstance(out, (str, float)) or not isinstance(out, bool) and isinstance(out, int):
            raise ValueError("a condition has to be true or false")
        return out if not isinstance(out, Num) else as_flag(out)

    return predicate
