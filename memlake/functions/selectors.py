"""Selectors: conjunctions of path -> condition compiled to one condition."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F


def dig(doc: Column, path: str) -> Column:
    """The value at a dotted path of a JSON text, as text; null where it is missing. A numeric step is a place in a list or a field."""
    steps = [(f"[{p}]", f"['{p}']") if p.isdigit() else (f"['{p}']",) for p in path.replace("[", ".").replace("]", "").split(".")]
    return F.coalesce(*[F.get_json_object(doc, "$" + "".join(way)) for way in product(*steps)])


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def compile_selector(selector: dict, doc: Column) -> Column:
    """A condition is a list (the value is one of it) or {"op": ..., "value": ...}. Operators: in, not_in, eq and ne (a list counts by its
    first element), exists (true unless the value says false), contains (any of a list, case-insensitive), gt, lt (numeric),
    changed (true). Missing values satisfy only not_in, ne and exists: false. An empty selector takes everything."""

    def one(path: str, condition) -> Column:
        rule = condition if isinstance(condition, dict) else {"op": "in", "value": condition}
        op, value = rule.get("op", "in"), rule.get("value", True if rule.get("op") == "exists" else None)
        listed = value if isinstance(value, list | tuple) else [value]
        v = dig(doc, path)
        missing = v.isNull()
        number = F.coalesce(F.get_json_object(v, "$[0]"), v).try_cast("double")
        tests = {
            "in": lambda: v.isin([_text(x) for x in listed]),
            "not_in": lambda: missing | ~v.isin([_text(x) for x in listed]),
            "eq": lambda: v == _text(listed[0]),
            "ne": lambda: missing | (v != _text(listed[0])),
            "exists": lambda: ~missing if value else missing,
            "contains": lambda: reduce(lambda a, b: a | b, [F.lower(v).contains(_text(x).lower()) for x in listed], F.lit(False)),
            "gt": lambda: number > float(listed[0]),
            "lt": lambda: number < float(listed[0]),
            "changed": lambda: F.lit(True),
        }
        return F.coalesce(tests[op](), F.lit(False)) if op in tests else F.lit(False)

    return reduce(lambda a, b: a & b, (one(p, c) for p, c in selector.items()), F.lit(True))
