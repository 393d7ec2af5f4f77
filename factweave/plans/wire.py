"""Clauses as plain dictionaries, for JSON, and back."""

from __future__ import annotations

from collections.abc import Sequence

from factweave.plans.clauses import FullText, Lit, Not, Or, Pattern, Predicate, RuleCall, is_var


def _term(x) -> dict:
    """A variable, or a literal; None is the literal null."""
    return {"var": x} if is_var(x) else {"literal": x.value if isinstance(x, Lit) else x}


def _read_term(x: dict):
    if set(x) == {"var"}:
        if not is_var(x["var"]):
            raise ValueError("a variable begins with ?")
        return x["var"]
    if set(x) != {"literal"}:
        raise ValueError("a term has a var or a literal")
    return Lit(x["literal"]) if is_var(x["literal"]) else x["literal"]


def to_dicts(clauses: Sequence[object]) -> list[dict]:
    """One dictionary a clause, its only key the kind of the clause."""
    out = []
    for c in clauses:
        if isinstance(c, Pattern):
            out.append({"pattern": {"entity": c.entity, "attribute": c.attr, "value": _term(c.value)}})
        elif isinstance(c, Predicate):
            out.append({"predicate": {"op": c.op, "left": _term(c.left), "right": _term(c.right)}})
        elif isinstance(c, Or):
            out.append({"or": {"branches": [to_dicts(b) for b in c.branches]}})
        elif isinstance(c, Not):
            out.append({"not": {"body": to_dicts(c.clauses)}})
        elif isinstance(c, FullText):
            out.append({"fulltext": {"query": c.text, "attribute": c.attr}})
        elif isinstance(c, RuleCall):
            out.append({"rule_call": {"name": c.name, "var": c.var, "root": c.root}})
        else:
            raise ValueError(f"unknown clause {type(c).__name__}")
    return out


def from_dicts(clauses: Sequence[dict]) -> list[object]:
    """The clauses of :func:`to_dicts`; raises ValueError for an unknown kind or a missing part."""
    out = []
    for c in clauses:
        if not isinstance(c, dict) or len(c) != 1:
            raise ValueError("a clause has one kind")
        ((kind, x),) = c.items()
        try:
            out.append({
                "pattern": lambda: Pattern(x.get("entity", "?e"), x["attribute"], _read_term(x["value"])),  # noqa: B023
                "predicate": lambda: Predicate(_read_term(x["left"]), x["op"], _read_term(x["right"])),  # noqa: B023
                "or": lambda: Or([from_dicts(b) for b in x["branches"]]),  # noqa: B023
                "not": lambda: Not(from_dicts(x["body"])),  # noqa: B023
                "fulltext": lambda: FullText(x["query"], x.get("attribute") or None),  # noqa: B023
                "rule_call": lambda: RuleCall(x["var"], x["root"], x.get("name", "category-in-tree")),  # noqa: B023
            }[kind]())
        except KeyError as e:
            raise ValueError(f"unknown clause or missing part {e}") from None
    return out
