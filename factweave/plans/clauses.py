"""Composite queries over one document at a time: clauses and their compilation to Column expressions.

A clause list is compiled left to right with an environment of variables. A variable is a pair (is it bound, its value);
a value has one field per kind it can be of, so that comparisons of different kinds are decided without casts. A comparison
with nothing is false. At the top a filter sees to that, so there conditions stay as bare as a source can take them, and
comparisons of integers stay such; below Or and Not they are made two-valued.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WILDCARD = None


@dataclass(frozen=True)
class Lit:
    """A literal that would else read as a variable."""

    value: object


@dataclass(frozen=True)
class Pattern:
    """The attribute is there and equals ``value``: a literal, a ``?variable`` or WILDCARD. ``entity`` isn't looked at."""

    entity: str
    attr: str
    value: object = WILDCARD


@dataclass(frozen=True)
class Predicate:
    """``left op right``; an unknown operator is false."""

    left: object
    op: str
    right: object


@dataclass(frozen=True)
class Or:
    """The first branch that holds; what it binds stays bound."""

    branches: Sequence[Sequence[object]]


@dataclass(frozen=True)
class Not:
    """The clauses don't hold together; nothing they bind stays bound."""

    clauses: Sequence[object]


@dataclass(frozen=True)
class FullText:
    """``text``, whatever its case, is in the attribute, or in any if none is named; never for an empty text."""

    text: str
    attr: str | None = None


@dataclass(frozen=True)
class RuleCall:
    """``var`` is the root of a tree or the name of one of its descendants; ``name``: the rule that says so."""

    var: str
    root: str
    name: str = "category-in-tree"


@dataclass(frozen=True)
class Rule:
    """One definition of a rule."""

    name: str
    body: Sequence[object]


def check_rules(rules: Sequence[Rule], call: RuleCall, parent: str = ":category/parent") -> None:
    """Raises ValueError unless the call's rule walks a tree and the call gives a variable and a root.

    A walk has two definitions: one that steps along the ``parent`` attribute and calls the rule again, and one that doesn't.
    """
    if not is_var(call.var) or call.root is None or is_var(call.root):
        raise ValueError("a rule is called with a variable and a root")
    steps = [any(isinstance(c, Pattern) and c.attr == parent for c in r.body) and any(isinstance(c, RuleCall) and c.name == r.name for c in r.body) for r in rules if r.name == call.name]
    if sorted(steps) != [False, True]:
        raise ValueError(f"{call.name} isn't a walk of a tree")


@dataclass(frozen=True)
class Aggregate:
    """``fn`` of ``count sum total avg min max`` over a variable, as column ``name``."""

    fn: str
    over: str
    name: str


@dataclass(frozen=True)
class Value:
    """A value by kind; a field is None if it can't be of the kind, and NULL where it isn't. All NULL: null."""

    num: Column | None = None
    text: Column | None = None
    flag: Column | None = None
    items: Column | None = None  # the string elements of a list
    whole: Column | None = None  # a list or object as canonical JSON
    integer: Column | None = None  # the number as it is stored, if only integers are
    solid: bool = False  # wherever it is there, it isn't null

    FIELDS = ("num", "text", "flag", "items", "whole")

    def out(self) -> Column:
        """As one column: of its kind, or JSON text if several are possible."""
        have = [getattr(self, f) for f in ("num", "text", "flag", "whole") if getattr(self, f) is not None]
        return F.lit(None).cast("string") if not have else have[0] if len(have) == 1 else F.coalesce(*[c.cast("string") for c in have])

    def is_nil(self) -> Column:
        have = [getattr(self, f) for f in ("num", "text", "flag", "whole") if getattr(self, f) is not None]
        return reduce(lambda a, b: a & b, [c.isNull() for c in have], F.lit(True))


NOTHING = Value()


def literal(value) -> Value:
    value = value.value if isinstance(value, Lit) else value
    if value is None:
        return NOTHING
    if isinstance(value, bool):
        return Value(flag=F.lit(value))
    if isinstance(value, (int, float)):
        return Value(num=F.lit(float(value)))
    if isinstance(value, str):
        return Value(text=F.lit(value))
    raise ValueError(f"a literal can't be a {type(value).__name__}")


def typed(column: Column, kind: str) -> Value:
    """The value of a typed column; ``kind`` is its Spark type."""
    if kind.startswith("array<"):
        return Value(items=column.cast("array<string>") if kind == "array<string>" else None, whole=F.to_json(column))
    if kind == "boolean":
        return Value(flag=column, solid=True)
    if kind == "string":
        return Value(text=column, solid=True)
    return Value(num=column.cast("double"), integer=column if kind in ("tinyint", "smallint", "int", "bigint") else None, solid=True)


def in_json(variant: Column, attr: str) -> tuple[Column, Value]:
    """(presence, value) of a top-level attribute of a parsed body. JSON null is present."""
    path = "$['" + attr.replace("'", "\\'") + "']"
    v = F.try_variant_get(variant, path, "variant")
    kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
    number = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|DOUBLE|FLOAT)")
    nested = kind.startswith("ARRAY") | kind.startswith("OBJECT")
    listed = F.when(kind.startswith("ARRAY"), v.cast("array<variant>"))
    return v.isNotNull(), Value(
        num=F.when(number, F.try_variant_get(v, "$", "double")), text=F.when(kind == "STRING", F.try_variant_get(v, "$", "string")),
        flag=F.when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean")), whole=F.when(nested, F.to_json(v)),
        items=F.transform(F.filter(listed, lambda x: F.schema_of_variant(x) == "STRING"), lambda x: F.try_variant_get(x, "$", "string")))


def top_level(variant: Column) -> Column:
    """The attributes of a parsed body as a map from names to variants; NULL for what is no object."""
    return F.try_variant_get(variant, "$", "map<string,variant>")


def any_text_in_json(variant: Column, test) -> Column:
    """Whether a string, or a string element of a list, among the top-level values of a parsed body passes ``test``."""
    text = lambda v: sure(test(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))))
    listed = lambda v: F.when(F.schema_of_variant(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>"))
    return sure(F.exists(F.map_values(top_level(variant)), lambda v: text(v) | sure(F.exists(listed(v), text))))


@dataclass(frozen=True)
class Facts:
    """Documents of one tenant: a DataFrame, its id column, and its attributes as typed columns or in a parsed body."""

    df: DataFrame
    doc_id: str
    columns: dict[str, Column] = field(default_factory=dict)
    variant: Column | None = None

    def attribute(self, name: str) -> tuple[Column, Value]:
        if name in self.columns:
            c = self.columns[name]
            return c.isNotNull(), typed(c, self.df.select(c.alias("x")).dtypes[0][1])
        if self.variant is not None:
            return in_json(self.variant, name)
        return F.lit(False), NOTHING

    def entity(self) -> Value:
        c = F.col(self.doc_id)
        if dict(self.df.dtypes)[self.doc_id] != "string":
            return Value(num=c.cast("double"))
        whole = F.when(c.rlike(r"^[+-]?\d+$"), c.try_cast("bigint")).cast("double")
        return Value(num=whole, text=F.when(whole.isNull(), c))


def sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def equal(a: Value, b: Value) -> Column:
    """Same kind and value, numbers as doubles; null equals null only; lists and objects by structure."""
    tests = [sure(getattr(a, f) == getattr(b, f)) for f in ("num", "text", "flag", "whole") if getattr(a, f) is not None and getattr(b, f) is not None]
    return reduce(lambda x, y: x | y, tests, a.is_nil() & b.is_nil())


#: Variables by name: whether it is bound (True, or a condition) and to what.
Env = dict[str, tuple[Column | bool, Value]]


def is_var(term) -> bool:
    return isinstance(term, str) and term.startswith("?")


def bound_value(env: Env, var: str) -> Value:
    """The value of a variable; nothing where it isn't bound."""
    bound, value = env.get(var, (False, NOTHING))
    if bound is True:
        return value
    return NOTHING if bound is False else Value(**{f: F.when(bound, getattr(value, f)) for f in Value.FIELDS if getattr(value, f) is not None})


def _operand(term, env: Env) -> Value:
    return bound_value(env, term) if is_var(term) else literal(term)


def _plain(term):
    return term.value if isinstance(term, Lit) else term


def _is_number(term) -> bool:
    return isinstance(term, (int, float)) and not isinstance(term, bool)


def _compare(value: Value, op: str, number: float) -> Column:
    """A comparison with a number; of integers with one that a double holds exactly, as integers."""
    if value.num is None:
        return F.lit(False)
    if value.integer is None or not abs(number) < 2**53:
        return _ORDER[op](value.num, F.lit(float(number)))
    if op == "==":
        return value.integer == int(number) if number == int(number) else F.lit(False)
    return _ORDER[op](value.integer, math.ceil(number) if op in ("<", ">=") else math.floor(number))


def _is(value: Value, wanted) -> Column:
    """Whether a value is a literal; NULL says no as well."""
    if wanted is None:
        return value.is_nil()
    if _is_number(wanted):
        return _compare(value, "==", wanted)
    have = value.flag if isinstance(wanted, bool) else value.text
    literal(wanted)  # raises for what can't be one
    return F.lit(False) if have is None else have == F.lit(wanted)


def _isnt(value: Value, wanted) -> Column:
    """The opposite of :func:`_is`, never NULL or, for values that can't be null, as bare as that."""
    return ~_is(value, wanted) if value.solid and wanted is not None else ~sure(_is(value, wanted))


def _texts(value: Value, test) -> Column:
    tests = [test(value.text)] if value.text is not None else []
    tests += [F.exists(value.items, test)] if value.items is not None else []
    return tests[0] if len(tests) == 1 else reduce(lambda a, b: a | b, map(sure, tests), F.lit(False))


_ORDER = {"==": lambda a, b: a == b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_FLIP = {"==": "==", "!=": "!=", "<": ">", "<=": ">=", ">": "<", ">=": "<="}
_TEXT = {"starts_with": "startswith", "ends_with": "endswith", "contains": "contains"}


def _predicate(p: Predicate, env: Env) -> Column:
    left, op, right = p.left, p.op, p.right
    if op in _FLIP and not is_var(left):
        left, op, right = right, _FLIP[op], left
    a, literal_ = _operand(left, env), not is_var(right)
    if op in ("==", "!="):
        if literal_:
            return (_is if op == "==" else _isnt)(a, _plain(right))
        return equal(a, _operand(right, env)) if op == "==" else ~equal(a, _operand(right, env))
    if op in _ORDER:
        if literal_:
            return _compare(a, op, _plain(right)) if _is_number(_plain(right)) else F.lit(False)
        b = _operand(right, env)
        return F.lit(False) if a.num is None or b.num is None else _ORDER[op](a.num, b.num)
    b = _operand(right, env)
    if op in _TEXT and b.text is not None:
        return _texts(a, lambda x: getattr(x, _TEXT[op])(_plain(right) if literal_ else b.text))
    return F.lit(False)


def all_of(tests: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def compile_clauses(clauses: Sequence[object], facts: Facts, env: Env, calls: list[tuple[RuleCall, Value]] | None = None) -> tuple[list[Column], Env]:
    """(conditions that must all hold, where NULL says no; the variables after the clauses).

    A rule call becomes the column ``__rule_i``, and the call and the value of its variable are put at place i of ``calls``.
    """
    tests: list[Column] = []
    for c in clauses:
        if isinstance(c, Pattern):
            if not c.attr:
                tests.append(F.lit(False))
                continue
            present, value = facts.attribute(c.attr)
            if is_var(c.value):
                tests.append(present)
                if c.value in env:
                    bound, old = env[c.value]
                    same = equal(old, value)
                    if bound is True:
                        tests.append(same)
                        continue
                    tests.append(~bound | same)
                    both = {f: (getattr(old, f), getattr(value, f)) for f in Value.FIELDS}
                    env = env | {c.value: (True, Value(**{f: F.when(bound, _or_null(x, y)).otherwise(_or_null(y, x)) for f, (x, y) in both.items() if x is not None or y is not None}))}
                else:
                    env = env | {c.value: (True, value)}
            elif c.value is WILDCARD:
                tests.append(present)
            else:
                tests += [_is(value, _plain(c.value))] if value.solid else [present, _is(value, _plain(c.value))]
        elif isinstance(c, Predicate):
            tests.append(_predicate(c, env))
        elif isinstance(c, Or):
            done = [(sure(all_of(t)), e) for t, e in (compile_clauses(b, facts, env, calls) for b in c.branches)]
            tests.append(reduce(lambda a, b: a | b, [o for o, _ in done], F.lit(False)))
            new = dict(env)
            for name in dict.fromkeys(v for _, e in done for v in e):
                if all(e.get(name) is env.get(name) for _, e in done):
                    continue
                own = [(o, e.get(name, (False, NOTHING))) for o, e in done]
                fields = [f for f in Value.FIELDS if any(getattr(v, f) is not None for _, (_, v) in own)]
                is_bound = _first([(o, F.lit(b) if isinstance(b, bool) else b) for o, (b, _) in own])
                new[name] = (sure(is_bound), Value(**{f: _first([(o, _or_null(getattr(v, f), next(getattr(w, f) for _, (_, w) in own if getattr(w, f) is not None))) for o, (_, v) in own]) for f in fields}))
            env = new
        elif isinstance(c, Not):
            tests.append(~sure(all_of(compile_clauses(c.clauses, facts, env, calls)[0])))
        elif isinstance(c, FullText):
            names = [c.attr] if c.attr else list(facts.columns)
            has = lambda x: F.lower(x).contains(F.lower(F.lit(c.text)))  # noqa: B023, E731
            anywhere = [sure(_texts(facts.attribute(n)[1], has)) for n in names]
            if not c.attr and facts.variant is not None:
                anywhere.append(any_text_in_json(facts.variant, has))
            tests.append(reduce(lambda a, b: a | b, anywhere, F.lit(False)) if c.text else F.lit(False))
        elif isinstance(c, RuleCall):
            if calls is None:
                raise ValueError("a rule call can't be made here")
            calls.append((c, bound_value(env, c.var)))
            tests.append(F.col(f"__rule_{len(calls) - 1}").isNotNull())
        else:
            raise ValueError(f"unknown clause {type(c).__name__}")
    return tests, env


def _or_null(a: Column | None, like: Column | None) -> Column:
    return a if a is not None else F.when(F.lit(False), like)


def _first(cases: list[tuple[Column, Column]]) -> Column:
    out = F.when(cases[0][0], cases[0][1])
    for test, value in cases[1:]:
        out = out.when(test, value)
    return out


def anchors(clauses: Sequence[object]) -> list[Pattern]:
    """Top-level patterns with an attribute and a literal."""
    return [c for c in clauses if isinstance(c, Pattern) and c.attr and not is_var(c.value) and c.value is not WILDCARD]


def narrowed(clauses: Sequence[object]) -> list[object] | None:
    """The clauses with one interval for each variable in place of its numeric comparisons; None if one is empty.

    Only comparisons at the top with a number, of variables that a pattern before them has bound, are merged: before that they
    are false. Catalyst would keep all filters, contradicting ones too.
    """
    first = {}
    for i, c in enumerate(clauses):
        if isinstance(c, Pattern) and c.attr and is_var(c.value):
            first.setdefault(c.value, i)
    low: dict[str, tuple[float, bool]] = {}
    high: dict[str, tuple[float, bool]] = {}
    rest, last = [], {}
    for i, c in enumerate(clauses):
        if isinstance(c, Predicate) and c.op in _FLIP and c.op != "!=":
            var, op, number = (c.left, c.op, _plain(c.right)) if is_var(c.left) else (c.right, _FLIP[c.op], _plain(c.left))
            if is_var(var) and _is_number(number) and number == number and first.get(var, i) < i:
                if op in (">", ">=", "=="):
                    low[var] = max(low.get(var, (-math.inf, False)), (number, op == ">"))
                if op in ("<", "<=", "=="):
                    high[var] = min(high.get(var, (math.inf, True)), (number, op != "<"))
                last[var] = len(rest)
                rest.append(None)
                continue
        rest.append(c)
    for var, at in last.items():
        (lo, open_low), (hi, closed_high) = low.get(var, (None, False)), high.get(var, (None, True))
        if lo is not None and hi is not None and (lo > hi or (lo == hi and (open_low or not closed_high))):
            return None
        if lo is not None and lo == hi:
            rest[at] = [Predicate(var, "==", lo)]
        else:
            rest[at] = [Predicate(var, ">" if open_low else ">=", lo)] * (lo is not None) + [Predicate(var, "<=" if closed_high else "<", hi)] * (hi is not None)
    return [x for c in rest if c is not None for x in (c if isinstance(c, list) else [c])]


__all__ = [n for n in dir() if n[0].isupper()] + ["anchors", "all_of", "bound_value", "check_rules", "compile_clauses", "is_var", "narrowed", "top_level"]
