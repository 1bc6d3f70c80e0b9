"""Productions as data: what the DSL and JSON definitions both produce and the operators turn into DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

COMPARISONS = ("eq", "neq", "lt", "lte", "gt", "gte")
ARITHMETIC = ("add", "sub", "mul", "div")


class Node:
    """Part of a condition."""

    def __and__(self, other: "Node") -> "All":
        return All(tuple(p for x in (self, other) for p in (x.parts if isinstance(x, All) else (x,))))

    def __or__(self, other: "Node") -> "Any":
        return Any(tuple(p for x in (self, other) for p in (x.parts if isinstance(x, Any) else (x,))))


@dataclass(frozen=True)
class All(Node):
    parts: tuple[Node, ...]


@dataclass(frozen=True)
class Any(Node):
    parts: tuple[Node, ...]


class Value:
    """A value in a condition: a property, an item of an array, a constant or arithmetic over them."""

    def _with(self, op: str, other: object) -> "Arith":
        return Arith(op, self, constant(other))

    def __add__(self, other):
        return self._with("add", other)

    def __sub__(self, other):
        return self._with("sub", other)

    def __mul__(self, other):
        return self._with("mul", other)

    def __truediv__(self, other):
        return self._with("div", other)

    def _compare(self, op: str, other: object) -> "Compare":
        return Compare(op, self, constant(other))

    def __eq__(self, other):  # type: ignore[override]
        return self._compare("eq", other)

    def __ne__(self, other):  # type: ignore[override]
        return self._compare("neq", other)

    def __lt__(self, other):
        return self._compare("lt", other)

    def __le__(self, other):
        return self._compare("lte", other)

    def __gt__(self, other):
        return self._compare("gt", other)

    def __ge__(self, other):
        return self._compare("gte", other)

    __hash__ = object.__hash__


@dataclass(frozen=True, eq=False)
class Const(Value):
    value: object


def constant(x: object) -> Value:
    return x if isinstance(x, Value) else Const(x)


@dataclass(frozen=True, eq=False)
class Arith(Value):
    op: str
    left: Value
    right: Value


@dataclass(frozen=True, eq=False)
class Prop(Value):
    """A property of a message. alias: None for the pattern's own message, `s` for the context state, `item` for an array's item."""

    alias: str | None
    name: str = ""

    def __getattr__(self, name: str) -> "Prop":
        if name.startswith("__"):
            raise AttributeError(name)
        return Prop(self.alias, f"{self.name}.{name}" if self.name else name)

    def __getitem__(self, name: str) -> "Prop":
        return Prop(self.alias, f"{self.name}.{name}" if self.name else name)

    def __pos__(self) -> "Exists":
        return Exists(self)

    def __neg__(self) -> "Exists":
        return Exists(self, False)

    def matches(self, pattern: str) -> "Match":
        return Match(self, pattern, False)

    def imatches(self, pattern: str) -> "Match":
        return Match(self, pattern, True)

    def allItems(self, condition: Node) -> "Quantified":  # noqa: N802
        return Quantified("all", self, condition)

    def anyItem(self, condition: Node) -> "Quantified":  # noqa: N802
        return Quantified("any", self, condition)


@dataclass(frozen=True, eq=False)
class Compare(Node):
    op: str
    left: Value
    right: Value


@dataclass(frozen=True, eq=False)
class Exists(Node):
    prop: Prop
    present: bool = True


@dataclass(frozen=True, eq=False)
class Match(Node):
    prop: Prop
    pattern: str
    ignore_case: bool


@dataclass(frozen=True, eq=False)
class Quantified(Node):
    kind: str
    prop: Prop
    condition: Node


@dataclass(frozen=True, eq=False)
class Pattern:
    """A message that must exist, or with negated none that may; on_state: the message is the context state."""

    alias: str
    condition: Node
    negated: bool = False
    on_state: bool = False

    def __and__(self, other: Node) -> "Pattern":
        return replace(self, condition=self.condition & other)

    def __or__(self, other: Node) -> "Pattern":
        return replace(self, condition=self.condition | other)


@dataclass(frozen=True, eq=False)
class Group:
    kind: str  # all or any
    alias: str
    elements: tuple["Pattern | Group", ...]


@dataclass(frozen=True)
class Rule:
    name: str
    when: Group
    pri: int = 0
    count: int | None = None
    cap: int | None = None
    distinct: bool = True
    run: Callable | str | None = field(default=None, compare=False)


def values(x: Node | Value) -> Iterator[Value]:
    """All values in a condition, those of nested ones included."""
    if isinstance(x, (All, Any)):
        for p in x.parts:
            yield from values(p)
    elif isinstance(x, (Compare, Arith)):
        yield from values(x.left)
        yield from values(x.right)
    elif isinstance(x, (Exists, Match)):
        yield x.prop
    elif isinstance(x, Quantified):
        yield x.prop
        yield from values(x.condition)
    elif isinstance(x, Value):
        yield x


def aliases(x: Node | Value) -> set[str]:
    """Aliases of other messages that a condition refers to."""
    return {v.alias for v in values(x) if isinstance(v, Prop) and v.alias not in (None, "item")}


def own_names(x: Node | Value) -> set[str]:
    return {v.name for v in values(x) if isinstance(v, Prop) and v.alias is None}


def names_of(x: Node | Value, alias: str) -> set[str]:
    return {v.name for v in values(x) if isinstance(v, Prop) and v.alias == alias}


def patterns(g: Group) -> Iterator[Pattern]:
    for e in g.elements:
        if isinstance(e, Group):
            yield from patterns(e)
        else:
            yield e


def named(elements: tuple, prefix: str = "") -> tuple:
    """Elements with names: `m` for a single unnamed pattern, m_0, m_1, ... for several; those in groups after the group's."""
    out = []
    for k, e in enumerate(elements):
        alias = e.alias or ("m" if len(elements) == 1 and isinstance(e, Pattern) else f"m_{k}")
        alias = f"{prefix}{alias}"
        out.append(replace(e, alias=alias, elements=named(e.elements, f"{alias}.")) if isinstance(e, Group) else replace(e, alias=alias))
    return tuple(out)


class RuleError(ValueError):
    """A definition that is not valid."""


def checked(rule: Rule) -> Rule:
    """The rule, if its settings and references are valid."""
    for name in ("pri", "count", "cap"):
        v = getattr(rule, name)
        if v is not None and (not isinstance(v, int) or isinstance(v, bool)):
            raise RuleError(f"{rule.name}: {name} must be an integer")
    if rule.count is not None and rule.cap is not None:
        raise RuleError(f"{rule.name}: count and cap exclude each other")
    if any(v is not None and v < 1 for v in (rule.count, rule.cap)):
        raise RuleError(f"{rule.name}: count and cap must be positive")
    if rule.when.kind not in ("all", "any") or not rule.when.elements:
        raise RuleError(f"{rule.name}: needs all or any of some patterns")

    def walk(g: Group, known: set[str]) -> None:
        seen = set(known)
        for e in g.elements:
            if e.alias in seen - known:
                raise RuleError(f"{rule.name}: {e.alias} is used twice")
            if isinstance(e, Group):
                walk(e, seen)
                seen |= {p.alias for p in patterns(e)} | {e.alias}
                continue
            if missing := aliases(e.condition) - seen - {"s"}:
                raise RuleError(f"{rule.name}: {e.alias} refers to {', '.join(sorted(missing))}, which no earlier pattern names")
            for q in quantified(e.condition):
                if aliases(q.condition):
                    raise RuleError(f"{rule.name}: a condition on items refers to another message")
            if not e.negated:
                seen.add(e.alias)

    walk(rule.when, set())
    return rule


def quantified(x: Node) -> Iterator[Quantified]:
    if isinstance(x, (All, Any)):
        for p in x.parts:
            yield from quantified(p)
    elif isinstance(x, Quantified):
        yield x
        yield from quantified(x.condition)
