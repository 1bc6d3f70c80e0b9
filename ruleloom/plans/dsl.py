"""Productions in Python.

    with ruleset("risk") as r:
        when_all(c.first << (m.event_type == "purchase"), c.second << (m.value > c.first.value * 2), name="fraud")

m is the pattern's own message, s the context state, item an item of an array; c names patterns and refers to them.
A rule may also decorate a function, which becomes its action.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from ruleloom.plans.ir import All, Compare, Const, Group, Node, Pattern, Prop, Rule, RuleError, Value, checked, named, patterns, values

_open: list["RuleSet"] = []


class RuleSet:
    """Named productions in order of definition."""

    def __init__(self, name: str, productions: list[Rule] | None = None):
        self.name, self.productions = name, list(productions or [])

    def __enter__(self) -> "RuleSet":
        _open.append(self)
        return self

    def __exit__(self, *_) -> None:
        _open.remove(self)

    def add(self, rule: Rule) -> Rule:
        if any(r.name == rule.name for r in self.productions):
            raise RuleError(f"{self.name}: rule {rule.name} is defined twice")
        self.productions.append(checked(rule))
        return rule

    def rule(self, name: str) -> Rule:
        return next(r for r in self.productions if r.name == name)

    def __iter__(self):
        return iter(self.productions)


def ruleset(name: str) -> RuleSet:
    return RuleSet(name)


class Tagged:
    """The start of a named pattern's condition: c.first << m.x, before it is compared with something."""

    def __init__(self, alias: str, value: Value):
        self._alias, self._value = alias, value

    def _pattern(self, x) -> Pattern:
        return replace(element(x), alias=self._alias)

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        if name in ("matches", "imatches", "allItems", "anyItem"):
            return lambda x: self._pattern(getattr(self._value, name)(x))
        return Tagged(self._alias, getattr(self._value, name))


def _lift(name: str, made: bool) -> None:
    def method(self, *args):
        x = getattr(self._value, name)(*args)
        return self._pattern(x) if made else Tagged(self._alias, x)

    setattr(Tagged, name, method)


for _name in ("__eq__", "__ne__", "__lt__", "__le__", "__gt__", "__ge__", "__pos__", "__neg__"):
    _lift(_name, True)
for _name in ("__add__", "__sub__", "__mul__", "__truediv__"):
    _lift(_name, False)


class Named:
    """c.first: names a pattern with <<, and refers to its message."""

    def __init__(self, alias: str):
        self._alias = alias

    def __lshift__(self, other):
        if isinstance(other, Value):
            return Tagged(self._alias, other)  # << binds closer than a comparison
        return replace(element(other), alias=self._alias)

    def __getattr__(self, name: str) -> Prop:
        if name.startswith("_"):
            raise AttributeError(name)
        return Prop("s" if self._alias == "s" else self._alias, name)

    def __getitem__(self, name: str) -> Prop:
        return Prop(self._alias, name)


class Names:
    def __getattr__(self, name: str) -> Named:
        if name.startswith("__"):
            raise AttributeError(name)
        return Named(name)


m, item, c = Prop(None), Prop("item"), Names()
#: a condition on s is one on the context state's row; in another pattern's condition it refers to that row
s = Prop("s")


def element(x) -> Pattern | Group:
    if isinstance(x, (Pattern, Group)):
        return x
    if not isinstance(x, Node):
        raise RuleError(f"no condition: {x!r}")
    mine = {v.alias for v in values(x) if isinstance(v, Prop)}
    if mine <= {"s"} and mine:
        return Pattern("", own_state(x), on_state=True)
    return Pattern("", x)


def own_state(x):
    """A condition on the state alone, as one on the state's own row."""
    if isinstance(x, Prop):
        return Prop(None, x.name) if x.alias == "s" else x
    if hasattr(x, "parts"):
        return replace(x, parts=tuple(own_state(p) for p in x.parts))
    fields = {k: own_state(v) for k, v in x.__dict__.items() if isinstance(v, (Node, Prop)) or hasattr(v, "left")}
    return replace(x, **fields) if fields else x


def all_(*xs) -> Group:
    return Group("all", "", tuple(map(element, xs)))


def any_(*xs) -> Group:
    return Group("any", "", tuple(map(element, xs)))


def none_(x) -> Pattern:
    return replace(element(x), negated=True)


def timeout(name: str) -> Group:
    """A timer of this name whose time has come on the clock."""
    base = Pattern("base", Compare("eq", Prop(None, "timer_name"), Const(name)))
    clock = Pattern("timeout", Compare("gte", Prop(None, "time"), Prop("base", "base_time")))
    return Group("all", "", (base, clock))


class Setting:
    def __init__(self, **kw):
        self.kw = kw


def pri(n: int) -> Setting:
    return Setting(pri=n)


def count(n: int) -> Setting:
    return Setting(count=n)


def cap(n: int) -> Setting:
    return Setting(cap=n)


def distinct(on: bool) -> Setting:
    return Setting(distinct=on)


def prefixed_references(elements: tuple, names: dict[str, str]) -> tuple:
    """References to patterns by their short names, as references to their full ones within groups."""

    def fix(x):
        if isinstance(x, Prop):
            return Prop(names.get(x.alias, x.alias), x.name)
        if hasattr(x, "parts"):
            return replace(x, parts=tuple(fix(p) for p in x.parts))
        fields = {k: fix(v) for k, v in x.__dict__.items() if isinstance(v, (Node, Prop)) or hasattr(v, "left")}
        return replace(x, **fields) if fields else x

    out = []
    for e in elements:
        if isinstance(e, Group):
            inner = names | {p.alias.rsplit(".", 1)[-1]: p.alias for p in e.elements}
            out.append(replace(e, elements=prefixed_references(e.elements, inner)))
            names = {p.alias.rsplit(".", 1)[-1]: p.alias for p in patterns(e) if not p.negated} | names  # later elements see its messages
        else:
            out.append(replace(e, condition=fix(e.condition)))
    return tuple(out)


def define(kind: str, args: tuple, name: str | None, run: Callable | None = None) -> Rule:
    settings: dict = {}
    elements = []
    for a in args:
        if isinstance(a, Setting):
            settings |= a.kw
        else:
            elements.append(element(a))
    full = prefixed_references(named(tuple(elements)), {})
    where = _open[-1] if _open else None
    rule = Rule(name or f"r_{len(where.productions) if where else 0}", Group(kind, "", full), run=run, **settings)
    return where.add(rule) if where else checked(rule)


class Definition:
    """A rule that was defined, and a decorator that gives it an action."""

    def __init__(self, kind: str, args: tuple, name: str | None):
        self.where = _open[-1] if _open else None
        self.rule = define(kind, args, name)

    def __call__(self, f: Callable) -> Callable:
        new = replace(self.rule, run=f)
        if self.where:
            self.where.productions[self.where.productions.index(self.rule)] = new
        self.rule = new
        f.rule = new
        return f


def when_all(*args, name: str | None = None) -> Definition:
    return Definition("all", args, name)


def when_any(*args, name: str | None = None) -> Definition:
    return Definition("any", args, name)


__all__ = ["All", "RuleSet", "all_", "any_", "c", "cap", "count", "distinct", "item", "m", "none_", "pri", "ruleset", "s", "timeout", "when_all", "when_any"]
