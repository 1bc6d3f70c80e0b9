"""Rule definitions as JSON objects, to productions and back.

    {"suspect": {"all": [{"first": {"t": "purchase"}}, {"second": {"$neq": {"location": {"first": "location"}}}}], "run": "unit"}}

A name that ends in $state or $flow holds a chart instead.
"""

from __future__ import annotations

from collections.abc import Callable

from ruleloom.operators.flow import Chart, Trigger
from ruleloom.plans.dsl import RuleSet, own_state
from ruleloom.plans.ir import ARITHMETIC, COMPARISONS, All, Any, Arith, Compare, Const, Exists, Group, Match, Node, Pattern, Prop, Quantified, Rule, RuleError, Value, checked, named, values

SETTINGS = {"pri": "pri", "count": "count", "cap": "cap", "dist": "distinct"}


def value(x: object, item: bool) -> Value:
    if not isinstance(x, dict):
        return Const(x)
    if len(x) != 1:
        raise RuleError(f"no value: {x}")
    (key, v), *_ = x.items()
    if key[:1] == "$" and key[1:] in ARITHMETIC:
        return Arith(key[1:], value(v["$l"], item), value(v["$r"], item))
    if key == "$m":
        return Prop(None, v)
    if key == "$i":
        return Prop("item", v)
    return Prop(key, v)


def prop(name: str, item: bool) -> Prop:
    """A property's name; $i and $i.x are an item and its property."""
    if name == "$i" or name.startswith("$i."):
        return Prop("item", name[3:])
    return Prop(None, name)


def expression(x: dict, item: bool = False) -> Node:
    """A condition: {prop: value} or {op: {prop: value}}; several entries hold together."""
    parts: list[Node] = []
    for key, v in x.items():
        if key == "$and":
            parts.append(All(tuple(expression(e, item) for e in v)))
        elif key == "$or":
            parts.append(Any(tuple(expression(e, item) for e in v)))
        elif key == "$s":
            continue
        elif key == "$t":
            parts.append(Compare("eq", Prop(None, "timer_name"), Const(v)))
        elif key in ("$ex", "$nex"):
            parts += [Exists(prop(p, item), key == "$ex") for p in v]
        elif key in ("$mt", "$imt"):
            parts += [Match(prop(p, item), e, key == "$imt") for p, e in v.items()]
        elif key in ("$iall", "$iany"):
            parts += [Quantified(key[2:], prop(p, item), expression(e, True)) for p, e in v.items()]
        elif key[:1] == "$" and key[1:] in COMPARISONS:
            parts += [Compare(key[1:], prop(p, item), value(e, item)) for p, e in v.items()]
        elif key[:1] == "$" and key not in ("$i",) and not key.startswith("$i."):
            raise RuleError(f"no operator {key}")
        else:
            parts.append(Compare("eq", prop(key, item), value(v, item)))
    if not parts:
        raise RuleError(f"no condition: {x}")
    return parts[0] if len(parts) == 1 else All(tuple(parts))


def on_state(x: object) -> bool:
    """Whether a condition is one on the context's state."""
    if isinstance(x, dict):
        return "$s" in x or any(on_state(v) for k, v in x.items() if k in ("$and", "$or"))
    return isinstance(x, list) and any(on_state(v) for v in x)


def elements(items: list) -> tuple:
    out = []
    for e in items:
        if not isinstance(e, dict) or len(e) != 1:
            raise RuleError(f"a pattern has one name: {e}")
        (alias, body), *_ = e.items()
        base, _, kind = alias.partition("$")
        if kind in ("all", "any"):
            out.append(Group(kind, base, elements(body)))
        elif kind in ("", "not"):
            out.append(Pattern(base, expression(body), kind == "not", on_state(body)))
        else:
            raise RuleError(f"no kind of pattern: {alias}")
    return tuple(out)


def rule(name: str, x: dict, actions: dict[str, Callable] | None = None) -> Rule:
    kinds = [k for k in ("all", "any") if k in x]
    if len(kinds) != 1:
        raise RuleError(f"{name}: needs all or any")
    if unknown := set(x) - {*kinds, *SETTINGS, "run"}:
        raise RuleError(f"{name}: {', '.join(sorted(unknown))} is no setting")
    settings = {SETTINGS[k]: x[k] for k in SETTINGS if k in x}
    if "distinct" in settings:
        settings["distinct"] = bool(settings["distinct"])
    run = x.get("run")
    return checked(Rule(name, Group(kinds[0], "", named(elements(x[kinds[0]]))), run=(actions or {}).get(run, run) if isinstance(run, str) else run, **settings))


def ruleset(name: str, x: dict, actions: dict[str, Callable] | None = None) -> RuleSet | Chart:
    """A rule set, or a chart if the name says so."""
    if name.endswith(("$state", "$flow")):
        return chart(name.partition("$")[0], x, actions=actions)
    out = RuleSet(name)
    for n, r in x.items():
        out.add(rule(n, r, actions))
    return out


def chart(name: str, x: dict, under: str = "", actions: dict[str, Callable] | None = None) -> Chart:
    out = Chart(name)

    def add(states: dict, prefix: str) -> None:
        for s, triggers in states.items():
            made = []
            for n, t in triggers.items():
                if n in ("$chart", "run", "to") and not (n == "to" and isinstance(t, dict)):
                    if n == "to":
                        made.append(Trigger(t, None, 0, f"{prefix}{s}->{t}"))
                    continue
                when = t.get("all") or t.get("any")
                if when is None:
                    made.append(Trigger(t.get("to", n), expression(t) if set(t) - {"to", "run", "pri"} else None, t.get("pri", 0), n))
                    continue
                body = rule(n, {k: v for k, v in t.items() if k not in ("to", "run")})
                only = body.when.elements[0]
                single = len(body.when.elements) == 1 and isinstance(only, Pattern) and not only.negated and not only.on_state and body.count is None and body.cap is None
                made.append(Trigger(t["to"], only.condition if single else body, t.get("pri", 0), n, (actions or {}).get(t.get("run"))))
            out.state(f"{prefix}{s}", *made)
            if "$chart" in triggers:
                add(triggers["$chart"], f"{prefix}{s}.")

    add(x, under)
    return out


def to_json(r: Rule) -> dict:
    """The rule as a JSON object that reads back as the same rule."""

    def rv(v: Value):
        if isinstance(v, Const):
            return v.value
        if isinstance(v, Prop):
            return {"$m" if v.alias is None else "$i" if v.alias == "item" else v.alias: v.name}
        return {f"${v.op}": {"$l": rv(v.left), "$r": rv(v.right)}}

    def name(p: Prop) -> str:
        return p.name if p.alias is None else f"$i.{p.name}" if p.name else "$i"

    def node(n: Node) -> dict:
        if isinstance(n, (All, Any)):
            return {"$and" if isinstance(n, All) else "$or": [node(p) for p in n.parts]}
        if isinstance(n, Compare):
            if not isinstance(n.left, Prop):
                raise RuleError("JSON has properties on the left only")
            return {name(n.left): rv(n.right)} if n.op == "eq" else {f"${n.op}": {name(n.left): rv(n.right)}}
        if isinstance(n, Exists):
            return {"$ex" if n.present else "$nex": {name(n.prop): 1}}
        if isinstance(n, Match):
            return {"$imt" if n.ignore_case else "$mt": {name(n.prop): n.pattern}}
        return {f"$i{n.kind}": {name(n.prop): node(n.condition)}}

    def element(e) -> dict:
        short = e.alias.rpartition(".")[2]
        if isinstance(e, Group):
            return {f"{short}${e.kind}": [element(x) for x in e.elements]}
        body = node(e.condition)
        return {short + "$not" * e.negated: {"$and": [body, {"$s": 1}]} if e.on_state else body}

    out: dict = {r.when.kind: [element(e) for e in r.when.elements]}
    out |= {k: v for k, v in (("pri", r.pri or None), ("count", r.count), ("cap", r.cap), ("dist", None if r.distinct else 0)) if v is not None}
    return out


__all__ = ["chart", "expression", "own_state", "rule", "ruleset", "to_json", "values"]
