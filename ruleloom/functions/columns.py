"""Conditions as Columns, with the productions' own sense of missing values, null and mixed types.

A message is a row with typed columns, or one with a VARIANT column. A comparison holds only if its property is
present; null equals null alone; int, double and bool compare as numbers; a string compares with anything else as text.
Typed columns keep their types at planning time, so their conditions are plain comparisons that reach the scan; a
VARIANT value is asked for its type in the row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleloom.functions.patterns import matched
from ruleloom.plans.ir import All, Any, Arith, Compare, Const, Exists, Match, Node, Prop, Quantified, RuleError, Value

NUMBERS = ("bool", "int", "double")
OPS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda a, b: a == b,
    "neq": lambda a, b: a != b,
    "lt": lambda a, b: a < b,
    "lte": lambda a, b: a <= b,
    "gt": lambda a, b: a > b,
    "gte": lambda a, b: a >= b,
}


def kind_of(t: T.DataType) -> str:
    """The productions' type of a Spark type."""
    if isinstance(t, T.StringType):
        return "string"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int"
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return "double"
    if isinstance(t, T.ArrayType):
        return "array"
    if isinstance(t, T.VariantType):
        return "variant"
    if isinstance(t, T.NullType):
        return "nil"
    return "other"


@dataclass
class Operand:
    """A value with its type: one kind if it is known at planning time, else a Column that tells it."""

    kind: str
    col: Column
    data_type: T.DataType | None = None
    #: of a VARIANT value: nil, bool, int, double, string, other; NULL if missing
    told: Column | None = None

    @property
    def number(self) -> Column:
        if self.kind == "variant":
            v = self.col
            return F.when(self.told == "bool", F.try_variant_get(v, "$", "boolean").cast("double")).when(self.told.isin("int", "double"), F.try_variant_get(v, "$", "double"))
        return self.col.cast("int") if self.kind == "bool" else self.col

    @property
    def text(self) -> Column:
        """Ints as they are, doubles with six decimals, bools as true and false, null as nil."""
        if self.kind == "variant":
            v, six = self.col, F.format_string("%f", F.try_variant_get(self.col, "$", "double"))
            return F.when(self.told == "double", six).when(self.told == "nil", F.lit("nil")).otherwise(F.try_variant_get(v, "$", "string"))
        if self.kind == "double":
            return F.when(self.col.isNotNull(), F.format_string("%f", self.col.cast("double")))
        return F.lit("nil") if self.kind == "nil" else self.col.cast("string")


def variant_kind(v: Column) -> Column:
    t = F.schema_of_variant(v)
    return (
        F.when(v.isNull(), F.lit(None))
        .when(t == "VOID", "nil")
        .when(t == "BOOLEAN", "bool")
        .when(t.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), "int")
        .when(t.startswith("DECIMAL") | t.isin("DOUBLE", "FLOAT"), "double")
        .when(t == "STRING", "string")
        .when(t.startswith("ARRAY"), "array")
        .otherwise("other")
    )


def field_type(schema: T.DataType, name: str) -> T.DataType:
    for part in name.split("."):
        if not isinstance(schema, T.StructType) or part not in schema.names:
            raise RuleError(f"no property {name}")
        schema = schema[part].dataType
    return schema


@dataclass
class Scope:
    """Where values are found: `own` for the pattern's message, `others` by alias, `item` in a condition on items.

    Each is (schema, get), and get turns a property's name into a Column; a schema of None is a VARIANT message.
    """

    own: tuple[T.StructType | None, Callable[[str], Column]]
    others: dict[str, tuple[T.StructType | None, Callable[[str], Column]]]
    item: Operand | None = None

    def property(self, p: Prop) -> Operand:
        if p.alias == "item":
            if self.item is None:
                raise RuleError("item stands outside a condition on items")
            if not p.name:
                return self.item
            if self.item.kind == "variant":
                v = F.try_variant_get(self.item.col, f"$.{p.name}", "variant")
                return Operand("variant", v, told=variant_kind(v))
            if not isinstance(self.item.data_type, T.StructType):
                return Operand("other", F.lit(None))
            t = field_type(self.item.data_type, p.name)
            return Operand(kind_of(t), self.item.col[p.name] if "." not in p.name else nested(self.item.col, p.name), t)
        if p.alias is not None and p.alias not in self.others:
            raise RuleError(f"no message {p.alias}")
        schema, get = self.own if p.alias is None else self.others[p.alias]
        c = get(p.name)
        if schema is None:
            return Operand("variant", c, told=variant_kind(c))
        t = field_type(schema, p.name)
        return Operand(kind_of(t), c, t) if kind_of(t) != "variant" else Operand("variant", c, told=variant_kind(c))


def nested(c: Column, name: str) -> Column:
    for part in name.split("."):
        c = c.getField(part)
    return c


def operand(v: Value, scope: Scope) -> Operand:
    if isinstance(v, Const):
        x = v.value
        kind = "nil" if x is None else "bool" if isinstance(x, bool) else "int" if isinstance(x, int) else "double" if isinstance(x, float) else "string"
        return Operand(kind, F.lit(x))
    if isinstance(v, Prop):
        return scope.property(v)
    return arithmetic(v, scope)


def arithmetic(v: Arith, scope: Scope) -> Operand:
    """int and double as usual, int / int truncates, division by zero and strings give nothing; bool + is and, * is xor."""
    a, b = operand(v.left, scope), operand(v.right, scope)
    if a.kind == "variant" or b.kind == "variant":
        x, y = a.number if a.kind in ("variant", *NUMBERS) else F.lit(None), b.number if b.kind in ("variant", *NUMBERS) else F.lit(None)
        whole = (a.told == "int" if a.kind == "variant" else F.lit(a.kind == "int")) & (b.told == "int" if b.kind == "variant" else F.lit(b.kind == "int"))
        r = calculate(v.op, x.cast("double"), y.cast("double"))
        return Operand("double", F.when(whole & F.lit(v.op == "div"), F.when(r >= 0, F.floor(r)).otherwise(F.ceil(r)).cast("double")).otherwise(r))
    if a.kind == b.kind == "bool":
        made = {"add": a.col & b.col, "mul": a.col != b.col}.get(v.op)
        return Operand("bool", made if made is not None else F.lit(None).cast("boolean"))
    if a.kind not in NUMBERS or b.kind not in NUMBERS:
        return Operand("double", F.lit(None).cast("double"))
    if "double" in (a.kind, b.kind):
        return Operand("double", calculate(v.op, a.number.cast("double"), b.number.cast("double")))
    x, y = a.number.cast("long"), b.number.cast("long")
    if v.op == "div":
        # the smallest long divided by -1 has no place in a long
        return Operand("int", F.when((y == -1) & (x == F.lit(-(1 << 63))), None).otherwise(F.call_function("div", x, F.nullif(y, F.lit(0).cast("long")))))
    return Operand("int", calculate(v.op, x, y))


def calculate(op: str, x: Column, y: Column) -> Column:
    """Nothing where the result has no place in its type: such a condition does not hold."""
    return {"add": F.try_add, "sub": F.try_subtract, "mul": F.try_multiply, "div": F.try_divide}[op](x, y)


def compare(op: str, a: Operand, b: Operand) -> Column:
    """The comparison, NULL or false where it does not hold."""
    if "variant" in (a.kind, b.kind):
        ka, kb = (x.told if x.kind == "variant" else F.lit(x.kind) for x in (a, b))
        numbers = ka.isin(*NUMBERS) & kb.isin(*NUMBERS)
        scalar = (*NUMBERS, "string")
        by_number = OPS[op](a.number.cast("double"), b.number.cast("double")) if all(x.kind in ("variant", *NUMBERS) for x in (a, b)) else F.lit(False)
        return (
            F.when(ka.isNull() | kb.isNull(), False)
            .when((ka == "nil") & (kb == "nil"), op == "eq")
            .when(kb == "nil", op == "neq")
            .when(ka == "nil", False)
            .when(numbers, by_number)
            .when(ka.isin(*scalar) & kb.isin(*scalar), OPS[op](a.text, b.text))
            .otherwise(False)
        )
    if b.kind == "nil":
        # a typed column cannot tell a null from a missing value: both are null
        return {"eq": a.col.isNull(), "neq": a.col.isNotNull()}.get(op, F.lit(False))
    if a.kind == "nil":
        return F.lit(False)
    if a.kind in NUMBERS and b.kind in NUMBERS:
        return OPS[op](a.number, b.number)
    if a.kind == b.kind:
        return OPS[op](a.col, b.col)
    if {a.kind, b.kind} & {"array", "other"}:
        # a date or time compares with a string that is one
        return OPS[op](a.col, b.col.cast(a.data_type)) if a.kind == "other" and b.kind == "string" and a.data_type is not None else F.lit(False)
    return OPS[op](a.text, b.text)


def matches(a: Operand, pattern: str, ignore_case: bool, in_item: bool) -> Column:
    return matched(a.text, pattern, ignore_case, in_item)


def quantified(q: Quantified, scope: Scope) -> Column:
    """False for what is no array and for empty ones; an item on which the condition is not true fails."""
    array = scope.property(q.prop)
    if array.kind == "variant":
        items: Column = F.try_variant_get(array.col, "$", "array<variant>")
        item = lambda x: Operand("variant", x, told=variant_kind(x))
    elif array.kind == "array":
        items, inner = array.col, array.data_type.elementType
        item = lambda x: Operand(kind_of(inner), x, inner, variant_kind(x) if kind_of(inner) == "variant" else None)
    else:
        return F.lit(False)
    holds = lambda x: condition(q.condition, Scope(scope.own, scope.others, item(x)))
    if q.kind == "any":
        return F.coalesce(F.exists(items, holds), F.lit(False))
    return F.coalesce((F.size(items) > 0) & F.forall(items, holds), F.lit(False))


def truth(node: Node, scope: Scope) -> Column:
    """The condition as a Column that may be NULL where it is not true: good for filters, which reach the scan."""
    if isinstance(node, (All, Any)):
        parts = [truth(p, scope) for p in node.parts]
        out = parts[0]
        for p in parts[1:]:
            out = out & p if isinstance(node, All) else out | p
        return out
    if isinstance(node, Compare):
        return compare(node.op, operand(node.left, scope), operand(node.right, scope))
    if isinstance(node, Exists):
        p = scope.property(node.prop)
        return p.col.isNotNull() if node.present else p.col.isNull()
    if isinstance(node, Match):
        return matches(scope.property(node.prop), node.pattern, node.ignore_case, scope.item is not None)
    if isinstance(node, Quantified):
        return quantified(node, scope)
    raise RuleError(f"no condition: {node!r}")


def condition(node: Node, scope: Scope) -> Column:
    """The condition as true or false, never NULL."""
    return F.coalesce(truth(node, scope), F.lit(False))
