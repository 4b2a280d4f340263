"""Host names in one spelling: without case and final dot, international labels in their ASCII form (Punycode, RFC 3492).

The encoder is a fold over a label's characters by higher-order functions, so that names are compared in the JVM. Labels are
lower-cased first and ideographic full stops count as dots; what is not in composed form is taken as it is written, and a
label that cannot be a name (more than 63 characters encoded) is encoded all the same and fits no rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the parameters of Punycode, and the characters that stand for a dot
BASE, T_MIN, T_MAX, SKEW, DAMP, FIRST_BIAS, FIRST_N = 36, 1, 26, 38, 700, 72, 128
DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"
DOTS = "[。．｡]"
#: Digits of a number at most: seven hold 32 bits.
PLACES = 7


def _record(**fields: Column) -> Column:
    """A struct whose names do not depend on aliases, which are lost inside lambda functions."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def _div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def _digit(d: Column) -> Column:
    return F.substr(F.lit(DIGITS), (d + 1).cast("int"), F.lit(1))


def _threshold(place: Column, bias: Column) -> Column:
    return F.least(F.greatest(BASE * place - bias, F.lit(T_MIN)), F.lit(T_MAX)).cast("long")


def _number(delta: Column, bias: Column) -> Column:
    """delta in digits of variable length, the least first."""
    start = _record(q=delta, text=F.lit(""), more=F.lit(True))

    def step(s: Column, place: Column) -> Column:
        t = _threshold(place, bias)
        last = s["q"] < t
        rest = s["q"] - t
        text = F.concat(s["text"], F.when(last, _digit(s["q"])).otherwise(_digit(t + rest % (BASE - t))))
        return F.when(s["more"], _record(q=_div(rest, BASE - t), text=text, more=~last)).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(PLACES).cast("long")), start, step, lambda s: s["text"])


def _adapted(delta: Column, points: Column, first: Column) -> Column:
    """The next bias."""
    half = F.when(first, _div(delta, F.lit(DAMP).cast("long"))).otherwise(_div(delta, F.lit(2).cast("long")))
    start = _record(d=half + _div(half, points), k=F.lit(0).cast("long"))
    most = (BASE - T_MIN) * T_MAX // 2
    step = lambda s, _: F.when(s["d"] > most, _record(d=_div(s["d"], F.lit(BASE - T_MIN).cast("long")), k=s["k"] + BASE)).otherwise(s)
    return F.aggregate(F.sequence(F.lit(1), F.lit(PLACES)), start, step, lambda s: s["k"] + _div((BASE - T_MIN + 1) * s["d"], s["d"] + SKEW))


def punycode(label: Column) -> Column:
    """A label's Punycode, without prefix."""
    points = F.transform(F.filter(F.split(label, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    plain = F.array_join(F.transform(F.filter(points, lambda p: p < FIRST_N), lambda p: F.char(p)), "")
    basic = F.size(F.filter(points, lambda p: p < FIRST_N)).cast("long")
    wanted = F.array_sort(F.array_distinct(F.filter(points, lambda p: p >= FIRST_N)))
    state = lambda delta, n, bias, done, text: _record(delta=delta, n=n, bias=bias, done=done, text=text)

    def character(s: Column, p: Column) -> Column:
        found = state(F.lit(0).cast("long"), s["n"], _adapted(s["delta"], s["done"] + 1, s["done"] == basic), s["done"] + 1, F.concat(s["text"], _number(s["delta"], s["bias"])))
        return F.when(p < s["n"], state(s["delta"] + 1, s["n"], s["bias"], s["done"], s["text"])).when(p == s["n"], found).otherwise(s)

    def value(s: Column, m: Column) -> Column:
        up = state(s["delta"] + (m - s["n"]) * (s["done"] + 1), m, s["bias"], s["done"], s["text"])
        return F.aggregate(points, up, character, lambda t: state(t["delta"] + 1, t["n"] + 1, t["bias"], t["done"], t["text"]))

    start = state(F.lit(0).cast("long"), F.lit(FIRST_N).cast("long"), F.lit(FIRST_BIAS).cast("long"), basic, F.concat(plain, F.when(basic > 0, "-").otherwise("")))
    return F.aggregate(wanted, start, value, lambda s: s["text"])


def host_name(x: Column) -> Column:
    """A host name as it is compared: lower case, no final dot, every label in its ASCII form."""
    name = F.regexp_replace(F.regexp_replace(F.lower(x), DOTS, "."), r"\.$", "")
    foreign = lambda label: F.regexp_like(label, F.lit(r"[^\x00-\x7f]"))
    each = F.transform(F.split(name, r"\."), lambda label: F.when(foreign(label), F.concat(F.lit("xn--"), punycode(label))).otherwise(label))
    return F.when(foreign(name), F.array_join(each, ".")).otherwise(name)
