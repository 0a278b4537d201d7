"""Measures: unit conversion on catalog text and parsing of folded measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from catalogmatch.functions.text import SPACE, let, strip

# ---- fixed values: unit names in matching order, their factor and target unit ----
# POL is recognised but has no factor: inches stay as they are written.
UNITS = (
    ("KILOGRAMA", 1000.0, "GRAMA"),
    ("GRAMA", 1.0, "GRAMA"),
    ("MILIGRAMA", 0.001, "GRAMA"),
    ("TONELADA", 1000000.0, "GRAMA"),
    ("LITRO", 1000.0, "MILILITRO"),
    ("MILILITRO", 1.0, "MILILITRO"),
    ("CENTIMETRO CUBICO", 1.0, "MILILITRO"),
    ("METRO CUBICO", 1000000.0, "MILILITRO"),
    ("METRO", 1000.0, "MILIMETRO"),
    ("CENTIMETRO", 10.0, "MILIMETRO"),
    ("MILIMETRO", 1.0, "MILIMETRO"),
    ("KILOMETRO", 1000000.0, "MILIMETRO"),
    ("POL", None, None),
    ("PÉS", 304.8, "MILIMETRO"),
    ("JARDAS", 914.4, "MILIMETRO"),
)
# ---- fixed values: letters a folded or raw unit may hold when a measure is parsed ----
UNIT_LETTERS = "a-zA-Zçãáéíóú"
# ---- fixed values: a quantity with its unit anywhere in a text; a text that is one measure ----
QUANTITY_UNIT = rf"(\d+[.,]?\d*){SPACE}*({'|'.join(name for name, _, _ in UNITS)})"
PARSED = rf"^(\d+(?:[.,]\d+)?){SPACE}*((?:[{UNIT_LETTERS}]|{SPACE})*)$"
# ---- end of fixed values ----

_FACTORS = "map(" + ", ".join(f"'{u}', struct({f}D AS factor, '{t}' AS target)" for u, f, t in UNITS if f) + ")"

# ``t`` is Spark's text of a double with an exponent: split into sign, digits and power of ten
_PARTS = """t -> named_struct(
    'sign', if(t LIKE '-%', '-', ''),
    'digits', regexp_replace(translate(split_part(t, 'E', 1), '-.', ''), '(?<=.)0+$', ''),
    'power', cast(split_part(t, 'E', 2) AS int))"""
_RENDER = """p -> p.sign || CASE
    WHEN p.power BETWEEN 0 AND 15 THEN rpad(left(p.digits, p.power + 1), p.power + 1, '0') || '.'
        || if(length(p.digits) > p.power + 1, substr(p.digits, p.power + 2), '0')
    WHEN p.power BETWEEN -4 AND -1 THEN '0.' || repeat('0', -p.power - 1) || p.digits
    ELSE left(p.digits, 1) || if(length(p.digits) > 1, '.' || substr(p.digits, 2), '')
        || if(p.power < 0, 'e-', 'e+') || lpad(abs(p.power), greatest(2, length(abs(p.power))), '0') END"""


def decimal_text(value: Column) -> Column:
    """Text of a double as catalogs store it: ``10000000.0``, never ``1.0E7``.

    Positional between 1e-4 and 1e16, otherwise ``1e-05`` / ``1e+16``.  The digits are those of
    Spark's own string cast, only re-arranged.
    """
    text = value.cast("string")
    return F.when(text.contains("E"), let(let(text, _PARTS), _RENDER)).otherwise(text)


def convert_measure(text: Column) -> Column:
    """Bring weights to grams, volumes to millilitres and lengths to millimetres.

    The quantity and unit may stand anywhere in the text; what surrounds them is dropped.  Text
    without a convertible unit comes back upper-cased and trimmed.  Null stays null.
    """
    measure = strip(F.upper(text))
    quantity = F.regexp_extract(measure, QUANTITY_UNIT, 1)
    unit = F.try_element_at(F.expr(_FACTORS), F.regexp_extract(measure, QUANTITY_UNIT, 2))
    number = F.replace(quantity, F.lit(","), F.lit(".")).try_cast("double")
    converted = F.concat(decimal_text(number * unit.getField("factor")), unit.getField("target"))
    return F.coalesce(converted, measure)


def parse_measure(text: Column) -> Column:
    """Struct ``(value double, unit string)``.

    ``1000grama`` gives (1000.0, grama), ``pacote`` gives (null, pacote), null or blank gives
    (null, '').
    """
    measure = F.lower(strip(F.coalesce(text, F.lit(""))))
    number = F.regexp_extract(measure, PARSED, 1)
    matched = number != ""
    return F.struct(
        F.when(matched, F.replace(number, F.lit(","), F.lit(".")).try_cast("double")).alias("value"),
        F.when(matched, strip(F.regexp_extract(measure, PARSED, 2))).otherwise(measure).alias("unit"),
    )
