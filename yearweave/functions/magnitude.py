"""Numbers written with a magnitude suffix, such as `2.5M`."""

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text patterns and the suffix tables that give the expected numbers.
NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?)"
SUFFIX = r"([A-Za-zµ]+)\z"
PLAIN = r"\A\s*-?[0-9]+(\.[0-9]+)?\s*[A-Za-zµ]*\z"
SI_FACTORS = {
    "Y": 1e24,
    "Z": 1e21,
    "E": 1e18,
    "P": 1e15,
    "T": 1e12,
    "G": 1e9,
    "M": 1e6,
    "k": 1e3,
    "m": 1e-3,
    "u": 1e-6,
    "n": 1e-9,
    "p": 1e-12,
    "f": 1e-15,
    "a": 1e-18,
}
# Same table with B (billion) where SI has G.
BILLION_FACTORS = {("B" if s == "G" else s): f for s, f in SI_FACTORS.items()}


class Magnitude(NamedTuple):
    value: Column
    symbol: Column
    unknown_suffix: Column
    suspicious: Column


def number_part(text: Column) -> Column:
    """First number anywhere in the text, null if there is none."""
    return F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")).cast("double")


def suffix_part(text: Column) -> Column:
    """Letters at the very end of the text, null if there are none."""
    return F.nullif(F.regexp_extract(text, SUFFIX, 1), F.lit(""))


def suffix_factor(symbol: Column, factors: dict[str, float]) -> Column:
    """Factor of a symbol. A symbol that itself reads as a double (`nan`, `inf`) counts as
    that double, so a `NaN` cell is a null value and not an unknown suffix."""
    table = F.create_map(*[F.lit(v) for pair in factors.items() for v in pair])
    return F.coalesce(F.try_element_at(table, symbol), symbol.try_cast("double"))


def magnitude_value(text: Column, factors: dict[str, float]) -> Column:
    symbol = suffix_part(text)
    factor = F.when(symbol.isNull(), F.lit(1.0)).otherwise(suffix_factor(symbol, factors))
    return number_part(text) * factor


def unknown_symbol(text: Column, factors: dict[str, float]) -> Column:
    """The trailing symbol if no factor is known for it, else null."""
    symbol = suffix_part(text)
    return F.when(suffix_factor(symbol, factors).isNull(), symbol)


def parse_magnitude(text: Column, factors: dict[str, float] = SI_FACTORS) -> Magnitude:
    return Magnitude(
        value=magnitude_value(text, factors),
        symbol=suffix_part(text),
        unknown_suffix=unknown_symbol(text, factors).isNotNull(),
        suspicious=text.isNotNull() & ~text.rlike(PLAIN),
    )
