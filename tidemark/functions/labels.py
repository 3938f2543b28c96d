"""Column functions on labels: truth rules, bit masks and label maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.texts import let

#: The label set. A label's code is what stands before the bracket.
STANDARD = (
    "C1(Sexual Content)",
    "C2(Harassment & Bullying)",
    "C3(Threats, Violence & Harm)",
    "C4(False & Deceptive Information)",
    "C5(Illegal/Regulated Activities)",
    "C6(Hateful Content & Extremism)",
)


def raw_map(text: Column) -> Column:
    """A JSON object's keys, in document order, with each value as JSON text (so "false" and false differ)."""
    return F.transform_values(F.from_json(text, "map<string,variant>"), lambda k, v: F.to_json(v))


def true_number(raw: Column) -> Column:
    """A JSON value is true if it is true or a number other than 0; a text never is."""
    return F.coalesce((raw == "true") | (raw.try_cast("double") != 0), F.lit(False))


def true_python(raw: Column) -> Column:
    """A JSON value is true unless it is false, null, 0, or an empty text, list or object ("false" in quotes is true)."""
    empty = lambda x: x.isNull() | x.isin("false", "null", '""', "[]", "{}")
    return let(raw, lambda x: F.when(empty(x), False).when(x == "true", True).otherwise(F.coalesce(x.try_cast("double") != 0, F.lit(True))))


def true_word(raw: Column) -> Column:
    """true, numbers other than 0, and the texts true, 1, yes and y in any case."""
    word = F.lower(F.trim(F.regexp_replace(raw, '^"|"$', "")))
    return F.coalesce(F.when(raw.startswith('"'), word.isin("true", "1", "yes", "y")).otherwise((raw == "true") | (raw.try_cast("double") != 0)), F.lit(False))


def label_value(labels: Column, standard: str) -> Column:
    """The raw value of the first key, in document order, that is the label, its code, or starts with ``code(``."""
    code = standard.split("(", 1)[0]
    fits = F.filter(F.map_entries(labels), lambda e: (e["key"] == standard) | (e["key"] == code) | e["key"].startswith(f"{code}("))
    return F.get(fits, 0)["value"]


def mask(tests: Sequence[Column]) -> Column:
    """Bit mask of the tests that hold; null counts as false."""
    bits = [F.when(test, 1 << j).otherwise(0) for j, test in enumerate(tests)]
    return sum(bits[1:], bits[0])


def label_bits(labels: Column, standard: Sequence[str] = STANDARD) -> Column:
    """Bit mask of the labels whose value is true by Python's rule; labels is a map of raw JSON values."""
    return let(labels, lambda found: mask([true_python(label_value(found, name)) for name in standard]))


def is_standard(labels: Column, standard: Sequence[str] = STANDARD) -> Column:
    """Whether the map's keys are the label set, in order."""
    return F.map_keys(labels) == F.array(*map(F.lit, standard))


def codes(bits: Column, n: int = 6) -> Column:
    """C1,C3,... of the set bits."""
    return F.array_join(F.filter(F.array(*[F.when(bits.bitwiseAND(1 << j) != 0, F.lit(f"C{j + 1}")) for j in range(n)]), lambda c: c.isNotNull()), ",")


def has(bits: Column, j: int) -> Column:
    return bits.bitwiseAND(1 << j) != 0


def exact_bits(labels: Column, standard: Sequence[str] = STANDARD) -> Column:
    """Bit mask by exact keys only: a label without its key counts as false. No labels at all give 0."""
    bits = [F.when(true_python(F.try_element_at(labels, F.lit(name))), 1 << j).otherwise(0) for j, name in enumerate(standard)]
    return F.coalesce(sum(bits[1:], bits[0]), F.lit(0))


def as_map(bits: Column, standard: Sequence[str] = STANDARD) -> Column:
    """The label set as a map to booleans, in order."""
    return F.map_from_arrays(F.array(*map(F.lit, standard)), F.array(*[has(bits, j) for j in range(len(standard))]))


def prefix_bits(labels: Column, codes: Sequence[str] = ("C1", "C2", "C3", "C4", "C5", "C6")) -> Column:
    """Bit mask of the codes whose first key that starts with ``code(`` is true."""
    value = lambda entries, code: F.get(F.filter(entries, lambda e: e["key"].startswith(f"{code}(")), 0)["value"]
    return let(F.map_entries(labels), lambda entries: mask([true_python(value(entries, code)) for code in codes]))


def key_union(maps: Column) -> Column:
    """All keys of an array of maps, in order."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(maps, lambda m: F.map_keys(m)))))


def vectorize(labels: Column, keys: Column) -> Column:
    """A truth value per key, by the rule for numbers; keys that the map lacks are false."""
    return F.transform(keys, lambda k: true_number(F.try_element_at(labels, k)))


def mask_of(labels: Column, universe: Sequence[str], present: bool = False) -> Column:
    """Bit mask over a label universe of up to 31 keys: those that are true, or with `present` those that the map has."""
    if len(universe) > 31:
        raise ValueError("a bit mask holds at most 31 labels")
    test = (lambda k: F.map_contains_key(labels, k)) if present else (lambda k: true_number(F.try_element_at(labels, F.lit(k))))
    bits = [F.when(test(k), 1 << j).otherwise(0) for j, k in enumerate(universe)]
    return sum(bits[1:], bits[0]) if bits else F.lit(0)


def distinct_in_order(values: Column) -> Column:
    """The values that are not empty, each where it comes first."""
    return F.array_distinct(F.filter(values, lambda v: v.isNotNull() & (v != "")))
