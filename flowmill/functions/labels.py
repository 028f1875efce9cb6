"""Label, family, verdict and band rules as native expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from flowmill.functions.text import clean_label
from flowmill.schema import (
    BRUTE_FORCE_NAMES, FAMILY_BY_NAME, FAMILY_RULES, FLOOD_PROTOCOLS, NORMAL_WORDS,
)


def label_of(word: Column, number: Column) -> Column:
    """0/1: a numeric value decides by being non-zero, a cleaned lower-case word by not
    meaning normal."""
    from_text = (word != "") & ~word.isin(NORMAL_WORDS)
    return F.when(number.isNotNull(), number != 0).otherwise(from_text).cast("int")


def is_attack(text: Column, number: Column) -> Column:
    """label_of a raw text."""
    return label_of(F.lower(clean_label(text)), number)


def any_flag(numbers: list[Column]) -> Column:
    """0/1: some column is a non-zero number."""
    flags = [F.coalesce(n, F.lit(0.0)) != 0 for n in numbers]
    return (reduce(or_, flags) if flags else F.lit(False)).cast("int")


def subcategory(raw: Column, label: Column) -> Column:
    return F.when(label == 0, F.lit("Normal")).otherwise(clean_label(raw))


def attack_family(raw: Column, label: Column) -> Column:
    """Family of a raw attack name."""
    name = clean_label(raw)
    return family_of(name, F.lower(name), label)


def family_of(name: Column, word: Column, label: Column) -> Column:
    """Family of a cleaned attack name and its lower-case form: exact names first, then
    substring rules in order."""
    by_name: dict[str, list[str]] = {}
    for attack, family in FAMILY_BY_NAME.items():
        by_name.setdefault(family, []).append(attack)

    rule = F.when((label == 0) | word.isin(NORMAL_WORDS), F.lit("Normal"))
    for family, attacks in by_name.items():
        rule = rule.when(word.isin(attacks), F.lit(family))
    rule = rule.when(word.isin(FLOOD_PROTOCOLS), F.lit("DDoS"))
    for parts, family in FAMILY_RULES:
        matches = reduce(or_, [word.contains(p) for p in parts])
        if family == "BruteForce":
            matches = matches | word.isin(BRUTE_FORCE_NAMES)
        rule = rule.when(matches, F.lit(family))
    return rule.when(name != "", name).otherwise(F.lit("Attack"))


def risk_level(p: Column) -> Column:
    return (F.when(p >= 0.85, "Critical").when(p >= 0.65, "High")
            .when(p >= 0.35, "Review").otherwise("Low"))


def decide(p: Column, threshold: float) -> Column:
    """Inclusive threshold."""
    return (p >= F.lit(threshold)).cast("int")


def verdict(prediction: Column) -> Column:
    return F.when(prediction == 1, "Attack").otherwise("Normal")


def _band(value: Column, attack: Column, ok: tuple, warn: tuple) -> Column:
    """ok and warn hold (least for attacks, most for normal)."""
    level = lambda good, fair: F.when(good, "ok").when(fair, "warn").otherwise("danger")
    return F.when(value.isNotNull(), F.when(
        attack, level(value >= ok[0], value >= warn[0])
    ).otherwise(level(value <= ok[1], value <= warn[1])))


def rate_band(rate: Column, label: Column) -> Column:
    """Traffic light of a detection rate (attacks) or false-positive rate (normal)."""
    return _band(rate, label == 1, (0.95, 0.02), (0.80, 0.06))


def probability_band(p: Column, label: Column) -> Column:
    return _band(p, label == 1, (0.90, 0.03), (0.70, 0.08))


def is_concern(rate: Column, label: Column) -> Column:
    """An attack category detected less than three times in four."""
    return F.coalesce((label == 1) & (rate < 0.75), F.lit(False))
