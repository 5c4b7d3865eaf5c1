"""Candidates of the pattern detectors, labelled fields, contextual persons and custom terms, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .dialect import CJK, extract, java, matches, replace, trim
from .spans import CANDIDATE, FRAGMENTS, HIT, bound, candidate, fragments, holds, none, scan, scan_each, scan_fields, scan_fields_each, scan_fragments_each, separable


def _ci(value: Column, pattern: str) -> Column:
    return F.regexp_extract(value, "(?i)" + java(pattern), 0)


def _unit(value: Column) -> Column:
    return _ci(value, f"{fixed.SPEC_UNIT}$")


def _compare(value: Column) -> Column:
    return extract(value, f"^{fixed.COMPARE}")


def _or(value: Column, default: str) -> Column:
    return F.when(value == "", F.lit(default)).otherwise(value)


def _date(value: Column) -> Column:
    year, day = F.contains(value, F.lit("年")), F.contains(value, F.lit("日"))
    return F.when(year & day, "20XX年XX月XX日").when(year, "20XX年XX月").otherwise("XX月XX日")


def _money(value: Column, before: Column) -> Column:
    unit = extract(value, f"(?:亿元|万元|万|元|{fixed.FOREIGN})(?=\\s*(?:[（(]|$))")
    total = matches(before, "(?:合同总额|合同总金额|合同金额|费用总额)\\s*(?:为|是|：|:)?\\s*$")
    return F.when(total | value.rlike("(?i)" + f"{fixed.CURRENCY}|{fixed.SYMBOL}"), "【金额】").otherwise(F.concat(F.lit("X"), _or(unit, "元")))


PLACEHOLDERS = {
    "bracketed_date": lambda v, b: F.when(F.contains(v, F.lit("日")), "20XX年XX月XX日").otherwise("20XX年XX月"),
    "money": _money,
    "compared_money": lambda v, b: F.concat(_compare(v), F.lit("X"), _or(extract(v, "(?:亿元|万元|万|元)$"), "元")),
    "money_range": lambda v, b: F.concat(F.lit("X-Y"), extract(v, f"(?:元|万元|亿元|{fixed.FOREIGN})$")),
    "tenths": lambda v, b: F.concat(F.lit("X"), F.when(F.endswith(v, F.lit("折")), "折").otherwise("成")),
    "nth": lambda v, b: F.when(F.startswith(trim(v), F.lit("第")), "第X").otherwise("X"),
    "compared": lambda v, b: F.concat(_compare(v), F.lit("X")),
    "compared_unit": lambda v, b: F.concat(_compare(v), F.lit("X"), _unit(v)),
    "range_unit": lambda v, b: F.concat(F.lit("X-Y"), _unit(v)),
    "qualified_unit": lambda v, b: F.concat(extract(v, "^(?:至少|至多|不少于|不低于|不高于|不超过|低于|高于|大于|小于|约|共|全部)?"), F.lit("X"), _unit(v)),
    "area": lambda v, b: F.concat(F.lit("X"), replace(extract(v, "(?:万|千|百)?\\s*(?:平方米|平方|平米|㎡|m²|米)$"), "\\s+")),
    "unit": lambda v, b: F.concat(F.lit("X"), _unit(v)),
    "period_range": lambda v, b: F.concat(F.when(F.startswith(v, F.lit("第")), "第").otherwise(""), F.lit("Y-Z"), extract(v, "(?:个?月|周|天|日|小时|年)$")),
    "period": lambda v, b: F.concat(F.lit("Y"), _or(extract(v, fixed.SPAN), "日")),
}


def _shown(kind: Column, value: Column, before: Column) -> Column:
    """The placeholder that a rule's kind makes from the match; only the kind's own branch is evaluated."""
    made = F.when(kind == "date", _date(value))
    for name, make in PLACEHOLDERS.items():
        made = made.when(kind == name, make(value, before))
    return made


def pattern_candidates(text: Column, rules: list[tuple] = fixed.DETECTORS, keep_amounts: bool = False) -> Column:
    """All pattern detectors in order; ``keep_amounts`` leaves the amount rules out.

    A rule of the fixed list is searched in the fragments that hold what it needs; other rules, and those that look at any character,
    in the whole text.
    """
    rules = [rule for rule in rules if not (keep_amounts and rule[1] == "amount")]
    needs = [fixed.RULE_NEEDS.get(rule[0]) if rule in fixed.DETECTORS and separable(rule[2]) else None for rule in rules]
    parted, whole = [i for i, n in enumerate(needs) if n], [i for i, n in enumerate(needs) if not n]
    holds = lambda i: reduce(lambda a, b: a & b, [F.contains(text, F.lit(x)) for x in fixed.TEXT_NEEDS[rules[i][0]]]) if rules[i] in fixed.DETECTORS and rules[i][0] in fixed.TEXT_NEEDS else None
    in_text = scan_each(text, [(holds(i), *rules[i][2:4]) for i in whole])
    # No rule of the list matches without a digit, a Chinese character, an @ or 18 capitals.
    pieces = F.when(text.rlike("[@\\d]|[A-HJ-NPQRTUWXY]{18}") | (F.octet_length(text) != F.length(text)) & text.rlike(fixed.NEEDS["han"]), fragments(text)).otherwise(none(FRAGMENTS))
    in_pieces = bound(pieces, lambda p: scan_fragments_each(p, [(needs[i], *rules[i][2:4]) for i in parted])) if parted else none(f"array<{HIT}>")
    order = [(parted + whole).index(i) for i in range(len(rules))]
    found = bound(F.concat(in_pieces, in_text), lambda every: F.array(*[F.get(every, F.lit(i)) for i in order]))
    kinds, texts = [], []
    for _, category, _, _, placeholder in rules:
        kind = placeholder if placeholder in PLACEHOLDERS else "date" if placeholder is None and category == "date" else None
        kinds.append(F.lit(kind).cast("string"))
        texts.append(F.lit(None).cast("string") if kind else F.lit(placeholder or fixed.CATEGORIES[category][1]))
    categories, kinds, texts = F.array(*[F.lit(rule[1]) for rule in rules]), F.array(*kinds), F.array(*texts)

    def of_rule(hits, i):
        def shaped(hit):
            before = F.substr(text, F.greatest(hit["start"] - 15, F.lit(1)), F.least(hit["start"], F.lit(16)))
            return candidate(hit["start"], hit["value"], F.get(categories, i), F.coalesce(F.get(texts, i), _shown(F.get(kinds, i), hit["value"], before)))

        return F.transform(hits, shaped)

    return F.flatten(F.transform(found, of_rule))


def is_party(value: Column) -> Column:
    return matches(value, f"{fixed.COMPANY_SUFFIX}$")


def is_address(value: Column) -> Column:
    clean = replace(value, fixed.WRAPPERS)
    return ~matches(clean, fixed.ADDRESS_WORDS) & F.length(clean).between(4, 140) & matches(clean, fixed.PLACE) & matches(clean, fixed.PLACE_DETAIL)


def is_person(value: Column) -> Column:
    clean = replace(value, fixed.WRAPPERS)
    parts = F.filter(F.transform(F.split(clean, "[，,、]"), trim), lambda x: x != "")
    name = f"^[{fixed.NAME_CHARS}][{fixed.NAME_CHARS} \\t　]{{1,29}}$"
    return (
        F.length(clean).between(2, 60) & ~matches(clean, fixed.PROSE) & ~matches(clean, fixed.BLANK_FORM) & ~is_party(clean) & ~is_address(clean)
        & F.size(parts).between(1, 2) & F.forall(parts, lambda p: matches(p, name))
    )


def _plain(category: str, shown: str):
    return lambda h: candidate(h["start"], h["value"], category, shown)


def field_candidates(text: Column, doc_type: Column, rules: list[tuple] = fixed.FIELDS) -> Column:
    """All labelled fields in order; a value starts where its text first occurs in the match, label included."""
    guard = lambda rule: holds(text, fixed.FIELD_WORDS[rule[0]]) if rule in fixed.FIELDS else None
    found = scan_fields_each(text, [(guard(rule), *rule[2:6]) for rule in rules])
    project = F.when(doc_type == "tech", fixed.PROJECT_TOKENS["tech"]).when(doc_type == "purchase", fixed.PROJECT_TOKENS["purchase"]).otherwise(fixed.PROJECT_TOKENS[""])
    categories, texts = F.array(*[F.lit(rule[1]) for rule in rules]), F.array(*[F.lit(rule[-1]).cast("string") for rule in rules])

    def of_rule(hits, i):
        category = F.get(categories, i)
        fits = lambda h: F.when(category == "person", is_person(h["value"])).when(category == "address", is_address(h["value"])).otherwise(True)
        at = lambda h: h["start"] + F.instr(h["whole"], h["value"]) - 1
        trimmed = F.transform(hits, lambda h: F.struct(h["start"].alias("start"), h["whole"].alias("whole"), trim(h["value"]).alias("value")))
        return F.transform(F.filter(trimmed, fits), lambda h: candidate(at(h), h["value"], category, F.coalesce(F.get(texts, i), project)))

    return F.flatten(F.transform(found, of_rule))


def person_candidates(text: Column) -> Column:
    """Lecturers, names before the word for lawyer, and names in clauses that appoint lawyers."""
    name = f"[{CJK}·]{{2,4}}"
    lawyer = holds(text, ("律师",))
    hit = lambda start, value: F.struct(start.cast("int").alias("start"), value.alias("value"))
    lecturers = F.flatten(F.transform(scan_fields(text, fixed.LECTURER, "[^，,。\\n；;]{2,60}", guard=holds(text, ("师", "主讲人"))), lambda h: F.transform(
        F.filter(scan(h["value"], "[^、,，和及与\\s　]+"), lambda t: matches(t["value"], f"^{name}$")),
        lambda t: hit(h["start"] + F.instr(h["whole"], h["value"]) - 1 + t["start"], t["value"]))))
    before = F.transform(scan_fields(text, "(?:^|[、,，\\s　])", name, "(?=律师)", guard=lawyer), lambda h: hit(h["start"] + F.instr(h["whole"], h["value"]) - 1, h["value"]))
    # In a clause a leading 本所 belongs to the label, not to the name.
    clauses = F.when(lawyer, scan(text, fixed.LAWYER_CLAUSE)).otherwise(none(HIT))
    appointed = F.flatten(F.transform(clauses, lambda c: F.transform(
        F.filter(scan_fields(c["value"], "(?:本所)?", name, "(?=律师)"), lambda h: ~matches(h["value"], fixed.LAWYER_ROLES)),
        lambda h: hit(c["start"] + h["start"] + F.length(h["whole"]) - F.length(h["value"]), h["value"]))))
    people = F.filter(F.concat(lecturers, before, appointed), lambda h: is_person(trim(h["value"])))
    return F.transform(people, lambda h: candidate(h["start"], h["value"], "person", "【人员姓名】"))


def parsed_terms(terms: str) -> list[str]:
    """The term list of a user's text: parted by line feeds, 、 or ;."""
    import re

    return [t for t in (x.strip() for x in re.split("\n|、|;", terms)) if t]


def term_candidates(text: Column, terms: list[str], numbered: bool = True) -> Column:
    """Literal hits of the terms, in their order."""
    if not terms:
        return none(CANDIDATE)
    found = []
    for i, term in enumerate(terms):
        shown = f"【敏感信息{i + 1}】" if numbered else "【敏感信息】"
        hits = F.transform(scan(text, "\\Q" + term.replace("\\E", "\\E\\\\E\\Q") + "\\E"), _plain("custom", shown))
        found.append(F.when(F.contains(text, F.lit(term)), hits).otherwise(none(CANDIDATE)))
    return F.concat(*found)
