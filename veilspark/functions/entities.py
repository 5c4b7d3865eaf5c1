"""Parties, related entities and aliases of a document, and their mentions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .detectors import is_party, is_person
from .dialect import BLANK, escaped, extract, matches, replace, trim
from .spans import CANDIDATE, HIT, bound, candidate, holds, literal_places, none, scan_fields, scan_fields_each, scan_java, without_blanks

PARTY = "array<struct<value:string,category:string>>"
ENTITY = "array<struct<value:string,category:string,placeholder:string>>"


def preamble(text: Column) -> Column:
    """The text before the first article or chapter, or its first 20 000 characters."""
    at = F.regexp_instr(text, F.lit(fixed.PREAMBLE_END))
    return F.when(at > 1, F.substr(text, F.lit(1), at - 1)).otherwise(F.substr(text, F.lit(1), F.lit(fixed.PREAMBLE_CHARS)))


def cleaned(value: Column) -> Column:
    rest = "[^\\n\\r\\u2028\\u2029]*$"
    value = replace(replace(value, fixed.AFTER_VALUE + rest), fixed.AFTER_NAME + rest)
    return trim(replace(replace(value, "[ \\t　\\r\\n]+"), fixed.AROUND_VALUE))


def _labelled_parties(text: Column, guard: Column) -> Column:
    rules = []
    for stem, labels in fixed.PARTIES:
        rules.append((guard & holds(text, labels.split("|")), f"(?:{labels})[ \\t　]*(?:[（(][^）)\\n]{{1,20}}[）)])?{fixed.PARTY_GAP}[【\\[（(]?[ \\t　]*", fixed.COMPANY, "", ""))
        rules.append((guard & F.contains(text, F.lit(f"{stem}方")), f"{stem}方\\s*[（(]\\s*", fixed.COMPANY, "\\s*[）)]", ""))
    category = F.array(*[F.lit(f"entity{letter}") for letter in fixed.ENTITY_LETTERS])

    def of_rule(hits, i):
        named = F.filter(F.transform(hits, lambda h: cleaned(h["value"])), lambda v: F.length(v).between(2, 50) & is_party(v))
        return F.transform(named, lambda v: F.struct(v.alias("value"), F.get(category, (i / 2).cast("int")).alias("category")))

    return F.flatten(F.transform(scan_fields_each(text, rules), of_rule))


def with_labelled_parties(docs, name: str):
    """Adds ``name``: parties named after their labels in the preamble; if there are none, in the whole text."""
    text, guard = F.col("text"), holds(F.col("text"), ("方",))
    head = docs.withColumn("__head", F.when(guard, bound(preamble(text), lambda t: _labelled_parties(t, F.lit(True)))).otherwise(none(PARTY)))
    return head.withColumn(name, F.when(F.size("__head") > 0, F.col("__head")).otherwise(_labelled_parties(text, guard & (F.size("__head") == 0)))).drop("__head")


def declared_roles(text: Column) -> Column:
    """Values of role declarations (authorising, mandating, declaring parties)."""
    values = F.transform(scan_fields(text, fixed.ROLE_LABEL, fixed.ROLE_NAME, fixed.ROLE_END, guard=holds(text, fixed.ROLES.split("|"))), lambda h: trim(h["value"]))
    return F.filter(values, lambda v: (is_party(v) | is_person(v)) & ~matches(v, fixed.ROLE_BLANK))


def assigned_parties(labelled: Column | str, declared: Column | str) -> Column:
    """Letters for a document's parties, in order.

    A declared role takes the first letter that no party has, or is numbered; of parties that share a letter the
    first keeps it and the others take free ones.
    """
    labelled, declared = (F.col(c) if isinstance(c, str) else c for c in (labelled, declared))
    letters = F.array(*[F.lit(f"entity{x}") for x in fixed.ENTITY_LETTERS])
    entry = lambda v, c, p: F.struct(v.alias("value"), c.alias("category"), p.alias("placeholder"))
    numbered = lambda n: F.concat(F.lit("【主体"), n.cast("string"), F.lit("】"))
    first_free = lambda taken: F.get(F.filter(letters, lambda c: ~taken(c)), F.lit(0))

    def with_role(acc, value):
        free = first_free(lambda c: F.exists(acc, lambda p: p["category"] == c))
        new = entry(value, F.coalesce(free, F.lit("entityOther")), F.when(free.isNull(), numbered(F.size(acc) + 1)))
        return F.when(F.exists(acc, lambda p: p["value"] == value), acc).otherwise(F.array_append(acc, new))

    def lettered(acc, p):
        free, used = first_free(lambda c: F.array_contains(acc["reserved"], c)), F.array_contains(acc["given"], p["category"])
        moved, lone = used & free.isNotNull(), used & free.isNull() & p["placeholder"].isNull()
        category = F.when(moved, free).when(lone, "entityOther").otherwise(p["category"])
        return F.struct(
            F.when(moved, F.array_append(acc["reserved"], free)).otherwise(acc["reserved"]).alias("reserved"), F.array_append(acc["given"], category).alias("given"),
            F.array_append(acc["out"], entry(p["value"], category, F.when(lone, numbered(F.size(acc["out"]) + 1)).otherwise(p["placeholder"]))).alias("out"),
        )

    begin = F.concat(none(ENTITY), F.transform(labelled, lambda p: entry(p["value"], p["category"], F.lit(None).cast("string"))))
    every = F.aggregate(declared, begin, with_role)
    unlike = lambda all_: F.filter(all_, lambda p, i: F.forall(F.slice(all_, F.lit(1), i), lambda q: q["value"] != p["value"]))
    distinct = F.transform(F.array(every), unlike)  # one element, so that it is bound once
    names = F.from_json(F.lit("[]"), "array<string>")
    of = lambda d: F.aggregate(d, F.struct(F.concat(names, F.transform(d, lambda p: p["category"])).alias("reserved"), names.alias("given"), none(ENTITY).alias("out")), lettered, lambda acc: acc["out"])
    return F.get(F.transform(distinct, of), F.lit(0))


def flexible(value: Column) -> Column:
    """A pattern for the value with blanks allowed between its characters."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    return F.array_join(F.transform(chars, escaped), f"[{BLANK}]*")


def related_entities(text: Column, parties: Column) -> Column:
    """Organisations after neutral labels that are no parties."""
    gap = "[ \\t　]*[：:，,.。;；]?\\s*[【\\[（(]?[ \\t　]*"
    hits = F.concat(scan_fields(text, fixed.RELATED_LABEL + gap, fixed.COMPANY, guard=holds(text, fixed.RELATED_WORDS)), scan_fields(text, f"(?:{fixed.PARTY_LABEL})[ \\t　]*(?:公司)?名称{gap}", fixed.COMPANY, guard=holds(text, ("名称",))))
    values = F.filter(F.transform(hits, lambda h: cleaned(h["value"])), lambda v: (v != "") & is_party(v))
    return F.transform(F.array_except(values, F.transform(parties, lambda p: p["value"])), lambda v: F.struct(v.alias("value"), F.lit("entityOther").alias("category"), F.lit("【相关主体】").alias("placeholder")))


def party_aliases(text: Column, parties: Column) -> Column:
    """Short names given in brackets after a party's name; parts of that name."""

    def of(party):
        pattern = F.concat(flexible(party["value"]), F.lit(fixed.ALIAS_AFTER), F.lit(f"({fixed.ALIAS_NAME})"))
        names = F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda a: trim(replace(a, "[ \\\\t　：:，,.。]+$")))
        names = F.filter(names, lambda a: F.length(a).between(2, 20) & ~a.isin(fixed.ALIAS_BLOCKED) & F.contains(party["value"], a))
        own = F.coalesce(F.regexp_replace(party["placeholder"], "^([^】]*)】", "$1简称】"), F.concat(F.lit("【主体"), F.replace(party["category"], F.lit("entity"), F.lit("")), F.lit("简称】")))
        return F.transform(names, lambda a: F.struct(a.alias("value"), party["category"].alias("category"), own.alias("placeholder")))

    # Bound as the only element of an array, so that the names are searched once and not again for each of them.
    first = lambda every: F.filter(every, lambda a, i: F.size(F.filter(F.slice(every, F.lit(1), i), lambda b: (b["value"] == a["value"]) & (b["category"] == a["category"]))) == 0)
    named = F.when(holds(text, fixed.ALIAS_WORDS.split("|")), parties).otherwise(F.filter(parties, lambda p: F.lit(False)))
    return F.get(F.transform(F.array(F.flatten(F.transform(named, of))), first), F.lit(0))


def _pattern_hits(text: Column, value: Column) -> Column:
    """Start and text of a value's mentions by one pattern, with the square brackets around them."""
    mention = bound(flexible(value), lambda p: F.concat(F.lit("【(?:"), p, F.lit(")】|\\[(?:"), p, F.lit(")\\]|"), p))
    return scan_java(text, mention)


def _literal_hits(text: Column, bare: Column, at: Column, value: Column) -> Column:
    """The same for a value without blanks: a literal search in the text without blanks, and each place mapped back."""
    n = F.length(value)

    def placed(h):
        start, end = F.get(at, h["place"]), F.get(at, h["place"] + n - 1) + 1
        closing = F.when(h["before"] == "【", "】").when(h["before"] == "[", "]")
        framed = (h["after"] == closing) & (F.get(at, h["place"] - 1) == start - 1) & (F.get(at, h["place"] + n) == end)
        return F.struct(start.alias("start"), end.alias("end"), F.coalesce(framed, F.lit(False)).alias("framed"), h["before"].alias("before"), h["after"].alias("after"))

    def hit(h):
        inner = F.when(h["end"] - h["start"] == n, value).otherwise(F.substr(text, h["start"] + 1, h["end"] - h["start"]))
        return F.struct(
            F.when(h["framed"], h["start"] - 1).otherwise(h["start"]).alias("start"), F.when(h["framed"], F.concat(h["before"], inner, h["after"])).otherwise(inner).alias("value")
        )

    return F.transform(F.transform(literal_places(bare, value), placed), hit)


def mention_candidates(text: Column, entities: Column) -> Column:
    """All mentions of the entities, in their order.

    Blanks may lie between a name's characters. The text is freed of its blanks once, for all entities; each is then a literal
    search in it. A value that holds blanks itself is still searched by its pattern. A null text or array has no mentions.
    """
    default = F.create_map(*[F.lit(x) for k, v in fixed.CATEGORIES.items() for x in (k, v[1])])

    def in_free(free):
        def of(entity):
            value, shown = entity["value"], F.coalesce(entity["placeholder"], F.element_at(default, entity["category"]))
            hits = F.when(value.rlike(f"[{BLANK}]"), _pattern_hits(text, value)).when(value != "", _literal_hits(text, free["bare"], free["at"], value))
            return F.transform(F.coalesce(hits, none(HIT)), lambda h: candidate(h["start"], h["value"], entity["category"], shown))

        return F.flatten(F.transform(entities, of))

    return F.when((F.size(entities) > 0) & text.isNotNull(), bound(without_blanks(text), in_free)).otherwise(none(CANDIDATE))


__all__ = ["assigned_parties", "cleaned", "declared_roles", "extract", "flexible", "mention_candidates", "party_aliases", "preamble", "related_entities", "with_labelled_parties"]
