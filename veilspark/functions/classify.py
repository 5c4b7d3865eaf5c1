"""Document types from headings and keywords, and their display names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .dialect import extract, matches, replace, trim


def _heading_type(line: Column) -> Column:
    clean = trim(replace(line, "^\\s*#{1,6}\\s*"))
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(fixed.HEADING_TYPES):
        kind = F.when(matches(clean, pattern), name).otherwise(kind)
    return F.when(matches(clean, fixed.HEADING), kind)


def document_type(text: Column, manual: Column | None = None) -> Column:
    """The type; a manual label, if given, stands for the headings and is searched with the text."""
    lines = F.slice(F.split(text, "\n"), 1, 8) if manual is None else F.array(manual)
    heading = F.get(F.filter(F.transform(lines, _heading_type), lambda t: t.isNotNull()), F.lit(0))
    source = text if manual is None else F.concat(manual, F.lit("\n"), text)
    score = lambda terms: sum((F.contains(source, F.lit(t)).cast("int") for t in terms), F.lit(0))
    tech, purchase = score(fixed.TECH_TERMS), score(fixed.PURCHASE_TERMS)
    words = F.when(~matches(source, fixed.CONTRACT_WORD), "generic").when((tech == 0) & (purchase == 0), "contract").when(tech > purchase, "tech").otherwise("purchase")
    return F.coalesce(heading, words)


def type_label(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in fixed.TYPES.items() for x in pair]), kind), F.lit(fixed.TYPES["generic"]))


def type_name(text: Column, kind: Column, manual: Column | None = None) -> Column:
    """What the document calls itself, for contracts; the type's label otherwise."""
    if manual is not None:
        return manual
    lines = F.slice(F.split(text, "\n"), 1, 30)
    names = F.transform(lines, lambda x: extract(trim(replace(replace(x, "^\\s*(?:#{1,6}|\\|)\\s*"), "\\|[^\\n\\r\\u2028\\u2029]*$")), fixed.TYPE_NAME))
    own = F.get(F.filter(names, lambda n: (n != "") & ~matches(n, fixed.SELF_REFERENCE)), F.lit(0))
    return F.when(kind.isin("contract", "tech", "purchase"), F.coalesce(own, type_label(kind))).otherwise(type_label(kind))
