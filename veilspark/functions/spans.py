"""Span scans, candidates, overlap resolution and replacement, all inside the document's row.

Offsets are 0-based code points, the end exclusive. A candidate is a struct (start, end, value,
category, placeholder); its place in the candidate array is its order of insertion.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed
from .dialect import BLANK, BLANKS, CJK, MARKS, escaped, extract, java, matches, trim

HIT = "array<struct<start:int,value:string>>"
FRAGMENTS = "array<struct<start:int,value:string,digit:boolean,digits:boolean>>"
PLACE = "array<struct<place:int,before:string,after:string>>"
FIELD = "array<struct<start:int,whole:string,value:string>>"
CLAUSE = "array<struct<line_start:int,line_end:int,start:int,end:int>>"
CANDIDATE = "array<struct<start:int,end:int,value:string,category:string,placeholder:string>>"


def holds(text: Column, words) -> Column:
    """Whether a text holds one of some words (none of them in ASCII only); a text of ASCII is not searched."""
    return (F.octet_length(text) != F.length(text)) & reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def none(kind: str) -> Column:
    return F.from_json(F.lit("[]"), kind)


RUN = 128
# Characters that no separable rule names; the text between two of them is a fragment.
SEPARATORS = "。；;、！？“”《》为的在"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def in_runs(items: Column) -> Column:
    """An array (a bound one) cut into arrays of RUN items; an empty one is one empty run."""
    last = F.greatest(F.floor((F.size(items) - 1) / F.lit(RUN)).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * RUN + 1, F.lit(RUN)))


def swept(items: Column, state: Column, step, kind: str) -> Column:
    """One pass over an array that carries a state: ``step(state, item)`` gives the next state, an element and whether it is
    kept; the kept elements (of an array of ``kind``) are the result.

    Appending to an array copies it, so each run gathers its own elements and the runs' arrays are joined at the end: for n items
    some n * RUN + (n / RUN)^2 / 2 copied places instead of n^2 / 2.
    """

    def item_step(acc, item):
        after, element, kept = step(acc["state"], item)
        return F.struct(after.alias("state"), F.when(kept, F.array_append(acc["found"], element)).otherwise(acc["found"]).alias("found"))

    def run_step(acc, run):
        inner = F.aggregate(run, F.struct(acc["state"].alias("state"), none(kind).alias("found")), item_step)
        return bound(inner, lambda r: F.struct(r["state"].alias("state"), F.array_append(acc["found"], r["found"]).alias("found")))

    zero = F.struct(state.alias("state"), none(f"array<{kind}>").alias("found"))
    return bound(items, lambda x: F.aggregate(in_runs(x), zero, run_step, lambda acc: F.flatten(acc["found"])))


def starts(parts: Column, gap: int = 0) -> Column:
    """Where each of a text's parts (a bound array) begins, with ``gap`` characters between them, and where the next would.

    A run appends to its own array only, as in ``swept``.
    """

    def run_step(acc, run):
        mine = F.aggregate(run, F.array(acc["at"]), lambda at, part: F.array_append(at, F.element_at(at, -1) + F.length(part) + gap))
        return bound(mine, lambda m: F.struct(F.element_at(m, -1).alias("at"), F.array_append(acc["found"], F.slice(m, 1, F.size(m) - 1)).alias("found")))

    zero = F.struct(F.lit(0).alias("at"), none("array<array<int>>").alias("found"))
    return F.aggregate(in_runs(parts), zero, run_step, lambda acc: F.array_append(F.flatten(acc["found"]), acc["at"]))


def _every(parts: Column, step: int, of, kind: str) -> Column:
    """``of(places, i)`` for each first place i of a match in a text's parts, which come in groups of ``step``."""
    places = lambda p: F.sequence(F.lit(1), F.size(p) - step, F.lit(step))
    return bound(parts, lambda p: F.when(F.size(p) > step, bound(starts(p), lambda at: F.transform(places(p), lambda i: of(p, at, i)))).otherwise(none(kind)))


def _hits(parts: Column) -> Column:
    """Matches and their starts from a text's parts: gap, match, gap and so on."""
    return _every(parts, 2, lambda p, at, i: F.struct(F.get(at, i).alias("start"), F.get(p, i).alias("value")), HIT)


def _fields(parts: Column) -> Column:
    """Label and value matches from a text's parts: gap, label, value, gap and so on."""
    return _every(parts, 3, lambda p, at, i: F.struct(F.get(at, i).alias("start"), F.concat(F.get(p, i), F.get(p, i + 1)).alias("whole"), F.get(p, i + 1).alias("value")), FIELD)


def _marked(text: Column, pattern: Column | str, marked: str, guard: Column | None = None) -> Column:
    """The text with marks around its matches; null, without a search, where the guard says that there are none."""
    out = F.regexp_replace(text, F.lit(pattern) if isinstance(pattern, str) else pattern, marked)
    return out if guard is None else F.when(guard, out)


def _parts(text: Column, marked: Column) -> Column:
    """A marked text (a bound one) split at its marks; empty where it is null or has none."""
    return F.when(marked != text, F.split(marked, MARKS[0])).otherwise(F.array().cast("array<string>"))


WHOLE, LABELLED = f"{MARKS[0]}$0{MARKS[0]}", f"{MARKS[0]}$1{MARKS[0]}$2{MARKS[0]}"


def scan_java(text: Column, pattern: Column | str) -> Column:
    """All matches of a Java pattern (which may be a column) with their starts."""
    return bound(_marked(text, pattern, WHOLE), lambda m: _hits(_parts(text, m)))


def without_blanks(text: Column) -> Column:
    """bare: the text without blanks; at: the place in the text of each character of it."""

    def step(at, part):  # a part has blanks only at its end
        n = F.length(F.rtrim(part, F.lit(BLANKS)))
        return (at + F.length(part)).cast("int"), F.sequence(at, at + n - 1), n > 0

    places = swept(F.split(text, f"(?<=[{BLANK}])(?=[^{BLANK}])"), F.lit(0), step, "array<array<int>>")
    return F.struct(F.regexp_replace(text, f"[{BLANK}]+", "").alias("bare"), F.flatten(places).alias("at"))


def literal_places(text: Column, value: Column) -> Column:
    """Where a value (not empty) stands in a text, from left to right and without overlaps, and the characters before and after it."""

    def step(state, part):  # a part is what lies between two hits; the hit before it is settled here
        after = F.struct((state["end"] + F.length(part) + F.length(value)).cast("int").alias("end"), F.right(F.concat(value, part), F.lit(1)).alias("before"))
        found = F.struct((state["end"] - F.length(value)).cast("int").alias("place"), state["before"].alias("before"), F.left(F.concat(part, value), F.lit(1)).alias("after"))
        return after, found, state["end"] > 0

    return swept(F.split(text, escaped(value)), F.struct(F.lit(0).alias("end"), F.lit("").alias("before")), step, PLACE)


def scan(text: Column, pattern: str, ignore_case: bool = False) -> Column:
    return scan_java(text, ("(?i)" if ignore_case else "") + java(pattern))


def scan_each(text: Column, rules: list[tuple[Column | None, str, bool]]) -> Column:
    """An array of the matches of each rule (guard, pattern, case ignored); one fold serves all."""
    return F.transform(F.array(*[_marked(text, ("(?i)" if ci else "") + java(p), WHOLE, guard) for guard, p, ci in rules]), lambda m: _hits(_parts(text, m)))


def separable(pattern: str) -> bool:
    """Whether a rule names every character that it looks at, and no separator: to it a separator is as a text's end."""
    named = re.sub(r"\\[ds]|\\[^A-Za-z0-9]", "", pattern)
    plain = re.sub(r"\[(?!\^)[^\]]*\]", "", named)
    ranges = [r for inner in re.findall(r"\[([^\]]*)\]", named) for r in re.findall("(.)-(.)", inner)]
    spans_one = any(a < c < b for a, b in ranges for c in SEPARATORS)
    return not (spans_one or re.search(r"[.^$\\]", plain) or "\\" in named or any(c in pattern for c in SEPARATORS))


def fragments(text: Column) -> Column:
    """A text's pieces between separators: start, value, whether there is a digit and whether there are four in a row."""
    each = lambda p, at: F.transform(p, lambda v, i: F.struct(F.get(at, i).alias("start"), v.alias("value"), v.rlike("\\d").alias("digit"), v.rlike("\\d{4}").alias("digits")))
    parts = F.split(F.translate(text, SEPARATORS, SEPARATORS[0] * len(SEPARATORS)), SEPARATORS[0])
    return F.filter(bound(parts, lambda p: bound(starts(p, 1), lambda at: each(p, at))), lambda f: f["value"] != "")


def meets(fragment: Column, needs: tuple) -> Column:
    """Whether a fragment has what a rule can't match without: a flag's name, one of several strings, or a pattern in slashes, for each need."""
    one = lambda n: fragment[n] if n in ("digit", "digits") else fragment["value"].rlike(n[1:-1]) if len(n) > 2 and n[0] == n[-1] == "/" else F.contains(fragment["value"], F.lit(n))
    return reduce(lambda a, b: a & b, [reduce(lambda a, b: a | b, map(one, need)) for need in needs])


def scan_fragments_each(pieces: Column, rules: list[tuple[tuple, str, bool]]) -> Column:
    """An array of the matches of each separable rule (needs, pattern, case ignored), searched only in fragments that meet its needs.

    The fragments of equal needs are joined by a mark and searched in one go; what is between two marks has its fragment's start.
    """
    groups: dict[tuple, list[tuple[str, bool]]] = {}
    for needs, pattern, ci in sorted(rules, key=lambda r: r[0][0] != ("digit",)):
        groups.setdefault(needs, []).append((pattern, ci))
    places = [(list(groups).index(needs), groups[needs].index((pattern, ci))) for needs, pattern, ci in rules]

    def found(pieces, needs, patterns):
        def of(kept):
            text = F.array_join(F.transform(kept, lambda f: f["value"]), MARKS[1])
            starts = F.transform(kept, lambda f: f["start"])
            marked = lambda t: F.array(*[F.regexp_replace(t, F.lit(("(?i)" if ci else "") + java(p)), WHOLE) for p, ci in patterns])
            return F.when(F.size(kept) > 0, bound(text, lambda t: F.transform(marked(t), lambda m: F.when(m != t, F.struct(starts.alias("starts"), F.split(m, MARKS[1]).alias("marked"))))))

        return bound(chosen(pieces, needs), of)

    def of_fragment(part, start):
        several = lambda parts: F.transform(_hits(parts), lambda h: F.struct((h["start"] + start).alias("start"), h["value"].alias("value")))
        single = lambda parts: F.array(F.struct((start + F.length(F.get(parts, F.lit(0)))).cast("int").alias("start"), F.get(parts, F.lit(1)).alias("value")))
        return bound(F.split(part, MARKS[0]), lambda parts: F.when(F.size(parts) == 3, single(parts)).otherwise(several(parts)))

    def of_rule(x):
        each = F.transform(x["marked"], lambda part, i: F.when(F.contains(part, F.lit(MARKS[0])), of_fragment(part, F.get(x["starts"], i))))
        return F.when(x.isNotNull(), F.flatten(F.filter(each, lambda h: h.isNotNull()))).otherwise(none(HIT))

    # Most needs begin with a digit, so these fragments are chosen once.
    chosen = lambda pieces, needs: F.filter(pieces, lambda f: meets(f, needs)) if needs else pieces
    numbers = lambda pieces: bound(F.filter(pieces, lambda f: f["digit"]), lambda d: F.array(*[found(d, n[1:], p) for n, p in groups.items() if n[0] == ("digit",)]))
    others = F.array(*[found(pieces, n, p) for n, p in groups.items() if n[0] != ("digit",)])
    every = F.concat(numbers(pieces), others)
    return bound(every, lambda e: F.transform(F.array(*[F.get(F.get(e, F.lit(g)), F.lit(i)) for g, i in places]), of_rule))


def _field_pattern(before: str, value: str, after: str, flags: str) -> str:
    return f"{flags}({java(before)})({java(value)}){java(after)}"


def scan_fields(text: Column, before: str, value: str, after: str = "", flags: str = "", guard: Column | None = None) -> Column:
    """Matches of label and value: start of the match, the match, the value's group."""
    return bound(_marked(text, _field_pattern(before, value, after, flags), LABELLED, guard), lambda m: _fields(_parts(text, m)))


def scan_fields_each(text: Column, rules: list[tuple[Column | None, str, str, str, str]]) -> Column:
    """An array of the matches of each rule (guard, label, value, what follows, flags); one fold serves all."""
    return F.transform(F.array(*[_marked(text, _field_pattern(*rule), LABELLED, guard) for guard, *rule in rules]), lambda m: _fields(_parts(text, m)))


def candidate(start: Column, value: Column, category: Column | str, placeholder: Column | str) -> Column:
    """A candidate with the value trimmed and its start moved accordingly."""
    clean = trim(value)
    at = start + F.instr(value, clean) - 1
    at = F.when(clean == "", start).otherwise(at).cast("int")
    of = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(at.alias("start"), (at + F.length(clean)).cast("int").alias("end"), clean.alias("value"), of(category).alias("category"), of(placeholder).alias("placeholder"))


def clauses(text: Column) -> Column:
    """Numbering tokens at line starts: line_start, line_end, start, end."""
    ordinal, wrapped, plain = fixed.CLAUSE_ORDINAL, fixed.CLAUSE_WRAPPED, fixed.CLAUSE_PLAIN
    # Each step binds what the next one needs, so that a line's patterns are searched once.
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(F.length(x).alias("n"), x.alias("line"), F.length(F.regexp_extract(x, "^[ \\t　]*(?:#{1,6}[ \\t　]+)?", 0)).alias("lead")))
    lines = F.transform(lines, lambda x: F.struct(x["n"], x["lead"], F.substr(x["line"], x["lead"] + 1).alias("content")))
    lines = F.transform(lines, lambda x: F.struct(x["n"], x["lead"], x["content"], extract(x["content"], f"{ordinal}|{wrapped}|{plain}").alias("token")))
    lines = F.transform(lines, lambda x: F.struct(x["n"], x["lead"], x["token"], F.when(x["token"] != "", F.substr(x["content"], F.length(x["token"]) + 1)).alias("rest")))

    def step(state, x):
        token, rest, begin = x["token"], x["rest"], state["at"] + x["lead"]
        dotted = matches(token, "^\\d+(?:\\s*[.．]\\s*\\d+)+$")
        unit = matches(rest, f"^\\s*(?:{fixed.CLAUSE_UNITS})(?![{CJK}])")
        explicit = matches(token, f"{ordinal}|{wrapped}") | dotted | matches(rest, "^\\s*[.．、:：]") | matches(rest, f"^\\s*[{CJK}]")
        row = F.struct(
            state["at"].cast("int").alias("line_start"), (state["at"] + x["n"]).cast("int").alias("line_end"), begin.cast("int").alias("start"),
            (begin + F.length(token) + F.length(extract(rest, "^\\s*[.．、:：]"))).cast("int").alias("end"),
        )
        is_clause = (token != "") & (dotted | ~unit) & explicit
        return F.struct((state["at"] + x["n"] + 1).cast("int").alias("at")), row, is_clause

    return swept(lines, F.struct(F.lit(0).alias("at")), step, CLAUSE)


def resolved(candidates: Column, clause_spans: Column | None, strict: bool = False) -> Column:
    """Candidates without clause numbers, overlaps settled: start, longer, priority, insertion order; greedily.

    ``strict`` keeps phone, date and id candidates that look like clause numbers.
    """
    priority = F.create_map(*[F.lit(x) for pair in fixed.PRIORITY.items() for x in pair])
    of = lambda kind: kind.removeprefix("array<").removesuffix(">")
    none_of = lambda kind: F.lit(None).cast(of(kind))
    item = lambda at, rank, c, k: F.struct(at.alias("at"), *[x.alias(f"k{i}") for i, x in enumerate(rank)], c.alias("c"), k.alias("clause"))
    items = F.transform(F.filter(candidates, lambda c: c["value"] != ""), lambda c, i: item(c["start"], (F.lit(1), -c["end"], -F.element_at(priority, c["category"]), i), c, none_of(CLAUSE)))
    if clause_spans is not None:  # a clause's line comes before the candidates that start in it
        zero = F.lit(0)
        items = F.concat(items, F.transform(clause_spans, lambda k, i: item(k["line_start"], (zero, zero, zero, i), none_of(CANDIDATE), k)))

    def step(state, x):
        c, k = x["c"], state["clause"]
        numbering = F.coalesce((c["start"] <= k["line_end"]) & (c["start"] < k["end"]) & (c["end"] > k["start"]), F.lit(False))
        if strict:
            numbering &= ~c["category"].isin("phone", "date", "idCard")
        taken = c.isNotNull() & (c["start"] >= state["end"]) & ~numbering
        after = F.struct(F.when(taken, c["end"]).otherwise(state["end"]).alias("end"), F.coalesce(x["clause"], k).alias("clause"))
        return after, c, taken

    return swept(F.sort_array(items), F.struct(F.lit(0).alias("end"), none_of(CLAUSE).alias("clause")), step, CANDIDATE)


def applied(text: Column, spans: Column) -> Column:
    """The text with its spans (in order, disjoint) replaced by their placeholders.

    A run of spans is cut out of the text once and its pieces out of that.
    """
    shown = lambda m: F.coalesce(F.nullif(m["placeholder"], F.lit("")), F.lit(fixed.DELETED))

    def of(every):
        last = F.get(every, F.size(every) - 1)["end"]
        begin = lambda run: F.when(run == 0, F.lit(0)).otherwise(F.get(every, run * RUN - 1)["end"])

        def run_text(mine, run):
            def cut(b):
                gap = lambda i: F.when(i == 0, b["at"]).otherwise(F.get(mine, i - 1)["end"])
                return F.array_join(F.transform(mine, lambda m, i: F.concat(F.substr(b["part"], gap(i) - b["at"] + 1, m["start"] - gap(i)), shown(m))), "")

            return bound(F.struct(begin(run).alias("at"), F.substr(text, begin(run) + 1, F.get(mine, F.size(mine) - 1)["end"] - begin(run)).alias("part")), cut)

        return F.when(F.size(every) == 0, text).otherwise(F.concat(F.array_join(F.transform(in_runs(every), run_text), ""), F.substr(text, last + 1)))

    return bound(spans, of)


def match_id(span: Column) -> Column:
    return F.concat_ws("-", span["category"], span["start"].cast("string"), (span["end"] - span["start"]).cast("string"))


__all__ = ["BLANK", "applied", "bound", "candidate", "clauses", "match_id", "none", "resolved", "scan", "scan_each", "scan_fields", "scan_fields_each", "scan_java", "swept"]
