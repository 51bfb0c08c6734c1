"""Text functions as column expressions: folding, clock times, extraction, keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from quarry.functions.dates import WEEKDAYS

#: Arabic letters that are written in several ways, and what each is folded to.
FOLD_FROM, FOLD_TO = "أإآٱىةؤئ", "اااايهوي"
#: Arabic-Indic and Persian digits.
DIGITS_FROM, DIGITS_TO = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789"
#: Marks that are dropped: vowel signs, superscript alef, tatweel.
MARKS = r"[ً-ْٰـ]"
#: Prefixes that belong to the name behind them.
GLUED = r"(^| )(عبد|ابو|ابن) "


def fold_digits(c: Column) -> Column:
    return F.translate(c, DIGITS_FROM, DIGITS_TO)


def fold(c: Column) -> Column:
    """Lower case, marks dropped, letter variants unified, everything else one space."""
    letters = F.translate(F.regexp_replace(fold_digits(F.lower(F.coalesce(c, F.lit("")))), MARKS, ""), FOLD_FROM, FOLD_TO)
    return F.trim(F.regexp_replace(letters, r"[^\p{L}\p{N}]+", " "))


def name_key(c: Column) -> Column:
    """fold() with name prefixes joined to what follows."""
    return F.regexp_replace(fold(c), GLUED, "$1$2")


def first_units(c: Column, n: int) -> Column:
    """The first n units of a name."""
    return F.array_join(F.slice(F.split(name_key(c), " "), 1, n), " ")


def clock_minutes(c: Column) -> Column:
    """Minutes of the day of a clock time h:mm or h with am/pm (or ص/م); bare hours 1-6 are afternoon; null if none."""
    t = fold_digits(F.lower(c))
    pattern = r"(\d{1,2})(?:[:.](\d{2}))?\s*(am|pm|ص|م)?"
    hour = F.try_to_number(F.nullif(F.regexp_extract(t, pattern, 1), F.lit("")), F.lit("99")).cast("int")
    minute = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(t, pattern, 2), F.lit("")), F.lit("99")).cast("int"), F.lit(0))
    suffix = F.regexp_extract(t, pattern, 3)
    bare = (suffix == "") & (F.regexp_extract(t, pattern, 2) == "")
    twelve = F.when(suffix.isin("pm", "م") & (hour < 12), hour + 12).when(suffix.isin("am", "ص") & (hour == 12), F.lit(0)).when(bare & hour.between(1, 6), hour + 12).otherwise(hour)
    return F.when((twelve < 24) & (minute < 60), twelve * 60 + minute)


def clock(c: Column) -> Column:
    """HH:MM of a clock time in text, blank if there is none."""
    m = clock_minutes(c)
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.coalesce(F.concat(two(F.floor(m / 60)), F.lit(":"), two(m % 60)), F.lit(""))


def sort_minutes(c: Column) -> Column:
    """Place of a time in a duty day: hours before 6 belong to the night before; unknown times last."""
    m = clock_minutes(c)
    return F.coalesce(F.when(m < 360, m + 1440).otherwise(m), F.lit(48 * 60))


def service_parts(c: Column) -> Column:
    """Sorted distinct parts of a service name written with +."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), r"\+"), fold), lambda x: x != "")))


def compare_parts(a: Column, b: Column) -> Column:
    """exact, superset, overlap or different, by two sets of parts."""
    return F.when(a == b, "exact").when(F.size(F.array_except(b, a)) == 0, "superset").when(F.arrays_overlap(a, b), "overlap").otherwise("different")


def phones(c: Column) -> Column:
    """Distinct mobile numbers in a text: 01 and nine more digits, separators dropped. The pattern is a fixed value."""
    plain = F.regexp_replace(fold_digits(c), r"(?<=\d)[ -](?=\d)", "")
    return F.array_distinct(F.regexp_extract_all(plain, F.lit(r"(?<!\d)(01\d{9})(?!\d)"), F.lit(1)))


def plate(c: Column) -> Column:
    """Canonical plate of up to four forms in order: number letters, letters number, number alone; blank if none.

    The patterns are fixed values.
    """
    t = F.regexp_replace(fold_digits(F.upper(c)), r"[ -]+", " ")
    forms = [F.concat_ws(" ", F.nullif(F.regexp_extract(t, p, letters), F.lit("")), F.nullif(F.regexp_extract(t, p, number), F.lit(""))) for p, letters, number in ((r"(\d{2,4}) ([A-Z]{1,3})\b", 2, 1), (r"\b([A-Z]{1,3}) (\d{2,4})", 1, 2), (r"()\b(\d{3,4})\b", 1, 2))]
    return F.coalesce(*[F.nullif(f, F.lit("")) for f in forms], F.lit(""))


def counted_classes(c: Column) -> Column:
    """array of (n, class) of texts such as '3 guards, 2 drivers'."""
    numbers, classes = (F.regexp_extract_all(fold_digits(F.lower(c)), F.lit(r"(\d+)\s+(\p{L}+)"), F.lit(k)) for k in (1, 2))
    return F.zip_with(numbers, classes, lambda n, k: F.struct(n.cast("int").alias("n"), k.alias("class")))


def split_padded(c: Column, separator: str, n: int) -> Column:
    """n parts of a text; the last one is repeated where there are fewer."""
    parts = F.split(c, separator)
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.element_at(parts, F.least(i, F.size(parts))))


def ordered_subsequence(short: Column, long: Column) -> Column:
    """Whether the tokens of short occur in long in the same order."""
    at = F.aggregate(long, F.lit(1), lambda k, x: F.when((k <= F.size(short)) & (F.get(short, k - 1) == x), k + 1).otherwise(k))
    return at > F.size(short)


#: Names of more tokens than this are running text: they nest with none but themselves.
LONGEST_NAME = 12


def nested_names(a: Column, b: Column) -> Column:
    """Whether two names of three tokens or more share the first two, and the shorter one's tokens stand in the longer one in order."""
    inside = F.when(F.size(a) <= F.size(b), ordered_subsequence(a, b)).otherwise(ordered_subsequence(b, a))
    return (F.size(a) > 2) & (F.size(b) > 2) & (F.slice(a, 1, 2) == F.slice(b, 1, 2)) & ((a == b) | (F.greatest(F.size(a), F.size(b)) <= LONGEST_NAME)) & inside


def choices(tokens: Column, fixed: int, least: int) -> Column:
    """All names of `least` tokens or more that keep the first `fixed` tokens and some, but not all, of the others in order."""
    start = F.array(F.slice(tokens, 1, fixed))
    grown = F.aggregate(F.slice(tokens, fixed + 1, LONGEST_NAME), start, lambda done, t: F.concat(done, F.transform(done, lambda x: F.concat(x, F.array(t)))))
    kept = F.filter(grown, lambda x: (F.size(x) >= least) & (F.size(x) < F.size(tokens)))
    return F.when(F.size(tokens) <= LONGEST_NAME, F.array_distinct(F.transform(kept, lambda x: F.array_join(x, " "))))


def abbreviated(c: Column, short: dict[str, str]) -> Column:
    """The short form of a label, blank if it has none."""
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in short.items() for x in pair]), c), F.lit(""))


def problems(c: Column, longest: int, allowed: str, banned: dict[str, str]) -> Column:
    """What is wrong with a field: too long, charset (it does not match allowed), or a label whose text it contains."""
    found = [F.when(F.length(c) > longest, "too long"), F.when(~c.rlike(allowed), "charset")]
    return F.concat_ws(",", *found, *[F.when(c.contains(x), label) for label, x in banned.items()])


def by_keyword(c: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The label of the first rule of which a keyword occurs in the text."""
    out = F.when(F.lit(False), otherwise)
    for label, words in rules:
        out = out.when(reduce(Column.__or__, [c.contains(w) for w in words]), label)
    return out.otherwise(otherwise)


def in_vocabulary(c: Column, values: Sequence[str], aliases: dict[str, str]) -> Column:
    """(raw, value, flags): the vocabulary's value for a text; flags: alias or unknown."""
    plain = F.lower(F.trim(c))
    known = F.array_contains(F.array(*map(F.lit, values)), plain)
    other = abbreviated(plain, aliases)
    flags = F.when(known, "").when(other != "", "alias").otherwise("unknown")
    return F.struct(c.alias("raw"), F.when(known, plain).otherwise(other).alias("value"), flags.alias("flags"))


def fuzzy_subsequence(short: Column, long: Column, distance: int) -> Column:
    """Whether the tokens of short stand in long in order, each within an edit distance; the first that fits is taken."""
    near = lambda x, k: F.levenshtein(x, F.coalesce(F.get(short, k - 1), F.lit("")), distance) >= 0
    at = F.aggregate(long, F.lit(1), lambda k, x: F.when((k <= F.size(short)) & near(x, k), k + 1).otherwise(k))
    return at > F.size(short)


def common_subsequence(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays, row by row of the usual table."""
    start = F.array_repeat(F.lit(0), F.size(b) + 1)
    cell = lambda row, x: F.aggregate(
        F.sequence(F.lit(0), F.size(b) - 1), F.array(F.lit(0)), lambda done, j: F.concat(done, F.array(F.when(F.get(b, j) == x, F.get(row, j) + 1).otherwise(F.greatest(F.get(row, j + 1), F.element_at(done, -1)))))
    )
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, start, cell), -1))


def token_f1(a: Column, b: Column, cap: float) -> Column:
    """F1 of two arrays of tokens as sets; at most cap if each has numbers and they differ."""
    a, b = F.array_distinct(a), F.array_distinct(b)
    numbers = lambda x: F.array_sort(F.filter(x, lambda t: t.rlike(r"^\d+$")))
    f1 = F.lit(2.0) * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))
    conflict = (F.size(numbers(a)) > 0) & (F.size(numbers(b)) > 0) & (numbers(a) != numbers(b))
    return F.when(conflict, F.least(f1, F.lit(cap))).otherwise(f1)


def leave_interval(c: Column, year: Column) -> Column:
    """(s, e, k, of_n): 'd/M to d/M' of that year, the end a year later if it would come before the start; a counter (k/n).

    Between the dates may stand to, until or a dash, or the Arabic words for them.
    """
    plain = fold_digits(c)
    span, count = r"(\d{1,2})/(\d{1,2})\s*(?:to|until|-|الى|إلى|الي|حتى|حتي)\s*(\d{1,2})/(\d{1,2})", r"\((\d+)/(\d+)\)"
    part = lambda k: F.try_to_number(F.nullif(F.regexp_extract(plain, span, k), F.lit("")), F.lit("99")).cast("int")
    number = lambda k: F.try_to_number(F.nullif(F.regexp_extract(plain, count, k), F.lit("")), F.lit("99")).cast("int")
    day = lambda y, m, d: F.try_to_date(F.format_string("%d-%02d-%02d", y, m, d), "yyyy-MM-dd")
    s, e = F.when(part(1).isNotNull(), day(year, part(2), part(1))), F.when(part(3).isNotNull(), day(year, part(4), part(3)))
    return F.struct(s.alias("s"), F.when(e < s, day(year + 1, part(4), part(3))).otherwise(e).alias("e"), number(1).alias("k"), number(2).alias("of_n"))


#: Marks of direction and joining that are no part of a text.
FORMAT_MARKS = "​‌‍‎‏‪‫‬‭‮﻿"


def dates_in(c: Column) -> Column:
    """All dates of a text as YYYY-MM-DD, in order: yyyy-M-d and d/M/yyyy (or d-M-yyyy); what is no date is left out."""
    plain = fold_digits(F.translate(c, FORMAT_MARKS, ""))
    found = F.regexp_extract_all(plain, F.lit(r"(\d{4}[-/]\d{1,2}[-/]\d{1,2}|\d{1,2}[-/]\d{1,2}[-/]\d{4})"), F.lit(1))
    read = lambda x: F.coalesce(F.try_to_date(F.replace(x, F.lit("/"), F.lit("-")), "yyyy-M-d"), F.try_to_date(F.replace(x, F.lit("/"), F.lit("-")), "d-M-yyyy"))
    return F.filter(F.transform(found, lambda x: F.date_format(read(x), "yyyy-MM-dd")), lambda x: x.isNotNull())


def weekday_in(c: Column) -> Column:
    """The weekday in a text by its English name, blank if there is none; an English one comes before an Arabic one."""
    english = F.regexp_extract(c, r"\b((?:Mon|Tues|Wednes|Thurs|Fri|Satur|Sun)day)\b", 1)
    words = F.split(fold(c), " ")
    found: Column | None = None
    for name, told in zip(WEEKDAYS, ("Saturday", "Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday"), strict=True):
        here = F.array_contains(words, fold(F.lit(name)))
        found = F.when(here, told) if found is None else found.when(here, told)
    return F.when(english != "", english).otherwise(F.coalesce(found.otherwise(""), F.lit("")))


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


def compatible(c: Column) -> Column:
    """Compatibility form with folded digits and single spaces; placeholders (dashes, dots) are blank. No built-in does NFKC."""
    plain = F.trim(F.regexp_replace(fold_digits(_nfkc(c)), r"\s+", " "))
    return F.when(plain.rlike(r"^[-–—._]*$"), "").otherwise(plain)


def name_parts(c: Column, ranks: Sequence[str]) -> Column:
    """(rank, name, time) of a name with a rank before it and a time in brackets behind it; blank if not there."""
    before, behind = rf"^({'|'.join(ranks)})\s*/\s*", r"\s*\(([^()]*)\)$"
    return F.struct(F.regexp_extract(c, before, 1).alias("rank"), F.regexp_replace(F.regexp_replace(c, before, ""), behind, "").alias("name"), clock(F.regexp_extract(c, behind, 1)).alias("time"))


def people_in(c: Column, markers: dict[str, Sequence[str]], stops: Sequence[str]) -> Column:
    """Array of (kind, marker, name, phones, start): people named in a text, each behind a marker of one of the kinds.

    The text is cut where a marker begins, so a person's segment ends where the next marker begins, whichever kind that
    is; start is the marker's place, from 0. Phones are taken out of a segment; its name ends at a sign that separates,
    a word of stops or a number. Segments without a letter in the name are no people.
    """
    every = [m for kind in markers.values() for m in kind]
    mark, cut = rf"\b({'|'.join(every)})\b[./]?\s*", "\x01"
    plain = F.translate(fold_digits(F.coalesce(c, F.lit(""))), "\x01\x02", "  ")
    parts = F.split(F.regexp_replace(plain, rf"\b(?={'|'.join(rf'{m}\b' for m in every)})", cut), cut)
    lengths = F.transform(parts, lambda p: F.length(p))
    phone = r"(?<!\d)(0\s?1(?:[\s-]?\d){8,9})(?!\d)"
    kinds = F.create_map(*[F.lit(x) for k, group in markers.items() for m in group for x in (m, k)])

    def person(p: Column, i: Column) -> Column:
        marker = F.regexp_extract(p, f"^{mark}", 1)
        rest = F.regexp_replace(p, f"^{mark}", "")
        name = F.regexp_replace(F.regexp_replace(rest, phone, " "), rf"(?s)([+;:,()\n\"«»]|\b(?:{'|'.join(stops)})\b|\d).*$", "")
        start = F.aggregate(F.slice(lengths, 1, i), F.lit(0), lambda s, n: s + n)
        phones = F.transform(F.regexp_extract_all(rest, F.lit(phone), F.lit(1)), lambda x: F.regexp_replace(x, r"\D", ""))
        return F.struct(F.element_at(kinds, F.when(marker != "", marker)).alias("kind"), marker.alias("marker"), fold(name).alias("name"), phones.alias("phones"), start.alias("start"))

    return F.filter(F.transform(parts, person), lambda x: (x["marker"] != "") & x["name"].rlike(r"\p{L}"))
