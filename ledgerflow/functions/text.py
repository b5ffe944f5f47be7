"""Text expressions (X2, X9–X14, SRC4).  Built-in functions only; no Python UDFs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# FIXED VALUES: weekday characters of the weekly delivery schedule, 1 = Monday ... 7 = Sunday.
WEEKDAY_NAMES = ("一", "二", "三", "四", "五", "六", "日")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def repair_text(c) -> Column:
    """Text that was decoded as Latin-1 by mistake is re-decoded as UTF-8.  Applied
    only when every character is ≤ U+00FF, at least one is ≥ U+0080, and the bytes form
    valid UTF-8; otherwise the text is unchanged."""
    c = _c(c)
    latin_only = c.rlike(r"^[\x{0000}-\x{00FF}]*$") & c.rlike(r"[\x{0080}-\x{00FF}]")
    raw = F.encode(c, "ISO-8859-1").cast("string")
    return F.when(latin_only, F.when(F.is_valid_utf8(raw), raw).otherwise(c)).otherwise(c)


def schedule_sorted(c) -> Column:
    """X9: '3,1,5' → '1,3,5' (numbers 1..7 only, unique, ascending)."""
    parts = F.transform(F.split(_c(c), ","), lambda x: F.trim(x))
    nums = F.filter(F.transform(parts, lambda x: x.try_cast("int")), lambda x: x.between(1, 7))
    return F.array_join(F.array_sort(F.array_distinct(nums)), ",")


def schedule_days(c) -> Column:
    """Weekly schedule → array of weekday numbers (7 = Sunday)."""
    parts = F.transform(F.split(_c(c), ","), lambda x: F.trim(x).try_cast("int"))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: x.between(1, 7))))


def schedule_names(c) -> Column:
    """X9: '1,3,5' → weekday characters joined by ',' in the given order; tokens that are
    not 1..7 stay as they are; null or blank → ''."""
    m = F.create_map(*[F.lit(x) for i, n in enumerate(WEEKDAY_NAMES, 1) for x in (str(i), n)])
    toks = F.filter(F.transform(F.split(_c(c), ","), lambda x: F.trim(x)), lambda x: x != "")
    names = F.transform(toks, lambda x: F.coalesce(F.element_at(m, x), x))
    return F.when(_c(c).isNull() | (F.trim(_c(c)) == ""), F.lit("")).otherwise(F.array_join(names, ","))


def fmt_quantity(q, unit) -> Column:
    """X10: '12' + 'box'; no unit when it is null or blank.  Whole numbers lose '.0'."""
    q = _c(q).cast("double")
    qs = F.when(q == F.floor(q), q.cast("long").cast("string")).otherwise(q.cast("string"))
    u = _c(unit)
    return F.when(u.isNull() | (F.trim(u) == ""), qs).otherwise(F.concat(qs, u))


def fmt_percent(p) -> Column:
    """Absolute percentage with one decimal and a '%' sign."""
    return F.concat(F.format_number(F.abs(_c(p).cast("double")), 1), F.lit("%"))


def safe_name(c) -> Column:
    """X11: path-hostile characters and blanks → '_'."""
    return F.regexp_replace(F.trim(_c(c)), r'[\\/:*?"<>|\s]+', "_")


def core_name(c) -> Column:
    """Delete parts in round brackets and the marks '-', '_', '/' to get a search term."""
    no_brackets = F.regexp_replace(_c(c), r"[\(（][^\)）]*[\)）]", "")
    return F.trim(F.regexp_replace(no_brackets, r"[-_/]+", ""))


def keywords_from_json(c) -> Column:
    """Keyword payload → distinct trimmed keywords.

    Code fences and // comments are removed; if the rest parses as a JSON object whose
    values are lists of strings, those strings are flattened (keys, i.e. category labels,
    are dropped); otherwise every double-quoted string in the text is taken."""
    text = F.regexp_replace(_c(c), r"```[a-zA-Z]*", "")
    text = F.regexp_replace(text, r"(?m)//[^\n]*$", "")
    parsed = F.from_json(text, "map<string,array<string>>")
    from_json = F.flatten(F.map_values(parsed))
    quoted = F.regexp_extract_all(text, F.lit(r'"([^"]*)"'), 1)
    words = F.when(parsed.isNotNull(), from_json).otherwise(quoted)
    words = F.transform(words, lambda x: F.trim(x))
    return F.array_distinct(F.filter(words, lambda x: x != ""))


def trim_name(c) -> Column:
    """Names with ≥ 4 '_'-separated parts drop the first two parts."""
    parts = F.split(_c(c), "_")
    return F.when(F.size(parts) >= 4, F.array_join(F.slice(parts, 3, 1000000), "_")).otherwise(_c(c))


def chat_file_key(file_name) -> tuple[Column, Column]:
    """SRC4: (customer name, customer id or null) from a chat file name.

    The stem (name without its last extension) is split on '_'.  With 5+ parts the name
    is parts 5 on joined by '_'; if it holds '(' and ')' the id is the text between the
    first '(' and the first ')', unless empty or 'Unknown', and the name is the part
    before '('.  With exactly 4 parts the name is the last part; with 2 or 3 the second;
    otherwise 'Unknown'.  An empty name is 'Unknown'."""
    stem = F.regexp_replace(_c(file_name), r"\.[^.]*$", "")
    parts = F.split(stem, "_")
    n = F.size(parts)
    tail = F.array_join(F.slice(parts, 5, 1000000), "_")
    lp, rp = F.instr(tail, "("), F.instr(tail, ")")
    has = (lp > 0) & (rp > 0)
    ident = F.when(has, F.substr(tail, lp + 1, F.greatest(rp - lp - 1, F.lit(0))))
    name5 = F.when(has, F.trim(F.substr(tail, F.lit(1), lp - 1))).otherwise(tail)
    name = (F.when(n >= 5, name5).when(n == 4, F.element_at(parts, -1))
            .when(n >= 2, F.element_at(parts, 2)).otherwise(F.lit("Unknown")))
    name = F.when((name.isNull()) | (name == ""), F.lit("Unknown")).otherwise(name)
    cid = F.when((n >= 5) & (ident != "") & (ident != "Unknown"), ident)
    return name, cid
