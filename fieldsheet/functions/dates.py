"""Dates with their given precision.

Accepted single values (grammar)::

    YYYY                      year
    YYYY-MM                   month
    YYYY-MM-DD  YYYY/MM/DD  YYYYMMDD                 day
    YYYY-MM-DD[T ]HH:MM[:SS[.f]][Z|+HH:MM]           time
    D Month YYYY   Month D, YYYY   M/D/YYYY          day (D/M/YYYY if the first number exceeds 12)
    Month YYYY                month, read as its first day

Month names are full English names or their three-letter forms. Anything else is not a date.
"""

from pyspark.sql import Column, functions as F

from .text import let, strip

# English month names and their starts.
MONTH_NAME = (r"(?i)^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sep(t(ember)?)?|oct(ober)?|"
              r"nov(ember)?|dec(ember)?)$")
MONTH_STARTS = "janfebmaraprmayjunjulaugsepoctnovdec"

YEAR = r"^(\d{4})$"
YEAR_MONTH = r"^(\d{4})-(\d{2})$"
ISO_DAY = r"^(\d{4})-(\d{1,2})-(\d{1,2})$"
SLASH_DAY = r"^(\d{4})/(\d{1,2})/(\d{1,2})$"
COMPACT_DAY = r"^(\d{4})(\d{2})(\d{2})$"
ISO_TIME = r"^(\d{4})-(\d{2})-(\d{2})[T ]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?\s?(Z|[+-]\d{2}:?\d{2})?$"
DAY_MONTH_YEAR = r"^(\d{1,2})(?:st|nd|rd|th)?[ -]([A-Za-z]{3,9})\.?,?[ -](\d{4})$"
MONTH_DAY_YEAR = r"^([A-Za-z]{3,9})\.? (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})$"
MONTH_YEAR = r"^([A-Za-z]{3,9})\.?,? (\d{4})$"
NUMBERS_YEAR = r"^(\d{1,2})/(\d{1,2})/(\d{4})$"
# What stands between the two ends of a written range.
BETWEEN = ["to", "-", "–"]
RANGE_WORD = r"\s(?:" + "|".join(BETWEEN) + r")\s"
# Forms of one end of a temporal scope, with what each group is (M: a month's name).
SCOPE_FORMS = [(ISO_DAY, "ymd"), (SLASH_DAY, "ymd"), (r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})$", "dMy"), (r"^([A-Za-z]+)\s+(\d{1,2})\s+(\d{4})$", "Mdy"),
               (YEAR_MONTH, "ym"), (YEAR, "y")]


def month_number(name: Column) -> Column:
    """1–12 as text for an English month name or its first three letters, else null."""
    place = F.position(F.left(F.lower(name), F.lit(3)), F.lit(MONTH_STARTS))
    return F.when(name.rlike(MONTH_NAME), F.floor((place + 2) / 3).cast("string"))


def _day_text(year: Column, month: Column, day: Column) -> Column:
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"),
                    F.lit("-"), F.lpad(day.cast("string"), 2, "0"))


def _to_date(text: Column) -> Column:
    return F.when(~text.startswith("0000"), text.try_cast("date"))


def make_day(year: Column, month: Column, day: Column) -> Column:
    """Calendar date from text or number parts; impossible dates become null."""
    return _to_date(_day_text(year, month, day))


def _part(c, pattern, i):
    return F.regexp_extract(c, pattern, i)


def _read(t: Column) -> Column:
    """Struct (text, precision): the value as ``Y[-M[-D]]`` by the grammar above, null if no form fits."""
    def form(text, precision):
        return F.struct(text.alias("text"), F.lit(precision).alias("precision"))

    one, two = _part(t, NUMBERS_YEAR, 1), _part(t, NUMBERS_YEAR, 2)
    swap = one.try_cast("int") > 12
    return (F.when(t.rlike(ISO_DAY), form(t, "day"))
            .when(t.rlike(YEAR), form(t, "year"))
            .when(t.rlike(YEAR_MONTH), form(t, "month"))
            .when(t.rlike(ISO_TIME), form(F.left(t, F.lit(10)), "time"))
            .when(t.rlike(SLASH_DAY), form(F.replace(t, F.lit("/"), F.lit("-")), "day"))
            .when(t.rlike(COMPACT_DAY), form(F.regexp_replace(t, COMPACT_DAY, "$1-$2-$3"), "day"))
            .when(t.rlike(DAY_MONTH_YEAR), form(_day_text(
                _part(t, DAY_MONTH_YEAR, 3), month_number(_part(t, DAY_MONTH_YEAR, 2)), _part(t, DAY_MONTH_YEAR, 1)), "day"))
            .when(t.rlike(MONTH_DAY_YEAR), form(_day_text(
                _part(t, MONTH_DAY_YEAR, 3), month_number(_part(t, MONTH_DAY_YEAR, 1)), _part(t, MONTH_DAY_YEAR, 2)), "day"))
            .when(t.rlike(NUMBERS_YEAR), form(_day_text(
                _part(t, NUMBERS_YEAR, 3), F.when(swap, two).otherwise(one), F.when(swap, one).otherwise(two)), "day"))
            .when(t.rlike(MONTH_YEAR), form(_day_text(
                _part(t, MONTH_YEAR, 2), month_number(_part(t, MONTH_YEAR, 1)), F.lit("01")), "named month")))


def date_value(c: Column, iso: bool = False) -> Column:
    """Struct (start, end, precision) of one date text and, if wanted, its ISO form; null if it is not a date."""
    def spanned(t, r, d):
        p = r["precision"]
        text = (F.when(p.isin("year", "month"), t).when(p == "named month", F.left(d.cast("string"), F.lit(7)))
                .when(p == "time", F.replace(t, F.lit(" "), F.lit("T"))).otherwise(d.cast("string")))
        fields = [
            d.alias("start"),
            F.when(p == "day", d).when(p == "year", F.date_sub(F.add_months(d, 12), 1))
            .when(p == "month", F.last_day(d)).otherwise(d).alias("end"),
            F.when(p == "named month", F.lit("month")).otherwise(p).alias("precision")]
        return F.when(d.isNotNull(), F.struct(*fields, *([text.alias("iso")] if iso else [])))

    return let(strip(c.cast("string")), lambda t: let(
        _read(t), lambda r: let(_to_date(r["text"]), lambda d: spanned(t, r, d))))


def _sides(t: Column) -> Column:
    """Struct (left, right) of ``start/end``; a short end borrows year or year-month from the start."""
    head = F.substring_index(t, "/", 1)
    split = F.struct(strip(head).alias("left"), strip(F.substr(t, F.length(head) + 2)).alias("right"))

    def borrowed(s):
        left, right = s["left"], s["right"]
        day, month = left.rlike(r"^\d{4}-\d{2}-\d{2}$"), left.rlike(r"^\d{4}-\d{2}$")
        full = (F.when(day & right.rlike(r"^\d{1,2}$"), F.concat(F.left(left, F.lit(8)), F.lpad(right, 2, "0")))
                .when(month & right.rlike(r"^\d{2}$"), F.concat(F.left(left, F.lit(5)), right))
                .when(day & right.rlike(r"^\d{2}-\d{2}$"), F.concat(F.left(left, F.lit(5)), right))
                .otherwise(right))
        return F.struct(left.alias("left"), full.alias("right"))

    return let(split, borrowed)


def _plain_day(c: Column):
    """Whether a text is a calendar day in its usual form, and that day: the common case, kept in generated code."""
    text = c.cast("string")
    d = _to_date(text)
    return text.rlike(r"^\d{4}-\d{2}-\d{2}$") & d.isNotNull(), d


def _parts(t: Column, words: bool) -> Column:
    """Array of the one or two single values a text consists of."""
    two = t.contains("/") & ~t.rlike(SLASH_DAY) & ~t.rlike(NUMBERS_YEAR) if not words else t.contains("/")
    out = F.when(two, let(_sides(t), lambda s: F.array(s["left"], s["right"])))
    return (out.when(t.rlike(RANGE_WORD), F.split(t, RANGE_WORD, 2)) if words else out).otherwise(F.array(t))


def event_date(c: Column) -> Column:
    """Struct (iso, start, end, precision, ok) of an event date: a single value or ``start/end``."""
    day, none = F.lit(None).cast("date"), F.lit(None).cast("string")

    def result(t, v):
        """``v`` holds one value or two."""
        ranged = F.size(v) == 2
        last = F.element_at(v, -1)
        good = F.struct(
            F.when(ranged, F.concat(v[0]["iso"], F.lit("/"), last["iso"])).otherwise(last["iso"]).alias("iso"),
            v[0]["start"].alias("start"), last["end"].alias("end"),
            F.when(ranged, F.lit("range")).otherwise(last["precision"]).alias("precision"), F.lit(True).alias("ok"))
        bad = F.struct(t.alias("iso"), day.alias("start"), day.alias("end"), none.alias("precision"), F.lit(False).alias("ok"))
        return F.when(v[0].isNotNull() & last.isNotNull(), good).otherwise(bad)

    def read(t):
        return let(F.transform(_parts(t, False), lambda x: date_value(x, True)), lambda v: result(t, v))

    plain, d = _plain_day(c)
    quick = F.struct(c.cast("string").alias("iso"), d.alias("start"), d.alias("end"), F.lit("day").alias("precision"), F.lit(True).alias("ok"))
    return F.when(plain, quick).otherwise(let(strip(c.cast("string")), read))


def date_bounds(c: Column) -> Column:
    """Struct (start, end) covered by a date or an interval text; reversed intervals are swapped.

    A month given by name stands for its first day.
    """
    def valued(x):
        return let(date_value(x), lambda v: F.when(v.isNotNull(), F.struct(
            v["start"].alias("start"),
            F.when((v["precision"] == "month") & ~x.rlike(YEAR_MONTH), v["start"]).otherwise(v["end"]).alias("end"))))

    def ordered(v):
        a, b = v[0], F.element_at(v, -1)
        return F.when(a.isNotNull() & b.isNotNull(), F.struct(
            F.least(a["start"], b["end"]).alias("start"), F.greatest(a["start"], b["end"]).alias("end")))

    plain, d = _plain_day(c)
    return F.when(plain, F.struct(d.alias("start"), d.alias("end"))).otherwise(
        let(strip(c.cast("string")), lambda t: let(F.transform(_parts(t, True), valued), ordered)))


def ymd_start(year: Column, month: Column, day: Column) -> Column:
    """First day that whole-number year, month and day columns cover, null if a part is impossible; a day without a month is ignored."""
    fine = (year.between(1, 9999) & F.coalesce(month.between(1, 12), F.lit(True))
            & (month.isNull() | F.coalesce(day.between(1, 31), F.lit(True))))
    return F.when(fine, make_day(year, F.coalesce(month, F.lit(1)), F.when(month.isNull(), 1).otherwise(F.coalesce(day, F.lit(1)))))


def ymd_end(start: Column, month: Column, day: Column) -> Column:
    """Last day that the parts cover whose first day is ``start``."""
    return (F.when(month.isNull(), F.date_sub(F.add_months(start, 12), 1))
            .when(day.isNull(), F.last_day(start)).otherwise(start))


def ymd_bounds(year: Column, month: Column | None = None, day: Column | None = None) -> Column:
    """Struct (start, end) of whole-number year, month and day columns; impossible parts are ignored."""
    null = F.lit(None).cast("bigint")
    parts = F.struct(year.alias("y"), (null if month is None else month).alias("m"), (null if day is None else day).alias("d"))

    def span(p, start):
        return F.when(start.isNotNull(), F.struct(start.alias("start"), ymd_end(start, p["m"], p["d"]).alias("end")))

    return let(parts, lambda p: let(ymd_start(p["y"], p["m"], p["d"]), lambda s: span(p, s)))


def _scope_end(token: Column, is_end: bool, whole: Column | None = None) -> Column:
    """The day that one end of a scope names: the first or last day of the period that is written.

    A bare day takes month and year from ``whole``, the other end.
    """
    def day(t, form, parts):
        group = {p.lower(): _part(t, form, i) for i, p in enumerate(parts, 1)}
        month = group.get("m", F.lit("12" if is_end else "01"))
        month = month_number(month) if "M" in parts else month
        if "d" in group:
            return make_day(group["y"], month, group["d"])
        first = make_day(group["y"], month, F.lit("01"))
        return F.last_day(first) if is_end else first

    def read(t):
        out = F.lit(None).cast("date")
        for form, parts in reversed(SCOPE_FORMS):
            out = F.when(t.rlike(form), day(t, form, parts)).otherwise(out)
        if whole is not None:
            out = F.when(t.rlike(r"^\d{1,2}$"), make_day(F.year(whole), F.month(whole), t)).otherwise(out)
        return out

    return let(F.regexp_replace(strip(token), r"^[,.;:]+|[,.;:]+$", ""), read)


def _scope_halves(t: Column) -> Column:
    """Struct (left, right) of a text cut at the first connector that has text on both sides; nulls if there is none."""
    none = F.lit(None).cast("string")
    out = F.struct(none.alias("left"), none.alias("right"))
    for mark in ["/"] + [f" {w} " for w in BETWEEN]:  # the last one that fits wins: a long dash before a hyphen, a hyphen before a word
        at = F.position(F.lit(mark), t)
        sides = F.struct(strip(F.left(t, at - 1)).alias("left"), strip(F.substr(t, at + len(mark))).alias("right"))
        out = F.when((at > 0) & (sides["left"] != "") & (sides["right"] != ""), sides).otherwise(out)
    return out


def scope_dates(c: Column) -> Column:
    """Struct (kind, start, end) of a free temporal scope: ``range``, ``single`` or null.

    ISO days anywhere in the text come first: two or more give the range from the first to the last.
    Else the text is one period or two with a connector between them.
    """
    def scope(kind, a, b=None):
        return F.struct(F.lit(kind).alias("kind"), a.alias("start"), (F.lit(None).cast("string") if b is None else b).alias("end"))

    def text(d):
        return F.date_format(d, "yyyy-MM-dd")

    def written(t):
        ends = let(_scope_halves(t), lambda h: let(_scope_end(h["right"], True), lambda e: F.struct(_scope_end(h["left"], False, e).alias("a"), e.alias("b"))))
        both = let(ends, lambda e: F.when(e["a"].isNotNull() & e["b"].isNotNull(), scope("range", text(e["a"]), text(e["b"]))))
        return F.coalesce(both, let(_scope_end(t, False), lambda one: F.when(one.isNotNull(), scope("single", text(one)))))

    def read(t):
        days = F.regexp_extract_all(t, F.lit(r"\b(\d{4}-\d{2}-\d{2})\b"), F.lit(1))
        return let(days, lambda d: F.when(F.size(d) > 1, scope("range", d[0], F.element_at(d, -1))).when(F.size(d) == 1, scope("single", d[0])).otherwise(written(t)))

    return let(strip(c), read)
