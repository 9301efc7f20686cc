"""Cleaning rules as column expressions.

Each takes a text column (or its name) and returns a column, and never fails
on bad text. What a rule uses several times it works out once (``once``).
That also keeps a wide cleaning projection from being fused into one method,
which would be too large for the JVM's compiler.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from salesprism.functions import fixed_values as fixed

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# A text whose ends are printable ASCII and no space, with nothing but such and spaces between.
TIDY = r"^[!-~]([ -~]*[!-~])?\z"
# A day in digits only: no time of day and no month name.
DIGITS_ONLY = r"^[0-9/.-]+\z"
# A date, and after it perhaps a time of day with AM or PM.
DATE_AND_TIME = r"^(.*?)(?:(?:\s+|T)([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]{1,9})?))?\s*([AaPp][Mm])?)?$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with ``value`` worked out once a row however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def first_match(pairs, value: Column, test) -> Column:
    """CASE over ``(pattern, label)`` pairs in order; null when none matches."""
    return reduce(
        lambda chain, pair: chain.when(test(value, pair[0]), F.lit(pair[1])),
        pairs[1:],
        F.when(test(value, pairs[0][0]), F.lit(pairs[0][1])),
    )


def strip(c: Column | str) -> Column:
    """Text without outer white space of any kind: tabs, line breaks, no-break spaces."""
    return once(_col(c).cast("string"), lambda text: F.when(text.rlike(TIDY), text).otherwise(
        F.regexp_replace(text, r"(?U)^\s+|\s+$", "")))


def normalize_space(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def _number_in(text: Column, pattern: str, group: int) -> Column:
    """A group of a match as a double; no text that is no number is cast, which would cost an exception a row."""
    return once(F.regexp_extract(text, pattern, group), lambda part: F.when(part != "", part)).try_cast("double")


def to_number(c: Column | str) -> Column:
    """A finite double, or null for anything that is not a plain number."""
    # the pattern lets no word and no other spelling of a number through, so a cast of its match is finite or too large
    return once(_number_in(strip(c), NUMBER, 0), lambda n: F.when(F.abs(n) < float("inf"), n))


def clean_price(c: Column | str) -> Column:
    """The number left once currency signs and commas are gone.

    Blanks and words such as "price on request", "n/a" or "null" are not
    numbers, so they need no rule of their own.
    """
    return to_number(F.translate(_col(c), fixed.CURRENCY_SIGNS, ""))


def category_bucket(c: Column | str) -> Column:
    """The first keyword bucket in one text column, else null.

    The keywords are single words, so spacing and separators do not matter.
    """
    def any_word(text: Column, words: str) -> Column:
        return reduce(lambda a, b: a | b, [text.contains(w) for w in words.split("|")])

    return first_match(fixed.CATEGORY_KEYWORDS, F.lower(_col(c)), any_word)


def clean_category(*sources: Column | str) -> Column:
    """Category, then subcategory, then product name; ``Other`` when none says."""
    return F.coalesce(*[category_bucket(s) for s in sources], F.lit("Other"))


def title_case(c: Column | str) -> Column:
    """Upper-case each letter that follows a non-letter, lower-case the rest.

    ``initcap`` only sees spaces, so other separators get one for its sake.
    """
    opened = F.regexp_replace(_col(c), r"([^\p{L} ])(?=\p{L})", "$1\u0001 ")
    return F.replace(F.initcap(opened), F.lit("\u0001 "), F.lit(""))


def clean_city(c: Column | str) -> Column:
    fixes = F.create_map(*[F.lit(v) for pair in {**fixed.CITY_FIXES, "": "Unknown"}.items() for v in pair])
    return once(title_case(normalize_space(c)), lambda tidy: F.coalesce(
        F.try_element_at(fixes, tidy), tidy, F.lit("Unknown")))


def clean_payment(c: Column | str, strict: bool = False) -> Column:
    """Payment family. ``strict`` corrects the over-matching of the word PAY.

    The patterns allow one space; the raw text may have several.
    """
    pairs = fixed.STRICT_PAYMENT_PATTERNS if strict else fixed.PAYMENT_PATTERNS
    found = first_match(pairs, _col(c), lambda v, p: v.rlike("(?i)" + p.replace(" ?", r"\s*")))
    return F.coalesce(found, F.lit("Other"))


def clean_bool(c: Column | str) -> Column:
    """Yes words; of a number, whether its whole part is 1 (the text ``1.0`` is no yes word)."""
    text = F.lower(strip(c))
    kind = F.typeof(_col(c))  # a constant of the plan
    numeric = kind.isin("tinyint", "smallint", "int", "bigint", "float", "double") | kind.startswith("decimal")
    number = F.when(numeric, text.try_cast("double"))
    return F.coalesce(((number >= 1) & (number < 2)) | text.isin(*fixed.YES_WORDS), text.isin(*fixed.YES_WORDS), F.lit(False))


def clean_flag(c: Column | str) -> Column:
    """0/1 integer: yes and no words, else the number's whole part, else 0."""
    text = F.lower(strip(c))
    return (
        F.when(text.isin(*fixed.FLAG_ONE_WORDS), F.lit(1))
        .when(text.isin(*fixed.FLAG_ZERO_WORDS), F.lit(0))
        .otherwise(F.coalesce(to_number(text).try_cast("int"), F.lit(0)))
    )


def clean_rating(c: Column | str) -> Column:
    """Stars out of 5: a number is capped at 5, ``a/b`` is scaled to 5, 0 or less is null."""
    fraction = r"^\s*([0-9]+(?:\.[0-9]+)?) */ *([0-9]+(?:\.[0-9]+)?)"

    def stars(text: Column) -> Column:
        top, bottom = _number_in(text, fraction, 1), _number_in(text, fraction, 2)
        return F.coalesce(
            once(to_number(text), lambda n: F.when(n > 0, F.least(n, F.lit(5.0)))),
            once(F.try_divide(top, bottom) * 5.0, lambda n: F.when(n.isNotNull(), F.bround(F.least(n, F.lit(5.0)), 2))))

    return once(F.regexp_replace(F.lower(_col(c)), fixed.RATING_NOISE, ""), stars)


def date_pieces(c: Column | str) -> Column:
    """The canonical day and the time of day of a date text, piece by piece, as a struct."""
    months = "|".join(m[:3] + (f"(?:{m[3:]})?" if m[3:] else "") for m in fixed.MONTH_NAMES).replace("tember)?", "t(?:ember)?)?")
    gap = "[ ,.-]+"

    def pieces(text: Column, day: Column, *clock: Column) -> Column:
        day = F.replace(F.replace(day, F.lit("/"), F.lit("-")), F.lit("."), F.lit("-"))
        for digits, century in ((fixed.YEARS_OF_1900S, "19"), (fixed.YEARS_OF_2000S, "20")):
            day = F.regexp_replace(day, rf"^(?<day>[0-9]{{1,2}}-[0-9A-Za-z]{{1,3}}-)(?<year>{digits})$", f"${{day}}{century}${{year}}")
        named = zip(("hour", "minute", "second", "half"), clock, strict=True)
        return F.struct(F.replace(text, F.lit("/"), F.lit("-")).alias("whole"), day.alias("day"), *[v.alias(name) for name, v in named])

    def cut(text: Column) -> Column:
        day, hour, minute, second, half = [F.regexp_extract(text, DATE_AND_TIME, group) for group in range(1, 6)]
        day = F.regexp_replace(day, rf"(?i)^({months}){gap}([0-9]{{1,2}}){gap}([0-9]+)$", "$2 $1 $3")
        day = F.regexp_replace(day, rf"(?i)^([0-9]{{1,2}}){gap}(?=(?:{months}){gap}[0-9]+$)([a-z]{{3}})[a-z]*{gap}", "$1-$2-")
        return F.when(text.rlike(DIGITS_ONLY), pieces(text, text, *[F.lit("")] * 4)).otherwise(
            pieces(text, day, hour, minute, second, F.lower(half)))

    return once(strip(c), cut)


def date_from_pieces(p: Column) -> Column:
    """Day-first layouts, then month-first, chosen by the shape of each row's text; a time of day may follow.

    The shape test keeps a layout from being tried on text it cannot fit: a
    failed parse is an exception, far dearer than a pattern match.
    """
    day, half = p["day"], p["half"]
    chain = F.when(day.rlike(fixed.ISO_DATE), day.try_cast("timestamp"))
    for shape, layouts in fixed.DATE_SHAPES:
        chain = chain.when(day.rlike(shape), F.coalesce(*[F.try_to_timestamp(day, F.lit(f)) for f in layouts]))
    hour = p["hour"].try_cast("int")
    hour = F.when(half == "", hour).when(hour.between(1, 12), hour % 12 + F.when(half == "pm", 12).otherwise(0))
    clock = F.when(p["hour"] == "", "00:00:00").otherwise(F.concat(
        F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), p["minute"], F.lit(":"),
        F.when(p["second"] == "", "00").otherwise(p["second"])))
    return F.when(p["whole"].rlike(fixed.ISO_DATE) & (half == ""), p["whole"].try_cast("timestamp")).otherwise(
        F.concat(F.date_format(chain, "yyyy-MM-dd "), clock).try_cast("timestamp"))


def parse_date(c: Column | str) -> Column:
    """A date text as a timestamp; null if no layout fits."""
    return once(date_pieces(c), date_from_pieces)


def clean_delivery_days(c: Column | str) -> Column:
    span = r"^([0-9]+)\s*-\s*([0-9]+)"

    def days(text: Column) -> Column:
        low, high = _number_in(text, span, 1), _number_in(text, span, 2)
        lead = _number_in(text, r"^([0-9]+)", 1)
        return F.coalesce(
            F.when(text.isin(*fixed.SAME_DAY_WORDS), F.lit(0.0)),
            (low + high) / 2,
            once(lead, lambda n: F.when(n <= fixed.MAX_DELIVERY_DAYS, n)))

    return once(F.lower(strip(c)), days)


def value_segment(c: Column | str) -> Column:
    amount = _col(c)
    chain = F.when(amount.isNull() | F.isnan(amount.cast("double")), "Unknown")
    for bound, label in fixed.VALUE_SEGMENTS:
        chain = chain.when(amount <= bound, label)
    return chain.otherwise("Luxury")


def final_amount(*columns: Column | str) -> Column:
    """The first amount that is there, else 0."""
    return F.coalesce(*[_col(c) for c in columns], F.lit(0.0))


def date_parts(c: Column | str) -> dict[str, Column]:
    date = _col(c)
    return {
        "order_year": F.year(date),
        "order_month_num": F.month(date),
        "order_quarter": F.quarter(date),
        "month_label": F.date_format(date, "yyyy-MM"),
        "month_name": F.date_format(date, "MMM"),
    }


def month_start(c: Column | str) -> Column:
    return F.trunc(F.to_date(_col(c)), "month")


def days_between(later: Column, earlier: Column) -> Column:
    """Whole days elapsed, rounded down, for timestamps with or without a time zone."""
    gap = later - earlier
    days = F.extract(F.lit("DAY"), gap).cast("int")
    return days - F.when(gap < F.make_dt_interval(days), 1).otherwise(0)


def percent(part: Column, whole: Column) -> Column:
    """``100 * part / whole``, 0 when ``whole`` is 0 or null."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def flag_label(c: Column | str, yes: str, no: str) -> Column:
    return F.when(_col(c), yes).otherwise(no)


def is_festival_event(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike("(?i)(" + "|".join(fixed.FESTIVAL_WORDS) + ")"), F.lit(False))


def is_returned(c: Column | str, report: str = "returns") -> Column:
    """Whether a return status counts as returned in the named report.

    ``insights`` compares the exact word; the others ignore case, and
    ``returns`` also ignores outer space.
    """
    status = _col(c).cast("string")
    if report == "insights":
        hit = status == "Returned"
    else:
        text = F.lower(strip(status)) if report == "returns" else F.lower(status)
        hit = text.isin(*fixed.RETURN_WORDS[report])
    return F.coalesce(hit, F.lit(False))
