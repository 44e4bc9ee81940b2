"""Canonical forms of field values as native column expressions."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossia.schema import KIND

# Letters that look alike in both alphabets, words that mean "none", and fields written in one alphabet.
CYRILLIC = "АВЕКМНОРСТУХ"
LATIN = "ABEKMHOPCTYX"
NOTHING = ["NULL", "NONE", "N/A", "НЕТ ДАННЫХ"]
LATIN_FIELDS = ["vin", "body", "make_model", "category"]
CYRILLIC_FIELDS = [
    "vehicle_type", "color", "eco_class", "chassis", "engine_type", "owner_last", "owner_first", "owner_middle", "region", "city", "street_address",
    "epts_status",
]
DATE = r"(\d{1,2})\s*[./\-]\s*(\d{1,2})\s*[./\-]\s*(\d{4})"
# Fixed values of ISO 3779: the value of each character, and the weight of each place.
VIN_VALUES = {
    "A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7, "H": 8,
    "J": 1, "K": 2, "L": 3, "M": 4, "N": 5, "P": 7, "R": 9,
    "S": 2, "T": 3, "U": 4, "V": 5, "W": 6, "X": 7, "Y": 8, "Z": 9,
    "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9,
}
VIN_WEIGHTS = [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2]
YEAR_CODES_2001 = "123456789"
YEAR_CODES_2010 = "ABCDEFGHJKLMNPRSTVWXY"


Let = Callable[[Column, Callable[[Column], Column]], Column]


def repeated(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value written out wherever body uses it: generated code finds equal parts by itself."""
    return body(value)


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it: for long bodies, where equal parts are too many to be found."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, body)


def folded_case(v: Column) -> Column:
    """Upper case, Ё as Е, white space runs as one space, outer blanks stripped; null is empty."""
    s = F.translate(F.upper(F.coalesce(v, F.lit(""))), "Ё\u00a0", "Е ")
    return F.btrim(F.regexp_replace(s, r"(?U)\s+", " "))


def stripped(s: Column) -> Column:
    """A folded text without outer punctuation; words for "none" are empty."""
    return F.btrim(F.when(s.isin(NOTHING), F.lit("")).otherwise(s), F.lit(" .,;:"))


def base(v: Column, let: Let = repeated) -> Column:
    """Upper case, Ё as Е, white space runs as one space, outer blanks and punctuation stripped; words for "none" are empty."""
    return let(folded_case(v), stripped)


def to_latin(s: Column) -> Column:
    return F.translate(s, CYRILLIC, LATIN)


def to_cyrillic(s: Column) -> Column:
    return F.translate(s, LATIN, CYRILLIC)


def _squeezed(s: Column, more: str) -> Column:
    return F.regexp_replace(s, rf"(?U)[\s{more}]", "")


def fix_vin(s: Column, let: Let = repeated) -> Column:
    """Latin letters without O, I and Q (read as 0, 1, 0)."""
    return F.translate(to_latin(_squeezed(s, r"\-")), "OIQ", "010")


def squeezed_plate(s: Column) -> Column:
    return to_cyrillic(_squeezed(s, r"\-|"))


def placed_plate(s: Column) -> Column:
    """A squeezed number with letters and digits told apart by their places."""
    letter = lambda c: F.translate(c, "08", "ОВ")
    digit = lambda c: F.translate(c, "ОЗБ", "036")
    return F.concat(letter(F.substring(s, 1, 1)), digit(F.substring(s, 2, 3)), letter(F.substring(s, 5, 2)), digit(s.substr(F.lit(7), F.length(s))))


def fix_plate(s: Column, let: Let = repeated) -> Column:
    """Cyrillic; letters and digits are told apart by their places: A123BC64."""
    return let(squeezed_plate(s), placed_plate)


def squeezed_number(s: Column) -> Column:
    return _squeezed(s, r"\-№N")


def fixed_series(s: Column) -> Column:
    """A squeezed number; the middle of a paper passport's series is Cyrillic letters."""
    middle = F.substring(s, 3, 2)
    mixed = s.rlike(r"(?U)^\d{2}.{2}\d{6}$") & ~middle.rlike(r"(?U)^\d+$")
    return F.when(mixed, F.concat(F.substring(s, 1, 2), F.translate(to_cyrillic(middle), "0", "О"), F.substring(s, 5, 6))).otherwise(s)


def fix_series(s: Column, let: Let = repeated) -> Column:
    """Document numbers; the middle of a paper passport's series is Cyrillic letters."""
    return let(squeezed_number(s), fixed_series)


def digits(s: Column) -> Column:
    """All digits together without leading zeros; empty if there is none."""
    return F.regexp_replace(F.regexp_replace(s, r"\D", ""), "^0+(?=.)", "")


def date_text(s: Column) -> Column:
    """DD.MM.YYYY of the first date; otherwise the text without white space."""
    part = lambda n: F.regexp_extract(s, DATE, n)
    found = F.concat_ws(".", F.lpad(part(1), 2, "0"), F.lpad(part(2), 2, "0"), part(3))
    return F.when(s.rlike(DATE), found).otherwise(F.regexp_replace(s, r"(?U)\s", ""))


def _alnum(s: Column) -> Column:
    return F.regexp_replace(s, "[^А-ЯA-Z0-9]", "")


def _form(key: str) -> str:
    """The rule by which a field's values are compared."""
    if key in ("vin", "body", "plate"):
        return key
    if key in ("doc_number", "pts_number"):
        return "series"
    kind = KIND.get(key, "text")
    if kind != "text":
        return kind
    return "latin" if key in LATIN_FIELDS else "cyrillic" if key in CYRILLIC_FIELDS else "text"


def body_form(s: Column, vin: Column) -> Column:
    """A body's number from its base form, and that read as a VIN."""
    return F.when(F.length(vin) == 17, vin).otherwise(_alnum(s))


def _body(s: Column, let: Let = repeated) -> Column:
    return let(fix_vin(s), lambda vin: body_form(s, vin))


_FORMS = {
    "vin": fix_vin,
    "body": _body,
    "plate": fix_plate,
    "series": fix_series,
    "code": lambda s: _squeezed(s, r"\-"),
    "int": digits,
    "date": date_text,
    "latin": lambda s: _alnum(to_latin(s)),
    "cyrillic": lambda s: _alnum(to_cyrillic(s)),
    "text": _alnum,
}


def canon(key: str, v: Column) -> Column:
    """The form in which values of a field are compared; null and nothing are empty."""
    return _FORMS[_form(key)](base(v))


def canon_of(key: str, s: Column, let: Let = repeated) -> Column:
    """canon() of a base form."""
    form = _form(key)
    return _FORMS[form](s, let) if form in ("vin", "body", "plate", "series") else _FORMS[form](s)


def canon_of_base(key: Column, s: Column) -> Column:
    """canon() of a base form where the field is a column too: one branch for each rule, not for each field."""
    keys: dict[str, list[str]] = {}
    for k in KIND:
        keys.setdefault(_form(k), []).append(k)
    out = None
    for form, names in keys.items():
        if form != "text":
            out = (F if out is None else out).when(key.isin(names), _FORMS[form](s))
    return out.otherwise(_alnum(s))


def clean_value(key: Column, v: Column) -> Column:
    """A value as it is stored: base form in its field's alphabet."""
    s = base(v)
    vin = fix_vin(s)
    lettered = F.when(key.isin(LATIN_FIELDS), to_latin(s)).when(key.isin(CYRILLIC_FIELDS), to_cyrillic(s)).otherwise(s)
    return F.when(key.isin("vin", "body") & (F.length(vin) == 17), vin).when(key == "plate", fix_plate(s)).otherwise(lettered)


def clean_fields(fields: Column) -> Column:
    """A map of cleaned values without empty ones."""
    some = F.map_filter(fields, lambda k, v: base(v) != "")
    return F.transform_values(some, clean_value)


def same(key: str, p: Column, t: Column) -> Column:
    return canon(key, p) == canon(key, t)


def cer(p: Column, t: Column) -> Column:
    """Character error rate of canonical forms, at most 1."""
    empty = F.when(p == "", 0.0).otherwise(1.0)
    return F.when(t == "", empty).otherwise(F.least(F.lit(1.0), F.levenshtein(p, t) / F.length(t)))


def int_value(v: Column) -> Column:
    """All digits of the value as a number, null if there is none."""
    d = F.regexp_replace(F.coalesce(v.cast("string"), F.lit("")), r"\D", "")
    return F.nullif(d, F.lit("")).try_cast("bigint")


def date_value(v: Column) -> Column:
    """The first date in the value if the calendar has it."""
    part = lambda n: F.regexp_extract(F.coalesce(v, F.lit("")), DATE, n)
    return F.try_to_date(F.concat_ws(".", part(1), part(2), part(3)), "d.M.yyyy")


def check_digit_sum(vin: Column, let: Let = repeated) -> Column:
    """The weighted sum of a VIN's characters modulo 11, by ISO 3779; other characters count 0."""
    chars = "".join(VIN_VALUES)

    def rest(as_digits: Column) -> Column:
        terms = [F.coalesce(F.nullif(F.substring(as_digits, n + 1, 1), F.lit("")).cast("int"), F.lit(0)) * w for n, w in enumerate(VIN_WEIGHTS)]
        return reduce(lambda a, b: a + b, terms) % 11

    # translate() gives each character its value as one digit; others become 0.
    as_digits = F.translate(F.regexp_replace(vin, f"[^{chars}]", "0"), chars, "".join(str(n) for n in VIN_VALUES.values()))
    return let(as_digits, rest)


def check_digit_of(r: Column) -> Column:
    return F.when(r == 10, "X").otherwise(r.cast("string"))


def vin_check_digit(vin: Column, let: Let = repeated) -> Column:
    """Check digit (place 9) by ISO 3779; other characters count 0."""
    return let(check_digit_sum(vin, let), check_digit_of)


def vin_year_code(year: Column) -> Column:
    """The model year's character; null where none is defined."""
    early = F.substring(F.lit(YEAR_CODES_2001), (year - 2000).cast("int"), F.lit(1))
    late = F.substring(F.lit(YEAR_CODES_2010), (year - 2009).cast("int"), F.lit(1))
    return F.when(year.between(2001, 2009), early).when(year.between(2010, 2030), late)


def hp_to_kw(hp: Column) -> Column:
    """Whole kilowatts, halves to even; in decimals, as 11000 * 0.7355 is above 8090.5 in doubles."""
    return F.bround(hp.cast("decimal(28,9)") * F.lit(Decimal("0.7355"))).cast("int")


def safe_name(s: Column) -> Column:
    return F.regexp_replace(s, "[^A-Za-z0-9._-]+", "_")


def variant_seed(item: Column, variant: Column) -> Column:
    return F.crc32(F.concat(item, F.lit("|"), variant).cast("binary"))


def norm_label(s: Column) -> Column:
    """A printed label for comparison: lower case, one alphabet for look-alikes, letters and digits only."""
    s = F.translate(F.lower(s), "ё", "е")
    s = F.translate(s, LATIN.lower(), CYRILLIC.lower())
    return F.btrim(F.regexp_replace(F.regexp_replace(s, "[^a-zа-я0-9 ]", " "), " +", " "))


def docs_word(n: Column) -> Column:
    """The Russian plural of "document" after a number."""
    one = (n % 10 == 1) & (n % 100 != 11)
    few = (n % 10).between(2, 4) & ~(n % 100).between(12, 14)
    return F.when(one, "документ").when(few, "документа").otherwise("документов")


def percent_text(share: Column) -> Column:
    return F.when(share.isNotNull(), F.format_string("%.1f%%", share * 100)).otherwise("—")
