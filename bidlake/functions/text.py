"""String and number expressions: tokens, stems, folds, dates, money, numbers with units."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space including the no-break space, which Java's \s leaves out.
SPACE = r"[\s\x{00A0}]+"
NUMBER = r"-?\d+(?:[.,]\d+)?"


@dataclass(frozen=True)
class LanguagePack:
    """What the text operators take from a language."""

    letters: str
    endings: tuple[str, ...]
    stop_prefixes: tuple[str, ...]
    fleeting: str | None
    measured: str


# Fixed values that must equal the reference's: endings in the order they are tried, words of which the first five
# letters mark a term that tells nothing, and the consonants before a fleeting vowel.
RUSSIAN = LanguagePack(
    letters="а-яёa-z",
    endings=("иями", "иях", "ами", "ями", "его", "ому", "ыми", "ими", "ого", "ах", "ях", "ов", "ев", "ий", "ый", "их", "ых", "ая", "яя", "ое", "ые", "ие", "ом", "ем", "им", "ым", "ой", "ей",
             "а", "я", "о", "е", "и", "ы", "у", "ю", "й", "ь"),
    stop_prefixes=("поставка", "закупка", "товар", "оказание", "услуги", "выполнение", "работ", "нужд", "государственн", "бюджетн", "учреждение", "который", "должен", "должн", "дней", "также",
                   "соответствии", "требования", "наличие", "договор", "контракт", "заказчик", "подрядчик", "поставщик", "исполнител", "срок", "оплат", "гарант", "ответственн", "обязательств",
                   "документац", "условия", "порядок", "качеств", "обеспечен", "изменен", "стоимост", "заявк", "предусмотрен", "осуществля", "являетс", "российск", "федераци", "наименован", "быть"),
    fleeting=r"^(.+[бвгджзйклмнпрстфхцчшщ])[оеё]к$",
    measured="а-яё",
)
LATIN = LanguagePack(letters="a-zß-öø-ÿ", endings=("ings", "ing", "ed", "es", "s"), stop_prefixes=("licen", "versi"), fleeting=None, measured="а-яё")


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it: keeps expressions built in steps from growing by every step."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE, " "))


def trimmed(c: Column) -> Column:
    """Without white space at either end, no-break spaces included."""
    return F.regexp_replace(c, r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")


# Entities in the order they are decoded, & last; those that stand for signs of the markup itself.
ENTITIES = (("&nbsp;", " "), ("&quot;", '"'), ("&laquo;", "«"), ("&raquo;", "»"), ("&lt;", "<"), ("&gt;", ">"), ("&#39;", "'"), ("&amp;", "&"))
MARKUP = (("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def strip_tags(c: Column, entities: tuple[tuple[str, str], ...] = ENTITIES) -> Column:
    """Text of an HTML fragment: span tags vanish, other tags separate, entities decoded in their order."""
    c = F.regexp_replace(F.regexp_replace(c, r"(?i)</?span[^>]*>", ""), r"<[^>]*>", " ")
    for entity, char in entities:
        c = F.replace(c, F.lit(entity), F.lit(char))
    return squeeze(c)


def plain(c: Column) -> Column:
    """Lower case with ё as е."""
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def tokens(c: Column, pack: LanguagePack = RUSSIAN) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{pack.letters}0-9]+)"))


def stem(word: Column, pack: LanguagePack = RUSSIAN) -> Column:
    """The first listed ending that leaves at least four characters is cut off; the lists hold longer endings first."""
    return F.regexp_replace(word, "^(.{4,}?)(" + "|".join(pack.endings) + ")$", "$1")


def fleeting(word: Column, pack: LanguagePack = RUSSIAN) -> Column:
    """The variant without the fleeting vowel (``замок`` also as ``замк``), else null."""
    if pack.fleeting is None:
        return F.lit(None).cast("string")
    return F.when(word.rlike(pack.fleeting), F.concat(F.regexp_extract(word, pack.fleeting, 1), F.lit("к")))


def is_stopped(term: Column, pack: LanguagePack = RUSSIAN) -> Column:
    """Whether a stem starts with the first five letters of a stop word."""
    return term.rlike("^(?:" + "|".join(dict.fromkeys(w[:5] for w in pack.stop_prefixes)) + ")")


def name_tokens(c: Column) -> Column:
    """Sorted distinct tokens of a field name: equal arrays mean equal token sets."""
    return F.array_sort(F.array_distinct(F.filter(F.split(plain(c), r"[^\p{L}\p{N}]+"), lambda t: t != "")))


def money(c: Column) -> Column:
    """A price text up to its currency sign; the first comma is the decimal point; unreadable is 0."""
    digits = F.regexp_replace(F.split(c, "&#|₽")[0], r"[^0-9,]", "")
    return F.coalesce(F.regexp_replace(digits, "^([0-9]*),([0-9]*).*$", "$1.$2").try_cast("double"), F.lit(0.0))


def local_timestamp(c: Column) -> Column:
    """``dd.MM.yyyy[ HH:mm]`` as a timestamp, 23:59 where the time is missing."""
    part = lambda i: F.regexp_extract(c, r"(\d\d)\.(\d\d)\.(\d{4})(?: (\d\d):(\d\d))?", i)
    time = lambda i, default: F.when(part(i) == "", F.lit(default)).otherwise(part(i).try_cast("int"))
    return F.when(part(3) != "", F.try_make_timestamp(part(3).try_cast("int"), part(2).try_cast("int"), part(1).try_cast("int"), time(4, 23), time(5, 59), F.lit(0)))


def number(c: Column) -> Column:
    """First number of a text, comma or point as decimal mark."""
    # The first of all, which is null where there is none: casting an empty text throws and catches inside Spark, which is slow.
    return F.replace(F.get(F.regexp_extract_all(c, F.lit(f"({NUMBER})")), F.lit(0)), F.lit(","), F.lit(".")).try_cast("double")


def numbers(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(f"({NUMBER})")), lambda x: F.replace(x, F.lit(","), F.lit(".")).try_cast("double"))


def unit_of(c: Column) -> Column:
    """The unit right after the first number, dotted compounds whole; empty if there is none or a sign of sizes stands there."""
    unit = F.regexp_extract(c, NUMBER + r"[\s\x{00A0}]*(\p{L}+(?:[·.⋅‧]\p{L}+)*|%|°)", 1)
    return F.when(F.lower(unit).isin("x", "х"), F.lit("")).otherwise(unit)


# Fixed values that must equal the reference's: cleaned units, their family and their scale to its base.
UNITS = {
    "амперчас": ("charge", 1.0), "ач": ("charge", 1.0), "ah": ("charge", 1.0), "миллиамперчас": ("charge", 0.001), "мач": ("charge", 0.001), "mah": ("charge", 0.001),
    "миллиметр": ("len", 1.0), "мм": ("len", 1.0), "mm": ("len", 1.0), "сантиметр": ("len", 10.0), "см": ("len", 10.0), "cm": ("len", 10.0),
    "метр": ("len", 1000.0), "м": ("len", 1000.0), "m": ("len", 1000.0),
}


def clean_unit(unit: Column) -> Column:
    """A unit as the table of families has it: lower case, ё as е, letters and digits only."""
    return F.regexp_replace(plain(unit), "[^0-9a-zа-я]", "")


def _of_unit(unit: Column, part: int) -> Column:
    table = F.create_map(*[x for name, own in UNITS.items() for x in (F.lit(name), F.lit(own[part]))])
    return F.try_element_at(table, clean_unit(unit))


def unit_family(unit: Column) -> Column:
    return _of_unit(unit, 0)


def unit_scale(unit: Column) -> Column:
    return _of_unit(unit, 1)


def resolution(c: Column) -> Column:
    """Product of ``A x B`` texts with exactly two numbers, else null."""
    found = numbers(c)
    return F.when(c.rlike(r"\d\s*[xх×*]\s*\d") & (F.size(found) == 2), F.abs(F.get(found, F.lit(0)) * F.get(found, F.lit(1))))


# Cyrillic letters that look like Latin ones, and their counterparts.
_CYRILLIC, _LATIN = "аеорсухкмтвн", "aeopcyxkmtbh"


def fold(c: Column) -> Column:
    """Lower case without a leading mark of sizes (``№ 3``, ``size 3``), look-alike letters unified."""
    bare = F.regexp_replace(F.lower(c), r"^[\s\x{00A0}]+|[\s\x{00A0}]+$", "")
    return F.translate(F.regexp_replace(bare, r"^(?:№|#|no\.?|размер|size)[\s\x{00A0}]*", ""), _CYRILLIC, _LATIN)


def js_round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


def buyer_key(c: Column) -> Column:
    """Normal form of a buyer's name: upper case, quotes dropped, other signs as spaces."""
    c = F.regexp_replace(F.upper(c), "[\"«»'“”„]", "")
    return squeeze(F.regexp_replace(c, r"[^A-Z0-9_ А-ЯЁ]", " "))


def code_parts(code: Column) -> tuple[Column, Column]:
    """A classifier code as (okpd, position or null)."""
    parts = F.split(code, "-", 2)
    return parts[0], F.try_element_at(parts, F.lit(2))


def code_ancestors(okpd: Column) -> Column:
    """The code and all its dot-bounded ancestors."""
    parts = F.split(okpd, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))


# Fixed values that must equal the reference's: words of a region's name in lower case, districts and cities by the
# region they belong to, federal cities, and what names a region of its own.
REGION_WORDS = ("область", "край", "округ", "автономный", "автономная", "автономного", "район", "района")
REGION_ROLLUP = {
    "р-н боровичский": "Новгородская область", "р-н хвойнинский": "Новгородская область", "р-н красновишерский": "Пермский край",
    "г. кемерово": "Кемеровская область - Кузбасс", "г. сургут": "Ханты-Мансийский автономный округ - Югра",
}
FEDERAL_CITY = r"(?iu)^г\.?\s*(?:москва|санкт[- ]петербург|севастополь)$"
REGION = "(?iu)облас|край|республик|автономн|округ|кузбасс"


def tidy_region(c: Column) -> Column:
    """A region's name as portals write it: capitals only where words and parts after a hyphen begin, service words small."""
    s = squeeze(F.coalesce(c, F.lit("")))
    s = F.when(s.rlike("[а-яё]"), s).otherwise(F.lower(s))
    first = lambda w: F.substring(w, 1, 1)
    raised = lambda w: F.concat(F.when(first(w).rlike("[а-яёa-z]"), F.upper(first(w))).otherwise(first(w)), F.substring(w, 2, 1_000_000))
    part = lambda w: F.array_join(F.transform(F.split(w, "-"), raised), "-")
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.when(F.lower(w).isin(*REGION_WORDS), F.lower(w)).otherwise(part(w))), " ")


def canonical_region(c: Column) -> Column:
    """The region that a name stands for: rolled up from a district, a federal city, or a region's own name; else empty."""
    s = trimmed(F.coalesce(c, F.lit("")))
    table = F.create_map(*[F.lit(x) for pair in REGION_ROLLUP.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(s)), F.when(s.rlike(FEDERAL_CITY), F.regexp_replace(s, r"(?iu)^г\.?\s*", "г. ")).when(s.rlike(REGION), s).otherwise(""))


def unit_label(c: Column) -> Column:
    """A unit without the gloss in brackets after it."""
    s = F.coalesce(c, F.lit(""))
    short = trimmed(F.regexp_replace(s, r"\s*\([^)]*\)\s*$", ""))
    return F.when(short != "", short).otherwise(trimmed(s))


def clipped(c: Column, most: int = 120) -> Column:
    """A text of at most ``most`` characters, the last a sign of what was left out."""
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def piped(cells: Column) -> Column:
    """A table row as text: cells between bars, line breaks as spaces; null for a row without any text."""
    clean = F.transform(cells, lambda x: trimmed(F.replace(F.coalesce(x, F.lit("")), F.lit("\n"), F.lit(" "))))
    return bound(clean, lambda xs: F.when(F.exists(xs, lambda x: x != ""), F.concat(F.lit("| "), F.array_join(xs, " | "), F.lit(" |"))))


def unpiped(line: Column) -> Column:
    """The cells of a row that :func:`piped` wrote; null for other lines."""
    return F.when(line.startswith("|"), F.transform(F.split(F.regexp_replace(line, r"^\|+|\|+$", ""), r"\|"), trimmed))


def unit_price(source: Column, price: Column, quantity: Column) -> Column:
    """Price of one unit: portals give it, others give the line's price, divided by a quantity above 0 if there is one."""
    n = F.replace(F.regexp_extract(F.regexp_replace(quantity, SPACE, ""), r"^[-+]?\d+(?:[.,]\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(F.coalesce(source, F.lit("")).rlike(r"(?iu)mos\.ru|портал"), price).when(n > 0, price / n)


def region_code(number: Column) -> Column:
    """Digits 3 and 4 of a 19-digit registry number, else null."""
    return F.when(number.rlike(r"^\d{19}$"), F.substring(number, 3, 2))
