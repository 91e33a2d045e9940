"""Bulgarian text as it is spoken: numbers in words, dates, times, money and abbreviations, as Column expressions.

Each pass finds all its matches in a text at once, turns each into words, and puts the text together again, so
that a text stays one row and nothing leaves the JVM. Defined results: null stays null; a blank text stays as it is; numbers
of more than twelve digits are left, or read digit by digit where a pass must read them; dates of a month that does not exist keep their figures.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, roman

# The words of numbers.
UNITS = {"m": "един два", "f": "една две", "n": "едно две"}
MORE = "три четири пет шест седем осем девет"
TEN, TEENS, TENS = "десет", "еди два три четири пет шест седем осем девет", "два три четири пет шест седем осем девет"
HUNDREDS = "сто двеста триста четиристотин петстотин шестстотин седемстотин осемстотин деветстотин"
ORDINALS = "първ втор трет четвърт пет шест седм осм девет десет"
MONTHS = "януари февруари март април май юни юли август септември октомври ноември декември"
ENDINGS = {"m": ("и", "ен"), "f": ("а", "на"), "n": ("о", "но")}
ORDINAL_SIGNS = {"m": "ви ри ти ми", "f": "ва ра та на", "n": "во ро то но"}
#: Main unit alone and in number, with its gender; part alone and in number, with its gender.
MONEY = {"BGN": ("лев", "лева", "m", "стотинка", "стотинки", "f"), "EUR": ("евро", "евро", "n", "цент", "цента", "m"), "USD": ("долар", "долара", "m", "цент", "цента", "m"), "GBP": ("лира", "лири", "f", "пени", "пенса", "m")}
NUMBERED = {"m": "век том клас", "f": "глава книга част степен"}
ABBREVIATED = """
т.е. = тоест; т. е. = тоест; т.н. = така наречен; т. н. = така наречен; т.нар. = така наречен; напр. = например; и т.н. = и така нататък; и т. н. = и така нататък; и др. = и други; вж. = виж; ср. = сравни;
вкл. = включително; изд. = издание; стр. = страница; гл. = глава; чл. = член; ал. = алинея; б.р. = бележка на редактора; б. р. = бележка на редактора; б.а. = бележка на автора; б. а. = бележка на автора;
пр.н.е. = преди новата ера; пр. н. е. = преди новата ера; сл.н.е. = след новата ера; сл. н. е. = след новата ера; пр.Хр. = преди Христа; сл.Хр. = след Христа;
бул. = булевард; ул. = улица; пл. = площад; ж.к. = жилищен комплекс; ж. к. = жилищен комплекс; кв. = квартал; бл. = блок; вх. = вход; ет. = етаж; ап. = апартамент; п.к. = пощенски код;
гр. = град; с. = село; обл. = област; общ. = община; р-н = район; г-н = господин; г-жа = госпожа; г-ца = госпожица; д-р = доктор; проф. = професор; доц. = доцент; акад. = академик; инж. = инженер; арх. = архитект; адв. = адвокат; св. = свети;
ЕООД = еоод; ООД = оод; ЕТ = едноличен търговец; АД = акционерно дружество; ЕАД = еад; КД = командитно дружество; СД = събирателно дружество;
НАП = национална агенция по приходите; НОИ = национален осигурителен институт; НЗОК = национална здравноосигурителна каса; МОН = министерство на образованието и науката; МВР = министерство на вътрешните работи;
МЗ = министерство на здравеопазването; МФ = министерство на финансите; МРРБ = министерство на регионалното развитие и благоустройството; БНБ = българска народна банка; БНТ = бнт; БТВ = бтв; НС = народно събрание; ЕС = европейски съюз;
ООН = организация на обединените нации; НАТО = нато; ДДС = данък добавена стойност; ДАНС = данс; ЕГН = единен граждански номер; БУЛСТАТ = булстат; ПИН = пин; ПДФ = пдф; СМС = есемес; № = номер; & = и; @ = кльомба
"""
MEASURES = """
км/ч = километра в час; м/с = метра в секунда; кв.м = квадратни метра; кв. м = квадратни метра; куб.м = кубически метра; куб. м = кубически метра; км = километра; м = метра; см = сантиметра; мм = милиметра;
кг = килограма; гр = грама; мг = милиграма; т = тона; л = литра; мл = милилитра; дка = декара; ха = хектара
"""

#: A word's sign, and no such sign before or after.
_SIGN = r"[\p{L}\p{N}_]"
_B, _E = rf"(?<!{_SIGN})", rf"(?!{_SIGN})"
#: Where a figure begins a number, and where a Cyrillic letter (of either case, old forms too) comes: that is seen sooner than what stands before.
_FIGURE, _LETTER = rf"(?=[0-9]){_B}", "(?=[\u0400-\u052f\u1c80-\u1c8f\ua640-\ua69f])"


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value worked out once however often it is used."""
    return F.element_at(F.transform(F.array(value), lambda v: then(v)), 1)


def _picked(words: list[str], at: Column) -> Column:
    return F.element_at(F.split(F.lit("|".join(words)), "[|]"), (at + 1).cast("int"))


def _small(gender: str) -> list[str]:
    """0 to 19; nothing for 0."""
    return ["", *UNITS[gender].split(), *MORE.split(), TEN, *[w + "надесет" for w in TEENS.split()]]


_TENS = ["", "", *[w + "десет" for w in TENS.split()]]
_HUNDREDS = ["", *HUNDREDS.split()]


def _below_hundred(gender: str) -> list[str]:
    """0 to 99; nothing for 0. Such tables keep a number's expression small, which each pass holds at least once."""
    small = _small(gender)
    return small + [_TENS[n // 10] + (" и " + small[n % 10] if n % 10 else "") for n in range(20, 100)]


def _joint(h: Column, r: Column) -> Column:
    return F.when((h == 0) | (r == 0), "").when((r < 20) | (r % 10 == 0), " и ").otherwise(" ")


def _under_thousand(n: Column, gender: str) -> Column:
    def words(n: Column) -> Column:
        h, r = F.floor(n / 100), n % 100
        return F.concat(_picked(_HUNDREDS, h), _joint(h, r), _picked(_below_hundred(gender), r))

    return _let(n, words)


def _part(n: Column, thousand: int) -> Column:
    """n's figures at that power of a thousand."""
    return F.floor(n / 1000**thousand).cast("long") % 1000


def two_figures(n: Column, gender: str = "m") -> Column:
    """A number from 0 to 99 in words."""
    return _picked(["нула", *_below_hundred(gender)[1:]], n)


def cardinal(n: Column, gender: str = "m") -> Column:
    """A whole number below 10 ** 12 in words; one and two have a gender."""
    one, many = ["един милиард", "един милион", "хиляда"], [" милиарда", " милиона", " хиляди", ""]
    below = [w for g in ("m", "m", "f", gender) for w in _below_hundred(g)]

    def words(a: Column) -> Column:
        def great(x: Column, i: Column) -> Column:
            h, r = F.floor(x / 100), x % 100
            lead = F.when((i == 3) & (a >= 1000) & ((h == 0) | (r == 0)), "и ").otherwise("")
            said = F.concat(lead, _picked(_HUNDREDS, h), _joint(h, r), _picked(below, i * 100 + r), _picked(many, i))
            return F.when(x == 0, "").when((x == 1) & (i < 3), _picked(one, F.least(i, F.lit(2)))).otherwise(said)

        parts = F.transform(F.array(*[_part(a, k) for k in (3, 2, 1, 0)]), great)
        return F.when(a == 0, "нула").otherwise(F.array_join(F.filter(parts, lambda w: w != ""), " "))

    return _let(n, lambda n: F.concat(F.when(n < 0, "минус ").otherwise(""), _let(F.abs(n).cast("long"), words)))


def _stem(hundred: str) -> str:
    """A hundred as the place's words begin."""
    return {"сто": "сто", "двеста": "двесто", "триста": "тристо"}.get(hundred) or hundred.removesuffix("отин") + "о"


def _places_below_hundred(gender: str) -> list[str]:
    """The places 0 to 99; nothing for 0."""
    end = ENDINGS[gender][0]
    small = ["", *[w + end for w in ORDINALS.split()], *[w + end for w in _small("m")[11:]]]
    return small + [_TENS[n // 10] + (" и " + small[n % 10] if n % 10 else end) for n in range(20, 100)]


def ordinal(n: Column, gender: str = "m") -> Column:
    """A number's place in words; numbers that are not positive, and round numbers from a million on, stay cardinal."""
    hundredth = ENDINGS[gender][1]
    hundreds = ["", *[_stem(w) + "т" + hundredth for w in HUNDREDS.split()]]

    def round_(t: Column) -> Column:
        return F.concat(F.when(t == 1, "").when(t == 2, "две").otherwise(_under_thousand(t, "f")), F.lit("хиляд" + hundredth))

    def words(n: Column) -> Column:
        h = _part(n, 0)
        hundred, r = F.floor(h / 100), h % 100
        whole = F.when((n <= 0) | (n >= 1000), cardinal(F.when(n <= 0, n).otherwise(n - h), gender))
        first = F.when((n > 0) & (hundred > 0), F.when(r == 0, _picked(hundreds, hundred)).otherwise(_picked(_HUNDREDS, hundred)))
        last = F.when((n > 0) & (r > 0), _picked(_places_below_hundred(gender), r))
        place = F.when((n > 0) & (n < 1_000_000) & (h == 0), _let(_part(n, 1), round_)).otherwise(F.array_join(F.array(whole, first, last), " "))
        return F.when(n.isNotNull(), place)

    return _let(n.cast("long"), words)


def _figures(digits: Column) -> Column:
    """Each figure's word."""
    names = ["нула", *UNITS["n"].split(), *MORE.split()]
    return F.array_join(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: _picked(names, c.cast("int"))), " ")


def in_words(digits: Column, gender: str = "m") -> Column:
    """The cardinal of a string of figures, read figure by figure beyond twelve."""
    words = lambda d: F.when(F.length(d) > 12, _figures(d)).otherwise(cardinal(_long(F.substring(d, 1, 12)), gender))
    return _let(F.regexp_replace(digits, "^0+(?=[0-9])", ""), words)


def decimal_in_words(whole: Column, places: Column) -> Column:
    """A number with figures after its mark, as tenths, hundredths or thousandths."""

    def words(places: Column) -> Column:
        k, one = F.length(places), F.regexp_replace(places, "^0+", "") == "1"
        name = lambda a, b: F.when(one, a).otherwise(b)
        unit = F.when(k == 1, name(" десета", " десети")).when(k == 2, name(" стотна", " стотни")).when(k == 3, name(" хилядна", " хилядни")).otherwise("")
        return F.when(k > 0, F.concat(F.lit(" цяло и "), in_words(places, "f"), unit)).otherwise("")

    return F.concat(in_words(whole, "n"), _let(F.regexp_replace(places, "0+$", ""), words))


def rewritten(text: Column, pattern: str, to: Callable[[Column], Column]) -> Column:
    """text with each match of pattern replaced by what `to` makes of it; a text without any is not taken apart."""

    def put(t: Column) -> Column:
        found = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)), lambda m: to(m))
        return F.array_join(F.zip_with(F.split(t, pattern, -1), found, lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")

    # most texts have no figures, or none any more: that is seen sooner than that the whole pattern fits nowhere
    of_figures = pattern.removeprefix("(?iu)").startswith(("(?=[0-9])", "(?<=[0-9])"))
    fits = lambda t: F.rlike(t, F.lit("[0-9]")) & F.rlike(t, F.lit(pattern)) if of_figures else F.rlike(t, F.lit(pattern))
    return _let(text, lambda t: F.when(fits(t), put(t)).otherwise(t))


def _group(pattern: str) -> Callable[[Column, int], Column]:
    """A match's group; what a pattern only looks at around a match is not there any more, so it is left out."""
    bare = re.sub(r"\(\?<?[!=](?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", "", pattern)
    return lambda m, k: F.regexp_extract(m, f"^(?:{bare})$", k)


def _table(values: str) -> dict[str, str]:
    return dict(tuple(x.strip().split(" = ")) for x in values.replace("\n", " ").split(";"))


def _alternatives(words: list[str]) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


#: A pattern, and what becomes of each match.
Pass = tuple[str, Callable[[Column], Column]]


def abbreviations() -> list[Pass]:
    """Abbreviations in full; those in capitals only as capitals, measures only after a figure."""
    known = _table(ABBREVIATED)
    folded = {k: v for k, v in known.items() if k.upper() != k}
    exact = {k: v for k, v in known.items() if k not in folded and k.lower() != k}
    signs = {k: v for k, v in known.items() if k not in folded and k not in exact}
    lookup = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    low = {k.lower(): v for k, v in folded.items()}
    measures = _table(MEASURES)
    return [
        (f"{_LETTER}(?iu){_B}(?:{_alternatives(list(folded))}){_E}", lambda m: lookup(low, F.lower(m))),
        (f"{_LETTER}{_B}(?:{_alternatives(list(exact))}){_E}", lambda m: lookup(exact, m)),
        (f"(?=[{''.join(signs)}]){_B}(?:{_alternatives(list(signs))}){_E}", lambda m: lookup(signs, m)),
        (f"(?<=[0-9]){WS}*(?:{_alternatives(list(measures))}){_E}", lambda m: F.concat(F.lit(" "), lookup(measures, F.regexp_replace(m, f"^{WS}+", "")))),
    ]


def _long(m: Column) -> Column:
    return F.coalesce(m.try_cast("long"), F.lit(0).cast("long"))


def year(n: Column) -> Column:
    return ordinal(n, "f")


def date(day: Column, month: Column, year_: Column | None = None) -> Column:
    """The words of a date, whose day has two figures at most; figures where there is no such month."""

    def words(month: Column) -> Column:
        parts = [_picked(["нула", *_places_below_hundred("m")[1:]], day), _picked(["", *MONTHS.split()], F.greatest(F.least(month, F.lit(12)), F.lit(0))), *([year(year_)] if year_ is not None else [])]
        plain = F.array_join(F.array(*[x.cast("string") for x in (day, month, *([year_] if year_ is not None else []))]), ".")
        return F.when(month.between(1, 12), F.array_join(F.array(*parts), " ")).otherwise(plain)

    return _let(month, words)


def dates() -> list[Pass]:
    """Days, months and years in figures, and days before a month's name."""
    day, sep, number = rf"{_FIGURE}([0-9]{{1,2}})", r"[./\-]", "([0-9]{1,2})"
    names = f"({MONTHS.replace(' ', '|')})"
    month = lambda m: F.array_position(F.split(F.lit(MONTHS), " "), F.lower(m))
    with_suffix, whole = rf"{day}{sep}{number}{sep}([0-9]{{4}}){WS}*г\.?", rf"{day}{sep}{number}{sep}([0-9]{{4}}){_E}"
    amount = rf"(?!{WS}*(?:лв|лева|евро|долар|EUR|USD|BGN|GBP|%|ч\.|часа))"
    g = _group(rf"{day}[./]{number}")
    named, bare = rf"(?iu){day}{WS}+{names}{WS}+([0-9]{{4}})(?:{WS}*(г\.?))?", rf"(?iu){day}{WS}+{names}{_E}"
    n, b = _group(named), _group(bare)

    def short(m: Column) -> Column:
        d, k = _long(g(m, 1)), _long(g(m, 2))
        return F.when(d.between(1, 31) & k.between(1, 12), date(d, k)).otherwise(m)

    def full(m: Column) -> Column:
        d = _long(n(m, 1))
        words = date(d, month(n(m, 2)), _long(n(m, 3)))
        return F.when(d.between(1, 31), F.concat(words, F.when(n(m, 4) != "", " година").otherwise(""))).otherwise(m)

    def plain(m: Column) -> Column:
        d = _long(b(m, 1))
        return F.when(d.between(1, 31), date(d, month(b(m, 2)))).otherwise(m)

    return [(with_suffix, _dated(_group(with_suffix), " година")), (whole, _dated(_group(whole), "")), (rf"{day}[./]{number}{_E}(?!\.[0-9]){amount}", short), (named, full), (bare, plain)]


def _dated(g: Callable[[Column, int], Column], suffix: str) -> Callable[[Column], Column]:
    def words(m: Column) -> Column:
        month = _long(g(m, 2))
        return F.concat(date(_long(g(m, 1)), month, _long(g(m, 3))), F.when(month.between(1, 12), suffix).otherwise(""))

    return words


def times() -> list[Pass]:
    clock = rf"{_FIGURE}([0-9]{{1,2}}):([0-9]{{2}})"
    return [(p, _timed(_group(p), suffix)) for p, suffix in ((rf"{clock}{WS}*(?:ч\.|часът|часа)", " часа"), (rf"{clock}{_E}", ""))]


def _timed(g: Callable[[Column, int], Column], suffix: str) -> Callable[[Column], Column]:
    def words(m: Column) -> Column:
        minutes = _long(g(m, 2))
        return F.concat(two_figures(_long(g(m, 1))), F.when(minutes > 0, F.concat(F.lit(" и "), two_figures(minutes))).otherwise(""), F.lit(suffix))

    return words


def money(amount: Column, currency: str) -> Column:
    """An amount (figures, with a mark before at most two more) in words."""
    one, many, gender, part_one, part_many, part_gender = MONEY[currency]
    whole, part = F.regexp_extract(amount, "^([0-9]+)", 1), _long(F.substring(F.concat(F.regexp_extract(amount, "[.,]([0-9]+)$", 1), F.lit("00")), 1, 2))
    some = F.regexp_replace(whole, "^0+", "")
    a = F.when(some != "", F.concat(in_words(whole, gender), F.when(some == "1", " " + one).otherwise(" " + many)))
    b = F.when(part > 0, F.concat(two_figures(part, part_gender), F.when(part == 1, " " + part_one).otherwise(" " + part_many)))
    both = F.array_join(F.array_compact(F.array(a, b)), " и ")
    return F.when(both != "", both).otherwise(f"нула {many}")


def currencies() -> list[Pass]:
    # all figures and blanks in one step: none of them begins what may follow, and a loop of alternatives takes a stack as deep as the run is long
    amount = rf"([0-9][0-9{WS[1:]}*+(?:[.,][0-9]{{1,2}})?)"
    out = [(rf"{_FIGURE}{amount}{WS}*(?:лв\.|(?:лв|лева|BGN){_E})", _priced("BGN", ""))]
    for sign, names, code in (("€", "EUR|евро", "EUR"), (r"\$", "USD|долара?", "USD")):
        out += [(rf"{sign}{WS}*{amount}{WS}*", _priced(code, " ")), (rf"{_FIGURE}{amount}{WS}*(?:{names}){_E}", _priced(code, ""))]
    return out


def _priced(code: str, end: str) -> Callable[[Column], Column]:
    def words(m: Column) -> Column:
        figures = F.regexp_replace(F.regexp_replace(m, r"[^0-9.,]+", ""), "[.,]$", "")
        return F.concat(_let(figures, lambda f: money(f, code)), F.lit(end))

    return words


def phones() -> list[Pass]:
    """Telephone numbers in pairs of figures."""

    def words(m: Column) -> Column:
        abroad = F.startswith(m, F.lit("+359"))
        digits = F.regexp_replace(F.when(abroad, F.substring(m, 5, 100)).otherwise(m), "[^0-9]", "")
        pair = lambda p: F.when((F.length(p) == 1) | F.startswith(p, F.lit("0")), _figures(p)).otherwise(two_figures(_long(p)))
        read = F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("[0-9]{1,2}"), F.lit(0)), pair), " ")
        return F.concat(F.when(abroad, "плюс три пет девет ").otherwise(""), read)

    return [(rf"(?:\+359(?:{WS}|-)?|0)(?:[0-9\-/]|{WS}){{6,12}}[0-9]", words)]


def roman_places() -> list[Pass]:
    """Roman numbers next to a century, chapter or the like, as its place."""
    numeral = r"(?=[IVXLCDM])M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3})"
    out: list[Pass] = []
    for gender, words in NUMBERED.items():
        names = words.replace(" ", "|")
        for pattern, number in ((rf"{_LETTER}(?iu){_B}({names})({WS}+)({numeral}){_E}", 3), (rf"(?iu)(?=[IVXLCDM]){_B}({numeral})({WS}+)({names}){_E}", 1)):
            out.append((pattern, _placed(_group(pattern), number, gender)))
    return out


def _placed(g: Callable[[Column, int], Column], number: int, gender: str) -> Callable[[Column], Column]:
    def words(m: Column) -> Column:
        place = ordinal(F.coalesce(roman(F.upper(g(m, number))), F.lit(0)).cast("long"), gender)
        return F.concat(g(m, 1), F.lit(" "), place) if number == 3 else F.concat(place, F.lit(" "), g(m, 3))

    return words


def ordinals() -> list[Pass]:
    return [(rf"{_FIGURE}([0-9]+){WS}*+(?:-{WS}*+)?(?:{signs.replace(' ', '|')}){_E}", _ranked(gender)) for gender, signs in ORDINAL_SIGNS.items()]


def _ranked(gender: str) -> Callable[[Column], Column]:
    return lambda m: ordinal(_long(F.regexp_extract(m, "^([0-9]+)", 1)), gender)


def years() -> list[Pass]:
    n = lambda m: _long(F.substring(m, 1, 4))
    return [(rf"{_FIGURE}[0-9]{{4}}{WS}*(?:г\.|година)(?!и)", lambda m: F.when(n(m).between(1000, 2100), F.concat(year(n(m)), F.lit(" година"))).otherwise(m))]


def numbers() -> list[Pass]:
    """What no other pass has read: numbers with a mark, and whole ones."""
    part = lambda m, k: F.regexp_extract(m, r"^([0-9]+)(?:[.,]([0-9]+))?", k)
    long_ = lambda m: F.length(F.regexp_replace(m, "^0+", "")) > 12
    return [(rf"{_FIGURE}[0-9]+[.,][0-9]+{_E}", lambda m: decimal_in_words(part(m, 1), part(m, 2))), (rf"{_FIGURE}[0-9]+{_E}", lambda m: F.when(long_(m), m).otherwise(in_words(m)))]


def percentages() -> list[Pass]:
    part = lambda m, k: F.regexp_extract(m, r"^([0-9]+)(?:[.,]([0-9]+))?", k)
    number = lambda m: F.when(part(m, 2) != "", decimal_in_words(part(m, 1), part(m, 2))).otherwise(in_words(part(m, 1)))
    return [(rf"{_FIGURE}[0-9]+(?:[.,][0-9]+)?{WS}*%", lambda m: F.concat(number(m), F.lit(" процента")))]


def passes(abbreviated: bool = True) -> list[Pass]:
    """All passes in their order: what is said in a special way comes before plain numbers."""
    spaced = (rf"{_FIGURE}[0-9]{{1,3}}(?:{WS}[0-9]{{3}})+{_E}", lambda m: F.translate(m, " ", ""))
    signs = [("№", lambda m: F.lit("номер ")), ("&", lambda m: F.lit(" и "))]
    return [*(abbreviations() if abbreviated else []), spaced, *percentages(), *dates(), *times(), *currencies(), *phones(), *roman_places(), *signs, *ordinals(), *years(), *numbers()]


def spoken(rows: DataFrame, text: str, name: str, *, abbreviated: bool = True) -> DataFrame:
    """rows with the column name: Bulgarian text as it is read aloud, by all passes in their order."""
    out = rows.withColumn(name, F.col(text))
    for pattern, to in passes(abbreviated):
        out = out.withColumn(name, rewritten(F.col(name), pattern, to))
    read = F.regexp_replace(F.regexp_replace(F.col(name), f"{WS}+", " "), "^ | $", "")
    return out.withColumn(name, F.when(F.regexp_replace(F.col(text), WS, "") == "", F.col(text)).otherwise(read))
