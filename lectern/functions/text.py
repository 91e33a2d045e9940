"""Text functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the library's texts count it: Java's \s leaves out all but ASCII.
WS = r"[\s\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_ENDS = rf"^{WS}+|{WS}+$"
_INVISIBLE = r"[\x{00ad}\x{200b}\x{200c}\x{200d}\x{feff}]"


def sub(text: Column, pattern: str, to: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(to))


def trim(text: Column) -> Column:
    return sub(text, _ENDS, "")


def effective_text(custom: Column, clean: Column, raw: Column) -> Column:
    """The first text that is there; an empty one counts."""
    return F.coalesce(custom, clean, raw)


_NOT_WS = WS.replace("[", "[^", 1)


def word_count(text: Column) -> Column:
    """Runs of anything but white space; null for null."""
    # most signs are ASCII, which a plain range tells faster than the long list of white space
    return F.regexp_count(text, F.lit(f"(?:[!-~]++|{_NOT_WS})++")).cast("long")


def ascii_counts(text: Column) -> tuple[Column, Column]:
    """Characters up to U+007F, and the others."""
    other = F.length(sub(text, r"[\x{0000}-\x{007f}]", ""))
    return F.length(text) - other, other


def estimate_tokens(ascii_: Column, other: Column) -> Column:
    """Rounded half up."""
    return F.floor(ascii_ / 3.4 + other / 1.4 + 0.5)


def clean_extracted(text: Column) -> Column:
    """One paragraph of reading text: broken words joined, invisible characters and line breaks gone."""
    text = sub(text, r"\x{00ad}[ \t]*\r?\n[ \t]*", "")
    text = sub(text, r"(\p{L})-[ \t]*\r?\n[ \t]*(?=\p{L})", "$1")
    text = sub(text, _INVISIBLE, "")
    return trim(sub(text, WS + "+", " "))


def format_verse(text: Column) -> Column:
    """Lines stay; each is cleaned on its own."""
    lines = F.split(sub(text, r"\r\n?", "\n"), "\n")
    return trim(F.array_join(F.transform(lines, lambda x: trim(sub(sub(x, _INVISIBLE, ""), r"[ \t]+", " "))), "\n"))


def normalize_for_speech(text: Column, keep_verse: bool = False) -> Column:
    """Text to be read aloud: marks, links, notes, addresses and broken lines go, in this order."""
    steps = [
        (r"\*\*([^\r\n]+?)\*\*", "$1"), (r"\*([^\r\n]+?)\*", "$1"), (r"(?<!\w)_([^_\n]+)_(?!\w)", "$1"), (r"`([^\r\n]+?)`", "$1"),
        (r"!\[([^\]]*)\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (rf"(?m)^#{{1,6}}{WS}+", ""),
        (r"\[[0-9]+\]", ""), (r"(?i)\[(?:i{1,3}|iv|v|vi{0,3}|ix|x{0,3})\]", ""), (rf"<?https?://{WS.replace('[', '[^', 1)}+", ""),
    ]
    if not keep_verse:
        steps.append((r"(\w)-\n(\w)", "$1$2"))
    steps += [(r"\n{3,}", "\n\n"), (r"[ \t]+", " ")]
    for pattern, to in steps:
        text = sub(text, pattern, to)
    return trim(F.array_join(F.transform(F.split(text, "\n"), trim), "\n"))


def snippet(text: Column, most: int = 140) -> Column:
    """At most `most` characters on one line, cut at a blank in the second half where there is one."""
    flat = trim(sub(text, WS + "+", " "))
    cut = F.substring(flat, 1, most)
    last = most - F.instr(F.reverse(cut), " ")  # the last blank's place, or `most` if there is none
    has = F.instr(cut, " ") > 0
    at = F.greatest(F.when(has, last).otherwise(-1), F.lit(most // 2))
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.substring(cut, F.lit(1), at), F.lit("…")))


def slug(text: Column) -> Column:
    return sub(sub(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def script_ratio(text: Column) -> Column:
    """Cyrillic letters among Latin and Cyrillic ones; 0 without letters."""
    cyrillic, latin = F.regexp_count(text, F.lit(r"[\x{0400}-\x{04ff}]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when(cyrillic + latin > 0, cyrillic / (cyrillic + latin)).otherwise(F.lit(0.0))


def script_language(text: Column) -> Column:
    """bg or en if that script has over 20 letters and over twice the other's, else und."""
    cyrillic, latin = F.regexp_count(text, F.lit(r"[\x{0400}-\x{04ff}]")), F.regexp_count(text, F.lit("[a-zA-Z]"))
    return F.when((cyrillic > 20) & (cyrillic > 2 * latin), "bg").when((latin > 20) & (latin > 2 * cyrillic), "en").otherwise("und")


def is_title_like(text: Column) -> Column:
    """Up to 8 words, 3 letters or more, none in lower case."""
    return (word_count(text) <= 8) & (F.regexp_count(text, F.lit(r"\p{L}")) >= 3) & ~F.rlike(text, F.lit(r"\p{Ll}"))


# Frequent short words of each language, and the letters of those that no other language here is written in.
_COMMON = {
    "en": "the of and to in is that it was for on are as with by this from",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au avec pas",
    "es": "de la que el en y los se del las un por con no una su para es al lo como",
    "it": "di e il la che in un per è del della non con una sono le da si",
    "pt": "de a o que e do da em um para é com não uma os no se na por",
    "nl": "de van het een en in is dat op te zijn met voor niet aan",
    "da": "og i at det er en til af på for med den der som ikke de har var et",
    "no": "og i det er en til av på for med den som ikke de har var et jeg",
    "sv": "och i att det är en som på av för med den till inte de om ett han var",
    "fi": "ja on ei se että oli hän mutta kun niin myös ovat joka hänen kuin",
    "hu": "a az és hogy nem is egy ez volt meg de azt csak már van ha el mint",
    "pl": "i w się na nie z do to że jest jak o po ale tak za co od przez",
    "cs": "a se v na je že to s z do o k i jako ale po by jsem které",
    "sk": "a sa v na je že to s z do o k aj ako ale po by som ktoré",
    "sl": "in je v da se na za so z ne bi ki kot pa po tudi ali pri",
    "hr": "i je u da se na za od s ne su što kao ali po bi sam koji",
    "ro": "și de în a la cu pe nu că o un din este mai să pentru care sau fost",
    "tr": "ve bir bu da de için ile ne o çok gibi daha olan kadar sonra ama en değil",
    "vi": "và của là có không cho được trong một người với các này đã khi đến",
    "id": "yang dan di dengan untuk dari ini itu pada tidak adalah dalam akan ke juga oleh",
    "bg": "на и да се от за не в с по е са като до ще това който си беше",
    "ru": "и в не на я что он с как это по но они мы за из от его было",
    "uk": "і в не на що з та до як це за від про його він вона але є було",
    "sr": "и је у да се на за од са не су што као али по би сам",
    "ar": "في من على إلى أن التي هذا عن مع لا ما هو كان",
    "fa": "و در به از که این را با است برای آن می تا",
}
_SCRIPTS = {"el": "Greek", "he": "Hebrew", "hi": "Devanagari", "ko": "Hangul"}


def guess_language(words: Column) -> Column:
    """The language with most of its frequent words, or of words in its letters, among the words (lower case); null without any."""
    kana, han = r"[\p{IsHiragana}\p{IsKatakana}]", r"\p{IsHan}"
    counts = {lang: F.size(F.filter(words, _among(c.split()))) for lang, c in _COMMON.items()}
    counts |= {lang: F.size(F.filter(words, _written(rf"\p{{Is{name}}}"))) for lang, name in _SCRIPTS.items()}
    counts |= {"ja": F.size(F.filter(words, _written(kana))), "zh": F.size(F.filter(words, lambda w: w.rlike(han) & ~w.rlike(kana)))}
    # of equal counts the language listed first
    scores = F.array(*[F.struct(n.alias("n"), F.lit(-i).alias("place"), F.lit(lang).alias("lang")) for i, (lang, n) in enumerate(counts.items())])
    # by transform the scores are taken once, not once for each use
    return F.transform(F.array(F.array_max(scores)), lambda best: F.when(best["n"] > 0, best["lang"]))[0]


def detect_language(text: Column, least: int = 200) -> Column:
    """The language of a text of at least that many characters; null for a shorter one."""
    # its words are cut out once, not once for each language
    guess = F.transform(F.array(words_of(text)), guess_language)[0]
    return F.when(F.length(F.trim(text)) >= least, guess)


def _written(pattern: str):
    return lambda w: w.rlike(pattern)


def _among(common: list[str]):
    return lambda w: w.isin(*common)


def words_of(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def citation_ids(text: Column, pattern: str = r"\[(c_[0-9]+)\]") -> Column:
    """Cited ids in order of their first place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def similarity(a: Column, b: Column, match: float = 0.7) -> Column:
    """1 - edit distance / longer length; 0 if one is empty or the lengths differ by more than 1 - match of the longer."""
    n, m = F.length(a), F.length(b)
    longer = F.greatest(n, m)
    off = (n == 0) | (m == 0) | (F.abs(n - m) > longer * F.lit(1 - match))
    return F.when(a == b, F.when(n > 0, 1.0).otherwise(0.0)).when(off, 0.0).otherwise(1 - F.levenshtein(a, b) / longer)


def roman(text: Column) -> Column:
    """A number in digits or Roman numerals; other letters count 0."""
    values = F.create_map(*[F.lit(x) for kv in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in kv])
    digits = F.transform(F.filter(F.split(F.lower(text), ""), lambda c: c != ""), lambda c: F.coalesce(F.try_element_at(values, c), F.lit(0)))
    later = F.concat(F.slice(digits, 2, 1_000), F.array(F.lit(0)))
    signed = F.zip_with(digits, later, lambda x, y: F.when(x < y, -x).otherwise(x))
    return F.when(F.rlike(text, F.lit("^[0-9]+$")), text.try_cast("int")).otherwise(F.aggregate(signed, F.lit(0), lambda t, x: t + x))
