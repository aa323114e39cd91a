"""Text functions as Columns; none leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, spelled so that Java and RE2 read it alike.
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
HANGUL, KANA, HAN = r"[\x{ac00}-\x{d7a3}]", r"[\x{3040}-\x{30ff}]", r"[\x{4e00}-\x{9fff}]"
#: Fixed value: words that mark a phrase as a sentence.
SENTENCE_HINTS = (
    "is", "are", "was", "were", "be", "been", "being", "am", "do", "does", "did", "don't", "doesn't", "didn't", "can", "could", "will", "would",
    "should", "shall", "may", "might", "must", "have", "has", "had", "haven't", "hasn't", "hadn't", "you", "your", "we", "our", "they", "their",
    "i'll", "we'll", "you'll", "how to", "what is", "why", "when", "where", "which", "who", "whose", "let's", "let us", "here's", "there's", "it's",
)
HINT = "(?i)(^|[^0-9A-Za-z_])(" + "|".join(SENTENCE_HINTS) + ")($|[^0-9A-Za-z_])"
EMAIL, PHONE, PATIENT = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", r"\+?[0-9][0-9\- ]{7,}[0-9]", r"PT-[0-9]{4}-[0-9]{4}"
WORD = r"[\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*"
#: Fixed value: weights of visual units.
UNITS = {"space": 0.28, "repeated": 0.12, "wide": 1.0, "ascii": 0.55, "punct": 0.35, "other": 0.8}


def normalized(c: Column) -> Column:
    """White space collapsed to single spaces and stripped."""
    return F.btrim(F.regexp_replace(c, WS + "+", " "))


def count(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


def letters(c: Column, outside: str) -> Column:
    """How many characters are left without those of `outside`: no string is made for each of them, as a count of matches would."""
    return F.length(F.regexp_replace(c, outside + "+", ""))


def once(x: Column, then: Callable[[Column], Column]) -> Column:
    """then(x), with x computed once however often it is used: the optimiser writes plain expressions out at each use."""
    return F.element_at(F.transform(F.array(x), then), 1)


def _split(n: Column) -> Column:
    return F.when(n == "", F.array().cast("array<string>")).otherwise(F.split(n, " "))


def words(c: Column) -> Column:
    """Words of normalised text; none for ''."""
    return once(normalized(c), _split)


def is_translatable(c: Column) -> Column:
    """Three characters, two ASCII letters, and not a code of at most three words."""
    return once(normalized(c), _translatable)


def _translatable(n: Column) -> Column:
    return (F.length(n) >= 3) & n.rlike("[A-Za-z][^A-Za-z]*[A-Za-z]") & ~(n.rlike(r"^[A-Z0-9_#./:,() -]+$") & (F.size(_split(n)) <= 3))


def is_translatable_strict(c: Column) -> Column:
    """Not blank, not marks and digits alone, no lone URL or address, a letter of any script."""
    return once(normalized(c), lambda n: (n != "") & n.rlike(r"\p{L}") & ~n.rlike(r"^(https?://|www\.)[^ ]+$") & ~n.rlike(r"^[^ @]+@[^ @]+\.[^ @]+$"))


def is_translatable_book(c: Column) -> Column:
    """A Latin, Greek, Cyrillic, Han, kana or Hangul letter, and no lone URL or address."""
    letter = r"[A-Za-z\x{c0}-\x{24f}\x{370}-\x{3ff}\x{400}-\x{4ff}\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{ac00}-\x{d7af}]"
    return once(normalized(c), lambda n: n.rlike(letter) & ~n.rlike(r"(?i)^https?://[^ ]+$") & ~n.rlike(r"^[^ @]+@[^ @]+\.[^ @]+$"))


def is_skippable(c: Column) -> Column:
    """Blank, digits alone, beginning with a URL, or an address."""
    return once(normalized(c), lambda n: (n == "") | n.rlike("^[0-9]+$") | n.rlike("(?i)^https?://") | n.rlike(r"^[^ @]+@[^ @]+\.[^ @]+$"))


def is_unusable(c: Column) -> Column:
    """Nothing visible, or a share of replacement characters of 0.35 or more and no two-letter ASCII word."""
    return once(F.regexp_replace(c, WS, ""), lambda v: (F.length(v) == 0) | ((count(v, r"\x{fffd}") / F.greatest(F.length(v), F.lit(1)) >= 0.35) & ~c.rlike("[A-Za-z]{2}")))


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def looks_like_sentence(c: Column) -> Column:
    n = F.size(words(c))
    return once(stripped(c), lambda t: (t != "") & (t.rlike("[.,;:!?。，；：！？]") | (F.length(t) >= 40) | (n >= 6) | ((n >= 4) & t.rlike(HINT))))


def is_mostly_english(c: Column) -> Column:
    """Three characters, a three-letter Latin word, and more Latin letters than Hangul, which are 0.3 of the text."""

    def latin(t: Column) -> Column:
        return once(count(t, "[A-Za-z]"), lambda n: (count(t, HANGUL) < n) & (n / F.greatest(F.length(t), F.lit(1)) >= 0.3))

    return once(stripped(c), lambda t: (F.length(t) >= 3) & t.rlike("[A-Za-z]{3}") & latin(t))


def needs_retry(source: Column, target: Column, korean: bool = True) -> Column:
    """The translation is empty or unchanged or, into Korean, still mostly Latin or still has the source's words."""

    def repeated(s: Column, t: Column) -> Column:
        first = F.slice(F.regexp_extract_all(F.lower(s), F.lit("([a-z]{4,})"), 1), 1, 80)
        return once(F.lower(t), lambda whole: F.size(F.filter(first, lambda w: F.contains(whole, w))))

    def left(s: Column, t: Column) -> Column:
        hangul = F.coalesce(F.when(t.rlike(HANGUL), letters(t, HANGUL.replace("[", "[^"))), F.lit(0))
        return once(letters(t, "[^A-Za-z]"), lambda n: ((n >= 40) & (n > F.greatest(F.lit(20.0), hangul * 0.8))) | ((n >= 25) & (repeated(s, t) >= 6)))

    def failed(s: Column) -> Column:
        return once(normalized(target), lambda t: (t == "") | (s == t) | (left(s, t) if korean else F.lit(False)))

    return once(normalized(source), lambda s: _translatable(s) & failed(s))


def collapse_repeated(c: Column) -> Column:
    """A text that says everything twice, once: by non-blank lines, else by words (four at least), else by characters (eight at least)."""
    lines = F.filter(F.transform(F.split(c, "\r\n|\n|\r"), lambda x: F.regexp_replace(x, WS + "+$", "")), lambda x: x != "")

    def half(a: Column) -> Column:
        return F.slice(a, F.lit(1), (F.size(a) / 2).cast("int"))

    def twice(a: Column, least: int) -> Column:
        return (F.size(a) >= least) & (F.size(a) % 2 == 0) & (half(a) == F.slice(a, (F.size(a) / 2).cast("int") + 1, F.greatest(F.size(a), F.lit(1))))

    def by_characters(n: Column) -> Column:
        m = (F.length(n) / 2).cast("int")
        return F.when((F.length(n) >= 8) & (F.length(n) % 2 == 0) & (n.substr(F.lit(1), m) == n.substr(m + 1, m)), n.substr(F.lit(1), m)).otherwise(c)

    def by_words(n: Column) -> Column:
        return once(_split(n), lambda w: F.when(twice(w, 4), F.array_join(half(w), " ")).otherwise(by_characters(n)))

    return once(lines, lambda x: F.when(twice(x, 2), F.array_join(half(x), "\n")).otherwise(once(normalized(c), by_words)))


#: Verb endings and marks that a Korean title drops.
TITLE_ENDINGS = "하십시오 하십시요 하세요 되세요 되십시오 합니다 입니다 됩니다 갑니다 하기 되기 해요 되요 예요 에요".split()
TITLE_MARKS = ".!?。！？"


def polished_title(c: Column) -> Column:
    """A title without its verb ending and, of each mark, one at its end; three times over."""
    ending = f"{WS}*(?:{'|'.join(TITLE_ENDINGS)})\\z"
    marks = "".join(f"(?:{WS}*[{m}])?" for m in reversed(TITLE_MARKS)) + f"{WS}*\\z"
    out = stripped(c)
    for _ in range(3):
        out = F.regexp_replace(F.regexp_replace(out, ending, ""), marks, "")
    return out


MARKER = r"^([ \t]*)((?:[•●○◦▪▫■□▶▷►▸▹◆◇※*–—-])|(?:\(?[0-9A-Za-z]{1,3}[.)]))([ \t]+)"


def align_marker(source: Column, target: Column) -> Column:
    """The translation with the source's list marker, or without one if the source has none."""
    prefix = lambda c: F.regexp_extract(c, MARKER, 0)
    body = F.ltrim(F.regexp_replace(target, MARKER, ""))
    return F.when(prefix(source) != "", F.concat(prefix(source), body)).when(prefix(target) != "", body).otherwise(target)


def join_fragments(left: Column, right: Column) -> Column:
    """Two runs joined with a space, unless punctuation or white space stands between them."""
    first, last = F.substring(right, 1, 1), F.right(left, F.lit(1))
    close = first.isin(*",.;:%)]}") | last.isin(*"([{/#$") | last.rlike(WS) | first.rlike(WS)
    return F.when(left == "", right).when(right == "", left).when(close, F.concat(left, right)).otherwise(F.concat(left, F.lit(" "), right))


def visual_units(c: Column) -> Column:
    """Estimated width: weights by class of character; white space after white space weighs less."""
    spaces, runs = count(c, WS), count(c, WS + "+")
    wide = count(c, r"[\x{ac00}-\x{d7af}\x{1100}-\x{11ff}\x{3130}-\x{318f}\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]")
    ascii_, punct = count(c, "[0-9A-Za-z]"), count(c, r"[!-/:-@\[-`{-~]")
    other = F.length(c) - spaces - wide - ascii_ - punct
    return runs * UNITS["space"] + (spaces - runs) * UNITS["repeated"] + wide * UNITS["wide"] + ascii_ * UNITS["ascii"] + punct * UNITS["punct"] + other * UNITS["other"]


def slug_key(c: Column) -> Column:
    return F.btrim(F.regexp_replace(c, "[^a-zA-Z0-9]+", "_"), F.lit("_"))


def safe_stem(c: Column, most: int = 96) -> Column:
    s = F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(c), '[\\\\/:*?"<>|\\s]+', "-"), "-+", "-"), F.lit("-"))
    return F.coalesce(F.nullif(F.substring(s, 1, most), F.lit("")), F.lit("pdf"))


def work_key(path: Column, most: int = 180) -> Column:
    """The name of a path's work folder: no file suffix, `_` for each run of other characters than letters, digits and `_.-`."""
    bare = F.regexp_replace(path, r"([^/])\.[^./]+$", "$1")
    return F.substring(F.regexp_replace(bare, "[^A-Za-z0-9_.-]+", "_"), 1, most)


def url_host(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, "^https?://([^/]+)", 1))


def mask_pii(c: Column) -> Column:
    """Addresses, then phone numbers, then patient numbers; the order is part of the result."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, EMAIL, "***@***"), PHONE, "***-****-****"), PATIENT, "PT-****-****")


def word_count(c: Column) -> Column:
    return count(c, WORD)


def clean_chars(c: Column) -> Column:
    """No control or zero-width characters, plain spaces, ligatures spelled out."""
    out = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{200b}-\x{200d}\x{feff}]", "")
    for a, b in ((" ", " "), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("¶", "’")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def cache_key(source_lang: Column, target_lang: Column, text: Column, sep: str = "\n") -> Column:
    return F.sha2(F.concat_ws(sep, source_lang, target_lang, text), 256)


def detected_language(text: Column, default: str = "en") -> Column:
    """Vote by script: any kana, then Hangul if as many as Han, then Han, then Latin."""
    kana, hangul, han, latin = (F.sum(count(text, p)) for p in (KANA, HANGUL, HAN, "[A-Za-z]"))
    return F.when(kana > 0, "jp").when(hangul >= F.greatest(han, F.lit(1)), "kr").when(han > 0, "ch").when(latin > 0, "en").otherwise(default)


#: Language codes, their labels and BCP-47 tags.
LANGUAGES = {"en": ("English", "en-US"), "kr": ("Korean", "ko-KR"), "ko": ("Korean", "ko-KR"), "jp": ("Japanese", "ja-JP"), "ja": ("Japanese", "ja-JP"), "ch": ("Chinese", "zh-CN"), "zh": ("Chinese", "zh-CN"), "fr": ("French", "fr-FR"), "de": ("German", "de-DE"), "es": ("Spanish", "es-ES")}
ALIASES = {"ko": "kr", "korean": "kr", "ja": "jp", "japanese": "jp", "zh": "ch", "chinese": "ch", "english": "en"}


def lang_normalized(c: Column) -> Column:
    """Aliases to one code; unknown codes pass through."""
    n = F.lower(F.btrim(c))
    table = F.create_map(*(F.lit(x) for kv in ALIASES.items() for x in kv))
    return F.coalesce(table[n], n)


def issue_code(c: Column) -> Column:
    return F.regexp_extract(c, "^([A-Z_]+):", 1)


def json_results(answer: Column) -> Column:
    """array<struct<id, translated>> of an answer in JSON: fenced or not, amid prose, an array, one object or {items: [...]}; null if there is none.

    Tried are the whole text, then from the first to the last bracket, then from the first to the last brace; the first that is an array or an
    object counts. Elements that are no objects are left out; an object's id is its text, `None` if it has none.
    """
    whole = F.regexp_replace(F.coalesce(answer, F.lit("")), r"^\s*```(?:json)?\s*|\s*```\s*$", "")
    spans = [whole, F.regexp_extract(whole, r"(?s)\[.*\]", 0), F.regexp_extract(whole, r"(?s)\{.*\}", 0)]

    def items(span: Column) -> Column:
        v = F.try_parse_json(span)
        kind = lambda x: F.schema_of_variant(x)
        inner = F.try_variant_get(v, "$.items", "variant")
        listed = F.when(kind(inner).startswith("ARRAY"), F.try_variant_get(v, "$.items", "array<variant>"))
        of_object = F.when(inner.isNull(), F.array(v)).otherwise(listed)
        return F.when(kind(v).startswith("ARRAY"), F.try_variant_get(v, "$", "array<variant>")).when(kind(v).startswith("OBJECT"), of_object)

    objects = F.filter(F.coalesce(*map(items, spans)), lambda v: F.schema_of_variant(v).startswith("OBJECT"))
    get = lambda v, name: F.try_variant_get(v, f"$.{name}", "string")
    return F.transform(objects, lambda v: F.struct(F.coalesce(get(v, "id"), F.lit("None")).alias("id"), get(v, "translated").alias("translated")))
