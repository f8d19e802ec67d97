"""Tokenizers, normalisers and formatters as Column expressions.

Four tokenizers exist because four features cut text differently; they are not to be merged. White space is Unicode
white space ("(?U)\\s") where the rules say so, and ends are trimmed the same way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
STOP_WORDS = (
    "about", "after", "again", "also", "and", "are", "because", "been", "before", "being", "between", "both", "but", "can", "could", "did",
    "does", "for", "from", "had", "has", "have", "how", "into", "its", "may", "more", "most", "not", "of", "on", "or", "our", "should", "than",
    "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "was", "were", "what", "when", "where",
    "which", "who", "why", "will", "with", "would", "you", "your",
)
TITLE_FILLERS = r"\b(the|first|second|third|book|epistle|gospel|according|to|of|moses|called|apostle|general|saint|st)\b"
HTML_ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
BOOK_ALIASES = {
    "genesis": ["gen"], "exodus": ["exod", "exo"], "leviticus": ["lev"], "numbers": ["num"], "deuteronomy": ["deut", "deu"],
    "joshua": ["josh", "jos"], "judges": ["judg", "jdg"], "ruth": ["rut"], "psalms": ["ps", "psalm", "psa"], "proverbs": ["prov", "pro"],
    "ecclesiastes": ["eccl", "ecc"], "isaiah": ["isa"], "jeremiah": ["jer"], "lamentations": ["lam"], "ezekiel": ["ezek", "ezk"], "daniel": ["dan"],
    "hosea": ["hos"], "joel": ["jol"], "amos": ["amo"], "obadiah": ["obad", "oba"], "jonah": ["jon"], "micah": ["mic"], "nahum": ["nah", "nam"],
    "habakkuk": ["hab"], "zephaniah": ["zeph"], "haggai": ["hag"], "zechariah": ["zech", "zec"], "malachi": ["mal"],
    "matthew": ["matt", "mat"], "mark": ["mark", "mrk"], "luke": ["luke", "luk"], "john": ["john", "jhn"], "acts": ["acts", "act"],
    "romans": ["rom"], "galatians": ["gal"], "ephesians": ["eph"], "philippians": ["phil", "php"], "colossians": ["col"], "hebrews": ["heb"],
    "james": ["jas"], "jude": ["jud"], "revelation": ["rev"],
}

MAX_TERMS = 8
DIFF_TOKENS = 250


def search_tokens(text: Column) -> Column:
    """Tokens of the search index: letters, digits and apostrophes, two or more, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}']{2,}"), F.lit(0))


def query_terms(text: Column) -> Column:
    """Terms of a question: three characters or more, no stop words, the first eight distinct ones."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}']{3,}"), F.lit(0))
    stop = F.array(*map(F.lit, STOP_WORDS))
    return F.slice(F.array_distinct(F.filter(found, lambda w: ~F.array_contains(stop, w))), 1, MAX_TERMS)


def diff_tokens(text: Column) -> Column:
    """Words, and runs of other characters that aren't white space, in order."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)[\p{L}\p{N}'’]+|[^\s\p{L}\p{N}'’]+"), F.lit(0))


def concordance_words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}'’]+"), F.lit(0))


def word_norm(word: Column) -> Column:
    """Lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(word), r"[^\p{L}\p{N}]+", "")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+\z", "")


def compact(text: Column) -> Column:
    return trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def name_norm(name: Column) -> Column:
    straight = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[’']", "'")
    return F.trim(F.regexp_replace(straight, "[^a-z0-9]+", " "))


def identity_of_folded(folded: Column) -> Column:
    """What editions of one work share: an already lower-cased, decomposed title without marks and filler words. Non-Latin titles become empty."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded, TITLE_FILLERS, " "), "[^a-z0-9]+", " "))


def reference_norm(reference: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(compact(reference)), "[.]", ""), r"(?U)\s+", " ")


def aliases(name: Column, book_id: Column) -> Column:
    """Names that references may use: the name itself, the id, its short forms, and short forms after a number."""
    table = F.create_map(*(x for k, v in BOOK_ALIASES.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    plain = F.regexp_replace(F.lower(compact(name)), r"(?U)^the\s+", "")
    number, base = F.regexp_extract(plain, r"^([123])\s+(.+)\z", 1), F.regexp_extract(plain, r"^([123])\s+(.+)\z", 2)
    none = F.array().cast("array<string>")
    short = F.coalesce(F.try_element_at(table, plain), none)
    of_base = F.coalesce(F.try_element_at(table, base), F.array(F.substring(base, 1, 3)))
    numbered = F.when(number != "", F.transform(of_base, lambda a: F.concat(number, F.lit(" "), a))).otherwise(none)
    own = F.array(plain, F.lower(F.coalesce(book_id, F.lit(""))))
    return F.filter(F.array_distinct(F.concat(own, short, numbered)), lambda a: a != "")


def friendly_title(title: Column, edition_id: Column | None = None) -> Column:
    """An edition's shown title, with the wording of acquisition packs replaced. Fixed patterns."""
    out = filled(title, edition_id if edition_id is not None else F.lit(None).cast("string"), F.lit("Documented edition"))
    rules = (
        (r"(?i)Online Critical Pseudepigrapha\s*·\s*Original-Language Editions", "Original-Language Critical Pseudepigrapha"),
        (r"(?i)Recovered Local Editions\s*·\s*", ""),
        (r"(?i)\bSource Pack\s*([IVXLC\d-]+)", "Collection $1"),
        (r"(?i)\bSource-Readable Works\s*([IVXLC\d-]+)", "Documented Sources $1"),
        (r"(?i)\bBibliographic and Fragmentary Witnesses\s*([IVXLC\d-]+)", "Bibliographic Witnesses $1"),
        (r"\s{2,}", " "),
        (r"\s*·\s*·\s*", " · "),
    )
    return F.trim(reduce(lambda c, r: F.regexp_replace(c, *r), rules, out))


def title_label(value: Column) -> Column:
    """Dashes and underscores become spaces, a to z after anything but an ASCII letter or digit become upper case, and the rest stays as it is."""
    parts = F.split(F.translate(F.coalesce(value, F.lit("")), "-_", "  "), "(?<![A-Za-z0-9])(?=[a-z])")
    raised = lambda w: F.when(w.rlike("^[a-z]"), F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))).otherwise(w)
    return F.array_join(F.transform(parts, raised), "")


def html_escape(text: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), HTML_ESCAPES, F.coalesce(text, F.lit("")))


def citation(title: Column, edition: Column, section: Column, label: Column, library: str) -> Column:
    """Title. Edition. Section:label. Library. An edition or a label that is empty is left out."""
    locator = F.concat(section, F.when(F.coalesce(label, F.lit("")) != "", F.concat(F.lit(":"), label)).otherwise(""))
    middle = F.when(F.coalesce(edition, F.lit("")) != "", F.concat(edition, F.lit(". "))).otherwise("")
    return compact(F.concat(filled(title, F.lit("Untitled work")), F.lit(". "), middle, locator, F.lit(f". {library}.")))


def source_profile(work: str = "work", edition: str = "edition", book: str = "book") -> Column:
    """Fifteen fields of provenance, each the first filled one of work, edition and book structs.

    book: rights, license, license_url, translator, attribution, source_note, title, name, manuscript_witnesses, source_urls;
    edition: title, collection_label, language, rights, license, license_url, translator; work: key, title, edition_title,
    collection_label, content_state, source_url.
    """
    w, e, b = (lambda f, s=s: F.col(f"{s}.{f}") for s in (work, edition, book))
    text = lambda *c: F.coalesce(filled(*c), F.lit(""))
    none = F.array().cast("array<string>")
    return F.struct(
        text(w("key")).alias("work_key"), text(w("title"), b("title"), b("name")).alias("title"), text(w("edition_title"), e("title")).alias("edition"),
        text(w("collection_label"), e("collection_label")).alias("collection"), text(e("language")).alias("language"), text(w("content_state")).alias("content_state"),
        filled(w("source_url")).alias("source_url"), text(b("rights"), e("rights")).alias("rights"), text(b("license"), e("license")).alias("license"),
        filled(b("license_url"), e("license_url")).alias("license_url"), text(b("translator"), e("translator")).alias("translator"), text(b("attribution")).alias("attribution"),
        text(b("source_note")).alias("source_note"), F.coalesce(b("manuscript_witnesses"), none).alias("manuscript_witnesses"), F.coalesce(b("source_urls"), none).alias("source_urls"),
    )


def strong_keys(query: Column) -> Column:
    """(letter, plain key, key padded to four digits) of a lexicon number such as g03056; null for anything else."""
    q = F.trim(query)
    letter, number = F.upper(F.substring(q, 1, 1)), F.regexp_replace(q, r"\D", "").cast("int").cast("string")
    keys = F.struct(letter.alias("letter"), F.concat(letter, number).alias("plain"), F.concat(letter, F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)).alias("padded"))
    return F.when(q.rlike(r"(?i)^[GH]\s*0*\d{1,5}\z"), keys)


def grouped_number(value: Column) -> Column:
    return F.format_number(value, 0)


def url_path(text: Column) -> Column:
    """Percent-encoded as a path: a space is %20 and a slash stays."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def safe_filename(name: Column) -> Column:
    """Reserved characters become dashes, white space one space."""
    return compact(F.regexp_replace(F.coalesce(name, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', "-"))


def base_title(file_name: Column) -> Column:
    """A file's name without folders and ending."""
    return F.regexp_replace(F.regexp_replace(file_name, r"^.*[\\/]", ""), r"\.[^.]+\z", "")


def safe_key(key: Column) -> Column:
    """The key where it is edition/book of safe characters; an error otherwise."""
    return F.when(key.rlike(r"^[A-Za-z0-9._-]+/[A-Za-z0-9._-]+\z"), key).otherwise(F.raise_error(F.concat(F.lit("unsafe work key: "), F.coalesce(key, F.lit("null")))))


def data_url_bytes(url: Column) -> Column:
    """(kind, bytes) of an image data URL; null for others."""
    pattern = r"(?i)^data:(image/[a-z0-9.+-]+);base64,([a-z0-9+/=]+)\z"
    kind = F.regexp_extract(url, pattern, 1)
    return F.when(kind != "", F.struct(kind.alias("kind"), F.unbase64(F.regexp_extract(url, pattern, 2)).alias("bytes")))


def first_bytes(text: Column, most: Column) -> Column:
    """At most so many UTF-8 bytes of a text; a character that would be cut in two is left out."""
    data = F.encode(text, "UTF-8")
    high = lambda at: F.conv(F.hex(F.substr(data, at, F.lit(1))), 16, 10).cast("int")
    goes_on = high(most + 1).between(128, 191)
    back = F.when(~F.coalesce(goes_on, F.lit(False)), 0).when(high(most) >= 192, 1).when(high(most - 1) >= 192, 2).otherwise(3)
    return F.when(most <= 0, F.lit("")).when(F.octet_length(text) <= most, text).otherwise(F.decode(F.substr(data, F.lit(1), most - back), "UTF-8"))


def is_blank(text: Column) -> Column:
    return F.length(trimmed(F.coalesce(text, F.lit("")))) == 0
