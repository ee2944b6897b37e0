"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern, and each is replaced by a keyed surrogate of its own type and format.
The replacement of letters and digits is a format-preserving permutation: the string is cut in halves, and
four times one half's characters are moved within their own alphabet (digits, small or capital letters of
one script) by amounts taken from SHA-256 of the key, the kind, the round and the other half.  Every step
can be undone, so different originals of a kind get different surrogates and equal ones get equal ones
anywhere in the corpus, without a table of entities.  Letter case does not enter the hash, so spellings that
differ in case stay alike in that way.  Given names that are in the lists below move within their own gender
and script, by a keyed cycle.  Where an output would leave its own set (a made-up name that is a listed one,
a plain value that looks like a hexadecimal one), the permutation is applied again until it is back, which
keeps it one to one.  Other names keep their pattern of vowels and consonants, their script and case, and
Russian ones the ending that shows the gender.  A word of a name found in a text is replaced wherever it stands
alone in that text, so later mentions stay with the first.  Card numbers and account numbers get valid check
digits for valid ones; a long number without a valid check digit is no card and stays.
:func:`collisions` checks distinctness over a whole corpus.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Given names by gender and script, forms of address, alphabets.
NAMES = {
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Anna Emma Maria Laura Julia Sophie Claire Camille Carmen Lucia Ingrid Greta Heidi Petra".split(),
    ("m", "latin"): "James Robert John Michael David William Richard Joseph Thomas Charles Peter Paul Mark Stefan Hans Klaus Pierre Jacques Antoine Carlos Miguel Pablo Diego Javier".split(),
    ("f", "cyrillic"): "Анна Мария Ольга Елена Наталья Ирина Светлана Татьяна".split(),
    ("m", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Николай Михаил Павел".split(),
    ("f", "greek"): "Μαρία Ελένη Κατερίνα Σοφία Αγγελική Δήμητρα".split(),
    ("m", "greek"): "Γιώργος Νίκος Δημήτρης Κώστας Παναγιώτης Βασίλης".split(),
}
ADDRESSES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mademoiselle Señor Señora Señorita господин госпожа κύριος κυρία".split()
ALPHABETS = (
    "0123456789",
    "abcdefghijklmnopqrstuvwxyz",
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "àáâãäåæçèéêëìíîïñòóôõöøùúûüý",
    "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
    "αβγδεζηθικλμνξοπρστυφχψω",
    "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
)
HEX = ("0123456789abcdef",)
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüýаеёиоуыэюяαεηιουω"
ENDINGS = "ова ева ина ская цкая ов ев ин ский цкий".split()
#: Each alphabet of letters in two: vowels and consonants.
SOUNDS = tuple("".join(c for c in a if (c.lower() in VOWELS) is vowel) for a in ALPHABETS[1:] for vowel in (True, False))

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)"
_WORD = r"\p{Lu}[\p{L}'’\-]++"
_KNOWN = "|".join(n for names in NAMES.values() for n in names)
_CYRILLIC = "|".join(n for (_, script), names in NAMES.items() if script == "cyrillic" for n in names)
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]{1,63}(?:\.[\p{L}\p{N}\-]{1,63}){0,6}\.\p{L}{2,24}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp|gho|sk)[_\-][A-Za-z0-9]{16,}+",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_\-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_\-/+]{6,}+",
    "ip": rf"(?<![\d.vV])(?<!ersion )(?<!elease )(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)|(?<![\w.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\w\-])",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "card": r"(?<![\w])\d(?:[ \-]?\d){12,18}(?!\w)",
    "name": rf"(?<!\p{{L}})(?:(?:{'|'.join(ADDRESSES)})\.?\s{{1,3}}{_WORD}(?:\s{{1,3}}{_WORD}){{0,2}}|(?:{_KNOWN})\s{{1,3}}{_WORD}|\p{{Lu}}\p{{Ll}}++(?<={'|'.join(ENDINGS)})\s{{1,3}}(?:{_CYRILLIC}))(?!\p{{L}})",
}
ANY = "|".join(PATTERNS.values())
#: What any entity holds; texts without are passed on untouched.
HINT = r"[0-9@=:]|(?<!\p{L})(?:" + "|".join(ADDRESSES) + "|" + _KNOWN + r")(?!\p{L})"


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _moved(s: Column, other: Column, key: str, kind: str, round_: Column, alphabets) -> Column:
    """Characters of s moved within their alphabets by amounts that depend on all else."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), F.length(s).cast("string"), F.lower(other)), 256)

    def moved(c: Column, i: Column) -> Column:
        amount = F.conv(F.substr(digest, ((i * 4) % 61 + 1).cast("int"), F.lit(4)), 16, 10).cast("int") + F.floor(i / 15).cast("int") * 7
        out = None
        for a in alphabets:
            at = F.position(c, F.lit(a))
            new = F.substr(F.lit(a), ((at - 1 + amount) % len(a) + 1).cast("int"), F.lit(1))
            out = F.when(at > 0, new) if out is None else out.when(at > 0, new)
        return out.otherwise(c)

    return F.array_join(F.transform(_chars(s), moved), "")


def permuted(s: Column, key: str, kind: str, alphabets=ALPHABETS) -> Column:
    """The keyed permutation of the strings of one format."""
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substr(s, F.lit(1), half).alias("l"), F.substr(s, half + 1).alias("r"))

    def step(acc: Column, n: Column) -> Column:
        odd = F.struct(_moved(acc["l"], acc["r"], key, kind, n, alphabets).alias("l"), acc["r"].alias("r"))
        even = F.struct(acc["l"].alias("l"), _moved(acc["r"], acc["l"], key, kind, n, alphabets).alias("r"))
        return F.when(n % 2 == 1, odd).otherwise(even)

    return F.aggregate(F.array(*[F.lit(n) for n in (1, 2, 3, 4)]), start, step, lambda acc: F.concat(acc["l"], acc["r"]))


def _walked(s: Column, again, key: str, kind: str, alphabets=ALPHABETS) -> Column:
    """Permute until ``again`` is false; a start outside the bad set always gets back out of it."""
    first = permuted(s, key, kind, alphabets)
    return F.aggregate(F.array(*[F.lit(n) for n in (1, 2, 3)]), first, lambda acc, n: F.when(again(acc), permuted(acc, key, kind, alphabets)).otherwise(acc))


def _refilled(s: Column, digits: Column) -> Column:
    """s with its digits replaced by ``digits``, in order."""
    return F.array_join(F.zip_with(F.split(s, "[0-9]", -1), _chars(digits), lambda p, d: F.concat(p, F.coalesce(d, F.lit("")))), "")


def _luhn(digits: Column) -> Column:
    """The check digit that the digits call for."""
    values = F.transform(F.reverse(_chars(digits)), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return (10 - F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10) % 10


def _is_card(e: Column) -> Column:
    """Whether the digits end in the check digit that the others call for."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    return F.substr(digits, F.length(digits)).cast("int") == _luhn(F.substr(digits, F.lit(1), F.length(digits) - 1))


def _card(e: Column, key: str) -> Column:
    digits = F.regexp_replace(e, "[^0-9]", "")
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), permuted(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card"))
    whole = F.aggregate(F.array(F.lit(0)), body, lambda a, _: a, lambda a: F.concat(a, _luhn(a).cast("string")))
    return _refilled(e, whole)


def _remainder(s: Column) -> Column:
    """The number that digits and capital letters (A = 10 .. Z = 35) spell, modulo 97."""
    value = lambda c: F.position(c, F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ")) - 1
    return F.aggregate(_chars(s), F.lit(0), lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def _iban(e: Column, key: str) -> Column:
    """Country kept, account permuted; the check digits are right for the new account if they were for the old."""
    country, check, account = F.substr(e, F.lit(1), F.lit(2)), F.substr(e, F.lit(3), F.lit(2)), F.substr(e, F.lit(5))
    plain = lambda c: F.regexp_replace(c, " ", "")
    right = _remainder(F.concat(plain(account), country, check)) == 1
    new = permuted(account, key, "iban")
    digits = F.aggregate(F.array(F.lit(0)), new, lambda a, _: a, lambda a: F.concat(F.lpad((98 - _remainder(F.concat(plain(a), country, F.lit("00")))).cast("string"), 2, "0"), a))
    return F.concat(country, F.when(right, digits).otherwise(permuted(F.concat(check, account), key, "iban-other")))


def _phone(e: Column, key: str) -> Column:
    digits = F.regexp_replace(e, "[^0-9]", "")
    keep = F.greatest(F.length(digits) - 10, F.lit(0))
    return _refilled(e, F.concat(F.substr(digits, F.lit(1), keep), permuted(F.substr(digits, keep + 1), key, "phone")))


def _ip(e: Column, key: str) -> Column:
    o = F.transform(F.split(e, r"\."), lambda x: x.cast("int"))
    start = F.struct((F.element_at(o, 1) * 256 + F.element_at(o, 2)).alias("l"), (F.element_at(o, 3) * 256 + F.element_at(o, 4)).alias("r"))

    def mixed(a: Column, b: Column, n: Column) -> Column:
        return (a + F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("ip"), n.cast("string"), b.cast("string")), 256), 1, 6), 16, 10).cast("int")) % 65536

    def step(acc: Column, n: Column) -> Column:
        odd = F.struct(mixed(acc["l"], acc["r"], n).alias("l"), acc["r"].alias("r"))
        even = F.struct(acc["l"].alias("l"), mixed(acc["r"], acc["l"], n).alias("r"))
        return F.when(n % 2 == 1, odd).otherwise(even)

    def shown(acc: Column) -> Column:
        parts = [F.floor(acc["l"] / 256), acc["l"] % 256, F.floor(acc["r"] / 256), acc["r"] % 256]
        return F.concat_ws(".", *[p.cast("int").cast("string") for p in parts])

    return F.aggregate(F.array(*[F.lit(n) for n in (1, 2, 3, 4)]), start, step, shown)


def _email(e: Column, key: str) -> Column:
    local, host = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    top = F.substring_index(host, ".", -1)
    inner = F.substr(host, F.lit(1), F.length(host) - F.length(top) - 1)
    return F.concat(permuted(local, key, "local"), F.lit("@"), permuted(inner, key, "host"), F.lit("."), top)


def _secret(e: Column, key: str) -> Column:
    label = F.regexp_extract(e, r"(?s)^(.*?[=:]\s*[\"']?)", 1)
    value = F.substr(e, F.length(label) + 1)
    is_hex = lambda c: c.rlike("^[0-9a-f]+$")
    return F.concat(label, F.when(is_hex(value), permuted(value, key, "hex", HEX)).otherwise(_walked(value, is_hex, key, "secret")))


def _given_names(key: str) -> dict[str, str]:
    out = {}
    for (gender, script), names in NAMES.items():
        order = sorted(names, key=lambda n: hashlib.sha256(f"{key}|{gender}|{script}|{n}".encode()).digest())
        out |= {a: b for a, b in zip(order, order[1:] + order[:1])}
    return out


def _name_word(w: Column, key: str) -> Column:
    """The surrogate of one word of a name; forms of address stay."""
    given = _given_names(key)
    listed = F.create_map(*[F.lit(x) for pair in given.items() for x in pair])
    ending = F.regexp_extract(w, f"^..+?({'|'.join(ENDINGS)})$", 1)
    taken = lambda c: F.array_contains(F.array(*[F.lit(n) for n in (*given, *ADDRESSES)]), c) | c.rlike(f"^..+?(?:{'|'.join(ENDINGS)})$")
    kept_ending = F.concat(permuted(F.substr(w, F.lit(1), F.length(w) - F.length(ending)), key, "name", SOUNDS), ending)
    made = F.when(F.length(ending) > 0, kept_ending).otherwise(_walked(w, taken, key, "name", SOUNDS))
    return F.when(_is_address(w), w).when(listed[w].isNotNull(), listed[w]).otherwise(made)


def _is_address(w: Column) -> Column:
    return F.array_contains(F.array(*[F.lit(a) for a in ADDRESSES], *[F.lit(f"{a}.") for a in ADDRESSES]), w)


def _name(e: Column, key: str) -> Column:
    words, gaps = F.split(e, r"\s+", -1), F.regexp_extract_all(e, F.lit(r"\s+"), F.lit(0))
    return F.array_join(F.zip_with(F.transform(words, lambda w: _name_word(w, key)), gaps, lambda w, g: F.concat(w, F.coalesce(g, F.lit("")))), "")


def _later_mentions(part: Column, names: Column, key: str) -> Column:
    """A stretch between entities with the words of ``names`` replaced where they stand alone."""
    word = r"\p{L}[\p{L}'’\-]*"
    words, gaps = F.regexp_extract_all(part, F.lit(word), F.lit(0)), F.split(part, word, -1)
    new = F.transform(words, lambda w: F.when(F.array_contains(names, w), _name_word(w, key)).otherwise(w))
    return F.array_join(F.zip_with(gaps, new, lambda g, w: F.concat(g, F.coalesce(w, F.lit("")))), "")


def kind_of(e: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        test = e.rlike(f"^(?:{pattern})$")
        out = F.when(test, kind) if out is None else out.when(test, kind)
    return out.otherwise("card")


def surrogate(e: Column, key: str) -> Column:
    """The surrogate of one entity, as its text stands."""
    return (
        F.when(e.contains("@"), _email(e, key))
        .when(e.rlike("^(?:AKIA|ASIA)"), F.concat(F.substr(e, F.lit(1), F.lit(4)), permuted(F.substr(e, F.lit(5)), key, "key")))
        .when(e.rlike(r"^(?:ghp|gho|sk)[_\-]"), F.concat(F.regexp_extract(e, r"^(\w{2,3}[_\-])", 1), permuted(F.regexp_replace(e, r"^(?:ghp|gho|sk)[_\-]", ""), key, "key")))
        .when(e.rlike(f"^(?:{PATTERNS['secret']})$"), _secret(e, key))
        .when(e.rlike(f"^(?:{PATTERNS['ip']})$"), _ip(e, key))
        .when(e.rlike(f"^(?:{PATTERNS['iban']})$"), _iban(e, key))
        .when(e.rlike(f"^(?:{PATTERNS['phone']})$"), _phone(e, key))
        .when(e.rlike(f"^(?:{PATTERNS['ssn']})$"), permuted(e, key, "ssn"))
        .when(e.rlike("^[0-9]"), F.when(_is_card(e), _card(e, key)).otherwise(e))
        .otherwise(_name(e, key))
    )


def _found(t: Column) -> Column:
    """The entities of a text in order, as they split it; among them long numbers that turn out to be no cards."""
    return F.when(t.rlike(HINT), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _is_entity(e: Column) -> Column:
    return ~(e.rlike(f"^(?:{PATTERNS['card']})$") & ~e.rlike(f"^(?:{PATTERNS['phone']})$") & ~_is_card(e))


def replace(docs: DataFrame, text_col: str = "text", key: str = "tissueloom", with_counts: bool = False) -> DataFrame:
    """``docs`` with entities in ``text_col`` replaced; all other columns and rows as they were.

    Null and empty texts stay as they are.  With counts, n_entities, n_distinct (different entities of the
    text) and n_surrogates (different surrogates) are added; the last two are equal, unless two spellings
    that differ only in marks fell together.  No shuffle: equal entities get equal surrogates by the key alone.
    """
    t = F.col(f"`{text_col}`")
    free = [f"_tl{k}" for k in range(len(docs.columns) + 3) if f"_tl{k}" not in docs.columns][:3]
    found, new, names = free
    out = docs.withColumn(found, _found(t))
    out = out.withColumn(new, F.transform(found, lambda e: surrogate(e, key)))
    words = F.flatten(F.transform(F.filter(found, lambda e: e.rlike(r"^\p{L}") & e.rlike(f"^(?:{PATTERNS['name']})$")), lambda e: F.split(e, r"\s+", -1)))
    out = out.withColumn(names, F.when(F.size(found) > 0, F.filter(F.array_distinct(words), lambda w: ~_is_address(w) & (F.length(w) > 2))).otherwise(F.array().cast("array<string>")))
    parts = F.split(t, ANY, -1)
    parts = F.when(F.size(names) > 0, F.transform(parts, lambda p: _later_mentions(p, F.col(names), key))).otherwise(parts)
    joined = F.array_join(F.zip_with(parts, F.col(new), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    out = out.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(t))
    if with_counts:
        size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
        real = F.filter(found, _is_entity)
        out = out.withColumns({"n_entities": size(real), "n_distinct": size(F.array_distinct(real)), "n_surrogates": size(F.array_distinct(F.transform(F.array_distinct(real), lambda e: surrogate(e, key))))})
    return out.drop(*free)


def entities(docs: DataFrame, text_col: str = "text", key: str = "tissueloom") -> DataFrame:
    """(kind, entity, surrogate, n) of the corpus: different entities with their number of occurrences."""
    t = F.col(f"`{text_col}`")
    each = docs.filter(t.rlike(HINT)).select(F.explode(F.regexp_extract_all(t, F.lit(ANY), F.lit(0))).alias("entity"))
    counted = each.filter(_is_entity(F.col("entity"))).groupBy("entity").agg(F.count("*").alias("n"))
    return counted.select(kind_of(F.col("entity")).alias("kind"), "entity", surrogate(F.col("entity"), key).alias("surrogate"), "n")


def collisions(docs: DataFrame, text_col: str = "text", key: str = "tissueloom") -> DataFrame:
    """(kind, surrogate, originals) of surrogates shared by different entities; none are expected."""
    return entities(docs, text_col, key).groupBy("kind", "surrogate").agg(F.count("*").alias("originals")).filter("originals > 1")
