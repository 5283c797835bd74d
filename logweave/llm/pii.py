"""Format-preserving pseudonyms for personal data, by keyed Feistel networks, in built-in expressions only.

What is found: e-mail addresses, IPv4 addresses with octets up to 255, phone numbers (+ and 8 to 15 digits, or three, three
and four digits), dates (ISO, dd.mm.yyyy, mm/dd/yyyy) that exist, card numbers of 13 to 19 digits that pass Luhn's check,
national ids nnn-nn-nnnn of valid parts, bank accounts (IBAN) whose remainder by 97 is 1, keys with a known prefix, and
hexadecimal secrets of 32 to 64 digits. Each is permuted within its format under a key, so a value has the same pseudonym
in every document, however it is spaced, and different values have different ones:

- strings are halved, and in each round every digit or letter of one half moves within its own class (digits, small
  letters, capitals, hexadecimal digits; beyond ASCII: Han characters, Hangul syllables, other small letters, capitals and
  the rest) by an amount drawn from the key, the round and the other half;
- a card or a phone number keeps its first digit and its separators, an account its country, an e-mail address its top-level
  domain, a key its prefix; cards and accounts get fresh check digits;
- addresses, national ids and dates are numbers (l, r) in a product of two ranges; each round adds to one what is drawn from
  the other. Dates from 1900-01-01 to 2100-05-01 are permuted among themselves, as are those before and those after.

What fails its validation stays as it is. Text without a digit or an @ is not searched for anything but keys.
The key is a parameter or the session's spark.logweave.pseudonymKey; the one in this file is for tests.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import texts

KEY = "logweave-pseudonyms-1"
ROUNDS = 8

#: A domain has at most 127 labels (it has 253 characters at the most), so the group that repeats them is bounded: Java's
#: matcher takes a piece of the stack for each repetition. Of a longer chain of labels the first ones are taken.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,125}\.[A-Za-z]{2,}"
#: How keys of well-known services begin.
PREFIX = r"(?:AKIA|ASIA|ghp_|gho_|ghs_|sk-|sk_live_|pk_live_|xox[abprs]-|AIza|glpat-)"
TOKEN = r"(?<![0-9A-Za-z_-])" + PREFIX + r"[0-9A-Za-z_-]{16,128}+"
ACCOUNT = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])"
ADDRESS = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
PHONE = r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?(?:\([0-9]{1,4}\)|[0-9]{2,4})){2,5}(?![0-9])"
DATE = r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9])"
SECRET = r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])"
NATIONAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
CARD = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
LOCAL = r"(?<![0-9.,+-])(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9.,-][0-9]|[0-9])"
ANY = "|".join([EMAIL, TOKEN, ACCOUNT, ADDRESS, PHONE, DATE, SECRET, NATIONAL, CARD, LOCAL])

#: First day and number of days of the ranges in which dates are permuted (to 1899-12-31, 2100-05-01, 9999-12-31), and two
#: factors whose product is the number or little more.
DAYS = [("0001-01-01", 693_595, (833, 833)), ("1900-01-01", 73_170, (270, 271)), ("2100-05-02", 2_885_294, (1699, 1699))]
#: Parts of national ids: 001 to 899 but 666, with 01 to 99; and 0001 to 9999.
NATIONAL_RANGES = (898 * 99, 9999)


def _beyond_ascii() -> list[str]:
    """Small letters, capitals, and other letters and numbers of the basic plane, without those moved by their codes."""
    found = {"Ll": [], "Lu": [], "": []}
    for code in range(0x80, 0x10000):
        kind = unicodedata.category(chr(code))
        if kind[0] in "LN" and not any(a <= code < a + n for a, n in CODES):
            found[kind if kind in found else ""].append(chr(code))
    return ["".join(x) for x in found.values()]


#: First code and number of the characters that are moved by their codes: Han, its extensions A and B, Hangul.
CODES = [(0x4E00, 20_976), (0x3400, 6_582), (0x20000, 42_711), (0xAC00, 11_172)]
CLASSES = _beyond_ascii()


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def rotate(c: Column, by: Column, hexadecimal: Column) -> Column:
    """A character moved within its class; hexadecimal: whether the class of small letters and digits is that of its digits."""
    digits = "0123456789abcdef"
    code = F.ascii(c)

    def within(first: str, size: int) -> Column:
        return F.char(F.pmod(code - ord(first) + by, F.lit(size)) + ord(first))

    moved = F.when(hexadecimal, F.substring(F.lit(digits), F.pmod(F.instr(F.lit(digits), c) - 1 + by, F.lit(16)) + 1, F.lit(1)))
    moved = moved.when(c.rlike("^[0-9]$"), within("0", 10)).when(c.rlike("^[a-z]$"), within("a", 26)).when(c.rlike("^[A-Z]$"), within("A", 26)).when(code < 128, c)
    for first, size in CODES:
        new = F.pmod(code - first + by, F.lit(size)) + first
        moved = moved.when(code.between(first, first + size - 1), F.decode(F.unhex(F.lpad(F.hex(new), 8, "0")), "UTF-32"))
    for these in CLASSES:
        place = F.instr(F.lit(these), c)
        moved = moved.when(place > 0, F.substring(F.lit(these), F.pmod(place - 1 + by, F.lit(len(these))) + 1, F.lit(1)))
    # letters outside these classes, all beyond the basic plane, become small letters, where two of them may meet
    return moved.otherwise(F.char(F.pmod(code + by, F.lit(26)) + ord("a")))


def permute_string(s: Column, key: str, tweak: Column | str, hexadecimal: Column | bool = False, rounds: int = ROUNDS) -> Column:
    """Feistel network over the classes of a string's characters; the format is the class at each place."""
    told, hexes = (F.lit(tweak) if isinstance(tweak, str) else tweak), (F.lit(hexadecimal) if isinstance(hexadecimal, bool) else hexadecimal)
    half = F.floor(F.length(s) / 2).cast("int")
    start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        moved, fixed = F.when(even, acc["b"]).otherwise(acc["a"]), F.when(even, acc["a"]).otherwise(acc["b"])
        drawn = F.sha2(F.concat_ws("|", F.lit(key), told, r.cast("string"), fixed).cast("binary"), 512)
        by = lambda d, i: F.conv(F.substring(d, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")
        new = let(drawn, lambda d: F.array_join(F.transform(F.split(moved, ""), lambda c, i: F.when(c == "", c).otherwise(rotate(c, by(d, i), hexes))), ""))
        return let(new, lambda n: F.struct(F.when(even, acc["a"]).otherwise(n).alias("a"), F.when(even, n).otherwise(acc["b"]).alias("b")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def permute_number(x: Column, ranges: tuple[Column | int, Column | int], key: str, tweak: Column | str, rounds: int = ROUNDS) -> Column:
    """A keyed permutation of 0 .. ranges[0] * ranges[1] - 1."""
    a, b = (F.lit(r).cast("long") if isinstance(r, int) else r for r in ranges)
    told = F.lit(tweak) if isinstance(tweak, str) else tweak
    start = F.struct(F.floor(x / b).cast("long").alias("l"), F.pmod(x, b).cast("long").alias("r"))

    def step(acc: Column, r: Column) -> Column:
        even = r % 2 == 0
        fixed, moved, size = F.when(even, acc["r"]).otherwise(acc["l"]), F.when(even, acc["l"]).otherwise(acc["r"]), F.when(even, a).otherwise(b)
        draw = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), told, r.cast("string"), fixed.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long")
        return let(F.pmod(moved + draw, size).cast("long"), lambda n: F.struct(F.when(even, n).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(n).alias("r")))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), start, step, lambda acc: acc["l"] * b + acc["r"])


def permute_below(x: Column, most: Column | int, ranges: tuple[Column | int, Column | int], key: str, tweak: Column | str) -> Column:
    """A keyed permutation of 0 .. most - 1: steps of a slightly larger one until the range is met again.

    At most 12 steps; at one chance in 2,000 to leave the range, a thirteenth would be needed once in 10^39 values.
    """
    step = lambda acc, _: F.when((acc >= 0) & (acc < most), acc).otherwise(permute_number(F.when(acc < 0, x).otherwise(acc), ranges, key, tweak))
    return F.aggregate(F.sequence(F.lit(1), F.lit(12)), F.lit(-1).cast("long"), step)


def digits_of(h: Column) -> Column:
    return F.regexp_replace(h, "[^0-9]", "")


def respelled(h: Column, new: Column) -> Column:
    """h with its letters and digits in order replaced by those of `new`, its other characters in place."""
    plain = lambda text: F.regexp_replace(text, "[^0-9A-Za-z]", "")
    return let(new, lambda n: F.array_join(F.transform(F.split(h, ""), lambda c, i: F.when(c.rlike("^[0-9A-Za-z]$"), F.substring(n, F.length(plain(F.substring(h, F.lit(1), i + 1))), F.lit(1))).otherwise(c)), ""))


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn's sum of a digit string; every second digit is doubled, the last one if doubled is 0, else the one before."""
    chars = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.transform(chars, lambda c, i: F.when(c == "", F.lit(0)).otherwise(F.when(i % 2 == doubled, F.get(F.array(*[F.lit(v) for v in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.coalesce(c.try_cast("int"), F.lit(0)))).otherwise(F.coalesce(c.try_cast("int"), F.lit(0))))),
        F.lit(0),
        lambda acc, v: acc + v,
    )


def remainder97(account: Column) -> Column:
    """An account's remainder by 97, its first four characters put last and letters read as 10 to 35."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = lambda c: F.when(c == "", F.lit(None)).when(c.rlike("^[0-9]$"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0), lambda acc, v: F.when(v.isNull(), acc).when(v < 10, (acc * 10 + v) % 97).otherwise((acc * 100 + v) % 97))


def kind_of(h: Column) -> Column:
    """What a found string is, if it is valid; null if it is not."""
    digits = digits_of(h)
    octets = F.transform(F.split(h, r"\."), lambda o: o.try_cast("long"))
    part = lambda a, n: F.substring(h, a, n).try_cast("int")
    sound = part(1, 3).between(1, 899) & (part(1, 3) != 666) & (part(5, 2) > 0) & (part(8, 4) > 0)
    return (
        F.when(h.contains("@"), "email")
        .when(h.rlike("^" + PREFIX), "token")
        .when(h.startswith("+") | h.rlike(r"^\(|^[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}$"), F.when(F.length(digits).between(8, 15), "phone"))
        .when(h.rlike(r"^([0-9]+\.){3}[0-9]+$"), F.when(F.array_max(octets) <= 255, "address"))
        .when(h.rlike("^([0-9a-f]{32,64}|[0-9A-F]{32,64})$"), "secret")
        .when(h.rlike("^[A-Z]"), F.when(remainder97(F.regexp_replace(h, " ", "")) == 1, "account"))
        .when(h.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), F.when(sound, "national"))
        .when((F.length(h) == 10) & h.rlike("[-./]"), F.when(day_of(h).isNotNull(), "date"))
        .when(luhn_sum(digits, 1) % 10 == 0, "card")
    )


def day_of(h: Column) -> Column:
    return F.coalesce(F.try_to_date(h, "yyyy-MM-dd"), F.try_to_date(h, "dd.MM.yyyy"), F.try_to_date(h, "MM/dd/yyyy"))


def texts_in(h: Column, kind: Column) -> Column:
    """What of a string is permuted as text: (text, tweak) for each part. Equal values give equal parts however they are spaced."""
    one = lambda text, tweak: F.struct(text.alias("text"), F.lit(tweak).alias("tweak"))
    domain, digits = F.substring_index(h, "@", -1), digits_of(h)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(F.substring_index(domain, ".", -1)) - 1)
    return (
        F.when(kind == "email", F.array(one(F.substring_index(h, "@", 1), "email"), one(name, "domain")))
        .when(kind == "token", F.array(one(F.regexp_replace(h, "^" + PREFIX, ""), "token")))
        .when(kind == "phone", F.array(one(F.substring(digits, F.lit(2), F.length(digits)), "phone")))
        .when(kind == "secret", F.array(one(F.lower(h), "secret")))
        .when(kind == "account", F.array(one(F.substring(F.regexp_replace(h, " ", ""), F.lit(5), F.length(h)), "account")))
        .when(kind == "card", F.array(one(F.substring(digits, F.lit(2), F.length(digits) - 2), "card")))
    )


def number_in(h: Column, kind: Column) -> Column:
    """What of a string is permuted as a number: (x, most, a, b, tweak), x below most, which a * b reaches."""
    one = lambda x, most, a, b, tweak: F.struct(x.cast("long").alias("x"), F.lit(most).cast("long").alias("most"), F.lit(a).cast("long").alias("a"), F.lit(b).cast("long").alias("b"), F.lit(tweak).alias("tweak"))
    octets = F.transform(F.split(h, r"\."), lambda o: o.try_cast("long"))
    part = lambda a, n: F.substring(h, a, n).try_cast("int")
    area = F.when(part(1, 3) > 666, part(1, 3) - 2).otherwise(part(1, 3) - 1)
    front, last = NATIONAL_RANGES
    found = F.when(kind == "address", one(F.aggregate(octets, F.lit(0).cast("long"), lambda acc, o: acc * 256 + o), 65536 * 65536, 65536, 65536, "address"))
    found = found.when(kind == "national", one((area * 99 + part(5, 2) - 1).cast("long") * last + part(8, 4) - 1, front * last, front, last, "national"))
    dated = None
    for begin, number, (a, b) in DAYS:
        # the middle range has had this tweak from the start, so its pseudonyms stay what they were
        at = lambda day, begin=begin: F.datediff(day, F.lit(begin).cast("date"))
        this = lambda day, at=at, number=number, a=a, b=b, begin=begin: one(at(day), number, a, b, "date" if a * b == number else f"date {begin}")
        dated = [*(dated or []), (at, number, this)]
    pick = lambda day: F.when(dated[0][0](day) < dated[0][1], dated[0][2](day)).when(dated[1][0](day) < dated[1][1], dated[1][2](day)).otherwise(dated[2][2](day))
    return found.when(kind == "date", let(day_of(h), pick))


def written(h: Column, kind: Column, texts: Column, n: Column, most: Column) -> Column:
    """A string of a kind anew, from its permuted texts, or its permuted number n below most."""
    one = F.get(texts, F.lit(0))
    digits, plain = digits_of(h), F.regexp_replace(h, " ", "")
    body = F.concat(F.substring(digits, 1, 1), one)
    checked = F.concat(body, F.pmod(-luhn_sum(body, 0), F.lit(10)).cast("string"))
    country = F.substring(plain, 1, 2)
    account = F.concat(country, F.lpad((98 - remainder97(F.concat(country, F.lit("00"), one))).cast("string"), 2, "0"), one)
    spelled = respelled(h, F.when(kind == "phone", body).when(kind == "card", checked).otherwise(account))
    dotted = F.concat_ws(".", *[F.pmod(F.floor(n / 256**k), F.lit(256)).cast("long").cast("string") for k in (3, 2, 1, 0)])
    front = F.floor(n / NATIONAL_RANGES[1])
    place = F.floor(front / 99)
    national = F.format_string("%03d-%02d-%04d", F.when(place >= 665, place + 2).otherwise(place + 1).cast("int"), (front % 99 + 1).cast("int"), (n % NATIONAL_RANGES[1] + 1).cast("int"))
    zero = F.lit(DAYS[2][0])
    for begin, number, _ in DAYS[:2]:
        zero = F.when(most == number, begin).otherwise(zero)
    formed = lambda x: F.when(h.contains("-"), F.date_format(x, "yyyy-MM-dd")).when(h.contains("/"), F.date_format(x, "MM/dd/yyyy")).otherwise(F.date_format(x, "dd.MM.yyyy"))
    day = let(F.date_add(zero.cast("date"), n.cast("int")), formed)
    return (
        F.when(kind == "email", F.concat(one, F.lit("@"), F.get(texts, F.lit(1)), F.lit("."), F.substring_index(h, ".", -1)))
        .when(kind == "token", F.concat(F.regexp_extract(h, "^" + PREFIX, 0), one))
        # capital and small spellings of one secret get one pseudonym, spelled alike
        .when(kind == "secret", F.when(h == F.lower(h), one).otherwise(F.upper(one)))
        .when(kind.isin("phone", "card", "account"), spelled)
        .when(kind == "address", dotted)
        .when(kind == "national", national)
        .when(kind == "date", day)
    )


def pseudonym(h: Column, key: str) -> Column:
    """The pseudonym of one found string, or the string itself where it is not valid.

    All kinds go through one network for texts and one for numbers, so the plan holds each once.
    """

    def anew(k: Column) -> Column:
        texts = F.transform(texts_in(h, k), lambda p: permute_string(p["text"], key, p["tweak"], p["tweak"] == "secret"))
        number = let(number_in(h, k), lambda v: F.when(v.isNotNull(), F.struct(permute_below(v["x"], v["most"], (v["a"], v["b"]), key, v["tweak"]).alias("n"), v["most"].alias("most"))))
        return let(F.struct(texts.alias("t"), number.alias("v")), lambda r: written(h, k, r["t"], r["v"]["n"], r["v"]["most"]))

    return let(kind_of(h), lambda k: F.when(k.isNull(), h).otherwise(anew(k)))


def key_of(docs: DataFrame, key: str | None) -> str:
    return key or docs.sparkSession.conf.get("spark.logweave.pseudonymKey", KEY)


def replaced(text: Column, key: str = KEY) -> tuple[Column, Column]:
    """The found strings of a text, and the text with their pseudonyms given the found strings as column `found`."""
    found = F.when(text.rlike("[0-9@]|" + PREFIX), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    between = F.split(text, ANY, -1)
    woven = F.zip_with(between, F.transform(F.col("found"), lambda h: pseudonym(h, key)), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return found, F.when(F.size("found") > 0, F.array_join(woven, "")).otherwise(text)


def pseudonymise(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_found) of every document, n_found being the strings that were looked at, valid or not.

    A null text gives an empty one; rows map one to one, so repeated rows stay repeated. Only doc_id and text are read.
    """
    found, text = replaced(F.col("text"), key_of(docs, key))
    return texts(docs).withColumn("found", found).select("doc_id", text.alias("text"), F.greatest(F.size("found"), F.lit(0)).cast("long").alias("n_found"))


def pseudonymise_column(docs: DataFrame, key: str | None = None, column: str = "text") -> DataFrame:
    """docs with one text column replaced and all other columns as they are; nulls stay null, empty texts empty."""
    found, text = replaced(F.col("text"), key_of(docs, key))
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{column}`").alias("text")).withColumn("found", found)
    return rows.select(*[text.alias(c) if c == column else k for c, k in zip(docs.columns, kept, strict=True)])
