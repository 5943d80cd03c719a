r"""Format-preserving pseudonyms for personal data.

Mails, phone numbers, account and card numbers, social security numbers, IBANs, IP addresses and
dates are found by pattern and checked; each is replaced by a keyed permutation of its own
format: letters stay letters of their case, digits digits, punctuation stays.  Equal values get equal
pseudonyms in every document and different values different ones, so links survive.

A value is a list of symbols, each with a radix (10 for a digit, 26 for a letter, 256 for an octet, 189 and
773 for the two halves of a day within 400 years).  A Feistel network over the two halves of the list
adds keyed hashes (SHA-256) of one half to the other, modulo the radices, so it never leaves the
format.  Check digits aren't permuted: a card number keeps its Luhn remainder (valid stays valid) and an
IBAN gets the check digits of its new account.  With the same key, ``reverse=True`` restores the texts.

Only built-in column functions.  The text is cut at the matches, matches are mapped, and the parts joined.

Defined results: a null text stays null; what fails its check (a date such as 2024-13-01, an octet over 255,
an IBAN with wrong check digits) isn't personal data of that kind and stays, unless it is of another kind; characters
that aren't ASCII letters or digits stay; spans don't overlap, the leftmost and then the first kind wins; equal rows get equal
results; other columns are kept, those named like a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packspark.llm.common import let

ROUNDS = 8
KEY = "pseudonyms-1"

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_NOT_IN_WORD = r"(?<![\p{L}\p{N}])"
_ENDS = r"(?![\p{L}\p{N}])"

# kind and pattern, in order of precedence at the same place
PATTERNS = (
    ("mail", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}" + _ENDS),
    ("iban", _NOT_IN_WORD + r"[A-Z]{2}\d{2}[A-Z0-9]{11,30}" + _ENDS),
    ("ip", r"(?<![\p{L}\p{N}]|\d\.)" + _OCTET + r"(?:\." + _OCTET + r"){3}(?![\p{L}\p{N}]|\.\d)"),
    ("date", _NOT_IN_WORD + r"(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})" + _ENDS),
    ("ssn", _NOT_IN_WORD + r"\d{3}-\d{2}-\d{4}" + _ENDS),
    ("account", _NOT_IN_WORD + r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}" + _ENDS),
    ("account", _NOT_IN_WORD + r"\d{13,19}" + _ENDS),
    ("phone", r"(?<![\p{L}\p{N}+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]\d{2,4}){2}(?:[ .-]\d{2}(?!\d)){0,2}" + _ENDS),
    ("phone", r"(?<![\p{L}\p{N}+])(?:\(\d{2,4}\) ?\d{3,4}|\d{3}[ .-]\d{3})[ .-]\d{4}" + _ENDS),
    ("phone", r"(?<![\p{L}\p{N}+])\+\d{7,15}" + _ENDS),
)
KINDS = tuple(dict.fromkeys(k for k, _ in PATTERNS))
ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
_SYMBOLS = "array<struct<v:bigint,r:bigint>>"

_DIGITS, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DATES = ((r"^\d{4}-", "yyyy-MM-dd"), (r"^\d{2}\.", "dd.MM.yyyy"), (r"^\d{2}/", "dd/MM/yyyy"))
_CYCLE, _HALF = 146097, 773       # days in 400 years = 189 * 773


def _stream(key: str, kind: Column, round_: Column, place: Column, other: Column) -> Column:
    """Keyed 32-bit number for one symbol: SHA-256 of key, kind, round, place and the other half."""
    text = F.concat_ws("|", F.lit(key), kind, round_.cast("string"), place.cast("string"), other)
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def permute(symbols: Column, kind: Column, key: str, reverse: bool = False) -> Column:
    """Permutes a list of (v, r) with 0 <= v < r within its radices; lists of one symbol get a keyed shift."""
    def network(s: Column) -> Column:
        half = F.floor(F.size(s) / 2).cast("int")
        start = F.struct(F.slice(s, F.lit(1), half).alias("a"), F.slice(s, half + 1, F.size(s) - half).alias("b"))
        rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if reverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

        def shift(changed: Column, other: Column, n: Column) -> Column:
            return let(F.array_join(F.transform(other, lambda x: x["v"].cast("string")), ","), lambda o: F.transform(
                changed, lambda x, i: F.struct(
                    F.pmod((x["v"] - _stream(key, kind, n, i, o) if reverse else x["v"] + _stream(key, kind, n, i, o)),
                           x["r"]).alias("v"), x["r"].alias("r"))))

        def step(acc: Column, n: Column) -> Column:
            even = n % 2 == 0
            return F.struct(F.when(even, acc["a"]).otherwise(shift(acc["a"], acc["b"], n)).alias("a"),
                            F.when(even, shift(acc["b"], acc["a"], n)).otherwise(acc["b"]).alias("b"))

        return F.aggregate(rounds, start, step, lambda acc: F.concat(acc["a"], acc["b"]))

    return let(symbols, network)


def _chars(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def _alphabet(c: Column) -> Column:
    return F.when(c.between("0", "9"), F.lit(_DIGITS)).when(c.between("A", "Z"), F.lit(_UPPER)) \
        .when(c.between("a", "z"), F.lit(_LOWER)).otherwise(F.lit(""))


def _permute_chars(value: Column, kind: Column, key: str, reverse: bool) -> Column:
    """Permutes the ASCII letters and digits of a string in place."""
    def put_back(chars: Column, symbols: Column) -> Column:
        start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
        return F.aggregate(chars, start, lambda acc, c: F.when(_alphabet(c) == "", F.struct(
            acc["i"].alias("i"), F.concat(acc["out"], c).alias("out"))).otherwise(F.struct(
                (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.substr(_alphabet(c), (F.get(symbols, acc["i"])["v"] + 1)
                                                                         .cast("int"), F.lit(1))).alias("out"))))["out"]

    def work(chars: Column) -> Column:
        own = F.filter(chars, lambda c: _alphabet(c) != "")
        symbols = F.transform(own, lambda c: F.struct((F.instr(_alphabet(c), c) - 1).cast("bigint").alias("v"),
                                                      F.length(_alphabet(c)).cast("bigint").alias("r")))
        return let(permute(symbols, kind, key, reverse), lambda s: put_back(chars, s))

    return let(_chars(value), work)


def _luhn(digits: Column) -> Column:
    """Luhn sum modulo 10 of a digit string."""
    n = F.length(digits)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + let(
        F.substr(digits, i, F.lit(1)).cast("int"), lambda d: F.when((n - i) % 2 == 0, d).otherwise(
            2 * d - F.when(d > 4, 9).otherwise(0))).cast("int")) % 10


def _account(value: Column, key: str, reverse: bool) -> Column:
    """Permutes all digits but the last, which then restores the Luhn remainder."""
    def work(old: Column) -> Column:
        n = F.length(value)
        body = _permute_chars(F.substr(value, F.lit(1), n - 1), F.lit("account"), key, reverse)
        digits = lambda s: F.regexp_replace(s, "[^0-9]", "")
        return let(body, lambda b: F.concat(b, F.pmod(
            old - _luhn(F.concat(digits(b), F.lit("0"))), F.lit(10)).cast("string")))

    return let(_luhn(F.regexp_replace(value, "[^0-9]", "")), work)


def _mod97(text: Column) -> Column:
    """The number that an IBAN's characters spell (letters as 10 to 35), modulo 97."""
    return F.aggregate(_chars(text), F.lit(0).cast("bigint"), lambda acc, c: F.when(
        c.between("0", "9"), acc * 10 + c.cast("bigint")).otherwise(acc * 100 + F.ascii(c) - 55) % 97)


def _iban_valid(value: Column) -> Column:
    return _mod97(F.concat(F.substr(value, F.lit(5)), F.substr(value, F.lit(1), F.lit(4)))) == 1


def _iban(value: Column, key: str, reverse: bool) -> Column:
    country = F.substr(value, F.lit(1), F.lit(2))
    return let(_permute_chars(F.substr(value, F.lit(5)), F.lit("iban"), key, reverse), lambda b: F.concat(
        country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))


def _ip(value: Column, key: str, reverse: bool) -> Column:
    octets = F.transform(F.split(value, r"\."), lambda x: F.struct(x.cast("bigint").alias("v"),
                                                                   F.lit(256).cast("bigint").alias("r")))
    return F.array_join(F.transform(permute(octets, F.lit("ip"), key, reverse), lambda x: x["v"].cast("string")), ".")


def _day(value: Column) -> Column:
    out = F.lit(None).cast("date")
    for pattern, form in _DATES:
        out = F.when(value.rlike(pattern), F.call_function("try_to_date", value, F.lit(form))).otherwise(out)
    return out


def _date(value: Column, key: str, reverse: bool) -> Column:
    """Permutes the day within its 400 years (counted from 1600, 2000 ...), where the calendar repeats."""
    def work(n: Column) -> Column:
        block = F.floor(n / _CYCLE)
        place = F.pmod(n, F.lit(_CYCLE))
        halves = F.array(F.struct(F.floor(place / _HALF).cast("bigint").alias("v"), F.lit(_CYCLE // _HALF).cast("bigint").alias("r")),
                         F.struct((place % _HALF).cast("bigint").alias("v"), F.lit(_HALF).cast("bigint").alias("r")))

        def show(s: Column) -> Column:
            day = F.date_add(F.lit("2000-01-01").cast("date"), (
                block * _CYCLE + F.get(s, 0)["v"] * _HALF + F.get(s, 1)["v"]).cast("int"))
            out = F.lit(None).cast("string")
            for pattern, form in _DATES:
                out = F.when(value.rlike(pattern), F.date_format(day, form)).otherwise(out)
            return out

        return let(permute(halves, F.lit("date"), key, reverse), show)

    return let(F.datediff(_day(value), F.lit("2000-01-01").cast("date")).cast("bigint"), work)


def _mail(value: Column, key: str, reverse: bool) -> Column:
    """Permutes the local part and the domain (without its last label), each on its own."""
    parts = F.split(value, "@")
    domain = F.get(parts, 1)
    last = F.substring_index(domain, ".", -1)
    rest = F.substr(domain, F.lit(1), F.length(domain) - F.length(last))
    return F.concat(_permute_chars(F.get(parts, 0), F.lit("mail"), key, reverse), F.lit("@"),
                    _permute_chars(rest, F.lit("domain"), key, reverse), last)


def kind_of(value: Column) -> Column:
    """Kind of a matched string, by the first pattern it is and the check of that kind; null if none holds."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(PATTERNS):
        fits = value.rlike("^(?:" + pattern + ")$")
        if kind == "iban":
            fits = fits & _iban_valid(value)
        if kind == "date":
            fits = fits & _day(value).isNotNull()
        out = F.when(fits, F.lit(kind)).otherwise(out)
    return out


def pseudonym(value: Column, kind: Column, key: str, reverse: bool = False) -> Column:
    return F.when(kind == "mail", _mail(value, key, reverse)).when(kind == "iban", _iban(value, key, reverse)) \
        .when(kind == "ip", _ip(value, key, reverse)).when(kind == "date", _date(value, key, reverse)) \
        .when(kind == "account", _account(value, key, reverse)) \
        .when(kind.isin("phone", "ssn"), _permute_chars(value, kind, key, reverse)).otherwise(value)


def pseudonymise(df: DataFrame, key: str = KEY, text: str = "text", reverse: bool = False) -> DataFrame:
    """Replaces ``text`` and adds ``n_<kind>`` (long) for each of KINDS: how many were replaced."""
    counts = [f"n_{k}" for k in KINDS]
    t = F.col(f"`{text}`")
    gaps, found = F.split(t, ANY, -1), F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    mapped = F.transform(found, lambda v: let(kind_of(v), lambda k: F.struct(
        k.alias("kind"), pseudonym(v, k, key, reverse).alias("value"))))
    cut = df.select(*[F.col(f"`{c}`") for c in df.columns if c not in counts],
                    F.when(t.rlike("[0-9@]") & t.rlike(ANY), F.struct(gaps.alias("gaps"), mapped.alias("new"))).alias("_pii"))
    new, at = F.col("_pii.new"), F.col("_pii.gaps")
    joined = F.array_join(F.transform(at, lambda g, i: F.concat(g, F.coalesce(F.get(new, i)["value"], F.lit("")))), "")
    keep = [F.when(F.col("_pii").isNull(), t).otherwise(joined).alias(text) if c == text else F.col(f"`{c}`")
            for c in df.columns if c not in counts]
    return cut.select(*keep, *[F.coalesce(F.size(F.filter(new, lambda x: x["kind"] == F.lit(kind))).cast("long"),
                                          F.lit(0).cast("long")).alias(f"n_{kind}") for kind in KINDS])
