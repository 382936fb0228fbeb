r"""PII: format-preserving Feistel pseudonyms, in DataFrame functions only.

Found, validated and permuted, each within its own format and under a key:

    card     13 to 19 digits that pass Luhn: the first digit stays, those
             between are permuted, the check digit is computed anew
    IBAN     two letters, check digits and an account that pass mod 97, all
             digits (spaced in any way) or letters and digits (together or in
             groups of four): digits are permuted among digits, letters among
             letters, the check digits computed anew
    phone    North American numbers (area and exchange from 200): the whole
             is permuted among such; other numbers with + and 8 to 15 digits:
             all but the first three digits are permuted
    SSN      ddd-dd-dddd with a valid area, group and serial
    IPv4     four numbers up to 255
    IPv6     eight groups of lower-case hexadecimal digits
    date     yyyy-mm-dd, d.m.yyyy and d/m/yyyy from 1900 to 2099 that exist
             (days first; months first where that alone exists, and it stays
             so): each field keeps its number of digits, so dates are permuted
             among those of the same notation
    e-mail   the letters and the digits of the part before @, capitals where
             capitals were

Digits are counted, permuted, and put back where digits were, so separators
stay; two notations of one number get one pseudonym. A value (A, B) of a domain
m x n goes through ``ROUNDS`` Feistel rounds, A += F(B) mod m and B += F(A) mod
n in turn, F from SHA-256 of key, kind, round and half; so it is a permutation
of the domain, equal values stay linked across documents, and whoever holds
the key can undo it. Dates lie in a domain a little larger than their number
and are permuted again until they are dates (cycle walking).

Defined results: null text stays null, and text without a match stays as it
is; matches that don't validate stay; a value may be its own pseudonym (one in
ten single digits is) and is then not reported; rows are independent, so
repeated rows, null identifiers, ties and empty tables need no rule. All columns
are kept, whatever their names: rows lie in the struct ``row``, what was
replaced in ``found``. There is no default key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ROUNDS = 10

# The formats. A match begins and ends where a longer one could not go on.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:(?: ?\d){11,30}|[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"
IPV4 = r"(?<![0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![0-9]|\.[0-9])"
IPV6 = r"(?<![0-9A-Za-z:.])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![0-9A-Za-z:]|\.[0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:(?:19|20)\d{2}-\d{2}-\d{2}|\d{1,2}[./]\d{1,2}[./](?:19|20)\d{2})(?![0-9A-Za-z]|[./-][0-9])"
SSN = r"(?<![0-9-])\d{3}-\d{2}-\d{4}(?![0-9]|-[0-9])"
PHONE = r"(?<![0-9+])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]\d{4}(?![0-9])|(?<![0-9+])\+?1[2-9]\d{2}[2-9]\d{6}(?![0-9])"
ABROAD = r"(?<![0-9+])\+[1-9](?:[ .()/-]{0,2}\d){7,14}(?![0-9])"
CARD = r"(?<![0-9])\d(?:[ -]?\d){12,18}(?![0-9])"
ANY = "|".join((EMAIL, IBAN, IPV4, IPV6, DATE, SSN, PHONE, ABROAD, CARD))


def _power(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**k) for k in range(19))), n + 1)


def _f(key: str, kind: str, r: Column, half: Column, size: Column) -> Column:
    h = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), r.cast("string"), half.cast("string"), size.cast("string")), 256)
    return F.conv(F.substring(h, 1, 15), 16, 10).cast("long")


def feistel(a: Column, m: Column, b: Column, n: Column, key: str, kind: str, undo: bool = False) -> Column:
    """struct(a, b): the permutation of 0..m-1 x 0..n-1, or its inverse."""
    a, b, m, n = (x.cast("long") for x in (a, b, m, n))
    sign = -1 if undo else 1

    def step(s: Column, r: Column) -> Column:
        even = r % 2 == 0
        new_a = F.when(even, F.pmod(s.a + sign * (_f(key, kind, r, s.b, n) % m), m)).otherwise(s.a)
        new_b = F.when(even, s.b).otherwise(F.pmod(s.b + sign * (_f(key, kind, r, s.a, m) % n), n))
        return F.struct(new_a.cast("long").alias("a"), new_b.cast("long").alias("b"), s.m.alias("m"), s.n.alias("n"))

    rounds = range(ROUNDS - 1, -1, -1) if undo else range(ROUNDS)
    start = F.struct(a.alias("a"), b.alias("b"), m.alias("m"), n.alias("n"))

    def bound(s: Column, r: Column) -> Column:
        nonlocal m, n
        m, n = s.m, s.n
        return step(s, r)

    return F.aggregate(F.array(*map(F.lit, rounds)), start, bound)


def permute_digits(d: Column, key: str, kind: str, undo: bool = False) -> Column:
    """A string of 1 to 30 digits as another of the same length."""
    n = F.length(d)
    half = F.floor(n / 2).cast("int")
    a, b = F.concat(F.lit("0"), F.substr(d, F.lit(1), half)).cast("long"), F.substr(d, half + 1, n - half).cast("long")
    s = feistel(a, _power(half), b, _power(n - half), key, kind, undo)
    return F.transform(F.array(s), lambda s: F.concat(F.lpad(s.a.cast("string"), half, "0"), F.lpad(s.b.cast("string"), n - half, "0")))[0]


def put_back(text: Column, new: Column, pattern: str = "[0-9]") -> Column:
    """``text`` with its characters of the class replaced, in order, by those of ``new``, as capitals where they were."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"), new.alias("new"))

    def step(s: Column, c: Column) -> Column:
        own, x = c.rlike(pattern), F.substr(s.new, s.at, F.lit(1))
        return F.struct(F.concat(s.out, F.when(own, F.when(c.rlike("[A-Z]"), F.upper(x)).otherwise(x)).otherwise(c)).alias("out"), F.when(own, s.at + 1).otherwise(s.at).alias("at"), s.new.alias("new"))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step).out


def in_pieces(x: Column, pattern: str, piece) -> Column:
    """Each piece of at most so many characters as the pattern takes, replaced by itself."""
    return F.array_join(F.transform(F.regexp_extract_all(x, F.lit(pattern), 0), piece), "")


def permute_number(p: Column, alphabet: str, key: str, kind: str, undo: bool) -> Column:
    """A piece of at most 12 characters of the alphabet as a number in its base, cut in two halves and permuted."""
    base = len(alphabet)
    value = lambda t: F.aggregate(F.filter(F.split(t, ""), lambda c: c != ""), F.lit(0).cast("long"), lambda s, c: s * base + F.instr(F.lit(alphabet), c) - 1)
    half = F.floor(F.length(p) / 2).cast("int")
    size = lambda k: F.element_at(F.array(*(F.lit(base**i) for i in range(13))), k + 1)
    s = feistel(value(F.substr(p, F.lit(1), half)), size(half), value(F.substr(p, half + 1)), size(F.length(p) - half), key, kind, undo)
    letter = lambda v, k, i: F.substr(F.lit(alphabet), (F.floor(v / size(k - i)) % base + 1).cast("int"), F.lit(1))
    text = lambda v, k: F.when(k > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda i: letter(v, k, i)), "")).otherwise("")
    return let(s, lambda s: F.concat(text(s.a, half), text(s.b, F.length(p) - half)))


def _letters(x: Column, key: str, undo: bool) -> Column:
    """Lower-case letters in pieces of 12."""
    return in_pieces(x, "[a-z]{1,12}", lambda p: permute_number(p, "abcdefghijklmnopqrstuvwxyz", key, "letters", undo))


def _digits(x: Column, key: str, kind: str, undo: bool) -> Column:
    return in_pieces(x, "[0-9]{1,30}", lambda p: permute_digits(p, key, kind, undo))


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def luhn_sum(d: Column) -> Column:
    """Luhn's sum of digits of which the last is the check digit."""
    digits = F.transform(F.filter(F.split(F.reverse(d), ""), lambda c: c != ""), lambda c, i: c.cast("int") * (1 + i % 2))
    return F.aggregate(digits, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def _card(digits: Column, key: str, undo: bool) -> Column:
    inner = permute_digits(F.substr(digits, F.lit(2), F.length(digits) - 2), key, "card", undo)
    body = F.concat(F.substring(digits, 1, 1), inner)
    return let(body, lambda x: F.concat(x, F.pmod(10 - luhn_sum(F.concat(x, F.lit("0"))) % 10, F.lit(10)).cast("string")))


def _mod97(x: Column) -> Column:
    """Of an IBAN with the first four characters moved to the end, letters as numbers from 10."""
    codes = F.filter(F.split(F.concat(F.substr(x, F.lit(5)), F.substring(x, 1, 4)), ""), lambda c: c != "")
    number = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.transform(codes, number), F.lit(0), lambda s, v: F.when(v > 9, (s * 100 + v) % 97).otherwise((s * 10 + v) % 97))


def _iban(x: Column, key: str, undo: bool) -> Column:
    account = F.substr(x, F.lit(5))
    new = put_back(account, _digits(F.regexp_replace(account, "[^0-9]", ""), key, "iban", undo))
    new = put_back(new, _letters(F.lower(F.regexp_replace(account, "[^A-Z]", "")), key, undo), "[A-Z]")
    return let(new, lambda y: F.concat(F.substring(x, 1, 2), F.lpad((98 - _mod97(F.concat(F.substring(x, 1, 2), F.lit("00"), y))).cast("string"), 2, "0"), y))


def _phone(digits: Column, key: str, undo: bool) -> Column:
    """Area 200-999, exchange 200-999, line: 80,000 x 80,000 numbers."""
    d = F.substr(digits, F.length(digits) - 9, F.lit(10))
    n = ((F.substring(d, 1, 3).cast("long") - 200) * 800 + F.substring(d, 4, 3).cast("long") - 200) * 10000 + F.substring(d, 7, 4).cast("long")
    s = let(n, lambda n: feistel(F.floor(n / 80000), F.lit(80000), n % 80000, F.lit(80000), key, "phone", undo))
    back = let(s, lambda s: s.a * 80000 + s.b)
    new = let(back, lambda n: F.concat((F.floor(n / 8000000) + 200).cast("string"), (F.floor(n / 10000) % 800 + 200).cast("string"), F.lpad((n % 10000).cast("string"), 4, "0")))
    return F.concat(F.substr(digits, F.lit(1), F.length(digits) - 10), new)


def _ssn(d: Column, key: str, undo: bool) -> Column:
    """Areas 1-665 and 667-899 are 0..897; group and serial are 99 x 9,999 numbers."""
    area = F.substring(d, 1, 3).cast("long")
    a = F.when(area > 666, area - 2).otherwise(area - 1)
    b = (F.substring(d, 4, 2).cast("long") - 1) * 9999 + F.substring(d, 6, 4).cast("long") - 1
    s = feistel(a, F.lit(898), b, F.lit(989901), key, "ssn", undo)
    return let(s, lambda s: F.concat(F.lpad(F.when(s.a >= 665, s.a + 2).otherwise(s.a + 1).cast("string"), 3, "0"), F.lpad((F.floor(s.b / 9999) + 1).cast("string"), 2, "0"), F.lpad((s.b % 9999 + 1).cast("string"), 4, "0")))


def _ipv4(x: Column, key: str, undo: bool) -> Column:
    q = lambda k: F.split(x, r"\.")[k].cast("long")
    s = feistel(q(0) * 256 + q(1), F.lit(65536), q(2) * 256 + q(3), F.lit(65536), key, "ipv4", undo)
    return let(s, lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.floor(s.a / 256), s.a % 256, F.floor(s.b / 256), s.b % 256))))


def _ipv6(x: Column, key: str, undo: bool) -> Column:
    hexa = F.regexp_replace(x, ":", "")
    return put_back(x, in_pieces(hexa, "[0-9a-f]{1,12}", lambda p: permute_number(p, "0123456789abcdef", key, "ipv6", undo)), "[0-9a-f]")


def _exists(y: Column, m: Column, d: Column) -> Column:
    text = F.concat_ws("-", y.cast("string"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()


def parse_date(x: Column) -> Column:
    """struct(y, m, d, months_first, and the fields as written: df, mf) of a date in one of the notations; null if it does not exist."""
    p = F.split(x, "[./-]")

    def read(y: Column, m: Column, d: Column, months_first: bool) -> Column:
        yy, mm, dd = (v.cast("int") for v in (y, m, d))
        found = F.struct(yy.alias("y"), mm.alias("m"), dd.alias("d"), F.lit(months_first).alias("months_first"), d.alias("df"), m.alias("mf"))
        return F.when(mm.between(1, 12) & dd.between(1, 31) & _exists(yy, mm, dd), found)

    iso = F.when(x.contains("-"), read(p[0], p[1], p[2], False))
    return F.coalesce(iso, F.when(~x.contains("-"), F.coalesce(read(p[2], p[1], p[0], False), read(p[2], p[0], p[1], True))))


def _date(x: Column, key: str, undo: bool) -> Column:
    """Among the dates whose fields are written alike: days (months) of one digit, of two, and with or without a leading zero where the other field tells them apart."""

    def new(t: Column) -> Column:
        one_d, one_m = F.length(t.df) == 1, F.length(t.mf) == 1
        zero_d, zero_m = t.df.startswith("0"), t.mf.startswith("0")
        few_d, many_d = one_d | one_m & zero_d, one_m & ~one_d & ~zero_d
        few_m, many_m = one_m | one_d & zero_m, one_d & ~one_m & ~zero_m
        low_d = F.when(t.months_first, 13).when(many_d, 10).otherwise(1)
        high_d = F.when(few_d & ~t.months_first, 9).otherwise(31)
        low_m, high_m = F.when(many_m, 10).otherwise(1), F.when(few_m, 9).otherwise(12)
        box = F.struct(low_d.alias("d0"), (high_d - low_d + 1).alias("nd"), low_m.alias("m0"), (high_m - low_m + 1).alias("nm"))

        def permuted(b: Column) -> Column:
            def once(y: Column, m: Column, d: Column) -> Column:
                s = feistel((y - 1900) * b.nm + m - b.m0, 200 * b.nm, d - b.d0, b.nd, key, "date", undo)
                return let(s, lambda s: F.struct((F.floor(s.a / b.nm) + 1900).cast("int").alias("y"), (s.a % b.nm + b.m0).cast("int").alias("m"), (s.b + b.d0).cast("int").alias("d")))

            walked = F.aggregate(F.sequence(F.lit(1), F.lit(32)), once(t.y, t.m, t.d), lambda v, _: F.when(_exists(v.y, v.m, v.d), v).otherwise(once(v.y, v.m, v.d)))
            return let(walked, shown)

        def shown(v: Column) -> Column:
            day, month = F.lpad(v.d.cast("string"), F.length(t.df), "0"), F.lpad(v.m.cast("string"), F.length(t.mf), "0")
            sep = F.when(x.contains("/"), "/").otherwise(".")
            return F.when(x.contains("-"), F.concat_ws("-", v.y.cast("string"), month, day)).when(t.months_first, F.concat(month, sep, day, sep, v.y.cast("string"))).otherwise(F.concat(day, sep, month, sep, v.y.cast("string")))

        return let(box, permuted)

    return let(parse_date(x), new)


def _email(x: Column, key: str, undo: bool) -> Column:
    """The digits before @ among digits, its letters among letters."""
    local, rest = F.split_part(x, F.lit("@"), F.lit(1)), F.split_part(x, F.lit("@"), F.lit(2))
    new_letters = _letters(F.lower(F.regexp_replace(local, "[^A-Za-z]", "")), key, undo)
    new_digits = _digits(F.regexp_replace(local, "[^0-9]", ""), key, "digits", undo)
    return F.concat(put_back(put_back(local, new_letters, "[A-Za-z]"), new_digits), F.lit("@"), rest)


def pseudonym(x: Column, key: str, undo: bool = False) -> Column:
    """struct(kind, new): what a match is, if it validates, and its pseudonym."""
    whole = lambda p: x.rlike(rf"\A(?:{p})\z")
    digits = F.regexp_replace(x, "[^0-9]", "")
    flat = F.regexp_replace(x, " ", "")
    octets = F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255)
    case = lambda *rows: F.coalesce(*(F.when(test, F.struct(F.lit(kind).alias("kind"), new.alias("new"))) for test, kind, new in rows), F.struct(F.lit(None).cast("string").alias("kind"), x.alias("new")))
    ssn = ~F.substring(digits, 1, 3).isin("000", "666") & (F.substring(digits, 1, 1) != "9") & (F.substring(digits, 4, 2) != "00") & (F.substring(digits, 6, 4) != "0000")
    return case(
        (whole(EMAIL), "email", _email(x, key, undo)),
        (whole(IBAN) & (_mod97(flat) == 1), "iban", put_back(x, _iban(flat, key, undo), "[A-Z0-9]")),
        (whole(IPV4) & octets, "ipv4", _ipv4(x, key, undo)),
        (whole(IPV6), "ipv6", _ipv6(x, key, undo)),
        (whole(DATE) & parse_date(x).isNotNull(), "date", _date(x, key, undo)),
        (whole(SSN) & ssn, "ssn", put_back(x, _ssn(digits, key, undo))),
        (whole(PHONE), "phone", put_back(x, _phone(digits, key, undo))),
        (whole(ABROAD), "abroad", put_back(x, F.concat(F.substring(digits, 1, 3), permute_digits(F.substr(digits, F.lit(4)), key, "abroad", undo)))),
        (whole(CARD) & (luhn_sum(digits) % 10 == 0), "card", put_back(x, _card(digits, key, undo))),
    )


def pseudonymise(docs: DataFrame, *, key: str, text_col: str = "text", undo: bool = False) -> DataFrame:
    """``row``: the documents with replaced texts; ``found``: the kinds of what was replaced, in order."""
    t = F.col(text_col)
    none = F.struct(t.alias("text"), F.array().cast("array<string>").alias("found"))

    def replaced(matches: Column) -> Column:
        def put(new: Column) -> Column:
            pieces = F.zip_with(F.split(t, ANY, -1), new, lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b.new, F.lit(""))))
            kinds = F.zip_with(matches, new, lambda a, b: F.when(a != b.new, b.kind))
            return F.struct(F.array_join(pieces, "").alias("text"), F.filter(kinds, lambda k: k.isNotNull()).alias("found"))

        return F.when(F.size(matches) > 0, let(F.transform(matches, lambda x: pseudonym(x, key, undo)), put)).otherwise(none)

    # texts without a digit or @ have nothing to find; the others go through the pattern once to find and once to cut
    done = F.when(t.rlike("[0-9@]"), let(F.regexp_extract_all(t, F.lit(ANY), 0), replaced)).otherwise(none)
    others = [c for c in docs.columns if c != text_col]
    d = docs.select(F.struct(*docs.columns).alias("row"), done.alias("done"))
    kept = [F.col("done.text").alias(c) if c not in others else F.col(f"row.`{c}`") for c in docs.columns]
    return d.select(F.struct(*kept).alias("row"), F.col("done.found").alias("found"))


def op10_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with pseudonyms, under a key for this query alone."""
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key="the key of the registered query")
    return out.select("row.doc_id", "row.text", F.size("found").alias("n_replaced"), F.array_join("found", ",").alias("kinds"))
