"""Format-preserving pseudonyms for personal data (native expressions only).

E-mail addresses, IPv4 and IPv6 addresses, phone numbers (ten digits in the North
American grouping, or with a country code: 8 to 15 digits), card numbers (Luhn), bank
accounts (IBAN, modulo 97), social security numbers and calendar dates are found in the whole text, validated, and
replaced by a keyed permutation of their own format: a Feistel network over the
two halves of the value. The permutation depends on the key and the kind only,
so equal values stay equal in all documents, different ones stay different, and
the pseudonym is itself valid (a card passes Luhn, a date exists). Of an e-mail
address the part before the @ is permuted and the domain stays, of a phone number the
country code and of an account the country; a date moves within its 400 years. An IPv6
address is permuted in its two halves of 64 bits and spelled in full groups, so all
spellings of one address stay one; those of fewer than three groups are left.

A key given as a string is a literal of the plan, which ``explain`` and event logs show.
``secret`` reads it from a file instead: plans then name the file and not the key.

The text is split at the matches, the matches are mapped by higher-order
functions, and both are put together again; nothing leaves the row. Candidates
that fail validation (16 digits that fail Luhn, octets over 255, 30 February)
stay as they are.

Defined results: a null text stays null with counts 0; empty texts and texts
without matches are unchanged; repeated rows give equal rows; an empty table
gives an empty table; other columns pass through untouched, but for one named as a
count where counts are asked for, which the count replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stafflens.llm.common import let

ROUNDS = 10
KINDS = ("email", "ip", "phone", "ssn", "date", "card", "iban", "ip6")

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?:{_OCTET}\.){{3}}{_OCTET}"
_SSN = r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}"
_ISO, _US = r"\d{4}-\d{2}-\d{2}", r"\d{2}/\d{2}/\d{4}"
_PHONE = r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"
#: A country code and groups of digits, or both in one.
_ABROAD = r"\+\d{1,3}(?:[ .-]\(?\d{1,4}\)?){2,6}|\+[1-9]\d{7,14}"
_IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
_HEX = r"[0-9A-Fa-f]{1,4}"
_IP6 = rf"(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}(?::{_HEX}){{0,5}})?::(?:{_HEX}(?::{_HEX}){{0,5}})?"
#: One pass finds all kinds; the guards keep a match from starting or ending inside a longer number.
PATTERN = "|".join((
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    rf"(?<![\d.]){_IP}(?!\.?\d)",
    rf"(?<![\d+]){_PHONE}(?!\d)",
    rf"(?<![\w+])(?:{_ABROAD})(?!\d)",
    rf"(?<![A-Za-z0-9]){_IBAN}(?![A-Za-z0-9])",
    rf"(?<![\w:.])(?:{_IP6})(?![\w:])",
    rf"(?<![\d-]){_SSN}(?![\d-])",
    rf"(?<![\d/-])(?:{_ISO}|{_US})(?![\d/-])",
    r"(?<![\d-])(?:\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|3[47]\d{2}[ -]\d{6}[ -]\d{5}|\d{13,19})(?![\d-])",
))
#: 1600-01-01 as days since 1970, and the days after which the calendar repeats.
_EPOCH, _CYCLE = -135140, 146097


def _long(x) -> Column:
    return (F.lit(x) if isinstance(x, int) else x).cast("long")


def secret(spark: SparkSession, path: str) -> Column:
    """The text of the file at ``path`` without outer blanks, as a key: a subquery whose value no plan shows."""
    return spark.read.text(path, wholetext=True).select(F.trim(F.regexp_replace("value", r"\s+$", ""))).scalar()


def feistel(left: Column, right: Column, a: Column, b: Column, key: Column, kind: str) -> Column:
    """Struct (l, r): a keyed permutation of the pairs with 0 <= l < a, 0 <= r < b."""

    def f(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws(":", key, F.lit(kind), i.cast("string"), half.cast("string"), a.cast("string"), b.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("long")

    def step(x: Column, i: Column) -> Column:
        even = i % 2 == 0
        return F.struct(
            F.when(even, (x["l"] + f(i, x["r"])) % a).otherwise(x["l"]).alias("l"),
            F.when(even, x["r"]).otherwise((x["r"] + f(i, x["l"])) % b).alias("r"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(_long(left).alias("l"), _long(right).alias("r")), step)


def _value(c: Column) -> Column:
    return F.when(c.between("0", "9"), F.instr(F.lit("0123456789"), c) - 1).otherwise(F.instr(F.lit("abcdefghijklmnopqrstuvwxyz"), c) - 1)


def _radix(c: Column) -> Column:
    return F.when(c.between("0", "9"), F.lit(10)).otherwise(F.lit(26))


def _chars(s: Column) -> Column:
    return F.array_remove(F.split(s, ""), "")


def _number(s: Column) -> Column:
    return F.aggregate(_chars(s), _long(0), lambda n, c: n * _radix(c) + _value(c))


def _range(s: Column) -> Column:
    return F.aggregate(_chars(s), _long(1), lambda n, c: n * _radix(c))


def _spelled(n: Column, shape: Column) -> Column:
    """The number ``n`` in the mixed radix of the characters of ``shape``."""

    def step(x: Column, c: Column) -> Column:
        radix = _radix(c)
        digit = (x["n"] % radix).cast("int") + 1
        alphabet = F.when(radix == 10, F.lit("0123456789")).otherwise(F.lit("abcdefghijklmnopqrstuvwxyz"))
        return F.struct(((x["n"] - x["n"] % radix) / radix).cast("long").alias("n"), F.concat(F.substr(alphabet, digit, F.lit(1)), x["s"]).alias("s"))

    return F.aggregate(F.reverse(_chars(shape)), F.struct(_long(n).alias("n"), F.lit("").alias("s")), step)["s"]


def permuted(s: Column, key: Column, kind: str) -> Column:
    """Permute lower-case letters and digits of ``s`` among strings of the same shape.

    The two halves of up to 10 characters each are numbers in mixed radix;
    longer strings are permuted in pieces of 20.
    """

    def halves(p: Column) -> Column:
        half = F.floor(F.length(p) / 2).cast("int")
        return F.struct(F.substr(p, F.lit(1), half).alias("left"), F.substr(p, half + 1).alias("right"))

    def sized(h: Column) -> Column:
        return F.struct(h["left"].alias("left"), h["right"].alias("right"), _range(h["left"]).alias("a"), _range(h["right"]).alias("b"))

    def moved(h: Column) -> Column:
        done = feistel(_number(h["left"]), _number(h["right"]), h["a"], h["b"], key, kind)
        return let(done, lambda x: F.concat(_spelled(x["l"], h["left"]), _spelled(x["r"], h["right"])))

    def pieces(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.length(whole), F.lit(1)), F.lit(20))
        return F.array_join(F.transform(starts, lambda i: let(let(let(F.substr(whole, i, F.lit(20)), halves), sized), moved)), "")

    return let(s, pieces)


def _refill(m: Column, chars: Column) -> Column:
    """``m`` with its letters and digits replaced, in order, by ``chars``."""

    def step(x: Column, c: Column) -> Column:
        own = c.rlike("[A-Za-z0-9]")
        return F.struct(F.concat(x["s"], F.when(own, F.substr(chars, x["p"], F.lit(1))).otherwise(c)).alias("s"), F.when(own, x["p"] + 1).otherwise(x["p"]).alias("p"))

    return F.aggregate(_chars(m), F.struct(F.lit("").alias("s"), F.lit(1).alias("p")), step)["s"]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _luhn(digits: Column, doubled_first: bool) -> Column:
    """Luhn sum of the digits from the right; the rightmost is doubled if ``doubled_first``."""
    parity = 0 if doubled_first else 1

    def step(x: Column, c: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.struct((x["t"] + F.when(x["i"] % 2 == parity, twice).otherwise(d)).alias("t"), (x["i"] + 1).alias("i"))

    return F.aggregate(F.reverse(_chars(digits)), F.struct(F.lit(0).alias("t"), F.lit(0).alias("i")), step)["t"]


def _date(m: Column) -> Column:
    iso = F.try_to_timestamp(m, F.lit("yyyy-MM-dd")).cast("date")
    return F.when(m.rlike(f"^{_ISO}$"), iso).otherwise(F.try_to_timestamp(m, F.lit("MM/dd/yyyy")).cast("date"))


def kind_of(m: Column) -> Column:
    """The kind of a match, null where validation fails."""
    return (
        F.when(F.contains(m, F.lit("@")), F.lit("email"))
        .when(m.rlike(f"^{_IP}$"), F.lit("ip"))
        .when(m.rlike(f"^{_SSN}$"), F.lit("ssn"))
        .when(m.rlike(f"^(?:{_ISO}|{_US})$"), F.when(_date(m).isNotNull(), F.lit("date")))
        .when(m.rlike(f"^{_PHONE}$"), F.lit("phone"))
        .when(m.rlike(r"^\+"), F.when(F.length(_digits(m)).between(8, 15), F.lit("phone")))
        .when(m.rlike(f"^{_IBAN}$"), F.when(_mod97(F.concat(F.substr(_compact(m), F.lit(5)), F.substr(_compact(m), F.lit(1), F.lit(4)))) == 1, F.lit("iban")))
        .when(F.contains(m, F.lit(":")), F.when((F.size(F.filter(F.split(m, ":"), lambda g: g != "")) >= 3) & m.rlike("[0-9]"), F.lit("ip6")))
        .when(_luhn(_digits(m), False) % 10 == 0, F.lit("card"))
    )


def _email(m: Column, key: Column) -> Column:
    local = F.substring_index(m, "@", 1)
    plain = F.lower(F.regexp_replace(local, "[^A-Za-z0-9]", ""))
    return let(permuted(plain, key, "email"), lambda p: F.concat(_refill(local, p), F.lit("@"), F.substring_index(m, "@", -1)))


def _ip(m: Column, key: Column) -> Column:
    def moved(o: Column) -> Column:
        return feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], _long(65536), _long(65536), key, "ip")

    def dotted(x: Column) -> Column:
        octet = lambda half, shift: F.shiftright(x[half], shift).bitwiseAND(F.lit(255).cast("long")).cast("string")
        return F.concat_ws(".", octet("l", 8), octet("l", 0), octet("r", 8), octet("r", 0))

    return let(let(F.transform(F.split(m, r"\."), lambda x: x.cast("long")), moved), dotted)


def _phone(m: Column, key: Column) -> Column:
    """The national digits are permuted; a country code stays (of a number in one group, its first two digits)."""

    def filled(d: Column) -> Column:
        code = F.when(m.rlike(f"^{_PHONE}$"), F.length(d) - 10).when(m.rlike(r"^\+\d+$"), F.lit(2)).otherwise(F.length(F.regexp_extract(m, r"^\+(\d+)", 1)))
        return let(code, lambda c: let(permuted(F.substr(d, c + 1), key, "phone"), lambda n: _refill(m, F.concat(F.substr(d, F.lit(1), c), n))))

    return let(_digits(m), filled)


def _compact(m: Column) -> Column:
    return F.replace(m, F.lit(" "), F.lit(""))


def _mod97(s: Column) -> Column:
    """Remainder of the number that digits and capitals (A is 10) spell."""

    def step(n: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), n * 10 + _value(c)).otherwise(n * 100 + 10 + _value(F.lower(c))) % 97

    return F.aggregate(_chars(s), _long(0), lambda n, c: step(n, c).cast("long"))


def _iban(m: Column, key: Column) -> Column:
    """The account is permuted, the country stays, the check digits follow."""

    def checked(p: Column, country: Column) -> Column:
        check = 98 - _mod97(F.concat(p, country, F.lit("00")))
        return _refill(m, F.concat(country, F.lpad(check.cast("string"), 2, "0"), p))

    def moved(c: Column) -> Column:
        return let(F.upper(permuted(F.lower(F.substr(c, F.lit(5))), key, "iban")), lambda p: checked(p, F.substr(c, F.lit(1), F.lit(2))))

    return let(_compact(m), moved)


def _ip6(m: Column, key: Column) -> Column:
    def groups(part: Column) -> Column:
        return F.transform(F.array_remove(F.split(part, ":"), ""), lambda g: F.conv(g, 16, 10).cast("long"))

    def whole(ends: Column) -> Column:
        zeros = F.array_repeat(_long(0), 8 - F.size(ends["l"]) - F.size(ends["r"]))
        return F.concat(ends["l"], zeros, ends["r"])

    def half(g: Column, at: int) -> Column:
        size = _long(1 << 32)
        return feistel(g[at] * 65536 + g[at + 1], g[at + 2] * 65536 + g[at + 3], size, size, key, "ip6" if at else "ip6-net")

    def spelled(x: Column) -> Column:
        pairs = [x[side][part] for side in ("net", "host") for part in ("l", "r")]
        four = lambda n: F.lower(F.hex(n))
        return F.concat_ws(":", *(four(y) for p in pairs for y in (F.shiftright(p, 16), p.bitwiseAND(F.lit(65535).cast("long")))))

    ends = F.struct(groups(F.substring_index(m, "::", 1)).alias("l"), groups(F.when(F.contains(m, F.lit("::")), F.substring_index(m, "::", -1)).otherwise(F.lit(""))).alias("r"))
    return let(let(let(ends, whole), lambda g: F.struct(half(g, 0).alias("net"), half(g, 4).alias("host"))), spelled)


def _ssn(m: Column, key: Column) -> Column:
    # Areas 001 to 899 without 666 (898 values), groups 01 to 99, serials 0001 to 9999.
    def moved(p: Column) -> Column:
        area = p[0] - F.when(p[0] > 666, 2).otherwise(1)
        return feistel(area * 99 + p[1] - 1, p[2] - 1, _long(898 * 99), _long(9999), key, "ssn")

    def spell(x: Column) -> Column:
        a = ((x["l"] - x["l"] % 99) / 99).cast("long")
        a = a + F.when(a >= 665, 2).otherwise(1)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((x["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((x["r"] + 1).cast("string"), 4, "0"))

    return let(let(F.transform(F.split(m, "-"), lambda x: x.cast("long")), moved), spell)


def _day(m: Column, key: Column) -> Column:
    """Permute the days within their 400 years, after which the calendar repeats (27 * 5411 days)."""

    def moved(since: Column) -> Column:
        n = F.pmod(since, F.lit(_CYCLE))
        out = feistel((n - n % 5411) / 5411, n % 5411, _long(27), _long(5411), key, "date")
        return let(out, lambda x: F.date_from_unix_date((since - n + x["l"] * 5411 + x["r"] + _EPOCH).cast("int")))

    day = let(_long(F.unix_date(_date(m))) - _EPOCH, moved)
    return let(day, lambda d: F.when(m.rlike(f"^{_ISO}$"), F.date_format(d, "yyyy-MM-dd")).otherwise(F.date_format(d, "MM/dd/yyyy")))


def _card(m: Column, key: Column) -> Column:
    """All digits but the last are permuted; the last is the check digit."""

    def checked(p: Column) -> Column:
        return _refill(m, F.concat(p, ((10 - _luhn(p, True) % 10) % 10).cast("string")))

    payload = let(_digits(m), lambda d: F.substr(d, F.lit(1), F.length(d) - 1))
    return let(permuted(payload, key, "card"), checked)


_MAKE = {"email": _email, "ip": _ip, "phone": _phone, "ssn": _ssn, "date": _day, "card": _card, "iban": _iban, "ip6": _ip6}


def _is(kind: str):
    return lambda k: k == kind


def pseudonymise(df: DataFrame, key: str | Column, text: str = "text", counts: bool = False) -> DataFrame:
    """``df`` with ``text`` pseudonymised; ``counts`` adds n_<kind> (long) for each kind."""
    t = F.col(text)
    rows = df.select(F.struct(*df.columns).alias("__doc"), t.alias("__t"))
    if isinstance(key, str):
        key = F.lit(key)
    else:
        rows, key = rows.withColumn("__key", key), F.col("__key")
    # Most texts have neither a digit nor an @: the long pattern is tried on the others only.
    some = F.coalesce(F.col("__t").rlike("[0-9@]"), F.lit(False))
    none = F.array().cast("array<string>")
    rows = rows.withColumn("__m", F.when(some, F.regexp_extract_all("__t", F.lit(PATTERN), 0)).otherwise(none))
    rows = rows.withColumn("__m", F.transform("__m", lambda m: F.struct(m.alias("m"), kind_of(m).alias("k"))))

    def pseudonym(x: Column) -> Column:
        out = F.when(x["k"].isNull(), x["m"])
        for kind, make in _MAKE.items():
            out = out.when(x["k"] == kind, make(x["m"], key))
        return out

    pieces = F.split("__t", PATTERN, -1)
    parts = F.zip_with(pieces, F.transform("__m", pseudonym), lambda p, m: F.concat(p, F.coalesce(m, F.lit(""))))
    new = F.when(F.size("__m") > 0, F.array_join(parts, "")).otherwise(F.col("__t"))
    added = {f"n_{k}" for k in KINDS} if counts else set()
    out = [new.alias(c) if c == text else F.col("__doc").getField(c).alias(c) for c in df.columns if c not in added]
    if counts:
        out += [F.size(F.filter(F.transform("__m", lambda x: x["k"]), _is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(*out)
