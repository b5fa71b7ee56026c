"""Format-preserving pseudonyms for personal data, made of built-in functions only.

Validated numbers (payment cards by their check digit, social security numbers, phone numbers, IPv4 addresses), dates
and the local parts of mail addresses are permuted within their format by a keyed Feistel network, so an equal value
has the same pseudonym in every document and the pseudonym is valid in the same way. Rounds are SHA-256 of key, kind,
round and the other half, added modulo the size of a half; who holds the key can undo them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: What may be personal data, tried in this order at each place; every part has a bounded length.
MAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}"
IPV4 = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
DATE = r"(?<![\d./-])(?:\d{4}([-/])\d{2}\1\d{2}|\d{1,2}([./])\d{1,2}\2\d{4})(?![\d/-]|\.\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PHONE = r"(?<![\w+])(?:\+1[ .-]?|1[ .-])?(?:\([2-9]\d{2}\) ?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]?\d{4}(?!\d)"
PHONE_ANY = r"(?<![\w+])\+[1-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)"
CARD = r"(?<![\d-])(?:\d{4}([ -])\d{4}\3\d{4}\3\d{4}|\d{4}([ -])\d{6}\4\d{5}|\d{13,19})(?![\d-])"
ANY = "|".join((MAIL, IPV4, DATE, SSN, PHONE, PHONE_ANY, CARD))
#: Months from 1800 to 2199, and the days in them after the twelfth, as a product of two sizes.
_EPOCH, _MONTHS, _LATE = "1800-01-01", 4800, (9, 9833)


def _pad(i: Column, secret: str, kind: str, half: Column) -> Column:
    """Round function: SHA-256 in hex."""
    return F.sha2(F.concat_ws("|", F.lit(secret), F.lit(kind), i.cast("string"), half.cast("string")).cast("binary"), 256)


def permute(a: Column, b: Column, size_a: Column, size_b: Column, secret: str, kind: str) -> Column:
    """Struct (a, b): the pair permuted among 0 <= a < size_a, 0 <= b < size_b (sizes below 2**31)."""

    def add(x: Column, i: Column, half: Column, size: Column) -> Column:
        return (x + F.conv(F.substring(_pad(i, secret, kind, half), 1, 14), 16, 10).cast("long")) % size

    start = F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))
    step = lambda s, i: F.when(i % 2 == 0, F.struct(add(s.a, i, s.b, size_a).alias("a"), s.b.alias("b"))).otherwise(F.struct(s.a.alias("a"), add(s.b, i, s.a, size_b).alias("b")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _with(value: Column, then) -> Column:
    """then(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10), n).cast("long")


def _permuted_digits(digits: Column, secret: str, kind: str) -> Column:
    """Another string of as many digits (2 to 18)."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    high = n - low
    pair = permute(F.substring(digits, F.lit(1), high).cast("long"), F.substring(digits, high + 1, low).cast("long"), _power(high), _power(low), secret, kind)
    text = _with(pair, lambda p: F.concat(F.lpad(p.a.cast("string"), 20, "0"), F.lpad(p.b.cast("string"), 20, "0")))
    return _with(text, lambda t: F.concat(F.substring(t, F.lit(21) - high, high), F.substring(t, F.lit(41) - low, low)))


def _refill(pattern: Column, digits: Column) -> Column:
    """pattern with its digits replaced one by one."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))
    step = lambda s, c: F.when(c.rlike(r"^\d$"), F.struct(F.concat(s.out, F.substring(digits, s.k, F.lit(1))).alias("out"), (s.k + 1).alias("k"))).otherwise(F.struct(F.concat(s.out, c).alias("out"), s.k.alias("k")))
    return F.aggregate(F.filter(F.split(pattern, ""), lambda c: c != ""), start, step, lambda s: s.out)


def _luhn(digits: Column) -> Column:
    """Weighted digit sum of the Luhn formula."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def _only_digits(m: Column) -> Column:
    return F.regexp_replace(m, r"\D", "")


def _card(m: Column, secret: str) -> Column:
    def new(d: Column) -> Column:
        n = F.length(d)
        body = F.concat(F.substring(d, 1, 1), _permuted_digits(F.substring(d, F.lit(2), n - 2), secret, "card"))
        return _with(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return _with(_only_digits(m), lambda d: F.when(_luhn(d) % 10 == 0, _refill(m, new(d))).otherwise(m))


def _ssn(m: Column, secret: str) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    fine = (area > 0) & (area < 900) & (area != 666) & (group > 0) & (serial > 0)
    pair = permute(F.when(area > 666, area - 2).otherwise(area - 1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), secret, "ssn")
    put = lambda p: F.format_string("%03d-%02d-%04d", F.when(p.a >= 665, p.a + 2).otherwise(p.a + 1), F.floor(p.b / 9999) + 1, p.b % 9999 + 1)
    return F.when(fine, _with(pair, put)).otherwise(m)


def _phone(m: Column, secret: str) -> Column:
    """A national number keeps its country code; area and exchange stay above 199."""

    def new(d: Column) -> Column:
        lead, rest = F.substring(d, F.lit(1), F.length(d) - 10), F.substring(d, -10, 10)
        pair = permute(F.substring(rest, 1, 3).cast("long") - 200, (F.substring(rest, 4, 3).cast("long") - 200) * 10000 + F.substring(rest, 7, 4).cast("long"), F.lit(800), F.lit(8_000_000), secret, "phone")
        return _with(pair, lambda p: F.concat(lead, (p.a + 200).cast("string"), (F.floor(p.b / 10000) + 200).cast("string"), F.lpad((p.b % 10000).cast("string"), 4, "0")))

    return _refill(m, _with(_only_digits(m), new))


def _phone_any(m: Column, secret: str) -> Column:
    """Another number: the country code (its first group, three digits at most) stays."""
    code = F.length(F.regexp_extract(m, r"^\+(\d{1,3})", 1))
    return _with(_only_digits(m), lambda d: F.when(F.length(d).between(8, 15), _refill(m, F.concat(F.substring(d, F.lit(1), code), _permuted_digits(F.substring(d, code + 1, F.length(d)), secret, "number")))).otherwise(m))


def _ipv4(m: Column, secret: str) -> Column:
    o = [F.substring_index(F.substring_index(m, ".", k), ".", -1).cast("long") for k in (1, 2, 3, 4)]
    put = lambda p: F.concat_ws(".", *[x.cast("string") for x in (F.shiftright(p.a, 8), p.a % 256, F.shiftright(p.b, 8), p.b % 256)])
    return _with(permute(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), secret, "ipv4"), put)


def _month(k: Column) -> Column:
    """First day of a month, counted from the epoch."""
    return F.add_months(F.lit(_EPOCH).cast("date"), k.cast("int"))


def _late_before(k: Column) -> Column:
    """Days after the twelfth in the months before month k."""
    return F.datediff(_month(k), F.lit(_EPOCH).cast("date")) - 12 * k


def _late_day(n: Column) -> Column:
    """The n-th day after the twelfth of its month."""
    near = F.floor(n * F.lit(_MONTHS) / F.lit(_LATE[0] * _LATE[1])).cast("int")  # off by two months at most
    month = F.array_max(F.filter(F.sequence(F.greatest(near - 2, F.lit(0)), F.least(near + 2, F.lit(_MONTHS - 1))), lambda k: _late_before(k) <= n))
    return _with(month, lambda k: F.date_add(_month(k), (12 + n - _late_before(k)).cast("int")))


def _date(m: Column, secret: str) -> Column:
    """ISO or day-month-year (month-day-year where only that is a date); the same day has the same pseudonym in any form.

    Days to the twelfth are permuted among each other, and so are those after it, so a date with the month first comes
    out as one that can be read in no other way.
    """
    iso = m.rlike(r"^\d{4}")
    sign = F.regexp_extract(m, r"([-/.])", 1)
    part = lambda k: F.element_at(F.split(m, r"[-/.]"), k)
    to_day = lambda y, mo, d: F.try_to_date(F.concat_ws("-", y, F.lpad(mo, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")
    day_first = to_day(part(3), part(2), part(1))
    day = F.when(iso, to_day(part(1), part(2), part(3))).otherwise(F.coalesce(day_first, to_day(part(3), part(1), part(2))))
    # a part has a leading zero if it had one, or if neither part shows that there are none
    full = lambda k: part(k).startswith("0") | (F.least(F.length(part(1)), F.length(part(2))) == 2)

    def new(day: Column) -> Column:
        month, early = (F.year(day) - 1800) * 12 + F.month(day) - 1, F.dayofmonth(day) <= 12
        late = F.datediff(day, F.lit(_EPOCH).cast("date")) - 12 * (month + 1)
        a, b = F.when(early, month).otherwise(F.floor(late / _LATE[1])), F.when(early, F.dayofmonth(day) - 1).otherwise(late % _LATE[1])
        size_a, size_b = (F.when(early, x).otherwise(y) for x, y in zip((_MONTHS, 12), _LATE, strict=True))
        put = lambda p: F.when(early, F.date_add(_month(p.a), p.b.cast("int"))).otherwise(_late_day(p.a * _LATE[1] + p.b))
        return _with(permute(a, b, size_a, size_b, secret, "date"), put)

    def written(new: Column) -> Column:
        day_part, month_part = F.dayofmonth(new), F.month(new)
        first, second = (F.when(day_first.isNotNull(), a).otherwise(b).cast("string") for a, b in ((day_part, month_part), (month_part, day_part)))
        first, second = (F.when(full(k), F.lpad(x, 2, "0")).otherwise(x) for k, x in ((1, first), (2, second)))
        return F.when(iso, F.replace(F.date_format(new, "yyyy-MM-dd"), F.lit("-"), sign)).otherwise(F.concat(first, sign, second, sign, F.year(new).cast("string")))

    return F.when(F.year(day).between(1800, 2199), _with(_with(day, new), written)).otherwise(m)


def _mail(m: Column, secret: str) -> Column:
    """Letters and digits of the local part move within their class; domain and signs stay."""

    def shift(text: Column, pad: Column) -> Column:
        def one(c: Column, j: Column) -> Column:
            k = F.conv(F.substring(pad, j * 2 % 64 + 1, F.lit(2)), 16, 10).cast("int")
            turned = lambda base, n: F.char(F.lit(base) + (F.ascii(c) - base + k) % n)
            return F.when(c.rlike("^[a-z]$"), turned(97, 26)).when(c.rlike("^[A-Z]$"), turned(65, 26)).when(c.rlike("^[0-9]$"), turned(48, 10)).otherwise(c)

        return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one), "")

    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    half = F.ceil(F.length(local) / 2).cast("int")
    start = F.struct(F.substring(local, F.lit(1), half).alias("a"), F.substring(local, half + 1, F.length(local)).alias("b"))
    step = lambda s, i: F.when(i % 2 == 0, F.struct(shift(s.a, _pad(i, secret, "mail", s.b)).alias("a"), s.b.alias("b"))).otherwise(F.struct(s.a.alias("a"), shift(s.b, _pad(i, secret, "mail", s.a)).alias("b")))
    return F.concat(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s.a, s.b)), F.lit("@"), domain)


def pseudonym(m: Column, secret: str) -> Column:
    """The pseudonym of a string that matches ANY; one that is not valid for its kind stays as it is."""
    return (
        F.when(m.contains("@"), _mail(m, secret))
        .when(m.rlike(f"^(?:{IPV4})$"), _ipv4(m, secret))
        .when(m.rlike(f"^(?:{DATE})$"), _date(m, secret))
        .when(m.rlike(f"^(?:{SSN})$"), _ssn(m, secret))
        .when(m.rlike(f"^(?:{PHONE})$"), _phone(m, secret))
        .when(m.startswith("+"), _phone_any(m, secret))
        .otherwise(_card(m, secret))
    )


def pseudonymise(docs: DataFrame, secret: str, text: str = "text") -> DataFrame:
    """All rows and columns of docs with personal data in ``text`` replaced, and n_private, the number of values replaced.

    Null and empty texts stay as they are (n_private 0); everything outside the values is unchanged. Rows are
    independent, so repeated rows and texts of any length are fine and nothing is shuffled; a column called n_private
    is replaced. The key is in the plan of the job: give it from a secret store, not from a file of the repository.
    """
    may = F.col(text).rlike(r"[0-9]|@")
    found = docs.withColumn("__tm_found", F.when(may, F.regexp_extract_all(text, F.lit(ANY), 0)))
    some = F.size("__tm_found") > 0
    found = found.withColumn("__tm_new", F.when(some, F.transform("__tm_found", lambda m: pseudonym(m, secret))))
    between = F.split(text, ANY, -1)
    joined = F.array_join(F.zip_with(between, "__tm_new", lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    count = F.size(F.filter(F.arrays_zip("__tm_found", "__tm_new"), lambda x: x["__tm_found"] != x["__tm_new"]))
    return found.withColumn(text, F.when(some, joined).otherwise(F.col(text))).withColumn("n_private", F.when(some, count).otherwise(0).cast("int")).drop("__tm_found", "__tm_new")
