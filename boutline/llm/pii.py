"""Format-preserving pseudonyms for personal data, by a keyed Feistel network in DataFrame functions alone.

Found and validated: e-mail addresses, North American phone numbers, payment card numbers (Luhn), IPv4
addresses, social security numbers and dates. Each is permuted among the valid values of its own
format under the key, so equal values get equal pseudonyms in every document and different values
different ones. What fails validation stays as it is. Separators, issuer digit and mail domain stay. Of a run of digit groups
the leftmost longest valid card numbers are taken, so other digits beside one do not hide it. Out of scope: numbers without
separators that are no cards, other countries' numbers, dates before 1700 or after 2099, and names.

Edge cases: a null text stays null; an empty text stays empty; repeated rows are each rewritten; an empty
table gives an empty result; all other columns are passed through as they are, whatever their names.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from boutline.llm.common import unused

ROUNDS = 8
#: The setting that names the secret of a deployment.
KEY = "spark.boutline.pii.key"
_SECRETS: dict[str, str] = {}
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+"
IPV4 = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"
ISO_DATE = r"(?<!\d)\d{4}-\d{2}-\d{2}(?!\d)"
DAY_DATE = r"(?<!\d)\d{2}([/.])\d{2}\1\d{4}(?!\d)"
PHONE = r"(?<![\w(.\-])(?:\+1[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[.\-])\d{3}[.\-]\d{4}(?!\d)"
SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
ANY = "|".join([EMAIL, IPV4, ISO_DATE, DAY_DATE.replace(r"([/.])", "[/.]").replace(r"\1", "[/.]"), PHONE, SSN])
#: Where card numbers may stand among what is left: digits with blanks and hyphens. Groups of digits are divided by one of them.
NUMBERS, GROUP, CARD_DIGITS = r"(?<!\d)\d[\d \-]{11,}\d", r"\d+[ \-]*", (13, 19)
#: The Gregorian calendar repeats after 146097 = 189 * 773 days; these begin on this day.
FIRST_DAY, DAYS = "1700-01-01", (189, 773)
_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_DIGITS26 = "0123456789abcdefghijklmnop"


def session_key(spark: SparkSession) -> str:
    """The secret that ``KEY`` names; where it is unset one made at random, the same for all of an application, that nobody is told."""
    return spark.conf.get(KEY, None) or _SECRETS.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def feistel(x: Column, a: Column | int, b: Column | int, key: str, tweak: Column) -> Column:
    """A keyed permutation of the whole numbers below ``a * b``.

    ``x`` is split into halves below ``a`` and ``b``; each round adds a keyed digest of one half to the
    other, modulo its size, which the same digest can take back.
    """
    a, b = (F.lit(v).cast("long") if isinstance(v, int) else v.cast("long") for v in (a, b))

    def noise(i: Column, half: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, i.cast("string"), half.cast("string")), 256)
        return F.conv(F.substring(digest, 1, 14), 16, 10).cast("long")

    start = F.struct(F.floor(x.cast("decimal(38,0)") / b.cast("decimal(20,0)")).cast("long").alias("l"), F.pmod(x, b).alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.when(i % 2 == 1, F.pmod(s["l"] + noise(i, s["r"]), a)).otherwise(s["l"])
        right = F.when(i % 2 == 0, F.pmod(s["r"] + noise(i, s["l"]), b)).otherwise(s["r"])
        return F.struct(left.alias("l"), right.alias("r"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * b + s["r"])


def _moved(x: Column, base: int, key: str, tweak: Column) -> Column:
    """A keyed permutation of the whole numbers below ``base`` that leaves none in its place, for what is too short to halve."""
    step = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), tweak), 256), 1, 14), 16, 10).cast("long") % (base - 1) + 1
    return (x + step) % base


def _power(base: int, n: Column) -> Column:
    """``base`` to the power ``n``, whole, for results that fit a long."""
    top = 18 if base == 10 else 13
    return F.get(F.array(*[F.lit(base**k).cast("long") for k in range(top + 1)]), n)


def _permuted_digits(digits: Column, key: str, tweak: Column) -> Column:
    """A string of up to 18 digits permuted among those of its length."""
    n = F.length(digits)
    low = F.floor(n / 2).cast("int")
    tweak = F.concat_ws("|", tweak, n.cast("string"))
    out = F.when(n == 1, _moved(digits.cast("long"), 10, key, tweak)).otherwise(feistel(digits.cast("long"), _power(10, n - low), _power(10, low), key, tweak))
    return F.when(n > 0, F.lpad(out.cast("string"), n, "0")).otherwise(digits)


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in turn by ``digits``."""
    start = F.struct(F.lit("").alias("done"), digits.alias("rest"))

    def step(s: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(
            F.concat(s["done"], F.when(digit, F.substring(s["rest"], 1, 1)).otherwise(c)).alias("done"),
            F.when(digit, F.substring(s["rest"], F.lit(2), F.length(s["rest"]))).otherwise(s["rest"]).alias("rest"),
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["done"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def card(value: Column, key: str) -> Column:
    """A Luhn-valid card number: the issuer digit stays, the check digit is made anew."""

    def of(d: Column) -> Column:
        body = F.concat(F.substring(d, 1, 1), _permuted_digits(F.substring(d, F.lit(2), F.length(d) - 2), key, F.lit("card")))
        whole = _let(body, lambda p: F.get(F.filter(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda c: F.concat(p, c.cast("string"))), luhn), F.lit(0)))
        return F.when(luhn(d), _refilled(value, whole)).otherwise(value)

    return _let(_digits(value), of)


def cards(value: Column, key: str) -> Column:
    """The card numbers in a run of groups of digits, from the left, each as long as can be; all other groups stay."""

    def of(groups: Column) -> Column:
        text = lambda at, size: F.array_join(F.slice(groups, at + 1, size), "")

        def longest(at: Column) -> Column:
            def good(size: Column) -> Column:
                return _let(text(at, size), lambda t: _let(_digits(t), lambda d: F.length(d).between(*CARD_DIGITS) & luhn(d) & ~t.rlike(r"[ \-]{2,}\d")))

            return F.coalesce(F.array_max(F.filter(F.sequence(F.lit(1), F.least(F.lit(CARD_DIGITS[1]), F.size(groups) - at)), good)), F.lit(0))

        def step(s: Column, at: Column) -> Column:
            size = F.when(at >= s["free"], longest(at)).otherwise(0)
            more = lambda n: F.struct((at + n).alias("free"), F.concat(s["chosen"], F.array(F.struct(at.alias("at"), n.alias("size")))).alias("chosen"))
            return _let(size, lambda n: F.when(n > 0, more(n)).otherwise(s))

        none = F.array().cast("array<struct<at:int,size:int>>")
        chosen = F.aggregate(F.sequence(F.lit(0), F.size(groups) - 1), F.struct(F.lit(0).alias("free"), none.alias("chosen")), step, lambda s: s["chosen"])

        def put(c: Column) -> Column:
            def told(group: Column, at: Column) -> Column:
                own = F.get(F.filter(c, lambda x: (x["at"] <= at) & (at < x["at"] + x["size"])), F.lit(0))
                return F.when(own.isNull(), group).when(own["at"] == at, card(text(at, own["size"]), key)).otherwise("")

            return F.when(F.size(c) == 0, value).otherwise(F.array_join(F.transform(groups, told), ""))

        return _let(chosen, put)

    return _let(F.regexp_extract_all(value, F.lit(GROUP), F.lit(0)), of)


def phone(value: Column, key: str) -> Column:
    """A phone number: area and exchange stay in the range that numbers have.

    Numbers with an area below 200, or with an exchange below 200, are not in use but are written alike;
    they are permuted among themselves, so that no two numbers meet.
    """

    def of(d: Column) -> Column:
        area, exchange, line = (F.substring(d, i, n).cast("long") for i, n in ((1, 3), (4, 3), (7, 4)))
        kind = F.when(area < 200, "odd area").when(exchange < 200, "odd exchange").otherwise("phone")
        areas, first_area = F.when(area < 200, 200).otherwise(800), F.when(area < 200, 0).otherwise(200)
        exchanges = F.when(area < 200, 1000).when(exchange < 200, 200).otherwise(800)
        first_exchange = F.when((area < 200) | (exchange < 200), 0).otherwise(200)
        x = ((area - first_area) * exchanges + exchange - first_exchange) * 10000 + line
        y = feistel(x, areas, exchanges * 10000, key, kind)

        def digits(v: Column) -> Column:
            rest = F.floor(v / 10000).cast("long")
            whole = ((F.floor(rest / exchanges).cast("long") + first_area) * 1000 + rest % exchanges + first_exchange) * 10000 + v % 10000
            return F.lpad(whole.cast("string"), 10, "0")

        country = F.when(F.length(_digits(value)) == 11, F.lit("1")).otherwise(F.lit(""))
        return _refilled(value, F.concat(country, _let(y, digits)))

    return _let(F.substring(_digits(value), -10, 10), of)


def ipv4(value: Column, key: str) -> Column:
    """An address of four octets below 256."""
    octets = F.transform(F.split(value, r"\."), lambda o: o.cast("long"))

    def of(o: Column) -> Column:
        x = ((F.get(o, 0) * 256 + F.get(o, 1)) * 256 + F.get(o, 2)) * 256 + F.get(o, 3)
        y = feistel(x, 65536, 65536, key, F.lit("ipv4"))
        text = _let(y, lambda v: F.concat_ws(".", *[(F.shiftright(v, s) % 256).cast("string") for s in (24, 16, 8, 0)]))
        return F.when(F.array_max(o) < 256, text).otherwise(value)

    return _let(octets, of)


def ssn(value: Column, key: str) -> Column:
    """A social security number: no area of 000, 666 or from 900, no group of 00, no serial of 0000."""
    area, group, serial = (F.split_part(value, F.lit("-"), F.lit(i)).cast("long") for i in (1, 2, 3))
    valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    x = ((area - 1 - (area > 666).cast("long")) * 99 + group - 1) * 9999 + serial - 1
    y = feistel(x, 898 * 99, 9999, key, F.lit("ssn"))

    def text(v: Column) -> Column:
        a = F.floor(v / (99 * 9999)).cast("long") + 1
        g = F.floor(v / 9999).cast("long") % 99 + 1
        return F.format_string("%03d-%02d-%04d", a + (a >= 666).cast("long"), g, v % 9999 + 1)

    return F.when(valid, _let(y, text)).otherwise(value)


def date(value: Column, key: str) -> Column:
    """A date of 1700 to 2099 in the same notation; one day has one pseudonym in every notation."""
    mark = F.substring(value, 3, 1)
    iso = value.rlike(ISO_DATE)
    day, month = F.substring(value, 1, 2), F.substring(value, 4, 2)
    year = F.substring(value, -4, 4)
    parsed = F.array(
        F.when(iso, F.try_to_timestamp(value, F.lit("yyyy-MM-dd"))),
        F.when(~iso, F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd"))),
        F.when(~iso, F.try_to_timestamp(F.concat_ws("-", year, day, month), F.lit("yyyy-MM-dd"))),
    )
    first = F.lit(FIRST_DAY).cast("date")

    def of(p: Column) -> Column:
        there = F.coalesce(F.get(p, 0), F.get(p, 1), F.get(p, 2)).cast("date")
        x = F.datediff(there, first).cast("long")
        other = F.date_add(first, feistel(x, *DAYS, key, F.lit("date")).cast("int"))
        text = _let(
            other,
            lambda o: F.when(iso, F.date_format(o, "yyyy-MM-dd"))
            .when(F.get(p, 1).isNotNull(), F.concat(F.date_format(o, "dd"), mark, F.date_format(o, "MM"), mark, F.date_format(o, "yyyy")))
            .otherwise(F.concat(F.date_format(o, "MM"), mark, F.date_format(o, "dd"), mark, F.date_format(o, "yyyy"))),
        )
        return F.when(x.between(0, DAYS[0] * DAYS[1] - 1), text).otherwise(value)

    return _let(parsed, of)


def email(value: Column, key: str) -> Column:
    """An address: letters of the local part become letters, digits digits; the domain stays."""
    at = F.instr(value, "@")
    local, domain = F.substring(value, F.lit(1), at - 1), F.lower(F.substring(value, at + 1, F.length(value)))

    def letters(run: Column, tweak: Column) -> Column:
        n = F.length(run)
        low = F.floor(n / 2).cast("int")
        x = F.conv(F.translate(run, _LETTERS, _DIGITS26), 26, 10).cast("long")
        tweak = F.concat_ws("|", tweak, n.cast("string"))
        y = F.when(n == 1, _moved(x, 26, key, tweak)).otherwise(feistel(x, _power(26, n - low), _power(26, low), key, tweak))
        digits = F.lpad(F.lower(F.conv(y.cast("string"), 10, 26)), n, "0")
        return F.translate(digits, _DIGITS26, _LETTERS)

    def other(run: Column, i: Column) -> Column:
        """Runs of up to 12 letters or digits; the place of a run and the domain tweak it."""
        tweak = F.concat_ws("|", F.lit("mail"), domain, i.cast("string"))
        return F.when(run.rlike("^[a-z]+$"), letters(run, tweak)).when(run.rlike("^[0-9]+$"), _permuted_digits(run, key, tweak)).otherwise(run)

    runs = F.regexp_extract_all(F.lower(local), F.lit("[a-z]{1,12}|[0-9]{1,12}|[^a-z0-9]+"), F.lit(0))
    return F.concat(F.array_join(F.transform(runs, other), ""), F.substring(value, at, F.length(value)))


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value."""
    whole = lambda pattern: value.rlike(f"^(?:{pattern})$")
    return (
        F.when(F.contains(value, F.lit("@")), email(value, key)).when(whole(IPV4), ipv4(value, key))
        .when(whole(ISO_DATE) | whole(DAY_DATE), date(value, key)).when(whole(PHONE), phone(value, key))
        .when(whole(SSN), ssn(value, key)).otherwise(value)
    )


def pseudonymize(docs: DataFrame, key: str, counted: str | None = "n_replaced") -> DataFrame:
    """``docs`` with ``text`` rewritten and, unless ``counted`` is None, a last column with the number of changed values.

    That column is ``counted``, or with underscores after it where the input has such a column.
    """
    (values,) = unused(docs.columns, "values")
    text = F.col("text").cast("string")

    def replaced(whole: Column, pattern: str, told: Callable[[Column], Column]) -> Column:
        """What is between the matches, and old and new of each."""
        pairs = F.transform(F.regexp_extract_all(whole, F.lit(pattern), F.lit(0)), lambda v: F.struct(v.alias("old"), told(v).alias("new")))
        return F.struct(F.split(whole, pattern, -1).alias("rest"), pairs.alias("pairs"))

    def merged(part: Column) -> Column:
        return F.array_join(F.zip_with(part["rest"], part["pairs"], lambda p, v: F.concat(p, F.coalesce(v["new"], F.lit("")))), "")

    def changes(pairs: Column) -> Column:
        return F.size(F.filter(pairs, lambda v: v["old"] != v["new"]))

    def outer(found: Column) -> Column:
        inner = F.transform(found["rest"], lambda piece: _let(replaced(piece, NUMBERS, lambda v: cards(v, key)), lambda part: F.struct(merged(part).alias("text"), changes(part["pairs"]).alias("n"))))

        def whole(pieces: Column) -> Column:
            text = F.array_join(F.zip_with(pieces["text"], found["pairs"], lambda p, v: F.concat(p, F.coalesce(v["new"], F.lit("")))), "")
            return F.struct(text.alias("text"), (F.aggregate(pieces["n"], F.lit(0), lambda a, n: a + n) + changes(found["pairs"])).alias("n"))

        return _let(inner, whole)

    put = F.when(text.rlike("[0-9@]"), _let(replaced(text, ANY, lambda v: pseudonym(v, key)), outer))
    staged = docs.withColumn(values, put)
    some, joined, changed = F.col(values).isNotNull(), F.col(f"{values}.text"), F.col(f"{values}.n")
    columns = [F.when(some, joined).otherwise(text).alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counted is not None:
        columns.append(F.when(some, changed).otherwise(0).cast("long").alias(*unused(docs.columns, counted)))
    return staged.select(*columns)
