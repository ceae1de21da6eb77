"""Format-preserving pseudonyms for personal numbers, dates and addresses. Native throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 6
# Days of the date domain: DAY_SIDE squared, from FIRST_DAY on.
DAY_SIDE = 362
FIRST_DAY = "1800-01-01"

# What is looked for, in order; a pattern takes no more than it has to of a
# long run and never goes back into one, so long texts cost no more than short.
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]{1,64}+@(?:[A-Za-z0-9\-]{1,63}+\.){1,8}[A-Za-z]{2,24}"
PHONE = r"(?<![\d(])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\d)"
ABROAD = r"(?<![\p{L}\d+])\+[1-9]\d{0,2}(?:[ .\-]?\(0\))?(?:[ .\-]?\d{1,8}+){2,6}(?![\d\p{L}]|[.\-]\d)"
CARD = r"(?<!\d)(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{4}[ \-]\d{6}[ \-]\d{5}|\d{13,19}+)(?!\d)"
SOCIAL = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)"
DATE = r"(?<![\d\-/])(?<!\d\.)(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\d/]|-\d|\.\d)"
SECRET = r"\bAKIA[0-9A-Z]{16}\b|(?<=token = \")[0-9A-Fa-f]{40}(?=\")|(?<=\bpassword=)[0-9A-Za-z]{6,128}+"
ANY = "|".join(f"(?:{p})" for p in (SECRET, EMAIL, PHONE, ABROAD, CARD, SOCIAL, ADDRESS, DATE))

# Runs of characters that are permuted among themselves, by first
# and size: digits and letters of ASCII; letters and digits of other blocks.
PLAIN = ((48, 10), (65, 26), (97, 26))
BLOCKS = (
    (0xC0, 23), (0xD8, 7), (0xE0, 23), (0xF8, 8), (0x100, 128), (0x180, 64), (0x391, 17), (0x3A3, 7), (0x3B1, 25),
    (0x400, 16), (0x410, 32), (0x430, 32), (0x450, 16), (0x531, 38), (0x561, 38), (0x5D0, 27), (0x620, 43),
    (0x660, 10), (0x904, 54), (0x966, 10), (0xE01, 48), (0x10D0, 43), (0x1E00, 150), (0x3041, 86), (0x30A1, 90),
    (0x4E00, 20992), (0xAC00, 11172),
)

# Possible social-security numbers: areas but 000, 666 and 900 on, groups but
# 00, serials but 0000; and the least side whose square holds them all.
AREAS, GROUPS, SERIALS = 898, 99, 9999
SOCIAL_SIDE = 29815
# Steps after which a walk gives up; less than one value in 10**20 takes more.
WALK = 64


def _digest(secret: Column, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", secret, *parts), 256)


def feistel_number(value: Column, side: int, secret: Column) -> Column:
    """A keyed permutation of 0 to ``side`` squared - 1."""

    def step(state: Column, turn: Column) -> Column:
        mark = _digest(secret, turn.cast("string"), state["r"].cast("string"))
        drawn = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long")
        mixed = F.pmod(state["l"] + drawn, F.lit(side).cast("long"))
        return F.struct(state["r"].alias("l"), mixed.alias("r"))

    start = F.struct(
        F.floor(value / side).cast("long").alias("l"), F.pmod(value, F.lit(side)).cast("long").alias("r")
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: s["l"] * side + s["r"]
    )


def walk(value: Column, side: int, secret: Column, inside: Callable[[Column], Column]) -> Column:
    """A keyed permutation of those numbers below ``side`` squared that are ``inside``.

    The number is permuted until it comes out inside: the cycle through an
    inside number leads back to one.
    """

    def step(state: Column, _: Column) -> Column:
        return F.when(inside(state), state).otherwise(feistel_number(state, side, secret))

    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), feistel_number(value, side, secret), step)


def _shift(text: Column, mark: Column, hexadecimal: bool, classes: tuple = PLAIN) -> Column:
    """Each character moved within its class by its byte of ``mark``, 64 hexadecimal digits."""

    def one(at: Column) -> Column:
        letter = text.substr(at + 1, F.lit(1))
        code = F.ascii(letter)
        drawn = F.conv(mark.substr(F.pmod(at, F.lit(32)) * 2 + 1, F.lit(2)), 16, 10).cast("int")
        moved = letter
        for first, size in reversed(classes):
            size = 6 if hexadecimal and size == 26 else size
            inside = (code >= first) & (code < first + size)
            to = F.pmod(code - first + drawn, F.lit(size)) + first
            moved = F.when(inside, _char(to) if first > 255 else F.char(to)).otherwise(moved)
        return moved

    places = F.sequence(F.lit(0), F.length(text) - 1)
    return F.when(F.length(text) == 0, text).otherwise(F.array_join(F.transform(places, one), ""))


def _char(code: Column) -> Column:
    """The character of a code point of four hexadecimal digits."""
    return F.decode(F.unhex(F.lpad(F.hex(code), 4, "0")), "UTF-16BE")


def feistel_text(text: Column, secret: Column, hexadecimal: bool = False, classes: tuple = PLAIN) -> Column:
    """A keyed permutation of the texts whose characters have the same ``classes`` in turn.

    The halves are added to in turn, each by what the other and the key give.
    Characters of no class stay. The permutation of a text of one character
    is a shift by the key.
    """

    def step(state: Column, turn: Column) -> Column:
        mark = _digest(secret, turn.cast("string"), state["r"])
        return F.struct(state["r"].alias("l"), _shift(state["l"], mark, hexadecimal, classes).alias("r"))

    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        text.substr(F.lit(1), half).alias("l"), text.substr(half + 1, F.length(text)).alias("r")
    )
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, lambda s: F.concat(s["l"], s["r"])
    )


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"\D", "")


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """The Luhn sum; every other digit from the right is doubled, from place ``doubled`` on."""

    def add(total: Column, at: Column) -> Column:
        digit = F.reverse(digits).substr(at + 1, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(F.pmod(at, F.lit(2)) == doubled, twice).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _refill(text: Column, digits: Column) -> Column:
    """The digits of ``text`` replaced in turn by ``digits``, all else left."""

    def add(state: Column, at: Column) -> Column:
        letter = text.substr(at + 1, F.lit(1))
        is_digit = letter.rlike("[0-9]")
        return F.struct(
            F.concat(state["out"], F.when(is_digit, digits.substr(state["n"] + 1, F.lit(1))).otherwise(letter)).alias("out"),
            (state["n"] + F.when(is_digit, 1).otherwise(0)).alias("n"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
    return F.aggregate(
        F.sequence(F.lit(0), F.length(text) - 1), start, add, lambda s: s["out"]
    )


def _card(found: Column, secret: Column) -> Column:
    digits = _digits(found)
    body = feistel_text(digits.substr(F.lit(1), F.length(digits) - 1), secret)
    check = F.pmod(10 - F.pmod(_luhn_sum(body, 0), F.lit(10)), F.lit(10))
    return F.when(
        F.pmod(_luhn_sum(digits, 1), F.lit(10)) == 0,
        _refill(found, F.concat(body, check.cast("string"))),
    ).otherwise(found)


def _phone(found: Column, secret: Column) -> Column:
    code = F.regexp_extract(found, r"^(?:\+\d{1,3}[ .\-]?)?", 0)
    rest = found.substr(F.length(code) + 1, F.length(found))
    return F.concat(code, _refill(rest, feistel_text(_digits(rest), secret)))


def _abroad(found: Column, secret: Column) -> Column:
    """The country's code stays, so only equal codes and layouts share their pseudonyms."""
    code = F.regexp_extract(found, r"^\+[1-9]\d{0,2}(?:[ .\-]?\(0\))?", 0)
    rest = found.substr(F.length(code) + 1, F.length(found))
    total = F.length(_digits(found))
    return F.when(total.between(8, 15), F.concat(code, _refill(rest, feistel_text(_digits(rest), secret)))).otherwise(found)


def _social(found: Column, secret: Column) -> Column:
    """The number of a possible number among all possible ones is permuted."""
    valid = found.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$")
    area, group, serial = (found.substr(at, n).cast("long") for at, n in ((1, 3), (5, 2), (8, 4)))
    place = area - F.when(area > 666, 2).otherwise(1)
    number = (place * GROUPS + group - 1) * SERIALS + serial - 1
    moved = walk(number, SOCIAL_SIDE, secret, lambda n: n < AREAS * GROUPS * SERIALS)
    place = F.floor(moved / (GROUPS * SERIALS))
    area = place + F.when(place >= 665, 2).otherwise(1)
    group = F.pmod(F.floor(moved / SERIALS), F.lit(GROUPS)) + 1
    serial = F.pmod(moved, F.lit(SERIALS)) + 1
    text = [F.lpad(x.cast("string"), n, "0") for x, n in ((area, 3), (group, 2), (serial, 4))]
    return F.when(valid, F.concat_ws("-", *text)).otherwise(found)


def _address(found: Column, secret: Column) -> Column:
    octets = F.transform(F.split(found, r"\."), lambda x: x.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda n, x: n * 256 + x)
    moved = feistel_number(number, 1 << 16, secret)
    shifts = F.array(*(F.lit(1 << s).cast("long") for s in (24, 16, 8, 0)))
    out = F.array_join(
        F.transform(shifts, lambda s: F.pmod(F.floor(moved / s), F.lit(256)).cast("string")), "."
    )
    return F.when(F.forall(octets, lambda x: x < 256), out).otherwise(found)


def _date(found: Column, secret: Column) -> Column:
    """A day becomes a day of the same reading.

    What can be month/day is; only other texts are day/month, and become days
    after the 12th, which can be nothing else. So no two readings share a text.
    """
    origin = F.to_date(F.lit(FIRST_DAY))
    on = lambda n: F.date_add(origin, n.cast("int"))
    out = found
    for shape, form, late in (
        (r"^\d{2}\.", "dd.MM.yyyy", False),
        (r"^\d{2}/", "dd/MM/yyyy", True),
        (r"^\d{2}/", "MM/dd/yyyy", False),
        (r"^\d{4}-", "yyyy-MM-dd", False),
    ):
        number = F.datediff(F.try_to_date(found, form), origin).cast("long")
        if late:
            moved = walk(number, DAY_SIDE, F.concat(secret, F.lit("|late")), lambda n: F.dayofmonth(on(n)) > 12)
        else:
            moved = feistel_number(number, DAY_SIDE, secret)
        inside = found.rlike(shape) & number.between(0, DAY_SIDE * DAY_SIDE - 1)
        out = F.when(inside, F.date_format(on(moved), form)).otherwise(out)
    return out


def _email(found: Column, secret: Column) -> Column:
    local = F.substring_index(found, "@", 1)
    return F.concat(feistel_text(local, secret, classes=PLAIN + BLOCKS), found.substr(F.length(local) + 1, F.length(found)))


def _secret(found: Column, secret: Column) -> Column:
    tail = found.substr(F.lit(5), F.length(found))
    hexadecimal = found.rlike("^[0-9A-Fa-f]{40}$")
    return (
        F.when(hexadecimal, feistel_text(found, secret, hexadecimal=True))
        .when(found.rlike("^AKIA[0-9A-Z]{16}$"), F.concat(F.lit("AKIA"), feistel_text(tail, secret)))
        .otherwise(feistel_text(found, secret))
    )


def pseudonym(found: Column, secret: Column) -> Column:
    """What a match of ANY becomes; a number that fails its check stays."""
    kinds = (
        ("email", "@", _email),
        ("date", f"^(?:{DATE})$", _date),
        ("ip", f"^(?:{ADDRESS})$", _address),
        ("ssn", f"^(?:{SOCIAL})$", _social),
        ("card", f"^(?:{CARD})$", _card),
        ("phone", f"^(?:{PHONE})$", _phone),
        ("abroad", f"^(?:{ABROAD})$", _abroad),
    )
    out = _secret(found, F.concat(secret, F.lit("|secret")))
    for name, shape, change in reversed(kinds):
        out = F.when(found.rlike(shape), change(found, F.concat(secret, F.lit("|" + name)))).otherwise(out)
    return out


def pseudonymize(docs: DataFrame, secret: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``docs`` with the personal data of whole texts replaced; other columns stay.

    E-mail names, telephone numbers (with a country's code in any layout of 8
    to 15 digits), card and social-security numbers, IP addresses
    and calendar dates are permuted within their format by a Feistel network
    keyed with ``secret`` and the kind: equal values become equal pseudonyms
    in every document, different ones stay different. Card numbers must pass
    the Luhn check and do so afterwards; octets, dates and social-security
    numbers must be possible ones. Named credentials are permuted alike.
    ``count`` names a column for the number of values changed. NULL stays
    NULL (no values), and a text without a digit or an @ is left as it is.
    """
    held, new = "__found", "__new"
    while {held, new} & {*docs.columns, count}:
        held, new = held + "_", new + "_"
    found = F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))
    changed = docs.withColumn(held, F.when(F.col(text).rlike("[0-9@]"), found))
    changed = changed.withColumn(new, F.transform(held, lambda x: pseudonym(x, F.lit(secret))))
    pieces = F.split(F.col(text), ANY, -1)
    woven = F.array_join(
        F.zip_with(pieces, F.col(new), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), ""
    )
    some = F.size(held) > 0
    out = changed.withColumn(text, F.when(some, woven).otherwise(F.col(text)))
    if count:
        differs = F.zip_with(held, new, lambda a, b: (a != b).cast("int"))
        total = F.aggregate(differs, F.lit(0), lambda n, x: n + x)
        out = out.withColumn(count, F.coalesce(total, F.lit(0)).cast("long"))
    return out.drop(held, new)
