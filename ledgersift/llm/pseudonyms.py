"""Format-preserving pseudonyms for personal values inside texts.

Every candidate value is validated (Luhn, mod 97, octets, calendar, numbering
plan), mapped by a keyed Feistel network to another valid value of the same
format and written back in its place. The map is a permutation of the format's
domain, so equal values stay equal across documents and different ones stay
different; whoever holds the key can invert it.

All of it is column expressions: texts are split at the candidates and put
together again inside the row, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 10

#: One alternative per kind; look-arounds keep candidates from starting inside longer numbers.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
#: Length of the IBANs of each country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN_OF_COUNTRY = "(?:" + "|".join(
    rf"(?:{of.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}"
    + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    for n, of in IBAN_LENGTHS.items()
) + ")(?![A-Za-z0-9])"
#: Other countries, and lengths that are not those of the table: as far as it goes, see :func:`_iban_parts`.
OTHER_IBAN = (
    rf"[A-Z]{{2}}\d{{2}}(?: ?(?!{IBAN_OF_COUNTRY})[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![A-Za-z0-9])"
)
IBAN = f"(?:{IBAN_OF_COUNTRY}|{OTHER_IBAN})"
KEY_ID = r"(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
ASSIGNED = r"(?:password|passwd|token|secret|api_key)\s?[=:]\s?\"?[A-Za-z0-9]{12,64}"
DATE = r"(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})(?![\d])"
SSN = r"\d{3}-\d{2}-\d{4}(?![-\d])"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}(?![\d]|\.\d)"
PHONE = r"\+\d(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\d)|\(\d{3}\) ?\d{3}-\d{4}(?!\d)|\d{3}-\d{3}-\d{4}(?![-\d])"
#: Groups of digits up to the next value of another kind; the cards among them are told apart afterwards.
RUN = rf"(?=\d(?:[ -]?\d){{12}})\d++(?:[ -](?!{DATE}|{SSN}|{IPV4}|\d{{3}}-\d{{3}}-\d{{4}}(?![-\d]))\d++)*+"
#: The usual groupings of a card, and others in groups of four digits or more with a shorter rest.
CARD = r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{4,5}"
OTHER_CARD = r"\d{4,}(?:[ -]\d{4,}){0,3}(?:[ -]\d+)?"
CARD_GROUPS = 5
CANDIDATE = (
    rf"(?<![A-Za-z0-9])(?:{EMAIL}|{IBAN}|{KEY_ID}|{ASSIGNED})"
    rf"|(?<!\d)(?<!\d\.)(?:{DATE}|{SSN}|{IPV4}|{PHONE}|{RUN})"
)
#: A text without any of these holds no candidate.
HINT = r"[0-9@]|AKIA|ASIA|password|passwd|token|secret|api_key"
KINDS = ("email", "iban", "secret", "date", "ssn", "ip", "phone", "card")


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value bound once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _prf(key: str, kind: str, turn: Column, half: Column, modulus: Column | int) -> Column:
    """A number below ``modulus`` that depends on the key, the kind, the round and the other half."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), half.cast("string"))
    number = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("bigint")
    return F.pmod(number, modulus if isinstance(modulus, Column) else F.lit(modulus).cast("bigint"))


def feistel(number: Column, left_size: Column, right_size: Column, key: str, kind: str,
            inverse: bool = False) -> Column:
    """Permute 0 .. left_size * right_size - 1; halves change in turn by modular addition."""
    left_size, right_size = left_size.cast("bigint"), right_size.cast("bigint")
    number = number.cast("bigint")
    start = F.struct(
        F.call_function("div", number, right_size).alias("l"), F.pmod(number, right_size).alias("r")
    )
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        own, other = F.when(even, s["l"]).otherwise(s["r"]), F.when(even, s["r"]).otherwise(s["l"])
        size = F.when(even, left_size).otherwise(right_size)
        return _let(
            F.pmod(own + sign * _prf(key, kind, i, other, size), size),
            lambda new: F.struct(
                F.when(even, new).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(new).alias("r")
            ),
        )

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(turns, start, turn, lambda s: s["l"] * right_size + s["r"])


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), n.cast("int") + 1, "0").cast("bigint")


def _digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permute_digits(digits: Column, key: str, kind: str, inverse: bool = False) -> Column:
    """A digit string of up to 34 digits to another of the same length (halves of up to 17 digits)."""
    n = F.length(digits)
    high = F.ceil(n / 2).cast("int")
    zero = F.lit(0).cast("bigint")
    # The halves are numbers of their own, so the whole need not fit into 64 bits.
    start = F.struct(
        F.coalesce(F.substring(digits, F.lit(1), high).try_cast("bigint"), zero).alias("l"),
        F.coalesce(F.substring(digits, high + 1, n).try_cast("bigint"), zero).alias("r"),
        high.alias("high"),
        (n - high).alias("low"),
    )
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        own, other = F.when(even, s["l"]).otherwise(s["r"]), F.when(even, s["r"]).otherwise(s["l"])
        size = _power(F.when(even, s["high"]).otherwise(s["low"]))
        tag = F.concat_ws(":", F.lit(kind), (s["high"] + s["low"]).cast("string"), other.cast("string"))
        return _let(
            F.pmod(own + sign * _prf(key, "digits", i, tag, size), size),
            lambda new: F.struct(
                F.when(even, new).otherwise(s["l"]).alias("l"),
                F.when(even, s["r"]).otherwise(new).alias("r"),
                s["high"].alias("high"),
                s["low"].alias("low"),
            ),
        )

    turns = F.sequence(F.lit(ROUNDS - 1), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    return F.aggregate(
        turns, start, turn,
        lambda s: F.concat(
            F.when(s["high"] > 0, F.lpad(s["l"].cast("string"), s["high"], "0")).otherwise(F.lit("")),
            F.when(s["low"] > 0, F.lpad(s["r"].cast("string"), s["low"], "0")).otherwise(F.lit("")),
        ),
    )


def _refill(shape: Column, digits: Column) -> Column:
    """Put ``digits`` in the places of the digits of ``shape``."""
    chars = F.split(shape, "")
    state = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))
    return F.aggregate(
        chars, state,
        lambda s, c: F.when(
            c.rlike("^[0-9]$"),
            F.struct(F.concat(s["out"], F.substring(digits, s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at")),
        ).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
        lambda s: s["out"],
    )


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string, the last digit being the check digit."""
    doubled = F.transform(
        F.split(F.reverse(digits), ""),
        lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def mod97(text: Column) -> Column:
    """The remainder of an IBAN-like text (letters count 10 to 35) divided by 97."""
    return F.aggregate(
        F.split(text, ""), F.lit(0),
        lambda a, c: F.when(c == "", a).otherwise(
            F.pmod(a * F.when(c.rlike("^[0-9]$"), 10).otherwise(100) + _position(c), F.lit(97))
        ),
    )


def _position(c: Column) -> Column:
    return F.call_function("instr", F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1


def _card(value: Column, key: str) -> Column:
    def check(body: Column) -> Column:
        return F.pmod(10 - F.pmod(luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")

    def made(digits: Column) -> Column:
        middle = F.substring(digits, F.lit(2), F.length(digits) - 2)
        return _let(
            F.concat(F.substring(digits, 1, 1), permute_digits(middle, key, "card")),
            lambda body: F.concat(body, check(body)),
        )

    return _refill(value, _let(_digits_of(value), made))


def _ip(value: Column, key: str) -> Column:
    parts = F.transform(F.split(value, r"\."), lambda p: p.cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda a, p: a * 256 + p)
    out = feistel(number, F.lit(65536), F.lit(65536), key, "ip")
    return _let(
        out,
        lambda x: F.concat_ws(".", *[F.pmod(F.shiftright(x, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]),
    )


#: Days from 1901-01-01 to 2099-12-31 are exactly 108 x 673; dates outside are no personal dates here.
FIRST_DAY, DATE_LEFT, DATE_RIGHT = "1901-01-01", 108, 673


def _parsed_date(value: Column) -> Column:
    iso = F.when(value.rlike(r"^\d{4}-"), value).otherwise(
        F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2))
    )
    return iso.try_cast("date")


def _date(value: Column, key: str) -> Column:
    day = F.datediff(_parsed_date(value), F.lit(FIRST_DAY).cast("date"))
    moved = feistel(day, F.lit(DATE_LEFT), F.lit(DATE_RIGHT), key, "date").cast("int")
    shown = F.date_format(F.date_add(F.lit(FIRST_DAY).cast("date"), moved), "yyyyMMdd")
    return _let(
        shown,
        lambda d: F.when(value.rlike(r"^\d{4}-"), _refill(value, d)).otherwise(
            _refill(value, F.concat(F.substring(d, 7, 2), F.substring(d, 5, 2), F.substring(d, 1, 4)))
        ),
    )


def _ssn(value: Column, key: str) -> Column:
    area, group, serial = (F.substring(value, a, n).cast("bigint") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = area - F.when(area > 666, 2).otherwise(1)
    out = feistel((index * 99 + group - 1) * 9999 + serial - 1, F.lit(898 * 99), F.lit(9999), key, "ssn")

    def shown(x: Column) -> Column:
        serial_ = F.pmod(x, F.lit(9999)) + 1
        rest = F.floor(x / 9999)
        area_ = F.floor(rest / 99) + 1
        area_ = area_ + F.when(area_ >= 666, 1).otherwise(0)
        return F.concat_ws(
            "-", F.lpad(area_.cast("string"), 3, "0"),
            F.lpad((F.pmod(rest, F.lit(99)) + 1).cast("string"), 2, "0"),
            F.lpad(serial_.cast("string"), 4, "0"),
        )

    return _let(out, shown)


NANP = r"^(?:\+1[ .-]?)?\(?[2-9]\d{2}\)?[ .-]?[2-9]\d{2}[ .-]?\d{4}$"


def _phone(value: Column, key: str) -> Column:
    def plan(ten: Column) -> Column:
        index = (
            (F.substring(ten, 1, 3).cast("bigint") - 200) * 800 + F.substring(ten, 4, 3).cast("bigint") - 200
        ) * 10000 + F.substring(ten, 7, 4).cast("bigint")
        return _let(
            feistel(index, F.lit(80000), F.lit(80000), key, "nanp"),
            lambda x: F.concat(
                (F.floor(x / 8000000) + 200).cast("string"),
                (F.pmod(F.floor(x / 10000), F.lit(800)) + 200).cast("string"),
                F.lpad(F.pmod(x, F.lit(10000)).cast("string"), 4, "0"),
            ),
        )

    def made(digits: Column) -> Column:
        n = F.length(digits)
        american = F.concat(
            F.substring(digits, F.lit(1), n - 10), _let(F.substring(digits, n - 9, F.lit(10)), plan)
        )
        abroad = F.concat(
            F.substring(digits, 1, 2), _let(F.substring(digits, F.lit(3), n), lambda d: permute_digits(d, key, "phone"))
        )
        return F.when(value.rlike(NANP), american).otherwise(abroad)

    return _refill(value, _let(_digits_of(value), made))


def _iban(value: Column, key: str) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country, bban = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))

    def filled(moved: Column) -> Column:
        check = 98 - mod97(F.concat(moved, country, F.lit("00")))
        return _digits_of(F.concat(F.lpad(check.cast("string"), 2, "0"), moved))

    moved = _let(bban, lambda b: _refill(b, permute_digits(_digits_of(b), key, "iban")))
    return _refill(value, _let(moved, filled))


def _iban(value: Column, key: str) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    country, bban = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain) - 4)
    moved = _refill(bban, permute_digits(_digits_of(bban), key, "iban"))
    check = 98 - mod97(F.concat(moved, country, F.lit("00")))
    new = F.concat(_digits_of(F.concat(F.lpad(check.cast("string"), 2, "0"), moved)))
    return _refill(value, new)


def _shift(text: Column, stream: Column, sign: int, hex_letters: bool = False) -> Column:
    """Move each letter within its case and each digit within the digits by the bytes of ``stream``."""
    letters = 6 if hex_letters else 26

    def one(c: Column, i: Column) -> Column:
        step = F.conv(F.substring(stream, F.pmod(i, F.lit(30)) * 2 + 1, F.lit(4)), 16, 10).cast("int")
        first = F.when(c.rlike("^[0-9]$"), 48).when(c.rlike("^[a-z]$"), 97).when(c.rlike("^[A-Z]$"), 65)
        return _let(
            first,
            lambda a: F.coalesce(
                F.chr(a + F.pmod(F.ascii(c) - a + sign * step, F.when(a == 48, 10).when(a == 65, 26).otherwise(letters))),
                c,
            ),
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def permute_text(text: Column, key: str, kind: str, hex_letters: bool = False, inverse: bool = False) -> Column:
    """Feistel over the two halves of a short text; every character keeps its class."""
    half = F.floor(F.length(text) / 2).cast("int")
    start = F.struct(
        F.substring(text, F.lit(1), half).alias("l"),
        F.substring(text, half + 1, F.length(text)).alias("r"),
    )
    sign = -1 if inverse else 1

    def turn(s: Column, i: Column) -> Column:
        even = i % 2 == 0
        own, other = F.when(even, s["r"]).otherwise(s["l"]), F.when(even, s["l"]).otherwise(s["r"])
        stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), i.cast("string"), other), 256)
        return _let(
            _let(stream, lambda x: _shift(own, x, sign, hex_letters)),
            lambda new: F.struct(
                F.when(even, s["l"]).otherwise(new).alias("l"), F.when(even, new).otherwise(s["r"]).alias("r")
            ),
        )

    turns = F.sequence(F.lit(3), F.lit(0)) if inverse else F.sequence(F.lit(0), F.lit(3))
    return F.aggregate(turns, start, turn, lambda s: F.concat(s["l"], s["r"]))


def _email(value: Column, key: str) -> Column:
    name = F.substring_index(value, "@", 1)
    return F.concat(permute_text(name, key, "email"), F.substring(value, F.length(name) + 1, F.length(value)))


def _secret(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, r"^(?:AKIA|ASIA|(?:password|passwd|token|secret|api_key)\s?[=:]\s?\"?)", 0)
    tail = F.substring(value, F.length(head) + 1, F.length(value))
    return F.concat(
        head,
        F.when(tail.rlike("^[0-9a-f]+$"), permute_text(tail, key, "hex", hex_letters=True)).otherwise(
            permute_text(tail, key, "secret")
        ),
    )


def kind_of(value: Column) -> Column:
    """The kind of a candidate that passes its validation, else null."""
    digits = _digits_of(value)
    n = F.length(digits)
    octets = F.split(value, r"\.")
    whole = lambda p: value.rlike(f"^(?:{p})$")
    day = _parsed_date(value)
    return (
        F.when(F.contains(value, F.lit("@")), F.lit("email"))
        .when(value.rlike("^(?:AKIA|ASIA|password|passwd|token|secret|api_key)"), F.lit("secret"))
        .when(
            value.rlike("^[A-Z]{2}"),
            F.when(
                _is_iban(value), F.lit("iban"),
            ),
        )
        .when(
            whole(DATE),
            F.when((day >= F.lit(FIRST_DAY).cast("date")) & (day <= F.lit("2099-12-31").cast("date")), F.lit("date")),
        )
        .when(
            whole(SSN),
            F.when(value.rlike(r"^(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}$"), F.lit("ssn")),
        )
        .when(
            whole(IPV4),
            F.when(
                F.forall(octets, lambda o: (o.cast("int") <= 255) & (o.cast("int").cast("string") == o)), F.lit("ip")
            ),
        )
        .when(value.rlike(NANP) & ((n == 10) | value.startswith("+1")), F.lit("phone"))
        .when(value.startswith("+"), F.when((n >= 8) & (n <= 15) & ~value.startswith("+1"), F.lit("phone")))
        .when(_is_card(value), F.lit("card"))
    )


def _is_iban(value: Column) -> Column:
    plain = F.replace(value, F.lit(" "), F.lit(""))
    return mod97(F.concat(F.substring(plain, F.lit(5), F.length(value)), F.substring(plain, 1, 4))) == 1


def _is_card(value: Column) -> Column:
    return F.when(
        F.length(_digits_of(value)).between(13, 19), F.pmod(luhn_sum(_digits_of(value)), F.lit(10)) == 0
    ).otherwise(F.lit(False))


def _part(value: Column, kind: Column) -> Column:
    return F.struct(value.alias("v"), kind.cast("string").alias("k"))


def _iban_parts(value: Column) -> Column:
    """The longest start of the groups that is an IBAN, and the rest; or the candidate as it is."""
    ends = F.filter(
        F.sequence(F.length(value), F.lit(15), F.lit(-1)),
        lambda n: ((n == F.length(value)) | (F.substring(value, n + 1, F.lit(1)) == " "))
        & _is_iban(F.substring(value, F.lit(1), n)),
    )
    return _let(
        F.when(F.length(value) >= 15, F.try_element_at(ends, F.lit(1))),
        lambda n: F.when(n.isNull(), F.array(_part(value, F.lit(None)))).otherwise(F.array(
            _part(F.substring(value, F.lit(1), n), F.lit("iban")),
            _part(F.substring(value, n + 1, F.length(value)), F.lit(None)),
        )),
    )


def _card_parts(run: Column) -> Column:
    """The cards in a run of digit groups and what lies between them, in order.

    Usual groupings come first, then others, then the run as a whole; of those
    that share a group the first and longest stays.
    """

    def text(groups: Column, a: Column, b: Column) -> Column:
        return F.array_join(F.slice(groups, a + 1, b - a), "")

    def spans(groups: Column) -> Column:
        n = F.size(groups)
        whole = F.struct(F.lit(2).alias("rank"), F.lit(0).alias("a"), (-n).alias("minus"), run.alias("v"))
        near = F.flatten(F.transform(
            F.sequence(F.lit(0), n - 1),
            lambda a: F.transform(
                F.sequence(F.lit(1), F.least(n - a, F.lit(CARD_GROUPS))),
                lambda k: _let(
                    F.rtrim(text(groups, a, a + k), F.lit(" -")),
                    lambda v: F.struct(
                        F.when(v.rlike(f"^(?:{CARD})$"), 0).when(v.rlike(f"^(?:{OTHER_CARD})$"), 1).alias("rank"),
                        a.alias("a"), (-k).alias("minus"), v.alias("v"),
                    ),
                ),
            ),
        ))
        return F.array_sort(
            F.filter(F.concat(near, F.array(whole)), lambda s: s["rank"].isNotNull() & _is_card(s["v"]))
        )

    def apart(found: Column) -> Column:
        none = F.array().cast("array<struct<a:int,b:int>>")
        ends = F.transform(found, lambda s: F.struct(s["a"].alias("a"), (s["a"] - s["minus"]).alias("b")))
        return F.array_sort(F.aggregate(
            ends, none,
            lambda held, s: F.when(
                F.exists(held, lambda h: (s["a"] < h["b"]) & (h["a"] < s["b"])), held
            ).otherwise(F.concat(held, F.array(s))),
        ))

    def cut(groups: Column, cards: Column) -> Column:
        pairs = F.transform(cards, lambda c, i: F.array(
            _part(text(groups, F.when(i == 0, 0).otherwise(F.get(cards, i - 1)["b"]), c["a"]), F.lit(None)),
            _part(text(groups, c["a"], c["b"]), F.lit("card")),
        ))
        last = F.coalesce(F.try_element_at(cards, F.lit(-1))["b"], F.lit(0))
        return F.concat(F.flatten(pairs), F.array(_part(text(groups, last, F.size(groups)), F.lit(None))))

    return _let(
        F.regexp_extract_all(run, F.lit(r"(\d+[ -]?)"), F.lit(1)),
        lambda groups: _let(apart(spans(groups)), lambda cards: cut(groups, cards)),
    )


def parts_of(value: Column) -> Column:
    """A candidate as parts (v, k) in order; k is the kind of a part that passes its validation, else null."""
    run = value.rlike(r"^\d[\d -]*$") & (F.length(_digits_of(value)) >= 13)
    return (
        F.when(run, _card_parts(value))
        .when(value.rlike(f"^{OTHER_IBAN}$") & ~value.rlike(f"^{IBAN_OF_COUNTRY}$"), _iban_parts(value))
        .otherwise(F.array(_part(value, kind_of(value))))
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a validated value."""
    makers = {"email": _email, "iban": _iban, "secret": _secret, "date": _date, "ssn": _ssn, "ip": _ip,
              "phone": _phone, "card": _card}
    out = value
    for name, make in makers.items():
        out = F.when(kind == name, make(value, key)).otherwise(out)
    return out


def pseudonymise_texts(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Add ``n_<kind>`` per kind and replace ``text`` by its pseudonymised form.

    A null text stays null with counts 0; an empty one stays empty. Candidates
    that fail validation are left as they are. Rows are neither merged nor
    dropped, other columns pass through; a column named ``n_<kind>`` is
    replaced. The key must be kept secret and equal for texts to be linked.
    """
    found = F.regexp_extract_all(F.col(text), F.lit(f"({CANDIDATE})"), F.lit(1))
    swapped = F.transform(
        F.transform(found, parts_of),
        lambda parts: _let(
            F.transform(parts, lambda x: F.struct(pseudonym(x["v"], x["k"], key).alias("v"), x["k"].alias("k"))),
            lambda new: F.struct(F.array_join(new["v"], "").alias("v"), new["k"].alias("k")),
        ),
    )
    # The candidates are bound once for the text and the counts.
    inner = F.col("_found")
    gaps = F.split(F.col(text), CANDIDATE)
    joined = F.array_join(
        F.zip_with(gaps, inner, lambda g, x: F.concat(g, F.coalesce(x["v"], F.lit("")))), ""
    )
    kinds = F.flatten(inner["k"])
    counts = {
        f"n_{k}": F.when(inner.isNull(), F.lit(0)).otherwise(F.size(kinds) - F.size(F.array_remove(kinds, k)))
        for k in KINDS
    }
    return (
        docs.withColumn("_found", F.when(F.col(text).rlike(HINT), swapped))
        .withColumns(counts)
        .withColumn(text, F.when(F.size(inner) > 0, joined).otherwise(F.col(text)))
        .drop("_found")
    )
