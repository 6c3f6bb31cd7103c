"""PII (op 1): format-preserving Feistel pseudonyms, in DataFrame functions only.

Personal values are found in the text and replaced by others of the same format: a keyed Feistel network permutes the
values of each format, so equal values get equal pseudonyms in every document, and different ones of a format differ.
What only looks like one is left alone, since every candidate is validated first:

- payment cards: 13 to 19 digits, also in groups, with an issuer's prefix and a right check digit. The first six digits
  stay, the check digit is computed anew.
- IBANs: a right checksum. The country stays, the check digits are computed anew.
- dates (yyyy-mm-dd, dd.mm.yyyy, dd/mm/yyyy, or mm/dd/yyyy where the former is none): real days from 1800 to 2199. The
  whole range of 146097 days is permuted; equal days stay equal across these ways of writing.
- US social security numbers: areas, groups and serials in use.
- IPv4 addresses: four numbers up to 255.
- telephone numbers: +country code or the North American form. The country code stays.
- e-mail addresses: the domain stays; letters become letters, digits become digits.
- secrets (token, key, secret, password = value of 16 or more characters with a digit): likewise; hexadecimal values
  stay so.

A candidate is searched from every place where one may start, and ends where its longest valid part ends: a card, IBAN or
telephone number is found before an expiry date, a year or a capital word. The search goes on behind a replaced part, and
within candidates of which no part is valid.

The network works on an array of small numbers with a radix each. The two halves take turns: a half gets added, number
by number and modulo its radix, a pad that SHA-256 derives from the key, the format, the round and the other half. This
can be undone whatever the pad is, so it is a permutation of exactly the values of that format.

Defined results: null text stays null, without findings; texts without digits, @ or = are skipped unread by the larger
pattern; repeated rows are treated alike; extra columns pass through ``replace``, whatever their names; an empty table
gives an empty result. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.names import fresh

#: Stands for a secret; a real run passes its own.
KEY = "tessera"
ROUNDS = 8

_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
EMAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[A-Za-z0-9\-][A-Za-z0-9\-.]*\.[A-Za-z]{2,}"
SECRET = _EDGE + r"(?i:token|secret|password|passwd|api[_\-]?key)\s*[:=]\s*\"?(?=[A-Za-z_\-]*[0-9])[A-Za-z0-9_\-]{16,}"
IBAN = _EDGE + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END
DATE = _EDGE + r"(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./\-][0-9])"
SSN = r"(?<![\p{L}\p{N}\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\p{L}\p{N}\-])"
IP = r"(?<![\p{L}\p{N}.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\p{L}\p{N}]|\.[0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}|" + _EDGE + r"(?:\([0-9]{3}\) ?|[0-9]{3}-)[0-9]{3}-[0-9]{4})" + _END + r"(?!\.[0-9])"
CARD = r"(?<![\p{L}\p{N}\-])[0-9](?:[ \-]?[0-9]){12,18}" + _END
# the domain is one loop over characters, since a loop over labels recurses in the JVM; ``part`` cuts at an empty label
PATTERN = "|".join((EMAIL, SECRET, IBAN, DATE, SSN, IP, PHONE, CARD))
#: Every place where a candidate starts, also within others.
STARTS = f"(?=({PATTERN}))"
LIKELY = r"[0-9@=]"
#: Bytes after which a text in the making is set aside, so that long texts aren't copied whole for each piece.
CHUNK = 4096

#: Visa, Mastercard, American Express, Discover, JCB, UnionPay, Diners.
ISSUERS = r"^(4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|6011|64[4-9]|65|35(2[89]|[3-8])|62|3[068])"
#: Characters of the IBANs of each country; elsewhere 15 to 34.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
FIRST_DAY, DAYS, DAY_RADIX = "1800-01-01", 146097, (189, 773)
_LETTERS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
_HEX = ("0123456789", "abcdef", "ABCDEF")


def feistel(values: Column, radix: Column, kind: str, key: str) -> Column:
    """A keyed permutation of the arrays of longs whose elements lie below ``radix``."""
    half = F.floor(F.size(values) / 2).cast("int")

    def pad(k: Column, i: Column, other: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), k.cast("string"), F.floor(i / 8).cast("string"), other), 256)
        return F.conv(F.substring(digest, (i % 8) * 8 + 1, F.lit(8)), 16, 10).cast("long")

    def one(s: Column, k: Column) -> Column:
        other = F.array_join(F.when(k % 2 == 0, F.slice(s, half + 1, F.size(s))).otherwise(F.slice(s, F.lit(1), half)), ",")
        return F.transform(s, lambda x, i: F.when((i < half) == (k % 2 == 0), (x + pad(k, i, other)) % F.get(radix, i)).otherwise(x))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, one)


def _bind(value: Column, then) -> Column:
    """``then(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _chars(s: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.substring(s, i, F.lit(1)))


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _numbers(s: Column) -> Column:
    return F.transform(_chars(s), lambda c: c.cast("long"))


def _permute_digits(s: Column, kind: str, key: str) -> Column:
    """A string of one or more digits, permuted among those of its length."""
    permuted = _bind(_numbers(s), lambda v: feistel(v, F.transform(v, lambda x: F.lit(10).cast("long")), kind, key))
    return F.when(F.length(s) > 0, F.array_join(permuted, "")).otherwise("")


def _refill(s: Column, digits: Column) -> Column:
    """``s`` with its digits replaced in order."""
    at = lambda i: F.length(_digits(F.substring(s, F.lit(1), i)))
    return F.array_join(F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.when(F.substring(s, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, at(i), F.lit(1))).otherwise(F.substring(s, i, F.lit(1)))), "")


def _permute_text(s: Column, classes: tuple[str, ...], kind: str, key: str) -> Column:
    """Each letter or digit becomes one of its class; other characters stay."""
    index = lambda c: F.coalesce(*[F.when(F.instr(F.lit(k), c) > 0, F.instr(F.lit(k), c) - 1) for k in classes], F.lit(0)).cast("long")
    radix = lambda c: F.coalesce(*[F.when(F.instr(F.lit(k), c) > 0, F.lit(len(k))) for k in classes], F.lit(1)).cast("long")
    letter = lambda c, x: F.coalesce(*[F.when(F.instr(F.lit(k), c) > 0, F.substring(F.lit(k), (x + 1).cast("int"), F.lit(1))) for k in classes], c)
    return _bind(_chars(s), lambda cs: F.array_join(F.zip_with(cs, feistel(F.transform(cs, index), F.transform(cs, radix), kind, key), letter), ""))


def _luhn(d: Column) -> Column:
    """The sum that is divisible by 10 in valid numbers."""
    double = lambda x: 2 * x - F.when(x > 4, 9).otherwise(0)
    return _bind(F.reverse(_numbers(d)), lambda v: F.aggregate(F.transform(v, lambda x, i: F.when(i % 2 == 1, double(x)).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x))


def _card(m: Column, key: str) -> Column:
    def made(d: Column) -> Column:
        head = F.concat(F.substring(d, F.lit(1), F.lit(6)), _permute_digits(F.substring(d, F.lit(7), F.length(d) - 7), "card", key))
        return _bind(head, lambda h: F.concat(h, ((10 - _luhn(F.concat(h, F.lit("0"))) % 10) % 10).cast("string")))

    return _bind(_digits(m), lambda d: F.when(d.rlike(ISSUERS) & (_luhn(d) % 10 == 0), _refill(m, made(d))))


def _mod97(s: Column) -> Column:
    """The remainder of an IBAN whose first four characters are moved to the end."""
    moved = F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, F.lit(1), F.lit(4)))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(_chars(moved), F.lit(0), lambda a, c: F.when(value(c) > 9, a * 100 + value(c)).otherwise(a * 10 + value(c)) % 97)


def _iban(m: Column, key: str) -> Column:
    def made(s: Column) -> Column:
        body = _permute_text(F.substring(s, F.lit(5), F.length(s)), _LETTERS[:3], "iban", key)
        country = F.substring(s, F.lit(1), F.lit(2))
        return _bind(body, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(country, F.lit("00"), b))).cast("string"), 2, "0"), b))

    spaced = lambda s: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substring(m, i, F.lit(1)) == " ", " ").otherwise(F.substring(s, F.length(F.replace(F.substring(m, F.lit(1), i), F.lit(" "))), F.lit(1)))), "")
    return _bind(F.replace(m, F.lit(" ")), lambda s: F.when((_mod97(s) == 1) & F.length(s).between(15, 34), _bind(made(s), spaced)))


def _date(m: Column, key: str) -> Column:
    part = lambda a, n: F.substring(m, F.lit(a), F.lit(n))
    iso, dotted = m.rlike("^[0-9]{4}-"), m.rlike(r"\.")
    ymd = lambda y, mo, d: F.concat_ws("-", y, mo, d).try_cast("date")
    european, american = ymd(part(7, 4), part(4, 2), part(1, 2)), ymd(part(7, 4), part(1, 2), part(4, 2))
    day = F.when(iso, ymd(part(1, 4), part(6, 2), part(9, 2))).when(dotted, european).otherwise(F.coalesce(european, american))
    shape = F.when(iso, "yyyy-MM-dd").when(dotted, "dd.MM.yyyy").when(european.isNotNull(), "dd/MM/yyyy").otherwise("MM/dd/yyyy")

    def made(n: Column) -> Column:
        a, b = DAY_RADIX
        v = F.array((n % a).cast("long"), F.floor(n / a).cast("long"))
        new = feistel(v, F.array(F.lit(a).cast("long"), F.lit(b).cast("long")), "date", key)
        day = lambda x: F.date_add(F.lit(FIRST_DAY).cast("date"), (F.get(x, F.lit(0)) + a * F.get(x, F.lit(1))).cast("int"))
        written = lambda d, f: F.date_format(d, f)
        return _bind(_bind(new, day), lambda d: F.when(shape == "yyyy-MM-dd", written(d, "yyyy-MM-dd")).when(shape == "dd.MM.yyyy", written(d, "dd.MM.yyyy")).when(shape == "dd/MM/yyyy", written(d, "dd/MM/yyyy")).otherwise(written(d, "MM/dd/yyyy")))

    return _bind(F.datediff(day, F.lit(FIRST_DAY).cast("date")), lambda n: F.when(n.between(0, DAYS - 1), made(n)))


def _ssn(m: Column, key: str) -> Column:
    part = lambda a, n: F.substring(m, F.lit(a), F.lit(n)).cast("long")
    area, group, serial = part(1, 3), part(5, 2), part(8, 4)
    v = F.array(F.when(area > 666, area - 2).otherwise(area - 1), group - 1, serial - 1)
    radix = F.array(*[F.lit(x).cast("long") for x in (898, 99, 9999)])
    pick = lambda x, i: F.get(x, F.lit(i))
    write = lambda x: F.concat_ws("-", F.lpad(F.when(pick(x, 0) >= 665, pick(x, 0) + 2).otherwise(pick(x, 0) + 1).cast("string"), 3, "0"), F.lpad((pick(x, 1) + 1).cast("string"), 2, "0"), F.lpad((pick(x, 2) + 1).cast("string"), 4, "0"))
    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), _bind(feistel(v, radix, "ssn", key), write))


def _ip(m: Column, key: str) -> Column:
    v = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    return _bind(v, lambda v: F.when(F.forall(v, lambda x: x <= 255), F.array_join(feistel(v, F.transform(v, lambda x: F.lit(256).cast("long")), "ip", key), ".")))


def _phone(m: Column, key: str) -> Column:
    code = F.when(m.startswith("+"), F.length(F.regexp_extract(m, r"^\+([0-9]{1,3})(?![0-9])", 1))).otherwise(0)
    code = F.when(m.startswith("+") & (code == 0), 1).otherwise(code)
    made = lambda d: F.concat(F.substring(d, F.lit(1), code), _permute_digits(F.substring(d, code + 1, F.length(d)), "phone", key))
    return _bind(_digits(m), lambda d: F.when(F.length(d).between(8, 15), _refill(m, made(d))))


def _email(m: Column, key: str) -> Column:
    at = F.instr(m, "@")
    return F.concat(_permute_text(F.substring(m, F.lit(1), at - 1), _LETTERS, "email", key), F.substring(m, at, F.length(m)))


def _secret(m: Column, key: str) -> Column:
    head = F.regexp_extract(m, r"^(.*?[:=]\s*\"?)", 1)
    value = lambda: F.substring(m, F.length(head) + 1, F.length(m))
    hexed = value().rlike("^([0-9a-f]+|[0-9A-F]+)$")
    return F.concat(head, F.when(hexed, _permute_text(value(), _HEX, "hex", key)).otherwise(_permute_text(value(), _LETTERS[:3], "secret", key)))


KINDS = (
    ("email", "@", _email),
    ("secret", r"[:=]", _secret),
    ("iban", r"^[A-Z]", _iban),
    ("date", "^" + DATE + "$", _date),
    ("ssn", "^" + SSN + "$", _ssn),
    ("ip", "^" + IP + "$", _ip),
    ("phone", r"^(\+|\(|[0-9]{3}-[0-9]{3}-[0-9]{4}$)", _phone),
    ("card", "^[0-9]", _card),
)


def _valid_iban(v: Column) -> Column:
    country, n = F.substring(v, F.lit(1), F.lit(2)), F.length(F.replace(v, F.lit(" ")))
    known = F.create_map(*[F.lit(x) for k, names in IBAN_LENGTHS.items() for name in names.split() for x in (name, k)])
    return F.coalesce(n == F.try_element_at(known, country), n.between(15, 34)) & (_mod97(F.replace(v, F.lit(" "))) == 1)


def _valid_card(v: Column) -> Column:
    return _bind(_digits(v), lambda d: F.length(d).between(13, 19) & d.rlike(ISSUERS) & (_luhn(d) % 10 == 0))


def _longest(m: Column, valid, apart: str = r"[ \-]") -> Column:
    """The longest valid part of a candidate from its start to the end of a group; null where there is none."""
    end = lambda i: F.substring(m, i, F.lit(1)).rlike(r"[\p{L}\p{N}]") & ((i == F.length(m)) | F.substring(m, i + 1, F.lit(1)).rlike(apart))
    ends = F.filter(F.sequence(F.length(m), F.lit(1), F.lit(-1)), end)
    return F.get(F.filter(F.transform(ends, lambda i: F.substring(m, F.lit(1), i)), valid), F.lit(0))


def part(m: Column) -> Column:
    """The part of a candidate that is to be replaced, where its kind leaves the end open."""
    card = lambda x: _longest(x, _valid_card)
    fits = lambda v: F.length(_digits(v)).between(8, 15) & v.rlike("^(?:" + PHONE + ")$")
    # too many digits for a telephone number may be a card behind a plus sign
    plus = F.when(F.length(_digits(m)) > 15, card(F.substring(m, F.lit(2), F.length(m))))
    kind = kind_of(m)
    mail = F.nullif(F.regexp_extract(F.substring_index(m, "..", 1), r"^[^@]*@.*\.[A-Za-z]{2,}", 0), F.lit(""))
    whole = ~F.contains(F.substring(m, F.instr(m, "@"), F.length(m)), F.lit(".."))
    mail = F.when(whole | F.contains(F.substring(m, F.lit(1), F.instr(m, "@")), F.lit("..")), m).otherwise(mail)
    return F.when(kind == "email", mail).when(kind == "iban", _longest(m, _valid_iban)).when(kind == "card", card(m)).when(kind == "phone", F.when(plus.isNull(), _longest(m, fits, " "))).otherwise(m)


def pseudonym(m: Column, key: str = KEY) -> Column:
    """The pseudonym of a part; null where it isn't valid."""
    out = None
    for _, test, made in KINDS:
        out = F.when(m.rlike(test), made(m, key)) if out is None else out.when(m.rlike(test), made(m, key))
    return out


def kind_of(m: Column) -> Column:
    out = None
    for name, test, _ in KINDS:
        out = F.when(m.rlike(test), name) if out is None else out.when(m.rlike(test), name)
    return out


def replace(docs: DataFrame, text: str = "text", key: str = KEY, counts: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in its texts; with ``counts`` also n_found, n_replaced and their kinds."""
    own = [F.col(f"`{c}`") for c in docs.columns]
    t = F.col(f"`{text}`")
    match, value, made, number, built = (fresh(docs.columns, x) for x in "mvcna")
    # a line break in front, so that no candidate stands at the start and there is one piece more than candidates
    led = F.concat(F.lit("\n"), t)
    found = F.when(t.rlike(LIKELY), F.regexp_extract_all(led, F.lit(STARTS), F.lit(1))).otherwise(F.array().cast("array<string>"))
    x = docs.select(*own, found.alias(match)).select(*own, F.transform(match, part).alias(value))
    x = x.select(*own, F.transform(value, lambda v: F.struct(F.length(v).alias("n"), pseudonym(v, key).alias("p"), kind_of(v).alias("kind"))).alias(made))
    state = F.struct(
        F.lit(0).alias("skip"), F.lit("").alias("text"), F.array().cast("array<string>").alias("done"),
        F.lit(0).cast("long").alias("found"), F.lit(0).cast("long").alias("replaced"), F.array().cast("array<string>").alias("kinds"),
    )

    def step(a: Column, x: Column) -> Column:
        """Appends a piece, with its candidate replaced; ``skip`` characters of it belong to a part already replaced."""
        free, s, c = a["skip"] == 0, x["s"], x["c"]
        take = free & c["p"].isNotNull()
        gone = F.when(take, c["n"]).otherwise(a["skip"])
        new = F.concat(a["text"], F.when(take, c["p"]).otherwise(""), F.substring(s, gone + 1, F.length(s)))
        full = F.octet_length(a["text"]) > CHUNK
        return F.struct(
            F.greatest(F.lit(0), gone - F.length(s)).alias("skip"),
            F.when(full, F.substring(new, F.length(a["text"]) + 1, F.length(new))).otherwise(new).alias("text"),
            F.when(full, F.concat(a["done"], F.array(a["text"]))).otherwise(a["done"]).alias("done"),
            (a["found"] + (free & c.isNotNull()).cast("long")).alias("found"),
            (a["replaced"] + take.cast("long")).alias("replaced"),
            F.when(take, F.array_union(a["kinds"], F.array(c["kind"]))).otherwise(a["kinds"]).alias("kinds"),
        )

    none = F.lit(None).cast("struct<n:int,p:string,kind:string>")
    pieces = F.zip_with(F.split(led, STARTS), F.concat(F.array(none), F.col(made)), lambda s, c: F.struct(s.alias("s"), c.alias("c")))
    x = x.select(*own, F.size(made).alias(number), F.when(F.exists(made, lambda c: c["p"].isNotNull()), F.aggregate(pieces, state, step)).alias(built))
    a = F.col(built)
    joined = F.concat(F.array_join(a["done"], ""), a["text"])
    new = F.when(a.isNotNull(), F.substring(joined, F.lit(2), F.length(joined))).otherwise(t)
    more = []
    if counts:
        found, replaced = F.coalesce(a["found"], F.greatest(F.col(number), F.lit(0)).cast("long")), F.coalesce(a["replaced"], F.lit(0).cast("long"))
        more = [found.alias("n_found"), replaced.alias("n_replaced"), F.coalesce(F.array_join(F.array_sort(a["kinds"]), ","), F.lit("")).alias("kinds")]
    return x.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns], *more)
