"""Format-preserving pseudonyms for personal data.

Found values are validated (checksums, octets, calendar) and permuted inside their own format by a keyed
Feistel network: digits stay digits, letters stay letters of their case, card numbers and IBANs keep right
check digits, addresses stay addresses and dates stay dates. The permutation depends on the key and the kind
only, so equal values stay equal in all documents. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: A key for trials; give your own and keep it secret.
TRIAL_KEY = "not a secret"
#: Dates from here, for so many days (200 years), permute among themselves; the two factors are its Feistel halves.
FIRST_DAY, DAY_HALVES = "1900-01-01", (17, 4297)

# The formats. Java syntax; every repeat of a group is bounded or possessive.
EMAIL = (
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,24})"
    r"|(?:[A-Za-z0-9-]++\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9]))"
)
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
IP = rf"(?<![\w.]){OCTET}(?:\.{OCTET}){{3}}(?!\.?\w)"
IBAN = r"(?<!\w)[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"
PHONE = (
    r"(?<![\w+])\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){1,4}(?![\w-])"
    r"|(?<![\w(])\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![\w-])"
    r"|(?<![\w.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![\w-])"
    r"|(?<![\w.-])[2-9][0-9]{2}-[0-9]{4}(?![\w-])"
)
SSN = r"(?<![\w-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![\w-])"
DATE = r"(?<![\w./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![\w/-])"
CARD = r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"
NAMED_SECRET = (
    r"(?<=[=:\s\"'])(?<=(?i:passwo?r?d|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']?\s{0,4}[:=]\s{0,4}[\"']?)"
    r"[A-Za-z0-9_+/=.~-]{5,}[A-Za-z0-9_+/=]"
)
KEY_ID = r"(?<!\w)(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?<!\w)gh[pousr]_[A-Za-z0-9]{36}(?!\w)"
KINDS = [("email", EMAIL), ("secret", NAMED_SECRET), ("key_id", KEY_ID), ("ip", IP), ("iban", IBAN), ("date", DATE),
         ("ssn", SSN), ("phone", PHONE), ("card", CARD)]
ANY = "|".join(f"(?:{pattern})" for _, pattern in KINDS)
#: Lengths of IBANs by country, as registered.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FO FI FK GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}
#: No format matches a text without one of these.
NEEDED = "[0-9@=:]"

DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def digit(value: Column, radix: Column) -> Column:
    return F.struct(value.cast("int").alias("v"), radix.cast("int").alias("r"))


def feistel(digits: Column, key: str, tweak: Column) -> Column:
    """A keyed permutation of arrays of digits (v, r), each v below its radix r; a null v stays in its place.

    In turn, each half is shifted by numbers that hash the other half. The result has the new v only.
    """

    def one_round(x: Column, i: Column) -> Column:
        half, left = F.floor(F.size(x) / 2).cast("int"), i % 2 == 0
        other = F.when(left, F.slice(x, half + 1, F.size(x) - half)).otherwise(F.slice(x, F.lit(1), half))
        values = F.array_join(F.transform(other, lambda d: d["v"].cast("string")), ",", "-")
        # Every digit hashes what is told: that of a very long value is hashed first.
        values = F.when(F.size(x) > 4096, F.sha2(values, 256)).otherwise(values)
        told = F.concat_ws(":", F.lit(key), tweak, i.cast("string"), values)

        def shifted(d: Column, j: Column, t: Column) -> Column:
            noise = F.conv(F.substring(F.sha2(F.concat_ws(":", t, j.cast("string")), 256), 1, 12), 16, 10).cast("long")
            new = F.when((j < half) == left, (d["v"] + noise) % d["r"]).otherwise(d["v"])
            return digit(new, d["r"])

        return let(told, lambda t: F.transform(x, lambda d, j: shifted(d, j, t)))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), digits, one_round), lambda d: d["v"])


def alphabet(char: Column, hexadecimal: Column) -> Column:
    return (
        F.when(hexadecimal, F.lit(DIGITS + LOWER[:6])).when(char.between("0", "9"), F.lit(DIGITS))
        .when(char.between("a", "z"), F.lit(LOWER)).when(char.between("A", "Z"), F.lit(UPPER)).otherwise(F.lit(""))
    )


def permuted_text(text: Column, key: str, tweak: Column) -> Column:
    """ASCII letters and digits permuted within their classes (lower-case hexadecimal within its 16 digits)."""

    def of_chars(chars: Column) -> Column:
        digits = F.transform(chars, lambda c: digit(F.when(c["a"] != "", F.position(c["c"], c["a"]) - 1), F.length(c["a"])))
        new = feistel(digits, key, tweak)
        return F.array_join(
            F.zip_with(chars, new, lambda c, v: F.coalesce(F.substring(c["a"], v + 1, F.lit(1)), c["c"])), ""
        )

    def with_alphabets(hexadecimal: Column) -> Column:
        chars = F.transform(F.split(text, ""), lambda c: F.struct(c.alias("c"), alphabet(c, hexadecimal).alias("a")))
        return let(chars, of_chars)

    return let(text.rlike("^(?=.*[0-9])(?=.*[a-f])[0-9a-f]{8,}$"), with_alphabets)


def permuted_address(ip: Column, key: str) -> Column:
    octets = F.transform(F.split(ip, r"\."), lambda o: digit(o, F.lit(256)))
    return F.array_join(feistel(octets, key, F.lit("ip")).cast("array<string>"), ".")


def parsed_date(text: Column) -> tuple[Column, Column]:
    """The date, null if there is none, and the format to write it in."""
    day = {f: F.try_to_timestamp(text, F.lit(f)).cast("date") for f in ("yyyy-MM-dd", "M/d/yyyy", "d/M/yyyy", "d.M.yyyy")}
    two = text.rlike("^[0-9]{2}[./][0-9]{2}[./]")
    slash = text.contains("/")
    us = slash & day["M/d/yyyy"].isNotNull()
    found = (
        F.when(us, day["M/d/yyyy"]).when(slash, day["d/M/yyyy"]).when(text.contains("."), day["d.M.yyyy"])
        .otherwise(day["yyyy-MM-dd"])
    )
    pick = lambda long, short: F.when(two, long).otherwise(short)
    form = (
        F.when(us, pick("MM/dd/yyyy", "M/d/yyyy")).when(slash, pick("dd/MM/yyyy", "d/M/yyyy"))
        .when(text.contains("."), pick("dd.MM.yyyy", "d.M.yyyy")).otherwise("yyyy-MM-dd")
    )
    return found, form


def permuted_date(text: Column, key: str) -> Column:
    """Another day of the same 200 years in the same format; null if the text is no such day."""
    high, low = DAY_HALVES
    first = F.lit(FIRST_DAY).cast("date")

    def other_day(number: Column) -> Column:
        digits = F.array(digit(F.floor(number / low), F.lit(high)), digit(number % low, F.lit(low)))
        return let(feistel(digits, key, F.lit("date")), lambda new: F.date_add(first, F.get(new, F.lit(0)) * low + F.get(new, F.lit(1))))

    def written(day: Column, form: Column) -> Column:
        year, month, date = (F.date_format(day, f) for f in ("yyyy", "MM", "dd"))
        short = lambda c: F.when(form.contains("MM"), c).otherwise(F.regexp_replace(c, "^0", ""))
        return (
            F.when(form.contains("-"), F.date_format(day, "yyyy-MM-dd"))
            .when(form.startswith("M"), F.concat_ws("/", short(month), short(date), year))
            .when(form.contains("/"), F.concat_ws("/", short(date), short(month), year))
            .otherwise(F.concat_ws(".", short(date), short(month), year))
        )

    found, form = parsed_date(text)
    number = F.date_diff(found, first)
    made = let(F.struct(number.alias("n"), form.alias("f")), lambda x: let(other_day(x["n"]), lambda day: written(day, x["f"])))
    return F.when(number.between(0, high * low - 1), made)


def iban_remainder(iban: Column) -> Column:
    """The checksum remainder modulo 97 of an IBAN without spaces; 1 if it is valid."""
    turned = F.split(F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4)), "")
    return F.aggregate(
        turned, F.lit(0),
        lambda r, c: F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97),
    )


def luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def kind_of(value: Column) -> Column:
    """The kind of a match by its format."""
    # The value stands alone here. A named secret is known by what stands before it, so it is what is left.
    kind = F.lit("secret")
    for name, pattern in reversed(KINDS):
        if name != "secret":
            kind = F.when(value.rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def valid_part(match: Column, kind: Column) -> Column:
    """The longest valid part from the start of a match, up to a separator or its end; null if there is none.

    An IBAN of the length of its country goes before longer ones.
    """
    digits = lambda v: F.regexp_replace(v, "[^0-9]", "")
    parts = lambda unit, seps, lengths, until="[ -]": F.array(
        *(F.regexp_extract(match, f"^{unit}(?:{seps}{unit}){{{n - 1}}}(?={until}|$)", 0) for n in lengths)
    )
    card = F.filter(parts("[0-9]", "[ -]?", range(19, 12, -1)), lambda v: (v != "") & luhn(digits(v)))
    # A dot after a number of its own may belong to an address, and +1 has eleven digits.
    phone = F.filter(parts(r"[+(]*[0-9]", r"[ .()-]*", range(15, 6, -1), " "), lambda v: (v != "") & v.rlike(f"^(?:{PHONE})$"))
    # What follows a country code may be a whole card, which is found at its own start.
    called = digits(F.regexp_replace(match, r"^\+[0-9]{1,3}[ .-]", ""))
    north = F.get(F.filter(phone, lambda v: v.rlike(r"^\+1[ .-]") & (F.length(digits(v)) == 11)), F.lit(0))
    phone = F.when(~(F.length(called).between(13, 19) & luhn(called)), F.coalesce(north, F.get(phone, F.lit(0))))
    iban = F.filter(
        parts("[A-Z0-9]", " ?", range(35, 14, -1)),
        lambda v: (v != "") & (iban_remainder(F.regexp_replace(v, " ", "")) == 1),
    )
    own = F.lit(None).cast("int")
    for length, countries in IBAN_LENGTHS.items():
        own = F.when(F.substring(match, 1, 2).isin(*countries.split()), length).otherwise(own)
    fitting = lambda found: F.coalesce(
        F.get(F.filter(found, lambda v: F.length(F.regexp_replace(v, " ", "")) == own), F.lit(0)), F.get(found, F.lit(0))
    )
    return (
        F.when(kind == "card", F.when(luhn(digits(match)), match).otherwise(F.get(card, F.lit(0))))
        .when(kind == "phone", F.when(F.length(digits(match)).between(7, 15), match).otherwise(phone))
        .when(kind == "iban", let(iban, fitting))
        .when((kind != "ip") | ~match.isin("127.0.0.1", "0.0.0.0", "255.255.255.255"), match)
    )


def pseudonym(value: Column, kind: Column, key: str) -> Column:
    """The stand-in for a value of this kind; the value itself if the kind is null or there is none.

    ``value`` and ``kind`` are plain columns or variables: they are named many times.
    """
    n = F.length(value)
    head = (
        F.when(kind == "phone", F.regexp_extract(value, r"^\+[0-9]{1,3}(?=[ .(-])", 0)).when(kind == "card", F.substring(value, 1, 1))
        .when(kind.isin("key_id", "iban"), F.substring(value, 1, 4)).otherwise("")
    )
    tail = F.when(kind == "email", F.regexp_extract(value, "@.*$", 0)).when(kind == "card", F.substring(value, n, F.lit(1))).otherwise("")

    def with_check(p: Column) -> Column:
        """Put the permuted core between head and tail, with new check digits."""
        body = F.concat(p["head"], p["core"])
        only = F.regexp_replace(body, "[^0-9]", "")
        check = let(only, lambda o: F.get(F.filter(F.sequence(F.lit(0), F.lit(9)), lambda d: luhn(F.concat(o, d.cast("string")))), F.lit(0)))
        country = F.substring(value, 1, 2)
        zeroed = F.concat(country, F.lit("00"), F.regexp_replace(p["core"], " ", ""))
        return (
            F.when(kind == "card", F.concat(body, check.cast("string")))
            .when(kind == "iban", F.concat(country, F.lpad((98 - iban_remainder(zeroed)).cast("string"), 2, "0"), p["core"]))
            .otherwise(F.concat(body, p["tail"]))
        )

    def with_core(e: Column) -> Column:
        core = F.substring(value, F.length(e["head"]) + 1, n - F.length(e["head"]) - F.length(e["tail"]))
        return let(F.struct(e["head"], permuted_text(core, key, kind).alias("core"), e["tail"]), with_check)

    new = (
        F.when(kind == "ip", permuted_address(value, key)).when(kind == "date", permuted_date(value, key))
        .when(kind.isNotNull(), let(F.struct(head.alias("head"), tail.alias("tail")), with_core))
    )
    return F.coalesce(new, value)


def pseudonymised(text: Column, key: str = TRIAL_KEY) -> Column:
    """struct(text, n_values): the text with its values replaced, and how many were."""
    # Formats are looked for at every place, also inside a match: that one may not be valid. The line end in front
    # stands for the start of the text, where split would not cut.
    searched = F.concat(F.lit("\n"), text)
    found = F.transform(
        F.regexp_extract_all(searched, F.lit(f"(?=({ANY}))"), F.lit(1)),
        lambda m: let(F.struct(m.alias("m"), kind_of(m).alias("kind")), lambda x: F.struct(valid_part(x["m"], x["kind"]).alias("old"), x["kind"])),
    )

    def step(state: Column, m: Column) -> Column:
        taken = F.when((state["left"] <= 0) & m["old"].isNotNull(), F.length(m["old"])).otherwise(state["left"])
        left = F.greatest(F.lit(0), taken - F.length(m["piece"]))
        return F.struct(left.alias("left"), F.array_append(state["all"], state["left"]).alias("all"))

    def covered(matches: Column) -> Column:
        """How many characters at each place belong to a value before it."""
        nothing = F.struct(F.lit(0).alias("left"), F.array().cast("array<int>").alias("all"))
        overlaps = F.exists(matches, lambda m: F.coalesce(F.length(m["old"]) > F.length(m["piece"]), F.lit(False)))
        return F.when(overlaps, F.aggregate(matches, nothing, step, lambda s: s["all"])).otherwise(
            F.transform(matches, lambda m: F.lit(0))
        )

    def written(m: Column, c: Column) -> Column:
        rest = lambda n: F.substr(m["piece"], n + 1)
        kept = lambda t: F.struct(t.alias("text"), F.lit(0).alias("n"))
        new = let(
            pseudonym(m["old"], m["kind"], key),
            lambda new: F.struct(F.concat(new, rest(F.length(m["old"]))).alias("text"), (new != m["old"]).cast("int").alias("n")),
        )
        return F.when(c > 0, kept(rest(c))).when(m["old"].isNotNull(), new).otherwise(kept(m["piece"]))

    def replaced(pieces: Column) -> Column:
        matches = F.zip_with(
            F.slice(pieces, 2, F.size(pieces)), found, lambda p, m: F.struct(p.alias("piece"), m["old"].alias("old"), m["kind"].alias("kind"))
        )
        told = let(matches, lambda ms: F.zip_with(ms, covered(ms), written))
        first = F.substr(F.get(pieces, F.lit(0)), F.lit(2))
        return let(told, lambda t: F.struct(
            F.concat(first, F.array_join(F.transform(t, lambda x: x["text"]), "")).alias("text"),
            F.aggregate(t, F.lit(0).cast("long"), lambda n, x: n + x["n"]).alias("n_values"),
        ))

    untouched = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n_values"))
    return F.when(text.rlike(NEEDED), let(F.split(searched, f"(?={ANY})", -1), replaced)).otherwise(untouched)


def pseudonymise(docs: DataFrame, text: str = "text", key: str = TRIAL_KEY) -> DataFrame:
    """Every row with the personal data of its text replaced, and ``n_values``, how many values were.

    Null texts stay null with 0 values, texts without valid values stay as they are. A column n_values is
    replaced, others stay; repeated rows are treated alike. Texts of any length are searched whole.
    """
    names = [c for c in docs.columns if c != "n_values"]
    found = docs.select(*names, pseudonymised(F.col(text), key).alias("pseudonyms_found"))
    return found.select(
        *(F.col("pseudonyms_found.text").alias(text) if c == text else F.col(c) for c in names),
        F.coalesce("pseudonyms_found.n_values", F.lit(0)).cast("long").alias("n_values"),
    )
