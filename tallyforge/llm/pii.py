"""Format-preserving pseudonyms for personal numbers, dates and mail names, in SQL functions only.

A value that passes its kind's validation is permuted within its format by a keyed Feistel
network: two parts take turns in adding a keyed hash of the other part, modulo the size of
their own domain. That is a permutation, so different values stay different and equal values
get equal pseudonyms in every document; separators, lengths and check digits stay valid.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import table

ROUNDS = 8
#: Dates of these years are permuted among each other: 73,049 days, the product of the two parts.
FIRST_DAY, DAYS, DATE_PARTS = "1900-01-01", 73049, (17, 4297)

_NUM = r"\p{L}\p{N}"
#: Characters of an IBAN by country, from the IBAN registry.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE",
    31: "MT SC", 32: "LC", 33: "RU",
}


def _of_length(size: int, countries: str) -> str:
    groups, rest = divmod(size - 4, 4)
    last = f" ?[A-Z0-9]{{{rest}}}" if rest else ""
    return rf"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{groups}}}{last}(?![{_NUM}])"


_MAIL = rf"[{_NUM}][{_NUM}._%+\-]*+@[A-Za-z0-9\-]{{1,63}}(?:\.[A-Za-z0-9\-]{{1,63}}){{1,8}}"
#: The length of the country, else any: a country's own length keeps a following word out.
_IBANS = (
    rf"(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join(_of_length(*x) for x in IBAN_LENGTHS.items())}"
    rf"|[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_NUM}]))"
)
_NUMBERS = (
    r"(?<!\.)[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?[0-9])"
    r"|[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![0-9])"
    r"|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}(?![0-9])"
    rf"|[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![\-{_NUM}])"
)
_LOCAL = (
    r"|\([0-9]{3}\) ?[0-9]{3}[ .\-][0-9]{4}(?![0-9])"
    r"|[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}(?![0-9])"
    r"|0[0-9](?:[ .][0-9]{2}){4}(?![0-9])"
    rf"|[0-9]{{13,19}}(?![{_NUM}])"
    rf"|[0-9]{{4}}[ \-][0-9]{{4}}[ \-][0-9]{{4}}[ \-][0-9]{{1,7}}(?![{_NUM}])"
    rf"|[0-9]{{4}}[ \-][0-9]{{6}}[ \-][0-9]{{5}}(?![{_NUM}])"
)
#: A phone ends where it has 8 to 15 digits, and before another value once it has them.
_DIALLED = r"(?<=\+" + r"[^0-9+]{0,3}[0-9]" * 8 + r"(?:[^0-9+]{0,3}[0-9])?" * 7
_PHONES = (
    r"|\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{1,4}"
    rf"(?:(?:[ \-](?!{_DIALLED}[ \-])(?:{_NUMBERS}{_LOCAL}))|\.)?[0-9]{{2,4}}){{1,4}}(?![0-9]){_DIALLED})"
)
#: What may be personal; each alternative is validated before it is replaced.
PATTERN = rf"(?<![{_NUM}])(?:{_MAIL}|{_IBANS}|{_NUMBERS}{_PHONES}{_LOCAL})"
#: The same without IBANs, for what looked like one and is none.
WITHIN = rf"(?<![{_NUM}])(?:{_MAIL}|{_NUMBERS}{_PHONES}{_LOCAL})"


def _let(value: str, name: str, body: str) -> str:
    """SQL for body with name bound to value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _hash(key: str, kind: str, i: str, other: str, modulus: str) -> str:
    digest = f"sha2(concat_ws('|', '{key}', '{kind}', {i}, {other}), 256)"
    return f"pmod(cast(conv(substr({digest}, 1, 15), 16, 10) AS bigint), {modulus})"


def _feistel(key: str, kind: str, left: str, right: str, m_left: str, m_right: str) -> str:
    """SQL for struct<l, r>: the two parts after all rounds."""
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('l', cast({left} AS bigint), 'r', cast({right} AS bigint)), (s, i) -> "
        f"if(i % 2 = 1, named_struct('l', (s.l + {_hash(key, kind, 'i', 's.r', m_left)}) % {m_left}, 'r', s.r), "
        f"named_struct('l', s.l, 'r', (s.r + {_hash(key, kind, 'i', 's.l', m_right)}) % {m_right})))"
    )


def _digits(value: str) -> str:
    return f"regexp_replace({value}, '[^0-9]', '')"


def _power(n: str) -> str:
    return f"cast(concat('1', repeat('0', {n})) AS bigint)"


def _permuted_digits(key: str, kind: str, digits: str) -> str:
    """A string of 2 to 34 digits permuted among strings of its length."""
    a, b = "(length(p) div 2)", "(length(p) - length(p) div 2)"
    moved = _feistel(key, kind, f"substr(p, 1, {a})", f"substr(p, {a} + 1)", _power(a), _power(b))
    joined = f"concat(lpad(cast(f.l AS string), {a}, '0'), lpad(cast(f.r AS string), {b}, '0'))"
    return _let(digits, "p", _let(moved, "f", joined))


def _in_format(value: str, digits: str) -> str:
    """The digits of value replaced in turn; everything else stays."""
    char = f"substr({value}, j, 1)"
    place = f"length({_digits(f'substr({value}, 1, j)')})"
    one = f"if({char} rlike '[0-9]', substr(nd, {place}, 1), {char})"
    return _let(digits, "nd", f"array_join(transform(sequence(1, length({value})), j -> {one}), '')")


def _luhn(body: str) -> str:
    """The check digit that completes a string of digits."""
    digit = "cast(substr(b, length(b) - k + 1, 1) AS int)"
    doubled = f"({digit} * 2 - if({digit} > 4, 9, 0))"
    total = f"aggregate(sequence(1, length(b)), 0, (t, k) -> t + if(k % 2 = 1, {doubled}, {digit}))"
    return _let(body, "b", f"cast((10 - {total} % 10) % 10 AS string)")


def _card(key: str) -> tuple[str, str]:
    d = _digits("m")
    valid = rf"m rlike '^[2-6][0-9 \\-]*$' AND length({d}) BETWEEN 13 AND 19 AND {_luhn(f'substr({d}, 1, length({d}) - 1)')} = substr({d}, -1)"
    moved = _permuted_digits(key, "card", f"substr({d}, 2, length({d}) - 2)")
    body = f"concat(substr({d}, 1, 1), {moved})"
    return valid, _in_format("m", _let(body, "body", f"concat(body, {_luhn('body')})"))


def _phone(key: str) -> tuple[str, str]:
    d = _digits("m")
    valid = (
        rf"(m rlike '^\\+' AND length({d}) BETWEEN 8 AND 15) "
        r"OR m rlike '^(\\([0-9]{3}\\) ?[0-9]{3}[ .\\-][0-9]{4}|[0-9]{3}[.\\-][0-9]{3}[.\\-][0-9]{4}|0[0-9]([ .][0-9]{2}){4})$'"
    )
    country = rf"if(m rlike '^\\+', if({d} rlike '^[17]', 1, 2), 0)"
    moved = _permuted_digits(key, "phone", f"substr({d}, {country} + 1)")
    return valid, _in_format("m", f"concat(substr({d}, 1, {country}), {moved})")


def _address(key: str) -> tuple[str, str]:
    octet = "cast(element_at(split(m, '[.]'), {}) AS int)"
    o = [octet.format(i) for i in (1, 2, 3, 4)]
    valid = rf"m rlike '^[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}$' AND greatest({', '.join(o)}) <= 255"
    moved = _feistel(key, "ip", f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", "65536", "65536")
    return valid, _let(moved, "f", "concat_ws('.', f.l div 256, f.l % 256, f.r div 256, f.r % 256)")


def _ssn(key: str) -> tuple[str, str]:
    area, group, serial = "cast(substr(m, 1, 3) AS int)", "cast(substr(m, 5, 2) AS int)", "cast(substr(m, 8, 4) AS int)"
    valid = (
        f"m rlike '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' AND {area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    )
    # 898 areas, 99 groups, 9,999 serials
    rank = f"({area} - 1 - if({area} > 666, 1, 0))"
    moved = _feistel(key, "ssn", f"{rank} * 99 + {group} - 1", f"{serial} - 1", "88902", "9999")
    first = "(f.l div 99 + 1 + if(f.l div 99 + 1 >= 666, 1, 0))"
    out = f"concat(lpad(cast({first} AS string), 3, '0'), '-', lpad(cast(f.l % 99 + 1 AS string), 2, '0'), '-', lpad(cast(f.r + 1 AS string), 4, '0'))"
    return valid, _let(moved, "f", out)


def _iban_check(country: str, account: str) -> str:
    """98 - (account, country, 00 with letters as 10 to 35) mod 97."""
    text = f"concat({account}, {country}, '00')"
    value = "if(c rlike '[0-9]', cast(c AS int), ascii(c) - 55)"
    rest = f"aggregate(split(x, ''), 0, (t, c) -> if(c = '', t, (t * if(c rlike '[0-9]', 10, 100) + {value}) % 97))"
    return _let(text, "x", f"lpad(cast(98 - {rest} AS string), 2, '0')")


def _iban(key: str) -> tuple[str, str]:
    flat = "replace(m, ' ', '')"
    account, country = f"substr({flat}, 5)", "substr(m, 1, 2)"
    valid = (
        rf"m rlike '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9 ]+$' AND length({flat}) BETWEEN 15 AND 34 AND length({_digits(account)}) >= 6 "
        f"AND {_iban_check(country, account)} = substr({flat}, 3, 2)"
    )
    moved = _in_format("acc", _permuted_digits(key, "iban", _digits("acc")))
    fresh = _let(account, "acc", moved)
    digits = _let(fresh, "na", f"concat({_iban_check(country, 'na')}, {_digits('na')})")
    return valid, _in_format("m", digits)


def _date(key: str) -> tuple[str, str]:
    """Year first, or day first (month first where only that is a date)."""
    piece = "cast(element_at(split(m, '[-/.]'), {}) AS int)"
    a, b, c = (piece.format(i) for i in (1, 2, 3))
    year_first = "m rlike '^[0-9]{4}[-/.]'"

    def day(y: str, mo: str, d: str) -> str:
        return f"try_to_date(concat_ws('-', lpad(cast({y} AS string), 4, '0'), lpad(cast({mo} AS string), 2, '0'), lpad(cast({d} AS string), 2, '0')), 'yyyy-MM-dd')"

    value = f"if({year_first}, {day(a, b, c)}, coalesce({day(c, b, a)}, {day(c, a, b)}))"
    month_first = f"(NOT {year_first} AND {day(c, b, a)} IS NULL)"
    number = f"datediff({value}, date'{FIRST_DAY}')"
    shape = "m rlike '^([0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})$'"
    valid = f"{shape} AND coalesce({number} BETWEEN 0 AND {DAYS - 1}, false)"
    moved = _feistel(key, "date", f"{number} div {DATE_PARTS[1]}", f"{number} % {DATE_PARTS[1]}", str(DATE_PARTS[0]), str(DATE_PARTS[1]))
    new = f"date_add(date'{FIRST_DAY}', cast(f.l * {DATE_PARTS[1]} + f.r AS int))"
    sep1, sep2 = "regexp_extract(m, '([-/.])', 1)", "regexp_extract(m, '[-/.][0-9]+([-/.])', 1)"
    y, mo, d = (f"date_format(nd, '{p}')" for p in ("yyyy", "MM", "dd"))
    out = (
        f"if({year_first}, concat({y}, {sep1}, {mo}, {sep2}, {d}), if({month_first}, concat({mo}, {sep1}, {d}, {sep2}, {y}), "
        f"concat({d}, {sep1}, {mo}, {sep2}, {y})))"
    )
    return valid, _let(moved, "f", _let(new, "nd", out))


def _mail(key: str) -> tuple[str, str]:
    """ASCII letters and digits of the name before the @ move within their class; case is kept."""
    name = "substring_index(m, '@', 1)"
    base = "if(c rlike '[0-9]', 10, if(c rlike '[A-Za-z]', 26, 1))"
    first = "if(c rlike '[0-9]', 48, if(c rlike '[a-z]', 97, if(c rlike '[A-Z]', 65, 0)))"
    chars = f"transform(sequence(1, length({name})), j -> substr({name}, j, 1))"
    cells = f"transform({chars}, c -> named_struct('c', c, 'b', {base}, 'o', {first}, 'v', if({base} = 1, 0, ascii(c) - {first})))"
    half = "(size(z) div 2)"
    other = "array_join(transform(filter(z, (x, k) -> (k < {h}) = (i % 2 = 0)), x -> cast(x.v AS string)), ',')".format(h=half)
    digest = f"sha2(concat_ws('|', '{key}', 'mail', i, {other}), 256)"
    shift = "cast(conv(substr(h, (k % 30) * 2 + 1, 4), 16, 10) AS int)"
    step = _let(
        digest,
        "h",
        f"transform(z, (x, k) -> if((k < {half}) = (i % 2 = 1), named_struct('c', x.c, 'b', x.b, 'o', x.o, 'v', (x.v + {shift}) % x.b), x))",
    )
    moved = f"aggregate(sequence(1, {ROUNDS}), {cells}, (z, i) -> {step})"
    text = f"array_join(transform({moved}, x -> if(x.b = 1, x.c, chr(x.o + x.v))), '')"
    return "m like '%@%'", f"concat({text}, substr(m, instr(m, '@')))"


def pseudonym_sql(key: str) -> str:
    """SQL for the pseudonym of m, or m itself where no kind's validation holds; what is no IBAN is searched for other kinds."""
    if "'" in key or "\\" in key:
        raise ValueError("the key may hold no quote and no backslash")
    kinds = [_mail, _address, _date, _ssn, _phone, _card, _iban]
    branches = [f"WHEN {valid} THEN {out}" for valid, out in (kind(key) for kind in kinds)]
    within = WITHIN.replace("\\", "\\\\")
    inner = f"transform(regexp_extract_all(m, '{within}', 0), m -> CASE {' '.join(branches[:-1])} ELSE m END)"
    rescanned = f"array_join(zip_with(split(m, '{within}', -1), {inner}, (gap, x) -> concat(gap, coalesce(x, ''))), '')"
    return f"CASE {' '.join(branches)} WHEN m rlike '^[A-Z]{{2}}[0-9]{{2}}' THEN {rescanned} ELSE m END"


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with personal values of text_col replaced; count_col, if named, says how many were.

    Null stays null, empty stays empty, and a text without such a value stays as it is. The domain of a mail
    address and dates before 1900 or after 2099 stay in clear. Every
    row is handled by itself, without a shuffle. A column named count_col is replaced.
    """
    text = F.col(text_col)
    quoted = PATTERN.replace("\\", "\\\\")
    hits = F.when(text.rlike("[0-9@]"), F.expr(f"regexp_extract_all(`{text_col}`, '{quoted}', 0)"))
    pairs = F.expr(f"transform(__hits, m -> named_struct('raw', m, 'out', {pseudonym_sql(key)}))")
    out = docs.withColumn("__hits", hits).withColumn("__pairs", pairs)
    rebuilt = F.expr(
        f"array_join(zip_with(split(`{text_col}`, '{quoted}', -1), __pairs, (gap, x) -> concat(gap, coalesce(x.out, ''))), '')"
    )
    changed = F.expr("size(filter(__pairs, x -> x.raw <> x.out))")
    some: Column = F.coalesce(F.size("__hits"), F.lit(0)) > 0
    out = out.withColumn("__text", F.when(some, rebuilt).otherwise(text))
    if count_col:
        out = out.withColumn(count_col, F.when(some, changed).otherwise(F.lit(0)).cast("long"))
    return out.withColumn(text_col, F.col("__text")).drop("__hits", "__pairs", "__text")


_own_keys: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key in spark.tallyforge.pseudonymKey; without that setting a random one, the same for the whole application."""
    own = _own_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))
    return spark.conf.get("spark.tallyforge.pseudonymKey", own)


def op5_feistel_pii(spark: SparkSession, sf_dir: str, key: str | None = None) -> DataFrame:
    """All documents with personal values replaced: doc_id, text, n_replaced.

    Values stay linked across all tables and runs of one key; the key is the session's where none is given.
    Null texts stay null with 0 replaced; repeated rows and null ids are kept. An empty table
    gives no rows; other columns are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, session_key(spark) if key is None else key, count_col="n_replaced")
