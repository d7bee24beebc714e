"""Format-preserving Feistel pseudonyms for personal data, in SQL functions only.

One pass finds what looks like a payment card, bank account, social security number, phone number,
network address, date or e-mail address; each find is validated (check digits, ranges, calendar) and, if
valid, replaced by a keyed permutation of it within its format: a number keeps its length, separators and
a right check digit, a date stays a date, an address stays one.  The permutation is an alternating Feistel
network on Z_A x Z_B: ten rounds add a keyed hash of one half to the other, modulo its size, so it is a
bijection for any A and B, and no value has to be walked or retried.  Equal values get equal pseudonyms in
every document, and different values of a format different ones, so links between documents stay.

Everything is a projection over the text column: no shuffle, no Python.  Texts without a digit or an @ are
returned as they are.

Formats: cards of 13 to 19 digits, plain or in groups of four (Luhn; the first digit stays); bank accounts
with digits after the country code (mod 97; the country stays); numbers ddd-dd-dddd (no 000, 666, 9xx; no
00; no 0000); +1 phone numbers of ten digits; dotted quads up to 255 without leading zeros; dates
YYYY-MM-DD, DD.MM.YYYY and MM/DD/YYYY from 1900-01-01 to 2099-08-04; e-mail addresses (the local part, by
class of character; the domain stays).  What doesn't validate stays as it is.

Defined results: a null text stays null with n_private 0; an empty one stays empty; other columns pass
through whatever their names (the pseudonymised text replaces the text column); rows are independent, so
repeated rows and an empty table need no special case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Session setting that holds the secret key of the registered query and the pipeline, and the public key that
#: they take without it, for tests and checks: whoever knows the key can undo the pseudonyms.
KEY_SETTING, TEST_KEY = "spark.mnemospark.pii.key", "change-this-key"
ROUNDS = 10
#: Days from 1900-01-01 on that dates are permuted in: 270 * 270.
DAYS = 270

# What each format looks like (Java regular expressions), in order of preference.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){1,8}",
    "phone": r"(?<![\w+])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{12,32}(?![A-Za-z0-9])",
    "card": r"(?<![A-Za-z0-9_])(?<!\d[.-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?![A-Za-z0-9_]|[.-]\d)",
    "ssn": r"(?<![A-Za-z0-9_])(?<!\d[.-])\d{3}-\d{2}-\d{4}(?![A-Za-z0-9_]|[.-]\d)",
    "date": r"(?<![A-Za-z0-9_])(?<!\d[./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?!\d|[./-]\d)",
    "address": r"(?<![A-Za-z0-9_.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?![A-Za-z0-9_]|\.\d)",
}


def _any() -> str:
    """One pattern for all; the back reference of cards counts the only group."""
    return "|".join(PATTERNS.values())


def _text(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _hash(key: str, tag: str, r: str, x: str) -> str:
    """A keyed hash of x in round r, as a number below 2**60."""
    return f"CAST(conv(substr(sha2(concat({_text(key + '|')}, {tag}, '|', CAST({r} AS STRING), '|', CAST({x} AS STRING)), 256), 1, 15), 16, 10) AS BIGINT)"


def _feistel(key: str, tag: str, a: str, size_a: str, b: str, size_b: str, then: str) -> str:
    """SQL of `then` over z.a and z.b, the permuted halves of (a, b) in Z_size_a x Z_size_b."""
    step_a = f"named_struct('a', (s.a + {_hash(key, tag, 'r', 's.b')}) % {size_a}, 'b', s.b)"
    step_b = f"named_struct('a', s.a, 'b', (s.b + {_hash(key, tag, 'r', 's.a')}) % {size_b})"
    start = f"named_struct('a', CAST({a} AS BIGINT), 'b', CAST({b} AS BIGINT))"
    return f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> IF(r % 2 = 0, {step_a}, {step_b}), z -> {then})"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _refilled(m: str, digits: str) -> str:
    """m with its digits replaced, from the left, by those of the string `digits`."""
    count = f"length({_digits(f'substr({m}, 1, i)')})"
    return f"array_join(transform(sequence(1, length({m})), i -> IF(substr({m}, i, 1) RLIKE '[0-9]', substr({digits}, {count}, 1), substr({m}, i, 1))), '')"


def _luhn_sum(d: str, offset: int) -> str:
    """Sum of the digits of d, every second one doubled; offset 0: d ends with the check digit, 1: it lacks it."""
    digit = f"CAST(substr({d}, i, 1) AS INT)"
    doubled = f"({digit} * 2 - IF({digit} > 4, 9, 0))"
    return f"aggregate(sequence(1, length({d})), 0, (t, i) -> t + IF((length({d}) - i + {offset}) % 2 = 1, {doubled}, {digit}))"


def _mod97(d: str) -> str:
    return f"aggregate(sequence(1, length({d})), 0, (t, i) -> (t * 10 + CAST(substr({d}, i, 1) AS INT)) % 97)"


def _let(value: str, name: str, body: str) -> str:
    """SQL of body with name bound to value, which is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _power(n: str) -> str:
    return f"CAST(pow(10, {n}) AS BIGINT)"


def _halves(key: str, tag: str, d: str, then) -> str:
    """Permute the digit string d in two halves; then(string) is SQL over the new digits."""
    u = f"(length({d}) div 2)"
    v = f"(length({d}) - {u})"
    new = f"concat(lpad(CAST(z.a AS STRING), {u}, '0'), lpad(CAST(z.b AS STRING), {v}, '0'))"
    return _feistel(key, tag, f"substr({d}, 1, {u})", _power(u), f"substr({d}, {u} + 1)", _power(v), then(new))


def _card(m: str, key: str) -> str:
    d = "d"
    body = f"substr({d}, 2, length({d}) - 2)"
    full = lambda new: _let(f"concat(substr({d}, 1, 1), {new})", "p", f"concat(p, CAST((10 - {_luhn_sum('p', 1)} % 10) % 10 AS STRING))")
    new = _let(body, "w", _halves(key, f"concat('card', CAST(length({d}) AS STRING), substr({d}, 1, 1))", "w", full))
    return _let(_digits(m), d, f"IF({_luhn_sum(d, 0)} % 10 = 0, {_let(new, 'n', _refilled(m, 'n'))}, {m})")


def _iban(m: str, key: str) -> str:
    country = f"concat(CAST(ascii(substr({m}, 1, 1)) - 55 AS STRING), CAST(ascii(substr({m}, 2, 1)) - 55 AS STRING))"
    valid = f"{_let(f'concat(substr({m}, 5), {country}, substr({m}, 3, 2))', 'q', _mod97('q'))} = 1"
    full = lambda new: _let(new, "p", f"concat(substr({m}, 1, 2), lpad(CAST(98 - {_let(f"concat(p, {country}, '00')", 'q', _mod97('q'))} AS STRING), 2, '0'), p)")
    return f"IF({valid}, {_let(f'substr({m}, 5)', 'w', _halves(key, f"concat('iban', substr({m}, 1, 2), CAST(length({m}) AS STRING))", 'w', full))}, {m})"


def _ssn(m: str, key: str) -> str:
    area, group, serial = (f"CAST(substr({m}, {i}, {n}) AS INT)" for i, n in ((1, 3), (5, 2), (8, 4)))
    valid = f"{area} BETWEEN 1 AND 899 AND {area} <> 666 AND {group} > 0 AND {serial} > 0"
    index = f"({area} - IF({area} > 666, 2, 1)) * 99 + {group} - 1"
    back = "(z.a div 99 + IF(z.a div 99 >= 665, 2, 1))"
    new = f"concat(lpad(CAST({back} AS STRING), 3, '0'), '-', lpad(CAST(z.a % 99 + 1 AS STRING), 2, '0'), '-', lpad(CAST(z.b + 1 AS STRING), 4, '0'))"
    return f"IF({valid}, {_feistel(key, "'ssn'", index, str(898 * 99), f'{serial} - 1', '9999', new)}, {m})"


def _phone(m: str, key: str) -> str:
    """Area and exchange, and line; the country code stays."""
    new = "concat('1', lpad(CAST(z.a AS STRING), 6, '0'), lpad(CAST(z.b AS STRING), 4, '0'))"
    return _let(_let(_digits(m), "d", _feistel(key, "'phone'", "substr(d, 2, 6)", "1000000", "substr(d, 8, 4)", "10000", new)), "n", _refilled(m, "n"))


def _address(m: str, key: str) -> str:
    part = lambda i: f"CAST(q[{i}] AS INT)"
    valid = "forall(q, x -> CAST(x AS INT) <= 255 AND (length(x) = 1 OR substr(x, 1, 1) <> '0'))"
    new = "concat_ws('.', CAST(z.a div 256 AS STRING), CAST(z.a % 256 AS STRING), CAST(z.b div 256 AS STRING), CAST(z.b % 256 AS STRING))"
    return _let(f"split({m}, '[.]')", "q", f"IF({valid}, {_feistel(key, "'address'", f'{part(0)} * 256 + {part(1)}', '65536', f'{part(2)} * 256 + {part(3)}', '65536', new)}, {m})")


def _date(m: str, key: str) -> str:
    form = f"CASE WHEN substr({m}, 5, 1) = '-' THEN 'yyyy-MM-dd' WHEN substr({m}, 3, 1) = '.' THEN 'dd.MM.yyyy' ELSE 'MM/dd/yyyy' END"
    iso = f"CASE WHEN substr({m}, 5, 1) = '-' THEN {m} WHEN substr({m}, 3, 1) = '.' THEN concat(substr({m}, 7, 4), '-', substr({m}, 4, 2), '-', substr({m}, 1, 2)) ELSE concat(substr({m}, 7, 4), '-', substr({m}, 1, 2), '-', substr({m}, 4, 2)) END"
    day = f"datediff(TRY_CAST({iso} AS DATE), DATE'1900-01-01')"
    new = f"date_format(date_add(DATE'1900-01-01', CAST(z.a * {DAYS} + z.b AS INT)), {form})"
    return _let(day, "d", f"IF(d IS NOT NULL AND d BETWEEN 0 AND {DAYS * DAYS - 1}, {_feistel(key, "'date'", f'd div {DAYS}', str(DAYS), f'd % {DAYS}', str(DAYS), new)}, {m})")


def _shifted(x: str, by) -> str:
    """x with every letter and digit moved within its class; by(i) is the SQL of how far."""
    c = f"substr({x}, i, 1)"
    move = lambda base, n: f"chr(CAST({base} + (ascii({c}) - {base} + {by('i')}) % {n} AS INT))"
    return f"array_join(transform(sequence(1, length({x})), i -> CASE WHEN {c} RLIKE '[a-z]' THEN {move(97, 26)} WHEN {c} RLIKE '[A-Z]' THEN {move(65, 26)} WHEN {c} RLIKE '[0-9]' THEN {move(48, 10)} ELSE {c} END), '')"


def _email(m: str, key: str) -> str:
    """The local part in two halves of characters, each moved by a keyed hash of the other half."""
    local = f"substring_index({m}, '@', 1)"
    shape = "regexp_replace(regexp_replace(regexp_replace(w, '[a-z]', 'a'), '[A-Z]', 'A'), '[0-9]', '0')"
    moved_a = _shifted("s.a", lambda i: _hash(key, "concat('email', h)", f"concat(r, '.', {i})", "s.b"))
    moved_b = _shifted("s.b", lambda i: _hash(key, "concat('email', h)", f"concat(r, '.', {i})", "s.a"))
    empty = "length(s.a) = 0"
    step = f"IF(r % 2 = 0, named_struct('a', IF({empty}, s.a, {moved_a}), 'b', s.b), named_struct('a', s.a, 'b', {moved_b}))"
    start = "named_struct('a', substr(w, 1, length(w) div 2), 'b', substr(w, length(w) div 2 + 1))"
    new = f"aggregate(sequence(0, {ROUNDS - 1}), {start}, (s, r) -> {step}, z -> concat(z.a, z.b))"
    return _let(local, "w", _let(shape, "h", f"concat({new}, substr({m}, length(w) + 1))"))


def _pseudonym(m: str, key: str) -> str:
    """SQL of the pseudonym of the find m, told apart by the characters that it has."""
    return (
        f"CASE WHEN contains({m}, '@') THEN {_email(m, key)} WHEN startswith({m}, '+') THEN {_phone(m, key)} WHEN {m} RLIKE '^[A-Z]' THEN {_iban(m, key)} "
        f"WHEN {m} RLIKE '^[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}$' THEN {_ssn(m, key)} WHEN {m} RLIKE '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}[.][0-9]{{2}}[.][0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}})$' THEN {_date(m, key)} "
        f"WHEN contains({m}, '.') THEN {_address(m, key)} ELSE {_card(m, key)} END"
    )


def pseudonym(column: str, key: str) -> Column:
    """The pseudonym of a column that holds a single value of one of the formats; what doesn't validate stays."""
    return F.expr(f"CASE WHEN `{column}` RLIKE {_text('^(?:' + _any() + ')$')} THEN {_let(f'`{column}`', 'm', _pseudonym('m', key))} ELSE `{column}` END")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = "n_private") -> DataFrame:
    """docs with the valid finds in text_col replaced; count_col, if given, counts them. key: a secret."""
    if not key:
        raise ValueError("pseudonyms need a key")
    t, held = "`__private_text`", "__pseudonymised"  # names that no lambda variable has
    finds = f"regexp_extract_all({t}, {_text(_any())}, 0)"
    pairs = f"transform({finds}, m -> named_struct('old', m, 'new', {_pseudonym('m', key)}))"
    # what stands around the finds, and the finds' pseudonyms, in turn
    rejoined = f"array_join(zip_with(split({t}, {_text(_any())}, -1), x, (between, p) -> concat(between, coalesce(p.new, ''))), '')"
    changed = "CAST(size(filter(x, p -> p.old <> p.new)) AS INT)"
    both = f"CASE WHEN {t} RLIKE '[0-9@]' THEN transform(array({pairs}), x -> named_struct('text', {rejoined}, 'n', {changed}))[0] ELSE named_struct('text', {t}, 'n', 0) END"
    out = docs.withColumn("__private_text", F.col(f"`{text_col}`")).withColumn(held, F.expr(both))
    columns = [F.col(f"{held}.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns if c != count_col]
    return out.select(*columns, *([F.coalesce(F.col(f"{held}.n"), F.lit(0)).alias(count_col)] if count_col else []))


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, TEST_KEY)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), session_key(spark))
