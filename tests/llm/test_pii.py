import hashlib
import random
import re
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from mnemospark.llm import pii

KEY = "k'1"


# the same networks, written independently of the SQL


def keyed(tag, r, x):
    return int(hashlib.sha256(f"{KEY}|{tag}|{r}|{x}".encode()).hexdigest()[:15], 16)


def feistel(tag, a, size_a, b, size_b):
    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = (a + keyed(tag, r, b)) % size_a
        else:
            b = (b + keyed(tag, r, a)) % size_b
    return a, b


def halves(tag, d):
    u = len(d) // 2
    v = len(d) - u
    a, b = feistel(tag, int(d[:u]), 10**u, int(d[u:]), 10**v)
    return f"{a:0{u}d}{b:0{v}d}"


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 * (x > 9)
    return t % 10


def refill(m, digits):
    it = iter(digits)
    return re.sub("[0-9]", lambda _: next(it), m)


def card(m):
    d = re.sub("[^0-9]", "", m)
    if luhn(d):
        return m
    p = d[0] + halves(f"card{len(d)}{d[0]}", d[1:-1])
    return refill(m, p + str(-luhn(p + "0") % 10))


def mod97(m):
    return int("".join(str(int(c, 36)) for c in m[4:] + m[:4])) % 97


def iban(m):
    if mod97(m) != 1:
        return m
    p = halves(f"iban{m[:2]}{len(m)}", m[4:])
    return f"{m[:2]}{98 - mod97(m[:2] + '00' + p):02d}{p}"


def ssn(m):
    area, group, serial = map(int, m.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return m
    areas = [x for x in range(1, 900) if x != 666]
    a, b = feistel("ssn", areas.index(area) * 99 + group - 1, 898 * 99, serial - 1, 9999)
    return f"{areas[a // 99]:03d}-{a % 99 + 1:02d}-{b + 1:04d}"


def phone(m):
    d = re.sub("[^0-9]", "", m)
    a, b = feistel("phone", int(d[1:7]), 10**6, int(d[7:]), 10**4)
    return refill(m, f"1{a:06d}{b:04d}")


def address(m):
    q = m.split(".")
    if any(int(x) > 255 or (len(x) > 1 and x[0] == "0") for x in q):
        return m
    q = list(map(int, q))
    a, b = feistel("address", q[0] * 256 + q[1], 65536, q[2] * 256 + q[3], 65536)
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def day(m):
    form = "%Y-%m-%d" if m[4] == "-" else "%d.%m.%Y" if m[2] == "." else "%m/%d/%Y"
    y, mo, d = (m[:4], m[5:7], m[8:]) if m[4] == "-" else (m[6:], m[3:5], m[:2]) if m[2] == "." else (m[6:], m[:2], m[3:5])
    try:
        n = (date(int(y), int(mo), int(d)) - date(1900, 1, 1)).days
    except ValueError:
        return m
    if not 0 <= n < 270 * 270:
        return m
    a, b = feistel("date", n // 270, 270, n % 270, 270)
    return (date(1900, 1, 1) + timedelta(a * 270 + b)).strftime(form)


def email(m):
    local, _, rest = m.partition("@")
    shape = re.sub("[0-9]", "0", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", local)))
    a, b = local[: len(local) // 2], local[len(local) // 2 :]

    def moved(x, other, r):
        out = ""
        for i, c in enumerate(x, 1):
            for lo, n in (("a", 26), ("A", 26), ("0", 10)):
                if ord(lo) <= ord(c) < ord(lo) + n:
                    c = chr(ord(lo) + (ord(c) - ord(lo) + keyed("email" + shape, f"{r}.{i}", other)) % n)
                    break
            out += c
        return out

    for r in range(pii.ROUNDS):
        if r % 2 == 0:
            a = moved(a, b, r)
        else:
            b = moved(b, a, r)
    return f"{a}{b}@{rest}"


KINDS = {"email": email, "phone": phone, "iban": iban, "card": card, "ssn": ssn, "date": day, "address": address}


def brute(text):
    if text is None:
        return None, 0
    named = "|".join(f"(?P<{k}>{p.replace('([ -])', '(?P<sep>[ -])').replace(chr(92) + '1', '(?P=sep)')})" for k, p in pii.PATTERNS.items())
    n = 0

    def one(m):
        nonlocal n
        kind = next(k for k in KINDS if m[k] is not None)
        new = KINDS[kind](m[0])
        n += new != m[0]
        return new

    return re.sub(named, one, text, flags=re.ASCII), n


def valid_card(rng, n):
    p = "".join(str(rng.randrange(10)) for _ in range(n - 1))
    return p + str(-luhn(p + "0") % 10)


def values(rng):
    c = valid_card(rng, rng.choice([13, 14, 15, 16, 16, 19]))
    g = valid_card(rng, 16)
    sep = rng.choice(" -")
    bban = "".join(str(rng.randrange(10)) for _ in range(rng.choice([10, 18, 23])))
    cc = rng.choice(["DE", "ES", "FR"])
    return rng.choice([
        c, sep.join(g[i : i + 4] for i in (0, 4, 8, 12)), str(rng.randrange(10**15, 10**16)), f"+1 ({rng.randrange(1000):03d}) 555-{rng.randrange(10**4):04d}", f"+1{rng.randrange(10**9, 10**10)}",
        f"{cc}{98 - mod97(cc + '00' + bban):02d}{bban}", f"{cc}11{bban}", f"{rng.randrange(1000):03d}-{rng.randrange(100):02d}-{rng.randrange(10**4):04d}",
        f"{rng.randrange(1880, 2110)}-{rng.randrange(14):02d}-{rng.randrange(33):02d}", f"{rng.randrange(33):02d}.{rng.randrange(14):02d}.{rng.randrange(1890, 2100)}", f"{rng.randrange(14):02d}/{rng.randrange(33):02d}/{rng.randrange(1890, 2100)}",
        ".".join(str(rng.randrange(300)) for _ in range(4)), f"{rng.choice(['ann.lee', 'X', 'a1', 'Bob_99', 'zoë'])}@mail{rng.randrange(9)}.example.com", "2.0.", "1.2.3.4.5", "a@b", "+1 (12) 5", "12345678901234567890",
    ])


def test_equals_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["", " ", "\n", "é", "(", "x ", ", "]) + values(rng) + rng.choice(["", " ", ".", "!!", "###", " und ", "x"]) for _ in range(rng.randint(0, 8))) for _ in range(300)]
    texts += [None, "", " ", "no numbers here", "@", "9" * 100_000, "a.b@" * 20_000, ("w " * 20_000) + "4111 1111 1111 1111", "4111111111111111", "192.168.0.1"]
    docs = spark.createDataFrame([(i, t, "keep", 3, 1) for i, t in enumerate(texts)], "doc_id long, text string, m string, x int, n_private int")
    out = {r.doc_id: r for r in pii.pseudonymise(docs, KEY).collect()}
    for i, t in enumerate(texts):
        want, n = brute(t)
        assert (out[i].text, out[i].n_private) == (want, n), t
        assert (out[i].m, out[i].x) == ("keep", 3)
    assert sum(r.n_private for r in out.values()) > 200


@pytest.mark.parametrize("kind", ["date", "ssn", "email", "address"])
def test_is_a_permutation_within_the_format(spark, kind):
    if kind == "date":
        every = spark.range(72900).select(F.expr("date_format(date_add(DATE'1900-01-01', CAST(id AS INT)), 'yyyy-MM-dd')").alias("d"))
    elif kind == "ssn":
        every = spark.range(1, 900).where("id <> 666").select(F.format_string("%03d-07-0001", "id").alias("d"))
    elif kind == "email":
        every = spark.range(2600).select(F.expr("concat(chr(97 + id % 26), id div 26 % 10, id div 260, '@x.org')").alias("d"))
    else:
        every = spark.range(256 * 40).select(F.expr("concat('10.0.', id div 256, '.', id % 256)").alias("d"))
    out = every.select("d", pii.pseudonym("d", KEY).alias("p"))
    n = every.distinct().count()
    assert out.select("p").distinct().count() == n
    assert out.where("d = p").count() < n / 50
    if kind == "date":
        assert out.join(every.withColumnRenamed("d", "e"), F.col("p") == F.col("e"), "left_anti").count() == 0


def test_no_python_and_no_shuffle(spark, capsys):
    pii.pseudonymise(spark.createDataFrame([(1, "a")], "doc_id long, text string"), KEY).explain()
    plan = capsys.readouterr().out
    assert "Python" not in plan and "Exchange" not in plan
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string"), KEY).count() == 0


def test_the_key(spark, tmp_path):
    docs = spark.createDataFrame([(1, "card 4111111111111111")], "doc_id long, text string")
    with pytest.raises(ValueError):
        pii.pseudonymise(docs, "")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    plain = pii.op5_pii(spark, str(tmp_path)).first().text
    spark.conf.set(pii.KEY_SETTING, "secret")
    try:
        own = pii.op5_pii(spark, str(tmp_path)).first().text
    finally:
        spark.conf.unset(pii.KEY_SETTING)
    assert own == pii.pseudonymise(docs, "secret").first().text != plain == pii.pseudonymise(docs, pii.TEST_KEY).first().text
