"""Personal data as format-preserving Feistel pseudonyms, in SQL expressions alone.

One pattern finds candidates; what a kind's rule accepts (Luhn sum of card
numbers, octets, calendar days, social security areas) is permuted by a keyed
Feistel network within its own format, anything else stays as it is:

* card: same length, separators and first digit; the last digit is the Luhn sum again
* phone: last ten digits; ssn: group and serial; ip: the 32 bits
* date: a day in the 72,900 days from 1900-01-01 (270 x 270), same notation
* email: letters and digits of the local part, run by run; the domain stays
* secret: AWS-like key ids, long hex strings and values after password/token/secret, in any case, in runs

A permutation of each format keeps distinct values distinct and depends on the
value and the key only, so equal values stay linked across documents; no join
and no shuffle takes part.

Defined results: a NULL text stays NULL with zero counts, an empty one stays
empty; repeated rows get equal pseudonyms; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabforge.llm.common import documents

ROUNDS = 8
#: fixed values: candidate patterns by kind, tried in this order at each place
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[0-9A-Fa-f]{32,64}(?![A-Za-z0-9])"
              r"|(?<=(?i:password|token|secret)[ ]{0,1}[=:][ ]{0,1}\"{0,1})[A-Za-z0-9]{8,}",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "date": r"(?<![\d-])\d{4}-\d{2}-\d{2}(?![\d-])|(?<![\d/.])\d{2}([/.])\d{2}\1\d{4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "phone": r"(?<!\d)(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\d)",
}
DAY0, SIDE = "1900-01-01", 270


def _hash(key: str, kind: str, i: Column, x: Column) -> Column:
    """A keyed 60-bit number."""
    text = F.concat_ws(":", F.lit(key), F.lit(kind), i.cast("string"), x.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: str, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """Struct (l, r): a permutation of the pairs left < left_size, right < right_size (longs)."""
    def turn(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, F.struct(((s.l + _hash(key, kind, i, s.r) % left_size) % left_size).alias("l"), s.r.alias("r"))).otherwise(
            F.struct(s.l.alias("l"), ((s.r + _hash(key, kind, i, s.l) % right_size) % right_size).alias("r")))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), turn)


def _power(base: int, n: Column) -> Column:
    """base ** n as an exact long."""
    return F.aggregate(F.array_repeat(F.lit(base), n), F.lit(1).cast("long"), lambda a, x: a * x)


def permuted(key: str, kind: str, s: Column, base: int = 10) -> Column:
    """A string of base-10 or base-36 digits (lower case, at most 20 or 22) of the same length."""
    n = F.length(s)
    a = F.floor(n / 2).cast("int")
    b = n - a

    def number(x: Column) -> Column:
        return F.coalesce(F.conv(x, base, 10).cast("long"), F.lit(0).cast("long"))

    def digits(x: Column, size: Column) -> Column:
        return F.when(size > 0, F.lpad(F.lower(F.conv(x.cast("string"), 10, base)), size, "0")).otherwise("")
    out = feistel(key, kind, number(F.substring(s, 1, a) if isinstance(a, int) else s.substr(F.lit(1), a)), number(s.substr(a + 1, b)), _power(base, a), _power(base, b))
    return F.transform(F.array(out), lambda p: F.concat(digits(p.l, a), digits(p.r, b)))[0]


def refill(m: Column, new: Column, sign: str = "[0-9]") -> Column:
    """m with its signs replaced by those of ``new`` in order; separators stay."""
    signs = F.filter(F.split(m, ""), lambda c: c != "")
    others = "[^" + sign[1:]

    def one(c: Column, i: Column) -> Column:
        seen = F.length(F.regexp_replace(m.substr(F.lit(1), i + 1), others, ""))
        return F.when(c.rlike(sign), new.substr(seen, F.lit(1))).otherwise(c)
    return F.array_join(F.transform(signs, one), "")


def luhn(digits: Column, doubled_last: bool) -> Column:
    """Luhn sum of a digit string; ``doubled_last`` where the check digit is still to come."""
    d = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")

    def add(total: Column, c: Column) -> Column:
        return total + c
    worth = F.transform(d, lambda c, i: F.when((i % 2 == 1) != F.lit(doubled_last), F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(
        c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.aggregate(worth, F.lit(0), add)


def _let(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _card(key: str, m: Column) -> Column:
    def swap(d: Column) -> Column:
        body = F.concat(d.substr(F.lit(1), F.lit(1)), permuted(key, "card", d.substr(F.lit(2), F.length(d) - 2)))
        return _let(body, lambda x: refill(m, F.concat(x, ((10 - luhn(x, True) % 10) % 10).cast("string"))))
    return _let(_digits(m), lambda d: F.when(luhn(d, False) % 10 == 0, swap(d)).otherwise(m))


def _phone(key: str, m: Column) -> Column:
    return _let(_digits(m), lambda d: refill(m, F.concat(d.substr(F.lit(1), F.length(d) - 10), permuted(key, "phone", d.substr(F.length(d) - 9, F.lit(10))))))


def _ip(key: str, m: Column) -> Column:
    p = F.split(m, r"\.")
    octet = [F.get(p, F.lit(i)).cast("int") for i in range(4)]
    pair = feistel(key, "ip", octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"))
    new = _let(pair, lambda x: F.concat_ws(".", *((v / d).cast("long") % 256 for v, d in ((x.l, 256), (x.l, 1), (x.r, 256), (x.r, 1)))))
    return F.when(F.greatest(*octet) < 256, new).otherwise(m)


def _date(key: str, m: Column) -> Column:
    iso = m.rlike(r"^\d{4}-")
    mark = m.substr(F.lit(3), F.lit(1))
    day = F.when(iso, F.try_to_timestamp(m, F.lit("yyyy-MM-dd"))).otherwise(
        F.try_to_timestamp(F.translate(m, "/.", "--"), F.lit("dd-MM-yyyy"))).cast("date")
    at = F.datediff(day, F.lit(DAY0).cast("date"))
    side = F.lit(SIDE).cast("long")

    def swap(n: Column) -> Column:
        new = _let(feistel(key, "date", (n / SIDE).cast("long"), (n % SIDE).cast("long"), side, side),
                   lambda x: F.date_add(F.lit(DAY0).cast("date"), (x.l * SIDE + x.r).cast("int")))
        return F.when(n.between(0, SIDE * SIDE - 1), _let(new, lambda d: F.when(iso, F.date_format(d, "yyyy-MM-dd")).otherwise(
            F.concat_ws("", F.date_format(d, "dd"), mark, F.date_format(d, "MM"), mark, F.date_format(d, "yyyy"))))).otherwise(m)
    return F.coalesce(_let(at, swap), m)


def _ssn(key: str, m: Column) -> Column:
    area, group, serial = (F.get(F.split(m, "-"), F.lit(i)).cast("long") for i in range(3))
    pair = feistel(key, "ssn", group - 1, serial - 1, F.lit(99).cast("long"), F.lit(9999).cast("long"))
    new = _let(pair, lambda x: F.concat_ws("-", m.substr(F.lit(1), F.lit(3)), F.lpad((x.l + 1).cast("string"), 2, "0"), F.lpad((x.r + 1).cast("string"), 4, "0")))
    return F.when((area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0), new).otherwise(m)


def _runs(key: str, kind: str, s: Column) -> Column:
    """Letters and digits of s (others stay), permuted in runs of 12 signs by their places; case by the whole."""
    plain = F.regexp_replace(F.lower(s), "[^0-9a-z]", "")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(plain) - 1) / 12).cast("int"), F.lit(0))),
                       lambda i: permuted(key, kind, plain.substr(i * 12 + 1, F.lit(12)), 36))
    return _let(F.array_join(runs, ""), lambda x: refill(s, F.when(F.upper(s) == s, F.upper(x)).otherwise(x), "[0-9A-Za-z]"))


def _email(key: str, m: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(_runs(key, "email", m.substr(F.lit(1), at - 1)), m.substr(at, F.length(m)))


def _secret(key: str, m: Column) -> Column:
    return F.when(m.startswith("AKIA"), F.concat(F.lit("AKIA"), _runs(key, "secret", m.substr(F.lit(5), F.length(m))))).otherwise(_runs(key, "secret", m))


_SWAP = {"email": _email, "secret": _secret, "ip": _ip, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


def kind_of(m: Column) -> Column:
    """Which kind of candidate a match is."""
    out = F.when(m.contains("@"), "email").when(m.rlike("^AKIA|^[0-9A-Fa-f]{32,}$|^[A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*$"), "secret")
    out = out.when(m.rlike(r"^\d+\.\d+\.\d+\.\d+$"), "ip").when(m.rlike(r"^\d{4}-\d\d-\d\d$|^\d\d([/.])\d\d\1\d{4}$"), "date")
    out = out.when(m.rlike(r"^\d{3}-\d\d-\d{4}$"), "ssn")
    return out.when(m.rlike(r"^\d(?:[ -]?\d){12,18}$"), "card").when(m.rlike(r"[ ().+-]"), "phone").otherwise("secret")


def _changed(kind: str):
    return lambda x: (x.kind == kind) & (x.new != x.old)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, the text with its pseudonyms, and how many values of each kind were swapped."""
    # groups of one kind's pattern must keep their numbers in the whole pattern
    pattern = "|".join(f"(?:{p})" for p in PATTERNS.values())
    text = F.col("text").cast("string")
    out = docs.select("doc_id", text.alias("old")).withColumn(
        "m", F.when(F.col("old").rlike("[0-9@]|AKIA|(?i:password|token|secret)"), F.regexp_extract_all("old", F.lit(pattern), F.lit(0))))

    def swap(m: Column) -> Column:
        def by_kind(k: Column) -> Column:
            new = F.when(F.lit(False), F.lit(""))
            for kind, f in _SWAP.items():
                new = new.when(k == kind, f(key, m))
            return F.struct(k.alias("kind"), m.alias("old"), new.alias("new"))
        return _let(kind_of(m), by_kind)
    out = out.withColumn("s", F.when(F.size("m") > 0, F.transform("m", swap)))
    parts = F.zip_with(F.split("old", pattern, -1), F.concat(F.transform("s", lambda x: x.new), F.array(F.lit(""))), lambda a, b: F.concat(a, b))
    counts = [F.coalesce(F.size(F.filter("s", _changed(k))), F.lit(0)).cast("long").alias(f"n_{k}") for k in _SWAP]
    counts = [F.when(F.col("s").isNull(), F.lit(0).cast("long")).otherwise(c).alias(f"n_{k}") for c, k in zip(counts, _SWAP)]
    return out.select("doc_id", F.when(F.col("s").isNull(), F.col("old")).otherwise(F.array_join(parts, "")).alias("text"), *counts)


def op9_pseudonyms(spark: SparkSession, sf: str) -> DataFrame:
    return pseudonymise(documents(spark, sf), key="example key; pass your own")


QUERIES = {"op9_pseudonyms": op9_pseudonyms}
SQL: dict[str, str] = {}
