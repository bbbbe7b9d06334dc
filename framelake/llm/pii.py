"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

Cards, phone numbers, social security numbers, IPv4 addresses and dates are
validated and then permuted among the values of their format, so a pseudonym is
valid again and equal values get equal pseudonyms in every document. Addresses
of mail and quoted secrets are permuted letter by letter within the classes of
their characters. All work is in SQL functions on the row that holds the text.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rounds of the Feistel network.
ROUNDS = 8

#: What may stand before a digit of a phone number: a parenthesis or one sign behind the country code,
#: the end of the parenthesis, or one sign before a group of two digits or more that doesn't begin a date.
PHONE_GAP = r"(?:(?<=\+\d{1,3})[ .-]?(?:\((?=\d{1,4}\)))?|(?<=\(\d{1,4})\)[ .-]?|[ .-](?=\d\d)(?!\d{4}-\d\d-\d\d(?!\d)|\d\d[./]\d\d[./]\d{4}(?!\d))|)"

#: Country codes of one and two digits; all others have three, and none begins with another.
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"

#: What each kind looks like. The first kind that fits at a place counts.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<=(?i:token|secret|password|api_key|apikey)\s{0,2}[=:]\s{0,2}[\"'])[0-9A-Za-z_-]{16,}+(?=[\"'])",
    "phone": rf"(?<![\p{{L}}\p{{N}}])\+(?:\d(?:{PHONE_GAP}\d){{6,14}}|\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)|\d{{2,4}})(?:[ .-]?\d{{2,4}}){{2,3}})(?!\d)",
    "ip": r"(?<![\p{L}\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "ssn": r"(?<![\p{L}\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "date": r"(?<![\p{L}\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d/-])",
    "card": r"(?<![\p{L}\d])(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5})(?!\d)",
}
ANY = "|".join(PATTERNS.values())

#: A text without any of these holds nothing to look for; of all kinds only a secret can be without the first two.
HINT = r"[0-9@]|(?i:token|secret|password|api_key|apikey)\s{0,2}[=:]"

#: Days from FIRST_DAY on, as DATE_LEFT * DATE_RIGHT; they stay among themselves.
FIRST_DAY, DATE_LEFT, DATE_RIGHT = "1900-01-01", 270, 271

#: All other days of years of four digits, as FAR_LEFT * FAR_RIGHT.
FAR_DAY, DAYS_BEFORE, FAR_LEFT, FAR_RIGHT = "0000-01-01", 693_961, 135, 26_513

#: Valid areas (001-899 without 666), groups and serial numbers.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is worked out once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


class Pseudonyms:
    """SQL for the pseudonym of one match; the key enters through its hash."""

    def __init__(self, key: str):
        self.key = hashlib.sha256(key.encode()).hexdigest()

    def _hash(self, kind: str, round_: str, half: str, bits: int = 256) -> str:
        return f"sha2(concat_ws('|', '{self.key}', '{kind}', {round_}, {half}), {bits})"

    def numbers(self, kind: str, left: str, right: str, a: str, b: str) -> str:
        """A struct (l, r) permuted among l < a and r < b, half by half in turns."""

        def moved(half: str, other: str, size: str) -> str:
            return f"pmod(s.{half} + cast(conv(substring({self._hash(kind, 'i', f's.{other}')}, 1, 15), 16, 10) as bigint), {size})"

        step = f"named_struct('l', if(i % 2 = 0, {moved('l', 'r', a)}, s.l), 'r', if(i % 2 = 1, {moved('r', 'l', b)}, s.r))"
        return f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', cast({left} as bigint), 'r', cast({right} as bigint)), (s, i) -> {step})"

    def digits(self, kind: str, digits: str) -> str:
        """A run of digits permuted among all of its length."""
        n, half = f"length({digits})", f"(length({digits}) div 2)"
        size = lambda k: f"cast(rpad('1', 1 + {k}, '0') as bigint)"
        whole = self.numbers(kind, f"substring({digits}, 1, {half})", f"substring({digits}, 1 + {half}, {n})", size(half), size(f"{n} - {half}"))
        return _let(whole, "p", f"concat(lpad(p.l, {half}, '0'), lpad(p.r, {n} - {half}, '0'))")

    def letters(self, kind: str, text: str, alphabets: list[str]) -> str:
        """A text permuted among those with characters of the same alphabets in the same places."""

        def moved(half: str, other: str) -> str:
            by = "cast(conv(substring(h, 1 + pmod(2 * k, 128), 2), 16, 10) as int)"
            cases = " ".join(f"when locate(c, '{x}') > 0 then substring('{x}', 1 + pmod(locate(c, '{x}') - 1 + {by}, {len(x)}), 1)" for x in alphabets)
            shifted = f"array_join(transform(split(s.{half}, ''), (c, k) -> case when c = '' then c {cases} else c end), '')"
            return _let(self._hash(kind, "i", f"s.{other}", 512), "h", shifted)

        half = f"(length({text}) div 2)"
        step = f"named_struct('l', if(i % 2 = 0, {moved('l', 'r')}, s.l), 'r', if(i % 2 = 1, {moved('r', 'l')}, s.r))"
        whole = f"aggregate(sequence(0, {ROUNDS - 1}), named_struct('l', substring({text}, 1, {half}), 'r', substring({text}, 1 + {half}, length({text}))), (s, i) -> {step})"
        return _let(whole, "w", "concat(w.l, w.r)")

    @staticmethod
    def laid_out(value: str, digits: str) -> str:
        """``value`` with its digits replaced in turn by ``digits``."""
        seen = f"length(regexp_replace(substring({value}, 1, k + 1), '[^0-9]', ''))"
        return f"array_join(transform(split({value}, ''), (c, k) -> if(c rlike '[0-9]', substring({digits}, {seen}, 1), c)), '')"

    @staticmethod
    def luhn(digits: str, shift: int) -> str:
        """Luhn sum of digits; ``shift`` 0 doubles the last digit, 1 the one before it."""
        d = f"cast(substring({digits}, length({digits}) + 1 - j, 1) as int)"
        return f"aggregate(sequence(1, length({digits})), 0L, (t, j) -> t + if((j + {shift}) % 2 = 1, (2 * {d}) div 10 + (2 * {d}) % 10, {d}))"

    def card(self, m: str) -> str:
        body = self.digits("card", "substring(d, 1, length(d) - 1)")
        check = _let(body, "q", f"concat(q, pmod(10 - {self.luhn('q', 0)} % 10, 10))")
        valid = f"{self.luhn('d', 1)} % 10 = 0"
        return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", f"if({valid}, {_let(check, 'z', self.laid_out(m, 'z'))}, {m})")

    def phone(self, m: str) -> str:
        """The country code stays; it is read off the digits, so a number has one pseudonym however it is spaced."""
        new = self.digits("phone", "substring(d, 1 + length(cc), length(d))")
        whole = _let(f"regexp_extract(d, {_quoted(COUNTRY_CODE)}, 0)", "cc", _let(f"concat(cc, {new})", "z", self.laid_out(m, "z")))
        return _let(f"regexp_replace({m}, '[^0-9]', '')", "d", whole)

    def ip(self, m: str) -> str:
        octet = lambda k: f"cast(o[{k}] as int)"
        moved = self.numbers("ip", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536")
        new = _let(moved, "p", "concat_ws('.', p.l div 256, p.l % 256, p.r div 256, p.r % 256)")
        return _let(f"split({m}, '[.]')", "o", f"if(forall(o, x -> cast(x as int) <= 255), {new}, {m})")

    def ssn(self, m: str) -> str:
        area, group, serial = (f"cast(o[{k}] as int)" for k in range(3))
        index = f"({area} - if({area} > 666, 2, 1))"
        moved = self.numbers("ssn", f"{index} * {SSN_GROUPS} + {group} - 1", f"{serial} - 1", str(SSN_AREAS * SSN_GROUPS), str(SSN_SERIALS))
        back = f"(p.l div {SSN_GROUPS})"
        new = _let(moved, "p", f"concat_ws('-', lpad({back} + if({back} >= 665, 2, 1), 3, '0'), lpad(p.l % {SSN_GROUPS} + 1, 2, '0'), lpad(p.r + 1, 4, '0'))")
        valid = f"{area} between 1 and 899 and {area} <> 666 and {group} > 0 and {serial} > 0"
        return _let(f"split({m}, '-')", "o", f"if({valid}, {new}, {m})")

    def date(self, m: str) -> str:
        """Days before months with points; with slashes months first, unless that is no date."""
        formats = f"case when {m} like '%-%' then array('yyyy-MM-dd') when {m} like '%.%' then array('dd.MM.yyyy') else array('MM/dd/yyyy', 'dd/MM/yyyy') end"
        order = f"filter({formats}, x -> date_format(try_to_timestamp({m}, x), x) = {m})"
        day = f"datediff(cast(try_to_timestamp({m}, f) as date), date'{FIRST_DAY}')"
        moved = self.numbers("date", f"n div {DATE_RIGHT}", f"n % {DATE_RIGHT}", str(DATE_LEFT), str(DATE_RIGHT))
        new = _let(moved, "p", f"date_format(date_add(date'{FIRST_DAY}', cast(p.l * {DATE_RIGHT} + p.r as int)), f)")
        days = DATE_LEFT * DATE_RIGHT
        # Other days are counted without those of the range, and the range is put back.
        index = f"(n + {DAYS_BEFORE} - if(n < 0, 0, {days}))"
        far = self.numbers("far date", f"{index} div {FAR_RIGHT}", f"{index} % {FAR_RIGHT}", str(FAR_LEFT), str(FAR_RIGHT))
        place = f"(p.l * {FAR_RIGHT} + p.r)"
        other = _let(far, "p", f"date_format(date_add(date'{FAR_DAY}', cast({place} + if({place} < {DAYS_BEFORE}, 0, {days}) as int)), f)")
        inside = _let(day, "n", f"if(n between 0 and {days - 1}, {new}, {other})")
        return _let(f"try_element_at({order}, 1)", "f", f"if(f is null, {m}, {inside})")

    def email(self, m: str) -> str:
        """The domain stays."""
        local = f"substring_index({m}, '@', 1)"
        return f"concat({self.letters('email', local, CLASSES)}, '@', substring_index({m}, '@', -1))"

    def secret(self, m: str) -> str:
        small, capital = (self.letters("hex", m, [x]) for x in ("0123456789abcdef", "0123456789ABCDEF"))
        return f"case when {m} rlike '^[0-9a-f]+$' then {small} when {m} rlike '^[0-9A-F]+$' then {capital} else {self.letters('secret', m, CLASSES)} end"

    def of(self, m: str) -> str:
        """The pseudonym of a match of ANY; what isn't valid stays as it is."""
        whole = {k: f"{m} rlike {_quoted('^(?:' + WHOLE[k] + ')$')}" for k in WHOLE}
        cases = " ".join(f"when {whole[k]} then {getattr(self, k)(m)}" for k in WHOLE)
        return f"case when {m} like '%@%' then {self.email(m)} {cases} else {self.secret(m)} end"


#: Alphabets whose characters stand for each other.
CLASSES = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]

#: How a match of the kinds of numbers is told from the others once it is cut out; secrets are what is left.
WHOLE = {
    "phone": r"\+[0-9 .()-]+",
    "ip": r"\d{1,3}(?:\.\d{1,3}){3}",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "date": r"\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4}",
    "card": r"\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{4,5}",
}


def pseudonymize(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, and pii_count int, how many values were changed.

    A null text stays null and counts none; an empty one too. Texts are read
    whole; repeated rows and ties do not matter, as rows are not compared; an
    empty table stays empty; other columns stay, and a pii_count is replaced.
    """
    others = [c for c in docs.columns if c.lower() != "pii_count"]
    hit = F.expr(f"if(text rlike {_quoted(HINT)}, regexp_extract_all(text, {_quoted(ANY)}, 0), array())")
    found = docs.select(*[F.col(f"`{c}`") for c in others], hit.alias("_fl_found"))
    found = found.withColumn("_fl_new", F.expr(f"transform(_fl_found, m -> {Pseudonyms(key).of('m')})"))
    gaps = f"split(text, {_quoted(ANY)}, -1)"
    joined = _let(gaps, "g", "concat(g[0], array_join(zip_with(_fl_new, slice(g, 2, size(_fl_new)), (n, x) -> concat(n, x)), ''))")
    text = F.expr(f"if(coalesce(size(_fl_found), 0) > 0, {joined}, text)")
    count = F.expr("coalesce(aggregate(zip_with(_fl_found, _fl_new, (m, n) -> if(m = n, 0, 1)), 0, (t, x) -> t + x), 0)")
    return found.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in others], count.cast("int").alias("pii_count"))
