"""Single rules as regular expressions that Java and RE2 read alike, for plain SQL: group 1 is the value.

They are written apart from the scan, which they check, and use up the byte after a value: a value right behind another one of its rule is missed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .patterns import KEY_PREFIXES, MONTHS, SCHEMES, TLDS

_LEFT, _RIGHT = r"(?:^|[^A-Za-z0-9._-])", r"(?:[^A-Za-z0-9]|\z)"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_YEAR, _MONTH, _DAY = r"(?:19[0-9][0-9]|20[0-9][0-9]|2100)", r"(?:1[0-2]|0?[1-9])", r"(?:3[01]|[12][0-9]|0?[1-9])"


def _any(words) -> str:
    return "(?:" + "|".join(w.replace(".", r"\.") for w in words) + ")"


#: name: label, pattern
SQL_RULES = {
    "ip": ("secret", rf"{_LEFT}({_OCTET}(?:\.{_OCTET}){{3}})(?:[^A-Za-z0-9.]|\z)"),
    "email": ("private_email", r"(?:^|[^A-Za-z0-9._%+-])([A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z0-9]{2,})"),
    "intl_phone": ("private_phone", rf"(?:^|[^A-Za-z0-9])(\+[0-9]{{1,3}}(?:[ .-]?\(?[0-9]{{1,8}}\)?){{2,5}}){_RIGHT}"),
    "paren_phone": ("private_phone", rf"(?:^|[^A-Za-z0-9])(\([0-9]{{2,4}}\)[ -]?[0-9]{{3,4}}[-. ][0-9]{{3,4}}){_RIGHT}"),
    "upper_code": ("account_number", rf"{_LEFT}([A-Z]{{8,11}}|[A-Z]{{6,9}}[0-9]{{2,3}}|[A-Z]{{2,}}[0-9]{{2,}}(?:-[A-Z0-9]{{2,}})+)(?:[^A-Za-z0-9-]|\z)"),
    "ssn": ("account_number", rf"{_LEFT}([0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}){_RIGHT}"),
    "cn_id": ("account_number", rf"{_LEFT}([0-9]{{17}}[0-9Xx]){_RIGHT}"),
    "card": ("account_number", rf"{_LEFT}([0-9]{{4}}(?:[ -][0-9]{{4}}){{3}}|3[47][0-9]{{2}}[ -][0-9]{{6}}[ -][0-9]{{5}}){_RIGHT}"),
    "iban": ("account_number", rf"{_LEFT}([A-Z]{{2}}[0-9]{{2}}(?: [A-Z0-9]{{4}}){{3,7}}(?: [A-Z0-9]{{1,3}})?){_RIGHT}"),
    "ein": ("account_number", rf"{_LEFT}([0-9]{{2}}-[0-9]{{7}}){_RIGHT}"),
    "api_key": ("secret", rf"{_LEFT}({'|'.join(f'{k}[A-Za-z0-9_.:/-]{{{n - len(k)},}}' for k, n in KEY_PREFIXES.items())})"),
    **{name: (label, rf"{_LEFT}({_any(s for s, own in SCHEMES.items() if own == label)}[A-Za-z0-9._/?&=#%+:@~!(),;-]*[A-Za-z0-9_/?&=#%+:@~!(-])") for name, label in (("scheme_url", "private_url"), ("scheme_secret", "secret"), ("scheme_phone", "private_phone"))},
    "bare_domain": ("private_url", rf"{_LEFT}([A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)+{_any(TLDS)})(?:[^A-Za-z0-9._-]|\z)"),
    "long_date": ("private_date", rf"(?:^|[^A-Za-z0-9])({_any(MONTHS)} {_DAY},? {_YEAR}){_RIGHT}"),
    "cjk_date": ("private_date", rf"(?:^|[^0-9])({_YEAR}年{_MONTH}月{_DAY}日)"),
    "euro_date": ("private_date", rf"{_LEFT}({_DAY}\.{_MONTH}\.{_YEAR}|{_DAY}/{_MONTH}/{_YEAR}){_RIGHT}"),
    "address": ("private_address", rf"{_LEFT}([0-9]{{1,5}} [^\n]{{1,200}}?, [A-Z]{{2}} [0-9]{{5}}){_RIGHT}"),
}


#: What a text has if it has a value of a rule: a quick look that spares most texts the rule's own pattern, which tries each place.
_HAS = {
    "ip": r"[0-9]\.[0-9]{1,3}\.[0-9]",
    "email": "@",
    "intl_phone": r"\+[0-9]",
    "paren_phone": r"\([0-9]{2}",
    "upper_code": r"[A-Z]{2}[A-Z0-9]{2}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]",
    "cn_id": r"[0-9]{17}",
    "card": r"[0-9]{4}[ -][0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2} ",
    "ein": r"[0-9]-[0-9]{7}",
    "scheme_url": "://",
    "scheme_secret": "[3s]://",
    "scheme_phone": "tel:",
    "bare_domain": r"\.[A-Za-z0-9_-]+\.",
    "long_date": "[a-z] [0-9]",
    "cjk_date": "年",
    "euro_date": r"[0-9][./][0-9]{1,2}[./][0-9]{4}",
    "address": r", [A-Z]{2} [0-9]{5}",
}


def may_have(text: Column, name: str) -> Column:
    """Whether a text may have a value of a rule; false only if it has none."""
    if name == "api_key":
        return reduce(Column.__or__, (text.contains(k) for k in KEY_PREFIXES))
    return text.rlike(_HAS[name])


def rule_values(text: Column, name: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(~may_have(text, name), none).otherwise(F.regexp_extract_all(text, F.lit(SQL_RULES[name][1]), F.lit(1)))


def rule_hits(texts: DataFrame, names=tuple(SQL_RULES), text: str = "text", of: dict[str, str] | None = None) -> DataFrame:
    """texts without the text, a row per value: rule, label, value. of: the columns that single rules read instead, which go too."""
    of = of or {}
    kept = [c for c in texts.columns if c != text and c not in of.values()]

    def hits(name: str) -> Column:
        found = rule_values(F.col(of.get(name, text)), name)
        return F.transform(found, lambda v: F.struct(F.lit(name).alias("rule"), F.lit(SQL_RULES[name][0]).alias("label"), v.alias("value")))

    return texts.select(*kept, F.explode(F.concat(*[hits(n) for n in names])).alias("hit")).select(*kept, "hit.*")
