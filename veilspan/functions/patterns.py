"""Fixed values of the rules, and the rules as patterns over bytes.

Possessive quantifiers (`++`, `?+`) keep a rule from giving back what it has taken. ASCII classes only: bytes of other letters are never
alphanumeric here.
"""

from __future__ import annotations

import re

# Prefixes of keys and the least length of a whole key.
KEY_PREFIXES = {
    "sk-": 20, "pk-": 20, "sk_live_": 20, "sk_test_": 20, "pk_live_": 20, "pk_test_": 20, "ghp_": 20, "gho_": 20, "ghs_": 20, "ghr_": 20, "github_pat_": 30, "AKIA": 20,
    "ABIA": 20, "ACCA": 20, "ASIA": 20, "xoxb-": 20, "xoxp-": 20, "xoxs-": 20, "xoxa-": 20, "eyJ": 30, "glpat-": 20, "npd_": 20, "Bearer ": 20,
}
# URL schemes and their labels.
SCHEMES = {
    "https://": "private_url", "http://": "private_url", "ftps://": "private_url", "ftp://": "private_url", "sftp://": "private_url", "ssh://": "private_url", "webdavs://": "private_url",
    "webdav://": "private_url", "davs://": "private_url", "dav://": "private_url", "smb://": "private_url", "nfs://": "private_url", "ldaps://": "private_url", "ldap://": "private_url",
    "vnc://": "private_url", "rdp://": "private_url", "mailto:": "private_email", "tel:": "private_phone", "s3://": "secret", "gs://": "secret",
}
# Top-level domains of bare domains.
TLDS = [
    ".com", ".net", ".org", ".edu", ".gov", ".mil", ".int", ".info", ".biz", ".name", ".pro", ".mobi", ".io", ".co", ".ai", ".de", ".jp", ".fr", ".cn", ".kr", ".ru", ".br", ".in", ".uk", ".au", ".ca", ".es",
    ".it", ".nl", ".se", ".no", ".dk", ".fi", ".pl", ".cz", ".tw", ".hk", ".sg", ".my", ".th", ".vn", ".id", ".ph", ".za", ".mx", ".ar", ".cl", ".pt", ".at", ".ch", ".be", ".ie", ".nz", ".il",
]
# Month names of long dates.
MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"]

ALNUM = "A-Za-z0-9"
HOST = r"A-Za-z0-9._\-"
URL_BODY = r"A-Za-z0-9\-._/?&=#%+:@~!(),;"
SPACE = b" \t\n\r\f\v"
YEARS, MONTHS_OF_YEAR, DAYS = range(1900, 2101), range(1, 13), range(1, 32)


def one_of(words) -> str:
    return "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True))


def compiled(pattern: str) -> re.Pattern[bytes]:
    return re.compile(pattern.encode(), re.S)


_END = rf"(?![{ALNUM}])"
INTL_PHONE = compiled(r"\+([0-9]{1,3}+)((?:[ .\-]|\([0-9]*+\)?+|[0-9]++)*+)")
#: Where digits go on behind a number: as many groups as one can have.
BOUNDED_PHONE = compiled(rf"\+[0-9]{{1,3}}(?:[ .\-]?\(?[0-9]{{1,8}}\)?){{2,5}}{_END}")
PAREN_PHONE = compiled(rf"\([0-9]{{2,4}}+\)[ \-]?+[0-9]{{3,4}}+(?![0-9])(?:[\-. ][0-9]{{3,4}}+|(?![\-. ])){_END}")
KEY = compiled(rf"({one_of(KEY_PREFIXES)})[{ALNUM}\-_.:/]*+")
LONG_DATE = compiled(rf"(?:{one_of(MONTHS)}) ([0-9]{{1,2}}+),?+ ([0-9]{{4}}){_END}")
CJK_DATE = compiled("([0-9]{4})年([0-9]{1,2}+)月([0-9]{1,2}+)日")
IPV4 = compiled(rf"([0-9]{{1,3}}+)\.([0-9]{{1,3}}+)\.([0-9]{{1,3}}+)\.([0-9]{{1,3}}+)(?![{ALNUM}.])")
EURO_DATE = compiled(rf"([0-9]{{1,2}}+)([./])([0-9]{{1,2}}+)\2([0-9]{{4}}){_END}")
SSN = compiled(rf"[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}")
NATIONAL_ID = compiled(rf"[0-9]{{17}}[0-9Xx]{_END}")
CARD = compiled(rf"[0-9]++(?:[ \-][0-9]++)*+{_END}")
EIN = compiled(rf"[0-9]{{2}}-[0-9]{{7}}{_END}")
HOUSE_NUMBER = compiled(r"[0-9]{1,5}+ ")
STATE_AND_ZIP = compiled(rf", [A-Z]{{2}} [0-9]{{5}}{_END}")
SCHEME = compiled(rf"({one_of(SCHEMES)})([{URL_BODY}]*+)")
IBAN_HEAD = compiled(r"[A-Z]{2}[0-9]{2}(?=.)")
UPPER_CODE = compiled(rf"[A-Z0-9\-]++{_END}")
HOST_RUN = compiled(rf"[{HOST}]++")
LOCAL_PART = compiled(r"[A-Za-z0-9._%+\-]*+")
DOMAIN_PART = compiled(r"[A-Za-z0-9.\-]*+")

#: The bytes at which some rule may start: signs, and starts of host runs that a rule can begin with.
VISITED = compiled(
    rf"[+(@]|(?<![{HOST}])(?:[0-9]|{one_of(KEY_PREFIXES)}|(?:{one_of(MONTHS)}) |{one_of(SCHEMES)}|[A-Z]{{2}}[0-9]{{2}}|[A-Z](?=[A-Z0-9\-]{{7}})"
    rf"|(?=[A-Za-z0-9_\-]*+\.[A-Za-z0-9_\-]*+\.)[{HOST}])"
)
