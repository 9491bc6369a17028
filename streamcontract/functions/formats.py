"""`format` predicates: each as a Python function and, where a native expression says the same, as a Column."""

from __future__ import annotations

import datetime as dt
import ipaddress
import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from streamcontract.functions import ecma, idn

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = "[0-9A-Fa-f]{1,4}"
_LAST = rf"(?:{_H}:{_H}|{IPV4})"
IPV6 = "|".join([rf"(?:{_H}:){{6}}{_LAST}", rf"::(?:{_H}:){{5}}{_LAST}", *(rf"(?:(?:{_H}:){{0,{n}}}{_H})?::(?:{_H}:){{{4 - n}}}{_LAST}" for n in range(5)), rf"(?:(?:{_H}:){{0,5}}{_H})?::{_H}", rf"(?:(?:{_H}:){{0,6}}{_H})?::"])
_PCT = "%[0-9A-Fa-f]{2}"
_UNRES = r"A-Za-z0-9\-._~"
_SUB = r"!$&'()*+,;="
_PCHAR = rf"(?:[{_UNRES}{_SUB}:@]|{_PCT})"
_HOST = rf"(?:\[(?:{IPV6}|[vV][0-9A-Fa-f]+\.[{_UNRES}{_SUB}:]+)\]|(?:[{_UNRES}{_SUB}]|{_PCT})*)"
_AUTH = rf"(?:(?:[{_UNRES}{_SUB}:]|{_PCT})*@)?{_HOST}(?::[0-9]*)?"
_TAIL = rf"(?:\?(?:{_PCHAR}|[/?])*)?(?:#(?:{_PCHAR}|[/?])*)?"
URI = rf"[A-Za-z][A-Za-z0-9+\-.]*:(?://{_AUTH}(?:/{_PCHAR}*)*|/(?:{_PCHAR}+(?:/{_PCHAR}*)*)?|{_PCHAR}+(?:/{_PCHAR}*)*|){_TAIL}"
_NOCOLON = rf"(?:[{_UNRES}{_SUB}@]|{_PCT})+"
RELATIVE = rf"(?://{_AUTH}(?:/{_PCHAR}*)*|/(?:{_PCHAR}+(?:/{_PCHAR}*)*)?|{_NOCOLON}(?:/{_PCHAR}*)*|){_TAIL}"
UUID = "[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}"
POINTER = "(?:/(?:[^~/]|~[01])*)*"
RELATIVE_POINTER = rf"(?:0|[1-9][0-9]*)(?:#|{POINTER})"
_TIME = r"(?:[0-9]+H(?:[0-9]+M(?:[0-9]+(?:\.[0-9]+)?S)?)?|[0-9]+M(?:[0-9]+(?:\.[0-9]+)?S)?|[0-9]+(?:\.[0-9]+)?S)"
_DATE = r"(?:[0-9]+Y(?:[0-9]+M(?:[0-9]+D)?)?|[0-9]+M(?:[0-9]+D)?|[0-9]+D)"
DURATION = rf"P(?:[0-9]+W|{_DATE}(?:T{_TIME})?|T{_TIME})"
_VARCHAR = r"(?:[A-Za-z0-9_]|%[0-9A-Fa-f]{2})"
_VARSPEC = rf"{_VARCHAR}(?:\.?{_VARCHAR})*(?:\*|:[1-9][0-9]{{0,3}})?"
TEMPLATE = rf"(?:[^\x00-\x20\"'%<>\\^`{{|}}]|{_PCT}|\{{[+#./;?&=,!@|]?{_VARSPEC}(?:,{_VARSPEC})*\}})*"
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+"
_QUOTED = r"\"(?:[\x20\x21\x23-\x5b\x5d-\x7e]|\\[\x20-\x7e])*\""
_LDH = "[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
EMAIL = rf"(?:{_ATOM}(?:\.{_ATOM})*|{_QUOTED})@(?:{_LDH}(?:\.{_LDH})*|\[(?:{IPV4}|[Ii][Pp][Vv]6:(?:{IPV6}))\])"
DATE = "[0-9]{4}-[0-9]{2}-[0-9]{2}"
TIME = r"([01][0-9]|2[0-3]):([0-5][0-9]):([0-5][0-9]|60)(?:\.[0-9]+)?(?:[Zz]|([+-])([01][0-9]|2[0-3]):([0-5][0-9]))"
HOSTNAME = rf"(?=.{{1,253}}\z){_LDH}(?:\.{_LDH})*"


def _full(pattern: str) -> Callable[[str], bool]:
    compiled = re.compile(pattern)
    return lambda s: compiled.fullmatch(s) is not None


def date(s: str) -> bool:
    if not (s.isascii() and re.fullmatch(DATE, s)):
        return False
    try:
        dt.date.fromisoformat(s if s[:4] != "0000" else "2000" + s[4:])
    except ValueError:
        return False
    return True


def time(s: str) -> bool:
    """A leap second is 23:59:60 in UTC."""
    m = re.fullmatch(TIME, s) if s.isascii() else None
    if not m:
        return False
    if m[3] != "60":
        return True
    offset = (int(m[5]) * 60 + int(m[6])) * (1 if m[4] == "+" else -1) if m[4] else 0
    return (int(m[1]) * 60 + int(m[2]) - offset) % 1440 == 1439


def date_time(s: str) -> bool:
    return len(s) > 11 and s[10] in "Tt" and date(s[:10]) and time(s[11:])


def ipv6(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return "%" not in s


_hostname = _full(HOSTNAME.replace(r"\z", r"\Z"))


def hostname(s: str) -> bool:
    """LDH labels; where a label looks like an A-label, it must be one."""
    if any(x.lower().startswith("xn--") or x[2:4] == "--" for x in s.split(".")):
        try:
            idn.to_ascii(s)
        except idn.IdnError:
            return False
    return s.isascii() and _hostname(s)


def idn_hostname(s: str) -> bool:
    try:
        return hostname(idn.to_ascii(s)) and not s.endswith(".")
    except idn.IdnError:
        return False


def idn_email(s: str) -> bool:
    local, at, domain = s.rpartition("@")
    return bool(at) and "@" not in local and 0 < len(local) <= 64 and local[0] != "." and local[-1] != "." and ".." not in local and idn_hostname(domain)


_uri, _reference = _full(URI), _full(f"(?:{URI}|{RELATIVE})")
_BAD_IRI = re.compile(r"[\x00-\x20<>\"{}|\\^`]")


def iri(s: str) -> bool:
    return _uri(s) if s.isascii() else bool(re.match(r"[A-Za-z][A-Za-z0-9+\-.]*:", s)) and not _BAD_IRI.search(s)


def iri_reference(s: str) -> bool:
    return _reference(s) if s.isascii() else not _BAD_IRI.search(s)


FORMATS: dict[str, Callable[[str], bool]] = {
    "email": _full(EMAIL), "idn-email": idn_email, "hostname": hostname, "idn-hostname": idn_hostname,
    "uri": _uri, "uri-reference": _reference, "iri": iri, "iri-reference": iri_reference,
    "ipv4": _full(IPV4), "ipv6": ipv6, "uuid": _full(UUID), "date-time": date_time, "date": date, "time": time, "duration": _full(DURATION),
    "json-pointer": _full(POINTER), "relative-json-pointer": _full(RELATIVE_POINTER), "regex": ecma.is_valid, "uri-template": _full(TEMPLATE),
}

#: Predicates of other formats; unknown formats accept everything.
custom: dict[str, Callable[[str], bool]] = {}


def check(name: str, s: str) -> bool:
    f = FORMATS.get(name) or custom.get(name)
    return True if f is None else f(s)


def _whole(s: Column, pattern: str) -> Column:
    return s.rlike(rf"\A(?:{pattern})\z")


def date_column(s: Column) -> Column:
    y = F.when(F.substring(s, 1, 4) == "0000", F.concat(F.lit("2000"), F.substring(s, 5, 6))).otherwise(s)
    return _whole(s, DATE) & F.try_to_date(y, "yyyy-MM-dd").isNotNull()


def time_column(s: Column) -> Column:
    n = lambda i: F.regexp_extract(s, rf"\A{TIME}\z", i).try_cast("int")
    sign = F.regexp_extract(s, rf"\A{TIME}\z", 4)
    offset = F.when(sign == "", 0).otherwise((n(5) * 60 + n(6)) * F.when(sign == "+", 1).otherwise(-1))
    return _whole(s, TIME) & F.coalesce((n(3) != 60) | (F.pmod(n(1) * 60 + n(2) - offset, F.lit(1440)) == 1439), F.lit(False))


def hostname_column(s: Column) -> Column:
    """Names without A-labels; those with one are judged by `hostname`."""
    return _whole(s, HOSTNAME)


COLUMNS: dict[str, Callable[[Column], Column]] = {
    "email": lambda s: _whole(s, EMAIL), "uri": lambda s: _whole(s, URI), "uri-reference": lambda s: _whole(s, f"(?:{URI}|{RELATIVE})"),
    "ipv4": lambda s: _whole(s, IPV4), "ipv6": lambda s: _whole(s, IPV6), "uuid": lambda s: _whole(s, UUID),
    "date": date_column, "time": time_column, "date-time": lambda s: F.substring(s, 11, 1).isin("T", "t") & date_column(F.substring(s, 1, 10)) & time_column(F.substring(s, 12, 1 << 30)),
    "duration": lambda s: _whole(s, DURATION), "json-pointer": lambda s: _whole(s, POINTER), "relative-json-pointer": lambda s: _whole(s, RELATIVE_POINTER), "uri-template": lambda s: _whole(s, TEMPLATE),
}


def column(name: str, s: Column) -> Column | None:
    """Native form of a format, or None where only the Python one is right; unknown formats are true."""
    if name in COLUMNS:
        return COLUMNS[name](s)
    return None if name in FORMATS or name in custom else F.lit(True)
