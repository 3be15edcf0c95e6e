"""Functions of e-mail addresses and telephone numbers, as column expressions. Nulls give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions import urls
from pagemill.functions.tables import COUNTRY_CODES, DATE_PREFIX, EMAIL, LEGAL_PATHS, PHONE, SHARE_MARKS


def emails_in(text: Column) -> Column:
    """All e-mail addresses of a text, in order."""
    return F.regexp_extract_all(text, F.lit(EMAIL), F.lit(0))


def phones_in(text: Column) -> Column:
    """All candidates of telephone numbers in a text, brackets repaired, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(PHONE), F.lit(0)), balance_brackets)


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def digits(text: Column) -> Column:
    """A text's ASCII digits."""
    return F.regexp_replace(text, "[^0-9]", "")


def looks_like_phone(number: Column) -> Column:
    """Whether a candidate is a telephone number rather than a date, a stamp, a product number or a filler."""
    s = F.trim(number)
    d, dots, spaces, dashes = digits(s), _count(s, "."), _count(s, " "), _count(s, "-")
    groups = F.size(F.regexp_extract_all(s, F.lit("[0-9]+"), F.lit(0)))
    plus = s.startswith("+")
    triples = "(?:" + "|".join(str(k) * 3 for k in range(10)) + "){3}"
    return (
        ~s.rlike(DATE_PREFIX) & ~s.rlike(r"^(19|20)\d\d(\D|$)") & ~s.rlike(r"[\n\r]") & F.length(d).between(9, 15) & ~s.rlike(r"^1[5-9]\d{8}$") & ~F.contains(s, F.lit("  "))
        & ((dots <= 1) | s.rlike(r"^[0-9.+\s]*$")) & ~((dots > 0) & (dashes > 0)) & ~((dots > 0) & (spaces > 0) & ~plus) & ~s.rlike(r"\d\D+\d(\D|$)") & ~d.rlike(triples)
        & (groups <= F.when((dots >= 3) & (spaces == 0) & (dashes == 0), 5).otherwise(4)) & (plus | s.rlike(r"[ \-().]"))
    )


def balance_brackets(number: Column) -> Column:
    """A number without brackets that have no partner; ``(`` is put back before an area code of three digits."""
    s = F.trim(number)
    more = _count(s, ")") - _count(s, "(")
    left = F.trim(F.regexp_replace(s, r"^[\s)]+", ""))
    area = F.regexp_extract(left, r"^([0-9\s]*)\)", 1)
    closed = F.when(F.contains(left, F.lit(")")) & (F.length(digits(area)) == 3), F.concat(F.lit("("), left)).otherwise(left)
    return F.when(more == 0, s).when(more > 0, closed).otherwise(F.trim(F.regexp_replace(s, r"[\s(]+$", "")))


def canonical_digits(number: Column) -> Column:
    """The digits of a number without its country code, for comparison."""
    d = digits(number)

    codes = F.array(*(F.lit(c) for c in COUNTRY_CODES))

    def without_code(rest: Column) -> Column:
        code = F.get(F.filter(codes, lambda c: F.startswith(rest, c) & (F.length(rest) - F.length(c) >= 7)), F.lit(0))
        return F.substring(rest, F.length(code) + 1, F.length(rest))

    plus = F.coalesce(without_code(d), F.when(F.length(d) >= 11, F.substring(d, F.lit(2), F.length(d))), d)
    zeros = F.when(d.startswith("00"), without_code(F.substring(d, F.lit(3), F.length(d))))
    return F.when(F.trim(number).startswith("+"), plus).otherwise(F.coalesce(zeros, F.when((F.length(d) == 11) & d.startswith("1"), F.substring(d, F.lit(2), F.length(d))), d))


def decode_mail(text: Column) -> Column:
    """A mail link's address with its common escapes undone; escaped spaces are dropped."""
    for code, char in (("40", "@"), ("2B", "+"), ("2E", "."), ("2D", "-"), ("5F", "_"), ("20", ""), ("2F", "/")):
        text = F.regexp_replace(text, f"(?i)%{code}", char)
    return text


def of_site(email: Column, url: Column) -> Column:
    """Whether an address is at the site's own host, above or below it; true if there is nothing to compare."""
    domain = F.regexp_replace(F.regexp_extract(F.lower(email), "^[^@]*@(.*)$", 1), r"^(www\.)+", "")
    host = F.regexp_replace(urls.host(url), r"^(www\.)+", "")
    same = (domain == host) | domain.endswith(F.concat(F.lit("."), host)) | host.endswith(F.concat(F.lit("."), domain))
    return F.when(~F.contains(email, F.lit("@")) | (host == ""), True).otherwise(same)


def is_share(url: Column) -> Column:
    """Whether a link only shares a page on a platform."""
    return urls.contains_any(F.lower(url), SHARE_MARKS)


def legal_page(url: Column) -> Column:
    """Whether a page is a legal one, by its path."""
    return F.coalesce(urls.contains_any(F.lower(urls.path(url)), LEGAL_PATHS), F.lit(False))


def contact_page(url: Column) -> Column:
    """Whether a page is about contact or the site itself, by its path."""
    path = F.lower(urls.path(url))
    return F.coalesce(urls.contains_any(path, ("/contact", "/kontakt", "/about")) | path.endswith("/get-in-touch"), F.lit(False))


def page_emails() -> Column:
    """Addresses of a captured page: mail links, and the text of contact and legal pages, elsewhere that of page chrome; only the site's own."""
    url = F.col("url")
    mails = F.filter(F.col("contact_links"), lambda h: h.startswith("mailto:"))
    linked = F.transform(mails, lambda h: decode_mail(F.trim(F.regexp_extract(h, r"^mailto:([^?]*)", 1))))
    seen = F.filter(emails_in(F.when(contact_page(url) | legal_page(url), F.col("body_text")).otherwise(F.col("chrome_text"))), lambda e: ~e.endswith("@2x.png") & ~urls.contains_any(e, ("example.com", "sentry.io", "@example")))
    every = F.concat(F.coalesce(linked, F.array().cast("array<string>")), F.coalesce(seen, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, lambda e: F.contains(e, F.lit("@")) & of_site(e, url)))


def page_phones() -> Column:
    """Numbers of a captured page: telephone links, and its text unless the page is a legal one."""
    calls = F.transform(F.filter(F.col("contact_links"), lambda h: h.startswith("tel:")), lambda h: balance_brackets(F.substring(h, F.lit(5), F.length(h))))
    seen = F.when(~legal_page(F.col("url")), phones_in(F.col("body_text")))
    every = F.concat(F.coalesce(calls, F.array().cast("array<string>")), F.coalesce(seen, F.array().cast("array<string>")))
    return F.array_distinct(F.filter(every, looks_like_phone))
