"""Mail address expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank_to_null, is_blank, strip

# Mail providers that count as one source class.
CONSUMER_DOMAINS = {"GMAIL": ("gmail.com",), "MICROSOFT": ("outlook.com", "hotmail.com", "live.com")}
SOURCE_TYPES = ("INTERNAL", "EXTERNAL")

# Marks of a sender that is a machine.
AUTOMATED_PREFIXES = ("no-reply@", "noreply@", "donotreply@", "do-not-reply@")
AUTOMATED_PARTS = ("account-security", "notification@", "notifications@", "mailer-daemon@")


def normalize_sender(address: Column) -> Column:
    return F.lower(blank_to_null(address))


def name_from_email(address: Column) -> Column:
    """Local part of an address, or the whole text where there is no usable '@'."""
    local = F.when(F.instr(address, "@") > 1, F.split_part(address, F.lit("@"), F.lit(1))).otherwise(address)
    return F.lower(blank_to_null(local))


def local_part(address: Column) -> Column:
    return F.lower(F.split_part(address, F.lit("@"), F.lit(1)))


def domain_of(address: Column, missing: str | None = "unknown", keep_empty: bool = False) -> Column:
    """Text after the last '@', lower case.

    ``missing`` stands for a blank address or one without '@'. An address that ends in '@' also gives
    ``missing`` unless ``keep_empty``, which returns the empty domain.
    """
    tail = F.lower(F.substring_index(address, "@", -1))
    absent = is_blank(address) | (F.instr(address, "@") == 0)
    if not keep_empty:
        absent = absent | F.endswith(address, F.lit("@"))
    return F.when(absent, F.lit(missing).cast("string")).otherwise(tail)


def sender_domain(given: Column, address: Column) -> Column:
    """The stated domain where there is one, else the domain of the address, else null."""
    return F.lower(F.coalesce(blank_to_null(given), strip(domain_of(address, missing=None))))


def source_class(domain: Column, own_domain: str) -> Column:
    low = F.lower(domain)
    return (
        F.when(low == own_domain.lower(), "INTERNAL")
        .when(low.isin(*CONSUMER_DOMAINS["GMAIL"]), "GMAIL")
        .when(low.isin(*CONSUMER_DOMAINS["MICROSOFT"]), "MICROSOFT")
        .otherwise("EXTERNAL")
    )


def parse_source_type(text: Column) -> Column:
    value = F.upper(strip(text))
    return F.when(value.isin(*SOURCE_TYPES), value)


def is_automated_sender(address: Column) -> Column:
    sender = F.lower(strip(F.coalesce(address, F.lit(""))))
    found = F.lit(False)
    for prefix in AUTOMATED_PREFIXES:
        found = found | F.startswith(sender, F.lit(prefix))
    for part in AUTOMATED_PARTS:
        found = found | F.contains(sender, F.lit(part))
    return found


def address_set(addresses: Column) -> Column:
    """Distinct, trimmed, lower-case, non-blank addresses of an array."""
    kept = F.filter(F.coalesce(addresses, F.array().cast("array<string>")), lambda a: ~is_blank(a))
    return F.array_distinct(F.transform(kept, lambda a: F.lower(strip(a))))


def recipient_display(recipients: Column) -> Column:
    """``Name <address>`` per recipient struct, or the bare address; blank addresses are dropped."""
    kept = F.filter(recipients, lambda r: ~is_blank(r["address"]))
    return F.transform(
        kept,
        lambda r: F.when(is_blank(r["name"]), r["address"]).otherwise(
            F.concat(r["name"], F.lit(" <"), r["address"], F.lit(">"))
        ),
    )
