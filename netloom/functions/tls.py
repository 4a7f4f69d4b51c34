"""Rules about cipher names and certificate names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted ciphers and message digests, and the cipher name form
# (key exchange, signature, cipher, chaining, digest).
STRONG_CIPHERS = ("AES128", "AES256", "AES384")
STRONG_DIGESTS = ("SHA", "SHA256", "SHA384")
CIPHER_FORM = r"^(?:(?:ECDHE|DHE)-)?(?:(?:ECDSA|DSA|RSA)-)?(DES-CBC3|[^-]+)-(?:GCM-)?(SHA\d*|MD5)$"


def cipher_weak(name: Column) -> Column:
    """Whether a cipher suite is weak; NULL when its name does not parse."""
    cipher = F.regexp_extract(name, CIPHER_FORM, 1)
    digest = F.regexp_extract(name, CIPHER_FORM, 2)
    strong = cipher.isin(*STRONG_CIPHERS) & digest.isin(*STRONG_DIGESTS)
    return F.when(name.rlike(CIPHER_FORM), ~strong)


def is_full(certificate: Column) -> Column:
    """A whole certificate rather than a fingerprint (longer than 40 characters)."""
    return F.length(certificate) > 40


def cert_name_matches(names: Column, host: Column) -> Column:
    """Whether any of the newline-separated names covers the host.

    A trailing dot is dropped, case is ignored and each leading "*." stands for
    exactly one label at the front of the host.
    """
    plain_host = F.lower(F.regexp_replace(host, r"\.$", ""))
    labels = F.split(plain_host, r"\.")

    def covers(name: Column) -> Column:
        plain = F.lower(F.regexp_replace(name, r"\.$", ""))
        stars = F.regexp_extract(plain, r"^((?:\*\.)*)", 1)
        skipped = (F.length(stars) / 2).cast("int")
        rest = F.substring(plain, F.length(stars) + 1, F.length(plain))
        # A host without a dot left keeps its last label, as nothing can be cut.
        cut = F.least(skipped, F.size(labels) - 1)
        tail = F.concat_ws(".", F.slice(labels, cut + 1, F.size(labels)))
        return rest == tail

    return F.exists(F.split(names, "\n"), covers)
