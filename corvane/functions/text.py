"""Column functions on text: normal form, sizes, words, n-grams, scrubbing, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File suffixes and directories that are never opened.
DENIED = r"(^|/)(\.git|\.venv|venv|node_modules|__pycache__)(/|$)|\.(pem|key|p12|pfx|so|bin|exe|png|jpg)$"
#: Languages of the code stream (fixed values).
CODE_LANGUAGES = ("python", "rust", "c", "cpp", "cuda")
#: Licences that may be kept (fixed values).
LICENSES = ("mit", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "unlicense", "cc0-1.0")
TEST_MARKERS = ("def test_", "unittest", "pytest")
#: Named secret rules: value patterns, replaced by ``<REDACTED>``.
SECRETS = {
    "aws_key": r"\bAKIA[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[A-Za-z0-9]{36,}\b",
    "openai_key": r"\bsk-[A-Za-z0-9_-]{20,}\b",
    "slack_token": r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    "jwt": r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}",
    "private_key": r"-----BEGIN [A-Z ]*PRIVATE KEY-----",
    "bearer": r"\bBearer [A-Za-z0-9._-]{16,}",
    "url_password": r"://[^/\s:@]+:[^/\s:@]+@",
    "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "hex_secret": r"\b[0-9a-f]{40}\b",
    "env_assignment": r"(?:TOKEN|SECRET|PASSWORD|API_KEY)=[^\s]+",
}
#: Key segments whose values are digests, not secrets (fixed values).
DIGEST_KEYS = ("sha256", "sha1", "md5", "hash", "salt", "checksum")


def normal(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed: the form in which texts are compared."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def approx_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("long")


def words(text: Column) -> Column:
    """Longest runs of letters or digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def ngrams(items: Column, n: int) -> Column:
    """All runs of ``n`` items, joined by blanks; empty for shorter arrays."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, F.lit(n)), " "))


def denied_path(path: Column) -> Column:
    return F.coalesce(path.rlike(DENIED), F.lit(False))


def path_class(path: Column) -> Column:
    """docs, behaviour or work, by path."""
    return (
        F.when(path.isNull(), "work")
        .when(path.rlike(r"^(docs|changes|evidence)/|\.md$"), "docs")
        .when(path.rlike(r"^(net|env|tools)/.*\.py$"), "behaviour")
        .otherwise("work")
    )


def all_licensed(licenses: Column, allowed: tuple[str, ...] = LICENSES) -> Column:
    """Whether all declared licences are allowed; an empty or missing list is not."""
    return F.coalesce((F.size(licenses) > 0) & F.forall(licenses, lambda x: F.lower(x).isin(*allowed)), F.lit(False))


def cut_bytes(text: Column, limit: int) -> Column:
    """Longest prefix of at most ``limit`` UTF-8 bytes that does not split a character."""
    raw = F.encode(text, "UTF-8")
    tail = F.regexp_replace(F.hex(F.substring(raw, limit - 2, 3)), "^((?:..)*?)(F[0-7](?:[89AB].){0,2}|E.(?:[89AB].)?|[CD].)?$", "$1")
    cut = F.concat(F.hex(F.substring(raw, 1, limit - 3)), tail)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.decode(F.unhex(cut), "UTF-8"))


def markers(text: Column, marks: tuple[str, ...] = TEST_MARKERS) -> Column:
    return F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))


def secret_counts(text: Column, rules: dict[str, str] = SECRETS) -> Column:
    return F.struct(*[F.regexp_count(text, F.lit(p)).cast("long").alias(k) for k, p in rules.items()])


def scrub(text: Column, rules: dict[str, str] = SECRETS) -> Column:
    """Secrets replaced; hexadecimal values of keys with a digest word among their segments stay."""
    word = "|".join(DIGEST_KEYS)
    key = rf"((?<![A-Za-z0-9_])(?:[A-Za-z0-9]+_)*(?i:{word})(?:_[A-Za-z0-9]+)*[\x22']?\s{{0,2}}[=:]\s{{0,2}}[\x22']?)"
    # such values carry a mark while the rules run
    out = F.regexp_replace(text, key + r"([0-9a-f]{40})\b", "$1\ue000$2")
    for name, p in rules.items():
        out = F.regexp_replace(out, ("(?<!\ue000)" if name == "hex_secret" else "") + p, "<REDACTED>")
    out = F.translate(out, "\ue000", "")
    return F.regexp_replace(out, r"(/home|/Users)/[A-Za-z0-9._-]+", "<HOME>")


def iso_week(ts: Column) -> Column:
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def parse_time(text: Column) -> Column:
    """Timestamp of an ISO spelling: blank or T, fraction, Z, offset or none (then UTC), compact or dotted dates."""
    t = F.trim(text)
    t = F.regexp_replace(t, r"^(\d{4})(\d{2})(\d{2})[T ]?(\d{2})(\d{2})(\d{2})", "$1-$2-$3T$4:$5:$6")
    t = F.regexp_replace(t, r"^(\d{4})[./](\d{2})[./](\d{2})", "$1-$2-$3")
    t = F.regexp_replace(t, r"^(\d{2})\.(\d{2})\.(\d{4})", "$3-$2-$1")
    return F.try_to_timestamp(F.regexp_replace(t, r" ?UTC$", "Z"))


def coin(*key: Column | str) -> Column:
    """Uniform number in [0, 1) from the md5 of the key parts, equal in every engine."""
    parts = [k if isinstance(k, Column) else F.lit(k) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 12), 16, 10).cast("double") / float(16**12)
