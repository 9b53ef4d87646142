"""Indicator extraction: fourteen sorted, distinct lists per text, all in JVM expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postwatch.functions.text import refang_text
from postwatch.schema import INDICATOR_FIELDS, IOC_COLUMNS

# --- fixed values: patterns. (?iU) gives the JVM Unicode-aware classes and case matching. --------
URL = r"""(?iU)\bhttps?://[^\s\x1c-\x1f<>"']+"""
URL_TAIL = ".,);]"
# Both cases are spelled out: the JVM compares some letters with one case of a class only.
EMAIL = r"(?iU)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,63}\b"
IP_CANDIDATE = r"(?iU)(?<![\w:])(?:[A-F0-9:.]{3,45})(?![\w:])"
# The look-ahead changes no match: it only gives up early on a word that no dot follows.
DOMAIN = r"(?iU)\b(?=[a-z0-9-]++\.)(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}\b"
DIGEST_LENGTHS = {"md5": 32, "sha1": 40, "sha256": 64, "sha512": 128}
DIGEST = r"(?U)\b(?:[a-fA-F0-9]{32}|[a-fA-F0-9]{40}|[a-fA-F0-9]{64}|[a-fA-F0-9]{128})\b"
CVE = r"(?iU)\bCVE-\d{4}-\d{4,7}\b"
ATTACK = r"(?iU)\bT\d{4}(?:\.\d{3})?\b"
FILE_SUFFIXES = "exe|dll|sys|ps1|bat|cmd|js|vbs|jar|apk|docm|xlsm|zip|rar|7z"
FILENAME = rf"(?iU)\b[\w.-]+\.(?:{FILE_SUFFIXES})\b"
HASHTAG = r"(?U)(?<!\w)#([\w-]{2,64})"
ACTOR = r"(?iU)\b(?:APT\d{1,3}|UNC\d{2,6}|FIN\d{1,3}|TA\d{3,6})\b"
# -------------------------------------------------------------------------------------------------

# Shorter words without a telling character, with the blanks behind; nothing is given back in part.
PLAIN_WORD = r"(?U)(?<!\S)(?:[^\s.:@#\-\p{Nd}]{1,31}+(?:\s++|\z))++"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_IPV4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_GROUPS = r"[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*"
_URL_HOST = r"(?i)^https?://(?:[^/?#]*@)?([^/?#:@\[\]]+)(?::[^/?#\[\]]*)?(?:[/?#]|$)"


def _none() -> Column:
    return F.array().cast("array<string>")


def _all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _only_if(condition: Column, values: Column) -> Column:
    """Skip a costly pattern where a cheap necessary condition already fails."""
    return F.when(condition, values).otherwise(_none())


def _tidy(values: Column) -> Column:
    return F.sort_array(F.array_distinct(values))


def inner_dot(prepared: Column) -> Column:
    """Some dot is followed by more text at once, as in every address, domain and file name."""
    return prepared.rlike(r"\.[^\s.]")


def letter_digit(prepared: Column) -> Column:
    """Some letter is followed by a digit, as in every technique id and group name."""
    return prepared.rlike(r"\p{Nd}") & prepared.rlike(r"[A-Za-zİı]\p{Nd}")


def telling_words(prepared: Column) -> Column:
    """The text without words that can hold no indicator; a run of them becomes one blank.

    Every indicator is part of one word and has a digit or one of ``. : @ # -`` in it, except for a
    digest, which has 32 characters at least. What remains is scanned by all patterns, so the blanks
    of a run go as well: they would be half of it.
    """
    return F.regexp_replace(prepared, PLAIN_WORD, " ")


def extract_urls(prepared: Column) -> Column:
    found = _only_if(prepared.contains("://"), _all(prepared, URL))
    return _tidy(F.transform(found, lambda url: F.rtrim(url, F.lit(URL_TAIL))))


def extract_emails(prepared: Column) -> Column:
    return _tidy(_only_if(prepared.contains("@"), _all(prepared, EMAIL)))


def ip_candidates(prepared: Column) -> Column:
    # A v4 address has a dot between digits, a v6 address two colons with at most a group between.
    possible = prepared.rlike(r"[0-9]\.[0-9]") | (
        prepared.contains(":") & prepared.rlike(r":[0-9A-Fa-f]{0,4}:")
    )
    return F.transform(
        _only_if(possible, _all(prepared, IP_CANDIDATE)), lambda run: F.btrim(run, F.lit("."))
    )


def extract_ipv4(candidates: Column) -> Column:
    return _tidy(F.filter(candidates, lambda run: run.rlike(rf"^{_IPV4}$")))


def extract_ipv6(candidates: Column) -> Column:
    with_colon = F.filter(candidates, lambda run: run.contains(":"))
    return _tidy(canonical_ipv6(with_colon))


def canonical_ipv6(runs: Column) -> Column:
    """Compressed lower-case forms of the runs that are v6 addresses.

    Every step maps the whole list, so that no step repeats the work of the one before.
    """

    def as_struct(run: Column) -> Column:
        lowered = F.lower(run)
        tail = F.regexp_extract(lowered, rf"(?:^|:)({_IPV4})$", 1)
        return F.struct(lowered.alias("text"), tail.alias("tail"))

    def hex_tail(run: Column) -> Column:
        """An embedded v4 address becomes two groups."""
        octets = F.transform(F.split(run["tail"], r"\."), lambda o: o.try_cast("int"))
        pairs = F.concat(
            F.hex(F.get(octets, 0) * 256 + F.get(octets, 1)), F.lit(":"),
            F.hex(F.get(octets, 2) * 256 + F.get(octets, 3)),
        )
        head = F.substring(run["text"], F.lit(1), F.length(run["text"]) - F.length(run["tail"]))
        return F.when(run["tail"] != "", F.concat(head, F.lower(pairs))).otherwise(run["text"])

    def sides(run: Column) -> Column:
        def groups(pattern: str) -> Column:
            return F.filter(F.split(F.regexp_extract(run, pattern, 1), ":"), lambda g: g != "")

        return F.struct(
            run.alias("text"), groups(r"^(.*?)::").alias("left"), groups(r"::(.*)$").alias("right")
        )

    def spelled(run: Column) -> Column:
        """All eight groups, or null."""
        missing = F.lit(8) - F.size(run["left"]) - F.size(run["right"])
        short = run["text"].rlike(rf"^(?:{_GROUPS})?::(?:{_GROUPS})?$") & (missing >= 1)
        full = run["text"].rlike(r"^[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}$")
        return F.when(full, F.split(run["text"], ":")).when(
            short, F.concat(run["left"], F.array_repeat(F.lit("0"), missing), run["right"])
        )

    def joined(groups: Column) -> Column:
        bare = F.transform(groups, lambda group: F.regexp_replace(group, "^0+(?=.)", ""))
        return F.array_join(bare, ":")

    def compressed(address: Column) -> Column:
        """The longest run of zero groups, the first of equals, is written as two colons."""
        zeros = r"(?:^|:)0(?::0){%d}(?:$|:)"
        runs = [
            (address.rlike(zeros % (n - 1)),
             F.regexp_replace(address, r"^(.*?)%s(.*)$" % (zeros % (n - 1)), "$1::$2"))
            for n in range(8, 1, -1)
        ]
        return reduce(lambda chain, run: chain.when(*run), runs[1:], F.when(*runs[0])).otherwise(
            address
        )

    plain = F.transform(F.transform(runs, as_struct), hex_tail)
    valid = F.filter(F.transform(F.transform(plain, sides), spelled), lambda g: g.isNotNull())
    return F.transform(F.transform(valid, joined), compressed)


def url_host(url: Column) -> Column:
    """Lower-case host without user and port; null for a bracketed or missing one."""
    return F.lower(F.nullif(F.regexp_extract(url, _URL_HOST, 1), F.lit("")))


def extract_domains(prepared: Column, urls: Column, emails: Column, dotted: Column) -> Column:
    named = F.array_distinct(_only_if(dotted, _all(prepared, DOMAIN)))
    mail_hosts = F.transform(emails, lambda mail: F.substring_index(mail, "@", -1))
    hosts = F.filter(
        F.transform(urls, url_host),
        lambda host: host.isNotNull() & ~host.rlike(rf"^{_IPV4}$"),
    )
    # Lower-cased after the lists are made distinct, so spellings of one name stay apart.
    return F.sort_array(
        F.transform(F.array_union(F.array_except(named, mail_hosts), hosts), F.lower)
    )


def digests(prepared: Column) -> Column:
    """Digests of all four lengths; no length can match inside another."""
    return _tidy(_only_if(prepared.rlike("[a-fA-F0-9]{32}"), _all(prepared, DIGEST)))


def extract_digests(found: Column, kind: str) -> Column:
    return F.filter(found, lambda digest: F.length(digest) == DIGEST_LENGTHS[kind])


def extract_cves(prepared: Column) -> Column:
    found = _only_if(prepared.rlike(r"(?iU)CVE-\d"), _all(prepared, CVE))
    return _tidy(F.transform(found, F.upper))


def extract_attack_techniques(prepared: Column, coded: Column) -> Column:
    found = _only_if(coded, _all(prepared, ATTACK))
    return _tidy(F.transform(found, F.upper))


def extract_filenames(prepared: Column, dotted: Column) -> Column:
    possible = dotted & prepared.rlike(rf"(?iU)\.(?:{FILE_SUFFIXES})\b")
    return _tidy(_only_if(possible, _all(prepared, FILENAME)))


def extract_hashtags(prepared: Column) -> Column:
    found = _only_if(prepared.contains("#"), _all(prepared, HASHTAG, 1))
    return _tidy(F.transform(found, F.lower))


def extract_threat_actors(prepared: Column, coded: Column) -> Column:
    found = _only_if(coded, _all(prepared, ACTOR))
    return _tidy(F.transform(found, F.upper))


def with_indicators(df: DataFrame, text: str = "text") -> DataFrame:
    """Add the fourteen ``ioc_*`` columns.

    The steps are separate projections so that each shared part (prepared text, candidates, URLs,
    emails) is computed once per row.
    """
    prepared, dotted, coded = F.col("_prepared"), F.col("_dotted"), F.col("_coded")
    urls, emails = F.col("ioc_urls"), F.col("ioc_emails")
    staged = (
        df.withColumn("_prepared", telling_words(refang_text(F.col(text))))
        .withColumns(
            {
                "ioc_urls": extract_urls(prepared),
                "ioc_emails": extract_emails(prepared),
                "_candidates": ip_candidates(prepared),
                "_digests": digests(prepared),
                "_dotted": inner_dot(prepared),
                "_coded": letter_digit(prepared),
            }
        )
        .withColumns(
            {
                "ioc_ipv4": extract_ipv4(F.col("_candidates")),
                "ioc_ipv6": extract_ipv6(F.col("_candidates")),
                "ioc_domains": extract_domains(prepared, urls, emails, dotted),
                **{f"ioc_{kind}": extract_digests(F.col("_digests"), kind)
                   for kind in DIGEST_LENGTHS},
                "ioc_cves": extract_cves(prepared),
                "ioc_attack_techniques": extract_attack_techniques(prepared, coded),
                "ioc_filenames": extract_filenames(prepared, dotted),
                "ioc_hashtags": extract_hashtags(prepared),
                "ioc_threat_actors": extract_threat_actors(prepared, coded),
            }
        )
    )
    return staged.drop("_prepared", "_candidates", "_digests", "_dotted", "_coded")


def indicator_struct() -> Column:
    """The fourteen stored lists as one struct."""
    return F.struct(*[F.col(f"ioc_{name}").alias(name) for name in INDICATOR_FIELDS])


def indicator_total() -> Column:
    return reduce(lambda total, name: total + F.size(name), IOC_COLUMNS, F.lit(0))


def indicator_preview(count: int = 10) -> Column:
    """The first values over all lists, in field order."""
    return F.slice(F.flatten(F.array(*IOC_COLUMNS)), 1, count)
