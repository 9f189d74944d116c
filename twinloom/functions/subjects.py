"""Subjects: dot-separated tokens, patterns over them, and the keys built from them. All are Column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The first token of every subject that the engine builds.
PREFIX = "twin"


def tokens(subject: Column) -> Column:
    """All tokens, empty ones too."""
    return F.split(subject, r"\.", -1)


def bounded_tokens(subject: Column, last: int) -> Column:
    """Tokens 0 to `last`; what follows stays together in one more."""
    return F.split(subject, r"\.", last + 2)


def token(parts: Column, i: int) -> Column:
    """The token at place i, null if there are fewer."""
    return F.get(parts, i)


def pattern_regex(pattern: str) -> str:
    """`*` is one token, a last `>` one or more; the rest is literal."""
    parts = pattern.split(".")
    if ">" in parts[:-1]:
        raise ValueError(f"> is not last in {pattern!r}")
    return "^" + r"\.".join("[^.]+" if p == "*" else ".+" if p == ">" else re.escape(p) for p in parts) + "$"


def pattern_prefix(pattern: str) -> str:
    """The literal head of a pattern, which a scan can use."""
    return re.split(r"[*>]", pattern, maxsplit=1)[0]


def bounded_token(parts: Column, i: int, last: int) -> Column:
    """Of all tokens, what bounded_tokens(.., last) has at place i: beyond `last` the rest stays together."""
    return token(parts, i) if i <= last else F.array_join(F.slice(parts, F.lit(last + 2), F.greatest(F.size(parts) - (last + 1), F.lit(0))), ".")


def matches(subject: Column, pattern: str, parts: Column | None = None) -> Column:
    """Whether the subject is in the pattern; the literal head is a predicate that reaches the scan.

    With the subject's tokens at hand (`parts`), they are compared one by one, and no regular expression runs.
    """
    names = pattern.split(".")
    if ">" in names[:-1]:
        raise ValueError(f"> is not last in {pattern!r}")
    head, wild = pattern_prefix(pattern), any(p in "*>" for p in names)
    if not wild:
        return subject == pattern
    found = subject.startswith(head) if head else F.lit(True)
    if parts is None:
        return found & subject.rlike(pattern_regex(pattern))
    many, kept = names[-1] == ">", names[:-1] if names[-1] == ">" else names
    found = found & (F.size(parts) > len(kept) if many else F.size(parts) == len(kept))
    for i, name in enumerate(kept):
        if name == "*":
            found = found & (token(parts, i) != "")
        elif "*" in names[:i]:  # before the first wildcard the head has told
            found = found & (token(parts, i) == name)
    # what a last > stands for has a character at least
    return found & ((F.size(parts) > len(names)) | (token(parts, len(kept)) != "")) if many else found


def relation_key(sid: Column, st: Column, si: Column, dt: Column) -> Column:
    """Where the relation set of (st, si, dt) is kept."""
    return F.concat(F.lit(f"{PREFIX}.sol."), sid, F.lit(".r.kv."), st, F.lit("."), si, F.lit("."), dt, F.lit(".set"))


def assertion_subject(sid: Column, st: Column, dt: Column) -> Column:
    """What an assertion is published on; the types allow sharding by subject."""
    return F.concat(F.lit(f"{PREFIX}.sol."), sid, F.lit(".r.assert."), st, F.lit("."), dt)


def base64url(raw: Column) -> Column:
    return F.translate(F.base64(raw), "+/", "-_")


def unbase64url(text: Column) -> Column:
    return F.unbase64(F.translate(text, "-_", "+/"))


def ipv4_bytes(text: Column) -> Column:
    """The four bytes of a dotted address; null if it isn't one."""
    parts = F.split(text, r"\.")
    ok = text.rlike(r"^((25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(25[0-5]|2[0-4]\d|1?\d?\d)$")
    return F.when(ok, F.unhex(F.array_join(F.transform(parts, lambda p: F.lpad(F.hex(p.cast("int")), 2, "0")), "")))


def ipv4_text(raw: Column) -> Column:
    return F.when(F.octet_length(raw) == 4, F.concat_ws(".", *(F.conv(F.substring(F.hex(raw), 2 * i + 1, 2), 16, 10) for i in range(4))))


def _with(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), 0)


def ipv6_bytes(text: Column) -> Column:
    """The sixteen bytes of an address with colons (`::` and a dotted tail too); null if it isn't one."""
    dotted = r"^(.*:)(\d+\.\d+\.\d+\.\d+)$"
    none = F.array().cast("array<string>")
    tail = F.hex(ipv4_bytes(F.regexp_extract(text, dotted, 2)))
    in_hex = _with(tail, lambda t: F.concat(F.regexp_extract(text, dotted, 1), F.substring(t, 1, 4), F.lit(":"), F.substring(t, 5, 4)))
    groups = lambda c: F.when(c == "", none).otherwise(F.split(c, ":", -1))

    def of_halves(halves: Column) -> Column:
        left, right = groups(F.get(halves, 0)), F.when(F.size(halves) == 2, groups(F.get(halves, 1))).otherwise(none)
        return _with(F.struct(F.size(halves).alias("halves"), left.alias("left"), right.alias("right")), of_groups)

    def of_groups(x: Column) -> Column:
        n = F.size(x["left"]) + F.size(x["right"])
        every = F.concat(x["left"], F.array_repeat(F.lit("0"), F.greatest(F.lit(8) - n, F.lit(0))), x["right"])
        ok = ((x["halves"] == 1) & (n == 8)) | ((x["halves"] == 2) & (n < 8))
        return F.when(ok & F.forall(every, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$")), F.unhex(F.array_join(F.transform(every, lambda g: F.lpad(g, 4, "0")), "")))

    return _with(F.split(F.when(text.rlike(dotted), in_hex).otherwise(text), "::", -1), of_halves)


def ipv6_text(raw: Column) -> Column:
    """The canonical text: lower case, no leading zeros, the first of the longest runs of zero groups as `::`."""
    groups = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.lower(F.conv(F.substring(F.hex(raw), 4 * i + 1, F.lit(4)), 16, 16)))

    def shortened(whole: Column) -> Column:
        out = whole
        for k in range(2, 9):  # the longest comes last and counts
            run = rf"^(|.*?:)0(?::0){{{k - 1}}}(|:.*)$"
            out = F.when(whole.rlike(run), F.concat(F.rtrim(F.regexp_extract(whole, run, 1), F.lit(":")), F.lit("::"), F.ltrim(F.regexp_extract(whole, run, 2), F.lit(":")))).otherwise(out)
        return out

    return F.when(F.octet_length(raw) == 16, _with(F.array_join(groups, ":"), shortened))


def ip_bytes(text: Column) -> Column:
    """Four or sixteen bytes."""
    return F.coalesce(ipv4_bytes(text), ipv6_bytes(text))


def ip_text(raw: Column) -> Column:
    return F.coalesce(ipv4_text(raw), ipv6_text(raw))
