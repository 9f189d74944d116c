"""Compiler rules: which subjects assert a relation, and the assertions they make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinloom.functions import subjects as S

#: The place of the solution's id in an observation subject.
SID_TOKEN = 2


@dataclass(frozen=True)
class Rule:
    """`match` asserts source (token, type) -> destination (token, type) for ttl_ms; 0 or less retracts."""

    match: str
    ttl_ms: int
    source_type: str
    destination_type: str
    source_token: int
    destination_token: int
    quantum_ms: int = 0
    description: str = ""

    @property
    def last(self) -> int:
        return max(self.source_token, self.destination_token, SID_TOKEN)


def quantised(exp: Column, quantum_ms: int) -> Column:
    """The nearest multiple, halves up."""
    return F.expr(f"({quantum_ms})").cast("long") * F.floor((exp + quantum_ms // 2) / F.lit(quantum_ms)).cast("long")


def _assertion(rule: Rule, subject: Column, parts: Column, at_ms: Column, quantise: bool) -> Column:
    exp = at_ms + F.lit(rule.ttl_ms)
    exp = quantised(exp, rule.quantum_ms) if quantise and rule.quantum_ms > 0 else exp
    whole = F.size(parts) > rule.last
    error = F.when(~whole, F.concat(F.lit("too few tokens for "), F.lit(rule.match)))
    pick = lambda i: F.when(whole, S.bounded_token(parts, i, rule.last))
    return F.when(
        S.matches(subject, rule.match, parts),
        F.struct(
            pick(SID_TOKEN).alias("sid"), F.lit(rule.source_type).alias("st"), pick(rule.source_token).alias("si"), F.lit(rule.destination_type).alias("dt"),
            pick(rule.destination_token).alias("di"), F.lit(rule.ttl_ms).cast("long").alias("ttl"), exp.alias("exp"), error.alias("error"),
        ),
    )


def assertions(messages: DataFrame, rules: list[Rule], subject: str = "subject", at_ms: str = "at_ms", quantise: bool = False) -> DataFrame:
    """One row per message and matching rule: the message's columns, then sid, st, si, dt, di, ttl, exp, error, msg_id.

    All rules are evaluated in one pass over subjects that are split once; a rule's literal tokens are compared before
    anything else, so a message costs a comparison a rule that doesn't match. A match with too few tokens has an error and
    null ids. msg_id is the SHA-1 of the assertion, for deduplication.
    """
    split = messages.withColumn("__t", S.tokens(F.col(subject)))
    made = F.array_compact(F.array(*(_assertion(r, F.col(subject), F.col("__t"), F.col(at_ms), quantise) for r in rules)))
    rows = split.select(*messages.columns, F.explode(made).alias("__a")).select(*messages.columns, "__a.*")
    return rows.withColumn("msg_id", F.sha1(F.concat_ws("\x1f", "sid", "st", "si", "dt", "di", F.col("ttl").cast("string"), F.col("exp").cast("string"))))


def valid(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error").isNull())


def deduplicated(rows: DataFrame, order: list[str]) -> DataFrame:
    """The first assertion of each msg_id in order; copies within a batch never reach the sets."""
    first = F.min_by(F.struct(*rows.columns), F.struct(*order)).alias("a")
    return rows.groupBy("msg_id").agg(first).select("a.*")
