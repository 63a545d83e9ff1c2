"""Scalar column functions: bit tests, bands, parsing, rounding and probability math."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# TCP flag bits, protocol numbers, and the order of severities.
FLAG_BITS = {"FIN": 1, "SYN": 2, "RST": 4, "PSH": 8, "ACK": 16, "URG": 32}
PROTOCOLS = {"icmp": 1, "tcp": 6, "udp": 17}
SEVERITIES = ["info", "low", "medium", "high", "critical"]


def bit(column, mask: int) -> Column:
    """True where any bit of mask is set."""
    return F.col(column).cast("int").bitwiseAND(F.lit(mask)) != 0 if isinstance(column, str) else column.cast("int").bitwiseAND(F.lit(mask)) != 0


def share(condition: Column) -> Column:
    """Aggregate: share of rows, among those where the condition isn't null, in which it holds."""
    return F.avg(condition.cast("double"))


def protocol_number(text: Column) -> Column:
    """tcp, udp and icmp by name, else the number itself; null where it's neither."""
    name = F.lower(F.trim(text))
    known = F.lit(None).cast("int")
    for k, v in PROTOCOLS.items():
        known = F.when(name == k, F.lit(v)).otherwise(known)
    return F.coalesce(known, name.try_cast("double").cast("int"))


def flag_mask(text: Column) -> Column:
    """Bit mask of flag names separated by blanks or commas; null where a name is unknown."""
    names = F.array_distinct(F.filter(F.split(F.upper(F.coalesce(text, F.lit(""))), "[ ,|]+"), lambda x: x != ""))
    unknown = F.size(F.array_except(names, F.array(*[F.lit(k) for k in FLAG_BITS]))) > 0
    total = sum((F.when(F.array_contains(names, k), F.lit(v)).otherwise(F.lit(0)) for k, v in FLAG_BITS.items()), F.lit(0))
    return F.when(~unknown, total)


def any_timestamp(text: Column) -> Column:
    """ISO text, with or without Z, or seconds since the epoch."""
    return F.coalesce(F.try_to_timestamp(text), F.timestamp_seconds(text.try_cast("double")))


def day_first_timestamp(text: Column) -> Column:
    """Day-first clock of labelled flow exports; hours before 8 are afternoon hours."""
    found = F.coalesce(*[F.try_to_timestamp(F.trim(text), F.lit(f)) for f in ("d/M/yyyy H:mm:ss", "d/M/yyyy H:mm", "yyyy-MM-dd HH:mm:ss")])
    return F.when(F.hour(found) < 8, found + F.expr("INTERVAL 12 HOURS")).otherwise(found)


def url_host(url: Column) -> Column:
    """Lower-case host[:port]; null without a scheme."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)", 1)), F.lit(""))


def severity(p: Column) -> Column:
    return F.when(p >= 0.85, "critical").when(p >= 0.65, "high").when(p >= 0.40, "medium").otherwise("low")


def confidence(p: Column) -> Column:
    return F.when(p >= 0.85, "high").when(p >= 0.50, "medium").otherwise("low")


def risk_level(score: Column) -> Column:
    return F.when(score >= 0.80, "critical").when(score >= 0.60, "high").when(score >= 0.35, "medium").when(score > 0.0, "low").otherwise("info")


def band(value: Column, warn: float, alert: float) -> Column:
    """0 up to warn, 1 from alert on, linear between."""
    return F.when(value >= alert, F.lit(1.0)).when(value <= warn, F.lit(0.0)).otherwise((value - warn) / (alert - warn))


def severity_rank(name: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), name)


def stage_from_probability(p: Column) -> Column:
    return F.when(p >= 0.75, "Lateral Movement").when(p >= 0.5, "Reconnaissance").when(p >= 0.25, "Benign with Anomaly").otherwise("Benign")


def decay(p: Column, horizon: Column) -> Column:
    """A probability that goes toward one half by 0.85 a step after the first."""
    span = F.abs(p - 0.5) * F.pow(F.lit(0.85), horizon - 1)
    return F.when(horizon <= 1, p).when(p >= 0.5, F.lit(0.5) + span).otherwise(F.lit(0.5) - span)


def forecast_confidence(p: Column, base: Column, skill: Column, modelled: Column) -> Column:
    """Skill, agreement with the baseline and distance from one half, in one score; 0 without a measured skill."""
    agreement = F.when(modelled, 1 - F.least(F.lit(1.0), F.abs(p - base) / 0.5)).otherwise(F.lit(0.5))
    decisive = 2 * F.abs(p - 0.5)
    raw = F.sqrt(F.greatest(F.lit(0.0), F.least(F.lit(1.0), skill))) * (0.5 + 0.5 * agreement) * (0.5 + 0.5 * decisive)
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), F.lit(0.0))


def logit(p: Column, edge: float = 1e-12) -> Column:
    q = F.greatest(F.lit(edge), F.least(F.lit(1 - edge), p))
    return F.log(q / (1 - q))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def erfc(x: Column) -> Column:
    """Complementary error function for x >= 0 by a rational approximation (relative error under 1.2e-7)."""
    t = 1 / (1 + 0.5 * x)
    # The coefficients of the approximation, constant term first.
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    total = F.lit(0.0)
    for c in reversed(terms):
        total = total * t + c
    return t * F.exp(-x * x + total)


def label_text(text: Column) -> Column:
    """Attack labels in one form: dashes of all kinds and their mis-decoded residue become ' - ', lower case, single blanks."""
    dashed = F.regexp_replace(F.lower(F.trim(text)), "[–—\u0096�]+", "-")
    return F.regexp_replace(F.regexp_replace(dashed, r"\s*-\s*", " - "), r"\s+", " ")


# Characters that JSON writes in a short form.
SHORT = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """A JSON string in ASCII: other characters as \\u and four lower-case digits, two of them beyond 16 bits; null as null."""

    def one(c: Column) -> Column:
        units = F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
        out = F.when(c.between(" ", "~"), c).otherwise(units)
        for plain, short in SHORT.items():
            out = F.when(c == plain, F.lit(short)).otherwise(out)
        return out

    # most texts hold plain characters only and are taken as they are
    odd = text.rlike(r'[^ -~]|["\\]')
    body = F.when(odd, F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), body, F.lit('"')))


def canonical_json(fields: dict[str, tuple[Column, str]]) -> Column:
    """The JSON object of named (column, type) values with sorted names and no blanks; nulls are written.

    Types: string, or number and boolean, which are written as Spark prints them (whole numbers and booleans as JSON has them).
    """
    parts = []
    for name in sorted(fields):
        column, kind = fields[name]
        value = json_string(column) if kind == "string" else F.coalesce(column.cast("string"), F.lit("null"))
        parts += [F.lit(("," if parts else "{") + f'"{name}":'), value]
    return F.concat(*parts, F.lit("}"))


def canonical_digest(fields: dict[str, tuple[Column, str]]) -> Column:
    """SHA-256 of the canonical JSON of named values."""
    return F.sha2(canonical_json(fields), 256)


# A rational approximation of the inverse normal distribution, numerators and denominators from the highest power down.
CENTRE = ((-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00), (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0))
TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00), (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0))
TAIL_FROM = 0.02425


def _polynomial(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_quantile(p: Column) -> Column:
    """The standard normal quantile of a probability strictly between 0 and 1, else null; within 1.2e-9."""
    q = F.sqrt(-2 * F.log(F.least(p, 1 - p)))
    tail = _polynomial(TAIL[0], q) / _polynomial(TAIL[1], q)
    r = p - 0.5
    centre = _polynomial(CENTRE[0], r * r) * r / _polynomial(CENTRE[1], r * r)
    return F.when((p > 0) & (p < 1), F.when(p < TAIL_FROM, tail).when(p > 1 - TAIL_FROM, -tail).otherwise(centre))
