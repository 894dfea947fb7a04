"""Scalar expressions: identifiers, token estimates, fingerprints, globs and slugs.  All are Columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Entity types by id prefix.
PREFIXES = {"PRG": "program", "FEAT": "feature", "SPEC": "spec", "TASK": "task", "KNOW": "knowledge", "LRN": "learning"}

#: White space at the ends of lines and fields.
WHITE = " \t\n\v\f\r"


def token_estimate(text: Column) -> Column:
    """Four code points a token, rounded up; none for an empty or null text."""
    return F.floor((F.coalesce(F.length(text), F.lit(0)) + 3) / 4).cast("long")


def fingerprint(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def without_evidence(body: Column) -> Column:
    """A task body without its ``Evidence-X:`` lines."""
    kept = F.regexp_replace(F.concat(F.lit("\n"), body), r"\n[\t\f\r ]*Evidence-[A-Za-z]+:[^\n]*", "")
    return F.when(F.contains(body, F.lit("Evidence-")), F.substr(kept, F.lit(2))).otherwise(body)


def stripped(text: Column) -> Column:
    """Without white space at either end: tabs and line ends too, not spaces alone."""
    return F.btrim(text, F.lit(WHITE))


def after_label(body: Column, label: str, value: str) -> Column:
    """What the group of ``value`` holds after ``label:`` on each line that starts with it; one pattern over the whole text, which starts with a plain line end
    so that most places are passed over at once."""
    found = F.regexp_extract_all(F.concat(F.lit("\n"), body), F.lit(rf"\n[ \t\x0B\f\r]*{label}:{value}"), F.lit(1))
    return F.when(F.contains(body, F.lit(f"{label}:")), found).otherwise(F.when(body.isNotNull(), F.array().cast("array<string>")))


def evidence_field(body: Column, name: str) -> Column:
    """The value of the last ``Evidence-name:`` line, or null."""
    rows = after_label(body, f"Evidence-{name}", r"([^\n]*)")
    return stripped(F.substring_index(F.try_element_at(rows, F.lit(-1)), f"Evidence-{name}:", -1))


def evidence_state(body: Column) -> Column:
    """failed, unverified, stale or verified, by the result and the fingerprint of what else the body says."""
    result = evidence_field(body, "Result")
    current = fingerprint(without_evidence(body))
    passed = F.when(evidence_field(body, "Fingerprint").eqNullSafe(current), "verified").otherwise("stale")
    return F.when(result == "pass", passed).when(result == "fail", "failed").otherwise("unverified")


def parse_id(text: Column) -> Column:
    """struct(type, prefix, number, width) of ``PREFIX-digits``, or null."""
    prefix, digits = F.regexp_extract(text, r"\A(.+)-([0-9]+)\z", 1), F.regexp_extract(text, r"\A(.+)-([0-9]+)\z", 2)
    kinds = F.create_map(*[F.lit(x) for kv in PREFIXES.items() for x in kv])
    kind, number = F.try_element_at(kinds, prefix), F.expr("null").cast("int")
    number = digits.try_cast("int")
    return F.when(kind.isNotNull() & (number >= 1), F.struct(kind.alias("type"), prefix.alias("prefix"), number.alias("number"), F.length(digits).alias("width")))


def format_id(prefix: str, number: Column, width: int = 3) -> Column:
    """Zero-padded to ``width``; longer numbers stay whole."""
    return F.format_string(f"{prefix}-%0{width}d", number.cast("long"))


def glob_regex(glob: str) -> str:
    """``**`` any text, ``*`` any text without a slash, ``?`` one character; anchored at both ends."""
    parts = re.split(r"(\*\*|\*|\?)", glob)
    return r"\A" + "".join({"**": "(?s:.*)", "*": "[^/]*", "?": "(?s:.)"}.get(p, re.escape(p)) for p in parts) + r"\z"


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def classify_path(path: Column) -> Column:
    """The artifact type of a canonical location, or null; the first that matches."""
    kinds = [
        ("constitution", r"memory/constitution\.md"), ("learning", r"memory/learnings/LRN-[0-9]+[^/]*\.md"), ("knowledge", r"knowledge/KNOW-[0-9]+[^/]*\.md"),
        ("program", r"programs/PRG-[0-9]+/program\.md"), ("feature", r"programs/PRG-[0-9]+/features/FEAT-[0-9]+/feature\.md"),
        *[(k, rf"programs/PRG-[0-9]+/features/FEAT-[0-9]+/specs/SPEC-[0-9]+/{k}\.md") for k in ("spec", "plan", "tasks", "validation")],
    ]
    out = None
    for kind, pattern in kinds:
        hit = path.rlike(rf"(\A|/){pattern}\z")
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out
