"""First-match policies compiled to one expression."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A rule: every listed column must have one of the listed values; no condition matches all rows."""

    id: str
    when: Mapping[str, Sequence[str]] = field(default_factory=dict)
    then: Mapping[str, object] = field(default_factory=dict)


def parse_policy(rules: Sequence[Mapping[str, object]], columns: Sequence[str]) -> list[Rule]:
    """Rules of plain mappings, checked: unique ids, known columns, a last rule without conditions, positive hours."""
    out, seen = [], set()
    for i, r in enumerate(rules):
        rid = str(r.get("id") or "")
        if not rid or rid in seen:
            raise ValueError(f"rule {i}: missing or repeated id {rid!r}")
        seen.add(rid)
        when = r.get("when") or {}
        if unknown := set(when) - set(columns):
            raise ValueError(f"rule {rid}: unknown conditions {sorted(unknown)}")
        then = dict(r.get("then") or {})
        if "hours" in then and not float(then["hours"]) > 0:
            raise ValueError(f"rule {rid}: hours must be positive")
        out.append(Rule(rid, {k: [v] if isinstance(v, str) else list(v) for k, v in when.items()}, then))
    if not out or out[-1].when:
        raise ValueError("the last rule must match everything")
    return out


def load_policy(text: str, columns: Sequence[str], priorities: Sequence[str] | None = None) -> list[Rule]:
    """Rules of a YAML document: a list, or a mapping with a list under ``rules``. What a rule has beside ``id`` and ``when`` is its outcome; ``sla_hours`` counts as ``hours``, and a ``priority`` must be among ``priorities`` where these are given. What is no such document fails by name."""
    import yaml

    try:
        doc = yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ValueError(f"the policy is no YAML: {e}") from e
    listed = doc.get("rules") if isinstance(doc, dict) else doc
    if not isinstance(listed, list) or not all(isinstance(r, dict) for r in listed):
        raise ValueError("the policy has no list of rules")
    rules = []
    for r in listed:
        then = {("hours" if k == "sla_hours" else k): v for k, v in r.items() if k not in ("id", "when")}
        if "hours" in then and (isinstance(then["hours"], bool) or not isinstance(then["hours"], (int, float))):
            raise ValueError(f"rule {r.get('id')}: hours must be a number")
        if priorities is not None and then.get("priority") not in priorities:
            raise ValueError(f"rule {r.get('id')}: priority must be one of {list(priorities)}")
        rules.append({"id": r.get("id"), "when": r.get("when") or {}, "then": then})
    return parse_policy(rules, columns)


def evaluate(policy: Sequence[Rule], output: str) -> Column:
    """The value of ``output`` of the first rule that matches, ``id`` for its id. A null never matches a listed condition, so the result is total."""
    out = None
    for r in reversed(policy):
        value = F.lit(r.id if output == "id" else r.then.get(output))
        if not r.when:
            out = value
            continue
        hit = F.lit(True)
        for column, values in r.when.items():
            hit = hit & F.coalesce(F.col(column).isin(*values), F.lit(False))
        out = F.when(hit, value).otherwise(out)
    return out


def due(start: Column, hours: Column) -> Column:
    """A moment some hours, also broken ones, after another."""
    return F.timestamp_micros(F.unix_micros(start.cast("timestamp")) + (hours * 3_600_000_000).cast("long"))
