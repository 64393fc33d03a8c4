"""How samples were taken: the contract that every read states, and a tag's metadata."""

from __future__ import annotations

import difflib
import hashlib
import math
from dataclasses import dataclass, field

from .errors import IncomparableSampling, SchemaError

BASES = ("TIME_WEIGHTED", "EVENT_WEIGHTED")
RETRIEVALS = ("RECORDED", "INTERPOLATED")
AGGREGATES = ("NONE", "OPC_UA_AVERAGE", "OPC_UA_TIME_AVERAGE")
ROLES = ("PV", "SP", "OP", "MODE")
SEVERITIES = ("BAD", "UNCERTAIN", "GOOD")


@dataclass(frozen=True)
class SamplingContract:
    basis: str = "TIME_WEIGHTED"
    retrieval: str = "RECORDED"
    aggregate: str = "NONE"
    stepped: bool = False

    def digest(self) -> str:
        """SHA-256 over the four settings as key=value, joined by bars; the text form is fixed."""
        text = f"calculation_basis={self.basis}|retrieval_mode={self.retrieval}|aggregate_type={self.aggregate}|stepped={self.stepped}"
        return hashlib.sha256(text.encode()).hexdigest()


def require_comparable(*contracts: SamplingContract) -> None:
    bases = sorted({c.basis for c in contracts})
    if len(bases) > 1:
        raise IncomparableSampling(f"calculation bases differ: {', '.join(bases)}")


@dataclass(frozen=True)
class TagMeta:
    source_id: str
    point_id: str
    name: str
    unit_raw: str | None = None
    unit_canonical: str | None = None
    eng_zero: float | None = None
    eng_span: float | None = None
    sample_rate_s: float | None = None
    asset: str | None = None
    loop_id: str | None = None
    role: str | None = None
    retrieval_mode: str | None = None
    quality_codes: dict[str, str] = field(default_factory=dict)
    quality_assumed: bool = False


_KEYS = {
    "identity": dict, "name": str, "unit_raw": str, "unit_canonical": str, "eng_range_zero": float, "eng_range_span": float, "sample_rate_s": float,
    "retrieval_mode": str, "asset": str, "loop_id": str, "role": str, "quality_codes": dict, "quality_assumed": bool,
}


def meta_from_dict(doc: dict) -> TagMeta:
    """Metadata from a closed set of keys; anything else is refused with the nearest known key."""
    for key, value in doc.items():
        if key == "_comments":
            continue
        if key not in _KEYS:
            near = difflib.get_close_matches(key, _KEYS, 1)
            raise SchemaError(f"unknown metadata key {key!r}" + (f"; did you mean {near[0]!r}?" if near else ""))
        kind = _KEYS[key]
        good = isinstance(value, (int, float)) and not isinstance(value, bool) if kind is float else isinstance(value, kind)
        if value is not None and not good:
            raise SchemaError(f"metadata {key!r} must be {kind.__name__}, not {type(value).__name__}")
    identity = doc.get("identity") or {}
    if not all(isinstance(identity.get(k), str) and identity[k] for k in ("source_id", "point_id")) or not doc.get("name"):
        raise SchemaError("metadata needs identity.source_id, identity.point_id and name")
    zero, span, rate = doc.get("eng_range_zero"), doc.get("eng_range_span"), doc.get("sample_rate_s")
    if (zero is None) != (span is None):
        raise SchemaError("an engineering range needs both its zero and its span")
    if span is not None and not (math.isfinite(zero) and math.isfinite(span) and span > 0):
        raise SchemaError("an engineering span must be positive and finite")
    if rate is not None and not (math.isfinite(rate) and rate > 0):
        raise SchemaError("a sample rate must be positive and finite")
    for key, known in (("role", ROLES), ("retrieval_mode", RETRIEVALS)):
        if doc.get(key) is not None and doc[key] not in known:
            raise SchemaError(f"{key} {doc[key]!r} is none of {', '.join(known)}")
    codes = doc.get("quality_codes") or {}
    for code, severity in codes.items():
        if severity not in SEVERITIES:
            raise SchemaError(f"quality code {code!r} maps to {severity!r}, which is no severity")
    take = {k: doc.get(k) for k in ("unit_raw", "unit_canonical", "asset", "loop_id", "role", "retrieval_mode")}
    return TagMeta(identity["source_id"], identity["point_id"], doc["name"], eng_zero=zero, eng_span=span, sample_rate_s=rate, quality_codes=codes, quality_assumed=bool(doc.get("quality_assumed")), **take)
