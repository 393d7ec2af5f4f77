"""Bodies as states: equal JSON values (numbers as doubles) or, if not JSON, equal texts have equal hashes."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import xxhash


def _refuse(text: str):
    raise ValueError(text)


def _number(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise ValueError(text)  # no double, so no JSON number to the store
    return value + 0.0


_DECODER = json.JSONDecoder(parse_int=_number, parse_float=_number, parse_constant=_refuse)


def parse(body: str):
    """``(True, value)`` of a JSON text, numbers as doubles, the last of equal keys; ``(False, text)`` of any other."""
    try:
        return True, _DECODER.decode(body)
    except (ValueError, RecursionError):
        return False, body


def _hash(text: str) -> int:
    value = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
    return value - (1 << 64) if value >= 1 << 63 else value


def satellite_parts(body: str | None, satellites: dict[str, int], n: int) -> list[str | None]:
    """One text per satellite: 0 to n-1 the object's attributes by ``satellites`` (those it doesn't name go to n-1), n what is
    no object: ``T`` before a text that isn't JSON, ``J`` before other JSON; NULL where there is nothing."""
    if body is None:
        return [None] * (n + 1)
    is_json, value = parse(body)
    if not is_json or not isinstance(value, dict):
        return [None] * n + [("J" + json.dumps(value, sort_keys=True, separators=(",", ":"))) if is_json else "T" + value]
    parts: list[dict] = [{} for _ in range(n)]
    for k, v in value.items():
        parts[satellites.get(k, n - 1)][k] = v
    return [json.dumps(p, sort_keys=True, separators=(",", ":")) for p in parts] + [None]


def satellite_hashes(body: str | None, satellites: dict[str, int], n: int) -> list[int]:
    """One hash per satellite of :func:`satellite_parts`."""
    if body is None:
        return [0] * n + [1]
    return [_hash(p) if p is not None else 0 for p in satellite_parts(body, satellites, n)]


def satellites_udf(column: str, satellites: dict[str, int], n: int):
    """For ``mapInArrow``: replaces ``column`` by ``state``, the list of satellite hashes, and ``parts``, that of their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index(column)
            bodies = b.column(i).to_pylist()
            parts = [satellite_parts(x, satellites, n) for x in bodies]
            hashes = [[0] * n + [1] if x is None else [_hash(t) if t is not None else 0 for t in p] for x, p in zip(bodies, parts)]
            names = [x for x in b.schema.names if x != column]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(x)) for x in names], pa.array(hashes, pa.list_(pa.int64())), pa.array(parts, pa.list_(pa.string()))], [*names, "state", "parts"])

    return run
