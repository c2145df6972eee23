"""Plain sequential model of the run collapse: observations are applied one
at a time, in id order, exactly as the row-at-a-time procedure does (per
device). Used as the oracle of the set-based operator."""

from __future__ import annotations

import json


def canonical(text: str) -> str:
    return json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"))


def is_restart(segment, data) -> bool:
    return segment == "app" and json.loads(data).get("value") == "restart"


def collapse(observations):
    """observations: iterable of (device, id, segment, canonical data, ts).
    Returns {run_id: (device, segment, data, ts_start, ts_end, epoch, n_obs)}."""
    runs = {}
    last_restart = {}
    seg_runs = {}
    for device, oid, segment, data, ts in sorted(observations, key=lambda r: r[1]):
        restart = last_restart.get(device, -1)
        cand = [r for r in seg_runs.get((device, segment), []) if r > restart]
        last = max(cand) if cand else None
        if last is None or runs[last][2] != data:
            runs[oid] = [device, segment, data, ts, ts, restart, 1]
            seg_runs.setdefault((device, segment), []).append(oid)
            if last is not None:
                runs[last][4] = ts
            if is_restart(segment, data):
                last_restart[device] = oid
        else:
            runs[last][4] = ts
            runs[last][6] += 1
    return {k: tuple(v) for k, v in runs.items()}
