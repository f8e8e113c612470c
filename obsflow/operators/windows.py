"""Replay and cost of incidents, worked out by groups of incidents that overlap.

Incidents whose windows end in the same bin of time share most of their events.
A group takes its events once, not once for each incident, and counts each
incident's events apart, over arrays. A group with very many events, and an
incident id that stands for several windows, go the way of frozen rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from obsflow.functions import exprs as X
from obsflow.operators.cardinality import ALPHA, EXACT, REGISTERS
from obsflow.operators.intervals import interval_join
from obsflow.schema import CONTROL, Policy
from obsflow.staging import stage

KEY = ["tenant_id", "incident_id"]
#: Seconds of a group's bin, events of a group that a task takes at once, and events of a shuffle partition.
BIN, HELD, DEALT = 900, 200_000, 50_000
LOST = ("drop_tag", "quarantine")


def by_groups(incidents: DataFrame, captures: DataFrame, of_group: Callable, schema: str, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """What ``of_group`` makes of each group of incidents, and the incidents that are left for another way, if any.

    ``of_group`` gets two Arrow tables: incidents (tenant_id, incident_id, _from, _to) and
    events, by time and id (``columns``, _id, _us, _hour, _captured, _before). An event's _before
    is its capture before the one at _captured; it counts in windows that begin after that.
    """
    spans = incidents.select(*KEY, "frozen_from", "frozen_to").withColumn("_group", F.floor(F.unix_micros("frozen_to") / (BIN * 1_000_000)))
    spans = stage(spans.withColumn("_same", F.count(F.lit(1)).over(W.partitionBy(*KEY))), "group-incidents")
    by = ["tenant_id", "_group"]
    # Of a group only its whole span is joined, so the bins of an event are few.
    whole = stage(spans.where("_same = 1").groupBy(*by).agg(F.min("frozen_from").alias("_a"), F.max("frozen_to").alias("_b")), "group-spans")
    few = whole.limit(100_001).count() <= 100_000
    before = F.lag("captured_at").over(W.partitionBy("tenant_id", "event_id").orderBy("captured_at"))
    rows = captures.select("tenant_id", "captured_at", F.unix_micros(before).alias("_before"), F.unix_micros("captured_at").alias("_captured"), F.col("event_id").alias("_id"), F.unix_micros("event_time").alias("_us"), F.unix_micros(F.date_trunc("hour", "event_time")).alias("_hour"), *columns)

    def inside(rows: DataFrame) -> DataFrame:
        return interval_join(whole, rows, ["tenant_id"], F.col("_a"), F.col("_b"), F.col("captured_at"), BIN, few=few).drop("_a", "_b", "captured_at")

    sizes = stage(inside(captures.select("tenant_id", "captured_at")).groupBy(*by).count(), "group-sizes")
    total, most = sizes.agg(F.sum("count"), F.max("count")).collect()[0]
    own, left = spans.where("_same = 1"), spans.where("_same > 1")
    members = inside(rows)
    if (most or 0) > HELD:
        hot = sizes.where(F.col("count") > HELD).select(*by)
        left = left.unionByName(own.join(hot, by, "left_semi"))
        own, members = own.join(hot, by, "left_anti"), members.join(hot, by, "left_anti")
    n = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil((total or 0) / DEALT))
    own = own.select(*by, "incident_id", F.unix_micros("frozen_from").alias("_from"), F.unix_micros("frozen_to").alias("_to"))

    def run(found: pa.Table, events: pa.Table) -> pa.Table:
        return of_group(found, events.take(pc.sort_indices(events, [("_us", "ascending"), ("_id", "ascending")])))

    out = own.repartition(n, *by).groupBy(*by).cogroup(members.repartition(n, *by).groupBy(*by)).applyInArrow(run, schema)
    left = left.select(*KEY, "frozen_from", "frozen_to")
    return out, left if left.limit(1).count() else None


def _codes(values: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, list]:
    """Numbers of the distinct values, nulls included, and those values."""
    found = pc.dictionary_encode(values, null_encoding="encode")
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary.to_pylist()


def _hits(pattern: str, value: str | None) -> bool:
    regex = X.glob_regex(pattern)
    return regex is None or (value is not None and re.search(regex, value) is not None)


class Tags:
    """The tags of a group's events in flat arrays, with what a key's running counts need, worked out once for all incidents."""

    def __init__(self, events: pa.Table):
        tags = events.column("tags").combine_chunks()
        tags = tags if isinstance(tags, pa.MapArray) else tags.chunk(0)
        self.us, hour = (events.column(c).to_numpy() for c in ("_us", "_hour"))
        source, self.sources = _codes(events.column("source"))
        kind, self.kinds = _codes(events.column("event_type"))
        self.kind = source * max(len(self.kinds), 1) + kind
        ends = tags.offsets.to_numpy()  # taken rows: a null map has no entries
        sizes = np.diff(ends)
        self.event = np.repeat(np.arange(len(sizes)), sizes)
        self.dim, self.dims = _codes(tags.keys.slice(ends[0], ends[-1] - ends[0]))
        self.value, self.values = _codes(tags.items.slice(ends[0], ends[-1] - ends[0]))
        what = self.kind[self.event] * max(len(self.dims), 1) + self.dim
        _, self.what = np.unique(what, return_inverse=True)
        _, self.key = np.unique(np.stack([self.what, hour[self.event]]), axis=1, return_inverse=True)
        self.key = self.key.ravel()
        self.by_key = np.argsort(self.key, kind="stable")
        self.by_value = np.lexsort((self.event, self.value, self.key))
        self.cells: dict[int, tuple[int, int]] = {}

    def judged(self, policy: Policy) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Threshold, action and whether it is dangerous, for each tag."""
        _, at, back = np.unique(self.what, return_index=True, return_inverse=True)
        told = []
        for i in at:
            source, kind = divmod(int(self.kind[self.event[i]]), max(len(self.kinds), 1))
            source, kind, dim = self.sources[source], self.kinds[kind], self.dims[self.dim[i]]
            rule = next((r for r in policy.rules if _hits(r.source, source) and _hits(r.type, kind) and _hits(r.dimension, dim)), None)
            threshold, action = (rule.unique_threshold, rule.action) if rule else (policy.default_unique_threshold, policy.default_action)
            told.append((threshold, action, any(k.strip().lower() in dim.lower() for k in policy.dangerous_keys if k.strip())))
        back = back.ravel()
        one = lambda i, kind: np.array([t[i] for t in told], dtype=kind)[back] if told else np.zeros(0, dtype=kind)
        return one(0, np.int64), one(1, object), one(2, bool)

    def _registers(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Register and rank of values; a null has rank 0."""
        for v in np.unique(values).tolist():
            if v not in self.cells:
                text = self.values[v]
                h = 0 if text is None else int.from_bytes(hashlib.sha256(text.encode()).digest()[:8])
                rest = h >> 6
                rank = 0 if text is None else 59 if rest == 0 else min((rest & -rest).bit_length(), 59)
                self.cells[v] = (h & (REGISTERS - 1), rank)
        found = np.array([self.cells[v] for v in values.tolist()], dtype=np.int64).reshape(-1, 2)
        return found[:, 0], found[:, 1]

    def counted(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tags of the chosen events by key and time, with observed and projected up to and with each."""
        mine = chosen[self.event]
        rows, by_value = self.by_key[mine[self.by_key]], self.by_value[mine[self.by_value]]
        first = np.zeros(len(self.event), dtype=np.int64)
        k, v = self.key[by_value], self.value[by_value]
        first[by_value] = np.concatenate([[True], (k[1:] != k[:-1]) | (v[1:] != v[:-1])])[: len(by_value)]
        k = self.key[rows]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])[: len(k)])
        sizes = np.diff(np.append(starts, len(k)))
        begin = np.repeat(starts, sizes)
        exact = _within(first[rows], begin)
        observed = exact.copy()
        many = np.repeat(exact[starts + sizes - 1] > EXACT, sizes) if len(starts) else np.zeros(0, dtype=bool)
        if many.any():
            guess = self._sketched(rows[many])
            observed[many] = np.where(exact[many] > EXACT, guess, exact[many])
        at = self.us[self.event[rows]]
        elapsed = (at - at[begin]) / 1e6
        fit = (elapsed >= 30) & (elapsed < 3600) & (np.arange(len(rows)) - begin + 1 >= 10)
        ahead = np.ceil(observed * 3600.0 / np.where(fit, elapsed, 1.0)).astype(np.int64)
        return rows, observed, np.where(fit, np.maximum(ahead, observed), observed)

    def _sketched(self, rows: np.ndarray) -> np.ndarray:
        """The estimate after each row, of rows by key and time: a register's change of its term telescopes."""
        register, rank = self._registers(self.value[rows])
        k = self.key[rows]
        cell = k * REGISTERS + register
        order = np.argsort(cell, kind="stable")
        _, place = np.unique(cell[order], return_inverse=True)
        top = np.maximum.accumulate(place.ravel() * 64 + rank[order])
        before = np.concatenate([[0], top[:-1] - place.ravel()[:-1] * 64])
        before[np.concatenate([[True], place.ravel()[1:] != place.ravel()[:-1]])] = 0
        up = rank[order] > before
        ds, dz = np.zeros(len(rows)), np.zeros(len(rows), dtype=np.int64)
        ds[order] = np.where(up, np.exp2(-rank[order].astype(float)) - np.exp2(-before.astype(float)), 0.0)
        dz[order] = up & (before == 0)
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        begin = np.repeat(starts, np.diff(np.append(starts, len(k))))
        inverse, zeros = REGISTERS + _within(ds, begin), REGISTERS - _within(dz, begin)
        raw = ALPHA * REGISTERS * REGISTERS / inverse
        small = (raw <= 2.5 * REGISTERS) & (zeros > 0)
        raw = np.where(small, REGISTERS * np.log(REGISTERS / np.maximum(zeros, 1)), raw)
        return np.maximum(np.floor(raw + 0.5), 1).astype(np.int64)


def _within(steps: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Running sums of steps, each from its own begin."""
    total = np.cumsum(steps)
    return total - (total - steps)[begin]


def _acts(rules: tuple, rows: np.ndarray, observed: np.ndarray, projected: np.ndarray) -> np.ndarray:
    """The action of each tag, or None without a finding."""
    threshold, action, dangerous = (r[rows] for r in rules)
    crossed = (observed >= threshold) | (projected >= threshold)
    early = dangerous & (observed >= np.maximum(3, threshold // 10)) & ~crossed
    return np.where(crossed, action, np.where(early, "allow", None))


def _spaced(key: np.ndarray, us: np.ndarray, gap: int = 60) -> np.ndarray:
    """Places kept by a greedy walk of each key: the first, then each ``gap`` seconds or more after the last kept; rows are by key and time."""
    if not len(key):
        return np.zeros(0, dtype=np.int64)
    width = gap * 1_000_000
    new = np.concatenate([[True], key[1:] != key[:-1]])
    place = np.cumsum(new) - 1
    at = place * (int(us.max() - us.min()) + 2 * width) + us - us.min()
    here, kept = np.flatnonzero(new), []
    while len(here):
        kept.append(here)
        onward = np.searchsorted(at, at[here] + width)
        inside = onward < len(at)
        inside[inside] = place[onward[inside]] == place[here[inside]]
        here = onward[inside]
    return np.concatenate(kept)


def _chosen(events: pa.Table) -> Callable:
    at = events.column("_captured").to_numpy()
    before = pc.fill_null(events.column("_before"), np.iinfo(np.int64).min).to_numpy()
    return lambda start, end: (at >= start) & (at <= end) & (before < start)


def replay_group(active: Policy, shadow: Policy | None, totals: bool) -> Callable:
    """For :func:`by_groups`: what a replay does with each event of each incident, or the totals of each."""

    def run(found: pa.Table, events: pa.Table) -> pa.Table:
        tags, chosen, out = Tags(events), _chosen(events), []
        rules, others = tags.judged(active), tags.judged(shadow) if shadow else None
        n = len(events)
        for tenant, incident, start, end in zip(*(found.column(c).to_pylist() for c in (*KEY, "_from", "_to")), strict=True):
            mask = chosen(start, end)
            if not mask.any():
                continue
            rows, observed, projected = tags.counted(mask)
            act = _acts(rules, rows, observed, projected)
            event = tags.event[rows]
            count = lambda of: np.bincount(of, minlength=n)
            told = np.flatnonzero(act != None)  # noqa: E711
            # Reports are spaced by source, type, dimension and action, over hours.
            names, action = np.unique(act[told].astype(str), return_inverse=True)
            key = tags.what[rows[told]] * max(len(names), 1) + action.ravel()
            order = np.lexsort((event[told], key))
            kept = _spaced(key[order], tags.us[event[told][order]])
            dropped, held = count(event[(act == "drop_tag") | (act == "quarantine")]), count(event[act == "quarantine"]) > 0
            findings, diffs = count(event[told][order][kept]), np.zeros(n, dtype=np.int64)
            if others:
                threshold, action, _ = (r[rows] for r in others)
                theirs = np.where((observed >= threshold) | (projected >= threshold), action, "allow")
                diffs = count(event[np.where(act == None, "allow", act) != theirs])  # noqa: E711
            if totals:
                out.append((tenant, incident, int(mask.sum()), int((dropped > 0).sum()), int(dropped.sum()), int(held.sum()), int(findings.sum()), int(diffs.sum())))
            else:
                i = np.flatnonzero(mask)
                same = lambda text: pa.array([text], pa.string()).take(pa.array(np.zeros(len(i), dtype=np.int64)))
                out.append(pa.table({"tenant_id": same(tenant), "incident_id": same(incident), "event_id": events.column("_id").take(i), "changed": dropped[i] > 0, "dropped": dropped[i], "quarantined": held[i], "findings": findings[i], "shadow_diffs": diffs[i]}))
        if totals:
            return _table(out, (*KEY, *(("events", pa.int64()), ("changed", pa.int64()), ("dropped", pa.int64()), ("quarantined", pa.int64()), ("findings", pa.int64()), ("shadow_diffs", pa.int64()))))
        names = (*KEY, "event_id", ("changed", pa.bool_()), ("dropped", pa.int64()), ("quarantined", pa.bool_()), ("findings", pa.int64()), ("shadow_diffs", pa.int64()))
        return pa.concat_tables(out) if out else _table([], names)

    return run


def _table(rows: list[tuple], names: tuple) -> pa.Table:
    kinds = pa.schema([(c, pa.string()) if isinstance(c, str) else c for c in names])
    columns = zip(*rows, strict=True) if rows else ([] for _ in names)
    return pa.table([pa.array(list(c), f.type) for c, f in zip(columns, kinds, strict=True)], kinds)


#: What a cost simulation counts of each incident: the figures before they are scaled.
COUNTED = "tenant_id string, incident_id string, events long, window_seconds double, baseline_bytes long, baseline_series long, active_bytes long, active_series long, active_changed long, shadow_bytes long, shadow_series long, shadow_changed long"


def cost_group(active: Policy, shadow: Policy | None, control: str = CONTROL) -> Callable:
    """For :func:`by_groups`: bytes, series and changed events of each incident, as captured and under both policies; events carry ``bytes``."""
    size = lambda text: 0 if text is None else len(text.encode())

    def run(found: pa.Table, events: pa.Table) -> pa.Table:
        tags, chosen, out = Tags(events), _chosen(events), []
        own = events.column("bytes").to_numpy()
        n = len(events)
        line = np.array([size(d) for d in tags.dims], dtype=np.int64)[tags.dim] + np.array([size(v) for v in tags.values], dtype=np.int64)[tags.value] + len("tag.=\n") if len(tags.dim) else np.zeros(0, dtype=np.int64)
        shown = ~np.array([d.lower().startswith(control) if control else False for d in tags.dims], dtype=bool)[tags.dim] if len(tags.dim) else np.zeros(0, dtype=bool)
        marks = [control + "quarantined", control + "quarantine_dimensions"]
        mark = np.isin(tags.dim, [i for i, d in enumerate(tags.dims) if d in marks])
        fixed = size(marks[0]) + size(marks[1]) + len("true") + 2 * len("tag.=\n")
        name = np.array([size(d) for d in tags.dims], dtype=np.int64)
        # A series is its text; where no name or value has the text's own separators, a set of numbered pairs stands for it.
        texts = [tags.sources, tags.kinds, tags.values]
        plain = not any("|" in (t or "") for of in texts for t in of) and not any("|" in d or "=" in d for d in tags.dims)
        empty = next((i for i, v in enumerate(tags.values) if v == ""), None)
        value = tags.value if empty is None else np.where(np.array([v is None for v in tags.values], dtype=bool)[tags.value], empty, tags.value) if len(tags.value) else tags.value
        pair = (tags.dim * max(len(tags.values), 1) + value).astype(np.uint64)
        marked = [_mixed(pair + np.uint64(salt)) for salt in (1 << 40, 1 << 50)]
        kinds = [_mixed(tags.kind.astype(np.uint64) + np.uint64(salt)) for salt in (1 << 41, 1 << 51)]

        def series(mask: np.ndarray, lost: np.ndarray) -> int:
            on = shown & ~lost & mask[tags.event]
            if plain:
                sums = []
                for k, m in zip(kinds, marked, strict=True):
                    total = k.copy()
                    np.add.at(total, tags.event[on], m[on])
                    sums.append(total[mask])
                both = np.stack(sums, axis=1)
                return len(np.unique(both.view([("a", np.uint64), ("b", np.uint64)])))
            parts: dict[int, list] = {}
            for r in np.flatnonzero(on).tolist():
                parts.setdefault(int(tags.event[r]), []).append((tags.dims[tags.dim[r]].encode(), (tags.values[tags.value[r]] or "").encode()))
            many = max(len(tags.kinds), 1)
            head = lambda e: (tags.sources[int(tags.kind[e]) // many], tags.kinds[int(tags.kind[e]) % many])
            made = {None if None in head(e) else "|".join(head(e)).encode() + b"".join(b"|" + k + b"=" + v for k, v in sorted(parts.get(e, []))) for e in np.flatnonzero(mask).tolist()}
            return len(made - {None})

        rules = [tags.judged(p) if p else None for p in (active, shadow)]
        none = np.zeros(len(tags.event), dtype=bool)
        for tenant, incident, start, end in zip(*(found.column(c).to_pylist() for c in (*KEY, "_from", "_to")), strict=True):
            mask = chosen(start, end)
            if not mask.any():
                continue
            rows, observed, projected = tags.counted(mask)
            at = tags.us[mask]
            base = int(own[mask].sum())
            row = [tenant, incident, int(mask.sum()), max((int(at.max()) - int(at.min())) / 1e6, 1.0), base, series(mask, none)]
            for told in rules:
                if told is None:
                    row += [base, row[5], 0]
                    continue
                act = _acts(told, rows, observed, projected)
                lost, held = none.copy(), none.copy()
                lost[rows[(act == "drop_tag") | (act == "quarantine")]] = True
                held[rows[act == "quarantine"]] = True
                quarantined = np.bincount(tags.event[held], minlength=n)
                # Marks stand in place of tags that had their names.
                gone = lost | (mark & (quarantined > 0)[tags.event] & mask[tags.event])
                dims = int(name[tags.dim[held]].sum()) + int((quarantined[quarantined > 0] - 1).sum())
                bytes_ = base - int(line[gone].sum()) + dims + fixed * int((quarantined > 0).sum())
                row += [bytes_, series(mask, lost), int((np.bincount(tags.event[lost], minlength=n) > 0).sum())]
            out.append(tuple(row))
        long_ = [(c.split()[0], pa.int64()) for c in COUNTED.split(", ")[4:]]
        return _table(out, (*KEY, ("events", pa.int64()), ("window_seconds", pa.float64()), *long_))

    return run


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of numbers, one to one."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
