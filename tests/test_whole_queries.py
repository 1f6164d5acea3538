"""Registered queries without SQL, over their whole tables, against plain models that share no code with the library."""

import math

import pytest

from tesserae.plans import images
from tesserae.plans.derived import palette, pixels

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rasters(spark):
    """{grid_id: {(row, col): (r, g, b, a)}}"""
    out = {}
    for p in pixels(spark, SF).collect():
        out.setdefault(p.grid_id, {})[p.row, p.col] = (p.r, p.g, p.b, p.a)
    return out


@pytest.fixture(scope="module")
def colours(spark):
    return [(p.code, p.r, p.g, p.b) for p in palette(spark).orderBy("idx").collect()]


def _far(c, p):
    luma = lambda x: x[0] * 0.299 + x[1] * 0.587 + x[2] * 0.114
    out = 0.0
    for x, y, w in zip(c, p, (0.95, 1.18, 1.05), strict=True):
        out += (x - y) * (x - y) * w
    out += (luma(c) - luma(p)) * (luma(c) - luma(p)) * 0.85
    spread = lambda x: max(x) - min(x)
    green = lambda x: x[1] - max(x[0], x[2])
    if spread(c) < 28 and spread(p) > 45:
        out += (spread(p) - spread(c)) * (spread(p) - spread(c)) * 0.45
    if green(c) < 8 and green(p) > 18:
        out += green(p) * green(p) * 1.8
    return out


def _nearest(c, colours):
    return min(range(len(colours)), key=lambda i: (_far(c, colours[i][1:]), i))


def _codes(df):
    return {(r.grid_id, r.row, r.col): r.code for r in df.collect()}


def test_dither(spark, rasters, colours):
    import struct

    single = lambda x: struct.unpack("f", struct.pack("f", x))[0]
    want = {}
    for g, cells in rasters.items():
        held = {k: [float(x) for x in v[:3]] for k, v in cells.items()}
        for (y, x), (*_, a) in sorted(cells.items()):
            if a < 24:
                want[g, y, x] = None
                continue
            value = [math.floor(min(255, max(0, v)) / 8 + 0.5) * 8 for v in held[y, x]]
            k = _nearest(value, colours)
            want[g, y, x] = colours[k][0]
            for dy, dx, part in ((0, 1, 7), (1, -1, 3), (1, 0, 5), (1, 1, 1)):
                if (y + dy, x + dx) in held:
                    to = held[y + dy, x + dx]
                    to[:] = [single(v + (value[i] - colours[k][1 + i]) * part / 16) for i, v in enumerate(to)]
    assert _codes(images.dither(spark, SF)) == want


def test_leader_cluster(spark, rasters):
    want = {}
    for g, cells in rasters.items():
        clusters, owner = [], {}
        for at, (*c, a) in sorted(cells.items()):
            if a < 24:
                continue
            for k, (s, n) in enumerate(clusters):
                if math.sqrt(sum((x / n - y) ** 2 for x, y in zip(s, c, strict=True))) <= 38:
                    break
            else:
                k = len(clusters)
                clusters.append(([0, 0, 0], 0))
            s, n = clusters[k]
            clusters[k] = ([x + y for x, y in zip(s, c, strict=True)], n + 1)
            owner[at] = k
        kept = [k for k, (_, n) in enumerate(clusters) if n >= 3] or [max(range(len(clusters)), key=lambda k: clusters[k][1])]
        name = {k: "#" + "".join(f"{math.floor(x / clusters[k][1] + 0.5):02X}" for x in clusters[k][0]) for k in kept}
        order = {k: f"C{i + 1}" for i, k in enumerate(sorted(kept, key=lambda k: (-clusters[k][1], name[k])))}
        want |= {(g, *at): (order.get(k), name.get(k)) for at, k in owner.items()}
    assert {(r.grid_id, r.row, r.col): (r.code, r.hex) for r in images.leader_cluster(spark, SF).collect()} == want


def _limited(cells, colours, most):
    """cells {at: code} with at most so many codes."""
    rgb = {c[0]: c[1:] for c in colours}
    count = {}
    for code in cells.values():
        count[code] = count.get(code, 0) + 1
    codes = sorted(count, key=lambda c: (-count[c], c))
    if len(codes) <= most:
        return dict(cells)
    square = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    seeds = [codes[0]]
    while len(seeds) < most:
        gain = [min(square(rgb[c], rgb[s]) for s in seeds) * math.log2(count[c] + 1) for c in codes]
        if max(gain) <= 0:
            break
        seeds.append(codes[gain.index(max(gain))])
    means = [tuple(map(float, rgb[s])) for s in seeds]
    for _ in range(8):
        own = [[] for _ in means]
        for c in codes:
            own[min(range(len(means)), key=lambda k: square(rgb[c], means[k]))].append(c)
        means = [tuple(sum(rgb[c][i] * count[c] for c in cs) / sum(count[c] for c in cs) for i in range(3)) if cs else m for m, cs in zip(means, own, strict=True)]
    keep = []
    for m in means:
        c = min(codes, key=lambda c: (square(rgb[c], m), -count[c]))
        if c not in keep:
            keep.append(c)
    keep += [c for c in codes if c not in keep][: most - len(keep)]
    to = {c: min(keep, key=lambda k: (_far(rgb[c], rgb[k]), keep.index(k))) for c in codes}
    return {at: to[c] for at, c in cells.items()}


def _around(at, cells, box):
    y, x = at
    near = [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)] if box else [(y + 1, x), (y - 1, x), (y, x + 1), (y, x - 1)]
    return [p for p in near if p in cells]


def _smoothed(cells):
    out = {}
    for at, code in cells.items():
        votes = {}
        for p in _around(at, cells, True):
            votes[cells[p]] = votes.get(cells[p], 0) + 1
        top = min(votes, key=lambda c: (-votes[c], c))
        out[at] = top if votes[top] >= 4 and votes[top] > votes.get(code, 0) + 1 else code
    return out


def _without_small(cells, least):
    out, done = dict(cells), set()
    for at in cells:
        if at in done:
            continue
        region, todo = {at}, [at]
        while todo:
            for p in _around(todo.pop(), cells, False):
                if p not in region and cells[p] == cells[at]:
                    region.add(p)
                    todo.append(p)
        done |= region
        votes = {}
        for p in region:
            for q in _around(p, cells, False):
                if cells[q] != cells[at]:
                    votes[cells[q]] = votes.get(cells[q], 0) + 1
        if len(region) < least and votes:
            best = min(votes, key=lambda c: (-votes[c], c))
            out |= dict.fromkeys(region, best)
    return out


@pytest.mark.parametrize("name", ["colour_limit", "optimised_grid"])
def test_limited_colours(spark, rasters, colours, name):
    want, known = {}, {}
    for g, cells in rasters.items():
        codes = {}
        for at, (*c, _) in cells.items():
            if tuple(c) not in known:
                known[tuple(c)] = colours[_nearest(c, colours)][0]
            codes[at] = known[tuple(c)]
        made = _limited(codes, colours, 12) if name == "colour_limit" else _without_small(_smoothed(_limited(codes, colours, 16)), 4)
        want |= {(g, *at): c for at, c in made.items()}
    assert _codes(images.QUERIES[name](spark, SF)) == want


class _Table:
    """A table's timer, as a person with a watch would keep it."""

    def __init__(self):
        self.total, self.running, self.stopped, self.ends, self.left = 3600, False, False, None, 0

    def do(self, now, action, minutes):
        cap = lambda s: min(86_400, max(0, s))
        refused = False
        if action == "start":
            wanted = cap(self.left if self.stopped and self.left else self.total)
            refused = wanted == 0
            if not refused:
                self.running, self.stopped, self.ends, self.left = True, False, now + wanted, 0
        elif action == "pause" and self.running and not self.stopped:
            self.left, self.ends, self.stopped = cap(self.ends - now), None, True
        elif action == "set_total":
            self.total = cap(minutes * 60)
            if not self.running:
                self.left, self.ends, self.stopped = 0, None, False
            elif self.stopped:
                self.left = self.total
            else:
                self.ends = now + self.total
        elif action in ("add_time", "sub_time"):
            more = minutes * 60 if action == "add_time" else -minutes * 60
            if not self.running:
                self.total = cap(self.total + more)
            elif self.stopped:
                self.left = cap(self.left + more)
            else:
                self.ends += more
        late = self.running and not self.stopped and self.ends <= now
        return ("OVERTIME" if late else "RUNNING" if self.running else "IDLE", self.total, self.ends, self.left, self.stopped, refused)


def test_timer_fsm(spark):
    tables, want = {}, {}
    for c in sorted(images._commands(spark, SF).collect(), key=lambda c: (c.ts, c.event_id)):
        want[c.event_id] = tables.setdefault(c.table_id, _Table()).do(c.ts, c.action, c.minutes)
    got = {r.event_id: (r.status, r.total, r.end, r.left, r.paused, r.refused) for r in images.timer_fsm(spark, SF).collect()}
    assert got == want and len({w[0] for w in want.values()}) == 3


class _Desk:
    """A desk, kept as a list of what has happened to it."""

    def __init__(self):
        self.log = []

    def do(self, now, action, minutes):
        at_work = bool(self.log)
        countdown = at_work and self.log[0][1] is not None
        paused = at_work and self.log[-1][0] == "pause"
        if action == "start" and not at_work:
            self.log = [("start", minutes, now)]
        elif action == "add" and countdown and not paused and minutes:
            self.log.append(("add", minutes, now))
        elif (action == "pause" and at_work and not paused) or (action == "resume" and paused):
            self.log.append((action, None, now))
        elif action == "adjust" and countdown and minutes and minutes > 0:
            # Adjusting while paused leaves the pause on.
            self.log.insert(len(self.log) - paused, ("adjust", minutes, now))
        elif action == "finish" and at_work:
            bill = self._bill(now)
            self.log = []
            return ("empty", True, *bill)
        return ("running" if self.log else "empty", False, None, None, None)

    def _bill(self, now):
        hour = lambda t: int(t // 3600) % 24
        late = lambda t: hour(t) >= 21
        _, minutes, start = self.log[0]
        end = None if minutes is None else start + 60 * minutes
        fee, idle, since = 0.0, 0, None
        for what, m, t in self.log[1:]:
            if what == "add":
                end = max(end, t) + 60 * m
                fee += ((30 if late(t) else 10) if m == 30 else (50 if late(t) else 20))
            elif what == "adjust":
                end = t + 60 * m
            elif what == "pause":
                since = t
            else:
                idle, end, since = idle + t - since, None if end is None else end + t - since, None
        stop = now if since is None else since
        over = 0 if end is None else max(0, stop - end)
        if over > 600:
            blocks = math.ceil(math.ceil(over / 60) / 30)
            fee += blocks // 2 * (50 if late(end) else 20) + blocks % 2 * (30 if late(end) else 10)
        return math.ceil(max(0, stop - start - idle) / 60), over, fee


def test_desk_fsm(spark):
    desks, want = {}, {}
    names = {"start": "start", "add_time": "add", "set_total": "finish", "sub_time": "adjust"}
    for c in sorted(images._commands(spark, SF).collect(), key=lambda c: (c.ts, c.event_id)):
        action = names.get(c.action) or ("pause" if c.event_id % 2 == 0 else "resume")
        want[c.event_id] = desks.setdefault(c.table_id, _Desk()).do(c.ts, action, c.minutes)
    got = {r.event_id: (r.status, r.closed, r.minutes, r.over, r.fee) for r in images.desk_fsm(spark, SF).collect()}
    assert got == want and any(w[1] for w in want.values())


def test_crc_hash(spark):
    import zlib

    from tesserae.plans import texts

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    assert {r.doc_id: r.crc for r in texts.crc_hash(spark, SF).collect()} == {i: zlib.crc32(t.encode()) for i, t in docs.items()}
