"""Operators on ordered rows against plain models, and odd rows."""

import random

import numpy as np
import pytest

from concordia.operators import sequence as S


def model_strips(ys, width, height, rows=10, overlap=1):
    """Header and strips of one page, from the rules."""
    ys = sorted(set(ys))
    gaps = np.diff(ys)
    if len(ys) < 5:
        head = int(height * 0.12)
    else:
        med = float(np.median(gaps))
        ok, best, at = [abs(g - med) <= 0.25 * med for g in gaps], (0, None), 0
        for i, x in enumerate(ok):
            at = at if x and i and ok[i - 1] else i
            if x and i - at + 1 > best[0]:
                best = (i - at + 1, at)
        head = int(ys[best[1]]) if best[0] >= 3 else int(ys[2])
    body = [y for y in ys if y >= head]
    out = []
    if len(body) < rows + 1:
        n = max(1, int(round((height - head) / (height * 0.18))))
        step = (height - head) // n
        for i in range(n):
            out.append((max(head, head + i * step - (int(step * 0.1) if i else 0)), height if i == n - 1 else head + (i + 1) * step))
        return head, out
    for start in range(0, len(body) - 1, rows - overlap):
        end = min(start + rows, len(body) - 1)
        if body[end] - body[start] >= 20:
            out.append((body[start], body[end]))
        if end >= len(body) - 1:
            break
    return head, out


def model_run(ys):
    gaps = np.diff(sorted(set(ys)))
    gaps = gaps[gaps > 5]
    if len(set(ys)) < 4 or len(gaps) < 3:
        return 0, None
    med, best, run = float(np.median(gaps)), 0, 0
    for g in gaps:
        run = run + 1 if abs(g - med) <= 0.25 * med else 0
        best = max(best, run)
    return best, int(med)


def test_grids_of_random_pages(spark):
    rng = random.Random(2)
    pages, rows = [], []
    for p in range(60):
        width, height, step = rng.randrange(200, 4000), rng.randrange(900, 3000), rng.choice([25, 40, 61])
        pages.append((p, width, height))
        y = rng.randrange(5, 60)
        for _ in range(rng.choice([0, 1, 3, 4, 6, 15, 30])):
            rows.append((p, y))
            if rng.random() < 0.1:
                rows.append((p, y))
            y += step + rng.randrange(-4, 5) if rng.random() < 0.85 else rng.randrange(1, 90)
            if y > height:
                break
    lines, sizes = spark.createDataFrame([*rows, (1, None)], "page long, y int").repartition(3), spark.createDataFrame(pages, "page long, width int, height int")
    by = {p: [y for q, y in rows if q == p] for p, _, _ in pages}
    got = {r["page"]: r["longest"] for r in S.regularity(lines).collect()}
    assert got == {p: model_run(ys)[0] for p, ys in by.items() if ys or p == 1}
    assert {r["page"]: r["height"] for r in S.line_height(lines, sizes).collect()} == {p: model_run(by[p])[1] or max(20, w // 50) for p, w, _ in pages}
    want = {p: model_strips(by[p], w, h) for p, w, h in pages}
    assert {r["page"]: r["header"] for r in S.header_end(lines, sizes).collect()} == {p: x[0] for p, x in want.items()}
    strips = {}
    for r in sorted(S.strips(lines, sizes).collect()):
        strips.setdefault(r["page"], []).append((r["top"], r["bottom"]))
    assert strips == {p: x[1] for p, x in want.items() if x[1]}
    assert S.strips(lines.limit(0), sizes.limit(0)).count() == 0


def test_peaks(spark):
    rng = np.random.default_rng(4)
    for _ in range(200):
        n, apart = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        raw = rng.integers(0, 40, n) * (rng.random(n) < 0.3)
        got = S.peaks(raw, 100, apart)
        smooth = np.convolve(raw.astype(float), np.ones(3) / 3, mode="same").astype(np.float32)[:n]
        spots = [i for i in range(n) if smooth[i] >= max(smooth[max(0, i - apart) : i + apart + 1]) - 1e-3 and smooth[i] >= 5] if raw.max() > 0 else []
        kept = []
        for i in sorted(spots, key=lambda i: -smooth[i]):
            if all(abs(i - k) >= apart for k in kept):
                kept.append(i)
        if len(kept) >= 5:
            least = 0.4 * float(np.median(smooth[kept]))
            kept = [i for i in kept if smooth[i] >= least]
        assert got == sorted(kept)
    profile = [0.0] * 30 + [60.0] * 3 + [0.0] * 30 + [55.0] * 3
    df = spark.createDataFrame([(1, profile, 60), (2, None, 60), (3, [], 60)], "page long, profile array<double>, length int")
    assert sorted(map(tuple, S.projection_peaks(df, 3).collect())) == [(1, 31), (1, 64)]


def test_outcome_of_polls(spark):
    rows = {
        "settled": [("a", 0), ("b", 5), ("b", 9)], "quiet": [("", 0), ("", 20), ("x", 31), ("x", 33)], "total": [("a", 1), ("b", 100), ("c", 119), ("c", 121)],
        "late": [("a", 10), ("", 50), ("a", 130)], "blank": [("", 0)], "on time": [("", 0), ("q", 30), ("q", 40)],
    }
    polls = spark.createDataFrame([(k, i, s, t) for k, v in rows.items() for i, (s, t) in enumerate(v)], "key string, seq int, snap string, at int")
    got = {r["key"]: (r["how"], r["text"]) for r in S.outcome(polls).collect()}
    assert got == {"settled": ("settled", "b"), "quiet": ("quiet", ""), "total": ("total", "c"), "late": ("total", "a"), "blank": ("quiet", ""), "on time": ("settled", "q")}


def test_gathered_with_dead_readers(spark):
    rows = [(1, "a", 3, "late"), (1, "a", 1, "early"), (1, "b", 2, "bee"), (2, "a", 1, "only"), (3, "c", 1, "sea"), (3, "a", 2, None), (3, "b", 4, "x")]
    reports = spark.createDataFrame(rows, "key long, witness string, seq int, text string")
    whole = lambda **k: {(r["key"], r["witness"]): (r["text"], r["seq"]) for r in S.gathered(reports, ("a", "b", "c"), **k).collect()}
    assert whole() == {(3, "a"): ("", 2), (3, "b"): ("x", 4), (3, "c"): ("sea", 1)}
    assert whole(dead=("c",)) == {(1, "a"): ("early", 1), (1, "b"): ("bee", 2), (1, "c"): ("", None), (3, "a"): ("", 2), (3, "b"): ("x", 4), (3, "c"): ("sea", 1)}
    assert len(whole(dead=("b", "c"))) == 9 and S.gathered(reports.limit(0), ("a",)).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_layout_against_a_model(spark, seed):
    rng = random.Random(seed)
    boxes = [(p, i, f"w{i}", rng.randrange(0, 200), rng.randrange(0, 90), rng.randrange(1, 60), rng.choice([0, 5, 12, 40]), rng.randrange(100)) for p in range(30) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame([*boxes, (1, 99, " ", 1, 1, 1, 1, 1), (1, 98, "x", None, 1, 1, 1, 1)], "page long, seq int, word string, left int, top int, width int, height int, conf int").repartition(3)
    for least in (0, 50):
        want = []
        for p in range(30):
            mine = [b for b in boxes if b[0] == p and (not least or b[7] >= least)]
            if not mine:
                continue
            m = sorted(b[6] for b in mine)[len(mine) // 2] or 20
            rows, last = [], None
            for b in sorted(mine, key=lambda b: (b[4], b[1])):
                if last is None or abs(b[4] - last) > max(6, m // 2):
                    rows.append([])
                rows[-1].append(b)
                last = b[4]
            for n, row in enumerate(rows):
                row.sort(key=lambda b: (b[3], b[4], b[1]))
                text = row[0][2]
                for a, b in zip(row, row[1:]):
                    gap = b[3] - a[3] - a[5]
                    text += ("" if gap <= 2 else "\t" if gap >= 4 * max(4, m // 2) else " ") + b[2]
                want.append((p, n, text))
        assert sorted(map(tuple, S.layout(df, least).collect())) == want
