"""The source mix against a plain version, its schedule against counting, and its evenness."""

import hashlib
import re
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest

from newsline.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, source string, block int, slot int, start int, place string, target string"


def plain(rows):
    """(doc_id, size, source size, target, taken) by sorting each source's stream in one list."""
    streams, sizes = defaultdict(list), defaultdict(int)
    for i, text, source in rows:
        n = len(WORD.findall(text or ""))
        place = hashlib.md5(f"{'' if i is None else i}|{hashlib.md5((text or '').encode()).hexdigest()}".encode()).hexdigest()
        streams[source].append((place, -1 if i is None else i, i, n))
        sizes[source] += n
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: k % 3 + 1 for k, s in enumerate(names)}
    total, ended = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in ended)
        share = sum(weight[s] for s in names if s not in ended)
        more = {s for s in names if s not in ended and 3 * sizes[s] * share < weight[s] * left}
        if not more:
            break
        ended |= more
    out = []
    for s in names:
        target = Fraction(3 * sizes[s]) if s in ended else Fraction(weight[s] * left, share)
        goal, at = int(target + Fraction(1, 2)), 0
        for _, _, i, n in sorted(streams[s]):
            whole = n * (goal // sizes[s]) + max(0, min(at + n, goal % sizes[s]) - at) if n else 0
            out.append((str(i), n, sizes[s], round(float(target), 6), whole))
            at += n
    return sorted(out)


def made():
    rng = np.random.default_rng(4)
    sources = ["b", "a", "é", "", "Z", None, "tiny", "blank"]
    rows = []
    for i in range(160):
        s = "b" if i % 2 else sources[i % 6]
        rows.append((i, " \t".join(f"w{x}" for x in range(int(rng.integers(0, 60)))), s))
    rows += [(900, "one word two\x1cwords", "tiny"), (901, None, "blank"), (902, "", "blank"), (903, "x " * 5000, "a"), (None, "no id", "a"), (None, None, None), (7, "again", "b"), (7, "again", "b")]
    return [(i, t, s, 1, 2, 3, "p", "t") for i, t, s in rows]


@pytest.mark.parametrize("block", [1, 7, 100, mixing.BLOCK])
def test_equals_plain(spark, block):
    rows = made()
    laid, sources = mixing.laid_out(spark.createDataFrame(rows, SCHEMA))
    mix = mixing.spans(laid, sources, block)
    got = mixing.taken(laid, mix).collect()
    assert sorted((str(r.doc_id), r.size, r.source_size, round(r.target, 6), r.taken) for r in got) == plain([r[:3] for r in rows])
    assert all(r.taken <= 3 * r["size"] for r in got)
    # Spans fill each slot without gap from its first word on, in the order of the source's stream.
    slots = defaultdict(list)
    for r in mix.collect():
        slots[r.slot].append((r.at, r.words))
    for own in slots.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(n for _, n in own) <= block


def test_schedule_is_even(spark):
    """Every beginning of the schedule holds the sources in about their shares; ranks count up without a gap."""
    sources = spark.createDataFrame([(0, 4000, 0, 6000.0), (1, 9000, 0, 3000.4), (2, 0, 1, 0.0), (3, 500, 1, 1500.0), (4, 123, 1, 0.2)], "source_no long, source_size long, part int, target double")
    rows = sorted(mixing.schedule(sources, 10).collect(), key=lambda r: r.slot)
    have = defaultdict(list)
    for r in rows:
        have[r.source_no].append(r)
    assert {s: sum(r.words for r in own) for s, own in have.items()} == {0: 6000, 1: 3000, 3: 1500}
    assert [(r.epoch, r.block) for r in have[3]] == [(e, b) for e in range(3) for b in range(50)]
    assert have[0][0].epoch == 0 and have[0][-1].epoch == 1
    for upto in (50, 200, 500, 1000):
        first = [r.source_no for r in rows[:upto]]
        for s, own in have.items():
            assert abs(first.count(s) - upto * len(own) / len(rows)) <= 8


def test_counting():
    """The closed form of a slot's rank equals counting."""
    bits, low, high = 7, 21, 90
    slots = np.arange(1 << bits, dtype=np.int64)
    inside = [low <= x < high for x in mixing._mirror(slots, bits)]
    assert mixing._earlier(slots, np.int64(low), np.int64(high), bits).tolist() == np.concatenate([[0], np.cumsum(inside)[:-1]]).tolist()


def test_reruns_agree_and_empty(spark, write):
    folder = write("documents", made(), SCHEMA)
    runs = [sorted(map(str, mixing.op13_source_mix(spark, folder).collect())) for _ in range(2)]
    assert runs[0] == runs[1]
    assert mixing.op13_source_mix(spark, write("documents", [], SCHEMA)).count() == 0
    blank = write("documents", [(1, None, "a", 1, 2, 3, "p", "t"), (2, " ", None, 1, 2, 3, "p", "t")], SCHEMA)
    assert sorted((r.size, r.target, r.taken) for r in mixing.op13_source_mix(spark, blank).collect()) == [(0, 0.0, 0)] * 2
