"""Random report bodies, many of an odd shape, against plain Python."""

import json
import random

from conftest import lines_frame

import hangstats as hs
from hangstats.operators.reports import ping_counts

ODD = [None, 5, 2.5, "x", "", [], {}, [1], {"a": 1}, True, 2**70, [None, "y"]]


def maybe(rng, odds, value):
    return rng.choice(ODD) if rng.random() < odds else value


def make_body(rng, odds):
    def values():
        labels = rng.sample(["1", "2", "4", "8", "abc", "-3", ""], rng.randrange(4))
        return {label: maybe(rng, odds, rng.randrange(-1, 5)) for label in labels}

    def hang():
        stack = [maybe(rng, odds / 3, rng.choice("abc")) for _ in range(rng.randrange(4))]
        stack = [f if isinstance(f, (str, int, type(None))) and f is not True else "z" for f in stack]
        parts = {
            "stack": maybe(rng, odds, stack),
            "histogram": maybe(rng, odds, {"sum": 3, "values": maybe(rng, odds, values())}),
            "extra": [1, {"stack": ["no"]}],
        }
        return {key: part for key, part in parts.items() if rng.random() > odds}

    def thread():
        hangs = [maybe(rng, odds, hang()) for _ in range(rng.randrange(4))]
        parts = {
            "name": maybe(rng, odds, rng.choice(["Gecko", "Other"])),
            "hangs": maybe(rng, odds, hangs),
        }
        return {key: part for key, part in parts.items() if rng.random() > odds}

    body = {
        "info": {"threadHangStats": [], "uptime": 1},
        "simpleMeasurements": maybe(rng, odds, {"uptime": maybe(rng, odds, rng.randrange(99))}),
        "threadHangStats": maybe(
            rng, odds, [maybe(rng, odds, thread()) for _ in range(rng.randrange(4))]
        ),
    }
    return maybe(rng, odds / 3, body)


def is_integer(value):
    return type(value) is int and -(2**63) <= value < 2**63


def field(value, name, kind):
    found = value.get(name) if isinstance(value, dict) else None
    return found if isinstance(found, kind) else None


def expected_hangs(body):
    uptime = field(field(body, "simpleMeasurements", dict), "uptime", int)
    uptime = uptime if type(uptime) is int else None  # (2**70 is one)
    for thread_pos, thread in enumerate(field(body, "threadHangStats", list) or []):
        if field(thread, "name", str) != "Gecko":
            continue
        for hang_pos, hang in enumerate(field(thread, "hangs", list) or []):
            stack = field(hang, "stack", list)
            values = field(field(hang, "histogram", dict), "values", dict)
            if stack is None or values is None:
                continue
            frames = [json.dumps(f) if isinstance(f, (int, float)) else f for f in stack]
            bins = sorted((label, n) for label, n in values.items() if is_integer(n))
            yield uptime, thread_pos, hang_pos, frames, bins


def test_hang_rows_equal_plain_python(spark):
    rng = random.Random(11)
    bodies = [make_body(rng, rng.choice([0, 0, 0.03, 0.2])) for _ in range(1500)]
    texts = [json.dumps(body, ensure_ascii=False) for body in bodies]
    cut = {i for i in range(len(texts)) if rng.random() < 0.1 and isinstance(bodies[i], dict)}
    lines = [
        f"{i:036d}\t" + (text[: rng.randrange(len(text))] if i in cut else text)
        for i, text in enumerate(texts)
    ]
    reports = hs.read_reports(lines_frame(spark, lines)).cache()
    assert tuple(ping_counts(reports).first()) == (len(lines) - len(cut), len(cut))
    found = {}
    for row in hs.hang_rows(reports).collect():
        entry = (row.uptime, row.thread_pos, row.hang_pos, row.stack, sorted(map(tuple, row.bins)))
        found.setdefault(int(row.ping_id), []).append(entry)
    reports.unpersist()
    for i, body in enumerate(bodies):
        wanted = [] if i in cut else list(expected_hangs(body))
        assert sorted(found.get(i, []), key=lambda e: e[1:3]) == wanted, texts[i]
