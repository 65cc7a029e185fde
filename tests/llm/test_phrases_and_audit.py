"""Collocation mining and the filter audit against brute force."""

import itertools
import random
import re
from collections import Counter, defaultdict

import pytest

from hangstats.llm import collocations as co
from hangstats.llm import filter_audit as fa

DOCS = "doc_id bigint, text string, lang string"


def brute_collocations(rows, least, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 6):
                counts[lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        f = {p: n for p, n in f.items() if n >= least}
        found = []
        for p, a in f.items():
            if len(p) < 2:
                continue
            around = (
                f[q] for q in f if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
            )
            if any(b >= a for b in around):
                continue
            n = totals[lang]
            score, _, left, right = min(
                (1000 * a * n // (f[p[:j]] * f[p[j:]]), j, f[p[:j]], f[p[j:]]) for j in range(1, len(p))
            )
            found.append((-score, -a, " ".join(p).encode(), left, right, n))
        found.sort()
        out += [
            (lang, i + 1, p.decode(), -a, left, right, n, -s) for i, (s, a, p, left, right, n) in enumerate(found[:top])
        ]
    return sorted(out)


def collocation_rows(rng):
    words = ["a", "b", "C", "dé", "e", "F", "new", "york", "x y", "rare%d"]
    rows = []
    for i in range(150):
        text = ""
        for _ in range(rng.randint(0, 60)):
            word = rng.choices(words, [9, 8, 5, 4, 3, 2, 2, 1, 1, 1])[0].replace("%d", str(rng.randint(0, 400)))
            word = "New York city" if word == "york" else word
            text += word + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\r\n", " ;"])
        rows.append((rng.choice(["en", "en", "de", None, ""]), text))
    rows += [("en", None), (None, ""), ("en", " .. ,\n")] + [("de", "new york, new york is a hot pair " * 30)] * 3
    return rows


@pytest.mark.parametrize("positions", [40, 700, 1 << 20])
@pytest.mark.parametrize("hot", [4, 4096])
def test_collocations_equal_brute_force(spark, monkeypatch, positions, hot):
    monkeypatch.setattr(co, "HOT_WORDS", hot)
    rows = collocation_rows(random.Random(positions))
    frame = spark.createDataFrame([(i, t, lang, 1) for i, (lang, t) in enumerate(rows)], "n int, text string, lang string, k int")
    for least, top in ((3, 2000), (12, 7)):
        got = sorted(tuple(r) for r in co.collocations(frame.repartition(3), least, top, positions).collect())
        assert got == brute_collocations(rows, least, top)
        assert got


def test_collocations_of_one_long_text(spark, monkeypatch):
    monkeypatch.setattr(co, "_CUT_BYTES", 64)
    rng = random.Random(3)
    text = " ".join(rng.choice(["a", "bb", "ccc", "dddd.", "e" * 90]) for _ in range(4000))
    frame = spark.createDataFrame([("en", text)], "lang string, text string")
    got = sorted(tuple(r) for r in co.collocations(frame, 5, 300, 500).collect())
    assert got == brute_collocations([("en", text)], 5, 300)


def test_collocations_of_nothing(spark):
    empty = spark.createDataFrame([], "lang string, text string")
    assert co.collocations(empty).collect() == []
    assert co.collocations(spark.createDataFrame([("en", "only once")], "lang string, text string")).collect() == []


def test_scores_pass_64_bits(spark, monkeypatch):
    """Arithmetic on counts whose products are beyond 64 bits."""
    big = 4 * 10**15
    phrases = spark.createDataFrame(
        [("en", 1, "a", big), ("en", 1, "b", big - 1), ("en", 2, "a b", big - 7)], "lang string, k int, phrase string, f bigint"
    )
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n bigint")
    monkeypatch.setattr(co, "frequent_phrases", lambda *_: (phrases, totals))
    (row,) = co.collocations(phrases).collect()
    assert row["score"] == 1000 * (big - 7) * 9 * 10**15 // (big * (big - 1))


def brute_audit(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    rows = []
    for i, text, lang in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(words) < 100,
            "B": 100 * len(set(words)) < 80 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)),
            "E": i is not None and least[t] < i,
        }
        rows.append((lang or "", {x for x in fails if fails[x]}, i in good, i in toxic))
    out, shares = [], Counter()
    for part in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r in left if x in r[1]]
                redundant = sum(x in r[1] for r in mine) - len(gone)
                left = [r for r in left if x not in r[1]]
                shares[part, x] += len(gone)
                unique = sum(r[1] == {x} for r in mine)
                lost = sum(r[2] for r in gone), sum(r[3] for r in gone)
                out.append([part, "".join(order), step, len(left), len(gone), redundant, unique, *lost])
    return sorted((*r, shares[r[0], r[1][r[2] - 1]]) for r in out)


def audit(spark, tmp_path, docs, labels, files, per_batch, buckets=5):
    path = str(tmp_path / "documents.parquet")
    frame = spark.createDataFrame([(*d, "extra", 1) for d in docs], DOCS + ", part string, n int")
    (frame.repartition(files) if files > 1 else frame.coalesce(1)).write.parquet(path)
    known = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    report = fa.audit_filters(fa.documents_stream(spark, path, per_batch), known, buckets)
    return sorted(tuple(r) for r in report.collect())


def audit_docs(rng, n):
    texts = ["", None, "short", "Word # " * 120, " ".join(f"w{i}" for i in range(130)), "ABC DEF\x0b" * 60, "x y" * 40]
    texts += [" ".join(rng.choice(["a", "b", "C", "dd", "|"]) for _ in range(rng.randint(90, 140))) for _ in range(5)]
    ids = [*range(n), None, None, 3, 3, 2**60, 2**60 + 1]
    rng.shuffle(ids)
    return [(i, rng.choice(texts), rng.choice(["en", "de", None, ""])) for i in ids]


@pytest.mark.parametrize(("files", "per_batch"), [(6, 1), (7, 3), (1, 1)])
def test_audit_equals_brute_force(spark, tmp_path, files, per_batch):
    rng = random.Random(files)
    docs = audit_docs(rng, 120)
    labels = [(rng.choice([i, i, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)]
    labels += [(4, 1, 0), (4, 0, 1), (2**60 + 1, 1, 1)]
    assert audit(spark, tmp_path, docs, labels, files, per_batch) == brute_audit(docs, labels)


def test_audit_of_many_copies(spark, tmp_path):
    docs = [(i, "one text for all", "en") for i in range(3000, 0, -1)] + [(7, "one text for all", "de")] * 50
    assert audit(spark, tmp_path, docs, [(1, 1, 0)], 5, 1) == brute_audit(docs, [(1, 1, 0)])


def test_audit_of_nothing(spark, tmp_path):
    assert audit(spark, tmp_path, [], [], 1, 1) == []


def test_audit_leaves_no_state_behind(spark, tmp_path):
    before = {**{k: spark.conf.get(k, None) for k in fa._SETTINGS}}
    audit(spark, tmp_path, [(1, "a", "en")], [], 1, 1)
    assert {k: spark.conf.get(k, None) for k in fa._SETTINGS} == before
