"""License scan, hard negatives and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from verdigris.llm import hard_negatives, license_scan, periodic_runs
from tests.llm.test_operators import ODD, frame


@pytest.mark.parametrize("run", [license_scan.scan_licenses, periodic_runs.periodic_runs])
def test_odd_rows_have_their_results(spark, run):
    docs = frame(spark, ODD, [None, 1, 2, 3, 4, 5, 6, 7, 8, 8])
    rows = sorted((r.asDict() for r in run(docs).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    assert [r.pop("doc_id") for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    assert rows[0] == rows[1] and rows[8] == rows[9]
    assert run(docs.limit(0)).count() == 0


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def license_brute(text):
    """Every phrase place by comparison, and for notices every diagonal's share of covered words by a scan of all pairs."""
    w = words_of(text)
    places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    labels, best = {x for _, x in places}, 0.0
    for notice, label in license_scan.NOTICES:
        t = words_of(notice)
        hits = [(i - j, j) for j in range(len(t) - 4) for i in range(len(w) - 4) if w[i : i + 5] == t[j : j + 5]]
        for d in {d for d, _ in hits}:
            share = len({j + o for e, j in hits if abs(e - d) <= 8 for o in range(5)}) / len(t)
            best = max(best, share)
            labels |= {label} if share >= 0.8 else set()
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})), ",".join(sorted(labels)), 1.0 if places else best


def test_license_scan_equals_brute_force(spark):
    rng, texts = random.Random(3), [None, "", "MIT License", "mit license mit license", "the mit licenses", "CC BY-NC 4.0 cc by cc", "gnu general GNU General Public License public license apache license"]
    for _ in range(40):
        notice = words_of(rng.choice(license_scan.NOTICES)[0])
        for _ in range(rng.choice([0, 1, 3, 6, 12])):
            k = rng.randrange(len(notice))
            notice[k : k + 1] = rng.choice([[], ["changed"], [notice[k], "more"]])
        texts.append(" ".join(rng.choices(["a", "the", "software", "license", "mit"], k=rng.choice([0, 300]))) + " " + " ".join(notice).title() + ". the end" * rng.randint(0, 3))
    texts += [" ".join(["filler"] * n + ["mit license"] * 3 + ["filler"] * n) for n in (250, 254, 255, 256, 257, 510)]
    got = {r.doc_id: tuple(r)[1:8] for r in license_scan.scan_licenses(frame(spark, texts)).collect()}
    for i, text in enumerate(texts):
        want = license_brute(text)
        assert got[i][:6] == want[:6] and got[i][6] == pytest.approx(want[6]), (i, text)
    assert any(a[5] != a[4] for a in got.values()) and any(0 < a[6] < 0.8 for a in got.values())


def test_license_scan_of_rows_alike_and_other_templates(spark):
    text = "alpha beta gamma delta " * 200
    docs = frame(spark, [text] * 50, [7] * 50).repartition(3)
    rows = license_scan.scan_licenses(docs, [("beta gamma", "x"), ("...", "none"), ("delta", "y")], []).collect()
    assert len(rows) == 50 and {tuple(r) for r in rows} == {(7, 800, 400, 1, 799, "x,y", "x,y", 1.0, "")}
    assert license_scan.scan_licenses(docs, [], []).first()["score"] == 0
    one = license_scan.scan_licenses(frame(spark, [license_scan.NOTICES[5][0] + " so " + license_scan.NOTICES[5][0]])).first()
    n = len(words_of(license_scan.NOTICES[5][0]))
    assert one.spans == f"mit:0:{n - 1},mit:{n + 1}:{2 * n}" and one.n_base == 0 and one.score == 1


def negatives_brute(rows, every=100):
    sound = [(i, label, v) for i, label, v in rows if label is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, _, v in sound), default=1)
    cells = lambda v: tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in [*v, *[0] * (width - len(v))])
    told = list({(i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, cells(v)) for i, label, v in sound})
    grid, found = np.array([t[2] for t in told]), []
    for k, (i, label, v) in enumerate(told):
        if i is None or i % every:
            continue
        score = (grid @ np.array(v)).tolist()
        order = sorted(range(len(told)), key=lambda j: (-score[j], told[j][0] is None, told[j][0] or 0))
        for p in [j for j in order if j != k and told[j][1] == label][:5]:
            window = [j for j in order if told[j][1] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            found += [(i, told[p][0], r + 1, told[j][0], score[p], score[j]) for r, j in enumerate(window)]
    return sorted(found, key=str)


@pytest.mark.parametrize("block, anchors, sent", [(4096, 1024, 16_000_000), (37, 11, 16_000_000), (50, 7, 0)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, block, anchors, sent):
    for name, value in (("BLOCK", block), ("ANCHORS", anchors), ("MOST_SENT", sent)):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(6, 9))
    rows = [(i, int(rng.integers(4)), [float(x) for x in np.float32(centres[i % 6] * 0.4 + rng.normal(size=9) * 0.3)]) for i in range(400)]
    rows += [(500 + i, i % 3, rows[5][2]) for i in range(60)] + [(700 + i, i % 3, [0.0] * 9) for i in range(8)]  # copies and ties
    rows += [(900, 1, [0.5, float("nan")]), (1000, None, [0.5] * 9), (1001, 2, None), (1002, 2, [None, 0.1]), (1003, 1, [float("inf")]), (1100, 2, [0.4, 0.3]), (1200, 2, []), (None, 1, rows[3][2]), rows[10], rows[100], rows[200]]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, label int, embedding array<float>, score string")
    got = sorted(map(tuple, hard_negatives.hard_negatives(docs, every=20).collect()), key=str)
    assert got == negatives_brute(rows, 20) and len(got) > 300
    assert hard_negatives.hard_negatives(docs.limit(0)).count() == 0
    assert hard_negatives.hard_negatives(docs.where("vec_id = 1")).count() == 0


def test_the_index_leaves_out_and_prunes():
    """Far rows are neither indexed whole nor scored."""
    rng = np.random.default_rng(1)
    rows = rng.integers(-200, 200, size=(500, 32)).astype(np.float64)
    tail = hard_negatives.levels(np.abs(rows))
    bound = 0.3 * tail.max()
    outside = np.where(tail > bound, 0, rows)
    assert (np.sqrt((outside**2).sum(axis=1)) <= bound + 1e-6).all() and 0.1 < (outside != 0).mean() < 0.9


def runs_brute(words):
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i >= q:
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((a, n, q) for (a, n), q in found.items() if n >= 12)


def rhythm(rng):
    """Nested repeats over few words, and two regions of one period side by side."""
    def part(depth):
        made = [rng.randrange(kinds) for _ in range(rng.randint(1, 6))] if depth == 0 else part(depth - 1)
        how = rng.random()
        return made * rng.randint(1, 6) if how < 0.5 else made + made[::-1] if how < 0.7 else made + made[: rng.randint(0, len(made))]

    kinds, words = rng.choice([1, 2, 3, 8]), []
    while len(words) < rng.choice([3, 60, 300]):
        words += part(rng.randint(0, 3))
    unit = [rng.randrange(4) for _ in range(rng.randint(2, 5))]
    return words[:500] + rng.choice([[], unit * rng.randint(3, 30) + (unit[1:] + unit[:1]) * rng.randint(3, 30)])


def test_periodic_runs_equal_brute_force(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n"] + [rng.choice(["  ", ""]) + rng.choice([" ", "\n"]).join(f"w{x}é" for x in rhythm(rng)) for _ in range(120)]
    docs = frame(spark, texts)
    for alter in (False, True):
        for r in periodic_runs.periodic_runs(docs, alter=alter).collect():
            words = re.findall(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "")
            h = zlib.crc32(str(r.doc_id).encode())
            if alter and h % 10 == 0 and words:
                a = h // 10 % len(words)
                p = 1 + (len(words) - a) // (3 + h // 10 % 8)
                words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
            runs = runs_brute(words)
            gone = {i for a, n, q in runs for i in range(a + q, a + n)}
            kept = " ".join(w for i, w in enumerate(words) if i not in gone)
            told = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
            best = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
            exponent = 1000 * best[1] // best[2] if runs else None
            assert tuple(r)[1:6] == (len(runs), *best, exponent) and r.runs == told and r.collapsed == kept
            assert (r.runs_sha256, r.collapsed_sha256) == tuple(hashlib.sha256(x.encode()).hexdigest() for x in (told, kept))


def test_periodic_runs_stand_misleading_hashes(monkeypatch):
    """If prefix hashes call everything alike, words are compared period by period."""
    rng = random.Random(2)
    words = rhythm(rng)[:120] + [1, 2, 3, 4, 5] * 6
    flat, sizes = np.array([-1, *words]), np.array([len(words)])
    want = periodic_runs.runs_of(flat, sizes).tolist()
    monkeypatch.setattr(periodic_runs.PrefixHashes, "alike", lambda self, a, b, size: np.ones(len(a), dtype=bool))
    assert periodic_runs.runs_of(flat, sizes).tolist() == want
    assert sorted((a - 1, n, q) for a, n, q in want if n >= 12) == runs_brute(words)


def test_periodic_runs_of_a_long_text():
    words = [b"a"] * 20_000 + [b"b", b"a"] * 20_000 + [str(i % 9999).encode() for i in range(60_000)]
    columns = periodic_runs.describe([1], [b" ".join(words).decode()], 12, False)
    assert (columns[1][0], columns[2][0], columns[3][0]) == (60_000, 60_000, 9999)
    assert columns[7][0].splitlines()[0] == "0,20000,1" and columns[0][0] >= 3


def test_blocks_of_phrases_leave_one_pass(spark):
    """Twenty blocks, of which every pass but the last one written is deleted; the hits are those of one block."""
    import glob

    from verdigris.functions.session import ensure_checkpoint_dir
    from verdigris.llm import decontaminate

    rng = random.Random(20)
    texts = [" ".join(f"w{rng.randrange(10**9)}" for _ in range(200)) for _ in range(50)] + [None, ""]
    items = [" ".join(texts[k].split()[20:35]) for k in range(4)]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    ensure_checkpoint_dir(spark)
    place = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    before = set(glob.glob(f"{place}/verdigris/table_*"))
    many = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(frame(spark, texts), bench, most=1).collect()}
    left = set(glob.glob(f"{place}/verdigris/table_*")) - before
    assert len(left) == 1 and many == {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(frame(spark, texts), bench).collect()}
    assert sum(r[1] for r in many.values()) == 60
    for most in (1, 1000):
        clean = {r.doc_id: r.text for r in decontaminate.decontaminate(frame(spark, texts), bench, most=most).collect()}
        assert clean[50] is None and clean[51] == "" and len(clean[0].split()) == 185 and clean[9] == texts[9]


def test_terms_are_found_alike_by_pattern_and_by_word(spark, monkeypatch):
    from pyspark.sql import functions as F

    from verdigris.llm import pii

    terms = [f"name{k}" for k in range(40)] + ["élan", "über2"]
    texts = [" ".join(f"{'7' * (k % 3)}{terms[k % 42].upper() if k % 5 else terms[k % 42]}{'s' * (k % 7 == 0)}" for k in range(300)), "a@b.cd ÉLAN, x élan@b.cd.ef Über2", "", None]
    docs = frame(spark, texts)
    marks = F.array(*(F.struct(F.lit(t).alias("term"), F.lit("[TERM]" if k % 2 else "").alias("mark")) for k, t in enumerate(terms)))
    rows = pii.base_spans(docs).drop("terms").join(pii.texts_of(docs), "doc_id")

    def told(few):
        monkeypatch.setattr(pii, "FEW_MARKS", few)
        return {r.doc_id: r.new for r in rows.select("doc_id", pii.rewritten().alias("new")).collect()}

    rows = rows.withColumn("__marks", marks)
    assert told(0) == told(1000)
    assert len(told(1000)[0].terms) == sum(k % 7 != 0 for k in range(300)) and told(0)[1].text == "[EMAIL] , x é[EMAIL] [TERM]"
