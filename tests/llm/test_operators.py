"""The text operators against brute force on small fixtures, with nulls, empty texts, repeats and clashing columns."""

import gc
import hashlib
import random
import re

import numpy as np
import pytest

from verdigris.llm import chat_quotes, common, decontaminate, line_dedup, piece_codec, pii, quality_rules, secret_scan, simhash, token_counts, toxicity
from verdigris.llm.queries import ORACLE_SQL, QUERIES, model_path

SCHEMA = "doc_id long, text string, n_words string, key int, fp int"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in zip(ids or range(len(texts)), texts)], SCHEMA)


def long_text():
    """A long text of words of all kinds, addresses, keys, quotes and lines."""
    rng = random.Random(14)
    bits = ["word", "Straße", "日本", "a@b.org", "1.2.3.4", "+49 151 12345678", "q7Rf2LmX9vBt4KcZ8sWd1HyP", "password=hunter22", ">", '"', "\n", "|", "😀", "x" * 70]
    return " ".join(rng.choice(bits) + rng.choice(["", str(rng.randint(0, 999))]) for _ in range(20_000))


ODD = [None, "", " \n\t", "a", "a b c", "é日 😀 A", "x" * 50_000, long_text(), "same text here", "same text here"]


@pytest.mark.parametrize("run", [
    pii.sanitise, secret_scan.scan_secrets, simhash.near_duplicates, line_dedup.deduplicate_lines,
    lambda d: token_counts.token_counts(d, model_path()), lambda d: piece_codec.encode_pieces(d, model_path()),
    lambda d: piece_codec.decode_pieces(piece_codec.encode_pieces(d, model_path()), model_path()),
    lambda d: decontaminate.contamination(d, d.selectExpr("doc_id as item_id", "text").limit(3)),
    lambda d: quality_rules.quality_rules(d, d.selectExpr("doc_id", "1 as quality")),
    lambda d: toxicity.toxicity(d, d.selectExpr("doc_id", "0 as toxic")),
])
def test_odd_rows_have_their_results(spark, run):
    """A null text counts as empty, rows alike get the same result, and no row is lost."""
    docs = frame(spark, ODD, [None, 1, 2, 3, 4, 5, 6, 7, 8, 8])
    rows = sorted((r.asDict() for r in run(docs).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"]))
    assert [r["doc_id"] for r in rows] == [None, 1, 2, 3, 4, 5, 6, 7, 8, 8]
    plain = [{k: v for k, v in r.items() if k not in ("doc_id", "text", "held_out")} for r in rows]
    assert plain[0] == plain[1]
    if "__dropped" not in plain[0]:
        assert plain[8] == plain[9]
    assert run(docs.limit(0)).count() == 0


PATTERNS = dict(email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(text):
    digits = [int(c) for c in re.sub("[ -]", "", text)][::-1]
    return 16 <= len(digits) <= 19 and sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(digits)) % 10 == 0


VALID = dict(email=lambda t: True, ip=lambda t: all(int(p) <= 255 for p in t.split(".")), card=luhn, phone=lambda t: 8 <= len(re.sub("[^0-9]", "", t)) <= 15)


def test_pii_base_spans_and_telling_terms(spark):
    rng = random.Random(1)
    bits = ["a@b.c", "%d@e.f-g.h", "1.2.3.4", "001.2.3.255", "999.1.1.1", "4111 1111 1111 1111", "+1 (555) 123-4567", "..", "é", "-", " ", "x", "@", "+4"]
    texts = ["".join(rng.choices(bits, k=12)) for _ in range(60)] + [None, ""]
    texts += [f"project falcon number{i} mail boss@corp.com about the plan{i} soon" for i in range(6)] + [f"about the usual thing number{i} plan{i} mail soon" for i in range(60)]
    want = {}
    for i, text in enumerate(texts):
        want[i] = [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if VALID[k](m[0])]
    for r in pii.sanitise(frame(spark, texts)).collect():
        spans = want[r.doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
        assert r.spans.split(",")[: len(spans)] == (spans or [""])[: len(spans)] and r.n_email == sum(s[:5] == "email" for s in spans)
        if 62 <= r.doc_id < 68:
            assert "falcon" not in r.text and "project" not in r.text and "[EMAIL]" in r.text and " about the plan" in r.text
        if r.doc_id >= 68:
            assert r.n_term == 0 and r.text == texts[r.doc_id]


def test_pii_terms_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdé", k=rng.randint(3, 7))) for _ in range(60)]
    people = {f"user{i}@corp{i}.org": rng.sample(words, 4) for i in range(5)}
    texts = []
    for _ in range(150):
        text = rng.choices(words[:40], k=rng.randint(2, 9))
        for mail, own in people.items():
            if rng.random() < 0.15:
                text += [rng.choice(own), mail, *rng.sample(own, 3), "." * rng.randint(0, 60)]
        texts.append(rng.choice([" ", "-", " \n"]).join(text))
    texts += texts[:20] + ["telling " + words[3] + "+4915112345678" + words[4] + " 1.2.3.4" + words[5], None]
    ids = [*range(170), 170, 171]
    ids[-3] = ids[19]  # a repeated row
    term = re.compile(r"[^\W\d_][^\W_]{2,}")
    terms = [set(term.findall((t or "").lower())) for t in texts]
    def entities(text):
        """By entity the text on either side of its mention, up to the next match of its kind."""
        out = {}
        for kind, pattern in PATTERNS.items():
            found = list(re.finditer(pattern, text))
            edges = [0, *(x for m in found for x in m.span()), len(text)]
            out |= {f"{kind}:{m[0].lower()}": (text[edges[2 * i] : m.start()][-60:].lower(), text[m.end() : edges[2 * i + 3]][:60].lower()) for i, m in enumerate(found) if VALID[kind](m[0])}
        return out

    held = [entities(t or "") for t in texts]
    n, shares = len(texts), {}
    for mail in set().union(*held):
        with_entity = [i for i in range(n) if mail in held[i]]
        for t in set().union(*terms):
            both = [i for i in with_entity if t in terms[i]]
            if len({held[i][mail] for i in both}) >= 3:
                pmi = np.log2(n * len(both) / (sum(t in x for x in terms) * len(with_entity)))
                shares[mail, t] = pmi / np.log2(n / len(with_entity))
    found = pii.base_spans(frame(spark, texts, ids))
    counts = spark.createDataFrame([(t, sum(t in x for x in terms)) for t in set().union(*terms)], "term string, n long")
    told = {(r.entity, r.term): r.share for r in pii.disclosing_terms(found, counts).collect()}
    assert told.keys() == {k for k, x in shares.items() if x >= 0.8} and told and all(abs(shares[k] - x) < 1e-9 and x <= 1 for k, x in told.items())
    mark = {t: "" if max(x for (_, u), x in told.items() if u == t) >= 0.95 else "[TERM]" for _, t in told}
    want = {}
    for i, text in zip(ids, texts):
        text = text or ""
        base = sorted((m.start(), m.end(), f"[{k.upper()}]") for k, p in PATTERNS.items() for m in re.finditer(p, text) if VALID[k](m[0]))
        spans = base + [(m.start(), m.end(), mark[m[0].lower()]) for m in term.finditer(text) if m[0].lower() in mark and not any(a <= m.end() and m.start() <= b for a, b, _ in base)]
        new, at = "", 0
        for a, b, m in sorted(spans):
            if a >= at:
                new += text[at:a] + m
            at = max(at, b)
        want[i] = new + text[at:]
    rows = pii.sanitise(frame(spark, texts, ids)).collect()
    assert len(rows) == n and all(r.text == want[r.doc_id] for r in rows)
    assert sum(r.n_generalised for r in rows) + sum(r.n_removed for r in rows) == sum(r.n_term for r in rows) > 0


def test_secret_spans(spark):
    key = "q7Rf2LmX9vBt4KcZ8sWd1HyP"
    texts = [f"token: '{key}' x", "password=abc", "password: token: abcdefghij", "AKIA" + "A1B2" * 4, "0123456789abcdef01234567 z", f"see {key}{key[::-1]} ok", "plainwordsonlythatarelongbutnotsecret", "ſecret=abcdefgh", None]
    found = {r.doc_id: r for r in secret_scan.scan_secrets(frame(spark, texts)).collect()}
    assert [(found[i].n_assign, found[i].n_access, found[i].n_hex, found[i].n_entropy) for i in range(9)] == [(1, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0)]
    assert secret_scan.redact(texts[5], found[5].spans) == "see [SECRET] ok"
    scanner = secret_scan.Scanner()
    added = lambda text: [text[a:b].lstrip("/") for a, b in scanner.added(text, scanner.base(text))]
    assert added(f"AKIA{'A1B2' * 4}/{key}{key}") == [key + key]
    assert added(f"docs/example/{key}{key} 123e4567-e89b-12d3-a456-426614174000") == [key + key]
    assert added("data iVBORw0KGgo" + "A" * 24 + "Nz9 end") == [] and added("a" + "-" * 5000 + "1 " + "-" * 60 + " a1" + "=" * 21) == []


def entropy(window):
    return -sum(window.count(c) / len(window) * np.log2(window.count(c) / len(window)) for c in set(window))


def test_secrets_equal_brute_force(spark):
    """Base spans by the patterns alone, and windows' entropies and classes by counting each anew."""
    rng = random.Random(2)
    scanner = secret_scan.Scanner()
    bits = ["password", "TOKEN", "api_key", "=", ": ", '"', "AKIA", "A1", "0" * 24, "f" * 9, "-" * 21, "A" * 30, "a/b", "/", "é", "\n", " ", "example", "x1"]
    random_bit = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-", k=rng.randint(3, 30)))
    texts = ["".join(rng.choice(bits) if rng.random() < 0.6 else random_bit() for _ in range(14)) for _ in range(300)]
    for text, r in zip(texts, secret_scan.scan_secrets(frame(spark, texts)).orderBy("doc_id").collect()):
        spans = [(m.start(), 0, m.end()) for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        told = [f"{['assign', 'access', 'hex'][k]}:{a}:{b}" for a, k, b in sorted(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(told).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("entropy")] == told
        inside = {p for a, _, b in spans for p in range(a, b)}
        added = [tuple(map(int, x.split(":")[1:])) for x in r.spans.split(",") if x.startswith("entropy")]
        hot = set()
        for i in range(len(text) - 19):
            window = text[i : i + 20]
            if not re.fullmatch(r"[A-Za-z0-9+/_=-]{20}", window) or inside.intersection(range(i, i + 20)) or not (re.search("[0-9]", window) and re.search("[A-Za-z]", window)):
                continue
            least = next(bits for _, chars, bits in secret_scan.CLASSES if set(window) <= set(chars))
            if entropy(window) >= least - 1e-9:
                hot.update(range(i, i + 20))
        covered = {p for a, b in added for p in range(a, b)}
        assert not covered & inside and r.n_entropy == len(added)
        stops = {p for p in range(len(text)) for m in re.finditer("(?i)example|placeholder|changeme|xxxx|0123456789|abcdefgh", text) if m.start() <= p < m.end() and not inside.intersection(range(*m.span()))}
        if not stops:
            assert hot <= covered and all(hot.intersection(range(a, b)) for a, b in added)
        else:
            assert not covered & stops


def components(links, nodes):
    above = {n: n for n in nodes}

    def top(n):
        while above[n] != n:
            n = above[n]
        return n

    for a, b in links:
        above[top(a)] = top(b)
    groups = {}
    for n in nodes:
        groups.setdefault(top(n), set()).add(n)
    return {n: min(groups[top(n)]) for n in nodes}


def test_hubs_are_joined_like_other_keys(spark):
    rng = random.Random(15)
    rows = [(rng.choice([1, 1, 1, 2, 2, rng.randint(3, 60)]), i) for i in range(3000)]
    counts = {k: sum(a == k for a, _ in rows) for k, _ in rows}
    values = [(k, f"v{k}", n) for k, n in counts.items() if k % 7] + [(99, "none", 0)]
    found = common.hub_join(spark.createDataFrame(rows, "k int, i int"), spark.createDataFrame(values, "k int, v string, n long"), "k", len(rows))
    assert found.columns == ["k", "i", "v"] and max(counts.values()) > 5 * common.LEAST_HUB
    assert sorted(map(tuple, found.collect())) == sorted((k, i, f"v{k}") for k, i in rows if k % 7)


def test_components_of_hubs_and_chains(spark):
    pairs = [(0, i) for i in range(1, 900)] + [(2000 + i, 2001 + i) for i in range(40)] + [(899, 1500), (7, 7)]
    root = components(pairs, {x for p in pairs for x in p})
    found = {r.node: r.root for r in common.connected_components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert found == {x: r for x, r in root.items() if x != r}


def test_few_links_have_few_partitions(spark, monkeypatch):
    pairs = [(i, i + 1) for i in range(300) if i % 11]
    root = components(pairs, {x for p in pairs for x in p})
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 40)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for links, parts in ((None, 8), (20, 40)):
            if links:
                monkeypatch.setattr(common, "LINKS", links)
            found = common.connected_components(spark.createDataFrame(pairs, "a int, b int"))
            assert {r.node: r.root for r in found.collect()} == {x: r for x, r in root.items() if x != r}
            assert 8 <= found.rdd.getNumPartitions() <= parts
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_simhash_components_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    fps = {0}
    for base in rng.integers(-(2**62), 2**62, 6):
        for _ in range(60):
            x = int(base)
            for bit in rng.integers(0, 62, rng.integers(0, 5)):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    want = components([(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 4], fps)
    for crowd in (4, 64):
        links = simhash.near_links(spark.createDataFrame([(x,) for x in fps], "fp long"), 4, crowd)
        root = {r.node: r.root for r in common.connected_components(links).collect()}
        assert {x: root.get(x, x) for x in fps} == want


def test_fingerprint_by_the_definition():
    import xxhash

    for text in ["", "One", "one two THREE", "a b c d e f é", "\x85a\xa0b c\td\ne"]:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        want = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
        assert simhash.fingerprint(text) % 2**64 == want


def test_prefix_counts_and_codec_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    texts = ["", "a", "  two  spaces ", "Die schöne Straße, naïve café.", "<s>é日😀 qzü\n\n ok</s>", "x▁y", "𝕏 \x00", "internationalization" * 20]
    counter = token_counts.PrefixCounter(model_path())
    for text, counts in zip(texts, counter.counts(texts)):
        assert counts.tolist() == [len(library.encode(text[:i])) for i in range(len(text) + 1)]
    assert [n for n, *_ in counter.measure(texts, 3)] == [len(library.encode(t)) for t in texts]
    assert [k for _, k, _ in counter.measure(texts, 3)] == [max(i for i in range(len(t) + 1) if len(library.encode(t[:i])) <= 3) for t in texts]
    made = piece_codec.encode_pieces(frame(spark, texts), model_path())
    rows = {r.doc_id: r for r in made.collect()}
    assert [rows[i].ids for i in range(len(texts))] == [library.encode(t) for t in texts]
    assert sum(r.n_repaired for r in rows.values()) == 0
    assert [rows[i].round_trip for i in range(len(texts))] == ["▁" not in t for t in texts]
    back = {r.doc_id: r.text for r in piece_codec.decode_pieces(made, model_path()).collect()}
    assert [back[i] for i in range(len(texts))] == [library.decode(library.encode(t)) for t in texts]


def message(*fields):
    """A protobuf message of (number, value) fields: ints, floats, bytes or texts."""
    import struct

    def varint(n):
        return bytes([n & 127 | 128]) + varint(n >> 7) if n > 127 else bytes([n])

    out = b""
    for number, value in fields:
        if isinstance(value, int):
            out += varint(number << 3) + varint(value)
        elif isinstance(value, float):
            out += varint(number << 3 | 5) + struct.pack("<f", value)
        else:
            value = value.encode() if isinstance(value, str) else value
            out += varint(number << 3 | 2) + varint(len(value)) + value
    return out


@pytest.mark.parametrize("squeeze", [0, 1])
def test_unigram_model_is_rebuilt(tmp_path, squeeze):
    """A hand-made model (none is trained) with scores that make no ties."""
    rng = random.Random(12)
    pieces = ["▁", *"abcde", "ab", "abc", "bc", "cd", "▁a", "▁ab", "de", "▁c", "cde", "ea", "▁▁"]
    proto = b"".join(message((1, message((1, p), (2, -rng.uniform(1, 9)), (3, kind)))) for p, kind in [("<unk>", 2), ("<s>", 3), ("</s>", 3), *((p, 1) for p in pieces)])
    path = tmp_path / "hand.model"
    path.write_bytes(proto + message((2, message((3, 1))), (3, message((3, 1), (4, squeeze), (5, 1)))))
    codec = piece_codec.Codec(str(path))
    texts = ["".join(rng.choices("abcde  xé", k=rng.randint(0, 30))) for _ in range(300)]
    for text, (ids, _, repaired) in zip(texts, codec.encode(texts)):
        assert ids.tolist() == codec.library.encode(text)
        assert repaired == 0
    path.write_bytes(proto + message((2, message((3, 3)))))
    with pytest.raises(ValueError):
        piece_codec.Codec(str(path))


def test_threads_give_the_same_ids():
    texts = [f"some words {i} and more of them" for i in range(50)]
    one, two = (piece_codec.Codec.of(model_path(), n) for n in (1, 2))
    assert one is not two and [x[0].tolist() for x in one.encode(texts)] == [x[0].tolist() for x in two.encode(texts)]


def test_workers_keep_a_codec_for_one_stage(spark):
    docs = frame(spark, [f"some words {i} and more of them" for i in range(40)]).repartition(4)
    assert all(r.ids for r in piece_codec.with_ids(docs, model_path()).collect())
    found = common.per_text(docs, lambda texts: [[sum(isinstance(x, piece_codec.Codec) for x in gc.get_objects())] * len(texts)], "codecs int").collect()
    assert len(found) == 40 and not any(r.codecs for r in found)
    one, two = (piece_codec.Codec.of(model_path()) for _ in range(2))
    assert one is two


def learned(monkeypatch, made, step):
    """What ``made`` is asked to work out from now on."""
    seen, inner = [], getattr(made, step)
    monkeypatch.setattr(made, step, lambda parts: (seen.extend(parts), inner(parts)))
    return seen


#: Usual words, then rare ones beyond a cache of 100 parts, then the usual ones again.
RECURRING = [[f"usual{i}" for i in range(40)], [f"rare{i}x" for i in range(80)], [f"rare{i}y" for i in range(80)], [f"usual{i}" for i in range(40)]]


def test_parts_that_recur_are_encoded_once(monkeypatch):
    monkeypatch.setattr(piece_codec, "CACHE", 100)
    codec = piece_codec.Codec(model_path())
    seen = learned(monkeypatch, codec, "learn")
    for words in RECURRING * 3:
        (ids, exact, repaired), *_ = codec.encode([" ".join(words)])
        assert ids.tolist() == codec.library.encode("▁" + "▁".join(words)) and exact and not repaired
        assert len(codec.known) <= 100 + 80
    assert sorted(p for p in seen if "usual" in p) == sorted("▁" + w for w in RECURRING[0])
    assert len(codec.before) <= 100 + 80


def test_parts_that_recur_are_tabulated_once(monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE", 100)
    counter = token_counts.PrefixCounter(model_path())
    seen = learned(monkeypatch, counter, "tabulate")
    for words in RECURRING * 3:
        text = " ".join(words)
        assert counter.measure([text], 10**6) == [(len(counter.library.encode(text)), len(text), 0)]
        assert len(counter.totals) <= 100 + 80 and counter.totals.keys() == counter.tables.keys()
    assert sorted(p for p in seen if "usual" in p) == sorted("▁" + w for w in RECURRING[0])


def test_prefix_counts_without_repairs_on_many_words(monkeypatch):
    """Random words, also of characters that no token has or that only longer tokens have; pairs are forgotten in between."""
    rng = random.Random(22)
    bits = ["▁", "a", "e", "in", "ing", "ter", "er", "qu", "ß", "é", "日", "本", "😀", "𝕏", "\x00", "\n", "1", ".", "--", "'s"]
    counter = token_counts.PrefixCounter(model_path())
    monkeypatch.setattr(token_counts, "PAIRS", 300)
    for _ in range(30):
        texts = [" ".join("".join(rng.choices(bits, k=rng.randint(1, 9))) for _ in range(5)) for _ in range(4)]
        for text, counts in zip(texts, counter.counts(texts)):
            assert counts.tolist() == [len(x) for x in counter.library.encode([text[:i] for i in range(len(text) + 1)])]
    assert not counter.repaired and counter.pairs <= 300 + 4 * 5 * 9 * 10


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        before, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            before, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, before + (x != y))
    return row[-1]


def test_banded_edit_distances():
    rng = random.Random(4)
    left, right = (["".join(rng.choices("abc", k=rng.randint(0, 90 if i % 50 == 0 else 9))) for i in range(4000)] for _ in range(2))
    for i in range(0, 4000, 3):  # near pairs of many lengths
        text = list(left[i])
        for _ in range(rng.randint(0, 4)):
            at = rng.randint(0, len(text))
            text[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        right[i] = "".join(text)
    want = [plain_distance(a, b) for a, b in zip(left, right)]
    for most in (np.full(4000, 1), np.full(4000, 3), np.array(rng.choices(range(1, 9), k=4000))):
        assert line_dedup.edit_distances(left, right, most).tolist() == [min(x, m + 1) for x, m in zip(want, most.tolist())]


@pytest.mark.parametrize("tau,crowd", [(1, 32), (1, 2), (2, 32)])
def test_line_dedup_equals_brute_force(spark, tau, crowd):
    rng = random.Random(tau + crowd)
    base = ["".join(rng.choices("abcd é", k=rng.randint(19, 25))) for _ in range(6)]

    def edited(line):
        line = list(line)
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(line))
            line[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        return "".join(line)

    texts = ["\n".join(edited(rng.choice(base)) if rng.random() < 0.8 else "short" for _ in range(rng.randint(0, 7))) for _ in range(40)]
    places = [(d, i, line) for d, t in enumerate(texts) for i, line in enumerate(t.split("\n")) if len(line) >= 20]
    lines = sorted({line for *_, line in places})
    root = components([(a, b) for i, a in enumerate(lines) for b in lines[:i] if plain_distance(a, b) <= tau], lines)
    first = {}
    for d, i, line in sorted(places):
        first.setdefault(root[line], (d, i))
    gone = {(d, i) for d, i, line in places if first[root[line]] != (d, i)}
    found = line_dedup.deduplicate_lines(frame(spark, texts), tau, 20, crowd).withColumn("kept", line_dedup.kept_text()).collect()
    assert {(r.doc_id, x.number) for r in found for x in r["__dropped"] or []} == gone
    line_at = {(d, i): line for d, i, line in places}
    assert all((x.doc_id, x.first) == first[root[line_at[r.doc_id, x.number]]] for r in found for x in r["__dropped"] or [])
    for r in found:
        assert r.kept == "\n".join(line for i, line in enumerate(r.text.split("\n")) if (r.doc_id, i) not in gone)


@pytest.mark.parametrize("crowd,block", [(0, 4096), (0, 16), (8, 4096)])
def test_edits_grow_with_the_line(spark, crowd, block):
    rng = random.Random(crowd)
    words = ["".join(rng.choices("abcdefghij é", k=rng.randint(2, 8))) for _ in range(300)]
    base = [" ".join(rng.choices(words, k=k)) for k in (5, 15, 25, 40, 60, 90) for _ in range(2)]
    lines = set(base)
    for line in base * 12:
        line = list(line)
        for _ in range(rng.randint(1, 5)):
            i = rng.randrange(len(line) - 4)
            line[i : i + rng.randint(0, 4)] = rng.choice(["", "z", "zz", "zzzz"])
        lines.add("".join(line))
    lines = sorted(lines)
    every = [(a, b) for i, a in enumerate(lines) for b in lines[:i]]
    most = np.array([min(8, max(1, min(len(a), len(b)) // 40)) for a, b in every])
    found = line_dedup.edit_distances([a for a, _ in every], [b for _, b in every], most)
    pairs = [p for p, d, m in zip(every, found, most) if d <= m]
    assert (found[found <= most] > 5).any()
    texts = ["\n".join(lines[i : i + 5]) for i in range(0, len(lines), 5)]
    ids = {hashlib.md5(line.encode()).digest(): line for line in lines}
    root = components([(ids[bytes(r.a)], ids[bytes(r.b)]) for r in line_dedup.line_links(frame(spark, texts), crowd=crowd, block=block).collect()], lines)
    assert root == components(pairs, lines)


def test_keys_with_too_many_rows_to_hold_are_crowded():
    import pyarrow as pa

    rows = [(1, 5, 1), (2, 5, 2), *((3, 5, i) for i in range(20)), (4, 5, 3), (4, 5, 4)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + 6])], ["key", "about", "line"]) for i in range(0, len(rows), 6)]
    found = [r for b in line_dedup.candidates_of_keys(iter(batches), 1, 8, 5) for r in b.to_pylist()]
    assert {r["a"] for r in found if r["key"] == 3} == set(range(20))
    assert [(r["a"], r["b"]) for r in found if r["key"] is None] == [(4, 3)]


def test_short_repeated_lines_go(spark):
    texts = ["Of, edti oner.\n--\n\nok", "ok\n--\nOf, edti oner.\nOf, edti onar.", "été\nété\n--"]
    found = line_dedup.deduplicate_lines(frame(spark, texts)).withColumn("kept", line_dedup.kept_text())
    assert [r.kept for r in found.orderBy("doc_id").collect()] == [texts[0], "--\nOf, edti onar.", "été\n--"]


@pytest.mark.parametrize("most", [200_000, 9])
def test_decontamination_equals_brute_force(spark, most):
    rng = random.Random(5)
    words = lambda k: " ".join(rng.choices(["aa", "B-b", "cé", "zz9"], k=k))
    items = [words(rng.randint(0, 14)) for _ in range(6)]
    texts = [words(rng.randint(0, 60)) + rng.choice(["", " unknown "]) + words(20) for _ in range(30)] + ["nothing shared", None]
    of = lambda t: [w.decode() for w in decontaminate.words_of(t or "")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    for r in decontaminate.contamination(frame(spark, texts), bench, 4, most).collect():
        doc, hit, found = of(texts[r.doc_id]), set(), set()
        for item, text in enumerate(items):
            w = of(text)
            for phrase in [w[i : i + 4] for i in range(max(1, len(w) - 3))] if w else []:
                for i in range(len(doc) - len(phrase) + 1):
                    if doc[i : i + len(phrase)] == phrase:
                        hit.update(range(i, i + len(phrase)))
                        found.add(str(item))
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (len(doc), len(hit), len(found), bool(hit))
        assert r.items_sha256 == hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    cleaned = decontaminate.decontaminate(frame(spark, texts), bench, 4, most)
    assert cleaned.columns == frame(spark, texts).columns
    assert decontaminate.contamination(cleaned, bench, 4).where("contaminated").count() == 0


def test_words_beyond_a_shards_vocabulary_match_nothing():
    phrases = decontaminate.Phrases([("1", [b"a", b"b", b"c"]), ("2", [b"w%d" % i for i in range(40)])], 3)
    assert decontaminate.search_shard(["x a b c y"], phrases)[1] == {0: [(1, 4, 0)]}


def test_quality_counts_and_forest(spark, data):
    rng = random.Random(6)
    for _ in range(100):
        words = rng.choices("abcd", k=rng.randint(0, 60))
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        want = len({j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)})
        assert quality_rules.statistics(" ".join(words))[4] == want
    assert quality_rules.statistics("a| b\n\na| b\nc")[:4] == (5, 7, 2, 1)
    for _ in range(200):
        text = "".join(rng.choices(["a", "é", "😀", "\x85", "\xa0", "#", "|", " ", "\t", "\n", "\n", "ab\n"], k=rng.randint(0, 40)))
        found = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        assert quality_rules.statistics(text)[:4] == want
    x = np.random.default_rng(1).random((300, 6))
    forest = quality_rules.Forest.fit(x, x.min(0), x.max(0) + 1, trees=20)
    for row, score in zip(x[:40], forest.score(x[:40])):
        total = 0.0
        for feature, value, path in zip(forest.feature, forest.value, forest.path):
            node = 1
            while feature[node] >= 0:
                node = 2 * node + (row[feature[node]] >= value[node])
            total += path[node]
        assert abs(score - 2 ** (-total / 20 / forest.norm)) < 1e-12
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed")
    good, bad = judged.where("quality = 1"), judged.where("quality = 0")
    assert good.where("not kept").count() <= 0.01 * good.count() and bad.where("kept").count() <= 0.2 * bad.count()


def test_forest_and_threshold_come_from_all_labelled_rows(spark):
    """The only bad rows have the largest hashes of doc_id, behind 6,475 others."""
    rng = random.Random(21)
    ids = [r.id for r in spark.range(6500).selectExpr("id", "xxhash64(id) as h").orderBy("h").collect()]
    bad = set(ids[-25:])
    word = lambda i: "".join(rng.choices("abcdefgh" if i not in bad else "ab#|<*", k=rng.randint(3, 8)))
    texts = [" ".join(word(i) for _ in range(rng.randint(20, 30))) for i in range(6500)]
    docs = frame(spark, texts)
    labels = docs.selectExpr("doc_id", f"if(doc_id in ({','.join(map(str, bad))}), 0, 1) as quality")
    judged = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert len(judged) == 6500 and not any(judged[i].kept for i in bad)
    assert sum(r.kept for r in judged.values()) >= 0.998 * 6475
    assert {r.doc_id for r in quality_rules.keep_good(docs, labels).collect()} == {i for i, r in judged.items() if r.kept}
    x, good = np.array([quality_rules.statistics(t)[-1] for t in texts]), np.array([i not in bad for i in range(6500)])
    forest = quality_rules.fit_forest(quality_rules.document_statistics(docs), labels)
    plain = quality_rules.Forest.fit(x[good], x.min(0), x.max(0))
    assert np.array_equal(forest.path, plain.path) and np.array_equal(forest.feature, plain.feature)
    scores = plain.anomaly(x)
    assert [judged[i].anomaly for i in range(6500)] == scores.tolist()
    kept = scores <= forest.threshold
    gains = [(scores[~good] > t).mean() - (scores[good] > t).mean() for t in np.unique(scores) if (scores[good] > t).mean() <= quality_rules.MOST_GOOD_LOST]
    assert kept[good].mean() - kept[~good].mean() == pytest.approx(max(gains))


def test_simhash_runs_too_long_to_hold_settle_nothing():
    import pyarrow as pa

    rows = [(1, 2**50), (1, 7), (1, 9), (1, 2**51), (2, 5), (2, 4)]
    for size in (1, 2, 4):
        batches = [pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows[i : i + size])], ["key", "fp"]) for i in range(0, 6, size)]
        found = [(r["a"], r["b"]) for b in simhash.pairs_of_runs(iter(batches), 4, 32, 3) for r in b.to_pylist()]
        assert {a for a, b in found if b is None} == {2**50, 7, 9, 2**51} and (5, 4) in found


def test_near_duplicates_and_winners_equal_brute_force(spark):
    rng = random.Random(10)
    base = [" ".join(rng.choices(["aa", "bb", "cc", "dd", "ee", "ff"], k=60)) for _ in range(5)]
    texts = [t for t in base for _ in range(4)] + [" ".join(w if rng.random() > 0.01 else "zz" for w in rng.choice(base).split()) for _ in range(20)] + [None, "", " "]
    ids = [None if rng.random() < 0.15 else rng.randint(0, 25) for _ in texts]  # ids clash, and some are missing
    docs = frame(spark, texts, ids)
    fps = [simhash.fingerprint(t or "") for t in texts]
    root = components([(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4], range(len(fps)))
    groups = {}
    for i in range(len(fps)):
        groups.setdefault(root[i], []).append(i)
    least = {g: min((ids[i] for i in members if ids[i] is not None), default=None) for g, members in groups.items()}
    found = sorted(((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert found == sorted(((ids[i], f"{fps[i] % 2**64:016x}", least[root[i]]) for i in range(len(fps))), key=str)
    kept = simhash.deduplicate(docs)
    assert kept.columns == docs.columns
    digest = lambda i: hashlib.md5(f"{'' if ids[i] is None else ids[i]}:{texts[i] or ''}".encode()).digest()
    first = [min(members, key=lambda i: (ids[i] is None, ids[i] or 0, digest(i))) for members in groups.values()]
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == sorted(((ids[i], texts[i] or "") for i in first), key=str)


def test_toxicity_held_out_and_automaton(spark):
    terms = ["stupid", "moron", "scum"]
    automaton = toxicity.LexiconAutomaton(terms)
    rng = random.Random(7)
    for _ in range(3000):
        word = list(rng.choice(terms))
        for _ in range(rng.randint(0, 2)):
            i = rng.randrange(len(word))
            word[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "s", "m"])
        word = "".join(word)
        near = [t for t in terms if plain_distance(word, t) <= (1 if len(t) >= 5 else 0)]
        assert (automaton.match(word) is not None) == bool(near)
    abuse = 'you are scum and more'
    assert toxicity.Quotes('he wrote "scum" there').likelihood(10, ["wrote"]) > 0.5 > toxicity.Quotes(abuse).likelihood(8, abuse.split())
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id")
    wrong = held.where("predicted <> toxic").count()
    assert wrong <= 0.02 * held.count()


def test_quotation_equals_looking_at_the_line(spark):
    rng = random.Random(13)
    for _ in range(300):
        text = "".join(rng.choices(["a ", "b", '"', "\n", "> ", "»", " "], k=rng.randint(1, 40)))
        quotes = toxicity.Quotes(text)
        for at in range(len(text)):
            if text[at] not in "ab":
                continue
            line, end = text.rfind("\n", 0, at) + 1, (text + "\n").find("\n", at)
            marks = [c for c in text[line:at] if c in '"»']
            want = 0.7 * text[line:at].lstrip().startswith(">") + 0.7 * (len(marks) % 2 == 1 and bool(set(text[at:end]) & set('"»')))
            assert quotes.likelihood(at, []) == min(want, 1.0)


def test_reply_order(spark):
    rows = [(1, 0, "user", "Hello there\nHow are you?"), (1, 1, "assistant", "> Hello there\n> how  ARE you?\nFine thanks.\nAnd you?"), (1, 2, "user", "Bob wrote:\n>> Hello there\n> Fine thanks.\nok"), (1, 3, "user", "> nothing\nx"), (1, 4, "user", ">> Fine thanks.\n>> And you?\n> ok\nlast"), (2, 0, "user", None), (None, 1, "user", "> a"), (2, None, "user", "a")]
    messages = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, root int")
    found = {(r.conv_id, r.turn): (r.thread_turn, r.reply_to, r.quote_depth, r.text) for r in chat_quotes.reply_ordered(messages).collect()}
    assert found[1, 1] == (0, 0, 1, "Fine thanks.\nAnd you?")
    assert found[1, 2] == (0, 1, 2, "ok")
    assert found[1, 3] == (3, None, 0, "x")
    assert found[1, 4] == (0, 2, 2, "last")
    assert found[None, 1] == (1, None, 0, "") and found[2, None] == (None, None, 0, "a") and len(found) == 8
    assert chat_quotes.reply_ordered(messages.limit(0)).count() == 0


def linked_replies(turns):
    """By turn thread_turn, reply_to, quote_depth, n_quoted_turns, n_quoted_lines and text of one conversation's texts."""
    tidy = lambda x: " ".join(x.split()).lower()
    parsed = []
    for text in turns:
        passages = []
        for line in text.split("\n"):
            mark = re.match(r"(?: {0,3}>)+ ?", line)
            level = mark[0].count(">") if mark else 0
            if not passages or passages[-1][0] != level:
                passages.append((level, []))
            passages[-1][1].append(line[len(mark[0]) :] if mark else line)
        own = []
        for (level, lines), after in zip(passages, [*passages[1:], (0, [])]):
            if level == 0:
                own += lines[:-1] if after[0] and re.search(r"(?i)\bwrote\s*:\s*$", lines[-1]) else lines
        parsed.append((passages, own))
    origin = {}
    for turn, (passages, own) in enumerate(parsed):
        for unit in [" ".join(own), *(" ".join(lines) for level, lines in passages if not level), *own]:
            origin.setdefault(tidy(unit), turn)
    out, reply = [], {}
    for turn, (passages, own) in enumerate(parsed):
        sizes = {}
        for level, lines in passages:
            found = {}
            if level:
                whole = tidy(" ".join(lines))
                for unit in {tidy(x) for x in lines} - {""}:
                    if origin.get(unit, turn) < turn:
                        found[origin[unit]] = found.get(origin[unit], 0) + len(unit)
                if whole and origin.get(whole, turn) < turn:
                    found[origin[whole]] = max(found.get(origin[whole], 0), len(whole))
            for source, n in found.items():
                sizes[level, source] = sizes.get((level, source), 0) + n
        if sizes:
            outer = min(level for level, _ in sizes)
            reply[turn] = max((n, source) for (level, source), n in sizes.items() if level == outer)[1]
        root = turn
        while root in reply:
            root = reply[root]
        out.append((root, reply.get(turn), max((k for k, _ in sizes), default=0), len({x for _, x in sizes}), sum(len(x) for k, x in passages if k), "\n".join(own).strip(" ")))
    return out


def test_reply_order_equals_brute_force(spark):
    rng = random.Random(9)
    said = ["Hello there", "fine  thanks", "ok", "And YOU", "see below", "Ann wrote:", "no", ""]
    rows = {conv: ["\n".join(rng.choice(["", "", "> ", ">", ">> ", "> > ", ">>>"]) + rng.choice(said) for _ in range(rng.randint(1, 6))) for _ in range(rng.randint(1, 9))] for conv in range(40)}
    messages = spark.createDataFrame([(c, t, "user", x) for c, turns in rows.items() for t, x in enumerate(turns)], "conv_id long, turn long, role string, text string")
    want = {(c, t): x for c, turns in rows.items() for t, x in enumerate(linked_replies(turns))}
    found = {(r.conv_id, r.turn): (r.thread_turn, r.reply_to, r.quote_depth, r.n_quoted_turns, r.n_quoted_lines, r.text) for r in chat_quotes.reply_ordered(messages).collect()}
    assert found == want and sum(x[1] is not None for x in want.values()) > 60 and any(x[2] > 2 for x in want.values())


def test_queries_with_sql_equal_it(spark, data):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"create view {table} as select * from read_parquet('{data}/{table}.parquet')")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, data)
        found = con.execute(sql)
        at = [df.columns.index(c[0]) for c in found.description]
        assert sorted(str(tuple(r[i] for i in at)) for r in df.collect()) == sorted(str(r) for r in found.fetchall())


def test_pipeline_stages(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    made = corpus_pipeline.run(spark, data)
    assert made.columns == [*docs.columns, "ids", "n_tokens"]
    rows = made.collect()
    assert 0 < len(rows) <= docs.count() and all(r.n_chars == len(r.text) for r in rows)
    assert len({r.doc_id for r in rows}) == len(rows)
    bench = spark.read.parquet(f"{data}/benchmark.parquet")
    assert decontaminate.contamination(made, bench).where("contaminated").count() == 0
    again = simhash.near_duplicates(made)
    assert again.count() == len(rows)


def test_pipeline_equals_brute_force(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    rng = random.Random(11)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    line = lambda: " ".join(rng.choices(words, k=rng.randint(4, 12)))
    shared, items = [line() for _ in range(5)], [" ".join(rng.choices(words, k=14)) for _ in range(3)]
    texts = []
    for i in range(40):
        lines = [line() for _ in range(rng.randint(1, 6))] + rng.sample(shared, 2)
        if i % 4 == 0:
            lines.append(f"{line()} {rng.choice(items).upper()}, {line()}")
        if i % 5 == 0:
            lines = lines[:1] * 6
        texts.append("\n".join(lines) if i % 7 else texts[-1] if texts else "\n".join(lines))
    spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    docs = {}
    for i, text in enumerate(texts):  # quality: too few labels for a forest, so the rules decide
        w = text.split()
        windows = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        repeated = {j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(k, k + 8)}
        if len(w) >= 20 and 100 * len(repeated) <= 30 * len(w):
            docs[i] = text
    assert 10 < len(docs) < 40
    places = [(i, k, x) for i, t in docs.items() for k, x in enumerate(t.split("\n")) if re.search(r"[^\W_]", x)]
    lines = sorted({x for *_, x in places})
    near = lambda a, b: min(len(a), len(b)) >= 20 and abs(len(a) - len(b)) <= 8 and plain_distance(a, b) <= max(1, min(len(a), len(b)) // 40)
    root = components([(a, b) for k, a in enumerate(lines) for b in lines[:k] if near(a, b)], lines)
    seen = set()
    gone = {(i, k) for i, k, x in places if root[x] in seen or seen.add(root[x])}
    docs = {i: "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs.items()}
    fp = {i: simhash.fingerprint(t) for i, t in docs.items()}
    root = components([(i, j) for i in docs for j in docs if i < j and (fp[i] ^ fp[j]).bit_count() <= 4], docs)
    docs = {i: t for i, t in docs.items() if root[i] == i}
    phrases = {tuple(x.split()[k : k + 10]) for x in items for k in range(5)}
    found = 0
    for i, text in docs.items():
        while True:
            spans = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())]
            w = [text[a:b].lower() for a, b in spans]
            hit = sorted({j for k in range(len(w) - 9) if tuple(w[k : k + 10]) in phrases for j in range(k, k + 10)})
            if not hit:
                break
            runs = [(j, next(e for e in range(j, len(w) + 1) if e not in hit)) for j in hit if j - 1 not in hit]
            for a, b in reversed(runs):
                text = text[: spans[a][0]] + "\n" + text[spans[b - 1][1] :]
            found += 1
        docs[i] = text
    assert found
    library = sentencepiece.SentencePieceProcessor(model_file=model_path())
    made = {r.doc_id: (r.text, r.n_chars, r.ids, r.n_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert made == {i: (t, len(t), library.encode(t), len(library.encode(t))) for i, t in docs.items()}


def test_pipeline_stages_take_odd_rows_and_clashing_columns(spark, data):
    import corpus_pipeline

    docs = frame(spark, ODD, [None, 1, 2, 3, 4, 5, 6, 7, 8, 8]).selectExpr("doc_id", "text", "length(text) as n_chars", "key as ids", "fp as n_tokens", "n_words")
    for name, stage in corpus_pipeline.STAGES:
        for some in (docs, docs.limit(0)):
            made = stage(spark, some, data)
            rest = [c for c in some.columns if c not in ("ids", "n_tokens")]
            assert made.columns == (rest + ["ids", "n_tokens"] if name == "sentencepiece" else some.columns)
            assert made.count() <= some.count()
        if name in ("line_dedup", "decontamination", "sentencepiece"):
            assert stage(spark, docs, data).count() == len(ODD)
